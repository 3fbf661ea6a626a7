"""Language, quality, toxicity and html against brute force, held-out accuracy and odd rows."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from orelode.llm import quality as q
from orelode.llm import html_text as h
from orelode.llm.html_text import extract_pages, main_text
from orelode.llm.langid import identify_languages, subwords, train_languages
from orelode.llm.common import char_codes
from orelode.llm.toxicity import BEGINNINGS, FactorizationMachine, best_cut, fit_machine, score_toxicity, term_buckets, train_toxicity

WORDS = {
    "en": "the of and to in that is was for it with as his on be at by had not are but from have they which one you were all her she there would their".split(),
    "de": "der die und das ist nicht ein eine mit sich auf für den dem von zu werden haben auch nach über können müssen schön größe straße wird durch".split(),
    "fr": "le la les des une est pour que dans qui sur avec pas plus être cette été même très où leur aussi comme après français élève".split(),
}


def sentence(lang, seed, n=30):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_subwords_against_plain_loops():
    texts = ["Ab c", "", "dé-f", "xyz"]
    want = Counter()
    for t in texts:
        s = "".join(c.lower() if c.isalpha() else "\1" for c in t)
        for n in (2, 3, 4):
            want[n] += sum(("\1" not in s[i + 1 : i + n - 1]) and (s[i] != "\1" or s[i + n - 1] != "\1") for i in range(len(s) - n + 1))
    found = Counter({n: len(at) for n, (at, _) in zip((2, 3, 4), subwords(*char_codes(texts)), strict=True)})
    assert found == want


def test_language_held_out_accuracy(spark):
    rows = [(k, sentence(lang, k), lang if k % 10 else None) for k, lang in enumerate(random.Random(1).choices(list(WORDS), k=300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_languages(df.where("doc_id < 200"))
    found = {r["doc_id"]: r for r in identify_languages(df, model).collect()}
    held = [(k, lang) for k, _, lang in rows if k >= 200 and lang]
    assert np.mean([found[k]["lang_pred"] == lang for k, lang in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())
    mixed = identify_languages(spark.createDataFrame([(0, "qzx wvk zzq"), (1, sentence("en", 5))], "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["score"] for r in mixed}[0] < {r["doc_id"]: r["score"] for r in mixed}[1]


def test_language_of_odd_rows(spark, docs, odd_texts):
    df = spark.createDataFrame([(k, sentence(lang, k), lang) for k, lang in enumerate(["en", "de"] * 20)], "doc_id long, text string, lang string")
    model = train_languages(df)
    out = identify_languages(docs([*odd_texts, "12 34 !"], [None, *range(len(odd_texts))], lang_pred=["?"] * (len(odd_texts) + 1)), model).collect()
    assert len(out) == len(odd_texts) + 1
    by = {r["doc_id"]: (r["lang_pred"], r["score"], r["accepted"]) for r in out}
    assert by[None] == by[0] == by[1] == by[10] == by[len(odd_texts) - 1] == ("und", 1.0, False) and by[2][0] in ("en", "de")
    assert identify_languages(docs([]), model).count() == 0
    none = train_languages(df.limit(0))
    found = identify_languages(docs(["some words", "12", None]), none).collect()
    assert sorted((r["doc_id"], r["lang_pred"], r["score"], r["accepted"]) for r in found) == [(0, "und", 0.0, False), (1, "und", 1.0, False), (2, "und", 1.0, False)]
    assert not train_languages(docs(["12", None], lang=["en", "en"])).languages


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)]


def test_counts_against_brute_force(odd_texts):
    rng = random.Random(3)
    texts = odd_texts + ["".join(rng.choice(["a", "b ", " ", "\n", "c\n", "|", "é", "\t"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    assert q.document_statistics(texts)[0].tolist() == [brute_counts(t) for t in texts]


def test_trees_keep_their_direction_and_flat_scores():
    rng = np.random.default_rng(0)
    x = rng.random((500, 2))
    y = ((x[:, 0] < 0.6) ^ (rng.random(500) < 0.1)).astype(float)
    model = q.fit_trees(x, y, np.array([-1, 0]), trees=30)
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.5)], axis=1)
    assert (np.diff(model.score(grid)) <= 1e-12).all()

    def walk(row, node):
        while model.feature[node] >= 0:
            node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
        return model.value[node]

    want = [1 / (1 + np.exp(-(model.base + sum(walk(r, root) for root in model.roots)))) for r in x[:50]]
    assert np.allclose(model.score(x[:50]), want) and ((model.score(x) > 0.5) == y).mean() > 0.85


def test_quality_of_odd_rows(spark, docs, odd_texts, prose):
    texts = [prose(60, k) if k % 2 else "BUY NOW!! " * 30 for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = q.train_quality(docs(texts), labels)
    found = q.judge_quality(docs(odd_texts, kept=["?"] * len(odd_texts)), model).collect()
    assert {r["doc_id"]: [r[c] for c in q.COUNTS] for r in found} == {k: brute_counts(t) for k, t in enumerate(odd_texts)}
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in found)
    kept = {r["doc_id"] for r in q.judge_quality(docs(texts), model).where("kept").collect()}
    assert kept == set(range(1, 80, 2)) == {r["doc_id"] for r in q.keep_good(docs(texts, extra=["e"] * 80), model).collect()}
    assert q.judge_quality(docs([]), model).count() == 0
    assert q.train_quality(docs([]), labels).score(np.zeros((1, len(q.FEATURES)))).shape == (1,)


def test_terms_against_plain_loops(odd_texts):
    texts = [t for t in odd_texts if t is None or len(t) < 20_000] + ["Bad, bad BADLY badly; b\u00e4d", "one1two"]
    rows, buckets, counts = term_buckets(texts)
    names: dict[int, set] = {}
    for k, text in enumerate(texts):
        terms = Counter()
        for word in re.findall(r"[^\W\d_]+", text or ""):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in word)
            terms.update([(low, "whole")] + [(low[:n], n) for n in BEGINNINGS if len(low) > n])
        got = dict(zip(buckets[rows == k].tolist(), counts[rows == k].tolist(), strict=True))
        assert sum(got.values()) == sum(terms.values())
        assert sorted(got.values()) == sorted(terms.values())
        for term in terms:
            one = term_buckets([term[0] if term[1] == "whole" else term[0] + "zz"])[1]
            names.setdefault(term, set()).update(b for b in one.tolist() if b in got)
    assert all(names.values())


def test_margin_is_the_double_sum():
    rng = np.random.default_rng(2)
    model = FactorizationMachine(np.arange(9), np.ones(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    row, term = np.nonzero(rng.random((7, 9)) < 0.5)
    x = rng.random(len(row))
    got = model.margin(row, term, x, 8)
    for k in range(8):
        own = [(t, v) for r, t, v in zip(row, term, x, strict=True) if r == k]
        want = 0.3 + sum(model.linear[t] * v for t, v in own)
        want += sum(float(model.factors[t] @ model.factors[u]) * v * w for i, (t, v) in enumerate(own) for u, w in own[i + 1 :])
        assert abs(got[k] - want) < 1e-9


def test_machine_learns_pairs():
    """Neither word says anything alone: label 1 if exactly both or none stand in a text."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for k in range(2000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows += [(k, b) for b in sorted({*[10] * insult, *[20] * group, 30 + int(rng.integers(50))})]
        y.append(float(insult == group))
    row, bucket = map(np.array, zip(*rows, strict=True))
    aside = np.arange(2000) % 5 == 0
    model = fit_machine(row, bucket, np.ones(len(row), dtype=int), np.array(y), aside, epochs=60)
    score = lambda m, bs: 1 / (1 + np.exp(-m.margin(*m.inputs(np.zeros(len(bs), int), np.array(bs), np.ones(len(bs))), 1)[0] - m.shift))
    assert min(score(model, [10, 20, 40]), score(model, [40])) > max(score(model, [10, 40]), score(model, [20, 40]))
    assert min(score(model, [10, 20, 40]), score(model, [40])) >= 0.7 > max(score(model, [10, 40]), score(model, [20, 40]))
    flat = FactorizationMachine(model.terms, model.weight, model.base, model.linear, np.zeros_like(model.factors), model.shift)
    assert min(score(flat, [10, 20, 40]), score(flat, [40])) < max(score(flat, [10, 40]), score(flat, [20, 40])) + 0.05  # what the factors do


def test_cut_parts_labels_best():
    z, y = np.array([9.0, 8.0, 7.0, 3.0, 2.0, 2.0, 1.0, -1.0, -2.0, -3.0, -4.0]), np.array([1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0])
    assert best_cut(z, y) == 0.0
    assert best_cut(z, np.ones(11)) is None and best_cut(z, np.zeros(11)) is None and best_cut(z[:0], y[:0]) is None


def test_toxicity_held_out_and_odd_rows(spark, docs, odd_texts, prose):
    rng = random.Random(5)
    texts, toxic = [], []
    for k in range(400):
        bad = rng.random() < 0.3
        words = prose(50, k).split()
        if bad:
            words[rng.randrange(50)] = rng.choice(["idiot", "Scum,", "moron"])
        texts.append(" ".join(words))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(k, t) for k, t in enumerate(toxic) if k < 300] + [(None, 1)], "doc_id long, toxic int")
    model = train_toxicity(docs(texts), labels)
    found = {r["doc_id"]: r for r in score_toxicity(docs(texts), model).collect()}
    assert [found[k]["predicted"] for k in range(300, 400)] == toxic[300:]
    out = score_toxicity(docs(odd_texts, score=["?"] * len(odd_texts)), model).collect()
    assert len(out) == len(odd_texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert score_toxicity(docs([]), model).count() == 0
    assert train_toxicity(docs([]), labels).score(["x"]).shape == (1,)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>The of and no";</script></head><body>
<div id="header">The site of the best of all <a href=x>Home</a></div><div class="cookie-notice">We use cookies on this site and you agree to the use of it by that.</div>
<nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav>{main}
<div class="comments"><p>I think that this is the best of the pages that I have read on the web for a long time, and I will be back.</p></div>
<form><label>Your name in the box</label><input></form><aside>About the author and the things that he did in the past.</aside><footer>&copy; 2020 The site of all</footer></body></html>"""
BODY = "<h1>Head line</h1><p>The quick brown fox jumps over the lazy dog &amp; it was the best\n of the days for <b>all</b> of them in <a href=y>the town</a> that we know.<p>Short<br>one.</p><!-- <p>no</p> --><p>The end of it is near and it was good for the people who were there with us on that day."
TEXT = "Head line The quick brown fox jumps over the lazy dog & it was the best of the days for all of them in the town that we know. Short one. The end of it is near and it was good for the people who were there with us on that day."


@pytest.mark.parametrize("main", [f"<article>{BODY}</article>", f"<main>{BODY}</main>", f'<div class="post-content">{BODY}</div>', f"<div>{BODY}</div>"])
def test_main_text(main):
    assert main_text(PAGE.replace("{main}", main)) == TEXT


def test_pages_of_all_sorts(spark):
    whole = PAGE.replace("{main}", f"<article>{BODY}</article>")
    cases = [None, "", "<", "<p", "text that stands alone", whole, whole, whole[: whole.index("near and")] + "<p cla", "<article>" * 3000 + "The end of the line", "&#x41;" * 10, "<script>never closed the of", whole * 50]
    df = spark.createDataFrame([(k, "u", c, "x") for k, c in enumerate(cases)] + [(None, None, whole, "x")], "page_id long, url string, html string, text string")
    out = {r["page_id"]: r for r in extract_pages(df).collect()}
    assert len(out) == len(cases) + 1 and out[5]["text"] == out[6]["text"] == out[None]["text"] == TEXT
    assert out[7]["text"] == TEXT[: TEXT.index(" near and")] and all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert out[0]["text"] == out[1]["text"] == out[10]["text"] == "" and out[11]["text"].count("Head line") == 50
    assert extract_pages(df.limit(0)).count() == 0


WRAPPERS = [
    '<div class="content with-sidebar"><article>{}</article></div>', '<div class="has-sidebar"><main>{}</main></div>', '<div class="content-with-sidebar">{}</div>',
    '<div class="comment-free content"><article>{}</article></div>', '<div class="social-layout"><article>{}</article></div>', '<div class="sidebar"><div class="social">{}</div></div>',
    '<div id="no-banner" class="page widget">{}</div>', '<form><div><article>{}</article></div></form>', "<aside>By the way<article>{}</article>", '<div class="share"><article>{}</article></div>',
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_keep_the_article(wrapper):
    assert main_text(PAGE.replace("{main}", wrapper.format(BODY))) == TEXT


def test_articles_of_comments_and_sidebars_go():
    for other in ('<div class="comments"><article>{}</article></div>', '<article class="comment">{}</article>', "<aside><article>{}</article></aside>"):
        assert main_text(PAGE.replace("{main}", f"<article>{BODY}</article>" + other.format("<p>I think that it was the best of all the things that I have read and we will be back in the morning.</p>"))) == TEXT


def test_copyright_sign_and_other_languages():
    signed = "<p>The photographs in this book are \u00a9 of the families that have kept them, and we are in their debt for the use of all of these pictures in the pages that follow from here.</p>"
    assert "\u00a9 of the families" in main_text(PAGE.replace("{main}", f"<div>{BODY}{signed}</div>"))
    finnish = "Talvella j\u00e4rvi j\u00e4\u00e4tyy nopeasti, jolloin kyl\u00e4l\u00e4iset k\u00e4velev\u00e4t suoraan vastarannalle. Vanhat kalastajat muistavat vuodet, jolloin lumi peitti kaikki polut ja hevoset vetiv\u00e4t kuormia mets\u00e4st\u00e4 kotiin asti. Illalla sytytettiin tulet."
    page = f'<body><nav><a href="/">Etusivu</a></nav><div><h1>Talvi</h1><p>{finnish}</p><p>{finnish}</p></div><div class="comments"><p>{finnish}</p></div><footer>\u00a9 2020</footer></body>'
    assert main_text(page) == f"Talvi {finnish} {finnish}"


def plain_labels(blocks):
    """The two passes by the letter: every unsure block looks at all others."""
    long = [b for b in blocks if not b.apart and len(b.text) >= h.SHORT and b.links / len(b.text) <= h.MOST_LINKS]
    known = sum(len(b.text.split()) for b in long) < h.KNOWN_WORDS or sum(w.lower() in h.STOP_WORDS for b in long for w in b.text.split()) / sum(len(b.text.split()) for b in long) >= h.KNOWN_STOPS
    own = [b.label(known) for b in blocks]
    held = lambda b, taken: b.apart or any(m not in taken for m in b.marks)
    taken = []
    while len(taken) < h.MOST_PEELS and not any((x == h.GOOD or x == h.UNSURE and b.inside) and not held(b, taken) for b, x in zip(blocks, own)):
        rest = [(next(m for m in b.marks if m not in taken), len(b.text)) for b, x in zip(blocks, own) if x == h.GOOD and not b.apart]
        if not rest:
            break
        taken.append(min({m for m, _ in rest}, key=lambda m: (-sum(n for k, n in rest if k == m), m)))
    first = [h.BAD if held(b, taken) else x for b, x in zip(blocks, own)]
    out = []
    for i, b in enumerate(blocks):
        decided = [j for j, c in enumerate(blocks) if first[j] != h.UNSURE and c.inside == b.inside and not (c.inside and held(c, taken))]
        near = [j for j in (max((j for j in decided if j < i), default=None), min((j for j in decided if j > i), default=None)) if j is not None]
        if first[i] != h.UNSURE:
            out.append(first[i])
        elif not near:
            out.append(h.GOOD if b.inside else h.BAD)
        else:
            ways = sorted({(abs(i - j), first[j] != h.GOOD) for j in near})
            tie = len(ways) > 1 and ways[0][0] == ways[1][0]
            out.append(h.GOOD if not ways[0][1] and (not tie or ways[0][0] <= 1) else h.BAD)
    return out


def test_labels_against_plain_passes(prose):
    rng, many = random.Random(3), " ".join(WORDS["en"])
    kinds = [lambda: f"<p>{prose(rng.randint(1, 60), rng.random())}</p>", lambda: f"<p>{many[: rng.randint(5, 120)]}</p>", lambda: f"<p><a>{many[:40]}</a> {many[: rng.randint(1, 90)]}</p>", lambda: "<p>\u00a9 x</p>"]
    wraps = ["{}", "<article>{}</article>", "<div class=comments>{}</div>", "<nav>{}</nav>", "<div class='side'><div class=content>{}</div></div>", "<main>{}</main>", "<div class=ad>{}</div>", "<div class=widget>{}</div>"]
    for _ in range(400):
        page = "".join(rng.choice(wraps).format("".join(rng.choice(kinds)() for _ in range(rng.randint(0, 4)))) for _ in range(rng.randint(1, 8)))
        blocks = h.page_blocks(page)
        assert h.label_blocks(blocks) == plain_labels(blocks), page


@pytest.mark.parametrize("unit", ['<p class="', "<a ", "<article>", "<aside><article>", "<div><nav><article></article>", "</div><p>", "<!--", "<svg>", "<b c='x>\">'", "<div class=ad>", "<!-- -->", "<script>"])
def test_time_grows_with_the_page(unit):
    def seconds(n):
        began = time.process_time()
        main_text(unit * n)
        return time.process_time() - began

    small, large = min(seconds(2000) for _ in range(3)), seconds(16000)
    assert large < 30 * small + 0.5, (small, large)
