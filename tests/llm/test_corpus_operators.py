"""Urls, shards, packing, near-duplicates, repeats, benchmark passages and the pipeline against brute-force versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from orelode.llm.decontaminate import Benchmark, _letters, drop_contaminated, find_passages
from orelode.llm.packing import WordTokenizer, pack_documents, plan_bins, token_pieces
from orelode.llm.queries import SHARD_WEIGHTS, URL_RULES
from orelode.llm.sharding import number_within, shard_records
from orelode.llm.simhash import Segments, keep_one, link_bucket, simhash_groups
from orelode.llm.substring_dedup import cut_out, drop_repeats, text_units
from orelode.llm.url_filter import filter_urls

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = [None, "", "nothing", "http://", "http://com/", "http://COM", "https://Example.com/en/1?x#y", "http://www.example.com/en/", "http://a.www.example.com/en/2/", "http://notexample.com/en/", "ftp://x.net/es/", "ftp://x.net/es", "ftp://x.net/fr/../es/", "http://net?q=/es/", "http://a.net#/es/", "a://b://c.com/", "http://É.com/é/", "http://example.com:80/en/", "http://..com/" + "a" * 5000, "http://" + "a." * 3000 + "com/\nen/"]


@pytest.mark.parametrize("limit", [100, 0])
def test_url_rules(spark, limit):
    rules = [*URL_RULES, ("org", "", "block"), ("org", "/a", "allow"), (None, "/", "block"), ("", "/", "block")]
    urls = URLS + [f"http://{h}{p}" for h in ("org", "x.org", "borg") for p in ("", "/", "/a", "/ab?c")]
    df = spark.createDataFrame([(k, u, "h", "c") for k, u in enumerate(urls)] + [(3, URLS[6], "h", "c")] * 2 + [(None, URLS[6], "h", "c")], "page_id long, url string, host string, rule string")
    out = filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"), broadcast_rules=limit)
    found = Counter(tuple(r) for r in out.select("page_id", "host", "path", "rule", "verdict").collect())
    real = [r for r in rules if r[0]]
    assert found == Counter([(k, *brute_verdict(u, real)) for k, u in enumerate(urls)] + [(3, *brute_verdict(URLS[6], real))] * 2 + [(None, *brute_verdict(URLS[6], real))])


def test_no_rules_or_urls(spark):
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert filter_urls(df, empty).first()[:] == (1, "a.com", "/", None, "allow")
    assert filter_urls(df.limit(0), spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).count() == 0


def test_shards(docs, odd_texts):
    texts = odd_texts + [f"t{k}" for k in range(3000)]
    ids = [*range(len(texts) - 40), *[7] * 35, *[None] * 5]
    out = shard_records(docs(texts, ids, shard=["x"] * len(texts)), SHARD_WEIGHTS).collect()
    body = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len(body(t)) + 1, zlib.crc32(body(t))) for i, t in zip(ids, texts, strict=True))
    where, slots = defaultdict(set), defaultdict(list)
    for r in out:
        where[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        slots[r["shard"]].append(r["slot"])
    assert all(len(w) == 1 for w in where.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = [g for w in where.values() for s, g in w if s != g]
    assert set(moved) == {16} and 100 < len(moved) < 260 and set(slots) == set(range(16))
    sizes = Counter(s for w in where.values() for s, _ in w)
    assert min(sizes.values()) > 130 and max(sizes.values()) < 250
    assert shard_records(docs([]), SHARD_WEIGHTS).count() == 0


def test_shard_weights_and_removal(docs):
    data = docs([""] * 4000)
    by = lambda w: {r["doc_id"]: r["shard"] for r in shard_records(data, w).collect()}
    three = by([1.0, 2.0, 1.0])
    assert 0.45 < sum(s == 1 for s in three.values()) / 4000 < 0.55
    two = by([1.0, 2.0, 0.0])
    assert all(two[k] == s for k, s in three.items() if s != 2) and 2 not in two.values()
    with pytest.raises(ValueError):
        shard_records(data, [0.0])


def test_numbering_in_small_blocks(spark):
    from pyspark.sql import functions as F

    table = spark.range(0, 1000, 1, 3).select((F.col("id") % 2).alias("g"), F.monotonically_increasing_id().alias("_row"))
    from orelode.checkpoint import materialize

    out = number_within(materialize(table, "t"), "g", "n", block_rows=16).collect()
    for g in (0, 1):
        assert sorted(r["n"] for r in out if r["g"] == g) == list(range(500))


def test_tokens_equal_the_tokenizer(odd_texts, prose):
    whole = Tokenizer.from_file(PATH)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    rng = random.Random(2)
    texts = odd_texts + ["it's  don't", " a", "a ", "a\n b", "a \nb", "a\n\nb c", "x\u2003 y z", "’ don’t", "a,b c.d \u00a0e", prose(500, 9)] + ["".join(rng.choice(["a", "B ", " ", "\n", "é", "'s", "1", ",", "\t", "ab c"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [f for t in added for f in (t, f"hello {t} world", f"a{t}b", f"{t}{t}\n", f" {t} ", t[:-1], f"it's{t} 1 {t}")]
    ids, starts = WordTokenizer(PATH).encode(texts)
    assert whole.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    for k, t in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_packing(docs, odd_texts, prose):
    texts = odd_texts + [prose(random.Random(k).randint(1, 900), k) for k in range(150)]
    data = docs(texts, length=["x"] * len(texts))
    tokenizer = WordTokenizer(PATH)
    ids = [np.append(tokenizer.whole(t or ""), 2) for t in texts]
    out = pack_documents(data, PATH, emit="ids_crc32").collect()
    whole = defaultdict(list)
    bins = defaultdict(list)
    for r in out:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(own.astype("<u4").tobytes()) == r["ids_crc32"]
        whole[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, pieces in whole.items():
        pieces.sort()
        n = len(ids[k])
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum(p[2] for p in pieces) == n
        assert all(p[2] == 1024 for p in pieces[1:]) and (len(pieces) == 1) == (n <= 1024)
    assert len(whole) == len(texts)
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    assert len(bins) <= -(-sum(map(len, ids)) // 1024) + 1
    arrays = {(r["doc_id"], r["piece"]): r["ids"] for r in token_pieces(data, PATH).collect()}
    assert [x for p in range(len(whole[12])) for x in arrays[12, p]] == ids[12].tolist()
    assert pack_documents(docs([]), PATH).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_bins_keep_every_limit(rule):
    rng = np.random.default_rng(0)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(rng.integers(1, 101, 3000), return_counts=True), strict=True)}
    bins = plan_bins(histogram, 100, max_docs=3, max_attention=6000 + 4000, rule=rule)
    placed = Counter()
    for b in bins:
        placed.update({n: k * b.count for n, k in b.content})
        assert sum(k for _, k in b.content) <= 3 and sum(n * k for n, k in b.content) <= 100 and sum(n * n * k for n, k in b.content) <= 10_000
    assert placed == histogram
    loose = sum(b.count for b in plan_bins(histogram, 100, rule="norm"))
    assert loose <= 1.03 * sum(n * c for n, c in histogram.items()) / 100 + 1
    with pytest.raises(ValueError):
        plan_bins({101: 1}, 100)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_documents_and_attention_bind(rule):
    cost = lambda b: [sum(x) for x in zip(*((n * k, k, n * n * k) for n, k in b.content), strict=True)]
    for histogram, limits, bound in (({50: 7, 20: 40}, {"max_attention": 3000}, 2), ({5: 100}, {"max_docs": 3}, 1), ({40: 11, 4: 90}, {"max_docs": 6, "max_attention": 1700}, 2)):
        bins, limit = plan_bins(histogram, 100, rule=rule, **limits), [100, limits.get("max_docs", 100), limits.get("max_attention", 10_000)]
        placed, needs = Counter(), [cost(b) for b in bins]
        for b, need in zip(bins, needs, strict=True):
            placed.update({n: k * b.count for n, k in b.content})
            assert all(x <= y for x, y in zip(need, limit, strict=True))
        assert placed == histogram
        # tokens alone would need fewer bins: the limit is what parts them
        assert sum(b.count for b in bins) > sum(b.count for b in plan_bins(histogram, 100, rule=rule))
        total = sum((n, 1, n * n)[bound] * c for n, c in histogram.items())
        assert sum(b.count for b in bins) >= total / limit[bound]


def brute_simhash(text, n):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(keys, linked):
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(keys))]


@pytest.mark.parametrize(("words", "distance", "parts"), [(4, 4, None), (4, 4, 3), (5, 7, 4), (2, 3, 2)])
def test_simhash_groups(docs, odd_texts, prose, words, distance, parts):
    texts = odd_texts + [prose(60, k) for k in range(6)]
    rng = random.Random(8)
    for base in (prose(120, 50), prose(300, 51)):
        for _ in range(12):
            w = base.split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(["zz", "The", "qq"])
            texts.append(" ".join(w))
    out = {r["doc_id"]: r for r in simhash_groups(docs(texts, fp=["x"] * len(texts)), words, distance, parts).collect()}
    keys = [brute_simhash(t, words) for t in texts]
    assert [out[k]["fp"] & (1 << 64) - 1 for k in range(len(texts))] == keys
    assert [out[k]["component_id"] for k in range(len(texts))] == brute_classes(keys, lambda a, b: (a ^ b).bit_count() <= distance)


def test_groups_with_null_and_repeated_ids(docs, prose):
    texts, ids = [prose(50, 1), prose(50, 1), prose(50, 1), prose(50, 2), prose(50, 2), None], [None, 5, 5, None, None, 9]
    data = docs(texts, ids, source=list("abcdef"))
    groups = simhash_groups(data)
    assert Counter((r["doc_id"], r["component_id"]) for r in groups.collect()) == Counter([(None, 5), (5, 5), (5, 5), (None, None), (None, None), (9, 9)])
    kept = keep_one(data, groups).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept) == sorted([(5, texts[0]), (-1, texts[3]), (9, "")])
    assert simhash_groups(docs([])).count() == 0
    # rows with one doc_id in several components, and links between rows without one
    again = docs([prose(50, 1), prose(50, 2), prose(400, 3), prose(400, 3) + " end"], [5, 5, None, None])
    assert len(keep_one(again, simhash_groups(again)).collect()) == 3


def test_more_tables_find_more(docs, prose):
    texts, rng = [], random.Random(1)
    for k in range(60):
        w = prose(150, k).split()
        texts.append(" ".join(w))
        for j in rng.sample(range(150), 3):
            w[j] = "zz"
        texts.append(" ".join(w))
    n = lambda t: len({r["component_id"] for r in simhash_groups(docs(texts), 5, 7, tables=t).collect()})
    one, four = n(1), n(4)
    assert 60 <= four <= 80 and four < one  # about three of four pairs that share 0.8 of their shingles


def edited_pairs(prose, edits, n=40):
    """Texts of 150 words, each followed by a copy with so many words replaced: Jaccard (146 - 5 edits) / (146 + 5 edits)."""
    texts, rng = [], random.Random(edits)
    for k in range(n):
        w = prose(150, 900 + k).split()
        texts.append(" ".join(w))
        for j in rng.sample(range(5, 145, 7), edits):
            w[j] = f"zz{j}"
        texts.append(" ".join(w))
    return texts


def test_near_dedup_keeps_what_is_less_similar(spark, docs, prose):
    import corpus_pipeline

    texts = edited_pairs(prose, 4)  # 0.76
    kept = corpus_pipeline.near_dedup(spark, docs([*texts, texts[0], None, ""], [*range(80), None, None, 90]), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [*range(80), 90]


def test_near_dedup_finds_every_pair(spark, docs, prose, monkeypatch):
    import corpus_pipeline
    from orelode.llm import jaccard

    texts = edited_pairs(prose, 3)  # 0.81
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(texts), "").collect()) == list(range(0, 80, 2))
    # chains, and groups and buckets that are dealt in blocks
    w = prose(150, 999).split()
    chain = [" ".join([*w[k:], *(f"q{j}" for j in range(k))]) for k in range(0, 120, 8)]
    copies = [" ".join([*w[:75], f"z{k}", *w[75:]]).upper() for k in range(120)]
    for block in (1 << 13, 20):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "GROUP_BLOCK", block)
        found = jaccard.near_groups(docs(chain + copies + texts[:2])).collect()
        want = brute_classes([{tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in chain + copies + texts[:2]], lambda a, b: len(a & b) >= 0.8 * len(a | b))
        assert [r["component_id"] for r in sorted(found, key=lambda r: r["doc_id"])] == want


def test_large_bucket_is_parted():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = base[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    table = np.unique(np.concatenate([base, near]))
    a, b = link_bucket(table, table[:0], 4)
    assert len(a) == 500 and (np.bitwise_count(a ^ b) <= 4).all()
    for distance in range(1, 9):
        for parts in range(2, distance + 2):
            s = Segments(distance, parts)
            assert sum(s.widths) == 64 and sum(r + 1 for r in s.radii) == distance + 1


def test_repeats(docs, prose):
    passage = prose(80, 99)
    texts = [prose(60, k) + (" " + passage + " " if k % 2 else " ") + prose(60, k + 50) for k in range(8)] + [None, "", "short one", passage, passage]
    ids = list(range(len(texts) - 1)) + [None]
    found = {r["doc_id"]: r for r in drop_repeats(docs(texts, ids, removed=["x"] * len(texts), spans=["x"] * len(texts))).collect()}
    inner = passage[len(passage) // 4 : 3 * len(passage) // 4]
    assert found[1]["text"] == texts[1] and all(found[k]["text"] == texts[k] for k in (0, 2, 4, 6, 8, 9, 10))
    for k in (3, 5, 7):
        spans = [(s["begin"], s["end"]) for s in found[k]["removed"]]
        assert inner not in found[k]["text"] and found[k]["text"] == cut_out(texts[k], spans)
        assert all(texts[k][b:e].strip()[:20] in texts[1] for b, e in spans)
    assert all(len(found[k]["text"].split()) < 8 for k in (11, None))
    assert drop_repeats(docs([])).count() == 0


def test_repeats_within_a_document_and_against_brute_force(docs, prose, odd_texts):
    texts = odd_texts + [prose(30, 1) + "\n" + prose(30, 2) + "\n" + prose(30, 1)]
    found = {r["doc_id"]: r for r in drop_repeats(docs(texts)).collect()}
    of, begin, end, digest = text_units(texts)
    seen, gone = set(), defaultdict(set)
    for t, b, e, d in zip(of.tolist(), begin.tolist(), end.tolist(), digest.tolist(), strict=True):
        if d in seen:
            gone[t].add((b, e))
        seen.add(d)
    for k, t in enumerate(texts):
        assert [(s["begin"], s["end"]) for s in found[k]["removed"]] == sorted(gone[k])
        assert found[k]["text"] == (t if t is None else cut_out(t, sorted(gone[k])))


@pytest.mark.parametrize("ids", [None, [7] * 12])
def test_whole_lines_and_ends_of_texts_repeat(docs, prose, ids):
    short, long = "All rights reserved", "Released under the terms that every one of the many authors of this text has agreed to, see below"
    texts = [f"{prose(20, 2 * k)}\n{short}\n{prose(30, 2 * k + 1)}\n{long}\n{prose(5, 70 + k)}" for k in range(4)]
    end = prose(26, 90) + "\n" + "So it ended there"
    texts += [prose(20, 50) + "\n" + end, prose(20, 51) + "\n" + end, "two words", "Two words!", "two words", "other words", "One line that stands alone", "One line that stands alone"]
    out = drop_repeats(docs(texts, ids, at=[str(k) for k in range(len(texts))])).collect()
    found = {int(r["at"]): r for r in out}
    if ids:  # rows with equal doc_id don't take from each other
        assert all(found[k]["text"] == t for k, t in enumerate(texts))
        return
    assert all(found[k]["text"] == texts[k] for k in (0, 4, 6, 9, 10))
    for k in (1, 2, 3):
        assert found[k]["text"].strip() == texts[k].replace("\n" + short, "").replace("\n" + long, "").strip()
    assert found[5]["text"].strip() == texts[5].removesuffix(end).strip()
    assert all(not found[k]["text"].strip() for k in (7, 8, 11))


def sellers(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i - 1] + (x != c), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_passages_against_full_alignment(spark, docs, prose, odd_texts):
    rng = random.Random(5)
    items = [prose(25, 200 + k) for k in range(6)] + ["too short"]
    texts = []
    for k in range(30):
        t = prose(60, k)
        if k % 2:
            s = list(items[k % 6])
            for _ in range(rng.randint(0, int(len(s) * 0.14))):
                j, kind = rng.randrange(len(s)), rng.random()
                if kind < 0.4:
                    s[j] = rng.choice("abcdefgh")
                elif kind < 0.7:
                    s.insert(j, rng.choice("abcdefgh"))
                else:
                    s.pop(j)
            j = rng.randrange(len(t))
            t = t[:j] + "".join(s) + t[j:]
        texts.append(t)
    texts.append(items[0].upper().replace(" ", " \n ") + items[1])
    own = Benchmark.of(list(range(7)), items)
    want = {}
    for k, t in enumerate(texts):
        letters = _letters([t])[0].tolist()
        for i in range(6):
            e = sellers(own.letters[i].tolist(), letters)
            if e <= own.budget[i]:
                want[k, i] = e
    table = spark.createDataFrame([*enumerate(items), (9, None), (0, items[0])], "item_id long, text string")
    data = docs(texts, item_id=["x"] * len(texts))
    for block in (4_000_000, 200):
        found = find_passages(data, table, block_letters=block).collect()
        assert {(r["doc_id"], r["item_id"]): r["edits"] for r in found} == want
        for r in found:
            piece = texts[r["doc_id"]][r["begin"] : r["end"]]
            assert abs(len(piece) - len(items[r["item_id"]])) <= 0.3 * len(items[r["item_id"]])
    kept = {r["doc_id"] for r in drop_contaminated(data, table, block_letters=200).collect()}
    assert kept == set(range(len(texts))) - {k for k, _ in want}
    assert find_passages(docs(odd_texts), table).count() == 0 and drop_contaminated(docs(odd_texts), table).count() == len(odd_texts)
    assert find_passages(docs([]), table).count() == 0 and find_passages(data, table.limit(0)).count() == 0


def test_pipeline(spark, prose, tmp_path):
    import corpus_pipeline

    good = [prose(120, k) for k in range(60)]
    item, passage = prose(30, 500), prose(70, 501)
    texts = good + [good[0], good[1].replace("the", "tha", 1)] + ["BUY NOW!! " * 40] * 20 + ["tiny"] + [prose(120, 800) + " " + item] + [prose(100, 600 + k) + " " + passage + " " + prose(100, 700 + k) for k in range(3)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(82)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    from orelode.checkpoint import materialize

    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        ids[name] = docs.select("doc_id").distinct().toPandas()["doc_id"].tolist()
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(ids["quality"]) == set(range(62)) | set(range(83, 87))
    assert set(ids["near_dedup"]) == set(ids["quality"]) - {60, 61}
    assert set(ids["substring_dedup"]) == set(ids["near_dedup"])
    assert set(ids["decontaminate"]) == set(ids["near_dedup"]) - {83} == set(ids["pack"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in whole.select("doc_id").distinct().collect()) == sorted(ids["pack"])
