"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the join uses; the rest is compared after it.
PREFIX_DIGITS = 8
#: Up to so many rules (about 200 bytes each) go to every executor; more are joined by shuffle.
BROADCAST_RULES = 100_000
#: Copies of each rule in the shuffled join, so that a prefix that most urls share is dealt over as many tasks.
SALTS = 32


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` has ``host``, ``path``, ``verdict``. A rule fits its host and every subdomain of it if the url's
    path starts with the rule's path. The longest ``host || path`` wins; of equally long ones ``block`` wins,
    then the greater text. Without a fitting rule, ``rule`` is null and ``verdict`` is ``default``.

    A url is expanded only into (number of labels, length of path) shapes that some rule has, so any prefix
    is found, at a directory's end or not, and the expansions of a url do not grow with its length. Each
    row keeps its place: equal rows stay apart, null and malformed urls get empty host and path, other
    columns of ``pages`` are dropped except those named in the result. Rules with a null or empty host
    never fit; no rules at all leave every row with ``default``.
    """
    rules = (
        rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
        .where(F.length("r_host") > 0)
        .distinct()
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_DIGITS))
    )
    # Shapes are bounded by the lengths of hosts and paths, however many rules there are.
    shapes = sorted(map(tuple, rules.select(F.size(F.split("r_host", r"\.")), F.length("r_path")).distinct().collect()))
    base = pages.select("page_id", F.col(url).alias("_url")).select("page_id", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"), F.monotonically_increasing_id().alias("_row"))
    if not shapes:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.col("_labels")
    each = [
        F.when((F.size(labels) >= n) & (F.length("path") >= m), _digest(F.array_join(F.slice(labels, -n, n), "."), F.substring("path", 1, m)))
        for n, m in shapes
    ]
    wide = base.withColumn("_labels", F.split("host", r"\.")).select("page_id", "host", "path", "_row", F.explode_outer(F.array_compact(F.array(*each))).alias("_digest"))
    wide = wide.withColumn("_prefix", F.substring("_digest", 1, PREFIX_DIGITS))
    few = rules.limit(broadcast_rules + 1).count() <= broadcast_rules
    if few:
        met = wide.join(F.broadcast(rules), F.col("_prefix") == F.col("r_prefix"), "left")
    else:
        salted = rules.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = wide.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted, (F.col("_prefix") == F.col("r_prefix")) & (F.col("_salt") == F.col("r_salt")), "left")
    text = F.concat("r_host", "r_path")
    fits = F.when(F.col("_digest") == F.col("r_digest"), F.struct(F.length(text).alias("n"), (F.col("r_verdict") == "block").alias("b"), text.alias("rule"), F.col("r_verdict").alias("verdict")))
    # All rows of a url stand in one partition, so partial aggregation leaves one row for each url to shuffle.
    best = met.groupBy("_row").agg(*[F.first(c).alias(c) for c in ("page_id", "host", "path")], F.max(fits).alias("_best"))
    return best.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
