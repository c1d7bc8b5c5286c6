"""URL filter: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A list entry is host and path prefix. A URL's candidates are its host and each
parent domain, with each prefix of its path that has a listed length. The Bloom
filter, of fixed size for any list, lets the few candidates pass that may be
listed; the join with the list removes false positives.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspan.llm import _bloom
from roadspan.llm._scratch import unused

LOG2_BYTES = 20
SMALL = 8 << 20  # bytes of rules up to which they are broadcast to the exact join
PARTS = 16  # parts that the rows of one url are dealt to when they meet its verdict
LENGTHS = 4096  # most distinct path lengths in a list
UNLISTED = "allow"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null urls and those without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of those names are replaced.

    rules: (verdict, host, path). A rule fits its host and all subdomains if
    the path starts with the rule's; the longest (host and path together, then
    the longer host) wins. No rule: null and ``allow``. Null urls have empty
    host and path, which fit no rule with a host. Rules with null or empty
    host fit nothing; of repeated rules the smallest verdict holds. Repeated
    pages are judged alike and kept, an empty table gives an empty one, without
    rules all is allowed. A very long url has a candidate for each label of its
    host and listed length of path, whatever its own length.
    """
    spark = pages.sparkSession
    base = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host(F.col(url_col)), "path": path(F.col(url_col))})
    listed = rules.where("host <> ''").groupBy(F.col("host").alias("h"), F.coalesce("path", F.lit("")).alias("p")).agg(F.min("verdict").alias("verdict"))
    lengths = sorted(r[0] for r in listed.select(F.length("p")).distinct().limit(LENGTHS + 1).collect())
    if len(lengths) > LENGTHS:
        raise ValueError(f"rules have over {LENGTHS} distinct path lengths")
    size = listed.agg(F.sum(F.octet_length("h") + F.octet_length("p") + F.octet_length(F.coalesce("verdict", F.lit(""))) + 64)).first()[0] or 0
    shared = _bloom.share(pages, _bloom.build(listed, F.xxhash64("h", "p"), LOG2_BYTES))

    def probe(batches):
        for batch in batches:
            hit = shared.value.probe(batch.column(batch.schema.get_field_index("key")).to_numpy())
            yield batch.filter(pa.array(hit))

    # each distinct host and path is judged once, whatever the number of its rows
    urls = base.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    candidates = urls.select("host", "path", F.explode(hosts).alias("h")).select("host", "path", "h", F.explode(prefixes).alias("n"))
    candidates = candidates.select("host", "path", "h", F.expr("substring(path, 1, n)").alias("p")).withColumn("key", F.xxhash64("h", "p"))
    passed = candidates.mapInArrow(probe, candidates.schema).drop("key")
    hits = passed.join(F.broadcast(listed) if size <= SMALL else listed, ["h", "p"])
    won = unused([*base.columns, "rule", "verdict"], "won")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("h", "p")), F.length("h"), F.concat("h", "p").alias("rule"), F.col("verdict").alias("v"))).alias(won))
    # rows of a common url are dealt to parts that all know its verdict; rows without a host have none to meet and stay spread
    part = unused([*base.columns, "rule", "verdict"], "part")
    dealt = base.withColumn(part, F.when(F.col("host") == "", F.spark_partition_id()).otherwise(F.pmod(F.spark_partition_id(), F.lit(PARTS))))
    spread = best.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    judged = dealt.join(spread, ["host", "path", part], "left").withColumns({"rule": F.col(f"{won}.rule"), "verdict": F.coalesce(f"{won}.v", F.lit(UNLISTED))})
    return judged.select(*base.columns, "rule", "verdict")
