"""URL filter: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The listed URLs are canonicalised and set in a blocked Bloom filter: a block of eight 64-bit words is
picked by one hash, and one bit of each word by another. The filter is a table with one row a block;
urls whose eight bits are all set are possible hits, and an exact hash join with the listed URLs
removes the false positives. Others never reach that join.

The filter is broadcast only while its size, which follows from the number of listed URLs and is known
before it is built, is within `BROADCAST_BYTES`; beyond that it is joined by block in a shuffle. Both
joins are plain equi-joins, whose skewed partitions adaptive execution splits.

Edge cases: a null url, or one without `://`, has an empty host and path and is not canonicalised, so
it is allowed unless a rule fits; repeated urls get equal verdicts; an empty list lists nothing; an
empty table gives no rows; of the input only the id and the url are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.common import Scratch, small

#: bits of the filter for each listed URL, and of a block
BITS_PER_URL, BLOCK_BITS, WORDS = 16, 512, 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading `www.` or `m.`, path without trailing slashes, query without tracking; null if there is no host.

    The scheme, the fragment and the parameters utm_* and ref are dropped, the others keep their order.
    """
    host = F.regexp_replace(host_of(url), "^(www|m)[.]", "")
    query = F.regexp_extract(_after_scheme(url), "^[^?#]*[?]([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike("^(utm_[^=]*|ref)(=|$)") & (p != "")), "&")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of the rules (`host/path`, verdict) that fits, else null."""
    found = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        site, _, rest = rule.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{rest}")
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
    return F.lit(None).cast("string") if found is None else found


def _bit(i: int) -> str:
    return f"shiftleft(1L, cast(shiftrightunsigned(h, {6 * i}) & 63 AS int))"


def _hashed(df: DataFrame, blocks: int) -> DataFrame:
    return df.withColumn("block", F.pmod(F.xxhash64("canon"), F.lit(blocks))).withColumn("h", F.xxhash64("canon", F.lit(1)))


def bloom_filter(listed: DataFrame, count: int) -> tuple[DataFrame, int]:
    """(block, w0..w7) over the column canon of `listed`, and the number of blocks."""
    blocks = max(1, -(-count * BITS_PER_URL // BLOCK_BITS))
    words = [F.expr(f"bit_or({_bit(i)})").alias(f"w{i}") for i in range(WORDS)]
    return _hashed(listed.select("canon"), blocks).groupBy("block").agg(*words), blocks


def listed_hits(urls: DataFrame, listed: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of `urls` (with a column canon) and whether their canon is in `listed`."""
    listed = scratch.put(listed.where("canon IS NOT NULL").select("canon").distinct(), "listed")
    bloom, blocks = bloom_filter(listed, listed.count())
    bloom = small(bloom, blocks, (WORDS + 1) * 8)
    own = urls.columns
    maybe = F.coalesce(F.expr(" AND ".join(f"(w{i} & {_bit(i)}) <> 0" for i in range(WORDS))), F.lit(False))
    probe = _hashed(urls.where("canon IS NOT NULL"), blocks).join(bloom, "block", "left").select(*own, maybe.alias("maybe"))
    probe = scratch.put(probe.unionByName(urls.where("canon IS NULL").withColumn("maybe", F.lit(False))), "probe")
    exact = probe.where("maybe").join(listed.withColumn("hit", F.lit(True)), "canon", "left")
    return exact.select(*own, F.coalesce("hit", F.lit(False)).alias("listed")).unionByName(probe.where("NOT maybe").select(*own, F.lit(False).alias("listed")))


def judge(urls: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, canon, listed, rule, verdict) of every row; `listed` has a column url."""
    base = urls.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), canonical(F.col(url_col)).alias("canon"))
    base = base.select("id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "canon")
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    found = listed_hits(base, listed.select(canonical(F.col("url")).alias("canon")), Scratch(urls.sparkSession, "urls"))
    said = F.when(F.col("listed"), "block").otherwise("allow")
    for rule, verdict in rules:
        said = F.when(F.col("rule") == rule, verdict).otherwise(said)
    return found.select("id", "host", "path", "canon", "listed", "rule", said.alias("verdict"))
