"""Filters over declarations (member, path, seq, parent_seq, depth, ...) and files.

Trees are flat: a row knows its parent, and `ancestors` gives all pairs of a row and one above it, so
subtree rules are semi-joins and anti-joins on (path, seq).
"""

from __future__ import annotations

from corvane.functions import scalars as S
from pyspark.sql import Column, DataFrame, functions as F

KEY = ["path", "seq"]


def with_ancestors(decls: DataFrame, most: int = 3) -> DataFrame:
    """Adds anc: the seqs above a row, nearest first, found in rounds of one equi-join for each level up to `most`."""
    up = decls.select("path", F.col("seq").alias("up_seq"), F.col("parent_seq").alias("up_parent"))
    out = decls.withColumn("anc", F.when(F.col("parent_seq").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("parent_seq"))).withColumn("top", F.col("parent_seq"))
    for _ in range(most - 1):
        step = up.withColumnsRenamed({"up_seq": "top"})
        out = out.join(step, ["path", "top"], "left").withColumn("anc", F.when(F.col("up_parent").isNull(), F.col("anc")).otherwise(F.concat("anc", F.array("up_parent")))).withColumn("top", F.col("up_parent")).drop("up_parent")
    return out.drop("top")


def by_path(df: DataFrame, prefix: str) -> DataFrame:
    """Rows below a folder, by whole components."""
    parts = prefix.strip("/").split("/")
    return df.where(F.slice(S.path_parts(F.col("path")), 1, len(parts)) == F.array(*[F.lit(x) for x in parts]))


def by_kind(decls: DataFrame, kind: str) -> DataFrame:
    """Rows of the kind, and the rows above them."""
    tree = with_ancestors(decls)
    hit = tree.where(F.col("kind") == kind)
    keep = hit.select(*KEY).union(hit.select("path", F.explode("anc").alias("seq"))).distinct()
    return decls.join(keep, KEY, "left_semi")


def public_only(decls: DataFrame) -> DataFrame:
    """Without private rows and all that is below them."""
    private = decls.where(F.col("visibility") == "Private").select("path", "seq")
    tree = with_ancestors(decls).where(F.col("visibility") != "Private")
    below = tree.select("path", "seq", F.explode("anc").alias("up")).join(private.withColumnRenamed("seq", "up"), ["path", "up"], "left_semi").select(*KEY).distinct()
    return decls.where(F.col("visibility") != "Private").join(below, KEY, "left_anti")


def by_symbol(decls: DataFrame, query: str) -> DataFrame:
    """Rows whose name holds the query in any case, with all rows above and below them."""
    tree = with_ancestors(decls)
    hit = tree.where(F.contains(F.lower("name"), F.lit(query.lower())))
    above = hit.select("path", F.explode("anc").alias("seq"))
    below = tree.select("path", "seq", F.explode("anc").alias("up")).join(hit.select("path", F.col("seq").alias("up")), ["path", "up"], "left_semi").select(*KEY)
    return decls.join(hit.select(*KEY).union(above).union(below).distinct(), KEY, "left_semi")


def apply(decls: DataFrame, path: str | None = None, kind: str | None = None, public: bool = False, symbol: str | None = None) -> DataFrame:
    """The filters in their fixed order: path, kind, public, symbol."""
    if path:
        decls = by_path(decls, path)
    if kind:
        decls = by_kind(decls, kind)
    if public:
        decls = public_only(decls)
    return by_symbol(decls, symbol) if symbol else decls


def is_test_file(path: Column) -> Column:
    return F.lower(path).rlike("_test[.]|_spec[.]|[.]test[.]|[.]spec[.]|/test_|/tests/")


def find_file(files: DataFrame, path: str) -> DataFrame:
    """The first file in path order that is the path or ends with it at a component."""
    return files.where((F.col("path") == path) | F.endswith("path", F.lit(f"/{path}"))).orderBy(S.path_parts(F.col("path"))).limit(1)
