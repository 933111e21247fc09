"""Shared pieces: table access, scratch tables in the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, as the cluster names it in spark.checkpoint.dir.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster it is an error,
    since its machines share no local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: rows that go to a Python worker at once: whole texts of any length are among them
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS, so that batches of long texts fit beside the executor's heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: a table of a size known beforehand is broadcast up to this
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """`df`, to be broadcast if its `rows` (counted before) of `row_bytes` are within BROADCAST_BYTES; else shuffled."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added to those that `df` has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(id_col: str, text_col: str) -> Column:
    """A digest of a row's id and text, never null: rows that agree in both have one fate in every stage."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), quoted(c).cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(part(id_col), F.lit("\n"), part(text_col)), 256))


class Scratch:
    """Tables written into the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component.

    Alternates the large-star and the small-star step until the edges no longer change. Each
    step is a map-side combined minimum and an equi-join; each round's edges are a written table.
    """
    now = scratch.put(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc0"
    )
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, k = mark(now), 0
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        after = scratch.put(small.where("u <> v").distinct(), f"cc{k + 1}")
        found = mark(after)
        if k:
            scratch.drop(f"cc{k}")
        k, now = k + 1, after
        if found == before:
            break
        before = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
