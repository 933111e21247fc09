"""Import resolution, file and symbol graphs, bounded reach, structural diff."""

from __future__ import annotations

from functools import reduce

from corvane.functions import scalars as S
from pyspark.sql import DataFrame, Window, functions as F

#: symbols that ask for one name in one piece
PIECE = 4096


def _paths(files: DataFrame) -> DataFrame:
    low = F.lower("path")
    bare = F.when(F.element_at(S.path_parts(low), -1).rlike("[^.][.][^.]*\\z"), F.regexp_replace(low, "[.][^./]*\\z", "")).otherwise(low)
    return files.select("path", low.alias("low"), bare.alias("bare"))


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, ord, text, target): the file that each import names, if any.

    An import's candidates match path ends that need not begin at a component. Instead of comparing all
    pairs, the paths' ends of three bytes or more that some import asks for become keys: both sides
    meet in an equi-join, and each key keeps its best path (the shortest, then the first). A relative
    import asks first for the whole path it names from its own folder, then for that folder's index or mod;
    such keys begin with a line feed, which no path has.
    """
    whole = S.relative_target(F.col("path"), F.col("text"))
    first = F.when(whole.isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.array(*map(F.lit, ("", "/index", "/mod"))), lambda x: F.concat(F.lit("\n"), whole, x)))
    asked = imports.select("path", "ord", "text", F.posexplode(F.concat(first, S.import_candidates(F.col("text")))).alias("at", "key"))
    wanted = asked.select("key").distinct()
    forms = _paths(files).select("path", "low", F.explode(F.array_distinct(F.array("low", "bare", F.regexp_replace("bare", "/(mod|index)\\z", "")))).alias("form"))
    ends = forms.select("path", "low", F.explode(F.sequence(F.lit(1), F.greatest(F.length("form") - 2, F.lit(1)))).alias("i"), "form").select("path", "low", F.expr("substring(form, i)").alias("key"))
    ends = ends.union(_paths(files).select("path", "low", F.explode(F.array_distinct(F.array("low", "bare"))).alias("form")).select("path", "low", F.concat(F.lit("\n"), "form")))
    best = ends.join(wanted, "key", "left_semi").groupBy("key").agg(F.min_by("path", F.struct(F.octet_length("low"), S.path_parts(F.col("path")))).alias("target"))
    hit = asked.join(best, "key").where("target <> path").groupBy("path", "ord", "text").agg(F.min_by("target", "at").alias("target"))
    return hit


def file_graph(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst) of resolved imports between files, each once."""
    return resolve_imports(files, imports).select(F.col("path").alias("src"), F.col("target").alias("dst")).distinct()


def symbols(decls: DataFrame) -> DataFrame:
    """decls with id: path::name, and #n for the n-th of the same name in a file from the second on."""
    n = F.row_number().over(Window.partitionBy("path", "name").orderBy("seq"))
    base = F.concat_ws("::", "path", "name")
    return decls.where("name <> ''").withColumn("n", n).withColumn("id", F.when(F.col("n") == 1, base).otherwise(F.concat(base, F.lit("#"), F.col("n").cast("string")))).drop("n")


def symbol_graph(decls: DataFrame, rels: DataFrame) -> DataFrame:
    """(src, dst, kind), each once: relationships to symbols of the target's name, and signatures that hold a type's name as a word.

    Both are one equi-join of what asks for a name with what has it; types are structs, traits, enums, classes and the like. The edges of a
    common name are all pairs of the two, so both sides lose their repeats before the join, and its rows are neither shuffled nor
    sorted again. An id of two names could be met twice from one symbol; the edges to such ids alone are made distinct. A common name's
    askers are dealt in pieces of about PIECE, each of which meets all that have the name.
    """
    s = symbols(decls).select("id", "path", "seq", "name", "kind", "signature")
    typed = F.col("kind").isin("Struct", "Enum", "Trait", "Class", "Interface", "TypeAlias") & (F.octet_length("name") >= 3)
    had = s.groupBy("id", "name").agg(F.max(F.coalesce(typed, F.lit(False))).alias("typed"))
    had = had.groupBy(F.col("id").alias("dst")).agg(F.collect_list(F.struct(F.col("name").alias("word"), "typed")).alias("names"))
    own = s.join(rels.select("path", "seq", F.col("kind").alias("rel"), "target"), ["path", "seq"]).select(F.col("id").alias("src"), F.col("rel").alias("kind"), F.col("target").alias("word"), F.lit(False).alias("only"))
    refs = s.select(F.col("id").alias("src"), F.lit("References").alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("signature", F.lit("([A-Za-z0-9_]+)"), 1))).alias("word"), F.lit(True).alias("only"))
    refs = refs.join(decls.where(typed).select(F.col("name").alias("word")).distinct(), "word", "left_semi").select("src", "kind", "word", "only")
    asks = own.union(refs).groupBy("src", "kind", "word").agg(F.min("only").alias("only"))
    pieces = asks.groupBy("word").agg(F.expr(f"count(*) div {PIECE} + 1").alias("pieces"))
    asks = asks.join(pieces, "word").withColumn("piece", F.pmod(F.xxhash64("src"), "pieces"))

    def edges(ids: DataFrame) -> DataFrame:
        held = ids.select("dst", F.inline("names")).join(pieces, "word").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"))
        return asks.join(held, ["word", "piece"]).where("(typed OR NOT only) AND src <> dst").select("src", "dst", "kind")

    return edges(had.where("size(names) = 1")).union(edges(had.where("size(names) > 1")).distinct())


def _written(df: DataFrame) -> DataFrame:
    """df computed once, in the folder that `spark.checkpoint.dir` names."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp())
    return df.checkpoint()


def _between(edges: DataFrame, seen: DataFrame) -> DataFrame:
    a, b = seen.withColumnRenamed("id", "src"), seen.withColumnRenamed("id", "dst")
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")


def reach(edges: DataFrame, seeds: DataFrame, hops: int | None) -> DataFrame:
    """Edges (src, dst) whose ends are both within `hops` steps of the seeds (id), along edges; None has no bound.

    The edges are written once. One join a hop: the frontier is what the last hop newly met, and it is
    written too, so no hop computes an earlier one again.
    """
    edges = _written(edges.select("src", "dst"))
    met = [_written(seeds.select("id").distinct())]
    while (hops is None or len(met) <= hops) and not met[-1].isEmpty():
        step = edges.join(met[-1], edges["src"] == met[-1]["id"]).select(F.col("dst").alias("id")).distinct()
        met.append(_written(step.join(reduce(DataFrame.union, met), "id", "left_anti")))
    return _between(edges, reduce(DataFrame.union, met))


def reach_all(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """As reach without a bound: hops until the frontier is empty."""
    return reach(edges, seeds, None)


def structural_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind, name, change, old_signature, new_signature) of declarations down to depth 1; the last of equal keys counts."""
    key = ["path", "kind", "name"]
    last = lambda df, name: df.where("depth <= 1").groupBy(*key).agg(F.max_by("signature", "seq").alias(name))
    both = last(old, "old_signature").join(last(new, "new_signature"), key, "full_outer")
    change = F.when(F.col("old_signature").isNull(), "added").when(F.col("new_signature").isNull(), "removed").when(F.col("old_signature") != F.col("new_signature"), "modified")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*key, "change", "old_signature", "new_signature")


def mermaid_nodes(edges: DataFrame) -> DataFrame:
    """(id, node): nodes named n0, n1, ... in order of their ids."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ids.withColumn("node", F.concat(F.lit("n"), (F.row_number().over(Window.orderBy("id")) - 1).cast("string")))
