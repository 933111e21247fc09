"""Aggregates: statistics, health, hotspots, token costs and the token budget."""

from __future__ import annotations

from corvane.functions import scalars as S
from pyspark.sql import DataFrame, Window, functions as F

HIGH = 10


def language_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("size").alias("bytes"))


def workspace_rollup(files: DataFrame) -> DataFrame:
    """Files and lines of every member and language, of every member, and of all."""
    return files.rollup("member", "language").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("files"), F.sum("lines").alias("lines"))


def health(decls: DataFrame) -> DataFrame:
    """One row of function counts, complexity averages, order statistics and shares, rounded to one decimal."""
    f = decls.where(F.col("kind").isin("Function", "Method"))
    cc = F.array_sort(F.collect_list("cyclomatic"))
    has = F.col("cyclomatic").isNotNull()
    a = f.agg(
        F.count("*").alias("total_functions"), F.count("cyclomatic").alias("analyzed"), F.sum("cyclomatic").alias("cc"), F.sum(F.when(has, F.col("max_nesting"))).alias("nest"), F.sum(F.when(has, F.col("param_count"))).alias("par"),
        F.sum(F.when(has, F.coalesce("body_lines", F.lit(0)))).alias("body"), F.count_if(F.col("cyclomatic") >= HIGH).alias("high_complexity_count"), F.count_if(F.col("doc_comment").isNotNull()).alias("documented"),
        F.count_if("is_test").alias("test_count"), F.count_if("is_deprecated").alias("deprecated_count"), F.count_if(F.col("visibility") == "Public").alias("public_api_count"), F.max("cyclomatic").alias("max_cc"),
    )
    # order statistics over the histogram of values, which has a row for each value, whatever the corpus
    h = f.where(has).groupBy("cyclomatic").agg(F.count("*").alias("n"))
    run = Window.orderBy("cyclomatic").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("cyclomatic")))
    o = h.agg(at(F.floor((F.col("total") - 1) / 2)).alias("lo"), at(F.floor(F.col("total") / 2)).alias("hi"), at(F.floor((F.col("total") - 1) * 0.9)).alias("p90_cc"))
    n = F.greatest("analyzed", F.lit(1))
    r1 = lambda x: F.coalesce(F.round(x, 1), F.lit(0.0))
    return a.join(o, how="full_outer", on=F.lit(True)).select(
        "total_functions", "analyzed", r1(F.col("cc") / n).alias("avg_cc"), F.coalesce(F.ceil((F.col("lo") + F.col("hi")) / 2), F.lit(0)).cast("bigint").alias("median_cc"), F.coalesce("max_cc", F.lit(0)).alias("max_cc"), F.coalesce("p90_cc", F.lit(0)).alias("p90_cc"),
        r1(F.col("nest") / n).alias("avg_nesting"), r1(F.col("par") / n).alias("avg_params"), r1(F.col("body") / n).alias("avg_body_lines"), "high_complexity_count", r1(F.col("high_complexity_count") / n * 100).alias("high_complexity_pct"),
        r1(F.col("documented") / F.greatest("total_functions", F.lit(1)) * 100).alias("documented_pct"), "test_count", "deprecated_count", "public_api_count",
    )


def hottest_files(decls: DataFrame, top: int = 5) -> DataFrame:
    """Files with two analysed functions or more, of the highest mean complexity; ties by path."""
    a = decls.where(F.col("kind").isin("Function", "Method") & F.col("cyclomatic").isNotNull()).groupBy("path").agg(F.count("*").alias("functions"), F.round(F.sum("cyclomatic") / F.count("*"), 1).alias("avg_complexity"), F.max("cyclomatic").alias("max_complexity"))
    return a.where("functions >= 2").orderBy(F.desc("avg_complexity"), "path").limit(top)


def hotspots(decls: DataFrame, limit: int = 20, sort_by: str = "score", min_complexity: int = 1, path: str = "") -> DataFrame:
    """Functions by score (or complexity, nesting, params, body_lines), then path and line."""
    rows = decls.where((F.col("cyclomatic") >= min_complexity) & F.contains("path", F.lit(path)))
    rows = rows.withColumn("score", S.hotspot_score(F.col("cyclomatic"), F.col("max_nesting"), F.col("param_count"), F.col("body_lines")))
    by = {"score": "score", "complexity": "cyclomatic", "nesting": "max_nesting", "params": "param_count", "body_lines": "body_lines"}[sort_by]
    return rows.orderBy(F.desc(by), "path", "line").limit(min(limit, 100))


def dir_tree(files: DataFrame) -> DataFrame:
    """(full_path, name, is_dir, depth) of all folders above files, and of the files."""
    parts = S.path_parts(F.col("path"))
    dirs = files.select(parts.alias("p")).where("size(p) > 1").select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("depth")).select(F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("full_path"), F.col("p")[F.col("depth") - 1].alias("name"), F.lit(True).alias("is_dir"), "depth").distinct()
    return dirs.union(files.select("path", F.element_at(parts, -1), F.lit(False), F.size(parts)))


def index_tokens(decls: DataFrame, imports: DataFrame, rels: DataFrame, files: DataFrame) -> DataFrame:
    """(path, tokens): a file's cost in the index."""
    tok = S.estimate_tokens
    doc = F.when(F.col("doc_comment").isNotNull(), 2 + tok(F.col("doc_comment"))).otherwise(0)
    each = files.select("path", (15 + tok(F.col("path"))).alias("t"))
    each = each.union(imports.select("path", 3 + tok(F.col("text")))).union(decls.select("path", 3 + tok(F.col("signature")) + doc + F.when(F.col("line") > 0, 5).otherwise(0))).union(rels.select("path", 3 + tok(F.col("target"))))
    return each.groupBy("path").agg(F.sum("t").alias("tokens"))


def budget_stages(decls: DataFrame) -> DataFrame:
    """One row: the declarations' tokens as they are, with documents cut (B1), without them (B2), without private subtrees (B3), and top level only (B4)."""
    from corvane.operators.filters import public_only

    tok = S.estimate_tokens
    d = F.col("doc_comment")
    first = F.split(d, "\n")[0]
    cut = F.when(F.octet_length(d) > 80, F.concat(F.left(first, F.lit(80)), F.lit("..."))).otherwise(d)
    bare = 8 + tok(F.col("signature"))
    cost = lambda doc: F.sum(bare + F.when(doc.isNotNull(), 2 + tok(doc)).otherwise(0))
    a = decls.agg(cost(d).alias("full"), cost(cut).alias("docs_cut"), F.sum(bare).alias("no_docs"))
    kept = public_only(decls)
    b = kept.agg(F.sum(bare).alias("public"), F.sum(F.when(F.col("depth") == 0, bare)).alias("top_level"))
    return a.join(b, on=F.lit(True), how="full_outer")


def drop_files(costs: DataFrame, budget: int) -> DataFrame:
    """(path, importance, tokens, kept): the least important files go while the rest exceeds the budget, the last never."""
    order = Window.orderBy("importance", S.path_parts(F.col("path")))
    prior = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    everything = Window.partitionBy()
    out = costs.withColumns({"prior": prior, "i": F.row_number().over(order), "n": F.count("*").over(everything), "total": F.sum("tokens").over(everything)})
    return out.withColumn("kept", ~((F.col("i") < F.col("n")) & (F.greatest(F.col("total") - F.col("prior"), F.lit(0)) > budget))).select("path", "importance", "tokens", "kept")


def token_scope_breakdown(files: DataFrame, top: int = 50) -> DataFrame:
    """(path, tokens, lines, total_tokens, total_files, advice) of the first `top` files in path order; totals are over all files."""
    tokens = F.expr("(size + 3) div 4").cast("bigint")
    totals = files.agg(F.sum(tokens).alias("total_tokens"), F.count("*").alias("total_files"))
    first = files.select("path", tokens.alias("tokens"), "lines").orderBy(S.path_parts(F.col("path"))).limit(top)
    return first.join(totals, on=F.lit(True), how="inner").withColumn("advice", F.when(F.col("total_tokens") > 2000, "summaries").otherwise("full"))


def hotspot_table(rows: DataFrame) -> DataFrame:
    """Fixed-width lines (n, text) of hotspot rows, in their order of score."""
    order = Window.orderBy(F.desc("score"), "path", "line")  # a report of at most a hundred rows
    return rows.withColumn("n", F.row_number().over(order)).select("n", F.format_string("%7.1f %4d %4d %4d %5d  %s:%d %s", "score", "cyclomatic", "max_nesting", "param_count", "body_lines", "path", "line", "name").alias("text"))


def read_budget(lines: DataFrame, most: int = 500) -> DataFrame:
    """(path, seq, shown): how many lines of each symbol a read of several shows before `most` are reached, in their order."""
    w = Window.orderBy("path", "seq").rowsBetween(Window.unboundedPreceding, -1)  # the symbols of one request
    prior = F.coalesce(F.sum("lines").over(w), F.lit(0))
    return lines.select("path", "seq", F.greatest(F.lit(0), F.least("lines", F.lit(most) - prior)).cast("bigint").alias("shown"))
