"""Texts of results: Markdown, DOT, Mermaid, diffs and column-wise rows. Lines are rows with a sort key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Edge arrows by kind.
ARROWS = {"Imports": "-->", "References": "-.->", "Extends": "==>", "Implements": "-.->|implements|"}


def joined(rows: DataFrame, *order: str, text: str = "text") -> DataFrame:
    """One row with the lines in order. For reports of bounded size; larger ones are written sorted, see write_lines."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), "\n").alias("text"))


def write_lines(rows: DataFrame, path: str, *order: str, text: str = "text") -> None:
    """Text files whose names sort as their lines do."""
    rows.orderBy(*order).select(text).write.mode("overwrite").text(path)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(edges: DataFrame) -> DataFrame:
    """(k, text) of a DOT digraph over (src, dst)."""
    spark = edges.sparkSession
    head = spark.createDataFrame([(0, "", "digraph dependencies {"), (9, "", "}")], "k int, s string, text string")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select(F.lit(1), "id", F.concat(F.lit("  "), _quoted(F.col("id")), F.lit(";")))
    arrows = edges.select(F.lit(2), F.concat_ws("\t", "src", "dst"), F.concat(F.lit("  "), _quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")), F.lit(";")))
    return head.union(nodes).union(arrows)


#: What breaks a label, and the form that Mermaid takes in its place.
MERMAID_ESCAPES = {"\\": "\\\\", '"': "#quot;", "[": "#91;", "]": "#93;", "|": "#124;", "(": "#40;", ")": "#41;", "{": "#123;", "}": "#125;"}


def mermaid_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(k, s, text) of a Mermaid graph; nodes are (id, node)."""
    spark = edges.sparkSession
    escaped = F.col("id")
    for c, name in MERMAID_ESCAPES.items():
        escaped = F.replace(escaped, F.lit(c), F.lit(name))
    head = spark.createDataFrame([(0, "", "graph LR")], "k int, s string, text string")
    a = nodes.select(F.lit(1), "id", F.concat(F.lit("  "), "node", F.lit('["'), escaped, F.lit('"]')))
    n = lambda c: nodes.select(F.col("id").alias(c), F.col("node").alias(f"{c}_node"))
    e = edges.join(n("src"), "src").join(n("dst"), "dst").select(F.lit(2), F.concat_ws("\t", "src", "dst"), F.concat(F.lit("  "), "src_node", F.lit(" --> "), "dst_node"))
    return head.union(a).union(e)


def diff_lines(changes: DataFrame) -> DataFrame:
    """(path, mark, name, text): +, - and ~ lines of a structural diff."""
    mark = F.when(F.col("change") == "added", "+").when(F.col("change") == "removed", "-").otherwise("~")
    shown = F.when(F.col("change") == "modified", F.concat(F.lit("`"), "old_signature", F.lit("` → `"), "new_signature", F.lit("`"))).otherwise(F.concat(F.lit("`"), F.coalesce("new_signature", "old_signature"), F.lit("`")))
    return changes.select("path", mark.alias("mark"), "name", F.concat_ws(" ", mark, F.lower("kind"), shown).alias("text"))


def index_lines(files: DataFrame, decls: DataFrame, imports: DataFrame, cap: int = 10) -> DataFrame:
    """(path, k, n, text) of a Markdown index: a section a file, at most `cap` imports, nested declarations."""
    head = files.select("path", F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("n"), F.concat(F.lit("## "), "path", F.lit(" ("), "language", F.lit(", "), F.col("lines").cast("string"), F.lit(" lines)")).alias("text"))
    w = Window.partitionBy("path")
    ranked = imports.withColumns({"r": F.row_number().over(w.orderBy("ord")), "c": F.count("*").over(w)})
    shown = ranked.where(F.col("r") <= cap).select("path", F.lit(1), F.col("r").cast("bigint"), F.concat(F.lit("- "), "text"))
    more = ranked.where((F.col("r") == cap + 1)).select("path", F.lit(1), F.col("r").cast("bigint"), F.format_string("- … and %d more", F.col("c") - cap))
    body = decls.select("path", F.lit(2), "seq", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- `"), "signature", F.lit("`")))
    return head.union(shown).union(more).union(body)


def compact_rows(df: DataFrame, *order: str) -> DataFrame:
    """One row: columns, and rows as arrays of texts (null where missing), in order. For results of bounded size."""
    columns = df.columns
    row = F.array(*[F.col(c).cast("string") for c in columns])
    return df.select(*order, row.alias("row")).agg(F.array(*map(F.lit, columns)).alias("columns"), F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{k}") for k, o in enumerate(order)], "row"))), lambda x: x["row"]).alias("rows"))


def index_json(files: DataFrame, decls: DataFrame) -> DataFrame:
    """(path, json): a file and its declarations in order, as one JSON text a file."""
    d = decls.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "parent_seq", "kind", "name", "signature", "visibility", "line"))).alias("declarations"))
    rows = files.join(d, "path", "left")
    return rows.select("path", F.to_json(F.struct("path", "language", "size", "lines", "declarations")).alias("json"))
