"""python -m corvane index|serve|diff|hotspots|graph PATH: the batch surface over a file tree."""

from __future__ import annotations

import argparse
import os

from corvane.operators import filters, graph, metrics, render
from corvane.plans.serve import serve
from corvane.plans.tools import Tools
from corvane.session import get_session
from corvane.sources import trees
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="corvane")
    p.add_argument("command", choices=("index", "serve", "diff", "hotspots", "graph"))
    p.add_argument("path")
    p.add_argument("--since")
    p.add_argument("--filter-path")
    p.add_argument("--kind")
    p.add_argument("--symbol")
    p.add_argument("--public-only", action="store_true")
    p.add_argument("--max-kb", type=int, default=512)
    p.add_argument("--max-depth", type=int)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--no-gitignore", action="store_true")
    p.add_argument("-o", "--output")
    a = p.parse_args(argv)
    spark, root = get_session(), os.path.abspath(a.path)
    ignore = "" if a.no_gitignore or not os.path.exists(f"{root}/.gitignore") else open(f"{root}/.gitignore", encoding="utf-8").read()
    files = trees.scan_tree(spark, f"file:{root}", os.path.basename(root), a.max_kb, a.max_depth, tuple(a.exclude), ignore)
    from corvane.functions.scalars import line_count

    files = files.withColumn("lines", line_count(F.col("content")))
    tools = Tools.of(files)
    if a.command == "serve":
        return serve(tools)
    if a.command == "diff":
        changed = trees.git_changed(root, a.since or "HEAD")
        old = [("old", c, text) for c in changed if (text := trees.git_version(root, c, a.since or "HEAD")) is not None]
        from corvane.parsers import ingest
        from corvane.sources.languages import detect

        before = spark.createDataFrame(old, "member string, path string, content string").withColumn("language", detect(F.col("path")))
        rows = render.diff_lines(graph.structural_diff(ingest.declarations(before), tools.decls.where(F.col("path").isin(*changed)))).orderBy("path", "mark", "name")
    elif a.command == "hotspots":
        rows = metrics.hotspot_table(metrics.hotspots(tools.decls, 30)).orderBy("n")
    elif a.command == "graph":
        rows = tools.call("get_dependency_graph", path=a.filter_path)
    else:
        kept = filters.apply(tools.decls, a.filter_path, a.kind, a.public_only, a.symbol)
        rows = render.index_lines(files.join(kept.select("path").distinct(), "path", "left_semi"), kept, tools.imports).orderBy("path", "k", "n")
    text = "\n".join(r["text"] for r in rows.select("text").toLocalIterator())
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)


if __name__ == "__main__":
    main()
