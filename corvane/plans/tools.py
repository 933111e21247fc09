"""The query surface by tool name: each tool is a plan over the canonical relations.

    tools = Tools(files, decls, imports, rels, pages=pages, sources=sources)
    tools.call("find", query="parser", mode="symbol").show()

`files` is (member, path, language, size, lines[, content]); see `corvane.parsers.ingest` for the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from corvane.functions import scalars as S, text as X
from corvane.operators import filters, graph, knowledge, metrics, render, search, types
from corvane.parsers import ingest
from pyspark.sql import DataFrame, SparkSession, functions as F


class ToolError(ValueError):
    """An unknown tool, a missing argument or a path that isn't there."""


@dataclass
class Tools:
    files: DataFrame
    decls: DataFrame
    imports: DataFrame
    rels: DataFrame
    pages: DataFrame | None = None
    sources: DataFrame | None = None

    @classmethod
    def of(cls, files: DataFrame, **rest) -> Tools:
        """Tools over files with content: they are parsed first."""
        decls = ingest.declarations(files)
        rels = decls.select("member", "path", "seq", F.explode("rels").alias("r")).select("member", "path", "seq", "r.kind", "r.target")
        return cls(files, decls, ingest.imports(files), rels, **rest)

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def names(self) -> list[str]:
        return sorted(n.removeprefix("tool_") for n in dir(self) if n.startswith("tool_"))

    def call(self, tool: str, /, member: str | None = None, **args) -> DataFrame:
        """The tool's rows; `member` limits them to one member, in any case of its name."""
        f = getattr(self, f"tool_{tool}", None)
        if f is None:
            raise ToolError(f"unknown tool: {tool}")
        if member is not None:
            own = lambda df: df.where(F.lower("member") == member.lower())
            if own(self.files).isEmpty():
                raise ToolError(f"unknown member: {member}")
            f = getattr(Tools(own(self.files), own(self.decls), own(self.imports), own(self.rels), self.pages, self.sources), f"tool_{tool}")
        try:
            return f(**args)
        except TypeError as e:
            raise ToolError(str(e)) from e

    def _file(self, path: str) -> str:
        row = filters.find_file(self.files, path).first()
        if row is None:
            raise ToolError(f"file not found: {path}")
        return row["path"]

    def _wiki(self) -> tuple[DataFrame, DataFrame]:
        if self.pages is None or self.sources is None:
            raise ToolError("there is no knowledge base")
        return self.pages, self.sources

    # compound tools

    def tool_find(self, query: str, mode: str = "relevant", kind: str | None = None, limit: int | None = None) -> DataFrame:
        more = {} if limit is None else {"limit": limit}
        if mode == "relevant":
            return self.tool_search_relevant(query, kind=kind, **more)
        found = {"symbol": self.tool_lookup_symbol, "callers": self.tool_get_callers, "signature": self.tool_search_signatures}.get(mode)
        if found is None:
            raise ToolError(f"unknown mode: {mode}")
        return found(query, **more)

    def tool_summarize(self, path: str, scope: str = "all") -> DataFrame:
        """A glob's files, a symbol, a file's public declarations, or a file."""
        if any(c in path for c in "*?["):
            return self.tool_batch_file_summaries(glob=path)
        if "/" not in path and "." not in path and filters.by_path(self.files, path).isEmpty():
            return self.tool_explain_symbol(path)
        return self.tool_get_public_api(path) if scope == "public" else self.tool_get_file_summary(path)

    def tool_read(self, path: str, symbol: str | None = None, start_line: int | None = None, end_line: int | None = None, expand: int = 0, collapse: bool = False) -> DataFrame:
        return self.tool_read_source(path, symbol, start_line, end_line, expand, collapse)

    # granular tools

    def tool_read_source(self, path: str, symbol: str | None = None, start_line: int | None = None, end_line: int | None = None, expand: int = 0, collapse: bool = False) -> DataFrame:
        """(path, start, stop, source) of a symbol or of lines, at most 200, with `expand` lines around."""
        path = self._file(path)
        text = self.files.where(F.col("path") == path).select("path", F.split("content", "\n").alias("rows"))
        if symbol is not None:
            hit = self.decls.where((F.col("path") == path) & (F.lower("name") == symbol.lower())).orderBy("seq").limit(1)
            span = hit.select("path", F.col("line").alias("s"), (F.col("line") + F.coalesce("body_lines", F.lit(1))).alias("e"))
        else:
            span = self.spark.createDataFrame([(path, start_line or 1, end_line or 1 << 30)], "path string, s bigint, e bigint")
        rows = text.join(span, "path").withColumns({"s": F.greatest(F.lit(1), F.col("s") - expand), "e": F.least(F.size("rows"), F.col("e") + expand)})
        rows = rows.withColumn("e", F.least("e", F.col("s") + 199)).where("s <= e")
        source = F.array_join(F.expr("slice(rows, CAST(s AS int), CAST(e - s + 1 AS int))"), "\n")
        return rows.select("path", F.col("s").alias("start"), F.col("e").alias("stop"), (X.collapse_bodies(source) if collapse else source).alias("source"))

    def tool_list_workspace_members(self) -> DataFrame:
        return self.files.groupBy("member").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))

    def tool_lookup_symbol(self, name: str, limit: int = 50) -> DataFrame:
        return search.lookup_symbol(self.decls, name, limit)

    def tool_search_signatures(self, query: str, limit: int = 20) -> DataFrame:
        return search.search_signatures(self.decls, query, limit)

    def tool_list_declarations(self, path: str, kind: str | None = None, shallow: bool = False) -> DataFrame:
        rows = self.decls.where(F.col("path") == self._file(path))
        if kind:
            rows = rows.where(F.col("kind") == kind)
        if shallow:
            kids = rows.groupBy(F.col("parent_seq").alias("seq")).agg(F.count("*").alias("children_count"))
            rows = rows.where("depth = 0").join(kids, "seq", "left").drop("doc_comment")
        return search.in_order(rows)

    def tool_get_file_summary(self, path: str) -> DataFrame:
        return search.file_summary(self.decls.where(F.col("path") == self._file(path)))

    def tool_batch_file_summaries(self, paths: list[str] | None = None, glob: str | None = None) -> DataFrame:
        """Summaries of the first thirty files."""
        fits = F.col("path").isin(*paths) if paths else S.glob_match(F.col("path"), glob or "*")
        first = self.files.where(fits).orderBy(S.path_parts(F.col("path"))).limit(30)
        return search.file_summary(self.decls.join(first.select("path"), "path", "left_semi"))

    def tool_get_public_api(self, path: str = "", limit: int = 100) -> DataFrame:
        found = filters.find_file(self.files, path).first() if path else None
        return search.public_api(self.decls, found["path"] if found else path, limit)

    def tool_explain_symbol(self, name: str) -> DataFrame:
        return search.explain_symbol(self.decls, name)

    def tool_get_file_context(self, path: str) -> DataFrame:
        """(path, relation, import): files that import it, its tests and its neighbours."""
        path = self._file(path)
        a = search.imported_by(self.files, self.imports, path).select("path", F.lit("imported_by").alias("relation"), "import")
        return a.union(search.related_files(self.files, path).withColumn("import", F.lit(None).cast("string")))

    def tool_search_relevant(self, query: str, limit: int = 20, kind: str | None = None) -> DataFrame:
        return search.search_relevant(self.decls, self.files, query, limit, kind)

    def tool_get_callers(self, symbol: str, limit: int = 20) -> DataFrame:
        return search.callers(self.decls, self.imports, symbol, limit)

    def tool_get_related_tests(self, symbol: str, path: str | None = None) -> DataFrame:
        return search.related_tests(self.decls, symbol, path)

    def tool_get_tree(self, path: str = "") -> DataFrame:
        """Rows of the tree whose own name, not path, begins with the text."""
        return metrics.dir_tree(self.files).where(F.startswith("name", F.lit(path))).orderBy(S.path_parts(F.col("full_path")))

    def tool_get_imports(self, path: str) -> DataFrame:
        return self.imports.where(F.col("path") == self._file(path)).orderBy("ord")

    def tool_get_stats(self) -> DataFrame:
        return metrics.language_stats(self.files)

    def tool_get_token_estimate(self, path: str | None = None, symbol: str | None = None, directory: str | None = None, glob: str | None = None) -> DataFrame:
        """Costs of a symbol against its file, of a file against its summary (300), or of a folder or glob."""
        if path and symbol:
            cost = self.tool_read_source(path, symbol).select("path", S.estimate_tokens(F.col("source")).alias("tokens"))
            whole = self.files.select("path", F.expr("(size + 3) div 4").alias("file_tokens"))
            return cost.join(whole, "path").withColumn("savings_percent", S.savings_percent(F.col("tokens"), F.greatest("file_tokens", F.lit(1))))
        if path:
            return self.files.where(F.col("path") == self._file(path)).select("path", F.expr("(size + 3) div 4").alias("tokens"), F.lit(300).alias("summary_tokens"))
        rows = filters.by_path(self.files, directory) if directory else self.files
        return metrics.token_scope_breakdown(rows.where(S.glob_match(F.col("path"), glob)) if glob else rows)

    def tool_get_hotspots(self, limit: int = 20, path: str = "", min_complexity: int = 1, sort_by: str = "score") -> DataFrame:
        return metrics.hotspots(self.decls, limit, sort_by, min_complexity, path)

    def tool_get_health(self, path: str = "") -> DataFrame:
        return metrics.health(self.decls.where(F.contains("path", F.lit(path))))

    def tool_get_type_flow(self, type_name: str, path: str = "", include_fields: bool = False, limit: int = 50) -> DataFrame:
        return types.type_flow(self.decls.where(F.contains("path", F.lit(path))), type_name, include_fields, limit)

    def tool_get_dependency_graph(self, path: str | None = None, level: str = "file", format: str = "mermaid", depth: int | None = None) -> DataFrame:
        edges = graph.file_graph(self.files, self.imports) if level == "file" else graph.symbol_graph(self.decls, self.rels).select("src", "dst")
        if path is not None:
            ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().where(F.contains(F.lower("id"), F.lit(path.lower())))
            edges = graph.reach(edges, ids, depth) if depth is not None else graph.reach_all(edges, ids)
        if format == "mermaid":
            return render.mermaid_lines(edges, graph.mermaid_nodes(edges)).orderBy("k", "s").select("text")
        return render.dot_lines(edges).orderBy("k", "s").select("text") if format == "dot" else edges

    def tool_get_diff_summary(self, old: DataFrame) -> DataFrame:
        """Changes since the declarations `old`, which come from a snapshot or from files at a git ref."""
        return graph.structural_diff(old, self.decls)

    def tool_regenerate_index(self, files: DataFrame) -> DataFrame:
        """Parse `files` anew; the changes against the present declarations."""
        old = self.decls
        self.__dict__.update(vars(Tools.of(files, pages=self.pages, sources=self.sources)))
        return graph.structural_diff(old, self.decls)

    # knowledge base

    def tool_wiki_generate(self) -> DataFrame:
        """The planning context: an index text of at most 100,000 characters."""
        lines = render.index_lines(self.files, self.decls.where("depth = 0"), self.imports)
        return render.joined(lines, "path", "k", "n").select(F.left("text", F.lit(100_000)).alias("text"))

    def tool_wiki_search(self, query: str, limit: int = 5) -> DataFrame:
        pages, sources = self._wiki()
        best = knowledge.search(pages, sources, query, limit)
        return best.join(pages.select("id", X.excerpt(F.col("content"), F.lit(query)).alias("excerpt")), "id").orderBy(F.desc("score"))

    def tool_wiki_read(self, page: str) -> DataFrame:
        return knowledge.read(self._wiki()[0], page)

    def tool_wiki_status(self) -> DataFrame:
        pages, sources = self._wiki()
        return knowledge.health(pages, sources, self.files.select("path"))

    def tool_wiki_contribute(self, page: DataFrame, content: str, source_files: list[str], links_to: list[str], resolve: list[int] | None = None, now: str = "") -> DataFrame:
        return knowledge.contribute(page, content, source_files, links_to, resolve or [], now)

    def tool_wiki_update(self, changed: DataFrame) -> DataFrame:
        """(what, id): pages with a changed source, and files no page has."""
        pages, sources = self._wiki()
        a = knowledge.affected(pages, sources, changed).select(F.lit("affected").alias("what"), "id")
        return a.union(knowledge.uncovered(self.files.select("path"), sources).select(F.lit("uncovered"), "path"))

    def tool_wiki_suggest_contribution(self, synthesis: str, source_pages: tuple[str, ...] = ()) -> DataFrame:
        """(action, id, score): update the best page from twenty points on, else create."""
        best = knowledge.route(self._wiki()[0], synthesis, source_pages).orderBy(F.desc("score"), "ord").limit(1)
        return best.select(F.when(F.col("score") >= 20, "update").otherwise("create").alias("action"), "id", "score")

    def tool_wiki_compound(self, synthesis: str, source_pages: tuple[str, ...] = (), title: str | None = None) -> DataFrame:
        return self.spark.createDataFrame([knowledge.compound(self._wiki()[0], synthesis, title, source_pages)], "action string, id string")

    def tool_wiki_record_failure(self, page: DataFrame, symptom: str, actual_fix: str | None = None, now: str = "") -> DataFrame:
        return knowledge.record_failure(page, symptom, actual_fix, now)
