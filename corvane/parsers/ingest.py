"""Parsing as a table function: files to declarations and imports, partition by partition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from corvane.parsers.scanner import parse
from pyspark.sql import DataFrame

DECLS = (
    "member string, path string, language string, seq bigint, parent_seq bigint, depth int, kind string, name string, signature string, visibility string, line bigint, doc_comment string, "
    "is_test boolean, is_async boolean, is_deprecated boolean, body_lines bigint, cyclomatic bigint, max_nesting bigint, param_count bigint, rels array<struct<kind:string,target:string>>"
)


def declarations(files: DataFrame) -> DataFrame:
    """DECLS of files(member, path, language, content); a file that can't be parsed gives no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in DECLS.split(", ")]
        for f in frames:
            rows = []
            for member, path, language, content in f.itertuples(index=False):
                _, decls = parse(language, content or "", path)
                depth: list[int] = []
                for seq, d in enumerate(decls):
                    depth.append(0 if d.parent is None else depth[d.parent] + 1)
                    rows.append((member, path, language, seq, d.parent, depth[-1], d.kind, d.name, d.signature, d.visibility, d.line, d.doc, d.is_test, d.is_async, d.is_deprecated, d.body_lines, d.cyclomatic, d.max_nesting, d.param_count, [{"kind": k, "target": t} for k, t in d.rels]))
            yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("seq", "parent_seq", "line", "body_lines", "cyclomatic", "max_nesting", "param_count")})

    return files.select("member", "path", "language", "content").mapInPandas(run, DECLS)


def imports(files: DataFrame) -> DataFrame:
    """(member, path, ord, text) of the same files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(m, p, k, t) for m, p, lang, c in f.itertuples(index=False) for k, t in enumerate(parse(lang, c or "", p)[0])], columns=["member", "path", "ord", "text"])

    return files.select("member", "path", "language", "content").mapInPandas(run, "member string, path string, ord bigint, text string")
