"""The token budget: lossy stages, each applied only while the index still costs more than the budget.

All stages' costs come from one aggregate over the declarations, so the stage is chosen before any is
applied; dropping files is one running sum over the files that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from corvane.functions import scalars as S
from corvane.operators import filters, metrics
from pyspark.sql import DataFrame, functions as F

DOC_BYTES = 80


@dataclass
class Index:
    files: DataFrame
    decls: DataFrame
    imports: DataFrame
    rels: DataFrame

    def tokens(self) -> int:
        return metrics.index_tokens(self.decls, self.imports, self.rels, self.files).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]


def _cut(decls: DataFrame) -> DataFrame:
    first = F.split("doc_comment", "\n")[0]
    return decls.withColumn("doc_comment", F.when(F.octet_length("doc_comment") > DOC_BYTES, F.concat(F.left(first, F.lit(DOC_BYTES)), F.lit("..."))).otherwise(F.col("doc_comment")))


def _strip(decls: DataFrame) -> DataFrame:
    return decls.withColumn("doc_comment", F.lit(None).cast("string"))


def apply_budget(index: Index, most: int) -> tuple[Index, int]:
    """The index within `most` tokens where that can be had, and how many stages it took (0 to 5).

    1 cuts long documents to their first line, 2 drops them, 3 drops private subtrees and files that then
    have neither declarations nor imports, 4 keeps top-level declarations alone, 5 drops the least important files but one.
    """
    now = index
    for stage in range(6):
        if stage and now.tokens() <= most:
            return now, stage - 1
        if stage == 0 and now.tokens() <= most:
            return now, 0
        if stage == 1:
            now = Index(now.files, _cut(now.decls), now.imports, now.rels)
        elif stage == 2:
            now = Index(now.files, _strip(now.decls), now.imports, now.rels)
        elif stage == 3:
            decls = filters.public_only(now.decls)
            left = decls.select("path").union(now.imports.select("path")).distinct()
            files = now.files.join(left, "path", "left_semi")
            now = Index(files, decls, now.imports, now.rels.join(decls.select("path", "seq"), ["path", "seq"], "left_semi"))
        elif stage == 4:
            decls = now.decls.where("depth = 0")
            now = Index(now.files, decls, now.imports, now.rels.join(decls.select("path", "seq"), ["path", "seq"], "left_semi"))
        elif stage == 5:
            costs = metrics.index_tokens(now.decls, now.imports, now.rels, now.files)
            public = now.decls.groupBy("path").agg(F.count_if(F.col("visibility") == "Public").alias("pub"))
            ranked = now.files.join(public, "path", "left").join(costs, "path").select("path", S.file_importance(F.col("path"), F.coalesce("pub", F.lit(0)), F.col("lines")).alias("importance"), "tokens")
            kept = metrics.drop_files(ranked, most).where("kept").select("path")
            only = lambda df: df.join(kept, "path", "left_semi")
            now = Index(only(now.files), only(now.decls), only(now.imports), only(now.rels))
    return now, 5
