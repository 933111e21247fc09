"""Type flow: which functions make and take a type."""

from __future__ import annotations

from corvane.functions.text import extract_types
from corvane.operators.search import in_order
from pyspark.sql import DataFrame, functions as F


def type_flow(decls: DataFrame, type_name: str, include_fields: bool = False, limit: int = 50) -> DataFrame:
    """(member, path, seq, role, name): producers return the type, consumers take it (fields too, if asked for); at most `limit` a role."""
    typed = decls.where(F.col("kind").isin("Function", "Method", "RpcMethod") & F.contains(F.lower("signature"), F.lit(type_name.lower())))
    typed = typed.withColumn("t", extract_types(F.col("signature"), F.col("language")))
    has = lambda c: F.exists(c, lambda x: F.lower(x) == type_name.lower())
    cols = ["member", "path", "seq", "name"]
    made = typed.where(has("t.returns")).select(*cols, F.lit("producer").alias("role"))
    used = typed.where(has("t.params")).select(*cols, F.lit("consumer").alias("role"))
    if include_fields:
        from corvane.functions.scalars import type_names

        used = used.union(decls.where(F.col("kind") == "Field").where(F.exists(type_names(F.col("signature")), lambda x: F.lower(x) == type_name.lower())).select(*cols, F.lit("consumer")))
    return in_order(made, min(limit, 200)).union(in_order(used, min(limit, 200)))
