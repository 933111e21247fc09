"""Canonical relations over the driver's tables, in SQL that Spark and the oracle both read."""

from __future__ import annotations

from corvane.functions.scalars import line_count
from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Common table expressions: parts stand in for declarations of a source tree of a file for each twenty parts, and forty files at least.
CTES = """
tree_size AS (SELECT greatest(CAST(40 AS BIGINT), CAST(floor(count(*) / 20.0) AS BIGINT)) AS n FROM part),
p AS (
  SELECT CAST(p_partkey AS BIGINT) AS k, CAST(floor(p_partkey / CAST((SELECT n FROM tree_size) AS DOUBLE)) AS BIGINT) AS seq, CAST(p_partkey AS BIGINT) % (SELECT n FROM tree_size) AS f, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size,
         split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part),
q AS (
  SELECT *, upper(substr(w1, 1, 1)) || substr(w1, 2) || upper(substr(w2, 1, 1)) || substr(w2, 2) AS camel,
         'member_' || CAST(f % 3 AS STRING) AS member,
         'src/' || CASE WHEN f % 5 = 4 THEN 'm3-x' ELSE 'm' || CAST(f % 5 AS STRING) END || '/file_' || CAST(f AS STRING)
         || CASE WHEN f % 4 = 0 THEN '.rs' WHEN f % 4 = 1 THEN '.py' WHEN f % 4 = 2 THEN '.ts' ELSE '.go' END AS path,
         CASE WHEN f % 4 = 0 THEN 'Rust' WHEN f % 4 = 1 THEN 'Python' WHEN f % 4 = 2 THEN 'TypeScript' ELSE 'Go' END AS language,
         seq % 10 AS r FROM p),
decls AS (
  SELECT member, path, language, k, seq,
         CASE WHEN r IN (1, 2, 3, 4) THEN seq - r WHEN r = 5 THEN seq - 5 WHEN r IN (6, 7) THEN seq - r + 5 END AS parent_seq,
         CASE WHEN r IN (1, 2, 3, 4, 5) THEN 1 WHEN r IN (6, 7) THEN 2 ELSE 0 END AS depth,
         CASE WHEN r = 0 THEN 'Struct' WHEN r IN (1, 2) THEN 'Method' WHEN r IN (3, 4) THEN 'Field' WHEN r = 5 THEN 'Trait' WHEN r IN (6, 7) THEN 'Function' WHEN r = 8 THEN 'Constant' ELSE 'Enum' END AS kind,
         CASE WHEN seq % 3 = 0 THEN w1 || '_' || w2 || '_' || CAST(k % 17 AS STRING) WHEN seq % 3 = 1 THEN w1 || upper(substr(w2, 1, 1)) || substr(w2, 2) ELSE camel END AS name,
         CASE WHEN r IN (1, 2, 6, 7) THEN 'fn ' || w1 || '_' || w2 || '(a: ' || camel || ', b: &' || w2 || '_' || w1 || ') -> Option<' || upper(substr(w2, 1, 1)) || substr(w2, 2) || '>' ELSE 'item ' || camel END AS signature,
         CASE WHEN p_size % 3 = 0 THEN 'Public' WHEN p_size % 3 = 1 THEN 'Private' ELSE 'PublicCrate' END AS visibility,
         seq * 10 + 1 AS line,
         CASE WHEN p_size % 4 = 0 THEN CAST(NULL AS STRING) WHEN p_size % 4 = 1 THEN 'Handles the ' || p_name || ' of ' || p_type || ', with care for what comes before it and after it in the list.' ELSE 'Handles the ' || p_name || '.' END AS doc_comment,
         p_size % 7 = 0 AS is_test, p_size % 11 = 0 AS is_async, p_size % 13 = 0 AS is_deprecated,
         CASE WHEN r IN (1, 2, 6, 7) THEN p_size END AS body_lines,
         CASE WHEN r IN (1, 2, 6, 7) THEN k % 19 + 1 END AS cyclomatic,
         CASE WHEN r IN (1, 2, 6, 7) THEN k % 5 END AS max_nesting,
         CASE WHEN r IN (1, 2, 6, 7) THEN k % 4 END AS param_count FROM q),
files AS (SELECT member, path, language, CAST(sum(coalesce(body_lines, 3)) * 37 AS BIGINT) AS size, CAST(sum(coalesce(body_lines, 3)) AS BIGINT) AS lines FROM decls GROUP BY member, path, language),
imports AS (
  SELECT member, path, seq AS ord,
         CASE WHEN f % 4 = 0 THEN 'use crate::m' || CAST(((f * 7 + seq * 3 + 1) % (SELECT n FROM tree_size)) % 5 AS STRING) || '::file_' || CAST((f * 7 + seq * 3 + 1) % (SELECT n FROM tree_size) AS STRING) || ';'
              WHEN f % 4 = 1 THEN 'import file_' || CAST((f * 7 + seq * 3 + 1) % (SELECT n FROM tree_size) AS STRING)
              WHEN f % 4 = 2 AND seq % 2 = 1 THEN 'import { a } from ''../m' || CAST(((f * 7 + seq * 3 + 1) % (SELECT n FROM tree_size)) % 5 AS STRING) || '/file_' || CAST((f * 7 + seq * 3 + 1) % (SELECT n FROM tree_size) AS STRING) || ''''
              WHEN f % 4 = 2 THEN 'import { a } from ''./file_' || CAST((f * 7 + seq * 3 + 1) % (SELECT n FROM tree_size) AS STRING) || ''''
              ELSE '"m2/file_' || CAST((f * 7 + seq * 3 + 1) % (SELECT n FROM tree_size) AS STRING) || '"' END AS text FROM q WHERE seq < 4),
rels AS (SELECT member, path, seq, CASE WHEN k % 2 = 0 THEN 'Implements' ELSE 'Extends' END AS kind, camel || CASE WHEN k % 3 = 0 THEN '' ELSE '_x' END AS target FROM q WHERE r = 0)
"""

#: Documents stand in for the pages of a knowledge base.
WIKI = """
pages_w AS (
  SELECT d.doc_id AS ord, 'page-' || CAST(d.doc_id AS STRING) AS id, substr(d.text, 1, 40) AS title,
         CASE WHEN d.doc_id % 5 = 0 THEN 'architecture' WHEN d.doc_id % 5 = 1 THEN 'module' WHEN d.doc_id % 5 = 2 THEN 'entity' WHEN d.doc_id % 5 = 3 THEN 'topic' ELSE 'index' END AS page_type,
         d.text AS content, coalesce(l.toxic, 0) AS toxic, coalesce(l.quality, 0) AS quality
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
sources_w AS (
  SELECT ord, id, 'src/file_' || CAST(ord % 37 AS STRING) || '.rs' AS source FROM pages_w WHERE ord % 4 <> 3
  UNION ALL SELECT ord, id, 'src/file_' || CAST((ord * 3 + 5) % 53 AS STRING) || '.rs' AS source FROM pages_w WHERE ord % 2 = 0),
tracked AS (SELECT DISTINCT 'src/file_' || CAST(doc_id % 80 AS STRING) || '.rs' AS path FROM documents),
changed AS (SELECT path FROM tracked WHERE path LIKE '%3%'),
deleted AS (SELECT path FROM tracked WHERE path LIKE '%1%')
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str, ctes: str = CTES) -> DataFrame:
    """One of the common table expressions over the tables in `sf_dir`."""
    used = [t for t in TABLES if f" {t}" in ctes]
    heads = ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in used)
    return spark.sql(f"WITH {heads}, {ctes} SELECT * FROM {name}")


def documents_as_files(docs: DataFrame) -> DataFrame:
    """files(member, path, language, size, lines, content) of documents."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("source").alias("member"),
        F.format_string("%s/%s/doc_%s.md", "source", "lang", F.col("doc_id").cast("string")).alias("path"),
        F.lit("Markdown").alias("language"),
        F.octet_length(text).cast("bigint").alias("size"),
        line_count(text).alias("lines"),
        text.alias("content"),
    )
