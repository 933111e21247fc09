"""The thin queries over the operators, and their oracle statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import compaction, decontaminate, huffman_ids, language_id, maxscore, packing, quote_linking, secret_scan, simhash_dedup, url_filter
from corvane.llm.common import Scratch, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(f):
    QUERIES[f.__name__] = f
    return f


@register
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


#: The rules of op4.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The list, for Spark and for the oracle: one crawled URL in seven, whatever its site, as another crawl spells it. All pages are judged.
URL_LIST = """
  SELECT concat('HTTP://WWW.', regexp_replace(split_part(url, '#', 1), '^[A-Za-z]+://(www[.]|m[.])?', ''),
                CASE WHEN split_part(url, '#', 1) LIKE '%?%' THEN '&ref=list' ELSE '/?utm_source=list' END, '#top') AS url
  FROM pages WHERE page_id % 7 = 0 AND url LIKE '%://%'"""


@register
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page by the rules and by a list of URLs in another spelling."""
    pages = table(spark, sf_dir, "pages")
    found = url_filter.judge(pages, spark.sql(URL_LIST.replace("FROM pages", "FROM {pages}"), pages=pages), URL_RULES)
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


ORACLES["op4_url_filter"] = f"""
WITH every AS (SELECT page_id, url, false AS listed FROM pages UNION ALL SELECT NULL, url, true FROM ({URL_LIST})),
a AS (
  SELECT page_id, listed, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM every),
b AS (
  SELECT page_id, listed, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query FROM a),
c AS (
  SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)')), '&') AS kept FROM b),
d AS (
  SELECT page_id, listed, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '/+$', '')
         || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canon FROM c),
r AS (
  SELECT d.*, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                   WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                   WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                   WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM d WHERE NOT listed)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN canon IN (SELECT canon FROM d WHERE listed AND canon IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM r"""


@register
def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned once for each different text."""
    return secret_scan.digests(secret_scan.scan_versions(table(spark, sf_dir, "documents")))


ORACLES["op9_secret_ledger"] = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p(k, kind, pat, grp, least) AS (VALUES
  (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]{24,}', 0, 24)),
m AS (
  SELECT rid, 0 AS k, 'assign' AS kind, 6 AS least, string_split_regex(text, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)') AS parts,
         regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS hits,
         regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS tested FROM d
  UNION ALL
  SELECT rid, 1, 'access', 20, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) FROM d
  UNION ALL
  SELECT rid, 2, 'hex', 24, string_split_regex(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}', 0), regexp_extract_all(text, '[0-9a-f]{24,}', 0) FROM d),
e AS (SELECT rid, k, kind, least, unnest(range(1, len(hits) + 1)) AS i, parts, hits, tested FROM m),
f AS (SELECT rid, k, kind, least, i, length(parts[i]) AS before, length(hits[i]) AS size, length(tested[i]) AS tested FROM e),
g AS (SELECT *, sum(before + size) OVER (PARTITION BY rid, k ORDER BY i) AS stop FROM f),
h AS (
  SELECT rid, CAST(count(*) FILTER (kind = 'assign') AS BIGINT) AS n_assign, CAST(count(*) FILTER (kind = 'access') AS BIGINT) AS n_access, CAST(count(*) FILTER (kind = 'hex') AS BIGINT) AS n_hex,
         string_agg(kind || ':' || CAST(CAST(stop - size AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY stop - size, k) AS spans FROM g WHERE tested >= least GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN h USING (rid)""".replace("\\\\x20", "\\x20")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register
def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


@register
def op7_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, read back from the store they were written to."""
    path = Scratch(spark, "store").root
    huffman_ids.write_store(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return huffman_ids.read_store(spark, path).withColumnRenamed("id", "doc_id")


#: Replies as mail has them, for Spark and for the oracle: but for every fourth turn, which starts anew, a turn
#: quotes the whole turn before it in other case and spacing, and every third one, a level deeper, the turn before that.
REPLIES = """
one AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn),
near AS (
  SELECT c.conv_id, c.turn, c.role, coalesce(c.text, '') AS own, CASE WHEN c.turn % 4 <> 0 THEN a.text END AS last, CASE WHEN c.turn % 3 = 2 THEN b.text END AS older
  FROM conversations c LEFT JOIN one a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN one b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
replies AS (
  SELECT conv_id, turn, role, own, last, older,
         concat(CASE WHEN older IS NULL THEN '' ELSE concat('> > ', replace(older, chr(10), concat(chr(10), '>>')), chr(10)) END,
                CASE WHEN last IS NULL THEN '' ELSE concat('>', replace(replace(translate(last, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ', '  '), chr(10), concat(chr(10), ' > ')), chr(10)) END,
                own) AS text
  FROM near)"""


@register
def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message, written as a reply that quotes the turns before it, without its quotes and with its place in reply order."""
    talk = table(spark, sf_dir, "conversations")
    replies = spark.sql(f"WITH {REPLIES.replace('FROM conversations', 'FROM {talk}')} SELECT conv_id, turn, role, text FROM replies", talk=talk)
    return quote_linking.conversations(replies)


_NORMAL = "trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\s+', ' ', 'g'))"
_PASSAGES = """(
  SELECT {key}, {text} AS x, 2 AS part FROM replies WHERE {text} IS NOT NULL
  UNION ALL SELECT {key}, unnest(string_split_regex({text}, '\\n[ \\t]*\\n')), 1 FROM replies WHERE {text} IS NOT NULL
  UNION ALL SELECT {key}, unnest(string_split({text}, chr(10))), 0 FROM replies WHERE {text} IS NOT NULL)"""
#: The oracle knows what every reply quotes, looks for the earliest turn that says so, and walks the threads. It holds where no original has a quote mark, as in the driver's tables.
ORACLES["op1_quote_linking"] = f"""
WITH RECURSIVE {REPLIES},
said AS (SELECT conv_id, {_NORMAL.format("x")} AS p, min(turn) AS source FROM {_PASSAGES.format(key="conv_id, turn", text="own")} GROUP BY ALL),
asked AS (
  SELECT conv_id, turn, 1 AS level, part, {_NORMAL.format("x")} AS p FROM {_PASSAGES.format(key="conv_id, turn", text="last")}
  UNION SELECT conv_id, turn, 2, part, {_NORMAL.format("x")} FROM {_PASSAGES.format(key="conv_id, turn", text="older")}),
links AS (SELECT conv_id, turn, level, part, p, source FROM asked JOIN said USING (conv_id, p) WHERE p <> '' AND source < turn),
parents AS (
  SELECT conv_id, turn, count(DISTINCT (level, p)) AS n_linked, arg_max(source, (-level, part, source)) AS parent FROM links GROUP BY conv_id, turn),
walk AS (
  SELECT conv_id, turn, parent AS up, 1 AS depth FROM parents
  UNION ALL SELECT w.conv_id, w.turn, q.parent, w.depth + 1 FROM walk w JOIN parents q ON q.conv_id = w.conv_id AND q.turn = w.up),
ends AS (SELECT conv_id, turn, max(depth) AS depth, arg_max(up, depth) AS root FROM walk GROUP BY conv_id, turn)
SELECT conv_id, turn, role, trim(own, concat(' ', chr(9), chr(10), chr(12), chr(13))) AS body,
       CAST(CASE WHEN {_NORMAL.format("last")} <> '' THEN 1 ELSE 0 END + CASE WHEN {_NORMAL.format("older")} <> '' THEN 1 ELSE 0 END AS BIGINT) AS n_quotes,
       CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, parent AS parent_turn, coalesce(root, turn) AS root_turn, CAST(coalesce(depth, 0) AS INTEGER) AS depth
FROM replies LEFT JOIN parents USING (conv_id, turn) LEFT JOIN ends USING (conv_id, turn)"""


#: arrivals that the documents come in
ARRIVALS = 8


@register
def op2_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the store after its arrivals, dealt by a hash of the row, were merged.

    `arrivals` and `merged` tell of the manifests: versions that appends made, and whether the latest has fewer files than those.
    """
    store = compaction.Store(spark, Scratch(spark, "compaction").root)
    arrivals = store.append_each(table(spark, sf_dir, "documents"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(ARRIVALS)))
    before = store.version()
    after = store.compact()
    merged = store.files(after).count() < store.files(before).count()
    return compaction.file_digest(store.read(after)).withColumns({"arrivals": F.lit(arrivals).cast("bigint"), "merged": F.lit(merged)})


#: Every arrival has rows, and at least one file, so eight small ones are merged.
ORACLES["op2_size_tiered_compaction"] = """
SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, md5(coalesce(text, '')) AS text_md5, CAST(8 AS BIGINT) AS arrivals, true AS merged FROM documents"""


@register
def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors of every fiftieth one."""
    vectors = maxscore.numbered(maxscore.quantised(table(spark, sf_dir, "embeddings")), Scratch(spark, "embeddings"))
    return maxscore.top_k(vectors, vectors.where("id % 50 = 0")).withColumnRenamed("id", "vec_id")


ORACLES["op6_maxscore"] = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.v, v.v) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.rid <> q.rid)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 5"""


@register
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@register
def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, and which."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")
