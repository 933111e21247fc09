"""Secret scans with an incremental blob ledger.

Every version of a path is content-addressed by the SHA-256 of its text. The ledger is an append-only
table of (blob_id, rule_version) with the findings. A scan takes the blobs whose pair with the present
rule version is not in the ledger, reads one representative row of each, appends their findings, and
joins the ledger back to all paths. So a text that is copied, moved back, or seen in an earlier run is
scanned once for each rule version.

The unseen pairs are written as a narrow table before any text is looked at. The rows that they pick go
through an aggregate (one row of each blob), which the optimiser moves no filter across, so the regular
expressions meet unseen texts alone. Where the pairs are few, by their count, they are broadcast and no
seen text moves; else one exchange of texts serves both the join and the aggregate.

Positions come from splitting the text at the matches: the pieces before, and the lengths of the
matches, add up to starts in code points. All of it is built-in SQL.

Edge cases: a null text is the empty blob; a text without secrets has the counts zero, the digest of
the empty string and empty spans; repeated rows are one blob and keep their rows; an empty table gives
no rows; matches of one text are summed up in a window over that text alone, however long; of the
input only the key columns and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corvane.llm.common import Scratch, fresh, quoted, small

#: Kind, pattern whose leftmost matches count, group whose length is tested, least length.
RULES = (
    ("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)
#: A match that is long enough is found by these too; they spare a text that has none.
SIEVES = {"assign": RULES[0][1].removesuffix("+)") + "{6,})", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
#: Patterns with the same long matches and fewer short ones: a run that is too short holds no other match.
PATTERNS = {"assign": RULES[0][1], "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
RULE_VERSION = "base-1"


#: bytes of a picked pair: a digest in hexadecimal, a key and the row around them
PICKED_BYTES = 160
NO_FINDINGS = "CAST(array() AS array<struct<start:bigint,k:int,kind:string,end:bigint>>)"


def _spot(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def content_address(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with a column blob_id."""
    return versions.withColumn("blob_id", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def scan(blobs: DataFrame) -> DataFrame:
    """(blob_id, kind, start, end) of every finding in `blobs` (blob_id, text)."""

    def matches(order: int, kind: str, group: int) -> str:
        p = "'" + PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'") + "'"
        sieve = "'" + SIEVES[kind].replace("\\", "\\\\").replace("'", "\\'") + "'"
        found = f"arrays_zip(transform(split(text, {p}, -1), x -> length(x)), transform(regexp_extract_all(text, {p}, 0), x -> length(x)), transform(regexp_extract_all(text, {p}, {group}), x -> length(x)))"
        return f"CASE WHEN text RLIKE {sieve} THEN transform({found}, (z, i) -> struct({order} AS k, i AS i, z.`0` AS before, z.`1` AS size, z.`2` AS tested)) ELSE CAST(array() AS array<struct<k:int,i:int,before:int,size:int,tested:int>>) END"

    every = ", ".join(matches(k, kind, group) for k, (kind, _, group, _) in enumerate(RULES))
    rows = blobs.select("blob_id", F.expr(f"concat({every})").alias("found")).where(F.size("found") > 0).select("blob_id", F.expr("inline(found)")).where("size IS NOT NULL")
    run = Window.partitionBy("blob_id", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("before").cast("bigint") + F.col("size")).over(run))
    least = F.element_at(F.array(*[F.lit(r[3]) for r in RULES]), F.col("k") + 1)
    kind = F.element_at(F.array(*[F.lit(r[0]) for r in RULES]), F.col("k") + 1)
    return placed.where(F.col("tested") >= least).select("blob_id", "k", kind.alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")


class BlobLedger:
    """The append-only ledger at `path`; it is made with the first append."""

    SCHEMA = "blob_id string, rule_version string, findings array<struct<start:bigint,k:int,kind:string,end:bigint>>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def unseen(self, addressed: DataFrame, key: str, rule_version: str = RULE_VERSION) -> DataFrame:
        """(blob_id, spot) of each blob that the ledger lacks for this rule version; spot is its least key, as text."""
        seen = self.read().where(F.col("rule_version") == rule_version).select("blob_id").distinct()
        return addressed.groupBy("blob_id").agg(F.min(_spot(key)).alias("spot")).join(seen, "blob_id", "left_anti")

    def blobs(self, addressed: DataFrame, key: str, picked: DataFrame, count: int) -> DataFrame:
        """(blob_id, text) of the picked blobs, once each, however often a row is repeated."""
        rows = addressed.select("blob_id", _spot(key).alias("spot"), F.coalesce("text", F.lit("")).alias("text"))
        few = small(picked, count, PICKED_BYTES)
        return rows.join(few, ["blob_id", "spot"], "left_semi").dropDuplicates(["blob_id", "spot"]).select("blob_id", "text")

    def update(self, addressed: DataFrame, key: str, rule_version: str = RULE_VERSION) -> int:
        """Scan what `addressed` (key, blob_id, text) has and the ledger lacks; returns the number of blobs scanned.

        A run that fails before its append leaves the ledger as it was; runs side by side may append a
        blob twice, which `findings` reads once.
        """
        scratch = Scratch(self.spark, "unseen")
        picked = scratch.put(self.unseen(addressed, key, rule_version), "picked")
        count = picked.count()
        if count:
            found = scan(self.blobs(addressed, key, picked, count)).groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("start", "k", "kind", "end"))).alias("findings"))
            rows = picked.select("blob_id").join(found, "blob_id", "left")
            rows.select("blob_id", F.lit(rule_version).alias("rule_version"), F.coalesce("findings", F.expr(NO_FINDINGS)).alias("findings")).write.mode("append").parquet(self.path)
        scratch.drop("picked")
        return count

    def findings(self, rule_version: str = RULE_VERSION) -> DataFrame:
        """(blob_id, findings) of the blobs with any."""
        return self.read().where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select("blob_id", "findings").dropDuplicates(["blob_id"])


def scan_versions(versions: DataFrame, ledger_path: str | None = None, key: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """(key, blob_id, findings) of every row; findings is null where there are none.

    The ledger at `ledger_path` (by default a fresh one in the shared folder) is brought up to date first.
    """
    spark = versions.sparkSession
    scratch = Scratch(spark, "secrets")
    ledger = BlobLedger(spark, ledger_path or scratch.path("ledger"))
    addressed = content_address(versions.select(key, F.col(text_col).alias("text")))
    paths = scratch.put(addressed.select(key, "blob_id"), "paths")
    ledger.update(addressed, key, rule_version)
    return paths.join(ledger.findings(rule_version), "blob_id", "left").select(key, "blob_id", "findings")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_<kind>..., base_sha256, spans) of scan_versions' rows."""
    rows = found.withColumn("findings", F.coalesce("findings", F.expr(NO_FINDINGS)))
    spans = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.expr(f"CAST(size(filter(findings, x -> x.k = {k})) AS bigint)").alias(f"n_{kind}") for k, (kind, *_) in enumerate(RULES)]
    return rows.select(key, *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with each secret replaced by `[kind]`; overlapping spans are one, of the first kind.

    The length column, where there is one, gets the new text's length in changed rows. Columns of any
    name are carried unchanged.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "redact")
    ledger = BlobLedger(spark, scratch.path("ledger"))
    ledger.update(content_address(docs.select(F.col(key), F.col(text_col).alias("text"))), key)
    at, blob, hits, made = fresh(docs, "_at", "_blob", "_findings", "_text")
    found = ledger.findings().withColumnsRenamed({"blob_id": blob, "findings": hits})
    joined = docs.withColumn(at, F.sha2(F.coalesce(quoted(text_col), F.lit("")), 256)).join(found, F.col(at) == F.col(blob), "left")
    pieces = (
        f"aggregate({hits}, struct(0L AS pos, CAST(array() AS array<string>) AS out), (a, x) -> IF(x.start < a.pos, struct(greatest(a.pos, x.end) AS pos, a.out AS out), "
        f"struct(x.end AS pos, concat(a.out, array(substring(`{text_col}`, CAST(a.pos + 1 AS int), CAST(x.start - a.pos AS int)), concat('[', x.kind, ']'))) AS out)), "
        f"a -> concat(array_join(a.out, ''), substring(`{text_col}`, CAST(a.pos + 1 AS int))))"
    )
    changed = F.col(hits).isNotNull()
    out = joined.withColumn(made, F.when(changed, F.expr(pieces)).otherwise(quoted(text_col)))
    cols = []
    for c, kind in docs.dtypes:
        if c == text_col:
            cols.append(F.col(made).alias(c))
        elif c == length_col:
            cols.append(F.when(changed, F.length(made).cast(kind)).otherwise(quoted(c)).alias(c))
        else:
            cols.append(quoted(c))
    return out.select(*cols)
