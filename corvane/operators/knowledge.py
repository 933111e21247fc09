"""The knowledge base: search, routing, staleness, coverage, health and page mutations.

Pages are (ord, id, title, page_type, content); their sources, links and failures are rows of their own.
"""

from __future__ import annotations

from corvane.functions import scalars as S
from pyspark.sql import Column, DataFrame, functions as F


def first_bytes(text: Column, most: int) -> Column:
    """As many whole characters as fit in `most` bytes; the last one is cut at up to three bytes."""
    held = F.left(text, F.lit(most)).cast("binary")
    return F.coalesce(*[F.try_validate_utf8(F.substring(held, 1, most - k).cast("string")) for k in range(4)])


def _hits(text: Column, words: list[str]) -> list[Column]:
    return [F.contains(text, F.lit(w)) for w in words]


def _any(found: list[Column]) -> Column:
    out = F.lit(False)
    for x in found:
        out = out | x
    return out


def search(pages: DataFrame, sources: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """(id, title, score) of the best pages, by title, id, content and sources; ties in store order."""
    q = query.lower()
    words = q.split()
    title, ident, body = F.lower("title"), F.lower("id"), F.lower("content")
    score = F.when(title == q, 100).when(F.contains(title, F.lit(q)), 50).when(_any(_hits(title, words)), 25).otherwise(0)
    score = score + F.when(F.contains(ident, F.lit(q)), 40).when(_any(_hits(ident, words)), 15).otherwise(0)
    count = F.lit(0)
    for x in _hits(body, words):
        count = count + F.when(x, 5).otherwise(0)
    score = score + F.when(F.contains(body, F.lit(q)), 20).otherwise(count)
    listed = sources.where(_any(_hits(F.lower("source"), words))).select("id").distinct().withColumn("listed", F.lit(10))
    out = pages.join(listed, "id", "left").withColumn("score", (score + F.coalesce("listed", F.lit(0))).cast("bigint")).where("score > 0")
    return out.orderBy(F.desc("score"), "ord").limit(limit).select("id", "title", "score")


def route(pages: DataFrame, synthesis: str, source_pages: tuple[str, ...] = (), headed: bool = True) -> DataFrame:
    """(id, score) of pages but indexes: 50 if listed, 10 a long word in the title, 2 a long word in the body's first 1000 bytes.

    A body begins after a first line that starts with #; where pages are not `headed`, such a line is of the body.
    """
    words = [w for w in synthesis.lower().split() if len(w.encode()) >= 4]
    body = F.col("content") if not headed else F.when(F.startswith("content", F.lit("#")) & F.contains("content", F.lit("\n")), F.expr("substring(content, instr(content, '\n') + 1)")).otherwise(F.col("content"))
    head = F.lower(first_bytes(body, 1000))
    score = F.when(F.col("id").isin(*source_pages), 50).otherwise(0) if source_pages else F.lit(0)
    for w in words:
        score = score + F.when(F.contains(F.lower("title"), F.lit(w)), 10).otherwise(0) + F.when(F.contains(head, F.lit(w)), 2).otherwise(0)
    return pages.where("page_type <> 'index'").select("ord", "id", score.cast("bigint").alias("score")).where("score > 0")


def affected(pages: DataFrame, sources: DataFrame, changed: DataFrame) -> DataFrame:
    """Ids of pages but indexes with a changed source."""
    stale = sources.join(changed, sources["source"] == changed["path"], "left_semi").select("id")
    return pages.where("page_type <> 'index'").join(stale, "id", "left_semi").select("id")


def uncovered(tracked: DataFrame, sources: DataFrame) -> DataFrame:
    return tracked.join(sources, tracked["path"] == sources["source"], "left_anti").select("path")


def all_deleted(sources: DataFrame, deleted: DataFrame) -> DataFrame:
    """Ids of pages with sources, all of which are deleted."""
    gone = deleted.select(F.col("path").alias("source"), F.lit(1).alias("gone")).distinct()
    return sources.join(gone, "source", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("gone").alias("g")).where("n = g").select("id")


def health(pages: DataFrame, sources: DataFrame, tracked: DataFrame) -> DataFrame:
    """Pages by type, tracked and covered files, and the coverage in whole percent, half to even."""
    types = pages.groupBy("page_type").count()
    cover = tracked.join(sources.select(F.col("source").alias("path")).distinct().withColumn("c", F.lit(1)), "path", "left").agg(F.count("*").alias("tracked"), F.count("c").alias("covered"))
    return types.join(cover, on=F.lit(True), how="inner").select("page_type", F.col("count").alias("pages"), "tracked", "covered", F.bround(F.col("covered") * 100.0 / F.greatest("tracked", F.lit(1)), 0).cast("bigint").alias("coverage_pct"))


def upsert(log: DataFrame) -> DataFrame:
    """The present pages of an append-only log (id, version, ...): the last version of each id."""
    rest = [c for c in log.columns if c != "id"]
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("id", "r.*")


def contribute(page: DataFrame, content: str, source_files: list[str], links_to: list[str], resolve: list[int], now: str) -> DataFrame:
    """A page (arrays as columns) with new content: sources united, links replaced, open contradictions at `resolve` closed."""
    done = F.transform(
        "contradictions",
        lambda x, i: F.struct(x["description"].alias("description"), F.when(i.isin(*resolve) & x["resolved_at"].isNull(), now).otherwise(x["resolved_at"]).alias("resolved_at")) if resolve else x,
    )
    return page.withColumns({"content": F.lit(content), "source_files": F.array_union("source_files", F.array(*map(F.lit, source_files)).cast("array<string>")), "links_to": F.array(*map(F.lit, links_to)).cast("array<string>"), "contradictions": done})


def record_failure(page: DataFrame, symptom: str, actual_fix: str | None, now: str) -> DataFrame:
    """A page with one more failure, which is closed if its fix is given."""
    new = F.struct(F.lit(symptom).alias("symptom"), F.lit(actual_fix).cast("string").alias("actual_fix"), F.lit(now).alias("recorded_at"), F.lit(now if actual_fix else None).cast("string").alias("resolved_at"))
    return page.withColumn("failures", F.concat("failures", F.array(new)))


def compound(pages: DataFrame, synthesis: str, title: str | None = None, source_pages: tuple[str, ...] = ()) -> tuple[str, str]:
    """(action, id): append to the best page from 20 points on, else create a page with a free id."""
    best = route(pages, synthesis, source_pages).orderBy(F.desc("score"), "ord").first()
    if best and best["score"] >= 20:
        return "append", best["id"]
    row = pages.sparkSession.range(1).select(S.derive_topic_id(F.lit(title or synthesis)).alias("i")).first()
    name = row["i"]
    number = F.when(F.col("id") == name, 1).otherwise(F.expr("try_cast(substring_index(id, '-', -1) AS bigint)"))
    taken = pages.select("id", number.alias("n")).where((F.col("id") == name) | (F.col("n") >= 2) & (F.col("id") == F.concat(F.lit(f"{name}-"), F.col("n").cast("string")))).select("n").distinct()
    if not taken.where("n = 1").isEmpty():
        free = taken.select((F.col("n") + 1).alias("n")).join(taken, "n", "left_anti").agg(F.min("n")).first()[0]
        name = f"{name}-{free}"
    return "create", name


def fan_in(links: DataFrame) -> DataFrame:
    """(id, n): pages that link to each id."""
    return links.select(F.explode("links_to").alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def open_items(pages: DataFrame) -> DataFrame:
    """One row: contradictions and failures in all, open ones, and pages with open ones; pages have arrays of items with resolved_at."""
    n = lambda c: F.size(c)
    unresolved = lambda c: F.size(F.filter(c, lambda x: x["resolved_at"].isNull()))
    made = []
    for c in ("contradictions", "failures"):
        made += [F.sum(n(c)).alias(c), F.sum(unresolved(c)).alias(f"open_{c}"), F.count_if(unresolved(c) > 0).alias(f"pages_with_{c}")]
    return pages.agg(*made)


def read(pages: DataFrame, name: str) -> DataFrame:
    """The page by its id, else by id or title in any case, else by a part of them; the first in store order."""
    low = name.lower()
    tier = F.when(F.col("id") == name, 0).when((F.lower("id") == low) | (F.lower("title") == low), 1).when(F.contains(F.lower("id"), F.lit(low)) | F.contains(F.lower("title"), F.lit(low)), 2)
    return pages.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", "ord").limit(1).drop("tier")


def covers(sources: DataFrame, decls: DataFrame) -> DataFrame:
    """(id, cover): kind:name of the public top-level declarations of a page's sources."""
    top = decls.where("depth = 0 AND visibility = 'Public'")
    return sources.join(top, sources["source"] == top["path"]).select("id", F.concat_ws(":", F.lower("kind"), "name").alias("cover")).distinct()


def load(spark, folder: str) -> DataFrame:
    """Pages of a folder of page files; malformed ones are left out."""
    from corvane.functions.text import parse_page

    kinds = "id string, title string, page_type string, source_files array<string>, links_to array<string>, covers array<string>, content string"

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(p["id"], p["title"], p.get("page_type", "topic"), p["source_files"], p["links_to"], p["covers"], p["content"]) for t in f["value"] if (p := parse_page(t))]
            yield pd.DataFrame(rows, columns=[k.split()[0] for k in kinds.split(", ")])

    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder).mapInPandas(run, kinds)
