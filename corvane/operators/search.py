"""Symbol, signature, caller and relevance search over declarations and imports."""

from __future__ import annotations

from corvane.functions import scalars as S
from corvane.operators.filters import is_test_file
from pyspark.sql import Column, DataFrame, functions as F

#: Kinds whose display form is not their lower-cased name.
DISPLAY = {"Function": "fn", "Method": "fn", "TypeAlias": "type", "SchemaType": "type", "Constant": "const"}


def display_kind(kind: Column) -> Column:
    out = F.lower(kind)
    for name, shown in DISPLAY.items():
        out = F.when(kind == name, shown).otherwise(out)
    return out


def in_order(df: DataFrame, limit: int | None = None) -> DataFrame:
    """By member, path components and position; `limit` takes the first rows."""
    df = df.orderBy("member", S.path_parts(F.col("path")), "seq")
    return df if limit is None else df.limit(limit)


def lookup_symbol(decls: DataFrame, name: str, limit: int = 50) -> DataFrame:
    return in_order(decls.where(F.contains(F.lower("name"), F.lit(name.lower()))), min(limit, 200))


def search_signatures(decls: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return in_order(decls.where(F.contains(F.lower("signature"), F.lit(query.lower()))), min(limit, 100))


def relevance(decls: DataFrame, query: str) -> DataFrame:
    """Adds score and match_on: name 3-fold, signature 2-fold, doc once, 5 more for public rows with any."""
    query = query.lower()
    terms = query.split()
    name, sig = S.score_match(F.lower("name"), query, terms), S.score_match(F.lower("signature"), query, terms)
    doc = F.when(F.coalesce("doc_comment", F.lit("")) != "", S.score_match(F.lower("doc_comment"), query, terms)).otherwise(0)
    # A generator of one row: the points are computed once, not again in every filter, key and output that reads them.
    out = decls.select("*", F.inline(F.array(F.struct(name.alias("s_name"), sig.alias("s_sig"), doc.alias("s_doc")))))
    total = 3 * F.col("s_name") + 2 * F.col("s_sig") + F.col("s_doc")
    on = F.concat_ws("+", F.when(F.col("s_name") > 0, "name"), F.when(F.col("s_sig") > 0, "signature"), F.when(F.col("s_doc") > 0, "doc"))
    out = out.withColumn("score", (total + F.when((F.col("visibility") == "Public") & (total > 0), 5).otherwise(0)).cast("bigint")).withColumn("match_on", on)
    return out.drop("s_name", "s_sig", "s_doc")


def search_relevant(decls: DataFrame, files: DataFrame, query: str, limit: int = 20, kind: str | None = None) -> DataFrame:
    """The best (path, name, kind, line, match_on, score) of declarations and, without a kind, of paths; ties in file order."""
    query_l = query.lower()
    rows = relevance(decls if kind is None else decls.where(F.col("kind") == kind), query).where("score > 0")
    rows = rows.select("member", "path", F.lit(1).alias("after"), "seq", "name", display_kind(F.col("kind")).alias("kind"), "line", "match_on", "score")
    if kind is None:
        paths = files.withColumn("score", S.score_match(F.lower("path"), query_l, query_l.split()).cast("bigint")).where("score > 0")
        none = lambda t: F.lit(None).cast(t)
        rows = rows.union(paths.select("member", "path", F.lit(0), none("bigint"), none("string"), none("string"), none("bigint"), F.lit("path"), "score"))
    best = rows.orderBy(F.desc("score"), "member", S.path_parts(F.col("path")), "after", "seq").limit(min(limit, 50))
    return best.select("path", "name", "kind", "line", "match_on", "score")


def callers(decls: DataFrame, imports: DataFrame, symbol: str, limit: int = 20) -> DataFrame:
    """Imports and signatures that hold the symbol as a word, other than declarations of that name."""
    a = imports.where(S.word_boundary(F.col("text"), symbol)).select("member", "path", F.lit(0).alias("after"), F.col("ord").cast("bigint").alias("seq"), F.lit("import").alias("match_type"), F.col("text").alias("context"))
    b = decls.where((F.col("name") != symbol) & S.word_boundary(F.col("signature"), symbol)).select("member", "path", F.lit(1), F.col("seq"), F.lit("signature"), "signature")
    return a.union(b).orderBy("member", S.path_parts(F.col("path")), "after", "seq").limit(min(limit, 50)).select("path", "match_type", "context")


def public_api(decls: DataFrame, prefix: str = "", limit: int = 100) -> DataFrame:
    return in_order(decls.where((F.col("visibility") == "Public") & F.startswith("path", F.lit(prefix))), min(limit, 500))


def explain_symbol(decls: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """All facts but the body of declarations of that name in any case, with a summary of their children by kind."""
    hits = in_order(decls.where(F.lower("name") == name.lower()), limit)
    kids = decls.where("parent_seq IS NOT NULL").groupBy("path", F.col("parent_seq").alias("seq"), display_kind(F.col("kind")).alias("k")).count()
    kids = kids.groupBy("path", "seq").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%d %s", "count", "k"))), ", ").alias("children_summary"))
    return hits.join(kids, ["path", "seq"], "left")


def related_tests(decls: DataFrame, symbol: str, scope: str | None = None, limit: int = 20) -> DataFrame:
    """Tests whose name holds the symbol: those of the scope's file first, then by file order, with the reason."""
    found = decls.where(F.col("is_test") & F.contains(F.lower("name"), F.lit(symbol.lower())))
    own = F.lit(False) if scope is None else (F.col("path") == scope) | F.endswith("path", F.lit(f"/{scope}"))
    reason = F.when(own, "same_file").when(is_test_file(F.col("path")), "test_file").otherwise("name_convention")
    return found.withColumn("reason", reason).orderBy(~own, "member", S.path_parts(F.col("path")), "seq").limit(limit)


def file_summary(decls: DataFrame) -> DataFrame:
    """(path, kind, n, n_public, has_tests) of every file and displayed kind."""
    return decls.groupBy("path", display_kind(F.col("kind")).alias("kind")).agg(
        F.count("*").alias("n"), F.count_if(F.col("visibility") == "Public").alias("n_public"), F.bool_or("is_test").alias("has_tests")
    )


def imported_by(files: DataFrame, imports: DataFrame, path: str) -> DataFrame:
    """Other files with their first import that names the file's stem (of three bytes or more), its path or, for mod and index, its folder."""
    bare = path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path
    folder, _, stem = bare.rpartition("/")
    names = [bare] + [stem] * (len(stem.encode()) >= 3)
    if stem in ("mod", "index") and len(parent := folder.rpartition("/")[2]) >= 3:
        names.append(parent)
    hit = F.lit(False)
    for name in names:
        hit = hit | F.contains("text", F.lit(name))
    return imports.where((F.col("path") != path) & hit).groupBy("path").agg(F.min_by("text", "ord").alias("import"))


def related_files(files: DataFrame, path: str, cap: int = 10) -> DataFrame:
    """Tests of the file by name, anywhere, and the first `cap` others of its folder in path order."""
    folder, _, name = path.rpartition("/")
    stem = name.rsplit(".", 1)[0]
    leaf, where = F.element_at(S.path_parts(F.col("path")), -1), F.regexp_replace("path", "/?[^/]*\\z", "")
    test = F.lit(False)
    for p in (f"{stem}_test.", f"{stem}_spec.", f"test_{stem}.", f"{stem}.test.", f"{stem}.spec."):
        test = test | F.startswith(leaf, F.lit(p))
    others = files.where(F.col("path") != path)
    near = others.where(~test & (where == folder)).orderBy(S.path_parts(F.col("path"))).limit(cap)
    return others.where(test).select("path", F.lit("test").alias("relation")).union(near.select("path", F.lit("sibling")))
