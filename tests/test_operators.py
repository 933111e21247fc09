"""Invariants of filters, graphs, diff, budget, sources and streams; the catalogue against its oracle."""

import duckdb
import pytest
from corvane.operators import filters, graph, knowledge, metrics, render
from corvane.plans import catalog
from corvane.sources import trees
from corvane.sources.fixtures import TABLES
from corvane.streaming import changes
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def code(spark):
    return catalog.Code(spark, SF)


def keys(df):
    return {(r.path, r.seq) for r in df.select("path", "seq").collect()}


def test_filters_are_idempotent(code):
    d = code.decls
    for f in (lambda x: filters.by_kind(x, "Function"), filters.public_only, lambda x: filters.by_symbol(x, "ring"), lambda x: filters.by_path(x, "src/m1")):
        once = f(d)
        assert keys(f(once)) == keys(once)


def test_diff_mirrors(code):
    a, b = code.decls.where("k % 11 <> 0"), code.decls.where("k % 13 <> 0")
    assert graph.structural_diff(a, a).isEmpty()
    there = {(r.path, r.kind, r.name): r.change for r in graph.structural_diff(a, b).collect()}
    back = {(r.path, r.kind, r.name): r.change for r in graph.structural_diff(b, a).collect()}
    assert there.keys() == back.keys()
    assert all({"added": "removed", "removed": "added", "modified": "modified"}[x] == back[k] for k, x in there.items())


def test_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "id string")
    got = lambda df: {tuple(r) for r in df.collect()}
    assert got(graph.reach(edges, seeds, 0)) == set()
    assert got(graph.reach(edges, seeds, 1)) == {("a", "b")}
    assert got(graph.reach_all(edges, seeds)) == {("a", "b"), ("b", "c"), ("c", "a")}


def test_resolve_imports(spark):
    files = spark.createDataFrame([("src/parser/mod.rs",), ("src/a/xparser.rs",), ("src/main.rs",)], "path string")
    imports = spark.createDataFrame([("src/main.rs", 0, "use crate::parser::parse_file;"), ("src/main.rs", 1, "std::io"), ("src/main.rs", 2, "")], "path string, ord int, text string")
    assert [(r.ord, r.target) for r in graph.resolve_imports(files, imports).collect()] == [(0, "src/a/xparser.rs")]


def test_relative_imports_start_at_their_own_folder(spark):
    files = spark.createDataFrame([(p,) for p in ("a/util.ts", "b/util.ts", "b/main.ts", "src/lib/core/utils.ts", "lib/core/utils.ts", "src/f/a/s/page.ts", "b/kit/index.ts", "src/config.json", "src/app.ts")], "path string")
    asked = [("b/main.ts", "{ x } from './util'", "b/util.ts"), ("src/f/a/s/page.ts", "{ u } from '../../../lib/core/utils'", "src/lib/core/utils.ts"), ("b/main.ts", "import k from \"./kit\"", "b/kit/index.ts"), ("src/app.ts", "{ c } from './config.json'", "src/config.json"), ("src/app.ts", "./main", "b/main.ts"), ("src/app.ts", "   ", None)]
    imports = spark.createDataFrame([(p, k, t) for k, (p, t, _) in enumerate(asked)], "path string, ord int, text string")
    got = {r.ord: r.target for r in graph.resolve_imports(files, imports).collect()}
    assert got == {k: target for k, (_, _, target) in enumerate(asked) if target}


def test_scores_against_a_loop(spark):
    import random
    import re

    from corvane.functions import scalars as S
    from pyspark.sql import functions as F

    def score(text: str, query: str) -> int:
        parts = [x for x in re.split(r"[_\-./]", text) if x]
        points = 10 * (query in text) + 20 * (query == text) + sum(5 * (t in text) + 3 * (t in parts) for t in query.split())
        if points or len(query) < 4 or len(text) < 2:
            return points
        x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (text, query))
        alike = 2 * len(x & y) / (len(x) + len(y))
        return int(alike * 8) if alike > 0.4 else 0

    rng = random.Random(5)
    texts = ["", "r", "red ring", "red_ring", "small-ring.red"] + ["".join(rng.choice("red ing_") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for query in ("red ring", "ring", "reding", "re"):
        got = rows.select("t", S.score_match(F.col("t"), query, query.split()).alias("s")).collect()
        assert [(r.t, r.s) for r in got] == [(t, score(t, query)) for t in texts], query


def test_budget_never_drops_the_last(spark):
    costs = spark.createDataFrame([("a", 1, 100), ("b", 2, 100), ("c", 3, 100)], "path string, importance int, tokens int")
    kept = lambda n: {r.path for r in metrics.drop_files(costs, n).where("kept").collect()}
    assert kept(300) == {"a", "b", "c"} and kept(200) == {"b", "c"} and kept(0) == {"c"}


def test_knowledge(spark):
    page = spark.createDataFrame([("p", "old", ["a"], [], [("x", None)], [])], "id string, content string, source_files array<string>, links_to array<string>, contradictions array<struct<description:string,resolved_at:string>>, failures array<struct<symptom:string,actual_fix:string,recorded_at:string,resolved_at:string>>")
    r = knowledge.contribute(page, "new", ["b", "a"], ["l"], [0], "now").first()
    assert (r.content, r.source_files, r.links_to, r.contradictions[0].resolved_at) == ("new", ["a", "b"], ["l"], "now")
    r = knowledge.record_failure(page, "s", None, "now").first()
    assert r.failures[0].symptom == "s" and r.failures[0].resolved_at is None
    pages = spark.createDataFrame([(0, "topic-some-words", "Some words", "topic", "text")], "ord int, id string, title string, page_type string, content string")
    assert knowledge.compound(pages, "some words") == ("append", "topic-some-words")
    assert knowledge.compound(pages, "other", title="some words") == ("create", "topic-some-words-2")


def test_trees(spark, tmp_path):
    for name, text in {"a.rs": "fn a() {}", "b/c.py": "x = 1", "b/skip.py": "y", ".h/z.rs": "", "d.bin": "", "e/big.rs": "x" * 2000}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = trees.scan_tree(spark, f"file:{tmp_path}", max_kb=1, gitignore="skip.py\n")
    assert {(r.path, r.language) for r in files.collect()} == {("a.rs", "Rust"), ("b/c.py", "Python")}
    snap = files.where("path = 'a.rs'").withColumn("version", F.lit(trees.VERSION))
    hits, misses = trees.cache_split(files, snap)
    assert [r.path for r in hits.collect()] == ["a.rs"] and [r.path for r in misses.collect()] == ["b/c.py"]


def test_workspace():
    kind, members = trees.workspace({"Cargo.toml": '[workspace]\nmembers = ["crates/*"]', "crates/a/Cargo.toml": '[package]\nname = "x"'}, ["crates", "crates/a", "crates/b"])
    assert (kind, members) == ("cargo", [("x", "crates/a"), ("b", "crates/b")])
    assert trees.workspace({"package.json": '{"name": "r", "workspaces": {"packages": ["p/*"]}}'}, ["p/q"]) == ("npm", [("q", "p/q")])
    assert trees.workspace({"go.work": "go 1.2\nuse (\n  ./m\n)\n", "m/go.mod": "module a.b/c\n"}, ["m"]) == ("go", [("c", "m")])
    assert trees.workspace({}, []) == ("none", [(".", ".")])


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a.rs",), ("a.rs",), ("x.tmp",), (".git/y.rs",)], "path string").write.parquet(src)
    seen = []
    q = changes.coalesce(changes.relevant(spark.readStream.schema("path string").parquet(src)), lambda df, n: seen.append(sorted(r.path for r in df.collect())), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == [["a.rs"]]


def test_render(spark):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    lines = render.mermaid_lines(edges, graph.mermaid_nodes(edges))
    assert [r.text for r in lines.orderBy("k", "s").collect()] == ["graph LR", '  n0["a"]', '  n1["b"]', "  n0 --> n1"]
    c = render.compact_rows(spark.createDataFrame([(2, None), (1, "x")], "a int, b string"), "a").first()
    assert (c.columns, c.rows) == (["a", "b"], [["1", "x"], ["2", None]])


def test_catalogue_has_oracles(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in catalog.ORACLES.items():
        spark_rows = catalog.QUERIES[name](spark, SF)
        oracle = con.sql(sql)
        assert sorted(spark_rows.columns) == sorted(oracle.columns), name
        if name in ("token_scope", "lang_stats", "filter_symbol", "structural_diff", "health", "import_resolve"):
            cols = sorted(oracle.columns)
            show = lambda rows: sorted(repr([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in rows)
            assert show(map(tuple, spark_rows.select(*cols).collect())) == show(oracle.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()), name


def test_session_ttl_stream(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, at(0)), (1, at(30)), (1, at(80)), (1, at(200)), (2, at(5))], "key bigint, ts timestamp").coalesce(1).write.parquet(src)
    stream = changes.session_ttl(spark.readStream.schema("key bigint, ts timestamp").parquet(src))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.key, r.ts, r.valid) for r in spark.read.parquet(out).collect())
    assert got == [(1, at(0), False), (1, at(30), True), (1, at(80), True), (1, at(200), False), (2, at(5), False)]


def test_debounce_stream(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", at(0)), ("a", at(1)), ("a", at(10)), ("b", at(1000))]
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(src)
    stream = changes.debounce(spark.readStream.schema("key string, ts timestamp").parquet(src), "5 seconds", late="1 second")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.key, r.start, r.events) for r in spark.read.parquet(out).collect())
    assert got == [("a", at(0), 2), ("a", at(10), 1)]
    batch = sorted((r.key, r.start, r.events) for r in changes.sessions_batch(spark.createDataFrame(rows, "key string, ts timestamp"), 5).collect())
    assert batch == [("a", at(0), 2), ("a", at(10), 1), ("b", at(1000), 1)]


def test_compound_takes_a_free_id(spark):
    columns = "ord long, id string, title string, content string, page_type string"
    ids = [f"topic-some-words-x{k}" for k in range(1500)] + ["topic-some-words"] + [f"topic-some-words-{k}" for k in range(2, 1300)] + ["topic-some-words-1301", "topic-some-words-01300"]
    pages = spark.createDataFrame([(k, i, "", "", "index") for k, i in enumerate(ids)], columns)
    assert knowledge.compound(pages, "zzz", title="some words") == ("create", "topic-some-words-1300")
    assert knowledge.compound(pages.where("id <> 'topic-some-words'"), "zzz", title="some words") == ("create", "topic-some-words")


def test_languages_and_mermaid_labels(spark):
    from pyspark.sql import functions as F

    from corvane.operators import render
    from corvane.sources.languages import detect

    want = {"a/x.pyi": "Python", "m.cjs": "JavaScript", "k.hxx": "C++", "s.podspec": "Ruby", "i.svg": "XML", "build.gradle.kts": "Gradle", "b.kts": "Kotlin", "Pipfile": "TOML", "d/Makefile": None, ".rs": None, "x.scss": None, "t.jsonc": "JSON", ".profile": "Shell"}
    got = spark.createDataFrame([(k,) for k in want], "path string").select("path", detect(F.col("path")).alias("language")).collect()
    assert {r.path: r.language for r in got} == want
    nodes = spark.createDataFrame([('a\\b("x")', "n0"), ("c[1]{2}|&", "n1")], "id string, node string")
    edges = spark.createDataFrame([('a\\b("x")', "c[1]{2}|&")], "src string, dst string")
    lines = {r.text for r in render.mermaid_lines(edges, nodes).collect()}
    assert lines == {"graph LR", '  n0["a\\\\b#40;#quot;x#quot;#41;"]', '  n1["c#91;1#93;#123;2#125;#124;&"]', "  n0 --> n1"}
