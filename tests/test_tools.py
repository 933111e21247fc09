"""Every tool by its name, over a small parsed tree."""

import pytest
from corvane.plans.tools import ToolError, Tools
from pyspark.sql import functions as F

SOURCES = {
    "src/parser.rs": ("Rust", "use crate::model::Node;\n/// Parses text\npub fn parse_file(path: &Path) -> Node {\n    if path.ok() && true {\n        return a;\n    }\n}\n#[test]\nfn parse_file_works() {}\n"),
    "src/model.rs": ("Rust", "pub struct Node {\n    pub name: String,\n}\npub trait Shape {\n}\nimpl Shape for Node {\n}\n"),
    "web/app.ts": ("TypeScript", "import { x } from './util';\nexport class App {\n  run(n: Node): void {\n  }\n}\n"),
}


@pytest.fixture(scope="module")
def tools(spark):
    rows = [("root" if p.startswith("src") else "web", p, lang, len(t), t.count("\n"), t) for p, (lang, t) in SOURCES.items()]
    files = spark.createDataFrame(rows, "member string, path string, language string, size bigint, lines bigint, content string")
    pages = spark.createDataFrame([(0, "parser", "The parser", "module", "How parsing works"), (1, "model", "Model", "entity", "Nodes")], "ord bigint, id string, title string, page_type string, content string")
    sources = spark.createDataFrame([("parser", "src/parser.rs")], "id string, source string")
    t = Tools.of(files, pages=pages, sources=sources)
    t.decls = t.decls.cache()
    return t


def test_find(tools):
    assert [r["name"] for r in tools.call("find", query="parse_file", mode="symbol").collect()] == ["parse_file", "parse_file_works"]
    best = tools.call("find", query="parse file").first()
    assert best["name"] == "parse_file" and best["kind"] == "fn"
    assert {r.match_type for r in tools.call("find", query="Node", mode="callers").collect()} == {"import", "signature"}
    assert tools.call("find", query="shape for", mode="signature").count() == 1


def test_reading(tools):
    r = tools.call("read", path="parser.rs", symbol="parse_file").first()
    assert (r.start, r.stop) == (3, 7) and r.source.startswith("pub fn parse_file")
    assert tools.call("read_source", path="src/model.rs", start_line=1, end_line=2).first().source == "pub struct Node {\n    pub name: String,"
    assert tools.call("get_token_estimate", path="src/parser.rs", symbol="parse_file").first().savings_percent > 0


def test_every_other_tool(tools, spark):
    n = lambda name, **a: tools.call(name, **a).count()
    assert n("list_workspace_members") == 2 and n("get_stats") == 2 and n("get_health") == 1
    assert n("list_declarations", path="model.rs", shallow=True) == 3 and n("get_file_summary", path="model.rs") == 4
    assert n("batch_file_summaries", glob="*.ts") == 2 and n("summarize", path="*.ts") == 2 and n("summarize", path="Node") == 1 and n("summarize", path="src/model.rs") == 4
    assert n("get_public_api", path="src/model.rs") == 3 and n("get_related_tests", symbol="parse_file") == 1
    assert {(r.path, r.relation) for r in tools.call("get_file_context", path="src/model.rs").collect()} == {("src/parser.rs", "imported_by"), ("src/parser.rs", "sibling")}
    assert n("get_tree", path="s") == 1 and n("get_imports", path="parser.rs") == 1 and n("get_hotspots") == 3
    assert {(r["name"], r.role) for r in tools.call("get_type_flow", type_name="Node").collect()} == {("parse_file", "producer"), ("run", "consumer")}
    assert [r.text for r in tools.call("get_dependency_graph").collect()] == ["graph LR", '  n0["src/model.rs"]', '  n1["src/parser.rs"]', "  n1 --> n0"]
    assert n("get_dependency_graph", path="parser", depth=1, format="json") == 1
    assert n("get_diff_summary", old=tools.decls.where("path <> 'web/app.ts'")) == 2
    assert "## src/model.rs" in tools.call("wiki_generate").first().text
    assert tools.call("wiki_search", query="parser").first().id == "parser" and tools.call("wiki_read", page="MODEL").first().id == "model"
    assert n("wiki_status") == 2 and tools.call("wiki_suggest_contribution", synthesis="parser parser things").first().action == "update"
    assert {(r.what, r.id) for r in tools.call("wiki_update", changed=spark.createDataFrame([("src/parser.rs",)], "path string")).collect()} == {("affected", "parser"), ("uncovered", "src/model.rs"), ("uncovered", "web/app.ts")}
    assert tools.call("wiki_compound", synthesis="entirely different matters").first().action == "create"
    assert n("regenerate_index", files=tools.files) == 0
    assert len(tools.names()) == 35


def test_errors_and_members(tools):
    assert tools.call("lookup_symbol", member="WEB", name="").where(F.col("member") != "web").isEmpty()
    for name, args in (("nothing", {}), ("find", {}), ("read", {"path": "none.rs"}), ("get_stats", {"member": "x"}), ("find", {"query": "a", "mode": "b"})):
        with pytest.raises(ToolError):
            tools.call(name, **args)


def test_rpc(tools):
    import json

    from corvane.plans.serve import reply

    ask = lambda **m: reply(tools, json.dumps({"jsonrpc": "2.0", "id": 1} | m))
    assert ask(method="initialize")["result"]["serverInfo"]["name"] == "corvane"
    assert len(ask(method="tools/list")["result"]["tools"]) == 35
    got = ask(method="tools/call", params={"name": "get_imports", "arguments": {"path": "parser.rs"}})["result"]
    assert json.loads(got["content"][0]["text"])["rows"][0][-1] == "crate::model::Node"
    assert ask(method="tools/call", params={"name": "nope"})["result"]["isError"]
    assert ask(method="x")["error"]["code"] == -32601 and ask(method="tools/call", params={})["error"]["code"] == -32602
    assert reply(tools, "{")["error"]["code"] == -32700 and reply(tools, '{"method": "initialized"}') is None


def test_replies_tell_how_many_rows_there_are(spark):
    from corvane.plans.serve import compact

    got = compact(spark.range(20), most=5)
    assert len(got["rows"]) == 5 and got["total"] == 20 and compact(spark.range(5), most=5)["total"] == 5
