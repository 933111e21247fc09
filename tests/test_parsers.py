"""Source snippets to declarations, and the table functions over files."""

import pytest
from corvane.functions import text as X
from corvane.parsers import ingest, lines
from corvane.parsers.scanner import parse


def names(language, text):
    return [(d.kind, d.name) for d in parse(language, text)[1]]


@pytest.mark.parametrize(
    ("language", "text", "found"),
    [
        ("Rust", "pub struct A {\n  x: u8,\n}\nimpl T for A {\n  fn m(&self) {}\n}\n", [("Struct", "A"), ("Field", "x"), ("Impl", "T for A"), ("Method", "m")]),
        ("Python", "X = 1\nclass C:\n  def m(self): pass\ndef f(): pass\n", [("Constant", "X"), ("Struct", "C"), ("Method", "m"), ("Function", "f")]),
        ("Go", "func (r *R) Do() {}\ntype S struct {\n  A int\n}\n", [("Method", "R.Do"), ("Struct", "S"), ("Field", "A")]),
        ("SQL", "CREATE TABLE t (\n  id INT,\n  PRIMARY KEY (id)\n);\n", [("TableDef", "t"), ("Field", "id")]),
        ("JSON", '{"a": {"b": 1}}', [("ConfigKey", "a"), ("ConfigKey", "b")]),
        ("YAML", "a: 1\nservices:\n  web:\n    x: 1\n", [("ConfigKey", "a"), ("ConfigKey", "services"), ("ConfigKey", "web"), ("ConfigKey", "x")]),
        ("XML", "<a><b/><b/></a>", [("ConfigKey", "a"), ("ConfigKey", "b")]),
        ("Python", "def f(:", []),
        ("Nothing", "x", []),
    ],
)
def test_declarations(language, text, found):
    assert names(language, text) == found


def test_complexity():
    d = parse("Rust", "fn f(a: u8, b: u8) {\n  if a > 0 && b > 0 {\n    for x in y {\n    }\n  } else if c {\n  }\n}\n")[1][0]
    assert (d.cyclomatic, d.max_nesting, d.param_count, d.body_lines) == (5, 2, 2, 6)
    d = parse("Python", "def f(self, a, *b):\n  while a and b:\n    if a: pass\n    elif b: pass\n")[1][0]
    assert (d.cyclomatic, d.max_nesting, d.param_count) == (5, 2, 2)


def test_ingest(spark):
    files = spark.createDataFrame([("m", "a.rs", "Rust", "use x::y;\nfn f() {}\n"), ("m", "b.py", "Python", None), ("m", "c.py", "Python", "def ("), ("m", "d.x", "None", "?")], "member string, path string, language string, content string")
    assert [(r.path, r.name, r.line) for r in ingest.declarations(files).collect()] == [("a.rs", "f", 2)]
    assert [(r.path, r.ord, r.text) for r in ingest.imports(files).collect()] == [("a.rs", 0, "x::y")]


def test_markdown_parents(spark):
    files = spark.createDataFrame([("p", "# a\n## b\ntext\n### c\n## d\n# e\n### f\n")], "path string, content string")
    assert [(r["name"], r.parent_line) for r in lines.markdown(files).orderBy("line").collect()] == [("a", None), ("b", 1), ("c", 2), ("d", 1), ("e", None), ("f", 6)]


def test_line_parsers(spark):
    f = lambda t: spark.createDataFrame([("p", t)], "path string, content string")
    assert [(r["name"], r.parent) for r in lines.properties(f("# c\na.b=1\na.c=2\nd: 3\n")).orderBy("line", "name").collect()] == [("a", None), ("a.b", "a"), ("a.c", "a"), ("d", None)]
    assert [(r.kind, r["name"]) for r in lines.cmake(f("project(x)\nset(FOO 1)\nset(foo 1)\nadd_executable(y a.c)\n")).orderBy("line").collect()] == [("Module", "x"), ("Constant", "FOO"), ("Function", "y")]
    assert [r.text for r in lines.shell_imports(f("source \"./a.sh\"\n. b\n")).orderBy("line").collect()] == ["./a.sh", "b"]
    assert [r.text for r in lines.html_imports(f('<link rel="stylesheet" href="a.css"><script src="b.js">')).collect()] == ["a.css", "b.js"]
    assert [r.depth for r in lines.brace_depth(f("{\n{}\n}\n")).orderBy("line").collect()] == [1, 1, 0]


def test_line_languages_reach_ingest(spark):
    text = {
        "run.sh": "#!/bin/sh\n\tsource \"./a.sh\"\nfunction f() {\n}\nfunction g {\ng2 () {\nif ()\nexport X=" + "v" * 70 + "\nalias ll='ls'\n",
        "Cargo.toml": "top = 1\n[package]\nname = \"x\"\n# c = 1\n[dependencies]\nserde = \"1\"\n[dev-dependencies.foo]\nv = 2\n[[bin]]\nname = \"b\"\n",
        "x.toml": "[dependencies]\na = 1\n",
        "README.md": "# a\r\n### b\n## c\n#no\n# d\n",
        "i.html": "<title>T</title>\n  <nav id='top'>\n<link rel='stylesheet' href='a.css'><script src='b.js'></script>\n",
        "CMakeLists.txt": "PROJECT(x)\nadd_subdirectory(lib)\nfind_package(Boost REQUIRED)\nset(foo 1)\nset(Foo 1)\noption(W \"wide\" ON)\nadd_library(y a.c)\n",
        "a.properties": "# c\na.b=1\nd: 3\na.c = x\n!z=1\n",
    }
    languages = {"run.sh": "Shell", "README.md": "Markdown", "i.html": "HTML", "CMakeLists.txt": "CMake", "a.properties": "Properties"}
    files = spark.createDataFrame([("m", p, languages.get(p, "TOML"), t) for p, t in text.items()], "member string, path string, language string, content string")
    got: dict = {p: [] for p in text}
    for r in ingest.declarations(files).orderBy("path", "seq").collect():
        got[r.path].append((r["name"], r.signature, r.line, r.parent_seq, r.visibility == "Public"))
    assert got["run.sh"] == [("f", "function f()", 3, None, True), ("g", "function g", 5, None, True), ("g2", "g2()", 6, None, True), ("X", "export X=" + "v" * 60 + "...", 8, None, True), ("ll", "alias ll", 9, None, True)]
    assert [x[0::3] for x in got["Cargo.toml"]] == [("top", None), ("package", None), ("name", 1), ("dependencies", None), ("serde", 3), ("dev-dependencies.foo", None), ("v", 5), ("bin", None), ("name", 7)]
    assert got["Cargo.toml"][7][1:3] == ("[[bin]]", 9) and got["Cargo.toml"][2][4] is False
    assert [(x[0], x[2], x[3]) for x in got["README.md"]] == [("a", 1, None), ("b", 2, 0), ("c", 3, 0), ("d", 5, None)]
    assert [x[:2] for x in got["i.html"]] == [("title", "title: T"), ("nav#top", "<nav#top>"), ("script", "<script>")]
    assert [x[1] for x in got["CMakeLists.txt"]] == ["project(x)", "set(Foo)", 'option(W "wide")', "add_library(y)"]
    assert got["a.properties"] == [("a", "a.*", 2, None, True), ("a.b", "a.b = 1", 2, 0, False), ("d", "d = 3", 3, None, True), ("a.c", "a.c = x", 4, 0, False)]
    imports = {(r.path, r.text) for r in ingest.imports(files).collect()}
    assert imports == {("run.sh", "./a.sh"), ("Cargo.toml", "serde"), ("Cargo.toml", "v"), ("i.html", "a.css"), ("i.html", "b.js"), ("CMakeLists.txt", "lib"), ("CMakeLists.txt", "Boost")}
    heads = lines.markdown(files.where("language = 'Markdown'")).orderBy("line").collect()
    assert [(r["name"], r.line) for r in heads] == [(x[0], x[2]) for x in got["README.md"]]


def test_types_and_texts():
    assert X.signature_types("fn f(a: &Foo, b: Vec<Bar>) -> Result<Baz, error>", "Rust") == (["Foo", "Vec", "Bar"], ["Result", "Baz"])
    assert X.signature_types("func (r *R) F(a Foo, b int) (Bar, error)", "Go") == (["Foo"], ["Bar"])
    assert X.signature_types("f(a: Foo): Bar", "TypeScript") == (["Foo"], ["Bar"])
    assert X.signature_types("public Bar get(Foo a, int b)", "Java") == (["Foo"], ["Bar"])
    assert X.split_nested("a, b<c, d>, (e, f)") == ["a", "b<c, d>", "(e, f)"]
    assert X.collapse('mod a {\n fn f() { "}" }\n}') == "mod a {\n fn f() { ... }\n}"
    page = {"id": "a", "title": "T", "source_files": ["x", "y"], "links_to": [], "covers": [], "content": "body\n"}
    assert X.parse_page(X.render_page(page)) == page
    assert X.parse_page("no front matter") is None
    assert X.excerpt_of("aaa\nthe Word here\nbbb", "word") == "the Word here..."


def test_match_arms_and_conditional_expressions_are_branches():
    from corvane.parsers import scanner

    rust = "fn classify(x: i32) -> &'static str {\n    match x {\n        0 => \"zero\",\n        1..=9 => \"single digit\",\n        _ => \"large\",\n    }\n}\n"
    ts = 'function choose(x: number, fallback?: string): string {\n    const a = x > 0 ? "pos" : "neg";\n    const b = fallback ?? o?.p;\n    if (x === 0) {\n        return b;\n    }\n    return a;\n}\n'
    js = 'function greet(name, loud) {\n    const greeting = loud ? "HELLO" : "hello";\n    return greeting + " " + (name || "world");\n}\n'
    java = "class A {\n    int f(List<? extends B> x) {\n        Map<?, ? super C> y = null;\n        return x == null ? 0 : 1;\n    }\n}\n"
    for language, text, name, want in (("Rust", rust, "classify", (4, 1)), ("TypeScript", ts, "choose", (4, 1)), ("JavaScript", js, "greet", (3, 0)), ("Java", java, "f", (2, 0))):
        found = [d for d in scanner.braces(language, text)[1] if d.name == name]
        assert [(d.cyclomatic, d.max_nesting) for d in found] == [want], language
