"""Scalar goldens: scores, identifiers, globs, bigrams, boundaries, imports."""

import pytest
from corvane.functions import scalars as S
from corvane.plans import catalog
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "query", "terms", "score"),
    [
        ("parse", "parse", ["parse"], 38),
        ("tree_sitter_parser", "parser", ["parser"], 18),
        ("indexer", "parser", ["parser"], 0),
        ("token_budget_manager", "token budget", ["token", "budget"], 16),
        ("apply token budget here", "token budget", ["token", "budget"], 20),
        ("token_counter", "token budget", ["token", "budget"], 8),
        ("parsedeclaration", "parse decl", ["parse", "decl"], 10),
        ("parse_declaration", "parse decl", ["parse", "decl"], 13),
    ],
)
def test_score(spark, text, query, terms, score):
    assert value(spark, S.score_match(F.lit(text), query, terms)) == score


@pytest.mark.parametrize(("name", "parts"), [("parseFile", ["parse", "file"]), ("XMLParser", ["xmlparser"]), ("v2Parser", ["v2", "parser"]), ("a_b-c.d/e", ["a", "b", "c", "d", "e"]), ("__x__", ["x"]), ("", [])])
def test_identifier(spark, name, parts):
    assert value(spark, S.split_identifier(F.lit(name))) == parts


@pytest.mark.parametrize(
    ("pattern", "path", "fits"),
    [
        ("*.rs", "src/a/b.rs", True), ("*.rs", "b.rs", True), ("src/*.rs", "src/a/b.rs", False), ("src/**/*.rs", "src/a/b.rs", True), ("src/**/*.rs", "src/b.rs", True), ("src", "src/b.rs", True), ("src", "srcx/b.rs", False),
        ("src/?.rs", "src/b.rs", True), ("src/?.rs", "src/bb.rs", False), ("src/[ab].rs", "src/b.rs", True), ("src/[!ab].rs", "src/b.rs", False), ("a+b.*", "x/a+b.c", True),
    ],
)
def test_glob(spark, pattern, path, fits):
    assert value(spark, S.glob_match(F.lit(path), pattern)) is fits


def test_bigrams(spark):
    assert value(spark, S.bigram_similarity(F.lit("abc"), F.lit("abc"))) == 1.0
    assert value(spark, S.bigram_similarity(F.lit("ab"), F.lit("cd"))) == 0.0
    assert value(spark, S.bigram_similarity(F.lit("a"), F.lit("ab"))) == 0.0


@pytest.mark.parametrize(("text", "word", "there"), [("a foo b", "foo", True), ("foobar", "foo", False), ("foo_bar", "foo", False), ("(foo)", "foo", True), ("éfoo", "foo", True), ("x", "", False), ("a.b", "a.b", True)])
def test_boundary(spark, text, word, there):
    assert value(spark, S.word_boundary(F.lit(text), word)) is there


@pytest.mark.parametrize(
    ("text", "path"),
    [("crate::parser::queries", "crate/parser/queries"), ("a.b.user", "a/b/user"), ("utils.h", "utils.h"), ("conf.json", "conf.json"), ("'x.html'", "'x.html'"), ("app.views", "app/views")],
)
def test_normalize_import(spark, text, path):
    assert value(spark, S.normalize_import(F.lit(text))) == path


def test_small_ones(spark):
    assert value(spark, S.estimate_tokens(F.lit("é"))) == 1
    assert value(spark, S.truncate(F.lit("abcdef"), 3)) == "abc..."
    assert value(spark, S.sanitize_id(F.lit("A b-C_é"))) == "ab-c_"
    assert value(spark, S.derive_topic_id(F.lit("to The quick Brown foxes jump"))) == "topic-quick-brown-foxes"
    assert value(spark, S.derive_topic_id(F.lit("a b"))) == "topic-new"
    assert value(spark, S.format_size(F.lit(1280))) == "1.2 KB"
    assert tuple(value(spark, S.github_repo(F.lit("git@github.com:a/b.git")))) == ("a", "b")
    assert value(spark, S.line_count(F.lit("a\nb\n"))) == 2
    assert value(spark, S.import_path(F.lit("{ a } from './x/y'"))) == "./x/y"
    assert value(spark, S.import_path(F.lit("platform ./z;"))) is None
    assert value(spark, S.wiki_links(F.lit("[[A b]] [[c]]\n```\n[[d]]\n```\n[[c]]"))) == ["ab", "c"]


def test_format_size_of_a_table(spark, tmp_path):
    rows = [(1, "x" * 1023), (2, "x" * 1280), (3, "x" * (1 << 20)), (4, "é" * (5 << 18)), (5, None), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r.shown for r in catalog.format_size(spark, f"file://{tmp_path}").collect()}
    assert got == {1: "1023 B", 2: "1.2 KB", 3: "1.0 MB", 4: "2.5 MB", 5: None, 6: "0 B"}
