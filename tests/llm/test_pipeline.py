"""The pipeline against brute force, stage by stage."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from corvane.llm import decontaminate, queries, secret_scan  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from test_operators_llm import slow_spans, whole, wide_roots

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    step = dict(corpus_pipeline.STAGES)
    docs = step["language identification"](spark, docs, SF).cache()
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()}.items() <= before.items()
    assert docs.count() >= 0.99 * len(before)
    rows = docs.orderBy("doc_id").collect()
    roots = wide_roots([r.text for r in rows])
    docs = step["near-duplicates"](spark, docs, SF).cache()
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == {r.doc_id for k, r in enumerate(rows) if roots[k] == k}
    rows, items = docs.collect(), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    norm = lambda t: b" " + b" ".join(decontaminate.words(t)) + b" "
    clean = {r.doc_id for r in rows if not any(norm(i.text) in norm(r.text) for i in items)}
    docs = step["decontamination"](spark, docs, SF).cache()
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == clean
    rows = {r.doc_id: r.text for r in docs.collect()}
    docs = step["secrets"](spark, docs, SF).cache()
    assert docs.columns == columns and docs.count() == len(rows)
    for r in docs.collect():
        assert (r.text == rows[r.doc_id]) == (slow_spans(rows[r.doc_id]) == "") and r.n_chars == len(r.text)
    assert secret_scan.scan_versions(docs).where("findings IS NOT NULL").isEmpty()
    rows = docs.collect()
    out = step["packing"](spark, docs, SF).collect()
    assert sum(r.length for r in out) == sum(len(x) for x in whole([r.text for r in rows], 0)) and {r.doc_id for r in out} == {r.doc_id for r in rows}
    assert max(r.offset + r.length for r in out) <= 2048
    assert queries.QUERIES and corpus_pipeline.run(spark, SF).count() == len(out)


CLASH = ["_told", "_sure", "_key", "_at", "_blob", "_findings", "_text", "key", "node", "root", "id", "seg", "w0"]


def test_stages_on_odd_rows(spark):
    """Null and repeated ids, long and equal texts, ties, and columns that the operators name so themselves: each stage but the last carries them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    long = " ".join(r.text for r in docs) * 4
    rows = [(r.doc_id, r.text) for r in docs] + [(7, item + " and more of that"), (None, "x y z " + item), (None, docs[3].text), (5, docs[5].text), (5, docs[9].text), (901, long), (902, "token=abcdef12 " + long), (None, None), (903, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    now = spark.createDataFrame([(i, t, "en" if t and "the" in t else "fr", "s", len(t or ""), *CLASH) for i, t in rows], schema)
    step = dict(corpus_pipeline.STAGES)
    for name in ("language identification", "near-duplicates", "decontamination", "secrets"):
        before, after = now.collect(), step[name](spark, now, SF)
        assert after.columns == now.columns
        now = spark.createDataFrame(after.collect(), schema)
        kept = now.collect()
        assert all(tuple(r)[5:] == tuple(CLASH) for r in kept)
        if name == "near-duplicates":
            assert len([r for r in kept if r.text == docs[5].text]) == 1 and not [r for r in kept if r.doc_id is None and r.text == docs[3].text]
        if name == "decontamination":
            assert not [r for r in kept if item in r.text] and [r for r in kept if r.doc_id == 7] == [r for r in before if r.doc_id == 7 and item not in r.text]
        if name == "secrets":
            assert not [r for r in kept if "abcdef12" in r.text] and len(kept) == len(before)
    assert step["packing"](spark, now, SF).select("length").groupBy().sum().first()[0] > 0


def test_empty_and_odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in (docs.limit(0), spark.createDataFrame([(None, None, None, None, None), (1, "password=hunter22 is what they said", "en", "s", 3), (1, "password=hunter22 is what they said", "en", "s", 3)], docs.schema)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = stage(spark, rows, SF)
            assert k == 4 or rows.columns == docs.columns
            if k < 4:
                rows = spark.createDataFrame(rows.collect(), docs.schema)
