"""Registered queries and their operators on odd tables, against their oracle statements."""

import os
import re

from corvane.operators import graph, knowledge
from corvane.plans import catalog


def oracle(name, **tables):
    """The rows of a query's statement over the given Arrow tables."""
    import duckdb

    con = duckdb.connect()
    for table, rows in tables.items():
        con.register(table, rows)
    return sorted(map(tuple, con.sql(catalog.ORACLES[name]).fetchall()))


def written(folder, **tables):
    """The folder with the given Arrow tables as Parquet files."""
    import pyarrow.parquet as pq

    for table, rows in tables.items():
        pq.write_table(rows, os.path.join(folder, f"{table}.parquet"))
    return str(folder)


def test_route_synthesis_reads_a_body_up_to_a_thousand_bytes(spark, tmp_path):
    import pyarrow as pa

    texts = ["ä" * 400 + " station", "ä" * 500 + " station", "ä" * 498 + "tion", "x" + "ä" * 498 + "tion", "x" * 996 + "TION", "x" * 997 + "tion", "€" * 332 + "tion", "€" * 333 + "tion", "# station\nx", "# thea", None, "", "𝄞" * 249 + "thea", "y" + "𝄞" * 249 + "thea"]
    docs = pa.table({"doc_id": pa.array([5 * k for k in range(len(texts))]), "text": pa.array(texts, pa.string())})
    labels = pa.table({"doc_id": pa.array([0, 0, 5]), "toxic": pa.array([1, 0, 0], pa.int32()), "quality": pa.array([1, 1, 0], pa.int32())})
    found = catalog.route_synthesis(spark, written(tmp_path, documents=docs, labels=labels, pages=pa.table({"page_id": pa.array([0])}))).collect()
    assert sorted(map(tuple, found)) == oracle("route_synthesis", documents=docs, labels=labels)
    assert {r["ord"] // 5 for r in found} == {0, 2, 4, 6, 8, 9, 12}


def test_first_bytes_keeps_whole_characters(spark):
    texts = ["", "a", "abcdefgh", "ääääää", "aäääää", "€€€€", "a€€€", "𝄞𝄞𝄞", "a𝄞𝄞", "ab\ufffd\ufffdx", None]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").withColumn("head", knowledge.first_bytes(knowledge.F.col("text"), 7)).collect()
    assert {r["k"]: r["head"] for r in found} == {k: t and t.encode()[:7].decode(errors="ignore") for k, t in enumerate(texts)}


def test_symbol_graph_gives_each_edge_once_and_moves_no_edges(spark, monkeypatch):
    """Against all pairs: common names in pieces, ids of two names, repeated rows, relationships called as references; the joined rows need no exchange."""
    monkeypatch.setattr(graph, "PIECE", 7, raising=False)
    decls = [(f"f{k % 20}", k, ("Node", "Leaf", "x#2", "x", "ab", "")[k % 6], ("Struct", "Function", "Enum", "Trait", "Class", None)[k // 6 % 6], ("fn a(Node, x) -> Leaf", "Leaf<ab>", "x#2 Node Node", None)[k % 4]) for k in range(300)]
    decls += [("g::x", 0, "y", "Struct", "x"), ("g", 0, "x::y", "Struct", "y"), ("g", 1, "Abcd", "Enum", "y"), ("h", 0, "x", "Enum", "Abcd"), ("h", 1, "x", "Enum", "Abcd"), ("h", 2, "x#2", "Struct", "x"), ("h", 3, "Wide", "Class", "x")]
    rels = [("f1", 1, "Implements", "Node"), ("f1", 1, "Implements", "Node"), ("f1", 1, "References", "Leaf"), ("f2", 2, "Extends", "y"), ("f2", 2, "Extends", "x::y"), ("h", 3, "References", "x#2"), ("h", 3, "Extends", "x"), ("h", 3, "Extends", "x#2"), ("f3", 3, "Extends", None)]
    made = spark.createDataFrame(decls, "path string, seq int, name string, kind string, signature string")
    found = graph.symbol_graph(made, spark.createDataFrame(rels, "path string, seq int, kind string, target string"))
    ids, seen = [], {}
    for path, seq, name, kind, text in decls:
        n = seen[path, name] = seen.get((path, name), 0) + 1
        ids += [(f"{path}::{name}" + (f"#{n}" if n > 1 else ""), path, seq, name, kind, text)] if name else []
    assert len({i[0] for i in ids}) < len({(i[0], i[3]) for i in ids})
    types = ("Struct", "Enum", "Trait", "Class")
    want = {(a[0], b[0], "References") for a in ids for b in ids if b[4] in types and len(b[3]) >= 3 and b[3] in set(re.findall("[A-Za-z0-9_]+", a[5] or ""))}
    want |= {(a[0], b[0], r[2]) for r in rels for a in ids if a[1:3] == r[:2] for b in ids if b[3] == r[3]}
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(e for e in want if e[0] != e[1]) and len(rows) > 2000
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
