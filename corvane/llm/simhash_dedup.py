"""SimHash near-duplicates by multi-index hashing.

Every text gets a 64-bit fingerprint. Fingerprints that differ in at most `RADIUS` = 4 bits are
linked. The 64 bits are cut into three segments of 22, 21 and 21 bits. If two fingerprints differ in
at most four bits, then they differ in at most one bit of the first segment, or at most one bit of the
second, or not at all in the third (else they would differ in 2 + 2 + 1 bits). So each fingerprint
looks up its own key in each segment, and the ball of radius one around it in the first two. Of two
keys that differ in one bit, one has that bit set: only balls of *cleared* bits are enumerated, so
that each pair is met from one side. Complete distances are verified in the join itself.

Equal fingerprints are one node. A segment bucket with over `HOT` fingerprints has a pivot, its most
frequent member; members within reach of the pivot get an edge to it, and pairs of members of one
pivot are not joined again: they are connected through it. So a large group of near copies gives a
star instead of all pairs, and no link between different groups is lost.

Edge cases: a null text counts as empty; without words the fingerprint is zero and is linked like
any other; fewer words than a shingle are one shingle; repeated rows share a node; a component whose
doc_ids are all null has the component_id null; an empty table gives no rows; further columns of the
input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import Scratch, connected_components

SEED = 42
#: shingles whose bits are counted at once, which bounds the memory that a very long text takes
STEP = 1 << 17


def shingle_bounds(joined: bytes, width: int) -> tuple[list[int], list[int]]:
    """Starts and ends, in the space-joined words, of all runs of `width` words."""
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    if len(starts) <= width:
        return [0], [len(joined)]
    return starts[: len(starts) - width + 1].tolist(), ends[width - 1 :].tolist()


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    joined = b" ".join((text or b"").lower().split())  # bytes: only A-Z and ASCII white space
    if not joined:
        return 0
    starts, ends = shingle_bounds(joined, width)
    total = np.zeros(64, np.int64)
    for k in range(0, len(starts), STEP):
        hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[k : k + STEP], ends[k : k + STEP], strict=True)], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp BIGINT): the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


#: (segment, shift, bits, radius)
SEGMENTS = ((0, 0, 22, 1), (1, 22, 21, 1), (2, 43, 21, 0))
RADIUS = 4
#: fingerprints in a bucket from which on it has a pivot
HOT = 32


def _key(shift: int, bits: int) -> str:
    return f"(shiftrightunsigned(fp, {shift}) & {(1 << bits) - 1}L)"


def _own(extra: str = "") -> str:
    return "array(" + ", ".join(f"struct({s} AS seg, {_key(h, w)} AS key{extra})" for s, h, w, _ in SEGMENTS) + ")"


def _balls() -> str:
    """The keys to look up: the own ones, and those with one set bit cleared."""
    cleared = [
        f"transform(filter(sequence(0, {w - 1}), i -> getbit({_key(h, w)}, i) = 1), i -> struct({s} AS seg, {_key(h, w)} - shiftleft(1L, i) AS key, false AS own))"
        for s, h, w, r in SEGMENTS
        if r
    ]
    return f"concat({', '.join([_own(', true AS own'), *cleared])})"


def links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between different fingerprints that connect what links of RADIUS bits connect.

    `nodes`: (fp, n), each fingerprint once.
    """
    entries = scratch.put(nodes.select("fp", "n", F.expr(f"inline({_own()})")), "entries")
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= RADIUS
    pivots = entries.groupBy("seg", "key").agg(F.count("*").alias("size"), F.max_by("fp", F.struct("n", "fp")).alias("pivot")).where(F.col("size") > HOT)
    stars = scratch.put(entries.join(pivots, ["seg", "key"]).where(near("fp", "pivot")).groupBy("fp").agg(F.max_by("pivot", F.struct("size", "pivot")).alias("pivot")), "stars")
    tagged = nodes.select("fp").join(stars, "fp", "left").select("fp", F.coalesce("pivot", "fp").alias("pivot"))
    asked = tagged.select(F.col("fp").alias("a"), F.col("pivot").alias("pa"), F.expr(f"inline({_balls()})"))
    held = tagged.select(F.col("fp").alias("b"), F.col("pivot").alias("pb"), F.expr(f"inline({_own()})"))
    met = asked.alias("q").join(
        held.alias("t"),
        (F.col("q.seg") == F.col("t.seg")) & (F.col("q.key") == F.col("t.key")) & near("a", "b") & (~F.col("own") | (F.col("a") < F.col("b"))) & (F.col("pa") != F.col("pb")),
    )
    return met.select("a", "b").union(stars.where("fp <> pivot").select(F.col("fp").alias("a"), F.col("pivot").alias("b")))


def near_duplicates(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, root, component): component is the least id that links reach, the row's own included; root names the group."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.put(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = scratch.put(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "nodes")
    roots = connected_components(links(nodes, scratch), scratch)
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.put(rooted, "rooted")
    labels = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component")), "root").select("fp", "root", "component")
    return prints.join(labels, "fp").select("id", "fp", "root", "component")

