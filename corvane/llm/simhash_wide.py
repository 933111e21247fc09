"""SimHash near-duplicates of a stated word-shingle similarity: wide fingerprints find the pairs, the shingles decide.

The contract of the 64-bit query fixes four-word shingles and 4 bits; the pipeline asks for five words at 0.8.
Two texts whose sets of word shingles have the Jaccard similarity s differ in about arccos(2s / (1 + s)) / pi
of their fingerprint bits: 15 percent at s = 0.8. A 64-bit fingerprint within 4 bits finds hardly any such
pair, so here the fingerprint has 512 bits and more, and pairs within `radius_of(0.8)` bits, the expected number and
1.65 deviations, are candidates: 95 percent of the pairs at the very bound, nearly all above it. The exact similarity
of the two sets of shingles then decides, so that no pair below the bound is linked.

The index is multi-index hashing as in `simhash_dedup`, over the first words of the fingerprint: segments, each
looked up by its own key and by the ball of radius one (keys with one set bit cleared, so that a pair is
met from one side). `LAYOUTS` widens the segments with the number of texts, so that buckets of unrelated texts stay small. A
pair is missed if it differs in two bits or more of every segment: at 0.8 that is 1 in 100 pairs or fewer in each layout.
The join gives each pair once, at its first segment.

Hot buckets have pivots, in two rounds: the member whose own buckets are largest, which is the one that most others
come from. Members within the radius are a star around their pivot. Each member of a star has a hub too, which stars of
one group have in common: the heaviest pivot of its buckets, near or not, or that one's hub. Members are compared with pivot and hub, and
what these links connect has one root. Pairs of one root need no look; of the others with a common hub those alone meet that can
be similar: the two share no shingle of the hub that one of them lacks, and of the rest nothing that one of the bitmaps rules out. That bound holds
for any hub and is nearly exact for near copies. Between two roots the nearest pair is verified first, and all
other pairs where that one fails. So a large group gives no square of candidates, and no link that could connect two groups is left out.

The shingles of those texts that have a candidate are made once: those of stars first, the others with the other pairs.

Edge cases: a null text counts as empty, and texts without words are copies of each other; fewer words than a shingle
are one shingle; rows of one id and text are one, rows of one id and other texts are not; a row without an
id is kept last; an empty table gives no rows; columns of any name are carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.common import Scratch, connected_components, fresh, quoted, row_key, small
from corvane.llm.simhash_dedup import SEED, shingle_bounds

WIDTH, SIMILARITY, HOT, ROUNDS, DEVIATIONS = 5, 0.8, 32, 2, 1.65
#: shingles whose bits are counted at once: their counts fit 16 bits
STEP = 1 << 14
#: words of the two bitmaps of a star member: its shingles that its hub lacks, and the hub's that it lacks
REST = 8
RESTS, LACKS = [f"r{k}" for k in range(REST)], [f"m{k}" for k in range(REST)]


class Layout(NamedTuple):
    """Bits of a segment, words of the fingerprint that are cut into segments, and all of its words."""

    bits: int
    index: int
    words: int

    def segments(self) -> list[tuple[int, int]]:
        """(word, shift) of each."""
        return [(w, s * self.bits) for w in range(self.index) for s in range(64 // self.bits)]


#: for up to so many texts; the last one for more
LAYOUTS = ((1 << 22, Layout(16, 4, 8)), (1 << 26, Layout(20, 8, 8)), (None, Layout(24, 20, 20)))


def layout_for(count: int) -> Layout:
    return next(layout for most, layout in LAYOUTS if most is None or count <= most)


def radius_of(similarity: float, words: int) -> int:
    """Bits in which texts of that shingle similarity differ, and DEVIATIONS more."""
    share, bits = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * words
    return round(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))


def multipliers(words: int) -> np.ndarray:
    """Odd numbers that make further hashes of one: steps of the golden ratio."""
    return np.array([(k * 0x9E3779B97F4A7C15 | 1) % 2**64 for k in range(words)], np.uint64)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of a UTF-8 text's different shingles, in order; none without words."""
    from xxhash import xxh64_intdigest

    joined = b" ".join((text or b"").lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    starts, ends = shingle_bounds(joined, width)
    return np.unique(np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def wide_fingerprint(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The fingerprint's words, one for each multiplier, and one that names the set; each different shingle counts once."""
    total = np.zeros(64 * len(odd), np.int64)
    for at in range(0, len(hashes), STEP):
        own = hashes[at : at + STEP, None] * odd
        own ^= own >> np.uint64(29)
        total += np.unpackbits(own.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    words = np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")
    return np.append(words, np.bitwise_xor.reduce(hashes, initial=np.uint64(0)) + np.uint64(len(hashes)))


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def wide_fingerprints(docs: DataFrame, layout: Layout, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, w0, w1, ..., node): the words as signed longs, and one long that names the set of shingles."""
    names = [f"w{k}" for k in range(layout.words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = multipliers(layout.words)
        for b in batches:
            words = np.array([wide_fingerprint(shingle_set(x.as_py(), width), odd) for x in b.column(2)], np.uint64).reshape(-1, layout.words + 1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(words[:, k]) for k in range(layout.words + 1))], ["id", "key", *names, "mark"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(quoted(id_col).alias("id"), row_key(id_col, text_col).alias("key"), quoted(text_col).cast("binary").alias("text"))
    made = rows.mapInArrow(run, f"id {kind}, key binary, {', '.join(f'{n} bigint' for n in names)}, mark bigint")
    return made.withColumn("node", F.xxhash64(*names, "mark")).drop("mark")


def _key(layout: Layout, s: int) -> str:
    word, shift = layout.segments()[s]
    return f"CAST(shiftrightunsigned(w{word}, {shift}) & {(1 << layout.bits) - 1}L AS int)"


def _keys(layout: Layout, extra: str = "") -> str:
    return "array(" + ", ".join(f"struct({s} AS seg, {_key(layout, s)} AS key{extra})" for s in range(len(layout.segments()))) + ")"


def _balls(layout: Layout) -> str:
    cleared = [
        f"transform(filter(sequence(0, {layout.bits - 1}), i -> getbit({_key(layout, s)}, i) = 1), i -> struct({s} AS seg, {_key(layout, s)} - shiftleft(1, i) AS key, false AS own))" for s in range(len(layout.segments()))
    ]
    return f"concat({', '.join([_keys(layout, ', true AS own'), *cleared])})"


def _distance(layout: Layout, a: str, b: str) -> Column:
    return F.expr(" + ".join(f"bit_count({a}.w{k} ^ {b}.w{k})" for k in range(layout.words)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _first(layout: Layout) -> str:
    """No segment before the one that q and t met at brings them together."""
    masks = [(w, _signed(((1 << layout.bits) - 1) << shift)) for w, shift in layout.segments()]
    part = lambda w, m: f"bit_count((q.w{w} ^ t.w{w}) & {m if m != -(1 << 63) else 'bigint(-9223372036854775808)'}L)"
    return " AND ".join(f"(q.seg <= {s} OR {part(w, m)} > 1)" for s, (w, m) in enumerate(masks[:-1]))


def candidate_stars(nodes: DataFrame, count: int, layout: Layout, scratch: Scratch, radius: int) -> DataFrame:
    """(node, pivot, hub) of members of hot buckets within the radius of a pivot; a pivot is its own."""
    words = [f"w{k}" for k in range(layout.words)]
    entries = nodes.select("node", F.expr(f"inline({_keys(layout)})"))
    hot = max(HOT, 4 * count >> layout.bits)  # four times what chance gives
    sizes = scratch.put(entries.groupBy("seg", "key").agg(F.count("*").alias("size")).where(F.col("size") > hot), "sizes")
    held = scratch.put(nodes.select("node", *words, F.expr(f"inline({_keys(layout)})")).join(sizes, ["seg", "key"]), "hot")
    weights = scratch.put(held.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    stars = None
    for r in range(ROUNDS):
        left = held if stars is None else held.join(stars.select("node"), "node", "left_anti")
        pivots = left.join(weights, "node").groupBy("seg", "key").agg(F.max_by(F.struct("node", "weight", *words), F.struct("weight", "node")).alias("p"))
        pivots = pivots.select("seg", "key", F.col("p.node").alias("pivot"), F.col("p.weight").alias("weight"), *[F.col(f"p.{w}").alias(w) for w in words])
        if not r:
            heavy = held.select("seg", "key", "node").join(pivots.select("seg", "key", "pivot", "weight"), ["seg", "key"])
            hubs = scratch.put(heavy.groupBy("node").agg(F.max_by("pivot", F.struct("weight", "pivot")).alias("hub")), "hubs")
        near = left.alias("e").join(pivots.alias("p"), ["seg", "key"]).where(_distance(layout, "e", "p") <= radius)
        found = scratch.put(near.groupBy("e.node").agg(F.max_by("p.pivot", F.struct("p.weight", "p.pivot")).alias("pivot")), f"stars{r}")
        stars = found if stars is None else stars.union(found)
    scratch.drop("hot", "sizes", "weights")
    above = hubs.select(F.col("node").alias("hub"), F.col("hub").alias("above"))
    return stars.join(hubs.join(above, "hub").select("node", F.col("above").alias("hub")), "node")


def candidate_pairs(tagged: DataFrame, layout: Layout, radius: int, tell: str) -> DataFrame:
    """(a, b, far, fa, fb) of nodes within the radius for which `tell`, over q and t, holds, and their roots in order; each pair once."""
    asked, held = tagged.select("*", F.expr(f"inline({_balls(layout)})")).alias("q"), tagged.select("*", F.expr(f"inline({_keys(layout)})")).alias("t")
    far = _distance(layout, "q", "t")
    met = asked.join(held, F.expr(f"q.seg = t.seg AND q.key = t.key AND (NOT q.own OR q.node < t.node) AND {tell}") & (far <= radius) & F.expr(_first(layout)))
    return met.select(F.col("q.node").alias("a"), F.col("t.node").alias("b"), far.alias("far"), F.least("q.root", "t.root").alias("fa"), F.greatest("q.root", "t.root").alias("fb"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, count: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes) of the nodes of `wanted` (key, node), from the texts of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x.as_py(), width).tobytes() for x in b.column(1)], pa.binary())], ["node", "hashes"])

    rows = docs.select(row_key(id_col, text_col).alias("key"), quoted(text_col).cast("binary").alias("text")).join(small(wanted, count, 80), "key")
    return rows.select("node", "text").mapInArrow(run, "node bigint, hashes binary").dropDuplicates(["node"])


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = lambda end, name: sets.select(F.col("node").alias(end), F.col("hashes").alias(name))
    return pairs.select("a", "b").join(one("b", "hb"), "b").join(one("a", "ha"), "a").select("a", "b", "ha", "hb")


def _both(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return ((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True))


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b) of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([similarity_of(x, y) for x, y in _both(b)], pa.float64())], ["a", "b", "similarity"])

    return _with_sets(pairs, sets).mapInArrow(run, "a bigint, b bigint, similarity double")


def spokes_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity, size, common, r0, ..., m0, ...): a's shingles, those that b has, and bitmaps of a's that b lacks and b's that a lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, maps = [], np.zeros((b.num_rows, 128 * REST), bool)
            for k, (x, y) in enumerate(_both(b)):
                own = np.isin(x, y, assume_unique=True)
                for at, only in ((0, x[~own]), (64 * REST, np.setdiff1d(y, x, assume_unique=True))):
                    maps[k, at + (only % np.uint64(64 * REST)).astype(np.int64)] = True
                rows.append((similarity_of(x, y), len(x), int(own.sum()), len(y)))
            bits = np.packbits(maps, axis=1, bitorder="little").view(np.int64)
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            made = [pa.array(cols[0], pa.float64()), *(pa.array(c, pa.int64()) for c in cols[1:]), *(pa.array(bits[:, k]) for k in range(2 * REST))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["a", "b", "similarity", "size", "common", "whole", *RESTS, *LACKS])

    return _with_sets(pairs, sets).mapInArrow(run, f"a bigint, b bigint, similarity double, size bigint, common bigint, whole bigint, {', '.join(f'{r} bigint' for r in RESTS + LACKS)}")


def _possible(similarity: float) -> str:
    """Whether q and t of one hub can be that similar, by the most shingles that they can share.

    A set bit stands for one shingle at least: the hub's that one of the two lacks are no fewer than the bits of both maps, and of
    the shingles that the hub lacks each has as many alone, at least, as it has bits that the other has not.
    """
    bits = lambda form, names: " + ".join(f"bit_count({form.format(r=r)})" for r in names)
    of_hub = f"least(q.common, t.common, q.whole - ({bits('q.{r} | t.{r}', LACKS)}))"
    others = f"least(q.size - q.common - ({bits('q.{r} & ~t.{r}', RESTS)}), t.size - t.common - ({bits('t.{r} & ~q.{r}', RESTS)}))"
    return f"({of_hub} + {others} >= {similarity / (1 + similarity)} * (q.size + t.size))"


def _rooted(tagged: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """`tagged` with the root of each node in what the links connect."""
    roots = connected_components(links, scratch).withColumnRenamed("node", "member")
    return tagged.join(roots, F.col("node") == F.col("member"), "left").drop("member").withColumn("root", F.coalesce("root", "node"))


def _nearest(pairs: DataFrame) -> DataFrame:
    """(fa, fb, a, b, n): the nearest pair of each two roots, and the number of their pairs."""
    near = pairs.groupBy("fa", "fb").agg(F.min_by(F.struct("a", "b"), F.struct("far", "a", "b")).alias("p"), F.count("*").alias("n"))
    return near.select("fa", "fb", "p.*", "n")


def wide_links(nodes: DataFrame, docs: DataFrame, scratch: Scratch, similarity: float, layout: Layout, width: int, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) of that similarity, which connect what all links connect; `nodes`: (node, key, w0, ...), each once."""
    words, radius, count = [f"w{k}" for k in range(layout.words)], radius_of(similarity, layout.words), nodes.count()
    enough = similarity - 1e-9
    stars = candidate_stars(nodes, count, layout, scratch, radius)
    starred = scratch.put(nodes.join(stars, "node").select("node", "key", "pivot", "hub"), "starred")
    sets = scratch.put(shingle_sets(docs, starred.select("key", "node"), starred.count(), width, id_col, text_col), "sets")
    asked = starred.select(F.col("node").alias("a"), F.col("hub").alias("b")).union(starred.select("node", "pivot")).distinct()
    spokes = scratch.put(spokes_of(asked, sets), "spokes")
    links = spokes.where((F.col("similarity") >= enough) & (F.col("a") != F.col("b"))).select("a", "b")
    tagged = nodes.join(starred.select("node", "hub"), "node", "left").select("node", *words, F.coalesce("hub", "node").alias("hub"))
    tagged = scratch.put(_rooted(tagged, links, scratch), "tagged")
    across = scratch.put(candidate_pairs(tagged, layout, radius, "q.hub <> t.hub AND q.root <> t.root"), "across")
    ends = across.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(starred.select("node"), "node", "left_anti")
    wanted = scratch.put(nodes.join(ends, "node", "left_semi").select("key", "node"), "wanted")
    sets = sets.union(scratch.put(shingle_sets(docs, wanted, wanted.count(), width, id_col, text_col), "more"))
    # of one hub: pairs that can be similar
    inside = tagged.join(spokes.select(F.col("a").alias("node"), F.col("b").alias("hub"), "size", "common", "whole", *RESTS, *LACKS), ["node", "hub"])
    pairs = scratch.put(across.union(candidate_pairs(inside, layout, radius, f"q.hub = t.hub AND q.root <> t.root AND {_possible(enough)}")), "pairs")
    nearest = scratch.put(_nearest(pairs), "nearest")
    first = scratch.put(similarities(nearest, sets).where(F.col("similarity") >= enough).select("a", "b"), "first")
    failed = nearest.where("n > 1").join(first, ["a", "b"], "left_anti")
    rest = pairs.join(failed.select("fa", "fb"), ["fa", "fb"], "left_semi").join(failed.select("a", "b"), ["a", "b"], "left_anti")
    second = similarities(rest, sets).where(F.col("similarity") >= enough).select("a", "b")
    edges = scratch.put(links.union(first).union(second), "edges")
    scratch.drop("starred", "tagged", "across", "wanted", "sets", "more", "spokes", "pairs", "nearest", "first", "hubs", *[f"stars{r}" for r in range(ROUNDS)])
    return edges


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, node, root) of every row: rows of one root are connected by links of the similarity."""
    scratch = Scratch(docs.sparkSession, "wide")
    layout = layout_for(docs.count())
    prints = scratch.put(wide_fingerprints(docs, layout, width, id_col, text_col), "prints")
    nodes = scratch.put(prints.groupBy("node").agg(F.min("key").alias("key"), *[F.first(f"w{k}").alias(f"w{k}") for k in range(layout.words)]), "nodes")
    edges = wide_links(nodes, docs, scratch, similarity, layout, width, id_col, text_col)
    scratch.drop("nodes")
    roots = connected_components(edges, scratch).withColumnRenamed("node", "member")
    return prints.join(roots, F.col("node") == F.col("member"), "left").select("id", "key", "node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that with the least id (rows without an id last), with all columns.

    Rows are told by a digest of id and text; of rows that agree in both any one stays.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    labels = scratch.put(similar_groups(docs, similarity, width, id_col, text_col), "labels")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("b")
    groups = labels.groupBy("root").agg(least, F.count("*").alias("n")).where("n > 1").select("root", F.col("b.key").alias("kept"))
    (key,) = fresh(docs, "_key")
    marked = labels.join(groups, "root").select("key", (F.col("key") == F.col("kept")).alias("kept"))
    marked = scratch.put(marked.groupBy("key").agg(F.first("kept").alias("kept"), F.count("*").alias("n")), "marked")  # rows of a key are of one group
    gone, again = (marked.where(x).select(F.col("key").alias(key)) for x in ("NOT kept", "kept AND n > 1"))
    own = [quoted(c) for c in docs.columns]
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    kept = keyed.join(gone, key, "left_anti")
    if again.isEmpty():
        return kept.select(*own)
    return kept.join(again, key, "left_anti").select(*own).unionByName(kept.join(again, key, "left_semi").dropDuplicates([key]).select(*own))
