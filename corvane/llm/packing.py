"""Best-two-fit packing of token sequences.

Pieces are packed by their lengths alone, so the driver packs the histogram of lengths (at most
`CAPACITY` classes, whatever the corpus) and no piece is ever collected. A bin is filled greedily with
the longest pieces that fit; then its smallest piece is replaced by two unpacked pieces that fit the
gap, enlarged by that piece, more tightly, as long as there are such. The bin just made is repeated
while the histogram has all of its pieces, so there are a few thousand patterns at any size, each a list of
lengths and a number of bins. Each piece then finds its place from its rank among the pieces of
its length: a rank within its task, written with the piece, plus the prefix sum of earlier tasks.

Edge cases: a null or empty text is one piece that holds the end id alone; a text of exactly the
capacity is not cut; repeated rows are packed each; a null id stays null; an empty table gives no rows;
of the input only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corvane.llm.common import Scratch
from corvane.llm.token_ids import encoder

CAPACITY, END_ID = 2048, 0
#: shares of the capacity that a replacing pair may leave free
LOOSE = (1.0, 1 / 16, 1 / 128, 0.0)


def best_pair(lengths: np.ndarray, counts: np.ndarray, most: int, over: int) -> tuple[int, int] | None:
    """The two lengths with the largest sum within (over, most]; `lengths` ascending, `counts` above zero."""
    if most < 2 or not len(lengths):
        return None
    at = np.searchsorted(lengths, most - lengths, side="right") - 1  # of the largest partner
    at = np.minimum(at, np.arange(len(lengths)))  # the pair's smaller one
    at = np.where((at == np.arange(len(lengths))) & (counts < 2), at - 1, at)
    sums = np.where(at >= 0, lengths + lengths[at], 0)
    sums[sums > most] = 0
    k = int(sums.argmax())
    return (int(lengths[k]), int(lengths[at[k]])) if sums[k] > over else None


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin in order, number of such bins) for all pieces of the histogram.

    A pair uses up small pieces that later bins may need. So the histogram is packed once for each share
    of `LOOSE`, which bounds the gap that a pair may leave, and the fewest bins win.
    """
    found = [_pack(counts, capacity, int(capacity * share)) for share in LOOSE]
    return min(found, key=lambda bins: sum(n for _, n in bins))


def _pack(counts: dict[int, int], capacity: int, loose: int) -> list[tuple[list[int], int]]:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    done = []
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            return done
        now, gap, bin_ = left.copy(), capacity, []
        while len(lengths) and (k := int(np.searchsorted(lengths, gap, side="right")) - 1) >= 0:
            length = int(lengths[k])
            n = min(int(now[length]), gap // length)
            bin_ += [length] * n
            now[length] -= n
            gap -= n * length
            lengths = lengths[:k] if not now[length] or length > gap else lengths[: k + 1]
        while gap:
            small = bin_[-1]
            rest = np.flatnonzero(now)
            pair = best_pair(rest, now[rest], gap + small, small)
            if not pair or gap + small - sum(pair) > loose:
                break
            bin_.pop()
            now[small] += 1
            for x in pair:
                now[x] -= 1
            gap += small - sum(pair)
            bin_ = sorted([*bin_, *pair], reverse=True)
        uses = Counter(bin_)
        times = min(int(left[x]) // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= n * times
        done.append((bin_, times))


def slots(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, uses in a bin, first bin and offsets (padded) of each pattern that has it."""
    found: dict[int, list] = {}
    ranks: Counter = Counter()
    base = 0
    for bin_, times in patterns:
        places: dict[int, list[int]] = {}
        at = 0
        for x in bin_:
            places.setdefault(x, []).append(at)
            at += x
        for x, offsets in places.items():
            found.setdefault(x, []).append((ranks[x], len(offsets), base, offsets))
            ranks[x] += len(offsets) * times
        base += times
    out = {}
    for x, rows in found.items():
        first, uses, bins, offsets = zip(*rows, strict=True)
        flat = np.concatenate([np.array(o) for o in offsets])
        out[x] = (np.array(first), np.array(uses), np.array(bins), flat, np.concatenate(([0], np.cumsum(uses)[:-1])))
    return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, rank[, ids]) of every piece of every text."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, met, encode = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer_path).ids
        for b in batches:
            names, rows = b.column(0).to_pylist(), []
            for name, text in zip(names, b.column(1), strict=True):
                ids = encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((name, piece, at // 4, n, zlib.crc32(own), task, int(met[n]), own if keep_ids else None))
                    met[n] += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            n = 8 if keep_ids else 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds[:n], strict=True)], ["id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"][:n])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint" + ", ids binary" * keep_ids
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.put(pieces(docs, tokenizer_path, capacity, end_id, keep_ids, id_col, text_col), "pieces")
    each = scratch.put(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = {r[0]: r[1] for r in each.groupBy("length").agg(F.sum("n")).collect()}  # at most one row for each length up to capacity
    table = slots(pack_histogram(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                first, uses, bins, flat, begins = table[int(x)]
                k = np.searchsorted(first, rank[own], side="right") - 1
                within = rank[own] - first[k]
                seq[own] = bins[k] + within // uses[k]
                offset[own] = flat[begins[k] + within % uses[k]]
            keep = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(seq), pa.array(offset)], [*keep, "sequence_id", "offset"])

    own = [c for c in cut.columns if c not in ("task", "rank")]
    placed = cut.join(offsets, ["length", "task"]).select(*own, (F.col("rank") + F.col("earlier")).alias("rank"))
    kinds = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in own)
    return placed.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")
