"""Exact top-k by integer inner product with MaxScore.

A vector's components are terms with weights. Vectors are dealt into shards of about `SHARD` rows by
a hash of the row; a shard sorts them by their strongest term and that term's weight and cuts them into
blocks of `BLOCK`. A block keeps a posting list for each term (rows and weights; of a term that over a quarter of
the rows have, the weights of all) and the term's least and largest weight. For a query the bound of a term in a
block is the most it can add there.

The blocks of a shard are visited by falling bound, the sum over the terms, and none is visited whose
bound is below the k-th best score so far, the bar. Within a block, terms whose bounds together stay
below the bar are non-essential: a vector that only they have can't enter the result. The essential
terms' postings are traversed; the others are probed, `PROBE` at a time with the largest bounds first, for
those candidates alone whose score can still reach the bar. The shards' results are merged at the end.

A task gets a shard's vectors once, then up to `QUERIES` queries one after another: vectors move once
for each such group of queries, queries once for each shard. This is the stated query set against all
rows; all else grows with the input, and a task's memory is bounded.

Edge cases: vectors that are null, or hold a null or a component that isn't finite, take no part, as
queries or as candidates; an empty vector scores zero with all; missing components of a shorter
vector count as zero; repeated rows are a query and a candidate each, and only the query's own row is left
out; ties go to the smaller id; scores beyond a BIGINT stop at its limits; null ids take no part; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corvane.llm.common import Scratch

SCALE, TOP = 256, 5
#: vectors of a shard and of a block, queries of a group, tasks at most
SHARD, BLOCK, QUERIES, TASKS = 8192, 512, 4096, 10_000
#: non-essential terms probed before candidates are held against the bar again
PROBE = 8


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v ARRAY<BIGINT>) with floor(scale * x) of each component; rows that take no part are left out."""
    bad = f"exists({vec_col}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.expr(bad)).select(
        F.col(id_col).cast("bigint").alias("id"), F.expr(f"transform({vec_col}, x -> floor(cast(x AS double) * {scale}))").alias("v")
    )


class Block:
    """Some vectors of a shard: postings by term, and the range of each term's weights."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray):
        self.rows, self.ids = rows, ids
        self.weights = np.ascontiguousarray(matrix.T)  # a term's weights side by side
        held = self.weights != 0
        self.full = held.sum(1) * 4 > len(ids)
        self.postings = [None if full else np.flatnonzero(at) for full, at in zip(self.full, held, strict=True)]
        self.least, self.most = np.minimum(matrix.min(0), 0), np.maximum(matrix.max(0), 0)

    def traverse(self, q: np.ndarray, essential: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores from the essential terms, and which vectors have any of them."""
        score, met = np.zeros(len(self.ids), q.dtype), np.zeros(len(self.ids), bool)
        essential = essential[q[essential] != 0]
        full = essential[self.full[essential]]
        if len(full):
            score += q[full] @ self.weights[full]
            met[:] = True
        for t in essential[~self.full[essential]]:
            at = self.postings[t]
            score[at] += q[t] * self.weights[t, at]
            met[at] = True
        return score, met


class Shard:
    """Vectors in blocks; weights are floats while all sums of products stay below 2**53 and are exact.

    `work` counts the postings that queries asked for (`asked`: all terms of all blocks), those they
    traversed, and those they probed.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray, block: int | None = None):
        self.work: Counter = Counter()
        self.terms = matrix.shape[1]
        if len(ids) and self.terms:
            size = np.abs(matrix.astype(float))
            top = size.argmax(1)
            at = np.arange(len(ids))
            order = np.lexsort((-size[at, top], matrix[at, top] < 0, top))
            rows, ids, matrix = rows[order], ids[order], matrix[order]
        step = block or BLOCK
        self.blocks = [Block(rows[k : k + step], ids[k : k + step], matrix[k : k + step]) for k in range(0, len(ids), step)]
        self.least, self.most = (np.array([getattr(b, x) for b in self.blocks]).reshape(len(self.blocks), self.terms) for x in ("least", "most"))

    def search(self, q: np.ndarray, own: int, k: int) -> list[tuple[int, int, int]]:
        """The k best (score, id, row) but for the row `own`, best first."""
        q = q[: self.terms] if len(q) >= self.terms else np.concatenate((q, np.zeros(self.terms - len(q), q.dtype)))
        best: list[tuple[int, int, int]] = []
        bounds = np.maximum(q * self.least, q * self.most)
        totals = bounds.sum(1)
        for n in np.argsort(-totals, kind="stable"):
            bar = best[-1][0] if len(best) == k else None
            self.work["asked"] += self.terms * len(self.blocks[n].ids)
            if bar is None or totals[n] >= bar:
                best = self._visit(self.blocks[n], bounds[n], q, own, k, best, bar)
        return best

    def _visit(self, block: Block, bounds: np.ndarray, q: np.ndarray, own: int, k: int, best: list, bar: int | None) -> list:
        order = np.argsort(-bounds, kind="stable")
        rest = np.concatenate((np.cumsum(bounds[order][::-1])[::-1], [0]))  # of the term and all after it
        essential = self.terms if bar is None else min(self.terms, int(np.searchsorted(-rest, -bar, side="right")))  # rest[essential] < bar
        score, met = block.traverse(q, order[:essential])
        self.work["traversed"] += essential * len(block.ids)
        if bar is None or bar <= 0:  # a vector without any of the terms scores zero
            met[:] = True
        found = np.flatnonzero(met & (block.rows != own))
        for n in range(essential, self.terms, PROBE):
            found = found[score[found] + rest[n] >= bar]
            if not len(found):
                return best
            t = order[n : n + PROBE]
            score[found] += q[t] @ block.weights[t][:, found]
            self.work["probed"] += len(t) * len(found)
        if bar is not None:
            found = found[score[found] >= bar]
        if len(found) > k:
            least = np.partition(score[found], len(found) - k)[len(found) - k]
            found = found[score[found] >= least]
        if not len(found):
            return best
        best = best + [(int(s), int(i), int(r)) for s, i, r in zip(score[found], block.ids[found], block.rows[found], strict=True)]
        return sorted(best, key=lambda x: (-x[0], x[1], x[2]))[:k]


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """The lists as rows, filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat, wide = lists.flatten().to_numpy(), int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    wide = max(p.shape[1] for p in parts)
    return np.concatenate([p if p.shape[1] == wide else np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts])


def _answers(shard: tuple[np.ndarray, np.ndarray, np.ndarray], kept: dict, rows: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int) -> Iterator[tuple]:
    """(query_row, query_id, id, row, score) of some queries in a shard; `kept` holds the shard's index by kind of number."""
    x = shard[2]
    largest = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(y.astype(float)).max(initial=0)) * max(x.shape[1], y.shape[1], 1)
    kind = np.float64 if largest < 2**53 else np.int64 if largest < 2**62 else object  # exact in each
    if kind not in kept:
        kept[kind] = Shard(shard[0], shard[1], x.astype(kind))
    y = y.astype(kind)
    for own, name, q in zip(rows.tolist(), ids.tolist(), y, strict=True):
        for score, i, row in kept[kind].search(q, own, k):
            yield own, name, i, row, max(-(2**63), min(2**63 - 1, score))


def numbered(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """The vectors with a number for each row, written, so that the numbers stay."""
    return scratch.put(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, id, score): the k best vectors of each query.

    Both have (id, v) and a row number, `row`; a query and a vector of one number are the same row. Queries
    that are no rows of `vectors` have numbers below zero.
    """
    scratch = Scratch(vectors.sparkSession, "maxscore")
    asked = scratch.put(queries.select("row", "id", "v"), "queries")
    shards, groups = max(1, -(-vectors.count() // SHARD)), max(1, -(-asked.count() // QUERIES))
    dealt = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.select(dealt(shards, 0).alias("shard"), every(groups).alias("grp"), F.lit(0).alias("kind"), "row", "id", "v")
    met = asked.select(every(shards).alias("shard"), dealt(groups, 1).alias("grp"), F.lit(1).alias("kind"), "row", "id", "v")
    stream = held.union(met).repartition(min(TASKS, shards * groups), "shard", "grp").sortWithinPartitions("shard", "grp", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard, kept = None, [], None, {}
        for b in batches:
            place = b.column(0).to_numpy().astype(np.int64) * (groups * 2) + b.column(1).to_numpy().astype(np.int64) * 2 + b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            out: list[tuple] = []
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                now, is_query = divmod(int(place[lo]), 2)
                if now != at:
                    at, parts, shard, kept = now, [], None, {}
                own = b.slice(lo, hi - lo)
                rows, ids, x = own.column(3).to_numpy(), own.column(4).to_numpy(), _matrix(own.column(5))
                if not is_query:
                    parts.append((rows, ids, x))
                elif parts or shard:
                    if parts:
                        shard, parts = (*(np.concatenate([p[c] for p in parts]) for c in (0, 1)), _joined([p[2] for p in parts])), []
                    out += _answers(shard, kept, rows, ids, x, k)
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_row", "query_id", "id", "row", "score"])

    found = scratch.put(stream.mapInArrow(run, "query_row bigint, query_id bigint, id bigint, row bigint, score bigint"), "found")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
