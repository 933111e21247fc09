"""Token ids in files of canonical length-limited Huffman codes.

A store is a folder of four tables, written and read by Spark alone:

* `codebook` (id, length): the code lengths; codes are canonical, in order of (length, id), most
  significant bit first;
* `parts` (part, base): the number of ids before each part of the corpus, in ascending id order;
* `blocks` (part, block, start, doc_ids, doc_tokens, n_tokens, checkpoints, payload): whole documents
  of at least `BLOCK` ids together, decodable on their own. `checkpoints` has the bit offset of every
  `CHECKPOINT`th id, so that a reader starts there, and decodes all of them side by side;
* `meta` (max_bits, checkpoint).

Code lengths are limited by package-merge over the global counts, at most one row for each id of the
vocabulary. Decoding reads `max_bits` bits and looks up id and length in one table.

Edge cases: a null or empty text is the end id alone; repeated ids keep all their rows, in order of
their contents; null ids come first; an empty table gives an empty store; a single distinct id has a
code of one bit; of the input only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm.common import Scratch
from corvane.llm.token_ids import encoder, vocabulary_size

END_ID, MAX_BITS = 1, 16
#: ids in a block, between checkpoints, and in a part
BLOCK, CHECKPOINT, PART = 1 << 18, 256, 1 << 22


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most max_bits bits; counts above zero. Package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    max_bits = max(max_bits, (n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(max_bits):
        both = np.concatenate((leaves, packages))
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        both = both[rank]
        both = both[: len(both) // 2 * 2]
        packages = both[::2] + both[1::2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        used = int(is_leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codec:
    """Encodes and decodes arrays of ids with the code of (ids, lengths)."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(self.lengths.max(initial=1))
        spans = np.left_shift(1, self.bits - self.lengths)
        self.codes = (np.cumsum(spans) - spans) >> (self.bits - self.lengths)
        self.spans = spans

    def encode(self, ids: np.ndarray, every: int = CHECKPOINT) -> tuple[bytes, np.ndarray]:
        """The bits, padded to whole 64-bit words, and the checkpoints."""
        if not hasattr(self, "by_id"):
            top = int(self.ids.max(initial=0)) + 1
            self.by_id = np.zeros(top, np.uint64), np.zeros(top, np.int64)
            self.by_id[0][self.ids], self.by_id[1][self.ids] = self.codes, self.lengths
        code, size = self.by_id[0][ids], self.by_id[1][ids]
        ends = np.cumsum(size)
        starts = ends - size
        word, shift = starts >> 6, 64 - (starts & 63) - size
        out = np.zeros(int(ends[-1] >> 6) + 1 if len(ends) else 0, np.uint64)
        over = shift < 0
        high = np.where(over, code >> np.abs(shift).astype(np.uint64), code << np.maximum(shift, 0).astype(np.uint64))
        if len(word):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] = np.add.reduceat(high, first)  # the bits are disjoint
            out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
        return out.astype(">u8").tobytes(), starts[::every]

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int, every: int = CHECKPOINT) -> np.ndarray:
        if not n:
            return np.empty(0, np.int64)
        if not hasattr(self, "table"):
            self.table = np.zeros(1 << self.bits, np.int64), np.ones(1 << self.bits, np.int64)
            filled = int(self.spans.sum())
            self.table[0][:filled], self.table[1][:filled] = np.repeat(self.ids, self.spans), np.repeat(self.lengths, self.spans)
        words = np.concatenate((np.frombuffer(payload, ">u8").astype(np.uint64), np.zeros(2, np.uint64)))
        at, last = checkpoints.astype(np.int64).copy(), len(words) - 2
        out, drop, one = np.empty((every, len(at)), np.int64), np.uint64(64 - self.bits), np.uint64(1)
        for k in range(min(every, n)):
            w, b = np.minimum(at >> 6, last), (at & 63).astype(np.uint64)
            seen = ((words[w] << b) | ((words[w + 1] >> one) >> (np.uint64(63) - b))) >> drop
            out[k] = self.table[0][seen]
            at += self.table[1][seen]
        return out.T.reshape(-1)[:n] if n > every else out[:n, 0]


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids with the end id, two bytes each where the vocabulary allows it, else four."""
    end = np.array([end_id], "<u4").tobytes()
    width = "<u2" if vocabulary_size(tokenizer_path) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).ids
        for b in batches:
            found = [np.frombuffer(encode(x.as_py()) + end, "<u4") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype(width).tobytes() for x in found], pa.binary())], ["id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary")


def id_counts(tokens: DataFrame, width: str) -> DataFrame:
    """(token, n) over all ids of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0):
                if len(raw := x.as_buffer()):
                    got = np.bincount(np.frombuffer(raw, width))
                    if len(got) > len(total):
                        got, total = total, got
                    total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["token", "n"])

    return tokens.select("ids").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the store of `docs` to `path`, in ascending order of their ids."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "huffman")
    width = "<u2" if vocabulary_size(tokenizer_path) <= 1 << 16 else "<u4"
    tokens = scratch.put(token_table(docs, tokenizer_path, end_id, id_col, text_col), "tokens", compression="zstd")
    counts = np.array([(r[0], r[1]) for r in id_counts(tokens, width).collect()], np.int64).reshape(-1, 2)  # a row for each id of the vocabulary at most
    counts = counts[np.argsort(counts[:, 0])]
    lengths = code_lengths(counts[:, 1], max_bits)
    spark.createDataFrame([(int(a), int(b)) for a, b in zip(counts[:, 0], lengths, strict=True)], "id bigint, length int").coalesce(1).write.parquet(f"{path}/codebook")
    spark.createDataFrame([(int(lengths.max(initial=1)), CHECKPOINT)], "max_bits int, checkpoint int").coalesce(1).write.parquet(f"{path}/meta")
    book = spark.sparkContext.broadcast((counts[:, 0], lengths))  # bounded by the vocabulary
    parts = max(1, -(-int(counts[:, 1].sum()) // PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, codec = TaskContext.get().partitionId(), Codec(*book.value)
        start, block, held, size = 0, 0, [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            payload, marks = codec.encode(ids)
            values = (part, block, start, [d for d, _ in held], [len(x) for _, x in held], size, marks.tolist(), payload)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["part", "block", "start", "doc_ids", "doc_tokens", "n_tokens", "checkpoints", "payload"])

        kinds = None
        for b in batches:
            kinds = kinds or (pa.int32(), pa.int32(), pa.int64(), pa.list_(b.schema.field(0).type), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary())
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.append((name, np.frombuffer(raw.as_buffer(), width)))
                size += len(held[-1][1])
                if size >= BLOCK:
                    yield close()
                    start, block, held, size = start + size, block + 1, [], 0
        if held:
            yield close()

    kind = docs.schema[id_col].dataType.simpleString()
    ranged = tokens.select("id", "ids").repartitionByRange(parts, F.col("id"), F.xxhash64("ids")).sortWithinPartitions("id", "ids")
    ranged.mapInArrow(run, f"part int, block int, start bigint, doc_ids array<{kind}>, doc_tokens array<bigint>, n_tokens bigint, checkpoints array<bigint>, payload binary").write.parquet(f"{path}/blocks")
    sums = dict(spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens")).collect())  # a row for each part
    base, rows = 0, []
    for part in sorted(sums):
        rows.append((part, base))
        base += sums[part]
    spark.createDataFrame(rows, "part int, base bigint").coalesce(1).write.parquet(f"{path}/parts")
    scratch.drop("tokens")


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document of the store; ids as an array."""
    book = spark.sparkContext.broadcast(tuple(np.array(c, np.int64) for c in zip(*spark.read.parquet(f"{path}/codebook").collect(), strict=True)) or (np.empty(0, np.int64),) * 2)
    every = spark.read.parquet(f"{path}/meta").first()["checkpoint"]
    base = dict(spark.read.parquet(f"{path}/parts").collect())
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*book.value)
        for b in batches:
            for r in b.to_pylist():
                ids = codec.decode(r["payload"], np.array(r["checkpoints"], np.int64), r["n_tokens"], every).astype("<u4")
                ends = np.cumsum(r["doc_tokens"])
                begins = ends - r["doc_tokens"]
                own = [ids[x:y] for x, y in zip(begins, ends, strict=True)]
                cols = [
                    pa.array(r["doc_ids"], b.schema.field("doc_ids").type.value_type), pa.array(begins + (r["start"] + base[r["part"]]), pa.int64()),
                    pa.array(r["doc_tokens"], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array([x.tolist() for x in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return blocks.mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)
