"""Hierarchical language identification with linear support vector machines.

A text is lower-cased, ASCII characters other than letters become spaces, and the byte trigrams of its
UTF-8 form are counted in `BUCKETS` hashed buckets, over the whole text. The language family is told
first, by one-versus-one linear SVMs between families; one-versus-one SVMs between the languages of that
family, trained on them alone, separate those. A vote decides, and the sum of margins between equal
votes. All machines are linear in the bucket frequencies, so a text costs one product of a small matrix.

Training takes up to `SAMPLE` labelled rows of each language (the first ones by a hash of id and text, whatever
else the table holds), whose bucket counts go to the driver; everything else reads all rows. `FAMILIES` groups languages; one
that is not listed is a family of its own.

Edge cases: `und` with score zero if the text is null or has no letter, or if nothing was learned; with
one learned language every text with letters gets it; rows with a null language or text are not learned from; a null
id counts as an empty one where folds are dealt; ties of votes and margins go to the language first
in order; repeated rows are judged each; an empty table gives no rows; only id, text and lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corvane.llm.common import bounded_batches

BUCKETS, SAMPLE, STEP = 1 << 12, 600, 1 << 20
#: Families of languages.
FAMILIES = {
    "germanic": ("da", "de", "en", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "uk"),
}
LETTER = re.compile(r"[^\W\d_]")
SPACES = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
#: margin to probability, and weight of the machines' norm
STEEP, REGULAR, ROUNDS = 3.0, 1e-3, 400


def family_of(language: str) -> str:
    return next((f for f, names in FAMILIES.items() if language in names), language)


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the text's byte trigrams, by bucket."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(SPACES) + b" ", np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw) - 2, STEP):
        b = raw[at : at + STEP + 2].astype(np.uint32)
        key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        total += np.bincount((key * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    return total


def train_svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM: y is 1 or -1. Averaged subgradient steps over all rows, classes of equal weight."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, mean = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, ROUNDS + 1):
        inside = ((y * (x @ w[:-1].astype(x.dtype) + w[-1]) < 1) * share * y).astype(x.dtype)
        w = (1 - 1 / t) * w + np.append(inside @ x, inside.sum()) / (REGULAR * t)
        norm = np.sqrt(REGULAR) * np.linalg.norm(w)
        w /= max(1.0, norm)
        if t > ROUNDS // 2:
            mean += w / (ROUNDS - ROUNDS // 2)
    return mean[:-1], float(mean[-1])


class Model:
    """The tree of machines, from bucket frequencies; `predict` takes bucket counts."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        self.languages = sorted(set(languages))
        self.families = sorted({family_of(x) for x in self.languages})
        lang = np.array(languages)
        fam = np.array([family_of(x) for x in languages])
        # the deviation by moments: no copy of x
        scale = 1 / np.maximum(np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / len(x) - x.mean(0) ** 2, 0)), 1e-4) if len(x) else np.ones(BUCKETS)
        scale = (scale / np.sqrt(BUCKETS)).astype(np.float32)
        rows, self.bias, self.pairs = [], [], []
        for level, labels, names in [("", fam, self.families), *((f, lang, [n for n in self.languages if family_of(n) == f]) for f in self.families)]:
            for a, b in combinations(names, 2):
                own = (labels == a) | (labels == b)
                part = x[own]
                part *= scale
                w, bias = train_svm(part, np.where(labels[own] == a, 1.0, -1.0))
                rows.append(w * scale)
                self.bias.append(bias)
                self.pairs.append((level, a, b))
        self.weights = np.array(rows).reshape(len(rows), BUCKETS)
        self.bias = np.array(self.bias)

    def _vote(self, level: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        votes, sums, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for (of, a, b), m in zip(self.pairs, margins, strict=True):
            if of == level:
                votes[a if m >= 0 else b] += 1
                for name, own in ((a, m), (b, -m)):
                    sums[name] += own
                    least[name] = min(least[name], 1 / (1 + np.exp(-min(30.0, max(-30.0, STEEP * own)))))
        best = max(names, key=lambda n: (votes[n], sums[n]))
        return best, least[best]

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        if not self.languages:
            return "und", 0.0
        margins = self.weights @ (counts / max(1, counts.sum())) + self.bias
        family, sure = self._vote("", self.families, margins)
        language, also = self._vote(family, [n for n in self.languages if family_of(n) == family], margins)
        return language, float(sure * also)


def held_out(id_col: str) -> Column:
    """True for the fold that is never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the labelled rows outside the held-out fold; `sample` rows of each language at most."""
    bounded_batches(docs.sparkSession)
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Model(np.zeros((0, BUCKETS), np.float32), [])
    # the hash picks about twice the sample, so that the ranks, kept to `sample` in each task before any exchange, have few rows to sort
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, 2 * sample / n))])
    near = labelled.withColumn("h", F.xxhash64("id", "text")).where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    picked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("rank") <= sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [trigram_counts(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([(c / max(1, c.sum())).astype("<f4").tobytes() for c in found], pa.binary())], ["lang", "parts"])

    rows = picked.select("text", "lang").mapInArrow(run, "lang string, parts binary").collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    x = np.empty((len(rows), BUCKETS), np.float32)
    for k, r in enumerate(rows):
        x[k] = np.frombuffer(r[1], "<f4")
    languages = [r[0] for r in rows]
    rows.clear()
    return Model(x, languages)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of `keep` (by default the id) and the prediction of every row, which sees the text alone."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few weights for each pair of languages
    own = list(keep) or [id_col]
    at = own.index(text_col) if text_col in own else len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value
        for b in batches:
            found = [told.predict(trigram_counts(x)) if (x := v.as_py()) and LETTER.search(x) else ("und", 0.0) for v in b.column(at)]
            cols = [*(b.column(k) for k in range(len(own))), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*own, *names])

    rows = docs.select(*own, *([F.col(text_col).alias("_text")] if at == len(own) else []))
    kinds = T.StructType([*docs.select(*own).schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return rows.mapInArrow(run, kinds)
