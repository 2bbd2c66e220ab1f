"""Operator 2: document quality by hashed word n-gram logistic regression.

Tokens are runs of word characters and runs of punctuation. Their uni- and bigrams, and
5-grams with the words replaced by which of the last four equal the newest (repetition
looks alike whatever is repeated), are hashed into 2**18 coordinates and weighted by
relative frequency. The model is trained by
follow-the-regularised-leader (proximal) updates on a bounded sample of labelled rows and
scores every text as a sparse dot product.

The sample: at most about `max_train` labelled rows, chosen by a hash of the id, so it is
the same whatever the partitioning. The weights (1 MB at 2**18) have a fixed size and are
broadcast.

Nulls and rows: null and empty texts have no features and score the bias alone; labels
that are null or have a null id are ignored, an id labelled repeatedly takes the mean
label; repeated documents are each scored; with no usable labels every score is 0.5; an
empty table gives an empty result; further columns pass through `scored`; a text of any length is hashed
whole, a megabyte at a time; a mean label of one half trains as such, and a score that equals the threshold passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, SPACES, WordHasher, free_name, mix, slices

BITS = 18
MAX_TRAIN = 4_000
#: Bytes of sampled texts' coordinates that the fit takes, at most.
MAX_FIT_BYTES = 256 << 20
THRESHOLD = 0.7
_SCALE = 8.0
_hasher = WordHasher(SPACES, PUNCTUATION)


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The hashed n-gram coordinates of each text, one for each occurrence."""
    shift = np.uint64(64 - BITS)
    for _, h in _hasher.texts([(t or "").encode() for t in texts]):
        pairs = mix(h[:-1] * np.uint64(3) + h[1:])
        same = np.zeros(len(h), dtype=np.uint64)
        for k in (1, 2, 3, 4):
            same[k:] |= (h[k:] == h[:-k]).astype(np.uint64) << np.uint64(k)
        yield (np.concatenate([h, pairs, mix(same + np.uint64(1 << 40))]) >> shift).astype(np.int32)


class Ftrl:
    """FTRL-proximal logistic regression over 2**BITS coordinates and a bias."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 4, seed: int = 7) -> np.ndarray:
        """Weights learnt from rows of (different coordinates, how often each occurs, label)."""
        rng = np.random.default_rng(seed)
        data = [(np.append(u, 1 << BITS), np.append(count * (_SCALE / max(1, int(count.sum()))), 1.0), y) for u, count, y in rows]
        for _ in range(epochs):
            for i in rng.permutation(len(data)):
                self.learn(*data[i])
        return self.weights(slice(None)).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_train: int, text: str = "text") -> DataFrame:
    """(doc_id, y, text) of about max_train labelled ids at most, chosen by a hash of the id; of an id's texts the least."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).cast("double").alias("y"))
    n = known.count()
    share = min(1.0, max_train / max(n, 1))
    known = known.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = docs.select("doc_id", F.col(text).cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights learnt from labels (doc_id, label 0/1) of docs (doc_id, text).

    The driver gets each sampled text's different coordinates with their counts, in the order of a hash of the
    id, and stops at MAX_FIT_BYTES; a text has 2 MB of them at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, y = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, f in ((s + i, f) for s, texts in slices(b.column(2)) for i, f in enumerate(features(texts))):
                at, count = np.unique(f, return_counts=True)
                row = [pa.array([ids[i]], pa.int64()), pa.array([y[i]]), pa.array([at.tobytes()]), pa.array([count.astype(np.int32).tobytes()])]
                yield pa.RecordBatch.from_arrays(row, ["doc_id", "y", "at", "n"])

    sample = labelled_sample(docs, labels, label, max_train).select(F.col("doc_id").cast("long"), "y", "text")
    found, rows, size = sample.mapInArrow(run, "doc_id long, y double, at binary, n binary"), [], 0
    for r in found.orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id").toLocalIterator():
        size += len(r.at) + len(r.n)
        if rows and size > MAX_FIT_BYTES:
            break
        rows.append(r)
    rows.sort(key=lambda r: r.doc_id)
    return Ftrl().fit([(np.frombuffer(r.at, dtype=np.int32), np.frombuffer(r.n, dtype=np.int32), r.y) for r in rows])


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1 as column `out`."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            score = []
            for _, texts in slices(b.column(b.num_columns - 1)):
                for at in features(texts):
                    dot = float(w[at].sum(dtype=np.float64)) * (_SCALE / max(1, len(at))) + float(w[-1])
                    score.append(1 / (1 + np.exp(-min(max(dot, -35.0), 35.0))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score, pa.float64())], [*b.schema.names[:-1], out])

    kept = [c for c in docs.columns if c != out]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    copy = free_name(docs, "_scored_text")
    return docs.select(*kept, F.col(text).cast("string").alias(copy)).mapInArrow(run, f"{kinds}, `{out}` double")


def held_out(doc_id: str = "doc_id"):
    """The quarter of the ids that no model learns from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
