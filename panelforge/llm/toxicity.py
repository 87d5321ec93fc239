"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: the hashed buckets of its words and their stems, of
neighbouring word pairs, and of pairs with one word between (each bucket counts
once a text). Training is
FTRL-proximal: every coordinate has its own learning rate, and L1 sets most
weights to exactly zero, so the model is a short list of (bucket, weight) pairs
that is broadcast whatever the size of the corpus. Scoring is a map over whole
texts without a shuffle.

The fit uses a sample of labelled rows bounded by ``max_rows`` and ``max_bytes``
(chosen by a hash of the id); the feature hashing is done on the executors.

Defined cases. Null or empty text: the score of the intercept. Without labelled
rows every score is 0 (predicted 0). Contradicting labels of one id both count.
Repeated rows are scored alike; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import Words, held_out, mapped, slices, table, whole, words, written

BITS = 20
STEMS = (4, 5)  # a longer word also counts under its first letters, so that inflected and compound words share a weight
EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
PAIR, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hashes(vocab: list[str]) -> np.ndarray:
    """Hashes of every word without its edge punctuation and of its stems, one row for each; 0 where there is none."""
    stripped = [w if w.isalnum() else EDGES.sub("", w) for w in vocab]
    forms = [stripped, *([f"{w[:k]}~" if len(w) > k else "" for w in stripped] for k in STEMS)]
    return np.array([[xxhash.xxh64_intdigest(w) | 1 if w else 0 for w in form] for form in forms], np.uint64)


#: Words whose features are worked out at a time.
STRETCH = 1 << 17


def features(w: Words, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct (text << BITS | bucket) of all words, stems, neighbouring pairs and skip-grams, sorted; with
    ``wanted`` only those buckets where it is not 0. Long texts are gone through in stretches, so that the room needed
    is that of the result."""
    if not len(w.codes):
        return np.zeros(0, np.int64)
    h, *stems = _hashes(w.vocab)
    first = [h * PAIR, h * SKIP]
    real = h[w.codes] != 0
    codes, rows = w.codes[real].astype(np.int32), w.rows[real].astype(np.int32)
    out = [np.zeros(0, np.int64)]

    def take(text: np.ndarray, hashed: np.ndarray) -> None:
        bucket = (hashed >> np.uint64(64 - BITS)).astype(np.int64)
        if wanted is not None:
            hit = wanted[bucket] != 0
            text, bucket = text[hit], bucket[hit]
        found.append(text.astype(np.int64) << BITS | bucket)

    for at in range(0, len(codes), STRETCH):
        c, r = codes[at : at + STRETCH + 2], rows[at : at + STRETCH + 2]
        found: list[np.ndarray] = []
        own = slice(0, STRETCH)
        take(r[own], h[c[own]])
        for stem in stems:
            hashed = stem[c[own]]
            longer = hashed != 0
            take(r[own][longer], hashed[longer])
        for gap, salted in zip((1, 2), first, strict=True):
            a, b = c[: len(c) - gap][own], c[gap:][own]
            same = r[: len(r) - gap][own] == r[gap:][own]
            take(r[gap:][own][same], salted[a[same]] + h[b[same]])
        out.append(np.unique(np.concatenate(found)))
    return np.unique(np.concatenate(out)) if len(out) > 2 else out[-1]


class FtrlProximal:
    """Per-coordinate follow-the-regularised-leader for binary features."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, size: int = 1 << BITS):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the intercept

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def sparse(self) -> tuple[float, np.ndarray, np.ndarray]:
        """(intercept, buckets, weights), weights that are not zero."""
        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w[:-1])
        return float(w[-1]), at, w[at]


#: A fit makes this many updates at least, going over few examples more often.
UPDATES = 24_000


def fit(examples: list[tuple[np.ndarray, int]], rounds: int = 4, **rates) -> tuple[float, np.ndarray, np.ndarray]:
    model = FtrlProximal(**rates)
    order = np.random.default_rng(7)
    for _ in range(max(rounds, -(-UPDATES // max(1, len(examples))))):
        for i in order.permutation(len(examples)):
            model.update(*examples[i])
    return model.sparse()


def _featurised(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            pairs = features(words(part.column("text")))
            ends = np.searchsorted(pairs, np.arange(1, part.num_rows + 1) << BITS)
            lists = np.split((pairs & ((1 << BITS) - 1)).astype(np.int32), ends[:-1])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array([x.tobytes() for x in lists], pa.binary())], names=["doc_id", "toxic", "buckets"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_bytes: int = 256 << 20, **rates) -> tuple[float, np.ndarray, np.ndarray]:
    """Fits on about ``max_rows`` labelled rows outside the held-out fold, and on fewer where their buckets (4 bytes
    for each distinct one of a text) would take more than about ``max_bytes`` on the driver."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & ~held_out())
    total = marked.count()
    if not total:
        return -50.0, np.zeros(0, np.int64), np.zeros(0)
    chosen = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < min(1.0, max_rows / total) * 1_000_000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    found = written(mapped(rows, _featurised, "doc_id bigint, toxic int, buckets binary"))
    if (room := found.agg(F.sum(F.octet_length("buckets")).alias("n")).first()["n"] or 0) > max_bytes:
        found = found.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < max_bytes / room * 1_000_000)
    got = found.toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    # Views of the received buffers: the sample is held once, as 32-bit buckets.
    views = [np.frombuffer(x.as_buffer(), np.int32) if x.is_valid else np.zeros(0, np.int32) for x in got.column("buckets")]
    model = fit(list(zip(views, got.column("toxic").to_pylist(), strict=True)), **rates)
    del views, got
    gc.collect()
    pa.default_memory_pool().release_unused()
    return model


class Scorer:
    """A broadcast model, spread out once by worker."""

    def __init__(self, shared):
        self.intercept, buckets, weights = shared.value
        self.dense = np.zeros(1 << BITS, np.float32)
        self.dense[buckets] = weights

    def scores(self, texts: pa.Array) -> np.ndarray:
        pairs = features(words(texts), self.dense)
        total = self.intercept + np.bincount(pairs >> BITS, self.dense[pairs & ((1 << BITS) - 1)], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def scored(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared)
        for batch in batches:
            for part in slices(batch, "text"):
                score = scorer.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return mapped(rows, run, "doc_id bigint, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, in one map."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared)
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(scorer.scores(part.column(text_col)) < 0.5))

    return mapped(docs, run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
