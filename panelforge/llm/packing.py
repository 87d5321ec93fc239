"""Packing of documents into sequences along a space-filling curve.

Every document becomes a hashed vector of its words, projected to a few
dimensions by a fixed random matrix; its place on a Hilbert curve through that
space orders the documents, so neighbours on the curve are alike. Documents are
range-partitioned by that key and sorted; each partition lays their token ids end
to end and cuts the line every ``length`` ids. Only the last sequence of a
partition is not full: it is padded to the next power of two.

The partition borders are quantiles, weighted by length, of the keys of a sample of
rows whose size depends on the number of partitions only; every row is then dealt
by its key. The low bits of the key are a hash of the row's place in its input, so
a large group of copies, which shares one place on the curve, is spread over
partitions evenly, be their ids equal, null or not.

Defined cases. Null text is empty: one end id. Rows with equal ids are documents
of their own; a null id stays null. An empty table gives an empty result. Other
columns are not read by ``packed``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import SMALL_SLICE_BYTES, bytes_of, mapped, mixed, slices, span_hashes, table
from panelforge.llm.tokens import encoder

LENGTH, DIMENSIONS, DEPTH, BUCKETS, TIE_BITS = 1024, 4, 11, 1 << 14, 18
#: Rows sampled for each partition border.
SAMPLE_PER_PARTITION = 200
#: For the borders a text counts once, and once more for each so many bytes.
WEIGHT_BYTES = 2048


def projection() -> np.ndarray:
    """The fixed random matrix from word buckets to dimensions."""
    return np.random.default_rng(20).standard_normal((BUCKETS, DIMENSIONS))


#: A-Z folded; white space is that of ASCII.
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
INK = ~np.isin(np.arange(256), [*range(0x09, 0x0E), 0x20])
#: Bytes whose words are hashed at once.
STRETCH = 1 << 20


def stretches(data: np.ndarray, bounds: np.ndarray):
    """Ranges of ``data`` of about STRETCH bytes that end between texts or, in a longer text, at white space."""
    at, end = 0, int(bounds[-1])
    while at < end:
        stop = int(bounds[np.searchsorted(bounds, at + STRETCH, side="right") - 1])
        if stop <= at:
            own, size = int(bounds[np.searchsorted(bounds, at, side="right")]), STRETCH
            stop = min(own, at + size)
            while stop < own:
                white = np.flatnonzero(~INK[data[at + 1 : stop]])
                if len(white):
                    stop = at + 1 + int(white[-1])
                    break
                size *= 2
                stop = min(own, at + size)
        yield at, stop
        at = stop


def vectors(texts: pa.Array, matrix: np.ndarray) -> np.ndarray:
    """The projected hashed vector of every text, scaled to (0, 1) in each dimension."""
    data, bounds = bytes_of(texts)
    n = len(texts)
    total, n_words = np.zeros((n, DIMENSIONS)), np.zeros(n, np.int64)
    for at, stop in stretches(data, bounds):
        b = LOWER[data[at:stop]]
        first = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, stop)] - at
        edge = np.zeros(len(b) + 1, bool)  # no word goes on across the place before this byte
        edge[first] = edge[-1] = edge[0] = True
        ink = INK[b]
        starts = np.flatnonzero(ink & (edge[:-1] | ~np.append(False, ink[:-1])))
        ends = np.flatnonzero(ink & (edge[1:] | ~np.append(ink[1:], False))) + 1
        bucket = (span_hashes(b, starts, ends) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        lowest = int(np.searchsorted(bounds, at, side="right")) - 1
        highest = int(np.searchsorted(bounds, stop))
        own = np.diff(np.searchsorted(starts, bounds[lowest : highest + 1] - at))
        rows = np.repeat(np.arange(len(own)), own)
        for d in range(DIMENSIONS):
            total[lowest:highest, d] += np.bincount(rows, matrix[bucket, d], len(own))
        n_words[lowest:highest] += own
    return 0.5 + np.arctan(3 * total / np.sqrt(np.maximum(1, n_words))[:, None] ** 1.5) / np.pi


def hilbert(points: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The place on the Hilbert curve of integer points (rows) with ``depth`` bits in each dimension."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (depth - 1)
    while bit > 1:  # undo the rotations and reflections from the coarsest cells down
        low = bit - 1
        for d in range(dims):
            set_ = (x[d] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):  # Gray code
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (depth - 1)
    while bit > 1:
        flip = np.where((x[dims - 1] & bit) != 0, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> b & 1)
    return key


def keys(texts: pa.Array, places: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The sort key of every document: its place on the curve, then a hash of its place in the input."""
    cells = np.minimum((vectors(texts, matrix) * (1 << DEPTH)).astype(np.int64), (1 << DEPTH) - 1)
    return hilbert(cells) << TIE_BITS | (mixed(places) >> np.uint64(64 - TIE_BITS)).astype(np.int64)


def _keyed(borders: np.ndarray):
    def run(batches):
        matrix, place = projection(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                key = keys(part.column("text"), np.arange(place, place + part.num_rows, dtype=np.uint64), matrix)
                place += part.num_rows
                to = np.searchsorted(borders, key, side="right").astype(np.int32)
                yield part.append_column("__key", pa.array(key)).append_column("__part", pa.array(to))

    return run


def along_curve(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``docs`` with ``__key`` and ``__part``, dealt to partitions by ranges of the key and sorted along the curve."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.select(F.lit(1)).count()
    share = min(1.0, n * SAMPLE_PER_PARTITION / max(1, total))
    schema = docs.select("doc_id", "text").withColumn("__key", F.lit(0).cast("long")).withColumn("__part", F.lit(0)).schema
    sample = docs.select("doc_id", "text").sample(fraction=share, seed=20)
    weight = F.explode(F.sequence(F.lit(0), F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / WEIGHT_BYTES))).alias("__of")
    found = mapped(sample, _keyed(np.zeros(0, np.int64)), schema).select("__key", weight)
    quantiles = found.agg(F.percentile_approx("__key", [k / n for k in range(1, n)], 10_000).alias("q")).first()["q"] if n > 1 else None
    borders = np.array(quantiles or [], np.int64)
    schema = docs.withColumn("__key", F.lit(0).cast("long")).withColumn("__part", F.lit(0)).schema
    return mapped(docs, _keyed(borders), schema).repartitionById(n, "__part").sortWithinPartitions("__key", "doc_id", "text")


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _packed(length: int, path: str | None):
    def run(batches):
        enc, at, base = encoder(path), 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", SMALL_SLICE_BYTES):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text")), strict=True):
                    raw = np.append(ids, np.uint32(0)).astype("<u4")
                    n, start = len(raw), 0
                    while start < n:
                        size = min(length - at % length, n - start)
                        rows.append((doc_id, start, size, zlib.crc32(raw[start : start + size]), n, base + at // length, at % length))
                        start += size
                        at += size
                if rows:
                    names = [x.split()[0] for x in PIECES.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


def packed(docs: DataFrame, length: int = LENGTH, path: str | None = None, partitions: int | None = None) -> DataFrame:
    """One row for each piece of a document in a sequence."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(along_curve(rows, partitions).select("doc_id", "text"), _packed(length, path), PIECES, "tokens")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
