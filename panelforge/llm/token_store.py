"""Token ids in a binary format of patched frame-of-reference blocks.

The ids of all documents, each closed by an end id, form one stream in ascending
order of doc_id. Documents are range-partitioned by id; every partition writes
shards, each a self-contained byte string (a row of a Parquet table in the shared
folder, so commits, retries and any file system are Spark's business):

    magic "PFB2", then uint32: documents, ids, block length, blocks, null doc ids (they stand first)
    int64 doc ids, uint32 ids of each document
    uint32 byte position of each block's start (one more for the end)
    blocks: uint32 minimum, uint8 width, uint16 exceptions; width bit planes
    (bit k of every value less the minimum, packed); the exceptions' uint16
    places and uint32 values

The width of a block is the percentile of its values' bit lengths, 90 or above,
with the smallest encoding; values that do not fit are exceptions. The position of
a shard in the whole stream is the sum of the partitions before it (a list as
long as the partitions) plus its place in its own.

Defined cases. Null text is empty and has the end id only. A null doc_id sorts
first. Rows with equal ids are documents of their own, in order of their text. An
empty table gives no shards and an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import SMALL_SLICE_BYTES, mapped, shared_folder, slices, table
from panelforge.llm.tokens import encoder

MAGIC, BLOCK, SHARD_IDS, END = b"PFB2", 1024, 1 << 18, 0
LEAST_SHARE = 0.9


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.frexp(x.astype(np.float64))[1], 0)


def encode_blocks(ids: np.ndarray, size: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """(the blocks of ``ids``, byte position of each block's start and the last one's end)."""
    n = len(ids)
    count = -(-n // size)
    if not count:
        return b"", np.zeros(1, np.uint32)
    full = np.concatenate([ids, np.full(count * size - n, ids[-1], np.uint32)]).reshape(count, size)
    least = full.min(axis=1)
    rest = full - least[:, None]
    lengths = _bit_lengths(rest)
    over = size - np.cumsum(np.bincount((lengths + np.arange(count)[:, None] * 33).ravel(), minlength=count * 33).reshape(count, 33), axis=1)
    cost = np.arange(33) * (size // 8) + 6 * over
    width = np.where(over <= (1 - LEAST_SHARE) * size, cost, 1 << 60).argmin(axis=1)
    body: list[bytes] = [b""] * count
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        part = rest[which]
        planes = np.stack([np.packbits(((part >> np.uint32(k)) & np.uint32(1)).astype(np.uint8), axis=1) for k in range(w)], axis=1) if w else np.zeros((len(which), 0, 0), np.uint8)
        large = lengths[which] > w
        for i, b in enumerate(which):
            places = np.flatnonzero(large[i])
            body[b] = b"".join((struct.pack("<IBH", int(least[b]), int(w), len(places)), planes[i].tobytes(), places.astype("<u2").tobytes(), part[i][places].astype("<u4").tobytes()))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in body])]).astype(np.uint32)
    return b"".join(body), starts


def decode_blocks(body: bytes, starts: np.ndarray, n: int, size: int = BLOCK) -> np.ndarray:
    """The ``n`` ids that ``encode_blocks`` was given."""
    count = len(starts) - 1
    out = np.zeros((count, size), np.uint32)
    raw = np.frombuffer(body, np.uint8)
    heads = [struct.unpack_from("<IBH", body, int(s)) for s in starts[:-1]]
    width = np.array([h[1] for h in heads], int)
    plane = size // 8
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        if w:
            packed = np.stack([raw[int(starts[b]) + 7 : int(starts[b]) + 7 + w * plane] for b in which]).reshape(len(which), w, plane)
            for k in range(w):
                out[which] |= np.unpackbits(packed[:, k], axis=1).astype(np.uint32) << np.uint32(k)
    for b, (least, w, exceptions) in enumerate(heads):
        if exceptions:
            at = int(starts[b]) + 7 + w * plane
            places = np.frombuffer(body, "<u2", exceptions, at)
            out[b, places] = np.frombuffer(body, "<u4", exceptions, at + 2 * exceptions)
        out[b] += np.uint32(least)
    return out.ravel()[:n]


def decode_block(shard: bytes, block: int) -> np.ndarray:
    """One block of a shard by its index, without reading the others."""
    docs, n, size, count, _ = struct.unpack_from("<5I", shard, 4)
    at = 24 + 12 * docs
    a, b = struct.unpack_from("<2I", shard, at + 4 * block)
    body = shard[at + 4 * (count + 1) :][a:b]
    return decode_blocks(body, np.array([0, b - a]), min(size, n - block * size), size)


def pack_shard(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """The bytes of a shard; null ids stand first."""
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    body, starts = encode_blocks(ids)
    nulls = sum(d is None for d in doc_ids)
    head = MAGIC + struct.pack("<5I", len(doc_ids), len(ids), BLOCK, len(starts) - 1, nulls)
    return b"".join((head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(d) for d in documents], "<u4").tobytes(), starts.astype("<u4").tobytes(), body))


def unpack_shard(shard: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """(doc ids, ids of each document) of a shard."""
    if shard[:4] != MAGIC:
        raise ValueError("not a shard of token ids")
    docs, n, size, count, nulls = struct.unpack_from("<5I", shard, 4)
    doc_ids = [None] * nulls + np.frombuffer(shard, "<i8", docs, 24).tolist()[nulls:]
    lengths = np.frombuffer(shard, "<u4", docs, 24 + 8 * docs)
    at = 24 + 12 * docs
    starts = np.frombuffer(shard, "<u4", count + 1, at)
    ids = decode_blocks(shard[at + 4 * (count + 1) :], starts, n, size)
    return doc_ids, np.split(ids, np.cumsum(lengths)[:-1]) if docs else []


def _shards(path: str | None):
    def run(batches):
        enc, part = encoder(path), TaskContext.get().partitionId()
        shard, first, size, doc_ids, documents = 0, 0, 0, [], []

        def row():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "first": pa.array([first], pa.int64()), "n_ids": pa.array([size], pa.int64()), "payload": pa.array([pack_shard(doc_ids, documents)], pa.binary())})

        for batch in batches:
            for cut in slices(batch, "text", SMALL_SLICE_BYTES):
                for doc_id, ids in zip(cut.column("doc_id").to_pylist(), enc.encode(cut.column("text")), strict=True):
                    doc_ids.append(doc_id)
                    documents.append(np.append(ids, np.uint32(END)))
                    size += len(ids) + 1
                    if size >= SHARD_IDS:
                        yield row()
                        shard, first, size, doc_ids, documents = shard + 1, first + size, 0, [], []
        if documents:
            yield row()

    return run


SHARD_SCHEMA = "part int, shard int, first bigint, n_ids bigint, payload binary"


def write_shards(docs: DataFrame, folder: str, path: str | None = None, partitions: int | None = None) -> None:
    """Writes the ids of ``docs`` (doc_id, text) in ascending doc_id order; one shuffle, by range of the id."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    mapped(ordered, _shards(path), SHARD_SCHEMA, "tokens").write.mode("overwrite").option("compression", "none").parquet(folder)


def _documents(batches):
    for batch in batches:
        for part, first, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "payload")), strict=True):
            doc_ids, documents = unpack_shard(payload)
            lengths = np.array([len(d) for d in documents], np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "part": pa.array([part] * len(documents), pa.int32()),
                    "start": pa.array(first + np.cumsum(lengths) - lengths),
                    "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in documents], pa.int64()),
                }
            )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    sizes = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1))]).tolist()
    found = mapped(shards, _documents, "doc_id bigint, part int, start bigint, n_tokens bigint, ids_crc32 bigint")
    base = F.element_at(F.from_json(F.lit(json.dumps(before)), "array<bigint>"), F.col("part") + 1)
    return found.select("doc_id", (F.col("start") + base).alias("start"), "n_tokens", "ids_crc32")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_shards(table(spark, sf_dir, "documents"), folder)
    return read_documents(spark, folder)


QUERIES = {"op9_token_store": op9_token_store}
ORACLES: dict[str, str] = {}
