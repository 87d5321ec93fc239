"""Tables, scratch folders and word splitting shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a local one only where that is unset and Spark is local."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/panelforge/{uuid.uuid4().hex}"


def input_bytes(df: DataFrame) -> int:
    """The size that the planner expects ``df`` to have: of the files it reads, in proportion to the columns it takes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_by_bytes(df: DataFrame, each: int) -> int:
    """Partitions of about ``each`` bytes of the input files, but no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // each))


def moved(spark: SparkSession, old: str, new: str) -> bool:
    """Renames a folder of the shared file system, so that its files appear in the new place at once; False if there is none."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(source):
        return False
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{old} could not be moved to {new}")
    return True


@contextmanager
def session_conf(spark: SparkSession, values: dict[str, str]):
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of a batch that goes to a Python worker, at most: a worker and the JVM beside it hold little at a time.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 10_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
#: Tables that workers keep between tasks, by operator: how to empty each. A worker that turns to other work empties them.
KEPT: dict[str, Callable[[], None]] = {}
_LIBC = None


def _tidy(keep: str) -> None:
    """In a worker: gives memory back to the system, and empties the tables of other operators than ``keep``."""
    global _LIBC
    for name, empty in KEPT.items():
        if name != keep:
            empty()
    try:
        if _LIBC is None:
            _LIBC = ctypes.CDLL(None)
            _LIBC.mallopt(-3, 1 << 20)  # blocks from 1 MB have pages of their own, which go back when freed
            _LIBC.mallopt(-1, 8 << 20)  # and so does the end of the heap beyond 8 MB
            pa.set_memory_pool(pa.system_memory_pool())
        _LIBC.malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to tune
        pass


def bounded(spark: SparkSession) -> None:
    """From now on batches of the session are of BATCHES at most."""
    for k, most in BATCHES.items():
        now = spark.conf.get(k, None)
        size = int(now) if now and now.lstrip("-").isdigit() else 0
        if not 0 < size <= most:
            spark.conf.set(k, str(most))


def mapped(df: DataFrame, run, schema, keep: str = "") -> DataFrame:
    """``df.mapInArrow`` with bounded batches, in workers that give memory back before each partition."""
    bounded(df.sparkSession)

    def tidied(batches):
        _tidy(keep)
        yield from run(batches)

    return df.mapInArrow(tidied, schema)


#: Side rows that a broadcast holds at most (see ``joined_by_weight``).
HEAVY_KEYS = 50_000


def joined_by_weight(rows: DataFrame, side: DataFrame, key: str | list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with the one row of ``side`` that has the same ``key`` (how: inner or left); ``weight`` says how many of
    ``rows`` have that key. Both are tables that were written before.

    Keys with more than total / HEAVY_KEYS rows, of which there can be fewer than HEAVY_KEYS whatever the size, are
    joined by broadcast where the rows lie; the others, none of which is heavy, by shuffle."""
    total = side.agg(F.sum(weight).alias("n")).first()["n"] or 0
    least = max(1000, total // HEAVY_KEYS)
    heavy, light = side.filter(F.col(weight) > least), side.filter(F.col(weight) <= least)
    if heavy.isEmpty():
        return rows.join(side, key, how)
    few = F.broadcast(heavy)
    return rows.join(few, key).unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how))


def whole(c: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def held_out(c: str = "doc_id") -> Column:
    """True for the fold that nothing may learn from: crc32 of the id as text, mod 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0, F.lit(True))


#: Texts of one batch are worked on in slices of about so many bytes, however many rows Arrow delivers.
SLICE_BYTES = 4 << 20
#: The same where the work on a text takes several times its room, as token ids do.
SMALL_SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cuts of ``batch`` whose ``column`` holds about ``limit`` bytes each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(limit, sizes.sum() + limit, limit)) + 1)
    at = 0
    for end in [*cuts[cuts < n].tolist(), n]:
        yield batch.slice(at, end - at)
        at = end


def solid(texts: pa.Array) -> pa.Array:
    """A copy as large strings, null as the empty text, that starts at the beginning of its buffers: some Arrow kernels
    misread a slice that was cast."""
    return pc.fill_null(pc.take(texts, pa.array(np.arange(len(texts)))), "").cast(pa.large_string())


class Words:
    """Words of many texts: ``codes`` into ``vocab`` for all words in order, and ``bounds`` of each text (len + 1)."""

    def __init__(self, codes: np.ndarray, vocab: list[str], bounds: np.ndarray):
        self.codes, self.vocab, self.bounds = codes, vocab, bounds

    @property
    def rows(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def _coded(parts) -> Words:
    if pa.types.is_list(parts.type):
        parts = parts.cast(pa.large_list(parts.type.value_type))
    flat = parts.flatten().dictionary_encode()
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return Words(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist(), bounds)


def words(texts: pa.Array, lower: bool = True, split=pc.ascii_split_whitespace) -> Words:
    """Runs of characters other than ASCII white space (or what ``split`` parts); ``lower`` folds A-Z only. Null is
    the empty text."""
    texts = solid(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    parts = split(texts)
    split = _coded(parts)
    if "" in split.vocab:  # white space at either end leaves empty words
        empty = split.vocab.index("")
        keep = split.codes != empty
        lengths = np.add.reduceat(np.append(keep, 0), split.bounds[:-1]) if len(keep) else np.zeros(len(texts), int)
        lengths = np.where(np.diff(split.bounds) > 0, lengths, 0)
        return Words(split.codes[keep], split.vocab, np.concatenate([[0], np.cumsum(lengths)]))
    return split


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the UTF-8 bytes of all texts in order, where each begins and the last ends); null is the empty text."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = solid(texts).buffers()
    bounds = np.frombuffer(bounds, np.int64)[: len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if bounds[-1] else np.zeros(0, np.uint8))[: bounds[-1]], bounds


#: An odd factor, its inverse modulo 2 ** 64, and the powers of both as far as they were asked for.
_FACTOR = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial in the factor, as a difference of running sums."""
    if len(b) > len(_POWERS[0]):
        n = 1 << int(len(b) - 1).bit_length()
        for k, f in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n - 1, f, np.uint64)))
    sums = np.append(np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(b)]))
    return mixed((sums[ends] - sums[starts]) * _POWERS[1][starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit over the word (xor-shift and multiply steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
