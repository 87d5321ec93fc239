"""First-seen line stripping: repeated lines go from the batches that come after those that brought them in.

Documents come in numbered batches. A line's key is the line without the ASCII
white space at its ends, with A-Z lower-cased. A line goes if its key has
``LEAST_CHARS`` code points and ``SEEN`` documents of all earlier batches, or
more, held that key before anything was removed.

The batches are written to the shared folder and fed in order to one streaming
query on one checkpoint, started anew for each. It combines the keys of a part
(the rows that one task wrote for one batch) before the shuffle, so a line that a
third of all documents hold is one entry a part. ``transformWithState`` keeps for
every key a committed count, a pending count and the number of the batch that the
pending count belongs to. Pending folds into committed only when a later batch
arrives (lazily, when its key is next met), so a batch may take any number of
triggers: within it the answer is given by committed alone. A call into the state
costs about a millisecond, so the counters of some thousand digests (a bucket, by the
digest's first bits) lie in one value of the state; the number of buckets grows with the
input. Entries are answered as they pass, so no group is held.

The stream's output is an exactly-once file sink: for each part the digests that
go, and for each bucket and trigger the totals of the keys that lost lines. A key that
has lost lines loses lines in every later batch that holds it, so its last
total counts all documents. Then every part is joined with its answers and the
lines are taken out, a part of some MB at a time.

Defined cases. A null or empty text is one empty line. Trailing empty lines count. A
null id falls in batch 0 and its row_id is null. Rows with equal ids are documents
of their own. An empty table, or an empty batch, gives no document rows and starts no
trigger. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from panelforge.llm.common import bounded, input_bytes, mapped, moved, session_conf, shared_folder, slices, solid, table
from panelforge.llm.exact_dedup import SETTINGS

BATCHES, LEAST_CHARS, SEEN = 10, 20, 2
#: One bucket of counters for so many bytes of the input files.
BUCKET_BYTES = 256 << 10
WHITE = " \t\n\x0b\x0c\r"
ENTRY = "bucket bigint, part bigint, batch int, digests binary, docs binary, lines binary"
ANSWER = "part bigint, batch int, digests binary, docs binary, lines binary"


def batch_of(id_col: str = "doc_id", batches: int = BATCHES) -> Column:
    """floor(batches * (crc32(decimal id) mod 64) / 64); a null id is in batch 0."""
    return F.coalesce(F.floor(batches * (F.crc32(F.col(id_col).cast("string").cast("binary")) % 64) / 64), F.lit(0)).cast("int")


class Lines:
    """The lines of many texts, and the digests of their keys: ``codes`` into ``digests`` for each line, -1 for a short key."""

    def __init__(self, texts: pa.Array, least_chars: int):
        parts = pc.split_pattern(solid(texts), "\n")
        self.flat = parts.flatten()
        self.bounds = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        keys = pc.ascii_lower(pc.ascii_trim(self.flat, WHITE))
        long = pc.greater_equal(pc.utf8_length(keys), least_chars).to_numpy(zero_copy_only=False)
        coded = keys.filter(pa.array(long)).dictionary_encode()
        self.codes = np.full(len(self.flat), -1, np.int64)
        self.codes[long] = coded.indices.to_numpy(zero_copy_only=False)
        self.digests = [hashlib.sha256(k.encode()).digest() for k in coded.dictionary.to_pylist()]


def _counted(least_chars: int, buckets: int):
    """Worker: the keys of each part with the documents and lines that hold them, packed by bucket."""

    def run(batches):
        totals: dict[int, dict[bytes, list[int]]] = {}

        def packed():
            for part, own in totals.items():
                dealt: dict[int, list] = {}
                for digest, (docs, lines) in own.items():
                    dealt.setdefault(int.from_bytes(digest[:6], "big") % buckets, []).append((digest, docs, lines))
                for bucket, rows in dealt.items():
                    digests, docs, lines = zip(*rows, strict=True)
                    yield bucket, part, b"".join(digests), np.array(docs, "<i8").tobytes(), np.array(lines, "<i8").tobytes()

        def emit():
            rows = list(packed())
            totals.clear()
            for i in range(0, len(rows), 10_000):
                b, p, d, n, m = zip(*rows[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(b, pa.int64()), "part": pa.array(p, pa.int64()), "batch": pa.array([x % BATCHES_LIMIT for x in p], pa.int32()), "digests": pa.array(d, pa.binary()), "docs": pa.array(n, pa.binary()), "lines": pa.array(m, pa.binary())})

        for batch in batches:
            for cut in slices(batch, "text"):
                got = Lines(cut.column("text"), least_chars)
                row_of = np.repeat(np.arange(cut.num_rows), np.diff(got.bounds))
                some = got.codes >= 0
                part = cut.column("part").to_numpy()[row_of[some]]
                codes, rows = got.codes[some], row_of[some]
                held, times = np.unique(np.stack([part, codes, rows]), axis=1, return_counts=True)  # once a document
                for p, c, n in zip(held[0].tolist(), held[1].tolist(), times.tolist(), strict=True):
                    count = totals.setdefault(p, {}).setdefault(got.digests[c], [0, 0])
                    count[0] += 1
                    count[1] += n
                if sum(map(len, totals.values())) > 200_000:
                    yield from emit()
        yield from emit()

    return run


#: A part's number is (writing task) * BATCHES_LIMIT + batch.
BATCHES_LIMIT = 1000


class Counters(StatefulProcessor):
    """Committed and pending document counts of a bucket's keys, tagged by batch."""

    def __init__(self, seen: int):
        self.seen = seen

    def init(self, handle) -> None:
        self.state = handle.getValueState("counters", "digests binary, committed binary, pending binary, tags binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.state.get() or (b"", b"", b"", b"")
        digests = [bytes(old[0][i : i + 32]) for i in range(0, len(old[0]), 32)]
        place = {d: i for i, d in enumerate(digests)}
        committed, pending, tags = (np.frombuffer(old[k], t).tolist() for k, t in ((1, "<i8"), (2, "<i8"), (3, "<i4")))
        lost: dict[tuple[int, bytes], int] = {}
        for row in rows:
            batch, go = row["batch"], []
            raw = bytes(row["digests"])
            for k, docs, lines in zip(range(0, len(raw), 32), np.frombuffer(row["docs"], "<i8").tolist(), np.frombuffer(row["lines"], "<i8").tolist(), strict=True):
                digest = raw[k : k + 32]
                i = place.get(digest)
                if i is None:
                    i = place[digest] = len(digests)
                    digests.append(digest)
                    committed.append(0)
                    pending.append(0)
                    tags.append(batch)
                elif batch > tags[i]:  # a later batch: what was pending is now of earlier ones
                    committed[i] += pending[i]
                    pending[i], tags[i] = 0, batch
                if committed[i] >= self.seen:
                    go.append(digest)
                    lost[batch, digest] = lost.get((batch, digest), 0) + lines
                pending[i] += docs
            if go:
                yield Row(part=row["part"], batch=batch, digests=b"".join(go), docs=None, lines=None)
        self.state.update((b"".join(digests), np.array(committed, "<i8").tobytes(), np.array(pending, "<i8").tobytes(), np.array(tags, "<i4").tobytes()))
        for batch in sorted({b for b, _ in lost}):
            own = [(d, n) for (b, d), n in lost.items() if b == batch]
            totals = [committed[place[d]] + pending[place[d]] for d, _ in own]
            yield Row(part=-1, batch=batch, digests=b"".join(d for d, _ in own), docs=np.array(totals, "<i8").tobytes(), lines=np.array([n for _, n in own], "<i8").tobytes())

    def close(self) -> None:
        pass


def _lost_keys(batches):
    """Worker: one row for each key, batch and trigger of the totals."""
    for batch in batches:
        for b, digests, docs, lines in zip(*(batch.column(c).to_pylist() for c in ("batch", "digests", "docs", "lines")), strict=True):
            keys = [digests[i : i + 32].hex() for i in range(0, len(digests), 32)]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "batch": pa.array([b] * len(keys), pa.int32()), "docs": pa.array(np.frombuffer(docs, "<i8")), "lines": pa.array(np.frombuffer(lines, "<i8"))})


DOC_SCHEMA = "doc_id bigint, batch int, n_all bigint, n_removed bigint, kept string"


def _kept(least_chars: int):
    """Worker: the documents of a part without the lines whose keys' digests are in its answers."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        gone = {bytes(d[i : i + 32]) for d in answers.column("digests").to_pylist() for i in range(0, len(d), 32)}
        out = []
        for whole in docs.to_batches():
            for cut in slices(whole, "text"):
                got = Lines(cut.column("text"), least_chars)
                hit = np.array([d in gone for d in got.digests] + [False])  # -1 is the last
                stays = ~hit[got.codes]
                before = np.concatenate([[0], np.cumsum(stays)])
                ends = before[got.bounds]
                kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), got.flat.filter(pa.array(stays)).cast(pa.string()))
                out.append(
                    pa.RecordBatch.from_pydict(
                        {
                            "doc_id": cut.column("doc_id"),
                            "batch": pc.cast(cut.column("batch"), pa.int32()),
                            "n_all": pa.array(np.diff(got.bounds)),
                            "n_removed": pa.array(np.diff(got.bounds) - np.diff(ends)),
                            "kept": pc.binary_join(kept, "\n"),
                        }
                    )
                )
        return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("batch", pa.int32()), ("n_all", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return run


def stripped(docs: DataFrame, batches: int = BATCHES, least_chars: int = LEAST_CHARS, seen: int = SEEN, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, batch, n_all, n_removed, kept for every row; key, batch, n_all, n_removed for every key that lost lines)."""
    if not 0 < batches <= BATCHES_LIMIT:
        raise ValueError(f"batches: 1 to {BATCHES_LIMIT}")
    spark, base = docs.sparkSession, shared_folder(docs.sparkSession)
    bounded(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = max(16, input_bytes(rows) // BUCKET_BYTES)
    rows = rows.withColumn("batch", batch_of("doc_id", batches))
    rows.withColumn("part", F.spark_partition_id().cast("long") * BATCHES_LIMIT + F.col("batch")).write.partitionBy("batch").parquet(f"{base}/written")
    schema = "doc_id bigint, text string, part bigint, batch int"
    answers = spark.createDataFrame([], ANSWER)
    fed = False
    with session_conf(spark, SETTINGS):
        for b in range(batches):
            if not moved(spark, f"{base}/written/batch={b}", f"{base}/feed/batch={b}"):
                continue  # an empty batch
            fed = True
            feed = spark.readStream.schema(schema).parquet(f"{base}/feed").select("part", "text")
            entries = mapped(feed, _counted(least_chars, buckets), ENTRY)
            (
                entries.groupBy("bucket").transformWithState(Counters(seen), ANSWER, "Append", "None")
                .writeStream.format("parquet").option("path", f"{base}/answers").option("checkpointLocation", f"{base}/state")
                .trigger(availableNow=True).start().awaitTermination()
            )
    if fed:
        answers = spark.read.schema(ANSWER).parquet(f"{base}/answers")
        rows = spark.read.schema(schema).parquet(f"{base}/feed")
    else:
        rows = spark.createDataFrame([], schema)
    kept = rows.groupBy("part").cogroup(answers.filter("part >= 0").select("part", "digests").groupBy("part")).applyInArrow(_kept(least_chars), DOC_SCHEMA)
    keys = mapped(answers.filter("part < 0").select("batch", "digests", "docs", "lines"), _lost_keys, "key string, batch int, docs bigint, lines bigint")
    lost = keys.groupBy("key").agg(F.min("batch").alias("batch"), F.max("docs").alias("n_all"), F.sum("lines").alias("n_removed"))
    return kept, lost


def op12_line_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, lost = stripped(table(spark, sf_dir, "documents"))
    return kept.select(
        F.lit("doc").alias("row_kind"), F.col("doc_id").cast("string").alias("row_id"), "batch", "n_all", "n_removed",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    ).unionByName(lost.select(F.lit("line").alias("row_kind"), F.col("key").alias("row_id"), "batch", "n_all", "n_removed", F.lit(None).cast("string").alias("kept_sha256")))


QUERIES = {"op12_line_strip": op12_line_strip}
#: crc32 is no function of the SQL engine: the tests hold the query against a brute-force version.
ORACLES: dict[str, str] = {}
