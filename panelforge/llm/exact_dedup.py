"""Exact deduplication as a stateful stream over digests, with DataFrame operations only.

A feed of (digest, id, locator) rows is streamed through an aggregation whose
keyed state lives in RocksDB on disk, checkpointed in the shared folder, and
never expires: for each digest the largest identifier, the file that holds its
content, and the number of rows. The state itself is then read as a table.
Because the state outlives a run, later feeds can be added to the same folder.

A digest met more than once is a hit: the full bytes of all its rows are
compared (least and greatest text, combined map-side). Hits are found by
broadcast, or beyond ``BROADCAST_DIGESTS`` of them by shuffle except for large
groups, so a group that holds a third of all rows moves two texts for each task. If two texts ever share a
digest, those rows are grouped by their bytes instead.

Defined cases. Null text counts as empty; empty texts form one group. A null
id is smaller than any other; a group of null ids only has keep_id null and
counts as kept. A repeated row (same id, same text) counts in group_size and
carries the same answer; ``deduplicated`` leaves one of such rows. An empty
table gives an empty result. Columns other than the two named are not read.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelforge.llm.common import joined_by_weight, shared_folder, table, whole, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State on disk; without preallocation a partition takes the room of what it holds and not megabytes of log.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # All stores of an executor share one bounded cache, and a store is closed when its task ends.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Hit digests are broadcast up to so many; beyond that the byte check joins by shuffle.
BROADCAST_DIGESTS = 100_000


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def digest_of(text_col: str) -> Column:
    return F.sha2(whole(text_col).cast("binary"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, id, locator) of every row; the locator names the file that holds the content ('' if none does)."""
    return docs.select(
        digest_of(text_col).alias("digest"),
        F.col(id_col).cast("long").alias("id"),
        F.input_file_name().alias("locator"),
    )


def stream_state(spark: SparkSession, feed_path: str, schema: T.StructType, state_path: str) -> DataFrame:
    """Runs all new files of ``feed_path`` through the keyed state; returns it: digest, keep_id, locator, n."""
    with _conf(spark, SETTINGS):
        (
            spark.readStream.schema(schema).parquet(feed_path)
            .groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("last"), F.count(F.lit(1)).alias("n"))
            .writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", state_path).trigger(availableNow=True).start().awaitTermination()
        )
        state = spark.read.format("statestore").load(state_path)
        last, n = (f.name for f in state.schema["value"].dataType.fields)
        return written(
            state.select(
                F.col("key.digest"), F.col(f"value.{last}.id").alias("keep_id"),
                F.col(f"value.{last}.locator").alias("locator"), F.col(f"value.{n}").alias("n"),
            )
        )


def _colliding(docs: DataFrame, hits: DataFrame, text_col: str) -> DataFrame:
    """Digests of ``hits`` (digest, n) under which rows differ in their bytes."""
    rows = docs.select(digest_of(text_col).alias("digest"), whole(text_col).alias("body"))
    if hits.count() <= BROADCAST_DIGESTS:
        found = rows.join(F.broadcast(hits.select("digest")), "digest", "left_semi")
    else:  # texts of large groups stay where they lie, so that each task reduces its own to two
        found = joined_by_weight(rows, hits, "digest", "n")
    return (
        found.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("greatest"))
        .filter(F.col("least") != F.col("greatest")).select("digest")
    )


def _by_bytes(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The answer for rows under colliding digests, grouped by their bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("body"), digest_of(text_col).alias("digest")).join(bad, "digest", "left_semi")
    groups = rows.groupBy("digest", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return rows.join(groups, ["digest", "body"]).select("digest", "id", "keep_id", "n")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    base = shared_folder(spark)
    feed = written(digests(docs, id_col, text_col), f"{base}/feed")
    if feed.isEmpty():
        answer = feed.select("digest", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    else:
        state = stream_state(spark, f"{base}/feed", feed.schema, f"{base}/state")
        answer = joined_by_weight(feed.select("digest", "id"), state.select("digest", "keep_id", "n"), "digest", "n", "left")
        bad = written(_colliding(docs, state.filter("n > 1").select("digest", "n"), text_col))
        if not bad.isEmpty():
            answer = answer.join(bad, "digest", "left_anti").unionByName(_by_bytes(docs, bad, id_col, text_col))
    return answer.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct text."""
    groups = exact_groups(docs, id_col, text_col)
    own = lambda c: f"__{c}_{mark}"
    mark = uuid.uuid4().hex  # no column of the table has such a name
    copies = groups.filter("group_size > 1").select(F.col("text_sha256").alias(own("d")), F.col("doc_id").alias(own("i")), F.col("kept").alias(own("k"))).distinct()
    tagged = docs.withColumn(own("digest"), digest_of(text_col)).withColumn(own("id"), F.col(id_col).cast("long"))
    joined = tagged.join(copies, (F.col(own("digest")) == F.col(own("d"))) & F.col(own("id")).eqNullSafe(F.col(own("i"))), "left")
    single = joined.filter(F.col(own("k")).isNull())
    # Only rows that stay out of a group of copies can be repeated rows: one of them is left for each text.
    one = Window.partitionBy(own("digest"), whole(text_col)).orderBy(F.lit(1))
    chosen = joined.filter(own("k")).withColumn(own("n"), F.row_number().over(one)).filter(F.col(own("n")) == 1).drop(own("n"))
    return single.unionByName(chosen).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents"""
}
