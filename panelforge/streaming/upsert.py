"""An upsert log: the latest row of each key as state of a stream, every change committed with the offset it came from.

Rows are cut to the latest of each key in a worker before the shuffle, so that a key with
very many rows sends one a batch of them. The state holds version and row of each key;
a row that is not newer changes nothing. Changes go to an exactly-once file sink: its log and
the checkpoint name the same batch, so a run that stops between batches takes up where it ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from panelforge.sources.scratch import session_conf

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
ENTRY = "key string, version bigint, tie bigint, payload string"
CHANGE = "key string, version bigint, tie bigint, payload string, replaced boolean"


class Latest(StatefulProcessor):
    """Keeps the row of the greatest (version, tie) of a key and tells of every replacement."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("latest", "version bigint, tie bigint, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.state.get()
        new = max(((r["version"], r["tie"], r["payload"]) for r in rows), key=lambda r: r[:2])
        if old is None or new[:2] > (old[0], old[1]):
            self.state.update(new)
            yield Row(key=key[0], version=new[0], tie=new[1], payload=new[2], replaced=old is not None)

    def close(self) -> None:
        pass


def _latest_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.sort_values(["version", "tie"]).groupby("key", sort=False).tail(1)


def upsert(rows: DataFrame, key: str, version, tie, path: str, checkpoint: str) -> None:
    """Runs all new rows of a stream into the log at ``path``. ``version`` and ``tie`` (long columns) order the rows of a key;
    rows without a key or version are left out."""
    entries = rows.select(F.col(key).cast("string").alias("key"), version.cast("long").alias("version"), F.coalesce(tie.cast("long"), F.lit(0)).alias("tie"), F.to_json(F.struct(*rows.columns)).alias("payload"))
    entries = entries.filter("key IS NOT NULL AND version IS NOT NULL").mapInPandas(_latest_of, ENTRY)
    with session_conf(rows.sparkSession, ROCKSDB):
        (
            entries.groupBy("key").transformWithState(Latest(), CHANGE, "Append", "None")
            .writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        )


def current(log: DataFrame, schema: str) -> DataFrame:
    """The log as a table: the latest payload of each key, by ``schema``."""
    last = log.groupBy("key").agg(F.max_by("payload", F.struct("version", "tie")).alias("payload"))
    return last.select(F.from_json("payload", schema).alias("r")).select("r.*")


def pending(items: DataFrame, key: str, log: DataFrame) -> DataFrame:
    """The items whose key the log does not have yet: what a run that takes up again still has to do."""
    return items.join(log.select(F.col("key").alias("__done")).distinct(), F.col(key).cast("string") == F.col("__done"), "left_anti")
