"""Streams: bars and sessions with watermarks, running averages with state, resumable append logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files of a folder; a single file is named by a pattern that fits it only."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def streaming_bars(events: DataFrame, entity: str, time: str, price: str, width: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bars of event time; a bar is out once the watermark passes its end."""
    at = F.struct(time, price)
    g = events.withWatermark(time, late).groupBy(F.window(time, width), entity)
    return g.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).alias("n")).select(entity, F.col("window.start").alias("bin"), "open", "high", "low", "close", "n")


def streaming_sessions(events: DataFrame, entity: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark(time, late).groupBy(F.session_window(time, gap), entity).agg(F.count(F.lit(1)).alias("n"))
    return g.select(entity, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def closing_event(events: DataFrame, time: str, after: str) -> DataFrame:
    """One row with nothing but a time, ``after`` the last of the table ``events``: streamed beside it, it moves the
    watermark past every real row, so that all windows and sessions come out. It belongs to no entity."""
    last = events.agg((F.max(F.col(time).cast("timestamp")) + F.expr(f"INTERVAL {after}")).alias("__t"))
    return last.select(*[F.col("__t").cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields])


#: Rows of a frame that ``streaming_average`` gives out.
FRAME = 100_000


def _averaged(entity: str, time: str, value: str, alpha: float, tie: str | None):
    """Worker: what a batch has of an entity is held as plain numbers (time, value, tie and an order, 8 bytes each) and goes
    out in frames of bounded size."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {c: [] for c in (time, value, *([tie] if tie else []))}
        for batch in batches:
            for c, own in held.items():
                own.append(batch[c].to_numpy(copy=True))
        rows = {}
        for c in list(held):
            rows[c] = np.concatenate(held.pop(c))
        if tie and rows[tie].dtype == object:  # texts: their places in order, null last
            codes = pd.factorize(rows[tie], sort=True)[0]
            rows[tie] = np.where(codes < 0, len(codes), codes)
        order = np.lexsort((rows.pop(tie), rows[time])) if tie else np.argsort(rows[time], kind="stable")
        average = state.get[0] if state.exists else None
        for a in range(0, len(order), FRAME):
            part = order[a : a + FRAME]
            values, out = rows[value][part].astype(np.float64), []
            for x in values.tolist():
                if x == x:
                    average = x if average is None else alpha * x + (1 - alpha) * average
                out.append(average)
            yield pd.DataFrame({entity: [key[0]] * len(part), time: rows[time][part], value: values, "average": np.array(out, np.float64)})
        if average is not None:
            state.update((average,))

    return run


def streaming_average(events: DataFrame, entity: str, time: str, value: str, alpha: float, tie: str | None = None) -> DataFrame:
    """(entity, time, value, average): an exponentially weighted average by entity whose last value is kept as state.
    Rows of a batch are taken in order of time, equal times in order of ``tie``. A worker holds an entity's rows of one
    batch: ``files_per_batch`` of ``read_events`` bounds it."""
    kind = events.schema[entity].dataType.simpleString()
    schema = f"{entity} {kind}, {time} timestamp, {value} double, average double"
    run = _averaged(entity, time, value, alpha, tie)
    return events.select(entity, F.col(time).cast("timestamp").alias(time), F.col(value).cast("double").alias(value), *([tie] if tie else [])).groupBy(entity).applyInPandasWithState(run, schema, "average double", "append", "NoTimeout")


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now into a Parquet table; a second call takes up where the first ended."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_errors(scored: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One-pass mse, mae, sign accuracy and balanced accuracy; works on streams and tables."""
    y, p = F.col(truth), F.col(prediction)
    up, hit = (y > 0).cast("double"), ((y > 0) == (p > 0)).cast("double")
    rate = lambda mask: F.try_divide(F.sum(hit * mask), F.nullif(F.sum(mask), F.lit(0.0)))
    return scored.groupBy().agg(F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("mse"), F.avg(F.abs(p - y)).alias("mae"), F.avg(hit).alias("sign_accuracy"), ((rate(up) + rate(1 - up)) / 2).alias("balanced_accuracy"))


def errors_by_batch(scored: DataFrame, truth: str, prediction: str, path: str, checkpoint: str) -> None:
    """Runs ``running_errors`` over what a stream has now. The sums are state of the stream; every batch writes its running row
    under its number, so a batch that is run again overwrites its own row, and a later call goes on from the state."""

    def keep(row: DataFrame, batch: int) -> None:
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    running_errors(scored, truth, prediction).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
