"""As-of, interval and history joins without theta joins.

``as_of`` sorts the union of both sides by key and time and carries the nearest
row across, one shuffle for each side; ``as_of_by_slices`` does so by slices of time, for keys with
a large share of the rows. ``within`` turns an interval condition into
an equi-join on time buckets. ``history`` needs one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp, with or without zone, read as UTC wall time if without."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], direction: str = "backward", strict: bool = False, tolerance: int | None = None, tie: list[str] | None = None) -> DataFrame:
    """``left`` with ``values`` of the nearest row of ``right`` at or before (backward) or at or after (forward) its
    time. ``strict`` leaves out equal times; ``tolerance`` is the largest distance in microseconds; of right rows at
    one time the last (backward) or first (forward) in order of ``tie`` counts."""
    back = direction == "backward"
    packed = F.struct(micros(right_time).alias("__at"), *values)
    tied = F.struct(*tie) if tie else F.lit(0)
    one = right.filter(F.col(right_time).isNotNull()).groupBy(key, right_time).agg((F.max_by if back else F.min_by)(packed, tied).alias("__v"))
    row = F.struct(*[F.col(c) for c in left.columns])
    # At one time, the side that must not see the other comes first (backward) or last (forward).
    left_rank = 0 if strict == back else 1
    a = left.select(F.col(key).alias("__k"), micros(left_time).alias("__t"), F.lit(left_rank).alias("__o"), row.alias("__row"), F.lit(None).cast(one.schema["__v"].dataType).alias("__v"))
    b = one.select(F.col(key).alias("__k"), micros(right_time).alias("__t"), F.lit(1 - left_rank).alias("__o"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), "__v")
    w = Window.partitionBy("__k").orderBy("__t", "__o")
    near = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if back else F.first("__v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = a.unionByName(b).withColumn("__near", near).filter(F.col("__row").isNotNull())
    if tolerance is not None:
        out = out.withColumn("__near", F.when(F.abs(F.col("__t") - F.col("__near.__at")) <= tolerance, F.col("__near")))
    return out.select("__row.*", *[F.col(f"__near.{v}").alias(v) for v in values])


def as_of_by_slices(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], width: int, strict: bool = False, tolerance: int | None = None, tie: list[str] | None = None) -> DataFrame:
    """``as_of`` backward, where no task needs all rows of a key: time is cut into slices of ``width`` microseconds, and
    what holds at the start of a slice is carried over from the last rows of the slices before it.

    Two windows: one over the slices of a key (a row each, combined map-side, so no more than the time span over
    ``width``), one over the rows of a key within a slice. Null keys and times match nothing; repeated rows of ``left``
    stay; an empty ``right`` gives nulls."""
    slice_of = F.floor(F.col("__t") / F.lit(width)).cast("long")
    packed = F.struct(micros(right_time).alias("__at"), *values)
    known = right.filter(F.col(right_time).isNotNull() & F.col(key).isNotNull())
    one = known.groupBy(key, right_time).agg(F.max_by(packed, F.struct(*tie) if tie else F.lit(0)).alias("__v"))
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    a = left.select(F.col(key).alias("__k"), micros(left_time).alias("__t"), F.lit(0 if strict else 1).alias("__o"), row.alias("__row"), F.lit(None).cast(one.schema["__v"].dataType).alias("__v"))
    b = one.select(F.col(key).alias("__k"), micros(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__o"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), "__v")
    a, b = (side.withColumn("__slice", slice_of) for side in (a, b))
    ends = b.select("__k", "__slice", "__t", "__v").unionByName(a.select("__k", "__slice", F.lit(None).cast("long").alias("__t"), "__v"))
    ends = ends.filter(F.col("__k").isNotNull() & F.col("__slice").isNotNull()).groupBy("__k", "__slice").agg(F.max_by("__v", "__t").alias("__v"))
    before = Window.partitionBy("__k").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    start = ends.select("__k", "__slice", (F.col("__slice") * width).alias("__t"), F.lit(-1).alias("__o"), F.last("__v", ignorenulls=True).over(before).alias("__v"))
    w = Window.partitionBy("__k", "__slice").orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).unionByName(start, allowMissingColumns=True).withColumn("__near", F.last("__v", ignorenulls=True).over(w)).filter("__row IS NOT NULL")
    if tolerance is not None:
        out = out.withColumn("__near", F.when(F.col("__t") - F.col("__near.__at") <= tolerance, F.col("__near")))
    return out.select("__row.*", *[F.col(f"__near.{v}").alias(v) for v in values])


def at_position(left: DataFrame, grid: DataFrame, key: str, left_time: str, grid_time: str, values: list[str], offset: int = 0, strict: bool = False) -> DataFrame:
    """``values`` of the grid row ``offset`` positions after the first one at or after (strictly after) each time."""
    w = Window.partitionBy(key).orderBy(grid_time)
    moved = grid.select(key, grid_time, *[F.lead(v, offset).over(w).alias(v) if offset else F.col(v) for v in values])
    return as_of(left, moved, key, left_time, grid_time, values, "forward", strict)


def within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, start: int, end: int, open_start: bool = False, open_end: bool = False, how: str = "inner") -> DataFrame:
    """Pairs with right time - left time in [start, end] microseconds (ends open if asked). The columns of the two
    sides must differ but for ``key``."""
    width = max(1, end - start)
    t = micros(left_time)
    bucket = lambda x: F.floor(x / width).cast("long")
    a = left.withColumn("__lt", t).withColumn("__b", F.explode(F.sequence(bucket(t + start), bucket(t + end))))
    b = right.withColumn("__rt", micros(right_time)).withColumn("__b", bucket(micros(right_time)))
    gap = F.col("__rt") - F.col("__lt")
    low, high = (gap > start) if open_start else (gap >= start), (gap < end) if open_end else (gap <= end)
    found = a.join(b, [key, "__b"]).filter(low & high).drop("__b", "__lt", "__rt")
    if how == "inner":
        return found
    return left.join(found, [*left.columns], "left")


def latest(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


def history(df: DataFrame, by: list[str], order: list[str], value: str, k: int, new: str = "history") -> DataFrame:
    """Adds the values of the ``k`` rows before, oldest first."""
    return df.withColumn(new, F.collect_list(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-k, -1)))


def oldest_before(df: DataFrame, key: str, time: str, order: list[str], k: int) -> DataFrame:
    """(row, earlier) pairs: each row with the ``k`` oldest rows of its key strictly before it. Only the k oldest of a
    key can ever qualify, so the join is with k rows a key."""
    first = latest(df, [key], [F.col(c) for c in order], k).select(F.col(key).alias("__k"), F.struct(*df.columns).alias("earlier"))
    return df.join(first, df[key] == F.col("__k")).filter(F.col(f"earlier.{time}") < F.col(time)).drop("__k")


def previous(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds previous_<column> of the row before in each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})


def unprocessed(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the log of what is done."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def rounded_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, digits: int = 6, how: str = "inner") -> DataFrame:
    """Rows whose values agree to ``digits`` decimals: an equi-join on scaled integers, as floats have no equality to
    rely on. Null values match nothing."""
    scaled = lambda c: F.round(F.col(c) * 10**digits).cast("long")
    a, b = left.withColumn("__k", scaled(left_value)), right.withColumn("__r", scaled(right_value))
    return a.join(b, F.col("__k") == F.col("__r"), how).drop("__k", "__r")
