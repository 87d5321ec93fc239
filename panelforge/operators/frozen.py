"""A column's value counts frozen as a table of ranges: ranks of later rows, batch or stream, without the column itself.

The table has, for each group, the lower edges of its ranges (one row a group) and the
ranges: the count of rows below, and the distinct values with their counts. A lookup
finds the range by the edges, joins it, and searches within it, both by halving. A range holds ``each``
rows or more only if they share a value; a group has ``MOST_RANGES`` ranges at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.ranks import counted, with_below
from panelforge.sources.scratch import written

MOST_RANGES = 10_000


def frozen_counts(train: DataFrame, value: str, by: Sequence[str] = (), each: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(edges: by, lows, numbers, total; ranges: by, number, below, values) of the rows that have a value; both written."""
    keys = [f"__k{i}" for i in range(len(by))]
    renamed = train.select(F.col(value).cast("double").alias("__v"), *[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)])
    counts = with_below(counted(renamed, "__v", keys), "__v", keys)
    each = max(each, -(-train.count() // MOST_RANGES))
    cells = counts.withColumn("__number", F.floor(F.col("below") / each))
    ranges = written(cells.groupBy(*keys, "__number").agg(F.min("below").alias("__below"), F.array_sort(F.collect_list(F.struct(F.col("__v").alias("v"), F.col("below"), F.col("c")))).alias("__values")))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("__values")[0]["v"].alias("low"), F.col("__number").alias("number"))))
    last = F.max(F.element_at("__values", -1)["below"] + F.element_at("__values", -1)["c"])
    edges = ranges.groupBy(*keys).agg(pairs.alias("p"), last.alias("__total"))
    return written(edges.select(*keys, F.transform("p", lambda x: x["low"]).alias("__lows"), F.transform("p", lambda x: x["number"]).alias("__numbers"), "__total")), ranges


def _before(values: Column, earlier) -> Column:
    """How many elements of a sorted array are ``earlier`` (a condition that holds up to some place), by halving; null for null."""
    steps, bits = F.array(*[F.lit(1 << b) for b in range(30, -1, -1)]), F.length(F.bin(F.size(values)))
    passes = lambda at: F.coalesce(earlier(F.get(values, at - 1)), F.lit(False))
    return F.aggregate(F.slice(steps, 32 - bits, bits), F.lit(0), lambda at, step: F.when(passes(at + step), at + step).otherwise(at))


def placed(df: DataFrame, frozen: tuple[DataFrame, DataFrame], value: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` (table or stream) with ``below``, ``same`` and ``total``: frozen rows of its group smaller than, equal to its value,
    and in all. Null for a null value, or where the group has none."""
    edges, ranges = frozen
    keys = [f"__k{i}" for i in range(len(by))]
    v = F.col(value).cast("double")
    left = df.withColumns({k: F.col(b) for b, k in zip(by, keys, strict=True)} | {"__one": F.lit(1)})
    out = left.join(edges.withColumn("__one", F.lit(1)), ["__one", *keys], "left").drop("__one")
    out = out.withColumn("__number", F.get("__numbers", _before(F.col("__lows"), lambda low: low <= v) - 1)).drop("__lows", "__numbers")
    out = out.join(ranges, [*keys, "__number"], "left")
    out = out.withColumn("__at", _before(F.col("__values"), lambda x: x["v"] < v))
    last, here = F.get("__values", F.col("__at") - 1), F.get("__values", F.col("__at"))
    passed = F.coalesce(last["below"] + last["c"], "__below")
    same = F.when(here["v"] == v, here["c"])
    known = v.isNotNull() & F.col("__total").isNotNull()
    return out.select(*df.columns, F.when(known, F.coalesce(passed, F.lit(0))).alias("below"), F.when(known, F.coalesce(same, F.lit(0))).alias("same"), F.col("__total").alias("total"))


def fitted_ranks(df: DataFrame, is_train, value: str, by: Sequence[str] = (), new: str = "rank") -> DataFrame:
    """Ranks in 0..1 by a map fitted on the rows where ``is_train``: (average rank - 0.5) / n for these, (rows below + 0.5) / n
    for the others."""
    found = placed(df.withColumn("__train", is_train), frozen_counts(df.filter(is_train), value, by), value, by)
    middle = F.when(F.col("__train"), F.col("same") / 2).otherwise(F.lit(0.5))
    return found.withColumn(new, F.try_divide(F.col("below") + middle, F.col("total"))).drop("__train", "below", "same", "total")
