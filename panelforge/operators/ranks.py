"""Exact ranks and quantiles of whole tables: counts by value, dealt to ranges of the value, so that no task holds them all."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelforge.sources.scratch import written

#: Ranges of the value that the counts are dealt to, and how many of them a step of the search for one spans.
RANGES, STEP = 200, 14


def counted(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, c) of the rows that have a value."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))


def with_below(counts: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``below``: the sum of c over the smaller values (of the same group). A range's values are summed up in one
    task; what lies in lower ranges is added from the ranges' totals, which are few."""
    edges = counts.agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 5000).alias("__edges"))
    # Lambdas are interpreted, so an edge is looked for among every STEP-th one and then among the STEP after it.
    edges = edges.withColumn("__steps", F.transform(F.sequence(F.lit(STEP), F.lit(RANGES - 1), F.lit(STEP)), lambda i: F.element_at("__edges", i)))
    lower_than = lambda held: F.size(F.filter(held, lambda e: e < F.col(value)))
    dealt = counts.crossJoin(F.broadcast(edges)).withColumn("__step", lower_than("__steps") * STEP)
    dealt = dealt.withColumn("__range", F.col("__step") + lower_than(F.slice("__edges", F.col("__step") + 1, STEP))).drop("__edges", "__steps", "__step")
    totals = dealt.groupBy(*by, "__range").agg(F.sum("c").alias("__total"))
    lower = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "__range", F.coalesce(F.sum("__total").over(lower), F.lit(0)).alias("__lower"))
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(totals, [*by, "__range"]).withColumn("below", F.col("__lower") + F.coalesce(F.sum("c").over(inside), F.lit(0)))
    return out.drop("__range", "__lower")


def average_ranks(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, rank): the average rank of every value."""
    ranked = with_below(counted(rows, value, by), value, by)
    return ranked.select(*by, value, (F.col("below") + (F.col("c") + 1) / 2).alias("rank"))


def quantiles(rows: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """One row: ``edges``, the linear quantiles of a column at ``shares``; null elements for an empty column."""
    counts = counted(rows, value)
    n = counts.agg(F.sum("c").alias("n"))
    placed = with_below(counts, value).crossJoin(F.broadcast(n))  # one row
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("c")), F.col(value)))
    place = [(F.col("n") - 1) * F.lit(float(p)) for p in shares]
    found = [x for i, h in enumerate(place) for x in (at(F.floor(h)).alias(f"a{i}"), at(F.ceil(h)).alias(f"b{i}"), F.max(h - F.floor(h)).alias(f"w{i}"))]
    g = placed.agg(*found)
    return g.select(F.array(*[F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"w{i}") for i in range(len(shares))]).alias("edges"))


#: Bits of a block's number that one level of ``_below_by_digits`` tells apart, and of a rank within a block.
LEVEL_BITS, BLOCK_BITS = 4, 18


def _within(by: Sequence[str], at: str, span: int):
    """Worker: ``below`` and ``held`` of the points of one block, by the bits of their ranks: at each bit, points with a 0 go
    before those with a 1, and a window stays a stretch of them."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by(at)
        time, weight = (block.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in (at, "c"))
        rank = np.unique(block.column("__r").combine_chunks().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        low, high = np.searchsorted(time, time - span, "left"), np.searchsorted(time, time, "right")
        total = np.concatenate([[0], np.cumsum(weight)])
        held, below, now = total[high] - total[low], np.zeros(len(time), np.int64), rank
        for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
            one = (now >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~one)])
            total = np.concatenate([[0], np.cumsum(np.where(one, 0, weight))])
            up = (rank >> bit & 1).astype(bool)
            below += np.where(up, total[high] - total[low], 0)
            low, high = (np.where(up, zeros[-1] + x - zeros[x], zeros[x]) for x in (low, high))
            order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
            now, weight = now[order], weight[order]
        out = block.drop_columns(["c", "__r"])
        return out.append_column("below", pa.array(below)).append_column("held", pa.array(held))

    return run


def sliding_below(rows: DataFrame, value: str, by: Sequence[str], at: str, span: int, width: int) -> DataFrame:
    """(by, at, value, below, held) for every distinct (by, at, value): how many rows of the group with ``at`` in [at - span, at]
    have a smaller value, and how many have a value at all. ``at`` is a long; rows with a null in any of these count nowhere.

    A group's values are cut by rank into blocks of some 2 ^ BLOCK_BITS rows, a value with more rows being a block of its
    own. Smaller values of a point's block are counted in a task that holds the block, those of smaller blocks by counts of
    (by, at, block), see ``_below_by_digits``. No list of a window's values is ever held."""
    points = rows.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, at, value))).groupBy(*by, at, value).agg(F.count(F.lit(1)).alias("c"))
    ranked = with_below(points.groupBy(*by, value).agg(F.sum("c").alias("c")), value, by)
    alone = (F.col("c") >= 1 << BLOCK_BITS).cast("int")  # what follows such a value begins in a later block
    ranked = ranked.select(*by, value, F.col("below").alias("__r"), (F.shiftright("below", BLOCK_BITS) * 2 + alone).alias("__block"))
    points = written(points.join(ranked, [*by, value]).select(*by, at, value, "__r", "__block", "c"))
    kinds = T.StructType([f for f in points.schema.fields if f.name not in ("c", "__r")]).add("below", "long").add("held", "long")
    own = points.filter(F.col("__block") % 2 == 0).groupBy(*by, "__block").applyInArrow(_within(by, at, span), kinds)
    top = points.agg(F.max("__block").alias("top")).first()["top"] or 0
    if not top:
        return own.drop("__block")
    alone = points.filter(F.col("__block") % 2 == 1).select(*by, at, value, "__block", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("held"))
    counts = points.groupBy(*by, at, "__block").agg(F.sum("c").alias("c"))
    lower = _below_by_digits(counts, "__block", int(top), by, at, span, width).withColumnsRenamed({"below": "__lower", "held": "__held"})
    out = own.unionByName(alone).join(lower, [*by, at, "__block"])
    return out.select(*by, at, value, (F.col("below") + F.col("__lower")).alias("below"), F.col("__held").alias("held"))


def _below_by_digits(points: DataFrame, value: str, top: int, by: Sequence[str], at: str, span: int, width: int) -> DataFrame:
    """What ``sliding_below`` gives, for points (by, at, value, c) with whole values from 0 to ``top``.

    A value is read as digits; a smaller one has, at the first digit where they differ, a smaller digit under the same
    prefix. So each level needs running counts by digit under a prefix, at the window's two ends: two rows for each point
    and digit. Runs are cut into slices of ``width`` of ``at``, each begun with the totals of the slices before, so
    that a task holds a slice of a group and no group."""
    group, digits = [F.col(c) for c in by], 1 << LEVEL_BITS
    levels = max(1, -(-top.bit_length() // LEVEL_BITS))
    prefix = lambda k: F.shiftright(value, LEVEL_BITS * (k + 1))
    digit = lambda k: F.shiftright(value, LEVEL_BITS * k).bitwiseAND(digits - 1)
    end = lambda k, t, c, sign: F.struct(F.lit(k).alias("__l"), prefix(k).alias("__p"), digit(k).alias("__d"), t.alias("__t"), c.alias("__c"), F.lit(sign).alias("__sign"))
    ends = [e for k in range(levels) for e in (end(k, F.col(at), F.col("c"), 1), end(k, F.col(at) - span - 1, F.lit(0).cast("long"), -1))]
    events = points.select(*by, at, value, F.explode(F.array(*ends)).alias("__e")).select(*by, at, value, "__e.*").withColumn("__slice", F.floor(F.col("__t") / width))
    smaller = [F.sum(F.when(F.col("__d") < k, F.col("__c")).otherwise(0)) for k in range(1, digits + 1)]
    totals = events.groupBy(*by, "__l", "__p", "__slice").agg(*[x.alias(f"__s{k}") for k, x in enumerate(smaller)])
    before = Window.partitionBy(*group, "__l", "__p").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.array(*[F.coalesce(F.sum(f"__s{k}").over(before), F.lit(0)) for k in range(digits)])
    starts = totals.select(*by, "__l", "__p", "__slice", (F.col("__slice") * width - 1).alias("__t"), carried.alias("__start"))
    run = Window.partitionBy(*group, "__l", "__p", "__slice").orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = events.unionByName(starts, allowMissingColumns=True)
    counts = [F.sum(F.when(F.col("__start").isNotNull(), F.col("__start")[k]).when(F.col("__d") <= k, F.col("__c")).otherwise(0)).over(run) for k in range(digits)]
    found = both.withColumn("__counts", F.array(*counts)).filter("__sign IS NOT NULL")
    under = F.when(F.col("__d") > 0, F.try_element_at("__counts", F.col("__d").cast("int"))).otherwise(0)
    held = F.when(F.col("__l") == levels - 1, F.try_element_at("__counts", F.lit(digits))).otherwise(0)
    return found.groupBy(*by, at, value).agg(F.sum(under * F.col("__sign")).alias("below"), F.sum(held * F.col("__sign")).alias("held"))
