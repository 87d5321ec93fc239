"""Keys, frames and null hygiene of long panels (entity, time, values...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


@dataclass(frozen=True)
class Keys:
    """The columns that name a series and order it."""

    entity: str = "ticker"
    time: str = "ts"

    def series(self) -> WindowSpec:
        return Window.partitionBy(self.entity).orderBy(self.time)

    def rows(self, n: int) -> WindowSpec:
        """The current row and the n - 1 before it."""
        return self.series().rowsBetween(-(n - 1), 0)

    def cross(self) -> WindowSpec:
        return Window.partitionBy(self.time)


KEYS = Keys()


def finite(x: Column) -> Column:
    """NaN and infinities as null: operators know null only."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clean(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def gated(value: Column, x: Column, n: int, frame: WindowSpec) -> Column:
    """``value`` over the frame, null unless the frame holds n non-null x."""
    return F.when(F.count(x).over(frame) == n, value.over(frame))


def nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


def correlation(a: str, b: str) -> Column:
    """The correlation of two complete columns as an aggregate; null where either is flat."""
    return F.try_divide(F.covar_pop(a, b), nonzero(F.stddev_pop(a) * F.stddev_pop(b)))


def truth(mask: Column) -> Column:
    """A mask as boolean; a missing mask counts as true."""
    return F.coalesce(mask.cast("double"), F.lit(1.0)) != 0


def flag(condition: Column, missing: bool = False) -> Column:
    return F.coalesce(condition, F.lit(missing)).cast("double")
