"""Complete time grids. Gaps stay gaps: a missing step is a row of nulls, and full windows need every step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def densify(df: DataFrame, time: str = "h", by: tuple[str, ...] = ("key",)) -> DataFrame:
    """A row for each step from the first to the last of each series; rows of one (series, time) must be one."""
    span = df.groupBy(*by).agg(F.min(time).alias("__a"), F.max(time).alias("__b")) if by else df.agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    steps = span.where("__a IS NOT NULL").select(*by, F.explode(F.sequence("__a", "__b")).alias(time))
    return steps.join(df, [*by, time], "left")


def trailing(time: str, n: int, by: tuple[str, ...] = ("key",), until: int = 0):
    """The last n rows of a series, the current included (until=0) or the one before the last (until=-1)."""
    return Window.partitionBy(*by).orderBy(time).rowsBetween(until - n + 1, until)


def full(value: Column, counted: Column, n: int, window) -> Column:
    """A windowed aggregate, null unless all n values of the window are known."""
    return F.when(F.count(counted).over(window) == n, value.over(window))


def missing_steps(df: DataFrame, time: str = "h", by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Steps between the first and the last without a row."""
    return densify(df.select(*by, time), time, by).join(df.select(*by, time), [*by, time], "left_anti")


def with_halo(df: DataFrame, size: int, halo: int, time: str = "h") -> DataFrame:
    """chunk and own: rows dealt into chunks of time, each with the halo of rows before it (own = false).

    Trailing windows of at most ``halo`` steps may then run by (series, chunk), in parallel over one long series, on the
    densified grid; afterwards only own rows are kept.
    """
    chunk = F.floor(F.col(time) / size).cast("long")
    last = F.floor((F.col(time) + halo) / size).cast("long")
    return df.withColumn("chunk", F.explode(F.sequence(chunk, last))).withColumn("own", F.col("chunk") == chunk)
