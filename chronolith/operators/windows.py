"""Windows that frames alone don't give: runs, sessions, decaying means, expanding quantiles, ranks."""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def average_rank(value: str, by: tuple[str, ...] = ()) -> Column:
    same = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(same) - 1) / 2


def run_ids(starts: Column, by: tuple[str, ...], time: str) -> Column:
    """A number for each run: how many rows so far start one."""
    return F.sum(starts.cast("int")).over(Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0))


def run_lengths(df: DataFrame, value: str, time: str = "h", by: tuple[str, ...] = ("key",)) -> DataFrame:
    """df with run: how many successive rows up to this one have the value, each exactly one step after the last."""
    w = Window.partitionBy(*by).orderBy(time)
    starts = F.coalesce((F.lag(value).over(w) != F.col(value)) | (F.col(time) - F.lag(time).over(w) != 1), F.lit(True))
    out = df.withColumn("__run", run_ids(starts, by, time))
    return out.withColumn("run", F.row_number().over(Window.partitionBy(*by, "__run").orderBy(time)).cast("long")).drop("__run")


def streak(df: DataFrame, value: str, cap: int = 6, time: str = "h", by: tuple[str, ...] = ("key",)) -> DataFrame:
    """df with streak: the signed length of the run of one sign, capped; 0 at zeros and gaps, which end runs."""
    w = Window.partitionBy(*by).orderBy(time)
    sign = F.coalesce(F.signum(value), F.lit(0.0))
    out = df.withColumn("__s", sign)
    out = out.withColumn("__new", F.coalesce(F.lag("__s").over(w) != F.col("__s"), F.lit(True)))
    out = out.withColumn("__run", run_ids(F.col("__new"), by, time))
    length = F.row_number().over(Window.partitionBy(*by, "__run").orderBy(time))
    return out.withColumn("streak", (F.col("__s") * F.least(length, F.lit(cap))).cast("long")).drop("__s", "__new", "__run")


def session_tail(df: DataFrame, time: str = "h", by: tuple[str, ...] = ("key",)) -> DataFrame:
    """df with tail: how many rows up to this one are unbroken by a gap of more than one step."""
    w = Window.partitionBy(*by).orderBy(time)
    out = df.withColumn("__new", F.coalesce(F.col(time) - F.lag(time).over(w) != 1, F.lit(True)))
    out = out.withColumn("__run", run_ids(F.col("__new"), by, time))
    return out.withColumn("tail", F.row_number().over(Window.partitionBy(*by, "__run").orderBy(time)).cast("long")).drop("__new", "__run")


def decayed_mean(value: str, time: str, half_life: float, by: tuple[str, ...] = ("key",), lives: int = 40) -> Column:
    """Mean of the known values so far, each weighted by 0.5 ** (age / half_life); ages over ``lives`` half-lives weigh nothing
    that a double could hold and are left out of the frame."""
    w = Window.partitionBy(*by).orderBy(time).rangeBetween(-int(half_life * lives), 0)
    seen = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("x")))).over(w)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))

    def add(acc, s):
        weight = F.pow(F.lit(0.5), (F.col(time) - s["t"]) / half_life)
        return F.struct((acc["a"] + weight * s["x"]).alias("a"), (acc["b"] + weight).alias("b"))

    return F.aggregate(seen, zero, add, lambda acc: F.when(acc["b"] > 0, acc["a"] / acc["b"]))


def rank_share(value: str, n: int, time: str = "h", by: tuple[str, ...] = ("key",)) -> Column:
    """Share of the n - 1 values before that are strictly below this one; null unless all n are known."""
    w = Window.partitionBy(*by).orderBy(time)
    before = F.collect_list(value).over(w.rowsBetween(-(n - 1), -1))
    below = F.size(F.filter(before, lambda x: x < F.col(value)))
    return F.when((F.count(value).over(w.rowsBetween(-(n - 1), 0)) == n), below / (n - 1))


def expanding_quantile(df: DataFrame, value: str, q: float, least: int, out: str, time: str = "h", by: str = "key") -> DataFrame:
    """df with the linear quantile of all earlier known values of the series, null before ``least`` of them. A fold with a
    sorted list for each series."""
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time).reset_index(drop=True)
        held: list[float] = []
        got = np.full(len(pdf), np.nan)
        for i, x in enumerate(pdf[value].to_numpy(float)):
            n = len(held)
            if n >= max(least, 1):
                at = q * (n - 1)
                k = int(at)
                got[i] = held[k] + (held[min(k + 1, n - 1)] - held[k]) * (at - k)
            if not np.isnan(x):
                insort(held, x)
        pdf[out] = pd.Series(got).astype(object).where(~np.isnan(got), None)
        return pdf

    return df.groupBy(by).applyInPandas(fold, schema)


def quantile_bin(rank: Column, count: Column, bins: int) -> Column:
    """Bin 0..bins-1 of an ordinal rank from 1, with edges at linear quantiles of the ranks."""
    share = (rank - 1) * bins / F.greatest(count - 1, F.lit(1))
    return F.greatest(F.ceil(share) - 1, F.lit(0)).cast("int")
