"""Groups of features by name: each a set of columns over an hourly grid (key, h, open, high, low, close, volume, trades, taker)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import log_positive, ratio


def back(hours: int) -> Column:
    return F.col("close") / F.lag("close", hours).over(Window.partitionBy("key").orderBy("h")) - 1


GROUPS: dict[str, Callable[[], dict[str, Column]]] = {
    "returns": lambda: {f"change_{n}": back(n) for n in (1, 6, 24)},
    "range": lambda: {"spread": ratio(F.col("high") - F.col("low"), F.col("close")), "body": ratio(F.col("close") - F.col("open"), F.col("open"))},
    "flow": lambda: {"taker_share": ratio(F.col("taker"), F.col("volume")), "log_volume": log_positive(F.col("volume")), "log_trades": log_positive(F.col("trades").cast("double"))},
    "clock": lambda: {"sin_day": F.sin(2 * F.pi() * (F.col("h") % 24) / 24), "cos_day": F.cos(2 * F.pi() * (F.col("h") % 24) / 24), "weekend": ((F.floor(F.col("h") / 24) + 3) % 7 >= 5).cast("double")},
}


def group_of(name: str) -> str:
    """The group that has a feature; KeyError for an unknown one."""
    return {n: g for g, made in GROUPS.items() for n in made()}[name]


def features(grid: DataFrame, groups: list[str]) -> DataFrame:
    """key, h and the features of the groups, for every step of a grid without gaps; unknown values are null. KeyError for an
    unknown group."""
    columns = {n: c for g in groups for n, c in GROUPS[g]().items()}
    return grid.select("key", "h", *[c.alias(n) for n, c in columns.items()])
