"""Scalar column builders. A null input gives a null unless said otherwise; NaN is made null at the boundary (``known``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null unless b is above 0."""
    return F.when(b > 0, a / b)


def float_ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it, whatever the session's mode: over 0 an infinity, NaN for 0 / 0."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def float_log(x: Column) -> Column:
    """The natural logarithm as floating point has it: minus infinity of 0, NaN below."""
    return F.when(x < 0, F.lit(float("nan"))).when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = clamp(p, clip, 1 - clip)
    return F.log(q / (1 - q))


def log_positive(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def mean_of(*parts: Column) -> Column:
    """Mean of the parts that are not null; null if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    count = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts])
    return F.when(count > 0, total / count)


def epoch_hour(t: Column) -> Column:
    """Whole hours since 1970 of a timestamp in UTC."""
    return F.floor(F.unix_timestamp(t.cast("timestamp")) / 3600).cast("long")


def hour_time(h: Column) -> Column:
    return F.timestamp_seconds(h * 3600).cast("timestamp_ntz")


def iso_week(t: Column) -> Column:
    return F.date_trunc("week", t).cast("timestamp_ntz")


def six_hour_block(hour: Column) -> Column:
    return F.floor(F.pmod(hour, F.lit(24)) / 6).cast("int")


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval for a share, inside [0, 1] and around the share itself; null for no trials."""
    p = successes / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    some = n > 0
    return F.when(some, F.least(F.greatest(centre - half, F.lit(0.0)), p)), F.when(some, F.greatest(F.least(centre + half, F.lit(1.0)), p))


def close_to(a: Column, b: Column, relative: float = 1e-9, absolute: float = 0.0) -> Column:
    """Equal within a tolerance; two nulls are equal, a null and a number aren't."""
    near = F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def normal_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


# What a kept answer must not show, and what stands for it.
SECRETS = [
    (r"(gh[pousr]_|github_pat_)[A-Za-z0-9_]+", "[redacted]"),
    (r"([Bb]earer|[Tt]oken)\s+[A-Za-z0-9._~+/=-]+", "$1 [redacted]"),
    (r"([Aa]uthorization\"?\s*[:=]\s*)[^\n,}]*", "$1[redacted]"),
]


def redacted(text: Column, most: int | None = None) -> Column:
    """Tokens, bearer values and authorization headers replaced, then cut to ``most`` characters."""
    for pattern, instead in SECRETS:
        text = F.regexp_replace(text, pattern, instead)
    return text if most is None else F.substring(text, 1, most)
