"""Row-level scores, decisions, labels and regimes as column expressions. Missing is not neutral: it stays null and drops out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clamp, mean_of, sigmoid

# Weights of the score's categories, and the thresholds of a decision.
WEIGHTS = {"trend": 0.3, "momentum": 0.25, "volume": 0.15, "pattern": 0.3}
BUY, SELL = 0.15, -0.15


def trend_score(close: Column, sma: Column) -> Column:
    return clamp((close - sma) / sma / 0.10)


def momentum_score(rsi: Column, histogram: Column, close: Column) -> Column:
    return mean_of(clamp((rsi - 50) / 50), clamp(histogram / close / 0.005))


def volume_score(change: Column, volume: Column, average: Column) -> Column:
    return F.when(change.isNotNull() & (average > 0), F.signum(change) * F.greatest(F.lit(0.0), clamp(volume / average - 1)))


def ma_cross(short: Column, long: Column) -> Column:
    return F.when(short > long, "bullish").when(short < long, "bearish").when(short.isNotNull() & long.isNotNull(), "neutral")


def structure(high_then: Column, low_then: Column, high_now: Column, low_now: Column) -> Column:
    return F.when((high_now > high_then) & (low_now > low_then), "up").when((high_now < high_then) & (low_now < low_then), "down").when(high_then.isNotNull() & high_now.isNotNull(), "sideways")


def band_position(close: Column, lower: Column, upper: Column, outer: float = 0.15) -> Column:
    place = (close - lower) / (upper - lower)
    return F.when(place <= outer, "lower").when(place >= 1 - outer, "upper").when(place.isNotNull(), "middle")


def pattern_score(cross: Column, trend: Column) -> Column:
    side = lambda c, up, down: F.when(c == up, 1.0).when(c == down, -1.0).when(c.isNotNull(), 0.0)
    return mean_of(side(cross, "bullish", "bearish"), side(trend, "up", "down"))


def combine(scores: dict[str, Column], weights: dict[str, float] | None = None) -> tuple[Column, Column]:
    """(weighted mean over the known scores, share of the weights that they hold)."""
    weights = weights or WEIGHTS
    held = sum((F.when(s.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, s in scores.items()), F.lit(0.0))
    total = sum((F.coalesce(s, F.lit(0.0)) * weights[k] for k, s in scores.items()), F.lit(0.0))
    return F.when(held > 0, total / held), held / sum(weights[k] for k in scores)


def decide(score: Column, buy: float = BUY, sell: float = SELL) -> Column:
    return F.when(score >= buy, "BUY").when(score <= sell, "SELL").otherwise("HOLD")


def agreement(scores: list[Column]) -> Column:
    """1 less the population deviation of the known scores; 0.5 with fewer than two."""
    values = F.filter(F.array(*scores), lambda x: x.isNotNull())
    n = F.size(values)
    add = lambda acc, x: acc + x
    mean = F.aggregate(values, F.lit(0.0), add) / n
    var = F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), add) / n
    return F.when(n < 2, 0.5).otherwise(clamp(1 - F.sqrt(var), 0.0, 1.0))


def binary_label(ret: Column) -> Column:
    return F.when(ret > 0, "UP").when(ret.isNotNull(), "DOWN")


def three_class(ret: Column, threshold: Column) -> Column:
    known = ret.isNotNull() & threshold.isNotNull()
    return F.when(~known, None).when(ret > threshold, "UP").when(ret < -threshold, "DOWN").when(known, "FLAT")


def large_move(ret: Column, threshold: float) -> Column:
    return F.when(ret.isNotNull(), (F.abs(ret) > threshold).cast("int"))


def trend_regime(change: Column, width: float = 0.10) -> Column:
    return F.when(change > width, "up").when(change < -width, "down").when(change.isNotNull(), "side")


def vol_regime(vol: Column, low: Column, high: Column) -> Column:
    """At the lower cut low, above the upper cut high."""
    return F.when(vol <= low, "low").when(vol > high, "high").when(vol.isNotNull(), "mid")


def position_size(mode: str, p: Column, vol: Column, target: float = 0.006) -> Column:
    less = clamp(1.5 - p, 0.25, 1.0)
    return {"more": clamp(0.5 + p, 0.25, 1.0), "less": less, "vol": clamp(target / vol, 0.25, 1.0), "full": F.lit(1.0)}[mode]


def frozen(model: dict, columns: dict[str, Column]) -> Column:
    """Probability of a frozen logistic model from its JSON fields: log inputs, scaling, weights, Platt map. Null if an input is
    missing or a log input isn't positive."""
    z = F.lit(float(model["intercept"]))
    for name, mean, scale, coef in zip(model["features"], model["scaler_mean"], model["scaler_scale"], model["coef"], strict=True):
        x = columns[name]
        if name in model["log_features"]:
            x = F.when(x > 0, F.log(x))
        z = z + (x - mean) / scale * coef
    limit = model["logit_clip"]
    p = clamp(sigmoid(z), limit, 1 - limit)
    return sigmoid(model["platt_a"] * F.log(p / (1 - p)) + model["platt_b"])


def verdict(criteria: list[Column], failed: Column) -> Column:
    """SUPPORTED if every criterion holds, NOT_SUPPORTED if it has failed, INCONCLUSIVE else."""
    every = reduce(lambda a, b: a & b, criteria)
    return F.when(every, "SUPPORTED").when(failed, "NOT_SUPPORTED").otherwise("INCONCLUSIVE")
