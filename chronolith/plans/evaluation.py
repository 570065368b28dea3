"""Queries on scores, decisions, probabilities, models, simulations and reporting views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar, scoring
from ..operators import grid as G
from ..operators import joins as J
from ..operators import models, simulate, stats, views
from ..operators.indicators import indicators
from ..sources import sinks, tables
from . import recursive
from .base import CANDLES, DAILY, FORECAST, GRID, RETURNS, SIGNALS, daily, forecast, forward, grid, hourly, labelled, query, r, signals

S = SparkSession


@query(f"WITH {SIGNALS} SELECT coalesce(signal, 'ALL') AS signal, count(*) AS n, round(avg(ret), 6) AS mean_ret FROM (SELECT * FROM sig) GROUP BY ROLLUP (signal)")
def signal_rollup(spark: S, sf: str) -> DataFrame:
    """By signal and over all; the total is summed from the few rows by signal, and is there without any."""
    by = signals(spark, sf).groupBy("signal").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.count("ret").alias("c"))
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c")).withColumn("signal", F.lit("ALL"))
    return by.unionByName(total).select("signal", "n", r(F.when(F.col("c") > 0, F.col("s") / F.col("c"))).alias("mean_ret"))


#: Three scores of a candle: distance to its mean, its own move, its volume against the mean before.
SCORES = GRID + """,
sx AS (SELECT key, h, close, open, volume, CASE WHEN count(close) OVER w = 6 THEN avg(close) OVER w END AS sma, CASE WHEN count(volume) OVER b = 6 THEN avg(volume) OVER b END AS va, close - lag(close) OVER o AS ch FROM g
  WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), b AS (PARTITION BY key ORDER BY h ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY key ORDER BY h)),
sy AS (SELECT key, h, CASE WHEN sma IS NOT NULL THEN greatest(least((close - sma) / sma / 0.10, 1.0), -1.0) END AS trend, greatest(least((close / open - 1) / 0.5, 1.0), -1.0) AS momentum,
  CASE WHEN ch IS NOT NULL AND va > 0 THEN sign(ch) * greatest(0.0, greatest(least(volume / va - 1, 1.0), -1.0)) END AS volume FROM sx WHERE close IS NOT NULL),
sz AS (SELECT *, CASE WHEN trend IS NULL THEN 0 ELSE 0.3 END + CASE WHEN momentum IS NULL THEN 0 ELSE 0.25 END + CASE WHEN volume IS NULL THEN 0 ELSE 0.15 END AS held,
  coalesce(trend, 0) * 0.3 + coalesce(momentum, 0) * 0.25 + coalesce(volume, 0) * 0.15 AS total FROM sy)"""


def scores(spark: S, sf: str) -> DataFrame:
    b = Window.partitionBy("key").orderBy("h")
    g = grid(spark, sf).select("key", "h", "close", "open", "volume", G.full(F.avg("close"), F.col("close"), 6, G.trailing("h", 6)).alias("sma"), G.full(F.avg("volume"), F.col("volume"), 6, G.trailing("h", 6, until=-1)).alias("va"), (F.col("close") - F.lag("close").over(b)).alias("ch"))
    return g.where("close IS NOT NULL").select(
        "key", "h", scoring.trend_score(F.col("close"), F.col("sma")).alias("trend"), scalar.clamp((F.col("close") / F.col("open") - 1) / 0.5).alias("momentum"), scoring.volume_score(F.col("ch"), F.col("volume"), F.col("va")).alias("volume")
    )


@query(f"WITH {SCORES} SELECT key, h, round(total / held, 6) AS score, round(held / 0.7, 6) AS completeness, CASE WHEN total / held >= 0.15 THEN 'BUY' WHEN total / held <= -0.15 THEN 'SELL' ELSE 'HOLD' END AS signal FROM sz")
def weighted_score(spark: S, sf: str) -> DataFrame:
    parts = {k: F.col(k) for k in ("trend", "momentum", "volume")}
    score, held = scoring.combine(parts)
    return scores(spark, sf).select("key", "h", r(score).alias("score"), r(held).alias("completeness"), scoring.decide(score).alias("signal"))


@query(f"WITH {SCORES}, u AS (SELECT key, h, trend, volume, unnest([trend, momentum, volume]) AS x, held FROM sz), a AS (SELECT key, h, held, count(x) AS n, stddev_pop(x) AS s FROM u GROUP BY ALL) SELECT key, h, round(CASE WHEN n < 2 THEN 0.5 ELSE greatest(least(1 - s, 1), 0) END, 6) AS agreement, round((CASE WHEN n < 2 THEN 0.5 ELSE greatest(least(1 - s, 1), 0) END + held / 0.7) / 2, 6) AS confidence FROM (SELECT key, h, max(held) AS held, sum(n) AS n, max(s) AS s FROM a GROUP BY 1, 2)")
def agreement(spark: S, sf: str) -> DataFrame:
    parts = {k: F.col(k) for k in ("trend", "momentum", "volume")}
    agree, held = scoring.agreement(list(parts.values())), scoring.combine(parts)[1]
    return scores(spark, sf).select("key", "h", r(agree).alias("agreement"), r((agree + held) / 2).alias("confidence"))


@query(f"WITH {SCORES}, d AS (SELECT key, h, CASE WHEN total / held >= 0.15 THEN 'BUY' WHEN total / held <= -0.15 THEN 'SELL' ELSE 'HOLD' END AS signal, CASE WHEN t2 / h2 >= 0.15 THEN 'BUY' WHEN t2 / h2 <= -0.15 THEN 'SELL' ELSE 'HOLD' END AS without FROM (SELECT *, coalesce(trend, 0) * 0.3 + coalesce(momentum, 0) * 0.25 AS t2, CASE WHEN trend IS NULL THEN 0 ELSE 0.3 END + CASE WHEN momentum IS NULL THEN 0 ELSE 0.25 END AS h2 FROM sz)) SELECT signal, without, count(*) AS n FROM d GROUP BY 1, 2")
def leave_one_out(spark: S, sf: str) -> DataFrame:
    parts = {k: F.col(k) for k in ("trend", "momentum", "volume")}
    with_all, without = (scoring.decide(scoring.combine(p)[0]) for p in (parts, {k: v for k, v in parts.items() if k != "volume"}))
    return scores(spark, sf).select(with_all.alias("signal"), without.alias("without")).groupBy("signal", "without").agg(F.count("*").alias("n"))


@query(f"""WITH {SIGNALS}, a AS (SELECT key, CASE WHEN ret > 0 THEN 'UP' ELSE 'DOWN' END AS actual, CASE signal WHEN 'BUY' THEN 'UP' ELSE 'DOWN' END AS said FROM sig WHERE ret IS NOT NULL),
c AS (SELECT key, count(*) AS n, sum((said = 'UP' AND actual = 'UP')::INT)::BIGINT AS tp, sum((said = 'UP' AND actual = 'DOWN')::INT)::BIGINT AS fp, sum((said = 'DOWN' AND actual = 'UP')::INT)::BIGINT AS fn, avg((said = actual)::INT) AS accuracy FROM a GROUP BY 1)
SELECT key, n, tp, fp, fn, round(accuracy, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def confusion(spark: S, sf: str) -> DataFrame:
    s = signals(spark, sf).where("ret IS NOT NULL").select("key", scoring.binary_label(F.col("ret")).alias("actual"), F.when(F.col("signal") == "BUY", "UP").otherwise("DOWN").alias("said"))
    c = stats.confusion(s, ["key"], "actual", "said", "UP")
    return c.select("key", "n", "tp", "fp", "fn", *[r(F.col(x)).alias(x) for x in ("accuracy", "precision", "recall", "f1")])


@query(f"WITH {FORECAST} SELECT key, least((p >= 0.1)::INT + (p >= 0.2)::INT + (p >= 0.3)::INT + (p >= 0.4)::INT + (p >= 0.5)::INT + (p >= 0.6)::INT + (p >= 0.7)::INT + (p >= 0.8)::INT + (p >= 0.9)::INT, 9) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM fc GROUP BY 1, 2")
def reliability(spark: S, sf: str) -> DataFrame:
    return stats.reliability(forecast(spark, sf), ["key"]).select("key", "bin", "n", r(F.col("mean_p")).alias("mean_p"), r(F.col("observed")).alias("observed"))


@query(f"WITH {FORECAST}, b AS (SELECT key, (p >= 0.1)::INT + (p >= 0.2)::INT + (p >= 0.3)::INT + (p >= 0.4)::INT + (p >= 0.5)::INT + (p >= 0.6)::INT + (p >= 0.7)::INT + (p >= 0.8)::INT + (p >= 0.9)::INT AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM fc GROUP BY 1, 2) SELECT key, round(sum(gap * n) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM b GROUP BY 1")
def calibration_error(spark: S, sf: str) -> DataFrame:
    return stats.calibration_error(forecast(spark, sf), ["key"]).select("key", r(F.col("ece")).alias("ece"), r(F.col("mce")).alias("mce"))


@query(f"WITH {FORECAST}, a AS (SELECT key, count(*) AS n, avg(y) AS base, avg((p - y) * (p - y)) AS brier, avg(-(y * ln(greatest(least(p, 1 - 1e-6), 1e-6)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)))) AS ll FROM fc GROUP BY 1) SELECT a.key, n, round(base, 6) AS base, round(brier, 6) AS brier, round(1 - brier / (base * (1 - base)), 6) AS skill, round(ll, 6) AS log_loss FROM a")
def brier_skill(spark: S, sf: str) -> DataFrame:
    f = forecast(spark, sf)
    loss = f.groupBy("key").agg(r(stats.log_loss(F.col("p"), F.col("y"))).alias("log_loss"))
    return stats.skill(f, ["key"]).select("key", "n", *[r(F.col(c)).alias(c) for c in ("base", "brier", "skill")]).join(loss, "key")


RANKED = FORECAST + """,
rk AS (SELECT key, h, p, y, rank() OVER (PARTITION BY key ORDER BY p) + (count(*) OVER (PARTITION BY key, p) - 1) / 2 AS rp, rank() OVER (PARTITION BY key ORDER BY abs(ret)) + (count(*) OVER (PARTITION BY key, abs(ret)) - 1) / 2 AS rr FROM fc)"""


@query(f"WITH {RANKED} SELECT key, count(*) AS n, round(corr(rp, rr), 6) AS rho FROM rk GROUP BY 1")
def spearman(spark: S, sf: str) -> DataFrame:
    f = forecast(spark, sf).withColumn("size", F.abs("ret"))
    return stats.spearman(f, "p", "size", ("key",)).withColumn("rho", r(F.col("rho")))


@query(f"WITH {RANKED}, a AS (SELECT key, sum(y) AS pos, sum(1 - y) AS neg, sum(CASE WHEN y = 1 THEN rp END) AS s FROM rk GROUP BY 1) SELECT key, round(CASE WHEN pos > 0 AND neg > 0 THEN (s - pos * (pos + 1) / 2) / (pos * neg) END, 6) AS auc FROM a")
def auc(spark: S, sf: str) -> DataFrame:
    return stats.auc(forecast(spark, sf), "p", "y", ("key",)).withColumn("auc", r(F.col("auc")))


@query(f"WITH {SIGNALS} SELECT key, round(avg(ret) FILTER (WHERE signal = 'BUY') - avg(ret) FILTER (WHERE signal = 'SELL'), 6) AS edge FROM sig GROUP BY 1")
def edge(spark: S, sf: str) -> DataFrame:
    return signals(spark, sf).groupBy("key").agg(r(stats.edge()).alias("edge"))


@query(f"WITH {FORECAST}, s AS (SELECT 'block' AS slice, (h % 24 // 6)::VARCHAR AS value, p, y FROM fc UNION ALL SELECT 'key', key, p, y FROM fc UNION ALL SELECT 'all', 'all', p, y FROM fc) SELECT slice, value, count(*) AS n, round(avg(y), 6) AS base, round(avg(p), 6) AS mean_p, round(avg((p - y) * (p - y)), 6) AS brier FROM s GROUP BY 1, 2")
def slice_table(spark: S, sf: str) -> DataFrame:
    f = forecast(spark, sf).withColumn("block", scalar.six_hour_block(F.col("h")).cast("string"))
    g = f.groupingSets([["block"], ["key"], []], "block", "key").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), r(F.avg("y")).alias("base"), r(F.avg("p")).alias("mean_p"), r(stats.brier(F.col("p"), F.col("y"))).alias("brier"))
    name = F.when(F.col("g") == 1, "block").when(F.col("g") == 2, "key").otherwise("all")
    return g.select(name.alias("slice"), F.coalesce("block", "key", F.lit("all")).alias("value"), "n", "base", "mean_p", "brier")


@query(f"""WITH {CANDLES}, m AS (SELECT key, min(h) + 360 AS cut FROM candles GROUP BY 1), ref AS (SELECT key, quantile_cont(close, 0.01) AS lo, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.5) AS q2, quantile_cont(close, 0.75) AS q3, quantile_cont(close, 0.99) AS hi FROM candles JOIN m USING (key) WHERE h < cut GROUP BY 1),
l AS (SELECT c.key, count(*) AS n, quantile_cont(close, 0.5) AS median, avg((close < lo OR close > hi)::INT) AS outside, any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3 FROM candles AS c JOIN m ON m.key = c.key JOIN ref ON ref.key = c.key WHERE h >= cut GROUP BY 1)
SELECT key, n, round(median, 6) AS median, round(abs(median - q2) / (q3 - q1), 6) AS shift, round(outside, 6) AS outside, n >= 100 AND (abs(median - q2) / (q3 - q1) > 1 OR outside > 0.1) AS flag FROM l""")
def drift(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf).withColumn("cut", F.min("h").over(Window.partitionBy("key")) + 360)
    d = stats.drift(c.where("h >= cut"), c.where("h < cut"), ["key"], "close")
    return d.select("key", "n", r(F.col("median")).alias("median"), r(F.col("shift")).alias("shift"), r(F.col("outside")).alias("outside"), "flag")


@query(f"WITH {GRID}, a AS (SELECT g.key, g.h, g.close / p.close - 1 AS ch FROM g JOIN g AS p ON p.key = g.key AND p.h = g.h - 72), t AS (SELECT CASE WHEN ch > 0.1 THEN 'up' WHEN ch < -0.1 THEN 'down' ELSE 'side' END AS regime FROM a WHERE ch IS NOT NULL) SELECT regime, count(*) AS n FROM t GROUP BY 1")
def trend_regime(spark: S, sf: str) -> DataFrame:
    c = J.at_shift(hourly(spark, sf).select("key", "h", "close"), -72, {"close": "then"})
    return c.select(scoring.trend_regime(F.col("close") / F.col("then") - 1).alias("regime")).where("regime IS NOT NULL").groupBy("regime").agg(F.count("*").alias("n"))


@query(f"WITH {CANDLES}, m AS (SELECT key, min(h) + 360 AS cut FROM candles GROUP BY 1), t AS (SELECT key, quantile_cont(volume, 1/3.0::DOUBLE) AS lo, quantile_cont(volume, 2/3.0::DOUBLE) AS hi FROM candles JOIN m USING (key) WHERE h < cut GROUP BY 1) SELECT key, CASE WHEN volume <= lo THEN 'low' WHEN volume > hi THEN 'high' ELSE 'mid' END AS regime, count(*) AS n FROM candles JOIN t USING (key) GROUP BY 1, 2")
def vol_terciles(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf).withColumn("cut", F.min("h").over(Window.partitionBy("key")) + 360)
    t = c.where("h < cut").groupBy("key").agg(F.percentile("volume", F.lit(1 / 3)).alias("lo"), F.percentile("volume", F.lit(2 / 3)).alias("hi"))
    return c.join(t, "key").select("key", scoring.vol_regime(F.col("volume"), F.col("lo"), F.col("hi")).alias("regime")).groupBy("key", "regime").agg(F.count("*").alias("n"))


@query(f"WITH {RETURNS}, b AS (SELECT key, h, ret FROM fwd WHERE ret IS NOT NULL), k AS (SELECT unnest(range(1, 6))::INT AS k) SELECT a.key, k, count(*) AS n, round(corr(a.ret, b.ret), 6) AS acf FROM b AS a CROSS JOIN k JOIN b ON b.key = a.key AND b.h = a.h - k GROUP BY 1, 2")
def pooled_acf(spark: S, sf: str) -> DataFrame:
    return stats.autocorrelation(forward(spark, sf).select("key", "h", "ret"), "ret", 5).withColumn("acf", r(F.col("acf")))


@query(f"WITH {FORECAST}, q AS (SELECT key, quantile_cont(p, 0.1) AS a, quantile_cont(p, 0.9) AS z, quantile_cont(ret, 0.1) AS lo, quantile_cont(ret, 0.9) AS hi FROM fc GROUP BY 1) SELECT key, round(avg((ret <= lo)::INT) FILTER (WHERE p >= z) - avg((ret >= hi)::INT) FILTER (WHERE p >= z) - (avg((ret <= lo)::INT) FILTER (WHERE p <= a) - avg((ret >= hi)::INT) FILTER (WHERE p <= a)), 6) AS contrast FROM fc JOIN q USING (key) GROUP BY 1")
def tail_contrast(spark: S, sf: str) -> DataFrame:
    f = forecast(spark, sf)
    q = f.groupBy("key").agg(*[F.percentile(c, F.lit(x)).alias(n) for c, x, n in (("p", 0.1, "a"), ("p", 0.9, "z"), ("ret", 0.1, "lo"), ("ret", 0.9, "hi"))])
    low, high = (F.col("ret") <= F.col("lo")).cast("int"), (F.col("ret") >= F.col("hi")).cast("int")
    side = lambda where: F.avg(F.when(where, low)) - F.avg(F.when(where, high))
    return f.join(q, "key").groupBy("key").agg(r(side(F.col("p") >= F.col("z")) - side(F.col("p") <= F.col("a"))).alias("contrast"))


@query()
def bootstrap_ci(spark: S, sf: str) -> DataFrame:
    f = forecast(spark, sf).withColumn("gain", F.pow(F.lit(0.5) - F.col("y"), 2) - F.pow(F.col("p") - F.col("y"), 2))
    b = stats.bootstrap_mean(f.select("key", "h", "gain"), "key", "gain", "h", block=24)
    return stats.holm(b, "p")


@query(recursive.cusum(0.025, 5.0))
def cusum(spark: S, sf: str) -> DataFrame:
    return stats.cusum(forecast(spark, sf).select("key", "h", "p", "y"), "p", "y", 0.025, 5.0)


@query(f"""WITH {CANDLES}, p AS (SELECT row_number() OVER (ORDER BY key, h) AS id, key, h, h + 1 AS created_h, close FROM candles), n AS (SELECT max(h) - 24 AS now FROM candles), o AS (SELECT p.id, q.h + 1 + h.horizon % 3 AS checked_h, h.horizon FROM p CROSS JOIN (SELECT unnest([1, 24]) AS horizon) AS h JOIN candles AS q ON q.key = p.key AND q.h = p.h + h.horizon)
SELECT (SELECT count(*) FROM p, n WHERE created_h <= now) AS predictions, (SELECT count(*) FROM o JOIN p USING (id), n WHERE checked_h <= now AND created_h <= now) AS outcomes""")
def bitemporal_known_at(spark: S, sf: str) -> DataFrame:
    p, o, now = record(spark, sf)
    seen, graded = views.known_at(p, o, now)
    return seen.agg(F.count("*").alias("predictions")).join(graded.agg(F.count("*").alias("outcomes")))


def record(spark: S, sf: str) -> tuple[DataFrame, DataFrame, int]:
    """Predictions (a row a candle, id by key and hour) and their outcomes after 1 and 24 hours; a time 24 hours before the end."""
    c = hourly(spark, sf)
    p = c.select(F.concat_ws(":", "key", "h").alias("id"), "key", "h", (F.col("h") + 1).alias("created_h"), "close", "open")
    p = p.withColumn("signal", scoring.decide(F.col("close") / F.col("open") - 1))
    later = J.at_shifts(p.select("id", "key", "h", "close"), [1, 24], "close").where("later IS NOT NULL")
    o = later.select(F.col("id").alias("prediction_id"), F.col("shift").alias("horizon"), (F.col("h") + F.col("shift") + 1 + F.col("shift") % 3).alias("checked_h"), F.lit("ok").alias("status"), (F.col("later") / F.col("close") - 1).alias("ret"))
    return p, o, (c.agg(F.max("h")).first()[0] or 24) - 24


VIEW = CANDLES + """,
n AS (SELECT max(h) - 24 AS now FROM candles),
p AS (SELECT key, h, close, CASE WHEN close / open - 1 >= 0.15 THEN 'BUY' WHEN close / open - 1 <= -0.15 THEN 'SELL' ELSE 'HOLD' END AS signal FROM candles, n WHERE h + 1 <= now),
rv0 AS (SELECT p.*, horizon, CASE WHEN q.h + 1 + horizon % 3 <= now THEN q.close / p.close - 1 END AS ret, now FROM p CROSS JOIN n CROSS JOIN (SELECT unnest([1, 24]) AS horizon) LEFT JOIN candles AS q ON q.key = p.key AND q.h = p.h + horizon),
rv AS (SELECT *, CASE WHEN ret IS NOT NULL THEN 'graded' WHEN now <= h + horizon + 2 THEN 'pending' ELSE 'overdue' END AS state FROM rv0)"""


def runs(spark: S, sf: str) -> tuple[DataFrame, int]:
    p, o, now = record(spark, sf)
    return views.run_view(p, o, [1, 24], now), now


@query(f"WITH {VIEW} SELECT horizon, state, count(*) AS n FROM rv GROUP BY 1, 2")
def outcome_states(spark: S, sf: str) -> DataFrame:
    return runs(spark, sf)[0].groupBy("horizon", "state").agg(F.count("*").alias("n"))


@query(f"""WITH {VIEW}, a AS (SELECT horizon, count(*) AS n, count(*) FILTER (WHERE state = 'graded') AS graded, count(*) FILTER (WHERE state = 'graded' AND signal <> 'HOLD') AS acted, count(*) FILTER (WHERE state = 'graded' AND ((signal = 'BUY' AND ret > 0) OR (signal = 'SELL' AND ret < 0))) AS agreed, avg(ret) AS mean_ret FROM rv GROUP BY 1)
SELECT horizon, n, graded, acted, agreed, round(mean_ret, 6) AS mean_ret FROM a""")
def horizon_table(spark: S, sf: str) -> DataFrame:
    return views.horizon_table(runs(spark, sf)[0]).select("horizon", "n", "graded", "acted", "agreed", r(F.col("mean_ret")).alias("mean_ret"))


@query(f"WITH {VIEW}, w AS (SELECT (h + 72) // 168 AS week, count(*) AS n, avg((signal <> 'HOLD')::INT) AS acted_share FROM rv WHERE horizon = 1 AND (h + 72) // 168 * 168 - 72 + 168 <= now GROUP BY 1) SELECT week, n, round(acted_share, 6) AS acted_share, round(acted_share - lag(acted_share) OVER (ORDER BY week), 6) AS change FROM w")
def weekly_trends(spark: S, sf: str) -> DataFrame:
    v, now = runs(spark, sf)
    return views.weekly(v.where("horizon = 1"), now).select("week", "n", r(F.col("acted_share")).alias("acted_share"), r(F.col("change")).alias("change"))


@query(f"WITH {CANDLES}, n AS (SELECT max(h) AS now FROM candles), k AS (SELECT unnest([24, 168]) AS hours) SELECT key, hours, count(*) AS present, round(count(*) / hours, 6) AS share FROM candles, n, k WHERE h < now AND h >= now - hours GROUP BY 1, 2")
def window_health(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf)
    return views.window_health(c, c.agg(F.max("h")).first()[0] or 0, [24, 168]).withColumn("share", r(F.col("share")))


@query(f"WITH {GRID}, m AS (SELECT key, h, close IS NOT NULL AS ok, lag(close IS NOT NULL) OVER (PARTITION BY key ORDER BY h) AS before FROM g) SELECT key, h, CASE WHEN ok THEN 'recovered' ELSE 'lost' END AS event FROM m WHERE before IS NOT NULL AND ok <> before")
def health_transitions(spark: S, sf: str) -> DataFrame:
    g = grid(spark, sf)
    return views.transitions(g.select("key", "h"), g.where("close IS NOT NULL"), 1 << 40)


@query(f"WITH {CANDLES}, m AS (SELECT max(h) AS m FROM candles) SELECT key, h, close FROM candles, m WHERE h < m - 10 AND key = 'click' ORDER BY h DESC LIMIT 20")
def keyset_page(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf).select("key", "h", "close")
    return views.page(c.where("key = 'click'"), (c.agg(F.max("h")).first()[0] or 0) - 10, 20)


@query("SELECT user_id, '{\"rows\":' || to_json(list({'event_id': event_id, 'event_type': event_type} ORDER BY event_id))::VARCHAR || '}' AS document FROM events GROUP BY 1")
def documents_json(spark: S, sf: str) -> DataFrame:
    return views.document(tables.table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id")


FOLDS = [(0, 0, 200, 225, 297, 322, 394), (1, 0, 272, 297, 369, 394, 466), (2, 0, 344, 369, 441, 466, 538), (3, 0, 416, 441, 513, 538, 610)]


def fold_rows(spark: S, sf: str, end: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled hours counted from the first, and folds up to ``end``: by default, all of them."""
    c = labelled(spark, sf)
    start, last = c.agg(F.min("h"), F.max("h")).first()
    start, last = start or 0, -1 if last is None else last
    f = models.folds(spark, 0, last - start + 1 if end is None else end, 200, 72, 72, 24, 1)
    return c.withColumn("i", F.col("h") - start), f


@query(f"WITH {RETURNS}, f(fold, a, b, c, d, e, z) AS (VALUES {', '.join(map(str, FOLDS))}), i AS (SELECT h - (SELECT min(h) FROM candles) AS i FROM g), p AS (SELECT fold, 'train' AS part, a AS lo, b AS hi FROM f UNION ALL SELECT fold, 'calib', c, d FROM f UNION ALL SELECT fold, 'test', e, z FROM f) SELECT fold, part, count(*) AS n FROM i JOIN p ON i >= lo AND i < hi GROUP BY 1, 2")
def fold_membership(spark: S, sf: str) -> DataFrame:
    c, f = fold_rows(spark, sf, FOLDS[-1][-1])  # the folds that the SQL names
    models.check_folds(f.collect(), 24, 1)  # a row a fold
    return J.in_folds(c.select("i"), f, "i").groupBy("fold", "part").agg(F.count("*").alias("n"))


MODEL = {"features": ["volume", "range"], "log_features": ["volume"], "scaler_mean": [4.0, 0.5], "scaler_scale": [1.2, 0.4], "coef": [0.3, -0.2], "intercept": 0.1, "platt_a": 0.9, "platt_b": -0.05, "logit_clip": 1e-6}


@query(f"""WITH {CANDLES}, z AS (SELECT key, h, 0.1 + (ln(volume) - 4.0) / 1.2 * 0.3 + ((high - low) / close - 0.5) / 0.4 * -0.2 AS z FROM candles WHERE volume > 0), p AS (SELECT key, h, greatest(least(1 / (1 + exp(-z)), 1 - 1e-6), 1e-6) AS p FROM z)
SELECT key, h, round(1 / (1 + exp(-(0.9 * ln(p / (1 - p)) - 0.05))), 6) AS p FROM p""")
def frozen_scorer(spark: S, sf: str) -> DataFrame:
    p = scoring.frozen(MODEL, {"volume": F.col("volume"), "range": (F.col("high") - F.col("low")) / F.col("close")})
    return hourly(spark, sf).where("volume > 0").select("key", "h", r(p).alias("p"))


def out_of_sample(spark: S, sf: str, calibrator: str | None) -> DataFrame:
    c, f = fold_rows(spark, sf)
    rows = J.in_folds(c.select("key", "i", "volume", ((F.col("high") - F.col("low")) / F.col("close")).alias("range"), F.col("y").cast("double").alias("y")), f, "i")
    return models.walk_forward(rows, ["volume", "range"], "y", ("volume",), calibrator=calibrator, time="i", by=("key",))


@query()
def logistic_walkforward(spark: S, sf: str) -> DataFrame:
    return out_of_sample(spark, sf, None)


@query()
def platt(spark: S, sf: str) -> DataFrame:
    return out_of_sample(spark, sf, "platt")


@query()
def isotonic(spark: S, sf: str) -> DataFrame:
    return out_of_sample(spark, sf, "isotonic")


@query(recursive.INDICATOR_SET)
def indicator_set(spark: S, sf: str) -> DataFrame:
    i = indicators(hourly(spark, sf).select("key", "h", "close", "volume"))
    return i.select("key", "h", "hours", *[r(F.col(c)).alias(c) for c in recursive.INDICATOR_NAMES])


def account_days(spark: S, sf: str) -> DataFrame:
    w = Window.orderBy("d").rowsBetween(-9, 0)  # a row a day
    d = daily(spark, sf).withColumn("sma", F.avg("total").over(w))
    return d.select(F.lit("orders").alias("key"), "d", F.col("total").alias("price"), (F.col("total") > F.col("sma")).cast("double").alias("desired"), F.lit(0.5).alias("size"))


RULES = {"signal": simulate.Rule(), "stop": simulate.Rule(stop_loss=0.05), "trail": simulate.Rule(trailing=0.1), "time": simulate.Rule(time_stop=5), "sized": simulate.Rule(sized=True)}


@query(recursive.PAPER)
def paper_account(spark: S, sf: str) -> DataFrame:
    ledger = simulate.paper_accounts(account_days(spark, sf), RULES)
    return ledger.select("key", "rule", "d", "action", r(F.col("cash")).alias("cash"), r(F.col("units"), 9).alias("units"), r(F.col("value")).alias("value"), "trades")


@query(recursive.PERFORMANCE)
def account_performance(spark: S, sf: str) -> DataFrame:
    ledger = simulate.paper_accounts(account_days(spark, sf), RULES)
    both = simulate.performance(ledger, ("rule",)).join(simulate.no_loss_windows(ledger, 30, ("rule",), "d", "value"), "rule")
    return both.select("rule", "days", *[r(F.col(c)).alias(c) for c in ("total", "sharpe", "max_drawdown", "profit_factor")], "windows", *[r(F.col(c)).alias(c) for c in ("no_loss", "mean_ret")])


def policy_curves(spark: S, sf: str) -> DataFrame:
    s = signals(spark, sf).select("key", "h", (100 + F.col("close") / 10).alias("price"), "signal", "score", (F.abs(F.col("score")) / 50).alias("vol"), (0.6 + F.col("h") % 7 / 10).alias("p"))
    return simulate.policies(s, [0.0, 0.001], selectors=simulate.Selectors(least_scores=200, least_outcomes=20, days=20))


@query(recursive.POLICIES)
def policy_simulation(spark: S, sf: str) -> DataFrame:
    return policy_curves(spark, sf).groupBy("key", "cost", "policy").agg(r(F.max_by("equity", "h")).alias("final"), F.sum(F.col("action").isin("buy", "sell", "exit").cast("long")).alias("trades"), F.count("*").alias("hours"))


@query(recursive.CYCLES)
def cycles(spark: S, sf: str) -> DataFrame:
    return simulate.cycles(policy_curves(spark, sf), ("key", "cost", "policy"), "h", "exposure", "equity").withColumn("ret", r(F.col("ret")))


@query(f"""WITH {SIGNALS}, i AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY key) AS n, CASE WHEN signal = 'BUY' THEN 1 ELSE 0 END AS held, ret FROM sig WHERE ret IS NOT NULL), k AS (SELECT unnest(range(0, 51)) AS k),
m AS (SELECT a.key, k, avg(b.ret) AS m FROM i AS a CROSS JOIN k JOIN i AS b ON b.key = a.key AND b.i = (a.i + (k * a.n) // 51) % a.n WHERE a.held = 1 GROUP BY 1, 2), o AS (SELECT key, m AS own FROM m WHERE k = 0)
SELECT key, round(any_value(own), 6) AS own, round(avg((m <= own)::INT), 6) AS share FROM m JOIN o USING (key) WHERE k > 0 GROUP BY 1""")
def timing_null(spark: S, sf: str) -> DataFrame:
    s = signals(spark, sf).where("ret IS NOT NULL").select("key", "h", (F.col("signal") == "BUY").cast("int").alias("held"), "ret")
    return simulate.timing_null(s, "held", "ret", 50).select("key", r(F.col("own")).alias("own"), r(F.col("share")).alias("share"))


@query(f"WITH {DAILY}, b AS (SELECT (d // 30)::BIGINT AS block, count(*) AS days, arg_max(total, d) / arg_min(total, d) - 1 AS ret FROM daily GROUP BY 1) SELECT block, days, CASE WHEN ret > 0.05 THEN 'up' WHEN ret < -0.05 THEN 'down' ELSE 'flat' END AS class FROM b")
def regime_blocks(spark: S, sf: str) -> DataFrame:
    b = daily(spark, sf).groupBy(F.floor(F.col("d") / 30).cast("long").alias("block")).agg(F.count("*").alias("days"), (F.max_by("total", "d") / F.min_by("total", "d") - 1).alias("ret"))
    return b.select("block", "days", F.when(F.col("ret") > 0.05, "up").when(F.col("ret") < -0.05, "down").otherwise("flat").alias("class"))


@query("SELECT n_name, o_orderpriority, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2")
def revenue_by_nation(spark: S, sf: str) -> DataFrame:
    """Large tables join by shuffle or broadcast as their statistics say; filter and columns reach the scans."""
    t = lambda n: tables.table(spark, sf, n)
    lines = t("lineitem").where(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_extendedprice", "l_discount")
    j = lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: S, sf: str) -> DataFrame:
    lines = tables.table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), r(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, count(DISTINCT c_custkey) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def segments(spark: S, sf: str) -> DataFrame:
    j = tables.table(spark, sf, "customer").join(tables.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"), F.countDistinct("c_custkey").alias("customers"))


@query("SELECT (SELECT count(*) FROM orders) AS n")
def table_checksum(spark: S, sf: str) -> DataFrame:
    return sinks.checksum(tables.table(spark, sf, "orders")).select("n")
