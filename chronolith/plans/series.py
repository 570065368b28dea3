"""Queries on series: candles, validation, grids, joins on time, windows, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar, scoring
from ..operators import grid as G
from ..operators import joins as J
from ..operators import windows as W
from ..sources import payloads, sinks, tables
from . import recursive
from .base import CANDLES, DAILY, FORECAST, GRID, RETURNS, SIGNALS, daily, forecast, forward, grid, hourly, labelled, query, r, signals

S = SparkSession


def w_(n: int, until: int = 0):
    return G.trailing("h", n, until=until)


@query(f"WITH {CANDLES} SELECT key, h, open, high, low, close, round(volume, 6) AS volume, trades, round(taker, 6) AS taker FROM candles")
def hourly_candles(spark: S, sf: str) -> DataFrame:
    return hourly(spark, sf).withColumn("volume", r(F.col("volume"))).withColumn("taker", r(F.col("taker")))


@query("""WITH c AS (SELECT event_type AS key, (epoch(date_trunc('hour', ts)) // 3600)::BIGINT AS h, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2),
o AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY key ORDER BY h), close) AS open FROM c) SELECT key, h, open, greatest(open, close) AS high, least(open, close) AS low, close FROM o""")
def last_print_candles(spark: S, sf: str) -> DataFrame:
    return tables.last_print_candles(tables.table(spark, sf, "events"))


@query(f"""WITH {CANDLES}, n AS (SELECT max(h) AS now FROM candles) SELECT key, h, close FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY h DESC) AS rn FROM candles, n WHERE h + 1 <= now) WHERE rn <= 24""")
def latest_closed(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf)
    now = c.agg(F.max("h")).first()[0]
    return tables.latest_closed(c, now or 0, 24).select("key", "h", "close")


@query(f"""WITH {CANDLES}, e AS (SELECT key, CASE WHEN least(open, high, low, close) <= 0.05 THEN 'small' WHEN high < greatest(open, close) OR low > least(open, close) THEN 'range' ELSE 'ok' END AS verdict FROM candles)
SELECT key, verdict, count(*) AS n FROM e GROUP BY 1, 2""")
def candle_validation(spark: S, sf: str) -> DataFrame:
    error = tables.candle_error()
    small = F.least("open", "high", "low", "close") <= 0.05
    return hourly(spark, sf).select("key", F.when(small, "small").otherwise(F.coalesce(error, F.lit("ok"))).alias("verdict")).groupBy("key", "verdict").agg(F.count("*").alias("n"))


@query(f"WITH {CANDLES} SELECT key, count(*) AS n, min(h) AS first, max(h) AS last, 0::BIGINT AS not_increasing, sum(CASE WHEN step > 1 THEN 1 ELSE 0 END)::BIGINT AS irregular FROM (SELECT *, h - lag(h) OVER (PARTITION BY key ORDER BY h) AS step FROM candles) GROUP BY key")
def series_integrity(spark: S, sf: str) -> DataFrame:
    return tables.integrity(hourly(spark, sf).select("key", "h"), "h", ["key"]).drop("checksum")


@query(f"WITH {GRID} SELECT key, h FROM g WHERE close IS NULL")
def missing_hours(spark: S, sf: str) -> DataFrame:
    return G.missing_steps(hourly(spark, sf))


@query(f"WITH {CANDLES}, s AS (SELECT key, h, lag(h) OVER (PARTITION BY key ORDER BY h) AS p FROM candles) SELECT key, p + 1 AS start, h - p - 1 AS hours FROM s WHERE h - p > 1")
def gap_report(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf).withColumn("p", F.lag("h").over(Window.partitionBy("key").orderBy("h")))
    return c.where("h - p > 1").select("key", (F.col("p") + 1).alias("start"), (F.col("h") - F.col("p") - 1).alias("hours"))


@query(f"WITH {GRID} SELECT key, count(*) AS steps, count(close) AS known FROM g GROUP BY key")
def grid_fill(spark: S, sf: str) -> DataFrame:
    return grid(spark, sf).groupBy("key").agg(F.count("*").alias("steps"), F.count("close").alias("known"))


@query(f"WITH {GRID}, k AS (SELECT unnest([1, 6, 24, 72, 168]) AS horizon) SELECT g.key, g.h, horizon, round(n.close / g.close - 1, 6) AS ret FROM g CROSS JOIN k LEFT JOIN g AS n ON n.key = g.key AND n.h = g.h + horizon WHERE g.close IS NOT NULL")
def forward_returns(spark: S, sf: str) -> DataFrame:
    g = hourly(spark, sf).select("key", "h", "close")
    return J.at_shifts(g, [1, 6, 24, 72, 168], "close").select("key", "h", F.col("shift").alias("horizon"), r(F.col("later") / F.col("close") - 1).alias("ret"))


@query(f"WITH {GRID} SELECT g.key, g.h, round(g.close / p.close - 1, 6) AS momentum FROM g LEFT JOIN g AS p ON p.key = g.key AND p.h = g.h - 24 WHERE g.close IS NOT NULL")
def lagged_momentum(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf).select("key", "h", "close")
    return J.at_shift(c, -24, {"close": "then"}).select("key", "h", r(F.col("close") / F.col("then") - 1).alias("momentum"))


@query(f"""WITH {RETURNS}, y AS (SELECT *, CASE WHEN ret IS NULL THEN NULL WHEN abs(ret) > 0.5 THEN 1 ELSE 0 END AS large FROM fwd),
a AS (SELECT (h % 24 // 6)::INT AS block, count(large) AS n, sum(large)::BIGINT AS large FROM y GROUP BY 1), p AS (SELECT *, large / n AS share, 1 + 1.96 * 1.96 / n AS s FROM a),
q AS (SELECT *, (share + 1.96 * 1.96 / (2 * n)) / s AS c, 1.96 * sqrt(share * (1 - share) / n + 1.96 * 1.96 / (4 * n * n)) / s AS w FROM p)
SELECT block, n, large, round(share, 6) AS share, round(least(greatest(c - w, 0), share), 6) AS low, round(greatest(least(c + w, 1), share), 6) AS high FROM q""")
def large_move_share(spark: S, sf: str) -> DataFrame:
    g = labelled(spark, sf).groupBy(scalar.six_hour_block(F.col("h")).alias("block")).agg(F.count("y").alias("n"), F.sum("y").alias("large"))
    low, high = scalar.wilson(F.col("large"), F.col("n"))
    return g.select("block", "n", "large", r(F.col("large") / F.col("n")).alias("share"), r(low).alias("low"), r(high).alias("high"))


LOGS = GRID + ", lr AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY key ORDER BY h)) AS lr FROM g)"


def log_returns(spark: S, sf: str) -> DataFrame:
    return grid(spark, sf).withColumn("lr", F.log("close") - F.log(F.lag("close").over(Window.partitionBy("key").orderBy("h"))))


@query(f"""WITH {LOGS}, v AS (SELECT key, h, CASE WHEN count(lr) OVER a = 6 THEN stddev_samp(lr) OVER a END AS rv_6, CASE WHEN count(lr) OVER b = 24 THEN stddev_samp(lr) OVER b END AS rv_24 FROM lr
WINDOW a AS (PARTITION BY key ORDER BY h ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), b AS (PARTITION BY key ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT key, h, round(rv_6, 6) AS rv_6, round(rv_24, 6) AS rv_24, round(rv_6 / rv_24, 6) AS vol_ratio FROM v WHERE rv_6 IS NOT NULL""")
def realised_vol(spark: S, sf: str) -> DataFrame:
    rv = lambda n: G.full(F.stddev_samp("lr"), F.col("lr"), n, w_(n))
    v = log_returns(spark, sf).select("key", "h", rv(6).alias("a"), rv(24).alias("b")).where("a IS NOT NULL")
    return v.select("key", "h", r(F.col("a")).alias("rv_6"), r(F.col("b")).alias("rv_24"), r(F.col("a") / F.col("b")).alias("vol_ratio"))


@query(f"""WITH {LOGS}, v AS (SELECT key, h, count(lr) OVER b AS n, stddev_pop(lr) OVER b AS vol FROM lr WINDOW b AS (PARTITION BY key ORDER BY h ROWS BETWEEN 71 PRECEDING AND CURRENT ROW))
SELECT key, h, round(vol, 6) AS vol FROM v WHERE n >= 48""")
def regime_vol(spark: S, sf: str) -> DataFrame:
    v = log_returns(spark, sf).select("key", "h", F.count("lr").over(w_(72)).alias("n"), F.stddev_pop("lr").over(w_(72)).alias("vol"))
    return v.where("n >= 48").select("key", "h", r(F.col("vol")).alias("vol"))


@query(f"""WITH {GRID}, t AS (SELECT *, lag(close) OVER (PARTITION BY key ORDER BY h) AS pc FROM g), u AS (SELECT *, CASE WHEN high IS NOT NULL AND pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM t),
a AS (SELECT key, h, close, count(tr) OVER w AS n, avg(tr) OVER w AS m FROM u WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) SELECT key, h, round(m / close, 6) AS atr FROM a WHERE n = 14""")
def true_range_mean(spark: S, sf: str) -> DataFrame:
    g = grid(spark, sf).withColumn("pc", F.lag("close").over(Window.partitionBy("key").orderBy("h")))
    tr = F.when(F.col("high").isNotNull() & F.col("pc").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("pc")), F.abs(F.col("low") - F.col("pc"))))
    a = g.withColumn("tr", tr).withColumn("m", G.full(F.avg("tr"), F.col("tr"), 14, w_(14))).where("m IS NOT NULL")
    return a.select("key", "h", r(F.col("m") / F.col("close")).alias("atr"))


@query(f"""WITH {GRID}, a AS (SELECT key, h, count(close) OVER w AS n, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s FROM g WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT key, h, round(4 * s / m, 6) AS width FROM a WHERE n = 20""")
def bollinger_width(spark: S, sf: str) -> DataFrame:
    a = grid(spark, sf).select("key", "h", G.full(F.avg("close"), F.col("close"), 20, w_(20)).alias("m"), F.stddev_samp("close").over(w_(20)).alias("s")).where("m IS NOT NULL")
    return a.select("key", "h", r(4 * F.col("s") / F.col("m")).alias("width"))


@query(f"""WITH {GRID}, a AS (SELECT key, h, count(high) OVER w AS n, avg(ln(high / low) * ln(high / low)) OVER w AS m FROM g WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT key, h, round(sqrt(m / (4 * ln(2))), 6) AS parkinson FROM a WHERE n = 24""")
def parkinson(spark: S, sf: str) -> DataFrame:
    """A low of 0 is a known hour: its range, and the mean of any window with it, is infinite, or NaN where the high is 0 too."""
    x = scalar.float_log(scalar.float_ratio(F.col("high"), F.col("low")))
    g = grid(spark, sf).withColumn("x", x * x)
    return g.withColumn("m", G.full(F.avg("x"), F.col("x"), 24, w_(24))).where("m IS NOT NULL").select("key", "h", r(F.sqrt(F.col("m") / (4 * F.log(F.lit(2.0))))).alias("parkinson"))


@query(f"""WITH {GRID}, a AS (SELECT key, h, close, count(close) OVER f AS n, list(close) OVER b AS before FROM g WINDOW f AS (PARTITION BY key ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), b AS (PARTITION BY key ORDER BY h ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING))
SELECT key, h, round(len(list_filter(before, lambda x: x < close)) / 23.0, 6) AS share FROM a WHERE n = 24""")
def rank_pct(spark: S, sf: str) -> DataFrame:
    return grid(spark, sf).withColumn("share", r(W.rank_share("close", 24))).where("share IS NOT NULL").select("key", "h", "share")


@query(f"WITH {GRID}, a AS (SELECT key, h, close / lag(close, 24) OVER w - 1 AS d1, close / lag(close, 168) OVER w - 1 AS d7 FROM g WINDOW w AS (PARTITION BY key ORDER BY h)) SELECT key, h, round(d1, 6) AS d1, round(d7, 6) AS d7 FROM a WHERE d1 IS NOT NULL")
def trailing_returns(spark: S, sf: str) -> DataFrame:
    w = Window.partitionBy("key").orderBy("h")
    a = grid(spark, sf).select("key", "h", *[r(F.col("close") / F.lag("close", n).over(w) - 1).alias(c) for c, n in (("d1", 24), ("d7", 168))])
    return a.where("d1 IS NOT NULL")


@query(f"WITH {GRID}, a AS (SELECT key, h, close, count(close) OVER w AS n, avg(close) OVER w AS m FROM g WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT key, h, round(close / m - 1, 6) AS distance FROM a WHERE n = 12")
def sma_distance(spark: S, sf: str) -> DataFrame:
    a = grid(spark, sf).withColumn("m", G.full(F.avg("close"), F.col("close"), 12, w_(12))).where("m IS NOT NULL")
    return a.select("key", "h", r(F.col("close") / F.col("m") - 1).alias("distance"))


@query(f"WITH {GRID}, a AS (SELECT key, h, close, count(close) OVER w AS n, max(high) OVER w AS hi, min(low) OVER w AS lo FROM g WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT key, h, round((close - lo) / (hi - lo), 6) AS place FROM a WHERE n = 12 AND hi > lo")
def donchian(spark: S, sf: str) -> DataFrame:
    a = grid(spark, sf).select("key", "h", "close", G.full(F.max("high"), F.col("close"), 12, w_(12)).alias("hi"), F.min("low").over(w_(12)).alias("lo"))
    return a.where("hi IS NOT NULL").select("key", "h", r(scalar.ratio(F.col("close") - F.col("lo"), F.col("hi") - F.col("lo"))).alias("place")).where("place IS NOT NULL")


@query(f"WITH {GRID}, a AS (SELECT key, h, volume, count(volume) OVER w AS n, avg(volume) OVER w AS m FROM g WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) SELECT key, h, round(volume / m, 6) AS ratio FROM a WHERE n = 12 AND m > 0 AND volume IS NOT NULL")
def prior_mean_ratio(spark: S, sf: str) -> DataFrame:
    a = grid(spark, sf).withColumn("m", G.full(F.avg("volume"), F.col("volume"), 12, w_(12, -1)))
    return a.select("key", "h", r(scalar.ratio(F.col("volume"), F.col("m"))).alias("ratio")).where("ratio IS NOT NULL")


@query(f"WITH {GRID}, a AS (SELECT key, h, count(volume) OVER w AS n, sum(taker) OVER w AS t, sum(volume) OVER w AS v FROM g WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) SELECT key, h, round(t / v, 6) AS share FROM a WHERE n = 6 AND v > 0")
def taker_share(spark: S, sf: str) -> DataFrame:
    a = grid(spark, sf).select("key", "h", G.full(F.sum("taker"), F.col("volume"), 6, w_(6)).alias("t"), F.sum("volume").over(w_(6)).alias("v"))
    return a.select("key", "h", r(scalar.ratio(F.col("t"), F.col("v"))).alias("share")).where("share IS NOT NULL")


@query(f"""WITH {LOGS}, p AS (SELECT *, lag(lr) OVER (PARTITION BY key ORDER BY h) AS before FROM lr), a AS (SELECT key, h, count(lr + before) OVER w AS n, corr(lr, before) OVER w AS c FROM p WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN 22 PRECEDING AND CURRENT ROW))
SELECT key, h, round(c, 6) AS autocorr FROM a WHERE n = 23""")
def autocorr(spark: S, sf: str) -> DataFrame:
    p = log_returns(spark, sf).withColumn("before", F.lag("lr").over(Window.partitionBy("key").orderBy("h")))
    return p.withColumn("c", G.full(F.corr("lr", "before"), F.col("lr") + F.col("before"), 23, w_(23))).where("c IS NOT NULL").select("key", "h", r(F.col("c")).alias("autocorr"))


@query(f"""WITH {LOGS}, s AS (SELECT key, h, coalesce(sign(lr), 0) AS s FROM lr), n AS (SELECT *, CASE WHEN lag(s) OVER w = s THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY key ORDER BY h)),
q AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY h) AS run FROM n) SELECT key, h, (s * least(row_number() OVER (PARTITION BY key, run ORDER BY h), 6))::BIGINT AS streak FROM q""")
def streak(spark: S, sf: str) -> DataFrame:
    return W.streak(log_returns(spark, sf).select("key", "h", "lr"), "lr").select("key", "h", "streak")


@query(f"""WITH {SIGNALS}, n AS (SELECT key, h, signal, CASE WHEN lag(signal) OVER w = signal AND h - lag(h) OVER w = 1 THEN 0 ELSE 1 END AS new FROM sig WINDOW w AS (PARTITION BY key ORDER BY h)),
q AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY h) AS k FROM n) SELECT key, h, signal, row_number() OVER (PARTITION BY key, k ORDER BY h) AS run FROM q""")
def run_lengths(spark: S, sf: str) -> DataFrame:
    return W.run_lengths(signals(spark, sf).select("key", "h", "signal"), "signal")


@query(f"""WITH {CANDLES}, n AS (SELECT key, h, CASE WHEN h - lag(h) OVER w = 1 THEN 0 ELSE 1 END AS new FROM candles WINDOW w AS (PARTITION BY key ORDER BY h)), q AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY h) AS k FROM n)
SELECT key, h, row_number() OVER (PARTITION BY key, k ORDER BY h) AS tail FROM q""")
def session_tail(spark: S, sf: str) -> DataFrame:
    return W.session_tail(hourly(spark, sf).select("key", "h"))


@query(f"""WITH {RETURNS}, k AS (SELECT key, h + 1 AS seen, abs(ret) AS m FROM fwd WHERE ret IS NOT NULL), v AS (SELECT key, seen, CASE WHEN count(m) OVER w >= 24 THEN quantile_cont(m, 0.5) OVER w END AS med FROM k
WINDOW w AS (PARTITION BY key ORDER BY seen RANGE BETWEEN 71 PRECEDING AND CURRENT ROW)), c AS (SELECT key, h FROM g WHERE close IS NOT NULL)
SELECT c.key, c.h, round(CASE WHEN c.h - seen <= 6 THEN med END, 6) AS threshold FROM c ASOF JOIN v ON c.key = v.key AND c.h >= v.seen""")
def vol_scaled_threshold(spark: S, sf: str) -> DataFrame:
    f = forward(spark, sf).where("ret IS NOT NULL").select("key", (F.col("h") + 1).alias("at"), F.abs("ret").alias("m"))
    w = Window.partitionBy("key").orderBy("at").rangeBetween(-71, 0)
    v = f.select("key", "at", F.when(F.count("m").over(w) >= 24, F.percentile("m", F.lit(0.5)).over(w)).alias("med"))
    c = hourly(spark, sf).select("key", "h")
    out = J.asof(c, v.withColumn("seen", F.col("at")), ["med", "seen"], "h", "at", ("key",), tolerance=None).where("known_at IS NOT NULL")
    return out.select("key", "h", r(F.when(F.col("h") - F.col("seen") <= 6, F.col("med"))).alias("threshold"))


@query(f"""WITH {RETURNS}, y AS (SELECT key, h, CASE WHEN ret IS NULL THEN NULL WHEN abs(ret) > 0.5 THEN 1 ELSE 0 END AS y FROM fwd), a AS (SELECT key, h, count(y) OVER w AS n, avg(y) OVER w AS rate, count(y) OVER e AS ne, avg(y) OVER e AS base FROM y
WINDOW w AS (PARTITION BY key ORDER BY h RANGE BETWEEN 23 PRECEDING AND CURRENT ROW), e AS (PARTITION BY key ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT key, h, round(CASE WHEN n >= 12 THEN rate END, 6) AS rate, round(CASE WHEN ne >= 72 THEN base END, 6) AS base FROM a""")
def trailing_rate(spark: S, sf: str) -> DataFrame:
    by = Window.partitionBy("key").orderBy("h")
    near, every = by.rangeBetween(-23, 0), by.rowsBetween(Window.unboundedPreceding, 0)
    rate = lambda w, n: r(F.when(F.count("y").over(w) >= n, F.avg("y").over(w)))
    return labelled(spark, sf).select("key", "h", rate(near, 12).alias("rate"), rate(every, 72).alias("base"))


@query(f"""WITH {RETURNS}, y AS (SELECT key, h, CASE WHEN ret IS NULL THEN NULL WHEN abs(ret) > 0.5 THEN 1.0 ELSE 0.0 END AS y FROM fwd), k AS (SELECT * FROM y WHERE y IS NOT NULL)
SELECT a.key, a.h, round(sum(pow(0.5, (a.h - b.h) / 24.0) * b.y) / sum(pow(0.5, (a.h - b.h) / 24.0)), 6) AS rate FROM y AS a JOIN k AS b ON b.key = a.key AND b.h <= a.h AND b.h >= a.h - 960 GROUP BY 1, 2""")
def ewma_rate(spark: S, sf: str) -> DataFrame:
    return labelled(spark, sf).select("key", "h", "y").withColumn("rate", r(W.decayed_mean("y", "h", 24.0))).where("rate IS NOT NULL").select("key", "h", "rate")


@query(f"WITH {SIGNALS}, a AS (SELECT key, h, count(*) OVER w AS n, quantile_cont(abs(score), 0.9) OVER w AS q FROM sig WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT key, h, round(CASE WHEN n >= 100 THEN q END, 6) AS strong FROM a")
def expanding_quantile(spark: S, sf: str) -> DataFrame:
    s = signals(spark, sf).select("key", "h", F.abs("score").alias("x"))
    return W.expanding_quantile(s, "x", 0.9, 100, "strong").select("key", "h", r(F.col("strong")).alias("strong"))


@query(f"WITH {GRID}, a AS (SELECT key, h, close, count(close) OVER w AS n, max(close) OVER w AS hi, min(close) OVER w AS lo FROM g WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) SELECT key, h, CASE WHEN close > hi THEN 'up' WHEN close < lo THEN 'down' ELSE 'inside' END AS breakout FROM a WHERE n = 12 AND close IS NOT NULL")
def breakout(spark: S, sf: str) -> DataFrame:
    a = grid(spark, sf).select("key", "h", "close", G.full(F.max("close"), F.col("close"), 12, w_(12, -1)).alias("hi"), F.min("close").over(w_(12, -1)).alias("lo")).where("hi IS NOT NULL AND close IS NOT NULL")
    return a.select("key", "h", F.when(F.col("close") > F.col("hi"), "up").when(F.col("close") < F.col("lo"), "down").otherwise("inside").alias("breakout"))


@query(f"WITH {DAILY}, a AS (SELECT d, total, avg(total) OVER w AS m, count(*) OVER w AS n, max(total) OVER p AS peak FROM daily WINDOW w AS (ORDER BY d ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), p AS (ORDER BY d)) SELECT d, round(total / m - 1, 6) AS above, round(1 - total / peak, 6) AS drawdown FROM a WHERE n = 50")
def daily_sma(spark: S, sf: str) -> DataFrame:
    w = Window.orderBy("d")  # one row a day: a few thousand rows whatever the size of orders
    a = daily(spark, sf).select("d", "total", F.avg("total").over(w.rowsBetween(-49, 0)).alias("m"), F.count("*").over(w.rowsBetween(-49, 0)).alias("n"), F.max("total").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))
    return a.where("n = 50").select("d", r(F.col("total") / F.col("m") - 1).alias("above"), r(1 - F.col("total") / F.col("peak")).alias("drawdown"))


DAYSIDE = """dv AS (SELECT event_type AS key, (epoch(date_trunc('day', ts)) // 3600)::BIGINT + 30 AS seen, sum(value) AS v FROM events GROUP BY 1, 2)"""


def day_side(spark: S, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("key"), (F.floor(scalar.epoch_hour(F.col("ts")) / 24) * 24 + 30).cast("long").alias("at")).agg(F.sum("value").alias("v"))


@query(f"WITH {CANDLES}, {DAYSIDE} SELECT c.key, c.h, round(v, 6) AS v, seen AS known_at FROM candles AS c ASOF LEFT JOIN dv ON c.key = dv.key AND c.h >= dv.seen")
def asof_daily(spark: S, sf: str) -> DataFrame:
    out = J.asof(hourly(spark, sf).select("key", "h"), day_side(spark, sf), ["v"], "h", "at", ("key",))
    return out.select("key", "h", r(F.col("v")).alias("v"), "known_at")


@query(f"WITH {CANDLES}, {DAYSIDE}, o AS (SELECT *, v / lag(v, 5) OVER (PARTITION BY key ORDER BY seen) - 1 AS change FROM dv) SELECT c.key, c.h, round(change, 6) AS change FROM candles AS c ASOF LEFT JOIN o ON c.key = o.key AND c.h >= o.seen")
def asof_offset_change(spark: S, sf: str) -> DataFrame:
    o = day_side(spark, sf).withColumn("change", F.col("v") / F.lag("v", 5).over(Window.partitionBy("key").orderBy("at")) - 1)
    return J.asof(hourly(spark, sf).select("key", "h"), o, ["change"], "h", "at", ("key",)).select("key", "h", r(F.col("change")).alias("change"))


@query(f"WITH {CANDLES}, {DAYSIDE} SELECT c.key, c.h, round(CASE WHEN c.h - seen <= 12 THEN v END, 6) AS v FROM candles AS c ASOF LEFT JOIN dv ON c.key = dv.key AND c.h >= dv.seen")
def asof_tolerance(spark: S, sf: str) -> DataFrame:
    return J.asof(hourly(spark, sf).select("key", "h"), day_side(spark, sf), ["v"], "h", "at", ("key",), tolerance=12).select("key", "h", r(F.col("v")).alias("v"))


@query("""WITH q AS (SELECT event_id, user_id, epoch_us(ts) AS t, value AS bid FROM events WHERE event_type = 'view'), s AS (SELECT user_id, epoch_us(ts) AS t, value AS price FROM events WHERE event_type = 'purchase')
SELECT q.event_id, count(*) AS trades, bool_or(price < bid) AS filled FROM q JOIN s ON q.user_id % 10 = s.user_id % 10 AND s.t > q.t AND s.t <= q.t + 3600000000 GROUP BY 1""")
def passive_fill(spark: S, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events").withColumn("desk", F.col("user_id") % 10).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    quotes = e.where("event_type = 'view'").select("event_id", "desk", "t", F.col("value").alias("bid"))
    trades = e.where("event_type = 'purchase'").select("desk", F.col("t").alias("at"), F.col("value").alias("price"))
    return J.interval(quotes, trades, "t", "at", 3_600_000_000, ("desk",)).groupBy("event_id").agg(F.count("*").alias("trades"), F.max(F.col("price") < F.col("bid")).alias("filled"))


@query(f"WITH {RETURNS}, due AS (SELECT key, h FROM g WHERE close IS NOT NULL AND h + 2 <= (SELECT max(h) FROM candles)) SELECT d.key, d.h FROM due AS d ANTI JOIN (SELECT key, h FROM fwd WHERE ret IS NOT NULL) AS o ON o.key = d.key AND o.h = d.h")
def awaiting_outcome(spark: S, sf: str) -> DataFrame:
    f = forward(spark, sf)
    now = f.agg(F.max("h").alias("now"))
    due = f.where("close IS NOT NULL").join(F.broadcast(now), F.col("h") + 2 <= F.col("now")).select("key", "h")
    return due.join(f.where("ret IS NOT NULL").select("key", "h"), ["key", "h"], "left_anti")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark: S, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")


@query("SELECT event_type, round(avg((props::JSON ->> '$.k')::DOUBLE), 6) AS mean_k, max((props::JSON ->> '$.k')::INT) AS max_k FROM events GROUP BY 1")
def json_extract(spark: S, sf: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return tables.table(spark, sf, "events").groupBy("event_type").agg(r(F.avg(k)).alias("mean_k"), F.max(k).alias("max_k"))


@query("""WITH b AS (SELECT user_id, list({'p': 100 + value / 100, 's': value} ORDER BY event_id) AS levels FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, round(coalesce(list_sum(list_transform(list_filter(levels, lambda x: abs(x.p - 100) <= 1), lambda x: x.p * x.s)), 0), 6) AS depth FROM b""")
def order_book_depth(spark: S, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events").where("event_type = 'click'")
    b = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (100 + F.col("value") / 100).alias("price"), F.col("value").alias("size")))).alias("levels"))
    return b.select("user_id", r(payloads.book_depth(F.col("levels"), F.lit(100.0), 0.01)).alias("depth"))


@query(recursive.BOOK_WALK)
def order_book_walk(spark: S, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events")
    b = e.groupBy("event_type", "user_id").agg(F.array_sort(F.collect_list(F.struct((100 + F.col("value") / 100).alias("price"), F.col("value").alias("size")))).alias("levels"))
    return b.select("event_type", "user_id", r(payloads.walk_book(F.col("levels"), 5000.0)).alias("fill"))


@query("""WITH i AS (SELECT doc_id, (doc_id * 7 % 100)::INT AS age FROM documents) SELECT CASE WHEN age = 0 THEN 'undated' WHEN age < 10 THEN 'after_cutoff' WHEN age >= 34 THEN 'too_old' ELSE 'eligible' END AS reason, count(*) AS n FROM i GROUP BY 1""")
def news_window(spark: S, sf: str) -> DataFrame:
    age = F.col("doc_id") * 7 % 100
    reason = F.when(age == 0, "undated").when(age < 10, "after_cutoff").when(age >= 34, "too_old").otherwise("eligible")
    return tables.table(spark, sf, "documents").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query()
def headline_dedup(spark: S, sf: str) -> DataFrame:
    """The first line of each document is its headline; documents have no time, so the whole table is one window, in order of ids."""
    d = tables.table(spark, sf, "documents")
    heads = d.select("doc_id", scalar.normal_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))
    return J.near_duplicates_of_all(heads, "doc_id", "title")


@query(f"WITH {CANDLES}, {DAYSIDE.replace('dv AS', 'dv0 AS')}, a AS (SELECT key, h, close FROM candles WHERE h % 5 <> 0), b AS (SELECT key, h, CASE WHEN h % 7 = 0 THEN close + 1 ELSE close END AS close FROM candles WHERE h % 11 <> 0) SELECT CASE WHEN a.h IS NULL THEN 'right' WHEN b.h IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.key = b.key AND a.h = b.h WHERE a.close IS DISTINCT FROM b.close GROUP BY 1")
def parity_report(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf).select("key", "h", "close")
    a, b = c.where("h % 5 <> 0"), c.where("h % 11 <> 0").withColumn("close", F.when(F.col("h") % 7 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return J.differences(a, b, ["key", "h"], ["close"], scalar.close_to).groupBy("side").agg(F.count("*").alias("n"))


@query(f"WITH {CANDLES}, a AS (SELECT key, h, close FROM candles WHERE h % 3 = 0), n AS (SELECT key, h, close FROM candles WHERE h % 2 = 0) SELECT key, h, close FROM a UNION ALL SELECT n.* FROM n ANTI JOIN a USING (key, h)")
def append_once(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf).select("key", "h", "close")
    old = c.where("h % 3 = 0")
    return old.unionByName(sinks.append_once(old, c.where("h % 2 = 0"), ["key", "h"], ["close"]))


@query(f"WITH {CANDLES} SELECT key, h, CASE WHEN h % 3 = 0 THEN close ELSE close + 1 END AS outcome FROM candles")
def fill_once(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf)
    old = c.select("key", "h", F.when(F.col("h") % 3 == 0, F.col("close")).alias("outcome"))
    return sinks.fill_once(old, c.select("key", "h", (F.col("close") + 1).alias("outcome")), ["key", "h"], ["outcome"], "outcome")


@query(f"WITH {CANDLES}, o AS (SELECT key, h, floor(close) AS v FROM candles WHERE h % 2 = 0), n AS (SELECT key, h, round(close) AS v FROM candles WHERE h % 3 = 0) SELECT count(*) AS changed FROM n LEFT JOIN o USING (key, h) WHERE n.v IS DISTINCT FROM o.v")
def upsert_changed(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf)
    old, new = c.where("h % 2 = 0").select("key", "h", F.floor("close").cast("double").alias("v")), c.where("h % 3 = 0").select("key", "h", F.round("close").alias("v"))
    return sinks.upsert_changed(old, new, ["key", "h"], "v")[1].agg(F.count("*").alias("changed"))


@query("SELECT user_id, event_type, round(value, 2) AS value, count(*) AS copies FROM (SELECT user_id, event_type, floor(value / 50) AS value FROM events) GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_ordinal(spark: S, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events").select("user_id", "event_type", F.floor(F.col("value") / 50).cast("double").alias("value"))
    n = F.row_number().over(Window.partitionBy("user_id", "event_type", "value").orderBy("value"))
    return e.withColumn("n", n).groupBy("user_id", "event_type", "value").agg(F.max("n").cast("long").alias("copies")).where("copies > 1")


@query(f"WITH {FORECAST} SELECT key, h, p, least(floor((rn - 1) * 10.0 / n), 9)::INT AS decile FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, h) AS rn, count(*) OVER (PARTITION BY key) AS n FROM fc)")
def deciles(spark: S, sf: str) -> DataFrame:
    w = Window.partitionBy("key")
    f = forecast(spark, sf).select("key", "h", "p", F.row_number().over(w.orderBy("p", "h")).alias("rn"), F.count("*").over(w).alias("n"))
    return f.select("key", "h", "p", F.least(F.floor((F.col("rn") - 1) * 10.0 / F.col("n")), F.lit(9)).cast("int").alias("decile"))


@query(f"""WITH {RETURNS} SELECT key, h, CASE WHEN ret > 0 THEN 'UP' ELSE 'DOWN' END AS two, CASE WHEN ret > 0.2 THEN 'UP' WHEN ret < -0.2 THEN 'DOWN' ELSE 'FLAT' END AS three FROM fwd WHERE ret IS NOT NULL""")
def three_class_labels(spark: S, sf: str) -> DataFrame:
    return forward(spark, sf).where("ret IS NOT NULL").select("key", "h", scoring.binary_label(F.col("ret")).alias("two"), scoring.three_class(F.col("ret"), F.lit(0.2)).alias("three"))


@query(f"WITH {CANDLES}, b AS (SELECT min(h) AS a, max(h) AS z FROM candles) SELECT CASE WHEN h < a + 240 THEN 'explore' WHEN h < a + 480 THEN 'validate' ELSE 'sealed' END AS period, count(*) AS n, count(*) FILTER (WHERE (h + 24 < a + 240) = (h < a + 240) AND (h + 24 < a + 480) = (h < a + 480)) AS inside FROM candles, b GROUP BY 1")
def period_split(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf)
    a = c.agg(F.min("h").alias("a"))
    period = lambda h: F.when(h < F.col("a") + 240, "explore").when(h < F.col("a") + 480, "validate").otherwise("sealed")
    x = c.join(F.broadcast(a)).select(period(F.col("h")).alias("period"), period(F.col("h") + 24).alias("after"))
    return x.groupBy("period").agg(F.count("*").alias("n"), F.sum((F.col("period") == F.col("after")).cast("long")).alias("inside"))


@query(f"""WITH {GRID}, a AS (SELECT key, h, count(lr) OVER w AS n, stddev_samp(lr) OVER w AS v FROM (SELECT key, h, ln(close) - ln(lag(close) OVER (PARTITION BY key ORDER BY h)) AS lr FROM g) WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) SELECT key, h, round(v, 6) AS rv_6 FROM a WHERE n = 6""")
def chunked_vol(spark: S, sf: str) -> DataFrame:
    """As realised_vol, with one long series dealt into chunks of time with halos, so that it doesn't run in one task."""
    g = log_returns(spark, sf).select("key", "h", "lr")
    w = Window.partitionBy("key", "chunk").orderBy("h").rowsBetween(-5, 0)
    v = G.with_halo(g, 168, 6).withColumn("v", F.when(F.count("lr").over(w) == 6, F.stddev_samp("lr").over(w)))
    return v.where("own AND v IS NOT NULL").select("key", "h", r(F.col("v")).alias("rv_6"))
