"""Queries with the reference's own window lengths, feature groups, reproduction of stored scores, sealed rows, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar, scoring
from ..functions.features import features
from ..operators import grid as G
from ..operators import simulate, stats, strategies, views
from ..operators.indicators import indicators
from ..sources import tables
from . import recursive
from .base import CANDLES, DAILY, FORECAST, GRID, SIGNALS, daily, forecast, grid, hourly, query, r, signals
from .evaluation import MODEL
from .series import LOGS, log_returns

S = SparkSession


@query(f"""WITH {LOGS}, v AS (SELECT key, h, {", ".join(f"CASE WHEN count(lr) OVER w{n} = {n} THEN stddev_samp(lr) OVER w{n} END AS rv_{n}" for n in (24, 168, 720))}, CASE WHEN count(lr) OVER w720 >= 480 THEN stddev_pop(lr) OVER w720 END AS regime FROM lr
WINDOW {", ".join(f"w{n} AS (PARTITION BY key ORDER BY h ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (24, 168, 720))})
SELECT key, h, round(rv_24, 6) AS rv_24, round(rv_168, 6) AS rv_168, round(rv_720, 6) AS rv_720, round(regime, 6) AS regime FROM v WHERE rv_24 IS NOT NULL OR regime IS NOT NULL""")
def long_vol(spark: S, sf: str) -> DataFrame:
    """Realised volatility over a day, a week and 30 days, and that of regimes, which needs 480 of 720 rows."""
    w = lambda n: G.trailing("h", n)
    rv = [G.full(F.stddev_samp("lr"), F.col("lr"), n, w(n)).alias(f"rv_{n}") for n in (24, 168, 720)]
    regime = F.when(F.count("lr").over(w(720)) >= 480, F.stddev_pop("lr").over(w(720))).alias("regime")
    v = log_returns(spark, sf).select("key", "h", *rv, regime).where("rv_24 IS NOT NULL OR regime IS NOT NULL")
    return v.select("key", "h", *[r(F.col(c)).alias(c) for c in ("rv_24", "rv_168", "rv_720", "regime")])


@query(f"""WITH {DAILY}, s AS (SELECT unnest(range((SELECT min(d) FROM daily), (SELECT max(d) + 1 FROM daily))) AS d), x AS (SELECT s.d, total, ln(total) - ln(lag(total) OVER (ORDER BY s.d)) AS lr FROM s LEFT JOIN daily USING (d)),
y AS (SELECT d, total, CASE WHEN count(lr) OVER m >= 20 THEN stddev_samp(lr) OVER m END AS vol_30, CASE WHEN count(total) OVER w = 7 THEN avg(total) OVER w END AS mean_7 FROM x WINDOW m AS (ORDER BY d ROWS 29 PRECEDING), w AS (ORDER BY d ROWS 6 PRECEDING))
SELECT d, round(vol_30, 6) AS vol_30, round(mean_7, 2) AS mean_7 FROM y WHERE total IS NOT NULL""")
def daily_risk(spark: S, sf: str) -> DataFrame:
    w = Window.orderBy("d")  # a row a day
    month, week = w.rowsBetween(-29, 0), w.rowsBetween(-6, 0)
    x = G.densify(daily(spark, sf), "d", ()).withColumn("lr", F.log("total") - F.log(F.lag("total").over(w)))
    y = x.select("d", "total", F.when(F.count("lr").over(month) >= 20, F.stddev_samp("lr").over(month)).alias("vol_30"), G.full(F.avg("total"), F.col("total"), 7, week).alias("mean_7"))
    return y.where("total IS NOT NULL").select("d", r(F.col("vol_30")).alias("vol_30"), r(F.col("mean_7"), 2).alias("mean_7"))


@query("""WITH c AS (SELECT date_trunc('hour', max(ts)) - INTERVAL 12 HOUR AS cutoff FROM events), i AS (SELECT CASE WHEN event_id % 20 <> 0 THEN CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 2 HOUR ELSE ts END END AS known FROM events)
SELECT CASE WHEN known IS NULL THEN 'undated' WHEN known > cutoff THEN 'after_cutoff' WHEN known <= cutoff - INTERVAL 24 HOUR THEN 'too_old' ELSE 'eligible' END AS reason, count(*) AS n FROM i, c GROUP BY 1""")
def news_eligibility(spark: S, sf: str) -> DataFrame:
    """By real stamps: undated, known after the cutoff, exactly 24 hours old or older, or eligible."""
    e = tables.table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    known = F.when(F.col("event_id") % 20 != 0, F.when(F.col("event_id") % 4 == 0, F.col("at") + F.expr("INTERVAL 2 HOURS")).otherwise(F.col("at")))
    cutoff = F.broadcast(e.agg((F.date_trunc("hour", F.max("at")) - F.expr("INTERVAL 12 HOURS")).alias("cutoff")))
    return e.select(known.alias("known")).join(cutoff).select(views.news_reason(F.col("known"), F.col("cutoff")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {GRID} SELECT key, h, round(close / lag(close, 6) OVER w - 1, 6) AS change_6, round(close / lag(close, 24) OVER w - 1, 6) AS change_24, round((high - low) / close, 6) AS spread, round(CASE WHEN volume > 0 THEN taker / volume END, 6) AS taker_share, round(ln(trades), 6) AS log_trades, round(cos(2 * pi() * (h % 24) / 24), 6) AS cos_day FROM g WINDOW w AS (PARTITION BY key ORDER BY h)""")
def feature_groups(spark: S, sf: str) -> DataFrame:
    names = ["change_6", "change_24", "spread", "taker_share", "log_trades", "cos_day"]
    return features(grid(spark, sf), ["returns", "range", "flow", "clock"]).select("key", "h", *[r(F.col(c)).alias(c) for c in names])


@query(f"""WITH {CANDLES}, z AS (SELECT key, h, 0.1 + (ln(volume) - 4.0) / 1.2 * 0.3 + ((high - low) / close - 0.5) / 0.4 * -0.2 AS z FROM candles WHERE volume > 0), p AS (SELECT key, h, 1 / (1 + exp(-(0.9 * ln(greatest(least(1 / (1 + exp(-z)), 1 - 1e-6), 1e-6) / (1 - greatest(least(1 / (1 + exp(-z)), 1 - 1e-6), 1e-6))) - 0.05))) AS p FROM z)
SELECT key, count(*) AS checked, count(*) FILTER (WHERE h % 50 = 0) AS differ FROM p GROUP BY 1""")
def reproduction(spark: S, sf: str) -> DataFrame:
    """Stored scores computed again from the stored inputs; here every fiftieth was stored wrong."""
    p = scoring.frozen(MODEL, {"volume": F.col("volume"), "range": (F.col("high") - F.col("low")) / F.col("close")})
    kept = hourly(spark, sf).where("volume > 0").withColumn("stored", F.when(F.col("h") % 50 == 0, p + 0.01).otherwise(p))
    again = ~scalar.close_to(F.col("stored"), p, 0.0, 1e-9)
    return kept.groupBy("key").agg(F.count("*").alias("checked"), F.count(F.when(again, 1)).alias("differ"))


@query(f"""WITH {FORECAST}, c AS (SELECT key, max(h) - 168 AS sealed FROM fc GROUP BY 1), x AS (SELECT fc.key, h >= sealed AS held, p, y FROM fc JOIN c USING (key)), e AS (SELECT key, held, count(*) AS n, avg((p - y) * (p - y)) AS b, avg(y) * (1 - avg(y)) AS ref FROM x GROUP BY 1, 2)
SELECT a.key, a.n AS opened, b.n AS sealed, round(1 - a.b / a.ref, 6) AS before, round(1 - b.b / b.ref, 6) AS after, CASE WHEN b.n < 100 THEN 'TOO_FEW' WHEN 1 - b.b / b.ref > 0 AND 1 - a.b / a.ref > 0 THEN 'CONFIRMED' WHEN 1 - b.b / b.ref <= 0 THEN 'NOT_CONFIRMED' ELSE 'INCONCLUSIVE' END AS verdict FROM e AS a JOIN e AS b ON b.key = a.key AND b.held AND NOT a.held WHERE a.ref > 0 AND b.ref > 0""")
def sealed_evaluation(spark: S, sf: str) -> DataFrame:
    """The last week is read once, after all else: does it confirm what the rows before said?"""
    f = forecast(spark, sf).withColumn("held", F.col("h") >= F.max("h").over(Window.partitionBy("key")) - 168)
    e = stats.skill(f, ["key", "held"]).where("skill IS NOT NULL")
    a = e.where("NOT held").select("key", F.col("n").alias("opened"), F.col("skill").alias("before"))
    b = e.where("held").select("key", F.col("n").alias("sealed"), F.col("skill").alias("after"))
    verdict = F.when(F.col("sealed") < 100, "TOO_FEW").when((F.col("after") > 0) & (F.col("before") > 0), "CONFIRMED").when(F.col("after") <= 0, "NOT_CONFIRMED").otherwise("INCONCLUSIVE")
    return a.join(b, "key").select("key", "opened", "sealed", r(F.col("before")).alias("before"), r(F.col("after")).alias("after"), verdict.alias("verdict"))


@query(f"""WITH {SIGNALS}, o AS (SELECT key, h, CASE signal WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 END AS side, 10 + volume AS amount, 100 + close / 10 AS price FROM sig WHERE signal <> 'HOLD'),
f AS (SELECT key, side, amount, price * (1 + 0.0005 * side) AS paid, amount * 0.001 AS fee, amount < 25 AS refused FROM o)
SELECT key, count(*) AS orders, count(*) FILTER (WHERE refused) AS refused, round(sum(amount) FILTER (WHERE NOT refused), 4) AS filled, round(sum(fee) FILTER (WHERE NOT refused), 6) AS fees, round(sum(side * (amount - fee * (side + 1) / 2) / paid) FILTER (WHERE NOT refused), 6) AS position FROM f GROUP BY 1""")
def exchange_fills(spark: S, sf: str) -> DataFrame:
    """Market orders against a simulated venue: slippage, fees, a least order, and the position that the fills add up to."""
    side = F.when(F.col("signal") == "BUY", 1).otherwise(-1)
    o = signals(spark, sf).where("signal <> 'HOLD'").select("key", side.alias("side"), (10 + F.col("volume")).alias("amount"), (100 + F.col("close") / 10).alias("price"))
    f = views.fills(o, slippage=0.0005, fee=0.001, least=25)
    done = ~F.col("refused")
    total = lambda c: F.sum(F.when(done, c))
    return f.groupBy("key").agg(F.count("*").alias("orders"), F.count(F.when(F.col("refused"), 1)).alias("refused"), r(total(F.col("amount")), 4).alias("filled"), r(total(F.col("fee"))).alias("fees"), r(total(F.col("units"))).alias("position"))


@query(recursive.CATEGORY_SCORES)
def category_scores(spark: S, sf: str) -> DataFrame:
    """Trend, momentum and place in the bands from the indicators themselves, and their weighted decision."""
    close = hourly(spark, sf).select("key", "h", "close")
    i = indicators(hourly(spark, sf).select("key", "h", "close")).join(close, ["key", "h"])
    parts = {"trend": scoring.trend_score(F.col("close"), F.col("sma_short")), "momentum": scoring.momentum_score(F.col("rsi"), F.col("macd_histogram"), F.col("close"))}
    score, held = scoring.combine(parts)
    return i.select("key", "h", *[r(c).alias(n) for n, c in parts.items()], scoring.band_position(F.col("close"), F.col("bb_lower"), F.col("bb_upper")).alias("band"), r(score).alias("score"), r(held).alias("completeness"), scoring.decide(score).alias("signal"))


#: Fee and spread of the two books: the model's own, and a venue's.
BOOKS = {"model": (0.001, 0.0), "venue": (0.0125, 0.002)}


@query(recursive.strategy_books(BOOKS))
def strategy_books(spark: S, sf: str) -> DataFrame:
    """The 118 daily strategies in both books, over the mean of ten days' order totals."""
    w = Window.orderBy("d")  # a row a day
    mean = daily(spark, sf).select(F.lit("orders").alias("key"), "d", F.avg("total").over(w.rowsBetween(-9, 0)).alias("price"))
    grid_ = G.densify(mean, "d", ("key",)).withColumn("r", F.col("price") / F.lag("price").over(w) - 1)
    sig = F.when(F.col("r") > 0.01, 1).when(F.col("r") < -0.01, -1).when(F.col("r").isNotNull(), 0)
    days = grid_.select("key", "d", "price", sig.alias("sig23"), scalar.clamp(F.col("r") * 5).alias("vote"), F.when(F.col("d") % 5 != 0, F.col("d") % 7 / 10).alias("pbar"))
    rules = {n: x.rule for n, x in strategies.strategies().items()}
    ledger = simulate.strategy_accounts(strategies.wishes(strategies.inputs(days)), rules, BOOKS)
    return ledger.groupBy("rule", "book").agg(F.count("*").alias("days"), r(F.max_by("value", "d")).alias("final"), F.max("trades").alias("trades"))
