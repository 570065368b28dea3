"""Further queries: scans and refusals, pivots and matrices, daily rules, controls, power, verdicts, state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar, scoring
from ..operators import grid as G
from ..operators import joins as J
from ..operators import models, stats
from ..operators import windows as W
from ..sources import payloads, tables
from . import recursive
from .base import CANDLES, DAILY, FORECAST, GRID, RETURNS, SIGNALS, daily, forecast, forward, grid, hourly, query, r, signals

S = SparkSession


@query(f"WITH {CANDLES}, w AS (SELECT key, max(h) - 24 AS h FROM candles GROUP BY 1) SELECT w.key, w.h, close FROM w LEFT JOIN candles AS c ON c.key = w.key AND c.h = w.h")
def point_lookup(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf)
    return c.groupBy("key").agg((F.max("h") - 24).alias("h")).join(c.select("key", "h", "close"), ["key", "h"], "left")


@query(f"WITH {CANDLES}, n AS (SELECT max(h) AS now FROM candles) SELECT key, count(*) FILTER (WHERE h + 1 <= now) AS closed, sum(trades) FILTER (WHERE h + 1 <= now)::BIGINT AS trades, count(*) FILTER (WHERE h + 1 > now) AS open FROM candles, n GROUP BY 1")
def candle_split(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf)
    closed = F.col("h") + 1 <= F.col("now")
    d = c.join(F.broadcast(c.agg(F.max("h").alias("now"))))
    return d.groupBy("key").agg(F.count(F.when(closed, 1)).alias("closed"), F.sum(F.when(closed, F.col("trades"))).alias("trades"), F.count(F.when(~closed, 1)).alias("open"))


@query(f"WITH {CANDLES}, b AS (SELECT min(h) AS a FROM candles) SELECT key, count(*) AS n, max(h + 30) AS last_known FROM candles, b WHERE h + 30 <= a + 400 AND h < a + 300 GROUP BY 1")
def registered_snapshot(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf)
    a = c.agg(F.min("h")).first()[0] or 0
    seen = tables.read_registered(c, tables.Registered("candles", "h", 30), a + 400, sealed_from=a + 300)
    return seen.groupBy("key").agg(F.count("*").alias("n"), F.max("available_at").alias("last_known"))


@query(f"WITH {CANDLES}, n AS (SELECT max(h) AS now FROM candles) SELECT key, max(h) = any_value(now) AS fresh FROM candles, n GROUP BY 1")
def staleness(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf)
    return c.join(F.broadcast(c.agg(F.max("h").alias("now")))).groupBy("key").agg((F.max("h") == F.first("now")).alias("fresh"))


@query(f"WITH {RETURNS}, p AS (SELECT key, h, ret, h + 1 + (h % 4) AS stored FROM fwd WHERE ret IS NOT NULL) SELECT key, count(*) AS graded, count(*) FILTER (WHERE stored < h + 2) AS prospective FROM p GROUP BY 1")
def prospective(spark: S, sf: str) -> DataFrame:
    """Rows that were stored before their outcome's candle closed."""
    p = forward(spark, sf).where("ret IS NOT NULL").withColumn("stored", F.col("h") + 1 + F.col("h") % 4)
    return p.groupBy("key").agg(F.count("*").alias("graded"), F.count(F.when(F.col("stored") < F.col("h") + 2, 1)).alias("prospective"))


@query(f"WITH {RETURNS}, x AS (SELECT key, h, CASE WHEN volume > 1 THEN ln(volume - 1) END AS a, ret AS b FROM fwd) SELECT key, count(*) AS steps, count(a) AS a, count(b) AS b, count(a + b) AS complete FROM x GROUP BY 1")
def complete_cases(spark: S, sf: str) -> DataFrame:
    x = forward(spark, sf).select("key", scalar.log_positive(F.col("volume") - 1).alias("a"), F.col("ret").alias("b"))
    g = x.groupBy("key").agg(F.count("*").alias("steps"), F.count("a").alias("a"), F.count("b").alias("b"))
    return g.join(x.na.drop(subset=["a", "b"]).groupBy("key").agg(F.count("*").alias("complete")), "key")


@query(f"""WITH {GRID}, s AS (SELECT key, h, close, volume, count(close) OVER w AS known FROM g WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
t AS (SELECT CASE WHEN close IS NULL THEN 'missing' WHEN known < 6 THEN 'gap' WHEN volume <= 5 THEN 'small' ELSE 'ok' END AS status FROM s) SELECT status, count(*) AS n FROM t GROUP BY 1""")
def row_refusals(spark: S, sf: str) -> DataFrame:
    s = grid(spark, sf).withColumn("known", F.count("close").over(G.trailing("h", 6)))
    status = F.when(F.col("close").isNull(), "missing").when(F.col("known") < 6, "gap").when(F.col("volume") <= 5, "small").otherwise("ok")
    return s.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {GRID} SELECT g.key, g.h, round(a.close / g.close - 1, 6) AS after_1, round(b.close / g.close - 1, 6) AS after_24 FROM g LEFT JOIN g AS a ON a.key = g.key AND a.h = g.h + 1 LEFT JOIN g AS b ON b.key = g.key AND b.h = g.h + 24 WHERE g.close IS NOT NULL")
def horizon_pivot(spark: S, sf: str) -> DataFrame:
    long = J.at_shifts(hourly(spark, sf).select("key", "h", "close"), [1, 24], "close").withColumn("ret", r(F.col("later") / F.col("close") - 1))
    return long.groupBy("key", "h").agg(F.max(F.when(F.col("shift") == 1, F.col("ret"))).alias("after_1"), F.max(F.when(F.col("shift") == 24, F.col("ret"))).alias("after_24"))


@query(f"WITH {RETURNS}, s AS (SELECT key, h, CASE WHEN h % 5 = 0 THEN 'error' ELSE 'ok' END AS status, volume AS v FROM candles WHERE h % 3 <> 0) SELECT p.key, count(*) AS n, count(v) AS with_shadow FROM candles AS p LEFT JOIN s ON s.key = p.key AND s.h = p.h AND s.status = 'ok' GROUP BY 1")
def shadow_join(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf)
    s = c.where("h % 3 <> 0").select("key", "h", F.when(F.col("h") % 5 == 0, "error").otherwise("ok").alias("status"), F.col("volume").alias("v"))
    return c.select("key", "h").join(s.where("status = 'ok'"), ["key", "h"], "left").groupBy("key").agg(F.count("*").alias("n"), F.count("v").alias("with_shadow"))


@query(f"WITH {DAILY} SELECT a.d AS start, round(b.total / a.total - 1, 6) AS ret FROM daily AS a JOIN daily AS b ON b.d = a.d + 30")
def window_pairs(spark: S, sf: str) -> DataFrame:
    d = daily(spark, sf).withColumn("key", F.lit(1))
    return J.at_shift(d, 30, {"total": "end"}, "d").where("end IS NOT NULL").select(F.col("d").alias("start"), r(F.col("end") / F.col("total") - 1).alias("ret"))


@query("SELECT r_name, privilege, count(n_nationkey) AS nations FROM region CROSS JOIN (SELECT unnest(['select', 'insert', 'update']) AS privilege) LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % len(privilege) > 1 GROUP BY 1, 2")
def privilege_matrix(spark: S, sf: str) -> DataFrame:
    rights = tables.table(spark, sf, "region").withColumn("privilege", F.explode(F.array(*[F.lit(p) for p in ("select", "insert", "update")])))
    n = tables.table(spark, sf, "nation")
    return rights.join(n, (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("n_nationkey") % F.length("privilege") > 1), "left").groupBy("r_name", "privilege").agg(F.count("n_nationkey").alias("nations"))


@query(f"WITH {CANDLES}, n AS (SELECT user_id, (value % 10) / 10 AS relevance, (user_id % 21 - 10) / 10 AS sentiment, event_type FROM events) SELECT event_type, round(sum(relevance * sentiment) / sum(relevance), 6) AS score, count(*) AS n FROM n WHERE relevance >= 0.2 GROUP BY 1")
def sentiment(spark: S, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events").select("event_type", (F.col("value") % 10 / 10).alias("w"), ((F.col("user_id") % 21 - 10) / 10).alias("s")).where("w >= 0.2")
    return e.groupBy("event_type").agg(r(F.sum(F.col("w") * F.col("s")) / F.sum("w")).alias("score"), F.count("*").alias("n"))


PAIRS = [("open", "close"), ("open", "volume"), ("close", "volume"), ("high", "low"), ("volume", "trades")]


@query(f"WITH {CANDLES} " + " UNION ALL ".join(f"SELECT key, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM candles GROUP BY 1" for a, b in PAIRS))
def correlation_matrix(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf).groupBy("key").agg(*[F.corr(a, F.col(b).cast("double")).alias(f"{a}:{b}") for a, b in PAIRS])
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(F.col(f"{a}:{b}")).alias("rho")) for a, b in PAIRS]))
    return c.select("key", cells.alias("x")).select("key", "x.*")


INFLATED = ("open", "close", "volume", "trades")


@query(recursive.inflation(INFLATED))
def inflation_factors(spark: S, sf: str) -> DataFrame:
    """Variance inflation of each column: the diagonal of the inverse of the correlation matrix, one aggregate pass."""
    columns = INFLATED
    c = hourly(spark, sf)
    got = c.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)]).first()
    m = np.array([[got[f"{i}_{j}"] if got[f"{i}_{j}"] is not None else float(i == j) for j in range(4)] for i in range(4)])
    return spark.createDataFrame([(c, round(float(v), 6)) for c, v in zip(columns, np.diag(np.linalg.pinv(m)), strict=True)], "feature string, vif double")


@query(f"WITH {SIGNALS}, d AS (SELECT key, h // 24 AS d, avg(score) AS score, count(*) AS n FROM sig GROUP BY 1, 2) SELECT key, d, round(score, 6) AS score, CASE WHEN score >= 0.15 THEN 'BUY' WHEN score <= -0.15 THEN 'SELL' ELSE 'HOLD' END AS vote FROM d WHERE n >= 6")
def daily_vote(spark: S, sf: str) -> DataFrame:
    d = signals(spark, sf).groupBy("key", F.floor(F.col("h") / 24).cast("long").alias("d")).agg(F.avg("score").alias("score"), F.count("*").alias("n")).where("n >= 6")
    return d.select("key", "d", r(F.col("score")).alias("score"), scoring.decide(F.col("score")).alias("vote"))


@query("WITH u AS (SELECT event_type, 'm' || (event_id % 3) AS model, (props::JSON ->> '$.k')::INT AS tokens FROM events) SELECT event_type, round(sum(tokens * CASE model WHEN 'm0' THEN 0.5 ELSE 2.0 END::DOUBLE) FILTER (WHERE model <> 'm2'), 6) AS cost, count(*) FILTER (WHERE model = 'm2') AS unpriced FROM u GROUP BY 1")
def model_cost(spark: S, sf: str) -> DataFrame:
    """Tokens by model are a map; models without a price are counted, not costed."""
    usage = F.create_map(F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")), F.from_json("props", "k int")["k"])
    u = tables.table(spark, sf, "events").select("event_type", F.explode(usage).alias("model", "tokens"))
    price = spark.createDataFrame([("m0", 0.5), ("m1", 2.0)], "model string, price double")
    return u.join(F.broadcast(price), "model", "left").groupBy("event_type").agg(r(F.sum(F.col("tokens") * F.col("price"))).alias("cost"), F.count(F.when(F.col("price").isNull(), 1)).alias("unpriced"))


@query("WITH l AS (SELECT event_id // 2 AS id, (epoch(date_trunc('hour', ts)) // 3600)::BIGINT AS h, CASE WHEN event_id % 4 < 2 THEN 'buy' ELSE 'sell' END AS side FROM events), b AS (SELECT min(h) AS a FROM l) SELECT side, count(DISTINCT id) AS n FROM l, b WHERE h >= a + 24 AND h < a + 96 GROUP BY 1")
def liquidations(spark: S, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events").select(F.floor(F.col("event_id") / 2).alias("id"), scalar.epoch_hour(F.col("ts")).alias("h"), F.when(F.col("event_id") % 4 < 2, "buy").otherwise("sell").alias("side"), F.col("value").alias("size"))
    a = e.agg(F.min("h")).first()[0] or 0
    return payloads.liquidations(e, a + 24, a + 96).select("side", "n")


@query("WITH o AS (SELECT event_id, 90000 + (event_id % 20) * 1000 AS strike, CASE WHEN event_id % 2 = 0 THEN 'C' ELSE 'P' END AS side, value FROM events WHERE event_type = 'click') SELECT side, count(*) AS n, min_by(value, (abs(strike - 100300), event_id)) AS nearest FROM o GROUP BY 1")
def options_summary(spark: S, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events").where("event_type = 'click'")
    name = F.concat(F.lit("BTC-27JUN25-"), (90000 + F.col("event_id") % 20 * 1000).cast("string"), F.when(F.col("event_id") % 2 == 0, "-C").otherwise("-P"))
    parts = payloads.option_parts(name)
    o = e.select("event_id", "value", parts["strike"].alias("strike"), parts["side"].alias("side")).where("side IS NOT NULL")
    return o.groupBy("side").agg(F.count("*").alias("n"), F.min_by("value", F.struct(F.abs(F.col("strike") - 100300), "event_id")).alias("nearest"))


@query(f"WITH {RETURNS}, t AS (SELECT key, h, ret, row_number() OVER (PARTITION BY key ORDER BY ret DESC, h) AS up, row_number() OVER (PARTITION BY key ORDER BY ret, h) AS down FROM fwd WHERE ret IS NOT NULL) SELECT key, h, round(ret, 6) AS ret, CASE WHEN up <= 5 THEN 'best' ELSE 'worst' END AS side FROM t WHERE up <= 5 OR down <= 5")
def best_and_worst(spark: S, sf: str) -> DataFrame:
    w = Window.partitionBy("key")
    t = forward(spark, sf).where("ret IS NOT NULL").select("key", "h", "ret", F.row_number().over(w.orderBy(F.desc("ret"), "h")).alias("up"), F.row_number().over(w.orderBy("ret", "h")).alias("down"))
    return t.where("up <= 5 OR down <= 5").select("key", "h", r(F.col("ret")).alias("ret"), F.when(F.col("up") <= 5, "best").otherwise("worst").alias("side"))


@query(f"WITH {DAILY}, s AS (SELECT unnest(range((SELECT min(d) FROM daily), (SELECT max(d) + 1 FROM daily))) AS d), x AS (SELECT s.d, total, max(total) OVER (ORDER BY s.d ROWS BETWEEN 364 PRECEDING AND CURRENT ROW) AS high, lag(total, 7) OVER (ORDER BY s.d) AS week FROM s LEFT JOIN daily USING (d)) SELECT d, round(total / high - 1, 6) AS below_high, round(total / week - 1, 6) AS weekly FROM x WHERE total IS NOT NULL")
def calendar_lags(spark: S, sf: str) -> DataFrame:
    w = Window.orderBy("d")  # a row a day
    x = G.densify(daily(spark, sf), "d", ()).select("d", "total", F.max("total").over(w.rowsBetween(-364, 0)).alias("high"), F.lag("total", 7).over(w).alias("week"))
    return x.where("total IS NOT NULL").select("d", r(F.col("total") / F.col("high") - 1).alias("below_high"), r(F.col("total") / F.col("week") - 1).alias("weekly"))


@query(f"""WITH {SIGNALS}, a AS (SELECT key, signal, h, ret FROM sig), m AS (SELECT key, h, signal, count(ret) OVER w AS n, avg(ret) OVER w AS mu FROM a WINDOW w AS (PARTITION BY key, signal ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND 24 PRECEDING))
SELECT key, h, signal, CASE WHEN n < 30 THEN 'wait' WHEN mu > 0.02 THEN 'in' WHEN mu < -0.02 THEN 'out' ELSE 'keep' END AS act FROM m""")
def gate(spark: S, sf: str) -> DataFrame:
    """What earlier rows of the same signal earned, only by outcomes known a day before."""
    w = Window.partitionBy("key", "signal").orderBy("h").rangeBetween(Window.unboundedPreceding, -24)
    m = signals(spark, sf).select("key", "h", "signal", F.count("ret").over(w).alias("n"), F.avg("ret").over(w).alias("mu"))
    return m.select("key", "h", "signal", F.when(F.col("n") < 30, "wait").when(F.col("mu") > 0.02, "in").when(F.col("mu") < -0.02, "out").otherwise("keep").alias("act"))


@query(f"""WITH {GRID}, x AS (SELECT key, h, close, count(close) OVER a AS n, max(high) OVER b AS h0, min(low) OVER b AS l0, max(high) OVER c AS h1, min(low) OVER c AS l1, avg(close) OVER c AS s, avg(close) OVER a AS l FROM g
WINDOW a AS (PARTITION BY key ORDER BY h ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), b AS (PARTITION BY key ORDER BY h ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING), c AS (PARTITION BY key ORDER BY h ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, CASE WHEN h1 > h0 AND l1 > l0 THEN 'up' WHEN h1 < h0 AND l1 < l0 THEN 'down' ELSE 'sideways' END AS structure, CASE WHEN s > l THEN 'bullish' WHEN s < l THEN 'bearish' ELSE 'neutral' END AS ma_cross FROM x WHERE n = 12)
SELECT key, h, structure, ma_cross, (CASE ma_cross WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END + CASE structure WHEN 'up' THEN 1.0 WHEN 'down' THEN -1.0 ELSE 0.0 END)::DOUBLE / 2 AS score FROM y""")
def trend_structure(spark: S, sf: str) -> DataFrame:
    by = Window.partitionBy("key").orderBy("h")
    every, then, now = by.rowsBetween(-11, 0), by.rowsBetween(-11, -6), by.rowsBetween(-5, 0)
    x = grid(spark, sf).select("key", "h", F.count("close").over(every).alias("n"), F.max("high").over(then).alias("h0"), F.min("low").over(then).alias("l0"), F.max("high").over(now).alias("h1"), F.min("low").over(now).alias("l1"), F.avg("close").over(now).alias("s"), F.avg("close").over(every).alias("l")).where("n = 12")
    x = x.withColumn("structure", scoring.structure(F.col("h0"), F.col("l0"), F.col("h1"), F.col("l1"))).withColumn("ma_cross", scoring.ma_cross(F.col("s"), F.col("l")))
    return x.select("key", "h", "structure", "ma_cross", scoring.pattern_score(F.col("ma_cross"), F.col("structure")).alias("score"))


@query(f"""WITH {FORECAST}, i AS (SELECT key, p, y, row_number() OVER (PARTITION BY key ORDER BY h) - 1 AS i FROM fc), w AS (SELECT key, unnest(range(0, n - 99, 50)) AS start FROM (SELECT key, count(*) AS n FROM fc GROUP BY 1))
SELECT w.key, start, round(avg((p - y) * (p - y)), 6) AS brier, round(abs(avg(p) - avg(y)), 6) AS gap FROM w JOIN i ON i.key = w.key AND i >= start AND i < start + 100 GROUP BY 1, 2""")
def sliding_windows(spark: S, sf: str) -> DataFrame:
    """Windows of 100 rows every 50: each row is dealt to the windows that hold it, no range join."""
    w = Window.partitionBy("key")
    i = forecast(spark, sf).select("key", "p", "y", (F.row_number().over(w.orderBy("h")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    k = F.floor(F.col("i") / 50)
    dealt = i.withColumn("start", F.explode(F.array((k - 1) * 50, k * 50))).where("start >= 0 AND start + 100 <= n")
    return dealt.groupBy("key", F.col("start").cast("long").alias("start")).agg(r(stats.brier(F.col("p"), F.col("y"))).alias("brier"), r(F.abs(F.avg("p") - F.avg("y"))).alias("gap"))


@query()
def random_rule(spark: S, sf: str) -> DataFrame:
    """A seeded random baseline by key: as many BUYs as the real signal has, at random hours."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        pdf["signal"] = np.random.default_rng(17).permutation(pdf["signal"].to_numpy())
        return pdf

    s = signals(spark, sf).select("key", "h", "signal", "ret")
    return s.groupBy("key").applyInPandas(draw, s.schema).groupBy("key").agg(stats.edge().alias("edge"), F.count("*").alias("n"))


@query(f"""WITH {DAILY}, x AS (SELECT d, total, lag(total) OVER (ORDER BY d) AS p, avg(total) OVER (ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s5, avg(total) OVER (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s20, max(total) OVER (ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS hi, lead(total) OVER (ORDER BY d) / total - 1 AS ret FROM daily)
SELECT rule, count(*) FILTER (WHERE held) AS days, round(sum(ret) FILTER (WHERE held), 6) AS total FROM (SELECT unnest(['always', 'momentum', 'sma5', 'sma20', 'breakout']) AS rule, unnest([true, total > p, total > s5, total > s20, total > hi]) AS held, ret FROM x) GROUP BY 1""")
def strategy_grid(spark: S, sf: str) -> DataFrame:
    w = Window.orderBy("d")  # a row a day
    x = daily(spark, sf).select("total", F.lag("total").over(w).alias("p"), F.avg("total").over(w.rowsBetween(-4, 0)).alias("s5"), F.avg("total").over(w.rowsBetween(-19, 0)).alias("s20"), F.max("total").over(w.rowsBetween(-10, -1)).alias("hi"), (F.lead("total").over(w) / F.col("total") - 1).alias("ret"))
    rules = {"always": F.lit(True), "momentum": F.col("total") > F.col("p"), "sma5": F.col("total") > F.col("s5"), "sma20": F.col("total") > F.col("s20"), "breakout": F.col("total") > F.col("hi")}
    long = x.select("ret", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), c.alias("held")) for k, c in rules.items()])).alias("x")).select("ret", "x.*")
    return long.groupBy("rule").agg(F.count(F.when(F.col("held"), 1)).alias("days"), r(F.sum(F.when(F.col("held"), F.col("ret")))).alias("total"))


@query(f"WITH {GRID}, a AS (SELECT key, h, 'missing' AS kind, 1 AS severity FROM g WHERE close IS NULL UNION ALL SELECT key, h, 'thin', 0 FROM g WHERE trades = 1 UNION ALL SELECT key, h, 'spike', 2 FROM g WHERE high > 200) SELECT key, h, kind, severity FROM a ORDER BY h DESC, severity DESC, key LIMIT 100")
def incidents(spark: S, sf: str) -> DataFrame:
    g = grid(spark, sf)
    kinds = [("missing", 1, F.col("close").isNull()), ("thin", 0, F.col("trades") == 1), ("spike", 2, F.col("high") > 200)]
    one = lambda name, severity, where: g.where(where).select("key", "h", F.lit(name).alias("kind"), F.lit(severity).alias("severity"))
    a, b, c = (one(*k) for k in kinds)
    return a.unionByName(b).unionByName(c).orderBy(F.desc("h"), F.desc("severity"), "key").limit(100)


@query(f"WITH {CANDLES}, e AS (SELECT DISTINCT h FROM candles WHERE h % 2 = 0), p AS (SELECT DISTINCT h FROM candles WHERE h % 3 = 0) SELECT (SELECT count(*) FROM (SELECT h FROM e EXCEPT SELECT h FROM p)) AS lost, (SELECT count(*) FROM (SELECT h FROM p EXCEPT SELECT h FROM e)) AS extra, (SELECT count(*) FROM (SELECT h FROM e INTERSECT SELECT h FROM p)) AS shared")
def set_differences(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf)
    e, p = c.where("h % 2 = 0").select("h"), c.where("h % 3 = 0").select("h")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(e.subtract(p), "lost").join(n(p.subtract(e), "extra")).join(n(e.intersect(p), "shared"))


@query(f"WITH {SIGNALS}, c AS (SELECT key, signal, count(*) AS n FROM sig GROUP BY 1, 2) SELECT key, signal, n, round(n / sum(n) OVER (PARTITION BY key), 6) AS share, row_number() OVER (PARTITION BY key ORDER BY n DESC, signal) = 1 AS majority FROM c")
def signal_mix(spark: S, sf: str) -> DataFrame:
    w = Window.partitionBy("key")
    c = signals(spark, sf).groupBy("key", "signal").agg(F.count("*").alias("n"))
    return c.select("key", "signal", "n", r(F.col("n") / F.sum("n").over(w)).alias("share"), (F.row_number().over(w.orderBy(F.desc("n"), "signal")) == 1).alias("majority"))


@query(f"WITH {CANDLES} SELECT key, h, round(close * close, 6) AS close_close, round(close * volume, 6) AS close_volume, round(sin(2 * pi() * (h % 24) / 24), 6) AS sin_1, round(cos(4 * pi() * (h % 24) / 24), 6) AS cos_2, (h // 24 + 3) % 7 >= 5 AS weekend FROM candles")
def interactions(spark: S, sf: str) -> DataFrame:
    angle = 2 * F.pi() * (F.col("h") % 24) / 24
    return hourly(spark, sf).select("key", "h", r(F.col("close") * F.col("close")).alias("close_close"), r(F.col("close") * F.col("volume")).alias("close_volume"), r(F.sin(angle)).alias("sin_1"), r(F.cos(2 * angle)).alias("cos_2"), ((F.floor(F.col("h") / 24) + 3) % 7 >= 5).alias("weekend"))


@query(f"WITH {FORECAST}, x AS (SELECT key, h, p, y, lag(y) OVER w AS last, avg(y) OVER (PARTITION BY key ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS base FROM fc WINDOW w AS (PARTITION BY key ORDER BY h)), z AS (SELECT * FROM x WHERE last IS NOT NULL AND base IS NOT NULL) SELECT key, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS model, round(avg((last - y) * (last - y)), 6) AS last_label, round(avg((base - y) * (base - y)), 6) AS base_rate FROM z GROUP BY 1")
def control_models(spark: S, sf: str) -> DataFrame:
    w = Window.partitionBy("key").orderBy("h")
    x = forecast(spark, sf).withColumn("last", F.lag("y").over(w)).withColumn("base", F.avg("y").over(w.rowsBetween(Window.unboundedPreceding, -2))).where("last IS NOT NULL AND base IS NOT NULL")
    return x.groupBy("key").agg(F.count("*").alias("n"), *[r(stats.brier(F.col(c), F.col("y"))).alias(n) for c, n in (("p", "model"), ("last", "last_label"), ("base", "base_rate"))])


@query()
def block_calibration(spark: S, sf: str) -> DataFrame:
    """Platt maps by six-hour block with the line of all rows where a block has under 100 rows or one class."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        every = models.fit_platt(pdf["p"].to_numpy(float), pdf["y"].to_numpy(float)) if pdf["y"].nunique() == 2 else (np.ones(1), 0.0)
        for block, g in pdf.groupby("block"):
            own = len(g) >= 100 and g["y"].nunique() == 2
            a, b = models.fit_platt(g["p"].to_numpy(float), g["y"].to_numpy(float)) if own else every
            out.append((pdf["key"].iloc[0], int(block), len(g), bool(own), float(a[0]), float(b)))
        return pd.DataFrame(out, columns=["key", "block", "n", "own", "slope", "intercept"])

    f = forecast(spark, sf).select("key", scalar.six_hour_block(F.col("h")).alias("block"), "p", "y")
    return f.groupBy("key").applyInPandas(fit, "key string, block int, n bigint, own boolean, slope double, intercept double")


@query(f"WITH {FORECAST}, d AS (SELECT key, (0.5 - y) * (0.5 - y) - (p - y) * (p - y) AS gain FROM fc) SELECT key, count(*) AS n, round(avg(gain), 6) AS gain, round(stddev_samp(gain) / sqrt(count(*)), 6) AS se FROM d GROUP BY 1")
def paired_brier(spark: S, sf: str) -> DataFrame:
    d = forecast(spark, sf).withColumn("gain", F.pow(0.5 - F.col("y"), F.lit(2)) - F.pow(F.col("p") - F.col("y"), F.lit(2)))
    return d.groupBy("key").agg(F.count("*").alias("n"), r(F.avg("gain")).alias("gain"), r(F.stddev_samp("gain") / F.sqrt(F.count("*"))).alias("se"))


@query(f"""WITH {RETURNS}, b AS (SELECT key, h, ret FROM fwd WHERE ret IS NOT NULL), k AS (SELECT unnest(range(1, 6))::INT AS k), a AS (SELECT a.key, k, corr(a.ret, b.ret) AS acf FROM b AS a CROSS JOIN k JOIN b ON b.key = a.key AND b.h = a.h - k GROUP BY 1, 2 HAVING count(*) >= 10), v AS (SELECT key, 1 + 2 * sum(acf * (1 - k / 6.0::DOUBLE)) AS vif FROM a GROUP BY 1), n AS (SELECT key, count(*) AS n FROM b GROUP BY 1)
SELECT key, n, round(vif, 6) AS vif, round((1.959964 + 0.841621) / sqrt(n / vif), 6) AS detectable FROM v JOIN n USING (key) WHERE vif > 0""")
def power(spark: S, sf: str) -> DataFrame:
    """Lags of fewer than ten pairs don't count."""
    b = forward(spark, sf).where("ret IS NOT NULL").select("key", "h", "ret")
    v = stats.variance_inflation(stats.autocorrelation(b, "ret", 5).where("n >= 10"), 6).where("vif > 0")
    n = b.groupBy("key").agg(F.count("*").alias("n"))
    return n.join(v, "key").select("key", "n", r(F.col("vif")).alias("vif"), r((1.959964 + 0.841621) / F.sqrt(F.col("n") / F.col("vif"))).alias("detectable"))


@query(f"""WITH {SIGNALS}, q AS (SELECT key, quantile_cont(ret, 0.1) AS lo, quantile_cont(ret, 0.9) AS hi FROM sig WHERE ret IS NOT NULL GROUP BY 1), m AS (SELECT CASE WHEN ret <= lo THEN 'large fall' WHEN ret < 0 THEN 'fall' WHEN ret >= hi THEN 'large rise' ELSE 'rise' END AS move, signal FROM sig JOIN q USING (key) WHERE ret IS NOT NULL)
SELECT move, signal, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY move), 6) AS share FROM m GROUP BY 1, 2""")
def falls_table(spark: S, sf: str) -> DataFrame:
    s = signals(spark, sf).where("ret IS NOT NULL").select("key", "ret", "signal")
    q = s.groupBy("key").agg(F.percentile("ret", F.lit(0.1)).alias("lo"), F.percentile("ret", F.lit(0.9)).alias("hi"))
    move = F.when(F.col("ret") <= F.col("lo"), "large fall").when(F.col("ret") < 0, "fall").when(F.col("ret") >= F.col("hi"), "large rise").otherwise("rise")
    m = s.join(q, "key").groupBy(move.alias("move"), "signal").agg(F.count("*").alias("n"))
    return m.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy("move"))))


@query(f"WITH {FORECAST}, a AS (SELECT key, count(*) AS n, avg(y) AS base, avg((p - y) * (p - y)) AS b, abs(avg(p) - avg(y)) AS gap FROM fc GROUP BY 1) SELECT key, n, CASE WHEN n < 192 THEN 'none' WHEN n < 2000 THEN 'optimistic' ELSE 'nominal' END AS evidence, CASE WHEN gap > 0.05 THEN 'NOT_SUPPORTED' WHEN 1 - b / (base * (1 - base)) > 0.02 THEN 'SUPPORTED' ELSE 'INCONCLUSIVE' END AS verdict FROM a")
def verdicts(spark: S, sf: str) -> DataFrame:
    from ..operators.views import evidence

    f = forecast(spark, sf)
    gap = f.groupBy("key").agg(F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    v = F.when(F.col("gap") > 0.05, "NOT_SUPPORTED").when(F.col("skill") > 0.02, "SUPPORTED").otherwise("INCONCLUSIVE")
    return stats.skill(f, ["key"]).join(gap, "key").select("key", "n", evidence(F.col("n")).alias("evidence"), v.alias("verdict"))


@query(f"WITH {CANDLES}, n AS (SELECT max(h) AS now, min(h) AS first FROM candles) SELECT count(*) AS rows, count(*) FILTER (WHERE h >= now - 24) AS last_day, count(DISTINCT key) AS series, any_value(now) AS newest, count(DISTINCT h // 24) AS days, count(DISTINCT h // 24) FILTER (WHERE (h // 24 + 3) % 7 >= 5) AS weekend_days FROM candles, n")
def backend_state(spark: S, sf: str) -> DataFrame:
    c = hourly(spark, sf)
    d = c.join(F.broadcast(c.agg(F.max("h").alias("now")))).withColumn("day", F.floor(F.col("h") / 24))
    return d.agg(F.count("*").alias("rows"), F.count(F.when(F.col("h") >= F.col("now") - 24, 1)).alias("last_day"), F.countDistinct("key").alias("series"), F.max("h").alias("newest"), F.countDistinct("day").alias("days"), F.countDistinct(F.when((F.col("day") + 3) % 7 >= 5, F.col("day"))).alias("weekend_days"))


@query(f"WITH {RETURNS}, b AS (SELECT key, h, ret, lag(ret) OVER (PARTITION BY key ORDER BY h) AS before FROM fwd) SELECT CASE WHEN before <= -0.5 THEN 'fell' WHEN before >= 0.5 THEN 'rose' ELSE 'calm' END AS before, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(avg((ret > 0)::INT), 6) AS up FROM b WHERE ret IS NOT NULL AND before IS NOT NULL GROUP BY 1")
def next_by_previous(spark: S, sf: str) -> DataFrame:
    b = forward(spark, sf).withColumn("before", F.lag("ret").over(Window.partitionBy("key").orderBy("h"))).where("ret IS NOT NULL AND before IS NOT NULL")
    bucket = F.when(F.col("before") <= -0.5, "fell").when(F.col("before") >= 0.5, "rose").otherwise("calm")
    return b.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), r(F.avg("ret")).alias("mean_ret"), r(F.avg((F.col("ret") > 0).cast("int"))).alias("up")).withColumnRenamed("bucket", "before")


@query(f"WITH {FORECAST}, q AS (SELECT key, quantile_cont(p, 0.2) AS a, quantile_cont(p, 0.4) AS b, quantile_cont(p, 0.6) AS c, quantile_cont(p, 0.8) AS d FROM fc GROUP BY 1) SELECT key, (p > a)::INT + (p > b)::INT + (p > c)::INT + (p > d)::INT AS quintile, count(*) AS n, round(avg(y), 6) AS observed FROM fc JOIN q USING (key) GROUP BY 1, 2")
def quintiles(spark: S, sf: str) -> DataFrame:
    f = forecast(spark, sf)
    q = f.groupBy("key").agg(*[F.percentile("p", F.lit(x)).alias(n) for n, x in (("a", 0.2), ("b", 0.4), ("c", 0.6), ("d", 0.8))])
    bin_ = sum(((F.col("p") > F.col(c)).cast("int") for c in "abcd"), F.lit(0))
    return f.join(q, "key").groupBy("key", bin_.alias("quintile")).agg(F.count("*").alias("n"), r(F.avg("y")).alias("observed"))


@query()
def forward_selection(spark: S, sf: str) -> DataFrame:
    """Features by how much each lowers the out-of-sample Brier score; each trial is one walk-forward over all folds and keys."""
    c = hourly(spark, sf)
    a, z = c.agg(F.min("h"), F.max("h")).first()
    a, z = a or 0, -1 if z is None else z
    w = Window.partitionBy("key").orderBy("h")
    y = (F.lead("volume").over(w) > F.col("volume")).cast("double")
    rows = J.in_folds(c.withColumn("y", y).select("key", (F.col("h") - a).alias("i"), "volume", "trades", "close", "y"), models.folds(spark, 0, z - a + 1, 200, 140, 72, 1), "i").cache()
    brier = lambda names: models.walk_forward(rows, list(names), "y", time="i", by=("key",)).agg(stats.brier(F.col("p"), F.col("y"))).first()[0]
    path = models.forward_selection(lambda names: brier(names) or 1.0, ["volume", "trades", "close"])
    rows.unpersist()
    return spark.createDataFrame([(k, f, float(b)) for k, (f, b) in enumerate(path)], "step int, feature string, brier double")


@query(f"WITH {RETURNS}, r AS (SELECT key, h, rank() OVER (PARTITION BY key ORDER BY volume) + (count(*) OVER (PARTITION BY key, volume) - 1) / 2 AS a FROM candles) SELECT key, round(avg(a), 6) AS mean_rank, max(a) AS top FROM r GROUP BY 1")
def average_ranks(spark: S, sf: str) -> DataFrame:
    a = hourly(spark, sf).withColumn("a", W.average_rank("volume", ("key",)))
    return a.groupBy("key").agg(r(F.avg("a")).alias("mean_rank"), F.max("a").alias("top"))
