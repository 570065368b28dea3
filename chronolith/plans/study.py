"""Queries that judge forecasts: economics, drift, slices, correlations, verdicts, calibration by group, detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar, scoring
from ..operators import grid as G
from ..operators import joins as J
from ..operators import models, stats
from ..operators import windows as W
from ..sources import tables
from .base import CANDLES, DAILY, FORECAST, GRID, RETURNS, SIGNALS, daily, forecast, grid, hourly, labelled, query, r, signals

S = SparkSession


def literals(spark: S, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows of the code, to be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


@query(f"""WITH {FORECAST}, u(rule) AS (VALUES ('long_flat'), ('sign')), c(cost) AS (VALUES (0.0011::DOUBLE), (0.0125::DOUBLE)),
x AS (SELECT key, rule, ret, CASE WHEN rule = 'long_flat' THEN (p > 0.5)::INT ELSE sign(p - 0.5)::INT END AS pos FROM fc CROSS JOIN u), b AS (SELECT key, avg(ret) AS hold FROM fc GROUP BY 1)
SELECT x.key, rule, cost, count(*) AS traded, round(avg(pos * ret), 6) AS gross, round(avg(pos * ret - 2 * cost), 6) AS net, round(any_value(hold), 6) AS hold FROM x JOIN b ON b.key = x.key CROSS JOIN c WHERE pos <> 0 GROUP BY 1, 2, 3""")
def economics(spark: S, sf: str) -> DataFrame:
    """Each traded hour is one round trip: gross and net of costs, beside holding."""
    f = forecast(spark, sf).withColumn("hold", F.avg("ret").over(Window.partitionBy("key")))
    pos = {"long_flat": (F.col("p") > 0.5).cast("int"), "sign": F.signum(F.col("p") - 0.5).cast("int")}
    x = f.select("key", "ret", "hold", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("pos")) for k, v in pos.items()])).alias("x")).select("*", "x.*").where("pos <> 0")
    gross = F.col("pos") * F.col("ret")
    return x.join(literals(spark, [(0.0011,), (0.0125,)], "cost double")).groupBy("key", "rule", "cost").agg(F.count("*").alias("traded"), r(F.avg(gross)).alias("gross"), r(F.avg(gross - 2 * F.col("cost"))).alias("net"), r(F.first("hold")).alias("hold"))


CUT = "cut AS (SELECT key, min(h) + 360 AS cut_h FROM fc GROUP BY 1)"


def in_two(df: DataFrame) -> DataFrame:
    """df with later: whether a row lies 360 hours or more after its series begins."""
    return df.withColumn("later", F.col("h") >= F.min("h").over(Window.partitionBy("key")) + 360)


@query(f"""WITH {FORECAST}, {CUT}, q AS (SELECT fc.key, quantile_cont(p, 0.05) AS lo, quantile_cont(p, 0.5) AS mid, quantile_cont(p, 0.95) AS hi FROM fc JOIN cut USING (key) WHERE h < cut_h GROUP BY 1),
l AS (SELECT fc.key, count(*) AS n, any_value(mid) AS reference, quantile_cont(p, 0.5) AS median, avg((p > hi)::INT) AS above, avg((p < lo)::INT) AS below FROM fc JOIN cut USING (key) JOIN q USING (key) WHERE h >= cut_h GROUP BY 1)
SELECT key, n, round(reference, 6) AS reference, round(median, 6) AS median, round(above, 6) AS above, round(below, 6) AS below, CASE WHEN n < 100 THEN 'too few rows' WHEN greatest(above, below) > 0.2 THEN 'FLAG' ELSE 'ok' END AS status FROM l""")
def probability_drift(spark: S, sf: str) -> DataFrame:
    f = in_two(forecast(spark, sf))
    q = f.where("NOT later").groupBy("key").agg(*[F.percentile("p", F.lit(x)).alias(n) for n, x in (("lo", 0.05), ("reference", 0.5), ("hi", 0.95))])
    share = lambda c: F.avg(c.cast("int"))
    g = f.where("later").join(q, "key").groupBy("key").agg(F.count("*").alias("n"), F.first("reference").alias("reference"), F.percentile("p", F.lit(0.5)).alias("median"), share(F.col("p") > F.col("hi")).alias("above"), share(F.col("p") < F.col("lo")).alias("below"))
    status = F.when(F.col("n") < 100, "too few rows").when(F.greatest("above", "below") > 0.2, "FLAG").otherwise("ok")
    return g.select("key", "n", *[r(F.col(c)).alias(c) for c in ("reference", "median", "above", "below")], status.alias("status"))


@query(f"""WITH {FORECAST}, {CUT}, d AS (SELECT fc.key, avg(y) AS dev FROM fc JOIN cut USING (key) WHERE h < cut_h GROUP BY 1), l AS (SELECT fc.key, count(*) AS n, avg(y) AS live, any_value(dev) AS dev FROM fc JOIN cut USING (key) JOIN d USING (key) WHERE h >= cut_h GROUP BY 1),
c AS (SELECT *, greatest(0.0, live - 1.96 * sqrt(live * (1 - live) / n)) AS low, least(1.0, live + 1.96 * sqrt(live * (1 - live) / n)) AS high FROM l)
SELECT key, n, round(dev, 6) AS dev, round(live, 6) AS live, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN n < 100 THEN 'too few rows' WHEN dev BETWEEN low AND high THEN 'ok' ELSE 'FLAG' END AS status FROM c""")
def outcome_drift(spark: S, sf: str) -> DataFrame:
    f = in_two(forecast(spark, sf))
    g = f.where("later").groupBy("key").agg(F.count("*").alias("n"), F.avg("y").alias("live")).join(f.where("NOT later").groupBy("key").agg(F.avg("y").alias("dev")), "key")
    half = 1.96 * F.sqrt(F.col("live") * (1 - F.col("live")) / F.col("n"))
    g = g.withColumn("low", F.greatest(F.lit(0.0), F.col("live") - half)).withColumn("high", F.least(F.lit(1.0), F.col("live") + half))
    status = F.when(F.col("n") < 100, "too few rows").when(F.col("dev").between(F.col("low"), F.col("high")), "ok").otherwise("FLAG")
    return g.select("key", "n", *[r(F.col(c)).alias(c) for c in ("dev", "live", "low", "high")], status.alias("status"))


@query("""WITH f AS (SELECT event_type AS key, (epoch(date_trunc('hour', ts)) // 3600)::BIGINT AS h, min(epoch_us(ts)) AS t FROM events GROUP BY 1, 2), d AS (SELECT key, (h + 72) // 168 AS week, (t / 1e6 - h * 3600) / 60 AS delay FROM f)
SELECT key, week, count(*) AS n, round(quantile_cont(delay, 0.5), 6) AS median_delay FROM d GROUP BY 1, 2""")
def arrival_delay(spark: S, sf: str) -> DataFrame:
    """Minutes from the hour to its first event, by ISO week."""
    e = tables.table(spark, sf, "events")
    f = e.groupBy(F.col("event_type").alias("key"), scalar.epoch_hour(F.col("ts")).alias("h")).agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"))
    d = f.select("key", F.floor((F.col("h") + 72) / 168).cast("long").alias("week"), ((F.col("t") / 1e6 - F.col("h") * 3600) / 60).alias("delay"))
    return d.groupBy("key", "week").agg(F.count("*").alias("n"), r(F.percentile("delay", F.lit(0.5))).alias("median_delay"))


@query(f"""WITH {SIGNALS}, s AS (SELECT key, h, ret, unnest(['model', 'buy', 'contrary']) AS system, unnest([signal, 'BUY', CASE signal WHEN 'BUY' THEN 'SELL' WHEN 'SELL' THEN 'BUY' ELSE 'HOLD' END]) AS said FROM sig WHERE ret IS NOT NULL),
v AS (SELECT system, said, ret, 'all' AS slice, 'all' AS value FROM s UNION ALL SELECT system, said, ret, 'key', key FROM s UNION ALL SELECT system, said, ret, 'block', (h % 24 // 6)::VARCHAR FROM s)
SELECT slice, value, system, count(*) AS n, round(avg((said <> 'HOLD')::INT), 6) AS coverage, round(avg(((said = 'BUY') = (ret > 0))::INT) FILTER (WHERE said <> 'HOLD'), 6) AS accuracy,
  round(avg(ret) FILTER (WHERE said = 'BUY') - avg(ret) FILTER (WHERE said = 'SELL'), 6) AS edge, round(avg(ret), 6) AS hold FROM v GROUP BY 1, 2, 3""")
def slice_evaluation(spark: S, sf: str) -> DataFrame:
    """All systems over all slices in one aggregation: rows are made long by system, slices are grouping sets."""
    turned = F.when(F.col("signal") == "BUY", "SELL").when(F.col("signal") == "SELL", "BUY").otherwise("HOLD")
    systems = F.array(*[F.struct(F.lit(n).alias("system"), c.alias("said")) for n, c in (("model", F.col("signal")), ("buy", F.lit("BUY")), ("contrary", turned))])
    s = signals(spark, sf).where("ret IS NOT NULL").select("key", scalar.six_hour_block(F.col("h")).cast("string").alias("block"), "ret", F.explode(systems).alias("s")).select("key", "block", "ret", "s.*")
    acted = F.col("said") != "HOLD"
    hit = ((F.col("said") == "BUY") == (F.col("ret") > 0)).cast("int")
    g = s.groupingSets([["block", "system"], ["key", "system"], ["system"]], "block", "key", "system").agg(
        F.grouping("block").alias("gb"), F.grouping("key").alias("gk"), F.count("*").alias("n"), r(F.avg(acted.cast("int"))).alias("coverage"), r(F.avg(F.when(acted, hit))).alias("accuracy"), r(stats.edge("said")).alias("edge"), r(F.avg("ret")).alias("hold"),
    )
    slice_ = F.when(F.col("gb") == 0, "block").when(F.col("gk") == 0, "key").otherwise("all")
    return g.select(slice_.alias("slice"), F.coalesce("block", "key", F.lit("all")).alias("value"), "system", "n", "coverage", "accuracy", "edge", "hold")


@query(f"""WITH {SIGNALS}, l AS (SELECT s.key, s.h, unnest(['score', 'volume']) AS x, unnest([s.score, s.volume]) AS v, k.horizon, n.close / s.close - 1 AS f FROM sig AS s CROSS JOIN (SELECT unnest([1, 24]) AS horizon) AS k JOIN sig AS n ON n.key = s.key AND n.h = s.h + k.horizon),
k AS (SELECT *, rank() OVER (PARTITION BY key, x, horizon ORDER BY v) + (count(*) OVER (PARTITION BY key, x, horizon, v) - 1) / 2 AS a, rank() OVER (PARTITION BY key, x, horizon ORDER BY f) + (count(*) OVER (PARTITION BY key, x, horizon, f) - 1) / 2 AS b FROM l)
SELECT key, x, horizon, count(*) AS n, round(corr(a, b), 6) AS rho, round(2.8 / sqrt(count(*) / horizon::DOUBLE), 6) AS detectable, round(avg((sign(v) = sign(f))::INT) FILTER (WHERE x = 'score' AND v <> 0 AND f <> 0), 6) AS hit_rate FROM k GROUP BY 1, 2, 3 HAVING count(*) >= 60""")
def correlation_cells(spark: S, sf: str) -> DataFrame:
    s = signals(spark, sf).select("key", "h", "close", "score", "volume")
    later = J.at_shifts(s.select("key", "h", "close", "score", "volume"), [1, 24], "close").where("later IS NOT NULL")
    xs = F.array(*[F.struct(F.lit(c).alias("x"), F.col(c).alias("v")) for c in ("score", "volume")])
    long = later.select("key", F.col("shift").alias("horizon"), (F.col("later") / F.col("close") - 1).alias("f"), F.explode(xs).alias("s")).select("key", "horizon", "f", "s.*")
    by = ("key", "x", "horizon")
    k = long.withColumn("a", W.average_rank("v", by)).withColumn("b", W.average_rank("f", by))
    signed = (F.col("x") == "score") & (F.col("v") != 0) & (F.col("f") != 0)
    g = k.groupBy(*by).agg(F.count("*").alias("n"), r(F.corr("a", "b")).alias("rho"), r(F.avg(F.when(signed, (F.signum("v") == F.signum("f")).cast("int")))).alias("hit_rate")).where("n >= 60")
    return g.select("key", "x", F.col("horizon").cast("int").alias("horizon"), "n", "rho", r(2.8 / F.sqrt(F.col("n") / F.col("horizon"))).alias("detectable"), "hit_rate")


@query(f"""WITH {FORECAST}, {CUT}, d AS (SELECT fc.key, h >= cut_h AS later, (h + 72) // 168 AS week, (0.5 - y) * (0.5 - y) - (p - y) * (p - y) AS gain, p, y FROM fc JOIN cut USING (key)),
w AS (SELECT key, count(*) FILTER (WHERE g > 0) AS good, count(*) AS weeks FROM (SELECT key, week, avg(gain) AS g FROM d GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT key, avg(gain) FILTER (WHERE later) AS v, stddev_samp(gain) FILTER (WHERE later) / sqrt(count(*) FILTER (WHERE later)) AS se, avg(gain) FILTER (WHERE NOT later) AS x, abs(avg(p) FILTER (WHERE later) - avg(y) FILTER (WHERE later)) AS gap FROM d GROUP BY 1)
SELECT e.key, v > 1.96 * se AS significant, v >= 0.01 AS practical, x > 0 AS earlier, gap <= 0.03 AS calibrated, good, good * 8 >= weeks * 6 AS steady,
  CASE WHEN v > 1.96 * se AND v >= 0.01 AND x > 0 AND gap <= 0.03 AND good * 8 >= weeks * 6 THEN 'SUPPORTED' WHEN v + 1.96 * se < 0.01 OR gap > 0.03 THEN 'NOT_SUPPORTED' ELSE 'INCONCLUSIVE' END AS verdict FROM e JOIN w USING (key) WHERE v IS NOT NULL AND x IS NOT NULL AND se IS NOT NULL""")
def judged(spark: S, sf: str) -> DataFrame:
    """The criteria of a registered comparison, and their verdict: later and earlier rows, calibration, weeks."""
    d = in_two(forecast(spark, sf)).withColumn("gain", F.pow(0.5 - F.col("y"), F.lit(2)) - F.pow(F.col("p") - F.col("y"), F.lit(2)))
    w = d.groupBy("key", F.floor((F.col("h") + 72) / 168).alias("week")).agg(F.avg("gain").alias("g")).groupBy("key").agg(F.count(F.when(F.col("g") > 0, 1)).alias("good"), F.count("*").alias("weeks"))
    on = lambda c: F.when(F.col("later"), F.col(c))
    e = d.groupBy("key").agg(F.avg(on("gain")).alias("v"), (F.stddev_samp(on("gain")) / F.sqrt(F.count(on("gain")))).alias("se"), F.avg(F.when(~F.col("later"), F.col("gain"))).alias("x"), F.abs(F.avg(on("p")) - F.avg(on("y"))).alias("gap"))
    e = e.join(w, "key").where("v IS NOT NULL AND x IS NOT NULL AND se IS NOT NULL")
    marks = {"significant": F.col("v") > 1.96 * F.col("se"), "practical": F.col("v") >= 0.01, "earlier": F.col("x") > 0, "calibrated": F.col("gap") <= 0.03, "steady": F.col("good") * 8 >= F.col("weeks") * 6}
    return e.select("key", "good", *[c.alias(n) for n, c in marks.items()], scoring.verdict(list(marks.values()), (F.col("v") + 1.96 * F.col("se") < 0.01) | ~marks["calibrated"]).alias("verdict"))


@query(f"""WITH {FORECAST}, b AS (SELECT *, (h + 72) // 168 AS week, avg(y) OVER (PARTITION BY key) AS base FROM fc) SELECT key, week, count(*) AS n, round(1 - avg((p - y) * (p - y)) / avg((base - y) * (base - y)), 6) AS skill, round(avg(((p > 0.5) = (y > 0.5))::INT), 6) AS accuracy, round(greatest(avg(y), 1 - avg(y)), 6) AS naive,
  round(avg((p > 0.5)::INT), 6) AS said, round(avg(sign(p - 0.5) * ret), 6) AS signed_return FROM b GROUP BY 1, 2""")
def direction_scores(spark: S, sf: str) -> DataFrame:
    f = forecast(spark, sf).withColumn("base", F.avg("y").over(Window.partitionBy("key")))
    own, ref = (F.avg(F.pow(F.col(c) - F.col("y"), F.lit(2))) for c in ("p", "base"))
    hit = ((F.col("p") > 0.5) == (F.col("y") > 0.5)).cast("int")
    return f.groupBy("key", F.floor((F.col("h") + 72) / 168).cast("long").alias("week")).agg(
        F.count("*").alias("n"), r(1 - own / ref).alias("skill"), r(F.avg(hit)).alias("accuracy"), r(F.greatest(F.avg("y"), 1 - F.avg("y"))).alias("naive"), r(F.avg((F.col("p") > 0.5).cast("int"))).alias("said"), r(F.avg(F.signum(F.col("p") - 0.5) * F.col("ret"))).alias("signed_return"),
    )


@query(f"""WITH {SIGNALS}, f AS (SELECT s.key, s.score, k.horizon, n.close / s.close - 1 AS ret FROM sig AS s CROSS JOIN (SELECT unnest([1, 24]) AS horizon) AS k JOIN sig AS n ON n.key = s.key AND n.h = s.h + k.horizon),
a AS (SELECT key, horizon, avg(ret) FILTER (WHERE score >= 0.15) - avg(ret) FILTER (WHERE score <= -0.15) AS before, avg(ret) FILTER (WHERE score >= 0.5) - avg(ret) FILTER (WHERE score <= -0.5) AS after FROM f GROUP BY 1, 2)
SELECT key, horizon, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS change, before > 0 AS held, after > 0 AS holds FROM a""")
def criterion_change(spark: S, sf: str) -> DataFrame:
    """One criterion on two sets of results, by horizon: a join of two long tables."""
    later = J.at_shifts(signals(spark, sf).select("key", "h", "close", "score"), [1, 24], "close").where("later IS NOT NULL").withColumn("ret", F.col("later") / F.col("close") - 1)

    def edges(limit: float, name: str) -> DataFrame:
        side = lambda c: F.avg(F.when(c, F.col("ret")))
        return later.groupBy("key", F.col("shift").cast("int").alias("horizon")).agg((side(F.col("score") >= limit) - side(F.col("score") <= -limit)).alias(name))

    a = edges(0.15, "before").join(edges(0.5, "after"), ["key", "horizon"])
    return a.select("key", "horizon", r(F.col("before")).alias("before"), r(F.col("after")).alias("after"), r(F.col("after") - F.col("before")).alias("change"), (F.col("before") > 0).alias("held"), (F.col("after") > 0).alias("holds"))


@query(f"WITH {CANDLES}, m AS (SELECT key, h, volume, quantile_cont(volume, 0.5) OVER (PARTITION BY key ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS median FROM candles) SELECT key, h, round(median, 6) AS median, volume <= median AS calm FROM m WHERE median IS NOT NULL")
def calm_flag(spark: S, sf: str) -> DataFrame:
    """At or under the median of all earlier values."""
    m = W.expanding_quantile(hourly(spark, sf).select("key", "h", "volume"), "volume", 0.5, 1, "median").where("median IS NOT NULL")
    return m.select("key", "h", r(F.col("median")).alias("median"), (F.col("volume") <= F.col("median")).alias("calm"))


@query(f"WITH {FORECAST}, f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY h) AS k FROM fc) SELECT key, count(*) AS n, max(h) AS last, round(avg((p - y) * (p - y)), 6) AS brier FROM f WHERE k <= 100 GROUP BY 1 HAVING count(*) = 100")
def checkpoint_reading(spark: S, sf: str) -> DataFrame:
    """Exactly the first 100 rows of each series; series with fewer have no reading."""
    k = F.row_number().over(Window.partitionBy("key").orderBy("h"))
    f = forecast(spark, sf).withColumn("k", k).where("k <= 100")
    return f.groupBy("key").agg(F.count("*").alias("n"), F.max("h").alias("last"), r(stats.brier(F.col("p"), F.col("y"))).alias("brier")).where("n = 100")


SIDE = "dv AS (SELECT event_type AS key, (epoch(date_trunc('hour', ts)) // 3600)::BIGINT // 24 * 24 + 30 AS seen, sum(value) AS v FROM events GROUP BY 1, 2)"


@query(f"""WITH {CANDLES}, {SIDE}, o AS (SELECT key, seen, lag(v, 1) OVER w AS back_1, lag(v, 7) OVER w AS back_7, CASE WHEN count(v) OVER (w ROWS 2 PRECEDING) = 3 THEN avg(v) OVER (w ROWS 2 PRECEDING) END AS mean_3, CASE WHEN count(v) OVER (w ROWS 20 PRECEDING) = 21 THEN sum(v) OVER (w ROWS 20 PRECEDING) END AS sum_21 FROM dv WINDOW w AS (PARTITION BY key ORDER BY seen))
SELECT c.key, c.h, round(back_1, 6) AS back_1, round(back_7, 6) AS back_7, round(mean_3, 6) AS mean_3, round(sum_21, 6) AS sum_21 FROM candles AS c ASOF LEFT JOIN o ON c.key = o.key AND c.h >= o.seen""")
def asof_offsets(spark: S, sf: str) -> DataFrame:
    """Earlier visible rows and sums over the last ones: lags over the side's own rows, then one as-of join."""
    e = tables.table(spark, sf, "events")
    w = Window.partitionBy("key").orderBy("at")
    side = e.groupBy(F.col("event_type").alias("key"), (F.floor(scalar.epoch_hour(F.col("ts")) / 24) * 24 + 30).cast("long").alias("at")).agg(F.sum("value").alias("v"))
    over = lambda f, n: G.full(f("v"), F.col("v"), n, w.rowsBetween(1 - n, 0))
    o = side.select("key", "at", F.lag("v", 1).over(w).alias("back_1"), F.lag("v", 7).over(w).alias("back_7"), over(F.avg, 3).alias("mean_3"), over(F.sum, 21).alias("sum_21"))
    names = ["back_1", "back_7", "mean_3", "sum_21"]
    out = J.asof(hourly(spark, sf).select("key", "h"), o, names, "h", "at", ("key",))
    return out.select("key", "h", *[r(F.col(c)).alias(c) for c in names])


@query(f"WITH {GRID} SELECT g.key, g.h, round(g.close / a.close - 1, 6) AS implied, round(ln(g.volume) - ln(a.volume), 6) AS interest, round(g.taker / g.volume - a.taker / a.volume, 6) AS margin FROM g JOIN g AS a ON a.key = g.key AND a.h = g.h - 24 WHERE g.close IS NOT NULL AND a.close IS NOT NULL")
def day_changes(spark: S, sf: str) -> DataFrame:
    """Changes against exactly 24 hours before."""
    c = J.at_shift(hourly(spark, sf).select("key", "h", "close", "volume", "taker"), -24, {"close": "c0", "volume": "v0", "taker": "t0"}).where("c0 IS NOT NULL")
    return c.select("key", "h", r(F.col("close") / F.col("c0") - 1).alias("implied"), r(F.log("volume") - F.log("v0")).alias("interest"), r(F.col("taker") / F.col("volume") - F.col("t0") / F.col("v0")).alias("margin"))


@query(f"""WITH {FORECAST}, a AS (SELECT key, h FROM fc), b AS (SELECT key, h FROM lab WHERE y IS NOT NULL) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_first, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_second, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) = 0 AS within""")
def index_equality(spark: S, sf: str) -> DataFrame:
    """Whether two variants were scored on the same hours."""
    a, b = forecast(spark, sf).select("key", "h"), labelled(spark, sf).where("y IS NOT NULL").select("key", "h")
    n = lambda x, y, name: x.exceptAll(y).agg(F.count("*").alias(name))
    return n(a, b, "only_first").join(n(b, a, "only_second")).withColumn("within", F.col("only_first") == 0)


@query(f"""WITH {DAILY}, x AS (SELECT d, total, CASE WHEN total > avg(total) OVER (ORDER BY d ROWS 9 PRECEDING) THEN 1.0::DOUBLE ELSE 0.25 END AS w, total / lag(total) OVER (ORDER BY d) - 1 AS ret FROM daily),
z AS (SELECT d, coalesce(lag(w) OVER (ORDER BY d), 0)::DOUBLE AS held, coalesce(ret, 0)::DOUBLE AS ret, abs(coalesce(lag(w) OVER (ORDER BY d), 0) - coalesce(lag(w, 2) OVER (ORDER BY d), 0)) AS turn FROM x)
SELECT d, round(held, 6) AS held, round(exp(sum(ln((1 + held * ret) * (1 - 0.001 * turn))) OVER (ORDER BY d)), 6) AS equity FROM z""")
def long_or_cash(spark: S, sf: str) -> DataFrame:
    """A share held from day to day with costs on what is turned over: a running product, no fold."""
    w = Window.orderBy("d")  # a row a day
    x = daily(spark, sf).select("d", F.when(F.col("total") > F.avg("total").over(w.rowsBetween(-9, 0)), 1.0).otherwise(0.25).alias("w"), (F.col("total") / F.lag("total").over(w) - 1).alias("ret"))
    held, before = F.coalesce(F.lag("w").over(w), F.lit(0.0)), F.coalesce(F.lag("w", 2).over(w), F.lit(0.0))
    z = x.select("d", held.alias("held"), F.coalesce("ret", F.lit(0.0)).alias("ret"), F.abs(held - before).alias("turn"))
    growth = F.log((1 + F.col("held") * F.col("ret")) * (1 - 0.001 * F.col("turn")))
    return z.select("d", r(F.col("held")).alias("held"), r(F.exp(F.sum(growth).over(w.rowsBetween(Window.unboundedPreceding, 0)))).alias("equity"))


@query(f"""WITH {DAILY}, x AS (SELECT d, row_number() OVER (ORDER BY d) AS i, total, total / lag(total) OVER (ORDER BY d) - 1 AS ret, total > avg(total) OVER (ORDER BY d ROWS 9 PRECEDING) AS up FROM daily), y AS (SELECT i, coalesce(ret, 0) AS ret, coalesce(lag(up) OVER (ORDER BY d), false) AS up FROM x),
n AS (SELECT max(i) AS n FROM y), s AS (SELECT unnest(range(1, n - 88, 90)) AS start FROM n), t(strategy) AS (VALUES ('hold'), ('above')), c(cost) AS (VALUES (0.0::DOUBLE), (0.01::DOUBLE)),
p AS (SELECT start, strategy, cost, i, CASE WHEN strategy = 'hold' OR up THEN ret ELSE 0 END AS ret FROM s JOIN y ON i > start AND i < start + 90 CROSS JOIN t CROSS JOIN c)
SELECT start, strategy, cost, count(*) AS days, round((1 - cost) * exp(sum(ln(1 + ret))) - 1, 6) AS ret, (1 - cost) * exp(sum(ln(1 + ret))) >= 1 AS kept FROM p GROUP BY 1, 2, 3""")
def fresh_starts(spark: S, sf: str) -> DataFrame:
    """Each strategy and cost from a fresh start in each window of 90 days: rows are dealt to their window, no range join."""
    w = Window.orderBy("d")  # a row a day
    x = daily(spark, sf).select("d", "total", F.row_number().over(w).alias("i"), (F.col("total") / F.lag("total").over(w) - 1).alias("ret"), (F.col("total") > F.avg("total").over(w.rowsBetween(-9, 0))).alias("up"))
    y = x.select("i", F.count("*").over(Window.partitionBy()).alias("n"), F.coalesce("ret", F.lit(0.0)).alias("ret"), F.coalesce(F.lag("up").over(w), F.lit(False)).alias("up"))
    start = (F.floor((F.col("i") - 1) / 90) * 90 + 1).cast("long")
    y = y.withColumn("start", start).where("i > start AND start < n - 88")
    grid_ = literals(spark, [(s, c) for s in ("hold", "above") for c in (0.0, 0.01)], "strategy string, cost double")
    step = F.log(1 + F.when((F.col("strategy") == "hold") | F.col("up"), F.col("ret")).otherwise(0.0))
    end = (1 - F.col("cost")) * F.exp(F.sum(step))
    return y.join(grid_).groupBy("start", "strategy", "cost").agg(F.count("*").alias("days"), r(end - 1).alias("ret"), (end >= 1).alias("kept"))


@query()
def group_calibration(spark: S, sf: str) -> DataFrame:
    """Stated less observed by six-hour block, resampled as one series so that neighbouring hours stay together."""
    f = forecast(spark, sf).withColumn("block", scalar.six_hour_block(F.col("h")))
    return stats.group_calibration(f, "key", "block", "p", "y", "h", block=48, count=100, seed=7)


@query()
def bootstrap_edge(spark: S, sf: str) -> DataFrame:
    """Any statistic of the rows of a block resample: here, what buys earn over sells."""
    s = signals(spark, sf).where("ret IS NOT NULL").select("key", "h", ((F.col("signal") == "BUY").cast("double") - (F.col("signal") == "SELL").cast("double")).alias("side"), "ret")
    return stats.bootstrap(s, "key", ["side", "ret"], stats.side_edge, "h", block=48, count=200, seed=7)


@query()
def alarm_threshold(spark: S, sf: str) -> DataFrame:
    """The least limit at which calibrated controls seldom alarm, and how soon an offset is found with it."""
    return stats.alarm_limits(forecast(spark, sf).select("key", "h", "p", "y"), "key", "p", "y", "h", slack=0.025, target=2.0, window=200, step=100, change=50, delta=0.1)


@query()
def shared_slope(spark: S, sf: str) -> DataFrame:
    """One slope and an intercept for each six-hour block, by key."""
    f = forecast(spark, sf).select("key", scalar.six_hour_block(F.col("h")).alias("block"), "p", "y")
    return models.shared_slope(f, "key", "block", "p", "y")


@query()
def boosted_trees(spark: S, sf: str) -> DataFrame:
    """Gradient-boosted trees, fitted on the first 360 hours of all series and scored on the others."""
    f = in_two(labelled(spark, sf).where("y IS NOT NULL AND volume IS NOT NULL").select("key", "h", F.col("y").cast("double").alias("y"), "volume", F.col("trades").cast("double").alias("trades"), ((F.col("high") - F.col("low")) / F.col("close")).alias("range")))
    return models.boosted(f.where("NOT later"), f.where("later"), ["volume", "trades", "range"], "y").select("key", "h", "y", r(F.col("p")).alias("p"))


@query(f"""WITH {RETURNS}, m AS (SELECT key, h, close, count(close) OVER w AS n, avg(close) OVER w AS mean FROM fwd WINDOW w AS (PARTITION BY key ORDER BY h ROWS 5 PRECEDING)), z AS (SELECT key, h // 6 AS bucket, count(close) AS points, count(*) - count(close) AS missing, min(close) AS low, max(close) AS high, arg_min(close, h) FILTER (WHERE close IS NOT NULL) AS first, arg_max(close, h) FILTER (WHERE close IS NOT NULL) AS last FROM m GROUP BY 1, 2)
SELECT key, bucket, points, missing, low, high, first, last FROM z""")
def chart_points(spark: S, sf: str) -> DataFrame:
    """A chart's points, six hours to one: missing hours are counted, not drawn."""
    known = F.when(F.col("close").isNotNull(), F.col("h"))
    return grid(spark, sf).groupBy("key", F.floor(F.col("h") / 6).cast("long").alias("bucket")).agg(F.count("close").alias("points"), (F.count("*") - F.count("close")).alias("missing"), F.min("close").alias("low"), F.max("close").alias("high"), F.min_by("close", known).alias("first"), F.max_by("close", known).alias("last"))


@query(f"""WITH {SIGNALS}, b AS (SELECT DISTINCT key FROM sig), o AS (SELECT key, h, ret, CASE WHEN score > 0 THEN 1 ELSE -1 END AS side FROM sig WHERE ret IS NOT NULL AND score <> 0), q AS (SELECT key, side, quantile_cont(ret, 0.5) AS median, count(*) AS n FROM o GROUP BY 1, 2)
SELECT key, max(n) FILTER (WHERE side = 1) AS ups, max(n) FILTER (WHERE side = -1) AS downs, round(max(median) FILTER (WHERE side = 1) - max(median) FILTER (WHERE side = -1), 6) AS direction, CASE WHEN max(n) FILTER (WHERE side = 1) < 30 OR max(n) FILTER (WHERE side = -1) < 30 THEN 'too few' WHEN abs(max(median) FILTER (WHERE side = 1) - max(median) FILTER (WHERE side = -1)) > 0.5 THEN 'tripwire' ELSE 'plain' END AS verdict FROM q GROUP BY 1 HAVING count(*) = 2""")
def feature_information(spark: S, sf: str) -> DataFrame:
    """What a feature's sign says about the next move; more than can be true is a tripwire for leaks."""
    o = signals(spark, sf).where("ret IS NOT NULL AND score <> 0").groupBy("key").agg(*[f for name, c in (("u", F.col("score") > 0), ("d", F.col("score") < 0)) for f in (F.count(F.when(c, 1)).alias(f"{name}n"), F.percentile(F.when(c, F.col("ret")), F.lit(0.5)).alias(f"{name}m"))])
    gap = F.col("um") - F.col("dm")
    verdict = F.when((F.col("un") < 30) | (F.col("dn") < 30), "too few").when(F.abs(gap) > 0.5, "tripwire").otherwise("plain")
    return o.where("un > 0 AND dn > 0").select("key", F.col("un").alias("ups"), F.col("dn").alias("downs"), r(gap).alias("direction"), verdict.alias("verdict"))
