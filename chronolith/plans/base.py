"""Relations that the queries share, each as a DataFrame and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators.grid import densify, full, trailing
from ..operators.joins import at_shift
from ..sources.tables import candles, daily_totals, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(x, digits: int = 6):
    return F.round(x, digits)


CANDLES = """candles AS (SELECT event_type AS key, (epoch(date_trunc('hour', ts)) // 3600)::BIGINT AS h, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
  min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS volume, count(*) AS trades, sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END) AS taker
  FROM events GROUP BY 1, 2)"""
GRID = CANDLES + """,
span AS (SELECT key, min(h) AS a, max(h) AS b FROM candles GROUP BY key),
steps AS (SELECT key, unnest(range(a, b + 1)) AS h FROM span),
g AS (SELECT key, h, open, high, low, close, volume, trades, taker FROM steps LEFT JOIN candles USING (key, h))"""
RETURNS = GRID + """,
fwd AS (SELECT g.*, n.close / g.close - 1 AS ret FROM g LEFT JOIN g AS n ON n.key = g.key AND n.h = g.h + 1)"""
#: A forecast: p is the share of large moves in the 24 rows before (12 known at least), y whether the next move is large.
LARGE = 0.5
FORECAST = RETURNS + f""",
lab AS (SELECT *, CASE WHEN ret IS NULL THEN NULL WHEN abs(ret) > {LARGE} THEN 1 ELSE 0 END AS y FROM fwd),
fc0 AS (SELECT key, h, ret, close, y, CASE WHEN count(y) OVER w >= 12 THEN avg(y) OVER w END AS p FROM lab
  WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN 25 PRECEDING AND 2 PRECEDING)),
fc AS (SELECT * FROM fc0 WHERE p IS NOT NULL AND y IS NOT NULL)"""
#: Signals: the sign of distance to the mean of the last 6 closes, with a dead band.
SIGNALS = RETURNS + """,
sma AS (SELECT *, CASE WHEN count(close) OVER w = 6 THEN avg(close) OVER w END AS sma FROM fwd WINDOW w AS (PARTITION BY key ORDER BY h ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
sc AS (SELECT *, greatest(least((close - sma) / sma / 0.10, 1.0), -1.0) AS score FROM sma WHERE sma IS NOT NULL AND close IS NOT NULL),
sig AS (SELECT *, CASE WHEN score >= 0.15 THEN 'BUY' WHEN score <= -0.15 THEN 'SELL' ELSE 'HOLD' END AS signal FROM sc)"""
DAILY = """daily AS (SELECT (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS d, sum(o_totalprice) AS total FROM orders GROUP BY 1)"""


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return candles(table(spark, sf, "events"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return densify(hourly(spark, sf))


def forward(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf)
    return at_shift(g, 1, {"close": "later"}).withColumn("ret", F.col("later") / F.col("close") - 1).drop("later")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return forward(spark, sf).withColumn("y", scoring.large_move(F.col("ret"), LARGE))


def forecast(spark: SparkSession, sf: str) -> DataFrame:
    """p uses outcomes known by the row's close: those of rows two and more before."""
    w = trailing("h", 24, until=-2)
    df = labelled(spark, sf).withColumn("p", F.when(F.count("y").over(w) >= 12, F.avg("y").over(w)))
    return df.select("key", "h", "ret", "close", "y", "p").where("p IS NOT NULL AND y IS NOT NULL")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    w = trailing("h", 6)
    df = forward(spark, sf).withColumn("sma", full(F.avg("close"), F.col("close"), 6, w)).where("sma IS NOT NULL AND close IS NOT NULL")
    df = df.withColumn("score", scoring.trend_score(F.col("close"), F.col("sma")))
    return df.withColumn("signal", scoring.decide(F.col("score")))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return daily_totals(table(spark, sf, "orders"))
