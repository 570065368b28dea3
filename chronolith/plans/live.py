"""Queries that run a stream over all data that is there, and return what its sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.simulate import Rule
from ..session import shared_dir
from ..sources.tables import table
from ..streaming import live
from . import recursive
from .base import CANDLES, daily, forecast, query, r

S = SparkSession


def events(spark: S, sf: str) -> DataFrame:
    return replayed(table(spark, sf, "events"), "ts")


def finished(stream: DataFrame) -> DataFrame:
    """What the stream appended once it has read all."""
    base = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    live.run_to_end(stream, f"{base}/checkpoint", live.into_parquet(f"{base}/rows"))
    return stream.sparkSession.read.schema(schema).parquet(f"{base}/rows/*")


#: Rows of a replayed file, about; at least three files, so that state passes from batch to batch.
FILE_ROWS = 1_000_000


def replayed(df: DataFrame, by: str) -> DataFrame:
    """A batch relation as a stream of files by time, one a batch, written one after the other."""
    path = f"{shared_dir(df.sparkSession)}/replay-{uuid.uuid4().hex}"
    files = max(3, df.count() // FILE_ROWS)
    bounds = df.agg(F.percentile_approx(by, [k / files for k in range(1, files)])).first()[0] or []
    edges = [None, *dict.fromkeys(bounds), None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = df if low is None else df.where(F.col(by) > F.lit(low))
        part = part if high is None else part.where(F.col(by) <= F.lit(high))
        part.coalesce(1).write.mode("append").parquet(path)
    return live.stream_files(df.sparkSession, path, df.schema)


@query(f"WITH {CANDLES}, w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events) SELECT key, h, open, high, low, close, round(volume, 6) AS volume, trades FROM candles, w WHERE (h + 1) * 3600 <= epoch(mark)")
def stream_candles(spark: S, sf: str) -> DataFrame:
    """Only candles whose hour the watermark has passed come out."""
    return finished(live.closed_candles(events(spark, sf))).withColumn("volume", r(F.col("volume")))


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def stream_once(spark: S, sf: str) -> DataFrame:
    e = events(spark, sf)
    return finished(live.once(e, ["event_id"], "ts", "1 hour").select("event_id")).agg(F.count("*").alias("n"))


@query(recursive.SESSIONS)
def stream_sessions(spark: S, sf: str) -> DataFrame:
    """Sessions that the watermark has passed; start and end in microseconds since 1970."""
    s = finished(live.sessions(events(spark, sf)))
    return s.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query(recursive.cusum(0.025, 5.0))
def stream_cusum(spark: S, sf: str) -> DataFrame:
    f = forecast(spark, sf).select("key", "h", (F.col("p") - F.col("y")).alias("residual"))
    return finished(live.cusum_stream(replayed(f, "h"), 0.025, 5.0))


@query(recursive.ONE_STOP)
def stream_account(spark: S, sf: str) -> DataFrame:
    w = Window.orderBy("d").rowsBetween(-9, 0)  # a row a day
    d = daily(spark, sf).withColumn("sma", F.avg("total").over(w))
    days = d.select(F.lit("orders").alias("key"), "d", F.col("total").alias("price"), (F.col("total") > F.col("sma")).cast("double").alias("desired"))
    return finished(live.account_stream(replayed(days, "d"), Rule(stop_loss=0.05))).withColumn("value", r(F.col("value")))
