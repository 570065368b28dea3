"""The hourly live flow as Structured Streaming: closed candles, availability, deferred outcomes, once-only records, state.

Every stream has a watermark; state is bounded by it or by the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.simulate import Account, full_step, Rule


def stream_files(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def closed_candles(events: DataFrame, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Hourly candles by event type, emitted once their hour has passed the watermark."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", delay)
    order = F.struct(ts, "event_id")
    g = timed.groupBy(F.window("at", "1 hour"), F.col("event_type").alias("key")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("value").alias("volume"), F.count("*").alias("trades")
    )
    return g.select("key", F.floor(F.unix_timestamp("window.start") / 3600).cast("long").alias("h"), "open", "high", "low", "close", "volume", "trades")


def available(stream: DataFrame, ts: str, lag: str, delay: str) -> DataFrame:
    """available_at = stamp + lag is the event time of a source, so that watermarks follow what could be known."""
    return stream.withColumn("available_at", F.col(ts).cast("timestamp") + F.expr(f"INTERVAL {lag}")).withWatermark("available_at", delay)


def once(stream: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark(key)


def outcomes(predictions: DataFrame, prices: DataFrame, horizon_hours: int, grace: str = "6 hours") -> DataFrame:
    """Predictions (key, at, close) with the price exactly horizon hours later, or status unavailable once the grace is over."""
    due = predictions.withColumn("due", F.col("at") + F.expr(f"INTERVAL {horizon_hours} HOURS")).withWatermark("due", grace).alias("p")
    then = prices.select(F.col("key").alias("k"), F.col("at").alias("t"), F.col("close").alias("later")).withWatermark("t", grace).alias("q")
    joined = due.join(then, F.expr("p.key = q.k AND q.t >= p.due AND q.t <= p.due"), "left_outer")
    return joined.select("key", F.col("p.at").alias("at"), "close", "later", F.when(F.col("later").isNull(), "unavailable").otherwise("ok").alias("status"))


def sessions(events: DataFrame, gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def cusum_stream(stream: DataFrame, slack: float, limit: float) -> DataFrame:
    """Alarms of a two-sided cumulative sum by key; rows of a batch in time order. Columns: key, h, residual."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("h")
        out = []
        for h, r in rows[["h", "residual"]].itertuples(index=False):
            up, down = max(0.0, up + r - slack), max(0.0, down - r - slack)
            if up > limit or down > limit:
                out.append((key[0], int(h), 1 if up > limit else -1))
                up = down = 0.0
        state.update((up, down))
        yield pd.DataFrame(out, columns=["key", "h", "direction"])

    return stream.groupBy("key").applyInPandasWithState(step, "key string, h bigint, direction int", "up double, down double", "append", GroupStateTimeout.NoTimeout)


def account_stream(stream: DataFrame, rule: Rule, fee: float = 0.001) -> DataFrame:
    """A paper account by key with the same steps as the batch fold. Columns: key, d, price, desired."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a = Account(*state.get) if state.exists else Account()
        out = []
        for d, price, desired in pd.concat(list(batches)).sort_values("d")[["d", "price", "desired"]].itertuples(index=False):
            action = full_step(a, price, None if pd.isna(desired) else float(desired), rule, fee)
            out.append((key[0], int(d), action, a.value(price), a.trades))
        state.update((a.cash, a.units, a.entry, a.peak, a.held, a.blocked, a.inside, a.trades))
        yield pd.DataFrame(out, columns=["key", "d", "action", "value", "trades"])

    kept = "cash double, units double, entry double, peak double, held int, blocked boolean, inside boolean, trades int"
    return stream.groupBy("key").applyInPandasWithState(step, "key string, d bigint, action string, value double, trades int", kept, "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """All data that is there now, batch by batch, each written by an idempotent function of (rows, batch number)."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def into_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A batch replaces its own folder, so a batch that runs again changes nothing."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
