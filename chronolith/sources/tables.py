"""Scans: driver tables, candles built from events, and registered series with availability and integrity rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch_hour


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def optional_table(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A catalog table, or no rows where it is missing."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def candles(events: DataFrame, by: str | None = "event_type") -> DataFrame:
    """key, h (hours since 1970), open, high, low, close, volume, trades and taker: hourly candles of event values.

    One partial and one final aggregation; the key and the hour are the only shuffle.
    """
    order = F.struct("ts", "event_id")
    key = F.col(by).cast("string") if by else F.lit("all")
    rows = events.select(key.alias("key"), epoch_hour(F.col("ts")).alias("h"), "ts", "event_id", "value", "user_id")
    return rows.groupBy("key", "h").agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"),
        F.sum("value").alias("volume"), F.count("*").alias("trades"), F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(0.0)).alias("taker"),
    )


def last_print_candles(events: DataFrame) -> DataFrame:
    """key, h, open, high, low, close from last prints only: open is the candle before's close, high and low span the two."""
    last = events.groupBy(F.col("event_type").alias("key"), epoch_hour(F.col("ts")).alias("h")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    opened = F.coalesce(F.lag("close").over(Window.partitionBy("key").orderBy("h")), F.col("close"))
    return last.withColumn("open", opened).select("key", "h", "open", F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low"), "close")


def latest_closed(series: DataFrame, now_hour: int, count: int) -> DataFrame:
    """The last ``count`` candles of each key that had closed by now_hour, the forming one dropped."""
    closed = series.where(F.col("h") + 1 <= now_hour)
    return closed.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("h")))).where(F.col("rn") <= count).drop("rn")


def daily_totals(orders: DataFrame) -> DataFrame:
    """d (days since 1970) and total: order value by day; a day without orders has no row."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return orders.groupBy(day.alias("d")).agg(F.sum("o_totalprice").alias("total"))


def first_usable(candidates: list[DataFrame], now_hour: int, error: Column | None = None) -> DataFrame | None:
    """The first series whose last candle is the hour that closed last, without invalid candles: those where error isn't null, which
    is candle_error unless given."""
    error = candle_error() if error is None else error
    for series in candidates:
        facts = series.agg(F.max("h").alias("last"), F.sum(error.isNotNull().cast("int")).alias("bad")).first()
        if facts["last"] == now_hour - 1 and not facts["bad"]:
            return series
    return None


def candle_error() -> Column:
    """Why a candle (open, high, low, close, volume) is refused, or null."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    missing = F.lit(False)
    for p in prices:
        missing = missing | p.isNull() | F.isnan(p) | (p <= 0)
    wide = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.col("low"))
    return F.when(missing, "price").when(F.col("volume").isNull() | F.isnan("volume") | (F.col("volume") < 0), "volume").when(wide, "range")


@dataclass(frozen=True)
class Registered:
    """A series file: its time column in hours, how many hours after its stamp a row may be seen, and, of its registered part, the
    rows, the leading bytes with the header, and their SHA-256."""

    name: str
    time: str
    delay: int
    rows: int | None = None
    refused: str | None = None
    size: int | None = None
    sha256: str | None = None


def read_registered(df: DataFrame, entry: Registered, until: int, sealed_from: int | None = None, unsealed: bool = False) -> DataFrame:
    """Rows of a registered series that could be seen by ``until``, with available_at; sealed rows only when unsealed."""
    if entry.refused:
        raise ValueError(f"{entry.name} is refused: {entry.refused}")
    seen = df.withColumn("available_at", F.col(entry.time) + entry.delay).where(F.col("available_at") <= until)
    return seen if unsealed or sealed_from is None else seen.where(F.col(entry.time) < sealed_from)


def integrity(df: DataFrame, time: str, by: list[str]) -> DataFrame:
    """One row a series: rows, first, last, how often time doesn't increase, irregular steps, and a checksum of sorted rows."""
    w = Window.partitionBy(*by).orderBy(time)
    step = F.col(time) - F.lag(time).over(w)
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), 256)
    marked = df.withColumn("step", step).withColumn("mark", F.conv(F.substring(row, 1, 12), 16, 10).cast("long"))
    return marked.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"), F.sum((F.col("step") <= 0).cast("long")).alias("not_increasing"),
        F.sum((F.col("step") > 1).cast("long")).alias("irregular"), F.sum("mark").alias("checksum"),
    )


class SnapshotError(ValueError):
    """A file that isn't what was registered."""


def check_snapshot(spark: SparkSession, path: str, entry: Registered) -> DataFrame:
    """The rows of a registered CSV file of whole numbers, after checks that it is the registered one: its first column, times that only
    increase, the number of rows, and the hash of its registered bytes. Raises SnapshotError otherwise.

    The file is hashed by the JVM as one value, so it must be under 2 GB, as a registered snapshot is.
    """
    if entry.refused:
        raise SnapshotError(f"{entry.name} is refused: {entry.refused}")
    head = spark.read.text(path).limit(1).collect()
    names = head[0].value.split(",") if head else []
    if names[:1] != [entry.time]:
        raise SnapshotError(f"{entry.name}: the first column isn't {entry.time!r}")
    if entry.sha256:
        part = F.expr(f"substring(content, 1, {entry.size})") if entry.size else F.col("content")
        found = spark.read.format("binaryFile").load(path).select(F.sha2(part, 256)).collect()
        if [x[0] for x in found] != [entry.sha256]:
            raise SnapshotError(f"{entry.name}: the registered bytes have changed")
    df = spark.read.schema(", ".join(f"`{n}` bigint" for n in names)).option("header", True).option("mode", "FAILFAST").csv(path)
    order = Window.orderBy("__at")  # one file's rows, in their order
    facts = df.withColumn("__at", F.monotonically_increasing_id()).select((F.col(entry.time) <= F.lag(entry.time).over(order)).cast("int").alias("back")).agg(F.count("*").alias("n"), F.sum("back").alias("back")).first()
    if facts["back"]:
        raise SnapshotError(f"{entry.name}: times don't only increase")
    if entry.rows is not None and facts["n"] != entry.rows:
        raise SnapshotError(f"{entry.name}: {facts['n']} rows, registered {entry.rows}")
    return df


def check_columns(df: DataFrame, reserved: tuple[str, ...] = ("ret_", "fwd_"), taken: tuple[str, ...] = ()) -> None:
    """Raise where a column starts with a prefix kept for outcomes, or is named as one that will be joined."""
    bad = [c for c in df.columns if c.startswith(reserved) or c in taken]
    if bad:
        raise ValueError(f"columns {bad} are reserved or taken")
