"""Bitemporal reporting views: every view can be recomputed as known at a time. Times are hours since 1970."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import wilson


def known_at(predictions: DataFrame, outcomes: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Predictions recorded by ``at``, and outcomes checked by then whose prediction is visible."""
    seen = predictions.where(F.col("created_h") <= at)
    return seen, outcomes.where(F.col("checked_h") <= at).join(seen.select("id"), F.col("prediction_id") == F.col("id"), "left_semi")


def masked_outcome(df: DataFrame, at: int, columns: list[str], checked: str = "checked_h") -> DataFrame:
    """Rows recorded by ``at``, their outcome columns null unless checked by then."""
    known = F.col(checked).isNotNull() & (F.col(checked) <= at)
    return df.where(F.col("created_h") <= at).select(*[F.when(known, F.col(c)).alias(c) if c in (*columns, checked) else F.col(c) for c in df.columns])


def outcome_state(made: Column, horizon: Column, status: Column, at: int) -> Column:
    """graded or unavailable with an outcome; else pending until an hour after maturity, then overdue."""
    return F.when(status == "ok", "graded").when(status.isNotNull(), "unavailable").when(F.lit(at) <= made + horizon + 2, "pending").otherwise("overdue")


def run_view(predictions: DataFrame, outcomes: DataFrame, horizons: list[int], at: int) -> DataFrame:
    """A row a prediction and horizon as known at ``at``, with its outcome's state."""
    seen, graded = known_at(predictions, outcomes, at)
    asked = seen.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    out = asked.join(graded.select(F.col("prediction_id").alias("id"), "horizon", "status", "ret"), ["id", "horizon"], "left")
    return out.withColumn("state", outcome_state(F.col("h"), F.col("horizon"), F.col("status"), at))


def horizon_table(runs: DataFrame) -> DataFrame:
    """By horizon: predictions, graded, and how often an acted signal agreed with its outcome, with a Wilson interval."""
    acted = (F.col("state") == "graded") & F.col("signal").isin("BUY", "SELL")
    agreed = acted & (((F.col("signal") == "BUY") & (F.col("ret") > 0)) | ((F.col("signal") == "SELL") & (F.col("ret") < 0)))
    g = runs.groupBy("horizon").agg(F.count("*").alias("n"), F.sum((F.col("state") == "graded").cast("int")).alias("graded"), F.sum(acted.cast("int")).alias("acted"), F.sum(agreed.cast("int")).alias("agreed"), F.avg(F.when(F.col("state") == "graded", F.col("ret"))).alias("mean_ret"))
    low, high = wilson(F.col("agreed"), F.col("acted"))
    return g.withColumn("low", low).withColumn("high", high)


def weekly(runs: DataFrame, at: int) -> DataFrame:
    """Monday weeks that are complete at ``at``, with the change of the acted share from the week before."""
    week = F.floor((F.col("h") + 72) / 168).cast("long")  # 1970-01-01 was a Thursday
    g = runs.where(week * 168 - 72 + 168 <= at).groupBy(week.alias("week")).agg(F.count("*").alias("n"), F.avg(F.col("signal").isin("BUY", "SELL").cast("int")).alias("acted_share"))
    return g.withColumn("change", F.col("acted_share") - F.lag("acted_share").over(Window.orderBy("week")))  # a row a week


def window_health(rows: DataFrame, at: int, lengths: list[int]) -> DataFrame:
    """By window back from ``at``: expected hours, hours present, and the share."""
    asked = rows.select("key", "h").withColumn("hours", F.explode(F.array(*[F.lit(n) for n in lengths])))
    inside = asked.where((F.col("h") < at) & (F.col("h") >= at - F.col("hours"))).distinct()
    return inside.groupBy("key", "hours").agg(F.count("*").alias("present")).withColumn("share", F.col("present") / F.col("hours"))


def evidence(n: Column) -> Column:
    return F.when(n < 192, "none").when(n < 2000, "optimistic").otherwise("nominal")


def page(df: DataFrame, before: int, limit: int, time: str = "h") -> DataFrame:
    """The newest rows before a key, newest first."""
    return df.where(F.col(time) < before).orderBy(F.desc(time)).limit(limit)


def document(df: DataFrame, by: str) -> DataFrame:
    """One JSON document a key, nulls kept, rows in time order."""
    rows = F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != by])))
    return df.groupBy(by).agg(F.to_json(F.struct(rows.alias("rows")), {"ignoreNullFields": "false"}).alias("document"))


def transitions(expected: DataFrame, present: DataFrame, at: int, grace: int = 2) -> DataFrame:
    """Lost and recovered hours of each series: an hour without a row is lost once ``grace`` hours have passed; the first row
    after a loss is a recovery."""
    marked = expected.join(present.select("key", "h", F.lit(1).alias("ok")), ["key", "h"], "left").where(F.col("ok").isNotNull() | (F.col("h") + grace <= at))
    before = F.lag(F.coalesce(F.col("ok"), F.lit(0))).over(Window.partitionBy("key").orderBy("h"))
    event = F.when(F.col("ok").isNull() & (F.coalesce(before, F.lit(1)) == 1), "lost").when(F.col("ok").isNotNull() & (before == 0), "recovered")
    return marked.withColumn("event", event).where("event IS NOT NULL").select("key", "h", "event")


def gaps(rows: DataFrame, by: str = "key", time: str = "h") -> DataFrame:
    """by, saved, first_missing, last_missing and missing: the steps missing for good before each row that follows a gap."""
    before = F.lag(time).over(Window.partitionBy(by).orderBy(time))
    return rows.withColumn("__before", before).where(F.col(time) - F.col("__before") > 1).select(by, F.col(time).alias("saved"), (F.col("__before") + 1).alias("first_missing"), (F.col(time) - 1).alias("last_missing"), (F.col(time) - F.col("__before") - 1).alias("missing"))


def health(rows: DataFrame, most_age: int, most_errors: int, by: str = "key", time: str = "h") -> DataFrame:
    """by, age (hours since the newest row's hour closed, now being two hours after the newest of all), fresh, errors of the last six
    hours, calm, and ai: which calls of the newest row failed, by the names its meta document holds. rows: by, time, error, meta."""
    now = F.broadcast(rows.agg((F.max(time) + 2).alias("now")))
    recent = (F.col(time) >= F.col("now") - 6) & F.col("error")
    g = rows.join(now).groupBy(by).agg((F.first("now") - F.max(time) - 1).alias("age"), F.count(F.when(recent, 1)).alias("errors"), F.max_by("meta", time).alias("meta"))
    failed = [F.when(F.get_json_object("meta", f"$.{name}").isNotNull(), F.lit(text)) for name, text in (("news_error", "the news step failed"), ("explanation_error", "the explanation failed"))]
    return g.select(by, "age", (F.col("age") <= most_age).alias("fresh"), "errors", (F.col("errors") <= most_errors).alias("calm"), F.concat_ws(" and ", *failed).alias("ai"))


def incident_error(name: Column, severity: Column, began: Column) -> Column:
    """The first field of an incident that isn't as it must be, or null."""
    stamp = r"^[0-9]{4}-(0[1-9]|1[0-2])-[0-9]{2}T[0-9]{2}:[0-9]{2}Z$"
    return F.when(~name.rlike(r"^inc-[0-9]{8}$"), "name").when(~severity.isin("minor", "major"), "severity").when(~began.rlike(stamp), "began")


def move_size_record(rows: DataFrame, checkpoints: tuple[int, ...], by: str = "key") -> DataFrame:
    """Counts of states, the share of large moves among graded rows, and how many checkpoints these have reached. rows: by, state, y."""
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    graded = n("graded")
    reached = sum(((graded >= c).cast("int") for c in checkpoints), F.lit(0))
    return rows.groupBy(by).agg(F.count("*").alias("rows"), graded.alias("graded"), n("pending").alias("pending"), n("outcome_unavailable").alias("unavailable"), n("no_probability").alias("no_probability"), F.avg(F.when(F.col("state") == "graded", F.col("y"))).alias("large_share"), reached.alias("reached"))


def in_time(rows: DataFrame, due: Column, came: Column, grace: int) -> DataFrame:
    """Rows that came at most ``grace`` steps before they were due, or after; others are too late to be used."""
    return rows.where(due - came <= grace)


def checklist(rows: DataFrame, by: list[str], checks: dict[str, Column]) -> DataFrame:
    """by, name and ok of each check, an aggregate condition; unknown counts as failed."""
    done = rows.groupBy(*by).agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("ok")) for n in checks]))
    return done.select(*by, each.alias("x")).select(*by, "x.*")


def news_reason(known: Column, cutoff: Column, hours: int = 24) -> Column:
    """Why an item doesn't count at the cutoff, or eligible: undated, after_cutoff, or too_old from exactly so many hours on."""
    oldest = cutoff - F.expr(f"INTERVAL {hours} HOURS")
    return F.when(known.isNull(), "undated").when(known > cutoff, "after_cutoff").when(known <= oldest, "too_old").otherwise("eligible")


def fills(orders: DataFrame, slippage: float, fee: float, least: float) -> DataFrame:
    """orders (side 1 or -1, amount, price) with refused (under the least order), at (the price paid), fee, and units: what the
    position changes by. A buy's fee comes out of its amount."""
    at = F.col("price") * (1 + slippage * F.col("side"))
    paid = F.col("amount") * fee
    net = F.when(F.col("side") > 0, F.col("amount") - paid).otherwise(F.col("amount"))
    return orders.select("*", (F.col("amount") < least).alias("refused"), at.alias("at"), paid.alias("fee"), (F.col("side") * net / at).alias("units"))
