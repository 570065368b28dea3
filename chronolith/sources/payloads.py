"""Projections of semi-structured payloads: JSON fields, order books, option names, liquidations, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_number(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).cast("double")


def book_depth(levels: Column, mid: Column, share: float) -> Column:
    """Sum of price * size of the levels (array of struct price, size) within a share of mid."""
    near = F.filter(levels, lambda x: F.abs(x["price"] - mid) <= share * mid)
    return F.aggregate(near, F.lit(0.0), lambda acc, x: acc + x["price"] * x["size"])


def walk_book(levels: Column, notional: float) -> Column:
    """Average price at which a notional fills against sorted levels; null if the book is too thin."""
    start = F.struct(F.lit(float(notional)).alias("left"), F.lit(0.0).alias("size"))

    def take(acc, x):
        spent = F.least(acc["left"], x["price"] * x["size"])
        return F.struct((acc["left"] - spent).alias("left"), (acc["size"] + spent / x["price"]).alias("size"))

    done = F.aggregate(levels, start, take)
    return F.when(done["left"] <= 1e-9, notional / done["size"])


def option_parts(name: Column) -> dict[str, Column]:
    """Expiry day, strike and side of names like BTC-27JUN25-100000-C."""
    pattern = r"^[A-Z]+-([0-9]{1,2}[A-Z]{3}[0-9]{2})-([0-9]+)-([CP])$"
    part = lambda k: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, k))
    day = F.to_date(F.initcap(F.lower(part(1))), "dMMMyy")
    return {"expiry": day, "strike": part(2).cast("double"), "side": part(3)}


def liquidations(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Count and size by side over [start, end), each key once. rows: id, h, side, size."""
    inside = rows.where((F.col("h") >= start) & (F.col("h") < end)).dropDuplicates(["id"])
    return inside.groupBy("side").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def feed_time(published: Column, updated: Column) -> Column:
    """When a feed item could be known: the later of its stamps."""
    return F.greatest(published, updated)


#: The hour of the day, in UTC, at which options expire.
EXPIRY_HOUR = 8


def expiry_hour(code: Column) -> Column:
    """Hours since 1970 of the expiry that a code like 27JUN25 names; null for other texts."""
    day = F.to_date(F.initcap(F.lower(F.when(code.rlike(r"^[0-9]{1,2}[A-Z]{3}[0-9]{2}$"), code))), "dMMMyy")
    return (F.datediff(day, F.lit("1970-01-01").cast("date")) * 24 + EXPIRY_HOUR).cast("long")


def option_surface(rows: DataFrame, now: int, by: list[str]) -> DataFrame:
    """Two expiries of each group of ``by``: the nearest at least two days off (near) and that nearest to 30 days (d30), with the
    implied volatility at the money, of puts about 10 percent under it and calls as much over it, their difference, and open
    interest by side. rows: by, expiry (hours), strike, side (C or P), iv (null or 0: unknown), interest, underlying."""
    ahead = rows.withColumn("days", (F.col("expiry") - now) / 24).where("days >= 2")

    def iv(side: str, part: float) -> Column:
        off = F.abs(F.col("strike") - part * F.col("underlying"))
        known = (F.col("side") == side) & (F.col("iv") > 0)
        return F.min_by(F.when(known, F.col("iv")), F.when(known, F.struct(off, "strike", "iv")))

    interest = lambda side: F.sum(F.when(F.col("side") == side, F.col("interest")).otherwise(0.0))
    each = ahead.groupBy(*by, "expiry", "days").agg(iv("C", 1.0).alias("c"), iv("P", 1.0).alias("p"), iv("P", 0.9).alias("put90"), iv("C", 1.1).alias("call110"), interest("P").alias("put_oi"), interest("C").alias("call_oi"))
    few = Window.partitionBy(*by)  # a row an expiry
    each = each.withColumn("near", F.row_number().over(few.orderBy("days"))).withColumn("d30", F.row_number().over(few.orderBy(F.abs(F.col("days") - 30), "days")))
    picks = each.withColumn("pick", F.explode(F.array_compact(F.array(F.when(F.col("near") == 1, F.lit("near")), F.when(F.col("d30") == 1, F.lit("d30"))))))
    money = F.when(F.col("c").isNotNull() & F.col("p").isNotNull(), (F.col("c") + F.col("p")) / 2).otherwise(F.coalesce("c", "p"))
    return picks.select(*by, "pick", "expiry", "days", money.alias("atm_iv"), "put90", "call110", (F.col("put90") - F.col("call110")).alias("skew"), "put_oi", "call_oi")


def ticker(text: Column, symbol: str, fields: list[str]) -> Column:
    """Struct of the numbers of one symbol in {"tickers": [{"symbol": ...}, ...]}; null where the symbol is missing."""
    rows = F.from_json(text, "tickers array<struct<symbol: string, " + ", ".join(f"{f}: double" for f in fields) + ">>")["tickers"]
    return F.get(F.filter(rows, lambda x: x["symbol"] == symbol), F.lit(0))


def listed(text: Column, name: str, fields: list[str]) -> Column:
    """Struct of numbers of one name in [{"universe": [{"name": ...}]}, [{...}, ...]], where the second list follows the first;
    numbers may be texts."""
    names = F.from_json(F.get_json_object(text, "$[0].universe"), "array<struct<name: string>>")
    values = F.from_json(F.get_json_object(text, "$[1]"), "array<struct<" + ", ".join(f"{f}: string" for f in fields) + ">>")
    one = F.get(values, F.array_position(F.transform(names, lambda x: x["name"]), name).cast("int") - 1)
    return F.when(one.isNotNull(), F.struct(*[one[f].cast("double").alias(f) for f in fields]))


def by_place(text: Column, places: dict[str, int]) -> Column:
    """Struct of numbers of a JSON list by their places in it."""
    values = F.from_json(text, "array<double>")
    return F.struct(*[F.get(values, F.lit(k)).alias(n) for n, k in places.items()])


def book(text: Column, bands: tuple[float, ...] = (0.001, 0.005, 0.01, 0.02)) -> Column:
    """Struct of mid, spread in basis points, how far both sides reach, and money within each band of mid on both sides, of
    {"bids": [["price", "size"], ...], "asks": ...} from the best level on. Null where a side is empty."""
    sides = F.from_json(text, "bids array<array<string>>, asks array<array<string>>")
    level = lambda x: F.struct(x[0].cast("double").alias("price"), x[1].cast("double").alias("size"))
    bids, asks = F.transform(sides["bids"], level), F.transform(sides["asks"], level)
    bid, ask = F.get(bids, F.lit(0))["price"], F.get(asks, F.lit(0))["price"]
    mid = (bid + ask) / 2
    worth = lambda levels: F.aggregate(levels, F.lit(0.0), lambda a, x: a + x["price"] * x["size"])
    above, under = (lambda least: worth(F.filter(bids, lambda x: x["price"] >= least))), (lambda most: worth(F.filter(asks, lambda x: x["price"] <= most)))
    parts = [mid.alias("mid"), ((ask - bid) / mid * 1e4).alias("spread_bps"), (1 - F.element_at(bids, -1)["price"] / mid).alias("bid_reach"), (F.element_at(asks, -1)["price"] / mid - 1).alias("ask_reach")]
    for k, b in enumerate(bands):
        parts += [above(mid * (1 - b)).alias(f"bid_{k}"), under(mid * (1 + b)).alias(f"ask_{k}")]
    return F.when((F.size(bids) > 0) & (F.size(asks) > 0), F.struct(*parts))


def feed_stamp(text: Column) -> Column:
    """A mail-style or ISO time stamp; null for others."""
    mail = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(mail, F.try_to_timestamp(text))


def feed_items(text: Column) -> Column:
    """Array of items (title, link, summary, available_at) of an RSS or Atom document. Titles are trimmed, empty summaries null; an
    item without any stamp has a null available_at."""
    kind = "title string, link string, guid string, description string, summary string, pubDate string, published string, updated string"
    options = {"mode": "PERMISSIVE"}
    rss = F.from_xml(text, f"channel struct<item: array<struct<{kind}>>>", options)["channel"]["item"]
    atom = F.from_xml(text, f"entry array<struct<{kind}>>", options)["entry"]

    def item(x):
        summary = F.trim(F.coalesce(x["summary"], x["description"], F.lit("")))
        stamp = feed_time(feed_stamp(F.coalesce(x["pubDate"], x["published"])), feed_stamp(x["updated"]))
        return F.struct(F.trim(F.coalesce(x["title"], F.lit(""))).alias("title"), F.coalesce(x["link"], x["guid"], F.lit("")).alias("link"), F.when(summary != "", summary).alias("summary"), stamp.alias("available_at"))

    return F.transform(F.coalesce(rss, atom), item)
