"""Joins on time: exact shifts, as-of with availability, offset and tolerance, intervals, comparisons, greedy near-duplicates."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from . import titles


def at_shift(df: DataFrame, shift: int, columns: dict[str, str], time: str = "h", by: tuple[str, ...] = ("key",)) -> DataFrame:
    """df with columns of its own row exactly ``shift`` steps later (earlier if negative); null where there is none."""
    other = df.select(*by, (F.col(time) - shift).alias(time), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(other, [*by, time], "left")


def at_shifts(df: DataFrame, shifts: list[int], value: str, time: str = "h", by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Long form: each row and shift with the value then (``later``), one join for all shifts."""
    asked = df.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumn("__to", F.col(time) + F.col("shift"))
    other = df.select(*by, F.col(time).alias("__to"), F.col(value).alias("later"))
    return asked.join(other, [*by, "__to"], "left").drop("__to")


def asof(left: DataFrame, right: DataFrame, columns: list[str], left_on: str, right_on: str, by: tuple[str, ...] = (), tolerance: int | None = None) -> DataFrame:
    """left with columns of the last right row known at or before it, and known_at, when that was.

    Union, one shuffle by ``by``, one pass: a right row at the same time comes before the left row, so the cutoff is
    inclusive. Older than the tolerance counts as unknown. Of right rows of one time the last by the columns wins.
    """
    stamp = F.struct(F.col(right_on).alias("at"), *[F.col(c) for c in columns])
    names = [c for c in left.columns if c not in by]
    tagged_right = right.select(*by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), stamp.alias("__seen"), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("__row"))
    tagged_left = left.select(*by, F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(tagged_right.schema["__seen"].dataType).alias("__seen"), F.struct(*names).alias("__row"))
    w = Window.partitionBy(*by).orderBy("__t", "__side", "__seen").rowsBetween(Window.unboundedPreceding, 0)
    out = tagged_right.unionByName(tagged_left).withColumn("__last", F.last("__seen", True).over(w)).where("__side = 1")
    valid = F.lit(True) if tolerance is None else F.col("__t") - F.col("__last.at") <= tolerance
    return out.select(*by, "__row.*", *[F.when(valid, F.col(f"__last.{c}")).alias(c) for c in columns], F.when(valid, F.col("__last.at")).alias("known_at"))


def interval(left: DataFrame, right: DataFrame, left_on: str, right_on: str, length: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with left_on < right_on <= left_on + length: an equi-join on time buckets of that length, then the exact test."""
    near = left.withColumn("__b", F.explode(F.array(F.floor(F.col(left_on) / length), F.floor(F.col(left_on) / length) + 1)))
    keyed = right.withColumn("__b", F.floor(F.col(right_on) / length))
    return near.join(keyed, [*by, "__b"]).where((F.col(right_on) > F.col(left_on)) & (F.col(right_on) <= F.col(left_on) + length)).drop("__b")


def differences(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], same) -> DataFrame:
    """Keys on one side only or with columns that differ: key, side (both, left, right) and fields (names, sorted)."""
    left, right = (d.select(*key, F.struct(*columns).alias(n)) for d, n in ((a, "l"), (b, "r")))
    j = left.join(right, key, "full_outer")
    fields = F.array_compact(F.array(*[F.when(~same(F.col(f"l.{c}"), F.col(f"r.{c}")), F.lit(c)) for c in sorted(columns)]))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return j.select(*key, side.alias("side"), F.when(side == "both", fields).otherwise(F.array().cast("array<string>")).alias("fields")).where((F.col("side") != "both") | (F.size("fields") > 0))


def near_duplicates(df: DataFrame, by: str, order: str, text: str, least: float = 0.75) -> DataFrame:
    """Rows kept when, in order, each is dropped whose text matches one kept before in its group by at least a ratio.

    The order of decisions makes this sequential; groups (``by``) are windows of one subject and hold few rows. Lengths
    and letter counts bound the ratio, so most pairs are never compared in full.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, rows = [], []
        for i, t in pdf.sort_values([order, text])[text].fillna("").items():
            m = SequenceMatcher(None, t, "", autojunk=True)
            m.set_seq1(t)
            for k in kept:
                m.set_seq2(k)
                if m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least:
                    break
            else:
                kept.append(t)
                rows.append(i)
        return pdf.loc[rows]

    return df.groupBy(by).applyInPandas(keep, df.schema)


def near_duplicates_of_all(df: DataFrame, order: str, text: str, least: float = 0.75, block: int | None = None, at_once: int = 200_000) -> DataFrame:
    """As near_duplicates, with the whole table as one group. Equal texts are one class; classes meet in pairs of blocks of about so many
    classes (else some 16 blocks, of 250 to 4000), by length, that run in parallel. Bounds in ``titles`` leave few pairs, whose ratio is taken in full; linked pairs then decide,
    round by round. While more than ``at_once`` pairs are left to compare, only those with an earlier class that surely stays are.

    Pairs whose lengths could match still meet in the bounds, so that work is the square of the number of different texts.
    """
    spark = df.sparkSession
    shared_dir(spark)
    first = F.min(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.struct(*[df[c] for c in df.columns]).alias("row")))
    classes = df.groupBy(F.coalesce(text, F.lit("")).alias("__text")).agg(first.alias("__first"))
    classes = classes.withColumns({"__id": F.monotonically_increasing_id(), "__n": F.length("__text")}).checkpoint()
    counts = {r["__n"]: r["count"] for r in classes.groupBy("__n").count().collect()}
    block = block or min(4000, max(250, sum(counts.values()) // 16))
    dealt, spans = titles.length_blocks(counts, least, block, 2000 * block)
    if not dealt:
        return classes.select("__first.row.*")
    tasks = min(sum(last - k + 1 for k, _, last in spans), max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    places, spans = spark.createDataFrame(dealt, "__n int, at int, parts int"), spark.createDataFrame(spans, "mine int, low int, high int")
    placed = classes.join(F.broadcast(places), "__n").withColumn("mine", (F.col("at") + F.pmod(F.xxhash64("__text"), F.col("parts"))).cast("int"))
    placed = placed.join(F.broadcast(spans), "mine").withColumn("other", F.explode(F.sequence("low", "high")))
    met = placed.select("mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.col("__id").alias("id"), F.col("__first.o").alias("o"), F.col("__text").alias("t"))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        pdf = pdf.iloc[np.argsort(pdf["t"].str.len().to_numpy(), kind="stable")]
        texts, mine = pdf["t"].tolist(), pdf["mine"].to_numpy()
        left = np.flatnonzero(mine == i)
        sizes, rank = np.array([len(t) for t in texts], np.int64), pdf["o"].rank(method="dense").to_numpy()
        a, b = titles.candidates(texts, sizes, rank, left, left if i == j else np.flatnonzero(mine == j), least)
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    key = F.struct(F.col("__first.o").alias("o"), "__text", F.col("__id").alias("id"))
    keyed = lambda name: classes.select(F.col("__id").alias(name), key.alias(f"__{name}"))
    pairs = met.repartition(tasks, "i", "j").groupBy("i", "j").applyInPandas(near, "a long, b long").join(keyed("a"), "a").join(keyed("b"), "b")
    left = pairs.select(F.greatest("__a", "__b")["id"].alias("late"), F.least("__a", "__b")["id"].alias("early")).checkpoint()

    def linked(batches):
        m, seen = SequenceMatcher(None, "", "", autojunk=True), None
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for k, (early, e, t) in enumerate(zip(pdf["early"], pdf["e"], pdf["t"], strict=True)):
                if early != seen:  # what the matcher knows of its second text serves all pairs with it
                    m.set_seq2(e)
                    seen = early
                m.set_seq1(t)
                keep[k] = m.ratio() >= least
            yield pdf.loc[keep, ["late", "early"]]

    def compared(ids: DataFrame) -> DataFrame:
        of = lambda name, t: classes.select(F.col("__id").alias(name), F.col("__text").alias(t))
        rows = ids.join(of("early", "e"), "early").join(of("late", "t"), "late").select("late", "early", "e", "t")
        return rows.repartition("early", F.pmod("late", F.lit(16))).sortWithinPartitions("early").mapInPandas(linked, "late long, early long").checkpoint()

    gone = spark.createDataFrame([], "late long")
    exact = False
    while not left.isEmpty():
        if not exact and left.count() <= at_once:
            left, exact = compared(left), True
            continue
        late = left.select(F.col("late").alias("early")).distinct()
        stays = left.join(late, "early", "left_anti")
        now = (stays if exact else compared(stays)).select("late").distinct().checkpoint()
        gone = gone.unionByName(now).checkpoint()
        left = left.join(late, "early", "left_semi").join(now, "late", "left_anti")
        left = left.join(now.select(F.col("late").alias("early")), "early", "left_anti").select("late", "early").checkpoint()
    return classes.join(gone, F.col("__id") == F.col("late"), "left_anti").select("__first.row.*")


def in_folds(df: DataFrame, folds: DataFrame, time: str = "h") -> DataFrame:
    """Rows with the folds and parts (train, calib, test) whose half-open bounds hold them. folds: a row a fold, broadcast."""
    parts = folds.select("fold", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"{p}_start").alias("a"), F.col(f"{p}_end").alias("b")) for p in ("train", "calib", "test")])).alias("p")).select("fold", "p.*")
    return df.join(F.broadcast(parts), (F.col(time) >= F.col("a")) & (F.col(time) < F.col("b"))).drop("a", "b")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
