"""A set of daily strategies as column expressions: each says what it wants of a day (1 in, 0 out, null as before), under which stops,
and how large. Families are built from their parameters; the set has 118 members.

Days are known by their own closes and earlier ones only. Changes are against exactly so many days before; means and extremes are over
the last available days.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp
from .grid import densify, full
from .simulate import Rule
from .windows import expanding_quantile

# The parameters of the families.
BACK = (7, 14, 28, 56, 84, 182)
TREND_BACK = (7, 14, 28, 84, 182)
MEANS = (20, 50, 100, 200)
CROSSES = ((20, 100), (50, 200))
TRENDS = ((2, 0.2), (6, 0.6), (10, 0.999))
BANDS, BAND_MEANS = (1, 3, 5), (50, 100, 200)
UPS, DOWNS = (20, 55), (10, 20)
DIPS, HOLDS = (3, 5, 8), (3, 7, 14)
SIZED = ("G_up55_down20", "C_MA100_b5", "A_sig23", "BH")
MODES = ("msmore", "msless", "vol")
VOTE = 0.15


def inputs(days: DataFrame, by: str = "key") -> DataFrame:
    """What the strategies look at, for each day with a price. days: by, d, price, sig23 (1, 0, -1), vote and pbar; gaps are allowed."""
    grid = Window.partitionBy(by).orderBy("d")
    g = densify(days, "d", (by,)).withColumn("lr", F.log("price") - F.log(F.lag("price").over(grid)))
    month = grid.rowsBetween(-29, 0)
    g = g.select("*", *[(F.col("price") / F.lag("price", k).over(grid) - 1).alias(f"R{k}") for k in (1, *BACK)], F.when(F.count("lr").over(month) >= 20, F.stddev_samp("lr").over(month)).alias("sigma"))
    g = g.where("price IS NOT NULL").drop("lr")
    last = lambda n: grid.rowsBetween(1 - n, 0)
    before = lambda n: grid.rowsBetween(-n, -1)
    g = g.select("*", *[full(F.avg("price"), F.col("price"), n, last(n)).alias(f"SMA{n}") for n in MEANS], *[full(f("price"), F.col("price"), n, before(n)).alias(f"{name}{n}") for name, f, of in (("HI", F.max, UPS), ("LO", F.min, DOWNS)) for n in of], F.lag("sig23").over(grid).alias("sig_before"))
    trend = sum((F.signum(f"R{k}") for k in TREND_BACK), F.lit(0.0)) / len(TREND_BACK)
    g = g.select("*", *[(F.col("price") / F.col(f"SMA{n}") - 1).alias(f"MA{n}") for n in MEANS], *[(F.col(f"SMA{a}") / F.col(f"SMA{b}") - 1).alias(f"X{a}_{b}") for a, b in CROSSES], trend.alias("TREND"))
    g = expanding_quantile(g, "sigma", 0.5, 1, "median", "d", by)
    return g.withColumn("calm", F.when(F.col("median").isNotNull() & F.col("sigma").isNotNull(), (F.col("sigma") <= F.col("median")).cast("double")))


@dataclass(frozen=True)
class Strategy:
    desired: Column
    rule: Rule = Rule()
    mode: str = "full"


def either(up: Column, down: Column) -> Column:
    """1 where up, 0 where down, null where neither."""
    return F.when(up, 1.0).when(down, 0.0)


def sign(x: Column) -> Column:
    return F.when(x.isNotNull(), (x > 0).cast("double"))


def strategies() -> dict[str, Strategy]:
    c = F.col
    sig = either(c("sig23") == 1, c("sig23") == -1)
    vote = either(c("vote") >= VOTE, c("vote") <= -VOTE)
    base = {f"B_{n}": sign(c(n)) for n in (*[f"R{k}" for k in BACK], *[f"MA{n}" for n in MEANS], *[f"X{a}_{b}" for a, b in CROSSES])}
    base |= {f"B_TREND{n:02d}": F.when(c("TREND").isNotNull(), (c("TREND") >= least).cast("double")) for n, least in TRENDS}
    base |= {f"C_MA{n}_b{b}": either(c(f"MA{n}") > b / 100, c(f"MA{n}") < -b / 100) for n in BAND_MEANS for b in BANDS}
    # a price can't be above the highest and under the lowest at once
    base |= {f"G_up{n}_down{m}": either(c("price") > c(f"HI{n}"), c("price") < c(f"LO{m}")) for n in UPS for m in DOWNS}
    long, steady, calm = F.coalesce(c("MA200") > 0, F.lit(False)), F.coalesce(c("TREND") >= 0.6, F.lit(False)), c("calm")
    out = {"A_sig23": Strategy(sig), "A_vote": Strategy(vote), "A_confirm2": Strategy(either((c("sig23") == 1) & (c("sig_before") == 1), (c("sig23") == -1) & (c("sig_before") == -1)))}
    out |= {k: Strategy(v) for k, v in base.items()}
    out |= {f"D_{name}_{gate}": Strategy(F.when(~ok, 0.0).otherwise(a)) for name, a in (("sig23", sig), ("vote", vote)) for gate, ok in (("ma200", long), ("trend", steady))}
    out |= {"E_calm_ma200": Strategy(F.when(calm.isNotNull(), ((calm == 1) & long).cast("double"))), "E_calm": Strategy(calm)}
    out |= {f"F_dip{x}_hold{h}": Strategy(F.when(c("R1") <= -x / 100, 1.0), Rule(time_stop=h)) for x in DIPS for h in HOLDS}
    held = {**base, "BH": F.lit(1.0)}
    for k, v in held.items():
        out |= {f"H_{k}_sl10": Strategy(v, Rule(stop_loss=0.10)), f"H_{k}_tr15": Strategy(v, Rule(trailing=0.15))}
    for k in SIZED:
        out |= {f"MS_{k}_{m}": Strategy(F.lit(1.0) if k == "BH" else out[k].desired, Rule(sized=True), m) for m in MODES}
    return out | {"BASE_buy_and_hold": Strategy(F.lit(1.0)), "BASE_cash": Strategy(F.lit(0.0))}


def size(mode: str) -> Column:
    """Share of a sized strategy: by the chance of a large move, more or less of it, or by volatility; a quarter where unknown."""
    within = lambda x: F.coalesce(clamp(x, 0.25, 1.0), F.lit(0.25))
    return {"full": F.lit(None).cast("double"), "msmore": within((F.col("pbar") - 0.20) / 0.40), "msless": within((0.60 - F.col("pbar")) / 0.40), "vol": within(F.when(F.col("sigma") > 0, 0.0294 / F.col("sigma")))}[mode]


def wishes(seen: DataFrame, by: str = "key") -> DataFrame:
    """by, d, price, rule, desired and size: a row for each strategy and day of ``inputs``."""
    each = [F.struct(F.lit(n).alias("rule"), s.desired.cast("double").alias("desired"), size(s.mode).alias("size")) for n, s in strategies().items()]
    return seen.select(by, "d", "price", F.explode(F.array(*each)).alias("s")).select(by, "d", "price", "s.*")
