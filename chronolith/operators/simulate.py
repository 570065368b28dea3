"""Sequential account simulations: one fold over time for each (series, rule), many in parallel.

State is a few numbers, so the same step functions serve grouped pandas here and stateful streaming.
"""

from __future__ import annotations

from bisect import insort
from collections import deque
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BAND = 0.20
#: Stops after which an account stays out until the signal has wanted out once.
PROTECTIVE = ("stop_loss", "trailing_stop")


@dataclass
class Account:
    cash: float = 1000.0
    units: float = 0.0
    entry: float = 0.0
    peak: float = 0.0
    held: int = 0
    blocked: bool = False
    inside: bool = False
    trades: int = 0

    def value(self, price: float) -> float:
        return self.cash + self.units * price

    def buy(self, amount: float, price: float, fee: float) -> None:
        """The fee is taken out of the amount."""
        self.units += (amount - amount * fee) / price
        self.cash -= amount
        self.trades += 1

    def sell(self, units: float, price: float, fee: float) -> None:
        gross = units * price
        self.cash += gross - gross * fee
        self.units = max(self.units - units, 0.0)
        self.trades += 1


@dataclass(frozen=True)
class Rule:
    stop_loss: float | None = None
    trailing: float | None = None
    time_stop: int | None = None
    sized: bool = False

    def exit_reason(self, a: Account, price: float, desired: float | None) -> str | None:
        """Why an account that holds leaves at this price; stops come before time, time before the signal."""
        hit = {
            "stop_loss": self.stop_loss is not None and price <= a.entry * (1 - self.stop_loss),
            "trailing_stop": self.trailing is not None and price <= a.peak * (1 - self.trailing),
            "time_stop": self.time_stop is not None and a.held >= self.time_stop,
            "signal": desired == 0,
        }
        return next((reason for reason, is_hit in hit.items() if is_hit), None)


def full_step(a: Account, price: float, desired: float | None, rule: Rule, fee: float, spread: float = 0.0) -> str:
    """All in or all out; returns what happened. A protective stop against the signal blocks entries until it wants out. spread: how
    far bids and asks are from the price, as a share of it."""
    action = "keep"
    if a.units > 0:
        a.held, a.peak = a.held + 1, max(a.peak, price)
        reason = rule.exit_reason(a, price, desired)
        if reason:
            a.sell(a.units, price * (1 - spread), fee)
            a.entry, a.peak, a.held, a.blocked = 0.0, 0.0, 0, reason in PROTECTIVE
            action = reason
    elif desired == 1 and not a.blocked:
        a.buy(a.cash, price * (1 + spread), fee)
        a.entry, a.peak, a.held = price, price, 0
        action = "enter"
    a.blocked = a.blocked and desired != 0
    return action


def sized_step(a: Account, price: float, desired: float | None, size: float, fee: float, spread: float = 0.0) -> str:
    """Holds a share ``size`` while in; trades on entering, leaving, or when the share is off by the band."""
    if desired in (0, 1):
        a.inside = desired == 1
    target, total, worth = size if a.inside else 0.0, a.value(price), a.units * price
    kind = "enter" if target > 0 and a.units == 0 else "leave" if target == 0 and a.units > 0 else "resize"
    off = target - (worth / total if total > 0 else 0.0)
    if kind == "resize" and abs(off) < BAND:
        return "keep"
    change = target * total - worth
    if change > 0 and a.cash > 0:
        a.buy(min(change, a.cash), price * (1 + spread), fee)
    elif change < 0:
        bid = price * (1 - spread)
        a.sell(a.units if kind == "leave" else min(a.units, -change / bid), bid, fee)
    else:
        return "keep"
    return kind


LEDGER = ["action", "cash", "units", "value", "trades"]


def strategy_accounts(asked: DataFrame, rules: dict[str, Rule], books: dict[str, tuple[float, float]], by: str = "key", time: str = "d") -> DataFrame:
    """A ledger row a (series, rule, book, day): action, cash, units, value and trades. asked: by, rule, time, price, desired and size;
    books: fee and spread by name. Days without a price are not seen; an unknown size counts as a quarter."""
    kind = asked.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, rule string, book string, {time} bigint, action string, cash double, units double, value double, trades int"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rule, (fee, spread), a, out = rules[key[1]], books[key[2]], Account(), []
        pdf = pdf[pdf["price"] > 0].sort_values(time)
        for t, price, desired, size in zip(*(pdf[c].tolist() for c in (time, "price", "desired", "size")), strict=True):
            desired = None if desired is None or desired != desired else desired
            if rule.sized:
                action = sized_step(a, price, desired, 0.25 if size is None or size != size else size, fee, spread)
            else:
                action = full_step(a, price, desired, rule, fee, spread)
            out.append((*key, t, action, a.cash, a.units, a.value(price), a.trades))
        return pd.DataFrame(out, columns=[by, "rule", "book", time, *LEDGER])

    numbers = [F.col(c).cast("double").alias(c) for c in ("price", "desired", "size")]
    each = asked.select(by, "rule", time, *numbers, F.explode(F.array(*[F.lit(b) for b in books])).alias("book"))
    return each.groupBy(by, "rule", "book").applyInPandas(run, schema)


def paper_accounts(days: DataFrame, rules: dict[str, Rule], by: str = "key", time: str = "d", fee: float = 0.001) -> DataFrame:
    """The ledger of rules that all want the same of a day, in one book without a spread. days: by, time, price, desired, size."""
    asked = days.select(by, time, "price", "desired", "size", F.explode(F.array(*[F.lit(n) for n in rules])).alias("rule"))
    return strategy_accounts(asked, rules, {"model": (fee, 0.0)}, by, time).drop("book")


@dataclass(frozen=True)
class Limits:
    """Constants of the hourly rule engine; hours, shares of the capital, or money."""

    drawdown: float = 0.30
    day_loss: float = 0.10
    halt: int = 168
    min_hold: int = 6
    per_day: int = 4
    band: float = 0.20
    vol_target: float = 0.006
    vol_floor: float = 0.25
    move_floor: float = 0.5
    least: float = 10.0
    resize: bool = True


def sizes(vol: np.ndarray, p: np.ndarray, limits: Limits) -> np.ndarray:
    """Share of the capital by volatility and by the chance of a large move; an unknown one counts as its floor."""
    with np.errstate(divide="ignore", invalid="ignore"):
        by_vol = np.where(vol > 0, np.clip(limits.vol_target / vol, limits.vol_floor, 1.0), limits.vol_floor)
    by_move = np.where(np.isnan(p), limits.move_floor, np.clip(1.5 - p, limits.move_floor, 1.0))
    return np.minimum(by_vol, by_move)


def wanted_order(a: Account, price: float, signal: int, size: float, capital: float, limits: Limits, last: tuple[int, int] | None, h: int) -> float:
    """Money to buy (positive) or to sell (negative) in this hour, 0 for none, before the limit of orders a day."""
    exposure = a.units * price
    if signal == 1 and not limits.resize and exposure >= limits.least:
        signal = 0
    base = min(capital, a.value(price))
    target = {1: base * size, 0: min(exposure, base), -1: 0.0}[signal]
    change = target - exposure
    side = 1 if change > 0 else -1
    if abs(change) < 1e-9 or (last and last[1] != side and h - last[0] < limits.min_hold):
        return 0.0
    resizing = target != 0.0 and exposure > 0
    if abs(change) < max(limits.least, limits.band * capital if resizing else 0.0):
        return 0.0
    if side == 1:
        amount = min(change, a.cash)
        return amount if amount >= limits.least else 0.0
    return -exposure if target == 0.0 else change


def hourly_policy(hours: np.ndarray, price: np.ndarray, signal: np.ndarray, size: np.ndarray, limits: Limits, cost: float, capital: float = 1000.0) -> pd.DataFrame:
    """Equity by hour of one series under halts, holding times, order limits and sizing. signal: 1 buy, 0 hold, -1 sell.

    A drawdown or a day's loss beyond its limit sells all and halts for a while; the peak starts again afterwards. The money
    at work never exceeds the capital; a turn waits min_hold hours since the last order; orders of a resize need the band.
    """
    a, peak, resume, last, recent, worth, out = Account(cash=capital), capital, None, None, deque(), {}, []
    for h, x, s, share in zip(hours.tolist(), price.tolist(), signal.tolist(), size.tolist(), strict=True):
        if resume is not None and h >= resume:
            resume, peak = None, a.value(x)
        equity, action, order = a.value(x), "keep", 0.0
        if resume is None:
            day_ago = worth.get(h - 24)
            top = max(peak, equity)
            if (top > 0 and 1 - equity / top > limits.drawdown) or (day_ago and 1 - equity / day_ago > limits.day_loss):
                resume, action = h + limits.halt, "halt"
                order = -a.units * x if a.units * x >= limits.least else 0.0
            else:
                while recent and h - recent[0] >= 24:
                    recent.popleft()
                if len(recent) < limits.per_day:
                    order = wanted_order(a, x, s, share, capital, limits, last, h)
        if order:
            action = "exit" if action == "halt" else "buy" if order > 0 else "sell"
            if order > 0:
                a.buy(order, x, cost)
            else:
                a.sell(a.units if order == -a.units * x else min(a.units, -order / x), x, cost)
            last = (h, 1 if order > 0 else -1)
            recent.append(h)
        after = a.value(x)
        peak = max(peak, after)
        worth[h] = after
        worth.pop(h - 48, None)
        out.append((h, action, a.units * x, after))
    return pd.DataFrame(out, columns=["h", "action", "exposure", "equity"])


@dataclass(frozen=True)
class Selectors:
    """Constants of the signals that policies trade on."""

    persist: int = 6
    buy: float = 0.15
    sell: float = -0.15
    quantile: float = 0.90
    least_scores: int = 2000
    least_outcomes: int = 500
    horizon: int = 24
    days: int = 200


def run_length(hours: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Successive hours with the same value up to each row; a missing hour ends a run."""
    at = np.arange(len(hours))
    new = np.ones(len(hours), bool)
    new[1:] = (np.diff(hours) != 1) | (value[1:] != value[:-1])
    return at - np.maximum.accumulate(np.where(new, at, 0)) + 1


def threshold(score: np.ndarray, k: Selectors) -> np.ndarray:
    """The linear quantile of the sizes of all earlier scores, NaN before least_scores of them."""
    out, held = np.full(len(score), np.nan), []
    for i, x in enumerate(np.abs(score).tolist()):
        if len(held) >= max(1, k.least_scores):
            place = k.quantile * (len(held) - 1)
            low = held[int(place)]
            out[i] = low + (held[min(int(place) + 1, len(held) - 1)] - low) * (place - int(place))
        insort(held, x)
    return out


def expected_return(hours: np.ndarray, price: np.ndarray, signal: np.ndarray, k: Selectors) -> np.ndarray:
    """Mean return over the horizon of earlier rows in the same state (signal and length of its run: up to 5, up to 23, more)
    whose outcome is known, NaN before least_outcomes of them."""
    later = np.searchsorted(hours, hours + k.horizon)
    there = (later < len(hours)) & (hours[np.minimum(later, len(hours) - 1)] == hours + k.horizon)
    ret = np.where(there, price[np.minimum(later, len(hours) - 1)] / price - 1, np.nan)
    state = (signal + 1) * 3 + np.searchsorted([5, 23], run_length(hours, signal))
    known = np.searchsorted(hours, hours - k.horizon, "right")  # rows whose outcome is in
    out = np.full(len(hours), np.nan)
    for s in np.unique(state):
        mine = (state == s) & ~np.isnan(ret)
        total, count = (np.concatenate([[0.0], np.cumsum(np.where(mine, x, 0))])[known] for x in (ret, 1.0))
        ask = (state == s) & (count >= max(1, k.least_outcomes))
        out[ask] = total[ask] / count[ask]
    return out


def above_mean(hours: np.ndarray, price: np.ndarray, k: Selectors) -> np.ndarray:
    """At the last hour of a day: 1 where the price is above the mean of the last ``days`` such prices, 0 where not; else NaN."""
    out, last = np.full(len(hours), np.nan), np.flatnonzero(hours % 24 == 23)
    if len(last) >= k.days:
        sums = np.concatenate([[0.0], np.cumsum(price[last])])
        mean = (sums[k.days :] - sums[: -k.days]) / k.days
        out[last[k.days - 1 :]] = price[last[k.days - 1 :]] > mean
    return out


def effective(kind: str, hours: np.ndarray, price: np.ndarray, signal: np.ndarray, score: np.ndarray, cost: float, k: Selectors) -> np.ndarray:
    """The signal that a kind of policy trades on: 1, 0 or -1."""
    if kind == "persist":
        return np.where(run_length(hours, signal) >= k.persist, signal, 0)
    if kind == "vote":
        mean = pd.Series(score).groupby(hours // 24).transform("mean").to_numpy()
        return np.where(hours % 24 == 23, (mean >= k.buy).astype(int) - (mean <= k.sell), 0)
    if kind == "strong":
        edge = threshold(score, k)
        return (score >= edge).astype(int) - (score <= -edge)
    if kind == "gate":
        gain = expected_return(hours, price, signal, k)
        return (gain > 2 * cost).astype(int) - (gain < -2 * cost)
    return signal


#: Policies: the signal they trade on, orders a day, and whether a buy while invested resizes.
POLICIES = {
    "A4": ("raw", 4, True), "A2": ("raw", 2, True), "A1": ("raw", 1, True),
    "B1_persist_cap1": ("persist", 1, False), "B1_persist_cap2": ("persist", 2, False), "B2_daily_vote": ("vote", 1, False),
    "B3_strong_cap1": ("strong", 1, False), "B3_strong_cap2": ("strong", 2, False), "B4_gate_cap1": ("gate", 1, False), "B4_gate_cap2": ("gate", 2, False),
}
PASSIVE = ("C1_buy_and_hold", "C2_cash", "C3_ma200d")


def passive(policy: str, hours: np.ndarray, price: np.ndarray, cost: float, k: Selectors, capital: float) -> pd.DataFrame:
    """Buy and hold, cash, or in while the price is above its long mean."""
    a, out = Account(cash=capital), []
    wants = {"C1_buy_and_hold": np.ones(len(hours)), "C2_cash": np.zeros(len(hours))}.get(policy)
    wants = above_mean(hours, price, k) if wants is None else wants
    for h, x, want in zip(hours.tolist(), price.tolist(), wants.tolist(), strict=True):
        action = "keep"
        if want == 1 and a.units == 0:
            a.buy(a.cash, x, cost)
            action = "buy"
        elif want == 0 and a.units > 0:
            a.sell(a.units, x, cost)
            action = "sell"
        out.append((h, action, a.units * x, a.value(x)))
    return pd.DataFrame(out, columns=["h", "action", "exposure", "equity"])


def policies(series: DataFrame, costs: list[float], limits: Limits | None = None, by: str = "key", selectors: Selectors | None = None, capital: float = 1000.0) -> DataFrame:
    """by, cost, policy, h, action, exposure, equity of the ten rule policies and three passive ones. Groups run in parallel.
    series: by, h, price, signal, score, vol, p. Rows without a price are not seen; empty series give no rows."""
    limits, k = limits or Limits(), selectors or Selectors()
    kind = series.schema[by].dataType.simpleString()
    grid = F.array(*[F.struct(F.lit(c).alias("cost"), F.lit(p).alias("policy")) for c in costs for p in (*POLICIES, *PASSIVE)])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, cost, policy = key
        pdf = pdf[pdf["price"] > 0].sort_values("h")
        hours, price, score, vol, p = (pdf[c].to_numpy(t) for c, t in (("h", np.int64), ("price", float), ("score", float), ("vol", float), ("p", float)))
        if policy in PASSIVE:
            got = passive(policy, hours, price, cost, k, capital)
        else:
            signal = pdf["signal"].map({"BUY": 1, "SELL": -1}).fillna(0).to_numpy(np.int64)
            on, per_day, resize = POLICIES[policy]
            got = hourly_policy(hours, price, effective(on, hours, price, signal, score, cost, k), sizes(vol, p, limits), replace(limits, per_day=per_day, resize=resize), cost, capital)
        for name, value in zip(("policy", "cost", by), reversed(key), strict=True):
            got.insert(0, name, value)
        return got

    numbers = [F.col(c).cast("double").alias(c) for c in ("price", "score", "vol", "p")]
    asked = series.select(by, "h", "signal", *numbers, F.explode(grid).alias("g")).select("*", "g.*").drop("g")
    return asked.groupBy(by, "cost", "policy").applyInPandas(run, f"{by} {kind}, cost double, policy string, h bigint, action string, exposure double, equity double")


def drawdown(equity: str, by: tuple[str, ...], time: str):
    """1 less equity over its peak so far."""
    peak = F.max(equity).over(Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    return F.when(peak > 0, 1 - F.col(equity) / peak)


def performance(curve: DataFrame, by: tuple[str, ...], time: str = "d", equity: str = "value") -> DataFrame:
    """Days, total return, Sharpe ratio (365 days), largest drawdown and profit factor of daily equity."""
    w = Window.partitionBy(*by).orderBy(time)
    df = curve.withColumn("r", F.col(equity) / F.lag(equity).over(w) - 1).withColumn("dd", drawdown(equity, by, time))
    gain, loss = F.sum(F.when(F.col("r") > 0, F.col("r"))), -F.sum(F.when(F.col("r") < 0, F.col("r")))
    return df.groupBy(*by).agg(
        F.count("*").alias("days"), (F.max_by(equity, time) / F.min_by(equity, time) - 1).alias("total"),
        F.when(F.stddev_samp("r") > 0, F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(365.0))).alias("sharpe"), F.max("dd").alias("max_drawdown"), F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / loss).alias("profit_factor"),
    )


def cycles(curve: DataFrame, by: tuple[str, ...], time: str, exposure: str, equity: str, least: float = 10.0) -> DataFrame:
    """Round trips that have ended: successive rows with an exposure and the row that leaves. Return from the equity before
    entry to that after exit; a trip still open at the end has none."""
    w = Window.partitionBy(*by).orderBy(time)
    on = F.coalesce(F.col(exposure) >= least, F.lit(False))
    df = curve.withColumn("on", on).withColumn("before", F.coalesce(F.lag(equity).over(w), F.col(equity))).withColumn("after", F.lead(equity).over(w)).withColumn("until", F.lead(time).over(w))
    df = df.withColumn("starts", (F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False))).cast("int"))
    df = df.withColumn("cycle", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("on")
    got = df.groupBy(*by, "cycle").agg(F.min(time).alias("start"), F.max_by("until", time).alias("end"), F.count("*").alias("steps"), (F.max_by("after", time) / F.min_by("before", time) - 1).alias("ret"))
    return got.where("end IS NOT NULL")


def timing_null(df: DataFrame, held: str, ret: str, shifts: int, by: str = "key", time: str = "h") -> DataFrame:
    """The mean return while held, and its share of circularly shifted twins that do no better: a join on rotated positions."""
    n = F.count("*").over(Window.partitionBy(by))
    rows = df.select(by, (F.row_number().over(Window.partitionBy(by).orderBy(time)) - 1).alias("i"), n.alias("n"), held, ret)
    moved = rows.where(F.col(held) == 1).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(shifts))))
    moved = moved.select(by, "k", F.pmod(F.col("i") + F.floor(F.col("k") * F.col("n") / (shifts + 1)), "n").alias("i"))
    means = moved.join(rows.select(by, "i", ret), [by, "i"]).groupBy(by, "k").agg(F.avg(ret).alias("m"))
    own = means.where("k = 0").select(by, F.col("m").alias("own"))
    return means.where("k > 0").join(own, by).groupBy(by).agg(F.first("own").alias("own"), F.avg((F.col("m") <= F.col("own")).cast("int")).alias("share"))


def no_loss_windows(curve: DataFrame, k: int, by: tuple[str, ...], time: str, value: str) -> DataFrame:
    """Of the overlapping windows of k steps, how many end at or above their start, and their mean return."""
    w = Window.partitionBy(*by).orderBy(time)
    pairs = curve.withColumn("start", F.lag(value, k).over(w)).where("start IS NOT NULL")
    return pairs.groupBy(*by).agg(F.count("*").alias("windows"), F.avg((F.col(value) >= F.col("start") - 1e-12).cast("int")).alias("no_loss"), F.avg(F.col(value) / F.col("start") - 1).alias("mean_ret"))
