"""Technical indicators of a window of closed candles: moving averages, RSI, MACD, Bollinger bands.

Each row sees only the unbroken tail of the last WINDOW candles before it, so a value depends on where its window starts, as
in a live run. Exponential means start at the first value of the window. RSI smooths gains and losses by 1 / 14; bands use
the population deviation. An indicator without enough hours is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

WINDOW = 250
NEED = {"sma_short": 50, "sma_long": 200, "rsi": 15, "macd": 35, "bands": 20}


NAMES = ["sma_short", "sma_long", "rsi", "macd", "macd_signal", "macd_histogram", "bb_lower", "bb_upper"]


def places(columns: np.ndarray):
    """Smoothed gain and loss, MACD line and signal after each place of a window, for many windows at once. columns: a row for each
    place, from the window's first value on."""
    fast = slow = before = columns[0]
    gain = loss = signal = None
    for k, v in enumerate(columns):
        if k:
            fast, slow = 2 / 13 * v + (1 - 2 / 13) * fast, 2 / 27 * v + (1 - 2 / 27) * slow
            up, down = np.maximum(v - before, 0), np.maximum(before - v, 0)
            gain, loss = (up, down) if k == 1 else (up / 14 + (1 - 1 / 14) * gain, down / 14 + (1 - 1 / 14) * loss)
            before = v
        line = fast - slow
        signal = line if k == 25 else None if k < 25 else 0.2 * line + 0.8 * signal
        yield gain, loss, line, signal


def table(close: np.ndarray) -> np.ndarray:
    """The indicators (NAMES) of every candle of an unbroken series, NaN where there are too few; all windows are followed together,
    place by place."""
    m = len(close)
    out = np.full((m, len(NAMES)), np.nan)
    for n, column in ((50, 0), (200, 1)):
        if m >= n:
            out[n - 1 :, column] = np.lib.stride_tricks.sliding_window_view(close, n).mean(1)
    if m >= NEED["bands"]:
        view = np.lib.stride_tricks.sliding_window_view(close, NEED["bands"])
        mean, spread = view.mean(1), view.std(1)
        out[NEED["bands"] - 1 :, 6], out[NEED["bands"] - 1 :, 7] = mean - 2 * spread, mean + 2 * spread

    def put(rows, gain, loss, line, signal, n):
        if n >= NEED["rsi"]:
            with np.errstate(divide="ignore", invalid="ignore"):
                out[rows, 2] = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
        if n >= NEED["macd"]:
            out[rows, 3], out[rows, 4], out[rows, 5] = line, signal, line - signal

    # windows that start with the series grow by a candle each; the others have their full length
    for k, x in enumerate(places(close[: WINDOW - 1, None])):
        put(slice(k, k + 1), *x, k + 1)
    for a in range(WINDOW - 1, m, 50_000):
        rows = slice(a, min(a + 50_000, m))
        last = None
        for last in places(np.lib.stride_tricks.sliding_window_view(close[a - WINDOW + 1 : rows.stop], WINDOW).T):
            pass
        put(rows, *last, WINDOW)
    return out


def one(close: np.ndarray) -> tuple[float | None, ...]:
    """The indicators of the last candle of a window."""
    return tuple(None if np.isnan(x) else float(x) for x in table(np.asarray(close, float))[-1])


def indicators(series: DataFrame, by: str = "key", time: str = "h") -> DataFrame:
    """by, time, hours (of the unbroken tail) and the indicators, for every candle. One task a series."""
    kind = series.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        t, close = pdf[time].to_numpy(), pdf["close"].to_numpy(float)
        cuts = [0, *(np.flatnonzero(np.diff(t) != 1) + 1).tolist(), len(t)]
        parts = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
        values = np.concatenate([table(close[a:b]) for a, b in parts])
        hours = np.concatenate([np.minimum(np.arange(1, b - a + 1), WINDOW) for a, b in parts])
        out = pd.DataFrame(values, columns=NAMES).astype(object).where(~np.isnan(values), None)
        out.insert(0, "hours", hours)
        out.insert(0, time, t)
        out.insert(0, by, pdf[by].iloc[0])
        return out

    return series.groupBy(by).applyInPandas(run, f"{by} {kind}, {time} bigint, hours int, " + ", ".join(f"{n} double" for n in NAMES))
