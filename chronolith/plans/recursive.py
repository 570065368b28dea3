"""SQL of queries with sequential state: recursive common table expressions, one step of the fold for each level."""

from __future__ import annotations

from .base import CANDLES, DAILY, FORECAST, SIGNALS

#: Days with the price and whether it is above its mean of ten days.
DAYS = DAILY + """,
a0 AS (SELECT row_number() OVER (ORDER BY d) AS i, d, total AS price, CASE WHEN total > avg(total) OVER (ORDER BY d ROWS 9 PRECEDING) THEN 1 ELSE 0 END AS desired FROM daily)"""


def accounts(rules: str, fee: float = 0.001, size: float = 0.5) -> str:
    """RECURSIVE CTEs up to ``acc``: a row a rule and day. rules: VALUES of (rule, stop, trail, days, sized)."""
    return f"""WITH RECURSIVE {DAYS}, rules(rule, sl, tr, ts, sized) AS ({rules}),
f AS (SELECT rule, sl::DOUBLE AS sl, tr::DOUBLE AS tr, ts::INT AS ts, sized, 0::BIGINT AS i, 0::BIGINT AS d, '' AS action, 1000.0::DOUBLE AS cash, 0.0::DOUBLE AS units, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS peak, 0 AS held, false AS blocked, 0.0::DOUBLE AS price, 0 AS trades FROM rules
UNION ALL
SELECT rule, sl, tr, ts, sized, i, d, action, cash - amount + (sold * price - sold * price * {fee}::DOUBLE), greatest(units + (amount - amount * {fee}::DOUBLE) / price - sold, 0.0),
  CASE WHEN sized THEN 0 WHEN action = 'enter' THEN price WHEN sold > 0 THEN 0 ELSE entry END, CASE WHEN sized THEN 0 WHEN action = 'enter' THEN price WHEN sold > 0 THEN 0 ELSE peak END,
  CASE WHEN action = 'enter' OR sold > 0 THEN 0 ELSE held END, desired = 1 AND (CASE WHEN sold > 0 AND NOT sized THEN action IN ('stop_loss', 'trailing_stop') ELSE blocked END), price, trades + (amount > 0 OR sold > 0)::INT
FROM (SELECT *, CASE WHEN NOT sized AND action = 'enter' THEN cash WHEN sized AND action IN ('enter', 'resize') AND off > 0 THEN least(off, cash) ELSE 0.0 END AS amount,
    CASE WHEN action IN ('stop_loss', 'trailing_stop', 'time_stop', 'signal', 'leave') THEN units WHEN sized AND action = 'resize' AND off < 0 THEN least(units, -off / price) ELSE 0.0 END AS sold
  FROM (SELECT *, target * total - units * price AS off, CASE WHEN sized THEN CASE WHEN target > 0 AND units = 0 THEN 'enter' WHEN target = 0 AND units > 0 THEN 'leave' WHEN abs(target - units * price / total) < 0.2 THEN 'keep' ELSE 'resize' END
      WHEN units > 0 THEN CASE WHEN price <= entry * (1 - sl) THEN 'stop_loss' WHEN price <= peak * (1 - tr) THEN 'trailing_stop' WHEN held >= ts THEN 'time_stop' WHEN desired = 0 THEN 'signal' ELSE 'keep' END
      WHEN desired = 1 AND NOT blocked THEN 'enter' ELSE 'keep' END AS action
    FROM (SELECT rule, sl, tr, ts, sized, a0.i, a0.d, a0.price, a0.desired, cash, units, entry, CASE WHEN units > 0 THEN greatest(peak, a0.price) ELSE peak END AS peak, held + (units > 0)::INT AS held, blocked, trades,
        cash + units * a0.price AS total, CASE WHEN a0.desired = 1 THEN {size}::DOUBLE ELSE 0.0 END AS target FROM f JOIN a0 ON a0.i = f.i + 1)))),
acc AS (SELECT rule, d, action, cash, units, cash + units * price AS value, trades FROM f WHERE i > 0)"""


FIVE = "VALUES ('signal', NULL, NULL, NULL, false), ('stop', 0.05, NULL, NULL, false), ('trail', NULL, 0.1, NULL, false), ('time', NULL, NULL, 5, false), ('sized', NULL, NULL, NULL, true)"
PAPER = accounts(FIVE) + " SELECT 'orders' AS key, rule, d, action, round(cash, 6) AS cash, round(units, 9) AS units, round(value, 6) AS value, trades FROM acc"
ONE_STOP = accounts("VALUES ('stop', 0.05, NULL, NULL, false)") + " SELECT 'orders' AS key, d, action, round(value, 6) AS value, trades FROM acc"
PERFORMANCE = accounts(FIVE) + """,
x AS (SELECT *, value / lag(value) OVER w - 1 AS r, 1 - value / max(value) OVER w AS dd, lag(value, 30) OVER w AS start FROM acc WINDOW w AS (PARTITION BY rule ORDER BY d))
SELECT rule, count(*) AS days, round(arg_max(value, d) / arg_min(value, d) - 1, 6) AS total, round(avg(r) / stddev_samp(r) * sqrt(365.0), 6) AS sharpe, round(max(dd), 6) AS max_drawdown,
  round(coalesce(sum(r) FILTER (WHERE r > 0), 0) / -sum(r) FILTER (WHERE r < 0), 6) AS profit_factor, count(start) AS windows, round(avg(CASE WHEN start IS NOT NULL THEN (value >= start - 1e-12)::INT END), 6) AS no_loss, round(avg(value / start - 1), 6) AS mean_ret
FROM x GROUP BY 1"""


def cusum(slack: float, limit: float) -> str:
    """Alarms of a two-sided cumulative sum of p - y."""
    return f"""WITH RECURSIVE {FORECAST}, o AS (SELECT key, h, p - y AS r, row_number() OVER (PARTITION BY key ORDER BY h) AS i FROM fc),
f AS (SELECT DISTINCT key, 0::BIGINT AS i, 0::BIGINT AS h, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS direction FROM o
UNION ALL
SELECT key, i, h, CASE WHEN alarm THEN 0.0 ELSE u END, CASE WHEN alarm THEN 0.0 ELSE v END, CASE WHEN u > {limit} THEN 1 WHEN alarm THEN -1 ELSE 0 END
FROM (SELECT *, u > {limit} OR v > {limit} AS alarm FROM (SELECT f.key, o.i, o.h, greatest(0.0, up + r - {slack}::DOUBLE) AS u, greatest(0.0, down - r - {slack}::DOUBLE) AS v FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1)))
SELECT key, h, direction FROM f WHERE direction <> 0"""


def ledgers(costs: tuple[float, ...], least_scores: int, least_outcomes: int, days: int) -> str:
    """RECURSIVE CTEs up to ``led``: key, cost, policy, h, action, exposure, equity of the thirteen policies over SIGNALS."""
    grid = ", ".join(f"({c}::DOUBLE)" for c in costs)
    return f"""WITH RECURSIVE {SIGNALS},
b0 AS (SELECT key, h, 100 + close / 10 AS price, score, CASE signal WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END AS s, abs(score) / 50 AS vol, 0.6::DOUBLE + h % 7 / 10 AS p FROM sig),
b1 AS (SELECT *, row_number() OVER w AS i, CASE WHEN lag(h) OVER w = h - 1 AND lag(s) OVER w = s THEN 0 ELSE 1 END AS new FROM b0 WINDOW w AS (PARTITION BY key ORDER BY h)),
b2 AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY h) AS grp FROM b1),
b3 AS (SELECT *, row_number() OVER (PARTITION BY key, grp ORDER BY h) AS run, avg(score) OVER (PARTITION BY key, h // 24) AS vote,
  CASE WHEN count(*) OVER e >= {least_scores} THEN quantile_cont(abs(score), 0.9) OVER e END AS edge FROM b2 WINDOW e AS (PARTITION BY key ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b4 AS (SELECT b.*, n.price / b.price - 1 AS ret, (b.s + 1) * 3 + (b.run > 5)::INT + (b.run > 23)::INT AS state FROM b3 AS b LEFT JOIN b3 AS n ON n.key = b.key AND n.h = b.h + 24),
b5 AS (SELECT *, CASE WHEN count(ret) OVER g >= {least_outcomes} THEN avg(ret) OVER g END AS mu FROM b4 WINDOW g AS (PARTITION BY key, state ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND 24 PRECEDING)),
m0 AS (SELECT key, h, price > avg(price) OVER m AS above, count(*) OVER m AS n FROM b0 WHERE h % 24 = 23 WINDOW m AS (PARTITION BY key ORDER BY h ROWS BETWEEN {days - 1} PRECEDING AND CURRENT ROW)),
b6 AS (SELECT b5.*, CASE WHEN m0.n = {days} THEN above::INT END AS ma, least(CASE WHEN vol > 0 THEN greatest(least(0.006::DOUBLE / vol, 1.0), 0.25) ELSE 0.25 END, greatest(least(1.5::DOUBLE - p, 1.0), 0.5)) AS share FROM b5 LEFT JOIN m0 USING (key, h)),
pol(policy, kind, per_day, resize, passive) AS (VALUES ('A4', 'raw', 4, true, false), ('A2', 'raw', 2, true, false), ('A1', 'raw', 1, true, false), ('B1_persist_cap1', 'persist', 1, false, false), ('B1_persist_cap2', 'persist', 2, false, false),
  ('B2_daily_vote', 'vote', 1, false, false), ('B3_strong_cap1', 'strong', 1, false, false), ('B3_strong_cap2', 'strong', 2, false, false), ('B4_gate_cap1', 'gate', 1, false, false), ('B4_gate_cap2', 'gate', 2, false, false),
  ('C1_buy_and_hold', 'hold', 0, false, true), ('C2_cash', 'cash', 0, false, true), ('C3_ma200d', 'ma', 0, false, true)),
costs(cost) AS (VALUES {grid}),
e AS (SELECT key, cost, policy, i, h, price, share, CASE kind WHEN 'raw' THEN s WHEN 'persist' THEN CASE WHEN run >= 6 THEN s ELSE 0 END WHEN 'vote' THEN CASE WHEN h % 24 = 23 THEN (vote >= 0.15)::INT - (vote <= -0.15)::INT ELSE 0 END
  WHEN 'strong' THEN coalesce((score >= edge)::INT - (score <= -edge)::INT, 0) WHEN 'gate' THEN coalesce((mu > 2 * cost)::INT - (mu < -2 * cost)::INT, 0) WHEN 'hold' THEN 1 WHEN 'cash' THEN 0 ELSE ma END AS s FROM b6 CROSS JOIN pol CROSS JOIN costs),
f AS (SELECT DISTINCT key, cost, policy, per_day, resize, passive, 0::BIGINT AS i, 0::BIGINT AS h, 0.0::DOUBLE AS price, 1000.0::DOUBLE AS cash, 0.0::DOUBLE AS units, 1000.0::DOUBLE AS peak, NULL::BIGINT AS resume, NULL::BIGINT AS last_h, NULL::INT AS last_side,
  []::BIGINT[] AS recent, []::STRUCT(h BIGINT, v DOUBLE)[] AS worth, '' AS action FROM b6 CROSS JOIN pol CROSS JOIN costs
UNION ALL
SELECT key, cost, policy, per_day, resize, passive, i, h, price, cash2, units2, greatest(peak, cash2 + units2 * price), CASE WHEN breach THEN h + 168 ELSE resume END, CASE WHEN amount > 0 OR sold > 0 THEN h ELSE last_h END,
  CASE WHEN amount > 0 THEN 1 WHEN sold > 0 THEN -1 ELSE last_side END, CASE WHEN amount > 0 OR sold > 0 THEN list_append(recent, h) ELSE recent END, list_append(list_filter(worth, lambda x: x.h > h - 48), {{'h': h, 'v': cash2 + units2 * price}}),
  CASE WHEN breach THEN CASE WHEN sold > 0 THEN 'exit' ELSE 'halt' END WHEN amount > 0 THEN 'buy' WHEN sold > 0 THEN 'sell' ELSE 'keep' END
FROM (SELECT *, cash - amount + (sold * price - sold * price * cost) AS cash2, greatest(units + (amount - amount * cost) / price - sold, 0.0) AS units2
  FROM (SELECT *, CASE WHEN passive THEN CASE WHEN s = 1 AND units = 0 THEN cash ELSE 0.0 END WHEN wants AND change > 0 AND least(change, cash) >= 10 THEN least(change, cash) ELSE 0.0 END AS amount,
      CASE WHEN passive THEN CASE WHEN s = 0 THEN units ELSE 0.0 END WHEN breach THEN CASE WHEN exposure >= 10 THEN units ELSE 0.0 END WHEN wants AND change < 0 THEN CASE WHEN target = 0 THEN units ELSE least(units, -change / price) END ELSE 0.0 END AS sold
    FROM (SELECT *, NOT passive AND resume IS NULL AND NOT breach AND len(recent) < per_day AND abs(change) >= 1e-9 AND NOT coalesce(last_side <> CASE WHEN change > 0 THEN 1 ELSE -1 END AND h - last_h < 6, false)
          AND abs(change) >= CASE WHEN target <> 0 AND exposure > 0 THEN 200 ELSE 10 END AS wants
      FROM (SELECT *, target - exposure AS change, NOT passive AND resume IS NULL AND ((top > 0 AND 1 - equity / top > 0.3) OR coalesce(day_ago <> 0 AND 1 - equity / day_ago > 0.1, false)) AS breach
        FROM (SELECT *, greatest(peak, equity) AS top, CASE WHEN s = 1 AND NOT resize AND exposure >= 10 THEN least(exposure, least(1000.0, equity)) WHEN s = 1 THEN least(1000.0, equity) * share WHEN s = -1 THEN 0.0 ELSE least(exposure, least(1000.0, equity)) END AS target
          FROM (SELECT f.key, f.cost, f.policy, per_day, resize, passive, e.i, e.h, e.price, e.s, e.share, cash, units, CASE WHEN e.h >= resume THEN cash + units * e.price ELSE peak END AS peak, CASE WHEN e.h >= resume THEN NULL ELSE resume END AS resume, last_h, last_side,
              list_filter(recent, lambda x: x > e.h - 24) AS recent, worth, cash + units * e.price AS equity, units * e.price AS exposure, list_filter(worth, lambda x: x.h = e.h - 24)[1].v AS day_ago
            FROM f JOIN e ON e.key = f.key AND e.cost = f.cost AND e.policy = f.policy AND e.i = f.i + 1)))))) ),
led AS (SELECT key, cost, policy, h, action, units * price AS exposure, cash + units * price AS equity FROM f WHERE i > 0)"""


POLICY_LEDGERS = ledgers((0.0, 0.001), 200, 20, 20)
POLICIES = POLICY_LEDGERS + " SELECT key, cost, policy, round(arg_max(equity, h), 6) AS final, count(*) FILTER (WHERE action IN ('buy', 'sell', 'exit')) AS trades, count(*) AS hours FROM led GROUP BY 1, 2, 3"
CYCLES = POLICY_LEDGERS + """,
c0 AS (SELECT *, exposure >= 10 AS on_, coalesce(lag(equity) OVER w, equity) AS before, lead(equity) OVER w AS after, lead(h) OVER w AS until, coalesce(lag(exposure) OVER w >= 10, false) AS was FROM led WINDOW w AS (PARTITION BY key, cost, policy ORDER BY h)),
c1 AS (SELECT *, sum((on_ AND NOT was)::INT) OVER (PARTITION BY key, cost, policy ORDER BY h)::BIGINT AS cycle FROM c0)
SELECT key, cost, policy, cycle, min(h) AS start, arg_max(coalesce(until, -1), h) AS "end", count(*) AS steps, round(arg_max(coalesce(after, -1), h) / arg_min(before, h) - 1, 6) AS ret FROM c1 WHERE on_ GROUP BY 1, 2, 3, 4 HAVING arg_max(coalesce(until, -1), h) >= 0"""

SESSIONS = """WITH w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events),
a AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 3600000000 THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS s FROM a)
SELECT user_id, min(t) AS start, max(t) + 3600000000 AS "end", count(*) AS n FROM b GROUP BY user_id, s HAVING max(t) + 3600000000 <= (SELECT epoch_us(mark) FROM w)"""

BOOK_WALK = """WITH l AS (SELECT event_type, user_id, 100 + value / 100 AS price, value AS size FROM events),
a AS (SELECT *, price * size AS worth, sum(price * size) OVER (PARTITION BY event_type, user_id ORDER BY price, size ROWS UNBOUNDED PRECEDING) AS upto FROM l),
b AS (SELECT event_type, user_id, max(upto) AS whole, sum(greatest(least(worth, 5000.0 - (upto - worth)), 0.0) / price) AS size FROM a GROUP BY 1, 2)
SELECT event_type, user_id, round(CASE WHEN whole >= 5000.0 - 1e-9 THEN 5000.0 / size END, 6) AS fill FROM b"""

#: Indicators of each candle's window, a reduction of the list of its closes: last close, two exponential means, signal, gain, loss.
INDICATORS = f"""WITH {CANDLES}, i0 AS (SELECT key, h, close, h - row_number() OVER (PARTITION BY key ORDER BY h) AS seg FROM candles),
i1 AS (SELECT key, h, close, list(close) OVER (PARTITION BY key, seg ORDER BY h ROWS 249 PRECEDING) AS c FROM i0),
i2 AS (SELECT key, h, close, c, list_reduce(list_transform(c, lambda v: {{'v': v, 'f': v, 's': v, 'g': NULL::DOUBLE, 'up': NULL::DOUBLE, 'dn': NULL::DOUBLE, 'k': 0}}), lambda a, x: {{'v': x.v, 'f': x.v * 2 / 13 + a.f * 11 / 13, 's': x.v * 2 / 27 + a.s * 25 / 27,
  'g': CASE WHEN a.k >= 24 THEN CASE WHEN a.k = 24 THEN 1 ELSE 0.2::DOUBLE END * ((x.v * 2 / 13 + a.f * 11 / 13) - (x.v * 2 / 27 + a.s * 25 / 27)) + CASE WHEN a.k = 24 THEN 0 ELSE 0.8::DOUBLE * a.g END END,
  'up': greatest(x.v - a.v, 0) / CASE WHEN a.k = 0 THEN 1 ELSE 14 END + CASE WHEN a.k = 0 THEN 0 ELSE a.up * 13 / 14 END, 'dn': greatest(a.v - x.v, 0) / CASE WHEN a.k = 0 THEN 1 ELSE 14 END + CASE WHEN a.k = 0 THEN 0 ELSE a.dn * 13 / 14 END, 'k': a.k + 1}}) AS z FROM i1),
ind AS (SELECT key, h, close, len(c)::INT AS hours, CASE WHEN len(c) >= 50 THEN list_avg(c[-50:]) END AS sma_short, CASE WHEN len(c) >= 200 THEN list_avg(c[-200:]) END AS sma_long, CASE WHEN len(c) >= 15 THEN CASE WHEN z.dn = 0 THEN 100.0 ELSE 100 - 100 / (1 + z.up / z.dn) END END AS rsi,
  CASE WHEN len(c) >= 35 THEN z.f - z.s END AS macd, CASE WHEN len(c) >= 35 THEN z.g END AS macd_signal, CASE WHEN len(c) >= 35 THEN z.f - z.s - z.g END AS macd_histogram,
  CASE WHEN len(c) >= 20 THEN list_avg(c[-20:]) - 2 * list_aggregate(c[-20:], 'stddev_pop') END AS bb_lower, CASE WHEN len(c) >= 20 THEN list_avg(c[-20:]) + 2 * list_aggregate(c[-20:], 'stddev_pop') END AS bb_upper FROM i2)"""
INDICATOR_NAMES = ("sma_short", "sma_long", "rsi", "macd", "macd_signal", "macd_histogram", "bb_lower", "bb_upper")
INDICATOR_SET = INDICATORS + " SELECT key, h, hours, " + ", ".join(f"round({n}, 6) AS {n}" for n in INDICATOR_NAMES) + " FROM ind"
CATEGORY_SCORES = INDICATORS + """,
t AS (SELECT *, CASE WHEN sma_short IS NOT NULL THEN greatest(least((close - sma_short) / sma_short / 0.10, 1.0), -1.0) END AS trend, CASE WHEN rsi IS NOT NULL THEN greatest(least((rsi - 50) / 50, 1.0), -1.0) END AS a, CASE WHEN macd_histogram IS NOT NULL THEN greatest(least(macd_histogram / close / 0.005, 1.0), -1.0) END AS b, (close - bb_lower) / (bb_upper - bb_lower) AS place FROM ind),
m AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END AS momentum FROM t),
n AS (SELECT *, CASE WHEN trend IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN momentum IS NULL THEN 0 ELSE 0.25::DOUBLE END AS held FROM m), o AS (SELECT *, CASE WHEN held > 0 THEN (coalesce(trend, 0) * 0.3 + coalesce(momentum, 0) * 0.25) / held END AS score FROM n)
SELECT key, h, round(trend, 6) AS trend, round(momentum, 6) AS momentum, CASE WHEN place <= 0.15 THEN 'lower' WHEN place >= 0.85 THEN 'upper' WHEN place IS NOT NULL THEN 'middle' END AS band, round(score, 6) AS score, round(held / 0.55, 6) AS completeness, CASE WHEN score >= 0.15 THEN 'BUY' WHEN score <= -0.15 THEN 'SELL' ELSE 'HOLD' END AS signal FROM o"""


def inflation(columns: tuple[str, str, str, str]) -> str:
    """The diagonal of the inverse of a 4 x 4 correlation matrix, by minors."""
    cells = ", ".join(f"coalesce(corr({a}, {b}), {float(i == j)}) AS m{i}{j}" for i, a in enumerate(columns) for j, b in enumerate(columns))

    def minor(rows: list[int], cols: list[int]) -> str:
        if len(rows) == 1:
            return f"m{rows[0]}{cols[0]}"
        parts = [f"{'+' if k % 2 == 0 else '-'} m{rows[0]}{c} * ({minor(rows[1:], [x for x in cols if x != c])})" for k, c in enumerate(cols)]
        return " ".join(parts).lstrip("+ ")

    every = [0, 1, 2, 3]
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(({minor([x for x in every if x != i], [x for x in every if x != i])}) / ({minor(every, every)}), 6) AS vif FROM m" for i, c in enumerate(columns))
    return f"WITH {CANDLES}, m AS (SELECT {cells} FROM candles) {rows}"


def strategy_books(books: dict[str, tuple[float, float]]) -> str:
    """Days, last value and trades of each of the 118 strategies in each book, over daily order totals."""
    back, means = (1, 7, 14, 28, 56, 84, 182), (20, 50, 100, 200)
    windows = ", ".join(f"w{n} AS (PARTITION BY key ORDER BY d ROWS {n - 1} PRECEDING)" for n in means) + ", " + ", ".join(f"p{n} AS (PARTITION BY key ORDER BY d ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (10, 20, 55)) + ", o AS (PARTITION BY key ORDER BY d)"
    wants = {"A_sig23": "CASE sig23 WHEN 1 THEN 1 WHEN -1 THEN 0 END", "A_vote": "CASE WHEN vote >= 0.15 THEN 1 WHEN vote <= -0.15 THEN 0 END", "A_confirm2": "CASE WHEN sig23 = 1 AND sb = 1 THEN 1 WHEN sig23 = -1 AND sb = -1 THEN 0 END"}
    base = {f"B_{n}": f"({n} > 0)::INT" for n in (*[f"R{k}" for k in back[1:]], *[f"MA{n}" for n in means], "X20_100", "X50_200")}
    base |= {f"B_TREND{n}": f"(TREND >= {x})::INT" for n, x in (("02", 0.2), ("06", 0.6), ("10", 0.999))}
    base |= {f"C_MA{n}_b{b}": f"CASE WHEN MA{n} > {b / 100} THEN 1 WHEN MA{n} < -{b / 100} THEN 0 END" for n in (50, 100, 200) for b in (1, 3, 5)}
    base |= {f"G_up{n}_down{m}": f"CASE WHEN price > HI{n} THEN 1 WHEN price < LO{m} THEN 0 END" for n in (20, 55) for m in (10, 20)}
    plain = wants | base
    plain |= {f"D_{n}_{g}": f"CASE WHEN NOT coalesce({ok}, false) THEN 0 ELSE {wants['A_' + n]} END" for n in ("sig23", "vote") for g, ok in (("ma200", "MA200 > 0"), ("trend", "TREND >= 0.6"))}
    plain |= {"E_calm_ma200": "CASE WHEN calm IS NOT NULL THEN (calm AND coalesce(MA200 > 0, false))::INT END", "E_calm": "calm::INT", "BASE_buy_and_hold": "1", "BASE_cash": "0"}
    rows = [(k, v, "NULL", "NULL", "NULL", "NULL") for k, v in plain.items()]
    rows += [(f"F_dip{x}_hold{h}", f"CASE WHEN R1 <= -{x / 100} THEN 1 END", "NULL", "NULL", str(h), "NULL") for x in (3, 5, 8) for h in (3, 7, 14)]
    for k, v in {**base, "BH": "1"}.items():
        rows += [(f"H_{k}_sl10", v, "0.10", "NULL", "NULL", "NULL"), (f"H_{k}_tr15", v, "NULL", "0.15", "NULL", "NULL")]
    shares = {"msmore": "(pbar - 0.20::DOUBLE) / 0.40::DOUBLE", "msless": "(0.60::DOUBLE - pbar) / 0.40::DOUBLE", "vol": "CASE WHEN sigma > 0 THEN 0.0294::DOUBLE / sigma END"}
    rows += [(f"MS_{k}_{m}", plain.get(k, "1"), "NULL", "NULL", "NULL", f"CASE WHEN {x} IS NULL THEN 0.25 ELSE greatest(0.25, least(1.0, {x})) END") for k in ("G_up55_down20", "C_MA100_b5", "A_sig23", "BH") for m, x in shares.items()]
    each = ", ".join(f"{{'rule': '{n}', 'desired': ({v})::INT, 'sl': {sl}::DOUBLE, 'tr': {tr}::DOUBLE, 'ts': {ts}::INT, 'sized': {'true' if z != 'NULL' else 'false'}, 'size': ({z})::DOUBLE}}" for n, v, sl, tr, ts, z in rows)
    venue = ", ".join(f"('{k}', {fee}::DOUBLE, {spread}::DOUBLE)" for k, (fee, spread) in books.items())
    return f"""WITH RECURSIVE {DAILY}, s0 AS (SELECT unnest(range((SELECT min(d) FROM daily), (SELECT max(d) + 1 FROM daily))) AS d), dm AS (SELECT d, avg(total) OVER (ORDER BY d ROWS 9 PRECEDING) AS price FROM daily), s1 AS (SELECT 'orders' AS key, s0.d, price FROM s0 LEFT JOIN dm USING (d)),
s2 AS (SELECT *, ln(price) - ln(lag(price) OVER o) AS lr, {", ".join(f"price / lag(price, {k}) OVER o - 1 AS R{k}" for k in back)} FROM s1 WINDOW o AS (PARTITION BY key ORDER BY d)),
s3 AS (SELECT *, CASE WHEN count(lr) OVER m >= 20 THEN stddev_samp(lr) OVER m END AS sigma FROM s2 WINDOW m AS (PARTITION BY key ORDER BY d ROWS 29 PRECEDING)),
s4 AS (SELECT *, CASE WHEN R1 > 0.01 THEN 1 WHEN R1 < -0.01 THEN -1 WHEN R1 IS NOT NULL THEN 0 END AS sig23, CASE WHEN R1 IS NOT NULL THEN greatest(-1.0, least(1.0, R1 * 5)) END AS vote, CASE WHEN d % 5 <> 0 THEN (d % 7) / 10 END AS pbar FROM s3 WHERE price IS NOT NULL),
s5 AS (SELECT *, {", ".join(f"CASE WHEN count(price) OVER w{n} = {n} THEN avg(price) OVER w{n} END AS SMA{n}" for n in means)}, {", ".join(f"CASE WHEN count(price) OVER p{n} = {n} THEN {f}(price) OVER p{n} END AS {c}{n}" for c, f, of in (("HI", "max", (20, 55)), ("LO", "min", (10, 20))) for n in of)},
  lag(sig23) OVER o AS sb, row_number() OVER o AS i, quantile_cont(sigma, 0.5) OVER (PARTITION BY key ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS median FROM s4 WINDOW {windows}),
s6 AS (SELECT *, {", ".join(f"price / SMA{n} - 1 AS MA{n}" for n in means)}, SMA20 / SMA100 - 1 AS X20_100, SMA50 / SMA200 - 1 AS X50_200, (sign(R7) + sign(R14) + sign(R28) + sign(R84) + sign(R182)) / 5 AS TREND, sigma <= median AS calm FROM s5),
a0 AS (SELECT key, i, price, unnest([{each}], recursive := true) FROM s6), b0(book, fee, spread) AS (VALUES {venue}),
f AS (SELECT DISTINCT key, rule, sl, tr, ts, sized, book, fee, spread, 0::BIGINT AS i, 1000.0::DOUBLE AS cash, 0.0::DOUBLE AS units, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS peak, 0 AS held, false AS blocked, false AS inside, 0.0::DOUBLE AS price, 0 AS trades FROM a0 CROSS JOIN b0
UNION ALL
SELECT key, rule, sl, tr, ts, sized, book, fee, spread, i, cash - amount + (sold * bid - sold * bid * fee), greatest(units + (amount - amount * fee) / ask - sold, 0.0), CASE WHEN sized THEN 0 WHEN action = 'enter' THEN price WHEN sold > 0 THEN 0 ELSE entry END, CASE WHEN sized THEN 0 WHEN action = 'enter' THEN price WHEN sold > 0 THEN 0 ELSE peak END,
  CASE WHEN action = 'enter' OR sold > 0 THEN 0 ELSE held END, (desired IS NULL OR desired <> 0) AND (CASE WHEN sold > 0 AND NOT sized THEN action IN ('stop_loss', 'trailing_stop') ELSE blocked END), inside, price, trades + (amount > 0 OR sold > 0)::INT
FROM (SELECT *, CASE WHEN NOT sized AND action = 'enter' THEN cash WHEN sized AND action IN ('enter', 'resize') AND off > 0 THEN least(off, cash) ELSE 0.0 END AS amount,
    CASE WHEN action IN ('stop_loss', 'trailing_stop', 'time_stop', 'signal', 'leave') THEN units WHEN sized AND action = 'resize' AND off < 0 THEN least(units, -off / bid) ELSE 0.0 END AS sold
  FROM (SELECT *, target * total - units * price AS off, CASE WHEN sized THEN CASE WHEN target > 0 AND units = 0 THEN 'enter' WHEN target = 0 AND units > 0 THEN 'leave' WHEN abs(target - units * price / total) < 0.2 THEN 'keep' ELSE 'resize' END
      WHEN units > 0 THEN CASE WHEN price <= entry * (1 - sl) THEN 'stop_loss' WHEN price <= peak * (1 - tr) THEN 'trailing_stop' WHEN held >= ts THEN 'time_stop' WHEN desired = 0 THEN 'signal' ELSE 'keep' END
      WHEN desired = 1 AND NOT blocked THEN 'enter' ELSE 'keep' END AS action
    FROM (SELECT f.key, f.rule, f.sl, f.tr, f.ts, f.sized, book, fee, spread, a0.i, a0.price, a0.price * (1 + spread) AS ask, a0.price * (1 - spread) AS bid, a0.desired, cash, units, entry, CASE WHEN units > 0 THEN greatest(peak, a0.price) ELSE peak END AS peak, held + (units > 0)::INT AS held, blocked, trades,
        cash + units * a0.price AS total, coalesce(a0.desired = 1, inside) AS inside, CASE WHEN coalesce(a0.desired = 1, inside) THEN a0.size ELSE 0.0 END AS target FROM f JOIN a0 ON a0.i = f.i + 1 AND a0.key = f.key AND a0.rule = f.rule))))
SELECT rule, book, count(*) AS days, round(arg_max(cash + units * price, i), 6) AS final, max(trades) AS trades FROM f WHERE i > 0 GROUP BY 1, 2"""
