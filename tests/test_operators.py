import hashlib
import io
import json
import math
import random
import time
from dataclasses import replace
from datetime import datetime
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolith import cli
from chronolith.functions import features as feature_columns
from chronolith.functions import scalar, scoring
from chronolith.operators import grid as G
from chronolith.operators import indicators, joins, models, simulate, stats, strategies, titles, views, windows
from chronolith.plans.catalogue import QUERIES, SQL
from chronolith.sources import context, paged, payloads, sinks, tables
from chronolith.streaming import live

from .oracle import compare, connect


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def walk(n=200, seed=1, drop=0.05):
    rng = random.Random(seed)
    price, out = 100.0, []
    for h in range(n):
        price *= math.exp(rng.gauss(0, 0.02))
        if h == 0 or rng.random() > drop:
            out.append(("a", h, price))
    return out


def features(df):
    g = G.densify(df)
    w = Window.partitionBy("key").orderBy("h")
    g = g.withColumn("r", F.log("close") - F.log(F.lag("close").over(w)))
    return g.select("key", "h", G.full(F.stddev_samp("r"), F.col("r"), 6, G.trailing("h", 6)).alias("vol"), windows.rank_share("close", 6).alias("share"), windows.decayed_mean("close", "h", 5.0).alias("decayed"))


def test_future_does_not_reach_back(spark):
    rows = walk()
    cut = 120
    garbled = [(k, h, c if h <= cut else 1e6 * (h % 7 + 1)) for k, h, c in rows]
    schema = "key string, h long, close double"
    a, b = (features(frame(spark, x, schema)).where(f"h <= {cut}").orderBy("h").collect() for x in (rows, garbled))
    assert a == b and any(x.vol is not None for x in a)


def test_window_over_a_gap_is_null(spark):
    rows = [("a", h, 100.0 + h) for h in range(20) if h != 10]
    got = {x.h: x.vol for x in features(frame(spark, rows, "key string, h long, close double")).collect()}
    assert all(got[h] is None for h in range(10, 17)) and got[9] is not None and got[17] is not None


def test_halo_equals_whole(spark):
    df = frame(spark, walk(drop=0.0), "key string, h long, close double")
    whole = df.withColumn("m", F.avg("close").over(G.trailing("h", 5))).where("h >= 4").select("h", "m")
    w = Window.partitionBy("key", "chunk").orderBy("h").rowsBetween(-4, 0)
    parts = G.with_halo(df, 17, 5).withColumn("m", F.avg("close").over(w)).where("own AND h >= 4").select("h", "m")
    assert sorted(whole.collect()) == sorted(parts.collect())


def test_asof_is_inclusive_at_the_cutoff_and_bounded(spark):
    left = frame(spark, [("a", t, t) for t in (9, 10, 11, 15, 16)] + [("b", 10, 0)], "key string, t long, x long")
    right = frame(spark, [("a", 10, 1.0), ("a", 12, 2.0), ("a", 12, 3.0)], "key string, at long, v double")
    got = {(r.key, r.t): (r.v, r.known_at) for r in joins.asof(left, right, ["v"], "t", "at", ("key",), tolerance=3).collect()}
    assert got == {("a", 9): (None, None), ("a", 10): (1.0, 10), ("a", 11): (1.0, 10), ("a", 15): (3.0, 12), ("a", 16): (None, None), ("b", 10): (None, None)}


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(3)
    a, b = [rng.randint(0, 300) for _ in range(60)], [rng.randint(0, 300) for _ in range(60)]
    left, right = frame(spark, [(i, x) for i, x in enumerate(a)], "i long, s long"), frame(spark, [(j, y) for j, y in enumerate(b)], "j long, t long")
    got = {(r.i, r.j) for r in joins.interval(left, right, "s", "t", 13).collect()}
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x < y <= x + 13}


def test_exact_shift_never_takes_a_neighbour(spark):
    df = frame(spark, [("a", 0, 1.0), ("a", 2, 3.0), ("a", 3, 4.0)], "key string, h long, close double")
    got = {r.h: r.later for r in joins.at_shift(df, 1, {"close": "later"}).collect()}
    assert got == {0: None, 2: 4.0, 3: None}


def test_near_duplicates(spark):
    titles = ["bitcoin rises above ninety thousand", "bitcoin rises above ninety thousands", "weather is fine", None, ""]
    df = frame(spark, [(0, i, t) for i, t in enumerate(titles)], "g int, i int, t string")
    assert SequenceMatcher(None, titles[1], titles[0]).ratio() >= 0.75
    assert sorted(r.i for r in joins.near_duplicates(df, "g", "i", "t").collect()) == [0, 2, 3]


def test_near_duplicates_of_the_whole_table(spark):
    rng = random.Random(12)
    titles = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(5, 30))) for _ in range(40)]
    rows = [(i, rng.choice(titles)) for i in range(150)]
    rows = [(i, t[: k % len(t)] + "x" + t[k % len(t) :] if k % 3 else t) for (i, t), k in zip(rows, rng.sample(range(1000), 150), strict=True)] + [(200, None), (201, "")]
    df = frame(spark, rows, "i int, t string")
    want = sorted(r.i for r in joins.near_duplicates(df.withColumn("g", F.lit(0)), "g", "i", "t").collect())
    got = joins.near_duplicates_of_all(df, "i", "t", block=20)
    assert got.columns == ["i", "t"] and sorted(r.i for r in got.collect()) == want and len(want) < 100


def headlines(seed, lengths, copies, edits):
    """Texts of syllables, in shuffled order, with near copies of a few to many edits each."""
    rng = random.Random(seed)
    syllables = "the and er on in ea re th at en ed nd ha st ou ing qu x. z, é".split()
    out = []
    for n in lengths:
        base = "".join(rng.choice(syllables) + " " * (rng.random() < 0.4) for _ in range(n))[:n]
        for _ in range(copies):
            t = base
            for _ in range(rng.randrange(1 + n // edits)):
                k, j = rng.randrange(len(t) + 1), rng.randrange(len(t) + 1)
                t = rng.choice([t[:k] + "x" + t[k:], t[:k] + t[k + 1 :], t[:k] + t[j : j + 9] + t[k:]])
            out.append(t)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("least", [0.6, 0.75, 0.9])
def test_title_bounds_lose_no_pair(least):
    """Against SequenceMatcher on all pairs: lengths about the words of the bits and where popular characters begin, ties of the order."""
    texts = sorted({*headlines(7, [3, 12, 40, 63, 65, 120, 128, 150, 190, 199, 201, 230, 260, 330, 500], 7, 5), "", "b" * 9, "a" * 300, "a" * 250, "that " * 60, "that " * 70}, key=len)
    sizes, rng = np.array([len(t) for t in texts]), np.random.default_rng(7)
    rank = rng.permutation(len(texts)).astype(float)
    rank[::7], rank[3::20] = rank[0], np.nan
    near = set()
    for x, y in ((x, y) for x in range(len(texts)) for y in range(x + 1, len(texts))):
        seconds = [x] if rank[x] < rank[y] else [y] if rank[y] < rank[x] else [x, y]
        if any(SequenceMatcher(None, texts[x + y - b], texts[b]).ratio() >= least for b in seconds):
            near.add((x, y))
    part = rng.integers(0, 2, len(texts))
    left, right = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
    got = [tuple(sorted(p)) for a, b in ((left, left), (right, right), (left, right)) for p in zip(*(x.tolist() for x in titles.candidates(texts, sizes, rank, a, b, least)), strict=True)]
    assert len(got) == len(set(got)) and near <= set(got) and len(got) < 0.15 * len(texts) ** 2 / 2 and len(near) > 20


@pytest.mark.parametrize("options", [{}, {"block": 15}, {"block": 15, "at_once": 0}, {"block": 4, "least": 0.9}])
def test_near_duplicates_of_long_and_short_titles(spark, options):
    texts = headlines(3, [6, 20, 60, 130, 180, 195, 205, 240, 300, 420], 8, 4)
    rows = [(i // 2 if i < 20 else i, t) for i, t in enumerate(texts)] + [(500, texts[3]), (501, None), (502, "")]
    df = frame(spark, rows, "i int, t string")
    want = joins.near_duplicates(df.withColumn("g", F.lit(0)), "g", "i", "t", options.get("least", 0.75)).select("i", "t").collect()
    got = joins.near_duplicates_of_all(df, "i", "t", **options).collect()
    assert sorted((r.i, r.t or "") for r in got) == sorted((r.i, r.t or "") for r in want) and 10 < len(want) < 80


def test_headlines_of_many_documents_end_in_time(spark, tmp_path):
    """3000 different headlines of two lengths and a few near copies: 4.5 million pairs."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["the", "and", "er", "on", "ing", "ea", "st", "qu"]) for _ in range(3))
    heads = [" ".join(word() for _ in range(rng.choice([12, 60]))) for _ in range(3000)]
    rows = [(i, h + "\nrest") for i, h in enumerate(heads)] + [(3000 + i, h[: len(h) // 2] + "x" + h[len(h) // 2 :]) for i, h in enumerate(heads[:50])] + [(4000, heads[7]), (4001, None), (4002, "")]
    frame(spark, rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = time.monotonic()
    got = sorted(r.doc_id for r in QUERIES["headline_dedup"](spark, str(tmp_path)).collect())
    far = [3000 + i for i in range(50) if SequenceMatcher(None, rows[3000 + i][1], heads[i]).ratio() < 0.75]
    assert time.monotonic() - start < 60 and got == [*range(3000), *far, 4001] and 0 < len(far) < 50


def test_order_book_walk_reads_all_events(spark):
    from chronolith.plans.series import order_book_walk

    sf = "/root/testdata/sf0.001"
    books = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "user_id").distinct()
    assert sorted(order_book_walk(spark, sf).select("event_type", "user_id").collect()) == sorted(books.collect())


def test_runs_and_streaks(spark):
    df = frame(spark, [("a", h, s, r) for h, s, r in [(0, "B", 1.0), (1, "B", 2.0), (3, "B", 1.0), (4, "S", -1.0), (5, "S", None), (6, "S", -2.0)]], "key string, h long, s string, r double")
    assert [r.run for r in windows.run_lengths(df, "s").orderBy("h").collect()] == [1, 2, 1, 1, 2, 3]
    assert [r.streak for r in windows.streak(df, "r", 2).orderBy("h").collect()] == [1, 2, 2, -1, 0, -1]


def test_expanding_quantile_and_decay(spark):
    rows = walk(80)
    df = frame(spark, rows, "key string, h long, close double")
    x = np.array([c for _, _, c in rows])
    got = windows.expanding_quantile(df, "close", 0.9, 10, "q").orderBy("h").collect()
    for i, r in enumerate(got):
        assert (r.q is None) == (i < 10) and (i < 10 or abs(r.q - np.quantile(x[:i], 0.9)) < 1e-9)
    last = df.withColumn("m", windows.decayed_mean("close", "h", 24.0)).orderBy(F.desc("h")).first()
    h = np.array([t for _, t, _ in rows])
    weight = 0.5 ** ((h[-1] - h) / 24)
    assert abs(last.m - (weight * x).sum() / weight.sum()) < 1e-9


def test_wilson_holds_its_share(spark):
    df = frame(spark, [(0, 10), (10, 10), (3, 7), (0, 0)], "s long, n long")
    low, high = scalar.wilson(F.col("s"), F.col("n"))
    for r in df.select("s", "n", low.alias("a"), high.alias("b")).collect():
        assert (r.a is None) if r.n == 0 else 0 <= r.a <= r.s / r.n <= r.b <= 1


def test_missing_is_not_neutral(spark):
    df = frame(spark, [(0.5, None), (None, None), (0.5, -0.5)], "a double, b double")
    score, held = scoring.combine({"trend": F.col("a"), "momentum": F.col("b")})
    got = df.select(score.alias("s"), held.alias("h"), scoring.agreement([F.col("a"), F.col("b")]).alias("g")).collect()
    assert got[0].s == pytest.approx(0.5) and got[0].h == pytest.approx(0.3 / 0.55) and got[0].g == 0.5
    assert got[1].s is None and got[2].g == pytest.approx(0.5)


def test_bootstrap_covers_and_withholds():
    rng = np.random.default_rng(0)
    hit = 0
    for _ in range(60):
        x = rng.normal(0.3, 1, 400)
        low, high = np.percentile(stats.block_means(x, 10, 300, 7), [2.5, 97.5])
        hit += low <= 0.3 <= high
    assert hit >= 50 and len(stats.block_means(np.ones(19), 10, 5, 1)) == 0
    assert np.allclose(stats.block_means(np.ones(25), 10, 5, 1), 1)


def test_holm(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    got = {round(r.p, 3): r.p_holm for r in stats.holm(frame(spark, [(x,) for x in p], "p double"), "p").collect()}
    assert got == {0.01: pytest.approx(0.04), 0.03: pytest.approx(0.09), 0.04: pytest.approx(0.09), 0.5: pytest.approx(0.5)}


def test_cusum_restarts(spark):
    df = frame(spark, [("a", h, 0.9, 0.0) for h in range(10)], "key string, h long, p double, y double")
    got = stats.cusum(df, "p", "y", 0.1, 2.0).orderBy("h").collect()
    assert [(r.h, r.direction) for r in got] == [(2, 1), (5, 1), (8, 1)]


def test_auc_shares_ties(spark):
    rng = random.Random(5)
    rows = [("a", rng.randint(0, 5) / 5, rng.randint(0, 1)) for _ in range(60)] + [("b", 0.5, 1)]
    got = {r.key: r.auc for r in stats.auc(frame(spark, rows, "key string, p double, y int"), "p", "y", ("key",)).collect()}
    pos, neg = ([p for k, p, y in rows if k == "a" and y == v] for v in (1, 0))
    assert got["a"] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])) and got["b"] is None


def test_folds_keep_the_purge(spark):
    rows = models.folds(spark, 0, 1000, 200, 100, 50, 24, 2).collect()
    models.check_folds(rows, 24, 2)
    assert rows[0].test_start == 200 + 26 + 50 + 26 and rows[0].calib_end + 26 == rows[0].test_start
    with pytest.raises(ValueError):
        models.check_folds([rows[0].__class__(**{**rows[0].asDict(), "calib_end": rows[0].test_start - 5})], 24, 2)


def test_folds_reach_the_end_of_the_data(spark):
    rows = models.folds(spark, 0, 720, 200, 72, 72, 24, 1).collect()
    assert rows[-1].test_end == 720 and rows[-1].test_end - rows[-1].test_start < 72
    assert all(a.test_end == b.test_start for a, b in zip(rows, rows[1:], strict=False))
    assert models.folds(spark, 0, 300, 200, 72, 72, 24, 1).count() == 0


def test_walk_forward_fits_each_series_and_tests_all_hours(spark):
    rng = random.Random(4)
    c = frame(spark, [(k, h, x, float((x > 0) == (k == "a"))) for k in "ab" for h in range(500) for x in [rng.gauss(0, 1)]], "key string, h long, x double, y double")
    rows = joins.in_folds(c, models.folds(spark, 0, 500, 200, 100, 60, 5), "h")
    out = models.walk_forward(rows, ["x"], "y", by=("key",)).toPandas()
    assert sorted(zip(out.key, out.h, strict=True)) == [(k, h) for k in "ab" for h in range(270, 500)]
    assert ((out.p - out.y) ** 2).mean() < 0.1


def test_walk_forward_queries_read_all_keys(spark):
    from chronolith.plans import evaluation

    sf = "/root/testdata/sf0.001"
    got = evaluation.logistic_walkforward(spark, sf).toPandas()
    rows, _ = evaluation.fold_rows(spark, sf)
    late = rows.where("y IS NOT NULL AND volume > 0 AND close <> 0").groupBy("key").agg(F.max("i").alias("i")).collect()
    assert len(late) == 5 and {r.key: r.i for r in late} == got.groupby("key").i.max().to_dict()


def test_logistic_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [1.0, -2.0] + 0.5)))).astype(float)
    w, b = models.fit_logistic(x, y, c=1e6)
    assert np.allclose(w, [1, -2], atol=0.2) and abs(b - 0.5) < 0.15
    z = np.column_stack([x, np.ones(len(x))])
    p = models.apply_logistic(x, (w, b))
    assert np.abs(z.T @ (p - y)).max() < 1e-3
    a, c = models.fit_platt(models.apply_logistic(x, (2 * w, b)), y)
    assert 0.4 < a[0] < 0.6
    xs, ys = models.fit_isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert np.all(np.diff(ys) >= 0) and np.interp(0.25, xs, ys) == 0.5


def test_frozen_equals_export(spark):
    import pandas as pd

    rng = np.random.default_rng(4)
    x = pd.DataFrame({"a": rng.lognormal(size=300), "b": rng.normal(size=300)})
    y = (rng.random(300) < 0.5).astype(float)
    m = models.export_model(x, y, ("a",))
    df = spark.createDataFrame(pd.concat([x, pd.DataFrame({"a": [0.0, -1.0], "b": [1.0, 1.0]})]))
    got = df.select(scoring.frozen(m, {"a": F.col("a"), "b": F.col("b")}).alias("p")).collect()
    assert got[-1].p is None and got[-2].p is None and all(0 < r.p < 1 for r in got[:-2])


def test_memoriser_scores_at_chance(spark):
    rng = random.Random(9)
    c = frame(spark, [(h, rng.gauss(0, 1), float(rng.randint(0, 1))) for h in range(600)], "h long, x double, y double")
    rows = joins.in_folds(c, models.folds(spark, 0, 600, 200, 100, 60, 5), "h")
    out = models.walk_forward(rows, ["x"], "y").toPandas()
    assert len(out) > 100 and abs(((out.p - out.y) ** 2).mean() - 0.25) < 0.02


def test_accounts():
    a = simulate.Account()
    rule = simulate.Rule(stop_loss=0.1)
    assert simulate.full_step(a, 100, 1, rule, 0.0) == "enter" and a.units == 10
    assert simulate.full_step(a, 89, 1, rule, 0.0) == "stop_loss" and a.blocked and a.cash == 890
    assert simulate.full_step(a, 95, 1, rule, 0.0) == "keep"
    assert simulate.full_step(a, 95, 0, rule, 0.0) == "keep" and not a.blocked
    assert simulate.full_step(a, 95, 1, rule, 0.0) == "enter"
    assert simulate.full_step(a, 96, None, rule, 0.0) == "keep" and simulate.full_step(a, 97, 0, rule, 0.0) == "signal"
    b = simulate.Account()
    assert simulate.sized_step(b, 10, 1, 0.5, 0.0) == "enter" and b.units == 50
    assert simulate.sized_step(b, 11, 1, 0.5, 0.0) == "keep" and simulate.sized_step(b, 30, 1, 0.5, 0.0) == "resize"
    assert simulate.sized_step(b, 30, 0, 0.5, 0.0) == "leave" and b.units == 0


def test_policies_and_cycles(spark):
    rows = [("a", h, 100.0 + h, "BUY" if h < 10 else "SELL", 0.5, 0.001, 0.5) for h in range(30)]
    s = frame(spark, rows, "key string, h long, price double, signal string, score double, vol double, p double")
    curves = simulate.policies(s, [0.0])
    final = {r.policy: r.e for r in curves.groupBy("policy").agg(F.max_by("equity", "h").alias("e")).collect()}
    assert len(final) == 13 and final["C2_cash"] == 1000 and final["C1_buy_and_hold"] == pytest.approx(1290) and 1000 < final["A4"] < 1290
    got = simulate.cycles(curves.where("policy = 'A4'"), ("key",), "h", "exposure", "equity").collect()
    assert len(got) == 1 and got[0].ret == pytest.approx(final["A4"] / 1000 - 1) and got[0].end == 10


def test_fees_and_time_stops():
    a = simulate.Account()
    rule = simulate.Rule(time_stop=1)
    assert simulate.full_step(a, 100, 1, rule, 0.01) == "enter" and a.value(100) == pytest.approx(990)
    assert simulate.full_step(a, 100, 1, rule, 0.01) == "time_stop" and not a.blocked and a.cash == pytest.approx(990 * 0.99)
    assert simulate.full_step(a, 100, 1, rule, 0.01) == "enter"
    b = simulate.Account()
    assert simulate.full_step(b, 100, 1, simulate.Rule(trailing=0.1), 0.0) == "enter" and simulate.full_step(b, 120, None, simulate.Rule(trailing=0.1), 0.0) == "keep"
    assert simulate.full_step(b, 107, None, simulate.Rule(trailing=0.1), 0.0) == "trailing_stop" and b.blocked


def test_hourly_rules():
    def run(price, signal, size=1.0, **limits):
        n = len(price)
        return simulate.hourly_policy(np.arange(n), np.array(price, float), np.array(signal), np.full(n, size), simulate.Limits(**limits), 0.0)

    # a turn waits six hours, whatever side came last
    turn = run([100] * 9, [1, -1, -1, -1, -1, -1, -1, 1, 1])
    assert turn.action.tolist() == ["buy", "keep", "keep", "keep", "keep", "keep", "sell", "keep", "keep"]
    # the money at work is the capital: what exceeds it by the band is sold
    assert run([100] * 6 + [119, 121], [1] + [0] * 7).action.tolist() == ["buy", *["keep"] * 6, "sell"]
    # a loss of over 10 percent in a day sells all and halts for a week
    crash = run([100] * 25 + [85] * 170, [1] * 195)
    assert crash.action[25] == "exit" and (crash.action[26:193] == "keep").all() and crash.action[193] == "buy"


def test_selectors():
    k = simulate.Selectors(least_scores=2, least_outcomes=1, days=2)
    hours = np.array([0, 1, 2, 4, 5])
    assert simulate.run_length(hours, np.array([1, 1, 1, 1, 0])).tolist() == [1, 2, 3, 1, 1]
    edge = simulate.threshold(np.array([0.1, -0.3, 0.2, 0.5]), k)
    assert np.isnan(edge[:2]).all() and edge[2] == pytest.approx(0.28) and edge[3] == pytest.approx(0.28)
    day = np.arange(0, 96)
    above = simulate.above_mean(day, np.where(day < 48, 1.0, 2.0), k)
    assert np.isnan(above[:47]).all() and above[47] == 0 and above[71] == 1 and above[95] == 0
    gain = simulate.expected_return(np.arange(60), np.linspace(1, 2, 60), np.zeros(60, int), simulate.Selectors(least_outcomes=1, horizon=24))
    assert np.isnan(gain[:24]).all() and gain[59] > 0


def test_views_hide_later_knowledge(spark):
    p = frame(spark, [("x", 1, 2), ("y", 5, 6)], "id string, h long, created_h long")
    o = frame(spark, [("x", 1, 3, "ok", 0.1), ("x", 24, 30, "ok", 0.2), ("y", 1, 4, "ok", 0.3)], "prediction_id string, horizon int, checked_h long, status string, ret double")
    seen, graded = views.known_at(p, o, 5)
    assert [r.id for r in seen.collect()] == ["x"] and [(r.prediction_id, r.horizon) for r in graded.collect()] == [("x", 1)]
    state = {(r.id, r.horizon): r.state for r in views.run_view(p, o, [1, 24], 40).collect()}
    assert state == {("x", 1): "graded", ("x", 24): "graded", ("y", 1): "graded", ("y", 24): "overdue"}


def test_sinks_keep_the_first(spark):
    old, new = frame(spark, [(1, "a")], "k int, v string"), frame(spark, [(1, "b"), (2, "c"), (2, "d")], "k int, v string")
    assert sinks.append_once(old, new, ["k"], ["v"]).collect() == [(2, "c")]
    table, changed = sinks.upsert_changed(old, frame(spark, [(1, "a"), (3, None)], "k int, v string"), ["k"], "v")
    assert changed.count() == 0 or sorted(r.k for r in changed.collect()) == [3]
    assert sinks.checksum(new).collect() == sinks.checksum(new.orderBy(F.desc("v"))).collect() != sinks.checksum(old).collect()


def test_candle_errors_and_registered(spark):
    rows = [(1.0, 2.0, 0.5, 1.5, 1.0), (1.0, 0.9, 0.5, 1.5, 1.0), (float("nan"), 2.0, 0.5, 1.5, 1.0), (1.0, 2.0, 0.5, 1.5, -1.0), (None, 2.0, 0.5, 1.5, 1.0)]
    df = frame(spark, rows, "open double, high double, low double, close double, volume double")
    assert [r.e for r in df.select(tables.candle_error().alias("e")).collect()] == [None, "range", "price", "volume", "price"]
    s = frame(spark, [(h,) for h in range(10)], "h long")
    entry = tables.Registered("macro", "h", 2)
    assert tables.read_registered(s, entry, 5).count() == 4 and tables.read_registered(s, entry, 50, sealed_from=3).count() == 3
    with pytest.raises(ValueError):
        tables.read_registered(s, tables.Registered("x", "h", 0, refused="wrong"), 5)


def test_payloads(spark):
    df = frame(spark, [("BTC-27JUN25-100000-C", [(100.0, 1.0), (102.0, 10.0)]), ("junk", [(100.0, 1.0)])], "name string, levels array<struct<price:double,size:double>>")
    parts = payloads.option_parts(F.col("name"))
    got = df.select(*[c.alias(k) for k, c in parts.items()], payloads.walk_book(F.col("levels"), 202.0).alias("fill")).collect()
    assert str(got[0].expiry) == "2025-06-27" and got[0].strike == 100000 and got[0].side == "C" and got[0].fill == pytest.approx(101) and got[1].strike is None and got[1].fill is None


def test_indicators_depend_on_the_window():
    close = 100 + np.cumsum(np.random.default_rng(1).normal(size=300))
    short, long, rsi, macd, signal, histogram, lower, upper = indicators.one(close[-250:])
    assert short == pytest.approx(close[-50:].mean()) and long == pytest.approx(close[-200:].mean()) and 0 < rsi < 100 and histogram == pytest.approx(macd - signal) and lower < close[-20:].mean() < upper
    assert indicators.one(close[:14]) == (None,) * 8


def test_empty_tables(spark):
    df = frame(spark, [], "key string, h long, close double")
    assert G.densify(df).count() == 0 and features(df).count() == 0 and joins.at_shift(df, 1, {"close": "x"}).count() == 0
    assert joins.asof(df, df.withColumnRenamed("close", "v"), ["v"], "h", "h", ("key",)).count() == 0


def test_bootstrap_of_any_statistic(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.choice([-1.0, 1.0], 200), rng.normal(size=200)])
    df = frame(spark, [("a", i, float(s), float(v)) for i, (s, v) in enumerate(x)], "key string, h long, side double, ret double")
    got = stats.bootstrap(df, "key", ["side", "ret"], stats.side_edge, "h", block=10, count=50, seed=3).collect()[0]
    draw, drawn = np.random.default_rng(3), []
    for _ in range(50):
        places = [(s + k) % 200 for s in draw.integers(0, 200, 20) for k in range(10)]
        drawn.append(stats.side_edge(x[places]))
    assert got.n == 200 and got.point == pytest.approx(stats.side_edge(x)) and [got.low, got.high] == pytest.approx(list(np.percentile(drawn, [2.5, 97.5])))
    short = stats.bootstrap(df.where("h < 15"), "key", ["side", "ret"], stats.side_edge, "h", block=10).collect()[0]
    assert short.low is None and short.point is not None


def test_group_calibration(spark):
    rng = np.random.default_rng(5)
    rows = [("a", i, i % 2, 0.5 if i % 2 else 0.9, float(rng.random() < 0.5)) for i in range(600)]
    got = {r.block: r for r in stats.group_calibration(frame(spark, rows, "key string, h long, block int, p double, y double"), "key", "block", "p", "y", "h", block=24, count=100).collect()}
    assert got[1].n == 300 and got[0].gap > 0.3 and not got[0].holds and got[0].low < got[0].gap < got[0].high and abs(got[1].gap) < 0.1


def test_alarm_limits(spark):
    rng = np.random.default_rng(6)
    p = rng.uniform(0.2, 0.6, 1500)
    y = (rng.random(1500) < p).astype(float)
    df = frame(spark, [("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, y, strict=True))], "key string, h long, p double, y double")
    got = stats.alarm_limits(df, "key", "p", "y", "h", target=1.0, window=600, step=300, change=100, delta=0.3).collect()[0]
    assert got.control_rate <= 1.0 and got.limit >= 1 and got.windows == 4 and 5 < got.median_delay < 200
    looser = stats.alarm_limits(df, "key", "p", "y", "h", target=5.0, window=600, step=300, change=100, delta=0.3).collect()[0]
    assert looser.limit <= got.limit
    assert stats.alarms(np.array([0.5, 0.5, 0.5, -0.9, -0.9]), 0.1, 1.0) == [(2, 1), (4, -1)]


def test_shared_slope_is_stationary(spark):
    rng = np.random.default_rng(7)
    block, z = rng.integers(0, 4, 2000), rng.normal(size=2000)
    p, y = 1 / (1 + np.exp(-z)), (rng.random(2000) < 1 / (1 + np.exp(-(0.7 * z + np.array([0.5, -0.5, 0.0, 1.0])[block])))).astype(float)
    df = frame(spark, [("a", int(b), float(s), float(v)) for b, s, v in zip(block, p, y, strict=True)], "key string, block int, p double, y double")
    got = models.shared_slope(df, "key", "block", "p", "y").collect()[0]
    fitted = 1 / (1 + np.exp(-(got.slope * z + np.array(got.intercepts)[block])))
    assert got.slope == pytest.approx(0.7, abs=0.15) and all(abs((fitted - y)[block == k].sum()) < 1e-2 for k in range(4))


def test_calibrated_models(spark):
    """Platt keeps the order, isotonic is a step function of it, and both come from calibration rows only."""
    rng = random.Random(12)
    rows = [(h, x := rng.gauss(0, 1), float(rng.random() < 1 / (1 + np.exp(-2 * x)))) for h in range(900)]
    dealt = joins.in_folds(frame(spark, rows, "h long, x double, y double"), models.folds(spark, 0, 900, 300, 200, 150, 2), "h")
    for kind in (None, "platt", "isotonic"):
        out = models.walk_forward(dealt, ["x"], "y", calibrator=kind).toPandas()
        assert len(out) > 300 and ((out.p - out.y) ** 2).mean() < 0.21
        for _, g in out.groupby("fold"):
            g = g.sort_values("p_raw")
            assert (np.diff(g.p) >= -1e-12).all() and (kind is not None or (g.p == g.p_raw).all())


def test_paged_history(spark):
    assert [tuple(r) for r in paged.history(spark, 5, 12, 3, ("malformed", "reference")).orderBy("h").collect()] == paged.reference_series(5, 7)
    assert paged.history(spark, 5, 5).count() == 0
    with pytest.raises(Exception, match="no answer"):
        paged.history(spark, 0, 3, 3, ("silent",)).collect()


def test_context_sources_fail_alone(spark):
    got = {r.source: r for r in context.collect(spark, {"a": lambda: {"x": 1}, "b": lambda: 1 / 0, "c": lambda: time.sleep(3)}, deadline=0.5).collect()}
    assert (got["a"].status, got["a"].payload) == ("ok", '{"x": 1}') and (got["b"].status, got["b"].error) == ("error", "ZeroDivisionError") and got["c"].status == "late"
    assert context.collect(spark, {}).count() == 0


def test_registered_files(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("h,v\n1,10\n2,20\n5,30\n")
    sha = hashlib.sha256(path.read_bytes()[:9]).hexdigest()
    entry = tables.Registered("s", "h", 1, rows=3, size=9, sha256=sha)
    assert tables.check_snapshot(spark, str(path), entry).count() == 3
    for bad in (replace(entry, rows=4), replace(entry, sha256="0" * 64), replace(entry, time="v"), replace(entry, refused="wrong source")):
        with pytest.raises(tables.SnapshotError):
            tables.check_snapshot(spark, str(path), bad)
    path.write_text("h,v\n1,10\n1,20\n")
    with pytest.raises(tables.SnapshotError, match="increase"):
        tables.check_snapshot(spark, str(path), tables.Registered("s", "h", 1))
    tables.check_columns(frame(spark, [], "a int"))
    with pytest.raises(ValueError):
        tables.check_columns(frame(spark, [], "a int, fwd_x int"))


def test_ledgers_only_grow(spark, tmp_path):
    ledger = sinks.Ledger(spark, str(tmp_path / "t"), ["k"], ["v"], "k int, v string")
    ledger.add(frame(spark, [(1, "a"), (1, "b"), (2, "c")], "k int, v string"))
    ledger.add(frame(spark, [(1, "z"), (3, None)], "k int, v string"))
    assert sorted((r.k, r.v) for r in ledger.rows().collect()) == [(1, "a"), (2, "c"), (3, None)]
    with pytest.raises(ValueError):
        ledger.add(frame(spark, [(4,)], "k int"))


def test_feeds_and_expiries(spark):
    rss = "<rss><channel><item><title> A </title><pubDate>Mon, 06 Oct 2025 10:00:00 +0200</pubDate></item><item><title>B</title><updated>2025-10-06T12:00:00Z</updated><description> </description></item></channel></rss>"
    got = frame(spark, [(rss, "5JAN26"), ("no xml", "5JANX6"), (None, None)], "x string, c string").select(payloads.feed_items(F.col("x")).alias("i"), payloads.expiry_hour(F.col("c")).alias("e")).collect()
    assert [(i.title, i.summary, str(i.available_at)) for i in got[0].i] == [("A", None, "2025-10-06 08:00:00"), ("B", None, "2025-10-06 12:00:00")] and got[0].e == 20458 * 24 + 8
    assert not got[1].i and got[1].e is None and got[2].i is None and got[2].e is None


def test_streams_over_restarts_and_late_rows(spark, tmp_path):
    """Files come between runs of one checkpoint; a row behind the watermark changes no candle, and none comes out twice."""
    schema = "event_id long, ts timestamp_ntz, value double, event_type string"
    source, run = str(tmp_path / "in"), lambda: live.run_to_end(live.closed_candles(live.stream_files(spark, source, spark.createDataFrame([], schema).schema)), str(tmp_path / "check"), live.into_parquet(str(tmp_path / "out")))
    at = lambda hour, minute=0: datetime(2025, 1, 1, hour, minute)

    def put(*rows):
        frame(spark, [(k, t, float(v), "a") for k, t, v in rows], schema).coalesce(1).write.mode("append").parquet(source)

    put((1, at(0), 1), (2, at(0, 30), 3), (3, at(1), 5), (4, at(4), 7))
    run()
    put((5, at(0, 40), 100), (6, at(4, 10), 9), (7, at(9), 2))
    run()
    run()
    put((8, at(20), 1))
    run()
    out = spark.read.parquet(f"{tmp_path}/out/*").orderBy("h").collect()
    first = 482136
    assert [(r.h - first, r.close, r.trades) for r in out] == [(0, 3.0, 2), (1, 5.0, 1), (4, 9.0, 2), (9, 2.0, 1)]


def test_indicators_equal_a_fold_of_each_window():
    """All windows at once against the definition, window by window."""
    close = 100 + np.cumsum(np.random.default_rng(2).normal(size=320))

    def smooth(x, alpha):
        return reduce(lambda acc, v: [*acc, v if not acc else alpha * v + (1 - alpha) * acc[-1]], x, [])

    got = indicators.table(close)
    for i in (10, 13, 14, 19, 33, 34, 60, 200, 248, 249, 250, 319):
        w = close[max(0, i - 249) : i + 1]
        want = [np.nan] * 8
        if len(w) >= 50:
            want[0] = w[-50:].mean()
        if len(w) >= 200:
            want[1] = w[-200:].mean()
        if len(w) >= 15:
            step = np.diff(w)
            want[2] = 100 - 100 / (1 + smooth(np.maximum(step, 0), 1 / 14)[-1] / smooth(np.maximum(-step, 0), 1 / 14)[-1])
        if len(w) >= 35:
            line = np.array(smooth(w, 2 / 13)) - np.array(smooth(w, 2 / 27))
            signal = smooth(line[25:], 2 / 10)[-1]
            want[3:6] = [line[-1], signal, line[-1] - signal]
        if len(w) >= 20:
            want[6], want[7] = w[-20:].mean() - 2 * w[-20:].std(), w[-20:].mean() + 2 * w[-20:].std()
        assert got[i] == pytest.approx(want, nan_ok=True)
    assert indicators.table(np.full(30, 5.0))[-1, 2] == 100


def test_feature_groups(spark):
    g = G.densify(frame(spark, [("a", h, 1.0, 2.0, 0.5, float(h + 1), 4.0, 2, 1.0) for h in range(30) if h != 7], "key string, h long, open double, high double, low double, close double, volume double, trades long, taker double"))
    got = {r.h: r for r in feature_columns.features(g, ["returns", "flow"]).collect()}
    assert len(got) == 30 and got[8].change_1 is None and got[9].change_1 == pytest.approx(10 / 9 - 1) and got[0].taker_share == 0.25 and got[7].log_volume is None
    assert feature_columns.group_of("change_6") == "returns"
    for ask in (lambda: feature_columns.group_of("nothing"), lambda: feature_columns.features(g, ["nothing"])):
        with pytest.raises(KeyError):
            ask()


def test_reports_from_the_command_line(spark):
    def report(*args):
        out = io.StringIO()
        assert cli.main([*args, "--sf", "/root/testdata/sf0.001"], spark, out) == 0
        return [json.loads(x) for x in out.getvalue().splitlines()]

    newest = report("latest")[0]["row"]
    page = report("runs", "--limit", "3", "--before", str(newest["h"]))
    assert len(page) == 3 and all(x["row"]["h"] < newest["h"] for x in page)
    one = report("run", "--hour", str(page[0]["row"]["h"]))
    assert {x["row"]["horizon"] for x in one} == {1, 24} and all(x["row"]["h"] == page[0]["row"]["h"] for x in one)
    early = report("statistics", "--at", str(newest["h"] - 100))
    assert {x["row"]["horizon"] for x in early} == {1, 24} and early[0]["row"]["n"] < report("statistics")[0]["row"]["n"]
    assert {x["kind"] for x in report("all")} == {"latest", "runs", "statistics", "health"}
    with pytest.raises(SystemExit):
        cli.main(["run", "--sf", "x"], spark)


def test_catalog_bootstrap(spark):
    name = f"made_{random.getrandbits(40)}"
    assert sinks.bootstrap(spark, {name: "a int"}) == [name] and sinks.bootstrap(spark, {name: "a int"}) == [] and spark.table(name).count() == 0
    spark.sql(f"DROP TABLE {name}")


def test_boosted_trees(spark):
    rng = random.Random(3)
    rows = [(h, x := rng.gauss(0, 1), rng.gauss(0, 1), float(x > 0.3)) for h in range(400)] + [(500, None, 1.0, 1.0)]
    df = frame(spark, rows, "h long, a double, b double, y double")
    got = models.boosted(df.where("h < 300"), df.where("h >= 300"), ["a", "b"], "y").toPandas()
    assert len(got) == 100 and ((got.p > 0.5) == (got.y > 0.5)).mean() > 0.95


def test_strategy_set(spark):
    """118 strategies; what each wants and how large, on a made-up series, against plain pandas for some."""
    rng = np.random.default_rng(8)
    price = 100 * np.exp(np.cumsum(rng.normal(scale=0.03, size=260)))
    rows = [("a", d, float(p), int(rng.integers(-1, 2)), float(rng.uniform(-0.3, 0.3)), float(rng.uniform(0, 1))) for d, p in enumerate(price) if d != 100]
    got = strategies.wishes(strategies.inputs(frame(spark, rows, "key string, d long, price double, sig23 int, vote double, pbar double"))).toPandas()
    assert got["rule"].nunique() == len(strategies.strategies()) == 118 and len(got) == 118 * 259
    wide, sizes = got.pivot(index="d", columns="rule", values="desired"), got.pivot(index="d", columns="rule", values="size")
    have = pd.Series(price).drop(100)
    week = pd.Series(price).where(pd.Series(range(260)) != 100)
    back = (week / week.shift(7) - 1).drop(100)
    pd.testing.assert_series_equal(wide["B_R7"], (back > 0).astype(float).where(back.notna()), check_names=False, check_index_type=False)
    mean = have / have.rolling(50).mean() - 1
    pd.testing.assert_series_equal(wide["C_MA50_b3"], pd.Series(np.where(mean > 0.03, 1.0, np.where(mean < -0.03, 0.0, np.nan)), have.index), check_names=False, check_index_type=False)
    high, low = have.shift(1).rolling(20).max(), have.shift(1).rolling(10).min()
    pd.testing.assert_series_equal(wide["G_up20_down10"], pd.Series(np.where(have > high, 1.0, np.where(have < low, 0.0, np.nan)), have.index), check_names=False, check_index_type=False)
    assert (wide["BASE_cash"] == 0).all() and set(sizes["MS_BH_msmore"].dropna().between(0.25, 1)) == {True} and sizes["B_R7"].isna().all()


def test_books_have_spreads():
    a, b = simulate.Account(), simulate.Account()
    assert simulate.full_step(a, 100, 1, simulate.Rule(), 0.0, 0.01) == "enter" and a.units == pytest.approx(1000 / 101)
    assert simulate.full_step(a, 100, 0, simulate.Rule(), 0.0, 0.01) == "signal" and a.cash == pytest.approx(1000 * 99 / 101)
    assert simulate.sized_step(b, 100, 1, 0.5, 0.0, 0.01) == "enter" and b.units == pytest.approx(500 / 101)
    assert simulate.sized_step(b, 100, None, 0.5, 0.0, 0.01) == "keep" and b.inside


def written_events(spark, path, rows):
    """An events table of (hour, value) rows of one key, some hours with several, without rows if there are none."""
    days = [(i, datetime(2024, 1, 1 + h // 24, h % 24, 0, i % 60), i % 7, "view", v, "{}") for i, (h, v) in enumerate(rows)]
    frame(spark, days, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("odd", [[0.0], [0.0, 0.0], [5.0, 0.0], [-0.0, 3.0], [-2.0, 3.0], [-2.0, 0.0], [-2.0, -1.0], [float("inf"), 1.0], [float("nan"), 1.0], [float("nan"), 0.0], [0.0, float("inf")]])
def test_parkinson_of_zero_negative_and_unbounded_prices(spark, tmp_path, odd):
    """Windows with the odd hour have the results of SQL, and those after it are as if it hadn't been."""
    rng = random.Random(5)
    rows = [(h, rng.uniform(1, 9)) for h in range(70) for _ in range(2) if h != 30] + [(30, v) for v in odd]
    sf = written_events(spark, tmp_path, rows)
    assert compare(spark, connect(sf), sf, QUERIES["parkinson"], SQL["parkinson"]) == 70 - 23


@pytest.mark.parametrize("values", [[3.0, 4.0], [3.0, 0.0], [0.0, 4.0], [-1.0, 4.0], [float("nan"), 4.0], [4.0, float("inf")], []])
def test_usable_source_whatever_the_prices(spark, tmp_path, values):
    sf = written_events(spark, tmp_path, [(50 * k, v) for k, v in enumerate(values)])
    assert compare(spark, connect(sf), sf, QUERIES["usable_source"], SQL["usable_source"]) == 1


def test_first_usable_refuses_invalid_candles(spark):
    candle = lambda h, low: (h, 2.0, 2.0, low, 2.0, 1.0)
    late, zero, good = (frame(spark, rows, "h long, open double, high double, low double, close double, volume double") for rows in ([candle(3, 1.0)], [candle(4, 0.0)], [candle(4, 1.0)]))
    assert tables.first_usable([late, zero, good], 5) is good and tables.first_usable([late, zero], 5) is None
    assert tables.first_usable([late, zero, good], 5, error=F.lit(None)) is zero
