"""Operators over whole corpora, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import jaccard_join, masked_lm, mixing, quality, sharding, spotsigs

from .cases import WORDS, documents, frame, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, width):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def linked(rows, width, percent):
    sets = [shingles(t, width) for _, t, _ in rows]
    label = {k: k for k, _, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                label[b] = a
    return {k: (len(s), find(k)) for (k, _, _), s in zip(rows, sets, strict=True)}


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_jaccard_join_loses_no_link(spark, width, percent, monkeypatch):
    rng = random.Random(7)
    passage = text(rng, 40)
    rows = [*documents(), *[(300 + k, edited(rng, documents()[5][1], k % 4), "s") for k in range(40)]]
    rows += [(400 + k, text(rng, 30) + " " + passage + " " + text(rng, rng.randint(2, 30)), "s") for k in range(60)]
    rows += [(500 + k, passage + f" tail{k % 5}", "s") for k in range(20)]
    monkeypatch.setattr(jaccard_join, "FREQUENT", 6)  # so that this small table has frequent tokens
    monkeypatch.setattr(jaccard_join, "MOST_FREQUENT", 200)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(frame(spark, rows, ("n_shingles", "cid", "label")), width=width, percent=percent).collect()}
    assert got == linked(rows, width, percent)


def test_jaccard_join_without_groups(spark, monkeypatch):
    """The matrix alone must find every link, also those that no band of minimum hashes shares."""
    rng = random.Random(8)
    rows = [(k, edited(rng, documents()[k % 6][1], k % 3), "s") for k in range(60)]
    monkeypatch.setattr(jaccard_join, "star_links", lambda rows, sets, percent: rows.sparkSession.createDataFrame([], "a long, b long"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(frame(spark, rows)).collect()}
    assert got == linked(rows, 4, 85)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.link_components(frame(spark, [])).count() == 0
    got = jaccard_join.keep_first(frame(spark, [(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (None, None, None), (3, "", "s")]))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 1), (False, 3), (True, 0)]


def test_keep_first_decides_by_row(spark):
    one, two, three = (text(random.Random(k), 40) for k in (41, 42, 43))
    rows = [(1, one, "a"), (None, one, "b"), (None, text(random.Random(44), 40), "c"), (None, two, "d"), (None, two, "e")]
    rows += [(7, three, "f"), (7, three, "g"), (1, text(random.Random(45), 40), "h"), (3, one, "i"), (None, None, "j"), (None, "", "k")]
    got = jaccard_join.keep_first(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "source"]
    kept = sorted(r.source for r in got.collect())
    assert [x for x in kept if x not in "defg"] == ["a", "c", "h", "j", "k"] and sum(x in "de" for x in kept) == sum(x in "fg" for x in kept) == 1


def test_spotsigs(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 5)
    rows = sorted({r[0]: r for r in documents()}.values(), reverse=True)
    got = {r.doc_id: r for r in spotsigs.compare_edited(frame(spark, rows, ("fingerprint", "part", "id"))).collect()}
    assert len(got) == len(rows)
    table = str.maketrans(spotsigs.SPACES + spotsigs.PUNCTUATION, " " * len(spotsigs.SPACES) + "\0" * len(spotsigs.PUNCTUATION))

    def sigs(t):
        w = [x for x in t.lower().translate(table).replace("\0", "").split(" ") if x]
        content, out, k = [x for x in w if x not in spotsigs.ANCHORS], set(), 0
        for i, x in enumerate(w):
            if x in spotsigs.ANCHORS:
                chain = tuple(content[i - k : i - k + spotsigs.CHAIN])
                out |= {chain} if len(chain) == spotsigs.CHAIN else set()
                k += 1
        return out or ({tuple(w)} if w else set())

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, (k, t, _) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(sigs(t), sigs(e)), abs=1e-3) and r.near_next == pytest.approx(like(sigs(t), sigs(after)), abs=1e-3)
    assert got[100].fingerprint == got[101].fingerprint and got[103].fingerprint == got[104].fingerprint == ""
    assert spotsigs.compare_edited(frame(spark, [])).count() == 0
    repeated = spotsigs.compare_edited(frame(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (None, None, None)]))
    assert repeated.count() == 4


def test_spotsigs_pairs(spark):
    rng = random.Random(4)
    rows = [(k, edited(rng, documents()[k % 5][1], k % 3), "s") for k in range(40)]
    pairs, classes = spotsigs.near_pairs(frame(spark, rows), 0.8)
    prints = {r.doc_id: r.fingerprint for r in spotsigs.fingerprints(frame(spark, rows)).collect()}
    sets = {k: {f[i : i + 8] for i in range(0, len(f), 8)} for k, f in prints.items()}
    first = {f: min(k for k in prints if prints[k] == f) for f in prints.values()}
    assert {r.doc_id: r.class_id for r in classes.collect()} == {k: first[f] for k, f in prints.items()}
    reps = sorted({*first.values()})
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == want and want


def test_sharding(spark):
    rng = random.Random(2)
    rows = [*documents(), *[(1000 + k, text(rng, rng.randint(5, 60)), "s") for k in range(300)], *[(2000 + k, "the same text again and again", "s") for k in range(150)], *[(3000 + k, f"pair {k // 2} of equal texts", "s") for k in range(60)]]
    got = sharding.shard_documents(frame(spark, rows, ("shard", "size", "node"))).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    texts = {k: (t or "").encode() for k, t, _ in rows}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and 0 <= r.shard < 8 for r in got)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(load.values()) / 8
    assert max(abs(v - mean) for v in load.values()) <= max(r.size for r in got)
    pairs = defaultdict(set)
    for r in got:
        if 3000 <= r.doc_id < 3060:
            pairs[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) == 1 for s in pairs.values()) >= 24  # by chance about 4 of 30
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def goal(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, most = sum(sizes.values()), {s: 3.0 * n for s, n in sizes.items()}
    capped: dict = {}
    while True:
        left = total - sum(capped.values())
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most[s]]
        if not over:
            return capped | share
        capped |= {s: most[s] for s in over}


def test_mixing(spark):
    rng = random.Random(6)
    rows = [*documents(), *[(1000 + k, text(rng, rng.randint(1, 50)), rng.choice(["a", "b", "é", None, "tiny"] if k % 20 == 0 else ["a", "b", "é", None])) for k in range(500)]]
    got = mixing.mix(frame(spark, rows, ("size", "target", "hash", "whole", "id")))
    rows_got = got.collect()
    assert len(rows_got) == len(rows) and sorted(map(str, rows_got)) == sorted(map(str, got.collect()))
    sizes: dict = defaultdict(int)
    words = {}
    for k, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
        words[k] = (len(WORD.findall(t or "")), s)
    want, taken, largest = goal(sizes), defaultdict(int), defaultdict(int)
    for r in rows_got:
        n, s = words[r.doc_id]
        assert r.size == n and r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * n
        taken[s] += r.taken
        largest[s] = max(largest[s], n * sum(x[0] == r.doc_id for x in rows))
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    assert mixing.mix(frame(spark, [])).count() == 0
    kept = mixing.mix(frame(spark, rows), keep=["text", "source"])
    assert {"text", "source", "copies"} <= set(kept.columns) and kept.count() == len(rows)


def labelled(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(w + ("***" if k % 4 == 0 else "") for w in text(rng, 40).split()), "s") for k in range(300)] + documents()[-12:]
    return frame(spark, rows, ("score", "quality")), spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(300)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    got = quality.classify(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id < 100]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    swapped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality.classify(docs, swapped).collect()) == sorted(got)  # held-out labels are never read
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    kept = quality.keep_quality(docs, labels, 0.5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id < 100} == {r.doc_id for r in got if r.score >= 0.5 and r.doc_id < 100}
    assert quality.classify(frame(spark, []), labels).count() == 0


def test_masked_lm(spark):
    rng = random.Random(1)
    follow = dict(zip(WORDS, rng.sample(WORDS, len(WORDS)), strict=True))

    def chain(n):
        out = [rng.choice(WORDS)]
        while len(out) < n:
            out.append(follow[out[-1]] if rng.random() < 0.9 else rng.choice(WORDS))
        return out

    rows = [(k, " ".join(chain(200)), "s") for k in range(200)]
    train = frame(spark, rows)
    model = masked_lm.train(train, stride=1)
    test = [chain(200) for _ in range(20)]
    asked = [(k, " ".join(w), "s") for k, w in enumerate(test)] + [(100 + k, " ".join(rng.sample(w, len(w))), "s") for k, w in enumerate(test)] + [(300, None, "s"), (301, "", "s"), (302, "zzz qqq", "s")]
    got = {r.doc_id: r for r in masked_lm.score(frame(spark, asked, ("n_words",)), model=model).collect()}
    assert all(got[k].pseudo_log_likelihood > got[100 + k].pseudo_log_likelihood for k in range(20))
    assert got[300].n_words == 0 and got[300].pseudo_log_likelihood == 0 and got[300].mean_log_probability is None and got[302].pseudo_log_likelihood < 0
    assert masked_lm.score(frame(spark, [])).count() == 0


def test_masked_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    net = masked_lm.Network(rng.integers(1, 100, masked_lm.SYMBOLS).astype(float))
    context = np.tile(rng.integers(0, masked_lm.SYMBOLS, (1, 4)), (masked_lm.SYMBOLS, 1))
    logs = net.log_probability(np.arange(masked_lm.SYMBOLS), context)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-3)


def test_masked_lm_trains_on_every_word(spark):
    docs = frame(spark, [(k, text(random.Random(k), 40), "s") for k in range(60)])
    assert masked_lm.STRIDE == 1 and masked_lm.train.__defaults__[-1] == 1
    assert np.array_equal(masked_lm.train(docs.coalesce(1))[1], masked_lm.train(docs.coalesce(1), stride=1)[1])


def test_masked_lm_step_is_the_gradient_by_class():
    rng = np.random.default_rng(2)
    net, was = (masked_lm.Network(np.ones(masked_lm.SYMBOLS)) for _ in range(2))
    symbol, context, rate = rng.integers(0, 300, 200), rng.integers(0, 50, (200, 4)), 0.1
    net.step(symbol, context, rate)
    h, c, m = was.hidden(context), symbol // masked_lm.MEMBERS, symbol % masked_lm.MEMBERS
    softmax = lambda z: np.exp(z) / np.exp(z).sum(1, keepdims=True)
    g = softmax(h @ was.wc + was.bc) - np.eye(masked_lm.CLASSES)[c]
    gh = g @ was.wc.T
    for k in np.unique(c):
        i = np.flatnonzero(c == k)
        e = softmax(h[i] @ was.wm[k] + was.bm[k]) - np.eye(masked_lm.MEMBERS)[m[i]]
        gh[i] += e @ was.wm[k].T
        assert np.allclose(net.wm[k], was.wm[k] - rate * h[i].T @ e / len(i), atol=1e-5) and np.allclose(net.bm[k], was.bm[k] - rate * e.mean(0), atol=1e-5)
    table = was.table.astype(float)
    for k in range(4):
        np.add.at(table[k], context[:, k], -rate * gh * (1 - h * h))
    assert np.allclose(net.table, table, atol=1e-5) and np.allclose(net.wc, was.wc - rate * 4 * h.T @ g / 200, atol=1e-5)


def test_masked_lm_divides_a_bucket_among_its_words(spark):
    rng = random.Random(5)
    often = ["w%dzz" % k for k in range(masked_lm.SYMBOLS - masked_lm.BUCKETS)]
    rare = ["aaaqqend", "bbbqqend", "cccqqend"]  # one ending and length, so one bucket; with 3, 2 and 1 occurrences
    words = often * 4 + [rare[0]] * 3 + [rare[1]] * 2 + [rare[2]]
    rng.shuffle(words)
    rows = [(k, " ".join(words[a : a + 500]), "s") for k, a in enumerate(range(0, len(words), 500))]
    model = masked_lm.train(frame(spark, rows))
    asked = [(k, w, "s") for k, w in enumerate([*rare, "dddqqend", "eeeqqend", often[0]])] + [(None, rare[0], "s"), (0, rare[0] + " " + rare[0], "s")]
    rows = masked_lm.score(frame(spark, asked), model=model).collect()
    got = {(r.doc_id, r.n_words): r.pseudo_log_likelihood for r in rows}
    assert len(rows) == len(asked) and got[None, 1] == got[0, 1]
    assert got[0, 1] - got[1, 1] == pytest.approx(np.log(3 / 2), abs=1e-3) and got[1, 1] - got[2, 1] == pytest.approx(np.log(2), abs=1e-3)
    assert got[2, 1] - got[3, 1] == pytest.approx(np.log(4), abs=1e-3) and got[3, 1] == got[4, 1]


def test_masked_lm_scores_are_sums_over_all_words(spark, monkeypatch):
    """Against plain Python from the trained weights, whatever the partitions and however many words are broadcast."""
    rng = random.Random(21)
    often = [f"w{k}" for k in range(masked_lm.SYMBOLS - masked_lm.BUCKETS)]
    every = [w for w in often for _ in range(3)] + [f"r{k}q" for k in range(300) for _ in range(1 + k % 2)]
    rng.shuffle(every)
    rows = [(k, " ".join(every[60 * k : 60 * k + 60]), "s") for k in range(-(-len(every) // 60))]
    rows += [(900, None, "s"), (901, "", "s"), (902, "r1q " * 900, "s"), (5, text(rng, 9), "s"), (903, rows[0][1], "s"), rows[1]]
    df, got = frame(spark, rows, ("n_words", "__sure")), []
    for partitions, known in ((1, 500_000), (7, 500_000), (3, 4), (3, 0)):
        monkeypatch.setattr(masked_lm, "KNOWN", known)
        model = masked_lm.train(df.repartition(partitions), id_col="doc_id", shard=4000)
        got.append((model, {(r.doc_id, r.n_words): r.pseudo_log_likelihood for r in masked_lm.score(df.repartition(partitions), model=model).collect()}))
    model, first = got[0]
    for other, scores in got[1:]:
        assert np.allclose(other[1], model[1], atol=1e-5) and scores.keys() == first.keys() and all(abs(scores[k] - first[k]) < 2e-2 for k in scores)
    net, counts = masked_lm.Network(np.ones(masked_lm.SYMBOLS)).load(model[1]), Counter(w for _, t, _ in rows for w in WORD.findall((t or "").translate(LOWER)))
    h, bucket, _ = masked_lm.hashed(np.frombuffer("\n".join(counts).encode(), np.uint8), np.array([0, len("\n".join(counts))]))
    symbol = dict(zip(counts, model[0].of(h, bucket).tolist(), strict=True))
    plain_bucket = dict(zip(counts, bucket.tolist(), strict=True))
    folded = {w for w in counts if symbol[w] in set(model[0].buckets.tolist())}
    rest = Counter()
    for w in folded:
        rest[plain_bucket[w]] += counts[w]
    for key, t, _ in rows[::9] + rows[-6:]:
        words, total = WORD.findall((t or "").translate(LOWER)), 0.0
        for i, w in enumerate(words):
            z = net.shift.astype(float)
            for k, p in enumerate(masked_lm.PLACES):
                z = z + net.table[k][symbol[words[i + p]] if 0 <= i + p < len(words) else masked_lm.SYMBOLS]
            hidden, (c, m) = np.tanh(z), divmod(symbol[w], masked_lm.MEMBERS)
            by_class, inside = hidden @ net.wc + net.bc, hidden @ net.wm[c] + net.bm[c]
            total += by_class[c] - np.log(np.exp(by_class).sum()) + inside[m] - np.log(np.exp(inside).sum())
            total += np.log(counts[w] / (rest[plain_bucket[w]] + 1)) if w in folded else 0
        assert abs(first[key, len(words)] - total) < 2e-2 + 1e-4 * len(words)


def test_sharding_depends_on_rows_only(spark):
    """Another split into files gives the same shards and slots; linked rows are cut less often than by hash."""
    rng = random.Random(31)
    base = [text(rng, rng.randint(5, 60)) for _ in range(60)]
    rows = [(k, base[k % 60] if k % 3 else base[k % 7], "s") for k in range(240)] + [(None, base[0], "s"), (None, None, "s"), (3, "other", "s")]
    df = frame(spark, rows)
    a, b = (sorted(((r.doc_id is None, r.doc_id or 0, r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(x).collect())) for x in (df.coalesce(1), df.repartition(9)))
    assert a == b
    nodes = spark.createDataFrame([(k, 10, k * 7919) for k in range(400)], "node long, size long, tie long")
    members = spark.createDataFrame([(k, k // 10) for k in range(400)], "node long, group int")
    state = sharding.propagate(nodes, members)
    spread = nodes.select("node", F.pmod("node", F.lit(8)).alias("shard"))
    after, before = sharding.cut_links(state, members).collect()[0], sharding.cut_links(spread, members).collect()[0]
    assert after.links == before.links == 40 * 45 and before.cut > 1400 and after.cut < before.cut / 2


def test_mixing_splits_rows_of_one_id(spark):
    """Null and repeated ids share their hash; the boundary falls between such rows, not before or after them all."""
    rng = random.Random(32)
    rows = [(None if k % 3 else 7, text(rng, 50), "a") for k in range(200)] + [(1000 + k, text(rng, 50), "b") for k in range(100)]
    got = mixing.mix(frame(spark, rows), weights=(1, 2), cap=3.0).collect()
    for s in ("a", "b"):
        mine = [r for r in got if (r.target, r.source_size) == next((x.target, x.source_size) for x in got if x.source_size == (10000 if s == "a" else 5000))]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 50


def test_length_partitions_hold_the_threshold():
    for t in (0.8, 0.85, 1 / 3, 0.5, 0.9):
        starts = spotsigs.length_parts(t, 1000)
        part = lambda n: sum(s <= n for s in starts)
        for n in range(1, 700):
            m = n
            while n >= t * m - 1e-12:
                assert part(m) - part(n) in (0, 1)
                m += 1
