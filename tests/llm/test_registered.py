"""Queries without SQL, as registered, over a whole table, against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronolith.llm import quality, queries
from chronolith.llm.runtime import table

from .test_text_operators import brute_spans

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF_DIR, "documents").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def rows(spark, name):
    got = queries.queries()[name](spark, SF_DIR).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(by_id) == len(got)
    return by_id


def little(ids):
    return np.array(ids, "<u4").tobytes()


def test_bpe(spark, docs, tokenizer):
    got = rows(spark, "op2_bpe")
    assert got.keys() == docs.keys()
    for k, t in docs.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(little(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_spotsigs(spark, docs):
    got, order = rows(spark, "op3_spotsigs"), sorted(docs, reverse=True)
    assert got.keys() == docs.keys()
    parts = lambda f: {f[k : k + 8] for k in range(0, len(f), 8)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    of_text = defaultdict(set)
    for place, k in enumerate(order):
        t, after, r = docs[k], order[(place + 1) % len(order)], got[k]
        half = len(t) // 2
        edited = t[: len(t) - half] + docs[after][:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(parts(r.fingerprint), parts(r.edited_fingerprint))) and r.near_next == pytest.approx(like(parts(r.fingerprint), parts(got[after].fingerprint)))
        of_text[t].add(r.fingerprint)
    assert all(len(f) == 1 for f in of_text.values())


def test_sharding(spark, docs):
    got = rows(spark, "op4_sharding")
    assert got.keys() == docs.keys()
    load, slots, count = Counter(), defaultdict(list), Counter(docs.values())
    for k, t in docs.items():
        r, raw = got[k], t.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 8
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load[k] for k in range(8)) <= 2 * max(len(t.encode()) + 1 for t in docs.values())
    # copies that fit beside each other are together more often than chance would have it
    pairs = kept = 0
    for t, n in count.items():
        if n > 1:
            in_shard = Counter(got[k].shard for k in docs if docs[k] == t)
            pairs, kept = pairs + n * (n - 1) // 2, kept + sum(m * (m - 1) // 2 for m in in_shard.values())
    assert not pairs or kept / pairs > 0.5


def test_personal_data(spark, docs):
    got = rows(spark, "op5_pii")
    assert got.keys() == docs.keys()
    for k, t in docs.items():
        base, r = brute_spans(t), got[k]
        kinds = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[x] for x in ("email", "ip", "card", "phone"))
        spans = [x for x in r.spans.split(",") if x]
        assert {x for x in base.split(",") if x} <= {*spans} and len(spans) == r.n_spans


def test_token_files(spark, docs, tokenizer):
    got, start = rows(spark, "op7_token_orc"), 0
    assert got.keys() == docs.keys()
    for k in sorted(docs):
        ids = [*tokenizer.encode(docs[k], add_special_tokens=False).ids, 1]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(little(ids)))
        start += len(ids)


def test_quality(spark, docs):
    got = rows(spark, "op9_quality")
    labels = {r.doc_id: r.quality for r in table(spark, SF_DIR, "labels").collect()}
    assert got.keys() == docs.keys()
    known = table(spark, SF_DIR, "labels").where(~quality.held_out(F.col("doc_id")))
    weights, bias = quality.train(table(spark, SF_DIR, "documents"), known)
    hits = []
    for k, t in docs.items():
        r, raw = got[k], np.frombuffer(t.encode(), np.uint8)
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
        bucket, share = quality.rows(raw, np.array([0, len(raw)]))[0]
        assert r.score == pytest.approx(1 / (1 + np.exp(-(weights[bucket] @ share + bias))), abs=1e-4)
        if r.held_out and k in labels:
            hits.append(r.predicted == labels[k])
    assert not hits or np.mean(hits) > 0.9


def test_masked_lm(spark, docs):
    got = rows(spark, "op10_masked_lm")
    assert got.keys() == docs.keys()
    same = defaultdict(set)
    for k, t in docs.items():
        same[t].add(round(got[k].pseudo_log_likelihood, 1))
        assert (got[k].pseudo_log_likelihood < 0) == (got[k].n_words > 0)
    assert sum(len(x) > 1 for x in same.values()) == 0
