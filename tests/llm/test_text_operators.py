"""Operators that take one text at a time, against plain Python."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronolith.llm import bpe, jaccard_join, pii, repetition, token_orc
from chronolith.llm import textkernel as K

from .cases import SCHEMA, documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def keyed(df):
    """Rows by id; repeated rows must agree."""
    out = {}
    for r in df.collect():
        assert out.setdefault(r.doc_id, r) == r
    return out


def twins(n=1024):
    """Two words of n letters that agree under any polynomial hash modulo a power of two (n from 1024 on)."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark, tokenizer):
    a, b = twins()
    assert K.range_hash(np.frombuffer((a + b).encode(), np.uint8), np.array([0, 1024]), np.array([1024, 2048])).tolist()[0] != 0
    rows = [(1, f"{a} {b}", "s"), (2, a, "s"), (3, b, "s"), (4, f"{a}\n{b}\n{a}", "s"), (5, f"{b} {a} {a}", "s")]
    df = frame(spark, rows).coalesce(1)
    got = keyed(repetition.repetition_coverage(df))
    assert [got[k].n_dup_lines for k in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 0]
    ids = {k: tokenizer.encode(t, add_special_tokens=False).ids for k, t, _ in rows}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode_texts(df, VOCABULARY, keep=["doc_id"]).collect()} == ids
    assert {r.doc_id: r.ids[:-1] for r in token_orc.encode(df, VOCABULARY).collect()} == ids
    linked = {r.doc_id: r.component_id for r in jaccard_join.link_components(df).collect()}
    assert linked == {k: k for k in (1, 2, 3, 4, 5)}


def covered(words, n):
    grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    inside = {i + j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(n)}
    return len(inside), sum(len(words[i]) for i in inside)


def test_repetition_equals_brute_force(spark):
    rows = [*documents(), (200, "a b c\na b c\n\nd # $ a b c", "s"), (201, "w1 w2 w3 w4 w5 w6 w7 w8 " * 5, "s"), (202, "aa " * 40, "s")]
    got = keyed(repetition.repetition_coverage(frame(spark, rows, ("n_words", "kept", "extra"))))
    assert len(got) == len({r[0] for r in rows})
    for k, t, _ in rows:
        t = t or ""
        w, r = WORD.findall(t), got[k]
        seen, dup, dup_chars = set(), 0, 0
        for line in t.split("\n"):
            if WORD.search(line):
                if line in seen:
                    dup, dup_chars = dup + 1, dup_chars + sum(map(len, WORD.findall(line)))
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.dup_line_chars) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, dup_chars)
        assert r.n_repeat_words == covered(w, 8)[0] and all(r[f"dup_chars_{n}"] == covered(w, n)[1] for n in repetition.NGRAM_PERCENT)
        assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w)) and (not r.kept or not r.base_failed)
    assert not got[201].kept and not got[103].kept and got[0].kept


def test_repetition_of_nothing(spark):
    df = repetition.repetition_coverage(frame(spark, []))
    assert df.count() == 0 and df.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_bpe_equals_the_library(spark, tokenizer):
    rows = [*documents(), (200, "Hello <|endoftext|>World's İstanbul Σίσυφος <|startoftext|", "s"), (201, "a" * 300 + " 12:30 don't I'LL", "s")]
    got = keyed(bpe.round_trip(frame(spark, rows, ("ids_sha256",)), VOCABULARY))
    encoded = bpe.encode_texts(frame(spark, rows, ("ids",)), VOCABULARY)
    back = {r.doc_id: r.decoded for r in bpe.decode_ids(encoded, VOCABULARY).collect()}
    for k, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest() and back[k] == decoded
    assert bpe.round_trip(frame(spark, []), VOCABULARY).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    with open(VOCABULARY, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


@settings(max_examples=300, deadline=None)
@given(t=st.text(alphabet=st.sampled_from("aehilnorst'dvm 019.,!?éßñ\n\t<|>#") , max_size=60) | st.text(max_size=30))
def test_any_text_encodes_as_in_the_library(t, vocabulary, tokenizer):
    t = t.encode("utf-8", "replace").decode()
    assert vocabulary.encode(t.encode()).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_token_files(spark, tokenizer, tmp_path):
    rows = documents()
    path = str(tmp_path / "orc")
    got = token_orc.token_files(frame(spark, rows, ("start", "n_tokens")), VOCABULARY, path, files=3).collect()
    assert len(got) == len(rows)
    start = 0
    texts = {k: t for k, t, _ in rows}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        ids = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id for r in token_orc.lookup(spark, path, [5, 104]).collect()} == {5, 104}
    assert token_orc.token_files(frame(spark, []), VOCABULARY).count() == 0


PERSONAL = [
    "mail bob.smith+x@mail.example.com now, or host 10.0.0.255 and 10.0.0.256",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 call +1 (415) 555-0100.",
    'token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" end',
    "Version 2.0 of 2024-05-06, 3.14 and 1,234,567 at 12:30",
]


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_personal_data(spark):
    rows = [*documents(), *[(200 + k, t, "s") for k, t in enumerate(PERSONAL)], (210, "é☃ " + PERSONAL[0], "s")]
    got = keyed(pii.find_all(frame(spark, rows, ("spans", "n_ip"))))
    for k, t, _ in rows:
        base = brute_spans(t or "")
        assert got[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert {*filter(None, base.split(","))} <= {*got[k].spans.split(",")}
    assert (got[200].n_email, got[200].n_ip, got[201].n_card, got[201].n_phone) == (1, 1, 1, 1)
    a = PERSONAL[2].index("0a1b")
    assert got[202].spans == f"secret:{a}:{a + 40}" and got[203].spans == "" and got[0].spans == ""
    clean = {r.doc_id: r for r in pii.redact_all(frame(spark, rows).selectExpr("*", "length(text) AS n_chars")).collect()}
    assert "[EMAIL]" in clean[200].text and "[SECRET]" in clean[202].text and clean[103].text is None and clean[0].text == dict((r[0], r[1]) for r in rows)[0]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean.values())


def test_segmentation_is_learnt():
    w = pii.weights()
    rng = np.random.default_rng(123)
    hit = wrong = missed = 0
    for _ in range(300):
        t, gold = pii.sample_text(rng)
        got = {*pii.find(t, w)[1]}
        hit, wrong, missed = hit + len(got & {*gold}), wrong + len(got - {*gold}), missed + len({*gold} - got)
    assert hit / (hit + missed) > 0.75 and hit / (hit + wrong) > 0.85


def test_spans_of_all_forms_are_candidates():
    """Each form within plain words: it is a segment of the lattice, and the trained model finds it."""
    jwt = "eyJhbGciOiJIUzI1NiJ9." + "ab0Cd1" * 25 + "." + "x9Yz_3" * 10
    forms = {
        "email": ["harold @ site.com", "john12 at site dot com"],
        "iban": ["GB82 WEST 1234 5698 7654 32", "NL91 ABNA 0417 1643 00", "FR14 2004 1010 0505 0001 3M02 606", "IT60 X054 2811 1010 0000 0123 456", "PL61 1090 1014 0000 0712 1981 2874"],
        "secret": [jwt],
    }
    cases = [(k, f, "please note that ", " and then go home") for k, of in forms.items() for f in of]
    cases += [("phone", "555-123-4567", "please note tel:", " and then"), ("ssn", "123-45-6789", "please note ssn=", " and then")]
    w, missed = pii.weights(), []
    for kind, form, left, right in cases:
        t, span = left + form + right, (len(left), len(left) + len(form))
        assert any(span == s[2:] for run in pii.runs(t) for s in pii.lattice(t, run, pii.base_spans(t))[0]), form
        if (pii.KINDS.index(kind), *span) not in pii.find(t, w)[1]:
            missed.append((form, pii.spelled(pii.find(t, w)[1])))
    assert not missed


def test_kinds_and_boundaries_are_chosen_together():
    """Against all labellings: the weights of steps from label to label change what is best."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        n, kinds = 4, 2
        segments = [(i, j, i, j) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.6]
        scores, steps = rng.normal(size=(len(segments), kinds)), rng.normal(size=(kinds + 1, kinds + 1))

        def best(at, label):
            if at == n:
                return 0.0, ()
            value, rest = best(at + 1, kinds)
            found = [(value + steps[label, kinds], rest)]
            for k, s in enumerate(segments):
                if s[0] == at:
                    for y in range(kinds):
                        value, rest = best(s[1], y)
                        found.append((value + steps[label, y] + scores[k, y] - pii.MARGIN, ((y, s[2], s[3]), *rest)))
            return max(found)

        assert tuple(pii.decode(n, segments, scores, steps)) == best(0, kinds)[1]
        if segments:
            chance, pairs = pii.expected(n, segments, np.pad(scores, ((0, 0), (0, len(pii.KINDS) - kinds)), constant_values=-50), np.pad(steps[:kinds, :kinds], ((0, len(pii.KINDS) + 1 - kinds),) * 2))
            inside = sum(chance[k].sum() * (s[1] - s[0]) for k, s in enumerate(segments))
            assert 0 <= inside <= n + 1e-9 and abs(pairs.sum() - (chance.sum() + n - inside)) < 1e-6


def test_long_tokens_take_linear_time():
    """A million characters in tokens of one kind, and spans that follow them; fewer where each is a candidate with its neighbours."""
    model = pii.weights()
    for filler in ("7", "a", "a.", "1.", "@", "a@", "+1", "at.", "x-", "=", "a dot ", "1 ", "A1="):
        t = filler * ((100_000 if filler in ("1 ", "A1=") else 1_000_000) // len(filler)) + " mail ann.lee@site.example.org"
        began = time.process_time()
        base, every = pii.find(t, model)
        assert time.process_time() - began < 60 and any(k == 0 and e == len(t) for k, _, e in base) and {*base} <= {*every}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.@-+ ()%_0é", max_size=60))
def test_base_spans_equal_the_patterns(t):
    got = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(t))
    assert got == brute_spans(t)


def test_decoding_takes_the_best_segmentation():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = 5
        segments = [(i, j, i, j) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.7]
        scores = rng.normal(size=(len(segments), 2))

        def best(at):
            if at == n:
                return 0.0
            return max([best(at + 1), *(scores[k].max() - pii.MARGIN + best(s[1]) for k, s in enumerate(segments) if s[0] == at)])

        value = {(s[2], s[3]): scores[k].max() - pii.MARGIN for k, s in enumerate(segments)}
        assert abs(sum(value[a, b] for _, a, b in pii.decode(n, segments, scores)) - best(0)) < 1e-9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t☃", max_size=20), max_size=8))
def test_words_of_a_batch(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    w = K.words(data, offsets)
    want = [(i, x.encode()) for i, t in enumerate(texts) for x in WORD.findall(t)]
    assert [(int(d), data[a:b].tobytes()) for d, a, b in zip(w.doc, w.start, w.end, strict=True)] == want
    h = K.range_hash(data, w.start, w.end)
    assert len({int(x) for x in h}) == len({x for _, x in want})
