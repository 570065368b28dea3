"""Quality classifier by supervised subword embeddings, in numpy.

A text is the mean of learned vectors of its words, of their character n-grams and of the pairs of neighbouring words (told
apart only by whether both are equal), all hashed into one table; a linear layer
and a softmax give the probability of each class. Training is stochastic gradient descent over small batches. As the layers
are linear until the softmax, scoring needs one number a bucket and class pair: the table times the output weights.

Training reads a bounded sample of the labelled rows (``sample``, by hash of the id, so the same at every run) as whole texts,
on one executor; scoring is one pass over Arrow batches without a shuffle. The trained numbers are broadcast: buckets * 8 bytes,
a fixed size.

Nulls and empty texts have no features and get the score of the bias alone; repeated rows get equal scores; without labelled
rows every score is 0.5. Input columns with the names of the results are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .runtime import map_text, raw_text, tidy

BUCKET_BITS, NGRAMS = 18, (3, 4)
DIM, EPOCHS, BATCH, RATE, SEED = 8, 8, 64, 0.05, 7
#: Labelled rows that training reads at most. More add little accuracy; the bound keeps training on one executor.
SAMPLE = 6000


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BUCKET_BITS, ngrams: tuple[int, ...] = NGRAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the batch with their feature buckets, and the words of each text.

    Returns (bucket, owner): the buckets of distinct word owner; (which, doc): the distinct word and text of each word; and
    the number of buckets of each distinct word. A word's features are itself and its byte n-grams with both its borders.
    """
    w = K.words(data, offsets)
    h = K.range_hash(data, w.start, w.end)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    start, end = w.start[first], w.end[first]
    length = end - start
    mask = K.U((1 << bits) - 1)
    bucket, owner = [h[first] & mask], [np.arange(len(first))]
    for n in ngrams:
        count = np.maximum(length + 2 - n + 1, 0)  # one border before and one after the word
        who = np.repeat(np.arange(len(first)), count)
        k = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        a = np.maximum(start[who] + k - 1, start[who])
        b = np.minimum(start[who] + k - 1 + n, end[who])
        edge = (k == 0).astype(K.U) + K.U(2) * (k == count[who] - 1).astype(K.U)
        bucket.append(K.mix(K.range_hash(data, a, b) + edge * K.U(0x9FB21C651E98DF25) + K.U(n)) & mask)
        owner.append(who)
    bucket, owner = np.concatenate(bucket).astype(np.int64), np.concatenate(owner)
    return bucket, owner, which, w.doc, np.bincount(owner, minlength=len(first))


#: Buckets of their own, behind the hashed ones: a pair of neighbouring words that differ, and one whose words are equal.
PAIRS = (1 << BUCKET_BITS) + np.arange(2)
SIZE = (1 << BUCKET_BITS) + len(PAIRS)
#: A pair counts as much as so many n-grams, about those of a word.
PAIR_WEIGHT = 10


def pairs(which: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring words of each text: how many pairs differ, and how many are equal."""
    near = doc[1:] == doc[:-1]
    equal = near & (which[1:] == which[:-1])
    same = np.bincount(doc[1:][equal], minlength=n)
    return PAIR_WEIGHT * (np.bincount(doc[1:][near], minlength=n) - same), PAIR_WEIGHT * same


def rows(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares of all its features."""
    out = []
    for i in range(len(offsets) - 1):
        part = data[offsets[i] : offsets[i + 1]]
        bucket, owner, which, _, _ = features(part, np.array([0, len(part)]))
        times = np.bincount(which, minlength=owner.max() + 1 if len(owner) else 0)
        at, place = np.unique(np.concatenate([bucket, PAIRS]), return_inverse=True)
        total = np.bincount(place, np.concatenate([times[owner], *pairs(which, np.zeros(len(which), np.int64), 1)]))
        at, total = at[total > 0], total[total > 0]
        out.append((at.astype(np.int32), (total / max(total.sum(), 1)).astype(np.float32)))
    return out


def fit(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Logits of (class 1 less class 0) by bucket and the same of the bias: what scoring needs of the trained network."""
    rng = np.random.default_rng(seed)
    size = SIZE
    table = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    out, bias = rng.uniform(-1 / dim, 1 / dim, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    if not len(y):
        return np.zeros(size), np.zeros(1)
    weight = len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))  # both classes count alike
    seen, outer = np.zeros(size, np.float32), np.zeros((dim, 2), np.float32)
    steps, k = epochs * -(-len(y) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            ids = order[a : a + BATCH]
            lens = np.array([len(texts[i][0]) for i in ids])
            at, share = np.concatenate([texts[i][0] for i in ids]), np.concatenate([texts[i][1] for i in ids]).astype(np.float32)
            doc = np.repeat(np.arange(len(ids)), lens)
            mean = np.stack([np.bincount(doc, share * table[at, d], len(ids)) for d in range(dim)], 1).astype(np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ids)), y[ids]] -= 1
            g = p * weight[y[ids]][:, None].astype(np.float32)
            g /= len(ids)
            used, inverse = np.unique(at, return_inverse=True)
            pull = np.stack([np.bincount(inverse, share * g[doc, c], len(used)) for c in (0, 1)], 1).astype(np.float32) @ out.T
            slope = mean.T @ g
            # steps shrink with the squared slopes so far, for each bucket and for the output layer
            seen[used] += (pull**2).mean(1)
            outer += slope**2
            step = rate * (1 - k / steps)
            table[used] -= step * pull / np.sqrt(seen[used] + 1e-12)[:, None]
            out -= step * slope / np.sqrt(outer + 1e-12)
            bias -= step * g.sum(0)
            k += 1
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float64), np.array([float(bias[1] - bias[0])])


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights learnt from the labelled rows (label 0 or 1; others don't count), on one executor. Of rows that share an id, the one whose
    text has the least hash is read, with the least label."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("__y"))
    drawn = known.orderBy(F.xxhash64(F.col(id_col), F.lit("draw")), id_col).limit(sample)  # a top-k report, no sort of all
    chosen = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(drawn), id_col)
    chosen = chosen.groupBy(id_col).agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"), F.first("__y").alias("__y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts, y = [], [], []
        for batch in batches:
            if batch.num_rows:
                seen += batch.column(0).to_pylist()
                texts += rows(*raw_text(batch.column(1)))
                y += batch.column(2).to_pylist()
        order = sorted(range(len(y)), key=lambda i: (str(seen[i]), y[i], len(texts[i][0])))
        table, bias = fit([texts[i] for i in order], np.array([y[i] for i in order], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([float(bias[0])], pa.float64())], ["table", "bias"])

    got = chosen.repartition(1).mapInArrow(tidy(run), "table binary, bias double").collect()
    if not got:  # no labelled row: every score is 0.5
        return np.zeros(SIZE), 0.0
    return np.frombuffer(got[0].table, np.float64), got[0].bias


def score_fields(spark, weights: tuple[np.ndarray, float]):
    """make() for map_text: the score of each text."""
    shared = spark.sparkContext.broadcast(weights)

    def make():
        table, bias = shared.value

        def kernel(data, offsets):
            n = len(offsets) - 1
            bucket, owner, which, doc, count = features(data, offsets)
            total = np.bincount(owner, table[bucket], len(count)) if len(count) else np.zeros(0)
            differ, same = pairs(which, doc, n)
            z = np.bincount(doc, total[which], n) + table[PAIRS[0]] * differ + table[PAIRS[1]] * same
            z = z / np.maximum(np.bincount(doc, count[which], n) + differ + same, 1) + bias
            return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

        return kernel

    return make


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """id_col, held_out, score and predicted for every row. Rows with crc32(id as text) mod 3 = 1 are held out: their labels
    are never read."""
    weights = train(df, labels.where(~held_out(F.col(id_col))), id_col, text_col, label_col, sample)
    make_score = score_fields(df.sparkSession, weights)

    def make():
        score = make_score()

        def kernel(data, offsets):
            s = score(data, offsets)
            return [s, (s >= 0.5).astype(np.int32)]

        return kernel

    return map_text(df, text_col, {"score": "double", "predicted": "int"}, make, [id_col]).select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", "predicted")


def held_out(ids) -> F.Column:
    return F.crc32(ids.cast("string").cast("binary")) % 3 == 1


def keep_quality(df: DataFrame, labels: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The rows of df, all columns as they were, whose score is at least threshold."""
    weights = train(df, labels.where(~held_out(F.col(id_col))), id_col, text_col, label_col, sample)
    make_score = score_fields(df.sparkSession, weights)

    def make():
        score = make_score()
        return lambda data, offsets: [score(data, offsets) >= threshold]

    return map_text(df, text_col, {"__kept": "boolean"}, make, df.columns, kept="__kept")
