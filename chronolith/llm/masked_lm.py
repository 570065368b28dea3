"""Language-model scoring by masked pseudo-likelihood: a bidirectional window network, trained in numpy.

The network predicts every word from the two words on each side of it. Each context place has its own embedding table; their
sum goes through tanh into a softmax in two steps, first the word's class, then the word in its class. A text's score is the
sum of the log-probabilities of its words, each given its real neighbours.

Symbols are the most frequent words of the corpus, counted exactly over all texts, and buckets by ending and length for the
others; sorted by frequency and cut into equal classes. The network gives a bucket's mass; a word in it gets its share of that by
the exact counts of all words: those of the KNOWN most frequent are broadcast, all others joined to the texts' words (a table as long
as the vocabulary, never collected). What is left of a
bucket, as much as one occurrence, is dealt among one more unseen word than it has seen ones. Output biases start at the corpus log-frequencies, so an untrained
network is the corpus unigram model. Texts are dealt by their hash and id into shards of about SHARD words, sorted by hash; one network
a shard trains on every place of its texts (on one in STRIDE, where that is more than 1) from the same start, and the networks are
averaged by their number of places. So the model depends on the rows, not on their files or partitions; data, counts and
what is gathered grow with the corpus, a task's memory and the model (about 2 MB, broadcast) don't. Partial sums are reduced in two
levels, so no task takes more than about the square root of the number of shards of models.

Nulls and empty texts have 0 words, a score of 0 and a null mean; repeated rows get equal rows; an empty table gives none.
Input columns with the names of the results are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .runtime import map_text, pieces, raw_text, staged, tidy

CLASSES, MEMBERS, BUCKETS = 64, 64, 256
SYMBOLS = CLASSES * MEMBERS
DIM, PLACES, STRIDE, BATCH, RATE, SEED = 24, (-2, -1, 1, 2), 1, 4096, 0.15, 3
#: Words that one network trains on, about.
SHARD = 2_000_000
CHUNK = 1 << 13
#: Words of buckets whose counts are broadcast at most (16 bytes each), the most frequent ones; those of all others are joined.
KNOWN = 500_000
NANO = 1_000_000_000  # logarithms are added as integers, so that their sum doesn't depend on the order


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, bucket and text of each word, A to Z in lower case."""
    data = K.lower_ascii(data)
    w = K.words(data, offsets)
    h = K.range_hash(data, w.start, w.end) >> K.U(1)
    if not len(h):
        return h.astype(np.int64), np.empty(0, np.int64), w.doc
    length = w.end - w.start
    tail = data[w.end - 1].astype(np.int64) * 256 + np.where(length > 1, data[np.maximum(w.end - 2, 0)], 0)
    return h.astype(np.int64), (tail * 31 + np.minimum(length, 12)) % BUCKETS, w.doc


class Symbols:
    def __init__(self, hashes: np.ndarray, ids: np.ndarray, buckets: np.ndarray, unseen: np.ndarray, often: np.ndarray | None = None, gain: np.ndarray | None = None):
        """unseen: for each bucket, the logarithm of the share of it that an unseen word gets; often and gain: frequent words in order,
        and by how much each is above an unseen one (in NANO)."""
        self.hashes, self.ids, self.buckets = hashes, ids, buckets
        self.often, self.gain = (np.empty(0, np.int64), np.empty(0, np.int64)) if often is None else (often, gain)
        self.unseen = np.full(SYMBOLS, np.nan)
        self.unseen[buckets] = unseen

    def of(self, h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return self.buckets[bucket]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], self.buckets[bucket])


    def gains(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gain of each word, and whether it is known here (0 where not)."""
        if not len(self.often):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.often, h), len(self.often) - 1)
        known = self.often[at] == h
        return np.where(known, self.gain[at], 0), known


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """word (hash), bucket and n over all texts."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch, 0):
                h, bucket, _ = hashed(*raw_text(piece.column(0)))
                held.append((h, bucket))
                size += len(h)
                if size > 2_000_000:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    def counted(held):
        h, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
        word, first, n = np.unique(h, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(bucket[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "bucket", "n"])

    part = df.select(df[text_col].cast("string").alias("text")).mapInArrow(tidy(run), "word bigint, bucket int, n bigint")
    return part.groupBy("word").agg(F.first("bucket").alias("bucket"), F.sum("n").alias("n"))


def symbols(df: DataFrame, text_col: str) -> tuple[Symbols, np.ndarray, DataFrame]:
    """The symbols, the corpus count of each plus one, and gains of the words that aren't known to the symbols: by how much a word of a
    bucket is above an unseen one (in NANO)."""
    words = staged(count_words(df, text_col), "words")
    top = words.orderBy(F.desc("n"), "word").limit(SYMBOLS - BUCKETS).toPandas()  # the vocabulary: a fixed number of rows
    rest, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in words.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():  # a row a bucket
        rest[r.bucket], kinds[r.bucket] = r.n, r.kinds
    in_top = top["bucket"].to_numpy(np.int64)
    rest -= np.bincount(in_top, top["n"].to_numpy(np.float64), BUCKETS)
    kinds -= np.bincount(in_top, minlength=BUCKETS)
    n = np.concatenate([top["n"].to_numpy(np.float64), rest, np.zeros(SYMBOLS - BUCKETS - len(top))])
    rank = np.empty(SYMBOLS, np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(SYMBOLS)
    counts = np.empty(SYMBOLS)
    counts[rank] = n
    h = top["word"].to_numpy(np.int64)
    order = np.argsort(h)
    more = df.sparkSession.createDataFrame([(b, float(np.log(k + 1))) for b, k in enumerate(kinds)], "bucket int, more double")
    gain = F.round((F.log("n") + F.col("more")) * NANO).cast("bigint")
    gains = words.join(F.broadcast(more), "bucket").select("word", "n", gain.alias("gain"))
    level, seen = 1 << 62, 0
    for r in sorted(words.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("kinds")).collect(), reverse=True):  # at most 63 rows
        seen += r.kinds
        if seen > KNOWN:
            break
        level = 1 << r.k
    often = gains.where(F.col("n") >= level).select("word", "gain").toArrow().sort_by("word")  # KNOWN rows at most
    gains = gains.where(F.col("n") < level).select("word", "gain")
    unseen = -np.log(rest + 1) - np.log(kinds + 1)
    return Symbols(h[order], rank[: len(h)][order], rank[len(h) : len(h) + BUCKETS], unseen, often["word"].to_numpy(), often["gain"].to_numpy()), counts + 1, gains


class Network:
    def __init__(self, counts: np.ndarray):
        rng = np.random.default_rng(SEED)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        by_class = counts.reshape(CLASSES, MEMBERS)
        self.table = small(len(PLACES), SYMBOLS + 1, DIM)
        self.shift = np.zeros(DIM, np.float32)
        self.wc, self.bc = small(DIM, CLASSES), np.log(by_class.sum(1) / counts.sum()).astype(np.float32)
        self.wm, self.bm = small(CLASSES, DIM, MEMBERS), np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.shift, self.wc, self.bc, self.wm, self.bm]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def hidden(self, context: np.ndarray) -> np.ndarray:
        z = self.table[0][context[:, 0]]
        for k in range(1, len(PLACES)):
            z += self.table[k][context[:, k]]
        z += self.shift
        return np.tanh(z, out=z)

    def members(self, h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Logits inside the class, of rows in order of class; cuts: where each class begins."""
        z = np.empty((len(h), MEMBERS), np.float32)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            i, j = cuts[k], cuts[k + 1]
            np.matmul(h[i:j], self.wm[k], out=z[i:j])
            z[i:j] += self.bm[k]
        return z

    def log_probability(self, symbol: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Of each symbol given its context. Logits are sums of DIM products of small weights and values within 1, so that their
        exponentials need no shift."""
        out = np.empty(len(symbol))
        for a in range(0, len(symbol), CHUNK):
            s = symbol[a : a + CHUNK]
            order = np.sort(s * len(s) + np.arange(len(s))) % len(s)
            s, h, at = s[order], self.hidden(context[a : a + CHUNK][order]), np.arange(len(s))
            cuts = np.searchsorted(s, np.arange(CLASSES + 1) * MEMBERS).tolist()
            z = h @ self.wc
            z += self.bc
            got = z[at, s // MEMBERS].astype(np.float64)
            got -= np.log(np.exp(z, out=z).sum(1))
            z = self.members(h, cuts)
            got += z[at, s % MEMBERS]
            got -= np.log(np.exp(z, out=z).sum(1))
            out[a + order] = got
        return out

    def step(self, symbol: np.ndarray, context: np.ndarray, rate: float) -> None:
        n, at = len(symbol), np.arange(len(symbol))
        order = np.sort(symbol * n + at) % n
        symbol, context = symbol[order], context[order]
        cuts = np.searchsorted(symbol, np.arange(CLASSES + 1) * MEMBERS).tolist()
        h = self.hidden(context)
        g = h @ self.wc
        g += self.bc
        np.exp(g, out=g)
        g /= g.sum(1, keepdims=True)
        g[at, symbol // MEMBERS] -= 1
        gh = g @ self.wc.T
        dwc, dbc = h.T @ g / n, g.mean(0)
        g = self.members(h, cuts)
        np.exp(g, out=g)
        g /= g.sum(1, keepdims=True)
        g[at, symbol % MEMBERS] -= 1
        inside, dwm = np.empty_like(gh), np.zeros_like(self.wm)
        sizes = np.diff(cuts)
        seen, turned = np.flatnonzero(sizes), h.T
        for k in seen.tolist():
            i, j = cuts[k], cuts[k + 1]
            np.matmul(g[i:j], self.wm[k].T, out=inside[i:j])
            np.matmul(turned[:, i:j], g[i:j], out=dwm[k])
        gh += inside
        part = (rate / np.maximum(sizes, 1)).astype(np.float32)
        self.wm -= dwm * part[:, None, None]
        self.bm[seen] -= np.add.reduceat(g, np.array(cuts)[seen], axis=0) * part[seen, None]
        self.wc -= rate * 4 * dwc
        self.bc -= rate * dbc
        gh *= np.float32(-rate) * (1 - h * h)
        self.shift += gh.mean(0)
        # each cell of the tables is changed once a batch, by the sum over its words
        cells = (context + np.arange(len(PLACES)) * (SYMBOLS + 1)).T.ravel()
        cells = np.sort(cells * n + np.tile(at, len(PLACES)))
        change = gh[cells % n]
        cells //= n
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        self.table.reshape(-1, DIM)[cells[first]] += np.add.reduceat(change, first, axis=0)


def windows(symbol: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Neighbours of each word at PLACES; outside the text, the border symbol."""
    n = len(symbol)
    context = np.full((n, len(PLACES)), SYMBOLS, np.int64)
    for k, p in enumerate(PLACES):
        to, of = (slice(-p, n), slice(0, n + p)) if p < 0 else (slice(0, n - p), slice(p, n))
        if n > abs(p):
            context[to, k] = np.where(doc[to] == doc[of], symbol[of], SYMBOLS)
    return context


def train(df: DataFrame, text_col: str = "text", id_col: str | None = None, shard: int = SHARD, stride: int = STRIDE) -> tuple[Symbols, np.ndarray, DataFrame]:
    """The symbols, the averaged network and the gains of words in buckets. id_col: spreads equal texts over the shards."""
    known, counts, gains = symbols(df, text_col)
    shared = df.sparkSession.sparkContext.broadcast((known, counts))
    shards = max(1, round(float(counts.sum() - SYMBOLS) / shard))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        known, counts = shared.value
        net, places, begun = Network(counts), 0, 0
        texts = rows.select(["tie", "text"]).sort_by("tie").select(["text"])
        for batch in texts.to_batches(max_chunksize=5000):
            for piece in pieces(batch, 0):
                h, bucket, doc = hashed(*raw_text(piece.column(0)))
                symbol = known.of(h, bucket)
                context = windows(symbol, doc)
                at = np.arange(begun % stride, len(symbol), stride)
                begun += 1
                for k in range(0, len(at), BATCH):
                    i = at[k : k + BATCH]
                    net.step(symbol[i], context[i], RATE)
                places += len(at)
        return pa.table({"part": [key[0].as_py()], "n": [places], "net": pa.array([net.flat().tobytes()], pa.binary())})

    def total(t: pa.Table) -> pa.Table:
        rows = sorted((p, n, i) for i, (p, n) in enumerate(zip(t.column("part").to_pylist(), t.column("n").to_pylist(), strict=True)))
        weight, mean = sum(n for _, n, _ in rows), 0.0
        for _, n, i in rows:
            mean = mean + np.frombuffer(t.column("net")[i].as_buffer(), np.float32) * (n / max(weight, 1) if weight else 1 / len(rows))
        return pa.table({"part": [rows[0][0]], "n": [weight], "net": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    tie = F.xxhash64(df[text_col])
    spread = F.xxhash64(df[text_col], df[id_col].cast("string")) if id_col else tie
    source = df.select(F.pmod(spread, F.lit(shards)).alias("part"), tie.alias("tie"), df[text_col].cast("string").alias("text"))
    kind = "part bigint, n bigint, net binary"
    nets = source.groupBy("part").applyInArrow(run, kind)
    few = max(1, round(shards**0.5))
    some = nets.groupBy(F.pmod("part", F.lit(few)).alias("g")).applyInArrow(total, kind)
    got = some.groupBy(F.lit(0).alias("g")).applyInArrow(total, kind).collect()
    net = Network(counts)
    return known, (net.load(np.frombuffer(got[0].net, np.float32)) if got else net).flat(), gains


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[Symbols, np.ndarray, DataFrame] | None = None) -> DataFrame:
    """id_col, n_words, pseudo_log_likelihood (natural logarithm) and mean_log_probability (by word)."""
    known, flat, gains = model or train(df, text_col, id_col=id_col)
    shared = df.sparkSession.sparkContext.broadcast((known, flat))

    def make():
        known, flat = shared.value
        net = Network(np.ones(SYMBOLS)).load(flat)

        def kernel(data, offsets):
            n = len(offsets) - 1
            h, bucket, doc = hashed(data, offsets)
            symbol = known.of(h, bucket)
            share = known.unseen[symbol]
            folded = ~np.isnan(share)
            logs = net.log_probability(symbol, windows(symbol, doc)) + np.where(folded, share, 0)
            w, d = h[folded], doc[folded]
            gain, is_known = known.gains(w)
            sure = np.bincount(d, gain, n).astype(np.int64)  # whole numbers under 2 ** 53: exact in any order
            w, d = w[~is_known], d[~is_known]
            order = np.lexsort((w, d))
            w, d = w[order], d[order]
            first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])])) if len(w) else np.empty(0, np.int64)
            ends = np.searchsorted(d[first], np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (w[first], np.diff(np.append(first, len(w))))]
            return [np.bincount(doc, minlength=n).astype(np.int64), np.bincount(doc, logs, n), *lists, sure]

        return kernel

    fields = {"n_words": "bigint", "pseudo_log_likelihood": "double", "mean_log_probability": "array<bigint>", "__times": "array<bigint>", "__sure": "bigint"}
    rows = map_text(df, text_col, fields, make, [id_col]).withColumnRenamed("mean_log_probability", "__words")
    rows = staged(rows.withColumn("__row", F.monotonically_increasing_id()), "scored")
    each = rows.select("__row", F.explode(F.arrays_zip("__words", "__times")).alias("w")).select("__row", F.col("w.__words").alias("word"), F.col("w.__times").alias("times"))
    gained = each.join(gains, "word").groupBy("__row").agg((F.sum(F.col("times") * F.col("gain")) / NANO).alias("__gain"))
    total = F.col("pseudo_log_likelihood") + F.col("__sure") / NANO + F.coalesce("__gain", F.lit(0.0))
    mean = F.when(F.col("n_words") > 0, F.round(total / F.col("n_words"), 6))
    kept = [c for c in rows.columns if not c.startswith("__") and c not in ("n_words", "pseudo_log_likelihood")]
    return rows.join(gained, "__row", "left").select(*kept, "n_words", F.round(total, 4).alias("pseudo_log_likelihood"), mean.alias("mean_log_probability"))
