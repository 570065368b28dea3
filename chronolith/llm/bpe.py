"""Byte-pair encoding and decoding with a public vocabulary, exact and in linear time.

Encoder: an Aho-Corasick automaton over the reversed tokens finds, in one pass, the longest token that starts at each place
of a word. The encoder takes the longest token, checks it against the token before it in a pair-compatibility table (would
the merges, in their order, keep this border?), falls back to the next shorter token, and steps back when none fits. The
result equals that of applying the merges one by one. Decoder: token texts stand in one buffer; ids index a table of offsets.

The vocabulary file (tokenizers' JSON, kind BPE with word ends) is read on the driver and broadcast, a few MB whatever the
data. Words, split at ASCII white space, are encoded once a worker and remembered up to a bound. One pass over Arrow batches,
no shuffle, 2 MB of text at a time.

Nulls and empty texts have no tokens; special tokens' strings in a text become those tokens; repeated rows get equal rows.
Input columns with the names of the results are not read.
"""

from __future__ import annotations

import json
import unicodedata
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .runtime import map_text, tidy
from .wordtable import WordTable, joined

END = ""  # stands for the mark of a word's end inside the automaton
NONE = -1
#: From this code point on, words are normalised and split by the library.
WIDE = "\u0250"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for b in range(256):
        letters.append(chr(b) if b in shown else chr(free))
        free += b not in shown
    return letters


#: Words that a worker remembers, with their ids.
WORDS = 1_000_000


class Vocabulary:
    def __init__(self, text: str):
        self.spec, self.library = text, None
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        own = {t: (t.removesuffix(self.suffix) + END if t.endswith(self.suffix) and t != self.suffix else t) for t in vocab}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.letters = byte_letters()
        size = max([*vocab.values(), *self.specials.values()]) + 1
        # merges in order: rank, and the two halves of the token that each makes
        self.merged: dict[tuple[int, int], int] = {}
        self.rank, self.left, self.right = [NONE] * size, [NONE] * size, [NONE] * size
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j = vocab[a], vocab[b]
            whole = vocab[a.removesuffix(self.suffix) + b] if a.endswith(self.suffix) else vocab[a + b]
            self.merged[i, j] = k
            if self.rank[whole] == NONE:
                self.rank[whole], self.left[whole], self.right[whole] = k, i, j
        self.text = [""] * size
        self.size = [0] * size
        backward, by_text = ahocorasick.Automaton(), {}
        for t, i in vocab.items():
            self.text[i], self.size[i] = t, len(own[t])
            backward.add_word(own[t][::-1], i)
            by_text[own[t]] = i
        backward.make_automaton()
        self.backward = backward
        # the longest token that is a proper prefix of each token
        self.shorter = [NONE] * size
        for t, i in by_text.items():
            self.shorter[i] = next((by_text[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_text), NONE)
        for t, i in self.specials.items():
            self.text[i] = t
        spelled = [(t + " ").encode() for t in self.text]
        self.lengths = np.array([len(t) for t in spelled], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.fits: dict[tuple[int, int], bool] = {}
        self.table = WordTable(lambda words: joined([self.word(w) for w in words]), WORDS)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between tokens a and b: undo merges at the border, the latest first, and see
        whether a merge across it would have come before the one undone."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        first, second, rank = a, b, self.rank
        before, strict = len(self.merged) + 1, True  # a merge across the border counts if its rank is under `before`
        answer = True
        while True:
            across = self.merged.get((first, second), NONE)
            if across != NONE and (across < before if strict else across <= before):
                answer = False
                break
            if rank[first] > rank[second]:
                before, strict, first = rank[first], True, self.right[first]
            elif rank[second] != NONE:
                # merges go from left to right: one across the border that ties with the right token's own comes first
                before, strict, second = rank[second], False, self.left[second]
            elif rank[first] != NONE:
                before, strict, first = rank[first], True, self.right[first]
            else:
                break
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[a, b] = answer
        return answer

    def merge(self, word: str) -> list[int]:
        """Tokens of one word in byte letters, its end marked."""
        n = len(word)
        longest = [NONE] * (n + 1)
        for end, token in self.backward.iter(word[::-1]):
            at = n - 1 - end  # tokens that end here backwards begin here forwards; the longest comes first
            if longest[at] == NONE or self.size[token] > self.size[longest[at]]:
                longest[at] = token
        tokens: list[int] = []
        open_at, at, token = [True] * (n + 1), 0, longest[0]
        while at < n:
            last = tokens[-1] if tokens else NONE
            while token != NONE and not (open_at[at + self.size[token]] and (last == NONE or self.compatible(last, token))):
                token = self.shorter[token]
            if token != NONE:
                tokens.append(token)
                at += self.size[token]
                token = longest[at]
            elif tokens:
                open_at[at] = False
                token = tokens.pop()
                at -= self.size[token]
            else:
                raise ValueError("a text has a byte that the vocabulary lacks")
        return tokens

    def plain(self, text: str) -> list[int]:
        out: list[int] = []
        if not text.isascii() and max(text) >= WIDE:
            # which characters are letters or digits there differs between versions of Unicode: the library's own says
            if self.library is None:
                self.library = Tokenizer.from_str(self.spec)
            for match, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
                out += self.merge(match + END)
            return out
        text = text.lower() if text.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", text))
        for match in self.pattern.findall(text):
            letters = [self.letters[b] for b in match.encode()]
            out += self.merge("".join(letters) + END)
        return out

    def word(self, raw: bytes) -> list[int]:
        text, ids = raw.decode("utf-8", "replace"), []
        if self.special and "<|" in text:
            for part in self.special.split(text):
                ids += [self.specials[part]] if part in self.specials else self.plain(part)
        else:
            ids = self.plain(text)
        return ids

    def encode(self, text: bytes) -> np.ndarray:
        return self.table.ids(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, a space after each."""
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        at = np.cumsum(lengths)
        total = int(at[-1]) if len(at) else 0
        return self.spelled[np.repeat(self.offsets[ids] - at + lengths, lengths) + np.arange(total)]


_loaded: dict[str, Vocabulary] = {}


def loaded(text: str) -> Vocabulary:
    """One vocabulary a worker."""
    key = sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def broadcast_file(spark, path: str):
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_texts(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default), n_tokens (long) and ids (binary: little-endian unsigned 32-bit integers)."""
    shared = broadcast_file(df.sparkSession, vocabulary)

    def make():
        v = loaded(shared.value)

        def kernel(data, offsets):
            ids, at = v.table.ids(data, offsets)
            raw = ids.astype("<u4").tobytes()
            return [np.diff(at), pa.array([raw[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())]

        return kernel

    return map_text(df, text_col, {"n_tokens": "bigint", "ids": "binary"}, make, df.columns if keep is None else keep)


def decode_ids(df: DataFrame, vocabulary: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and decoded (string): token texts joined by spaces; null ids give an empty text."""
    shared = broadcast_file(df.sparkSession, vocabulary)
    keep = [c for c in (df.columns if keep is None else keep) if c != "decoded"]

    def run(batches):
        v = loaded(shared.value)
        for batch in batches:
            texts = [v.decode(np.frombuffer(x or b"", "<u4"))[:-1].tobytes().decode() for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "decoded"])

    source = df.select(*[df[c] for c in keep], df[ids_col].alias("__ids"))
    return source.mapInArrow(tidy(run), source.drop("__ids").schema.add("decoded", "string"))


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256: encoding and decoding in one pass, with digests of both."""
    shared = broadcast_file(df.sparkSession, vocabulary)

    def make():
        v = loaded(shared.value)

        def kernel(data, offsets):
            every, at = v.table.ids(data, offsets)
            raw, text = memoryview(every.astype("<u4").tobytes()), v.decode(every)
            ends = np.concatenate([[0], np.cumsum(v.lengths[every])])[at]
            decoded = [sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            return [np.diff(at), [sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], decoded]

        return kernel

    return map_text(df, text_col, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, make, [id_col])
