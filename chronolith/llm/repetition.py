"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, in numpy.

For each text: how many characters of its words lie inside word n-grams that the text holds twice or more, for each of
several n, and how many in lines that equal an earlier line. One pass over Arrow batches, no shuffle; a task holds one piece
of about 2 MB of text at a time, so memory doesn't depend on the size of the table.

Nulls and empty texts have no words and fail the base rule; repeated rows get equal rows; an empty table gives none. Input
columns with the names of the results are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import textkernel as K
from .runtime import map_text

#: n-gram length: the most percent of word characters inside repeated n-grams. A short clean text whose header comes back as
#: its footer reaches 25 percent; texts that are one passage over and over lie above 90.
NGRAM_PERCENT = {5: 40, 6: 38, 7: 36, 8: 34, 9: 32, 10: 30}
LINE_PERCENT = 30
MIN_WORDS, BASE_NGRAM, BASE_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"


def measures(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Long columns, one value a text: n_words, word_chars, n_symbols, n_dup_lines, dup_line_chars, and for each n
    dup_chars_n and dup_words_n."""
    n = len(offsets) - 1
    w = K.words(data, offsets)
    solid = K.running(K.letters(data) & ~K.SPACE[data])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = K.running(symbol[data])
    chars = solid[w.end] - solid[w.start]
    total = lambda doc, weight: np.bincount(doc, weight, n).astype(np.int64)
    out = {"n_words": w.count.astype(np.int64), "word_chars": np.diff(solid[offsets]), "n_symbols": np.diff(symbols[offsets])}

    breaks = np.flatnonzero(data == 10)
    per_doc = np.diff(np.searchsorted(breaks, offsets)) + 1
    start, end = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    doc = np.repeat(np.arange(n), per_doc)
    inside = solid[end] - solid[start]
    some = inside > 0
    start, end, doc, inside = start[some], end[some], doc[some], inside[some]
    _, later = K.repeated(K.mix(K.range_hash(data, start, end) ^ K.mix(doc.astype(K.U) + K.U(1))))
    out |= {"n_dup_lines": total(doc, later), "dup_line_chars": total(doc, later * inside)}

    h = K.range_hash(data, w.start, w.end)
    own = K.mix(w.doc.astype(K.U) + K.U(1))
    at = np.arange(len(h))
    for k in sorted(lengths):
        # a repeated window holds a repeated shorter window at its start: only those are looked at
        at = at[at + k <= len(h)]
        at = at[w.doc[at] == w.doc[at + k - 1]] if len(at) else at
        key, power = np.zeros(len(at), K.U), 1
        for j in range(k):
            key += h[at + j] * K.U(power)
            power = power * K.WINDOW % (1 << 64)
        twice, _ = K.repeated(K.mix(key) ^ own[at])
        at = at[twice]
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + k, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out |= {f"dup_words_{k}": total(w.doc, covered), f"dup_chars_{k}": total(w.doc, covered * chars)}
    return out


def verdicts(m: dict[str, np.ndarray], limits: dict[int, int], line_percent: int, min_words: int, base_ngram: int, base_percent: int) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < min_words) | (100 * m[f"dup_words_{base_ngram}"] > base_percent * m["n_words"])
    kept = ~failed & (100 * m["dup_line_chars"] <= line_percent * m["word_chars"])
    for k, percent in limits.items():
        kept &= 100 * m[f"dup_chars_{k}"] <= percent * m["word_chars"]
    return failed, kept


def repetition_coverage(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, int] | None = None, line_percent: int = LINE_PERCENT, min_words: int = MIN_WORDS, base_ngram: int = BASE_NGRAM, base_percent: int = BASE_PERCENT) -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, dup_line_chars and dup_chars_n
    for each n of ``limits`` (n: the most percent of word characters inside repeated n-grams)."""
    limits = dict(limits or NGRAM_PERCENT)
    lengths = tuple(sorted({*limits, base_ngram}))
    whole = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["dup_line_chars", *(f"dup_chars_{k}" for k in limits)]
    fields = {c: "bigint" for c in whole} | {"base_failed": "boolean", "kept": "boolean"} | {c: "bigint" for c in more}

    def make():
        def kernel(data, offsets):
            m = measures(data, offsets, lengths)
            failed, kept = verdicts(m, limits, line_percent, min_words, base_ngram, base_percent)
            m["n_repeat_words"] = m[f"dup_words_{base_ngram}"]
            return [*(m[c] for c in whole), failed, kept, *(m[c] for c in more)]

        return kernel

    return map_text(df, text_col, fields, make, [id_col])


WORD = r"[^\x20\x09-\x0D]+"


def oracle_sql(limits: dict[int, int] | None = None) -> str:
    limits = limits or NGRAM_PERCENT
    sizes = sorted({*limits, BASE_NGRAM})
    leads = ", ".join(f"lead(h, {j}) OVER s AS h{j}" for j in range(1, max(sizes)))
    same = ", ".join(f"h{k - 1} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, {', '.join(['h', *(f'h{j}' for j in range(1, k))])}) > 1 AS r{k}" for k in sizes)
    inside = ", ".join(f"max(r{k}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS c{k}" for k in sizes)
    covers = "\nUNION ALL\n".join(f"SELECT doc_id, {k} AS n, count(*) AS words, sum(c) AS chars FROM marks WHERE c{k} GROUP BY 1" for k in sizes)
    chars = ",\n  ".join(f"coalesce((SELECT chars FROM covered c WHERE c.doc_id = w.doc_id AND n = {k}), 0)::BIGINT AS dup_chars_{k}" for k in limits)
    tests = " AND ".join(f"100 * dup_chars_{k} <= {v} * word_chars" for k, v in limits.items())
    return rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
each AS (SELECT doc_id, i, length(ws[i]) AS c, hash(ws[i]) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
grams AS (SELECT doc_id, i, c, h, {leads} FROM each WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, c, {same} FROM grams),
marks AS (SELECT doc_id, c, {inside} FROM twice),
covered AS ({covers}),
lines AS (SELECT doc_id, l, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS c, row_number() OVER (PARTITION BY doc_id, l) AS k
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w)),
dup AS (SELECT doc_id, count(*) AS n, sum(c) AS chars FROM lines WHERE k > 1 AND c > 0 GROUP BY 1),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce((SELECT n FROM dup d WHERE d.doc_id = w.doc_id), 0)::BIGINT AS n_dup_lines,
  coalesce((SELECT words FROM covered c WHERE c.doc_id = w.doc_id AND n = {BASE_NGRAM}), 0)::BIGINT AS n_repeat_words,
  coalesce((SELECT chars FROM dup d WHERE d.doc_id = w.doc_id), 0)::BIGINT AS dup_line_chars,
  {chars} FROM w),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * dup_line_chars <= {LINE_PERCENT} * word_chars AND {tests} AS kept, dup_line_chars, {", ".join(f"dup_chars_{k}" for k in limits)} FROM f"""
