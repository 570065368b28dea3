"""Pairs of texts whose SequenceMatcher ratio may reach a least one, by bounds that never lose a pair; whole blocks of texts in numpy.

A ratio is 2 * matched / (both lengths), and matched characters lie in blocks that stand in both texts in one order. So matched is at most

- the letters that both texts have (``same_letters``), and their longest common subsequence (``subsequences``);
- the 4-grams that both have (``common``), plus 3 a block. Where the earlier text has ``POPULAR_FROM`` characters or more, SequenceMatcher starts
  blocks at unpopular characters only, and one more at the texts' start, so there are few blocks.
"""

from __future__ import annotations

import numpy as np

#: SequenceMatcher's own: from this length of the second text on, its popular characters start no block.
POPULAR_FROM = 200
GRAM = 4
PIECE = 1 << 20  # characters whose grams are sorted at once
TOGETHER = 1 << 14  # pairs whose subsequences are found at once
WIDER = 8  # times the bits for pairs that narrow signatures leave
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys' starts of equal runs and their lengths."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(keys)])


def most_blocks(texts: list[str], sizes: np.ndarray) -> np.ndarray:
    """Of each text as the second one, how many blocks SequenceMatcher may find at most, if it has popular characters."""
    out = np.ones(len(texts), np.int64)
    for a, b in pieces(sizes):
        key = np.sort((np.repeat(np.arange(b - a, dtype=np.uint64), sizes[a:b]) << np.uint64(21)) | code_points(texts[a:b]).astype(np.uint64))
        starts, n = runs(key)
        row = (key[starts] >> np.uint64(21)).astype(np.int64)
        rare = n <= sizes[a:b][row] // 100 + 1
        out[a:b] += np.bincount(row[rare], n[rare], b - a).astype(np.int64)
    return out


def pieces(sizes: np.ndarray):
    """Bounds of consecutive rows with PIECE characters at most, or one row."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, "right")))
        yield a, b
        a = b


def widths(sizes: np.ndarray) -> np.ndarray:
    """Bits of a text's signature: a power of two, 4 to 8 a character."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(1, 4 * sizes))).astype(np.int64))


class Signatures:
    """Of texts in ascending length, the set of (gram, how many-th of its text) as bits, in parts of one width: (first, last, words by texts)."""

    def __init__(self, texts: list[str], sizes: np.ndarray, q: int, wider: int = 1):
        bits = widths(sizes) * wider
        self.grams = np.maximum(0, sizes - q + 1)
        self.parts = []
        starts, n = runs(bits)
        for a, k in zip(starts.tolist(), n.tolist(), strict=True):
            words = np.zeros((k, int(bits[a]) // 64), np.uint64)
            for x, y in pieces(sizes[a : a + k]):
                words[x:y] = packed(texts[a + x : a + y], sizes[a + x : a + y], q, int(bits[a]))
            self.parts.append((a, a + k, np.ascontiguousarray(words.T) if wider == 1 else words.T))


def packed(texts: list[str], sizes: np.ndarray, q: int, bits: int) -> np.ndarray:
    codes = code_points(texts).astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    n = max(0, len(codes) - q + 1)
    gram = np.zeros(n, np.uint64)
    for k in range(q):
        gram = gram * _A + codes[k : k + n]
    inside = row[:n] == row[q - 1 :][:n]
    key = np.sort((row[:n][inside] << np.uint64(40)) | (mixed(gram[inside]) >> np.uint64(24)))
    starts, length = runs(key)
    nth = np.arange(len(key)) - np.repeat(starts, length)
    place = mixed((key & np.uint64((1 << 40) - 1)) * _A + nth.astype(np.uint64)) & np.uint64(bits - 1)
    flags = np.zeros(len(texts) * bits, bool)
    flags[(key >> np.uint64(40)).astype(np.int64) * bits + place.astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64).reshape(len(texts), bits // 64)


def folded(words: np.ndarray, count: int) -> np.ndarray:
    while len(words) > count:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def common(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Bits that one signature has in common with each of many (words by texts)."""
    out = np.zeros(many.shape[1], np.uint16 if len(one) < 1024 else np.uint32)
    both, n = np.empty(many.shape[1], np.uint64), np.empty(many.shape[1], np.uint8)
    for w in np.flatnonzero(one).tolist():
        np.bitwise_and(many[w], one[w], out=both)
        np.bitwise_count(both, out=n)
        out += n
    return out


def same_letters(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many letters one text has in common with each of many, from counts of each letter (letters by texts)."""
    out, less = np.zeros(many.shape[1], np.uint16), np.empty(many.shape[1], np.uint16)
    for c in np.flatnonzero(one).tolist():
        np.minimum(many[c], one[c], out=less)
        out += less
    return out


def subsequences(patterns: list[np.ndarray], which: np.ndarray, letters: np.ndarray, column: np.ndarray, sizes: np.ndarray, need: np.ndarray, alphabet: int) -> np.ndarray:
    """Of pairs of a pattern and a text (a column of letters, filled up with ``alphabet``), those with a common subsequence of ``need``.

    The row of a pair's table is kept as bits (Hyyro's), a letter of every text a step; pairs that can't get there any more are put aside.
    """
    lengths = np.array([len(p) for p in patterns])
    count, stride = -(-int(lengths.max()) // 64), alphabet + 1
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    masks = np.zeros((count, len(patterns) * stride), np.uint64)
    np.bitwise_or.at(masks, (place // 64, np.repeat(np.arange(len(patterns)) * stride, lengths) + np.concatenate(patterns)), np.uint64(1) << (place % 64).astype(np.uint64))
    here, base = np.arange(len(which)), which * stride
    state = [np.full(len(here), ~np.uint64(0)) for _ in range(count)]
    found = lambda: 64 * count - sum(np.bitwise_count(v).astype(np.int64) for v in state)
    for t in range(int(sizes.max())):
        if t and t % 16 == 0:
            alive = found() + np.maximum(0, sizes - t) >= need
            if 8 * np.count_nonzero(alive) < 7 * len(here):
                here, base, column, sizes, need, state = here[alive], base[alive], column[alive], sizes[alive], need[alive], [v[alive] for v in state]
                if not len(here):
                    return here
        at, carry = base + letters[t][column], None
        for w, v in enumerate(state):
            u = masks[w].take(at)
            u &= v
            s = v + u
            if w + 1 < count or carry is not None:
                over = s < v
                if carry is not None:
                    s += carry
                    over |= s < carry
                carry = over.astype(np.uint64)
            u ^= v
            s |= u
            state[w] = s
    return here[found() >= need]


def counted(rows: np.ndarray, letters: np.ndarray, n: int, alphabet: int) -> np.ndarray:
    """How often each of n texts has each letter; of a large alphabet, letters share counts, which only adds to what texts have in common."""
    width = min(alphabet, 256)
    return np.bincount(rows * width + letters % width, minlength=n * width).astype(np.uint16).reshape(n, width)


def candidates(texts: list[str], sizes: np.ndarray, rank: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs, one of left with one of right, whose ratio may be at least ``least``; the text of lower rank is the second, and
    for equal ranks either may be. left and right are positions in ascending length; where they are the same, each pair is met once."""
    reach = least / (2 - least)
    same = left is right
    longest = max(sizes[left].max(initial=0), sizes[right].max(initial=0))
    sides, wide = [], []
    for rows in (left,) if same else (left, right):
        some, n = [texts[k] for k in rows], sizes[rows]
        wide.append(Signatures(some, n, GRAM, WIDER) if longest >= POPULAR_FROM else None)
        sides.append((n, rank[rows], most_blocks(some, n), Signatures(some, n, GRAM), some))
    (n1, r1, k1, g1, t1), (n2, r2, k2, g2, t2) = sides[0], sides[-1]
    m1, m2 = int(np.sum(n1 * reach < POPULAR_FROM)), int(np.sum(n2 * reach < POPULAR_FROM))
    if m1 and m2:  # texts that may meet a second text without popular characters, letter by letter
        known, coded = np.unique(code_points([*t1[:m1], *t2[:m2]]), return_inverse=True)
        ends1, rows2 = np.r_[0, np.cumsum(n1[:m1])], np.repeat(np.arange(m2), n2[:m2])
        letters = np.full((int(n2[m2 - 1]), m2), len(known), np.uint16 if len(known) < 65535 else np.int64)
        second = coded[ends1[-1] :]
        letters[np.arange(len(second)) - np.repeat(np.cumsum(n2[:m2]) - n2[:m2], n2[:m2]), rows2] = second
        often1 = counted(np.repeat(np.arange(m1), n1[:m1]), coded[: ends1[-1]], m1, len(known))
        often2 = counted(rows2, second, m2, len(known)).T.copy()
    out, waiting = [], []

    def shared(p: int, x: int, q: int, ys: np.ndarray) -> np.ndarray:
        """At least the 4-grams in common of the x-th text of the left part p and those at ys of the right part q."""
        (a1, b1, w1), (a2, b2, w2) = wide[0].parts[p], wide[-1].parts[q]
        count = min(len(w1), len(w2))
        one, many = folded(w1[:, x : x + 1], count), folded(w2[:, ys], count)
        lost = [g[rows] - np.bitwise_count(w).sum(0, dtype=np.int64) for g, rows, w in ((g1.grams, [a1 + x], one), (g2.grams, a2 + ys, many))]
        return np.bitwise_count(many & one).sum(0, dtype=np.int64) + np.minimum(*lost)

    def follow() -> None:
        """Pairs with enough letters in common go on to their subsequences, many at once."""
        rows, columns, needed = (np.concatenate(x) for x in zip(*((np.full(len(y), x), y, z) for x, y, z in waiting), strict=True))
        waiting.clear()
        own, which = np.unique(rows, return_inverse=True)
        hit = subsequences([coded[ends1[x] : ends1[x + 1]] for x in own.tolist()], which, letters, columns, n2[columns], needed, len(known))
        out.append((left[rows[hit]], right[columns[hit]]))

    many = 0
    for p, (a1, b1, w1) in enumerate(g1.parts):
        for q, (a2, b2, w2) in enumerate(g2.parts):
            if n2[b2 - 1] < n1[a1] * reach - 1e-9 or n2[a2] * reach - 1e-9 > n1[b1 - 1]:
                continue
            count = min(len(w1), len(w2))
            x4, y4 = folded(w1, count), folded(w2, count)
            lost = lambda g, a, b, w: g.grams[a:b] - np.bitwise_count(w).sum(0, dtype=np.int64)
            lx4, ly4 = lost(g1, a1, b1, x4), lost(g2, a2, b2, y4)
            for x in range(a1, b1):
                lo, hi = np.searchsorted(n2[a2:b2], [n1[x] * reach - 1e-9, n1[x] / reach + 1e-9]) + a2
                lo = max(lo, x + 1) if same else lo
                if lo >= hi:
                    continue
                n, s = n2[lo:hi], slice(lo - a2, hi - a2)
                need = least * (n1[x] + n) / 2 - 1e-9
                before, after = r1[x] < r2[lo:hi], r2[lo:hi] < r1[x]
                second = np.where(before, n1[x], np.where(after, n, np.minimum(n1[x], n)))
                long = second >= POPULAR_FROM
                if long.any():
                    blocks = np.where(before, k1[x], np.where(after, k2[lo:hi], np.maximum(k1[x], k2[lo:hi])))
                    most = common(np.ascontiguousarray(x4[:, x - a1]), y4[:, s]) + np.minimum(lx4[x - a1], ly4[s]) + (GRAM - 1) * blocks
                    hit = np.flatnonzero(long & (most >= need))
                    if len(hit):  # again by wider signatures
                        hit = hit[shared(p, x - a1, q, lo + hit - a2) + (GRAM - 1) * blocks[hit] >= need[hit]]
                        out.append((np.full(len(hit), left[x]), right[lo + hit]))
                if not long.all():
                    end = min(hi, m2) - lo
                    near = np.flatnonzero(~long[:end] & (same_letters(often1[x], often2[:, lo : lo + end]) >= need[:end]))
                    if len(near):
                        waiting.append((x, lo + near, need[near]))
                        many += len(near)
                        if many >= TOGETHER:
                            follow()
                            many = 0
    if waiting:
        follow()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def length_blocks(counts: dict[int, int], least: float, rows: int, chars: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Blocks of texts by length, of about so many rows and characters at most: (length, first block, how many it is dealt to) and, of
    each block, (block, first, last) of the blocks whose lengths may match its own."""
    reach = least / (2 - least)
    dealt, spans, here, size = [], [], rows, 0
    for n, c in sorted(counts.items()):
        parts = min(c, max(1, -(-c // rows), -(-c * n // chars)))
        if parts > 1 or here + c > rows or size + c * n > chars:
            spans += [[n, n] for _ in range(parts)]
            here, size = (rows, 0) if parts > 1 else (0, 0)
        here, size, spans[-1][1] = here + c, size + c * n, n
        dealt.append((n, len(spans) - parts, parts))
    lows, highs = np.array([a for a, _ in spans]), np.array([b for _, b in spans])
    last = np.searchsorted(lows, highs / reach + 1e-6, "right") - 1
    first = np.searchsorted(last, np.arange(len(spans)))
    return dealt, [(k, int(first[k]), int(last[k])) for k in range(len(spans))]
