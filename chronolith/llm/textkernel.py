"""numpy kernels over the UTF-8 bytes of many texts at once: words, lines, code points and rolling hashes.

A byte range is hashed in steps of eight bytes, each mixed into two chained 64-bit states, so no rule ties the hashes of
related ranges; ranges beyond LONG bytes take blake2b. Where ranges must be told apart for certain, both states are compared.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

U = np.uint64
WINDOW, LONG = 0xD6E8FEB86659FD93 | 1, 1024
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def range_states(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit states for the bytes of each range; equal bytes have equal states wherever they stand."""
    left = (end - start).astype(np.int64)
    a, b = mix(left.astype(U) + U(0x9E3779B97F4A7C15)), mix(left.astype(U) * U(0xA0761D6478BD642F) + U(0xD1B54A32D192ED03))
    at, long = np.asarray(start, np.int64), np.flatnonzero(left > LONG)
    for i in long:
        digest = blake2b(data[at[i] : at[i] + left[i]].tobytes(), digest_size=16).digest()
        a[i], b[i] = np.frombuffer(digest, U)
    eights = np.ndarray(len(data) + 1, "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    todo = np.flatnonzero((left > 0) & (left <= LONG))
    at, left = at[todo], left[todo]
    while len(todo):
        piece = eights[at]
        short = left < 8
        piece[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
        a[todo] = mix(a[todo] ^ piece)
        b[todo] = mix(b[todo] * U(0xE7037ED1A0B428DB) + piece)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return a, b


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range."""
    a, b = range_states(data, start, end)
    return mix(a ^ (b << U(1) | b >> U(63)))


@dataclass
class Words:
    """Words are runs of bytes other than 0x20 and 0x09 to 0x0D inside one text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    count: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(offsets) - 1
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    count = np.diff(np.searchsorted(start, offsets))
    return Words(start, end, np.repeat(np.arange(n), count), count)


def running(mask: np.ndarray) -> np.ndarray:
    """Prefix sums of a mask, with a zero in front."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def letters(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the keys that occur twice or more, and of those that have an earlier equal."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n successive hashes, whether or not they are of one text."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, U)
    power = 1
    for j in range(n):
        out += hashes[j : j + size] * U(power)
        power = power * WINDOW % (1 << 64)
    return mix(out)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text after lower-casing A to Z, and offsets of the texts in them.

    A text of fewer words than width has its whole word sequence as its one shingle; a text without words has none.
    """
    data = lower_ascii(data)
    w = words(data, offsets)
    h = range_hash(data, w.start, w.end)
    n = len(offsets) - 1
    first = np.concatenate([[0], np.cumsum(w.count)])
    full = windows(h, width)
    sets = []
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            x = np.sort(full[a : b - width + 1])
            sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            sets.append(windows(h[a:b], b - a) ^ U(b - a))
        else:
            sets.append(np.empty(0, U))
    return np.concatenate(sets) if sets else np.empty(0, U), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
