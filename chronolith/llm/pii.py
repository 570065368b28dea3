"""Personal data by a semi-Markov conditional random field over candidate runs of tokens.

Base rules find e-mail addresses, IPv4 addresses, payment cards and international phone numbers. The model adds what they
miss: runs of tokens with digits or an at-sign, with their neighbours, are segmented by dynamic programming over all segments of
up to MAX_TOKENS tokens and all kinds at once, one token of any length or several of MAX_CHARS together. A segment scores its kind's
weights on features of the whole span (shape, digit counts, checksums, the word before), each step from one label to the next, "outside"
among them, the weight of that pair of labels; so boundaries and kinds are chosen together. Base spans stay as they are, and no segment
crosses one. Time is linear in a text's length, whatever its tokens look like.

The weights are trained here, on the driver, by gradient ascent on the model's conditional likelihood over generated
sentences (fixed seed, TRAINING of them), and broadcast: a few KB. One pass over Arrow batches, no shuffle; whole texts.

Nulls and empty texts have no spans; repeated rows get equal rows; an empty table gives none. Input columns with the names of
the results are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from hashlib import sha256
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "ssn")
MAX_TOKENS, MAX_CHARS, TRAINING, EPOCHS, RATE, SEED = 12, 320, 1500, 12, 0.3, 5
#: What a segment's kind must score above staying outside.
MARGIN = 0.3

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
#: Digits are taken whole, from the first of them on, so that no start is tried inside a long number.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
SPACE = " \t\n\x0b\x0c\r"
#: Tokens end at white space and at the marks that stand between a name and its value or in a list.
TOKEN = re.compile(r"[^\x20\t\n\x0b\x0c\r:=\"',;]+")
GAP = re.compile(r"[\x20\t\n\x0b\x0c\r]{0,2}[:=\"',;]{0,3}[\x20\t\n\x0b\x0c\r]{0,2}[\"']?")
GROUP = re.compile(r"[A-Z0-9]{1,4}")
#: A written-out address: at and dot in words. A mailbox has at most 64 characters by the mail standard.
AT = re.compile(r" ?(?:\(at\)|\[at\]|\bat\b) ?", re.IGNORECASE)
DOTS = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z0-9-]+)+", re.IGNORECASE)
HIDDEN = re.compile(r"[A-Za-z0-9._%+-]{1,64}" + AT.pattern + DOTS.pattern, re.IGNORECASE)
NOT_DIGIT = re.compile(r"[^0-9]+")
TRIM_LEFT, TRIM_RIGHT = "\"'`.,;:!?<>[]{}*#$%&|=/-", "\"'`.,;:!?<>[]{}*#$%&|=/-"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return NOT_DIGIT.sub("", text)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses, found from their at-signs: the mailbox is all that may stand in one before the sign."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = free + len(text[free:at].rstrip(LOCAL))
        free = at + 1
        if domain and start < at:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", free)
    return out


def written_out(text: str) -> list[tuple[int, int]]:
    """Addresses with at and dot in words, found from the at."""
    out, free = [], 0
    for m in AT.finditer(text):
        domain = DOTS.match(text, m.end()) if m.start() >= free else None
        if domain:
            box = text[max(free, m.start() - 64) : m.start()]
            start = m.start() - len(box) + len(box.rstrip(LOCAL))
            if start < m.start():
                out.append((start, domain.end()))
                free = domain.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and then start."""
    out = []
    if "@" in text:
        out += [(0, *span) for span in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Tokens with a digit or an at-sign, the token on each side of them, groups of capitals beside them and written-out addresses, in
    runs of neighbours with at most two spaces or a few marks between them."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    n = len(tokens)
    near = [GAP.fullmatch(text, a[1], b[0]) is not None if b[0] - a[1] <= 8 else False for a, b in zip(tokens, tokens[1:], strict=False)]
    keep = bytearray(n)
    starts = [s for s, _ in tokens]
    marked = sorted({bisect_right(starts, m.start()) - 1 for m in MARK.finditer(text)})
    for i in marked:
        keep[i] = 1
        for step in (-1, 1):
            k = i
            while 0 <= k + step < n and near[min(k, k + step)] and not keep[k + step]:
                k += step
                keep[k] = 1
                if not GROUP.fullmatch(text, *tokens[k]):
                    break
    for begin, end in written_out(text) if "dot" in text or "DOT" in text or "Dot" in text else ():
        for i in range(bisect_right(starts, begin) - 1, n):
            if tokens[i][0] >= end:
                break
            keep[i] = 1
    out: list[list[tuple[int, int]]] = []
    for i in range(n):
        if keep[i]:
            if i and keep[i - 1] and near[i - 1]:
                out[-1].append(tokens[i])
            else:
                out.append([tokens[i]])
    return out


# Words that come before a kind of data.
CUES = {
    "iban": "iban account konto compte cuenta",
    "secret": "token key secret password passwd pwd apikey api_key bearer credential auth",
    "ssn": "ssn social security number",
    "phone": "phone tel telephone call mobile cell fax telefon téléphone teléfono",
    "card": "card visa mastercard amex carte karte tarjeta",
    "email": "email mail e-mail contact correo courriel",
}
CUE_OF = {w: k for k, (_, words) in enumerate(CUES.items()) for w in words.split()}

SHAPES = [
    re.compile(p)
    for p in (
        r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}",
        r"0[0-9]{1,4}[ /-][0-9 -]{5,12}",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
        r"[0-9a-f]{32,}|[0-9A-F]{32,}",
        r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{20,}",
        r"(?:sk|pk|rk|ghp|gho|xox[bp]|AKIA|AIza|glpat|eyJ)[A-Za-z0-9_.-]{10,}",
        r"[0-9]{4}(?:[ -]+[0-9]{4}){3}",
        r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)+",
        HIDDEN.pattern,
        r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?",
        r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}",
        r"[0-9]+[.,:][0-9]+",
        r"v?[0-9]+(?:\.[0-9]+)*",
        r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?",
        r"[0-9 .-]+",
        r"\+?[0-9() .-]+",
        r"[A-Za-z]+[0-9]{1,4}|[0-9]{1,4}[A-Za-z]+",
    )
]
DIGITS = (1, 4, 7, 8, 9, 10, 11, 12, 13, 16, 17, 20, 30)
WIDTH = 1 + len(SHAPES) + len(DIGITS) + len(CUES) + 8


def iban_ok(text: str) -> bool:
    t = text.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", t):
        return False
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A segment without the punctuation around it."""
    while start < end and text[start] in TRIM_LEFT:
        start += 1
    while end > start and text[end - 1] in TRIM_RIGHT:
        end -= 1
    if text[start:end].count("(") != text[start:end].count(")"):
        if text[start] in "()":
            start += 1
        if end > start and text[end - 1] in "()":
            end -= 1
    return start, end


def span_features(text: str, start: int, end: int, before: str, tokens: int) -> np.ndarray:
    span = text[start:end]
    x = np.zeros(WIDTH, np.float64)
    x[0] = 1
    at = 1
    for k, shape in enumerate(SHAPES):
        x[at + k] = shape.fullmatch(span) is not None
    at += len(SHAPES)
    digits = only_digits(span)
    x[at + int(np.searchsorted(DIGITS, len(digits), "right")) - 1] = 1 if digits else 0
    at += len(DIGITS)
    for w in TOKEN.findall(before)[-2:]:
        k = CUE_OF.get(w.strip(TRIM_LEFT + "()").lower())
        if k is not None:
            x[at + k] = 1
    at += len(CUES)
    x[at : at + 8] = (
        12 <= len(digits) <= 19 and luhn(digits), iban_ok(span), "@" in span, any(c.isalpha() for c in span), tokens > 1,
        len(set(digits)) <= 2, span.startswith("+"), len(span) >= 32 and " " not in span,
    )
    return x


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def lattice(text: str, run: list[tuple[int, int]], base: list[tuple[int, int, int]], taken: tuple[list[int], list[int]] | None = None) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """Segments (first token, token after the last, start, end) of a run that touch no base span, and their features. taken: what
    the base spans cover, where it is known already."""
    segments, rows = [], []
    edges = [trimmed(text, s, e) for s, e in run]
    starts, ends = taken or merged(base)
    for i in range(len(run)):
        before = text[max(0, run[i][0] - 40) : run[i][0]]
        for j in range(i + 1, min(len(run), i + MAX_TOKENS) + 1):
            # several tokens are at most MAX_CHARS long; a single one is as long as it is
            if edges[i][0] == edges[i][1] or (j > i + 1 and run[j - 1][1] - run[i][0] > MAX_CHARS):
                break
            s, e = trimmed(text, run[i][0], run[j - 1][1])
            k = bisect_right(ends, s)
            if e - s < 6 or edges[j - 1][0] == edges[j - 1][1] or (k < len(starts) and starts[k] < e):
                continue
            if MARK.search(text, s, e) or HIDDEN.fullmatch(text, s, e):
                segments.append((i, j, s, e))
                rows.append(span_features(text, s, e, before, len(text[s:e].split())))
    return segments, np.array(rows).reshape(len(rows), WIDTH)


def log_sum(x: np.ndarray, axis: int = 0) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def decode(n: int, segments: list[tuple[int, int, int, int]], scores: np.ndarray, steps: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """The labelling of n tokens with the highest score: (kind, start, end) of its segments. steps: (label, next label) weights, by
    default none; the last label is outside, where each run begins."""
    out_of = scores.shape[1]
    steps = np.zeros((out_of + 1, out_of + 1)) if steps is None else steps
    best = np.full((n + 1, out_of + 1), -inf)
    best[0, out_of] = 0
    back: dict[tuple[int, int], tuple[int, int, int]] = {}
    ends: dict[int, list[int]] = {}
    for k, seg in enumerate(segments):
        ends.setdefault(seg[1], []).append(k)
    into, came = np.empty_like(best), np.empty(best.shape, int)
    for j in range(n + 1):
        if j:
            best[j, out_of] = into[j - 1, out_of]
            back[j, out_of] = (j - 1, int(came[j - 1, out_of]), -1)
            for k in ends.get(j, ()):
                i = segments[k][0]
                got = into[i, :out_of] + scores[k] - MARGIN
                for y in np.flatnonzero(got > best[j, :out_of]):
                    best[j, y] = got[y]
                    back[j, int(y)] = (i, int(came[i, y]), k)
        through = best[j][:, None] + steps
        came[j] = through.argmax(0)
        into[j] = through.max(0)
    found, j, y = [], n, int(best[n].argmax())
    while j > 0:
        i, before, k = back[j, y]
        if k >= 0:
            found.append((y, segments[k][2], segments[k][3]))
        j, y = i, before
    return found[::-1]


def expected(n: int, segments: list[tuple[int, int, int, int]], scores: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Under the model, the probability of each segment and kind, and how often each label follows each: forward and backward sums
    over all segmentations and labellings."""
    out_of = len(KINDS)
    starts: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    for k, seg in enumerate(segments):
        starts.setdefault(seg[0], []).append(k)
        ends.setdefault(seg[1], []).append(k)
    ahead, into = np.full((n + 1, out_of + 1), -inf), np.empty((n + 1, out_of + 1))
    ahead[0, out_of] = 0
    for j in range(n + 1):
        if j:
            ahead[j, out_of] = into[j - 1, out_of]
            if j in ends:
                ahead[j, :out_of] = log_sum(np.stack([into[segments[k][0], :out_of] + scores[k] for k in ends[j]]))
        into[j] = log_sum(ahead[j][:, None] + steps)
    total = log_sum(ahead[n])
    behind, pairs, chance = np.zeros((n + 1, out_of + 1)), np.zeros(steps.shape), np.zeros(scores.shape)
    for i in range(n - 1, -1, -1):
        on = np.full(out_of + 1, -inf)
        on[out_of] = behind[i + 1, out_of]
        if i in starts:
            on[:out_of] = log_sum(np.stack([scores[k] + behind[segments[k][1], :out_of] for k in starts[i]]))
        through = steps + on
        behind[i] = log_sum(through, 1)
        pairs += np.exp(np.minimum(ahead[i][:, None] + through - total, 0))
        for k in starts.get(i, ()):
            chance[k] = np.exp(np.minimum(into[i, :out_of] + scores[k] + behind[segments[k][1], :out_of] - total, 0))
    return chance, pairs


def marked_path(n: int, segments: list[tuple[int, int, int, int]], spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The same two counts of the marked labelling."""
    out_of = len(KINDS)
    kind_of = {(a, b): k for k, a, b in spans}
    gold, pairs = np.zeros((len(segments), out_of)), np.zeros((out_of + 1, out_of + 1))
    at = {seg[0]: k for k, seg in enumerate(segments) if seg[2:] in kind_of}
    i, label = 0, out_of
    while i < n:
        k = at.get(i)
        after = out_of if k is None else kind_of[segments[k][2:]]
        pairs[label, after] += 1
        if k is not None:
            gold[k, after] = 1
        i, label = (i + 1 if k is None else segments[k][1]), after
    return gold, pairs


def sample_text(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated sentence with at most two marked spans."""
    digits = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    letters = lambda k, of="abcdefghijklmnopqrstuvwxyz": "".join(of[i] for i in rng.integers(0, len(of), k))
    pick = lambda *of: of[int(rng.integers(len(of)))]
    word = lambda: letters(int(rng.integers(2, 9)))

    def card():
        d = digits(15)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def iban():
        country = pick("DE", "FR", "ES", "GB", "NL", "IT", "PL", "MT")
        tail = (letters(4, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if country in ("GB", "NL", "MT") else "") + digits(int(rng.integers(10, 25)))
        check = 98 - int("".join(str(int(c, 36)) for c in tail + country + "00")) % 97
        whole = f"{country}{check:02d}{tail}"
        return pick(whole, " ".join(whole[k : k + 4] for k in range(0, len(whole), 4)))

    def entity():
        kind = int(rng.integers(len(KINDS)))
        c = card()
        made = {
            "email": lambda: pick(f"{word()} @ {word()}.com", f"{word()} at {word()} dot com", f"{word()}{digits(2)} at {word()} dot com", f"{word()}(at){word()}(dot)org", f"{word()}{digits(2)}[at]{word()}[dot]net", f"{word()}.{digits(2)} @{word()}.example.com"),
            "ip": lambda: ".".join(str(x) for x in rng.integers(1, 255, 4)),
            "card": lambda: pick(*(sep.join(c[k : k + 4] for k in range(0, 16, 4)) for sep in ("  ", ".", "/"))),
            "phone": lambda: pick(f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(3)} {digits(7)}", f"0{digits(2)}-{digits(8)}", f"+{digits(2)} ({digits(3)}) {digits(3)}-{digits(4)}"),
            "iban": iban,
            "secret": lambda: pick(letters(40, "0123456789abcdef"), letters(32, "0123456789abcdef"), letters(64, "0123456789abcdef"), "sk_live_" + letters(24, "abcdefghijkABCDEFG0123456789"), "ghp_" + letters(36, "abcdefghijkABCDEFG0123456789"), "AKIA" + letters(16, "ABCDEFGHIJK0123456789"), letters(30, "abcdefghijkABCDEFGH0123456789_-"), "eyJ" + ".".join(letters(int(rng.integers(20, 90)), "abcdefghijkABCDEFGH0123456789_-") for _ in range(3))),
            "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        }[KINDS[kind]]()
        cue = pick("", *CUES.get(KINDS[kind], "").split()) if KINDS[kind] in CUES else ""
        around = pick(("", ""), ("", ""), ('"', '"'), ("(", ")"), ("", "."), ("", "%%%"), ("", ","))
        return kind, (f"{cue}{pick(' ', ': ', ' = ', ':', '=')}" if cue else "") + around[0], made, around[1]

    def other():
        return pick(
            f"{digits(4)}-{pick('01', '07', '12')}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{pick(1, 2, 3)}.{digits(1)}", f"v{digits(1)}.{digits(2)}.{digits(1)}", f"{pick('19', '20')}{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}",
            f"{digits(3)}", f"{digits(2)}%", f"{digits(5)}", f"{digits(6)}", f"{digits(7)}", f"{digits(9)}", f"{digits(12)}", f"{digits(16)}", f"{word()}{digits(1)}", f"{digits(2)}.{digits(4)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"@{word()}", f"#{digits(4)}", f"{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}",
            f"{digits(4)}–{digits(4)}", f"{digits(3)} {digits(3)}", f"{digits(2)} {digits(3)} {digits(4)}", f"{digits(1)} {digits(2)} {digits(1)} {digits(3)} {digits(2)}", f"ISBN {digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
        )

    text, spans = word(), []
    for _ in range(int(rng.integers(1, 4))):
        text += " " + " ".join(word() for _ in range(int(rng.integers(1, 5)))) + " "
        if rng.random() < 0.5:
            kind, lead, made, tail = entity()
            spans.append((kind, len(text) + len(lead), len(text) + len(lead) + len(made)))
            text += lead + made + tail
        else:
            text += other()
    return text + " " + word() + ".", spans


def train(count: int = TRAINING, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, kinds) of segments and (label, next label) of steps."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(count):
        text, spans = sample_text(rng)
        base = base_spans(text)
        for run in runs(text):
            segments, x = lattice(text, run, base)
            if segments:
                data.append((len(run), segments, x, *marked_path(len(run), segments, spans)))
    labels = len(KINDS) + 1
    w, steps = np.zeros((WIDTH, len(KINDS))), np.zeros((labels, labels))
    seen_w, seen_s = np.full(w.shape, 1e-3), np.full(steps.shape, 1e-3)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            n, segments, x, gold, pairs = data[k]
            chance, often = expected(n, segments, x @ w, steps)
            for value, seen, slope in ((w, seen_w, x.T @ (gold - chance) - 1e-4 * w), (steps, seen_s, pairs - often - 1e-4 * steps)):
                seen += slope**2
                value += rate * slope / np.sqrt(seen)
    return w, steps


Model = tuple[np.ndarray, np.ndarray]
_trained: dict[tuple, Model] = {}


def weights() -> Model:
    """The trained weights; one training a process."""
    key = (TRAINING, EPOCHS, RATE, SEED)
    if key not in _trained:
        _trained[key] = train(*key)
    return _trained[key]


def find(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (kind, start, end) in code points, by kind and then start."""
    w, steps = model
    # a segment with less than this can't be part of the best labelling: no pair of steps makes up for it
    least = MARGIN - 2 * (steps.max() - steps.min())
    base = base_spans(text)
    taken = merged(base)
    added = []
    for run in runs(text):
        segments, x = lattice(text, run, base, taken)
        if segments:
            scores = x @ w
            some = np.flatnonzero(scores.max(1) > least)
            if len(some):
                added += decode(len(run), [segments[k] for k in some], scores[some], steps)
    return base, sorted({*base, *added})


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with a digit, an at-sign or the word dot: only they can hold a span."""
    mark = np.zeros(256, bool)
    mark[[*range(48, 58), 64]] = True
    counts = np.concatenate([[0], np.cumsum(mark[data])])
    some = np.diff(counts[offsets]) > 0
    raw = data.tobytes()
    for i in np.flatnonzero(~some):
        some[i] = b"dot" in (t := raw[offsets[i] : offsets[i + 1]]) or b"DOT" in t or b"Dot" in t
    return some


def find_all(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone (of the base rules), base_sha256, spans and n_spans."""
    shared = df.sparkSession.sparkContext.broadcast(weights())
    nothing = sha256(b"").hexdigest()

    def make():
        w = shared.value

        def kernel(data, offsets):
            n = len(offsets) - 1
            counts, total, digest, spans = np.zeros((4, n), np.int64), np.zeros(n, np.int64), [nothing] * n, [""] * n
            for i in np.flatnonzero(suspects(data, offsets)):
                base, every = find(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"), w)
                for k, _, _ in base:
                    counts[k, i] += 1
                digest[i], spans[i], total[i] = sha256(spelled(base).encode()).hexdigest(), spelled(every), len(every)
            return [*counts, digest, spans, total]

        return kernel

    fields = {f"n_{k}": "bigint" for k in BASE} | {"base_sha256": "string", "spans": "string", "n_spans": "bigint"}
    return map_text(df, text_col, fields, make, [id_col])


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_all(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """df with each span of its texts replaced by its kind in brackets; chars_col, if df has it, counts the code points left.
    Null texts stay null."""
    shared = df.sparkSession.sparkContext.broadcast(weights())
    count = chars_col if chars_col in df.columns else None

    def make():
        w = shared.value

        def kernel(data, offsets):
            raw, some = data.tobytes(), suspects(data, offsets)
            texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            for i in np.flatnonzero(some):
                text = texts[i].decode("utf-8", "replace")
                texts[i] = redact(text, find(text, w)[1]).encode()
            made = pa.array(texts, pa.binary()).cast(pa.string())
            sizes = np.array([len(t.decode("utf-8", "replace")) for t in texts], np.int64)
            return [made, sizes]

        return kernel

    fields = {"__redacted": "string", "__chars": "bigint"}
    out = map_text(df, text_col, fields, make, df.columns)
    new = {text_col: F.when(F.col(text_col).isNotNull(), F.col("__redacted")).cast(df.schema[text_col].dataType)}
    if count:
        new[count] = F.when(F.col(text_col).isNotNull(), F.col("__chars")).otherwise(F.col(count)).cast(df.schema[count].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])
