"""Personal data by fixed patterns plus a semi-Markov conditional random field.

Base spans come from four patterns (email, ip, card, phone). Around every digit, ``@`` and
worded at-mark that no base span covers, the text is cut into tokens, and a semi-Markov CRF
scores whole candidate segments (digit and group counts, checksum, separators, borders,
context words); a dynamic program over segments of at most ``MAX_TOKENS`` tokens picks
boundaries and types together. What it labels is added to the base spans, which always stay. A stretch of any length (a long table
of numbers) is taken in windows, with the same result.

Training: regions of a bounded sample of documents (``SAMPLE_DOCS`` documents, ``SAMPLE_REGIONS``
regions), whose base spans are the gold segments, plus rewritten forms of those spans (worded
at-marks, defanged addresses, other separators) and plain numbers as negatives. The gradient of
the conditional likelihood comes from the forward-backward sums over all segmentations.

Nulls and odd inputs: a null text is empty and has no span; positions are code points; a table
without any base span to learn from adds nothing; equal texts get equal spans and count once in the sample; very long texts are
read whole; of segmentations that score alike the one with earlier, longer entities is taken; an empty table gives no rows; in the
pipeline the row rides in a struct, so no input column can clash.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwarden.llm.common import nested, smallest_hashes, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_REGIONS = 4_000, 600
MAX_TOKENS, MAX_CHARS = 18, 64
WINDOW_TOKENS, AROUND = 2_048, 16  # tokens whose segments are scored together, and tokens beside them that features look at
EPOCHS, RATE, L2 = 14, 0.3, 1e-3

# ---------------------------------------------------------------- base spans
# Possessive repeats and look-behinds keep the patterns linear on long runs; the matches are those
# of the plain patterns (a run of digits can only start a match at its first digit).
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run of its characters before the ``@``, from the last match on."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind as listed, then by start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)
                    if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


# ---------------------------------------------------------------- regions and candidate segments
_TRIGGER = re.compile(r"[0-9@]+|[(\[{](?i:at)[)\]}]|(?<=\s)(?i:at) (?=[A-Za-z0-9-]{1,30}(?i: dot ))")
_TOKEN = re.compile(r"[(\[{](?:(?i:at|dot)|\.)[)\]}]|[^\W\d_]+|[0-9]+|\S")
_AT = frozenset({"@", "(at)", "[at]", "{at}", "at"})
_DOT = frozenset({".", "(dot)", "[dot]", "{dot}", "dot", "[.]", "(.)", "{.}"})
_SEPARATOR = frozenset({"-", ".", "(", ")", "/", "+", "[.]", "(.)", "{.}"})
_GAP = re.compile(r"(?:\s?(?:[(\[{]\.[)\]}]|[-.()/]))*\s*")  # what may stand between two digits of one segment
LEAST_DIGITS = 4  # an ip has four
# context words (fixed values)
CONTEXT = {"phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "ip": "ip",
           "host": "ip", "server": "ip", "card": "card", "visa": "card", "credit": "card", "email": "email",
           "mail": "email", "contact": "email"}


def regions(text: str, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of text around the triggers that no span in ``covered`` holds.

    A region reaches ``MAX_CHARS`` beyond its triggers, to a token border, and is dropped when it has
    no candidate segment (no at-mark, and under ``LEAST_DIGITS`` digits outside the covered spans).
    """
    out: list[list[int]] = []
    covered = sorted(covered)
    k = 0
    for m in _TRIGGER.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k < len(covered) and covered[k][0] <= m.start() and m.end() <= covered[k][1]:
            continue
        size = m.end() - m.start() if m.group().isdigit() else LEAST_DIGITS
        gap = m.start() - out[-1][1] if out else MAX_CHARS
        if gap <= 8 or (gap < MAX_CHARS and _GAP.fullmatch(text, out[-1][1], m.start())):
            out[-1][1] = m.end()
            out[-1][2] += size
        else:
            out.append([m.start(), m.end(), size])
    return [(max(0, a - MAX_CHARS), min(len(text), b + MAX_CHARS)) for a, b, n in out if n >= LEAST_DIGITS]


def token_borders(text: str, lo: int, hi: int) -> tuple[int, int]:
    """``lo`` and ``hi`` moved outward so that they cut no word or number in two."""
    while lo > 0 and text[lo - 1].isalnum() and text[lo].isalnum():
        lo -= 1
    while hi < len(text) and text[hi - 1].isalnum() and text[hi].isalnum():
        hi += 1
    return lo, hi


class Region:
    """Tokens of a region (or of a window of one), their candidate segments and features."""

    def __init__(self, text: str, lo: int, hi: int, blocked: list[tuple[int, int]], spans: list[tuple[int, int]] | None = None):
        self.text = text
        if spans is None:
            lo, hi = token_borders(text, lo, hi)
            spans = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
        self.spans = spans
        self.n = len(spans)
        self.tok = [text[a:b] for a, b in spans]
        self.low = [t.lower() for t in self.tok]
        near = [(a, b) for a, b in blocked if a < hi and b > lo]
        self.free = [not any(a < e and b > s for a, b in near) for s, e in spans]
        self.segments: list[tuple[int, int]] = []  # token ranges
        self.numeric: list[bool] = []
        rows = []
        for i, j, row in self._numbers():
            rows.append(row)
            self.segments.append((i, j))
            self.numeric.append(True)
        for i, k, j in self._email_ranges():
            rows.append(self._email_features(i, k, j))
            self.segments.append((i, j))
            self.numeric.append(False)
        self.features = np.array(rows, float) if rows else np.zeros((0, WIDTH))

    def _glued(self, i: int) -> bool:
        """Token i follows token i - 1 without white space."""
        return self.spans[i][0] == self.spans[i - 1][1]

    def _numbers(self) -> Iterator[tuple[int, int, list[float]]]:
        """Numeric segments with their features, which grow with the segment token by token."""
        tok, spans, free, n = self.tok, self.spans, self.free, self.n
        digit = ["0" <= t[0] <= "9" for t in tok]
        glued = [True] + [spans[x][0] == spans[x - 1][1] for x in range(1, n)]
        rights: dict[int, tuple] = {}
        for i in range(n):
            if not free[i] or not (digit[i] or tok[i] in "+(") or len(tok[i]) > 19:
                continue
            left = None
            begin, digits, groups, lengths = spans[i][0], 0, [], []
            seps: set[str] = set()
            spaces, small, dots = 0, True, True
            for j in range(i, min(n, i + MAX_TOKENS)):
                t = tok[j]
                if not free[j] or spans[j][1] - begin > MAX_CHARS:
                    break
                spaces += j > i and not glued[j]
                if not digit[j]:
                    if t not in _SEPARATOR or (t == "+" and j > i) or (j > i and spans[j][0] - spans[j - 1][1] > 1):
                        break
                    seps.add(t)
                    dots = dots and t in _DOT
                    continue
                digits += len(t)
                if digits > 19:
                    break
                groups.append(t)
                lengths.append(len(t))
                small = small and _small(t)
                if digits < LEAST_DIGITS:
                    continue
                left = self._left(i) if left is None else left
                right = rights.get(j)
                if right is None:
                    right = rights[j] = self._right(j + 1)
                g, dotted = len(groups), bool(seps) and dots and not spaces
                yield i, j + 1, [
                    1.0, left[0], right[0], left[1], right[1], *left[2], digits < 7, 7 <= digits <= 8, 9 <= digits <= 12,
                    13 <= digits <= 15, digits == 16, digits > 16, g == 1, g == 2, g == 3, g == 4, g > 4, tok[i] == "+", "(" in seps,
                    ("(" in seps) != (")" in seps), dotted and g == 4 and small, dotted,
                    digits >= 13 and luhn("".join(groups)), lengths == [4, 4, 4, 4],
                    lengths in _PHONE_SHAPES, len(seps) > 1, spaces > 0,
                    i > 0 and digit[i - 1] and begin - spans[i - 1][1] <= 1,
                    j + 1 < n and digit[j + 1] and spans[j + 1][0] - spans[j][1] <= 1, *_NO_EMAIL]

    def _email_ranges(self) -> Iterator[tuple[int, int, int]]:
        tok, low = self.tok, self.low
        for k in range(1, self.n - 1):
            if low[k] not in _AT or not self.free[k]:
                continue
            worded = tok[k] != "@"
            starts = []
            for i in range(k - 1, max(-1, k - 1 - MAX_TOKENS // 2), -1):
                if not self.free[i] or not (tok[i][0].isalnum() or tok[i] in "._%+-") or \
                        (i < k - 1 and not self._glued(i + 1)):
                    break
                if tok[i][0].isalnum():
                    starts.append(i)
            ends, label, dotted = [], True, False
            for j in range(k + 1, min(self.n, k + 1 + MAX_TOKENS // 2)):
                t = tok[j]
                if not self.free[j] or (not worded and low[j] not in _DOT and j > k + 1 and not self._glued(j)):
                    break
                if worded and t == "." and not (self._glued(j) and j + 1 < self.n and self._glued(j + 1)):
                    break  # the end of a sentence
                if label:
                    if not t[0].isalnum():
                        break
                    label = False
                    if dotted:  # a domain has two labels at least
                        ends.append(j + 1)
                elif low[j] in _DOT or t == "-":
                    label, dotted = True, dotted or t != "-"
                elif self._glued(j) and t[0].isalnum():
                    if dotted:
                        ends.append(j + 1)
                else:
                    break
            yield from ((i, k, j) for i in starts for j in ends if j - i <= MAX_TOKENS)

    def _left(self, i: int) -> tuple[bool, bool, list[bool]]:
        """Of a segment that begins at token i: a free border, a joined border, and the kinds that the words before name."""
        text, a = self.text, self.spans[i][0]
        kinds = {CONTEXT[w] for t in self.tok[max(0, i - 4):i] if (w := t.lower()) in CONTEXT}
        left, left2 = text[a - 1] if a else " ", text[a - 2] if a > 1 else " "
        return (not (left.isalnum() or left in "_@"), left in ".-+(/" and left2 != " " and left2.isalnum(),
                [k in kinds for k in KINDS])

    def _right(self, j: int) -> tuple[bool, bool]:
        """Of a segment that ends before token j: a free border, a joined border."""
        text, b = self.text, self.spans[j - 1][1]
        right, right2 = text[b] if b < len(text) else " ", text[b + 1] if b + 1 < len(text) else " "
        return not (right.isalnum() or right in "_@"), right in ".-+/@" and right2.isalnum()

    def _borders(self, i: int, j: int) -> list[float]:
        left, right = self._left(i), self._right(j)
        return [1.0, left[0], right[0], left[1], right[1], *left[2]]

    def _email_features(self, i: int, k: int, j: int) -> list[float]:
        tok, low = self.tok, self.low
        domain = low[k + 1:j]
        dots = [t for t in domain if t in _DOT]
        glued_left = i > 0 and self._glued(i) and (self.tok[i - 1][0].isalnum() or self.tok[i - 1] in "._%+-")
        more = j + 1 < self.n and low[j] in _DOT and tok[j + 1][0].isalnum() and (
            tok[j] != "." or (self._glued(j) and self._glued(j + 1)))
        return [*self._borders(i, j), *[0.0] * 23, float(tok[k] == "@"), float(low[k] == "at"), float(bool(dots)),
                float(len(domain[-1]) >= 2 and domain[-1].isalpha()), float(glued_left), float(more),
                float(tok[k] != "@" and low[k] != "at")]


WIDTH = 9 + 23 + 7
_NO_EMAIL = [0.0] * 7
_PHONE_SHAPES = ([3, 3, 4], [1, 3, 3, 4], [2, 3, 3, 4])


def _allowed(region: Region) -> np.ndarray:
    """``[segment, kind]`` mask: numbers are ip, card or phone, the others email."""
    num = np.array(region.numeric, bool)
    return np.stack([~num, num, num, num], axis=1)


def _log_partition(region: Region, score: np.ndarray) -> tuple[float, np.ndarray]:
    """log Z over all segmentations (single outside tokens score 0) and each segment's marginal."""
    n, segs = region.n, region.segments
    flat = np.logaddexp.reduce(score, axis=1) if len(segs) else np.zeros(0)
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    by_start: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, j) in enumerate(segs):
        by_end[j].append(s)
        by_start[i].append(s)
    fwd, bwd = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, n + 1):
        v = fwd[t - 1]
        for s in by_end[t]:
            v = np.logaddexp(v, fwd[segs[s][0]] + flat[s])
        fwd[t] = v
    for t in range(n - 1, -1, -1):
        v = bwd[t + 1]
        for s in by_start[t]:
            v = np.logaddexp(v, bwd[segs[s][1]] + flat[s])
        bwd[t] = v
    if not len(segs):
        return fwd[n], np.zeros_like(score)
    i, j = np.array(segs).T
    return fwd[n], np.exp((fwd[i] + bwd[j])[:, None] + score - fwd[n])


def decode(region: Region, w: np.ndarray) -> list[tuple[str, int, int]]:
    """The best segmentation's entities as ``(kind, start, end)``."""
    if not region.segments:
        return []
    score = np.where(_allowed(region), region.features @ w.T, -1e9)
    kind, top = score.argmax(1), score.max(1)
    by_end: dict[int, list[int]] = {}
    for s, (_, j) in enumerate(region.segments):
        if top[s] > 0:  # a segment that scores less than outside tokens is in no best segmentation
            by_end.setdefault(j, []).append(s)
    best, how = np.zeros(region.n + 1), [-1] * (region.n + 1)
    for t in range(1, region.n + 1):
        best[t] = best[t - 1]
        for s in by_end.get(t, ()):
            v = best[region.segments[s][0]] + top[s]
            if v > best[t]:
                best[t], how[t] = v, s
    out, t = [], region.n
    while t > 0:
        if how[t] < 0:
            t -= 1
        else:
            i, j = region.segments[how[t]]
            out.append((KINDS[kind[how[t]]], region.spans[i][0], region.spans[j - 1][1]))
            t = i
    return out[::-1]


def decode_windows(text: str, lo: int, hi: int, blocked: list[tuple[int, int]], w: np.ndarray,
                   window: int = WINDOW_TOKENS) -> list[tuple[str, int, int]]:
    """``decode`` for a region of any length: segments are built and scored for ``window`` first tokens at a time.

    An entity has at most ``MAX_TOKENS`` tokens, so a place's best score is known once all segments that begin before it are, and
    features look a few tokens around. Of the whole region only token places and the program's choices are held (about 30 bytes a token).
    """
    lo, hi = token_borders(text, lo, hi)
    begin, end = array("q"), array("q")
    for m in _TOKEN.finditer(text, lo, hi):
        begin.append(m.start())
        end.append(m.end())
    n = len(begin)
    best, how, kinds = np.zeros(n + 1), np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int8)
    by_end: dict[int, list[tuple]] = {}
    for first in range(0, n, window):
        last = min(n, first + window)
        a, z = max(0, first - AROUND), min(n, last + MAX_TOKENS + AROUND)
        part = Region(text, begin[a], end[z - 1], blocked, list(zip(begin[a:z], end[a:z])))
        if part.segments:
            score = np.where(_allowed(part), part.features @ w.T, -1e9)
            kind, top = score.argmax(1), score.max(1)
            for s in np.flatnonzero(top > 0):  # a segment that scores less than outside tokens is in no best segmentation
                i, j = part.segments[s]
                if first <= a + i < last:
                    by_end.setdefault(a + j, []).append((not part.numeric[s], a + i, float(top[s]), int(kind[s])))
        for t in range(first + 1, last + 1):
            best[t] = best[t - 1]
            for _, i, v, k in sorted(by_end.pop(t, ()), key=lambda x: x[:2]):
                if best[i] + v > best[t]:
                    best[t], how[t], kinds[t] = best[i] + v, i, k
    out, t = [], n
    while t > 0:
        if how[t] < 0:
            t -= 1
        else:
            out.append((KINDS[kinds[t]], begin[how[t]], end[t - 1]))
            t = int(how[t])
    return out[::-1]


# ---------------------------------------------------------------- training
def _rewritten(kind: str, s: str, rng: random.Random) -> str | None:
    """Another written form of a base span, or None."""
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "email":
        local, _, domain = s.partition("@")
        at, dot = rng.choice([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", "."), (" [at] ", " [dot] "),
                              ("(at)", "."), (" {at} ", " {dot} ")])
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return s.replace(".", rng.choice(["[.]", "(.)"]))
    if kind == "card" and len(digits) == 16:
        return rng.choice(["/", "."]).join(digits[i:i + 4] for i in range(0, 16, 4))
    if kind == "phone" and len(digits) >= 10:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}"])
    return None


def _plain(rng: random.Random) -> str:
    """A number that is nobody's: dates, amounts, counts, identifiers."""
    n = rng.randint
    return rng.choice([
        f"{n(1990, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}", f"{n(1, 28):02d}/{n(1, 12):02d}/{n(1990, 2030)}",
        f"{n(1990, 2030)}-{n(1, 12):02d}-{n(1, 28):02d} {n(0, 23):02d}:{n(0, 59):02d}:{n(0, 59):02d}",
        str(n(10 ** 6, 10 ** 9)), str(n(10 ** 9, 10 ** 12)), str(n(10 ** 12, 10 ** 16)), f"{n(10 ** 5, 10 ** 8)}.{n(10, 99)}",
        f"{n(1, 9)}.{n(0, 20)}.{n(0, 99)}", f"{n(100, 9999)} {n(100, 9999)} {n(1, 99)}",
        f"978-{n(0, 9)}-{n(100, 999)}-{n(10000, 99999)}-{n(0, 9)}", f"{n(1000, 9999)}-{n(1000, 9999)}"])


def examples(rows: list[tuple[str, str, int, int, int]]) -> list[tuple[Region, list[tuple[str, int, int]]]]:
    """Training regions of sampled contexts ``(text, kind, start, end, seed)``; kind '' has no entity."""
    out = []
    for text, kind, a, b, seed in rows:
        rng = random.Random(seed)
        forms = [(text, a, b, kind)]
        if kind and (other := _rewritten(kind, text[a:b], rng)):
            forms.append((text[:a] + other + text[b:], a, a + len(other), kind))
        if kind:
            plain = _plain(rng)
            forms.append((text[:a] + plain + text[b:], a, a + len(plain), ""))
        for t, lo, hi, k in forms:
            gold = base_spans(t)
            if k and not any(x < hi and y > lo for _, x, y in gold):
                gold.append((k, lo, hi))
            elif not k and any(x < hi and y > lo for _, x, y in gold):
                continue  # the plain number happens to fit a pattern
            out.append((Region(t, 0, len(t), []), gold))
    return out


def train(rows: list[tuple[str, str, int, int, int]]) -> np.ndarray:
    """Weights ``[kind, feature]`` by stochastic gradient ascent on the conditional likelihood."""
    w, seen = np.zeros((len(KINDS), WIDTH)), np.full((len(KINDS), WIDTH), 1e-6)
    data = []
    for region, gold in examples(rows):
        if not region.segments:
            continue
        at = {(region.spans[i][0], region.spans[j - 1][1]): s for s, (i, j) in enumerate(region.segments)}
        hit = np.zeros((len(region.segments), len(KINDS)))
        for kind, a, b in gold:
            if (a, b) in at:
                hit[at[a, b], KINDS.index(kind)] = 1.0
        data.append((region, hit, _allowed(region)))
    rng = random.Random(7)
    for _ in range(EPOCHS):
        rng.shuffle(data)
        for region, hit, allowed in data:
            score = np.where(allowed, region.features @ w.T, -1e9)
            _, p = _log_partition(region, score)
            grad = (hit - p).T @ region.features - L2 * w
            seen += grad * grad
            w += RATE * grad / np.sqrt(seen)
    return w


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans (and uncovered digit regions) of sampled texts with the text around them."""
    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            spans = base_spans(text)
            found = [(k, x, y) for k, x, y in spans] + [("", x, y) for x, y in regions(text, [s[1:] for s in spans])][:2]
            for kind, x, y in found:
                lo, hi = (max(0, x - 40), min(len(text), y + 40)) if kind else (x, y)
                ctx = text[lo:hi]
                seed = int.from_bytes(hashlib.md5(ctx.encode("utf-8", "surrogatepass")).digest()[:7], "big")
                rows.append((ctx, kind, x - lo, y - lo, seed))
        yield pa.RecordBatch.from_pydict(dict(zip(
            ("ctx", "kind", "a", "b", "seed"), map(list, zip(*rows)) if rows else [[]] * 5)),
            schema=pa.schema([("ctx", pa.string()), ("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()),
                              ("seed", pa.int64())]))


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS,
          sample_regions: int = SAMPLE_REGIONS) -> np.ndarray | None:
    """Weights from a bounded sample: the documents with the smallest hash of id and text (copies once), then per kind the
    ``sample_regions / 5`` distinct contexts with the smallest hash. None if no base span was found."""
    from pyspark.sql import Window as W

    d = docs.where(F.col(text).isNotNull())
    sample = smallest_hashes(d.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.lit(0).alias("all")), "all",
                             ["id", "text"], sample_docs, "pii")
    sample = sample.select("text").repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ctx = sample.mapInArrow(_contexts, "ctx string, kind string, a int, b int, seed long").distinct()
    w = W.partitionBy("kind").orderBy("seed", "ctx", "a", "b")
    rows = ctx.withColumn("n", F.row_number().over(w)).where(F.col("n") <= sample_regions // 5).drop("n").collect()
    rows = sorted((tuple(r) for r in rows), key=lambda r: (r[4], r))
    return train(rows) if any(r[1] for r in rows) else None


# ---------------------------------------------------------------- all texts
def find(text: str, weights: np.ndarray | None) -> tuple[list, list]:
    """``(base spans, all spans)``, both by kind as listed, then by start."""
    base = base_spans(text)
    if weights is None:
        return base, base
    covered = sorted(s[1:] for s in base)
    starts = [a for a, _ in covered]
    reach = list(itertools.accumulate((b for _, b in covered), max))  # rises, so what ends before a place can be skipped
    added: list[tuple[str, int, int]] = []
    for lo, hi in regions(text, covered):
        lo, hi = token_borders(text, lo, hi)
        near = covered[bisect.bisect_right(reach, lo):bisect.bisect_left(starts, hi)]
        before = itertools.takewhile(lambda s: s[2] > lo, reversed(added))  # regions go upward and so do their spans
        added += decode_windows(text, lo, hi, near + [s[1:] for s in before], weights)
    if not added:
        return base, base
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def spans(df: DataFrame, weights: np.ndarray | None, text: str = "text", redact: bool = False) -> DataFrame:
    """The columns of ``df`` without ``text`` plus ``base`` and ``spans``: arrays of ``(kind, start, end)``.

    ``redact`` adds ``redacted``, the text with every span replaced by ``<KIND>`` (spans that
    overlap become one, named by the first). Narrow: one pass in Arrow batches.
    """
    sent = df.sparkSession.sparkContext.broadcast(weights)  # 4 x WIDTH numbers
    keep = [c for c in df.columns if c != text]
    span = "array<struct<kind:string,start:int,end:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            texts = b.column(text).to_pylist()
            found = [find(t or "", w) for t in texts]
            rows = [[[dict(zip(("kind", "start", "end"), s)) for s in part] for part in f] for f in found]
            cols = {c: b.column(c) for c in keep}
            cols |= {"base": pa.array([r[0] for r in rows], kind), "spans": pa.array([r[1] for r in rows], kind)}
            if redact:
                cols["redacted"] = pa.array([None if t is None else _redacted(t, f[1]) for t, f in zip(texts, found)],
                                            pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    schema = T.StructType([*df.drop(text).schema.fields, T.StructField("base", T._parse_datatype_string(span)),
                           T.StructField("spans", T._parse_datatype_string(span))])
    return df.mapInArrow(run, schema.add("redacted", T.StringType()) if redact else schema)


def _redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    out, done = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _listed(col: str):
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_pii_semicrf(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = spans(docs, learn(docs))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[n(k) for k in KINDS],
                      F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every span in the text becomes ``<KIND>``; ``n_chars`` follows the text."""
    weights = learn(docs)
    out = spans(nested(docs, "text"), weights, redact=True)
    new = {"text": F.col("redacted"), "n_chars": F.char_length("redacted").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


__all__ = ["base_spans", "decode", "examples", "find", "learn", "luhn", "op8_pii_semicrf", "redact", "regions",
           "spans", "train"]
