"""Sentences across languages and scripts, by a hidden-event n-gram language model.

Layout gives blocks: paragraphs, list items and headings. Within a block every gap after a mark that may end a sentence
(and, in scripts without marks, every blank) is a place where a boundary token may be hidden between two words. The model has the probability
of the event after a word, given whether an event came just before that word; the probability of a word at a
sentence's start; and that of a word going on after another. It is trained without labels over the documents
given: ends and starts of blocks are certain events, the rest are expectations, re-estimated on counts of word types. The posteriors of
the forward-backward algorithm over each block's gaps decide. In a block without any mark the gaps are those between all words:
there the event is as frequent as sentences are in the corpus, and what speaks for it are words that end blocks and words that begin them.

Word types with a thousandth or more of all gaps and ends, of which there are a thousand at most, are the model's own, as are the
shapes of all others: these are sent to the workers. The expectations are partial sums on the executors; what reaches the driver is a number or two per such type,
and pairs of them that hold a fiftieth of their left type, fifty at most of each. Every other type has values of its own too, from its own counts and its
shape's, in a table that is joined with the documents that have the type.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespark.plans.cuts import cut

ROUNDS = 8
#: A type of the model's own has this share of all gaps and ends, and this count, at least; the least count of a type in the table.
LEAST_SHARE, LEAST = 1e-3, 3
#: What is taken off the rarer outcome of a word, and off each pair's share: words are mostly of one kind, and pairs seen seldom are errors.
SHARPEN, DISCOUNT, EDGE = 0.1, 0.02, 0.002
#: How many occurrences its shape's share counts for beside a rarer type's own.
TRUST = 8.0
#: Words that a block without marks must have to be searched between all words; how often a sentence has one word only.
UNMARKED, SHORT = 8, 0.02

#: Marks that may end a sentence; those that need no blank after them; closing and opening signs.
MARKS = ".!?…。．！？｡।॥؟۔։።፧፨။༎།។៕"
WIDE = "。．！？｡…።፧፨။།༎។៕"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "“": "”", "„": "“", "«": "»", "‹": "›"}
CLOSING = set(PAIRS.values()) | {'"', "”", "’", "`"}
_OPENS = {c: "".join(o for o in PAIRS if PAIRS[o] == c) for c in PAIRS.values()}

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_HEAD = re.compile(r"[ ]{0,3}#{1,6}(?:[ \t]+|$)")
_ITEM = re.compile(r"[ \t]*(?:[-*+•‣]|\d{1,9}[.)])[ \t]+")
_BULLET = re.compile(r"[ \t]*[-*+•‣][ \t]+")
_RULE = re.compile(r"[ ]{0,3}(?:=+|-+|(?:[-_*][ \t]*){3,})[ \t]*$")
_FENCE = re.compile(r"[ ]{0,3}(```+|~~~+)")
_MARK = re.compile(f"[{re.escape(MARKS)}]+")
_SIGN = re.compile("[" + re.escape("".join({*PAIRS, *CLOSING} - {"’"})) + "]")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"\S+")
_THAI = re.compile(r"[฀-๿]")
_NARROW = re.compile(r"[ᄀ-ᇿ⺀-鿿가-힯豈-﫿＀-￯　-ヿ]")
#: Scripts that set blanks between phrases, not words: Thai, Lao, Tibetan, Myanmar, Khmer.
_PHRASED = re.compile(r"[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff]")
#: A unit of text that a boundary may follow where there is no mark: a sign of a script without blanks with what is written about it, or a word.
_UNIT = re.compile(r"(?:[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff]|[\u2e80-\u9fff\uf900-\ufaff\u3040-\u30ff])[\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u0eb1\u0eb4-\u0ebc\u0ec8-\u0ecd\u0f71-\u0fbc\u102b-\u103e\u17b4-\u17d3]*|[^\s\u0e00-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff]+")


def remembered(f: Callable[[str], str]) -> Callable[[str], str]:
    """``f`` of short strings, which come again and again, is looked up; long ones are not kept."""
    known = lru_cache(maxsize=1 << 16)(f)

    @wraps(f)
    def look(t: str) -> str:
        return known(t) if len(t) <= 48 else f(t)

    return look


def blocks(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the blocks of a text: ``text``, ``item`` and ``head``; fenced code, rules and markers are in none."""
    out: list[tuple[str, int, int]] = []
    kind, start, end, fence = "", 0, 0, ""

    def close() -> None:
        nonlocal kind
        if kind and end > start:
            out.append((kind, start, end))
        kind = ""

    at, size = 0, len(text)
    while at < size:
        m = _LINE.match(text, at)
        stop = m.end()
        line = text[at:stop].rstrip("\r\n")
        if fence:
            if line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                fence = ""
        elif not line.strip():
            close()
        elif f := _FENCE.match(line):
            close()
            fence = f[1]
        elif _RULE.match(line):
            if kind == "text":
                kind = "head"
            close()
        elif h := _HEAD.match(line):
            close()
            body = re.sub(r"[ \t]+#+[ \t]*$", "", line)
            kind, start, end = "head", at + h.end(), at + max(h.end(), len(body))
            close()
        elif (i := _ITEM.match(line)) and (not kind or kind == "item" or _BULLET.match(line)):
            close()
            kind, start, end = "item", at + i.end(), at + len(line)
        else:
            if not kind:
                kind, start = "text", at
            end = at + len(line)
        at = stop
    close()
    return out


def spans(block: str) -> list[tuple[int, int]]:
    """Matched quotations and brackets of a block as (place of the opening, place of the closing sign); what has no partner is none."""
    found, stack, open_ = [], [], Counter()

    def match(signs: str, at: int) -> bool:
        """Closes the last of ``signs`` that is open, and drops what was opened after it; looked for only if there is one, so each opening is passed once."""
        if not any(open_[c] for c in signs):
            return False
        while True:
            c, start = stack.pop()
            open_[c] -= 1
            if c in signs:
                found.append((start, at))
                return True

    for m in _SIGN.finditer(block):
        c, p = m[0], m.start()
        if c in '"`':
            done = match(c, p)
        else:
            done = match(_OPENS.get(c, ""), p) or c == "”" and match("“„", p)
        if not done and (c in PAIRS or c in '"`'):
            stack.append((c, p))
            open_[c] += 1
    return found


class Covered:
    """Whether a place lies in one of some spans, after its opening sign and up to its closing one."""

    def __init__(self, found: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(found):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def __contains__(self, place: int) -> bool:
        i = bisect_left(self.starts, place) - 1
        return i >= 0 and place <= self.ends[i]


@remembered
def shape(word: str) -> str:
    """What a word that is too rare to count by itself counts as."""
    lead = ""
    while word and not word[0].isalnum():
        if word[0] in PAIRS or word[0] in "\"'`¿¡":
            lead = word[0]
        word = word[1:]
    if not word:
        return lead + "?"
    c = word[0]
    if c.isdigit():
        kind = "0"
    elif _NARROW.match(c) or _THAI.match(c):
        kind = "W"
    elif c.isupper():
        kind = "X." if len(word) > 1 and word[1] == "." else "Xx" if word[1:2].islower() or len(word) == 1 else "XX"
    elif c.islower():
        kind = "x.x" if "." in word.rstrip(".,;:!?") else "x"
    else:
        kind = "a"
    return lead + kind


def right_type(block: str, at: int) -> str:
    """The type of the word that begins at ``at``: two characters where words aren't set off, four where phrases are, else up to the blank, digits as 0."""
    if _PHRASED.match(block, at):
        return block[at : at + 4]
    if _NARROW.match(block, at) and not "가" <= block[at] <= "힯":
        return block[at : at + 2]
    return _plain(_WORD.match(block, at)[0])


@remembered
def _plain(word: str) -> str:
    return _DIGITS.sub("0", word.rstrip(",;:"))


def left_type(block: str, start: int, mark: int, end: int) -> str:
    """The type of what precedes a gap: for a single full stop its word, for other marks these; with the signs that close after it."""
    marks = block[mark:end]
    if marks[0] != "." or marks[:2] == ".." or marks[:2] in (".!", ".?"):
        return re.sub(r"\s", "", marks)
    a = mark
    while a > start and not block[a - 1].isspace():
        a -= 1
    word = block[a:mark].lstrip("\"'“„«(「[`¿¡-–—#*")
    if len(word) == 1 and word.isupper():
        pass  # an initial, or an abbreviation of one letter
    elif re.fullmatch(r"[^\W\d_]{1,2}\.(?:-?[^\W\d_]{1,2}\.)*-?[^\W\d_]{1,2}", word) and word[0].isupper():
        word = "X.X"
    else:
        word = re.sub(r"\d+", "0", word.lower())
    return word + marks


@remembered
def left_shape(left: str) -> str:
    """What a rare word before a full stop counts as."""
    m = re.match(r"(.*?)(\.[^.]*)$", left)
    if not m or left[:1] in MARKS:
        return left if left.startswith("<") else "mark"
    body, tail = m.groups()
    if len(body) == 1 and body.isupper():
        return "X" + tail
    return ("0" if body[:1].isdigit() else "x.x" if "." in body or "_" in body or "/" in body else f"w{min(len(body), 4)}") + tail


def gaps(block: str) -> list[tuple[int, int, str, str, bool]]:
    """(end of the left side, start of the right, left type, right type, adjacent) of each gap that may hold a boundary.

    Adjacent: one word only since the gap before. In quotations and brackets there are none.
    """
    out: list[tuple[int, int, str, str, bool]] = []
    size = len(block)
    inner = spans(block)
    closers, covered = {b for _, b in inner}, Covered(inner)
    phrased = len(_PHRASED.findall(block)) * 3 > size
    places: list[tuple[int, int, int]] = []
    for m in _MARK.finditer(block):
        mark, end = m.start(), m.end()
        while end < size:
            if block[end] in CLOSING and (end in closers or block[end] in '”’"'):
                end += 1
            elif block[end] in "   " and end + 1 < size and block[end + 1] in "»›" and end + 1 in closers:
                end += 2
            elif block[end] in MARKS:
                end += 1
            else:
                break
        if end < size and (not places or places[-1][2] < end):
            places.append((mark, m.end(), end))
    if phrased:
        taken = {end for _, _, end in places}
        for m in _SPACE.finditer(block):
            if 0 < m.start() and m.end() < size and m.start() not in taken and (_PHRASED.match(block, m.start() - 1) or _PHRASED.match(block, m.end())):
                places.append((m.start(), m.start(), m.start()))
        places.sort()
    before = 0
    for mark, done, end in places:
        if end in covered:
            continue
        nxt = _SPACE.match(block, end)
        start = nxt.end() if nxt else end
        if start >= size:
            continue
        if not nxt and not (block[done - 1] in WIDE and block[start] not in "，、；：,;:)）"):
            continue
        if nxt and block[start] in ",;:，、；：)":
            continue
        left = "<blank>" if mark == end else left_type(block, before, mark, end)
        out.append((end, start, left, right_type(block, start), bool(out) and len(_UNIT.findall(block, out[-1][1], end)) == 1))
        before = start
    return out


@remembered
def word_type(unit: str) -> str:
    """The type of a word that may end or begin a sentence without a mark."""
    return _DIGITS.sub("0", unit.strip("\"'“”«»()[]「」『』,;:，、；：" + MARKS).lower()) or "?"


def between_words(block: str) -> list[tuple[int, int, str, str, bool]]:
    """The gaps between all units of a block, as ``gaps`` gives them; left types begin with a blank."""
    units = list(_UNIT.finditer(block))
    covered = Covered(spans(block))
    out = []
    for a, b in zip(units, units[1:]):
        if b.start() not in covered:
            out.append((a.end(), b.start(), " " + word_type(a[0]), right_type(block, b.start()), bool(out)))
    return out


def observed(text: str):
    """Yields what a text tells the model: ('start', type), ('end', type), ('on', type), ('last', word), ('gap', left, right, left before, right before or '')."""
    for kind, a, b in blocks(text):
        block = text[a:b].strip()
        if not block:
            continue
        if kind == "text":
            yield "start", right_type(block, 0), "", "", ""
        if kind == "head":
            continue
        found = gaps(block)
        m = None
        for m in _MARK.finditer(block):
            pass
        tail = m.end() if m else -1
        while 0 <= tail < len(block) and block[tail] in CLOSING | {" "}:
            tail += 1
        if m and tail >= len(block):
            yield "end", left_type(block, found[-1][1] if found else 0, m.start(), len(block)), "", "", ""
            units = _UNIT.findall(block[max(0, m.start() - 40) : m.start()])
            if units:
                yield "last", " " + word_type(units[-1]), "", "", ""
        starts = {g[1] for g in found}
        for w in _WORD.finditer(block):
            if w.start() and w.start() not in starts:
                yield "on", right_type(block, w.start()), "", "", ""
        for i, (_, _, left, right, near) in enumerate(found):
            yield ("gap", left, right, *((found[i - 1][2], found[i - 1][3]) if near else ("", "")))


class Model:
    """Tables of the hidden-event model; plain dictionaries, sent to workers as they are."""

    def __init__(self, lefts: set[str], rights: set[str]):
        self.lefts, self.rights = lefts, rights
        self.words = {word_type(t) for t in rights}
        self.event: dict[str, float] = {}
        self.event_after: dict[tuple[str, int], float] = {}
        self.first: dict[str, float] = {}
        self.on: dict[str, float] = {}
        self.after: dict[tuple[str, str], float] = {}
        self.weight: dict[str, float] = {}
        self.last: dict[str, float] = {}
        self.begins: dict[str, float] = {}
        self.base = 0.1

    def left(self, t: str) -> str:
        return t if t in self.lefts or t.startswith(" ") else left_shape(t)

    def right(self, t: str) -> str:
        return t if t in self.rights else shape(t)

    def odds(self, left: str, right: str, own: float | None = None) -> float:
        """Probability of the right word at a start, over that of its going on after the left; ``own`` is what a rarer word's own counts make of that at all."""
        s = self.first.get(right, 1e-6)
        plain = self.on.get(right, 1e-6)
        if own is not None:
            plain = s / max(own, 1e-9)
        w = self.weight.get(left, 0.0)
        c = w * self.after.get((left, right), 0.0) + (1 - w) * plain
        return s / max(c, 1e-9)

    def caseless(self, right: str) -> float:
        """How much likelier the word is to begin a sentence than to go on, whatever its case."""
        return self.begins.get(word_type(right), self.begins.get("", 1.0))

    def unmarked(self, left: str, own: float | None) -> float:
        """The event's prior after a word without a mark: how often there is one at all, times how much likelier the word is at a sentence's end."""
        ratio = own if own is not None else self.last.get(left[1:], self.last.get("", 1.0))
        x = self.base / (1 - self.base) * min(max(ratio, 1e-3), 1e3)
        return x / (1 + x)

    def prior(self, left: str, previous: int | None, own: float | None = None) -> float:
        if left.startswith(" "):
            return SHORT * self.base if previous else self.unmarked(left, own)
        if own is not None:
            return own
        some = self.event.get(left, 0.9 if left in ("mark", "<blank>") else 0.5)
        return some if previous is None else self.event_after.get((left, previous), some)

    def posteriors(self, chain: list[tuple[str, str]], lefts: dict | None = None, rights: dict | None = None) -> list[float]:
        """Forward-backward over gaps each of which is one word after the one before: P(event) at each. ``lefts`` and ``rights`` have the values of rarer types."""
        n = len(chain)
        lefts, rights = lefts or {}, rights or {}
        names = [self.left(a) for a, _ in chain]
        own = [lefts.get(a) for a, _ in chain]
        odds = [self.caseless(b) if x.startswith(" ") and not b[:1].isupper() else self.odds(x, self.right(b), rights.get(b)) for x, (_, b) in zip(names, chain)]
        emit = [(1.0, o) if o < 1 else (1 / o, 1.0) for o in odds]
        p = self.prior(names[0], None, own[0])
        f = [((1 - p) * emit[0][0], p * emit[0][1])]
        moves = [None]
        for i in range(1, n):
            a, b = self.prior(names[i], 0, own[i]), self.prior(names[i], 1, own[i])
            moves.append((a, b))
            x = (f[-1][0] * (1 - a) + f[-1][1] * (1 - b)) * emit[i][0], (f[-1][0] * a + f[-1][1] * b) * emit[i][1]
            z = (x[0] + x[1]) or 1.0
            f.append((x[0] / z, x[1] / z))
        g = (1.0, 1.0)
        out = [0.0] * n
        for i in range(n - 1, -1, -1):
            no, yes = f[i][0] * g[0], f[i][1] * g[1]
            out[i] = yes / ((no + yes) or 1.0)
            if i:
                a, b = moves[i]
                g = ((1 - a) * emit[i][0] * g[0] + a * emit[i][1] * g[1], (1 - b) * emit[i][0] * g[0] + b * emit[i][1] * g[1])
                z = max(g) or 1.0
                g = (g[0] / z, g[1] / z)
        return out


def _normed(c: dict[str, float], size: int) -> dict[str, float]:
    whole = sum(c.values()) + 0.02 * size
    return {k: (v + 0.02) / whole for k, v in c.items()}


def begin(totals: dict[tuple[str, str], float], lefts: set[str], rights: set[str]) -> Model:
    """The model before the first round, from the number of each (kind, type)."""
    m = Model(lefts, rights)
    of = lambda kind: {t: n for (k, t), n in totals.items() if k == kind}
    first, on, ends, seen = of("start"), of("on"), of("end"), of("gap")
    types = len({*first, *on}) + 1
    m.first, m.on = _normed(first, types), _normed(on, types)
    for t in {*ends, *seen}:  # an end of a block speaks for the event; its absence, the more the word occurs, against it
        e, s = ends.get(t, 0), seen.get(t, 0) + ends.get(t, 0)
        m.event[t] = min((e + 0.5) / (0.35 * s + e + 1.0), 0.98) if t != "<blank>" else 0.9  # no block ends in a blank, so that says nothing; it sets off phrases, mostly sentences
    return m


def expect(m: Model, windows) -> Counter:
    """Expected sums of (left, right, left before, right before, count): keys (what, a, b, part)."""
    out: Counter = Counter()
    for left, right, x, y, n in windows:
        if not x:
            p = m.posteriors([(left, right)])[0]
        else:
            q, p = m.posteriors([(x, y), (left, right)])
            for state, share in (("0", 1 - q), ("1", q)):
                out["N", left, state, 0] += n * share * p
                out["N", left, state, 1] += n * share
        out["L", left, "", 0] += n * p
        out["L", left, "", 1] += n
        out["R", right, "", 0] += n * p
        out["R", right, "", 1] += n * (1 - p)
        out["P", left, right, 0] += n * (1 - p)
    return out


def update(m: Model, totals: dict[tuple[str, str], float], sums: dict[tuple[str, str, str], tuple[float, float]]) -> None:
    """The model of the next round. Of pairs only those with more than a fiftieth of their left type count."""
    of = lambda kind: {t: n for (k, t), n in totals.items() if k == kind}
    ends, first, on, last = of("end"), Counter(of("start")), Counter(of("on")), of("last")
    left = {a: v for (w, a, _), v in sums.items() if w == "L"}
    for t in {*ends, *left}:
        yes, seen = left.get(t, (0.0, 0.0))
        share = (yes + ends.get(t, 0) + 0.25) / (seen + ends.get(t, 0) + 0.5)
        m.event[t] = min(max((share - SHARPEN) / (1 - 2 * SHARPEN), EDGE), 1 - EDGE)
    m.event_after = {(a, int(b)): (v + 2 * m.event[a]) / (n + 2) for (w, a, b), (v, n) in sums.items() if w == "N"}
    types = len({*first, *on}) + 1
    for (w, a, _), (yes, no) in sums.items():
        if w == "R":
            first[a] += yes
            on[a] += no
    m.first, m.on = _normed(first, types), _normed(on, types)
    off = {t: seen - yes for t, (yes, seen) in left.items()}
    kept = {(a, b): d for (w, a, b), (v, _) in sums.items() if w == "P" and (d := v - 1 - DISCOUNT * off[a]) > 0}
    over: Counter = Counter()
    for (a, _), v in kept.items():
        over[a] += v
    m.after = {k: v / over[k[0]] for k, v in kept.items()}
    m.weight = {t: over[t] / (v + 3.0) for t, v in off.items()}
    # sentences among words; how much likelier a word is at an end than anywhere
    words = sum(on.values()) + sum(first.values())
    m.base = min(max((sum(first.values()) + 1) / (words + 10), 1e-3), 0.3)
    whole = sum(last.values())
    every: Counter = Counter()
    for t, n in [*on.items(), *first.items()]:
        every[word_type(t)] += n
    starts: Counter = Counter()
    for t, n in first.items():
        starts[word_type(t)] += n
    begun = max(sum(first.values()), 1.0)
    # words that are never seen to begin anything do so the less, the more beginnings there are
    m.begins = {t: min(max(((starts[t] + 0.05) / begun) / ((n - starts[t] + 0.5) / max(words - begun, 1.0)), 1e-3), 1e3) for t, n in every.items()} | {"": 0.3}
    m.last = {}
    for t, n in last.items():
        if whole and every.get(t[1:]):
            m.last[t[1:]] = ((n + 0.5) / (whole + 1)) / ((every[t[1:]] + 1.0) / (words + 2))
    # words that aren't seen to end anything do so less than those that are, the less the more ends there are
    m.last[""] = 1.0 if not whole else max(0.05, 10 / (whole + 10))


def fit(counts: list[tuple[str, str, str, str, str, int]], lefts: set[str], rights: set[str], rounds: int = ROUNDS) -> Model:
    """Trains on (kind, a, b, left before, right before, count) in memory; ``train`` does the same with sums on the executors."""
    shapes = Model(lefts, rights)
    totals: Counter = Counter()
    windows = []
    for kind, a, b, x, y, n in counts:
        totals[kind, _typed(shapes, kind, a)] += n
        if kind == "gap":
            windows.append((shapes.left(a), shapes.right(b), shapes.left(x) if x else "", shapes.right(y) if x else "", n))
    m = begin(totals, lefts, rights)
    for _ in range(rounds):
        sums: dict = {}
        for (what, a, b, part), v in expect(m, windows).items():
            now = sums.setdefault((what, a, b), [0.0, 0.0])
            now[part] += v
        update(m, totals, {k: tuple(v) for k, v in sums.items()})
    return m


def _typed(m: Model, kind: str, t: str) -> str:
    if kind == "last":
        return t if t[1:] in m.words else " " + shape(t[1:])
    return m.left(t) if kind in ("end", "gap") else m.right(t)


#: A block as it is decided upon: where it begins, its length, its gaps.
Block = tuple[int, int, list]


def compiled(text: str, unmarked: bool) -> list[Block]:
    """The blocks of a text with their gaps; with ``unmarked`` a block without any mark has those between all words."""
    out: list[Block] = []
    for kind, a, b in blocks(text):
        raw = text[a:b]
        block = raw.strip()
        if not block:
            continue
        a += len(raw) - len(raw.lstrip())
        found = gaps(block) if kind != "head" else []
        if unmarked and kind != "head" and not found and not _MARK.search(block):
            every = between_words(block)
            found = every if len(every) >= UNMARKED else []
        out.append((a, len(block), found))
    return out


def decided(parts: list[Block], model: Model, lefts: dict | None = None, rights: dict | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of compiled blocks."""
    out: list[tuple[int, int]] = []
    for a, size, found in parts:
        at = i = 0
        while i < len(found):
            j = i + 1
            while j < len(found) and found[j][4]:
                j += 1
            for g, p in zip(found[i:j], model.posteriors([(g[2], g[3]) for g in found[i:j]], lefts, rights)):
                if p > 0.5:
                    out.append((a + at, a + g[0]))
                    at = g[1]
            i = j
        out.append((a + at, a + size))
    return out


def sentences_of(text: str, model: Model, unmarked: bool = False, lefts: dict | None = None, rights: dict | None = None) -> list[tuple[int, int]]:
    """(start, end) in code points of the sentences of a text."""
    return decided(compiled(text, unmarked), model, lefts, rights)


@dataclass
class Trained:
    """The model that is sent to workers, and the table ``side, type, value`` of the rarer types."""

    model: Model
    rarer: DataFrame


_COUNTS = "kind string, a string, b string, x string, y string, n bigint"
_SUMS = "what string, a string, b string, v double, w double"


def _counted(c: Counter) -> pa.RecordBatch:
    keys = list(c)
    return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(5)), pa.array([c[k] for k in keys], pa.int64())], ["kind", "a", "b", "x", "y", "n"])


def _summed(c: dict) -> pa.RecordBatch:
    keys = list(c)
    return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), *(pa.array([c[k][i] for k in keys], pa.float64()) for i in range(2))], ["what", "a", "b", "v", "w"])


def train(documents: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Trained:
    """Counts over the documents given, then the fit by expectation-maximisation from the certain events."""
    context = documents.sparkSession.sparkContext

    def run(batches):
        for batch in batches:
            c = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    c.update(observed(t))
            yield _counted(c)

    seen = documents.select(F.col(text).cast("string")).mapInArrow(run, _COUNTS)
    counts = cut(seen.groupBy("kind", "a", "b", "x", "y").agg(F.sum("n").alias("n")), "events")

    # ends decide which words before a mark are worth a type; starts and gaps which words after it
    sides = counts.where("kind in ('end', 'gap')").select(F.lit("l").alias("side"), "a", "n")
    sides = sides.unionByName(counts.where("kind = 'start'").select(F.lit("r").alias("side"), "a", "n")).unionByName(counts.where("kind = 'gap'").select(F.lit("r").alias("side"), F.col("b").alias("a"), "n"))
    often = cut(sides.groupBy("side", "a").agg(F.sum("n").alias("n")), "types")
    whole = {r["side"]: r["n"] for r in often.groupBy("side").agg(F.sum("n").alias("n")).collect()}
    enough = lambda side: max(LEAST, LEAST_SHARE * whole.get(side, 0))
    top = often.where((F.col("side") == "l") & (F.col("n") >= enough("l")) | (F.col("side") == "r") & (F.col("n") >= enough("r"))).collect()
    left, right = ({r["a"] for r in top if r["side"] == s} for s in "lr")
    shapes = Model(left, right)

    def typed(batches):
        to_left, to_right = (lambda t: shapes.left(t) if t else t), (lambda t: shapes.right(t) if t else t)
        for batch in batches:
            c = Counter()
            for kind, a, b, x, y, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
                c[kind, _typed(shapes, kind, a), to_right(b), to_left(x), to_right(y)] += n
            yield _counted(c)

    small = cut(counts.mapInArrow(typed, _COUNTS).groupBy("kind", "a", "b", "x", "y").agg(F.sum("n").alias("n")), "typed")
    totals = {(r["kind"], r["a"]): r["n"] for r in small.groupBy("kind", "a").agg(F.sum("n").alias("n")).collect()}
    model = begin(totals, left, right)
    windows = small.where("kind = 'gap'").select("a", "b", "x", "y", "n")
    for _ in range(rounds):
        sent = context.broadcast(model)

        def step(batches, sent=sent):
            for batch in batches:
                sums: dict = {}
                for (what, a, b, part), v in expect(sent.value, zip(*(c.to_pylist() for c in batch.columns))).items():
                    sums.setdefault((what, a, b), [0.0, 0.0])[part] += v
                yield _summed(sums)

        sums = cut(windows.mapInArrow(step, _SUMS).groupBy("what", "a", "b").agg(F.sum("v").alias("v"), F.sum("w").alias("w")), "sums")
        off = sums.where("what = 'L'").select(F.col("a").alias("_a"), (F.col("w") - F.col("v")).alias("_off"))
        pairs = sums.where("what = 'P'").join(off, F.col("a") == F.col("_a")).where(F.col("v") - 1 - DISCOUNT * F.col("_off") > 0).select("what", "a", "b", "v", "w")
        got = sums.where("what != 'P'").unionByName(pairs).collect()
        update(model, totals, {(r["what"], r["a"], r["b"]): (r["v"], r["w"]) for r in sorted(got)})
    return Trained(model, _rarer(counts, model))


def _rarer(counts: DataFrame, model: Model) -> DataFrame:
    """``side, type, value`` of types with a count of ``LEAST`` or more that aren't the model's own.

    Left: the event's probability, from the posteriors at the type's own gaps, its ends, and its shape's probability for ``TRUST`` more. Right: how much likelier the
    word is to begin than to go on. Word: how much likelier it is to end a block than to stand anywhere.
    """
    sent = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            sums: dict = {}

            def add(side, t, v, w, sums=sums):
                now = sums.setdefault((side, t, ""), [0.0, 0.0])
                now[0] += v
                now[1] += w

            for kind, a, b, x, y, n in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == "gap":
                    p = m.posteriors([(x, y), (a, b)])[1] if x else m.posteriors([(a, b)])[0]
                    if m.left(a) != a:
                        add("l", a, n * p, n)
                    if m.right(b) != b:
                        add("r", b, n * p, n * (1 - p))
                    add("w", " " + word_type(b), 0.0, n)
                elif kind == "end" and m.left(a) != a:
                    add("l", a, n, n)
                elif kind in ("start", "on"):
                    if m.right(a) != a:
                        add("r", a, n if kind == "start" else 0.0, n if kind == "on" else 0.0)
                    add("w", " " + word_type(a), 0.0, n)
                elif kind == "last":
                    add("w", a, n, 0.0)
            yield _summed(sums)

    sums = counts.mapInArrow(run, _SUMS).groupBy("what", "a").agg(F.sum("v").alias("v"), F.sum("w").alias("w")).where(F.greatest(F.col("w"), F.col("v")) >= LEAST)
    total = sums.where("what = 'w'").agg(F.sum("v").alias("v"), F.sum("w").alias("w")).first()
    ends, words = (total["v"] or 0.0) + 1, (total["w"] or 0.0) + 2

    def values(batches):
        m = sent.value
        for batch in batches:
            out = []
            for what, a, v, w in zip(*(c.to_pylist() for c in batch.columns)):
                if what == "l":
                    share = (v + TRUST * (SHARPEN + (1 - 2 * SHARPEN) * m.event.get(m.left(a), 0.5))) / (w + TRUST)
                    out.append(min(max((share - SHARPEN) / (1 - 2 * SHARPEN), EDGE), 1 - EDGE))
                elif what == "r":
                    kind = m.right(a)
                    first, on = m.first.get(kind, 1e-6), m.on.get(kind, 1e-6)
                    ratio = first / on
                    share = ratio * m.base / (1 - m.base + ratio * m.base)
                    out.append((v + TRUST * share) / (w + TRUST * (1 - share)) * (1 - m.base) / m.base)
                else:
                    out.append(((v + 0.5) / ends) / ((w + 1.0) / words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["side", "type", "value"])

    return cut(sums.mapInArrow(values, "side string, type string, value double"), "rarer")


def sentences(documents: DataFrame, trained: Trained, key: str = "doc_id", text: str = "text", unmarked: bool = False) -> DataFrame:
    """``key, start_char, end_char`` of every sentence of every row, in code points, the end exclusive.

    With ``unmarked`` blocks without any mark are searched between all words. Null, empty and blank texts have no sentences; a text without marks
    has one per block, or with ``unmarked`` those the words tell of. Repeated rows repeat; other columns are not read. Texts are compiled to their gaps once; those
    with rarer types meet the values of these by joins on the type and on a number of the row, and no text is shuffled.
    """
    kind = documents.schema[key].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(trained.model)

    def compile_(batches):
        m = sent.value
        for batch in batches:
            packed, types = [], []
            for t in batch.column(1).to_pylist():
                parts = compiled(t or "", unmarked)
                some = {("w" if g[2][0] == " " else "l") + g[2] for _, _, found in parts for g in found if g[2][0] == " " or m.left(g[2]) != g[2]}
                some |= {"r" + g[3] for _, _, found in parts for g in found if m.right(g[3]) != g[3]}
                types.append(sorted(some))
                packed.append(pickle.dumps(parts, protocol=5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(types, pa.list_(pa.string()))], [key, "_parts", "_types"])

    made = documents.select(F.col(key), F.col(text).cast("string")).mapInArrow(compile_, f"`{key}` {kind}, _parts binary, _types array<string>")
    made = cut(made.withColumn("_row", F.monotonically_increasing_id()), "compiled")
    values = trained.rarer.select(F.concat("side", "type").alias("_type"), "value")
    met = made.select("_row", F.explode("_types").alias("_type")).join(values, "_type").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_type", "value"))).alias("_values"))
    ready = made.drop("_types").join(met, "_row", "left").select(key, "_parts", "_values")

    def decide(batches):
        m = sent.value
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, (parts, values) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                values = values or []
                own = {t[1:]: v for t, v in values if t[0] in "lw"}, {t[1:]: v for t, v in values if t[0] == "r"}
                for a, b in decided(pickle.loads(parts), m, *own):
                    rows.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [key, "start_char", "end_char"])

    return ready.mapInArrow(decide, f"`{key}` {kind}, start_char int, end_char int")
