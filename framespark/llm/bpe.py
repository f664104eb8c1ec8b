"""Token ids of whole corpora by a public byte-level BPE, with a pair occurrence index.

Texts of a batch are joined and cut into words (the pre-tokens of the vocabulary's pattern) by array
operations over their code points. Each distinct word is encoded once: all new words of a batch
lie in one array of symbols, an index maps every mergeable pair to all its positions, and
pairs are merged in ascending rank; each merge updates the lists of the pairs it touches. A pair made by a
merge has a higher rank than the merge, so one pass over the ranks in use ends the work.
"""

from __future__ import annotations

import heapq
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters handled at once, and distinct words kept by a worker before it starts anew: bounds of memory, not of the result.
BATCH_CHARS, KEPT_WORDS = 2_000_000, 1_000_000
OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
#: Unicode's white space.
BLANKS = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """The vocabulary's file: in ``folder``, or where the installed package of public tokenizers has it."""
    if folder is None:
        folder = os.environ.get("TOKENIZERS", "/opt/tokenizers")
        if not os.path.exists(folder):
            import public_tokenizers

            return str(public_tokenizers.path(name))
    return os.path.join(folder, name)


def byte_letters() -> dict[int, str]:
    """The printable letter by which the vocabulary writes each byte: itself if printable, else the next unused code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def classes() -> np.ndarray:
    import regex

    table = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    at = lambda i: i if i < 0xD800 else i + 0x800
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, everything):
            table[at(m.start()) : at(m.end() - 1) + 1] = kind
    table[BLANKS] = BLANK
    return table


def word_starts(points: np.ndarray, firsts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where words start in the joined texts; ``firsts`` are the starts of the non-empty texts.

    The pattern's alternatives as rules over runs of one class: a contraction after no blank, then a run of
    letters, numbers or others with a blank before it, then blanks, of which the last is left to what follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = table[points]
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= first[:n]
    start = change.copy()
    run = np.flatnonzero(change)
    end = np.append(run[1:], n)
    # blanks followed by something in the same text
    blank = (kind[run] == BLANK) & ~first[end]
    last = end[blank] - 1
    start[last] = True
    spaced = last[points[last] == 0x20] + 1
    start[spaced] = False
    # contractions
    quote = np.flatnonzero((points == 0x27) & start)
    quote = quote[(quote + 1 < n)]
    quote = quote[~first[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        one = points[quote + 1]
        two = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long_ = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        some = short | long_
        start[quote[some] + 1] = False
        after = quote[some] + np.where(short[some], 2, 3)
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Words(dict):
    """Numbers for words; those met for the first time are kept in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte = [vocab[c] for _, c in sorted(byte_letters().items())]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.pairs = [None] * len(self.merges)
        for key, (rank, made) in self.merges.items():
            self.pairs[rank] = (key >> 32, key & 0xFFFFFFFF, made)
        self.table = classes()
        self.clear()

    def clear(self) -> None:
        self.words = Words()
        self.at, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all ``words``, number of ids of each), by the pair occurrence index."""
        symbol: list[int] = []
        bounds = [0]
        for w in words:
            symbol += [self.byte[b] for b in w.encode()]
            bounds.append(len(symbol))
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for b in bounds[1:]:
            if b:
                after[b - 1] = -1
            if b < n:
                before[b] = -1
        known, where = self.merges, {}
        for p in range(n):
            q = after[p]
            if q >= 0 and (hit := known.get(symbol[p] << 32 | symbol[q])):
                where.setdefault(hit[0], []).append(p)
        ranks = list(where)
        heapq.heapify(ranks)
        while ranks:
            rank = heapq.heappop(ranks)
            a, b, made = self.pairs[rank]
            for p in sorted(where.pop(rank)):
                q = after[p]
                if symbol[p] != a or q < 0 or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = made, -1
                right = after[p] = after[q]
                if right >= 0:
                    before[right] = p
                    if hit := known.get(made << 32 | symbol[right]):
                        if hit[0] not in where:
                            where[hit[0]] = []
                            heapq.heappush(ranks, hit[0])
                        where[hit[0]].append(p)
                left = before[p]
                if left >= 0 and (hit := known.get(symbol[left] << 32 | made)):
                    if hit[0] not in where:
                        where[hit[0]] = []
                        heapq.heappush(ranks, hit[0])
                    where[hit[0]].append(left)
        ids = np.array(symbol, np.int32)
        alive = np.concatenate([[0], np.cumsum(ids >= 0)])
        return ids[ids >= 0], np.diff(alive[np.array(bounds)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all their ids); a null text has none."""
        if len(self.words) > KEPT_WORDS:
            self.clear()
        full = [t or "" for t in texts]
        joined = "".join(full)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.concatenate([[0], np.cumsum([len(t) for t in full])]).astype(np.int64)
        starts = word_starts(points, edges[:-1][np.diff(edges) > 0], self.table)
        cuts = starts.tolist()
        number = np.fromiter(map(self.words.__getitem__, map(joined.__getitem__, map(slice, cuts, [*cuts[1:], len(joined)]))), np.int64, len(cuts))
        if self.words.new:
            ids, sizes = self.merge(self.words.new)
            self.words.new = []
            offset = len(self.pool) + np.cumsum(sizes) - sizes
            self.at, self.size, self.pool = np.append(self.at, offset), np.append(self.size, sizes), np.append(self.pool, ids)
        size = self.size[number]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.pool[np.repeat(self.at[number] - total[:-1], size) + np.arange(total[-1])]
        return np.diff(total[np.searchsorted(starts, edges)]), flat


_ENCODERS: dict[str, Encoder] = {}


_SENT: set[tuple[str, str]] = set()


def send(spark, path: str) -> None:
    """Sends the vocabulary's file from the driver to the executors, once an application, so that they need not have it installed."""
    context = spark.sparkContext
    if (context.applicationId, path) not in _SENT:
        _SENT.add((context.applicationId, path))
        context.addFile(path)


def received(path: str) -> str:
    """The file on a worker: as sent, or where it lies if nothing was."""
    from pyspark import SparkFiles

    sent = SparkFiles.get(os.path.basename(path))
    return sent if os.path.exists(sent) else path


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _groups(texts: list[str | None]):
    group, chars = [], 0
    for t in texts:
        if group and chars + len(t or "") > BATCH_CHARS:
            yield group
            group, chars = [], 0
        group.append(t)
        chars += len(t or "")
    if group:
        yield group


def _encoded(documents: DataFrame, key: str, text: str, path: str, counts_only: bool) -> DataFrame:
    kind = documents.schema[key].dataType.simpleString()
    send(documents.sparkSession, path)

    def run(batches):
        made = encoder(received(path))
        for batch in batches:
            done = 0
            for group in _groups(batch.column(1).to_pylist()):
                sizes, ids = made.encode(group)
                keys = batch.column(0).slice(done, len(group))
                done += len(group)
                if counts_only:
                    out = pa.array(sizes, pa.int64())
                else:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    out = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, out], [key, "n_tokens" if counts_only else "ids"])

    return documents.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens bigint" if counts_only else "ids array<int>"))


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids`` for every row: whole texts, no special tokens; empty for an empty and for a null text. No shuffle.

    Strings that look like special tokens are ordinary text. Repeated rows come out repeated; other columns are not read. Executors need the
    vocabulary file at ``path``.
    """
    return _encoded(documents, key, text, path or vocabulary_path(), False)


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, n_tokens``: as ``encode``, with the number of ids in place of them."""
    return _encoded(documents, key, text, path or vocabulary_path(), True)
