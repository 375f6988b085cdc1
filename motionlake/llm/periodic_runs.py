"""Periodic runs of words: a harmonic grid of longest-common-extension queries.

The words of a text are numbered, and for every period p the grid of places
0, p, 2p, ... is laid over it. The two neighbours jp and (j+1)p are extended
forwards and backwards by what they have in common; a periodic stretch shows as
extensions that cover it. An extension is one range-minimum query over the common
prefixes of neighbours in the suffix array, and backwards over the same of the
reversed array. n words have about n ln n grid places, so all periods together
take little more than one pass.

A run has four periods at least, so four places of its own grid lie in it and hold
the same word. Places where that fails are passed over without a query, and a
text without such places gets no suffix array.

Texts are taken in packs of bounded size (a longer text is a pack of its own); the
words of one text are kept apart from those of any other, so that nothing
extends from text to text. One text needs memory in proportion to its words times
the logarithm of its longest repeat.

Defined cases: null counts as empty; texts without words have no runs and nulls for
the greatest one; a null doc_id passes through and, having no hash, leaves its text as it is;
repeated rows are answered each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH, LEAST_PERIODS = 6, 4
PACK_WORDS = 1 << 17
GRID_PLACES = 1 << 20
OUT = ["n_runs", "start", "length", "period", "exponent_milli"]


class Extensions:
    """Longest common extensions of two places of an array: suffix array, common prefixes of its neighbours, range minima.

    Suffixes are sorted by doubling; those already apart from all others are left out of the later
    rounds. Two places have the same rank in a round if their next 2^round symbols agree.
    """

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        ranks = [self._ranked(order, symbols[order], np.arange(n), n)]
        open_ = self._tied(order, ranks[0])
        width = 1
        while len(open_):
            rank = ranks[-1]
            behind = open_ + width
            next_ = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
            key = rank[open_].astype(np.int64) * (n + 2) + next_
            by = np.argsort(key, kind="stable")
            open_, key = open_[by], key[by]
            first = np.flatnonzero(np.r_[True, rank[open_[1:]] != rank[open_[:-1]]])
            place = rank[open_] + np.arange(len(open_)) - np.repeat(first, np.diff(np.r_[first, len(open_)]))
            new = rank.copy()
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            new[open_] = np.repeat(place[starts], np.diff(np.r_[starts, len(open_)]))
            ranks.append(new)
            open_ = self._tied(open_, new)
            width *= 2
        self.place = ranks[-1]
        self.common = self._common(ranks, np.argsort(self.place, kind="stable"))
        self.minima = [self.common]

    @staticmethod
    def _ranked(order, values, places, n) -> np.ndarray:
        """The place of the first of its equals, for each symbol."""
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if n else np.zeros(0, int)
        rank = np.empty(n, np.int32)
        rank[order] = np.repeat(places[starts], np.diff(np.r_[starts, n]))
        return rank

    @staticmethod
    def _tied(order, rank) -> np.ndarray:
        """Of places in their order, those that share their rank with a neighbour."""
        r = rank[order]
        same = r[1:] == r[:-1]
        return order[np.r_[False, same] | np.r_[same, False]] if len(r) else order

    def _common(self, ranks: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Of each suffix and the one sorted before it, the length of their common prefix."""
        out = np.zeros(self.n, np.int32)
        first = ranks[0][order]
        at = np.flatnonzero(first[1:] == first[:-1]) + 1
        a, b = order[at - 1].astype(np.int64), order[at].astype(np.int64)
        length = np.zeros(len(at), np.int32)
        for k in reversed(range(len(ranks))):
            inside = np.maximum(a, b) < self.n
            same = inside & (ranks[k][np.where(inside, a, 0)] == ranks[k][np.where(inside, b, 0)])
            step = same.astype(np.int32) << k
            length += step
            a, b = a + step, b + step
        out[at] = length
        return out

    def _minimum(self, level: int) -> np.ndarray:
        while len(self.minima) <= level:
            half = 1 << (len(self.minima) - 1)
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last)
        return self.minima[level]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the symbols from places a and b agree; a != b."""
        x, y = self.place[a], self.place[b]
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int32)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self._minimum(k)
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        return out


def grid(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the grid where four places in a row hold the same symbol, over all texts and periods."""
    longest = np.maximum(sizes // LEAST_PERIODS, 0)
    longest[sizes < LEAST_LENGTH] = 0
    text = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    tries = (sizes[text] - 1) // period + 1 - (LEAST_PERIODS - 1)
    upto = np.cumsum(tries)
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + GRID_PLACES, "right")))
        p, t = period[lo:hi], tries[lo:hi]
        each = np.repeat(p, t)
        at = np.repeat(starts[text[lo:hi]], t) + each * (np.arange(len(each)) - np.repeat(np.cumsum(t) - t, t))
        keep = np.flatnonzero(symbols[at] == symbols[at + each])
        for times in range(2, LEAST_PERIODS):
            keep = keep[symbols[at[keep]] == symbols[at[keep] + times * each[keep]]]
        places.append(at[keep])
        periods.append(each[keep])
        lo = hi
    return np.concatenate(places), np.concatenate(periods)


def runs_of(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and least period of every run, by start, then period. No symbol occurs in two texts."""
    ends = np.cumsum(sizes)
    at, period = grid(symbols, ends - sizes, sizes)
    if not len(at):
        return at, at, period
    # suffix arrays only of the texts in which something is asked
    asked = np.unique(np.searchsorted(ends, at, "right"))
    inner = np.cumsum(sizes[asked])
    part = np.concatenate([symbols[e - s : e] for e, s in zip(ends[asked].tolist(), sizes[asked].tolist())])
    shift = (ends[asked] - sizes[asked]) - (inner - sizes[asked])
    own = at - shift[np.searchsorted(asked, np.searchsorted(ends, at, "right"))]
    n = len(part)
    after, before = Extensions(part), Extensions(part[::-1])
    # place i stands at n - 1 - i of the reversed array; what lies before i is extended from n - i
    found = []
    for lo in range(0, len(own), GRID_PLACES):
        o, p = own[lo : lo + GRID_PLACES], period[lo : lo + GRID_PLACES]
        back = np.zeros(len(o), np.int32)
        inside = np.flatnonzero(o > 0)
        back[inside] = before.of(n - o[inside], n - o[inside] - p[inside])
        length = p + after.of(o, o + p) + back
        good = length >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * p)
        found.append(np.unique(np.stack([(at[lo : lo + GRID_PLACES] - back)[good], length[good], p[good]]), axis=1))
    start, length, period = np.concatenate(found, axis=1)
    # a stretch has the same ends under each multiple of its least period
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    first = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, length, period = start[first], length[first], period[first]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def tailed(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document, by the hash of its id, gets a periodic tail of its own words."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // len(tail) + 1))[: n - a]


def described(words: list[bytes], start: list[int], length: list[int], period: list[int]) -> tuple:
    """The figures of one text; its runs in order of start, then period."""
    collapsed = words
    best = (None, None, None, None)
    if start:
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, np.add(start, period), 1)
        np.add.at(edges, np.add(start, length), -1)
        collapsed = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
        ratio = np.divide(length, period)
        near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9)).tolist()
        i = max(near, key=lambda i: (Fraction(length[i], period[i]), -start[i], -period[i]))
        best = (start[i], length[i], period[i], 1000 * length[i] // period[i])
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in zip(start, length, period)).encode()
    return (len(start), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed)).hexdigest())


def pack_runs(texts: list[list[bytes]]) -> Iterator[tuple]:
    """described() for each text of a pack."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter((known[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    symbols = ids + np.repeat(np.arange(len(texts)), sizes) * max(1, len(known))
    start, length, period = runs_of(symbols, sizes)
    ends = np.cumsum(sizes)
    to = np.searchsorted(start, ends).tolist()
    for words, end, size, lo, hi in zip(texts, ends.tolist(), sizes.tolist(), [0, *to], to):
        yield described(words, (start[lo:hi] - (end - size)).tolist(), length[lo:hi].tolist(), period[lo:hi].tolist())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_tails: bool = False, pack_words: int = PACK_WORDS) -> DataFrame:
    """id, n_runs, the greatest run and the digests of all runs and of the text with runs cut to one period.

    with_tails puts periodic tails on a tenth of the documents first (see tailed), by their integer ids.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"{id_col} {id_type}, {', '.join(f'{c} bigint' for c in OUT)}, runs_sha256 string, collapsed_sha256 string"
    kinds = [*[pa.int64()] * len(OUT), pa.string(), pa.string()]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list[pa.Array], texts: list[list[bytes]]) -> pa.RecordBatch:
            columns = list(zip(*pack_runs(texts)))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *arrays], [id_col, *OUT, "runs_sha256", "collapsed_sha256"])

        ids, texts, held = [], [], 0
        for b in batches:
            lo = 0
            for k, (i, t) in enumerate(zip(b.column(0), b.column(1))):
                words = t.as_buffer().to_pybytes().split()
                if with_tails:
                    words = tailed(words, i.as_py())
                if held and held + len(words) > pack_words:
                    if k > lo:
                        ids.append(b.column(0).slice(lo, k - lo))
                    yield done(ids, texts)
                    ids, texts, held, lo = [], [], 0, k
                texts.append(words)
                held += len(words)
            if b.num_rows > lo:
                ids.append(b.column(0).slice(lo))
        if texts:
            yield done(ids, texts)

    return rows.mapInArrow(found, schema)
