"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased and their white space runs become one space. An item of m
characters may be met with k = floor(edit_share * m) edits. By the q-gram lemma a region
within k edits shares at least m - q + 1 - k * q of the item's q-grams, all on at
most k + 1 neighbouring diagonals (position in the text minus position in the
item). So hits are counted in diagonal bands of k + 1, two neighbours of which hold such a
run; where the two reach the bound, item and text are aligned on their diagonals and the k on
either side (edits at an item's ends leave no hits), free at both ends of the text, and kept
within k edits.

q is 8, and m // (k + 1) for items so short that the bound would fall below 1 with it; items
of less than 8 characters have no edits and must stand between spaces.

A q-gram that an item repeats more than ``REPEATS`` times is not counted, and the item's
bound falls by its places; an item (or piece) that is left without a bound is aligned with
whole texts. So what a text of one repeated phrase lists is bounded.

Passages: an item of more than ``PIECE`` characters is also cut into overlapping pieces
of that length, one every ``STEP`` characters, each with its own budget and bound. An
item that is not met as a whole is reported with its best piece, and edits are then
those of the piece. So a verbatim passage of PIECE + STEP - 1 characters is always
found; of 100 characters almost every one is (measured, see README). Parts of items of up to PIECE characters are not reported.

Items go to the executors in blocks of at most ``block_chars`` characters, one
pass over the texts for each block; documents are never shuffled. Long texts are
hashed window by window.

Defined cases: null and empty texts or items match nothing; a null doc_id or
item_id is carried along; items that repeat are reported each; repeated rows are
reported each; an empty table of either kind gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

Q = 8
EDIT_SHARE = 0.1
PIECE = 96
STEP = 16
REPEATS = 8
BLOCK_CHARS = 4_000_000
WINDOW = 1 << 20
_TABLE_BITS = 22
_MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_FAR = 1 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of the q-grams of c, by doubling; q is 8 at most."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    h, held = c.astype(np.uint64), 1
    for by in _MULTIPLIERS:
        reach = min(held, q - held)
        if not reach:
            break
        h = (h[:-reach] * by) ^ (h[reach:] + (h[reach:] << np.uint64(7)))
        h ^= h >> np.uint64(29)
        held += reach
    return h * _MULTIPLIERS[0]


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int, free: bool = True) -> tuple[int, int] | None:
    """The least edits between item and a substring of text, and that substring's end; None beyond most.

    Only diagonals (place in the text minus place in the item) from low to high are looked at: one cell a
    diagonal and item character. The substring begins anywhere, or at 0 unless free.
    """
    m, n, at = len(item), len(text), np.arange(high - low + 1)
    padded = np.full(m + len(at), 0xFFFFFFFF, np.uint32)  # beyond the text nothing is equal
    a, b = max(low, 0), min(high + m, n)
    if a < b:
        padded[a - low : b - low] = text[a:b]
    row = np.zeros(len(at), np.int32) if free else np.where(at + low >= 0, at + low, _FAR).astype(np.int32)
    new = np.empty_like(row)
    for i in range(m):
        np.add(row, padded[i : i + len(at)] != item[i], out=new)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - at) + at
        if i % 8 == 7 and row.min() > most:
            return None
    d = int(row.argmin())
    return (int(row[d]), min(max(m + low + d, 0), n)) if row[d] <= most else None


class Unit:
    """What is met as one: an item, or a piece of one."""

    def __init__(self, text: str, edit_share: float):
        self.text, self.codes = text, codes(text)
        self.size = len(self.codes)
        self.edits = math.floor(edit_share * self.size + 1e-9)
        self.q = min(Q, self.size // (self.edits + 1))

    def met(self, text: str, c: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
        """start, end and edits of the best region on the diagonals from low to high."""
        at = text.find(self.text, max(low, 0), max(0, min(len(c), high + self.size)))
        if at >= 0:
            return at, at + len(self.text), 0
        ended = align(self.codes, c, low, high, most)
        if ended is None:
            return None
        edits, end = ended
        shift = end - self.size  # the same from the right, where diagonals are mirrored, gives where it begins
        began = align(self.codes[::-1], c[:end][::-1], shift - high, shift - low, edits, False)
        return end - (began[1] if began else self.size), end, edits


class Index:
    """The q-grams of the units of one q."""

    def __init__(self, units: list[tuple[int, Unit]], q: int):
        self.q = q
        hashes = [grams(u.codes, q) for _, u in units]
        key, item = np.concatenate(hashes), np.repeat([j for j, _ in units], [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.lexsort((place, item, key))
        key, item, place = key[order], item[order], place[order]
        run = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (item[1:] != item[:-1]))) - 1
        often = np.bincount(run)[run] > REPEATS
        self.left_out = list(zip(item[often].tolist(), place[often].tolist()))
        key, self.item, self.place = key[~often], item[~often], place[~often]
        self.keys, self.first = np.unique(key, return_index=True)
        self.last = np.append(self.first[1:], len(key))
        self.seen = np.zeros(1 << _TABLE_BITS, np.bool_)
        self.seen[key >> np.uint64(64 - _TABLE_BITS)] = True

    def hits(self, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Item, diagonal and place in the text of every shared q-gram, for some places of the text at a time."""
        if not len(self.keys):
            return
        for start in range(0, len(c) - self.q + 1, WINDOW):
            h = grams(c[start : start + WINDOW + self.q - 1], self.q)
            at = np.flatnonzero(self.seen[h >> np.uint64(64 - _TABLE_BITS)])
            k = np.searchsorted(self.keys, h[at])
            k[k == len(self.keys)] = 0
            real = self.keys[k] == h[at]
            at, k = at[real], k[real]
            n = self.last[k] - self.first[k]
            upto = np.cumsum(n)
            few = not len(n) or upto[-1] <= WINDOW
            for part in [slice(None)] if few else np.split(np.arange(len(n)), np.flatnonzero(np.diff(upto // WINDOW)) + 1):
                m = n[part]
                where = np.repeat(self.first[k[part]] - np.append(0, np.cumsum(m)[:-1]), m) + np.arange(m.sum())
                places = np.repeat(at[part] + start, m)
                yield self.item[where], places - self.place[where], places


def paired(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of each band and the next together."""
    follows = np.append(keys[1:] == keys[:-1] + 1, False)
    return counts + np.where(follows, np.append(counts[1:], 0), 0)


class Items:
    """A block of items with the indexes of their q-grams."""

    def __init__(self, items: list[tuple], edit_share: float):
        self.short = [(i, t) for i, t in items if 0 < len(t) < Q]
        kept = [(i, t) for i, t in items if len(t) >= Q]
        self.ids = [i for i, _ in kept]
        self.units = [Unit(t, edit_share) for _, t in kept]
        size = np.array([u.size for u in self.units], np.int64)
        self.width = np.array([u.edits + 1 for u in self.units], np.int64)
        self.bound = np.array([u.size - u.q + 1 - u.edits * u.q for u in self.units], np.int64)
        by_q: dict[int, list] = {}
        for j, u in enumerate(self.units):
            by_q.setdefault(u.q, []).append((j, u))
        self.indexes = [Index(us, q) for q, us in by_q.items()]
        gone = {j: np.zeros(u.size + 1, np.int64) for j, u in enumerate(self.units)}
        for index in self.indexes:
            for j, place in index.left_out:
                gone[j][place + 1] += 1
        gone = {j: np.cumsum(x) for j, x in gone.items()}
        self.bound -= np.array([gone[j][-1] for j in range(len(kept))], np.int64)
        self.loose = np.flatnonzero(self.bound < 1).tolist()
        # the pieces of long items: starts, units and bounds
        self.pieces: dict[int, tuple[list[int], list[Unit], np.ndarray]] = {}
        for j in np.flatnonzero(size > PIECE).tolist():
            starts = [*range(0, int(size[j]) - PIECE, STEP), int(size[j]) - PIECE]
            units = [Unit(self.units[j].text[a : a + PIECE], edit_share) for a in starts]
            held = PIECE - Q + 1 - units[0].edits * Q
            bounds = np.array([held - (gone[j][a + PIECE - Q + 1] - gone[j][a]) for a in starts])
            self.pieces[j] = starts, units, bounds
        self.loose_pieces = {j: [u for u, b in zip(units, bounds) if b < 1] for j, (_, units, bounds) in self.pieces.items() if bounds.min() < 1}
        self.piece_least = np.array([max(1, self.pieces[j][2].min()) if j in self.pieces else _FAR for j in range(len(kept))], np.int64)
        self.longest = int(size.max()) if len(size) else 0

    def regions(self, text: str) -> list[tuple]:
        """(item_id, start, end, edits): the best region of each item met, whole or by a piece, by item."""
        found = []
        for i, t in self.short:
            at = f" {text} ".find(f" {t} ")
            if at >= 0:
                found.append((i, at, at + len(t), 0))
        c = codes(text)
        best: dict[int, tuple] = {}
        for index in self.indexes:
            self._search(index, text, c, best)
        for j in self.loose:
            got = self.units[j].met(text, c, -self.units[j].size, len(c), self.units[j].edits)
            if got:
                best[j] = got
        for j, units in self.loose_pieces.items():
            got = [] if j in best else [x for u in units if (x := u.met(text, c, -u.size, len(c), u.edits))]
            if got:
                best[j] = min(got, key=lambda x: x[2])
        return found + [(self.ids[j], *best[j]) for j in sorted(best)]

    def _search(self, index: Index, text: str, c: np.ndarray, best: dict[int, tuple]) -> None:
        shift = self.longest  # no diagonal is below its negative
        span = len(c) + 2 * shift + 2
        chunks = [np.unique(item * span + (diagonal + shift) // self.width[item], return_counts=True) for item, diagonal, _ in index.hits(c) if len(item)]
        if not chunks:
            return
        keys, counts = chunks[0]
        if len(chunks) > 1:
            keys, back = np.unique(np.concatenate([k for k, _ in chunks]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([n for _, n in chunks])).astype(np.int64)
        pair = paired(keys, counts)
        of = keys // span
        for key, j in zip(keys[pair >= self.bound[of]].tolist(), of[pair >= self.bound[of]].tolist()):
            u, w = self.units[j], int(self.width[j])
            low = key % span * w - shift
            got = u.met(text, c, low - u.edits, low + 2 * w - 1 + u.edits, best[j][2] - 1 if j in best else u.edits)
            if got and (j not in best or got[2] < best[j][2]):
                best[j] = got
        # a piece's bands are no wider than its item's, so what reaches the piece's bound does so here
        left = {*of[pair >= self.piece_least[of]].tolist()} - set(best)
        if left:
            kept = [(item[x], diagonal[x], at[x]) for item, diagonal, at in index.hits(c) for x in [np.isin(item, list(left))]]
            item, diagonal, at = (np.concatenate(x) for x in zip(*kept))
            for j in sorted(left):
                got = self._piece(j, text, c, diagonal[item == j], at[item == j])
                if got:
                    best[j] = got

    def _piece(self, j: int, text: str, c: np.ndarray, diagonal: np.ndarray, at: np.ndarray) -> tuple[int, int, int] | None:
        """The best region of the pieces of item j, of whose q-grams these are the hits."""
        starts, units, bounds = self.pieces[j]
        k, size = units[0].edits, self.units[j].size
        w = k + 1
        place, band = at - diagonal, (diagonal + size) // w
        keys, counts = np.unique(band, return_counts=True)
        best = None
        for key in keys[paired(keys, counts) >= self.piece_least[j]].tolist():
            low = key * w - size
            places = np.unique(place[(band == key) | (band == key + 1)])  # a q-gram of the item counts once
            a = np.array(starts)
            held = np.searchsorted(places, a + PIECE - Q, "right") - np.searchsorted(places, a)
            for x in np.flatnonzero((held >= bounds) & (bounds >= 1)).tolist():
                d = low + starts[x]  # diagonals of the piece itself
                got = units[x].met(text, c, d - k, d + 2 * w - 1 + k, best[2] - 1 if best else k)
                if got and got[2] == 0:
                    return got
                best = got or best
        return best


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple]]:
    """The normalised items, in lists of about block_chars characters at most."""
    rows = benchmark.select(F.col(item_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    for k in range(n):
        yield [(r["id"], normal(r["text"])) for r in rows.where(F.col("block") == k).collect()]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document and item met, whole or by a piece: id, item, start and end in the normalised text, edits."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    id_type, item_type = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (benchmark, item_col)))
    item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for block in item_blocks(benchmark, item_col, item_text_col, block_chars):

        def searched(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = Items(block, edit_share)
            for b in batches:
                place, met = [], []
                for i, t in enumerate(b.column(1)):
                    for r in items.regions(normal(t.as_py())):
                        place.append(i)
                        met.append(r)
                cols = list(zip(*met)) or [[]] * 4
                ids = b.column(0).take(pa.array(place, pa.int64()))
                item_ids = pa.array(cols[0], item_kind)
                yield pa.RecordBatch.from_arrays(
                    [ids, item_ids, *(pa.array(x, pa.int64()) for x in cols[1:])], ["id", "item", "start", "end", "edits"]
                )
        found = rows.mapInArrow(searched, f"id {id_type}, item {item_type}, start bigint, end bigint, edits bigint")
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that meet no item, with their columns as they were."""
    place = docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_col, item_text_col, block_chars):

        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = Items(block, edit_share)
            for b in batches:
                yield b.filter(pa.array([not items.regions(normal(t.as_py())) for t in b.column(place)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
