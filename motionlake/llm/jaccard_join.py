"""N-gram Jaccard join as a metric-space join, exact.

Jaccard distance d = 1 - |x & y| / |x | y| is a metric. Rows with equal shingle sets form
one class; classes within e = 1 - t of each other are linked.

1. Pivots. A document is at distance 1 from nearly every other, so pivots drawn at random
   would leave all documents in every window. A pivot is therefore drawn where documents
   can be near each other at all: a linked pair shares ``COMMON`` of the first
   n - ceil(t * n) + COMMON shingles of either set in one global order, rarest first, so all
   classes that have a shingle among these meet there, and of each meeting the class with the
   least hash is a pivot. Its region holds the classes that met it; a linked pair meets in the
   region of the pivot of its first common shingle. Two classes that only ever meet alone
   must do so COMMON times, and with enough shingles left after the first time.
2. Windows about the empty set and its likes. The distance of a set to the empty set is its
   size, in all shingles or in any part of them. By the triangle inequality these sizes
   bound the symmetric difference of two sets from below; a class that has no other class of
   its region within this bound leaves the region before any set is fetched.
3. Recursion. A region of more than ``CELL_ROWS`` classes (or ``CELL_SHINGLES`` shingles) is
   split by ``PIVOTS`` of its documents. A class lies in the Voronoi cell of its nearest
   pivot, and is replicated into each cell before it in order whose pivot is within
   nearest + 2e; pivot 0 is the empty set, at distance 1 from all. A linked pair meets in the
   first of its two cells: with x in cell i and y in cell j, d(y, pi) <= d(x, pi) + e <=
   d(x, pj) + e <= d(y, pj) + 2e. Pivots are compared with their whole region and leave it; a
   cell whose classes are all linked to one pivot is done. So it goes on, level by level.
4. A region within the bounds is joined in one task by the same recursion, down to ``LEAF``
   classes, which are compared. A large region that its cells do not split is dealt out in
   blocks of bounded size, and each pair of blocks is joined in a task.

Links of a task are reduced to a forest, and components() joins the forests. Shingles are
64-bit hashes. The order of shingles takes the expected frequency from the counts of their
words, and the counts of shingles themselves where these stand out (passages that many
documents share): two tables of fixed size (2 ** WORD_BITS and 2 ** SHINGLE_BITS sums over
all rows), which is all that the driver collects. The order changes what is compared, never
what is found.

Defined cases: null and empty texts and texts without words have an empty set and
are linked with nothing; with fewer words than ``size`` the whole sequence is the
one shingle; null ids never win as component_id, unless a component has no other;
repeated rows are rows of one class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Tables, cut, grouped
from .components import components
from .rows import keep_rows

PERCENT = 90
SIZE = 3
WORD_BITS = 18
SHINGLE_BITS = 20
CHUNK = 1 << 14
SUM_SALTS = 64
CELL_ROWS = 512
CELL_SHINGLES = 1 << 20
LEAF = 32
COMMON = 3
PIVOTS = 8
UNSPLIT = 0.75
COLUMNS = 4096
BROADCAST_ROWS = 500_000
REMEMBERED = 1_000_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_WORD_SHIFT, _SHINGLE_SHIFT = np.uint64(64 - WORD_BITS), np.uint64(64 - SHINGLE_BITS)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    h = (h ^ (h >> np.uint64(29))) * _C
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    """Hashes of the words between ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each shingle, in the order of the text."""
    n = len(words)
    size = min(size, n)
    h = np.full(n - size + 1 if n else 0, np.uint64(size))
    for k in range(size):
        h = mixed(h * _A + words[k : n - size + 1 + k])
    return h


def shingles(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and for each the place of its first word."""
    return np.unique(shingle_hashes(words, size), return_index=True)


def window(n: int, percent: int) -> int:
    """How many shingles of n, in any order, must hold COMMON of every linked set's (all of them, where they are fewer)."""
    return min(n, n - (percent * n + 99) // 100 + COMMON)


@dataclass
class Rarity:
    """What the global order of shingles is made from; logarithms to base 2."""

    words: np.ndarray  # by the place of a word: its count
    all_words: float
    passages: np.ndarray  # by the place of a shingle: its count where it stands out, else a low value

    def order(self, words: np.ndarray, s: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """The class of each shingle of s in the global order, low is rare; within a class the hash decides."""
        own = self.words[words >> _WORD_SHIFT]
        size = min(size, len(words))
        expected = sum((own[place + k] for k in range(size)), np.float32(0)) - np.float32((size - 1) * self.all_words)
        return np.clip(2 * (np.maximum(expected, self.passages[s >> _SHINGLE_SHIFT]) + 80), 0, 255).astype(np.uint8)


def rarity(docs: DataFrame, text_col: str, size: int) -> Rarity:
    """Counts of words and shingles over all rows, in tables of fixed size."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = WordHashes(), [np.zeros(1 << WORD_BITS, np.int64), np.zeros(1 << SHINGLE_BITS, np.int64)]

        def add(held: list[np.ndarray]) -> None:
            h = [np.concatenate(held) >> _WORD_SHIFT, np.concatenate([shingle_hashes(w, size) for w in held]) >> _SHINGLE_SHIFT]
            for t, x in zip(total, h):
                t += np.bincount(x.astype(np.int64), minlength=len(t))
            held.clear()

        held, n = [], 0
        for b in batches:
            for t in b.column(0):
                held.append(word_hashes(t.as_py(), known))
                n += len(held[-1])
                if n > 1 << 20:
                    add(held)
                    n = 0
        if held:
            add(held)
        salt = TaskContext.get().partitionId() % SUM_SALTS
        for k, part in enumerate(np.split(np.concatenate(total), sum(map(len, total)) // CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([part.tobytes()])], ["chunk", "salt", "sums"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(2)):
                part = np.frombuffer(x.as_py(), np.int64)
                total[k] = total[k] + part if k in total else part
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([x.tobytes()])], ["chunk", "salt", "sums"])

    schema = "chunk int, salt int, sums binary"
    parts = docs.select(docs[text_col].cast("string")).mapInArrow(counted, schema)
    whole = parts.repartition("chunk", "salt").mapInArrow(summed, schema).repartition("chunk").mapInArrow(summed, schema)
    sums = np.zeros((1 << WORD_BITS) + (1 << SHINGLE_BITS), np.int64)
    for r in whole.collect():
        sums[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["sums"], np.int64)
    words, counts = np.split(sums, [1 << WORD_BITS])
    usual = float(np.median(counts))
    over = counts > usual + 6 * np.sqrt(usual) + 1
    passages = np.where(over, np.log2(np.maximum(counts - usual, 1)), -100)
    return Rarity(np.log2(words + 1).astype(np.float32), float(np.log2(words.sum() + 1)), passages.astype(np.float32))


TEXT_KEYS = ["text_key", "text_key2"]


def text_keys(text: str) -> list[Column]:
    """What a text is found again by: 96 bits in two hashes."""
    return [F.xxhash64(text).alias("text_key"), F.hash(text).alias("text_key2")]


def part_sizes(s: np.ndarray) -> np.ndarray:
    """The sizes of the set s in equal parts of the shingle space; the more parts, the larger the set."""
    bits = min(max(len(s).bit_length() - 3, 5), 12)
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, rare: Rarity) -> DataFrame:
    """id, TEXT_KEYS, n, d1, d2 (together the set's digest), anchors (its rarest shingles), parts: one row per row of docs."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    rows = rows.select(F.struct("id", *text_keys("text")).alias("key"), "text")
    told = docs.sparkSession.sparkContext.broadcast(rare)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rare = WordHashes(), told.value
        for b in batches:
            out = []
            for t in b.column(1):
                words = word_hashes(t.as_py(), known)
                s, place = shingles(words, size)
                n = len(s)
                if not n:
                    out.append((0, 0, 0, [], b""))
                    continue
                order = rare.order(words, s, place, size)
                anchors = s[np.argsort(order, kind="stable")[: window(n, percent)]]
                d1, d2 = mixed(s + _A).sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(s ^ _B))
                parts = np.minimum(part_sizes(s), 0xFFFF).astype(np.uint16).tobytes()
                out.append((n, int(d1.view(np.int64)), int(d2.view(np.int64)), anchors.view(np.int64), parts))
            n, d1, d2, anchors, parts = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                    pa.array(anchors, pa.list_(pa.int64())), pa.array(parts, pa.binary()),
                ],
                ["key", "n", "d1", "d2", "anchors", "parts"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(sketched, f"key {kind}, n int, d1 bigint, d2 bigint, anchors array<bigint>, parts binary")
    return out.select("key.*", "n", "d1", "d2", "anchors", "parts")


def sets_of(docs: DataFrame, text_col: str, size: int, wanted: DataFrame) -> DataFrame:
    """node, n, set of the rows of wanted (node, TEXT_KEYS)."""
    text = docs.select(docs[text_col].cast("string").alias("text")).select("text", *text_keys("text"))
    if wanted.count() <= BROADCAST_ROWS:  # 20 bytes a row; beyond that the texts are shuffled
        wanted = F.broadcast(wanted)
    met = text.join(wanted, TEXT_KEYS).select("node", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            sets = [shingles(word_hashes(t.as_py(), known), size)[0].view(np.int64) for t in b.column(1)]
            n = pa.array(map(len, sets), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(sets, pa.list_(pa.int64()))], ["node", "n", "set"])

    # rows that repeat a text give its set more than once
    return met.mapInArrow(made, "node bigint, n int, set array<bigint>").dropDuplicates(["node"])


def _linked(inter: Column, na: Column, nb: Column, percent: int) -> Column:
    return 100 * inter >= percent * (na + nb - inter)


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column those whose value another row has, or may have in another partition: the first and last."""
    held, known = None, True
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        k = t.column(0).to_numpy()
        same = k[1:] == k[:-1]
        keep = np.append(known, same) | np.append(same, False)
        yield from t.slice(0, len(k) - 1).filter(pa.array(keep[:-1])).combine_chunks().to_batches()
        held, known = t.slice(len(k) - 1), bool(keep[-1])
    if held is not None:
        yield from held.combine_chunks().to_batches()


def near_bound(n: np.ndarray, parts: list[bytes], percent: int) -> np.ndarray:
    """Which sets have another that their sizes, whole and by parts, allow to be linked. Two are compared by the parts of the smaller one."""
    parts = [np.frombuffer(p, np.uint16).astype(np.int32) for p in parts]
    many = np.array([len(p) for p in parts])
    out = np.zeros(len(n), np.bool_)
    for m in np.unique(many):
        other = np.flatnonzero(many >= m)
        p = np.stack([parts[j].reshape(m, -1).sum(1) for j in other])
        for k in np.flatnonzero(many[other] == m):
            i = other[k]
            apart = np.abs(p - p[k]).sum(1)
            # |x & y| = (nx + ny - |x ^ y|) / 2, and |x ^ y| >= apart
            fits = 100 * (n[other] + n[i] - apart) >= percent * (n[other] + n[i] + apart)
            fits[k] = False
            out[other[fits]] = True
            out[i] |= fits.any()
    return out


class Region:
    """The sets of one region, joined in a task."""

    def __init__(self, nodes: np.ndarray, sets: list[np.ndarray], percent: int):
        order = np.argsort(mixed(nodes.view(np.uint64) ^ _A), kind="stable")  # whoever comes first becomes a pivot
        self.nodes, self.percent, self.e = nodes[order], percent, 1 - percent / 100 + 1e-9
        sets = [sets[i] for i in order]
        self.n = np.array([len(s) for s in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), self.n)
        _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        kept = times[col] > 1  # what one set alone holds is in no intersection
        names = np.cumsum(times > 1) - 1
        col, self.row = names[col[kept]], row[kept]
        by = np.argsort(col, kind="stable")
        self.col, self.row = col[by], self.row[by]
        self.root = np.arange(len(sets))

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the sets a with the sets b, a slice of columns at a time."""
        out = np.zeros((len(a), len(b)), np.float32)
        width = int(self.col[-1]) + 1 if len(self.col) else 0
        for lo in range(0, width, COLUMNS):
            i, j = np.searchsorted(self.col, [lo, lo + COLUMNS])
            dense = np.zeros((len(self.n), min(COLUMNS, width - lo)), np.float32)
            dense[self.row[i:j], self.col[i:j] - lo] = 1
            out += dense[a] @ dense[b].T
        return out

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of the sets a to the sets b; links are taken into root."""
        inter = self.overlap(a, b).astype(np.int64)
        union = self.n[a][:, None] + self.n[b] - inter
        x, y = np.nonzero(100 * inter >= self.percent * union)
        x, y = a[x], b[y]
        while True:
            rx, ry = self.root[x], self.root[y]
            differ = rx != ry
            if not differ.any():
                return 1 - inter / union
            np.minimum.at(self.root, np.maximum(rx, ry)[differ], np.minimum(rx, ry)[differ])
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up

    def join(self, rows: np.ndarray) -> None:
        """Takes all links among rows into root."""
        if len(np.unique(self.root[rows])) < 2:
            return
        if len(rows) <= LEAF:
            self.compare(rows, rows)
            return
        pivots, rest = rows[:PIVOTS], rows[PIVOTS:]
        self.compare(pivots, pivots)
        inside = cells(self.compare(rest, pivots), self.e)
        if inside.sum(0).max() > UNSPLIT * len(rest):
            self.compare(rest, rest)
            return
        for cell in inside.T:
            self.join(rest[cell])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        tied = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.nodes[tied], self.nodes[self.root[tied]]


def cells(d: np.ndarray, e: float) -> np.ndarray:
    """Which cells rows lie in, by their distances d to pivots; cell 0 is the empty set's, whose distance to all is 1."""
    d = np.column_stack([np.ones(len(d)), d])
    home = d.argmin(1)
    least = d[np.arange(len(d)), home]
    places = np.arange(d.shape[1])
    return (places == home[:, None]) | ((places < home[:, None]) & (d <= least[:, None] + 2 * e))


def region_links(percent: int, whole: bool = False):
    """The links within each region, as a forest; the recursion is left out if whole (for pairs of blocks)."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches):
            if t.num_rows < 2:
                continue
            t = t.combine_chunks()
            sets = t.column("set").chunk(0)
            values, at = sets.values.to_numpy(), sets.offsets.to_numpy()
            r = Region(t.column("node").to_numpy(), [values[a:z].view(np.uint64) for a, z in zip(at[:-1], at[1:])], percent)
            rows = np.arange(t.num_rows)
            if whole:
                r.compare(rows, rows)
            else:
                r.join(rows)
            a, b = r.links()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return joined


class Join:
    """One join of classes (node, TEXT_KEYS, n, anchors, parts)."""

    def __init__(self, tables: Tables, classes: DataFrame, docs: DataFrame, text_col: str, size: int, percent: int):
        self.tables, self.classes, self.docs, self.text_col, self.size, self.percent = tables, classes, docs, text_col, size, percent
        self.sets = None

    def regions(self) -> DataFrame:
        """region (its pivot), node: the classes that meet pivots."""
        entries = self.classes.select("node", "n", F.posexplode("anchors").alias("pos", "anchor"))
        entries = entries.select("anchor", "node", "n", (F.col("n") - F.col("pos")).cast("int").alias("rest"))
        # ranges of (anchor, node) deal out even an anchor that a third of all classes have
        dealt = entries.repartitionByRange("anchor", "node").sortWithinPartitions("anchor", "node")
        met = self.tables.cut(dealt.mapInArrow(shared, entries.schema))
        stats = met.groupBy("anchor").agg(
            F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("rest").alias("rest"),
            F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("pivot"),
        ).where("c > 1").select("anchor", "c", "lo", "hi", "rest", F.col("pivot.node").alias("region"))
        found = met.select("anchor", "node").join(stats, "anchor").where("node <> region")
        alone = F.col("c") == 2
        found = found.groupBy("region", "node").agg(
            F.max("c").alias("c"), F.count_if(alone).alias("k"), F.max(F.when(alone, F.col("rest"))).alias("rest"), F.max("lo").alias("lo"), F.max("hi").alias("hi")
        )
        # a pair that always meets alone has its first common shingle here; what stands before that is not shared
        least = F.least(F.lit(COMMON), F.ceil(self.percent * F.col("hi") / 100))
        near = (F.col("k") >= least) & _linked(F.col("rest"), F.col("lo"), F.col("hi"), self.percent)
        found = self.tables.cut(found.where((F.col("c") > 2) | near).select("region", "node"))
        own = found.select("region", F.col("region").alias("node")).distinct()
        out = self.tables.cut(found.unionByName(own))
        self.tables.free(found)
        self.tables.free(met)
        return out

    def by_size(self, rows: DataFrame, shingles: bool) -> tuple[DataFrame, DataFrame]:
        """Rows of regions (region, node, and n if shingles) within the bounds of a task, and the others."""
        weight = F.sum("n") if shingles else F.lit(0)
        stats = rows.groupBy("region").agg(F.count("*").alias("c"), weight.alias("w")).where("c > 1")
        within = (F.col("c") <= CELL_ROWS) & (F.col("w") <= CELL_SHINGLES)
        return tuple(rows.join(stats.where(x).select("region", "c"), "region") for x in (within, ~within))

    def bounded(self, regions: DataFrame) -> DataFrame:
        """The rows of regions with another class that sizes allow to be near. Large regions stay as they are."""
        few, many = self.by_size(regions, False)
        sized = few.select("region", "node").join(self.classes.select("node", "n", "parts"), "node").select("region", "node", "n", "parts")
        percent = self.percent

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in grouped(batches):
                keep = near_bound(t.column(2).to_numpy().astype(np.int64), t.column(3).to_pylist(), percent)
                yield from t.select([0, 1]).filter(pa.array(keep)).combine_chunks().to_batches()

        kept = sized.repartition("region").sortWithinPartitions("region").mapInArrow(near, "region bigint, node bigint")
        return self.tables.cut(kept.unionByName(many.select("region", "node")))

    def with_sets(self, rows: DataFrame, whole: bool = False) -> DataFrame:
        """Links within the regions of rows, each region in a task."""
        met = rows.select("region", "node").join(self.sets, "node").select("region", "node", "set")
        return met.repartition("region").sortWithinPartitions("region").mapInArrow(region_links(self.percent, whole), "a bigint, b bigint")

    def split(self, rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Large regions as cells of pivots; the rows of those that cells do not split; the links to pivots."""
        nth = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(level)), "node"))
        pivots = self.tables.cut(rows.withColumn("j", nth).where(F.col("j") <= PIVOTS).select("region", "j", F.col("node").alias("pivot")))
        pairs = rows.join(pivots, "region").select("region", "c", "node", "n", "j", "pivot")
        plain = self.tables.cut(pairs.where("node <> pivot").select("node", "pivot").distinct())
        mine, other = self.sets, self.sets.select(F.col("node").alias("pivot"), F.col("n").alias("np"), F.col("set").alias("sp"))
        met = plain.join(mine, "node").join(other, "pivot").withColumn("inter", F.size(F.array_intersect("set", "sp")))
        far = self.tables.cut(met.select("node", "pivot", (1 - F.col("inter") / (F.col("n") + F.col("np") - F.col("inter"))).alias("d"),
                                         _linked(F.col("inter"), F.col("n"), F.col("np"), self.percent).alias("linked")))
        links = far.where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        # a pivot of the region has been compared with all of it
        rest = pairs.join(pivots.select("region", F.col("pivot").alias("node")), ["region", "node"], "left_anti").join(far, ["node", "pivot"])
        own = rest.groupBy("region", "c", "node", "n").agg(
            F.min(F.struct("d", "j")).alias("home"), F.min(F.when(F.col("linked"), F.col("j"))).alias("to"), F.collect_list(F.struct("j", "d")).alias("all")
        )
        near, limit = F.least(F.col("home.d"), F.lit(1.0)), 2 * (1 - self.percent / 100 + 1e-9)
        home = F.when(F.col("home.d") < 1, F.col("home.j")).otherwise(0)
        others = F.transform(F.filter("all", lambda x: (x["j"] < home) & (x["d"] <= near + limit)), lambda x: x["j"])
        outer = F.when((home > 0) & (near + limit >= 1), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        placed = self.tables.cut(own.select("region", "c", "node", "n", "to", F.concat(F.array(home), others, outer).alias("js")))
        in_cells = placed.select("region", "c", "node", "n", "to", F.explode("js").alias("j"))
        held = in_cells.groupBy("region", "c", "j").agg(F.count("*").alias("m"), F.count("to").alias("tied"), F.min("to").alias("t0"), F.max("to").alias("t1"))
        most = held.groupBy("region").agg((F.max("m") > UNSPLIT * F.first("c")).alias("whole"))
        done = (F.col("m") == F.col("tied")) & (F.col("t0") == F.col("t1"))  # all linked to one pivot
        live = held.where(~F.coalesce(done, F.lit(False)) & (F.col("m") > 1)).join(most.where("not whole"), "region").select("region", "j")
        name = F.xxhash64("region", "j", F.lit(level)).alias("region")
        smaller = self.tables.cut(in_cells.join(live, ["region", "j"]).select(name, "node", "n"))
        stuck = self.tables.cut(placed.join(most.where("whole"), "region").select("region", "c", "node", "n"))
        links = self.tables.cut(links)
        self.tables.free(pivots, plain, far, placed)
        return smaller, stuck, links

    def blocks(self, rows: DataFrame) -> DataFrame:
        """Pairs of blocks of the regions of rows, each a region of its own."""
        total = rows.groupBy("region").agg(F.sum("n").alias("w"))
        rows = rows.join(total, "region")
        n = F.greatest(F.ceil(2 * F.col("c") / F.lit(CELL_ROWS)), F.ceil(2 * F.col("w") / F.lit(CELL_SHINGLES))).cast("int")
        own = F.pmod(F.xxhash64("node", F.lit("block")), n).cast("int")
        dealt = rows.select("region", "node", own.alias("i"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
        return dealt.select(F.xxhash64("region", F.least("i", "k"), F.greatest("i", "k")).alias("region"), "node")

    def run(self) -> DataFrame:
        """u, comp of the classes that have links."""
        t = self.tables
        met = self.regions()
        rows = self.bounded(met)
        wanted = t.cut(rows.select("node").distinct().join(self.classes.select("node", *TEXT_KEYS), "node"))
        self.sets = t.cut(sets_of(self.docs, self.text_col, self.size, wanted))
        rows = rows.join(self.classes.select("node", "n"), "node").select("region", "node", "n")
        found, level = [], 0
        while True:
            few, many = self.by_size(rows, True)
            found.append(t.cut(self.with_sets(few)))
            many = t.cut(many)
            if many.isEmpty():
                break
            rows, stuck, links = self.split(many, level)
            found += [links, t.cut(self.with_sets(self.blocks(stuck), whole=True))]
            level += 1
        links = found[0]
        for f in found[1:]:
            links = links.unionByName(f)
        return components(t, links, "a", "b")


def _placed(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """id, text_key, rid, n, node (class) and comp of every row of docs."""
    t = Tables(docs.sparkSession)
    rows = t.cut(sketches(docs, id_col, text_col, size, percent, rarity(docs, text_col, size)).withColumn("rid", F.monotonically_increasing_id()))
    key = ["n", "d1", "d2"]
    firsts = [F.first(c).alias(c) for c in (*TEXT_KEYS, "anchors", "parts")]
    classes = t.cut(rows.where("n > 0").groupBy(*key).agg(F.min("rid").alias("node"), *firsts))
    comps = Join(t, classes, docs, text_col, size, percent).run().withColumnRenamed("u", "node")
    classed = rows.select("id", "text_key", "rid", *key).join(classes.select(*key, "node"), key, "left")
    classed = classed.withColumn("node", F.coalesce("node", "rid"))
    placed = classed.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    out = cut(placed.select("id", "text_key", "rid", "n", "node", "comp"))
    t.close()
    return out


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT
) -> DataFrame:
    """id, n_shingles, component_id and class (of equal sets) of every row of docs."""
    placed = _placed(docs, id_col, text_col, size, percent)
    least = cut(placed.groupBy("comp").agg(F.min("id").alias("component_id")))  # a side of its own: a large component can be split
    out = placed.join(least, "comp")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("node").alias("class"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The row with the least id of each component, with its columns as they were; of rows that repeat id and text, one."""
    placed = _placed(docs, id_col, text_col, size, percent)
    stay = placed.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull(), "id", "rid", "text_key")).alias("s"))
    return keep_rows(docs, F.xxhash64(docs[text_col].cast("string")), id_col, stay.select(F.col("s.text_key").alias("key"), F.col("s.id").alias("id")))

