"""Phrases that occur together: candidates from sketch upper bounds, counted by automata.

First pass: each chunk of texts adds its words and word pairs to a count-min sketch. A sketch is two rows
of cells in 256 blocks each: chunks send the cells they touch, and
blocks are summed where they meet. Only one bit of a cell comes back, whether it reached the
threshold; a phrase whose bits are not all set occurs less often, for sure. Second pass: the
same for longer phrases all of whose pairs are still possible. Third pass: each chunk compiles the
phrases of its own that are still possible into Aho-Corasick automata, with a blank as guard
before and behind, and counts all their matches, overlapping ones too. Counts are summed over
chunks, and only then do thresholds apply: the sketch spares rows and decides nothing.

The candidates never meet in one place: a chunk asks for its own. A sketch has as many cells as
the corpus has words over four, 2^28 a row at most (64 MB of bits altogether); beyond that it
fills up, more phrases are counted and thrown away, and results stay the same.

A word or phrase stays within its piece of text and its language. Cuts, subsumption and
ranks are joins and windows over the phrases that reach the threshold.

Defined cases: null texts are empty; a null language is `und`; texts without words count
nothing; repeated rows count each; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, Tables

LEAST, LONGEST, SHARE, TOP = 30, 4, 80, 2000
CHUNK_BYTES = 8 << 20
AUTOMATON_PHRASES = 100_000
BLOCKS = 256  # of a row
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 28
SENT_HASHES = 3_000_000
STEP, ROWS = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)  # odd multipliers

BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(UPPER.encode() + BREAKS + b"\t", UPPER.lower().encode() + b"\n" * len(BREAKS) + b" ")

c = F.col


class Words:
    """The words of some texts as numbers, the piece that each stands in, and their spellings."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts).translate(_PLAIN), np.uint8)
        apart = (data == 32) | (data == 10)
        edges = np.flatnonzero(np.diff(np.r_[True, apart, True].view(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(data == 10, dtype=np.int32)[self.starts]
        self.data = data
        offsets = np.r_[0, np.cumsum(self.ends - self.starts)]
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~apart])])
        coded = packed.dictionary_encode()
        self.ids = coded.indices.to_numpy()
        self.spelled = coded.dictionary.to_pylist()

    def counts(self) -> np.ndarray:
        return np.bincount(self.ids, minlength=len(self.spelled))

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.spelled[i] for i in self.ids[at : at + n].tolist())

    def plain(self, held: np.ndarray) -> bytes:
        """The words that are held, with one blank before, between and behind them, and a line feed where others or a new piece come between."""
        at = np.flatnonzero(held)
        joined = np.r_[False, (np.diff(at) == 1) & (self.piece[at[1:]] == self.piece[at[:-1]])] if len(at) else held[:0]
        sizes = self.ends[at] - self.starts[at]
        to = np.cumsum(sizes + np.where(joined, 1, 3)) - sizes
        out = np.full(int(to[-1] + sizes[-1]) + 1 if len(at) else 0, 32, np.uint8)
        out[to[~joined] - 2] = 10
        from_ = np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        out[np.repeat(to - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())] = self.data[from_]
        return out.tobytes()

    def grams(self, lang: str, longest: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: hash of the phrase that starts at each word, and whether there is one."""
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        own = np.fromiter((xxhash.xxh3_64_intdigest(w, seed=seed) for w in self.spelled), np.uint64, len(self.spelled))[self.ids]
        h, out = own, {}
        for n in range(1, longest + 1):
            if len(own) < n:
                break
            if n > 1:
                h = h[:-1] * np.uint64(STEP) + own[n - 1 :]
            mixed = h ^ (h >> np.uint64(31))
            mixed *= np.uint64(ROWS[0] ^ (2 * n))
            out[n] = mixed ^ (mixed >> np.uint64(29)), self.piece[n - 1 :] == self.piece[: len(h)]
        return out


class Sketch:
    """Which cells reached the threshold, as bits. Two rows of `width` cells."""

    def __init__(self, width: int, reached: np.ndarray):
        self.width, self.reached = width, reached

    @staticmethod
    def cells(hashes: np.ndarray, width: int) -> list[np.ndarray]:
        """The cell of each hash in both rows, counted through."""
        half = np.uint64(32)
        return [(((hashes * np.uint64(m)) >> half) * np.uint64(width) >> half) + np.uint64(r * width) for r, m in enumerate(ROWS)]

    def may_reach(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for cell in self.cells(hashes, self.width):
            out &= (self.reached[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 == 1
        return out


def _possible(grams: dict, pairs: Sketch | None, longer: Sketch | None) -> dict[int, np.ndarray]:
    """By length: the places whose phrase may reach the threshold, as far as the sketches given tell."""
    out: dict[int, np.ndarray] = {}
    for n, (h, there) in grams.items():
        if n > 1 and pairs is not None:
            there = there & out[n - 1][: len(h)] & out[n - 1][1 : len(h) + 1]
        known = pairs if n <= 2 else longer
        if known is not None:
            at = np.flatnonzero(there)
            there = np.zeros(len(h), bool)
            there[at[known.may_reach(h[at])]] = True
        out[n] = there
    return out


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about chunk_bytes of all languages together at a time. Whole texts only."""
    held, size = defaultdict(list), 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            held[lang].append(text.as_buffer().to_pybytes())
            size += len(held[lang][-1])
            if size >= chunk_bytes:
                yield from held.items()
                held, size = defaultdict(list), 0
    yield from held.items()


def steps(places: np.ndarray) -> bytes:
    """Rising numbers as the steps between them: a byte for what is left of a step, after a 255 for every 255 in it."""
    step = np.diff(places, prepend=np.uint32(0)).astype(np.int64)
    more = step // 255
    out = np.full(len(step) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = step % 255
    return out.tobytes()


def places(packed: pa.Buffer) -> np.ndarray:
    """What steps() was given."""
    step = np.frombuffer(packed, np.uint8)
    return np.cumsum(step, dtype=np.int64)[step != 255]


def _sketched(docs: DataFrame, lengths: range, width: int, least: int, pairs, chunk_bytes: int) -> Sketch:
    """The sketch of all phrases of these lengths; of those, if pairs are given, whose pairs may all reach the threshold."""
    cap = min(least, 255)
    cells = width // BLOCKS

    def sent(hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for touched_cells in Sketch.cells(hashes, width):
            cell = np.sort(touched_cells).astype(np.int64)
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
            times = np.minimum(np.diff(np.r_[first, len(cell)]), cap)
            block, place = np.divmod(cell[first], cells)
            at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, int)
            rows = []
            for a, z in zip(at.tolist(), [*at[1:].tolist(), len(block)]):
                t, p = times[a:z], place[a:z]
                rows.append((int(block[a]), steps(p[t == 1]), steps(p[t > 1]), t[t > 1].astype(np.uint8).tobytes()))
            if rows:
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["block", "once", "more", "times"])

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for lang, texts in _chunks(batches, chunk_bytes):
            grams = Words(texts).grams(lang, lengths[-1])
            there = _possible(grams, pairs and pairs.value, None)
            held += [grams[n][0][there[n]] for n in lengths if n in grams]
            if sum(map(len, held)) >= SENT_HASHES:
                yield from sent(np.concatenate(held))
                held = []
        if held:
            yield from sent(np.concatenate(held))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["block", "reached"])

        now, total = None, np.zeros(cells, np.int64)
        for b in batches:
            for block, once, more, times in zip(b.column(0).to_pylist(), *b.columns[1:]):
                if block != now:
                    if now is not None:
                        yield closed()
                    now, total = block, np.zeros(cells, np.int64)
                total[places(once.as_buffer())] += 1
                total[places(more.as_buffer())] += np.frombuffer(times.as_buffer(), np.uint8)
        if now is not None:
            yield closed()

    rows = docs.mapInArrow(touched, "block bigint, once binary, more binary, times binary")
    met = rows.repartition("block").sortWithinPartitions("block").mapInArrow(summed, "block bigint, reached binary")
    reached = np.zeros(len(ROWS) * width // 8, np.uint8)
    for r in met.collect():  # two bits a cell, 64 MB at most
        reached[r.block * cells // 8 : (r.block + 1) * cells // 8] = np.frombuffer(r.reached, np.uint8)
    return Sketch(width, reached)


def matches(text: bytes, phrases: list[bytes]) -> np.ndarray:
    """How often each phrase occurs in a plain() text, overlaps included."""
    import ahocorasick

    out = np.zeros(len(phrases), np.int64)
    for lo in range(0, len(phrases), AUTOMATON_PHRASES):
        automaton = ahocorasick.Automaton()
        for k, p in enumerate(phrases[lo : lo + AUTOMATON_PHRASES], lo):
            automaton.add_word(f" {p.decode('latin-1')} ", k)
        automaton.make_automaton()
        found = np.fromiter(map(itemgetter(1), automaton.iter(text.decode("latin-1"))), np.int64)  # a character for each byte
        out += np.bincount(found, minlength=len(phrases))
    return out


def phrase_counts(docs: DataFrame, least: int, longest: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """lang, phrase, f: all words and phrases that occur `least` times or more, and the number of all words as the phrase ''."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = -(-min(MOST_CELLS, max(LEAST_CELLS, size // 24)) // (8 * BLOCKS)) * 8 * BLOCKS  # a word has about six bytes
    pairs = spark.sparkContext.broadcast(_sketched(docs, range(1, 3), width, least, None, chunk_bytes))
    longer = spark.sparkContext.broadcast(_sketched(docs, range(3, longest + 1), width, least, pairs, chunk_bytes)) if longest > 2 else None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _chunks(batches, chunk_bytes):
            words = Words(texts)
            grams = words.grams(lang, longest)
            possible = _possible(grams, pairs.value, longer and longer.value)
            phrases, held = [], np.zeros(len(words.ids) + 1, np.int32)
            for n in range(2, max(possible, default=0) + 1):
                at = np.flatnonzero(possible[n])
                held[at] += 1
                np.subtract.at(held, at + n, 1)
                _, first = np.unique(grams[n][0][at], return_index=True)
                phrases += [words.phrase(i, n) for i in at[first].tolist()]
            single = words.counts()
            known = np.unique(words.ids[possible[1]]) if possible else []
            names = [b"", *(words.spelled[i] for i in known), *phrases]
            met = matches(words.plain(np.cumsum(held[:-1]) > 0), phrases) if phrases else single[:0]
            f = np.concatenate([[single.sum()], single[known] if possible else single[:0], met])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(f, pa.int64())], ["lang", "phrase", "f"]
            )

    rows = docs.mapInArrow(counted, "lang string, phrase string, f bigint")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((c("f") >= least) | (c("phrase") == ""))


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP,
    lang_col: str = "lang", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """lang, rank, phrase, a (its count), l and r (counts of the parts of its worst cut), n (words of the language), score.

    Of each language the first `top` phrases of 2 to `longest` words. A phrase that is `share`
    percent of the time, or more, within one longer candidate is dropped.
    """
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    tables = Tables(docs.sparkSession)
    known = tables.cut(phrase_counts(rows, least, longest, chunk_bytes))
    counts = known.where("phrase != ''")
    words = F.split("phrase", " ", -1)
    candidates = counts.select("lang", "phrase", c("f").alias("a"), words.alias("w")).where(F.size("w") > 1)
    part = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), c("k")).alias("left"), part(c("k") + 1, F.size("w") - c("k")).alias("right"))
    of = lambda name, f: counts.select("lang", c("phrase").alias(name), c("f").alias(f))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("(cast(a AS decimal(20, 0)) * 2000000) div (cast(l AS decimal(20, 0)) + r)")
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inside = candidates.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), c("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    much = F.expr(f"cast(longer AS decimal(20, 0)) * 100 >= cast(a AS decimal(20, 0)) * {share}")
    left = worst.join(inside, ["lang", "phrase"], "left").where(c("longer").isNull() | ~much)
    best = Window.partitionBy("lang").orderBy(c("c.score").desc(), c("a").desc(), c("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(best)).where(c("rank") <= top)
    totals = known.where("phrase = ''").select("lang", c("f").alias("n"))
    out = ranked.join(totals, "lang")
    return out.select("lang", c("rank").cast("long").alias("rank"), "phrase", "a", c("c.l").alias("l"), c("c.r").alias("r"), "n", c("c.score").cast("long").alias("score"))
