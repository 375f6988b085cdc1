"""Repeated byte windows by a depth-limited radix sort of suffixes.

A suffix is ordered through its first 100 bytes only, by passes from the most significant
digit down; after each pass suffixes that are alone leave, and what is equal at the
end are the repeated windows. All but the earliest window of a group are removed.

First passes, on Spark. Most windows occur once, and no row is made for these. A
window falls into the bucket of its least 24-byte gram (by a hash of the gram). Only
the places of these grams, about one in forty bytes, become rows; neighbouring windows share
them, and equal windows have equal ones. A gram that occurs once leaves in the first pass.
The bytes from 76 before it to 100 behind its start hold all windows of a place. In the second pass places whose
surroundings are the same fall together: all but the earliest are covered whole. Both passes
are aggregations with partial ones ahead, so a passage that a third of all rows share is
one row per task.

Last passes. The earliest places of each bucket with several surroundings get their bytes. Small
buckets are sorted in tasks, in packs, by digits of eight bytes. A bucket above `most` places
takes another pass on Spark: it is dealt out by the half of its windows and the bytes that all
windows of that half have, and places whose windows of that half are all the same leave but for
the earliest. That ends with single windows, which are the same or apart, so no
bucket is ever sorted that does not fit.

Surroundings are compared by 64-bit hashes within buckets of 64-bit hashes; the last passes of small buckets compare bytes.

Defined cases: null counts as empty; texts below 100 bytes have no windows; a null id
comes before all others; rows with the same id are ordered by a 24-bit hash of their
text, and rows with the same id and text are the same document and have the same result; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

WINDOW, GRAM = 100, 24
REST = WINDOW - GRAM  # bytes of a window beside its gram; windows of a place start 0 to REST bytes before it
PACK_BYTES, PACK_PLACES, MOST = 1 << 17, 8192, 4096
PLACE_BITS = 39
DIGIT = 8

c = F.col


@lru_cache(maxsize=1)
def _byte_hashes() -> np.ndarray:
    """A 64-bit number for each byte, from a rule."""
    return np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=1) for b in range(256)], np.uint64)


def _over(values: np.ndarray, width: int, merge) -> np.ndarray:
    """merge over each stretch of `width` values, by doubling."""
    done, reach = values, 1
    while 2 * reach <= width:
        done, reach = merge(done[:-reach], done[reach:]), 2 * reach
    rest = width - reach
    return merge(done[: len(done) - rest], done[rest:]) if rest else done


def least_grams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every gram that is the least of a window; texts lie one after the other and end at ends."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    odd = iter(int(x) | 1 for x in _byte_hashes())
    level, reach = _byte_hashes()[data], 1
    by_reach = {1: level}
    while 2 * reach <= GRAM:
        level = level[:-reach] * np.uint64(next(odd)) + level[reach:]
        reach *= 2
        by_reach[reach] = level
    size, hashes = 0, None
    for reach in sorted(by_reach, reverse=True):
        if GRAM & reach:
            part = by_reach[reach][size:]
            n = len(data) - GRAM + 1
            hashes = part[:n] if hashes is None else hashes[:n] * np.uint64(next(odd)) + part[:n]
            size += reach
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(next(odd))
    hashes ^= hashes >> np.uint64(32)
    least = _over(hashes, REST + 1, np.minimum)
    # windows that would cross the end of a text don't count
    for e in ends[:-1].tolist():
        least[max(0, e - WINDOW + 1) : e] = 0
    held = np.concatenate([np.zeros(REST, np.uint64), least, np.zeros(REST, np.uint64)])
    at = np.flatnonzero(hashes == _over(held, REST + 1, np.maximum))
    at = at[hashes[at] != 0]
    return at, hashes[at]


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bytes, np.ndarray]]:
    """Rows (first column text), their texts one after the other, and where each ends. A long text is a pack of its own."""
    for b in batches:
        sizes = pc.binary_length(b.column(0)).to_numpy(zero_copy_only=False)
        lo = 0
        while lo < len(sizes):
            hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[lo:]), PACK_BYTES, "right")))
            part = b.slice(lo, hi - lo)
            texts = part.column(0)
            yield part, b"".join(t.as_buffer() for t in texts), np.cumsum(sizes[lo:hi], dtype=np.int64)
            lo = hi


def _grams(docs: DataFrame) -> DataFrame:
    """h: the hash of each place's gram. For counting."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, ends in _packs(batches):
            _, h = least_grams(np.frombuffer(data, np.uint8), ends)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return docs.select("text").mapInArrow(made, "h bigint")


def _places(docs: DataFrame) -> DataFrame:
    """h, around (hash of the bytes that hold all windows of the place, and of where the gram stands in them), id, place (24 bits of the text's hash, then the offset)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in _packs(batches):
            at, h = least_grams(np.frombuffer(data, np.uint8), ends)
            text = np.searchsorted(ends, at, "right")
            starts = np.r_[0, ends[:-1]][text]
            lo, hi = np.maximum(starts, at - REST), np.minimum(ends[text], at + WINDOW)
            whole = memoryview(data)
            around = np.fromiter((xxhash.xxh3_64_intdigest(whole[a:z], seed=p - a) for a, p, z in zip(lo.tolist(), at.tolist(), hi.tolist())), np.uint64, len(at))
            tag = part.column(2).to_numpy()[text]
            place = (tag << PLACE_BITS) | (at - starts)
            ids = part.column(1).take(pa.array(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), ids, pa.array(place)], ["h", "around", "id", "place"]
            )

    return docs.select("text", "id", "tag").mapInArrow(made, f"h bigint, around bigint, id {_kind(docs)}, place bigint")


def _kind(docs: DataFrame) -> str:
    return docs.schema["id"].dataType.simpleString()


def offset() -> Column:
    return c("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (h, n, id, place) with before (bytes ahead of the gram) and bytes. Texts and places meet by document."""
    by_text = wanted.groupBy(c("id").alias("w_id"), F.shiftright("place", PLACE_BITS).alias("w_tag")).agg(
        F.collect_list(F.struct("h", "n", offset().alias("at"))).alias("w")
    )
    met = docs.join(by_text, docs["id"].eqNullSafe(c("w_id")) & (docs["tag"] == c("w_tag"))).select("text", "id", "tag", "w")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            row = pc.list_parent_indices(lists).to_numpy()
            flat = lists.flatten()
            at = flat.field("at").to_numpy()
            for lo in range(0, len(row), PACK_PLACES):
                part = slice(lo, lo + PACK_PLACES)
                r, p = row[part], at[part]
                texts = {i: b.column(0)[i].as_buffer().to_pybytes() for i in np.unique(r).tolist()}
                cuts = [texts[i][max(0, a - REST) : a + WINDOW] for i, a in zip(r.tolist(), p.tolist())]
                place = (b.column(2).to_numpy()[r] << PLACE_BITS) | p
                yield pa.RecordBatch.from_arrays(
                    [flat.field("h")[part], flat.field("n")[part], b.column(1).take(pa.array(r)), pa.array(place), pa.array(np.minimum(p, REST).astype(np.int32)), pa.array(cuts, pa.binary())],
                    ["h", "n", "id", "place", "before", "bytes"],
                )

    out = f"h bigint, n bigint, id {_kind(docs)}, place bigint, before int, bytes binary"
    return met.mapInArrow(cut_out, out)


def msd_order(bucket: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """The order of rows within their buckets (which come sorted), by passes from the first digit down. Rows that are alone leave."""
    order = np.arange(len(bucket))
    group = np.searchsorted(bucket, bucket)
    live = order.copy()
    for j in range(digits.shape[1]):
        g = group[live]
        tied = g[1:] == g[:-1]
        live = live[np.r_[False, tied] | np.r_[tied, False]] if len(live) else live
        if not len(live):
            break
        rows, g = order[live], group[live]
        by = np.lexsort((digits[rows, j], g))
        rows, g = rows[by], g[by]
        order[live] = rows
        digit = digits[rows, j]
        opens = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (digit[1:] != digit[:-1])])
        group[live] = np.repeat(live[opens], np.diff(np.r_[opens, len(live)]))
    return order


def side_classes(bucket: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """side: the bytes on one side of each gram, from the gram outwards. The class of each place by its first r bytes, for every r,
    and how many bytes it shares with any other place of its bucket (-1: there is no other)."""
    n = len(bucket)
    order = msd_order(bucket, side.view(">u8"))
    near = side[order]
    apart = np.ones((max(0, n - 1), side.shape[1] + 1), bool)
    np.not_equal(near[1:], near[:-1], out=apart[:, :-1])
    common = np.argmax(apart, axis=1)
    common[bucket[order[1:]] != bucket[order[:-1]]] = -1
    shared = np.empty(n, np.int64)
    shared[order] = np.maximum(np.r_[-1, common], np.r_[common, -1])
    classes = np.empty((REST + 1, n), np.int64)
    classes[:, order] = np.cumsum(np.r_[0, common][None, :] < np.arange(REST + 1)[:, None], axis=1)
    return classes, shared


def radix_repeats(bucket: np.ndarray, before: np.ndarray, size: np.ndarray, data: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: np.ndarray):
    """Which windows repeat an earlier one of their bucket: place number and offset d of the window before the gram.

    All windows of a bucket share the gram, so a window is told by the d bytes before it and the rest
    behind it. Both sides are ordered by digit passes; windows whose sides both fall into one class are the same.
    Places come in order within each bucket; lo and hi bound d; same marks a place that is its predecessor once more.
    """
    n, after = len(bucket), size - before - GRAM
    reach = np.arange(-(-REST // DIGIT) * DIGIT)
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    gram = start + before
    take = lambda at, there: padded[np.where(there, at, len(data))]
    ahead = take(gram[:, None] - 1 - reach, reach < before[:, None])
    behind = take(gram[:, None] + GRAM + reach, reach < after[:, None])
    left, left_shared = side_classes(bucket, ahead)
    right, right_shared = side_classes(bucket, behind)
    first = np.maximum(lo, REST - np.minimum(after, right_shared))
    last = np.minimum(hi, np.minimum(before, left_shared))
    each = np.maximum(0, last - first + 1)
    place = np.repeat(np.arange(n), each)
    d = first[place] + np.arange(len(place)) - np.repeat(np.cumsum(each) - each, each)
    key = (d * n + left[d, place]) * n + right[REST - d, place]
    order = np.argsort(key, kind="stable")
    key = key[order]
    opens = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    rank = np.cumsum(~same)[place[order]]  # equal places have the same
    later = order[rank > rank[opens][np.cumsum(opens) - 1]] if len(key) else order
    return place[later], d[later]


def _sorted_in_tasks(buckets: DataFrame, kind: str) -> DataFrame:
    """id, place, lo, hi: of each place the first and last d of its repeated windows; they all hold the gram, so they make one span."""
    met = buckets.repartition("node").sortWithinPartitions("node", "id", "place")
    met = met.select("node", "id", "place", "before", "bytes", "lo", "hi")

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
            node = t.column("node").to_numpy()
            borders = np.flatnonzero(node[1:] != node[:-1]) + 1
            lo = 0
            while len(borders) and borders[-1] > lo:
                hi = int(borders[max(0, int(np.searchsorted(borders, lo + PACK_PLACES, "right")) - 1)])
                hi = hi if hi > lo else int(borders[np.searchsorted(borders, lo, "right")])
                yield sort_pack(t.slice(lo, hi - lo))
                lo = hi
            rest = t.slice(lo)
        if rest is not None and rest.num_rows:
            yield sort_pack(rest)

    def sort_pack(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        (b,) = t.to_batches() or [pa.RecordBatch.from_pylist([], t.schema)]
        node, ids, place = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy()
        bucket = np.cumsum(np.r_[False, node[1:] != node[:-1]])
        like = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)), False).to_numpy(zero_copy_only=False)
        void = ids.is_null().to_numpy(zero_copy_only=False)
        same = np.r_[False, (like | (void[1:] & void[:-1])) & (place[1:] == place[:-1]) & (bucket[1:] == bucket[:-1])]
        cuts = b.column(4)
        size = pc.binary_length(cuts).to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(x.as_buffer() for x in cuts), np.uint8)
        which, d = radix_repeats(bucket, b.column(3).to_numpy().astype(np.int64), size, data, np.cumsum(size) - size, b.column(5).to_numpy(), b.column(6).to_numpy(), same)
        least, most = np.full(len(node), REST + 1), np.full(len(node), -1)
        np.minimum.at(least, which, d)
        np.maximum.at(most, which, d)
        at = np.flatnonzero(most >= 0)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at)), pa.array(place[at]), pa.array(least[at].astype(np.int32)), pa.array(most[at].astype(np.int32))], ["id", "place", "lo", "hi"]
        )

    return met.mapInArrow(ordered, f"id {kind}, place bigint, lo int, hi int")


def _halves(large: DataFrame) -> DataFrame:
    """Another pass: each half of a bucket's windows, dealt out by the bytes that all windows of that half have. Adds whole, a hash of all bytes of the half."""
    middle = F.floor((c("lo") + c("hi")) / 2).cast("int")
    each = large.select("*", F.explode(F.array(F.struct(c("lo").alias("a"), middle.alias("z")), F.struct((middle + 1).alias("a"), c("hi").alias("z")))).alias("half"))
    each = each.withColumns({"lo": c("half.a"), "hi": c("half.z")}).drop("half").where("lo <= hi")
    after = F.length("bytes") - c("before")
    some = (F.greatest(c("lo"), WINDOW - after) <= F.least(c("hi"), c("before")))
    cut = lambda left, right: F.expr(f"substring(bytes, before - ({left}) + 1, ({left}) + ({right}))")
    core = cut("lo", f"{WINDOW} - hi")
    whole = cut("least(hi, before)", f"least({WINDOW} - lo, length(bytes) - before)")
    return each.where(some).withColumns({"node": F.xxhash64("node", "lo", core), "whole": F.xxhash64(whole, F.least("hi", "before"), F.least(WINDOW - c("lo"), after))})


def _sorted(surroundings: DataFrame, tables: Tables, most: int) -> list[DataFrame]:
    """id, place, lo, hi of the repeated windows of all buckets. Those above `most` places are dealt out first."""
    kind = _kind(surroundings)
    rows = surroundings.select(c("h").alias("node"), "n", "id", "place", "before", "bytes", F.lit(0).alias("lo"), F.lit(REST).alias("hi"))
    out = [_sorted_in_tasks(rows.where(c("n") <= most), kind)]
    large = rows.where(c("n") > most)
    while not large.isEmpty():
        each = tables.cut(_halves(large.drop("n")))
        first = each.groupBy("node", "whole").agg(F.min(F.struct("id", "place")).alias("first"))
        met = each.join(first, ["node", "whole"])
        is_first = F.struct("id", "place").eqNullSafe(c("first"))
        out.append(met.where(~is_first).select("id", "place", "lo", "hi"))
        left = met.where(is_first).drop("first", "whole").dropDuplicates(["node", "id", "place"])
        n = first.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = tables.cut(left.join(n, "node"))
        out.append(_sorted_in_tasks(rows.where(c("n") <= most), kind))
        large = rows.where(c("n") > most)
    return out


def _covered(docs: DataFrame, marks: DataFrame, id_col: str) -> DataFrame:
    """marks: id, place, lo, hi. Removes the windows that start lo to hi bytes before their place."""
    from_ = F.greatest(offset() - c("hi"), F.lit(0))
    packed = from_ * 256 + (offset() - c("lo") + WINDOW - from_)
    by_text = marks.groupBy(c("id").alias("m_id"), F.shiftright("place", PLACE_BITS).alias("m_tag")).agg(F.collect_list(packed).alias("m"))
    met = docs.join(by_text, docs["id"].eqNullSafe(c("m_id")) & (docs["tag"] == c("m_tag")), "left").select("text", "id", "m")
    spans = "array<struct<start:bigint,end:bigint>>"
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, marked in zip(b.column(0), b.column(2)):
                data = text.as_buffer()
                n = len(data)
                if not marked.is_valid:
                    rows.append((n, 0, 0, hashlib.sha256(data).hexdigest(), []))
                    continue
                m = np.sort(marked.values.to_numpy())
                lo, hi = m >> 8, np.maximum.accumulate(np.minimum((m >> 8) + (m & 255), n))
                opens = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
                lo, hi = lo[opens], hi[np.r_[opens[1:] - 1, len(hi) - 1]]
                kept = hashlib.sha256()
                whole = memoryview(data)
                for a, z in zip([0, *hi.tolist()], [*lo.tolist(), n]):
                    kept.update(whole[a:z])
                found = [{"start": a, "end": z} for a, z in zip(lo.tolist(), hi.tolist())]
                rows.append((n, int((hi - lo).sum()), len(lo), kept.hexdigest(), found))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(1), *columns], names)

    return met.mapInArrow(removed, f"{id_col} {_kind(docs)}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans {spans}")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (bytes) of every row."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(text).bitwiseAND(F.lit((1 << 24) - 1)).alias("tag"))
    tables = Tables(docs.sparkSession)
    # a table of its own: the join with it can then split a hot gram
    repeated = tables.cut(_grams(rows).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    places = tables.cut(_places(rows).join(repeated, "h"))
    first = tables.cut(places.groupBy("h", "around").agg(F.min(F.struct("id", "place")).alias("first")))
    several = first.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = first.join(several, "h").select("h", "n", "first.id", "first.place")
    again = places.join(first, ["h", "around"]).where(~F.struct("id", "place").eqNullSafe(c("first")))
    marks = [again.select("id", "place", F.lit(0).alias("lo"), F.lit(REST).alias("hi"))]
    marks += _sorted(tables.cut(_surroundings(rows, wanted)), tables, most)
    every = marks[0]
    for m in marks[1:]:
        every = every.unionByName(m)
    every = tables.cut(every)
    tables.free(*(t for t, _ in tables.held if t is not every))
    return _covered(rows, every, id_col)
