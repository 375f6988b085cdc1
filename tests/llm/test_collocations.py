"""Collocations against counts of all phrases in dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("motionlake.llm")

from motionlake.llm import collocations as C  # noqa: E402


def lowered(t):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")


def brute(rows, least, longest, share, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(inside[lang, w[i : i + m]], a)
    out = {}
    for (lang, w), a in cand.items():
        if inside[lang, w] and 100 * inside[lang, w] >= share * a:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(
        (lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)
    )


def invented(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "b", "c", "é", "É", "x\x1cy", "don't", "(d", "nul\x00l", "日本"]
    rows = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(40)):
            words.append(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\n", "\r\n", "\x0b", "\t", "  ", "..", ". "]))
            if rng.random() < 0.3:
                words.append(rng.choice(["in spite of", "New York", "a a a a a", "new york state"]))
        rows.append((rng.choice(["en", "en", "de", "und", None]), " ".join(words)))
    return rows + [(None, None), ("fr", ""), ("de", " \t\n.,"), ("en", "b c " * 2000), ("xx", "only once"), ("en", rows[0][1]), ("en", rows[0][1])]


@pytest.mark.parametrize("seed,least,longest,share,top,chunk", [(1, 3, 4, 80, 2000, 8 << 20), (2, 2, 4, 80, 10, 300), (3, 5, 3, 50, 2000, 3000), (4, 3, 2, 80, 7, 1000)])
def test_collocations(spark, seed, least, longest, share, top, chunk):
    rows = invented(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, rank int, n int").repartition(3)
    got = C.collocations(df, least, longest, share, top, chunk_bytes=chunk)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, longest, share, top)
    assert C.collocations(df.limit(0), least, longest, share, top).count() == 0


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_CELLS", 1 << 16)
    rows = [(lang, text) for lang, text in invented(5)] + [("en", " ".join(f"w{i % 997} v{i % 991}" for i in range(40000)))]
    got = C.collocations(spark.createDataFrame(rows, "lang string, text string"), least=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 4, 80, 2000)


def test_sketch_never_understates():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    cells = C.Sketch.cells(hashes, 1 << 16)
    reached = np.zeros((2 << 16) // 8, np.uint8)
    for cell in cells:
        bits = np.zeros(2 << 16, bool)
        bits[cell[:100]] = True
        reached |= np.packbits(bits)
    assert C.Sketch(1 << 16, reached).may_reach(hashes[:100]).all() and C.Sketch(1 << 16, reached).may_reach(hashes).sum() < 200


def test_overlapping_matches_and_their_blocks(monkeypatch):
    monkeypatch.setattr(C, "AUTOMATON_PHRASES", 2)
    words = C.Words([b"a a a a, a  a\tb", b"b a"])
    text = words.plain(np.ones(len(words.ids), bool))
    assert C.matches(text, [b"a a", b"a a a", b"a b", b"b b", b"b a"]).tolist() == [4, 2, 1, 0, 1]
    some = words.plain(np.array([1, 1, 0, 1, 1, 1, 0, 1, 1], bool))
    assert C.matches(some, [b"a a", b"a", b"b a"]).tolist() == [2, 6, 1] and C.Words([b" \n"]).plain(np.zeros(0, bool)) == b""


def test_steps_come_back():
    for p in ([], [0], [3, 4, 255], [0, 300], [5, 70000, 1 << 20]):
        import pyarrow as pa

        assert C.places(pa.py_buffer(C.steps(np.array(p, np.uint32)))).tolist() == p
