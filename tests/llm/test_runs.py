"""Periodic runs against a search that tries every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("motionlake.llm")

from motionlake.llm import periodic_runs as P  # noqa: E402


def brute(words):
    n, ends = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                ends.setdefault((i, j - i + q), q)  # the least period comes first
            i = j + 1
    return sorted(((s, m, q) for (s, m), q in ends.items()), key=lambda r: (r[0], r[2]))


def invented(rng):
    k, n = rng.choice([1, 2, 2, 3, 9]), rng.randrange(60)
    words = [b"%d" % rng.randrange(k) for _ in range(n)]
    if words and rng.random() < 0.5:
        words = words[: rng.randrange(1, max(2, n // 3))] * rng.randrange(1, 9) + words
    return words


def test_runs_of_packs():
    rng = random.Random(1)
    for _ in range(400):
        texts = [invented(rng) for _ in range(rng.randrange(1, 6))]
        ids = {}
        symbols = np.array([ids.setdefault((i, w), len(ids)) for i, t in enumerate(texts) for w in t], np.int64)
        got = list(zip(*(x.tolist() for x in P.runs_of(symbols, np.array([len(t) for t in texts])))))
        want, before = [], 0
        for t in texts:
            want += [(s + before, m, q) for s, m, q in brute(t)]
            before += len(t)
        assert got == want


def test_grid_and_queries_in_pieces(monkeypatch):
    monkeypatch.setattr(P, "GRID_PLACES", 7)
    rng = random.Random(2)
    for _ in range(100):
        words = invented(rng)
        ids = np.array([int(w) for w in words], np.int64)
        assert list(zip(*(x.tolist() for x in P.runs_of(ids, np.array([len(ids)]))))) == brute(words)


def expected(text, doc_id):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    milli = 1000 * best[1] // best[2] if found else None
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("pack", [40, 1 << 17])
def test_query_over_odd_rows(spark, pack):
    rng = random.Random(3)
    rows = [(i, " ".join(w.decode() for w in invented(rng)), 1) for i in range(120)]
    rows += [(500, None, 2), (501, "", 2), (None, "a " * 9, 2), (502, " \t\n", 2), (503, "b c " * 3000 + "É\x1cd " * 5, 2), (503, "x", 2), (503, "x", 2), (504, "a\x0bA\x0ca a\ra a a a", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_runs int").repartition(3)
    got = sorted(map(tuple, P.periodic_runs(df, with_tails=True, pack_words=pack).collect()), key=str)
    assert got == sorted(((i, *expected(t, i)) for i, t, _ in rows), key=str)
    assert P.periodic_runs(df.limit(0)).count() == 0
