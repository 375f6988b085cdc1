"""Repeated windows against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("motionlake.llm")

from motionlake.llm import window_dedup as W  # noqa: E402


def brute(docs):
    """docs: (id, text bytes), in order."""
    first, out = {}, []
    for k, (_, t) in enumerate(docs):
        hit = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 99):
            if first.setdefault(t[i : i + 100], (k, i)) != (k, i):
                hit[i] += 1
                hit[min(len(t), i + 100)] -= 1
        gone = np.cumsum(hit)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int))).tolist()
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), list(zip(edges[::2], edges[1::2]))))
    return out


def invented(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(n) for n in (20, 30, 60, 200)]
    texts = ["", None, "short", "x" * 99, "y" * 100, "z" * 101, "z" * 500, "ab" * 300, "long " * 3000, shared[3]]
    for _ in range(120):
        parts = [prose(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            s = list(rng.choice(shared))
            for _ in range(rng.choice([0, 0, 1, 5])):
                s[rng.randrange(len(s))] = rng.choice("QRS")
            parts += ["".join(s), prose(rng.randrange(40))]
        texts.append("".join(parts))
    texts += [shared[2][3:], "ÀÉ" * 40 + shared[1], rng.choice(texts[20:])]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,most", [(1, 4096), (2, 4), (3, 1)])
def test_windows(spark, seed, most):
    """most=4 and 1: buckets are dealt out again and again, in the end by single windows."""
    texts = invented(seed)
    rows = [(2 * i, t, 1, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, h int, spans string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, [tuple(s) for s in r.spans]) for r in W.repeated_windows(df, most=most).collect()}
    assert got == dict(zip((r[0] for r in rows), brute([(r[0], (r[1] or "").encode()) for r in rows])))


def test_same_and_null_ids(spark):
    a, b = "0123456789" * 10 + "tail", "".join(chr(97 + i * i % 23) + str(i) for i in range(60))[:150]
    rows = [(None, a), (1, a), (2, b), (2, b), (3, b + a), (3, "other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in W.repeated_windows(df).collect()), key=str)
    assert got == sorted([(None, 104, 0, 0), (1, 104, 104, 1), (2, 150, 0, 0), (2, 150, 0, 0), (3, 254, 254, 1), (3, 5, 0, 0)], key=str)
    assert W.repeated_windows(df.limit(0)).count() == 0


def test_large_group_in_packs(spark, monkeypatch):
    """Thousands of near copies with edits at one place: many surroundings for each gram."""
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = []
    for _ in range(600):
        s = list(base)
        s[rng.randrange(400)] = rng.choice("XYZ")
        texts.append("".join(s))
    want = brute([(i, t.encode()) for i, t in enumerate(texts)])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    for most in (4096, 60):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in W.repeated_windows(df, most=most).collect()}
        assert got == {i: w[:4] for i, w in enumerate(want)}
