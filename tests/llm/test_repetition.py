"""Word runs against brute force, whole and in tiles, and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, body string, runs int, key string"


def brute(w):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i >= p and j - i + p >= 12:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(w, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, text):
    w, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def sequences(rng, count, most):
    for _ in range(count):
        n, letters = rng.randrange(most), rng.choice([1, 2, 3, 40])
        w = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3 + 1))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield w


def test_runs_equal_brute_force_whole_and_in_tiles():
    for w in sequences(random.Random(1), 400, 130):
        x = np.array(w, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(99)
        assert list(zip(*(v.tolist() for v in repetition.whole(x)), strict=True)) == brute(w)
        parts = []
        for first, last, lo, hi, low, high in repetition.cut(len(w), 16):
            assert last - first <= 2 * max(16, repetition.CORE << low) + (10 << high)
            p, a, b = repetition.fragments(x[first:last], lo - first, hi - first, range(low, high))
            parts += zip(p.tolist(), (a + first).tolist(), (b + first).tolist(), strict=True)
        p, a, b = repetition.joined(*(np.array(v, np.int64) for v in (zip(*parts, strict=True) if parts else ([], [], []))))
        found = {}
        for q, s, e in zip(p.tolist(), a.tolist(), b.tolist(), strict=True):
            if e - s >= q and e - s + q >= 12:
                found[s, e + q] = min(q, found.get((s, e + q), q))
        assert sorted((s, e - s, q) for (s, e), q in found.items()) == brute(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = [None, "", " \t\n ", "one", "a " * 40, "a b " * 300, "é ü " * 9, "same line here\n" * 50]
    texts += [" ".join(f"w{v}" for v in w) for w in sequences(rng, 60, 200)]
    long = [f"w{rng.randrange(500)}" for _ in range(700)]
    texts += [" ".join(long + long[:300] + long[-40:] * 4), " ".join(long * 2), "x" * 500]
    out = [(k, t, "en", None, 1, "i", None, 3, "k") for k, t in enumerate(texts)]
    return [*out, (None, "b " * 30, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), out[5], out[-2], out[-2]]


@pytest.mark.parametrize("sizes", [{}, {"tile": 64, "whole_bytes": 300}, {"tile": 16, "whole_bytes": 0}])
def test_runs_of_odd_rows(spark, rows, sizes):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in repetition.runs(docs, **sizes).collect()), key=str)
    want = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        want.append((r[0], len(w), brute(w), collapsed(w, brute(w))))
    assert got == sorted(want, key=str)
    assert repetition.runs(docs.limit(0), **sizes).count() == 0


def test_query_equals_brute_force(spark, rows, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    got = sorted(map(str, (tuple(r) for r in repetition.op11_runs(spark, folder).collect())))
    want = []
    for r in rows:
        w = planted(r[0], r[1])
        runs = brute(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r[0], len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(collapsed(w, runs)), len(w)))
    assert got == sorted(map(str, want))
