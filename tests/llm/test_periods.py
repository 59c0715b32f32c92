"""Periodic runs against plain loops, on made-up texts and on all documents of sf0.001."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from linework.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=24, times=3):
    """(start, length, period): for each period every stretch of equal words so far apart; the smallest period of a stretch stays."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def made(rng):
    """Words of few kinds: noise, a Fibonacci word, repeats of units that hold repeats themselves."""
    n, kind = rng.randint(0, 220), rng.randrange(4)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    out = []
    while len(out) < n:
        inner = [rng.randrange(2) for _ in range(rng.randint(1, 4))]
        unit = [rng.randrange(3) for _ in range(rng.randint(0, 3))] + (inner * 20)[: rng.randint(1, 40)] + [rng.randrange(3) for _ in range(rng.randint(0, 2))]
        out += (unit * 10)[: rng.randint(1, 5 * len(unit))] if rng.random() < 0.8 else [rng.randrange(60) for _ in range(rng.randint(1, 20))]
    return out[:n]


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_made_up_texts(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = [made(rng) for _ in range(rng.randint(1, 4))]
        sizes = np.array([len(t) for t in texts])
        got = periodic_runs.find_runs(np.array([w + 100 * k for k, t in enumerate(texts) for w in t], np.int64), sizes)
        want = [(s + at, length, q) for at, t in zip(np.cumsum(sizes) - sizes, texts, strict=True) for s, length, q in plain_runs(t)]
        assert [tuple(r) for r in got.tolist()] == want


def test_one_run_of_many_words():
    unit = np.random.default_rng(3).integers(0, 5000, 700)
    got = periodic_runs.find_runs(np.concatenate([[9000], np.tile(unit, 300), [9001]]), np.array([210_002]))
    assert got.tolist() == [[1, 210_000, 700]]


def test_other_limits():
    words = [k % 30 for k in range(100)]
    assert len(periodic_runs.find_runs(np.array(words), np.array([100]), 24, 4)) == 0
    assert len(periodic_runs.find_runs(np.array(words), np.array([100]), 101)) == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.array(words), np.array([100]), 10)


def test_all_documents(spark, small):
    """The query against plain loops; words are split and planted anew here."""
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got.values()) > 10
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc_id, text in docs:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, r = plain_runs(words), got[doc_id]
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda x: (-x[1] * 10**9 // x[2], x[0], x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == digest("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert r.collapsed_sha256 == digest(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_odd_rows_of_runs(spark):
    beat = " ".join(["tick", "tock", "boom"] * 10)
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, f"so {beat} end"), (5, beat), (5, beat), (6, "a b " * 30), (7, "word " * 300_000)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, runs string, id string")
    got = periodic_runs.periodic_runs(df).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    by = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in got}
    assert by[1] == by[2] == by[3] == ([], "")
    assert by[None] == ([(1, 30, 3)], "so tick tock boom end") and by[5] == ([(0, 30, 3)], "tick tock boom")
    assert by[6] == ([(0, 30, 1)], "a b") and by[7] == ([(0, 300_000, 1)], "word")
    assert sum(r.doc_id == 5 for r in got) == 2
    assert periodic_runs.run_digests(df.limit(0)).collect() == [] and periodic_runs.run_digests(df).count() == len(rows)


def test_best_run_and_ties(spark):
    one, two = " ".join(["a", "b"] * 12), " ".join(["c", "d"] * 12)
    docs = spark.createDataFrame([(10**6 + 1, f"{one} x {two} y {' '.join(['e'] * 24)}"), (10**6 + 2, f"{one} x {two}")], "doc_id long, text string")
    assert all(zlib.crc32(str(10**6 + k).encode()) % 10 for k in (1, 2))
    got = {r.doc_id: r for r in periodic_runs.run_digests(docs).collect()}
    a, b = got[10**6 + 1], got[10**6 + 2]
    assert (a.n_runs, a.start, a.length, a.period, a.exponent_milli) == (3, 50, 24, 1, 24_000)
    assert (b.n_runs, b.start, b.length, b.period, b.exponent_milli) == (2, 0, 24, 2, 12_000)
