"""Periodic runs against brute force."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from kerbside.llm.repair_runs import find_runs, repeat_tail, run_digests, runs_of


def brute(words):
    """All runs of at least max(6, 4 q) words, from every start and period."""
    found, n = set(), len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            left, right = i, j + q
            if right - left >= max(6, 4 * q) and not any(all(words[k] == words[k + d] for k in range(left, right - d)) for d in range(1, q)):
                found.add((left, right, q))
            i = j + 1
    return found


def random_words(pick):
    """Short alphabets, powers of words, passages that come again."""
    parts = []
    for _ in range(pick.integers(1, 8)):
        base = pick.integers(0, pick.integers(1, 6), pick.integers(1, 12)).tolist()
        parts += (base * 8)[:pick.integers(1, 70)] if pick.random() < 0.6 else base
    return parts + parts[: pick.integers(0, len(parts) + 1)]


@pytest.mark.parametrize("seed", range(60))
def test_runs_against_brute_force(seed):
    pick = np.random.default_rng(seed)
    docs = [random_words(pick) for _ in range(6)] + [[], [1] * 100, [0, 1] * 40, [0, 0, 0, 1] * 30 + [2] * 5, list(range(50)) * 5]
    words = np.array([w for d in docs for w in d])
    sizes = np.array([len(d) for d in docs])
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    got = {tuple(r) for r in runs_of(words, np.repeat(np.arange(len(docs)), sizes)).tolist()}
    assert got == {(a + f, b + f, q) for d, f in zip(docs, firsts.tolist()) for a, b, q in brute(d)}


def test_long_text():
    words = np.concatenate([np.arange(5000), np.tile(np.arange(3000), 5), np.arange(70000) % 9000 * 3, np.zeros(200_000, np.int64)])
    runs = {tuple(r) for r in runs_of(words, np.zeros(len(words), np.int64)).tolist()}
    assert runs == {(5000, 20001, 3000), (20000, 90000, 9000), (90000, 290000, 1)}


def expected(doc_id, text, planted=True):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n = len(words)
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted((a, q, b - a) for a, b, q in brute(words))
    drop = {k for a, q, size in runs for k in range(a + q, a + size)}
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    lines = "".join(f"{a},{size},{q}\n" for a, q, size in runs)
    return (doc_id, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in drop).encode()).hexdigest())


def rows(df):
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


MORE = [(d, " ".join(f"w{(i * i) % (7 + d % 5)}" for i in range(40 + d)) + " go" * (d % 9)) for d in range(100, 160)]


def test_rows(spark, hard, clashing, empty):
    from tests.llm.conftest import HARD

    short = [(r[0], "word " * 200 if r[0] == 11 else r[1]) for r in HARD]
    docs = spark.createDataFrame(short + MORE, "doc_id bigint, text string").repartition(3)
    assert rows(run_digests(find_runs(docs, planted=True))) == sorted((expected(d, t or "") for d, t in short + MORE), key=repr)
    assert rows(run_digests(find_runs(docs))) == sorted((expected(d, t or "", False) for d, t in short + MORE), key=repr)
    assert rows(run_digests(find_runs(clashing, planted=True))) == rows(run_digests(find_runs(hard, planted=True)))
    assert rows(run_digests(find_runs(empty))) == []


def test_edit_keeps_what_it_should():
    hit = next(d for d in range(1000) if zlib.crc32(str(d).encode()) % 10 == 0)
    assert repeat_tail(0, hit).tolist() == [] and repeat_tail(7, 1).tolist() == list(range(7))
    assert sorted(set(repeat_tail(50, hit).tolist())) != list(range(50))
