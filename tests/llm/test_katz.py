"""Katz backoff against a model of dictionaries, and its normalisation."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kerbside.llm import katz
from kerbside.llm.katz import K, discounts, pack, score_documents, unpack, word_hashes


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Brute:
    def __init__(self, rows):
        self.ones, self.twos, self.after = Counter(), Counter(), defaultdict(set)
        for doc_id, text in rows:
            if not held(doc_id):
                before = "<start>", "start"
                for t in tokens(text):
                    self.ones[t] += 1
                    self.twos[before, t] += 1
                    self.after[before].add(t)
                    before = t
        self.n = sum(self.ones.values())
        self.contexts = Counter()
        for (v, _), c in self.twos.items():
            self.contexts[v] += c
        self.d1, self.d2 = (discounts([sum(c == r for c in table.values()) for r in range(1, K + 2)]) for table in (self.ones, self.twos))
        self.freed = sum((1 - self.d1[min(c, K + 1)]) * c for c in self.ones.values())

    def one(self, w):
        total = self.n if self.freed > 0 else self.n + 1
        c = self.ones.get(w, 0)
        return self.d1[min(c, K + 1)] * c / total if c else (self.freed or 1.0) / total

    def two(self, v, w):
        if v not in self.contexts:
            return self.one(w)
        seen = self.after[v]
        freed = sum((1 - self.d2[min(self.twos[v, x], K + 1)]) * self.twos[v, x] for x in seen)
        room = self.contexts[v] + (freed <= 0)
        c = self.twos.get((v, w), 0)
        if c:
            return self.d2[min(c, K + 1)] * c / room
        return (freed or 1.0) / room / (1 - sum(self.one(x) for x in seen)) * self.one(w)

    def score(self, text):
        before, total = ("<start>", "start"), 0.0
        for t in tokens(text):
            total += math.log10(self.two(before, t))
            before = t
        return total

    def rows(self, rows):
        v = len(self.ones)
        base = {t: math.log10((c + 0.1) / (self.n + 0.1 * (v + 1))) for t, c in self.ones.items()}
        other = math.log10(0.1 / (self.n + 0.1 * (v + 1)))
        return [(d, held(d), len(tokens(t)), sum(x in self.ones for x in tokens(t)), self.n,
                 sum(base.get(x, other) for x in tokens(t)), self.score(t)) for d, t in rows]


def same(df, want):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    want = sorted(want, key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], rel=1e-9, abs=1e-9)


def some_texts(seed, n=300):
    pick = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "ÉTÉ", "été"]
    weights = 1 / np.arange(1, len(words) + 1)
    return [(d, " ".join(pick.choice(words, pick.integers(0, 25), p=weights / weights.sum()))) for d in range(n)]


@pytest.mark.parametrize("blocks", [4_000_000, 1])
def test_scores_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", blocks)
    rows = [*some_texts(3), *some_texts(4, 50), (None, "the w1 never"), (1000, None), (1001, ""), (1002, " \n\t"), (30, "unheard of words the w1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    same(score_documents(docs), Brute(rows).rows(rows))


def test_hard_rows(spark, hard, clashing, empty):
    from tests.llm.conftest import HARD

    rows = [(r[0], r[1]) for r in HARD]
    want = Brute(rows).rows(rows)
    same(score_documents(hard), want)
    same(score_documents(clashing), want)
    assert score_documents(empty).collect() == []


def test_only_held_out(spark):
    same(score_documents(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id bigint, text string")),
         [(None, True, 3, 0, 0, 0.0, 0.0), (None, True, 1, 0, 0, 0.0, 0.0)])


@pytest.mark.parametrize("seed", range(5))
def test_the_reference_model_sums_to_one(seed):
    """The model that the scores are compared with is normalised after every context."""
    model = Brute(some_texts(seed))
    assert sum(model.one(w) for w in model.ones) + model.one("unknown") == pytest.approx(1)
    for v in [*model.contexts, "unknown"]:
        assert sum(model.two(v, w) for w in model.ones) + model.two(v, "unknown") == pytest.approx(1)


def test_longer_words_and_packing():
    texts = ["a " * 3 + "B" * 3000 + " b" * 2, "", "b" * 3000, "x" * 1024 + " " + "X" * 1023]
    hashes, sizes = word_hashes([t.encode() for t in texts])
    assert sizes.tolist() == [7, 1, 2, 3]
    names = [w for t in texts for w in tokens(t)]
    assert len({(w, h) for w, h in zip(names, hashes.tolist())}) == len(set(names)) == len(set(hashes.tolist()))
    for values in ([], [0], [255, 0, 7], [256, 1], [2 ** 32, 5], [2 ** 40]):
        assert unpack(pack(np.array(values, np.int64))).tolist() == values
