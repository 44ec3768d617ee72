"""Toxicity, near-duplicates and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from kerbside.llm.neardup import components, keep_one, near_duplicates, needed, shingles
from kerbside.llm.queries import ORACLE, QUERIES
from kerbside.llm.toxicity import fit, keep_clean, score_toxicity

TABLES = ["hard", "clashing", "empty"]


def made_up(n, seed=0):
    pick = random.Random(seed)
    syllables = ["an", "ti", "on", "er", "sha", "re", "wh", "ou", "nd", "in"]
    out = []
    for i in range(n):
        words = ["".join(pick.choice(syllables) for _ in range(pick.randint(1, 4))) for _ in range(60)]
        toxic = pick.random() < 0.3
        if toxic:
            words[pick.randrange(60)] = pick.choice(["idiot", "moron", "worthless"])
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = made_up(900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    aside = [(got[i].predicted, t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(p == t for p, t in aside) / len(aside) > 0.97
    assert {r.doc_id for r in keep_clean(docs, labels).collect()} == {i for i in got if not got[i].predicted}


def test_misspellings_share_ngrams():
    rows = made_up(600, seed=1)
    model = fit([t for _, t, _ in rows], [y for _, _, y in rows])
    clean = rows[[y for _, _, y in rows].index(0)][1]
    low, high = model.scores([clean, clean + " you idiott and worthles"])
    assert low < 0.5 < high and 0 <= model.scores([""])[0] < 0.5
    assert fit([], []).scores(["x"]).tolist() == [0.0]


@pytest.mark.parametrize("table", TABLES)
def test_toxicity_hard_rows(spark, request, texts, table):
    docs = request.getfixturevalue(table)
    labels = spark.createDataFrame([(5, 0), (12, 1), (None, 1), (99, 1), (7, None)], "doc_id long, toxic int")
    got = score_toxicity(docs, labels).collect()
    assert len(got) == (len(texts) if table != "empty" else 0) and all(0 <= r.score <= 1 for r in got)
    assert keep_clean(docs, labels).columns == docs.columns


def brute(rows):
    sets = {}
    for doc_id, text in rows:
        words = text.encode().lower().split()
        sets[doc_id] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                a_, b_ = root(a), root(b)
                top[max(a_, b_)] = min(a_, b_)
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


def near_copies(seed=0):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows, base = [], [word() for _ in range(150)]
    for i in range(120):
        if i % 3 == 0:
            text = passage + [word() for _ in range(70)]  # share a passage, no more
        elif i % 3 == 1:
            text = list(base)
            for _ in range(pick.choice([0, 1, 2, 4])):
                text[pick.randrange(150)] = word()
        else:
            text = [word() for _ in range(pick.choice([0, 1, 3, 30]))]
            text = text or ["short"]
        rows.append((i * 7 - 50, " ".join(text)))
    return rows


def test_near_duplicates_against_all_pairs(spark):
    rows = near_copies()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {tuple(r) for r in got} == brute(rows)


@pytest.mark.parametrize("table", TABLES)
def test_near_duplicates_hard_rows(request, texts, table):
    docs = request.getfixturevalue(table)
    got = near_duplicates(docs).collect()
    named = [(d, t) for d, t in texts if d is not None] if table != "empty" else []
    assert {tuple(r) for r in got if r.doc_id is not None} == brute(named)
    assert [tuple(r)[2:] for r in got if r.doc_id is None] == ([(None, True)] if named else [])
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _, _, k in brute(named) if k)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, 3)], "a long, b long")
    got = dict(components(edges).collect())
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_sequential_verification_misses_little():
    steps, pick = needed(), np.random.default_rng(1)
    equal = (pick.random((20000, 128)) < 0.75).cumsum(axis=1)
    assert sum((equal[:, n - 1] < m).sum() for n, m in steps) <= 2
    far = (pick.random((20000, 128)) < 0.3).cumsum(axis=1)
    assert np.any([far[:, n - 1] < m for n, m in steps], axis=0).mean() > 0.999


def test_shingles():
    assert len(shingles("")) == len(shingles(" \n ")) == 0 and len(shingles("one two")) == 1
    assert shingles("A b c d e").tolist() == shingles("a  B\tc d e ").tolist()
    assert shingles("É b").tolist() != shingles("é b").tolist() and len(shingles("a " * 100)) == 1


def test_pipeline_stages(spark, hard, clashing):
    sf = "/root/testdata/sf0.001"
    for docs in (hard, clashing):
        before = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, before, sf)
            assert after.columns == docs.columns, name
            ids = lambda d: {(r.doc_id,) for r in d.select("doc_id").collect()}
            assert ids(after) <= ids(before)
            before = after
        assert "sequence_id" in corpus_pipeline.STAGES[-1][1](spark, before, sf).columns


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    total = got.agg(F.sum("length"), F.max("sequence_id")).first()
    assert got.count() and total[1] == (total[0] - 1) // 4096


def test_queries_are_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
    assert ORACLE.keys() <= QUERIES.keys()
