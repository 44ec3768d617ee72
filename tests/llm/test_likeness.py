"""Likeness over all common spans."""

import random

import pytest

from kerbside.llm.fingerprints import BLOCK, SPAN, Prefixes, fingerprint_documents


def prose(pick, n):
    return " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 9))) for _ in range(n))


def like(a, b):
    got = Prefixes.of(a).likeness(Prefixes.of(b))
    assert abs(got - Prefixes.of(b).likeness(Prefixes.of(a))) < 0.05
    return got


def test_likeness_of_near_copies():
    pick = random.Random(3)
    text = prose(pick, 2000)
    assert like(text, "x" + text + "x") == len(text) / (len(text) + 2)
    words = text.split(" ")
    for at in range(50, 2000, 100):
        words[at] = "EDITED"
    assert like(text, " ".join(words)) > 0.97
    assert like(text, prose(pick, 2000)) < 0.02
    half = len(text) // 2
    assert 0.49 < like(text, text[half:] + text[:half]) < 0.51  # one of the halves is out of order
    assert like("x" + "word " * 30000, "y" + "word " * 30000 + "z") > 0.999
    assert abs(like("x" + text + "y", "z" + text * 3) - 1 / 3) < 0.01  # no place counts twice


def test_likeness_counts_spans_by_their_length():
    for n in (BLOCK, SPAN - 1, SPAN, SPAN + 1, 100):
        for shift in range(BLOCK):
            span = prose(random.Random(n), 60)[:n]
            a, b = "A" * (shift + 1) + span + "B" * 40, "C" * 30 + span + "D" * 20
            assert Prefixes.of(a).likeness(Prefixes.of(b)) * max(len(a), len(b)) == pytest.approx(n if n >= SPAN else 0)


def test_common_spans_are_equal_ordered_and_apart():
    pick = random.Random(8)
    parts = [prose(pick, pick.randint(1, 12)) for _ in range(12)]
    for _ in range(300):
        a, b = ("".join(pick.choice(parts) for _ in range(pick.randint(0, 15))) for _ in range(2))
        x, y = Prefixes.of(a), Prefixes.of(b)
        i, j = 0, 0
        for at, other, n in x.spans_between(y, 0, 0):
            assert n > 0 and at >= i and other >= j and a[at:at + n] == b[other:other + n]
            i, j = at + n, other + n
        assert i <= len(a) and j <= len(b) and (x.likeness(y) == 1) == (a == b)


def test_near_next_of_a_copy_with_both_ends_edited(spark):
    text = prose(random.Random(5), 300)
    docs = spark.createDataFrame([(1, text), (2, "x" + text + "x")], "doc_id long, text string")
    assert all(r.near_next > 0.99 for r in fingerprint_documents(docs).collect())
