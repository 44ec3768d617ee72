"""Operators that look at each document or at id order: licences, quality, fingerprints, shards, personal data."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kerbside.llm import pii
from kerbside.llm.fingerprints import Prefixes, fingerprint_documents
from kerbside.llm.licences import scan_licences
from kerbside.llm.quality import counts, keep_good, quality_rules
from kerbside.llm.sharding import permute, row_in_slot, shard_documents, unpermute

TABLES = ["hard", "clashing", "empty"]


def rows(frame, n):
    return sorted((tuple(r)[:n] for r in frame.collect()), key=str)


@pytest.mark.parametrize("table", TABLES)
def test_licences(request, texts, table):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    want = []
    for doc_id, text in texts if table != "empty" else []:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        at = [(i, name) for p, name in phrases.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        want.append((doc_id, len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in at}))))
    got = scan_licences(request.getfixturevalue(table))
    assert rows(got, 6) == sorted(want, key=str)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got.collect())


def test_licences_beyond_the_base(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "gnu general public licence version 3",
             "cc by nc cc by nc", "the mit license under"]
    got = scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.labels, r.n_base, r.score > 0) for r in sorted(got)] == [("gpl-3", 0, True), ("", 0, False), ("cc-by-nc", 2, True), ("", 0, False)]


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(marked))


def test_quality_counts():
    pick = random.Random(5)
    for _ in range(500):
        text = "".join(pick.choice(["a ", "b ", "é", "#", "\n", "\t", " ", "\x1c", "a b c d e f\n", "|"]) for _ in range(pick.randint(0, 40)))
        n, chars, symbols, _, dup, repeat, _ = counts(text)
        assert (n, chars, symbols, dup, repeat) == brute_counts(text)


@pytest.mark.parametrize("table", TABLES)
def test_quality(request, texts, table):
    docs = request.getfixturevalue(table)
    want = []
    for doc_id, text in texts if table != "empty" else []:
        n, chars, symbols, dup, repeat = brute_counts(text)
        want.append((doc_id, n, chars, symbols, dup, repeat, n < 10 or 100 * repeat > 20 * n))
    assert rows(quality_rules(docs), 7) == sorted(want, key=str)
    assert keep_good(docs).columns == docs.columns


def test_quality_follows_the_source(spark):
    plain = [(i, " ".join(f"w{i + 1000}x{j}" for j in range(30)), "en", "plain") for i in range(300)]
    hashes = [(1000 + i, " ".join(f"#w{i + 1000}x{j}" for j in range(30)), "en", "tags") for i in range(300)]
    odd = [(5000, " ".join(f"##w{j}" for j in range(30)), "en", "plain"), (5001, " ".join(f"#v2000x{j}" for j in range(30)), "en", "tags")]
    docs = spark.createDataFrame(plain + hashes + odd, "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in quality_rules(docs).where("not kept").collect()] == [5000]


@pytest.mark.parametrize("table", TABLES)
def test_fingerprints(request, texts, table):
    got = fingerprint_documents(request.getfixturevalue(table)).collect()
    ordered = sorted(texts if table != "empty" else [], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (doc_id, text) in enumerate(ordered):
        after, n = ordered[(i + 1) % len(ordered)][1], len(text) // 4
        edited = text[:len(text) - n] + after[:n]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), Prefixes.of(text).fingerprint(), Prefixes.of(edited).fingerprint()))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.near_edited >= 0.74 for r in got)


def test_prefix_hashes():
    pick = random.Random(4)
    for _ in range(500):
        a, b = ("".join(pick.choice("ab") for _ in range(pick.randint(0, 30))) for _ in range(2))
        x, y = Prefixes.of(a), Prefixes.of(b)
        i, j = pick.randint(0, len(a)), pick.randint(0, len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert x.extension(i, y, j) == n
        assert (x.fingerprint() == y.fingerprint()) == (a == b) == (x.likeness(y) == 1)


def test_permutation():
    for n in (1, 2, 3, 64, 65, 1000):
        places = permute(np.arange(n), n, seed=3)
        assert sorted(places.tolist()) == list(range(n))
        assert unpermute(places, n, seed=3).tolist() == list(range(n))


@pytest.mark.parametrize("table", TABLES)
def test_shards(request, texts, table):
    got = shard_documents(request.getfixturevalue(table), 8).collect()
    texts = texts if table != "empty" else []
    want = [(d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts]
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(want, key=str)
    sizes = Counter(r.shard for r in got)
    assert not got or max(sizes[s] for s in range(8)) - min(sizes[s] for s in range(8)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert all(row_in_slot(r.shard, r.slot, len(got), 8) == r.row_number for r in got)


def brute_spans(text):
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
             ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for kind, pattern in kinds:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def test_base_spans():
    pick = random.Random(2)
    parts = ["a", "b1", "@", "@", "a@b.co", ".", "1", "255", "1.2.3.4", "+", "+1 (555) 555-1234", " ", "-", "4041894974608795", "é", "%", "0", "٣", "\n"]
    for _ in range(4000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(1, 14)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("a" * 10 ** 6 + "1" * 10 ** 6 + "." + "+1" + " " * 10 ** 6) == []  # in linear time


@pytest.mark.parametrize("table", TABLES)
def test_personal_data(request, texts, table):
    docs = request.getfixturevalue(table)
    want = []
    for doc_id, text in texts if table != "empty" else []:
        spans = brute_spans(text)
        n = Counter(k for k, _, _ in spans)
        want.append((doc_id, *(n[k] for k in pii.BASE), hashlib.sha256(pii.written(spans).encode()).hexdigest()))
    assert rows(pii.detect(docs), 6) == sorted(want, key=str)
    masked = pii.mask_documents(docs)
    assert masked.columns == docs.columns and masked.count() == len(want)
    if table != "empty":
        got = {r.doc_id: r.text for r in masked.collect()}
        assert got[12] == "mail [EMAIL] from [IP], card [CARD] or [PHONE]" and got[3] is None and got[5].startswith("The quick")


def test_labelers_find_a_noisy_one():
    pick, counted = random.Random(1), Counter()
    for _ in range(4000):
        true = pick.random() < 0.5
        good = [(1 if true else -1) * (1 if pick.random() < 0.9 else -1) for _ in range(4)]
        counted[(0, *good, pick.choice([-1, 1]), 0, 4, 2)] += 1
    patterns, n = np.array(sorted(counted)), np.array([counted[p] for p in sorted(counted)], float)
    chance, table = pii.reliabilities(patterns, n)
    assert all(table[1, j, 2] > 0.8 for j in range(4)) and abs(table[1, 4, 2] - 0.5) < 0.1
    assert pii.train(list(counted.items())).accepts([(0, 1, 1, 1, 1, -1, 0, 4, 2), (0, -1, -1, -1, -1, 1, 0, 4, 2)]) == [True, False]
