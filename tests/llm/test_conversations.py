"""Conversation repair against a cheapest-path search over whole conversations."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from kerbside.llm import conversations
from kerbside.llm.conversations import AT_END, closing, damage, digests, edits, repair

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def cheapest(letters):
    """Dijkstra over (rows done, state), least audit first among equal costs."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if i == len(letters) and s in (0, 3):
            return cost, audit
        if (i, s) in done:
            continue
        done.add((i, s))
        heapq.heappush(heap, (cost + 5, audit + "I", i, NEXT[s]))
        if i < len(letters):
            c = letters[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, s))
            if c != "x":
                more = 5 if c.isupper() else 0
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, NEXT[s]))
                if (s, c.lower()) in KEPT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, KEPT[s, c.lower()]))


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("segment", [1, 3, 32])
def test_edits(monkeypatch, segment, seed):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    pick = np.random.default_rng(seed)
    for _ in range(20):
        letters = "".join(pick.choice(list("uuuaaasoxUAS"), pick.integers(0, 40)))
        audit, state = edits(letters, 0, AT_END)
        assert audit + closing(state) == cheapest(letters)[1]


def expected(rows):
    """All of the contract, row by row."""
    by: dict = {}
    for conv_id, turn, role, text in rows:
        kept = by.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        kept += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = []
    for conv_id, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts, letters, seen = [0, 0, 0], "", set()
        for _, role, text in kept:
            signs = re.sub(r"[\x20\x09-\x0D]", "", text)
            kind = 0 if not signs else 1 if (role, text) in seen else 2 if signs[-1] not in ".!?" else None
            seen.add((role, text))
            c = role[:1] if role[:1] in tuple("sua") else "o"
            if kind is not None:
                counts[kind] += 1
                c = c.upper() if kind == 2 else "x"
            letters += c
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = cheapest(letters)
        lines, i, s = [], 0, 0
        for e in audit:
            if e == "I":
                lines.append(f"{ROLE[s]}:")
            elif e != "D":
                lines.append(f"{kept[i][1] if e == 'K' else ROLE[s]}:{kept[i][2]}")
            if e != "D":
                s = KEPT[s, letters[i].lower()] if e == "K" else NEXT[s]
            i += e != "I"
        out.append((conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


KINDS = "conv_id bigint, turn bigint, role string, text string"


def rows_of(df):
    return sorted((tuple(r) for r in digests(repair(damage(df))).collect()), key=repr)


def some(seed, convs=60, longest=12):
    pick = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", "Aha. \n", "a", "b.", "c.", "ünd.", "d.", "e?", "f!", "g."]
    rows = []
    for c in range(convs):
        for t in range(int(pick.integers(1, longest))):
            role = ["user", "assistant"][t % 2] if pick.random() < 0.8 else str(pick.choice(["system", "user", "assistant", "tool", "", "User"]))
            rows.append((c, t + int(pick.random() < 0.1) * 100, role, str(pick.choice(texts)) if pick.random() < 0.4 else f"{c} {t}."))
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize("seed", range(3))
def test_conversations(spark, seed):
    rows = [*some(seed), (None, 3, "user", "x."), (None, None, None, None), (77, None, "user", "hm."), (77, 5, None, "so."), (78, None, "system", None),
            (79, 2, "assistant", "twice.")] + [(79, 1, "user", "same.")] * 3
    assert rows_of(spark.createDataFrame(rows, KINDS).repartition(5)) == expected(rows)


def test_long_conversation_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_ROWS", 7)
    pick = np.random.default_rng(9)
    rows = [(1, t, ["user", "assistant"][t % 2] if pick.random() < 0.8 else "system", f"{t % 90}." if pick.random() < 0.8 else "cut") for t in range(700)]
    rows += some(5, 20)
    rows = list({(r[0], r[1]): r for r in rows}.values())
    assert rows_of(spark.createDataFrame(rows, KINDS).repartition(6)) == expected(rows)


def test_everything_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert rows_of(spark.createDataFrame([(5, turn, "user", "gone.")], KINDS)) == [
        (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_and_clashing(spark):
    from pyspark.sql import functions as F

    assert rows_of(spark.createDataFrame([], KINDS)) == []
    rows = some(7, 10)
    names = ("key", "part", "seq", "hash", "tie", "gone", "fault", "settled", "copy", "audit", "cost", "__key")
    df = spark.createDataFrame(rows, KINDS)
    assert rows_of(df.select("*", *(F.lit("theirs").alias(n) for n in names))) == expected(rows)
    assert [r[1:] for r in rows_of(df.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text"))] == [
        r[1:] for r in sorted(expected(rows), key=lambda r: repr(str(r[0])))]
