"""Periodic runs of words by grammar compression: Re-Pair over word ids, one look at every nonterminal's boundary.

All stretches of words of a slice of documents share one grammar. Re-Pair goes in rounds: every pair of neighbouring symbols
that is more frequent than the pairs it overlaps becomes a nonterminal, as long as it stands twice; what is left of a stretch
is folded into a balanced tree of nonterminals that stand once. A run that lies in a text lies in the expansion of some lowest
nonterminal and crosses the boundary between its two halves. So each nonterminal is expanded once, at its first place, and
searched for runs across its boundary; those are translated to all places of its derivation, and intervals of one period that
share a period's length are merged into maximal ones.

A run of 4 periods and 6 words or more has only 4-word windows that stand twice in its text. Words outside such windows are
seams: no run crosses them, and Re-Pair gets the stretches in between. Span equality is by prefix hashes (62 bits), and every
run is compared word by word in the end.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import field, slices

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Two moduli and bases of the prefix hashes.
MODULI = ((2147483647, 1000003), (2147483629, 998244353))
#: (nonterminal, period) candidates that are tested at once.
TESTED = 1 << 20
#: A round that shortens the sequence by less than this share is the last before folding.
LEAST_GAIN = 0.01

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Spans:
    """Equality of spans of one sequence by prefix sums of its polynomial terms."""

    def __init__(self, items: np.ndarray):
        self.tables = []
        for p, base in MODULI:
            p = np.uint64(p)
            powers = np.ones(len(items) + 1, np.uint64)
            filled, step = 1, np.uint64(base)
            while filled < len(powers):
                n = min(filled, len(powers) - filled)
                powers[filled:filled + n] = powers[:n] * step % p
                filled, step = filled + n, step * step % p
            sums = np.concatenate([[np.uint64(0)], np.cumsum((items.astype(np.uint64) + np.uint64(1)) % p * powers[:-1] % p)]) % p
            self.tables.append((p, powers, sums))

    def equal(self, a: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n items from a are those from c, a <= c."""
        same = np.ones(len(a), bool)
        for p, powers, sums in self.tables:
            same &= (sums[a + n] + p - sums[a]) % p * powers[c - a] % p == (sums[c + n] + p - sums[c]) % p
        return same

    def forward(self, a: np.ndarray, c: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the right of a and c, a <= c, `most` at most, by binary search."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a, c, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def backward(self, a: np.ndarray, c: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same to the left: of the items before a and before c."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a - mid, c - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def edges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true flags."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def repeated_windows(words: np.ndarray, doc: np.ndarray, width: int = 4) -> np.ndarray:
    """Whether the window of `width` words from each place stands at two places of its document at least.

    Windows meet by a 64-bit sum; a clash only keeps words that aren't needed.
    """
    n = len(words) - width + 1
    live = np.zeros(len(words), bool)
    if n < 2:
        return live
    odd = (np.random.default_rng(11).integers(1, 2 ** 63, width + 1).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    key = (doc[:n].astype(np.uint64) + np.uint64(1)) * odd[width]
    for k in range(width):
        key += (words[k:k + n].astype(np.uint64) + np.uint64(1)) * odd[k]
    inside = np.flatnonzero(doc[:n] == doc[width - 1:])
    order = inside[np.argsort(key[inside])]
    again = key[order[1:]] == key[order[:-1]]
    live[order[1:][again]] = True
    live[order[:-1][again]] = True
    return live


class Grammar:
    """Nonterminals of one sequence that falls into stretches: first place, boundary and end of each, and all its places."""

    def __init__(self, items: np.ndarray, stretch: np.ndarray):
        self.rules: list[tuple[np.ndarray, ...]] = []
        self.made = 0
        names, symbols = np.unique(items, return_inverse=True)
        state = symbols.astype(np.int64), np.arange(len(items)), np.ones(len(items), np.int64), stretch
        total = len(names)
        while True:
            state, total, gain = self._round(*state, total)
            if gain < LEAST_GAIN:
                break
        while True:
            symbols, at, size, stretch = state
            first = np.concatenate([[True], stretch[1:] != stretch[:-1]]) if len(stretch) else np.empty(0, bool)
            place = np.arange(len(stretch)) - np.maximum.accumulate(np.where(first, np.arange(len(stretch)), 0))
            pick = np.flatnonzero((place[:-1] % 2 == 0) & ~first[1:])
            if not len(pick):
                break
            state = self._replace(pick, np.arange(len(pick)), total, *state)
            total += len(pick)

    def _round(self, symbols, at, size, stretch, total):
        """One round of Re-Pair."""
        pair = np.flatnonzero(stretch[1:] == stretch[:-1])
        if not len(pair):
            return (symbols, at, size, stretch), total, 0.0
        kinds, kind, counts = np.unique(symbols[pair] * total + symbols[pair + 1], return_inverse=True, return_counts=True)
        mixed = (np.arange(len(kinds), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        rank = np.zeros(len(symbols) + 1, np.int64)  # of the pair from each place; the last entry stands for the one before the first
        rank[pair] = (np.where(counts > 1, counts, 0)[kind] << 31) + np.where(counts > 1, mixed, 0)[kind].astype(np.int64)
        here = rank[:-1]
        best = (here > 0) & (here >= rank[np.arange(len(symbols)) - 1]) & (here >= rank[1:])
        starts, ends = edges(best)
        origin = np.zeros(len(symbols), np.int64)
        origin[best] = np.repeat(starts, ends - starts)
        pick = np.flatnonzero(best & ((np.arange(len(symbols)) - origin) % 2 == 0))
        of = np.full(len(symbols), -1, np.int64)
        of[pair] = kind
        taken = np.bincount(of[pick], minlength=len(kinds))
        pick = pick[taken[of[pick]] > 1]
        if not len(pick):
            return (symbols, at, size, stretch), total, 0.0
        names, rule = np.unique(of[pick], return_inverse=True)
        state = self._replace(pick, rule, total, symbols, at, size, stretch)
        return state, total + len(names), len(pick) / len(symbols)

    def _replace(self, pick, rule, total, symbols, at, size, stretch):
        """The picked symbols and their right neighbours become nonterminals; `rule` numbers them within the round."""
        order = np.argsort(rule, kind="stable")
        places, numbers = at[pick][order], rule[order] + self.made
        first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        left, whole = size[pick][order][first], (size[pick] + size[pick + 1])[order][first]
        self.rules.append((places[first], places[first] + left, places[first] + whole, places, np.diff(np.append(first, len(places)))))
        self.made += len(first)
        symbols, size = symbols.copy(), size.copy()
        symbols[pick], size[pick] = total + rule, size[pick] + size[pick + 1]
        keep = np.ones(len(symbols), bool)
        keep[pick + 1] = False
        return symbols[keep], at[keep], size[keep], stretch[keep]

    def nonterminals(self) -> list[np.ndarray]:
        """Start, boundary and end at the first place, all places in the order of nonterminals, and the number of each's places."""
        return [np.concatenate([r[k] for r in self.rules]) if self.rules else np.empty(0, np.int64) for k in range(5)]


def crossing(items: np.ndarray, spans: Spans, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (nonterminal, left, right, period) of the runs across a boundary, within each expansion.

    A run of four periods has two of them on one side of the boundary, which gives the candidates: periods of which two
    begin or end there.
    """
    long_enough = np.flatnonzero(end - start >= LEAST_WORDS)
    found = []
    for side in (1, -1):
        room = ((end - middle) if side == 1 else (middle - start))[long_enough] // 2
        upto = np.concatenate([[0], np.cumsum(room)])
        for low in range(0, int(upto[-1]), TESTED):
            flat = np.arange(low, min(low + TESTED, int(upto[-1])))
            k = np.searchsorted(upto, flat, "right") - 1
            node, q = long_enough[k], flat - upto[k] + 1
            b = middle[node]
            anchor = b if side == 1 else b - 2 * q
            likely = (items[anchor] == items[anchor + q]) & (items[anchor + q - 1] == items[anchor + 2 * q - 1])
            node, q, anchor = node[likely], q[likely], anchor[likely]
            square = spans.equal(anchor, anchor + q, q)
            node, q, anchor = node[square], q[square], anchor[square]
            s, b, e = start[node], middle[node], end[node]
            right = anchor + q + spans.forward(anchor, anchor + q, e - anchor - q)
            left = anchor - spans.backward(anchor, anchor + q, anchor - s)
            keep = (right - left >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)) & (left < b) & (b < right)
            found.append(np.stack([node, left, right, q], axis=1)[keep])
    rows = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])] if len(rows) else rows


def runs_of(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (left, right, period) of all runs of the sequence of word ids; none crosses from one doc to the next."""
    starts, ends = edges(repeated_windows(words, doc))
    wide = ends - starts > LEAST_WORDS - 4
    starts, sizes = starts[wide], ends[wide] - starts[wide] + 3
    if not len(starts):
        return np.empty((0, 3), np.int64)
    stretch = np.repeat(np.arange(len(starts)), sizes)
    origin = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    items = words[origin]
    start, middle, end, places, times = Grammar(items, stretch).nonterminals()
    rows = crossing(items, Spans(items), start, middle, end)
    first = np.concatenate([[0], np.cumsum(times)])
    n = times[rows[:, 0]]
    each = np.repeat(np.arange(len(rows)), n)
    at = places[first[rows[each, 0]] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]
    shift = at - start[rows[each, 0]]
    merged = merge(rows[each, 1] + shift, rows[each, 2] + shift, rows[each, 3])
    size = merged[:, 1] - merged[:, 0] - merged[:, 2]
    for low in range(0, len(merged), 4096):
        n = size[low:low + 4096]
        inner = np.repeat(merged[low:low + 4096, 0] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        if (items[inner] != items[inner + np.repeat(merged[low:low + 4096, 2], n)]).any():
            raise RuntimeError("two different spans have the same hashes")
    length = merged[:, 1] - merged[:, 0]
    left = origin[merged[:, 0]] if len(merged) else merged[:, 0]
    return np.stack([left, left + length, merged[:, 2]], axis=1)


def merge(left: np.ndarray, right: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Maximal intervals: those of one period that share a period's length or more are parts of one run."""
    order = np.lexsort((-right, left, period))
    left, right, period = left[order], right[order], period[order]
    if not len(left):
        return np.empty((0, 3), np.int64)
    _, group = np.unique(period, return_inverse=True)
    lift = group * (int(right.max()) + 1)
    reach = np.maximum.accumulate(right + lift) - lift
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (left[1:] + period[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    return np.stack([left[at], np.maximum.reduceat(right, at), period[at]], axis=1)


def repeat_tail(n: int, doc_id: int | None) -> np.ndarray:
    """The planted edit: for one document in ten, by CRC-32 of its id (missing: empty text), its words from some place on repeat."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    index = np.arange(n)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        index[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return index


def _find(planted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc_ids, split = batch.column("doc_id").to_pylist(), [t.split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            if planted:
                for i, (doc_id, words) in enumerate(zip(doc_ids, split)):
                    index = repeat_tail(len(words), doc_id)
                    if len(index) and index[-1] != len(index) - 1:
                        split[i] = [words[k] for k in index.tolist()]
            names: defaultdict[bytes, int] = defaultdict(count().__next__)
            sizes = np.array([len(w) for w in split])
            ids = np.fromiter((names[w] for words in split for w in words), np.int64, int(sizes.sum()))
            firsts = np.concatenate([[0], np.cumsum(sizes)])
            found = runs_of(ids, np.repeat(np.arange(len(split)), sizes))
            found = found[np.lexsort((found[:, 2], found[:, 0]))]
            owner = np.searchsorted(firsts, found[:, 0], "right") - 1
            edge = np.searchsorted(owner, np.arange(len(split) + 1))
            runs, texts = [], []
            for i, words in enumerate(split):
                own = found[edge[i]:edge[i + 1]]
                begin = own[:, 0] - firsts[i]
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in
                             zip(begin.tolist(), (own[:, 1] - own[:, 0]).tolist(), own[:, 2].tolist())])
                if len(own):
                    drop = np.zeros(len(words) + 1, np.int64)
                    np.add.at(drop, begin + own[:, 2], 1)
                    np.add.at(drop, own[:, 1] - firsts[i], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
                texts.append(b" ".join(words))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, kind),
                                   pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text without its repetitions.

    Words are what stands between ASCII white space. A run is a maximal stretch of words with smallest period q and at least
    max(6, 4 q) words; `collapsed` keeps of each run its first period only, words joined by one space. `planted` first gives one
    document in ten a periodic tail. A missing or empty text has no words, no runs and an empty `collapsed`; repeated rows
    each have their row; a missing doc_id counts as the empty text where the tail is planted; other columns aren't read.

    A task holds one bounded slice of documents, or one longer document, and its grammar. Nothing is shuffled.
    """
    text = F.coalesce(field(docs, "text", "string"), F.lit("")).alias("text")
    return docs.select(field(docs, "doc_id", "bigint"), text).mapInArrow(
        _find(planted), f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def longest_run(runs: Column) -> Column:
    """The run of most periods, exactly compared; of equal ones the first, then the shortest period. Null without runs."""
    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the run of most periods and hashes of what `find_runs` returns."""
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                   r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("best", longest_run(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
