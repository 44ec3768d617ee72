"""Document fingerprints by prefix polynomial hashes.

The prefix array of a text holds sum(code point * BASE^i) mod p for each of its prefixes, for two primes. The hash of any
span is a difference of two entries, so spans of two texts compare in constant time after a shift by a power of BASE, and
the longest common extension of two places is found by binary search. The last entries and the length are the fingerprint.
Behind a mismatch two texts meet again where blocks of equal hash stand, from which binary search goes both ways.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import corpus, ordering, shuffle_width, slices, with_id_bucket

#: Two primes just below 2^31: products fit in 64 bits, and a sum of 2^32 residues does too.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 1299709)
#: Code points of a common span between the common beginning and ending from which it counts, and of the grid's blocks:
#: any SPAN places in a row hold a whole block.
SPAN, BLOCK = 32, 16

SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


class Powers:
    """BASE^i mod p, made as far as the longest text so far needs."""

    def __init__(self, base: int, prime: int):
        self.base, self.prime, self.table = base, prime, np.ones(1, dtype=np.int64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) <= n:
            step = pow(self.base, len(self.table), self.prime)
            self.table = np.concatenate([self.table, self.table * step % self.prime])
        return self.table


POWERS = [Powers(b, p) for b, p in zip(BASES, PRIMES)]


class Prefixes:
    """Prefix arrays of one text."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.arrays = []
        for power in POWERS:
            sums = np.zeros(self.n + 1, dtype=np.int64)
            # residues are below 2^31, so sums of fewer than 2^32 of them can't overflow
            np.cumsum(codes * power.upto(self.n)[:self.n] % power.prime, out=sums[1:])
            self.arrays.append(sums % power.prime)

    @classmethod
    def of(cls, text: str) -> Prefixes:
        return cls(code_points(text))

    def fingerprint(self) -> str:
        return "".join(f"{int(a[-1]):08x}" for a in self.arrays) + f"{self.n:x}"

    def same(self, at: int, other: Prefixes, other_at: int, length: int) -> bool:
        """Whether two spans are equal, up to a chance of about 2^-60."""
        if at + length > self.n or other_at + length > other.n:
            return False
        for power, a, b in zip(POWERS, self.arrays, other.arrays):
            x, y = int(a[at + length]) - int(a[at]), int(b[other_at + length]) - int(b[other_at])
            if at < other_at:
                x *= int(power.upto(other_at - at)[other_at - at])
            else:
                y *= int(power.upto(at - other_at)[at - other_at])
            if (x - y) % power.prime:
                return False
        return True

    @staticmethod
    def steps(most: int, equal: Callable[[int, int], bool]) -> tuple[int, int]:
        """Bounds of a length from doubling steps, so that the search costs as much as its result is long."""
        low, step = 0, BLOCK
        while low + step <= most and equal(low, step):
            low, step = low + step, 2 * step
        return low, min(most, low + step - 1)

    def extension(self, at: int, other: Prefixes, other_at: int) -> int:
        """Length of the longest common extension from two places, by binary search."""
        low, high = self.steps(min(self.n - at, other.n - other_at),
                               lambda n, step: self.same(at + n, other, other_at + n, step))
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(at + low, other, other_at + low, middle - low):
                low = middle
            else:
                high = middle - 1
        return low

    def extension_back(self, at: int, other: Prefixes, other_at: int, most: int) -> int:
        """Length of the longest common extension backwards from two places, `most` at most."""
        low, high = self.steps(most, lambda n, step: self.same(at - n - step, other, other_at - n - step, step))
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(at - middle, other, other_at - middle, middle - low):
                low = middle
            else:
                high = middle - 1
        return low

    def block_hashes(self, starts: np.ndarray, top: int) -> np.ndarray:
        """Hashes, by the first prime, of the blocks at the starts, as if all stood at place `top`."""
        power, sums = POWERS[0], self.arrays[0]
        return (sums[starts + BLOCK] - sums[starts]) % power.prime * power.upto(top)[top - starts] % power.prime

    def spans_between(self, other: Prefixes, start: int, ending: int) -> list[tuple[int, int, int]]:
        """Common spans (place, other's place, length) of SPAN code points or more, in the same order in both texts and
        without overlap, between a common beginning and a common ending.

        Each run of SPAN code points holds a whole block of a grid over this text. Blocks that occur once in both texts
        are extended both ways and the heaviest chain of these spans stays. The gaps of the chain are then walked from
        left to right, where a block is met with its next occurrence.
        """
        stop, other_stop = self.n - ending, other.n - ending
        if min(stop, other_stop) - start < SPAN:
            return []
        top = max(stop, other_stop)
        grid, places = np.arange(start, stop - BLOCK + 1, BLOCK), np.arange(start, other_stop - BLOCK + 1)
        wanted, hashes = self.block_hashes(grid, top), other.block_hashes(places, top)
        marks = np.zeros(1 << 16, dtype=bool)
        marks[wanted & 0xFFFF] = True
        likely = np.flatnonzero(marks[hashes & 0xFFFF])  # spares the sort most of the places
        likely = likely[np.isin(hashes[likely], wanted)]
        if not len(likely):
            return []
        order = likely[np.argsort(hashes[likely], kind="stable")]
        found, where = hashes[order], places[order].tolist()
        first, last = np.searchsorted(found, wanted, "left"), np.searchsorted(found, wanted, "right")
        _, of, often = np.unique(wanted, return_inverse=True, return_counts=True)
        hits = np.flatnonzero(last > first)
        met, low, high = grid[hits].tolist(), first[hits].tolist(), last[hits].tolist()
        once = ((last - first == 1) & (often[of] == 1))[hits].tolist()

        def whole(a: int, b: int, begin: int, other_begin: int, end: int, other_end: int) -> tuple[int, int, int]:
            back = self.extension_back(a, other, b, min(a - begin, b - other_begin))
            return a - back, b - back, back + min(self.extension(a, other, b), end - a, other_end - b)

        spans, reached, shift = [], start, None
        for h, a in enumerate(met):
            if not once[h]:
                continue
            b = where[low[h]]
            if a + BLOCK <= reached and b - a == shift:
                continue  # inside the last span
            x, y, n = whole(a, b, start, start, stop, other_stop)
            if n >= SPAN:
                spans.append((x, y, n))
                reached, shift = x + n, y - x

        chain: list[tuple[int, int, int]] = []
        at, other_at = start, start
        for a, b, n in [*heaviest_chain(spans), (stop, other_stop, 0)]:
            skip = max(0, at - a, other_at - b)
            a, b, n = a + skip, b + skip, n - skip
            if n < 0 or (n == 0 and a != stop):
                continue
            h = bisect_left(met, at)
            while h < len(met) and met[h] + BLOCK <= a:
                k = bisect_left(where, other_at, low[h], high[h])
                if met[h] >= at and k < high[h] and where[k] + BLOCK <= b:
                    x, y, m = whole(met[h], where[k], at, other_at, a, b)
                    if m >= SPAN:
                        chain.append((x, y, m))
                        at, other_at = x + m, y + m
                h += 1
            if n:
                chain.append((a, b, n))
                at, other_at = a + n, b + n
        return chain

    def likeness(self, other: Prefixes) -> float:
        """1 for equal fingerprints, else the share of the longer text in the common beginning, the common ending and the
        common spans between them."""
        longer = max(self.n, other.n)
        if not longer:
            return 1.0
        start = self.extension(0, other, 0)
        if start == self.n == other.n:
            return 1.0
        ending = self.extension_back(self.n, other, other.n, min(self.n, other.n) - start)
        return (start + ending + sum(n for _, _, n in self.spans_between(other, start, ending))) / longer


def heaviest_chain(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans in order of place, those that also start in the order of the other's places, with the greatest sum of lengths."""
    starts, best, links = [], [], []  # other's places with rising sums, and (span, link before)
    for a, b, n in spans:
        k = bisect_left(starts, b)
        total, link = (best[k - 1] + n, ((a, b, n), links[k - 1])) if k else (n, ((a, b, n), None))
        upto = k
        while upto < len(starts) and best[upto] <= total:
            upto += 1
        if upto > k or k == len(starts) or starts[k] != b:
            starts[k:upto], best[k:upto], links[k:upto] = [b], [total], [link]
    out, link = [], links[-1] if links else None
    while link is not None:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _row(doc_id, text: str, codes: np.ndarray, own: Prefixes, after: str, after_codes: np.ndarray, following: Prefixes) -> tuple:
    cut = len(codes) - len(codes) // 4
    borrowed = min(len(codes) // 4, len(after_codes))
    edited = Prefixes(np.concatenate([codes[:cut], after_codes[:borrowed]]))
    sha = hashlib.sha256((text[:cut] + after[:borrowed]).encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, own.n, sha, own.fingerprint(), edited.fingerprint(), own.likeness(edited), own.likeness(following))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one range in order, then the first document of the next range as the last one's neighbour."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())
    held, done = None, False
    for batch in slices(batches):
        rows = []
        for doc_id, text, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest"))):
            if done:
                continue
            codes = code_points(text)
            now = (doc_id, text, codes, Prefixes(codes))
            if held is not None:
                rows.append(_row(*held, *now[1:]))
            held, done = now, guest
        if rows:
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how like the edited and the next text are.

    The edited text has its last floor(n_chars/4) code points replaced by the first as many (or all) of the next document
    in ascending doc_id order (missing ids first, ties by text; after the last comes the first). A missing text is empty;
    two empty texts have likeness 1. One shuffle deals the texts into id ranges, where a task streams them in order and
    holds two; the first document of each range also goes to the range before it.
    """
    spark = docs.sparkSession
    n = shuffle_width(spark)
    ranged = with_id_bucket(corpus(docs), n).withColumn("key", ordering(F.col("doc_id")))
    firsts = sorted((b, k) for b, k in ranged.groupBy("bucket").agg(F.min("key")).collect())
    before = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    guests = F.broadcast(spark.createDataFrame(before, "first_key bigint, host int"))  # at most n rows
    own = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("guest"))
    also = F.when(F.col("host").isNotNull(), F.array(own, F.struct(F.col("host").alias("at"), F.lit(True).alias("guest"))))
    dealt = (ranged.join(guests, F.col("key") == F.col("first_key"), "left")
             .select("doc_id", "text", "key", F.inline(F.coalesce(also, F.array(own)))))
    placed = dealt.repartitionById(n, F.col("at")).sortWithinPartitions("guest", "key", F.col("doc_id").isNotNull(), "text")
    return placed.select("doc_id", "text", "guest").mapInArrow(_run, SCHEMA)
