"""Near-duplicates by MinHash with sequential Bayesian verification.

A document is its set of distinct 5-word shingles. Equal sets form a class, and only one document of each goes on. Bands of
its MinHash signature name buckets; documents that share one are candidates. A candidate pair's signatures are compared a
batch at a time: after n places with m equal, the pair is dropped once the posterior chance of a similarity at or above the
threshold (uniform prior, Beta posterior) is below the chosen miss probability. Survivors are verified on their full sets.

No bucket is expanded into all its pairs at once. The hubs of a bucket are its lowest and highest document; every other
member is first compared with the hub it meets most often, then with another one outside its component. That joins most of a
group. Then only pairs of a bucket whose documents still lie in different components are formed, as within one component a
further link would change nothing, and only where both have enough shingles that occur elsewhere: the others can't be
similar enough to any.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import corpus, field, slices, stored, unused

WORDS = 5
SIMILAR = 75  # per cent
#: Rows of a band and bands: a pair at the threshold shares no bucket with a chance of (1 - 0.75^8)^100, 3 in 100,000, and
#: one at 0.8 of 1 in 100 million. Fewer rows would fill buckets with documents that share no more than a common passage.
ROWS, BANDS = 8, 100
#: Signature places kept for verification (a byte each), the size of a batch, and the chance of a miss accepted per batch.
PLACES, BATCH, MISS = 128, 16, 1e-6
#: Rounds in which every document is compared with one hub of its buckets.
HUB_ROUNDS = 2
#: Times that the bound on shared shingles is taken, each time over the documents that met it before.
BOUND_ROUNDS = 2
#: Groups of shingles by hash in which the bound is taken.
GROUPS = 32
#: Shingles hashed at a time, so that a block stays in the processor's cache.
BLOCK = 1 << 15

FEATURES = "doc_id bigint, n_shingles bigint, key1 bigint, key2 bigint, bands array<bigint>, signature binary"
U = np.uint64


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well spread 64-bit value for each 64-bit value."""
    y = x + U((0x9E3779B97F4A7C15 * (salt + 1)) % 2 ** 64)
    y = (y ^ (y >> U(30))) * U(0xBF58476D1CE4E5B9)
    y = (y ^ (y >> U(27))) * U(0x94D049BB133111EB)
    return y ^ (y >> U(31))


#: White space adds nothing to a word's hash, every other byte a fixed random value.
BYTE = mixed(np.arange(256, dtype=U), 7)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE[SPACE] = 0
FACTORS = mixed(np.arange(WORDS + 1, dtype=U), 11) | U(1)
HASHES = mixed(np.arange(ROWS * BANDS, dtype=U), 13) | U(1)
BAND_FACTORS = mixed(np.arange(ROWS, dtype=U), 17) | U(1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text that is lower-cased already."""
    codes = np.frombuffer(data, np.uint8)
    blank = SPACE[codes]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(starts):
        return np.empty(0, U)
    body = codes[starts[0]:]
    edges = starts - starts[0]
    place = np.arange(len(body)) - np.repeat(edges, np.diff(np.append(edges, len(body))))
    return mixed(np.add.reduceat(BYTE[body] * (U(2) * mixed(place.astype(U), 3) + U(1)), edges))


def shingles(text: str) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes; a text of fewer words is one shingle, without any none."""
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return words
    n = min(WORDS, len(words))
    sums = sum(words[k:len(words) - n + 1 + k] * FACTORS[k] for k in range(n))
    return np.unique(mixed(sums + FACTORS[WORDS] * U(n)))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ROWS x BANDS minima for each non-empty set."""
    out = np.full((len(sets), len(HASHES)), np.iinfo(U).max, dtype=U)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= BLOCK):
            size += len(sets[end])
            end += 1
        values, edges = np.concatenate(sets[at:end]), np.concatenate([[0], np.cumsum([len(s) for s in sets[at:end]])[:-1]])
        scratch = np.empty_like(values)
        for j, factor in enumerate(HASHES):
            np.multiply(values, factor, out=scratch)
            out[at:end, j] = np.minimum.reduceat(scratch, edges)
        at = end
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        full = [i for i, s in enumerate(sets) if len(s)]
        minima = minhashes([sets[i] for i in full])
        keys = np.zeros((len(sets), 2), np.int64)
        with np.errstate(over="ignore"):
            bands = (minima.reshape(-1, BANDS, ROWS) * BAND_FACTORS).sum(axis=2, dtype=U)
            bands = mixed(bands + mixed(np.arange(BANDS, dtype=U), 19)).view(np.int64)
            for i in full:
                keys[i] = [mixed(sets[i], 23).sum(dtype=U).view(np.int64), mixed(sets[i], 29).sum(dtype=U).view(np.int64)]
        places = (mixed(minima[:, :PLACES], 31) >> U(56)).astype(np.uint8)
        at = {i: k for k, i in enumerate(full)}
        yield pa.record_batch([
            batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
            pa.array([bands[at[i]].tolist() if i in at else [] for i in range(len(sets))], pa.list_(pa.int64())),
            pa.array([places[at[i]].tobytes() if i in at else b"" for i in range(len(sets))], pa.binary()),
        ], names=["doc_id", "n_shingles", "key1", "key2", "bands", "signature"])


def needed(threshold: float = SIMILAR / 100, miss: float = MISS) -> list[tuple[int, int]]:
    """(places compared, fewest equal ones to go on): below it the posterior chance of `threshold` or more is under `miss`.

    Bytes of different minima agree in one of 256 cases, so the threshold for equal bytes is a little higher. The tail of
    the Beta(m + 1, n - m + 1) posterior is a binomial sum.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, PLACES + 1, BATCH):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps = needed()
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("sa", "sb"))
        alive, equal = np.arange(len(left)), np.zeros(len(left), np.int64)
        for n, fewest in steps:
            equal[alive] += (left[alive, n - BATCH:n] == right[alive, n - BATCH:n]).sum(axis=1)
            alive = alive[equal[alive] >= fewest]
        pick = pa.array(alive)
        yield pa.record_batch([batch.column("a").take(pick), batch.column("b").take(pick), pa.array(equal[alive])],
                              names=["a", "b", "equal"])


def promising(pairs: DataFrame, representatives: DataFrame) -> DataFrame:
    """a, b, equal: the pairs that sequential comparison of their signatures doesn't rule out."""
    sides = representatives.select("rep", "signature")
    with_a = pairs.join(sides.toDF("a", "sa"), "a").join(sides.toDF("b", "sb"), "b")
    return with_a.select("a", "b", "sa", "sb").mapInArrow(_survivors, "a bigint, b bigint, equal bigint")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = (pairs.select("a", "b").join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
            .withColumn("common", F.size(F.array_intersect("left", "right"))))
    union = F.size("left") + F.size("right") - F.col("common")
    return both.where(100 * F.col("common") >= SIMILAR * union).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of an edge list, by large-star and small-star rounds.

    Every round is an aggregation and a join on nodes; a node with many neighbours is summed before it is shuffled, and its
    rows in the join may be split. Each round's edges go through the shared folder.
    """
    def settled(e: DataFrame) -> tuple:
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = settled(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        now = stored(small.select("e.u", F.col("e.m").alias("v")).where("u != v").distinct(), "links")
        after = settled(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (doc_id = component_id).

    A document without words, or without doc_id, links with nothing and is kept. Rows that repeat a doc_id are one document.
    """
    texts = corpus(docs)
    features = stored(texts.mapInArrow(_features, FEATURES), "shingles", compression="zstd")
    named = features.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("key1", "key2", "n_shingles").agg(F.min(F.struct("doc_id", "bands", "signature")).alias("one"))
    reps = stored(classes.select(F.col("one.doc_id").alias("rep"), "n_shingles", "key1", "key2", "one.bands", "one.signature"),
                  "representatives", compression="zstd")

    member = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    ends = member.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    shared = stored(member.join(ends, "bucket"), "buckets", compression="zstd")
    sets = shingle_sets(texts, shared.select(F.col("rep").alias("doc_id")).distinct())
    hubs = shared.select("rep", F.explode(F.array("low", "high")).alias("hub")).where("rep != hub")
    open_pairs = stored(hubs.groupBy(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).agg(
        F.count("*").alias("together")), "hub-pairs")

    # each round tries one hub per document, the one it shares most buckets with; then only other components matter
    links = found = tried = None
    for _ in range(HUB_ROUNDS):
        best = stored(open_pairs.groupBy("b").agg(F.max_by("a", F.struct("together", F.negative("a"))).alias("a")).select("a", "b"),
                      "tries")
        new = linked(promising(best, reps), sets)
        links = stored(new if links is None else links.union(new), "links")
        found = stored(components(links), "components")
        tried = best if tried is None else tried.union(best)
        open_pairs = across(open_pairs.join(best, ["a", "b"], "left_anti"), found)

    # what remains: pairs of a bucket in different components that weren't tried
    placed = shared.select("bucket", "rep", "n").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed_up = placed.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2")
    left = stored(placed.join(mixed_up.select("bucket"), "bucket"), "mixed-buckets", compression="zstd")
    # x and y share at most the shingles of either that a document of another component has, in every group of shingles
    # by hash at most the smaller number c of the two, s in all. Their similarity is at most s / (n + n2 - s)
    mine = sets.join(left.select(F.col("rep").alias("doc_id"), "component").distinct(), "doc_id").select(
        F.col("doc_id").alias("rep"), "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    for _ in range(BOUND_ROUNDS):
        elsewhere = mine.groupBy("shingle").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2")
        shareable = mine.join(elsewhere.select("shingle"), "shingle").groupBy("rep", "n").agg(F.count("*").alias("c"))
        able = stored(shareable.where(f"100 * c >= {SIMILAR} * n"), "shareable")
        mine = mine.join(able.select("rep"), "rep", "left_semi")
    group = F.pmod(F.col("shingle"), F.lit(GROUPS))
    by_group = mine.join(elsewhere.select("shingle"), "shingle").groupBy("rep").agg(F.array(*(F.count_if(group == g).cast("int") for g in range(GROUPS))).alias("c"))
    left = stored(left.join(by_group, "rep"), "shareable", compression="zstd")
    other = left.select("bucket", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("c").alias("c2"),
                        F.col("component").alias("component2"))
    cross = left.join(other, "bucket").where(
        f"component < component2 and 100 * least(n, n2) >= {SIMILAR} * greatest(n, n2) and {100 + SIMILAR} * "
        f"aggregate(zip_with(c, c2, (x, y) -> least(x, y)), 0, (x, y) -> x + y) >= {SIMILAR} * (n + n2)")
    pairs = cross.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()
    last = stored(linked(promising(pairs.join(tried, ["a", "b"], "left_anti"), reps), sets), "links")
    if not last.isEmpty():
        found = stored(components(links.union(last)), "components")

    of_class = reps.select("key1", "key2", "n_shingles", "rep")
    placed_reps = of_class.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key1", "key2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    narrow = features.select("doc_id", "n_shingles", "key1", "key2")
    linkable = F.col("n_shingles") > 0
    joined = narrow.where(linkable & F.col("doc_id").isNotNull()).join(placed_reps, ["key1", "key2", "n_shingles"]).select(
        "doc_id", "n_shingles", "component")
    alone = narrow.where(~linkable | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return joined.unionByName(alone).select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    a, b = found.toDF("a", "ca"), found.toDF("b", "cb")
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def shingle_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and its full set, made anew from the texts of the wanted documents.

    The texts are shuffled whatever the number of wanted ones, so the plan is the same at every size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    of_wanted = texts.join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stored(of_wanted.mapInArrow(run, "doc_id bigint, shingles array<bigint>"), "sets")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns: the one with the smallest doc_id, and any one of rows that repeat its
    doc_id and text. Rows that share a doc_id but not the text all stay if their doc_id does, and rows without doc_id all stay.
    An empty table stays one, and columns of any other name pass through.
    """
    name, of_kept = unused(docs, "text_hash"), unused(docs, "kept_id")
    kept = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias(of_kept)).distinct()
    mine = field(docs, "doc_id", "bigint")
    hashed = docs.withColumn(name, F.sha2(F.coalesce(field(docs, "text", "string"), F.lit("")), 256))
    one = hashed.join(kept, mine == F.col(of_kept), "left_semi").dropDuplicates(["doc_id", name]).drop(name)
    return one.unionByName(docs.where(mine.isNull()))
