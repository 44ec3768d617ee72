"""Gradient-boosted trees over blocks of binned rows: Spark deals and sums, numpy counts inside the tasks.

The method is that of Spark ML's GBTRegressor: the first tree is fitted to the target and counts whole, each later one to twice the
error and counts by the learning rate; splits go by variance at a feature's quantiles. Rows live in persisted blocks, one byte per
row and feature, and a level of the trees of all fits is one job: every partition returns counts and sums per node, feature and
bin. Of two siblings only the smaller is counted, the other is what is left of their parent. Blocks are elements of an RDD: as
rows of a DataFrame each of the many short jobs would copy them several times. They are small, which Spark hands to Python faster
than large ones, and a task joins some before it counts, which takes fewer calls.
"""

from __future__ import annotations

import json
import math
from collections.abc import Container, Iterator, Sequence
from typing import TYPE_CHECKING, Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.schemas import require_columns
from kerbside.session import run_folder
from kerbside.sources.files import remove

if TYPE_CHECKING:
    from kerbside.plans.learners import Fit

# Far below every feature, so that a tree can split missing values off.
MISSING = -1.0e6
# Rows of a block as it is dealt and held, and of the blocks that a task joins to count them.
BLOCK_ROWS, JOINED_ROWS = 8_192, 131_072
# A core takes part for so many rows; a partition has no more rows than the second number.
CORE_ROWS, PARTITION_ROWS = 50_000, 8_000_000
# Rounds after which the blocks go through a table in the shared folder, where their lineage ends.
KEPT_ROUNDS = 25
# Features are counted side by side as one number of so many values, whose counts stay in a core's cache.
CELLS = 4096
# The cut of a node without a split, above every bin.
NO_CUT = 1 << 20
BLOCK = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("n", T.IntegerType()),
                      T.StructField("bins", T.BinaryType()), T.StructField("goal", T.BinaryType())])


def filled(name: str) -> Column:
    return F.nanvl(F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(MISSING)), F.lit(MISSING))


def _kind(bins: int) -> type:
    return np.uint8 if bins <= 256 else np.uint16


def _binned(values: Sequence[np.ndarray], edges: Sequence[np.ndarray], bins: int) -> np.ndarray:
    """One row per feature; bin i holds values above edge i - 1, up to edge i."""
    out = np.empty((len(edges), len(values[0]) if values else 0), _kind(bins))
    for row, x, cuts in zip(out, values, edges):
        row[:] = np.searchsorted(cuts, x, side="left")
    return out


class Levels:
    """The splits of a tree, level by level. A node without one sends its rows left."""

    def __init__(self, depth: int):
        self.feature = [np.zeros(1 << level, np.int64) for level in range(depth)]
        self.cut = [np.full(1 << level, NO_CUT, np.int32) for level in range(depth)]
        self.leaf = np.zeros(1 << depth)

    def _below(self, bins: np.ndarray, level: int, node: int, at: np.ndarray | None, wanted: Container[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The wanted ones of a node's children with the numbers of their rows; None are all rows."""
        own = bins[self.feature[level][node]]
        right = (own if at is None else own.take(at)) > self.cut[level][node]
        for child in (2 * node, 2 * node + 1):
            if child in wanted:
                there = np.flatnonzero(right if child & 1 else ~right)
                yield child, there if at is None else at.take(there)

    def rows(self, bins: np.ndarray, level: int, nodes: Sequence[int]) -> dict[int, np.ndarray | None]:
        """The numbers of the rows of some nodes of a level."""
        found: dict[int, np.ndarray | None] = {0: None}
        for above in range(level):
            wanted = {node >> (level - above - 1) for node in nodes}
            found = {child: at for node, rows in found.items() for child, at in self._below(bins, above, node, rows, wanted)}
        return found

    def values(self, bins: np.ndarray) -> np.ndarray:
        depth = len(self.feature)
        out, found = np.empty(bins.shape[1]), {0: None}
        for level in range(depth + 1):
            below: dict[int, np.ndarray] = {}
            for node, at in found.items():
                if level == depth or self.cut[level][node] == NO_CUT:  # all rows end in the same leaf
                    out[slice(None) if at is None else at] = self.leaf[node << (depth - level)]
                else:
                    below.update(self._below(bins, level, node, at, (2 * node, 2 * node + 1)))
            found = below
        return out


# --- the rows ---------------------------------------------------------------------------------------------


class Part:
    """Fits of one target and number of bins: they see the same rows, cut at the same edges."""

    def __init__(self, target: str, bins: int, numbers: list[int], fits: Sequence[Fit]):
        self.target, self.bins, self.numbers = target, bins, numbers
        self.features = list(dict.fromkeys(c for i in numbers for c in fits[i].features))
        self.edges: list[np.ndarray] = []


def _parts(fits: Sequence[Fit]) -> list[Part]:
    numbers: dict[tuple[str, int], list[int]] = {}
    for i, fit in enumerate(fits):
        numbers.setdefault((fit.target, fit.settings.bins), []).append(i)
    return [Part(*key, found, fits) for key, found in numbers.items()]


def _edges(rows: DataFrame, parts: Sequence[Part], features: Sequence[str], targets: Sequence[str]) -> int:
    """Set each part's edges from all of its rows: middles between the values of a feature that has few, else quantiles. Returns the rows."""
    def of(part, c):
        return F.when(F.col(f"`{targets.index(part.target)}`").isNotNull(), F.col(f"_{features.index(c)}"))

    asked = [(p, c) for p in parts for c in p.features]
    first = rows.agg(
        F.count_if(F.greatest(*(F.abs(f"_{i}") for i in range(len(features))), F.lit(0.0)) == math.inf).alias("endless"),
        F.count_if(F.greatest(*(F.isnan(f"`{i}`") | (F.abs(f"`{i}`") == math.inf) for i in range(len(targets))), F.lit(False))).alias("odd"),
        *(F.count(f"`{targets.index(p.target)}`").alias(f"rows{i}") for i, p in enumerate(parts)),
        *(F.approx_count_distinct(of(*x)).alias(f"distinct{i}") for i, x in enumerate(asked)),
        *(F.percentile_approx(of(p, c), [(j + 1) / p.bins for j in range(p.bins)]).alias(f"cuts{i}") for i, (p, c) in enumerate(asked)),
    ).first()
    for i, part in enumerate(parts):
        if not first[f"rows{i}"]:
            raise ValueError(f"No row has the target {part.target}, so there is nothing to train on.")
    if first["endless"] or first["odd"]:
        raise ValueError("A feature is infinite, or a target infinite or no number, so nothing can be trained on them.")
    few = [i for i, (p, _) in enumerate(asked) if first[f"distinct{i}"] <= 2 * p.bins]
    # Sets of some two hundred values at most, whatever the rows.
    sets = rows.agg(F.lit(1), *(F.collect_set(of(*asked[i])).alias(f"set{i}") for i in few)).first()
    for i, (part, _) in enumerate(asked):
        values = np.sort(sets[f"set{i}"]) if i in few else []
        if i in few and len(values) <= part.bins:
            part.edges.append((values[:-1] + values[1:]) / 2)
        else:
            cuts = np.unique(first[f"cuts{i}"])
            part.edges.append(cuts[:-1])  # the largest value is the last part's end
    return sum(first[f"rows{i}"] for i in range(len(parts)))


def _to_blocks(parts: Sequence[Part], features: Sequence[str], targets: Sequence[str]):
    wanted = [(p.bins, targets.index(p.target), [features.index(c) for c in p.features], p.edges, len(p.numbers)) for p in parts]
    width = len(features)

    def blocks(columns: list[np.ndarray], start: int) -> Iterator[pa.RecordBatch]:
        for i, (bins, target, own, edges, copies) in enumerate(wanted):
            goal = columns[width + target]
            there = ~np.isnan(goal)
            n = int(there.sum())
            if n:
                binned = _binned([columns[c][there] for c in own], edges, bins)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([i], pa.int32()), "seq": pa.array([start + i], pa.int64()), "n": pa.array([n], pa.int32()),
                    "bins": pa.array([binned.tobytes()], pa.binary()),
                    "goal": pa.array([np.tile(goal[there], copies).tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield from blocks([np.concatenate(c) for c in zip(*held)], seq)
                seq, held, n = seq + len(wanted), [], 0
        if n:
            yield from blocks([np.concatenate(c) for c in zip(*held)], seq)

    return run


Block = tuple[int, np.ndarray, np.ndarray]  # a part's number, its bins by feature and its goals by fit


def _blocks(rows: Iterator[Row], kinds: Sequence[type]) -> Iterator[Block]:
    """The stored blocks of a partition."""
    for row in rows:
        yield row.part, np.frombuffer(row.bins, kinds[row.part]).reshape(-1, row.n), np.frombuffer(row.goal).reshape(-1, row.n)


def _joined(blocks: Iterator[Block]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """A part's number, the bins of some of its blocks side by side, and the bins and goals of each."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    rows: dict[int, int] = {}

    def some(part: int):
        bins, goals = map(list, zip(*held.pop(part)))
        return part, np.concatenate(bins, axis=1), bins, goals

    for part, bins, goals in blocks:
        held.setdefault(part, []).append((bins, goals))
        rows[part] = rows.get(part, 0) + bins.shape[1]
        if rows[part] >= JOINED_ROWS:
            rows[part] = 0
            yield some(part)
    for part in list(held):
        yield some(part)


# --- tasks ------------------------------------------------------------------------------------------------


def _side_by_side(sizes: Sequence[int]) -> list[list[int]]:
    """Groups of features with CELLS combinations of bins at most; counts of the combinations give those of each feature."""
    groups: list[list[int]] = []
    cells: list[int] = []
    for c in sorted(range(len(sizes)), key=lambda c: -sizes[c]):
        for g, have in enumerate(cells):
            if have * sizes[c] <= CELLS:
                groups[g].append(c)
                cells[g] *= sizes[c]
                break
        else:
            groups.append([c])
            cells.append(sizes[c])
    return groups


class Asked:
    """What to count for one fit: some nodes of a level of its tree, over the features in `rows` of the blocks with `sizes` bins.

    Counts lie as (sums and, unless they are known, counts; nodes; bins of all features one after the other).
    """

    def __init__(self, part: int, line: int, rows: Sequence[int], sizes: Sequence[int], tree: Levels, level: int, nodes: Sequence[int], known: bool):
        self.part, self.line, self.tree, self.level, self.nodes = part, line, tree, level, nodes
        self.kinds = 1 if known else 2
        starts = np.concatenate([[0], np.cumsum(sizes)])
        self.shape = (self.kinds, len(nodes), int(starts[-1]))
        #: Lines of the bins, their sizes, and where each feature's counts go.
        self.groups = [(tuple(rows[c] for c in group), [sizes[c] for c in group], [slice(starts[c], starts[c + 1]) for c in group])
                       for group in _side_by_side(sizes)]

    def empty(self) -> list[np.ndarray]:
        return [np.zeros((self.kinds, len(self.nodes), math.prod(sizes))) for _, sizes, _ in self.groups]

    def add(self, found: list[np.ndarray], bins: np.ndarray, goals: np.ndarray, columns: dict[tuple[int, ...], np.ndarray]) -> None:
        places = self.tree.rows(bins, self.level, self.nodes)
        found_at = [places[node] for node in self.nodes]
        goal, at = goals[self.line], None
        ends = [0, len(goal)]
        if found_at[0] is not None:  # else the root, which has all rows
            at, ends = np.concatenate(found_at), np.cumsum([0, *map(len, found_at)])
            goal = goal.take(at)
        for out, (lines, sizes, _) in zip(found, self.groups):
            if lines not in columns:  # for all fits
                columns[lines] = _joint(bins, lines, sizes)
            cell = (columns[lines] if at is None else columns[lines].take(at)).astype(np.intp)
            for i, (start, end) in enumerate(zip(ends, ends[1:])):
                out[0, i] += np.bincount(cell[start:end], goal[start:end], out.shape[2])
                if self.kinds == 2:
                    out[1, i] += np.bincount(cell[start:end], None, out.shape[2])

    def by_feature(self, found: list[np.ndarray]) -> np.ndarray:
        out = np.empty(self.shape)
        for counts, (_, sizes, places) in zip(found, self.groups):
            counts = counts.reshape(*self.shape[:2], *sizes)
            for axis, place in enumerate(places):
                out[:, :, place] = counts.sum(axis=tuple(2 + other for other in range(len(sizes)) if other != axis))
        return out


def _joint(bins: np.ndarray, lines: Sequence[int], sizes: Sequence[int]) -> np.ndarray:
    out = bins[lines[0]].astype(_kind(math.prod(sizes)))
    for line, size in zip(lines[1:], sizes[1:]):
        out *= out.dtype.type(size)
        out += bins[line]
    return out


def _count(asked: Sequence[Asked]):
    """One partition's counts."""
    def run(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
        found = [one.empty() for one in asked]
        for part, bins, _, several in _joined(blocks):
            goals, columns = np.concatenate(several, axis=1), {}
            for one, out in zip(asked, found):
                if one.part == part:
                    one.add(out, bins, goals, columns)
        yield np.concatenate([one.by_feature(out).reshape(-1) for one, out in zip(asked, found)])

    return run


def _moved(trees: Sequence[tuple[int, int, Levels, bool, float]]):
    """The blocks with the next goals after (part, line, tree, is the first, weight)."""
    def run(blocks: Iterator[Block]) -> Iterator[Block]:
        for part, whole, several, before in _joined(blocks):
            goals = np.concatenate(before, axis=1)
            for of, line, tree, first, weight in trees:
                if of == part:
                    goals[line] = 2 * (goals[line] - tree.values(whole)) if first else goals[line] - 2 * weight * tree.values(whole)
            start = 0
            for bins in several:
                end = start + bins.shape[1]
                yield part, bins, goals[:, start:end].copy()
                start = end

    return run


# --- growing ----------------------------------------------------------------------------------------------


class Growing:
    """One fit's next tree: which nodes to count on a level, and their splits."""

    def __init__(self, fit: Fit, rows: Sequence[int], cuts: Sequence[int]):
        self.fit, self.settings, self.rows = fit, fit.settings, rows
        self.sizes = [n + 1 for n in cuts]  # bins of each feature
        self.whole: np.ndarray | None = None  # counts of all rows, the same for every tree
        self.cuts = np.asarray(cuts)[:, None] > np.arange(self.settings.bins)[None, :]  # bins that end at an edge
        self.forest: list[Levels] = []

    def begin(self) -> None:
        self.tree = Levels(self.settings.depth)
        self.pick = np.random.default_rng([self.settings.seed & 0xFFFFFFFF, len(self.forest)])
        self.open, self.known = {0: None}, {}

    def asked(self, part: int, line: int, level: int) -> Asked:
        """Every node that is counted: the root, and the smaller child of each pair."""
        return Asked(part, line, self.rows, self.sizes, self.tree, level, sorted(self.open), level == 0 and self.whole is not None)

    def spread(self, found: np.ndarray) -> np.ndarray:
        """What was asked for as counts and sums (2, features, nodes, bins)."""
        if len(found) == 1:
            found = np.concatenate([found, self.whole])
        elif self.whole is None:
            self.whole = found[1:]  # the first counts are the root's
        out = np.zeros((2, len(self.sizes), found.shape[1], self.settings.bins))
        for feature, part in enumerate(np.split(found, np.cumsum(self.sizes)[:-1], axis=2)):
            out[:, feature, :, :part.shape[2]] = part[::-1]
        return out

    def split(self, level: int, found: np.ndarray) -> None:
        """Take the counts (2, features, slots, bins) of this level and choose the splits."""
        stats = {}
        for i, node in enumerate(sorted(self.open)):
            stats[node] = found[:, :, i]
            if level:
                stats[node ^ 1] = self.known[node >> 1] - stats[node]
        self.open, self.known = {}, {}
        for node in sorted(stats):
            count, total = stats[node]
            n, s = count[0].sum(), total[0].sum()
            if level == 0:
                self._end(0, 0, s / n)
            if not self.settings.depth:
                continue
            best = self._best(count, total, n, s)
            if best is None:
                continue
            feature, cut = best
            self.tree.feature[level][node], self.tree.cut[level][node] = self.rows[feature], cut
            left_n, left_s = count[feature, :cut + 1].sum(), total[feature, :cut + 1].sum()
            self._end(level + 1, 2 * node, left_s / left_n)
            self._end(level + 1, 2 * node + 1, (s - left_s) / (n - left_n))
            # A child that can't be cut into two leaves is one.
            if level + 1 < self.settings.depth and max(left_n, n - left_n) >= 2 * max(1, self.settings.min_leaf_rows):
                self.open[2 * node + int(left_n > n - left_n)] = None
                self.known[node] = stats[node]

    def _end(self, level: int, node: int, value: float) -> None:
        below = self.settings.depth - level
        self.tree.leaf[node << below:(node + 1) << below] = value

    def _best(self, count: np.ndarray, total: np.ndarray, n: float, s: float) -> tuple[int, int] | None:
        left_n, left_s = np.cumsum(count, 1), np.cumsum(total, 1)
        right_n, right_s = n - left_n, s - left_s
        least = max(1, self.settings.min_leaf_rows)
        ok = self.cuts & (left_n >= least) & (right_n >= least)
        share = self.fit.per_split
        if share != "all":
            some = self.pick.choice(len(ok), math.ceil(float(share) * len(ok)), replace=False)
            ok[np.setdiff1d(np.arange(len(ok)), some)] = False
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, (left_s * left_s / left_n + right_s * right_s / right_n - s * s / n) / n, -math.inf)
        at = int(gain.argmax())
        if gain.flat[at] <= 0 or gain.flat[at] < self.fit.least_gain:
            return None
        return divmod(at, gain.shape[1])


def grow(train: DataFrame, fits: Sequence[Fit]) -> list[BoostedTrees]:
    """The models of all fits, grown level by level together. They don't see each other."""
    spark = train.sparkSession
    features = list(dict.fromkeys(c for fit in fits for c in fit.features))
    targets = list(dict.fromkeys(fit.target for fit in fits))
    require_columns(train, [*features, *targets])
    parts = _parts(fits)
    kinds = [_kind(p.bins) for p in parts]
    rows = train.where(F.coalesce(*(F.col(f"`{t}`") for t in targets)).isNotNull()).select(
        *(filled(c).alias(f"_{i}") for i, c in enumerate(features)),
        *(F.col(f"`{t}`").cast("double").alias(str(i)) for i, t in enumerate(targets))).persist(StorageLevel.MEMORY_AND_DISK)
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.enabled", "false")  # as many partitions as are asked for
    held, kept = [], []

    def hold(blocks: RDD) -> RDD:
        held.append(blocks.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    def through_files(blocks: RDD) -> RDD:
        kept.append(run_folder(spark, "boosting"))
        blocks.saveAsPickleFile(kept[-1], 1)
        while len(kept) > 2:
            remove(spark, kept.pop(0))
        return hold(spark.sparkContext.pickleFile(kept[-1]).coalesce(tasks))

    try:
        n = _edges(rows, parts, features, targets)
        cores = spark.sparkContext.defaultParallelism
        tasks = max(1, min(cores, -(-n // CORE_ROWS)))
        if n > tasks * PARTITION_ROWS:
            tasks = cores * -(-n // (cores * PARTITION_ROWS))
        kept.append(run_folder(spark, "boosting"))
        rows.mapInArrow(_to_blocks(parts, features, targets), BLOCK).write.parquet(kept[-1])
        rows.unpersist()
        stored = session.read.schema(BLOCK).parquet(kept[-1]).repartitionByRange(tasks, "seq").sortWithinPartitions("seq")
        state = hold(stored.rdd.mapPartitions(lambda rows: _blocks(rows, kinds)))
        place, growing = {}, []
        for p, part in enumerate(parts):
            place.update({i: (p, line) for line, i in enumerate(part.numbers)})
        for i, fit in enumerate(fits):
            part = parts[place[i][0]]
            own = [part.features.index(c) for c in fit.features]
            growing.append(Growing(fit, own, [len(part.edges[c]) for c in own]))
        for done in range(max(fit.settings.rounds for fit in fits)):
            active = [i for i, fit in enumerate(fits) if done < fit.settings.rounds]
            for i in active:
                growing[i].begin()
            for level in range(max(1, *(fits[i].settings.depth for i in active))):
                wanted = [i for i in active if growing[i].open]
                if wanted:
                    _level(state, [(i, *place[i], growing[i]) for i in wanted], level)
                while len(held) > 1:  # the first level's job has made the new blocks
                    held.pop(0).unpersist()
            trees = []
            for i in active:
                growing[i].forest.append(growing[i].tree)
                trees.append((*place[i], growing[i].tree, done == 0, fits[i].settings.learning_rate))
            state = hold(state.mapPartitions(_moved(trees)))
            if (done + 1) % KEPT_ROUNDS == 0:
                state = through_files(state)
        return [BoostedTrees(list(fit.features), fit.prediction, _forest_text(growing[i], parts[place[i][0]])) for i, fit in enumerate(fits)]
    finally:
        for df in (rows, *held):
            df.unpersist()
        for path in kept:
            remove(spark, path)


def _level(state: RDD, wanted: Sequence[tuple[int, int, int, Growing]], level: int) -> None:
    asked = [one.asked(part, line, level) for _, part, line, one in wanted]
    # One array per partition, whose size is that of the trees' level; partitions follow the cores.
    found = np.sum(state.mapPartitions(_count(asked)).collect(), axis=0)
    ends = np.cumsum([math.prod(a.shape) for a in asked])
    for (_, _, _, one), a, counts in zip(wanted, asked, np.split(found, ends[:-1])):
        one.split(level, one.spread(counts.reshape(a.shape)))


# --- the model --------------------------------------------------------------------------------------------


def _forest_text(one: Growing, part: Part) -> str:
    """Edges per feature of the fit; per tree the splits of its levels, features by their place in the fit, and its leaves."""
    number = {row: i for i, row in enumerate(one.rows)}
    trees = [{
        "feature": [[number.get(int(f), 0) for f in level] for level in tree.feature], "cut": [level.tolist() for level in tree.cut],
        "leaf": (tree.leaf * (1.0 if i == 0 else one.settings.learning_rate)).tolist()} for i, tree in enumerate(one.forest)]
    return json.dumps({"bins": one.settings.bins, "edges": [part.edges[row].tolist() for row in one.rows], "trees": trees})


def _forest(text: str) -> tuple[int, list[np.ndarray], list[Levels]]:
    said: dict[str, Any] = json.loads(text)
    trees = []
    for t in said["trees"]:
        tree = Levels(len(t["feature"]))
        tree.feature = [np.asarray(level, np.int64) for level in t["feature"]]
        tree.cut = [np.asarray(level, np.int32) for level in t["cut"]]
        tree.leaf = np.asarray(t["leaf"], float)
        trees.append(tree)
    return said["bins"], [np.asarray(e, float) for e in said["edges"]], trees


class BoostedTrees(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A trained model: adds its prediction to the rows. Missing features are allowed."""

    features = Param(Params._dummy(), "features", "feature columns", TypeConverters.toListString)
    prediction = Param(Params._dummy(), "prediction", "prediction column", TypeConverters.toString)
    forest = Param(Params._dummy(), "forest", "edges and trees as JSON", TypeConverters.toString)

    def __init__(self, features: list[str] | None = None, prediction: str | None = None, forest: str | None = None):
        super().__init__()
        if features is not None:
            self._set(features=features, prediction=prediction, forest=forest)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bins, edges, trees = _forest(self.getOrDefault(self.forest))

        def predict(*columns: pd.Series) -> pd.Series:
            binned = _binned([c.to_numpy() for c in columns], edges, bins)
            out = np.zeros(len(columns[0]))
            for tree in trees:
                out += tree.values(binned)
            return pd.Series(out)

        names = self.getOrDefault(self.features)
        return dataset.withColumn(self.getOrDefault(self.prediction), F.pandas_udf(predict, "double")(*(filled(c) for c in names)))
