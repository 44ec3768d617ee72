"""The block learner grows the trees of Spark ML's, in jobs that several fits share and over any number of partitions."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from kerbside.plans import boosting
from kerbside.plans.learners import BoostSettings, fit_all, gbt_fit, hist_gbt_fit, score

SETTINGS = BoostSettings(rounds=6, learning_rate=0.2, depth=3, min_leaf_rows=20)


@pytest.fixture(scope="module")
def rows(spark):
    pick = np.random.default_rng(1)
    data = [(float(a), None if b == 0 else float(b), float(3 * np.sin(a) + b / 10 + (a > 7) * b / 5 + pick.normal() / 5))
            for a, b in zip(pick.integers(0, 20, 3000), pick.integers(0, 50, 3000))]
    return spark.createDataFrame(data, "a double, b double, target_k_1h double")


def predictions(model, rows, name="predicted_k"):
    return np.array([r[0] for r in score(model, rows, name).orderBy("a", "b", "target_k_1h").select(name).collect()])


@pytest.mark.parametrize("tasks", [1, 3])
def test_the_trees_of_spark_ml(spark, rows, tmp_path, monkeypatch, tasks):
    if tasks > 1:
        monkeypatch.setattr(boosting, "CORE_ROWS", 1000)
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 2)
    whole = rows.withColumn("b", F.coalesce("b", F.lit(boosting.MISSING)))
    theirs = GBTRegressor(featuresCol="f", labelCol="target_k_1h", predictionCol="p", maxIter=6, stepSize=0.2, maxDepth=3,
                          minInstancesPerNode=20, maxBins=64, seed=42).fit(VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(whole))
    (model,) = fit_all(rows, [gbt_fit(["a", "b"], settings=SETTINGS)])
    model.save(str(tmp_path / "model"))
    ours = predictions(PipelineModel.load(str(tmp_path / "model")), rows)
    assembled = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(whole)
    expected = [r.p for r in theirs.transform(assembled).withColumn("b", F.when(F.col("b") != boosting.MISSING, F.col("b")))
                .orderBy("a", "b", "target_k_1h").select("p").collect()]
    assert np.allclose(ours, expected, rtol=0, atol=1e-9) and len(set(ours)) > 8


def test_fits_share_their_jobs(spark, rows, monkeypatch):
    jobs = []
    level = boosting._level
    monkeypatch.setattr(boosting, "_level", lambda state, wanted, *rest: jobs.append(len(wanted)) or level(state, wanted, *rest))
    fits = [gbt_fit(["a", "b"], settings=SETTINGS), gbt_fit(["b"], settings=SETTINGS), hist_gbt_fit(["a", "b"], settings=SETTINGS)]
    fit_all(rows, fits)
    assert len(jobs) <= SETTINGS.rounds * SETTINGS.depth and max(jobs) == 3


def test_many_values_are_cut_at_quantiles(rows):
    wide = rows.withColumn("a", F.col("a") + F.rand(3))
    (model,) = fit_all(wide, [gbt_fit(["a", "b"], settings=SETTINGS)])
    _, edges, _ = boosting._forest(model.stages[0].getOrDefault(model.stages[0].forest))
    assert [len(e) for e in edges] == [63, 49]
    error = score(model, wide).agg(F.avg(F.abs(F.col("predicted_k") - F.col("target_k_1h")))).first()[0]
    flat = rows.agg(F.avg(F.abs(F.col("target_k_1h") - rows.agg(F.avg("target_k_1h")).first()[0]))).first()[0]
    assert error < 0.6 * flat


def test_endless_numbers_are_an_error(rows):
    for name in ("a", "target_k_1h"):
        with pytest.raises(ValueError, match="infinite"):
            fit_all(rows.withColumn(name, F.when(F.col("b") == 3, F.lit(float("inf"))).otherwise(F.col(name))), [gbt_fit(["a"], settings=SETTINGS)])


def test_features_counted_side_by_side():
    """Counts and sums of the nodes of a level, of which a fit sees some features, against one feature and node at a time."""
    pick = np.random.default_rng(4)
    sizes = [64, 2, 64, 24, 7, 1]
    bins = np.array([pick.integers(0, size, 2000) for size in sizes]).astype(np.uint8)
    goals = pick.normal(size=(2, 2000))
    tree = boosting.Levels(2)
    tree.feature[0][0], tree.cut[0][0], tree.feature[1][1], tree.cut[1][1] = 3, 11, 0, 20
    tree.leaf[:] = [1, 1, 2, 3]
    node = np.where(bins[3] <= 11, 0, np.where(bins[0] <= 20, 2, 3))
    rows = [0, 2, 3, 4, 1]
    assert len(boosting._side_by_side([sizes[r] for r in rows])) == 2
    for known in (False, True):
        asked = boosting.Asked(0, 1, rows, [sizes[r] for r in rows], tree, 2, [2, 3], known)
        blocks = [(0, bins[:, :1500], goals[:, :1500]), (1, bins, goals), (0, bins[:, 1500:], goals[:, 1500:])]
        found = next(boosting._count([asked])(iter(blocks))).reshape(asked.shape)
        for i, n in enumerate((2, 3)):
            there = node == n
            for kind, weight in zip(range(asked.kinds), (goals[1][there], None)):
                wanted = np.concatenate([np.bincount(bins[r][there], weight, sizes[r]) for r in rows])
                assert np.allclose(found[kind, i], wanted, rtol=0, atol=1e-9)
    assert np.array_equal(tree.values(bins), np.array([1, 1, 2, 3])[node])


def test_counts_of_all_rows_are_asked_for_once(rows, monkeypatch):
    kinds = []
    asked = boosting.Growing.asked
    monkeypatch.setattr(boosting.Growing, "asked", lambda self, *x: kinds.append((x[2], (found := asked(self, *x)).kinds)) or found)
    fit_all(rows, [gbt_fit(["a", "b"], settings=SETTINGS)])
    assert [k for level, k in kinds if level == 0] == [2] + [1] * (SETTINGS.rounds - 1)
    assert {k for level, k in kinds if level} == {2}
