"""The dataset of many roads: its rows, rows per road, and the roads that dropped out."""

from times import at

from kerbside.catalogue import views as V
from kerbside.catalogue.queries import QUERIES
from kerbside.plans.features import multi_road_coverage, multi_road_dataset
from kerbside.schemas import KEY, TIME

SF = "/root/testdata/sf0.001"


def test_queries_return_the_job(spark):
    rows, report = QUERIES["multi_road_rows"](spark, SF), QUERIES["multi_road_coverage"](spark, SF).collect()
    assert rows.count() == sum(r.n_rows for r in report) > 0
    assert {r[KEY] for r in rows.select(KEY).distinct().collect()} == {r[KEY] for r in report if not r.dropped}


def test_a_road_without_targets_drops_out(spark):
    obs = spark.createDataFrame(
        [("1", at("2024-01-01 00:00:00"), 1.0, 2.0), ("1", at("2024-01-01 01:00:00"), 1.0, 2.0), ("2", at("2024-01-01 00:00:00"), 1.0, 2.0)],
        f"{KEY} string, {TIME} timestamp, q double, k double")
    inputs = obs, V.weather(spark, SF), V.road_reference(spark, SF)
    assert sorted(map(tuple, multi_road_coverage(*inputs).collect())) == [("1", 2, 1, False), ("2", 1, 0, True)]
    assert [r[KEY] for r in multi_road_dataset(*inputs)[1].collect()] == ["2"]
