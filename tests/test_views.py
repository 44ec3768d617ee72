"""What is worked out from each customer is worked out by all cores, though one task reads the file."""

import pytest
from pyspark.sql import functions as F

from kerbside.catalogue import views as V


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("views"))
    spark.range(0, 600, 1, 1).selectExpr("id as c_custkey", "concat('c', id) as c_name", "'M' as c_mktsegment").write.parquet(f"{path}/customer.parquet")
    return path


@pytest.mark.parametrize("view, rows", [(V.events_raw, 640), (V.road_ref_raw, 600), (V.city_events, None)])
def test_customers_are_dealt_over_the_cores(spark, tables, view, rows):
    found = view(spark, tables)
    if rows is None:  # the parsers' filter stays above the dealing
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning" in plan and "RLIKE" not in plan[plan.index("RoundRobinPartitioning"):]
        return
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and sum(sizes) == rows and max(sizes) < 2 * min(sizes)


def test_twins_of_events(spark, tables):
    rows = V.events_raw(spark, tables)
    again = rows.where("title like '% (bis)'")
    assert [r[0] for r in again.select("event_id").orderBy(F.length("event_id"), "event_id").collect()] == [f"ev-{i}" for i in range(0, 600, 15)]
    first = rows.where("title not like '% (bis)'").join(again.select("event_id"), "event_id", "left_semi").drop("title")
    assert first.count() == 40 and first.exceptAll(again.drop("title")).count() == 0
