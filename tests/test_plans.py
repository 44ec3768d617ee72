"""Plan checks: no nested loops, no Python rows, pruned and filtered scans."""

import pytest

from kerbside.catalogue import views as V
from kerbside.catalogue.queries import QUERIES
from kerbside.operators.serving import latest_observation_per_road, recent_window

SF = "/root/testdata/sf0.001"
# Queries that run jobs while they are built: they write tables, train or stream.
EAGER = {
    "src_traffic_pages", "src_road_reference_pages", "src_event_pages", "src_weather_payload", "scan_bulk_parquet",
    "sink_parquet", "ingest_traffic", "ingest_weather", "ingest_events", "process_traffic_file", "load_traffic_table",
    "event_features", "event_coverage", "systematic_sample", "bootstrap_window", "upsert_traffic", "bulk_import",
    "incremental_ingest", "stream_bulk_inbox", "stream_dedupe", "refresh_job", "run_predictions", "horizon_predictions",
    "train_gbt", "train_hist_gbt", "train_horizon", "train_one_horizon", "train_all_horizons", "ablation_calendar",
    "ablation_weather", "ablation_road", "ablation_events", "ablation_all", "model_comparison", "train_report",
}
FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
             "FlatMapGroupsInPandas", "Scan ExistingRDD[_1")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for operator in FORBIDDEN:
        assert operator not in plan, operator


def test_without_broadcast_there_is_still_no_nested_loop(spark):
    """Beyond the broadcast limit every join has an equality to shuffle by."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("build_training_features", "event_radius_pairs", "weather_features", "quality_gate", "upsert_predictions",
                     "prediction_coverage", "filter_eligible_ids", "cursor_filter", "temporal_split"):
            plan = plan_of(QUERIES[name](spark, SF))
            assert "NestedLoop" not in plan and "Cartesian" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scan_reads_the_needed_columns_only(spark, tmp_path):
    path = str(tmp_path / "t")
    V.obs(spark, SF).write.parquet(path)
    plan = plan_of(spark.read.parquet(path).where("k >= 15 and iu_ac = '1'").select("iu_ac", "k"))
    assert "ReadSchema: struct<iu_ac:string,k:double>" in plan
    assert "GreaterThanOrEqual(k,15.0)" in plan and "EqualTo(iu_ac,1)" in plan


def test_newest_row_is_limited_before_the_shuffle(spark):
    plan = plan_of(latest_observation_per_road(V.table(spark, SF, "events").selectExpr("cast(user_id as string) iu_ac", "ts timestamp_utc")))
    first, after = plan.split("Exchange", 1)
    assert "WindowGroupLimit" in first and "Partial" in after


def test_window_start_is_a_scalar_subquery(spark):
    plan = plan_of(recent_window(V.obs(spark, SF)))
    assert "Subquery" in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["cursor_filter", "gap_context", "road_history"])
def test_facts_meet_roads_by_bucket(spark, name):
    """Beyond the broadcast limit no join that filters facts goes by the road alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = [line for line in plan_of(QUERIES[name](spark, SF)).splitlines() if "SortMergeJoin" in line]
        assert any("_bucket" in line for line in joins)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_recent_rows_of_a_store_prune_its_days(spark, tmp_path):
    from kerbside.operators.keyed import upsert_traffic
    from kerbside.sources.tables import read_recent, write_keyed

    store = str(tmp_path / "store")
    assert read_recent(spark, store, 48) is None
    obs = V.obs(spark, SF)
    write_keyed(spark, store, obs, upsert_traffic)
    for n in (0, 5, 48):
        got, want = read_recent(spark, store, n), recent_window(obs, n)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
        assert "PartitionFilters: [isnotnull(day" in plan_of(got)


def test_store_reads_only_the_batch_days(spark, tmp_path):
    from kerbside.operators.keyed import upsert_traffic
    from kerbside.sources.tables import write_keyed

    store = str(tmp_path / "store")
    write_keyed(spark, store, V.obs(spark, SF), upsert_traffic)
    days = spark.read.parquet(store).where("day in (date '2024-01-05', date '2024-01-06')")
    plan = plan_of(days)
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [day" in plan
