"""Every operator under one name: `from kerbside import api; api.traffic_lags(observations)`."""

# ruff: noqa: F401
from kerbside.functions.geo import haversine_m
from kerbside.operators.cleaning import (
    clean_traffic, congested_rows, congestion_class, dedupe_keep_last, distinct_ids, filter_complete,
    filter_eligible_ids, filter_road, incomplete_rows, normalize_bulk, normalize_json_text, normalize_traffic,
    normalize_utc, quality_counts, quality_flags, union_sources, utc_to_local,
)
from kerbside.operators.evaluate import (
    evaluation_rows, fixed_cutoff_split, improvement_pct, last_training_timestamp, model_version_lookup,
    persistence_baseline, promote_all, quality_gate, regression_metrics, temporal_split,
)
from kerbside.operators.features import (
    public_holiday_features, road_features, school_holiday_features, target_timestamp, time_features,
    weather_features,
)
from kerbside.operators.incremental import (
    bootstrap_window, cursor_filter, freshness_gate, new_data_gate, new_vs_known_roads, road_cursors,
)
from kerbside.operators.keyed import (
    constraint_checks, dataset_invariants, migrate_horizon, sync_roads, upsert_predictions, upsert_roads,
    upsert_traffic, weather_hour_checks,
)
from kerbside.operators.monitoring import (
    alerts, breach_runs, champion_version_metric, observation_freshness, prediction_age, prediction_coverage,
)
from kerbside.operators.nearby import active_interval_count, event_features, event_radius_pairs, haversine_pairs
from kerbside.operators.occurrences import (
    event_duration_profile, events_overlapping_period, explode_occurrences, longest_events, normalize_events,
)
from kerbside.operators.offsets import (
    gap_context, gap_histogram, gaps_over_1h, traffic_lags, traffic_target_single, traffic_targets,
)
from kerbside.operators.profiles import (
    candidate_roads, capped_per_road, complete_count, coverage_ratio, describe_numeric,
    distinct_roads, eligible_roads, event_coverage, excluded_roads, null_profile, observations_per_road,
    page_overlap, road_statistics, rows_without_match, smallest_roads, stats_reference_join, systematic_sample,
    targets_available, threshold_counts, time_range, top_roads_by_coverage,
)
from kerbside.operators.reference import (
    all_road_ids, latest_version_per_road, linestring_length, list_roads, missing_road_ids,
    normalize_road_reference, reference_for_eligible, roads_not_in_reference, sync_reference_projection,
    versions_per_road,
)
from kerbside.operators.serving import (
    latest_n_for_road, latest_observation_per_road, latest_prediction_for_road, latest_predictions,
    latest_timestamp_by_road, latest_timestamp_rows, latest_traffic_timestamp, persistence_predictions,
    recent_window, response_projection, road_history, top_predicted,
)
from kerbside.plans.features import (
    build_ml_dataset, build_prediction_features, build_traffic_features, build_training_features,
    make_training_dataset, multi_road_coverage, multi_road_dataset, multi_road_rows,
)
from kerbside.plans.inference import horizon_predictions, run_predictions
from kerbside.plans.ingest import (
    bulk_import, bulk_import_counts, incremental_ingest, ingest_events, ingest_traffic, ingest_weather, load_traffic_table,
)
from kerbside.plans.jobs import refresh_job, training_job, inference_job
from kerbside.plans.learners import train_gbt, train_hist_gbt
from kerbside.plans.training import (
    ablation_all, ablation_calendar, ablation_events, ablation_road, ablation_weather, model_comparison,
    train_all_horizons, train_horizon, train_one_horizon, train_report, promote_candidates,
)
from kerbside.sources.landed import (
    traffic_pages as src_traffic_pages, road_reference_pages as src_road_reference_pages, event_pages as
    src_event_pages, weather_payload as src_weather_payload,
)
from kerbside.sources.tables import process_traffic_file, scan_bulk_parquet, scan_parquet, sink_parquet
from kerbside.streaming.inbox import stream_bulk_inbox, stream_dedupe
