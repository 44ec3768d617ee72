import random
from datetime import timedelta

from times import at, utc

from kerbside.operators.incremental import bootstrap_window, cursor_filter, cursors, freshness_gate, new_data_gate, new_vs_known_roads, road_cursors
from kerbside.operators.keyed import upsert_traffic
from kerbside.plans.ingest import bulk_import, incremental_ingest
from kerbside.schemas import BULK_EXPORT, OBSERVATIONS
from kerbside.sources.tables import read_store, write_keyed
from kerbside.streaming.inbox import read_inbox, stream_bulk_inbox, stream_dedupe

import pytest

T0 = at("2024-01-01T00:00:00")
NOW = "2024-01-05 00:00:00"


def obs(spark, rows):
    return spark.createDataFrame([(r, T0 + timedelta(hours=h), float(h), 1.0) for r, h in rows], OBSERVATIONS)


def ids(spark, *roads):
    return spark.createDataFrame([(r,) for r in roads], "iu_ac string")


def facts(df):
    return sorted((r["iu_ac"], int((utc(r["timestamp_utc"]) - utc(T0)).total_seconds() // 3600)) for r in df.collect())


def test_cursors(spark):
    stored = obs(spark, [("1", 5), ("1", 3), ("2", 5), ("9", 1)])
    roads = ids(spark, "1", "2", "3", "3")
    got = {r["iu_ac"]: r["latest_timestamp"] and utc(r["latest_timestamp"]).hour for r in cursors(roads, stored).collect()}
    assert got == {"1": 5, "2": 5, "3": None}
    assert {r["n_roads"]: (r["first_road"], r["last_road"]) for r in road_cursors(roads, stored).collect()} == {2: ("1", "2"), 1: ("3", "3")}
    assert cursors(roads.limit(0), stored).count() == 0
    assert {r["iu_ac"]: r["is_known"] for r in new_vs_known_roads(roads, stored).collect()} == {"1": True, "2": True, "3": False}
    arrivals = obs(spark, [("1", 5), ("1", 6), ("3", 0), ("9", 99)])
    assert facts(cursor_filter(arrivals, cursors(roads, stored))) == [("1", 6), ("3", 0)]


def test_bootstrap_matches_brute_force(spark):
    rnd = random.Random(10)
    arrivals = [(r, h) for r in "abcdefg" for h in range(96) if rnd.random() < 0.8]
    stored = [("a", 90), ("c", 50)]
    got = facts(bootstrap_window(obs(spark, arrivals), cursors(ids(spark, *"abcdef"), obs(spark, stored)), NOW, 72))
    cursor = {**dict.fromkeys("abcdef", 24), **dict(stored)}
    assert got == sorted((r, h) for r, h in arrivals if r in cursor and h > cursor[r])


def test_a_road_that_starts_late_loses_nothing(spark, tmp_path):
    store = str(tmp_path / "late")
    rows = [("a", h) for h in range(30, 42)] + [("b", h) for h in range(30, 38)] + [("c", h) for h in range(90, 95)]
    segments = ids(spark, "a", "b", "c")
    assert incremental_ingest(spark, obs(spark, rows), segments, store, NOW) == 25
    assert facts(read_store(spark, store)) == sorted(rows)


def test_incremental_run_is_repeatable(spark, tmp_path):
    store = str(tmp_path / "store")
    write_keyed(spark, store, obs(spark, [("1", 50)]), upsert_traffic)
    arrivals = obs(spark, [("1", 49), ("1", 50), ("1", 51), ("2", 10), ("2", 80), ("3", 80)])
    segments = ids(spark, "1", "2")
    assert incremental_ingest(spark, arrivals, segments, store, NOW) == 2
    assert facts(read_store(spark, store)) == [("1", 50), ("1", 51), ("2", 80)]
    assert incremental_ingest(spark, arrivals, segments, store, NOW) == 0
    empty = str(tmp_path / "empty")
    assert incremental_ingest(spark, arrivals, segments, empty, NOW) == 4


def test_training_gates(spark):
    df = obs(spark, [("1", 72)])
    assert freshness_gate(df, NOW).first()["is_fresh"] is True
    late = freshness_gate(df, "2024-01-05 00:00:01").first()
    assert late["is_fresh"] is False and late["age_hours"] > 24
    assert freshness_gate(df.limit(0), NOW).first()["is_fresh"] is False

    def required(last):
        table = spark.createDataFrame([(last,)], "t timestamp")
        return new_data_gate(df, table).first()["training_required"]

    assert required(None) is True and required(T0) is True
    assert required(T0 + timedelta(hours=72)) is False


def land(spark, folder, name, rows):
    df = spark.createDataFrame([(r, f"2024-01-{d:02d}T00:00:00Z", q, 1.0) for r, d, q in rows], BULK_EXPORT)
    df.coalesce(1).write.mode("append").parquet(str(folder))


def test_bulk_import_is_idempotent(spark, tmp_path):
    inbox, store = tmp_path / "bulk", str(tmp_path / "store")
    land(spark, inbox, "a", [("1", 1, 1.0), ("2", 1, 2.0), ("9", 1, 3.0), (None, 1, 4.0)])
    for _ in range(2):
        assert bulk_import(spark, str(inbox), ids(spark, "1", "2"), store) == 2
        assert read_store(spark, store).count() == 2
    with pytest.raises(RuntimeError, match="no roads"):
        bulk_import(spark, str(inbox), ids(spark, "1").limit(0), store)


def test_later_rows_win(spark, tmp_path):
    inbox, store = tmp_path / "bulk", str(tmp_path / "store")
    rows = [("1", 1, float(n)) for n in range(500)] + [("1", 1, None)]
    land(spark, inbox, "a", rows)
    assert bulk_import(spark, str(inbox), ids(spark, "1"), store) == 1
    assert read_store(spark, store).first()["q"] is None
    query = stream_bulk_inbox(spark, str(inbox), ids(spark, "1"), str(tmp_path / "other"), str(tmp_path / "state"))
    query.awaitTermination()
    assert read_store(spark, str(tmp_path / "other")).first()["q"] is None


def test_stream_restarts_and_redelivery(spark, tmp_path):
    inbox, store, state = tmp_path / "inbox", str(tmp_path / "store"), str(tmp_path / "state")
    roads = ids(spark, "1", "2")

    def run():
        query = stream_bulk_inbox(spark, str(inbox), roads, store, state, max_files=1)
        query.awaitTermination()
        return sorted((r["iu_ac"], utc(r["timestamp_utc"]).day, r["q"]) for r in read_store(spark, store).collect())

    land(spark, inbox, "a", [("1", 1, 1.0), ("9", 1, 1.0)])
    land(spark, inbox, "b", [("2", 2, 2.0)])
    first = run()
    assert first == [("1", 1, 1.0), ("2", 2, 2.0)]
    assert run() == first  # nothing new
    land(spark, inbox, "c", [("1", 1, 5.0), ("2", 2, 2.0), ("2", 3, None)])  # a correction and a repeat
    after = [("1", 1, 5.0), ("2", 2, 2.0), ("2", 3, None)]
    assert run() == after
    state = str(tmp_path / "lost")  # without its checkpoint the stream reads all files again
    assert {r[:2] for r in run()} == {r[:2] for r in after}


def test_stream_dedupe(spark, tmp_path):
    inbox, store = tmp_path / "inbox", str(tmp_path / "deduped")
    land(spark, inbox, "a", [("1", 1, 1.0), ("1", 1, 1.0), ("2", 10, 1.0)])
    stream_dedupe(read_inbox(spark, str(inbox), max_files=1), store, str(tmp_path / "state")).awaitTermination()
    land(spark, inbox, "b", [("1", 2, 1.0), ("2", 11, 1.0), ("1", 1, 7.0)])  # days behind the newest row
    stream_dedupe(read_inbox(spark, str(inbox), max_files=1), store, str(tmp_path / "state")).awaitTermination()
    got = sorted((r["iu_ac"], r["timestamp_utc"].date().day, r["q"]) for r in read_store(spark, store).collect())
    assert got == [("1", 1, 7.0), ("1", 2, 1.0), ("2", 10, 1.0), ("2", 11, 1.0)]
