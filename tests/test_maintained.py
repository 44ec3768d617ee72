"""Tables that writes keep up to date: newest times, import counts, versions of small tables, archives."""

import pytest
from times import at, utc

from kerbside.operators.keyed import merge_traffic, traffic_batch
from kerbside.plans.ingest import bulk_import_counts, incremental_ingest, incremental_rows
from kerbside.sources import tables
from kerbside.sources.files import archive_files, create_new, pending_files, read_text
from kerbside.sources.tables import newest_by_road, newest_path, read_store, write_keyed, write_small

OBS = "iu_ac string, timestamp_utc timestamp, q double, k double"


def batch(spark, *rows):
    return traffic_batch(spark.createDataFrame([(r, at(f"2024-01-{d:02d} {h:02d}:00:00"), 1.0, 2.0) for r, d, h in rows], OBS))


def times(df):
    return {r["iu_ac"]: utc(r["latest_timestamp"]) for r in df.collect()}


def by_hand(spark, store):
    out = {}
    for r in read_store(spark, store).collect():
        out[r["iu_ac"]] = max(out.get(r["iu_ac"], utc(r["timestamp_utc"])), utc(r["timestamp_utc"]))
    return out


def test_newest_times_follow_the_writes(spark, tmp_path):
    store = str(tmp_path / "store")
    assert newest_by_road(spark, store) is None
    for rows in ([("1", 1, 5), ("2", 1, 7)], [("1", 1, 3)], [("1", 2, 0), ("3", 1, 1)], []):
        if rows:
            write_keyed(spark, store, batch(spark, *rows), merge_traffic, newest=True)
        assert times(newest_by_road(spark, store)) == by_hand(spark, store)


def test_a_missing_table_is_made_from_the_store(spark, tmp_path):
    store = str(tmp_path / "store")
    write_keyed(spark, store, batch(spark, ("1", 1, 5), ("2", 1, 7)), merge_traffic)
    assert read_text(spark, f"{newest_path(store)}/_current") is None
    assert times(newest_by_road(spark, store)) == by_hand(spark, store)
    write_keyed(spark, store, batch(spark, ("1", 3, 5)), merge_traffic, newest=True)
    assert times(read_store(spark, newest_path(store))) == by_hand(spark, store)


def test_an_incremental_run_does_not_scan_the_history(spark, tmp_path):
    store = str(tmp_path / "store")
    write_keyed(spark, store, batch(spark, *[("1", d, 1) for d in range(1, 9)]), merge_traffic, newest=True)
    arrivals = batch(spark, ("1", 8, 1), ("1", 9, 1), ("2", 9, 1), ("3", 9, 1))
    roads = spark.createDataFrame([("1",), ("2",)], "iu_ac string")
    rows = incremental_rows(arrivals, newest_by_road(spark, store), roads, "2024-01-09 06:00:00")
    assert rows.inputFiles() and all("store__newest" in f for f in rows.inputFiles())
    assert incremental_ingest(spark, arrivals, roads, store, "2024-01-09 06:00:00") == 2
    assert times(newest_by_road(spark, store)) == by_hand(spark, store)
    assert incremental_ingest(spark, arrivals, roads, store, "2024-01-09 06:00:00") == 0


def test_import_counts_come_from_the_import(spark, tmp_path):
    """Two files: padded ids and bad times aren't eligible, a key that comes twice in a file or in both counts once per file."""
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    bulk = "iu_ac string, t_1h string, q double, k double"
    first = [("1", "2024-01-01 00:00:00", 1.0, 1.0), ("1", "2024-01-01 00:00:00", 2.0, 2.0), ("2", "2024-01-01 00:00:00", 3.0, 3.0),
             ("9", "2024-01-01 00:00:00", 4.0, 4.0), (None, "2024-01-01 00:00:00", 4.0, 4.0), ("1", "never", 4.0, 4.0)]
    second = [("1", "2024-01-01 00:00:00", 5.0, None), ("2", "2024-01-01 01:00:00", 6.0, 6.0)]
    for name, rows in (("a", first), ("b", second)):
        spark.createDataFrame(rows, bulk).coalesce(1).write.parquet(str(tmp_path / name))
        inbox.mkdir(exist_ok=True)
        (part,) = (tmp_path / name).glob("*.parquet")
        part.rename(inbox / f"{name}.parquet")
    roads = spark.createDataFrame([("1",), ("2",), ("2",)], "iu_ac string")
    want = {("a.parquet", 6, 3, 2), ("b.parquet", 2, 2, 2), (None, 8, 5, 4)}
    for _ in range(2):
        assert {tuple(r) for r in bulk_import_counts(spark, str(inbox), roads, store).collect()} == want
        assert sorted((r["iu_ac"], utc(r["timestamp_utc"]).hour, r["q"], r["k"]) for r in read_store(spark, store).collect()) == [
            ("1", 0, 5.0, None), ("2", 0, 3.0, 3.0), ("2", 1, 6.0, 6.0)]
    with pytest.raises(RuntimeError, match="no roads"):
        bulk_import_counts(spark, str(inbox), roads.limit(0), store)


def test_a_small_table_switches_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "roads")

    def names():
        return sorted(r["n"] for r in read_store(spark, path).collect())

    for i in range(4):
        write_small(spark.createDataFrame([(f"{i}",)], "n string"), path)
        assert names() == [f"{i}"]
    assert len(list((tmp_path / "roads").glob("_v-*"))) == 2

    def lost(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(tables, "replace_file", lost)
    with pytest.raises(KeyboardInterrupt):
        write_small(spark.createDataFrame([("new",)], "n string"), path)
    assert names() == ["3"]
    monkeypatch.undo()
    write_small(read_store(spark, path).selectExpr("concat(n, '!') as n"), path)
    assert names() == ["3!"] and len(list((tmp_path / "roads").glob("_v-*"))) == 2


def test_a_name_that_is_archived_already_loses_nothing(spark, tmp_path):
    inbox, archive = tmp_path / "in", tmp_path / "archive"
    for text in ("first", "second"):
        inbox.mkdir(exist_ok=True)
        (inbox / "export.parquet").write_text(text)
        archive_files(spark, str(inbox), str(archive), ["export.parquet"])
    assert sorted(f.read_text() for f in archive.glob("*/export.parquet")) == ["first", "second"] and pending_files(spark, str(inbox)) == []


def test_one_of_two_creates_a_file(spark, tmp_path):
    assert [create_new(spark, str(tmp_path / "claims" / "v1")) for _ in range(3)] == [True, False, False]


def test_a_batch_of_many_days_rewrites_only_its_own(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    write_keyed(spark, store, batch(spark, *[("1", d, 1) for d in range(1, 9)]), merge_traffic)
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "store").glob("day=*/*.parquet")}
    monkeypatch.setattr(tables, "LISTED_DAYS", 2)
    write_keyed(spark, store, batch(spark, ("1", 2, 1), ("2", 4, 1), ("2", 7, 1)), merge_traffic)
    after = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "store").glob("day=*/*.parquet")}
    assert len(before.items() & after.items()) == 5
    assert sorted((r["iu_ac"], utc(r["timestamp_utc"]).day) for r in read_store(spark, store).collect()) == [
        *[("1", d) for d in range(1, 9)], ("2", 4), ("2", 7)]


def test_a_cluster_needs_a_folder_that_all_share():
    from types import SimpleNamespace

    from kerbside.session import shared_folder

    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)

    def session(folder):
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: folder))

    with pytest.raises(RuntimeError, match="of each machine's own"):
        shared_folder(session("file:///tmp/x"))
    with pytest.raises(RuntimeError, match="must name"):
        shared_folder(session(None))
    assert shared_folder(session("hdfs:///x")) == "hdfs:///x"
