import random
from datetime import timedelta

import pytest
from times import at, utc
from test_geo import metres

from kerbside.operators.nearby import active_interval_count, event_features, event_radius_pairs

T0 = at("2024-01-01T00:00:00")


def hour(n):
    return T0 + timedelta(hours=n)


@pytest.mark.parametrize("bucket_hours", [5, 24, 336])
def test_interval_counts_match_brute_force(spark, bucket_hours):
    """Half of the intervals end before they start."""
    rnd = random.Random(bucket_hours)
    spans = [(rnd.choice("ab"), rnd.randint(-300, 300), rnd.randint(-300, 300)) for _ in range(120)]
    spans += [("a", 0, 0), ("a", 5, 5), ("b", -5000, 5000)]
    points = [(r, h) for r in "abc" for h in range(-310, 310, 3)]
    got = active_interval_count(
        spark.createDataFrame([(r, hour(h)) for r, h in points] + [("a", None)], "iu_ac string, timestamp_utc timestamp"),
        spark.createDataFrame([(r, hour(a), hour(b)) for r, a, b in spans] + [("a", None, hour(1))],
                              "iu_ac string, interval_start timestamp, interval_end timestamp"),
        bucket_hours=bucket_hours,
    ).collect()
    assert len(got) == len(points) + 1
    for row in got:
        if row["timestamp_utc"] is None:
            assert row["n_active"] is None
            continue
        t = (utc(row["timestamp_utc"]) - utc(T0)).total_seconds() / 3600
        mine = [(a, b) for r, a, b in spans if r == row["iu_ac"]]
        assert row["n_active"] == sum(a <= t for a, _ in mine) - sum(b < t for _, b in mine)


OCCURRENCES = "event_id string, occurrence_start timestamp, occurrence_end timestamp, latitude double, longitude double"


def test_event_features_match_brute_force(spark):
    rnd = random.Random(5)
    roads = {"1": (48.85, 2.35), "2": (48.90, 2.40), "3": (48.85, 2.35), "4": None, "5": (10.0, 10.0)}
    events = [(f"e{i}", rnd.randint(0, 60), rnd.randint(0, 60), 48.85 + rnd.uniform(-.08, .08), 2.35 + rnd.uniform(-.1, .1))
              for i in range(60)]
    rows = []
    for r, place in roads.items():
        for h in range(0, 60, 2):
            known = place and h >= 4  # the first rows have no coordinates
            rows.append((r, hour(h), place[0] if known else None, place[1] if known else None))
    rows.append(("1", None, 48.85, 2.35))
    traffic = spark.createDataFrame(rows, "iu_ac string, timestamp_utc timestamp, latitude double, longitude double")
    held = spark.createDataFrame(
        [(e, hour(a), hour(b), y, x) for e, a, b, y, x in events] + [("none", hour(0), hour(60), None, 2.35)], OCCURRENCES)
    got = event_features(traffic, held, horizon_hours=2, bucket_hours=24).collect()
    assert len(got) == len(rows)
    for r in got:
        place, n = roads[r["iu_ac"]], 0
        if place and r["timestamp_utc"] is not None:
            t = (utc(r["timestamp_utc"]) - utc(T0)).total_seconds() / 3600 + 2
            near = [(a, b) for _, a, b, y, x in events if metres(place[1], place[0], x, y) <= 5000]
            n = sum(a <= t for a, _ in near) - sum(b < t for _, b in near)
        assert r["event_count_nearby_target_1h"] == n
        assert r["has_event_nearby_target_1h"] == int(n > 0)


def test_bounds_are_closed(spark):
    traffic = spark.createDataFrame([("1", hour(h), 48.85, 2.35) for h in range(6)],
                                    "iu_ac string, timestamp_utc timestamp, latitude double, longitude double")
    held = spark.createDataFrame([("e", hour(2), hour(4), 48.85, 2.35)], OCCURRENCES)
    got = {utc(r["timestamp_utc"]).hour: r["event_count_nearby_target_1h"] for r in event_features(traffic, held).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0}


def test_radius_limit_belongs_to_the_radius(spark):
    road, near = (2.35, 48.85), (2.35, 48.88)
    limit = metres(*road, *near)
    roads = spark.createDataFrame([("1", road[1], road[0])], "iu_ac string, latitude double, longitude double")
    held = spark.createDataFrame([("e", hour(0), hour(1), near[1], near[0]), ("f", hour(0), hour(1), near[1], near[0])], OCCURRENCES)
    assert event_radius_pairs(roads, held, limit + 0.001).count() == 2
    assert event_radius_pairs(roads, held, limit - 0.001).count() == 0


def test_roads_may_give_the_positions(spark):
    traffic = spark.createDataFrame([("1", hour(1), None, None)], "iu_ac string, timestamp_utc timestamp, latitude double, longitude double")
    roads = spark.createDataFrame([("1", 48.85, 2.35)], "iu_ac string, latitude double, longitude double")
    held = spark.createDataFrame([("e", hour(2), hour(4), 48.85, 2.35)], OCCURRENCES)
    assert event_features(traffic, held).first()["event_count_nearby_target_1h"] == 0
    assert event_features(traffic, held, roads=roads).first()["event_count_nearby_target_1h"] == 1


def test_dense_city_is_complete_and_split(spark):
    """2,000 roads and 150 venues within a few cells: every pair is found once, over many join keys."""
    from kerbside.operators.nearby import PART_VENUES, haversine_pairs

    rnd = random.Random(8)
    spot = lambda: (48.85 + rnd.uniform(-.06, .06), 2.35 + rnd.uniform(-.08, .08))
    roads = [(str(i), *spot()) for i in range(2000)]
    venues = [spot() for _ in range(150)]
    got = haversine_pairs(spark.createDataFrame(roads, "iu_ac string, latitude double, longitude double"),
                          spark.createDataFrame(venues, "venue_latitude double, venue_longitude double")).collect()
    want = {(r, y, x) for r, a, b in roads for y, x in venues if metres(b, a, x, y) <= 5000}
    assert len(venues) > PART_VENUES and len(got) == len(want)
    assert {(g["iu_ac"], g["venue_latitude"], g["venue_longitude"]) for g in got} == want


def covered(spark, roads, venues, radius_m=5000.0):
    """What the cover says is near each road, cells taken apart, and its numbers of rows."""
    from kerbside.operators.nearby import _with_cells, venue_cover

    where = spark.createDataFrame(roads, "iu_ac string, latitude double, longitude double")
    held = spark.createDataFrame(venues, "venue_latitude double, venue_longitude double").distinct()
    cells, found, rows = _with_cells(held, radius_m), [], []
    for part, by in zip(venue_cover(where, held, radius_m), (["_own", "_coarse"], ["_own", "_coarse", "_fine"], None)):
        rows.append(part.count())
        single = part.join(cells, by) if by else part
        found += [(r["iu_ac"], r["venue_latitude"], r["venue_longitude"]) for r in single.collect()]
    return found, rows


@pytest.mark.parametrize("middle", [(48.85, 2.35), (0.0, 179.99), (-70.0, -180.0), (89.97, 10.0)])
def test_cover_names_every_venue_once(spark, middle):
    rnd = random.Random(3)

    def spot():
        lat = max(-90.0, min(90.0, middle[0] + rnd.uniform(-.1, .1)))
        return lat, (middle[1] + rnd.uniform(-.15, .15) * (1 if abs(middle[0]) < 80 else 900) + 180) % 360 - 180

    roads, venues = [(str(i), *spot()) for i in range(40)], list({spot() for _ in range(400)})
    found, rows = covered(spark, roads, venues)
    assert sorted(found) == sorted((r, y, x) for r, a, b in roads for y, x in venues if metres(b, a, x, y) <= 5000)
    assert rows[0] and sum(rows) < len(found)


def test_doubled_venues_in_a_cell_add_no_rows(spark):
    """A venue's neighbours stand for it: more of them within a road's radius cost the road nothing."""
    roads = [(str(i), 48.85 + i / 10000, 2.35) for i in range(30)]
    one = [(48.86, 2.36 + i / 100000) for i in range(20)]
    rows = [covered(spark, roads, venues)[1] for venues in (one, one + [(y, x + 1e-6) for y, x in one])]
    assert rows[0] == rows[1] == [30, 0, 0]
