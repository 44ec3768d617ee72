"""Keyed writes as table-to-table functions, and checks of keys and invariants.

An upsert keeps the stored rows whose key is not in the batch and adds the batch.
While the batch is small Spark broadcasts its keys, and the stored rows are not
shuffled at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.values import to_instant
from kerbside.operators.reference import SEGMENT_COLUMNS
from kerbside.operators.serving import PREDICTION_COLUMNS
from kerbside.schemas import KEY, TIME, require_columns

OBSERVATION_KEY = [KEY, TIME]
PREDICTION_KEY = [KEY, "prediction_timestamp_utc", "horizon_hours", "model_version"]


def last_per_key(batch: DataFrame, keys: Sequence[str], ordinal: str | Sequence[str] | None) -> DataFrame:
    """One row per key: the last by the ordinal columns, or the largest row without any."""
    ordinals = [ordinal] if isinstance(ordinal, str) else list(ordinal or ())
    order = [F.col(c).desc_nulls_last() for c in ordinals or [c for c in batch.columns if c not in keys]]
    if not order:
        return batch.dropDuplicates(list(keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return batch.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def repeated_keys(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows of a batch share their key with another row and will be dropped."""
    return batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_dropped")
    )


def upsert(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows with the batch's rows in place of those of the same key."""
    kept = stored.join(batch.select(*keys), list(keys), "left_anti")
    return kept.select(*stored.columns).unionByName(batch.select(*stored.columns))


def traffic_batch(batch: DataFrame, ordinal: str | Sequence[str] | None = None) -> DataFrame:
    """A batch in store shape: four columns, UTC time, one row per key."""
    require_columns(batch, [KEY, TIME, "q", "k"], "traffic")
    rows = batch.withColumn(TIME, to_instant(batch, TIME)).na.drop(subset=OBSERVATION_KEY)
    return last_per_key(rows, OBSERVATION_KEY, ordinal).select(KEY, TIME, "q", "k")


def upsert_traffic(stored: DataFrame, batch: DataFrame, ordinal: str | Sequence[str] | None = None) -> DataFrame:
    """q and k of a known key are replaced, also by null."""
    return upsert(stored, traffic_batch(batch, ordinal), OBSERVATION_KEY)


def merge_traffic(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """`upsert_traffic` for a batch that `traffic_batch` has made: its keys are unique, so nothing is ranked again."""
    return upsert(stored, batch, OBSERVATION_KEY)


def upsert_predictions(stored: DataFrame, batch: DataFrame, ordinal: str = "first_write") -> DataFrame:
    """Value and target time of a known key are replaced; its `first_write` stays.

    Batch rows bring the `first_write` they would get as new rows. Both sides meet in one
    shuffle by key: of a key's rows the last of the batch stays, or the stored one.
    """
    columns = [*PREDICTION_COLUMNS, "first_write"]
    require_columns(batch, columns, "prediction")
    both = stored.select(*columns, F.lit(0).alias("_side")).unionByName(batch.select(*columns, F.lit(1).alias("_side")))
    key = Window.partitionBy(*PREDICTION_KEY)
    rank = F.row_number().over(key.orderBy(F.col("_side").desc(), F.col(ordinal).desc_nulls_last()))
    written = F.min(F.when(F.col("_side") == 0, F.col("first_write"))).over(key)
    return (
        both.withColumns({"_rank": rank, "_written": written}).where("_rank = 1")
        .withColumn("first_write", F.coalesce("_written", "first_write")).select(*columns)
    )


def upsert_roads(stored: DataFrame, batch: DataFrame) -> DataFrame:
    rows = last_per_key(batch.select(*SEGMENT_COLUMNS), [KEY], None)
    return upsert(stored.select(*SEGMENT_COLUMNS), rows, [KEY])


def sync_roads(stored: DataFrame, reference: DataFrame) -> DataFrame:
    """The reference's roads take the place of all stored ones; an empty reference deletes nothing.

    Every stored road is either replaced (same id) or deleted (id not in the
    reference), so only an empty reference lets stored rows through.
    """
    rows = last_per_key(reference.select(*SEGMENT_COLUMNS), [KEY], None)
    arriving = reference.select(F.lit(1).alias("one")).limit(1).agg(F.count("one").alias("n")).scalar()
    return rows.unionByName(stored.select(*SEGMENT_COLUMNS).where(arriving == 0))


def constraint_checks(obs: DataFrame, segments: DataFrame, predictions: DataFrame) -> DataFrame:
    """Number of violations per store rule."""

    def repeated(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return repeated_keys(df, keys).select(
            F.lit(name).alias("rule"), F.col("n_dropped").cast("long").alias("n_violations")
        )

    def counted(df: DataFrame, **rules: Column) -> DataFrame:
        """All row-wise rules of a table in one pass."""
        lines = F.array(*[
            F.struct(F.lit(name.replace("_", " ")).alias("rule"), F.count_if(bad).alias("n_violations"))
            for name, bad in rules.items()
        ])
        return df.agg(lines.alias("lines")).select(F.inline("lines"))

    def missing(columns: list[str]) -> Column:
        return reduce(or_, [F.col(c).isNull() for c in columns])

    parts = [
        repeated(obs, OBSERVATION_KEY, "observations unique key"),
        counted(obs, observations_not_null=missing(OBSERVATION_KEY)),
        repeated(segments, [KEY], "segments unique key"),
        counted(segments, segments_not_null=missing([KEY, "latitude", "longitude"])),
        repeated(predictions, PREDICTION_KEY, "predictions unique key"),
        counted(
            predictions, predictions_not_null=missing(PREDICTION_COLUMNS),
            predictions_horizon_above_zero=~(F.col("horizon_hours") > 0),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def dataset_invariants(dataset: DataFrame, features: DataFrame, source: DataFrame) -> DataFrame:
    """One row of checks on a training dataset built from `features` of `source`."""
    facts = dataset.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(KEY).alias("roads"),
        F.count_if(F.col("target_k_1h").isNull()).alias("no_target"),
        F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()
                   | F.col("road_length_m").isNull()).alias("no_road"),
    )
    wider = features.agg(F.count(F.lit(1))).scalar()
    roads_in = source.agg(F.count_distinct(KEY)).scalar()
    return facts.select(
        (F.col("rows") > 0).alias("not_empty"),
        (F.col("roads") > 1).alias("several_roads"),
        (F.col("roads") <= roads_in).alias("no_new_roads"),
        (F.col("no_target") == 0).alias("target_complete"),
        (F.col("no_road") == 0).alias("road_complete"),
        (F.col("rows") <= wider).alias("not_longer_than_input"),
    )


def ids_complete(requested: DataFrame, found: DataFrame) -> DataFrame:
    """Whether the requested and the found ids are the same set."""
    a, b = (df.select(KEY).distinct() for df in (requested, found))
    lost = a.join(b, KEY, "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    extra = b.join(a, KEY, "left_anti").agg(F.count(F.lit(1)))
    return lost.select("n_missing", extra.scalar().alias("n_unrequested")).withColumn(
        "same_ids", (F.col("n_missing") == 0) & (F.col("n_unrequested") == 0)
    )


def weather_hour_checks(weather: DataFrame) -> DataFrame:
    """Row and distinct hour counts; a table has no order, so sortedness means no repeats."""
    return weather.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(TIME).alias("n_hours"),
        F.min(TIME).alias("first_hour"), F.max(TIME).alias("last_hour"),
    ).withColumn("hours_unique", F.col("n_rows") == F.col("n_hours"))


def migrate_horizon(predictions: DataFrame, strict: bool = False) -> DataFrame:
    """Predictions from before horizons existed were one hour ahead, and the key gets the horizon as a fourth part.

    With `strict` a key that occurs twice is an error: a migration must not choose between rows.
    """
    moved = predictions.withColumn("horizon_hours", F.lit(1))
    if not strict:
        return moved
    same = F.count(F.lit(1)).over(Window.partitionBy(*PREDICTION_KEY))
    once = F.assert_true(F.col("_same") == 1, F.lit("Predictions repeat a key; the horizon can't become part of it."))
    return moved.withColumn("_same", same).where(once.isNull()).drop("_same")
