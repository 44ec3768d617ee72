"""Shared pieces: reading the corpus, id ranges, bounded batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kerbside.session import run_folder

#: Characters of text that one Arrow slice holds when a task works on it; a longer text is a slice of its own.
SLICE_CHARS = 8_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def field(df: DataFrame, name: str, kind: str) -> Column:
    """A column by name, or nulls where the table has none."""
    if name not in df.columns:
        return F.lit(None).cast(kind).alias(name)
    return F.col(f"`{name}`").cast(kind).alias(name)


def unused(docs: DataFrame, name: str) -> str:
    """A column name like this one that the table doesn't have, by whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def corpus(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), then the string columns named."""
    text = F.coalesce(field(docs, "text", "string"), F.lit("")).alias("text")
    return docs.select(field(docs, "doc_id", "bigint"), text, *(field(docs, name, "string") for name in more))


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The rows after a trip through a table in the shared folder: lineage ends there and every executor can read it."""
    path = run_folder(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ordering(doc_id: Column) -> Column:
    """doc_id as a number that sorts a missing one first."""
    return F.coalesce(doc_id, F.lit(-(2 ** 63)).cast("bigint"))


def with_id_bucket(docs: DataFrame, buckets: int, name: str = "bucket") -> DataFrame:
    """Adds an int column that never falls as doc_id rises, with about as many rows for each value.

    The cut points are approximate quantiles of doc_id, so only that column is read for them and the driver holds at
    most `buckets` numbers. Rows with equal doc_id share a bucket; a missing doc_id is in the lowest.
    """
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 10_000)).first()[0] or []
    inner = sorted({float(c) for c in cuts}) if buckets > 1 and cuts else [0.0]
    splits = [float("-inf"), *inner, float("inf")]
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(-(2.0 ** 64)))
    cut = Bucketizer(splits=splits, inputCol="__key", outputCol="__at").transform(docs.withColumn("__key", key))
    return cut.withColumn(name, F.col("__at").cast("int")).drop("__key", "__at")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that none holds much more than SLICE_CHARS bytes of text."""
    for batch in batches:
        at, size = 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if size and size + n > SLICE_CHARS:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += int(n)
        if at < batch.num_rows:
            yield batch.slice(at)


def beside(docs: DataFrame, name: str, kind: str, work) -> DataFrame:
    """docs with one more column, which `work` makes from each list of whole texts (missing ones are empty).

    `work(texts)` returns one Python value per text, of the Spark type `kind`. All other columns pass through untouched, so
    `name` must be one that docs doesn't have. Slices of texts are bounded.
    """
    if name in docs.columns:
        raise ValueError(f"the table already has a column {name}")
    out = docs.withColumn(name, F.lit(None).cast(kind)).schema
    arrow, held = to_arrow_type(out[name].dataType), unused(docs, "whole_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, held):
            texts = batch.column(held).to_pylist()
            made = pa.array(work(texts), arrow)
            keep = [c for c in batch.schema.names if c != held]
            yield pa.record_batch([*(batch.column(c) for c in keep), made], names=[*keep, name])

    text = F.coalesce(field(docs, "text", "string"), F.lit("")).alias(held)
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns), text).mapInArrow(run, out)
