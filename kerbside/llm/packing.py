"""Mixture-controlled packing: deficit round-robin over one queue of documents per source.

Every window gives each source a quantum of its share times the window's tokens. A source's next document is served once
the quanta it has been given cover its tokens; what is left is its deficit and carries into the next window. A document
that ends at token e of its source's queue is therefore served in window ceil(e / quantum), whichever task looks at it, so
deficits carry across windows and partitions without any state to hand over. Within a window documents stand by the share of
their source's quantum that is used up with them, so that not only windows but single sequences follow the proportions. The row
of tokens is cut into sequences; only the last one needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import corpus, shuffle_width, slices, stored

#: Rows of the table of queue starts (one per source and scan part) up to which it is broadcast; beyond, a shuffled join.
SMALL_ROWS = 50_000

ENCODED = "part int, seq bigint, source string, doc_id bigint, before bigint, doc_tokens bigint, ids binary"
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, source string, window bigint")


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kerbside.llm.encoding import encoder

        tool, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(tool.width, "little")
        queued: dict[str, int] = {}
        for batch in slices(batches):
            sources = [s or "" for s in batch.column("source").to_pylist()]
            ids = [x + end for x in tool.encode_all(batch.column("text").to_pylist())]
            lengths, before = [len(x) // tool.width for x in ids], []
            for s, n in zip(sources, lengths):
                before.append(queued.get(s, 0))
                queued[s] = before[-1] + n
            yield pa.record_batch([
                pa.array([part] * len(ids), pa.int32()), pa.array(range(seq, seq + len(ids)), pa.int64()), pa.array(sources, pa.string()),
                batch.column("doc_id"), pa.array(before, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()),
            ], names=["part", "seq", "source", "doc_id", "before", "doc_tokens", "ids"])
            seq += len(ids)

    return run


def _cut(first: dict[int, int], length: int, width: int):
    """Pieces of documents that come in serving order; `first`: tokens before each task's first one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = first.get(TaskContext.get().partitionId(), 0)
        kinds = (*[pa.int64()] * 7, pa.string(), pa.int64())
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in slices(batches, "ids"):
            rows: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids", "source", "window"))
            for doc_id, n, ids, source, window in zip(*columns):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                start = 0
                while start < n:
                    size = min(n - start, length - at % length)
                    crc = zlib.crc32(wide[start:start + size].tobytes())
                    rows.append((doc_id, start, size, crc, n, at // length, at % length, source, window))
                    start, at = start + size, at + size
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, window: int = 64 * 4096,
                   targets: dict[str, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, window.

    Every id, `end_id` after each document included, lies in exactly one piece; offsets in a sequence have no gaps; all
    sequences but the last are full. `targets` gives sources their share of every window (positive numbers, any scale;
    sources that it lacks, and all without it, get their share of all tokens, so that every queue lasts to the end).
    A missing text is empty (one id), a missing source the queue named "". Queues go by the order of the scan.

    Texts are encoded once and never shuffled; the ids are, once, into window ranges of equal size. The driver holds one
    token count per range, however many sources there are; the starts of the queues are broadcast only if they are few.
    """
    from kerbside.llm.encoding import encoder

    spark, width = docs.sparkSession, encoder(tokenizer).width
    encoded = stored(corpus(docs, "source").mapInArrow(_encode(tokenizer, end_id), ENCODED), "packing", compression="zstd")
    each = encoded.groupBy("source", "part").agg(F.sum("doc_tokens").alias("tokens"))
    by_part = Window.partitionBy("source").orderBy("part")
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    queues = each.select("source", "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("queued"),
                         F.sum("tokens").over(Window.partitionBy("source")).alias("of_source"))
    total, starts = each.agg(F.sum("tokens"), F.count("*")).first()
    total = total or 0
    share = F.col("of_source") / F.lit(float(max(1, total)))
    if targets:
        whole = sum(targets.values())
        named = [F.when(F.col("source") == s, F.lit(w / whole)) for s, w in targets.items()]
        share = F.coalesce(*named, share)
    ends = F.col("queued") + F.col("before") + F.col("doc_tokens")
    served = (encoded.join(F.broadcast(queues) if starts <= SMALL_ROWS else queues, ["source", "part"])
              .withColumn("turn", ends / (share * F.lit(float(window)))).withColumn("window", F.ceil("turn").cast("bigint")))
    n = shuffle_width(spark)
    last = served.agg(F.max("window")).first()[0] or 0
    ranged = served.withColumn("range", F.least(F.floor(F.col("window") * n / F.lit(float(last + 1))), F.lit(n - 1)).cast("int"))
    sums = dict(ranged.groupBy("range").agg(F.sum("doc_tokens")).collect())
    first, at = {}, 0
    for r in sorted(sums):
        first[r] = at
        at += sums[r]
    order = ranged.repartitionById(n, F.col("range")).sortWithinPartitions("window", "turn", "source", "part", "seq")
    return order.select("doc_id", "doc_tokens", "ids", "source", "window").mapInArrow(_cut(first, length, width), PIECES)
