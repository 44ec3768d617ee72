"""Token id files: one concatenated id array per segment, with Elias-Fano lists of document boundaries and doc_ids.

A segment is one binary value of a Parquet table (part, segment, first_id, ids, payload); parts and segments ascend with
doc_id, so the table is one long id array in doc_id order. Payload, little-endian:

    magic "KTF1", bytes an id (u8), documents without doc_id (u64), smallest doc_id (i64)
    Elias-Fano list: doc_id - smallest, for each document that has one
    Elias-Fano list: first id of each document in this segment, and the end
    ids
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.common import corpus, ordering, shuffle_width, slices, with_id_bucket
from kerbside.llm.elias_fano import EliasFano
from kerbside.llm.encoding import encoder

MAGIC = b"KTF1"
HEAD = struct.Struct("<4sBQq")
#: Ids and documents after which a segment is closed. One longer document makes a segment of its own.
SEGMENT_IDS = 2_000_000
SEGMENT_DOCS = 65_536

FILE_SCHEMA = "part int, segment int, first_id bigint, ids bigint, documents bigint, payload binary"


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """One segment; doc_ids ascend, missing ones come first."""
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    head = HEAD.pack(MAGIC, width, len(doc_ids) - len(known), least)
    ends = np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.uint64))])
    names = EliasFano.of(np.array([d - least for d in known], dtype=np.uint64))
    return head + names.to_bytes() + EliasFano.of(ends).to_bytes() + ids


class Segment:
    """A segment as read back: doc_id(i), boundaries by selection, ids(i)."""

    def __init__(self, payload: bytes):
        magic, self.width, self.unnamed, self.least = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token file segment")
        self.names, at = EliasFano.from_bytes(payload, HEAD.size)
        self.ends, self.at = EliasFano.from_bytes(payload, at)
        self.payload = payload

    def __len__(self) -> int:
        return self.ends.count - 1

    def doc_ids(self) -> list[int | None]:
        return [None] * self.unnamed + [int(v) + self.least for v in self.names.all().tolist()]

    def ids(self, i: int) -> np.ndarray:
        """The ids of document i, found by two selections."""
        return self.between(self.ends.select(i), self.ends.select(i + 1))

    def between(self, a: int, b: int) -> np.ndarray:
        return np.frombuffer(self.payload, f"<u{self.width}", b - a, self.at + a * self.width)


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kerbside.llm.encoding import encoder

        tool, part = encoder(path), TaskContext.get().partitionId()
        end = int(end_id).to_bytes(tool.width, "little")
        names: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []
        state = {"segment": 0, "first": 0, "n": 0}

        def closed() -> pa.RecordBatch:
            payload = pack_segment(names, lengths, b"".join(held), tool.width)
            row = [[part], [state["segment"]], [state["first"]], [state["n"]], [len(names)], [payload]]
            state.update(segment=state["segment"] + 1, first=state["first"] + state["n"], n=0)
            for x in (names, lengths, held):
                x.clear()
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds)],
                                   names=["part", "segment", "first_id", "ids", "documents", "payload"])

        for batch in slices(batches):
            for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), tool.encode_all(batch.column("text").to_pylist())):
                ids = encoded + end
                names.append(doc_id)
                held.append(ids)
                lengths.append(len(ids) // tool.width)
                state["n"] += lengths[-1]
                if state["n"] >= SEGMENT_IDS or len(names) >= SEGMENT_DOCS:
                    yield closed()
        if names:
            yield closed()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write every document's ids and `end_id`, in ascending doc_id order (missing ones first, ties by text).

    `tokenizer` is a file of the tokenizers library that every executor can open. One shuffle deals the texts into doc_id
    ranges; a task streams its range in order and holds one segment at a time. A missing text counts as empty.
    """
    width = encoder(tokenizer).width
    if end_id >= 1 << 8 * width:
        raise ValueError(f"id {end_id} doesn't fit in {width} bytes")
    n = shuffle_width(docs.sparkSession)
    ranged = with_id_bucket(corpus(docs), n).repartitionById(n, F.col("bucket"))
    ordered = ranged.sortWithinPartitions(ordering(F.col("doc_id")), F.col("doc_id").isNotNull(), "text")
    files = ordered.select("doc_id", "text").mapInArrow(_encoded(tokenizer, end_id), FILE_SCHEMA)
    files.write.option("compression", "zstd").parquet(path)


def _read(before: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "first_id", "payload"))):
                segment = Segment(payload)
                ends = segment.ends.all().astype(np.int64)
                crc = [zlib.crc32(segment.between(a, b).astype("<u4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.record_batch([pa.array(segment.doc_ids(), pa.int64()), pa.array(ends[:-1] + (before[part] + first)),
                                       pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit, little-endian).

    Everything comes from the files. The driver holds one sum per part to place the parts after each other.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = dict(files.groupBy("part").agg(F.sum("ids")).collect())
    before, at = {}, 0
    for part in sorted(sums):
        before[part] = at
        at += sums[part]
    return files.select("part", "first_id", "payload").mapInArrow(
        _read(before), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
