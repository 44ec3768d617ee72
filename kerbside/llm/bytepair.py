"""Byte-level BPE by ranks, over overlapping chunks, and back.

A text is cut into chunks that overlap. Each chunk is pre-tokenised by itself, so a long text keeps many tasks busy. A match
of the pattern depends only on the text from its start to at most LOOK characters past its end, so once two neighbours agree
on one boundary they agree on all that follow, up to the end of the earlier chunk: there they are stitched. If an overlap
holds no common boundary (a run longer than the overlap), the earlier chunk's last sure boundary is carried on through the
later chunk's text, alone. Then each piece is encoded; pieces seen before come from memory.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import corpus, slices

#: Code points of a chunk and of the overlap with the next one.
CHUNK, OVERLAP = 32_768, 512
#: Code points past a match's end that may have decided it (an apostrophe and two letters, white space and one character).
LOOK = 4
#: Pieces that a worker remembers in each of two generations.
REMEMBERED = 400_000

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, chunks bigint"


class BytePairs:
    """The ranks of a file with the pattern that splits text before the merges."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        self.tool = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def boundaries(self, text: str) -> list[int]:
        """The start of every match; the pattern's matches leave no gaps."""
        return [m.start() for m in self.pattern.finditer(text)]

    def piece(self, piece: str) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.older.get(piece)
            if ids is None:
                ids = self.tool._encode_single_piece(piece)
            if len(piece) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.older, self.known = self.known, {}
                self.known[piece] = ids
        return ids

    def encode(self, pieces: list[str]) -> array:
        out = array("I")
        for piece in pieces:
            out.extend(self.piece(piece))
        return out

    def digests(self, ids: array) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(self.tool.decode_bytes(ids)).hexdigest()


@lru_cache(maxsize=2)
def byte_pairs(path: str, pattern: str) -> BytePairs:
    """One encoder for each rank file and worker."""
    return BytePairs(path, pattern)


def stitch(chunks: list[tuple[int, str, list[int]]], boundaries) -> list[str]:
    """The pieces of a whole text from its chunks (start, text, own boundaries in the text), in order.

    `boundaries(text)` pre-tokenises where an overlap holds no common boundary.
    """
    pieces: list[str] = []
    start, text, cuts = chunks[0]
    cuts = list(cuts)
    for later_start, later, later_cuts in chunks[1:]:
        sure = len(text) - LOOK  # boundaries before it can't change with more text
        sure_cuts = [c for c in cuts if c <= sure]
        own = {c + start for c in sure_cuts}
        meet = next((c for c in later_cuts if c + later_start in own), None)
        if meet is not None:
            upto = meet + later_start - start
            keep = [c for c in sure_cuts if c <= upto]
            pieces += [text[a:b] for a, b in zip(keep, keep[1:])]
            start, text, cuts = later_start, later, [c for c in later_cuts if c >= meet]
            continue
        last = sure_cuts[-1]
        pieces += [text[a:b] for a, b in zip(sure_cuts, sure_cuts[1:])]
        tail = text[last:later_start - start] + later if later_start - start > last else later[start + last - later_start:]
        start, text = start + last, tail
        cuts = boundaries(text)
    ends = [*cuts, len(text)]
    return pieces + [text[a:b] for a, b in zip(ends, ends[1:])]


def _short(path: str, pattern: str):
    """Documents of one chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = byte_pairs(path, pattern)
        for batch in slices(batches):
            rows = [tool.digests(tool.encode(tool.pattern.findall(t))) for t in batch.column("text").to_pylist()]
            n, ids, decoded = zip(*rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded),
                                   pa.array([1] * len(rows), pa.int64())],
                                  names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "chunks"])

    return run


def _cut(path: str, pattern: str):
    """Own boundaries of each chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = byte_pairs(path, pattern)
        for batch in slices(batches):
            cuts = [tool.boundaries(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "whole", "start", "text")),
                                   pa.array(cuts, pa.list_(pa.int32()))], names=["doc_id", "whole", "start", "text", "cuts"])

    return run


def _joined(path: str, pattern: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tool = byte_pairs(path, pattern)
        copies = int((rows["start"] == 0).sum())
        rows = rows.drop_duplicates("start").sort_values("start")
        pieces = stitch([(int(s), t, list(c)) for s, t, c in zip(rows["start"], rows["text"], rows["cuts"])], tool.boundaries)
        n, ids, decoded = tool.digests(tool.encode(pieces))
        name = rows["doc_id"].iloc[0]
        one = {"doc_id": None if pd.isna(name) else int(name), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded,
               "chunks": len(rows)}
        return pd.DataFrame([one] * copies).astype({"doc_id": "Int64"})

    return run


def encode_documents(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256 (the bytes that the ids give back),
    chunks.

    Ids are those of each match of `pattern` by itself, without special tokens. A missing text is empty: no ids. A text of
    one chunk needs no shuffle. Chunks of longer texts are pre-tokenised apart and meet in one task per document; equal rows
    meet there too and each gets its row back.
    """
    if overlap < 4 * LOOK or chunk <= overlap:
        raise ValueError("a chunk must be longer than the overlap, and that at least 16")
    texts = corpus(docs)
    long = F.char_length("text") > chunk
    short = texts.where(~long).mapInArrow(_short(ranks, pattern), SCHEMA)
    starts = F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(chunk))
    chunks = (texts.where(long).withColumn("whole", F.sha2("text", 256))
              .select("doc_id", "whole", "text", F.explode(starts).alias("start"))
              .select("doc_id", "whole", "start", F.substring("text", F.col("start") + 1, F.lit(chunk + overlap)).alias("text")))
    cut = chunks.mapInArrow(_cut(ranks, pattern), "doc_id bigint, whole string, start int, text string, cuts array<int>")
    return short.unionByName(cut.groupBy("doc_id", "whole").applyInPandas(_joined(ranks, pattern), SCHEMA))
