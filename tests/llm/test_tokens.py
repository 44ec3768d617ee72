"""Encoding, token files, packing, byte-level BPE."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from kerbside.llm.bytepair import byte_pairs, encode_documents, stitch
from kerbside.llm.elias_fano import EliasFano
from kerbside.llm.encoding import encoder
from kerbside.llm.packing import pack_documents
from kerbside.llm.token_files import Segment, pack_segment, read_token_files, write_token_files
from kerbside.session import run_folder

PARTS = [" ", " ", "\n", "\t", "a", "b", "'s", "'", "!", "é", "1", "23", "<|endoftext|>", "S", "'LL", " ", "\x1c", "é",
         "中文", "İ", "😀", "  ", "\r", "　", "ﬁ", "Σ", "''", "\x85", "‍"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_librarys_ids(name):
    tool, plain, pick = encoder(public.path(name)), Tokenizer.from_file(public.path(name)), random.Random(3)
    for _ in range(3000):
        text = "".join(pick.choice(PARTS) for _ in range(pick.randint(0, 9)))
        assert np.frombuffer(tool.encode(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_elias_fano_round_trip():
    pick = random.Random(1)
    for n in (0, 1, 2, 300, 2000):
        values = np.sort(np.array([pick.randint(0, pick.choice([3, 10 ** 6])) for _ in range(n)], dtype=np.uint64))
        back, end = EliasFano.from_bytes(b"xx" + EliasFano.of(values).to_bytes(), 2)
        assert back.all().tolist() == values.tolist()
        assert [back.select(i) for i in range(n)] == values.tolist()
    wide = EliasFano.of(np.arange(0, 10 ** 6, 50, dtype=np.uint64))
    assert len(wide.to_bytes()) < 20_000 * 8.5 / 8 + 40  # 2 + log2(50) bits each, not 64


def test_segment_selects_documents():
    ids = np.arange(7, dtype="<u2")
    segment = Segment(pack_segment([None, -3, 9], [2, 1, 4], ids.tobytes(), 2))
    assert segment.doc_ids() == [None, -3, 9] and len(segment) == 3
    assert [segment.ids(i).tolist() for i in range(3)] == [[0, 1], [2], [3, 4, 5, 6]]


@pytest.mark.parametrize("table", ["hard", "clashing", "empty"])
def test_token_files(spark, request, texts, table):
    path = run_folder(spark, "files")
    write_token_files(request.getfixturevalue(table), path, public.path("byte_bpe_50k.json"))
    got = [(r[0], r[1], r[2], r[3]) for r in read_token_files(spark, path).collect()]
    plain, at, want = Tokenizer.from_file(public.path("byte_bpe_50k.json")), 0, []
    for doc_id, text in sorted(texts if table != "empty" else [], key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("targets", [None, {"a": 3, "b": 1}])
@pytest.mark.parametrize("table", ["hard", "clashing", "empty"])
def test_packing(request, texts, table, targets):
    got = pack_documents(request.getfixturevalue(table), public.path("word_bpe_49k.json"), 2, length=64, window=128, targets=targets).collect()
    plain, held = Tokenizer.from_file(public.path("word_bpe_49k.json")), []
    if table == "empty":
        assert not got
        return
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert len(held) == r.sequence_id * 64 + r.offset and 0 < r.length <= 64 - r.offset
        held += [r] * r.length
    ids = {d: [*plain.encode(t, add_special_tokens=False).ids, 2] for d, t in texts}
    assert len(held) == sum(len([*plain.encode(t, add_special_tokens=False).ids, 2]) for _, t in texts)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())


def test_packing_keeps_the_mixture(spark):
    rows = [(i, "a b c d e f g h i", "x" if i % 4 else "y") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pack_documents(docs, public.path("word_bpe_49k.json"), 2, length=100, window=100).collect()
    for s in range(3, 37):  # ten tokens a document: 7.5 and 2.5 documents a window, what is short carries over
        of_y = sum(r.length for r in got if r.sequence_id < s and r.source == "y")
        assert abs(of_y - 25 * s) <= 20


def test_stitching_and_decoding():
    tool, pick = byte_pairs(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'", "'ll", "!", "1", "é", "a" * 24, " " * 6, "\t", "    \n\n\n   ", "''", "." * 11]
    for _ in range(1500):
        text, size = "".join(pick.choice(parts) for _ in range(pick.randint(1, 60))), pick.choice([20, 24, 30])
        chunks = [(s, text[s:s + size + 16], tool.boundaries(text[s:s + size + 16])) for s in range(0, len(text), size)]
        pieces = stitch(chunks, tool.boundaries)
        assert pieces == tool.pattern.findall(text)
        assert list(tool.encode(pieces)) == tool.tool.encode_ordinary(text)


@pytest.mark.parametrize("chunk", [32, 32768])
@pytest.mark.parametrize("table", ["hard", "clashing", "empty"])
def test_byte_pairs(request, texts, table, chunk):
    got = encode_documents(request.getfixturevalue(table), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN, chunk, 16).collect()
    tool, want = byte_pairs(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).tool, []
    for doc_id, text in texts if table != "empty" else []:
        ids = tool.encode_ordinary(text)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
