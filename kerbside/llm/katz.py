"""Katz backoff: Good-Turing discounted counts of words and word pairs, exactly normalised backoff weights.

p(w | v) of a pair seen r times in training is d(r) r / c(v); otherwise it is alpha(v) p(w), where p(w) is the word's own
Good-Turing discounted share, and all unknown words together get the mass that those discounts free. alpha(v) is what the
pairs of v leave over, divided by one minus the sum of p(w) over the words seen after v, so that the probabilities of all words
and of the unknown one sum to one after every v. Texts begin after a start mark and end with an end mark, which is a word.

Tokens never move one by one. Documents are tokenised once into blocks of some million tokens, which know words by numbers of
their own. A block asks for what it needs by distinct word, then by distinct pair: its questions go, packed and sorted, to
buckets; a bucket adds up the training counts of all blocks, writes its part of the model's table and answers every block in
the order of its questions. A frequent word's pairs are dealt over as many buckets as its share of all tokens would fill, so
that no word makes a bucket large; the sums of such words, at most one for each bucket, meet in the driver.
"""

from __future__ import annotations

import gc
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.common import corpus, shuffle_width, slices
from kerbside.session import run_folder

#: Tokens from which on a block is closed; a document is never parted.
BLOCK_TOKENS = 2_000_000
#: Tokens for which one bucket of questions is meant.
BUCKET_TOKENS = 4_000_000
#: Counts up to this one are discounted.
K = 5
#: The end mark among word hashes, the start mark among word numbers.
END, START = np.uint64(1), (1 << 32) - 1
#: Bytes from which on a word is hashed by itself.
LONG_WORD = 1024

BLOCK = ("block bigint, doc_ids array<bigint>, sizes array<bigint>, held array<boolean>, n_train bigint, n_train_docs bigint, "
         "words binary, tokens binary, train binary")
MESSAGE = "target bigint, sender bigint, kind int, tally array<bigint>, blobs array<binary>"
ANSWER, HOT, TABLE = 0, 1, 2
SCORES = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")

_ODD = (np.random.default_rng(12).integers(1, 2 ** 63, 64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 as compressed planes of bytes."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or w == 8 or int(values.max()) < 1 << (8 * w))
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[9:], n * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, with an END after each text, and the tokens of each text.

    Two of a billion different words share a hash with a chance of a few per cent; nothing else is inexact here.
    """
    data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    step = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    size = ends - starts
    out = np.empty(len(starts), np.uint64)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    usual = np.flatnonzero(size <= LONG_WORD)
    upto = np.cumsum(size[usual])
    cuts = np.searchsorted(upto, np.arange(0, (int(upto[-1]) if len(upto) else 0) + 1_000_000, 1_000_000))
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        some = usual[low:high]
        if not len(some):
            continue
        n = size[some]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        letters = data[np.repeat(starts[some], n) + inside].astype(np.uint64) + np.uint64(1)
        terms = letters * _ODD[inside & 63] * (2 * (inside >> 6) + 1).astype(np.uint64)
        out[some] = mixed(np.add.reduceat(terms, first) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out[out <= END] += np.uint64(2)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, bounds)]))
    tokens = np.empty(len(out) + len(texts), np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[np.cumsum(counts + 1) - 1] = True
    tokens[is_end], tokens[~is_end] = END, out
    return tokens, counts + 1


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    doc_ids, sizes, tokens, n = [], [], [], 0

    def block() -> pa.RecordBatch:
        held = [is_held_out(d) for d in doc_ids]
        size = np.concatenate(sizes)
        words, local, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        local = number[local]
        train = np.bincount(local[np.repeat(~np.array(held), size)], minlength=len(words))
        columns = ([(part << 32) + seq], [doc_ids], [size], [held], [int(train.sum())], [len(held) - sum(held)],
                   [words[order].astype("<u8").tobytes()], [pack(local)], [pack(train)])
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.int64(), *[pa.binary()] * 3)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in BLOCK.split(", ")])

    for batch in slices(batches):
        got, size = word_hashes(batch.column("text").cast(pa.binary()).to_pylist())
        doc_ids += batch.column("doc_id").to_pylist()
        sizes.append(size)
        tokens.append(got)
        n += len(got)
        if n >= BLOCK_TOKENS:
            yield block()
            doc_ids, sizes, tokens, n, seq = [], [], [], 0, seq + 1
    if doc_ids:
        yield block()


def _messages(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()))
    columns = list(zip(*rows)) or [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["target", "sender", "kind", "tally", "blobs"])


def _tally(counts: np.ndarray) -> list[int]:
    """How many have been counted 1 to K + 1 times."""
    return np.bincount(counts[counts <= K + 1], minlength=K + 2)[1:].tolist()


def _word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray):
    """The order by bucket, and (bucket, where it begins and ends in that order)."""
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return order, zip(bucket[order][at].tolist(), at.tolist(), np.append(at[1:], len(order)).tolist())


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = np.frombuffer(batch.column("words")[i].as_py(), "<u8")
                train, block = unpack(batch.column("train")[i].as_py()), batch.column("block")[i].as_py()
                order, cut = _by_bucket(_word_bucket(words, buckets))
                rows = [(b, block, ANSWER, [], [words[order[x:y]].tobytes(), pack(train[order[x:y]])]) for b, x, y in cut]
                yield from _messages(rows).to_batches()

    return run


def _answer_words(buckets: int):
    """Counts and numbers of a bucket's words; the more frequent a word, the smaller its number."""
    def run(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
        bucket, senders, blobs = key[0].as_py(), asked.column("sender").to_pylist(), asked.column("blobs").to_pylist()
        parts = [np.frombuffer(b[0], "<u8") for b in blobs]
        words, of = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(of, np.concatenate([unpack(b[1]) for b in blobs])).astype(np.int64)
        number = np.empty(len(words), np.int64)
        number[np.argsort(-counts, kind="stable")] = np.arange(len(words)) * buckets + bucket
        if int(number.max()) >= START:
            raise OverflowError("more than 2**32 different words")
        rows, at = [], 0
        for sender, part in zip(senders, parts):
            own = of[at:at + len(part)]
            rows.append((sender, bucket, ANSWER, [], [pack(number[own]), pack(counts[own])]))
            at += len(part)
        seen = counts > 0
        tally = [int(seen.sum()), *_tally(counts)]
        rows.append((None, bucket, TABLE, tally, [words[seen].tobytes(), pack(number[seen]), pack(counts[seen])]))
        return _messages(rows)

    return run


@dataclass
class Words:
    """What is known of the training words as a whole."""

    n: int
    distinct: int
    n_docs: int
    buckets: int
    discount: np.ndarray

    freed: float

    def __post_init__(self) -> None:
        """Without discounts one more token stands for all unknown words."""
        self.total = self.n if self.freed > 0 else self.n + 1
        self.unknown = (self.freed or 1.0) / self.total

    def share(self, counts: np.ndarray) -> np.ndarray:
        """p(w) by count; 0 is the count of the unknown word."""
        return np.where(counts > 0, self.discount[np.minimum(counts, K + 1)] * counts / self.total, self.unknown)


def discounts(tally: list[int]) -> np.ndarray:
    """d(r) for r from 0 to K + 1, the last for all greater ones: Good-Turing with Katz's correction.

    Where that gives no number between 0 and 1, as with counts that all copies share, half a count is taken off.
    """
    n = [0, *tally]
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    out = np.ones(K + 2)
    for r in range(1, K + 1):
        turing = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = turing if 0 < turing < 1 else (r - 0.5) / r
    return out


class Pairs:
    """A block's distinct pairs in the order in which it asks for them, and where every token's pair stands there."""

    def __init__(self, block: dict, answers: list[tuple], words: Words):
        self.sizes = np.array(block["sizes"], np.int64)
        self.tokens = unpack(block["tokens"]).astype(np.int32)
        self.train = np.repeat(~np.array(block["held"], bool), self.sizes)
        hashes = np.frombuffer(block["words"], "<u8")
        order, _ = _by_bucket(_word_bucket(hashes, words.buckets))
        number, self.counts = np.empty(len(hashes) + 1, np.int64), np.empty(len(hashes) + 1, np.int64)
        got = [blobs for _, blobs in sorted(answers)]
        number[order], self.counts[order] = (np.concatenate([unpack(b[k]) for b in got]) for k in (0, 1))
        number[-1], self.counts[-1] = START, words.n_docs
        before = np.empty(len(self.tokens), np.int32)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = len(hashes)
        number = number.astype(np.uint64)
        key = number[before]
        key <<= np.uint64(32)
        key |= number[self.tokens]
        pairs, first, of = distinct(key)
        del key
        first_count = self.counts[before[first]]
        fair = max(1, words.n // words.buckets)
        ways = np.clip(-(-first_count // fair), 1, words.buckets).astype(np.uint64)
        v, w = pairs >> np.uint64(32), pairs & np.uint64(START)
        bucket = (mixed(v) % np.uint64(words.buckets) + mixed(w + np.uint64(7)) % ways) % np.uint64(words.buckets)
        order, cut = _by_bucket(bucket.astype(np.int64))
        self.cut = list(cut)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.of = place[of]
        self.pairs, self.hot = pairs[order], (ways > 1)[order]
        self.first_count, self.second_count = first_count[order], self.counts[self.tokens[first]][order]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and every key's number among them; in less room than numpy's own needs."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], order[new], of


def heads(v: np.ndarray) -> np.ndarray:
    """Where the first words of pairs that stand in order change."""
    return np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)


def _row(table: pa.Table) -> dict:
    return table.slice(0, 1).to_pylist()[0]


def _ask_pairs(words: Words):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = _row(block)
        p = Pairs(row, list(zip(answers.column("sender").to_pylist(), answers.column("blobs").to_pylist())), words)
        train = np.bincount(p.of, p.train, minlength=len(p.pairs)).astype(np.int64)
        rows = []
        for b, x, y in p.cut:
            v, w = (p.pairs[x:y] >> np.uint64(32)).astype(np.int64), p.pairs[x:y] & np.uint64(START)
            rows.append((b, row["block"], ANSWER, [], [
                pack(np.diff(v, prepend=0)), pack(w), pack(train[x:y]), pack(p.second_count[x:y]), pack(p.hot[x:y][heads(v)])]))
        return _messages(rows)

    return run


def _answer_pairs(words: Words):
    """Counts of a bucket's pairs, and for every first word how many of its pairs were counted 1 to K times and the sum of p(w)
    over the words seen after it."""
    def run(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
        bucket, senders, blobs = key[0].as_py(), asked.column("sender").to_pylist(), asked.column("blobs").to_pylist()
        parts, hots = [], []
        for b in blobs:
            v = np.cumsum(unpack(b[0])).astype(np.uint64)
            parts.append((v << np.uint64(32)) | unpack(b[1]).astype(np.uint64))
            hots.append(v[heads(v)][unpack(b[4]) > 0])
        pairs, of = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(of, np.concatenate([unpack(b[2]) for b in blobs])).astype(np.int64)
        second = np.empty(len(pairs), np.int64)
        second[of] = np.concatenate([unpack(b[3]) for b in blobs])
        v = pairs >> np.uint64(32)
        at = heads(v)
        few = np.stack([np.add.reduceat((counts == r).astype(np.int64), at) for r in range(1, K + 1)])
        sums = np.add.reduceat(np.where(counts > 0, words.share(second), 0.0), at)
        rows, here, number = [], 0, np.repeat(np.arange(len(at)), np.diff(np.append(at, len(v))))
        for sender, part in zip(senders, parts):
            own = of[here:here + len(part)]
            first = number[own[heads(part >> np.uint64(32))]]
            rows.append((sender, bucket, ANSWER, [], [pack(counts[own]), pack(few[:, first].ravel()), sums[first].tobytes()]))
            here += len(part)
        hot = np.flatnonzero(np.isin(v[at], np.unique(np.concatenate(hots))))
        if len(hot):
            rows.append((None, bucket, HOT, [], [pack(v[at][hot]), pack(few[:, hot].ravel()), sums[hot].tobytes()]))
        seen = counts > 0
        rows.append((None, bucket, TABLE, _tally(counts), [
            pack(np.diff(v[seen].astype(np.int64), prepend=0)), pack(pairs[seen] & np.uint64(START)), pack(counts[seen])]))
        return _messages(rows)

    return run


def _score(words: Words, discount: np.ndarray, hot: dict[int, tuple[np.ndarray, float]]):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = _row(block)
        got: dict[int, list] = {0: [], 1: []}
        for level, sender, blobs in zip(*(answers.column(c).to_pylist() for c in ("level", "sender", "blobs"))):
            got[level].append((sender, blobs))
        p = Pairs(row, got[0], words)
        counts = np.zeros(len(p.pairs), np.int64)
        freed, sums = np.zeros(len(p.pairs)), np.zeros(len(p.pairs))
        free = (1 - discount[1:K + 1]) * np.arange(1, K + 1)
        for (_, x, y), (_, (r, few, total)) in zip(p.cut, sorted(got[1])):
            v = p.pairs[x:y] >> np.uint64(32)
            at = heads(v)
            few, total = unpack(few).reshape(K, len(at)), np.frombuffer(total).copy()
            for i in np.flatnonzero(p.hot[x:y][at]).tolist():
                few[:, i], total[i] = hot[int(v[at[i]])]
            n = np.diff(np.append(at, y - x))
            counts[x:y], freed[x:y], sums[x:y] = unpack(r), np.repeat(free @ few, n), np.repeat(total, n)
        known = p.first_count > 0
        room = np.where(freed > 0, p.first_count, p.first_count + 1)  # a word whose pairs give nothing up gets one more token
        left = np.where(freed > 0, freed, 1.0) / np.maximum(room, 1)
        alpha = np.where(known, left / np.maximum(1 - sums, 1e-300), 1.0)
        seen = discount[np.minimum(counts, K + 1)] * counts / np.maximum(room, 1)
        chance = np.log10(np.where(counts > 0, seen, alpha * words.share(p.second_count)))
        base = np.log10((p.counts[:-1] + 0.1) / (words.n + 0.1 * (words.distinct + 1)))
        first = np.cumsum(p.sizes) - p.sizes
        n = len(p.sizes)
        return pa.table([
            pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(p.sizes, pa.int64()),
            pa.array(np.add.reduceat((p.counts[p.tokens] > 0).astype(np.int64), first), pa.int64()), pa.array([words.n] * n, pa.int64()),
            pa.array(np.add.reduceat(base[p.tokens], first)), pa.array(np.add.reduceat(chance[p.of], first)),
        ], names=[c.split()[0] for c in SCORES.split(", ")])

    return run


def _table(df: DataFrame, path: str) -> DataFrame:
    """Messages written by kind, so that a reader of one kind opens no other."""
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _let_go(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs whose rows are written: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _hot_words(pairs: DataFrame) -> dict[int, tuple[np.ndarray, float]]:
    """The sums of words that are dealt over several buckets, of which there are at most as many as buckets."""
    out: dict[int, tuple[np.ndarray, float]] = {}
    for r in pairs.where(F.col("kind") == HOT).orderBy("sender").toLocalIterator():
        v, few, total = unpack(r["blobs"][0]), unpack(r["blobs"][1]), np.frombuffer(r["blobs"][2])
        for i, (word, of_word) in enumerate(zip(v.tolist(), few.reshape(K, len(v)).T)):
            n, s = out.get(word, (0, 0.0))
            out[word] = (n + of_word, s + float(total[i]))
    return out


def score_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    One document in ten, by CRC-32 of its id as text, is held out: it teaches nothing. `score` is the model's log10 probability of
    the whole text with its end, `base_score` that of single words with 0.1 added to each count; `n_known` counts tokens seen in
    training. The tables `blocks`, `words` (hash, number, count) and `pairs` (first, second, count) go below `path`, a new folder
    in the shared one by default; those of the model are the rows of kind TABLE, one for each bucket.

    A missing or empty text is its end mark alone. A missing doc_id counts as empty text, so it is held out. Repeated rows each have
    their row and each count. Without a training document every token is unknown and has probability one. An empty table gives no
    rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    path = path or run_folder(spark, "katz")
    made = corpus(docs).mapInArrow(_blocks, BLOCK)
    made.write.parquet(f"{path}/blocks")
    blocks = spark.read.schema(made.schema).parquet(f"{path}/blocks")
    n, n_docs = (x or 0 for x in blocks.agg(F.sum("n_train"), F.sum("n_train_docs")).first())
    tokens = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(shuffle_width(spark), -(-tokens // BUCKET_TOKENS))

    asked = blocks.select("block", "words", "train").mapInArrow(_ask_words(buckets), MESSAGE)
    of_words = _table(asked.groupBy("target").applyInArrow(_answer_words(buckets), MESSAGE), f"{path}/words")
    distinct, *tally = _sums(of_words, K + 2)
    discount = discounts(tally)
    freed = float(sum((1 - discount[r]) * r * tally[r - 1] for r in range(1, K + 1)))
    words = Words(n=n, distinct=distinct, n_docs=n_docs, buckets=buckets, discount=discount, freed=freed)
    del asked
    _let_go(spark)

    narrow = blocks.select("block", "sizes", "held", "words", "tokens")
    answers = of_words.where(F.col("kind") == ANSWER).select(F.col("target").alias("block"), "sender", "blobs")
    asked = narrow.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_ask_pairs(words), MESSAGE)
    of_pairs = _table(asked.groupBy("target").applyInArrow(_answer_pairs(words), MESSAGE), f"{path}/pairs")
    discount, hot = discounts(_sums(of_pairs, K + 1)), _hot_words(of_pairs)
    del asked
    _let_go(spark)

    more = of_pairs.where(F.col("kind") == ANSWER).select(F.col("target").alias("block"), "sender", "blobs")
    both = answers.withColumn("level", F.lit(0)).unionByName(more.withColumn("level", F.lit(1)))
    whole = blocks.select("block", "doc_ids", "sizes", "held", "words", "tokens")
    return whole.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_score(words, discount, hot), SCORES)


def _sums(messages: DataFrame, n: int) -> list[int]:
    """The tallies of all buckets together."""
    got = messages.where(F.col("kind") == TABLE).agg(*(F.sum(F.col("tally")[i]) for i in range(n))).first()
    return [x or 0 for x in got]
