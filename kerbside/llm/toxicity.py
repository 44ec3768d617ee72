"""Toxicity by subword bags: character n-gram embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character n-grams and of itself, all hashed into one table; a window of a few
words (a short last one counts as padded) is the average of its words, and a softmax over two classes reads it. A misspelt word shares most n-grams with the
word it stands for. Labels are for documents, so training looks for the windows that carry them: clean documents' windows are
all clean, and of a toxic document first every window counts a little, then the most toxic one and those already found toxic.
A document's score is that of its most toxic window, wherever it starts, so one insult in a long text is not averaged away.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import beside, field, unused

WORD = re.compile(r"[^\s.,;:!?|()\[\]\"]+")
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 8
WINDOW = 8
#: Labelled rows of each class that a model is fitted on at most, taken by a hash of doc_id.
SAMPLE = 3000
#: Windows in a batch at most; few windows are dealt into smaller ones, so that an epoch has at least about STEPS.
EPOCHS, BATCH, STEPS, RATE = 8, 4096, 40, 0.02
#: Weights that a worker remembers by word.
REMEMBERED = 1_000_000


def words_of(text: str) -> list[str]:
    """The words, of which repetitions in a row count once."""
    return [w for w, _ in groupby(WORD.findall(text.lower()))]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words' subwords, and the word that each belongs to."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    word = np.repeat(np.arange(len(words)), lengths)
    ids, owners = [], []

    def put(hashes: np.ndarray, owner: np.ndarray) -> None:
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        ids.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(owner)

    for n in GRAMS:
        if len(codes) < n:
            continue
        inside = word[n - 1:] == word[:len(word) - n + 1]
        h = np.full(int(inside.sum()), n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(1000003) + codes[k:len(codes) - n + 1 + k][inside]
        put(h, word[:len(word) - n + 1][inside])
    place = (np.arange(len(codes)) - starts[word]).astype(np.uint64)
    put(np.add.reduceat((codes + place * np.uint64(0x9E3779B9)) * (np.uint64(2) * place + np.uint64(0x85EBCA6B)), starts), np.arange(len(words)))
    return np.concatenate(ids), np.concatenate(owners)


@dataclass
class Model:
    """`weights`: what a subword adds to the toxic class's logit over the clean one's; `bias`: the same for every window."""

    weights: np.ndarray | None
    bias: float = 0.0

    def of_words(self, words: list[str]) -> np.ndarray:
        ids, owner = subwords(words)
        n = np.bincount(owner, minlength=len(words))
        return np.bincount(owner, weights=self.weights[ids], minlength=len(words)) / np.maximum(n, 1)

    def scores(self, texts: list[str], known: dict[str, float] | None = None) -> np.ndarray:
        """0 to 1 for each whole text: the softmax probability of its most toxic window. Without labels to learn from: 0."""
        if self.weights is None:
            return np.zeros(len(texts))
        known = {} if known is None else known
        if len(known) > REMEMBERED:
            known.clear()
        split = [words_of(t) for t in texts]
        new = list(set().union(*split) - known.keys())
        for at in range(0, len(new), 100_000):
            part = new[at:at + 100_000]
            known.update(zip(part, self.of_words(part).tolist()))
        return self.of_windows([most_toxic(np.fromiter(map(known.__getitem__, words), np.float64, len(words))) for words in split])

    def of_windows(self, most: list[float]) -> np.ndarray:
        out = np.array(most)
        return 1.0 / (1.0 + np.exp(-np.clip(np.where(np.isneginf(out), 0.0, out) + self.bias, -60, 60)))


def numbered(texts: Iterable[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words, all words by number, and how many each text has. No text is kept."""
    names: dict[str, int] = {}
    parts = [np.array([names.setdefault(w, len(names)) for w in words_of(t)], np.int32) for t in texts]
    return list(names), np.concatenate([np.empty(0, np.int32), *parts]), np.array([len(p) for p in parts], np.int64)


def fit(texts: Iterable[str], toxic: list[int], seed: int = 0) -> Model:
    """Train embeddings and softmax together on labelled texts. Every fifth text only sets the point where a score is 0.5.

    Texts are read once, one by one. What is held are the distinct words' subwords, word numbers and one vector per bucket.
    """
    if len(set(toxic)) < 2:
        return Model(None)
    listed, flat, lengths = numbered(texts)
    parts, sizes_of = [], []
    for at in range(0, len(listed), 20_000):  # the hashing needs far more room than its result
        ids, owner = subwords(listed[at:at + 20_000])
        parts.append(ids[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes_of.append(np.bincount(owner))
    if not parts:
        return Model(None)
    ids, first = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes_of))])
    begins, windows = np.cumsum(lengths) - lengths, -(-lengths // WINDOW)
    doc = np.repeat(np.arange(len(lengths)), windows)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    sizes = np.minimum(WINDOW, lengths[doc] - WINDOW * place)
    starts = np.append(begins[doc] + WINDOW * place, len(flat))
    label = np.asarray(toxic)
    is_toxic, aside = label[doc] == 1, doc % 5 == 4

    rng = np.random.default_rng(seed)
    params = {"table": rng.normal(0, 0.1, (BUCKETS, DIM)), "softmax": rng.normal(0, 0.1, (DIM, 2)), "bias": np.zeros(2)}
    means, squares = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))

    def forward(chosen: np.ndarray):
        tokens = np.concatenate([flat[starts[c]:starts[c] + sizes[c]] for c in chosen.tolist()])
        bag = np.repeat(np.arange(len(chosen)), sizes[chosen])
        distinct, of = np.unique(tokens, return_inverse=True)
        counts = first[distinct + 1] - first[distinct]
        spans = np.concatenate([ids[a:b] for a, b in zip(first[distinct].tolist(), first[distinct + 1].tolist())])
        word = np.repeat(np.arange(len(distinct)), counts)
        vectors = np.add.reduceat(params["table"][spans], np.concatenate([[0], np.cumsum(counts)[:-1]])) / counts[:, None]
        edges = np.concatenate([[0], np.cumsum(sizes[chosen])[:-1]])
        mean = np.add.reduceat(vectors[of], edges) / WINDOW
        logits = mean @ params["softmax"] + params["bias"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), mean, (bag, of, len(distinct), counts, spans, word)

    def read(params: dict) -> tuple[np.ndarray, float]:
        """What each word adds to the toxic class's logit over the clean one's, and the bias."""
        bucket = params["table"] @ (params["softmax"][:, 1] - params["softmax"][:, 0])
        return np.add.reduceat(bucket[ids], first[:-1]) / np.diff(first), float(params["bias"][1] - params["bias"][0])

    learned = np.flatnonzero(~aside)
    chance = np.zeros(len(doc))
    step = 0
    for epoch in range(EPOCHS):
        positive = is_toxic.copy()
        if epoch >= 2:
            top = np.lexsort((chance, doc))
            best = np.zeros(len(doc), bool)
            best[top[np.concatenate([np.flatnonzero(np.diff(doc[top])), [len(top) - 1]])]] = True
            positive &= best | (chance > 0.9)
        use = learned[(positive | ~is_toxic)[learned]]
        n_pos = max(1, int(positive[use].sum()))
        weight = np.where(positive, min(8.0, max(1.0, (len(use) - n_pos) / n_pos)), 1.0)
        rng.shuffle(use)
        batch = max(64, min(BATCH, len(use) // STEPS))
        for at in range(0, len(use), batch):
            chosen = use[at:at + batch]
            p, mean, (bag, of, n_words, counts, spans, word) = forward(chosen)
            error = p.copy()
            error[np.arange(len(chosen)), positive[chosen].astype(int)] -= 1
            error *= (weight[chosen] / weight[chosen].sum())[:, None]
            up = (error @ params["softmax"].T) / WINDOW
            grad = {"softmax": mean.T @ error, "bias": error.sum(axis=0), "table": np.empty((BUCKETS, DIM))}
            for d in range(DIM):
                by_word = np.bincount(of, weights=up[bag, d], minlength=n_words) / counts
                grad["table"][:, d] = np.bincount(spans, weights=by_word[word], minlength=BUCKETS)
            step += 1
            for k, g in grad.items():
                means[k] += 0.1 * (g - means[k])
                squares[k] += 0.01 * (g * g - squares[k])
                params[k] -= RATE * (means[k] / (1 - 0.9 ** step)) / (np.sqrt(squares[k] / (1 - 0.99 ** step)) + 1e-8)
        weights, bias = read(params)
        upto = np.concatenate([[0.0], np.cumsum(weights[flat])])
        logit = (upto[starts[:-1] + sizes] - upto[starts[:-1]]) / WINDOW + bias
        chance = 1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60)))

    to = params["softmax"][:, 1] - params["softmax"][:, 0]
    model = Model((params["table"] @ to).astype(np.float64), float(params["bias"][1] - params["bias"][0]))
    kept = range(4, len(lengths), 5)
    values = read(params)[0]
    scores = model.of_windows([most_toxic(values[flat[begins[i]:begins[i] + lengths[i]]]) for i in kept])
    model.bias += centre(scores, label[list(kept)])
    return model


def most_toxic(values: np.ndarray) -> float:
    """The mean of the most toxic window, given the words' weights in order; a text shorter than a window counts as padded."""
    if not len(values):
        return -np.inf
    upto, n = np.concatenate([[0.0], np.cumsum(values)]), min(WINDOW, len(values))
    return float((upto[n:] - upto[:-n]).max() / WINDOW)


def centre(scores: np.ndarray, label: np.ndarray) -> float:
    """What to add to the logits so that 0.5 parts the classes best; in the middle of the gap."""
    if len(set(label.tolist())) < 2:
        return 0.0
    s = np.clip(scores, 1e-15, 1 - 1e-15)
    logit, order = np.log(s / (1 - s)), np.argsort(s, kind="stable")
    logit, y = logit[order], label[order]
    wrong = np.concatenate([[(y == 0).sum()], (y == 0).sum() - np.cumsum(y == 0) + np.cumsum(y == 1)])
    at = int(np.flatnonzero(wrong == wrong.min())[-1])
    low = logit[at - 1] if at else logit[0] - 2
    high = logit[at] if at < len(logit) else logit[-1] + 2
    return -float(low + (high - low) / 2)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled documents of each class, none of them held out.

    Which ones, a hash of doc_id says; their texts meet in one task, the driver gets their ids and the weights. Rows without a
    label or doc_id teach nothing.
    """
    seen = labels.select(field(labels, "doc_id", "bigint"), field(labels, "toxic", "int")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    one = seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(field(docs, "doc_id", "bigint"), field(docs, "text", "string"))
    known = texts.select("doc_id").join(one, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = [r for t in (0, 1) for r in known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not rows:
        return Model(None)
    chosen = F.broadcast(docs.sparkSession.createDataFrame(rows, "doc_id bigint, toxic int"))  # at most 2 x sample rows
    got = texts.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    trained = got.groupBy(F.lit(0).alias("all")).applyInArrow(_train, "weights binary, bias double").first()
    return Model(None if trained["weights"] is None else np.frombuffer(trained["weights"]), trained["bias"])


def _train(sample: pa.Table) -> pa.Table:
    """The model of the sample, in one task; only its weights go to the driver."""
    doc_ids = sample.column("doc_id").to_pylist()
    order = sorted(range(len(doc_ids)), key=lambda i: doc_ids[i] * 0x9E3779B97F4A7C15 % 2 ** 64)
    text, toxic = sample.column("text"), sample.column("toxic").to_pylist()
    model = fit((text[i].as_py() or "" for i in order), [toxic[i] for i in order])
    return pa.table({"weights": pa.array([None if model.weights is None else model.weights.tobytes()], pa.binary()),
                     "bias": pa.array([model.bias], pa.float64())})


def scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs with the score of every whole text beside its columns."""
    known: dict[str, float] = {}
    return beside(docs, name, "double", lambda texts: model.scores(texts, known).tolist())


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; a missing text scores as an empty one, below 0.5."""
    narrow = docs.select(field(docs, "doc_id", "bigint"), field(docs, "text", "string"))
    return scored(narrow, learn(docs, labels), "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with their own columns, whatever those are called. An empty table stays one; a
    missing or empty text is clean."""
    name = unused(docs, "toxicity")
    return scored(docs, learn(docs, labels), name).where(F.col(name) < 0.5).drop(name)
