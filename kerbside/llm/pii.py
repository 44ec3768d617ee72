"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Candidates are the base kinds' matches and spans of further kinds. Format, gazetteer, context, shape and edge labelers each
vote for, against or not at all. The corpus's counts of vote patterns (a few thousand at most, whatever its size) go through
expectation-maximisation, which estimates how each labeler votes on true and on false spans and so how likely each pattern
is to be personal data. A logistic span classifier learns those likelihoods from kind, votes, length and digits, and has the
last word on spans of the further kinds. Matches of the base kinds always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import beside, corpus, field, slices, unused

BASE = ("email", "ip", "card", "phone")
MORE = ("mail", "tel", "account", "id", "iban", "secret")

DIGIT = re.compile("[0-9]")
LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a start inside a run of digits fails or succeeds as the run's first digit does, so only that one is tried
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: A start inside a local part succeeds or fails as the part's first character does, so only that one is tried.
MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++"
                  r"(?:(?: ?(?:\[dot\]|\(dot\)) ?| \. |\.)[A-Za-z0-9-]++)++")
TEL = re.compile(r"(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b")
ACCOUNT = re.compile(r"(?<![0-9-])[0-9]{13,15}(?![0-9-])")
NUMBER = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b")
NAMED = re.compile(r"\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key) {0,3}[=:] {0,3}[\"']?([A-Za-z0-9_/+.-]{8,}+)", re.I)
HEX = re.compile(r"\b[0-9a-f]{32,}+\b")
CLOUD = re.compile(r"\bAKIA[0-9A-Z]{16}\b")
SECRET_NAMES = ("password", "passwd", "pwd", "token", "secret", "key")

#: Gazetteers: top-level domains, countries of account numbers, first digits of card issuers.
DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl ru cn jp br ca au ch se no pl eu us".split())
COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK TR".split())
CUES = {
    "email": ("mail", "contact", "write", "@"), "mail": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"), "account": ("card", "account", "amex", "payment"),
    "phone": ("call", "tel", "phone", "fax", "mobile"), "tel": ("call", "tel", "phone", "fax", "mobile"),
    "id": ("ssn", "social", "security", "id"), "iban": ("iban", "account", "bank"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "key", "=", ":"),
}
AGAINST = ("version", "isbn", "page", "chapter", "figure", "section", "$", "€", "£")
CONTEXT = 24
LABELERS = ("format", "gazetteer", "context", "shape", "edges", "against")

SCHEMA = ("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, "
          "n_more bigint, n_spans bigint")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the local part is all that may stand before an @, back to the last match; time is linear."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at - LOCAL_BACK.match(text[low:at][::-1]).end()
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        low = domain.end() if domain else at + 1
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def more_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates of the further kinds."""
    out = []
    if "at]" in text or "at)" in text:
        out += [("mail", *m.span()) for m in MAIL.finditer(text)]
    if DIGIT.search(text):
        out += [("tel", *m.span()) for m in TEL.finditer(text)]
        out += [("account", *m.span()) for m in ACCOUNT.finditer(text)]
        out += [("id", *m.span()) for m in NUMBER.finditer(text)]
        out += [("iban", *m.span()) for m in IBAN.finditer(text)]
        out += [("secret", *m.span()) for m in HEX.finditer(text)]
        if "AKIA" in text:
            out += [("secret", *m.span()) for m in CLOUD.finditer(text)]
    if "=" in text or ":" in text:
        lower = text.lower()
        if any(n in lower for n in SECRET_NAMES):
            out += [("secret", *m.span(1)) for m in NAMED.finditer(text)]
    return out


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """1, 0 or -1 of each labeler."""
    span, before = text[start:end], text[max(0, start - CONTEXT):start].lower()
    digits = "".join(c for c in span if c in "0123456789")
    form = {"ip": all(p == "0" or not p.startswith("0") for p in span.split(".")),
            "email": span.rpartition(".")[2].isalpha(), "mail": span.rstrip().rpartition(".")[2].rpartition(" ")[2].isalpha(),
            "card": len(digits) == 16, "account": bool(digits) and luhn(digits), "phone": 10 <= len(digits) <= 13, "tel": len(digits) == 10,
            "id": not span.startswith(("000", "666", "9")) and "-00-" not in span and not span.endswith("0000"),
            "iban": 15 <= len(span) <= 34 and any(c.isalpha() or c in "0123456789" for c in span[4:]),
            "secret": any(c in "0123456789" for c in span) and any(c.isalpha() for c in span)}[kind]
    known = 0
    if kind in ("email", "mail"):
        known = 1 if re.split(r"[^a-z]+", span.lower())[-1] in DOMAINS else -1
    elif kind in ("card", "account"):
        known = 1 if digits[:1] in ("3", "4", "5", "6") else -1
    elif kind == "iban":
        known = 1 if span[:2] in COUNTRIES else -1
    elif kind == "secret":
        known = 1 if span.startswith("AKIA") or any(n in before for n in SECRET_NAMES) else 0
    elif kind in ("phone", "tel"):
        known = -1 if digits[:1] == "0" else 1
    elif kind == "ip":
        known = -1 if span.startswith(("0.", "127.", "255.")) else 1
    cue = 1 if any(c in before for c in CUES[kind]) else 0
    shape = 1 if len(set(span.lower())) >= 5 else -1
    edge = -1 if text[start - 1:start].isalnum() or text[end:end + 1].isalnum() else 1
    against = -1 if any(c in before for c in AGAINST) else 0
    return (1 if form else -1, known, cue, shape, edge, against)


def pattern(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """What the classifier sees of a span: kind, votes, length and share of digits in a few steps."""
    span = text[start:end]
    share = sum(c in "0123456789" for c in span) / max(1, len(span))
    return ((BASE + MORE).index(kind), *votes(text, kind, start, end), min(7, (len(span) - 1).bit_length()), int(share * 4))


def _one_hot(patterns: np.ndarray) -> np.ndarray:
    parts = [np.eye(len(BASE + MORE))[patterns[:, 0]]]
    parts += [np.eye(3)[patterns[:, 1 + j] + 1] for j in range(len(LABELERS))]
    return np.hstack([*parts, np.eye(8)[patterns[:, -2]], np.eye(5)[patterns[:, -1]], np.ones((len(patterns), 1))])


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: the chance that each is personal data, and P(vote | true or false) of each labeler."""
    ballots, kinds = patterns[:, 1:1 + len(LABELERS)], patterns[:, 0]
    chance = 1 / (1 + np.exp(-ballots.sum(axis=1).astype(float)))
    table = np.zeros((2, len(LABELERS), 3))
    for _ in range(rounds):
        weight = np.stack([(1 - chance) * counts, chance * counts])
        for j in range(len(LABELERS)):
            for v in (-1, 0, 1):
                table[:, j, v + 1] = weight[:, ballots[:, j] == v].sum(axis=1) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        prior = np.zeros((2, len(BASE + MORE)))
        for z in (0, 1):
            prior[z] = np.bincount(kinds, weights=weight[z], minlength=len(BASE + MORE)) + (1.0, 2.0)[z]
        prior /= prior.sum(axis=0)
        logs = np.log(prior[:, kinds]) + sum(np.log(table[:, j][:, ballots[:, j] + 1]) for j in range(len(LABELERS)))
        chance = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return chance, table


@dataclass
class SpanClassifier:
    weights: np.ndarray | None

    def accepts(self, patterns: list[tuple[int, ...]]) -> list[bool]:
        if self.weights is None or not patterns:
            return [False] * len(patterns)
        return (_one_hot(np.array(patterns)) @ self.weights >= 0).tolist()


def train(counted: list[tuple[tuple[int, ...], int]]) -> SpanClassifier:
    """The span classifier from all vote patterns and how often each occurs."""
    if not counted:
        return SpanClassifier(None)
    counted = sorted(counted)
    patterns, counts = np.array([p for p, _ in counted]), np.array([n for _, n in counted], dtype=float)
    chance, _ = reliabilities(patterns, counts)
    x, share = _one_hot(patterns), counts / counts.sum()
    weights = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps of the penalised soft-label logistic loss
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share * (p - chance)) + 1e-4 * weights
        curve = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(len(weights))
        weights -= np.linalg.solve(curve, slope)
    return SpanClassifier(weights)


def learn(docs: DataFrame) -> SpanClassifier:
    """Count the vote patterns of all candidates in all texts, then train. Only the sums reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                counts.update(pattern(text, *s) for s in (*base_spans(text), *more_spans(text)))
        if counts:
            yield pa.record_batch([pa.array([",".join(map(str, p)) for p in counts]), pa.array(counts.values(), pa.int64())],
                                  names=["pattern", "n"])

    sums = corpus(docs).select("text").mapInArrow(run, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n")).collect()
    return train([(tuple(map(int, p.split(","))), n) for p, n in sums])


def find_spans(text: str, classifier: SpanClassifier) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and accepted spans of further kinds that touch neither a base span nor an earlier one."""
    base = base_spans(text)
    candidates = sorted(set(more_spans(text)), key=lambda s: (s[1], -s[2], MORE.index(s[0])))
    accepted = classifier.accepts([pattern(text, *s) for s in candidates])
    taken, more = sorted((a, b) for _, a, b in base), []
    for (kind, a, b), good in zip(candidates, accepted):
        if good and not any(a < y and x < b for x, y in taken):
            taken.append((a, b))
            more.append((kind, a, b))
    return base, sorted(more, key=lambda s: (MORE.index(s[0]), s[1]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, how many the method added, and how many there are.

    A missing text is empty. Two passes over the texts, no shuffle of texts: pattern counts, then spans.
    """
    classifier = learn(docs)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, more = find_spans(text, classifier)
                n = Counter(k for k, _, _ in base)
                rows.append((doc_id, *(n[k] for k in BASE), hashlib.sha256(written(base).encode()).hexdigest(),
                             written(base + more), len(more), len(base) + len(more)))
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)

    return corpus(docs).mapInArrow(run, SCHEMA)


def masked(text: str, classifier: SpanClassifier) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    base, more = find_spans(text, classifier)
    out, at, last = [], 0, None
    for kind, a, b in sorted(base + more, key=lambda s: (s[1], -s[2])):
        if last is not None and a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at, last = b, kind
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs with the spans in `text` masked and `n_chars`, where there is one, brought up to date; a missing text stays.

    A table without `text`, and an empty one, stays as it is; columns of any other name pass through.
    """
    if "text" not in docs.columns:
        return docs
    classifier, name = learn(docs), unused(docs, "masked")
    made = beside(docs, name, "string", lambda texts: [masked(t, classifier) for t in texts])
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    columns["text"] = F.when(F.col("text").isNotNull(), F.col(name))
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("text").isNotNull() & field(docs, "n_chars", "bigint").isNotNull(),
                                    F.char_length(name)).cast(docs.schema["n_chars"].dataType)
    return made.select(*(c.alias(name) for name, c in columns.items()))
