"""Licence scan by a positional index of rare licence words.

Templates are short word sequences with a key phrase that must stand in full. The rarer a licence word is in the corpus,
the higher its IDF. In each file the key phrase's rarest words are looked up first: every place of the rarest one raises a
possible start, and the places of the next words, moved by their positions in the template, are intersected with it until
the whole key phrase is verified. The rest of the template around a verified phrase gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import corpus, slices

#: Bytes that separate words become a space, A-Z become a-z: words are runs of 0-9, a-z and all beyond ASCII.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Template:
    """Words before the key phrase, the key phrase, words after it. base: one of the phrases that the counts are about."""

    label: str
    before: str
    key: str
    after: str
    base: bool = False


#: The base phrases with their labels, then phrases of other well-known licences.
TEMPLATES = (
    Template("mit", "released", "under the mit license", "", base=True),
    Template("apache-2", "licensed under the", "apache license version 2", "0", base=True),
    Template("cc-by-nc", "licensed under", "cc by nc", "4 0", base=True),
    Template("gpl-3", "licensed under the", "gnu general public license version 3", ""),
    Template("gpl-2", "licensed under the", "gnu general public license version 2", ""),
    Template("lgpl", "under the terms of the", "gnu lesser general public license", ""),
    Template("agpl", "under the terms of the", "gnu affero general public license", ""),
    Template("mpl-2", "subject to the terms of the", "mozilla public license", "v 2 0"),
    Template("bsd", "redistribution and use in source and binary forms", "with or without modification are permitted", "provided"),
    Template("mit", "permission is hereby granted", "free of charge to any person obtaining a copy", "of this software"),
    Template("isc", "", "permission to use copy modify and or distribute this software", "for any purpose"),
    Template("unlicense", "this is", "free and unencumbered software released into the public domain", ""),
    Template("cc-by-sa", "licensed under", "cc by sa", "4 0"),
    Template("cc0", "", "creative commons zero", "v1 0 universal"),
)

SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
          "labels string, score double, places array<struct<label:string,word:bigint,score:double>>")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def vocabulary(templates=TEMPLATES) -> list[bytes]:
    return sorted({w.encode() for t in templates for part in (t.before, t.key, t.after) for w in part.split()})


class Index:
    """Postings of the templates' words, and the words' IDF."""

    def __init__(self, idf: dict[bytes, float], templates=TEMPLATES):
        self.idf, self.templates = idf, templates
        self.keys, self.rest, self.anchors = [], [], {}
        for i, t in enumerate(templates):
            key = [w.encode() for w in t.key.split()]
            before, after = [w.encode() for w in t.before.split()], [w.encode() for w in t.after.split()]
            self.keys.append(sorted(enumerate(key), key=lambda p: (-idf[p[1]], p[0])))
            self.rest.append([(j - len(before), w) for j, w in enumerate(before)] + [(j + len(key), w) for j, w in enumerate(after)])
            self.anchors.setdefault(self.keys[-1][0][1], []).append(i)
        self.all = frozenset(vocabulary(templates))

    def places(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, word at which its key phrase starts, score) of every key phrase in full."""
        present = {w for w in self.anchors if w in words} if len(words) < 8 else self.anchors.keys() & set(words)
        if not present:
            return []
        at: dict[bytes, set[int]] = {}
        for i, w in enumerate(words):
            if w in self.all:
                at.setdefault(w, set()).add(i)
        found = []
        for anchor in sorted(present, key=lambda w: (-self.idf[w], w)):
            for t in self.anchors[anchor]:
                starts = None
                for offset, w in self.keys[t]:
                    here = {p - offset for p in at.get(w, ())}
                    starts = here if starts is None else starts & here
                    if not starts:
                        break
                for start in sorted(starts):
                    has = need = sum(self.idf[w] for _, w in self.keys[t])
                    for offset, w in self.rest[t]:
                        need += self.idf[w]
                        has += self.idf[w] if start + offset in at.get(w, ()) else 0.0
                    found.append((t, start, has / need if need else 1.0))
        return found


def word_frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, and how many documents there are: counted over all of them."""
    known = frozenset(vocabulary(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                counts.update(known.intersection(words_of(text)))
            n += batch.num_rows
        yield pa.record_batch([pa.array(["", *(w.decode() for w in counts)]), pa.array([n, *counts.values()], pa.int64())],
                              names=["word", "n"])

    sums = corpus(docs).select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n")).collect()
    found = {w.encode(): n for w, n in sums}
    return found, found.pop(b"", 0)


def scan_licences(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document: word count, base phrases (all places), labels, score, and every place found.

    first_word and last_word are the smallest and largest start of a base phrase, null without one; score is the largest
    share, by IDF, of a template's words that stand around its verified phrase (0 without one). A missing text is empty.
    Two passes over the texts: one counts the templates' words (a few dozen sums reach the driver), one scans. No shuffle of
    texts, and each text is looked at by itself.
    """
    frequency, n = word_frequencies(docs, templates)
    idf = {w: math.log((n + 1) / (frequency.get(w, 0) + 1)) + 1.0 for w in vocabulary(templates)}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(),
             pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("score", pa.float64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf, templates)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                found = index.places(words)
                base = [(t, start) for t, start, _ in found if templates[t].base]
                starts = [start for _, start in base]
                rows.append((
                    doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({templates[t].label for t, _ in base})), ",".join(sorted({templates[t].label for t, _, _ in found})),
                    round(max((s for _, _, s in found), default=0.0), 6),
                    [{"label": templates[t].label, "word": start, "score": round(s, 6)} for t, start, s in sorted(found, key=lambda f: f[1::-1])]))
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)

    return corpus(docs).mapInArrow(run, SCHEMA)
