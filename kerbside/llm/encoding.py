"""Whole texts through the tokenizers library, with the ids of repeated units remembered.

In running text most of the time goes into words seen before. A text is cut before every space or line end that follows
another character; both vocabularies always end a piece there. They also end one between a letter or digit and a mark such as a
comma that follows it, so a text is cut there too, and `word`, `word,` and `word.` need the library once. Where a vocabulary
lower-cases and drops white space, as is found out by asking it, A-Z are lower-cased first. The units that a list of texts brings
for the first time go through the library together, parted by a special token, which it never joins with anything. Texts with other
white space, control or format characters, or what may be a special token go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units of a text in which white space characters stand together.
UNITS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Between a letter or digit (Latin ones, which every library knows, and only such as stay one when lower-cased) and a mark.
BEFORE_MARK = re.compile("(?<=[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f])(?=[.,;:!?])")
#: Begins a unit that no space stands before; never part of a text that is cut.
JOINED = "\x01"
#: Units that a worker remembers in each of two generations.
REMEMBERED = 500_000
#: Characters of the longest unit that is remembered.
LONGEST = 64
#: Characters that go through the library in one call.
TOGETHER = 20_000


class Encoder:
    """encode_all(texts): the ids of each as little-endian bytes, `width` bytes an id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else 4
        self.kind = "H" if self.width == 2 else "I"
        added = self.tokenizer.get_added_tokens_decoder()
        self.parted = next(((i, t.content) for i, t in sorted(added.items()) if t.special and not (t.lstrip or t.rstrip)), None)
        self.loose = self._ids("Ab\n  C") == self._ids("ab c")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        done: dict[str, bytes] = {}
        jobs: dict[str, list[str]] = {}
        for text in dict.fromkeys(texts):
            if "<|" in text or not text.replace("\n", "").isprintable():
                done[text] = self._ids(text)
            else:
                jobs[text] = self._units(text)
        long = self._learn(set().union(*jobs.values()))
        get = self.known.__getitem__
        for text, units in jobs.items():
            done[text] = b"".join(map(get, units))
        for unit in long:
            del self.known[unit]
        return [done[text] for text in texts]

    def _units(self, text: str) -> list[str]:
        if self.loose:
            low = text.encode().lower().decode()
            return BEFORE_MARK.sub(" ", low).replace("\n", " ").split(" ")
        flat = text.replace("\n", " \n")
        if "  " in flat or "\n " in flat:
            return [JOINED + u for u in UNITS.findall(text)]
        return (JOINED + BEFORE_MARK.sub(" " + JOINED, flat)).split(" ")

    def _asked(self, unit: str) -> str:
        """What the library is asked for a unit."""
        if self.loose or unit[:1] == "\n":
            return unit
        return unit[1:] if unit[:1] == JOINED else " " + unit

    def _learn(self, wanted: set[str]) -> list[str]:
        """Put the ids of all wanted units into `known`; returns those that are too long to stay there."""
        if len(self.known) > REMEMBERED:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = wanted - known.keys()
        held = new & old.keys()
        known.update((u, old[u]) for u in held)
        group, size, long = [], 0, []
        for unit in new - held:
            group.append(unit)
            size += len(unit)
            if len(unit) > LONGEST:
                long.append(unit)
            if size > TOGETHER:
                self._ask(group)
                group, size = [], 0
        self._ask(group)
        return long

    def _ask(self, units: list[str]) -> None:
        asked = list(map(self._asked, units))
        if self.parted is None or "" in asked:
            self.known.update((u, self._ids(a)) for u, a in zip(units, asked))
        elif units:
            mark, name = self.parted
            ids = np.array(self.tokenizer.encode_batch_fast([name.join(asked)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            ends = np.flatnonzero(ids == mark).tolist()
            width, packed = self.width, ids.tobytes()
            for unit, start, end in zip(units, [0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True):
                self.known[unit] = packed[start * width:end * width]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker."""
    return Encoder(path)
