"""Words of whole texts as numbers, some documents at a time, for operators that work on UTF-8 bytes in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are numbered together; a longer text comes alone.
TOGETHER = 1 << 20


@dataclass
class Words:
    """Some rows of a batch. bytes.split() parts at white space in ASCII, which is x20 and x09 to x0D: the words of the contract."""

    rows: pa.RecordBatch
    texts: list[bytes]

    @cached_property
    def lists(self) -> list[list[bytes]]:
        return [t.split() for t in self.texts]

    @cached_property
    def bounds(self) -> np.ndarray:
        """Where the words of each text begin among those of all, and their end."""
        return np.concatenate([[0], np.cumsum([len(w) for w in self.lists], dtype=np.int64)])

    @cached_property
    def ids(self) -> np.ndarray:
        """A number for each word: within a text equal words have equal numbers; no number is in two texts."""
        parts, base = [], 0
        for words in self.lists:
            index = {w: k for k, w in enumerate(dict.fromkeys(words), base)}
            parts.append(map(index.__getitem__, words))
            base += len(index)
        return np.fromiter(chain.from_iterable(parts), np.int64, int(self.bounds[-1]))


def word_groups(batches, column: str = "text") -> Iterator[Words]:
    """Arrow batches as groups of rows of about TOGETHER bytes of text; a null text is empty."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
        at, held = 0, 0
        for k, t in enumerate(texts):
            if k > at and held + len(t) > TOGETHER:
                yield Words(batch.slice(at, k - at), texts[at:k])
                at, held = k, 0
            held += len(t)
        if len(texts) > at:
            yield Words(batch.slice(at), texts[at:])
