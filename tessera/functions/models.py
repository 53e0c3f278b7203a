"""Pluggable models. The defaults need no network: a hashing embedder and no language model."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
LanguageModel = Callable[[list[str]], list[str]]


def hashing_embedder(dimension: int = 64) -> Embedder:
    """Signed counts of character trigrams by hash, scaled to length 1: alike words get alike vectors, in every process."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimension
            padded = f"  {text} "
            for i in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "little")
                v[h % dimension] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def prefixed(embedder: Embedder, instruction: str) -> Embedder:
    """For models that embed queries otherwise than documents."""
    return lambda texts: embedder([f"{instruction}{t}" for t in texts])


EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hashing": hashing_embedder}
LANGUAGE_MODELS: dict[str, Callable[..., LanguageModel]] = {}


def build(registry: dict, name: str, **options):
    """A registered model by name; an unknown name is an error."""
    if name not in registry:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(registry)) or 'none'}")
    return registry[name](**options)


def embed_column(text: Column, embedder: Embedder) -> Column:
    """Vectors of a text column, a batch of rows at a time. A null text has none."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = iter(embedder([t for t in texts if t is not None]))
            yield pd.Series([None if t is None else next(vectors) for t in texts])

    return run(text)
