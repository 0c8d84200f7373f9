"""Models from outside: embedders and generators, with stand-ins that need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, prompt: str, system: str, context: str) -> str: ...


class HashEmbedder:
    """Words hashed into a unit vector; the same on every machine."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for i, text in enumerate(texts):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.size] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


class EchoGenerator:
    def generate(self, prompt: str, system: str, context: str) -> str:
        return f"{context[:200]} [1]"


def embedded(text: Column, embedder: Embedder, batch: int = 16) -> Column:
    """A model is loaded once for each worker and called on batches."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in embedder.embed(texts[i : i + batch])])

    return run(text)
