"""Text to vectors. No neural model is at hand: the default embedder hashes words into a fixed number of signed places."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dimension: int = 64) -> Embedder:
    """Each word adds 1 or -1 at a place that its hash gives; vectors have length 1, or 0 without words."""
    from zlib import crc32

    def embed(texts: list[str]) -> np.ndarray:
        # Words are hashed once each; sums are made for all texts at once.
        split = [text.lower().split() for text in texts]
        hashes = {w: crc32(w.encode()) for w in set().union(*split)}
        h = np.fromiter((hashes[w] for words in split for w in words), np.int64)
        row = np.repeat(np.arange(len(split)), [len(words) for words in split])
        signs = np.where(h >> 16 & 1, 1.0, -1.0)
        out = np.bincount(row * dimension + h % dimension, signs, len(split) * dimension).reshape(len(split), dimension).astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


def with_retry(f: Callable, tries: int = 3, wait: float = 0.1, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """f, called again after a failure, with doubled waits; the last failure is raised."""

    def call(*args):
        delay = wait
        for i in range(tries):
            try:
                return f(*args)
            except Exception:
                if i == tries - 1:
                    raise
                sleep(delay)
                delay *= 2

    return call


def embed(text: Column, embedder: Embedder | None = None, dimension: int = 64) -> Column:
    """array<float> of every text, in Arrow batches; null for null. A provider with a service goes in as the embedder."""
    run = with_retry(embedder or hashing_embedder(dimension))

    @F.pandas_udf("array<float>")
    def make(texts: pd.Series) -> pd.Series:
        vectors = run(texts.fillna("").tolist())
        return pd.Series([None if t is None else v for t, v in zip(texts, vectors, strict=True)])

    return make(text)
