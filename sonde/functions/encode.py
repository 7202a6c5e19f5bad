"""Encoders: any object with ``encode(texts) -> matrices``, made once per Python worker, fed by Arrow batches of distinct texts."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Word vectors a HashingEncoder keeps, and letters whose matrices are handed over at a time.
KNOWN_WORDS, GROUP_CHARS = 100_000, 400_000


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list: ...


class HashingEncoder:
    """A model-free encoder: each word a fixed pseudo-random unit vector.

    A matrix is cut and padded with zero vectors to ``tokens`` rows; with None it has a row for each word.
    """

    def __init__(self, dim: int = 16, tokens: int | None = 32):
        self.dim, self.tokens = dim, tokens
        self.known: dict[str, np.ndarray] = {}

    def vector(self, word: str) -> np.ndarray:
        v = self.known.get(word)
        if v is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            v = np.random.default_rng(zlib.crc32(word.encode())).standard_normal(self.dim)
            v = self.known[word] = (v / np.linalg.norm(v)).astype(np.float32)
        return v

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            words = text.split()[: self.tokens]
            m = np.zeros((len(words) if self.tokens is None else self.tokens, self.dim), np.float32)
            for i, w in enumerate(words):
                m[i] = self.vector(w)
            out.append(m)
        return out


def groups(contents: list[str]) -> Iterator[list[str]]:
    """Texts in groups of at most GROUP_CHARS letters, or of one text."""
    group, chars = [], 0
    for c in contents:
        if group and chars + len(c) > GROUP_CHARS:
            yield group
            group, chars = [], 0
        group.append(c)
        chars += len(c)
    if group:
        yield group


def encode(docs: DataFrame, key: str, text: Column, make: Callable[[], Encoder], prefix: str = "", of: Callable[[np.ndarray], tuple] | None = None, schema: str = "matrix array<array<float>>") -> DataFrame:
    """key, matrix (array<array<float>>). Each distinct text is encoded once and handed to all its keys.

    With ``of``, key and the columns of ``schema`` that it makes of each whole matrix, which then stays in its worker.
    Texts are matched by a digest, so no shuffle sorts whole texts twice.
    """
    content = F.concat(F.lit(prefix), text)
    rows = docs.select(F.col(key), F.sha2(content, 256).alias("digest"), content.alias("content"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            for group in groups(b["content"].tolist()):
                made = [of(m) if of else (list(m),) for m in model.encode(group)]
                yield pd.DataFrame({"digest": [hashlib.sha256(t.encode()).hexdigest() for t in group]} | {n: [r[i] for r in made] for i, n in enumerate(names)})

    distinct = rows.groupBy("digest").agg(F.first("content").alias("content")).select("content").mapInPandas(run, f"digest string, {schema}")
    return rows.select(key, "digest").join(distinct, "digest").select(key, *names)


def rows_of(encoded: DataFrame, name: str = "rows") -> DataFrame:
    """One row for each struct of an encoded text's list."""
    return encoded.select(*[c for c in encoded.columns if c != name], F.inline(name))


def encode_vectors(docs: DataFrame, key: str, text: Column, make: Callable[[], Encoder]) -> DataFrame:
    """key, pos, embedding: the vectors of a text's places, padding (zero vectors) too."""
    return rows_of(encode(docs, key, text, make, "", lambda m: ([{"pos": i, "embedding": v.tolist()} for i, v in enumerate(m)],), "rows array<struct<pos:int,embedding:array<double>>>"))


def encode_activations(docs: DataFrame, key: str, text: Column, make: Callable[[], Encoder]) -> DataFrame:
    """key, term, value of each activated term, also where its value is 0."""
    return rows_of(encode(docs, key, text, make, "", lambda a: ([{"term": int(t), "value": float(v)} for t, v in zip(a[0], a[1], strict=True)],), "rows array<struct<term:int,value:double>>"))


def encode_embedded(docs: DataFrame, key: str, text: Column, make: Callable[[], Encoder]) -> DataFrame:
    """key, token, value, embedding of each activated term."""
    of = lambda a: ([{"token": int(t), "value": float(v), "embedding": e.tolist()} for t, v, e in zip(*a, strict=True)],)
    return rows_of(encode(docs, key, text, make, "", of, "rows array<struct<token:int,value:double,embedding:array<double>>>"))
