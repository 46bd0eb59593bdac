"""Vector functions: JVM-side dot / cosine, and the default text encoder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """H4: dot product of two numeric arrays, in double precision."""
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """H5: ``1 - a.b / (|a| |b|)``."""
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


_WORD = re.compile(r"\w+", re.UNICODE)


# rows and characters of a batch that are encoded at once
_ENCODED_ROWS, _ENCODED_CHARS = 1024, 1 << 19


def _hash_embed_batch(texts: pd.Series, dim: int) -> pd.Series:
    """Vectors of a batch, made in slices: the lists of words are many times larger than their texts."""
    ends = np.cumsum([len(t) if isinstance(t, str) else 0 for t in texts], dtype=np.int64)
    out, at = [], 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + _ENCODED_CHARS, side="right")))
        stop = min(stop, at + _ENCODED_ROWS)
        out.extend(_hash_embed_slice(texts.iloc[at:stop], dim))
        at = stop
    return pd.Series(out, dtype=object)


def _hash_embed_slice(texts: pd.Series, dim: int) -> list:
    """Signed hashed bag of words for a batch: one regex pass per text, then one MD5 of each distinct word (its first 32
    bits choose the cell, the next one the sign) and one ``bincount`` into ``rows x dim`` cells."""
    words, owner = [], []
    valid = texts.notna().to_numpy()
    for i, t in enumerate(texts):
        if t is not None and t == t:
            w = _WORD.findall(t.lower())
            words.extend(w)
            owner.extend([i] * len(w))
    n = len(texts)
    mat = np.zeros((n, dim), dtype=np.float64)
    if words:
        which, distinct = pd.factorize(np.asarray(words, dtype=object))
        h = np.frombuffer(b"".join(hashlib.md5(w.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:8] for w in distinct), ">u4").reshape(-1, 2)
        bucket = (h[:, 0].astype(np.int64) % dim)[which]
        sign = np.where(h[:, 1] >> 31 == 0, 1.0, -1.0)[which]
        cells = np.asarray(owner, dtype=np.int64) * dim + bucket
        mat = np.bincount(cells, weights=sign, minlength=n * dim).reshape(n, dim)
    norms = np.linalg.norm(mat, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        mat = np.where(norms > 0, mat / norms, mat).astype(np.float32)
    return [mat[i] if valid[i] else None for i in range(n)]


def hash_encoder(dim: int = 64):
    """K2 default encoder: signed hashed bag of words, unit norm, as an Arrow-batched UDF.

    A real sentence model plugs in the same way (load once per worker in an
    iterator pandas UDF); this one keeps tests deterministic and offline.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _encode(texts: pd.Series) -> pd.Series:
        return _hash_embed_batch(texts, dim)

    return _encode


def _encode_rows(model, texts: list[str], dim: int) -> list:
    """Vectors of a batch; a failing batch is halved until the failing texts stand alone: they get None."""
    try:
        return list(np.asarray(model.encode(texts), dtype=np.float32).reshape(len(texts), dim))
    except Exception:  # noqa: BLE001 - a failing row has no vector and takes the embedding fallback
        if len(texts) == 1:
            return [None]
    half = len(texts) // 2
    return _encode_rows(model, texts[:half], dim) + _encode_rows(model, texts[half:], dim)


def model_encoder(factory, dim: int):
    """K2 plug point for a real sentence model: ``factory()`` builds an object with
    ``encode(list[str]) -> array (n, dim)``; it is called once per task (iterator pandas
    UDF), then every Arrow batch of the partition is encoded with it. A text that the model
    fails on gets a null vector; the other rows are not affected."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            valid = texts.notna().to_numpy()
            out = [None] * len(texts)
            if valid.any():
                vecs = _encode_rows(model, texts[valid].tolist(), dim)
                for j, i in enumerate(np.flatnonzero(valid)):
                    out[i] = vecs[j]
            yield pd.Series(out)

    return _encode
