"""Pluggable models as pandas UDFs; the defaults are deterministic and need no files."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

DIMS = 64
# Types as objects: a type in words needs a session, which a worker has not.
NAME = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType())])


def hash_vector(text: str | None, dims: int = DIMS) -> list[float] | None:
    """Signed feature hashing of words and word pairs, of unit length; null for texts without words."""
    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return None
    v = np.zeros(dims)
    for gram in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
        h = zlib.crc32(gram.encode())
        v[h % dims] += 1 if h & 0x80000000 else -1
    n = float(np.linalg.norm(v))
    return [float(x) for x in (v / n if n else v).astype(np.float32)]


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(text: pd.Series) -> pd.Series:
    return pd.Series(hash_vectors(text))


def hash_vectors(texts: pd.Series, dims: int = DIMS) -> list[np.ndarray | None]:
    """``hash_vector`` of a whole batch: words and word pairs are hashed once each and summed up together."""
    grams, rows = [], []
    for i, t in enumerate(texts):
        words = re.findall(r"\w+", (t or "").lower())
        own = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        grams += own
        rows += [i] * len(own)
    out: list[np.ndarray | None] = [None] * len(texts)
    if grams:
        code, names = pd.factorize(np.array(grams, object))
        h = np.array([zlib.crc32(g.encode()) for g in names], np.int64)[code]
        total = np.bincount(np.array(rows) * dims + h % dims, np.where(h & 0x80000000, 1.0, -1.0), len(texts) * dims).reshape(-1, dims)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        total = (total / np.where(size > 0, size, 1)).astype(np.float32)
        for i in set(rows):
            out[i] = total[i]
    return out


@F.pandas_udf(T.DoubleType())
def rerank(query: pd.Series, text: pd.Series) -> pd.Series:
    """Share of the query's words that the text holds; the default cross-encoder."""
    q = [set(re.findall(r"\w+", (x or "").lower())) for x in query]
    t = [set(re.findall(r"\w+", (x or "").lower())) for x in text]
    return pd.Series([len(a & b) / len(a) if a else 0.0 for a, b in zip(q, t)])


@F.pandas_udf(T.ArrayType(NAME))
def tag_names(text: pd.Series) -> pd.Series:
    """Names as runs of capitalised words: two or more are persons, one after ``the`` a place."""
    out = []
    for t in text:
        found = []
        for m in re.finditer(r"(?:\b[A-ZÀ-Ý][\wÀ-ÿ'’]+(?: |$))*\b[A-ZÀ-Ý][\wÀ-ÿ'’]+", t or ""):
            words = m.group().split()
            if len(words) > 1:
                found.append({"text": m.group(), "label": "PER", "start": m.start()})
            elif m.start() >= 4 and t[m.start() - 4 : m.start()].lower() == "the ":
                found.append({"text": m.group(), "label": "LOC", "start": m.start()})
        out.append(found)
    return pd.Series(out)
