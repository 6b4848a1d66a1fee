"""Vector functions over arrays of numbers."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.udf import arrow_udf


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null where either vector is null or zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def encode_text(text: str, width: int = 384) -> np.ndarray:
    """A deterministic stand-in for an embedding model: signed hashed words, at unit length."""
    out = np.zeros(width)
    for word in (text or "").lower().split():
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        out[h % width] += 1 if h >> 63 else -1
    n = np.linalg.norm(out)
    return out / n if n else out


def encoder(width: int = 384):
    """encode_text() as a vectorised column function; null text gives a null vector."""

    @arrow_udf("array<float>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else encode_text(t, width).astype("float32"))

    return run


def preflight(encode, width: int = 384) -> None:
    """Fail early if an encoder's vectors have another length."""
    got = len(encode("test"))
    if got != width:
        raise ValueError(f"the encoder gives {got} numbers, not {width}")
