"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between them of a text, hashed into 2**18 places.
Every coordinate has its own learning rate, and L1 keeps coordinates at exactly zero until evidence adds up, so the
model is a short list of places and weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import ALNUM, LOWER, Words, discard, hash_sample, materialise, mix, slices, small, text_bytes

PLACES = 1 << 18
#: Words that a worker turns into features at once.
BLOCK_WORDS = 1 << 19
#: Labelled rows of the training sample.
TRAIN_ROWS = 12_000
#: Bytes of their texts.
TRAIN_BYTES = 64 << 20


def feature_places(words: Words, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of each feature that starts at the words lo .. hi of a slice, with repeats."""
    end = min(hi + 2, len(words.hashes))
    h, text = words.hashes[lo:end], np.searchsorted(words.first, np.arange(lo, end), "right") - 1
    parts = [(text[: hi - lo], h[: hi - lo])]
    for gap, salt in ((1, 0x51ED2701), (2, 0x7A3B9C05)):
        n = min(hi - lo, len(h) - gap)
        whole = text[gap : gap + n] == text[:n] if n > 0 else np.zeros(0, bool)
        if whole.any():
            parts.append((text[:n][whole], mix(h[:n] * np.uint64(3) + h[gap : gap + n] + np.uint64(salt))[whole]))
    return np.concatenate([t for t, _ in parts]), (np.concatenate([x for _, x in parts]) >> np.uint64(64 - 18)).astype(np.int64)


def distinct_features(batch: pa.RecordBatch, wanted: np.ndarray | None = None) -> np.ndarray:
    """text * PLACES + place of each distinct feature of a slice, sorted; of the wanted places alone, if given. Works block by block of words."""
    words, out = Words(*text_bytes(batch.column("text")), ALNUM, LOWER), np.zeros(0, np.int64)
    for lo in range(0, len(words.hashes), BLOCK_WORDS):
        text, place = feature_places(words, lo, min(lo + BLOCK_WORDS, len(words.hashes)))
        keep = slice(None) if wanted is None else wanted[place]
        out = np.union1d(out, text[keep] * PLACES + place[keep])
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        pair = distinct_features(batch)
        bounds = np.searchsorted(pair, np.arange(batch.num_rows + 1) * PLACES)
        x = (pair % PLACES).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())], names=["label", "x"])


@dataclass
class Ftrl:
    """FTRL-proximal state. weights are zero where |z| stays within L1. Positives, which are rare, weigh more."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.0
    positive: float = 2.0

    def train(self, rows: list[tuple[int, np.ndarray]], epochs: int = 12, seed: int = 5) -> np.ndarray:
        """rows: (label, places). The last place of the returned weights is the bias, which L1 leaves alone."""
        z, n, w = np.zeros(PLACES + 1), np.zeros(PLACES + 1), np.zeros(PLACES + 1)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                label, x = rows[k]
                x = np.append(x, PLACES)
                zx, nx = z[x], n[x]
                l1 = np.full(len(x), self.l1)
                l1[-1] = 0
                wx = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((self.beta + np.sqrt(nx)) / self.alpha + self.l2))
                p = 1 / (1 + np.exp(-np.clip(wx.sum(), -35, 35)))
                g = (p - label) * (self.positive if label else 1.0)
                sigma = (np.sqrt(nx + g * g) - np.sqrt(nx)) / self.alpha
                z[x] = zx + g - sigma * wx
                n[x] = nx + g * g
        l1 = np.full(PLACES + 1, self.l1)
        l1[-1] = 0
        w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))
        return w.astype(np.float32)


def train_toxicity(
    df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES
) -> np.ndarray:
    """Weights from the labelled rows where `learn` holds: those of smallest id hash, `rows` rows and most_bytes of text of them at most.

    Ids may be of any type. Texts that share an id share its label, rows that repeat id and text count once; an id with
    two labels teaches both.
    """
    marked = labels_sample(labels, learn, id_col, label_col, rows)
    joined = materialise(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small(marked), "id"))
    sample = hash_sample(joined, "id", rows, "text", most_bytes).select("label", "text")
    got = sorted((r.label, r.x) for r in sample.mapInArrow(_features, "label int, x binary").collect())  # eight bytes a word of the sample at most
    discard(joined, marked)
    return Ftrl().train([(label, np.frombuffer(x, np.int32)) for label, x in got])


def labels_sample(labels: DataFrame, learn: Column, id_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, label) of labelled rows where learn holds, a written table of `rows` rows at most."""
    marked = labels.where(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    return materialise(hash_sample(marked, "id", rows))


def _score(batches: Iterator[pa.RecordBatch], places: np.ndarray, weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    dense = np.zeros(PLACES, np.float32)
    dense[places] = weights
    used = dense != 0
    for batch in slices(batches):
        pair = distinct_features(batch, used)
        z = np.bincount(pair // PLACES, dense[pair % PLACES], batch.num_rows) + bias
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], names=["id", "score"])


def score_toxicity(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score (0 to 1, higher: toxic likelier).

    Null and empty texts get the model's bias. Every row gives one row, so repeated rows and null ids stay. Other
    columns don't matter; an empty table gives an empty result, and without labelled rows every score is 0.5.
    """
    places, bias = np.flatnonzero(weights[:-1]).astype(np.int32), float(weights[-1])
    kept = weights[places]
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(lambda b: _score(b, places, kept, bias), f"id {dict(docs.dtypes)['id']}, score double").withColumnRenamed("id", id_col)
