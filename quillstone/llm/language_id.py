"""Language identification with error-correcting output codes.

Each language has a codeword; each bit of it is predicted by a binary logistic classifier over hashed byte n-grams.
Decoding is loss-weighted: a language's loss is the sum over bits of the logistic loss of its codeword's bit, weighted
by how well that bit's classifier did in training, and the language of least loss wins. A small gap between the best
two losses flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import ALNUM, LOWER, fresh, hash_sample, materialise, slices, small, text_bytes

BUCKETS = 1 << 12
ORDERS = (1, 2, 3, 4)
#: Documents of the training sample.
TRAIN_DOCS = 4000
#: Bytes of text of the training sample, and bytes that a worker turns into n-grams at once.
TRAIN_BYTES = 64 << 20
BLOCK_BYTES = 512 << 10
#: Gap of softmax shares below which a text is ambiguous.
AMBIGUOUS = 0.1
UNKNOWN = "und"

_FOLD = np.where(ALNUM, LOWER, 0x20).astype(np.uint8)
_FOLD[0x30:0x3A] = 0x20


def folded(data: np.ndarray) -> np.ndarray:
    """Letters in lower case (ASCII and the Latin-1 block), anything else of ASCII as a space."""
    out = _FOLD[data]
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[latin] += 0x20
    return out


def gram_buckets(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at each place, and which places hold one within one text."""
    x, room = folded(data).astype(np.uint64), np.repeat(offs[1:], np.diff(offs)) - np.arange(len(data))
    code = np.zeros(len(x), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        code[: len(x) - order + 1] = (code[: len(x) - order + 1] << np.uint64(8)) | x[order - 1 :] if order <= len(x) else 0
        if order in ORDERS:
            yield ((code + np.uint64(order << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 12)).astype(np.int64), room >= order


def blocks(offs: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of texts (first, end) and of bytes (first, end) that hold most bytes at most: whole texts, or a part of a long one."""
    k, n = 0, len(offs) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(offs, offs[k] + most, "right")) - 1)
        for lo in range(int(offs[k]), max(int(offs[end]), int(offs[k]) + 1), most):
            yield k, end, lo, min(lo + most, int(offs[end]))
        k = end


def frequencies(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Share of each bucket in each text."""
    n = len(offs) - 1
    text = np.repeat(np.arange(n), np.diff(offs))
    out = np.zeros(n * BUCKETS, np.float32)
    for bucket, whole in gram_buckets(data, offs):
        out += np.bincount(text[whole] * BUCKETS + bucket[whole], minlength=n * BUCKETS).astype(np.float32)
    out = out.reshape(n, BUCKETS)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def codewords(k: int, seed: int = 3) -> np.ndarray:
    """A row of +1 and -1 for each of k languages: the exhaustive code up to five, then the best of many random ones."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        return np.array([[1 if not (column >> row) & 1 else -1 for column in range(1, 2 ** (k - 1))] for row in range(k)], float)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    codes = (rng.integers(0, 2, (k, bits)) * 2 - 1 for _ in range(500))
    return max(codes, key=lambda c: min(np.sum(c[i] != c[j]) for i in range(k) for j in range(i))).astype(float)


@dataclass
class Codebook:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    @classmethod
    def train(cls, languages: np.ndarray, x: np.ndarray, steps: int = 150, rate: float = 0.3, decay: float = 1e-5) -> Codebook:
        names = sorted(set(languages.tolist()))
        codes = codewords(len(names))
        if len(names) < 2:
            return cls(names, codes, np.zeros((BUCKETS, codes.shape[1]), np.float32), np.zeros(codes.shape[1]), np.ones(codes.shape[1]))
        y = np.array([names.index(lang) for lang in languages])
        share = np.bincount(y) / len(y)
        target, weight = codes[y], (1 / (share[y] * len(names)))[:, None]
        scale = np.float32(100.0)  # shares are small numbers
        w, b = np.zeros((BUCKETS, codes.shape[1]), np.float32), np.zeros(codes.shape[1])
        m = v = np.zeros_like(w)
        for step in range(1, steps + 1):
            z = (x @ w) * scale + b
            g = (-target * weight / (1 + np.exp(np.clip(target * z, -50, 50))) / len(y)).astype(np.float32)
            d = x.T @ g * scale + np.float32(decay) * w
            m, v = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d
            w -= np.float32(rate) * 0.1 * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.99**step)) + np.float32(1e-8))
            b -= rate * g.sum(axis=0)
        z = (x @ w) * scale + b
        right = ((z * target) > 0).mean(axis=0)
        trust = np.log(np.clip(right, 0.5 + 1e-3, 1 - 1e-3) / (1 - np.clip(right, 0.5 + 1e-3, 1 - 1e-3)))
        return cls(names, codes, w * scale, b, trust / trust.sum())

    def decode(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bit scores -> (index of the language, its share, its lead over the next)."""
        loss = np.stack([(np.logaddexp(0, -code * z) * self.trust).sum(axis=1) for code in self.codes], axis=1) * len(self.trust)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        top = np.sort(share, axis=1)[:, ::-1]
        return share.argmax(axis=1), top[:, 0], top[:, 0] - (top[:, 1] if share.shape[1] > 1 else 0)

    def bits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The classifiers' scores of each text: the mean weight of its n-grams. Long texts are summed up block by block."""
        n, reach = len(offs) - 1, max(ORDERS) - 1
        sums, counts = np.zeros((n, len(self.bias))), np.zeros(n)
        weights = np.vstack([self.weights, np.zeros((1, self.weights.shape[1]), np.float32)])
        for k, end, lo, hi in blocks(offs):
            if hi == lo:
                continue
            first, last = max(lo - 1, int(offs[k])), min(hi + reach, int(offs[end]))  # n-grams reach over the block's end, letters over its start
            own = slice(lo - first, hi - first)
            inner = np.clip(offs[k : end + 1], lo, hi) - lo
            filled = np.flatnonzero(np.diff(inner))
            for bucket, whole in gram_buckets(data[first:last], np.clip(offs[k : end + 1], first, last) - first):
                bucket[~whole] = BUCKETS
                sums[k + filled] += np.add.reduceat(weights[bucket[own]], inner[filled], axis=0, dtype=np.float64)
                counts[k + filled] += np.add.reduceat(whole[own].astype(np.int64), inner[filled])
        return sums / np.maximum(counts, 1)[:, None] + self.bias


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=512 << 10):
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            x = frequencies(*text_bytes(part.column("text"))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])


def _identify(batches: Iterator[pa.RecordBatch], book: Codebook) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=512 << 10):
        best, share, lead = book.decode(book.bits(*text_bytes(batch.column("text"))))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([book.languages[k] for k in best], pa.string()), pa.array(share), pa.array(lead < AMBIGUOUS)], names=["id", "lang", "score", "ambiguous"])


def train_codebook(
    df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES
) -> Codebook:
    """Train on rows where `learn` holds and the language isn't null: those of smallest id hash, `docs` and most_bytes of text of them at most."""
    rows = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    got = hash_sample(rows, "id", docs, "text", most_bytes).select("text", "lang").mapInArrow(_features, "lang string, x binary").toArrow()
    got = got.sort_by([("lang", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    return Codebook.train(np.array(got.column("lang").to_pylist(), object), x)


def identify_languages(df: DataFrame, book: Codebook, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (0 to 1), ambiguous.

    Null texts and texts without a letter are `und` with score 0, and so is every text if no language was learned.
    Every row gives one row, so repeated rows and null ids stay. Other columns don't matter; an empty table gives an
    empty result.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("letters"))
    kind = f"id {dict(docs.dtypes)['id']}, lang string, score double, ambiguous boolean"
    mute = docs.where(~F.col("letters") if book.languages else F.lit(True)).select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    if not book.languages:
        return mute
    said = docs.where("letters").select("id", "text").mapInArrow(lambda b: _identify(b, book), kind)
    return said.select(F.col("id").alias(id_col), F.col("lang").alias("lang_pred"), "score", "ambiguous").unionByName(mute)


def keep_languages(
    df: DataFrame, book: Codebook, languages: list[str] | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of df in one of the languages (all that were learned) with a score of least or more; all columns stay.

    Texts that are null, have no letter or lie too near two languages go, so every row that stays has a language. Rows
    with equal texts share their fate; repeated rows stay if their text does. An empty table gives an empty result.
    """
    wanted = book.languages if languages is None else languages
    text = (F.coalesce(F.col(text_col), F.lit("")),)
    h1, h2 = fresh(df, "__h1", "__h2")
    hashes = {h1: F.xxhash64(*text), h2: F.xxhash64(F.lit("second"), *text)}
    keyed = df.select(F.struct(hashes[h1].alias("h1"), hashes[h2].alias("h2")).alias("key"), F.col(text_col).alias("text"))
    said = identify_languages(keyed, book, "key", "text")
    gone = materialise(said.where(~F.col("lang_pred").isin(wanted) | (F.col("score") < least)).select(F.col("key.h1").alias(h1), F.col("key.h2").alias(h2)).distinct())
    return df.withColumns(hashes).join(small(gone), [h1, h2], "left_anti").select(df.columns)
