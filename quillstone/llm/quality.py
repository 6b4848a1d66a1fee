"""Quality classification by positive-unlabelled learning.

Trusted positives are rows labelled 1; all other text is unlabelled, a mixture of good and bad. With a class prior p,
the risk of calling bad text good is that of unlabelled text minus p times that of positives. A flexible model can
drive this estimate below zero, so the non-negative risk estimator is minimised: where a batch's estimate falls below
zero, the step goes the other way until it is back. The model is a small network over statistics of a text.

No row labelled 0 is used anywhere. The prior is estimated from positives and unlabelled text: a first model is
trained with a prior of a half, and the lowest ratio of the two score distributions' upper tails is the estimate.
Scores are calibrated from the same two samples: logistic regression tells positives from unlabelled text, with
weights in the ratio of the prior, so that its odds are the prior times the ratio of densities, which is the
probability of being good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import PLAIN, Words, discard, grams, hash_sample, materialise, slices, small, text_bytes

#: Rows of the labelled and of the unlabelled sample, and bytes of text of each.
TRAIN_ROWS = 6000
TRAIN_BYTES = 64 << 20
#: Bytes that a worker classifies at once.
BLOCK_BYTES = 1 << 20
SHAPES = 128

_CLASS = np.zeros(256, np.int64)  # 0: other marks
for _k, _group in enumerate((b" ", b"\n\t\r\x0b\x0c", b"0123456789", bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)), bytes(range(0x80, 256)), b".", b",", b"!", b"|", b"#*&%$@^~", b"'\"-", b":;/\\", b"<>{}[]()=_+")):
    _CLASS[list(_group)] = _k + 1
KINDS = 15


def character_counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: characters by kind, hashed trigrams of kinds, line feeds. Works block by block of bytes."""
    n = len(offs) - 1
    kinds, shapes, feeds = np.zeros(n * KINDS), np.zeros(n * SHAPES), np.zeros(n)
    for lo in range(0, len(data), BLOCK_BYTES):
        hi = min(lo + BLOCK_BYTES, len(data))
        kind = _CLASS[data[lo : hi + 2]]  # trigrams reach over the block's end
        text = np.searchsorted(offs, np.arange(lo, lo + len(kind)), "right") - 1
        own = hi - lo
        kinds += np.bincount(text[:own] * KINDS + kind[:own], minlength=n * KINDS)
        feeds += np.bincount(text[:own][data[lo:hi] == 10], minlength=n)
        if len(kind) > 2:
            m = min(own, len(kind) - 2)
            code = kind[:m] * KINDS * KINDS + kind[1 : m + 1] * KINDS + kind[2 : m + 2]
            whole = text[:m] == text[2 : m + 2]
            shapes += np.bincount(text[:m][whole] * SHAPES + (code[whole] * 2654435761 >> 7) % SHAPES, minlength=n * SHAPES)
    return kinds.reshape(n, KINDS), shapes.reshape(n, SHAPES), feeds


def distinct_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many different values each stretch first[k] .. first[k + 1] holds."""
    owner = np.searchsorted(first, np.arange(len(hashes)), "right") - 1
    if len(first) == 2 or len(hashes) > 4 * BLOCK_BYTES:
        return np.array([len(np.unique(hashes[a:b])) for a, b in zip(first, first[1:], strict=False)])
    order = np.lexsort((hashes, owner))
    k, o = hashes[order], owner[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[fresh], minlength=len(first) - 1)


def text_statistics(batch: pa.RecordBatch) -> np.ndarray:
    """A row of numbers for each text: shares of kinds of characters, repetition of words, pairs and lines, lengths, and hashed trigrams of kinds."""
    data, offs = text_bytes(batch.column("text"))
    n, sizes = len(offs) - 1, np.diff(offs)
    kinds, shapes, feeds = character_counts(data, offs)
    shares = kinds / np.maximum(sizes, 1)[:, None]
    words = Words(data, offs, PLAIN)
    first, count, lengths = words.first, np.diff(words.first), words.ends - words.starts

    def total(values: np.ndarray, bounds: np.ndarray = first) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    per = lambda x: x / np.maximum(count, 1)
    per_pair = lambda x: x / np.maximum(count - 1, 1)
    inside = np.ones(max(len(words.hashes) - 1, 0), bool)  # pairs within one text
    inside[first[1:-1][(first[1:-1] > 0) & (first[1:-1] <= len(inside))] - 1] = False
    pair_first = np.concatenate([[0], np.cumsum(np.maximum(count - 1, 0))])
    same = total((words.hashes[1:] == words.hashes[:-1])[inside], pair_first)
    last = _CLASS[data[words.ends - 1]] if len(lengths) else lengths
    lone, marked = total(lengths == 1), total((last == 9) | (last == 10) | (last == 11))
    mean, square = per(total(lengths)), per(total(lengths * lengths))
    pairs = distinct_counts(grams(words.hashes, 2)[inside], pair_first) if len(inside) else np.zeros(n)
    rows = [
        np.log1p(count) / 5, per(distinct_counts(words.hashes, first)), per_pair(pairs), per_pair(same),
        per(lone), per(marked), mean / 10, np.sqrt(np.maximum(square - mean**2, 0)) / 10, np.log1p(sizes / (feeds + 1)) / 5, count == 0,
    ]
    upper = shares[:, 4] / np.maximum(shares[:, 4] + shares[:, 5], 1e-9)
    return np.column_stack([*rows, upper, shares, np.sqrt(shapes / np.maximum(sizes, 1)[:, None])]).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Network:
    """One hidden layer; centre and spread standardise inputs; the score is min(1, exp(scale * raw + shift)) once calibrated."""

    centre: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    scale: float = 0.0
    shift: float = float(np.log(0.5))

    def raw(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(np.clip((x - self.centre) / self.spread, -10, 10) @ a + b) @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.scale * self.raw(x) + self.shift, -50, 0))

    @classmethod
    def constant(cls, width: int) -> Network:
        return cls(np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.zeros(1)])

    @classmethod
    def train(cls, positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 40, batch: int = 500, rate: float = 3e-3, decay: float = 1e-4, seed: int = 9) -> Network:
        """Minimise p R+(positive) + max(0, R-(unlabelled) - p R-(positive)) with the sigmoid loss."""
        rng = np.random.default_rng(seed)
        centre, spread = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
        p, u = (positive - centre) / spread, (unlabelled - centre) / spread
        p, u = np.clip(p, -10, 10), np.clip(u, -10, 10)
        w = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
        batches = max(1, len(u) // batch)
        for _ in range(epochs):
            pp, uu = np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches)
            for i, j in zip(pp, uu, strict=True):
                if not len(i) or not len(j):
                    continue
                x = np.concatenate([p[i], u[j]])
                h = np.tanh(x @ w[0] + w[1])
                s = _sigmoid(h @ w[2] + w[3][0])  # sigmoid loss of calling a text good: 1 - s; bad: s
                sp, su = s[: len(i)], s[len(i) :]
                negative = su.mean() - prior * sp.mean()
                dp, du = -prior / len(i) * np.ones(len(i)), np.zeros(len(j))
                if negative >= 0:
                    dp, du = dp - prior / len(i), du + 1 / len(j)
                else:  # step back: raise the negative part alone
                    dp, du = np.full(len(i), prior / len(i)), np.full(len(j), -1 / len(j))
                g = np.concatenate([dp, du]) * s * (1 - s)
                gh = np.outer(g, w[2]) * (1 - h * h)
                step += 1
                for k, d in enumerate((x.T @ gh + decay * w[0], gh.sum(axis=0), h.T @ g + decay * w[2], np.array([g.sum()]))):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return cls(centre, spread, w)

    def calibrate(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 50) -> None:
        """Logistic regression of positives (of total weight prior) against unlabelled text (of weight one), by Newton's method.

        Its odds are prior * density of positives / density of all, the probability of being good.
        """
        raw = np.concatenate([self.raw(positive), self.raw(unlabelled)])
        z, theta = np.column_stack([raw, np.ones(len(raw))]), np.zeros(2)
        y = np.repeat([1.0, 0.0], [len(positive), len(unlabelled)])
        weight = np.repeat([prior / len(positive), 1 / len(unlabelled)], [len(positive), len(unlabelled)])
        for _ in range(steps):
            s = _sigmoid(z @ theta)
            theta -= np.linalg.solve(z.T @ (z * (weight * s * (1 - s))[:, None]) + 1e-6 * np.eye(2), z.T @ (weight * (s - y)) + 1e-6 * theta)
        self.scale, self.shift = float(theta[0]), float(theta[1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = text_statistics(batch)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])


def prior_from_tails(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Lowest ratio of the shares of unlabelled and positive scores above a threshold (with at least a tenth of the positives)."""
    cuts = np.quantile(positive, np.linspace(0, 0.9, 46))
    return float(np.clip(min((unlabelled > c).mean() / max((positive > c).mean(), 1e-9) for c in cuts), 0.05, 0.99))


def train_quality(
    df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES
) -> Network | None:
    """Train on rows labelled 1 where `learn` holds and on unlabelled texts: of each those of smallest id hash, `rows` and most_bytes of text at most.

    Ids may be of any type; texts that share an id share its label; repeated rows count once. None without positives.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = labels.where(learn & (F.col(label_col) == 1)).select(F.col(id_col).alias("id"))
    marked = materialise(hash_sample(marked, "id", rows))
    trusted = materialise(docs.join(small(marked), "id", "left_semi"))

    def statistics(sample: DataFrame) -> np.ndarray:
        found = sorted(r.x for r in hash_sample(sample, "id", rows, "text", most_bytes).mapInArrow(_features, f"id {dict(docs.dtypes)['id']}, x binary").collect())
        return np.frombuffer(b"".join(found), np.float32).reshape(len(found), -1) if found else np.zeros((0, 1), np.float32)

    good, other = statistics(trusted), statistics(docs)
    discard(marked, trusted)
    if not len(good):
        return None
    first = Network.train(good, other, 0.5, epochs=10)
    prior = prior_from_tails(first.raw(good), first.raw(other))
    model = Network.train(good, other, prior)
    model.calibrate(good, other, prior)
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Network | None) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = text_statistics(batch)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((model or Network.constant(x.shape[1])).score(x).astype(np.float64))], names=["id", "score"])


def score_quality(df: DataFrame, model: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score (0 to 1, higher: good likelier).

    Null and empty texts are scored by their (zero) statistics. Every row gives one row, so repeated rows and null ids
    stay. Other columns don't matter; an empty table gives an empty result, and without a model every score is 0.5.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(lambda b: _score(b, model), f"id {dict(docs.dtypes)['id']}, score double").withColumnRenamed("id", id_col)
