"""Best-fit decreasing packing of token pieces into windows of a fixed size.

Documents become token ids; a document longer than a window is first cut into full windows, and its rest is a piece
like any other. Pieces go in by decreasing length, each into the open window with the least room that still holds
it; a segment tree over remaining capacity (one leaf for each capacity from 0 to the window's size) finds that
capacity in log steps. Pieces of one length are alike, and so are windows with one remaining capacity, so the exact
best-fit decreasing result follows from the histogram of lengths alone: at most `size` numbers reach the driver, and
what it makes of them is a short list of rules (the i-th to j-th piece of length L go to windows s, s+1, ... at
offset o). Each piece learns its rank among pieces of its length from counts per task and follows the rules; pieces
themselves, with their ids, are never shuffled for that.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import materialise, slices, small, trim

SIZE = 2048
END_ID = 1
#: Distinct words whose ids a worker remembers.
CACHE = 300_000
#: Marks that make a pre-token of their own at the end of a word.
MARKS = b"!\"#$%&()*+,-./:;=?@[]^_`{|}~"

#: Texts that tell at load whether a tokenizer works word by word in lower case; any other encodes whole texts.
PROBES = tuple(t.encode() for t in ("Hello  World", " a\nb ", "It's (3.5) x--y?!", "\u00c9t\u00e9 STRASSE \u4e2d\u6587", "a,b;c <|x|> 1,000"))

#: Words of these letters alone are one pre-token, and their normal form is that in lower case.
LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, through a cache of words.

    Pre-tokens of the vocabulary never span white space, so a text's ids are those of its words in order; nor do they
    span a letter and the marks after it, so a word's ids are those of its stem and of the marks at its end. A word of
    common letters goes to the merge rules directly. ASCII letters are put in lower case first, which the vocabulary's
    own normaliser does anyway, unless the text may hold a special token. Vocabularies for which this does not hold are
    recognised by PROBES, and for them whole texts go to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.most = Tokenizer.from_file(path), Learned(self._word), CACHE
        self.tokenize = self.tokenizer.model.tokenize
        self.by_words = all(self._cached([p])[0] == self._plain(p) for p in PROBES)
        self.cache.clear()

    def _plain(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone: their bytes stand for themselves
            return array("I", [t.id for t in self.tokenize(word.lower().decode())]).tobytes()
        stem = word.rstrip(MARKS)
        if len(stem) < len(word) and stem[-4:].decode(errors="ignore").lower()[-1:].isalnum():
            return (self.cache.get(stem) or self._word(stem)) + self.cache[word[len(stem) :]]
        text = word.decode()
        if LETTERS.fullmatch(text):
            return array("I", [t.id for t in self.tokenize(text.lower().encode().decode("latin1").translate(BYTE_CHARACTERS))]).tobytes()
        return self._plain(word)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        return self._cached(texts) if self.by_words else [self._plain(t) for t in texts]

    def _cached(self, texts: list[bytes]) -> list[bytes]:
        ids, out = self.cache.__getitem__, []
        for text in texts:
            if len(self.cache) > self.most:
                self.cache.clear()
            out.append(b"".join(map(ids, (text if b"<|" in text else text.lower()).split())))
        return out


class Learned(dict):
    """Values that learn gives when they are first asked for."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        self.learn = learn

    def __missing__(self, key: bytes) -> bytes:
        value = self[key] = self.learn(key)
        return value


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """Loaded once a worker process, not once a task."""
    return Encoder(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int, cache_words: int = CACHE) -> Iterator[pa.RecordBatch]:
    encode, end, step = _encoder(path), np.array([end_id], "<u4").tobytes(), 4 * size
    encode.most = cache_words
    seen = np.zeros(size + 1, np.int64)
    for batch in slices(batches, most=2 << 20):
        rows = []
        for k, ids in enumerate(encode([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")])):
            ids += end
            for lo in range(0, len(ids), step):
                part = ids[lo : lo + step]
                length = len(part) // 4
                rows.append((k, lo // 4, length, part, len(ids) // 4, int(seen[length])))
                seen[length] += 1
        column = lambda j, kind: pa.array([r[j] for r in rows], kind)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(column(0, pa.int64())), column(1, pa.int64()), column(2, pa.int64()), column(3, pa.binary()), column(4, pa.int64()), column(5, pa.int64())], names=["id", "start", "length", "ids", "doc_tokens", "nth"])
    encode.cache.clear()
    trim()


class OpenWindows:
    """Segment tree over remaining capacity; a leaf holds the runs of windows (first, count) that have just so much room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = np.zeros(2 * self.leaves, bool)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, room: int, first: int, count: int) -> None:
        self.runs[room].append((first, count))
        self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def _mark(self, room: int) -> None:
        at = room + self.leaves
        self.any[at] = bool(self.runs[room])
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least length that some open window has."""
        at = length + self.leaves
        if self.any[at]:
            return length
        while at > 1 and not (at % 2 == 0 and self.any[at + 1]):  # up to the first right-hand neighbour that has any
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rules (length, first rank, end rank, first window, pieces per window, offset) that place all pieces."""
    open_, rules, windows = OpenWindows(size), [], 0
    for length in sorted(histogram, reverse=True):
        rank, n = 0, histogram[length]
        while rank < n:
            room = open_.tightest(length)
            if room is None:
                room, first, count = size, windows, -(-(n - rank) // (size // length))
                windows += count
            else:
                first, count = open_.take(room)
            each = room // length
            full = min(count, (n - rank) // each)
            if full:
                rules.append((length, rank, rank + full * each, first, each, size - room))
                rank += full * each
                if room - each * length:
                    open_.add(room - each * length, first, full)
            if full < count and rank < n:
                rest = n - rank
                rules.append((length, rank, n, first + full, rest, size - room))
                rank = n
                open_.add(room - rest * length, first + full, 1)
                full += 1
            if full < count:
                open_.add(room, first + full, count - full)
    return rules


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, cache_words: int = CACHE) -> DataFrame:
    """Per piece: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are its text's (null: none) and end_id; each lies in just one piece. Pieces of a window lie side by
    side from offset 0. Rows that repeat an id, or have none, are documents of their own. Other columns don't matter; an
    empty table gives an empty result. A worker remembers about cache_words words (220 bytes each). The tokenizer's file has to be at the same path on all machines.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # What grows: `before` has a row for each task and length, at most `size` rows a task; it is broadcast only when small.
    cut = docs.mapInArrow(lambda b: _pieces(b, tokenizer_path, size, end_id, cache_words), f"id {dict(docs.dtypes)['id']}, start long, length long, ids binary, doc_tokens long, nth long")
    pieces = materialise(cut.withColumn("task", F.spark_partition_id()))
    counts = materialise(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("task", "length", F.coalesce("before", F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    rules = spark.createDataFrame(best_fit_decreasing(histogram, size), "length long, lo long, hi long, first long, each long, at long")
    ranked = pieces.join(small(materialise(before)), ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(rules), (ranked.length == rules.length) & (ranked["rank"] >= rules.lo) & (ranked["rank"] < rules.hi)).drop(rules.length)
    step = F.col("rank") - F.col("lo")
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens", (F.col("first") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + step % F.col("each") * F.col("length")).alias("offset"))
