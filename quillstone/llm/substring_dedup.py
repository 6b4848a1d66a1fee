"""Removal of repeated passages by relative Lempel-Ziv parsing.

A document is factored greedily against reference blocks: from each place, the factor is the longest stretch that also
stands somewhere else in the block, as a pointer to that place and a length; where no window of `window` words repeats,
the parse moves on by one word. Factors of a whole window or more are duplicate spans. At the boundary of two factors,
windows that straddle it are looked up in their own blocks like all others, and factors that abut become one span, so
nothing is lost there.

The reference is all documents, and its index is sharded by content, not by document, so that a document meets every
block of it with one exchange instead of one pass per block:

1. Anchors. Of the `gram`-word phrases in a window, the one of smallest hash is its anchor (with all ties). Equal
   windows have equal anchors, so a window whose anchor occurs once in the corpus can't repeat. Anchors are counted
   with a combine before the shuffle; about one word in twelve is an anchor.
2. Runs. Consecutive windows with the same repeated anchor are a run: (document, first window, their fingerprints).
   A reference block holds all runs of its anchors, and each run is parsed against its block. A block is indexed by its
   sorted suffixes: the longest match of a place is with one of its two neighbours there. Windows match if the 64-bit
   hashes of both anchor and window do.
3. An anchor with more than HOT occurrences (a boilerplate passage in a third of all documents) isn't gathered in one
   block: its windows are counted with a combine before the shuffle, and answers return over salted keys. Each repeated
   window of it is a factor, without a pointer, since it stands in very many places.
4. Factors return to their documents, and the words they cover go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import PLAIN, Words, discard, grams, materialise, packed, packed_flat, signed, slices, small, text_bytes

WINDOW = 35
GRAM = 12
#: Occurrences of an anchor from which on its windows are counted apart and its answers salted.
HOT = 20_000
SALTS = 64
#: Windows of a run at most; factors of runs that abut become one span.
LONGEST_RUN = 1000
#: Windows of runs that are parsed together.
BLOCK_WINDOWS = 200_000
FACTOR = ["id", "start", "windows", "source", "source_start"]


def _slide(x: np.ndarray, k: int, best) -> np.ndarray:
    """best over k consecutive values, at each of len - k + 1 places."""
    width, out = 1, x
    while 2 * width <= k:
        out = best(out[:-width], out[width:])
        width *= 2
    return best(out[: len(x) - k + 1], out[k - width :]) if width < k else out


def _windows(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first word) of each whole window of a slice, and nothing across texts."""
    n = np.diff(words.first)
    counts = np.maximum(n - window + 1, 0)
    total = int(counts.sum())
    text = np.repeat(np.arange(len(n)), counts)
    at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + words.first[:-1][text]
    return text, at, counts


def anchors(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each window, its first word in the slice, its anchor)."""
    text, at, _ = _windows(words, window, gram)
    if not len(at):
        return text, at, np.zeros(0, np.uint64)
    return text, at, _slide(grams(words.hashes, gram), window - gram + 1, np.minimum)[at]


def anchor_places(words: Words, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Hashes of all phrases that are the smallest of some window of their text, one for each place."""
    text, at, least = anchors(words, window, gram)
    if not len(at):
        return least
    phrases, span = grams(words.hashes, gram), window - gram + 1
    lows = np.full(len(phrases) + 2 * span, 0, np.uint64)  # 0: no window begins here
    lows[at + span - 1] = np.maximum(least, np.uint64(1))
    most = _slide(lows, span, np.maximum)[: len(phrases)]  # largest minimum among the windows that hold the phrase
    return phrases[(most == np.maximum(phrases, np.uint64(1)))]


def _count(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        values, counts = np.unique(anchor_places(Words(*text_bytes(batch.column("text")), PLAIN), window, gram), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts)], names=["anchor", "n"])


def _runs(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = Words(*text_bytes(batch.column("text")), PLAIN)
        text, at, least = anchors(words, window, gram)
        if not len(at):
            continue
        prints = grams(words.hashes, window)[at]
        fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
        fresh[::LONGEST_RUN] = True
        starts = np.flatnonzero(fresh)
        ids = batch.column("id").take(pa.array(text[starts]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(at[starts] - words.first[text[starts]]), pa.array(signed(least[starts])), packed_flat(prints, np.append(starts, len(at)))], names=["id", "start", "anchor", "prints"])


def longest_matches(prints: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, place) of the longest match of each place with another one. ends: the end of each place's run, which no match crosses.

    Suffixes are sorted by doubling: rank[k] orders stretches of 2**k windows. Neighbours in that order match longest.
    """
    n, at = len(prints), np.arange(len(prints))
    ranks = [np.unique(prints, return_inverse=True)[1] + 1]
    longest = int((ends - at).max())
    while (1 << (len(ranks) - 1)) < longest:
        step, last = 1 << (len(ranks) - 1), ranks[-1]
        after = np.where(at + step < ends, last[np.minimum(at + step, n - 1)], 0)
        ranks.append(np.unique(last * np.int64(n + 1) + after, return_inverse=True)[1] + 1)
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    same = np.zeros(max(n - 1, 0), np.int64)
    room = np.minimum(ends[a] - a, ends[b] - b)
    for k in range(len(ranks) - 1, -1, -1):
        fits = same + (1 << k) <= room
        x, y = np.minimum(a + same, n - 1), np.minimum(b + same, n - 1)
        same += (fits & (ranks[k][x] == ranks[k][y])) << k
    left, right = np.concatenate([[0], same]), np.concatenate([same, [0]])
    length, place = np.empty(n, np.int64), np.empty(n, np.int64)
    length[order] = np.maximum(left, right)
    place[order] = np.where(left >= right, np.concatenate([order[:1], a]), np.concatenate([b, order[-1:]]))
    return length, place


def greedy_parse(prints: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, place of the source) of the factors of all runs bounds[k] .. bounds[k + 1], parsed against all runs of the block."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    length, source = longest_matches(prints, ends)
    at, out = bounds[:-1][np.diff(bounds) > 0], []
    while len(at):  # one step of every run's parse at a time
        out.append(at[length[at] > 0])
        after = at + np.maximum(length[at], 1)
        at = after[after < ends[at]]
    places = np.concatenate(out) if out else np.zeros(0, np.int64)
    return places, length[places], source[places]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by anchor -> factors (id, start, windows, source, source_start). Blocks of several anchors are parsed together."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    windows, last = 0, None

    def flush() -> pa.RecordBatch:
        ids, starts, lengths, prints = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        run = np.repeat(np.arange(len(ids)), lengths)
        place, length, source = greedy_parse(prints, bounds)
        word = lambda x: starts[run[x]] + x - bounds[run[x]]
        columns = [ids[run[place]], word(place), length, ids[run[source]], word(source)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=FACTOR)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids, starts = (batch.column(c).to_numpy() for c in ("anchor", "id", "start"))
        data, offs = text_bytes(batch.column("prints"))
        prints, offs = data.view(np.uint64), offs // 8
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if keys[lo] != last and windows > BLOCK_WINDOWS:
                yield flush()
                windows = 0
            last = keys[lo]
            held.append((ids[lo:hi], starts[lo:hi], np.diff(offs[lo : hi + 1]), prints[offs[lo] : offs[hi]].copy()))
            windows += int(offs[hi] - offs[lo])
    if held:
        yield flush()


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "prints", 4 << 20):
        data, offs = text_bytes(batch.column("prints"))
        n = np.diff(offs) // 8
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(offs[:-1] // 8, n)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(batch.column("start").to_numpy(zero_copy_only=False)[row] + place), batch.column("anchor").take(pa.array(row)), pa.array(data.view(np.int64))], names=["id", "start", "anchor", "print"])


def spans(starts: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """(first word, end) of each stretch of words that factors cover, in order. Factors that abut or overlap make one stretch."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], np.maximum.accumulate(starts[order] + windows[order] - 1 + window)
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    return np.stack([begin[first], end[np.append(first[1:], len(end)) - 1]], axis=1)


def _factored(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """A document's factors -> the stretches that they cover, as packed pairs of places."""
    for batch in batches:
        cuts = []
        for found in batch.column("found"):
            places = np.array([(r["start"], r["windows"]) for r in found.as_py()], np.int64)
            cuts.append(spans(places[:, 0], places[:, 1], window))
        yield pa.RecordBatch.from_arrays([batch.column("id"), packed(cuts, np.int64)], names=["id", "cuts"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words_, removed, kept, spans = [], [], [], []
        for text, raw in zip(batch.column("text"), batch.column("cuts").to_pylist(), strict=True):
            words = text.as_buffer().to_pybytes().split()
            cuts = np.frombuffer(raw or b"", np.int64).reshape(-1, 2).tolist()
            words_.append(len(words))
            removed.append(sum(e - s for s, e in cuts))
            spans.append([{"start": s, "end": e} for s, e in cuts])
            for s, e in reversed(cuts):
                del words[s:e]
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words_, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["id", "n_words", "n_removed", "kept", "spans"])


def relative_factors(plain: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """plain: id (long), text without nulls -> id, start, windows, source, source_start of all factors of a window or more.

    A factor of so many windows covers windows - 1 + window words from start on; the same words stand at source_start in
    the text of id source. Windows of a hot anchor, which stand in very many places, name no source. A join beyond the broadcast bound is on the anchor, whose hot keys adaptive execution splits.
    """
    counted = plain.mapInArrow(lambda b: _count(b, window, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = materialise(counted)
    runs = materialise(plain.mapInArrow(lambda b: _runs(b, window, gram), "id long, start long, anchor long, prints binary").join(small(repeated), "anchor").select("id", "start", "anchor", "prints", (F.col("n") > hot).alias("hot")))
    discard(repeated)
    cool = runs.where("NOT hot").select("id", "start", "anchor", "prints").repartition(F.col("anchor")).sortWithinPartitions("anchor")
    found = cool.mapInArrow(_parse, "id long, start long, windows long, source long, source_start long")
    if runs.where("hot").take(1):
        flat = runs.where("hot").select("id", "start", "anchor", "prints").mapInArrow(_open, "id long, start long, anchor long, print long")
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        again = flat.groupBy("anchor", "print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "print", salts)
        salted = flat.withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.lit(SALTS)).cast("int")).join(again, ["anchor", "print", "salt"], "left_semi")
        nowhere = F.lit(None).cast("long")
        found = found.unionByName(salted.select("id", "start", F.lit(1).cast("long").alias("windows"), nowhere.alias("source"), nowhere.alias("source_start")))
    out = materialise(found)
    discard(runs)
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_text, spans (first word and end of each removed stretch).

    Words are runs of anything but white space, unchanged. A word goes if a window of `window` consecutive words over
    it also starts anywhere else, in the same document or another; all windows are judged on the input. Kept words are
    joined by one space. Null and empty texts, and texts shorter than a window, lose nothing. Repeated rows repeat
    each other's windows. Rows that share an id, or have none, are kept apart by a row number made from id and text.
    Other columns don't matter; an empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    factors = relative_factors(docs.select(F.xxhash64("doc", "text").alias("id"), "text"), window, gram, hot)
    by_doc = factors.select("id", "start", "windows").distinct().groupBy("id").agg(F.collect_list(F.struct("start", "windows")).alias("found"))
    per_doc = materialise(by_doc.mapInArrow(lambda b: _factored(b, window), "id long, cuts binary"))
    discard(factors)
    joined = docs.withColumn("id", F.xxhash64("doc", "text")).join(small(per_doc), "id", "left")
    cut = joined.select(F.col("doc").alias("id"), "text", "cuts").mapInArrow(_cut, f"id {dict(docs.dtypes)['doc']}, n_words long, n_removed long, kept binary, spans array<struct<start:bigint,end:bigint>>")
    return cut.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"), "spans")
