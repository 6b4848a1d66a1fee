"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Items and documents are word sequences. The CGK walk reads a sequence with a pointer that stays or moves on at each
step, by random bits that depend on the step and the word it sees; it turns sequences at small edit distance into
strings at small Hamming distance. Of each string, several repetitions keep a few random steps each (bit sampling);
a window and an item that agree on all steps of a repetition are a candidate pair. How many repetitions an item of n
words gets follows from a target recall: seeded trials with the most edits allowed measure how often one repetition
succeeds, and there are as many as the target needs. A candidate is verified exactly, by the word edit distance of
the item to the best stretch around the window.

Windows are those that can match at all. An item of n words and a stretch at most d edits away have at least
n - q + 1 - q d phrases of q words in common, all of them shifted by no more than d places; so only windows with as
many hits of an item's phrases near their start are walked, at every offset that d edits allow. Phrases that many
items share are not looked up, as far as fewer hits of the item's other phrases then suffice. That loses no match.

Items reach the workers in blocks of at most `block_items` items and `block_bytes` bytes, each a pass over the documents.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillstone.llm.common import ALNUM, GOLD, LOWER, Words, fresh, grams, materialise, mix, slices, small, text_bytes

#: Edits allowed, as a share of an item's words.
EDITS = 0.2
#: Steps that a repetition keeps.
SAMPLED = 2
#: Least share of matches with the most edits allowed that shall become candidates, the trials that measure it, and the most repetitions.
RECALL = 0.99
TRIALS = 64
MOST_REPETITIONS = 256
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
PHRASE = 3
#: Items that may share a phrase that is looked up, where an item's other phrases suffice.
COMMON = 16
#: Hits of phrases that are held at once.
HITS = 2_000_000
#: Windows whose walks go side by side.
WALKS = 1024


def _number(x: np.ndarray | int, seed: int) -> np.ndarray:
    """A random 64-bit number for each whole number."""
    with np.errstate(over="ignore"):
        return mix((np.atleast_1d(np.asarray(x, np.uint64)) + np.uint64(seed)) * GOLD)


def allowed_edits(n: int) -> int:
    return int(EDITS * n)


def phrase_words(n: int) -> tuple[int, int]:
    """(q, least number of q-word phrases that an item of n words has in common with every match of it)."""
    d = allowed_edits(n)
    for q in range(min(PHRASE, n), 0, -1):
        if n - q + 1 - q * d > 0:
            return q, n - q + 1 - q * d
    raise AssertionError("edits are fewer than words")


def sampled_steps(n: int, repetition: int) -> np.ndarray:
    """The steps that a repetition keeps for items of n words: random ones of a walk whose pointer stays inside."""
    rng = np.random.default_rng([n, repetition, 23])
    return np.sort(rng.choice(max(SAMPLED, int(1.6 * n)), SAMPLED, replace=False))


def kept_steps(n: int, repetitions: int) -> np.ndarray:
    """Mask (repetition, step) of the steps that each repetition keeps for items of n words."""
    steps = np.stack([sampled_steps(n, r) for r in range(repetitions)])
    out = np.zeros((repetitions, 1 + int(steps.max())), bool)
    out[np.arange(repetitions)[:, None], steps] = True
    return out


def walk_keys(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, kept: np.ndarray) -> np.ndarray:
    """Bucket keys (window, repetition) of the windows of n words at starts (cut at ends, where walks see padding)."""
    repetitions = len(kept)
    out, coin = np.empty((len(starts), repetitions), np.uint64), _number(np.arange(repetitions), 101)[None, :]
    for lo in range(0, len(starts), WALKS):
        part = slice(lo, lo + WALKS)
        pointer = np.repeat(starts[part][:, None], repetitions, axis=1)
        stop = np.minimum(starts[part] + n, ends[part])[:, None]
        key = np.full(pointer.shape, n, np.uint64)
        for step in range(kept.shape[1]):
            inside = pointer < stop
            seen = np.where(inside, hashes[np.minimum(pointer, len(hashes) - 1)], np.uint64(0))
            number = _number(step, 7)
            now = kept[:, step]
            if now.any():
                key[:, now] = mix(key[:, now] ^ seen[:, now]) + number
            pointer += (mix(seen ^ number ^ coin) >> np.uint64(63)).astype(np.int64) & inside
        out[part] = key
    return out


def edited(n: int, edits: int, trials: int, seed: int) -> list[np.ndarray]:
    """For each trial a sequence of n made-up words, then one that so many random edits make of it."""
    rng, out = np.random.default_rng([n, edits, seed]), []
    for _ in range(trials):
        words = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        changed = words.tolist()
        for kind in rng.integers(0, 3, edits):
            at = int(rng.integers(0, len(changed)))
            changed[at : at + (kind > 0)] = [] if kind == 1 else [int(rng.integers(1, 1 << 63))]
        out += [words, np.array(changed, np.uint64)]
    return out


def repetitions_for(n: int, recall: float, trials: int = TRIALS) -> int:
    """Repetitions that items of n words need, so that matches with the most edits allowed become candidates with the target recall.

    In each trial all windows are tried whose start such edits can shift, as in a search. The number doubles until the
    recall that the trials show reaches the target (or MOST_REPETITIONS).
    """
    d, tried = allowed_edits(n), 16
    pairs = edited(n, d, trials if d else 1, 5)
    while tried < MOST_REPETITIONS:
        kept, hits = kept_steps(n, tried), 0
        for item, text in zip(pairs[::2], pairs[1::2], strict=True):
            own = walk_keys(item, np.zeros(1, np.int64), np.array([n]), n, kept)
            starts = np.arange(min(d + 1, max(len(text), 1)))
            hits += bool((walk_keys(text, starts, np.full(len(starts), len(text)), n, kept) == own).any()) if len(text) else 0
        if hits >= recall * len(pairs) / 2:
            break
        tried *= 2
    return tried


@functools.lru_cache(maxsize=4096)
def planned_repetitions(n: int, recall: float) -> int:
    """Those of the next length of a grid of about a tenth's steps, so that few lengths are tried."""
    grid = 1
    while grid < n:
        grid = max(grid + 1, int(grid * 1.1))
    return repetitions_for(grid, recall, TRIALS if grid < 400 else TRIALS // 4)


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least word edits that turn a stretch of text into item, and the stretch's end."""
    row = np.zeros(len(text) + 1, np.int64)
    place = np.arange(len(text) + 1)
    for i, word in enumerate(item):
        after = np.empty_like(row)
        after[0] = i + 1
        after[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(after - place) + place  # words of the text to leave out
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """Items by phrase and by bucket. items: texts; repetitions: by number of words."""

    def __init__(self, texts: list[str], repetitions: dict[int, int]):
        words = Words(*text_bytes(pa.array(texts, pa.string())), ALNUM, LOWER)
        self.words = [words.hashes[a:b] for a, b in zip(words.first, words.first[1:], strict=False)]
        self.lengths = np.array([len(h) for h in self.words], np.int64)
        self.edits = np.array([allowed_edits(n) for n in self.lengths.tolist()], np.int64)
        self.needed = np.zeros(len(texts), np.int64)
        hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, h in enumerate(self.words):
            if len(h):
                q, self.needed[k] = phrase_words(len(h))
                hits[q] += [(g, k, j) for j, g in enumerate(grams(h, q).tolist())]
        self.phrases = {}
        for q, found in hits.items():
            found = self._without_common(found)
            found.sort()
            keys, first = np.unique(np.array([g for g, _, _ in found], np.uint64), return_index=True)
            self.phrases[q] = (keys, np.append(first, len(found)), np.array([k for _, k, _ in found]), np.array([j for _, _, j in found]))
        self.kept: dict[int, np.ndarray] = {}
        self.buckets: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n in sorted(set(self.lengths.tolist()) - {0}):
            members = np.flatnonzero(self.lengths == n)
            flat, starts = np.concatenate([self.words[k] for k in members.tolist()]), np.arange(len(members)) * n
            self.kept[n] = kept_steps(n, repetitions[n])
            keys = walk_keys(flat, starts, starts + n, n, self.kept[n])
            orders = [np.argsort(keys[:, r], kind="stable") for r in range(keys.shape[1])]
            self.buckets[n] = [(keys[order, r], members[order]) for r, order in enumerate(orders)]

    def _without_common(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Leave out an item's most common phrases, while at least one of the hits that it needs is left to the others."""
        shared: dict[int, set[int]] = defaultdict(set)
        for g, k, _ in found:
            shared[g].add(k)
        by_item: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for entry in found:
            by_item[entry[1]].append(entry)
        out = []
        for k, entries in by_item.items():
            entries.sort(key=lambda e: -len(shared[e[0]]))
            spare = 0
            while spare < min(len(entries), self.needed[k]) - 1 and len(shared[entries[spare][0]]) > COMMON:
                spare += 1
            self.needed[k] -= spare
            out += entries[spare:]
        return out

    def windows(self, words: Words) -> dict[int, np.ndarray]:
        """Starts to walk, by item length."""
        out: dict[int, list[np.ndarray]] = defaultdict(list)
        if not len(words.hashes):
            return {}
        for keys, first, item, place, q in ((*x, q) for q, x in self.phrases.items()):
            hits, at = self._hits(words, keys, q)
            counts = np.diff(first)[at]
            parts = int(counts.sum()) // HITS + 1  # items go in so many turns, each with about HITS hits
            for turn in range(parts):
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for lo, hi in _chunks(counts, HITS):
                    n, begin = counts[lo:hi], first[at[lo:hi]]
                    entry = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                    mine = item[entry] % parts == turn
                    found.append((item[entry][mine], (np.repeat(hits[lo:hi], n) - place[entry])[mine], np.repeat(hits[lo:hi], n)[mine]))
                if found:
                    self._near(words, *map(np.concatenate, zip(*found, strict=True)), out)
        return {n: np.unique(np.concatenate(parts)) for n, parts in out.items()}

    @staticmethod
    def _hits(words: Words, keys: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text's phrases that items have, and which phrases they are."""
        where, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(words.hashes) - q + 1, HITS):
            g = grams(words.hashes[lo : lo + HITS + q - 1], q)
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == g)
            where.append(hit + lo)
            which.append(at[hit])
        hits, at = np.concatenate(where), np.concatenate(which)
        inside = np.searchsorted(words.first, hits, "right") == np.searchsorted(words.first, hits + q - 1, "right")
        return hits[inside], at[inside]

    def _near(self, words: Words, k: np.ndarray, start: np.ndarray, hit: np.ndarray, out: dict[int, list[np.ndarray]]) -> None:
        """Add the starts around which an item has as many hits as it needs."""
        text = np.searchsorted(words.first, hit, "right") - 1
        order = np.lexsort((start, text, k))
        k, start, text = k[order], start[order], text[order]
        last = np.arange(len(k)) + self.needed[k] - 1
        fits = last < len(k)
        last = np.minimum(last, max(len(k) - 1, 0))
        fits &= (k[last] == k) & (text[last] == text) & (start[last] - start <= 2 * self.edits[k])
        for n in np.unique(self.lengths[k[fits]]).tolist():
            mine, d = fits & (self.lengths[k] == n), allowed_edits(n)
            begin, of = start[mine], text[mine]
            for lo in range(0, len(begin), max(1, HITS // (3 * d + 1))):
                part = slice(lo, lo + max(1, HITS // (3 * d + 1)))
                around = begin[part][:, None] + np.arange(-d, 2 * d + 1)[None, :]
                least, most = words.first[of[part]][:, None], words.first[of[part] + 1][:, None] - 1
                out[n].append(np.unique(np.clip(around, least, most)))  # a window may be short of words at its text's ends


def _chunks(counts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of entries that hold about so many in sum."""
    block = np.cumsum(counts) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(counts)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


@functools.lru_cache(maxsize=1)
def _index(texts: tuple[str, ...], repetitions: tuple[tuple[int, int], ...]) -> Index:
    """Built once a worker process, not once a task; blocks of items are bounded, so it is too."""
    return Index(list(texts), dict(repetitions))


def _search(batches: Iterator[pa.RecordBatch], texts: tuple[str, ...], ids: list, id_type: pa.DataType, repetitions: tuple[tuple[int, int], ...]) -> Iterator[pa.RecordBatch]:
    index = _index(texts, repetitions)
    for batch in slices(batches):
        words = Words(*text_bytes(batch.column("text")), ALNUM, LOWER)
        h, rows = words.hashes, []
        near: dict[tuple[int, int], set[int]] = defaultdict(set)
        for n, starts in index.windows(words).items():
            text = np.searchsorted(words.first, starts, "right") - 1
            keys = walk_keys(h, starts, words.first[text + 1], n, index.kept[n])
            for r, (known, members) in enumerate(index.buckets[n]):
                lo, hi = np.searchsorted(known, keys[:, r], "left"), np.searchsorted(known, keys[:, r], "right")
                for w in np.flatnonzero(hi > lo).tolist():
                    for k in members[lo[w] : hi[w]].tolist():
                        near[int(text[w]), k].add(int(starts[w]))
        for (t, k), starts in sorted(near.items()):
            item = index.words[k]
            d, first, last = allowed_edits(len(item)), int(words.first[t]), int(words.first[t + 1])
            best, done = None, -1
            for start in sorted(starts):
                if start < done:
                    continue
                lo, hi = max(first, start - 2 * d - 1), min(last, start + 2 * len(item) + 2 * d + 1)
                edits, end = best_stretch(item, h[lo:hi])
                done = start + len(item) // 2  # the stretch just searched covers these starts as well
                if edits <= d and (best is None or edits < best[0]):
                    best = (edits, lo + end - first)
            if best:
                rows.append((t, k, best[0], best[1], len(item)))
        column = lambda j: pa.array([r[j] for r in rows], pa.int64())
        held = pa.array([ids[r[1]] for r in rows], id_type)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(column(0)), held, column(2), column(3), column(4)], names=["id", "item_id", "edits", "end_word", "item_words"])


def find_items(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, recall: float = RECALL,
) -> DataFrame:
    """One row per document row and item that it holds: id, item_id, edits, end_word (of the best stretch), item_words.

    Words are runs of ASCII digits, letters and all of non-ASCII, A-Z in lower case. A document holds an item of n
    words if some stretch of it is at most floor(0.2 n) word edits away. Exact passages are always found, edited ones
    with the target recall at least. Ids of documents and items may be of any type. Null and empty texts, and items
    without words, match nothing. Repeated rows give repeated results; an item id with several texts gives a row for
    each that is held. Other columns don't matter; an empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("k"), F.col(item_text).alias("t")).distinct()
    rows, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(1, -(-rows // block_items), -(-size // block_bytes))
    kind = f"id {dict(docs.dtypes)['id']}, item_id {dict(wanted.dtypes)['k']}, edits long, end_word long, item_words long"
    id_type, out = to_arrow_type(wanted.schema["k"].dataType), None
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block).orderBy("t", "k").collect()  # a block of items
        texts, ids = tuple(r.t for r in part), [r.k for r in part]
        words = Words(*text_bytes(pa.array(texts, pa.string())), ALNUM, LOWER, hashed=False)
        planned = tuple((n, planned_repetitions(n, recall)) for n in sorted(set(np.diff(words.first).tolist()) - {0}))
        found = docs.mapInArrow(lambda b, texts=texts, ids=ids, planned=planned: _search(b, texts, ids, id_type, planned), kind)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of df whose texts hold none of the items; all columns stay. Equal texts share their fate, whatever their ids.

    Null and empty texts hold nothing and stay; repeated rows stay; an empty table, or one of items, takes nothing away.
    """
    text = (F.coalesce(F.col(text_col), F.lit("")),)
    hashes = {name: x for name, x in zip(fresh(df, "__h1", "__h2"), (F.xxhash64(*text), F.xxhash64(F.lit("second"), *text)), strict=True)}
    keyed = df.select(F.struct(*[x.alias(f"h{k}") for k, x in enumerate(hashes.values(), 1)]).alias("key"), F.col(text_col).alias("text"))
    found = find_items(keyed, items, "key", "text", item_col, item_text)
    hit = materialise(found.select(*[F.col(f"key.h{k}").alias(name) for k, name in enumerate(hashes, 1)]).distinct())
    return df.withColumns(hashes).join(small(hit), list(hashes), "left_anti").select(df.columns)
