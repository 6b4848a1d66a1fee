"""Exact deduplication by counting quotient filters and byte verification.

Each partition of documents builds a counting quotient filter over 64-bit fingerprints: the high bits (quotient)
name a canonical slot, the low bits (remainder) are stored sorted in that slot's run, each with a count. Filters
over the same quotient space merge without loss, by merging each run's sorted remainders and adding counts.
Here a filter travels as slabs (equal shares of the quotient space), so every slab of the merged filter is built
by one task from one slab per partition, whatever the size of a group of copies. Fingerprints whose merged count
is above one route their documents to byte verification: those texts are grouped by their very bytes. All other
documents are unique and never leave the scan.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import BROADCAST_BYTES, discard, materialise, one_row_each, small, trim

WHITESPACE = "[\\x20\\x09-\\x0D]+"
#: Bits of a remainder. The other 24 are the quotient.
REMAINDER_BITS = 40
#: Fingerprints that one slab of the merged filter holds on average, at most.
SLAB_ROWS = 1_000_000


class QuotientFilter:
    """A counting quotient filter over quotients [first, first + size): occupieds, runends, sorted remainders and their counts."""

    def __init__(self, first: int, size: int, occupied: np.ndarray, run_length: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.first, self.size, self.occupied, self.run_length, self.remainders, self.counts = first, size, occupied, run_length, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, first: int = 0, size: int = 1 << (64 - REMAINDER_BITS)) -> QuotientFilter:
        """From fingerprints in any order, repeated or not; counts default to one each."""
        fingerprints = np.asarray(fingerprints, np.uint64)
        counts = np.ones(len(fingerprints), np.uint64) if counts is None else np.asarray(counts, np.uint64)
        order = np.argsort(fingerprints, kind="stable")
        keys, counts = fingerprints[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return cls._sorted(keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts, first, size)

    def fingerprints(self) -> np.ndarray:
        quotients = np.repeat(self.occupied.astype(np.uint64) + np.uint64(self.first), self.run_length)
        return (quotients << np.uint64(REMAINDER_BITS)) | self.remainders

    def merge(self, *others: QuotientFilter) -> QuotientFilter:
        """The filter of all their members together. Runs merge by sorted remainder; counts add up; nothing is lost.

        Filters are merged two by two, the smallest first, so that a member takes part in about log(filters) merges.
        """
        if any((x.first, x.size) != (self.first, self.size) for x in others):
            raise ValueError("filters of different quotient ranges don't merge")
        queue = [(len(x.remainders), k, x) for k, x in enumerate((self, *others))]
        heapq.heapify(queue)
        while len(queue) > 1:
            (_, k, x), (_, _, y) = heapq.heappop(queue), heapq.heappop(queue)
            both = x._with(y)
            heapq.heappush(queue, (len(both.remainders), k, both))
        return queue[0][2]

    def _with(self, other: QuotientFilter) -> QuotientFilter:
        """Merge two sorted sequences of (quotient, remainder): each member of the shorter finds its place in the longer one."""
        a, b = (self, other) if len(self.remainders) >= len(other.remainders) else (other, self)
        x, y = a.fingerprints(), b.fingerprints()
        at = np.searchsorted(x, y)
        same = at < len(x)
        same[same] = x[at[same]] == y[same]
        counts = a.counts.copy()
        counts[at[same]] += b.counts[same]
        keys, sums = np.insert(x, at[~same], y[~same]), np.insert(counts, at[~same], b.counts[~same])
        return QuotientFilter._sorted(keys, sums, self.first, self.size)

    @classmethod
    def _sorted(cls, keys: np.ndarray, counts: np.ndarray, first: int, size: int) -> QuotientFilter:
        quotients = (keys >> np.uint64(REMAINDER_BITS)).astype(np.int64) - first
        starts = np.flatnonzero(np.concatenate([[True], quotients[1:] != quotients[:-1]])) if len(keys) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(keys)))
        return cls(first, size, quotients[starts].astype(np.uint32), lengths.astype(np.uint32), keys & np.uint64((1 << REMAINDER_BITS) - 1), counts)

    def count(self, fingerprint: int) -> int:
        """How often a fingerprint was added: walk to its quotient's run, then search the sorted remainders."""
        quotient, remainder = (fingerprint >> REMAINDER_BITS) - self.first, fingerprint & ((1 << REMAINDER_BITS) - 1)
        at = int(np.searchsorted(self.occupied, quotient))
        if at == len(self.occupied) or self.occupied[at] != quotient:
            return 0
        lo = int(self.run_length[:at].sum())
        run = self.remainders[lo : lo + int(self.run_length[at])]
        k = int(np.searchsorted(run, np.uint64(remainder)))
        return int(self.counts[lo + k]) if k < len(run) and run[k] == remainder else 0

    def slabs(self, bits: int) -> Iterator[tuple[int, QuotientFilter]]:
        """Its parts by the quotient's highest bits."""
        share = self.size >> bits
        slab = self.occupied // share
        bounds = np.searchsorted(slab, np.arange((1 << bits) + 1))
        ends = np.concatenate([[0], np.cumsum(self.run_length, dtype=np.int64)])
        for k in np.unique(slab):
            lo, hi = bounds[k], bounds[k + 1]
            yield int(k), QuotientFilter(self.first + int(k) * share, share, self.occupied[lo:hi] - np.uint32(k * share), self.run_length[lo:hi], self.remainders[ends[lo] : ends[hi]], self.counts[ends[lo] : ends[hi]])

    def pack(self) -> bytes:
        """Remainders in five bytes each; a count is stored only for members that have more than one."""
        many = np.flatnonzero(self.counts > 1).astype(np.uint32)
        low = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : REMAINDER_BITS // 8]
        return struct.pack("<qqIII", self.first, self.size, len(self.occupied), len(self.remainders), len(many)) + self.occupied.tobytes() + self.run_length.tobytes() + many.tobytes() + self.counts[many].tobytes() + low.tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> QuotientFilter:
        first, size, n_occupied, n, n_many = struct.unpack_from("<qqIII", raw)
        at = struct.calcsize("<qqIII")

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        occupied, run_length, many, high = take(np.uint32, n_occupied), take(np.uint32, n_occupied), take(np.uint32, n_many), take(np.uint64, n_many)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, : REMAINDER_BITS // 8] = take(np.uint8, n * (REMAINDER_BITS // 8)).reshape(n, -1)
        counts = np.ones(n, np.uint64)
        counts[many] = high
        return cls(first, size, occupied, run_length, wide.view("<u8").ravel(), counts)


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def _filters(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The filter of a partition, in slabs. Filters of batches merge as their sizes double, so building takes n log n steps."""
    stack: list[QuotientFilter] = []
    for batch in batches:
        stack.append(QuotientFilter.build(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
        while len(stack) > 1 and len(stack[-2].remainders) <= 2 * len(stack[-1].remainders):
            stack.append(stack.pop().merge(stack.pop()))
    if stack:
        for k, part in stack[0].merge(*stack[1:]).slabs(bits):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.pack()], pa.binary())], names=["slab", "filter"])
    stack.clear()
    trim()


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    first, *others = [QuotientFilter.unpack(raw) for raw in pdf["filter"]]
    whole = first.merge(*others)
    return pd.DataFrame({"fp": whole.fingerprints()[whole.counts > 1].view(np.int64)})


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """fingerprints: one long column of about so many rows. Returns those that occur more than once, each once, as fp."""
    bits = min(20, max(6, (rows // SLAB_ROWS).bit_length()))
    return fingerprints.mapInArrow(lambda batches: _filters(batches, bits), "slab int, filter binary").groupBy("slab").applyInPandas(_merged, "fp long")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they have the same bytes after white space is normalised. The smallest id of a group stays.
    Null and empty texts are equal to each other and form a group. Rows that repeat an id count as rows of their own;
    a null id sorts last and is kept only if its whole group has none. Other columns don't matter. An empty table
    gives an empty result.
    """
    norm = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("fp", F.xxhash64("norm"))
    rows = materialise(norm.select("id", "fp", F.sha2("norm", 256).alias("sha")))
    repeated = materialise(repeated_fingerprints(rows.select("fp"), rows.count()))
    again = small(repeated, broadcast_bytes)
    # Byte verification: the grouping key is the text itself, combined before the shuffle, so that copies travel once per task.
    exact = norm.join(again, "fp", "left_semi").groupBy("fp", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(exact.select("fp", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size").where("group_size > 1"))
    discard(repeated)
    out = rows.join(small(groups, broadcast_bytes), ["fp", "sha"], "left")
    keep, size = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")), F.coalesce("group_size", F.lit(1).cast("long"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without exact copies: of equal texts the row of smallest id stays, one without an id only if none has one.

    Texts are equal as in exact_dedup; null and empty ones are equal to each other. Decisions are by row: rows that
    share an id but not their text are judged apart, and of rows that repeat both one stays. All columns stay; an empty
    table gives an empty result.
    """

    def classes(keyed: DataFrame) -> DataFrame:
        return exact_dedup(keyed, "row").where("group_size > 1").select("row", F.col("keep_id").alias("class"))

    return one_row_each(df, id_col, text_col, classes)
