"""Shared pieces of the corpus operators: rows by content, Arrow batches, vectorised tokenising and hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.scratch import BROADCAST_BYTES, discard, lean_batches, materialise, scratch_dir, small  # noqa: F401

#: Bytes of text that a worker turns into arrays at once.
SLICE_BYTES = 1 << 20

M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))


# ---------------------------------------------------------------- rows by content


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def row_key(id_col: str, text_col: str) -> Column:
    """A row by its content: (id is null, id, two 64-bit hashes of id and text). Keys sort by id, null ids last."""
    both = (F.col(id_col).cast("string"), F.col(text_col))
    hashes = (F.xxhash64(F.col(id_col).isNull(), *both), F.xxhash64(F.lit("second"), *both))
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), hashes[0].alias("h1"), hashes[1].alias("h2"))


def one_row_each(df: DataFrame, id_col: str, text_col: str, classes) -> DataFrame:
    """df with one row of each class, that of smallest key: smallest id, null ids last. All columns stay.

    classes: (df of a column row with the keys and a column text) -> row, class (the smallest key in it) of all rows
    in classes of two rows or more. Rows that repeat id and text have one key; one of them stays.
    """
    h1, h2 = fresh(df, "__h1", "__h2")
    key = row_key(id_col, text_col)
    found = materialise(classes(df.select(key.alias("row"), F.col(text_col).alias("text"))).select(F.col("row.h1").alias(h1), F.col("row.h2").alias(h2), (F.col("row") == F.col("class")).alias("stays")))
    gone = materialise(found.where("NOT stays").select(h1, h2).distinct())
    again = materialise(found.where("stays").groupBy(h1, h2).count().where("count > 1").select(h1, h2))
    discard(found)
    left = df.withColumns({h1: key.h1, h2: key.h2}).join(small(gone), [h1, h2], "left_anti")
    if again.take(1):
        twice = small(again)
        left = left.join(twice, [h1, h2], "left_anti").unionByName(left.join(twice, [h1, h2], "left_semi").dropDuplicates([h1, h2]))
    return left.select(df.columns)


# ---------------------------------------------------------------- Arrow batches


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about most bytes of text; a longer text stands alone."""
    _lean()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(lo, hi - lo)
    trim()


@functools.cache
def _lean() -> None:
    """Once a worker: one arena, whose end goes back to the system, and pages of their own for very large arrays.

    Smaller arrays reuse the arena: pages of their own for each of them cost half as much CPU again.
    """
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no mallopt
        libc = ctypes.CDLL("libc.so.6")
        for what, value in ((-3, 16 << 20), (-1, 64 << 20), (-8, 1)):  # mmap threshold, trim threshold, arenas
            libc.mallopt(what, value)


def trim() -> None:
    """Give freed memory back to the system: Python workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def packed(arrays: list[np.ndarray], dtype) -> pa.Array:
    """A binary column that holds each array's bytes."""
    return pa.array([np.ascontiguousarray(a, dtype).tobytes() for a in arrays], pa.binary())


def packed_flat(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of values[bounds[i]:bounds[i+1]]."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


# ---------------------------------------------------------------- words


def _table(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Words of any byte but space and \x09-\x0D.
PLAIN = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of ASCII digits, letters and all of non-ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80)
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[0x41:0x5B] += 32

#: For bytes.translate: A-Z in lower case, and every byte that is not in a word to a space.
ALNUM_LOWER_SPACES = bytes(LOWER[b] if ALNUM[b] else 0x20 for b in range(256))
PLAIN_LOWER = bytes(LOWER.tolist())

_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE64 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
@functools.cache
def _all_powers(inverse: bool) -> np.ndarray:
    steps = np.full(2 * SLICE_BYTES + 1, BASE_INV if inverse else BASE, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1), or those of its inverse, modulo 2**64."""
    have = _all_powers(inverse)
    if n <= len(have):
        return have[:n]
    steps = np.full(n, BASE_INV if inverse else BASE, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a slice of texts: starts, ends (bytes), first (index of each text's first word; one more at the end), hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, inside: np.ndarray, fold: np.ndarray = IDENTITY, hashed: bool = True):
        self.data, self.offs = data, offs
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(data), 4 * SLICE_BYTES):  # a block of bytes at a time, so that masks stay small for texts of any length
            hi = min(lo + 4 * SLICE_BYTES, len(data))
            word = np.zeros(hi - lo + 2, bool)
            word[1:-1] = inside[data[lo:hi]]
            word[0], word[-1] = lo > 0 and inside[data[lo - 1]], hi < len(data) and inside[data[hi]]
            edge = np.zeros(hi - lo + 1, bool)
            edge[offs[np.searchsorted(offs, lo) : np.searchsorted(offs, hi, "right")] - lo] = True
            inner = word[1:-1]
            starts.append(np.flatnonzero(inner & (~word[:-2] | edge[:-1])) + lo)
            ends.append(np.flatnonzero(inner & (~word[2:] | edge[1:])) + lo + 1)
        self.starts, self.ends = np.concatenate(starts), np.concatenate(ends)
        self.first = np.searchsorted(self.starts, offs)
        self.hashes = self._hash(fold) if hashed else None

    def _hash(self, fold: np.ndarray) -> np.ndarray:
        values, out, n = _BYTE64[fold], np.empty(len(self.starts), np.uint64), len(self.starts)
        lo = 0
        while lo < n:  # a block of words at a time, so that memory stays flat for texts of any length
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + SLICE_BYTES)))
            a, b = self.starts[lo], self.ends[hi - 1]
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(values[self.data[a:b]] * powers(b - a), out=sums[1:])
            s, e = self.starts[lo:hi] - a, self.ends[lo:hi] - a
            out[lo:hi] = (sums[e] - sums[s]) * powers(b - a, True)[s] + (e - s).astype(np.uint64) * GOLD
            lo = hi
        return mix(out)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values that start at each place; len - k + 1 of them (none if fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 6:
        out = hashes[:n].copy()
        for j in range(1, k):
            out = out * M1 + hashes[j : j + n]
        return mix(out + np.uint64(k))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes)), out=sums[1:])
    return mix((sums[k : k + n] - sums[:n]) * powers(n, True) + np.uint64(k))


def spread(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of k words over texts whose words begin at first: mask of whole windows over all len - k + 1 places, and windows per text."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    total = int(first[-1]) - k + 1
    if total <= 0:
        return np.zeros(0, bool), counts
    mask = np.zeros(total + 1, np.int32)
    np.add.at(mask, np.minimum(first[:-1], total)[counts > 0], 1)
    np.add.at(mask, np.minimum(first[:-1] + counts, total)[counts > 0], -1)
    return np.cumsum(mask[:-1]) > 0, counts


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def crc_bucket(column: str, modulus: int):
    """crc32 of an id as text, modulo modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def hash_sample(df: DataFrame, id_col: str, rows: int, text_col: str | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """Distinct rows of df, the same ones each time: those of smallest hash, `rows` of them and `most_bytes` of text at most.

    Rows without an id are left out, and so are texts of more than a hundredth of most_bytes; repeated rows count once.
    """
    own = F.xxhash64(F.col(id_col), F.lit(11))
    some = df.where(F.col(id_col).isNotNull())
    known = some.agg(F.approx_count_distinct(own)).first()[0]
    cut = min(1.5 * rows / max(known, 1), 1.0) * 2**64 - 2**63
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") if text_col else F.lit(0).cast("long")
    some = some.where((own <= F.lit(min(int(cut), 2**63 - 1))) & (size <= most_bytes // 100))
    key = F.struct(own.alias("own"), F.xxhash64(*df.columns).alias("row"))
    found = some.select(key.alias("key"), size.alias("size")).distinct().orderBy("key").limit(rows).collect()  # `rows` pairs of numbers
    room, last = most_bytes, (-(2**63), -(2**63))
    for r in found:
        room -= r["size"]
        if room < 0:
            break
        last = (r.key.own, r.key.row)
    return some.where(key <= F.struct(F.lit(last[0]).cast("long").alias("own"), F.lit(last[1]).cast("long").alias("row"))).distinct()
