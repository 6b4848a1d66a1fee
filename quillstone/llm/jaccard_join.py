"""N-gram Jaccard self-join by parity sketches, and the groups that its links form.

Every document is a set of shingle hashes. XOR-ing hashes into a sketch makes a parity sketch: a shingle that both
documents have cancels out, so the sketches differ in at most as many places as the sets do. Two sets of a and b
shingles whose Jaccard similarity is t or more differ in at most (1 - t) / (1 + t) * (a + b) shingles.

1. Sizes fall into bands, and each band allows at most d differences. The sketch of a band has places of 64 bits. A
   document of n shingles uses the first D + 1 + s of them, where D is the most differences that it can have to a
   larger partner and s some slack; by the pigeonhole principle a linked pair agrees in s + 1 places that both use.
   Each place is a join key. A document at the top of a band also takes part in the next one. Places that are empty
   are keys only for documents with more than s of them, since any other pair agrees in a place that isn't.
2. Documents with identical sets are one member from the start: in lists of a key, a member is the fingerprint of its
   set. Keys are grouped per batch before the shuffle; a key's group is a list of members, in blocks of bounded size.
   Keys are made from the texts when they are shuffled and stored nowhere else.
3. Since linked pairs agree in s + 1 places, each document leaves out its s keys of longest lists (less its empty
   places): of the keys that a linked pair shares, the one of shortest list is left out by neither. So passages that
   very many documents have cost little.
4. In a list, one-bit parity sketches (popcount of XOR) prune pairs exactly, by the same bound. Pairs that are left
   join members to families, so that all links lie within families. First each member is compared with the head of its
   list alone, and such pairs are few, since lists of one group share their heads. Only lists that hold members of
   several families after that are compared in full.
5. A family of bounded size is compared in one task, and each member travels there once: pairs that the sketches
   leave are verified on the shingle sets themselves, unless links have joined them already. Larger families are
   compared list by list, block against block.
6. Groups are the connected components of verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import LOWER, PLAIN, Words, discard, grams, materialise, mix, one_row_each, packed, packed_flat, signed, slices, small, text_bytes
from quillstone.llm.components import components

#: Members of a block of a list.
BLOCK = 512
#: Members, and shingles of all of them, that a family compared in one task may have.
FAMILY = (4096, 4_000_000)
BAND_RATIO = 1.6
BAND_BITS = 6
#: One place of slack for so many differences.
SLACK = 8
#: Keys that a worker groups before it sends them on.
HELD = 500_000


class Threshold:
    """Jaccard similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def differences(self, both):
        """Most differences that sets of together so many shingles can have."""
        return (self.den - self.num) * both // (self.den + self.num)

    def bands(self, largest: int = 1 << 40) -> np.ndarray:
        first = 1
        while not self.differences(2 * first + 1):
            first += 1
        edges = [first]
        while edges[-1] < largest:
            edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_RATIO)))
        return np.array(edges, np.int64)


def shingle_sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; with fewer words, of the whole sequence; with none, empty."""
    words = Words(*text_bytes(batch.column("text")), PLAIN, LOWER)
    flat, first = grams(words.hashes, k), words.first.tolist()
    out = []
    for lo, hi in zip(first, first[1:], strict=False):
        if hi - lo >= k:
            out.append(np.unique(flat[lo : hi - k + 1]))
        else:
            out.append(grams(words.hashes[lo:hi], hi - lo))
    return out


def parity_bits(shingles: np.ndarray, places: int) -> np.ndarray:
    """Parity sketch of one bit a place; places is a power of two. Halves XOR-ed together are the sketch of half the size."""
    odd = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def band_of(n: int, edges: np.ndarray) -> int:
    return int(np.searchsorted(edges, n, "right")) - 1


def bands_of(n: int, edges: np.ndarray, threshold: Threshold) -> tuple[int, ...]:
    """The bands that a document of n shingles takes part in: its own, and the next one if a partner can be there."""
    band = band_of(n, edges)
    if band < 0:
        return ()
    return (band, band + 1) if n * threshold.den >= edges[band + 1] * threshold.num else (band,)


def band_places(shingles: np.ndarray, band: int, edges: np.ndarray, threshold: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places in use that are not empty, XOR of the shingles in each, empty places in use, slack) of a document in a band."""
    n = len(shingles)
    most = int(threshold.differences(2 * (edges[band + 1] - 1)))
    slack = 1 + most // SLACK
    places = most + 1 + slack
    used = min(places, int(threshold.differences(n + n * threshold.den // threshold.num)) + 1 + slack)
    place = (shingles >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)
    inside = int(np.searchsorted(place, used))  # shingles are sorted, and so are their places
    place, shingles = place[:inside].astype(np.int64), shingles[:inside]
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    empty = np.ones(used, bool)
    empty[place[starts]] = False
    return place[starts], np.bitwise_xor.reduceat(shingles, starts) if len(starts) else shingles, np.flatnonzero(empty), slack


def band_keys(shingles: np.ndarray, edges: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Keys of a document's places. The last BAND_BITS bits of a key are those of its band."""
    out = [np.zeros(0, np.uint64)]
    for band in bands_of(len(shingles), edges, threshold):
        place, xor, empty, slack = band_places(shingles, band, edges, threshold)
        salt = np.uint64(band << 40)
        keys = [mix(xor ^ mix(place.astype(np.uint64) + salt))]
        if len(empty) > slack:
            keys.append(mix(mix(empty.astype(np.uint64) + salt)))
        out += [(x >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS)) | np.uint64(band & ((1 << BAND_BITS) - 1)) for x in keys]
    return np.concatenate(out)


def spare_keys(shingles: np.ndarray, edges: np.ndarray, threshold: Threshold) -> tuple[int, int]:
    """How many keys a document may leave out in its own band and in the next one."""
    out = [0, 0]
    for j, band in enumerate(bands_of(len(shingles), edges, threshold)):
        _, _, empty, slack = band_places(shingles, band, edges, threshold)
        out[j] = max(0, slack - len(empty))
    return out[0], out[1]


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    sums = np.array([int(np.sum(mix(s), dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
    xors = np.array([int(np.bitwise_xor.reduce(mix(~s))) if len(s) else 0 for s in sets], np.uint64)
    return sums, xors


def _sketch(batches: Iterator[pa.RecordBatch], k: int, threshold: Threshold) -> Iterator[pa.RecordBatch]:
    edges = threshold.bands()
    for batch in slices(batches):
        sets = shingle_sets(batch, k)
        f1, f2 = fingerprints(sets)
        sketches = [parity_bits(s, 1 << max(8, len(s).bit_length())) for s in sets]
        spares = [spare_keys(s, edges, threshold) for s in sets]
        numbers = [pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(f1)), pa.array(signed(f2))]
        small_numbers = [pa.array(x, pa.int32()) for x in ([band_of(len(s), edges) for s in sets], [x for x, _ in spares], [x for _, x in spares])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("k"), *numbers, packed(sketches, np.uint64), *small_numbers],
            names=["id", "k", "n", "f1", "f2", "sketch", "band", "spare", "spare_next"],
        )


def _keys(batches: Iterator[pa.RecordBatch], k: int, threshold: Threshold) -> Iterator[pa.RecordBatch]:
    """Members of each key among many texts: a key that very many documents have leaves a task a few times, not once each."""
    edges, held, room = threshold.bands(), [], HELD
    for batch in slices(batches):
        sets = shingle_sets(batch, k)
        keys = [band_keys(s, edges, threshold) for s in sets]
        held.append((np.concatenate(keys), np.repeat(fingerprints(sets)[0], [len(x) for x in keys])))
        room -= len(held[-1][0])
        if room < 0:
            yield _grouped(held)
            held, room = [], HELD
    if held:
        yield _grouped(held)


def _grouped(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys, members = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]).view(np.int64)
    order = np.lexsort((members, keys))
    keys, members = keys[order], members[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (members[1:] != members[:-1])
    keys, members = keys[fresh], members[fresh]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed(keys[starts])), packed_flat(members, np.append(starts, len(keys)))], names=["key", "members"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key -> lists of two members or more, in blocks. Holds one block of one key at a time."""
    out: list[tuple[int, int, bool, bytes]] = []
    key, held, block = None, np.zeros(0, np.int64), 0

    def close() -> None:
        if len(held) > 1 or (block and len(held)):
            out.append((key, block, block > 0, held.tobytes()))

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=["key", "block", "many", "members"])
        out.clear()
        return batch

    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        data, offs = text_bytes(batch.column("members"))
        members, offs = data.view(np.int64) if len(data) else np.zeros(0, np.int64), offs // 8
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], len(keys))
        lone = offs[ends] - offs[starts] == 1  # in this batch; the first and the last may go on in others
        lone[[0, -1]] = False
        for s, e in zip(starts[~lone].tolist(), ends[~lone].tolist(), strict=True):
            if keys[s] != key:
                close()
                key, held, block = int(keys[s]), np.zeros(0, np.int64), 0
            held = np.union1d(held, members[offs[s] : offs[e]])
            while len(held) > BLOCK:
                out.append((key, block, True, held[:BLOCK].tobytes()))
                held, block = held[BLOCK:], block + 1
        if len(out) >= 2000:
            yield flush()
    close()
    yield flush()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists -> (key, size, f1). All blocks of a list of many count as of one size, so that a key's size is the same everywhere."""
    for batch in slices(batches, "members", 4 << 20):
        data, offs = text_bytes(batch.column("members"))
        sizes = np.where(batch.column("many").to_numpy(zero_copy_only=False), BLOCK + 1, np.diff(offs) // 8)
        row = np.repeat(np.arange(batch.num_rows), np.diff(offs) // 8)
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), pa.array(sizes[row].astype(np.int32)), pa.array(data.view(np.int64))], names=["key", "size", "f1"])


def _regrouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) -> members of each key among many rows, as _lists takes them: a key of very many ids leaves a task a few times."""
    held, room = [], HELD
    for batch in batches:
        held.append((batch.column("key").to_numpy().view(np.uint64).copy(), batch.column("id").to_numpy().copy()))
        room -= batch.num_rows
        if room < 0:
            yield _grouped(held)
            held, room = [], HELD
    if held:
        yield _grouped(held)


def _near_pairs(batches: Iterator[pa.RecordBatch], threshold: Threshold) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sketches those that are as near as linked pairs."""
    for batch in slices(batches, "bits", 4 << 20):
        sizes = [batch.column(c).to_numpy() for c in ("n", "m")]
        sides = [text_bytes(batch.column(c)) for c in ("bits", "other")]
        widths = [np.diff(offs) // 8 for _, offs in sides]
        most, near = threshold.differences(sizes[0] + sizes[1]), np.zeros(batch.num_rows, bool)
        for pair in np.unique(np.stack(widths, axis=1), axis=0).tolist():
            rows = np.flatnonzero((widths[0] == pair[0]) & (widths[1] == pair[1]))
            folded = []
            for (data, offs), width in zip(sides, pair, strict=True):
                x = data.view(np.uint64)[offs[rows][:, None] // 8 + np.arange(width)]
                while x.shape[1] > min(pair):
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                folded.append(x)
            near[rows] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1, dtype=np.int64) <= most[rows]
        near &= np.abs(sizes[0] - sizes[1]) <= most
        yield batch.select(["a", "b"]).filter(pa.array(near))


def joined(ids: np.ndarray, sides: np.ndarray, sizes: np.ndarray, groups: np.ndarray, sketches: np.ndarray, threshold: Threshold, accept) -> list[tuple[int, int]]:
    """Accepted pairs that join all of these members that accepted pairs join. With two sides, only pairs across count.

    Members of one group (a number from 0 on, one number for each group) are joined already.
    """
    label, cross, out = groups.copy(), bool(sides.any()), []
    for i in range(len(ids) - 1):
        j = np.arange(i + 1, len(ids))
        j = j[(label[j] != label[i]) & ((sides[j] != sides[i]) if cross else True)]
        most = threshold.differences(sizes[i] + sizes[j])
        fits = np.abs(sizes[j] - sizes[i]) <= most
        j, most = j[fits], most[fits]
        if not len(j):
            continue
        hamming = np.bitwise_count(sketches[j] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        for k in j[hamming <= most].tolist():
            if label[k] != label[i] and ids[k] != ids[i] and accept(i, k):
                label[label == label[k]] = label[i]
                out.append((int(ids[i]), int(ids[k])))
    return out


def _by_item(batches: Iterator[pa.RecordBatch], compare) -> Iterator[pa.RecordBatch]:
    """Batches sorted by item -> pairs (a, b) that compare finds among an item's rows. Holds one item at a time."""
    item, held, found = None, [], []

    def close() -> None:
        if len(held) > 1:
            held[:] = {r[:2]: r for r in held}.values()  # repeated rows carry one member
            held.sort(key=lambda r: r[:2])
            groups = np.unique([r[4] for r in held], return_inverse=True)[1]
            found.extend(compare(np.array([r[1] for r in held]), np.array([r[0] for r in held]), [np.frombuffer(r[2], np.uint64) for r in held], np.array([r[3] for r in held]), groups))
        held.clear()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        found.clear()
        return batch

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("item", "side", "id", "bits", "n", "family")), strict=True):
            if row[0] != item:
                close()
                item = row[0]
            held.append(row[1:])
        yield flush()
    close()
    yield flush()


def _near(batches: Iterator[pa.RecordBatch], threshold: Threshold) -> Iterator[pa.RecordBatch]:
    """Pairs whose parity sketches are as near as those of linked pairs."""

    def compare(ids, sides, bits, sizes, groups):
        width = min(map(len, bits))
        return joined(ids, sides, sizes, groups, np.stack([fold(b, width) for b in bits]), threshold, lambda i, k: True)

    return _by_item(batches, compare)


def _links(batches: Iterator[pa.RecordBatch], threshold: Threshold) -> Iterator[pa.RecordBatch]:
    """Pairs whose shingle sets are similar enough."""

    def compare(ids, sides, sets, sizes, groups):
        places = 1 << max(9, (4 * int(np.median(sizes))).bit_length())

        def accept(i: int, k: int) -> bool:
            both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            return threshold.den * both >= threshold.num * int(sizes[i] + sizes[k] - both)

        return joined(ids, sides, sizes, groups, np.stack([parity_bits(s, places) for s in sets]), threshold, accept)

    return _by_item(batches, compare)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The members' shingle sets; a text whose set is not the member's (its row key only looks alike) is passed over."""
    for batch in slices(batches):
        sets = shingle_sets(batch, k)
        f1, f2 = fingerprints(sets)
        same = (signed(f1) == batch.column("f1").to_numpy()) & (signed(f2) == batch.column("f2").to_numpy())
        rows = np.flatnonzero(same)
        sets, where = [sets[j] for j in rows.tolist()], pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("item").take(where), batch.column("side").take(where), batch.column("id").take(where), packed(sets, np.uint64), pa.array([len(s) for s in sets], pa.int64()), batch.column("id").take(where)],
            names=["item", "side", "id", "bits", "n", "family"],
        )


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, similarity: tuple[int, int] = (85, 100)) -> DataFrame:
    """Per row: id, n_shingles, component_id.

    Words are runs of anything but white space, with A-Z in lower case. Documents link when their shingle sets have a
    Jaccard similarity of similarity[0] / similarity[1] or more; component_id is the smallest id that links reach.
    Ids may be of any type that can be compared. Null and empty texts have no shingles and link with nothing. Every row
    is a document of its own, also those that repeat an id; rows without an id link like others, and a group of such
    rows alone has a null component_id. Other columns don't matter; an empty table gives an empty result.
    """
    threshold = Threshold(*similarity)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"))
    kind, per_set = dict(docs.dtypes)["id"], ["f1", "f2", "n"]
    described = f"id {kind}, k long, n long, f1 long, f2 long, sketch binary, band int, spare int, spare_next int"
    base = materialise(docs.mapInArrow(lambda b: _sketch(b, shingle_words, threshold), described).withColumn("node", F.monotonically_increasing_id()))
    sets = materialise(base.where("n > 0").groupBy(per_set).agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("copies")))
    members = base.join(small(sets.select("node")), "node", "left_semi").drop("id").withColumnRenamed("node", "id")
    entries = _entries(docs.select("text").mapInArrow(lambda b: _keys(b, shingle_words, threshold), "key long, members binary"), members)
    families = _families(entries, members.select("id", "n", F.col("sketch").alias("bits")), threshold)
    compared = "a long, b long"
    sized = families.join(sets.select("node", "n"), "node").groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    sized = materialise(sized.select("component", ((F.col("members") <= FAMILY[0]) & (F.col("shingles") <= FAMILY[1])).alias("whole")))
    rows = families.join(sized.where("whole"), "component").select(F.col("component").alias("item"), F.lit(0).alias("side"), F.col("node").alias("id"))
    if sized.where("NOT whole").take(1):
        large = families.join(sized.where("NOT whole"), "component").select(F.col("node").alias("id"))
        rows = rows.unionByName(_blocks(_by_key(entries.join(large, "id", "left_semi").mapInArrow(_regrouped, "key long, members binary"))))
    rows = materialise(rows.join(members.select("id", "k", "f1", "f2"), "id"))
    discard(entries)
    shingles = docs.select("k", "text").join(small(rows), "k").select("item", "side", "id", "f1", "f2", "text")
    shingles = shingles.mapInArrow(lambda b: _sets(b, shingle_words), "item long, side int, id long, bits binary, n long, family long")
    links = shingles.repartition(F.col("item")).sortWithinPartitions("item").mapInArrow(lambda b: _links(b, threshold), compared)
    groups = components(links)
    discard(rows, families, sized)

    # Only sets that several rows have or that are linked need a lookup: any other row is its own component.
    shared = sets.join(small(groups), "node", "left").where("copies > 1 OR component IS NOT NULL")
    shared = materialise(shared.select(*per_set, F.coalesce("component", "node").alias("component")))
    least = base.select("id", *per_set).join(small(shared), per_set).groupBy("component").agg(F.min("id").alias("least"))
    named = materialise(shared.join(small(materialise(least)), "component").select(*per_set, F.struct("least").alias("found")))
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles")]
    out = base.where("n > 0").select("id", *per_set).join(small(named), per_set, "left").select(*columns, F.when(F.col("found").isNull(), F.col("id")).otherwise(F.col("found.least")).alias("component_id"))
    discard(groups, shared, sets)
    return out.unionByName(base.where("n = 0").select(*columns, F.col("id").alias("component_id")))


def _by_key(members: DataFrame) -> DataFrame:
    """Rows (key, members) -> lists (key, block, many, members) of keys with two members or more."""
    dealt = members.repartition(F.col("key")).sortWithinPartitions("key")
    return dealt.mapInArrow(_lists, "key long, block int, many boolean, members binary").where("key IS NOT NULL")


def _entries(keys: DataFrame, members: DataFrame) -> DataFrame:
    """(key, id) of the keys that members share with others, without those of longest lists that each may leave out."""
    lists = materialise(_by_key(keys))
    shared = lists.mapInArrow(_opened, "key long, size int, f1 long").join(members.select("f1", "id", "band", "spare", "spare_next"), "f1")
    band = F.col("key").bitwiseAND((1 << BAND_BITS) - 1)
    own = band == F.col("band") % (1 << BAND_BITS)
    longest_first = Window.partitionBy("id", band).orderBy(F.desc("size"), "key")
    kept = shared.withColumn("nth", F.row_number().over(longest_first)).where(F.col("nth") > F.when(own, F.col("spare")).otherwise(F.col("spare_next")))
    out = materialise(kept.select("key", "id"))
    discard(lists)
    return out


def _families(entries: DataFrame, described: DataFrame, threshold: Threshold) -> DataFrame:
    """(node, component) of the members that pairs with near sketches join. described: id, n, bits of each member."""
    compared = "a long, b long"
    heads = entries.groupBy("key").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "b")
    pairs = entries.join(heads, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    left, right = described.select(F.col("id").alias("a"), "n", "bits"), described.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("other"))
    near = materialise(pairs.join(left, "a").join(right, "b").select("a", "n", "bits", "b", "m", "other").mapInArrow(lambda b: _near_pairs(b, threshold), compared))
    first = components(near)

    named = first.select(F.col("node").alias("id"), F.col("component").alias("family"))
    family = F.coalesce("family", "id")
    several = entries.join(small(named), "id", "left").groupBy("key").agg(F.min(family).alias("least"), F.max(family).alias("most"), F.count(F.lit(1)).alias("size"))
    several = materialise(several.where("least < most AND size > 2").select("key"))
    rest = materialise(_by_key(entries.join(small(several), "key", "left_semi").mapInArrow(_regrouped, "key long, members binary")))
    known = described.join(small(named), "id", "left").withColumn("family", family)
    more = _blocks(rest).join(known, "id").repartition(F.col("item")).sortWithinPartitions("item").mapInArrow(lambda b: _near(b, threshold), compared)
    out = components(near.unionByName(more))
    discard(near, first, several, rest)
    return out


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of df with one row of each group of linked documents: that of smallest id, one without an id only if none has one.

    Groups are those of jaccard_components. Texts without words are in no group, so all of them stay, but for rows that
    repeat both id and text, of which one stays, as of all such rows. All columns stay; an empty table gives an empty result.
    """

    def classes(keyed: DataFrame) -> DataFrame:
        found = jaccard_components(keyed, "row", shingle_words=shingle_words, similarity=similarity)
        moved = materialise(found.where("component_id <> row").select("row", F.col("component_id").alias("class")))
        repeated = found.groupBy("row").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("row", F.col("row").alias("class"))
        repeated = repeated.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
        return moved.unionByName(repeated)

    return one_row_each(df, id_col, text_col, classes)


def _blocks(lists: DataFrame) -> DataFrame:
    """Rows (item, side, id) of all lists and, for lists of several blocks, of each two of them."""
    many = lists.where("many").select("key", "block", "members")
    crossed = many.join(many.select("key", F.col("block").alias("other"), F.col("members").alias("right")), "key").where("block < other").select("members", "right")
    whole = lists.select("members").distinct().select("members", F.lit(None).cast("binary").alias("right"))
    opened = whole.unionByName(crossed).select(F.xxhash64("members", "right").alias("item"), "members", "right").mapInArrow(_open, "item long, side int, id long")
    return opened.distinct()


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, left, right in zip(*(batch.column(c).to_pylist() for c in ("item", "members", "right")), strict=True):
            for side, raw in enumerate((left, right or b"")):
                ids = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(np.full(len(ids), side, np.int32)), pa.array(ids)], names=["item", "side", "id"])
