"""Exact dedup, substring dedup and the Jaccard join against brute force, with the odd cases in."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import common, exact_dedup, jaccard_join, substring_dedup
from quillstone.llm import components as components_of

SCHEMA = "doc_id long, text string, lang string, id string, kept string"


def corpus(seed: int = 1, n: int = 120):
    """Invented words, copies, near copies, passages that repeat, periodic text, nulls, empty and short texts, ties, repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, texts = words(60), []
    for k in range(n):
        w = words(rng.choice((5, 40, 90, 200)))
        if k % 5 == 0:
            at = rng.randrange(len(w))
            w = w[:at] + passage[rng.randint(0, 20) :] + w[at:]
        texts.append(w)
    for k in range(0, n, 6):
        w = list(texts[k])
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(w)
    texts = [" ".join(w) for w in texts]
    texts += [texts[3].replace(" ", "\n"), texts[3].upper(), texts[4] + "  ", "  " + texts[4], "a b a b " * 40, "x " * 50, None, "", "   ", "\t", "one", "one two three", "ONE two three", "one two three four"]
    rows = [(i, t, "en", "clash", "clash") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[5], rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


def test_exact(docs):
    rows = docs.collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    for limit in (common.BROADCAST_BYTES, 0):
        got = exact_dedup.exact_dedup(docs, broadcast_bytes=limit).collect()
        want = [(r.doc_id, min(g := groups[norm(r.text)]), len(g), r.doc_id == min(g), hashlib.sha256(norm(r.text).encode()).hexdigest()) for r in rows]
        assert sorted(map(tuple, got)) == sorted(want)


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(4)]
    parts[1][:50], parts[2][:7] = parts[0][:50], parts[0][:7]
    first, *others = [exact_dedup.QuotientFilter.build(p) for p in parts]
    merged = first.merge(*[exact_dedup.QuotientFilter.unpack(o.pack()) for o in others])
    counts = Counter(np.concatenate(parts).tolist())
    assert dict(zip(merged.fingerprints().tolist(), merged.counts.tolist(), strict=True)) == counts
    assert all(merged.count(fp) == n for fp, n in list(counts.items())[:200]) and merged.count(12345) == counts.get(12345, 0)
    slabs = [s for _, s in merged.slabs(6)]
    assert np.array_equal(np.concatenate([exact_dedup.QuotientFilter.unpack(s.pack()).fingerprints() for s in slabs]), merged.fingerprints())


def repeats(rows, window):
    split = [(r.doc_id, (r.text or "").encode().split()) for r in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for doc_id, w in split:
        covered = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                covered[k : k + window] = [True] * window
        out.append((doc_id, len(w), sum(covered), b" ".join(x for x, c in zip(w, covered, strict=True) if not c).decode()))
    return sorted(out)


@pytest.mark.parametrize(("hot", "limit"), [(20_000, None), (1, None), (20_000, 0)])
def test_substring(docs, hot, limit, monkeypatch):
    if limit is not None:
        plain = substring_dedup.small
        monkeypatch.setattr(substring_dedup, "small", lambda df: plain(df, limit))
    got = substring_dedup.remove_repeats(docs, hot=hot).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got)) == repeats(docs.collect(), 35)


def test_substring_spans(docs):
    for r in substring_dedup.remove_repeats(docs).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_longest_matches_and_greedy_parse():
    """Against a plain search for the longest match of each place, and a parse step by step."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = rng.integers(1, 9, rng.integers(1, 12))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        prints = rng.integers(0, 4, bounds[-1]).astype(np.uint64)
        ends = np.repeat(bounds[1:], lengths)

        def match(i, j):
            n = 0
            while i + n < ends[i] and j + n < ends[j] and prints[i + n] == prints[j + n]:  # noqa: B023
                n += 1
            return n

        want = [max((match(i, j) for j in range(len(prints)) if j != i), default=0) for i in range(len(prints))]
        length, place = substring_dedup.longest_matches(prints, ends)
        assert length.tolist() == want
        assert all(n == 0 or (place[i] != i and match(i, place[i]) == n) for i, n in enumerate(want))
        factors = []
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            at = lo
            while at < hi:
                factors += [(at, want[at])] if want[at] else []
                at += max(want[at], 1)
        places, lengths_, _ = substring_dedup.greedy_parse(prints, bounds)
        assert sorted(zip(places.tolist(), lengths_.tolist(), strict=True)) == sorted(factors)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_factors_point_to_the_same_words(spark, hot):
    rows = [(i, t or "") for i, (_, t, *_) in enumerate(corpus())]
    words = {i: t.encode().split() for i, t in rows}
    found = substring_dedup.relative_factors(spark.createDataFrame(rows, "id long, text string"), hot=hot).collect()
    assert len(found) > 50
    for r in found:
        n = r.windows - 1 + substring_dedup.WINDOW
        assert (r.source is None) <= (hot == 1)
        if r.source is None:
            continue
        assert (r.id, r.start) != (r.source, r.source_start)
        assert words[r.id][r.start : r.start + n] == words[r.source][r.source_start : r.source_start + n] and r.start + n <= len(words[r.id])


def test_filter_build_is_about_linear():
    import time

    import pyarrow as pa

    rng = np.random.default_rng(1)

    def seconds(n):
        values = rng.integers(0, 1 << 63, n)
        began = time.process_time()
        slabs = list(exact_dedup._filters((pa.RecordBatch.from_arrays([pa.array(values[k : k + 2000])], names=["fp"]) for k in range(0, n, 2000)), 6))
        assert sum(len(exact_dedup.QuotientFilter.unpack(b.column("filter")[0].as_py()).remainders) for b in slabs) == n
        return time.process_time() - began

    seconds(20_000)
    assert seconds(400_000) < 10 * max(seconds(100_000), 0.05)


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def components(rows):
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted((i, len(s), root(i)) for i, s in sets)


def test_jaccard(docs):
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect())) == components(docs.collect())


def test_jaccard_of_a_large_family_in_blocks(spark, monkeypatch):
    """Families beyond the bound are compared list by list, block against block, with the same result."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "FAMILY", (10, 1000))
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    assert sorted(map(tuple, jaccard_join.jaccard_components(df).collect())) == components(df.collect())


def test_components_of_few_links_take_few_jobs(spark, monkeypatch):
    """A chain of links is joined in one task, however long it is; beyond the bound, rounds of stars give the same."""
    chain = list(range(-200, 200))
    random.Random(5).shuffle(chain)
    links = spark.createDataFrame([*zip(chain, chain[1:], strict=False), (500, 501), (501, 500), (502, 502), (503, 500)], "a long, b long").repartition(6)
    want = sorted([(x, -200) for x in chain] + [(x, 500) for x in (500, 501, 503)])
    spark.sparkContext.setJobGroup("few links", "")
    assert sorted(map(tuple, components_of.components(links).collect())) == want
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 8
    spark.sparkContext.setJobGroup("more links", "")
    monkeypatch.setattr(components_of, "LINKS", 0)
    assert sorted(map(tuple, components_of.components(links).collect())) == want
    assert components_of.components(links.where("a = b")).count() == 0


def test_lists_of_a_key_of_many_ids_are_grouped_before_the_shuffle():
    rows = [(7 if k % 2 else k, k) for k in range(3000)]
    batches = [pa.RecordBatch.from_pylist([{"key": key, "id": i} for key, i in rows[lo : lo + 1000]]) for lo in range(0, 3000, 1000)]
    out = [r for batch in jaccard_join._regrouped(iter(batches)) for r in batch.to_pylist()]
    assert sorted((r["key"], i) for r in out for i in np.frombuffer(r["members"], np.int64).tolist()) == sorted(rows)
    assert len(out) == 1501


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    threshold = jaccard_join.Threshold(85, 100)
    edges = threshold.bands()
    for n in (6, 7, 9, 15, 40, 147, 600):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            keep = len(a) - rng.integers(0, max(1, n // 6) + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[:keep], rng.integers(0, 1 << 63, rng.integers(0, max(1, n // 8) + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            difference = len(a) + len(b) - 2 * both
            assert np.bitwise_count(jaccard_join.parity_bits(a, 512) ^ jaccard_join.parity_bits(b, 512)).sum() <= difference
            if 100 * both >= 85 * (len(a) + len(b) - both) and difference:
                assert np.intersect1d(jaccard_join.band_keys(a, edges, threshold), jaccard_join.band_keys(b, edges, threshold)).size


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, substring_dedup.remove_repeats, jaccard_join.jaccard_components])
def test_empty_table_and_null_ids(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f g h", None, None, None), (None, None, None, None, None), (7, "a b c d e f g h", None, None, None)]
    assert run(spark.createDataFrame(rows, SCHEMA)).count() == 3


def test_words_of_odd_bytes():
    import pyarrow as pa

    texts = ["", "a", " a  b\n\x0bcd ", None, "é ß", "x" * 3_000_000 + " y", "y"]
    w = common.Words(*common.text_bytes(pa.array(texts)), common.PLAIN)
    assert np.diff(w.first).tolist() == [len((t or "").encode().split()) for t in texts]
    assert w.hashes[-1] == w.hashes[-2]
