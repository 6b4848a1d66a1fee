"""Queries over small tables of their own, against plain versions: no row is left out."""

import hashlib
import math
import random
import re

import pyarrow as pa
import pytest

from quillstone.operators import relational
from quillstone.plans import queries

DOCS = [
    (1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (2, "gamma delta epsilon"), (3, None), (4, ""), (5, "of no use"), (45, "alpha alpha beta zeta eta"),
    (6, "It cost 1,200,300 or 1,2,3 and 4, 5."), (7, "“Quoted” – text for 5 € today"), (8, "слово и ещё\tслово\n日本 語"),
]
ITEMS = [(0, "alpha beta gamma delta"), (40, "alpha beta"), (41, "eta theta"), (199, "gamma delta epsilon zeta"), (200, None)]


def rows(spark, folder, name):
    spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return sorted(map(tuple, getattr(queries, name)(spark, str(folder)).collect()))


def tokens(text):
    return {w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) >= 3}


def test_near_dups_of_all_pairs(spark, tmp_path):
    pairs = [(i, k, tokens(t), tokens(u)) for i, t in DOCS for k, u in ITEMS]
    assert rows(spark, tmp_path, "jaccard_near_dups") == sorted((i, k, round(len(x & y) / len(x | y), 9)) for i, k, x, y in pairs if x & y)


@pytest.mark.parametrize("block", [None, 6000])
def test_near_dups_are_counted_without_a_shuffle(spark, monkeypatch, block):
    """A task holds counts of a few documents, not those of all its pairs; blocks of items and of documents change nothing."""
    if block:
        monkeypatch.setattr(relational, "BLOCK_BYTES", block)
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(90)} ab" for _ in range(rng.randrange(60)))
    left, right = ([(None if k % 50 == 9 else k // 2, tokens(text()) if k % 7 else None if k % 2 else []) for k in range(n)] for n in (400, 90))
    a, b = (spark.createDataFrame([(i, None if t is None else sorted(t)) for i, t in rows], "id long, tokens array<string>").repartition(3) for rows in (left, right))
    got = relational.shared_tokens(a, b)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert block or plan.count("Exchange") == 1  # the repartition(3) of the test
    want = [(i, k, len(x & y), len(x), len(y)) for i, x in left for k, y in right if x and y and x & y]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_counts_of_a_batch_are_made_a_few_rows_at_a_time(monkeypatch):
    monkeypatch.setattr(relational, "PLACES", 5)
    items = pa.table({"id": [1, 2, 3], "tokens": [["one", "two"], ["two"], ["four"]]})
    batch = pa.RecordBatch.from_pydict({"id": [7, 8, 9, 7, 5], "tokens": pa.array([["one", "two"], ["six"], None, ["two", "four", "six"], ["two"]])})
    out = [tuple(r.values()) for part in relational._shared_tokens(iter([batch]), items) for r in part.to_pylist()]
    assert out == [(7, 1, 2, 2, 2), (7, 2, 1, 2, 1), (7, 1, 1, 3, 2), (7, 2, 1, 3, 1), (7, 3, 1, 3, 1), (5, 1, 1, 1, 2), (5, 2, 1, 1, 1)]


def test_normalized_text_of_all_documents(spark, tmp_path):
    plain = lambda t: " ".join(re.findall("[a-z0-9]+", re.sub("(?<=[0-9]),(?=[0-9])", "", (t or "").lower())))
    assert plain(DOCS[7][1]) == "it cost 1200300 or 123 and 4 5"
    assert rows(spark, tmp_path, "normalized_text") == sorted((i, hashlib.md5(plain(t).encode()).hexdigest()) for i, t in DOCS)


def test_token_estimate_of_all_documents(spark, tmp_path):
    assert rows(spark, tmp_path, "token_estimate") == sorted((i, math.ceil(len(re.findall("[^ \t\n\x0b\f\r]+", t or "")) * 1.3)) for i, t in DOCS)
