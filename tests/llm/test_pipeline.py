"""The pipeline on the smallest tables, each stage against a plain version on that stage's own input."""

import re
from pathlib import Path

import pytest

import corpus_pipeline
from quillstone.llm.common import materialise

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_dedup", "near_dedup", "decontaminate", "pack"]
    ids, texts = {}, {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, DATA))
        assert docs.columns == columns
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert ids["language"] == {i for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    first = {}
    for i in sorted(ids["language"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", texts[i]), i)
    assert ids["exact_dedup"] == set(first.values())

    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()
        return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)])

    sets = {i: shingles(texts[i]) for i in sorted(ids["exact_dedup"])}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                lo, hi = sorted((group[a], group[b]))
                group = {k: lo if g == hi else g for k, g in group.items()}
    assert ids["near_dedup"] == {i for i, g in group.items() if i == g}
    words = lambda t: " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())) + " "
    items = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    exact = {i for i in ids["near_dedup"] if any(x in words(texts[i]) for x in items)}
    assert not exact & ids["decontaminate"] and len(ids["near_dedup"] - ids["decontaminate"] - exact) <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == ids["decontaminate"]
    assert len(packed) == len(corpus_pipeline.run(spark, DATA).collect())


def test_near_copies_of_five_words(spark):
    """Near copies by 5-word shingles and 0.8 go, also those below 0.85 by 4-word shingles; a text below 0.8 stays."""
    base = [f"w{k}" for k in range(200)]
    replaced = list(base)
    for k in (30, 70, 110, 150):
        replaced[k] = f"x{k}"
    rows = [(1, base), (2, base + [f"y{k}" for k in range(40)]), (3, replaced), (4, base + [f"z{k}" for k in range(60)])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, DATA).collect()} == {1, 4}


def test_dedup_decides_by_row(spark):
    """Repeated ids with different texts, rows that repeat both, and null ids."""
    text = lambda k, more=0: " ".join(f"{k}{i}" for i in range(100 + more))
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (7, text("c")), (7, text("c")), (None, text("d")), (None, text("d")), (None, text("a")), (None, text("e"))]
    kept = [(1, text("a")), (5, text("b")), (7, text("c")), (None, text("d")), (None, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.keep_first_copies(spark, docs, DATA).collect()), key=repr) == sorted(kept, key=repr)
    near = spark.createDataFrame([*rows, (None, text("b", 9)), (9, text("c", 9))], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.keep_one_of_each_group(spark, near, DATA).collect()), key=repr) == sorted(kept, key=repr)
