"""Classifiers: held-out accuracy on small invented corpora, decoding rules and the odd cases. The pipeline against plain versions of its stages."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import language_id, quality, queries, toxicity
from quillstone.llm.common import crc_bucket, hash_sample

SYLLABLES = {"aa": "ka lo mi ra tu so".split(), "bb": "sch ung eit ver pf ö".split(), "cc": "eau ois é que ment aux".split()}


def tables(spark, folder, n=900, seed=1):
    rng = random.Random(seed)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        w = [word(lang) for _ in range(rng.randint(5, 80))]
        toxic, bad = rng.random() < 0.2, rng.random() < 0.25
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(("vile", "rotten"))
        if bad:
            w = [x + rng.choice(("###", "$$$", "%%%")) for x in w] if i % 2 else w[:3] * 20
        rows.append((i, " ".join(w), lang if i % 9 else None, "s", len(w)))
        if rng.random() < 0.7:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(n, None, "aa", "s", 0), (n + 1, "", "bb", "s", 0), (n + 2, "12 34 !!", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {r[0]: r for r in rows}, {x[0]: x for x in labels}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("models"))
    return folder, *tables(spark, folder)


def test_language(spark, corpus):
    folder, docs, _ = corpus
    got = queries.op8_language_id(spark, folder).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and docs[r.doc_id][2]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == docs[r.doc_id][2] for r in held if docs[r.doc_id][1]]) > 0.98
    assert {r.lang_pred for r in got if r.doc_id >= 900} == {"und"}


def test_codewords():
    for k in (2, 3, 4, 5, 9):
        codes = language_id.codewords(k)
        assert min(np.sum(codes[i] != codes[j]) for i in range(k) for j in range(i)) >= (1 if k == 2 else 2 ** (k - 2) if k <= 5 else 8)


def test_score_does_not_depend_on_neighbours(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    book = language_id.train_codebook(docs, crc_bucket("doc_id", 4) != 2)
    many = {r.doc_id: r.score for r in language_id.identify_languages(docs, book).collect()}
    one = language_id.identify_languages(docs.where("doc_id = 17"), book).first()
    assert one.score == pytest.approx(many[17], abs=1e-9)


def test_toxicity(spark, corpus):
    folder, docs, labels = corpus
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, folder).collect()}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, x[2]) for i, x in labels.items() if got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_quality(spark, corpus):
    folder, docs, labels = corpus
    got = {r.doc_id: r for r in queries.op2_quality(spark, folder).collect()}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[i].predicted, x[1]) for i, x in labels.items() if got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_labels_are_no_inputs(spark, corpus):
    folder, _, _ = corpus
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    learn = crc_bucket("doc_id", 5) != 0
    turned = labels.withColumn("toxic", F.when(learn, F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert np.array_equal(toxicity.train_toxicity(docs, labels, learn), toxicity.train_toxicity(docs, turned, learn))


def test_non_negative_risk():
    """Positives and a mixture, without any negative label: held-out accuracy with the prior given and estimated."""
    rng = np.random.default_rng(0)
    make = lambda n, good: rng.normal(2.0 if good else -2.0, 1.0, (n, 3))
    positive, unlabelled = make(300, True), np.concatenate([make(400, True), make(400, False)])
    model = quality.Network.train(positive, unlabelled, 0.5)
    assert (model.raw(make(300, True)) > 0).mean() > 0.97 and (model.raw(make(300, False)) < 0).mean() > 0.97
    assert quality.prior_from_tails(model.raw(positive), model.raw(unlabelled)) == pytest.approx(0.5, abs=0.12)


def test_empty_tables_and_no_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    every = F.lit(True)
    book = language_id.train_codebook(docs, every)
    assert language_id.identify_languages(docs, book).count() == 0
    assert toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels, every)).count() == 0
    assert quality.score_quality(docs, quality.train_quality(docs, labels, every)).count() == 0
    one = spark.createDataFrame([(None, "hello", "en"), (None, None, None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.identify_languages(one, book).collect()] == ["und", "und"]
    assert {r.score for r in quality.score_quality(one, None).collect()} == {0.5}


def test_sample_is_bounded_and_the_same(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = hash_sample(df, "k", 50).collect(), hash_sample(df.repartition(7), "k", 50).collect()
    assert len(a) == 50 and sorted(a) == sorted(b)
