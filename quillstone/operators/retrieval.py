"""Lexical and vector top-k, and their fusion by reciprocal rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import vectors as V

#: The constant of reciprocal rank fusion, candidates for each table and arm, and the fused score below which a search is incomplete.
RRF_K = 60
CANDIDATES = 40
SCORE_FLOOR = 0.005


def postings(df: DataFrame, id_col: str, lexemes: Column) -> DataFrame:
    """(id, lexeme, tf, length) for each distinct lexeme of each document."""
    opened = df.select(F.col(id_col), lexemes.alias("__l")).select(id_col, F.size("__l").alias("length"), F.explode("__l").alias("lexeme"))
    return opened.groupBy(id_col, "lexeme").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def lexical_scores(df: DataFrame, id_col: str, lexemes: Column, query: Sequence[str], mode: str = "tsrank", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents that hold at least one query lexeme; without query lexemes none.

    tsrank: grows with each lexeme's frequency, tf / (tf + 1), summed, no document frequencies. bm25: the usual formula
    over the documents given. Only query lexemes leave the scan, and they are counted per row without a shuffle.
    """
    query = list(dict.fromkeys(query))
    if not query:
        return df.select(id_col, F.lit(0.0).alias("score")).where(F.lit(False))
    tokens = df.select(F.col(id_col), lexemes.alias("__l"))
    tf = lambda w: F.size(F.filter("__l", lambda x: x == w)).cast("double")
    counted = tokens.select(id_col, F.size("__l").alias("__n"), *[tf(w).alias(f"__{i}") for i, w in enumerate(query)])
    any_ = sum((F.col(f"__{i}") for i in range(len(query))), F.lit(0.0)) > 0
    if mode == "tsrank":
        score = sum((F.col(f"__{i}") / (F.col(f"__{i}") + 1.0) for i in range(len(query))), F.lit(0.0))
        return counted.where(any_).select(id_col, score.alias("score"))
    if mode != "bm25":
        raise ValueError(f"no lexical mode {mode!r}")
    stats = counted.agg(F.count(F.lit(1)).alias("__docs"), F.avg("__n").alias("__avg"), *[F.count_if(F.col(f"__{i}") > 0).alias(f"__df{i}") for i in range(len(query))])
    joined = counted.where(any_).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(query)):
        idf = F.log1p((F.col("__docs") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5))
        score = score + idf * F.col(f"__{i}") * (k1 + 1) / (F.col(f"__{i}") + k1 * (1 - b + b * F.col("__n") / F.col("__avg")))
    return joined.select(id_col, score.alias("score"))


def top_k(scores: DataFrame, id_col: str, k: int = CANDIDATES, score: str = "score") -> DataFrame:
    """The k best, ties by id, with their rank from 1. The limit comes first, so the rank's window sees k rows only."""
    best = scores.orderBy(F.col(score).desc(), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(id_col))))


def lexical_top_k(df: DataFrame, id_col: str, lexemes: Column, query: Sequence[str], k: int = CANDIDATES, mode: str = "tsrank") -> DataFrame:
    return top_k(lexical_scores(df, id_col, lexemes, query, mode), id_col, k)


def vector_top_k(df: DataFrame, id_col: str, vector: str, query: Sequence[float], k: int = CANDIDATES) -> DataFrame:
    """The k nearest by cosine, exactly. Null and zero vectors are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.where(F.col(vector).isNotNull()).select(id_col, V.cosine_similarity(F.col(vector), q).alias("score")).where("score IS NOT NULL")
    return top_k(scored, id_col, k)


def vector_top_k_lsh(df: DataFrame, id_col: str, vector: str, query: Sequence[float], k: int = CANDIDATES, tables: int = 8, width: float = 0.5, seed: int = 1) -> DataFrame:
    """An approximate variant: random projections of unit vectors make buckets, and candidates are ranked exactly."""
    import numpy as np

    rng = np.random.default_rng(seed)
    q = np.asarray(query, float)
    q = q / (np.linalg.norm(q) or 1)
    planes = rng.normal(size=(tables, len(q)))
    shifts = rng.uniform(0, width, tables)
    length = V.norm(F.col(vector))
    near = F.lit(False)
    for p, s in zip(planes, shifts, strict=True):
        bucket = F.floor((V.dot(F.col(vector), F.array(*[F.lit(float(x)) for x in p])) / F.nullif(length, F.lit(0.0)) + float(s)) / width)
        near = near | F.coalesce(bucket == F.lit(int(np.floor((q @ p + s) / width))), F.lit(False))
    return vector_top_k(df.where(F.col(vector).isNotNull() & near), id_col, vector, query, k)


def fuse(arms: Sequence[DataFrame], key: Sequence[str], k: int = RRF_K) -> DataFrame:
    """Arms with a key and a rank -> key, rank_<i> and rrf_score = sum of 1 / (k + rank). A missing arm adds nothing."""
    parts = None
    for i, arm in enumerate(arms):
        part = arm.select(*key, F.lit(i).alias("__arm"), F.col("rank").alias("__rank"))
        parts = part if parts is None else parts.unionByName(part)
    best = parts.groupBy(*key, "__arm").agg(F.min("__rank").alias("__rank"))
    ranks = [F.min(F.when(F.col("__arm") == i, F.col("__rank"))).alias(f"rank_{i}") for i in range(len(arms))]
    fused = best.groupBy(*key).agg(*ranks)
    score = sum((F.coalesce(1.0 / (k + F.col(f"rank_{i}")), F.lit(0.0)) for i in range(len(arms))), F.lit(0.0))
    return fused.withColumn("rrf_score", score)


def fused_top(fused: DataFrame, key: Sequence[str], n: int = CANDIDATES) -> DataFrame:
    return fused.orderBy(F.col("rrf_score").desc(), *key).limit(n)


def search_is_incomplete(fused: DataFrame, floor: float = SCORE_FLOOR) -> DataFrame:
    """One row, `incomplete`: the best fused score is below the floor, or there is none."""
    return fused.agg(F.coalesce(F.max("rrf_score") < floor, F.lit(True)).alias("incomplete"))


def without_superseded(df: DataFrame, documents: DataFrame, reference: str = "document_id", key: str = "id") -> DataFrame:
    """Rows whose document is there and not superseded."""
    alive = documents.where(F.col("status") != "superseded").select(F.col(key).alias(reference))
    return df.join(alive, reference, "left_semi")


def gold_ranks(gold: DataFrame, pool: DataFrame, key: Sequence[str]) -> DataFrame:
    """gold (case_id, key) with its best rank in each arm of the pool (case_id, arm, key, rank), and whether it is there."""
    best = pool.groupBy("case_id", *key).agg(F.min(F.when(F.col("arm") == "lexical", F.col("rank"))).alias("rank_lexical"), F.min(F.when(F.col("arm") == "vector", F.col("rank"))).alias("rank_vector"))
    return gold.join(best, ["case_id", *key], "left").withColumn("in_pool", F.coalesce("rank_lexical", "rank_vector").isNotNull())


def occurrence_top_k(df: DataFrame, id_col: str, text: str, terms: Sequence[str], k: int = 6) -> DataFrame:
    """The k texts with most occurrences of terms at a word's begin, without those that have none."""
    score = F.lit(0)
    for t in terms:
        score = score + F.regexp_count(F.lower(F.col(text)), F.lit(rf"(?<![a-z0-9])\Q{t}\E"))
    return top_k(df.select(id_col, score.cast("double").alias("score")).where("score > 0"), id_col, k)


def any_term(columns: Sequence[str], terms: Sequence[str]) -> Column:
    """Some column holds some term, in any case. No terms: true."""
    if not terms:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        for t in terms:
            out = out | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(t.lower())), F.lit(False))
    return out


def probe_union(df: DataFrame, id_col: str, node: str, title: str, text: str, tokens: Sequence[str], words: Sequence[str], per_token: int = 10, per_word: int = 5) -> DataFrame:
    """Candidates of several probes, each once: ids by citation token, texts by keyword, titles by keyword (the first four words)."""
    parts = [df.where(F.contains(F.upper(F.col(node)), F.lit(t.upper()))).orderBy(id_col).limit(per_token).select(id_col) for t in tokens]
    for w in list(words)[:4]:
        parts.append(occurrence_top_k(df, id_col, text, [w], per_word).select(id_col))
        parts.append(df.where(F.contains(F.lower(F.col(title)), F.lit(w.lower()))).orderBy(id_col).limit(per_word).select(id_col))
    if not parts:
        return df.where(F.lit(False))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return df.join(found.distinct(), id_col, "left_semi")


def citation_first(df: DataFrame, id_col: str, node: str, tokens: Sequence[str], order: Sequence[Column], most: int = 8) -> DataFrame:
    """At most `most` candidates, each once: those that match a citation, if there are any, else all."""
    unique = df.dropDuplicates([id_col])
    if tokens:
        cited = unique.where(F.coalesce(T.matches_citation(F.col(node), F.array(*[F.lit(t) for t in tokens])), F.lit(False))).orderBy(*order).limit(most)
        if cited.take(1):
            return cited
    return unique.orderBy(*order).limit(most)
