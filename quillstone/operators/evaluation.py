"""Grading of answers, and metrics over graded cases. No model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

CASE = "id string, category string, query string, chunk_ids array<string>, criteria array<struct<id:string,description:string,check:struct<type:string,value:string,chunk_id:string>>>"


def expects_answer(criteria: Column) -> Column:
    return ~F.exists(criteria, lambda c: c["check"]["type"] == "is_refusal")


def grade(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """cases (CASE) and answers (case_id, answer, cited_chunk_ids) -> one row for each criterion: case_id, criterion_id, passed.

    contains and not_contains are tolerant (synonyms, order, 0.8 of the words); cites wants a chunk; is_refusal and not_refusal.
    """
    opened = cases.select(F.col("id").alias("case_id"), "category", F.explode("criteria").alias("c"))
    joined = opened.join(answers, "case_id", "left").withColumn("__said", T.answer_tokens(F.coalesce("answer", F.lit("")))).withColumn("__want", T.answer_tokens(F.coalesce(F.col("c.check.value"), F.lit(""))))
    holds = T.tolerant_contains(F.col("__said"), F.col("__want"))
    cites = F.coalesce(F.array_contains("cited_chunk_ids", F.col("c.check.chunk_id")), F.lit(False))
    kind = F.col("c.check.type")
    passed = F.when(kind == "contains", holds).when(kind == "not_contains", ~holds).when(kind == "cites", cites).when(kind == "is_refusal", T.is_refusal(F.col("answer"))).when(kind == "not_refusal", ~T.is_refusal(F.col("answer"))).otherwise(False)
    return joined.select("case_id", "category", F.col("c.id").alias("criterion_id"), passed.alias("passed"))


def case_results(graded: DataFrame, cases: DataFrame, answers: DataFrame) -> DataFrame:
    """One row for each case: status pass, fail, skipped or error, expects_answer, refused. Cases without an answer row are skipped."""
    all_passed = graded.groupBy("case_id").agg(F.bool_and("passed").alias("ok"))
    base = cases.select(F.col("id").alias("case_id"), "category", expects_answer(F.col("criteria")).alias("expects_answer"))
    joined = base.join(answers.withColumn("__there", F.lit(True)), "case_id", "left").join(all_passed, "case_id", "left")
    error = F.col("error").isNotNull() if "error" in answers.columns else F.lit(False)
    status = F.when(F.col("__there").isNull(), "skipped").when(error, "error").when(F.coalesce("ok", F.lit(False)), "pass").otherwise("fail")
    return joined.select("case_id", "category", "expects_answer", status.alias("status"), T.is_refusal(F.col("answer")).alias("refused"))


def percent(part: Column, whole: Column) -> Column:
    return F.floor(100.0 * part / F.nullif(whole, F.lit(0)) + 0.5).cast("long")


def summary(results: DataFrame) -> DataFrame:
    """One row: totals, pass rate, correctness (of asserted answers, how many hold) and availability (of expected answers, how many came).

    Skipped and errored cases don't count as run; a rate over nothing is null.
    """
    ran, ok = F.col("status").isin("pass", "fail"), F.col("status") == "pass"
    asserted, expected = ran & ~F.col("refused"), ran & F.col("expects_answer")
    c = results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "error").alias("errored"), F.count_if(ran).alias("ran"), F.count_if(ok).alias("passed"),
        F.count_if(asserted).alias("asserted"), F.count_if(asserted & ok).alias("correct"), F.count_if(asserted & ~F.col("expects_answer")).alias("false_assertions"),
        F.count_if(expected).alias("expected"), F.count_if(expected & ~F.col("refused")).alias("answered"),
    )
    return c.select("*", percent(F.col("passed"), F.col("ran")).alias("overall_pct"), percent(F.col("correct"), F.col("asserted")).alias("correctness_pct"), percent(F.col("answered"), F.col("expected")).alias("availability_pct"))


def by_category(results: DataFrame) -> DataFrame:
    """Run, passed and percent for each category; the row of null category is the total."""
    ran = results.where(F.col("status").isin("pass", "fail"))
    return ran.rollup("category").agg(F.count(F.lit(1)).alias("ran"), F.count_if(F.col("status") == "pass").alias("passed")).withColumn("pct", percent(F.col("passed"), F.col("ran")))


def retrieval_split(results: DataFrame, pool: DataFrame) -> DataFrame:
    """One row over cases with gold (case_id, rank_lexical, rank_vector, in_pool, cited): surfaced or blind, by which arm, surfaced but failed or not cited."""
    j = results.join(pool, "case_id")
    lex, vec = F.col("rank_lexical").isNotNull(), F.col("rank_vector").isNotNull()
    return j.agg(
        F.count(F.lit(1)).alias("with_gold"), F.count_if("in_pool").alias("surfaced"), F.count_if(~F.col("in_pool")).alias("blind"), F.count_if(lex & ~vec).alias("lexical_only"), F.count_if(vec & ~lex).alias("vector_only"), F.count_if(lex & vec).alias("both"),
        F.count_if(F.col("in_pool") & (F.col("status") == "fail")).alias("surfaced_failed"), F.count_if(F.col("in_pool") & ~F.col("cited")).alias("surfaced_not_cited"),
    )


def pool_size(pool: DataFrame) -> DataFrame:
    return pool.groupBy("case_id").agg(F.countDistinct("table", "id").alias("pool_size"))


def missing_chunks(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, chunk_id) of cases that name chunks which don't exist."""
    return cases.select(F.col("id").alias("case_id"), F.explode("chunk_ids").alias("chunk_id")).join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")


def date_sources(df: DataFrame, category: str = "doc_type") -> DataFrame:
    """For each type (and all, null): rows, and how many dates came from the URL, from extraction, or not at all."""
    return df.rollup(category).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("date_source") == "url").alias("from_url"), F.count_if(F.col("date_source") == "extracted").alias("from_text"), F.count_if(F.col("date_source").isNull()).alias("undated"))
