"""Which value is current: rerank candidates, drop claims that can't be defended, pick a value only where sources agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import values as V
from quillstone.operators import relational as R


def scored(candidates: DataFrame, query: str, current_year: int, places=()) -> DataFrame:
    """Candidates with their current-state score (0: not an answer). `places` are words of the query without a subject."""
    q = F.lit(query)
    return V.with_columns(candidates).withColumn("score", V.current_score(q, T.query_terms(q, extra=places), current_year))


def rerank(candidates: DataFrame, query: str, current_year: int, places=()) -> DataFrame:
    """By score, then fused score, then (table, id)."""
    return scored(candidates, query, current_year, places).orderBy(F.col("score").desc(), F.col("rrf_score").desc(), "table", "id")


def without_undefended_claims(candidates: DataFrame, query: str, current_year: int, places=()) -> DataFrame:
    """Narratives that claim a current value must be positively current; drafts go, and so do undated or older ones if a dated, defended rival exists."""
    q = F.lit(query)
    terms = T.query_terms(q, extra=places)
    df = scored(candidates, query, current_year, places)
    claims = V.claims_current_value(terms, current_year + 1)
    df = df.withColumn("__claim", F.when(F.col("table") == V.NARRATIVES, claims).otherwise(F.col("score") > 0)).withColumn("__ok", V.has_currency_evidence(current_year)).withColumn("__date", V.date_score()).withColumn("__draft", V.draft_qualified())
    best = df.where(F.col("__claim") & F.col("__ok")).agg(F.max("__date").alias("__best"))
    narrative = (F.col("table") == V.NARRATIVES) & F.col("__claim") & ~F.col("__ok")
    beaten = F.col("__best").isNotNull() & (F.col("__date").isNull() | (F.col("__date") < F.col("__best")))
    active = V.wants_current(q) & ~V.is_historical(q)
    out = df.join(F.broadcast(best)).where(~(active & narrative & (F.col("__draft") | beaten)))
    return out.drop("__claim", "__ok", "__date", "__draft", "__best")


def resolve(candidates: DataFrame, query: str, current_year: int, places=()) -> DataFrame:
    """At most one row: the candidate that answers. None for historical questions, and none where sources disagree without a majority."""
    q = F.lit(query)
    df = scored(candidates, query, current_year, places).where(V.wants_current(q) & ~V.is_historical(q) & (F.col("score") > 0))
    band = df.where((F.col("table") == V.INDICATORS) & (F.col("score") >= V.STRUCTURED_BAND)).withColumn("__all", F.lit(1))
    agreed = R.corroborated(band.withColumn("document_id", F.coalesce(F.col("document_id").cast("string"), F.concat_ws(":", "table", F.col("id").cast("string")))), "__all", "value_actual", "document_id", V.SAME_RATE_RATIO)
    chosen = band.join(F.broadcast(agreed.select("__all", "value_actual")), ["__all", "value_actual"], "left_semi").drop("__all")
    other = df.where((F.col("table") == V.PROVISIONS) & (F.col("score") >= V.ORDINANCE_BAND))
    usable = chosen.unionByName(other.join(F.broadcast(band.limit(1).select("__all")), how="left_anti"))
    best = usable.orderBy(F.col("score").desc(), F.col("rrf_score").desc(), "table", "id").limit(1)
    terms = T.query_terms(q, extra=places)
    return best.withColumn("value", F.when(F.col("table") == V.INDICATORS, V.format_value(F.col("value_actual"), F.col("unit"))).otherwise(V.provision_value(q, terms)))


def anchors(candidates: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The best candidate of each key (section or document), then the n best of those, in order."""
    best = R.latest(candidates, key, F.col("score").desc(), F.col("id").asc()).orderBy(F.col("score").desc(), "id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))


def prefetch_indicators(indicators: DataFrame, query: str, limit: int = 5000, places=()) -> DataFrame:
    """Indicators with a value whose own fields name the subject: latest fiscal year first, ties by id."""
    from quillstone.operators.retrieval import any_term

    words = [w for w in dict.fromkeys("".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()) if len(w) > 2 and w not in T.VALUE_STOPWORDS and w not in places and not (len(w) == 4 and w.isdigit())]
    distinctive = [w for w in words if w not in ("tax", "taxes", "fee", "fees", "charge", "charges")]
    return indicators.where(F.col("value_actual").isNotNull() & any_term(("indicator_name", "program", "department"), distinctive)).orderBy(F.col("fiscal_year").desc(), "id").limit(limit)


def prefetch_narratives(candidates: DataFrame, query: str, current_year: int, n: int = 3, places=()) -> DataFrame:
    q = F.lit(query)
    return V.with_columns(candidates).withColumn("score", V.narrative_score(T.query_terms(q, extra=places), current_year + 1)).where(F.col("score") >= V.NARRATIVE_PREFETCH).orderBy(F.col("score").desc(), "id").limit(n)
