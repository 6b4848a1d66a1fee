"""Entry points that users call. Model calls (encoder, judge, drafter, verifier) are plain functions passed in."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import dates as D
from quillstone.functions import text as T
from quillstone.functions import values as VAL
from quillstone.functions import vectors as V
from quillstone.operators import current_value, evaluation, graph, relational, retrieval, temporal
from quillstone.streaming import queue

REFUSAL = "I cannot answer this question from the documents I have."
MOST_CALLS, MOST_CORRECTIONS, MOST_SELECTED = 5, 2, 8
#: First line of an indicator's embedding text (a fixed value).
RECORD = "budget_indicator"
UNVERIFIED = "This answer has not been verified."
INCOMPLETE = "Some sources may be missing from this search."


@dataclass
class Budget:
    """Model calls that are left for one question."""

    left: int = MOST_CALLS

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


@dataclass
class Models:
    """judge(query, candidates) -> ids; draft(query, candidates) -> {answer, claims: {claim: id}}; verify(query, answer, candidates) -> flagged claims."""

    judge: Callable[[str, list[dict]], list[str]] = lambda query, rows: [r["key"] for r in rows[:3]]
    draft: Callable[[str, list[dict]], dict] = lambda query, rows: {"answer": " ".join(f"{r['content'][:200]} [chunk:{r['key']}]" for r in rows), "claims": {}}
    verify: Callable[[str, str, list[dict]], list[str]] = lambda query, answer, rows: []
    encode: Callable[[str], Sequence[float]] = V.encode_text


@dataclass
class Answer:
    answer: str
    citations: list[dict] = field(default_factory=list)
    caveats: list[str] = field(default_factory=list)
    incomplete: bool = False
    temporal: bool = False
    unverified: bool = False
    calls: int = 0


class Engine:
    """Questions over chunk tables. tables: name -> frame with id, document_id, content, embedding (and more); documents: id, status, title, url, ..."""

    def __init__(self, tables: dict[str, DataFrame], documents: DataFrame, models: Models | None = None, places: Sequence[str] = (), current_year: int = 2025):
        self.tables, self.documents, self.models, self.places, self.current_year = tables, documents, models or Models(), tuple(places), current_year

    # ------------------------------------------------------------ retrieval

    def search(self, query: str, k: int = retrieval.CANDIDATES) -> DataFrame:
        """Fused candidates (table, id, rank_0 lexical, rank_1 vector, rrf_score) over all tables; superseded documents are left out of both arms."""
        words = [r[0] for r in self.documents.sparkSession.createDataFrame([(query,)], "q string").select(F.explode(T.english_lexemes("q"))).collect()]
        vector, lexical, near = list(self.models.encode(query)), None, None
        for name, df in sorted(self.tables.items()):
            alive = retrieval.without_superseded(df, self.documents)
            lex = retrieval.lexical_top_k(alive.select("id", T.english_lexemes("content").alias("l")), "id", F.col("l"), words, k).withColumn("table", F.lit(name))
            vec = retrieval.vector_top_k(alive, "id", "embedding", vector, k).withColumn("table", F.lit(name))
            lexical = lex if lexical is None else lexical.unionByName(lex)
            near = vec if near is None else near.unionByName(vec)
        return retrieval.fuse([lexical, near], ["table", "id"])

    def candidates(self, fused: DataFrame, n: int = retrieval.CANDIDATES) -> DataFrame:
        """The n best with their rows and documents; superseded versions with a current peer are gone."""
        top = retrieval.fused_top(fused, ["table", "id"], n)
        rows = None
        for name, df in sorted(self.tables.items()):
            part = df.drop("embedding").withColumn("table", F.lit(name))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        for c, t in {"node_id": "string", "is_current": "boolean"}.items():
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(t))
        docs = self.documents.select(F.col("id").alias("document_id"), *[F.col(c).alias(f"doc_{c}") for c in ("title", "url", "filename") if c in self.documents.columns], *[F.col(c).alias(a) for c, a in (("budget_stage", "doc_stage"), ("fiscal_year", "doc_fiscal_year"), ("source_published_at", "doc_published"), ("ingested_at", "doc_retrieved")) if c in self.documents.columns])
        joined = rows.join(F.broadcast(top), ["table", "id"]).join(docs, "document_id", "left")
        return joined.withColumn("key", F.concat_ws(":", "table", F.col("id").cast("string")))

    # ------------------------------------------------------------ questions

    def answer(self, query: str) -> Answer:
        """Search, filter, judge, draft, verify and correct, within a budget of calls; a refusal where nothing is found or chosen."""
        if not query.strip():
            raise ValueError("the question is empty")
        spark = self.documents.sparkSession
        flags = spark.createDataFrame([(query,)], "q string").select(self._historical_only(F.col("q")).alias("h")).first()
        fused = self.search(query)
        if retrieval.search_is_incomplete(fused).first().incomplete:
            return Answer(REFUSAL, incomplete=True)
        rows = self.candidates(fused)
        if not flags.h:
            rows = temporal.hard_version_filter(rows, [], "node_id", versioned=F.col("node_id").isNotNull())
            rows = current_value.without_undefended_claims(rows, query, self.current_year, self.places)
        ranked = current_value.rerank(rows, query, self.current_year, self.places).limit(retrieval.CANDIDATES)
        pool = [r.asDict(recursive=True) for r in ranked.collect()]  # at most CANDIDATES rows
        budget, known = Budget(), {r["key"]: r for r in pool}
        budget.take()
        chosen = [known[i] for i in dict.fromkeys(self.models.judge(query, pool)) if i in known][:MOST_SELECTED]
        if not chosen:
            return Answer(REFUSAL, calls=MOST_CALLS - budget.left)
        budget.take()
        draft = self.models.draft(query, chosen)
        history = any(r.get("has_history") for r in chosen)
        unverified = False
        for _ in range(MOST_CORRECTIONS + 1):
            if not (history or any(c.isdigit() for c in draft["answer"])):
                break
            if not budget.take():
                unverified = True
                break
            flagged = self.models.verify(query, draft["answer"], chosen)
            if not flagged:
                break
            if not budget.take():
                unverified = True
                break
            draft = self.models.draft(query, chosen)
        labels = {r["key"]: self._label(r) for r in chosen}
        caveats = [UNVERIFIED] if unverified else []
        return Answer(T.rewrite_citations(draft["answer"], labels), [{"key": k, "label": v} for k, v in labels.items()], caveats, temporal=history, unverified=unverified, calls=MOST_CALLS - max(budget.left, 0))

    def _historical_only(self, q: Column) -> Column:
        from quillstone.functions import values

        return values.is_historical_only(q)

    @staticmethod
    def _label(row: dict) -> str:
        title = row.get("doc_title") or row.get("doc_filename") or row["table"]
        page = f"page {row['page_start']}" if row.get("page_start") is not None else "page n/a"
        day = f"{row['doc_retrieved']:%Y-%m-%d}" if row.get("doc_retrieved") else "retrieval date unavailable"
        return f"[{title}, {page}, retrieved {day}]"

    def current_value(self, query: str) -> dict:
        """{source, value, section} of the value that the tables agree on; all None where they don't."""
        rows = None
        docs = self.documents.select(F.col("id").alias("document_id"), F.col("title").alias("doc_title"), F.col("url").alias("doc_url"), F.col("filename").alias("doc_filename"), F.col("budget_stage").alias("doc_stage"), F.col("fiscal_year").alias("doc_fiscal_year"), F.col("source_published_at").alias("doc_published"))
        for name, df in sorted(self.tables.items()):
            part = df.drop("embedding").withColumn("table", F.lit(name)).withColumn("rrf_score", F.lit(0.0))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        found = current_value.resolve(rows.join(docs, "document_id", "left"), query, self.current_year, self.places).first()
        return {"source": None, "value": None, "section": None} if found is None else {"source": found["table"], "value": found["value"], "section": found["node_id"] if "node_id" in found.asDict() else None}

    def in_force(self, topic: str, day) -> DataFrame:
        """The provision of a topic that was in force on a day."""
        return relational.as_of_rows(self.tables["crosswalk"].where(F.col("topic") == topic), "topic", F.lit(day).cast("date"))

    def topic_history(self, topic: str) -> DataFrame:
        return temporal.topic_history(self.tables["crosswalk"], self.tables["provisions"].select(F.col("id").alias("provision_id"), "content"), topic)

    def historical(self, query: str, editions: DataFrame, chunks: DataFrame, n: int = 6) -> DataFrame:
        """Chunks of the edition (edition_id, year) that was in force in the year a question names, by occurrences of its terms; none without a year."""
        spark = self.documents.sparkSession
        q = spark.createDataFrame([(query,)], "q string").select(D.historical_year(F.col("q")).alias("y"), T.query_terms(F.col("q"), T.LOOKUP_STOPWORDS, self.places).alias("t")).first()
        if q.y is None:
            return chunks.where(F.lit(False))
        edition = editions.where(F.col("year") <= q.y).agg(F.max_by("edition_id", "year").alias("edition_id"))
        part = chunks.join(F.broadcast(edition), "edition_id")
        return part.join(F.broadcast(retrieval.occurrence_top_k(part, "id", "content", q.t, n)), "id")


# ---------------------------------------------------------------- jobs


def document_dates(documents: DataFrame, extracted: DataFrame) -> DataFrame:
    """Each document's date: what its URL names, else the most frequent extracted one (the earliest of equals), with its source."""
    modes = relational.mode_smallest(extracted, "document_id", "extracted_date", "extracted_date").withColumnRenamed("document_id", "id")
    joined = documents.withColumn("__url", D.date_from_url(F.col("url"))).join(modes, "id", "left")
    source = F.when(F.col("__url").isNotNull(), "url").when(F.col("extracted_date").isNotNull(), "extracted")
    return joined.withColumn("document_date", F.coalesce("__url", "extracted_date")).withColumn("date_source", source).drop("__url", "extracted_date")


def detect_changes(known: DataFrame, seen: DataFrame) -> DataFrame:
    """seen (url, validator, content_hash) against known (url, validator, content_hash): each URL with its action."""
    k = known.select("url", F.col("validator").alias("__v"), F.col("content_hash").alias("__h"), F.lit(True).alias("__k"))
    j = seen.join(k, "url", "left")
    return j.withColumn("action", graph.change_action(F.coalesce("__k", F.lit(False)), F.col("validator"), F.col("__v"), F.col("content_hash"), F.col("__h"))).drop("__v", "__h", "__k")


def reconcile(pending: DataFrame, provisions: DataFrame, compare: Callable[[str, str], str], done: DataFrame) -> DataFrame:
    """(pending_change_id, provision_id, result) of pairs that weren't compared before; changes without a current provision are not_found."""
    cur = provisions.where("is_current").select("node_id", F.col("id").alias("provision_id"), F.col("content").alias("__c"))
    pairs = pending.where(F.col("codification_status") == "pending").select(F.col("id").alias("pending_change_id"), "node_id", "proposed_text").join(cur, "node_id", "left")
    fresh = pairs.join(done.select("pending_change_id", F.col("provision_id").alias("__p")), (pairs.pending_change_id == done.pending_change_id) & pairs.provision_id.eqNullSafe(F.col("__p")), "left_anti")
    call = F.udf(lambda a, b: compare(a or "", b or ""), "string")
    return fresh.select("pending_change_id", "provision_id", F.when(F.col("provision_id").isNull(), "not_found").otherwise(call("proposed_text", "__c")).alias("result"))


def verify_votes(decisions: DataFrame, votes: DataFrame) -> DataFrame:
    """(decision_id, vote_id, matched_via) of decisions (id, document_id, subject) with just one best vote of their document.

    A single vote whose motion names a chapter or appendix of the subject wins by citation. Of several such votes, or of
    all votes if there is none, the one with most of the subject's keywords in its motion wins, unless two have as many.
    """
    wanted = decisions.select(F.col("id").alias("decision_id"), "document_id", T.keywords(F.col("subject")).alias("words"), T.citation_tokens(F.col("subject")).alias("cites"))
    pairs = wanted.join(votes.select(F.col("id").alias("vote_id"), "document_id", "motion_text"), "document_id")
    motion = F.lower("motion_text")
    scored = pairs.withColumns(
        {
            "cited": F.arrays_overlap("cites", T.citation_tokens(F.col("motion_text"))).cast("int"),
            "score": F.size(F.filter("words", lambda w: F.contains(motion, w))),
        }
    ).withColumn("named", F.sum("cited").over(Window.partitionBy("decision_id")))
    by_citation = scored.where("named = 1 AND cited = 1").select("decision_id", "vote_id", F.lit("citation").alias("matched_via"))
    pool = scored.where("(named = 0 OR (named > 1 AND cited = 1)) AND score > 0")
    by_words = relational.unique_best(pool, "decision_id", "score", "vote_id").select("decision_id", "vote_id", F.lit("keyword").alias("matched_via"))
    return by_citation.unionByName(by_words)


def ingest_step(table: DataFrame, now: Column, limit: int, process: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Claim due rows, process them (id, outcome, error), settle: (queue, outcomes)."""
    claimed, taken = queue.claim(table, now, limit)
    outcomes = process(taken)
    return queue.settle(claimed, outcomes, now), outcomes


def open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(~F.col("acknowledged")).orderBy(F.col("triggered_at").desc(), "id")


def acknowledge(alerts: DataFrame, alert_id: str) -> DataFrame:
    """The alert acknowledged; doing it twice changes nothing, and ids that aren't UUIDs are an error."""
    import uuid

    uuid.UUID(alert_id)
    return alerts.withColumn("acknowledged", F.col("acknowledged") | (F.col("id") == alert_id))


def reembed(indicators: DataFrame, encode, columns: Sequence[str], dry_run: bool = True) -> DataFrame:
    """Rows with their embedding text; with vectors unless it is a dry run.

    The text has a line for the kind of record, then one labelled line for each column (see values.embedding_field).
    """
    kinds = dict(indicators.dtypes)
    text = F.concat_ws("\n", F.lit(RECORD), *[F.concat(F.lit(f"{c}: "), VAL.embedding_field(F.col(c), kinds[c])) for c in columns])
    out = indicators.withColumn("embedding_text", text)
    return out if dry_run else out.withColumn("embedding", encode(F.col("embedding_text")))


def evaluate(cases: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each case, summary)."""
    results = evaluation.case_results(evaluation.grade(cases, answers), cases, answers)
    return results, evaluation.summary(results)
