"""Operators on literal scenarios: fusion, versions, corroboration, history, hierarchies, crawls, chunks, queues, streams, tables and entry points."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone import schemas
from quillstone.operators import chunking, constraints, current_value, evaluation, graph, relational, retrieval, temporal
from quillstone.plans import engine
from quillstone.sources import readers, sinks
from quillstone.streaming import queue, windows

day, ts = dt.date, dt.datetime


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_fusion(spark):
    lex = spark.createDataFrame([("t", 1, 1), ("t", 2, 2), ("u", 1, 3)], "table string, id int, rank int")
    vec = spark.createDataFrame([("t", 2, 1), ("u", 9, 2)], "table string, id int, rank int")
    got = {(r["table"], r.id): r.rrf_score for r in retrieval.fuse([lex, vec], ["table", "id"]).collect()}
    assert got == {("t", 1): pytest.approx(1 / 61), ("t", 2): pytest.approx(1 / 62 + 1 / 61), ("u", 1): pytest.approx(1 / 63), ("u", 9): pytest.approx(1 / 62)}
    empty = lex.where("false")
    assert retrieval.fuse([empty, empty], ["table", "id"]).count() == 0 and retrieval.search_is_incomplete(retrieval.fuse([empty, vec.where("false")], ["table", "id"])).first().incomplete


def test_empty_query_matches_nothing(spark):
    df = spark.createDataFrame([(1, ["a"])], "id int, l array<string>")
    assert retrieval.lexical_top_k(df, "id", F.col("l"), []).count() == 0


def test_lsh_is_a_subset_ranked_exactly(spark):
    df = spark.createDataFrame([(i, [float(i % 7) - 3, float(i % 5) - 2, float(i % 3)]) for i in range(200)] + [(999, None)], "id int, v array<double>")
    exact = [r.id for r in retrieval.vector_top_k(df, "id", "v", [1.0, 1.0, 1.0], 10).collect()]
    near = [r.id for r in retrieval.vector_top_k_lsh(df, "id", "v", [1.0, 1.0, 1.0], 10).collect()]
    assert len(set(exact) & set(near)) >= 7 and 999 not in exact


def test_as_of(spark):
    v = spark.createDataFrame([("a", day(2020, 1, 1), day(2021, 1, 1)), ("a", day(2021, 1, 1), None)], "k string, effective_date date, superseded_date date")
    at = lambda *d: [r.effective_date for r in relational.as_of_rows(v, "k", F.lit(day(*d))).collect()]
    assert at(2019, 12, 31) == [] and at(2020, 1, 1) == [day(2020, 1, 1)] and at(2021, 1, 1) == [day(2021, 1, 1)] and at(2030, 1, 1) == [day(2021, 1, 1)]


def test_hard_filter(spark):
    df = spark.createDataFrame([(1, "n", True), (2, "n", False), (3, "m", False), (4, None, False)], "id int, node string, is_current boolean")
    assert rows(temporal.hard_version_filter(df, [], "node"), "id", "has_history") == [(1, True), (3, False), (4, False)]


@pytest.mark.parametrize(("votes", "value"), [([(1.0, "a"), (1.0, "b")], 1.0), ([(1.0, "a"), (1.0, "b"), (1.1, "c")], 1.0), ([(1.0, "a"), (1.1, "b")], None), ([(1.0, "a"), (1.0, "b"), (5.6, "c")], None), ([(1.0, "a"), (1.1, "b"), (1.1, "b")], None), ([(2.0, "a")], 2.0)])
def test_corroboration(spark, votes, value):
    df = spark.createDataFrame([("k", *v) for v in votes], "k string, v double, d string")
    assert relational.corroborated(df, "k", "v", "d").first().v == value


def test_history(spark):
    data = [("k", "A", day(2020, 1, 1), 1), ("k", "A", day(2020, 6, 1), 2), ("k", "B", day(2021, 1, 1), 3), ("k", "C", day(2019, 1, 1), 4), ("k", "A", day(2022, 1, 1), 5)]
    df = spark.createDataFrame(data, "key string, hash string, effective_date date, arrival int")
    assert rows(temporal.history(df, "key", "hash", "effective_date"), "hash", "is_current") == [("A", False), ("A", True), ("B", False), ("C", False)]
    assert rows(temporal.history_by_arrival(df), "hash", "superseded_date", "is_current") == [("A", day(2021, 1, 1), False), ("B", None, True)]
    undated = spark.createDataFrame([("k", "A", ts(2020, 1, 1), 1), ("k", "B", None, 2), ("k", None, ts(2024, 1, 1), 3)], "key string, hash string, effective_date timestamp, arrival int")
    assert rows(temporal.history_by_arrival(undated), "hash", "superseded_date", "is_current") == [("A", None, True)]
    nulls = spark.createDataFrame([("k", None, day(2020, 1, 1)), ("k", None, day(2021, 1, 1)), ("k", "A", day(2022, 1, 1))], "key string, hash string, effective_date date")
    assert temporal.history(nulls, "key", "hash", "effective_date").count() == 2


def test_mode(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", None), ("c", 3), ("c", 3), ("c", 1)], "k string, v int")
    assert rows(relational.mode_smallest(df, "k", "v"), "k", "value") == [("a", 1), ("b", None), ("c", 3)]


def test_ancestors_and_paths(spark):
    n = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y"), ("o", "gone", "O"), ("b", "a", "B2")], "node_id string, parent_id string, label string")
    start = spark.createDataFrame([("c",), ("x",), ("o",)], "node_id string")
    assert rows(graph.ancestors(n, start), "start", "node_id", "distance") == [("c", "a", 2), ("c", "b", 1), ("c", "c", 0), ("o", "gone", 1), ("o", "o", 0), ("x", "x", 0), ("x", "y", 1)]
    assert {r.start: r.path for r in graph.ancestor_paths(n, start, label="label").collect()}["c"] == ["A", "B", "C"]


def test_crawl_resumes(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "a"), ("d", "e")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "url string")
    whole, rest = graph.crawl(links, seeds, 2)
    assert rows(whole, "url", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)] and rest.count() == 0
    visited, frontier = graph.crawl(links, seeds, 2, most_pages=2)
    again, _ = graph.crawl(links, seeds, 2, state=graph.crawl_state(visited, frontier))
    assert rows(again, "url", "depth") == rows(whole, "url", "depth")


def test_url_predicates(spark):
    u = ["https://x.org/a.pdf", "http://x.org/a", "https://127.0.0.1/x", "https://u:p@x.org/", "https://10.1.1.1/", "https://sub.x.org/b.HTML"]
    df = spark.createDataFrame([(v,) for v in u], "u string")
    got = df.select(graph.safe_to_fetch(F.col("u")).alias("s"), graph.is_document(F.col("u")).alias("d"), graph.same_host(F.col("u"), F.lit("https://X.org/")).alias("h"), graph.allowed(F.col("u"), ["https://x.org", "regex:html$"]).alias("p")).collect()
    assert [r.s for r in got] == [True, False, False, False, False, True] and [r.d for r in got] == [True, False, False, False, False, False]
    assert [r.h for r in got] == [True, True, False, True, False, False] and [r.p for r in got] == [True, False, False, False, False, False]


def test_change_actions(spark):
    known = spark.createDataFrame([("a", '"e1"', "h"), ("b", None, "h"), ("c", None, "h")], "url string, validator string, content_hash string")
    seen = spark.createDataFrame([("a", 'W/"E1"', "zz"), ("b", None, "h"), ("c", "e", "h2"), ("d", None, "h")], "url string, validator string, content_hash string")
    assert rows(engine.detect_changes(known, seen), "url", "action") == [("a", "skip"), ("b", "touch"), ("c", "changed"), ("d", "new")]


def test_identity(spark):
    cur = spark.createDataFrame([("n1", "Sec. 4-1-1. Levy", "the hotel levy applies to rooms"), ("n2", "Sec. 4-1-2", "other words entirely different")], "node_id string, heading string, content string")
    old = spark.createDataFrame([("n1", "x", "y"), ("h1", "Sec. 4-1-1", "the hotel levy applies to rooms now"), ("h2", "Sec. 4-1-2", "nothing shared whatsoever"), ("h3", "none", "z")], "raw_id string, heading string, content string")
    assert rows(temporal.resolve_identity(old, cur), "raw_id", "node_id", "strategy") == [("h1", "n1", "citation-current-node"), ("h2", "h2", "historical-node"), ("h3", "h3", "historical-node"), ("n1", "n1", "raw-current-node")]


def test_repair(spark):
    df = spark.createDataFrame([(1, "n", "A", day(2020, 1, 1), False), (2, "n", "A", day(2021, 1, 1), True), (3, "n", "B", day(2022, 1, 1), False)], "id int, node string, h string, effective_date date, is_current boolean")
    fixed, mapping = temporal.repair_history(df, "node", "h", "id")
    assert rows(fixed, "id", "superseded_date", "is_current") == [(1, day(2022, 1, 1), False), (3, None, True)] and rows(mapping, "old", "new") == [(2, 1)]
    temporal.assert_counts(temporal.repair_counts(fixed, "node", "h"), groups=0, excess=0, without_current=0)
    with pytest.raises(ValueError):
        temporal.assert_counts(temporal.repair_counts(df, "node", "h"), groups=0)


def test_chunks(spark):
    assert chunking.chunk_blocks([]) == [] and chunking.chunk_ranges([600, 10, 10]) == [(0, 1), (1, 3), (2, 3)]
    blocks = [{"text": f"Sentence number {k} has some words in it.", "page_no": k, "reading_order_index": k} for k in range(40)]
    want = chunking.chunk_blocks(blocks, target=60)
    assert want == chunking.chunk_blocks(blocks[::-1], target=60)
    assert want[0]["sentence_start"] == 0 and want[-1]["sentence_end"] == 40 and all(a["sentence_end"] >= b["sentence_start"] > a["sentence_start"] for a, b in zip(want, want[1:], strict=False))
    df = spark.createDataFrame([("d", b["text"], b["page_no"], b["reading_order_index"]) for b in blocks], "document_id string, text string, page_no int, reading_order_index int")
    got = chunking.chunk_documents(df.repartition(3), target=60).orderBy("chunk_index").collect()
    assert [(r.text, r.page_start, r.overlap_prev) for r in got] == [(c["text"], c["page_start"], c["overlap_prev"]) for c in want]
    n = spark.createDataFrame([("d", 7), ("e", 0)], "document_id string, page_count int")
    done = spark.createDataFrame([("d", 4)], "document_id string, first_page int")
    assert rows(chunking.page_ranges(n, done=done), "first_page", "last_page") == [(1, 3), (7, 7)]


EVENTS = [(1, "k", ts(2024, 1, 1, 0)), (2, "k", ts(2024, 1, 1, 5)), (3, "k", ts(2024, 1, 1, 7)), (4, "k", ts(2024, 1, 1, 13)), (5, "j", ts(2024, 1, 1, 6))]


def test_cooldown(spark):
    df = spark.createDataFrame(EVENTS, "event_id int, key string, ts timestamp")
    assert rows(windows.cooldown(df, ["key"]), "event_id") == [(1,), (3,), (4,), (5,)]


def test_streams_equal_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([*EVENTS, (6, "z", ts(2024, 1, 9))], "event_id int, key string, ts timestamp")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    windows.run_available(windows.stream_minute_counts(stream, "key"), str(tmp_path / "o"), str(tmp_path / "c"))
    got = rows(spark.read.parquet(str(tmp_path / "o")), "key", "window_start", "requests")
    assert got == rows(windows.minute_counts(df.where("key <> 'z'"), "key"), "key", "window_start", "requests")
    windows.run_available(windows.stream_cooldown(stream, "key"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert rows(spark.read.parquet(str(tmp_path / "o2")), "key", "written_at") == rows(windows.cooldown(df, ["key"]), "key", "ts")


def test_queue(spark):
    now = F.lit(ts(2024, 1, 2))
    schema = "id string, url string, doc_type string, status string, attempts int, detected_at timestamp, next_attempt_at timestamp, started_at timestamp, last_error string"
    q = spark.createDataFrame([(str(k), "u", "t", s, a, ts(2024, 1, 1), n, st, None) for k, (s, a, n, st) in enumerate([("pending", 0, None, None), ("pending", 1, ts(2025, 1, 1), None), ("done", 0, None, None), ("pending", 49, None, None), ("processing", 0, None, ts(2024, 1, 1))])], schema)
    claimed, taken = queue.claim(q, now, 5)
    assert rows(taken, "id") == [("0",), ("3",)]
    out = spark.createDataFrame([("0", "failed", "e"), ("3", "failed", "e")], "id string, outcome string, error string")
    done = {r.id: r for r in queue.settle(claimed, out, now).collect()}
    assert (done["0"].status, done["0"].attempts, done["0"].next_attempt_at) == ("pending", 1, ts(2024, 1, 2, 0, 1)) and (done["3"].status, done["3"].attempts) == ("failed", 50)
    fixed, alerts = queue.watchdog(q, now)
    assert rows(alerts, "alert_key", "stuck_since") == [("4", ts(2024, 1, 1))] and fixed.where("id = '4'").first().status == "pending"
    new = spark.createDataFrame([("r", "k", ts(2024, 1, 2)), ("r", "j", ts(2024, 1, 2)), ("r", "j", ts(2024, 1, 2, 1))], "reason string, alert_key string, triggered_at timestamp")
    old = spark.createDataFrame([("r", "k", ts(2024, 1, 1, 20))], "reason string, alert_key string, triggered_at timestamp")
    assert rows(queue.suppress(new, old), "alert_key", "triggered_at") == [("j", ts(2024, 1, 2))]
    assert queue.run_phases(("a", lambda: 1 / 0), ("b", lambda: None)) == {"a": "ZeroDivisionError: division by zero", "b": None}


def test_tables(spark, tmp_path):
    t = sinks.Table(spark, str(tmp_path / "t"), "id string, v int")
    frame = lambda *r: spark.createDataFrame(list(r), "id string, v int")
    assert t.read().count() == 0
    t.append(frame(("a", 1), ("b", 2)))
    t.upsert(frame(("b", 3), ("c", 4)), "id")
    t.insert_if_absent(frame(("a", 9), ("d", 5)), "id")
    assert rows(t.read(), "id", "v") == [("a", 1), ("b", 3), ("c", 4), ("d", 5)]
    with pytest.raises(ValueError):
        sinks.checked_write(frame(("a", 1), ("a", 2)), str(tmp_path / "x"), unique=constraints.repeated(frame(("a", 1), ("a", 2)), "id"))
    assert sinks.failed("NOT_FOUND", "x") == (404, {"ok": False, "error": {"code": "NOT_FOUND", "message": "x"}})


def test_readers(spark, tmp_path):
    (tmp_path / "seeds.json").write_text(json.dumps([{"source_id": "a", "doc_type": "t", "discovery_urls": ["https://x.org"], "depth": 1}, {"source_id": "b", "doc_type": "t"}, {"source_id": "c", "doc_type": "t", "api_base": "https://y.org"}]))
    good, bad = readers.seeds(spark, str(tmp_path / "seeds.json"))
    assert rows(good, "source_id") == [("a",), ("c",)] and rows(bad, "source_id", "issue") == [("b", "neither crawled nor API")]
    cases = tmp_path / "cases"
    cases.mkdir()
    (cases / "1.json").write_text(json.dumps({"id": "c1", "category": "x", "query": "q", "chunk_ids": ["k"], "criteria": [{"id": "1", "check": {"type": "contains", "value": "five percent"}}]}))
    (cases / "2.json").write_text(json.dumps([{"id": "c2", "category": "y", "query": "q", "chunk_ids": [], "criteria": [{"id": "1", "check": {"type": "is_refusal"}}]}, {"id": "c3", "category": "y", "query": "q", "chunk_ids": [], "criteria": []}]))
    got = readers.eval_cases(spark, str(cases))
    answers = spark.createDataFrame([("c1", "It is five percent.", ["k"]), ("c2", "It is six.", [])], "case_id string, answer string, cited_chunk_ids array<string>")
    results, summary = engine.evaluate(got, answers)
    assert rows(results, "case_id", "status") == [("c1", "pass"), ("c2", "fail"), ("c3", "skipped")]
    s = summary.first()
    assert (s.total, s.ran, s.overall_pct, s.correctness_pct, s.false_assertions, s.availability_pct) == (3, 2, 50, 50, 1, 100)
    assert evaluation.summary(results.where("false")).first().overall_pct is None
    df = spark.createDataFrame([("u1", "ok"), ("u2", "boom")], "u string, body string")
    parsed = readers.per_row(df, "body", lambda t: [{"n": len(t)}] if t == "ok" else 1 / 0, "n int", ["u"])
    assert [(r.u, r.n, r.error) for r in parsed.orderBy("u").collect()] == [("u1", 2, None), ("u2", None, "ZeroDivisionError: division by zero")]
    with pytest.raises(ValueError):
        readers.one_row(df, F.lit(True))


def test_constraints(spark):
    docs = spark.createDataFrame([("1", "u", "current"), ("2", "u", "odd")], "id string, url string, status string")
    prov = spark.createDataFrame([("p", "9", "n", day(2020, 1, 1), True), ("q", "1", "n", day(2021, 1, 1), True)], "id string, document_id string, node_id string, effective_date date, is_current boolean")
    found = {r.rule: r.violations for r in constraints.report(**schemas.violations("documents", {"documents": docs}), **schemas.violations("provisions", {"documents": docs, "provisions": prov})).collect()}
    assert found == {"documents.status is a known value": 1, "documents.(url) is unique": 1, "provisions.(node_id, effective_date) is unique": 0, "provisions.document_id refers to documents": 1, "provisions: one current version a node": 1}
    for ddl in schemas.TABLES.values():
        assert spark.createDataFrame([], ddl).count() == 0
    keyed = spark.createDataFrame([("a", None, "x"), (" A ", None, "x"), ("a", "b", "x")], "k string, l string, m string")
    assert constraints.drop_repeats(keyed, ["k", "l", "m"], [F.col("k")], ["m"]).count() == 2


QUESTION = "What is the current hotel tax rate?"


def world(spark):
    docs = spark.createDataFrame([("d1", "current", "Adopted Budget", "https://x/adopted", "f", "adopted", 2025), ("d2", "superseded", "Old", "https://x/old", "f", None, 2015), ("d3", "current", "Second", "https://x/second", "f", "adopted", 2025)], "id string, status string, title string, url string, filename string, budget_stage string, fiscal_year int").withColumn("source_published_at", F.lit(None).cast("timestamp"))
    ind = spark.createDataFrame([("i1", "d1", "hotel tax rate is 6", "Hotel Tax Rate", "percent", 6.0, 2025), ("i2", "d3", "hotel tax rate is 6", "Hotel Tax Rate", "percent", 6.0, 2025), ("i3", "d1", "hotel tax", "Hotel Tax increase", "percent", 3.0, 2025), ("i4", "d2", "hotel tax rate", "Hotel Tax Rate", "percent", 4.0, 2015)], "id string, document_id string, content string, indicator_name string, unit string, value_actual double, fiscal_year int").withColumn("embedding", F.array([F.lit(float(x)) for x in (0.1,) * 384]))
    nar = spark.createDataFrame([("n1", "d1", "The hotel tax was discussed at length."), ("n2", "d1", "Sewers and parks.")], "id string, document_id string, content string").withColumn("embedding", F.array([F.lit(float(x)) for x in (0.1,) * 384]))
    return {"indicators": ind, "narratives": nar}, docs


def test_engine(spark):
    tables, docs = world(spark)
    e = engine.Engine(tables, docs)
    fused = e.search("hotel tax")
    assert "i4" not in {r.id for r in fused.collect()}
    got = e.answer(QUESTION)
    assert got.answer and got.citations and got.calls >= 2
    assert engine.Engine(tables, docs, engine.Models(judge=lambda q, r: ["nope"])).answer(QUESTION).answer == engine.REFUSAL
    flagged = engine.Engine(tables, docs, engine.Models(verify=lambda q, a, r: ["6"], draft=lambda q, r: {"answer": "It is 6."})).answer(QUESTION)
    assert flagged.calls <= engine.MOST_CALLS and flagged.unverified
    with pytest.raises(ValueError):
        e.answer(" ")
    assert e.current_value(QUESTION) == {"source": "indicators", "value": "6%", "section": None}
    assert e.current_value("hotel tax rate in 1998")["value"] is None


def test_disagreement_declines(spark):
    tables, docs = world(spark)
    tables["indicators"] = tables["indicators"].withColumn("value_actual", F.when(F.col("id") == "i2", 7.0).otherwise(F.col("value_actual")))
    assert engine.Engine(tables, docs).current_value(QUESTION)["value"] is None


def test_jobs(spark):
    docs = spark.createDataFrame([("1", "https://x/2024-05-06.pdf"), ("2", "https://x/none"), ("3", "https://x/none")], "id string, url string")
    ext = spark.createDataFrame([("2", day(2020, 1, 2)), ("2", day(2020, 1, 1)), ("1", day(1999, 1, 1))], "document_id string, extracted_date date")
    assert rows(engine.document_dates(docs, ext), "id", "document_date", "date_source") == [("1", day(2024, 5, 6), "url"), ("2", day(2020, 1, 1), "extracted"), ("3", None, None)]
    dec = spark.createDataFrame([("x", "d", "approve hotel levy"), ("y", "d", "sewer plan")], "id string, document_id string, subject string")
    dec = dec.unionByName(spark.createDataFrame([("z", "d", "Chapter 41 sewer plan")], dec.schema))
    votes = spark.createDataFrame([("v1", "d", "motion on the hotel levy"), ("v2", "d", "sewer plan"), ("v3", "d", "sewer plan"), ("v4", "d", "amend Ch. 41")], "id string, document_id string, motion_text string")
    assert rows(engine.verify_votes(dec, votes), "decision_id", "vote_id", "matched_via") == [("x", "v1", "keyword"), ("z", "v4", "citation")]
    pend = spark.createDataFrame([("c1", "n", "new", "pending"), ("c2", "m", "new", "pending")], "id string, node_id string, proposed_text string, codification_status string")
    prov = spark.createDataFrame([("p", "n", "new", True)], "id string, node_id string, content string, is_current boolean")
    done = spark.createDataFrame([], "pending_change_id string, provision_id string")
    assert rows(engine.reconcile(pend, prov, lambda a, b: "matched" if a == b else "mismatch", done), "pending_change_id", "result") == [("c1", "matched"), ("c2", "not_found")]
    alerts = spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000", False, ts(2024, 1, 1))], "id string, acknowledged boolean, triggered_at timestamp")
    assert engine.open_alerts(engine.acknowledge(alerts, "123e4567-e89b-12d3-a456-426614174000")).count() == 0
    with pytest.raises(ValueError):
        engine.acknowledge(alerts, "x")
    ind = spark.createDataFrame([("a", None)], "k string, v int")
    assert engine.reembed(ind, None, ["k", "v"]).first().embedding_text == "budget_indicator\nk: a\nv: null"


def test_rerank_and_anchors(spark):
    tables, docs = world(spark)
    c = tables["indicators"].drop("embedding").withColumn("table", F.lit("indicators")).withColumn("rrf_score", F.lit(0.01)).join(docs.select(F.col("id").alias("document_id"), F.col("title").alias("doc_title"), F.col("budget_stage").alias("doc_stage"), F.col("fiscal_year").alias("doc_fiscal_year")), "document_id")
    ranked = current_value.rerank(c, QUESTION, 2025).select("id", "score").collect()
    assert [r.id for r in ranked][:2] == ["i1", "i2"] and ranked[0].score > 3_000_000 and {r.id for r in ranked if r.score == 0} >= {"i3"}
    assert [r.id for r in current_value.anchors(current_value.scored(c, QUESTION, 2025), "document_id", 2).collect()] == ["i1", "i2"]
    assert isinstance(pd.DataFrame(ranked), pd.DataFrame)
