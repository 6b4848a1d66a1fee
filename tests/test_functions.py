"""Text, date, value, JSON and HTML functions on small literal rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import dates as D
from quillstone.functions import html as H
from quillstone.functions import structured as S
from quillstone.functions import text as T
from quillstone.functions import values as V
from quillstone.functions import vectors as X


def one(spark, column, *values, types="string"):
    """The column's value for each row of a frame with columns a, b, ..."""
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    types = types.split(",") * len(rows[0]) if "," not in types else types.split(",")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} {t}" for n, t in zip("abcdef", types[: len(rows[0])], strict=False)))
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


@pytest.fixture(autouse=True)
def columns(spark):
    """Columns a and b: they need a session."""
    globals().update(a=F.col("a"), b=F.col("b"))


def test_normalising(spark):
    assert one(spark, T.normalized_text(a), "Tax: 1,200.5 (A&B)", None, "") == ["tax 1200 5 a b", "", ""]
    assert one(spark, T.query_terms(a, extra=("springfield",)), "What is the current Springfield tax rate in 2024, tax?") == [["tax"]]
    assert one(spark, T.query_terms(a, T.JUDGE_STOPWORDS), "What is the rate of tax") == [["rate", "tax"]]
    assert one(spark, T.keywords(a, 3), "Approval of Transit Funding, Sewers and Parks") == [["transit", "funding", "sewers"]]
    assert one(spark, T.english_lexemes("a"), "The running dogs relate to rationality", None) == [["run", "dog", "relat", "rational"], []]
    lex = F.array(F.lit("run"), F.lit("dog"))
    assert one(spark, F.array(T.matches_any(lex, F.array(F.lit("dog"), F.lit("x"))), T.matches_all(lex, F.array(F.lit("dog"), F.lit("x"))), T.matches_any(lex, F.array().cast("array<string>"))), "") == [[True, False, False]]


def test_sentences_and_tokens(spark):
    assert one(spark, T.sentences(a), "One. Two!  Three?\n\nFour", " ", None) == [["One.", "Two!", "Three?", "Four"], [], []]
    assert one(spark, T.token_estimate(a), "a b c", "", None) == [4, 0, 0]
    assert len(one(spark, T.truncate_for_embedding(a), "w " * 600)[0].split()) == 393
    assert one(spark, T.snippet(a, 3), "abcd", "abc") == ["abc…", "abc"]
    assert one(spark, T.subject_windows(a, F.array(F.lit("tax")), 6), "the tax is a Tax", "none here") == [["tax is", "Tax"], ["none here"]]


def test_excerpt():
    text = "x" * 50 + " needle " + "y" * 3000 + " rare " + "needle " * 9
    out = T.excerpt(text, ["needle", "rare"], budget=400, head=40, radius=30)
    assert out.startswith("x" * 40) and "rare" in out and " … " in out and len(out) <= 430
    assert T.excerpt("short", ["a"]) == "short" and T.merge_intervals([(5, 8), (0, 2), (2, 3), (7, 9)]) == [(0, 3), (5, 9)]


def test_similarity_and_citations(spark):
    pairs = [("the big tax", "the big tax"), ("alpha beta", "gamma delta"), ("", "x"), ("ab cd", "ab cd")]
    assert one(spark, T.content_similarity(a, b), *pairs) == [1.0, 0.0, 0.0, 0.0]
    assert one(spark, T.citation_key(a, b), ("Sec. 4-13-2. Levy", None), ("Chapter 12", "text"), ("none", None)) == ["section:4-13-2", "chapter:12", None]
    assert one(spark, T.citation_tokens(a), "Chapter 4.1 and chapter 4.1, Appendix R") == [["CH4.1", "APXR"]]
    assert one(spark, T.heading_has_prefix(a, b), ("Chapter 4 Taxes", "chapter 4"), ("Chapter 41", "chapter 4"), ("Chapter 4", "chapter 4")) == [True, False, True]
    assert one(spark, T.supplement_number(a), "Supplement 177 (update)", "none") == [177, None]
    assert one(spark, T.section_heading(a)["title"], "Sec. 4-13-2. Levy of tax.") == ["Levy of tax"]
    labels = {"p:1": "[Code, page 2]"}
    assert T.rewrite_citations("Rate is 5% [chunk:p:1] [chunk:p:1]. More [chunk:zz].", labels) == "Rate is 5% [Code, page 2]. More."
    assert T.rewrite_citations("open [chunk:p:1", labels) == "open p:1"


def test_answers(spark):
    assert one(spark, T.is_refusal(a), "", None, "I cannot find it", "The documents do not state a rate.", "It is 5%.") == [True, True, True, True, False]
    pairs = spark.createDataFrame([(1, "The code allows sheds.", "permits sheds"), (2, "rate of 5 percent for hotels", "hotels percent 5 rate"), (3, "no", "a b c d"), (4, "x", "")], "i int, a string, b string")
    made = pairs.withColumn("x", T.answer_tokens("a")).withColumn("y", T.answer_tokens("b"))
    assert [r.t for r in made.select("i", T.tolerant_contains(F.col("x"), F.col("y")).alias("t")).orderBy("i").collect()] == [True, True, False, True]
    assert one(spark, T.has_number(a), "5%", "id 123e4567-e89b-12d3-a456-426614174000", "none") == [True, False, False]
    assert one(spark, T.is_uuid(a), "123e4567-e89b-12d3-a456-426614174000", "x", None) == [True, False, False]
    assert one(spark, T.normalize_claim(a), "  A  B ") == ["a b"]
    assert one(spark, T.with_caveats(a, T.caveat_list(F.lit("Note. "), F.lit("Note."), F.lit(None))), " x ", "x Note.") == ["x\n\nCaveats: Note.", "x Note."]
    assert one(spark, T.append_caveat(a, F.lit("Note.")), None, " ", "See Note. 2", "More.") == ["Note.", "Note.", "See Note. 2", "More. Note."]
    missing = T.citation_label(a, F.lit(None).cast("int"), F.lit(None).cast("timestamp"))
    assert one(spark, missing, "T") == ["[T, page n/a, retrieved retrieval date unavailable]"]
    assert one(spark, T.non_blank(a), " x ", "  ") == ["x", None]
    assert one(spark, T.question_style(a), "list all fees", "what is the rate", "tell me about the way that the county sets its many rates please", "a question of more than eight words about nothing at all") == ["structured", "terse", "conversational", "structured"]


def test_dates_in_urls(spark):
    urls = ["https://x.org/a/BOS_1990-01-08.pdf", "https://x.org/Minutes-March-10-2026.pdf", "https://x.org/04-22-2025%20Final.pdf", "https://x.org/07-16-24_Final.pdf", "https://x.org/092424_Final_Summary.pdf", "https://x.org/2019/may1-board.pdf", "https://x.org/2019/mar-12/agenda.pdf", "https://x.org/2023-02-30.pdf", "https://x.org/none.pdf"]
    day = dt.date
    assert one(spark, D.date_from_url(a), *urls) == [day(1990, 1, 8), day(2026, 3, 10), day(2025, 4, 22), day(2024, 7, 16), day(2024, 9, 24), day(2019, 5, 1), day(2019, 3, 12), None, None]
    assert one(spark, D.year_from_path(a), "https://x.org/b/agenda-2018", "https://x.org/2017/b", "https://x.org/b") == [2018, 2017, None]


def test_dates(spark):
    d = a.cast("date")
    assert one(spark, D.fiscal_year(d), "2024-06-30", "2024-07-01") == [2024, 2025]
    assert one(spark, D.historical_year(a), "rates in 1998 and 2003", "rates in 2030") == [1998, None]
    assert one(spark, D.document_fiscal_year(F.lit(None).cast("int"), a), "FY2026 adopted", "fiscal year 2025", "x") == [2026, 2025, None]
    assert one(spark, D.document_date_score(F.lit(None).cast("int"), F.lit(None).cast("timestamp"), a), "FY2026", "report March 5, 2020", "report 2020-03-05", "none") == [1002026.0, 18326.0, 18326.0, None]
    assert one(spark, D.backoff_minutes(a.cast("int")), "1", "2", "3", "9") == [1, 5, 30, 30]
    assert one(spark, D.rounded_percent(a.cast("int"), b.cast("int")), ("1", "8"), ("1", "0")) == [13, None]
    assert one(spark, D.normalized_date(a), "2024-05-06T01:02:03Z", "x", None) == [dt.date(2024, 5, 6), None, None]
    assert one(spark, D.effective_date_from_stage(a, F.lit(2026)), "adopted", "advertised") == [dt.date(2025, 7, 1), None]


def test_json_and_arrays(spark):
    assert one(spark, S.json_object(a), '```json\n{"a": {"b": 1}}\n``` x', "none") == ['{"a": {"b": 1}}', None]
    assert one(spark, S.first_json_object(a), 'x {"a": {"b": 1}} y') == ['{"a": {"b": 1}']
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, S.selected_ids(arr("b", "z", "b", "a"), arr("a", "b")), "") == [["b", "a"]]
    assert one(spark, S.within(arr(1, 2), arr(1)), "") == [False]
    spans = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in ((5, 8), (0, 2), (2, 3))])
    assert [tuple(x) for x in one(spark, S.merged_intervals(spans), "")[0]] == [(0, 3), (5, 8)]
    assert one(spark, S.json_with(a, "k", F.lit("v")), '{"a":"1","k":"0"}') == ['{"a":"1","k":"v"}']


def test_html(spark):
    page = "<p>A&nbsp;&amp; B</p><script>x<y</script><a href='/p?q=1'>l</a> <a href=\"mailto:x\">m</a><a href='b#c'>n</a>"
    assert one(spark, H.strip_html(a), page) == ["A & B l m n"]
    assert one(spark, H.links(F.lit("https://x.org/d/e"), a), page) == [["https://x.org/p?q=1", "https://x.org/d/b"]]
    table = "<table><tr><th rowspan=2>Kind</th><th colspan=2>Rate</th></tr><tr><th>2024</th><th>2025</th></tr><tr><td>Hotel</td><td>5%</td><td>6%</td></tr><tr><td>Bed</td><td colspan=2>1%</td></tr></table>"
    assert H.table_lines(table) == ["Kind: Hotel; Rate > 2024: 5%; Rate > 2025: 6%", "Kind: Bed; Rate > 2024: 1%; Rate > 2025: 1%"]
    assert H.section_text("<div id='a'>x<div>y</div>z</div><div id='b'>w</div>", "a") == "x y z" and H.section_text("<p>", "q") is None
    tree = one(spark, H.contents_tree("a"), "<ul><li id='1'><a href='/c1'>Ch 1</a><ul><li id='2'>Sec 1</li></ul></li><li id='3'>Ch 2</li></ul>")[0]
    assert [(i.id, i.parent, i.level, i.heading, i.has_children) for i in tree] == [("1", None, 1, "Ch 1", True), ("2", 0, 2, "Sec 1", False), ("3", None, 1, "Ch 2", False)]


def test_vectors(spark):
    u = F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, F.round(X.cosine_distance(u, F.array(F.lit(1.0), F.lit(1.0))), 4), "") == [0.2929]
    assert one(spark, X.cosine_similarity(u, F.array(F.lit(0.0), F.lit(0.0))), "") == [None]
    assert np.linalg.norm(X.encode_text("some words")) == pytest.approx(1) and X.preflight(X.encode_text) is None
    with pytest.raises(ValueError):
        X.preflight(lambda t: [0.0])


def candidate(**k):
    return {"table": "indicators", "id": "1", "document_id": "d1", "rrf_score": 0.01, "content": "", "program": None, "indicator_name": None, "department": None, "unit": None, "value_actual": None, "fiscal_year": None, "is_current": None, "effective_date": None, "doc_title": None, "doc_filename": None, "doc_url": None, "doc_stage": None, "doc_fiscal_year": None} | k


SCHEMA = "table string, id string, document_id string, rrf_score double, content string, program string, indicator_name string, department string, unit string, value_actual double, fiscal_year int, is_current boolean, effective_date date, doc_title string, doc_filename string, doc_url string, doc_stage string, doc_fiscal_year int"


def frame(spark, *rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return V.with_columns(spark.createDataFrame([tuple(candidate(**r)[n] for n in names) for r in rows], SCHEMA))


def test_question_shapes(spark):
    q = ("What is the current tax rate?", "What was the rate in 1998?", "rate as of May", "hello")
    assert one(spark, V.wants_current(a), *q) == [True, False, False, False]
    assert one(spark, V.is_historical_only(a), *q) == [False, True, True, False]


def test_provision_values(spark):
    q = F.lit("what is the current transient occupancy tax rate")
    levy = "There is hereby imposed and levied a tax equivalent to three percent of the transient occupancy charge."
    rows = frame(
        spark,
        {"table": "provisions", "is_current": True, "content": levy},
        {"table": "provisions", "is_current": True, "content": levy + " In addition to the tax imposed by subsection a, a tax at the rate of two percent."},
        {"table": "provisions", "is_current": True, "content": levy + " A penalty of ten percent."},
        {"table": "provisions", "is_current": False, "content": levy},
        {"table": "provisions", "is_current": True, "content": "The transient occupancy tax is mentioned with 25 percent."},
    )
    got = [r.x for r in rows.select(V.provision_value(q, T.query_terms(q)).alias("x")).collect()]
    assert got == ["3%", "5%", None, None, None]


def test_narrative_values(spark):
    q = F.lit("current meals tax")
    texts = ["The meals tax, as adopted, was increased from 4 percent to 5 percent", "The meals tax rate is 4%.", "The meals tax rate would be 6%.", "nothing"]
    df = frame(spark, *({"table": "narratives", "content": t} for t in texts))
    assert [r.x for r in df.select(V.narrative_value(T.query_terms(q), 2028).alias("x")).collect()] == ["5 percent", "4%", None, None]


def test_values_and_formats(spark):
    assert one(spark, V.format_value(a.cast("double"), b), ("1.12", "dollars per $100"), ("6", "percent"), ("5", "tons")) == ["$1.12 per $100", "6%", "5 tons"]
    assert one(spark, V.stage_from_url(a), "https://x/FY2026/Adopted/a.pdf", "https://x/fy2026/advertised/adopted-budget.pdf", "https://x/FY2026-Adopted") == ["adopted", "advertised", None]
    assert one(spark, V.canonical_indicator(a), "FY 2026 Adopted Real Estate Tax Rate", "Other 2025", "2026  approved Visits draft", "Adopted") == ["Real Estate Tax rate", "Other 2025", "Visits", "Adopted"]
