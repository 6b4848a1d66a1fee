"""Queries for questions, labels, indicators, citations and values in text, over texts made from the driver's tables.

Each row of `orders` becomes a question, a passage, an indicator or a URL by a template that depends on its numbers;
no row is left out. Templates are expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import dates as D
from quillstone.functions import text as T
from quillstone.functions import values as V
from quillstone.operators import graph
from quillstone.plans import engine
from quillstone.plans.registry import query


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _like(column: str, pattern: str) -> str:
    """SQL for: column matches the pattern somewhere; null does not."""
    return f"coalesce(regexp_matches({column}, {_sql(pattern)}), false)"


def _plain(column: str) -> str:
    """SQL of text.normalized_text."""
    commas = f"regexp_replace(regexp_replace(lower(coalesce({column}, '')), '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g')"
    return f"trim(regexp_replace({commas}, '[^a-z0-9]+', ' ', 'g'))"


def _case(key: str, *templates: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(templates))
    return f"CASE CAST({key} % {len(templates)} AS INT) {whens} END"


_YEAR = "CAST(year(o_orderdate) + 25 AS STRING)"
_SMALL, _OTHER = "CAST(o_custkey % 90 + 1 AS STRING)", "CAST(o_orderkey % 70 + 2 AS STRING)"
QUESTION = _case(
    "o_orderkey", "'What is the current real estate tax rate?'", f"concat('Real estate tax rate in ', {_YEAR})",
    "'List the current and prior tax rates, as of January 2020, by district please'", "'Could you please explain how the county sets the personal property tax and what does this mean for us'",
    "'Show me the transient occupancy tax levy now'", f"concat('What was the fee before the ', {_YEAR}, ' budget')", "'compare the TOT rate today with the rate at the time of adoption'",
    "concat('park fee ', o_orderpriority)", "'a question without any of those words that goes on for rather more than eight of them'", "'  tell  me about the tax   rate '",
    "'summarize in March what changed'", f"concat('budget ', o_orderstatus, ' of ', {_YEAR})", "''",
)
PASSAGE = _case(
    "o_orderkey", f"concat('The adopted real estate tax rate is $', {_SMALL}, '.25 per $100 of assessed value, up from 1,234 cents.')", f"concat('The tax rate of ', {_SMALL}, '% was proposed and advertised.')",
    f"concat('Approved by the Board of Supervisors: adopted an increase of the rate from ', {_SMALL}, '% to ', {_OTHER}, '%.')",
    f"concat('A transient occupancy tax is hereby imposed at the rate of two percent. In addition to the tax imposed by subsection (a), an additional tax of ', {_SMALL}, ' percent.')",
    f"concat('The advertised budget plan has a tax rate of $', {_SMALL}, ' for FY ', {_YEAR})", "'Draft mark-up of rates; these would be lower'",
    f"concat('The decrease of the tax rate from $', {_SMALL}, ' to $', {_OTHER}, ' is final')", f"concat('A real estate tax is levied at the rate of ', {_OTHER}, '% of value')", "''", "CAST(NULL AS STRING)",
    f"concat('Adoption of the fiscal year ', {_YEAR}, ' tax rate; the ', {_SMALL}, '% draft')",
)
URL = _case(
    "o_custkey", f"concat('https://x.org/budget/FY', {_YEAR}, '/adopted/Volume2/a.pdf')", f"concat('https://x.org/fy', {_YEAR}, '/advertised/adopted-budget.DOCX')", f"concat('http://x.org/fy', {_YEAR}, '/fy', {_YEAR}, '-Adopted-Package.pdf')",
    "'https://x.org/Adopted%20Budget%20Summary.xls?v=2'", "'https://x.org/page?file=a.pdf'", "'https://x.org/table.csv'", "'https://x.org/CEX%20Letter.zip#top'", f"concat('https://x.org/fy', {_YEAR}, '/adopted-package/general-fund-revenue-overview.doc')",
    "'https://x.org/proposed/markup.xlsx'", "CAST(NULL AS STRING)",
)


def orders(spark: SparkSession, d: str, **templates: str) -> DataFrame:
    """o_orderkey and the templates' texts of every order."""
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", *[F.expr(t).alias(name) for name, t in templates.items()])


def _from(**templates: str) -> str:
    return "(SELECT o_orderkey, " + ", ".join(f"{t} AS {name}" for name, t in templates.items()) + " FROM orders)"


# ---------------------------------------------------------------- questions and answers

_HISTORICAL, _CURRENT = _like("q", V.HISTORICAL), _like("q", V.CURRENT)
_TAX, _RATE, _LEVY = _like("q", r"(?i)\btax\b"), _like("q", r"(?i)\brate\b"), _like("q", r"(?i)\b(rate|levy|occupancy|tot)\b")


@query(
    "question_shapes",
    f"""SELECT o_orderkey, {_HISTORICAL} AS historical, {_CURRENT} AS current, {_HISTORICAL} AND NOT {_CURRENT} AS historical_only, {_TAX} AND {_RATE} AS tax_rate,
    {_CURRENT} AND NOT {_HISTORICAL} AND {_TAX} AND {_LEVY} AS levy,
    CASE WHEN {_like("q", T.STRUCTURED_WORDS)} THEN 'structured' WHEN len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) <= {T.TERSE_WORDS} THEN 'terse'
      WHEN {_like("q", T.CONVERSATIONAL_WORDS)} THEN 'conversational' ELSE 'structured' END AS style
    FROM {_from(q=QUESTION)}""",
)
def question_shapes(spark, d):
    q = F.col("q")
    return orders(spark, d, q=QUESTION).select(
        "o_orderkey", V.is_historical(q).alias("historical"), V.wants_current(q).alias("current"), V.is_historical_only(q).alias("historical_only"),
        V.asks_tax_rate(q).alias("tax_rate"), V.asks_current_levy(q).alias("levy"), T.question_style(q).alias("style"),
    )


_PAGE, _DAY = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 50 END", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END"


@query(
    "citation_labels",
    f"""SELECT o_orderkey, '[' || title || ', ' || coalesce('page ' || page, 'page n/a') || ', retrieved ' || coalesce(strftime(day, '%Y-%m-%d'), 'retrieval date unavailable') || ']' AS label
    FROM {_from(title="o_orderpriority", page=_PAGE, day=_DAY)}""",
)
def citation_labels(spark, d):
    rows = orders(spark, d, title="o_orderpriority", page=_PAGE, day=_DAY)
    return rows.select("o_orderkey", T.citation_label(F.col("title"), F.col("page"), F.col("day")).alias("label"))


_ANSWER = _case("o_orderkey", "' The rate is 2%. Note A. '", "'Nothing.'", "'See Note B.'")
_NOTES = {"a": _case("o_custkey", "'Note A.'", "CAST(NULL AS STRING)", "' '"), "b": _case("o_custkey", "'Note B. '", "'Note A.'"), "c": _case("o_orderkey", "'Note A.'", "'More is to come.'", "CAST(NULL AS STRING)", "''")}


@query(
    "required_caveats",
    f"""WITH n AS (SELECT *, list_filter([trim(a), trim(b), trim(c)], lambda x: x IS NOT NULL AND x <> '') AS l FROM {_from(answer=_ANSWER, **_NOTES)}),
    m AS (SELECT *, list_filter(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: NOT contains(answer, x)) AS missing FROM n)
    SELECT o_orderkey, CASE WHEN len(missing) = 0 THEN answer ELSE trim(answer) || chr(10) || chr(10) || 'Caveats: ' || array_to_string(missing, ' ') END AS answer,
    CASE WHEN trim(coalesce(a, '')) = '' THEN b WHEN contains(a, b) THEN a ELSE a || ' ' || b END AS appended FROM m""",
)
def required_caveats(spark, d):
    rows = orders(spark, d, answer=_ANSWER, **_NOTES)
    return rows.select(
        "o_orderkey", T.with_caveats(F.col("answer"), T.caveat_list(F.col("a"), F.col("b"), F.col("c"))).alias("answer"), T.append_caveat(F.col("a"), F.col("b")).alias("appended")
    )


# ---------------------------------------------------------------- indicators

_NAME = _case(
    "o_orderkey", f"concat('FY ', {_YEAR}, ' Adopted  Real Estate   Tax Rate')", "'Personal Property (vehicle) tax RATE proposed'", f"concat({_YEAR}, ' TOT tax rate')", "'Approved Library visits Draft'",
    f"concat('Visits ', {_YEAR})", "'adopted'", "'Transient occupancy rate'", "concat(' current ', o_orderpriority, ' advertised ')", f"concat('fy', {_YEAR}, ' proposed')",
)
_BARE = f"trim(regexp_replace(regexp_replace(regexp_replace(n, '(?i)^(?:fy\\s*)?20[0-9]{{2}}\\s+', ''), '(?i)^(?:{V.STAGE_WORDS})\\s+', ''), '(?i)\\s+(?:{V.STAGE_WORDS})$', ''))"
_KNOWN = " ".join(f"WHEN {' AND '.join(_like('w', p) for p in patterns)} THEN {_sql(form)}" for form, patterns in V.CANONICAL_NAMES.items())


@query(
    "indicator_names",
    f"""WITH a AS (SELECT o_orderkey, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS n FROM {_from(name=_NAME)}), b AS (SELECT *, {_BARE} AS bare FROM a),
    c AS (SELECT *, trim(regexp_replace(lower(bare), '[^a-z0-9]+', ' ', 'g')) AS w FROM b) SELECT o_orderkey, CASE {_KNOWN} WHEN bare <> '' THEN bare ELSE n END AS name FROM c""",
)
def indicator_names(spark, d):
    return orders(spark, d, name=_NAME).select("o_orderkey", V.canonical_indicator(F.col("name")).alias("name"))


_FIELDS = {"indicator_name": _NAME, "value_actual": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey / 8 END", "unit": _case("o_custkey", "' per  $100 '", "''", "CAST(NULL AS STRING)"), "fiscal_year": "year(o_orderdate)"}


def _field(name: str) -> str:
    return f"'{name}: ' || coalesce(nullif(regexp_replace(trim({name}), '\\s+', ' ', 'g'), ''), 'null')"


@query(
    "embedding_texts",
    f"""SELECT o_orderkey, md5('budget_indicator' || chr(10) || {_field("indicator_name")} || chr(10) || 'value_actual: ' || coalesce(regexp_replace(printf('%.6f', value_actual::DOUBLE), '\\.?0+$', ''), 'null')
    || chr(10) || {_field("unit")} || chr(10) || 'fiscal_year: ' || coalesce(fiscal_year::VARCHAR, 'null')) AS digest FROM {_from(**_FIELDS)}""",
)
def embedding_texts(spark, d):
    return engine.reembed(orders(spark, d, **_FIELDS), None, list(_FIELDS)).select("o_orderkey", F.md5("embedding_text").alias("digest"))


_STAGES = " ".join(f"WHEN lower(url) LIKE {_sql(p)} THEN {_sql(s)}" for p, s in V.STAGE_RULES)


@query(
    "document_urls",
    f"""SELECT o_orderkey, CASE {_STAGES} END AS stage, {_like("lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1))", r"\.(pdf|docx?|xlsx?|zip)$")} AS document FROM {_from(url=URL)}""",
)
def document_urls(spark, d):
    return orders(spark, d, url=URL).select("o_orderkey", V.stage_from_url(F.col("url")).alias("stage"), graph.is_document(F.col("url")).alias("document"))


# ---------------------------------------------------------------- votes and citations

_SUBJECT = _case(
    "c_custkey", "concat('Amendment of Chapter ', CAST(c_custkey % 5 + 1 AS STRING), ' about parking districts and zoning permits')", "'Appendix I: speed limits on residential streets'", "'Proclamation of library week'",
    "'Appropriation for stormwater maintenance, chapter 41.1 and Appendix Q'", "CAST(NULL AS STRING)",
)
_MOTION = _case(
    "o_orderkey", "concat('Motion to amend Chapter ', CAST(o_orderkey % 5 + 1 AS STRING))", "'Motion on parking, districts and zoning'", "'To adopt APPENDIX I with limits on streets'", "'Library week was proclaimed'",
    "'Stormwater appropriation passed'", "'Residential parking permits, Ch. 41.1'", "''",
)
_STOP = "[" + ", ".join(map(_sql, T.KEYWORD_STOPWORDS)) + "]"


def _cites(x: str) -> str:
    number, letter = r"\bCH(?:APTER|\.)?\s*([0-9]+(?:\.[0-9]+)?)", r"\bAPP(?:ENDI)?X\s+([A-Z0-9]+)\b"
    up = f"upper(coalesce({x}, ''))"
    return f"list_concat(list_transform(regexp_extract_all({up}, {_sql(number)}, 1), lambda n: 'CH' || n), list_transform(regexp_extract_all({up}, {_sql(letter)}, 1), lambda n: 'APX' || n))"


@query(
    "vote_verification",
    f"""WITH s AS (SELECT c_custkey AS decision_id, {_SUBJECT} AS subject FROM customer),
    k AS (SELECT decision_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(subject, '')), '[^a-z0-9\\s.-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 4 AND NOT list_contains({_STOP}, w)) AS l, {_cites("subject")} AS dc FROM s),
    w AS (SELECT decision_id, dc, list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x, i: {{'k': -length(x), 'i': i, 'w': x}}) AS l FROM k),
    v AS (SELECT o_orderkey AS vote_id, o_custkey AS decision_id, {_MOTION} AS motion FROM orders),
    p AS (SELECT decision_id, vote_id, list_has_any(dc, {_cites("motion")}) AS cited, len(list_filter(list_slice(list_sort(l), 1, 6), lambda x: contains(lower(motion), x.w))) AS score FROM w JOIN v USING (decision_id)),
    n AS (SELECT *, count(*) FILTER (cited) OVER (PARTITION BY decision_id) AS named FROM p),
    f AS (SELECT *, rank() OVER (PARTITION BY decision_id ORDER BY score DESC) AS r FROM n WHERE named <> 1 AND (named = 0 OR cited) AND score > 0),
    u AS (SELECT *, count(*) OVER (PARTITION BY decision_id) AS ties FROM f WHERE r = 1)
    SELECT decision_id, vote_id, 'citation' AS matched_via FROM n WHERE named = 1 AND cited UNION ALL SELECT decision_id, vote_id, 'keyword' FROM u WHERE ties = 1""",
)
def vote_verification(spark, d):
    decisions = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("document_id"), F.expr(_SUBJECT).alias("subject"))
    votes = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.expr(_MOTION).alias("motion_text"))
    return engine.verify_votes(decisions, votes)


_HEADING = _case(
    "o_orderkey", "concat('Sec. 82-1-6. Adoption of state law ', o_orderstatus, '.')", "concat('Section 4.1-2-', CAST(o_custkey % 9 AS STRING), ' Taxes')", "'Chapter 41.1 Animals'", "concat('Supplement ', CAST(o_custkey AS STRING), ' of the code')", "CAST(NULL AS STRING)", "'ARTICLE 1'",
)
_HEAD_TEXT = "lower(regexp_replace(trim(coalesce(h, '') || ' ' || coalesce(c, '')), '\\s+', ' ', 'g'))"
_NUMBER = r"([0-9]+(?:\.[0-9]+)?-[0-9]+(?:[a-z]|\.[0-9]+|-?[0-9]+)*)\b"


@query(
    "citation_keys",
    f"""WITH t AS (SELECT *, {_HEAD_TEXT} AS x FROM {_from(h=_HEADING, c=_MOTION)}),
    u AS (SELECT *, nullif(regexp_extract(x, {_sql("(?:§|sec[.]?|section)" + chr(92) + "s*" + _NUMBER)}, 1), '') AS named, nullif(regexp_extract(x, {_sql(chr(92) + "b" + _NUMBER)}, 1), '') AS bare,
      nullif(regexp_extract(x, {_sql(r"\bchapter\s+([0-9]+(?:\.[0-9]+)?)\b")}, 1), '') AS chapter FROM t)
    SELECT o_orderkey, coalesce('section:' || coalesce(named, bare), 'chapter:' || chapter) AS key, array_to_string({_cites("c")}, ',') AS cites,
    try_cast(nullif(regexp_extract(coalesce(h, ''), {_sql(r"(?i)\bSupplement\s+([0-9]+)\b")}, 1), '') AS INT) AS supplement FROM u""",
)
def citation_keys(spark, d):
    rows = orders(spark, d, h=_HEADING, c=_MOTION)
    return rows.select(
        "o_orderkey", T.citation_key(F.col("h"), F.col("c")).alias("key"), F.array_join(T.citation_tokens(F.col("c")), ",").alias("cites"), T.supplement_number(F.col("h")).alias("supplement")
    )


# ---------------------------------------------------------------- values in text

_SOURCE = "concat_ws(' ', " + ", ".join(_plain(c) for c in ("doc_title", "doc_filename", "doc_url")) + ")"
_CANDIDATE = {
    "content": PASSAGE, "doc_url": URL, "doc_title": _case("o_orderkey", "'Adopted Budget Summary'", "'General Fund'", "'Trends and Demographics'", "CAST(NULL AS STRING)"), "doc_filename": "CAST(NULL AS STRING)",
    "doc_stage": _case("o_custkey", "CAST(NULL AS STRING)", "'adopted'", "CAST(NULL AS STRING)", "'advertised'"), "program": _case("o_orderkey", "'Real Estate Tax'", "'Transient Occupancy (TOT)'", "'Parks'"),
    "indicator_name": _case("o_custkey", "'Tax rate'", "'Percent of rate increase'", "'Visits'", "'Share of the tax rate'", "'Occupancy tax rate'"), "department": "o_orderpriority",
    "unit": _case("o_orderkey", "'per $100'", "'percent'", "'dollars'", "CAST(NULL AS STRING)"), "table": _case("o_orderkey", "'indicators'", "'narratives'", "'indicators'", "'provisions'", "'other'"),
    "value_actual": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 130 AS DOUBLE) END", "is_current": "o_custkey % 3 <> 0", "q": QUESTION,
}


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return V.with_columns(orders(spark, d, **_CANDIDATE))


def _points(column: str, rules, several: bool) -> str:
    """SQL of a sum of points. rules: (points, pattern or patterns)."""
    return " + ".join(f"CASE WHEN {' OR '.join(_like(column, p) for p in (patterns if several else (patterns,)))} THEN {points} ELSE 0 END" for points, patterns in rules)


_AMOUNT = rf"(?:{V.NUMBER}\s*(?:%|percent)|\$\s*{V.NUMBER})"
_NEAR = " OR ".join(
    f"len(list_filter(regexp_extract_all(coalesce(content, ''), {_sql(p)}, 0), lambda w: regexp_matches(w, {_sql(V.DRAFT)}))) > 0"
    for p in (rf"(?i)\btax\s+rate\b[\s\S]{{0,100}}{_AMOUNT}", rf"(?i){_AMOUNT}[\s\S]{{0,100}}\btax\s+rate\b")
)
_SIGNALS = f"""SELECT *, ({_NEAR}) AS near_rate, {_like("source", V.DRAFT)} AS draft_source, {_points("text", V.FINAL_TEXT, True)} AS final_score, {_points("source", V.SOURCE_NAMES, False)} AS source_score
    FROM (SELECT *, {_plain("content")} AS text, {_SOURCE} AS source, concat_ws(' ', {_plain("content")}, {_plain("program")}, {_plain("indicator_name")}, {_plain("department")}, {_plain("doc_title")}, {_plain("doc_filename")}, {_plain("doc_url")}) AS corpus
    FROM {_from(**{f'"{k}"': v for k, v in _CANDIDATE.items()})})"""
_FINAL = f"final_score >= {V.FINAL_SIGNAL}"
_QUALIFIED = f"CASE WHEN NOT draft_source AND {_FINAL} THEN false ELSE near_rate OR draft_source END"


@query(
    "draft_and_adoption",
    f"""SELECT o_orderkey, near_rate, draft_source, final_score, source_score, {_QUALIFIED} AS draft_qualified, {_like("text", V.APPROVED)} OR {_FINAL} AS approved,
    CASE WHEN doc_stage = 'adopted' THEN true WHEN doc_stage = 'advertised' THEN false ELSE (NOT draft_source AND {_FINAL}) OR ({_like("corpus", r"\badopt(ed|ion)?\b")} AND NOT near_rate AND NOT draft_source) END AS adopted
    FROM ({_SIGNALS})""",
)
def draft_and_adoption(spark, d):
    return candidates(spark, d).select(
        "o_orderkey", V.draft_near_rate().alias("near_rate"), V.draft_source().alias("draft_source"), V.final_text_score().alias("final_score"), V.source_score().alias("source_score"),
        V.draft_qualified().alias("draft_qualified"), V.asserts_approval().alias("approved"), V.adopted_source().alias("adopted"),
    )


_TERMS = f"list_filter(string_split(regexp_replace(lower(coalesce(q, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) > 2 AND NOT list_contains([{', '.join(map(_sql, T.VALUE_STOPWORDS))}], t) AND NOT regexp_full_match(t, '(19|20)[0-9]{{2}}'))"
_HAS = "len(list_filter({terms}, lambda t: NOT contains({text}, t) AND NOT ({more}))) = 0"
_SHORT = f"regexp_matches({{text}}, '\\b{V.ABBREVIATION[0]}\\b') AND len(list_intersect(terms, ['{V.ABBREVIATION[1][0]}', '{V.ABBREVIATION[1][1]}'])) = 2 AND t IN {V.ABBREVIATION[1]}"
_SUBJECT_FITS = _HAS.format(terms="terms", text="corpus", more=_SHORT.format(text="corpus"))
_STRUCTURED_FITS = _HAS.format(terms="terms", text="own_text", more=_SHORT.format(text="own_text") + " OR (regexp_matches(own_text, '\\b(rate|fee|charge)\\b') AND t IN ('rate', 'fee', 'charge'))")


@query(
    "subject_matches",
    f"""SELECT o_orderkey, {_SUBJECT_FITS} AS subject, {_STRUCTURED_FITS} AS structured
    FROM (SELECT *, {_TERMS} AS terms, concat_ws(' ', {_plain("program")}, {_plain("indicator_name")}, {_plain("department")}) AS own_text FROM ({_SIGNALS}))""",
)
def subject_matches(spark, d):
    rows = candidates(spark, d).withColumn("terms", T.query_terms(F.col("q")))
    return rows.select("o_orderkey", V.matches_subject(F.col("terms")).alias("subject"), V.matches_structured_subject(F.col("terms")).alias("structured"))


_GROWTH = (
    f"""("table" = 'indicators' AND ({_like("named", r"\b(increase|decrease|change|growth|projected|equalization)\b")} OR {_like("named", r"\bpercent(age)?\s+of\b|\bshare\b")}"""
    f""" OR ({_like("unit_text", r"\bpercent(age)?\b")} AND NOT {_like("own", r"\b(rate|levy)\b")})))"""
)
_PER = r"\bper\s+\$?100\b"
_OWN = f"""({_like("fields", r"\brate\b")} OR {_like("fields", _PER)}) AND coalesce(value_actual <= 100, true) AND NOT ({_like("unit_text", r"\bdollars?\b")} AND NOT {_like("unit_text", _PER)})"""
_TAXED, _RATED = _like("corpus", r"\btax\b"), _like("corpus", r"\brate\b")


@query(
    "tax_rate_candidates",
    f"""SELECT o_orderkey, {_GROWTH} AS growth_or_share, {_TAX} AND {_RATE} AND CASE "table" WHEN 'indicators' THEN NOT {_GROWTH} AND {_OWN} AND {_TAXED} AND {_RATED} AND {_SUBJECT_FITS}
      WHEN 'narratives' THEN {_TAXED} AND {_RATED} AND {_SUBJECT_FITS} WHEN 'provisions' THEN {_TAXED} AND ({_RATED} OR {_like("corpus", "percent|%")}) AND {_SUBJECT_FITS} ELSE {_TAXED} AND {_RATED} END AS fits
    FROM (SELECT *, {_TERMS} AS terms, concat_ws(' ', {_plain("indicator_name")}, {_plain("program")}) AS named, {_plain("indicator_name")} AS own, {_plain("unit")} AS unit_text, concat_ws(' ', {_plain("indicator_name")}, {_plain("unit")}) AS fields FROM ({_SIGNALS}))""",
)
def tax_rate_candidates(spark, d):
    rows = candidates(spark, d).withColumn("terms", T.query_terms(F.col("q")))
    return rows.select("o_orderkey", V.is_growth_or_share().alias("growth_or_share"), V.is_tax_rate_candidate(F.col("q"), F.col("terms")).alias("fits"))


_WORD_VALUE = "coalesce(try_cast(x AS DOUBLE), nullif(list_position([" + ", ".join(map(_sql, V.PERCENT_WORDS)) + "], lower(x)), 0)::DOUBLE)"
_PERCENTS = rf"(?i)\b({V.NUMBER}|{'|'.join(V.PERCENT_WORDS)})\s*(?:%|percent\b)"


@query(
    "provision_values",
    f"""WITH t AS (SELECT *, {_TERMS} AS terms FROM ({_SIGNALS})),
    u AS (SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(content, ''), {_sql(_PERCENTS)}, 1), lambda x: {_WORD_VALUE}), lambda v: v > 0 AND v <= 100)) AS found FROM t),
    w AS (SELECT *, CASE WHEN len(found) = 1 THEN found[1] WHEN len(found) > 1 AND list_sum(found) <= 20 AND {_like("content", V.ADDITIVE)} THEN list_sum(found) END AS value,
      "table" = 'provisions' AND is_current AND {_TAX} AND {_LEVY} AND {_like("text", r"\btax\b")} AND {_SUBJECT_FITS} AND {_like("content", V.LEVY)} AS fits FROM u)
    SELECT o_orderkey, CASE WHEN fits THEN regexp_replace(printf('%.4f', value), '\\.?0+$', '') || '%' END AS value FROM w""",
)
def provision_values(spark, d):
    rows = candidates(spark, d).withColumn("terms", T.query_terms(F.col("q")))
    return rows.select("o_orderkey", V.provision_value(F.col("q"), F.col("terms")).alias("value"))


@query(
    "future_passages",
    f"""SELECT o_orderkey, {_like("content", V.FUTURE)} OR len(list_filter(regexp_extract_all(coalesce(content, ''), {_sql(r"(?i)\bfy\s*(20[0-9]{2})\b")}, 1), lambda y: y::INT >= 2024)) > 0 AS future FROM {_from(content=PASSAGE)}""",
)
def future_passages(spark, d):
    return orders(spark, d, content=PASSAGE).select("o_orderkey", F.coalesce(V.is_future(F.col("content"), 2024), F.lit(False)).alias("future"))


_UNIT = _case("o_orderkey", "'dollars'", "'percent'", "'%'", "'Dollars per $100'", "' visits '", "CAST(NULL AS STRING)")
_AMOUNT_TEXT = "regexp_replace(printf('%.4f', v), '\\.?0+$', '')"


@query(
    "formatted_values",
    f"""WITH t AS (SELECT *, trim(coalesce(unit, '')) AS u, {_AMOUNT_TEXT} AS n FROM {_from(v="CAST(o_custkey % 1000 AS DOUBLE) / 8", unit=_UNIT)})
    SELECT o_orderkey, CASE WHEN {_like("u", r"(?i)\bdollars?\b")} THEN trim('$' || n || ' ' || trim(regexp_replace(u, '(?i)\\bdollars?\\b', '', 'g'))) WHEN {_like("u", "(?i)^percent(age)?$|^%$")} THEN n || '%' ELSE trim(n || ' ' || u) END AS shown FROM t""",
)
def formatted_values(spark, d):
    rows = orders(spark, d, v="CAST(o_custkey % 1000 AS DOUBLE) / 8", unit=_UNIT)
    return rows.select("o_orderkey", V.format_value(F.col("v"), F.col("unit")).alias("shown"))


# ---------------------------------------------------------------- small text and date functions

_UUIDS = _case("o_orderkey", "'123e4567-e89b-12d3-a456-426614174000'", "concat('item 123e4567-e89b-12d3-a456-426614174000 of ', o_orderstatus)", f"concat('$', {_SMALL}, ',000.5 for A+B (2)')", "'none  here\t at all '", "CAST(NULL AS STRING)")
_UUID_RE = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


@query(
    "text_checks",
    f"""SELECT o_orderkey, {_like("x", f"^{_UUID_RE}$")} AS uuid, regexp_matches(regexp_replace(coalesce(x, ''), '{_UUID_RE}', '', 'g'), '[$]?[0-9][0-9,]*(?:\\.[0-9]+)?%?') AS number,
    lower(regexp_replace(trim(x), '\\s+', ' ', 'g')) AS claim, nullif(trim(x), '') AS kept, regexp_replace(x, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g') AS escaped FROM {_from(x=_UUIDS)}""",
)
def text_checks(spark, d):
    x = F.col("x")
    return orders(spark, d, x=_UUIDS).select(
        "o_orderkey", T.is_uuid(x).alias("uuid"), T.has_number(x).alias("number"), T.normalize_claim(x).alias("claim"), T.non_blank(x).alias("kept"), T.escape_regex(x).alias("escaped")
    )


_FISCAL = f"CASE WHEN o_custkey % 4 = 0 THEN CAST({_YEAR} AS INT) END"


@query(
    "fiscal_years",
    f"""WITH t AS (SELECT *, concat_ws(' ', q, url) AS x FROM {_from(explicit=_FISCAL, q=QUESTION, url=URL)}),
    y AS (SELECT *, list_filter(list_transform(regexp_extract_all(coalesce(q, ''), '\\b((?:19|20)[0-9]{{2}})\\b', 1), lambda z: z::INT), lambda z: z >= 1941 AND z < 2023) AS named FROM t)
    SELECT o_orderkey, coalesce(explicit, try_cast(nullif(regexp_extract(x, '(?i)\\b(?:fy|fiscal[-_\\s]*year[-_\\s]*)(20[0-9]{{2}})\\b', 1), '') AS INT)) AS fiscal_year, named[1] AS named_year FROM y""",
)
def fiscal_years(spark, d):
    rows = orders(spark, d, explicit=_FISCAL, q=QUESTION, url=URL)
    return rows.select("o_orderkey", D.document_fiscal_year(F.col("explicit"), F.col("q"), F.col("url")).alias("fiscal_year"), D.historical_year(F.col("q")).alias("named_year"))
