"""Date and number functions over columns. "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, and the span of years that a folder may name.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
FOLDER_YEARS = (1985, 2035)
FISCAL_YEARS = (2000, 2050)


def _extract(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _int(text: Column) -> Column:
    return text.try_cast("int")


def checked_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where the calendar has none (30 February) or a part is null."""
    return F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")))


def month_number(name: Column) -> Column:
    """1 to 12 from a month's name or its first three letters (or `sept`), else null."""
    short = F.substring(F.lower(name), 1, 3)
    return F.when(short.isin(*[m[:3] for m in MONTHS]), F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), short).cast("int"))


_MONTH = "(" + "|".join([*MONTHS, "sept", *(m[:3] for m in MONTHS)]) + ")"


def path_segments(url: Column) -> Column:
    """Lower-case, decoded, non-empty segments of a URL's path (or of a plain path)."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), url)
    return F.filter(F.split(F.lower(F.coalesce(F.try_url_decode(path), path)), "/"), lambda s: F.length(s) > 0)


def folder_year(segments: Column, before: Column) -> Column:
    """The year segment nearest before a (0-based) place."""
    lead = F.slice(segments, 1, F.greatest(before, F.lit(0)))
    years = F.filter(lead, lambda s: s.rlike(r"^[0-9]{4}$") & s.try_cast("int").between(*FOLDER_YEARS))
    return F.try_element_at(years, F.lit(-1)).try_cast("int")


def date_from_url(url: Column) -> Column:
    """The date that a document's URL names, by the first rule that gives a real date, else null.

    In the file name: ISO; month name, day, year; M-D-YYYY; M-D-YY; six digits MMDDYY (names with `final` or `summary`).
    Else month and day at the file name's start, or as a whole folder, with the year of the nearest folder before.
    """
    seg = path_segments(url)
    name = F.coalesce(F.try_element_at(seg, F.lit(-1)), F.lit(""))
    part = lambda p, k: _extract(name, p, k)
    num = lambda p, k: _int(part(p, k))
    iso, long_, mdy4, mdy2 = r"([0-9]{4})-([0-9]{2})-([0-9]{2})", _MONTH + r"[\s-]+([0-9]{1,2})(?:st|nd|rd|th)?[\s,-]+([0-9]{4})", r"\b([0-9]{1,2})-([0-9]{1,2})[\s-]([0-9]{4})", r"\b([0-9]{1,2})-([0-9]{1,2})-([0-9]{2})(?![0-9])"
    glued, start, folder = r"(?:^|[-_\s])([0-9]{2})([0-9]{2})([0-9]{2})(?:[-_\s.]|$)", "^" + _MONTH + r"[\s-]?([0-9]{1,2})(?:[\s_-]|$)", "^" + _MONTH + r"[\s-]?([0-9]{1,2})$"
    last = F.size(seg) - 1
    spot = F.array_position(F.transform(seg, lambda s: s.rlike(folder)), F.lit(True)).cast("int") - 1
    dir_ = F.coalesce(F.when(spot >= 0, F.try_element_at(seg, spot + 1)), F.lit(""))
    return F.coalesce(
        checked_date(num(iso, 1), num(iso, 2), num(iso, 3)),
        checked_date(num(long_, 3), month_number(part(long_, 1)), num(long_, 2)),
        checked_date(num(mdy4, 3), num(mdy4, 1), num(mdy4, 2)),
        checked_date(F.lit(2000) + num(mdy2, 3), num(mdy2, 1), num(mdy2, 2)),
        F.when(name.rlike("final|summary"), checked_date(F.lit(2000) + num(glued, 3), num(glued, 1), num(glued, 2))),
        checked_date(folder_year(seg, last), month_number(part(start, 1)), num(start, 2)),
        checked_date(folder_year(seg, spot), month_number(_extract(dir_, folder, 1)), _int(_extract(dir_, folder, 2))),
    )


def year_from_path(url: Column) -> Column:
    """A trailing `-YYYY` of the last segment, else a folder that is a year, else a year token anywhere."""
    seg = path_segments(url)
    last = F.regexp_replace(F.coalesce(F.try_element_at(seg, F.lit(-1)), F.lit("")), r"\.[a-z]+$", "")
    token = F.try_element_at(F.regexp_extract_all(F.lower(url), F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1)), F.lit(1))
    return _int(F.coalesce(_extract(last, r"-((?:19|20)[0-9]{2})$", 1), F.try_element_at(F.filter(seg, lambda s: s.rlike(r"^(19|20)[0-9]{2}$")), F.lit(-1)), token))


def historical_year(query: Column, first: int = 1941, end: int = 2023) -> Column:
    """The first year that a query names in [first, end)."""
    years = F.transform(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.try_element_at(F.filter(years, lambda y: (y >= first) & (y < end)), F.lit(1))


def fiscal_year(day: Column) -> Column:
    """July begins the next fiscal year."""
    return F.year(day) + F.when(F.month(day) >= 7, 1).otherwise(0)


def document_fiscal_year(explicit: Column, *texts: Column) -> Column:
    """The column, else the first `FY20nn` or `fiscal year 20nn` in the texts."""
    return F.coalesce(explicit, _int(_extract(F.concat_ws(" ", *texts), r"(?i)\b(?:fy|fiscal[-_\s]*year[-_\s]*)(20[0-9]{2})\b", 1)))


def document_date_score(explicit_year: Column, published: Column, *texts: Column) -> Column:
    """How current a document is, from real signals only: 1,000,000 + fiscal year, else its day number; null if undatable."""
    text = F.concat_ws(" ", *texts)
    iso = r"\b(20[0-9]{2})[-_/](0?[1-9]|1[0-2])[-_/](0?[1-9]|[12][0-9]|3[01])\b"
    named = r"(?i)\b(" + "|".join(MONTHS) + r")\s+([0-3]?[0-9]),?\s+(20[0-9]{2})\b"
    num = lambda p, k: _int(_extract(text, p, k))
    written = F.coalesce(checked_date(num(iso, 1), num(iso, 2), num(iso, 3)), checked_date(num(named, 3), month_number(_extract(text, named, 1)), num(named, 2)))
    return F.coalesce(F.lit(1_000_000) + document_fiscal_year(explicit_year, *texts), day_number(F.to_date(published)), day_number(written)).cast("double")


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def minute_floor(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def effective_date_from_stage(stage: Column, fiscal: Column) -> Column:
    """Adopted budgets take effect on 1 July of the year before; other stages have no date."""
    return F.when(stage == "adopted", F.make_date(fiscal - 1, F.lit(7), F.lit(1)))


def resolved_effective_date(decision: Column, meeting: Column) -> Column:
    """struct(effective_date, source): the decision's own date, else the meeting's."""
    source = F.when(decision.isNotNull(), "decision").when(meeting.isNotNull(), "meeting")
    return F.struct(F.coalesce(decision, meeting).alias("effective_date"), source.alias("source"))


def default_effective_date(today: Column) -> Column:
    return F.date_add(today, 1)


def normalized_date(text: Column) -> Column:
    """A leading ISO date, else any timestamp Spark can read, as a date."""
    return F.coalesce(F.to_date(F.try_to_timestamp(_extract(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(text)))


# Minutes to wait after each failure.
INGEST_BACKOFF = (1, 5, 30)
EMBEDDING_BACKOFF = (5, 15, 60, 360)


def backoff_minutes(attempt: Column, schedule=INGEST_BACKOFF) -> Column:
    """Minutes after the attempt-th failure (from 1); the last one from then on."""
    return F.element_at(F.array(*[F.lit(m) for m in schedule]), F.least(F.greatest(attempt, F.lit(1)), F.lit(len(schedule))).cast("int"))


def next_attempt_at(now: Column, attempt: Column, schedule=INGEST_BACKOFF) -> Column:
    return now + F.make_dt_interval(F.lit(0), F.lit(0), backoff_minutes(attempt, schedule))


def exponential_backoff_ms(attempt: Column, first: int = 500) -> Column:
    return (F.lit(first) * F.pow(F.lit(2), attempt)).cast("long")


def rounded_percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, rounded half up; null where whole is 0."""
    return F.floor(F.lit(100.0) * part / F.nullif(whole.cast("double"), F.lit(0.0)) + F.lit(0.5)).cast("long")
