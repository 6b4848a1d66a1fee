"""String functions over columns. Built-in expressions throughout; Arrow UDFs only where a fold over a text is needed."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.udf import arrow_udf

# ---------------------------------------------------------------- normalising and terms


def normalized_text(text: Column) -> Column:
    """Lower case, commas between digits gone, anything but a-z and 0-9 to one space, trimmed. Null gives ''."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(lower, r"(?<=\d),(?=\d)", ""), "[^a-z0-9]+", " "))


# Words that carry no subject, one list for each use. Place names are the caller's (extra=...).
VALUE_STOPWORDS = ("a", "an", "and", "are", "at", "county", "current", "currently", "different", "for", "in", "is", "it", "latest", "now", "of", "rate", "the", "this", "today", "value", "was", "what", "whats", "year")
JUDGE_STOPWORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are", "was", "were", "what", "whats", "which", "who", "when", "where", "how", "did", "does", "do", "has", "have", "had", "that", "this", "with", "from", "by", "at", "as", "it", "its", "be", "been", "than", "then", "into", "under", "over")
LOOKUP_STOPWORDS = ("the", "a", "an", "of", "in", "on", "for", "to", "and", "or", "is", "was", "were", "are", "what", "when", "where", "how", "did", "does", "do", "which", "that", "this", "it", "as", "by", "with", "from", "at", "be", "been", "being", "county", "ordinance", "zoning")
KEYWORD_STOPWORDS = ("the", "of", "and", "to", "for", "in", "on", "a", "an", "is", "are", "be", "by", "as", "or", "that", "this", "with", "from", "at", "approval", "adoption", "amendment", "amendments", "proposed", "board", "decision", "decisions", "supervisors", "fiscal", "county", "code", "authorization", "approve", "approving", "resolution", "regarding", "review", "third", "quarter", "annual", "fy", "year")
ANSWER_STOPWORDS = ("the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "is", "are", "be", "that", "this", "it", "as", "at", "by", "with", "from")


def _words(items) -> Column:
    return F.array(*[F.lit(w) for w in items]) if items else F.array().cast("array<string>")


def query_terms(text: Column, stopwords=VALUE_STOPWORDS, extra=(), years: bool = False) -> Column:
    """Distinct ASCII terms of three letters or more, in order, without stop words and (unless years) 19xx and 20xx."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda t: F.length(t) > 2)
    kept = F.filter(parts, lambda t: ~F.array_contains(_words([*stopwords, *extra]), t) & (F.lit(True) if years else ~t.rlike(r"^(19|20)[0-9]{2}$")))
    return F.array_distinct(kept)


def keywords(subject: Column, most: int = 6, extra=()) -> Column:
    """Distinct words of four characters or more, longest first and in order among equals, at most `most`."""
    cleaned = F.split(F.regexp_replace(F.lower(F.coalesce(subject, F.lit(""))), r"[^a-z0-9\s.-]", " "), r"\s+")
    kept = F.array_distinct(F.filter(cleaned, lambda w: (F.length(w) >= 4) & ~F.array_contains(_words([*KEYWORD_STOPWORDS, *extra]), w)))
    keyed = F.array_sort(F.transform(kept, lambda w, i: F.struct((-F.length(w)).alias("k"), i.alias("i"), w.alias("w"))))
    return F.slice(F.transform(keyed, lambda s: s["w"]), 1, most)


def has_all_terms(corpus: Column, terms: Column, accept=None) -> Column:
    """Every term is a substring of the corpus, or accepted by accept(term). No terms: true."""
    return F.forall(terms, lambda t: F.contains(corpus, t) | (accept(t) if accept else F.lit(False)))


# Fixed values of the Snowball English stop list are left to the caller; this is the short list that carries no meaning in search.
_STOP = frozenset("a about above after again all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours out over own s same she should so some such t than that the their theirs them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours".split())

_VOWEL = re.compile(r"[aeiouy]")
_SUFFIXES = [("ational", "ate"), ("tional", "tion"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("aliti", "al"), ("iviti", "ive"), ("alism", "al"), ("ation", "ate"), ("ement", ""), ("ment", ""), ("ness", ""), ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ance", ""), ("ence", ""), ("able", ""), ("ible", ""), ("ism", ""), ("ate", ""), ("iti", ""), ("ous", ""), ("ive", ""), ("ize", ""), ("ion", ""), ("ful", ""), ("al", ""), ("er", ""), ("ic", "")]


def _measure(stem: str) -> int:
    return len(re.findall(r"[aeiouy]+[^aeiouy]+", stem))


def english_stem(word: str) -> str:
    """A suffix stripper in the manner of Porter: plurals, -ed and -ing, -y, then one derivational suffix."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    for end in ("eed", "ed", "ing"):
        if word.endswith(end):
            stem = word[: -len(end)]
            if end == "eed":
                word = word[:-1] if _measure(stem) > 0 else word
            elif _VOWEL.search(stem):
                word = stem + "e" if stem.endswith(("at", "bl", "iz")) else stem[:-1] if len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "lsz" else stem
            break
    if word.endswith("y") and _VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    for end, into in _SUFFIXES:
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > (0 if into else 1) and not (end == "ion" and not stem.endswith(("s", "t"))):
                word = stem + into
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not re.search("[^aeiouy][aeiouy][^aeiouwxy]$", stem)):
            word = stem
    return word


@arrow_udf("array<string>")
def english_lexemes(text: pd.Series) -> pd.Series:
    """Stemmed ASCII words without stop words, in order and with repeats."""
    seen: dict[str, str] = {}

    def one(value):
        out = []
        for w in re.findall(r"[a-z0-9]+", (value or "").lower()):
            if w not in _STOP:
                if w not in seen:
                    seen[w] = english_stem(w)
                out.append(seen[w])
        return out

    return text.map(one)


def matches_any(lexemes: Column, query: Column) -> Column:
    """OR semantics: at least one query lexeme occurs; an empty query matches nothing."""
    return F.coalesce(F.arrays_overlap(lexemes, query), F.lit(False))


def matches_all(lexemes: Column, query: Column) -> Column:
    """AND semantics; an empty query matches nothing."""
    return (F.size(query) > 0) & (F.size(F.array_except(query, lexemes)) == 0)


# ---------------------------------------------------------------- sentences, tokens, windows


def sentences(text: Column) -> Column:
    """Split after . ! ? with white space and at blank lines; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n{2,}"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 0)


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: F.length(w) > 0))


def token_estimate(text: Column) -> Column:
    """Words times 1.3, rounded up."""
    return F.ceil(word_count(text) * F.lit(1.3)).cast("int")


def truncate_for_embedding(text: Column, tokens: int = 512) -> Column:
    """The text itself if its estimate fits, else as many leading words as fit, joined by one space."""
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)
    return F.when(token_estimate(text) <= tokens, text).otherwise(F.array_join(F.slice(words, 1, int(tokens / 1.3)), " "))


def subject_windows(text: Column, terms: Column, radius: int = 260) -> Column:
    """Slices of `radius` characters from each occurrence of each term; the first 2 * radius characters if there is none."""
    lower = F.lower(text)

    def at(term):
        pieces = F.split(lower, F.concat(F.lit(r"\Q"), term, F.lit(r"\E")))
        return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p, i: F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda n, q: n + F.length(q)) + i * F.length(term) + 1)

    found = F.flatten(F.transform(terms, at))
    return F.when(F.size(found) > 0, F.transform(found, lambda p: F.substring(text, p, F.lit(radius)))).otherwise(F.array(F.substring(text, 1, 2 * radius)))


def merge_intervals(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def excerpt(text: str, terms: list[str], budget: int = 1500, head: int = 300, radius: int = 160, per_term: int = 6) -> str:
    """A text within a budget: its head and windows around terms, rarest term first, in order and joined by ellipses."""
    if len(text) <= budget:
        return text
    lower, windows = text.lower(), []
    for term in terms:
        places = [m.start() for m in re.finditer(re.escape(term), lower)] if term else []
        windows += [(len(places), p, max(0, p - radius), min(len(text), p + len(term) + radius)) for p in places[:per_term]]
    chosen, used = [(0, min(head, len(text)))], min(head, len(text))
    for _, _, s, e in sorted(windows):
        if used >= budget:
            break
        fresh = (e - s) - sum(max(0, min(e, b) - max(s, a)) for a, b in chosen)
        if fresh > 0:
            chosen.append((s, e))
            used += fresh
    parts, left = [], budget
    for s, e in merge_intervals(chosen):
        if left <= 0:
            break
        parts.append(text[s : min(e, s + left)])
        left -= e - s
    return " … ".join(parts)


def excerpts(budget: int = 1500, head: int = 300, radius: int = 160):
    """excerpt() as a vectorised function of (text, array of terms)."""

    @arrow_udf("string")
    def run(text: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else excerpt(t, list(q) if q is not None else [], budget, head, radius) for t, q in zip(text, terms, strict=True)])

    return run


def snippet(text: Column, most: int = 600) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


# ---------------------------------------------------------------- similarity


def content_tokens(text: Column) -> Column:
    """Distinct ASCII tokens of three characters or more."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def content_similarity(a: Column, b: Column) -> Column:
    return jaccard(content_tokens(a), content_tokens(b))


# ---------------------------------------------------------------- citations and headings


def supplement_number(name: Column) -> Column:
    return F.regexp_extract(F.coalesce(name, F.lit("")), r"(?i)\bSupplement\s+([0-9]+)\b", 1).try_cast("int")


def section_heading(heading: Column) -> Column:
    """struct(number, title) of `Sec. N. title`."""
    at = lambda k: F.nullif(F.regexp_extract(F.coalesce(heading, F.lit("")), r"(?i)^\s*(?:§|sec(?:tion)?\.?)\s*([0-9][0-9A-Za-z.\-]*?)\.?\s+(.*?)\.?\s*$", k), F.lit(""))
    return F.struct(at(1).alias("number"), at(2).alias("title"))


def citation_key(heading: Column, content: Column) -> Column:
    """`section:N-N` if a section is named, else `chapter:N`, else null."""
    text = F.lower(F.regexp_replace(F.trim(F.concat_ws(" ", F.coalesce(heading, F.lit("")), F.coalesce(content, F.lit("")))), r"\s+", " "))
    number = r"([0-9]+(?:\.[0-9]+)?-[0-9]+(?:[a-z]|\.[0-9]+|-?[0-9]+)*)\b"
    named = F.nullif(F.regexp_extract(text, r"(?:§|sec\.?|section)\s*" + number, 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(text, r"\b" + number, 1), F.lit(""))
    chapter = F.nullif(F.regexp_extract(text, r"\bchapter\s+([0-9]+(?:\.[0-9]+)?)\b", 1), F.lit(""))
    return F.coalesce(F.concat(F.lit("section:"), F.coalesce(named, bare)), F.concat(F.lit("chapter:"), chapter))


def citation_tokens(text: Column) -> Column:
    """Distinct CHn and APXn tokens of chapters and appendices that a text names."""
    up = F.upper(F.coalesce(text, F.lit("")))
    chapters = F.transform(F.regexp_extract_all(up, F.lit(r"\bCH(?:APTER|\.)?\s*([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda n: F.concat(F.lit("CH"), n))
    appendices = F.transform(F.regexp_extract_all(up, F.lit(r"\bAPP(?:ENDI)?X\s+([A-Z0-9]+)\b"), F.lit(1)), lambda n: F.concat(F.lit("APX"), n))
    return F.array_distinct(F.concat(chapters, appendices))


def matches_citation(node_id: Column, tokens: Column) -> Column:
    return F.exists(tokens, lambda t: F.contains(F.upper(node_id), t))


def heading_has_prefix(heading: Column, prefix: Column) -> Column:
    """A heading begins with the prefix, and a boundary (end, space, `.`, `:` or `-`) follows."""
    head, want = F.lower(F.trim(heading)), F.lower(F.trim(prefix))
    after = F.substring(head, F.length(want) + 1, F.lit(1))
    return F.startswith(head, want) & ((after == "") | after.rlike(r"^[\s.:\-]"))


def citation_label(title: Column, page: Column, retrieved: Column) -> Column:
    """`[title, page n, retrieved date]`, with words of its own for a page or a date that is missing."""
    number = F.coalesce(F.concat(F.lit("page "), page.cast("string")), F.lit("page n/a"))
    day = F.coalesce(F.date_format(retrieved, "yyyy-MM-dd"), F.lit("retrieval date unavailable"))
    return F.concat(F.lit("["), title, F.lit(", "), number, F.lit(", retrieved "), day, F.lit("]"))


def page_label(start: Column, end: Column) -> Column:
    return F.coalesce(start, end)


def rewrite_citations(answer: str, labels: dict[str, str]) -> str:
    """Inline `[chunk:<id>]` marks become labels (each once a run); unknown and malformed ones go. Brackets may nest."""
    out, at, last = [], 0, None
    while at < len(answer):
        if not answer.startswith("[chunk:", at):
            out.append(answer[at])
            last = None if not answer[at].isspace() else last
            at += 1
            continue
        depth, end = 0, at
        while end < len(answer):
            depth += {"[": 1, "]": -1}.get(answer[end], 0)
            end += 1
            if not depth:
                break
        if depth:  # it never ends: drop the opening alone
            at += len("[chunk:")
            continue
        label = labels.get(answer[at + 7 : end - 1].strip())
        if label and label != last:
            out.append(label)
            last = label
        at = end
    return re.sub(r"\s+([.,;:])", r"\1", re.sub(r"[ \t]{2,}", " ", "".join(out))).strip()


@arrow_udf("string")
def rewritten_citations(answer: pd.Series, labels: pd.Series) -> pd.Series:
    """rewrite_citations() over (answer, map of chunk id to label)."""
    return pd.Series([None if a is None else rewrite_citations(a, dict(m) if m is not None else {}) for a, m in zip(answer, labels, strict=True)])


# ---------------------------------------------------------------- answers and grading

# Words that count as the same when answers are graded; the first of a row stands for all of it.
SYNONYMS = (
    ("allow", "allows", "allowed", "allowing", "permit", "permits", "permitted", "permitting", "authorize", "authorizes", "authorized", "authorizing", "authorise", "authorises", "authorised", "authorising"),
    ("prohibit", "prohibits", "prohibited", "prohibiting", "forbid", "forbids", "forbidden", "forbidding", "ban", "bans", "banned", "banning", "disallow", "disallows", "disallowed", "disallowing"),
    ("require", "requires", "required", "requiring", "mandate", "mandates", "mandated", "mandating", "oblige", "obliges", "obliged", "obligating"),
)
_CANON = {w: row[0] for row in SYNONYMS for w in row}

# Openings and phrases of a refusal.
REFUSALS = (
    r"i (don't|do not|cannot|can't) (find|have|know|answer)",
    r"not (in|part of) (my|the) (corpus|knowledge|documents)",
    r"no information (available|found)",
    r"unable to (find|answer|provide)",
    r"outside (the scope|my knowledge)",
    r"^\s*(?:(?:based on|according to|per|within|in)\s+(?:the\s+)?(?:provided\s+|available\s+|supplied\s+|given\s+)?documents?,?\s+)?(?:the\s+)?(?:provided\s+|available\s+|supplied\s+|given\s+)?documents?\s+(?:do|does)\s+not\s+(?:state|specify|contain|mention|include|address|provide|indicate|list|define|discuss|cover|detail|reference|describe|identify|note|say)\b",
    r"^\s*(?:(?:based on|according to|per|within|in)\s+(?:the\s+)?(?:provided\s+|available\s+)?documents?,?\s+)?there\s+is\s+no\s+(?:mention|information|reference|indication|record|data)\b",
)


def is_refusal(answer: Column) -> Column:
    """Blank, or one of the refusal patterns."""
    return F.coalesce(F.trim(answer) == "", F.lit(True)) | reduce(lambda a, b: a | b, (F.coalesce(answer, F.lit("")).rlike("(?i)" + p) for p in REFUSALS))


@arrow_udf("array<string>")
def answer_tokens(text: pd.Series) -> pd.Series:
    """Lower-case NFKD tokens of a-z and 0-9, synonyms as one."""
    return text.map(lambda t: [_CANON.get(w, w) for w in re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", (t or "").lower())).split()])


def tolerant_contains(answer: Column, target: Column, coverage: float = 0.8) -> Column:
    """Arrays of answer tokens: the target stands in the answer as a run, or 0.8 of its content words (with repeats) occur."""
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    content = F.filter(target, lambda t: ~F.array_contains(_words(ANSWER_STOPWORDS), t))
    goal = F.when(F.size(content) > 0, content).otherwise(target)
    present = F.size(F.filter(goal, lambda t: F.array_contains(answer, t)))
    return (F.size(target) == 0) | F.contains(pad(answer), pad(target)) | (present / F.size(goal) >= coverage)


def normalize_claim(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^{_UUID}$"), F.lit(False))


def has_number(text: Column) -> Column:
    """A number is in the text, outside of any UUID."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _UUID, "").rlike(r"[$]?[0-9][0-9,]*(?:\.[0-9]+)?%?")


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def append_caveat(existing: Column, caveat: Column) -> Column:
    """The text of caveats with one more after a space, unless the text holds it already; blank texts give way to it."""
    return F.when(F.trim(F.coalesce(existing, F.lit(""))) == "", caveat).when(F.contains(existing, caveat), existing).otherwise(F.concat(existing, F.lit(" "), caveat))


def caveat_list(*caveats: Column) -> Column:
    """The array of those caveats that are not blank, trimmed, each once and in order."""
    return F.array_distinct(F.filter(F.transform(F.array(*caveats), lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != "")))


def with_caveats(answer: Column, caveats: Column) -> Column:
    """The answer, and in a paragraph of their own those caveats that its text doesn't hold already."""
    missing = F.filter(caveats, lambda c: ~F.contains(answer, c))
    return F.when(F.size(missing) == 0, answer).otherwise(F.concat(F.trim(answer), F.lit("\n\nCaveats: "), F.array_join(missing, " ")))


# Words that ask for a structured or a conversational answer, and the most words of a terse question.
STRUCTURED_WORDS = r"(?i)\b(list|compare|break down|table|bullets?|steps?|summarize)\b"
CONVERSATIONAL_WORDS = r"(?i)\b(can you|could you|please|explain|walk me through|what does this mean)\b"
TERSE_WORDS = 8


def question_style(query: Column) -> Column:
    """structured, terse or conversational: by words that ask for structure, by length, by words of courtesy, else structured."""
    return (
        F.when(query.rlike(STRUCTURED_WORDS), "structured")
        .when(word_count(query) <= TERSE_WORDS, "terse")
        .when(query.rlike(CONVERSATIONAL_WORDS), "conversational")
        .otherwise("structured")
    )


def non_blank(text: Column) -> Column:
    """Trimmed, or null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def finite(number: Column) -> Column:
    """The number as a double, or null for NaN and infinities."""
    d = number.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)
