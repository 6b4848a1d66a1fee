"""Sentence-aware chunks with overlap and provenance. Documents are independent; within one, the next start depends on the last end."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET = 512
OVERLAP = 0.15
CHUNK = "chunk_index int, text string, token_count int, page_start int, page_end int, order_start int, order_end int, sentence_start int, sentence_end int, overlap_prev boolean, overlap_next boolean"

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n{2,}")


def estimate(text: str) -> int:
    return math.ceil(len(text.split()) * 1.3)


def split_sentences(text: str | None) -> list[str]:
    return [s for s in (p.strip() for p in _SENTENCE.split(text or "")) if s]


def chunk_ranges(tokens: list[int], target: int = TARGET, overlap: float = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of sentences in each chunk. A chunk takes sentences while they fit (one at least); the next one begins
    with as many trailing sentences as fit into overlap * target tokens, but always at a later sentence."""
    out, i, spare = [], 0, math.floor(target * overlap)
    while i < len(tokens):
        total, j = tokens[i], i + 1
        while j < len(tokens) and total + tokens[j] <= target:
            total += tokens[j]
            j += 1
        out.append((i, j))
        back, used = 0, 0
        while back < j - i and used + tokens[j - 1 - back] <= spare:
            used += tokens[j - 1 - back]
            back += 1
        i = max(i + 1, j - back)
    return out


def chunk_blocks(blocks: list[dict], target: int = TARGET, overlap: float = OVERLAP) -> list[dict]:
    """Chunks of one document's blocks (text, page_no, reading_order_index), which may come in any order."""
    flat = [(s, estimate(s), b.get("page_no"), b["reading_order_index"]) for b in sorted(blocks, key=lambda b: b["reading_order_index"]) for s in split_sentences(b["text"])]
    ranges = chunk_ranges([t for _, t, _, _ in flat], target, overlap)
    out = []
    for k, (i, j) in enumerate(ranges):
        part = flat[i:j]
        out.append(
            {
                "chunk_index": k, "text": " ".join(s for s, *_ in part), "token_count": sum(t for _, t, *_ in part),
                "page_start": part[0][2], "page_end": part[-1][2], "order_start": part[0][3], "order_end": part[-1][3],
                "sentence_start": i, "sentence_end": j, "overlap_prev": k > 0 and i < ranges[k - 1][1], "overlap_next": k + 1 < len(ranges) and ranges[k + 1][0] < j,
            }
        )
    return out


def chunk_documents(blocks: DataFrame, key: str = "document_id", target: int = TARGET, overlap: float = OVERLAP) -> DataFrame:
    """blocks (key, text, page_no, reading_order_index) -> chunks of each document. One document at a time is in a task."""
    kind = dict(blocks.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = chunk_blocks([{"text": t, "page_no": None if pd.isna(p) else int(p), "reading_order_index": int(r)} for t, p, r in zip(pdf["text"], pdf["page_no"], pdf["reading_order_index"], strict=True)], target, overlap)
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])
        out.insert(0, key, pdf[key].iloc[0])
        return out.astype({"page_start": "Int32", "page_end": "Int32"})

    return blocks.select(key, "text", "page_no", "reading_order_index").groupBy(key).applyInPandas(run, f"{key} {kind}, {CHUNK}")


def chunk_texts(df: DataFrame, key: str = "doc_id", text: str = "text", target: int = TARGET, overlap: float = OVERLAP) -> DataFrame:
    """Whole texts, each one block: chunked row by row, without a shuffle."""
    kind = dict(df.dtypes)[key]
    names = [c.split()[0] for c in CHUNK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *(c[n] for n in names)) for k, t in zip(pdf["key"], pdf["text"], strict=True) for c in chunk_blocks([{"text": t, "page_no": None, "reading_order_index": 0}], target, overlap)]
            yield pd.DataFrame(rows, columns=[key, *names]).astype({"page_start": "Int32", "page_end": "Int32"})

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, {CHUNK}")


def page_ranges(documents: DataFrame, key: str = "document_id", pages: str = "page_count", size: int = 3, done: DataFrame | None = None) -> DataFrame:
    """(key, first_page, last_page) of all ranges of `size` pages that `done` (key, first_page) lacks."""
    ranges = documents.where(F.col(pages) > 0).select(key, F.explode(F.sequence(F.lit(1), F.col(pages), F.lit(size))).alias("first_page"), F.col(pages).alias("__n")).select(key, "first_page", F.least(F.col("first_page") + size - 1, F.col("__n")).alias("last_page"))
    return ranges if done is None else ranges.join(done.select(key, "first_page"), [key, "first_page"], "left_anti")
