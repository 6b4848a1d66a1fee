"""Sources: tables, JSON configuration and cases, and bodies that an injected function fetches or parses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import structured as S
from quillstone.operators import evaluation as E
from quillstone.operators import graph as G

SEED = "source_id string, doc_type string, label string, api_base string, discovery_urls array<string>, depth int, allow_patterns array<string>, prefix string, min_year int, priority int"
BLOCK = f"text string, page_no int, bbox {S.BBOX}, reading_order_index int"


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A table's columns and rows. Both reach the scan: Spark prunes columns and pushes the filter down."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def one_row(df: DataFrame, where: Column) -> dict | None:
    """The only row that fits, or None; more than one is an error."""
    rows = df.where(where).limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row fits")
    return rows[0].asDict(recursive=True) if rows else None


def exact_count(df: DataFrame, where: Column | None = None) -> int:
    return (df if where is None else df.where(where)).count()


def after(df: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """The next rows after a cursor in key order: a batch of an incremental job, stable under inserts behind the cursor."""
    return (df if cursor is None else df.where(F.col(key) > F.lit(cursor))).orderBy(key).limit(limit)


def seeds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid seed sources, problems). A source is either crawled (discovery_urls and depth) or an API (api_base), and ids are unique."""
    raw = spark.read.schema(SEED).json(path, multiLine=True)
    crawled, api = F.size(F.coalesce("discovery_urls", F.array())) > 0, F.col("api_base").isNotNull()
    issue = (
        F.when(F.col("source_id").isNull() | (F.trim("source_id") == ""), "no id")
        .when(F.col("doc_type").isNull(), "no type")
        .when(crawled & api, "both crawled and API")
        .when(~crawled & ~api, "neither crawled nor API")
        .when(crawled & ~F.coalesce(F.col("depth") >= 0, F.lit(False)), "no depth")
        .when(crawled & F.exists("discovery_urls", lambda u: ~G.safe_to_fetch(u)), "unsafe URL")
    )
    marked = raw.withColumn("issue", issue)
    doubled = marked.groupBy("source_id").count().where("count > 1").select("source_id", F.lit("repeated id").alias("issue"))
    return marked.where("issue IS NULL").drop("issue").join(doubled.select("source_id"), "source_id", "left_anti"), marked.where("issue IS NOT NULL").select("source_id", "issue").unionByName(doubled)


def crawled_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.size(F.coalesce("discovery_urls", F.array())) > 0)


def api_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("api_base").isNotNull())


def eval_cases(spark: SparkSession, folder: str) -> DataFrame:
    """All cases of a folder's JSON files, each one an object or an array of them; ids must be unique."""
    cases = spark.read.schema(E.CASE).json(folder, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    twice = [r.id for r in cases.groupBy("id").count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"cases with the same id: {', '.join(map(str, twice))}")
    return cases


def per_row(df: DataFrame, column: str, function: Callable[[object], list[dict]], schema: str, keep: list[str], workers: int | None = None) -> DataFrame:
    """Rows that an injected function makes of one column, beside the kept columns. An error gives no rows but `error`.

    For network or model calls: bounded concurrency is the number of partitions (`workers`). The function travels to the
    executors, so it must not hold a connection.
    """
    names = [f.split()[0] for f in _fields(schema)]
    kinds = dict(df.dtypes)
    out = ", ".join([*(f"{c} {kinds[c]}" for c in keep), schema, "error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for values in pdf[[*keep, column]].itertuples(index=False):
                try:
                    rows += [(*values[:-1], *(r.get(n) for n in names), None) for r in function(values[-1])]
                except Exception as e:  # the row's own failure is data, not the job's
                    rows.append((*values[:-1], *(None for _ in names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[*keep, *names, "error"])

    wanted = df.select(*dict.fromkeys([*keep, column]))
    return (wanted.repartition(workers) if workers else wanted).mapInPandas(run, out)


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, c in enumerate(schema):
        depth += {"<": 1, "(": 1, ">": -1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(schema[start:k].strip())
            start = k + 1
    return [*out, schema[start:].strip()]


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, sha256, content) of whole files, for parsers in per_row()."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def text_blocks(df: DataFrame, content: str, parse: Callable[[bytes], list[dict]], keep: list[str]) -> DataFrame:
    """Blocks (text, page_no, bbox, reading_order_index) that a parser makes of each file."""
    return per_row(df, content, parse, BLOCK, keep)


def ranged_blocks(df: DataFrame, content: str, first_page: str, parse: Callable[[bytes], list[dict]], keep: list[str]) -> DataFrame:
    """As text_blocks() for slices of pages: page numbers count from the slice's first page on."""
    out = text_blocks(df, content, parse, list(dict.fromkeys([*keep, first_page])))
    return out.withColumn("page_no", F.col("page_no") + F.col(first_page) - 1)


def probe(df: DataFrame, url: str, head: Callable[[str], dict]) -> DataFrame:
    """HEAD results (ok, status, etag, last_modified) of safe URLs."""
    return per_row(df.where(G.safe_to_fetch(F.col(url))), url, lambda u: [head(u)], "ok boolean, status int, etag string, last_modified string", [url])


def fetch(df: DataFrame, url: str, get: Callable[[str], dict]) -> DataFrame:
    """Bodies of safe URLs with their status and hash; an empty body counts as an error."""
    got = per_row(df.where(G.safe_to_fetch(F.col(url))), url, lambda u: [get(u)], "status int, body string", [url])
    return got.withColumn("sha256", F.sha2("body", 256)).withColumn("error", F.when(F.col("error").isNull() & (F.coalesce(F.length("body"), F.lit(0)) == 0), "empty body").otherwise(F.col("error")))
