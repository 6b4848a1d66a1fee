"""Arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output shapes of extractors, as from_json schemas.
VOTES = "array<struct<motion_text:string,motion_type:string,outcome:string,vote_yes:int,vote_no:int,vote_abstain:int,vote_absent:int,individual_votes:array<struct<supervisor_name:string,district:string,vote:string>>>>"
DECISIONS = "array<struct<decision_type:string,subject:string,fiscal_year:int,amount_dollars:decimal(15,2),rate_value:decimal(10,4),rate_unit:string,effective_date:string,is_amendment:boolean>>"
INDICATORS = "array<struct<fiscal_year:int,department:string,program:string,indicator_name:string,value_actual:decimal(15,4),value_target:decimal(15,4),value_prior_year:decimal(15,4),unit:string>>"
BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def json_object(text: Column) -> Column:
    """The text from the first `{` to the last `}`, without code fences; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1), F.lit(""))


def first_json_object(text: Column) -> Column:
    """The text from the first `{` to the next `}`. Nested objects are cut short, as this form is known to do."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*?\})", 1), F.lit(""))


def parsed(text: Column, schema: str) -> Column:
    return F.from_json(json_object(text), schema, {"mode": "PERMISSIVE"})


def selected_ids(ids: Column, allowed: Column, most: int = 8) -> Column:
    """Distinct ids that are allowed, in their order, at most `most`."""
    return F.slice(F.array_distinct(F.filter(ids, lambda i: F.array_contains(allowed, i))), 1, most)


def within(cited: Column, provided: Column) -> Column:
    """All cited ones were provided."""
    return F.size(F.array_except(cited, provided)) == 0


def json_with(json: Column, key: str, value: Column) -> Column:
    """A flat JSON object of strings with one key set."""
    return F.to_json(F.map_concat(F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string"))))


def grouped(key: str, value: Column) -> tuple:
    """Aggregates for a map from key to all its values (sorted): use in groupBy().agg()."""
    return (F.sort_array(F.collect_set(value)).alias(key),)


def merged_intervals(spans: Column) -> Column:
    """An array of struct(start, end), sorted, with overlapping and touching ones joined."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce(s["start"] <= last["end"], F.lit(False))
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(joins, longer).otherwise(F.concat(acc, F.array(F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end")))))

    return F.aggregate(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end")))), empty, step)


def ordered_collect(order: Column, value: Column) -> Column:
    """Values of a group in the order of another column."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])


def box_end(start: Column, end: Column) -> Column:
    """The end box, or null where it equals the start box."""
    return F.when(~start.eqNullSafe(end), end)


def json_array_size(json: Column) -> Column:
    return F.coalesce(F.json_array_length(json), F.lit(0))
