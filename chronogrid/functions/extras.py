"""Open-ended information and provenance text.

Extras are kept as ``map<string, array<string>>``: one value stays a one-element list,
differing values are appended. JSON text is only read and written at the edges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import clean_ws, text

OLD_TEXT_KEY = "Ancienne valeur"
NEW_TEXT_KEY = "Nouvelle valeur"
EXTRAS_TYPE = "map<string,array<string>>"


def parse_extras(c: Column | str, fallback_key: str = OLD_TEXT_KEY) -> Column:
    """JSON object text to a map; text that is no object is kept under ``fallback_key``."""
    raw = text(c)
    lists = F.from_json(raw, "map<string,string>")
    # A value that is itself a JSON list becomes that list, anything else one element.
    as_list = lambda v: F.coalesce(
        F.when(v.startswith("["), F.from_json(v, "array<string>")), F.array(v)
    )
    parsed = F.transform_values(lists, lambda k, v: as_list(v))
    return (
        F.when(F.trim(raw).isin("", "{}"), F.from_json(F.lit("{}"), EXTRAS_TYPE))
        .when(F.trim(raw).startswith("{") & lists.isNotNull(), parsed)
        .otherwise(F.create_map(F.lit(fallback_key), F.array(clean_ws(raw))))
    )


def merge_extras(a: Column, b: Column) -> Column:
    """Blank incoming values are ignored, new keys added, differing values appended."""
    said = lambda values: F.filter(
        F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != ""
    )
    merged = F.map_zip_with(
        a,
        b,
        lambda k, old, new: F.when(F.size(said(old)) == 0, said(new)).otherwise(
            F.array_union(old, said(new))
        ),
    )
    return F.map_filter(merged, lambda k, v: F.size(v) > 0)


def extras_json(c: Column) -> Column:
    """Sorted-key JSON text with single values unwrapped."""
    # Spark sorts arrays, not maps: order the entries and build the map again.
    entries = F.array_sort(F.map_entries(c))
    quoted = lambda v: F.concat(
        F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')
    )
    value = lambda vs: F.when(F.size(vs) == 1, quoted(vs[0])).otherwise(
        F.concat(F.lit("["), F.array_join(F.transform(vs, quoted), ", "), F.lit("]"))
    )
    body = F.array_join(
        F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), value(e["value"]))), ", "
    )
    return F.concat(F.lit("{"), body, F.lit("}"))


def merge_sources(a: Column | str, b: Column | str) -> Column:
    """`` ; `` lists united in first-seen order."""
    both = F.concat(F.split(text(a), " ; "), F.split(text(b), " ; "))
    kept = F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_distinct(kept), " ; ")


def format_sources(c: Column | str) -> Column:
    raw = text(c)
    return F.when(
        F.trim(raw).startswith("["),
        F.coalesce(F.array_join(F.from_json(raw, "array<string>"), ", "), raw),
    ).otherwise(raw)
