"""JSON and key/value text files as long cells (B2, B3); delimited files have a module of their own.

Every reader returns cells (doc, row, col, header, value), which ``headers.map_rows``
turns into records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folding import clean_ws
from ..operators.extract import LINE_BREAKS
from ..skew import settled
from .encodings import windows_latin, windows_undefined

CONTAINERS = ["data", "users", "enseignants", "teachers", "rows", "items"]
PAIR = r"^([^:;=]{2,80})\s*[:=]\s*(.+)$"


def decoded(content: Column) -> Column:
    """UTF-8 with or without a mark, else Windows Latin, else Latin-1."""
    latin = F.decode(content, "iso-8859-1")
    body = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.when(windows_undefined(latin), latin).otherwise(windows_latin(latin))
    )
    return F.regexp_replace(body, "^\\x{feff}", "")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("doc"), decoded(F.col("content")).alias("text"))


def json_cells(docs: DataFrame) -> DataFrame:
    """Cells of a JSON list, of the first known list inside an object, or of one object."""
    body = F.trim("text")
    parsed = F.try_parse_json(body)
    listed = F.coalesce(
        *[
            F.when(
                F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant")).startswith("ARRAY"),
                F.get_json_object(body, f"$.{k}"),
            )
            for k in CONTAINERS
        ],
        F.concat(F.lit("["), body, F.lit("]")),
    )
    items = F.when(body.startswith("["), body).otherwise(listed)
    objects = F.from_json(items, "array<string>")  # an item that is no object is left out, not its list
    return (
        settled(docs, "doc", objects.alias("items"))
        .select("doc", F.posexplode("items").alias("row", "item"))
        .filter(F.col("item").startswith("{"))
        .select("doc", "row", F.from_json("item", "map<string,string>").alias("m"))
        .select("doc", "row", F.posexplode(F.map_entries("m")).alias("col", "e"))
        .select("doc", "row", "col", F.col("e.key").alias("header"), F.coalesce("e.value", F.lit("")).alias("value"))
    )


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    return json_cells(read_texts(spark, path))


def kv_cells(docs: DataFrame) -> DataFrame:
    """``key : value`` lines of each blank-line block; the last value of a key counts."""
    blocks = settled(docs, "doc", F.split("text", r"\n\s*\n+").alias("bs")).select(
        "doc", F.posexplode("bs").alias("row", "block")
    )
    lines = blocks.select("doc", "row", F.posexplode(F.split("block", LINE_BREAKS)).alias("col", "line"))
    said = settled(lines, "doc", "row", "col", clean_ws("line").alias("line")).filter(F.col("line").rlike(PAIR))
    pairs = said.select(
        "doc", "row", "col",
        F.trim(F.regexp_extract("line", PAIR, 1)).alias("header"), F.trim(F.regexp_extract("line", PAIR, 2)).alias("value"),
    )
    return pairs.groupBy("doc", "row", "header").agg(
        F.min("col").alias("col"), F.max_by("value", "col").alias("value")
    ).select("doc", "row", "col", "header", "value")
