"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), where ``docs`` is the table its predecessor wrote, and
returns what it keeps. All but the last return the columns of ``documents``. The smoothing of
the quality model and the packing rounds have no SQL form, so there is no SQL to compare with;
the tests hold every stage against plain code.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.llm.common import free_name, placed, table, with_row_id
from chronogrid.llm.line_dedup import build_state, dedup_lines
from chronogrid.llm.mixing import mix
from chronogrid.llm.near_dup import near_duplicates
from chronogrid.llm.packing import pack, token_pieces
from chronogrid.llm.perplexity import judge_quality
from chronogrid.session import shared_folder

SIMILARITY = 80  # percent, of sets of five-word shingles


def _rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``placed`` documents that ``chosen`` names by file and place."""
    row = free_name(docs.columns, "row_place")
    named = chosen.select(F.struct("file", "at").alias(row))
    return with_row_id(docs, row).join(named, row, "left_semi").drop(row)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and lie inside their language's perplexity band."""
    docs = placed(docs)
    return _rows_of(docs, judge_quality(docs).filter("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share."""
    added = tuple(free_name(docs.columns, c) for c in ("n_lines", "n_dropped", "kept_text"))
    cleaned = dedup_lines(build_state(docs, keep_postings=False), docs, added=added)
    changed = F.col(added[1]) > 0
    return cleaned.select(
        *[
            F.when(changed, F.col(added[2])).otherwise(F.col(c)).alias(c)
            if c == "text"
            else F.when(changed, F.length(added[2]).cast("long")).otherwise(F.col(c)).alias(c)
            if c == "n_chars"
            else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    docs = placed(docs)
    return _rows_of(docs, near_duplicates(docs, percent=SIMILARITY).filter("first"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them."""
    return mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents and their places in sequences."""
    return pack(token_pieces(docs)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
