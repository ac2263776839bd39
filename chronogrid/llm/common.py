"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SPACES = " \\t-\\r"  # the six white-space characters words are cut at, for a regex class
BROADCAST_BYTES = 64 << 20  # nothing above this size is broadcast
RANGE_ROWS = 100_000  # rows wanted in one range of a global order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: Sequence[str], name: str) -> str:
    """``name``, with as many underscores after it as none of ``columns`` has (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs of anything but the six white-space characters."""
    parts = F.split(text, f"[{SPACES}]+")
    ends = (F.element_at(parts, 1) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    return F.greatest(F.lit(0), F.size(parts) - ends).cast("long")


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Marks ``df`` for broadcast if ``rows`` of ``row_bytes`` stay within the bound.

    Above it the join is left to Spark, which shuffles and splits skewed partitions.
    """
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def ordered(df: DataFrame, order: Sequence[Column], rows: int, name: str = "_position") -> DataFrame:
    """Adds the 0-based position of each row in one global order.

    Rows are cut into ranges of about ``RANGE_ROWS``; each range is numbered on its own and
    shifted by the rows before it, so no task sees more than a range. ``order`` should be
    unique for reruns to agree.
    """
    parts = max(1, math.ceil(rows / RANGE_ROWS))
    ranged = cut_lineage(
        df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.join(F.broadcast(shift), "_range")  # one row per range
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("_before"))
        .drop("_range", "_before")
    )


def mark_first(rows: DataFrame, within: Sequence[str], content: str, name: str, row: str = "_row") -> DataFrame:
    """Adds ``name``: whether a row stands for all rows of equal ``content`` that share ``within``.

    Only digests that occur more than once are met again; no content is shuffled while they are few.
    """
    keys = [*within, "_digest"]
    coded = rows.withColumn("_digest", F.sha2(content, 256))
    found = coded.groupBy(*keys).agg(F.min(row).alias("_one"), F.count(F.lit(1)).alias("_n"))
    copied = cut_lineage(found.filter("_n > 1").drop("_n"))
    return (
        coded.join(maybe_broadcast(copied, copied.count(), 160), keys, "left")
        .withColumn(name, F.coalesce(F.col(row) == F.col("_one"), F.lit(True)))
        .drop("_digest", "_one")
    )


def _place() -> Column:
    return F.struct(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("at"),
    )


def placed(df: DataFrame) -> DataFrame:
    """``df`` if it is a plain read of Parquet files, else what was written of it to the shared folder.

    An operator that names rows in more than one place calls this once and passes the frame on,
    since each written copy has places of its own. Joins and the like are written too: they keep
    the places of one side, which may repeat.
    """
    plan = df._jdf.queryExecution().analyzed()
    plain = plan.deterministic()
    while plain and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plain and plan.nodeName() == "LogicalRelation":
        try:
            df.select(_place())
        except AnalysisException:
            return cut_lineage(df)
        return df
    return cut_lineage(df)


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """Adds an id of each row that stays the same between two reads of a ``placed`` frame.

    It is the file and the place in it, so repeated rows differ and nothing is shuffled. A
    frame that is no plain read of Parquet files is written to the shared folder first.
    """
    return placed(df).select("*", _place().alias(name))
