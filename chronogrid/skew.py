"""Building blocks that keep one oversized key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.folding import SPACE_CLASS
from .session import cut_lineage

BROADCAST_ROWS = 100_000  # a side with more rows is shuffled instead


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and must never be broadcast.

    Spark guesses its size from compressed files and does not count what ``explode`` adds, so
    a side of many hundred MB may seem small enough to be gathered by the driver.
    """
    return df.hint("merge")


def keep_first(df: DataFrame, keys: Sequence[str], order: str, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in ``order``.

    An aggregate with map-side combine instead of ``row_number``, so a key that holds
    a large share of the rows never has to be sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.col(order)).alias("_r"))
        .select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def look_up(facts: DataFrame, rows: DataFrame, on: str | list[str]) -> DataFrame:
    """Facts with the row that they name ``on`` a column; facts of one row may be many.

    The rows looked up are broadcast while they are few, so the facts stay where they are. Spark's
    own guess, made from file sizes, may broadcast the facts and leave all work to one task.
    """
    rows = cut_lineage(rows)
    return facts.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else shuffled(rows), on)


def hot_groups(
    df: DataFrame, keys: Sequence[str], split_rows: int, weight: str | None = None
) -> DataFrame:
    """All groups above ``split_rows`` with the number of pieces their count asks for.

    ``df`` may already be counted, with the count in ``weight``. There are at most
    ``rows / split_rows`` of them.
    """
    size = F.sum(weight) if weight else F.count(F.lit(1))
    return (
        df.groupBy(*keys)
        .agg(size.alias("_size"))
        .filter(F.col("_size") > split_rows)
        .select(*keys, F.ceil(F.col("_size") / split_rows).cast("int").alias("_parts"))
    )


def split_sides(
    left: DataFrame, right: DataFrame, hot: DataFrame, keys: Sequence[str], spread_by: str
) -> tuple[DataFrame, DataFrame]:
    """Add a ``_salt`` join column to both sides.

    Rows of a hot group are spread over several salts on the left and repeated once
    per salt on the right, so an inner join that adds ``_salt`` to its keys gives the
    same pairs. The counts are broadcast while they are few, else joined by a shuffle.
    """
    hot = cut_lineage(hot)
    small = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    spread = (
        left.join(small, list(keys), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread_by), parts).cast("int"))
        .drop("_parts")
    )
    repeated = (
        right.join(small, list(keys), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    return spread, repeated


def rank_in_key(df: DataFrame, keys: Sequence[str], order: str, name: str = "rank") -> DataFrame:
    """1-based position of each row within its key by the column ``order``.

    All rows are put into one order by key and ``order`` and cut into ranges of equal size,
    whatever the values are; a range is ranked on its own and shifted by the rows its key has
    in the ranges before it. A key has at most one count per range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(parts, *keys, order).withColumn("_cut", F.spark_partition_id())
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy("_cut")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = (
        ranged.groupBy(*keys, "_cut")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_cut").orderBy(order)
    return (
        ranged.join(shift, [*keys, "_cut"])
        .withColumn(name, (F.row_number().over(inside) + F.col("_before")).cast("bigint"))
        .drop("_cut", "_before")
    )


def in_order(df: DataFrame, order: Sequence[Column], measure: Column | None = None) -> DataFrame:
    """Rows in one global order, cut into ranges that each fit a task.

    Adds ``_range`` (number of the range), ``_before`` (rows, or sum of ``measure``, in
    all earlier ranges) and ``_all`` (the grand total). A running value is then
    ``_before`` plus a window partitioned by ``_range``. The ranged rows are written
    once, because their cut points must not move between the two reads.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    )
    amount = F.sum(measure) if measure is not None else F.count(F.lit(1))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(amount.alias("_sum"))  # one row per range
    shift = totals.select(
        "_range",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_sum").over(Window.partitionBy()).alias("_all"),
    )
    return ranged.join(F.broadcast(shift), "_range")


def settled(df: DataFrame, *cols: Column | str) -> DataFrame:
    """A projection the optimiser does not see through.

    Long chains of derived columns make its constraint inference grow exponentially, and
    merge into one huge expression; a generated struct ends the chain.
    """
    return df.select(F.inline(F.array(F.struct(*cols))))


def blank(c: Column | str) -> Column:
    """True where the text is null or only white space of any kind."""
    col = F.col(c) if isinstance(c, str) else c
    return ~F.coalesce(col.cast("string"), F.lit("")).rlike("[^" + SPACE_CLASS[1:])
