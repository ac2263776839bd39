"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words: its weight's share of all words, but at most
``most`` times the words it has, what is above being shared again by weight. Every document
of a source is then expected ``target / words`` times. The expected copies are summed along
the source's documents in order of size, one random offset per source is added, and a copy is
emitted for each whole number the running sum crosses. Because neighbours in that order are
alike in size, the words taken differ from the target by less than the longest document.

Defined cases: a null text has no words; a null source is a source of its own, last in order;
documents without words are taken with the rate of their source and add nothing; repeated rows
are sampled as rows of their own; a source without words has target 0; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import free_name, maybe_broadcast, ordered, text_of, with_row_id, word_count

MOST = 3  # a source is repeated this often at most
SOURCE_ROW_BYTES = 256


def _offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) per source, the same in every run."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00")))
    digits = F.substring(F.md5(named.cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """``source, n_docs, source_size, target`` of each source; ``sizes`` has source and size.

    Capping repeats until no source is above its cap: sources above it are fixed there and the
    rest is shared by weight among the others. A round is one aggregate of three sums.
    """
    found = cut_lineage(
        sizes.groupBy("source").agg(
            F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")
        )
    )
    place = ordered(found, [F.col("source").asc_nulls_last()], found.count())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        (F.col("_position") % len(weights) + 1).cast("int"),
    ).cast("long")
    place = place.select("*", weight.alias("_w"), (F.col("source_size") * most).alias("_cap"))
    total = place.agg(F.sum("source_size")).first()[0] or 0
    full, share = None, (0, 1)
    while True:
        over = F.lit(False) if full is None else full
        spent, open_weight = place.agg(
            F.sum(F.when(over, F.col("_cap")).otherwise(0)),
            F.sum(F.when(over, 0).otherwise(F.col("_w"))),
        ).first()
        if not open_weight:
            break
        if full is not None and (total - spent, open_weight) == share:
            break
        share = (total - spent, open_weight)
        full = F.col("_cap") * share[1] < F.col("_w") * share[0]
    wanted = F.col("_w").cast("double") * float(share[0]) / float(share[1])
    return place.select(
        "source",
        "n_docs",
        "source_size",
        F.least(F.col("_cap").cast("double"), wanted).alias("target"),
    )


def systematic_copies(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = MOST,
    seed: int = 7,
    row: str | None = None,
) -> DataFrame:
    """``doc_id, _row, size, source, source_size, target, copies`` of each document.

    Positions come from one global order by source, size and key; a document's place in its
    source is its position less that of the source's first document, so a source that holds a
    third of all rows is spread over as many ranges as it needs. ``_row`` tells repeated rows
    apart.
    """
    picked = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        word_count(text_of(text)).alias("size"),
        *([F.col(row).alias("_row")] if row else []),
    )
    sizes = cut_lineage(picked if row else with_row_id(picked))
    targets = cut_lineage(source_targets(sizes, weights, most))
    n_sources = targets.count()
    place = ordered(targets, [F.col("source").asc_nulls_last()], n_sources, "_nth")
    # One row per source: rows of all earlier sources, summed over ranges of sources.
    first = _before(place)
    order = [
        F.col("source").asc_nulls_last(),
        F.col("size").desc(),
        F.col("doc_id").asc_nulls_last(),
        F.col("_row").asc(),
    ]
    rows = sizes.count()
    placed = ordered(sizes, order, rows)
    side = maybe_broadcast(first, n_sources, SOURCE_ROW_BYTES).alias("s")
    joined = placed.alias("d").join(side, F.col("d.source").eqNullSafe(F.col("s.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    nth = (F.col("_position") - F.col("_first")).cast("double")
    offset = _offset(F.col("d.source"), seed)
    copies = F.floor((nth + 1) * rate + offset) - F.floor(nth * rate + offset)
    return joined.select(
        "doc_id",
        "_row",
        F.col("d.source").alias("source"),
        "size",
        "source_size",
        "target",
        copies.cast("long").alias("copies"),
    )


def _before(place: DataFrame) -> DataFrame:
    """Adds ``_first``, the documents of all earlier sources, block by block of positions."""
    block = F.floor(F.col("_nth") / 100_000)
    blocks = place.groupBy(block.alias("_block")).agg(F.sum("n_docs").alias("_n"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = blocks.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_block").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    return (
        place.withColumn("_block", block)
        .join(shift, "_block")
        .select(
            "source",
            "source_size",
            "target",
            (F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("_shift")).alias("_first"),
        )
    )


def mix(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """The mixed documents: each row of ``docs`` as many times as it was drawn, same columns."""
    row, times, nth = (free_name(docs.columns, c) for c in ("mix_row", "mix_copies", "mix_copy"))
    fixed = with_row_id(docs, row)
    drawn = systematic_copies(fixed, source=source, row=row, **options)
    often = drawn.filter("copies > 0").select(F.col("_row").alias(row), F.col("copies").cast("int").alias(times))
    return (
        fixed.join(often, row)
        .withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
