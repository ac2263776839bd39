"""Exact similarity joins over distinct strings."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import may_reach, seq_ratio
from ..session import cut_lineage
from ..skew import look_up, shuffled

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import the package

BLOCK, MOST_BLOCK = 512, 8_192  # texts of one length that a task holds of either side at a time
BLOCKS = 16  # blocks grow when all texts would be more of them, since every block is sent to all that it meets
STRIP = 512  # texts of a block that are compared with another block at a time
LETTERS = 32  # code points are counted by their remainder
LOWEST_FLOOR = 0.67  # below this a string may have fewer characters than pieces


def _partners(length: Column, floor: float) -> Column:
    """Lengths a string of ``length`` can reach ``floor`` with."""
    low = F.ceil(length * (floor / (2 - floor)) - 1e-9)
    high = F.floor(length * ((2 - floor) / floor) + 1e-9)
    return F.sequence(F.greatest(low, F.lit(1)), high)


def _pieces(text: Column, other: Column, floor: float) -> Column:
    """The right string cut into one piece more than there may be edits."""
    n = F.length(text)
    edits = F.floor((other + n) * (1 - floor) + 1e-9)
    cut = lambda k: F.floor(n * k / (edits + 1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), edits),
        lambda k: F.struct(
            k.cast("int").alias("k"),
            F.substring(text, cut(k) + 1, cut(k + 1) - cut(k)).alias("piece"),
        ),
    )


def _probes(text: Column, other: Column, floor: float) -> Column:
    """Substrings of the left string that may equal a piece of a string of length ``other``."""
    n = F.length(text)
    edits = F.floor((other + n) * (1 - floor) + 1e-9)
    cut = lambda k: F.floor(other * k / (edits + 1)).cast("int")
    gap = n - other
    # A shift costs that many edits before the piece and the rest of the gap after it.
    shifts = F.sequence(
        F.ceil((gap - edits) / 2).cast("int"), F.floor((gap + edits) / 2).cast("int")
    )
    tried = F.transform(
        F.sequence(F.lit(0).cast("bigint"), edits),
        lambda k: F.transform(
            F.filter(
                shifts,
                lambda s: (cut(k) + s >= 0) & (cut(k + 1) + s <= n),
            ),
            lambda s: F.struct(
                k.cast("int").alias("k"),
                F.substring(text, cut(k) + s + 1, cut(k + 1) - cut(k)).alias("piece"),
            ),
        ),
    )
    return F.array_distinct(F.flatten(tried))


def similar_pairs(
    left: DataFrame, right: DataFrame, floor: float, within: Sequence[str] = ()
) -> DataFrame:
    """All pairs of a left and a right ``text`` whose ratio is ``floor`` or more.

    With at most e edits between two strings, one of e+1 pieces of the right string
    occurs unchanged, and nearly in place, in the left one. Joining on pieces therefore
    loses no pair, and only strings that share a piece ever meet. Blank strings are
    left out. The result has the columns ``a``, ``b``, ``ratio`` and those of ``within``.
    """
    if floor < LOWEST_FLOOR:
        raise ValueError(f"floor must be at least {LOWEST_FLOOR}")
    keys = list(within)
    lefts = left.select(*keys, "text").filter("text <> ''").distinct()
    rights = right.select(*keys, "text").filter("text <> ''").distinct()
    n = F.length("text")
    probes = (
        lefts.withColumn("other", F.explode(_partners(n, floor)))
        .withColumn("p", F.explode(_probes(F.col("text"), F.col("other"), floor)))
        .select(*keys, F.col("text").alias("a"), n.alias("la"), F.col("other").alias("lb"), "p.k", "p.piece")
    )
    pieces = (
        rights.withColumn("other", F.explode(_partners(n, floor)))
        .withColumn("p", F.explode(_pieces(F.col("text"), F.col("other"), floor)))
        .select(*keys, F.col("text").alias("b"), F.col("other").alias("la"), n.alias("lb"), "p.k", "p.piece")
    )
    met = probes.join(shuffled(pieces), [*keys, "la", "lb", "k", "piece"]).filter(
        may_reach(F.col("a"), F.col("b"), floor)
    )
    pairs = met.select(*keys, "a", "b").distinct()
    return score_pairs(pairs).filter(F.col("ratio") >= floor)


def _counted(texts: Sequence[str]) -> np.ndarray:
    """Letter counts of each text, one column per text."""
    out = np.zeros((LETTERS, len(texts)), dtype="int16")
    for i, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        out[:, i] = np.bincount(codes % LETTERS, minlength=LETTERS)
    return out


def similar_within(texts: DataFrame, floor: float, block: int | None = None) -> DataFrame:
    """All pairs ``a``, ``b`` of different texts, both ways round, whose ratio is ``floor`` or more.

    For texts that share most of their pieces, such as names with a frequent last word. Texts of one
    length are cut into blocks and blocks of lengths that can reach the floor meet. In them the
    difference of letter counts, which no two texts can undercut by edits, leaves few pairs to compare.
    Work is the square of the distinct texts, divided among tasks that hold two blocks each; every text is sent
    once for each block it meets, so blocks grow with the texts up to ``MOST_BLOCK``.
    """
    if floor <= 0:
        raise ValueError("floor must be above 0")
    rows = cut_lineage(texts.select("text").filter("text <> ''").distinct().withColumn("n", F.length("text")))
    if block is None:
        block = min(MOST_BLOCK, max(BLOCK, rows.count() // BLOCKS))
    parts = rows.groupBy("n").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    place = F.pmod(F.xxhash64("text"), F.col("parts")).cast("int")
    blocks = cut_lineage(
        look_up(rows, parts, "n").groupBy("n", place.alias("p")).agg(F.collect_list("text").alias("texts"))
    )
    side = lambda s: blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in ("n", "p", "texts")])
    low, high = F.col("n_a"), F.floor(F.col("n_a") * ((2 - floor) / floor) + 1e-9)
    lengths = blocks.select(F.col("n").alias("n_a"), F.col("p").alias("p_a")).withColumn(
        "n_b", F.explode(F.sequence(low.cast("int"), high.cast("int")))
    )
    ids = lengths.join(blocks.select(F.col("n").alias("n_b"), F.col("p").alias("p_b")), "n_b").filter(
        "n_a < n_b OR p_a <= p_b"
    )
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = (
        ids.join(shuffled(side("a")), ["n_a", "p_a"]).join(shuffled(side("b")), ["n_b", "p_b"])
        .repartition(tasks, "n_a", "p_a", "n_b", "p_b")
    )

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                left, right = np.array(list(r.texts_a), dtype=object), np.array(list(r.texts_b), dtype=object)
                counts, others = _counted(left), _counted(right)
                for at in range(0, len(left), STRIP):
                    strip = counts[:, at : at + STRIP]
                    apart = np.zeros((strip.shape[1], len(right)), dtype="int16")
                    for x, y in zip(strip, others):
                        if x.any() or y.any():
                            apart += np.abs(x[:, None] - y[None, :])
                    close = apart <= (1.0 - floor) * (r.n_a + r.n_b) + 1e-9
                    if (r.n_a, r.p_a) == (r.n_b, r.p_b):
                        close = np.triu(close, at + 1)
                    i, j = np.nonzero(close)
                    a, b = left[at + i], right[j]
                    yield pd.DataFrame({"a": np.concatenate([a, b]), "b": np.concatenate([b, a])})

    pairs = met.select("n_a", "p_a", "texts_a", "n_b", "p_b", "texts_b").mapInPandas(near, "a string, b string")
    return score_pairs(pairs.filter(may_reach(F.col("a"), F.col("b"), floor))).filter(F.col("ratio") >= floor)


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Add ``ratio`` to pairs ``a``, ``b``; equal strings skip Python."""
    same = F.col("a") == F.col("b")
    return pairs.withColumn(
        "ratio", F.when(same, 1.0).otherwise(seq_ratio(F.col("a"), F.col("b")))
    )

