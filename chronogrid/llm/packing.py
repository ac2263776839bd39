"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

Every round sorts what is left of the documents and the gaps of the open sequences into one
order of falling size, cut into ranges. Read in that order, a document takes the smallest gap
before it that no other document took: gaps and documents pair like brackets, so the depth of a
prefix sum names each pair, and ranks inside a depth settle every conflict. Range totals carry
the sweep from one range to the next. Gaps shrink by what they took and the round repeats; when
documents fit no gap, empty sequences are added for them. Pieces of full length skip the rounds.

A gap that holds the longest document left several times over is offered as that many slots, so
short documents don't need a round each.

Defined cases: a null or empty text is the end token alone; repeated rows are packed as rows of
their own; equal lengths are told apart by row id; texts of any length are cut into full pieces; the text of an added token
(the end-of-text mark) is that token; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import RANGE_ROWS, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import the package

CAPACITY = 1024
END_ID = 2


def tokenizer_files() -> tuple[str, str]:
    """The vocabulary as JSON, and the same as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(json_path: str) -> dict[str, int]:
    """Texts that the tokenizer takes as one token of their own wherever they occur."""
    import json

    with open(json_path, encoding="utf-8") as file:
        return {t["content"]: int(t["id"]) for t in json.load(file)["added_tokens"]}


def load_encoder(ranks_path: str, added: dict[str, int]):
    """Text to ids. The ranks give the ids of the JSON vocabulary, several times as fast."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added
    )

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return coder.encode(text, allowed_special="all")
        return coder.encode_ordinary(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and ends of the pieces of ``n`` tokens; the first may be shorter."""
    head = n % capacity
    bounds = [0, *range(head or capacity, n + 1, capacity)]
    return list(zip(bounds, bounds[1:], strict=False))


def token_pieces(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    ranks_path: str | None = None,
    json_path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]`` of each piece of each document."""
    json_path, ranks_path = json_path or tokenizer_files()[0], ranks_path or tokenizer_files()[1]
    added = added_tokens(json_path)
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {key_type}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(ranks_path, added)
        for batch in batches:
            owner, rows, ids = [], [], []
            for at, content in enumerate(batch.column(1).to_pylist()):
                coded = np.array([*encode(content), end_id], dtype="<u4")
                for k, (a, b) in enumerate(cut(len(coded), capacity)):
                    owner.append(at)
                    rows.append((k, a, b - a, zlib.crc32(coded[a:b].tobytes())))
                    if with_ids:
                        ids.append(coded[a:b].astype("i4"))
            if not rows:
                continue
            number, start, length, crc = (np.array(x, dtype="i8") for x in zip(*rows, strict=True))
            columns = [
                batch.column(0).take(pa.array(owner)),
                pa.array(number.astype("i4")),
                pa.array(start),
                pa.array(length),
                pa.array(crc),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, type=pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")).mapInArrow(pieces, schema)


def _sweep(tokens: DataFrame, rows: int) -> DataFrame:
    """Pairs documents with gaps; adds ``mate`` and ``mate_size`` to both (null: none)."""
    order = [F.col("size").desc(), F.col("is_doc"), F.col("id"), F.col("slot")]
    parts = max(1, math.ceil(rows / RANGE_ROWS))
    ranged = cut_lineage(
        tokens.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    )
    upto = Window.partitionBy("_range").orderBy(*order)
    past = upto.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn(
        "_sum",
        F.sum(F.when(F.col("is_doc"), -1).otherwise(1)).over(
            upto.rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (  # one row per range
        local.groupBy("_range")
        .agg(
            F.sum(F.when(F.col("is_doc"), -1).otherwise(1)).alias("_total"),
            F.min("_sum").alias("_low"),
        )
        .withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .withColumn("_floor", F.min(F.col("_before") + F.col("_low")).over(earlier))
        .select("_range", "_before", F.least(F.lit(0), F.col("_floor")).alias("_floor"))
    )
    deep = local.join(F.broadcast(shift), "_range").withColumn(
        "_lowest", F.least(F.col("_floor"), F.col("_before") + F.min("_sum").over(past))
    )
    depth = F.col("_before") + F.col("_sum") - F.col("_lowest") + F.col("is_doc").cast("int")
    beside = Window.partitionBy("_depth").orderBy(*order)
    near = lambda f, c: f(F.struct("is_doc", c)).over(beside)
    pair = F.when(F.col("is_doc"), near(F.lag, "id")).otherwise(near(F.lead, "id"))
    size = F.when(F.col("is_doc"), near(F.lag, "size")).otherwise(near(F.lead, "size"))
    free = F.col("_depth") < 1  # a document that found no gap
    paired = deep.withColumn("_depth", depth)
    # Documents without a gap are many and share depth 0; they need no partner and are spread.
    spread = paired.withColumn("_depth", F.when(free, -1 - F.col("id")).otherwise(F.col("_depth")))
    other = spread.select("is_doc", "id", "slot", "size", "gap", pair.alias("_p"), size.alias("_s"), "_depth")
    good = (F.col("_depth") > 0) & (F.col("_p.is_doc") != F.col("is_doc"))
    return other.select(
        "is_doc",
        "id",
        "slot",
        "size",
        "gap",
        F.when(good, F.col("_p.id")).alias("mate"),
        F.when(good, F.col("_s.size")).alias("mate_size"),
    )


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``id, sequence_id`` of items ``id, length`` with ``0 < length < capacity``.

    What is collected per round is a histogram of at most ``capacity`` lengths and two numbers.
    """
    spark = items.sparkSession
    left = items.select("id", F.col("length").cast("int").alias("length"))
    gaps, placed, opened = None, [], 0
    counts = {r["length"]: r["count"] for r in left.groupBy("length").count().collect()}
    top, open_count = 0, 0  # the largest gap, and how many there are
    while counts:
        stuck = {n: k for n, k in counts.items() if n > top}
        need = max(
            math.ceil(sum(n * k for n, k in stuck.items()) / capacity),
            sum(k for n, k in stuck.items() if n > capacity // 2),
        )
        if need:
            fresh = spark.range(opened, opened + need).select("id", F.lit(capacity).alias("gap"))
            gaps = fresh if gaps is None else gaps.unionByName(fresh)
            opened += need
        longest = max(counts)
        slots = F.greatest(F.lit(1), F.floor(F.col("gap") / longest)).cast("int")
        offers = gaps.select(
            F.lit(False).alias("is_doc"),
            "id",
            F.explode(F.sequence(F.lit(1), slots)).alias("slot"),
            F.floor(F.col("gap") / slots).cast("int").alias("size"),
            "gap",
        )
        asks = left.select(
            F.lit(True).alias("is_doc"),
            "id",
            F.lit(0).alias("slot"),
            F.col("length").alias("size"),
            F.lit(0).alias("gap"),
        )
        result = cut_lineage(_sweep(asks.unionByName(offers), sum(counts.values()) + open_count + need))
        placed.append(result.filter("is_doc AND mate IS NOT NULL").select("id", F.col("mate").alias("sequence_id")))
        left = result.filter("is_doc AND mate IS NULL").select("id", F.col("size").alias("length"))
        counts = {r["length"]: r["count"] for r in left.groupBy("length").count().collect()}
        if not counts:
            break
        used = F.col("gap") - F.sum(F.coalesce("mate_size", F.lit(0)))
        gaps = cut_lineage(
            result.filter("NOT is_doc")
            .groupBy("id", "gap")
            .agg(used.cast("int").alias("rest"))
            .select("id", F.col("rest").alias("gap"))
            .filter(F.col("gap") >= min(counts))
        )
        top, open_count = gaps.agg(F.coalesce(F.max("gap"), F.lit(0)), F.count(F.lit(1))).first()
    if not placed:
        return items.select("id", F.col("id").alias("sequence_id")).limit(0)
    whole = placed[0]
    for more in placed[1:]:
        whole = whole.unionByName(more)
    return whole


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length``."""
    numbered = cut_lineage(pieces.withColumn("_id", F.monotonically_increasing_id()))
    short = numbered.filter(F.col("length") < capacity).select(F.col("_id").alias("id"), "length")
    homes = best_fit(short, capacity)
    full = numbered.filter(F.col("length") == capacity).select(
        F.col("_id").alias("id"), (-1 - F.col("_id")).alias("sequence_id")
    )
    inside = Window.partitionBy("sequence_id").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        numbered.join(homes.unionByName(full), F.col("_id") == F.col("id"))
        .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
        .drop("_id", "id")
    )
