"""Reversible line dedup: sharded cuckoo filters before exact reference-count tables.

The state is a folder of Parquet tables. ``postings`` holds which document has which line key,
``counts`` how many documents hold a key and the largest of their ids, and ``filters`` one
cuckoo filter per shard of keys over the limit. A cuckoo filter answers "surely not" for most
lines, so only the lines it lets through are shuffled to the exact table, which decides. It
stores a 16-bit fingerprint in one of two buckets, which is why a key can also be taken out
again. Inserting documents and deleting them move the counts up and down, and a key that
crosses the limit enters or leaves the filter of its shard, so a deletion restores exactly the
state before the insertion.

A line's key is the line without the six white-space characters at both ends and with A-Z in
lower case; it is known by a digest of 128 bits.

Defined cases: a null or empty text is one empty line; rows of one id are one document when keys are
counted, but each is answered, and all of them keep a line for which that id is the largest; a null id
is an id, below every other; inserting an id that is there adds what it did not hold; texts and lines of
any length are read whole; an empty table gives an empty table. Other columns are passed on unread.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, shared_folder
from .common import BROADCAST_BYTES, free_name, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import the package

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 50_000  # keys wanted in one filter
SLOTS = 4  # fingerprints in a bucket
LOAD = 0.8  # share of slots filled
KICKS = 500
BLANKS = " \t\n\v\f\r"
KEY_TYPE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def line_key(line: str) -> bytes | None:
    """The 128-bit digest of a line's key; None for a line that is too short to count."""
    import xxhash

    if len(line) < MIN_CHARS or len(line := line.strip(BLANKS)) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(line.encode().lower())  # on bytes: only A-Z


def batch_keys(texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Lines of each text; text and line number of the long ones; their digests as (n, 2)."""
    lines, places, digests = [], [], []
    for at, text in enumerate(texts):
        lines.append(text.split("\n"))
        for k, line in enumerate(lines[-1]):
            if (key := line_key(line)) is not None:
                places.append((at, k))
                digests.append(key)
    keys = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
    return lines, np.array(places, dtype=np.int64).reshape(-1, 2), keys


# --- cuckoo filters ---------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def fingerprints(b: np.ndarray) -> np.ndarray:
    """16 bits of the second digest, never 0 (which marks a free slot)."""
    return ((b.astype(np.uint64) >> np.uint64(20)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def buckets_of(a: np.ndarray, mark: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two buckets of a key; each follows from the other and the fingerprint alone."""
    first = (_mix(a) & np.uint64(size - 1)).astype(np.int64)
    return first, first ^ (_mix(mark) & np.uint64(size - 1)).astype(np.int64)


def empty_filter(keys: int) -> np.ndarray:
    size = 1
    while size * SLOTS * LOAD < max(1, keys):
        size *= 2
    return np.zeros((size, SLOTS), dtype=np.uint16)


def filter_insert(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Adds keys in place; False if a fingerprint found no place (the caller then grows it)."""
    marks = fingerprints(b)
    one, two = buckets_of(a, marks, len(table))
    moves = np.random.default_rng(len(table))
    for mark, i, j in zip(marks, one, two, strict=True):
        for at in (i, j):
            free = np.flatnonzero(table[at] == 0)
            if len(free):
                table[at, free[0]] = mark
                break
        else:
            at = j
            for _ in range(KICKS):
                slot = moves.integers(SLOTS)
                mark, table[at, slot] = table[at, slot], mark
                at = at ^ int(_mix(np.array([mark], dtype=np.uint16))[0] & np.uint64(len(table) - 1))
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = mark
                    break
            else:
                return False
    return True


def filter_delete(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Takes out keys that were inserted before."""
    marks = fingerprints(b)
    for mark, i, j in zip(marks, *buckets_of(a, marks, len(table)), strict=True):
        for at in (i, j):
            held = np.flatnonzero(table[at] == mark)
            if len(held):
                table[at, held[0]] = 0
                break


def filter_has(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    marks = fingerprints(b)
    one, two = buckets_of(a, marks, len(table))
    return (table[one] == marks[:, None]).any(axis=1) | (table[two] == marks[:, None]).any(axis=1)


def update_filter(old: bytes | None, add: np.ndarray, drop: np.ndarray) -> bytes | None:
    """The filter of a shard after keys ``drop`` left and ``add`` came, both (n, 2) digests; None if it is full."""
    if old is not None:
        table = np.frombuffer(old, dtype=np.uint16).reshape(-1, SLOTS).copy()
        filter_delete(table, drop[:, 0], drop[:, 1])
        if filter_insert(table, add[:, 0], add[:, 1]):
            return table.tobytes()
        return None
    room = len(add)
    while not filter_insert(table := empty_filter(room), add[:, 0], add[:, 1]):
        room *= 2
    return table.tobytes()


def shard_of(a: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(a, 7), F.lit(shards)).cast("int")


# --- state ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LineState:
    """Where the tables of one version of the state lie; versions are never changed."""

    path: str
    shards: int
    filter_bytes: int
    over: int  # keys at or over the limit

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def key_array(keys: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["a", "b"])


def _postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, key``: the distinct long lines of each document."""
    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))

    def long_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, places, keys = batch_keys(batch.column(1).to_pylist())
            once = np.unique(np.column_stack([places[:, 0], keys]), axis=0) if len(keys) else np.empty((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(once[:, 0])), key_array(once[:, 1:])], names=["doc_id", "key"]
            )

    return rows.mapInArrow(long_lines, rows.select("doc_id").schema.add("key", KEY_TYPE))


def _counted(postings: DataFrame) -> DataFrame:
    """How many ids hold a key (rows of one id are one document, null is an id), and the largest."""
    ids = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))
    return postings.groupBy("key").agg(ids.alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _write_state(spark: SparkSession, postings: DataFrame | None, counts: DataFrame, old: LineState | None) -> LineState:
    """Writes counts and filters of a new version. Filters change by the keys that crossed."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    if postings is not None:
        postings.write.parquet(f"{path}/postings")
    counts.write.parquet(f"{path}/counts")
    over = spark.read.parquet(f"{path}/counts").filter(F.col("n_docs") >= MIN_DOCS).select("key")
    n_over = over.count()
    shards = old.shards if old else 1 + n_over // SHARD_KEYS
    moved = over.withColumn("add", F.lit(True))
    if old:
        was = old.read(spark, "counts").filter(F.col("n_docs") >= MIN_DOCS).select("key")
        moved = over.join(was, "key", "left_anti").withColumn("add", F.lit(True)).unionByName(
            was.join(over, "key", "left_anti").withColumn("add", F.lit(False))
        )
    moved = moved.select(
        shard_of(F.col("key.a"), shards).alias("shard"), F.col("key.a").alias("a"), F.col("key.b").alias("b"), "add"
    )
    schema = "shard int, bits binary"

    def build(shard: tuple, was: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        pick = lambda m: rows.loc[m, ["a", "b"]].to_numpy(dtype=np.int64)
        old_bits = was["bits"].iloc[0] if len(was) else None
        return pd.DataFrame({"shard": [shard[0]], "bits": [update_filter(old_bits, pick(rows["add"]), pick(~rows["add"]))]})

    before = old.read(spark, "filters") if old else spark.createDataFrame([], schema)
    built = before.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(build, schema)
    built.write.parquet(f"{path}/filters")
    if old and spark.read.parquet(f"{path}/filters").filter("bits IS NULL").limit(1).count():
        # A shard outgrew its filter: lay all of them out anew, with as many as are needed now.
        held = None if postings is None else spark.read.parquet(f"{path}/postings")
        return _write_state(spark, held, spark.read.parquet(f"{path}/counts"), None)
    total = spark.read.parquet(f"{path}/filters").agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    return LineState(path, shards, total, n_over)


def build_state(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_postings: bool = True) -> LineState:
    """State of a first set of documents. Postings are needed for deletions only."""
    spark = docs.sparkSession
    postings = _postings(docs, key, text)
    if not keep_postings:
        return _write_state(spark, None, _counted(postings), None)
    postings = cut_lineage(postings)
    return _write_state(spark, postings, _counted(postings), None)


def insert_documents(state: LineState, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineState:
    """State with more documents; only counts of keys that they hold change."""
    spark = docs.sparkSession
    same = ["doc_id", "key"]
    new, old = _postings(docs, key, text).distinct(), state.read(spark, "postings")
    matched = F.col("n.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("n.key") == F.col("o.key"))
    new = cut_lineage(new.alias("n").join(old.alias("o"), matched, "left_anti").select(*same))
    both = state.read(spark, "counts").unionByName(_counted(new))
    counts = both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
    return _write_state(spark, old.unionByName(new), counts, state)


def delete_documents(state: LineState, ids: DataFrame) -> LineState:
    """State without the documents of ``ids`` (column doc_id, null for those without an id), as if they had never come.

    Only keys that the deleted documents hold are counted again.
    """
    spark = ids.sparkSession
    gone = ids.select(F.col("doc_id").alias("gone")).distinct()
    postings, matched = state.read(spark, "postings"), F.col("doc_id").eqNullSafe(F.col("gone"))
    rest = cut_lineage(postings.join(gone, matched, "left_anti"))
    touched = cut_lineage(postings.join(gone, matched, "left_semi").select("key").distinct())
    again = _counted(rest.join(touched, "key", "left_semi"))
    counts = state.read(spark, "counts").join(touched, "key", "left_anti").unionByName(again)
    return _write_state(spark, rest, counts, state)


# --- application ------------------------------------------------------------------------------


class Filters:
    """The filters of all shards in a task."""

    def __init__(self, bits: dict[int, bytes], shards: int) -> None:
        self.tables = {k: np.frombuffer(v, dtype=np.uint16).reshape(-1, SLOTS) for k, v in bits.items()}
        self.shards = shards

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """False for keys that surely are under the limit."""
        found, home = np.zeros(len(keys), dtype=bool), (keys[:, 0] >> 7) % self.shards
        for k in np.unique(home):
            if k in self.tables:
                at = np.flatnonzero(home == k)
                found[at] = filter_has(self.tables[k], keys[at, 0], keys[at, 1])
        return found


def _filters(spark: SparkSession, state: LineState):
    """A broadcast of the filters, or None where they are over the bound."""
    if state.filter_bytes > BROADCAST_BYTES:
        return None
    rows = state.read(spark, "filters").collect()
    return spark.sparkContext.broadcast({r["shard"]: bytes(r["bits"]) for r in rows})


def lines_to_drop(state: LineState, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, drop``: keys a document loses, for the documents that lose any.

    What the filters let through meets the exact table in a shuffle join, whose skewed
    partitions Spark splits.
    """
    spark, shards = docs.sparkSession, state.shards
    asked, sent = _postings(docs, key, text), _filters(spark, state)
    if sent is not None:

        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            maybe = Filters(sent.value, shards)
            for batch in batches:
                keys = np.column_stack([batch.column(1).field(i).to_numpy() for i in (0, 1)])
                yield batch.filter(pa.array(maybe(keys)))

        asked = asked.mapInArrow(sift, asked.schema)
    over = state.read(spark, "counts").filter(F.col("n_docs") >= MIN_DOCS)
    lost = cut_lineage(asked).join(over, "key").filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def dedup_lines(
    state: LineState,
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    bound: int = BROADCAST_BYTES,
    added: tuple[str, str, str] = ("__n_lines", "__n_dropped", "__kept"),
) -> DataFrame:
    """``docs`` with its number of lines, of dropped lines and the text that is left, named by ``added``.

    While the exact rows of the keys over the limit stay within ``bound`` bytes, they are sent to
    the tasks next to the filters, and texts are read once and not shuffled. Beyond it each
    document meets its list of keys in a join. Both ways give the same rows.
    """
    spark, shards = docs.sparkSession, state.shards
    own_id, own_text, drop_id, drop_keys = (free_name(docs.columns, c) for c in ("own_id", "own_text", "drop_id", "drop_keys"))
    wide = docs.select("*", F.col(key).alias(own_id), text_of(text).alias(own_text))
    local = state.over * 40 <= bound and state.filter_bytes <= bound
    if local:
        over = state.read(spark, "counts").filter(F.col("n_docs") >= MIN_DOCS)
        rows = over.select("key.a", "key.b", "last_doc").orderBy("a", "b").toArrow()
        exact = spark.sparkContext.broadcast(
            (rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_pylist())
        )
        sent = _filters(spark, state)
    else:
        drop = cut_lineage(lines_to_drop(state, docs, key, text)).toDF(drop_id, drop_keys)
        wide = wide.join(drop, F.col(own_id).eqNullSafe(F.col(drop_id)), "left").drop(drop_id)
    names = [*docs.columns, *added]
    width = len(docs.columns)

    def local_losses(ids: list, places: np.ndarray, keys: np.ndarray, maybe: Filters) -> set[tuple[int, int]]:
        firsts, seconds, last = exact.value
        out = set()
        for k in np.flatnonzero(maybe(keys)):
            at = int(np.searchsorted(firsts, keys[k, 0]))
            while at < len(firsts) and firsts[at] == keys[k, 0] and seconds[at] != keys[k, 1]:
                at += 1
            if at < len(firsts) and firsts[at] == keys[k, 0] and ids[places[k, 0]] != last[at]:
                out.add((int(places[k, 0]), int(places[k, 1])))
        return out

    def joined_losses(lists: list, places: np.ndarray, keys: np.ndarray) -> set[tuple[int, int]]:
        gone = [{(d["a"], d["b"]) for d in x or ()} for x in lists]
        return {(int(i), int(k)) for (i, k), (a, b) in zip(places, keys.tolist(), strict=True) if (a, b) in gone[i]}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = Filters(sent.value, shards) if local else None
        for batch in batches:
            texts = batch.column(width + 1).to_pylist()
            lines, places, keys = batch_keys(texts)
            if local:
                lost = local_losses(batch.column(width).to_pylist(), places, keys, maybe)
            else:
                lost = joined_losses(batch.column(width + 2).to_pylist(), places, keys)
            touched = {i for i, _ in lost}
            kept = [
                "\n".join(x for k, x in enumerate(lines[i]) if (i, k) not in lost) if i in touched else text
                for i, text in enumerate(texts)
            ]
            dropped = np.bincount([i for i, _ in lost], minlength=len(texts)) if lost else np.zeros(len(texts), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:width],
                    pa.array([len(x) for x in lines], pa.int64()),
                    pa.array(dropped.astype(np.int64)),
                    pa.array(kept, pa.string()),
                ],
                names=names,
            )

    schema = T.StructType([*docs.schema.fields])
    for name, kind in zip(added, (T.LongType(), T.LongType(), T.StringType()), strict=True):
        schema = schema.add(name, kind)
    return wide.mapInArrow(apply, schema)
