"""Near-duplicate documents: MinHash bands, odd sketches and exact confirmation.

1. Each text becomes the set of its five-word shingles, its MinHash samples and band keys. Texts
   with one and the same set are one node from here on.
2. Nodes that share a band key are candidates. The 240 samples are cut into the widest bands with
   which a pair at the limit shares no key with a probability under 1e-8: 40 bands of 6 at 0.85,
   48 bands of 5 at 0.8. Stars around the smallest node of each band key
   give candidate clusters, without any list of pairs.
3. Clusters are cut into blocks of bounded size and every pair of blocks is one small group. In
   it, odd sketches (the MinHash samples folded into a parity bitmap; Mitzenmacher, Pagh and
   Pham, 2014) are compared by the population count of their XOR, and what they can't rule out is
   confirmed on the full sets. Only links that join two trees of the group are returned, at most
   one per member, so copies are not expanded into pairs and no link between trees is lost.
4. Connected components of those links.

Work inside a cluster of n different texts grows with n * n / block size; everything else is
linear.

Defined cases: a null, empty or blank text has an empty set and no links; fewer than five words
are one shingle; repeated rows are one node; an empty table gives an empty table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import maybe_broadcast, placed, text_of, with_row_id
from .components import connected_components

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import the package

WORDS = 5
SAMPLES = 240
MISS = 1e-8  # chance that a pair just at the limit shares no band key
SKETCH_BITS = 512
BLOCK_NODES, BLOCK_SHINGLES = 256, 2_000_000
SLACK = 0.17  # an estimate this far below the limit is not looked at; over six deviations


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _constants() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20140407).integers(0, 2**63, WORDS + SAMPLES, dtype=np.uint64)
    odd = draw * np.uint64(2) + np.uint64(1)
    return odd[:WORDS], odd[WORDS:]


class Shingler:
    """Texts to sorted sets of shingle digests. Words are hashed once while they stay cached."""

    def __init__(self) -> None:
        import xxhash

        self.digest, self.words, self.weights = xxhash.xxh64_intdigest, {}, _constants()[0]

    def word(self, w: bytes) -> int:
        h = self.words.get(w)
        if h is None:
            if len(self.words) > 500_000:
                self.words.clear()
            h = self.words[w] = self.digest(w)
        return h

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # on bytes: A-Z and the six white-space characters
        if not words:
            return np.empty(0, dtype=np.uint64)
        h = np.fromiter(map(self.word, words), np.uint64, len(words))
        n = len(h) - WORDS + 1
        if n < 1:
            return _mix((h * self.weights[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
        return np.unique(_mix(sum(h[i : i + n] * self.weights[i] for i in range(WORDS))))


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples of non-empty sets, one row per set, a few sets at a time."""
    factors = _constants()[1]
    out = np.empty((len(sets), len(factors)), dtype=np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 50_000):
            size += len(sets[end])
            end += 1
        joined = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        for k, f in enumerate(factors):
            out[at:end, k] = np.minimum.reduceat(joined * f, starts)
        at = end
    return out


def band_shape(percent: int) -> tuple[int, int]:
    """Number and width of the bands for a limit of similarity."""
    for rows in range(SAMPLES, 1, -1):
        if (1 - (percent / 100) ** rows) ** (SAMPLES // rows) <= MISS:
            return SAMPLES // rows, rows
    return SAMPLES, 1


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band; the band's number goes into it."""
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(samples), 1))
    for r in range(rows):
        keys = _mix(keys + samples[:, r::rows][:, :bands])
    return keys


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples: each flips the bit that it and its number choose."""
    numbered = _mix(samples + np.arange(samples.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bit = (numbered % np.uint64(SKETCH_BITS)).astype(np.int64)
    parity = np.zeros((len(samples), SKETCH_BITS), dtype=np.uint8)
    rows = np.repeat(np.arange(len(samples)), bit.shape[1])
    np.bitwise_xor.at(parity, (rows, bit.ravel()), 1)
    return np.packbits(parity, axis=1).view(np.uint64)


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of every row of ``a`` with every row of ``b``."""
    odd = np.zeros((len(a), len(b)), dtype=np.float64)
    for k in range(a.shape[1]):
        odd += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
    share = np.clip(1 - 2 * odd / SKETCH_BITS, 1e-9, None)
    differing = -SKETCH_BITS / 2 * np.log(share)  # samples of either side that the other lacks
    return 1 - differing / (2 * SAMPLES)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def group_links(
    sets: list[np.ndarray], sketches: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """Confirmed links between members ``left`` and ``right`` that join two trees."""
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    guess = sketch_similarity(sketches[left], sketches[right])
    x, y = np.nonzero(guess >= percent / 100 - SLACK)
    best = np.argsort(-guess[x, y], kind="stable")
    out = []
    for i, j in zip(left[x[best]].tolist(), right[y[best]].tolist(), strict=True):
        if i != j and root(i) != root(j) and linked(sets[i], sets[j], percent):
            parent[root(i)] = root(j)
            out.append((i, j))
    return out


def mark_documents(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """``doc_id, _row, doc, n_shingles, a, b, bands`` of each row (written; no texts)."""
    picked = with_row_id(docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")))
    rows = picked.select("doc_id", "_row.file", "_row.at", "text")
    shape = band_shape(percent)
    schema = rows.drop("text").schema
    for name in ("n_shingles", "a", "b"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("bands", T.ArrayType(T.LongType()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        shingle = Shingler()
        for batch in batches:
            sets = [shingle(t) for t in batch.column(3).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            digest = np.zeros((len(sets), 2), dtype=np.int64)
            bands: list = [[]] * len(sets)
            if full:
                keys = band_keys(min_hashes([sets[i] for i in full]), *shape).view(np.int64)
                for i, k in zip(full, keys, strict=True):
                    digest[i] = np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), np.int64)
                    bands[i] = k
            columns = [batch.column(i) for i in range(3)]
            columns.append(pa.array(np.array([len(s) for s in sets], dtype=np.int64)))
            columns += [pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(bands, type=pa.list_(pa.int64()))]
            names = ["doc_id", "file", "at", "n_shingles", "a", "b", "bands"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut_lineage(rows.mapInArrow(mark, schema).withColumn("doc", F.monotonically_increasing_id()))


def candidate_clusters(marks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component`` of nodes that share a band key with another, directly or in steps."""
    bands = marks.join(nodes.select("doc", "node"), "doc").select("node", F.explode("bands").alias("band"))
    first = bands.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
    stars = bands.join(first.filter("n > 1").drop("n"), "band").select(F.col("node").alias("u"), F.col("first").alias("v"))
    return connected_components(stars)


def confirmed_links(
    docs: DataFrame, marks: DataFrame, nodes: DataFrame, clusters: DataFrame, percent: int, text: str
) -> DataFrame:
    """Links ``u, v`` between nodes, enough of them to connect whatever is linked."""
    schema = "node long, words binary, sketch binary"
    place = nodes.join(clusters, "node").join(marks.select("doc", "file", "at"), "doc").select("node", "file", "at")
    texts = with_row_id(docs.select(text_of(text).alias("text"))).select("_row.file", "_row.at", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            sets = [shingle(t) for t in batch.column(1).to_pylist()]
            if sets:
                sketches = odd_sketches(min_hashes(sets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([s.tobytes() for s in sets]), pa.array([s.tobytes() for s in sketches])],
                    names=["node", "words", "sketch"],
                )

    sets = cut_lineage(texts.join(place, ["file", "at"]).select("node", "text").mapInArrow(sets_of, schema))
    sized = nodes.join(clusters, "node").select("node", "component", "n_shingles")
    blocks = sized.groupBy("component").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    large = cut_lineage(blocks.filter("blocks > 1"))  # one row per BLOCK_NODES nodes at most
    side = maybe_broadcast(large, large.count(), 32)
    blocked = cut_lineage(
        sized.join(side, "component", "left").select("node", "component", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        sets.join(blocked, "node")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )

    def confirm(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        inside = [np.frombuffer(x, dtype=np.uint64) for x in group["words"]]
        sketches = np.frombuffer(b"".join(group["sketch"]), dtype=np.uint64).reshape(len(group), -1)
        low, high, own = (group[c].to_numpy() for c in ("low", "high", "block"))
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        found = group_links(inside, sketches, left, right, percent)
        node = group["node"].to_numpy()
        return pd.DataFrame({"u": [node[i] for i, _ in found], "v": [node[j] for _, j in found]}, dtype="int64")

    return (
        dealt.select("component", "low", "high", "block", "node", "words", "sketch")
        .groupBy("component", "low", "high")
        .applyInPandas(confirm, "u long, v long")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """``doc_id, file, at, n_shingles, component_id, kept, first`` of each row.

    ``kept`` marks the smallest id of each component, ``first`` exactly one row of it.
    """
    docs = placed(docs)  # marks and texts are joined by the places of rows
    marks = mark_documents(docs, key, text, percent)
    full = marks.filter("n_shingles > 0")
    nodes = cut_lineage(
        full.groupBy("a", "b")
        .agg(F.min("doc").alias("doc"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    clusters = cut_lineage(candidate_clusters(marks, nodes))
    links = confirmed_links(docs, marks, nodes, clusters, percent, text)
    joined = cut_lineage(connected_components(links))
    named = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = cut_lineage(named.groupBy("component").agg(F.min("least").alias("component_id")))
    owners = cut_lineage(named.join(lowest, "component").select("a", "b", "component", "component_id"))
    owned = full.drop("bands").join(owners, ["a", "b"])
    holders = owned.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = cut_lineage(holders.groupBy("component").agg(F.min("doc").alias("_first")))
    alone = marks.filter("n_shingles = 0").select(
        "doc_id",
        "file",
        "at",
        "n_shingles",
        F.col("doc_id").alias("component_id"),
        F.lit(True).alias("kept"),
        F.lit(True).alias("first"),
    )
    return owned.join(first, "component").select(
        "doc_id",
        "file",
        "at",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        (F.col("doc") == F.col("_first")).alias("first"),
    ).unionByName(alone)
