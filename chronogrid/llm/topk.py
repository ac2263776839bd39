"""Exact top-k inner products in three phases with one uniform threshold.

Queries and candidates are cut into blocks of bounded size, and every pair of blocks is one
small unit of work. Phase one gathers from each unit the local score list of each query; the
k-th best of all lists is a safe cutoff, because k candidates reach it. Phase two sends every
unit the cutoff, and it collects the entries that can still reach it: the product over the first
half of the components plus a Cauchy-Schwarz bound on the rest. Phase three resolves those
entries exactly and merges what reaches the cutoff. Lists are merged in rounds of bounded
width, so the number of blocks does not limit a query.

Components become ``floor(scale * x)``, so scores are whole numbers and exact.

Defined cases: vectors that are null or hold a null or non-finite component take no part; only
vectors of one length are compared; a query's own row is no candidate, a repetition of it is;
ties go to the smaller id; a query with fewer candidates than k gets all; no query or no vector
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import the package

SCALE, TOP = 64, 20
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
MERGE = 64  # lists merged into one per round
LONG = 2**63 - 1


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, dim, v`` of usable vectors; ``v`` holds 64-bit whole numbers."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, dims, out = [], [], []
            for at, x in enumerate(batch.column(1).to_pylist()):
                if x is None or any(c is None for c in x):
                    continue
                x = np.floor(scale * np.array(x, dtype=np.float64))
                if np.isfinite(x).all():
                    kept.append(at)
                    dims.append(len(x))
                    out.append(np.clip(x, -(2.0**62), 2.0**62).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(dims, pa.int32()), pa.array(out, pa.binary())],
                names=["vec_id", "dim", "v"],
            )

    picked = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    return picked.mapInArrow(convert, "vec_id long, dim int, v binary")


def matrix(rows: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.int64).reshape(len(rows), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while they are, else in whole numbers, held to a long."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    largest = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if largest < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if largest < 2.0**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -LONG, LONG).astype(np.int64)


def scores_of(queries: pd.DataFrame, candidates: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a unit, and where a query meets itself."""
    same = queries["q_row"].to_numpy()[:, None] == candidates["row"].to_numpy()[None, :]
    return products(matrix(queries["q_v"]), matrix(candidates["v"])), same


def reachable(a: np.ndarray, b: np.ndarray, cutoff: np.ndarray) -> np.ndarray:
    """False where a product surely stays below the query's cutoff."""
    half = a.shape[1] // 2
    head = products(a[:, :half], b[:, :half]).astype(np.float64)
    rest = np.sqrt((a[:, half:].astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(
        (b[:, half:].astype(np.float64) ** 2).sum(axis=1)
    )
    slack = 1e-9 * (np.abs(head) + rest) + 1
    return head + rest + slack >= cutoff[:, None]


def frame(query, cb, best: list) -> pd.DataFrame:
    """Lists of a unit; typed also where there are none."""
    return pd.DataFrame(
        {
            "query": np.asarray(query, dtype=np.int64),
            "cb": np.asarray(cb, dtype=np.int32),
            "best": pd.Series(best, dtype=object),
        }
    )


def _units(queries: DataFrame, vectors: DataFrame, q_blocks: int, c_blocks: int):
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    mine = lambda n, name: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(name)
    # Columns of the left side are made anew: both sides come from one table.
    own = [F.col(c).alias(f"q_{c}") for c in queries.columns]
    left = queries.select(*own, mine(q_blocks, "qb"), each(c_blocks, "cb"))
    right = vectors.select("*", mine(c_blocks, "cb"), each(q_blocks, "qb"))
    return left.groupBy("qb", "cb", "q_dim").cogroup(right.groupBy("qb", "cb", "dim"))


def _merged(lists: DataFrame, blocks: int, top: int, ascending: bool) -> DataFrame:
    """One list per query: the first ``top`` of all its lists, ``MERGE`` blocks at a time."""
    while True:
        blocks = math.ceil(blocks / MERGE)
        best = F.slice(F.sort_array(F.flatten(F.collect_list("best")), ascending), 1, top)
        lists = (
            lists.withColumn("cb", F.floor(F.col("cb") / MERGE).cast("int"))
            .groupBy("query", "cb")
            .agg(best.alias("best"))
        )
        if blocks <= 1:
            return lists.drop("cb")


def top_products(
    rows: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    top: int = TOP,
    scale: int = SCALE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``. ``is_query`` is a condition on ``vec_id``."""
    vectors = cut_lineage(whole_vectors(rows, key, vector, scale).withColumn("row", F.monotonically_increasing_id()))
    queries = vectors.filter(is_query)
    n_queries, n_vectors = queries.count(), vectors.count()
    q_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    c_blocks = max(1, math.ceil(n_vectors / CANDIDATE_BLOCK))

    def gather(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return frame([], [], [])
        scores, same = scores_of(queries, candidates)
        size = min(top, scores.shape[1])
        scores = np.where(same, -LONG - 1, scores)
        best = np.partition(scores, scores.shape[1] - size, axis=1)[:, -size:]
        return frame(queries["q_row"], queries["cb"], [x[x > -LONG - 1] for x in best])

    local = _units(queries, vectors, q_blocks, c_blocks).applyInPandas(gather, "query long, cb int, best array<long>")
    cutoffs = _merged(local, c_blocks, top, False).select(
        F.col("query").alias("row"),
        F.when(F.size("best") >= top, F.element_at("best", -1)).otherwise(F.lit(-LONG)).alias("cutoff"),
    )
    aimed = cut_lineage(queries.join(cutoffs, "row"))

    def resolve(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = [], [], []
        if not len(queries) or not len(candidates):
            return frame(*out)
        candidates = candidates.sort_values(["vec_id", "row"])
        a, b = matrix(queries["q_v"]), matrix(candidates["v"])
        cutoff = queries["q_cutoff"].to_numpy()
        maybe = reachable(a, b, cutoff)
        maybe &= queries["q_row"].to_numpy()[:, None] != candidates["row"].to_numpy()[None, :]
        ids, cb = candidates["vec_id"].to_numpy(), int(queries["cb"].iloc[0])
        for q, row in enumerate(queries["q_row"].to_numpy()):
            near = np.flatnonzero(maybe[q])
            if not len(near):
                continue
            exact = products(a[q : q + 1], b[near])[0]
            keep = np.flatnonzero(exact >= cutoff[q])
            keep = keep[np.argsort(-exact[keep], kind="stable")][:top]  # ties stay in order of id
            if len(keep):
                out[0].append(row)
                out[1].append(cb)
                out[2].append([{"less": int(-exact[k]), "vec_id": int(ids[near[k]])} for k in keep])
        return frame(*out)

    found = _units(aimed, vectors, q_blocks, c_blocks).applyInPandas(
        resolve, "query long, cb int, best array<struct<less:long,vec_id:long>>"
    )
    ranked = _merged(found, c_blocks, top, True).select("query", F.posexplode("best").alias("_at", "_e"))
    return ranked.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select(
        "query_id",
        (F.col("_at") + 1).cast("int").alias("rank"),
        F.col("_e.vec_id").alias("vec_id"),
        (-F.col("_e.less")).alias("score"),
    )
