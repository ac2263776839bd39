"""Toxicity by character n-grams: a linear classifier on naive Bayes log-count ratios.

A text's features are the distinct character n-grams of 3 to 5 characters of its lower-cased form, white
space folded to one blank, hashed to ``2 ** BITS`` places. Spark counts over *all* training rows in how many
toxic and other texts each place occurs. The log of the ratio of the two rates, smoothed in proportion to the
classes and brought ``ERRORS`` standard errors towards 0, so that rare n-grams say nothing, scales the feature
(Wang and Manning, 2012: NB-SVM, here with the logistic loss). The weights of the scaled features are fitted on
at most ``SAMPLE`` rows of each class, those with the smallest digest of their id, by accelerated gradient steps
with an L2 penalty; rows are weighted by the share their class has among all training rows. Ids, languages and
sources never enter a score, and no label of a held-out row is read.

Held out are rows whose ``crc32`` of the id as text is 2 modulo 4. Defined cases: a null id counts as the
empty text (not held out) and has no label; a null label is no label; an id with several labels is toxic if
one of them is; null and empty texts have no features, and so get the score of the intercept; texts of any length
are read whole, in blocks; rows of one id are scored each; without rows of both classes the score is the smoothed
share of toxic rows for every text; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import maybe_broadcast, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import the package

SHORTEST, LONGEST = 3, 5
BITS = 18
SAMPLE = 5000  # rows of each class that weights are fitted on, at most
BLOCK = 1 << 20  # characters of a text that are hashed at a time
ERRORS = 2.0
PENALTY, STEPS = 1e-4, 60
FLAGGED = 0.3


def places(text: str) -> np.ndarray:
    """Places of the distinct n-grams of a text, rising."""
    text = " " + " ".join(text.lower().split()) + " "
    found = []
    for start in range(0, max(1, len(text) - SHORTEST + 1), BLOCK):
        part = text[start : start + BLOCK + LONGEST - 1]
        x = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        rolled, of_block = x + np.uint64(1), []
        for size in range(2, LONGEST + 1):
            if len(x) < size:
                break
            rolled = rolled[:-1] * np.uint64(0x100000001B3) + x[size - 1 :]
            if size >= SHORTEST:
                mixed = (rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
                of_block.append(mixed.astype(np.int32))
        if of_block:
            found.append(_distinct(of_block))
    return _distinct(found) if len(found) > 1 else found[0] if found else np.empty(0, np.int32)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    x = np.sort(np.concatenate(parts))
    return x[np.r_[True, x[1:] != x[:-1]]]


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """``id, text, toxic`` of the labelled rows that are not held out."""
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("toxic"))
    )
    known = cut_lineage(known)
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("text"))
    return rows.join(maybe_broadcast(known, known.count(), 40), "id")


def count_places(rows: DataFrame) -> DataFrame:
    """``place, toxic, other``: how many toxic and other texts have each place; a task sums what it reads first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            for content, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[int(toxic > 0), places(content)] += 1
        at = np.flatnonzero(sums.any(axis=0))
        for start in range(0, len(at), 50_000):
            part = at[start : start + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(sums[1, part]), pa.array(sums[0, part])],
                names=["place", "toxic", "other"],
            )

    counted = rows.select("text", "toxic").mapInArrow(count, "place int, toxic long, other long")
    return counted.groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """``place, ratio`` of the places whose log-count ratio is sure to differ from 0; the others scale to nothing."""
    all_toxic, all_other = counts.agg(F.sum("toxic"), F.sum("other")).first() or (0, 0)
    if not all_toxic or not all_other:
        return counts.select("place", F.lit(0.0).alias("ratio")).limit(0)
    toxic = F.col("toxic") + F.lit(all_toxic / (all_toxic + all_other))
    other = F.col("other") + F.lit(all_other / (all_toxic + all_other))
    ratio = F.log(toxic / other) - F.lit(float(np.log(all_toxic / all_other)))
    sure = F.abs(ratio) - ERRORS * F.sqrt(1 / toxic + 1 / other)
    return counts.select("place", (F.signum(ratio) * sure).alias("ratio"), sure.alias("sure")).filter("sure > 0").drop("sure")


def sampled(rows: DataFrame, limit: int) -> DataFrame:
    """The rows of each class with the smallest digests of their ids, ``limit`` of them or fewer."""
    coded = rows.withColumn("digest", F.xxhash64("id"))
    parts = None
    for toxic in (True, False):
        of_class = coded.filter((F.col("toxic") > 0) == F.lit(toxic))
        last = of_class.select("digest").orderBy("digest").limit(limit).agg(F.max("digest")).first()[0]
        part = of_class.filter(F.col("digest") <= F.lit(last).cast("long"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def fit_logistic(lists: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the places, times their ratios, and the intercept."""
    lengths = np.array([len(x) for x in lists])
    flat = np.concatenate(lists).astype(np.int64)
    if not len(flat):  # no place tells the classes apart
        share = float(weight @ toxic / weight.sum())
        return np.zeros(len(ratios)), float(np.log(share / (1 - share)))
    used, flat = np.unique(flat, return_inverse=True)
    scale = ratios[used]
    owner = np.repeat(np.arange(len(lists)), lengths)
    values = scale[flat]
    weight = weight / weight.sum()
    # The largest curvature is a quarter of that of the weighted squares: a few power iterations find it.
    probe = np.random.default_rng(7).random(len(used))
    for _ in range(12):
        probe /= np.linalg.norm(probe)
        image = np.bincount(owner, values * probe[flat], len(lists)) * weight
        probe = np.bincount(flat, values * image[owner], len(used))
    pace = 1.0 / (0.3 * np.linalg.norm(probe) + 0.25 + PENALTY)
    w, b = np.zeros(len(used)), 0.0
    ahead_w, ahead_b, momentum = w, b, 1.0
    for _ in range(STEPS):
        margin = np.bincount(owner, values * ahead_w[flat], len(lists)) + ahead_b
        slope = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - toxic)
        new_w = ahead_w - pace * (np.bincount(flat, values * slope[owner], len(used)) + PENALTY * ahead_w)
        new_b = ahead_b - pace * slope.sum()
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead_w = new_w + (momentum - 1) / following * (new_w - w)
        ahead_b = new_b + (momentum - 1) / following * (new_b - b)
        w, b, momentum = new_w, new_b, following
    out = np.zeros(len(ratios))
    out[used] = w * scale
    return out, b


def fit(rows: DataFrame, limit: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weight of each place and the intercept, from ``training_rows``."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_other:
        share = (n_toxic + 0.1) / (n_toxic + n_other + 1)
        return np.zeros(1 << BITS), float(np.log(share / (1 - share)))
    ratios = np.zeros(1 << BITS)
    found = log_ratios(cut_lineage(count_places(rows))).toPandas()  # at most 2 ** BITS rows
    ratios[found["place"].to_numpy()] = found["ratio"].to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(ratios)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [places(x) for x in batch.column(0).to_pylist()]
            lists = [x[sent.value[x] != 0] for x in lists]
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, type=pa.list_(pa.int32())), batch.column(1), batch.column(2)],
                names=["places", "toxic", "digest"],
            )

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("digest", kind="stable")
        toxic = (frame["toxic"].to_numpy() > 0).astype(np.float64)
        share = np.where(toxic > 0, n_toxic / toxic.sum(), n_other / (1 - toxic).sum())
        w, b = fit_logistic(list(frame["places"]), toxic, share, sent.value)
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": np.r_[-1, at], "weight": np.r_[b, w[at]]})

    sample = sampled(rows, limit).select("text", "toxic", "digest")
    learnt = sample.mapInArrow(features, "places array<int>, toxic int, digest long")
    out = learnt.groupBy().applyInPandas(fitted, "place long, weight double").toPandas()
    weights, at = np.zeros(1 << BITS), out["place"].to_numpy()
    weights[at[at >= 0]] = out["weight"].to_numpy()[at >= 0]
    sent.unpersist()
    return weights, float(out["weight"][at < 0].iloc[0])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = SAMPLE
) -> DataFrame:
    """``key, held_out, score`` of each row of ``docs``; see the module for the method."""
    weights, intercept = fit(training_rows(docs, labels, key, text, label), limit)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = np.array([sent.value[places(x)].sum() for x in batch.column(2).to_pylist()]) + intercept
            score = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, type=pa.float64())], names=[key, "held_out", "score"]
            )

    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(key, held_out(key).alias("held_out"), text_of(text).alias("text"))
    return picked.mapInArrow(scored, f"`{key}` {kind}, held_out boolean, score double")
