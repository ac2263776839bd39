"""Spelling variants: words one letter apart, found by pairs of trie nodes.

The words are sorted, and sorted again from their ends. Neighbours in such an order tell which nodes of the trie (of
prefixes, or of suffixes) a word goes through: the first letters it shares with the word before it are nodes of that
word, the others are new. Nodes are numbered range by range of the order; of each range only its first and last word
and the nodes of the last one are carried to the next. A node that a single word goes through meets nothing and is
left out.

Two words differ in one replaced letter exactly if at some position both have the same pair (node before it, node
after it). A word is another one with a letter inserted exactly if its pair around that letter is a pair of the
other one around no letter; of a run of equal letters only the first counts, so each pair of words meets once. So one
shuffle by pairs of integers gives all neighbours and nothing else. The words of one pair around a letter differ in
this letter only, so there are at most as many as letters (90). Within such a group each word takes the number of
the others and the most frequent of them; pairs of words are never listed.

Defined cases: null texts have no words, a null id counts as the empty text; texts are read whole, in blocks cut
between runs; words of any length are taken; repeated rows count each; ties go to the smaller word in code-point order;
forms rise in frequency at least tenfold, so following them ends; an empty table gives an empty table. Other columns
are not read.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import RANGE_ROWS, maybe_broadcast, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import the package

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST = 7, 2  # code points and occurrences of a word
TIMES = 10  # how much more frequent a word's form is
CHANCE = 31  # one in so many runs loses a letter
BLOCK = 1 << 20
HELD = 200_000  # different words that a task sums up before it sends them on

_ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


def runs_of(text: str) -> Counter[str]:
    """How often each run of letters that is long enough occurs, A-Z lower-cased."""
    found: Counter[str] = Counter()
    wanted, gap = re.compile(f"[{LETTERS}]{{{SHORTEST},}}"), re.compile(f"[^{LETTERS}]")
    start = 0
    while start < len(text):
        cut = gap.search(text, start + BLOCK) if start + BLOCK < len(text) else None
        end = cut.start() if cut else len(text)
        found.update(wanted.findall(text, start, end))
        start = end
    out: Counter[str] = Counter()
    for run, n in found.items():
        out[run.translate(_ASCII_LOWER)] += n
    return out


def count_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``word, n`` over all documents; each task sums up what it reads first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"]
            )
            held.clear()
            return out

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(f"{name}:".encode())
                for run, n in runs_of(content).items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % CHANCE == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < SHORTEST:
                            continue
                    held[run] += n
                if len(held) > HELD:
                    yield sent()
        yield sent()

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")), text_of(text))
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST)


# --- numbered tries ---------------------------------------------------------------------------


def shared_start(a: str, b: str) -> int:
    """Number of letters that two words share from their start."""
    if a == b[: len(a)]:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:  # the first half of the rest is shared, or the border lies in it
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def trie_paths(words: list[str], before: str | None, carried: list[int], after: str | None, base: int) -> Iterator[list[int]]:
    """Nodes that sorted words go through, from the root (0) to the last one that another word shares.

    ``carried`` holds the nodes of ``before``, the word ahead of them; new nodes get numbers after ``base``.
    The last word's whole path follows at the end.
    """
    path, last, number = list(carried), before, base
    for k, word in enumerate(words):
        common = 0 if last is None else shared_start(last, word)
        following = words[k + 1] if k + 1 < len(words) else after
        ahead = 0 if following is None else shared_start(word, following)
        path = path[: common + 1] + list(range(number + 1, number + 1 + len(word) - common))
        number += len(word) - common
        yield path[: max(common, ahead) + 1]
        last = word
    yield path


def number_nodes(words: DataFrame, order: str, rows: int, path: str) -> DataFrame:
    """Adds ``path`` (array of node numbers) by the trie of the texts in ``order``, and ``_place``, a rank in its order."""
    ranged = cut_lineage(
        words.repartitionByRange(max(1, math.ceil(rows / RANGE_ROWS)), order).withColumn("_range", F.spark_partition_id())
    )

    def summary(frame: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(frame[order])
        nodes, last = 0, None
        for word in texts:
            nodes += len(word) - (shared_start(last, word) if last is not None else 0)
            last = word
        own = list(trie_paths(texts, None, [0], None, 0))[-1]
        return pd.DataFrame({"r": [int(frame["_range"].iloc[0])], "first": [texts[0]], "last": [last], "own": [own], "nodes": [nodes]})

    kind = "r int, first string, last string, own array<long>, nodes long"
    ends = ranged.select("_range", order).groupBy("_range").applyInPandas(summary, kind).collect()  # one row per range
    ends.sort(key=lambda e: e["first"])
    context, base, before, carried = {}, 0, None, [0]
    for k, e in enumerate(ends):
        after = ends[k + 1]["first"] if k + 1 < len(ends) else None
        context[e["r"]] = (k, before, carried, after, base)
        # A range's own numbers start at 1 and count what it shares with the word before as new.
        common = shared_start(before, e["first"]) if before is not None else 0
        kept = min(common, shared_start(e["first"], e["last"]))
        carried = carried[: kept + 1] + [base + x - common for x in e["own"][kept + 1 :]]
        base += e["nodes"] - common
        before = e["last"]
    sent = words.sparkSession.sparkContext.broadcast(context)  # a few words and paths per range

    def numbered(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order).reset_index(drop=True)
        at, before, carried, after, base = sent.value[int(frame["_range"].iloc[0])]
        paths = list(trie_paths(list(frame[order]), before, carried, after, base))[:-1]
        frame[path] = paths
        frame["_place"] = (at << 40) + np.arange(len(frame), dtype=np.int64)
        return frame.drop(columns="_range")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema) + f", {path} array<long>, _place long"
    return ranged.groupBy("_range").applyInPandas(numbered, schema)


# --- pairs of nodes ---------------------------------------------------------------------------


def node_pairs(words: DataFrame) -> DataFrame:
    """``p, s, kind, id, n``: pairs of shared nodes around no letter (kind 0) and around a letter (2 where it is the
    first of a run of equal letters, else 1)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for i, word, n, fore, back in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size, deep, wide = len(word), len(fore) - 1, len(back) - 1
                around = range(max(0, size - wide), min(size, deep) + 1)
                over = range(max(0, size - 1 - wide), min(size - 1, deep) + 1)
                out[0] += [fore[k] for k in around] + [fore[k] for k in over]
                out[1] += [back[size - k] for k in around] + [back[size - 1 - k] for k in over]
                out[2] += [0] * len(around) + [1 if k and word[k] == word[k - 1] else 2 for k in over]
                out[3] += [i] * (len(around) + len(over))
                out[4] += [n] * (len(around) + len(over))
                if len(out[0]) > 100_000:
                    yield _pairs(out)
                    out = [[], [], [], [], []]
            if out[0]:
                yield _pairs(out)

    return words.select("id", "word", "n", "fore", "back").mapInArrow(listed, "p long, s long, kind int, id long, n long")


def _pairs(out: list[list[int]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["p", "s", "kind", "id", "n"])


def near_in_groups(p: np.ndarray, s: np.ndarray, kind: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """``id, near, form, form_n`` of rows that meet another word; rows of a pair are neighbours, most frequent first."""
    rows = np.arange(len(p))
    new = np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])]
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    never = len(p)
    first_of = lambda m: np.minimum.reduceat(np.where(m, rows, never), starts)[group]
    count_of = lambda m: np.add.reduceat(m.astype(np.int64), starts)[group]
    letter, fresh, whole = kind > 0, kind == 2, kind == 0
    top = first_of(letter)
    second = first_of(letter & (rows != top))
    best = np.where(whole, first_of(fresh), np.where(rows == top, second, top))
    best = np.where(fresh, np.minimum(best, first_of(whole)), best)
    near = np.where(whole, count_of(fresh), count_of(letter) - 1 + np.where(fresh, count_of(whole), 0))
    met = near > 0
    best = best[met]
    return ids[met], near[met], ids[best], n[best]


def neighbours(pairs: DataFrame) -> DataFrame:
    """``id, n_near, form_id, form_n`` of the words that have neighbours; the form is the most frequent one."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            if not len(held[0]):
                continue
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            done = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            if done:
                yield _met([x[:done] for x in held])
                held = [x[done:] for x in held]
        if held and len(held[0]):
            yield _met(held)

    grouped = pairs.repartition("p", "s").sortWithinPartitions("p", "s", F.desc("n"), "id")
    each = grouped.mapInArrow(met, "id long, near long, form long, form_n long")
    best = F.max(F.struct("form_n", (-F.col("form")).alias("back")))
    summed = each.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return summed.select("id", "n_near", (-F.col("b.back")).alias("form_id"), F.col("b.form_n").alias("form_n"))


def _met(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in near_in_groups(*columns)], names=["id", "near", "form", "form_n"])


def follow(links: DataFrame) -> DataFrame:
    """``id, root``: the end of the links ``id, form_id``; each round doubles the links followed."""
    links = cut_lineage(links.select("id", F.col("form_id").alias("root")))
    while True:
        n = links.count()
        onward = links.select(F.col("id").alias("root"), F.col("root").alias("onward"))
        longer = cut_lineage(links.join(maybe_broadcast(onward, n, 40), "root", "left"))
        moved = longer.filter("onward IS NOT NULL").limit(1).count()
        links = longer.select("id", F.coalesce("onward", "root").alias("root"))
        if not moved:
            return links


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``docs``; see the module."""
    counted = cut_lineage(count_words(docs, key, text))
    rows = counted.count()
    fore = number_nodes(counted, "word", rows, "fore").withColumnRenamed("_place", "id")
    fore = cut_lineage(fore)
    back = number_nodes(fore.select("id", F.reverse("word").alias("turned")), "turned", rows, "back")
    both = fore.join(back.select("id", "back"), "id")
    near = cut_lineage(neighbours(node_pairs(both)))
    words = fore.select("id", "word", "n").join(near, "id", "left")
    formed = F.col("form_n") >= TIMES * F.col("n")
    words = cut_lineage(
        words.select(
            "id",
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("form_id")).alias("form_id"),
            F.when(formed, F.col("form_n")).alias("form_n"),
        )
    )
    linked = words.filter("form_id IS NOT NULL").select("id", "form_id")
    roots = follow(linked)
    ends = linked.select("form_id").unionByName(roots.select(F.col("root").alias("form_id"))).distinct()
    names = words.select(F.col("id").alias("form_id"), F.col("word").alias("form")).join(ends, "form_id", "left_semi")
    named = linked.join(names, "form_id").join(
        roots.join(names.select(F.col("form_id").alias("root"), F.col("form").alias("root_word")), "root"), "id"
    )
    return words.join(named.select("id", "form", "root_word"), "id", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
