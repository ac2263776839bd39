"""Quality rules with an n-gram perplexity band per language.

A character 5-gram model of each language is counted by Spark over all documents and smoothed by
modified Kneser-Ney (Chen and Goodman, 1998): discounts from counts of counts, lower orders from
continuation counts. A task finds the 5-grams of its documents in an array sorted by a 64-bit hash of
language and n-gram; from there, places lead to the shorter n-grams and to the contexts. A document is
scored on the counts of all other texts: its own n-grams are taken out at every size, those of the
lower sizes where it alone supports them. Only the discounts and the number of letters are those of
the whole language.

What is broadcast is the list of 5-grams and their counts, from which each Python worker builds the
shorter sizes once; it stays under ``MODEL_BYTES`` when built. A larger model is joined: every chunk of
``CHUNK_ROWS`` documents asks once for its distinct 5-grams and gets their part of the model.

The median and the median deviation of the log-perplexity of each language set a lower and an
upper band; for short documents the band is wider by the sampling error of a mean of so many
characters. Outside the band a document is unlike its language (too high) or a loop of the same
text and symbols (too low).

An n-gram is packed into a long, 12 bits per character. Characters from U+0800 on share the upper
2048 symbols.

Defined cases: a null or empty text has no words and fails; a null language is a language of its
own; fewer than five characters have no perplexity and are judged by the rules alone; equal texts
of a language are judged each but count once in its model and medians; an empty table gives an
empty table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import mark_first, maybe_broadcast, text_of, with_row_id

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import the package

ORDER = 5
BITS = 12
MODEL_BYTES = 192 << 20  # a larger model, as built in a worker, is joined to chunks instead of broadcast
GRAM_BYTES = 48  # of a built model for each 5-gram, shorter sizes included
CHUNK_ROWS = 4000
LOWER_WIDTH, UPPER_WIDTH = 4.0, 8.0  # deviations from the median; mixed languages are high but sound
BIN = 1e-4  # resolution of medians
SYMBOLS = "#*$%&|<>"  # fixed values
MERGE_ROWS = 1_500_000


# --- counting ---------------------------------------------------------------------------------


def packed(text: str) -> np.ndarray:
    """All n-grams of a text, each packed into one number."""
    x = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if len(x) < ORDER:
        return np.empty(0, dtype=np.int64)
    x = np.where(x < 2048, x, 2048 + (x & 2047)).astype(np.int64)
    out = x[: len(x) - ORDER + 1]
    for k in range(1, ORDER):
        out = (out << BITS) | x[k : len(x) - ORDER + 1 + k]
    return out


def _fold(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams[starts], np.add.reduceat(counts, starts)


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, gram, n`` over all documents; each task sums up what it reads first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def settle(name: str) -> None:
            raw = [p for p in held[name] if p[1] is None]
            grams, n = np.unique(np.concatenate([p[0] for p in raw]), return_counts=True)
            held[name] = [_fold([p for p in held[name] if p[1] is not None] + [(grams, n)])]

        waiting: dict[str, int] = {}
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = packed(content)
                if len(grams):
                    held.setdefault(name, []).append((grams, None))
                    waiting[name] = waiting.get(name, 0) + len(grams)
                    if waiting[name] > MERGE_ROWS:
                        settle(name)
                        waiting[name] = 0
        for name in held:
            if waiting[name]:
                settle(name)
            grams, n = held[name][0]
            for at in range(0, len(grams), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams[part])), pa.array(grams[part]), pa.array(n[part].astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

    rows = docs.select(language(F.col(lang)).alias("lang"), text_of(text).alias("text"))
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("\x00none"))


# --- smoothing --------------------------------------------------------------------------------


def count_levels(counts: DataFrame) -> tuple[dict[int, DataFrame], DataFrame]:
    """``lang, gram, n`` of each size, continuation counts below the largest, and ``lang, _v`` of letters."""
    levels = {ORDER: cut_lineage(counts)}
    for size in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (BITS * size)) - 1))
        longer = levels[size + 1]
        levels[size] = cut_lineage(
            longer.groupBy("lang", suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        )
    return levels, cut_lineage(levels[1].groupBy("lang").agg(F.count(F.lit(1)).alias("_v")))


def discounts(level: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3``: what n-grams seen once, twice or more often give away."""
    seen = lambda k: F.count(F.when(F.col("n") == k, 1)).cast("double")
    rates = level.groupBy("lang").agg(*[seen(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
    step = lambda k: k - F.try_divide((k + 1) * y * F.col(f"n{k + 1}"), F.col(f"n{k}"))
    # Counts of counts of a small corpus can leave the range in which a discount makes sense.
    held = lambda k: F.least(F.lit(0.95 * k), F.greatest(F.lit(0.1), F.coalesce(step(k), F.lit(0.5 * k))))
    return rates.select("lang", *[held(k).alias(f"d{k}") for k in (1, 2, 3)])


def context_totals(level: DataFrame, rates: DataFrame, n_langs: int) -> DataFrame:
    """``lang, context, total, spare``: counts after a context and what they give away."""
    kinds = lambda m: F.count(F.when(m, 1))
    found = level.groupBy("lang", F.shiftright("gram", BITS).alias("context")).agg(
        F.sum("n").alias("total"),
        *[kinds(m).alias(f"k{k}") for k, m in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") > 2))],
    )
    spare = F.col("k1") * F.col("d1") + F.col("k2") * F.col("d2") + F.col("k3") * F.col("d3")
    return found.join(maybe_broadcast(rates, n_langs, 64), "lang").select("lang", "context", "total", spare.alias("spare"))


@dataclass
class Model:
    """Counts of n-grams by size, discounts by size and numbers of letters; all rows name their language."""

    levels: dict[int, DataFrame]
    rates: dict[int, DataFrame]
    letters: DataFrame

    def widened(self) -> DataFrame:
        """``lang, gram, n5, t5, s5, ...``: each 5-gram with the counts of its ends and of their contexts."""
        n_langs = self.letters.count()
        whole = None
        for size, level in sorted(self.levels.items()):
            totals = context_totals(level, self.rates[size], n_langs).withColumnsRenamed({"total": f"t{size}", "spare": f"s{size}"})
            level = level.withColumn("context", F.shiftright("gram", BITS)).withColumnRenamed("n", f"n{size}")
            level = level.join(totals, ["lang", "context"]).drop("context")
            if whole is not None:
                level = level.withColumn("_end", F.col("gram").bitwiseAND(F.lit((1 << (BITS * (size - 1))) - 1)))
                level = level.join(whole.withColumnRenamed("gram", "_end"), ["lang", "_end"]).drop("_end")
            whole = cut_lineage(level)
        return whole


def count_model(counts: DataFrame) -> Model:
    """All that is needed to smooth with any one text held out."""
    levels, letters = count_levels(counts)
    return Model(levels, {size: cut_lineage(discounts(level)) for size, level in levels.items()}, letters)


# --- sorted hash arrays -----------------------------------------------------------------------


def gram_hash(seeds: np.ndarray | np.uint64, grams: np.ndarray) -> np.ndarray:
    x = grams.astype(np.uint64) + seeds
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class SortedHashes:
    """Sorted hashes with an index of their leading bits, so a lookup is a few array steps."""

    def __init__(self, hashes: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], order.astype(np.int32)
        self.shift = np.uint64(64 - max(1, int(len(hashes)).bit_length()))
        heads = (self.hashes >> self.shift).astype(np.int64)
        self.first = np.searchsorted(heads, np.arange((1 << (64 - int(self.shift))) + 1))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each hash among those given at first, or -1."""
        head = (wanted >> self.shift).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        out = np.full(len(wanted), -1, dtype=np.int64)
        open_rows = np.flatnonzero(at < end)
        at, end = at[open_rows], end[open_rows]
        while len(open_rows):
            hit = self.hashes[at] == wanted[open_rows]
            out[open_rows[hit]] = self.rows[at[hit]]
            at = at + 1
            go = ~hit & (at < end)
            open_rows, at, end = open_rows[go], at[go], end[go]
        return out


def by_last(grams: np.ndarray) -> np.ndarray:
    """Packed n-grams with their characters in reverse, so that equal ends are neighbours."""
    out = np.zeros_like(grams)
    for k in range(ORDER):
        out = (out << BITS) | ((grams >> (BITS * k)) & ((1 << BITS) - 1))
    return out


def _starts(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _groups(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's (code, value), and a row of each number."""
    order = np.lexsort((values, codes))
    new = _starts(codes[order]) | _starts(values[order])
    number = np.empty(len(order), dtype=np.int32)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _fitting(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if not len(x) or x.max() < 2**31 else x.astype(np.int64)


class HeldOutCounts:
    """Counts of all n-grams; a text is smoothed and scored on what all others leave of them.

    Made of the 5-grams of some languages (numbers into ``langs``), the discounts of each size and
    language and the numbers of letters. ``wide`` holds, where only a part of the 5-grams is given,
    what the rest adds: a count, a context's total and its spare mass for every size and row.
    """

    def __init__(
        self,
        langs: list[str],
        codes: np.ndarray,
        grams: np.ndarray,
        n: np.ndarray,
        rates: dict[int, np.ndarray],
        letters: np.ndarray,
        wide: dict[str, np.ndarray] | None = None,
    ) -> None:
        self.langs, self.codes, self.grams, self.n = langs, codes, grams, n
        self.rates, self.letters, self.wide = rates, letters, wide
        self.levels: dict[int, tuple] = {}
        self.whole: dict[int, np.ndarray] = {}  # probabilities of shorter n-grams where nothing is held out

    def ready(self) -> HeldOutCounts:
        """Builds the arrays, once in a worker.

        Each size has the count, the context and the n-gram one size shorter of each of its n-grams, and
        the total and spare mass of each context. N-grams are in the order of their last characters, so
        that those with one end are neighbours.
        """
        if self.levels:
            return self
        import xxhash

        self.number = {lang: k for k, lang in enumerate(self.langs)}
        self.seeds = np.array([xxhash.xxh64_intdigest(lang) for lang in self.langs], dtype=np.uint64)
        order = np.lexsort((by_last(self.grams), self.codes))
        codes, grams, n = self.codes[order], self.grams[order], self.n[order].astype(np.int64)
        self.index = SortedHashes(gram_hash(self.seeds[codes], grams))
        picked = order  # a given row for each n-gram of the size
        language_of = {}
        for size in range(ORDER, 0, -1):
            language_of[size] = codes
            context, one = _groups(codes, grams >> BITS)
            if self.wide:
                n = self.wide[f"n{size}"][picked]
                total, spare = self.wide[f"t{size}"][picked][one], self.wide[f"s{size}"][picked][one]
            else:
                total = np.bincount(context, n)
                spare = np.bincount(context, self.rates[size][codes, np.minimum(n, 3)])
            ends = grams & ((1 << (BITS * (size - 1))) - 1)
            new = _starts(codes) | _starts(ends) if size > 1 else np.ones(0, dtype=bool)
            up = (np.cumsum(new) - 1).astype(np.int32)
            self.levels[size] = (_fitting(n), context, up, total.astype(np.float64), spare, (np.zeros(len(total)), np.zeros(len(total))))
            if size > 1:
                codes, grams, picked = codes[new], ends[new], picked[new]
                n = np.bincount(up)
        lower: np.ndarray | None = None
        for size in range(1, ORDER):
            ns, context, up, total, spare, _ = self.levels[size]
            code = language_of[size]
            base = 1 / self.letters[code] if lower is None else lower[up]
            lower = (ns - self.rates[size][code, np.minimum(ns, 3)]) / total[context] + spare[context] / total[context] * base
            self.whole[size] = lower
        self.codes = self.grams = self.n = self.wide = None
        return self

    def score(self, lang: str, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log-probability of each of a text's distinct n-grams, given sorted and with their counts.

        All of them must have been counted. From the largest size down, ``taken`` is what the text
        holds of each count: its sightings, then the longer n-grams that end so and no other text has.
        """
        code, steps = self.number[lang], []
        row = self.index.find(gram_hash(self.seeds[code], grams))
        order = np.argsort(row)
        row, taken = row[order], counts[order]
        for size in range(ORDER, 0, -1):
            if size < ORDER and not taken.any():  # nor is anything taken from the sizes below
                p = self.whole[size][row]
                break
            ns, contexts, ups, totals, spares, less = self.levels[size]
            rates = self.rates[size][code]
            n, context = ns[row], contexts[row]
            left = n - taken
            cut = rates[np.minimum(left, 3)]
            total, spare = totals[context], spares[context]
            changed = taken.nonzero()[0]
            if len(changed):  # what the text itself gives its contexts
                at = context[changed]
                freed = rates[np.minimum(n[changed], 3)] - cut[changed]
                np.add.at(less[0], at, taken[changed].astype(np.float64))
                total -= less[0][context]
                less[0][at] = 0.0
                some = freed.nonzero()[0]
                if len(some):
                    at = at[some]
                    np.add.at(less[1], at, freed[some])
                    spare -= less[1][context]
                    less[1][at] = 0.0
            alone = (total < 0.5).nonzero()[0]  # no other text has the context: the shorter one decides
            total[alone] = 1.0
            own, weight = (left - cut) / total, spare / total
            own[alone], weight[alone] = 0.0, 1.0
            if size == 1:
                p = own + weight / self.letters[code]
                break
            up = ups[row]
            new = _starts(up)
            first = new.nonzero()[0]
            steps.append((own, weight, np.cumsum(new) - 1))
            gone = left == 0
            row, taken = up[first], np.add.reduceat(gone.astype(np.int64), first) if gone.any() else np.zeros(len(first), np.int64)
        for own, weight, at in reversed(steps):
            p = own + weight * p[at]
        out = np.empty(len(p))
        out[order] = np.log(p)
        return out

    def sums(self, lang: str, grams: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
        """Sums of the log-probabilities and of their squares over a text."""
        if not len(grams):
            return 0.0, 0.0
        p = self.score(lang, grams, counts)
        weighted = counts * p
        return float(weighted.sum()), float((weighted * p).sum())


# --- rules ------------------------------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that are found twice or more."""
    n = len(words) - 4
    if n < 2 or len(set(zip(*(words[k:] for k in range(5)), strict=False))) == n:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, k) for k, w in enumerate(words)], dtype=np.int64)
    rank = ids
    for step in (1, 2):  # windows of 2, then of 4 words, named by rank: exact, no hashing
        length = len(rank) - step
        rank = np.unique(rank[:length] * np.int64(len(words) + 1) + rank[step : step + length], return_inverse=True)[1]
    rank = rank[:n] * np.int64(len(words) + 1) + ids[4:]
    _, back, count = np.unique(rank, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[back] > 1)
    if not len(starts):
        return 0
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + 5, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_rules(text: str) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines and repeated words of a text."""
    coded = text.encode()
    words = coded.split()  # bytes split at exactly the six white-space characters
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.encode().split():
            seen.add(line)
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), again, repeated_words(words)


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def language_rows(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``doc_id, file, at, lang, counted, text``; one row of equal texts of a language is counted."""
    picked = docs.select(
        F.col(key).alias("doc_id"), language(F.col(lang)).alias("lang"), text_of(text).alias("text")
    )
    marked = mark_first(with_row_id(picked), ["lang"], "text", "counted")
    return marked.select("doc_id", "_row.file", "_row.at", "lang", "counted", "text")


def distinct_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed n-grams of a text, rising, and their counts."""
    grams = np.sort(packed(text))
    if not len(grams):
        return grams, grams
    first = np.flatnonzero(_starts(grams))
    return grams[first], np.diff(np.r_[first, len(grams)])


MEASURES = [*[(c, "long") for c in (*RULES, "n_scored")], ("logp", "double"), ("logp2", "double")]


def _measures(held: HeldOutCounts | None, langs: list[str], texts: list[str]) -> list[pa.Array]:
    """Columns of rules and of log-probability sums."""
    rules, sums = [], []
    for lang, text in zip(langs, texts, strict=True):
        grams, n = distinct_grams(text)
        rules.append((*text_rules(text), int(n.sum())))
        sums.append(held.sums(lang, grams, n) if len(grams) else (0.0, 0.0))
    both = [np.array(rules, dtype=np.int64).reshape(-1, 6), np.array(sums, dtype=np.float64).reshape(-1, 2)]
    return [pa.array(np.ascontiguousarray(c)) for x in both for c in x.T]


def measure_documents(rows: DataFrame, model: Model, bound: int = MODEL_BYTES) -> DataFrame:
    """Rules and log-probability sums of each row of ``language_rows``."""
    letters = sorted((r["lang"], r["_v"]) for r in model.letters.collect())  # one row per language
    langs = [lang for lang, _ in letters]
    number = {lang: k for k, lang in enumerate(langs)}
    rates = {size: np.zeros((len(langs), 4)) for size in model.rates}
    for size, found in model.rates.items():
        for r in found.collect():
            rates[size][number[r["lang"]]] = (0.0, r["d1"], r["d2"], r["d3"])
    n_letters = np.array([n for _, n in letters], dtype=np.float64)
    head = rows.drop("text").columns
    schema = T.StructType([*rows.drop("text").schema.fields])
    for name, kind in MEASURES:
        schema = schema.add(name, kind)
    if model.levels[ORDER].count() * GRAM_BYTES <= bound:
        return cut_lineage(_measured_by_broadcast(rows, model, langs, number, rates, n_letters, head, schema))
    return cut_lineage(_measured_by_chunks(rows, model, rates, n_letters, number, head, schema))


def _measured_by_broadcast(rows, model, langs, number, rates, n_letters, head, schema) -> DataFrame:
    spark = rows.sparkSession
    codes = spark.createDataFrame(list(number.items()), "lang string, code int")
    listed = model.levels[ORDER].join(F.broadcast(codes), "lang").select("code", "gram", "n").toArrow()  # under the bound
    columns = [listed.column(k).to_numpy() for k in range(3)]
    del listed
    sent = spark.sparkContext.broadcast(HeldOutCounts(langs, *columns[:2], _fitting(columns[2]), rates, n_letters))
    del columns

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = sent.value.ready()
            found = _measures(held, batch.column(3).to_pylist(), batch.column(5).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), *found], names=schema.names)

    return rows.mapInArrow(measured, schema)


def _measured_by_chunks(rows, model, rates, n_letters, number, head, schema) -> DataFrame:
    chunked = rows.withColumn("chunk", F.floor(F.col("at") / CHUNK_ROWS).cast("long"))
    kept = [k for k, name in enumerate(rows.columns) if name in head]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            for file, chunk, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = held.setdefault((file, chunk, lang), [])
                parts.append(distinct_grams(text)[0])
                if sum(map(len, parts)) > MERGE_ROWS:
                    parts[:] = [_merged(parts)]
        for (file, chunk, lang), parts in held.items():
            grams = _merged(parts)
            for start in range(0, len(grams), 100_000):
                part = grams[start : start + 100_000]
                same = [pa.array([v] * len(part)) for v in (file, chunk, lang)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(part)], names=["file", "chunk", "lang", "gram"])

    wanted = chunked.select("file", "chunk", "lang", "text").mapInArrow(asked, "file long, chunk long, lang string, gram long")
    parts = wanted.distinct().join(model.widened(), ["lang", "gram"])

    def measured(left: pa.Table, right: pa.Table) -> pa.Table:
        langs = sorted(set(right.column("lang").to_pylist()))
        code = {lang: k for k, lang in enumerate(langs)}
        codes = np.array([code[x] for x in right.column("lang").to_pylist()], dtype=np.int32)
        own = [number[lang] for lang in langs]
        wide = {f"{c}{size}": right.column(f"{c}{size}").to_numpy() for c in "nts" for size in range(1, ORDER + 1)}
        grams = right.column("gram").to_numpy()
        share = {size: x[own] for size, x in rates.items()}
        held = HeldOutCounts(langs, codes, grams, wide[f"n{ORDER}"], share, n_letters[own], wide).ready() if langs else None
        found = _measures(held, left.column("lang").to_pylist(), left.column("text").to_pylist())
        return pa.Table.from_arrays([*(left.column(k) for k in kept), *found], names=schema.names)

    by_chunk = chunked.groupBy("file", "chunk").cogroup(parts.groupBy("file", "chunk"))
    return by_chunk.applyInArrow(measured, schema)


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    x = np.sort(np.concatenate(parts))
    return x[_starts(x)] if len(x) else x


def _median(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Lower median per language, from counts of values rounded to ``BIN``."""
    bins = rows.groupBy("lang", F.round(value / BIN).cast("long").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("lang").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("lang")
    reached = bins.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(whole))
    return reached.filter(F.col("_upto") * 2 >= F.col("_all")).groupBy("lang").agg((F.min("_bin") * BIN).alias(name))


def perplexity_bands(measured: DataFrame) -> DataFrame:
    """``lang, middle, spread, noise`` of the log-perplexity of each language's distinct texts."""
    scored = measured.filter("counted AND n_scored > 0 AND n_words >= 10").withColumn("_x", -F.try_divide("logp", "n_scored"))
    middle = cut_lineage(_median(scored, F.col("_x"), "middle"))
    spread = _median(scored.join(F.broadcast(middle), "lang"), F.abs(F.col("_x") - F.col("middle")), "spread")
    square = F.try_divide("logp2", "n_scored") - F.pow(F.col("_x"), F.lit(2))
    noise = _median(scored, square, "noise")
    return cut_lineage(middle.join(F.broadcast(spread), "lang").join(F.broadcast(noise), "lang"))  # one row per language


def judge_quality(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    lower: float = LOWER_WIDTH,
    upper: float = UPPER_WIDTH,
) -> DataFrame:
    """Rules, perplexity, bands, ``base_failed`` and ``kept`` of each row (``file, at``)."""
    rows = language_rows(docs, key, text, lang)
    model = count_model(count_grams(rows.filter("counted")))
    measured = measure_documents(rows, model)
    bands = perplexity_bands(measured)
    x = -F.try_divide("logp", "n_scored")
    error = F.try_divide("noise", "n_scored")
    room = F.sqrt(F.pow(1.4826 * F.col("spread"), F.lit(2)) + error)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    outside = (x < F.col("middle") - lower * room) | (x > F.col("middle") + upper * room)
    return measured.join(F.broadcast(bands), "lang", "left").select(  # one row per language
        "doc_id",
        "file",
        "at",
        *RULES,
        F.exp(x).alias("perplexity"),
        F.exp(F.col("middle") - lower * room).alias("lower_band"),
        F.exp(F.col("middle") + upper * room).alias("upper_band"),
        failed.alias("base_failed"),
        (~failed & ~F.coalesce(outside, F.lit(False))).alias("kept"),
    )
