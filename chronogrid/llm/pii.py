"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole spans.

Text around digits and at-signs is cut into units (runs of digits, runs of letters, single
characters). A segment of at most ``MAX_UNITS`` units gets a score for each kind from features
of the whole span: its separators, digit groups, check sum, octets, domain and surroundings. A
dynamic program over bounded segments chooses boundaries and kinds together (Sarawagi and Cohen,
2004). Text without a digit or at-sign can't be part of a segment, so the program skips it
without changing the result.

The weights maximise the conditional likelihood of the pattern matches in at most
``SAMPLE_WINDOWS`` stretches of text, those with the smallest digest, by gradients from the
forward-backward recursion. Matches of the patterns are always reported; the model adds spans
where they found nothing.

Defined cases: a null or empty text has no spans; equal texts have equal spans; a sample without
a kind leaves the kind to its pattern; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import math
import re
import sys
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import the package

KINDS = ("email", "ip", "card", "phone")
SAMPLE_WINDOWS = 1500  # bound of the sample the weights are fitted on
MAX_UNITS, MAX_CHARS = 20, 80
EPOCHS, RATE, DECAY = 8, 0.3, 1e-4
Span = tuple[int, int, int]  # kind, start, end

# The patterns. Possessive digits keep long runs linear without changing matches.
DIGITS = frozenset("0123456789")  # other scripts have digits too; the patterns know these
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]+")
UNIT = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def octet(digits: str) -> bool:
    """At most 255, however many zeros lead it."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at-sign outwards, so long runs stay linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def pattern_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then start."""
    out: list[Span] = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    if TRIGGER.search(text):
        for m in ADDRESS.finditer(text):
            if all(octet(p) for p in m.group().split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = digits_of(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        for m in PHONE.finditer(text):
            if 8 <= len(digits_of(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


# --- the lattice ------------------------------------------------------------------------------


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of white-space separated chunks that all hold a digit or at-sign."""
    done = 0
    for m in TRIGGER.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while True:
            while end < len(text) and not text[end].isspace():
                end += 1
            after = end + 1
            if after >= len(text) or text[after].isspace():
                break
            stop = after
            while stop < len(text) and not text[stop].isspace():
                stop += 1
            if not TRIGGER.search(text, after, stop):
                break
            end = stop
        yield start, end
        done = end


def side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "none"
    c = text[at]
    return "digit" if c in DIGITS else "letter" if c.isalpha() else "space" if c.isspace() else c


def span_features(text: str, start: int, end: int) -> tuple[list[str], tuple[int, ...]]:
    """Features of a whole span, and the kinds it may be of."""
    span = text[start:end]
    around = [f"before={side(text, start - 1)}", f"after={side(text, end)}"]
    if "@" in span:
        local, _, domain = span.rpartition("@")
        labels = domain.split(".")
        tail = labels[-1]
        return [
            "bias",
            *around,
            f"ats={min(3, span.count('@'))}",
            f"local={'none' if not local else 'clean' if all(c in LOCAL for c in local) else 'odd'}",
            f"labels={min(4, len(labels))}",
            f"empty={any(not x for x in labels)}",
            f"tail={'letters' if tail.isalpha() else 'other'}",
            f"blank={any(c.isspace() for c in span)}",
            f"first={span[0].isalnum()}",
        ], (0,)
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    marks = "".join(sorted(set(re.sub(r"[0-9]", "", span)))).replace(" ", "_")
    features = [
        "bias",
        *around,
        f"digits={min(20, len(digits))}",
        f"marks={marks}",
        f"groups={min(6, len(groups))}",
        f"luhn={len(digits) >= 12 and luhn(digits)}",
        f"octets={len(groups) == 4 and marks == '.' and all(len(g) <= 3 and octet(g) for g in groups)}",
        f"plus={span[0]}" if span[0] in "+(" else "plus=",
        f"longest={min(20, max(map(len, groups)))}",
    ]
    return features, (1, 2, 3)


Candidate = tuple[int, int, int, list[str]]  # first unit, past the last unit, kind, features


def lattice(text: str, start: int, end: int) -> tuple[list[int], list[list[Candidate]]]:
    """Unit bounds of a window, and the candidate segments that end at each bound."""
    bounds = [start]
    for m in UNIT.finditer(text, start, end):
        bounds.append(m.end())
    n = len(bounds) - 1
    ending: list[list[Candidate]] = [[] for _ in range(n + 1)]
    for i in range(n):
        head = text[bounds[i]]
        if not (head.isalnum() or head in "+(_.%-") or head == " ":
            continue
        letters = at = triggered = False
        for j in range(i + 1, min(n, i + MAX_UNITS) + 1):
            unit = text[bounds[j - 1] : bounds[j]]
            if bounds[j] - bounds[i] > MAX_CHARS:
                break
            at |= unit == "@"
            letters |= unit[0].isalpha()
            triggered |= unit == "@" or unit[0] in DIGITS
            if not triggered or (letters and not at) or not unit[-1].isalnum():
                continue
            if at and head in "+(":
                continue
            features, kinds = span_features(text, bounds[i], bounds[j])
            ending[j] += [(i, j, k, features) for k in kinds]
    return bounds, ending


Weights = dict[tuple[int, str], float]


def score(weights: Weights, candidate: Candidate) -> float:
    kind = candidate[2]
    return sum(weights.get((kind, f), 0.0) for f in candidate[3])


def decode(weights: Weights, text: str, start: int, end: int) -> list[Span]:
    """Boundaries and kinds with the highest joint score; ties go to no span."""
    bounds, ending = lattice(text, start, end)
    best, back = [0.0], [None]
    for j in range(1, len(bounds)):
        value, choice = best[j - 1], None
        for c in ending[j]:
            if (v := best[c[0]] + score(weights, c)) > value + 1e-9:
                value, choice = v, c
        best.append(value)
        back.append(choice)
    out, j = [], len(bounds) - 1
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            out.append((back[j][2], bounds[back[j][0]], bounds[j]))
            j = back[j][0]
    return out[::-1]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def fit(samples: list[str]) -> Weights:
    """Weights by stochastic gradient ascent of the conditional likelihood."""
    prepared = []
    for text in samples:
        gold = set(pattern_spans(text))
        for start, end in windows(text):
            bounds, ending = lattice(text, start, end)
            flat = [c for cs in ending for c in cs]
            true = {i for i, c in enumerate(flat) if (c[2], bounds[c[0]], bounds[c[1]]) in gold}
            if flat:
                prepared.append((len(bounds), ending, flat, true))
    weights: Weights = defaultdict(float)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for n, ending, flat, true in prepared:
            scores = [score(weights, c) for c in flat]
            ahead, number = [0.0] * n, 0
            for j in range(1, n):
                ahead[j] = ahead[j - 1]
                for c in ending[j]:
                    ahead[j] = _add(ahead[j], ahead[c[0]] + scores[number])
                    number += 1
            behind = [-math.inf] * n
            behind[-1] = 0.0
            number = len(flat)
            for j in range(n - 1, 0, -1):
                behind[j - 1] = _add(behind[j - 1], behind[j])
                for c in reversed(ending[j]):
                    number -= 1
                    behind[c[0]] = _add(behind[c[0]], behind[j] + scores[number])
            for k, c in enumerate(flat):
                chance = math.exp(min(0.0, ahead[c[0]] + scores[k] + behind[c[1]] - ahead[-1]))
                step = rate * ((k in true) - chance)
                if abs(step) > 1e-6:
                    for f in c[3]:
                        weights[c[2], f] += step - rate * DECAY * weights[c[2], f]
    return dict(weights)


# --- jobs -------------------------------------------------------------------------------------


def training_windows(docs: DataFrame, text: str = "text", limit: int = SAMPLE_WINDOWS) -> list[str]:
    """The bounded sample: stretches of text around windows, in the order of their digests."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column(0).to_pylist():
                out += [content[max(0, a - 12) : b + 12] for a, b in windows(content) if b - a <= 4 * MAX_CHARS]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["stretch"])

    found = docs.select(text_of(text).alias("text")).mapInArrow(cut, "stretch string")
    first = cut_lineage(found.orderBy(F.xxhash64("stretch"), "stretch").limit(limit))
    return sorted(r["stretch"] for r in first.collect())


def all_spans(text: str, weights: Weights) -> tuple[list[Span], list[Span]]:
    """Pattern spans, and those with the model's further spans."""
    base = pattern_spans(text)
    if not TRIGGER.search(text):
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    more = []
    for start, end in windows(text):
        if any(a <= start and end <= b for a, b in taken):
            continue
        more += [s for s in decode(weights, text, start, end) if all(s[2] <= a or b <= s[1] for a, b in taken)]
    return base, sorted(base + more)


def find_personal_data(
    docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Weights | None = None
) -> DataFrame:
    """``doc_id, base, spans`` of each row; both are lists of ``kind, start, end``."""
    if weights is None:
        weights = fit(training_windows(docs, text))
    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    span = T.ArrayType(
        T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType())
    )
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def named(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t, weights) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([named(f[i]) for f in found], arrow) for i in (0, 1)]],
                names=["doc_id", "base", "spans"],
            )

    return rows.mapInArrow(search, rows.select("doc_id").schema.add("base", span).add("spans", span))
