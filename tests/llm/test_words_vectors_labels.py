"""Spelling variants, whitening and toxicity against plain code."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from chronogrid.llm import pii, spelling, style_tree, toxicity, whitening
from chronogrid.llm.queries import QUERIES

from .conftest import documents, embeddings

LOWER = {k: k + 32 for k in range(65, 91)}


def plain_variants(docs):
    """Words, forms and roots by looking at every word with one letter left out."""
    count = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    count = {w: n for w, n in count.items() if n > 1}
    holed = collections.defaultdict(set)
    for w in count:
        for k in range(len(w)):
            holed[w[:k], w[k + 1 :]].add(w)
    near, form = {}, {}
    for w in count:
        found = {v for k in range(len(w)) for v in holed[w[:k], w[k + 1 :]]}
        found |= {v for k in range(len(w)) if (v := w[:k] + w[k + 1 :]) in count}
        found |= {v for k in range(len(w) + 1) for v in holed.get((w[:k], w[k:]), ())}
        near[w] = found - {w}
        if near[w] and count[best := min(near[w], key=lambda v: (-count[v], v))] >= 10 * count[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), count.get(form.get(w))) for w, n in count.items()}


def rows_of(spark, docs):
    frame = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_variants_of_messy_documents(result):
    got = [tuple(r) for r in result("op11_trie_pairs")]
    assert len(got) == len(set(got)) and set(got) == plain_variants([(i, t) for i, t, _, _ in documents()])


@pytest.mark.parametrize("range_rows", [5, 40, 100_000])
def test_variants_of_random_words(spark, monkeypatch, range_rows):
    monkeypatch.setattr(spelling, "RANGE_ROWS", range_rows)
    draw = np.random.default_rng(range_rows)
    words = ["".join("abÿ"[k] for k in draw.integers(0, 3, draw.integers(6, 10))) for _ in range(300)]
    often = ["aaaaaaab", "abababab", "bbbbbbb"]
    docs = [(k, " ".join([*draw.choice(words, 40), *often[: 1 + k % 3] * (1 + 4 * (k % 3))])) for k in range(60)]
    docs += [(None, "Aaaaaaab aaaaaaaab"), (3, None), (3, ""), (7, "x" * 3000 + " " + "x" * 2999 + "y " + "x" * 2999), (8, docs[7][1])]
    docs += [(90 + k, docs[-2][1]) for k in range(3)]
    got = rows_of(spark, docs)
    assert got == plain_variants(docs)


def test_forms_are_followed_to_the_last(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    docs = [(k, " ".join([chain[0]] * 2000 + [chain[1]] * 200 + [chain[2]] * 20 + [chain[3]] * 2)) for k in (1, 2)]
    got = {w: (form, root) for w, form, root, *_ in rows_of(spark, docs)}
    assert got["abcdefghij"] == ("abcdefghi", "abcdefg") and got["abcdefg"] == (None, "abcdefg")


def test_one_word_with_all_letters(spark):
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    docs = [(k, " ".join("abc" + c + "defg" for c in letters) + " abcdefg") for k in range(4)]
    assert rows_of(spark, docs) == plain_variants(docs)


def test_long_texts_are_cut_between_runs(monkeypatch):
    text = " ".join(["Verylongword", "tiny", "wörterbuch"] * 50) + "x" * 300
    whole = spelling.runs_of(text)
    monkeypatch.setattr(spelling, "BLOCK", 17)
    assert spelling.runs_of(text) == whole and whole["verylongword"] == 50


# --- whitening --------------------------------------------------------------------------------


def plain_whitening(rows):
    """Whitened rows with numpy; the fit list is one of each distinct vector."""
    kept = [(i, np.array([math.floor(64 * c) + 1_000_000 for c in v], dtype=object)) for i, v in rows]
    fitted = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, total = len(fitted), fitted.sum(axis=0)
    v = np.cov((fitted * n - total).astype(float).T / n, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in kept:
        off = x * n - total
        out.setdefault(i, []).append((int((off * off).sum()), (off.astype(float) / n) @ vectors / np.sqrt(np.abs(values) + 1e-300)))
    return n, values, out


def test_whitening_of_messy_vectors(result):
    rows = [(i, v) for i, v in embeddings() if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    n, values, want = plain_whitening(rows)
    got = collections.defaultdict(list)
    for r in result("op12_polarisation"):
        got[r.vec_id].append(r)
    assert {i for i in got} == {i for i, _ in rows} | {260}
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got[260]] == [(1, 0, None, None, None)]
    signs = {}
    for i, found in got.items():
        if i == 260:
            continue
        by_row = collections.defaultdict(list)
        for r in found:
            by_row[r.component].append(r)
        assert sorted(by_row) == [1, 2, 3, 4, 5, 6]
        for k, of in by_row.items():
            assert sorted(r.deviation for r in of) == sorted(d for d, _ in want[i])
            for r in of:
                assert r.n == n and r.identity_error < 1e-6
                assert math.isclose(r.explained, values[k - 1] / values.sum(), rel_tol=1e-9, abs_tol=1e-12)
                if r.whitened is None:
                    assert values[k - 1] < 1e-9 * values.sum()
                    continue
                near = [w[k - 1] for d, w in want[i] if d == r.deviation]
                if abs(near[0]) > 1e-3:
                    assert signs.setdefault(k, np.sign(near[0] * r.whitened)) == np.sign(near[0] * r.whitened)
                assert min(abs(abs(w) - abs(r.whitened)) for w in near) < 1e-6


def test_whitening_is_exact_for_wide_values(spark):
    draw = np.random.default_rng(3)
    x = draw.integers(-(2**45), 2**45, (60, 3)).astype(float)
    x[:, 2] = x[:, 0] + draw.integers(-3, 4, 60)  # nearly dependent
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fitted = whitening.integer_vectors(frame, "vec_id", "embedding")
    totals = whitening.dimension_sums(fitted)
    v = whitening.covariances(fitted, totals)[3]
    whole = [[int(64 * c) + 1_000_000 for c in row] for row in x]
    for i in range(3):
        for j in range(3):
            total = sum(a[i] * a[j] for a in whole) * 60 - sum(a[i] for a in whole) * sum(a[j] for a in whole)
            assert v[i, j] == total / 3600
    assert {r.deviation for r in whitening.whiten(frame).collect()} == {None}


def test_vectors_of_no_use(spark):
    rows = [(1, None), (2, []), (3, [float("inf"), 1.0]), (4, [1e300, 0.0]), (5, [0.5, 0.25]), (5, [0.5, 0.25]), (6, [0.5, 0.28])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in got) == [
        (5, 1, False), (5, 1, False), (5, 2, True), (5, 2, True), (6, 1, False), (6, 2, True)
    ]
    assert all(r.n == 2 and r.deviation == 1 and abs(abs(r.whitened or 1) - 1) < 1e-9 for r in got)


# --- toxicity ---------------------------------------------------------------------------------


def made_up(n, seed):
    draw = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = ["".join("aeioulnrst"[j] for j in draw.integers(0, 10, draw.integers(2, 8))) for _ in range(draw.integers(5, 60))]
        toxic = int(draw.random() < 0.2)
        for _ in range(2 * toxic):
            words.insert(int(draw.integers(0, len(words))), ["zwok", "Gribx", "untzwokal"][draw.integers(0, 3)])
        rows.append((k, " ".join(words), toxic))
    return rows


def held(k):
    return zlib.crc32(str(k).encode()) % 4 == 2


def frames(spark, rows):
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")


def test_toxic_texts_are_told_from_others(spark):
    rows = made_up(1200, 1)
    got = {r.doc_id: r for r in toxicity.score_toxicity(*frames(spark, rows)).collect()}
    right = [(got[k].score >= 0.3) == bool(y) for k, _, y in rows if held(k)]
    assert len(right) > 200 and np.mean(right) > 0.97
    assert all(got[k].held_out == held(k) for k, _, _ in rows)


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = made_up(300, 2)
    turned = [(k, t, 1 - y if held(k) else y) for k, t, y in rows]
    scores = [sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(*frames(spark, x)).collect()) for x in (rows, turned)]
    assert scores[0] == scores[1]


def test_scores_without_both_classes(spark, result):
    for rows, low, high in ((made_up(40, 3), 0, 0.1), ([(k, t, 0) for k, t, _ in made_up(40, 3)], 0, 0.1), ([], 0, 1)):
        docs, labels = frames(spark, rows) if rows else frames(spark, made_up(5, 4))
        labels = labels.filter("toxic = 0") if rows else labels.limit(0)
        found = {r.score for r in toxicity.score_toxicity(docs, labels).collect()}
        assert len(found) == 1 and low <= found.pop() <= high
    messy = result("op13_log_ratios")
    assert len(messy) == len(documents()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in messy)


def test_places_of_long_texts_by_block(monkeypatch):
    text = "Some WORDS of a text, \n with  blanks and 🙂. " * 40
    whole = toxicity.places(text)
    assert (whole == toxicity.places(" ".join(text.lower().split()))).all() and not len(toxicity.places(""))
    monkeypatch.setattr(toxicity, "BLOCK", 13)
    assert (toxicity.places(text) == whole).all()


def test_ratios_follow_the_counts(spark):
    rows = [(k, "abc" if k < 60 else "xyz", int(k < 60)) for k in range(120)] + [(200, "abc", 0), (201, "xyz", 1)]
    frame = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, toxic int")
    got = {r.place: r.ratio for r in toxicity.log_ratios(toxicity.count_places(frame)).collect()}
    for text, sign in (("abc", 1), ("xyz", -1)):
        for place in toxicity.places(text):
            ratio = math.log(60.5 / 1.5)
            assert math.isclose(got[place], sign * (ratio - 2 * math.sqrt(1 / 60.5 + 1 / 1.5)), rel_tol=1e-9)


# --- repairs ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text",
    ["an area of 10² km", "①2 ٣4 @٣ 5٤", "0" * 5000 + ".1.1.1", "+1²(3", "@" * 300 + "1" * 300, "1 " * 400, "é@é.é 7", "\x00\x01 9@퟿"],
)
def test_odd_digits_do_not_end_the_job(text):
    for weights in ({}, {(k, "bias"): 1.0 for k in range(4)}):
        base, spans = pii.all_spans(text, weights)
        assert set(base) <= set(spans)


def test_best_segmentation_by_trying_all():
    draw = np.random.default_rng(11)
    for _ in range(60):
        text = "".join("1 @a.-"[k] for k in draw.integers(0, 6, 7))
        bounds, ending = pii.lattice(text, 0, len(text))
        candidates = [c for cs in ending for c in cs]
        weights = {(c[2], f): float(draw.normal()) for c in candidates for f in c[3]}

        def best(at):
            """Highest score of any set of segments that do not overlap, from a unit on."""
            if at >= len(bounds) - 1:
                return 0.0
            return max([best(at + 1)] + [pii.score(weights, c) + best(c[1]) for c in candidates if c[0] == at])

        found = pii.decode(weights, text, 0, len(text))
        got = 0.0
        for kind, a, b in found:
            got += max(pii.score(weights, c) for c in candidates if (c[2], bounds[c[0]], bounds[c[1]]) == (kind, a, b))
        assert math.isclose(got, best(0), abs_tol=1e-6)


def test_class_words_that_say_a_state_keep_the_page():
    read = lambda s: style_tree.Page(s).main_text(set())
    assert read('<body class="no-sidebar"><div><p>kept</div></body>') == "kept"
    assert read('<article class="post comments-open"><p>kept</article>') == "kept"
    assert read('<body class="promo share banner"><main class="related"><p>kept</main></body>') == "kept"
    assert read('<div class="site-sidebar">gone</div><div class="main-nav">gone</div><p>kept') == "kept"
