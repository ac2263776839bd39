"""Every registered query over messy small tables, against plain code."""

import collections
import math
import zlib

import numpy as np
import pytest

from chronogrid.llm import line_dedup, packing, perplexity, pii, style_tree
from chronogrid.llm.queries import QUERIES

from . import plain
from .conftest import BODY, documents, embeddings, pages

DOCS = [(i, t) for i, t, _, _ in documents()]


def same(a, b):
    assert collections.Counter(a) == collections.Counter(b)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables_give_empty_results(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_main_text(result):
    rows = {(r.page_id, r.text, r.n_chars) for r in result("op1_style_tree")}
    for k in range(8):
        line = f"Item {k} is unlike item {k + 90}."
        assert (k, line, len(line)) in rows  # menus by name, the repeated line by the style tree
    assert {(50, "", 0), (51, "", 0), (52, "plain <text> & more", 19), (53, "T & t\na b\nc", 11), (54, "deep", 4)} <= rows
    assert len(result("op1_style_tree")) == len(pages())


def test_main_text_of_a_host_of_copies(spark, tmp_path):
    page = "<html><body><nav>Menu</nav><article class='{}-post'><p class='{}-p'>{}</p></article></body></html>"
    rows = [(k, f"http://one.example.com/?session={k}", page.format("one", "one", "The only page.")) for k in range(50)]
    rows += [(100 + k, f"http://two.example.com/{k}", page.format("two", "two", "Mostly this.")) for k in range(90)]
    rows += [(200 + k, f"http://two.example.com/x{k}", page.format("two", "two", f"Text {k} of it.")) for k in range(5)]
    rows += [(300 + k, f"http://mirror{k}.example.com/", page.format("m", "m", "A mirrored page.")) for k in range(30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in QUERIES["op1_style_tree"](spark, str(tmp_path)).collect()}
    assert got == {i: html.split("p'>")[1].split("<")[0] for i, _, html in rows}


def test_main_text_where_the_style_tree_is_too_large_to_send(spark, messy, result):
    found = style_tree.extract_main_text(spark.read.parquet(f"{messy}/pages.parquet"), bound=0)
    same([tuple(r) for r in found.collect()], [tuple(r) for r in result("op1_style_tree")])


def test_pages_get_their_own_nodes_only(spark, messy):
    hosted = style_tree._hosted(spark.read.parquet(f"{messy}/pages.parquet"), "page_id", "url", "html")
    low = style_tree.unimportant_styles(style_tree.style_nodes(hosted))
    foreign = spark.range(5000).selectExpr("IF(id % 2 = 0, '', 'shop.example.com') AS host", "id AS style")
    got = style_tree.own_unimportant(hosted, low.unionByName(foreign)).collect()
    assert got and max(len(r.styles) for r in got) < 20


def test_broken_pages():
    read = lambda s: style_tree.Page(s).main_text(set())
    assert read('<div>one</div><div class=x>two<br>three</div><p class="') == "one\ntwo three"
    assert read("<ul><li>1<li>2</ul><table><tr><td>x<td>y</table>") == "1\n2\nx\ny"
    assert read("<main><p>in</main><p>out") == "in"
    assert read("<div class='has menu'><article><p>kept</article></div>") == "kept"


def test_rules_and_bands(result):
    rows = result("op2_perplexity_bands")
    same(
        [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows],
        [(i, *plain.rules(t)) for i, t in DOCS],
    )
    assert not any(r.kept and r.base_failed for r in rows)


def prose(seed, n=60):
    """Words of one made-up language."""
    draw = np.random.default_rng(seed)
    syllables = ["the", "an", "er", "on", "ing", "st", "re", "ou", "ha", "ti"]
    words = ["".join(syllables[k] for k in draw.integers(0, 10, 1 + draw.integers(0, 3))) for _ in range(n)]
    return " ".join(words)


def test_a_clean_document_in_a_third_of_the_rows_stays(spark, tmp_path):
    rows = [(k, prose(k), "en") for k in range(300)] + [(1000 + k, prose(7), "en") for k in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op2_perplexity_bands"](spark, str(tmp_path)).collect()
    assert len(got) == 450
    assert all(r.kept for r in got if r.doc_id == 7 or r.doc_id >= 1000)


def held_out_score(texts, left_out):
    """Log-probability sum of one of some texts on a model of the others, without arrays."""

    def levels(of):
        out = {5: collections.Counter(t[i : i + 5] for t in of for i in range(len(t) - 4))}
        for size in (4, 3, 2, 1):
            out[size] = collections.Counter(g[1:] for g in out[size + 1])
        return out

    whole, others = levels(texts), levels([t for t in texts if t != left_out])
    cuts = {}
    for size, level in whole.items():
        n = collections.Counter(level.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        for k in (1, 2, 3):
            step = k - (k + 1) * y * n[k + 1] / n[k] if n[k] and y is not None else 0.5 * k
            cuts[size, k] = min(0.95 * k, max(0.1, step))

    def p(gram):
        if not gram:
            return 1 / len(whole[1])
        level = others[len(gram)]
        after = [(n, cuts[len(gram), min(n, 3)]) for g, n in level.items() if g[:-1] == gram[:-1]]
        low = p(gram[1:])
        if not after:
            return low
        n = level[gram]
        own = max(0, n - cuts[len(gram), min(n, 3)]) if n else 0
        return (own + sum(c for _, c in after) * low) / sum(n for n, _ in after)

    return sum(math.log(p(left_out[i : i + 5])) for i in range(len(left_out) - 4))


def test_documents_are_scored_on_the_others_alone(spark, tmp_path):
    texts = [prose(1, 12), prose(2, 15), "abab" * 9 + " the an er", prose(3, 20), "zq zq jx " * 3, "tiny one"]
    rows = [(k, t, "en") for k, t in enumerate([*texts, texts[0]])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2).write.parquet(f"{tmp_path}/d")
    docs = perplexity.language_rows(spark.read.parquet(f"{tmp_path}/d"), "doc_id", "text", "lang")
    model = perplexity.count_model(perplexity.count_grams(docs.filter("counted")))
    for bound in (perplexity.MODEL_BYTES, 0):
        got = perplexity.measure_documents(docs, model, bound=bound).collect()
        assert len(got) == len(rows) and sum(r.counted for r in got) == len(texts)
        for r in got:
            assert math.isclose(r.logp, held_out_score(texts, rows[r.doc_id][1]), rel_tol=1e-9)


def test_texts_unlike_their_language_score_high(spark, tmp_path):
    draw = np.random.default_rng(5)
    odd = [
        " ".join("".join(map(chr, draw.integers(0x4E00, 0x9FFF, 6))) for _ in range(80)),
        " ".join("".join(map(chr, draw.integers(0x100, 0x24F, 6))) for _ in range(80)),
        " ".join("".join(map(chr, draw.choice([*range(48, 58), *range(65, 91), *range(97, 123)], 8))) for _ in range(80)),
    ]
    rows = [(k, prose(k), "en") for k in range(300)] + [(1000 + k, t, "en") for k, t in enumerate(odd)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op2_perplexity_bands"](spark, str(tmp_path)).collect()}
    for k in range(len(odd)):
        assert got[1000 + k].perplexity > got[1000 + k].upper_band and not got[1000 + k].kept
    assert all(got[k].kept for k in range(300))


def test_line_dedup(result):
    rows = result("op3_cuckoo_lines")
    same([tuple(r) for r in rows], plain.line_dedup(DOCS))
    assert sum(r.n_dropped for r in rows) == 6


def test_line_state_is_reversible(spark, messy):
    docs = spark.read.parquet(f"{messy}/documents.parquet").select("doc_id", "text").filter("doc_id IS NOT NULL")
    old, new = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    counts = lambda s: sorted((r.key.a, r.key.b, r.n_docs, r.last_doc) for r in s.read(spark, "counts").collect())
    first, whole = line_dedup.build_state(old), line_dedup.build_state(docs)
    grown = line_dedup.insert_documents(first, new)
    back = line_dedup.delete_documents(grown, new)
    assert counts(grown) == counts(whole) and counts(back) == counts(first)
    texts = lambda s, **k: sorted(r["__kept"] for r in line_dedup.dedup_lines(s, docs, **k).collect())
    assert texts(grown) == texts(whole) == texts(whole, bound=0)


def test_cuckoo_filter_holds_all_and_forgets():
    draw = np.random.default_rng(1).integers(-(2**63), 2**63, (2, 20_000), dtype=np.int64)
    table = line_dedup.empty_filter(20_000)
    assert line_dedup.filter_insert(table, *draw)
    assert line_dedup.filter_has(table, *draw).all()
    other = np.random.default_rng(2).integers(-(2**63), 2**63, (2, 20_000), dtype=np.int64)
    assert line_dedup.filter_has(table, *other).mean() < 0.001
    line_dedup.filter_delete(table, *draw[:, :10_000])
    assert line_dedup.filter_has(table, *draw[:, 10_000:]).all()
    assert line_dedup.filter_has(table, *draw[:, :10_000]).mean() < 0.001


def test_personal_data(result):
    rows = result("op4_semi_markov")
    found = {i: plain.personal(t) for i, t in DOCS}
    for r in rows:
        base = found[r.doc_id]
        counts = collections.Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.KINDS)
        assert r.base_sha256 == plain.sha(plain.spans(base))
        assert {plain.spans([s]) for s in base} <= set(r.spans.split(","))
    assert len(rows) == len(DOCS)


def test_field_finds_what_patterns_miss_and_stays_quiet():
    fixed = [f"see 4111111111111111 or 10.0.{k}.7 and mail x{k}@mail.example.com, +1 (555) 123-45{k:02d} ok" for k in range(40)]
    noise = [f"version {k}.{k + 1}, item {k * 977}, AKIA{k}B{k}C, 1234567890{k:06d}" for k in range(40)]
    weights = pii.fit(fixed + noise)
    assert pii.all_spans("pay 4111111111111111 4012888888881881 now", weights)[1] == [(2, 4, 20), (2, 21, 37)]
    for text in ("Licensed under CC BY-NC 4.0.", "version 3.", "in 1984 and 2001 there were 12 of 300"):
        assert pii.all_spans(text, weights) == ([], [])


def test_patterns_stay_linear():
    long_run = "a" * 300_000 + "@" + "1" * 300_000 + " +" + "1-" * 100_000
    assert len(pii.pattern_spans(long_run)) == 0


def test_shards(result):
    rows = result("op5_jump_hash")
    want = [
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", plain.shard(i, 16), plain.shard(i, 17))
        for i, t in DOCS
    ]
    same([(r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows], want)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_mix(result):
    rows = result("op6_systematic_mix")
    source = {i: s for i, _, _, s in documents()}
    sizes = collections.Counter()
    for i, t in DOCS:
        sizes[source[i]] += len(plain.WORD.findall(t or ""))
    want = plain.targets(sizes)
    taken, longest = collections.Counter(), collections.Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    assert all(abs(taken[s] - want[s]) <= longest[s] + 1e-6 for s in want)
    assert len(rows) == len(DOCS)


def test_near_duplicates(result):
    rows = result("op7_odd_sketches")
    same([(r.doc_id, r.n_shingles, r.component_id) for r in rows], plain.components(DOCS, 85))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_a_dense_group(spark, tmp_path):
    """Variants on a chain: neighbours are alike, the ends are not."""
    words = BODY.split()
    rows = []
    for k in range(400):
        words[(k * 29) % 120] = f"new{k}"
        rows.append((k, " ".join(words) + f" {k % 3}"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op7_odd_sketches"](spark, str(tmp_path)).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], plain.components(rows, 85))


def test_packing(result):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.tokenizer_files()[0])
    want = []
    for i, t in DOCS:
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = packing.cut(len(ids), 1024)
        want += [(i, k, a, b - a, plain.crc(ids[a:b])) for k, (a, b) in enumerate(cuts)]
    rows = result("op8_best_fit")
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], want)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= math.ceil(sum(r.length for r in rows) / 1024) + 2


@pytest.mark.parametrize("lengths", [[512] * 50, [1] * 3000, [700, 300, 24] * 40, list(range(1, 1024)), [513] * 30 + [511] * 30])
def test_best_fit_is_tight(spark, lengths):
    items = spark.createDataFrame(list(enumerate(lengths)), "id long, length int")
    placed = packing.best_fit(items).collect()
    assert sorted(r.id for r in placed) == list(range(len(lengths)))
    filled = collections.Counter()
    for r in placed:
        filled[r.sequence_id] += lengths[r.id]
    assert max(filled.values()) <= 1024
    least = max(math.ceil(sum(lengths) / 1024), sum(n > 512 for n in lengths))
    assert len(filled) <= least + max(1, least // 50)


def test_cuts_put_the_short_piece_first():
    assert packing.cut(2050, 1024) == [(0, 2), (2, 1026), (1026, 2050)]
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(1, 1024) == [(0, 1)]


def test_top_products(result):
    usable = [(i, v) for i, v in embeddings() if v and all(x is not None and math.isfinite(x) for x in v)]
    usable = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in usable]
    want = []
    for q, (i, a) in enumerate(usable):
        if i % 20 == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), j) for c, (j, b) in enumerate(usable) if c != q and len(a) == len(b)]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(sorted(scored)[:20])]
    same([(r.query_id, r.rank, r.vec_id, r.score) for r in result("op9_three_phase")], want)


def test_secrets(result):
    rows = result("op10_ownership_secrets")
    found = {i: plain.secrets(t) for i, t in DOCS}
    for r in rows:
        base = found[r.doc_id]
        counts = collections.Counter(k for k, _, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (counts["assign"], counts["access"], counts["hex"])
        assert r.base_sha256 == plain.sha(plain.spans(base))
        assert {plain.spans([s]) for s in base} <= set(r.spans.split(","))
    assert len(rows) == len(DOCS)


def test_ownership_separates_copies_from_live_secrets(spark, tmp_path):
    key, own = "ghp_" + "Ab3" * 12, "ghp_" + "x9Zq7T" * 6
    rows = [(k, f"setup: {key} end", f"s{k % 4}") for k in range(12)] + [(50 + k, f"mine {own}", "s1") for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op10_ownership_secrets"](spark, str(tmp_path)).collect():
        assert (r.n_live, r.n_copied) == ((0, 1) if r.doc_id < 50 else (1, 0))
        assert r.spans == ("" if r.doc_id < 50 else "forge:5:45")
