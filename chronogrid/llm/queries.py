"""The registered queries of the training-data operators and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .jump_hash import shard_documents
from .line_dedup import build_state, dedup_lines
from .mixing import systematic_copies
from .near_dup import near_duplicates
from .packing import pack, token_pieces
from .pii import find_personal_data
from .perplexity import judge_quality
from .secret_scan import scan_secrets, span_text
from .spelling import spelling_variants
from .style_tree import extract_main_text
from .topk import top_products
from .toxicity import FLAGGED, score_toxicity
from .whitening import whiten

SHARDS = 16


def op1_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).drop("file", "at")


def op3_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    state = build_state(docs, keep_postings=False)
    return dedup_lines(state, docs).select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )


def _joined(spans: str) -> Column:
    """``kind:start:end`` of spans in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def op5_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs, SHARDS)


def op6_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = systematic_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return drawn.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def op7_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(token_pieces(docs)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op9_three_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("fixed", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_text(F.col("fixed")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        "n_live",
        "n_copied",
    )


def op11_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_polarisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_log_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= FLAGGED).cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_style_tree": op1_style_tree,
    "op2_perplexity_bands": op2_perplexity_bands,
    "op3_cuckoo_lines": op3_cuckoo_lines,
    "op4_semi_markov": op4_semi_markov,
    "op5_jump_hash": op5_jump_hash,
    "op6_systematic_mix": op6_systematic_mix,
    "op7_odd_sketches": op7_odd_sketches,
    "op8_best_fit": op8_best_fit,
    "op9_three_phase": op9_three_phase,
    "op10_ownership_secrets": op10_ownership_secrets,
    "op11_trie_pairs": op11_trie_pairs,
    "op12_polarisation": op12_polarisation,
    "op13_log_ratios": op13_log_ratios,
}

WORDS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> ''))"
# The checksum of each 4-bit number in the reflected polynomial 0xEDB88320.
CRC_NIBBLES = (
    "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, "
    "3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
)


def crc32_of(text: str) -> str:
    """SQL for the checksum of the UTF-8 bytes of a text that is not null."""
    return f"""CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce(
    list_transform(string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), ''),
                   lambda ch: (strpos('0123456789ABCDEF', ch) - 1)::UBIGINT),
    lambda a, x: xor(a >> 4, {CRC_NIBBLES}[(xor(a, x) & 15)::INTEGER + 1]::UBIGINT),
    4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT END"""


CRC32_OF_TEXT = crc32_of("coalesce(text, '')")

SQL: dict[str, str] = {
    "op5_jump_hash": """
WITH RECURSIVE k AS (
  SELECT doc_id, text, md5(coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), h AS (
  SELECT doc_id, text, d, ('0x' || substr(d, 1, 16))::UBIGINT AS key FROM k
), j(d, n, state, shard, nxt) AS (
  SELECT DISTINCT d, n, key::UHUGEINT, -1::BIGINT, 0::BIGINT FROM h, (VALUES (16), (17)) v(n)
  UNION ALL
  SELECT d, n, s, nxt, floor((nxt + 1)::DOUBLE * (2147483648.0::DOUBLE / ((s >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (state * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS s
        FROM j WHERE nxt < n)
), f AS (
  SELECT d, max(shard) FILTER (n = 16) AS a, max(shard) FILTER (n = 17) AS b FROM j GROUP BY d
)
SELECT doc_id, (coalesce(strlen(text), 0) + 1)::BIGINT AS size, """
    + CRC32_OF_TEXT
    + """ AS text_crc32, 'key' AS law,
  a::INTEGER AS shard, b::INTEGER AS grown_shard,
  row_number() OVER (PARTITION BY a ORDER BY d, doc_id) - 1 AS slot
FROM h JOIN f USING (d)
""",
    "op6_systematic_mix": f"""
WITH d AS (
  SELECT doc_id, source, {WORDS}::BIGINT AS size FROM documents
), s AS (
  SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, source_size * 3 AS cap,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s
), x AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent,
    sum(weight) OVER (ORDER BY cap / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_weight
  FROM w
), y AS (
  SELECT *, cap * open_weight < weight * (total - spent) AS full_up FROM x
), z AS (
  SELECT total - coalesce(sum(cap) FILTER (full_up), 0)::BIGINT AS share,
    sum(weight) FILTER (NOT full_up)::BIGINT AS open_weight FROM y GROUP BY total
), t AS (
  SELECT source, source_size,
    least(cap::DOUBLE, weight::DOUBLE * share::DOUBLE / z.open_weight::DOUBLE) AS target,
    ('0x' || substr(md5('7:' || coalesce(source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM y, z
), r AS (
  SELECT d.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    (row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id) - 1)::DOUBLE AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (floor((i + 1) * rate + u) - floor(i * rate + u))::BIGINT * size AS taken FROM r
""",
    "op3_cuckoo_lines": """
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), k AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.*, last_doc IS NOT NULL AND last_doc <> doc_id AS gone FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
    "op9_three_phase": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op7_odd_sketches": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), u AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.doc_id
)
SELECT r.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(root) AS component_id,
  r.doc_id = min(root) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""",
    "op11_trie_pairs": """
WITH RECURSIVE r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''),
    '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), h AS (
  SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL
), c AS (
  SELECT run, n, """
    + crc32_of("(id || ':' || run)")
    + """ AS crc FROM h
), w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN crc % 31 = 0 THEN substr(run, 1, (crc % length(run))::BIGINT)
      || substr(run, (crc % length(run))::BIGINT + 2) ELSE run END AS word FROM c)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), s AS (
  SELECT word, substr(word, 1, i - 1) AS pre, substr(word, i + 1) AS post
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)
), e AS (
  SELECT a.word, b.word AS other FROM s a JOIN s b USING (pre, post) WHERE a.word <> b.word
  UNION SELECT s.word, w.word FROM s JOIN w ON w.word = s.pre || s.post
  UNION SELECT w.word, s.word FROM s JOIN w ON w.word = s.pre || s.post
), b AS (
  SELECT e.word, other, n, count(*) OVER (PARTITION BY e.word) AS n_near,
    row_number() OVER (PARTITION BY e.word ORDER BY n DESC, other) AS place
  FROM e JOIN w ON w.word = e.other
), f AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
    CASE WHEN b.n >= 10 * w.n THEN other END AS form, CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n
  FROM w LEFT JOIN b ON b.word = w.word AND place = 1
), t(word, root, step) AS (
  SELECT word, word, 0 FROM f
  UNION ALL
  SELECT t.word, f.form, step + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL
)
SELECT f.word, form, root, n, n_near, form_n
FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM t GROUP BY word) USING (word)
""",
}
