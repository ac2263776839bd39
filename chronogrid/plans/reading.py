"""Queries over page reading (C): layouts generated from the sessions must read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract
from . import views
from .registry import query

_WRITTEN = """
w AS (SELECT 'doc' || (event_id // 40) AS doc, event_id % 40 AS i, event_id, ([{days}])[isodow(ts)] AS jour, 'Module ' || (event_id % 53) AS matiere,
    event_type, 'Pr. User ' || user_id AS enseignant, 'Groupe G' || (event_id % 3) AS groupe, 'Salle ' || (k % 40) AS salle,
    printf('%02dh%02d', st // 60, st % 60) || '–' || printf('%02dh%02d', (st + ln) // 60, (st + ln) % 60) AS horaire, CAST(ln AS DOUBLE) / 60.0 AS duree
  FROM ev),
""".format(days=views._DAYS)
VIEW = views.SQL_SESSIONS + _WRITTEN


def written(spark, folder):
    """The sessions with every field filled, forty to a document."""
    e = views.table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k")
    )
    s = views.sessions(spark, folder).select(F.col("session_id").alias("event_id"), "jour", "horaire", "matiere")
    t = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    i = F.col("event_id")
    return e.join(s, "event_id").select(
        t("doc", F.floor(i / 40)).alias("doc"), F.lit(1).alias("page"), (i % 40).cast("int").alias("i"), "event_id", "jour", "matiere",
        "event_type", t("Pr. User ", F.col("user_id")).alias("enseignant"), t("Groupe G", i % 3).alias("groupe"),
        t("Salle ", F.col("k") % 40).alias("salle"), "horaire",
    )


def lined_pages(spark, folder):
    block = F.concat_ws(
        "\n", "jour", "matiere", "enseignant", "groupe", "salle", F.concat("event_type", F.lit(" · "), "horaire")
    )
    per_doc = F.array_sort(F.collect_list(F.struct("i", block.alias("b"))))["b"]
    return written(spark, folder).groupBy("doc", "page").agg(F.array_join(per_doc, "\n").alias("text"))


_READ = "doc, jour, matiere, {t} AS type_seance, enseignant, horaire, round(duree, 2) AS duree, {g} AS groupe, salle FROM w"


def shown(df):
    return df.select("doc", *extract.RECORD)


@query("c4_sessions_from_lines", "SELECT " + _READ.format(t="event_type", g="groupe"), VIEW)
def c4(spark, folder):
    return shown(extract.sessions_from_lines(lined_pages(spark, folder)))


@query("c3_classify_fragments", "SELECT event_id, matiere, event_type AS type_seance, enseignant, horaire, groupe, salle FROM w", VIEW)
def c3(spark, folder):
    w = written(spark, folder).select(
        "event_id",
        # Times and rooms come in either order and the title is wrapped onto its own line.
        F.when(
            F.col("i") % 2 == 0,
            F.array("salle", "matiere", F.lit("Pr."), F.regexp_replace("enseignant", "^Pr. ", ""), "groupe", F.concat("event_type", F.lit(" "), "horaire")),
        )
        .otherwise(F.array("matiere", "enseignant", F.concat("event_type", F.lit(" · "), "horaire"), "groupe", "salle"))
        .alias("fragments"),
    ).withColumn("fragments", F.transform("fragments", lambda x: F.when(x == "Pr.", "Pr").otherwise(x)))
    got = extract.classify_fragments(w, "fragments")
    return got.select("event_id", "matiere", "type_seance", extract.title_case_prefix("enseignant").alias("enseignant"), "horaire", "groupe", "salle")


def cells(w, *parts):
    """Cells (doc, page, table, row, col, text) from (row, col, text) structs per session."""
    made = [F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"), t.alias("text")) for r, c, t in parts]
    return w.select("doc", "page", F.lit(0).alias("table"), F.explode(F.array(*made)).alias("x")).select(
        "doc", "page", "table", "x.*"
    ).distinct()


def block_cells(spark, folder):
    i, c = F.col("i"), F.col
    return cells(
        written(spark, folder),
        (i * 4, F.lit(0), c("jour")), (i * 4, F.lit(1), c("matiere")), (i * 4 + 1, F.lit(1), c("enseignant")),
        (i * 4 + 2, F.lit(1), c("horaire")), (i * 4 + 3, F.lit(1), c("salle")),
    )


@query("c5_sessions_from_day_blocks", "SELECT " + _READ.format(t="''", g="''"), VIEW)
def c5(spark, folder):
    return shown(extract.sessions_from_day_blocks(block_cells(spark, folder)))


@query("c6_sessions_from_grid_across", "SELECT " + _READ.format(t="''", g="''"), VIEW)
def c6(spark, folder):
    i, c = F.col("i"), F.col
    w = written(spark, folder)
    at = views.keys.day_order("jour")
    course = F.concat_ws("\n", "matiere", "enseignant", "salle")
    heads = [(F.lit(0), F.lit(j), F.lit(d)) for j, d in enumerate(views.keys.WEEK_DAYS, 1)]
    return shown(extract.sessions_from_grid(cells(w, *heads, (i + 1, F.lit(0), c("horaire")), (i + 1, at, course))))


@query("c6_sessions_from_grid_down", "SELECT " + _READ.format(t="''", g="''"), VIEW)
def c6_down(spark, folder):
    # Times stand in the first row above each course's own column.
    i, c = F.col("i"), F.col
    course = F.concat_ws("\n", "matiere", "enseignant", "salle")
    # A second day label in the first rows would make it a header, so days start at row 5.
    return shown(
        extract.sessions_from_grid(
            cells(written(spark, folder), (F.lit(0), i + 1, c("horaire")), (i + 5, F.lit(0), c("jour")), (i + 5, i + 1, course))
        )
    )


def positioned(spark, folder, *parts):
    """Positioned lines: a day label per session and its texts around it."""
    y = F.col("i") * 100 + 50
    made = [
        F.struct(F.lit(j).alias("n"), x.cast("double").alias("x"), (y + dy).cast("double").alias("y"), t.alias("text"))
        for j, (x, dy, t) in enumerate(parts)
    ]
    return written(spark, folder).select("doc", "page", "i", F.explode(F.array(*made)).alias("p")).select(
        "doc", "page", (F.col("i") * 10 + F.col("p.n")).alias("seq"), "p.x", "p.y", "p.text"
    )


@query("c7_sessions_from_four_lanes", "SELECT " + _READ.format(t="''", g="''"), VIEW)
def c7_four(spark, folder):
    c = F.col
    x = F.element_at(F.array(*[F.lit(v) for v in (150, 300, 500, 700)]), (c("i") % 4 + 1).cast("int"))
    lines = positioned(
        spark, folder, (F.lit(50), 0, c("jour")), (x, -20, c("matiere")), (x, -10, c("enseignant")), (x, 0, c("horaire")), (x, 10, c("salle"))
    )
    return shown(extract.sessions_from_four_lanes(lines))


@query("c7_sessions_from_five_lanes", "SELECT " + _READ.format(t="event_type", g="''"), VIEW)
def c7_five(spark, folder):
    c = F.col
    x = F.element_at(F.array(*[F.lit(v) for v in (150, 300, 450, 600, 700)]), (c("i") % 5 + 1).cast("int"))
    lines = positioned(
        spark, folder, (F.lit(50), 0, c("jour")), (x, -15, c("matiere")), (x, -5, F.concat("event_type", F.lit(" · "), "horaire")),
        (x, 10, F.concat("enseignant", F.lit(" · "), "salle")),
    )
    return shown(extract.sessions_from_five_lanes(lines, 100_000.0))


@query("c8_sessions_from_anchors", "SELECT " + _READ.format(t="''", g="''"), VIEW)
def c8(spark, folder):
    c = F.col
    x = F.lit(400) + (c("i") % 3) * 150
    lines = positioned(
        spark, folder, (F.lit(100), 0, c("jour")), (x, -20, c("matiere")), (x, -10, c("enseignant")), (x, 0, c("horaire")), (x, 10, c("salle"))
    )
    return shown(extract.sessions_from_anchors(lines, 1000.0))


def candidates(spark, folder):
    """Every document read as text; every other one also as two grids of unequal size."""
    lines = extract.sessions_from_lines(lined_pages(spark, folder)).select("doc", "page", "jour", "matiere", "horaire", "enseignant")
    tables = block_cells(spark, folder)
    number = F.regexp_extract("doc", r"(\d+)", 1).cast("int")
    grid = extract.sessions_from_day_blocks(tables.filter(number % 2 == 0)).select("doc", "page", "start", "jour", "matiere", "horaire", "enseignant")
    tag = lambda df, s, t: df.withColumn("strategy", F.lit(s)).withColumn("table", F.lit(t))
    small = grid.filter("start > 0").drop("start")
    return tag(lines, "text", 0).unionByName(tag(small, "grid", 1)).unionByName(tag(grid.drop("start"), "grid", 2))


@query(
    "c9_best_strategy",
    """SELECT doc, jour, matiere, horaire, CASE WHEN (event_id // 40) % 2 = 0 THEN 'grid' ELSE 'text' END AS strategy,
      CASE WHEN (event_id // 40) % 2 = 0 THEN 2 ELSE 0 END AS tbl FROM w""",
    VIEW,
)
def c9(spark, folder):
    return extract.best_strategy(candidates(spark, folder)).select("doc", "jour", "matiere", "horaire", "strategy", F.col("table").alias("tbl"))


@query(
    "c9_strategy_notices",
    """SELECT DISTINCT doc, doc || ' - page 1: ' || CASE WHEN (event_id // 40) % 2 = 0 THEN 'grille reconnue automatiquement ; vérifiez les matières et enseignants.'
      ELSE 'lecture par blocs de texte ; vérifiez chaque séance.' END AS notice FROM w""",
    VIEW,
)
def c9_notices(spark, folder):
    return extract.strategy_notices(extract.best_strategy(candidates(spark, folder))).select("doc", "notice")


_TWICE = "twice AS (SELECT * FROM sessions UNION ALL SELECT * REPLACE (ord + 1000000000 AS ord, salle || ' bis' AS salle) FROM sessions),"


def twice(spark, folder):
    s = views.sessions(spark, folder)
    again = s.withColumn("ord", F.col("ord") + 1_000_000_000).withColumn("salle", F.concat("salle", F.lit(" bis")))
    return s.unionByName(again)


@query(
    "c10_merge_unique",
    "SELECT source_document, min(ord) AS ord, arg_min(salle, ord) AS salle FROM twice GROUP BY source_document, jour, matiere, enseignant, horaire, groupe",
    views.SQL_SESSIONS + _TWICE,
)
def c10(spark, folder):
    return extract.merge_unique(twice(spark, folder), ["source_document"], "ord").select("source_document", "ord", "salle")


@query(
    "c11_merge_unique_last",
    "SELECT source_document, min(ord) AS ord, arg_max(salle, ord) AS salle FROM twice GROUP BY source_document, jour, matiere, enseignant, horaire, groupe",
    views.SQL_SESSIONS + _TWICE,
)
def c11(spark, folder):
    return extract.merge_unique_last(twice(spark, folder), ["source_document"], "ord").select("source_document", "ord", "salle")


@query(
    "c12_extraction_warnings",
    "SELECT source_document, count(*) FILTER (WHERE enseignant = '') AS sans_enseignant, false AS sans_programme FROM sessions GROUP BY 1 HAVING count(*) FILTER (WHERE enseignant = '') > 0",
    views.SQL_SESSIONS,
)
def c12(spark, folder):
    return extract.extraction_warnings(views.sessions(spark, folder))


@query("c13_document_summary", "SELECT source_document, arg_min(filiere, ord) AS filiere, arg_min(niveau, ord) AS niveau FROM sessions GROUP BY 1", views.SQL_SESSIONS)
def c13(spark, folder):
    return extract.document_summary(views.sessions(spark, folder))


@query(
    "c13_document_overrides",
    "SELECT session_id, CASE WHEN o.source_document IS NULL THEN filiere ELSE 'XX' END AS filiere, niveau FROM sessions s LEFT JOIN (SELECT DISTINCT source_document FROM sessions WHERE niveau = 'S6') o USING (source_document)",
    views.SQL_SESSIONS,
)
def c13_overrides(spark, folder):
    s = views.sessions(spark, folder)
    o = s.filter("niveau = 'S6'").select("source_document", F.lit(" XX ").alias("filiere"), F.lit(None).cast("string").alias("niveau")).distinct()
    return extract.apply_document_overrides(s, o).select("session_id", "filiere", "niveau")


_META = """
m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'RT' WHEN 1 THEN 'GCCD' WHEN 2 THEN 'IDSD' ELSE '' END AS filiere,
  CASE doc_id % 4 WHEN 0 THEN 'Réseaux' WHEN 2 THEN 'IDSD – Semestre 3' ELSE '' END AS filiere_label FROM documents),
"""


def headed_pages(spark, folder):
    """Whole document texts under a timetable head in one of three spellings."""
    d = views.table(spark, folder, "documents")
    i = F.col("doc_id")
    head = (
        F.when(i % 4 == 0, "Filière : Réseaux (rt)\nEmploi du 4ème Semestre\nAnnée universitaire : 2024 / 2025\n")
        .when(i % 4 == 1, "G C CD\nSemestre 2\nAnnée universitaire 2024/2025\n")
        .when(i % 4 == 2, "Filiere : IDSD – Semestre 3\n")
        .otherwise("")
    )
    text = F.concat(head, F.coalesce("text", F.lit("")))
    return d.select(F.concat(F.lit("d"), i).alias("doc"), F.lit(1).alias("page"), text.alias("text"), "doc_id")


@query(
    "c1_document_metadata",
    """SELECT 'd' || doc_id AS doc, filiere, filiere_label, CASE doc_id % 4 WHEN 0 THEN 'S4' WHEN 1 THEN 'S2' WHEN 2 THEN 'S3' ELSE '' END AS niveau,
      CASE WHEN doc_id % 4 < 2 THEN '2024/2025' ELSE '' END AS academic_year FROM m""",
    _META,
)
def c1(spark, folder):
    return extract.document_metadata(headed_pages(spark, folder)).drop("page")


@query(
    "c2_propagate_first_page",
    """SELECT 'b' || (doc_id // 4) AS doc, doc_id % 4 AS page, CASE WHEN m.filiere = '' THEN 'RT' ELSE m.filiere END AS filiere FROM m""",
    _META,
)
def c2(spark, folder):
    pages = headed_pages(spark, folder)
    meta = extract.document_metadata(pages).join(pages.select("doc", "doc_id"), "doc")
    bound = meta.withColumn("page", (F.col("doc_id") % 4).cast("int")).withColumn(
        "doc", F.concat(F.lit("b"), F.floor(F.col("doc_id") / 4))
    )
    return extract.propagate_first_page(bound.drop("doc_id")).select("doc", "page", "filiere")


@query("c14_title_case_prefix", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Pr. ' WHEN 1 THEN 'Prof. ' ELSE 'Dr. ' END || 'User ' || user_id AS enseignant FROM events")
def c14(spark, folder):
    e = views.table(spark, folder, "events")
    i = F.col("event_id")
    raw = F.concat(F.when(i % 3 == 0, "PR   ").when(i % 3 == 1, "prof. ").otherwise(" dR. "), F.lit("User "), "user_id")
    return e.select("event_id", extract.title_case_prefix(raw).alias("enseignant"))
