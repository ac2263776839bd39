"""Queries over change detection (E11), verification (F) and archive search (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, search, verify
from . import views
from .registry import query
from .statistics import INDEX, sessions_index

MODEL, CHANGES = views.SQL_MODEL, views.SQL_WITH_CHANGES
YEAR = "2023/2024"


def edited_versions(spark, folder):
    """Each version against itself after edits: moved rooms and times, renamed teachers,
    sessions dropped and sessions added."""
    s = views.sessions(spark, folder)
    i = F.col("session_id")
    edited = (
        s.filter(i % 11 != 0)
        .withColumn("salle", F.when(i % 5 == 0, "Salle Z").otherwise(F.col("salle")))
        .withColumn("horaire", F.when(i % 7 == 0, "18h00–19h00").otherwise(F.col("horaire")))
        .withColumn(
            "enseignant", F.when(i % 13 == 0, F.concat("enseignant", F.lit(" bis"))).otherwise(F.col("enseignant"))
        )
    )
    added = s.filter(i % 17 == 0).withColumn("ord", F.col("ord") + 1_000_000_000).withColumn("groupe", F.lit("G9"))
    new = edited.unionByName(added)
    return diff.comparable(s, "version_id", "ord"), diff.comparable(new, "version_id", "ord")


_EDITED = """
edited AS (
  SELECT version_id, ord, jour, matiere, type_seance,
    CASE WHEN session_id % 13 = 0 THEN trim(enseignant || ' bis') ELSE enseignant END AS enseignant,
    CASE WHEN session_id % 7 = 0 THEN '18h00–19h00' ELSE horaire END AS horaire, duree, groupe,
    CASE WHEN session_id % 5 = 0 THEN 'Salle Z' ELSE salle END AS salle
  FROM sessions WHERE session_id % 11 <> 0
  UNION ALL SELECT version_id, ord + 1000000000, jour, matiere, type_seance, enseignant, horaire, duree, 'G9', salle
  FROM sessions WHERE session_id % 17 = 0),
ro AS (SELECT version_id, ord, jour, matiere, type_seance, enseignant, horaire, duree, groupe, salle,
  row_number() OVER (PARTITION BY version_id, jour, matiere, type_seance, enseignant, horaire, duree, groupe, salle ORDER BY ord) AS r FROM sessions),
rn AS (SELECT *, row_number() OVER (PARTITION BY version_id, jour, matiere, type_seance, enseignant, horaire, duree, groupe, salle ORDER BY ord) AS r FROM edited),
"""


@query(
    "e11_exact_match",
    """SELECT o.version_id AS pair, o.ord AS old_idx, n.ord AS new_idx FROM ro o
    JOIN rn n USING (version_id, jour, matiere, type_seance, enseignant, horaire, duree, groupe, salle, r)""",
    MODEL + _EDITED,
)
def exact_match(spark, folder):
    return diff.exact_match(*edited_versions(spark, folder))


@query("e11_score_pairs")
def score_pairs(spark, folder):
    _, old, new = diff.remaining(*edited_versions(spark, folder))
    return diff.score_row_pairs(old, new)


@query("e11_greedy_match")
def greedy_match(spark, folder):
    _, old, new = diff.remaining(*edited_versions(spark, folder))
    return diff.match_remaining(old, new)


@query(
    "e11_diff_summary",
    """SELECT c.version_id AS pair, coalesce(u.n, 0) AS unchanged_count, c.n AS old_rows, e.n AS new_rows FROM
      (SELECT version_id, count(*) AS n FROM sessions GROUP BY 1) c
      JOIN (SELECT version_id, count(*) AS n FROM edited GROUP BY 1) e USING (version_id)
      LEFT JOIN (SELECT o.version_id, count(*) AS n FROM ro o
        JOIN rn n USING (version_id, jour, matiere, type_seance, enseignant, horaire, duree, groupe, salle, r) GROUP BY 1) u USING (version_id)""",
    MODEL + _EDITED,
)
def diff_summary(spark, folder):
    # The two conservation laws: counters add up to the rows of either side.
    _, summary = diff.diff_versions(*edited_versions(spark, folder))
    kept = F.col("unchanged_count") + F.col("modified_count")
    return summary.select(
        "pair", "unchanged_count", (kept + F.col("removed_count")).alias("old_rows"),
        (kept + F.col("added_count")).alias("new_rows"),
    )


@query("e11_diff_rows")
def diff_rows(spark, folder):
    rows, _ = diff.diff_versions(*edited_versions(spark, folder))
    return rows.select(
        "pair", "change_type", F.array_join("changed_fields", ", ").alias("champs"), "old_idx", "new_idx"
    )


def status_events(spark, folder):
    """Three rounds of checking per session, in time order."""
    s = views.sessions(spark, folder)
    turn = F.col("session_id") + F.col("tour")
    return s.select(
        "version_id", "session_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("tour")
    ).select(
        "version_id",
        "session_id",
        F.when(turn % 4 == 0, "review").when(turn % 4 == 1, "pending").otherwise("verified").alias("status"),
        F.concat(F.lit(" tour  "), "tour").alias("note"),
        F.col("tour").alias("at"),
    )


_STATUS = "CASE (session_id + 3) % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'pending' ELSE 'verified' END"
_CODES = ", ".join(f"'{c}'" for c in views.PROGRAMMES)
_WORK = f"""
programmes AS (
  SELECT CAST(i + CASE n WHEN 'S1' THEN 0 ELSE 12 END AS INTEGER) AS program_order, ([{_CODES}])[i + 1] AS filiere, n AS niveau
  FROM range(12) r(i), (VALUES ('S1'), ('S3')) l(n)),
active AS (SELECT * FROM versions WHERE is_active = 1),
work AS (
  SELECT p.program_order, s.*, {_STATUS} AS verification_status, 'tour 3' AS verification_note,
    row_number() OVER (ORDER BY p.program_order, list_position([{views._DAYS}], jour), horaire, matiere, enseignant, session_id) AS position
  FROM programmes p JOIN active a USING (filiere, niveau) JOIN sessions s USING (version_id)),
local AS (
  SELECT *, position - min(position) OVER (PARTITION BY program_order) + 1 AS local_position,
    count(*) OVER (PARTITION BY program_order) AS local_total, count(*) OVER () AS total FROM work),
"""


def worklist(spark, folder):
    return verify.verification_worklist(
        views.versions(spark, folder),
        views.stored_sessions(spark, folder),
        verify.latest_status(status_events(spark, folder), "at"),
        YEAR,
    )


@query(
    "f1_verification_worklist",
    """SELECT program_order, filiere, niveau, version_id, session_id, jour, horaire, verification_status, verification_note,
      local_position - 1 AS session_order, false AS missing_timetable FROM local
    UNION ALL SELECT program_order, filiere, niveau, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM programmes p
    WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.filiere = p.filiere AND v.niveau = p.niveau)""",
    MODEL + _WORK,
)
def f1(spark, folder):
    return worklist(spark, folder).select(
        "program_order", "filiere", "niveau", "version_id", "session_id", "jour", "horaire",
        "verification_status", "verification_note", "session_order", "missing_timetable",
    )


@query(
    "f2_latest_status",
    f"""SELECT version_id, session_id, {_STATUS} AS status, 'tour 3' AS note,
      CASE WHEN {_STATUS} = 'verified' THEN 3 END AS verified_at, 3 AS updated_at FROM sessions""",
    MODEL,
)
def f2(spark, folder):
    return verify.latest_status(status_events(spark, folder), "at")


_COUNTS = """count(*) FILTER (WHERE verification_status = 'verified') AS verified, count(*) FILTER (WHERE verification_status = 'review') AS review,
      count(*) FILTER (WHERE verification_status = 'pending') AS pending, count(session_id) AS total"""
_STATE = "CASE WHEN count(session_id) = 0 THEN 'missing' WHEN count(*) FILTER (WHERE verification_status = 'verified') = count(session_id) THEN 'done' WHEN count(*) FILTER (WHERE verification_status = 'review') > 0 THEN 'review' ELSE 'pending' END"


@query(
    "f3_progress",
    f"""SELECT p.program_order, p.filiere, p.niveau, {_COUNTS}, {_STATE} AS state FROM programmes p LEFT JOIN work w USING (program_order) GROUP BY 1, 2, 3
    UNION ALL SELECT NULL, NULL, NULL, {_COUNTS}, {_STATE} FROM work""",
    MODEL + _WORK,
)
def f3(spark, folder):
    return verify.progress(worklist(spark, folder))


@query(
    "f4_positions",
    """SELECT session_id, position, local_position, local_total, total, greatest(position - 1, 1) AS previous_position,
      least(position + 1, total) AS next_position,
      coalesce(min(CASE WHEN verification_status <> 'verified' THEN position END) OVER (ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
        min(CASE WHEN verification_status <> 'verified' THEN position END) OVER (), position) AS next_unverified FROM local""",
    MODEL + _WORK,
)
def f4(spark, folder):
    return verify.positions(worklist(spark, folder))


@query(
    "f4_start_position",
    "SELECT coalesce(min(CASE WHEN verification_status <> 'verified' THEN position END), min(position)) AS position FROM work",
    MODEL + _WORK,
)
def f4_start(spark, folder):
    return verify.start_position(worklist(spark, folder))


@query(
    "f5_review_list",
    """SELECT filiere, niveau, 'V' || version_number AS version, jour, horaire, matiere, enseignant, salle, verification_note AS note, position
    FROM work WHERE verification_status = 'review'""",
    MODEL + _WORK,
)
def f5(spark, folder):
    return verify.review_list(worklist(spark, folder))


@query(
    "f6_missing_essentials",
    """SELECT session_id, concat_ws(', ', CASE WHEN enseignant = '' THEN 'Enseignant' END, CASE WHEN salle = '' THEN 'Salle' END) AS manquants
    FROM sessions WHERE enseignant = '' OR salle = ''""",
    MODEL,
)
def f6(spark, folder):
    return verify.missing_essentials(views.sessions(spark, folder))


@query(
    "f7_reset_year",
    """SELECT version_id, session_id FROM sessions WHERE version_id NOT IN
    (SELECT version_id FROM active JOIN programmes USING (filiere, niveau))""",
    MODEL + _WORK,
)
def f7(spark, folder):
    statuses = verify.latest_status(status_events(spark, folder), "at")
    return verify.reset_year(statuses, views.versions(spark, folder), YEAR).select("version_id", "session_id")


@query("f8_academic_years", "SELECT DISTINCT academic_year FROM timetables", MODEL)
def f8(spark, folder):
    return verify.academic_years(views.timetables(spark, folder))


def _norm(e):
    return f"trim(regexp_replace(regexp_replace(translate(lower(strip_accents({e})), '_-', '  '), '[^a-z0-9@.+/ ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _text(labels):
    parts = " || ' ' || ".join(
        f"'{k}{'' if k.endswith(' v') else ' '}' || CAST({c} AS VARCHAR)" for k, c in labels.items()
    )
    return _norm(parts)


_SEARCH = (
    INDEX
    + """
sidx AS (SELECT s.*, v.is_active, v.comment AS version_comment, v.status AS version_status FROM sessions s JOIN versions v USING (version_id)),
"""
)
_HITS = f"hits AS (SELECT * FROM sidx WHERE contains({_text(search.SESSION_TEXT)}, '17') AND contains({_text(search.SESSION_TEXT)}, 'lundi')),"
SESSION_QUERY = "Salle 17 LUNDI"


@query("g1_search_sessions", "SELECT session_id, salle, jour, matiere, version_number FROM hits", _SEARCH + _HITS)
def g1(spark, folder):
    return search.search_sessions(sessions_index(spark, folder), SESSION_QUERY).select(
        "session_id", "salle", "jour", "matiere", "version_number"
    )


_VHITS = f"vhits AS (SELECT * FROM versions WHERE contains({_text(search.VERSION_TEXT)}, 'v3') AND contains({_text(search.VERSION_TEXT)}, 'archivee')),"


@query("g2_search_versions", "SELECT version_id, filiere, niveau, version_number, status FROM vhits", MODEL + _VHITS)
def g2(spark, folder):
    return search.search_versions(views.versions(spark, folder), "V3 Archivée").select(
        "version_id", "filiere", "niveau", "version_number", "status"
    )


def _change_json(p):
    pairs = " || ',' || ".join(
        f"'\"{n}\":\"' || CAST({p}_{c} AS VARCHAR) || '\"'" for c, n in search.EXPORT_NAMES.items()
    )
    return f"CASE WHEN {p}_jour IS NULL THEN '{{}}' ELSE '{{' || {pairs} || '}}' END"


_SUM = lambda p: f"concat_ws(' | ', nullif({p}_jour, ''), nullif({p}_horaire, ''), nullif({p}_salle, ''), nullif({p}_enseignant, ''))"
_CIDX = f"""
cidx AS (
  SELECT c.*, v.version_number, v.version_number - 1 AS previous_version_number, v.timetable_id, v.academic_year, v.period, v.filiere, v.niveau,
    coalesce(new_matiere, old_matiere) AS matiere, coalesce(new_enseignant, old_enseignant) AS enseignant,
    coalesce(new_groupe, old_groupe) AS groupe, coalesce(new_type_seance, old_type_seance) AS type_seance, fields AS champs,
    {_SUM('old')} AS old_summary, {_SUM('new')} AS new_summary, {_change_json('old')} AS old_json, {_change_json('new')} AS new_json
  FROM change_rows c JOIN versions v ON v.version_id = c.to_version_id),
chits AS (SELECT * FROM cidx WHERE contains({_text(search.CHANGE_TEXT)}, 'click') AND contains({_text(search.CHANGE_TEXT)}, 'mercredi')
  AND contains({_text(search.CHANGE_TEXT)}, '12h30')),
"""


def cidx(spark, folder):
    return search.changes_index(views.change_rows(spark, folder), views.versions(spark, folder))


@query(
    "g3_changes_index",
    "SELECT to_version_id, version_number, previous_version_number, filiere, niveau, change_type, matiere, enseignant, champs, old_summary, new_summary FROM cidx",
    CHANGES + _CIDX,
)
def g3_index(spark, folder):
    return cidx(spark, folder).select(
        "to_version_id", "version_number", "previous_version_number", "filiere", "niveau", "change_type",
        "matiere", "enseignant", "champs", "old_summary", "new_summary",
    )


@query(
    "g3_search_changes",
    "SELECT to_version_id, change_type, matiere, enseignant, old_summary, new_summary FROM chits",
    CHANGES + _CIDX,
)
def g3(spark, folder):
    return search.search_changes(cidx(spark, folder), "module click_12h30 Mercredi").select(
        "to_version_id", "change_type", "matiere", "enseignant", "old_summary", "new_summary"
    )


@query(
    "g4_filter_version_sessions",
    """SELECT session_id, jour, matiere, salle FROM sessions WHERE jour = 'Mardi' AND groupe = 'G1'
      AND (contains(lower(matiere), 'e 4') OR contains(lower(enseignant), 'e 4') OR contains(lower(salle), 'e 4') OR contains(lower(horaire), 'e 4'))""",
    MODEL,
)
def g4(spark, folder):
    return search.filter_version_sessions(
        views.sessions(spark, folder), search=" É 4", day="Mardi", group="G1"
    ).select("session_id", "jour", "matiere", "salle")


@query(
    "g5_filter_catalog",
    "SELECT timetable_id, academic_year, period, filiere, niveau FROM timetables WHERE period = 'Printemps' AND niveau = 'S2'",
    MODEL,
)
def g5(spark, folder):
    chosen = {"academic_year": "Tous", "period": "Printemps", "filiere": "Tous", "niveau": "S2"}
    return search.filter_catalog(views.timetables(spark, folder), chosen)


@query(
    "g8_matched_versions",
    """SELECT filiere || ' ' || niveau || ' | ' || period || ' ' || academic_year || ' | V' || version_number AS label, max(version_id) AS version_id
    FROM (SELECT filiere, niveau, period, academic_year, version_number, version_id FROM hits
      UNION ALL SELECT filiere, niveau, period, academic_year, version_number, version_id FROM vhits) GROUP BY 1""",
    _SEARCH + _HITS + _VHITS,
)
def g8(spark, folder):
    found = search.search_sessions(sessions_index(spark, folder), SESSION_QUERY)
    return search.matched_versions(found, search.search_versions(views.versions(spark, folder), "V3 Archivée"))


@query(
    "g9_pin_target",
    "SELECT timetable_id, filiere, niveau, CASE WHEN filiere = 'IAID' THEN 0 ELSE 1 END AS rang FROM timetables WHERE period = 'Printemps' OR filiere = 'IAID'",
    MODEL,
)
def g9(spark, folder):
    t = views.timetables(spark, folder)
    wanted = spark.range(1).select(
        views.hashed_id(*[F.lit(x) for x in ("2023/2024", "Automne", "IAID", "S1")])
    ).first()[0]
    shown = search.filter_catalog(t, {"period": "Printemps"})
    return search.pin_target(shown, t, wanted).select("timetable_id", "filiere", "niveau", "rang")


@query(
    "g10_session_labels",
    """SELECT session_id, matiere || ' — ' || jour || ' ' || horaire || ' | ' || concat_ws(' | ', CASE WHEN enseignant <> '' THEN 'Ens. ' || enseignant END,
      'Groupe ' || groupe, CASE WHEN salle <> '' THEN 'Salle ' || salle END, filiere || ' ' || niveau, 'V' || version_number) AS label FROM sidx""",
    _SEARCH,
)
def g10_labels(spark, folder):
    return search.session_labels(sessions_index(spark, folder))


@query(
    "g10_display_sessions",
    """SELECT academic_year, period, filiere, niveau, 'V' || version_number AS version, CASE WHEN is_active = 1 THEN '✅' ELSE '' END AS active,
      jour, horaire, matiere, type_seance, enseignant, groupe, salle, source_document FROM hits""",
    _SEARCH + _HITS,
)
def g10_sessions(spark, folder):
    return search.display_sessions(search.search_sessions(sessions_index(spark, folder), SESSION_QUERY))


@query(
    "g10_display_versions",
    """SELECT academic_year, period, filiere, niveau, 'V' || version_number AS version, CASE WHEN is_active = 1 THEN '✅' ELSE '' END AS active,
      status, sessions_count, imported_at, comment FROM vhits""",
    MODEL + _VHITS,
)
def g10_versions(spark, folder):
    return search.display_versions(search.search_versions(views.versions(spark, folder), "V3 Archivée"))


@query(
    "g10_display_changes",
    """SELECT academic_year, period, filiere, niveau, 'V' || previous_version_number || ' → V' || version_number AS version,
      CASE change_type WHEN 'modified' THEN '🟠 Modifiée' WHEN 'added' THEN '🟢 Ajoutée' ELSE '🔴 Supprimée' END AS changement,
      matiere, enseignant, groupe, type_seance, champs, old_summary AS avant, new_summary AS apres FROM cidx""",
    CHANGES + _CIDX,
)
def g10_changes(spark, folder):
    return search.display_changes(cidx(spark, folder))
