"""Queries over versions and their history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fingerprints
from ..operators import diff, versions as V
from . import views
from .registry import query

MODEL, SUMMARY, CHANGES = views.SQL_MODEL, views.SQL_WITH_SUMMARY, views.SQL_WITH_CHANGES

# Canonical JSON of a session; durations are multiples of a half hour.
def _json(salle="salle"):
    hours = "CASE WHEN duree = floor(duree) THEN CAST(CAST(duree AS INTEGER) AS VARCHAR) ELSE CAST(duree AS VARCHAR) END"
    parts = [
        ("Année universitaire", "academic_year"), ("Durée", hours), ("Filière", "filiere"),
        ("Groupe", "groupe"), ("Horaire", "horaire"), ("Jour", "jour"), ("Matière", "matiere"),
        ("Niveau", "niveau"), ("Nom et prénom", "enseignant"), ("Salle", salle), ("Type", "type_seance"),
    ]
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":\"' || {v} || '\"'" for k, v in parts) + " || '}'"


_QUARTERS = " || ':' || ".join(
    f"CAST(sum(CAST('0x' || substr(d, {16 * i + 1}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4)
)
_DIGEST = f"sha256(CAST(count(*) AS VARCHAR) || ':' || {_QUARTERS})"
PRINTS = f"""
rowd AS (SELECT *, sha256({_json()}) AS d FROM sessions),
prints AS (SELECT version_id, count(*) AS sessions_count, {_DIGEST} AS source_hash FROM rowd GROUP BY version_id),
catalog AS (SELECT v.*, p.source_hash FROM versions v JOIN prints p USING (version_id)),
"""


def catalog(spark, folder):
    prints = fingerprints.content_fingerprint(views.sessions(spark, folder), ["version_id"])
    return views.versions(spark, folder).join(prints.drop("sessions_count"), "version_id")


@query("a30_record_digest", f"SELECT session_id, sha256({_json()}) AS digest FROM sessions", MODEL)
def record_digest(spark, folder):
    return views.sessions(spark, folder).select("session_id", fingerprints.row_digest().alias("digest"))


@query("e1_content_fingerprint", "SELECT * FROM prints", MODEL + PRINTS)
def content_fingerprint(spark, folder):
    return fingerprints.content_fingerprint(views.sessions(spark, folder), ["version_id"])


def draft_batch(spark, folder):
    """Sessions of the active versions: S1 with rooms renamed, S2 without a semester."""
    active = views.versions(spark, folder).filter("is_active = 1").select("version_id")
    s = views.sessions(spark, folder).join(active, "version_id", "left_semi")
    return s.withColumn(
        "salle", F.when(F.col("niveau") == "S1", F.upper("salle")).otherwise(F.col("salle"))
    ).withColumn("niveau", F.when(F.col("niveau") == "S2", "").otherwise(F.col("niveau")))


_DRAFT = f"""
draft0 AS (
  SELECT s.* REPLACE (CASE WHEN niveau = 'S1' THEN upper(salle) ELSE salle END AS salle,
    CASE WHEN niveau = 'S2' THEN '' ELSE niveau END AS niveau, CASE WHEN niveau = 'S2' THEN '' ELSE period END AS period)
  FROM sessions s WHERE version_id IN (SELECT version_id FROM versions WHERE is_active = 1)),
draftd AS (SELECT *, sha256({_json()}) AS d FROM draft0),
draft AS (SELECT academic_year, period, filiere, niveau, count(*) AS sessions_count, {_DIGEST} AS source_hash FROM draftd GROUP BY ALL),
decided AS (
  SELECT academic_year, period, filiere, niveau, sessions_count, source_hash,
    CASE WHEN niveau = '' THEN 'skipped' WHEN same IS NOT NULL THEN 'duplicate' ELSE 'created' END AS status,
    CASE WHEN niveau = '' THEN NULL WHEN same IS NOT NULL THEN same ELSE coalesce(last, 0) + 1 END AS version_number
  FROM (SELECT d.*,
      (SELECT max(version_number) FROM catalog c WHERE c.academic_year = d.academic_year AND c.period = d.period AND c.filiere = d.filiere AND c.niveau = d.niveau AND c.source_hash = d.source_hash) AS same,
      (SELECT max(version_number) FROM catalog c WHERE c.academic_year = d.academic_year AND c.period = d.period AND c.filiere = d.filiere AND c.niveau = d.niveau) AS last
    FROM draft d)),
"""


@query(
    "e2_assign_versions",
    """SELECT academic_year, period, filiere, niveau, status, version_number, sessions_count, source_hash,
    CASE status WHEN 'skipped' THEN 'Mémoire automatique suspendue : semestre, période manquant(e)(s).'
      WHEN 'duplicate' THEN 'Déjà mémorisé : V' || version_number || '.' ELSE 'V' || version_number || ' mémorisée automatiquement.' END AS message
    FROM decided""",
    MODEL + PRINTS + _DRAFT,
)
def assign_versions(spark, folder):
    return V.assign_versions(draft_batch(spark, folder), catalog(spark, folder)).drop("timetable_id", "version_id")


@query(
    "e2_versions_after",
    """SELECT filiere, niveau, version_number,
      CASE WHEN niveau = 'S1' THEN 0 ELSE is_active END AS is_active, CASE WHEN niveau = 'S1' THEN 'Archivée' ELSE status END AS status FROM catalog
    UNION ALL SELECT filiere, niveau, version_number, 1, 'Active' FROM decided WHERE status = 'created'""",
    MODEL + PRINTS + _DRAFT,
)
def versions_after(spark, folder):
    stored = catalog(spark, folder)
    decided = V.assign_versions(draft_batch(spark, folder), stored)
    return V.versions_after(stored, decided, F.lit("2024-03-01")).select(
        "filiere", "niveau", "version_number", "is_active", "status"
    )


@query(
    "e3_get_or_create_timetables",
    "SELECT timetable_id, academic_year, period, filiere, niveau FROM timetables",
    MODEL,
)
def get_or_create(spark, folder):
    t = views.timetables(spark, folder)
    return V.get_or_create_timetables(t, t.filter("period = 'Automne'"))


@query(
    "e4_reconcile_fingerprints",
    "SELECT version_id, source_hash, version_number <> 2 AS rehashed FROM catalog",
    MODEL + PRINTS,
)
def reconcile_fingerprints(spark, folder):
    old = catalog(spark, folder).withColumn(
        "source_hash",
        F.when(F.col("version_number") == 2, F.col("source_hash")).otherwise(F.md5("source_hash")),
    )
    return V.reconcile_fingerprints(old, views.sessions(spark, folder)).select(
        "version_id", "source_hash", "rehashed"
    )


@query(
    "e5_list_timetables",
    """SELECT t.timetable_id, t.academic_year, t.period, t.filiere, t.niveau, count(v.version_id) AS versions,
      max(CASE WHEN is_active = 1 THEN version_number END) AS version_active
    FROM timetables t LEFT JOIN (SELECT * FROM versions WHERE period = 'Automne') v USING (timetable_id) GROUP BY ALL""",
    MODEL,
)
def list_timetables(spark, folder):
    some = views.versions(spark, folder).filter("period = 'Automne'")
    return V.list_timetables(views.timetables(spark, folder), some)


@query(
    "e6_list_versions",
    """SELECT version_id, 'V' || version_number AS version, imported_at AS date_import, status AS statut,
      CASE WHEN is_active = 1 THEN '✅' ELSE '' END AS active, sessions_count AS seances,
      'semaine' || version_number || '.pdf, annexe.pdf' AS documents, comment AS commentaire FROM versions""",
    MODEL,
)
def list_versions(spark, folder):
    return V.list_versions(views.versions(spark, folder))


@query(
    "e6_version_ids",
    """SELECT t.timetable_id, n.version_number, v.version_id FROM timetables t CROSS JOIN (SELECT unnest([2, 99]) AS version_number) n
    LEFT JOIN versions v ON v.timetable_id = t.timetable_id AND v.version_number = n.version_number""",
    MODEL,
)
def version_ids(spark, folder):
    wanted = views.timetables(spark, folder).select(
        "timetable_id", F.explode(F.array(F.lit(2), F.lit(99))).alias("version_number")
    )
    return V.version_ids(views.versions(spark, folder), wanted)


def _activations(spark, folder):
    """Every session event asks for its own version; every seventh names a foreign one."""
    return views.sessions(spark, folder).select(
        "timetable_id",
        F.when(F.col("session_id") % 7 == 0, F.col("version_id") + 1).otherwise(F.col("version_id")).alias("version_id"),
        # Requests arrive newest version first within a day of the week.
        ((F.col("session_id") * 7919) % 1000003).alias("rang"),
    )


_ASKED = """
asked AS (SELECT timetable_id, version_id, (session_id * 7919) % 1000003 AS rang FROM sessions WHERE session_id % 7 <> 0),
target AS (SELECT timetable_id, arg_max(version_id, rang) AS target FROM asked GROUP BY 1),
"""


@query(
    "e7_active_versions",
    """SELECT v.version_id, CASE WHEN t.target = v.version_id THEN 1 ELSE 0 END AS is_active,
      CASE WHEN t.target = v.version_id THEN 'Active' ELSE 'Archivée' END AS status
    FROM versions v JOIN target t USING (timetable_id)""",
    MODEL + _ASKED,
)
def active_versions(spark, folder):
    return V.active_versions(views.versions(spark, folder), _activations(spark, folder), "rang").select(
        "version_id", "is_active", "status"
    )


@query("e7_rejected_activations", "SELECT timetable_id, version_id + 1 AS version_id FROM sessions WHERE session_id % 7 = 0", MODEL)
def rejected_activations(spark, folder):
    return V.rejected_activations(views.versions(spark, folder), _activations(spark, folder)).drop("rang")


@query(
    "e8_resolve_active",
    "SELECT academic_year, filiere, niveau, version_id, version_number FROM versions WHERE is_active = 1",
    MODEL,
)
def resolve_active(spark, folder):
    # Half the timetables lose their flag and must fall back to the latest version.
    v = views.versions(spark, folder).withColumn(
        "is_active", F.when(F.col("niveau").isin("S1", "S2", "S3"), 0).otherwise(F.col("is_active"))
    ).withColumn("filiere", F.concat(F.lit(" "), F.lower("filiere")))
    return V.resolve_active(v)


def _some_version(spark, folder):
    """The id of the first IAID version, known from its natural key alone."""
    key = ["2023/2024", "Automne", "IAID", "S1", "1"]
    row = spark.range(1).select(views.hashed_id(*[F.lit(k) for k in key])).first()
    return row[0]


@query(
    "e9_version_sessions",
    "SELECT jour, horaire, matiere, enseignant, salle, session_id FROM sessions WHERE filiere = 'IAID' AND niveau = 'S1' AND version_number = 1",
    MODEL,
)
def version_sessions(spark, folder):
    return V.version_sessions(views.stored_sessions(spark, folder), _some_version(spark, folder)).select(
        "jour", "horaire", "matiere", "enseignant", "salle", "session_id"
    )


@query(
    "e10_save_state",
    """SELECT academic_year, period, filiere, niveau,
      CASE status WHEN 'skipped' THEN 'incomplete' WHEN 'duplicate' THEN 'saved' ELSE 'unsaved' END AS status,
      CASE WHEN status = 'duplicate' THEN version_number END AS version_number, CASE WHEN status = 'duplicate' THEN 1 END AS is_active
    FROM decided""",
    MODEL + PRINTS + _DRAFT,
)
def save_state(spark, folder):
    draft = V.keyed(draft_batch(spark, folder))
    return V.save_state(draft, draft, catalog(spark, folder))


@query(
    "e12_previous_version",
    """SELECT timetable_id, version_id, version_number, lag(version_id) OVER w AS from_version_id, lag(version_number) OVER w AS from_version_number,
      lag(version_id) OVER w IS NULL AS baseline FROM versions WINDOW w AS (PARTITION BY timetable_id ORDER BY version_number)""",
    MODEL,
)
def previous_version(spark, folder):
    return V.previous_version(views.versions(spark, folder))


@query(
    "e12_archive_changes",
    "SELECT to_version_id, change_type, count(*) AS n FROM change_rows GROUP BY ALL",
    CHANGES,
)
def archive_changes(spark, folder):
    rows = views.change_rows(spark, folder)
    stale = rows.withColumn("change_type", F.lit("added"))
    return V.archive_changes(stale, rows).groupBy("to_version_id", "change_type").agg(
        F.count(F.lit(1)).alias("n")
    )


_SUM = lambda p: f"concat_ws(' | ', nullif({p}_jour, ''), nullif({p}_horaire, ''), nullif({p}_salle, ''), nullif({p}_enseignant, ''))"


@query(
    "e13_changes_report",
    f"""SELECT to_version_id, CASE change_type WHEN 'modified' THEN '🟠 Modifiée' WHEN 'added' THEN '🟢 Ajoutée' ELSE '🔴 Supprimée' END AS changement,
      CASE change_type WHEN 'modified' THEN 1 WHEN 'added' THEN 2 ELSE 3 END AS ordre,
      coalesce(new_matiere, old_matiere) AS matiere, coalesce(new_enseignant, old_enseignant) AS enseignant,
      coalesce(new_type_seance, old_type_seance) AS type_seance, coalesce(new_groupe, old_groupe) AS groupe,
      fields AS champs_modifies, {_SUM('old')} AS avant, {_SUM('new')} AS apres FROM change_rows""",
    CHANGES,
)
def changes_report(spark, folder):
    return diff.changes_report(views.change_rows(spark, folder))


@query(
    "e14_change_summary",
    """SELECT to_version_id, v.version_number - 1 AS previous_version_number, unchanged_count AS unchanged, modified_count AS modified,
      added_count AS added, removed_count AS removed, created_at FROM change_summary c JOIN versions v ON v.version_id = c.to_version_id""",
    SUMMARY,
)
def change_summary(spark, folder):
    return V.change_summary_for(views.change_summary(spark, folder), views.versions(spark, folder))


@query(
    "e15_backfill_versions",
    """SELECT c.version_id, c.is_active, c.status, c.sessions_count, c.source_hash, d.docs AS source_documents
    FROM catalog c JOIN (SELECT version_id, '["' || string_agg(source_document, '","' ORDER BY source_document) || '"]' AS docs
      FROM (SELECT DISTINCT version_id, source_document FROM sessions) GROUP BY 1) d USING (version_id)""",
    MODEL + PRINTS,
)
def backfill_versions(spark, folder):
    bare = views.versions(spark, folder).select("timetable_id", "version_id", "version_number")
    return V.backfill_versions(bare, views.sessions(spark, folder)).select(
        "version_id", "is_active", "status", "sessions_count", "source_hash", "source_documents"
    )


def _corrections(spark, folder):
    """Each session asks for something: a room, a wrong duration, nothing, a foreign session."""
    s = views.sessions(spark, folder)
    turn = F.col("session_id") % 5
    return s.select(
        "version_id",
        F.when(turn == 3, -F.col("session_id") - 1).otherwise(F.col("session_id")).alias("session_id"),
        F.when(turn == 0, "Salle Z").alias("salle"),
        F.when(turn == 0, "09:00-11:00").alias("horaire"),
        F.when(turn == 1, "deux heures").when(turn == 4, "2,5").alias("duree"),
        *[F.lit(None).cast("string").alias(c) for c in ("jour", "matiere", "enseignant", "type_seance", "groupe")],
    )


_VERDICTS = """
verdicts AS (
  SELECT s.*, v.is_active,
    CASE WHEN session_id % 5 = 3 THEN 'wrong_session' WHEN session_id % 5 = 1 THEN 'invalid_duration'
      WHEN session_id % 5 = 2 OR (session_id % 5 = 4 AND duree = 2.5) THEN 'no_changes'
      WHEN v.is_active <> 1 THEN 'stale_base' ELSE 'accepted' END AS verdict
  FROM sessions s JOIN versions v USING (version_id)),
"""


@query(
    "e16_prepare_corrections",
    """SELECT version_id, CASE WHEN session_id % 5 = 3 THEN -session_id - 1 ELSE session_id END AS session_id, verdict,
      CASE WHEN verdict IN ('wrong_session', 'invalid_duration', 'no_changes') THEN ''
        WHEN session_id % 5 = 0 THEN 'Horaire:' || horaire || '>09:00-11:00, Salle:' || salle || '>Salle Z'
        ELSE 'Durée:' || CAST(duree AS VARCHAR) || '>2.5' END AS changed FROM verdicts""",
    MODEL + _VERDICTS,
)
def prepare_corrections(spark, folder):
    out = V.prepare_corrections(
        views.sessions(spark, folder), views.versions(spark, folder), _corrections(spark, folder)
    )
    shown = F.array_join(
        F.transform("changed", lambda x: F.concat(x["label"], F.lit(":"), x["before"], F.lit(">"), x["after"])), ", "
    )
    listed = F.when(F.col("verdict").isin("accepted", "stale_base"), shown).otherwise("")
    return out.withColumn("changed", listed)


@query(
    "e16_correct_sessions",
    """SELECT session_id, version_id AS base_version_id,
      CASE WHEN verdict = 'accepted' AND session_id % 5 = 0 THEN 'Salle Z' ELSE salle END AS salle,
      CASE WHEN verdict = 'accepted' AND session_id % 5 = 0 THEN '09:00-11:00' ELSE horaire END AS horaire,
      CASE WHEN verdict = 'accepted' AND session_id % 5 = 4 THEN 2.5 ELSE duree END AS duree, jour, enseignant
    FROM verdicts WHERE version_id IN (SELECT version_id FROM verdicts WHERE verdict = 'accepted')""",
    MODEL + _VERDICTS,
)
def correct_sessions(spark, folder):
    return V.correct_sessions(
        views.sessions(spark, folder), views.versions(spark, folder), _corrections(spark, folder)
    ).select("session_id", "base_version_id", "salle", "horaire", "duree", "jour", "enseignant")


@query(
    "e17_validate_targets",
    "SELECT timetable_id, version_id, session_id, v.version_number, v.is_active, jour, salle FROM sessions s JOIN versions v USING (timetable_id, version_id) WHERE session_id % 4 = 0",
    MODEL,
)
def validate_targets(spark, folder):
    s = views.sessions(spark, folder)
    turn = F.col("session_id") % 4
    targets = s.select(
        F.when(turn == 1, F.col("timetable_id") + 1).otherwise(F.col("timetable_id")).alias("timetable_id"),
        F.when(turn == 2, F.col("version_id") + 1).otherwise(F.col("version_id")).alias("version_id"),
        F.when(turn == 3, -F.col("session_id")).otherwise(F.col("session_id")).alias("session_id"),
    )
    return V.validate_targets(targets, views.stored_sessions(spark, folder), views.versions(spark, folder)).select(
        "timetable_id", "version_id", "session_id", "version_number", "is_active", "jour", "salle"
    )


@query(
    "e18_programme_subsets",
    """SELECT filiere, niveau, '2023/2024' AS default_year, filiere || ' — ' || niveau AS label
    FROM (SELECT DISTINCT filiere, niveau FROM sessions)""",
    MODEL,
)
def programme_subsets(spark, folder):
    s = views.sessions(spark, folder).withColumn(
        "academic_year", F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("academic_year"))
    )
    return V.programme_subsets(s)
