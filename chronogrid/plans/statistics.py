"""Queries over dashboards and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..sources import indexes
from . import views
from .registry import query

MODEL, SUMMARY = views.SQL_MODEL, views.SQL_WITH_SUMMARY
INDEX = (
    SUMMARY
    + """
index_s AS (SELECT s.*, v.is_active FROM sessions s JOIN versions v USING (version_id)),
changes AS (
  SELECT c.*, v.version_number, v.academic_year, v.period, v.filiere, v.niveau,
    modified_count + added_count + removed_count AS total
  FROM change_summary c JOIN versions v ON v.version_id = c.to_version_id),
"""
)


def sessions_index(spark, folder):
    return indexes.load_sessions_index(
        views.stored_sessions(spark, folder), views.versions(spark, folder), views.timetables(spark, folder)
    )


def changes_index(spark, folder):
    return indexes.load_change_summary_index(
        views.change_summary(spark, folder), views.versions(spark, folder), views.timetables(spark, folder)
    )


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(
    "d6_scope_active",
    "SELECT session_id, filiere, niveau, is_active FROM index_s WHERE period = 'Automne' AND filiere = 'ILCS' AND is_active = 1",
    INDEX,
)
def scope_active(spark, folder):
    chosen = {"academic_year": "Tous", "period": "Automne", "filiere": "ILCS"}
    return stats.scope(sessions_index(spark, folder), chosen, active_only=True).select(
        "session_id", "filiere", "niveau", "is_active"
    )


@query(
    "d7_filter_options",
    "SELECT 0 AS rang, 'Tous' AS valeur UNION ALL SELECT DISTINCT 1, salle FROM sessions WHERE salle <> ''",
    MODEL,
)
def filter_options(spark, folder):
    return stats.filter_options(views.sessions(spark, folder), "salle")


@query(
    "d8_overview_kpis",
    """SELECT s.*, v.versions, c.changements FROM
    (SELECT count(*) AS seances, sum(duree) AS heures, count(DISTINCT nullif(enseignant, '')) AS enseignants,
      count(DISTINCT nullif(salle, '')) AS salles, count(DISTINCT matiere) AS matieres,
      count(DISTINCT filiere || '|' || niveau) AS programmes FROM index_s WHERE is_active = 1) s,
    (SELECT count(*) AS versions FROM versions WHERE is_active = 1) v,
    (SELECT CAST(sum(total) AS BIGINT) AS changements FROM changes) c""",
    INDEX,
)
def overview_kpis(spark, folder):
    return stats.overview_kpis(
        stats.scope(sessions_index(spark, folder), {}, True),
        stats.scope(views.versions(spark, folder), {}, True),
        changes_index(spark, folder),
    )


@query(
    "d9_day_activity",
    f"SELECT jour, count(*) AS seances, round(sum(duree), 2) AS heures, list_position([{views._DAYS}], jour) AS ordre FROM sessions GROUP BY jour",
    MODEL,
)
def day_activity(spark, folder):
    return stats.day_activity(views.sessions(spark, folder))


@query(
    "d10_programme_activity",
    "SELECT filiere, niveau, count(*) AS seances, filiere || ' ' || niveau AS programme FROM sessions GROUP BY ALL ORDER BY seances DESC, filiere, niveau LIMIT 15",
    MODEL,
)
def programme_activity(spark, folder):
    return stats.programme_activity(views.sessions(spark, folder))


def _load_sql(by, **distinct):
    counts = "".join(f", count(DISTINCT {c}) AS {n}" for n, c in distinct.items())
    return f"SELECT {by}, count(*) AS seances, round(sum(duree), 2) AS heures{counts} FROM sessions WHERE {by} <> '' GROUP BY {by}"


TEACHERS = _load_sql("enseignant", matieres="matiere", filieres="filiere")
ROOMS = _load_sql("salle", enseignants="enseignant", matieres="matiere")
SUBJECTS = _load_sql("matiere", enseignants="enseignant")


@query("d11_teacher_load", TEACHERS, MODEL)
def teacher_load(spark, folder):
    return stats.teacher_load(views.sessions(spark, folder))


@query("d11_top_teachers_by_hours", TEACHERS + " ORDER BY heures DESC, enseignant LIMIT 15", MODEL)
def top_teachers_hours(spark, folder):
    return stats.top(stats.teacher_load(views.sessions(spark, folder)), "heures", "enseignant")


@query("d11_top_teachers_by_sessions", TEACHERS + " ORDER BY seances DESC, enseignant LIMIT 15", MODEL)
def top_teachers_sessions(spark, folder):
    return stats.top(stats.teacher_load(views.sessions(spark, folder)), "seances", "enseignant")


@query("d12_room_usage", ROOMS, MODEL)
def room_usage(spark, folder):
    return stats.room_usage(views.sessions(spark, folder))


@query("d12_top_rooms", ROOMS + " ORDER BY seances DESC, salle LIMIT 15", MODEL)
def top_rooms(spark, folder):
    return stats.top(stats.room_usage(views.sessions(spark, folder)), "seances", "salle")


@query("d13_subject_load", SUBJECTS, MODEL)
def subject_load(spark, folder):
    return stats.subject_load(views.sessions(spark, folder))


@query("d13_top_subjects", SUBJECTS + " ORDER BY heures DESC, matiere LIMIT 15", MODEL)
def top_subjects(spark, folder):
    return stats.top(stats.subject_load(views.sessions(spark, folder)), "heures", "matiere")


@query(
    "d14_type_distribution",
    "SELECT CASE WHEN type_seance = '' THEN 'Non précisé' ELSE type_seance END AS type, count(*) AS seances FROM sessions GROUP BY 1",
    MODEL,
)
def type_distribution(spark, folder):
    return stats.type_distribution(views.sessions(spark, folder))


@query(
    "d15_versions_per_programme",
    "SELECT filiere, niveau, count(*) AS versions, filiere || ' ' || niveau AS programme FROM versions GROUP BY ALL ORDER BY versions DESC, filiere, niveau LIMIT 20",
    MODEL,
)
def versions_per_programme(spark, folder):
    return stats.versions_per_programme(views.versions(spark, folder))


_LONG = """
long AS (
  SELECT filiere, niveau, version_number, 'Modifiées' AS type, modified_count AS nombre FROM changes
  UNION ALL SELECT filiere, niveau, version_number, 'Ajoutées', added_count FROM changes
  UNION ALL SELECT filiere, niveau, version_number, 'Supprimées', removed_count FROM changes),
"""


@query("d16_change_totals", "SELECT type, CAST(sum(nombre) AS BIGINT) AS nombre FROM long GROUP BY type", INDEX + _LONG)
def change_totals(spark, folder):
    return stats.change_totals(changes_index(spark, folder))


@query("d16_changes_long", "SELECT * FROM long", INDEX + _LONG)
def changes_long(spark, folder):
    return stats.changes_long(changes_index(spark, folder))


@query(
    "d16_changes_wide",
    'SELECT filiere, niveau, version_number, modified_count AS "Modifiées", added_count AS "Ajoutées", removed_count AS "Supprimées" FROM changes',
    INDEX,
)
def changes_wide(spark, folder):
    return stats.changes_wide(stats.changes_long(changes_index(spark, folder)))


@query(
    "d17_change_ranking",
    "SELECT filiere, niveau, CAST(sum(total) AS BIGINT) AS changements, filiere || ' ' || niveau AS programme FROM changes GROUP BY ALL",
    INDEX,
)
def change_ranking(spark, folder):
    return stats.change_ranking(changes_index(spark, folder))


@query(
    "d18_archive_counts",
    """SELECT 'sessions' AS table_name, count(*) AS lignes FROM sessions UNION ALL SELECT 'versions', count(*) FROM versions
    UNION ALL SELECT 'timetables', count(*) FROM timetables UNION ALL SELECT 'changes', count(*) FROM change_rows""",
    views.SQL_WITH_CHANGES,
)
def archive_counts(spark, folder):
    return stats.archive_counts(
        sessions=views.stored_sessions(spark, folder),
        versions=views.versions(spark, folder),
        timetables=views.timetables(spark, folder),
        changes=views.change_rows(spark, folder),
    )


@query(
    "d19_auto_insights",
    """SELECT * FROM (SELECT 'Jour le plus chargé' AS indicateur, jour AS valeur, printf('%d séances', count(*)) AS note FROM sessions GROUP BY jour ORDER BY count(*) DESC, jour LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'Charge la plus élevée', enseignant, printf('%.1f h', sum(duree)) FROM sessions WHERE enseignant <> '' GROUP BY enseignant ORDER BY sum(duree) DESC, enseignant LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'Salle la plus sollicitée', salle, printf('%d séances', count(*)) FROM sessions WHERE salle <> '' GROUP BY salle ORDER BY count(*) DESC, salle LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'Transition la plus mouvementée', printf('%s %s V%d', filiere, niveau, version_number), printf('%d changements', CAST(total AS BIGINT)) FROM changes WHERE total > 0 ORDER BY total DESC, filiere, niveau, version_number LIMIT 1)""",
    INDEX,
)
def auto_insights(spark, folder):
    return stats.auto_insights(views.sessions(spark, folder), changes_index(spark, folder))


@query(
    "d20_occupancy_heatmap",
    f"SELECT jour, horaire, count(*) AS seances, list_position([{views._DAYS}], jour) AS ordre FROM sessions GROUP BY ALL",
    MODEL,
)
def heatmap(spark, folder):
    return stats.occupancy_heatmap(views.sessions(spark, folder))


@query(
    "d20_occupancy_matrix",
    "SELECT horaire"
    + "".join(f", count(*) FILTER (WHERE jour = '{d}') AS \"{d}\"" for d in views.keys.WEEK_DAYS)
    + " FROM sessions GROUP BY horaire",
    MODEL,
)
def matrix(spark, folder):
    return stats.occupancy_matrix(stats.occupancy_heatmap(views.sessions(spark, folder)))


@query(
    "d21_iqr_outliers",
    """SELECT l.*, round(q1, 6) AS q1, round(mediane, 6) AS mediane, round(q3, 6) AS q3,
      round(greatest(0, q1 - 1.5 * (q3 - q1)), 6) AS borne_basse, round(q3 + 1.5 * (q3 - q1), 6) AS borne_haute,
      heures < greatest(0, q1 - 1.5 * (q3 - q1)) OR heures > q3 + 1.5 * (q3 - q1) AS atypique
    FROM loads l, (SELECT quantile_cont(heures, 0.25) AS q1, quantile_cont(heures, 0.5) AS mediane, quantile_cont(heures, 0.75) AS q3, count(*) AS n FROM loads) WHERE n >= 4""",
    MODEL + f"loads AS ({TEACHERS}),",
)
def iqr_outliers(spark, folder):
    out = stats.iqr_outliers(stats.teacher_load(views.sessions(spark, folder)))
    return rounded(out, "q1", "mediane", "q3", "borne_basse", "borne_haute")


def _pareto_sql(dim):
    return f"""
counts AS (SELECT {dim} AS valeur, count(*) AS seances FROM sessions WHERE {dim} <> '' GROUP BY 1),
shares AS (SELECT valeur, seances, 100.0 * sum(seances) OVER (ORDER BY seances DESC, valeur ROWS UNBOUNDED PRECEDING) / sum(seances) OVER () AS part_cumulee FROM counts),
"""


for _dim, _name in [("salle", "rooms"), ("enseignant", "teachers"), ("matiere", "subjects")]:

    @query(
        f"d22_pareto_{_name}",
        "SELECT valeur, seances, round(part_cumulee, 6) AS part_cumulee FROM shares",
        MODEL + _pareto_sql(_dim),
    )
    def pareto(spark, folder, dim=_dim):
        return rounded(stats.pareto(views.sessions(spark, folder), dim), "part_cumulee")


@query(
    "d22_pareto_size",
    "SELECT count(*) FILTER (WHERE part_cumulee <= 80) + CASE WHEN count(*) FILTER (WHERE part_cumulee <= 80) < count(*) THEN 1 ELSE 0 END AS n80, count(*) AS valeurs FROM shares",
    MODEL + _pareto_sql("enseignant"),
)
def pareto_size(spark, folder):
    return stats.pareto_size(stats.pareto(views.sessions(spark, folder), "enseignant"))


@query(
    "d23_control_chart",
    """SELECT row_number() OVER (ORDER BY created_at, filiere, niveau, version_number) AS rang, filiere, niveau, version_number, created_at,
      CAST(total AS DOUBLE) AS total, round(m, 6) AS moyenne, round(s, 6) AS ecart_type, round(m + 3 * s, 6) AS ucl,
      round(greatest(0, m - 3 * s), 6) AS lcl, total > m + 3 * s AS signal
    FROM changes, (SELECT avg(total) AS m, stddev_samp(total) AS s, count(*) AS n FROM changes) WHERE n >= 3""",
    INDEX,
)
def control_chart(spark, folder):
    return rounded(stats.control_chart(changes_index(spark, folder)), "moyenne", "ecart_type", "ucl", "lcl")


@query(
    "d24_stability_index",
    """SELECT academic_year, period, filiere, niveau, version_number, total AS changements, round(rate, 6) AS taux_changement, round(100.0 - rate, 6) AS stabilite
    FROM (SELECT *, CASE WHEN total + unchanged_count > 0 THEN 100.0 * total / (total + unchanged_count) ELSE 0 END AS rate FROM changes)
    ORDER BY rate DESC, academic_year, period, filiere, niveau, version_number LIMIT 20""",
    INDEX,
)
def stability_index(spark, folder):
    return rounded(stats.stability_index(changes_index(spark, folder)), "taux_changement", "stabilite")


_MISSING = " UNION ALL ".join(
    f"SELECT '{label}' AS champ, count(*) FILTER (WHERE trim({c}) = '') AS manquants, count(*) AS total FROM sessions"
    for c, label in stats.QUALITY_FIELDS.items()
)


@query(
    "d25_completeness",
    """SELECT champ, manquants, round(100.0 * manquants / total, 6) AS taux_manquant, round(100.0 - 100.0 * manquants / total, 6) AS completude,
    round(100.0 * (1.0 - sum(manquants) OVER () / (7.0 * total)), 6) AS score FROM missing""",
    MODEL + f"missing AS ({_MISSING}),",
)
def completeness(spark, folder):
    return rounded(stats.completeness(views.sessions(spark, folder)), "taux_manquant", "completude", "score")


@query(
    "b5_sessions_index",
    "SELECT session_id, version_id, version_number, is_active, timetable_id, period, filiere, niveau, jour, enseignant, salle, duree FROM index_s",
    INDEX,
)
def b5(spark, folder):
    return sessions_index(spark, folder).select(
        "session_id", "version_id", "version_number", "is_active", "timetable_id", "period", "filiere",
        "niveau", "jour", "enseignant", "salle", "duree",
    )


@query(
    "b6_versions_index",
    "SELECT version_id, timetable_id, version_number, imported_at, is_active, status, source_documents, comment, sessions_count, academic_year, period, filiere, niveau FROM versions",
    MODEL,
)
def b6(spark, folder):
    return indexes.load_versions_index(views.versions(spark, folder), views.timetables(spark, folder))


@query(
    "b7_change_summary_index",
    "SELECT from_version_id, to_version_id, unchanged_count, modified_count, added_count, removed_count, created_at, version_number, timetable_id, academic_year, period, filiere, niveau FROM change_summary c JOIN versions v ON v.version_id = c.to_version_id",
    SUMMARY,
)
def b7(spark, folder):
    return changes_index(spark, folder)
