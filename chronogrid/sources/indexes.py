"""Joined read models of the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folding import text
from ..skew import look_up
from .conform import conform

VERSION_LAYOUT = (
    "version_id bigint, timetable_id bigint, version_number int, imported_at string, "
    "is_active int, status string, source_documents string, comment string, sessions_count bigint"
)
VERSION_DEFAULTS = {
    "is_active": 0, "status": "", "source_documents": "", "comment": "", "sessions_count": 0,
}
TIMETABLE_KEY = ["academic_year", "period", "filiere", "niveau"]
SESSION_TEXT = [
    "jour", "horaire", "matiere", "type_seance", "enseignant", "groupe", "salle",
    "source_document", "page",
]


def _versions(versions: DataFrame) -> DataFrame:
    return conform(versions, VERSION_LAYOUT, VERSION_DEFAULTS)


def load_versions_index(versions: DataFrame, timetables: DataFrame) -> DataFrame:
    return _versions(versions).join(timetables.select("timetable_id", *TIMETABLE_KEY), "timetable_id")


def load_sessions_index(
    sessions: DataFrame, versions: DataFrame, timetables: DataFrame
) -> DataFrame:
    """Sessions with their version and timetable; blanks filled, unreadable hours 0.

    Versions and timetables are joined to each other first, so the facts pass one join
    whose other side is broadcast by its counted rows.
    """
    dims = load_versions_index(versions, timetables).select(
        "version_id", "timetable_id", "version_number", "is_active",
        F.col("status").alias("version_status"), F.col("comment").alias("version_comment"),
        *[F.trim(text(c)).alias(c) for c in TIMETABLE_KEY],
    )
    facts = sessions.select(
        "session_id",
        "version_id",
        *[F.trim(text(c)).alias(c) for c in SESSION_TEXT],
        F.coalesce(text("duree").try_cast("double"), F.lit(0.0)).alias("duree"),
    )
    return look_up(facts, dims, "version_id")


def load_change_summary_index(
    summaries: DataFrame, versions: DataFrame, timetables: DataFrame
) -> DataFrame:
    dims = load_versions_index(versions, timetables).select(
        F.col("version_id").alias("to_version_id"), "version_number", "timetable_id", *TIMETABLE_KEY
    )
    return summaries.join(dims, "to_version_id").orderBy("created_at", "version_number")
