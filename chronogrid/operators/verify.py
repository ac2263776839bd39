"""Session-by-session verification tracking (F1-F8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.folding import clean_ws
from ..skew import blank, in_order
from .versions import resolve_active
from .workload import PROGRAMMES

VERIFIED, REVIEW, PENDING = "verified", "review", "pending"
ESSENTIALS = {
    "jour": "Jour", "horaire": "Horaire", "matiere": "Matière", "enseignant": "Enseignant",
    "salle": "Salle",
}
SESSION_TEXT = [
    "jour", "horaire", "matiere", "type_seance", "enseignant", "groupe", "salle", "duree",
    "source_document", "page",
]
WALK = ["program_order", "_day", "horaire", "matiere", "enseignant", "session_id"]


def programme_order(spark) -> DataFrame:
    """The 24 programmes in checking order: all of S1, then all of S3."""
    rows = [(f, n) for n in ("S1", "S3") for f in PROGRAMMES]
    return spark.createDataFrame(
        [(i, f, n) for i, (f, n) in enumerate(rows)], "program_order int, filiere string, niveau string"
    )


def latest_status(events: DataFrame, order: str) -> DataFrame:
    """Last status per session; the verification time only stands while verified."""
    last = F.max_by(F.struct("status", "note", F.col(order).alias("at")), order)
    return (
        events.groupBy("version_id", "session_id")
        .agg(last.alias("s"))
        .select(
            "version_id",
            "session_id",
            "s.status",
            clean_ws("s.note").alias("note"),
            F.when(F.col("s.status") == VERIFIED, F.col("s.at")).alias("verified_at"),
            F.col("s.at").alias("updated_at"),
        )
    )


def _ordered(sessions: DataFrame) -> DataFrame:
    """Position among all sessions and within the programme, in checking order."""
    day = keys.day_order("jour", 99)
    ranged = in_order(sessions.withColumn("_day", day), [F.col(c) for c in WALK])
    inside = Window.partitionBy("_range").orderBy(*WALK)
    placed = ranged.withColumn("position", F.col("_before") + F.row_number().over(inside))
    first = placed.groupBy("program_order").agg(
        F.min("position").alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    return (
        placed.join(F.broadcast(first), "program_order")  # one row per programme of the fixed list
        .withColumn("local_position", F.col("position") - F.col("_first") + 1)
        .withColumn("session_order", F.col("local_position") - 1)
        .withColumnRenamed("_size", "local_total")
        .withColumnRenamed("_all", "total")
        .drop("_first", "_before", "_day")
    )


def verification_worklist(
    versions: DataFrame, sessions: DataFrame, statuses: DataFrame, academic_year: str
) -> DataFrame:
    """Sessions of each programme's active version with their status, in checking order.

    A programme without any version stays as one flagged row.
    """
    order = programme_order(versions.sparkSession)
    resolved = resolve_active(versions, academic_year).drop("academic_year")
    wanted = F.broadcast(order).join(resolved, ["filiere", "niveau"], "left")
    missing = wanted.filter("version_id is null").select("program_order", "filiere", "niveau")
    facts = sessions.select("version_id", "session_id", *[clean_ws(c).alias(c) for c in SESSION_TEXT])
    status = statuses.select(
        "version_id", "session_id", clean_ws("status").alias("_status"),
        clean_ws("note").alias("verification_note"), "verified_at",
    )
    known = F.coalesce(F.col("_status"), F.lit(""))
    listed = (
        wanted.filter("version_id is not null")
        .join(facts, "version_id")
        .join(status, ["version_id", "session_id"], "left")
        .withColumn("verification_status", F.when(known == "", PENDING).otherwise(known))
        .withColumn("verification_note", F.coalesce("verification_note", F.lit("")))
        .drop("_status")
    )
    return (
        _ordered(listed)
        .drop("_range")
        .withColumn("missing_timetable", F.lit(False))
        .unionByName(missing.withColumn("missing_timetable", F.lit(True)), allowMissingColumns=True)
    )


def progress(worklist: DataFrame) -> DataFrame:
    """Counts per programme and, on the row without a programme, over all of them."""
    has = F.col("session_id").isNotNull()
    count = lambda s: F.count_if(has & (F.col("verification_status") == s))
    programme = F.struct("program_order", "filiere", "niveau").alias("programme")
    counted = (
        worklist.select(programme, "session_id", "verification_status", "missing_timetable")
        .rollup("programme")
        .agg(
            count(VERIFIED).alias("verified"),
            count(REVIEW).alias("review"),
            F.count_if(has).alias("total"),
            F.bool_or("missing_timetable").alias("_missing"),
        )
    )
    state = (
        F.when(F.col("_missing") & (F.col("total") == 0), "missing")
        .when((F.col("total") > 0) & (F.col("verified") == F.col("total")), "done")
        .when(F.col("review") > 0, "review")
        .otherwise("pending")
    )
    return counted.select(
        F.col("programme.program_order").alias("program_order"),
        F.col("programme.filiere").alias("filiere"),
        F.col("programme.niveau").alias("niveau"),
        "verified",
        "review",
        (F.col("total") - F.col("verified") - F.col("review")).alias("pending"),
        "total",
        state.alias("state"),
    )


def positions(worklist: DataFrame) -> DataFrame:
    """Where to go from each session: previous, next, and next unverified with wrap-around.

    The next unverified session is looked for in the row's own range first, then among
    the first ones of the later ranges, then from the start.
    """
    rows = worklist.filter(F.col("session_id").isNotNull()).select(
        "program_order", "version_id", "session_id", "position", "local_position", "local_total",
        "total", "verification_status",
    )
    ranged = in_order(rows, [F.col("position")]).drop("_before", "_all")
    open_at = F.when(F.col("verification_status") != VERIFIED, F.col("position"))
    following = Window.partitionBy("_range").orderBy("position").rowsBetween(1, Window.unboundedFollowing)
    later = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    firsts = ranged.groupBy("_range").agg(F.min(open_at).alias("_open")).select(
        "_range",
        F.min("_open").over(later).alias("_later"),
        F.min("_open").over(Window.partitionBy()).alias("_any"),
    )
    return (
        ranged.join(F.broadcast(firsts), "_range")  # one row per range
        .withColumn("_here", F.min(open_at).over(following))
        .select(
            "session_id", "position", "local_position", "local_total", "total",
            F.greatest(F.col("position") - 1, F.lit(1)).alias("previous_position"),
            F.least(F.col("position") + 1, F.col("total")).alias("next_position"),
            F.coalesce("_here", "_later", "_any", "position").alias("next_unverified"),
        )
    )


def start_position(worklist: DataFrame) -> DataFrame:
    """Where checking starts: the first session not verified yet, else the first one."""
    open_at = F.when(F.col("verification_status") != VERIFIED, F.col("position"))
    return worklist.agg(F.coalesce(F.min(open_at), F.min("position")).alias("position"))


def review_list(worklist: DataFrame) -> DataFrame:
    return worklist.filter(F.col("verification_status") == REVIEW).select(
        "filiere", "niveau", F.concat(F.lit("V"), "version_number").alias("version"),
        "jour", "horaire", "matiere", "enseignant", "salle",
        F.col("verification_note").alias("note"), "position",
    )


def missing_essentials(rows: DataFrame) -> DataFrame:
    """Labels of the essential fields a session lacks; complete sessions are left out."""
    lacking: Column = F.filter(
        F.array(*[F.when(blank(c), F.lit(label)) for c, label in ESSENTIALS.items()]),
        lambda x: x.isNotNull(),
    )
    return (
        rows.filter(F.col("session_id").isNotNull())
        .select("session_id", lacking.alias("_l"))
        .filter(F.size("_l") > 0)
        .select("session_id", F.array_join("_l", ", ").alias("manquants"))
    )


def reset_year(statuses: DataFrame, versions: DataFrame, academic_year: str) -> DataFrame:
    """Statuses without those of the versions currently shown for a year."""
    order = programme_order(versions.sparkSession)
    shown = resolve_active(versions, academic_year).join(F.broadcast(order), ["filiere", "niveau"], "left_semi")
    return statuses.join(shown.select("version_id"), "version_id", "left_anti")


def academic_years(timetables: DataFrame) -> DataFrame:
    return (
        timetables.select(clean_ws("academic_year").alias("academic_year"))
        .filter("academic_year <> ''")
        .distinct()
        .orderBy(F.desc("academic_year"))
    )
