"""Files handed out to users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extras import extras_json
from ..operators.workload import teacher_workload


def write_version_export(
    sessions: DataFrame, versions: DataFrame, version_id: int, folder: str
) -> str | None:
    """Workload and detailed sessions of one version; None when it holds no session."""
    found = versions.filter(F.col("version_id") == version_id).select("timetable_id", "version_number").head(1)
    if not found:
        raise ValueError("Version introuvable : export impossible.")
    name = f"{folder}/EDT_{found[0].timetable_id}_V{found[0].version_number}"
    chosen = sessions.filter(F.col("version_id") == version_id)
    if chosen.isEmpty():
        return None
    write = lambda df, part: df.write.mode("overwrite").option("header", True).csv(f"{name}/{part}")
    write(teacher_workload(chosen).drop("ord"), "intervenants")
    write(chosen.drop("version_id"), "details")
    return name


def write_people_export(people: DataFrame, conflicts: DataFrame, unknown: DataFrame, folder: str) -> None:
    """People, conflicts and unknown headers as semicolon files."""
    flat = people.withColumn("extras", extras_json(F.col("extras")))
    for part, df in {"enseignants": flat, "conflits": conflicts, "colonnes": unknown}.items():
        df.write.mode("overwrite").option("header", True).option("sep", ";").csv(f"{folder}/{part}")
