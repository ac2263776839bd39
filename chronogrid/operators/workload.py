"""Teacher workload and its enrichment, completeness gate, document control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.folding import text
from ..skew import blank, keep_first

# --- fixed values ---
PROGRAMMES = [
    "IAID", "DAWM", "ILCS", "IDSD", "MGPDI", "FBTD", "WM", "MLT", "GCCD", "GITAM", "GEE", "RT",
]
REFERENCE_HEADERS = {
    "nom et prenom": "enseignant", "nom prenom": "enseignant", "enseignant": "enseignant",
    "nom": "enseignant", "statut": "statut", "tel": "tel", "telephone": "tel", "mobile": "tel",
    "email": "email", "mail": "email", "departement": "departement", "department": "departement",
}
FILLED_FROM_REFERENCE = ["statut", "tel", "email", "departement"]
REQUIRED = ["jour", "matiere", "enseignant", "horaire", "duree", "filiere", "niveau"]
NOMINAL_LOAD = (2.5, 3.5, 3.0)  # loads from .. to .. are recorded as ..


def teacher_workload(sessions: DataFrame, order: str = "ord") -> DataFrame:
    """Weekly load per teacher, programme, semester and subject.

    A day/time/group is counted once, hours add up within a group, and the load is the
    largest group's. All steps are aggregates with map-side combine, so neither a busy
    teacher nor a group of copies is gathered in one task.
    """
    given = text("duree")
    key = ["teacher_key", "filiere", "niveau", "subject_key"]
    rows = sessions.select(
        keys.ascii_key("enseignant").alias("teacher_key"),
        text("filiere").alias("filiere"),
        text("niveau").alias("niveau"),
        keys.ascii_key("matiere").alias("subject_key"),
        *[text(c).alias(c) for c in ("enseignant", "matiere", "jour", "horaire", "groupe")],
        (given != "").alias("given"),
        F.replace(given, F.lit(","), F.lit(".")).try_cast("double").alias("hours"),
        F.col(order).alias("_ord"),
    )
    first = lambda c, when=F.lit(True): F.min_by(c, F.when(when, F.col("_ord")))
    slots = rows.groupBy(*key, "jour", "horaire", "groupe").agg(
        first("hours", F.col("given")).alias("hours"),
        F.min("_ord").alias("_first"),
        first(F.struct("enseignant", "matiere")).alias("names"),
    )
    groups = slots.groupBy(*key, "groupe").agg(
        F.sum("hours").alias("hours"),
        F.min_by("names", "_first").alias("names"),
        F.min("_first").alias("_first"),
    )
    load = F.coalesce(F.max("hours"), F.lit(0.0))
    low, high, nominal = NOMINAL_LOAD
    return (
        groups.groupBy(*key)
        .agg(
            load.alias("ch"),
            F.min_by("names", "_first").alias("names"),
            F.min("_first").alias("ord"),
        )
        .select(
            F.col("names.enseignant").alias("enseignant"),
            F.lit("").alias("statut"),
            "filiere",
            "niveau",
            F.col("names.matiere").alias("matiere"),
            F.round(F.when(F.col("ch").between(low, high), nominal).otherwise(F.col("ch")), 2).alias("ch"),
            F.lit("").alias("tel"),
            F.lit("").alias("email"),
            F.lit("").alias("departement"),
            "ord",
        )
    )


def standard_reference(reference: DataFrame) -> DataFrame:
    """Rename a reference table's headers to the known names.

    Headers are metadata, so they are matched on the driver; the first header wins when
    two of them mean the same.
    """
    import re

    from ..functions.folding import fold_text

    picked: dict[str, str] = {}
    for name in reference.columns:
        plain = re.sub(r"^(?:PROF|PR|DR)\.?\s*", "", fold_text(name.strip().upper()))
        plain = re.sub(r"[^a-z0-9]+", " ", plain.lower()).strip()
        target = REFERENCE_HEADERS.get(plain)
        if target and target not in picked.values():
            picked[name] = target
    out = reference.select(*[F.col(f"`{n}`").alias(t) for n, t in picked.items()])
    for c in FILLED_FROM_REFERENCE:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(""))
    return out


def enrich_with_reference(workload: DataFrame, reference: DataFrame, order: str) -> DataFrame:
    """Fill blank contact fields from the first reference row with the same name tokens.

    The join side is left to the optimiser, which broadcasts by measured size.
    """
    ref = reference.select(
        keys.token_set_key("enseignant").alias("_key"),
        *[text(c).alias(f"ref_{c}") for c in FILLED_FROM_REFERENCE],
        F.col(order).alias("_ord"),
    ).filter(F.col("_key") != "")
    first = keep_first(ref, ["_key"], "_ord").drop("_ord")
    fill = lambda c: F.when(~blank(c), F.col(c)).otherwise(F.coalesce(F.col(f"ref_{c}"), F.lit("")))
    return (
        workload.withColumn("_key", keys.token_set_key("enseignant"))
        .join(first, "_key", "left")
        .select(*[fill(c).alias(c) if c in FILLED_FROM_REFERENCE else c for c in workload.columns])
    )


def missing_any(fields: list[str] = REQUIRED) -> Column:
    out = F.lit(False)
    for c in fields:
        out = out | blank(text(c))
    return out


def incomplete_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter(missing_any())


def export_readiness(sessions: DataFrame) -> DataFrame:
    """One row: how many sessions there are, how many lack a field, and the verdict."""
    lacking = F.count_if(missing_any())
    total = F.count(F.lit(1))
    return sessions.agg(
        total.alias("sessions"),
        lacking.alias("incomplete"),
        ((total > 0) & (lacking == 0)).alias("ready"),
    )


def document_control(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("source_document").agg(
        F.count(F.lit(1)).alias("seances"), F.count_distinct("matiere").alias("matieres")
    )
