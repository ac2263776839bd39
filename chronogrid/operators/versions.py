"""Immutable numbered versions of a timetable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.extras import format_sources
from ..functions.fingerprints import content_fingerprint
from ..functions.folding import clean_ws, text

KEY = ["academic_year", "period", "filiere", "niveau"]
ACTIVE, ARCHIVED = "Active", "Archivée"
IMPORT_COMMENT = "Import automatique à l'upload"
CORRECTION_COMMENT = "Correction depuis la vérification globale"
MISSING_LABELS = {
    "academic_year": "année universitaire", "filiere": "filière", "niveau": "semestre",
    "period": "période",
}
CORRECTABLE = {
    "jour": "Jour", "horaire": "Horaire", "matiere": "Matière", "enseignant": "Enseignant",
    "type_seance": "Type", "groupe": "Groupe", "salle": "Salle", "duree": "Durée",
}


def natural_id(*parts: str | Column) -> Column:
    """Deterministic positive id of a natural key, so reruns and retries agree."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def keyed(sessions: DataFrame) -> DataFrame:
    """Cleaned natural key with the period inferred from the semester."""
    cleaned = {c: clean_ws(c) for c in ("academic_year", "filiere", "niveau")}
    return sessions.withColumns(cleaned).withColumn("period", keys.infer_period("niveau"))


def get_or_create_timetables(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalog plus a row for each natural key it does not hold yet."""
    new = wanted.select(*KEY).distinct().join(catalog, KEY, "left_anti")
    return catalog.select("timetable_id", *KEY).unionByName(
        new.withColumn("timetable_id", natural_id(*KEY))
    )


def assign_versions(batch: DataFrame, catalog: DataFrame) -> DataFrame:
    """Decide for each timetable of a batch: skipped, duplicate or created.

    ``catalog`` holds stored versions with natural key, version_number and source_hash.
    """
    drafts = content_fingerprint(keyed(batch), KEY)
    same = catalog.groupBy(*KEY, "source_hash").agg(F.max("version_number").alias("_same"))
    last = catalog.groupBy(*KEY).agg(F.max("version_number").alias("_last"))
    lacking = F.array_join(
        F.filter(
            F.array(*[F.when(F.col(c) == "", F.lit(label)) for c, label in MISSING_LABELS.items()]),
            lambda x: x.isNotNull(),
        ),
        ", ",
    )
    status = (
        F.when(lacking != "", "skipped").when(F.col("_same").isNotNull(), "duplicate").otherwise("created")
    )
    number = F.when(F.col("status") == "duplicate", F.col("_same")).when(
        F.col("status") == "created", F.coalesce("_last", F.lit(0)) + 1
    )
    message = (
        F.when(
            F.col("status") == "skipped",
            F.concat(F.lit("Mémoire automatique suspendue : "), lacking, F.lit(" manquant(e)(s).")),
        )
        .when(F.col("status") == "duplicate", F.format_string("Déjà mémorisé : V%d.", "version_number"))
        .otherwise(F.format_string("V%d mémorisée automatiquement.", "version_number"))
    )
    stored = F.col("status") != "skipped"
    return (
        drafts.join(same, [*KEY, "source_hash"], "left")
        .join(last, KEY, "left")
        .withColumn("status", status)
        .withColumn("version_number", number.cast("int"))
        .select(
            *KEY,
            "status",
            F.when(stored, natural_id(*KEY)).alias("timetable_id"),
            F.when(stored, natural_id(*KEY, "version_number")).alias("version_id"),
            "version_number",
            "source_hash",
            "sessions_count",
            message.alias("message"),
        )
    )


def versions_after(catalog: DataFrame, decided: DataFrame, imported_at: Column) -> DataFrame:
    """The version table after a batch: created versions added, older active ones archived."""
    created = decided.filter(F.col("status") == "created")
    touched = created.select("timetable_id").distinct().withColumn("_new", F.lit(True))
    replaced = F.col("_new").isNotNull() & (F.col("is_active") == 1)
    older = (
        catalog.join(touched, "timetable_id", "left")
        .withColumn(
            "status",
            F.when(replaced & (F.col("status") == ACTIVE), ARCHIVED).otherwise(F.col("status")),
        )
        .withColumn("is_active", F.when(replaced, 0).otherwise(F.col("is_active")))
        .drop("_new")
    )
    fresh = created.select(
        "timetable_id", "version_id", *KEY, "version_number", "source_hash", "sessions_count",
        F.lit(1).alias("is_active"), F.lit(ACTIVE).alias("status"), imported_at.alias("imported_at"),
        F.lit(IMPORT_COMMENT).alias("comment"),
    )
    return older.unionByName(fresh, allowMissingColumns=True)


def reconcile_fingerprints(versions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Replace digests that no longer match the stored rows (older duration formats)."""
    actual = content_fingerprint(sessions, ["version_id"], "_actual").drop("sessions_count")
    outdated = F.col("_actual").isNotNull() & ~F.col("source_hash").eqNullSafe(F.col("_actual"))
    return (
        versions.join(actual, "version_id", "left")
        .withColumn("rehashed", outdated)
        .withColumn("source_hash", F.when(outdated, F.col("_actual")).otherwise(F.col("source_hash")))
        .drop("_actual")
    )


def list_timetables(timetables: DataFrame, versions: DataFrame) -> DataFrame:
    """Version count and active version; the newest one where no flag column exists."""
    active = F.col("version_number")
    if "is_active" in versions.columns:
        active = F.when(F.col("is_active") == 1, active)
    counted = versions.groupBy("timetable_id").agg(
        F.count(F.lit(1)).alias("versions"), F.max(active).alias("version_active")
    )
    return (
        timetables.join(counted, "timetable_id", "left")
        .withColumn("versions", F.coalesce("versions", F.lit(0)))
        .orderBy(F.desc("academic_year"), "period", "filiere", "niveau")
    )


def list_versions(versions: DataFrame, timetable_id: int | None = None) -> DataFrame:
    """Display columns, newest first; all timetables when no id is given."""
    chosen = versions if timetable_id is None else versions.filter(F.col("timetable_id") == timetable_id)
    return chosen.orderBy("timetable_id", F.desc("version_number")).select(
        "version_id",
        F.concat(F.lit("V"), "version_number").alias("version"),
        F.col("imported_at").alias("date_import"),
        F.col("status").alias("statut"),
        keys.active_mark(F.col("is_active")).alias("active"),
        F.col("sessions_count").alias("seances"),
        format_sources("source_documents").alias("documents"),
        F.col("comment").alias("commentaire"),
    )


def version_ids(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of (timetable_id, version_number) pairs; unknown pairs get null."""
    known = versions.select("timetable_id", "version_number", "version_id")
    return wanted.join(known, ["timetable_id", "version_number"], "left")


def active_versions(versions: DataFrame, activations: DataFrame, order: str) -> DataFrame:
    """Apply activation requests in ``order``; requests for foreign versions are ignored.

    Only the generic statuses follow the flag, and repeating an activation changes nothing.
    """
    valid = activations.join(
        versions.select("timetable_id", "version_id"), ["timetable_id", "version_id"], "left_semi"
    )
    last = valid.groupBy("timetable_id").agg(F.max_by("version_id", order).alias("_target"))
    asked = valid.select("timetable_id", "version_id").distinct().withColumn("_asked", F.lit(True))
    state = versions.join(last, "timetable_id", "left").join(
        asked, ["timetable_id", "version_id"], "left"
    )
    # A timetable moves when some request names a version other than the one active so far.
    moving = (
        state.filter(F.col("_asked") & (F.col("is_active") == 0))
        .select("timetable_id")
        .distinct()
        .withColumn("_moves", F.lit(True))
    )
    moves = F.coalesce("_moves", F.lit(False))
    target = F.col("version_id") == F.col("_target")
    was_active = (F.col("is_active") == 1) | F.coalesce("_asked", F.lit(False))
    status = (
        F.when(moves & target & (F.col("status") == ARCHIVED), ACTIVE)
        .when(moves & ~target & was_active & (F.col("status") == ACTIVE), ARCHIVED)
        .otherwise(F.col("status"))
    )
    return (
        state.join(moving, "timetable_id", "left")
        .withColumn("status", status)
        .withColumn("is_active", F.when(moves, target.cast("int")).otherwise(F.col("is_active")))
        .select(*versions.columns)
    )


def rejected_activations(versions: DataFrame, activations: DataFrame) -> DataFrame:
    """Requests for a version that is missing or belongs to another timetable."""
    return activations.join(versions, ["timetable_id", "version_id"], "left_anti")


def programme_key(filiere: str | Column, niveau: str | Column) -> list[Column]:
    return [F.upper(F.trim(text(filiere))).alias("_f"), F.upper(F.trim(text(niveau))).alias("_n")]


def resolve_active(versions: DataFrame, academic_year: str | None = None) -> DataFrame:
    """Active version per programme and year, else the latest one."""
    chosen = versions if academic_year is None else versions.filter(F.col("academic_year") == academic_year)
    best = F.max_by(
        F.struct("version_id", "version_number"), F.struct("is_active", "version_number", "version_id")
    )
    return (
        chosen.groupBy("academic_year", *programme_key("filiere", "niveau"))
        .agg(best.alias("_v"))
        .select(
            "academic_year", F.col("_f").alias("filiere"), F.col("_n").alias("niveau"),
            "_v.version_id", "_v.version_number",
        )
    )


def version_sessions(sessions: DataFrame, version_id: int, weekdays: bool = True) -> DataFrame:
    chosen = sessions.filter(F.col("version_id") == version_id)
    if weekdays:
        return chosen.orderBy(keys.day_order("jour", 8), "horaire", "matiere", "enseignant")
    return chosen.orderBy("jour", "horaire", "matiere", "enseignant")


def save_state(contexts: DataFrame, draft: DataFrame, versions: DataFrame | None) -> DataFrame:
    """Whether the draft of each context (natural key) is stored, and as which version."""
    cleaned = contexts.select(*[clean_ws(c).alias(c) for c in KEY]).distinct()
    incomplete = F.lit(False)
    for c in KEY:
        incomplete = incomplete | (F.col(c) == "")
    prints = content_fingerprint(draft.withColumns({c: clean_ws(c) for c in KEY}), KEY)
    state = cleaned.join(prints, KEY, "left")
    empty = F.col("source_hash").isNull()
    if versions is None:
        status = F.when(incomplete, "incomplete").when(empty, "empty").otherwise("unknown")
        return state.select(
            *KEY, status.alias("status"), F.lit(None).cast("int").alias("version_number"),
            F.lit(None).cast("int").alias("is_active"),
        )
    stored = versions.groupBy(*KEY, "source_hash").agg(
        F.max(F.struct("version_number", "is_active")).alias("_v")
    )
    known = F.col("_v").isNotNull() & ~incomplete
    status = (
        F.when(incomplete, "incomplete").when(empty, "empty").when(known, "saved").otherwise("unsaved")
    )
    return state.join(stored, [*KEY, "source_hash"], "left").select(
        *KEY,
        status.alias("status"),
        F.when(known, F.col("_v.version_number")).alias("version_number"),
        F.when(known, F.col("_v.is_active")).alias("is_active"),
    )


def previous_version(versions: DataFrame) -> DataFrame:
    """Each version with its predecessor in the timetable; the first one is a baseline."""
    line = Window.partitionBy("timetable_id").orderBy("version_number")
    return versions.select(
        "timetable_id",
        "version_id",
        "version_number",
        F.lag("version_id").over(line).alias("from_version_id"),
        F.lag("version_number").over(line).alias("from_version_number"),
    ).withColumn("baseline", F.col("from_version_id").isNull())


def archive_changes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows with those of the freshly compared target versions replaced."""
    targets = fresh.select("to_version_id").distinct()
    return stored.join(targets, "to_version_id", "left_anti").unionByName(fresh)


def write_change_archive(fresh: DataFrame, path: str) -> None:
    """Replace only the partitions of the versions in ``fresh``; a rerun writes the same."""
    (
        fresh.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("to_version_id")
        .parquet(path)
    )


def change_summary_for(summaries: DataFrame, versions: DataFrame) -> DataFrame:
    """Counters with the number of the version compared against, where it still exists."""
    previous = versions.select(
        F.col("version_id").alias("from_version_id"),
        F.col("version_number").alias("previous_version_number"),
    )
    count = lambda c: F.coalesce(F.col(f"{c}_count"), F.lit(0)).alias(c)
    return summaries.join(previous, "from_version_id", "left").select(
        "to_version_id", "previous_version_number",
        *[count(c) for c in ("unchanged", "modified", "added", "removed")],
        "created_at",
    )


def backfill_versions(versions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Derive the catalog columns an older layout lacks; present ones stay as they are."""
    have = set(versions.columns)
    out = versions
    if "is_active" not in have:
        flagged = F.col("status") == ACTIVE if "status" in have else F.lit(False)
        chosen = out.groupBy("timetable_id").agg(
            F.max_by("version_id", F.struct(flagged.cast("int"), "version_number")).alias("_active")
        )
        out = (
            out.join(chosen, "timetable_id")
            .withColumn("is_active", (F.col("version_id") == F.col("_active")).cast("int"))
            .drop("_active")
        )
    if "status" not in have:
        out = out.withColumn("status", F.when(F.col("is_active") == 1, ACTIVE).otherwise(ARCHIVED))
    if "comment" not in have:
        out = out.withColumn("comment", F.lit(None).cast("string"))
    lacking = {"sessions_count", "source_hash", "source_documents"} - have
    if lacking:
        prints = content_fingerprint(sessions, ["version_id"])
        named = sessions.select("version_id", clean_ws("source_document").alias("_s")).distinct()
        sources = named.groupBy("version_id").agg(
            F.to_json(F.array_sort(F.collect_list(F.when(F.col("_s") != "", F.col("_s"))))).alias(
                "source_documents"
            )
        )
        facts = prints.join(sources, "version_id", "left").select("version_id", *sorted(lacking))
        defaults = {"sessions_count": F.lit(0), "source_hash": F.lit(""), "source_documents": F.lit("[]")}
        out = out.join(facts, "version_id", "left")
        for c in sorted(lacking):
            out = out.withColumn(c, F.coalesce(F.col(c), defaults[c]))
    return out


def prepare_corrections(sessions: DataFrame, versions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Verdict and changed fields of each requested correction.

    ``corrections`` holds version_id, session_id and the new texts; null keeps a field.
    """
    before = {c: clean_ws(c) for c in CORRECTABLE}
    current = sessions.select(
        "version_id", "session_id", F.struct(*[before[c].alias(c) for c in CORRECTABLE]).alias("before")
    )
    asked = corrections.select(
        "version_id",
        "session_id",
        F.struct(*[F.col(c).cast("string").alias(c) for c in CORRECTABLE]).alias("asked"),
    )
    base = versions.select("version_id", F.col("is_active").alias("_base"))
    hours = F.replace(clean_ws(F.col("asked.duree")), F.lit(","), F.lit("."))
    number = hours.try_cast("double")
    infinite = number.isin(float("inf"), float("-inf"))
    bad_hours = (hours != "") & (number.isNull() | F.isnan(number) | infinite | (number <= 0))

    def after(c: str) -> Column:
        given = clean_ws(F.col(f"asked.{c}"))
        if c == "duree":
            given = F.when(hours != "", number.cast("string")).otherwise("")
        return F.when(F.col(f"asked.{c}").isNull(), F.col(f"before.{c}")).otherwise(given)

    changed = F.filter(
        F.array(
            *[
                F.when(
                    after(c) != F.col(f"before.{c}"),
                    F.struct(
                        F.lit(c).alias("field"), F.lit(label).alias("label"),
                        F.col(f"before.{c}").alias("before"), after(c).alias("after"),
                    ),
                )
                for c, label in CORRECTABLE.items()
            ]
        ),
        lambda x: x.isNotNull(),
    )
    verdict = (
        F.when(F.col("_base").isNull(), "unknown_version")
        .when(F.col("before").isNull(), "wrong_session")
        .when(F.col("asked.duree").isNotNull() & bad_hours, "invalid_duration")
        .when(F.size(changed) == 0, "no_changes")
        .when(F.col("_base") != 1, "stale_base")
        .otherwise("accepted")
    )
    return (
        asked.join(base, "version_id", "left")
        .join(current, ["version_id", "session_id"], "left")
        .select("version_id", "session_id", verdict.alias("verdict"), changed.alias("changed"))
    )


def correct_sessions(sessions: DataFrame, versions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Copy-on-write rows of the versions that follow from accepted corrections.

    The base rows stay untouched; ``assign_versions`` numbers the result.
    """
    accepted = prepare_corrections(sessions, versions, corrections).filter("verdict = 'accepted'")
    edits = accepted.select(
        "version_id",
        "session_id",
        F.map_from_entries(
            F.transform("changed", lambda x: F.struct(x["field"], x["after"]))
        ).alias("_edit"),
    )
    touched = accepted.select("version_id").distinct()
    new = lambda c: F.coalesce(
        F.try_element_at("_edit", F.lit(c)).cast(sessions.schema[c].dataType), F.col(c)
    )
    return (
        sessions.join(touched, "version_id", "left_semi")
        .join(edits, ["version_id", "session_id"], "left")
        .withColumns({c: new(c) for c in CORRECTABLE})
        .drop("_edit")
        .withColumnRenamed("version_id", "base_version_id")
    )


def validate_targets(targets: DataFrame, sessions: DataFrame, versions: DataFrame) -> DataFrame:
    """The (timetable, version, session) triples whose parts really belong together."""
    owned = versions.select("timetable_id", "version_id", "version_number", "is_active")
    return targets.join(owned, ["timetable_id", "version_id"]).join(
        sessions.drop("ord"), ["version_id", "session_id"]
    )


def programme_subsets(details: DataFrame, order: str = "ord", default_year: str = "2026-2027") -> DataFrame:
    """Programme and semester pairs that can be stored, with the first year given for each."""
    trimmed = details.select(
        F.trim(text("filiere")).alias("filiere"),
        F.trim(text("niveau")).alias("niveau"),
        F.trim(text("academic_year")).alias("_y"),
        F.col(order).alias("_o"),
    )
    first_year = F.min_by("_y", F.when(F.col("_y") != "", F.col("_o")))
    shown = lambda c: F.when(F.col(c) == "", keys.UNSTATED).otherwise(F.col(c))
    return (
        trimmed.filter((F.col("filiere") != "") | (F.col("niveau") != ""))
        .groupBy("filiere", "niveau")
        .agg(F.coalesce(first_year, F.lit(default_year)).alias("default_year"))
        .withColumn("label", F.concat(shown("filiere"), F.lit(" — "), shown("niveau")))
    )
