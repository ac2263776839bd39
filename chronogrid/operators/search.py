"""Archive and people search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.folding import clean_ws, text
from ..functions.similarity import may_reach, seq_ratio
from ..skew import settled
from .stats import ALL

SESSION_TEXT = {
    "annee": "academic_year", "periode": "period", "filiere": "filiere", "semestre": "niveau",
    "jour": "jour", "horaire": "horaire", "matiere module": "matiere", "type": "type_seance",
    "enseignant professeur": "enseignant", "groupe": "groupe", "salle": "salle",
    "document": "source_document", "version v": "version_number", "commentaire": "version_comment",
}
VERSION_TEXT = {
    "annee": "academic_year", "periode": "period", "filiere": "filiere", "semestre": "niveau",
    "version v": "version_number", "statut": "status", "document": "source_documents",
    "commentaire": "comment",
}
CHANGE_TEXT = {
    "annee": "academic_year", "periode": "period", "filiere": "filiere", "semestre": "niveau",
    "version v": "version_number", "matiere module": "matiere", "enseignant professeur": "enseignant",
    "groupe": "groupe", "type": "type_seance", "changement": "change_type", "champs": "champs",
    "avant": "old_summary", "apres": "new_summary", "old": "old_json", "new": "new_json",
}
EXPORT_NAMES = {
    "jour": "Jour", "matiere": "Matière", "type_seance": "Type", "enseignant": "Nom et prénom",
    "horaire": "Horaire", "duree": "Durée", "groupe": "Groupe", "salle": "Salle",
}
FUZZY_FLOOR = 0.68


def labelled_text(labels: dict[str, str]) -> Column:
    """All values behind their labels in one normalised text; labels match as well."""
    parts = [
        F.concat(F.lit(label + ("" if label.endswith(" v") else " ")), text(c)) for label, c in labels.items()
    ]
    return keys.search_key(F.concat_ws(" ", *parts))


def _matching(index: DataFrame, labels: dict[str, str], query: str) -> DataFrame:
    """Rows whose text contains every word of the query; a blank query matches nothing.

    The words are worked out once, ahead of the rows: the optimiser does not fold them.
    """
    words = index.sparkSession.range(1).select(keys.query_tokens(F.lit(query))).first()[0]
    found = F.lit(bool(words))
    for word in words:
        found = found & F.col("_text").contains(word)
    # The text is built once per row, not once per word looked for in it.
    spoken = settled(index, *index.columns, labelled_text(labels).alias("_text"))
    return spoken.filter(found).drop("_text")


def search_sessions(index: DataFrame, query: str) -> DataFrame:
    return _matching(index, SESSION_TEXT, query)


def search_versions(index: DataFrame, query: str) -> DataFrame:
    return _matching(index, VERSION_TEXT, query)


def changes_index(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """Change rows with both versions' numbers, the timetable's key and readable summaries."""
    to = versions.select(
        F.col("version_id").alias("to_version_id"), "version_number", "timetable_id",
        "academic_year", "period", "filiere", "niveau",
    )
    since = versions.select(
        F.col("version_id").alias("from_version_id"),
        F.col("version_number").alias("previous_version_number"),
    )
    shown = lambda c: clean_ws(F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))).alias(c)
    json = lambda side: F.coalesce(
        F.to_json(F.struct(*[text(F.col(f"{side}.{c}")).alias(n) for c, n in EXPORT_NAMES.items()])),
        F.lit("{}"),
    )
    whole = lambda side: F.when(F.col(side).isNull(), "{}").otherwise(json(side))
    return (
        changes.join(to, "to_version_id", "left")
        .join(since, "from_version_id", "left")
        .select(
            "to_version_id", "version_number", "previous_version_number", "timetable_id",
            *[text(c).alias(c) for c in ("academic_year", "period", "filiere", "niveau")],
            "change_type",
            shown("matiere"), shown("enseignant"), shown("groupe"), shown("type_seance"),
            F.array_join("changed_fields", ", ").alias("champs"),
            F.coalesce(keys.slot_summary(F.col("old")), F.lit("")).alias("old_summary"),
            F.coalesce(keys.slot_summary(F.col("new")), F.lit("")).alias("new_summary"),
            whole("old").alias("old_json"),
            whole("new").alias("new_json"),
        )
    )


def search_changes(index: DataFrame, query: str) -> DataFrame:
    return _matching(index, CHANGE_TEXT, query)


def filter_version_sessions(
    sessions: DataFrame, search: str = "", day: str = ALL, teacher: str = ALL, group: str = ALL
) -> DataFrame:
    """Equality filters, and the folded text anywhere in five columns."""
    out = sessions
    for column, value in (("jour", day), ("enseignant", teacher), ("groupe", group)):
        if value != ALL and column in out.columns:
            out = out.filter(text(column) == value)
    if search.strip():
        needle = F.trim(keys.contains_key(F.lit(search)))
        present = [c for c in ("matiere", "enseignant", "groupe", "salle", "horaire") if c in out.columns]
        hay = F.array(*[keys.contains_key(c) for c in present]) if present else F.array().cast("array<string>")
        out = out.filter(F.exists(hay, lambda x: x.contains(needle)))
    return out


def filter_catalog(catalog: DataFrame, selections: dict[str, str]) -> DataFrame:
    out = catalog
    for column, value in selections.items():
        if value != ALL:
            out = out.filter(F.col(column).cast("string") == value)
    return out


def rank_people(people: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """People ordered by how directly the query names them.

    Every rung but the last is native. Only rows that reach none of them, and whose
    edit distance leaves the fuzzy rung possible, are sent to Python.
    """
    q = keys.list_filter_key(F.lit(query))
    nom, prenom = keys.list_filter_key("nom"), keys.list_filter_key("prenom")
    c = F.col
    # Each key is built once per row: a filter would be pushed through plain columns and build them again.
    keyed = settled(
        people, *people.columns, q.alias("_q"), nom.alias("_nom"), prenom.alias("_prenom"),
        keys.list_filter_key("email").alias("_mail"), keys.list_filter_key("telephone").alias("_tel"),
    ).filter("_q <> ''")
    rows = settled(
        keyed, *keyed.columns,
        F.trim(F.concat_ws(" ", "_nom", "_prenom")).alias("_full"), F.trim(F.concat_ws(" ", "_prenom", "_nom")).alias("_back"),
    )
    words = F.filter(F.split(F.concat_ws(" ", "_nom", "_prenom"), " "), lambda w: w != "")
    asked = F.split("_q", " ")
    starts = lambda part: F.exists(words, lambda w: w.startswith(part))
    short = F.array_join(F.transform(F.filter(F.split("_full", " "), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")
    consonants = keys.consonant_key(F.lit(query))
    tier = (
        F.when((c("_q") == c("_mail")) | (c("_q") == c("_tel")), 100.0)
        .when(starts(c("_q")), 98.0)
        .when(c("_full").startswith(c("_q")) | c("_back").startswith(c("_q")), 96.0)
        .when((F.size(asked) > 1) & F.forall(asked, starts), 94.0)
        .when((short != "") & short.startswith(F.replace("_q", F.lit(" "), F.lit(""))), 91.0)
        .when(c("_full").contains(c("_q")) | c("_back").contains(c("_q")), 88.0)
        .when(c("_mail").contains(c("_q")) | c("_tel").contains(c("_q")), 86.0)
        .when((F.length(consonants) >= 2) & keys.consonant_key("_full").startswith(consonants), 82.0)
    )
    scored = settled(rows, *rows.columns, tier.alias("score"))
    direct = scored.filter(c("score").isNotNull())
    possible = scored.filter(
        c("score").isNull()
        & (F.length("_q") >= 3)
        & (
            may_reach(c("_q"), c("_nom"), FUZZY_FLOOR)
            | may_reach(c("_q"), c("_prenom"), FUZZY_FLOOR)
            | may_reach(c("_q"), c("_full"), FUZZY_FLOOR)
        )
    )
    part = lambda name: F.when(c(name) == "", 0.0).otherwise(seq_ratio(c("_q"), c(name)))
    fuzzy = (
        possible.withColumn("_r", F.greatest(part("_nom"), part("_prenom"), part("_full")))
        .filter(c("_r") >= FUZZY_FLOOR)
        .withColumn("score", 60.0 + c("_r") * 20.0)
        .drop("_r")
    )
    return (
        direct.unionByName(fuzzy)
        .select(*people.columns, "score")
        .orderBy(F.desc("score"), "nom", "prenom", "person_id")
        .limit(limit)
    )


def filter_people(people: DataFrame, status: str = ALL, department: str = ALL, search: str = "") -> DataFrame:
    out = filter_catalog(people, {"statut": status, "departement": department})
    if search.strip():
        needle = keys.list_filter_key(F.lit(search))
        hay = F.array(*[keys.list_filter_key(F.col(c).cast("string")) for c in people.columns])
        out = out.filter(F.exists(hay, lambda x: x.contains(needle)))
    return out


def _version_title() -> Column:
    return F.concat(
        F.concat_ws(" ", "filiere", "niveau"), F.lit(" | "), F.concat_ws(" ", "period", "academic_year"),
        F.lit(" | V"), F.col("version_number"),
    )


def matched_versions(sessions: DataFrame, versions: DataFrame) -> DataFrame:
    """One version per label over both result lists; the version list wins."""
    pick = lambda df, rank: df.select(_version_title().alias("label"), "version_id", F.lit(rank).alias("_rank"))
    both = pick(sessions, 0).unionByName(pick(versions, 1))
    return both.groupBy("label").agg(
        F.max_by("version_id", F.struct("_rank", "version_id")).alias("version_id")
    )


def pin_target(filtered: DataFrame, catalog: DataFrame, timetable_id: int) -> DataFrame:
    """The filtered catalog with the opened timetable first when the filters exclude it."""
    target = catalog.filter(F.col("timetable_id") == timetable_id)
    absent = target.join(filtered, "timetable_id", "left_anti").withColumn("rang", F.lit(0))
    return absent.unionByName(filtered.withColumn("rang", F.lit(1)))


def session_labels(found: DataFrame) -> DataFrame:
    """A readable label per session that tells sessions of one slot apart."""
    said = lambda head, c: F.when(clean_ws(c) != "", F.concat(F.lit(head), clean_ws(c)))
    context = F.concat_ws(
        " | ",
        said("Ens. ", "enseignant"),
        said("Groupe ", "groupe"),
        said("Salle ", "salle"),
        F.nullif(keys.join_nonblank(" ", F.col("filiere"), F.col("niveau")), F.lit("")),
        F.concat(F.lit("V"), F.col("version_number")),
    )
    subject = F.when(clean_ws("matiere") == "", "Séance").otherwise(clean_ws("matiere"))
    return found.select(
        "session_id",
        F.concat(
            subject, F.lit(" — "), clean_ws("jour"), F.lit(" "), clean_ws("horaire"), F.lit(" | "), context
        ).alias("label"),
    )


def display_sessions(found: DataFrame) -> DataFrame:
    return found.select(
        "academic_year", "period", "filiere", "niveau",
        F.concat(F.lit("V"), "version_number").alias("version"),
        keys.active_mark(F.col("is_active")).alias("active"),
        "jour", "horaire", "matiere", "type_seance", "enseignant", "groupe", "salle", "source_document",
    )


def display_versions(found: DataFrame) -> DataFrame:
    return found.select(
        "academic_year", "period", "filiere", "niveau",
        F.concat(F.lit("V"), "version_number").alias("version"),
        keys.active_mark(F.col("is_active")).alias("active"),
        "status", "sessions_count", "imported_at", "comment",
    )


def display_changes(found: DataFrame) -> DataFrame:
    return found.select(
        "academic_year", "period", "filiere", "niveau",
        keys.version_label(F.col("previous_version_number"), F.col("version_number")).alias("version"),
        keys.change_label(F.col("change_type")).alias("changement"),
        "matiere", "enseignant", "groupe", "type_seance", "champs",
        F.col("old_summary").alias("avant"), F.col("new_summary").alias("apres"),
    )
