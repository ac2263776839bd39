"""Staff-record integration: resolution, merging, conflicts and rules.

A record has rid (arrival order), the eight fields below, ``extras`` (map of lists) and
the provenance texts source_document and feuille.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.extras import EXTRAS_TYPE, merge_extras
from ..functions.folding import clean_ws, text
from ..functions.keys import UNSTATED
from ..session import cut_lineage
from . import resolution
from .matching import similar_within

FIELDS = {
    "statut": "Statut", "nom": "Nom", "prenom": "Prénom", "email": "Email",
    "telephone": "Téléphone", "diplome": "Diplôme", "specialite": "Spécialité",
    "departement": "Département",
}
PROVENANCE = ["source_document", "feuille"]
NO_IDENTITY = "Aucun identifiant enseignant"
KEEP, ADOPT, BOTH = "actuelle", "nouvelle", "les_deux"
RESOLUTIONS = {
    KEEP: "Valeur actuelle conservée — décision mémorisée",
    ADOPT: "Nouvelle valeur adoptée — décision mémorisée",
    BOTH: "Actuelle conservée + alternative archivée — décision mémorisée",
}
AUTO_LABELS = {
    KEEP: "Résolu automatiquement par règle mémorisée : valeur préférée conservée",
    ADOPT: "Résolu automatiquement par règle mémorisée : valeur préférée adoptée",
    BOTH: "Résolu automatiquement par règle mémorisée : valeur préférée + alternative archivée",
}
AUTO_UNNAMED = "Résolu automatiquement par règle mémorisée"
RULE_LABELS = {
    KEEP: "Conserver la valeur préférée", ADOPT: "Adopter la valeur préférée",
    BOTH: "Valeur préférée + archiver alternative",
}


def said(c: str | Column) -> Column:
    """Real content: neither blank nor the "unstated" marker."""
    return ~clean_ws(c).isin("", UNSTATED)


def has_identity() -> Column:
    out = F.lit(False)
    for c in ("nom", "prenom", "email", "telephone"):
        out = out | (clean_ws(c) != "")
    return out


def has_any_content() -> Column:
    out = F.coalesce(F.size("extras") > 0, F.lit(False))
    for c in FIELDS:
        out = out | said(c)
    return out


def resolve_entities(records: DataFrame, split_rows: int = 100_000) -> DataFrame:
    """``label`` per record: the rid of the record that opened its entity; see ``resolution``."""
    return resolution.resolve(records, split_rows=split_rows).labels


def merge_records(records: DataFrame, labels: DataFrame, archived: DataFrame | None = None) -> DataFrame:
    """One record per entity: first real value per field, extras and sources united.

    ``archived`` (label, rid, key, pos, value) holds further extras, each ahead of those of its record.
    """
    r = records.join(labels, "rid")
    first = lambda c: F.coalesce(F.min_by(c, F.when(said(c), F.col("rid"))), F.min_by(c, "rid"))
    fields = r.groupBy("label").agg(*[first(c).alias(c) for c in FIELDS], F.count(F.lit(1)).alias("n"))
    values = (
        r.select("label", "rid", F.explode("extras").alias("key", "values"))
        .select("label", "rid", "key", F.posexplode("values").alias("pos", "value"))
    )
    values = (
        (values if archived is None else values.unionByName(archived))
        .filter("coalesce(value, '') <> ''")
        .groupBy("label", "key", "value").agg(F.min(F.struct("rid", "pos")).alias("at"))
    )
    lists = values.groupBy("label", "key").agg(
        F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v")
    )
    extras = lists.groupBy("label").agg(
        F.map_from_entries(F.collect_list(F.struct("key", F.col("v.value").alias("v")))).alias("extras")
    )
    out = fields.join(extras, "label", "left").withColumn(
        "extras", F.coalesce("extras", F.from_json(F.lit("{}"), EXTRAS_TYPE))
    )
    for c in PROVENANCE:
        parts = (
            r.select("label", "rid", F.posexplode(F.split(text(c), " ; ")).alias("pos", "part"))
            .select("label", "rid", "pos", F.trim("part").alias("part")).filter("part <> ''")
            .groupBy("label", "part").agg(F.min(F.struct("rid", "pos")).alias("at"))
        )
        united = parts.groupBy("label").agg(
            F.array_join(F.array_sort(F.collect_list(F.struct("at", "part")))["part"], " ; ").alias(c)
        )
        out = out.join(united, "label", "left").withColumn(c, text(c))
    return out


@dataclass(frozen=True)
class Imported:
    """What an import did.

    ``outcome`` (rid, outcome, person_id) of each useful record, ``people`` afterwards, ``conflicts`` that it opened,
    ``resolved``: conflicts that a rule decided, and ``rules`` with their use counted.
    """

    outcome: DataFrame
    people: DataFrame
    conflicts: DataFrame
    resolved: DataFrame
    rules: DataFrame | None


def import_records(
    store: DataFrame, batch: DataFrame, rules: DataFrame | None = None, conflicts: DataFrame | None = None
) -> Imported:
    """Takes records into the store in their order of arrival.

    Stored people come first (their rid is their id) and keep their identity; batch rids must be larger than any id.
    A differing value follows the rule that remembers a decision for the pair, else opens a conflict, unless
    ``conflicts`` has an open one of that wording. Values that rules put in place are what later records meet.
    """
    useful = batch.filter(has_any_content())
    known = useful.filter(keys.identity_key("email", "telephone", "nom", "prenom") != "")
    both = store.withColumn("pinned", F.lit(True)).unionByName(known.withColumn("pinned", F.lit(False)))
    labels = resolution.resolve(both, rules).labels
    outcome = useful.select("rid").join(labels, "rid", "left").select(
        "rid",
        F.when(F.col("label").isNull(), "pending")
        .when(F.col("label") == F.col("rid"), "inserted")
        .otherwise("updated").alias("outcome"),
        F.col("label").alias("person_id"),
    )
    owned = both.join(labels, "rid").withColumnRenamed("label", "person_id")
    events = cut_lineage(resolution.field_events(resolution.long_values(owned, FIELDS, "person_id", "rid"), rules))
    ruled = events.filter("kind = 'rule'")
    other = F.when(keys.person_key("kept") == keys.person_key("current"), F.col("incoming")).otherwise(F.col("current"))
    place = F.array_position(F.array(*map(F.lit, FIELDS.values())), F.col("field")).cast("int") - 1 - len(FIELDS)
    archived = ruled.filter(F.col("decision") == BOTH).select(
        F.col("person_id").alias("label"), "rid", F.concat(F.lit("Alternative "), "field").alias("key"), place.alias("pos"), other.alias("value")
    )
    people = merge_records(both.drop("pinned"), labels, archived).withColumnRenamed("label", "person_id").drop("n")
    latest = ruled.groupBy("person_id", "field").agg(F.max_by("kept", "rid").alias("value"))
    people = _with_fields(people, latest)
    people = people.withColumn("statut", F.when(clean_ws("statut") == "", UNSTATED).otherwise(clean_ws("statut")))
    origin = both.select("rid", *PROVENANCE)
    clash = events.filter("kind = 'clash'").groupBy("person_id", "field", "incoming").agg(F.min_by(F.struct("current", "rid"), "rid").alias("c"))
    opened = clash.select("person_id", "field", "c.current", "incoming", "c.rid").join(origin, "rid")
    if conflicts is not None:
        opened = new_conflicts(opened, conflicts)
    said_of = F.concat(_auto_label(), F.lit(" — valeur retenue : "), "kept")
    resolved = ruled.join(origin, "rid").select(
        "person_id", "field", "current", "incoming", "rid", *PROVENANCE, "kept", "decision",
        F.lit("auto_resolved").alias("status"), said_of.alias("resolution"), *_pair("current", "incoming"),
    )
    return Imported(
        outcome, people, opened.select("person_id", "field", "current", "incoming", *PROVENANCE, "rid"), resolved,
        None if rules is None else rules_after_use(rules, resolved),
    )


def upsert_people(store: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcome per batch record, the people afterwards, and the value conflicts found, without rules."""
    done = import_records(store, batch)
    return done.outcome, done.people, done.conflicts


def detect_field_conflicts(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Values that differ from the one their entity already holds, once per wording."""
    owned = records.join(labels, "rid").withColumnRenamed("label", "person_id")
    events = resolution.field_events(resolution.long_values(owned, FIELDS, "person_id", "rid"), None).filter("kind = 'clash'")
    first = events.groupBy("person_id", "field", "current", "incoming").agg(F.min("rid").alias("rid"))
    origin = records.select("rid", *PROVENANCE)
    return first.join(origin, "rid").select("person_id", "field", "current", "incoming", *PROVENANCE, "rid")


def new_conflicts(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Found conflicts that are not open yet with the same incoming wording."""
    open_ones = stored.filter("status = 'open'").select("person_id", "field", "incoming")
    return found.join(open_ones, ["person_id", "field", "incoming"], "left_anti")


def _pair(a: str, b: str) -> list[Column]:
    x, y = keys.person_key(a), keys.person_key(b)
    return [F.least(x, y).alias("low"), F.greatest(x, y).alias("high")]


def _auto_label() -> Column:
    label = F.create_map(*[F.lit(x) for kv in AUTO_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(label, F.col("decision")), F.lit(AUTO_UNNAMED))


def apply_conflict_rules(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Conflicts with the remembered decision for their pair of values, in either order."""
    known = rules.select("person_id", "field", "low", "high", "preferred", "decision")
    preferred = F.when(clean_ws("preferred") == "", F.col("current")).otherwise(clean_ws("preferred"))
    alternative = F.when(keys.person_key("kept") == keys.person_key("current"), F.col("incoming")).otherwise(
        F.col("current")
    )
    ruled = F.col("decision").isNotNull()
    return (
        found.withColumns(dict(zip(("low", "high"), _pair("current", "incoming"))))
        .join(known, ["person_id", "field", "low", "high"], "left")
        .withColumn("kept", F.when(ruled, preferred))
        .withColumn("status", F.when(ruled, "auto_resolved").otherwise("open"))
        .withColumn(
            "resolution",
            F.when(ruled, F.concat(_auto_label(), F.lit(" — valeur retenue : "), "kept")),
        )
        .withColumn("alternative", F.when(F.col("decision") == BOTH, alternative))
        .drop("preferred")
    )


def rules_after_use(rules: DataFrame, ruled: DataFrame) -> DataFrame:
    """Usage counters after a batch of automatic resolutions."""
    key = ["person_id", "field", "low", "high"]
    used = ruled.filter("status = 'auto_resolved'").groupBy(*key).agg(F.count(F.lit(1)).alias("_used"))
    return (
        rules.join(used, key, "left")
        .withColumn("usage_count", F.col("usage_count") + F.coalesce("_used", F.lit(0)))
        .drop("_used")
    )


def _with_fields(people: DataFrame, values: DataFrame) -> DataFrame:
    """People with some fields' values (person_id, field, value) put in place."""
    sets = values.groupBy("person_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_set"))
    put = {c: F.coalesce(F.try_element_at("_set", F.lit(n)), F.col(c)) for c, n in FIELDS.items()}
    return people.join(sets, "person_id", "left").withColumns(put).drop("_set")


def _with_values(people: DataFrame, values: DataFrame, alternatives: DataFrame) -> DataFrame:
    latest = values.groupBy("person_id", "field").agg(F.max_by("value", "rid").alias("value"))
    each = alternatives.groupBy("person_id", "field").agg(F.array_sort(F.collect_set("value")).alias("v"))
    more = each.groupBy("person_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat(F.lit("Alternative "), "field").alias("k"), "v"))
        ).alias("_alt")
    )
    kept = F.when(F.col("_alt").isNull(), F.col("extras")).otherwise(merge_extras(F.col("extras"), F.col("_alt")))
    return _with_fields(people, latest).join(more, "person_id", "left").withColumn("extras", kept).drop("_alt")


def resolve_conflicts(
    conflicts: DataFrame, decisions: DataFrame, people: DataFrame, rules: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply manual decisions to open conflicts; returns conflicts, people and rules.

    ``decisions`` holds conflict_id and decision; every decision is remembered as a rule.
    """
    labels = F.create_map(*[F.lit(x) for kv in RESOLUTIONS.items() for x in kv])
    state = conflicts.join(decisions, "conflict_id", "left")
    taken = (F.col("status") == "open") & F.col("decision").isNotNull()
    decided = state.filter(taken).withColumn("rid", F.col("conflict_id"))
    after = (
        state.withColumn("_t", taken)
        .withColumn("status", F.when(F.col("_t"), "resolved").otherwise(F.col("status")))
        .withColumn(
            "resolution",
            F.when(F.col("_t"), F.coalesce(F.element_at(labels, F.col("decision")), F.col("decision"))).otherwise(F.col("resolution")),
        )
        .select(*conflicts.columns)
    )
    value = lambda d: decided.filter(F.col("decision") == d).select(
        "person_id", "field", F.col("incoming").alias("value"), "rid"
    )
    changed = _with_values(people, value(ADOPT), value(BOTH))
    fresh = decided.select(
        "person_id", "field", *_pair("current", "incoming"),
        F.when(F.col("decision") == ADOPT, F.col("incoming")).otherwise(F.col("current")).alias("preferred"),
        "decision", "rid",
    )
    key = ["person_id", "field", "low", "high"]
    newest = fresh.groupBy(*key).agg(F.max_by(F.struct("preferred", "decision"), "rid").alias("_n"))
    remembered = (
        rules.join(newest, key, "full")
        .withColumn("preferred", F.coalesce("_n.preferred", "preferred"))
        .withColumn("decision", F.coalesce("_n.decision", "decision"))
        .withColumn("usage_count", F.coalesce("usage_count", F.lit(0)))
        .drop("_n")
    )
    return after, changed, remembered


def _person_name() -> Column:
    return F.trim(F.concat(text("nom"), F.lit(" "), text("prenom"))).alias("enseignant")


def list_conflicts(conflicts: DataFrame, people: DataFrame, status: str = "open") -> DataFrame:
    chosen = conflicts if status == "all" else conflicts.filter(F.col("status") == status)
    names = people.select("person_id", _person_name())
    return chosen.join(names, "person_id").orderBy(F.desc("conflict_id"))


def list_rules(rules: DataFrame, people: DataFrame) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for kv in RULE_LABELS.items() for x in kv])
    shown = F.coalesce(F.element_at(labels, F.col("decision")), F.col("decision"))
    return rules.withColumn("libelle", shown).join(people.select("person_id", _person_name()), "person_id")


def delete_rules(rules: DataFrame, ids: DataFrame) -> DataFrame:
    return rules.join(ids, ids.columns, "left_anti")


def field_history(batch: DataFrame, outcome: DataFrame) -> DataFrame:
    """One row per real value a batch brought to a person."""
    owned = outcome.filter("person_id is not null").select("rid", "person_id")
    return resolution.long_values(batch, FIELDS, "rid", *PROVENANCE).join(owned, "rid")


def history_of(history: DataFrame, person_id: int) -> DataFrame:
    return history.filter(F.col("person_id") == person_id).orderBy(F.desc("rid"))


def fragments(batch: DataFrame) -> DataFrame:
    """Records with content that identify nobody, with the reason."""
    nobody = keys.identity_key("email", "telephone", "nom", "prenom") == ""
    data = F.to_json(F.struct(*FIELDS, "extras"))
    return batch.filter(has_any_content() & nobody).select(
        "rid", *PROVENANCE, data.alias("donnees"), F.lit(NO_IDENTITY).alias("raison")
    )


def import_log(batch: DataFrame) -> DataFrame:
    return batch.groupBy(clean_ws("source_document").alias("source_document")).agg(
        F.count(F.lit(1)).alias("nb_lignes")
    )


def similar_names(people: DataFrame, floor: float = 0.86) -> DataFrame:
    """Pairs of different names alike enough to be one person, at the level of names.

    Whichever name is listed first (by nom, prenom) is the one searched for.
    """
    key = keys.full_name_key("nom", "prenom")
    named = people.select(key.alias("text"), F.struct(text("nom"), text("prenom"), "person_id").alias("at"))
    names = named.filter("text <> ''").groupBy("text").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    # Read by the pairs and by both joins.
    names = cut_lineage(names)
    pairs = similar_within(names, floor).filter("ratio < 1")
    side = lambda s: names.select(F.col("text").alias(s), F.col("first").alias(f"first_{s}"), F.col("last").alias(f"last_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter("first_a < last_b")


def possible_duplicates(people: DataFrame, floor: float = 0.86) -> DataFrame:
    """Pairs of people with similar but different names; expands name pairs to people."""
    pairs = similar_names(people, floor).select("a", "b", "ratio")
    at = F.struct(text("nom"), text("prenom"), "person_id")
    side = lambda s: people.select(
        keys.full_name_key("nom", "prenom").alias(s),
        F.col("person_id").alias(f"id_{s}"),
        F.concat(text("nom"), F.lit(" "), text("prenom")).alias(f"enseignant_{s}"),
        at.alias(f"at_{s}"),
    )
    return (
        pairs.join(side("a"), "a").join(side("b"), "b").filter("at_a < at_b")
        .select("id_a", "enseignant_a", "id_b", "enseignant_b", F.round("ratio", 3).alias("similarite"))
    )


def delete_people(ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the given person ids."""
    gone = ids.select("person_id").distinct()
    return {name: df.join(gone, "person_id", "left_anti") for name, df in tables.items()}


def people_listing(people: DataFrame) -> DataFrame:
    return people.orderBy("nom", "prenom", "person_id")


def person_profile(people: DataFrame) -> DataFrame:
    """Main fields, extras and provenance as (person_id, section, information, valeur) rows."""
    main = F.array(
        *[
            F.struct(F.lit(n).alias("information"), F.when(clean_ws(c) == "", UNSTATED).otherwise(F.col(c)).alias("valeur"))
            for c, n in FIELDS.items()
        ]
    )
    first = people.select("person_id", F.lit("principale").alias("section"), F.explode(main).alias("x")).select(
        "person_id", "section", "x.*"
    )
    more = people.select(
        "person_id", F.lit("secondaire").alias("section"), F.explode("extras").alias("information", "v")
    ).select("person_id", "section", "information", F.array_join("v", ", ").alias("valeur"))
    origin = F.array(
        F.struct(F.lit("Source document").alias("information"), F.col("source_document").alias("valeur")),
        F.struct(F.lit("Feuille/Section").alias("information"), F.col("feuille").alias("valeur")),
    )
    meta = people.select("person_id", F.lit("secondaire").alias("section"), F.explode(origin).alias("x")).select(
        "person_id", "section", "x.*"
    ).filter(clean_ws("valeur") != "")
    return first.unionByName(more).unionByName(meta)
