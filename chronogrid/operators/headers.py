"""Recognising the columns of staff files (H1, H2, H3, H5, H6)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.extras import EXTRAS_TYPE
from ..functions.folding import clean_ws
from ..session import cut_lineage
from ..skew import BROADCAST_ROWS, shuffled
from .matching import similar_pairs
from .people import has_any_content

IGNORE = "Ignorer"
FULL_NAME = "Nom complet"
FUZZY_FLOOR = 0.88
TASK_CELLS = 200_000  # cells whose records one task makes

# --- fixed values: spellings of each column (accent and case variants fold together) ---
SYNONYMS = {
    "Statut": [
        "statut", "statut enseignant", "type enseignant", "type d enseignant",
        "situation administrative", "qualite", "categorie", "position administrative",
        "type intervenant", "nature intervenant",
    ],
    "Nom": [
        "nom", "nom enseignant", "nom de famille", "family name", "surname", "last name",
        "last name required", "familyname", "lastname",
    ],
    "Prénom": [
        "prenom", "prenom enseignant", "first name", "given name", "first name required",
        "firstname", "givenname",
    ],
    "Nom complet": [
        "nom et prenom", "nom complet", "enseignant", "professeur", "intervenant", "full name",
        "display name", "name",
    ],
    "Email": [
        "email", "e-mail", "e mail", "mail", "adresse mail", "mail professionnel",
        "email professionnel", "adresse electronique", "courriel", "email address",
        "email address required", "adresse e-mail", "messagerie",
    ],
    "Téléphone": [
        "telephone", "tel", "tel portable", "telephone portable", "numero telephone", "gsm",
        "portable", "mobile", "phone", "phone number", "numero de telephone",
    ],
    "Diplôme": [
        "diplome", "diplome obtenu", "dernier diplome", "plus haut diplome", "qualification",
        "degree", "highest degree", "grade universitaire", "titre universitaire",
    ],
    "Spécialité": [
        "specialite", "specialite diplome", "discipline", "domaine", "specialization",
        "specialisation", "domaine de specialite", "champ disciplinaire",
    ],
    "Département": [
        "departement", "departement d affectation", "dept", "department", "structure", "service",
        "unite", "departement pedagogique",
    ],
}
FIELD_COLUMNS = {
    "Statut": "statut", "Nom": "nom", "Prénom": "prenom", "Email": "email",
    "Téléphone": "telephone", "Diplôme": "diplome", "Spécialité": "specialite",
    "Département": "departement",
}


def dictionary(spark: SparkSession) -> DataFrame:
    """(canonical, variant, rang): the fixed spellings, in order of preference."""
    rows = [(c, v, i) for i, (c, v) in enumerate((c, v) for c, vs in SYNONYMS.items() for v in [c, *vs])]
    raw = spark.createDataFrame(rows, "canonical string, variant string, rang int")
    return raw.withColumn("variant", keys.person_key("variant"))


def canonical_headers(headers: DataFrame, learned: DataFrame) -> DataFrame:
    """``canonical`` for each distinct ``header``; null where it is unknown or ignored.

    A learned mapping wins, then an exact spelling, then the most similar one. The whole
    header is tried before the header without annotations.
    """
    names = dictionary(headers.sparkSession)
    tried = cut_lineage(headers.select("header").distinct()).select(
        "header",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("turn"), keys.person_key("header").alias("text")),
                F.struct(F.lit(1).alias("turn"), keys.person_key(keys.header_base("header")).alias("text")),
            )
        ).alias("c"),
    ).select("header", "c.*")
    # A mapping table is keyed by normalised header; the dictionary is a fixed list.
    taught = learned.select(F.col("normalized_header").alias("text"), F.col("canonical").alias("taught"))
    exact = names.groupBy("variant").agg(F.min_by("canonical", "rang").alias("exact")).withColumnRenamed("variant", "text")
    hit = tried.join(taught, "text", "left").join(F.broadcast(exact), "text", "left")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("turn")))
    whole = F.max(F.when(F.col("turn") == 0, F.col("text")))
    found = hit.groupBy("header").agg(first("taught").alias("taught"), first("exact").alias("exact"), whole.alias("whole"))
    open_ones = tried.join(found.filter("taught is null and exact is null").select("header"), "header")
    alike = similar_pairs(
        open_ones.filter(F.length("text") >= 3).select("text"), names.select(F.col("variant").alias("text")), FUZZY_FLOOR
    )
    near = (
        open_ones.join(alike.select(F.col("a").alias("text"), F.col("b").alias("variant"), "ratio"), "text")
        .join(F.broadcast(names), "variant")
        .groupBy("header")
        .agg(F.max_by("canonical", F.struct("ratio", -F.col("turn"), -F.col("rang"))).alias("near"))
    )
    technical = F.col("whole").startswith("status") & F.col("whole").rlike("read only|readonly")
    return found.join(near, "header", "left").select(
        "header",
        F.when(technical, None)
        .when(F.col("taught") == IGNORE, None)
        .otherwise(F.coalesce("taught", "exact", "near"))
        .alias("canonical"),
    )


def score_header_rows(cells: DataFrame, mapping: DataFrame, first_rows: int = 30) -> DataFrame:
    """How many cells of each leading row name a known column. Cells: (doc, row, col, text)."""
    leading = cells.filter(F.col("row") < first_rows)
    known = mapping.filter("canonical is not null").select(F.col("header").alias("text"), F.lit(1).alias("hit"))
    return leading.join(known, "text", "left").groupBy("doc", "row").agg(
        F.coalesce(F.sum("hit"), F.lit(0)).alias("score")
    )


def pick_header(scores: DataFrame) -> DataFrame:
    """The first row with the highest score."""
    return scores.groupBy("doc").agg(
        F.max_by(F.struct("row", "score"), F.struct("score", -F.col("row"))).alias("h")
    ).select("doc", F.col("h.row").alias("header_row"), "h.score")


def map_rows(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Records from long cells (doc, row, col, header, value), those that say anything.

    The first non-blank value of a known column is kept; a differing repeat and every
    unknown column go to the extras.
    """
    c = cells.select("doc", "row", "col", clean_ws("header").alias("header"), clean_ws("value").alias("value")).filter(
        "header <> '' and value <> '' and not lower(header) like 'unnamed%'"
    )
    # Five aggregates read the recognised cells; the files behind them are read once.
    # Few headers stand above all cells: a shuffle by header would leave the cells of one to one task.
    mapping = cut_lineage(mapping)
    known = cut_lineage(c.join(F.broadcast(mapping) if mapping.count() <= BROADCAST_ROWS else shuffled(mapping), "header", "left"))
    # What a task sorts stays bounded however many cells there are.
    known = known.repartition(max(1, math.ceil(known.count() / TASK_CELLS)), "doc", "row")
    field = known.filter(F.col("canonical").isin(list(FIELD_COLUMNS)))
    first = field.groupBy("doc", "row", "canonical").agg(F.min_by("value", "col").alias("kept"))
    pick = lambda n: F.coalesce(F.max(F.when(F.col("canonical") == n, F.col("kept"))), F.lit(""))
    fields = first.groupBy("doc", "row").agg(*[pick(n).alias(col) for n, col in FIELD_COLUMNS.items()])
    full = known.filter(F.col("canonical") == FULL_NAME).groupBy("doc", "row").agg(F.max_by("value", "col").alias("full"))
    repeats = field.join(shuffled(first), ["doc", "row", "canonical"]).filter("value <> kept").select("doc", "row", "col", "header", "value")
    unknown = known.filter(F.col("canonical").isNull()).select("doc", "row", "col", "header", "value")
    source = full.select("doc", "row", F.lit(-1).alias("col"), F.lit("Nom complet source").alias("header"), F.col("full").alias("value"))
    every = source.unionByName(repeats).unionByName(unknown)
    extras = every.groupBy("doc", "row", "header").agg(F.max_by("value", "col").alias("value")).groupBy("doc", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("header", F.array("value").alias("v")))).alias("extras")
    )
    rows = known.select("doc", "row").distinct()
    out = rows
    for part in (fields, full, extras):  # each has as many rows as the files
        out = out.join(shuffled(part), ["doc", "row"], "left")
    blank = F.lit("")
    out = out.withColumns({x: F.coalesce(F.col(x), blank) for x in FIELD_COLUMNS.values()})
    unnamed = F.col("full").isNotNull() & (F.col("nom") == "") & (F.col("prenom") == "")
    name = keys.split_full_name("full")
    return out.select(
        "doc",
        "row",
        keys.normalize_status("statut").alias("statut"),
        F.when(unnamed, name["nom"]).otherwise(F.col("nom")).alias("nom"),
        F.when(unnamed, name["prenom"]).otherwise(F.col("prenom")).alias("prenom"),
        "email", "telephone", "diplome", "specialite", "departement",
        F.coalesce("extras", F.from_json(F.lit("{}"), EXTRAS_TYPE)).alias("extras"),
    ).filter(has_any_content())


def normalized_header(c: Column | str) -> Column:
    return keys.person_key(keys.header_base(c))


def unknown_headers(batch: DataFrame, mapping: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Unrecognised headers with first and last sighting and count, merged into ``store``.

    ``batch`` holds one row per cell under a header: (header, source_document, seen_at).
    """
    unknown = mapping.filter("canonical is null").select("header")
    new = (
        batch.join(unknown, "header").withColumn("normalized_header", normalized_header("header"))
        .filter("normalized_header <> '' and not lower(header) like 'unnamed%'")
        .groupBy("normalized_header")
        .agg(
            F.max_by(F.struct("header", "source_document"), F.struct("seen_at", "header", "source_document")).alias("l"),
            F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"),
            F.count(F.lit(1)).alias("seen_count"),
        )
        .select("normalized_header", F.col("l.header").alias("source_header"), "l.source_document", "first_seen", "last_seen", "seen_count")
    )
    if store is None:
        return new
    o, n = store.alias("o"), new.alias("n")
    later = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return o.join(n, F.col("o.normalized_header") == F.col("n.normalized_header"), "full").select(
        later("normalized_header"), later("source_header"), later("source_document"),
        F.coalesce("o.first_seen", "n.first_seen").alias("first_seen"), later("last_seen"),
        (F.coalesce("o.seen_count", F.lit(0)) + F.coalesce("n.seen_count", F.lit(0))).alias("seen_count"),
    )


def learn_mapping(store: DataFrame, new: DataFrame, unknown: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Learned mappings after ``new`` (header, canonical, order), and the headers still unknown."""
    allowed = [*FIELD_COLUMNS, FULL_NAME, IGNORE]
    fresh = (
        new.filter(F.col("canonical").isin(allowed))
        .groupBy(normalized_header("header").alias("normalized_header"))
        .agg(F.max_by(F.struct(clean_ws("header").alias("h"), "canonical"), order).alias("_n"), F.count(F.lit(1)).alias("_c"))
    )
    after = store.join(fresh, "normalized_header", "full").select(
        "normalized_header",
        F.coalesce("_n.h", "source_header").alias("source_header"),
        F.coalesce("_n.canonical", "canonical").alias("canonical"),
        (F.coalesce("usage_count", F.lit(0)) + F.coalesce("_c", F.lit(0))).alias("usage_count"),
    )
    return after, unknown.join(fresh, "normalized_header", "left_anti")
