"""Linking questions to the people, subjects, rooms and programmes they name."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.folding import text
from ..session import cut_lineage
from ..skew import hot_groups, in_order, look_up, shuffled, split_sides
from .matching import similar_pairs

KINDS = {
    "enseignant": "professeur", "matiere": "matière", "salle": "salle", "filiere": "filière",
}
COLUMN_NAMES = {"enseignant": "Nom et prénom", "matiere": "Matière", "salle": "Salle", "filiere": "Filière"}
NOBODY = ["", "-", "—", "non precise"]
CUT_OFF, TOKEN_FLOOR, BONUS = 0.72, 0.82, 0.08
GRAMS = (8, 6, 4, 3, 2, 1)
SPLIT_QUESTIONS = 200  # a value asked for by more questions is answered in several tasks
RANGE_ROWS, MOST_RANGES = 200_000, 20_000  # sessions found that a task puts in order, as far as there are tasks enough
LIST_ROWS = 5_000  # sessions of one value, day and time beyond which they are several lists
# --- fixed values: words that reveal what a question is after ---
INTENTS = {
    "asks_time": ["quelle heure", "quel heure", "a quelle heure", "horaire", "quand"],
    "asks_prof": ["prof", "professeur", "professeurs", "enseignant", "enseignants", "intervenant", "intervenants"],
    "asks_room": ["salle", "salles", "amphi", "amphis"],
    "asks_subject": ["matiere", "matieres", "module", "modules", "cours"],
    "asks_filiere": ["filiere", "filieres"],
    "asks_planning": ["planning", "emploi", "seance", "seances"],
}
KIND_INTENT = {"professeur": "asks_prof", "matière": "asks_subject", "salle": "asks_room", "filière": "asks_filiere"}


def question_intents(questions: DataFrame) -> DataFrame:
    key = keys.question_key("question")
    flags = {n: key.rlike("|".join(words)) for n, words in INTENTS.items()}
    return questions.withColumns({**flags, "day": F.coalesce(keys.find_day("question"), F.lit(""))})


def entity_dictionary(sessions: DataFrame, order: str = "ord") -> DataFrame:
    """Distinct values per kind, for all days (scope "") and for each day.

    Values equal after normalisation are one entity, shown as first seen.
    """
    value = lambda c, kind: F.struct(
        F.lit(kind).alias("kind"), F.lit(c).alias("col"), F.trim(text(c)).alias("value")
    )
    day = F.upper(keys.question_key("jour"))
    # Days are folded once per distinct value, not once per session.
    told = (
        sessions.select(F.col(order).alias("_o"), "jour", F.explode(F.array(*[value(c, k) for c, k in KINDS.items()])).alias("v"))
        .groupBy("jour", "v").agg(F.min("_o").alias("_o"))
    )
    return (
        cut_lineage(told).select("_o", F.explode(F.array(F.lit(""), day)).alias("scope"), "v.*")
        .groupBy("scope", "kind", "col", "value")
        .agg(F.min("_o").alias("_o"))
        .withColumn("norm", keys.question_key("value"))
        .filter(~F.col("norm").isin(NOBODY))
        .groupBy("scope", "kind", "col", "norm")
        .agg(F.min_by("value", "_o").alias("value"))
    )


def _tail(c: Column) -> Column:
    """The longest ending of a text among the indexed lengths."""
    out = F.lit(None)
    for n in reversed(GRAMS):
        out = F.when(F.length(c) >= n, F.substring(c, -n, n)).otherwise(out)
    return out


def _grams(c: Column) -> Column:
    """Every distinct substring of the indexed lengths."""
    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(c) - (n - 1))
        cut = F.transform(starts, lambda i: F.substring(c, i, F.lit(n)))
        return F.when(F.length(c) >= n, cut).otherwise(F.array().cast("array<string>"))

    parts = [of_length(n) for n in GRAMS]
    return F.array_distinct(F.concat(*parts))


def entity_scores(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """Scores of the entities a question may mean: (question_id, scope, kind, col, norm, value, score).

    1 when the value occurs in the question, else from shared words, else from similar
    words. Candidates come from equality joins on text endings and words.
    """
    q = questions.select("question_id", "scope", keys.question_key("question").alias("qn"), F.array_distinct(keys.entity_tokens("question")).alias("qt"))
    names = entities.select("norm").distinct()
    tokens = names.select("norm", F.explode(F.array_distinct(keys.entity_tokens("norm"))).alias("token"))
    asked = q.select("question_id", F.explode("qt").alias("token"))
    # The question itself is only sent to the few names whose ending it has, not with each substring.
    endings = (
        q.select("question_id", F.explode(_grams(F.col("qn"))).alias("gram"))
        .join(names.withColumn("gram", _tail(F.col("norm"))), "gram")
        .select("question_id", "norm").distinct()
    )
    contained = (
        endings.join(q.select("question_id", "qn"), "question_id")
        .filter(F.col("qn").contains(F.col("norm")))
        .select("question_id", "norm", F.lit(1.0).alias("score"))
    )
    shared = asked.join(tokens, "token").groupBy("question_id", "norm").agg(
        F.greatest(
            0.86 + 0.04 * F.least(F.count(F.lit(1)) - 1, F.lit(2)),
            F.lit(0.72 + (1.0 - TOKEN_FLOOR) * 0.8),  # an equal word is also the most similar one
        ).alias("score")
    )
    as_text = lambda df: df.select(F.col("token").alias("text"))
    alike = similar_pairs(as_text(asked), as_text(tokens), TOKEN_FLOOR).filter("a <> b")
    fuzzy = (
        asked.join(alike.select(F.col("a").alias("token"), F.col("b"), "ratio"), "token")
        .join(tokens.withColumnRenamed("token", "b"), "b")
        .groupBy("question_id", "norm")
        .agg((0.72 + (F.max("ratio") - TOKEN_FLOOR) * 0.8).alias("score"))
    )
    best = (
        contained.unionByName(shared).unionByName(fuzzy)
        .groupBy("question_id", "norm").agg(F.least(F.max("score"), F.lit(1.0)).alias("score"))
    )
    return best.join(q.select("question_id", "scope"), "question_id").join(entities, ["scope", "norm"])


def link_entity(questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """The entity each question is about, among the sessions of the day it names."""
    asked = question_intents(questions).withColumn("scope", F.col("day"))
    scored = entity_scores(asked, entity_dictionary(sessions)).filter(F.col("score") >= CUT_OFF)
    per_kind = scored.groupBy("question_id", "kind", "col").agg(
        F.max(F.struct("score", "value", "norm")).alias("b")
    )
    bonus = F.lit(0.0)
    for kind, flag in KIND_INTENT.items():
        bonus = F.when((F.col("kind") == kind) & F.col(flag), BONUS).otherwise(bonus)
    named = F.create_map(*[F.lit(x) for kv in COLUMN_NAMES.items() for x in kv])
    rank = F.struct(
        F.least(F.lit(1.0), F.col("b.score") + bonus).alias("score"),
        F.element_at(named, F.col("col")).alias("shown"), "kind", F.col("b.value").alias("value"),
        F.col("b.norm").alias("norm"), "col",
    )
    flags = asked.select("question_id", "day", *KIND_INTENT.values())
    return (
        per_kind.join(flags, "question_id")
        .groupBy("question_id", "day").agg(F.max(rank).alias("m"))
        .select("question_id", "day", "m.kind", "m.col", "m.value", "m.norm", "m.score")
    )


def entity_schedule(linked: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct sessions of each question's entity on its day, by day and time.

    Names and days are folded once per distinct text. The sessions of one value, day and time are one list;
    how many there are is counted first and tells which range of the result a question's day and time belongs
    to. So questions meet lists, lists are put in order, and only then they become rows.
    """
    shown = ["jour", "horaire", "matiere", "type_seance", "enseignant", "salle", "filiere", "groupe"]
    alone = F.count(F.lit(1)).over(Window.partitionBy("question_id")) == 1
    asked = cut_lineage(linked.select("question_id", "day", "col", "norm").distinct().withColumn("_alone", alone))
    told = cut_lineage(sessions.select(*shown).distinct())
    in_columns = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), text(c).alias("raw")) for c in KINDS])).alias("e")
    named = cut_lineage(told.select(in_columns).select("e.*").distinct()).withColumn("norm", keys.question_key("raw"))
    wanted = named.join(shuffled(asked.select("col", "norm").distinct()), ["col", "norm"])
    sortable = lambda c: F.coalesce(F.concat(F.lit(" "), c), F.lit("")).alias(f"_{c}")  # noqa: E731 (null comes first)
    at = ["col", "norm", "_jour", "_horaire"]
    by_value = look_up(told.select(*shown, in_columns).select(*shown, "e.*"), wanted, ["col", "raw"]).select(
        "col", "norm", sortable("jour"), sortable("horaire"), F.struct(*shown).alias("s")
    )
    counted = cut_lineage(by_value.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")))
    days = counted.select("_jour").distinct().withColumn("_day", F.upper(keys.question_key("_jour")))
    due = asked.join(shuffled(counted.join(shuffled(days), "_jour")), ["col", "norm"]).filter(
        (F.col("day") == "") | (F.col("day") == F.col("_day"))
    )
    due = cut_lineage(due.select("question_id", "_alone", *at, "_n"))
    rows = due.agg(F.sum("_n")).first()[0] or 0
    ranges = min(MOST_RANGES, math.ceil(rows / RANGE_ROWS) or 1)
    # What a question finds at one time is never cut: entities share the running count.
    upto = F.sum("_n").over(Window.partitionBy("_range").orderBy("question_id", "_jour", "_horaire"))
    placed = in_order(due, ["question_id", "_jour", "_horaire"], F.col("_n")).withColumn("_at", F.col("_before") + upto)
    part = F.floor((F.col("_at") - 1) * ranges / F.col("_all")).cast("int").alias("_part")
    placed = cut_lineage(placed.select("question_id", "_alone", *at, "_at", part))
    spread, placed = split_sides(
        by_value.withColumn("_h", F.xxhash64("s")), placed, hot_groups(counted, at, LIST_ROWS, "_n"), at, "_h"
    )
    lists = spread.groupBy(*at, "_salt").agg(F.collect_list("s").alias("ss")).withColumnRenamed("_salt", "_list")
    # Few values may be asked for by most questions: those are spread over tasks.
    placed = placed.withColumnRenamed("_salt", "_list")
    left, right = split_sides(placed, lists, hot_groups(placed, at, SPLIT_QUESTIONS), at, "question_id")
    found = left.join(shuffled(right), [*at, "_list", "_salt"])
    # One entity's sessions are distinct already; only what a question finds under several is compared.
    single, several = (found.filter(c).select("_part", "_at", "question_id", "ss") for c in ("_alone", "not _alone"))
    one = several.select("_part", "_at", "question_id", F.explode("ss").alias("s")).distinct()
    return (
        single.unionByName(one.select("_part", "_at", "question_id", F.array("s").alias("ss")))
        .repartitionById(ranges, F.col("_part")).sortWithinPartitions("_at").select("question_id", F.inline("ss"))
    )


def day_answers(sessions: DataFrame) -> dict[str, DataFrame]:
    """Teachers, rooms, subjects and programmes of each day."""
    rows = sessions.select("jour", "enseignant", "matiere", "type_seance", "horaire", "salle", "filiere")
    named = lambda c: ~F.trim(text(c)).isin("", "-", "—")
    teachers = rows.filter(named("enseignant")).select("jour", "enseignant", "matiere", "horaire", "salle", "filiere").distinct()
    return {
        "teachers": teachers,
        "teacher_count": teachers.groupBy("jour").agg(F.count_distinct(F.trim("enseignant")).alias("professeurs")),
        "rooms": rows.filter(F.trim("salle") != "").select("jour", "salle", "horaire", "matiere", "enseignant", "filiere").distinct(),
        "subjects": rows.select("jour", "matiere", "type_seance", "horaire", "enseignant", "salle", "filiere").distinct(),
        "programmes": rows.select("jour", F.trim("filiere").alias("filiere")).filter("filiere <> ''").distinct(),
    }
