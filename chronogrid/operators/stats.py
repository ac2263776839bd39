"""Dashboards and statistics over sessions, versions and change summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.folding import text
from ..skew import blank, in_order

ALL = "Tous"
QUALITY_FIELDS = {
    "jour": "Jour", "horaire": "Horaire", "matiere": "Matière", "enseignant": "Enseignant",
    "salle": "Salle", "filiere": "Filière", "niveau": "Semestre",
}
COUNTERS = {"modified_count": "Modifiées", "added_count": "Ajoutées", "removed_count": "Supprimées"}


def scope(df: DataFrame, filters: Mapping[str, str], active_only: bool = False) -> DataFrame:
    """Equality filters where "Tous" means any, plus the active flag when asked."""
    out = df
    for column, value in filters.items():
        if value and value != ALL and column in df.columns:
            out = out.filter(F.col(column).cast("string") == value)
    if active_only and "is_active" in df.columns:
        out = out.filter(F.coalesce(F.col("is_active"), F.lit(0)) == 1)
    return out


def filter_options(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values in order, after the "Tous" entry (rank 0)."""
    values = (
        df.select(F.trim(text(column)).alias("valeur"))
        .filter(F.col("valeur") != "")
        .distinct()
        .select(F.lit(1).alias("rang"), "valeur")
    )
    first = df.sparkSession.createDataFrame([(0, ALL)], "rang int, valeur string")
    return first.unionAll(values).orderBy("rang", "valeur")


def total_changes() -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in COUNTERS), F.lit(0)).cast("bigint")


def overview_kpis(sessions: DataFrame, versions: DataFrame, changes: DataFrame) -> DataFrame:
    named = lambda c: F.count_distinct(F.when(text(c) != "", F.col(c)))
    s = sessions.agg(
        F.count(F.lit(1)).alias("seances"),
        F.coalesce(F.sum("duree"), F.lit(0.0)).alias("heures"),
        named("enseignant").alias("enseignants"),
        named("salle").alias("salles"),
        named("matiere").alias("matieres"),
        F.count_distinct("filiere", "niveau").alias("programmes"),
    )
    v = versions.agg(F.count(F.lit(1)).alias("versions"))
    c = changes.agg(F.coalesce(F.sum(total_changes()), F.lit(0)).alias("changements"))
    # Three one-row results side by side.
    return s.crossJoin(v).crossJoin(c)


def day_activity(sessions: DataFrame) -> DataFrame:
    return (
        sessions.filter(~blank("jour"))
        .groupBy("jour")
        .agg(F.count("session_id").alias("seances"), F.round(F.sum("duree"), 2).alias("heures"))
        .withColumn("ordre", keys.day_order("jour"))
        .orderBy("ordre", "jour")
    )


def programme_activity(sessions: DataFrame, top: int = 15) -> DataFrame:
    return (
        sessions.groupBy("filiere", "niveau")
        .agg(F.count(F.lit(1)).alias("seances"))
        .withColumn("programme", F.concat_ws(" ", "filiere", "niveau"))
        .orderBy(F.desc("seances"), "filiere", "niveau")
        .limit(top)
    )


def _load(sessions: DataFrame, by: str, distinct: Mapping[str, str]) -> DataFrame:
    """Sessions, hours and distinct counts per value of ``by``; blank counts as a value."""
    return (
        sessions.filter(~blank(by))
        .groupBy(by)
        .agg(
            F.count("session_id").alias("seances"),
            F.round(F.sum("duree"), 2).alias("heures"),
            *[F.count_distinct(text(c)).alias(name) for c, name in distinct.items()],
        )
    )


def teacher_load(sessions: DataFrame) -> DataFrame:
    return _load(sessions, "enseignant", {"matiere": "matieres", "filiere": "filieres"})


def room_usage(sessions: DataFrame) -> DataFrame:
    return _load(sessions, "salle", {"enseignant": "enseignants", "matiere": "matieres"})


def subject_load(sessions: DataFrame) -> DataFrame:
    return _load(sessions, "matiere", {"enseignant": "enseignants"})


def top(df: DataFrame, metric: str, name: str, n: int = 15) -> DataFrame:
    return df.orderBy(F.desc(metric), name).limit(n)


def type_distribution(sessions: DataFrame) -> DataFrame:
    kind = F.when(text("type_seance") == "", keys.UNSTATED).otherwise(F.col("type_seance"))
    return sessions.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("seances"))


def versions_per_programme(versions: DataFrame, n: int = 20) -> DataFrame:
    return (
        versions.groupBy("filiere", "niveau")
        .agg(F.count(F.lit(1)).alias("versions"))
        .withColumn("programme", F.concat_ws(" ", "filiere", "niveau"))
        .orderBy(F.desc("versions"), "filiere", "niveau")
        .limit(n)
    )


def _long(changes: DataFrame, *ids: str) -> DataFrame:
    return changes.select(
        *ids,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(label).alias("type"), F.coalesce(F.col(c), F.lit(0)).alias("nombre"))
                    for c, label in COUNTERS.items()
                ]
            )
        ).alias("x"),
    ).select(*ids, "x.type", "x.nombre")


def change_totals(changes: DataFrame) -> DataFrame:
    return _long(changes).groupBy("type").agg(F.sum("nombre").alias("nombre"))


def changes_long(changes: DataFrame) -> DataFrame:
    """One row per version transition and kind of change."""
    return _long(changes, "filiere", "niveau", "version_number")


def changes_wide(long: DataFrame) -> DataFrame:
    return (
        long.groupBy("filiere", "niveau", "version_number")
        .pivot("type", list(COUNTERS.values()))
        .sum("nombre")
        .na.fill(0)
    )


def change_ranking(changes: DataFrame) -> DataFrame:
    return (
        changes.groupBy("filiere", "niveau")
        .agg(F.sum(total_changes()).alias("changements"))
        .withColumn("programme", F.concat_ws(" ", "filiere", "niveau"))
        .orderBy(F.desc("changements"), "filiere", "niveau")
    )


def archive_counts(**tables: DataFrame) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("lignes")).select(F.lit(name).alias("table_name"), "lignes")
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def auto_insights(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """Busiest day, heaviest teacher, busiest room and the most changed transition."""

    def leader(by: str, metric: Column, kind: str, shown) -> DataFrame:
        best = (
            sessions.filter(~blank(by))
            .groupBy(F.col(by).alias("valeur"))
            .agg(metric.alias("m"))
            .orderBy(F.desc("m"), "valeur")
            .limit(1)
        )
        return best.select(F.lit(kind).alias("indicateur"), "valeur", shown(F.col("m")).alias("note"))

    seen = lambda m: F.format_string("%d séances", m)
    moved = (
        changes.withColumn("m", total_changes())
        .filter("m > 0")
        .orderBy(F.desc("m"), "filiere", "niveau", "version_number")
        .limit(1)
        .select(
            F.lit("Transition la plus mouvementée").alias("indicateur"),
            F.format_string("%s %s V%d", "filiere", "niveau", "version_number").alias("valeur"),
            F.format_string("%d changements", "m").alias("note"),
        )
    )
    return (
        leader("jour", F.count(F.lit(1)), "Jour le plus chargé", seen)
        .unionAll(
            leader(
                "enseignant", F.sum("duree"), "Charge la plus élevée",
                lambda m: F.format_string("%.1f h", m),
            )
        )
        .unionAll(leader("salle", F.count(F.lit(1)), "Salle la plus sollicitée", seen))
        .unionAll(moved)
    )


def occupancy_heatmap(sessions: DataFrame) -> DataFrame:
    return (
        sessions.filter(~blank("jour") & ~blank("horaire"))
        .groupBy("jour", "horaire")
        .agg(F.count(F.lit(1)).alias("seances"))
        .withColumn("ordre", keys.day_order("jour"))
    )


def occupancy_matrix(heatmap: DataFrame) -> DataFrame:
    """One row per time with a column per weekday, 0 where nothing takes place.

    Weekdays are the known, fixed side, so they become the columns; times stay rows.
    """
    return (
        heatmap.groupBy("horaire").pivot("jour", keys.WEEK_DAYS).sum("seances").na.fill(0)
    )


def exact_quantiles(rows: DataFrame, metric: str, shares: dict[str, float]) -> DataFrame:
    """One row with the interpolated quantile for each name in ``shares``; null without values.

    Equal values are counted first; the distinct ones are put into one order, cut into ranges, and each range
    learns how many rows lie before it. The values at the wanted ranks are then picked out, so no task sees more
    than a range of the distinct values.
    """
    counted = rows.filter(F.col(metric).isNotNull()).groupBy(F.col(metric).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = in_order(counted, [F.col("v")], F.col("n"))
    inside = Window.partitionBy("_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("n").over(inside)  # ranks from upto - n to upto - 1 hold the value
    placed = ranged.select("v", (upto - F.col("n")).alias("first"), upto.alias("upto"), F.col("_all").alias("total"))
    position = lambda share: F.lit(share) * (F.col("total") - 1)
    at = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank < F.col("upto")), F.col("v")))
    found = placed.agg(
        F.max("total").alias("total"),
        *[at(f(position(p))).alias(f"{name}_{side}") for name, p in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))],
    )
    value = lambda name, p: F.when(F.col(f"{name}_low") == F.col(f"{name}_high"), F.col(f"{name}_low")).otherwise(
        (F.ceil(position(p)) - position(p)) * F.col(f"{name}_low") + (position(p) - F.floor(position(p))) * F.col(f"{name}_high")
    )
    return found.select(*[value(name, p).alias(name) for name, p in shares.items()])


def iqr_outliers(loads: DataFrame, metric: str = "heures", minimum: int = 4) -> DataFrame:
    """Rows outside 1.5 interquartile ranges, with the bounds; nothing below 4 rows."""
    quartiles = exact_quantiles(loads, metric, {"q1": 0.25, "mediane": 0.5, "q3": 0.75})
    bounds = quartiles.crossJoin(loads.agg(F.count(F.lit(1)).alias("n"))).select(
        "q1", "mediane", "q3", "n",
        F.greatest(F.lit(0.0), F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("borne_basse"),
        (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("borne_haute"),
    )
    # The bounds are one row.
    return (
        loads.crossJoin(F.broadcast(bounds))
        .filter(F.col("n") >= minimum)
        .withColumn(
            "atypique", (F.col(metric) < F.col("borne_basse")) | (F.col(metric) > F.col("borne_haute"))
        )
        .drop("n")
    )


def pareto(sessions: DataFrame, dim: str) -> DataFrame:
    """Sessions per value, largest first, with the cumulative share."""
    counts = sessions.filter(~blank(dim)).groupBy(F.col(dim).alias("valeur")).agg(
        F.count(F.lit(1)).alias("seances")
    )
    return running_share(counts, "seances", "valeur")


def running_share(counts: DataFrame, metric: str, name: str) -> DataFrame:
    """Cumulative percentage in (metric desc, name) order without a global window."""
    order = [F.desc(metric), F.asc(name)]
    ranged = in_order(counts, order, F.col(metric))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return ranged.select(
        name,
        metric,
        (100.0 * (F.col("_before") + F.sum(metric).over(inside)) / F.col("_all")).alias("part_cumulee"),
    )


def pareto_size(shares: DataFrame, share: float = 80.0) -> DataFrame:
    """How many values reach ``share`` percent: those within it plus one unless all are."""
    within = F.count_if(F.col("part_cumulee") <= share)
    total = F.count(F.lit(1))
    return shares.agg(
        F.when(within < total, within + 1).otherwise(within).alias("n80"), total.alias("valeurs")
    )


def control_chart(changes: DataFrame, minimum: int = 3) -> DataFrame:
    """Changes per transition against mean and three-sigma limits.

    The chronological index is the rank within a creation date plus the transitions of
    all earlier dates; the dates alone are put in one global order.
    """
    data = changes.withColumn("total", total_changes().cast("double")).withColumn(
        "_date", F.substring("created_at", 1, 10)
    )
    limits = data.agg(
        F.avg("total").alias("moyenne"),
        F.coalesce(F.stddev_samp("total"), F.lit(0.0)).alias("ecart_type"),
        F.count(F.lit(1)).alias("n"),
    ).select(
        "moyenne", "ecart_type", "n",
        (F.col("moyenne") + 3 * F.col("ecart_type")).alias("ucl"),
        F.greatest(F.lit(0.0), F.col("moyenne") - 3 * F.col("ecart_type")).alias("lcl"),
    )
    earlier = Window.orderBy("_date").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        data.groupBy("_date")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_date", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_date").orderBy("created_at", "filiere", "niveau", "version_number")
    return (
        data.join(shift, "_date")
        .withColumn("rang", F.row_number().over(inside) + F.col("_before"))
        .crossJoin(F.broadcast(limits))
        .filter(F.col("n") >= minimum)
        .select(
            "rang", "filiere", "niveau", "version_number", "created_at", "total",
            "moyenne", "ecart_type", "ucl", "lcl",
            (F.col("total") > F.col("ucl")).alias("signal"),
        )
    )


def stability_index(changes: DataFrame, n: int = 20) -> DataFrame:
    """The least stable transitions; an empty base counts as fully stable."""
    base = total_changes() + F.coalesce(F.col("unchanged_count"), F.lit(0))
    rate = F.when(base > 0, 100.0 * total_changes() / base).otherwise(0.0)
    return (
        changes.select(
            "academic_year", "period", "filiere", "niveau", "version_number",
            total_changes().alias("changements"), rate.alias("taux_changement"),
        )
        .withColumn("stabilite", 100.0 - F.col("taux_changement"))
        .orderBy(F.desc("taux_changement"), "academic_year", "period", "filiere", "niveau", "version_number")
        .limit(n)
    )


def completeness(sessions: DataFrame) -> DataFrame:
    """Missing values per field in one pass, with the overall score on every row."""
    counted = sessions.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(blank(text(c))).alias(c) for c in QUALITY_FIELDS]
    )
    missing = sum((F.col(c) for c in QUALITY_FIELDS), F.lit(0))
    cells = F.col("total") * len(QUALITY_FIELDS)
    percent = lambda part, whole: F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(label).alias("champ"), F.col(c).alias("manquants"))
                for c, label in QUALITY_FIELDS.items()
            ]
        )
    )
    return counted.select(
        rows.alias("f"),
        "total",
        F.when(cells > 0, 100.0 * (1.0 - missing / cells)).otherwise(0.0).alias("score"),
    ).select(
        "f.champ",
        "f.manquants",
        percent(F.col("f.manquants"), F.col("total")).alias("taux_manquant"),
        (100.0 - percent(F.col("f.manquants"), F.col("total"))).alias("completude"),
        "score",
    )
