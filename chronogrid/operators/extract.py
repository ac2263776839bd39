"""Sessions from decoded pages: lines, cells and positioned text.

Inputs are tables, one row per page, cell or text line. A page's lines are handled inside
its row; cells and positioned lines are joined to the day they fall under, and only the
few fragments of one course are ever collected together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, times
from ..functions.folding import clean_ws, text
from ..session import cut_lineage
from ..skew import keep_first, settled

# --- fixed values: patterns and words of the timetable layouts ---
TIME = r"(?i)(?<!\d)\d{1,2}(?:[h:.]\d{0,2})?\s*[-–—−]\s*\d{1,2}(?:[h:.]\d{0,2})?(?!\d)"
TEACHER = r"(?i)^(?:Prof\.?|Pr\.?|Dr\.?)\s+"
ROOM = r"(?i)\b(?:Salle|Amphi|SM\s*\d+|SC\s*\d+|TP\s*\d+)\b"
GROUP = r"(?i)^(?:Groupe\s+\w+|TC(?:\s|$))"
TYPES = ["CM", "TD", "TP", "TDM", "COURS", "COURS/TD", "COURS/TD/TP"]
CODES = ["GITAM", "MGPDI", "GCCD", "IDSD", "ILCS", "FBTD", "DAWM", "GEE", "IAID", "MLT", "WM", "RT"]
UNNAMED = "À compléter"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
FIVE_LANES = [(91, 241), (241, 390), (390, 532), (532, 675), (675, 817)]
FOUR_LANES = [(94, 260), (260, 430), (445, 614), (614, 808)]
# ------------------------------------------------------------------
META = ["filiere", "niveau", "academic_year"]
RECORD = ["jour", "matiere", "type_seance", "enseignant", "horaire", "duree", "groupe", "salle"]


def lines_of(c: Column | str) -> Column:
    cut = F.transform(F.split(text(c), LINE_BREAKS), clean_ws)
    return F.filter(cut, lambda x: x != "")


def has_time(c: Column) -> Column:
    return c.rlike(TIME)


def document_metadata(pages: DataFrame) -> DataFrame:
    """Programme code and label, semester and academic year of each page (doc, page, text)."""
    body, name = F.col("text"), F.url_decode(F.replace(F.col("doc"), F.lit("+"), F.lit("%2B")))
    grab = lambda c, pattern, g=1: F.nullif(F.regexp_extract(c, pattern, g), F.lit(""))
    labelled = r"(?i)Fili[eè]re\s*:\s*(.+?)\s*\(([A-Z0-9_-]+)\)"
    compact = lambda x: F.upper(F.regexp_replace(x, r"\s+", ""))
    heads = F.slice(F.split(body, LINE_BREAKS), 1, 28)
    alone = F.try_element_at(F.filter(F.transform(heads, compact), lambda x: x.isin(CODES)), F.lit(1))
    in_name = F.coalesce(
        *[F.when(F.upper(name).rlike(rf"(?<![A-Z]){c}(?![A-Z])"), F.lit(c)) for c in CODES]
    )
    code = F.coalesce(
        F.nullif(F.upper(clean_ws(F.regexp_extract(body, labelled, 2))), F.lit("")),
        alone,
        F.upper(grab(body, r"(?i)Fili[eè]re\s*:\s*([A-Z]{2,6})\s*[–-]\s*Semestre")),
        in_name,
        F.lit(""),
    )
    label = F.coalesce(grab(body, labelled, 1), grab(body, r"(?i)Fili[eè]re\s*:\s*(.+)"), F.lit(""))
    short = r"(?i)\bS\.?([1-6])\b"
    level = F.coalesce(
        grab(body, r"(?i)du\s+(\d+)\s*(?:ème|eme|e)?\s*Semestre"),
        grab(body, r"(?i)\bSemestre\s*([1-6])\b"),
        grab(F.substring(body, 1, 1000), short),
        grab(name, short),
    )
    year = F.coalesce(grab(body, r"(?i)Ann[ée]e\s+universitaire\s*:?\s*([0-9]{4}\s*/\s*[0-9]{4})"), F.lit(""))
    return pages.select(
        "doc",
        "page",
        code.alias("filiere"),
        clean_ws(label).alias("filiere_label"),
        F.coalesce(F.concat(F.lit("S"), level), F.lit("")).alias("niveau"),
        F.replace(year, F.lit(" "), F.lit("")).alias("academic_year"),
    )


def propagate_first_page(meta: DataFrame) -> DataFrame:
    """Blank page metadata taken from the document's first page."""
    first = meta.groupBy("doc").agg(*[F.min_by(c, "page").alias(f"_{c}") for c in META])
    fill = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in META}
    return meta.join(first, "doc").withColumns(fill).select(*meta.columns)


def title_case_prefix(c: Column | str) -> Column:
    """Academic title in title case with a full stop; other names unchanged."""
    name = clean_ws(c)
    title = r"(?i)^(Prof|Pr|Dr)\.?\s+(.*)$"
    return F.when(
        name.rlike(title),
        F.concat(F.initcap(F.regexp_extract(name, title, 1)), F.lit(". "), F.regexp_extract(name, title, 2)),
    ).otherwise(name)


def _joined(raw: Column) -> Column:
    """Fragments with wrapped titles and dotted name placeholders put back together."""

    def add(acc: Column, piece: Column) -> Column:
        last = F.element_at(acc, -1)
        glued = lambda x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))
        return (
            F.when(F.size(acc) == 0, F.array(piece))
            .when(F.upper(last).isin("PR", "PROF", "DR"), glued(F.concat(last, F.lit(" "), piece)))
            .when(last.rlike(TEACHER) & (keys.ascii_key(piece) == ""), glued(F.concat(last, piece)))
            .otherwise(F.concat(acc, F.array(piece)))
        )

    # Only a line that is a bare title or starts with one can take up the next line.
    wraps = F.exists(raw, lambda x: x.rlike(TEACHER) | F.upper(x).isin("PR", "PROF", "DR"))
    return F.when(wraps, F.aggregate(raw, F.array().cast("array<string>"), add)).otherwise(raw)


def _first_index(items: Column, test) -> Column:
    """0-based position of the first item that passes, or null."""
    hits = F.filter(F.transform(items, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())
    return F.try_element_at(hits, F.lit(1))


def classify_fragments(df: DataFrame, fragments: str, allow_missing_teacher: bool = True) -> DataFrame:
    """Adds the fields of the course told by a list of fragments; other rows are dropped.

    Adds matiere, enseignant, horaire, type_seance, groupe and salle.
    """
    c = F.col
    is_type = lambda x: F.upper(x).isin(TYPES)
    is_teacher = lambda x: x.rlike(TEACHER)
    raw = F.flatten(F.transform(F.col(fragments), lines_of))
    at = lambda name, column: column.alias(name)
    joined = settled(df, *df.columns, at("_raw", raw))
    joined = settled(joined, *df.columns, at("_f", _joined(c("_raw"))))
    found = settled(
        joined,
        *df.columns,
        "_f",
        at("_t", _first_index(c("_f"), has_time)),
        at("_named", _first_index(c("_f"), is_teacher)),
        at("_room", _first_index(c("_f"), lambda x: x.rlike(ROOM) & ~is_teacher(x))),
    ).filter("_t is not null")
    before = F.filter(
        F.transform(
            c("_f"),
            lambda x, i: F.when((i < c("_t")) & ~i.eqNullSafe(c("_room")) & ~is_type(x), i),
        ),
        lambda i: i.isNotNull(),
    )
    line = F.get("_f", c("_t"))
    rows = settled(
        found,
        *df.columns,
        "_f", "_t", "_room",
        at("_line", line),
        at("horaire", F.regexp_extract(line, TIME, 0)),
        at("_before", before),
        at("_named", c("_named")),
    )
    who = F.coalesce("_named", F.when(F.size("_before") >= 2, F.element_at("_before", -1)))
    rows = settled(
        rows,
        *df.columns,
        "_f", "_t", "_room", "_line", "horaire",
        at("_who", who),
        at("_hours", times.duration_hours("horaire")),
    ).filter("_hours is not null")
    if not allow_missing_teacher:
        rows = rows.filter("_who is not null")
    lead = clean_ws(F.trim(F.split_part(c("_line"), c("horaire"), F.lit(1)), F.lit(" ·")))
    alone = F.coalesce(F.try_element_at(F.filter("_f", is_type), F.lit(1)), F.lit(""))
    end = F.least(c("_t"), F.coalesce(c("_who"), c("_t")))
    said = F.filter(
        F.transform(
            c("_f"),
            lambda x, i: F.when(
                (i < end) & ~i.eqNullSafe(c("_room")) & ~is_type(x) & ~x.isin("—", "-"), x
            ),
        ),
        lambda x: x.isNotNull(),
    )
    told = settled(
        rows,
        *df.columns,
        "horaire",
        at("matiere", F.array_join(said, " ")),
        at("lead", lead),
        at("alone", alone),
        at("groupe", F.coalesce(F.try_element_at(F.filter("_f", lambda x: x.rlike(GROUP)), F.lit(1)), F.lit(""))),
        at("_name", F.coalesce(F.get("_f", c("_who")), F.lit(UNNAMED))),
        at("_place", F.coalesce(F.get("_f", c("_room")), F.lit(""))),
    )
    place = F.substring(c("_name"), F.instr(c("_name"), "·") + 1, F.length("_name"))
    split = c("_name").contains("·") & place.rlike(ROOM)
    return settled(
        told,
        *df.columns,
        "horaire", "matiere", "groupe",
        at("type_seance", F.when(c("lead") != "", c("lead")).otherwise(c("alone"))),
        at("salle", F.when(split, F.trim(place)).otherwise(c("_place"))),
        at("enseignant", F.when(split, F.trim(F.substring_index("_name", "·", 1))).otherwise(c("_name"))),
        at("_exam", keys.ascii_key("matiere") == "EXAMEN"),
    ).filter("matiere <> '' and not _exam").drop("_exam")


def build_records(parsed: DataFrame, *keep: str) -> DataFrame:
    return parsed.select(
        *keep,
        "jour",
        clean_ws("matiere").alias("matiere"),
        clean_ws("type_seance").alias("type_seance"),
        title_case_prefix("enseignant").alias("enseignant"),
        clean_ws("horaire").alias("horaire"),
        times.duration_hours("horaire").alias("duree"),
        clean_ws("groupe").alias("groupe"),
        clean_ws("salle").alias("salle"),
    )


def sessions_from_lines(pages: DataFrame) -> DataFrame:
    """Sessions of pages written as a list: each time line with its nearby lines."""
    days = F.filter(
        F.transform("lines", lambda x, i: F.when(keys.canonical_day(x) != "", i)), lambda i: i.isNotNull()
    )
    hits = F.filter(F.transform("lines", lambda x, i: F.when(has_time(x), i)), lambda i: i.isNotNull())

    def context(t: Column) -> Column:
        day = F.array_max(F.filter("days", lambda d: d < t))
        stop = F.coalesce(F.array_min(F.filter("days", lambda d: d > t)), F.size("lines"))
        previous = F.array_max(F.filter("hits", lambda h: (h < t) & (h > day)))
        start = F.greatest(F.coalesce(previous, day) + 1, t - 7)
        return F.struct(
            t.alias("ord"), keys.canonical_day(F.get("lines", day)).alias("jour"),
            F.slice("lines", start + 1, F.least(stop, t + 3) - start).alias("fragments"),
        )

    cut = settled(pages, "doc", "page", lines_of("text").alias("lines"))
    marked = settled(cut, "doc", "page", "lines", days.alias("days"), hits.alias("hits"))
    under_day = F.filter("hits", lambda h: F.exists("days", lambda d: d < h))
    anchors = (
        settled(marked, "doc", "page", "lines", "days", under_day.alias("hits"))
        .select("doc", "page", F.inline(F.transform("hits", context)))
    )
    found = build_records(classify_fragments(anchors, "fragments"), "doc", "page", "ord")
    return merge_unique(found, ["doc", "page"], "ord")


def _day_blocks(cells: DataFrame, first_column_only: bool) -> DataFrame:
    """Row ranges from one day label to the next, per table."""
    where = ["doc", "page", "table"]
    day = keys.canonical_day("text")
    labels = cells.filter(F.col("col") == 0) if first_column_only else cells
    labels = settled(labels, *labels.columns, day.alias("jour")).filter("jour <> ''")
    per_row = labels.groupBy(*where, "row").agg(
        F.min_by(F.struct(F.col("col").alias("day_col"), "jour"), "col").alias("d")
    )
    nxt = F.lead("row").over(Window.partitionBy(*where).orderBy("row"))
    return per_row.select(*where, F.col("row").alias("start"), nxt.alias("stop"), "d.*")


def _blocks(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of each column inside each day block, top to bottom."""
    where = ["doc", "page", "table"]
    inside = (F.col("row") >= F.col("start")) & (F.col("stop").isNull() | (F.col("row") < F.col("stop")))
    said = cells.filter(clean_ws("text") != "")
    return (
        said.join(labels, where)
        .filter(inside & (F.col("col") != F.col("day_col")))
        .groupBy(*where, "start", "jour", "col")
        .agg(F.array_sort(F.collect_list(F.struct("row", "text")))["text"].alias("fragments"))
    )


def sessions_from_day_blocks(cells: DataFrame) -> DataFrame:
    """Tables whose first column names the day: one course per column and day block."""
    blocks = _blocks(cells.filter("row is not null"), _day_blocks(cells, True))
    parsed = classify_fragments(blocks, "fragments", allow_missing_teacher=False)
    return build_records(parsed, "doc", "page", "table", "start", "col")


def sessions_from_grid(cells: DataFrame) -> DataFrame:
    """Grids with the days as column heads, or as row heads with times above."""
    where = ["doc", "page", "table"]
    cells = cut_lineage(cells)  # read for heads, days, times and both kinds of table
    top = cells.filter("row < 5")
    heads = settled(top, *top.columns, keys.canonical_day("text").alias("jour")).filter("jour <> ''")
    header = (
        heads.groupBy(*where, "row").count().filter("count >= 2").groupBy(*where).agg(F.min("row").alias("header"))
    )
    days = heads.join(header, where).filter("row = header").select(*where, "header", "col", "jour")
    timed = cells.filter(has_time(F.col("text")))
    schedule = timed.filter("col < 2").groupBy(*where, "row").agg(
        F.min_by(F.regexp_extract("text", TIME, 0), "col").alias("schedule")
    )
    across = (
        cells.filter("trim(text) <> ''").join(days, [*where, "col"]).filter("row > header")
        .join(schedule, [*where, "row"])
        .select(*where, F.col("row").alias("start"), "col", "jour", F.array("text", "schedule").alias("fragments"))
    )
    rest = cells.join(header, where, "left_anti")
    above = timed.groupBy(*where, "col").agg(
        F.min_by(F.struct("row", F.regexp_extract("text", TIME, 0).alias("time")), "row").alias("h")
    )
    down = _blocks(rest, _day_blocks(rest, False)).join(above, [*where, "col"], "left")
    add = (F.col("h.row") < F.col("start")) & ~F.exists("fragments", has_time)
    down = down.withColumn(
        "fragments", F.when(add, F.concat("fragments", F.array("h.time"))).otherwise(F.col("fragments"))
    ).select(*where, "start", "col", "jour", "fragments")
    return build_records(
        classify_fragments(across.unionByName(down), "fragments"), "doc", "page", "table", "start", "col"
    )


def _bands(labels: DataFrame, above: Column, below: Column) -> DataFrame:
    """Vertical band of each day label: up to the middle between neighbours."""
    line = Window.partitionBy("doc", "page").orderBy("y", "jour")
    before, after = F.lag("y").over(line), F.lead("y").over(line)
    return (
        labels.withColumn("_before", before)
        .withColumn("_after", after)
        .withColumn("_gap", F.min(F.col("_after") - F.col("y")).over(Window.partitionBy("doc", "page")))
        .select(
            "doc", "page", "jour", F.col("y").alias("day_y"),
            F.coalesce((F.col("_before") + F.col("y")) / 2, above).alias("top"),
            F.coalesce((F.col("y") + F.col("_after")) / 2, below).alias("bottom"),
        )
    )


def _day_labels(lines: DataFrame, limit: Column) -> DataFrame:
    left = lines.filter(F.col("x") < limit)
    return settled(left, *left.columns, keys.canonical_day("text").alias("jour")).filter("jour <> ''")


def _in_band(lines: DataFrame, bands: DataFrame) -> DataFrame:
    return lines.join(bands, ["doc", "page"]).filter((F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom")))


def _fragments(rows: DataFrame, *by: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("y", "seq", "text")))["text"]
    return rows.groupBy("doc", "page", "jour", "day_y", *by).agg(ordered.alias("fragments"))


def _lanes(lines: DataFrame, bands: DataFrame, lanes: Sequence[tuple[float, float]]) -> DataFrame:
    lane = F.coalesce(*[F.when((F.col("x") >= a) & (F.col("x") < b), F.lit(i)) for i, (a, b) in enumerate(lanes)])
    return _fragments(_in_band(lines, bands).withColumn("lane", lane).filter("lane is not null"), "lane")


def sessions_from_four_lanes(lines: DataFrame, lanes: Sequence[tuple[float, float]] = FOUR_LANES) -> DataFrame:
    """The four-lane template. Lines: (doc, page, seq, x, y, text)."""
    bands = _bands(_day_labels(lines, F.lit(100)), F.col("y") - 36, F.col("y") + 32)
    return build_records(
        classify_fragments(_lanes(lines, bands, lanes), "fragments"), "doc", "page", "day_y", "lane"
    )


def sessions_from_five_lanes(
    lines: DataFrame, page_height: float, lanes: Sequence[tuple[float, float]] = FIVE_LANES
) -> DataFrame:
    """The five-lane template: subject lines, then type and time, then teacher and room."""
    bands = _bands(
        _day_labels(lines, F.lit(92)), F.col("y") - 20, F.least(F.lit(page_height), F.col("y") + 23)
    )
    f = F.col("fragments")
    who = ["doc", "page", "jour", "day_y", "lane"]
    placed = settled(_lanes(lines, bands, lanes), *who, "fragments", _first_index(f, has_time).alias("_t"))
    rows = settled(placed.filter("_t > 0"), *who, "fragments", "_t", F.get(f, F.col("_t")).alias("_line"))
    subject = F.array_join(F.filter(F.slice(f, F.lit(1), F.col("_t")), lambda x: ~x.isin("—", "-")), " ")
    after = F.slice(f, F.col("_t") + 2, F.size(f))
    told = F.try_element_at(
        F.filter(after, lambda x: x.contains("Salle") & (x.rlike(TEACHER) | x.contains("·"))), F.lit(1)
    )
    found = settled(
        rows, *who, "_line",
        F.regexp_extract("_line", TIME, 0).alias("horaire"),
        subject.alias("matiere"),
        (keys.ascii_key(subject) == "EXAMEN").alias("_exam"),
        told.alias("_who"),
    ).filter("matiere <> '' and not _exam and _who is not null")
    parsed = settled(
        found, *who, "horaire", "matiere",
        F.trim(F.split_part(F.col("_line"), F.col("horaire"), F.lit(1)), F.lit(" ·")).alias("type_seance"),
        F.regexp_replace("_who", r"(?s)\s*·.*$", "").alias("enseignant"),
        F.regexp_extract("_who", r"(?s)·\s*(.*)$", 1).alias("salle"),
        F.lit("").alias("groupe"),
    )
    return build_records(parsed, "doc", "page", "day_y", "lane")


def sessions_from_anchors(lines: DataFrame, width: float) -> DataFrame:
    """Scanned pages: the text in a strip around each time, as wide as its neighbours allow."""
    labels = _day_labels(lines, F.lit(width * 0.23))
    spacing = F.coalesce(F.col("_gap"), F.lit(180.0))
    bands = _bands(labels, F.col("y") - 0.36 * spacing, F.col("y") + 0.48 * spacing)
    within = _in_band(lines, bands)
    times_at = within.filter(has_time(F.col("text"))).select(
        "doc", "page", "jour", "day_y", F.col("x").alias("ax"), F.col("seq").alias("anchor")
    )
    at = ["doc", "page", "jour", "day_y"]
    other = times_at.select(*at, F.col("ax").alias("ox")).distinct()
    gap = F.abs(F.col("ox") - F.col("ax"))
    near = times_at.join(other, at).groupBy(*at, "ax", "anchor").agg(
        F.min(F.when(gap > width * 0.08, gap)).alias("near")
    )
    half = F.coalesce(F.least(F.col("near") * 0.47, F.lit(width * 0.22)), F.lit(width * 0.18))
    strips = near.withColumn("half", half).join(within, at).filter(
        (F.abs(F.col("x") - F.col("ax")) < F.col("half")) & (F.col("x") > width * 0.23)
    )
    parsed = classify_fragments(_fragments(strips, "anchor"), "fragments")
    found = build_records(parsed, "doc", "page", F.col("anchor").alias("ord"))
    return merge_unique(found, ["doc", "page"], "ord")


def best_strategy(candidates: DataFrame) -> DataFrame:
    """Rows of each page's best reading, with the name of the way it was read.

    ``candidates`` carry strategy in template/grid/text/positioned and a table number: a
    template wins, then the grid with the most rows, then text, then positioned text.
    """
    order = F.create_map(*[F.lit(x) for kv in {"template": 3, "grid": 2, "text": 1, "positioned": 0}.items() for x in kv])
    candidates = cut_lineage(candidates)  # else every reading of a page is made twice
    size = candidates.groupBy("doc", "page", "strategy", "table").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy("doc", "page").agg(
        F.max_by(
            F.struct("strategy", "table"), F.struct(F.element_at(order, F.col("strategy")), "n", -F.col("table"))
        ).alias("b")
    ).select("doc", "page", "b.*")
    return candidates.join(best, ["doc", "page", "strategy", "table"])


NOTICES = {
    "grid": "grille reconnue automatiquement ; vérifiez les matières et enseignants.",
    "text": "lecture par blocs de texte ; vérifiez chaque séance.",
    "positioned": "OCR appliqué ; vérifiez tous les champs.",
}


def strategy_notices(chosen: DataFrame) -> DataFrame:
    words = F.create_map(*[F.lit(x) for kv in NOTICES.items() for x in kv])
    told = chosen.select("doc", "page", "strategy").distinct().withColumn("w", F.element_at(words, F.col("strategy")))
    return told.filter("w is not null").select(
        "doc", "page", F.format_string("%s - page %s: %s", "doc", F.col("page").cast("string"), "w").alias("notice")
    )


def merge_unique(sessions: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    """First session per day, subject, teacher, time and group."""
    spaced = F.replace(F.replace("horaire", F.lit(" "), F.lit("")), F.lit("–"), F.lit("-"))
    key = {
        "_jour": F.col("jour"), "_matiere": keys.ascii_key("matiere"),
        "_enseignant": keys.ascii_key("enseignant"), "_horaire": spaced, "_groupe": F.col("groupe"),
    }
    return keep_first(sessions.withColumns(key), [*within, *key], order).select(*sessions.columns)


def merge_unique_last(sessions: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    """One row per raw key: the last row's values at the first row's position."""
    key = [*within, "jour", "matiere", "enseignant", "horaire", "groupe"]
    rest = [c for c in sessions.columns if c not in key and c != order]
    return (
        sessions.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), order).alias("_r"), F.min(order).alias(order))
        .select(*key, *[F.col("_r")[c].alias(c) for c in rest], order)
        .select(*sessions.columns)
    )


def extraction_warnings(sessions: DataFrame) -> DataFrame:
    """Per source: sessions without a real teacher, and whether programme or semester lack."""
    unnamed = (F.col("enseignant") == UNNAMED) | (F.length(keys.ascii_key("enseignant")) < 5)
    lacking = (text("filiere") == "") | (text("niveau") == "")
    return sessions.groupBy("source_document").agg(
        F.count_if(unnamed).alias("sans_enseignant"), F.bool_or(lacking).alias("sans_programme")
    ).filter("sans_enseignant > 0 or sans_programme")


def document_summary(sessions: DataFrame, order: str = "ord") -> DataFrame:
    """Programme and semester of each source, as its first session has them."""
    return sessions.groupBy("source_document").agg(
        F.min_by("filiere", order).alias("filiere"), F.min_by("niveau", order).alias("niveau")
    )


def apply_document_overrides(sessions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every session of a listed source takes the programme and semester given for it."""
    given = overrides.select(
        "source_document", F.trim("filiere").alias("_f"), F.trim("niveau").alias("_n")
    )
    return (
        sessions.join(given, "source_document", "left")
        .withColumns({"filiere": F.coalesce("_f", "filiere"), "niveau": F.coalesce("_n", "niveau")})
        .select(*sessions.columns)
    )
