"""Delimited text files of any size as long cells (B1).

The lines of a file are read in ranges by Spark's own text source, so a large file is many tasks. A line that
may end inside a quoted value is a function from the state before it (outside or inside quotes) to the state
after it; such functions are composed along each range, the ranges' functions along the file, and so every line
learns the state it starts in without any task seeing more than a range. Lines that start inside quotes belong to
the record before them, which may have begun in an earlier range.

Delimiter and header row are those that recognise the most columns among the first rows of a file. A delimiter is
one of the fixed ones or the one that the first line suggests. Files in which no row names a known column, or
whose last quoted value is never closed, give no cells but a notice (``delimited_notices``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.folding import clean_ws
from ..operators import headers
from ..session import cut_lineage
from ..skew import blank, look_up
from .encodings import windows_latin, windows_undefined

DELIMITERS = [";", ",", "\t", "|"]
PREFERRED = [",", "\t", ";", " ", ":"]  # what a first line suggests, in this order
HEADER_ROWS = 30
HEAD_LINES = 10_000  # header rows begin among the first lines of a file
SAMPLE_CELLS = 12


@dataclass(frozen=True)
class Delimited:
    """Lines of all files, and for each file its delimiter, header row and what was seen of it."""

    lines: DataFrame
    files: DataFrame


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``doc, block, at, line``: raw lines, ordered by block and at within a file."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("doc"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )
    return decoded_lines(cut_lineage(raw))


def decoded_lines(raw: DataFrame) -> DataFrame:
    """Lines of a file that is valid UTF-8 as such, else of Windows Latin, else of Latin-1."""
    latin = F.decode(F.col("line").cast("binary"), "iso-8859-1")
    sound = F.is_valid_utf8("line")
    kinds = raw.groupBy("doc").agg(
        F.bool_and(sound).alias("utf8"), F.bool_or(windows_undefined(latin)).alias("odd")
    )
    first = Window.partitionBy("doc", "block").orderBy("at")
    text = F.when(F.col("utf8"), F.col("line")).when(F.col("odd"), latin).otherwise(windows_latin(latin))
    marked = (F.col("block") == 0) & (F.row_number().over(first) == 1)
    return look_up(raw, kinds, "doc").select(
        "doc", "block", "at", F.when(marked, F.regexp_replace(text, "^\\x{feff}", "")).otherwise(text).alias("line")
    )


# --- quotes -----------------------------------------------------------------------------------


def _escaped(delimiter: Column) -> Column:
    return F.concat(F.lit("\\"), delimiter)


def _field(d: Column) -> Column:
    return F.concat(F.lit(r'(?:"(?:[^"]++|"")*+"[^'), d, F.lit(r']*+|[^"'), d, F.lit("][^"), d, F.lit("]*+|)"))


def line_effect(line: Column, delimiter: Column) -> Column:
    """What a line does to the state: ``same``, ``turn``, ``out`` or ``in``.

    A quote opens a value at the start of a field only; a doubled one stands for itself.
    """
    d = _escaped(delimiter)
    rest = F.concat(F.lit("(?:"), d, _field(d), F.lit(r")*+\z"))
    stays_out = F.regexp(line, F.concat(F.lit("^"), _field(d), rest))
    gets_out = F.regexp(line, F.concat(F.lit(r'^(?:[^"]++|"")*+"[^'), d, F.lit("]*+"), rest))
    return (
        F.when(~F.contains(line, F.lit('"')), "same")
        .when(stays_out & gets_out, "out")
        .when(stays_out, "same")
        .when(gets_out, "turn")
        .otherwise("in")
    )


def _entered(rows: DataFrame, within: list[str], order: str, effect: str, name: str) -> DataFrame:
    """Adds the state before each row as ``name``: a number where it is known whatever came before ``within``,
    and ``name`` + ``_turned``, whether the state before ``within`` is turned where it is not known."""
    past = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.when(F.col(effect) == "turn", 1).otherwise(0)).over(past), F.lit(0))
    held = rows.withColumn("_turns", turns)
    fixed = F.when(F.col(effect).isin("out", "in"), F.struct((F.col(effect) == "in").cast("int").alias("s"), F.col("_turns").alias("t")))
    held = held.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(past))
    parity = F.pmod(F.col("_turns") - F.coalesce(F.col("_fixed.t"), F.lit(0)), F.lit(2)).cast("int")
    return held.withColumns(
        {name: F.col("_fixed.s").bitwiseXOR(parity), f"{name}_turned": F.when(F.col("_fixed").isNull(), parity).otherwise(0)}
    ).drop("_turns", "_fixed")


def _after(state: Column, effect: Column) -> Column:
    return F.when(effect == "out", 0).when(effect == "in", 1).when(effect == "turn", 1 - state).otherwise(state)


def with_states(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``before`` and ``after`` (0 outside, 1 inside quotes) to lines with their ``effect``.

    ``keys`` name a file; a range of it is a ``block``.
    """
    local = _entered(lines, [*keys, "block"], "at", "effect", "own")
    # The function of a whole range: its last line's state, or the turned state it was entered with.
    last = F.max_by(F.struct("own", "own_turned", "effect"), "at")
    ends = local.groupBy(*keys, "block").agg(last.alias("l"))
    known = _after(F.col("l.own"), F.col("l.effect"))
    turned = F.col("l.own_turned") != (F.col("l.effect") == "turn").cast("int")
    fixed = F.col("l.own").isNotNull() | F.col("l.effect").isin("out", "in")
    ranges = ends.select(
        *keys,
        "block",
        F.when(fixed, F.when(known == 1, "in").otherwise("out")).when(turned, "turn").otherwise("same").alias("effect"),
    )
    entered = _entered(ranges, keys, "block", "effect", "entry")  # one row per range
    entry = F.coalesce("entry", "entry_turned")  # a file starts outside
    joined = look_up(local, entered.select(*keys, "block", entry.alias("_entry")), [*keys, "block"])
    before = F.coalesce("own", F.col("_entry").bitwiseXOR(F.col("own_turned")))
    return (
        joined.withColumn("before", before)
        .withColumn("after", _after(F.col("before"), F.col("effect")))
        .drop("own", "own_turned", "_entry")
    )


def with_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``row``, the number of the record that each line belongs to; blank lines between records are left out."""
    begins = (F.col("before") == 0) & ~blank("line")
    upto = Window.partitionBy(*keys, "block").orderBy("at")
    own = lines.withColumn("_own", F.sum(begins.cast("int")).over(upto))
    ranges = own.groupBy(*keys, "block").agg(F.max("_own").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_ahead", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    row = (F.col("_own") + F.col("_ahead") - 1).cast("bigint")
    return look_up(own, ranges, [*keys, "block"]).withColumn("row", row).filter(begins | (F.col("before") == 1)).drop("_own", "_ahead")


def records_of(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, row, record``; only records of several lines are gathered."""
    alone = (F.col("before") == 0) & (F.col("after") == 0)
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    several = lines.filter(~alone).groupBy(*keys, "row").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("record"))
    return lines.filter(alone).select(*keys, "row", F.col("line").alias("record")).unionByName(several)


def cells_of(record: Column, delimiter: Column) -> Column:
    """Values of a record; quotes around a value are taken off, what follows them is kept."""
    d = _escaped(delimiter)
    pattern = F.concat(d, F.lit(r'((?:"(?:[^"]++|"")*+")?+[^'), d, F.lit("]*+)"))
    quoted = r'(?s)^"((?:[^"]++|"")*+)"(.*)$'
    value = lambda c: F.when(
        c.startswith('"'), F.concat(F.replace(F.regexp_extract(c, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, quoted, 2))
    ).otherwise(c)
    return F.transform(F.regexp_extract_all(F.concat(delimiter, record), pattern, F.lit(1)), value)


# --- delimiters and header rows ---------------------------------------------------------------


def suggested(line: Column) -> Column:
    """The delimiter that a line suggests: the first preferred one outside quotes, else its most frequent mark."""
    bare = F.regexp_replace(line, r'"(?:[^"]++|"")*+"', "")
    marks = F.regexp_extract_all(bare, F.lit(r"[^\p{L}\p{N}\s\"'.]"), F.lit(0))
    often = F.array_max(F.transform(F.array_distinct(marks), lambda m: F.struct(F.size(F.filter(marks, lambda x: x == m)).alias("n"), m.alias("m"))))["m"]
    picks = [F.when(F.contains(bare, F.lit(p)), F.lit(p)) for p in PREFERRED]
    return F.coalesce(*picks, F.when(F.ascii(often) < 128, often), F.lit(";"))


def _candidates(lines: DataFrame) -> DataFrame:
    """``doc, turn, delimiter, row, record`` of the first rows under each delimiter."""
    first = Window.partitionBy("doc").orderBy("at")
    head = lines.filter("block = 0").withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= HEAD_LINES)
    opening = head.filter(~blank("line")).groupBy("doc").agg(F.min_by("line", "at").alias("_opening"))
    tried = F.array(suggested(F.col("_opening")), *map(F.lit, DELIMITERS))
    head = look_up(head, opening, "doc").select("doc", "block", "at", "line", F.posexplode(tried).alias("turn", "delimiter"))
    keys = ["doc", "turn", "delimiter"]
    stated = with_rows(with_states(head.withColumn("effect", line_effect(F.col("line"), F.col("delimiter"))), keys), keys)
    return records_of(stated.filter(F.col("row") < HEADER_ROWS), keys)


def open_delimited(spark: SparkSession, path: str, learned: DataFrame) -> Delimited:
    """Finds the delimiter and header row of each file under ``path``."""
    lines = cut_lineage(read_lines(spark, path))
    tried = cut_lineage(_candidates(lines))
    cells = tried.select("doc", "turn", "delimiter", "row", F.explode(cells_of(F.col("record"), F.col("delimiter"))).alias("header"))
    cells = cells.withColumn("header", clean_ws("header"))
    mapping = headers.canonical_headers(cells.select("header"), learned)
    known = mapping.filter("canonical is not null").select("header", F.lit(1).alias("hit"))
    scores = cells.join(known, "header", "left").groupBy("doc", "turn", "delimiter", "row").agg(
        F.coalesce(F.sum("hit"), F.lit(0)).alias("score")
    )
    best = scores.groupBy("doc").agg(
        F.max_by(F.struct("row", "delimiter", "score"), F.struct("score", -F.col("turn"), -F.col("row"))).alias("b")
    )
    sample = tried.filter("turn = 0 and row = 0").select(
        "doc", F.slice(F.transform(cells_of(F.col("record"), F.col("delimiter")), clean_ws), 1, SAMPLE_CELLS).alias("sample")
    )
    every = lines.select("doc").distinct().join(best, "doc", "left").join(sample, "doc", "left")
    files = every.select("doc", F.col("b.row").alias("header_row"), "b.delimiter", F.coalesce("b.score", F.lit(0)).alias("score"), "sample")
    chosen = files.filter("score > 0").select("doc", "delimiter", "header_row")
    stated = look_up(lines, chosen, "doc").withColumn("effect", line_effect(F.col("line"), F.col("delimiter")))
    stated = cut_lineage(with_states(stated, ["doc"]))
    # A file that ends inside quotes has no last record: nothing of it is gathered.
    ends = stated.groupBy("doc").agg(F.max_by("after", F.struct("block", "at")).alias("_end"))
    files = cut_lineage(files.join(ends, "doc", "left").withColumn("closed", F.coalesce(F.col("_end") == 0, F.lit(True))).drop("_end"))
    return Delimited(look_up(stated, files.filter("closed").select("doc"), "doc"), files)


def delimited_cells(found: Delimited) -> DataFrame:
    """``doc, row, col, header, value`` of all rows under the header rows.

    The names are looked up: columns that repeat are small in a file, so that Spark may take the cells for the lesser side.
    """
    keys = ["doc", "delimiter", "header_row"]
    rows = records_of(with_rows(found.lines, keys).filter("row >= header_row"), keys)
    cells = cut_lineage(rows.select("doc", "row", "header_row", F.posexplode(cells_of(F.col("record"), F.col("delimiter"))).alias("col", "value")))
    name = clean_ws("value")
    named = cells.filter("row = header_row").select(
        "doc", "col", F.when(name == "", F.concat(F.lit("Colonne_"), F.col("col") + 1)).otherwise(name).alias("header")
    )
    return look_up(cells.filter("row > header_row"), named, ["doc", "col"]).select("doc", "row", "col", "header", "value")


def delimited_notices(found: Delimited) -> DataFrame:
    """``doc, kind, detail`` of files that gave no cells, or whose header is not the first row."""
    seen = F.concat(F.lit("["), F.array_join("sample", ", "), F.lit("]"))
    kind = (
        F.when(~F.col("closed"), "unclosed quote")
        .when(F.col("sample").isNull(), "no rows")
        .when(F.col("score") == 0, "no known column")
        .when(F.col("header_row") > 0, "header below first row")
    )
    detail = F.when(kind == "header below first row", (F.col("header_row") + 1).cast("string")).otherwise(F.coalesce(seen, F.lit("")))
    return found.files.select("doc", kind.alias("kind"), detail.alias("detail")).filter("kind is not null")
