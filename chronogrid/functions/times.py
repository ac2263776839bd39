"""Time ranges and decimal durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import clean_ws, text

RANGE = r"(\d{1,2})(?:[h:.](\d{0,2}))?-(\d{1,2})(?:[h:.](\d{0,2}))?"
ALONE_RANGE = rf"(?<!\d){RANGE}(?!\d)"
MAX_SESSION_MINUTES = 360
NUMBER = r"^([+-]?)(?=\.?\d)(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?$"
PLAIN_NUMBER = r"^[+-]?\d+(?:\.\d*)?$"
MAX_ZEROS = 1000


def _compact(c: Column) -> Column:
    return F.translate(F.lower(c), "–—− ", "---")


def _minutes(c: Column, pattern: str, hour: int) -> Column:
    """Minute of the day from the hour group ``hour`` and the minute group after it."""
    part = lambda g: F.regexp_extract(c, pattern, g).try_cast("int")
    return part(hour) * 60 + F.coalesce(part(hour + 1), F.lit(0))


def time_range(c: Column | str) -> Column:
    """``struct<start_min,end_min>``, or null unless the end lies after the start."""
    compact = _compact(text(c))
    start, end = _minutes(compact, RANGE, 1), _minutes(compact, RANGE, 3)
    return F.when(end > start, F.struct(start.alias("start_min"), end.alias("end_min")))


def duration_hours(c: Column | str) -> Column:
    compact = _compact(clean_ws(c))
    span = _minutes(compact, ALONE_RANGE, 3) - _minutes(compact, ALONE_RANGE, 1)
    return F.when((span > 0) & (span <= MAX_SESSION_MINUTES), F.round(span / 60, 2))


def clock(minutes: Column) -> Column:
    return F.format_string(
        "%02dh%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    )


def canonical_decimal(c: Column | str) -> Column:
    """Finite decimal text without trailing zeros, so 2, 2.0 and "2.00" agree.

    The point is shifted as text, which keeps every digit. A number with more than
    ``MAX_ZEROS`` zeros to add is written as digits and an exponent, still one text for one
    value. Anything that is no number stays as it is.
    """
    raw = clean_ws(c)
    # Most numbers have no exponent: only zeros and signs at their ends go.
    lean = F.regexp_replace(F.regexp_replace(raw, r"^\+?(-?)0*(?=\d)", "$1"), r"\.0*$|(\.\d*[1-9])0+$", "$1")
    plain = F.when(lean == "-0", "0").otherwise(lean)
    parts = lambda g: F.regexp_extract(raw, NUMBER, g)
    shift = F.when(parts(4) == "", F.lit(0)).otherwise(parts(4).try_cast("int"))
    digits = F.regexp_replace(F.concat(parts(2), parts(3)), "^0+", "")
    short = F.regexp_replace(digits, "0+$", "")
    power = shift - F.length(parts(3)) + F.length(digits) - F.length(short)
    size = F.length(short)
    point = size + power  # digits before the point
    number = (
        F.when(F.abs(power) > MAX_ZEROS, F.concat(short, F.lit("e"), power.cast("string")))
        .when(power >= 0, F.concat(short, F.repeat(F.lit("0"), power)))
        .when(point > 0, F.concat(F.substring(short, F.lit(1), point), F.lit("."), F.substring(short, point + 1, size)))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), short))
    )
    sign = F.when(parts(1) == "-", "-").otherwise("")
    known = raw.rlike(NUMBER) & shift.isNotNull()
    return F.when(raw.rlike(PLAIN_NUMBER), plain).when(~known, raw).when(short == "", "0").otherwise(F.concat(sign, number))
