"""Accent folding: compatibility decomposition with combining marks removed (A1, A2).

Spark has no Unicode normaliser, so the mapping is derived once from ``unicodedata``.
One-to-one changes and deletions run in a single ``translate``; characters that turn
into several (such as ligatures and fractions) go through a map lookup that only
strings containing one of them ever reach.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# All of Unicode but the surrogates and the Hangul syllables, which follow a rule.
COVERED = (range(0x80, 0xAC00), range(0xD7A4, 0xD800), range(0xE000, 0x110000))
SYLLABLES = (0xAC00, 0xD7A3)
LEADS, VOWELS, TAILS = (
    "".join(map(chr, range(first, first + n))) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27))
)

# Python's str.isspace set, which is wider than Java's or RE2's \s.
SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# A run that is not one plain space already: plain ones are most of a text and stay as they are.
UNEVEN_SPACE = " " + SPACE_CLASS + "+|" + SPACE_CLASS.replace(r"\x20", r"\x1f") + SPACE_CLASS + "*"

ASCII_RUN, NOT_ASCII = r"[\x00-\x7f]+", r"[^\x00-\x7f]"
# Anything but ASCII and the usual dashes and quotes, none of which folding changes.
MAY_FOLD = r"[^\x00-\x7f\x{2012}-\x{2015}\x{2018}-\x{201f}]"


def fold_text(text: str, form: str = "NFKD") -> str:
    """Plain-Python definition that the column form is tested against."""
    spread = unicodedata.normalize(form, text)
    if form == "NFD":
        return "".join(ch for ch in spread if unicodedata.category(ch) != "Mn")
    return "".join(ch for ch in spread if not unicodedata.combining(ch))


@lru_cache(maxsize=2)
def _tables(form: str) -> tuple[str, str, dict[str, str]]:
    single_from, single_to, deleted, multi = [], [], [], {}
    for block in COVERED:
        for code in block:
            ch = chr(code)
            out = fold_text(ch, form)
            if out == ch:
                continue
            if len(out) == 1:
                single_from.append(ch)
                single_to.append(out)
            elif not out:
                deleted.append(ch)
            else:
                multi[ch] = out
    return "".join(single_from) + "".join(deleted), "".join(single_to), multi


def _char_class(chars: list[str]) -> str:
    """A regex class of ``chars`` written as code-point ranges."""
    codes = sorted(map(ord, chars))
    runs: list[list[int]] = []
    for code in codes:
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def outside(kept: str) -> str:
    """A regex class of everything but the ASCII characters of ``kept``.

    Written as the ranges between them: Java tries a negated class some seven times as slowly.
    """
    return _char_class([chr(i) for i in range(0x80) if chr(i) not in kept])[:-1] + r"\x{80}-\x{10ffff}]"


def fold(c: Column, form: str = "NFKD") -> Column:
    """``NFKD`` also unfolds compatibility characters, ``NFD`` only drops accents.

    The wide classes are only tried on what is left without ASCII, and each table stands once
    in the expression: plans are written out as text for every stage that ends.
    """
    source, target, multi = _tables(form)
    lookup = F.from_json(F.lit(json.dumps(multi)), "map<string,string>")
    first, last = map(chr, SYLLABLES)
    unfolded = lambda ch: (
        F.when(ch < "\x80", ch).when(ch.between(first, last), _jamo(ch)).otherwise(F.coalesce(F.element_at(lookup, ch), ch))
    )
    several = _char_class([*multi])[:-1] + f"\\x{{{SYLLABLES[0]:x}}}-\\x{{{SYLLABLES[1]:x}}}]"

    def folded(x: Column) -> Column:
        odd = F.regexp_replace(x, ASCII_RUN, "")
        spelled = F.array_join(F.transform(F.split(x, ""), unfolded), "")
        return F.when(~odd.rlike(MAY_FOLD), x).otherwise(
            F.translate(F.when(odd.rlike(several), spelled).otherwise(x), source, target)
        )

    # A lambda's argument is worked out once, whatever ``c`` is made of.
    return F.get(F.transform(F.array(c), lambda x: F.when(~x.rlike(NOT_ASCII), x).otherwise(folded(x))), F.lit(0))


def _jamo(ch: Column) -> Column:
    """The two or three letters of a Hangul syllable."""
    place = F.ascii(ch) - SYLLABLES[0]
    letter = lambda letters, at: F.substring(F.lit(letters), at, F.lit(1))
    lead, vowel, tail = F.floor(place / 588), F.floor(place % 588 / 28), place % 28
    return F.concat(
        letter(LEADS, lead.cast("int") + 1),
        letter(VOWELS, vowel.cast("int") + 1),
        F.when(tail > 0, letter(TAILS, tail.cast("int"))).otherwise(""),
    )


def strip(c: Column) -> Column:
    """Both ends without white space of any kind."""
    return F.regexp_replace(c, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def text(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, UNEVEN_SPACE, " "))


def clean_ws(c: Column | str) -> Column:
    """Null to blank, runs of Unicode white space to one space, ends trimmed."""
    return squeeze(text(c))
