"""Comparison keys and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import clean_ws, fold, outside, squeeze, strip, text

# --- fixed values -----------------------------------------------------------------
WEEK_DAYS = ["Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche"]
TITLES = "PROF|PR|DR"
SEARCH_STOP_WORDS = [
    "de", "du", "des", "le", "la", "les", "un", "une", "salle", "prof", "professeur",
    "enseignant", "enseignante", "module", "matiere", "filiere", "semestre", "niveau",
    "version", "emploi", "edt",
]
QUESTION_STOP_WORDS = [
    "pr", "prof", "professeur", "professeurs", "enseignant", "enseignants", "le", "la",
    "les", "de", "du", "des", "a", "au", "aux", "en", "et", "quelle", "quel", "quelles",
    "quels", "heure", "horaire", "quand", "matiere", "module", "cours", "salle",
    "filiere", "planning", "seance",
]
STATUS_WORDS = {
    "Vacataire": ["vacataire", "vacation", "heure vacataire", "externe"],
    "Permanent": ["permanent", "titulaire", "fonctionnaire", "permanente"],
}
UNSTATED = "Non précisé"
CHANGE_LABELS = {
    "modified": "🟠 Modifiée",
    "added": "🟢 Ajoutée",
    "removed": "🔴 Supprimée",
}
ACTIVE_MARK = "✅"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# ----------------------------------------------------------------------------------


def drop_title(c: Column, strict: bool = False) -> Column:
    """Remove a leading academic title.

    By default the title needs no word boundary ("DRISSI" loses its DR), which is what
    existing keys were built with; ``strict`` asks for a real boundary.
    """
    tail = r"(?:\.\s*|\s+)" if strict else r"\.?\s*"
    return F.regexp_replace(c, rf"^(?:{TITLES}){tail}", "")


def ascii_key(c: Column | str, strict_titles: bool = False) -> Column:
    base = fold(F.upper(F.replace(clean_ws(c), F.lit("’"), F.lit("'"))))
    return F.trim(F.regexp_replace(drop_title(base, strict_titles), outside(UPPER + DIGITS) + "+", " "))


def resource_key(c: Column | str, strict_titles: bool = False) -> Column:
    base = fold(F.upper(strip(text(c))))
    return squeeze(drop_title(base, strict_titles))


def norm_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold(clean_ws(c))), outside(LOWER + DIGITS) + "+", " "))


def search_key(c: Column | str) -> Column:
    # White space of any kind, underscores and hyphens become spaces with all else that is not kept.
    base = F.regexp_replace(F.lower(fold(text(c))), outside(LOWER + DIGITS + "@.+/ ") + "+", " ")
    return F.trim(F.regexp_replace(base, "  +", " "))


def person_key(c: Column | str) -> Column:
    base = F.regexp_replace(F.lower(fold(text(c), "NFD")), outside(LOWER + DIGITS + "@.+ ") + "+", " ")
    return F.trim(F.regexp_replace(base, "  +", " "))


def list_filter_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(fold(F.lower(F.trim(text(c)))), outside(LOWER + DIGITS + "@+") + "+", " "))


def contains_key(c: Column | str) -> Column:
    return fold(F.replace(F.lower(text(c)), F.lit("ß"), F.lit("ss")))


def question_key(c: Column | str) -> Column:
    return F.lower(squeeze(fold(text(c), "NFD")))


def canonical_day(c: Column | str) -> Column:
    key = ascii_key(c)
    days = F.create_map(*[F.lit(x) for d in WEEK_DAYS for x in (d.upper(), d)])
    return F.coalesce(F.element_at(days, key), F.lit(""))


def day_order(c: Column | str, unknown: int = 99, week: int = 7) -> Column:
    """Position of the weekday; days past ``week`` and unknown text get ``unknown``."""
    col = F.col(c) if isinstance(c, str) else c
    order = F.create_map(*[F.lit(x) for i, d in enumerate(WEEK_DAYS[:week], 1) for x in (d, i)])
    return F.coalesce(F.element_at(order, col), F.lit(unknown))


def infer_period(level: Column | str) -> Column:
    digit = F.regexp_extract(clean_ws(level), "([1-6])", 1)
    return (
        F.when(digit == "", "")
        .when(digit.isin("1", "3", "5"), "Automne")
        .otherwise("Printemps")
    )


def token_set_key(c: Column | str) -> Column:
    return F.array_join(F.array_sort(F.split(ascii_key(c), " ")), " ")


def normalize_status(c: Column | str) -> Column:
    key = person_key(clean_ws(c))
    out = F.when(key == "", UNSTATED)
    for label, words in STATUS_WORDS.items():
        out = out.when(key.rlike("|".join(words)), label)
    return out.otherwise(clean_ws(c))


def split_full_name(c: Column | str) -> Column:
    raw = clean_ws(c)
    parts = F.split(raw, " ")
    first, second = F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))

    def shouted(word: Column) -> Column:
        # At least one cased letter and none in lower case.
        return (F.upper(word) == word) & (F.lower(word) != word)

    def pair(nom: Column, prenom: Column) -> Column:
        return F.struct(nom.alias("nom"), prenom.alias("prenom"))

    return (
        F.when(
            raw.contains(","),
            pair(
                F.trim(F.substring_index(raw, ",", 1)),
                F.trim(F.substring(raw, F.instr(raw, ",") + 1, F.length(raw))),
            ),
        )
        .when(
            (F.size(parts) == 2) & shouted(first) & ~shouted(second),
            pair(first, second),
        )
        .otherwise(pair(raw, F.lit("")))
    )


def phone_digits(c: Column | str) -> Column:
    """The digits of a phone number when there are enough of them to identify it."""
    digits = F.regexp_replace(text(c), r"[^0-9]+", "")
    return F.when(F.length(digits) >= 8, digits).otherwise("")


def full_name_key(nom: Column | str, prenom: Column | str) -> Column:
    return person_key(F.concat(text(nom), F.lit(" "), text(prenom)))


def identity_key(email, phone, nom, prenom) -> Column:
    mail, tel, name = person_key(email), phone_digits(phone), full_name_key(nom, prenom)
    return (
        F.when(mail != "", F.concat(F.lit("email:"), mail))
        .when(tel != "", F.concat(F.lit("tel:"), tel))
        .when(name != "", F.concat(F.lit("nom:"), name))
        .otherwise("")
    )


def initials(c: Column | str) -> Column:
    words = F.filter(F.split(list_filter_key(c), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def consonant_key(c: Column | str) -> Column:
    return F.regexp_replace(list_filter_key(c), "[^a-z]|[aeiouy]", "")


def query_tokens(q: Column | str) -> Column:
    whole = search_key(q)
    words = F.filter(F.split(whole, " "), lambda w: (w != "") & ~w.isin(SEARCH_STOP_WORDS))
    return F.when(F.size(words) > 0, words).otherwise(
        F.filter(F.array(whole), lambda w: w != "")
    )


def entity_tokens(c: Column | str) -> Column:
    words = F.regexp_extract_all(question_key(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(QUESTION_STOP_WORDS))


def find_day(question: Column | str) -> Column:
    """The weekday named as a whole word; Monday is looked for first, then Tuesday..."""
    key = question_key(question)
    out = None
    for day in WEEK_DAYS:
        hit = key.rlike(rf"\b{day.lower()}\b")
        out = F.when(hit, day.upper()) if out is None else out.when(hit, day.upper())
    return out


def header_base(c: Column | str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text(c), r"\[[^\]]*\]", " "), r"\([^)]*\)", " ")
    marks = r"(?i)\b(required|mandatory|obligatoire|read only|readonly)\b"
    return squeeze(F.regexp_replace(bare, marks, " "))


def join_nonblank(sep: str, *cols: Column) -> Column:
    return F.concat_ws(sep, *[F.when(clean_ws(c) != "", clean_ws(c)) for c in cols])


def slot_summary(row: Column) -> Column:
    """Day, time, room and teacher of a session struct, blanks left out."""
    return join_nonblank(" | ", row["jour"], row["horaire"], row["salle"], row["enseignant"])


def version_label(previous: Column, current: Column) -> Column:
    v = lambda c: F.concat(F.lit("V"), c.cast("string"))
    return (
        F.when(current.isNull(), "")
        .when(previous.isNull(), v(current))
        .otherwise(F.concat(v(previous), F.lit(" → "), v(current)))
    )


def change_label(c: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in CHANGE_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(labels, c), c)


def active_mark(c: Column) -> Column:
    return F.when(c == 1, ACTIVE_MARK).otherwise("")
