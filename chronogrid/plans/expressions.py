"""Queries over the scalar expressions (A), on whole texts and whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extras, folding, keys, similarity, times
from . import views
from .registry import query

SPACE = folding.SPACE_CLASS
_CLEAN = f"trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))"
_FOLD = "lower(strip_accents(text))"


def documents(spark, folder):
    return views.table(spark, folder, "documents").select("doc_id", "text")


def text_query(name, column, sql):
    """A whole-text expression, compared by digest."""

    @query(name, f"SELECT doc_id, md5({sql}) AS digest FROM documents")
    def run(spark, folder):
        return documents(spark, folder).select("doc_id", F.md5(column(F.col("text"))).alias("digest"))


text_query("a1_clean_ws", folding.clean_ws, _CLEAN)
text_query("a2_fold", folding.fold, "strip_accents(text)")
text_query("a3_ascii_key", keys.ascii_key, "trim(regexp_replace(regexp_replace(upper(strip_accents(replace(" + _CLEAN + ", 'ß', 'ss'))), '^(?:PROF|PR|DR)\\.?\\s*', ''), '[^A-Z0-9]+', ' ', 'g'))")
text_query("a5_norm_key", keys.norm_key, f"trim(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g'))")
_KEEP = "trim(regexp_replace(regexp_replace(translate({f}, '_-', '  '), '[^a-z0-9{k} ]+', ' ', 'g'), ' +', ' ', 'g'))"
text_query("a6_search_key", keys.search_key, _KEEP.format(f=f"lower(strip_accents({_CLEAN}))", k="@.+/"))
text_query("a7_person_key", keys.person_key, _KEEP.format(f=_FOLD, k="@.+"))
text_query("a7_list_filter_key", keys.list_filter_key, f"trim(regexp_replace({_FOLD}, '[^a-z0-9@+]+', ' ', 'g'))")
text_query("a8_contains_key", keys.contains_key, f"replace({_FOLD}, 'ß', 'ss')")
text_query("a8_question_key", keys.question_key, f"trim(regexp_replace({_FOLD}, '{SPACE}+', ' ', 'g'))")


def sessions_query(name, sql, columns):
    listed = ", ".join(f"{s} AS {n}" for n, s in sql.items())

    @query(name, f"SELECT session_id, {listed} FROM sessions", views.SQL_SESSIONS)
    def run(spark, folder):
        return views.sessions(spark, folder).select("session_id", *[c.alias(n) for n, c in columns().items()])


sessions_query(
    "a4_resource_key",
    {"k": "regexp_replace(upper(enseignant), '^PR\\. ', '')", "r": "upper(salle) || '—'"},
    lambda: dict(
        k=keys.resource_key("enseignant"),
        r=keys.resource_key(F.concat(F.lit("  "), "salle", F.lit("—"))),
    ),
)
sessions_query(
    "a9_time_range",
    {"start_min": "start_min", "end_min": "end_min", "backwards": "NULL"},
    lambda: dict(
        start_min=times.time_range("horaire")["start_min"],
        end_min=times.time_range("horaire")["end_min"],
        backwards=times.time_range(F.concat(F.lit("19h-"), F.substring("horaire", 1, 5)))["end_min"],
    ),
)
sessions_query(
    "a10_duration_hours",
    {"hours": "round(duree, 2)", "long": "CASE WHEN start_min - 420 <= 360 THEN round((start_min - 420) / 60.0, 2) END"},
    lambda: dict(
        hours=times.duration_hours("horaire"),
        long=times.duration_hours(F.concat(F.lit("7.00 — "), F.substring("horaire", 1, 5))),
    ),
)
sessions_query(
    "a11_canonical_day", {"d": "jour", "none": "''"},
    lambda: dict(
        d=keys.canonical_day(F.concat(F.lit(" "), F.upper("jour"), F.lit(" !"))),
        none=keys.canonical_day("matiere"),
    ),
)
sessions_query(
    "a12_day_order",
    {"a": f"list_position([{views._DAYS}], jour)", "b": f"least(list_position([{views._DAYS}], jour), 7)", "c": "8"},
    lambda: dict(
        a=keys.day_order("jour"),
        b=keys.day_order("jour", 7, 6),
        c=keys.day_order("matiere", 8),
    ),
)
sessions_query(
    "a13_infer_period", {"p": "period", "none": "''"}, lambda: dict(
        p=keys.infer_period("niveau"),
        none=keys.infer_period(F.lit("S9")),
    )
)
sessions_query(
    "a14_canonical_decimal",
    {"d": "CASE WHEN duree = floor(duree) THEN CAST(CAST(duree AS INTEGER) AS VARCHAR) ELSE CAST(duree AS VARCHAR) END", "z": "CAST(ord AS VARCHAR)", "t": "matiere"},
    lambda: dict(
        d=times.canonical_decimal(F.concat(F.col("duree").cast("string"), F.lit("00"))),
        z=times.canonical_decimal(F.concat(F.lit("0"), F.col("ord").cast("string"), F.lit(".000"))),
        t=times.canonical_decimal("matiere"),
    ),
)
sessions_query(
    "a15_token_set_key",
    {"k": "list_aggregate(list_sort(string_split(upper(matiere || ' ' || groupe || ' ' || filiere), ' ')), 'string_agg', ' ')"},
    lambda: dict(
        k=keys.token_set_key(F.concat_ws(" ", "filiere", "matiere", "groupe")),
    ),
)
sessions_query(
    "a16_normalize_status",
    {"s": "CASE ord % 4 WHEN 0 THEN 'Non précisé' WHEN 1 THEN 'Vacataire' WHEN 2 THEN 'Permanent' ELSE 'Doctorant' END"},
    lambda: dict(
        s=keys.normalize_status(F.element_at(F.array(*map(F.lit, (" ", "Enseignant VACATION", "Prof. titulaire", " Doctorant "))), (F.col("ord") % 4 + 1).cast("int"))),
    ),
)
_SPLIT = lambda: F.when(F.col("ord") % 3 == 0, F.concat("matiere", F.lit(", "), "groupe")).when(F.col("ord") % 3 == 1, F.concat("filiere", F.lit("  Jean"))).otherwise(F.col("matiere"))
sessions_query(
    "a17_split_full_name",
    {"nom": "CASE ord % 3 WHEN 1 THEN filiere ELSE matiere END", "prenom": "CASE ord % 3 WHEN 0 THEN groupe WHEN 1 THEN 'Jean' ELSE '' END"},
    lambda: dict(
        nom=keys.split_full_name(_SPLIT())["nom"],
        prenom=keys.split_full_name(_SPLIT())["prenom"],
    ),
)
_MAIL = lambda: F.when(F.col("ord") % 3 == 0, F.concat(F.lit("U"), "ord", F.lit("@X.org"))).otherwise("")
_TEL = lambda: F.when(F.col("ord") % 3 == 1, F.format_string("06 %08d", "ord")).otherwise(F.lit("123"))
sessions_query(
    "a18_identity_key",
    {"k": "CASE ord % 3 WHEN 0 THEN 'email:u' || ord || '@x.org' WHEN 1 THEN printf('tel:06%08d', ord) ELSE 'nom:' || lower(matiere) || ' jean' END"},
    lambda: dict(
        k=keys.identity_key(_MAIL(), _TEL(), "matiere", F.lit("Jean")),
    ),
)
sessions_query(
    "a19_initials_consonants",
    {"i": "'m' || substr(split_part(matiere, ' ', 2), 1, 1) || lower(substr(filiere, 1, 1))", "c": "regexp_replace(lower('mdl' || filiere), '[aeiouy]', '', 'g')"},
    lambda: dict(
        i=keys.initials(F.concat_ws(" ", "matiere", "filiere")),
        c=keys.consonant_key(F.concat_ws(" ", "matiere", "filiere")),
    ),
)
sessions_query(
    "a20_query_tokens",
    {"t": "split_part(matiere, ' ', 2) || ' ' || lower(filiere)", "only_stops": "'salle de prof'"},
    lambda: dict(
        t=F.array_join(keys.query_tokens(F.concat_ws(" ", "matiere", F.lit("de la Filière"), "filiere")), " "),
        only_stops=F.array_join(keys.query_tokens(F.lit("Salle de-prof")), " "),
    ),
)
sessions_query(
    "a23_header_base", {"h": "'E-mail ' || matiere"},
    lambda: dict(
        h=keys.header_base(F.concat(F.lit("E-mail [x] (y) REQUIRED "), "matiere", F.lit(" Read only"))),
    ),
)
sessions_query(
    "a24_slot_summary",
    {"s": "concat_ws(' | ', nullif(jour, ''), nullif(horaire, ''), nullif(salle, ''), nullif(enseignant, ''))"},
    lambda: dict(
        s=keys.slot_summary(F.struct("jour", "horaire", "salle", "enseignant")),
    ),
)
sessions_query(
    "a25_version_label",
    {"v": "CASE WHEN version_number = 1 THEN 'V1' ELSE 'V' || (version_number - 1) || ' → V' || version_number END", "c": "'🟢 Ajoutée'", "m": "CASE WHEN version_number = 1 THEN '✅' ELSE '' END"},
    lambda: dict(
        v=keys.version_label(F.nullif(F.col("version_number") - 1, F.lit(0)), F.col("version_number")),
        c=keys.change_label(F.lit("added")),
        m=keys.active_mark((F.col("version_number") == 1).cast("int")),
    ),
)
_OLD = lambda: F.format_string('{"Bureau": "%s", "Vide": ""}', "groupe")
_NEW = lambda: F.format_string('{"Bureau": "%s", "Vide": "x", "Blanc": ""}', F.when(F.col("ord") % 2 == 0, F.col("groupe")).otherwise(F.col("filiere")))
sessions_query(
    "a26_merge_extras",
    {"e": """'{"Bureau": ' || CASE WHEN ord % 2 = 0 THEN '"' || groupe || '"' ELSE '["' || groupe || '", "' || filiere || '"]' END || ', "Vide": "x"}'""", "raw": """'{"Ancienne valeur": "' || matiere || '"}'"""},
    lambda: dict(
        e=extras.extras_json(extras.merge_extras(extras.parse_extras(_OLD()), extras.parse_extras(_NEW()))),
        raw=extras.extras_json(extras.merge_extras(extras.parse_extras("matiere"), extras.parse_extras(F.lit("{}")))),
    ),
)
sessions_query(
    "a27_merge_sources", {"s": "groupe || ' ; ' || filiere || ' ; ' || matiere"},
    lambda: dict(
        s=extras.merge_sources(F.concat_ws(" ; ", "groupe", "filiere"), F.concat_ws(" ; ", "filiere", F.lit(" "), "matiere", "groupe")),
    ),
)
sessions_query(
    "a28_format_sources", {"s": "groupe || ', ' || filiere", "raw": "matiere"},
    lambda: dict(
        s=extras.format_sources(F.to_json(F.array("groupe", "filiere"))),
        raw=extras.format_sources("matiere"),
    ),
)


@query(
    "a21_entity_tokens",
    "SELECT doc_id, md5(concat_ws(' ', list_aggregate([t for t in regexp_extract_all("
    + _FOLD
    + ", '[a-z0-9]+') if length(t) >= 3 AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in keys.QUESTION_STOP_WORDS)
    + "], t)], 'string_agg', ' '))) AS digest FROM documents",
)
def a21(spark, folder):
    joined = F.array_join(keys.entity_tokens("text"), " ")
    return documents(spark, folder).select("doc_id", F.md5(joined).alias("digest"))


@query(
    "a22_find_day",
    f"SELECT conv_id, turn, (['LUNDI', 'MARDI', 'MERCREDI', 'JEUDI', 'VENDREDI', 'SAMEDI', 'DIMANCHE'])[conv_id % 7 + 1] AS day FROM conversations",
)
def a22(spark, folder):
    c = views.table(spark, folder, "conversations")
    day = F.element_at(F.array(*map(F.lit, views.keys.WEEK_DAYS)), (F.col("conv_id") % 7 + 1).cast("int"))
    return c.select("conv_id", "turn", keys.find_day(F.concat("text", F.lit(" le "), day, F.lit("?"))).alias("day"))


@query("a29_seq_ratio")
def a29(spark, folder):
    p = views.table(spark, folder, "part")
    names = p.select("p_name", "p_brand", "p_type").distinct()
    return names.select("p_name", "p_type", "p_brand", similarity.seq_ratio(F.lower("p_name"), F.lower("p_type")).alias("ratio"))
