"""Queries over staff records, people search, questions and reconciliation (G6-G7, H, I, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.extras import extras_json
from ..operators import headers, linking, people, reconcile, search
from ..skew import settled
from . import views
from .registry import query

SEGMENTS = {"BUILDING": "Vacataire 2024", "MACHINERY": "titulaire", "HOUSEHOLD": "", "FURNITURE": "Doctorant"}


def staff(spark, folder):
    """Staff records from customers: repeated mails, phones and names by modulus."""
    c = views.table(spark, folder, "customer").join(
        F.broadcast(views.table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey")
    )
    i = F.col("c_custkey")
    t = lambda fmt, n: F.format_string(fmt, n)
    return c.select(
        (i + 1).alias("rid"),
        F.when(i % 4 == 0, "Non précisé").otherwise("Permanent").alias("statut"),
        F.when(i % 5 == 0, "").otherwise(t("NOM%d", i % 900)).alias("nom"),
        F.when(i % 5 == 0, "").otherwise(t("Prénom%d", i % 7)).alias("prenom"),
        F.when(i % 3 == 0, t("p%d@example.org", i % 600)).otherwise("").alias("email"),
        F.when(i % 4 == 1, t("06-%08d", i % 1000)).otherwise("").alias("telephone"),
        F.when(i % 6 == 0, "Doctorat").otherwise("").alias("diplome"),
        F.lit("").alias("specialite"),
        F.col("n_name").alias("departement"),
        F.create_map(F.lit("Bureau"), F.array(t("B%d", i % 11))).alias("extras"),
        t("fichier%d.csv", i % 20).alias("source_document"),
        F.lit("Feuil1").alias("feuille"),
    )


_STAFF = """
staff AS (
  SELECT c_custkey AS i, c_custkey + 1 AS rid, CASE WHEN c_custkey % 4 = 0 THEN 'Non précisé' ELSE 'Permanent' END AS statut,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE printf('NOM%d', c_custkey % 900) END AS nom,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE printf('Prénom%d', c_custkey % 7) END AS prenom,
    CASE WHEN c_custkey % 3 = 0 THEN printf('p%d@example.org', c_custkey % 600) ELSE '' END AS email,
    CASE WHEN c_custkey % 4 = 1 THEN printf('06-%08d', c_custkey % 1000) ELSE '' END AS telephone,
    CASE WHEN c_custkey % 6 = 0 THEN 'Doctorat' ELSE '' END AS diplome, '' AS specialite, n_name AS departement,
    printf('B%d', c_custkey % 11) AS bureau, printf('fichier%d.csv', c_custkey % 20) AS source_document, 'Feuil1' AS feuille
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
"""
_FIELDS = list(people.FIELDS)
_LONG = " UNION ALL ".join(
    f"SELECT rid, source_document, '{n}' AS field, {c} AS value FROM staff WHERE {c} NOT IN ('', 'Non précisé')"
    for c, n in people.FIELDS.items()
)


def named_people(spark, folder):
    """People named by the longest and the last word of each whole document."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    d = views.table(spark, folder, "documents")
    d = settled(d, "doc_id", "lang", "source", words.alias("words"))
    named = settled(d, "doc_id", "lang", "source", longest.alias("longest"), F.array_max("words").alias("last"))
    return named.select(
        F.col("doc_id").alias("person_id"),
        F.upper(F.coalesce("longest", F.lit(""))).alias("nom"),
        F.initcap(F.coalesce("last", F.lit(""))).alias("prenom"),
        F.concat(F.lit("d"), F.col("doc_id"), F.lit("@example.org")).alias("email"),
        F.format_string("07%08d", "doc_id").alias("telephone"),
        F.col("lang").alias("statut"),
        F.col("source").alias("departement"),
    )


@query("g6_rank_people")
def g6(spark, folder):
    return search.rank_people(named_people(spark, folder), "tionment")


@query(
    "g7_filter_people",
    "SELECT rid, nom, departement FROM staff WHERE statut = 'Permanent' AND contains(lower(nom || '|' || prenom || '|' || email || '|' || telephone || '|' || departement || '|' || source_document), 'm1')",
    _STAFF,
)
def g7(spark, folder):
    s = staff(spark, folder).drop("extras", "feuille", "diplome", "specialite").withColumn("source_document", F.col("source_document"))
    return search.filter_people(s, status="Permanent", search=" M1 ").select("rid", "nom", "departement")


@query("h7_resolve_entities")
def h7(spark, folder):
    return people.resolve_entities(staff(spark, folder))


def by_mail(spark, folder):
    """All records, named after their mail, or each by itself without one: people that SQL can group."""
    s = staff(spark, folder)
    i = F.col("rid") - 1
    number = F.when(F.col("email") == "", i + 1_000_000).otherwise(i % 600)
    return s.withColumns(
        {
            "nom": F.concat(F.lit("NOM"), number), "prenom": F.concat(F.lit("Prénom"), number % 7),
            "telephone": F.format_string("07%08d", number),
        }
    )


_MAIL = """
named AS (
  SELECT * REPLACE ('NOM' || m AS nom, 'Prénom' || (m % 7) AS prenom, printf('07%08d', m) AS telephone)
  FROM (SELECT *, CASE WHEN email = '' THEN i + 1000000 ELSE i % 600 END AS m FROM staff)),
label0 AS (SELECT *, CASE WHEN email = '' THEN rid ELSE min(rid) OVER (PARTITION BY email) END AS label FROM named),
"""


@query("h7_resolve_by_mail", "SELECT rid, label FROM label0", _STAFF + _MAIL)
def h7_mail(spark, folder):
    return people.resolve_entities(by_mail(spark, folder))


@query(
    "h8_merge_records",
    """SELECT label, count(*) AS n, coalesce(arg_min(statut, rid) FILTER (WHERE statut <> 'Non précisé'), arg_min(statut, rid)) AS statut,
      arg_min(nom, rid) AS nom, arg_min(prenom, rid) AS prenom, arg_min(telephone, rid) AS telephone,
      arg_min(email, rid) AS email, coalesce(arg_min(diplome, rid) FILTER (WHERE diplome <> ''), '') AS diplome, arg_min(departement, rid) AS departement,
      (SELECT CASE WHEN count(*) = 1 THEN '{"Bureau": "' || max(bureau) || '"}' ELSE '{"Bureau": [' || string_agg('"' || bureau || '"', ', ' ORDER BY r) || ']}' END
        FROM (SELECT bureau, min(rid) AS r FROM label0 b WHERE b.label = a.label GROUP BY 1)) AS extras,
      (SELECT string_agg(source_document, ' ; ' ORDER BY r) FROM (SELECT source_document, min(rid) AS r FROM label0 b WHERE b.label = a.label GROUP BY 1)) AS source_document
    FROM label0 a GROUP BY label""",
    _STAFF + _MAIL,
)
def h8(spark, folder):
    s = by_mail(spark, folder)
    return people.merge_records(s, people.resolve_entities(s)).select(
        "label", "n", "statut", "nom", "prenom", "telephone", "email", "diplome", "departement", extras_json(F.col("extras")).alias("extras"), "source_document"
    )


def stored_and_batch(spark, folder):
    """One stored person per distinct mail; the staff records arrive as a batch."""
    s = by_mail(spark, folder)
    store = (
        s.filter("email <> ''").groupBy("email").agg(F.min("rid").alias("rid"))
        .join(s.drop("email"), "rid").select(*s.columns)
        .withColumn("departement", F.when(F.col("rid") % 2 == 0, "Ancien").otherwise(""))
    )
    return store, s.withColumn("rid", F.col("rid") + 1_000_000_000)


_STORE = """
store AS (SELECT email, min(rid) AS pid FROM staff WHERE email <> '' GROUP BY 1),
arrive AS (SELECT s.*, s.rid + 1000000000 AS brid, t.pid FROM staff s LEFT JOIN store t ON t.email = s.email),
cur AS (SELECT pid, CASE WHEN pid % 2 = 0 THEN 'Ancien' ELSE arg_min(departement, rid) END AS dep FROM arrive WHERE pid IS NOT NULL GROUP BY pid),
clash AS (
  SELECT a.pid AS person_id, 'Département' AS field, c.dep AS current, a.departement AS incoming, min(a.brid) AS rid
  FROM arrive a JOIN cur c USING (pid) WHERE lower(replace(c.dep, '_', ' ')) <> lower(replace(a.departement, '_', ' ')) GROUP BY ALL),
"""


@query(
    "h9_upsert_outcome",
    "SELECT brid AS rid, CASE WHEN pid IS NULL THEN 'inserted' ELSE 'updated' END AS outcome, coalesce(pid, brid) AS person_id FROM arrive",
    _STAFF + _STORE,
)
def h9(spark, folder):
    return people.upsert_people(*stored_and_batch(spark, folder))[0]


@query(
    "h9_upsert_people",
    "SELECT pid AS person_id, dep AS departement FROM cur UNION ALL SELECT brid, departement FROM arrive WHERE pid IS NULL",
    _STAFF + _STORE,
)
def h9_people(spark, folder):
    return people.upsert_people(*stored_and_batch(spark, folder))[1].select("person_id", "departement")


@query("h10_field_conflicts", "SELECT person_id, field, current, incoming, rid FROM clash", _STAFF + _STORE)
def h10(spark, folder):
    found = people.upsert_people(*stored_and_batch(spark, folder))[2]
    return found.select("person_id", "field", "current", "incoming", "rid")


def known_conflicts(spark, folder):
    """Clashes between all fields of records that share a mail, without running a resolution."""
    s = by_mail(spark, folder)
    label = F.when(F.col("email") == "", F.col("rid")).otherwise(F.min("rid").over(views.Window.partitionBy("email")))
    return people.detect_field_conflicts(s, s.select("rid", label.alias("label")))


_CLASH = """
grp AS (SELECT *, min(rid) OVER (PARTITION BY email) AS pid, first_value(departement) OVER (PARTITION BY email ORDER BY rid) AS cur FROM staff WHERE email <> ''),
found AS (SELECT pid AS person_id, 'Département' AS field, cur AS current, departement AS incoming, min(rid) AS rid FROM grp WHERE cur <> departement GROUP BY ALL),
ruled AS (SELECT *, CASE person_id % 4 WHEN 0 THEN 'actuelle' WHEN 1 THEN 'nouvelle' WHEN 2 THEN 'les_deux' END AS decision FROM found),
"""


def rules_for(found):
    """Remembered decisions for three quarters of the people, values swapped."""
    turn = F.col("person_id") % 4
    decision = F.when(turn == 0, "actuelle").when(turn == 1, "nouvelle").when(turn == 2, "les_deux")
    return found.filter(turn < 3).select(
        "person_id", "field", *people._pair("incoming", "current"),
        F.when(turn == 1, F.col("incoming")).otherwise(F.col("current")).alias("preferred"),
        decision.alias("decision"), F.lit(0).cast("bigint").alias("usage_count"),
    )


@query("h10_new_conflicts", "SELECT person_id, incoming FROM found WHERE person_id % 3 <> 0", _STAFF + _CLASH)
def h10_new(spark, folder):
    found = known_conflicts(spark, folder)
    stored = found.filter("person_id % 3 = 0").select("person_id", "field", "incoming", F.lit("open").alias("status"))
    return people.new_conflicts(found, stored).select("person_id", "incoming")


@query(
    "h11_apply_conflict_rules",
    """SELECT person_id, current, incoming, CASE WHEN decision IS NULL THEN 'open' ELSE 'auto_resolved' END AS status,
      CASE decision WHEN 'nouvelle' THEN incoming WHEN 'actuelle' THEN current WHEN 'les_deux' THEN current END AS kept,
      CASE WHEN decision = 'les_deux' THEN incoming END AS alternative FROM ruled""",
    _STAFF + _CLASH,
)
def h11(spark, folder):
    found = known_conflicts(spark, folder)
    return people.apply_conflict_rules(found, rules_for(found)).select(
        "person_id", "current", "incoming", "status", "kept", "alternative"
    )


@query(
    "h11_rules_after_use",
    "SELECT person_id, current, incoming, 1 AS usage_count FROM ruled WHERE decision IS NOT NULL",
    _STAFF + _CLASH,
)
def h11_usage(spark, folder):
    found = known_conflicts(spark, folder)
    rules = rules_for(found)
    used = people.rules_after_use(rules, people.apply_conflict_rules(found, rules))
    names = found.select("person_id", "field", "current", "incoming", *people._pair("current", "incoming"))
    return used.join(names, ["person_id", "field", "low", "high"]).select("person_id", "current", "incoming", "usage_count")


def numbered_conflicts(spark, folder):
    found = known_conflicts(spark, folder)
    return found.withColumn("conflict_id", F.col("rid")).withColumn("status", F.lit("open")).withColumn(
        "resolution", F.lit(None).cast("string")
    )


def folk(spark, folder):
    return staff(spark, folder).withColumnRenamed("rid", "person_id")


def decided(spark, folder):
    conflicts = numbered_conflicts(spark, folder)
    turn = F.col("conflict_id") % 4
    choice = conflicts.filter(turn < 3).select(
        "conflict_id", F.when(turn == 0, "actuelle").when(turn == 1, "nouvelle").otherwise("les_deux").alias("decision")
    )
    empty = rules_for(conflicts).limit(0)
    return people.resolve_conflicts(conflicts, choice, folk(spark, folder), empty)


_DECIDED = "decided AS (SELECT *, CASE rid % 4 WHEN 0 THEN 'actuelle' WHEN 1 THEN 'nouvelle' WHEN 2 THEN 'les_deux' END AS decision FROM found),"


@query(
    "h12_resolve_conflicts",
    "SELECT rid AS conflict_id, person_id, CASE WHEN decision IS NULL THEN 'open' ELSE 'resolved' END AS status FROM decided",
    _STAFF + _CLASH + _DECIDED,
)
def h12(spark, folder):
    return decided(spark, folder)[0].select("conflict_id", "person_id", "status")


@query(
    "h12_people_after",
    """SELECT s.rid AS person_id, coalesce((SELECT arg_max(incoming, rid) FROM decided d WHERE d.person_id = s.rid AND decision = 'nouvelle'), departement) AS departement,
      coalesce((SELECT string_agg(DISTINCT incoming, ',' ORDER BY incoming) FROM decided d WHERE d.person_id = s.rid AND decision = 'les_deux'), '') AS alternatives FROM staff s""",
    _STAFF + _CLASH + _DECIDED,
)
def h12_people(spark, folder):
    alt = F.try_element_at("extras", F.lit("Alternative Département"))
    return decided(spark, folder)[1].select(
        "person_id", "departement", F.coalesce(F.array_join(alt, ","), F.lit("")).alias("alternatives")
    )


@query(
    "h13_list_conflicts",
    "SELECT f.rid AS conflict_id, person_id, trim(s.nom || ' ' || s.prenom) AS enseignant FROM found f JOIN staff s ON s.rid = f.person_id",
    _STAFF + _CLASH,
)
def h13(spark, folder):
    return people.list_conflicts(numbered_conflicts(spark, folder), folk(spark, folder)).select(
        "conflict_id", "person_id", "enseignant"
    )


@query(
    "h13_list_rules",
    """SELECT person_id, CASE decision WHEN 'actuelle' THEN 'Conserver la valeur préférée' WHEN 'nouvelle' THEN 'Adopter la valeur préférée'
      ELSE 'Valeur préférée + archiver alternative' END AS libelle FROM ruled WHERE decision IS NOT NULL AND person_id % 5 <> 0""",
    _STAFF + _CLASH,
)
def h13_rules(spark, folder):
    rules = rules_for(known_conflicts(spark, folder))
    gone = rules.filter("person_id % 5 = 0").select("person_id", "field", "low", "high")
    return people.list_rules(people.delete_rules(rules, gone), folk(spark, folder)).select("person_id", "libelle")


@query(
    "h14_field_history",
    f"SELECT h.rid, p.pid AS person_id, field, value FROM ({_LONG}) h JOIN (SELECT rid, CASE WHEN email = '' THEN rid ELSE min(rid) OVER (PARTITION BY email) END AS pid FROM staff) p USING (rid)",
    _STAFF,
)
def h14(spark, folder):
    s = staff(spark, folder)
    person = F.when(F.col("email") == "", F.col("rid")).otherwise(F.min("rid").over(views.Window.partitionBy("email")))
    owned = s.select("rid", person.alias("person_id"))
    return people.field_history(s, owned).select("rid", "person_id", "field", "value")


@query(
    "h15_fragments",
    "SELECT rid, source_document, 'Aucun identifiant enseignant' AS raison FROM staff WHERE email = '' AND telephone = '' AND nom = ''",
    _STAFF,
)
def h15(spark, folder):
    return people.fragments(staff(spark, folder)).select("rid", "source_document", "raison")


@query("h15_import_log", "SELECT source_document, count(*) AS nb_lignes FROM staff GROUP BY 1", _STAFF)
def h15_log(spark, folder):
    return people.import_log(staff(spark, folder))


@query("h4_record_predicates", "SELECT rid, NOT (nom = '' AND email = '' AND telephone = '') AS identity, true AS content FROM staff", _STAFF)
def h4(spark, folder):
    return staff(spark, folder).select(
        "rid", people.has_identity().alias("identity"), people.has_any_content().alias("content")
    )


@query("h16_similar_names")
def h16_names(spark, folder):
    return people.similar_names(named_people(spark, folder)).select("a", "b", F.round("ratio", 3).alias("similarite"))


@query("h16_possible_duplicates")
def h16(spark, folder):
    return people.possible_duplicates(named_people(spark, folder))


@query(
    "h17_delete_people",
    "SELECT 'people' AS t, rid AS person_id FROM staff WHERE rid % 3 <> 0 UNION ALL SELECT 'conflicts', person_id FROM found WHERE person_id % 3 <> 0",
    _STAFF + _CLASH,
)
def h17(spark, folder):
    p = folk(spark, folder)
    left = people.delete_people(
        p.filter("person_id % 3 = 0"), people=p, conflicts=known_conflicts(spark, folder)
    )
    tag = lambda n: left[n].select(F.lit(n).alias("t"), "person_id")
    return tag("people").unionByName(tag("conflicts"))


@query(
    "h18_people_listing",
    "SELECT rid AS person_id, nom, prenom, row_number() OVER (ORDER BY nom, prenom, rid) > 0 AS listed FROM staff",
    _STAFF,
)
def h18(spark, folder):
    return people.people_listing(folk(spark, folder)).select("person_id", "nom", "prenom", F.lit(True).alias("listed"))


_MAIN = " UNION ALL ".join(
    f"SELECT rid AS person_id, 'principale' AS section, '{n}' AS information, CASE WHEN {c} = '' THEN 'Non précisé' ELSE {c} END AS valeur FROM staff"
    for c, n in people.FIELDS.items()
)


@query(
    "h18_person_profile",
    _MAIN
    + """ UNION ALL SELECT rid, 'secondaire', 'Bureau', bureau FROM staff
    UNION ALL SELECT rid, 'secondaire', 'Source document', source_document FROM staff
    UNION ALL SELECT rid, 'secondaire', 'Feuille/Section', feuille FROM staff""",
    _STAFF,
)
def h18_profile(spark, folder):
    return people.person_profile(folk(spark, folder))


# --- staff files: cells under raw headers -----------------------------------------
RAW_HEADERS = {
    "nom": "NOM de famille [Required]", "prenom": "Prenom", "email": "E-mail", "telephone": "Telephonne",
    "departement": "Département (obligatoire)", "statut": "Statut", "bureau": "N° de bureau",
}


def staff_cells(spark, folder):
    """The staff records as cells of one file per source, header texts as in the wild."""
    s = staff(spark, folder).withColumn("bureau", F.element_at("extras", "Bureau")[0])
    cells = F.array(
        *[
            F.struct(F.lit(j).alias("col"), F.lit(h).alias("header"), F.col(c).alias("value"))
            for j, (c, h) in enumerate(RAW_HEADERS.items())
        ]
    )
    return s.select(F.col("source_document").alias("doc"), F.col("rid").alias("row"), F.explode(cells).alias("x")).select("doc", "row", "x.*")


def taught(spark):
    return spark.createDataFrame([("inconnu", "Ignorer")], "normalized_header string, canonical string")


@query(
    "h2_canonical_headers",
    """SELECT * FROM (VALUES ('NOM de famille [Required]', 'Nom'), ('Prenom', 'Prénom'), ('E-mail', 'Email'), ('Telephonne', 'Téléphone'),
      ('Département (obligatoire)', 'Département'), ('Statut', 'Statut'), ('N° de bureau', NULL)) v(header, canonical)""",
)
def h2(spark, folder):
    return headers.canonical_headers(staff_cells(spark, folder), taught(spark))


@query(
    "h3_map_rows",
    """SELECT source_document AS doc, rid AS row, CASE WHEN statut = 'Non précisé' THEN 'Non précisé' ELSE 'Permanent' END AS statut, nom, prenom, email, telephone, departement,
      '{"N° de bureau": "' || bureau || '"}' AS extras FROM staff""",
    _STAFF,
)
def h3(spark, folder):
    cells = staff_cells(spark, folder)
    return headers.map_rows(cells, headers.canonical_headers(cells, taught(spark))).select(
        "doc", "row", "statut", "nom", "prenom", "email", "telephone", "departement", extras_json(F.col("extras")).alias("extras")
    )


@query(
    "h1_pick_header",
    "SELECT source_document AS doc, 2 AS header_row, 6 AS score FROM staff GROUP BY 1",
    _STAFF,
)
def h1(spark, folder):
    # Two title rows above the header row of each file, data rows below.
    cells = staff_cells(spark, folder)
    top = cells.select("doc", "col", "header").distinct()
    lines = (
        top.select("doc", F.lit(2).cast("bigint").alias("row"), "col", F.col("header").alias("text"))
        .unionByName(top.select("doc", (F.col("col") % 2).cast("bigint").alias("row"), "col", F.lit("Statut").alias("text")))
        .unionByName(cells.select("doc", (F.col("row") + 2).alias("row"), "col", F.col("value").alias("text")))
    )
    mapping = headers.canonical_headers(lines.select(F.col("text").alias("header")), taught(spark))
    return headers.pick_header(headers.score_header_rows(lines, mapping))


@query(
    "h5_unknown_headers",
    """SELECT 'n de bureau' AS normalized_header, 'N° de bureau' AS source_header, 5 AS first_seen, max(rid) AS last_seen, count(*) + 10 AS seen_count FROM staff""",
    _STAFF,
)
def h5(spark, folder):
    cells = staff_cells(spark, folder)
    batch = cells.select("header", F.col("doc").alias("source_document"), F.col("row").alias("seen_at"))
    store = spark.createDataFrame(
        [("n de bureau", "N de bureau", "vieux.csv", 5, 6, 10)],
        "normalized_header string, source_header string, source_document string, first_seen bigint, last_seen bigint, seen_count bigint",
    )
    return headers.unknown_headers(batch, headers.canonical_headers(cells, taught(spark)), store).drop("source_document")


@query(
    "h6_learn_mapping",
    """SELECT 'bureau' || (rid % 11) AS normalized_header, CASE WHEN max(rid) % 2 = 0 THEN 'Spécialité' ELSE 'Ignorer' END AS canonical, count(*) AS usage_count FROM staff GROUP BY rid % 11
    UNION ALL SELECT 'ancien', 'Nom', 3""",
    _STAFF,
)
def h6(spark, folder):
    s = staff(spark, folder)
    new = s.select(
        F.concat(F.lit("Bureau"), (F.col("rid") % 11).cast("string"), F.lit(" (x)")).alias("header"),
        F.when(F.col("rid") % 2 == 0, "Spécialité").otherwise("Ignorer").alias("canonical"), "rid",
    )
    store = spark.createDataFrame(
        [("ancien", "Ancien", "Nom", 3)], "normalized_header string, source_header string, canonical string, usage_count bigint"
    )
    unknown = spark.createDataFrame([("bureau1",), ("autre",)], "normalized_header string")
    return headers.learn_mapping(store, new, unknown, "rid")[0].select("normalized_header", "canonical", "usage_count")


# --- questions -------------------------------------------------------------------
def questions(spark, folder):
    c = views.table(spark, folder, "conversations").filter("role = 'user'")
    qid = F.col("conv_id") * 1000 + F.col("turn")
    day = F.element_at(F.array(*map(F.lit, [d.lower() for d in views.keys.WEEK_DAYS] + [""])), (F.col("conv_id") % 8 + 1).cast("int"))
    ask = F.concat(F.lit(" Quelle matière en salle "), (F.col("conv_id") % 40).cast("string"), F.lit(" "), day, F.lit(" ?"))
    return c.select(qid.alias("question_id"), F.concat("text", ask).alias("question"))


_Q = """
qs AS (SELECT conv_id * 1000 + turn AS question_id, lower(strip_accents(text || ' Quelle matière en salle ' || (conv_id % 40) || ' ' || (['lundi', 'mardi', 'mercredi', 'jeudi', 'vendredi', 'samedi', 'dimanche', ''])[conv_id % 8 + 1] || ' ?')) AS q
  FROM conversations WHERE role = 'user'),
"""


def _has(words):
    return " OR ".join(f"contains(q, '{w}')" for w in words)


@query(
    "i3_question_intents",
    "SELECT question_id, "
    + ", ".join(f"({_has(w)}) AS {n}" for n, w in linking.INTENTS.items())
    + ", CASE "
    + " ".join(f"WHEN regexp_matches(q, '\\b{d.lower()}\\b') THEN '{d.upper()}'" for d in views.keys.WEEK_DAYS)
    + " ELSE '' END AS day FROM qs",
    _Q,
)
def i3(spark, folder):
    return linking.question_intents(questions(spark, folder)).drop("question")


@query("i1_entity_scores")
def i1(spark, folder):
    asked = linking.question_intents(questions(spark, folder)).withColumn("scope", F.col("day"))
    scores = linking.entity_scores(asked, linking.entity_dictionary(views.sessions(spark, folder)))
    return scores.select("question_id", "kind", "value", F.round("score", 6).alias("score"))


@query("i2_link_entity")
def i2(spark, folder):
    out = linking.link_entity(questions(spark, folder), views.sessions(spark, folder))
    return out.select("question_id", "day", "kind", "value", F.round("score", 6).alias("score"))


@query(
    "i4_entity_schedule",
    """SELECT DISTINCT question_id, jour, horaire, matiere, type_seance, enseignant, salle, filiere, groupe FROM (
      SELECT conv_id || '-' || turn AS question_id, (conv_id + turn) % 3 AS kind, (conv_id + turn) % 40 AS n,
        CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN 'LUNDI' WHEN 2 THEN 'MARDI' ELSE 'SAMEDI' END AS day FROM conversations) q
    JOIN sessions ON (day = '' OR day = upper(jour)) AND CASE kind WHEN 0 THEN lower(salle) = 'salle ' || n WHEN 1 THEN lower(filiere) = ['iaid', 'idsd', 'iid'][n % 3 + 1]
      ELSE lower(matiere) = 'module ' || n END""",
    views.SQL_SESSIONS,
)
def i4(spark, folder):
    """Every turn of every conversation asks for a room, a programme or a subject, on a day or on all."""
    n = F.col("conv_id") + F.col("turn")
    kind, pick = n % 3, lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    linked = views.table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"),
        pick(["", "LUNDI", "MARDI", "SAMEDI"], F.col("turn") % 4).alias("day"),
        pick(["salle", "filiere", "matiere"], kind).alias("col"),
        F.when(kind == 0, F.concat(F.lit("salle "), n % 40)).when(kind == 1, pick(["iaid", "idsd", "iid"], n % 40 % 3))
        .otherwise(F.concat(F.lit("module "), n % 40)).alias("norm"),
    )
    return linking.entity_schedule(linked, views.sessions(spark, folder))


for _name, _sql in {
    "teachers": "SELECT DISTINCT jour, enseignant, matiere, horaire, salle, filiere FROM sessions WHERE enseignant <> ''",
    "teacher_count": "SELECT jour, count(DISTINCT enseignant) AS professeurs FROM sessions WHERE enseignant <> '' GROUP BY 1",
    "rooms": "SELECT DISTINCT jour, salle, horaire, matiere, enseignant, filiere FROM sessions WHERE salle <> ''",
    "subjects": "SELECT DISTINCT jour, matiere, type_seance, horaire, enseignant, salle, filiere FROM sessions",
    "programmes": "SELECT DISTINCT jour, filiere FROM sessions",
}.items():

    @query(f"i5_day_{_name}", _sql, views.SQL_SESSIONS)
    def i5(spark, folder, name=_name):
        return linking.day_answers(views.sessions(spark, folder))[name]


@query(
    "j1_three_way_reconcile",
    """SELECT o_orderkey, CASE WHEN k % 5 = 0 THEN 'first_choice' WHEN k % 6 = 0 THEN 'first_upload' WHEN k % 7 = 0 THEN 'conflict' WHEN k % 2 = 0 THEN 'local_blocked'
      WHEN k % 3 = 0 THEN 'pull' ELSE 'up_to_date' END AS status FROM (SELECT *, o_orderkey AS k FROM orders)""",
)
def j1(spark, folder):
    o = views.table(spark, folder, "orders")
    k = F.col("o_orderkey")
    fresh = k % 5 == 0
    new = (k % 6 == 0) & ~fresh
    clash = (k % 7 == 0) & ~fresh & ~new
    mark = lambda when, s: F.when(when, F.concat("o_orderstatus", F.lit(s))).otherwise(F.col("o_orderstatus"))
    base = o.filter(~fresh & ~new)
    local = o.withColumn("o_orderstatus", mark(fresh | clash | (k % 2 == 0), "L"))
    remote = o.filter(~new).withColumn("o_orderstatus", mark(fresh | clash | ((k % 3 == 0) & (k % 2 != 0)), "R"))
    return reconcile.three_way_reconcile(base, local, remote, ["o_orderkey"])
