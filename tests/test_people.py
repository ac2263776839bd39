"""Entity resolution and staff upsert against a sequential reading of the rules."""

import random
import re

from pyspark.sql import functions as F

from chronogrid.functions.folding import fold_text
from chronogrid.functions.similarity import ratio
from chronogrid.operators import matching, people, resolution

SCHEMA = "rid bigint, " + ", ".join(f"{c} string" for c in people.FIELDS) + ", extras map<string,array<string>>, source_document string, feuille string"


def key(v):
    v = fold_text(v, "NFD").lower().replace("_", " ").replace("-", " ")
    return re.sub(r" +", " ", re.sub(r"[^a-z0-9@.+ ]+", " ", v)).strip()


def tel(v):
    d = re.sub(r"[^0-9]", "", v)
    return d if len(d) >= 8 else ""


def sequential(rows):
    """rid -> rid of the entity's first record."""
    groups, out = [], {}
    for r in rows:
        ks = (key(r["email"]), tel(r["telephone"]), key(r["nom"] + " " + r["prenom"]))
        hit = None
        for g in groups:
            gs = (key(g["email"]), tel(g["telephone"]), key(g["nom"] + " " + g["prenom"]))
            if any(a and a == b for a, b in zip(gs, ks)):
                hit = g
                break
        if hit is None:
            groups.append(dict(r))
            out[r["rid"]] = r["rid"]
        else:
            for c in ("email", "telephone", "nom", "prenom"):
                if not hit[c].strip():
                    hit[c] = r[c]
            out[r["rid"]] = hit["rid"]
    return out


def record(rid, **kw):
    base = {c: "" for c in people.FIELDS}
    return {"rid": rid, **base, "extras": {}, "source_document": f"f{rid}", "feuille": "F", **kw}


def frame(spark, rows):
    cols = [x.split()[0] for x in SCHEMA.split(", ")]
    names = ["rid", *people.FIELDS, "extras", "source_document", "feuille"]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], SCHEMA)


def test_resolution_equals_the_sequential_pass(spark):
    rng = random.Random(11)
    for size in (60, 150):
        rows = [
            record(
                i,
                email=rng.choice(["", f"m{rng.randint(0, size // 6)}@x.y"]),
                telephone=rng.choice(["", f"06 00 00 {rng.randint(10, 10 + size // 6)}"]),
                nom=rng.choice(["", f"N{rng.randint(0, size // 8)}"]),
                prenom=rng.choice(["", "Ali", "Éva"]),
            )
            for i in range(size)
        ]
        got = {r.rid: r.label for r in people.resolve_entities(frame(spark, rows), split_rows=5).collect()}
        assert got == sequential(rows)


def test_bounded_components_are_walked_without_rounds(spark):
    # Halves of names come from different records, blank, unstated or made of signs only.
    rng = random.Random(4)
    rows = [
        record(
            i,
            email=rng.choice(["", "", f"m{rng.randint(0, 25)}@x.y", "Non précisé" if i % 40 == 0 else ""]),
            telephone=rng.choice(["", "", f"06 00 00 {rng.randint(10, 35)}"]),
            nom=rng.choice(["", f"N{rng.randint(0, 30)}", f"Ben N{rng.randint(0, 30)}", f"N{rng.randint(0, 30)} Ali", "???"]),
            prenom=rng.choice(["", f"P{rng.randint(0, 9)}", "Ali", "Éva-Lou", "N3"]),
        )
        for i in range(240)
    ]
    found = resolution.resolve(frame(spark, rows))
    assert {r.rid: r.label for r in found.labels.collect()} == sequential(rows)
    assert found.looked_at == []
    # Two halves make a name that only a third record asks for; components above the bound go through rounds.
    halves = [
        record(1, nom="Naji", email="n@x.y"), record(2, prenom="Ali", email="n@x.y"), record(3, nom="Naji", prenom="Ali"),
        record(4, prenom="Zoé", email="z@x.y"), record(5, nom="Alami", email="z@x.y"), record(6, nom="Alami", prenom="Zoé"),
        record(7, nom="Seul"), record(8, telephone="0611223344", nom="A"), record(9, telephone="06 11 22 33 44"),
    ]
    for bound in (2, 100):
        found = resolution.resolve(frame(spark, halves), split_rows=bound)
        assert {r.rid: r.label for r in found.labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 8}
        assert bool(found.looked_at) == (bound == 2)


def test_upsert_fills_blanks_and_reports_conflicts(spark):
    store = frame(spark, [record(1, nom="Durand", prenom="Zoé", email="z@x.y", departement="Info")])
    batch = frame(
        spark,
        [
            record(10, email="Z@x.y", telephone="0611223344", departement="Maths", extras={"Bureau": ["B1"]}),
            record(11, nom="Neuf", prenom="Ana", statut="Non précisé"),
            record(12, diplome="Doctorat"),
            record(13, nom="Neuf", prenom="Ana", departement="Droit"),
        ],
    )
    outcome, after, conflicts = people.upsert_people(store, batch)
    assert {(r.rid, r.outcome, r.person_id) for r in outcome.collect()} == {
        (10, "updated", 1), (11, "inserted", 11), (12, "pending", None), (13, "updated", 11),
    }
    by_id = {r.person_id: r for r in after.collect()}
    assert by_id[1].telephone == "0611223344" and by_id[1].departement == "Info"
    assert by_id[1].extras == {"Bureau": ["B1"]} and by_id[1].source_document == "f1 ; f10"
    assert by_id[11].departement == "Droit" and by_id[11].statut == "Non précisé"
    assert [(r.person_id, r.field, r.current, r.incoming) for r in conflicts.collect()] == [
        (1, "Département", "Info", "Maths")
    ]


def test_rules_follow_decisions(spark):
    folk = spark.createDataFrame(
        [(1, *[""] * 7, "Info", {})], "person_id bigint, " + ", ".join(f"{c} string" for c in people.FIELDS) + ", extras map<string,array<string>>"
    )
    conflicts = spark.createDataFrame(
        [(5, 1, "Département", "Info", "Maths", "open", None)],
        "conflict_id bigint, person_id bigint, field string, current string, incoming string, status string, resolution string",
    )
    rules = spark.createDataFrame(
        [], "person_id bigint, field string, low string, high string, preferred string, decision string, usage_count bigint"
    )
    decisions = spark.createDataFrame([(5, "les_deux")], "conflict_id bigint, decision string")
    done, changed, known = people.resolve_conflicts(conflicts, decisions, folk, rules)
    assert done.first().status == "resolved"
    assert changed.first().extras == {"Alternative Département": ["Maths"]}
    again = spark.createDataFrame(
        [(1, "Département", "MATHS", "info", 9)], "person_id bigint, field string, current string, incoming string, rid bigint"
    )
    ruled = people.apply_conflict_rules(again, known).first()
    assert (ruled.status, ruled.kept, ruled.alternative) == ("auto_resolved", "Info", "MATHS")


def test_similarity_join_loses_no_pair(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 12))).strip() or "a"
    left, right = sorted({word() for _ in range(90)}), sorted({word() for _ in range(90)})
    df = lambda ws: spark.createDataFrame([(w,) for w in ws], "text string")
    for floor in (0.68, 0.86):
        got = {(r.a, r.b) for r in matching.similar_pairs(df(left), df(right), floor).collect()}
        assert got == {(a, b) for a in left for b in right if ratio(a, b) >= floor}


def test_blocks_of_names_lose_no_pair(spark):
    # Names that share a last word all share its pieces; blocks of letter counts hold them apart.
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 9)))
    names = sorted({word() + rng.choice([" with", "", " with", "\U0001d400"]) for _ in range(120)})
    df = spark.createDataFrame([(w,) for w in [*names, names[0], "", None]], "text string")
    for floor in (0.5, 0.86):
        got = [(r.a, r.b, r.ratio) for r in matching.similar_within(df, floor, block=7).collect()]
        assert sorted(got) == sorted((a, b, ratio(a, b)) for a in names for b in names if a != b and ratio(a, b) >= floor)
    plan = people.similar_names(spark.createDataFrame([("N", "P", 1)], "nom string, prenom string, person_id int"))
    assert "piece" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_names_grow_with_the_names(spark, monkeypatch):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.choice((5, 6)))) for _ in range(150)})
    df = spark.createDataFrame([(w,) for w in names], "text string")
    sent = []
    cut = matching.cut_lineage
    monkeypatch.setattr(matching, "cut_lineage", lambda d: sent.append(cut(d)) or sent[-1])
    for name, value in (("BLOCK", 4), ("BLOCKS", 4), ("STRIP", 3)):
        monkeypatch.setattr(matching, name, value)
    got = sorted((r.a, r.b) for r in matching.similar_within(df, 0.86).select("a", "b").collect())
    assert got == [(a, b) for a in names for b in names if a != b and ratio(a, b) >= 0.86]
    assert [d.count() for d in sent if "texts" in d.columns][0] <= 2 * matching.BLOCKS
