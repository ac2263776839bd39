"""Joins whose sides grow with the input are shuffled, whatever size is guessed for them."""

import random
import re

from pyspark.sql import functions as F

from chronogrid import skew
from chronogrid.functions import keys
from chronogrid.operators import conflicts, diff, extract, headers, linking, search
from chronogrid.plans import views


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {kind: plan.count(kind) for kind in ("SortMergeJoin", "BroadcastHashJoin")}


def event_rows(spark, n=40):
    rows = [(i, f"2024-01-{1 + i % 9:02d} 10:00:00", i % 5, "view", f'{{"k": {i % 30}}}') for i in range(n)]
    e = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, props string")
    return views.sessions_from(e.withColumn("ts", e.ts.cast("timestamp")))


def test_conflicts_meet_in_a_shuffle(spark):
    assert joins(conflicts.detect_conflicts(event_rows(spark)))["SortMergeJoin"] == 1


def test_conflicts_are_found_between_titles(spark):
    rng = random.Random(5)
    pick = rng.choice
    cols = ["jour", "horaire", "matiere", "enseignant", "salle", "filiere", "niveau"]
    rows = [
        (i, pick(["Lundi", "LUNDI", "Mardi"]), pick(["08h00–09h30", "08h00-09h30", "09h00–10h00", "08h00–10h00"]), pick(["M", "N"]),
         pick(["Pr. A", "pr a", "B", ""]), pick(["S1", "s1", "S2", "-"]), "RT", pick(["S1", "S2"]))
        for i in range(90)
    ]
    s = spark.createDataFrame(rows, "ord bigint, " + ", ".join(f"{c} string" for c in cols))
    key = [r[:8] for r in s.select("ord", *[keys.resource_key(c).alias(c) for c in cols]).collect()]
    named = {r[0]: dict(zip(cols, r[1:])) for r in key}
    minutes = {"08h00–09h30": (480, 570), "08h00-09h30": (480, 570), "09h00–10h00": (540, 600), "08h00–10h00": (480, 600)}
    clock = lambda m: f"{m // 60:02d}h{m % 60:02d}"
    due = set()
    for a in rows:
        for b in rows:
            (x, y), (v, w), m, n = minutes[a[2]], minutes[b[2]], named[a[0]], named[b[0]]
            if not (a[0] < b[0] and m["jour"] == n["jour"] and x < w and v < y):
                continue
            if all(m[c] == n[c] for c in ("matiere", "enseignant", "salle", "horaire")):
                continue
            for kind, c, i in (("Professeur", "enseignant", 4), ("Salle", "salle", 5)):
                if m[c] == n[c] and m[c] not in ("", "-"):
                    title = lambda r: f"{r[6]} {r[7]} – {r[3]} ({r[2]})"
                    due.add((kind, a[i], a[1], f"{clock(max(x, v))}–{clock(min(y, w))}", title(a), title(b), "À vérifier"))
    for split in (20_000, 3):
        found = [tuple(r) for r in conflicts.detect_conflicts(s, split_rows=split).collect()]
        assert len(found) == len(set(found)) and set(found) == due
    # Sessions that read alike are one row before they are paired, and reports that cannot repeat are not compared.
    plain = s.filter("jour <> 'LUNDI' and enseignant <> 'pr a' and salle <> 's1' and horaire <> '08h00-09h30'")
    plan = conflicts.detect_conflicts(plain)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_versions_are_compared_in_shuffles(spark):
    s = event_rows(spark)
    old, new = diff.comparable(s, "version_id", "ord"), diff.comparable(s.filter("ord % 7 > 0"), "version_id", "ord")
    assert joins(diff.score_row_pairs(old, new))["SortMergeJoin"] >= 10
    rest = [old.select("pair", "cls", "idx", "row", "norm")] * 2
    pairs = old.selectExpr("pair", "idx AS old_idx", "idx AS new_idx")
    assert joins(diff.diff_rows(*rest, pairs)) == {"SortMergeJoin": 4, "BroadcastHashJoin": 0}


def test_records_of_files_meet_in_shuffles(spark):
    cells = [("d", 1, 0, "Nom", "A"), ("d", 1, 1, "Bureau", "B")]
    mapping = spark.createDataFrame([("Nom", "Nom"), ("Bureau", None)], "header string, canonical string")
    rows = headers.map_rows(spark.createDataFrame(cells, "doc string, row bigint, col int, header string, value string"), mapping)
    assert joins(rows) == {"SortMergeJoin": 4, "BroadcastHashJoin": 0}
    assert [(r.nom, r.extras) for r in rows.collect()] == [("A", {"Bureau": ["B"]})]


def test_texts_are_worked_out_once_before_they_are_folded(spark):
    d = spark.createDataFrame([("PR.  é…ﬁ ½",), ("’a  b",), (None,)], "t string")
    plan = d.select(keys.ascii_key("t").alias("k"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1
    assert [r.k for r in plan.collect()] == ["E FI 1 2", "A B", ""]


def test_questions_are_not_sent_with_each_of_their_substrings(spark):
    q = spark.createDataFrame([(1, "", "Où est Salle 12 ?"), (2, "", "iaid")], "question_id bigint, scope string, question string")
    e = spark.createDataFrame([("", "salle", "salle", "salle 12", "Salle 12"), ("", "filière", "filiere", "iaid", "IAID")], "scope string, kind string, col string, norm string, value string")
    scores = linking.entity_scores(q, e)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Project \[question_id#\d+L, gram#\d+\]|Generate explode\(.*\), \[1\], false, \[gram#", plan)
    assert not re.search(r"Project \[question_id#\d+L, qn#\d+, gram#\d+\]", plan)
    assert {(r.question_id, r.value) for r in scores.collect() if r.score == 1.0} == {(1, "Salle 12"), (2, "IAID")}


def test_days_of_entities_are_folded_once_per_value(spark, monkeypatch):
    shown = ["jour", "enseignant", "matiere", "salle", "filiere"]
    rows = [(i, j, "A", m, "S", None) for i, (j, m) in enumerate([("Lundi", "M "), ("LUNDI", "m"), (None, "M"), ("Lundi", "m")])]
    s = spark.createDataFrame(rows, "ord bigint, " + ", ".join(f"{c} string" for c in shown))
    folded = []
    cut = linking.cut_lineage
    monkeypatch.setattr(linking, "cut_lineage", lambda d: folded.append(d) or cut(d))
    found = {(r.scope, r.col, r.norm, r.value) for r in linking.entity_dictionary(s).collect()}
    assert found == {(d, c, n, v) for d in ("", "LUNDI") for c, n, v in (("enseignant", "a", "A"), ("salle", "s", "S"), ("matiere", "m", "M"))}
    assert len(folded) == 1 and "upper(" not in plan_of(folded[0])


def test_a_question_that_many_ask_is_answered_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(linking, "SPLIT_QUESTIONS", 2)
    shown = ["jour", "horaire", "matiere", "type_seance", "enseignant", "salle", "filiere", "groupe"]
    s = spark.createDataFrame([("Lundi", "10h", "M", "CM", "A", "S", "RT", "G")] * 2 + [("Mardi", "10h", "M", "CM", "A", "S", "RT", "G")], ", ".join(f"{c} string" for c in shown))
    asked = [(i, "", "filiere", "rt") for i in range(6)] + [(0, "", "salle", "s"), (1, "LUNDI", "filiere", "rt"), (1, "LUNDI", "filiere", "rt")]
    found = linking.entity_schedule(spark.createDataFrame(asked, "question_id bigint, day string, col string, norm string"), s)
    assert [(r.question_id, r.jour) for r in found.collect()] == [(i, d) for i in range(6) for d in ("Lundi", "Mardi")]
    assert "_salt" in found._jdf.queryExecution().optimizedPlan().toString()


def test_sessions_found_are_put_in_order_as_lists(spark, monkeypatch):
    monkeypatch.setattr(linking, "LIST_ROWS", 2)
    monkeypatch.setattr(linking, "RANGE_ROWS", 3)
    shown = ["jour", "horaire", "matiere", "type_seance", "enseignant", "salle", "filiere", "groupe"]
    rows = [(j, h, "M", "CM", f"A{i}", "S", "RT", "G") for j in ("Mardi", "Lundi", None, "") for h in ("9h", "10h", None) for i in range(5)]
    s = spark.createDataFrame(rows * 2, ", ".join(f"{c} string" for c in shown))
    asked = [(3, "", "salle", "s"), (3, "", "filiere", "rt"), (10, "MARDI", "filiere", "rt"), (2, "LUNDI", "matiere", "m"), (2, "", "matiere", "x")]
    found = linking.entity_schedule(spark.createDataFrame(asked, "question_id bigint, day string, col string, norm string"), s)
    whole = {"": rows, "LUNDI": rows[15:30], "MARDI": rows[:15]}
    due = [(q, *r) for q, day in ((2, "LUNDI"), (3, ""), (10, "MARDI")) for r in whole[day]]
    low = lambda x: (x is not None, x or "")
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=lambda r: [low(str(x) if x is not None else x) for x in r]) == sorted(due, key=lambda r: [low(str(x) if x is not None else x) for x in r])
    place = [(r[0], low(r[1]), low(r[2])) for r in got]
    assert place == sorted(place)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and not re.search(r"Sort \[question_id", plan)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_readings_are_made_once_before_the_best_is_chosen(spark):
    made = spark.createDataFrame([("d", 1, "text", 0, "a"), ("d", 1, "grid", 1, "b")], "doc string, page int, strategy string, table int, matiere string")
    best = extract.best_strategy(made.withColumn("matiere", F.upper("matiere")))
    assert "upper(" not in plan_of(best)
    assert [(r.strategy, r.matiere) for r in best.collect()] == [("grid", "B")]


def test_people_are_ranked_by_keys_worked_out_once(spark):
    folk = spark.createDataFrame([(1, "Alami", "Sara", "", ""), (2, "Bennis", "Ali", "", "")], "person_id bigint, nom string, prenom string, email string, telephone string")
    ranked = search.rank_people(folk, "alami")
    assert not any("regexp_replace" in x for x in plan_of(ranked).splitlines() if "Filter" in x)
    assert [(r.person_id, r.score) for r in ranked.collect()][0] == (1, 98.0)


def test_versions_are_written_once_before_they_are_compared(spark):
    s = event_rows(spark)
    _, old, new = diff.remaining(diff.comparable(s, "version_id", "ord"), diff.comparable(s.filter("ord % 7 > 0"), "version_id", "ord"))
    assert "LogicalRDD" not in plan_of(old) + plan_of(new)
    assert old.count() == s.filter("ord % 7 = 0").count() and new.count() == 0


def test_search_words_and_classes_are_worked_out_ahead(spark):
    # A negated class is tried slowly by Java, and a query's words are the same for every row.
    rows = [("Salle_17 — LUNDI ", 1), ("Ｓalle-17\tLündi", 2), ("lundi 18", 3), (None, 4), ("İ ﬁn Σ a@b.c/+ \U0001d400", 5)]
    said = spark.createDataFrame(rows, "text string, id int")
    keyed = said.select("id", keys.search_key("text").alias("k"))
    assert dict(map(tuple, keyed.collect())) == {1: "salle 17 lundi", 2: "salle 17 lundi", 3: "lundi 18", 4: "", 5: "i fin a@b.c/+ a"}
    found = search._matching(said, {"": "text"}, "Salle 17 LUNDI")
    assert sorted(r.id for r in found.collect()) == [1, 2]
    assert search._matching(said, {"": "text"}, " ").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "forall" not in plan and "[^a-z" not in plan


def test_sessions_find_their_version_without_being_sent_to_it(spark):
    facts = spark.createDataFrame([(i, i % 3) for i in range(9)], "id int, version_id int")
    few = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "version_id int, name string")
    joined = skew.look_up(facts, few, "version_id")
    assert joined.count() == 9
    assert "BuildRight" in joined._jdf.queryExecution().executedPlan().toString()
