"""Inputs that once gave wrong or partial results."""

import re

import pytest
from pyspark.sql import functions as F

from chronogrid import skew
from chronogrid.functions import folding, keys, times
from chronogrid.operators import headers
from chronogrid.sources import records


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", column("t").alias("v")).orderBy("i").collect()]


def test_no_limit_on_hot_groups(spark):
    rows = spark.range(30_000).select((F.col("id") % 1500).alias("k"), "id")
    hot = skew.hot_groups(rows, ["k"], 5)
    assert hot.count() == 1500 and {r._parts for r in hot.collect()} == {4}
    left, right = skew.split_sides(rows, rows.select("k", F.col("id").alias("other")), hot, ["k"], "id")
    assert left.join(right, ["k", "_salt"]).count() == 1500 * 20 * 20


def test_ranks_do_not_depend_on_the_values(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.abs(F.xxhash64("id")).alias("o"),
    )
    got = skew.rank_in_key(rows, ["k"], "o").filter("k = 'hot'").orderBy("o").collect()
    assert [r.rank for r in got] == list(range(1, 1001))


def test_exponents_keep_every_digit(spark):
    got = values(
        spark,
        ["1e-20", "0", "1.25e25", "125e23", "2", "2.00", "-0.50", "+1.", "-0e5", "1e", "12345678901234567890.1230", "1e5000", "10e4999"],
        times.canonical_decimal,
    )
    big = "125" + "0" * 23
    assert got[:10] == ["0." + "0" * 19 + "1", "0", big, big, "2", "2", "-0.5", "1", "0", "1e"]
    assert got[10] == "12345678901234567890.123" and got[11] == got[12]


@pytest.mark.parametrize("form", ["NFKD", "NFD"])
def test_fold_covers_all_of_unicode(spark, form):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c]
    chars = [chr(c) for c in codes if c % 53 == 0 or folding.fold_text(chr(c), form) != chr(c)]
    rows = spark.createDataFrame([(c,) for c in chars], "t string").repartition(8)
    bad = [r for r in rows.select("t", folding.fold(F.col("t"), form).alias("v")).collect() if r.v != folding.fold_text(r.t, form)]
    assert not bad


def test_any_white_space_is_trimmed(spark):
    assert values(spark, ["\tPr. Ali", " Pr. Ali ", "Pr. Ali"], keys.resource_key) == ["ALI"] * 3
    assert values(spark, ["\t", "  ", "", None, "x"], skew.blank) == [True, True, True, True, False]


def test_json_keeps_its_records(spark):
    docs = [("a", '[{"Nom":"A"}, 5, {"Nom":"B"}]'), ("b", '{"data":"[x","users":[{"Nom":"C"}]}'), ("c", '{"Nom":"D"}')]
    got = records.json_cells(spark.createDataFrame(docs, "doc string, text string")).orderBy("doc", "row").collect()
    assert [(r.doc, r.header, r.value) for r in got] == [("a", "Nom", "A"), ("a", "Nom", "B"), ("b", "Nom", "C"), ("c", "Nom", "D")]


def test_tasks_that_make_records_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(headers, "TASK_CELLS", 3)
    rows = [
        ("f", 0, 0, "Nom", " Naji "), ("f", 0, 1, "Enseignant", "Autre Nom"), ("f", 0, 2, "Name", "Plein Nom"), ("f", 0, 3, "NOM", "Alami"),
        ("f", 0, 4, "Bureau", "B1"), ("f", 0, 5, "Bureau", "B2"), ("f", 0, 6, "nom", "Naji"), ("f", 0, 7, "vide", " "), ("f", 0, 8, "Unnamed: 3", "x"),
        ("f", 1, 0, "Enseignant", "ALAMI Zoé"), ("f", 2, 0, "Statut", "Non précisé"), (None, 3, 0, "Nom", "Perdu"), ("g", 0, 0, "Nom complet source", "S"),
    ]
    cells = spark.createDataFrame(rows, "doc string, row int, col int, header string, value string")
    known = {"Nom": "Nom", "NOM": "Nom", "nom": "Nom", "Enseignant": headers.FULL_NAME, "Name": headers.FULL_NAME, "Statut": "Statut"}
    mapping = spark.createDataFrame([(h, known.get(h)) for h in {r[3] for r in rows}], "header string, canonical string")
    made = headers.map_rows(cells, mapping)
    got = {(r.doc, r.row): (r.statut, r.nom, r.prenom, r.extras) for r in made.collect()}
    assert got == {
        ("f", 0): ("Non précisé", "Naji", "", {"Nom complet source": ["Plein Nom"], "NOM": ["Alami"], "Bureau": ["B2"]}),
        ("f", 1): ("Non précisé", "ALAMI", "Zoé", {"Nom complet source": ["ALAMI Zoé"]}),
        ("g", 0): ("Non précisé", "", "", {"Nom complet source": ["S"]}),
    }
    # The cells, eleven that say something, are dealt to as many tasks as the bound asks for.
    assert re.search(r"hashpartitioning\(doc#\d+, row#\d+, 4\)", made._jdf.queryExecution().executedPlan().toString())
