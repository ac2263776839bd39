"""The delimited reader against a reading character by character, and the folder for cut lineages."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from chronogrid.operators import headers
from chronogrid.sources import delimited

HEAD = "Nom;Email;Note"


@pytest.fixture
def learned(spark):
    return spark.createDataFrame([], "normalized_header string, canonical string")


@pytest.fixture
def ranges(spark):
    """Cuts files into ranges of a few bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("48", "0"), strict=True):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def plain_records(text, delimiter):
    """Records that are no blank lines, and whether the last value is closed. A quote opens a value at its start only."""
    rows, row, cell, state, quotes = [], [], "", "start", False
    for c in text + "\n":
        if state == "quoted":
            if c == '"':
                state = "quote"
            else:
                cell += c
            continue
        if state == "quote" and c == '"':
            cell, state = cell + '"', "quoted"
        elif state == "start" and c == '"':
            state, quotes = "quoted", True
        elif c == delimiter:
            row, cell, state = [*row, cell], "", "start"
        elif c == "\n":
            if quotes or row or cell.strip():
                rows.append([*row, cell])
            row, cell, state, quotes = [], "", "start", False
        else:
            cell, state = cell + c, "plain"
    return rows, state != "quoted"


def save(path, texts):
    os.makedirs(path, exist_ok=True)
    for name, text in texts.items():
        with open(f"{path}/{name}", "wb") as file:
            file.write(text.encode() if isinstance(text, str) else text)


def read(spark, path, learned):
    found = delimited.open_delimited(spark, f"{path}/*.csv", learned)
    cells = {}
    for r in delimited.delimited_cells(found).collect():
        cells.setdefault(os.path.basename(r.doc), {}).setdefault(r.row, {})[r.col] = (r.header, r.value)
    notices = {os.path.basename(r.doc): (r.kind, r.detail) for r in delimited.delimited_notices(found).collect()}
    return cells, notices, found


@pytest.mark.parametrize("seed", [1, 2])
def test_random_files_cut_into_ranges(spark, learned, ranges, tmp_path, seed):
    rng = random.Random(seed)
    texts, want, open_ones = {}, {}, set()
    for k in range(25):
        body = "".join(rng.choice('ab";\n"\n;é ') for _ in range(rng.randint(5, 150)))
        text = f"{HEAD}\n{body}"
        rows, closed = plain_records(text, ";")
        texts[f"f{k}.csv"] = text
        if not closed:
            open_ones.add(f"f{k}.csv")
            continue
        want[f"f{k}.csv"] = [r[:3] for r in rows[1:]]
    save(tmp_path, texts)
    cells, notices, found = read(spark, tmp_path, learned)
    assert found.lines.select("block").distinct().count() > 3
    assert {n for n, (kind, _) in notices.items() if kind == "unclosed quote"} == open_ones
    for name, rows in want.items():
        got = cells.get(name, {})
        assert [[got[k][c][1] for c in sorted(got[k])] for k in sorted(got)] == rows, (name, texts[name])


def test_value_over_lines_and_over_a_border(spark, learned, ranges, tmp_path):
    note = "first line; \"quoted\"\n\n" + "x" * 200 + "\nlast"
    quoted = '"' + note.replace('"', '""') + '"'
    save(tmp_path, {"a.csv": f"Nom;Email;Note\nA;a@x.org;{quoted}\nB;b@x.org;\n", "b.csv": "Nom,Email\nC,c@x.org\n"})
    cells, notices, _ = read(spark, tmp_path, learned)
    assert cells["a.csv"][1] == {0: ("Nom", "A"), 1: ("Email", "a@x.org"), 2: ("Note", note)}
    assert cells["a.csv"][2][0] == ("Nom", "B") and cells["b.csv"][1][0] == ("Nom", "C") and not notices


def test_encodings_marks_and_suggested_delimiters(spark, learned, tmp_path):
    save(
        tmp_path,
        {
            "utf8.csv": "﻿Nom:Email\nÉ\x00b:e@x.org",
            "windows.csv": "Nom;Email\nPrénom€;p@x.org".encode("cp1252"),
            "latin.csv": "Nom;Email\nPr\xe9\x81;p@x.org".encode("latin-1"),
            "odd.csv": "Nom~Email\nA~a@x.org",
            "late.csv": "\n" * 40 + "Liste;;\n\nNom;Email;Bureau\nA;a@x.org;B1\n",
            "none.csv": "rouge;vert\n1;2\n",
            "empty.csv": "\n \n",
        },
    )
    cells, notices, _ = read(spark, tmp_path, learned)
    assert cells["utf8.csv"][1] == {0: ("Nom", "É\x00b"), 1: ("Email", "e@x.org")}
    assert cells["windows.csv"][1][0] == ("Nom", "Prénom€") and cells["latin.csv"][1][0] == ("Nom", "Pr\xe9\x81")
    assert cells["odd.csv"][1][1] == ("Email", "a@x.org")
    assert cells["late.csv"] == {2: {0: ("Nom", "A"), 1: ("Email", "a@x.org"), 2: ("Bureau", "B1")}}
    assert notices == {
        "late.csv": ("header below first row", "2"),
        "none.csv": ("no known column", "[rouge, vert]"),
        "empty.csv": ("no rows", ""),
    }


def test_records_that_say_nothing_are_left_out(spark, learned, tmp_path):
    save(tmp_path, {"a.csv": "Statut;Nom;Email\nNon précisé;;\nNon précisé;A;\n;;\n"})
    cells = delimited.delimited_cells(delimited.open_delimited(spark, f"{tmp_path}/*.csv", learned))
    rows = headers.map_rows(cells, headers.canonical_headers(cells, learned)).collect()
    assert [r.nom for r in rows] == ["A"]


def test_a_large_file_is_many_tasks(spark, ranges, tmp_path):
    save(tmp_path, {"big.csv": HEAD + "\nA;a@x.org;n" * 400})
    assert spark.read.text(f"{tmp_path}/big.csv").rdd.getNumPartitions() > 50


def test_long_quoted_lines(spark):
    wide = ";".join(['"a;b"'] * 20_000)
    rows = spark.createDataFrame([(wide,), ('x;"say ""hi; you"""; "y";"a"b;',)], "t string")
    got = [r.v for r in rows.select(delimited.cells_of(F.col("t"), F.lit(";")).alias("v")).collect()]
    assert got[0] == ["a;b"] * 20_000 and got[1] == ["x", 'say "hi; you"', ' "y"', "ab", ""]


def test_lineage_is_cut_without_any_setting(tmp_path):
    script = (
        "from pyspark.sql import SparkSession\nfrom chronogrid.session import cut_lineage, shared_folder\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('rows', cut_lineage(spark.range(3)).count(), shared_folder(spark) == shared_folder(spark))\n"
    )
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_SUBMIT_ARGS", "SPARK_CONF_DIR")}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run(
        [sys.executable, "-c", script], env={**env, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}, capture_output=True, text=True
    )
    assert "rows 3 True" in out.stdout, out.stderr[-2000:]


def test_cells_are_never_gathered_for_their_names(spark, learned, tmp_path):
    save(tmp_path, {"a.csv": f"{HEAD}\nA;a@b.c;1\n\"B\n2\";b@b.c;2\n"})
    found = delimited.open_delimited(spark, f"{tmp_path}/*.csv", learned)
    cells = delimited.delimited_cells(found)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "rightHint=(strategy=broadcast)" in plan
    lines = found.lines._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in lines
    assert cells.filter("header = 'Nom'").count() == 2
