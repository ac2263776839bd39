"""Imports with rules against a sequential reading, and the rounds of entity resolution."""

import random
from collections import Counter

import pytest

from chronogrid.operators import people, resolution

from .test_people import frame, key, record, sequential, tel

RULES = "person_id bigint, field string, low string, high string, preferred string, decision string, usage_count bigint"
UNSTATED = "Non précisé"
NAMES = people.FIELDS


def same_person(a, b):
    ours = (key(a["email"]), tel(a["telephone"]), key(a["nom"] + " " + a["prenom"]))
    theirs = (key(b["email"]), tel(b["telephone"]), key(b["nom"] + " " + b["prenom"]))
    return any(x and x == y for x, y in zip(ours, theirs))


def plain_import(store, batch, rules):
    """One record after the other, as a person at a desk would enter them."""
    folk = {r["rid"]: {**r, "alternatives": []} for r in store}
    outcome, opened, resolved, used = {}, {}, [], Counter()
    for r in batch:
        if not any(r[c].strip() not in ("", UNSTATED) for c in NAMES) and not r["extras"]:
            continue
        if not (key(r["email"]) or tel(r["telephone"]) or key(r["nom"] + " " + r["prenom"])):
            outcome[r["rid"]] = ("pending", None)
            continue
        hit = next((i for i in sorted(folk) if same_person(folk[i], r)), None)
        if hit is None:
            folk[r["rid"]] = {**r, "alternatives": []}
            outcome[r["rid"]] = ("inserted", r["rid"])
            continue
        outcome[r["rid"]] = ("updated", hit)
        held = folk[hit]
        for c, name in NAMES.items():
            new, now = r[c].strip(), held[c].strip()
            if new in ("", UNSTATED):
                continue
            if now in ("", UNSTATED):
                held[c] = new
            elif key(now) != key(new):
                pair = (hit, name, *sorted((key(now), key(new))))
                if pair in rules:
                    preferred, decision = rules[pair]
                    preferred = preferred.strip() or now
                    if decision == "les_deux":
                        held["alternatives"].append((name, new if key(preferred) == key(now) else now))
                    held[c] = preferred
                    used[pair] += 1
                    resolved.append((hit, name, now, new, r["rid"], preferred))
                else:
                    opened.setdefault((hit, name, new), (now, r["rid"]))
    return folk, outcome, opened, resolved, used


def random_case(rng, b):
    """A few stored people, records that meet them and each other, and rules for the stored ones."""
    mail = lambda: rng.choice(["", "", f"m{b}x{rng.randint(0, 3)}@x.y"])
    phone = lambda: rng.choice(["", "", f"06{b:05d}{rng.randint(100, 102)}"])
    name = lambda: rng.choice(["", f"N{b}a", f"N{b}b", f"N{b}c", f"N{b}c"])
    first = lambda: rng.choice(["", f"Ali{b}", f"Éva{b}", f"éva{b}"])
    other = lambda: rng.choice(["", "Info", "Maths", "Droit", UNSTATED, "info"])
    new = lambda rid: record(rid, email=mail(), telephone=phone(), nom=name(), prenom=first(), departement=other(), statut=other())
    store = [new(b * 100 + k) for k in range(rng.randint(1, 3))]
    batch = [new(1_000_000_000 + b * 100 + k) for k in range(rng.randint(4, 14))]
    values = {
        "Email": [f"m{b}x{k}@x.y" for k in range(4)], "Téléphone": [f"06{b:05d}{k}" for k in range(100, 103)],
        "Nom": [f"N{b}a", f"N{b}b", f"N{b}c"], "Prénom": [f"Ali{b}", f"Éva{b}"], "Département": ["Info", "Maths", "Droit"],
    }
    rules = {}
    for person in store:
        for field, known in values.items():
            for i, x in enumerate(known):
                for y in known[i + 1 :]:
                    if rng.random() < 0.6:
                        preferred = rng.choice([x, y, y, "", rng.choice(known)])
                        rules[(person["rid"], field, *sorted((key(x), key(y))))] = (preferred, rng.choice(["actuelle", "nouvelle", "les_deux"]))
    return store, batch, rules


def compare(spark, cases):
    flat = lambda i: [r for case in cases for r in case[i]]
    rows = [(*pair, preferred, decision, 0) for case in cases for pair, (preferred, decision) in case[2].items()]
    done = people.import_records(frame(spark, flat(0)), frame(spark, flat(1)), spark.createDataFrame(rows, RULES))
    got = {
        "outcome": {r.rid: (r.outcome, r.person_id) for r in done.outcome.collect()},
        "people": {r.person_id: r for r in done.people.collect()},
        "opened": {(r.person_id, r.field, r.incoming): (r.current, r.rid) for r in done.conflicts.collect()},
        "resolved": Counter((r.person_id, r.field, r.current, r.incoming, r.rid, r.kept) for r in done.resolved.collect()),
        "used": {(r.person_id, r.field, r.low, r.high): r.usage_count for r in done.rules.collect() if r.usage_count},
    }
    moved = 0
    for store, batch, rules in cases:
        folk, outcome, opened, resolved, used = plain_import(store, batch, rules)
        assert {k: v for k, v in got["outcome"].items() if k in {r["rid"] for r in batch}} == outcome
        ids = set(folk)
        assert {k: v for k, v in got["opened"].items() if k[0] in ids} == opened
        assert {k: n for k, n in got["resolved"].items() if k[0] in ids} == Counter(resolved)
        assert {k: n for k, n in got["used"].items() if k[0] in ids} == used
        for i, want in folk.items():
            r = got["people"][i]
            for c in NAMES:
                held = want[c].strip()
                assert r[c].strip() == (UNSTATED if c == "statut" and not held else held), (i, c)
            lists = {}
            for name, value in want["alternatives"]:
                if value not in lists.setdefault(f"Alternative {name}", []):
                    lists[f"Alternative {name}"].append(value)
            assert r.extras == lists
        moved += any(f in ("Email", "Téléphone", "Nom") for _, f, *_ in resolved)
    return moved


def test_five_hundred_imports_with_rules(spark):
    rng = random.Random(3)
    assert compare(spark, [random_case(rng, b) for b in range(500)]) > 100


def test_long_histories_are_folded_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(resolution, "CHUNK", 3)
    rng = random.Random(4)
    assert compare(spark, [random_case(rng, b) for b in range(60)]) > 10


def test_one_key_in_a_third_of_the_rows(spark):
    rng = random.Random(8)
    rows = [
        record(
            i,
            email="hot@x.y" if i % 3 == 0 else rng.choice(["", f"m{rng.randint(0, 60)}@x.y"]),
            telephone=rng.choice(["", f"06 00 01 {rng.randint(100, 160)}"]),
            nom=rng.choice(["", f"N{rng.randint(0, 50)}", f"N{i}"]),
            prenom=rng.choice(["", "Ali"]),
        )
        for i in range(600)
    ]
    found = resolution.resolve(frame(spark, rows), split_rows=20)
    assert {r.rid: r.label for r in found.labels.collect()} == sequential(rows)
    looked = found.looked_at
    assert len(looked) > 2 and looked[-1] < looked[0] / 3 and sorted(looked, reverse=True)[:2] == looked[:2]


@pytest.mark.parametrize("size", [1, 2])
def test_small_and_empty_imports(spark, size):
    rows = [record(5 + k, nom="A", prenom="B") for k in range(size)]
    done = people.import_records(frame(spark, []) if size > 1 else frame(spark, rows[:1]), frame(spark, rows[1:]), spark.createDataFrame([], RULES))
    assert done.people.count() == 1 and done.resolved.count() == 0
