"""Which entity each record belongs to, and what each entity's fields hold over time.

Records arrive in the order of ``rid``. A record joins the first entity, in order of creation, that holds its email,
phone or full name at its arrival, and then fills that entity's blank fields. Where a conflict rule remembers a
decision for an entity, a differing value may replace the one that is held, and later records meet the new value.

Records that share no key, directly or through others, never meet, so they fall into components. A component of
bounded size is walked in its order of arrival, many of them side by side. Larger ones, and imports with rules, are
worked out in rounds: every arrival depends only on earlier ones, so the outcome of the sequence is the one assignment
that reproduces itself, and it is reached from a first guess. A round looks only at records that ask for a key whose
holders changed in the round before, and only entities that won or lost a record are worked out again; what no longer
changes is neither read again in full nor rewritten.
"""

from __future__ import annotations

import heapq
import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..components import connected_components
from ..functions import keys
from ..functions.folding import clean_ws
from ..functions.keys import UNSTATED
from ..session import cut_lineage
from ..skew import hot_groups, rank_in_key, split_sides

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import the package

IDENTITY = {"email": "Email", "telephone": "Téléphone", "nom": "Nom", "prenom": "Prénom"}
CHUNK = 10_000  # values of one field that a task folds at a time
EVENTS = "person_id bigint, field string, rid bigint, kind string, current string, incoming string, kept string, decision string"


def row_keys() -> Column:
    """Keys a record asks for."""
    key = lambda kind, value: F.when(value != "", F.struct(F.lit(kind).alias("kind"), value.alias("key")))
    return F.filter(
        F.array(
            key("email", keys.person_key("email")),
            key("tel", keys.phone_digits("telephone")),
            key("nom", keys.full_name_key("nom", "prenom")),
        ),
        lambda k: k.isNotNull(),
    )


# --- values over time -------------------------------------------------------------------------


def long_values(rows: DataFrame, fields: dict[str, str], *ids: str) -> DataFrame:
    """``ids, field, value`` of every value that says something."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), clean_ws(c).alias("value")) for c, n in fields.items()])
    return rows.select(*ids, F.explode(pairs).alias("f")).select(*ids, "f.*").filter(~F.col("value").isin("", UNSTATED))


def _fold(values: list[tuple], rules: dict, current: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Events of values (rid, wording, key) that meet what is held, and what is held at the end."""
    events = []
    for rid, value, key in values:
        if current is None:
            events.append((rid, "set", None, value, value, None))
            current = (value, key)
        elif key != current[1]:
            rule = rules.get((min(key, current[1]), max(key, current[1])))
            if rule is None:
                events.append((rid, "clash", current[0], value, None, None))
                continue
            kept = (rule[0], rule[1]) if rule[0] else current
            events.append((rid, "rule", current[0], value, kept[0], rule[2]))
            current = kept
    return events, current


def _rule_map(frame: pd.DataFrame) -> dict:
    return {(r.low, r.high): (r.preferred, r.preferred_key, r.decision) for r in frame.itertuples(index=False)}


def _apart(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, for a cogroup with a frame they come from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _ruled_events(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Events of fields that have rules. ``values``: person_id, field, rid, value.

    Histories of more than ``CHUNK`` values are folded in chunks: first every chunk from each value it may start
    with, then the chunks' ends are chained, then each chunk from the value it really starts with.
    """
    by = ["person_id", "field"]
    told = cut_lineage(
        rules.select(*by, "low", "high", clean_ws("preferred").alias("preferred"), keys.person_key("preferred").alias("preferred_key"), "decision")
    )
    coded = values.join(told.select(*by).distinct(), by, "left_semi").withColumn("key", keys.person_key("value"))
    coded = cut_lineage(coded)
    longest = coded.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if longest > CHUNK:
        rank = F.floor((F.col("rank") - 1) / CHUNK).cast("bigint")
        chunked = cut_lineage(rank_in_key(coded, by, "rid").withColumn("chunk", rank).drop("rank"))
    else:
        chunked = coded.withColumn("chunk", F.lit(0).cast("bigint"))
    span = [*by, "chunk"]
    listed = lambda f: list(f.sort_values("rid")[["rid", "value", "key"]].itertuples(index=False, name=None))
    begun = _begun(chunked, told, by, listed) if longest > CHUNK else None
    context = _apart(told).join(_apart(chunked.select(*span).distinct()), by)
    if begun is None:
        none = F.lit(None).cast("string")
        context = context.withColumns({"start": none, "start_key": none})
    else:
        context = context.join(begun.select(*span, F.col("value").alias("start"), F.col("key").alias("start_key")), span, "left")

    def told_of(names: tuple, rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        start = others[["start", "start_key"]].iloc[0]
        held = None if pd.isna(start.iloc[1]) else tuple(start)
        events = _fold(listed(rows), _rule_map(others), held)[0]
        return pd.DataFrame([(*names[:2], *e) for e in events], columns=[c.split()[0] for c in EVENTS.split(", ")])

    return chunked.groupBy(*span).cogroup(_apart(context).groupBy(*span)).applyInPandas(told_of, EVENTS)


def _begun(chunked: DataFrame, told: DataFrame, by: list[str], listed) -> DataFrame:
    """``person_id, field, chunk, value, key``: what each chunk but the first starts with."""
    span = [*by, "chunk"]
    first = chunked.groupBy(*by).agg(F.min_by(F.struct("value", "key"), "rid").alias("f"))
    starts = (
        told.select(*by, F.col("preferred").alias("value"), F.col("preferred_key").alias("key"))
        .unionByName(first.select(*by, "f.*"))
        .distinct()
        .join(chunked.filter("chunk > 0").select(*span).distinct(), by)
    )

    def tried(names: tuple, rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        ours = others.drop_duplicates(["low", "high"])
        found, values = _rule_map(ours), listed(rows)
        out = []
        for value, key in others[["start", "start_key"]].drop_duplicates().itertuples(index=False, name=None):
            end = _fold(values, found, (value, key))[1]
            out.append((*names, value, key, *end))
        return pd.DataFrame(out, columns=[*span, "start", "start_key", "end", "end_key"])

    shape = "person_id bigint, field string, chunk bigint, start string, start_key string, end string, end_key string"
    offered = starts.select(*span, F.col("value").alias("start"), F.col("key").alias("start_key")).join(told, by)
    later = chunked.filter("chunk > 0")
    ends = later.groupBy(*span).cogroup(_apart(offered).groupBy(*span)).applyInPandas(tried, shape)

    def chained(names: tuple, rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found, values = _rule_map(others), listed(rows)
        held = _fold(values, found, None)[1] if values else None
        return pd.DataFrame([(*names, *held)] if held else [], columns=[*by, "value", "key"])

    heads = chunked.filter("chunk = 0").groupBy(*by).cogroup(_apart(told).groupBy(*by)).applyInPandas(
        chained, "person_id bigint, field string, value string, key string"
    )

    def walked(names: tuple, rows: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        if not len(head):
            return pd.DataFrame(columns=[*span, "value", "key"])
        steps = {(r.chunk, r.start, r.start_key): (r.end, r.end_key) for r in rows.itertuples(index=False)}
        held, out = (head["value"].iloc[0], head["key"].iloc[0]), []
        for chunk in range(1, int(rows["chunk"].max()) + 1 if len(rows) else 1):
            out.append((*names, chunk, *held))
            held = steps[(chunk, *held)]
        return pd.DataFrame(out, columns=[*span, "value", "key"])

    return ends.groupBy(*by).cogroup(_apart(heads).groupBy(*by)).applyInPandas(
        walked, "person_id bigint, field string, chunk bigint, value string, key string"
    )


def field_events(values: DataFrame, rules: DataFrame | None) -> DataFrame:
    """What each value did: ``set`` a blank field, follow a ``rule`` or ``clash``.

    ``values`` and the result name the entity ``person_id``. Without rules the first value stays.
    """
    by = ["person_id", "field"]
    free = values if rules is None else values.join(rules.select(*by).distinct(), by, "left_anti")
    first = free.groupBy(*by).agg(F.min_by(F.struct("value", "rid"), "rid").alias("f"))
    none = F.lit(None).cast("string")
    is_first = F.col("rid") == F.col("f.rid")
    plain = (
        free.join(first, by)
        .filter(is_first | (keys.person_key("value") != keys.person_key("f.value")))
        .select(
            *by, "rid", F.when(is_first, "set").otherwise("clash").alias("kind"), F.when(~is_first, F.col("f.value")).alias("current"),
            F.col("value").alias("incoming"), F.when(is_first, F.col("value")).alias("kept"), none.alias("decision"),
        )
    )
    return plain if rules is None else plain.unionByName(_ruled_events(values, rules))


# --- keys over time ---------------------------------------------------------------------------


def held_keys(rows: DataFrame, rules: DataFrame | None) -> DataFrame:
    """``label, kind, key, since, until``: keys of entities and the arrivals that see them.

    An arrival sees a key if ``since`` < rid <= ``until`` (null: for ever). ``rows`` are the members of whole entities.
    """
    values = long_values(rows.withColumnRenamed("label", "person_id"), IDENTITY, "person_id", "rid")
    changes = field_events(values, rules).filter("kind <> 'clash'").select(F.col("person_id").alias("label"), "field", F.col("rid").alias("at"), F.col("kept").alias("value"))
    # A field that its first record left unstated holds that marker until a value comes.
    marker = F.array(*[F.when(clean_ws(c) == UNSTATED, F.lit(n)) for c, n in IDENTITY.items()])
    marked = rows.filter("rid = label").select("label", F.explode(marker).alias("field")).filter("field IS NOT NULL")
    changes = changes.unionByName(marked.select("label", "field", F.col("label").alias("at"), F.lit(UNSTATED).alias("value")))
    after = Window.partitionBy("label", "kind").orderBy("at")
    upto = after.rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(F.col("field") == IDENTITY["email"], "email").when(F.col("field") == IDENTITY["telephone"], "tel").otherwise("nom")
    # Both halves of a name may change at one arrival: its last word counts.
    part = lambda n: F.max(F.when(F.col("field") == IDENTITY[n], F.col("value"))).alias(n)
    steps = changes.withColumn("kind", kind).groupBy("label", "kind", "at").agg(*map(part, IDENTITY))
    now = lambda n: F.coalesce(F.last(n, ignorenulls=True).over(upto), F.lit("")).alias(n)
    states = steps.select("label", "kind", "at", *map(now, IDENTITY), F.lead("at").over(after).alias("until"))
    key = (
        F.when(F.col("kind") == "email", keys.person_key("email"))
        .when(F.col("kind") == "tel", keys.phone_digits("telephone"))
        .otherwise(keys.full_name_key("nom", "prenom"))
    )
    return states.select("label", "kind", key.alias("key"), F.col("at").alias("since"), "until").filter("key <> ''")


def _worth_asking(held: DataFrame) -> DataFrame:
    """Without holders that every arrival passes over, because an older entity held the key no later."""
    lasting = held.filter("until IS NULL").groupBy("kind", "key").agg(
        F.min(F.struct("since", "label")).alias("f")
    )
    later = (F.col("label") > F.col("f.label")) & (F.col("since") >= F.col("f.since"))
    return held.join(lasting, ["kind", "key"], "left").filter(F.col("f").isNull() | ~later).drop("f")


# --- components -------------------------------------------------------------------------------


def _half_names(base: DataFrame) -> DataFrame:
    """``rid, kind, key``: halves of names whose other half a later record may bring.

    An entity takes the halves of its name from different records only if the first of them lacks the other half.
    """
    half = lambda kind, own, other: F.when(
        (clean_ws(own) != "") & clean_ws(other).isin("", UNSTATED), F.struct(F.lit(kind).alias("kind"), keys.person_key(own).alias("key"))
    )
    halves = F.array(half("head", "nom", "prenom"), half("tail", "prenom", "nom"))
    return base.select("rid", F.explode(halves).alias("k")).filter("k IS NOT NULL").select("rid", "k.*")


def _components(base: DataFrame) -> DataFrame:
    """``rid, component`` of the records that may meet others, over every key an entity of theirs may come to hold."""
    asked = base.select("rid", F.explode("k").alias("k")).select("rid", "k.*")
    halves = cut_lineage(_half_names(base).distinct())
    ties = asked.unionByName(halves)
    if not halves.isEmpty():
        # A whole name meets each half that it begins or ends with.
        words = F.split("key", " ")
        cuts = F.sequence(F.lit(0), F.size("words"))
        part = lambda kind, start, size: F.struct(F.lit(kind).alias("kind"), F.array_join(F.slice("words", start, size), " ").alias("key"))
        either = lambda n: F.array(part("head", F.lit(1), n), part("tail", n + 1, F.size("words") - n))
        names = asked.filter("kind = 'nom'").select("rid", words.alias("words"))
        cut = names.select("rid", F.explode(F.flatten(F.transform(cuts, either))).alias("k")).select("rid", "k.*")
        ties = ties.unionByName(cut.join(halves.select("kind", "key").distinct(), ["kind", "key"], "left_semi"))
    ties = cut_lineage(ties.filter("rid IS NOT NULL"))
    first = ties.groupBy("kind", "key").agg(F.min("rid").alias("first"))
    edges = ties.join(first, ["kind", "key"]).select(F.col("rid").cast("bigint").alias("u"), F.col("first").cast("bigint").alias("v"))
    return cut_lineage(connected_components(edges).select(F.col("node").alias("rid"), "component"))


_STATED = {c: f"{c}_stated" for c in IDENTITY}


def _to_walk(records: DataFrame) -> DataFrame:
    """Records with the keys of their fields and what each field holds: 0 nothing, 1 the marker, 2 a value."""
    stated = lambda c: F.when(clean_ws(c) == "", 0).when(clean_ws(c) == UNSTATED, 1).otherwise(2)
    key = lambda c: keys.phone_digits(c) if c == "telephone" else keys.person_key(c)
    return records.select("component", "rid", "pinned", *[key(c).alias(c) for c in IDENTITY], *[stated(c).alias(s) for c, s in _STATED.items()])


def _walk(records: Iterable[tuple]) -> Iterator[tuple]:
    """(rid, label) of one component's records, which come in the order of ``_to_walk``'s columns, by rid.

    Entities hold a key as long as no other one takes its place; the oldest holder of a key is at the top of its heap.
    """
    holders: dict[tuple, list] = defaultdict(list)
    fields: dict[int, list] = {}  # what email, phone, name and first name hold, and their keys
    held: dict[tuple, str] = {}

    def keys_of(mail: str, tel: str, nom: str, prenom: str) -> tuple:
        return mail, tel, " ".join(x for x in (nom, prenom) if x)

    for rid, same in groupby(records, lambda r: r[1]):
        rows = list(same)
        label = rid
        for row in rows:
            if row[2]:
                continue
            for kind, key in enumerate(keys_of(*row[3:7])):
                heap = holders.get((kind, key)) if key else None
                while heap and held[heap[0], kind] != key:
                    heapq.heappop(heap)
                if heap:
                    label = min(label, heap[0])
        state = fields.setdefault(label, [[0, ""] for _ in IDENTITY])
        for row in rows:
            for i, (key, stated) in enumerate(zip(row[3:7], row[7:11])):
                # A marker is held only where the record that opened the entity has it.
                if stated > state[i][0] and (stated == 2 or label == rid):
                    state[i] = [stated, key]
        for kind, key in enumerate(keys_of(*[key for _, key in state])):
            if held.get((label, kind)) != key:
                held[label, kind] = key
                if key:
                    heapq.heappush(holders[kind, key], label)
        for _ in rows:
            yield rid, label


def _walked(records: DataFrame) -> DataFrame:
    """``rid, label`` of the records of whole components (rid, component and fields), each walked in one task."""
    shape = StructType([StructField("rid", LongType()), StructField("label", LongType())])

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for frame in frames for r in frame.itertuples(index=False, name=None))
        done = []
        for _, members in groupby(rows, lambda r: r[0]):
            for found in _walk(members):
                done.append(found)
                if len(done) == CHUNK:
                    yield pd.DataFrame(done, columns=shape.names)
                    done = []
        yield pd.DataFrame(done, columns=shape.names, dtype="int64")

    placed = _to_walk(records).repartition("component").sortWithinPartitions("component", "rid")
    rid = records.schema["rid"].dataType
    return placed.mapInPandas(walk, shape).select(*[F.col(c).cast(rid).alias(c) for c in shape.names])


# --- rounds -----------------------------------------------------------------------------------


@dataclass
class Resolved:
    """``labels`` (rid, label: the rid of the record that opened the entity), and the records looked at in each round."""

    labels: DataFrame
    looked_at: list[int] = field(default_factory=list)


class _Versions:
    """A written table of which some keys' rows are replaced; only replaced rows are written again."""

    def __init__(self, table: DataFrame, key: str) -> None:
        self.table, self.key = table, key
        self.replaced = table.select(key).limit(0)
        self.rows = table.limit(0)

    def replace(self, replaced: DataFrame, rows: DataFrame) -> None:
        self.rows = cut_lineage(self.rows.join(replaced, self.key, "left_anti").unionByName(rows.select(*self.rows.columns)))
        self.replaced = cut_lineage(self.replaced.unionByName(replaced).distinct())

    def now(self, of: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
        """The rows as they are now, only those that ``of`` names ``on`` some columns if it is given."""
        pick = (lambda df: df) if of is None else (lambda df: df.join(of, on, "left_semi"))
        return pick(self.table).join(self.replaced, self.key, "left_anti").unionByName(pick(self.rows))


def resolve(records: DataFrame, rules: DataFrame | None = None, split_rows: int = 100_000) -> Resolved:
    """The entity of each record; records with ``pinned`` true (stored people) always open their own.

    Without rules, components of at most ``split_rows`` records are walked; all else goes through rounds.
    """
    pinned = F.col("pinned") if "pinned" in records.columns else F.lit(False)
    base = cut_lineage(records.select("rid", *IDENTITY, pinned.alias("pinned"), row_keys().alias("k")))
    if rules is not None:
        out = _rounds(base, cut_lineage(rules), split_rows)
        out.labels = cut_lineage(out.labels)
        return out
    member = _components(base)
    apart = base.join(member, "rid", "left_anti").select("rid", F.col("rid").alias("label"))
    sizes = base.join(member, "rid").groupBy("component").count()
    wide = cut_lineage(sizes.filter(F.col("count") > split_rows).select("component"))
    if wide.isEmpty():
        out = Resolved(_walked(base.join(member, "rid")))
    else:
        out = _rounds(cut_lineage(base.join(member.join(wide, "component", "left_semi"), "rid", "left_semi")), None, split_rows)
        out.labels = out.labels.unionByName(_walked(base.join(member.join(wide, "component", "left_anti"), "rid")))
    out.labels = cut_lineage(out.labels.unionByName(apart))
    return out


def _rounds(base: DataFrame, rules: DataFrame | None, split_rows: int) -> Resolved:
    """The entity of each record (rid, fields, pinned, keys ``k``), reached in rounds."""
    asked = cut_lineage(base.filter("not pinned").select("rid", F.explode("k").alias("k")).select("rid", "k.*"))
    base = base.drop("k")
    earliest = (
        base.filter("pinned").select("rid", F.explode(row_keys()).alias("k")).select("rid", "k.*")
        .unionByName(asked).groupBy("kind", "key").agg(F.min("rid").alias("first"))
    )
    guess = asked.join(earliest, ["kind", "key"]).groupBy("rid").agg(F.min("first").alias("guess"))
    start = base.select("rid").join(guess, "rid", "left").select("rid", F.coalesce("guess", "rid").alias("label"))
    labels = _Versions(cut_lineage(start), "rid")
    held = _Versions(cut_lineage(held_keys(base.join(labels.table, "rid"), rules)), "label")
    crowded = cut_lineage(hot_groups(asked, ["kind", "key"], split_rows))
    out, todo = Resolved(labels.table), asked
    while True:
        out.looked_at.append(todo.select("rid").distinct().count())
        wanted = todo.select("kind", "key").distinct()
        left, right = split_sides(todo, _worth_asking(held.now(wanted, ["kind", "key"])), crowded, ["kind", "key"], "rid")
        seen = (F.col("since") < F.col("rid")) & (F.col("until").isNull() | (F.col("rid") <= F.col("until")))
        found = left.join(right, ["kind", "key", "_salt"]).filter(seen).groupBy("rid").agg(F.min("label").alias("found"))
        rows = todo.select("rid").distinct()
        moved = cut_lineage(
            labels.now(rows, ["rid"]).join(found, "rid", "left")
            .select("rid", F.col("label").alias("old"), F.coalesce("found", "rid").alias("label"))
            .filter("old <> label")
        )
        if moved.isEmpty():
            break
        touched = cut_lineage(moved.select("label").unionByName(moved.select(F.col("old").alias("label"))).distinct())
        before = cut_lineage(held.now(touched, ["label"]))
        labels.replace(moved.select("rid"), moved.select("rid", "label"))
        members = labels.now(touched, ["label"]).join(base, "rid")
        after = cut_lineage(held_keys(members, rules))
        held.replace(touched, after)
        changed = after.exceptAll(before).unionByName(before.exceptAll(after)).select("kind", "key").distinct()
        again = asked.join(changed, ["kind", "key"], "left_semi").select("rid").distinct()
        todo = cut_lineage(asked.join(again, "rid", "left_semi"))
    out.labels = labels.now()
    return out
