"""Maintained results equal full evaluation, for random tables, random changes and many transforms, batch after batch."""

import random
from decimal import Decimal as D

import pytest

from sluice.operators import relational as R
from sluice.plans import affect
from sluice.plans import stages as S
from sluice.streaming.store import same_keys

A, B = "id long, g long, v decimal(6,2), t string, u string", "k long, g long, w string"

LOOKUP = {"$lookup": {"from": "B", "localField": "g", "foreignField": "g", "as": "m"}}
PLANS = {
    "project": ([{"$project": {"id": 1, "t": 1}}], ["id"]),
    "match": ([{"$match": {"t": "a"}}, {"$unset": "u"}], ["id"]),
    "moving identity": ([{"$project": {"id": 1, "g": 1}}, {"$rename": {"id": "x"}}], ["x", "g"]),
    "group": ([{"$group": {"_id": "$g", "s": {"$sum": "$v"}, "n": {"$count": "$v"}, "lo": {"$min": "$v"}, "m": {"$avg": "$v"}}}], ["g"]),
    "group renamed": ([{"$rename": {"g": "z"}}, {"$match": {"t": "a"}}, {"$group": {"_id": ["$z", "$t"], "s": {"$max": "$v"}}}], ["z", "t"]),
    "group added": ([{"$addFields": {"z": "$t"}}, {"$group": {"_id": "$z", "s": {"$sum": "$v"}}}], ["z"]),
    "having": ([{"$group": {"_id": "$g", "n": {"$count": "$id"}}}, {"$match": {"n": 2}}], ["g"]),
    "distinct": ([{"$group": {"_id": ["$g", "$t"]}}], ["g", "t"]),
    "set": ([{"$group": {"_id": "$g", "s": {"$addToSet": "$t"}}}], ["g"]),
    "twice": ([{"$group": {"_id": ["$g", "$t"]}}, {"$group": {"_id": "$g", "n": {"$count": "$t"}}}], ["g"]),
    "lookup": ([LOOKUP, {"$unset": "u"}], ["id"]),
    "lookup dropped": ([LOOKUP, {"$project": {"id": 1, "t": 1}}], ["id"]),
    "unwind": ([LOOKUP, {"$unwind": "m"}, {"$project": {"id": 1, "k": 1, "w": 1}}], ["id", "k"]),
    "unwind group": ([LOOKUP, {"$unwind": "m"}, {"$group": {"_id": "$w", "s": {"$sum": "$v"}}}], ["w"]),
    "renamed lookup": ([{"$rename": {"g": "h"}}, {"$lookup": {"from": "B", "localField": "h", "foreignField": "g", "as": "m"}}, {"$match": {"t": "a"}}], ["id"]),
    "union": ([{"$rename": {"id": "k"}}, {"$project": {"k": 1, "g": 1}}, {"$unionWith": "B"}, {"$project": {"k": 1, "g": 1}}], ["k"]),
    "union group": ([{"$unionWith": "B"}, {"$group": {"_id": "$g", "n": {"$count": "$k"}, "s": {"$sum": "$v"}}}], ["g"]),
}


def random_rows(rng, ids, kind):
    if kind == "A":
        return {i: (i, rng.choice([1, 2, 3, None]), rng.choice([None, D("1.50"), D("2.00"), D("-1.00")]), rng.choice(["a", "b", None]), rng.choice(["p", "q"])) for i in ids}
    return {100 + i: (100 + i, rng.choice([1, 2, 3, 4, None]), rng.choice(["x", "y", None])) for i in ids}


def changed(rng, rows, kind):
    out = dict(rows)
    for key in rng.sample(sorted(rows), k=min(3, len(rows))):
        if rng.random() < 0.4:
            del out[key]
        else:
            out[key] = (key, *random_rows(rng, [key - (100 if kind == "B" else 0)], kind)[key][1:])
    new = [i for i in range(1, 15) if (i if kind == "A" else 100 + i) not in rows]
    return out | random_rows(rng, rng.sample(new, k=min(2, len(new))), kind)


@pytest.mark.parametrize("name", PLANS)
def test_incremental_equals_full(spark, name):
    steps, identity = PLANS[name]
    stages, rng = S.parse(steps), random.Random(name)
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema).coalesce(1)
    a, b = random_rows(rng, range(1, 9), "A"), random_rows(rng, range(1, 5), "B")
    derived = None
    for batch in range(3):
        a2 = changed(rng, a, "A") if batch != 1 else a
        b2 = changed(rng, b, "B") if batch != 2 else b
        old, new = {(None, "A"): frame(a.values(), A), (None, "b"): frame(b.values(), B)}, {(None, "A"): frame(a2.values(), A), (None, "b"): frame(b2.values(), B)}
        delta = {}
        for table, key, was, now, schema in (("A", "id", a, a2, A), ("B", "k", b, b2, B)):
            gone, come = [was[k] for k in was if now.get(k) != was[k]], [now[k] for k in now if was.get(k) != now[k]]
            if gone or come:
                delta[None, table] = affect.Change(frame(gone, schema), frame(come, schema), (key,))
        tables = affect.Tables(old, new, delta)
        if derived is None:
            derived = R.run(old[None, "A"], stages, tables.old)
        hit = affect.affected(stages, (None, "A"), tables, identity)
        if hit is not None:
            rows = affect.evaluate_for(hit, stages, (None, "A"), tables.new, identity)
            derived = derived.alias("a").join(hit.alias("b"), same_keys(identity, "a", "b"), "left_anti").unionByName(rows)
        full = R.run(new[None, "A"], stages, tables.new)
        got = derived.select(*full.columns).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, full.collect()))
        derived, a, b = frame([tuple(r) for r in got], full.schema), a2, b2


def test_unused_fields_touch_nothing(spark):
    stages = S.parse([{"$group": {"_id": "$g", "s": {"$sum": "$v"}}}])
    row = lambda u: spark.createDataFrame([(1, 1, D("1.00"), "a", u)], A)
    tables = affect.Tables({(None, "A"): row("p")}, {(None, "A"): row("q")}, {(None, "A"): affect.Change(row("p"), row("q"), ("id",))})
    assert affect.affected(stages, (None, "a"), tables, ["g"]).count() == 0


def test_identities_filter_before_the_group(spark):
    stages = S.parse([{"$group": {"_id": "$g", "s": {"$sum": "$v"}}}])
    base = spark.createDataFrame([(i, i % 3, D("1.00"), "a", "u") for i in range(9)], A)
    out = affect.evaluate_for(spark.createDataFrame([(1,)], "g long"), stages, (None, "A"), lambda s, t: base, ["g"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(1, D("3.00"))] and plan.index("Aggregate") < plan.index("LeftSemi")
