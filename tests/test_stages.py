import pytest

from sluice.plans import lineage
from sluice.plans import stages as S

ACCEPTED = [
    ({"$project": {"A": 1, "B": True}}, S.Project(("A", "B"))),
    ({"$project": {"fields": ["B", "A"]}}, S.Project(("B", "A"))),
    ({"$match": {"A": None}}, S.Match("A", None)),
    ({"$match": {"A": {"$eq": "x"}}}, S.Match("A", "x")),
    ({"$set": {"A": "$B", "C": {"$literal": [1]}, "D": "x"}}, S.AddFields((("A", S.Copy("B")), ("C", S.Literal([1])), ("D", S.Literal("x"))))),
    ({"$unset": "A"}, S.Unset(("A",))),
    ({"$unset": ["A", "B"]}, S.Unset(("A", "B"))),
    ({"$rename": {"A": "B"}}, S.Rename((("A", "B"),))),
    ({"$lookup": {"from": "T", "localField": "a", "foreignField": "b", "as": "c", "fromSchema": " "}}, S.Lookup("T", None, "a", "b", "c")),
    ({"$unwind": "$x"}, S.Unwind("x")),
    ({"$unwind": {"path": "x"}}, S.Unwind("x")),
    ({"$unionWith": "T"}, S.Union("T", None)),
    ({"$unionWith": {"from": "T", "fromSchema": "s"}}, S.Union("T", "s")),
    ({"$group": {"_id": "$A"}}, S.Group(("A",), ())),
    ({"$group": {"_id": ["$A", "B"], "n": {"$count": "$C"}}}, S.Group(("A", "B"), (S.Aggregate("n", "count", "C"),))),
    ({"$group": {"_id": {"A": "$A"}, "s": {"$addToSet": "$C"}}}, S.Group(("A",), (S.Aggregate("s", "add_to_set", "C"),))),
]


@pytest.mark.parametrize("step,stage", ACCEPTED)
def test_accepted(step, stage):
    assert S.parse([step]) == (stage,)


REJECTED = [
    {"$project": {}}, {"$project": {"A": 0}}, {"$project": {"A": False}}, {"$project": {"A": "$B"}}, {"$project": {"$x": 1}}, {"$project": {"A": {"$add": [1, 2]}}}, {"$project": {"fields": []}},
    {"$match": {}}, {"$match": {"A": 1, "B": 2}}, {"$match": {"$or": []}}, {"$match": {"A": {"$gt": 1}}}, {"$match": {"field": "A", "eq": 1}}, {"$match": []},
    {"$addFields": {}}, {"$addFields": {"A": {"$concat": []}}}, {"$addFields": {"$A": 1}}, {"$addFields": {"fields": []}}, {"$addFields": {"A": "$"}},
    {"$unset": []}, {"$unset": [1]}, {"$unset": ""}, {"$unset": {"fields": ["A"]}}, {"$rename": {}}, {"$rename": {"A": 1}}, {"$rename": {"A": " "}}, {"$rename": {"fields": []}},
    {"$lookup": {"from": "T"}}, {"$lookup": {"from": "T", "localField": "a", "foreignField": "b", "as": "c", "pipeline": []}}, {"$lookup": {"from": "T", "localField": "a", "foreignField": "b", "as": "c", "let": {}}}, {"$lookup": {"from": "T", "localField": "a", "foreignField": "b", "as": "c", "asOf": 1}},
    {"$unwind": ""}, {"$unwind": "$"}, {"$unwind": {"path": "x", "preserveNullAndEmptyArrays": True}}, {"$unwind": {"path": "x", "includeArrayIndex": "i"}}, {"$unwind": 1},
    {"$unionWith": ""}, {"$unionWith": {"coll": "A", "from": "B"}}, {"$unionWith": {"coll": "A", "pipeline": []}}, {"$unionWith": {}},
    {"$group": {}}, {"$group": {"_id": None}}, {"$group": {"_id": {"B": "$A"}}}, {"$group": {"_id": "$a.b"}}, {"$group": {"_id": []}}, {"$group": {"_id": "$A", "n": {"$sum": 1}}}, {"$group": {"_id": "$A", "n": {"$count": {}}}}, {"$group": {"_id": "$A", "n": {"$push": "$B"}}}, {"$group": {"_id": "$A", "n": {"$sum": "$B", "$min": "$B"}}}, {"$group": {"_id": "$A", "s": {"$addToSet": "$B"}, "n": {"$sum": "$B"}}}, {"$group": {"keys": ["A"]}},
]


@pytest.mark.parametrize("step", REJECTED, ids=str)
def test_rejected(step):
    with pytest.raises(S.InvalidStage, match="step 1"):
        S.parse([step])


@pytest.mark.parametrize("name", ["$sort", "$limit", "$facet", "$count", "project", "filter", "groupBy", "select", "where", "join", "$sortByCount"])
def test_unknown_stages(name):
    with pytest.raises(S.UnsupportedStage):
        S.parse([{"$unset": "a"}, {name: {}}])


@pytest.mark.parametrize("name", ["script", "function", "$function"])
def test_scripts(name):
    with pytest.raises(S.FreeFormScript):
        S.parse([{name: "return 1"}])


@pytest.mark.parametrize("steps", [[], None, [1], [{"$unset": "a", "$match": {"b": 1}}], [{"$group": {"_id": "$A"}}, {"$group": {"_id": "$A"}}], [{"$unwind": "x"}, {"$group": {"_id": "$A"}}], [{"$unionWith": "T"}, {"$group": {"_id": "$A", "s": {"$addToSet": "$B"}}}]])
def test_composition(steps):
    with pytest.raises(S.InvalidStage):
        S.parse(steps)


def test_references():
    stages = S.parse([{"$lookup": {"from": "B", "localField": "a", "foreignField": "b", "as": "c"}}, {"$unionWith": {"coll": "C", "fromSchema": "s"}}, {"$unionWith": "C"}])
    assert S.references(stages, "d") == [("d", "B"), ("s", "C"), ("d", "C")]


COLUMNS = ["A", "B", "C", "D"]


@pytest.mark.parametrize(
    "steps,used",
    [
        ([{"$project": {"A": 1, "B": 1}}], "AB"),
        ([{"$group": {"_id": "$A", "t": {"$sum": "$B"}}}], "AB"),
        ([{"$match": {"C": 1}}, {"$project": {"A": 1}}], "AC"),
        ([{"$unset": ["D"]}], "ABC"),
        ([{"$rename": {"A": "X"}}, {"$project": {"X": 1}}], "A"),
        ([{"$addFields": {"X": "$D"}}, {"$project": {"X": 1}}], "D"),
        ([{"$addFields": {"A": 1}}, {"$project": {"A": 1}}], ""),
        ([{"$addFields": {"X": "$A", "Y": "$X"}}, {"$project": {"Y": 1}}], "A"),
        ([{"$lookup": {"from": "T", "localField": "B", "foreignField": "k", "as": "x"}}, {"$project": {"A": 1, "x": 1}}], "AB"),
        ([{"$lookup": {"from": "T", "localField": "B", "foreignField": "k", "as": "x"}}, {"$project": {"A": 1}}], "A"),
        ([{"$match": {"A": 1}}], "ABCD"),
    ],
)
def test_used_fields(steps, used):
    assert "".join(lineage.used_fields(S.parse(steps), COLUMNS)) == used


def test_used_secondary():
    dropped = S.parse([{"$lookup": {"from": "t", "localField": "A", "foreignField": "k", "as": "x"}}, {"$unset": "x"}])
    kept = S.parse([{"$lookup": {"from": "t", "localField": "A", "foreignField": "k", "as": "x"}}])
    flat = S.parse([{"$lookup": {"from": "t", "localField": "A", "foreignField": "k", "as": "x"}}, {"$unwind": "x"}, {"$project": {"v": 1}}])
    assert lineage.used_secondary(dropped, None, "T", ["k", "v", "w"]) == []
    assert lineage.used_secondary(kept, None, "T", ["k", "v", "w"]) == ["k", "v", "w"]
    assert lineage.used_secondary(flat, None, "T", ["k", "v", "w"]) == ["k", "v"]
