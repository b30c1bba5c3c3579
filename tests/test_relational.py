from decimal import Decimal as D

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.values import equals
from sluice.operators import relational as R
from sluice.plans import stages as S


@pytest.fixture(scope="module")
def bases(spark):
    customers = spark.createDataFrame([(1, "Alice", 1), (2, "Bob", 0), (3, "Carol", 1)], "ID long, NAME string, ACTIVE long")
    orders = spark.createDataFrame([(100, 1, D("42.50"), "a"), (101, 1, D("10.00"), "a"), (200, 2, D("5.00"), "b")], "ORDER_ID long, CUSTOMER_ID long, AMOUNT decimal(12,2), ADDRESS string")
    west = spark.createDataFrame([(10, "Zoe"), (11, "Wade")], "ID long, NAME string")
    return {"CUSTOMERS": customers, "ORDERS": orders, "WEST": west}


def run(bases, table, *steps):
    return R.run(bases[table], S.parse(list(steps)), lambda schema, t: bases[t.upper()])


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns[:1])).collect()]


def test_group_sum(bases):
    assert rows(run(bases, "ORDERS", {"$group": {"_id": "$CUSTOMER_ID", "T": {"$sum": "$AMOUNT"}}})) == [(1, D("52.50")), (2, D("5.00"))]


def test_accumulators(spark):
    df = spark.createDataFrame([(1, D("10.00")), (1, D("30.00")), (1, None), (2, None)], "K long, V decimal(12,2)")
    out = R.group(df, S.parse([{"$group": {"_id": "$K", "n": {"$count": "$V"}, "lo": {"$min": "$V"}, "hi": {"$max": "$V"}, "mean": {"$avg": "$V"}, "t": {"$sum": "$V"}}}])[0])
    assert rows(out) == [(1, 2, D("10.00"), D("30.00"), D("20.000000"), D("40.00")), (2, 0, None, None, None, D("0.00"))]


@pytest.mark.parametrize("values,mean", [(("20.00", "30.00", "50.00"), "33.333333"), (("0.10", "0.20"), "0.150000"), (("-0.01", "0.00", "0.00"), "-0.003333")])
def test_average(spark, values, mean):
    df = spark.createDataFrame([(1, D(v)) for v in values], "K long, V decimal(12,2)")
    assert rows(R.group(df, S.parse([{"$group": {"_id": "$K", "m": {"$avg": "$V"}}}])[0])) == [(1, D(mean))]


def test_group_rejects_text_and_times(spark):
    times = spark.sql("SELECT 1 AS K, current_timestamp() AS V, 'x' AS W, '1.50' AS X")
    with pytest.raises(S.InvalidStage):
        R.group(times, S.parse([{"$group": {"_id": "$K", "m": {"$max": "$V"}}}])[0])
    with pytest.raises(PySparkException):
        R.group(times, S.parse([{"$group": {"_id": "$K", "m": {"$sum": "$W"}}}])[0]).collect()
    assert rows(R.group(times, S.parse([{"$group": {"_id": "$K", "m": {"$sum": "$X"}}}])[0]))[0][1] == D("1.5")


def test_distinct_and_sets(bases, spark):
    assert rows(run(bases, "ORDERS", {"$group": {"_id": "$CUSTOMER_ID"}})) == [(1,), (2,)]
    df = spark.createDataFrame([(1, D("10")), (1, D("7")), (1, D("42.5")), (1, D("7.0")), (2, None), (None, D("1"))], "K long, V decimal(6,1)")
    out = R.group(df, S.parse([{"$group": {"_id": "$K", "s": {"$addToSet": "$V"}}}])[0])
    assert rows(out) == [(None, [D("1.0")]), (1, [D("7.0"), D("10.0"), D("42.5")]), (2, [])]


def test_lookup(bases):
    out = run(bases, "CUSTOMERS", {"$lookup": {"from": "orders", "localField": "ID", "foreignField": "CUSTOMER_ID", "as": "o"}})
    assert [(r.ID, len(r.o), [x.ORDER_ID for x in r.o]) for r in out.orderBy("ID").collect()] == [(1, 2, [100, 101]), (2, 1, [200]), (3, 0, [])]


def test_lookup_nulls_and_mixed_types(spark):
    left = spark.createDataFrame([(1, "007"), (2, None), (3, "x")], "id long, k string")
    right = spark.createDataFrame([(7, "seven"), (None, "none")], "n long, v string")
    out = R.lookup(left, S.parse([{"$lookup": {"from": "r", "localField": "k", "foreignField": "n", "as": "m"}}])[0], right)
    assert [(r.id, [x.v for x in r.m]) for r in out.orderBy("id").collect()] == [(1, ["seven"]), (2, ["none"]), (3, [])]


def test_lookup_unwind_is_one_join(bases):
    steps = [{"$lookup": {"from": "ORDERS", "localField": "ID", "foreignField": "CUSTOMER_ID", "as": "o"}}, {"$unwind": "$o"}]
    fused = run(bases, "CUSTOMERS", *steps)
    stages = S.parse(steps)
    apart = R.unwind(R.lookup(bases["CUSTOMERS"], stages[0], bases["ORDERS"]), stages[1])
    assert rows(fused, "ORDER_ID") == rows(apart.select(*fused.columns), "ORDER_ID")
    assert len(rows(fused)) == 3
    plan = fused._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Generate" not in plan


def test_unwind(spark):
    df = spark.createDataFrame([(1, [10, 20]), (2, []), (3, None)], "id long, x array<long>")
    assert rows(R.unwind(df, S.Unwind("x")), "x") == [(1, 10), (1, 20)]
    objects = df.select("id", F.lit("parent").alias("v"), F.array(F.struct(F.lit("child").alias("v"), F.lit(1).alias("w"))).alias("x"))
    assert rows(R.unwind(objects.limit(1), S.Unwind("x"))) == [(1, "child", 1)]
    with pytest.raises(S.InvalidStage):
        R.unwind(df, S.Unwind("id"))
    assert rows(R.unwind(df, S.Unwind("absent"))) == []


def test_union(bases):
    out = run(bases, "CUSTOMERS", {"$unionWith": "WEST"}, {"$project": {"ID": 1, "NAME": 1}})
    assert rows(out) == [(1, "Alice"), (2, "Bob"), (3, "Carol"), (10, "Zoe"), (11, "Wade")]


def test_field_ops(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a long, b long, c long")
    stage = lambda *s: R.run(df, S.parse(list(s)), None)
    assert stage({"$project": {"c": 1, "missing": 1, "a": 1}}).columns == ["c", "a"]
    assert stage({"$rename": {"a": "b", "b": "d"}}).first().asDict() == {"c": 3, "d": 1}
    assert stage({"$rename": {"missing": "c"}}).columns == ["a", "b", "c"]
    assert stage({"$addFields": {"x": "$missing", "y": "$a", "z": "$y"}}).first()[3:] == (None, 1, 1)
    assert stage({"$unset": ["a", "missing"]}).columns == ["b", "c"]
    assert stage({"$match": {"missing": None}}).collect() == []


def test_names_are_case_sensitive(spark):
    df = spark.createDataFrame([(1, 2)], "name long, NAME long")
    assert R.run(df, S.parse([{"$match": {"NAME": 2}}, {"$project": {"name": 1}}]), None).columns == ["name"]


EQUAL = [("1", "long", "1.00", True), ("1", "long", "+1", True), ("1", "long", "1e0", False), ("7", "string", 7, True), ("'007'", "string", 7, True), ("'7.0'", "string", "7", True), ("'x'", "string", "x", True), ("'x'", "string", 1, False), ("NULL", "string", None, True), ("NULL", "long", 1, False), ("1.50", "decimal(5,2)", 1.5, True), ("1.50", "decimal(5,2)", "1.5000", True), ("1.50", "decimal(5,2)", "1.5001", False), ("true", "boolean", True, True), ("true", "boolean", 1, False), ("1", "long", True, False), ("1.5", "double", "1.50", True), ("' 5 '", "string", 5, True), ("'.5'", "string", 0.5, True), ("'5.'", "string", 5, True)]


@pytest.mark.parametrize("value,kind,literal,same", EQUAL)
def test_equality(spark, value, kind, literal, same):
    df = spark.sql(f"SELECT CAST({value} AS {kind}) AS v")
    assert df.select(equals(F.col("v"), T._parse_datatype_string(kind), literal)).first()[0] is same
