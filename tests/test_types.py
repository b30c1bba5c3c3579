import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sluice.control import health
from sluice.functions import types as K
from sluice.plans import stages as S

C = K.ColumnShape


@pytest.mark.parametrize("p,s,kind", [(18, 0, "long"), (19, 0, "decimal"), (34, 10, "decimal"), (35, 0, "unsafe"), (38, 10, "unsafe"), (None, None, "unsafe"), (10, -2, "unsafe"), (3, 5, "unsafe"), (0, 0, "unsafe"), (12, 2, "decimal"), (10, None, "long")])
def test_number_class(p, s, kind):
    assert K.number_class(p, s) == kind


@pytest.mark.parametrize("shape,size,yes", [(C("a", "BLOB"), None, False), (C("a", "CLOB"), None, False), (C("a", "RAW"), 2000, True), (C("a", "RAW"), 2001, False), (C("a", "TIMESTAMP(6) WITH TIME ZONE"), None, True), (C("a", "TIMESTAMP(6)"), None, True), (C("a", "VARCHAR2"), None, True), (C("a", "BOOLEAN"), None, False)])
def test_supported(shape, size, yes):
    assert K.supported(shape, size) is yes


def test_zones(spark):
    assert K.zone_of("Europe/Berlin", "UTC") == "Europe/Berlin"
    assert K.zone_of("nonsense", "+09:00") == "+09:00"
    for bad in ((None, None), ("", "Mars/Base"), (None, "+25:00")):
        with pytest.raises(K.MappingError):
            K.zone_of(*bad)
    at = lambda text, zone: spark.sql(f"SELECT TIMESTAMP_NTZ '{text}' AS t").select(K.to_utc(F.col("t"), zone).cast("string")).first()[0]
    assert at("2024-01-15 10:30:00", "America/New_York") == "2024-01-15 15:30:00"
    assert at("2024-01-15 10:30:00", "+09:00") == "2024-01-15 01:30:00"
    for odd in ("2024-03-10 02:30:00", "2024-11-03 01:30:00"):  # skipped, and twice
        with pytest.raises(PySparkException):
            at(odd, "America/New_York")


def test_mapping(spark):
    df = spark.createDataFrame([(1, D("10.00"), D("0.0000001"))], "a long, b decimal(12,2), c decimal(38,10)")
    shapes = [C("a", "NUMBER", 10, 0), C("b", "NUMBER", 12, 2), C("c", "NUMBER", 38, 10)]
    with pytest.raises(K.MappingError, match="c"):
        K.mapped(df, {}, shapes)
    assert K.mapped(df, {"c": "string", "b": "string"}, shapes).first() == (1, "10.00", "0.0000001000")
    assert K.mapped(df, {"c": "omit"}, shapes).columns == ["a", "b"]
    for bad in ({"zz": "omit"}, {"a": "number"}):
        with pytest.raises(K.MappingError):
            K.mapped(df, bad, shapes[:2])
    assert df.select(K.truncated(F.lit("1.239"), 5, 2), K.truncated(F.lit("-1.999"), 5, 0)).first() == (D("1.23"), D("-1"))


def test_times_to_the_millisecond(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00.123999' AS t")
    assert K.for_target(df).first()[0] == dt.datetime(2024, 1, 1, 0, 0, 0, 123000)


def test_derived_shapes():
    primary = [C("A", "NUMBER", 10, 0), C("B", "NUMBER", 12, 2), C("T", "VARCHAR2")]
    infer = lambda *s: {c.name: (c.data_type, c.precision, c.scale) for c in K.derived_shapes(S.parse(list(s)), primary, {"O": [C("X", "NUMBER", 5, 1)]})}
    assert infer({"$group": {"_id": "$A", "m": {"$avg": "$B"}, "n": {"$count": "$B"}, "t": {"$sum": "$B"}}}) == {"A": ("NUMBER", 10, 0), "m": ("NUMBER", 34, 10), "n": ("NUMBER", 18, 0), "t": ("NUMBER", 12, 2)}
    assert infer({"$rename": {"B": "Z"}}, {"$project": {"Z": 1}}) == {"Z": ("NUMBER", 12, 2)}
    assert infer({"$lookup": {"from": "o", "localField": "A", "foreignField": "X", "as": "j"}})["j"][0] == "JSON"
    assert infer({"$lookup": {"from": "o", "localField": "A", "foreignField": "X", "as": "j"}}, {"$unwind": "j"})["X"] == ("NUMBER", 5, 1)
    assert infer({"$addFields": {"c": "USD", "d": "$T", "e": "$zz"}}, {"$project": {"c": 1, "d": 1, "e": 1}}) == {"c": ("VARCHAR2", None, None), "d": ("VARCHAR2", None, None), "e": ("NUMBER", None, None)}


def test_health():
    assert [health.sync_health(b) for b in ({}, {"lag": 2, "applied": 1}, {"applied": 1}, {"status": "incremental"}, {"failed": True})] == ["unknown", "lagging", "ok", "ok", "failed"]
    assert [health.delivery_health(p, q) for p, q in (({"paused": True}, 1), ({}, 1), ({"delivery": "delivered"}, 0), ({"delivery": "pending"}, 0), ({}, 0))] == ["paused", "unhealthy", "ok", "pending", "unknown"]
    assert [health.pressure(n) for n in (0, 1, 99, 100, 1000, 10_000)] == [5, 30, 30, 60, 85, 90]
    cap = health.capacity({"bases": {"A": {"lag": 150}}, "pipelines": {}})
    assert (cap.limiting, cap.rows_per_second) == ("source", 40_000.0)
    assert health.capacity({}).limiting == "store" and health.capacity({}, saturated=("target",)).rows_per_second == 0
    assert health.capacity({}, disk_free=5).rows_per_second == 0
    text = health.metrics({"bases": {'a"b': {"lag": 1}}, "pipelines": {"p": {"paused": True}}}, disk_free=1 << 40)
    assert text.count("# TYPE") == 11 and 'sluice_sync_lag{table="a\\"b"} 1' in text and 'sluice_pipeline_paused{pipeline="p"} 1' in text


@pytest.mark.parametrize("kind,columns,impact", [("drop_table", [], "blocking"), ("drop_column", ["a"], "blocking"), ("alter_column", ["A"], "blocking"), ("drop_column", ["z"], "unaffecting"), ("add_column", ["A"], "non_blocking"), ("add_column", ["z"], "unaffecting"), ("other", ["A"], "unaffecting")])
def test_schema_impact(kind, columns, impact):
    change = {"kind": kind, "table": "t", "columns": columns}
    assert health.schema_impact(change, "T", None, {"A"}) == impact
    assert health.schema_impact(change, "U", None, {"A"}) == "unaffecting"
    assert health.schema_impact(change | {"schema": "x"}, "T", "y", {"A"}) == "unaffecting"
