"""One query for each operator of the engine over the test tables, and the SQL that it must equal.

Money is decimal(12,2) in every base. Decimals, arrays and times are returned as text, so that both engines write them alike.
The change log of the incremental queries follows from orders by key: snapshot k % 10 <> 0; inserted k % 10 = 0; k % 10 = 1
moves to another customer, = 3 costs 10.00 more, = 4 changes only a field that no result uses; = 2 is deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.control import health
from sluice.control.engine import Engine, Options
from sluice.functions import types as K
from sluice.operators import relational as R
from sluice.plans import affect, lineage
from sluice.plans import stages as S
from sluice.sources import changes
from sluice.sources.engine import CatalogSource, ParquetSource
from sluice.sources.target import ParquetTarget
from sluice.streaming.store import Store, state_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MONEY = "decimal(12,2)"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.caseSensitive", "true")
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.withColumns({c: F.col(c).cast(MONEY) for c in ("o_totalprice", "c_acctbal", "l_extendedprice", "s_acctbal") if c in df.columns})


def bases(spark: SparkSession, sf_dir: str) -> R.Bases:
    return lambda schema, table: read(spark, sf_dir, table.lower())


def plan(spark: SparkSession, sf_dir: str, table: str, *steps: dict) -> DataFrame:
    return R.run(read(spark, sf_dir, table), S.parse(list(steps)), bases(spark, sf_dir))


def text(df: DataFrame, *columns: str, kind: str = "decimal(20,2)") -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind).cast("string") for c in columns})


# stages


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def project_customers(spark, sf_dir):
    return plan(spark, sf_dir, "customer", {"$project": {"c_custkey": 1, "c_name": True, "c_mktsegment": 1}})


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def match_segment(spark, sf_dir):
    return plan(spark, sf_dir, "customer", {"$match": {"c_mktsegment": "BUILDING"}}, {"$project": {"fields": ["c_custkey", "c_mktsegment"]}})


@query("SELECT o_orderkey FROM orders WHERE NULLIF(o_orderpriority, '1-URGENT') IS NULL")
def match_null_safe(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '1-URGENT')"))
    return R.run(rows, S.parse([{"$match": {"o_orderpriority": {"$eq": None}}}, {"$project": {"o_orderkey": 1}}]), bases(spark, sf_dir))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 7")
def match_numeric_literal(spark, sf_dir):
    return plan(spark, sf_dir, "customer", {"$match": {"c_nationkey": "7.00"}}, {"$project": {"c_custkey": 1, "c_nationkey": 1}})


@query("SELECT c_custkey AS id, c_name AS label, c_name AS copied, 'USD' AS currency, CAST(3 AS BIGINT) AS rank FROM customer WHERE c_nationkey = 3")
def field_ops(spark, sf_dir):
    out = plan(spark, sf_dir, "customer", {"$project": {"c_custkey": 1, "c_name": 1, "c_nationkey": 1, "c_acctbal": 1}}, {"$unset": ["c_acctbal"]}, {"$rename": {"c_custkey": "id", "c_name": "label"}}, {"$addFields": {"copied": "$label", "currency": {"$literal": "USD"}}}, {"$set": {"rank": 3}}, {"$match": {"c_nationkey": 3}}, {"$unset": "c_nationkey"})
    return out.withColumn("rank", F.col("rank").cast("long"))


LOOKUP = {"$lookup": {"from": "ORDERS", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}}


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS order_keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def lookup_orders(spark, sf_dir):
    out = plan(spark, sf_dir, "customer", LOOKUP, {"$project": {"c_custkey": 1, "orders": 1}})
    return out.select("c_custkey", F.size("orders").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("orders", lambda o: o["o_orderkey"])).cast("array<string>"), ",").alias("order_keys"))


@query("SELECT c_custkey, c_name, o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey")
def lookup_unwind(spark, sf_dir):
    out = plan(spark, sf_dir, "customer", LOOKUP, {"$unwind": "$orders"}, {"$project": {"c_custkey": 1, "c_name": 1, "o_orderkey": 1, "o_totalprice": 1}})
    return text(out, "o_totalprice", kind=MONEY)


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def lookup_chain(spark, sf_dir):
    return plan(spark, sf_dir, "customer", {"$lookup": {"from": "NATION", "localField": "c_nationkey", "foreignField": "n_nationkey", "as": "n"}}, {"$unwind": {"path": "$n"}}, {"$lookup": {"from": "REGION", "localField": "n_regionkey", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": "r"}, {"$project": {"c_custkey": 1, "n_name": 1, "r_name": 1}})


@query("SELECT n_name, CAST(count(c_custkey) AS BIGINT) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def lookup_unwind_group(spark, sf_dir):
    return plan(spark, sf_dir, "nation", {"$lookup": {"from": "CUSTOMER", "localField": "n_nationkey", "foreignField": "c_nationkey", "as": "c"}}, {"$unwind": "$c"}, {"$group": {"_id": "$n_name", "customers": {"$count": "$c_custkey"}}})


@query("SELECT s_suppkey, CAST(count(c_custkey) AS BIGINT) AS customers FROM (SELECT s_suppkey, NULLIF(s_nationkey, 7) AS n FROM supplier) LEFT JOIN (SELECT c_custkey, NULLIF(c_nationkey, 7) AS m FROM customer) ON n IS NOT DISTINCT FROM m GROUP BY s_suppkey")
def lookup_null_keys(spark, sf_dir):
    """Null keys are equal to each other."""
    left = read(spark, sf_dir, "supplier").select("s_suppkey", F.expr("nullif(s_nationkey, 7)").alias("n"))
    right = read(spark, sf_dir, "customer").select("c_custkey", F.expr("nullif(c_nationkey, 7)").alias("m"))
    out = R.run(left, S.parse([{"$lookup": {"from": "B", "localField": "n", "foreignField": "m", "as": "b"}}]), lambda s, t: right)
    return out.select("s_suppkey", F.size("b").cast("long").alias("customers"))


@query("SELECT n_nationkey, unnest(['a', 'b', 'c']) AS tag FROM nation")
def unwind_scalar(spark, sf_dir):
    return plan(spark, sf_dir, "nation", {"$project": {"n_nationkey": 1}}, {"$addFields": {"tag": {"$literal": ["a", "b", "c"]}}}, {"$unwind": "$tag"})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def union_all(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    stages = S.parse([{"$unionWith": {"coll": "URGENT"}}, {"$project": {"o_orderkey": 1, "o_custkey": 1}}])
    return R.run(rows.where("o_orderstatus = 'F'"), stages, lambda s, t: rows.where("o_orderpriority = '1-URGENT'"))


@query("SELECT s_suppkey AS k, s_name, CAST(NULL AS VARCHAR) AS c_name FROM supplier UNION ALL SELECT NULL, NULL, c_name FROM customer")
def union_ragged(spark, sf_dir):
    return plan(spark, sf_dir, "supplier", {"$rename": {"s_suppkey": "k"}}, {"$unionWith": "CUSTOMER"}, {"$project": {"fields": ["k", "s_name", "c_name"]}})


#: An average exact to six places, ties away from zero.
AVG = "CAST(CAST((({u} * 10000) // {n}) + CASE WHEN abs(({u} * 10000) % {n}) * 2 >= {n} THEN sign({u}) ELSE 0 END AS DECIMAL(32,0)) * CAST(0.000001 AS DECIMAL(6,6)) AS DECIMAL(20,6))"


@query(f"WITH g AS (SELECT o_custkey, sum(CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS HUGEINT)) AS u, count(o_totalprice) AS n, min(CAST(o_totalprice AS DECIMAL(12,2))) AS lo, max(CAST(o_totalprice AS DECIMAL(12,2))) AS hi, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS s FROM orders GROUP BY o_custkey) SELECT o_custkey, CAST(n AS BIGINT) AS n, CAST(CAST(s AS DECIMAL(20,2)) AS VARCHAR) AS total, CAST(CAST(lo AS DECIMAL(20,2)) AS VARCHAR) AS lo, CAST(CAST(hi AS DECIMAL(20,2)) AS VARCHAR) AS hi, CAST({AVG.format(u='u', n='n')} AS VARCHAR) AS mean FROM g")
def group_accumulators(spark, sf_dir):
    out = plan(spark, sf_dir, "orders", {"$group": {"_id": "$o_custkey", "n": {"$count": "$o_orderkey"}, "total": {"$sum": "$o_totalprice"}, "lo": {"$min": "$o_totalprice"}, "hi": {"$max": "$o_totalprice"}, "mean": {"$avg": "$o_totalprice"}}})
    return text(text(out, "total", "lo", "hi"), "mean", kind="decimal(20,6)")


@query("SELECT l_returnflag, l_shipmode_, CAST(count(*) AS BIGINT) AS n, CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(20,2)) AS VARCHAR) AS total FROM (SELECT *, l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY ALL")
def group_multi_key(spark, sf_dir):
    out = plan(spark, sf_dir, "lineitem", {"$rename": {"l_linestatus": "l_shipmode_"}}, {"$group": {"_id": {"l_returnflag": "$l_returnflag", "l_shipmode_": "$l_shipmode_"}, "n": {"$count": "$l_orderkey"}, "total": {"$sum": "$l_extendedprice"}}})
    return text(out, "total")


@query("SELECT p, CAST(count(v) AS BIGINT) AS n, CAST(CAST(coalesce(sum(v), 0) AS DECIMAL(20,2)) AS VARCHAR) AS total, CAST(CAST(min(v) AS DECIMAL(20,2)) AS VARCHAR) AS lo FROM (SELECT NULLIF(o_orderpriority, '1-URGENT') AS p, CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS v FROM orders) GROUP BY p")
def group_null_field(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.expr("nullif(o_orderpriority, '1-URGENT')").alias("p"), F.expr("CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_totalprice END").alias("v"))
    return text(R.run(rows, S.parse([{"$group": {"_id": "$p", "n": {"$count": "$v"}, "total": {"$sum": "$v"}, "lo": {"$min": "$v"}}}]), bases(spark, sf_dir)), "total", "lo")


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct_keys(spark, sf_dir):
    return plan(spark, sf_dir, "orders", {"$group": {"_id": ["$o_custkey", "$o_orderstatus"]}})


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def add_to_set(spark, sf_dir):
    out = plan(spark, sf_dir, "events", {"$group": {"_id": "$user_id", "kinds": {"$addToSet": "$event_type"}}})
    return out.withColumn("kinds", F.array_join("kinds", ","))


@query("SELECT o_custkey, n FROM (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey) WHERE n = 10")
def group_then_match(spark, sf_dir):
    return plan(spark, sf_dir, "orders", {"$group": {"_id": "$o_custkey", "n": {"$count": "$o_orderkey"}}}, {"$match": {"n": 10}})


@query("SELECT o_custkey, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS kinds FROM orders GROUP BY o_custkey")
def group_twice(spark, sf_dir):
    return plan(spark, sf_dir, "orders", {"$group": {"_id": ["$o_custkey", "$o_orderpriority"]}}, {"$group": {"_id": "$o_custkey", "kinds": {"$count": "$o_orderpriority"}}})


@query("SELECT * FROM (VALUES ('hi', 'NUMBER', 12, 2), ('mean', 'NUMBER', 34, 10), ('n', 'NUMBER', 18, 0), ('o_custkey', 'NUMBER', 18, 0)) t(name, data_type, precision, scale)")
def derived_schema(spark, sf_dir):
    stages = S.parse([{"$group": {"_id": "$o_custkey", "n": {"$count": "$o_orderkey"}, "hi": {"$max": "$o_totalprice"}, "mean": {"$avg": "$o_totalprice"}}}])
    shapes = K.derived_shapes(stages, list(source(spark, sf_dir).describe("orders").columns))
    return spark.createDataFrame([(c.name, c.data_type, c.precision, c.scale) for c in shapes], "name string, data_type string, precision int, scale int")


# changes

COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
#: orders after the log, as SQL.
FINAL = "(SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN o_custkey % 97 + 1 ELSE o_custkey END AS o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) + CASE WHEN o_orderkey % 10 = 3 THEN 10.00 ELSE 0 END AS o_totalprice, CASE WHEN o_orderkey % 10 = 4 THEN 'TOUCHED' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 10 <> 2)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(COLUMNS)


def log(rows: DataFrame, modulus: int = 10, first: int = 1) -> DataFrame:
    """The change log as events in any order; an earlier, overtaken image of each update is in it as well."""
    k = F.col("o_orderkey") % modulus
    moved = rows.withColumns({"o_custkey": F.when(k == 1, F.col("o_custkey") % 97 + 1).otherwise(F.col("o_custkey")), "o_totalprice": F.when(k == 3, F.col("o_totalprice") + F.lit(10).cast(MONEY)).otherwise(F.col("o_totalprice")).cast(MONEY), "o_orderpriority": F.when(k == 4, "TOUCHED").otherwise(F.col("o_orderpriority"))})
    op = F.when(k == 0, "insert").when(k == 2, "delete").when(k.isin(1, 3, 4), "update")
    last = moved.withColumn("op", op).where("op IS NOT NULL")
    early = rows.withColumn("op", op).where("op = 'update'")
    image = F.to_json(F.struct(*COLUMNS))

    def events(df: DataFrame, ssn: int) -> DataFrame:
        return df.select(F.lit("ORDERS").alias("table_name"), "op", (F.col("o_orderkey") + first).alias("position"), F.lit("r").alias("rs_id"), F.lit(ssn).cast("long").alias("ssn"), image.alias("image"))

    return events(last, 2).union(events(early, 1))


def moved(spark: SparkSession, sf_dir: str, modulus: int = 10) -> tuple[affect.Tables, DataFrame]:
    rows = orders(spark, sf_dir)
    old = rows.where(f"o_orderkey % {modulus} <> 0")
    change = changes.net_change(old, log(rows, modulus), ["o_orderkey"])
    new = changes.applied(old, change)
    fixed = {(None, t): read(spark, sf_dir, t) for t in ("customer", "nation")}
    return affect.Tables({(None, "orders"): old, **fixed}, {(None, "orders"): new, **fixed}, {(None, "orders"): change}), new


def maintained(spark: SparkSession, sf_dir: str, table: str, steps: list[dict], identity: list[str]) -> DataFrame:
    """The derived rows after the log: those of the snapshot, with only the affected identities computed anew."""
    tables, _ = moved(spark, sf_dir)
    stages = S.parse(steps)
    before = R.run(tables.old(None, table), stages, tables.old)
    hit = affect.affected(stages, (None, table), tables, identity)
    rows = affect.evaluate_for(hit, stages, (None, table), tables.new, identity)
    from sluice.streaming.store import same_keys

    return before.alias("a").join(hit.alias("b"), same_keys(identity, "a", "b"), "left_anti").unionByName(rows)


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS o_totalprice, o_orderpriority FROM {FINAL}")
def cdc_base_apply(spark, sf_dir):
    return text(moved(spark, sf_dir)[1], "o_totalprice", kind=MONEY)


@query(f"SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, CAST(CAST(sum(o_totalprice) AS DECIMAL(20,2)) AS VARCHAR) AS total, CAST(CAST(min(o_totalprice) AS DECIMAL(20,2)) AS VARCHAR) AS lo FROM {FINAL} GROUP BY o_custkey")
def inc_group(spark, sf_dir):
    return text(maintained(spark, sf_dir, "orders", [{"$group": {"_id": "$o_custkey", "n": {"$count": "$o_orderkey"}, "total": {"$sum": "$o_totalprice"}, "lo": {"$min": "$o_totalprice"}}}], ["o_custkey"]), "total", "lo")


@query(f"SELECT customer, CAST(CAST(sum(o_totalprice) AS DECIMAL(20,2)) AS VARCHAR) AS total FROM (SELECT o_custkey AS customer, o_totalprice FROM {FINAL} WHERE o_orderstatus = 'F') GROUP BY customer")
def inc_group_renamed(spark, sf_dir):
    return text(maintained(spark, sf_dir, "orders", [{"$match": {"o_orderstatus": "F"}}, {"$rename": {"o_custkey": "customer"}}, {"$group": {"_id": "$customer", "total": {"$sum": "$o_totalprice"}}}], ["customer"]), "total")


@query(f"SELECT o_custkey, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS kinds FROM {FINAL} GROUP BY o_custkey")
def inc_group_twice(spark, sf_dir):
    return maintained(spark, sf_dir, "orders", [{"$group": {"_id": ["$o_custkey", "$o_orderstatus"]}}, {"$group": {"_id": "$o_custkey", "kinds": {"$count": "$o_orderstatus"}}}], ["o_custkey"])


@query(f"SELECT DISTINCT o_custkey, o_orderstatus FROM {FINAL}")
def inc_distinct(spark, sf_dir):
    return maintained(spark, sf_dir, "orders", [{"$group": {"_id": ["$o_custkey", "$o_orderstatus"]}}], ["o_custkey", "o_orderstatus"])


@query(f"SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM {FINAL} GROUP BY o_custkey")
def inc_add_to_set(spark, sf_dir):
    out = maintained(spark, sf_dir, "orders", [{"$group": {"_id": "$o_custkey", "statuses": {"$addToSet": "$o_orderstatus"}}}], ["o_custkey"])
    return out.withColumn("statuses", F.array_join("statuses", ","))


@query(f"SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n, CAST(CAST(coalesce(sum(o_totalprice), 0) AS DECIMAL(20,2)) AS VARCHAR) AS total FROM customer LEFT JOIN {FINAL} ON o_custkey = c_custkey GROUP BY c_custkey")
def inc_lookup(spark, sf_dir):
    out = maintained(spark, sf_dir, "customer", [LOOKUP, {"$project": {"c_custkey": 1, "orders": 1}}], ["c_custkey"])
    total = F.aggregate("orders", F.lit(0).cast("decimal(20,2)"), lambda a, o: (a + o["o_totalprice"]).cast("decimal(20,2)"))
    return out.select("c_custkey", F.size("orders").cast("long").alias("n"), total.cast("string").alias("total"))


@query(f"SELECT c_name, o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS o_totalprice FROM customer JOIN {FINAL} ON o_custkey = c_custkey")
def inc_unwind(spark, sf_dir):
    return text(maintained(spark, sf_dir, "customer", [LOOKUP, {"$unwind": "$orders"}, {"$project": {"c_name": 1, "o_orderkey": 1, "o_totalprice": 1}}], ["o_orderkey"]), "o_totalprice", kind=MONEY)


@query(f"SELECT c_nationkey, CAST(CAST(sum(o_totalprice) AS DECIMAL(20,2)) AS VARCHAR) AS total FROM customer JOIN {FINAL} ON o_custkey = c_custkey GROUP BY c_nationkey")
def inc_lookup_unwind_group(spark, sf_dir):
    return text(maintained(spark, sf_dir, "customer", [LOOKUP, {"$unwind": "$orders"}, {"$group": {"_id": "$c_nationkey", "total": {"$sum": "$o_totalprice"}}}], ["c_nationkey"]), "total")


@query(f"SELECT k, source FROM (SELECT c_custkey + 100000000 AS k, 'customer' AS source FROM customer UNION ALL SELECT o_orderkey, o_orderstatus FROM {FINAL})")
def inc_union(spark, sf_dir):
    tables, _ = moved(spark, sf_dir)
    customers = tables.old(None, "customer").select((F.col("c_custkey") + 100000000).alias("o_orderkey"), F.lit("customer").alias("o_orderstatus"))
    for side in (tables.old_rows, tables.new_rows):
        side[None, "CUSTOMER"] = customers
    stages, identity = S.parse([{"$unionWith": "ORDERS"}, {"$project": {"o_orderkey": 1, "o_orderstatus": 1}}, {"$rename": {"o_orderkey": "k", "o_orderstatus": "source"}}]), ["k"]
    hit = affect.affected(stages, (None, "customer"), tables, identity)
    rows = affect.evaluate_for(hit, stages, (None, "customer"), tables.new, identity)
    return R.run(customers, stages, tables.old).join(hit, "k", "left_anti").unionByName(rows)


@query("SELECT DISTINCT o_custkey FROM (SELECT CASE WHEN o_orderkey % 1000 = 1 THEN o_custkey % 97 + 1 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 1000 IN (0, 1, 3) UNION ALL SELECT o_custkey FROM orders WHERE o_orderkey % 1000 IN (1, 2, 3))")
def affect_identities(spark, sf_dir):
    """A sparse log: few customers are recomputed, and none for the field that no total uses."""
    tables, _ = moved(spark, sf_dir, 1000)
    return affect.affected(S.parse([{"$group": {"_id": "$o_custkey", "total": {"$sum": "$o_totalprice"}}}]), (None, "orders"), tables, ["o_custkey"])


@query(f"SELECT o_custkey, o_orderstatus AS member, CAST(count(*) AS BIGINT) AS refcount FROM {FINAL} GROUP BY ALL")
def maintenance_refcounts(spark, sf_dir):
    """Counts behind the members of sets: those of the snapshot, with only the touched keys counted anew."""
    tables, new = moved(spark, sf_dir)
    stages = S.parse([{"$group": {"_id": "$o_custkey", "statuses": {"$addToSet": "$o_orderstatus"}}}])
    before = affect.refcounts(tables.old(None, "orders"), stages[0])
    hit = affect.affected(stages, (None, "orders"), tables, ["o_custkey"])
    after = affect.refcounts(affect.semi(new, hit, ["o_custkey"]), stages[0])
    return before.join(hit, "o_custkey", "left_anti").unionByName(after).withColumnRenamed("__member", "member")


@query("SELECT CAST(o_orderkey + 1 AS BIGINT) AS position, 'log:ORDERS:' || CAST(o_orderkey + 1 AS VARCHAR) || ':' || CASE WHEN o_orderkey % 10 = 0 THEN 'insert' WHEN o_orderkey % 10 = 2 THEN 'delete' ELSE 'update' END || ':' || CAST(o_orderkey AS VARCHAR) || ':r:2' AS change_id FROM orders WHERE o_orderkey % 10 IN (0, 1, 2, 3, 4) UNION ALL SELECT CAST(o_orderkey + 1 AS BIGINT), 'log:ORDERS:' || CAST(o_orderkey + 1 AS VARCHAR) || ':update:' || CAST(o_orderkey AS VARCHAR) || ':r:1' FROM orders WHERE o_orderkey % 10 IN (1, 3, 4)")
def change_ids(spark, sf_dir):
    return changes.with_ids(log(orders(spark, sf_dir)), {"ORDERS": ["o_orderkey"]}).select("position", "change_id")


@query("SELECT CAST(o_orderkey + 1 AS BIGINT) AS position FROM orders WHERE o_orderkey % 10 IN (0, 1, 2, 3, 4) AND o_orderkey + 1 >= 500 AND NOT (o_orderkey + 1 = 500)")
def resume_unapplied(spark, sf_dir):
    """An inclusive resume at position 500, whose own changes the ledger has."""
    due = changes.with_ids(log(orders(spark, sf_dir)), {"ORDERS": ["o_orderkey"]})
    ledger = due.where("position = 500").select("change_id")
    return changes.unapplied(due, ledger, 500).where("ssn = 2").select("position")


# the control plane


def source(spark: SparkSession, sf_dir: str, changes_of: DataFrame | None = None, snapshot: bool = False) -> ParquetSource:
    class Orders(ParquetSource):
        def rows(self, table: str) -> DataFrame:
            rows = orders(spark, sf_dir) if table == "orders" else read(spark, sf_dir, table)
            return rows.where("o_orderkey % 10 <> 0") if snapshot and table == "orders" else rows

        def log(self) -> DataFrame | None:
            return changes_of

    return Orders(spark, sf_dir, {"orders": ["o_orderkey"], "customer": ["c_custkey"]})


def engine(spark: SparkSession, src: ParquetSource, **options) -> Engine:
    root = state_root(spark)
    return Engine(spark, src, Store(spark, f"{root}/store", 8), ParquetTarget(Store(spark, f"{root}/target", 8)), Options(**options))


def document(*pipelines: dict) -> dict:
    return {"apiVersion": "v1", "kind": "Deployment", "metadata": {"name": "test"}, "spec": {"pipelines": list(pipelines)}}


TOTALS = {"name": "totals", "mode": "transform", "source": {"table": "orders"}, "outputIdentity": ["o_custkey"], "transform": [{"$group": {"_id": "$o_custkey", "total": {"$sum": "$o_totalprice"}}}]}
COPY = {"name": "copy", "mode": "direct", "source": {"table": "orders"}, "fields": {"o_orderpriority": {"as": "omit"}, "o_totalprice": {"as": "string"}}}


@query(f"SELECT o_custkey, CAST(CAST(sum(o_totalprice) AS DECIMAL(20,2)) AS VARCHAR) AS total FROM {FINAL} GROUP BY o_custkey")
def sync_transform(spark, sf_dir):
    """Apply, then sync in windows; the target's documents."""
    rows = orders(spark, sf_dir)
    e = engine(spark, source(spark, sf_dir, log(rows), snapshot=True))
    e.apply(document(TOTALS))
    e.sync()
    return text(e.target.documents("totals"), "total")


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS o_totalprice FROM {FINAL}")
def sync_direct(spark, sf_dir):
    e = engine(spark, source(spark, sf_dir, log(orders(spark, sf_dir)), snapshot=True))
    e.apply(document(COPY))
    e.sync()
    e.sync()
    return e.target.documents("copy")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 1 THEN 'kept' END AS note FROM customer WHERE c_custkey % 5 <> 4")
def target_merge(spark, sf_dir):
    """Upserts set their own fields only, deletes take whole documents."""
    target, rows = ParquetTarget(Store(spark, state_root(spark), 8)), read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    target.upsert("c", rows, ["c_custkey"])
    target.upsert("c", rows.where("c_custkey % 3 = 1").select("c_custkey", F.lit("kept").alias("note")), ["c_custkey"])
    target.upsert("c", rows.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("new")), ["c_custkey"])
    target.delete("c", rows.where("c_custkey % 5 = 4").select("c_custkey").union(spark.sql("SELECT -1L")), ["c_custkey"])
    return target.documents("c")


@query("SELECT CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (o_orderkey % 10 = 7) AS BIGINT) AS missing, CAST(count(*) FILTER (o_orderkey % 10 = 8) AS BIGINT) AS different, CAST(5 AS BIGINT) AS extra FROM orders")
def align_report(spark, sf_dir):
    """Rows taken out of a base, changed in it and added to it are found and repaired."""
    e = engine(spark, source(spark, sf_dir), align_rows=max(10_000_000, orders(spark, sf_dir).count()))  # the whole table, however large
    e.apply(document(COPY))
    rows = e.store.read("base/ORDERS")
    tx = e.store.transaction()
    extra = rows.limit(5).withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    tx.patch("base/ORDERS", rows.where("o_orderkey % 10 = 7"), rows.where("o_orderkey % 10 = 8").withColumn("o_custkey", F.lit(-1).cast("long")).unionByName(extra))
    tx.commit()
    first, second = e.align("orders"), e.align("orders")
    if second["missing"] or second["different"] or second["extra"]:
        raise AssertionError(second)
    return spark.createDataFrame([tuple(first[k] for k in ("checked", "missing", "different", "extra"))], "checked long, missing long, different long, extra long")


@query("SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS checked, CAST(count(DISTINCT o_custkey) FILTER (o_custkey % 10 = 7) AS BIGINT) AS missing, CAST(count(DISTINCT o_custkey) FILTER (o_custkey % 10 = 8) AS BIGINT) AS different, CAST(1 AS BIGINT) AS extra FROM orders")
def drift_report(spark, sf_dir):
    """Documents lost and changed behind the engine's back are found and repaired; extra ones are counted and stay."""
    e = engine(spark, source(spark, sf_dir))
    e.apply(document(TOTALS))
    docs = e.target.documents("totals")
    e.target.upsert("totals", docs.where("o_custkey % 10 = 8").withColumn("total", F.lit(0).cast(docs.schema["total"].dataType)).unionByName(docs.limit(1).withColumn("o_custkey", F.lit(-1).cast("long"))), ["o_custkey"])
    e.target.delete("totals", docs.where("o_custkey % 10 = 7"), ["o_custkey"])
    first, second = e.drift("totals"), e.drift("totals")
    if second["missing"] or second["different"] or second["extra"] != 1:
        raise AssertionError(second)
    return spark.createDataFrame([tuple(first[k] for k in ("checked", "missing", "different", "extra"))], "checked long, missing long, different long, extra long")


@query("SELECT o_orderkey, o_custkey FROM orders")
def chunked_load(spark, sf_dir):
    """An initial load of the whole table by key ranges."""
    return loaded(spark, sf_dir, orders(spark, sf_dir))


def loaded(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    class Some(ParquetSource):
        def rows(self, table: str) -> DataFrame:
            return rows.select("o_orderkey", "o_custkey")

    src = Some(spark, sf_dir, {"orders": ["o_orderkey"]})
    e = engine(spark, src, chunk_rows=max(100, src.rows("orders").count() // 3 + 1))
    e.apply(document({"name": "few", "mode": "direct", "source": {"table": "orders"}}))
    return e.store.read("base/ORDERS")


@query(f"SELECT o_custkey, CAST(CAST(sum(o_totalprice) AS DECIMAL(20,2)) AS VARCHAR) AS total FROM {FINAL} GROUP BY o_custkey")
def pause_resume(spark, sf_dir):
    """Changes that arrive while a pipeline is paused are not delivered; resuming catches up."""
    e = engine(spark, source(spark, sf_dir, log(orders(spark, sf_dir)), snapshot=True), window=10_000_000)
    e.apply(document(TOTALS))
    e.pause("totals")
    stale = e.target.documents("totals").agg(F.count("*"), F.sum("total")).first()
    e.sync()
    if e.target.documents("totals").agg(F.count("*"), F.sum("total")).first() != stale or e.status()["pipelines"]["totals"]["health"] != "paused":
        raise AssertionError("delivered while paused")
    e.resume("totals")
    return text(e.target.documents("totals"), "total")


@query("SELECT * FROM (VALUES ('applied', 'added copy'), ('applied', 'added totals'), ('applied', 'loaded ORDERS'), ('changed', 'removed copy'), ('changed', 'revised totals'), ('left', 'totals')) t(step, what)")
def lifecycle(spark, sf_dir):
    """What applying a document does, and a later one that changes a pipeline and leaves one out."""
    e = engine(spark, source(spark, sf_dir))
    done = [("applied", x) for x in e.apply(document(COPY, TOTALS))]
    done += [("changed", x) for x in e.apply(document(TOTALS | {"transform": [{"$match": {"o_orderstatus": "F"}}, *TOTALS["transform"]]}))]
    return spark.createDataFrame(done + [("left", n) for n in e.status()["pipelines"]], "step string, what string")


@query("SELECT CAST(count(*) AS BIGINT) AS due, CAST(least(count(*), 100) AS BIGINT) AS taken, CAST(count(*) - least(count(*), 100) AS BIGINT) AS lag, 'lagging' AS health FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 IN (0, 1, 2, 3, 4) UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 10 IN (1, 3, 4))")
def window_and_lag(spark, sf_dir):
    """One window of a hundred changes, and what is then still due."""
    e = engine(spark, source(spark, sf_dir, log(orders(spark, sf_dir)), snapshot=True), window=100)
    e.apply(document(COPY))
    taken = sum(e._window(None).values())
    base = e.status()["bases"]["ORDERS"]
    return spark.createDataFrame([(taken + base["lag"], taken, base["lag"], base["health"])], "due long, taken long, lag long, health string")


@query("SELECT CAST(c_custkey AS VARCHAR) AS parked FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer)")
def poison_identity(spark, sf_dir):
    """A change whose value is no number parks the one customer that it belongs to; all others are brought up to date."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("v"))
    image = F.to_json(F.struct("c_custkey", F.when(F.col("c_custkey") == rows.agg(F.min("c_custkey")).first()[0], "poison").otherwise("1").alias("v")))
    events = rows.where("c_custkey < 200").select(F.lit("CUSTOMER").alias("table_name"), F.lit("update").alias("op"), (F.col("c_custkey") + 10).alias("position"), F.lit("r").alias("rs_id"), F.lit(0).cast("long").alias("ssn"), image.alias("image"))

    class Customers(ParquetSource):
        def rows(self, table: str) -> DataFrame:
            return rows

        def log(self) -> DataFrame | None:
            return events

    e = engine(spark, Customers(spark, sf_dir, {"customer": ["c_custkey"]}), attempts=1)
    e.apply(document({"name": "sums", "mode": "transform", "source": {"table": "customer"}, "outputIdentity": ["c_custkey"], "transform": [{"$group": {"_id": "$c_custkey", "v": {"$sum": "$v"}}}]}))
    e.sync()
    if e.target.documents("sums").where("v = 1").count() != events.count() - 1:
        raise AssertionError("others were held up")
    return spark.createDataFrame([(q["identity"]["c_custkey"],) for q in e.status()["quarantine"]], "parked string")


@query("SELECT n_nationkey, n_name FROM nation")
def catalog_source(spark, sf_dir):
    """A JSON catalog as source; a column of a type that is not read is left out."""
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect()]  # 25 rows
    src = CatalogSource(spark, {"tables": [{"name": "NATION", "watermark": 5, "primary_key": ["n_nationkey"], "columns": [{"name": "n_nationkey", "data_type": "NUMBER", "precision": 10, "scale": 0}, {"name": "n_name", "data_type": "VARCHAR2", "size": 40}, {"name": "pic", "data_type": "BLOB"}], "rows": rows}], "changes": []})
    return src.rows("nation").withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("SELECT * FROM (VALUES ('lineitem: no primary key'), ('nothing: cannot be read'), ('customer: the primary key is not unique')) t(problem)")
def prerequisites(spark, sf_dir):
    """All that stands against a sync, at once."""
    src = ParquetSource(spark, sf_dir, {"orders": ["o_orderkey"], "customer": ["c_nationkey"]})
    return spark.createDataFrame([(p.split(" (")[0],) for p in src.problems(["orders", "lineitem", "customer", "nothing"])], "problem string")


@query("SELECT * FROM (VALUES ('add_column note', 'unaffecting'), ('alter_column o_custkey', 'blocking'), ('drop_column o_orderpriority', 'unaffecting'), ('drop_column o_totalprice', 'blocking'), ('drop_table', 'blocking')) t(change, impact)")
def schema_impact(spark, sf_dir):
    """What changes of a table's schema mean for a pipeline that reads two of its fields."""
    used = set(lineage.used_fields(S.parse(TOTALS["transform"]), orders(spark, sf_dir).columns))
    kinds = [("add_column", ["note"]), ("drop_column", ["o_totalprice"]), ("drop_column", ["o_orderpriority"]), ("alter_column", ["o_custkey"]), ("drop_table", [])]
    return spark.createDataFrame([(" ".join([k, *c]), health.schema_impact({"kind": k, "table": "ORDERS", "columns": c}, "orders", None, used)) for k, c in kinds], "change string, impact string")


@query("SELECT * FROM (VALUES ('infrastructure full', 'target', 0::BIGINT), ('lagging', 'source', 10000::BIGINT), ('quiet', 'store', 95000::BIGINT)) t(state, limiting, rows_per_second)")
def capacity_estimate(spark, sf_dir):
    """The part that limits, and the rows per second that its headroom leaves."""
    quiet, lagging = {"bases": {"T": {"lag": 0}}}, {"bases": {"T": {"lag": 20_000}}}
    found = [("quiet", health.capacity(quiet)), ("lagging", health.capacity(lagging)), ("infrastructure full", health.capacity({"pipelines": {"p": {"lag": 20_000}}}, ("target",)))]
    return spark.createDataFrame([(n, c.limiting, int(c.rows_per_second)) for n, c in found], "state string, limiting string, rows_per_second long")


# types


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS o_totalprice FROM orders")
def map_as_string(spark, sf_dir):
    rows = orders(spark, sf_dir)
    return K.mapped(rows, {"o_orderkey": "string", "o_totalprice": "string", "o_custkey": "omit", "o_orderstatus": "omit", "o_orderpriority": "omit"})


@query("SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def temporal_utc(spark, sf_dir):
    """Naive times of a zone five and a half hours behind, as instants."""
    return in_utc(spark.read.parquet(f"{sf_dir}/events.parquet"))


def in_utc(rows: DataFrame) -> DataFrame:
    naive = F.col("ts").cast("timestamp")
    return rows.select("event_id", F.date_format(K.to_utc(naive, "-05:30"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc_group(spark, sf_dir)
