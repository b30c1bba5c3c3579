"""Change logs: their row form, stable ids, order, and net changes per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.relational import col

#: A change: op is insert, update or delete; image is the row after it (its key alone is enough for a delete) as JSON.
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("table_name", T.StringType()), ("op", T.StringType()), ("position", T.LongType()), ("rs_id", T.StringType()), ("ssn", T.LongType()), ("image", T.StringType()))])
ORDER = ("position", "rs_id", "ssn")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def stream_log(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The log as a stream of files, so many a batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(path)


def with_ids(log: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """The log with change_id: log:table:position:op:key:rs_id:ssn."""
    pk = F.lit("")
    for table, names in keys.items():
        pk = F.when(F.upper("table_name") == table.upper(), F.concat_ws(",", *[F.coalesce(F.get_json_object("image", f"$['{k}']"), F.lit("null")) for k in names])).otherwise(pk)
    parts = [F.lit("log"), F.upper("table_name"), F.col("position"), F.col("op"), pk, F.coalesce("rs_id", F.lit("")), F.coalesce("ssn", F.lit(0))]
    return log.withColumn("change_id", F.concat_ws(":", *parts))


def unapplied(log: DataFrame, ledger: DataFrame | None, checkpoint: int) -> DataFrame:
    """Changes from the checkpoint on, its own position included, but for those that the ledger has."""
    due = log.where(F.col("position") >= checkpoint)
    return due if ledger is None else due.join(ledger.select("change_id"), "change_id", "left_anti")


#: So many rows may be ordered in one task.
TASK_ROWS = 100_000


def _slice(rows: DataFrame, key: str, n: int, enough: int) -> tuple[int, int, int] | None:
    """(low, high, below): row n by a whole number key lies in low..high, and below rows before it. Counts of a thousand
    slices at a time narrow the range until it holds enough rows or fewer, or one value. None if there are no more than n rows with a key."""
    inside, low, high = rows.agg(F.count(col(key)), F.min(col(key)), F.max(col(key))).first()
    if inside <= n:
        return None
    low, high, below = int(low), int(high), 0
    while low < high and inside > enough:
        width = (high - low) // 1000 + 1
        part = F.floor((col(key).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int")
        counts = dict(rows.where(col(key).between(low, high)).groupBy(part.alias("p")).count().collect())  # a thousand rows
        for p in sorted(counts):
            if below + counts[p] >= n:
                low, high, inside = low + p * width, min(high, low + (p + 1) * width - 1), counts[p]
                break
            below += counts[p]
    return low, high, below


def first(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order that begins with a whole number and has no null there, of which one task puts only the last few in order."""
    found = _slice(rows, order[0], n, TASK_ROWS)
    if found is None:
        return rows
    low, high, below = found
    return rows.where(col(order[0]) < low).union(rows.where(col(order[0]).between(low, high)).orderBy(*[col(c) for c in order]).limit(n - below))


def window(log: DataFrame, capacity: int) -> DataFrame:
    """The first changes in log order, at most so many."""
    order = [*ORDER, "table_name"]
    return log.orderBy(*order).limit(capacity) if capacity <= TASK_ROWS else first(log, order, capacity)


def stretch(log: DataFrame, capacity: int) -> DataFrame:
    """The first changes in log order, as many or somewhat more, whole positions alone: nothing is put in order."""
    found = _slice(log, "position", capacity, max(1, capacity // 8))
    return log if found is None else log.where(F.col("position") <= found[1])


def last_images(log: DataFrame, schema: T.StructType, keys: list[str]) -> DataFrame:
    """For each key its last change: the row after it in the base's schema, and __op."""
    typed = log.select("op", *ORDER, F.from_json("image", schema).alias("row"))
    order = F.struct(F.col("position"), F.coalesce("rs_id", F.lit("")).alias("rs"), F.coalesce("ssn", F.lit(0)).alias("ssn"))
    best = typed.groupBy(*[F.col("row")[k].alias(k) for k in keys]).agg(F.max_by(F.struct("op", "row"), order).alias("x"))
    return best.select(*[F.col("x.row")[f.name].alias(f.name) for f in schema.fields], F.col("x.op").alias("__op"))


def net_change(base: DataFrame, log: DataFrame, keys: list[str], last: DataFrame | None = None):
    """What the log changes in the base: by what a key's row was and is, whatever the labels say. last: its last images, if they are there."""
    from sluice.plans.affect import Change

    last = last_images(log, base.schema, keys) if last is None else last
    before = base.join(last.select(*[col(k) for k in keys]), list(keys), "left_semi")
    after = last.where("__op != 'delete'").drop("__op")
    return Change(before, after, tuple(keys))


def applied(base: DataFrame, change) -> DataFrame:
    """The base after a change."""
    keys = list(change.keys)
    touched = change.before.select(*[col(k) for k in keys]).union(change.after.select(*[col(k) for k in keys]))
    return base.join(touched, keys, "left_anti").unionByName(change.after)


def merged(data: DataFrame, schema_changes: DataFrame) -> DataFrame:
    """Data and schema changes in one order of positions; at one position the schema's come first."""
    a = schema_changes.select("position", F.lit(0).alias("__kind"), F.to_json(F.struct("*")).alias("event"))
    b = data.select("position", F.lit(1).alias("__kind"), F.to_json(F.struct("*")).alias("event"))
    return a.union(b).orderBy("position", "__kind")
