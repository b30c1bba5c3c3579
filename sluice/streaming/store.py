"""Durable state: keyed Parquet datasets and small values behind one manifest.

A commit writes new files first and then one manifest, by rename, so that readers see all of it or nothing. A dataset is
divided into buckets by a hash of its key; a patch rewrites the buckets that it touches, the others are referred to as they are.
The number of buckets follows a dataset's bytes, so that a bucket stays small however large the dataset grows. A bucket may
have several folders of files, from appends of keys that it did not have.
"""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.relational import col

FORMAT, BUCKETS = 1, 32
#: Bytes of files from which on a bucket is divided, and for how many seconds a lock holds that nobody renews.
BUCKET_BYTES, LEASE = 1 << 30, 600.0


class StoreBusy(RuntimeError):
    """Another writer holds the store, or committed in between."""


def folders(dataset: dict, only: list[int] | None = None) -> list[str]:
    """The folders of a dataset's buckets."""
    wanted = None if only is None else set(only)
    return [p for b, paths in dataset["buckets"].items() if wanted is None or int(b) in wanted for p in ([paths] if isinstance(paths, str) else paths)]


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*[col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def same_keys(keys: list[str], left: str, right: str):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return on


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, bucket_bytes: int = BUCKET_BYTES, lease: float = LEASE):
        self.spark, self.root, self.buckets, self.bucket_bytes, self.lease = spark, root.rstrip("/"), buckets, bucket_bytes, lease
        self._held: str | None = None
        self._thread = 0
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """The whole state of a version; a reader that holds on to one is not disturbed by later commits."""
        version = self.version() if version is None else version
        if not version:
            return {"format": FORMAT, "version": 0, "datasets": {}, "values": {}}
        stream = self._fs.open(self._path(f"{self.root}/manifest/{version:012d}.json"))
        try:
            found = json.loads(bytes(self.spark._jvm.org.apache.hadoop.shaded.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
        return migrate(found)

    def value(self, key: str, default: Any = None) -> Any:
        return self.manifest()["values"].get(key, default)

    def has(self, name: str) -> bool:
        return name in self.manifest()["datasets"]

    def read(self, name: str, manifest: dict | None = None, only: list[int] | None = None) -> DataFrame:
        d = (manifest or self.manifest())["datasets"][name]
        schema = T.StructType.fromJson(d["schema"])
        paths = folders(d, only)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        """Files of df by bucket; nothing refers to them until a commit does."""
        path = f"{self.root}/data/{name.replace('/', '_')}/{uuid.uuid4().hex}"
        marked = df.withColumn("__bucket", bucket_of(keys, buckets))
        marked.hint("rebalance", F.col("__bucket")).write.partitionBy("__bucket").parquet(path)
        out = {}
        for s in self._fs.listStatus(self._path(path)):
            n = s.getPath().getName()
            if n.startswith("__bucket="):
                out[n.split("=")[1]] = f"{path}/{n}"
        return out

    def bytes_of(self, paths: list[str]) -> int:
        """Length of the files in folders."""
        return sum(self._fs.getContentSummary(self._path(p)).getLength() for p in paths)

    def free_bytes(self) -> int:
        """What the store's file system says is left, -1 if it does not say."""
        left = self._fs.getStatus(self._path(self.root)).getRemaining()
        return -1 if left >= 1 << 62 else left

    @contextlib.contextmanager
    def lock(self) -> Iterator[None]:
        """One writer at a time: a lock file that only one can create. A holder may enter again; one that no longer renews it loses it after the lease."""
        path = self._path(f"{self.root}/lock")
        if self._held and self._thread == threading.get_ident():
            self.renew()
            yield
            return
        owner = uuid.uuid4().hex
        try:
            self._claim(path, owner)
        except self._jvm_errors() as e:
            held = self._holder(path)
            if held and time.time() - held[1] < self.lease:
                raise StoreBusy(f"{self.root} is held by another writer") from e
            self._fs.delete(path, False)
            try:
                self._claim(path, owner)
            except self._jvm_errors() as again:
                raise StoreBusy(f"{self.root} is held by another writer") from again
        self._held, self._thread = owner, threading.get_ident()
        try:
            yield
        finally:
            held, self._held = self._holder(path), None
            if held and held[0] == owner:
                self._fs.delete(path, False)

    @staticmethod
    def _jvm_errors() -> tuple[type[Exception], ...]:
        from py4j.protocol import Py4JJavaError

        return (Py4JJavaError,)

    def _claim(self, path: Any, owner: str, again: bool = False) -> None:
        out = self._fs.create(path, again)
        out.write(bytearray(json.dumps([owner, time.time()]).encode()))
        out.close()

    def _holder(self, path: Any) -> tuple[str, float] | None:
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return tuple(json.loads(bytes(self.spark._jvm.org.apache.hadoop.shaded.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()))
        except ValueError:  # being written
            return "", time.time()
        finally:
            stream.close()

    def renew(self) -> None:
        """Says that the holder is still at work; raises if the lock went to another one."""
        if self._held:
            path = self._path(f"{self.root}/lock")
            held = self._holder(path)
            if not held or held[0] != self._held:
                raise StoreBusy(f"the lock of {self.root} was lost")
            self._claim(path, self._held, True)

    def transaction(self) -> Transaction:
        return Transaction(self, self.manifest())

    def _commit(self, manifest: dict) -> None:
        manifest["version"] += 1
        target = self._path(f"{self.root}/manifest/{manifest['version']:012d}.json")
        draft = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise StoreBusy(f"version {manifest['version']} is there already")

    def vacuum(self, keep: int = 3) -> int:
        """Deletes files that none of the last `keep` versions refers to; returns how many directories went."""
        now = self.version()
        used = {p.split("/")[-2] for v in range(max(1, now - keep + 1), now + 1) for d in self.manifest(v)["datasets"].values() for p in folders(d)}
        gone = 0
        data = self._path(f"{self.root}/data")
        for name in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for s in self._fs.listStatus(name.getPath()):
                if s.getPath().getName() not in used:
                    gone += bool(self._fs.delete(s.getPath(), True))
        return gone


def migrate(manifest: dict) -> dict:
    """Older manifests in today's form; data stays as it is."""
    if manifest.get("format", 0) > FORMAT:
        raise RuntimeError(f"state of format {manifest['format']} needs a newer release")
    manifest.setdefault("values", {})
    manifest["format"] = FORMAT
    return manifest


@dataclass
class Transaction:
    """Changes that become visible together."""

    store: Store
    manifest: dict
    values: dict[str, Any] = field(default_factory=dict)

    def replace(self, name: str, df: DataFrame, keys: list[str], buckets: int | None = None) -> None:
        count = buckets or self.store.buckets
        files = self.store.write(name, df, keys, count)
        self.manifest["datasets"][name] = {"schema": df.schema.jsonValue(), "keys": keys, "bucket_count": count, "buckets": files}
        self._fit(name)

    def append(self, name: str, df: DataFrame) -> None:
        """Rows of keys that the dataset does not have: nothing that is there is read or written."""
        d = self.manifest["datasets"][name]
        files = self.store.write(name, df, d["keys"], d["bucket_count"])
        old = {b: [p] if isinstance(p, str) else p for b, p in d["buckets"].items()}
        self.manifest["datasets"][name] = d | {"buckets": old | {b: [*old.get(b, []), p] for b, p in files.items()}}
        self._fit(name)

    def _fit(self, name: str) -> None:
        """Divides a dataset into more buckets once they are too large on average."""
        d = self.manifest["datasets"][name]
        size = self.store.bytes_of(folders(d))
        if size > self.store.bucket_bytes * d["bucket_count"]:
            count = d["bucket_count"]
            while size > self.store.bucket_bytes * count // 2:
                count *= 2
            files = self.store.write(name, self.store.read(name, self.manifest), d["keys"], count)
            self.manifest["datasets"][name] = d | {"bucket_count": count, "buckets": files}

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets that hold these keys; as many rows at most as there are buckets."""
        d = self.manifest["datasets"][name]
        return [r[0] for r in keys.select(bucket_of(d["keys"], d["bucket_count"]).alias("b")).distinct().collect()]

    def patch(self, name: str, gone: DataFrame, upserts: DataFrame, touched: list[int] | None = None, whole: bool = False) -> None:
        """Rows with a key of gone or of upserts leave, upserts enter; only their buckets (touched, where they are known) are written. whole: gone has the keys of upserts as well."""
        d = self.manifest["datasets"][name]
        keys, count = d["keys"], d["bucket_count"]
        old_schema = T.StructType.fromJson(d["schema"])
        names = [col(k) for k in keys]
        touched_keys = (gone.select(*names) if whole else gone.select(*names).union(upserts.select(*names))).distinct()
        touched = self.touched(name, touched_keys) if touched is None else touched
        if not touched:
            return
        old = self.store.read(name, self.manifest, touched).alias("o").join(touched_keys.alias("k"), same_keys(keys, "o", "k"), "left_anti")
        rows = old.unionByName(upserts.select(*[col(f.name).cast(f.dataType) if f.name in upserts.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in old_schema.fields]))
        files = self.store.write(name, rows, keys, count)
        kept = {b: p for b, p in d["buckets"].items() if int(b) not in touched}
        self.manifest["datasets"][name] = d | {"buckets": kept | files}
        self._fit(name)

    def append_ids(self, name: str, ids: DataFrame, keep_from: dict[str, int]) -> None:
        """Adds applied change ids; those below their table's checkpoint are never asked for again and go, so that few are left, in one bucket."""
        rows = self.store.read(name, self.manifest).unionByName(ids) if name in self.manifest["datasets"] else ids
        for table, position in keep_from.items():
            rows = rows.where((F.col("table_name") != table) | (F.col("position") >= position))
        self.replace(name, rows.dropDuplicates(["change_id"]), ["change_id"], 1)

    def drop(self, name: str) -> None:
        self.manifest["datasets"].pop(name, None)

    def set(self, key: str, value: Any) -> None:
        self.manifest["values"][key] = value

    def commit(self) -> None:
        self.store._commit(self.manifest)


_own_root: str | None = None


def state_root(spark: SparkSession) -> str:
    """A new folder for state under spark.checkpoint.dir, which all machines share; in a local run without it, under a temporary one."""
    import tempfile

    global _own_root
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own_root = _own_root or "file://" + tempfile.mkdtemp(prefix="sluice-state-")
        shared = _own_root
    return f"{shared.rstrip('/')}/state-{uuid.uuid4().hex}"
