"""What the operators share: table access, the shared folder, and words of whole Arrow columns as numpy arrays."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_staged: list[str] = []

#: Rows and bytes of a batch that goes to Python, so that a worker's memory does not depend on how long texts are.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and there is one machine alone."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="sluice-")
    return _own_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, which outlives any executor. Whoever owns that folder clears it."""
    spark = df.sparkSession
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    path_ = spark._jvm.org.apache.hadoop.fs.Path(path)
    path_.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path_, True)
    with contextlib.suppress(ValueError):
        _staged.remove(path)


def drop_stage(df: DataFrame) -> None:
    """Deletes the table of a stage() that no later plan reads."""
    files = df.inputFiles()[:1]
    for path in [p for p in _staged if files and f"/{p.rsplit('/', 1)[1]}/" in files[0]]:
        _delete(df.sparkSession, path)


def staged_so_far() -> int:
    return len(_staged)


def drop_stages(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Deletes the tables that were staged after staged_so_far() said `since`, but for the one that is to be kept."""
    files = keep.inputFiles()[:1]
    for path in [p for p in _staged[since:] if not (files and f"/{p.rsplit('/', 1)[1]}/" in files[0])]:
        _delete(spark, path)


def _give_back() -> None:
    """Memory that a Python worker has freed goes back to the machine, as workers live on, idle, through later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such call nothing is given back
        ctypes.CDLL(None).malloc_trim(0)


def lean_group(compare: Callable) -> Callable:
    """A function over groups, each after which freed memory is given back."""

    @functools.wraps(compare)
    def tidied(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return compare(key, table)
        finally:
            _give_back()

    return tidied


def lean(run: Callable) -> Callable:
    """A function over batches after which freed memory is given back."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def fresh(name: str, *taken: list[str]) -> str:
    """A column name that none of the tables has, in any case."""
    names = {c.lower() for columns in taken for c in columns}
    while name.lower() in names:
        name += "_"
    return name


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _LETTER.copy()
_FOLDED[65:91] = _LETTER[97:123]
_BASE, _PIECE = 0x9E3779B97F4A7C15 | 1, 1 << 17
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None:
        inverse = pow(_BASE, -1, 2**64)
        up, down = np.full(_PIECE + 1, _BASE, np.uint64), np.full(_PIECE + 1, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on its own copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def chunks(offsets: np.ndarray, most: int = 1 << 18):
    """Runs (first, last + 1) of whole texts of at most so many bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 18):
    """Like chunks, as (first text, last + 1, from byte, to byte), but a text of more than twice so many bytes comes in several
    spans, each up to a white space (a longer word stays whole), so that memory does not grow with a text's length."""
    for i, j in chunks(offsets, most):
        a, end = int(offsets[i]), int(offsets[j])
        while j == i + 1 and end - a > 2 * most:
            b = a + most
            while b < end and not (found := np.flatnonzero(SPACE[data[b : b + most]])[:1]).size:
                b += most
            b = min(b + int(found[0]) if b < end else end, end)
            if b < end:
                yield i, j, a, b
            else:
                break
            a = b
        yield i, j, a, end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of the texts, and for each text where its words begin in them (n + 1)."""
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of words by their bytes; fold: A-Z as a-z."""
    up, down = _power_tables()
    letters, out, i = _FOLDED if fold else _LETTER, np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _PIECE, "right")))
        if ends[i] - at > _PIECE:  # one word longer than a piece: its pieces' hashes are chained
            h = np.zeros(1, np.uint64)
            for p in range(at, ends[i], _PIECE):
                part = letters[data[p : min(p + _PIECE, ends[i])]]
                h = mix(h * np.uint64(_BASE) + (part * up[: len(part)]).sum(dtype=np.uint64, keepdims=True))
            out[i] = h[0]
            i += 1
            continue
        part = letters[data[at : ends[j - 1]]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        s = starts[i:j] - at
        out[i:j] = (sums[ends[i:j] - at] - sums[s]) * down[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def maybe_in(df: DataFrame, column: str, ids: DataFrame, id_col: str, bits: int = 24) -> DataFrame:
    """Rows of df whose id may be among ids, before any shuffle of df: hashes of ids set bits of a bitmap of fixed size (2**bits), which is broadcast as at most 2**bits / 64 rows. It lets more through the more ids there are, and never drops one of them."""
    from pyspark.sql import functions as F

    def bit(c: str):
        return F.pmod(F.xxhash64(F.col(c)), F.lit(1 << bits))

    words = ids.select(bit(id_col).alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 AS INT))")).alias("_set"))
    marked = df.withColumn("_bit", bit(column)).withColumn("_word", F.shiftright("_bit", 6))
    return marked.join(F.broadcast(words), "_word").where(F.expr("getbit(_set, cast(_bit % 64 AS INT)) = 1")).select(*df.columns)
