"""Shared folder, materialised tables and the text rules that several operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: `[\x20\x09-\x0D]` as a trim set.
ASCII_SPACE = " \t\n\x0b\x0c\r"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where that is unset, a folder of our own, but only on a local master: executors elsewhere would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "local").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="locusforge-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/locusforge/{name}-{uuid.uuid4().hex}"


class _Tables:
    """What materialize() has written within a scratch() block."""

    def __init__(self):
        self.made: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.made = [x for x in self.made if x is not df]
        self.kept.append(df)
        return df


_open: list[_Tables] = []


@contextmanager
def scratch() -> Iterator[_Tables]:
    """Deletes the tables written within the block at its end, but for those that keep() was given; so nothing that is returned may still read the others."""
    tables = _Tables()
    _open.append(tables)
    try:
        yield tables
    finally:
        _open.remove(tables)
        for x in tables.made:
            drop(x)
        if _open:  # what is kept here is the surrounding block's to delete
            _open[-1].made += tables.kept


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, and every executor can read it."""
    path = fresh_path(df.sparkSession, name)  # a fresh name, so a rerun never reads what a lost run left
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._locusforge_path = path
    if _open:
        _open[-1].made.append(out)
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_locusforge_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Tables are broadcast up to this many rows, if a row is some numbers of fixed width: at most 16 MB.
BROADCAST_ROWS = 200_000


def few(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df, marked for broadcast if a count shows that it is small. df is a written table of fixed-width rows, so the count is cheap and bounds the bytes; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if limit is None else limit) else df


#: Shifts of a 64-bit hash that give a Bloom filter's probes; the most 64-bit numbers a filter has (32 MB).
PROBES, MOST_LONGS = (0, 20, 36), 1 << 22


def bloom(df: DataFrame, column: str, keys_per_long: float = 4, most: int = MOST_LONGS) -> np.ndarray:
    """A Bloom filter of a column of 64-bit hashes, as a power of two of 64-bit numbers, at most `most`. It has no false negatives; over its size it only lets more pass. Tasks combine their bits first; the driver gets the filter, not the hashes."""
    longs = 1 << 10
    while longs < min(df.count() / keys_per_long, most):
        longs *= 2
    spots = df.select(F.explode(F.array(*[F.shiftrightunsigned(F.col(column), s) for s in PROBES])).alias("p"))
    held = spots.groupBy(F.expr(f"cast(shiftrightunsigned(p, 6) & {longs - 1} AS int)").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("v")).toArrow()
    words = np.zeros(longs, np.int64)
    words[held["k"].to_numpy()] = held["v"].to_numpy()
    return words


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys a Bloom filter may hold."""
    keys, ok = keys.view(np.uint64), np.ones(len(keys), bool)
    for s in PROBES:
        p = keys >> np.uint64(s)
        ok &= (words.view(np.uint64)[(p >> np.uint64(6)) & np.uint64(len(words) - 1)] >> (p & np.uint64(63)) & np.uint64(1)) == 1
    return ok


def sieve(run: Callable, column: str, keys: DataFrame) -> Callable:
    """run (a function for mapInArrow) without most of those rows whose hash isn't in keys (a written table with that one column): what is left goes to the join."""
    words = keys.sparkSession.sparkContext.broadcast(bloom(keys, keys.columns[0]))

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.filter(pa.array(may_hold(words.value, batch.column(column).to_numpy())))

    return sifted


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else. In a text of ASCII alone lower() does just that, many times faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold that held-out rows are told by."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(n)
