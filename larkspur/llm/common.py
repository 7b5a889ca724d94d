"""What the operators share: reading tables, tables written to the shared folder, names that can't clash."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

#: Columns that operators add for their own use begin with this, so they never clash with those of the input.
OWN = "__lk_"


def load(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A sample table. spread: rows of an input with fewer splits than there are cores are dealt out to all of them."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if spread and table.rdd.getNumPartitions() < cores else table


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session in one machine has a folder of its
    own (tests); on a cluster that is an error, for no other executor would find what one writes to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        application = spark.sparkContext.applicationId
        found = _local[application] = _local.get(application) or f"file://{tempfile.mkdtemp(prefix='larkspur_')}"
    return found.rstrip("/")


class _Written(threading.local):
    """Tables that this thread has written since each finished() that is going on began."""

    def __init__(self):
        self.levels: list[list[str]] = []


_written = _Written()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df, written once to the shared folder and read again: its lineage is cut, and a lost executor costs nothing.

    Unlike DataFrame.checkpoint() this runs the plan once, and the copy has columns that can be pruned and filtered.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _written.levels:
        _written.levels[-1].append(path)
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.__dict__[OWN + "path"] = path
    return held


def finished(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What make() returns, materialized; all that it had materialized on the way has no reader any more and is deleted."""
    _written.levels.append([])
    try:
        done = materialize(make(), tag)
    finally:
        *steps, last = _written.levels.pop() or [""]
        for path in [*steps, last] if sys.exc_info()[0] else steps:
            _delete(spark, path)
    if _written.levels:
        _written.levels[-1].append(last)
    return done


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize() or finished() gave, which nothing reads any more; others are left alone."""
    for df in tables:
        _delete(df.sparkSession, df.__dict__.get(OWN + "path", ""))


def _delete(spark: SparkSession, folder: str) -> None:
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/larkspur/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder. Frames that were made from it can't be read any more."""
    _delete(spark, _own_dir(spark))


def seeded(seed: int, *columns: str | Column) -> Column:
    """A 64-bit hash of the columns that depends on the seed and on nothing else."""
    return F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in columns])


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def integer(df: DataFrame, name: str) -> Column:
    """An identifier as a long. Identifiers of another kind have no order that the operators could promise: a TypeError."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"{name} has to be an integer, not {kind.simpleString()}")
    return F.col(name).cast("long")


def row_hash(df: DataFrame, names: list[str]) -> Column:
    """A 64-bit hash of what a row says in these columns, whatever their types."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    plain = [n for n in names if not any(k in kinds[n] for k in ("map<", "variant", "void"))]
    others = [n for n in names if n not in plain]
    return F.xxhash64(*columns_of(df, plain), F.to_json(F.struct(*columns_of(df, others)), {"ignoreNullFields": "false"}) if others else F.lit(0))


def one_of(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Of rows with the same keys the one that is least as JSON: beyond that they are alike."""
    row = F.struct(*columns_of(rows, names))
    best = rows.groupBy(*keys).agg(F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias(OWN + "row"))
    return best.select(*[F.col(OWN + "row").getField(n).alias(n) for n in names], *[F.col(k) for k in keys if k.startswith(OWN)])


def columns_of(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """Columns by name, whatever is in the names."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in (df.columns if names is None else names)]


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns whose names an operator's output takes (in any case)."""
    taken = {n.lower() for n in names}
    drop = [c for c in df.columns if c.lower() in taken]
    return df.drop(*drop) if drop else df


_held: dict | None = None


def claim(cache: dict) -> None:
    """One cache a worker: that of the operator at work. Workers outlive stages, and what an earlier one remembered or loaded goes."""
    global _held
    if _held is not cache:
        if _held is not None:
            _held.clear()
        _held = cache


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, list[str | None]]]:
    """(start, end, texts) of about `most` bytes, or of one text if it is longer: few are Python strings at a time. Afterwards
    freed memory goes back to the machine, which other workers share."""
    sizes = np.cumsum(pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield start, end, texts.slice(start, end - start).to_pylist()
        start = end
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass
