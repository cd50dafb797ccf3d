"""Cutting lineage with a written table in the folder the cluster names, and keeping little on disk on the way."""

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_ROWS = 4_000_000  # rows whose shuffle files may stand on disk at once, about

_LOCAL: list[str] = []
_MADE = threading.local()  # .paths: what was written inside of `scratch`
_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Only a local master may do without it and gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("spark.checkpoint.dir names no shared folder: tables written by executors would be lost")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="omenflow-"))
    return _LOCAL[0]


@contextlib.contextmanager
def freeing(spark: SparkSession):
    """A job in here gives up its shuffle files when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_FREES, "false")
    spark.conf.set(_FREES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREES, before)


def written(df: DataFrame) -> DataFrame:
    """Write `df` once and read it back: executors may be lost afterwards without recomputation."""
    return in_slices(1, lambda i: df)


def in_slices(n: int, make: Callable[[int], DataFrame]) -> DataFrame:
    """`make(i)` for i below n, written one after the other as one table: the shuffle files of one are gone before the next."""
    path = None
    for i in range(n):
        df = make(i)
        spark = df.sparkSession
        path = path or f"{checkpoint_root(spark).rstrip('/')}/omenflow-{uuid.uuid4().hex}"
        with freeing(spark):
            df.write.mode("append").parquet(path)
    if getattr(_MADE, "paths", None) is not None:
        _MADE.paths.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def slices(rows: int) -> int:
    """In how many slices so many rows are shuffled."""
    return max(1, -(-rows // SLICE_ROWS))


def of_slice(i: int, n: int, *by: str | Column) -> Column:
    """Whether a row is of slice i of n; rows that agree on `by` are of one slice."""
    return F.lit(True) if n == 1 else F.pmod(F.xxhash64(*by), F.lit(n)) == i


@contextlib.contextmanager
def scratch():
    """Tables written in here are deleted at the end, but for those that are taken off the list."""
    outer, own = getattr(_MADE, "paths", None), []
    _MADE.paths = own
    try:
        yield own
    finally:
        _MADE.paths = outer
    for spark, path in own:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """`make()`, which ends with writing what it returns; the tables that were written on the way to it are deleted."""
    with scratch() as own:
        out = make()
        last = own.pop()
    if getattr(_MADE, "paths", None) is not None:
        _MADE.paths.append(last)
    return out
