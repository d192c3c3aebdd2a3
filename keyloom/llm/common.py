"""Shared pieces of the training-data operators: durable intermediate tables, distributed ranks,
connected components and streaming group iteration.

Nothing here keeps corpus-sized state on the driver.  Intermediate tables are Parquet files under
``spark.checkpoint.dir`` (shared by all executors), so a lost executor costs only a re-read.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words everywhere: maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode without it, one temporary folder a session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_roots[app] = tempfile.mkdtemp(prefix="keyloom-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return "file://" + _local_roots[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables of the open scopes, innermost last; each thread has its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("keyloom_scopes", default=())
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning: dict[int, tuple[int, str | None]] = {}
_cleaning_lock = threading.Lock()


def _place(spark: SparkSession, path: str):
    """(file system, path) of a classic session; a remote session has no JVM to ask and keeps its files."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return None
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that ``materialize`` wrote inside it without ``keep``."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in reversed(own):
            if "/" not in path:
                spark.sql(f"DROP TABLE IF EXISTS {path}")
            elif found := _place(spark, path):
                found[0].delete(found[1], True)


def _track(spark: SparkSession, path: str, keep: bool) -> None:
    """Puts a table in the innermost scope, with ``keep`` in the one around it; outside all, it goes with the JVM."""
    scopes = _scopes.get()
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    elif found := _place(spark, path):
        found[0].deleteOnExit(found[1])


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """Executions that begin inside remove their shuffle files as they end; the setting returns when no thread is inside."""
    with _cleaning_lock:
        depth, before = _cleaning.get(id(spark), (0, None))
        if not depth:
            before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _cleaning[id(spark)] = depth + 1, before
    try:
        yield
    finally:
        with _cleaning_lock:
            depth, before = _cleaning.pop(id(spark))
            if depth > 1:
                _cleaning[id(spark)] = depth - 1, before
            else:
                spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage durably.

    The write's shuffle files go as it ends.  Inside ``scratch`` the table lives until its end, with
    ``keep`` (for what a result reads) until the end of the scope around it; outside all scopes until
    the JVM ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _track(spark, path, keep)
    with _cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """As ``materialize``, bucketed by ``column``: later joins on it do not shuffle this side.

    Only inside ``scratch``, which drops the table; a catalog entry names the buckets meanwhile.
    """
    spark = df.sparkSession
    path, entry = fresh_path(spark, name), f"keyloom_{name}_{uuid.uuid4().hex}"
    _scopes.get()[-1].extend([path, entry])
    with _cleanup(spark):
        df.write.option("path", path).bucketBy(partitions(spark), column).sortBy(column).saveAsTable(entry)
    return spark.table(entry)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def null_safe_join(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with the other columns of ``right``; nulls in ``cols`` equal each other."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}" if c in cols else c) for c in right.columns])
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in cols])


def distributed_rank(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Add the 1-based rank of each row in its group without gathering a group in one task.

    Rows are range-partitioned by (group, order) and written with their partition number; the
    prefix sums of the partition counts give each partition's offset, so a group that holds a
    third of all rows is ranked by many tasks.  ``df`` should be narrow: the range sampler reads it.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in (*group, *order)]
    parts = materialize(df.repartitionByRange(partitions(spark), *keys).withColumn("_pid", F.spark_partition_id()), name)
    counts = parts.groupBy(*group, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = null_safe_join(parts, offsets, [*group, "_pid"])
    within = Window.partitionBy(*group, "_pid").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return joined.withColumn(name, F.col("_off") + F.row_number().over(within)).drop("_pid", "_off")


def spread_join(rows: DataFrame, counted: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``counted``, one row a key that counts in ``c`` its rows among the ``total``.

    Keys of over a thousandth of all rows, of which there are fewer than 1,000, go to all executors and
    their rows stay where they are; only the others meet by shuffle.  ``c`` is dropped.
    """
    bar = max(1, total // 1000)
    hot, few = counted.filter(F.col("c") > bar).drop("c"), counted.filter(F.col("c") <= bar).drop("c")
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(few, on))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)`` as (id, component): the smallest id that links reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until the edges no longer
    change.  What a step looks up is a written table, so its join is broadcast while that is small and
    one of two plain shuffles beyond, which AQE splits where a hub's neighbours would meet in one task.
    Ids of no edge are not returned.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    e = materialize(e, "edges")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        state = now
        with scratch(spark):
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("m", "u").alias("m")), "low")
            # a node's larger neighbours move to its smallest one
            large = materialize(e.join(low, "v").select("u", F.col("m").alias("v")).filter("u > v").distinct(), "large")
            low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
            e = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges", keep=True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small slices, so that a worker holds what it makes of few documents at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def grouped(key: str, work: Callable[[pa.Table], Iterable[pa.RecordBatch]]) -> Callable:
    """For mapInArrow over partitions sorted by ``key``: calls ``work`` with each group's table.

    Callers bound the groups (see ``blocked``), so a group fits in a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            at = 0
            for i in range(len(keys)):
                if i == 0 and (not held or held[-1].column(key)[-1].as_py() == keys[0]):
                    continue
                if i == 0 or keys[i] != keys[i - 1]:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    if held:
                        yield from work(pa.Table.from_batches(held))
                    held, at = [], i
            if len(keys) > at:
                held.append(batch.slice(at))
        if held:
            yield from work(pa.Table.from_batches(held))

    return run
