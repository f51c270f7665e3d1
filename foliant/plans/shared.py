"""Tables in the folder that the driver and all executors share, and ranks without a single task."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each Spark context; the driver gives back what earlier work has left."""
    trim()
    sc = spark.sparkContext
    if getattr(sc, "_foliant_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="foliant-")  # the driver serves the archive from here until it ends
    atexit.register(shutil.rmtree, folder, True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "foliant"), "zip", os.path.dirname(top), os.path.basename(top)))
    sc._foliant_shipped = True


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its store's scheme: without one it is in the default store, on executors as on the driver."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    return re.sub(r"^file:/(?!/)", "file:///", full)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, with its store's scheme.

    Where ``spark.checkpoint.dir`` is unset, a local master gets a temporary
    folder; any other master uses the warehouse, unless that is in the local
    files of each machine: then the setting is asked for.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return qualified(spark, path)
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return f"file://{os.path.join(tempfile.gettempdir(), f'foliant-{spark.sparkContext.applicationId}')}"
    path = qualified(spark, spark.conf.get("spark.sql.warehouse.dir"))
    if path.startswith("file:"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{path}/_foliant"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, in this application's part of it, which goes when the driver ends."""
    sc = spark.sparkContext
    top = f"{shared_dir(spark)}/foliant-{sc.applicationId}"
    if getattr(sc, "_foliant_scratch", None) != top:
        p = sc._jvm.org.apache.hadoop.fs.Path(top)
        store = p.getFileSystem(sc._jsc.hadoopConfiguration())
        store.mkdirs(p)
        store.deleteOnExit(p)
        sc._foliant_scratch = top
    return f"{top}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = path or shared_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def side(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def forget(spark: SparkSession, path: str) -> None:
    """Delete a shared table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def group_codes(table: pa.Table, key: str) -> np.ndarray:
    """Equal numbers for equal values of a column, missing ones too."""
    column = table.column(key).combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Rows sorted by ``keys`` in tables of at least ``least`` rows that hold whole groups; only a larger group makes a larger table."""
    held, n, bar = [], 0, least
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= bar:
            table = pa.Table.from_batches(held)
            same = np.ones(n, bool)
            for k in keys:
                col = group_codes(table, k) if table.column(k).null_count else table.column(k).to_numpy()
                same &= col == col[-1]
            other = np.flatnonzero(~same)
            if len(other):
                start = int(other[-1]) + 1
                yield table.slice(0, start)
                held, n, bar = table.slice(start).to_batches(), n - start, least
            bar = max(least, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def arrow_schema(ddl: str) -> pa.Schema:
    """A schema for ``batched_rows``; only the driver can read DDL."""
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def batched_rows(rows: Iterable[tuple], arrow: pa.Schema, most: int = 10_000, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, each filled from as many groups or files as fit: up to ``most`` rows or about ``most_bytes`` of strings and bytes."""
    long = [k for k, f in enumerate(arrow) if pa.types.is_string(f.type) or pa.types.is_binary(f.type)]
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        for k in long:
            if row[k] is not None:
                size += len(row[k])
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)


def by_group(df: DataFrame, key: str, order: list[Column], fn: Callable[[object, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``fn`` gives for each group of ``key`` (its first column) and its rows in ``order``.

    Groups are runs of a sorted partition, so a small one costs no more than
    its rows; a worker holds one group and one batch. The number of partitions
    is the session's: by their bytes alone few tasks would get all the work.
    """
    df = df.select(key, *[c for c in df.columns if c != key])
    arrow = arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                yield from zip(*[c.to_pylist() for c in batch.slice(s, 1000).columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched_rows((row for name, group in groupby(rows(batches), itemgetter(0)) for row in fn(name, list(group))), arrow)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def trim() -> None:
    """Gives back what a worker process no longer uses, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def give_back(spark: SparkSession) -> None:
    """The driver gives back what is no longer used: broadcasts and shuffles without a reference, free heap, freed native memory.

    Spark drops broadcasts and shuffles only when the driver's JVM happens to
    collect its garbage, and the JVM keeps the heap that a wide plan has
    grown. The JVM's own setting for free heap is lowered for this one
    collection and then put back. A JVM without these commands just collects.
    """
    gc.collect()
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName

    def call(interface: str, target, method: str, *args):
        # by the interface: the classes behind it are not open
        types, values = new(jvm.java.lang.Class, len(args)), new(jvm.java.lang.Object, len(args))
        for k, (kind, value) in enumerate(args):
            types[k], values[k] = of(kind), value
        return of(interface).getMethod(method, types).invoke(target, values)

    factory, text, shrink = jvm.java.lang.management.ManagementFactory, "java.lang.String", "MaxHeapFreeRatio"
    flags = "com.sun.management.HotSpotDiagnosticMXBean"
    was = None
    with contextlib.suppress(Py4JError, TypeError):
        bean = factory.getPlatformMXBean(of(flags))
        was = call(flags, bean, "getVMOption", (text, shrink)).getValue()
        least = call(flags, bean, "getVMOption", (text, "MinHeapFreeRatio")).getValue()
        call(flags, bean, "setVMOption", (text, shrink), (text, str(min(int(was), int(least) + 5))))
    try:
        jvm.System.gc()
    finally:
        if was is not None:
            with contextlib.suppress(Py4JError, TypeError):
                call(flags, bean, "setVMOption", (text, shrink), (text, was))
    with contextlib.suppress(Py4JError, TypeError):
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        none = (("[Ljava.lang.Object;", new(jvm.java.lang.Object, 0)), ("[Ljava.lang.String;", new(jvm.java.lang.String, 0)))
        call("javax.management.MBeanServerConnection", factory.getPlatformMBeanServer(), "invoke", ("javax.management.ObjectName", name), (text, "systemTrimNativeHeap"), *none)
    trim()


def buckets_for(rows: int, per_bucket: int = 4096, least: int = 64) -> int:
    """A power of two of buckets, each with about ``per_bucket`` rows."""
    n = least
    while n * per_bucket < rows:
        n *= 2
    return n


def dealt(df: DataFrame, keys: list[str], each: int = 250_000) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as keep each at about ``each`` rows, the session's number at least.

    Rows that compress well look small to the session, which would put
    millions of them into one task's sorts and hash tables.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-df.count() // each)), *keys)


def prefix_sums(df: DataFrame, groups: list[str], key: Column, order: list[Column], n_buckets: int, value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the group's rows before this one, in the order of (bucket of ``key``, ``order``).

    Rows are summed inside (group, bucket), and each bucket starts where the
    buckets before it end, so that no task holds a whole group. Only the
    sums by bucket meet in one task for each group.
    """
    b = f"__{out}_bucket"
    src = df.withColumn(b, F.pmod(key, F.lit(n_buckets)).cast("int")).withColumn("__v", value)
    sums = src.groupBy(*groups, b).agg(F.sum("__v").alias("__n"))
    before = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"__g_{g}") for g in groups], F.col(b).alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inner = Window.partitionBy(*groups, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = src.withColumn("__in", F.coalesce(F.sum("__v").over(inner), F.lit(0)))
    cond = F.col(b) == F.col("__b")
    for g in groups:
        cond = cond & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return summed.join(starts, cond).withColumn(out, F.col("__start") + F.col("__in")).drop(b, "__b", "__v", "__in", "__start", *[f"__g_{g}" for g in groups])


def ranked(df: DataFrame, groups: list[str], key: Column, order: list[Column], n_buckets: int, out: str) -> DataFrame:
    """Adds ``out``: gapless numbers from 0 within ``groups``, without a task that holds a group."""
    return prefix_sums(df, groups, key, order, n_buckets, F.lit(1).cast("long"), out)
