"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: The characters that separate words wherever a contract says [^\x20\x09-\x0D]+.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting that removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Spark's setting that bounds a batch handed to a Python function by its bytes, and a bound for batches of whole texts.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="sparkwright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts its lineage.

    The files outlive any executor; release() removes them once nothing reads them any more. The shuffles behind the table
    go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def lean_batches(spark: SparkSession) -> None:
    """Batches of texts stay at about BATCH_BYTES from now on.

    10 000 long texts are over 30 MB, which a task holds several times: Spark writes them, Python reads and converts them.
    """
    spark.conf.set(BATCH, BATCH_BYTES)


def give_back() -> None:
    """Return what a task has freed to the system, as its last step.

    Spark keeps Python workers for the tasks that follow, more of them than tasks run at once, and an idle one would hold its share of an executor's memory.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def mark() -> int:
    """How many tables materialise() has written so far."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Remove the tables that materialise() has written since mark(), but for the last `keep`.

    Only for callers whose results are already stored, or read nothing but the tables kept.
    """
    while len(_written) - keep > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop(since))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = 20_000) -> DataFrame:
    """Hint a broadcast for a materialised table if it has at most `limit` rows; beyond that Spark's joins do the work."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_uneven(rows: DataFrame, table: DataFrame, keys: list[str], count: str, share: int = 1000) -> DataFrame:
    """rows joined with a materialised table of one row for each key, `count` being the key's number of rows.

    A key with over 1/share of all those rows would fill one task. At most `share` keys can be that heavy, so these are
    broadcast, and the rest is dealt by key. Neither side is read for rows it doesn't give out.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    heavy = F.col(count) * share > total
    hot = F.broadcast(table.filter(heavy).limit(share))
    cold = rows.join(F.broadcast(table.filter(heavy).select(*keys).limit(share)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(table.filter(~heavy), keys))


def text_of(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words_in(text: Column) -> Column:
    """Number of words, as a long."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def running(df: DataFrame, part: str, order: list[str], weight: str, name: str) -> DataFrame:
    """Add `cum` (inclusive sum of weight) and `rank` (from 0) in each value of `part`, rows in the order of `order`.

    A range sort splits even a single huge part over all tasks. Each task sums its own stretch; the sums
    of the earlier stretches, one row for a task and part, are added afterwards. Nothing passes one task whole.
    """
    spec = df.repartitionByRange(part, *order).sortWithinPartitions(part, *order)
    schema = StructType([*df.schema.fields, *[StructField(c, LongType()) for c in ("_pid", "_cum", "_rank")]])

    def local(batches):
        pid, last, total, seen = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(part).to_numpy(zero_copy_only=False)
            cum = np.cumsum(batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64))
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            base = np.r_[0, cum[first[1:] - 1]] if len(first) > 1 else np.zeros(1, np.int64)
            rank0 = first.astype(np.int64)
            if last is not None and keys[0] == last:  # the part goes on from the batch before
                base[0] -= total
                rank0[0] -= seen
            lens = np.diff(np.r_[first, n])
            cum = cum - np.repeat(base, lens)
            rank = np.arange(n) - np.repeat(rank0, lens)
            last, total, seen = keys[-1], int(cum[-1]), int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, pid, np.int64)), pa.array(cum), pa.array(rank.astype(np.int64))], names=[*batch.schema.names, "_pid", "_cum", "_rank"])

    placed = materialise(spec.mapInArrow(local, schema), name)
    ends = placed.groupBy(F.col(part).alias("_part"), F.col("_pid").alias("_at")).agg(F.max("_cum").alias("_sum"), F.max("_rank").alias("_last"))
    before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_part", "_at", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_c0"), F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_r0"))
    # at most one row for each task and one for each change of part: bounded by the number of partitions and parts
    out = placed.join(F.broadcast(ends), (F.col(part) == F.col("_part")) & (F.col("_pid") == F.col("_at")))
    return out.select(*df.columns, (F.col("_cum") + F.col("_c0")).alias("cum"), (F.col("_rank") + F.col("_r0")).alias("rank"))


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v: any ordered type): node, root, the root being the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) as DataFrame joins until every
    component is a star around its smallest node. Each step is written out, so that a lost executor costs one step.
    Nodes without an edge are not returned.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, seen = materialise(e, name), None
    for _ in range(rounds):  # each round at least halves the longest way to a root, so 60 are never used up
        mark = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        # large-star: the larger neighbours of a node move to its smallest neighbour. A node without a
        # smaller neighbour keeps its edges as they are, so the hub of a finished star takes part in no join.
        least = materialise(e.groupBy("u").agg(F.min("v").alias("m")), name)
        moved = e.join(least.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        big = materialise(moved.union(own).filter("u <> v").distinct(), name)
        # small-star: a node and its smaller neighbours move to the smallest of these.
        least = materialise(big.groupBy("u").agg(F.min("v").alias("m")), name)
        hung = big.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
    else:
        raise RuntimeError(f"{name}: components did not settle in {rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return materialise(nodes.union(e.select("v", "v")).distinct(), name)
