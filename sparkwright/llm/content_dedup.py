"""Exact dedup by content sort."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, text_of

NO_ID = -(2**63)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def folded(text: Column) -> Column:
    """text with A-Z, and nothing else, in lower case; lower() does that for texts of one byte a character, and faster."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _runs(batches):
    """Rows sorted by content and falling id: compares each text with its neighbour and describes every run of equals.

    A run's ids are held until it ends, 8 bytes each and never more than the task's rows; its text once.
    """
    pid, run = TaskContext.get().partitionId(), 0
    open_ids: list[np.ndarray] = []
    open_text, first_run = None, True

    def out(ids, keep, size, sha, edge, number, text):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(keep), pa.array(size), pa.array(sha, pa.string()), pa.array(np.full(n, edge)), pa.array(np.full(n, pid, np.int64)), pa.array(number), pa.array(text, pa.string())],
            names=["id", "keep_id", "group_size", "text_sha256", "edge", "pid", "run", "text"],
        )

    def close(last=False):
        nonlocal run, first_run
        ids = np.concatenate(open_ids)
        sha, edge, n = hashlib.sha256(open_text).hexdigest(), first_run or last, len(ids)
        head = [open_text.decode() if edge else None] + [None] * (n - 1)
        batch = out(ids, np.full(n, ids[0]), np.full(n, n, np.int64), [sha] * n, edge, np.full(n, run, np.int64), head)
        run, first_run = run + 1, False
        return batch

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, t = batch.column("id").to_numpy(), batch.column("t").cast(pa.large_binary())
        n = len(ids)
        goes_on = open_text is not None and t[0].as_py() == open_text
        same = np.r_[goes_on, pc.equal(t.slice(1), t.slice(0, n - 1)).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, bool)]
        starts = np.flatnonzero(~same)
        if not len(starts):
            open_ids.append(ids)
            continue
        if open_text is not None:
            if starts[0]:
                open_ids.append(ids[: starts[0]])
            yield close()
        done = starts[:-1] if not first_run else starts[:0]
        if first_run and len(starts) > 1:  # the task's first run has ended in its first batch
            open_ids, open_text = [ids[starts[0] : starts[1]]], t[int(starts[0])].as_py()
            yield close()
            starts, done = starts[1:], starts[1:-1]
        if len(done):
            sizes = np.diff(starts)
            sha = [hashlib.sha256(t[int(i)].as_py()).hexdigest() for i in done]
            rows = np.repeat(np.arange(len(done)), sizes)
            yield out(ids[starts[0] : starts[-1]], ids[done][rows], sizes[rows], pa.array(sha).take(pa.array(rows)), False, run + rows.astype(np.int64), [None] * len(rows))
            run += len(done)
        open_ids, open_text = [ids[starts[-1] :]], t[int(starts[-1])].as_py()
    if open_text is not None:
        yield close(last=True)


def _normalised(batches):
    for b in batches:
        t = pa.array([x.lower() for x in b.column("t").cast(pa.binary()).to_pylist()], pa.binary())  # bytes.lower() touches A-Z only
        yield pa.RecordBatch.from_arrays([b.column("p"), b.column("h"), b.column("h2"), b.column("id"), t.cast(pa.string())], names=["p", "h", "h2", "id", "t"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256. The largest id of equal texts stays.

    Texts are equal when they agree after lower-casing A-Z; null counts as empty. Splitters sampled by
    Spark range-partition the rows by content, an external sort places equals next to each other in each
    task, and each text is compared whole with its neighbour. The id is part of the splitters, so a group of
    copies larger than a task is cut over several; the runs at the ends of tasks (at most two each) are then
    joined by their whole text. Placement uses a short key of the folded text (its first characters and 128 bits of
    hash) to keep the splitters small on the driver: equal texts share it, and different texts do not, whatever
    letters beyond A-Z they differ in, so what a cut divides is always one group.

    Null ids count as the smallest id (-2^63, which no real id may be); rows that repeat both id and text are marked alike,
    and counted. Texts of any length are compared whole. An empty table gives an empty result. Other columns of docs are not
    read, so their names can't clash.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_of(text_col).alias("t")).select("id", "t", folded(F.col("t")).alias("n"))
    rows = rows.select(F.substring("n", 1, 24).alias("p"), F.xxhash64("n").alias("h"), F.xxhash64(F.lit(1), "n").alias("h2"), "id", "t")
    ranged = rows.repartitionByRange(F.col("p"), F.col("h"), F.col("h2"), F.col("id").desc())
    sorted_ = ranged.mapInArrow(_normalised, "p string, h bigint, h2 bigint, id bigint, t string").sortWithinPartitions("p", "h", "h2", "t", F.col("id").desc())
    schema = "id bigint, keep_id bigint, group_size bigint, text_sha256 string, edge boolean, pid bigint, run bigint, text string"
    runs = materialise(sorted_.select("id", "t").mapInArrow(_runs, schema), "content-runs")
    heads = runs.filter("edge and text is not null")
    whole = materialise(heads.groupBy("text").agg(F.max("keep_id").alias("k"), F.sum("group_size").alias("n"), F.collect_list(F.struct("pid", "run")).alias("at")).select("k", "n", F.explode("at").alias("at")).select("k", "n", "at.pid", "at.run"), "content-ends")
    # at most two rows for each task of the sort
    joined = runs.filter("edge").drop("keep_id", "group_size").join(F.broadcast(whole), ["pid", "run"]).select("id", F.col("k").alias("keep_id"), F.col("n").alias("group_size"), "text_sha256", "text", "edge")
    inner = runs.filter("not edge").select("id", "keep_id", "group_size", "text_sha256", "text", "edge")
    both = inner.union(joined)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).cast(kind)
    return both.select(real("id").alias(id_col), real("keep_id").alias("keep_id"), "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), "text_sha256")
