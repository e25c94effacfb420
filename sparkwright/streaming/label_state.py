"""The label log as a stream: current state, and daily counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def fold_stream(events: DataFrame) -> DataFrame:
    """Streaming log (sample_id, task_id, seq, op, value) -> an update for each key that a micro-batch touches.

    Keeps the event with the largest seq of a key, whatever order events arrive in, and counts all of them: an aggregate whose
    state Spark holds, made up in each task before the shuffle, so that a key costs one row of state and no Python.
    """
    value = F.when(~F.isnan("value"), F.col("value")).cast("double").alias("value")
    latest = F.max_by(F.struct(F.col("seq").cast("long").alias("seq"), "op", value), "seq")
    return events.groupBy("sample_id", "task_id").agg(latest.alias("e"), F.count("*").alias("revisions")).select("sample_id", "task_id", "e.seq", "e.op", "e.value", "revisions")


def _folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="sparkwright-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _drain(spark: SparkSession, out: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over all there is, each micro-batch appended with its number; exactly one file set for a batch number."""
    folder = _folder(spark, name)

    def store(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    q = out.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(store).start()
    q.awaitTermination()
    schema = StructType([*out.schema.fields, StructField("_batch", IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/out") if q.lastProgress else spark.createDataFrame([], schema)


def current_from_stream(spark: SparkSession, events: DataFrame, files_name: str = "label-stream") -> DataFrame:
    """The state after all available events, retracted keys left out: equal to the batch fold."""
    updates = _drain(spark, fold_stream(events), files_name, "update")
    last = updates.groupBy("sample_id", "task_id").agg(F.max_by(F.struct("seq", "op", "value", "revisions"), "_batch").alias("e"))
    return last.select("sample_id", "task_id", "e.*").filter("op <> 'retract'")


def daily_counts(spark: SparkSession, events: DataFrame, time: str, kind: str) -> DataFrame:
    """day, kind, n over all available events, in whatever order their files come: no watermark, as one would drop late days.

    The state is one row for a day and kind.
    """
    ts = events.withColumn("_t", F.col(time).cast("timestamp"))
    by = ts.groupBy(F.window("_t", "1 day").alias("w"), kind).agg(F.count("*").alias("n"))
    out = _drain(spark, by.select(F.to_date("w.start").alias("day"), kind, "n"), "daily", "update")
    return out.groupBy("day", kind).agg(F.max_by("n", "_batch").alias("n"))
