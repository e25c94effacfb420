"""A training-data pipeline over documents: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a DataFrame, which is stored as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm.content_dedup import exact_dedup
from sparkwright.llm.mixing import digest, mix_sources, number_repeats
from sparkwright.llm.packing import pack_documents
from sparkwright.llm.queries import tokenizer_path
from sparkwright.llm.shared import lean_batches, mark, materialise, release, shared_folder
from sparkwright.llm.simhash import simhash_components
from sparkwright.llm.toxicity import score_toxicity


def _key(text: Column) -> Column:
    """Tells rows apart by id and content. Orders as doc_id does, null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _rows_of(docs: DataFrame, kept: DataFrame, text: Column) -> DataFrame:
    """The rows of docs whose key (over `text`) is in kept: one row for a key, even where rows repeat it.

    Nearly every document has its key in kept, so the table grows with the input: a merge join at every size, never a broadcast.
    The row travels as one struct, so that no column of docs can clash with the key.
    """
    names = ["none", "id", "a", "b"]
    kept = materialise(kept.select(F.col("_key.*")).toDF(*names), "kept").hint("merge")
    keyed = docs.select(F.struct("*").alias("row"), _key(text).alias("key")).select("row", "key.*")
    out = keyed.join(kept, names, "left_semi")
    again = materialise(keyed.groupBy(*names).count().filter("count > 1").select(*names), "again")
    if not again.isEmpty():
        out = out.join(again, names, "left_anti").unionByName(out.join(again, names, "left_semi").dropDuplicates(names))
    return out.select("row.*")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Tables written before the first stage belong to others; each later stage removes those of the stages before it.
_first = [0]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go; a toxic row takes only its own repeats (same id, same text) with it.

    Null texts count as empty, as in every stage. No labels, or an empty table: nothing goes.
    """
    lean_batches(spark)  # holds for the stages that follow, too
    _first[0] = mark()
    scores = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry_text_hash=True)
    bad = materialise(scores.filter("predicted = 1").select(F.col("doc_id").alias("_bad"), F.col("th").alias("_a"), F.col("th2").alias("_b")).distinct(), "toxic")
    same = F.col("doc_id").eqNullSafe(F.col("_bad")) & (F.xxhash64(_text()) == F.col("_a")) & (F.xxhash64(F.lit(1), _text()) == F.col("_b"))
    return docs.join(bad, same, "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays (null ids last); of exact repeats of a row, one."""
    release(spark, _first[0])
    sha = F.sha2(F.translate(_text(), UPPER, UPPER.lower()).cast("binary"), 256)
    found = exact_dedup(docs).filter("kept").select("doc_id", "text_sha256").distinct()
    return _rows_of(docs, found.select(_key(F.col("text_sha256")).alias("_key")), sha)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id stays (null ids last); of ties by id, one by text hash."""
    release(spark, _first[0])
    found = simhash_components(docs.withColumn("_key", _key(_text())), radius=4, size=4, id_col="_key")
    return _rows_of(docs, found.filter("_key = component_id").select("_key").distinct(), _text())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to twice, so that the sources' words come near their targets."""
    release(spark, _first[0])
    plan = mix_sources(docs, weights=(5.0, 2.0, 1.0), share=1.5, repeats=2).filter("copies > 0")
    mark = F.struct(F.col("id").isNull(), F.coalesce("id", F.lit(0)), F.col("source").isNull(), F.coalesce("source", F.lit("")), "digest", "occurrence")
    plan = plan.withColumnRenamed("doc_id", "id").select(mark.alias("mark"), "copies")
    # nearly every document is in the plan, so it grows with the input: a merge join at every size
    plan = materialise(plan, "mix-plan").hint("merge")
    rows = docs.select(F.col("doc_id").alias("id"), "source", digest(F.col("text")).alias("digest"), F.struct("*").alias("row"))
    taken = number_repeats(rows, "mix-docs").select("row", mark.alias("mark")).join(plan, "mark")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 4096 ids."""
    release(spark, _first[0])
    return pack_documents(docs, tokenizer_path(), capacity=4096)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the classifier nor the tokenizer; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the tables between them go to the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
