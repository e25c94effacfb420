"""Reading labelling datasets (CSV, JSON lines) with checks, writing them, and listing what there is."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESERVED = ("id", "sample_id", "text")


def shared_path(spark: SparkSession) -> str:
    """The folder that every executor reaches: spark.checkpoint.dir; one of our own only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="sparkwright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header required; names trimmed and lower-cased, unnamed surplus cells dropped, a byte-order mark removed. Malformed rows fail."""
    df = spark.read.option("header", True).option("multiLine", True).option("mode", "FAILFAST").option("encoding", "UTF-8").csv(path)
    names = [c.strip().lstrip("﻿").lower() for c in df.columns]
    keep = [(old, new) for old, new in zip(df.columns, names, strict=True) if new and not new.startswith("_c")]
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in keep])


def read_jsonl(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Blank lines skipped; a malformed line fails. Keys lower-cased. Without columns, names come from the file."""
    reader = spark.read.option("mode", "FAILFAST")
    df = reader.schema(", ".join(f"`{c}` string" for c in columns)).json(path) if columns else reader.option("primitivesAsString", True).json(path)
    return df.toDF(*[c.lower() for c in df.columns])


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value of the lines that are no JSON object, for the error report."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").filter(F.trim("value") != "")
    bad = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}).isNull()
    return lines.filter(bad)


def as_samples(df: DataFrame) -> DataFrame:
    """id, text, extra: needs a text column; id from id or sample_id, else from the content; blank texts dropped; other non-empty columns in a map.

    Rows without an id are named by their place in the file's parts, so that repeated texts stay apart; the names hold as long as the parts do.
    """
    if "text" not in df.columns:
        raise ValueError("the dataset has no text column")
    ids = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("id", "sample_id") if c in df.columns]
    others = [c for c in df.columns if c not in RESERVED]
    extra = F.map_from_arrays(F.array(*[F.lit(c) for c in others]), F.array(*[F.col(c).cast("string") for c in others])) if others else F.create_map().cast("map<string,string>")
    rows = df.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    name = F.coalesce(*ids, F.concat(F.lit("row"), F.monotonically_increasing_id().cast("string")))
    return rows.select(name.alias("id"), "text", F.map_filter(extra, lambda k, v: v.isNotNull() & (v != "")).alias("extra"))


def repeated_ids(samples: DataFrame) -> DataFrame:
    return samples.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a .csv or .jsonl file or folder; fails if an id occurs twice."""
    samples = as_samples(read_csv(spark, path) if path.rstrip("/").endswith(".csv") else read_jsonl(spark, path))
    if twice := repeated_ids(samples).limit(5).collect():
        raise ValueError(f"repeated ids: {[r['id'] for r in twice]}")
    return samples


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each file, to notice drift."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def column_conflicts(tasks: list[dict]) -> list[str]:
    """Problems of task columns: reserved names, and names that two tasks use."""
    problems, seen = [], {}
    for t in tasks:
        for column in (t.get("label_col") or f"{t['id']}_labels", t.get("pred_col") or f"{t['id']}_pred"):
            if column in RESERVED:
                problems.append(f"{t['id']}: {column} is reserved")
            elif column in seen and seen[column] != t["id"]:
                problems.append(f"{t['id']}: {column} belongs to {seen[column]}")
            seen.setdefault(column, t["id"])
    return problems


def presence(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n: how many rows have a value, in one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, by the writer's commit protocol: readers see all of it or none."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("errorifexists").text(path)


def read_json_or(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt): lines that don't fit the schema are set aside instead of failing the read."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).cache()
    return df.filter("_corrupt is null").drop("_corrupt"), df.filter("_corrupt is not null").select("_corrupt")


def probabilities_cell(p: Column) -> Column:
    return F.to_json(F.transform(p, lambda x: F.round(x, 6)))


def split_targets(df: DataFrame, task: str) -> DataFrame:
    """x, y from a table of features and targets, whose names begin with y: an array of doubles, and a double (regression), an int, or an array of ints (multilabel).

    Rows with a null or NaN anywhere are left out.
    """
    targets = [c for c in df.columns if c.startswith("y")]
    if not targets:
        raise ValueError("no column begins with y")
    whole = df.dropna()
    x = F.array(*[F.col(c).cast("double") for c in df.columns if c not in targets]).cast("array<double>")
    y = {"regression": F.col(targets[0]).cast("double"), "multilabel": F.array(*[F.col(c).cast("int") for c in targets])}.get(task, F.col(targets[0]).cast("int"))
    return whole.select(x.alias("x"), y.alias("y"))
