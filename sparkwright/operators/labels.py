"""An append-only label log and what is read from it: current state, history, statistics, review queue, exports.

Log rows: sample_id, task_id, seq, op ('label' or 'retract'), value, confidence, annotator, ts; other columns ride along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import positions

KEYS = ["sample_id", "task_id"]
REQUIRED = ["sample_id", "task_id", "op", "seq"]


def payload_crc(df: DataFrame, columns: list[str]) -> Column:
    """CRC32 of the canonical JSON (columns by name) of an event."""
    return F.crc32(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"))


def append_events(log: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The new events numbered after the log's last seq. Numbers rise in the given order; they run over the new batch only."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    return positions(new, order, "_at").crossJoin(last).withColumn("seq", F.col("last") + F.col("_at") + 1).drop("last", "_at")


def split_valid(lines: DataFrame, schema: str, crc_of: list[str]) -> tuple[DataFrame, DataFrame]:
    """Parse JSON lines (column value): (events, quarantine). Bad JSON, a missing field or a wrong checksum is quarantined with its reason."""
    parsed = lines.withColumn("e", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    missing = F.array_compact(F.array(*[F.when(F.col(f"e.{c}").isNull(), F.lit(c)) for c in REQUIRED]))
    crc = F.crc32(F.to_json(F.struct(*[F.col(f"e.{c}").alias(c) for c in sorted(crc_of)]), {"ignoreNullFields": "false"}).cast("binary"))
    reason = F.when(F.col("e").isNull() | F.col("e._corrupt").isNotNull(), "json").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, " "))).when(F.col("e.crc").isNotNull() & (F.col("e.crc") != crc), "crc")
    marked = parsed.withColumn("reason", reason)
    return marked.filter("reason is null").select("e.*").drop("_corrupt"), marked.filter("reason is not null").select("value", "reason")


def current_state(log: DataFrame, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """The last event of each key, unless it retracts the label. A maximum by key: partial in each task, no sort of the log."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("e"))
    return last.select(*keys, "e.*").filter("op <> 'retract'")


def history(log: DataFrame, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """Every event with its place in the key's history, from 1."""
    return log.withColumn("revision", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def latest(log: DataFrame, limit: int, order: str = "seq") -> DataFrame:
    return log.orderBy(F.desc(order)).limit(limit)


def insert_if_absent(current: DataFrame, new: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows of new whose key has no current label; one for each key, the first by value."""
    fresh = new.join(current.select(*keys), keys, "left_anti")
    rest = [c for c in new.columns if c not in keys]
    return fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("e")).select(*keys, "e.*")


def integrity_issues(samples: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """issue, id: labels of unknown samples, samples without text, ids that occur twice."""
    lost = labelled.join(samples, key, "left_anti").select(F.lit("unknown sample").alias("issue"), F.col(key).cast("string").alias("id"))
    blank = samples.filter(F.trim(F.coalesce("text", F.lit(""))) == "").select(F.lit("blank text").alias("issue"), F.col(key).cast("string").alias("id"))
    twice = samples.groupBy(key).count().filter("count > 1").select(F.lit("repeated id").alias("issue"), F.col(key).cast("string").alias("id"))
    return lost.union(blank).union(twice)


def coverage(samples: DataFrame, current: DataFrame, key: str = "sample_id") -> DataFrame:
    """task_id, labelled, samples, coverage, mean_confidence."""
    n = samples.agg(F.count("*").alias("samples"))
    known = current.join(samples.select(key), key, "left_semi")
    by = known.groupBy("task_id").agg(F.count("*").alias("labelled"), F.avg("confidence").alias("mean_confidence"))
    return by.crossJoin(n).select("task_id", "labelled", "samples", (F.col("labelled") / F.col("samples")).alias("coverage"), "mean_confidence")


def review_queue(scores: DataFrame, size: int, reduce: str = "max", least: float = 0.0, done: DataFrame | None = None, key: str = "sample_id") -> DataFrame:
    """The most uncertain samples over their tasks: sample, score, task (the one that drives it). Ties by sample; a top-k, not a sort."""
    rows = scores.filter(F.col("score").isNotNull())
    if done is not None:
        rows = rows.join(done.select(key).distinct(), key, "left_anti")
    score = F.max("score") if reduce == "max" else F.avg("score")
    by = rows.groupBy(key).agg(score.alias("score"), F.min_by("task_id", F.struct(-F.col("score"), "task_id")).alias("task_id"))
    return by.filter(F.col("score") >= least).orderBy(F.desc("score"), key).limit(size)


def score_pivot(scores: DataFrame, tasks: list[str], key: str = "sample_id") -> DataFrame:
    """One row for each sample, one column for each task, and the row's maximum and mean."""
    wide = scores.groupBy(key).pivot("task_id", tasks).agg(F.max("score"))
    n = sum([F.col(t).isNotNull().cast("int") for t in tasks], F.lit(0))
    total = sum([F.coalesce(F.col(t), F.lit(0.0)) for t in tasks], F.lit(0.0))
    top = F.greatest(*tasks) if len(tasks) > 1 else F.col(tasks[0])
    return wide.withColumn("row_max", top).withColumn("row_mean", F.when(n > 0, total / n))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin, n over [0, 1]; the right edge belongs to the last bin. Empty bins have a row."""
    b = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(column).between(0, 1)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def export_wide(samples: DataFrame, current: DataFrame, tasks: list[str], key: str = "sample_id") -> DataFrame:
    """Every sample, and for each task the label cell (JSON of value and confidence), null where there is none."""
    cell = F.to_json(F.struct("value", "confidence"))
    wide = current.withColumn("cell", cell).groupBy(key).pivot("task_id", tasks).agg(F.first("cell"))
    for t in tasks:
        wide = wide.withColumnRenamed(t, f"{t}_labels")
    return samples.join(wide, key, "left")


def export_lines(current: DataFrame, key: str = "sample_id") -> DataFrame:
    """One JSON line for each sample with a label: its records by task."""
    record = F.struct("value", "confidence")
    by = current.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task_id", record.alias("r"))))).alias("labels"))
    return by.select(F.to_json(F.struct(key, "labels")).alias("value"))


def parse_label_cell(cell: Column) -> Column:
    """A cell as struct(values, confidence): JSON {"value", "confidence"}, or plain labels separated by |."""
    schema = "struct<value:string,confidence:double>"
    js = F.from_json(cell, schema)
    text = F.when(F.startswith(F.trim(cell), F.lit("{")), js["value"]).otherwise(cell)
    inner = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>")).otherwise(F.transform(F.split(text, r"\|"), lambda x: F.trim(x)))
    values = F.filter(inner, lambda x: x != "")
    return F.when(cell.isNotNull(), F.struct(values.alias("values"), F.when(F.startswith(F.trim(cell), F.lit("{")), js["confidence"]).alias("confidence")))


def prediction_report(df: DataFrame, column: str, labels: int) -> DataFrame:
    """ok, bad, missing cells: JSON arrays of as many probabilities as labels."""
    p = F.from_json(column, "array<double>")
    good = p.isNotNull() & (F.size(p) == labels) & F.forall(p, lambda x: x.between(0, 1))
    return df.agg(F.count_if(F.col(column).isNotNull() & good).alias("ok"), F.count_if(F.col(column).isNotNull() & ~F.coalesce(good, F.lit(False))).alias("bad"), F.count_if(F.col(column).isNull()).alias("missing"))


def candidates(df: DataFrame, key: str, seed: str, count: int) -> DataFrame:
    """For each sample `count` other samples (key, place, candidate): its successors on a ring ordered by a seeded hash.

    Successors come from an equality join on the place in the ring, so there is no join of all samples with all, and places
    from counts of range partitions, so no task orders all ids.
    """
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"), 256)
    size = df.count()
    ring = positions(df.select(key, h.alias("h")), ["h", key], "at")
    asked = ring.select(key, "at", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("place")).filter(F.col("place") < size)
    asked = asked.withColumn("at", (F.col("at") + F.col("place")) % size)
    return asked.join(ring.select("at", F.col(key).alias("candidate")), "at").select(key, "place", "candidate")


def fixed_candidates(fresh: DataFrame, saved: DataFrame, drafts: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """key, candidates: those of a draft, else of a saved label, else the fresh ones, so that pairs never drift.

    saved and drafts: key, candidates (array); of these, ids that are not among the samples are left out. fresh: key, place, candidate.
    """
    drawn = fresh.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "candidate"))), lambda c: c["candidate"]).alias("fresh"))
    held = drafts.select(key, "candidates", F.lit(0).alias("rank")).unionByName(saved.select(key, "candidates", F.lit(1).alias("rank")))
    held = held.groupBy(key).agg(F.min_by("candidates", "rank").alias("candidates"))
    single = held.select(key, F.posexplode("candidates").alias("place", "candidate")).join(samples.select(F.col(key).alias("candidate")).distinct(), "candidate")
    kept = single.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "candidate"))), lambda c: c["candidate"]).alias("kept"))
    out = samples.select(key).join(drawn, key, "left").join(held.select(key, F.lit(True).alias("held")), key, "left").join(kept, key, "left")
    none = F.array().cast(drawn.schema["fresh"].dataType)
    return out.select(key, F.when(F.col("held"), F.coalesce("kept", none)).otherwise(F.coalesce("fresh", none)).alias("candidates"))


def lookup_predictions(samples: DataFrame, cells: DataFrame, cell: str, labels: int, key: str = "sample_id") -> DataFrame:
    """key, probs, problem: the JSON array of probabilities of each sample's cell, or a uniform one and what was wrong."""
    p = F.from_json(F.col(cell), "array<double>")
    good = F.coalesce(p.isNotNull() & (F.size(p) == labels) & F.forall(p, lambda x: x.between(0, 1)), F.lit(False))
    total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    rows = samples.select(key).join(cells.select(key, cell), key, "left")
    probs = F.when(good & (total > 0), F.transform(p, lambda x: x / total)).otherwise(F.array_repeat(F.lit(1.0 / labels), labels))
    problem = F.when(F.col(cell).isNull(), "no value").when(~good | (total <= 0), "unreadable")
    return rows.select(key, probs.alias("probs"), problem.alias("problem"))


def is_confidence(c: Column) -> Column:
    """A number from 0 to 1; null and NaN are none."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & c.between(0, 1), F.lit(False))


def label_problems(values: Column, confidence: Column, labels: list[str], multi: bool) -> Column:
    """array<string> of what is wrong with a label: none, too many, unknown or repeated ones, a bad confidence."""
    known = F.array(*[F.lit(x) for x in labels])
    checks = [
        F.when(values.isNull() | (F.size(values) == 0), F.lit("no label")),
        F.when(F.size(values) > 1, F.lit("several labels")) if not multi else F.lit(None).cast("string"),
        F.when(F.size(F.array_except(values, known)) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(F.array_except(values, known)), " "))),
        F.when(F.size(F.array_distinct(values)) < F.size(values), F.lit("repeated label")),
        F.when(~is_confidence(confidence), F.lit("confidence")),
    ]
    return F.array_compact(F.array(*checks))


def labelled_for(current: DataFrame, samples: DataFrame, task: str, key: str = "sample_id") -> DataFrame:
    """Current labels of one task, of samples in the dataset only."""
    return current.filter(F.col("task_id") == task).join(samples.select(key), key, "left_semi")


def needs_work(samples: DataFrame, current: DataFrame, drafts: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples without a current label, or with a draft."""
    done = current.select(key).join(drafts.select(key), key, "left_anti").distinct()
    return samples.join(done, key, "left_anti")


def score_frame(samples: DataFrame, tasks: list[str], predictions: DataFrame, current: DataFrame, key: str = "sample_id") -> DataFrame:
    """A row for each sample and task: score (null without a prediction) and whether it is labelled. Tasks are a short literal list."""
    every = samples.select(key, F.explode(F.array(*[F.lit(t) for t in tasks])).alias("task_id"))
    keys = [key, "task_id"]
    marked = current.select(*keys).distinct().withColumn("labelled", F.lit(True))
    return every.join(predictions.select(*keys, "score"), keys, "left").join(marked, keys, "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))
