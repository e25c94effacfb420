"""Ordered operators over rows: array windows of series, runs, spans, overlap-add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .signals import series_positions


def series(df: DataFrame, key: str, order: list[str], value: str, name: str = "values") -> DataFrame:
    """key and its values as an array in order. For results that are a whole series in a row; all else keeps to rows."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(key).agg(F.transform(items, lambda s: s["_v"]).alias(name))


def _placed(df: DataFrame, key: str, order: list[str], value: Column, *more: Column) -> DataFrame:
    """_key, pos, value and more: the rows of each series with their places, by range partitions.

    The key is wrapped in a struct, whose equality holds for null keys too, so that these are a series like any other.
    """
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select(F.struct(F.col(key).alias("k")).alias("_key"), *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)], value.alias("value"), *more)
    return series_positions(rows, ["_key"], names).drop(*names)


def _sizes(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.struct(F.col(key).alias("k")).alias("_key")).agg(F.count("*").alias("_n"))


def series_windows(df: DataFrame, key: str, order: list[str], value: str, size: int, overlap: int) -> DataFrame:
    """key, window (number), values: whole windows of `size` values, each sharing `overlap` with the one before.

    A row is sent to the windows it takes part in, so the largest group is one window, however long a series or however many
    rows a key has. A tail too short for a window gives none; null values keep their place.
    """
    step = size - (size - 1 if overlap >= size else overlap)
    first = F.greatest(F.ceil((F.col("pos") - size + 1) / step), F.lit(0))
    each = _placed(df, key, order, F.col(value)).select("_key", "pos", "value", F.explode(F.sequence(first, F.floor(F.col("pos") / step))).alias("window"))
    full = each.groupBy("_key", "window").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_w")).filter(F.size("_w") == size)
    return full.select(F.col("_key.k").alias(key), F.col("window").cast("int").alias("window"), F.transform("_w", lambda s: s["value"]).alias("values"))


def shift_rows(df: DataFrame, key: str, order: list[str], value: str, by: int, fill: Column | None = None, wrap: bool = False) -> DataFrame:
    """df's rows and `shifted`: the value `by` places later in the series of the same key (earlier, if by is negative).

    Each row goes to two places, its own and the one its value moves to, and places meet in one shuffle on key and place, so
    that a key with a third of all rows is spread as any other. Beyond the ends stands `fill` (null by default), or with
    `wrap` the value from the other end. A null value moves as null.
    """
    rows, to = _placed(df, key, order, F.col(value), F.struct("*").alias("row")), F.col("pos") - by
    if wrap:
        rows, to = rows.join(_sizes(df, key), "_key"), F.pmod(to, F.col("_n"))
    own = F.struct(F.col("pos").alias("at"), F.col("row").alias("row"), F.lit(None).cast(rows.schema["value"].dataType).alias("x"), F.lit(0).alias("moved"))
    moved = F.struct(to.alias("at"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.col("value").alias("x"), F.lit(1).alias("moved"))
    each = rows.select("_key", F.explode(F.array(own, moved)).alias("e")).select("_key", "e.*")
    met = each.groupBy("_key", "at").agg(F.first("row", ignorenulls=True).alias("row"), F.first("x", ignorenulls=True).alias("x"), F.max("moved").alias("moved"))
    x = F.col("x") if fill is None else F.when(F.col("moved") == 1, F.col("x")).otherwise(fill)
    return met.filter("row is not null").select("row.*", x.alias("shifted"))


def sequence_targets(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, pos, copied, reversed, sorted: the targets of the copy, reversal and sorting tasks of each series, a row for a place. Nulls sort first."""
    placed = _placed(df, key, order, F.col(value)).select("_key", "pos", "value", F.lit("copied").alias("task"))
    back = placed.join(_sizes(df, key), "_key").select("_key", (F.col("_n") - 1 - F.col("pos")).alias("pos"), "value", F.lit("reversed").alias("task"))
    rising = _placed(df, key, [value], F.col(value)).select("_key", "pos", "value", F.lit("sorted").alias("task"))
    each = placed.unionByName(back).unionByName(rising)
    met = each.groupBy("_key", "pos").agg(*[F.first(F.when(F.col("task") == t, F.col("value")), ignorenulls=True).alias(t) for t in ("copied", "reversed", "sorted")])
    return met.select(F.col("_key.k").alias(key), "pos", "copied", "reversed", "sorted")


def row_accuracy(rows: DataFrame, keys: list[str], predicted: str, target: str, mask: str | None = None) -> DataFrame:
    """keys, accuracy, exact: the share of equal tokens among the rows the mask (0/1) counts, and whether all of them are equal.

    Sequences stay rows, and each task sums its own. Null equals nothing; a sequence of which nothing counts has accuracy 0 and is exact.
    """
    counts = F.lit(1) if mask is None else F.col(mask)
    hit = F.coalesce((F.col(predicted) == F.col(target)).cast("int"), F.lit(0)) * counts
    return rows.groupBy(*keys).agg((F.sum(hit) / F.greatest(F.sum(counts), F.lit(1))).alias("accuracy"), (F.sum(hit) == F.sum(counts)).alias("exact"))


def row_windows(df: DataFrame, key: str, order: list[str], value: str, size: int, overlap: int) -> DataFrame:
    """The same windows without gathering a series: each row looks `size` rows ahead and every step-th full one is kept."""
    step = size - (size - 1 if overlap >= size else overlap)
    by = Window.partitionBy(key).orderBy(*order)
    ahead = by.rowsBetween(0, size - 1)
    rows = df.select(key, (F.row_number().over(by) - 1).alias("_at"), F.collect_list(value).over(ahead).alias("values"))
    return rows.filter((F.col("_at") % step == 0) & (F.size("values") == size)).select(key, (F.col("_at") / step).cast("int").alias("window"), "values")


def overlap_add(w: DataFrame, key: str, step: int, taper: list[float]) -> DataFrame:
    """Fold windows (key, window, values) back: key, pos, value = sum(x k) / sum(k^2), for windows already tapered by k once."""
    k = F.array(*[F.lit(float(x)) for x in taper])
    rows = w.select(key, "window", F.posexplode("values").alias("i", "x"))
    weight = F.get(k, F.col("i"))
    at = (F.col("window") * step + F.col("i")).cast("int").alias("pos")
    return rows.groupBy(key, at).agg((F.sum(F.col("x") * weight) / F.sum(weight * weight)).alias("value"))


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, run, value, first, last (row numbers from 0), n: maximal stretches of equal neighbours. Null equals null."""
    by = Window.partitionBy(key).orderBy(*order)
    rows = df.select(key, F.col(value).alias("value"), (F.row_number().over(by) - 1).alias("at"), F.lag(value).over(by).alias("_before"))
    new = F.when((F.col("at") == 0) | ~F.col("value").eqNullSafe(F.col("_before")), 1).otherwise(0)
    rows = rows.withColumn("run", F.sum(new).over(Window.partitionBy(key).orderBy("at")) - 1)
    return rows.groupBy(key, "run", "value").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))


def tag_spans(df: DataFrame, key: str, order: str, tag: str) -> DataFrame:
    """key, label, first, last: spans of B-/I-/plain tags, O and null outside. B- begins a span anew; an I- of another label too."""
    by = Window.partitionBy(key).orderBy(order)
    name = F.regexp_replace(tag, "^[BI]-", "")
    rows = df.select(key, F.col(order).alias("at"), F.when(F.col(tag) != "O", name).alias("label"), F.col(tag).startswith("B-").alias("b"), F.lag(F.when(F.col(tag) != "O", name)).over(by).alias("before"))
    new = F.when(F.col("b") | ~F.col("label").eqNullSafe(F.col("before")), 1).otherwise(0)
    rows = rows.withColumn("span", F.sum(new).over(Window.partitionBy(key).orderBy("at"))).filter("label is not null")
    return rows.groupBy(key, "span", "label").agg(F.min("at").alias("first"), F.max("at").alias("last")).drop("span")


def schedule(steps: int, start: float, stop: float, shape: str = "linear") -> Column:
    """Values of a parameter for each step from 0 to `steps`."""
    share = lambda i: i / F.lit(float(steps))
    curve = {"linear": share, "sigmoid": lambda i: 1 / (1 + F.exp(-12 * (share(i) - 0.5)))}[shape]
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.lit(start) + (stop - start) * curve(i))


def positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add each row's place in the order, from 0. Places come from counts of range partitions, not from one sorted task."""
    return series_positions(df, [], order, name)


def ordered_split(df: DataFrame, order: list[str], shares: list[float]) -> DataFrame:
    """Add `part`: 0, 1, ... by position in the order."""
    n = df.count()
    ends, at = [], 0.0
    for s in shares[:-1]:
        at += s
        ends.append(int(round(at * n)))
    part = sum([(F.col("_at") >= e).cast("int") for e in ends], F.lit(0))
    return positions(df, order, "_at").withColumn("part", part).drop("_at")
