"""Fuzzy line dedup by MinHash: DataFrame functions, with NumPy inside the tasks for shingles, minima and exact comparison."""

from __future__ import annotations

import random
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, join_uneven, mark, materialise, release, text_of

#: A shingle starts at every character (UTF-16 unit) of a line and runs over this many, or to the line's end.
SHINGLE = 12
#: Bands and minima in each.
BANDS, ROWS = 8, 3
#: Lines that share a bucket are compared in cells of about this much weight, a line weighing 1 and 1 for each LONG characters.
CELL, LONG = 96, 4096
#: Characters that a task hashes at once (more only for a single longer line or cell), and columns multiplied at once.
CHUNK, COLUMNS = 1 << 17, 1 << 13


def normal_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ta, tb, pos, text of each non-blank line: lower case, runs of white space as one space, trimmed.

    ta and tb, two hashes of the whole text, tell apart documents that share an id. Only lines with such runs or with other
    white space than blanks meet the pattern.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("whole"))
    # hashed before the lines part: beside posexplode the whole text would be hashed again for each of its lines
    rows = rows.select("id", F.xxhash64("whole").alias("ta"), F.xxhash64(F.lit(1), "whole").alias("tb"), "whole")
    rows = rows.select("id", "ta", "tb", F.posexplode(F.split(F.lower("whole"), "\n")).alias("pos", "raw"))
    rough = F.contains("raw", F.lit("  "))
    for c in "\t\x0b\f\r":
        rough = rough | F.contains("raw", F.lit(c))
    return rows.select("id", "ta", "tb", "pos", F.trim(F.when(rough, F.regexp_replace("raw", r"\s+", " ")).otherwise(F.col("raw"))).alias("text")).filter("text <> ''")


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def shingle_hashes(units: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shingles that start at each of these units, the lines lying one behind the other.

    The units of a shingle are the digits of a polynomial, summed by doubling; behind its line's end it has zeros.
    """
    base = 0x9E3779B97F4A7C15
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    at = np.arange(len(units)) + np.repeat(np.arange(len(lengths)) * SHINGLE, lengths)
    digits = np.zeros(len(units) + SHINGLE * len(lengths), np.uint64)
    digits[at] = units.astype(np.uint64) + np.uint64(1)
    two = digits[:-1] * power(1) + digits[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    twelve = eight[:-4] * power(4) + four[8:]
    return mixed(twelve[at])


def chunks(lengths: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK units that end where a group ends; ends: the rows behind each group."""
    total, first = np.r_[0, np.cumsum(lengths)], 0
    while first < len(lengths):
        fit = np.searchsorted(total[ends], total[first] + CHUNK, "right") - 1
        last = int(ends[max(int(fit), int(np.searchsorted(ends, first, "right")))])
        yield first, last
        first = last


def units_of(column: pa.Array, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(units, lengths) of rows first .. last - 1 of a binary column of UTF-16BE text."""
    values = column.slice(first, last - first).to_pylist()
    return np.frombuffer(b"".join(values), ">u2"), np.array([len(v) // 2 for v in values], np.int64)


def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, a, b, weight, and a hash of each band's minima over the line's shingles, each minimum in an order a * h of its own."""
    rng = random.Random(1)
    factors = [np.uint32(2 * rng.randrange(1 << 30) + 1 + (1 << 31)) for _ in range(BANDS * ROWS)]
    for batch in batches:
        lengths = pc.binary_length(batch["units"]).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        bands = np.empty((BANDS, batch.num_rows), np.int64)
        for first, last in chunks(lengths, np.arange(1, batch.num_rows + 1)):
            units, sizes = units_of(batch["units"], first, last)
            h = (shingle_hashes(units, sizes) >> np.uint64(32)).astype(np.uint32)
            starts, ordered = np.cumsum(sizes) - sizes, np.empty_like(h)
            for k in range(BANDS):
                band = np.full(last - first, k + 1, np.uint64)
                for factor in factors[k * ROWS:(k + 1) * ROWS]:
                    np.multiply(h, factor, out=ordered)
                    band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(ordered, starts))
                bands[k, first:last] = band.view(np.int64)
        yield pa.RecordBatch.from_arrays([batch["rid"], batch["a"], batch["b"], pa.array(1 + lengths // LONG), *map(pa.array, bands)], names=["rid", "a", "b", "weight", *[f"b{k}" for k in range(BANDS)]])


def signed_lines(lines: DataFrame) -> DataFrame:
    """uid, weight, bucket: each distinct line (two hashes of its text, a and b) with its bands; uid is the smallest rid among its copies."""
    names = [f"b{k}" for k in range(BANDS)]
    signed = lines.select("rid", "a", "b", F.encode("text", "UTF-16BE").alias("units")).mapInArrow(minima, "rid long, a long, b long, weight long, " + ", ".join(f"{c} long" for c in names))
    nodes = signed.groupBy("a", "b").agg(F.min("rid").alias("uid"), *[F.min(c).alias(c) for c in ["weight", *names]])
    return nodes.select("uid", "weight", F.explode(F.array(*names)).alias("bucket"))


def links_in(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The first row (of this cell) that each row is linked to, by chains of exact Jaccard similarities; sets: sorted, without repeats."""
    m, sizes = len(sets), np.array([len(s) for s in sets], np.float64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), sizes.astype(np.int64))
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    change = np.r_[True, flat[1:] != flat[:-1]]
    if m == 2:
        both = len(flat) - np.count_nonzero(change)
        return np.array([0, 0 if both >= similarity * (sizes.sum() - both) else 1])
    column = np.cumsum(change) - 1
    shared = np.bincount(column)[column] > 1  # a shingle of one line adds to no intersection
    column, row = np.unique(column[shared], return_inverse=True)[1], row[shared]
    both = np.diag(sizes)
    for low in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        held = np.zeros((m, min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
        held[row[part], column[part] - low] = 1
        both += np.where(np.eye(m, dtype=bool), 0, held @ held.T)
    linked = both >= similarity * (sizes[:, None] + sizes - both)
    label = np.arange(m)
    while True:
        lower = np.where(linked, label, m).min(1)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def links(cells: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """u, v: for each cell (cells: cell, line) links that join all its lines of an exact similarity that is high enough.

    Similarity is that of the sets of all shingles, by their 64-bit hashes; a cell's lines need to share a bucket.
    """
    def compare(batches):
        rest = None
        for batch in batches:
            table = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            cell = table["cell"].to_numpy(zero_copy_only=False)
            ends = np.r_[np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
            whole = int(ends[-2]) if len(ends) > 1 else 0
            if whole:
                yield found(table.slice(0, whole), ends[:-1])
            rest = table.slice(whole)
        if rest is not None and rest.num_rows:
            yield found(rest, np.array([rest.num_rows]))

    def found(table, ends):
        line, u, v = table["line"].to_numpy(zero_copy_only=False), [], []
        lengths = pc.binary_length(table["units"]).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        ends = np.asarray(ends)
        for first, last in chunks(lengths, ends):
            units, sizes = units_of(table["units"], first, last)
            h = np.split(shingle_hashes(units, sizes), np.cumsum(sizes)[:-1])
            start = first
            for end in ends[(ends > first) & (ends <= last)]:
                if end - start > 1:
                    root = links_in([np.unique(x) for x in h[start - first:end - first]], similarity)
                    node = np.flatnonzero(root != np.arange(end - start))
                    u.append(line[start + node])
                    v.append(line[start + root[node]])
                start = end
        pair = [np.concatenate([np.empty(0, np.int64), *x]) for x in (u, v)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["u", "v"])

    rows = cells.join(texts.hint("merge"), "line").select("cell", "line", "units").repartition("cell").sortWithinPartitions("cell")
    return rows.mapInArrow(compare, "u long, v long").filter("u <> v")


def similar_lines(lines: DataFrame, similarity: float) -> DataFrame:
    """node, root: the components of similar lines; lines without a link are left out. lines: rid, a, b, text.

    Lines that agree in a band meet in a bucket; of buckets with the same members one is enough. A bucket is dealt over cells,
    within which all lines are compared exactly, and the smallest lines of the cells with the smallest of all. After union-find,
    in buckets of several cells that still hold different components, the lines outside the most frequent one are compared with
    all the others, block by block. So every pair that the banding proposes is either compared or joined by a chain of links
    already. With 8 bands of 3, a pair of similarity 0.8 meets with probability 0.997.
    """
    signed = signed_lines(lines).repartition("bucket")  # one shuffle, from which the buckets are counted and filled
    prints = [F.bit_xor(F.xxhash64(F.lit(k), "uid")).alias(f"f{k}") for k in range(2)]
    shared = signed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("weight").alias("size"), F.min("uid").alias("low"), F.max("uid").alias("high"), *prints).filter("low <> high")
    shared = shared.groupBy("n", "size", "low", "high", "f0", "f1").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("size") / CELL).cast("int").alias("cells"))
    members = signed.join(shared.hint("merge"), "bucket").select("bucket", F.col("uid").alias("line"), "weight", "cells", F.pmod(F.xxhash64("uid"), "cells").cast("int").alias("sub"))
    members = materialise(members, "line-members")
    partners = members.select(F.col("line").alias("rid")).distinct().hint("merge")  # grows with the input: a merge join at every size
    texts = materialise(lines.join(partners, "rid", "left_semi").select(F.col("rid").alias("line"), F.encode("text", "UTF-16BE").alias("units")), "line-texts", compression="zstd")

    heads = members.filter("cells > 1").groupBy("bucket", "cells", "sub").agg(F.min("line").alias("line"))
    tops = heads.groupBy("bucket", "cells").agg(F.min("line").alias("line")).withColumn("block", F.explode(F.sequence(F.lit(0), ((F.col("cells") - 1) / CELL).cast("int"))))
    heads = heads.withColumn("block", (F.col("sub") / CELL).cast("int"))
    cells = members.select(F.xxhash64("bucket", "sub").alias("cell"), "line")
    for extra in (heads, tops):
        cells = cells.union(extra.select(F.xxhash64("bucket", F.lit("heads"), "block").alias("cell"), "line"))
    found = components(links(cells, texts, similarity), "line-classes")

    known = members.filter("cells > 1").join(found.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
    known = materialise(known, "line-known")
    sizes = known.groupBy("bucket", "root").agg(F.sum("weight").alias("w")).groupBy("bucket").agg(F.max_by("root", F.struct("w", "root")).alias("main"), (F.sum("w") - F.max("w")).alias("others"))
    still = known.join(sizes.filter("others > 0").select("bucket", "main", F.ceil(F.col("others") / CELL).cast("int").alias("pieces")), "bucket")
    still = materialise(still, "line-open")
    home = still.select("bucket", "sub", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "line")
    guests = still.filter("root <> main").select("bucket", F.pmod(F.xxhash64("line", F.lit(7)), "pieces").cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("sub"), "line")
    cells = home.unionByName(guests).select(F.xxhash64("bucket", "sub", "piece").alias("cell"), "line")
    bridges = materialise(links(cells, texts, similarity).distinct(), "line-bridges")
    if not bridges.isEmpty():
        found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(bridges), "line-classes")
    return found


def line_classes(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines, classes). lines: rid, id, ta, tb, pos, text, a, b for each non-blank line; classes: node, root for lines with a link.

    Equal lines share a and b, 128 bits of hash, and are one node: the smallest rid among them.
    """
    rows = normal_lines(docs, id_col, text_col)
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "*", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    lines = materialise(rows, "line-rows", compression="zstd")
    return lines, similar_lines(lines, similarity)


def dedup_lines(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input row with its columns, and n_lines, n_dropped, and clean_text: the text without lines that another one stands for.

    Of each component of similar lines the first one stays, by document id (nulls last), then text hash, then place; blank lines
    stay. Lines are compared after folding case and white space, texts of any length whole. Null text: n_lines 0 and an empty
    clean_text. Rows that share an id, null included, are told apart by their texts; exact repeats of a row get equal results.
    Input columns of any other name are passed on untouched; those named n_lines, n_dropped or clean_text are replaced.
    An empty table gives an empty result.
    """
    since = mark()
    lines, classes = line_classes(docs, similarity, id_col, text_col)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "ta", "tb", "pos")
    nodes = lines.select("rid", "a", "b", place.alias("at")).groupBy("a", "b").agg(F.min("rid").alias("node"), F.min("at").alias("first"), F.count("*").alias("n"))
    nodes = materialise(nodes.join(classes, "node", "left").select("a", "b", "n", "first", "root"), "line-nodes")
    alone = nodes.filter("root is null and n > 1").select("a", "b", "n", "first")
    rooted = nodes.filter("root is not null")
    firsts = materialise(rooted.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("nodes")), "line-firsts")
    rooted = join_uneven(rooted, firsts, ["root"], "nodes").select("a", "b", "n", F.col("best").alias("first"))
    firsts = materialise(alone.unionByName(rooted), "line-first")
    narrow = lines.select("a", "b", "id", "ta", "tb", "pos")
    gone = join_uneven(narrow, firsts, ["a", "b"], "n").filter(~place.eqNullSafe(F.col("first")))
    gone = gone.groupBy("id", "ta", "tb").agg(F.collect_set("pos").alias("gone"))
    gone = materialise(gone, "line-gone").select(F.col("id").alias("gid"), F.col("ta").alias("gta"), F.col("tb").alias("gtb"), "gone")
    release(docs.sparkSession, since, keep=1)  # what follows reads the documents and the last table only

    text = text_of(text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("ta"), F.xxhash64(F.lit(1), text).alias("tb"))
    same = F.col("id").eqNullSafe(F.col("gid")) & (F.col("ta") == F.col("gta")) & (F.col("tb") == F.col("gtb"))
    rows = rows.join(gone.hint("merge"), same, "left")  # grows with the input: a merge join at every size
    raw = F.col("row").getField(text_col)
    parts, marks = F.split(raw, "\n"), F.coalesce("gone", F.array().cast("array<int>"))
    # the stretches between dropped lines, each cut out at once; split and sorted marks are bound to names, so no stretch works them out again
    ends = F.concat(F.array(F.lit(-1)), F.array_sort(marks), F.array(F.size(parts)))
    between = lambda x: F.flatten(F.transform(F.sequence(F.lit(1), F.size(x["ends"]) - 1), lambda i: F.slice(x["parts"], F.get(x["ends"], i - 1) + 2, F.get(x["ends"], i) - F.get(x["ends"], i - 1) - 1)))
    kept = F.array_join(F.get(F.transform(F.array(F.struct(parts.alias("parts"), ends.alias("ends"))), between), F.lit(0)), "\n")
    clean = F.when(F.col("gone").isNull(), F.coalesce(raw, F.lit(""))).otherwise(kept)
    n = F.when(raw.isNull(), 0).otherwise(F.size(parts))
    rows = rows.select("row", n.alias("n_lines"), F.size(marks).alias("n_dropped"), clean.alias("clean_text"))
    results = ["n_lines", "n_dropped", "clean_text"]
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in results], *results)
