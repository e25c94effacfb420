"""SimHash near-dedup with covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, give_back, materialise, small, text_of

WHITE = bytes([32, 9, 10, 11, 12, 13])
SEED = 42
HEAVY = 512  # fingerprints in a bucket from which on they are linked by joins instead of in a task


def fingerprint(text: bytes, size: int = 4) -> int:
    """64 bits; a bit is set if it is in over half of the hashes of the shingles, repeats included."""
    words = text.lower().translate(_SPACES).split()  # bytes.lower() touches A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.r_[0, ends[:-1] + 1]
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)
    return _majority(hashes)


_SPACES = bytes.maketrans(WHITE, b" " * len(WHITE))


def _majority(hashes: np.ndarray) -> int:
    total, n = np.zeros(64, np.int64), len(hashes)
    for lo in range(0, n, 65_536):  # bounded memory for the longest texts
        part = hashes[lo : lo + 65_536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the 64 bits as a signed long) of each whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def hash_texts(batches):
        for b in batches:
            fp = np.array([fingerprint(x, size) for x in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])
        give_back()

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(hash_texts, f"id {kind}, fp bigint")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks; any two values that differ in at most `radius` bits agree under one of them.

    Each bit position gets a non-zero vector of radius+1 bits, all vectors about equally often, so that every mask keeps
    about half of the bits; mask v keeps the positions whose vector has an odd number of ones in common with v. At most `radius` differing positions cannot span all vectors, so some v is orthogonal to
    all of theirs, and its mask drops every differing bit (Pagh, CoveringLSH, 2016).
    """
    count = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if (i % count + 1 & v).bit_count() & 1) for v in range(1, count + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the classes of a[i] and b[i]; parent holds roots before and after."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        parent = _roots(parent)
    return parent


def _link_sorted(radius: int):
    """Rows sorted by bucket: compares all fingerprints of a bucket and gives the edges of a spanning forest of their links.

    Buckets have at most HEAVY rows here. The comparison runs for one distance in the sort order at a time over all
    buckets of the batch, so that small buckets cost no call of their own.
    """

    def link(batches):
        rest = np.zeros((0, 3), np.int64)
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy() for c in ("t", "key", "fp")]).astype(np.int64)
            rows = np.concatenate([rest, rows])
            new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            cut = int(new[-1]) if len(new) else 0
            rest = rows[cut:]
            yield from forest(rows[:cut])
        yield from forest(rest)

    def forest(rows):
        if len(rows) < 2:
            return
        fp = rows[:, 2].copy()
        bucket = np.r_[0, np.cumsum((rows[1:, :2] != rows[:-1, :2]).any(axis=1))]
        parent = np.arange(len(rows))
        alive = np.arange(len(rows))
        edges = []
        for lag in range(1, len(rows)):
            alive = alive[alive + lag < len(rows)]
            alive = alive[bucket[alive] == bucket[alive + lag]]
            if not len(alive):
                break
            a, b = alive, alive + lag
            near = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= radius
            a, b = a[near], b[near]
            apart = parent[a] != parent[b]
            if apart.any():
                a, b = a[apart], b[apart]
                _, one = np.unique(np.column_stack([parent[a], parent[b]]), axis=0, return_index=True)  # one edge for two classes
                a, b = a[one], b[one]
                edges.append((fp[a], fp[b]))
                parent = _union(parent, a, b)
        if edges:
            u, v = (np.concatenate(x) for x in zip(*edges, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return link


def near_components(values: DataFrame, radius: int = 4) -> DataFrame:
    """Components of distinct 64-bit values (column fp) under links between values that differ in at most `radius` bits.

    Returns node, root for every value with a link; exact, whatever the sizes of the buckets.
    """
    masks = covering_masks(radius)
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    rows = values.select("fp", table.alias("b")).select("b.t", "b.key", "fp")
    heavy = materialise(rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("rep")).filter(F.col("n") > HEAVY), "simhash-heavy")
    many = heavy.count()
    light = rows.join(small(heavy.select("t", "key")), ["t", "key"], "left_anti") if many else rows
    light = light.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    edges = light.mapInArrow(_link_sorted(radius), "u bigint, v bigint")
    if not many:
        return components(edges, "simhash-links")
    # a heavy bucket: first every value against one representative, which costs its size and joins nearly all of a
    # group of near copies; then only values of different components against each other.
    inside = materialise(rows.join(small(heavy), ["t", "key"]), "simhash-inside")
    stars = inside.select(F.col("fp").alias("u"), F.col("rep").alias("v")).filter((F.col("u") != F.col("v")) & near)
    edges = materialise(edges.union(stars).distinct(), "simhash-edges")
    found = components(edges, "simhash-links")
    known = inside.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = materialise(known, "simhash-known")
    mixed = known.groupBy("t", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("t", "key")
    mixed = small(materialise(mixed, "simhash-mixed"))
    # in each mixed bucket the values outside its largest component meet all values of other components
    parts = known.join(mixed, ["t", "key"]).groupBy("t", "key", "root").agg(F.count("*").alias("n"))
    top = small(materialise(parts.groupBy("t", "key").agg(F.max(F.struct("n", "root")).alias("m")).select("t", "key", F.col("m.root").alias("top")), "simhash-top"))
    placed = known.join(top, ["t", "key"])
    few = placed.filter("root <> top").select("t", "key", F.col("fp").alias("u"), F.col("root").alias("ru"))
    pairs = few.join(placed.select("t", "key", F.col("fp").alias("v"), F.col("root").alias("rv")), ["t", "key"]).filter((F.col("ru") != F.col("rv")) & near)
    bridges = materialise(pairs.groupBy("ru", "rv").agg(F.first("u").alias("u"), F.first("v").alias("v")).select("u", "v"), "simhash-bridges")
    return components(edges.union(bridges), "simhash-links")


def simhash_components(docs: DataFrame, radius: int = 4, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, fingerprint (16 hex digits), component_id (the smallest id reachable by links).

    Equal fingerprints form one node, so groups of copies cost one row from here on. Nodes go into the covering tables, links
    are verified on all 64 bits, and union-find joins give each node its component. Null and empty texts have fingerprint
    zero and link like any other. Rows that repeat an id are documents of their own. Null ids are ignored for the smallest id;
    a component of null ids alone has a null one. An empty table gives an empty result.
    """
    hashed = materialise(fingerprints(docs, size, id_col, text_col), "fingerprints")
    nodes = materialise(hashed.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    found = near_components(nodes.select("fp"), radius)
    member = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = materialise(member.join(least, "root").select("fp", "component_id"), "simhash-labels")
    out = hashed.join(labels, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
