"""Ranked lexical search: item tiles times document tiles by dense float64 products whose sums are exact."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .shared import materialise, text_of

EXACT = 2**53  # whole numbers below it, and so sums of them that stay below it, are exact in float64 in any order
TOP_IMPACT = 10**6  # an impact is (10^9 tf) div (1000 tf + 8 m), less than 10^9 / 1000
BLOCK_TERMS = 500_000  # terms of the items searched in one pass over the documents
ITEM_TILE = 64
DOC_TILE = 1024
SALTS = 64

#: Everything in ASCII but digits and letters separates terms; A-Z become small.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of UTF-8 bytes: maximal runs of ASCII digits and letters and of all characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TERMS).split()


def _postings(vocabulary: dict[bytes, int]):
    """(id, text) to id, n (terms with repeats) and the counts of the terms in the vocabulary; texts without terms are left out."""

    def count(batches):
        get = vocabulary.get
        for batch in batches:
            rows, sizes, which, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                terms = terms_of(text)
                if not terms:
                    continue
                found = Counter(map(get, terms))
                found.pop(None, None)
                rows.append(i)
                sizes.append(len(terms))
                which.extend(found.keys())
                tfs.extend(found.values())
                ends.append(len(which))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((which, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "term", "tf"])

    return count


def bands(weights: np.ndarray, bound: int = EXACT) -> list[slice]:
    """Cuts the terms of a tile where the sum of weight x largest impact would reach the bound."""
    out, first, total = [], 0, 0
    for i, w in enumerate(weights.tolist()):
        if total + w * TOP_IMPACT >= bound and i > first:
            out.append(slice(first, i))
            first, total = i, 0
        total += w * TOP_IMPACT
    return [*out, slice(first, len(weights))]


def item_tiles(items: list[list[int]], weights: np.ndarray, bound: int = EXACT, width: int = ITEM_TILE) -> list[tuple[int, np.ndarray, np.ndarray, list[slice]]]:
    """Tiles of at most `width` items: (first item, its terms in rising order, terms x items matrix of weights, bands).

    Items with many terms share a tile only while it stays under some 8 million cells; one item alone always fits.
    """
    out, at = [], 0
    while at < len(items):
        to, terms = at, set()
        while to < len(items) and to - at < width and (to == at or len(terms | set(items[to])) * (to - at + 1) <= 8_000_000):
            terms |= set(items[to])
            to += 1
        cols = np.array(sorted(terms), np.int64)
        matrix = np.zeros((len(cols), to - at))
        for j, item in enumerate(items[at:to]):
            own = np.searchsorted(cols, np.array(item, np.int64))
            matrix[own, j] = weights[item]
        out.append((at, cols, matrix, bands(weights[cols], bound) if len(cols) else []))
        at = to
    return out


class Best:
    """The k best (score, then smallest id, null last) of each item so far. Rows that tie with the k-th stay until the ids decide."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)  # a score of 0 is no match
        self.rows, self.size = [], 0

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least[first : first + scores.shape[1]])
        if len(doc):
            self.rows.append(np.column_stack([item + first, scores[doc, item], none[doc], ids[doc]]))
            self.size += len(doc)
            if self.size > 40 * self.k * len(self.least):
                self.settle()

    def settle(self) -> np.ndarray:
        rows = np.concatenate(self.rows) if self.rows else np.zeros((0, 4), np.int64)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        begin = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]]) if len(rows) else np.zeros(0, np.int64)
        place = np.arange(len(rows)) - np.repeat(begin, np.diff(np.r_[begin, len(rows)]))
        rows, place = rows[place < self.k], place[place < self.k]
        full = place == self.k - 1
        self.least[rows[full, 0]] = rows[full, 1]
        self.rows, self.size = [rows], len(rows)
        return rows


def _lengths(n: np.ndarray, count: int, total: int) -> np.ndarray:
    """m of each document: 100 - 90 + (90 n N) div L, in Python's integers where 64 bits might not do."""
    if len(n) and 90 * int(n.max()) * count >= 2**63:
        return np.array([10 + 90 * x * count // total for x in n.tolist()], np.int64)
    return 10 + 90 * n * count // total


def _ranked(tiles: list, items: int, count: int, total: int, k: int, doc_tile: int):
    """Postings to the task's k best documents of each item."""

    def rank(batches):
        best = Best(items, k)
        for batch in batches:
            for at in range(0, batch.num_rows, doc_tile):
                part = batch.slice(at, doc_tile)
                term, tf = part.column("term"), part.column("tf")
                lens = np.diff(term.offsets.to_numpy())
                doc, n = np.repeat(np.arange(len(lens)), lens), part.column("n").to_numpy()
                term, tf = term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy()
                impact = 10**9 * tf // (1000 * tf + 8 * _lengths(n, count, total)[doc])
                none = part.column("id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = part.column("id").fill_null(0).to_numpy()
                for first, cols, matrix, cuts in tiles:
                    if not len(cols):
                        continue
                    place = np.minimum(np.searchsorted(cols, term), len(cols) - 1)
                    own = cols[place] == term
                    tile = np.zeros((len(lens), len(cols)))
                    tile[doc[own], place[own]] = impact[own]
                    scores = np.zeros((len(lens), matrix.shape[1]), np.int64)
                    for cut in cuts:  # each product is exact in float64; what adds them up has 64 bits
                        scores += (tile[:, cut] @ matrix[cut]).astype(np.int64)
                    best.add(first, scores, ids, none)
        rows = best.settle()
        salt = np.full(len(rows), TaskContext.get().partitionId() % SALTS, np.int32)
        ids = pa.array(rows[:, 3], pa.int64(), mask=rows[:, 2] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)), ids, pa.array(rows[:, 1]), pa.array(salt)], names=["item", "id", "score", "salt"])

    return rank


def _blocks(items: DataFrame, block_terms: int):
    """The items as lists of (row number, id, terms), each list with at most block_terms terms, or one item with more."""
    part, size = [], 0
    for row in items.toLocalIterator():
        terms = sorted(set(terms_of(row["text"].encode())))
        if part and size + len(terms) > block_terms:
            yield part
            part, size = [], 0
        part.append((row["row"], row["id"], terms))
        size += len(terms)
    if part:
        yield part


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS, doc_tile: int = DOC_TILE, bound: int = EXACT,
) -> DataFrame:
    """For each item its k best documents with a score above 0: item id, rank (from 1), document id, score.

    The score is a sum of whole numbers, term weight times impact, over the item's distinct terms (BM25 with k1 = 0.8 and
    b = 0.9 in fixed point). Items are the queries and are read in blocks of bounded vocabulary, each of which searches all
    documents: whole texts become counts of the block's terms once, and the counts are then laid out as dense tiles
    of documents x terms and multiplied by tiles of terms x items. Terms are cut into bands whose sums stay below `bound`, so
    that every product is exact; bands add up in 64 bits. Each task keeps its k best of each item, ties with the k-th included
    until ids decide, and windows merge the tasks' lists in two steps. No group of rows meets in one task whole.

    Equal scores go by rising id, null ids last; rows that repeat an id are documents of their own. Null texts have no terms.
    Each row of items is ranked on its own, even where ids repeat; items without a match give no row. Ids of documents are
    whole numbers. Texts of any length are read whole. Other columns are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id_col].dataType
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    queries = materialise(items.select(F.monotonically_increasing_id().alias("row"), F.col(item_id_col).alias("id"), text_of(item_text_col).alias("text")), "search-items")
    found = []
    for block in _blocks(queries, block_terms):
        words = sorted({t for _, _, terms in block for t in terms})
        vocabulary = {w: i for i, w in enumerate(words)}
        postings = materialise(rows.mapInArrow(_postings(vocabulary), "id bigint, n bigint, term array<int>, tf array<bigint>"), "search-postings", compression="zstd")
        count, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not count:
            continue
        df = np.zeros(len(words), np.int64)  # at most as many rows as the block has terms
        for r in postings.select(F.explode("term").alias("t")).groupBy("t").count().toLocalIterator():
            df[r[0]] = r[1]
        weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        tiles = item_tiles([[vocabulary[t] for t in terms] for _, _, terms in block], weights, bound)
        best = postings.mapInArrow(_ranked(tiles, len(block), count, total, k, doc_tile), "item int, id bigint, score bigint, salt int")
        names = StructType([StructField("item", IntegerType()), StructField("query", LongType()), StructField("item_id", kind)])
        asked = spark.createDataFrame([(i, row, id_) for i, (row, id_, _) in enumerate(block)], names)
        found.append(materialise(best.join(F.broadcast(asked), "item").select("query", "item_id", "id", "score", "salt"), "search-best"))
    if not found:
        found = [spark.createDataFrame([], StructType([StructField("query", LongType()), StructField("item_id", kind), StructField("id", LongType()), StructField("score", LongType()), StructField("salt", IntegerType())]))]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    return every.select(F.col("item_id").alias(item_id_col), "rank", F.col("id").alias(id_col), "score")
