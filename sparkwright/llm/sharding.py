"""Sharding by balanced label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, running, small, text_of

BIG = 16


def balanced_shards(docs: DataFrame, shards: int = 8, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, size, text_crc32, shard, slot, group. Shard sizes in bytes are equal to within one document.

    Documents with equal texts are linked. They start in the shard their id hashes to. In every round the linked
    documents count, by a join with the tallies of their group, their neighbours' bytes in each shard, and those
    outside the heaviest one ask to move there. A shard accepts what its quota (an equal share of all bytes less
    its load, plus what leaves it) allows: a hash of the group and round decides, or of the document where a group is
    too large to move whole. Cut links fall, sizes stay under quota. Then what exceeds a shard's share, in an order
    that keeps groups together and puts the largest last, is dealt with all unlinked documents into the shards' gaps
    by a distributed running sum. Only a group larger than the room left by others is cut.

    Null text: 0 bytes, so size 1; it equals the empty text. Rows that repeat an id are separate documents of one
    group. An empty table gives an empty result. Other columns of docs are not read.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(text, F.lit(1)))).alias("g"))
    rows = materialise(rows.withColumn("u", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")))), "shard-rows")
    groups = materialise(rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("n > 1").select("g", "bytes"), "shard-groups")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    share = total / shards
    marked = materialise(rows.join(groups, "g", "left").withColumn("shard", F.pmod("u", F.lit(shards)).cast("int")), "shard-start")
    linked, single = marked.filter("bytes is not null"), marked.filter("bytes is null")

    for t in range(rounds):
        tally = linked.groupBy("g", "shard").agg(F.sum("size").alias("here"))
        # the heaviest shard of each group; ties go to the shard with the smallest hash
        best = tally.groupBy("g").agg(F.max(F.struct("here", F.xxhash64("g", "shard").alias("tie"), "shard")).alias("b")).select("g", F.col("b.shard").alias("to"))
        best = materialise(best, "shard-best")
        wish = linked.join(best, "g")
        flow = {(r["shard"], r["to"]): r["n"] for r in wish.groupBy("shard", "to").agg(F.sum("size").alias("n")).collect()}  # at most shards x shards rows
        asked = {s: sum(n for (a, b), n in flow.items() if b == s and a != s) for s in range(shards)}
        if not any(asked.values()):
            break
        load = {s: sum(n for (a, b), n in flow.items() if a == s) for s in range(shards)}
        gone = {s: sum(n for (a, b), n in flow.items() if a == s and b != s) for s in range(shards)}
        odds = [min(1.0, max(0.0, share - load[s] + gone[s]) / asked[s]) if asked[s] else 1.0 for s in range(shards)]
        chance = F.element_at(F.array(*[F.lit(x) for x in odds]), F.col("to") + 1)
        draw = F.when(F.col("bytes") <= share / BIG, F.xxhash64("g", F.lit(t))).otherwise(F.xxhash64("u", F.lit(t)))
        take = F.pmod(draw, F.lit(1_000_000)) < chance * 1_000_000
        linked = materialise(wish.withColumn("shard", F.when(take, F.col("to")).otherwise(F.col("shard"))).drop("to"), "shard-moved")

    placed = running(linked.select("id", "size", "crc", "g", "u", "bytes", "shard"), "shard", ["bytes", "g", "u", "id"], "size", "shard-linked")
    placed = materialise(placed, "shard-kept")
    stay, over = placed.filter(F.col("cum") <= share), placed.filter(F.col("cum") > share)
    kept = {r["shard"]: (r["n"], r["b"]) for r in stay.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    pool = over.select("id", "size", "crc", "g", "u").withColumn("single", F.lit(0)).union(single.select("id", "size", "crc", "g", "u", F.lit(1)))
    pool = pool.withColumn("all", F.lit(0)).withColumn("order", F.when(F.col("single") == 1, F.col("u").cast("string")).otherwise(F.col("g")))
    dealt = running(pool, "all", ["single", "order", "u", "id"], "size", "shard-pool")
    # the gaps of the shards, one after another, on the line of the pool's bytes; a document goes where its middle lies
    ends, at = [], 0.0
    for s in range(shards - 1):
        at += max(0.0, share - kept.get(s, (0, 0))[1])
        ends.append(at)
    middle = F.col("cum") - F.col("size") / 2
    shard = F.aggregate(F.array(*[F.lit(x) for x in ends]), F.lit(0), lambda n, x: n + F.when(middle > x, 1).otherwise(0)) if ends else F.lit(0)
    dealt = materialise(dealt.withColumn("shard", shard.cast("int")), "shard-dealt")
    first = {r["shard"]: r["r"] for r in dealt.groupBy("shard").agg(F.min("rank").alias("r")).collect()}
    offset = F.element_at(F.array(*[F.lit(kept.get(s, (0, 0))[0] - first.get(s, 0)).cast("long") for s in range(shards)]), F.col("shard") + 1)
    cols = ["id", "size", "crc", "shard", "slot", "g"]
    out = stay.withColumn("slot", F.col("rank")).select(cols).union(dealt.withColumn("slot", F.col("rank") + offset).select(cols))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"), F.col("g").alias("group"))
