"""Queries of array windows, spans, token layouts and sequence tasks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.text import sentences, tokens
from ..operators import windows as W
from .registry import query, rounded, table

SERIES = "with v as (select user_id, list(value order by ts, event_id) as a from events group by 1)"


@query(SERIES + """, w as (select user_id, a, unnest(range(0, cast(ceil((len(a) - 4) / 3.0::double) as bigint))) as i from v where len(a) >= 5)
select user_id, cast(i as int) as "window", round(list_sum(a[cast(i * 3 + 1 as bigint) : cast(i * 3 + 5 as bigint)]), 6) + 0.0 as total from w""")
def rolling_windows(spark, sf_dir):
    w = W.series_windows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 5, 2)
    return w.select("user_id", "window", rounded(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(SERIES + """, w as (select user_id, a, unnest(range(0, cast(ceil((len(a) - 4) / 3.0::double) as bigint))) as i from v where len(a) >= 5)
select user_id, cast(i as int) as "window", round(list_sum(a[cast(i * 3 + 1 as bigint) : cast(i * 3 + 5 as bigint)]), 6) + 0.0 as total from w""")
def rolling_windows_rows(spark, sf_dir):
    """The same windows by row frames, for series too long for an array."""
    w = W.row_windows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 5, 2)
    return w.select("user_id", "window", rounded(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("select event_id, round(lead(value, 2, 0) over (partition by user_id order by ts, event_id), 6) + 0.0 as shifted from events")
def shift_left(spark, sf_dir):
    moved = W.shift_rows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 2, F.lit(0.0))
    return moved.select("event_id", rounded(F.col("shifted")).alias("shifted"))


@query("select event_id, round(lag(value, 1, 0) over (partition by user_id order by ts, event_id), 6) + 0.0 as shifted from events")
def shift_right(spark, sf_dir):
    moved = W.shift_rows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", -1, F.lit(0.0))
    return moved.select("event_id", rounded(F.col("shifted")).alias("shifted"))


TAPER = [0.5, 1.0, 1.0, 1.0, 0.5]


@query(SERIES + f""", c as (select user_id, cast(ceil((len(a) - 4) / 3.0::double) as bigint) as n, a from v where len(a) >= 5), p as (select user_id, n, unnest(range(0, (n - 1) * 3 + 5)) as pos, a from c)
select user_id, cast(pos as int) as pos, round(a[pos + 1], 5) + 0.0 as value from p""")
def overlap_add(spark, sf_dir):
    """Windows tapered, then folded back: the series again, as far as windows cover it."""
    w = W.series_windows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 5, 2)
    taper = F.array(*[F.lit(x) for x in TAPER])
    w = w.withColumn("values", F.zip_with("values", taper, lambda x, k: x * k))
    return W.overlap_add(w, "user_id", 3, TAPER).select("user_id", "pos", rounded(F.col("value"), 5).alias("value"))


@query("""
with r as (select user_id, event_type as value, row_number() over w - 1 as ix, lag(event_type) over w as b from events window w as (partition by user_id order by ts, event_id)),
g as (select user_id, value, ix, sum(case when ix = 0 or value is distinct from b then 1 else 0 end) over (partition by user_id order by ix) - 1 as run from r)
select user_id, cast(run as bigint) as run, value, min(ix) as first, max(ix) as last, count(*) as n from g group by 1, 2, 3""")
def runs(spark, sf_dir):
    return W.runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").withColumn("run", F.col("run").cast("long"))


TAGS = """select user_id, ts, event_id, case when event_type is null then null when value is null then 'O' when value > 60 then 'B-' || event_type when value > 30 then 'I-' || event_type when value > 10 then event_type else 'O' end as tag from events"""


@query(f"""
with t as ({TAGS}), n as (select user_id, tag, row_number() over (partition by user_id order by ts, event_id) - 1 as ix, case when tag <> 'O' then regexp_replace(tag, '^[BI]-', '') end as label from t),
b as (select *, lag(label) over (partition by user_id order by ix) as before from n),
g as (select *, sum(case when coalesce(starts_with(tag, 'B-'), false) or label is distinct from before then 1 else 0 end) over (partition by user_id order by ix) as span from b)
select user_id, label, min(ix) as first, max(ix) as last from g where label is not null group by user_id, span, label""")
def bio_spans(spark, sf_dir):
    v = F.col("value")
    tag = F.when(F.col("event_type").isNull(), None).when(v.isNull(), "O").when(v > 60, F.concat(F.lit("B-"), "event_type")).when(v > 30, F.concat(F.lit("I-"), "event_type")).when(v > 10, F.col("event_type")).otherwise("O")
    e = table(spark, sf_dir, "events").withColumn("tag", tag)
    e = e.withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return W.tag_spans(e, "user_id", "at", "tag").select("user_id", "label", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


# token ids in the SQL: length of the token, a vocabulary that any engine has
TOK = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[''’-][\\p{L}\\p{N}_]+)*|[^\\p{L}\\p{N}_\\s]')"
IDS = f"list_transform({TOK}, lambda t: cast(len(t) + 20 as int))"


def _ids(text="text"):
    return F.transform(tokens(F.col(text)), lambda t: F.char_length(t) + S.CONTENT)


@query(f"select item_id, array_to_string(list_concat([1], {IDS}, [2]), ' ') as ids from benchmark")
def cls_sequence(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(S.cls_sequence(_ids()), " ").alias("ids"))


@query(f"""with b as (select item_id, {IDS} as a, lead({IDS}) over (order by item_id) as b from benchmark)
select item_id, array_to_string(list_concat([1], a, [2], b, [2]), ' ') as ids, cast(len(a) + len(b) + 3 as int) as n from b where b is not null""")
def paired_sequence(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", _ids().alias("a"))
    nxt = b.select((F.col("item_id")).alias("next"), F.col("a").alias("b"))
    at = W.positions(b.select("item_id"), ["item_id"], "at")
    order = at.join(at.select(F.col("item_id").alias("next"), (F.col("at") - 1).alias("at")), "at").select("item_id", "next")
    p = b.join(order, "item_id").join(nxt, "next")
    return p.select("item_id", F.array_join(S.paired_sequence(F.col("a"), F.col("b")), " ").alias("ids"), F.size(S.segment_ids(F.col("a"), F.col("b"))).alias("n"))


PAD = f"select item_id, list_resize(({IDS})[1:32], 32, 0) as p from benchmark"


@query(f"select item_id, array_to_string(p, ' ') as ids, array_to_string(list_transform(p, lambda x: cast(x <> 0 as int)), ' ') as mask from ({PAD})")
def padded_ids(spark, sf_dir):
    p = S.pad(_ids(), 32)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(p, " ").alias("ids"), F.array_join(S.padding_mask(p), " ").alias("mask"))


@query(f"""with c as (select conv_id, turn, role, {IDS} as ids from conversations),
w as (select conv_id, turn, case role when 'system' then list_concat([9], ids, [10]) when 'user' then list_concat([11], ids, [12]) else list_concat([13], ids, [14]) end as s from c)
select conv_id, array_to_string(flatten(list(s order by turn)), ' ') as ids from w group by 1""")
def multi_turn(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("ids", _ids())
    by = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "ids"))).alias("turns"))
    return by.select("conv_id", F.array_join(S.multi_turn_sequence(F.col("turns")), " ").alias("ids"))


@query(f"""with b as (select item_id, {IDS} as a from benchmark), p as (select item_id, a[1:4] as i, [a[5:6], a[7:9]] as o, a[10:] as s from b where len(a) >= 9)
select item_id, array_to_string(list_concat([1], i, [2], [15], o[1], [15], o[2], [2], s[1 : greatest(24 - 14, 0)]), ' ') as ids, '6 9' as marker_pos, '9 13' as marker_end from p""")
def decision_sequence(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", _ids().alias("a")).filter("size(a) >= 9")
    a = F.col("a")
    d = S.decision_sequence(F.slice(a, 1, 4), F.array(F.slice(a, 5, 2), F.slice(a, 7, 3)), F.slice(a, F.lit(10), F.size(a)), 24)
    return b.select("item_id", d.alias("d")).select("item_id", F.array_join("d.ids", " ").alias("ids"), F.array_join("d.marker_pos", " ").alias("marker_pos"), F.array_join("d.marker_end", " ").alias("marker_end"))


SENT = """with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as s from documents)"""


@query(SENT + ", p as (select doc_id, s, unnest(range(1, len(s))) as i from s) select doc_id, i - 1 as pos, sha256(s[i] || '|' || s[i + 1]) as pair from p")
def next_sentence_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", sentences(F.col("text")).alias("s"))
    pairs = F.zip_with(F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))), F.slice("s", F.lit(2), F.size("s")), lambda a, b: F.concat(a, F.lit("|"), b))
    p = s.select("doc_id", F.posexplode(pairs).alias("pos", "pair"))
    return p.select("doc_id", F.col("pos").cast("long").alias("pos"), F.sha2(F.col("pair").cast("binary"), 256).alias("pair"))


@query(SERIES + """select user_id, array_to_string(list_transform(list_reverse(a), lambda x: round(x, 2)), ' ') as reversed_, array_to_string(list_transform(list_sort(a), lambda x: round(x, 2)), ' ') as sorted_ from v""")
def sequence_copy_reverse_sort(spark, sf_dir):
    e = W.series(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    text = lambda a: F.array_join(F.transform(a, lambda x: F.round(x, 2).cast("string")), " ")
    return e.select("user_id", text(F.reverse("values")).alias("reversed_"), text(F.array_sort("values")).alias("sorted_"))


@query("""with s as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as pos,
row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as back, row_number() over (partition by user_id order by value) - 1 as rising from events)
select a.user_id, a.pos, round(a.value, 6) + 0.0 as copied, round(b.value, 6) + 0.0 as reversed, round(c.value, 6) + 0.0 as sorted from s a join s b on a.user_id = b.user_id and a.pos = b.back join s c on a.user_id = c.user_id and a.pos = c.rising""")
def sequence_targets(spark, sf_dir):
    """Copy, reversal and sorting as rows, for series too long for an array."""
    t = W.sequence_targets(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return t.select("user_id", "pos", *[rounded(F.col(c)).alias(c) for c in ("copied", "reversed", "sorted")])


def _distorted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.hash_ids(tokens(F.col("text")), 30000).alias("ids"))


@query()
def cloze(spark, sf_dir):
    d = _distorted(spark, sf_dir).withColumn("c", S.cloze(F.col("ids"), F.col("doc_id"), 7, 30000))
    return d.select("doc_id", F.size("ids").alias("n"), F.size(F.filter("c.labels", lambda x: x >= 0)).alias("hidden"), F.size(F.filter("c.ids", lambda x: x == 3)).alias("masked"))


@query()
def replaced_token(spark, sf_dir):
    d = _distorted(spark, sf_dir).withColumn("c", S.replaced_tokens(F.col("ids"), F.col("doc_id"), 7, 30000))
    return d.select("doc_id", F.size("ids").alias("n"), F.aggregate("c.labels", F.lit(0), lambda a, x: a + x).alias("replaced"))


@query()
def token_deletion(spark, sf_dir):
    d = _distorted(spark, sf_dir).withColumn("c", S.deleted_tokens(F.col("ids"), F.col("doc_id"), 7))
    return d.select("doc_id", F.size("ids").alias("n"), F.size("c.ids").alias("kept"), F.aggregate("c.labels", F.lit(0), lambda a, x: a + x).alias("deleted_inside"))


@query()
def span_boundary(spark, sf_dir):
    """Counts and sums of all that a corrupted text holds: its ids, labels, both boundaries of the hidden tokens and their offsets."""
    d = _distorted(spark, sf_dir).withColumn("c", S.span_boundaries(F.col("ids"), F.col("doc_id"), 7, 30000))
    count = lambda field, test: F.size(F.filter(field, test))
    places = lambda field: F.aggregate(F.filter(field, lambda x: x >= 0), F.lit(0).cast("long"), lambda a, x: a + x)
    changed = F.zip_with("ids", "c.ids", lambda a, b: (a != b) & (b != S.SPECIAL["mask"]))
    return d.select(
        "doc_id", F.size("ids").alias("n"), count("c.offset", lambda x: x > 0).alias("hidden"), count("c.offset", lambda x: x == 1).alias("spans"), count("c.ids", lambda x: x == S.SPECIAL["mask"]).alias("masked"),
        count(changed, lambda x: x).alias("replaced"), count("c.labels", lambda x: x >= 0).alias("labelled"), places("c.left").alias("left"), places("c.right").alias("right"),
    )


@query()
def text_infilling(spark, sf_dir):
    d = _distorted(spark, sf_dir).withColumn("c", S.infilled_spans(F.col("ids"), F.col("doc_id"), 7))
    return d.select("doc_id", F.size("ids").alias("n"), F.size("c.ids").alias("kept"), F.size(F.filter("c.labels", lambda x: x >= 0)).alias("spans"))


@query(SERIES + """, t as (select user_id, a as p, list_concat(a[2:], a[1:1]) as q from v)
select user_id, round(list_sum(list_transform(list_zip(p, q), lambda z: cast(z[1] = z[2] as int))) / len(p)::double, 6) + 0.0 as accuracy, list_bool_and(list_transform(list_zip(p, q), lambda z: z[1] = z[2])) as exact from t""")
def token_accuracy(spark, sf_dir):
    e = W.shift_rows(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value", 1, wrap=True)
    return W.row_accuracy(e, ["user_id"], "value", "shifted").select("user_id", rounded(F.col("accuracy")).alias("accuracy"), "exact")


@query("""with o as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as ix, count(*) over () as n from orders)
select o_orderkey, cast(case when ix >= round(0.8::double * n) then 2 when ix >= round(0.6::double * n) then 1 else 0 end as int) as part from o""")
def split_rows(spark, sf_dir):
    return W.ordered_split(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], [0.6, 0.2, 0.2]).select("o_orderkey", "part")
