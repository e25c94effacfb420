"""Queries of label validation: labels of documents, made up from events, some of them wrong in every way the rules know."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as V
from .registry import query, table

LABELS = ["view", "click", "purchase"]

# each event labels document event_id mod 1100 (some are missing); task 3 is not defined. Spans begin at event_id mod 60.
MADE = """with e as (
  select event_id, cast(event_id % 1100 as bigint) as doc_id, cast(event_id % 4 as int) as kind, event_type as label, (event_id % 104) / 100.0::double as confidence,
         cast(event_id % 60 as int) as a, cast(event_id % 60 + 5 - event_id % 7 as int) as b from events),
r as (select e.*, d.doc_id is not null as known, coalesce(d.text, '') as text from e left join documents d using (doc_id)),
sp as (
  select event_id, doc_id, text, confidence, j, s, t, label, w from (
    select event_id, doc_id, text, confidence, label, 0 as j, a as s, b as t, substr(text, a + 1, greatest(b - a, 0)) as w from r where known and kind = 0
    union all select event_id, doc_id, text, confidence, label, 1, a, b + event_id % 2, case when event_id % 3 = 0 then '' else substr(text, a + 1, greatest(b + event_id % 2 - a, 0)) end from r where known and kind = 0))"""

SQL = (
    MADE
    + """, p as (
  select doc_id, event_id, event_id % 1300 as c0, case when event_id % 5 = 0 then event_id % 1300 when event_id % 7 = 0 then doc_id else event_id % 1201 end as c1
  from r where known and kind = 2),
i as (
  select doc_id, event_id, 'sample not in dataset' as issue from r where not known
  union all select doc_id, event_id, 'unknown task' from r where known and kind = 3
  union all select doc_id, event_id, 'confidence' from r where known and kind <> 3 and confidence > 1
  union all select doc_id, event_id, 'span ' || j || ': out of range' from sp where not (s < t and t <= len(text))
  union all select doc_id, event_id, 'span ' || j || ': other text' from sp where s < t and t <= len(text) and substr(text, s + 1, t - s) <> w
  union all select doc_id, event_id, 'span ' || j || ': unknown label' from sp where label not in ('view', 'click', 'purchase')
  union all select doc_id, event_id, 'span ' || j || ': confidence' from sp where confidence > 1
  union all select doc_id, event_id, 'span 1: duplicate' from r where known and kind = 0 and event_id % 2 = 0
  union all select doc_id, event_id, 'repeated labels' from r where known and kind = 1 and event_id % 3 = 0
  union all select doc_id, event_id, 'unknown labels: ' || label from r where known and kind = 1 and label not in ('view', 'click', 'purchase')
  union all select doc_id, event_id, 'pair 0: unknown relation' from r where known and kind = 2 and label not in ('view', 'click', 'purchase')
  union all select doc_id, event_id, 'pair 1: unknown relation' from r where known and kind = 2 and label not in ('view', 'click', 'purchase')
  union all select doc_id, event_id, 'repeated candidates' from p where c0 = c1
  union all select doc_id, event_id, 'pair 0: candidate is the anchor' from p where c0 = doc_id
  union all select doc_id, event_id, 'pair 1: candidate is the anchor' from p where c1 = doc_id
  union all select doc_id, event_id, 'candidate not in dataset: ' || c from (select doc_id, event_id, unnest([c0, c1]) as c from p) where c not in (select doc_id from documents))
select cast(doc_id as varchar) as sample_id, cast(event_id as varchar) as task_id, issue from i where issue is not null
"""
)


@query(SQL)
def label_integrity(spark, sf_dir):
    """Every issue of labels of three kinds; each event is a task of its own, so that issues can be told apart."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), "text")
    current, tasks = _made(spark, sf_dir)
    return V.integrity(current, docs, tasks)


def _made(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    id_, text = F.col("event_id"), F.coalesce("text", F.lit(""))
    e = table(spark, sf_dir, "events").select(id_, (id_ % 1100).alias("doc_id"), (id_ % 4).alias("kind"), F.col("event_type").alias("label"), ((id_ % 104) / 100.0).alias("confidence"), (id_ % 60).cast("int").alias("a"), (id_ % 60 + 5 - id_ % 7).cast("int").alias("b"))
    e = e.join(docs, "doc_id", "left")
    cut = lambda s, t: F.substring(text, s + 1, F.greatest(t - s, F.lit(0)))
    more = F.col("b") + (id_ % 2).cast("int")
    span = lambda s, t, w: F.struct(s.alias("start"), t.alias("end"), w.alias("text"), F.col("label").alias("label"), F.col("confidence").alias("confidence"))
    spans = F.array(span(F.col("a"), F.col("b"), cut(F.col("a"), F.col("b"))), span(F.col("a"), more, F.when(id_ % 3 == 0, "").otherwise(cut(F.col("a"), more))))
    pair = lambda c: F.struct(c.cast("string").alias("sample_id"), F.col("label").alias("relation"), F.lit(0.5).alias("confidence"))
    second = F.when(id_ % 5 == 0, id_ % 1300).when(id_ % 7 == 0, F.col("doc_id")).otherwise(id_ % 1201)
    labels = F.when(id_ % 3 == 0, F.array("label", "label")).otherwise(F.array("label"))
    value = F.when(F.col("kind") == 0, F.to_json(F.struct(spans.alias("spans")))).when(F.col("kind") == 1, F.to_json(F.struct(labels.alias("labels")))).otherwise(F.to_json(F.struct(F.col("doc_id").cast("string").alias("anchor_id"), F.array(pair(id_ % 1300), pair(second)).alias("pairs"))))
    current = e.select(F.col("doc_id").cast("string").alias("sample_id"), id_.cast("string").alias("task_id"), value.alias("value"), "confidence")
    kinds = F.element_at(F.array(*map(F.lit, ["span", "classification", "contrastive"])), (F.col("kind") + 1).cast("int"))
    tasks = e.filter("kind < 3").select(id_.cast("string").alias("task_id"), kinds.alias("type"), (F.col("kind") == 1).alias("multi"), F.array(*map(F.lit, LABELS)).alias("labels"))
    return current, tasks


@query(MADE + """, o as (select doc_id, s, t, max(t) over (partition by doc_id order by s, t rows between unbounded preceding and 1 preceding) > s as o from sp)
select doc_id, count(*) as spans, count(*) filter (o) as overlapping from o group by 1""")
def span_overlaps(spark, sf_dir):
    """Spans of each document, and how many begin before an earlier one has ended."""
    current, _ = _made(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_id"))
    spans = current.filter(F.col("task_id").cast("long") % 4 == 0).join(docs, "sample_id", "left_semi").select("sample_id", F.explode(F.from_json("value", V.VALUE)["spans"]).alias("s")).select("sample_id", "s.*")
    out = V.overlapping(spans, ["sample_id"])
    return out.groupBy(F.col("sample_id").cast("long").alias("doc_id")).agg(F.count("*").alias("spans"), F.count_if("overlaps").alias("overlapping"))
