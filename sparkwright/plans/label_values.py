"""Queries of label values, predictions and decisions. Labels are a user's events of a day; the kind goes by the user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import vectors as V
from ..functions.text import tokens
from ..operators import label_values as L
from ..operators import validation
from ..sources import datasets
from .registry import query, rounded, table
from .sequences import TOK
from .vectors import WHOLE, _whole

KINDS = ["classification", "token", "span", "contrastive"]
MADE = """with e as (select user_id, cast(ts as date) as day, event_id, case when event_type = 'view' then 'O' else event_type end as name, (event_id % 7 + 1) / 8::double as c, coalesce(props, '') as w from events),
g as (select user_id, day, user_id % 4 as k, min(event_id) as seq, count(*) as n, list(name order by event_id) as names, list(c order by event_id) as cs, list(w order by event_id) as ws from e group by 1, 2) """


def _made(spark, sf_dir):
    name = F.when(F.col("event_type") == "view", L.OUTSIDE).otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.struct("event_id", name.alias("name"), ((F.col("event_id") % 7 + 1) / 8).alias("c"), F.coalesce("props", F.lit("")).alias("w")).alias("e"))
    g = e.groupBy("user_id", "day").agg(F.min("e.event_id").alias("seq"), F.array_sort(F.collect_list("e")).alias("es"))
    at = lambda x: (F.lit(0).alias("start"), F.char_length(x["w"]).alias("end"), x["w"].alias("text"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("user_id") % 4 + 1).cast("int"))
    token = F.transform("es", lambda x: F.struct(*at(x), x["name"].alias("tag"), x["c"].alias("confidence")))
    span = F.transform("es", lambda x: F.struct(*at(x), x["name"].alias("label"), x["c"].alias("confidence")))
    pair = F.transform("es", lambda x: F.struct(x["event_id"].cast("string").alias("sample_id"), x["name"].alias("relation"), x["c"].alias("confidence")))
    one, many = F.when((F.col("kind") == KINDS[0]) & (F.size("es") == 1), F.get("es.name", F.lit(0))), F.when((F.col("kind") == KINDS[0]) & (F.size("es") > 1), F.col("es.name"))
    is_ = lambda i, c: F.when(F.col("kind") == KINDS[i], c)
    value = F.to_json(F.struct(one.alias("label"), many.alias("labels"), is_(1, token).alias("tokens"), is_(2, span).alias("spans"), is_(3, pair).alias("pairs")))
    return g.withColumn("kind", kind).select("user_id", "day", "seq", "kind", F.from_json(value, validation.VALUE).alias("v"))


@query(MADE + """, s as (select *, array_to_string(list_transform(list_zip(names, ws), lambda z: z[1] || ': ' || z[2]), '; ') as spans from g),
r as (select user_id, day, string_agg(x || '×' || m, ', ' order by o) as rel from (select user_id, day, name as x, count(*) as m, min(event_id) as o from e group by 1, 2, 3) group by 1, 2)
select s.user_id, s.day, case k when 0 then array_to_string(names, ', ') when 1 then len(list_filter(names, lambda x: x <> 'O')) || ' tagged / ' || n || ' tokens'
when 2 then case when len(spans) > 80 then spans[1:77] || '…' else spans end else rel end as summary,
round(case k when 0 then 0.75::double else list_sum(cs) / n end, 4) + 0.0 as confidence from s join r using (user_id, day)""")
def label_summaries(spark, sf_dir):
    v, kind = F.col("v"), F.col("kind")
    return _made(spark, sf_dir).select("user_id", "day", L.summary(v, kind).alias("summary"), L.final_confidence(v, kind, F.lit(0.75)).alias("confidence"))


@query(MADE + """, i as (select g.seq, k, unnest(names) as name, unnest(range(0, n)) as i from g), f as (select name, count(*) as n, min((seq, i)) as o from i where not (k = 1 and name = 'O') group by 1),
d as (select unnest(['refund', 'click', 'purchase']) as name, unnest([0, 1, 2]) as pl), b as (select coalesce(d.name, f.name) as name, coalesce(n, 0) as n, coalesce(pl, 3) as pl, o from d full join f on d.name = f.name)
select row_number() over (order by pl, o) - 1 as place, name, n from b""")
def label_name_counts(spark, sf_dir):
    """Labels that no task declares come after the declared ones; a declared one that never occurs counts 0."""
    return L.label_counts(_made(spark, sf_dir), ["refund", "O", "click", "refund", "purchase"])


ENTROPY = "coalesce(list_sum(list_transform(p, lambda x: -greatest(x, 1e-12) * ln(greatest(x, 1e-12)))), 0) / ln(len(p))"


@query(f"""with s as ({WHOLE}), u as (select vec_id, vec_id % 4 as k, vec_id % 8 = 4 as multi, list_transform(range(0, 8), lambda i: v[8 * i + 1: 8 * i + 8]) as r from s),
m as (select vec_id, k, multi, unnest(case when k in (0, 3) then r[1:1] else r end) as w, unnest(range(0, case when k in (0, 3) then 1 else 8 end)) as i from u),
p as (select vec_id, k, multi, i, list_transform(w, lambda x: exp(x) / list_sum(list_transform(w, lambda y: exp(y)))) as p from m),
d as (select vec_id, p from p where not (k = 3 or (k = 0 and multi)) union all select vec_id, [1 - x, x] from (select vec_id, unnest(p) as x from p where k = 3 or (k = 0 and multi)))
select vec_id, count(*) as n, round(avg(least(1, greatest(0, {ENTROPY}))), 6) + 0.0 as uncertainty, round(sum(list_max(p)), 6) + 0.0 as top from d group by 1""")
def prediction_distributions(spark, sf_dir):
    """Uncertainty of model outputs of four kinds, from the distributions of all their decisions."""
    id_ = F.col("vec_id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (id_ % 4 + 1).cast("int"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: V.softmax(F.slice("v", i * 8 + 1, F.lit(8))))
    s = _whole(spark, sf_dir).withColumn("kind", kind).withColumn("probs", F.when(F.col("kind").isin("classification", "contrastive"), F.slice(rows, 1, 1)).otherwise(rows))
    s = s.select("vec_id", L.distributions(F.col("kind"), F.col("probs"), id_ % 8 == 4).alias("d"))
    top = F.aggregate(F.transform("d", lambda p: F.array_max(p)), F.lit(0.0), lambda a, x: a + x)
    return s.select("vec_id", F.size("d").cast("long").alias("n"), rounded(L.mean_uncertainty(F.col("d"))).alias("uncertainty"), rounded(top).alias("top"))


def _sql_ids(text: str) -> str:
    return f"list_transform({TOK.replace('text', text)}, lambda t: cast(cast('0x' || substr(sha256(t), 1, 8) as bigint) % 5000 + 20 as int))"


@query(f"""with d as (select doc_id, case doc_id % 3 when 0 then 'binary' when 1 then 'choice' else 'score' end as kind, coalesce(text, '') as st, coalesce(source, '') as src, coalesce(lang, '') as lng from documents),
q as (select doc_id, st, kind || ' Is this from ' || src || '?' as hd, case kind when 'binary' then ['false', 'true'] when 'choice' then [src, lng, 'none of both'] else list_transform(range(0, 2 + doc_id % 4), lambda i: cast(i as varchar)) end as os from d),
i as (select doc_id, {_sql_ids('hd')} as h, {_sql_ids('st')} as s, list_transform(os, lambda o: {_sql_ids('o')}) as o from q),
n as (select *, list_transform(o, lambda x: len(x) + 1) as w, flatten(list_transform(o, lambda x: list_concat([15], x))) as body from i),
a as (select doc_id, list_concat([1], h, [2], body, [2]) as head, s, len(h) + 2 as z, w from n)
select doc_id, array_to_string(list_concat(head, s[1: greatest(0, 63 - len(head))], [2]), ' ') as ids, array_to_string(list_transform(range(0, len(w)), lambda k: cast(z + coalesce(list_sum(w[1:k]), 0) as bigint)), ' ') as marker_pos,
array_to_string(list_transform(range(0, len(w)), lambda k: cast(z + list_sum(w[1:k + 1]) as bigint)), ' ') as marker_end from a""")
def typed_decisions(spark, sf_dir):
    """Yes or no, choice and level questions about each document, with the place of every option."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "source", "lang")])
    given = F.element_at(F.array(F.lit("0"), F.lit("Choice"), F.lit("SCORE")), (F.col("doc_id") % 3 + 1).cast("int"))
    d = docs.withColumn("kind", S.decision_kind(given)).withColumn("options", S.decision_options(F.col("kind"), F.array("source", "lang", F.lit("none of both")), 2 + F.col("doc_id") % 4))
    asked = F.concat(F.lit("Is this from "), "source", F.lit("?"))
    t = S.typed_decision(F.col("kind"), asked, F.col("options"), F.col("text"), lambda x: S.sha_ids(tokens(x), 5000), 64)
    return d.select("doc_id", t.alias("t")).select("doc_id", *[F.array_join(f"t.{c}", " ").alias(c) for c in ("ids", "marker_pos", "marker_end")])


@query("""select round(l_quantity + l_discount, 4) + 0.0 as total, cast(l_returnflag = 'R' as int) || ' ' || cast(l_linestatus = 'O' as int) as targets, count(*) as n from lineitem where l_tax <> 0 group by 1, 2""")
def supervised_split(spark, sf_dir):
    """Features and targets of rows without a gap; a tax of zero counts as one."""
    flag = lambda c, v: (F.col(c) == v).cast("int")
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("F0"), F.col("l_discount").alias("F1"), F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("F2"), flag("l_returnflag", "R").alias("y0"), flag("l_linestatus", "O").alias("y1"))
    xy = datasets.split_targets(df, "multilabel")
    return xy.groupBy(rounded(F.get("x", F.lit(0)) + F.get("x", F.lit(1)), 4).alias("total"), F.array_join(F.col("y").cast("array<string>"), " ").alias("targets")).agg(F.count("*").alias("n"))
