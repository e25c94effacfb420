"""Queries of the label log. The log is events: sample = user, task = the user's event group by hour, error events retract."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import labels as L
from .registry import query, rounded, table
from .vectors import SOFT

LOG = """with log as (select cast(user_id as varchar) as sample_id, cast(event_id % 5 as varchar) as task_id, event_id as seq, case when event_type = 'error' then 'retract' else 'label' end as op, value, event_type from events),
cur as (select * from (select *, row_number() over (partition by sample_id, task_id order by seq desc) as rn from log) where rn = 1 and op <> 'retract')"""


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return _as_log(e)


def _as_log(e):
    op = F.when(F.col("event_type") == "error", "retract").otherwise("label")
    return e.select(F.col("user_id").cast("string").alias("sample_id"), (F.col("event_id") % 5).cast("string").alias("task_id"), F.col("event_id").alias("seq"), op.alias("op"), "value", "event_type")


@query(LOG + " select sample_id, task_id, seq, round(value, 6) + 0.0 as value from cur")
def label_state(spark, sf_dir):
    return L.current_state(_log(spark, sf_dir)).select("sample_id", "task_id", "seq", rounded(F.col("value")).alias("value"))


@query(LOG + " select sample_id, task_id, seq, row_number() over (partition by sample_id, task_id order by seq) as revision from log")
def label_history(spark, sf_dir):
    return L.history(_log(spark, sf_dir)).select("sample_id", "task_id", "seq", F.col("revision").cast("long").alias("revision"))


@query(LOG + " select sample_id, task_id, seq, op from log order by seq desc limit 50")
def label_events_latest(spark, sf_dir):
    return L.latest(_log(spark, sf_dir), 50).select("sample_id", "task_id", "seq", "op")


@query(LOG + ", s as (select count(distinct user_id) as samples from events) select task_id, count(*) as labelled, any_value(samples) as samples, round(count(*) / any_value(samples)::double, 6) + 0.0 as coverage, round(avg(value), 6) + 0.0 as mean_confidence from cur, s group by 1")
def coverage(spark, sf_dir):
    log = _log(spark, sf_dir)
    out = L.coverage(log.select("sample_id").distinct(), L.current_state(log).withColumn("confidence", F.col("value")))
    return out.select("task_id", "labelled", "samples", rounded(F.col("coverage")).alias("coverage"), rounded(F.col("mean_confidence")).alias("mean_confidence"))


SCORES = SOFT + """, sc as (select cast(vec_id // 4 as varchar) as sample_id, 't' || (vec_id % 4) as task_id, round(-list_sum(list_transform(p, lambda x: x * ln(x))) / ln(64), 9) as score from q)"""


def _scores(spark, sf_dir):
    """Four tasks for each sample: entropies of softmaxed vectors."""
    e = table(spark, sf_dir, "embeddings").withColumn("p", V.softmax(F.col("embedding").cast("array<double>")))
    return e.select(F.floor(F.col("vec_id") / 4).cast("string").alias("sample_id"), F.concat(F.lit("t"), F.col("vec_id") % 4).alias("task_id"), F.round(V.normal_entropy(F.col("p")), 9).alias("score"))


def _queue(name, reduce):
    def run(spark, sf_dir):
        q = L.review_queue(_scores(spark, sf_dir), 20, reduce, 0.5)
        return q.select("sample_id", rounded(F.col("score")).alias("score"), "task_id")

    sql = {"max": "max", "mean": "avg"}[reduce]
    query(SCORES + f" select sample_id, round({sql}(score), 6) + 0.0 as score, arg_min(task_id, (-score, task_id)) as task_id from sc group by 1 having {sql}(score) >= 0.5 order by {sql}(score) desc, sample_id limit 20", name)(run)


_queue("review_queue_max", "max")
_queue("review_queue_mean", "mean")


@query(SCORES + """ select sample_id, round(max(score) filter (where task_id = 't0'), 6) + 0.0 as t0, round(max(score) filter (where task_id = 't1'), 6) + 0.0 as t1, round(max(score) filter (where task_id = 't2'), 6) + 0.0 as t2, round(max(score) filter (where task_id = 't3'), 6) + 0.0 as t3,
round(max(score), 6) + 0.0 as row_max, round(avg(score), 6) + 0.0 as row_mean from sc group by 1""")
def score_pivot(spark, sf_dir):
    out = L.score_pivot(_scores(spark, sf_dir), ["t0", "t1", "t2", "t3"])
    return out.select("sample_id", *[rounded(F.col(c)).alias(c) for c in out.columns[1:]])


@query(SCORES + ", b as (select cast(least(floor(score * 10), 9) as int) as bin, count(*) as n from sc where score between 0 and 1 group by 1) select cast(i as int) as bin, coalesce(n, 0) as n from (select unnest(range(0, 10)) as i) left join b on i = bin")
def score_histogram(spark, sf_dir):
    return L.histogram(_scores(spark, sf_dir), "score")


@query("""with c as (select doc_id, quality from labels where quality = 1), n as (select doc_id, lang from documents)
select doc_id, lang from n where doc_id not in (select doc_id from c)""")
def prelabel_import(spark, sf_dir):
    """Language as a pre-label for documents without a quality label of 1."""
    done = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return L.insert_if_absent(done, table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"])


@query("""select 'unknown sample' as issue, cast(o_custkey as varchar) as id from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)
union all select 'blank text', cast(c_custkey as varchar) from customer where c_acctbal > 0 and trim(coalesce(c_mktsegment, '')) = ''
union all select 'repeated id', cast(c_custkey as varchar) from customer where c_acctbal > 0 group by c_custkey having count(*) > 1""")
def integrity_issues(spark, sf_dir):
    samples = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("text"))
    labelled = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return L.integrity_issues(samples, labelled, "id")


@query(LOG + """, w as (select sample_id, max(value) filter (where task_id = '0') as a, max(value) filter (where task_id = '1') as b from cur group by 1), s as (select distinct sample_id from log)
select sample_id, round(a, 4) as value_0, round(b, 4) as value_1 from s left join w using (sample_id)""")
def export_wide(spark, sf_dir):
    log = _log(spark, sf_dir)
    current = L.current_state(log).withColumn("confidence", F.lit(1.0))
    wide = L.export_wide(log.select("sample_id").distinct(), current, ["0", "1"])
    value = lambda t: F.round(F.get_json_object(f"{t}_labels", "$.value").cast("double"), 4)
    return wide.select("sample_id", value("0").alias("value_0"), value("1").alias("value_1"))


@query(LOG + """, j as (select sample_id, string_agg('"' || task_id || '":{' || case when value is null then '' else '"value":' || cast(value as varchar) || ',' end || '"confidence":1.0}', ',' order by task_id) as j from cur group by 1)
select '{"sample_id":"' || sample_id || '","labels":{' || j || '}}' as value from j""")
def export_jsonl(spark, sf_dir):
    return L.export_lines(L.current_state(_log(spark, sf_dir)).withColumn("confidence", F.lit(1.0)))


@query("""with r as (select doc_id, row_number() over (order by sha256('7:' || doc_id), doc_id) - 1 as at, count(*) over () as n from documents), k as (select unnest(range(1, 4)) as place)
select r.doc_id, cast(place as int) as place, c.doc_id as candidate from r, k join r c on c.at = (r.at + place) % r.n where place < r.n""")
def candidates_hash(spark, sf_dir):
    return L.candidates(table(spark, sf_dir, "documents"), "doc_id", "7", 3)


@query("""with r as (select doc_id, row_number() over (order by sha256('7:' || doc_id), doc_id) - 1 as at, count(*) over () as n from documents), k as (select unnest(range(1, 4)) as place),
f as (select r.doc_id, list(c.doc_id order by place) as fresh from r, k join r c on c.at = (r.at + place) % r.n where place < r.n group by 1),
d as (select doc_id, max(toxic) as toxic, max(quality) as quality from labels group by 1),
h as (select doc_id, case when toxic = 1 then [doc_id + 1, -1, doc_id + 2] when quality = 1 then [doc_id + 3] end as held from d),
x as (select doc_id, unnest(held) as x, generate_subscripts(held, 1) as i from h where held is not null),
l as (select x.doc_id, list(x.x order by x.i) as kept from x join documents d on d.doc_id = x.x group by 1)
select f.doc_id, array_to_string(case when h.held is not null then coalesce(l.kept, []::bigint[]) else fresh end, ' ') as candidates from f left join h using (doc_id) left join l using (doc_id)""")
def candidates_fixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    d = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    drafts = d.filter("toxic = 1").selectExpr("doc_id", "array(doc_id + 1, cast(-1 as bigint), doc_id + 2) as candidates")
    saved = d.filter("quality = 1").selectExpr("doc_id", "array(doc_id + 3) as candidates")
    out = L.fixed_candidates(L.candidates(docs, "doc_id", "7", 3), saved, drafts, docs, "doc_id")
    return out.select("doc_id", F.array_join(F.col("candidates").cast("array<string>"), " ").alias("candidates"))


@query("""with d as (select doc_id, max(toxic) as toxic, max(quality) as quality from labels group by 1)
select doc_id, round(case when toxic = 1 then 0.75::double when quality = 1 then 0.4::double else 0.5::double end, 6) + 0.0 as p, case when toxic = 1 or quality = 1 then null when toxic = 0 then 'unreadable' else 'no value' end as problem from documents left join d using (doc_id)""")
def precomputed_predictions(spark, sf_dir):
    d = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    cell = F.when(F.col("toxic") == 1, "[0.75,0.25]").when(F.col("quality") == 1, "[0.4,0.6]").when(F.col("toxic") == 0, "[2,x")
    out = L.lookup_predictions(table(spark, sf_dir, "documents"), d.withColumn("cell", cell), "cell", 2, "doc_id")
    return out.select("doc_id", rounded(F.get("probs", F.lit(0))).alias("p"), "problem")


@query("""select doc_id, case when toxic = 1 then 'toxic|clean' else '{"value":"clean","confidence":0.5}' end as cell, case when toxic = 1 then 2 else 1 end as n, case when toxic = 1 then null else 0.5::double end as confidence from labels""")
def label_cells(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    cell = F.when(F.col("toxic") == 1, "toxic|clean").otherwise('{"value":"clean","confidence":0.5}')
    p = l.select("doc_id", cell.alias("cell")).withColumn("p", L.parse_label_cell(F.col("cell")))
    return p.select("doc_id", "cell", F.size("p.values").alias("n"), F.col("p.confidence").alias("confidence"))


def _stream(spark, sf_dir):
    """events as a stream: one file a micro-batch, declared schema."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path if _is_folder(spark, path) else f"{sf_dir}/events.parque[t]")


def _is_folder(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query(LOG + ", n as (select sample_id, task_id, count(*) as revisions from log group by 1, 2) select sample_id, task_id, seq, round(value, 6) + 0.0 as value, revisions from cur join n using (sample_id, task_id)")
def stream_state(spark, sf_dir):
    out = label_state_stream(spark, sf_dir)
    return out.select("sample_id", "task_id", "seq", rounded(F.col("value")).alias("value"), "revisions")


def label_state_stream(spark, sf_dir):
    from ..streaming.label_state import current_from_stream

    return current_from_stream(spark, _as_log(_stream(spark, sf_dir)).drop("event_type"))


@query("select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2")
def stream_daily(spark, sf_dir):
    from ..streaming.label_state import daily_counts

    return daily_counts(spark, _stream(spark, sf_dir), "ts", "event_type")


@query("""select doc_id, case when toxic = 1 then 'several labels' when quality = 0 then 'unknown: bad' else '' end as problems from labels""")
def label_problems(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    values = F.when(F.col("toxic") == 1, F.array(F.lit("good"), F.lit("fine"))).when(F.col("quality") == 0, F.array(F.lit("bad"))).otherwise(F.array(F.lit("good")))
    return l.select("doc_id", F.array_join(L.label_problems(values, F.lit(0.5), ["good", "fine"], multi=False), " ").alias("problems"))


@query(LOG + ", u as (select distinct sample_id from log where cast(sample_id as bigint) % 2 = 0) select sample_id, seq from cur semi join u using (sample_id) where task_id = '1'")
def labelled_for(spark, sf_dir):
    log = _log(spark, sf_dir)
    samples = log.filter(F.col("sample_id").cast("long") % 2 == 0).select("sample_id").distinct()
    return L.labelled_for(L.current_state(log), samples, "1").select("sample_id", "seq")


@query(SCORES + ", sm as (select distinct sample_id from sc), tk as (select unnest(['t0', 't1', 't9']) as task_id) select sm.sample_id, tk.task_id, round(score, 6) + 0.0 as score, coalesce(score > 0.9, false) as labelled from sm cross join tk left join sc on sc.sample_id = sm.sample_id and sc.task_id = tk.task_id")
def score_frame(spark, sf_dir):
    sc = _scores(spark, sf_dir)
    out = L.score_frame(sc.select("sample_id").distinct(), ["t0", "t1", "t9"], sc, sc.filter("score > 0.9"))
    return out.select("sample_id", "task_id", rounded(F.col("score")).alias("score"), "labelled")


@query(LOG + ", s as (select distinct sample_id from log), d as (select sample_id from log group by 1 having max(seq) % 2 = 0) select sample_id from s where sample_id not in (select sample_id from cur) or sample_id in (select sample_id from d)")
def needs_work(spark, sf_dir):
    log = _log(spark, sf_dir)
    drafts = log.groupBy("sample_id").agg(F.max("seq").alias("m")).filter("m % 2 = 0")
    return L.needs_work(log.select("sample_id").distinct(), L.current_state(log), drafts)
