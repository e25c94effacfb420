"""Queries of what the other catalogues leave out: files written and read back, log appends, inverses, layouts, masks and codes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import chrono as C
from ..functions import sequences as S
from ..functions import vectors as V
from ..operators import boosting as B
from ..operators import label_metrics as M
from ..operators import labels as L
from ..operators import regression as R
from ..sources import datasets
from ..sources.datasets import shared_path
from .encoders import CYCLES, time_lag
from .pipeline import FeaturePipeline, expand_arrays, to_matrix
from .registry import query, rounded, table
from .sequences import IDS, _ids


def _path(spark, ending):
    return f"{shared_path(spark)}/{uuid.uuid4().hex}{ending}"


@query("select conv_id || '-' || turn as id, text, role from conversations where trim(text) <> ''")
def dataset_jsonl(spark, sf_dir):
    """A table written as JSON lines and loaded as a dataset: ids, texts and the other columns come back."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("ID"), "text", "role")
    path = _path(spark, ".jsonl")
    datasets.write_jsonl(rows, path)
    return datasets.load_dataset(spark, path).select("id", "text", F.col("extra")["role"].alias("role"))


@query("select c_custkey::varchar as id, c_name as text, c_mktsegment as segment from customer")
def dataset_csv(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(" Sample_ID "), F.col("c_name").alias("text"), F.col("c_mktsegment").alias("Segment"))
    path = _path(spark, ".csv")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return datasets.load_dataset(spark, path).select("id", "text", F.col("extra")["segment"].alias("segment"))


@query("""with l as (select event_id, event_type = 'view' as old from events)
select event_id, row_number() over (partition by old order by event_id) + case when old then 0 else (select count(*) from l where old) end as seq from l""")
def log_append(spark, sf_dir):
    """The views make the log, all other events are appended to it."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    old = F.coalesce(F.col("event_type") == "view", F.lit(False))
    empty = e.limit(0).withColumn("seq", F.lit(0).cast("long"))
    log = L.append_events(empty, e.filter(old), ["event_id"])
    return log.unionByName(L.append_events(log, e.filter(~old), ["event_id"])).select("event_id", "seq")


@query("""select coalesce(reason, 'kept') as reason, count(*) as n from (select case when event_id % 11 = 0 then 'json' when event_id % 7 = 0 then 'missing sample_id op' when event_id % 5 = 0 then 'crc' end as reason from events) group by 1""")
def log_quarantine(spark, sf_dir):
    """Events as lines of a log with checksums, some of them damaged in one of three ways, read again with the damage set aside."""
    of = ["sample_id", "task_id", "op", "value"]
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("sample_id"), F.coalesce("event_type", F.lit("none")).alias("task_id"), F.lit("label").alias("op"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("seq"))
    e = e.withColumn("crc", L.payload_crc(e, of) + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0))
    whole = F.to_json(F.struct(*of, "seq", "crc"))
    line = F.when(F.col("event_id") % 11 == 0, F.substring(whole, 1, 20)).when(F.col("event_id") % 7 == 0, F.to_json(F.struct("task_id", "value", "seq", "crc"))).otherwise(whole)
    kept, bad = L.split_valid(e.select(line.alias("value")), "sample_id string, task_id string, op string, value string, seq long, crc long", of)
    return kept.select(F.lit("kept").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _shares_sql() -> str:
    cells = []
    for name, (_, _, _, sql) in CYCLES.items():
        share = sql.format(t="ts")
        cells.append(f"round((({share}) - case when ({share}) > 1.000001 then 1 else 0 end) * {C.PARTS[tuple(name.split('_'))]!r}::double, 6) + 0.0 as {name}")
    return f"select event_id, {', '.join(cells)} from events"


@query(_shares_sql())
def calendar_values(spark, sf_dir):
    """Every cycle there and back: the sine and cosine of a time give the unit's value again."""
    t = F.col("ts")
    back = [rounded(C.cycle_value(C.cycle_angle(*C.cycle(t, *pair)), *pair)).alias("_".join(pair)) for pair in C.RATIOS]
    return table(spark, sf_dir, "events").select("event_id", *back)


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as second, 4 as formats, 0 as wrong from orders""")
def parsed_times(spark, sf_dir):
    """Dates written in several formats and read by the first that fits."""
    t = F.col("o_orderdate")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    read = [C.to_timestamp(F.date_format(t, f)) for f in ("dd.MM.yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "yyyy-MM-dd")]
    same = sum([(day(c) == day(t)).cast("int") for c in read], F.lit(0))
    second = F.date_format(C.to_timestamp(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")), "yyyy-MM-dd HH:mm:ss")
    wrong = C.to_timestamp(F.concat(F.lit("on "), day(t))).isNotNull().cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", day(read[0]).alias("day"), second.alias("second"), same.alias("formats"), wrong.alias("wrong"))


@query("""with l as (select l_orderkey, l_linenumber, (abs(epoch(l_shipdate) + (c_nationkey % 24) * 3600 - epoch(o_orderdate))::bigint % 86400) / 3600.0::double as lag
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey) select l_orderkey, l_linenumber, round(lag, 3) + 0.0 as lag from l""")
def lag_inverse(spark, sf_dir):
    e = time_lag(spark, sf_dir)
    low, high = e.agg(F.min("lag"), F.max("lag")).first()
    return e.select("l_orderkey", "l_linenumber", rounded(C.lag_decode(C.lag_encode(F.col("lag"), low, high), low, high), 3).alias("lag"))


@query("""select 0 as at, 'price' as output, 'min_max' as kind, null::int as codes union all select 1, 'day_year_sin', 'cycle', null union all select 2, 'day_year_cos', 'cycle', null
union all select 3, 'flag', 'categories', cast(least(count(distinct l_returnflag), 15) + 1 as int) from lineitem union all select 4, 'quantity', 'standard', null""")
def pipeline_layout(spark, sf_dir):
    """Where each output of a fitted pipeline lies, its kind and its number of codes."""
    df = table(spark, sf_dir, "lineitem")
    p = FeaturePipeline().min_max("l_extendedprice", "price").cycle("l_shipdate", "day", "year").categories("l_returnflag", "flag").standard("l_quantity", "quantity")
    if p.missing(df) or len(p.validate(df)) != 3 or p.fit(df).validate(df) or not p.is_fitted:
        raise ValueError("the pipeline doesn't fit the table")
    kinds, codes, numbers = p.output_types(), p.category_outputs(), set(p.numeric_outputs())
    names = list(kinds)
    if {i for i in range(len(names)) if i not in codes} != numbers or sum(w for _, _, w in p.layout()) != len(names):
        raise ValueError("the layout is torn")
    return spark.createDataFrame([(i, n, kinds[n], codes.get(i)) for i, n in enumerate(names)], "at int, output string, kind string, codes int")


@query("select vec_id, round(list_sum(list_transform(cast(embedding as double[]), lambda x, i: x * i)), 4) + 0.0 as weighted, len(embedding) as width from embeddings")
def expanded_vectors(spark, sf_dir):
    """Arrays as one column for each position, and these as a matrix row again."""
    wide = expand_arrays(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), {"embedding": 64})
    m = to_matrix(wide, [c for c in wide.columns if c != "vec_id"])
    return m.select("vec_id", rounded(F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("weighted"), F.size("features").cast("long").alias("width"))


@query("""with v as (select vec_id, label, cast(embedding as double[]) as x from embeddings),
w as (select *, list_transform(x, lambda a: exp(-(a - list_min(x)) / 0.5::double)) as e, list_transform(x, lambda a: exp(a - list_max(x))) as s from v)
select vec_id, round(list_sum(list_transform(e, lambda a: a * a)) / pow(list_sum(e), 2), 6) + 0.0 as soft, list_position(x, list_min(x)) - 1 as hard,
round(list_sum(list_transform(s, lambda a: a * a)) / pow(list_sum(s), 2), 6) + 0.0 as probabilities, round(1.0::double / (label + 1), 6) + 0.0 as even from w""")
def soft_assignments(spark, sf_dir):
    """Soft and hard assignment of scores; scores that are no distribution become one, and one stays as it is."""
    e = table(spark, sf_dir, "embeddings")
    squares = lambda p: V.bound(p, lambda a: V.dot(a, a))
    x = V.doubles(F.col("embedding"))
    hard = F.array_position(V.soft_assign(x, 0.0), F.lit(1.0)) - 1
    twice = V.bound(V.as_probabilities(x), V.as_probabilities)
    return e.select("vec_id", rounded(squares(V.soft_assign(x, 0.5))).alias("soft"), hard.alias("hard"), rounded(squares(twice)).alias("probabilities"), rounded(squares(V.uniform(F.col("label") + 1))).alias("even"))


@query("""select event_id, round(abs(value), 4) + 0.0 as power, abs(user_id // 16 - hour(ts)) + abs(user_id % 16 - day(ts)) as steps, 1.0::double * (value > 0)::int as relu, case when value > 0 then 1 else 0.1::double end as leaky, 1.0::double as linear from events""")
def levels_and_steps(spark, sf_dir):
    """Power to decibels and back, steps between places of a lattice, slopes of the piecewise linear activations."""
    e, v = table(spark, sf_dir, "events"), F.col("value")
    user = F.col("user_id")
    steps = V.lattice_distance(F.floor(user / 16), user % 16, F.hour("ts").cast("long"), F.day("ts").cast("long"))
    slopes = [V.slope_of(n, v).alias(a) for n, a in (("relu", "relu"), ("leaky_relu", "leaky"), ("linear", "linear"))]
    return e.select("event_id", rounded(V.from_decibels(V.decibels(F.abs(v))), 4).alias("power"), steps.alias("steps"), *slopes)


@query("select conv_id, turn, k, round(sin(turn * pow(10000, -2 * k / 8.0::double)), 6) + 0.0 as sine, round(cos(turn * pow(10000, -2 * k / 8.0::double)), 6) + 0.0 as cosine from conversations, (select unnest(range(0, 4)) as k)")
def position_codes(spark, sf_dir):
    """Rotary or sinusoidal codes of each turn's place in its conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(V.position_angles(F.col("turn").cast("double"), 8)).alias("k", "a"))
    return c.select("conv_id", "turn", F.col("k").cast("long").alias("k"), rounded(F.sin("a")).alias("sine"), rounded(F.cos("a")).alias("cosine"))


@query("""with v as (select vec_id, label, cast(embedding as double[]) as x from embeddings), e as (select *, list_transform(x, lambda a: exp(a - list_max(x))) as e from v),
p as (select vec_id, label, list_transform(e, lambda a: a / list_sum(e)) as p from e),
s as (select *, list_sum(list_transform(p, lambda a, i: a * (i - 1))) as expected, list_position(p, list_max(p)) - 1 as best from p)
select vec_id, round(-ln(greatest(p[label + 1], 1e-12)) + case when label % 2 = 0 then 0.5::double * pow(expected - label, 2) else 0 end, 5) + 0.0 as loss,
case label % 3 when 0 then round_even(p[2], 0) = label when 1 then best = label else round_even(expected, 0) = label end as correct from s""")
def decision_losses(spark, sf_dir):
    """All dimensions as options of a decision whose answer is the label: its loss, and whether the decoded decision is right."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("x"))
    label, valid = F.col("label"), F.transform("x", lambda _: F.lit(True))
    kind = F.element_at(F.array(*map(F.lit, ("BINARY", "CHOICE", "SCORE"))), (label % 3 + 1).cast("int"))
    loss = M.decision_loss(F.col("x"), valid, label, label % 2 == 0)
    return e.select("vec_id", rounded(loss, 5).alias("loss"), V.decision_correct(kind, V.softmax(F.col("x")), label).alias("correct"))


_MARK = S.SPECIAL


@query(f"""with c as (select conv_id, turn, {IDS} as a, list_reverse({IDS})[1 : turn + 1] as b from conversations),
k as (select *, case when len(a) + len(b) <= 24 then len(a) else least(len(a), greatest(12, 24 - len(b))) end as ka from c),
p as (select *, a[1 : ka] as pa, b[1 : greatest(24 - ka, 0)] as pb from k)
select conv_id, turn, array_to_string(list_concat([{_MARK['inst']}], a, [{_MARK['inst_end']}]), ' ') as instruction,
array_to_string(list_concat([{_MARK['sys']}], a, [{_MARK['sys_end']}, {_MARK['user']}], b, [{_MARK['user_end']}]), ' ') as system_user,
array_to_string(list_concat([{_MARK['user']}], a, [{_MARK['user_end']}, {_MARK['answer']}], b, [{_MARK['answer_end']}]), ' ') as question_answer,
array_to_string(list_concat([{_MARK['cls']}], pa, [{_MARK['sep']}], pb, [{_MARK['sep']}]), ' ') as pair from p""")
def turn_sequences(spark, sf_dir):
    """Each turn with the end of itself read backwards: as instruction, system and user, question and answer, and as a pair of at most 27 ids."""
    c = table(spark, sf_dir, "conversations").withColumn("a", _ids()).withColumn("b", F.slice(F.reverse("a"), F.lit(1), (F.col("turn") + 1).cast("int")))
    a, b = F.col("a"), F.col("b")
    made = {"instruction": S.instruction_sequence(a), "system_user": S.system_user_sequence(a, b), "question_answer": S.question_answer_sequence(a, b), "pair": S.paired_sequence(*S.fit_pair(a, b, 24))}
    return c.select("conv_id", "turn", *[F.array_join(x, " ").alias(n) for n, x in made.items()])


@query("""with m as (select avg(l_extendedprice) as m, stddev_pop(l_extendedprice) as s, avg(l_quantity) as mq, stddev_pop(l_quantity) as sq from lineitem)
select round(avg(pow(0.1::double + 0.5::double * (l_quantity - mq) / sq - (l_extendedprice - m) / s, 2)) / 2 + 0.2::double * (0.25::double * 0.6::double + 0.75::double * 0.26::double), 6) + 0.0 as loss from lineitem, m""")
def elasticnet_loss(spark, sf_dir):
    """Half the mean squared error of standardised values and the penalty of weights 0.1 and 0.5, a quarter of it by magnitude."""
    df = table(spark, sf_dir, "lineitem").withColumn("x", F.array("l_quantity"))
    return R.elasticnet_loss(df, "x", "l_extendedprice", [0.1, 0.5], penalty=0.2, alpha=0.25).select(rounded(F.col("loss")).alias("loss"))


@query(f"""with e as (select [{', '.join(f'quantile_cont(l_quantity, {i / 8}::double)' for i in range(1, 8))}] as e, avg(l_extendedprice) as m from lineitem),
b as (select len(list_filter(list_distinct(e), lambda x: x <= l_quantity)) as bin, l_extendedprice - m as r from lineitem, e),
t as (select bin, 0.2::double * avg(r) as c from b group by 1), d as (select list_sort(list_distinct(e)) as d from e)
select cast(bin as int) as bin, round(case when bin = 0 then d[1] when bin = len(d) then d[bin] else (d[bin] + d[bin + 1]) / 2 end, 6) + 0.0 as centre, round(c, 4) + 0.0 as contribution, round((select avg(abs(c)) from t), 4) + 0.0 as importance from t, d""")
def ebm_shape(spark, sf_dir):
    """The shape of a feature after one round: bin centres, contributions, and the feature's importance."""
    m = B.fit_shapes(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", bins=8, rounds=1, rate=0.2)
    rows = [(i, float(x), float(y), m.importance()["l_quantity"]) for i, (x, y) in enumerate(m.shape("l_quantity"))]
    df = spark.createDataFrame(rows, "bin int, centre double, contribution double, importance double")
    return df.select("bin", rounded(F.col("centre")).alias("centre"), rounded(F.col("contribution"), 4).alias("contribution"), rounded(F.col("importance"), 4).alias("importance"))
