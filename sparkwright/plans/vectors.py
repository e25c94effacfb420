"""Queries of distances, nearest prototypes, activations and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.categorical import arg_max, multi_hot, one_hot, round_labels
from ..functions.sequences import windows  # noqa: F401
from ..functions.text import tokens
from ..operators import cluster_metrics as M
from ..operators.nearest import label_means, nearest
from .registry import query, rounded, table

# each vector against the mean of its own label: whole table, no pairs of rows
MEANS = """
with e as (select vec_id, label, unnest(cast(embedding as double[])) as x, generate_subscripts(embedding, 1) as i from embeddings),
m as (select label, i, avg(x) as m, count(*) as n from e group by 1, 2),
c as (select label, list(m order by i) as centre, max(n) as size from m group by 1),
p as (select vec_id, e.label, cast(embedding as double[]) as x, centre as y from embeddings e join c on e.label is not distinct from c.label)
"""


def _pairs(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return df.join(label_means(df, "embedding", "label"), "label").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("centre").alias("y"))


def _distance(name, column, sql):
    def run(spark, sf_dir):
        return _pairs(spark, sf_dir).select("vec_id", rounded(column(F.col("x"), F.col("y"))).alias("distance"))

    query(MEANS + f"select vec_id, round({sql}, 6) + 0.0 as distance from p", name)(run)


_VAR = "(list_aggregate({v}, 'var_pop'))"
_distance("dist_manhattan", V.manhattan, "list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])))")
_distance("dist_euclid", V.euclid, "list_distance(x, y)")
_distance("dist_cosine", V.cosine_distance, "1 - list_cosine_similarity(x, y)")
_distance("dist_normvar", V.variance_distance, f"0.5 * {_VAR.format(v='x')} / ({_VAR.format(v='x')} + {_VAR.format(v='y')})")


@query(MEANS + "select vec_id, cast(list_sum(list_transform(list_zip(x, y), lambda z: cast((z[1] > 0) <> (z[2] > 0) as int))) as int) as distance from p")
def dist_hamming(spark, sf_dir):
    sign = lambda c: F.transform(c, lambda v: v > 0)
    return _pairs(spark, sf_dir).select("vec_id", V.hamming(sign(F.col("x")), sign(F.col("y"))).alias("distance"))


@query(MEANS + "select vec_id, round(list_sum(list_transform(list_zip(x, y), lambda z: cast(z[1] > 0 and z[2] > 0 as int))) / cast(nullif(list_sum(list_transform(list_zip(x, y), lambda z: cast(z[1] > 0 or z[2] > 0 as int))), 0) as double), 6) + 0.0 as similarity from p")
def jaccard_binary(spark, sf_dir):
    sign = lambda c: F.transform(c, lambda v: (v > 0).cast("double"))
    return _pairs(spark, sf_dir).select("vec_id", rounded(V.binary_jaccard(sign(F.col("x")), sign(F.col("y")))).alias("similarity"))


@query("""
with s as (select l_quantity as x, l_extendedprice / 1000 as y, l_orderkey, l_linenumber from lineitem),
m as (select avg(x) as mx, avg(y) as my, var_samp(x) as vx, var_samp(y) as vy, covar_samp(x, y) as c from s)
select l_orderkey, l_linenumber, round(sqrt(((x - mx) * (x - mx) * vy - 2 * (x - mx) * (y - my) * c + (y - my) * (y - my) * vx) / (vx * vy - c * c)), 5) + 0.0 as distance from s, m""")
def mahalanobis(spark, sf_dir):
    import numpy as np

    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", F.col("l_extendedprice") / 1000).alias("x"))
    n, mean, scatter = M.scatter(df, "x")
    inverse = np.linalg.inv(scatter / (n - 1)).tolist()
    centre = F.array(*[F.lit(float(v)) for v in mean])
    return df.select("l_orderkey", "l_linenumber", rounded(V.mahalanobis(F.col("x"), centre, inverse), 5).alias("distance"))


@query("""
with c as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+(?:[''’-][\\p{L}\\p{N}_]+)*|[^\\p{L}\\p{N}_\\s]')) as t from conversations),
p as (select conv_id, turn, t, lag(t) over (partition by conv_id order by turn) as b from c)
select conv_id, turn, round(len(list_intersect(t, b)) / cast(len(list_distinct(list_concat(t, b))) as double), 6) + 0.0 as similarity from p where b is not null and len(t) + len(b) > 0""")
def jaccard_tokens(spark, sf_dir):
    """Word sets of each turn and the one before it."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(tokens(F.lower("text"))).alias("t"))
    p = c.withColumn("b", F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("b is not null and size(t) + size(b) > 0")
    return p.select("conv_id", "turn", rounded(V.jaccard(F.col("t"), F.col("b"))).alias("similarity"))


@query(MEANS + "select label, cast(size as bigint) as size, round(list_sum(list_transform(centre, lambda v: v * v)), 6) + 0.0 as squared_norm from c")
def label_centres(spark, sf_dir):
    m = label_means(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return m.select("label", "size", rounded(V.dot(F.col("centre"), F.col("centre"))).alias("squared_norm"))


@query(MEANS + """
, d as (select e.vec_id, c.label, list_distance(cast(e.embedding as double[]), centre) as d from embeddings e, c)
select vec_id, cast(arg_min(label, d) as bigint) as nearest, round(min(d), 5) + 0.0 as distance from d group by 1""")
def nearest_centroid(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    centres = [(r["label"], r["centre"]) for r in label_means(df, "embedding", "label").collect()]  # one row for a label
    return nearest(df.select("vec_id", "embedding"), "embedding", centres).select("vec_id", "nearest", rounded(F.col("distance"), 5).alias("distance"))


WHOLE = "select vec_id, cast(embedding as double[]) as v from embeddings"


def _whole(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


SOFT = f"""with s as ({WHOLE}), t as (select vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) as e from s),
q as (select vec_id, v, list_transform(e, lambda x: x / list_sum(e)) as p from t) """


@query(SOFT + "select vec_id, i - 1 as pos, round(p[i], 6) + 0.0 as p from q, (select unnest(range(1, 65)) as i)")
def softmax_rows(spark, sf_dir):
    p = _whole(spark, sf_dir).select("vec_id", F.posexplode(V.softmax(F.col("v"))).alias("pos", "p"))
    return p.select("vec_id", F.col("pos").cast("long").alias("pos"), rounded(F.col("p")).alias("p"))


@query(f"""with s as ({WHOLE}), t as (select vec_id, list_transform(v, lambda x: case when x > -0.05 then exp(x / 0.5) else 0 end) as e from s)
select vec_id, i - 1 as pos, round(coalesce(e[i] / nullif(list_sum(e), 0), 0), 6) + 0.0 as p from t, (select unnest(range(1, 65)) as i)""")
def masked_softmax_rows(spark, sf_dir):
    s = _whole(spark, sf_dir).withColumn("m", F.transform("v", lambda x: x > -0.05))
    p = s.select("vec_id", F.posexplode(V.masked_softmax(F.col("v"), F.col("m"), 0.5)).alias("pos", "p"))
    return p.select("vec_id", F.col("pos").cast("long").alias("pos"), rounded(F.col("p")).alias("p"))


@query("""select event_id, round(1 / (1 + exp(-x)), 6) + 0.0 as sigmoid, round(x / (1 + exp(-x)), 6) + 0.0 as swish, round(case when x > 0 then x else exp(x) - 1 end, 6) + 0.0 as elu,
round(greatest(x, 0), 6) + 0.0 as relu, round(case when x > 0 then x else 0.1::double * x end, 6) + 0.0 as leaky_relu, round(tanh(x), 6) + 0.0 as tanh
from (select event_id, (value - 50) / 25 as x from events)""")
def activations(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("x", (F.col("value") - 50) / 25)
    x = F.col("x")
    named = {"sigmoid": V.sigmoid(x), "swish": V.swish(x), "elu": V.elu(x), "relu": V.relu(x), "leaky_relu": V.leaky_relu(x), "tanh": F.tanh(x)}
    return df.select("event_id", *[rounded(c).alias(n) for n, c in named.items()])


@query("""select event_id, round(s * (1 - s), 6) + 0.0 as sigmoid, round(s + x * s * (1 - s), 6) + 0.0 as swish, round(case when x > 0 then 1 else exp(x) end, 6) + 0.0 as elu, round(1 - tanh(x) * tanh(x), 6) + 0.0 as tanh
from (select event_id, (value - 50) / 25 as x, 1 / (1 + exp(-(value - 50) / 25)) as s from events)""")
def activation_slopes(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("x", (F.col("value") - 50) / 25)
    return df.select("event_id", *[rounded(V.slope_of(n, F.col("x"))).alias(n) for n in ("sigmoid", "swish", "elu", "tanh")])


@query("select vec_id, pos, cast(pos = label as int) as hot from embeddings, (select unnest(range(0, 10)) as pos)")
def onehot(spark, sf_dir):
    o = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(one_hot(F.col("label"), 10)).alias("pos", "hot"))
    return o.select("vec_id", F.col("pos").cast("long").alias("pos"), "hot")


@query("select doc_id, pos, cast(case pos when 0 then quality when 1 then toxic else 0 end as int) as hot from labels, (select unnest(range(0, 3)) as pos)")
def multihot(spark, sf_dir):
    marks = F.array_compact(F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1)))
    o = table(spark, sf_dir, "labels").select("doc_id", F.posexplode(multi_hot(marks, 3)).alias("pos", "hot"))
    return o.select("doc_id", F.col("pos").cast("long").alias("pos"), "hot")


@query("select vec_id, cast(list_position(cast(embedding as double[]), list_max(cast(embedding as double[]))) - 1 as int) as best, cast(round_even(cast(embedding[1] as double), 0) as int) as rounded_first from embeddings")
def argmax_labels(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return df.select("vec_id", arg_max(F.col("v")).alias("best"), F.get(round_labels(F.col("v")), F.lit(0)).alias("rounded_first"))


@query(SOFT + """select vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(x))) / ln(64), 6) + 0.0 as entropy, round((1 - list_max(p)) / (1 - 1 / 64.0::double), 6) + 0.0 as least_confidence,
round(1 - (list_reverse_sort(p)[1] - list_reverse_sort(p)[2]), 6) + 0.0 as margin from q""")
def uncertainty_scores(spark, sf_dir):
    s = _whole(spark, sf_dir).withColumn("p", V.softmax(F.col("v")))
    return s.select("vec_id", *[rounded(f(F.col("p"))).alias(n) for n, f in V.STRATEGIES.items()])


@query(SOFT + """, d as (select vec_id, case vec_id % 3 when 0 then 'BINARY' when 1 then 'CHOICE' else 'SCORE' end as kind, p from q)
select vec_id, kind, round(case kind when 'BINARY' then p[2] when 'CHOICE' then list_position(p, list_max(p)) - 1 else list_sum(list_transform(list_zip(p, range(0, 64)), lambda z: z[1] * z[2])) end, 6) + 0.0 as decoded,
round(1 + list_sum(list_transform(p, lambda x: x * ln(x))) / ln(64), 6) + 0.0 as confidence, kind || ':11+' as bucket from d""")
def decode_decisions(spark, sf_dir):
    kind = F.when(F.col("vec_id") % 3 == 0, "BINARY").when(F.col("vec_id") % 3 == 1, "CHOICE").otherwise("SCORE")
    s = _whole(spark, sf_dir).withColumn("p", V.softmax(F.col("v"))).withColumn("kind", kind)
    return s.select("vec_id", "kind", rounded(V.decode_decision(F.col("kind"), F.col("p"))).alias("decoded"), rounded(V.decision_confidence(F.col("p"))).alias("confidence"), V.option_bucket(F.col("kind"), F.size("p")).alias("bucket"))


GRID = [0.5, 0.75, 1.0, 1.5, 2.0, 4.0]
TEMPERATURES = f"""
with s as ({WHOLE}), g as (select unnest({GRID}::double[]) as t, unnest(range(0, {len(GRID)})) as k),
l as (select s.vec_id, v, e.label as y, e.label % 2 as bucket from s join embeddings e using (vec_id)),
n as (select bucket, t, k, avg(ln(list_sum(list_transform(v, lambda x: exp((x - list_max(v)) / t)))) - (v[cast(y + 1 as int)] - list_max(v)) / t) as nll from l, g group by 1, 2, 3),
b as (select bucket, arg_min(t, (round(nll, 9), k)) as temperature, min(nll) as nll from n group by 1)
"""


def _temperatures(spark, sf_dir):
    """Mean negative log likelihood of each grid value in one scan: a column for each, no copy of the rows for each."""
    l = _whole(spark, sf_dir).withColumn("bucket", F.col("label") % 2)
    y = F.get("v", F.col("label").cast("int"))

    def nll(t):
        return F.avg(V.bound(F.array_max("v"), lambda top: F.log(V.total(F.transform("v", lambda x: F.exp((x - top) / t)))) - (y - top) / t))

    n = l.groupBy("bucket").agg(*[nll(t).alias(f"n{i}") for i, t in enumerate(GRID)])
    best = F.array_min(F.array(*[F.struct(F.round(f"n{i}", 9).alias("n"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(GRID)]))
    return l, n.select("bucket", best["t"].alias("temperature"), best["n"].alias("nll"))


@query(TEMPERATURES + "select cast(bucket as bigint) as bucket, temperature, round(nll, 6) + 0.0 as nll from b")
def temperature_fit(spark, sf_dir):
    return _temperatures(spark, sf_dir)[1].select(F.col("bucket").cast("long").alias("bucket"), "temperature", rounded(F.col("nll")).alias("nll"))


@query(TEMPERATURES + ", c as (select vec_id, list_transform(v, lambda x: exp((x - list_max(v)) / temperature)) as e from l join b using (bucket)) select vec_id, i - 1 as pos, round(e[i] / list_sum(e), 6) + 0.0 as p from c, (select unnest(range(1, 65)) as i)")
def calibrated_probs(spark, sf_dir):
    l, t = _temperatures(spark, sf_dir)
    p = l.join(t, "bucket", "left").select("vec_id", F.posexplode(V.softmax(F.transform("v", lambda x: x / F.coalesce("temperature", F.lit(1.0))))).alias("pos", "p"))
    return p.select("vec_id", F.col("pos").cast("long").alias("pos"), rounded(F.col("p")).alias("p"))


@query(f"""with s as ({WHOLE}), f as (select vec_id, list_min(v) as lo, v from s)
select vec_id, round(lo - 0.7::double * ln(list_sum(list_transform(v, lambda x: exp((lo - x) / 0.7::double)))), 6) + 0.0 as energy,
round(10 * log10(v[1] * v[1] + 1e-12::double), 6) + 0.0 as level from f""")
def free_energy(spark, sf_dir):
    s = _whole(spark, sf_dir)
    first = F.get("v", F.lit(0))
    return s.select("vec_id", rounded(V.free_energy(F.col("v"), 0.7)).alias("energy"), rounded(V.decibels(first * first)).alias("level"))


@query(SOFT + """, g as (select vec_id, p, v, list_inner_product(p, v) as inner_, list_transform(v, lambda x: x > 0) as m from q)
select vec_id, round(ln(list_sum(list_transform(v, lambda x: exp(x)))), 6) + 0.0 as lse, round(p[1] * (v[1] - inner_), 6) + 0.0 as slope, round(2 * tanh(v[1] / 2), 6) + 0.0 as bounded, cast(len(list_filter(v, lambda x: x > 0)) as int) as kept,
case when len(list_filter(v, lambda x: x > 0)) > 0 then 1.0::double else 0.0::double end as attention from g""")
def attention_parts(spark, sf_dir):
    s = _whole(spark, sf_dir).withColumn("p", V.softmax(F.col("v"))).withColumn("m", F.transform("v", lambda x: x > 0))
    v, first = F.col("v"), F.get("v", F.lit(0))
    attention = F.round(V.total(V.attention_softmax(v, F.col("m"))), 6)
    return s.select("vec_id", rounded(V.log_sum_exp(v)).alias("lse"), rounded(F.get(V.softmax_slope(F.col("p"), v), F.lit(0))).alias("slope"), rounded(V.soft_bound(first, 2.0)).alias("bounded"), F.size(V.gather(v, F.col("m"))).alias("kept"), attention.alias("attention"))
