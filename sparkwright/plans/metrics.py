"""Queries of cluster scores, label agreement and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import cluster_metrics as M
from ..operators import label_metrics as L
from ..operators.nearest import label_means
from .registry import query, rounded, table
from .vectors import MEANS

PAIRS = """
with e as (select vec_id, label, cast(embedding as double[]) as x from embeddings),
d as (select a.vec_id, a.label, b.label as other, sum(list_distance(a.x, b.x)) as total, count(*) as n from e a, e b group by 1, 2, 3),
s as (select vec_id, label, max(case when other = label and n > 1 then total / (n - 1) end) as a, min(case when other <> label then total / n end) as b from d group by 1, 2),
v as (select vec_id, label, case when a is null or b is null then 0 else (b - a) / greatest(a, b) end as silhouette from s)
"""


@query(PAIRS + "select round(avg(silhouette), 6) + 0.0 as silhouette, count(*) as n from v")
def silhouette(spark, sf_dir):
    out = M.silhouette_score(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return out.select(rounded(F.col("silhouette")).alias("silhouette"), "n")


@query(PAIRS + "select vec_id, round(silhouette, 5) + 0.0 as silhouette from v")
def silhouette_rows(spark, sf_dir):
    out = M.silhouette_values(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return out.select("vec_id", rounded(F.col("silhouette"), 5).alias("silhouette"))


@query(PAIRS.replace("sum(list_distance(a.x, b.x))", "sum(list_distance(a.x, b.x) ** 2)") + "select vec_id, round(silhouette, 5) + 0.0 as silhouette from v")
def silhouette_squared(spark, sf_dir):
    """Exact over squared distances, in one pass."""
    out = M.silhouette_by_centres(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return out.select("vec_id", rounded(F.col("silhouette"), 5).alias("silhouette"))


@query(MEANS + """, d as (select v.vec_id, v.label, c.label as other, c.size, list_distance(cast(embedding as double[]), centre) as d from embeddings v, c where v.label is not null and c.label is not null),
s as (select vec_id, max(case when other = label and size > 1 then d end) as a, min(case when other <> label then d end) as b from d group by 1)
select vec_id, round(case when a is null or b is null then 0 else (b - a) / greatest(a, b) end, 5) + 0.0 as silhouette from s""")
def silhouette_simplified(spark, sf_dir):
    out = M.silhouette_by_centres(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", squared=False)
    return out.select("vec_id", rounded(F.col("silhouette"), 5).alias("silhouette"))


@query(MEANS + """, s as (select p.vec_id, label, list_distance(x, y) as d from p), k as (select s.label, avg(d) as s, any_value(centre) as centre from s join c using (label) group by 1)
select round(avg(r), 6) + 0.0 as davies_bouldin from (select a.label, max((a.s + b.s) / list_distance(a.centre, b.centre)) as r from k a, k b where a.label <> b.label group by 1)""")
def davies_bouldin(spark, sf_dir):
    return M.davies_bouldin(table(spark, sf_dir, "embeddings"), "embedding", "label").select(rounded(F.col("davies_bouldin")).alias("davies_bouldin"))


@query(MEANS + """, g as (select list(m order by i) as g from (select i, avg(x) as m from e group by 1)),
w as (select sum(list_distance(x, y) ** 2) as w, count(*) as n from p), b as (select sum(size * list_distance(centre, g) ** 2) as b, count(*) as k from c, g)
select round(b / w * (n - k) / (k - 1), 5) + 0.0 as calinski_harabasz from w, b""")
def calinski_harabasz(spark, sf_dir):
    return M.calinski_harabasz(table(spark, sf_dir, "embeddings"), "embedding", "label").select(rounded(F.col("calinski_harabasz"), 5).alias("calinski_harabasz"))


@query(MEANS + "select round(avg(list_distance(x, y)), 6) + 0.0 as quantization_error from p")
def quantization_error(spark, sf_dir):
    return M.quantization_error(table(spark, sf_dir, "embeddings"), "embedding", "label").select(rounded(F.col("quantization_error")).alias("quantization_error"))


@query()
def ccc(spark, sf_dir):
    value = M.cubic_clustering_criterion(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return spark.range(1).select(F.lit(value).alias("ccc"))


MEMBERS = MEANS + """, g as (select list(centre order by label) as cs, count(*) as k from c),
u as (select vec_id, cast(embedding as double[]) as x, list_transform(cs, lambda q: exp(-list_distance(cast(embedding as double[]), q))) as w, cs, k from embeddings, g),
mm as (select vec_id, x, list_transform(w, lambda a: a / list_sum(w)) as p, cs, k from u) """


def _members(spark, sf_dir):
    """Soft memberships: softmax of the negative distance to each label's mean."""
    df = table(spark, sf_dir, "embeddings")
    centres = [r["centre"] for r in label_means(df, "embedding", "label").orderBy("label").collect()]
    x = F.col("embedding").cast("array<double>")
    d = F.array(*[-V.euclid(x, F.array(*[F.lit(float(a)) for a in c])) for c in centres])
    return df.select("vec_id", "embedding", d.alias("d")).withColumn("p", V.softmax(F.col("d"))), centres


@query(MEMBERS + ", f as (select avg(list_sum(list_transform(p, lambda a: a * a))) as f, max(k) as k from mm) select round(f, 6) + 0.0 as partition_coefficient, round((f * k - 1) / (k - 1), 6) + 0.0 as normalised from f")
def partition_coef(spark, sf_dir):
    out = M.partition_coefficient(_members(spark, sf_dir)[0], "p")
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


@query(MEMBERS + """, gap as (select min(list_distance(a.centre, b.centre) ** 2) as gap from c a, c b where a.label < b.label)
select round(sum(list_sum(list_transform(list_zip(p, cs), lambda z: z[1] * z[1] * list_distance(x, z[2]) * list_distance(x, z[2])))) / (count(*) * any_value(gap)), 6) + 0.0 as xie_beni from mm, gap""")
def xie_beni(spark, sf_dir):
    m, centres = _members(spark, sf_dir)
    return M.xie_beni(m, "embedding", "p", centres).select(rounded(F.col("xie_beni")).alias("xie_beni"))


@query("""
with d as (select a.vec_id, b.vec_id as o, round(list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])), 9) as dx, round(list_distance(cast(a.embedding[1:2] as double[]), cast(b.embedding[1:2] as double[])), 9) as dy from embeddings a, embeddings b where a.vec_id <> b.vec_id),
r as (select row_number() over (partition by vec_id order by dx, o) as rx, row_number() over (partition by vec_id order by dy, o) as ry from d),
n as (select cast(count(*) as double) as n from embeddings)
select round(1 - 2 * sum(case when ry <= 5 then greatest(rx - 5, 0) else 0 end) / (any_value(n) * 5 * (2 * any_value(n) - 16)), 5) + 0.0 as trustworthiness,
round(1 - 2 * sum(case when rx <= 5 then greatest(ry - 5, 0) else 0 end) / (any_value(n) * 5 * (2 * any_value(n) - 16)), 5) + 0.0 as continuity from r, n""")
def trustworthiness(spark, sf_dir):
    """The first two dimensions as an embedding of all of them."""
    df = table(spark, sf_dir, "embeddings").withColumn("two", F.slice("embedding", 1, 2))
    out = M.rank_scores(df, "vec_id", "embedding", "two", 5)
    return out.select(*[rounded(F.col(c), 5).alias(c) for c in out.columns])


SHARES = """
with c as (select event_type as a, user_id % 7 as b, count(*) as n from events group by 1, 2),
s as (select n, sum(n) over () as t, sum(n) over (partition by a) as na, sum(n) over (partition by b) as nb from c),
h as (select -sum(p * ln(p)) as h from (select sum(n) / (select sum(n) from c)::double as p from c group by a))
"""


def _typed(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 7)


@query("select quality, toxic, count(*) as n from labels where quality is not null and toxic is not null group by 1, 2")
def contingency(spark, sf_dir):
    return L.contingency(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(SHARES + "select round(sum(n / t::double * ln(n * t / (na * nb)::double)), 6) + 0.0 as mutual_information from s")
def mutual_info(spark, sf_dir):
    return L.mutual_information(_typed(spark, sf_dir), "event_type", "bucket").select(rounded(F.col("mutual_information")).alias("mutual_information"))


@query(SHARES + "select round(1 + sum(n / t::double * ln(n / nb::double)) / any_value(h), 6) + 0.0 as homogeneity from s, h")
def homogeneity(spark, sf_dir):
    return L.homogeneity(_typed(spark, sf_dir), "event_type", "bucket").select(rounded(F.col("homogeneity")).alias("homogeneity"))


@query(SHARES + "select round(h, 6) + 0.0 as entropy from h")
def label_entropy(spark, sf_dir):
    return L.label_entropy(table(spark, sf_dir, "events"), "event_type").select(rounded(F.col("entropy")).alias("entropy"))


@query("""
with d as (select 'purchase' as label, 0 as p union all select 'refund', 1 union all select 'view', 2),
c as (select event_type as label, count(*) as n from events where event_type is not null group by 1)
select label, cast(coalesce(n, 0) as bigint) as n, cast(row_number() over (order by p is null, p, label) as int) as pos from d full join c using (label)""")
def label_distribution(spark, sf_dir):
    return L.distribution(table(spark, sf_dir, "events"), "event_type", ["purchase", "refund", "view"])


ERRORS = "from (select l_extendedprice / 1000 as p, l_quantity as t from lineitem)"


@query(f"""select round(avg((p - t) ** 2), 5) + 0.0 as mse, round(sqrt(avg((p - t) ** 2)), 6) + 0.0 as rmse, round(avg(abs(p - t)), 6) + 0.0 as mae, round(avg(sqrt(1 + (p - t) ** 2) - 1), 6) + 0.0 as huber,
round(1 - sum((p - t) ** 2) / (var_pop(t) * count(*)), 6) + 0.0 as r2 {ERRORS}""")
def regression_errors(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("p"), F.col("l_quantity").alias("t"))
    out = L.errors(df, "p", "t")
    return out.select(rounded(F.col("mse"), 5).alias("mse"), *[rounded(F.col(c)).alias(c) for c in ("rmse", "mae", "huber", "r2")])


LOGITS = "select doc_id, toxic, quality * 1.5::double - 0.8 as x from labels where toxic is not null and quality is not null"


@query(f"""with l as ({LOGITS}), e as (select avg(greatest(x, 0) - x * toxic + ln(1 + exp(-abs(x)))) as e, avg(toxic) as b from l)
select round(e, 6) + 0.0 as cross_entropy, round(1 + e / (b * ln(b) + (1 - b) * ln(1 - b)), 6) + 0.0 as mcfadden_r2 from e""")
def cross_entropy_binary(spark, sf_dir):
    df = table(spark, sf_dir, "labels").filter("toxic is not null and quality is not null").withColumn("x", F.col("quality") * 1.5 - 0.8)
    both = df.agg(F.avg(L.binary_cross_entropy(F.col("x"), F.col("toxic"))).alias("cross_entropy")).crossJoin(L.mcfadden(df, "x", "toxic"))  # one row each
    return both.select(*[rounded(F.col(c)).alias(c) for c in both.columns])


VECTOR = "with s as (select vec_id, cast(embedding as double[]) as v, label from embeddings)"


@query(VECTOR + " select round(avg(ln(list_sum(list_transform(v, lambda x: exp(x)))) - v[cast(label + 1 as int)]), 6) + 0.0 as cross_entropy from s")
def cross_entropy_classes(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return df.agg(rounded(F.avg(L.cross_entropy(F.col("v"), F.col("label").cast("int")))).alias("cross_entropy"))


@query(MEANS + """select vec_id, round((list_distance(x[1:8], y[1:8]) ** 2 / 8 + 0.5::double * list_distance(x[1:32], y[1:32]) ** 2 / 32) / 1.5::double, 6) + 0.0 as loss from p""")
def matryoshka_loss(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    p = df.join(label_means(df, "embedding", "label"), "label")
    return p.select("vec_id", rounded(L.matryoshka(F.col("embedding").cast("array<double>"), F.col("centre"), [8, 32], [1.0, 0.5])).alias("loss"))


@query("""select event_id, round(-ln(0.3::double * exp(-(pow((value - 20) / 10, 2) / 2)) / (10 * sqrt(2 * pi())) + 0.7::double * exp(-(pow((value - 60) / 25, 2) / 2)) / (25 * sqrt(2 * pi()))), 6) + 0.0 as nll from events where value is not null""")
def mixture_nll(spark, sf_dir):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    df = table(spark, sf_dir, "events").filter("value is not null")
    return df.select("event_id", rounded(L.mixture_nll(arr(0.3, 0.7), arr(20.0, 60.0), arr(10.0, 25.0), F.col("value"))).alias("nll"))


@query("""with v as (select vec_id, cast(embedding as double[]) as p, list_reverse(cast(embedding as double[])) as t from embeddings)
select vec_id, round(1 - list_dot_product(p, t) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(t, t)) + 1e-8::double), 6) + 0.0 as cosine, round(list_sum(list_transform(list_zip(p, t), lambda z: abs(z[1] - z[2]))) / len(p), 6) + 0.0 as difference from v""")
def vector_losses(spark, sf_dir):
    """Each vector against itself backwards."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("p")).withColumn("t", F.reverse("p"))
    apart = F.zip_with("p", "t", L.absolute_error)
    return v.select("vec_id", rounded(L.cosine_loss(F.col("p"), F.col("t"))).alias("cosine"), rounded(V.total(apart) / F.size("p")).alias("difference"))
