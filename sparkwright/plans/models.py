"""Queries of fitted models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import calibration as C
from ..operators import clustering, projection, regression
from .registry import query, rounded, table

FEATURES = ["l_quantity", "l_discount", "l_tax"]
EDGES = "[" + ", ".join(f"quantile_cont({{c}}, {i / 8}::double)" for i in range(1, 8)) + "]"


@query(" union all ".join(f"select '{c}' as feature, unnest(list_distinct({EDGES.format(c=c)})) as edge from lineitem" for c in FEATURES))
def ebm_bins(spark, sf_dir):
    edges = B.bin_edges(table(spark, sf_dir, "lineitem"), FEATURES, 8)
    return spark.createDataFrame([(c, float(e)) for c, es in edges.items() for e in es], "feature string, edge double")


@query(f"""with e as (select {EDGES.format(c='l_quantity')} as e, avg(l_extendedprice) as m from lineitem),
b as (select len(list_filter(list_distinct(e), lambda x: x <= l_quantity)) as bin, l_extendedprice - m as r from lineitem, e)
select cast(bin as int) as bin, round(0.2::double * avg(r), 4) + 0.0 as contribution from b group by 1""")
def ebm_round1(spark, sf_dir):
    m = B.fit_shapes(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", bins=8, rounds=1, rate=0.2)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.shapes["l_quantity"])], "bin int, contribution double").select("bin", rounded(F.col("contribution"), 4).alias("contribution"))


def ebm_sql(features: list[str], bins: int, rounds: int, rate: float, tail: str) -> str:
    """The rounds as one window average after the other; then `best`, the pair whose cells leave most, and its step d in `u`. `tail` reads them."""
    edges = ", ".join("list_distinct([" + ", ".join(f"quantile_cont({c}, {i / bins!r}::double)" for i in range(1, bins)) + f"]) as e{k}" for k, c in enumerate(features))
    cells = ", ".join(f"len(list_filter(e{k}, lambda x: x <= {c})) as b{k}" for k, c in enumerate(features))
    parts = [f"with e as (select {edges} from lineitem), t0 as (select l_orderkey, l_linenumber, l_extendedprice as y, {cells}, avg(l_extendedprice) over () as s from lineitem, e)"]
    steps = [k for _ in range(rounds) for k in range(len(features))]
    for n, k in enumerate(steps):
        parts.append(f"t{n + 1} as (select * exclude (s), s + {rate!r}::double * avg(y - s) over (partition by b{k}) as s from t{n})")
    pairs = [(a, b) for a in range(len(features)) for b in range(a + 1, len(features))]
    last = f"t{len(steps)}"
    ranks = " union all ".join(f"select {n} as pair, '{features[a]}' as fa, '{features[b]}' as fb, sum(r * r / k) as v from (select sum(y - s) as r, count(*) as k from {last} group by b{a}, b{b} having count(*) > 1)" for n, (a, b) in enumerate(pairs))
    parts.append(f"best as (select * from ({ranks}) order by v desc, fa, fb limit 1)")
    case = lambda of: "case pair " + " ".join(f"when {n} then {of(a, b)}" for n, (a, b) in enumerate(pairs)) + " end"
    step = case(lambda a, b: f"avg(y - s) over (partition by b{a}, b{b})")
    parts.append(f"u as (select {last}.*, fa, fb, {case(lambda a, b: f'b{a}')} as i, {case(lambda a, b: f'b{b}')} as j, {rate!r}::double * {step} as d from {last}, best)")
    return ", ".join(parts) + " " + tail


@query(ebm_sql(FEATURES, 8, 3, 0.3, "select l_orderkey, l_linenumber, round(s + d, 2) + 0.0 as price from u"))
def ebm_fit(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    m = B.fit_shapes(df, FEATURES, "l_extendedprice", bins=8, rounds=3, rate=0.3, pairs=1)
    return df.select("l_orderkey", "l_linenumber", rounded(m.predict(), 2).alias("price"))


def _scored(spark, sf_dir):
    """Quality labels with a score of their documents: the share of long words, hashed into ties."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.round(F.log10(F.col("n_chars") + 1), 2).alias("score"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "score", "quality")


SCORED = "with s as (select doc_id, round(log10(n_chars + 1), 2) as score, quality from labels join documents using (doc_id) where quality is not null)"


@query(SCORED + """, n as (select sum(quality) as p, sum(1 - quality) as q from s),
t as (select score, case when quality = 1 then (p + 1) / (p + 2)::double else 1 / (q + 2)::double end as t, 1 / (1 + exp(-(0.5::double * score - 1))) as p from s, n)
select round(sum((p - t) * score), 5) + 0.0 as ga, round(sum(p - t), 5) + 0.0 as gb, round(sum(p * (1 - p) * score * score), 5) + 0.0 as haa, round(sum(p * (1 - p) * score), 5) + 0.0 as hab, round(sum(p * (1 - p)), 5) + 0.0 as hbb from t""")
def platt_step(spark, sf_dir):
    sums = C.platt_sums(_scored(spark, sf_dir), "score", "quality", 0.5, -1.0)
    return spark.range(1).select(*[rounded(F.lit(v), 5).alias(n) for n, v in zip(("ga", "gb", "haa", "hab", "hbb"), sums, strict=False)])


@query("with recursive" + SCORED.removeprefix("with") + """, n as (select sum(quality) as p, sum(1 - quality) as q from s),
t as (select score, case when quality = 1 then (p + 1) / (p + 2)::double else 1 / (q + 2)::double end as t from s, n),
it as (select 0 as k, 0.0::double as a, ln((p + 1) / (q + 1)::double) as b from n union all
select k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) from
(select k, a, b, sum((p - t) * score) as ga, sum(p - t) as gb, sum(p * (1 - p) * score * score) as haa, sum(p * (1 - p) * score) as hab, sum(p * (1 - p)) as hbb
from (select k, a, b, score, t, 1 / (1 + exp(-(a * score + b))) as p from it, t where k < 15) group by k, a, b)),
f as (select a, b from it where k = 15), d as (select doc_id, round(log10(n_chars + 1), 2) as score from labels join documents using (doc_id))
select doc_id, round(1 / (1 + exp(-(a * score + b))), 5) + 0.0 as p from d, f""")
def platt_fit(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("doc_id", rounded(C.platt(F.col("score"), *C.fit_platt(s, "score", "quality")), 5).alias("p"))


#: The rising fit as the maximum over starts of the minimum over ends of means.
RISING = SCORED + """, g as (select score, sum(quality) as y, count(*) as n, row_number() over (order by score) as i from s where score is not null group by 1),
c as (select *, sum(y) over (order by i) as cy, sum(n) over (order by i) as cn from g),
m as (select a.i as a, b.i as b, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n)::double as m from c a join c b on a.i <= b.i),
lo as (select a, g.i, min(m) as m from m join g on g.i between a and b group by 1, 2), f as (select i, round(max(m), 12) as p from lo group by 1),
k as (select sum(score * n) / sum(n)::double as x, p from f join g using (i) group by p)"""


@query(RISING + " select round(x, 6) + 0.0 as score, round(p, 6) + 0.0 as p from k")
def isotonic_knots(spark, sf_dir):
    k = C.isotonic_table(_scored(spark, sf_dir), "score", "quality")
    return k.select(rounded(F.col("x")).alias("score"), rounded(F.col("p")).alias("p"))


@query(RISING + """, w as (select x, p, lead(x) over (order by x) as x1, lead(p) over (order by x) as p1 from k), e as (select min(x) as x0, arg_min(p, x) as first from k),
q as (select doc_id, round(log10(n_chars + 1), 2) as score from labels join documents using (doc_id))
select doc_id, round(case when q.score < x0 then first when x1 is null then p else p + (p1 - p) * (q.score - x) / (x1 - x) end, 6) + 0.0 as p from q cross join e left join w on q.score >= x and (x1 is null or q.score < x1)""")
def isotonic_predict(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return C.predict_isotonic(s, "score", C.isotonic_table(s, "score", "quality")).select("doc_id", rounded(F.col("p")).alias("p"))


@query()
def spline_predict(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("doc_id", C.spline(F.col("score"), C.fit_isotonic(s, "score", "quality")).alias("p"))


@query()
def centroid_fit(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    g = clustering.grow_centroids(e, "vec_id", "embedding", most=4, iterations=6, score="squared")
    return g.predict(e.select("vec_id", "embedding"), "embedding").select("vec_id", "nearest", "distance")


@query()
def latent_som_fit(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return clustering.fit_latent_map(e, "embedding", 4, 4, iterations=5).transform(e, "embedding").select("vec_id", "unit", "latent")


@query("""with f as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from lineitem)
select l_orderkey, l_linenumber, round(a + b * l_quantity, 1) + 0.0 as price from lineitem, f""")
def scg_regression(spark, sf_dir):
    """One predictor, where the least-squares line is known in closed form."""
    df = table(spark, sf_dir, "lineitem").withColumn("x", F.array("l_quantity"))
    m = regression.fit_linear(df, "x", "l_extendedprice", steps=30)
    return df.select("l_orderkey", "l_linenumber", rounded(m.predict(F.col("x")), 1).alias("price"))


@query()
def scg_logistic(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 5).cast("int")).withColumn("x", F.col("embedding"))
    m = regression.fit_linear(e, "x", "y", task="binary", penalty=0.01, steps=12)
    return e.select("vec_id", m.predict(F.col("x").cast("array<double>")).alias("p"))


@query("""with c as (select corr(l_quantity, l_tax) as r, corr(l_quantity, l_extendedprice) as a, corr(l_tax, l_extendedprice) as b from lineitem),
h as (select a, b, (sqrt(1 + r) + sqrt(1 - r)) / 2 as d, (sqrt(1 + r) - sqrt(1 - r)) / 2 as o from c),
w as (select d, o, (d * a - o * b) / (d * d - o * o) as x, (d * b - o * a) / (d * d - o * o) as y from h)
select 'l_quantity' as feature, round(d * d * x * x + o * o * y * y, 6) + 0.0 as weight from w union all select 'l_tax', round(o * o * x * x + d * d * y * y, 6) + 0.0 from w""")
def relative_weights(spark, sf_dir):
    w = regression.relative_weights(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice")
    return spark.createDataFrame(list(w.items()), "feature string, weight double").select("feature", rounded(F.col("weight")).alias("weight"))


@query("""with m as (select avg(l_quantity) as ma, stddev_pop(l_quantity) as sa, avg(l_extendedprice) as mb, stddev_pop(l_extendedprice) as sb, sign(corr(l_quantity, l_extendedprice)) as r from lineitem)
select l_orderkey, l_linenumber, round(((l_quantity - ma) / sa + r * (l_extendedprice - mb) / sb) / sqrt(2), 4) + 0.0 as pc1 from lineitem, m""")
def pca2(spark, sf_dir):
    """Of two columns, whose first axis is known: equal weights, of the sign of their correlation."""
    df = table(spark, sf_dir, "lineitem").withColumn("x", F.array("l_quantity", "l_extendedprice"))
    p = projection.fit_pca(df, "x", 1)
    return df.select("l_orderkey", "l_linenumber", rounded(F.get(p.project(F.col("x")), F.lit(0)), 4).alias("pc1"))


@query()
def mca(spark, sf_dir):
    return projection.mca(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], 2)


@query()
def incremental_svd(spark, sf_dir):
    """Two halves of the vectors folded one after the other."""
    e = table(spark, sf_dir, "embeddings")
    m = projection.RunningSVD(rank=8)
    for half in (0, 1):
        projection.update_svd(m, e.filter(F.col("vec_id") % 2 == half), "embedding")
    return spark.createDataFrame([(i, float(s), float(x)) for i, (s, x) in enumerate(zip(m.sigma, m.explained, strict=True))], "component int, sigma double, explained double")


@query("""select vec_id, round(list_sum(embedding::double[]), 3) + 0.0 as total, round(list_sum(list_transform(embedding::double[], lambda x: x * x)), 3) + 0.0 as squares from embeddings""")
def svd_inverse(spark, sf_dir):
    """Projected on all components and back: the vectors themselves."""
    e = table(spark, sf_dir, "embeddings")
    m = projection.update_svd(projection.RunningSVD(rank=64), e, "embedding")
    back = e.select("vec_id", m.project(F.col("embedding")).alias("c")).select("vec_id", m.restore(F.col("c")).alias("x"))
    return back.select("vec_id", rounded(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 3).alias("total"), rounded(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v), 3).alias("squares"))


@query("""with v as (select label, unnest(embedding)::double as x, unnest(range(1, 65)) as i from embeddings where label is not null),
c as (select label, list(m order by i) as c from (select label, i, avg(x) as m from v group by 1, 2) group by 1),
d as (select c.label, list_distance(cast(embedding as double[]), c) as d from embeddings, c),
r as (select label, 1.67::double * avg(d) as r from (select *, row_number() over (partition by label order by d) as k from d) where k <= 20 group by 1),
n as (select label, r, greatest(count_if(d <= r), 1) as n from d join r using (label) group by 1, 2), l as (select label, ln(n) - 64 * ln(r) as l from n),
e as (select label, exp(l - max(l) over ()) as e from l)
select label, round(e / avg(e) over (), 6) + 0.0 as density from e""")
def local_density(spark, sf_dir):
    """Relative density at each label's mean: rows within 1.67 times the mean of its 20 nearest distances, over the ball's volume."""
    from ..operators.nearest import distances, label_means

    e = table(spark, sf_dir, "embeddings")
    means = label_means(e, "embedding", "label").orderBy("label").collect()
    names, centres = [r["label"] for r in means], np.array([r["centre"] for r in means])

    def nearest20(batches):
        import pandas as pd

        best = np.empty((0, len(centres)))  # one result for a task
        for pdf in batches:
            if len(pdf):
                d = distances(np.stack(pdf["embedding"].to_numpy()).astype(float), centres)
                best = np.sort(np.r_[best, d], axis=0)[:20]
        yield pd.DataFrame({"k": np.repeat(np.arange(len(centres)), len(best)), "d": best.T.ravel()})

    from pyspark.sql import Window

    near = e.select("embedding").mapInPandas(nearest20, "k int, d double").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("d"))).filter("r <= 20")
    radius = {r["k"]: 1.67 * r["m"] for r in near.groupBy("k").agg(F.avg("d").alias("m")).collect()}

    def inside(batches):
        import pandas as pd

        limits, n = np.array([radius[k] for k in range(len(centres))]), np.zeros(len(centres), np.int64)
        for pdf in batches:
            if len(pdf):
                n += (distances(np.stack(pdf["embedding"].to_numpy()).astype(float), centres) <= limits).sum(axis=0)
        yield pd.DataFrame({"k": np.arange(len(centres)), "n": n})

    counts = e.select("embedding").mapInPandas(inside, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    logs = np.array([np.log(max(r["n"], 1)) - centres.shape[1] * np.log(radius[r["k"]]) for r in sorted(counts, key=lambda r: r["k"])])
    density = np.exp(logs - logs.max())
    density = density / density.mean()
    return spark.createDataFrame([(int(i), float(v)) for i, v in zip(names, density, strict=True)], "label int, density double").select("label", rounded(F.col("density")).alias("density"))
