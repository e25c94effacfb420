"""Queries around human annotation and predictions, and small array operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import sentences
from ..operators import boosting as B
from ..operators import labels as L
from ..operators import signals
from ..sources import datasets
from ..sources.audio import band_edges
from .models import ebm_sql
from .registry import query, rounded, table
from .sequences import SENT
from .vectors import MEANS, SOFT, _pairs, _whole


@query(SOFT + """, h as (select q.vec_id, p, e.label as human from q join embeddings e using (vec_id))
select vec_id, round(1 - p[cast(human + 1 as int)], 6) + 0.0 as disagreement, human <> list_position(p, list_max(p)) - 1 as differs from h""")
def disagreement(spark, sf_dir):
    """One less the probability that a model gives to the human label."""
    s = _whole(spark, sf_dir).withColumn("p", V.softmax(F.col("v"))).withColumn("human", F.col("label").cast("int"))
    best = F.array_position("p", F.array_max("p")) - 1
    return s.select("vec_id", rounded(1 - F.get("p", F.col("human"))).alias("disagreement"), (F.col("human") != best).alias("differs"))


@query("""select doc_id, round(1 - (0.5::double * quality + 0.25::double), 6) + 0.0 as score from labels where quality is not null and 1 - (0.5::double * quality + 0.25::double) >= 0.5""")
def low_confidence(spark, sf_dir):
    c = F.col("quality") * 0.5 + 0.25
    return table(spark, sf_dir, "labels").filter(F.col("quality").isNotNull() & (1 - c >= 0.5)).select("doc_id", rounded(1 - c).alias("score"))


@query("""with t as (select user_id, event_type, value / 100 as p, row_number() over (partition by user_id order by ts, event_id) - 1 as ix, case when value >= 20 then event_type end as tag from events),
b as (select *, lag(tag) over (partition by user_id order by ix) as before from t),
g as (select *, sum(case when tag is distinct from before then 1 else 0 end) over (partition by user_id order by ix) as run from b)
select user_id, tag, min(ix) as first, max(ix) as last, round(avg(p), 6) + 0.0 as confidence from g where tag is not null group by user_id, run, tag""")
def suggested_spans(spark, sf_dir):
    """Runs of one predicted tag, with the mean probability; weak predictions count as none."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 100).alias("p"), (F.row_number().over(by) - 1).cast("long").alias("at"), F.when(F.col("value") >= 20, F.col("event_type")).alias("tag"))
    at = Window.partitionBy("user_id").orderBy("at")
    new = F.when(F.col("tag").eqNullSafe(F.lag("tag").over(at)), 0).otherwise(1)
    g = t.withColumn("new", new).withColumn("run", F.sum("new").over(at)).filter("tag is not null")
    return g.groupBy("user_id", "run", "tag").agg(F.min("at").alias("first"), F.max("at").alias("last"), rounded(F.avg("p")).alias("confidence")).drop("run")


@query("select 'quality' as column, count(quality) as n from labels union all select 'toxic', count(toxic) from labels")
def column_presence(spark, sf_dir):
    return datasets.presence(table(spark, sf_dir, "labels"), ["quality", "toxic"])


@query("""select count_if(vec_id % 3 = 0) as ok, count_if(vec_id % 3 = 1) as bad, count_if(vec_id % 3 = 2) as missing from embeddings""")
def prediction_report(spark, sf_dir):
    cell = F.when(F.col("vec_id") % 3 == 0, "[0.25, 0.75]").when(F.col("vec_id") % 3 == 1, "[0.5, 1.5]")
    return L.prediction_report(table(spark, sf_dir, "embeddings").withColumn("cell", cell), "cell", 2)


@query("select lang, count(*) as n, quantile_cont(n_chars, 0.5) as median_chars, max(n_chars) as max_chars from documents group by 1")
def text_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.percentile("n_chars", F.lit(0.5)).alias("median_chars"), F.max("n_chars").alias("max_chars"))


@query("select vec_id, array_to_string(list_transform(list_sort(list_transform(range(1, 65), lambda i: (-cast(embedding[i] as double), i)))[1:2], lambda z: z[2] - 1), ' ') as experts from embeddings")
def select_experts(spark, sf_dir):
    """The two largest gates of each row; the first of equal ones."""
    gates = F.array_sort(F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.struct((-x).alias("g"), i.alias("i"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(F.slice(gates, 1, 2), lambda s: s["i"].cast("string")), " ").alias("experts"))


@query("select c_custkey, cast('0x' || substr(sha256(c_name), 1, 12) as bigint) as seed from customer")
def stable_seeds(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.conv(F.substring(F.sha2(F.col("c_name").cast("binary"), 256), 1, 12), 16, 10).cast("long").alias("seed"))


@query(MEANS + """, g as (select vec_id, list_sum(list_transform(x, lambda a: a * a)) as xx, list_inner_product(x, y) as xy, list_sum(list_transform(y, lambda a: a * a)) as yy from p)
select vec_id, round(sqrt(greatest(xx - 2 * xy + yy, 0)), 5) + 0.0 as distance from g""")
def gram_pairs(spark, sf_dir):
    """Distances from inner products equal the direct ones."""
    x, y = F.col("x"), F.col("y")
    return _pairs(spark, sf_dir).select("vec_id", rounded(F.sqrt(F.greatest(V.dot(x, x) - 2 * V.dot(x, y) + V.dot(y, y), F.lit(0.0))), 5).alias("distance"))


@query(SENT + """, p as (select doc_id, unnest(s) as sentence from s), d as (select distinct sentence from p)
select sentence from d order by sha256('3:' || sentence), sentence limit 200""")
def sentence_pool(spark, sf_dir):
    """A sample of the corpus' distinct sentences in the order of a seeded hash: the same whatever the partitioning."""
    s = table(spark, sf_dir, "documents").select(F.explode(sentences(F.col("text"))).alias("sentence")).distinct()
    return s.orderBy(F.sha2(F.concat(F.lit("3:"), "sentence").cast("binary"), 256), "sentence").limit(200)


@query("""with c as (select conv_id, list(length(text) order by turn) as n from conversations group by 1) select conv_id, round(list_avg(n), 4) + 0.0 as mean_length, cast(len(n) as int) as turns from c""")
def conversation_confidence(spark, sf_dir):
    """Mean of a conversation's item values to four places, as for the confidence of an event with several items."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.char_length("text")).alias("n"))
    return c.select("conv_id", rounded(F.aggregate("n", F.lit(0.0), lambda a, x: a + x) / F.size("n"), 4).alias("mean_length"), F.size("n").alias("turns"))


PAIR = ["l_quantity", "l_discount", "l_tax"]


@query(ebm_sql(PAIR, 4, 2, 0.5, """, z as (select fa, fb, case fa when 'l_quantity' then len(e0) else len(e1) end as na, case fb when 'l_discount' then len(e1) else len(e2) end as nb from best, e),
g as (select fa, fb, nb, unnest(range(0, na + 1)) as i from z), h as (select fa, fb, i, unnest(range(0, nb + 1)) as j from g), c as (select i, j, any_value(d) as d from u group by all)
select fa as first, fb as second, cast(h.i as int) as i, cast(h.j as int) as j, round(coalesce(d, 0), 4) + 0.0 as contribution from h left join c on c.i = h.i and c.j = h.j"""))
def ebm_interactions(spark, sf_dir):
    """The pair of features that explains most of what single features leave."""
    m = B.fit_shapes(table(spark, sf_dir, "lineitem"), PAIR, "l_extendedprice", bins=4, rounds=2, rate=0.5, pairs=1)
    return spark.createDataFrame([(a, b, int(i), int(j), float(t[i, j])) for (a, b), t in m.pairs.items() for i in range(t.shape[0]) for j in range(t.shape[1])], "first string, second string, i int, j int, contribution double").withColumn("contribution", rounded(F.col("contribution"), 4))


@query("""with s as (select count(distinct quality) as q, min(quality) as lo, max(quality) as hi, count_if(quality + toxic > 1) as many, count_if(quality + toxic = 0) as none from labels where quality is not null and toxic is not null)
select case when many > 0 or none > 0 then 'multilabel' when q > 2 then 'multinomial' else 'binary' end as task from s""")
def classification_task(spark, sf_dir):
    """Kind of a one-hot target: rows with several or no ones make it multilabel."""
    s = table(spark, sf_dir, "labels").filter("quality is not null and toxic is not null").agg(F.count_if(F.col("quality") + F.col("toxic") != 1).alias("odd"), F.count_distinct("quality").alias("q"))
    return s.select(F.when(F.col("odd") > 0, "multilabel").when(F.col("q") > 2, "multinomial").otherwise("binary").alias("task"))


@query("""with u as (select user_id, avg(value) as m, count(*) as n from events group by 1) select cast(count(*) as bigint) as users, round(sum(n * m) / sum(n), 6) + 0.0 as mean from u""")
def weighted_mean(spark, sf_dir):
    """Element sums of parts, weighted by their rows, as workers' results are averaged."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return u.agg(F.count("*").alias("users"), rounded(F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))


@query("""with s as (select vec_id, cast(embedding as double[]) as v from embeddings),
m as (select vec_id, [v[1], v[2], (v[3] + v[4]) / 2, (v[5] + v[6] + v[7] + v[8]) / 4, list_sum(v[9:16]) / 8, list_sum(v[17:32]) / 16, list_sum(v[33:64]) / 32] as b from s)
select vec_id, i - 1 as band, round(b[i], 6) + 0.0 as level from m, (select unnest(range(1, 8)) as i)""")
def band_pooling(spark, sf_dir):
    from ..sources.audio import pool_bands

    s = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    b = pool_bands(s, "v", [0, 1, 2, 4, 8, 16, 32, 64]).select("vec_id", F.posexplode("bands").alias("band", "level"))
    return b.select("vec_id", F.col("band").cast("long").alias("band"), rounded(F.col("level")).alias("level"))


EDGES = band_edges(9, 3)
BLACKMAN = np.blackman(16).tolist()


@query(f"""with s as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, value::double as value from events where value is not null),
n as (select user_id, unnest(range(0, (max(pos) - 15) // 8 + 1)) as win from s group by 1 having max(pos) >= 15),
w as (select user_id, win, pos - win * 8 as i, value * ({BLACKMAN!r}::double[])[pos - win * 8 + 1] as x from s join n using (user_id) where pos between win * 8 and win * 8 + 15),
c as (select user_id, win, freq, sum(x * cos(2 * pi() * freq * i / 16)) as re, sum(x * sin(2 * pi() * freq * i / 16)) as im from w, (select unnest(range(0, 9)) as freq) group by all),
p as (select user_id, win, freq, (case when freq between 1 and 7 then 2 else 1 end) * (re * re + im * im) / {sum(x * x for x in BLACKMAN)!r}::double as power from c)
select user_id, cast(win as int) as "window", cast(band as int) as band, round(avg(power), 4) + 0.0 as level from p, (select unnest(range(0, 3)) as band) where freq >= ({EDGES!r})[band + 1] and freq < ({EDGES!r})[band + 2] group by all""")
def window_spectra(spark, sf_dir):
    """Spectra of each user's series of values, pooled into bands; series and spectra stay rows."""
    e = table(spark, sf_dir, "events").filter("value is not null").select("user_id", "ts", "event_id", "value")
    rows = signals.series_positions(e, ["user_id"], ["ts", "event_id"])
    found = signals.spectra(rows, ["user_id"], BLACKMAN, 8)
    at = F.col("freq")
    band = sum([(at >= x).cast("int") for x in EDGES[1:]], F.lit(0))
    inside = found.filter((at >= EDGES[0]) & (at < EDGES[-1])).select("user_id", "win", band.alias("band"), signals.power(F.col("c"), at, BLACKMAN).alias("power"))
    levels = inside.groupBy("user_id", "win", "band").agg(F.avg("power").alias("level"))
    return levels.select("user_id", F.col("win").cast("int").alias("window"), "band", rounded(F.col("level"), 4).alias("level"))
