"""Queries of the encoders: numbers, categories, calendar, text, and the mixed pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chrono as C
from ..functions import text as T
from ..functions.categorical import Categories, category_counts
from ..functions.numeric import MinMax, Outliers, Standard, merge_moments, midpoint_quantiles
from .pipeline import FeaturePipeline
from .registry import query, rounded, table

MIDPOINT = """
with v as (select {c} as v, row_number() over (order by {c}) - 1 as r, count(*) over () as n from {t} where {c} is not null),
q as (select avg(v) filter (where r in (floor(0.25 * (n - 1)), ceil(0.25 * (n - 1)))) as q1,
             avg(v) filter (where r in (floor(0.75 * (n - 1)), ceil(0.75 * (n - 1)))) as q3 from v),
b as (select q1, q3, q1 - 2.0 * (q3 - q1) as low, q3 + 2.0 * (q3 - q1) as high from q)
"""


@query("""select l_orderkey, l_linenumber, round((l_quantity - (select min(l_quantity) from lineitem)) / ((select max(l_quantity) from lineitem) - (select min(l_quantity) from lineitem)), 9) as quantity from lineitem""")
def norm_quantity(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    fitted = MinMax.fit(df, "l_quantity")
    return df.select("l_orderkey", "l_linenumber", F.round(fitted.encode(F.col("l_quantity")), 9).alias("quantity"))


@query("select l_orderkey, l_linenumber, round(l_quantity, 6) as quantity from lineitem")
def norm_inverse(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    fitted = MinMax.fit(df, "l_quantity")
    return df.select("l_orderkey", "l_linenumber", F.round(fitted.inverse(fitted.encode(F.col("l_quantity"), (-1.0, 1.0)), (-1.0, 1.0)), 6).alias("quantity"))


@query("select o_orderkey, round((o_totalprice - (select avg(o_totalprice) from orders)) / ((select stddev_pop(o_totalprice) from orders) + 1e-12), 6) as price from orders")
def standardize_price(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    fitted = Standard.fit(df, "o_totalprice")
    return df.select("o_orderkey", F.round(fitted.encode(F.col("o_totalprice")), 6).alias("price"))


@query("select o_orderkey, round(o_totalprice, 4) as price from orders")
def standardize_inverse(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    fitted = Standard.fit(df, "o_totalprice")
    return df.select("o_orderkey", F.round(fitted.inverse(fitted.encode(F.col("o_totalprice"))), 4).alias("price"))


@query(MIDPOINT.format(c="c_acctbal", t="customer") + "select round(q1, 6) as q1, round(q3, 6) as q3, round(low, 6) as low, round(high, 6) as high from b")
def iqr_bounds(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    q1, q3 = midpoint_quantiles(df, "c_acctbal", [0.25, 0.75])
    b = Outliers.fit(df, "c_acctbal")
    return df.sparkSession.range(1).select(*[F.round(F.lit(float(x)), 6).alias(n) for n, x in (("q1", q1), ("q3", q3), ("low", b.low), ("high", b.high))])


@query(MIDPOINT.format(c="value", t="events") + "select event_id, value > high or value < low as outlier from events, b")
def iqr_outliers(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select("event_id", Outliers.fit(df, "value").flag(F.col("value")).alias("outlier"))


@query(MIDPOINT.format(c="value", t="events") + "select event_id, round(least(greatest(value, low), high), 6) as value from events, b")
def iqr_clip(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select("event_id", F.round(Outliers.fit(df, "value").clip(F.col("value")), 6).alias("value"))


@query(MIDPOINT.format(c="value", t="events") + "select event_id, round(case when value is null or value > high or value < low then (select avg(value) from events) else value end, 6) as value from events, b")
def impute_mean(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    by = df.agg(F.avg("value")).first()[0]
    return df.select("event_id", F.round(Outliers.fit(df, "value").impute(F.col("value"), by), 6).alias("value"))


@query(MIDPOINT.format(c="value", t="events") + "select event_id, round(case when value is null or value > high or value < low then (select avg(v) filter (where r in (floor(0.5 * (n - 1)), ceil(0.5 * (n - 1)))) from v) else value end, 6) as value from events, b")
def impute_median(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    by = midpoint_quantiles(df, "value", [0.5])[0]
    return df.select("event_id", F.round(Outliers.fit(df, "value").impute(F.col("value"), by), 6).alias("value"))


CATEGORIES = """
with c as (select p_brand as value, count(*) as n from part where p_brand is not null group by 1),
m as (select value, row_number() over (order by n desc, value) as id from c)
"""


@query("select p_brand as value, count(*) as n from part where p_brand is not null group by 1")
def cat_counts(spark, sf_dir):
    return category_counts(table(spark, sf_dir, "part"), "p_brand")


@query(CATEGORIES + "select p_partkey, cast(case when p_brand is null then null when id <= 15 then id else 16 end as int) as code from part left join m on p_brand = value")
def cat_encode(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", Categories.fit(df, "p_brand", 15).encode(F.col("p_brand")).alias("code"))


@query(CATEGORIES + "select p_brand as value, count(*) as n from part join m on p_brand = value where id > 15 group by 1")
def cat_rare(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    c = Categories.fit(df, "p_brand", 15)
    return df.filter(c.encode(F.col("p_brand")) == c.rare).groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n"))


@query(CATEGORIES + "select p_partkey, case when id <= 15 then p_brand else 'rare_label' end as brand from part left join m on p_brand = value")
def cat_inverse(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    c = Categories.fit(df, "p_brand", 15)
    return df.select("p_partkey", c.inverse(c.encode(F.col("p_brand"))).alias("brand"))


@query("with m as (select o_orderpriority as p, row_number() over (order by count(*) desc, o_orderpriority) - 1 as id from orders group by 1) select o_orderkey, cast(id as int) as target from orders join m on p = o_orderpriority")
def cat_target(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", Categories.fit(df, "o_orderpriority", 15, for_target=True).encode(F.col("o_orderpriority")).alias("target"))


DIM = "cast(day(last_day({t})) as double)"
CYCLES = {
    "minute_hour": ("events", "event_id", "ts", "minute({t}) / 60.0::double"),
    "hour_day": ("events", "event_id", "ts", "(hour({t}) + case when minute({t}) >= 30 then 1 else 0 end) / 24.0::double"),
    "day_week": ("orders", "o_orderkey", "o_orderdate", "isodow({t}) / 7.0::double"),
    "day_month": ("orders", "o_orderkey", "o_orderdate", "day({t}) / " + DIM),
    "day_year": ("orders", "o_orderkey", "o_orderdate", "dayofyear({t}) / cast(dayofyear(make_date(year({t}), 12, 31)) as double)"),
    "week_month": ("orders", "o_orderkey", "o_orderdate", "round(day({t}) / 7.0::double, 1) / floor(" + DIM + " / 7)"),
    "week_year": ("orders", "o_orderkey", "o_orderdate", "round_even(dayofyear({t}) / 7.0::double, 0) / 52.1775::double"),
    "month_year": ("orders", "o_orderkey", "o_orderdate", "month({t}) / 12.0::double"),
}


def _cycle_query(name, source, key, column, sql):
    def run(spark, sf_dir):
        s, c = C.cycle(F.col(column), *name.split("_"))
        return table(spark, sf_dir, source).select(key, rounded(s).alias("cycle_sin"), rounded(c).alias("cycle_cos"))

    angle = f"({sql.format(t=column)}) * 2 * pi()"
    query(f"select {key}, round(sin({angle}), 6) + 0.0 as cycle_sin, round(cos({angle}), 6) + 0.0 as cycle_cos from {source}", f"cycle_{name}")(run)


for _name, _parts in CYCLES.items():
    _cycle_query(_name, *_parts)


@query("""select o_orderkey, round(case when a < 0 then a + 1 else a end, 6) as share from (select o_orderkey, atan2(sin(month(o_orderdate) / 12.0::double * 2 * pi()), cos(month(o_orderdate) / 12.0::double * 2 * pi())) / (2 * pi()) as a from orders)""")
def cycle_inverse(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(C.cycle_angle(*C.cycle(F.col("o_orderdate"), "month", "year")), 6).alias("share"))


@query("""
with l as (select l_orderkey, l_linenumber,
  (abs(epoch(l_shipdate) + (c_nationkey % 24) * 3600 - epoch(o_orderdate))::bigint % 86400) / 3600.0::double as lag
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
b as (select min(lag) as lo, max(lag) as hi from l)
select l_orderkey, l_linenumber, round(lag, 6) as lag, round((least(greatest(lag, 0.75 * lo), 1.25 * hi) - hi) / (hi - lo), 6) as encoded from l, b""")
def time_lag(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    df = df.select("l_orderkey", "l_linenumber", C.lag(F.col("l_shipdate"), F.col("o_orderdate"), "hour", F.col("c_nationkey") % 24, 0).alias("lag"))
    low, high = df.agg(F.min("lag"), F.max("lag")).first()
    return df.select("l_orderkey", "l_linenumber", F.round("lag", 6).alias("lag"), F.round(C.lag_encode(F.col("lag"), low, high), 6).alias("encoded"))


@query("select o_orderkey, o_orderdate + to_hours(cast(o_custkey % 24 as bigint)) as local from orders")
def localized_time(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.localise(F.col("o_orderdate"), (F.col("o_custkey") % 24).cast("int")).alias("local"))


@query()
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags("html").alias("text"))


@query("select c_custkey, sha256(c_name) as digest from customer")
def hash_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.sha256(F.col("c_name")).alias("digest"))


@query("select p_partkey, case when s = '' then 'item' else s end as slug from (select p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as s from part)")
def slug_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("""select doc_id, cast(len(list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) as int) as sentences from documents""")
def split_sentences_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


@query("""select item_id, cast(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[''’-][\\p{L}\\p{N}_]+)*|[^\\p{L}\\p{N}_\\s]')) as int) as tokens from benchmark""")
def tokenize_counts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(T.tokens(F.col("text"))).alias("tokens"))


@query("""
with t as (select item_id, text, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[''’-][\\p{L}\\p{N}_]+)*|[^\\p{L}\\p{N}_\\s]')) as token from benchmark)
select item_id, token, count(*) as n from t group by 1, 2""")
def token_counts(spark, sf_dir):
    spans = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.token_offsets(F.col("text"))).alias("t"), "text")
    right = spans.filter(F.substring("text", F.col("t.start") + 1, F.col("t.end") - F.col("t.start")) == F.col("t.token"))
    return right.groupBy("item_id", F.col("t.token").alias("token")).agg(F.count("*").alias("n"))


@query("""
with h as (select l_linenumber % 2 as half, count(*) as n, avg(l_quantity) as m, stddev_samp(l_quantity) as s from lineitem group by 1)
select cast(sum(n) as bigint) as n, round((select avg(l_quantity) from lineitem), 6) as mean, round((select stddev_samp(l_quantity) from lineitem), 6) as std from h""")
def running_merge(spark, sf_dir):
    """Two halves of the table fitted apart, then merged."""
    df = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_linenumber") % 2).alias("half"))
    cut = lambda h, f: f(F.when(F.col("half") == h, F.col("l_quantity")))
    halves = df.agg(*[cut(h, f).alias(f"{n}{h}") for h in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))])
    n, m, s = merge_moments(*[F.col(c) for c in ("n0", "m0", "s0", "n1", "m1", "s1")])
    return halves.select(n.cast("long").alias("n"), F.round(m, 6).alias("mean"), F.round(s, 6).alias("std"))


@query("""
with b as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders),
m as (select o_orderpriority as p, row_number() over (order by count(*) desc, o_orderpriority) as id from orders group by 1)
select o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) as price, cast(id as int) as priority,
  round(sin(month(o_orderdate) / 12.0::double * 2 * pi()), 6) + 0.0 as month_year_sin, round(cos(month(o_orderdate) / 12.0::double * 2 * pi()), 6) + 0.0 as month_year_cos,
  round(sin(isodow(o_orderdate) / 7.0::double * 2 * pi()), 6) + 0.0 as day_week_sin, round(cos(isodow(o_orderdate) / 7.0::double * 2 * pi()), 6) + 0.0 as day_week_cos
from orders join m on p = o_orderpriority, b""")
def mixed_pipeline(spark, sf_dir):
    """A pipeline of four encoders: one aggregate fits it, one projection encodes."""
    df = table(spark, sf_dir, "orders")
    p = FeaturePipeline()
    p.min_max("o_totalprice", name="price").categories("o_orderpriority", name="priority").cycle("o_orderdate", "month", "year").cycle("o_orderdate", "day", "week")
    out = p.fit(df).encode(df, keep=["o_orderkey"])
    return out.select("o_orderkey", "priority", *[rounded(F.col(c)).alias(c) for c in ("price", "month_year_sin", "month_year_cos", "day_week_sin", "day_week_cos")])


@query("select o_orderkey, round(o_totalprice, 4) as o_totalprice, o_orderpriority from orders")
def pipeline_decode(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    p = FeaturePipeline().standard("o_totalprice", name="price").categories("o_orderpriority", name="priority").fit(df)
    back = p.decode(p.encode(df, keep=["o_orderkey"]), keep=["o_orderkey"])
    return back.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"), "o_orderpriority")
