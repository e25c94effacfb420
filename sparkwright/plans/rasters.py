"""Queries over rasters of orders, and over batches of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches as B
from ..operators import rasters as R
from .registry import query, rounded, table

MONTHS, DAYS = 84, 7
PRICE = 20_000

# orders by month since 1992 and weekday
COUNTS = "with c as (select (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 as y, dayofweek(o_orderdate) as x, count(*) as value from orders group by 1, 2)"


def _months():
    d = F.col("o_orderdate")
    return ((F.year(d) - 1992) * 12 + F.month(d) - 1).cast("long")


@query(COUNTS + f""", r as (select y, v, sum(value * cos(2 * pi() * x * v / {DAYS})) as re, -sum(value * sin(2 * pi() * x * v / {DAYS})) as im from c, range({DAYS}) t(v) where y between 0 and {MONTHS - 1} group by 1, 2)
select u, v, round(sum(re * (cos(2 * pi() * y * u / {MONTHS}) + sin(2 * pi() * y * u / {MONTHS})) + im * (sin(2 * pi() * y * u / {MONTHS}) - cos(2 * pi() * y * u / {MONTHS}))), 4) + 0.0 as value from r, range({MONTHS}) t(u) group by 1, 2""")
def hartley_2d(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cells = o.groupBy(_months().alias("y"), (F.dayofweek("o_orderdate") - 1).cast("long").alias("x")).agg(F.count("*").alias("value")).filter(F.col("y").between(0, MONTHS - 1))
    return R.hartley_2d(cells, MONTHS, DAYS).select("u", "v", rounded(F.col("value"), 4).alias("value"))


CELLS = f"with recursive c as (select (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 as y, cast(floor(o_totalprice / {PRICE}) as bigint) as x, count(*) as value from orders group by 1, 2)"


def _prices(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(_months().alias("y"), F.floor(F.col("o_totalprice") / PRICE).alias("x")).agg(F.count("*").alias("value"))


@query(CELLS + """, s as (select c.y, c.x, c.value, unnest([-1, 0, 1]) as dy from c), t as (select *, unnest([-1, 0, 1]) as dx from s),
low as (select t.y, t.x, first(struct_pack(y := n.y, x := n.x) order by n.value, n.y, n.x) as n from t join c n on n.y = t.y + dy and n.x = t.x + dx group by 1, 2),
way as (select y, x, n.y as by_, n.x as bx, 0 as step from low union all select way.y, way.x, low.n.y, low.n.x, step + 1 from way join low on low.y = way.by_ and low.x = way.bx where low.n.y <> low.y or low.n.x <> low.x),
bottom as (select y, x, arg_max(by_, step) as bottom_y, arg_max(bx, step) as bottom_x from way group by 1, 2)
select y, x, value, bottom_y, bottom_x from c join bottom using (y, x)""")
def order_basins(spark, sf_dir):
    """Where water would run on the raster of orders by month and price: a cell and those around it, itself included, the lowest wins."""
    return R.basins(_prices(spark, sf_dir)).withColumnsRenamed({"by": "bottom_y", "bx": "bottom_x"})


@query(CELLS + """, n as (select c.y, c.x, avg(b.value) as mean from c join c b on (abs(b.y - c.y) + abs(b.x - c.x)) = 1 group by 1, 2)
select y, x, round(case when y % 2 = x % 2 and y between 1 and 82 and x between 1 and 18 then mean else value end, 6) + 0.0 as value from c left join n using (y, x)""")
def raster_infill(spark, sf_dir):
    return R.infill(_prices(spark, sf_dir), 84, 20).select("y", "x", rounded(F.col("value").cast("double")).alias("value"))


@query("""with d as (select doc_id, n_chars, row_number() over (order by doc_id) - 1 as place, count(*) over () as n from documents),
r as (select i as draw, cast('0x' || substr(md5('draws:' || i), 1, 15) as bigint) as h from range(1024) t(i))
select draw, draw // 64 as batch, doc_id, n_chars from r join d on d.place = r.h % d.n""")
def random_batches(spark, sf_dir):
    """1024 draws from all documents, in batches of 64."""
    return B.random_draws(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], 1024, "draws", 64).select("draw", "batch", "doc_id", "n_chars")


TASKS = ["cloze", "replaced", "deletion", "infilling"]


@query("""with w as (select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as words from documents),
p as (select *, row_number() over (order by words, doc_id) - 1 as place from w),
b as (select *, place // 32 as batch, cast(place % 32 as int) as slot from p)
select doc_id, words, batch, slot, max(words) over (partition by batch) as width, max(words) over (partition by batch) - words as padding,
  ['cloze', 'replaced', 'deletion', 'infilling'][cast('0x' || substr(md5('tasks:' || batch), 1, 15) as bigint) % 4 + 1] as task from b""")
def length_batches(spark, sf_dir):
    """All documents in batches of 32 of like length; each batch has one corruption task."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return B.length_batches(table(spark, sf_dir, "documents").select("doc_id", words.alias("words")), "words", ["doc_id"], 32, TASKS, "tasks")
