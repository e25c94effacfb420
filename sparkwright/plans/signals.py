"""Queries over long series: the values of events in order, all of them or by user, and the vectors of embeddings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import signals as S
from .registry import query, rounded, table

FACTORS = [2, 2, 4]
LEAST, N_FFT = 8, 16
TAPER = [0.54 - 0.46 * math.cos(2 * math.pi * i / 15) for i in range(16)]
STEP = 8

USERS = "with s as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as pos, value::double as value from events)"


def _by_user(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return S.series_positions(e, ["user_id"], ["event_id"])


@query("""with s as (select unnest(embedding)::double as x, unnest(range(0, len(embedding))) as pos from embeddings)
select cast(pos as int) as pos, count(*) as n, round(avg(x), 6) + 0.0 as mean, round(stddev_pop(x), 6) + 0.0 as std, round(min(x), 6) + 0.0 as least, round(max(x), 6) + 0.0 as most from s group by 1""")
def embedding_moments(spark, sf_dir):
    out = S.position_moments(table(spark, sf_dir, "embeddings"), "embedding")
    return out.select("pos", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "least", "most")])


def _pyramid_sql() -> str:
    parts = ["with l0 as (select row_number() over (order by event_id) - 1 as pos, value::double as value from events)"]
    for i, q in enumerate(FACTORS):
        taps = S.low_pass(q)
        rows = ", ".join(f"({k - len(taps) // 2}, {w!r}::double)" for k, w in enumerate(taps))
        parts.append(f"t{i} as (select * from (values {rows}) v(k, w))")
        parts.append(f"l{i + 1} as (select m.pos, sum(w * value) / sum(w) as value from (select distinct pos // {q} as pos from l{i}) m, t{i} join l{i} on l{i}.pos = m.pos * {q} + k group by m.pos)")
    return ", ".join(parts) + " " + " union all ".join(f"select {i} as level, pos, round(value, 6) + 0.0 as value from l{i}" for i in range(len(FACTORS) + 1))


@query(_pyramid_sql())
def value_pyramid(spark, sf_dir):
    """All values as one series, halved twice and quartered: it lies in blocks over all tasks."""
    e = S.series_positions(table(spark, sf_dir, "events").select("event_id", "value"), [], ["event_id"])
    return S.pyramid(e, [], FACTORS).select("level", "pos", rounded(F.col("value")).alias("value"))


@query(USERS + f""", n as (select user_id, count(*) as n, stddev_pop(value) as sd, cast(pow(2, floor(log2(count(*) // {LEAST}))) as bigint) as most from s group by 1 having count(*) >= {LEAST}),
l as (select user_id, sd, level, cast(ceil(n / most) * most / pow(2, level) as bigint) as size from (select *, unnest(range(0, cast(log2(most) as bigint) + 1)) as level from n)),
f as (select user_id, sd, level, size, pos // size as win, pos % size as i, value * (0.5 - 0.5 * cos(2 * pi() * (pos % size) / (size - 1))) as x from s join l using (user_id)),
w as (select *, unnest(range(0, {N_FFT // 2 + 1})) as freq from f),
c as (select user_id, sd, level, size, win, freq, sum(x * cos(2 * pi() * freq * i / {N_FFT})) as re, sum(x * sin(2 * pi() * freq * i / {N_FFT})) as im from w group by all)
select user_id, cast(level as int) as level, win, cast(freq as int) as freq, round((case when freq > 0 and 2 * freq < {N_FFT} then 2 else 1 end) * (re * re + im * im) / (0.375 * (size - 1) * pow(sd + 1e-12, 2)), 5) + 0.0 as power from c""")
def dyadic_power(spark, sf_dir):
    out = S.dyadic_power(_by_user(spark, sf_dir), ["user_id"], LEAST, N_FFT)
    return out.select("user_id", "level", "win", "freq", rounded(F.col("power"), 5).alias("power"))


@query(USERS + f""", n as (select user_id, max(pos) as last from s group by 1 having max(pos) >= {len(TAPER) - 1})
select user_id, pos, round(value, 5) + 0.0 as value from s join n using (user_id) where pos < ((last - {len(TAPER) - 1}) // {STEP}) * {STEP} + {len(TAPER)}""")
def spectrum_round_trip(spark, sf_dir):
    """Values to power and phase and back: what the whole windows cover comes out as it went in."""
    found = S.spectra(_by_user(spark, sf_dir), ["user_id"], TAPER, STEP)
    kept = found.select("user_id", "win", "freq", S.power(F.col("c"), F.col("freq"), TAPER).alias("p"), S.angle(F.col("c")).alias("phase"))
    back = kept.select("user_id", "win", "freq", S.from_power(F.col("p"), F.col("phase"), F.col("freq"), TAPER).alias("c"))
    out = S.inverse_spectra(back, ["user_id"], TAPER, STEP)
    return out.select("user_id", "pos", rounded(F.col("value"), 5).alias("value"))


def _haar_sql() -> str:
    parts = [USERS, "l0 as (select user_id, pos, value, count(*) over (partition by user_id) as n, first(value) over (partition by user_id order by pos) as x0 from s)"]
    for i in range(3):
        parts.append(f"d{i} as (select user_id, pos // 2 as p, max(value) filter (pos % 2 = 0) as a, coalesce(max(value) filter (pos % 2 = 1), any_value(x0)) as b from l{i} group by 1, 2)")
        parts.append(f"l{i + 1} as (select user_id, p as pos, (a + b) / sqrt(2) as value, (b - a) / sqrt(2) as high, count(*) over (partition by user_id) as n, first((a + b) / sqrt(2)) over (partition by user_id order by p) as x0 from d{i})")
    return ", ".join(parts) + " " + " union all ".join(f"select {i} as level, user_id, pos, round(value, 6) + 0.0 as low, round(high, 6) + 0.0 as high from l{i}" for i in (1, 2, 3))


@query(_haar_sql())
def haar_levels(spark, sf_dir):
    out = S.haar(_by_user(spark, sf_dir), ["user_id"], 3)
    return out.select("level", "user_id", "pos", rounded(F.col("low")).alias("low"), rounded(F.col("high")).alias("high"))


@query(USERS + """, n as (select user_id, count(*) as n, max(value) filter (pos = 0) as x0, max(value) filter (pos = count_) as xl from (select *, max(pos) over (partition by user_id) as count_ from s) group by 1)
select s.user_id, s.pos, round(case when n % 2 = 1 and n > 1 and s.pos = 0 then 2 * value when n = 1 then 2 * value else value end, 6) + 0.0 as value from s join n using (user_id)""")
def haar_round_trip(spark, sf_dir):
    """There and back: even series come out as they were, in odd ones the value that two pairs share counts twice."""
    rows = _by_user(spark, sf_dir)
    sizes = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    out = S.haar_back(S.haar_step(rows, ["user_id"]), ["user_id"], sizes)
    return out.select("user_id", "pos", rounded(F.col("value")).alias("value"))
