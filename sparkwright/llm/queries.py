"""The registered queries of this subpackage, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .content_dedup import exact_dedup
from .gif_media import text_media
from .html_text import extract_text
from .lexical import rank_documents
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .packing import pack_documents
from .pii import digests, find_personal_data
from .quality import quality_rules
from .sharding import balanced_shards
from .simhash import simhash_components
from .spelling import spelling_groups
from .toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"), similarity=0.8).select("doc_id", "n_lines", "n_dropped", "clean_text")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def tokenizer_path() -> str:
    """The public tokenizer that the packing contract names; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096)


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(_table(spark, sf_dir, "documents"), keep_media=False).drop("media")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"), radius=4, size=4)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = balanced_shards(_table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, repeats=2)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_personal_data(_table(spark, sf_dir, "documents")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(_table(spark, sf_dir, "documents"), least_letters=7, least_count=2, ratio=10)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), risk=0.05, error=0.05)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html_text": op2_html_text,
    "op3_packing": op3_packing,
    "op4_gif_media": op4_gif_media,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_spelling": op11_spelling,
    "op12_search": op12_search,
    "op13_quality": op13_quality,
}

ORACLES = {
    "op7_mixing": """
with d as (
  select doc_id, source,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, '')) || ':'
              || cast(row_number() over (partition by doc_id, source, coalesce(text, '')) - 1 as varchar)), 1, 12) as bigint) as h
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
         [5.0::double, 2.0::double, 1.0::double][cast((row_number() over (order by source is null, source) - 1) % 3 + 1 as int)] as weight
  from d group by source),
c as (
  select *, source_size * 2.0::double as cap, sum(source_size) over () as total,
         coalesce(sum(source_size * 2.0::double) over (order by source_size * 2.0::double / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as capped,
         sum(weight) over (order by source_size * 2.0::double / weight, source is null, source rows between current row and unbounded following) as rest
  from s),
l as (select *, (1.5::double * total - capped) / rest as level, cap / weight as ratio from c),
t as (
  select source, source_size, least(cap, (select arg_min(level, ratio) from l where level <= ratio) * weight) as target
  from l),
k as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from t),
r as (
  select d.doc_id, d.size, k.source_size, k.target, k.whole, k.target - k.whole * k.source_size as need,
         sum(d.size) over (partition by d.source order by d.h) as upto,
         sum(d.size) over (partition by d.source, d.h) as own
  from d join k on d.source is not distinct from k.source)
select doc_id, size, source_size, target,
       cast(size * (whole + case when need > 0 and 2 * upto - own <= 2 * need then 1 else 0 end) as bigint) as taken
from r
""",
    "op8_exact_dedup": """
with n as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
""",
    "op11_spelling": r"""
with recursive tab as (
  select list(c order by b) as tbl from (
    select b, list_reduce(list_prepend(cast(b as bigint), [1, 2, 3, 4, 5, 6, 7, 8]::bigint[]), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as c
    from range(256) r(b))),
r as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents),
u as (select doc_id, run, count(*) as k, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as x from r where len(run) >= 7 group by 1, 2),
h as (
  select run, k, xor(4294967295, list_reduce(
           list_prepend(4294967295::bigint, list_transform(range(1, len(x), 2), lambda i: cast(('0x' || substr(x, cast(i as int), 2)) as bigint))),
           lambda c, b: xor(c >> 8, tbl[cast(xor(c, b) & 255 as int) + 1]))) as h
  from u, tab),
w as (
  select word, cast(sum(k) as bigint) as n
  from (select case when h % 31 = 0 then left(run, cast(h % len(run) as int)) || substr(run, cast(h % len(run) as int) + 2) else run end as word, k from h)
  where len(word) >= 7 group by 1 having sum(k) >= 2),
cut as (select word, i, left(word, cast(i as int) - 1) || substr(word, cast(i as int) + 1) as rest from (select word, unnest(range(1, len(word) + 1)) as i from w)),
pair as (
  select a.word as a, b.word as b from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select c.word, w.word from cut c join w on c.rest = w.word
  union select w.word, c.word from cut c join w on c.rest = w.word),
best as (
  select a as word, cast(count(*) as bigint) as n_near, first(b order by n desc, encode(b)) as near, max(n) as m
  from pair join w on w.word = b group by 1),
f as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 10 * w.n then near end as form, case when m >= 10 * w.n then m end as form_n
  from w left join best using (word)),
way as (
  select word, word as cur, 0 as step from f
  union all select way.word, f.form, step + 1 from way join f on f.word = way.cur where f.form is not null),
root as (select word, arg_max(cur, step) as root from way group by 1)
select word, form, root, n, n_near, form_n from f join root using (word)
""",
    "op12_search": r"""
with d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
q as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
size as (select count(*) as docs, sum(len(terms)) as total from d where len(terms) > 0),
t as (select rid, term, cast(count(*) as bigint) as tf from (select rid, unnest(terms) as term from d) group by 1, 2),
df as (select term, count(*) as df from t where term in (select term from q) group by 1),
w as (select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double)) as bigint) as w from df, size),
m as (select rid, doc_id, 10 + (90 * len(terms) * docs) // cast(total as bigint) as m from d, size where len(terms) > 0),
s as (
  select item_id, m.rid, doc_id, cast(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from q join w using (term) join t using (term) join m on m.rid = t.rid group by 1, 2, 3),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0)
select * from r where rank <= 10
""",
    "op13_quality": r"""
with recursive d as (
  select row_number() over () as rid, doc_id, coalesce('=' || lang, '') as stratum, coalesce(text, '') as t from documents),
w as (
  select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from d),
win as (
  select rid, i, array_to_string(words[i:i + 4], ' ') as win
  from (select rid, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5)),
again as (select rid, i from (select *, count(*) over (partition by rid, win) as n from win) where n > 1),
cover as (
  select rid, cast(sum(least(5, coalesce(nxt - i, 5))) as bigint) as n
  from (select rid, i, lead(i) over (partition by rid order by i) as nxt from again) group by rid),
c as (
  select w.rid, doc_id, stratum, md5(t) as digest, cast(len(words) as bigint) as n_words, cast(len(array_to_string(words, '')) as bigint) as word_chars,
         cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(lines) as bigint) as n_lines,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(cover.n, 0) as n_repeat_words,
         len(regexp_extract_all(t, '[A-Z]')) as n_capitals, len(regexp_extract_all(t, '[!-/:-@\[-`{-~]')) as n_marks
  from w left join cover on w.rid = cover.rid),
f as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
         case when n_words > 0 then floor(word_chars * 20 / n_words) else 0 end as mean from c),
m as (
  select *, list_transform([
    case when word_chars > 0 then floor(n_symbols * 1000 / word_chars) else 0 end,
    case when n_lines > 0 then floor(n_dup_lines * 1000 / n_lines) else 0 end,
    case when n_words > 0 then floor(n_repeat_words * 1000 / n_words) else 0 end,
    case when word_chars > 0 then floor(n_capitals * 1000 / word_chars) else 0 end,
    case when word_chars > 0 then floor(n_marks * 1000 / word_chars) else 0 end,
    mean, case when n_words > 0 then 1000 - least(1000, mean) else 0 end, 1000 - least(1000, n_words)], lambda x: cast(least(1000, x) as int)) as ms
  from f),
truth as (select doc_id, max(quality) as q from labels group by doc_id having max(quality) is not null),
known as (
  select stratum, digest, max(q) > 0 as good, any_value(ms) as ms, substr(digest, 1, 1) <= '7' as train
  from m join truth using (doc_id) where not base_failed group by stratum, digest),
lv as (select i - 1 as level, l[i] as share
  from (select [0.0, 0.0005, 0.001, 0.002, 0.004, 0.006, 0.008, 0.01, 0.015, 0.02, 0.025, 0.03, 0.035, 0.04, 0.045, 0.05]::double[] as l), range(1, 17) r(i)),
hist as (
  select stratum, rule, ms[rule] as v, count(*) filter (good) as g, count(*) filter (not good) as b
  from known, range(1, 9) r(rule) where train group by 1, 2, 3),
up as (
  select *, sum(g) over p as g_up, sum(b) over p as b_up, sum(g) over (partition by stratum, rule) as n_g, sum(b) over (partition by stratum, rule) as n_b
  from hist window p as (partition by stratum, rule order by v desc)),
cut0 as (
  select stratum, rule, level, share, min(v) filter (g_up <= share * n_g) as cut, coalesce(max(b_up) filter (g_up <= share * n_g), 0) as caught, max(n_b) as n_b
  from up, lv group by 1, 2, 3, 4),
cut1 as (
  select stratum, rule, level,
         case when bool_or(share = 0.02::double and n_b > 0 and caught >= 0.1::double * n_b) over (partition by stratum, rule) then coalesce(cut, 1001) else 1001 end as cut
  from cut0),
cuts as (select stratum, level, list(cut order by rule) as cuts from cut1 group by 1, 2),
met as (
  select k.stratum, train, good, coalesce((select min(level) from cuts c, range(1, 9) r(j) where c.stratum = k.stratum and k.ms[j] >= c.cuts[j]), 16) as level
  from known k where k.stratum in (select stratum from cuts)),
cnt as (
  select stratum, level, count(*) filter (train and good) as good, count(*) filter (train and not good) as bad, count(*) filter (not train and good) as held
  from met group by 1, 2),
tot as (select stratum, sum(good) as all_good, sum(bad) as all_bad, sum(held) as all_held from cnt group by 1),
grid as (
  select t.*, lv.level, cast(sum(coalesce(good, 0)) over p as bigint) as good, sum(coalesce(bad, 0)) over p as bad, cast(sum(coalesce(held, 0)) over p as bigint) as held
  from tot t cross join lv left join cnt on cnt.stratum = t.stratum and cnt.level = lv.level window p as (partition by t.stratum order by lv.level)),
test as (
  select *, case when held >= all_held * 0.05::double then 1.0
    else list_sum(list_transform(range(0, held + 1), lambda j: exp(lgamma(all_held + 1) - lgamma(j + 1) - lgamma(all_held - j + 1) + j * ln(0.05::double) + (all_held - j) * ln(0.95::double)))) end
    > 0.05::double / (select greatest(count(*), 1) from tot where all_held > 0) as fails
  from grid),
pass as (select *, bool_or(fails) over (partition by stratum order by level) as failed from test),
best as (
  select stratum, level from pass where not failed
  qualify row_number() over (partition by stratum order by round(bad / greatest(all_bad, 1) - good / greatest(all_good, 1), 9) desc, level) = 1),
rule as (
  select m.*, case when n_words < 10 then 'base: few words' when base_failed then 'base: repeated words'
    else ['symbols', 'repeated_lines', 'repeated_words', 'capitals', 'marks', 'long_words', 'short_words', 'few_words'][
      list_position(list_transform(range(1, 9), lambda j: ms[j] >= cuts.cuts[j]), true)] end as reason
  from m left join best on m.stratum = best.stratum left join cuts on cuts.stratum = best.stratum and cuts.level = best.level)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reason is null as kept, reason from rule
""",
}
