"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, small, text_of

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
BLOCK = 256  # matches of a text that are placed together

# A run of name characters is tried from its start only, or from the end of the match before: the same matches, in linear time.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: After single separators between digits are the only ones left, a card candidate is a plain run of characters.
_LOOSE = r"(?<![0-9])[ -]|[ -](?![0-9])"
_CARD = r"[0-9][0-9 -]+"
_HAS_CARD = r"[0-9](?:[ -]?[0-9]){13}"
_BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
_WORD = r"\p{L}{3,}"


def located(text: Column, pattern: str, source: Column | None = None, keep: Callable[[Column], Column] | None = None) -> Column:
    """Array of struct(start, end, value) of all matches, or of those whose value passes `keep`, in code points, the end exclusive.

    The lengths of the pieces between matches give the places; `source` is the text that values are taken from if it
    differs from the searched one, which must then agree with it position by position.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
    pairs = F.zip_with(pieces, values, lambda p, v: F.struct(F.char_length(p).alias("gap"), F.char_length(v).alias("len"), v.alias("value")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["len"]
        value = x["value"] if source is None else F.substring(source, begin + 1, x["len"])
        put = F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), value.alias("value"))))
        return F.struct(end.alias("at"), (put if keep is None else F.when(keep(x["value"]), put).otherwise(acc["out"])).alias("out"))

    def part(block: Column) -> Column:
        return F.aggregate(block["items"], F.struct(block["at"].alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def place(acc: Column, items: Column) -> Column:
        after = F.aggregate(items, acc["at"], lambda n, x: n + x["gap"] + x["len"])
        return F.struct(after.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), items.alias("items")))).alias("out"))

    def whole(found: Column) -> Column:
        # an array grows by copying, so matches are placed in blocks: first where each block begins, then inside it
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda i: F.slice(found, i * BLOCK + 1, F.lit(BLOCK)))
        begun = F.struct(F.lit(0).alias("at"), F.slice(F.array(F.struct(F.lit(0).alias("at"), found.alias("items"))), 1, 0).alias("out"))
        return F.flatten(F.transform(F.aggregate(blocks, begun, place, lambda acc: acc["out"]), part))

    # the array of pairs is bound to a name, so that no block works it out again
    return F.when(F.size(values) > 0, F.get(F.transform(F.array(pairs), whole), F.lit(0))).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)
    n = F.char_length(d)

    def digit(i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int") * (2 - i % 2)
        return F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + digit(i))
    return F.when(n.between(14, 19), total % 10 == 0).otherwise(False)


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the array of struct(start, end, value) of valid matches; failing matches are dropped without retries."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    email = F.when(F.contains(text, F.lit("@")), located(text, _EMAIL)).otherwise(none)
    ip = F.filter(located(text, _IP), lambda m: F.forall(F.split(m["value"], r"\."), lambda p: F.rlike(p, F.lit(_BYTE))))
    plain = F.regexp_replace(text, _LOOSE, "x")
    card = F.when(F.rlike(text, F.lit(_HAS_CARD)), F.filter(located(plain, _CARD), lambda m: _luhn(m["value"]))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(located(text, _PHONE), lambda m: F.char_length(_digits(m["value"])).between(10, 15))).otherwise(none)
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda x: x == kind


def _tagged(kind: str) -> Column:
    return F.transform(F.col(kind), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))


def _row_key(th, th2) -> Column:
    """Rows of the same id and text share it; over columns id and the text's two hashes."""
    return F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull().cast("string"), _column(th).cast("string"), _column(th2).cast("string"))


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _entities(base: Column) -> Column:
    """What the base matches of a text reveal: each value, and the group it belongs to (mail domain, network, number range, issuer)."""
    value = lambda s: F.lower(F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(s["value"]))

    def group(s: Column) -> Column:
        v = value(s)
        mail, net = F.substring_index(v, "@", -1), F.substring_index(v, ".", 3)
        return F.when(s["kind"] == "email", mail).when(s["kind"] == "ip", net).otherwise(F.substring(v, F.lit(1), F.lit(6)))

    named = F.transform(base, lambda s: F.concat_ws("=", s["kind"], value(s)))
    return F.array_distinct(F.concat(named, F.transform(base, lambda s: F.concat_ws("~", s["kind"], group(s)))))


def disclosing_terms(found: DataFrame, support: int, disclosure: float, certainty: float, evidence: float) -> DataFrame:
    """term, entity, n_te, n_t, n_e, total: the pairs of find_personal_data's rule, counted over the distinct texts of found."""
    total = found.agg(F.count_distinct("th", "th2")).first()[0]
    reps = found.groupBy("th", "th2").agg(F.min("rid").alias("rid")).select("rid")
    # shuffled as one string: an array of short strings takes several times the room
    texts = found.select("rid", (F.size("entities") > 0).cast("long").alias("private"), F.array_join("terms", " ").alias("terms")).join(reps, "rid", "left_semi")
    words = texts.filter("terms <> ''").select(F.explode(F.split("terms", " ")).alias("term"), "private")
    counts = words.groupBy("term").agg(F.count("*").alias("n_t"), F.sum("private").alias("n_p"))
    # a term of a pair that passes stands in at least `support` texts with entities, and these are at least `certainty` of its texts
    rare = small(materialise(counts.filter((F.col("n_p") >= support) & (F.col("n_p") >= certainty * F.col("n_t"))).select("term", "n_t"), "pii-rare"))
    private = found.filter(F.size("entities") > 0).select("rid", "entities", "terms").join(reps, "rid", "left_semi")
    n_e = private.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= support)
    n_e = small(materialise(n_e, "pii-entities"))
    terms = private.select("rid", F.explode("terms").alias("term")).join(rare, "term").select("rid", "term", "n_t")
    entities = private.select("rid", F.explode("entities").alias("entity")).join(n_e, "entity").select("rid", "entity", "n_e")
    pairs = terms.join(entities, "rid").groupBy("term", "entity").agg(F.count("*").alias("n_te"), F.max("n_t").alias("n_t"), F.max("n_e").alias("n_e"))
    told = F.log2(F.col("n_te") * float(total) / (F.col("n_t") * F.col("n_e")))
    info = F.log2(F.lit(float(total)) / F.col("n_e"))
    enough = (F.col("n_te") >= support) & (F.col("n_te") >= certainty * F.col("n_t")) & (info > 0) & (told >= disclosure * info) & (F.col("n_te") * told * 0.6931471805599453 >= evidence)
    return pairs.filter(enough).withColumn("total", F.lit(total))


def find_personal_data(docs: DataFrame, support: int = 3, disclosure: float = 0.8, certainty: float = 0.5, evidence: float = 12.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_email, n_ip, n_card, n_phone, base (array), terms (array), and `rk`, its row key.

    Protected entities are the values of valid base matches and their groups: a mail domain, the first three parts of an
    address, the first six digits of a number. Terms are words of three letters or more, case folded, wherever they stand in a
    text. Over the distinct texts of the corpus, a term t discloses an entity e if both occur together in at least `support`
    texts, p(e|t) is at least `certainty`, PMI(t; e) = log2(n_te N / (n_t n_e)) is at least `disclosure` times the
    entity's own information log2(N / n_e), and n_te PMI is worth `evidence` nats, which chance pairs don't reach.
    Such a term is marked everywhere, in texts without the entity too; sanitised() generalises it.

    Copies count once, so that the words of a document copied many times aren't taken for disclosing ones. Null text counts
    as empty; texts are read whole. Rows that repeat id and text get equal results, one each, and ties don't arise: every pair
    that passes counts. Columns other than id and text are not read, so their names can't clash. An empty table gives an empty
    result.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    found = rows.select("id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    found = found.select("id", "text", F.concat(*[_tagged(k) for k in KINDS]).alias("base"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))
    found = found.select("id", F.xxhash64("text").alias("th"), F.xxhash64(F.lit(1), "text").alias("th2"), "base", _entities(F.col("base")).alias("entities"), words.alias("terms"))
    found = materialise(found.select(F.monotonically_increasing_id().alias("rid"), _row_key("th", "th2").alias("rk"), "*"), "pii-base", compression="zstd")

    told = disclosing_terms(found, support, disclosure, certainty, evidence)
    told = materialise(told.select("term").distinct(), "pii-terms")
    hits = found.select("rk", F.explode("terms").alias("term")).join(small(told), "term").groupBy("rk").agg(F.collect_set("term").alias("told"))
    hits = materialise(hits, "pii-hits")
    keyed = rows.select("text", _row_key(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).alias("rk"))
    marked = located(F.col("text"), _WORD, keep=lambda w: F.array_contains("told", F.lower(w)))
    span = lambda w: F.struct(w["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), w["end"].alias("end"), F.lit(TERM).alias("kind"), w["value"].alias("value"))
    extra = keyed.join(small(hits), "rk").select("rk", F.transform(marked, span).alias("marked")).dropDuplicates(["rk"])
    extra = materialise(extra, "pii-extra")
    out = found.drop("terms").join(extra, "rk", "left").withColumn("terms", F.coalesce("marked", F.array().cast(found.schema["base"].dataType)))
    counts = [F.size(F.filter(F.col("base.kind"), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("id").alias(id_col), *counts, "base", "terms", "rk")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The spans as text, and the digest of the base ones."""
    return found.select(id_col, *[f"n_{k}" for k in KINDS], F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("base", "terms")).alias("spans"))


def sanitised(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and clean_text: base matches become [kind], disclosing terms a generalisation ([term]). Overlapping spans become one."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("rk", _row_key(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")))
    spans = found.select("rk", F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))).alias("spans")).dropDuplicates(["rk"])
    text = F.col("text")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        put = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]"))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), put.alias("out"))

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text)))
    return rows.join(spans, "rk").select(F.col("id").alias(id_col), F.aggregate("spans", begin, step, end).alias("clean_text"))
