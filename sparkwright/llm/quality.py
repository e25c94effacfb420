"""Quality rules with risk-controlled thresholds, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, small, text_of

WHITE = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Each rule's measure is a whole number from 0 to TOP, larger being worse.
TOP = 1000
RULES = ("symbols", "repeated_lines", "repeated_words", "capitals", "marks", "long_words", "short_words", "few_words")
#: The path of nested cutoffs: shares of good training documents beyond a rule's cutoff.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.004, 0.006, 0.008, 0.01, 0.015, 0.02, 0.025, 0.03, 0.035, 0.04, 0.045, 0.05)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once for a row even where `use` names it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def lines_of(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that stand in a window of so many words found twice or more in the text, as an int.

    Windows are told apart by 64-bit hashes first; only a text in which two agree sorts them, and only the windows that
    agree are compared as strings. All of it is linear in the text but for the sort.
    """
    at = lambda a, i: [F.get(a, i + k) for k in range(window)]

    def beside(rows: Column, field: str) -> Column:
        """Of rows sorted by field those that have an equal neighbour."""
        return F.filter(rows, lambda s, j: F.coalesce((F.get(rows, j - 1)[field] == s[field]) & (j > 0), F.lit(False)) | F.coalesce(F.get(rows, j + 1)[field] == s[field], F.lit(False)))

    def spread(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, j: F.least(F.lit(window), F.coalesce(F.get(starts, j + 1), s + window) - s))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    def exact(same: Column) -> Column:
        texts = F.sort_array(F.transform(same, lambda s: F.struct(F.concat_ws(" ", *at(words, s["at"])).alias("w"), s["at"].alias("at"))))
        return _once(texts, lambda t: _once(F.sort_array(F.transform(beside(t, "w"), lambda s: s["at"])), spread))

    def search(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        found = _once(keyed, lambda k: _once(beside(k, "h"), exact))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)

    def windows(each: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(each) - window), lambda i: F.xxhash64(*at(each, i)))

    hashed = _once(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _once(windows(h), search))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(hashed)


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_marks (all long) in place of the text."""
    rest = [c for c in docs.columns if c != text]
    split = docs.select(*rest, text, words_of(F.col(text)).alias("_words"), lines_of(F.col(text)).alias("_lines"))
    counts = {
        "n_words": F.size("_words"), "word_chars": F.char_length(F.array_join("_words", "")), "n_symbols": F.regexp_count(F.col(text), F.lit(SYMBOLS)),
        "n_lines": F.size("_lines"), "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")), "n_repeat_words": repeated_words(F.col("_words")),
        "n_capitals": F.regexp_count(F.col(text), F.lit("[A-Z]")), "n_marks": F.regexp_count(F.col(text), F.lit(r"[!-/:-@\[-`{-~]")),
    }
    return split.select(*rest, *[c.cast("long").alias(k) for k, c in counts.items()])


def measures() -> Column:
    """Array of the rules' measures, in the order of RULES, from the columns of text_counts()."""
    part = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * TOP / F.col(b))).otherwise(0)
    mean = F.when(F.col("n_words") > 0, F.floor(F.col("word_chars") * 20 / F.col("n_words"))).otherwise(0)
    short = F.when(F.col("n_words") > 0, TOP - F.least(F.lit(TOP), mean)).otherwise(0)
    few = TOP - F.least(F.lit(TOP), F.col("n_words"))
    every = [part("n_symbols", "word_chars"), part("n_dup_lines", "n_lines"), part("n_repeat_words", "n_words"), part("n_capitals", "word_chars"), part("n_marks", "word_chars"), mean, short, few]
    return F.array(*[F.least(F.lit(TOP), c).cast("int") for c in every])


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of X ~ Bin(n, p), summed term by term in logarithms; 1 where k >= n p, where it is no less than about a half.

    It is at most delta exactly where the Clopper-Pearson upper bound at confidence 1 - delta of a rate seen k times in n is at most p.
    """
    import math

    first = n * math.log1p(-p)
    odds = math.log(p / (1 - p))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + F.lit(odds)
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    start = F.struct(first.alias("term"), first.alias("total"))
    total = F.when(k < 1, F.exp(first)).otherwise(F.exp(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, step, lambda acc: acc["total"])))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def candidate_cutoffs(labelled: DataFrame, gain: float = 5.0) -> DataFrame:
    """stratum, level, cuts: for each level of the path the rules' cutoffs, learned from the training fold alone.

    A rule's cutoff at a level is the least measure that at most that share of the good training documents reach. A rule takes
    part in a stratum if at the level of 0.02 its cutoff catches at least `gain` times that share of the bad ones; otherwise its
    cutoff is out of reach. Counts by measure suffice: at most strata x rules x 1001 rows, whatever the number of labels.
    """
    every = labelled.select("stratum", "good", F.posexplode("measures").alias("rule", "m"))
    hist = every.groupBy("stratum", "rule", "m").agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
    above = Window.partitionBy("stratum", "rule").orderBy(F.col("m").desc())
    whole = Window.partitionBy("stratum", "rule")
    hist = hist.select("stratum", "rule", "m", F.sum("g").over(above).alias("g_up"), F.sum("b").over(above).alias("b_up"), F.sum("g").over(whole).alias("n_g"), F.sum("b").over(whole).alias("n_b"))
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(e).alias("share")) for i, e in enumerate(LEVELS)]))
    within = F.col("g_up") <= F.col("l.share") * F.col("n_g")
    cuts = hist.select("*", levels.alias("l")).groupBy("stratum", "rule", "l").agg(F.min(F.when(within, F.col("m"))).alias("cut"), F.coalesce(F.max(F.when(within, F.col("b_up"))), F.lit(0)).alias("caught"), F.max("n_b").alias("n_b"))
    # between the highest good measure and the next seen above it nothing was seen, so that the lowest cutoff is the one seen
    judge = Window.partitionBy("stratum", "rule")
    active = F.max(F.when(F.col("l.share") == 0.02, (F.col("n_b") > 0) & (F.col("caught") >= gain * 0.02 * F.col("n_b")))).over(judge)
    cuts = cuts.select("stratum", "rule", "l.level", F.when(active, F.coalesce("cut", F.lit(TOP + 1))).otherwise(TOP + 1).alias("cut"))
    return cuts.groupBy("stratum", "level").agg(F.transform(F.sort_array(F.collect_list(F.struct("rule", "cut"))), lambda x: x["cut"]).alias("cuts"))


def _fires(cuts: Column, found: Column) -> Column:
    return F.exists(F.zip_with(cuts, found, lambda c, m: m >= c), lambda x: x)


def first_levels(labelled: DataFrame, candidates: DataFrame) -> DataFrame:
    """stratum, train, good, level, n: how many labelled documents are first rejected at each level (len(LEVELS): at none)."""
    paths = candidates.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("level", "cuts"))).alias("path"))
    met = labelled.join(small(materialise(paths, "quality-paths")), "stratum")
    first = F.array_min(F.transform(F.filter("path", lambda x: _fires(x["cuts"], F.col("measures"))), lambda x: x["level"]))
    return met.groupBy("stratum", "train", "good", F.coalesce(first, F.lit(len(LEVELS))).alias("level")).agg(F.count("*").alias("n"))


def controlled_cutoffs(counts: DataFrame, candidates: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """stratum, level, cuts, n, k: of each stratum's path the best cutoffs that provably reject at most a share `risk` of good documents.

    counts comes from first_levels(). With probability 1 - error the bound holds for all strata at once. From the mildest cutoffs
    on, each is tested on the good documents outside the training fold (n of them, k rejected) by the exact binomial bound, and
    the first that fails ends its path: testing in a fixed order needs no correction along a path, since a later test counts only
    if all earlier ones passed, and `error` is divided by the number of strata (Bonferroni). All that pass hold together, so
    any of them may be taken: the one whose share of bad training documents rejected is furthest above the share of good
    ones, the mildest of equals. Strata in which no cutoff passes are not returned.
    """
    each = counts.groupBy("stratum", "level").agg(*[F.sum(F.when(F.expr(c), F.col("n")).otherwise(0)).alias(k) for k, c in {"good": "train and good", "bad": "train and not good", "held": "not train and good"}.items()])
    each = materialise(each, "quality-levels")  # at most a row for each stratum and level
    strata = each.filter("held > 0").select("stratum").distinct().count()
    levels = F.explode(F.array(*map(F.lit, range(len(LEVELS))))).alias("level")
    grid = each.groupBy("stratum").agg(*[F.sum(c).alias(f"all_{c}") for c in ("good", "bad", "held")]).select("*", levels).join(each, ["stratum", "level"], "left")
    upto = Window.partitionBy("stratum").orderBy("level")
    grid = grid.select("stratum", "level", *[F.col(f"all_{c}") for c in ("good", "bad", "held")], *[F.sum(F.coalesce(c, F.lit(0))).over(upto).alias(c) for c in ("good", "bad", "held")])
    tested = grid.withColumn("fails", (binomial_at_most(F.col("held"), F.col("all_held"), risk) > error / max(strata, 1)).cast("int"))
    passed = tested.withColumn("failed", F.max("fails").over(upto)).filter("failed = 0")
    share = lambda c: F.col(c) / F.greatest(F.col(f"all_{c}"), F.lit(1))
    best = F.max_by(F.struct("level", F.col("all_held").alias("n"), F.col("held").alias("k")), F.struct(F.round(share("bad") - share("good"), 9), -F.col("level")))
    return passed.groupBy("stratum").agg(best.alias("x")).select("stratum", "x.*").join(candidates, ["stratum", "level"])


def quality_rules(
    docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", cutoffs: DataFrame | None = None,
) -> DataFrame:
    """One row for each document: id, the counts of text_counts(), base_failed, kept and reason (the rule that rejects it, or null).

    Base rules reject texts of under 10 words and those with over a fifth of repeated words. Of the rest, a document goes if one
    of its measures reaches the cutoff of its stratum. Cutoffs come from labelled documents that pass the base rules, each
    distinct text once (a text is good if one of its labels says so), half of them to propose cutoffs and half to bound their
    false rejections: see controlled_cutoffs(). `cutoffs` (stratum, cuts) replaces the learned ones.

    Null text counts as empty. A null stratum is a stratum of its own. A stratum with too few labels to prove anything, an
    empty labels table included, keeps what passes the base rules. Null ids have no label; a repeated id lends its label to
    each of its rows, and equal rows are judged alike, so ties don't arise. Texts of any length are read whole. Columns other
    than id, text and stratum are not read, so their names can't clash. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(stratum_col)), F.lit("")).alias("stratum"), text_of(text_col).alias("text"))
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = materialise(text_counts(rows).select("*", failed.alias("base_failed"), measures().alias("measures")), "quality-counts", compression="zstd")
    if cutoffs is None:
        truth = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("q")).filter("q is not null")
        known = found.filter("not base_failed").select("id", "stratum", "digest", "measures").join(truth, "id")
        known = known.groupBy("stratum", "digest").agg(F.max("q").alias("q"), F.first("measures").alias("measures"))
        known = materialise(known.select("stratum", "measures", (F.col("q") > 0).alias("good"), F.col("digest").substr(1, 1).isin(*"01234567").alias("train")), "quality-labelled")
        candidates = materialise(candidate_cutoffs(known.filter("train")), "quality-candidates")
        cutoffs = controlled_cutoffs(first_levels(known, candidates), candidates, risk, error)
    cutoffs = small(materialise(cutoffs.select("stratum", "cuts"), "quality-cutoffs"))
    out = found.join(cutoffs, "stratum", "left")
    reached = F.array_position(F.zip_with("cuts", "measures", lambda c, m: m >= c), F.lit(True))
    names = F.array(*map(F.lit, RULES))
    reason = F.when(F.col("n_words") < 10, "base: few words").when(F.col("base_failed"), "base: repeated words").when(reached > 0, F.element_at(names, F.greatest(reached, F.lit(1)).cast("int")))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("id").alias(id_col), *counts, "base_failed", reason.isNull().alias("kept"), reason.alias("reason"))
