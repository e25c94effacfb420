"""Array windows, shifts, paddings and token layouts."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bound

#: Ids of the control tokens; content ids begin at 20.
SPECIAL = {"pad": 0, "cls": 1, "sep": 2, "mask": 3, "bos": 4, "eos": 5, "unk": 6, "inst": 7, "inst_end": 8, "sys": 9, "sys_end": 10, "user": 11, "user_end": 12, "answer": 13, "answer_end": 14, "mark": 15}
CONTENT = 20


def _id(name: str) -> Column:
    return F.array(F.lit(SPECIAL[name]))


def windows(a: Column, size: int, overlap: int) -> Column:
    """Windows of `size` values, each sharing `overlap` with the one before; a tail too short for one is dropped."""
    overlap = size - 1 if overlap >= size else overlap
    step = size - overlap
    count = F.ceil((F.size(a) - size + 1) / F.lit(step)).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(a, i * step + 1, F.lit(size)))).otherwise(F.slice(F.array(a), 1, 0))


def shift_left(a: Column, by: int = 1) -> Column:
    return F.concat(F.slice(a, by + 1, F.size(a)), F.array_repeat(F.element_at(a, 1) * 0, F.least(F.lit(by), F.size(a)).cast("int")))


def shift_right(a: Column, by: int = 1) -> Column:
    return F.concat(F.array_repeat(F.element_at(a, 1) * 0, F.least(F.lit(by), F.size(a)).cast("int")), F.slice(a, F.lit(1), F.greatest(F.size(a) - by, F.lit(0))))


def pad(ids: Column, length: int, left: bool = False, fill: int = 0) -> Column:
    """Cut to `length`, or filled up on the right or on the left."""
    cut = F.slice(ids, 1, length)
    filler = F.array_repeat(F.lit(fill), F.lit(length) - F.size(cut))
    return F.concat(filler, cut) if left else F.concat(cut, filler)


def padding_mask(ids: Column) -> Column:
    """1 where there is a token, 0 where there is padding."""
    return F.transform(ids, lambda x: (x != SPECIAL["pad"]).cast("int"))


def hash_ids(tokens: Column, vocabulary: int) -> Column:
    """Ids from a hash vocabulary: content ids from crc32, stable across engines that have it."""
    return F.transform(tokens, lambda t: (F.crc32(t.cast("binary")) % vocabulary + CONTENT).cast("int"))


def cls_sequence(ids: Column) -> Column:
    return F.concat(_id("cls"), ids, _id("sep"))


def paired_sequence(a: Column, b: Column) -> Column:
    return F.concat(_id("cls"), a, _id("sep"), b, _id("sep"))


def segment_ids(a: Column, b: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(0), F.size(a) + 2), F.array_repeat(F.lit(1), F.size(b) + 1))


def fit_pair(a: Column, b: Column, room: int) -> tuple[Column, Column]:
    """Both cut so that they share the room: the shorter keeps what it has, up to half or more if the other leaves it."""
    half = room // 2
    keep_a = F.when(F.size(a) + F.size(b) <= room, F.size(a)).otherwise(F.least(F.size(a), F.greatest(F.lit(half), room - F.size(b))))
    return F.slice(a, F.lit(1), keep_a), F.slice(b, F.lit(1), F.greatest(room - keep_a, F.lit(0)))


def instruction_sequence(ids: Column) -> Column:
    return F.concat(_id("inst"), ids, _id("inst_end"))


def system_user_sequence(system: Column, user: Column) -> Column:
    return F.concat(_id("sys"), system, _id("sys_end"), _id("user"), user, _id("user_end"))


def question_answer_sequence(question: Column, answer: Column) -> Column:
    return F.concat(_id("user"), question, _id("user_end"), _id("answer"), answer, _id("answer_end"))


def multi_turn_sequence(turns: Column) -> Column:
    """turns: array<struct<role, ids>> in order; each wrapped by the marks of its role."""

    def wrap(t: Column) -> Column:
        marks = {r: (_id(r), _id(f"{r}_end")) for r in ("sys", "user", "answer")}
        out = F.concat(marks["answer"][0], t["ids"], marks["answer"][1])
        out = F.when(t["role"] == "user", F.concat(marks["user"][0], t["ids"], marks["user"][1])).otherwise(out)
        return F.when(t["role"] == "system", F.concat(marks["sys"][0], t["ids"], marks["sys"][1])).otherwise(out)

    return F.flatten(F.transform(turns, wrap))


def decision_sequence(instruction: Column, options: Column, state: Column, length: int) -> Column:
    """struct(ids, marker_pos, marker_end): [CLS] instruction [SEP] ([MARK] option)* [SEP] state, the state cut to fit.

    options is array<array<int>>; marker positions point at each option's mark, ends just behind its last id.
    """
    start = F.struct((F.size(instruction) + 2).alias("at"), F.array().cast("array<int>").alias("pos"), F.array().cast("array<int>").alias("end"))

    def step(acc: Column, o: Column) -> Column:
        stop = acc["at"] + 1 + F.size(o)
        return F.struct(stop.alias("at"), F.concat(acc["pos"], F.array(acc["at"])).alias("pos"), F.concat(acc["end"], F.array(stop)).alias("end"))

    marks = F.aggregate(options, start, step)
    body = F.concat(_id("cls"), instruction, _id("sep"), F.flatten(F.transform(options, lambda o: F.concat(_id("mark"), o))), _id("sep"))
    ids = F.concat(body, F.slice(state, F.lit(1), F.greatest(F.lit(length) - F.size(body), F.lit(0))))
    return F.struct(ids.alias("ids"), marks["pos"].alias("marker_pos"), marks["end"].alias("marker_end"))


def cloze(ids: Column, key: Column, seed: int, vocabulary: int, share: int = 15) -> Column:
    """struct(ids, labels): `share` percent of the content ids are hidden, of these 80 % masked, 10 % replaced, 10 % left.

    A hash of (seed, key, place) decides, so the draw doesn't depend on the partitioning. Labels are -100 elsewhere.
    """

    def draw(i: Column, salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), key, i, F.lit(salt)), F.lit(1000))

    def chosen(x: Column, i: Column) -> Column:
        return (x >= CONTENT) & (draw(i, 1) < share * 10)

    def hide(x: Column, i: Column) -> Column:
        other = (F.pmod(F.xxhash64(F.lit(seed), key, i, F.lit(3)), F.lit(vocabulary)) + CONTENT).cast("int")
        return F.when(~chosen(x, i), x).when(draw(i, 2) < 800, SPECIAL["mask"]).when(draw(i, 2) < 900, other).otherwise(x)

    return F.struct(F.transform(ids, hide).alias("ids"), F.transform(ids, lambda x, i: F.when(chosen(x, i), x).otherwise(-100)).alias("labels"))


def replaced_tokens(ids: Column, key: Column, seed: int, vocabulary: int, share: int = 15) -> Column:
    """struct(ids, labels): some content ids replaced by other ones; label 1 where the id has changed."""

    def other(x: Column, i: Column) -> Column:
        new = (F.pmod(F.xxhash64(F.lit(seed), key, i, F.lit(7)), F.lit(vocabulary)) + CONTENT).cast("int")
        return F.when((x >= CONTENT) & (F.pmod(F.xxhash64(F.lit(seed), key, i, F.lit(5)), F.lit(100)) < share), new).otherwise(x)

    new = F.transform(ids, other)
    return F.struct(new.alias("ids"), F.zip_with(ids, new, lambda a, b: (a != b).cast("int")).alias("labels"))


def deleted_tokens(ids: Column, key: Column, seed: int, share: int = 15) -> Column:
    """struct(ids, labels): some content ids gone; the label of a kept one is the number deleted just before it."""
    kept = F.filter(F.transform(ids, lambda x, i: F.struct(x.alias("x"), i.alias("i"), ((x < CONTENT) | (F.pmod(F.xxhash64(F.lit(seed), key, i, F.lit(9)), F.lit(100)) >= share)).alias("k"))), lambda z: z["k"])
    # the places of the kept ids tell how many are gone between them; no growing array, so long texts take linear time
    before = F.concat(F.array(F.lit(-1)), F.slice(kept["i"], F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
    labels = F.when(F.size(kept) > 0, F.zip_with(kept["i"], before, lambda i, j: i - j - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(ids.isNotNull(), F.struct(kept["x"].alias("ids"), labels.alias("labels")))


#: Where a span that its text has no room for would begin: behind every token.
_NOWHERE = 2**31 - 1


def _spans(ids: Column, key: Column, seed: int, upto: list[float], share: int) -> tuple[int, Column]:
    """(stretch, spans): one span in each stretch of tokens, as an array of struct(first, stop, kind) by stretch number.

    upto: cumulative probabilities of the lengths 0, 1, 2 ...; stretches are as long as gives `share` percent of all tokens.
    A span keeps clear of its stretch's first and last token, so spans never touch and both their neighbours are seen.
    Spans are drawn once for a stretch; tokens look theirs up, so bind the array before reading it inside a lambda.
    """
    mean = sum(1 - u for u in upto)
    stretch = max(len(upto) + 3, round(mean * 100 / share))
    u = lambda b, salt: F.pmod(F.xxhash64(F.lit(seed), key, b, F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    steps = F.array(*[F.lit(float(x)) for x in upto])

    def placed(b: Column, length: Column) -> Column:
        first = (b * stretch + 1 + F.floor(u(b, 13) * (stretch - 1 - length))).cast("int")
        return F.struct(first.alias("first"), (first + length).alias("stop"), F.pmod(F.xxhash64(F.lit(seed), key, b, F.lit(17)), F.lit(10)).alias("kind"))

    drawn = F.transform(F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / stretch).cast("int")), lambda b: bound(bound(u(b, 11), lambda x: F.size(F.filter(steps, lambda c: c <= x))), lambda n: placed(b, n)))
    whole = bound(F.size(ids), lambda n: F.transform(drawn, lambda s: F.when(s["stop"] < n, s).otherwise(F.struct(F.lit(_NOWHERE).alias("first"), F.lit(_NOWHERE).alias("stop"), s["kind"].alias("kind")))))
    return stretch, whole


def span_boundaries(ids: Column, key: Column, seed: int, vocabulary: int, share: int = 15, geometric: float = 0.2, most: int = 10) -> Column:
    """struct(ids, labels, left, right, offset): spans of geometric length hidden, with what is seen on both sides of each.

    Of the spans 80 % are masked, 10 % replaced, 10 % left. left and right are the places of the tokens just outside a span,
    offset the place in it from 1, all -1 elsewhere; labels are -100 elsewhere. A hash of (seed, key, stretch) decides.
    """
    upto = [0.0] + [1 - (1 - geometric) ** k for k in range(1, most)]
    stretch, spans = _spans(ids, key, seed, upto, share)
    other = lambda i: (F.pmod(F.xxhash64(F.lit(seed), key, i, F.lit(19)), F.lit(vocabulary)) + CONTENT).cast("int")
    names = ("ids", "labels", "left", "right", "offset")
    as_struct = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])

    def corrupt(t: Column) -> Column:
        x, i, s = t["x"], t["i"], t["s"]
        hidden = F.when(s["kind"] < 8, SPECIAL["mask"]).when(s["kind"] == 9, x).otherwise(other(i))
        inside = as_struct(hidden, x, s["first"] - 1, s["stop"], i - s["first"] + 1)
        return F.when((i >= s["first"]) & (i < s["stop"]), inside).otherwise(as_struct(x, F.lit(-100), F.lit(-1), F.lit(-1), F.lit(-1)))

    # a token meets its span once, and the five fields are read from what that gives
    met = bound(spans, lambda found: F.transform(ids, lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.get(found, F.floor(i / stretch).cast("int")).alias("s"))))
    return bound(F.transform(met, corrupt), lambda e: as_struct(*[e[n] for n in names]))


def infilled_spans(ids: Column, key: Column, seed: int, share: int = 30, rate: float = 3.0, most: int = 10) -> Column:
    """struct(ids, labels): spans of Poisson length, each become one mask; one of length 0 puts a mask where nothing was.

    The label of such a mask is the length of its span, that of other tokens -100. A hash of (seed, key, stretch) decides.
    """
    chance, upto, total = math.exp(-rate), [], 0.0
    for k in range(most):
        total += chance
        upto.append(total)
        chance *= rate / (k + 1)
    stretch, spans = _spans(ids, key, seed, upto, share)
    none = F.array().cast("array<int>")

    def pieces(kept, mark) -> Column:
        """kept(x) for a token outside of spans, mark(length) where one begins."""

        def one(found: Column):
            at = lambda i: F.get(found, F.floor(i / stretch).cast("int"))
            begin = lambda x, s: F.when(s["stop"] > s["first"], F.array(mark(s))).otherwise(F.array(mark(s), kept(x)))
            return lambda x, i: F.when(i == at(i)["first"], begin(x, at(i))).when((i > at(i)["first"]) & (i < at(i)["stop"]), none).otherwise(F.array(kept(x)))

        return F.flatten(bound(spans, lambda found: F.transform(ids, one(found))))

    return F.struct(pieces(lambda x: x, lambda s: F.lit(SPECIAL["mask"])).alias("ids"), pieces(lambda x: F.lit(-100), lambda s: s["stop"] - s["first"]).alias("labels"))


def token_accuracy(predicted: Column, target: Column, mask: Column) -> Column:
    """Share of equal tokens among those the mask (0/1) counts."""
    hits = F.zip_with(F.zip_with(predicted, target, lambda a, b: (a == b).cast("double")), mask, lambda e, m: e * m)
    count = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m)
    return F.aggregate(hits, F.lit(0.0), lambda a, x: a + x) / F.greatest(count, F.lit(1.0))


def exact_match(predicted: Column, target: Column, mask: Column) -> Column:
    wrong = F.zip_with(F.zip_with(predicted, target, lambda a, b: a != b), mask, lambda w, m: w & (m > 0))
    return ~F.exists(wrong, lambda w: w)


#: Kinds of decisions in the order of their numbers.
DECISIONS = ["binary", "choice", "score"]


def decision_kind(value: Column) -> Column:
    """The kind's name from its name in any case or its number as text; null if it is none."""
    by_number = F.get(F.array(*map(F.lit, DECISIONS)), F.when(F.rlike(value, F.lit("^[0-9]$")), value).cast("int"))
    return F.coalesce(by_number, F.when(F.lower(value).isin(DECISIONS), F.lower(value)))


def decision_options(kind: Column, options: Column, levels: Column) -> Column:
    """Option texts in the order of their answers: false and true, those given, or the levels from 0."""
    ladder = F.transform(F.sequence(F.lit(0), F.greatest(levels, F.lit(1)).cast("int") - 1), lambda i: i.cast("string"))
    ladder = F.when(levels > 0, ladder).otherwise(F.array().cast("array<string>"))
    return F.when(kind == "binary", F.array(F.lit("false"), F.lit("true"))).when(kind == "score", ladder).otherwise(options)


def typed_decision(kind: Column, instruction: Column, options: Column, state: Column, encode: Callable[[Column], Column], length: int | None = None) -> Column:
    """struct(ids, marker_pos, marker_end) of a decision whose kind stands before the instruction, closed by a [SEP].

    instruction and state are texts, options an array of texts; encode turns a text into ids. The state is cut so that all
    but it and the last mark fit `length`; it is whole without one.
    """
    head = encode(F.concat_ws(" ", kind, instruction))
    d = decision_sequence(head, F.transform(options, encode), encode(state), (2**30 if length is None else length) - 1)
    return F.struct(F.concat(d["ids"], _id("sep")).alias("ids"), d["marker_pos"].alias("marker_pos"), d["marker_end"].alias("marker_end"))


def sha_ids(words: Column, vocabulary: int) -> Column:
    """Content ids from the first 32 bits of each word's SHA-256: the same in every engine."""
    return F.transform(words, lambda t: (F.conv(F.substring(F.sha2(t.cast("binary"), 256), 1, 8), 16, 10).cast("long") % vocabulary + CONTENT).cast("int"))
