"""Spelling variants: words one edit apart by an index of variable-length grams, and the common form of each rare one."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, small, text_of

LETTERS = "a-zÀ-ÿ"  # after lower-casing A-Z
SHORTEST, LONGEST = 3, 6  # lengths of grams
FREQUENT = 3  # a gram that more often stands in the sample is told apart by its next letter too
SAMPLE = 50_000  # words that the gram dictionary is made from
HEAVY = 2048  # words in a gram's list from which on it is not compared pair by pair
DAMAGE = 31
DELETIONS = 64  # letters up to which words of heavy lists meet by their deletions
WIDE = 48  # letters up to which pairs are verified in blocks; longer ones by themselves
HELD = 200_000  # words counted by a task before it hands them on


def _counted(least: int):
    """(id, text) to word, n: runs of at least `least` letters, one letter taken out where the hash of id and run says so."""
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def count(batches):
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for id_, text in zip(batch.column("id").to_pylist(), texts, strict=True):
                begin = zlib.crc32(f"{id_}:".encode())
                for run, n in Counter(runs.findall(text.lower().decode())).items():  # bytes.lower() touches A-Z only
                    h = zlib.crc32(run.encode(), begin)
                    if h % DAMAGE == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    held[run] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return count


def word_counts(docs: DataFrame, least_letters: int = 7, least_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: each distinct word of so many letters with the number of times it stands in all texts, if that is enough."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).alias("text"))
    counts = rows.mapInArrow(_counted(least_letters), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def padding(least_letters: int, longest: int = LONGEST) -> int:
    """Marks to put on either end so that the shortest word with them has over twice the longest gram.

    Then one edit cannot reach all grams of a word: behind position `longest` the first gram stays, before it the last one.
    """
    return max(0, -(-(2 * longest + 1 - least_letters) // 2))


class GramDictionary:
    """Grams of variable length. Every prefix of a gram, from the shortest length on, is a gram too.

    A gram belongs to it if its prefix is frequent in the sample (more than `frequent` places), so that frequent grams are
    told apart by the letters behind them and rare ones stay short. Which words the sample has decides only how long the
    lists of the index are: decomposition and bounds hold for any word.
    """

    def __init__(self, sample: list[str], pad: int, shortest: int = SHORTEST, longest: int = LONGEST, frequent: int = FREQUENT):
        self.pad, self.shortest, self.longest = pad, shortest, longest
        padded = [self.padded(w) for w in sample]
        self.count: dict[str, int] = {}
        for size in range(shortest, longest + 1):  # level by level, as only frequent prefixes are looked into
            level: Counter = Counter()
            for w in padded:
                level.update(w[p : p + size] for p in range(len(w) - size + 1) if size == shortest or self.count.get(w[p : p + size - 1], 0) > frequent)
            self.count |= level
        self.depth: dict[str, int] = {"": longest}  # the longest gram that begins so
        for g in sorted(self.count, key=len):
            for k in range(1, len(g) + 1):
                self.depth[g[:k]] = max(self.depth.get(g[:k], 0), len(g))

    def padded(self, word: str) -> str:
        return "^" * self.pad + word + "$" * self.pad

    def ends(self, s: str) -> tuple[list[int], list[bool]]:
        """For each position where a gram may begin: the end of the longest one there, and whether the letter behind might prolong it."""
        ends, opens, count, n = [], [], self.count, len(s)
        for p in range(n - self.shortest + 1):
            e = p + self.shortest
            if s[p:e] in count:
                while e < n and s[p : e + 1] in count:
                    e += 1
                opens.append(self.depth[s[p:e]] > e - p)
            else:
                opens.append(False)
            ends.append(e)
        return ends, opens

    def decompose(self, s: str) -> list[tuple[int, str]]:
        """(position, gram) of a padded word: the longest gram at each position, but for those inside an earlier one."""
        out, far = [], 0
        for p, e in enumerate(self.ends(s)[0]):
            if e > far:
                out.append((p, s[p:e]))
                far = e
        return out

    def affected(self, s: str) -> int:
        """At most so many of the word's grams are lost or moved, against the end on their side, by any one edit.

        An edit touches a gram if it falls inside it, or right behind it where the letter there might prolong it. A touched
        position may also begin a longer gram than before, which swallows grams up to where it reaches.
        """
        return self._affected(s, *self.ends(s))

    def _affected(self, s: str, ends: list[int], opens: list[bool]) -> int:
        own, far = [], 0
        for p, e in enumerate(ends):
            if e > far:
                own.append(p)
                far = e
        worst, n, depth, least, longest, first = 0, len(s), self.depth.get, self.shortest, self.longest, 0
        for i in range(self.pad, n - self.pad + 1):
            low = max(0, i - longest)
            while first < len(own) and own[first] < low:
                first += 1
            base = 0  # where a gram that begins before i and is touched may reach, if the text kept its length
            for p in range(low, min(i, len(ends))):
                e = ends[p]
                if e > i or e == i and opens[p]:
                    d = depth(s[p:i], 0)
                    base = max(base, p + (d if d > least else least))
            changed, put = max(base + 1, i + longest), max(base - 1, i + longest - 1)  # the letter at i goes or changes; one comes in before it
            change = insert = 0
            for k in range(first, len(own)):
                p = own[k]
                e = ends[p]
                if p < i:
                    if e > i or e == i and opens[p]:
                        change += 1
                        insert += 1
                    continue
                if p > i + 2 * longest:  # no edit at i reaches further
                    break
                change += p == i or e <= changed
                insert += e <= put
            worst = max(worst, insert, change if i < n - self.pad else 0)
        return worst

    def signature(self, word: str) -> list[tuple[int, int, str]]:
        """(first place from the start, last place from the end, gram) of the rarest grams of a word, one more than an edit may affect.

        Two words one edit apart share at least as many grams, at the same place from one end, as either bound leaves. The rarest
        of the shared ones has all others behind it in the order of rarity, so it is among these of both words. Where a word has a
        gram several times, one place from each end will do: left of an edit nothing changes, so if any place of the gram is
        shared there the first one is; and right of it, behind a shared gram, nothing changes either, so the last one is.
        """
        s = self.padded(word)
        ends, opens = self.ends(s)
        grams, far = [], 0
        for p, e in enumerate(ends):
            if e > far:
                grams.append((self.count.get(s[p:e], 0), s[p:e], p))
                far = e
        grams.sort()
        keep = min(len(grams), self._affected(s, ends, opens) + 1)
        while keep < len(grams) and grams[keep][1] == grams[keep - 1][1]:
            keep += 1
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for _, g, p in grams[:keep]:  # in rising order of place within a gram
            first.setdefault(g, p)
            last[g] = len(s) - p
        return [(first[g], last[g], g) for g in first]


def sketch(word: str) -> int:
    """The length (255 at most) in the upper 8 bits, and which letters occur in the other 56: one edit changes the length by at most 1 and two letters."""
    bits = 0
    for c in set(word):
        bits |= 1 << ord(c) % 56
    size = min(len(word), 255)
    return bits | (size if size < 128 else size - 256) << 56


def gram_lists(words: DataFrame, dictionary: GramDictionary) -> DataFrame:
    """key, word, sketch: the inverted lists. A gram's place is told from the start and from the end, a list for each."""

    def index(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            for at in range(0, len(words), 1000):
                keys, rows = [], []
                for i, w in enumerate(words[at : at + 1000]):
                    for left, right, g in dictionary.signature(w):
                        keys += [f"{left}<{g}", f"{right}>{g}"]
                        rows += [i, i]
                part = batch.column("word").slice(at, 1000)
                seen = pa.array([sketch(w) for w in words[at : at + 1000]], pa.int64())
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), part.take(rows), seen.take(rows)], names=["gram", "word", "sketch"])

    # a list is known by 64 bits of hash: lists that meet by chance only mean words compared in vain
    return words.select("word").mapInArrow(index, "gram string, word string, sketch bigint").select(F.xxhash64("gram").alias("key"), "word", "sketch")


def _merged(batches):
    """Rows sorted by key to the pairs of words of a list whose sketches allow for one edit.

    Compares all rows of a batch with those at one distance behind them at a time, so that short lists cost no call of
    their own. A list that goes on in the next batch is carried along; lists have at most HEAVY words here.
    """
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        table = table.combine_chunks()
        keys = table.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
        held = table.slice(cut)
        yield _compared(table.slice(0, cut))
    if held is not None:
        yield _compared(held)


def _edit_apart(a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """Which pairs of rows are one edit apart, from their letters in order and in reverse; pairs with a longer word all pass."""
    same, out = size[a] == size[b], np.zeros(len(a), bool)
    out[same] = (start[a[same]] != start[b[same]]).sum(axis=1) == 1
    x, y = a[~same], b[~same]
    alike = (start[x] != start[y]).argmax(axis=1) + (end[x] != end[y]).argmax(axis=1)
    out[~same] = alike >= np.minimum(size[x], size[y])
    return out | ~(fits[a] & fits[b])


def _compared(rows: pa.Table) -> pa.RecordBatch:
    keys, sketches = rows.column("key").to_numpy(), rows.column("sketch").to_numpy()
    size, letters = sketches.view(np.uint64) >> np.uint64(56), sketches.view(np.uint64) & np.uint64(2**56 - 1)
    size, alive, found = size.astype(np.int16), np.arange(len(keys)), [np.zeros((2, 0), np.int64)]
    for lag in range(1, len(keys)):
        alive = alive[alive < len(keys) - lag]
        alive = alive[keys[alive] == keys[alive + lag]]
        if not len(alive):
            break
        a, b = alive, alive + lag
        near = (np.bitwise_count(letters[a] ^ letters[b]) <= 2) & (np.abs(size[a] - size[b]) <= 1)
        found.append(np.stack([a[near], b[near]]))
    a, b = np.concatenate(found, axis=1)
    own = rows.column("word").to_pylist()
    width = min(WIDE, max(map(len, own), default=1))
    fits = np.array([len(w) <= width for w in own], bool)
    bytes_ = [w.encode("latin-1") for w in own]  # every letter of the runs is one byte there
    start, end = (np.array(x, f"S{width}").view(np.uint8).reshape(len(own), width) for x in (bytes_, [w[::-1] for w in bytes_]))
    keep = [np.zeros(0, bool)]
    for at in range(0, len(a), 500_000):
        keep.append(_edit_apart(a[at : at + 500_000], b[at : at + 500_000], start, end, size, fits))
    keep = np.concatenate(keep)
    a, b = a[keep], b[keep]
    words = rows.column("word").combine_chunks()
    return pa.RecordBatch.from_arrays([words.take(pa.array(x)) for x in (a, b)], names=["a", "b"])


def _one_edit(a: str, b: str):
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def _by_deletions(words: DataFrame) -> DataFrame:
    """a, b (a < b): all pairs of these words that are one edit apart, in time linear in their letters.

    Words one replacement apart agree once the letter at that place is taken out of both; words one insertion apart agree
    once it is taken out of the longer one. Each deletion is a string of its own, so that is for words of at most DELETIONS letters.
    """
    n = F.char_length("word")
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, n)))
    cuts = words.select("word", F.posexplode(cut).alias("at", "rest"))
    same = cuts.withColumnRenamed("word", "a").join(cuts.withColumnRenamed("word", "b"), ["at", "rest"]).filter("a < b").select("a", "b")
    longer = cuts.join(words.select(F.col("word").alias("rest")), "rest").select(F.least("word", "rest").alias("a"), F.greatest("word", "rest").alias("b"))
    return same.union(longer).filter(_one_edit("a", "b"))


def near_words(words: DataFrame, least_letters: int = 7, sample: int = SAMPLE, heavy: int = HEAVY, **grams: int) -> DataFrame:
    """a, b (a < b): every pair of the distinct words (column word, all of at least least_letters) that are one edit apart.

    The lists of the words' rarest grams are merged by a join, and each pair that meets is verified. A list of over `heavy`
    words is not compared pair by pair: its words meet by their single deletions instead, which is as exact and linear (but for words of 64 letters and more).
    """
    some = [r[0] for r in words.select("word").orderBy(F.xxhash64("word"), "word").limit(sample).collect()]
    if not some:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b"))
    dictionary = GramDictionary(some, padding(least_letters, grams.get("longest", LONGEST)), **grams)
    lists = materialise(gram_lists(words, dictionary), "spelling-lists")
    large = materialise(lists.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > heavy).select("key"), "spelling-heavy")
    rest, any_large = lists, not large.isEmpty()
    if any_large:
        rest = lists.join(small(large), "key", "left_anti")
    sorted_ = rest.repartition("key").sortWithinPartitions("key")
    pairs = sorted_.mapInArrow(_merged, "a string, b string").filter(_one_edit("a", "b"))
    if any_large:
        many = materialise(lists.join(small(large), "key"), "spelling-many")
        pairs = pairs.union(_by_deletions(many.filter(F.char_length("word") <= DELETIONS).select("word").distinct()))
        # a pair with a word of more letters has two words of at least DELETIONS
        long = many.filter(F.char_length("word") >= DELETIONS).select("key", "word")
        meet = long.toDF("key", "a").join(long.toDF("key", "b"), "key").filter((F.col("a") < F.col("b")) & _one_edit("a", "b"))
        pairs = pairs.union(meet.select("a", "b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def spelling_groups(docs: DataFrame, least_letters: int = 7, least_count: int = 2, ratio: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    Words are the runs of Latin letters of at least least_letters letters that stand at least least_count times in all texts, some
    with a letter taken out (see the contract of the query). A word's form is the commonest word one edit away (of equals the
    first by code points), if that is at least `ratio` times as common; its root is the last form of the chain. Chains
    are short, since each step multiplies the count, and are followed by doubling.

    Null texts have no words, a null id counts as empty, rows that repeat an id or a text count each. Texts of any length are
    read whole. Columns other than id and text are not read, so their names can't clash. An empty table gives an empty result.
    """
    words = materialise(word_counts(docs, least_letters, least_count, id_col, text_col), "spelling-words")
    pairs = materialise(near_words(words, least_letters), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select("b", "a"))
    known = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    # of the largest n the first word: counts rise and code points fall, which one minimum of (-n, word) settles
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    common = -F.col("best.less") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"))
    rows = materialise(rows, "spelling-forms")
    ways = materialise(rows.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "spelling-ways")
        ways = moved.select("word", "root")
        if moved.filter("went").isEmpty():
            break
    out = rows.join(ways, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
