"""Packing token sequences: first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, materialise, text_of

END = 2
KNOWN_WORDS = 200_000  # remembered by a task, the rarer half then forgotten; bounds memory, not results
KNOWN_BYTES = 8_000_000  # the same for the bytes of these words and of their ids
SLICE = 1_000_000  # bytes tokenised at a time in a task; bounds memory, not results


def _byte_letters() -> dict[int, str]:
    """Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokens:
    """Ids of texts for a tokenizer that drops white space: each distinct stretch without ASCII white space is encoded once.

    No pattern of such a tokenizer reaches across white space, so the ids of a text are those of its stretches. If the
    tokenizer ignores case and splits letters from marks (tried on probes when it is loaded), case is folded and marks behind
    a word are split off before (not in texts with a dotted capital I), and plain words go to its vocabulary model directly, which leaves far fewer and cheaper stretches.
    """

    SPLIT = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"  # no apostrophe, which begins endings of words, and nothing of a special token's brackets
    MARKS = rf"(\pL|\pN)([{re.escape(SPLIT)}]+)(\s|$)"
    SPECIAL = "<|"  # texts with special tokens keep their case
    DOTTED = "\u0130"  # the one letter that lower-casing turns into a letter and a combining dot, which takes a mark behind it along

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), _byte_letters()
        self._remember(pa.array([], pa.large_string()), *(np.empty(0, t) for t in (np.int64, np.uint32, np.int64)))
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        probes = ["the", "straße", "éàñ", "日本語", "thing"]
        self.uncased = all(self._word(w) == ids(w) == ids(w.upper() if w != "straße" else w) == ids(w + ",")[: len(ids(w))] for w in probes) and all(ids(f"the{m}") == ids(f"the {m}") for m in [*self.SPLIT, self.SPLIT])

    def _word(self, word: str) -> list[int]:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _remember(self, words: pa.Array, lens: np.ndarray, ids: np.ndarray, seen: np.ndarray) -> None:
        """Flat arrays of what is known, as an object for each word takes many times the memory: words, number of ids, ids, times seen."""
        self.words, self.lens, self.ids, self.seen = words, lens, ids, seen

    def _ids_at(self, places: np.ndarray) -> np.ndarray:
        n, starts = self.lens[places], np.cumsum(self.lens) - self.lens
        return self.ids[np.repeat(starts[places] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def _forget(self) -> None:
        """Of the known words the half seen most often stays, or none if even that is too much."""
        kept = np.sort(np.argsort(-self.seen, kind="stable")[: KNOWN_WORDS // 2])
        words = self.words.take(pa.array(kept))
        if words.nbytes > KNOWN_BYTES // 2:
            words, kept = words[:0], kept[:0]
        self._remember(words, self.lens[kept], self._ids_at(kept), self.seen[kept] // 2)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Places of these words, all new, among the known ones."""
        ids, ends, rest, letters, model = array("I"), [0], [], self.letters, self.tokenizer.model.tokenize
        for i, w in enumerate(words.to_pylist()):
            if not (self.uncased and w.isalpha() and w == w.lower()):
                rest.append((i, w))
                continue
            if not w.isascii():
                if not unicodedata.is_normalized("NFC", w):
                    rest.append((i, w))
                    continue
                w = w.encode().decode("latin-1").translate(letters)
            ids.extend([t.id for t in model(w)])
            ends.append(len(ids))
        for e in self.tokenizer.encode_batch([w for _, w in rest], add_special_tokens=False):
            ids.extend(e.ids)
            ends.append(len(ids))
        behind = np.zeros(len(words), bool)  # these were encoded last
        behind[[i for i, _ in rest]] = True
        order = np.argsort(behind, kind="stable")
        places = np.empty(len(words), np.int64)
        places[order] = len(self.words) + np.arange(len(words))
        self._remember(pa.concat_arrays([self.words, words.take(pa.array(order))]), np.r_[self.lens, np.diff(ends)], np.r_[self.ids, np.array(ids, np.uint32)], np.r_[self.seen, np.zeros_like(order)])
        return places

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts))))  # whole: string functions err on slices
        if self.uncased:
            texts = pc.if_else(pc.match_substring(texts, self.SPECIAL), texts, pc.ascii_lower(texts))
            texts = pc.if_else(pc.match_substring(texts, self.DOTTED), texts, pc.replace_substring_regex(texts, self.MARKS, r"\1 \2\3"))
        lists = pc.ascii_split_whitespace(texts)
        stretch = lists.flatten().dictionary_encode()
        vocabulary, index = stretch.dictionary, stretch.indices.to_numpy(zero_copy_only=False)
        place = pc.index_in(vocabulary, self.words)
        new = vocabulary.filter(place.is_null())
        if len(self.words) and (len(self.words) + len(new) > KNOWN_WORDS or self.words.nbytes + self.ids.nbytes + new.nbytes > KNOWN_BYTES):
            self._forget()
            place = pc.index_in(vocabulary, self.words)
            new = vocabulary.filter(place.is_null())
        at, unknown = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), place.is_null().to_numpy(zero_copy_only=False)
        at[unknown] = self._learn(new)
        self.seen[at] += np.bincount(index, minlength=len(at))
        places = at[index]
        ids, upto = self._ids_at(places), np.r_[0, np.cumsum(self.lens[places])]
        ends = upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of at most `capacity` ids of each document (its ids, then the end id): id, start, length, ids_crc32, doc_tokens, and ids unless with_ids is false."""

    def cut(batches):
        encode = WordTokens(tokenizer_path)
        for batch in batches:
            at, sizes = 0, np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")))
                rows = batch.slice(at, to - at)
                out = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for i, ids in enumerate(encode(rows.column("text"))):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    for s in range(0, len(ids), capacity):
                        piece = ids[s : s + capacity]
                        for k, v in zip(out, (i, s, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece), strict=True):
                            out[k].append(v)
                row, ids = pa.array(out.pop("row"), pa.int64()), out.pop("ids")
                columns = {"id": rows.column("id").take(row), **{k: pa.array(v, pa.int64()) for k, v in out.items()}}
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)
                at = to
        del encode
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids)


class Tournament:
    """A tournament tree over the free room of bins: the winner of a match is the larger room, so the first bin with
    enough room is found by one walk from the root."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.width)

    def place(self, length: int) -> tuple[int, int]:
        """Put a piece into the first bin that holds it: (bin, offset in it is capacity less the room before)."""
        room, i = self.room, 1
        while i < self.width:
            i *= 2
            i += room[i] < length
        bin_, before = i - self.width, room[i]
        room[i] -= length
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return bin_, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths are at most capacity."""
    tree = Tournament(len(lengths), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        bins[i], before = tree.place(int(lengths[i]))
        offsets[i] = capacity - before
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = 4096, group_docs: int = 1024, seed: int = 7) -> DataFrame:
    """Add sequence_id, offset and sequence_length to pieces (id, start, length, ...).

    Pieces go to groups of about group_docs by a hash of document, position and a row number, which mixes the lengths alike in
    every group whatever the order or source of the documents, and spreads repeated and null ids over all groups. In a group, the longest piece comes first and goes to the
    first sequence with room. A sequence is padded to the capacity unless its length is a power of two.
    """
    schema = pieces.schema
    pieces = materialise(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")  # the number is stored with its row
    groups = max(1, -(-pieces.count() // group_docs))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_row"], ascending=[False, True], kind="stable", ignore_index=True).drop(columns="_row")
        bins, offsets = first_fit_decreasing(pdf.length.to_numpy(), capacity)
        used = np.bincount(bins, pdf.length.to_numpy()).astype(np.int64)
        padded = np.where(used & (used - 1), capacity, used)
        return pdf.assign(sequence_id=pdf.pop("grp") * 2**32 + bins, offset=offsets, sequence_length=padded[bins])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("start"), F.col("_row")), F.lit(groups)))
    return grouped.groupBy("grp").applyInPandas(pack, f"{fields}, sequence_id bigint, offset bigint, sequence_length bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, group_docs: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length.

    A document longer than a sequence is cut at multiples of the capacity; no other is cut. Null text counts as empty: the
    end id alone. Rows that repeat an id, null included, are separate documents, and texts of any length are read whole. Other columns
    are not read. An empty table gives an empty result. Only lengths,
    never ids, are shuffled; token_pieces() gives the ids for writing sequences (sequences()).
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, id_col, text_col, with_ids=False)
    return pack_pieces(pieces, capacity, group_docs).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids; at most `capacity` ids in a group."""
    ids = packed.join(pieces.select("id", "start", "ids"), ["id", "start"])
    by = ids.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return by.select("sequence_id", F.flatten("parts.ids").alias("ids"))
