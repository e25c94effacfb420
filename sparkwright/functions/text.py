"""Strings and tokens."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words with inner apostrophes or hyphens, and single marks. Letters and digits of every script.
TOKEN = r"[\p{L}\p{N}_]+(?:['’-][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_offsets(text: Column) -> Column:
    """array<struct<token, start, end>> in characters, from the lengths of the stretches between tokens."""
    found = tokens(text)
    gaps = F.slice(F.split(text, TOKEN, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(gaps, found, lambda g, t: F.struct(F.char_length(g).alias("g"), t.alias("t")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<token:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + F.char_length(x["t"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(x["t"].alias("token"), begin.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def sentences(text: Column) -> Column:
    """Parts that end in . ! or ? and white space; trimmed, without empty ones."""
    parts = F.split(F.trim(text), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def slug(text: Column, default: str = "item") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("string").cast("binary"), 256)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data):
        self.parts.append(data)


def _strip(value: str) -> str:
    """References resolved and tags removed, again and again until nothing changes."""
    while True:
        parser = _Text()
        parser.feed(html.unescape(value).replace("&", "&amp;"))  # what is still an ampersand now is one
        parser.close()
        plain = "".join(parser.parts)
        if plain == value:
            return plain
        value = plain


@F.pandas_udf(StringType())
def strip_tags(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _strip(t))


def key_values(text: Column) -> Column:
    """Lines `name: meaning` as a map; later lines win, lines without a colon, a name or a meaning are left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    last = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, p: F.concat(F.filter(acc, lambda q: q["k"] != p["k"]), F.array(p)))
    return F.map_from_entries(last)
