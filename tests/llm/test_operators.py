"""Operators against plain versions on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwright.llm import gif_media as G
from sparkwright.llm import simhash as S
from sparkwright.llm.content_dedup import exact_dedup
from sparkwright.llm.html_text import extract_text, main_text, stretches
from sparkwright.llm.line_dedup import dedup_lines, line_classes
from sparkwright.llm.mixing import mix_sources
from sparkwright.llm.packing import WordTokens, first_fit_decreasing, pack_documents, sequences, token_pieces
from sparkwright.llm.pii import base_spans, digests, find_personal_data, sanitised
from sparkwright.llm.sharding import balanced_shards
from sparkwright.llm.toxicity import score_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, t string, fp string"


def table(spark, texts, sources=None):
    """documents with some columns whose names clash with the operators' own."""
    rows = [(i, t, None, (sources or ["a", "b", None])[i % 3] if not sources else sources[i], 0, -1, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


BASE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of great power in the old tower by the sea "
ODD = ["", None, " \t\n", "A", "a", "Hello World", "hello world", "HELLO world", "É", "é", BASE * 3, (BASE * 3).upper(), BASE * 400, "x" * 50_000, "line one\nline two\nline one", "line one\nline 2"] + [BASE + str(i % 3) for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").encode().lower().decode()


def test_exact_dedup(spark, docs, empty):
    got = {r["doc_id"]: r for r in exact_dedup(docs).collect()}
    groups = {}
    for i, t in enumerate(ODD):
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(ODD)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup(empty).count() == 0
    same = spark.createDataFrame([(None, "q"), (5, "q"), (5, "Q")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"]) for r in exact_dedup(same).collect()) == [(0, 5, 3), (5, 5, 3), (5, 5, 3)]


def test_exact_dedup_hot_group_over_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'Hot text', concat('t', id)) as text").repartition(7)
        got = exact_dedup(many).filter("text_sha256 = sha2('hot text', 256)").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 1000 and {(r["keep_id"], r["group_size"]) for r in got} == {(2997, 1000)} and sum(r["kept"] for r in got) == 1


def test_exact_dedup_case_variants_of_other_letters_over_many_tasks(spark):
    """Texts that differ only in the case of letters beyond A-Z are different, however the sort cuts them."""
    kinds = ["\u00c9cole one", "\u00e9cole one", "\u00c9COLE One", "\u00e9COLE ONE", "\u0130x", "i\u0307x", "\u0130X"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5600).select("id", F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % 7 + 1).cast("int")).alias("text")).withColumnRenamed("id", "doc_id").repartition(5)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        got = exact_dedup(rows).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = {}
    for i in range(5600):
        groups.setdefault(lower(kinds[i % 7]), []).append(i)
    assert len(groups) == 4 and len(got) == 5600
    for r in got:
        ids = groups[lower(kinds[r["doc_id"] % 7])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), r["doc_id"] == max(ids))


def test_mixing_of_null_and_repeated_ids(spark):
    """A third of the rows without id, and a group of equal rows, still let every source come near its target."""
    rows = [(None if i % 3 == 0 else i % 50, "same words here" if i % 5 == 0 else f"w{i} " * (1 + i % 7), "abc"[i % 3] if i % 4 else None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    sums = {}
    for r in got:
        s = sums.setdefault(r["source"], [r["target"], 0])
        s[1] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    for target, taken in sums.values():
        assert abs(taken - target) <= 7
    key = lambda r: tuple(str(r[c]) for c in ("doc_id", "source", "digest", "occurrence", "copies"))
    assert sorted(map(key, got)) == sorted(map(key, mix_sources(docs.repartition(7)).collect()))
    again = [r["occurrence"] for r in got if r["doc_id"] is None and r["source"] == "a" and r["size"] == 3]
    assert len(again) > 100 and max(again) > 50


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_mixing(spark, docs, empty):
    rows = mix_sources(docs).collect()
    size = {i: words(t) for i, t in enumerate(ODD)}
    source = {i: ["a", "b", None][i % 3] for i in size}
    per = {s: sum(n for i, n in size.items() if source[i] == s) for s in ("a", "b", None)}
    weight, total = {"a": 5, "b": 2, None: 1}, 1.5 * sum(per.values())
    target, left, free = {}, total, set(per)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * per[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * per[s]
            left -= target[s]
        free -= over
    taken = {}
    for r in rows:
        i = r["doc_id"]
        assert r["size"] == size[i] and r["source_size"] == per[source[i]] and abs(r["target"] - target[source[i]]) < 1e-6
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"]
        taken[source[i]] = taken.get(source[i], 0) + r["taken"]
    for s in per:
        assert abs(taken[s] - target[s]) <= max(n for i, n in size.items() if source[i] == s) / 2 + 1e-6
    assert len(rows) == len(ODD) and rows == mix_sources(docs).collect()
    assert mix_sources(empty).count() == 0
    assert mix_sources(table(spark, ["", None])).agg({"taken": "sum"}).first()[0] == 0


def test_sharding(spark, docs, empty):
    rows = balanced_shards(docs, shards=4).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(ODD)))
    for r in rows:
        raw = (ODD[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert balanced_shards(empty).count() == 0
    many = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('hot ', 10), concat('text ', id div 2, repeat('x', cast(id % 37 as int)))) as text")
    got = balanced_shards(many, shards=8).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() - load.min() <= 2 * got["size"].max()
    cut = got.groupby("group")["shard"].nunique()
    assert (cut > 1).sum() <= 5


def test_packing(spark, docs, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = pack_documents(docs, path, capacity=512, group_docs=16).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(ODD)}
    used = {}
    for i, whole in ids.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            piece = whole[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(whole) and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
            at += r["length"]
            used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert at == len(whole)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    pieces = token_pieces(docs, path, 512)
    packed = pack_documents(docs, path, 512, 16).withColumnRenamed("doc_id", "id")
    assert sum(len(r["ids"]) for r in sequences(packed, pieces).collect()) == sum(map(len, ids.values()))
    assert pack_documents(empty, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbéÉ Σσß'.,!?\"5½ \t\n<|>endoftextﷺ́İIi̇ıßẞ\u00a0\u0085\u1680\x1c", max_size=30), max_size=4))
def test_word_tokens_equal_the_tokenizers(texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encode = test_word_tokens_equal_the_tokenizers.__dict__.setdefault("encode", WordTokens(public_tokenizers.path("word_bpe_49k.json")))
    want = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encode(pa.array(texts, pa.string()))] == want
    assert [x.tolist() for x in encode(pa.array(["some text before", *texts, "and behind"], pa.string()).slice(1, len(texts)))] == want


@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_first_fit_decreasing_equals_the_plain_search(lengths):
    bins, offsets = first_fit_decreasing(np.array(lengths), 64)
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((k for k, r in enumerate(room) if r >= lengths[i]), None)
        if b is None:
            b = len(room)
            room.append(64)
        want[i] = (b, 64 - room[b])
        room[b] -= lengths[i]
    assert [(int(b), int(o)) for b, o in zip(bins, offsets, strict=True)] == [want[i] for i in range(len(lengths))]


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([2, 4, 8]))
def test_lzw_round_trip(data, size):
    data = bytes(b % (1 << size) for b in data)
    assert G.lzw_decode(G.lzw_encode(data, size), size, len(data)) == data


def test_gif_long_payloads_and_features(spark, docs, empty):
    rng = np.random.default_rng(1)
    for payload in (bytes(192), rng.integers(0, 256, 192 * 700, dtype=np.uint8).tobytes(), b"ab" * 96 * 300):
        assert b"".join(f.pixels[..., 0].tobytes() for f in G.read_gif(G.write_gif(payload), canvas=False)) == payload
    from sparkwright.llm.gif_media import frame_table, text_media

    media = text_media(docs)
    for r in media.collect():
        raw = (ODD[r["doc_id"]] or "").encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and sum(map(int, r["feature"].split(":")[2].split(","))) == len(padded)
    frames = frame_table(media)
    assert frames.count() >= len(ODD) and frames.filter("frame > 0 and at_cs = 0").count() == 0
    assert text_media(empty).count() == 0


def _gif(frames, size=(4, 2), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    out = [b"GIF89a", bytes([size[0], 0, size[1], 0, 0x81, 0, 0]), bytes(v for c in palette for v in c)]
    for (x, y, w, h), pixels, disposal, clear, flags, local in frames:
        out += [bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), 7, 0, clear or 0, 0]), bytes([0x2C, x, 0, y, 0, w, 0, h, 0, flags]), local, b"\x02", G._blocks(G.lzw_encode(bytes(pixels), 2))]
    return b"".join([*out, b"\x3b"])


def test_gif_disposal_transparency_interlace_and_local_palette():
    full = (0, 0, 4, 2)
    seen = [f.pixels[..., :3].tolist() for f in G.read_gif(_gif([(full, [1] * 8, 1, None, 0, b""), ((0, 0, 2, 1), [2, 0], 3, 0, 0, b""), ((1, 1, 2, 1), [3, 3], 2, None, 0, b""), ((0, 0, 1, 1), [0], 1, 0, 0, b"")]))]
    red, green, blue, none = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    assert seen[0] == [[red] * 4] * 2
    assert seen[1] == [[green, red, red, red], [red] * 4]  # index 0 is transparent
    assert seen[2] == [[red] * 4, [red, blue, blue, red]]  # the frame before was taken back
    assert seen[3] == [[red] * 4, [red, none, none, red]]  # and this one's rectangle cleared
    rows = [0, 2, 1, 3, 0, 2, 1, 3]
    stored = [v for r in [0, 4, 2, 6, 1, 3, 5, 7] for v in [rows[r]]]
    one = list(G.read_gif(_gif([((0, 0, 1, 8), stored, 1, None, 0x40, b"")], (1, 8))))[0]
    assert one.indices[:, 0].tolist() == rows and one.delay == 7
    local = bytes([9] * 12)
    assert list(G.read_gif(_gif([(full, [1] * 8, 1, None, 0x81, local)])))[0].pixels[0, 0].tolist() == [9, 9, 9, 255]


def test_damaged_gifs_give_their_whole_frames_and_an_error(spark):
    payload = bytes(range(256)) * 192 * 2
    good = G.write_gif(payload)
    files = [good, good[:-1], good[: len(good) * 3 // 4], b"no image", b"", None, good[:20]]
    rows = G.frame_table(spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary")).collect()
    whole, bad = {}, {}
    for r in rows:
        (bad if r["error"] else whole).setdefault(r["doc_id"], []).append(r["frame"])
    assert whole == {0: [0, 1], 1: [0, 1], 2: [0]} and {k: v for k, v in bad.items()} == {1: [2], 2: [1], 3: [0], 6: [0]}


def test_packing_spreads_a_repeated_id(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.range(600).selectExpr("cast(null as long) as doc_id", "'same text' as text")
    rows = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=64, group_docs=50).collect()
    groups = {}
    for r in rows:
        groups[r["sequence_id"] >> 32] = groups.get(r["sequence_id"] >> 32, 0) + 1
    assert len(rows) == 600 and len(groups) == 12 and max(groups.values()) < 120


def test_covering_masks_meet_every_pair():
    masks, rng = S.covering_masks(4), np.random.default_rng(3)
    assert len(masks) == 31 and {m.bit_count() for m in masks} <= set(range(28, 37))
    for _ in range(3000):
        flips = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
        assert any(m & flips == 0 for m in masks)


def plain_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower(t).encode())
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("heavy", [512, 3])
def test_simhash(spark, empty, heavy, monkeypatch):
    monkeypatch.setattr(S, "HEAVY", heavy)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary, 120)) for _ in range(12)]
    texts = [*ODD]
    for b in base:
        for _ in range(6):
            w = b.split()
            w[rng.integers(len(w))] = "changed"
            texts.append(" ".join(w))
    docs = table(spark, texts)
    fp = [plain_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.simhash_components(docs).collect()}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in range(len(texts))}
    assert S.simhash_components(empty).count() == 0


def normal(line):
    return re.sub(r"\s+", " ", line.lower()).strip(" ")


def test_line_dedup(spark, docs, empty):
    texts = ODD + [f"{BASE}{w}\nunique {w} {i}" for i, w in enumerate(["tail", "tails", "tale", "other ending here", "tail"])]
    docs = table(spark, texts)
    lines = {(i, p): normal(x) for i, t in enumerate(texts) for p, x in enumerate((t or "").split("\n"))}
    lines = {k: v for k, v in lines.items() if v}
    nodes = sorted(set(lines.values()))
    sets, parent = [{x[k : k + 12] for k in range(len(x))} for x in nodes], list(range(len(nodes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    first = {}
    for k in sorted(lines):
        first.setdefault(find(nodes.index(lines[k])), k)
    keep = set(first.values())
    want = {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if (i, p) not in lines or (i, p) in keep) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["clean_text"] for r in dedup_lines(docs).collect()}
    assert got == want
    assert dedup_lines(empty).count() == 0 and line_classes(empty)[0].count() == 0


def test_html(spark):
    page = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">We use cookies, a long text that would otherwise count for a lot of characters here.</div>
    <article><h1>Head &amp; tail</h1><p><b>First   one.<br><p>Second &lt;here&gt;&nbsp;x</p><aside>related things</aside><ul><li>a<li>b</ul>
    <form><label>Mail</label><input></form><p>Last</p><div id="comments"><p>nice post</p></div></article><footer>(c)</footer></body></html>"""
    assert main_text(page) == "Head & tail First one. Second <here> x a b Last"
    soup = "<div id=menu><a>One</a><a>Two</a></div><div><h2>Title</h2><p>" + "Long text of the story. " * 5 + "</p><div class=ad>Buy</div><p>End.</p></div><div class=sidebar>" + "<p>aside text aside text</p>" * 9 + "</div>"
    assert main_text(soup) == "Title " + ("Long text of the story. " * 5).strip() + " End."
    assert main_text("") == "" and main_text("<nav>only</nav>") == "" and main_text("plain < text &#65;") == "plain < text A"
    pages = spark.createDataFrame([(1, "u", page, "clash"), (1, "u", page, "clash"), (2, None, None, ""), (3, "v", "<p>" * 20_000 + "deep", "")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["n_chars"]) for r in extract_text(pages).collect())
    assert got == [(1, len(main_text(page)))] * 2 + [(2, 0), (3, 4)]
    assert extract_text(pages.limit(0)).count() == 0


LONG = "Long text of the story that goes on and on. " * 3


@pytest.mark.parametrize("wrap", ['class="with-sidebar"', 'class="has-nav"', 'class="post no-comments"', 'class="search-result"', 'class="ad-free"', 'data-hidden="false"', 'data-grid="ad"', 'title="the hidden valley"', 'class="sidebar"'])
def test_html_names_that_only_mention_furniture(wrap):
    assert main_text(f"<div {wrap}><article><h1>Head</h1><p>{LONG}</p></article></div>") == f"Head {LONG.strip()}"
    if wrap != 'class="sidebar"':
        assert main_text(f"<div {wrap}><h1>Head</h1><p>{LONG}</p></div>") == f"Head {LONG.strip()}"


def test_html_surge_decides_in_articles_too():
    """Scraps in elements of their own before the surge stay out; a lead in the same element as the surge stays in."""
    scraps = "<div>4 min</div><div>A-Z</div><div>Tip</div>"
    assert main_text(f"<article>{scraps}<div><h1>Head</h1><p>Ann</p><p>Bob</p><p>{LONG}</p></div></article>") == f"Head Ann Bob {LONG.strip()}"
    assert main_text("<article><p>Short.</p><p>All of it.</p></article>") == "Short. All of it."


def test_html_links_titles_and_plain_menus():
    links = "".join(f"<li><a href=x>Reference number {i}</a>" for i in range(4))
    shown = " ".join(f"Reference number {i}" for i in range(4))
    title = '<div class="article-header"><h1>Head</h1></div>'
    assert main_text(f"<article>{title}<p>{LONG}</p><ul>{links}</ul><p>End.</p></article>") == f"Head {LONG.strip()} {shown} End."
    menu = "<div>Home</div><div>About us</div><div>Contact</div>"
    page = f"{menu}<div><h1>Head</h1><p>{LONG}</p><ul>{links}</ul><p>{LONG}</p></div><div>© 2020 Somebody</div>"
    assert main_text(page) == f"Head {LONG.strip()} {shown} {LONG.strip()}"
    assert main_text(f"{menu}<div><h1>Head</h1><p>{LONG}</p><ul>{links}</ul></div><div>Imprint</div>") == f"Head {LONG.strip()} {shown}"
    two = f"<div><p>{LONG}</p></div><ul>{links}</ul><div class=ad>Buy</div><div><p>{LONG}</p></div>"
    assert main_text(two) == f"{LONG.strip()} {LONG.strip()}"
    comments = f'<article><p>{LONG}</p></article><div id="comments"><article class="comment"><p>First!</p></article></div>'
    assert main_text(comments) == LONG.strip()


@given(st.lists(st.integers(0, 60), max_size=40), st.integers(1, 4), st.integers(1, 80), st.integers(1, 20))
def test_stretches_equal_plain_sums(lengths, window, surge, dive):
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    want, begin = [], None
    floor = min(surge, max(sums, default=0))
    for i, total in enumerate(sums):
        if begin is not None and total < dive:
            want.append((begin, i))
            begin = None
        if begin is None and lengths[i] and total >= floor:
            begin = i
    want += [(begin, len(lengths))] if begin is not None else []
    assert stretches(np.array(lengths, np.int64), window, surge, dive) == (want if any(lengths) else [])


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_html_of_any_text_keeps_it(text):
    shown = re.sub(r"\s+", " ", text).strip()
    assert main_text("<article><p>" + html.escape(text).replace("\r", "\n") + "</p></article>") == re.sub(r"\s+", " ", html.unescape(html.escape(text).replace("\r", "\n"))).strip() or not shown


def plain_spans(t):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for rank, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(x - 9 if x > 9 else x for i, c in enumerate(reversed(digits)) for x in [int(c) * (1 + i % 2)])
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


PRIVATE = ["a@b.c_x@d.e a@b.c%x@d.e ..q@w.e.r..t@y.u", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.0255 1.1.1.11.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 4111111111111111 5", "é😀 a@b.co ñ+1 (212) 555-0199. +1--2 +123", "9" * 3000 + " 1" * 3000, "a" * 20_000 + "@x.y", "x@y" + ".z" * 5000, "+12345678901234567 +4915112345678 - 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"]


def test_pii(spark, empty):
    secret = [f"zorblax writes to agent{k}@secret.org about quomfrit {k} {w}" for k in (7,) for w in ("alpha", "beta", "gamma", "delta")]
    texts = PRIVATE + ODD + secret + ["mails and writes about many other things " + str(i) for i in range(60)]
    docs = table(spark, texts)
    found = find_personal_data(docs)
    got = {r["doc_id"]: r for r in digests(found).collect()}
    for i, t in enumerate(texts):
        base = plain_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), i
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [base.count(k + ":") for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))
    first = len(PRIVATE) + len(ODD)
    told = {texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] for i in range(first, first + 4) for s in got[i]["spans"].split(",") if s.startswith("term")}
    assert told >= {"zorblax", "quomfrit"} and "about" not in told
    clean = {r["doc_id"]: r["clean_text"] for r in sanitised(docs, found).collect()}
    assert clean[first].startswith("[term] ") and "agent7" not in clean[first] and clean[len(PRIVATE)] == ""
    assert digests(find_personal_data(empty)).count() == 0


def test_pii_terms_equal_plain_counts(spark):
    """Every term span against a plain count of texts, PMI and evidence; texts far longer than any window, copies, and a clean text."""
    rng = np.random.default_rng(4)
    vocabulary = [f"wort{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    texts = []
    for i in range(240):
        w = list(rng.choice(vocabulary, 30))
        if i % 12 == 0:
            w[0], w[-1] = "Quomfrit", f"person{i}@secret-firm.org"
            if i % 24 == 0:
                w[5] = "zorblax"
        if i % 30 == 7:
            w[3] = "+49 30 1234" + f"{i:04d}"
            w[20] = "blumquist"
        texts.append(" ".join(w))
    texts += ["a note about quomfrit and nothing else", texts[0], texts[0], None, ""]
    support, disclosure, certainty, evidence = 3, 0.8, 0.5, 12.0
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
    held, words = {}, {}
    for t in {t or "" for t in texts}:
        found = {(k, m[0]) for k, p in kinds.items() for m in re.finditer(p, t)}
        ids = {(k, v if k == "email" else re.sub("[^0-9]", "", v)) for k, v in found}
        held[t] = ids | {(k + "~", v.split("@")[1] if k == "email" else v[:6]) for k, v in ids}
        words[t] = {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)}
    told, n = set(), len(held)
    for e in set().union(*held.values()):
        n_e = sum(e in x for x in held.values())
        for w in set().union(*words.values()):
            n_t, n_te = sum(w in x for x in words.values()), sum(w in words[t] and e in held[t] for t in held)
            if n_te >= support and n_te >= certainty * n_t and n_e < n:
                pmi = np.log2(n_te * n / (n_t * n_e))
                if pmi >= disclosure * np.log2(n / n_e) and n_te * pmi * np.log(2) >= evidence:
                    told.add(w)
    assert told >= {"quomfrit", "zorblax", "blumquist"}
    got = {r["doc_id"]: r["spans"] for r in digests(find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, t in enumerate(texts):
        want = {f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]{3,}", t or "") if m[0].lower() in told}
        assert {x for x in got[i].split(",") if x.startswith("term")} == want


def test_toxicity(spark, empty):
    rng = np.random.default_rng(2)
    vocabulary = [f"wort{i}" for i in range(300)]
    texts, marks = [], []
    for i in range(900):
        bad = i % 4 == 0
        w = list(rng.choice(vocabulary, 40))
        for _ in range(3 if bad else 0):
            w.insert(int(rng.integers(40)), ["idiot", "grumbold" + str(rng.choice(["en", "er", "ig"])), "you fool"][int(rng.integers(3))])
        texts.append(" ".join(w))
        marks.append(int(bad))
    docs = table(spark, texts + ["", None])
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(marks)] + [(5, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(docs, labels).collect()}
    assert len(got) == 902
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(900))
    assert np.mean([got[i]["predicted"] == marks[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in score_toxicity(docs, none).collect()} == {0.0}
    assert score_toxicity(empty, labels).count() == 0


def test_line_dedup_rows_and_names(spark):
    """Null and repeated ids of different texts, exact repeats, and columns named as the operator's own."""
    schema = "doc_id string, text string, gone int, id int, row int, n_lines int, clean_text string, a int"
    line = "a line that is long enough to be found again"
    rows = [(None, f"{line}\nfirst", 1, 2, 3, 4, "x", 5), ("none", f"{line}\nsecond", 1, 2, 3, 4, "x", 5), (None, f"third\n{line}", 1, 2, 3, 4, "x", 5), ("z", "alone", 1, 2, 3, 4, "x", 5), ("z", "alone", 1, 2, 3, 4, "x", 5)]
    got = dedup_lines(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "gone", "id", "row", "a", "n_lines", "n_dropped", "clean_text"]
    texts = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["clean_text"]) for r in got.collect())
    assert texts == [("None", 2, 1, "first"), ("None", 2, 1, "third"), ("none", 2, 0, f"{line}\nsecond"), ("z", 1, 0, "alone"), ("z", 1, 0, "alone")]


def test_line_dedup_large_bucket(spark):
    """Hundreds of near copies of one line in the same buckets, against brute force; a short line and a hot exact copy beside them."""
    rng = np.random.default_rng(8)
    base = ["".join(map(chr, rng.integers(97, 123, int(m)))) for m in rng.integers(3, 9, 60)]
    texts = ["tiny"] * 40
    for i in range(300):
        w = list(base)
        for k in rng.integers(0, 60, 1 + i % 9):
            w[int(k)] = f"x{i}"
        texts.append(" ".join(w))
    sets = [{x[i : i + 12] for i in range(len(x))} for x in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            if (n := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    rows = dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    dropped, want = {r["doc_id"] for r in rows if r["n_dropped"]}, {i for i in range(len(texts)) if find(i) != i}
    assert dropped <= want and len(want - dropped) <= 0.02 * len(want)


def test_line_dedup_every_character(spark):
    """Against brute force on shingles at every character: lines without blanks, short lines, and words with one letter changed."""
    rng = np.random.default_rng(5)
    text = lambda low, high, n: "".join(map(chr, rng.integers(low, high, n)))
    texts = []
    for k in range(20):
        han, url = text(0x4E00, 0x9FA5, 200), "://" + text(97, 123, 190)
        texts += [han, "字" + han, "https" + url, "http" + url, text(97, 123, 8 + k), text(97, 123, 30), (short := text(97, 123, 90)), "x" + short]
    for n in (15, 20, 25, 40) * 15:
        words = [text(97, 123, int(m)) for m in rng.integers(3, 9, n)]
        at = int(rng.integers(n))
        texts += [" ".join(words), " ".join([*words[:at], "é" + words[at][1:], *words[at + 1 :]])]
    sets = [{x[i : i + 12] for i in range(len(x))} for x in texts]
    similar = {(i, j) for j in range(len(texts)) for i in range(j) if (n := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)}
    assert {(8 * k + i, 8 * k + i + 1) for k in range(20) for i in (0, 2, 6)} <= similar
    rows = dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    dropped, want = {r["doc_id"] for r in rows if r["n_dropped"]}, {j for _, j in similar}
    assert dropped <= want and len(want - dropped) <= 0.02 * len(want)


def test_line_dedup_many_dropped_lines(spark):
    """100 000 dropped lines in one text, kept ones between them."""
    lines = ["the very same line of text that comes again and again"] * 100_000
    for i, w in enumerate(("first", "second", "third")):
        lines[i * 40_000 + 1] = f"{w} quite another line here {w * 3} {i}"
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n\nthe very same line of text that comes again and again"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in dedup_lines(df).collect()}
    assert got[1]["n_lines"] == 100_000 and got[1]["n_dropped"] == 100_000 - 4
    assert got[1]["clean_text"].split("\n") == [lines[0], lines[1], lines[40_001], lines[80_001]]
    assert (got[2]["n_dropped"], got[2]["clean_text"], got[3]["clean_text"]) == (1, "\n", "")


def test_pii_many_matches_in_a_text(spark):
    """Places of matches over many blocks, block ends included, in linear time."""
    for n in (0, 1, 255, 256, 257, 512, 30_000):
        text = " ".join(f"é u{i}@ex{i % 7}.org," for i in range(n))
        want = [(m.start(), m.end(), m.group()) for m in re.finditer(r"u[0-9]+@ex[0-9]\.org", text)]
        got = spark.createDataFrame([(text,)], "t string").select(base_spans(F.col("t"))["email"]).first()[0]
        assert [tuple(x) for x in got] == want
