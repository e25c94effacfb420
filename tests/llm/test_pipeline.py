"""Every stage of the pipeline against a plain version, stage by stage."""

import re
import zlib
from collections import Counter

import pytest

from tests.llm.test_operators import lower, plain_fingerprint

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
    words = base.split()
    texts = [f"{base * 3}{i} ends" for i in range(10)] + [" ".join(words[(i * k * k + k) % 20] + str((i * k) % 7) for k in range(1, 40 + i)) for i in range(1, 31)] + ["Same Text here", "same text HERE"] * 3 + ["you idiot moron scum " * 3 + str(i) for i in range(20)] + ["", None]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, int("idiot" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = docs.collect()
        if name == "packing":
            break
        assert docs.columns == columns
        ids = Counter(r["doc_id"] for r in got)
        if name == "toxicity":
            assert set(before) - set(ids) == {i for i, t in before.items() if "idiot" in (t or "")}
        elif name == "exact_dedup":
            best = {}
            for i, t in before.items():
                best[lower(t)] = max(best.get(lower(t), -1), i)
            assert ids == Counter(best.values())
        elif name == "near_dedup":
            order, fps = sorted(before), {i: plain_fingerprint(t) for i, t in before.items()}
            root = {i: i for i in order}
            for _ in order:
                for i in order:
                    for j in order:
                        if (fps[i] ^ fps[j]).bit_count() <= 4:
                            root[i] = root[j] = min(root[i], root[j])
            assert ids == Counter(set(root.values()))
        elif name == "mixing":
            assert max(ids.values()) <= 2 and set(ids) <= set(before)
            size = {i: len(re.findall(r"\S+", t or "")) for i, t in before.items()}
            near = sum(max((n for i, n in size.items() if i % 4 == s), default=0) for s in range(4)) / 2 + 1
            assert abs(sum(size[i] * n for i, n in ids.items()) - 1.5 * sum(size.values())) <= near
        before = {r["doc_id"]: r["text"] for r in got}
    assert {r["doc_id"] for r in got} == set(before)
    assert zlib.crc32(b"") == 0 and all(r["length"] > 0 for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "x y", None, None, None)] * 3 + [(None, "z", None, "s", 1)], schema)
    kept = corpus_pipeline.exact(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "None"]
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.mixing, corpus_pipeline.packing):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_rows_of_null_and_repeated_ids_are_told_apart(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clean = [" ".join(f"{w}{k * 17 % 101}" for w in "river stone maple cloud amber field ocean candle".split()) + f" number {k}" for k in range(6)]
    toxic = ["you idiot moron scum " * 3 + str(i) for i in range(30)]
    rows = [(None if i < 3 else 7, t, None, f"s{i % 2}", 0) for i, t in enumerate(clean)] + [(100 + i, t, None, "s", 0) for i, t in enumerate(toxic)] + [(None, toxic[0], None, "s", 0)] + [(200 + i, f"{t} more", None, "s", 0) for i, t in enumerate(clean * 6)]
    marks = [(r[0], 1, int("idiot" in r[1])) for r in rows if r[0] and r[0] >= 100]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.toxicity(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()
    assert set(clean) <= {r["text"] for r in got} and not any("idiot" in r["text"] for r in got)
    docs = spark.createDataFrame(rows[:6] + rows[:1], schema)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        assert sorted(r["text"] for r in stage(spark, docs, str(tmp_path)).collect()) == sorted(clean)
    taken = Counter(r["text"] for r in corpus_pipeline.mixing(spark, docs.limit(6), str(tmp_path)).collect())
    assert max(taken.values()) <= 2


def test_stages_with_clashing_columns_and_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, key int, id int, copies int, none int, a int, b int"
    docs = spark.createDataFrame([(i, f"text number {i} of a few with words {i * 7}", None, "s", 1, *[i] * 7) for i in range(6)] + [(1, None, None, None, None, *[9] * 7)], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (corpus_pipeline.toxicity, corpus_pipeline.exact, corpus_pipeline.near):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    assert corpus_pipeline.mixing(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.toxicity(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_batches_of_long_texts_are_bounded(spark, tmp_path):
    """After the first stage Spark hands Python a few MB of texts at a time, however long they are."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    corpus_pipeline.toxicity(spark, spark.createDataFrame([], schema), str(tmp_path))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    got = spark.sql("select repeat('word ', 10000) as text from range(0, 600, 1, 1)").mapInArrow(sizes, "n long").collect()
    assert sum(r["n"] for r in got) > 30_000_000 and max(r["n"] for r in got) < 5_000_000


def test_packing_remembers_little():
    """What a task remembers of 200 000 words stays small."""
    import tracemalloc

    import pyarrow as pa
    import public_tokenizers

    from sparkwright.llm.packing import WordTokens

    encode = WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    tracemalloc.start()
    try:
        for i in range(40):
            encode(pa.array([" ".join(f"w{i}x{j}" for j in range(5000))]))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 25_000_000


def test_packing_keeps_the_frequent_words():
    """Words that come again and again are encoded once, however many rare ones lie between; ids stay the tokenizer's."""
    import pyarrow as pa
    import public_tokenizers

    from sparkwright.llm.packing import WordTokens

    learned = []

    class Watched(WordTokens):
        def _learn(self, words):
            learned.extend(map(str, words))
            return super()._learn(words)

    encode = Watched(public_tokenizers.path("word_bpe_49k.json"))
    often = [f"often{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    for k in range(60):
        text = " ".join([*often, *(f"r{k}x{j}" for j in range(5000)), *often])
        (got,) = encode(pa.array([text]))
    assert len(set(learned)) == 100 + 60 * 5000  # more than is remembered
    assert sum(w.startswith("often") for w in learned) == 100
    assert got.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_remembers_few_bytes():
    import pyarrow as pa
    import public_tokenizers

    from sparkwright.llm.packing import KNOWN_BYTES, WordTokens

    encode = WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(24):
        text = " ".join(f"{k}{j}" + "long" * 500 for j in range(250))
        (got,) = encode(pa.array([text]))
        assert encode.words.nbytes + encode.ids.nbytes < KNOWN_BYTES + 2_000_000
    assert got.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_leaves_ids_out(spark):
    import public_tokenizers

    from sparkwright.llm.packing import token_pieces

    docs = spark.createDataFrame([(1, "one two three"), (2, None), (None, "four " * 30)], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    short, whole = (token_pieces(docs, path, 16, with_ids=w) for w in (False, True))
    assert short.columns == ["id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(repr, short.collect())) == sorted(map(repr, whole.drop("ids").collect()))


def test_packing_splits_marks_from_words():
    """Whatever marks follow a word, only the word and its marks are encoded, and ids stay the tokenizer's."""
    import random

    import pyarrow as pa
    import public_tokenizers

    from sparkwright.llm.packing import WordTokens

    rng, encode = random.Random(5), WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    tokens = ["Word", "é", "e\u0301", "ß", "7", "½", "日本", "it's", "<|endoftext|>", "<|", "|>", " ", "\n", "\u00a0", "\u0338", "İ", *map(chr, range(33, 127))]
    texts = ["".join(rng.choices(tokens, k=rng.randrange(40))) for _ in range(4000)]
    want = [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encode(pa.array(texts))] == want
    encode = WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    encode(pa.array([f"thing{m * n}" for m in "$%&#*" for n in (1, 3)]))
    assert len(encode.words) == 11  # "thing" and the ten runs of marks
