"""Counts by pre-token against the library's own."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from repograph.llm import tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")


def counted(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    return sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count(df, PATH, batch=60).collect())


def test_counts_equal_the_library(spark):
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "The", "it's", "'ll", "12", "é", "日本", "😀", "!!", "<|endoftext|>", "<|endof", " ", " ", "\u0085", "ᲊ", "\U0001e030", "x" * 30, "don't", "_", "́", "½"]
    texts = [None, "", " ", "word " * 3000, *["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(400)]]
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert counted(spark, [(i, t, "clash") for i, t in enumerate(texts)]) == want


def test_repeated_rows_and_same_ids(spark):
    rows = [(1, "two words", ""), (1, "two words", ""), (1, "other text here", ""), (2, None, ""), (2, None, "")]
    assert counted(spark, rows) == [(1, 9, 2, False), (1, 9, 2, False), (1, 15, 3, False), (2, 0, 0, False), (2, 0, 0, False)]


def test_empty_table(spark):
    assert counted(spark, []) == []


def test_texts_whose_32_bit_hashes_are_equal_keep_their_own_counts(spark):
    from pyspark.sql import functions as F

    texts = ["x 79787", "one two three 246968"]
    assert spark.createDataFrame([(t,) for t in texts], "t string").select(F.hash("t")).distinct().count() == 1
    library = Tokenizer.from_file(PATH)
    want = sorted((len(t), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    got = spark.createDataFrame([(k, t) for k in (None, 7) for t in texts], "doc_id long, text string")
    rows = tokencount.count(got, PATH, batch=60).collect()
    for k in (None, 7):
        assert sorted((r.n_bytes, r.n_tokens) for r in rows if r.doc_id == k) == want


def test_every_character_is_cut_as_the_library_does(spark):
    library = Tokenizer.from_file(PATH)
    texts = ["".join(f"a{chr(c)}1{chr(c)}! {chr(c)}" for c in range(start, min(start + 512, 0x110000)) if not 0xD800 <= c < 0xE000) for start in [*range(0, 0x20000, 512), 0x32200, 0x3D000, 0xE0000, 0x10FE00]]
    want = [(i, len(t.encode()), n, n > 1024) for i, t in enumerate(texts) for n in [len(library.encode(t, add_special_tokens=False).ids)]]
    assert counted(spark, [(i, t, "") for i, t in enumerate(texts)]) == want


def test_a_very_long_text(spark):
    library = Tokenizer.from_file(PATH)
    text = "".join(f"word{i % 9973} and\n" for i in range(400_000)) + "z" * 200_000
    assert counted(spark, [(1, text, ""), (2, "short", "")]) == [(1, len(text), len(library.encode(text, add_special_tokens=False).ids), True), (2, 5, 1, False)]
