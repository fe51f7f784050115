"""The pipeline's stages against plain Python on a small table."""

import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from repograph.llm import quality, stages
from repograph.llm.queries import tokenizer_path
from tokenizers import Tokenizer

from .test_operators import DOCS, near_texts, plain_components


def test_stages_keep_and_drop(spark):
    texts = near_texts(4, 70) + ["a token = deadbeefdeadbeefdeadbeef here with more words in it"]
    df = spark.createDataFrame([(i, t, f"s{i % 2}", "en", len(t or ""), 0, 0) for i, t in enumerate(texts)], DOCS).drop("key", "node")
    first = {c for _, _, c in plain_components(texts, 5, 80, 100)}
    kept = stages.keep_one_of_each(df)
    assert {r.doc_id for r in kept.collect()} == first and kept.columns == df.columns
    clean = {r.doc_id: r.text for r in stages.redacted(df).collect()}
    assert len(clean) == len(texts) and all(clean[i] == t for i, t in enumerate(texts[:-1])) and "deadbeef" not in clean[len(texts) - 1]


def test_one_of_each_decides_by_row(spark):
    """A unique text keeps its row though its id has a copy elsewhere; of identical rows one stays; nulls and bare texts stay."""
    x, y = " ".join(f"x{i}" for i in range(9)), " ".join(f"y{i}" for i in range(9))
    rows = [(3, y), (5, x), (5, y), (7, "z z z"), (7, "z z z"), (None, y), (None, y), (8, ""), (8, ""), (9, None)]
    df = spark.createDataFrame([(i, t, 1, "d", 0.5) for i, t in rows], "doc_id long, text string, n int, digest string, `odd.name` double")
    kept = stages.keep_one_of_each(df)
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(3, y), (5, x), (7, "z z z"), (None, y), (None, y), (8, ""), (8, ""), (9, None)]))
    assert kept.columns == df.columns and stages.keep_one_of_each(df.limit(0)).count() == 0


def test_quality_stage(spark):
    rng = random.Random(1)
    words = ["the", "house", "runs", "green", "over"]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(80)] + [" ".join(w.upper() + "!!" for w in rng.choices(words, k=30)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "s", "en", len(t), 0, 0) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(120)], "doc_id long, quality int")
    kept = stages.keep_good(df, labels)
    scores = {r.doc_id: r.score for r in quality.score(df, quality.fit(df, labels)).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.7} == set(range(80))
    assert kept.columns == df.columns


def test_stages_take_any_columns_nulls_and_empty_tables(spark):
    rows = [(1, "plain words here", 1.0, "s", 2, None), (None, None, None, None, None, None), (3, "", 0.5, "t", 0, 1), (3, "", 0.5, "t", 0, 1), (4, "token = abcdef0123 and more", 0.1, "s", 9, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, source string, n_chars long, `__score` int").withColumn("__text", F.lit("x")).withColumn("odd.name", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    for stage in (lambda d: stages.keep_good(d, labels, threshold=0.0), stages.keep_one_of_each, stages.redacted):
        kept = stage(df)
        assert kept.columns == df.columns and kept.count() == 5 and stage(df.limit(0)).count() == 0
    assert {r.text for r in stages.redacted(df).collect()} == {"plain words here", None, "", "[SECRET] and more"}
    assert {(r.doc_id, r.start) for r in stages.packed(df, tokenizer_path()).collect()} == {(1, 0), (None, 0), (3, 0), (4, 0)}
    assert stages.packed(df, tokenizer_path()).count() == 5 and stages.packed(df.limit(0), tokenizer_path()).count() == 0


def test_a_very_long_text_goes_through_all_stages(spark):
    text = " ".join(f"word{i % 5000}" for i in range(1_000_000)) + " AKIA" + "Q7" * 10
    df = spark.createDataFrame([(1, text, "s", len(text)), (2, "short one", "s", 9)], "doc_id long, text string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    clean = {r.doc_id: r.text for r in stages.redacted(stages.keep_one_of_each(stages.keep_good(df, labels, 0.5))).collect()}
    assert clean[2] == "short one" and clean[1].startswith(text[:-30]) and "AKIA" not in clean[1]


def test_run_is_its_stages(spark):
    """run's rows are those of the stages called one after the other, and its packing places each kept document whole."""
    folder = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, folder).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
    kept = {r.doc_id: r.text or "" for r in docs.collect()}
    library = Tokenizer.from_file(tokenizer_path())
    pieces, spots = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r["length"], r.ids_crc32, r.doc_tokens))
        spots[r.sequence_id].append((r.offset, r["length"]))
    assert set(pieces) == set(kept)
    for doc_id, text in kept.items():
        ids, at = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4"), 0
        for start, n, crc, all_tokens in sorted(pieces[doc_id]):
            assert (start, crc, all_tokens) == (at, zlib.crc32(ids[at : at + n].tobytes()), len(ids))
            at += n
        assert at == len(ids)
    for k, held in spots.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at == 1024 or k == max(spots)


def test_stages_take_names_that_clash(spark):
    """Names that differ in case from text, or that the stages use themselves; which of repeated rows stays is fixed."""
    text = "token = abcdef0123 and more words of one text"
    rows = [(1, text, "B", i, "x", 0.5, "d") for i in (9, 3, 7)] + [(2, text, "A", 1, "y", 0.1, "e"), (4, "other words here", None, 5, "z", 0.2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT string, n_chars long, source string, score double, digest string").selectExpr("*", "1 as id", "2 as `__stage_id`", "3 as c0", "'q' as row")
    labels = spark.createDataFrame([(i, i % 2, "t", 5) for i in range(5)], "doc_id long, quality int, text string, Quality int")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        good, kept, clean = stages.keep_good(df, labels, threshold=0.0), stages.keep_one_of_each(df), stages.redacted(df)
        assert good.columns == kept.columns == clean.columns == df.columns
        assert sorted(map(tuple, good.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
        assert sorted((r.doc_id, r.n_chars, r.TEXT) for r in kept.collect()) == [(1, 3, "B"), (4, 5, None)]
        assert {(r.doc_id, r.text, r.TEXT, r.n_chars) for r in clean.collect()} == {(i, "[SECRET] and more words of one text", t, 35) for i, t in ((1, "B"), (2, "A"))} | {(4, "other words here", None, 16)}
        assert stages.packed(df, tokenizer_path()).count() >= 5
        upper = df.select("doc_id", "text", "n_chars", "source").toDF("DOC_ID", "TEXT", "N_CHARS", "Source")
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
    assert stages.keep_one_of_each(df).count() == 2 and stages.redacted(df).count() == 5  # by position, so clashes do not matter
    assert stages.keep_one_of_each(upper).columns == stages.redacted(upper).columns == upper.columns
    assert stages.keep_one_of_each(upper).count() == 2


def test_the_fit_holds_no_values_of_all_rows():
    """Values are those that a list of them gave, one row's at a time; what comes to the driver is smaller than the numbers."""
    import numpy as np

    from repograph.llm import quality

    rows = [quality.features(f"words {i} and {'more ' * i}") for i in range(20)] + [np.empty(0, np.int32)]
    ratios = np.random.default_rng(1).normal(size=1 << quality.BITS)
    scaled = quality.Scaled(rows, ratios)
    assert len(scaled) == len(rows) and all((v == ratios[r] / np.sqrt(max(1, len(r)))).all() for r, v in zip(rows, scaled))
    assert all((quality.unpacked(quality.packed(r)) == r).all() for r in rows)
    assert sum(len(quality.packed(r)) for r in rows) < sum(r.nbytes for r in rows)
