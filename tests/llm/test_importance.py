import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from repograph.llm import importance, oracles

SCHEMA = "doc_id long, text string"


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def grams_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, share, least, buckets):
    """The operator by strings of n-grams and zlib."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, rows in ((s, docs), (t, target)):
        for _, text in rows:
            for g in grams_of(text):
                counts[g % buckets] += 1
    gain = [math.floor(1000 * math.log((a + 1) * (s.sum() + buckets) / ((b + 1) * (t.sum() + buckets)))) for a, b in zip(t, s)]
    out = []
    for i, text in docs:
        grams = grams_of(text)
        weight = sum(gain[g % buckets] for g in grams)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: share[0] * len(able) // share[1]], 1):
        r[4] = n
    return sorted(map(tuple, out), key=str)


def spark_rows(spark, docs, target, share=(30, 100), least=5, buckets=997):
    got = importance.resample(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(target, "item_id long, text string"), share, least, buckets)
    return sorted(map(tuple, got.collect()), key=str)


def test_crc_algebra():
    rng = random.Random(3)
    for n in [*range(70), 127, 128, 1000, 70_001]:
        a, b = rng.randbytes(rng.randint(0, 90)), rng.randbytes(n)
        moved = importance.append_zeros(np.array([zlib.crc32(a)], np.uint32), np.array([n]))
        assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_equals_the_plain_version(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abXYZ09éß") for _ in range(rng.randint(1, 6)))
    docs = [(i, rng.choice([" ", "\n", "--", "\x00"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, " .,! "), (None, "a b c d e f g"), (3, docs[3][1]), (3, docs[3][1]), (103, "y" * 300 + " " + "z" * 64 + " q " + "ü" * 5000 + " a b"), (104, "w" * (importance.CHUNK + 5) + " a b c d e")]
    target = [(i, docs[i][1]) for i in range(0, 30, 3)] + [(1, None)]
    assert spark_rows(spark, docs, target) == plain(docs, target, (30, 100), 5, 997)


def test_empty_tables_and_clashing_names(spark):
    assert spark_rows(spark, [], [(1, "a b")]) == []
    docs = [(i, f"alpha beta w{i} gamma delta") for i in range(10)]
    assert spark_rows(spark, docs, []) == plain(docs, [], (30, 100), 5, 997)
    wide = spark.createDataFrame([(1, i, t, "x", 7, 8) for i, t in docs], "`TEXT ` int, doc_id long, text string, Text string, rank int, `a.b` int")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        got = importance.resample(wide, spark.createDataFrame([], "text string"), (30, 100), 5, 997)
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, [], (30, 100), 5, 997)
    with pytest.raises(ValueError):
        importance.resample(wide.drop("doc_id"), wide)


def test_sql_is_registered():
    assert "op11_importance_resampling" in oracles.SQL
