import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from repograph.llm import perplexity

SCHEMA = "doc_id long, lang string, text string"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
GAP = r"[\x20\x09-\x0D]+"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    words, seen, dup = words_of(text), set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed


def grams_of(text, n=perplexity.ORDER):
    joined = " ".join(words_of(text))
    padded = "\n" * (n - 1) + joined + "\n"
    return [padded[i : i + n] for i in range(len(joined) + 1)] if joined else []


class Plain:
    """Modified Kneser-Ney by dictionaries, from the texts of one fold; ``letters``: of both."""

    def __init__(self, texts, letters, n=perplexity.ORDER):
        self.counts, self.n, self.least = {n: Counter(g for t in texts for g in grams_of(t))}, n, 1 / (letters + 1)
        for k in range(n - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.cut, self.context = {}, {}
        for k, counts in self.counts.items():
            each = Counter(counts.values())
            self.cut[k] = perplexity.discounts([each[i] for i in (1, 2, 3, 4)])
            self.context[k] = defaultdict(list)
            for g, c in counts.items():
                self.context[k][g[:-1]].append(c)

    def chance(self, gram):
        k = len(gram)
        if not k:
            return self.least
        below, others = self.chance(gram[1:]), self.context[k].get(gram[:-1])
        if not others:
            return below
        cut = lambda c: self.cut[k][min(c, 3) - 1]
        c = self.counts[k][gram]
        return ((c - cut(c) if c else 0) + sum(map(cut, others)) * below) / sum(others)


def documents(seed=3):
    rng = random.Random(seed)
    parts = ["the", "an", "ing", "er", "sh", "on", "ed", "th"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    rows = [(i, rng.choice(["en", "de", None]), rng.choice([" ", "\n", " \t"]).join(word() for _ in range(rng.randint(40, 120)))) for i in range(60)]
    rows += [(100, "en", None), (101, "en", ""), (102, None, " \n\t"), (103, "en", "a b c"), (104, "de", "x # y\nx # y\n\nx # y | <z>"), (None, "en", rows[0][2]), (0, "en", rows[0][2])]
    rows += [(105, "en", " ".join("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(8)) for _ in range(60))), (106, "en", "a\x00b é́ " * 30), (107, "de", "one two three " * 40)]
    return rows


def judged(spark, rows, **more):
    return perplexity.judge(spark.createDataFrame(rows, SCHEMA).repartition(3), **more)


def test_base_counts_and_perplexity_equal_the_plain_version(spark):
    rows = documents()
    folds = {r.text: r.fold for r in spark.createDataFrame([(t or "",) for _, _, t in rows], "text string").select("text", (F.xxhash64("text").bitwiseAND(1)).alias("fold")).distinct().collect()}
    clean = lambda t: (t or "").replace("\x00", "�")
    letters = len({g[-1] for _, _, t in rows for g in grams_of(clean(t))})
    models = [Plain([clean(t) for _, _, t in rows if folds[t or ""] == m], letters) for m in (0, 1)]
    got = judged(spark, rows).collect()
    key = lambda i, lang, base: (str(i), str(lang), base)
    expected = {key(i, lang, base(t)): t for i, lang, t in rows}
    assert len(got) == len(rows)
    for r in got:
        t = expected[key(r.doc_id, r.lang, tuple(r[c] for c in BASE))]
        grams = grams_of(clean(t))
        if not grams:
            assert r.log_perplexity is None and not r.kept
        else:
            plain = -sum(math.log(models[1 - folds[t]].chance(g)) for g in grams) / len(grams)
            assert abs(r.log_perplexity - plain) < 1e-5
            assert r.kept == (not r.base_failed and r.band_low <= math.floor(r.log_perplexity * 1000) <= r.band_high)
    assert not next(r for r in got if r.doc_id == 105).kept  # letters that no other text has
    assert sum(r.kept for r in got) >= 40


def test_bands_by_distinct_texts(spark):
    rows = [("en", i, 1000 + i) for i in range(101)] + [("en", 5, 1005)] * 900 + [("de", 1, 700)] + [("fr", i, 10 * i) for i in range(101)]
    df = spark.createDataFrame(rows, "language string, digest long, milli long").withColumn("base_failed", F.lit(False))
    got = {r.language: (r.low, r.high) for r in perplexity.bands(df).collect()}
    width = perplexity.LEAST_WIDTH * perplexity.FENCE
    assert got == {"en": (1025 - width, 1075 + width), "de": (700 - width, 700 + width), "fr": (250 - 1500, 750 + 1500)}


def test_the_join_gives_the_same(spark):
    rows = documents(4)
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert as_rows(judged(spark, rows)) == as_rows(judged(spark, rows, model_rows=0))


def test_many_letters_and_long_texts(spark, monkeypatch):
    text = " ".join(chr(0x4E00 + i) + chr(0x5000 + i * 2) for i in range(9000))
    counter = perplexity.Counter()
    chunk = perplexity.Chunk([text.encode()], [len(text)])
    batches = [b for _, characters in chunk.slices() for b in counter.add(characters, chunk.of)] + list(counter.packed())
    found = Counter()
    for b in batches:
        for g, n0, n1 in zip(*(b.column(i).to_pylist() for i in range(3))):
            found[g] += n0
            assert n1 == 0
    assert found == Counter(grams_of(text))
    long = [(1, "en", "word and other words " * 60_000), (2, "en", "z" * 300_000)]
    got = {r.doc_id: r for r in judged(spark, long).collect()}
    assert got[1].n_words == 240_000 and got[1].n_repeat_words == 240_000 and got[2].word_chars == 300_000


def test_empty_tables_and_clashing_names(spark):
    assert judged(spark, []).collect() == []
    assert [r.kept for r in judged(spark, [(1, "en", None), (2, None, " ")]).collect()] == [False, False]
    wide = spark.createDataFrame(documents()[:5], SCHEMA).selectExpr("'x' as gram", "1 as digest", "*", "2 as n_words", "'y' as `a.b`", "3 as kept")
    assert perplexity.judge(wide).count() == 5
