"""Quality rules with an n-gram language model: base counts of a text, and bands of its perplexity for its language.

The model is a modified Kneser-Ney model over the characters of a text's words, joined by one space, of order ``ORDER``.
Spark counts it over whole texts of all documents: a task counts the distinct n-grams of its documents, one shuffle sums them, and the
lower orders, contexts and discounts are grouped from the sums.  So that no text is judged by counts of its own, texts are
dealt to two folds by their hash (copies fall into one) and a text is scored with the counts of the other fold only.

Every n-gram of the corpus has a row with its log-probability under both folds, back-off resolved, as integers of 2**-20 nats, so that sums do
not depend on any order.  Sorted by the 64-bit hash of the n-gram, these are two arrays: up to ``MODEL_ROWS`` rows (64 MB) go to
the tasks, which find a hash by its leading bits; a larger model stays a table, and the documents' distinct n-grams are
joined with it.  Both ways give the same numbers.

A document's language has a band from the quartiles of log-perplexity over distinct texts that pass the base rules: outside
[Q1 - 3 w, Q3 + 3 w], with w the larger of Q3 - Q1 and ``LEAST_WIDTH``, a document is rejected.

Defined results: a null text has no words; null languages are one language; repeated rows are documents each and judged alike; NUL
counts as U+FFFD in the model; a table without rows gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import support

ORDER = 5
MODEL_ROWS = 1 << 22  # 16 bytes a row: what may be broadcast
BANDS = 50_000  # languages whose bands may be broadcast
LEAST_WORDS, MOST_REPEATED = 50, 50
LEAST_WIDTH = 200  # thousandths of a nat
FENCE = 3
UNIT = 1 << 20  # log-probabilities are integers of this fraction of a nat
CHUNK, SLICE = 1 << 21, 1 << 21  # bytes of texts that are joined, n-grams that are hashed at once
LETTERS = 12  # bits of a character in a packed n-gram
HELD = 1 << 22  # distinct n-grams that a task holds before it merges them
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
EDGE = 10  # a line feed stands before the first and after the last character; no word has one

GRAMS = "gram string, n0 long, n1 long"
HASHED = "hash long, cost0 int, cost1 int"
MEASURES = "doc_id long, lang string, digest long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long"
SCORED = MEASURES + ", cost long"
LISTED = MEASURES + ", hashes array<long>, often array<int>"


# -- texts ----------------------------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
    pairs = np.unique(w[:-1] * len(numbers) + w[1:], return_inverse=True)[1]
    _, window, often = np.unique(pairs[:-1] * len(numbers) + w[2:], return_inverse=True, return_counts=True)
    twice = often[window] > 1
    inside = np.zeros(len(words), bool)
    for j in range(3):
        inside[j : len(words) - 2 + j] |= twice
    return int(inside.sum())


def measures(raw: bytes, words: list[bytes], chars: int) -> tuple[int, ...]:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars - max(len(words) - 1, 0), sum(map(raw.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


class Chunk:
    """Texts as one array of characters; n-gram i of all starts at ``starts[i]``."""

    def __init__(self, texts: list[bytes], chars: list[int]):
        edges = bytes([EDGE]) * (ORDER - 1)
        codes = np.frombuffer(b"".join(edges + t + bytes([EDGE]) for t in texts).decode().encode("utf-32-le"), np.uint32)
        self.codes = np.where(codes == 0, np.uint32(0xFFFD), codes)
        self.sizes = np.array(chars, np.int64) + 1
        begins = np.cumsum(self.sizes + ORDER - 1) - (self.sizes + ORDER - 1)
        firsts = np.cumsum(self.sizes) - self.sizes
        self.of = np.repeat(np.arange(len(texts)), self.sizes)
        self.starts = np.arange(len(self.of)) + np.repeat(begins - firsts, self.sizes)

    def slices(self):
        """(document of each, the characters of each as ORDER arrays) of up to SLICE n-grams."""
        for a in range(0, len(self.of), SLICE):
            at = self.starts[a : a + SLICE]
            yield self.of[a : a + SLICE], [self.codes[at + j] for j in range(ORDER)]


def chunks(rows, size: int = CHUNK):
    """Rows of (..., text) in lists of about ``size`` bytes; a longer text is a list of its own."""
    held, n = [], 0
    for row in rows:
        if held and n + len(row[-1]) > size:
            yield held
            held, n = [], 0
        held.append(row)
        n += len(row[-1])
    if held:
        yield held


def joined_words(raw: bytes) -> tuple[bytes, list[bytes], int]:
    words = raw.split()
    joined = b" ".join(words)
    return joined, words, len(joined.decode())


def gram_hash(characters: list[np.ndarray]) -> np.ndarray:
    """64 bits of each n-gram."""
    h = np.full(len(characters[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in characters:
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


# -- counting -------------------------------------------------------------------------------


class Counter:
    """Counts of the n-grams of a task by fold, packed by the alphabet that it has met so far."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.place = np.full(0x110000, -1, np.int64)
        self.letters: list[int] = []
        self.keys: list[np.ndarray] = []
        self.often: list[np.ndarray] = []

    def add(self, characters: list[np.ndarray], fold: np.ndarray):
        """Yields batches when the alphabet is full."""
        if not len(fold):
            return
        met = np.unique(np.concatenate([np.unique(c) for c in characters]))
        if len(met) > 1 << LETTERS and len(fold) > 1:  # no run of n-grams with so many letters fits: halve it
            half = len(fold) // 2
            yield from self.add([c[:half] for c in characters], fold[:half])
            yield from self.add([c[half:] for c in characters], fold[half:])
            return
        new = met[self.place[met] < 0]
        if len(self.letters) + len(new) > 1 << LETTERS:
            yield from self.packed()
            self.clear()
            new = met
        self.place[new] = np.arange(len(new)) + len(self.letters)
        self.letters += new.tolist()
        key = np.zeros(len(fold), np.int64)
        for c in characters:
            key = key << LETTERS | self.place[c]
        keys, often = np.unique(key << 1 | fold, return_counts=True)
        self.keys.append(keys)
        self.often.append(often)
        if len(self.keys) > 1 and sum(map(len, self.keys)) > HELD:
            self.merge()

    def merge(self) -> None:
        keys, often = np.concatenate(self.keys), np.concatenate(self.often)
        order = np.argsort(keys, kind="stable")
        keys, often = keys[order], often[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        self.keys, self.often = [keys[first]], [np.add.reduceat(often, first)]

    def packed(self):
        if not self.keys:
            return
        self.merge()
        keys, often = self.keys[0], self.often[0]
        gram, fold = keys >> 1, keys & 1
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        at = np.cumsum(np.r_[True, gram[1:] != gram[:-1]]) - 1
        counts = np.zeros((2, len(first)), np.int64)
        counts[fold, at] = often
        letters = np.array(self.letters, np.uint32)
        for a in range(0, len(first), 1 << 17):
            part = gram[first[a : a + (1 << 17)]]
            codes = np.stack([letters[part >> LETTERS * (ORDER - 1 - j) & (1 << LETTERS) - 1] for j in range(ORDER)], 1)
            texts = np.ascontiguousarray(codes).view(f"<U{ORDER}").ravel()
            yield pa.RecordBatch.from_arrays([pa.array(texts.tolist(), pa.string()), *(pa.array(n[a : a + (1 << 17)]) for n in counts)], ["gram", "n0", "n1"])


def count_grams(batches):
    """A mapInArrow function: digest, text -> the distinct n-grams of the task with their counts in both folds."""
    counter = Counter()
    for batch in batches:
        for rows in chunks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            texts = [(digest & 1, *joined_words(raw)) for digest, raw in rows]
            texts = [t for t in texts if t[2]]
            if texts:
                chunk, fold = Chunk([t[1] for t in texts], [t[3] for t in texts]), np.array([t[0] for t in texts])
                for of, characters in chunk.slices():
                    yield from counter.add(characters, fold[of])
    yield from counter.packed()


# -- model ----------------------------------------------------------------------------------


def discounts(n: list[int]) -> tuple[float, float, float]:
    """What is taken from counts of 1, 2 and more, from the numbers of n-grams with counts of 1 to 4."""
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05 * k), 0.95 * k) for k in (1, 2, 3))


def mass(fold: int, cut: tuple[float, float, float]):
    """What the discounts leave of a context's counts for lower orders."""
    return sum((F.col(f"{r}_{fold}") * F.lit(d) for r, d in zip(("one", "two", "more"), cut)), F.lit(0.0))


def kept(fold: int, cut: tuple[float, float, float]):
    c = F.col(f"n{fold}")
    return F.when(c == 0, 0.0).when(c == 1, 1 - cut[0]).when(c == 2, 2 - cut[1]).otherwise(c - cut[2])


def sums_of() -> list:
    """Totals of counts, and how many are 1, 2 and more, for both folds."""
    out = []
    for m in (0, 1):
        c = F.col(f"n{m}")
        out += [F.sum(c).alias(f"all_{m}"), F.sum((c == 1).cast("long")).alias(f"one_{m}"), F.sum((c == 2).cast("long")).alias(f"two_{m}"), F.sum((c > 2).cast("long")).alias(f"more_{m}")]
    return out


def model(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """hash, cost0 and cost1 of every n-gram of the texts (digest, text): minus its log-probability under the counts of either fold."""
    grams = {order: support.table(texts.mapInArrow(count_grams, GRAMS).groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")}
    for k in range(order - 1, 0, -1):  # in how many ways a shorter one goes on to the left
        shorter = grams[k + 1].groupBy(F.substring("gram", 2, k).alias("gram"))
        grams[k] = support.table(shorter.agg(*[F.sum((F.col(f"n{m}") > 0).cast("long")).alias(f"n{m}") for m in (0, 1)]), "grams")
    shares = [F.sum((F.col(f"n{m}") == r).cast("long")).alias(f"n{m}_{r}") for m in (0, 1) for r in (1, 2, 3, 4)]
    rows = [grams[k].agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n"), *shares, *sums_of()) for k in grams]
    found = {}
    whole = rows[0]
    for row in rows[1:]:
        whole = whole.unionByName(row)
    for r in whole.na.fill(0).collect():  # a row for each order
        found[r.k] = r
    cuts = {k: [discounts([r[f"n{m}_{i}"] for i in (1, 2, 3, 4)]) for m in (0, 1)] for k, r in found.items()}
    least = 1.0 / (found[1].n + 1)
    chances = []
    for m in (0, 1):
        total, cut = found[1][f"all_{m}"], cuts[1][m]
        left = sum(found[1][f"{r}_{m}"] * d for r, d in zip(("one", "two", "more"), cut))
        chances.append((kept(m, cut) / F.lit(float(total)) + F.lit(left / total * least) if total else F.lit(least)).alias(f"p{m}"))
    known = grams[1].select("gram", *chances)
    for k in range(2, order + 1):
        contexts = grams[k].groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(*sums_of())
        below = known.select(F.col("gram").alias("shorter"), F.col("p0").alias("below0"), F.col("p1").alias("below1"))
        with_both = grams[k].withColumns({"context": F.substring("gram", 1, k - 1), "shorter": F.substring("gram", 2, k - 1)}).join(contexts, "context").join(below, "shorter")
        known = with_both.select("gram", *[F.when(F.col(f"all_{m}") > 0, (kept(m, cuts[k][m]) + mass(m, cuts[k][m]) * F.col(f"below{m}")) / F.col(f"all_{m}")).otherwise(F.col(f"below{m}")).alias(f"p{m}") for m in (0, 1)])
    costs = known.select("gram", *[F.round(-F.log(f"p{m}") * UNIT).cast("int").alias(f"cost{m}") for m in (0, 1)])
    return support.table(costs.mapInArrow(hashed, HASHED), "model")


def hashed(batches):
    for batch in batches:
        if batch.num_rows:
            codes = np.frombuffer("".join(batch.column(0).to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
            yield pa.RecordBatch.from_arrays([pa.array(gram_hash(list(codes.T)).view(np.int64)), batch.column(1), batch.column(2)], ["hash", "cost0", "cost1"])


class Sorted:
    """Sorted hashes with the costs of both folds, found by the leading bits of a hash."""

    def __init__(self, hashes: np.ndarray, costs: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.costs = hashes[order], costs[:, order]
        bits = max(1, len(hashes).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def cost(self, fold: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = self.begin[(h >> self.shift).view(np.int64)]
        off = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != h)
        while len(off):
            at[off] += 1
            if int(at[off].max()) >= len(self.hashes):
                raise ValueError("the documents are not those that the model was counted on")
            off = off[self.hashes[at[off]] != h[off]]
        return self.costs[fold, at]


# -- scoring --------------------------------------------------------------------------------


def measured(batches, score):
    """MEASURES of each row and what ``score`` gives for the texts of a chunk."""
    names = [c.split()[0] for c in MEASURES.split(", ")]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 7]
    for batch in batches:
        for rows in chunks(zip(*(batch.column(i).to_pylist() for i in range(4)))):
            texts = [joined_words(r[3]) for r in rows]
            out = [(*r[:3], *measures(r[3], words, chars), chars + 1 if words else 0) for r, (_, words, chars) in zip(rows, texts)]
            more = score([r[2] for r in rows], texts)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] + list(more.values()), names + list(more))


def scorer(shared):
    """A mapInArrow function: doc_id, lang, digest, text -> SCORED, by the arrays of the model."""

    def score(digests, texts):
        total = np.zeros(len(texts), np.int64)
        some = [i for i, t in enumerate(texts) if t[1]]
        if some:
            chunk, fold = Chunk([texts[i][0] for i in some], [texts[i][2] for i in some]), 1 - (np.array([digests[i] for i in some]) & 1)
            own, at = np.zeros(len(some), np.int64), np.array(some)
            for of, characters in chunk.slices():
                upto = np.r_[0, np.cumsum(shared.value.cost(fold[of], gram_hash(characters)), dtype=np.int64)]
                each = np.bincount(of, minlength=len(some))
                ends = np.cumsum(each)
                own += upto[ends] - upto[ends - each]
            total[at] = own
        return {"cost": pa.array(total)}

    return lambda batches: measured(batches, score)


def lister(batches):
    """A mapInArrow function: doc_id, lang, digest, text -> LISTED, the distinct n-grams of each document."""

    def score(digests, texts):
        hashes, often = [], []
        for joined, words, chars in texts:
            if not words:
                hashes.append([])
                often.append([])
                continue
            parts = [np.unique(gram_hash(characters), return_counts=True) for _, characters in Chunk([joined], [chars]).slices()]
            h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            hashes.append(h.view(np.int64))
            often.append(np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int32))
        return {"hashes": pa.array(hashes, pa.list_(pa.int64())), "often": pa.array(often, pa.list_(pa.int32()))}

    return measured(batches, score)


def joined_costs(rows: DataFrame, costs: DataFrame) -> DataFrame:
    """SCORED by a join of the documents' n-grams with the model."""
    listed = support.table(rows.mapInArrow(lister, LISTED).withColumn("row", F.monotonically_increasing_id()), "listed")
    each = listed.select("row", (F.col("digest").bitwiseAND(1) == 1).alias("odd"), F.explode(F.arrays_zip("hashes", "often")).alias("g"))
    each = each.select("row", "odd", F.col("g.hashes").alias("hash"), F.col("g.often").alias("often")).join(costs, "hash")
    total = each.groupBy("row").agg(F.sum(F.col("often") * F.when(F.col("odd"), F.col("cost0")).otherwise(F.col("cost1"))).alias("cost"))
    return listed.join(total, "row", "left").select(*[c.split()[0] for c in MEASURES.split(", ")], F.coalesce("cost", F.lit(0)).cast("long").alias("cost"))


def bands(scored: DataFrame) -> DataFrame:
    """language, low and high in thousandths of a nat: quartiles over distinct texts that pass the base rules, by counts of each thousandth."""
    texts = scored.where(~F.col("base_failed")).select("language", "digest", "milli").distinct()
    counts = texts.groupBy("language", "milli").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("language")
    upto = counts.select("language", "milli", F.sum("n").over(own.orderBy("milli")).alias("upto"), F.sum("n").over(own).alias("of"))
    at = [F.min(F.when(F.col("upto") * 4 >= F.col("of") * q, F.col("milli"))).alias(name) for q, name in ((1, "q1"), (3, "q3"))]
    width = F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_WIDTH)) * FENCE
    return upto.groupBy("language").agg(*at).select("language", (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))


def judge(docs: DataFrame, model_rows: int = MODEL_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, lang, log_perplexity (nats a character; null without words) and the band of each row."""
    spark = support.ready(docs.sparkSession)
    plain, doc_id, lang, text = support.pick(docs, "doc_id", "lang", "text")
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = plain.select(doc_id.cast("long").alias("doc_id"), lang.cast("string").alias("lang"), text)
    rows = rows.select("doc_id", "lang", F.xxhash64(whole).alias("digest"), whole.cast("binary").alias("text"))
    costs = model(rows.select("digest", "text"))
    if costs.limit(model_rows + 1).count() > model_rows:
        found = joined_costs(rows, costs)
    else:
        held = costs.toArrow()
        arrays = Sorted(held["hash"].to_numpy().view(np.uint64), np.stack([held[f"cost{m}"].to_numpy() for m in (0, 1)]))
        found = rows.mapInArrow(scorer(spark.sparkContext.broadcast(arrays)), SCORED)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    log = F.when(F.col("n_grams") > 0, F.col("cost") / UNIT / F.col("n_grams"))
    marked = found.withColumns({"base_failed": failed, "language": F.coalesce("lang", F.lit("")), "log_perplexity": log}).withColumn("milli", F.floor(F.col("log_perplexity") * 1000))
    scored = support.table(marked.drop("cost", "n_grams"), "perplexity")
    by_language = support.table(bands(scored), "bands")
    if by_language.limit(BANDS + 1).count() <= BANDS:
        by_language = F.broadcast(by_language)
    inside = F.coalesce(F.col("milli").between(F.col("low"), F.col("high")), F.lit(False))
    out = scored.join(by_language, "language", "left").withColumn("kept", ~F.col("base_failed") & inside)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log_perplexity", F.col("low").alias("band_low"), F.col("high").alias("band_high"))
