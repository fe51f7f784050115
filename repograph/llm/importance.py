"""Target-distribution importance resampling over hashed word n-grams.

Every run of 1 to 3 words is a feature; its bucket is the CRC-32 of its words joined by one space, modulo ``buckets``.
The target table gives one distribution over the buckets, the documents another; a bucket's gain is the scaled logarithm
of their ratio, a document's weight the sum of the gains of its features, and Gumbel noise drawn from the id
turns the highest scores into a sample without replacement in proportion to exp(weight / 1000).

CRCs are combined, strings of n-grams never made: a word's CRC is computed once, from its bytes; then

    crc(a + b) = M[len(b)] * crc(a)  ^  crc(b)

where M[n] is the 32 x 32 matrix over GF(2) that appends n zero bytes.  The matrices of short lengths are held as four
tables of 256 words each, those of longer ones are made of the powers of two in the length.

Texts are scanned twice, for the buckets' counts and for the weights, as raw UTF-8 in Arrow buffers; what leaves the first scan is
one row for each bucket and task.  The drawn documents are ranked by ranges and prefix sums, in no single task.

Defined results: a null text has no features; a null id draws the noise of the id ``null`` and comes last among ties; repeated rows
are documents each, of equal score; without documents or without eligible ones nothing is drawn; an empty target
gives gains by the documents alone; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordering
from . import support

BUCKETS, LEAST_WORDS, SHARE, SEED = 10_000, 20, (5, 100), 42
CHUNK = 1 << 21  # bytes that are cut at once; a longer text is a chunk of its own
SHORT = 64  # appended lengths with tables of their own, and word lengths that are hashed side by side
POLYNOMIAL = 0xEDB88320  # CRC-32, reflected
U4 = np.uint32

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

COUNTS = "bucket int, n long"
WEIGHTS = "doc_id long, n_features long, n_words long, weight long"


# -- CRC algebra ----------------------------------------------------------------------------


def times(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A matrix over GF(2), given by its 32 columns, times each of the vectors."""
    out = np.zeros_like(vectors)
    for bit in range(32):
        out ^= np.where(vectors >> U4(bit) & U4(1), matrix[bit], U4(0))
    return out


def tables_of(matrix: np.ndarray) -> np.ndarray:
    """The matrix as four tables, one for each byte of a vector."""
    byte = np.arange(256, dtype=U4)
    return np.stack([times(matrix, byte << U4(8 * j)) for j in range(4)])


@functools.lru_cache(1)
def algebra() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables for appending 0 .. SHORT zero bytes, for appending 2**k of them, and the CRC's table for one byte."""
    bit = np.concatenate([[U4(POLYNOMIAL)], U4(1) << np.arange(31, dtype=U4)])  # one zero bit: a shift to the right
    one = bit
    for _ in range(3):
        one = times(one, one)
    matrix, short = U4(1) << np.arange(32, dtype=U4), []
    for _ in range(SHORT + 1):
        short.append(tables_of(matrix))
        matrix = times(one, matrix)
    powers, matrix = [], one
    for _ in range(40):
        powers.append(tables_of(matrix))
        matrix = times(matrix, matrix)
    step = np.arange(256, dtype=U4)
    for _ in range(8):
        step = np.where(step & U4(1), step >> U4(1) ^ U4(POLYNOMIAL), step >> U4(1))
    return np.stack(short), np.stack(powers), step


def look(tables: np.ndarray, which: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    out = tables[which, 0, crc & U4(255)]
    for j in (1, 2, 3):
        out = out ^ tables[which, j, crc >> U4(8 * j) & U4(255)]
    return out


def append_zeros(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """M[length] * crc for each pair."""
    short, powers, _ = algebra()
    out = look(short, np.minimum(lengths, SHORT), crc)
    far = np.flatnonzero(lengths > SHORT)
    if len(far):
        c, left = crc[far], lengths[far]
        for k in range(int(left.max()).bit_length()):
            c = np.where(left >> k & 1, look(powers, k, c), c)
        out[far] = c
    return out


def word_crcs(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word: short ones side by side, byte by byte."""
    step = algebra()[2]
    by_length = np.argsort(np.minimum(length, SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    sizes = length[by_length]
    far = int(np.searchsorted(-sizes, -SHORT, "left"))  # the first `far` words are longer than SHORT
    out = np.empty(len(start), U4)
    for i in by_length[:far]:
        out[i] = zlib.crc32(raw[start[i] : start[i] + length[i]])
    near, sizes = by_length[far:], sizes[far:]
    crc, at = np.full(len(near), 0xFFFFFFFF, U4), start[near]
    for j in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -j, "left"))  # words longer than j
        crc[:n] = step[(crc[:n] ^ raw[at[:n] + j]) & U4(255)] ^ crc[:n] >> U4(8)
    out[near] = ~crc
    return out


def joined(left: np.ndarray, word: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc(left + ' ' + word) from the CRCs of both and the word's length."""
    space = np.full(1, zlib.crc32(b" "), U4)
    spaced = append_zeros(np.broadcast_to(space, length.shape), length) ^ word
    return append_zeros(left, length + 1) ^ spaced


# -- features -------------------------------------------------------------------------------


def features(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """[(the n-gram's CRC, its document) for n of 1 to 3] and the number of words of each document raw[begin:end]."""
    raw = LOWER[raw]
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = WORD[raw]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    edge = begin[begin < end]
    first[edge] = inside[edge]
    last = inside[:-1] & ~inside[1:]
    edge = end[begin < end] - 1
    last[edge] = inside[edge]
    start = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - start
    of = np.searchsorted(end, start, "right")
    one = word_crcs(raw, start, length)
    two = joined(one[:-1], one[1:], length[1:])
    three = joined(two[:-1], one[2:], length[2:])
    pairs, triples = of[:-1] == of[1:], of[:-2] == of[2:]
    return [(one, of), (two[pairs], of[:-1][pairs]), (three[triples], of[:-2][triples])], np.bincount(of, minlength=len(begin))


def chunks(texts: pa.Array):
    """(rows from, rows to, raw bytes, begin and end of each row) of at most CHUNK bytes or one text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a]
        a = b


def counter(buckets: int):
    """A mapInArrow function: text -> how often the task met each bucket."""

    def task(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, raw, begin, end in chunks(batch.column(0)):
                for crc, _ in features(raw, begin, end)[0]:
                    n += np.bincount(crc % U4(buckets), minlength=buckets)
        met = np.flatnonzero(n)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n[met])], ["bucket", "n"])

    return task


def weigher(gains: np.ndarray):
    """A mapInArrow function: doc_id, text -> doc_id, features, words and the sum of the features' gains."""

    def task(batches):
        for batch in batches:
            for a, b, raw, begin, end in chunks(batch.column(1)):
                found, words = features(raw, begin, end)
                weight, n = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for crc, of in found:
                    upto = np.concatenate([[0], np.cumsum(gains[crc % U4(len(gains))])])
                    each = np.bincount(of, minlength=b - a)
                    ends = np.cumsum(each)
                    weight += upto[ends] - upto[ends - each]
                    n += each
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(words.astype(np.int64)), pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"])

    return task


def texts_of(df: DataFrame) -> DataFrame:
    plain, text = support.pick(df, "text")
    return plain.select(F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def bucket_counts(df: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: ``buckets`` numbers, whatever the table's size."""
    rows = texts_of(df).mapInArrow(counter(buckets), COUNTS).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of both smoothed distributions) for each bucket."""
    t, s, buckets = float(target.sum()), float(source.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((a + 1.0) * (s + buckets) / ((b + 1.0) * (t + buckets)))) for a, b in zip(target.tolist(), source.tolist())], np.int64)


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank for each row; the ``share`` of the documents of enough words with the highest scores have a rank."""
    support.ready(docs.sparkSession)
    gain = gains(bucket_counts(target, buckets), bucket_counts(docs, buckets))
    plain, doc_id, text = support.pick(docs, "doc_id", "text")
    weighed = plain.select(doc_id.cast("long").alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text")).mapInArrow(weigher(gain), WEIGHTS)
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    scored = support.table(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "weighed")
    able = scored.where(F.col("n_words") >= least_words)
    most = share[0] * able.count() // share[1]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    placed = ordering.numbered(able, order, "rank").withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    out = placed.unionByName(scored.where(F.col("n_words") < least_words), allowMissingColumns=True)
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
