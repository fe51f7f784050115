"""Secret scans: fixed patterns, and character Markov models for strings that no pattern knows.

The base detectors are three patterns.  The method adds spans of kind ``markov``: strings of key
characters that a character model of random strings explains better than one of ordinary
identifiers.  Both models are first-order Markov chains over characters, trained from labelled
samples (``labelled_samples``); a candidate is reported when the log-likelihood ratio per
character, and in all, is above its threshold.  Where base spans touch a candidate, the parts
outside them are scored alone.

The models are fixed by the samples' seed, so a text's result depends on nothing but the text.

Defined results: a null text is empty; a text without findings has empty spans and the digest of
the empty string; repeated rows and null ids keep their rows; a table without rows gives no rows;
other columns are ignored.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import support

# The base patterns and the least length of what they must find.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are taken whole, so shorter ones need no match
LEAST_VALUE, LEAST_ACCESS = 6, 20
# What the learned scan looks at.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Parts of ordinary identifiers, for the negative samples.
IDENTIFIER_PARTS = (
    "account action address amount array async attribute base batch block body bool buffer build button byte cache call callback channel char check child class "
    "client code collection color column command common compare component config connection content context control convert count create current cursor data "
    "database date debug default delete device dictionary directory display document domain download element email enable encode entry error event example "
    "execute expression extension factory feature field file filter final first flag folder format frame function generator global group handler hash header "
    "height helper history host image import index info initial input insert instance integer interface internal item iterator key label language last layer "
    "layout length level library limit line link list listener loader local location lock login main manager mapping mask match matrix max memory menu message "
    "method min mode model module monitor move name network next node notification number object offset operation option order output owner page panel parameter "
    "parent parse path pattern payment permission pixel player point policy position post prefix price print process product profile progress project property "
    "provider query queue random range read record reference register remote render report request reset resource response result return role root route rule "
    "sample schema scope score screen search section select sequence serial server service session setting shape size slot sort source stack start state status "
    "step store stream string style submit suffix support switch symbol system table target task temp template test text thread time title toggle total track "
    "transaction transform tree trigger type unit update upload url user utility valid value variable vector version video view wait width window word worker write"
).split()

RESULT = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """(string, 1 if random): keys of common alphabets and lengths, and identifiers of every case style."""
    rng = random.Random(seed)
    upper, lower, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    alphabets = [upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_", lower + digits, upper + digits, digits + "abcdef", digits + "ABCDEF"]
    samples = []
    for i in range(n):
        samples.append(("".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 64))), 1))
        parts = rng.choices(IDENTIFIER_PARTS, k=rng.randint(3, 7))
        style = i % 6
        if style == 0:
            text = "_".join(parts)
        elif style == 1:
            text = parts[0] + "".join(p.title() for p in parts[1:])
        elif style == 2:
            text = "".join(p.title() for p in parts)
        elif style == 3:
            text = "-".join(parts)
        elif style == 4:
            text = "/".join(parts).upper() if i % 12 == 4 else "/".join(parts)
        else:
            text = "".join(parts)
        if i % 5 == 0:
            text += str(rng.randint(1, 2025))
        samples.append((text, 0))
    return samples


class MarkovPair:
    """Two first-order character chains with additive smoothing, compared by log-likelihood ratio."""

    def __init__(self, samples: list[tuple[str, int]], smooth: float = 0.1):
        n = len(ALPHABET) + 1  # the last state is the string's border
        self.place = {c: i for i, c in enumerate(ALPHABET)}
        counts = np.full((2, n, n), smooth)
        for text, label in samples:
            at = [n - 1, *(self.place.get(c, n - 1) for c in text)]
            np.add.at(counts[label], (at[:-1], at[1:]), 1)
        chance = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.ratio = (chance[1] - chance[0]).tolist()
        self.border = n - 1

    def score(self, text: str) -> float:
        """log P(text | random) - log P(text | ordinary)."""
        total, before, place = 0.0, self.border, self.place
        for c in text:
            now = place.get(c, self.border)
            total += self.ratio[before][now]
            before = now
        return total


@functools.lru_cache(1)
def default_model() -> MarkovPair:
    return MarkovPair(labelled_samples())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base findings by start, then kind as listed."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def looks_random(text: str, model: MarkovPair, per_char: float, in_all: float) -> bool:
    core = text.strip("=-_/+")
    if len(core) < 20 or not any(c.isalpha() for c in core):
        return False
    score = model.score(core)
    return score >= in_all and score >= per_char * len(core) and not math.isinf(score)


def outside(start: int, end: int, spans: list) -> list[tuple[int, int]]:
    """The parts of start to end that no span (ordered by start) touches."""
    parts = []
    for _, s, e in spans:
        if s < end and start < e:
            parts.append((start, s))
            start = max(start, e)
    return [(a, b) for a, b in [*parts, (start, end)] if a < b]


def find(text: str, model: MarkovPair, per_char: float = 0.6, in_all: float = 15.0) -> tuple[list, list]:
    """Base spans and all spans of a text, each (kind, start, end)."""
    base = base_spans(text)
    more = []
    for m in CANDIDATE.finditer(text):
        for start, end in outside(m.start(), m.end(), base):
            if looks_random(text[start:end], model, per_char, in_all):
                more.append(("markov", start, end))
    order = {k: i for i, k in enumerate((*KINDS, "markov"))}
    return base, sorted(base + more, key=lambda s: (s[1], order[s[0]]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, per_char: float = 0.6, in_all: float = 15.0) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans of each document."""
    support.ready(docs.sparkSession)
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def task(batches):
        model = default_model()
        for batch in batches:
            rows = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                base, spans = find(text.as_py() or "", model, per_char, in_all)
                n = [sum(1 for s in spans if s[0] == k) for k in (*KINDS, "markov")]
                for x, y in zip(rows, (doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, RESULT)


def redact(docs: DataFrame, per_char: float = 0.6, in_all: float = 15.0, mark: str = "[SECRET]") -> DataFrame:
    """The documents, all columns, with every span of their text replaced; n_chars follows where there is one."""
    support.ready(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index("text")

    def clean(text, model):
        if text is None:
            return None
        out, last = [], 0
        for _, start, end in sorted(find(text, model, per_char, in_all)[1], key=lambda s: s[1:]):
            if start >= last:
                out += [text[last:start], mark]
            last = max(last, end)
        return "".join([*out, text[last:]]) if out else text

    def task(batches):
        model = default_model()
        for batch in batches:
            texts = pa.array([clean(t.as_py(), model) for t in batch.column(at)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], schema.names)

    found = support.numbered(docs).mapInArrow(task, schema)
    return found.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else found
