"""Token counts: pieces counted once per distinct pre-token, joined to the documents' pre-tokens and summed.

The pre-tokens of a byte-level BPE are cut by the tokenizer's own pattern, once for each text.  Documents are cut in
batches of bounded size; a batch keeps the list of its distinct pre-tokens, most frequent first, and for each document the
numbers of its pre-tokens in that list, as differences, with their frequencies.  Then

1. the batches' pre-tokens are dealt and sorted by pre-token, so all rows of one lie together: its pieces are
   counted once and go back to (batch, number).  A pre-token of all documents is a row for each batch, not for each document;
2. each batch's documents meet the piece counts of its list, and frequency times pieces is summed.

No ids are made for documents, no text is shuffled, and what a task holds is bounded by the size of a batch.

The pattern's classes are those of this Python's Unicode tables; a text with a character that is unassigned there is
cut by the library, and goes on as the others do.

Defined results: a null text is empty and has 0 tokens; each row has its own count, also where rows repeat or share
a doc_id; a null doc_id stays null; special strings inside a text count as the library counts them by
default (one token each); a text longer than a batch is a batch of its own; a table without rows gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import support
from .bytelevel import PATTERN

BATCH = 32 << 20  # characters of text in a batch
CUT = "batch long, doc_id long, n_bytes long, specials long, which binary, often binary, words array<string>"
PIECES = "batch long, at int, pieces int"
COUNTS = "doc_id long, n_bytes long, n_tokens long"


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("token counts by pre-token take a byte-level BPE with its regex, without normaliser or prefix space")
    plain = [t for t in spec.get("added_tokens", []) if not (t["lstrip"] or t["rstrip"] or t["single_word"])]
    if len(plain) != len(spec.get("added_tokens", [])):
        raise ValueError("added tokens that strip their surroundings are not taken")
    return sorted((t["content"] for t in plain), key=len, reverse=True)


@functools.lru_cache(1)
def unassigned():
    """Tells whether a text has a character that this Python's Unicode tables do not know.

    A class of characters below U+10000 alone is a bitmap, one that goes beyond is a list of ranges that is searched for
    each character: the ranges beyond are only looked at where a text has such characters.
    """
    ranges, last = [], None
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn":
            if last is not None and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
            last = c
    of = lambda some: re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in some) + "]")
    low = of([(a, min(b, 0xFFFF)) for a, b in ranges if a <= 0xFFFF])
    high = of([(max(a, 0x10000), b) for a, b in ranges if b > 0xFFFF])
    far = re.compile("[\U00010000-\U0010FFFF]")
    return lambda text: bool(low.search(text) or (far.search(text) and high.search(text)))


def cutter(path: str):
    """A function from a text to its pre-tokens and the number of its special strings."""
    import regex

    pattern, odd = regex.compile(PATTERN), unassigned()
    specials = special_strings(path)
    splitter = re.compile("|".join(map(re.escape, specials))) if specials else None

    @functools.lru_cache(1)
    def library():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path).pre_tokenizer

    def plain(text: str) -> list[str]:
        if not text.isascii() and odd(text):
            return [text[a:b] for _, (a, b) in library().pre_tokenize_str(text)]
        return pattern.findall(text)

    def cut(text: str) -> tuple[list[str], int]:
        parts = splitter.split(text) if splitter and splitter.search(text) else [text]
        return [w for part in parts for w in plain(part)] if len(parts) > 1 else plain(text), len(parts) - 1

    return cut


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four planes of bytes, of which the higher ones are nearly all zero."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(stored: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(stored, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Batch:
    """Documents with a common list of distinct pre-tokens."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.which: list[np.ndarray] = []
        self.often: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id, text: str, found: list[str], specials: int) -> None:
        often, words = Counter(found), self.words
        self.rows.append((doc_id, len(text.encode()), specials))
        self.which.append(np.fromiter((words.setdefault(w, len(words)) for w in often), np.int64, len(often)))
        self.often.append(np.fromiter(often.values(), np.int64, len(often)))
        self.held += len(text)

    def packed(self, number: int) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in self.which])
        which, often, begin = np.concatenate(self.which), np.concatenate(self.often), np.cumsum(sizes) - sizes
        order = np.argsort(-np.bincount(which, often, len(self.words)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = np.lexsort((rank[which], np.repeat(np.arange(len(sizes)), sizes)))
        which, often = rank[which][at], often[at]
        steps = np.diff(which, prepend=0)
        full = begin[sizes > 0]
        steps[full] = which[full]
        words = list(self.words)
        rows = [(number, *row, planes(steps[b : b + n]), planes(often[b : b + n]), None) for row, b, n in zip(self.rows, begin, sizes)]
        rows.append((number, None, None, None, None, None, [words[i] for i in order]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in CUT.split(", ")])


def cut_batches(path: str, size: int):
    """A mapInArrow function: doc_id, text -> a row for each document, and one with the distinct pre-tokens of each batch."""

    def task(batches):
        cut, held = cutter(path), Batch()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if held.rows and held.held + len(text) > size:
                    yield held.packed(number)
                    number, held = number + 1, Batch()
                held.add(doc_id, text, *cut(text))
        if held.rows:
            yield held.packed(number)

    return task


def pieces_of(path: str):
    """A mapInArrow function over rows that are sorted by word: batch, at, word -> batch, at, pieces; each word is tokenised once."""

    def task(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        last, pieces = None, 0
        for batch in batches:
            runs = pa.RecordBatch.from_arrays([batch.column(2)], ["word"]).column(0).dictionary_encode()
            counts = np.array([pieces if w == last else len(tokenizer.encode(w, add_special_tokens=False)) for w in runs.dictionary.to_pylist()], np.int32)
            if batch.num_rows:
                last, pieces = batch.column(2)[-1].as_py(), int(counts[runs.indices[-1].as_py()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts[runs.indices.to_numpy()])], ["batch", "at", "pieces"])

    return task


def summed(docs: pa.Table, pieces: pa.Table) -> pa.Table:
    """The documents of a batch, with the pieces of its words: a row for each document."""
    by_word = np.zeros(pieces.num_rows, np.int64)
    by_word[pieces["at"].to_numpy()] = pieces["pieces"].to_numpy()
    tokens = [specials + int(by_word[np.cumsum(from_planes(which))] @ from_planes(often)) for specials, which, often in zip(*(docs[c].to_pylist() for c in ("specials", "which", "often")))]
    return pa.table({"doc_id": docs["doc_id"], "n_bytes": docs["n_bytes"], "n_tokens": pa.array(tokens, pa.int64())})


def count(docs: DataFrame, tokenizer_path: str, limit: int = 1024, batch: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) for each row."""
    support.ready(docs.sparkSession)
    special_strings(tokenizer_path)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = support.table(texts.mapInArrow(cut_batches(tokenizer_path, batch), CUT), "cut")
    words = cut.where("words is not null").select("batch", F.posexplode("words").alias("at", "word"))
    pieces = words.repartition("word").sortWithinPartitions("word").mapInArrow(pieces_of(tokenizer_path), PIECES)
    frequencies = cut.where("words is null").select("batch", "doc_id", "n_bytes", "specials", "which", "often")
    counted = frequencies.groupBy("batch").cogroup(pieces.groupBy("batch")).applyInArrow(summed, COUNTS)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
