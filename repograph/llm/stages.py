"""The operators as stages of a corpus pipeline: documents in, documents out.

Columns may have any names, such as ones that differ from ``text`` in case only or that clash with names used here: every
stage works on columns by position and gives the names back at its end.  ``doc_id``, ``text``, ``source`` and ``n_chars`` are the
columns of exactly these names, or where there is none the first that differs in case only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing, quality, secrets, setjoin, support


def by_position(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The documents as columns c0, c1, ..., but the named ones under their names; and the columns in order."""
    places = support.places(docs, *names)
    own = [next((n for n, at in zip(names, places) if at == i), f"c{i}") for i in range(len(docs.columns))]
    return docs.toDF(*own), own


def back(kept: DataFrame, own: list[str], docs: DataFrame) -> DataFrame:
    return kept.select(*own).toDF(*docs.columns)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose quality score reaches the threshold.

    Nulls and empty texts are scored as empty; each row, repeated or not, is judged by its own text; without labels of both
    kinds all have the labels' share as score; a table without rows gives no rows; all columns are returned as they
    came, of any name.
    """
    rows, own = by_position(docs, "doc_id", "text")
    marked, _ = by_position(labels, "doc_id", "quality")
    scored = quality.score(rows, quality.fit(rows, marked.select("doc_id", "quality")), keep=own, name="score")
    return back(scored.where(F.col("score") >= threshold), own, docs)


def keep_one_of_each(docs: DataFrame, rule: setjoin.Rule = setjoin.Rule(width=5, num=80, den=100)) -> DataFrame:
    """One document of each group of near copies: the one of the least id, of equal ids that of the least digest.

    A document is a row: rows that repeat a doc_id with other texts have groups of their own, and of rows that repeat
    both id and text one stays, the one whose other columns come first as JSON text.  Documents without words, text or id
    have no group and stay, repeated or not; a table without rows gives no rows; all columns are returned as they came, of any name.
    """
    support.ready(docs.sparkSession)
    rows, own = by_position(docs, "doc_id", "text")
    key = ["id", "digest"]
    marked = rows.select(*own, F.col("doc_id").cast("long").alias("id"), setjoin.digest_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"))
    plain = setjoin.standardised(rows)
    gone = setjoin.later_members(plain, rule).select(F.col("doc_id").alias("id"), "digest")
    kept = marked.join(setjoin.few(gone), key, "left_anti")
    worded = plain.where("doc_id is not null").where(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0)
    twice = support.cut(worded.select(F.col("doc_id").alias("id"), setjoin.digest_of("text").alias("digest")).groupBy(*key).count().where("count > 1").select(*key))
    if twice.limit(1).count():
        twice, whole = setjoin.few(twice), F.struct(*own)
        one = kept.join(twice, key, "left_semi").groupBy(*key).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
        kept = kept.join(twice, key, "left_anti").select(*own).unionByName(one.select("row.*"))
    return back(kept, own, docs)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every secret of their text replaced.

    Every row stays, repeated or not; a null text stays null and an empty one empty; n_chars, where there is one, is the
    length of the new text; a table without rows gives no rows; other columns are returned as they came, of any name.
    """
    sized = any(c.lower() == "n_chars" for c in docs.columns)
    rows, own = by_position(docs, "text", *["n_chars"] * sized)
    return back(secrets.redact(rows), own, docs)


def packed(docs: DataFrame, tokenizer_path: str, sequence: int = 1024) -> DataFrame:
    """Where each piece of each document lies in the packed sequences.

    A null or empty text is the end id alone; a null source is a source of its own; repeated rows and null ids are packed
    like any others; a table without rows gives no rows; other columns are ignored, whatever their names.
    """
    rows, _ = by_position(docs, "doc_id", "text", "source")
    return packing.pack(rows.select("doc_id", "text", "source"), tokenizer_path, sequence=sequence)
