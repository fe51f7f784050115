"""Exact top-k search by inner product over vector-approximation files.

``approximate`` writes the file once: a row for each block of vectors, with the block's cells of
``bits`` bits a dimension, their edges, and the exact vectors in a column of their own.  The first
scan reads cells only: their lower bounds (two matrix products over the cells' edges) give, for
each query, a score that k rows are sure to reach.  The second takes the upper bounds the same
way; of the rows whose bound reaches that score it takes exact vectors in the order of their
bounds until the k-th exact score is above every bound that is left, so the answer is exact.
Candidates are never shuffled: their exact vectors lie in the same row of the file.

Within a block, equal vectors are kept once for each of the k + 1 least ids that have them (and k
rows of one id), as no others can be in a result; so a group of very many copies stays small.

Queries are handed to the tasks in blocks of at most ``query_block`` vectors, so what is
broadcast has a bound that does not grow with the data; both scans run once for each such block.
Each task returns k rows a query and a window keeps the best k of those.

Defined results:

* vectors that are null, or hold null, NaN or infinite components, take no part, nor do rows without id;
* only vectors of equal length are compared; empty vectors score 0 with each other;
* rows that repeat an id are candidates of their own, but never candidates of that id's query;
  an id that repeats among the queries is answered once, for its smallest vector;
* ties go to the smaller id; a table without rows gives no rows; other columns are ignored;
* scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import support

SCHEMA = "query_id long, vec_id long, score long"
FILE = "size int, ids binary, edges binary, cells binary, exact binary"
BLOCK = 4096


def integer_vectors(ids: pa.Array, vectors: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the ids and floor(scale * x) of the rows that take part."""
    if isinstance(ids, pa.ChunkedArray):
        ids, vectors = ids.combine_chunks(), vectors.combine_chunks()
    keep = np.asarray(ids.is_valid()) & np.asarray(vectors.is_valid())
    ids, vectors = ids.filter(pa.array(keep)), vectors.filter(pa.array(keep))
    offsets = np.asarray(vectors.offsets)
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    ids, sizes, starts = ids.to_numpy(zero_copy_only=False), np.diff(offsets), offsets[:-1]
    found = {}
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        matrix = flat[starts[rows][:, None] + np.arange(size)[None, :]]
        finite = np.isfinite(matrix).all(axis=1)
        found[int(size)] = ids[rows][finite], np.floor(scale * matrix[finite]).astype(np.int64)
    return found


def needed(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The rows that some query's k best may hold: of equal vectors k + 1 ids, of one id k rows."""
    if vectors.shape[1]:
        whole = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
        group = np.unique(whole, return_inverse=True)[1].ravel()
    else:
        group = np.zeros(len(ids), np.int64)
    order = np.lexsort((ids, group))
    group, ids = group[order], ids[order]
    first = np.r_[True, group[1:] != group[:-1]]
    new = first | np.r_[True, ids[1:] != ids[:-1]]
    place, nth = np.arange(len(ids)), np.cumsum(new)
    nth -= np.maximum.accumulate(np.where(first, nth, 0))
    copy = place - np.maximum.accumulate(np.where(new, place, 0))
    return np.sort(order[(nth <= k) & (copy < k)])


def block_row(ids: np.ndarray, vectors: np.ndarray, bits: int) -> tuple:
    """A row of the file: size, ids, edges (low, width, high), cells and exact vectors in as few bytes as hold them."""
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    width = np.maximum(1, -(-(high - low + 1) // (1 << bits)))
    cells = ((vectors - low) // width).astype(np.uint8 if bits <= 8 else np.uint16)
    kind = next(t for t in (np.int16, np.int32, np.int64) if not vectors.size or np.iinfo(t).min <= low.min() and high.max() <= np.iinfo(t).max)
    return vectors.shape[1], ids.astype(np.int64).tobytes(), np.stack([low, width, high]).tobytes(), cells.tobytes(), vectors.astype(kind).tobytes()


def approximate(rows: DataFrame, k: int, scale: float, bits: int) -> DataFrame:
    """The file of vec_id, embedding, written to the shared folder."""

    def task(batches):
        for batch in batches:
            found = []
            for ids, vectors in integer_vectors(batch.column(0), batch.column(1), scale).values():
                for at in range(0, len(ids), BLOCK):
                    keep = at + needed(ids[at : at + BLOCK], vectors[at : at + BLOCK], k)
                    found.append(block_row(ids[keep], vectors[keep], bits))
            if found:
                kinds = [pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), kinds)], [x.split()[0] for x in FILE.split(", ")])

    return support.table(rows.select("vec_id", "embedding").mapInArrow(task, FILE), "vafile")


class Approximation:
    """The ids and cells of a block, and the bounds of inner products that they give."""

    def __init__(self, size: int, ids: bytes, edges: bytes, cells: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.low, self.width, self.high = np.frombuffer(edges, np.int64).reshape(3, size)
        n = len(self.ids)
        self.cells = np.frombuffer(cells, np.uint16 if size and len(cells) == 2 * n * size else np.uint8).reshape(n, size)
        floor = self.low + self.cells.astype(np.int64) * self.width
        self.ceiling = np.minimum(floor + self.width - 1, self.high).astype(np.float64).T
        self.floor = floor.astype(np.float64).T

    def slack(self, queries: np.ndarray) -> float:
        most = float(np.abs(queries).max(initial=0)) * float(max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0))) * max(1, queries.shape[1])
        return most * 1e-9 if most > 2**52 else 0.0  # below that, doubles hold these sums exactly

    def lower(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0).astype(np.float64) @ self.floor + np.minimum(queries, 0).astype(np.float64) @ self.ceiling - self.slack(queries)

    def upper(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0).astype(np.float64) @ self.ceiling + np.minimum(queries, 0).astype(np.float64) @ self.floor + self.slack(queries)

    def exact(self, stored: bytes) -> np.ndarray:
        n, size = self.cells.shape
        return np.frombuffer(stored, {2: np.int16, 4: np.int32, 8: np.int64}[len(stored) // (n * size)] if n * size else np.int64).reshape(n, size)


class Best:
    """The k best of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n

    def worst(self, q: int) -> float:
        return float(self.scores[q][-1]) if len(self.scores[q]) >= self.k else -np.inf

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]


def bounded(bound, query_ids: np.ndarray, queries: np.ndarray, block: Approximation, step: int = 256):
    """Some queries at a time: where they begin and their bounds of all rows, minus infinity for rows of the query's own id."""
    own = np.searchsorted(query_ids, block.ids)
    rows = np.flatnonzero(query_ids[np.minimum(own, len(query_ids) - 1)] == block.ids)
    own = own[rows]
    for at in range(0, len(query_ids), step):
        found = bound(queries[at : at + step])
        here = (own >= at) & (own < at + step)
        found[own[here] - at, rows[here]] = -np.inf
        yield at, found


def sure_scores(sure: np.ndarray, query_ids, queries, block: Approximation) -> None:
    """Bring the k greatest lower bounds of each query up to date with a block."""
    k = sure.shape[1]
    for at, lower in bounded(block.lower, query_ids, queries, block):
        both = np.concatenate([sure[at : at + len(lower)], lower], axis=1)
        sure[at : at + len(lower)] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]


def read_in_order(best: Best, sure: np.ndarray, query_ids, queries, block: Approximation, vectors: np.ndarray, read: int = 32) -> None:
    """Exact scores of a block's rows whose upper bound reaches the score that k rows are sure of, the highest bounds first."""
    for at, upper in bounded(block.upper, query_ids, queries, block):
        least = np.maximum(sure[at : at + len(upper)], [best.worst(at + i) for i in range(len(upper))])
        reach = (upper >= least[:, None]) & (upper > -np.inf)
        for i in np.flatnonzero(reach.any(axis=1)):
            near = np.flatnonzero(reach[i])
            near = near[np.argsort(-upper[i][near], kind="stable")]
            for j in range(0, len(near), read):
                if upper[i][near[j]] < best.worst(at + i):
                    break
                rows = near[j : j + read]
                best.add(at + i, block.ids[rows], vectors[rows].astype(np.int64) @ queries[at + i])


def topk(data: DataFrame, is_query, k: int = 5, scale: float = 256.0, bits: int = 6, query_block: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of the greatest integer inner product for each row that ``is_query`` (a column) marks.

    Returns query_id, rank (from 1), vec_id and score.
    """
    spark = support.ready(data.sparkSession)
    rows = data.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"), is_query.alias("asks")).where("vec_id is not null and embedding is not null")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    able = rows.where("asks").where(finite)  # of rows that repeat an id and a length the least vector asks, chosen in the plan
    asked = able.groupBy("vec_id", F.size("embedding").alias("size")).agg(F.min_by("embedding", whole).alias("embedding")).select("vec_id", "embedding")
    blocks = max(1, -(-asked.count() // query_block))
    file, parts = approximate(rows, k, scale, bits), []
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        got = some.toArrow()
        block = {}
        for size, (ids, vectors) in integer_vectors(got["vec_id"], got["embedding"], scale).items():
            order = np.lexsort((*vectors.T[::-1], ids)) if size else np.argsort(ids, kind="stable")
            ids, vectors = ids[order], vectors[order]
            first = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.empty(0, bool)
            if len(ids):
                block[size] = ids[first], vectors[first]
        if block:
            parts.append(support.cut(answers(file, block, k), scans=True))
    support.remove(file)
    found = parts[0] if parts else spark.createDataFrame([], SCHEMA)
    for more in parts[1:]:
        found = found.unionAll(more)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def answers(file: DataFrame, block: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """query_id, vec_id, score: from each task the k best of the queries, which are given by length."""
    context = file.sparkSession.sparkContext
    sent = context.broadcast(block)

    def sure_of(batches):
        sure = {size: np.full((len(ids), k), -np.inf) for size, (ids, _) in sent.value.items()}
        for batch in batches:
            for size, *stored in zip(*(c.to_pylist() for c in batch.columns)):
                sure_scores(sure[size], *sent.value[size], Approximation(size, *stored))
        for size, (ids, _) in sent.value.items():
            query, _ = np.nonzero(sure[size] > -np.inf)
            if len(query):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(query), size, np.int32)), pa.array(ids[query]), pa.array(sure[size][sure[size] > -np.inf])], ["size", "query_id", "lower"])

    mine = file.where(F.col("size").isin([int(x) for x in block]))
    lowest = mine.select("size", "ids", "edges", "cells").mapInArrow(sure_of, "size int, query_id long, lower double")
    place = F.row_number().over(W.partitionBy("size", "query_id").orderBy(F.desc("lower")))
    reached = lowest.withColumn("place", place).where(F.col("place") == k).select("size", "query_id", "lower").toArrow()
    sizes, queries, lower = (reached[c].to_numpy() for c in ("size", "query_id", "lower"))
    sure = {size: np.full(len(ids), -np.inf) for size, (ids, _) in block.items()}
    for size, (ids, _) in block.items():
        sure[size][np.searchsorted(ids, queries[sizes == size])] = lower[sizes == size]
    sure_sent = context.broadcast(sure)

    def read(batches):
        best = {size: Best(len(ids), k) for size, (ids, _) in sent.value.items()}
        for batch in batches:
            for size, *stored, exact in zip(*(c.to_pylist() for c in batch.columns)):
                cells = Approximation(size, *stored)
                read_in_order(best[size], sure_sent.value[size], *sent.value[size], cells, cells.exact(exact))
        for size, (ids, _) in sent.value.items():
            counts = [len(x) for x in best[size].ids]
            if sum(counts):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.concatenate(best[size].ids)), pa.array(np.concatenate(best[size].scores))], ["query_id", "vec_id", "score"])

    return mine.mapInArrow(read, SCHEMA)
