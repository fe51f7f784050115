"""Mixture-controlled packing: deficit round-robin over source queues into fixed-length sequences.

Every source is a queue of its documents' tokens.  A window of ``window`` sequences is filled to
the target token proportions: each queue is owed its share of the window, the queue with the
largest deficit in proportion to its share is served next, and what rounding leaves is carried to
the next window.  Served one token at a time, that is Webster's divisor sequence, so the number of
tokens that each queue has given before any window has a closed form (``served``): a task works out
the deficits that all earlier windows and partitions carry to it without seeing them.  Inside a
window each queue's tokens lie together, and the queue that comes first moves on by one from
window to window.  Targets are weights by source; without any they are the queues' shares of all tokens, so every
queue lasts to the end.  With others a queue may run out: from there on the rest share its part by their own weights
(a phase), and sources without a target come last, by their shares.  No token is left over and only
the last sequence is short, whatever the targets.

Beyond ``MAX_QUEUES`` sources the queues are buckets of sources, and each bucket's tokens are served from its own
sources by the same rule, so every source keeps its share.

The plan tokenises once into a table of ids in the shared folder, sums tokens by (queue, partition),
and turns each document's place in its queue into pieces where it lies; token ids are never shuffled.

Defined results: a null text is empty (one token, the end id); a null source is a queue of its own;
repeated rows and null ids are packed like any others; a table without rows gives no rows; other columns are
ignored.  More than ``MOST_SOURCES`` sources, or targets for more than ``MAX_QUEUES``, raise an error.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import support
from .bytelevel import encoder

MAX_QUEUES = 4096
MOST_SOURCES = 1_000_000  # whose totals, some 50 MB, are sent to the tasks
FEW_BASES = 200_000
HELD = 1 << 21  # places of queues in windows that a task holds

TOKENS = "doc_id long, queue string, block int, start long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(path: str, end_id: int):
    """A mapInArrow function: doc_id, text, queue -> the document's ids and its place in its queue's part of this partition."""

    def task(batches):
        encode, block, at = encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc_id, text, queue in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                stored = ids.astype("<u2") if ids.max() < 65_536 else ids
                for held, x in zip(rows, (doc_id, queue, at.get(queue, 0), len(ids), stored.tobytes())):
                    held.append(x)
                at[queue] = at.get(queue, 0) + len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array([block] * len(rows[0]), pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())], ["doc_id", "queue", "block", "start", "n_tokens", "ids"])

    return task


def served(taken: int, totals: list[int]) -> list[int]:
    """How many of the first ``taken`` tokens each queue has given: the ``taken`` least keys (2j + 1) / (2 * total).

    j counts a queue's tokens from 0; equal keys go to the earlier queue.  Exact in integers.
    """
    everything = sum(totals)
    if not everything:
        return [0] * len(totals)
    given = [min(t, (2 * taken * t + everything) // (2 * everything)) for t in totals]
    over = sum(given) - taken

    def key(j: int, q: int):
        return Ratio(2 * j + 1, totals[q]), q

    if over > 0:
        heap = [Last(*key(given[q] - 1, q)) for q in range(len(totals)) if given[q]]
        heapq.heapify(heap)
        while over > 0:
            q = heap[0].queue
            given[q] -= 1
            over -= 1
            if given[q]:
                heapq.heapreplace(heap, Last(*key(given[q] - 1, q)))
            else:
                heapq.heappop(heap)
    if over < 0:
        heap = [(*key(given[q], q),) for q in range(len(totals)) if given[q] < totals[q]]
        heapq.heapify(heap)
        while over < 0:
            _, q = heapq.heappop(heap)
            given[q] += 1
            over += 1
            if given[q] < totals[q]:
                heapq.heappush(heap, (*key(given[q], q),))
    return given


@functools.total_ordering
class Ratio:
    """An exact fraction that only knows how to be compared."""

    __slots__ = ("over", "under")

    def __init__(self, over: int, under: int):
        self.over, self.under = over, under

    def __eq__(self, other):
        return self.over * other.under == other.over * self.under

    def __lt__(self, other):
        return self.over * other.under < other.over * self.under


class Last:
    """A key in a heap that gives the greatest first."""

    __slots__ = ("ratio", "queue")

    def __init__(self, ratio: Ratio, queue: int):
        self.ratio, self.queue = ratio, queue

    def __lt__(self, other):
        return (other.ratio, other.queue) < (self.ratio, self.queue)


def phases(totals: list[int], weights: list[int]) -> list[tuple[int, list[int], list[int]]]:
    """(first token, tokens given before it, weights) of each phase; a phase ends where a queue would be served that has run out."""
    everything, rest, begin, out = sum(totals), list(totals), 0, []
    while sum(rest):
        live = [w * (everything + 1) if r else 0 for w, r in zip(weights, rest)]
        given = [t - r for t, r in zip(totals, rest)]
        if not any(live):
            return [*out, (begin, given, rest)]
        out.append((begin, given, live))
        fits = lambda n: all(a <= r for a, r in zip(served(n, live), rest))  # noqa: B023, E731
        most = bisect.bisect_left(range(sum(r for r, w in zip(rest, live) if w)), True, key=lambda n: not fits(n + 1))
        rest = [r - a for r, a in zip(rest, served(most, live))]
        begin += most
    return out


class Layout:
    """Where the tokens of each queue lie."""

    def __init__(self, totals: list[int], sequence: int, window: int, weights: list[int] | None = None, within: tuple | None = None):
        """``within`` is the layout and the queue that these queues are in: their windows are its share of each window there."""
        self.totals, self.all, self.sequence, self.tokens, self.within = totals, sum(totals), sequence, sequence * window, within
        self.phases = phases(totals, weights) if weights else [(0, [0] * len(totals), totals)]
        self.natural = not weights and not within
        self.windows = within[0].windows if within else -(-self.all // self.tokens)
        held = max(4, min(4096, HELD // max(len(totals), 1)))
        self.window = functools.lru_cache(held)(self._window)
        self.before = functools.lru_cache(held)(self._before)

    def taken(self, i: int) -> int:
        """How many tokens lie before window i."""
        return self.within[0].before(i)[self.within[1]] if self.within else min(i * self.tokens, self.all)

    def _before(self, i: int) -> list[int]:
        """How many tokens each queue has given before window i."""
        taken = self.taken(i)
        begin, given, weights = self.phases[bisect.bisect_right(self.phases, taken, key=lambda p: p[0]) - 1]
        return [a + b for a, b in zip(given, served(taken - begin, weights))]

    def window_of(self, q: int, token: int) -> int:
        """The window with a token of a queue, or one before it."""
        if self.natural:
            i = token * self.all // (self.totals[q] * self.tokens)
            while i and self.before(i)[q] > token:
                i -= 1
            return i
        return bisect.bisect_right(range(self.windows + 1), token, key=lambda i: self.before(i)[q]) - 1

    def _window(self, i: int) -> tuple[list[int], list[int], list[int]]:
        """Of window i: the first token of each queue, the one behind its last, and the first's place."""
        first, behind, n = self.before(i), self.before(i + 1), len(self.totals)
        place, at = [0] * n, self.taken(i)
        for step in range(n):
            q = (i + step) % n
            place[q] = at
            at += behind[q] - first[q]
        return first, behind, place

    def pieces(self, q: int, start: int, n: int):
        """(start within the run, length, place) of a run of n tokens from token ``start`` of queue q."""
        i, at, end = self.window_of(q, start), start, start + n
        while at < end:
            first, behind, place = self.window(i)
            if behind[q] <= at:
                i += 1
                continue
            spot = place[q] + at - first[q]
            length = min(end, behind[q], *[at + self.sequence - spot % self.sequence] * (not self.within)) - at
            yield at - start, length, spot
            at += length


class Mixture:
    """The layout of all sources: one level of queues, or buckets of sources where there are many."""

    def __init__(self, totals: dict[str, int], sequence: int, window: int, weights: dict[str, int] | None = None):
        buckets = [[q] for q in totals] if len(totals) <= MAX_QUEUES else [[] for _ in range(MAX_QUEUES)]
        if len(totals) > MAX_QUEUES:
            for q in totals:
                buckets[zlib.crc32(q.encode()) % MAX_QUEUES].append(q)
            buckets = [b for b in buckets if b]
        self.places = {q: (i, j) for i, bucket in enumerate(buckets) for j, q in enumerate(bucket)}
        self.top = Layout([sum(totals[q] for q in b) for b in buckets], sequence, window, weights and [sum(weights.get(q, 0) for q in b) for b in buckets])
        self.inner = [Layout([totals[q] for q in b], sequence, window, within=(self.top, i)) if len(b) > 1 else None for i, b in enumerate(buckets)]

    def pieces(self, queue: str, start: int, n: int):
        """(start within the run, length, place) of a run of n tokens from token ``start`` of a source."""
        i, j = self.places[queue]
        if self.inner[i] is None:
            yield from self.top.pieces(i, start, n)
            return
        for at, length, spot in self.inner[i].pieces(j, start, n):
            for begin, part, place in self.top.pieces(i, spot, length):
                yield at + begin, part, place


def packed(sent, sequence: int, window: int):
    """A mapInArrow function: documents with their place in their queue -> pieces; sent: the broadcast totals and weights."""

    def task(batches):
        layout = Mixture(sent.value[0], sequence, window, sent.value[1])
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            rows = [[] for _ in names]
            for doc_id, queue, start, n, stored in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ids = np.frombuffer(stored, "<u2" if len(stored) == 2 * n else "<u4").astype("<u4").data.cast("B")
                for at, length, spot in layout.pieces(queue, start, n):
                    for held, x in zip(rows, (doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, spot // sequence, spot % sequence)):
                        held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names)

    return task


def queue_of(source: str | None) -> str:
    return "null" if source is None else f"={source}"


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = 1024, window: int | None = None, end_id: int = 0, source_col: str = "source", targets: dict[str | None, int] | None = None) -> DataFrame:
    """One row for each piece of a document in a sequence.  ``targets`` are whole weights by source (None: the null source).

    ``window`` is in sequences.  If not given it is 64, or as many as there are sources if these are more: a source then has a sequence
    of each window on average, so documents lie in few pieces and a window costs the same for each of its tokens.
    """
    spark = support.ready(docs.sparkSession)
    text, source = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col(source_col).cast("string")
    queue = F.coalesce(F.concat(F.lit("="), source), F.lit("null"))
    tokens = support.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), queue.alias("queue")).mapInArrow(tokenised(tokenizer_path, end_id), TOKENS), "tokens")
    sums = support.cut(tokens.groupBy("queue", "block").agg(F.sum("n_tokens").alias("n")))
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").limit(MOST_SOURCES + 1).collect()}
    if len(totals) > (MAX_QUEUES if targets else MOST_SOURCES):
        raise ValueError(f"{len(totals)} sources or more are beyond what can be mixed{' by targets' if targets else ''}")
    window = window or max(64, len(totals))
    weights = {queue_of(s): w for s, w in targets.items()} if targets else None
    before = W.partitionBy("queue").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("queue", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if sums.count() <= FEW_BASES else bases
    placed = tokens.join(bases, ["queue", "block"]).select("doc_id", "queue", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")
    return placed.mapInArrow(packed(spark.sparkContext.broadcast((totals, weights)), sequence, window), PIECES)
