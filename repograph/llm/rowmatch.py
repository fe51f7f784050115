"""Row pattern matching: a regular expression over the consecutive rows of each client, by a Pike machine.

Rows are dealt by ranges of (client, ts, click_id) and sorted inside the partitions, so a client with a third of all rows spans as
many tasks as its rows need.  A task streams its rows once through a Thompson NFA.  Every row may start a match of its own,
so each start has its own list of threads, in order of priority as a backtracking matcher would try them; a thread
carries the cents of its A, the sum and the labels so far.  A thread that reaches the end cuts off those below it, and the
last one that does so wins.

Where a partition ends, the starts that are still alive are handed on: as one row with their threads and the last row
seen.  Each partition also gives its head, the rows from its begin that *any* handed-on thread could consume (the machine run
from all states at once, mostly a few rows).  Rounds then join handed-on starts with the next head, until none is
left; a start goes on for as many partitions as its rows fit.

Matches are numbered by partition and client, plus the counts of the client's earlier partitions: what meets in one task is a row for
each partition of a client.

Letters: A is any row with a value; D has fewer cents than the row before it, U more, and neither is of null kind or an
error; P is a click of at least the cents of the thread's A.  D, U and P come at most ``gap`` after the row before.

Defined results: rows without client or ts are dropped; rows equal in all of COLUMNS count once; a value that is null, NaN or
infinite fits no letter; a null click_id sorts first; rows equal in client, ts and click_id go by kind of click, error or other,
then cents; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import support

COLUMNS = ("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props")
LETTERS = "ADUP"
A, D, U, P = 1, 2, 4, 8  # a row's letters as bits
CLICK, GOOD = 1, 2  # a row's kind as bits: a click, neither null nor an error
FOUND = "what string, part int, place long, client_id long, first_id long, last_id long, n_rows long, sum_cents long, labels string, state binary"
MATCHED = -1


# -- pattern --------------------------------------------------------------------------------


class Program:
    """A pattern of letters, ( ) | * + ? as Thompson's NFA; ``after[i]``: the states that follow state i, by priority."""

    def __init__(self, pattern: str):
        self.text = [c for c in pattern if not c.isspace()]
        self.at, self.code = 0, []
        self.either()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} in the pattern")
        end = len(self.code)
        self.bits = [1 << LETTERS.index(c[1]) if c[0] == "letter" else 0 for c in self.code]
        follow = lambda i: self.closure(i, end, [], set())
        self.first = follow(0)
        self.after = [follow(i + 1) if bit else [] for i, bit in enumerate(self.bits)]
        if MATCHED in self.first:
            raise ValueError("the pattern matches no rows at all")
        self.states = [i for i, bit in enumerate(self.bits) if bit]

    def either(self) -> None:
        begin = len(self.code)
        self.series()
        while self.at < len(self.text) and self.text[self.at] == "|":
            self.at += 1
            self.insert(begin, ("split", begin + 1, len(self.code) + 2))
            jump = len(self.code)
            self.code.append(None)
            self.either()
            self.code[jump] = ("jump", len(self.code))

    def series(self) -> None:
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            begin = len(self.code)
            if self.text[self.at] == "(":
                self.at += 1
                self.either()
                if self.at == len(self.text):
                    raise ValueError("a parenthesis stays open in the pattern")
            elif self.text[self.at] in LETTERS:
                self.code.append(("letter", self.text[self.at]))
            else:
                raise ValueError(f"unexpected {self.text[self.at]!r} in the pattern")
            self.at += 1
            while self.at < len(self.text) and self.text[self.at] in "*+?":
                sign, end = self.text[self.at], len(self.code)
                self.at += 1
                if sign == "+":
                    self.code.append(("split", begin, end + 1))
                else:
                    self.insert(begin, ("split", begin + 1, end + 1 + (sign == "*")))
                    if sign == "*":
                        self.code.append(("jump", begin))

    def insert(self, at: int, op: tuple) -> None:
        moved = [(c[0], *(x + (x >= at) for x in c[1:])) if c[0] != "letter" else c for c in self.code[at:]]
        self.code[at:] = [op, *moved]

    def closure(self, i: int, end: int, out: list, seen: set) -> list:
        if i not in seen:
            seen.add(i)
            if i == end:
                out.append(MATCHED)
            elif self.code[i][0] == "letter":
                out.append(i)
            else:
                for to in self.code[i][1:]:
                    self.closure(to, end, out, seen)
        return out


# -- machine --------------------------------------------------------------------------------


class Rows:
    """A run of sorted rows as arrays; ``before``: client, ts and cents of the row that precedes them, or None."""

    def __init__(self, client, ts, ids, cents, has, kind, before, gap):
        n = len(client)
        self.client, self.ts, self.ids, self.cents, self.has, self.kind = client, ts, ids, cents, has, kind
        earlier = lambda x, first: np.concatenate([np.array([first], x.dtype), x[:-1]]) if n else x
        c, t, v = before or (0, 0, None)
        self.same = earlier(client, c) == client
        if not before:
            self.same[:1] = False
        near = self.same & (ts - earlier(ts, t) <= gap) & has
        old, known = earlier(cents, v or 0), earlier(has, v is not None)
        good = near & known & (kind & GOOD > 0)
        self.fits = has * A | (good & (cents < old)) * D | (good & (cents > old)) * U | (near & (kind & CLICK > 0)) * P

    @classmethod
    def of(cls, batch: pa.RecordBatch, before, gap: int) -> Rows:
        client, ts, ids, cents, kind = (batch.column(i) for i in range(5))
        return cls(client.to_numpy(), ts.cast(pa.int64()).to_numpy(), ids.to_pylist(), cents.fill_null(0).to_numpy(), cents.is_valid().to_numpy(zero_copy_only=False), kind.to_numpy(), before, gap)

    def last(self) -> tuple:
        return int(self.client[-1]), int(self.ts[-1]), int(self.cents[-1]) if self.has[-1] else None

    def part(self, n: int) -> tuple:
        return self.client[:n], self.ts[:n], self.ids[:n], self.cents[:n], self.has[:n], self.kind[:n]


def unrolled(history) -> str:
    out = []
    while history:
        history, letter = history
        out.append(letter)
    return "".join(reversed(out))


class Machine:
    """The starts that are alive, [[place, first_id, part, best, threads]]; a thread is (state, A's cents, rows, sum, labels)."""

    def __init__(self, program: Program, part: int, place: int = 0):
        self.program, self.part, self.place = program, part, place
        self.client, self.live, self.found = None, [], []

    def end(self, start: list) -> None:
        place, first_id, part, best, _ = start
        if best:
            last_id, n, total, labels = best
            self.found.append((part, place, self.client, first_id, last_id, n, total, unrolled(labels)))

    def end_all(self) -> None:
        for start in self.live:
            self.end(start)
        self.live = []

    def step(self, start: list, fit: int, cents: int, row_id) -> bool:
        """One row for the threads of a start; False when none is left."""
        bits, after = self.program.bits, self.program.after
        threads, seen = [], set()
        for state, held, n, total, labels in start[4]:
            bit = bits[state]
            if not fit & bit or (bit == P and held is not None and cents < held):
                continue
            if bit == A:
                held = cents
            labels = (labels, LETTERS[bit.bit_length() - 1])
            for to in after[state]:
                if to == MATCHED:
                    start[3] = (row_id, n + 1, total + cents, labels)
                    start[4] = threads
                    return bool(threads)  # threads of lower priority are cut off
                if to not in seen:
                    seen.add(to)
                    threads.append((to, held, n + 1, total + cents, labels))
        start[4] = threads
        return bool(threads)

    def run(self, rows: Rows, starting: bool = True) -> None:
        """Rows that follow those of the last call."""
        program, n = self.program, len(rows.client)
        fits, cents, same, ids, clients = rows.fits.tolist(), rows.cents.tolist(), rows.same.tolist(), rows.ids, rows.client
        wanted = np.zeros(n, bool)
        if starting:
            firsts = sum({program.bits[s] for s in program.first})
            then = {to for s in program.first for to in program.after[s]}
            wanted = rows.fits & firsts > 0
            if MATCHED not in then:  # the row after must fit as well; beyond the last row it is not known
                wanted[:-1] &= rows.same[1:] & (rows.fits[1:] & sum({program.bits[s] for s in then}) > 0)
        begins, at, i = np.flatnonzero(wanted).tolist(), 0, 0
        wanted = wanted.tolist()
        fresh = [(s, None, 0, 0, None) for s in program.first]
        while i < n:
            if not self.live:
                while at < len(begins) and begins[at] < i:
                    at += 1
                if at == len(begins):
                    break
                i = begins[at]
                self.client = int(clients[i])
            elif not same[i]:
                self.end_all()
                continue
            left = []
            for start in self.live:
                if self.step(start, fits[i], cents[i], ids[i]):
                    left.append(start)
                else:
                    self.end(start)
            self.live = left
            if wanted[i]:
                start = [self.place + i, ids[i], self.part, None, fresh]
                if self.step(start, fits[i], cents[i], ids[i]):
                    self.live.append(start)
                else:
                    self.end(start)
            i += 1
        self.place += n

    def handed_on(self, before: tuple) -> bytes:
        live = [[*s[:3], s[3] and (*s[3][:3], unrolled(s[3][3])), [(*t[:4], unrolled(t[4])) for t in s[4]]] for s in self.live]
        return pickle.dumps((before, live))

    def taken_over(self, state: bytes) -> tuple:
        rolled = lambda text: (None, text) if text else None  # noqa: E731  a text stands for its letters
        before, live = pickle.loads(state)
        self.client = before[0]
        self.live = [[*s[:3], s[3] and (*s[3][:3], rolled(s[3][3])), [(*t[:4], rolled(t[4])) for t in s[4]]] for s in live]
        return before


class Head:
    """The rows from a partition's begin that a thread in any state could consume, and the one that ends the last of them."""

    def __init__(self, program: Program):
        self.program, self.states, self.rows = program, set(program.states), []

    def see(self, rows: Rows) -> None:
        n = 0
        while self.states and n < len(rows.client):
            fit = int(rows.fits[n])
            if not self.rows and not n:  # the row before is in another partition: all that the row itself allows
                fit = int(rows.has[0]) * (A | (D | U) * int(rows.kind[0] & GOOD > 0) | P * int(rows.kind[0] & CLICK > 0))
            elif not rows.same[n]:
                fit = 0
            self.states = {to for s in self.states if fit & self.program.bits[s] for to in self.program.after[s]} - {MATCHED}
            n += 1
        if n:
            self.rows.append(rows.part(n))

    def packed(self) -> bytes:
        """The rows, and whether all threads end in them."""
        columns = [np.concatenate(x) if isinstance(x[0], np.ndarray) else sum(x, []) for x in zip(*self.rows)]
        return pickle.dumps((columns, not self.states))


def found_batch(matches: list[tuple], more: list[tuple]) -> pa.RecordBatch:
    """Matches, and (what, part, state) rows."""
    rows = [("match", *m, None) for m in matches] + [(what, part, None, None, None, None, None, None, None, state) for what, part, state in more]
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary()]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in FOUND.split(", ")])


def first_pass(pattern: str, gap: int):
    """A mapInArrow function over sorted rows: the matches that end in the partition, its head, and the starts it hands on."""

    def task(batches):
        program, part, before = Program(pattern), TaskContext.get().partitionId(), None
        machine, head = Machine(program, part), Head(program)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = Rows.of(batch, before, gap)
            head.see(rows)
            machine.run(rows)
            before = rows.last()
            if machine.found:
                yield found_batch(machine.found, [])
                machine.found = []
        if before:
            yield found_batch([], [("head", part, head.packed()), *([("open", part + 1, machine.handed_on(before))] if machine.live else [])])

    return task


def next_pass(pattern: str, gap: int, last_part: int):
    """A mapInArrow function: part, state of handed-on starts, head of the partition (or null) -> matches and what is handed on again."""

    def task(batches):
        program = Program(pattern)
        for batch in batches:
            for part, state, head in zip(*(batch.column(i).to_pylist() for i in range(3))):
                machine = Machine(program, part)
                before = machine.taken_over(state)
                whole = part > last_part
                if head is not None:
                    columns, whole = pickle.loads(head)
                    rows = Rows(*columns, before, gap)
                    machine.run(rows, starting=False)
                    before = rows.last()
                if whole:
                    machine.end_all()
                yield found_batch(machine.found, [("open", part + 1, machine.handed_on(before))] if machine.live else [])

    return task


def sorted_rows(clicks: DataFrame) -> DataFrame:
    """client_id, ts, click_id, cents and kind bits of the distinct rows, by ranges and sorted inside them."""
    plain, *columns = support.pick(clicks, *COLUMNS)
    rows = plain.select(*columns).where("client_id is not null and ts is not null")
    rest = ["arrived_at", "kind", "value", "props"]
    others = F.xxhash64(*rest, *[F.col(c).isNull() for c in rest])  # tells rows of one client, ts and click_id apart
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    cents = F.when(finite, F.floor(F.lit(100.0) * F.col("value") + F.lit(0.5)).cast("long"))
    good = F.coalesce(F.col("kind") != "error", F.lit(False))
    kind = F.coalesce((F.col("kind") == "click").cast("int"), F.lit(0)) * CLICK + good.cast("int") * GOOD
    narrow = rows.select(F.col("client_id").cast("long"), "ts", F.col("click_id").cast("long"), cents.alias("cents"), kind.cast("long").alias("kind"), others.alias("others"))
    order = ["client_id", "ts", "click_id", "kind", "cents"]
    return narrow.distinct().drop("others").repartitionByRange("client_id", "ts", "click_id").sortWithinPartitions(*order).select("client_id", "ts", "click_id", "cents", "kind")


def match(clicks: DataFrame, pattern: str = "A D+ U+ P", gap_seconds: int = 300) -> DataFrame:
    """client_id, match_no, first_id, last_id, n_rows, sum_cents and labels (a letter for each row) of each match."""
    support.ready(clicks.sparkSession)
    Program(pattern)
    gap = gap_seconds * 1_000_000
    first = support.table(sorted_rows(clicks).mapInArrow(first_pass(pattern, gap), FOUND), "rowmatch")
    heads = first.where("what = 'head'").select("part", F.col("state").alias("head"))
    last_part = heads.agg(F.max("part")).first()[0]
    found, opened = [first.where("what = 'match'")], first.where("what = 'open'")
    while last_part is not None and opened.limit(1).count():
        again = opened.select("part", "state").join(heads.hint("merge"), "part", "left").mapInArrow(next_pass(pattern, gap, last_part), FOUND)
        again = support.table(again, "rowmatch")
        found.append(again.where("what = 'match'"))
        opened = again.where("what = 'open'")
    matches = found[0]
    for more in found[1:]:
        matches = matches.unionByName(more)
    own = ["client_id", "part"]
    placed = matches.withColumn("own", F.row_number().over(Window.partitionBy(*own).orderBy("place")))
    counts = matches.groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(*own, (F.sum("n").over(Window.partitionBy("client_id").orderBy("part")) - F.col("n")).alias("before"))
    numbers = placed.join(before.hint("merge"), own)  # dealt and sorted alike; never broadcast, as it grows with the clients
    return numbers.select("client_id", (F.col("before") + F.col("own")).alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", "labels")
