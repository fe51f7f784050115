import datetime as dt
import math
import random

import pytest

from repograph.llm import rowmatch

SCHEMA = "click_id long, ts timestamp, arrived_at timestamp, client_id long, kind string, value double, props string"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def cut_small(spark):
    """Many partitions, none merged, so that matches go across them."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def ways(tree, k, fits):
    """Ends of all ways in which a pattern matches from row k, in the order in which a backtracking matcher tries them."""
    op = tree[0]
    if op == "letter":
        if fits(tree[1], k):
            yield k + 1, tree[1]
    elif op == "then":
        for mid, a in ways(tree[1], k, fits):
            for end, b in ways(tree[2], mid, fits):
                yield end, a + b
    elif op == "or":
        yield from ways(tree[1], k, fits)
        yield from ways(tree[2], k, fits)
    elif op == "some":  # one or more, greedy
        for mid, a in ways(tree[1], k, fits):
            for end, b in ways(tree, mid, fits):
                yield end, a + b
            yield mid, a
    elif op == "maybe":
        yield from ways(tree[1], k, fits)
        yield k, ""


L = {c: ("letter", c) for c in "ADUP"}
PATTERNS = {
    "A D+ U+ P": ("then", L["A"], ("then", ("some", L["D"]), ("then", ("some", L["U"]), L["P"]))),
    "A (D|U)* P": ("then", L["A"], ("then", ("maybe", ("some", ("or", L["D"], L["U"]))), L["P"])),
    "A D? (U P|P)+": ("then", L["A"], ("then", ("maybe", L["D"]), ("some", ("or", ("then", L["U"], L["P"]), L["P"])))),
    "(A D)+ U?": ("then", ("some", ("then", L["A"], L["D"])), ("maybe", L["U"])),
    "A": L["A"],
}


def plain(rows, tree):
    clients = {}
    for r in set(rows):
        if r[3] is not None and r[1] is not None:
            clients.setdefault(r[3], []).append(r)
    out = []
    for client, own in clients.items():
        own.sort(key=lambda r: (r[1], r[0] is not None, r[0] or 0))
        cents = [None if r[5] is None or not math.isfinite(r[5]) else math.floor(100 * r[5] + 0.5) for r in own]
        found = 0
        for i in range(len(own)):

            def fits(letter, k, i=i):
                if k >= len(own) or cents[k] is None:
                    return False
                if letter == "A":
                    return True
                if k == 0 or own[k][1] - own[k - 1][1] > dt.timedelta(minutes=5):
                    return False
                kind = own[k][4]
                if letter == "P":
                    return kind == "click" and cents[k] >= cents[i]
                if kind in (None, "error") or cents[k - 1] is None:
                    return False
                return cents[k] < cents[k - 1] if letter == "D" else cents[k] > cents[k - 1]

            for end, labels in ways(tree, i, fits):
                found += 1
                out.append((client, found, own[i][0], own[end - 1][0], end - i, sum(cents[i:end]), labels))
                break
    return sorted(out)


def rows_at_random(seed, n=900, clients=(1, 1, 1, 2, 3, None)):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 0, 1, 1, 5, 5, 30, 60, 100, 300, 301]) * 1_000_000 + rng.choice([0, 0, 1])
        value = rng.choice([None, 1.0, 2.0, 2.004, 2.005, 3.0, 4.0, 5.5, -1.0, float("nan"), float("inf")])
        kind = rng.choice(["click", "click", "view", "purchase", "error", None])
        rows.append((i, T0 + dt.timedelta(microseconds=at), None, rng.choice(clients), kind, value, "{}"))
    rows += rng.sample(rows, 50)  # repeated
    rows += [(n + 1, None, None, 1, "click", 1.0, None)]
    return rows


def got(spark, rows, pattern):
    return sorted(map(tuple, rowmatch.match(spark.createDataFrame(rows, SCHEMA).repartition(5), pattern).collect()))


@pytest.mark.parametrize("pattern", PATTERNS)
def test_equals_backtracking(spark, cut_small, pattern):
    for seed in (1, 2):
        rows = rows_at_random(seed, clients=(1, 1, 1, 2, 3, None) if seed == 1 else (1,))
        expected = plain(rows, PATTERNS[pattern])
        assert expected
        assert got(spark, rows, pattern) == expected


def test_matches_across_many_partitions(spark, cut_small):
    """One client whose runs of D and U are longer than partitions, beside short ones."""
    values = [500.0 - i for i in range(120)] + [380.0 + 2 * i for i in range(90)] + [1.0, 0.5, 3.0, 700.0, 0.1]
    rows = [(i, T0 + dt.timedelta(seconds=i), None, 7, "click" if i % 3 else "view", v, "{}") for i, v in enumerate(values)]
    rows += [(1000 + i, T0 + dt.timedelta(seconds=i), None, c, "click", v, "{}") for c in (1, 9) for i, v in enumerate([3.0, 2.0, 5.0, 6.0])]
    assert got(spark, rows, "A D+ U+ P") == plain(rows, PATTERNS["A D+ U+ P"])


def test_ties_nulls_and_empty_tables(spark):
    assert got(spark, [], "A D+ U+ P") == []
    same = [(i, T0, None, 1, "click", v, "{}") for i, v in enumerate([3.0, 2.0, 3.0, 9.0])]
    assert got(spark, same + same, "A D+ U+ P") == [(1, 1, 0, 3, 4, 1700, "ADUP")]
    twins = [(5, T0, None, 1, "view", 2.0, "{}"), (5, T0, None, 1, "view", 2.0, None), (5, T0, T0, 1, "view", 2.0, "{}")]
    assert len(got(spark, twins, "A")) == 3  # rows that differ in any column are rows of their own
    assert got(spark, [(None, None, None, None, None, None, None)], "A") == []


def test_clashing_names_and_wrong_patterns(spark):
    df = spark.createDataFrame([(i, T0, None, 1, "click", v, "{}") for i, v in enumerate([3.0, 2.0, 3.0, 9.0])], SCHEMA)
    wide = df.selectExpr("'x' as what", "1 as part", "'y' as `a.b`", "*", "2 as place", "3 as cents", "4 as others")
    assert [tuple(r) for r in rowmatch.match(wide).collect()] == [(1, 1, 0, 3, 4, 1700, "ADUP")]
    for wrong in ("", "A (", "A )", "X", "D*", "* A"):
        with pytest.raises(ValueError):
            rowmatch.Program(wrong)
