import random

from pyspark.sql import functions as F

from repograph.operators import ordering


def test_numbers_in_a_global_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "hot", "hot", "b"]), rng.randint(0, 40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "team string, score int, id int").repartition(7)
    order = [F.col("score").desc(), F.col("id").asc()]
    all_of = {r.id: r.place for r in ordering.numbered(df, order, "place").collect()}
    expected = {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])), 1)}
    assert all_of == expected
    by_team = {r.id: r.place for r in ordering.numbered(df, order, "place", within=["team"]).collect()}
    seen: dict = {}
    for team, _, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        seen[team] = seen.get(team, 0) + 1
        assert by_team[i] == seen[team]


def test_equal_and_absent_rows(spark):
    same = spark.range(500).select(F.lit(3).alias("x"))
    assert sorted(r.n for r in ordering.numbered(same, [F.col("x")], "n").collect()) == list(range(1, 501))
    assert ordering.numbered(same.where("x > 3"), [F.col("x")], "n").collect() == []
