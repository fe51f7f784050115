"""Changes of tables by job, and writers that meet."""

import os

import pytest
from pyspark.sql import functions as F

from repograph.sources import store

SCHEMA = "job_id string, id string, label string"


def table(spark, path, rows=(("a", "1", "x"), ("a", "2", "y"), ("b", "3", "z"), ("odd/name %", "4", "w"))):
    t = store.Table(spark, str(path), SCHEMA)
    t.replace(spark.createDataFrame(list(rows), SCHEMA))
    return t


def files(path, job):
    return sorted(f for d, _, names in os.walk(path) if f"job_id={job}" in d and "/v-" in d for f in names if f.endswith(".parquet"))


def rows(t):
    return sorted(((r.job_id, r.id, r.label) for r in t.read().collect()), key=str)


def test_a_change_leaves_other_jobs_files(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    before = {j: files(t.path, j) for j in ("a", "b", "odd")}
    t.update(F.col("id") == "1", label="new")
    assert rows(t) == [("a", "1", "new"), ("a", "2", "y"), ("b", "3", "z"), ("odd/name %", "4", "w")]
    assert files(t.path, "b") == before["b"] and files(t.path, "odd") == before["odd"] and files(t.path, "a") != before["a"]
    t.upsert(spark.createDataFrame([("q", "2", "moved"), ("odd/name %", "9", "fresh")], SCHEMA))
    assert rows(t) == [("a", "1", "new"), ("a", "2", "moved"), ("b", "3", "z"), ("odd/name %", "4", "w"), ("odd/name %", "9", "fresh")]
    assert t.delete(F.col("job_id") == "a") == 2 and t.delete(F.col("id") == "none") == 0
    assert rows(t) == [("b", "3", "z"), ("odd/name %", "4", "w"), ("odd/name %", "9", "fresh")] and files(t.path, "b") == before["b"]
    assert not [n for n in os.listdir(t.path) if n.startswith("s-")]


def test_a_lost_race_raises_and_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    other = store.Table(spark, t.path, SCHEMA)

    class Slow(store.Table):
        """A writer that another one overtakes between its reading and its change."""

        def _claim(self, number, staged=None):
            other.update(F.col("id") == "3", label="other")
            self._claim = super()._claim
            self._claim(number, staged)

    for change in (lambda s: s.update(F.col("id") == "1", label="lost"), lambda s: s.upsert(spark.createDataFrame([("a", "1", "lost")], SCHEMA)), lambda s: s.delete(F.col("id") == "1"), lambda s: s.replace(spark.createDataFrame([("a", "1", "lost")], SCHEMA), s._state()[1])):
        with pytest.raises(store.LostRace):
            change(Slow(spark, t.path, SCHEMA))
        assert rows(t) == [("a", "1", "x"), ("a", "2", "y"), ("b", "3", "other"), ("odd/name %", "4", "w")]
        assert not [n for n in os.listdir(t.path) if n.startswith("s-")]
    t.update(F.col("id") == "1", label="won")
    assert ("a", "1", "won") in rows(t)


def test_null_jobs_and_tables_without_jobs(spark, tmp_path):
    t = table(spark, tmp_path / "t", [(None, "1", "x"), ("b", "2", "y")])
    t.update(F.col("id") == "1", label="new")
    assert rows(t) == sorted([(None, "1", "new"), ("b", "2", "y")], key=str)
    plain = store.Table(spark, str(tmp_path / "p"), SCHEMA, None)
    plain.replace(spark.createDataFrame([("a", "1", "x")], SCHEMA))
    plain.upsert(spark.createDataFrame([("a", "1", "y"), ("b", "2", "z")], SCHEMA))
    assert plain.delete(F.col("id") == "2") == 1 and rows(plain) == [("a", "1", "y")]
