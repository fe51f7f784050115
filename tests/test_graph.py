"""Graph build, coupling, cycles, report and store on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from repograph.operators import coupling, graphalgos, jobs, parsers, selectors
from repograph.plans import graph, insights
from repograph.sources import repository, store


def edges_of(spark, pairs, job="j"):
    return spark.createDataFrame([(job, a, b, "IMPORTS") for a, b in pairs], "job_id string, source_id string, target_id string, relationship string")


def build(spark, files):
    df = spark.createDataFrame([("job12345x", p, c) for p, c in files], "job_id string, path string, content string")
    repo = spark.createDataFrame([("job12345x", "r", "u")], "job_id string, name string, url string")
    return graph.build(parsers.parse_files(df), repo)


def test_modules_and_edges(spark):
    g = build(spark, [("backend/src/app/main.py", "import util\nclass A: pass\nclass B(A):\n    def m(self): pass\n"), ("frontend/src/util.py", "def f(): pass\n"), ("broken.py", "def (")])
    assert {r.path for r in g.modules.collect()} == {"backend", "backend/src", "backend/src/app", "frontend", "frontend/src"}
    kinds = {r.relationship: r["count"] for r in g.edges.groupBy("relationship").count().collect()}
    assert kinds == {"CONTAINS": 5 + 2 + 2 + 1 + 1, "IMPORTS": 1, "DEPENDS_ON": 1, "INHERITS": 1}
    assert g.files.count() == 2 and g.nodes().count() == 1 + 5 + 2 + 2 + 2


@pytest.mark.parametrize("pairs,size,cycle", [([("a", "b"), ("b", "a")], 2, ["a", "b", "a"]), ([("a", "b"), ("b", "c"), ("c", "a")], 3, ["a", "b", "c", "a"]), ([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], 4, ["a", "b", "c", "d", "a"])])
def test_cycles(spark, pairs, size, cycle):
    (row,) = graphalgos.cycles(edges_of(spark, pairs)).collect()
    assert (row["size"], row.cycle) == (size, cycle)


def test_no_and_two_cycles(spark):
    assert graphalgos.cycles(edges_of(spark, [("a", "b"), ("b", "c")])).count() == 0
    assert graphalgos.cycles(edges_of(spark, [("a", "b"), ("b", "a"), ("b", "x"), ("x", "y"), ("y", "x")])).count() == 2
    assert graphalgos.cycles(edges_of(spark, [])).count() == 0


def test_propagation_equals_grouped(spark):
    rng = random.Random(4)
    pairs = list({(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(40)})
    e = edges_of(spark, pairs)
    want = sorted(r.members for r in graphalgos.cycles(e).collect())
    assert sorted(r.members for r in graphalgos.cycles(e, small=0).collect()) == want


def test_coupling_counts_pairs_once(spark):
    e = edges_of(spark, [("a", "b"), ("a", "b"), ("a", "c"), ("a", "a"), ("a", "zz")])
    files = spark.createDataFrame([("j", x) for x in "abc"], "job_id string, id string")
    got = {r.id: (r.ce, r.ca, r.instability) for r in coupling.coupling(files, e).collect()}
    assert got == {"a": (2, 0, 1.0), "b": (0, 1, 0.0), "c": (0, 1, 0.0)}


def test_depth_with_a_loop(spark):
    got = {r.id: r.depth for r in graphalgos.chain_depth(edges_of(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")]), most=5).collect()}
    assert got == {"a": 2, "b": 1, "x": 5, "y": 5}


def test_propagation_gives_the_grouped_paths(spark):
    rng = random.Random(9)
    pairs = list({(f"n{rng.randrange(16):02}", f"n{rng.randrange(16):02}") for _ in range(30)})
    e = edges_of(spark, [*pairs, ("p", "q"), ("q", "p"), ("p", "r"), ("r", "s"), ("s", "p")])
    want = sorted((r.scc, r.cycle) for r in graphalgos.cycles(e).collect())
    assert sorted((r.scc, r.cycle) for r in graphalgos.cycles(e, small=0).collect()) == want


def test_trimming_costs_no_round_and_too_few_rounds_raise(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "x"), ("x", "y"), ("y", "x"), ("y", "z")])
    wanted = e.select("job_id", "source_id", "target_id")
    assert [r.cycle for r in graphalgos.by_propagation(wanted, most_rounds=2).collect()] == [["x", "y", "x"]]
    with pytest.raises(RuntimeError):
        graphalgos.by_propagation(wanted, most_rounds=0)


def test_deep_chains_pass_the_limit_of_loops(spark):
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(8)] + [("x", "y"), ("y", "x"), ("x", "c0")]
    got = {r.id: r.depth for r in graphalgos.chain_depth(edges_of(spark, pairs), most=3).collect()}
    assert got == {"x": 3, "y": 3, **{f"c{i}": 8 - i for i in range(8)}}


FILES = "job_id string, id string, label string, path string, language string, lines int, classes int, functions int"
CLASSES = "job_id string, id string, label string, file string, line int, lines int, methods int, is_abstract boolean, has_docstring boolean, language string"
FUNCTIONS = "job_id string, id string, label string, file string, line int, lines int, param_count int, is_method boolean, is_async boolean, cyclomatic int, nesting_depth int, call_count int, has_docstring boolean, language string"


def clean(spark, functions=()):
    fs = spark.createDataFrame([("j", "f1", "service.py", "src/service.py", "python", 80, 1, 3), ("j", "f2", "test_service.py", "tests/test_service.py", "python", 20, 0, 1)], FILES)
    cs = spark.createDataFrame([("j", "c1", "Service", "src/service.py", 1, 40, 3, False, True, "python")], CLASSES)
    fn = [("j", f"m{i}", f"do_{i}", "src/service.py", i, 10, 1, True, False, 2, 1, 2, True, "python") for i in range(3)] + list(functions) + [("j", "t", "test_x", "tests/test_service.py", 1, 90, 9, False, False, 30, 9, 30, False, "python")]
    es = spark.createDataFrame([("j", "f1", "c1", "CONTAINS")], "job_id string, source_id string, target_id string, relationship string")
    return insights.report(fs, cs, spark.createDataFrame(fn, FUNCTIONS), es)


def test_clean_repository(spark):
    r = clean(spark)
    (o,) = r.overall.collect()
    assert o.overall_score >= 70 and r.dimensions.count() == 6 and r.metrics.count() == 33
    assert r.issues.where("severity in ('critical', 'high')").count() == 0
    s = r.stats.first()
    assert (s.functions, s.test_files, s.files) == (3, 1, 1)


def test_god_function_is_found(spark):
    big = ("j", "g", "do_all", "src/service.py", 9, 200, 12, False, False, 25, 6, 30, True, "python")
    rules_ = {x.rule for x in clean(spark, [big]).issues.where("affected_symbol = 'do_all'").collect()}
    assert {"I1", "I4", "I5"} <= rules_ and "I7" not in rules_


def test_empty_repository(spark):
    e = lambda s: spark.createDataFrame([], s)
    r = insights.report(e(FILES), e(CLASSES), e(FUNCTIONS), e("job_id string, source_id string, target_id string, relationship string"))
    assert r.issues.count() == 0 and r.overall.count() == 0


def test_store_round_trip(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "nodes"), "job_id string, id string, label string", "job_id")
    assert t.read().count() == 0
    row = lambda *r: spark.createDataFrame(list(r), "job_id string, id string, label string")
    t.append(row(("a", "1", "x"), ("b", "2", "y")))
    t.upsert(row(("a", "1", "z"), ("a", "3", "n")))
    t.insert_if_absent(row(("a", "1", "no"), ("b", "4", "new")))
    assert sorted(tuple(r) for r in t.read().select("job_id", "id", "label").collect()) == [("a", "1", "z"), ("a", "3", "n"), ("b", "2", "y"), ("b", "4", "new")]
    assert t.delete(F.col("job_id") == "a") == 2
    t.vacuum()
    assert t.read().count() == 2


def test_delete_graph_touches_one_job(spark, tmp_path):
    schema = "job_id string, id string"
    nodes, edges = (store.Table(spark, str(tmp_path / name), schema) for name in ("nodes", "edges"))
    odd = "a/b=c d"
    nodes.append(spark.createDataFrame([(odd, "1"), (odd, "2"), ("other", "3")], schema))
    edges.append(spark.createDataFrame([(odd, "e"), ("other", "f")], schema))
    assert store.delete_graph(nodes, edges, odd) == (2, 1) and store.delete_graph(nodes, edges, odd) == (0, 0)
    assert [r.id for r in nodes.read().collect()] == ["3"] and [r.id for r in edges.read().collect()] == ["f"]


def test_selectors(spark):
    one = lambda value, schema: spark.createDataFrame(value, schema)
    p = one([('{"a": 1, "b": {"c": 2}}',), ("[1]",), ("{bad",), (None,), ("",)], "p string").select(selectors.properties(F.col("p")).alias("p"))
    assert [r.p for r in p.collect()] == [{"a": "1", "b": '{"c":2}'}, {}, {}, {}, {}]
    with pytest.raises(Exception, match="too short"):
        one([("is it",)], "q string").select(selectors.checked_tokens(F.col("q"))).collect()
    e = one([({"threshold": "1", "x": "2"},), (None,)], "e map<string,string>").select(selectors.evidence(F.col("e")).alias("e"))
    assert [[tuple(x) for x in r.e] for r in e.collect()] == [[("x", "2")], []]
    asked, done = one([("a",), ("b",), ("c",), ("d",)], "job_id string"), one([("a", "completed"), ("b", "failed"), ("c", "completed")], "job_id string, status string")
    verdicts = dict(map(tuple, selectors.gate(asked, done, one([("a",), ("a",), ("b",)], "job_id string")).collect()))
    assert verdicts == {"a": "ready", "b": "not completed", "c": "no graph", "d": "missing"}


def test_missing_ends_are_errors(spark):
    nodes = spark.createDataFrame([("j", "a")], "job_id string, id string")
    with pytest.raises(Exception, match="no such node"):
        store.checked_edges(edges_of(spark, [("a", "b")]), nodes).collect()


def test_tree_source(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\x00")
    rows = {r.path: r.content for r in repository.read_tree(spark, str(tmp_path), "j").collect()}
    assert rows == {"src/a.py": "x = 1\n", "b.bin": None}


def test_tree_source_reads_big_files_whole(spark, tmp_path):
    text = "x = 1\n" * 1_500_000
    (tmp_path / "big.py").write_text(text)
    (row,) = repository.read_tree(spark, str(tmp_path), "j").collect()
    assert row.size == len(text) and row.content == text


def test_job_fold(spark):
    steps = ["running", "pending", "completed", "failed"]
    e = spark.createDataFrame([("j", i, i, s) for i, s in enumerate(steps)], "job_id string, at long, seq long, status string")
    assert tuple(jobs.fold(e).first()) == ("j", "completed", 2, 2)


def test_streaming_states(spark, tmp_path):
    from datetime import datetime

    from repograph.streaming import jobs as live

    source = str(tmp_path / "in")
    spark.createDataFrame([("j", datetime(2024, 1, 1, 0, i), i, s) for i, s in enumerate(["running", "completed", "failed"])], live.EVENTS).coalesce(1).write.parquet(source)
    q = live.states(live.read_events(spark, source)).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("states").collect()] == [("j", "completed", 2, 1)]
