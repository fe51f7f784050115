"""Steps whose tables grow with the input: none goes whole through the driver, one task or one group."""

from pyspark.sql import functions as F

from repograph.plans import graph, insights, render


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_imports_meet_files_by_shuffles(spark):
    """Many ask for one module; nothing is broadcast, and exact, longer and shorter names are all found."""
    asked = spark.createDataFrame([("j", f"s{i}", "os") for i in range(50)] + [("j", "a", "pkg.util_1"), ("j", "b", "til_2"), ("j", "c", "x.y.util_2z")], "job_id string, source string, module string")
    targets = spark.createDataFrame([("j", "t1", "util_1"), ("j", "t2", "util_2"), ("j", "t3", "2z")], "job_id string, target string, name string")
    found = graph.resolve_imports(asked, targets)
    assert sorted((r.source, r.target) for r in found.collect()) == [("a", "t1"), ("b", "t2"), ("c", "t3")]
    assert "Broadcast" not in plan_of(found)


def test_parsing_is_dealt_to_all_cores(spark):
    """Rows of one small file are parsed by more than one task."""
    from repograph.operators import parsers

    files = spark.createDataFrame([("j", f"m{i}.py", f"def f{i}(a):\n    return a\n") for i in range(200)], "job_id string, path string, content string").coalesce(1)
    parsed = parsers.parsed_once(files)
    assert parsed.count() == 200 and len(parsed.inputFiles()) > 1


def test_parts_of_a_text_are_the_text(spark):
    """Parts of three lines, joined in order, equal the text in one piece; no part holds more."""
    from repograph.plans import render

    lines = [spark.createDataFrame([(j, n, f"{i:03d}", f"line {i * 7 % 5}") for j in ("a", "b") for i in range(10)], "job_id string, section int, seq string, line string") for n in (1, 0)]
    whole = {r.job_id: r.text for r in render.document(lines).collect()}
    parts: dict = {}
    for r in render.in_parts(lines, most=3).orderBy("job_id", "part").collect():
        assert r.text.count("\n") < 3
        parts.setdefault(r.job_id, []).append(r.text)
    assert {j: "\n".join(p) for j, p in parts.items()} == whole and len(parts["a"]) == 7


def test_pointers_double_by_shuffles(spark, monkeypatch):
    """No round of the doubling broadcasts its nodes."""
    from repograph.operators import graphalgos

    plans, cut = [], graphalgos.cut
    monkeypatch.setattr(graphalgos, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    parents = spark.createDataFrame([("j", str(i), str(i - 1)) for i in range(1, 9)], "job_id string, id string, next string")
    ends, _ = graphalgos.pointers(parents)
    assert {(r.id, r.at, r.hops) for r in ends.collect()} == {(str(i), "0", i) for i in range(1, 9)}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_er_diagram_broadcasts_no_models(spark, monkeypatch):
    """What is made of a small file of parsed classes and methods meets by shuffles, and relations need no order of all models."""
    import __spark_entry__
    from repograph import storage

    plans, table = [], storage.table
    monkeypatch.setattr(storage, "table", lambda df, label, *more: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if label == "models" else None, table(df, label, *more))[1])
    out = __spark_entry__.queries()["er_diagram"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
    assert "erDiagram" in out.first().text


def test_joins_of_the_view_are_dealt_by_the_number_of_rows(spark):
    """The tasks of a join are told by its rows and not coalesced, so one of them holds no more when there are more rows."""
    from repograph import storage, testdata

    assert [storage.tasks(n) for n in (0, 250_000, 250_001, 10_000_000)] == [1, 1, 2, 40]
    assert "REPARTITION_BY_NUM" in plan_of(testdata.view(spark, "/root/testdata/sf0.001").edges.groupBy("job_id", "relationship").count())


def test_files_that_only_import_count_for_no_size(spark, monkeypatch):
    """Imports from one set of files to another have no cycle, so no job is solved over frames, however many they are."""
    from repograph.operators import graphalgos

    def never(edges):
        raise AssertionError("solved over frames")

    monkeypatch.setattr(graphalgos, "by_propagation", never)
    schema = "job_id string, source_id string, target_id string"
    apart = [(j, f"c{i}", f"s{k}") for j in ("a", None) for i in range(6) for k in range(4)]
    assert graphalgos.cycles(spark.createDataFrame(apart[:24], schema), small=3).count() == 0
    with_one = [*apart, ("a", "x", "y"), ("a", "y", "x"), (None, "p", "q"), (None, "q", "p")]
    assert sorted((str(r.job_id), r.scc) for r in graphalgos.cycles(spark.createDataFrame(with_one, schema), small=3).collect()) == [("None", "p"), ("a", "x")]


def test_outliers_are_marked_without_a_shuffle_by_job(spark):
    """A job's 95th percentile comes to its symbols; they do not all go to one task."""
    from repograph.plans import insights

    told = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = insights.line_outliers(spark.createDataFrame([("j", i) for i in range(1, 41)], "job_id string, lines int"), 20, 10)
        assert "SortMergeJoin" not in plan_of(marked)
        assert sorted(r.lines for r in marked.where("outlier").collect()) == [39, 40]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", told)


def test_the_report_holds_no_frame_in_memory(spark):
    """Symbols are written by the columns that the report reads; only files' and classes' ids are among them."""
    from repograph.plans import insights
    from repograph import testdata

    v = testdata.view(spark, "/root/testdata/sf0.001")
    for frame in (insights.report(v.files, v.classes, v.functions, v.edges).metrics,):
        assert "InMemoryTableScan" not in plan_of(frame)


def test_coverage_by_file_equals_that_by_symbol(spark):
    """Numbers by file, met with the source files, give what symbols met with them give."""
    from repograph.plans import insights

    files = spark.createDataFrame([("j", "f1", "src/a.py", "python"), ("j", "f2", "tests/test_a.py", "python"), ("j", "f3", "src/b.go", "go"), ("k", "f4", "src/a.py", "python"), ("k", "f5", "src/a.py", "java")], "job_id string, id string, path string, language string")
    symbol = "job_id string, id string, label string, file string, line int, lines int, has_docstring boolean"
    rows = [(j, f"{n}", label, file, 1, lines, doc) for n, (j, label, file, lines, doc) in enumerate((j, label, file, lines, doc) for j in "jk" for label in ("a", "_b") for file in ("src/a.py", "tests/test_a.py", "src/b.go", "src/none.py") for lines in (5, 6, None) for doc in (True, False, None))]
    symbols = spark.createDataFrame(rows, symbol)
    edges = spark.createDataFrame([], "job_id string, source_id string, target_id string, relationship string")
    want = insights.doc_coverage(insights.public_symbols(insights.scope(files, symbols, symbols, edges)))
    got = insights.doc_coverage_by_file(files, symbols, symbols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 2


def test_parts_in_one_range_are_not_shuffled(spark, monkeypatch):
    """Rows are sorted as they are, not as texts; parts over the ends of ranges, equal seqs, null lines and null jobs are those of the whole text."""
    from repograph.operators import ordering

    rows = [(j, "b" if i % 3 else "a", i % 4 if i % 5 else None) for j in ("x", "y", None) for i in range(300)]
    late = spark.createDataFrame(rows, "job_id string, name string, n int").withColumn("section", F.lit(4))
    line = F.concat(F.lit("issue "), F.col("name"), F.lit("\n no "), F.col("n"))  # null where n is
    made = render.Late(late, F.col("name"), line, [F.col("n")])
    heads = [spark.createDataFrame([(j, 0, f"{i}", f"head {i}" if i else None) for j in ("x", "y") for i in range(4)], "job_id string, section int, seq string, line string")]
    whole = {r.job_id: r.text for r in render.document(heads, late=made).collect()}
    wide = {r.job_id: r.n for r in heads[0].select("job_id").unionByName(late.select("job_id")).groupBy("job_id").count().withColumnRenamed("count", "n").collect()}
    monkeypatch.setattr(render, "tasks", lambda rows: 7)
    for few, many in ((ordering.FEW, True), (0, False)):
        monkeypatch.setattr(ordering, "FEW", few)
        parts = render.in_parts(heads, late=made, most=10)
        got: dict = {}
        for r in parts.orderBy("job_id", "part").collect():
            got.setdefault(r.job_id, []).append((r.part, r.text))
        assert {j: "\n".join(t for _, t in p if t) for j, p in got.items()} == whole
        assert all([n for n, _ in p] == list(range(-(-wide[j] // 10))) for j, p in got.items())
        plan = parts._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and (not many or "BroadcastHashJoin" in plan)
    assert parts.where("text is null").count() == 0


def test_touched_files_are_those_at_an_end_of_an_edge(spark):
    files = spark.createDataFrame([("j", "a"), ("j", "b"), ("j", "c"), ("j", "c"), ("k", "a"), ("l", "z")], "job_id string, id string")
    edges = spark.createDataFrame([("j", "a", "c"), ("j", "a", "f9"), ("j", "f9", "c"), ("k", "b", "a"), ("l", "a", "b")], "job_id string, source_id string, target_id string")
    for deals in (None, 3):
        s = insights.Scope(files, files, None, None, edges, deals)
        assert {tuple(r) for r in insights.touched_files(s).collect()} == {("j", 3), ("k", 1)}


def test_no_case_of_a_rule_is_interpreted(spark):
    """A filter by a lambda has no generated code, nor has what it filters."""
    frame = spark.createDataFrame([("j", "p", 1, "s", 5), ("j", "q", 2, "t", 50)], "job_id string, path string, line int, label string, n int")
    cases = [(F.col("n") > 3, "A", "c", "low", "few", 1.0, F.col("n")), (F.col("n") > 9, "B", "c", "high", "many", 0.5, F.col("n")), (F.lit(None).cast("boolean"), "C", "c", "high", "none", 0.5, F.col("n"))]
    issues = insights.exploded_rules(frame, cases, "path", "line", "label")
    assert {(r.rule, r.file_path, r.value, r.confidence) for r in issues.collect()} == {("A", "p", 5.0, 1.0), ("A", "q", 50.0, 1.0), ("B", "q", 50.0, 0.5)}
    assert "lambda" not in issues._jdf.queryExecution().executedPlan().toString()
