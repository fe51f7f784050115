"""A query for each operator over the testbed's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import storage
from . import testdata as T
from .functions import rules, text
from .operators import coupling, graphalgos, jobs, lint, parsers, retrieval, search, selectors
from .plans import graph, insights, memory, render
from .sources import repository, store
from .streaming import jobs as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# -- coupling and counts ------------------------------------------------------------------------


@query
def coupling_metrics(spark, d):
    v = T.view(spark, d)
    return coupling.coupling(v.files, v.edges)


@query
def instability_avg(spark, d):
    e = T.nation_graph(spark, d)
    files = e.select("job_id", F.col("source_id").alias("id")).union(e.select("job_id", "target_id")).distinct()
    return coupling.average_instability(coupling.coupling(files, e)).select("job_id", F.round("avg_instability", 6).alias("avg_instability"))


@query
def fan_in_out_dup(spark, d):
    return coupling.fans(T.view(spark, d).edges)


@query
def top_fanout(spark, d):
    v = T.view(spark, d)
    return coupling.fans(v.edges).groupBy("job_id").agg(F.max_by("id", F.struct("fan_out", "id")).alias("id"), F.max("fan_out").alias("fan_out")).where("fan_out >= 3")


@query
def node_type_counts(spark, d):
    v = T.view(spark, d)
    parts = [f.select("job_id", F.lit(k).alias("node_type")) for k, f in (("File", v.files), ("Class", v.classes), ("Function", v.functions))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("job_id", "node_type").agg(F.count(F.lit(1)).alias("n"))


@query
def edge_type_counts(spark, d):
    return T.view(spark, d).edges.groupBy("job_id", "relationship").agg(F.count(F.lit(1)).alias("n"))


@query
def incident_edges(spark, d):
    return coupling.incident_edges(T.view(spark, d).edges, "s7")


@query
def status_counts_zero_filled(spark, d):
    return jobs.status_counts(T.job_events(spark, d))  # no event cancels a job


@query
def owner_resolution(spark, d):
    v = T.view(spark, d)
    owned = coupling.resolve_owner(v.functions.select("job_id", "id", "file"), v.files, v.classes, v.edges)
    return owned.groupBy("job_id", "file_id").agg(F.count(F.lit(1)).alias("n"))


# -- rules --------------------------------------------------------------------------------------


@query
def file_classify(spark, d):
    r = T.repository(spark, d)
    return r.select("doc_id", "path", rules.category(F.col("path")).alias("category"))


@query
def category_counts(spark, d):
    r = T.repository(spark, d).withColumn("category", rules.category(F.col("path")))
    return insights.coverage_counts(r)


@query
def dominant_language(spark, d):
    r = T.repository(spark, d).withColumn("language", rules.language(F.col("path")))
    return insights.dominant_language(r.where("language <> 'unknown'"))


@query
def layer_detection(spark, d):
    r = T.repository(spark, d)
    return r.select("doc_id", rules.layer(F.col("path")).alias("layer"))


@query
def diagram_noise(spark, d):
    r = T.repository(spark, d)
    label = text.last_segment(F.col("path"))
    return r.select("doc_id", rules.diagram_noise(label, F.col("path"), F.col("size"), F.lit(0), F.lit(0)).alias("noise"))


@query
def naming_check(spark, d):
    v = T.view(spark, d)
    both = v.classes.select("id", "label", F.lit("class").alias("kind")).unionByName(v.functions.select("id", "label", F.lit("method").alias("kind")))
    langs = both.withColumn("lang", F.explode(F.array(*[F.lit(x) for x in ("python", "java", "typescript", "unknown")])))
    ok = rules.naming_ok(F.col("label"), F.col("lang"), F.col("kind"))
    return langs.groupBy("kind", "lang").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("bad"))


@query
def mixed_naming(spark, d):
    v = T.view(spark, d)
    return lint.mixed_naming(v.functions.select("job_id", F.col("file").alias("path"), F.col("label").alias("name")))


@query
def field_types(spark, d):
    names = T.table(spark, d, "part").select(F.lower(F.translate("p_name", " ", "_")).alias("name")).union(spark.createDataFrame([(x,) for x in "user_id id created_at email page is_on price_list image_url title birthdate".split()], "name string")).distinct()
    return names.select("name", rules.field_type(F.col("name")).alias("type"))


@query
def url_parts(spark, d):
    p = T.table(spark, d, "pages").select("page_id", F.concat(F.lit("https://host.example/owner"), F.col("page_id") % 9, F.lit("/repo"), "page_id", F.when(F.col("page_id") % 2 == 0, ".git").otherwise("/")).alias("url"))
    parts = rules.repo_parts(F.col("url"))
    return p.select("page_id", parts["owner"].alias("owner"), parts["name"].alias("name"))


@query
def code_file_selection(spark, d):
    return repository.code_files(T.repository(spark, d), 25).select("job_id", "path", "size")


@query
def module_enumeration(spark, d):
    return T.repository(spark, d).select("job_id", F.explode(text.ancestors(F.col("path"))).alias("module")).distinct()


@query
def top_directories(spark, d):
    top = F.when(F.size(F.split("path", "/")) > 1, F.get(F.split("path", "/"), F.lit(0)))
    return T.repository(spark, d).groupBy("job_id").agg(F.count_distinct(top).alias("n_dirs"))


@query
def longest_prefix_parent(spark, d):
    r = T.repository(spark, d).select("job_id", "path").distinct()
    modules = r.select("job_id", F.explode(text.ancestors(F.col("path"), 2)).alias("path")).distinct()
    return graph.longest_prefix(r, modules)


@query
def import_resolution(spark, d):
    files = T.sources(spark, d).where("path like '%.py'").select("job_id", F.col("path").alias("target"), F.explode(graph.target_names(F.col("path"))).alias("name"))
    asked = T.table(spark, d, "part").select(F.lit("synthetic").alias("job_id"), F.concat(F.lit("f"), "p_partkey").alias("source"), F.concat(F.lit("pkg.util_"), F.col("p_partkey") * 3).alias("module"))
    return graph.resolve_imports(asked, files)


@query
def content_preview(spark, d):
    return T.table(spark, d, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


# -- aggregates, windows, scores ------------------------------------------------------------------


@query
def line_percentiles(spark, d):
    v = T.view(spark, d)
    f = v.functions.where("lines > 0").groupBy("job_id").agg(F.percentile("lines", F.lit(0.95)).alias("p95"), F.median("lines").alias("median"), F.round(F.avg("lines"), 6).alias("mean"), F.max("lines").alias("longest"))
    return f


@query
def size_outliers(spark, d):
    marked = insights.line_outliers(T.view(spark, d).functions, 20, insights.FN_LINES_CRITICAL)
    return marked.where("outlier").select("job_id", "id", "lines")


@query
def top_k_per_group(spark, d):
    v = T.view(spark, d)
    w = W.partitionBy("job_id").orderBy(F.desc("methods"), "id")
    return v.classes.withColumn("rank", F.row_number().over(w)).where("rank <= 6").select("job_id", "id", "methods", "rank")


@query
def god_function_scores(spark, d):
    f = insights.judged_functions(T.view(spark, d).functions)
    return f.select("job_id", "id", F.round("composite", 6).alias("composite"), "is_god", "is_large", "many_params")


@query
def issue_counts_complexity(spark, d):
    v = T.view(spark, d)
    return insights.complexity_issues(v.functions, v.classes).groupBy("job_id", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def issue_counts_coupling(spark, d):
    v = T.view(spark, d)
    return insights.coupling_issues(v.files, coupling.coupling(v.files, v.edges)).groupBy("job_id", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def issue_counts_size(spark, d):
    return insights.size_issues(T.view(spark, d).files).groupBy("job_id", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def whole_report(spark, d):
    v = T.view(spark, d)
    deals = max(storage.tasks(T.table(spark, d, "lineitem").count()), spark.sparkContext.defaultParallelism)
    return insights.report(v.files, v.classes, v.functions, v.edges, deals)


@query
def dimension_scores(spark, d):
    return whole_report(spark, d).dimensions.select("job_id", "dimension", "score", "grade")


@query
def overall_score(spark, d):
    return whole_report(spark, d).overall.select("job_id", "overall_score", "overall_grade", "weakest")


@query
def metric_rows(spark, d):
    return whole_report(spark, d).metrics.select("job_id", "dimension", "metric", F.round("value", 6).alias("value"), "score")


@query
def report_stats(spark, d):
    return whole_report(spark, d).stats


@query
def sorted_issues(spark, d):
    return insights.sorted_issues(whole_report(spark, d).issues)


@query
def issue_groups(spark, d):
    """Issues by file: number and worst severity, as a dashboard groups them."""
    v = T.view(spark, d)
    i = insights.size_issues(v.files).unionByName(insights.coupling_issues(v.files, coupling.coupling(v.files, v.edges)))
    rank = F.when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return i.groupBy("job_id", F.coalesce(F.nullif("file_path", F.lit("")), F.lit("(no file)")).alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("worst"))


@query
def issue_ranks(spark, d):
    """Issues of size and coupling with their place in their job's order."""
    v = T.view(spark, d)
    i = insights.size_issues(v.files).unionByName(insights.coupling_issues(v.files, coupling.coupling(v.files, v.edges)))
    return insights.ranked_issues(i).select("job_id", "rule", "severity", "file_path", "place")


@query
def doc_coverage(spark, d):
    v = T.view(spark, d)
    return insights.doc_coverage_by_file(v.files, v.classes, v.functions).select("job_id", "n_public", "n_undocumented", F.round("coverage", 6).alias("coverage"))


@query
def worst_undocumented(spark, d):
    v = T.view(spark, d)
    w = W.partitionBy("job_id").orderBy(F.desc("lines"), "id")
    bare = v.classes.where("not has_docstring and not startswith(label, '_')")
    return bare.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("job_id", "id", "lines", "rank")


# -- graph algorithms -----------------------------------------------------------------------------


@query
def scc_nation(spark, d):
    return graphalgos.cycles(T.nation_graph(spark, d)).select("job_id", "size", F.explode("members").alias("member"))


@query
def first_cycle(spark, d):
    return graphalgos.first_cycle(T.nation_graph(spark, d))


@query
def inheritance_depth(spark, d):
    return graphalgos.chain_depth(T.inheritance(spark, d)).select("id", "depth")


@query
def first_cycle_steps(spark, d):
    return graphalgos.first_cycle(T.nation_graph(spark, d)).select("job_id", F.posexplode("cycle").alias("place", "node"))


@query
def click_chain_depth(spark, d):
    return graphalgos.chain_depth(T.click_chain(spark, d)).select("job_id", "id", "depth")


@query
def single_parent_depth(spark, d):
    return graphalgos.single_parent_depth(T.parent_parts(spark, d)).select("id", "depth")


# -- store, jobs, memory, search --------------------------------------------------------------------


@query
def insert_if_absent(spark, d):
    """Customers with orders are there first; all customers come in where they are not."""
    old = T.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lit("old").alias("from")).distinct()
    new = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("new").alias("from"))
    return old.unionByName(store.absent(old, new))


@query
def upsert_last_wins(spark, d):
    old = T.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lit("old").alias("label"), F.lit("first").alias("made")).distinct()
    new = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("new").alias("label"), F.lit("later").alias("made"))
    return store.merged(old, new, ("id",), ("made",))


@query
def insert_parties_if_absent(spark, d):
    """Suppliers are there first; a customer comes in where no supplier has its number."""
    old = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("from"))
    new = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("from"))
    return old.unionByName(store.absent(old, new))


@query
def upsert_parties(spark, d):
    """Customers over suppliers of the same number: the later label, the first maker."""
    old = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("supplier").alias("made"))
    new = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("customer").alias("made"))
    return store.merged(old, new, ("id",), ("made",))


@query
def latest_state(spark, d):
    return jobs.latest(T.job_events(spark, d), "job_id", ["at", "seq"]).select("job_id", "status")


@query
def job_transitions(spark, d):
    return jobs.fold(T.job_events(spark, d))


@query
def orphan_reset(spark, d):
    last = jobs.latest(T.job_events(spark, d), "job_id", ["at", "seq"]).withColumn("error_message", F.lit(None).cast("string"))
    return jobs.fail_orphans(last).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("error_message").alias("n_errors"))


@query
def memory_fold(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("repo_url"), F.col("o_orderdate").alias("at"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("job_id"), F.floor(F.col("o_totalprice") / 10000).cast("int").alias("overall_score"), F.col("o_orderpriority").alias("headline"))
    return memory.summaries(o).select("repo_url", "analysis_count", "overall_score", "headline", "job_id")


@query
def keyword_search(spark, d):
    n = T.repository(spark, d).select(F.col("doc_id").alias("id"), "job_id", F.lit("File").alias("node_type"), text.last_segment(F.col("path")).alias("label"), F.col("source").alias("file"), "path")
    return search.top_nodes(n, text.keywords(F.lit("How does the order service test, and the router?"))).select("job_id", "id", "score", "rank")


@query
def fact_search(spark, d):
    return search.search_facts(T.facts(spark, d), text.search_tokens(F.lit("SRC1 the router an")), k=10).select("id", "score")


@query
def indexed_facts(spark, d):
    index = retrieval.build(T.facts(spark, d), {"source_symbol": 3, "text": 2, "source_file": 1}, group_col="repo_url")
    return retrieval.search(index, T.questions(spark, d), k=10).select("question", F.col("group").alias("repo_url"), "id", "score", "rank")


@query
def streamed_job_states(spark, d):
    """The events table as a stream of micro-batches, folded with timers and a watermark that covers its disorder."""
    source = storage.table(T.job_events(spark, d).withColumn("at", F.col("at").cast("timestamp")), "events")
    events = live.read_events(spark, source.written_to)
    return live.run_states(events, late="60 days")


@query
def chat_window(spark, d):
    m = T.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))
    return search.history(m).select("session_id", "id", "role", "back")


@query
def intent_routing(spark, d):
    m = T.table(spark, d, "conversations").where("role = 'user'")
    return m.select("conv_id", "turn", search.intent(F.col("text")).alias("intent"))


@query
def context_text(spark, d):
    n = T.repository(spark, d).select(F.col("doc_id").cast("string").alias("id"), "job_id", F.lit("File").alias("node_type"), text.last_segment(F.col("path")).alias("label"), F.col("source").alias("file"), "path")
    return search.render_context(search.context(n, text.keywords(F.lit("order service router"))))


# -- parsing, lint, graph build, text ---------------------------------------------------------------


@query
def page_braces(spark, d):
    p = T.table(spark, d, "pages")
    return p.select("page_id", text.brace_depth(F.col("html")).alias("depth"), F.regexp_count("html", F.lit(r"&&|\|\|")).alias("tokens"))


@query
def parse_metrics(spark, d):
    """Per file: its language and the figures of its free function or method."""
    p = parsers.parsed_once(T.sources(spark, d))
    f = F.coalesce(F.get(F.filter("functions", lambda x: x["name"].isin("get_part", "load", "size")), F.lit(0)))
    return p.select("path", "language", F.size("classes").alias("classes"), F.size("imports").alias("imports"), f["cyclomatic"].alias("cyclomatic"), f["nesting_depth"].alias("nesting"), F.size(f["parameters"]).alias("parameters"))


def built(spark, d):
    parsed = parsers.parsed_once(T.sources(spark, d))
    repo = spark.createDataFrame([("synthetic", "testbed", "https://host.example/owner/testbed")], "job_id string, name string, url string")
    return parsed, graph.build(parsed, repo)


@query
def graph_nodes(spark, d):
    return built(spark, d)[1].persisted()[0].groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query
def graph_edges(spark, d):
    return built(spark, d)[1].persisted()[1].groupBy("relationship").agg(F.count(F.lit(1)).alias("n"))


@query
def lint_flags(spark, d):
    return lint.detect(parsers.parsed_once(T.sources(spark, d))).groupBy("pattern", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def lint_health(spark, d):
    p = parsers.parsed_once(T.sources(spark, d))
    return lint.health(lint.detect(p), p)


@query
def duplicate_names(spark, d):
    p = parsers.parsed_once(T.sources(spark, d))
    return lint.duplicate_names(p).select("name", "many")


@query
def duplicate_messages(spark, d):
    """Flags of one pattern, as a reader sees them."""
    flags = lint.of_pattern(lint.detect(parsers.parsed_once(T.sources(spark, d))), "duplicate_logic")
    return lint.described(flags).select("job_id", "symbol", "severity", "message", "fix")


@query
def lint_markdown(spark, d):
    p = parsers.parsed_once(T.sources(spark, d))
    flags = lint.detect(p)
    names = spark.createDataFrame([("synthetic", "testbed")], "job_id string, repo_name string")
    return render.lint_markdown(flags, lint.health(flags, p), p, names)


@query
def insights_markdown(spark, d):
    r = whole_report(spark, d)
    r.issues = storage.table(r.issues, "issues")  # read three times
    r.dimensions = storage.table(r.dimensions, "dimensions")  # and these four times
    r.overall = insights.overall(r.dimensions)
    names = r.overall.select("job_id", F.lower("job_id").alias("repo_name"))
    return render.insights_markdown(r, names, made=render.in_parts)


@query
def memory_facts(spark, d):
    r = whole_report(spark, d)
    r.dimensions = storage.table(r.dimensions, "dimensions")  # read five times
    r.overall = insights.overall(r.dimensions)
    names = r.overall.select("job_id", F.lower("job_id").alias("repo_name"))
    return memory.facts(memory.headlines(r.overall, r.dimensions, r.issues, names), r.dimensions, r.issues)


@query
def architecture_diagram(spark, d):
    v = T.view(spark, d)
    return render.architecture_diagram(v.files, v.edges, v.classes)


@query
def er_diagram(spark, d):
    _, g = built(spark, d)
    held = storage.shuffled(g.edges.where("relationship = 'CONTAINS'"), g.functions.select("job_id", F.col("id").alias("target_id"), "line", F.col("label").alias("name"), "lines"), ["job_id", "target_id"])
    methods = held.groupBy("job_id", F.col("source_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("line", "name", "lines"))).alias("methods"))
    classes = storage.shuffled(g.classes.drop("methods"), methods, ["job_id", "id"], "left").withColumn("methods", F.coalesce(F.transform("methods", lambda m: F.struct(m["name"].alias("name"), m["lines"].alias("lines"))), F.array().cast("array<struct<name:string,lines:int>>")))
    methods = F.col("methods")
    models = classes.where(rules.is_model_class(F.col("file"), F.col("label"), F.split("base_classes", ", "), F.split("decorators", ", "))).select("job_id", F.col("line").alias("seq"), F.col("label").alias("name"), rules.fields_of(methods).alias("fields"))
    return render.er_diagram(storage.table(models, "models"), classes=g.classes)  # read four times


@query
def module_breakdown(spark, d):
    _, g = built(spark, d)
    return render.module_breakdown(g.modules, g.files, g.classes, g.functions, g.edges, made=render.in_parts)


@query
def interview_questions(spark, d):
    v = T.view(spark, d)
    # The rules read each frame many times; of the functions a label and a number.
    v = T.View(storage.table(v.files, "files"), storage.table(v.classes.select("job_id", "id", "label", "file", "file_id", "line", "methods"), "classes"), storage.table(v.functions.select("job_id", "id", "label", "param_count"), "functions"), storage.table(v.edges, "edges"))
    line = W.partitionBy("job_id", "file_id").orderBy(F.length("id"), "id")  # an order's class inherits from its customer's order before it
    inherits = v.classes.select("job_id", F.col("id").alias("source_id"), F.lag("id").over(line).alias("target_id")).where("target_id is not null")
    depths = graphalgos.single_parent_depth(inherits).withColumn("depth", F.col("depth").cast("int"))
    return render.interview_questions(v.files, v.classes, v.functions, v.edges, depths, graphalgos.cycles(coupling.internal_dependencies(v.files, v.edges)))


@query
def learning_path(spark, d):
    _, g = built(spark, d)
    return render.learning_path(g.files, g.classes, g.modules, made=render.in_parts)


@query
def api_spec(spark, d):
    r = T.repository(spark, d).where("path like '%router%'")
    fns = r.select("job_id", F.concat(F.lit("h"), "doc_id").alias("id"), F.concat(F.lit("handle_"), "doc_id").alias("label"), F.col("path").alias("file"), F.lit(1).alias("line"), F.lit("request").alias("parameters"))
    return render.api_spec(fns)


@query
def canvas_layout(spark, d):
    v = T.view(spark, d)
    return render.canvas_layout(v.files.select("job_id", "id", F.lit("File").alias("node_type")))


# -- selectors --------------------------------------------------------------------------------------


@query
def node_selectors(spark, d):
    r = T.table(spark, d, "region").select(F.lit("Repository").alias("node_type"), F.col("r_name").alias("label"))
    n = T.table(spark, d, "nation").select(F.lit("Module").alias("node_type"), F.col("n_name").alias("label"))
    c = T.table(spark, d, "customer").select(F.lit("File").alias("node_type"), F.col("c_name").alias("label"))
    kind = F.col("node_type")
    return r.unionByName(n).unionByName(c).select(selectors.display_label(kind, F.col("label")).alias("display"), selectors.is_entry_point(kind).alias("entry"))


@query
def dependency_edges(spark, d):
    e = T.view(spark, d).edges
    return e.groupBy("job_id", selectors.is_dependency(F.col("relationship")).alias("dependency")).agg(F.count(F.lit(1)).alias("n"))


@query
def node_properties(spark, d):
    o = T.table(spark, d, "orders")
    stored = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('{"lines": '), F.col("o_custkey"), F.lit(', "doc": "yes"}'))).when(F.col("o_orderstatus") == "O", "no json")
    p = selectors.properties(stored)
    return o.select("o_orderkey", F.size(p).alias("n"), p["lines"].alias("lines"))


def order_issues(spark, d):
    """An order is an issue: its status is the job, its priority the severity, its clerk the category."""
    o = T.table(spark, d, "orders")
    severity = F.element_at(F.array(*[F.lit(x) for x in selectors.SEVERITIES]), F.substring("o_orderpriority", 1, 1).cast("int"))
    return o.select("o_orderkey", F.col("o_orderstatus").alias("job_id"), severity.alias("severity"), F.col("o_orderpriority").alias("category"))


@query
def severity_counts(spark, d):
    return selectors.severity_counts(order_issues(spark, d))


@query
def issue_choices(spark, d):
    i = order_issues(spark, d)
    high = selectors.issues_at(selectors.chosen(i, job_id="F", category="all"), "high").select(F.lit("high").alias("choice"), "o_orderkey")
    return high.unionByName(selectors.issues_at(i, "low").select(F.lit("low").alias("choice"), "o_orderkey"))


@query
def issue_categories(spark, d):
    return selectors.categories(order_issues(spark, d)).select("job_id", F.array_join("categories", "|").alias("categories"))


@query
def issues_shown(spark, d):
    return selectors.shown(order_issues(spark, d).select("o_orderkey", "severity"), ["o_orderkey"])


@query
def evidence_shown(spark, d):
    names = ["threshold", "clerk", "suggestion", "cust", "status", "recommendation", "priority", "key", "last"]
    values = ["9", "c", "s", "o_custkey", "o_orderstatus", "r", "o_orderpriority", "o_orderkey", "z"]
    of = F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.array(*[F.col(x).cast("string") if x.startswith("o_") else F.lit(x) for x in values]))
    shown = F.array_join(F.transform(selectors.evidence(of), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return T.table(spark, d, "orders").select("o_orderkey", shown.alias("evidence"))


@query
def label_repeats(spark, d):
    c = T.table(spark, d, "customer").select(F.col("c_nationkey").alias("job_id"), F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("id"))
    return selectors.label_repeats(c).select("id", "same_label")


@query
def artifact_counts(spark, d):
    return selectors.artifact_counts(T.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("job_id")))


@query
def checked_tokens(spark, d):
    p = T.table(spark, d, "part")
    return p.select("p_partkey", F.array_join(selectors.checked_tokens(F.concat(F.lit("a To "), "p_name", F.lit("  Part"))), "|").alias("tokens"))


@query
def report_gate(spark, d):
    last = jobs.latest(T.job_events(spark, d), "job_id", ["at", "seq"])
    asked = T.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("job_id"))
    nodes = T.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("job_id"))
    return selectors.gate(asked, last, nodes)
