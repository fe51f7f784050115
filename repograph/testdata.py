"""The testbed's tables seen as repositories, graphs, jobs and texts.

Regions are jobs; customers and suppliers are files, orders classes, line items functions; what a
customer buys in large quantity is what its file imports.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text
from .storage import shuffled, tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class View:
    files: DataFrame
    classes: DataFrame
    functions: DataFrame
    edges: DataFrame


def customers(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.col("r_name").alias("job_id"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("src/"), F.lower(F.translate("n_name", " ", "_")), F.lit("/file_"), "c_custkey", F.lit(".py")).alias("path"), F.floor(F.abs("c_acctbal") / 10).cast("int").alias("lines"))


def imports(spark: SparkSession, d: str) -> DataFrame:
    """Distinct job_id, source_id, target_id: a customer's file and the suppliers of its large orders."""
    items = table(spark, d, "lineitem")
    n = tasks(items.count())
    lines = items.where("l_quantity >= 40").select("l_orderkey", "l_suppkey").repartition(n, "l_orderkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey")
    met = shuffled(lines, orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "l_suppkey").repartition(n, "c_custkey").distinct()
    return shuffled(met, customers(spark, d).select("c_custkey", "job_id", "id").repartition(n, "c_custkey"), "c_custkey").select("job_id", F.col("id").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"))


def view(spark: SparkSession, d: str) -> View:
    c = customers(spark, d)
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    n = tasks(items.count())  # both sides of a join of orders are dealt to as many tasks
    of_customer = c.select("c_custkey", "job_id", F.col("id").alias("file_id"), F.col("path").alias("file")).repartition(n, "c_custkey")
    placed = shuffled(orders.repartition(n, "o_custkey"), of_customer, F.col("o_custkey") == F.col("c_custkey")).repartition(n, "o_orderkey")
    items = items.repartition(n, "l_orderkey")
    counts = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    classes = shuffled(placed, counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "job_id", F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.when(F.col("o_orderkey") % 7 == 0, "order_").otherwise("Order"), F.col("o_orderkey").cast("string")).alias("label"), "file", "file_id", F.lit(1).alias("line"),
        (F.col("o_totalprice") / 500).cast("int").alias("lines"), (F.coalesce("n", F.lit(0)) * 3).alias("methods"), (F.col("o_orderstatus") == "P").alias("is_abstract"), (F.col("o_orderpriority") < "3").alias("has_docstring"), F.lit("python").alias("language"),
    )
    number = F.col("l_linenumber")
    functions = shuffled(items, placed.select("o_orderkey", "job_id", "file"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "job_id", F.concat_ws("_", F.concat(F.lit("l"), "l_orderkey"), number.cast("string")).alias("id"), F.when(number % 3 == 0, F.concat(F.lit("getItem"), number)).otherwise(F.concat(F.lit("get_item_"), F.col("l_partkey") % 50)).alias("label"), "file", F.concat(F.lit("o"), "o_orderkey").alias("class_id"),
        number.alias("line"), (F.col("l_quantity") * 2).cast("int").alias("lines"), (number + 5).alias("param_count"), F.lit(True).alias("is_method"), (F.col("l_linestatus") == "O").alias("is_async"), (F.col("l_orderkey") % 20).cast("int").alias("cyclomatic"),
        (F.col("l_partkey") % 7).cast("int").alias("nesting_depth"), (F.col("l_suppkey") % 20).cast("int").alias("call_count"), (F.col("l_returnflag") == "N").alias("has_docstring"), F.lit("python").alias("language"),
    )
    pairs = imports(spark, d)
    per_file = classes.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("classes"))
    own = c.join(per_file, F.col("id") == F.col("file_id"), "left").select("job_id", "id", F.element_at(F.split("path", "/"), -1).alias("label"), "path", F.lit("python").alias("language"), "lines", F.coalesce("classes", F.lit(0)).alias("classes"), F.lit(1).alias("functions"))
    size = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("sup_"), "s_suppkey", F.lit(".ts")).alias("label"), F.floor(F.abs("s_acctbal") / 20).cast("int").alias("lines"))
    shared = pairs.select("job_id", F.col("target_id").alias("id")).distinct().join(size, "id").select("job_id", "id", "label", F.concat(F.lit("lib/shared/"), "label").alias("path"), F.lit("typescript").alias("language"), "lines", F.lit(0).alias("classes"), F.lit(1).alias("functions"))
    kind = lambda frame, s, t, r: frame.select("job_id", F.col(s).alias("source_id"), F.col(t).alias("target_id"), F.lit(r).alias("relationship"))
    edges = kind(pairs, "source_id", "target_id", "IMPORTS").unionByName(kind(pairs, "source_id", "target_id", "DEPENDS_ON")).unionByName(kind(classes, "file_id", "id", "CONTAINS")).unionByName(kind(functions, "class_id", "id", "CONTAINS"))
    return View(own.unionByName(shared), classes, functions, edges)


def nation_graph(spark: SparkSession, d: str, quantile: float = 0.8) -> DataFrame:
    """job_id, source_id, target_id: trade between nations above a quantile of the number of line items."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("a"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    met = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    weights = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    least = weights.agg(F.percentile("w", F.lit(quantile)).alias("least"))
    kept = weights.crossJoin(F.broadcast(least)).where("w >= least and a <> b")
    named = kept.join(n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("source_id")), "a").join(n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("target_id")), "b")
    return named.select(F.lit("nations").alias("job_id"), "source_id", "target_id", F.lit("IMPORTS").alias("relationship"))


def inheritance(spark: SparkSession, d: str) -> DataFrame:
    """Part p inherits from part p div 2."""
    p = table(spark, d, "part").where("p_partkey > 1")
    return p.select(F.lit("parts").alias("job_id"), F.col("p_partkey").cast("string").alias("source_id"), F.floor(F.col("p_partkey") / 2).cast("long").cast("string").alias("target_id"))


# One CASE over documents gives paths of every kind; the same text runs in both engines.
PATH_SQL = """CASE doc_id % 20
 WHEN 0 THEN concat('src/app/', source, '/service_', doc_id, '.py') WHEN 1 THEN concat('tests/unit/test_', doc_id, '.py')
 WHEN 2 THEN concat('docs/guide_', doc_id, '.md') WHEN 3 THEN concat('node_modules/', source, '/index.js')
 WHEN 4 THEN concat('src/domain/models/Order', doc_id, '.java') WHEN 5 THEN concat('web/frontend/components/View', doc_id, '.tsx')
 WHEN 6 THEN concat('db/migrations/0001_', doc_id, '.sql') WHEN 7 THEN 'package.json'
 WHEN 8 THEN concat('config/.app', doc_id, '.yaml') WHEN 9 THEN concat('assets/logo', doc_id, '.png')
 WHEN 10 THEN concat('src/gen/api_', doc_id, '_pb2.py') WHEN 11 THEN concat('src/utils/my_testimony_', doc_id, '.py')
 WHEN 12 THEN concat('README', doc_id, '.rst') WHEN 13 THEN concat('data/settings', doc_id, '.json')
 WHEN 14 THEN concat('build/out', doc_id, '.js') WHEN 15 THEN concat('20240101_', doc_id, '.sql')
 WHEN 16 THEN concat('src/infrastructure/persistence/OrderRepository', doc_id, '.java') WHEN 17 THEN concat('web/pages/index', doc_id, '.jsx')
 WHEN 18 THEN concat('.github/workflows/ci', doc_id, '.yml') ELSE concat('src/presentation/routers/user_router', doc_id, '.ts') END"""


def repository(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of four jobs (their languages): job_id, path, size, doc_id."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("lang").alias("job_id"), F.expr(PATH_SQL).alias("path"), F.col("n_chars").alias("size"), "doc_id", "source")


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic source files in three languages, a row for each part: job_id, path, content."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey").cast("string")
    ifs = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 5 + 1), lambda i: F.concat(F.lit("    if a > "), i, F.lit(":\n        b = run(a)\n"))), "")
    python = F.concat(F.lit("import os\nfrom pkg.util_"), (F.col("p_partkey") % 10).cast("string"), F.lit(' import x\n\nclass Part'), k, F.lit('(Base):\n    """Doc."""\n    def size(self, a):\n        return a\n\ndef get_part(a, b):\n'), ifs, F.lit("    return a and b\n"))
    blocks = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 5 + 1), lambda i: F.concat(F.lit("  if (a > "), i, F.lit(") { run(a); }\n"))), "")
    script = F.concat(F.lit("import { x } from './part_"), k, F.lit("';\nexport class View"), k, F.lit(" extends Base {\n  render(a: number): void {\n    draw(a);\n  }\n}\n\nexport function load(a, b) {\n"), blocks, F.lit("  return a && b;\n}\n"))
    java = F.concat(F.lit("import com.acme.Base;\npublic class Item"), k, F.lit(" extends Base {\n  public int size(int a, int b) {\n"), blocks, F.lit("    return a;\n  }\n}\n"))
    which = F.col("p_partkey") % 3
    path = F.when(which == 0, F.concat(F.lit("pkg/mod_"), F.col("p_partkey") % 7, F.lit("/util_"), k, F.lit(".py"))).when(which == 1, F.concat(F.lit("web/view_"), k, F.lit(".ts"))).otherwise(F.concat(F.lit("java/acme/Item"), k, F.lit(".java")))
    return p.select(F.lit("synthetic").alias("job_id"), path.alias("path"), F.when(which == 0, python).when(which == 1, script).otherwise(java).alias("content"))


def job_events(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as job events: job_id, at, seq, status."""
    status = F.element_at(F.create_map(*[F.lit(x) for pair in (("signup", "pending"), ("view", "running"), ("click", "running"), ("purchase", "completed"), ("error", "failed")) for x in pair]), F.col("event_type"))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), status.alias("status"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("repo_url"), "text", F.col("source").alias("source_symbol"), F.expr(PATH_SQL).alias("source_file"))


def click_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each click leads to its client's click before it: a chain for each client, the job."""
    rows = table(spark, d, "clicks").where("client_id is not null and ts is not null and click_id is not null").select("client_id", "ts", "click_id").distinct()
    before = F.lag("click_id").over(W.partitionBy("client_id").orderBy("ts", "click_id"))
    pairs = rows.select(F.col("client_id").cast("string").alias("job_id"), F.col("click_id").cast("string").alias("source_id"), before.cast("string").alias("target_id"))
    return pairs.where("target_id is not null")


def parent_parts(spark: SparkSession, d: str) -> DataFrame:
    """Part p descends from part p * p + 1 modulo the number of parts: ways that end in loops."""
    p = table(spark, d, "part")
    most = p.agg(F.max("p_partkey").alias("most"))
    parent = (F.col("p_partkey") * F.col("p_partkey") + 1) % F.col("most") + 1
    return p.join(F.broadcast(most)).select(F.lit("parts").alias("job_id"), F.col("p_partkey").cast("string").alias("source_id"), parent.cast("string").alias("target_id"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The passages of ``benchmark`` as questions: question and its words."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question"), text.keywords(F.col("text")).alias("words"))
