"""The health report: issues, six dimensions with their metrics, and the overall score, for all jobs in one pass.

Frames (all with job_id): files(id, path, language, lines, classes, functions), classes(id, label, file,
line, lines, methods, is_abstract, has_docstring), functions(id, label, file, line, lines, param_count,
is_method, is_async, cyclomatic, nesting_depth, call_count, has_docstring), edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import grade
from ..operators import coupling, graphalgos, ordering
from ..storage import cut, shuffled, table

# -- Fixed values: thresholds and weights ------------------------------------------------------
CYCLOMATIC_CRITICAL, CYCLOMATIC_HIGH, CYCLOMATIC_MEDIUM = 15, 10, 5
NESTING_CRITICAL, NESTING_HIGH = 5, 3
FN_LINES_CRITICAL, FN_LINES_HIGH = 60, 40
FN_PARAMS_CRITICAL = 7
CLASS_METHODS_CRITICAL, CLASS_METHODS_HIGH, CLASS_LINES_CRITICAL = 20, 12, 400
CE_CRITICAL, CE_HIGH, CA_HIGH = 10, 7, 20
FILE_LINES_CRITICAL, FILE_LINES_HIGH, CLASSES_PER_FILE = 500, 300, 5
INHERIT_DEPTH = 5
GOD_SCORE, LARGE_SCORE = 0.55, 0.35
SLACK = 1e-12  # a sum of weighted doubles may lie this far below the threshold that it equals in decimals
WEIGHTS = {"lines": 0.20, "cyclomatic": 0.30, "params": 0.20, "nesting": 0.15, "calls": 0.15}
DIMENSIONS = (("Complexity", 0.22), ("Coupling", 0.22), ("Size", 0.15), ("Architecture", 0.20), ("Documentation", 0.12), ("Naming", 0.09))
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}

FILE_COLUMNS = ("job_id", "id", "label", "path", "language", "lines", "classes")
CLASS_COLUMNS = ("job_id", "id", "label", "file", "line", "lines", "methods", "is_abstract", "has_docstring")
FUNCTION_COLUMNS = ("job_id", "label", "file", "line", "lines", "param_count", "is_method", "is_async", "cyclomatic", "nesting_depth", "call_count", "has_docstring")  # no issue names a function by its id
ISSUE_COLUMNS = ("job_id", "rule", "category", "severity", "title", "file_path", "line_start", "affected_symbol", "value", "confidence")


@dataclass
class Scope:
    """The source files and their symbols, with the files' languages."""

    all_files: DataFrame
    files: DataFrame
    classes: DataFrame
    functions: DataFrame
    edges: DataFrame
    deals: int | None = None


def scope(files: DataFrame, classes: DataFrame, functions: DataFrame, edges: DataFrame, deals: int | None = None) -> Scope:
    """Classifies files and keeps the symbols of source files; a symbol belongs to the file of its path.

    ``deals``: to how many tasks what is as large as all symbols is dealt; left out, it is the session's number of shuffle partitions.
    """
    sorted_ = files.withColumn("category", rules.category(F.col("path")))
    source = sorted_.where("category = 'source'")
    owner = owners(source)
    of_source = lambda frame: shuffled(dealt(frame.drop("language"), deals, "job_id", "file"), dealt(owner, deals, "job_id", "file"), ["job_id", "file"]).withColumnRenamed("file_language", "language")
    return Scope(sorted_, source, of_source(classes), of_source(functions), edges, deals)


def dealt(frame: DataFrame, n: int | None, *keys: str) -> DataFrame:
    return frame if n is None else frame.repartition(n, *keys)


def touched_files(s: Scope) -> DataFrame:
    """job_id, touched: the files that an edge begins or ends at.  The ends, as many as all symbols, stream past the files: none is sorted or held."""
    ends = s.edges.select("job_id", F.explode(F.array("source_id", "target_id")).alias("id"))
    files = dealt(s.files.select("job_id", "id"), s.deals, "job_id", "id")
    met = dealt(ends, s.deals, "job_id", "id").join(files.distinct().hint("shuffle_hash"), ["job_id", "id"]).distinct()
    return shuffled(files, met, ["job_id", "id"], "left_semi").groupBy("job_id").agg(F.count(F.lit(1)).alias("touched"))


def owners(source: DataFrame) -> DataFrame:
    """job_id, file, file_language of the source files' paths."""
    return source.select("job_id", F.col("path").alias("file"), F.col("language").alias("file_language")).distinct()


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def composite(lines: Column, cyclomatic: Column, params: Column, nesting: Column, calls: Column) -> Column:
    """How much a function does, from 0 to 1; without a cyclomatic figure its weight goes to the lines."""
    w = WEIGHTS
    s_lines = clamp01((lines - FN_LINES_CRITICAL) / F.lit(float(FN_LINES_CRITICAL)))
    s_cyclo = clamp01((cyclomatic - CYCLOMATIC_HIGH) / F.lit(float(CYCLOMATIC_HIGH)))
    s_params = clamp01((params - FN_PARAMS_CRITICAL) / F.lit(float(FN_PARAMS_CRITICAL)))
    s_nesting = clamp01((nesting - NESTING_HIGH) / F.lit(float(NESTING_HIGH)))
    s_calls = clamp01((calls - 8) / F.lit(10.0))
    rest = s_params * w["params"] + s_nesting * w["nesting"] + s_calls * w["calls"]
    return F.when(cyclomatic > 0, s_lines * w["lines"] + s_cyclo * w["cyclomatic"] + rest).otherwise(s_lines * (w["lines"] + w["cyclomatic"]) + rest)


def line_outliers(frame: DataFrame, least_n: int, over: int) -> DataFrame:
    """Adds ``outlier``: at or above the job's 95th percentile of positive line counts, in jobs with enough of them.

    One row for each job is broadcast: a shuffle by job would put all symbols of a job into one task.
    """
    p95 = frame.where("lines > 0").groupBy("job_id").agg(F.percentile("lines", F.lit(0.95)).alias("p95"), F.count(F.lit(1)).alias("n_lines"))
    return frame.join(F.broadcast(p95), "job_id", "left").withColumn("outlier", F.coalesce((F.col("lines") >= F.col("p95")) & (F.col("n_lines") >= least_n) & (F.col("lines") > over), F.lit(False)))


def judged_functions(functions: DataFrame) -> DataFrame:
    """Adds composite, outlier, is_god, is_large and many_params."""
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    scored = line_outliers(functions, 20, FN_LINES_CRITICAL).withColumn("composite", composite(c("lines"), c("cyclomatic"), c("param_count"), c("nesting_depth"), c("call_count")))
    god = (F.col("composite") >= GOD_SCORE - SLACK) | F.col("outlier")
    return scored.withColumn("is_god", god).withColumn("is_large", ~god & ((F.col("composite") >= LARGE_SCORE - SLACK) | (c("lines") > FN_LINES_HIGH))).withColumn("many_params", c("param_count") > FN_PARAMS_CRITICAL)


def judged_classes(classes: DataFrame) -> DataFrame:
    marked = line_outliers(classes, 10, CLASS_LINES_CRITICAL)
    god = (F.col("methods") > CLASS_METHODS_CRITICAL) | (F.col("lines") > CLASS_LINES_CRITICAL) | F.col("outlier")
    return marked.withColumn("is_god", god).withColumn("is_large", ~god & (F.col("methods") > CLASS_METHODS_HIGH))


def found(frame: DataFrame, rule: str, category: str, severity, title: str, confidence, value, file="file", line="line", symbol="label") -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    named = lambda x, kind: (F.col(x) if x else F.lit(None)).cast(kind)
    return frame.select("job_id", F.lit(rule).alias("rule"), F.lit(category).alias("category"), as_column(severity).alias("severity"), F.lit(title).alias("title"), named(file, "string").alias("file_path"), named(line, "int").alias("line_start"), named(symbol, "string").alias("affected_symbol"), as_column(value).cast("double").alias("value"), as_column(confidence).cast("double").alias("confidence"))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def exploded_rules(frame: DataFrame, cases: list[tuple], file: str, line: str | None, symbol: str) -> DataFrame:
    """Issues of one frame in one pass: each case is (condition, rule, category, severity, title, confidence, value)."""
    structs = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(cat).alias("category"), F.lit(sev).alias("severity"), F.lit(title).alias("title"), (conf if isinstance(conf, Column) else F.lit(conf)).cast("double").alias("confidence"), value.cast("double").alias("value"))) for cond, rule, cat, sev, title, conf, value in cases]
    hit = frame.withColumn("hit", F.explode(F.array(*structs))).where("hit is not null")  # a filter by a lambda would have every case interpreted
    return hit.select("job_id", "hit.rule", "hit.category", "hit.severity", "hit.title", F.col(file).alias("file_path"), (F.col(line) if line else F.lit(None)).cast("int").alias("line_start"), F.col(symbol).alias("affected_symbol"), "hit.value", "hit.confidence")


def complexity_issues(functions: DataFrame, classes: DataFrame) -> DataFrame:
    f, cyc, nest = judged_functions(functions), F.coalesce("cyclomatic", F.lit(0)), F.coalesce("nesting_depth", F.lit(0))
    god, large = F.col("is_god"), F.col("is_large")
    cases = [
        (cyc >= CYCLOMATIC_CRITICAL, "I1", "complexity", "critical", "Critical cyclomatic complexity", 1.0, cyc),
        ((cyc >= CYCLOMATIC_HIGH) & (cyc < CYCLOMATIC_CRITICAL), "I2", "complexity", "high", "High cyclomatic complexity", 1.0, cyc),
        ((cyc >= CYCLOMATIC_MEDIUM) & (cyc < CYCLOMATIC_HIGH), "I3", "complexity", "medium", "Moderate cyclomatic complexity", 0.90, cyc),
        (nest >= NESTING_CRITICAL, "I4", "complexity", "high", "Deep nesting", 0.95, nest),
        (god, "I5", "complexity", "high", "God function — doing too much", F.least(F.lit(1.0), 0.5 + F.col("composite") * 0.5), F.col("composite")),
        (large, "I6", "complexity", "medium", "Large function — approaching complexity limit", 0.8, F.col("composite")),
        (F.col("many_params") & ~god, "I7", "complexity", "high", "Too many parameters", 0.95, F.col("param_count")),
    ]
    of_functions = exploded_rules(f, cases, "file", "line", "label")
    cases = [
        (god, "I8", "complexity", "high", "God class — too many responsibilities", 0.85, F.col("methods")),
        (large, "I9", "complexity", "medium", "Large class — starting to accumulate responsibilities", 0.75, F.col("methods")),
    ]
    return of_functions.unionByName(exploded_rules(judged_classes(classes), cases, "file", "line", "label"))


def coupling_issues(files: DataFrame, metrics: DataFrame) -> DataFrame:
    named = metrics.join(files.select("job_id", "id", "path", "label"), ["job_id", "id"])
    cases = [
        (F.col("ce") > CE_CRITICAL, "I10", "coupling", "high", "High efferent coupling — too many outgoing dependencies", 0.90, F.col("ce")),
        ((F.col("ce") > CE_HIGH) & (F.col("ce") <= CE_CRITICAL), "I11", "coupling", "medium", "Elevated efferent coupling", 0.75, F.col("ce")),
        (F.col("ca") > CA_HIGH, "I12", "coupling", "medium", "Critical dependency hub — wide blast radius", 0.85, F.col("ca")),
    ]
    return exploded_rules(named, cases, "path", None, "label")


def size_issues(files: DataFrame) -> DataFrame:
    lines = F.col("lines")
    cases = [
        (lines > FILE_LINES_CRITICAL, "I13", "size", "high", "Oversized source file", 0.90, lines),
        ((lines > FILE_LINES_HIGH) & (lines <= FILE_LINES_CRITICAL), "I14", "size", "low", "Large file — approaching split threshold", 0.80, lines),
        (F.col("classes") > CLASSES_PER_FILE, "I15", "size", "medium", "Multiple classes in one file", 0.85, F.col("classes")),
    ]
    return exploded_rules(files, cases, "path", None, "label")


def architecture_facts(s: Scope, sccs: DataFrame) -> DataFrame:
    """job_id, n_files, n_modules, n_classes, n_abstract, n_cycles of each job with source files."""
    top = F.when(F.size(F.split("path", "/")) > 1, F.get(F.split("path", "/"), F.lit(0)))
    files = s.files.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct(top).alias("n_modules"))
    classes = s.classes.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_classes"), F.count_if(F.coalesce("is_abstract", F.lit(False))).alias("n_abstract"))
    cycles = sccs.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_cycles"))
    return files.join(classes, "job_id", "left").join(cycles, "job_id", "left").na.fill(0)


def architecture_issues(s: Scope, facts: DataFrame, sccs: DataFrame, depths: DataFrame) -> DataFrame:
    ratio = F.col("n_abstract") / F.greatest(F.lit(1), F.col("n_classes"))
    cyc = found(sccs, "I16", "architecture", F.when(F.col("size") <= 3, "high").otherwise("critical"), "Circular dependency", 1.0, F.col("size"), file=None, line=None, symbol="scc")
    low = found(facts.where((F.col("n_classes") > 8) & (ratio < 0.10)), "I17", "architecture", "medium", "Low abstraction coverage", 0.75, ratio, None, None, None)
    flat = found(facts.where((F.col("n_files") > 15) & (F.col("n_modules") < 3)), "I18", "architecture", "medium", "Poor modularisation — flat file structure", 0.70, F.col("n_modules"), None, None, None)
    deep = s.classes.join(depths, ["job_id", "id"]).where(F.col("depth") >= INHERIT_DEPTH)
    return union([cyc, low, flat, found(deep, "I19", "architecture", "medium", "Deep inheritance chain", 0.85, F.col("depth"))])


def public_symbols(s: Scope) -> DataFrame:
    """job_id, kind, id, label, file, line, lines, has_docstring of what should be documented."""
    public = lambda frame: frame.where(~F.col("label").startswith("_") & rules.has_doc_support(F.col("language")))
    id_ = lambda frame: F.col("id") if "id" in frame.columns else F.lit(None).cast("string").alias("id")
    pick = lambda frame, kind: frame.select("job_id", F.lit(kind).alias("kind"), id_(frame), "label", "file", "line", "lines", F.coalesce("has_docstring", F.lit(False)).alias("has_docstring"))
    return pick(public(s.classes), "class").unionByName(pick(public(s.functions).where("lines > 5"), "function"))


def doc_coverage(public: DataFrame) -> DataFrame:
    return public.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_public"), F.count_if(~F.col("has_docstring")).alias("n_undocumented"), F.count_if(~F.col("has_docstring") & (F.col("kind") == "class")).alias("n_undocumented_classes")).withColumn("coverage", 1.0 - F.col("n_undocumented") / F.greatest(F.lit(1), F.col("n_public")))


def doc_coverage_by_file(files: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """``doc_coverage`` of the public symbols of source files, whose numbers meet the files: no symbol is shuffled to its file."""
    public = lambda frame, kind: frame.where(~F.col("label").startswith("_")).select("job_id", "file", F.lit(kind).alias("kind"), (~F.coalesce("has_docstring", F.lit(False))).alias("bare"))
    every = public(classes, "class").unionByName(public(functions.where("lines > 5"), "function"))
    counts = every.groupBy("job_id", "file").agg(F.count(F.lit(1)).alias("n"), F.count_if("bare").alias("n_bare"), F.count_if(F.col("bare") & (F.col("kind") == "class")).alias("n_bare_classes"))
    source = owners(files.where(rules.category(F.col("path")) == "source")).where(rules.has_doc_support(F.col("file_language")))
    met = shuffled(counts, source, ["job_id", "file"]).groupBy("job_id").agg(F.sum("n").alias("n_public"), F.sum("n_bare").alias("n_undocumented"), F.sum("n_bare_classes").alias("n_undocumented_classes"))
    return met.withColumn("coverage", 1.0 - F.col("n_undocumented") / F.greatest(F.lit(1), F.col("n_public")))


def documentation_issues(public: DataFrame, coverage: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    largest = W.partitionBy("job_id").orderBy(F.desc("lines"), "id")
    worst = public.where("kind = 'class' and not has_docstring").withColumn("rn", F.row_number().over(largest)).where("rn <= 5")
    undocumented = found(worst, "I20", "documentation", "medium", "Public class missing docstring", 1.0, F.col("lines"))
    c = F.col("coverage")
    level = coverage.where(c < 0.70).select("job_id", c.alias("value"), F.when(c < 0.30, F.array(F.lit("I21"), F.lit("high"), F.lit("Critical documentation gap"))).when(c < 0.50, F.array(F.lit("I22"), F.lit("medium"), F.lit("Low documentation coverage"))).otherwise(F.array(F.lit("I23"), F.lit("low"), F.lit("Documentation below recommended threshold"))).alias("k"), F.when(c < 0.30, 0.95).when(c < 0.50, 0.90).otherwise(0.80).alias("confidence"))
    none = F.lit(None)
    gap = level.select("job_id", F.get("k", F.lit(0)).alias("rule"), F.lit("documentation").alias("category"), F.get("k", F.lit(1)).alias("severity"), F.get("k", F.lit(2)).alias("title"), none.cast("string").alias("file_path"), none.cast("int").alias("line_start"), none.cast("string").alias("affected_symbol"), "value", "confidence")
    return undocumented.unionByName(gap)


def named_symbols(s: Scope) -> DataFrame:
    """Functions and classes of supported languages with ``ok``."""
    f = s.functions.select("job_id", F.when(F.coalesce("is_method", F.lit(False)), "method").otherwise("function").alias("kind"), "label", "file", "line", "language")
    c = s.classes.select("job_id", F.lit("class").alias("kind"), "label", "file", "line", "language")
    both = f.unionByName(c)
    name, lang, kind = F.col("label"), F.col("language"), F.col("kind")
    short = (kind != "class") & rules.idiomatic_short(name, lang)
    return both.withColumn("supported", rules.has_doc_support(lang)).withColumn("ok", ~F.col("supported") | short | rules.naming_ok(name, lang, kind))


def naming_issues(symbols: DataFrame) -> DataFrame:
    cases = [
        (~F.col("ok") & (F.col("kind") != "class"), "I24", "naming", "low", "Non-standard function name", 0.8, F.lit(1.0)),
        (~F.col("ok") & (F.col("kind") == "class"), "I25", "naming", "low", "Non-standard class name", 0.8, F.lit(1.0)),
    ]
    return exploded_rules(symbols, cases, "file", "line", "label")


def score(penalty: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), (F.lit(100.0) - penalty).cast("int")))


def ratio(n: Column, of: Column) -> Column:
    return n / F.greatest(F.lit(1), of)


def dimensions(s: Scope, metrics: DataFrame, facts: DataFrame, coverage: DataFrame, symbols: DataFrame) -> DataFrame:
    """job_id, dimension, score, confidence: one row for each of the six dimensions of every job with files."""
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    f = judged_functions(s.functions).groupBy("job_id").agg(F.count(F.lit(1)).alias("fns"), n(F.col("is_god")).alias("god"), n(F.col("is_large")).alias("large"), n(F.col("many_params")).alias("params"), n(F.col("lines") > 0).alias("with_lines"), n(F.col("cyclomatic") > 0).alias("with_cyclo"))
    c = judged_classes(s.classes).groupBy("job_id").agg(F.count(F.lit(1)).alias("cls"), n(F.col("is_god")).alias("god_cls"))
    k = metrics.groupBy("job_id").agg(n(F.col("ce") > CE_CRITICAL).alias("fanout"), n(F.col("ca") > CA_HIGH).alias("hubs"))
    z = s.files.groupBy("job_id").agg(F.count(F.lit(1)).alias("files"), n(F.col("lines") > FILE_LINES_CRITICAL).alias("oversized"), n(F.col("lines") > 0).alias("files_with_lines"))
    touched = touched_files(s)
    y = symbols.groupBy("job_id").agg(n(F.col("supported")).alias("supported"), n(~F.col("ok")).alias("bad"), F.count(F.lit(1)).alias("symbols"))
    jobs = s.all_files.select("job_id").distinct()
    j = jobs
    for frame in (f, c, k, z, touched, facts.drop("n_files"), coverage, y):
        j = j.join(frame, "job_id", "left")
    coverage_ = F.coalesce("coverage", F.lit(1.0))
    j = j.na.fill(0, subset=[x for x in j.columns if x not in ("job_id", "coverage")])
    col = F.col
    complexity = score(ratio(col("god"), col("fns")) * 50 + ratio(col("large"), col("fns")) * 15 + ratio(col("god_cls"), col("cls")) * 35 + ratio(col("params"), col("fns")) * 20)
    lines_known, cyclo_known = F.round(ratio(col("with_lines"), col("fns")), 3), F.round(ratio(col("with_cyclo"), col("fns")), 3)
    complexity_conf = F.when(col("fns") == 0, 0.1).when(col("with_cyclo") > 0, F.least(F.lit(1.0), F.round((lines_known + cyclo_known) / 2, 3))).otherwise(lines_known)
    edges_known = F.when(col("files") == 0, 0.0).otherwise(F.round(ratio(col("touched"), col("files")), 3))
    abstraction = ratio(col("n_abstract"), col("n_classes"))
    flat = F.when((col("files") > 15) & (col("n_modules") < 3), 8).otherwise(0)
    architecture = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - col("n_cycles") * 18 - flat + F.least(F.lit(12), (abstraction * 50).cast("int")))).cast("int")
    no_files = col("files") == 0
    rows = [
        ("Complexity", F.when(col("fns") == 0, 100).otherwise(complexity), complexity_conf),
        ("Coupling", F.when(no_files, 100).otherwise(score(ratio(col("fanout"), col("files")) * 55 + ratio(col("hubs"), col("files")) * 25)), edges_known),
        ("Size", F.when(no_files, 100).otherwise(score(ratio(col("oversized"), col("files")) * 60)), F.when(no_files, 0.0).otherwise(F.round(ratio(col("files_with_lines"), col("files")), 3))),
        ("Architecture", F.when(no_files, 100).otherwise(architecture), edges_known),
        ("Documentation", F.when(col("n_public") == 0, 100).otherwise(F.least(F.lit(100), (coverage_ * 100).cast("int"))), F.when(col("n_public") == 0, 0.1).otherwise(1.0)),
        ("Naming", F.when(col("symbols") == 0, 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), ((1.0 - ratio(col("bad"), col("supported"))) * 100).cast("int")))), F.when(col("symbols") == 0, 0.0).otherwise(F.round(ratio(col("supported"), col("symbols")), 3))),
    ]
    weights = dict(DIMENSIONS)
    structs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(name).alias("dimension"), s_.cast("int").alias("score"), conf.cast("double").alias("confidence"), F.lit(weights[name]).alias("weight")) for i, (name, s_, conf) in enumerate(rows)])
    return j.select("job_id", F.inline(structs)).withColumn("grade", grade(F.col("score")))


def overall(dims: DataFrame) -> DataFrame:
    """job_id, overall_score, overall_grade, overall_confidence, weakest."""
    parts = F.sort_array(F.collect_list(F.struct("position", "score", "weight", "confidence")))
    total = lambda field: F.aggregate("parts", F.lit(0.0), lambda a, x: a + x[field] * x["weight"])
    summed = dims.groupBy("job_id").agg(parts.alias("parts"), F.min_by("dimension", F.struct("score", "position")).alias("weakest"))
    scored = summed.select("job_id", F.greatest(F.lit(0), F.least(F.lit(100), total("score").cast("int"))).alias("overall_score"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total("confidence"))), 3).alias("overall_confidence"), "weakest")
    return scored.withColumn("overall_grade", grade(F.col("overall_score")))


def metric_rows(s: Scope, metrics: DataFrame, facts: DataFrame, coverage: DataFrame, public: DataFrame, symbols: DataFrame) -> DataFrame:
    """job_id, dimension, metric, value, score: the labelled figures below the dimensions."""
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    pos = lambda x: F.greatest(F.lit(0), x.cast("int"))
    eff = F.greatest(F.lit(0), F.col("param_count") - F.when(F.coalesce("is_method", F.lit(False)), 1).otherwise(0))
    lines, cyc = F.when(F.col("lines") > 0, F.col("lines")), F.when(F.col("cyclomatic") > 0, F.col("cyclomatic"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    f = judged_functions(s.functions).groupBy("job_id").agg(F.count(F.lit(1)).alias("fns"), n(F.col("is_god")).alias("god"), n(F.col("is_large")).alias("large"), n(F.col("many_params")).alias("params"), n(F.col("cyclomatic") >= CYCLOMATIC_HIGH).alias("high_cyc"), zero(F.avg(cyc)).alias("avg_cyc"), zero(F.max(cyc)).alias("max_cyc"), zero(F.median(lines)).alias("med_lines"), zero(F.avg(lines)).alias("avg_lines"), zero(F.avg(eff)).alias("avg_params"))
    c = judged_classes(s.classes).groupBy("job_id").agg(F.count(F.lit(1)).alias("cls"), n(F.col("is_god")).alias("god_cls"))
    k = metrics.groupBy("job_id").agg(n(F.col("ce") > CE_CRITICAL).alias("fanout"), n(F.col("ca") > CA_HIGH).alias("hubs"), zero(F.avg("instability")).alias("instability"))
    z = s.files.groupBy("job_id").agg(F.count(F.lit(1)).alias("files"), n(F.col("lines") > FILE_LINES_CRITICAL).alias("oversized"), n((F.col("lines") > FILE_LINES_HIGH) & (F.col("lines") <= FILE_LINES_CRITICAL)).alias("watch"), zero(F.median(lines)).alias("med_size"))
    inherits = s.edges.where("relationship = 'INHERITS'").groupBy("job_id").agg(F.count(F.lit(1)).alias("inherits"))
    d = public.groupBy("job_id").agg(n((F.col("kind") == "class") & F.col("has_docstring")).alias("doc_cls"), n((F.col("kind") == "class") & ~F.col("has_docstring")).alias("undoc_cls"), n((F.col("kind") == "function") & F.col("has_docstring")).alias("doc_fns"), n((F.col("kind") == "function") & ~F.col("has_docstring")).alias("undoc_fns"))
    y = symbols.groupBy("job_id").agg(n(~F.col("ok") & (F.col("kind") != "class")).alias("bad_fns"), n(~F.col("ok") & (F.col("kind") == "class")).alias("bad_cls"), n(F.col("supported")).alias("supported"), n(~F.col("supported")).alias("unsupported"))
    j = s.all_files.select("job_id").distinct()
    for frame in (f, c, k, z, facts.drop("n_files"), inherits, coverage, d, y):
        j = j.join(frame, "job_id", "left")
    j = j.withColumn("coverage", F.coalesce("coverage", F.lit(1.0))).na.fill(0)
    col = F.col
    pct = lambda a, b: ratio(col(a), col(b))
    abstraction = pct("n_abstract", "n_classes")
    compliance = 1.0 - ratio(col("bad_fns") + col("bad_cls"), col("supported"))
    rows = [
        ("Complexity", "Functions Analysed", col("fns"), F.lit(100)), ("Complexity", "God Functions", col("god"), 100 - (pct("god", "fns") * 100).cast("int")), ("Complexity", "Large Functions", col("large"), 100 - (pct("large", "fns") * 60).cast("int")),
        ("Complexity", "God Classes", col("god_cls"), 100 - (pct("god_cls", "cls") * 100).cast("int")), ("Complexity", "High-Param Functions", col("params"), 100 - (pct("params", "fns") * 100).cast("int")), ("Complexity", "High Cyclomatic", col("high_cyc"), 100 - 5 * col("high_cyc")),
        ("Complexity", "Avg Cyclomatic", col("avg_cyc"), (100 - F.greatest(F.lit(0), col("avg_cyc") - 3) * 6).cast("int")), ("Complexity", "Max Cyclomatic", col("max_cyc"), 100 - F.greatest(F.lit(0), col("max_cyc") - 5) * 5), ("Complexity", "Median Length", col("med_lines"), (100 - F.greatest(F.lit(0), col("med_lines") - 15) * 1.5).cast("int")),
        ("Complexity", "Avg Length", col("avg_lines"), (100 - F.greatest(F.lit(0), col("avg_lines") - 15) * 1.5).cast("int")), ("Complexity", "Avg Parameters", col("avg_params"), (100 - F.greatest(F.lit(0), col("avg_params") - 2) * 15).cast("int")),
        ("Coupling", "High Fan-out Files", col("fanout"), 100 - (pct("fanout", "files") * 100).cast("int")), ("Coupling", "Dependency Hubs", col("hubs"), 100 - (pct("hubs", "files") * 100).cast("int")), ("Coupling", "Avg Instability", col("instability"), ((1 - col("instability")) * 100).cast("int")),
        ("Size", "Source Files", col("files"), F.lit(100)), ("Size", "Oversized Files", col("oversized"), 100 - (pct("oversized", "files") * 100).cast("int")), ("Size", "Watch-list Files", col("watch"), 100 - 5 * col("watch")), ("Size", "Median Size", col("med_size"), (100 - F.greatest(F.lit(0), col("med_size") - 80) * 0.12).cast("int")),
        ("Size", "Classes per File", pct("cls", "files"), (100 - F.greatest(F.lit(0), pct("cls", "files") - 1) * 20).cast("int")),
        ("Architecture", "Circular Dependencies", col("n_cycles"), 100 - 25 * col("n_cycles")), ("Architecture", "Modules", col("n_modules"), F.lit(100)), ("Architecture", "Abstract Classes", col("n_abstract"), F.least(F.lit(100), (abstraction * 200).cast("int"))), ("Architecture", "Abstraction Ratio", abstraction, F.least(F.lit(100), (abstraction * 200).cast("int"))), ("Architecture", "Inheritance Edges", col("inherits"), F.lit(100)),
        ("Documentation", "Doc Coverage", col("coverage"), F.least(F.lit(100), (col("coverage") * 100).cast("int"))), ("Documentation", "Public Classes Documented", col("doc_cls"), 100 - 10 * col("undoc_cls")), ("Documentation", "Undocumented Public Classes", col("undoc_cls"), 100 - 10 * col("undoc_cls")), ("Documentation", "Public Functions Documented", col("doc_fns"), 100 - 3 * col("undoc_fns")), ("Documentation", "Total Public Symbols", col("n_public"), F.lit(100)),
        ("Naming", "Naming Compliance", compliance, (compliance * 100).cast("int")), ("Naming", "Bad Function Names", col("bad_fns"), 100 - 5 * col("bad_fns")), ("Naming", "Bad Class Names", col("bad_cls"), 100 - 8 * col("bad_cls")), ("Naming", "Unsupported Symbols", col("unsupported"), F.lit(100)),
    ]
    structs = F.array(*[F.struct(F.lit(dim).alias("dimension"), F.lit(name).alias("metric"), value.cast("double").alias("value"), pos(sub).alias("score")) for dim, name, value, sub in rows])
    return j.select("job_id", F.inline(structs))


@dataclass
class Report:
    """All frames of the report, keyed by job_id."""

    issues: DataFrame
    dimensions: DataFrame
    metrics: DataFrame
    overall: DataFrame
    coverage: DataFrame
    stats: DataFrame


def coverage_counts(files: DataFrame) -> DataFrame:
    n = lambda *kinds: F.count_if(F.col("category").isin(*kinds))
    return files.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_files"), n("source").alias("source_files"), n("test").alias("test_files"), n("generated").alias("generated_files"), n("vendor").alias("vendor_files"), n("config", "docs").alias("config_files"), n("unknown").alias("unsupported_files"), F.lit(0).alias("skipped_files"), F.lit(1.0).alias("coverage_pct"))


def dominant_language(files: DataFrame) -> DataFrame:
    """The language of most files of each job; of equals the first by name."""
    counts = files.groupBy("job_id", "language").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("job_id").agg(F.max_by("language", F.struct("n", F.translate("language", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))).alias("dominant_language"))


def stats(s: Scope, issues: DataFrame) -> DataFrame:
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    j = s.all_files.groupBy("job_id").agg(n(F.col("category") == "source").alias("files"), n(F.col("category") == "test").alias("test_files"))
    f = s.functions.groupBy("job_id").agg(F.count(F.lit(1)).alias("functions"), n(F.col("is_async")).alias("async_functions"), n(F.col("has_docstring")).alias("documented_fns"))
    c = s.classes.groupBy("job_id").agg(F.count(F.lit(1)).alias("classes"), n(F.col("has_docstring")).alias("documented_classes"))
    i = issues.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_issues"), *[n(F.col("severity") == x).alias(f"{x}_issues") for x in ("critical", "high", "medium", "low")])
    e = s.edges.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_edges"))
    for frame in (f, c, i, e):
        j = j.join(frame, "job_id", "left")
    return j.na.fill(0).join(dominant_language(s.files), "job_id", "left").withColumn("dominant_language", F.coalesce("dominant_language", F.lit("unknown")))


def issue_order() -> list[Column]:
    """By severity, then path; ties by rule, symbol and line."""
    rank = F.lit(5)
    for name, r in SEVERITY_RANK.items():
        rank = F.when(F.col("severity") == name, r).otherwise(rank)
    return [rank, F.coalesce(F.col("file_path"), F.lit("")), F.col("rule"), F.coalesce(F.col("affected_symbol"), F.lit("")), F.col("line_start")]


def sorted_issues(issues: DataFrame) -> DataFrame:
    return issues.orderBy("job_id", *issue_order())


def ranked_issues(issues: DataFrame) -> DataFrame:
    """The issues with their ``place`` in their job's order, numbered by ranges: a job's issues may span any number of tasks."""
    return ordering.numbered(table(issues, "issues"), issue_order(), "place", within=["job_id"])


def report(files: DataFrame, classes: DataFrame, functions: DataFrame, edges: DataFrame, deals: int | None = None) -> Report:
    """The report's frames.  Files and the symbols of source files are written once, by the columns that it reads; edges are read where they are
    wanted, by their relationship, as their ends are as many as all symbols.  ``deals``: see ``scope``."""
    s = scope(table(files.select(*FILE_COLUMNS), "files"), classes.select(*CLASS_COLUMNS), functions.select(*FUNCTION_COLUMNS), edges, deals)
    s = Scope(s.all_files, s.files, table(s.classes, "classes"), table(s.functions, "functions"), edges, deals)
    pairs = table(coupling.internal_dependencies(s.files, edges), "pairs")
    metrics = table(coupling.coupling(s.files, edges, pairs), "coupling")
    sccs = cut(graphalgos.cycles(pairs))
    facts = cut(architecture_facts(s, sccs))
    depths = graphalgos.chain_depth(edges.where("relationship = 'INHERITS'"))
    public = public_symbols(s)
    docs = doc_coverage(public)
    symbols = named_symbols(s)
    issues = union([complexity_issues(s.functions, s.classes), coupling_issues(s.files, metrics), size_issues(s.files), architecture_issues(s, facts, sccs, depths), documentation_issues(public, docs), naming_issues(symbols)])
    dims = dimensions(s, metrics, facts, docs, symbols)
    return Report(issues, dims, metric_rows(s, metrics, facts, docs, public, symbols), overall(dims), coverage_counts(s.all_files), stats(s, issues))
