"""Parsed files to a property graph: typed node frames, edges, and the generic nodes and edges.

Every step is a projection, an explode or an equi-join; import targets that no exact name gives go by
their exploded endings, over unmatched imports only.  The parsed frame is read in many branches: see ``parsers.parsed_once``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ancestors, last_segment, node_id, normal_path, parent_path, path_parts
from ..storage import shuffled


@dataclass
class Graph:
    """Typed frames of many jobs at once."""

    repositories: DataFrame
    modules: DataFrame
    files: DataFrame
    classes: DataFrame
    functions: DataFrame
    edges: DataFrame

    def nodes(self) -> DataFrame:
        """All nodes with their properties as JSON."""
        parts = []
        for kind, frame in (("Repository", self.repositories), ("Module", self.modules), ("File", self.files), ("Class", self.classes), ("Function", self.functions)):
            properties = [c for c in frame.columns if c not in ("id", "label", "job_id")]
            parts.append(frame.select("id", "label", F.lit(kind).alias("node_type"), "job_id", F.to_json(F.struct(*properties)).alias("properties")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def persisted(self) -> tuple[DataFrame, DataFrame]:
        """What a store keeps: a node or edge for each id."""
        return self.nodes().dropDuplicates(["job_id", "id"]), self.edges.dropDuplicates(["job_id", "id"])


def edge(frame: DataFrame, source: str, target: str, relationship: str) -> DataFrame:
    s, t = F.col(source), F.col(target)
    return frame.select(F.sha2(F.concat_ws("|", F.lit(relationship), s, t), 256).alias("id"), s.alias("source_id"), t.alias("target_id"), F.lit(relationship).alias("relationship"), "job_id")


def filled(column) -> F.Column:
    return F.length(F.trim(F.coalesce(column, F.lit("")))) > 0


def target_names(path) -> F.Column:
    """Names by which an import can mean a file: its stem and its dotted suffixes; none unless a segment ends in .py."""
    parts = path_parts(path)
    at = F.array_position(F.transform(parts, lambda p: p.endswith(".py")), True).cast("int")
    stem = F.regexp_replace(F.element_at(parts, at), r"\.py$", "")
    below = F.slice(parts, at + 1, F.size(parts))
    inside = F.when(F.size(below) > 0, F.array(F.array_join(below, "."))).otherwise(F.array().cast("array<string>"))
    inside = F.concat(inside, F.when(F.size(below) > 1, F.array(F.array_join(F.slice(below, 1, F.size(below) - 1), "."))).otherwise(F.array().cast("array<string>")))
    suffixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))
    return F.when(at > 0, F.array_distinct(F.concat(inside, F.array(stem), suffixes))).otherwise(F.array().cast("array<string>"))


def resolve_imports(imports: DataFrame, targets: DataFrame) -> DataFrame:
    """job_id, source, module and job_id, target, name -> distinct job_id, source, module, target.

    First by the module's name or its last part; imports without any such target meet the
    names of their job that end with the module, or that the module ends with.  Modules and names are met once each, whoever
    asks for them, and the joins are by shuffles: either side grows with the files, and a broadcast would pass it whole through the driver.
    """
    plain = F.regexp_replace("module", r"^\.+|\.+$", "")
    asked = imports.select("job_id", "source", plain.alias("module")).distinct()
    keys = asked.withColumn("name", F.explode(F.array_distinct(F.array("module", F.element_at(F.split("module", r"\."), -1))))).where("name <> ''")
    exact = shuffled(keys, targets, ["job_id", "name"]).select("job_id", "source", "module", "target").distinct()
    left = shuffled(asked, exact.select("job_id", "source", "module").distinct(), ["job_id", "source", "module"], "left_anti")
    # Names and modules are short, so each way round is an equi-join on all endings of one side (the empty one included).
    endings = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substr(F.col(c), i)))
    modules, names = left.select("job_id", "module").distinct(), targets.select("job_id", "name").distinct()
    by_name = shuffled(names.select("job_id", "name", endings("name").alias("module")), modules, ["job_id", "module"])
    by_module = shuffled(modules.select("job_id", "module", endings("module").alias("name")), names, ["job_id", "name"])
    met = by_name.select("job_id", "module", "name").unionByName(by_module.select("job_id", "module", "name")).distinct()
    loose = shuffled(shuffled(met, left, ["job_id", "module"]), targets, ["job_id", "name"]).select("job_id", "source", "module", "target")
    return exact.unionByName(loose).where("source <> target").distinct()


def build(parsed: DataFrame, repositories: DataFrame) -> Graph:
    """parsed: schemas.PARSED; repositories: job_id, name, url."""
    path = normal_path(F.col("path"))
    repos = repositories.select(node_id(F.col("job_id"), "repo", F.col("name")).alias("id"), F.col("name").alias("label"), "job_id", "url", "name")
    modules = parsed.select("job_id", F.explode(ancestors(F.col("path"))).alias("path")).distinct().select(node_id(F.col("job_id"), "module", F.col("path")).alias("id"), last_segment(F.col("path")).alias("label"), "job_id", "path")
    kept = parsed.where((F.size("parse_errors") == 0) | (F.size("classes") > 0)).withColumn("file_id", node_id(F.col("job_id"), "file", path)).withColumn("npath", path)
    files = kept.select(F.col("file_id").alias("id"), last_segment(F.col("npath")).alias("label"), "job_id", F.col("npath").alias("path"), "language", F.col("line_count").alias("lines"), F.size("classes").alias("classes"), (F.size("functions") + F.aggregate("classes", F.lit(0), lambda a, c: a + F.size(c["methods"]))).alias("functions"))
    each = kept.select("job_id", "file_id", "npath", "language", F.posexplode("classes").alias("seq", "c"))
    span = lambda x: x["line_end"] - x["line_start"] + 1
    c = F.col("c")
    with_id = each.withColumn("class_id", node_id(F.col("job_id"), "class", F.concat_ws("_", "npath", c["name"])))
    classes = with_id.select(
        F.col("class_id").alias("id"), c["name"].alias("label"), "job_id", F.col("npath").alias("file"), c["line_start"].alias("line"), span(c).alias("lines"), F.size(c["methods"]).alias("methods"),
        F.array_join(c["base_classes"], ", ").alias("base_classes"), F.exists(c["base_classes"], lambda b: b.isin("ABC", "ABCMeta")).alias("is_abstract"), filled(c["docstring"]).alias("has_docstring"), F.array_join(c["decorators"], ", ").alias("decorators"), "language",
    )
    methods = with_id.select("job_id", "npath", "language", F.col("class_id").alias("owner"), c["name"].alias("class_name"), F.explode(c["methods"]).alias("f"))
    free = kept.select("job_id", "npath", "language", F.col("file_id").alias("owner"), F.lit(None).cast("string").alias("class_name"), F.explode("functions").alias("f"))
    f = F.col("f")
    called = methods.unionByName(free).withColumn("fn_id", node_id(F.col("job_id"), "fn", F.concat_ws("_", "npath", "class_name", f["name"])))
    functions = called.select(
        F.col("fn_id").alias("id"), f["name"].alias("label"), "job_id", F.col("npath").alias("file"), f["line_start"].alias("line"), f["is_async"].alias("is_async"), f["is_method"].alias("is_method"), F.array_join(f["parameters"], ", ").alias("parameters"), F.size(f["parameters"]).alias("param_count"),
        span(f).alias("lines"), filled(f["docstring"]).alias("has_docstring"), F.array_join(f["decorators"], ", ").alias("decorators"), f["cyclomatic"].alias("cyclomatic"), f["branch_count"].alias("branch_count"), f["nesting_depth"].alias("nesting_depth"), f["call_count"].alias("call_count"), "language",
    )

    # Containment: a module's or file's parent is the directory above it, the repository at the top.
    # Modules are all directories above the parsed files, so a parent's id needs no join; only what has none meets its repository.
    top = repos.select("job_id", F.col("id").alias("holder"))

    def contained(frame: DataFrame, parent) -> DataFrame:
        placed = frame.select("job_id", "id", parent.alias("parent"))
        inside = placed.where("parent is not null").select("job_id", "id", node_id(F.col("job_id"), "module", F.col("parent")).alias("holder")).where("holder is not null")
        return edge(inside.unionByName(shuffled(placed.where("parent is null"), top, "job_id").select("job_id", "id", "holder")), "holder", "id", "CONTAINS")

    parts = path_parts(F.col("path"))
    nearest = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(4))), "/"))
    edges = contained(modules, parent_path(F.col("path"))).unionByName(contained(files, nearest))
    edges = edges.unionByName(edge(with_id, "file_id", "class_id", "CONTAINS")).unionByName(edge(called, "owner", "fn_id", "CONTAINS"))
    names = files.select("job_id", F.col("id").alias("target"), F.explode(target_names(F.col("path"))).alias("name"))
    asked = kept.select("job_id", F.col("file_id").alias("source"), F.explode("imports").alias("i")).select("job_id", "source", F.col("i.module").alias("module"))
    resolved = resolve_imports(asked, names)
    for relationship in ("IMPORTS", "DEPENDS_ON"):
        edges = edges.unionByName(edge(resolved, "source", "target", relationship))
    # A base class is found by its bare name; of several the last by (file, line).
    last = W.partitionBy("job_id", "label").orderBy(F.desc("file"), F.desc("line"), F.desc("id"))
    known = classes.withColumn("rn", F.row_number().over(last)).where("rn = 1").select("job_id", F.col("label").alias("base"), F.col("id").alias("base_id"))
    bases = shuffled(with_id.select("job_id", "class_id", F.explode(c["base_classes"]).alias("base")), known, ["job_id", "base"])
    edges = edges.unionByName(edge(bases.where("class_id <> base_id"), "class_id", "base_id", "INHERITS"))
    return Graph(repos, modules, files, classes, functions, edges)


def longest_prefix(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Each file's module of the longest path that holds it: general modules, at any depth.

    Rewritten to an equi-join: a file meets its own ancestors only.
    """
    deep = files.select("job_id", F.col("path").alias("file"), F.explode(F.concat(F.array(normal_path(F.col("path"))), ancestors(F.col("path"), 1000))).alias("module"))
    met = deep.join(modules.select("job_id", F.col("path").alias("module")), ["job_id", "module"])
    best = met.groupBy("job_id", "file").agg(F.max_by("module", F.length("module")).alias("module"))
    return files.select("job_id", F.col("path").alias("file")).join(best, ["job_id", "file"], "left")
