"""Lint detectors over parsed files: flags (job_id, pattern, severity, file_path, line, symbol, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = ("job_id", "pattern", "severity", "file_path", "line", "symbol", "value")
# The messages' texts.
MESSAGES = {
    "god_function": "`{symbol}` is {value} lines long.",
    "long_parameter_list": "`{symbol}` takes {value} parameters.",
    "missing_docstrings": "`{symbol}` has no docstring.",
    "inconsistent_naming": "File mixes camelCase and snake_case function names.",
    "no_error_handling": "File has {value} functions but no error handling imports or exception classes.",
    "duplicate_logic": "Function `{symbol}` appears {value} times.",
}
# What to do about each.
FIXES = {
    "god_function": "Split it into functions that each do one thing.",
    "long_parameter_list": "Pass one object that holds the values that belong together.",
    "missing_docstrings": "Say in a docstring what it is for, what it takes and what it returns.",
    "inconsistent_naming": "Choose the style that the language's convention names and rename the others.",
    "no_error_handling": "Decide which failures can occur and handle or declare them.",
    "duplicate_logic": "Keep one definition in a shared module and import it.",
}


def filled(texts: dict[str, str]) -> Column:
    """The text of a flag's pattern with its symbol and value."""
    out = F.lit(None).cast("string")
    for pattern, template in texts.items():
        text = F.replace(F.replace(F.lit(template), F.lit("{symbol}"), F.coalesce("symbol", F.lit(""))), F.lit("{value}"), F.coalesce(F.col("value").cast("string"), F.lit("")))
        out = F.when(F.col("pattern") == pattern, text).otherwise(out)
    return out


def described(flags: DataFrame) -> DataFrame:
    """The flags with ``message`` and ``fix``."""
    return flags.withColumns({"message": filled(MESSAGES), "fix": filled(FIXES)})


def of_pattern(flags: DataFrame, pattern: str) -> DataFrame:
    return flags.where(F.col("pattern") == pattern)


def all_functions(parsed: DataFrame) -> DataFrame:
    """A row for each function and method of files without parse errors."""
    clean = parsed.where(F.size("parse_errors") == 0)
    methods = F.flatten(F.transform("classes", lambda c: c["methods"]))
    free = F.transform("functions", lambda f: F.struct(f.alias("f"), F.lit(True).alias("top")))
    own = F.transform(methods, lambda f: F.struct(f.alias("f"), F.lit(False).alias("top")))
    return clean.select("job_id", "path", F.explode(F.concat(free, own)).alias("x")).select("job_id", "path", "x.top", "x.f.*").withColumn("lines", F.col("line_end") - F.col("line_start") + 1)


def flag(frame: DataFrame, pattern: str, severity, line, symbol, value) -> DataFrame:
    col = lambda x: x if not isinstance(x, (str, int)) else F.lit(x)
    return frame.select("job_id", F.lit(pattern).alias("pattern"), col(severity).alias("severity"), F.col("path").alias("file_path"), col(line).cast("int").alias("line"), col(symbol).cast("string").alias("symbol"), col(value).cast("int").alias("value"))


def god_functions(fns: DataFrame) -> DataFrame:
    return flag(fns.where("lines > 30"), "god_function", F.when(F.col("lines") > 50, "high").otherwise("medium"), F.col("line_start"), F.col("name"), F.col("lines"))


def long_parameter_lists(fns: DataFrame) -> DataFrame:
    n = F.size("parameters")
    return flag(fns.where(n > 5), "long_parameter_list", F.when(n > 7, "high").otherwise("medium"), F.col("line_start"), F.col("name"), n)


def missing_docstrings(parsed: DataFrame, fns: DataFrame) -> DataFrame:
    bare = lambda doc: F.length(F.trim(F.coalesce(doc, F.lit("")))) == 0
    classes = parsed.where(F.size("parse_errors") == 0).select("job_id", "path", F.explode("classes").alias("c")).where(~F.col("c.name").startswith("_") & bare(F.col("c.docstring")))
    of_classes = flag(classes, "missing_docstrings", "low", F.col("c.line_start"), F.col("c.name"), 0)
    free = fns.where(F.col("top") & ~F.col("name").startswith("_") & (F.col("lines") > 10) & bare(F.col("docstring")))
    return of_classes.unionByName(flag(free, "missing_docstrings", "low", F.col("line_start"), F.col("name"), F.col("lines")))


def mixed_naming(fns: DataFrame) -> DataFrame:
    """job_id, path, camel, snake of each file: names with a lower-to-upper step, and other names with an underscore."""
    camel = F.col("name").rlike("[a-z][A-Z]")
    return fns.groupBy("job_id", "path").agg(F.count_if(camel).alias("camel"), F.count_if(~camel & F.contains("name", F.lit("_"))).alias("snake"))


def inconsistent_naming(fns: DataFrame) -> DataFrame:
    return flag(mixed_naming(fns).where("camel > 0 and snake > 0"), "inconsistent_naming", "medium", 1, "", F.col("camel") + F.col("snake"))


def no_error_handling(parsed: DataFrame) -> DataFrame:
    n = F.size("functions") + F.aggregate("classes", F.lit(0), lambda a, c: a + F.size(c["methods"]))
    named = F.exists("classes", lambda c: c["name"].rlike("Error|Exception") | F.exists(c["base_classes"], lambda b: b.rlike("Error|Exception")))
    imported = F.exists("imports", lambda i: F.lower(i["module"]).rlike("exception|error"))
    return flag(parsed.where((F.size("parse_errors") == 0) & (n > 5) & ~named & ~imported), "no_error_handling", "medium", 1, "", n)


def duplicate_names(parsed: DataFrame, least: int = 3) -> DataFrame:
    """job_id, name, many and path (the least) of top-level functions that occur often enough."""
    fns = parsed.select("job_id", "path", F.explode("functions").alias("f")).select("job_id", "path", F.col("f.name").alias("name"), F.col("f.line_start").alias("line"))
    grouped = fns.where(~F.col("name").startswith("_")).groupBy("job_id", "name").agg(F.count(F.lit(1)).alias("many"), F.min("path").alias("path"))
    return grouped.where(F.col("many") >= least)


def detect(parsed: DataFrame) -> DataFrame:
    """All detectors' flags."""
    fns = all_functions(parsed)
    parts = [god_functions(fns), long_parameter_lists(fns), missing_docstrings(parsed, fns), inconsistent_naming(fns), no_error_handling(parsed), flag(duplicate_names(parsed), "duplicate_logic", "medium", 1, F.col("name"), F.col("many"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def health(flags: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, high, medium, low, score: 100 less 8, 4 and 1 for each flag, not below 0."""
    n = lambda s: F.count_if(F.col("severity") == s)
    counts = flags.groupBy("job_id").agg(n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - 8 * F.col("high") - 4 * F.col("medium") - F.col("low"))).cast("int")
    return jobs.select("job_id").distinct().join(counts, "job_id", "left").na.fill(0).withColumn("score", score)
