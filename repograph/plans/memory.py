"""What is remembered of repositories across jobs: summaries that accumulate, and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def headlines(overall: DataFrame, dimensions: DataFrame, issues: DataFrame, names: DataFrame) -> DataFrame:
    """job_id and one sentence on its report; names: job_id, repo_name."""
    worst = dimensions.groupBy("job_id").agg(F.min_by(F.struct("dimension", "score"), F.struct("score", "position")).alias("w"), F.count(F.lit(1)).alias("n_dims"))
    found = issues.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_issues"))
    joined = overall.join(worst, "job_id").join(found, "job_id", "left").join(names, "job_id")
    return joined.select("job_id", F.format_string("%s scored %d/100 (%s) across %d dimensions with %d issues found, weakest dimension is %s (%d/100).", "repo_name", "overall_score", "overall_grade", "n_dims", F.coalesce("n_issues", F.lit(0)), "w.dimension", "w.score").alias("headline"))


def facts(headline: DataFrame, dimensions: DataFrame, issues: DataFrame, most_issues: int = 8) -> DataFrame:
    """job_id, category, text, source_symbol, source_file: an overview, the dimensions, and the gravest issues."""
    from pyspark.sql import Window as W

    none = F.lit(None).cast("string")
    over = headline.select("job_id", F.lit("overview").alias("category"), F.col("headline").alias("text"), none.alias("source_symbol"), none.alias("source_file"))
    dims = dimensions.select("job_id", F.lower(F.translate("dimension", " ", "_")).alias("category"), F.format_string("%s: %d/100 (%s)", "dimension", "score", "grade").alias("text"), none.alias("source_symbol"), none.alias("source_file"))
    rank = F.when(F.col("severity") == "critical", 0).otherwise(1)
    order = W.partitionBy("job_id").orderBy(rank, F.coalesce("file_path", F.lit("")), "rule", F.coalesce("affected_symbol", F.lit("")))
    grave = issues.where("severity in ('critical', 'high')").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most_issues)
    where = F.concat(F.col("title"), F.coalesce(F.concat(F.lit(" (`"), F.col("affected_symbol"), F.lit("`)")), F.lit("")), F.coalesce(F.concat(F.lit(" in "), F.col("file_path")), F.lit("")))
    of_issues = grave.select("job_id", F.concat(F.lit("issue_"), F.col("category")).alias("category"), where.alias("text"), F.col("affected_symbol").alias("source_symbol"), F.col("file_path").alias("source_file"))
    return over.unionByName(dims).unionByName(of_issues)


def summaries(analyses: DataFrame) -> DataFrame:
    """A row for each repository from its analyses (repo_url, at, job_id, overall_score, headline): counts and the latest."""
    last = lambda c: F.max_by(c, F.struct("at", "job_id")).alias(c)
    return analyses.groupBy("repo_url").agg(F.count(F.lit(1)).alias("analysis_count"), F.min("at").alias("first_seen"), F.max("at").alias("updated_at"), last("overall_score"), last("headline"), last("job_id"))
