"""Rollups over groups and members: the numbers behind the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def package(file: Column) -> Column:
    return F.substring_index(file, "/", 1)


def scan_metrics(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row from (path, n_lines) and blocks."""
    f = files.agg(F.count("*").alias("files_scanned"), F.sum("n_lines").alias("total_lines"), F.round(F.avg("n_lines"), 4).alias("avg_lines"))
    b = blocks.agg(F.count("*").alias("total_blocks"))
    return f.crossJoin(b).withColumn("blocks_per_file", F.round(F.col("total_blocks") / F.col("files_scanned"), 4))  # one row each


def duplication_metrics(groups: DataFrame) -> DataFrame:
    return groups.groupBy("duplicate_type").agg(
        F.count("*").alias("n_groups"), F.sum("occurrences").alias("n_fragments"), F.sum("saved_lines").alias("saved_lines"),
        F.round(F.avg("similarity"), 6).alias("avg_similarity"), F.max("total_lines").alias("max_lines"), F.round(F.avg("total_lines"), 4).alias("avg_lines"),
    )


def language_rollup(members: DataFrame) -> DataFrame:
    return members.groupBy(F.regexp_extract("file", "\\.([^./]+)$", 1).alias("language")).agg(
        F.countDistinct("file").alias("n_files"), F.countDistinct("group_id").alias("n_groups"), F.count("*").alias("n_fragments"), F.sum(F.col("line_end") - F.col("line_start") + 1).alias("dup_lines")
    )


def file_rollup(members: DataFrame, top: int | None = 10) -> DataFrame:
    out = members.groupBy("file").agg(F.count("*").alias("n_fragments"), F.countDistinct("group_id").alias("n_groups"), F.sum(F.col("line_end") - F.col("line_start") + 1).alias("dup_lines"))
    return out.orderBy(F.desc("dup_lines"), "file").limit(top) if top else out


def complexity_metrics(groups: DataFrame) -> DataFrame:
    n = F.col("total_lines")
    size = F.when(n < 5, "tiny").when(n < 10, "small").when(n < 30, "medium").when(n < 50, "large").otherwise("huge")
    return groups.groupBy(size.alias("size_class")).agg(F.count("*").alias("n_groups"), F.round(F.avg(F.sqrt(n) * F.col("similarity")), 6).alias("mean_complexity"), F.sum((F.col("impact") > 100).cast("int")).alias("high_impact"))


def similarity_histogram(scores: DataFrame, column: str = "similarity") -> DataFrame:
    s = F.col(column)
    bucket = F.when(s >= 0.95, "95-100").when(s >= 0.90, "90-95").when(s >= 0.85, "85-90").when(s >= 0.80, "80-85").otherwise("below 80")
    return scores.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def refactoring_metrics(suggestions: DataFrame) -> DataFrame:
    """Counts by action, by risk, and over all, in one pass."""
    return suggestions.groupingSets([["action"], ["risk_level"], []], "action", "risk_level").agg(F.count("*").alias("n"), F.min("priority").alias("best_priority"))


def hotspots(members: DataFrame, classes: DataFrame, files: DataFrame, top: int = 7) -> DataFrame:
    """Files with most duplicated lines, generated copies left out. files: (file, n_lines)."""
    kept = members.join(classes.filter("actionability <> 'generated'").select("group_id"), "group_id", "left_semi")
    n = F.sum(F.col("line_end") - F.col("line_start") + 1)
    g = kept.groupBy("file").agg(n.alias("dup_lines"), F.countDistinct("group_id").alias("n_groups"), F.count("*").alias("n_fragments"))
    both = g.join(files.select(F.col("file").alias("f_file"), "n_lines"), F.col("file") == F.col("f_file"), "left")
    return both.select("file", "dup_lines", "n_groups", "n_fragments", F.round(100.0 * F.col("dup_lines") / F.col("n_lines"), 2).alias("pct")).orderBy(F.desc("dup_lines"), "file").limit(top)


def dependency_risk(members: DataFrame, groups: DataFrame, top: int | None = 7) -> DataFrame:
    """Groups that span several top-level packages."""
    spread = members.groupBy(F.col("group_id").alias("g")).agg(F.array_join(F.array_sort(F.collect_set(package(F.col("file")))), ",").alias("packages"), F.countDistinct(package(F.col("file"))).alias("n_packages"))
    out = groups.join(spread.filter("n_packages > 1"), F.col("group_id") == F.col("g")).select("group_id", "packages", "n_packages", "total_lines", "saved_lines", "impact")
    return out.orderBy(F.desc("n_packages"), F.desc("impact"), "group_id").limit(top) if top else out


def quick_wins(suggestions: DataFrame, groups: DataFrame, top: int = 10) -> DataFrame:
    low = suggestions.filter("risk_level = 'low'").select("group_id", "action", "new_module")
    return low.join(groups.filter("saved_lines >= 6").select("group_id", "saved_lines", "occurrences", "total_lines"), "group_id").orderBy(F.desc("saved_lines"), "group_id").limit(top)


def effort(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Minutes of work a group: two a saved line, twice that across packages, half as much again when big."""
    spread = members.groupBy(F.col("group_id").alias("g")).agg(F.countDistinct(package(F.col("file"))).alias("n_packages"))
    minutes = F.col("saved_lines") * 2.0 * F.when(F.col("n_packages") > 1, 2.0).otherwise(1.0) * F.when(F.col("total_lines") > 30, 1.5).otherwise(1.0)
    out = groups.join(spread, F.col("group_id") == F.col("g")).withColumn("minutes", minutes)
    return out.select("group_id", "saved_lines", "n_packages", "minutes", F.when(F.col("minutes") < 30, "easy").when(F.col("minutes") < 90, "medium").otherwise("hard").alias("difficulty"))


def by_actionability(groups: DataFrame, classes: DataFrame) -> DataFrame:
    kind = classes.select(F.col("group_id").alias("c"), "actionability")
    return groups.join(kind, F.col("group_id") == F.col("c")).groupBy("actionability").agg(F.count("*").alias("n_groups"), F.sum("saved_lines").alias("saved_lines"))


def quality_gate(groups: DataFrame, max_groups: int = 10, max_saved_lines: int = 100) -> DataFrame:
    """One row: totals, whether they keep within the budget, and what does not."""
    t = groups.agg(F.count("*").alias("total_groups"), F.coalesce(F.sum("saved_lines"), F.lit(0)).alias("saved_lines"))
    over = F.array_compact(F.array(F.when(F.col("total_groups") > max_groups, F.concat(F.lit("groups "), F.col("total_groups").cast("string"), F.lit(f" > {max_groups}"))), F.when(F.col("saved_lines") > max_saved_lines, F.concat(F.lit("lines "), F.col("saved_lines").cast("string"), F.lit(f" > {max_saved_lines}")))))
    return t.withColumn("passed", (F.col("total_groups") <= max_groups) & (F.col("saved_lines") <= max_saved_lines)).withColumn("violations", F.array_join(over, "; "))


def budget(groups: DataFrame, total_lines: Column | int, max_groups: int = 15, max_lines: int = 200) -> DataFrame:
    """One row: the clone budget of a corpus of `total_lines` lines."""
    lines = total_lines if isinstance(total_lines, Column) else F.lit(total_lines)
    t = groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("saved_lines"), F.lit(0)).alias("dup_lines"))
    return t.select("n_groups", "dup_lines", F.round(100.0 * F.col("dup_lines") / lines, 4).alias("percentage"), ((F.col("n_groups") <= max_groups) & (F.col("dup_lines") <= max_lines)).alias("passed"))
