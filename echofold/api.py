"""The public surface, by the names a caller of a deduplication service would look for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echofold.config import DedupConfig
from echofold.operators.blocks import extract
from echofold.operators.compare import diff_statistics, scan_diff
from echofold.plans.analysis import Analysis, analyze, compare_corpora
from echofold.sinks.report import rendered
from echofold.sources.files import read_files


def scan_project(spark: SparkSession, root: str, config: DedupConfig = DedupConfig()) -> DataFrame:
    return extract(read_files(spark, root, config), config.functions_only, config.min_lines)


def analyze_project(spark: SparkSession, root: str, config: DedupConfig = DedupConfig()) -> Analysis:
    return analyze(scan_project(spark, root, config), config)


def compare_projects(spark: SparkSession, a: str, b: str, config: DedupConfig = DedupConfig()):
    return compare_corpora(scan_project(spark, a, config), scan_project(spark, b, config), config)


HANDLERS = {
    "analyze_project": analyze_project,
    "find_duplicates": lambda spark, root, config=DedupConfig(): analyze_project(spark, root, config).groups,
    "check_project": lambda spark, root, config=DedupConfig(): analyze_project(spark, root, config).gate(config),
    "suggest_refactoring": lambda spark, root, config=DedupConfig(): analyze_project(spark, root, config).suggestions,
    "compare_projects": compare_projects,
    "compare_scans": lambda spark, before, after: diff_statistics(scan_diff(before, after)),
    "project_report": lambda spark, root, fmt="toon", config=DedupConfig(): rendered(analyze_project(spark, root, config), fmt),
    "project_info": lambda spark, root, config=DedupConfig(): {"root": root, "min_lines": config.min_lines},
}
