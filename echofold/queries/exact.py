"""Exact and structural groups, scan statistics, filters, rankings and rollups over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.config import DedupConfig
from echofold.operators import blocks as blocks_
from echofold.operators import classify, grouping, metrics
from echofold.queries.views import BLOCKS, EXACT, blocks, documents, exact, file_name, masked_sql, norm_sql, table, url_blocks
from echofold.sources import files


def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: documents equal after normalising, ranked by the lines that one copy would save."""
    return exact(spark, sf_dir)[1].select("group_id", "duplicate_type", "occurrences", "n_files", "name", F.col("total_lines").cast("long"), F.col("saved_lines").cast("long"), "similarity", "impact").orderBy(F.desc("impact"), "group_id")


def exact_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact(spark, sf_dir)[0].select("group_id", "file", "line_start", "line_end", "function_name")


def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    f = d.select(F.size(F.split("text", "\n")).alias("n_lines"))
    return metrics.scan_metrics(f, blocks_.whole_files(d, file_name(), F.col("text")).filter("line_count >= 3"))


def suffix_test_exclude_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page paths through the file filters, with the language of their suffix."""
    config = DedupConfig(exclude=("es", "*7", "fr/9*"))
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/|[?#].*$", "")
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % n + 1).cast("int"))
    named = F.concat(pick(5, "src/test_", "tests/", "lib/", "pytest-1/test_", "a/spec_"), F.col("path"))
    suffixed = F.concat(F.col("path"), pick(4, ".py", ".TS", ".unknown", "/Makefile"))
    return p.select("page_id", "path", files.excluded(F.col("path"), config.exclude).alias("excluded"), files.is_test(named).alias("is_test"), files.language(suffixed).alias("language"))


def line_window_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three lines that occur at several places."""
    w = grouping.hashed(blocks_.line_windows(documents(spark, sf_dir), file_name(), F.col("text")))
    g = w.groupBy("exact_hash").agg(F.countDistinct("file", "line_start").alias("places"), F.countDistinct("file").alias("n_files"), F.min("file").alias("first_file"))
    return g.filter("places > 1")


def structural_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page paths equal but for their numbers, less those equal as they are."""
    b = url_blocks(spark, sf_dir)
    return grouping.summarized(grouping.structural_members(b, grouping.exact_members(b))).select("group_id", "occurrences", "n_files")


def covered_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no exact group holds."""
    b = blocks(spark, sf_dir)
    return grouping.uncovered(b, grouping.exact_members(b)).select("file", "line_start", "structural_hash")


def impact_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.ranked(exact(spark, sf_dir)[1]).select("priority", "group_id", "impact")


def bounded_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.bounded(exact(spark, sf_dir)[1], max_groups=40, max_saved_lines=300, min_impact=3.0).select("group_id", F.col("saved_lines").cast("long"), "impact")


def _tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Whole documents and three-line windows as one set of groups."""
    whole = exact(spark, sf_dir)[0].select(*grouping.MEMBER)
    windows = grouping.hashed(blocks_.line_windows(documents(spark, sf_dir), file_name(), F.col("text")))
    members = whole.unionByName(grouping.members_of(windows, "exact_hash", "window").select(*grouping.MEMBER))
    return members, grouping.summarized(members)


def subset_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, groups = _tiers(spark, sf_dir)
    return grouping.without_subsets(members, groups).select("group_id", "duplicate_type", F.col("saved_lines").cast("long"))


def provenance_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.provenance(exact(spark, sf_dir)[0]).select("group_id", "provenance", "actionability")


def refactor_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, groups = exact(spark, sf_dir)
    return classify.suggestions(groups, members, classify.provenance(members))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, groups = exact(spark, sf_dir)
    spread = members.groupBy(F.col("group_id").alias("g")).agg(F.countDistinct(metrics.package(F.col("file"))).alias("n_packages"))
    both = groups.join(spread, F.col("group_id") == F.col("g"))
    return both.select("group_id", F.col("saved_lines").cast("long"), classify.task_priority(F.col("saved_lines")).alias("priority"), classify.task_difficulty(F.col("n_files"), F.col("n_packages"), F.col("total_lines")).alias("difficulty"))


def language_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.language_rollup(exact(spark, sf_dir)[0])


def file_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per directory of members here: a document is one file, so files roll up to their source."""
    return metrics.file_rollup(exact(spark, sf_dir)[0].withColumn("file", metrics.package(F.col("file"))), top=None)


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = exact(spark, sf_dir)
    d = documents(spark, sf_dir).groupBy(F.col("source").alias("file")).agg(F.sum(F.size(F.split("text", "\n"))).alias("n_lines"))
    return metrics.hotspots(members.withColumn("file", metrics.package(F.col("file"))), classify.provenance(members), d)


def dependency_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, groups = exact(spark, sf_dir)
    return metrics.dependency_risk(members, groups).select("group_id", "packages", "n_packages", F.col("saved_lines").cast("long"))


def quick_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, groups = exact(spark, sf_dir)
    one = members.withColumn("file", metrics.package(F.col("file")))
    s = classify.suggestions(grouping.summarized(one), one, classify.provenance(one))
    return metrics.quick_wins(s, groups).select("group_id", "action", F.col("saved_lines").cast("long"))


def effort_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, groups = exact(spark, sf_dir)
    return metrics.effort(groups, members).select("group_id", F.col("saved_lines").cast("long"), "n_packages", "minutes", "difficulty")


def complexity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.complexity_metrics(exact(spark, sf_dir)[1])


def duplication_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.duplication_metrics(exact(spark, sf_dir)[1]).select("duplicate_type", "n_groups", "n_fragments", F.col("saved_lines").cast("long"), "avg_similarity", F.col("max_lines").cast("long"), "avg_lines")


def refactoring_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.refactoring_metrics(refactor_suggestions(spark, sf_dir))


def actionability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, groups = exact(spark, sf_dir)
    return metrics.by_actionability(groups, classify.provenance(members)).select("actionability", "n_groups", F.col("saved_lines").cast("long"))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quality_gate(exact(spark, sf_dir)[1]).select("total_groups", F.col("saved_lines").cast("long"), "passed", "violations")


def clone_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = documents(spark, sf_dir).agg(F.sum(F.size(F.split("text", "\n")))).first()[0]
    return metrics.budget(exact(spark, sf_dir)[1], n or 1).select("n_groups", F.col("dup_lines").cast("long"), "percentage", "passed")


QUERIES = {
    f.__name__: f
    for f in (
        exact_groups, exact_group_members, scan_stats, suffix_test_exclude_filter, line_window_dups, structural_groups, covered_anti_join, impact_ranking, bounded_collect,
        subset_elimination, provenance_classes, refactor_suggestions, tasks, language_rollup, file_rollup, hotspots, dependency_risk, quick_wins, effort_estimate,
        complexity_metrics, duplication_metrics, refactoring_metrics, actionability_summary, quality_gate, clone_budget,
    )
}

_PACKAGES = ", spread AS (SELECT group_id, count(DISTINCT string_split(file, '/')[1]) AS n_packages, string_agg(DISTINCT string_split(file, '/')[1], ',' ORDER BY string_split(file, '/')[1]) AS packages FROM members GROUP BY group_id)"
#: Every path is source/id.lang, so of the provenance rules only these can apply.
_PROVENANCE = """, kinds AS (
  SELECT group_id, CASE WHEN count(DISTINCT file) = 1 THEN 'same_file' WHEN count(DISTINCT string_split(file, '/')[2]) = 1 AND count(DISTINCT string_split(file, '/')[1]) > 1 THEN 'platform_variant'
         WHEN count(DISTINCT string_split(file, '/')[1]) <= 1 THEN 'local_duplicate' ELSE 'cross_component' END AS provenance FROM members GROUP BY group_id
), classes AS (
  SELECT *, CASE WHEN provenance IN ('same_file', 'local_duplicate') THEN 'refactor' ELSE 'review' END AS actionability FROM kinds
)"""
_SUGGESTIONS = (
    _PACKAGES
    + _PROVENANCE
    + """, ranked AS (SELECT *, row_number() OVER (ORDER BY impact DESC, group_id) AS priority FROM scored)
, lists AS (SELECT group_id, string_agg(DISTINCT file, ',' ORDER BY file) AS original_files FROM members GROUP BY group_id)
, suggested AS (
  SELECT group_id, CAST(priority AS INTEGER) AS priority, CASE WHEN total_lines > 50 THEN 'extract_module' ELSE 'extract_function' END AS action,
         CASE WHEN n_packages = 1 THEN packages || '/' ELSE '' END || 'utils/' || coalesce(nullif(name, ''), 'shared_block_' || substring(group_id, 1, 8)) || '.py' AS new_module,
         original_files, CASE WHEN actionability = 'review' THEN 'medium' WHEN n_files = 1 THEN 'low' WHEN total_lines > 30 THEN 'medium' WHEN n_packages > 2 THEN 'high' ELSE 'low' END AS risk_level,
         format('{} occurrences of {}-line block across {} files, saves {} lines', occurrences, total_lines, n_files, saved_lines) AS rationale
  FROM ranked JOIN spread USING (group_id) JOIN classes USING (group_id) JOIN lists USING (group_id) WHERE saved_lines > 0
)"""
)
_WINDOWS = f"""
win AS (
  SELECT file, i AS line_start, array_to_string(l[i:i + 2], chr(10)) AS text
  FROM (SELECT source || '/' || doc_id || '.' || lang AS file, string_split(text, chr(10)) AS l, unnest(generate_series(1, len(string_split(text, chr(10))) - 2)) AS i FROM documents)
), windows AS (
  SELECT *, substring(sha256({norm_sql("text")}), 1, 16) AS exact_hash FROM win WHERE regexp_matches(text, '[^ \\t\\n\\r\\x0b\\x0c]')
)"""

SQL = {
    "exact_groups": f"WITH {EXACT} SELECT * FROM scored",
    "exact_group_members": f"WITH {EXACT} SELECT group_id, file, line_start, line_end, function_name FROM members",
    "scan_stats": """SELECT count(*) AS files_scanned, CAST(sum(n) AS BIGINT) AS total_lines, round(avg(n), 4) AS avg_lines, count(*) FILTER (n >= 3) AS total_blocks,
        round(count(*) FILTER (n >= 3) / count(*), 4) AS blocks_per_file FROM (SELECT len(string_split(text, chr(10))) AS n FROM documents)""",
    "suffix_test_exclude_filter": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/|[?#].*$', '', 'g') AS path FROM pages)
        SELECT page_id, path, path = 'es' OR path LIKE '%7' OR path LIKE 'fr/9%' OR len(list_filter(string_split(path, '/'), lambda s: s = 'es' OR s LIKE '%7')) > 0 AS excluded,
        page_id % 5 <> 3 AND (page_id % 5 = 1 OR regexp_matches(string_split(q, '/')[-1], 'test_|_test\.|tests\.|spec_|_spec\.') OR len(list_filter(string_split(q, '/')[:-2], lambda s: contains(s, 'test'))) > 0) AS is_test,
        CASE page_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 3 THEN 'make' END AS language
        FROM (SELECT *, ['src/test_', 'tests/', 'lib/', 'pytest-1/test_', 'a/spec_'][page_id % 5 + 1] || path AS q FROM p)""",
    "line_window_dups": f"WITH {_WINDOWS} SELECT exact_hash, count(*) AS places, count(DISTINCT file) AS n_files, min(file) AS first_file FROM windows GROUP BY exact_hash HAVING count(*) > 1",
    "structural_groups": f"""WITH u AS (SELECT 'page/' || page_id AS file, {norm_sql("regexp_replace(url, '^[a-z]+://[^/]*', '')")} AS norm FROM pages),
        h AS (SELECT file, norm, substring(sha256({masked_sql("norm")}), 1, 16) AS sh FROM u), left_over AS (SELECT * FROM h WHERE norm NOT IN (SELECT norm FROM h GROUP BY norm HAVING count(*) > 1))
        SELECT 'S' || sh AS group_id, count(*) AS occurrences, count(DISTINCT file) AS n_files FROM left_over GROUP BY sh HAVING count(*) > 1""",
    "covered_anti_join": f"WITH {EXACT} SELECT file, line_start, structural_hash FROM blocks WHERE file NOT IN (SELECT file FROM members)",
    "impact_ranking": f"WITH {EXACT} SELECT CAST(row_number() OVER (ORDER BY impact DESC, group_id) AS INTEGER) AS priority, group_id, impact FROM scored",
    "bounded_collect": f"""WITH {EXACT}, r AS (SELECT *, row_number() OVER w AS n, sum(saved_lines) OVER w AS upto FROM scored WHERE impact >= 3 WINDOW w AS (ORDER BY impact DESC, group_id ROWS UNBOUNDED PRECEDING))
        SELECT group_id, saved_lines, impact FROM r WHERE n <= 40 AND upto - saved_lines < 300""",
    "provenance_classes": f"WITH {EXACT}{_PROVENANCE} SELECT * FROM classes",
    "refactor_suggestions": f"WITH {EXACT}{_SUGGESTIONS} SELECT * FROM suggested",
    "tasks": f"""WITH {EXACT}{_PACKAGES} SELECT group_id, saved_lines, CASE WHEN saved_lines > 30 THEN 'critical' WHEN saved_lines > 15 THEN 'major' ELSE 'minor' END AS priority,
        CASE WHEN n_files = 1 THEN 'easy' WHEN n_packages > 2 OR total_lines > 50 THEN 'hard' ELSE 'medium' END AS difficulty FROM scored JOIN spread USING (group_id)""",
    "language_rollup": f"WITH {EXACT} SELECT regexp_extract(file, '\\.([^./]+)$', 1) AS language, count(DISTINCT file) AS n_files, count(DISTINCT group_id) AS n_groups, count(*) AS n_fragments, CAST(sum(line_end - line_start + 1) AS BIGINT) AS dup_lines FROM members GROUP BY 1",
    "file_rollup": f"WITH {EXACT} SELECT string_split(file, '/')[1] AS file, count(*) AS n_fragments, count(DISTINCT group_id) AS n_groups, CAST(sum(line_end - line_start + 1) AS BIGINT) AS dup_lines FROM members GROUP BY 1",
    "hotspots": f"""WITH {EXACT}, s AS (SELECT source AS file, sum(len(string_split(text, chr(10)))) AS n_lines FROM documents GROUP BY 1),
        g AS (SELECT string_split(file, '/')[1] AS file, sum(line_end - line_start + 1) AS dup_lines, count(DISTINCT group_id) AS n_groups, count(*) AS n_fragments FROM members GROUP BY 1)
        SELECT file, CAST(dup_lines AS BIGINT) AS dup_lines, n_groups, n_fragments, round(100.0::DOUBLE * dup_lines / n_lines, 2) AS pct FROM g JOIN s USING (file) ORDER BY dup_lines DESC, file LIMIT 7""",
    "dependency_risk": f"WITH {EXACT}{_PACKAGES} SELECT group_id, packages, n_packages, saved_lines FROM scored JOIN spread USING (group_id) WHERE n_packages > 1 ORDER BY n_packages DESC, impact DESC, group_id LIMIT 7",
    "quick_wins": f"""WITH {EXACT}{_PACKAGES} SELECT group_id, CASE WHEN total_lines > 50 THEN 'extract_module' ELSE 'extract_function' END AS action, saved_lines
        FROM scored JOIN spread USING (group_id) WHERE n_packages = 1 AND saved_lines >= 6 ORDER BY saved_lines DESC, group_id LIMIT 10""",
    "effort_estimate": f"""WITH {EXACT}{_PACKAGES}, e AS (SELECT *, saved_lines * 2.0::DOUBLE * CASE WHEN n_packages > 1 THEN 2 ELSE 1 END * CASE WHEN total_lines > 30 THEN 1.5::DOUBLE ELSE 1 END AS minutes FROM scored JOIN spread USING (group_id))
        SELECT group_id, saved_lines, n_packages, minutes, CASE WHEN minutes < 30 THEN 'easy' WHEN minutes < 90 THEN 'medium' ELSE 'hard' END AS difficulty FROM e""",
    "complexity_metrics": f"""WITH {EXACT} SELECT CASE WHEN total_lines < 5 THEN 'tiny' WHEN total_lines < 10 THEN 'small' WHEN total_lines < 30 THEN 'medium' WHEN total_lines < 50 THEN 'large' ELSE 'huge' END AS size_class,
        count(*) AS n_groups, round(avg(sqrt(total_lines) * similarity), 6) AS mean_complexity, CAST(count(*) FILTER (impact > 100) AS BIGINT) AS high_impact FROM scored GROUP BY 1""",
    "duplication_metrics": f"WITH {EXACT} SELECT duplicate_type, count(*) AS n_groups, CAST(sum(occurrences) AS BIGINT) AS n_fragments, CAST(sum(saved_lines) AS BIGINT) AS saved_lines, round(avg(similarity), 6) AS avg_similarity, max(total_lines) AS max_lines, round(avg(total_lines), 4) AS avg_lines FROM scored GROUP BY 1",
    "refactoring_metrics": f"WITH {EXACT}{_SUGGESTIONS} SELECT action, risk_level, count(*) AS n, min(priority) AS best_priority FROM suggested GROUP BY GROUPING SETS ((action), (risk_level), ())",
    "actionability_summary": f"WITH {EXACT}{_PROVENANCE} SELECT actionability, count(*) AS n_groups, CAST(sum(saved_lines) AS BIGINT) AS saved_lines FROM scored JOIN classes USING (group_id) GROUP BY 1",
    "quality_gate": f"""WITH {EXACT}, t AS (SELECT count(*) AS total_groups, CAST(coalesce(sum(saved_lines), 0) AS BIGINT) AS saved_lines FROM scored)
        SELECT total_groups, saved_lines, total_groups <= 10 AND saved_lines <= 100 AS passed,
        concat_ws('; ', CASE WHEN total_groups > 10 THEN 'groups ' || total_groups || ' > 10' END, CASE WHEN saved_lines > 100 THEN 'lines ' || saved_lines || ' > 100' END) AS violations FROM t""",
    "clone_budget": f"""WITH {EXACT}, t AS (SELECT count(*) AS n_groups, CAST(coalesce(sum(saved_lines), 0) AS BIGINT) AS dup_lines FROM scored), n AS (SELECT sum(len(string_split(text, chr(10)))) AS n FROM documents)
        SELECT n_groups, dup_lines, round(100.0::DOUBLE * dup_lines / n, 4) AS percentage, n_groups <= 15 AND dup_lines <= 200 AS passed FROM t, n""",
}
