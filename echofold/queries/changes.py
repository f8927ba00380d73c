"""Two corpora and two runs: shared content, decisions, diffs, and incremental state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.operators import candidates, compare, grouping, state
from echofold.operators.blocks import whole_files
from echofold.operators.graph import written
from echofold.queries.views import BLOCKS, EXACT, documents, exact, file_name, table

_EVEN = "CAST(regexp_extract(file, '^src([0-9]+)/', 1) AS INT) % 2 = 0"


def cross_corpus_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share runs of eight words with benchmark items."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("key"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text")
    return candidates.cross_corpus_passages(d, b).select(F.col("l").alias("doc_id"), F.col("r").alias("item_id"), "shared")


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = grouping.hashed(whole_files(documents(spark, sf_dir), file_name(), F.col("text"))).select("file", "line_start", "line_end", "function_name", "line_count", "structural_hash")
    b = written(b, "halves")
    return b.filter(_EVEN), b.filter(f"NOT ({_EVEN})")


def cross_corpus_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that even and odd sources share, with their places on both sides."""
    return compare.matched_hashes(*halves(spark, sf_dir))


def compare_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do about the two halves: a hash they share is one community."""
    a, b = halves(spark, sf_dir)
    shared = compare.matched_hashes(a, b).agg(F.sum(F.col("loc") * (F.col("n_a") + F.col("n_b"))).alias("loc"))
    total = lambda df: df.agg(F.coalesce(F.sum("line_count"), F.lit(0)).alias("n"))
    return compare.recommended(shared, total(a), total(b)).select(F.col("shared_loc").cast("long"), "overlap_percent", "decision", "confidence")


def _snapshot(spark: SparkSession, sf_dir: str, odd: bool) -> DataFrame:
    """A run over the documents without every third, or every fourth, source."""
    keep = "CAST(regexp_extract(file, '^src([0-9]+)/', 1) AS INT) % {} <> 0".format(4 if odd else 3)
    members = exact(spark, sf_dir)[0].filter(keep)
    files = members.groupBy(F.col("group_id").alias("g")).agg(F.array_sort(F.collect_set("file")).alias("files"))
    g = grouping.summarized(members).filter("occurrences > 1").join(files, F.col("group_id") == F.col("g"))
    return g.select("group_id", "duplicate_type", "similarity", "impact", F.col("group_id").alias("hash"), "name", "files")


def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = written(_snapshot(spark, sf_dir, False), "before"), written(_snapshot(spark, sf_dir, True), "after")
    return compare.scan_diff(before, after).select("group_id", "status")


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files now, what an earlier scan left): every fifth text has changed and every seventh is new."""
    d = documents(spark, sf_dir).select("doc_id", file_name().alias("file_path"), F.col("n_chars").cast("double").alias("file_mtime"), F.sha2("text", 256).alias("file_hash"))
    d = d.withColumn("last_scan_time", (F.col("doc_id") * 3600.0).cast("double"))
    old = d.filter("doc_id % 7 <> 0").withColumn("file_hash", F.when(F.col("doc_id") % 5 == 0, F.lit("changed")).otherwise(F.col("file_hash")))
    return d.drop("doc_id"), old.drop("doc_id")


def incremental_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.misses(*_state(spark, sf_dir)).select("file_path")


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, old = _state(spark, sf_dir)
    return state.upserted(old, state.misses(now, old)).select("file_path", "file_hash")


def ttl_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the state thirty days before its last entry."""
    _, old = _state(spark, sf_dir)
    last = old.agg(F.max("last_scan_time")).first()[0] or 0.0
    return state.unexpired(old, last).select("file_path", "last_scan_time")


QUERIES = {f.__name__: f for f in (cross_corpus_passages, cross_corpus_structural, compare_decision, scan_diff, incremental_misses, cache_upsert, ttl_delete)}
HALVES = (
    BLOCKS.replace("WHERE line_count >= 3", "")
    + """, halves AS (SELECT *, CAST(regexp_extract(file, '^src([0-9]+)/', 1) AS INT) % 2 = 0 AS even FROM blocks)
, sides AS (SELECT structural_hash, count(*) FILTER (even) AS n_a, count(*) FILTER (NOT even) AS n_b, min(file) FILTER (even) AS first_a, min(file) FILTER (NOT even) AS first_b, CAST(max(line_end - line_start) AS INTEGER) AS loc FROM halves GROUP BY 1)
, both_sides AS (SELECT * FROM sides WHERE n_a > 0 AND n_b > 0)"""
)
_STATE = """now AS (SELECT doc_id, source || '/' || doc_id || '.' || lang AS file_path, sha256(text) AS file_hash, doc_id * 3600.0::DOUBLE AS last_scan_time FROM documents)
, old AS (SELECT file_path, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE file_hash END AS file_hash, last_scan_time FROM now WHERE doc_id % 7 <> 0)"""
SQL = {
    "cross_corpus_passages": r"""WITH w AS (SELECT 'd' AS t, doc_id AS id, regexp_extract_all(text, '[^ \t\n\r\x0b\x0c]+') AS w FROM documents UNION ALL SELECT 'b', item_id, regexp_extract_all(text, '[^ \t\n\r\x0b\x0c]+') FROM benchmark),
        g AS (SELECT DISTINCT t, id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT t, id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) >= 8))
        SELECT a.id AS doc_id, b.id AS item_id, count(*) AS shared FROM g a JOIN g b ON a.t = 'd' AND b.t = 'b' AND a.g = b.g GROUP BY 1, 2""",
    "cross_corpus_structural": f"WITH {HALVES} SELECT structural_hash, n_a, n_b, first_a, first_b, loc FROM both_sides",
    "compare_decision": f"""WITH {HALVES}, t AS (SELECT coalesce((SELECT sum(loc * (n_a + n_b)) FROM both_sides), 0) AS shared, (SELECT sum(line_count) FROM halves) AS n), o AS (SELECT shared, shared::DOUBLE / n AS o FROM t)
        SELECT CAST(shared AS BIGINT) AS shared_loc, round(100 * o, 4) AS overlap_percent, CASE WHEN o > 0.60 THEN 'merge_projects' WHEN o > 0.05 THEN 'extract_library' ELSE 'keep_separate' END AS decision,
        CASE WHEN o > 0.60 THEN 0.9::DOUBLE WHEN o > 0.20 THEN 0.8::DOUBLE WHEN o > 0.05 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM o""",
    "incremental_misses": f"WITH {_STATE} SELECT file_path FROM now WHERE (file_path, file_hash) NOT IN (SELECT (file_path, file_hash) FROM old)",
    "cache_upsert": f"WITH {_STATE} SELECT file_path, file_hash FROM now",
    "ttl_delete": f"WITH {_STATE} SELECT file_path, last_scan_time FROM old WHERE last_scan_time >= (SELECT max(last_scan_time) FROM old) - 30 * 86400",
    # a document is in one exact group, so groups of other ids share no file and none is matched greedily
    "scan_diff": f"""WITH {EXACT}, runs AS (SELECT group_id, list(file) FILTER (s % 3 <> 0) AS b, list(file) FILTER (s % 4 <> 0) AS a FROM (SELECT *, CAST(regexp_extract(file, '^src([0-9]+)/', 1) AS INT) AS s FROM members) GROUP BY group_id),
        kept AS (SELECT group_id, coalesce(len(b), 0) > 1 AS was, coalesce(len(a), 0) > 1 AS now, coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0)::DOUBLE, 0) >= 0.5 AS fits FROM runs)
        SELECT group_id, 'unchanged' AS status FROM kept WHERE was AND now AND fits UNION ALL SELECT group_id, 'resolved' FROM kept WHERE was AND NOT (now AND fits) UNION ALL SELECT group_id, 'new' FROM kept WHERE now AND NOT (was AND fits)""",
}
