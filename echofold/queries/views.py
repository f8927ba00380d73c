"""How the driver's tables become corpora, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.operators import grouping
from echofold.operators.blocks import whole_files
from echofold.operators.graph import written
from echofold.operators.grouping import hashed


def file_name() -> Column:
    """A document's path: source/id.lang."""
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def blocks(spark: SparkSession, sf_dir: str, min_lines: int = 3) -> DataFrame:
    """Documents as hashed blocks of at least `min_lines` lines."""
    return hashed(whole_files(documents(spark, sf_dir), file_name(), F.col("text")).filter(F.col("line_count") >= min_lines))


def url_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page paths (scheme and host removed) as one-line blocks."""
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("file"), path.alias("text"))
    one = F.lit(1)
    return hashed(p.select("file", one.alias("line_start"), one.alias("line_end"), "text", F.lit(None).cast("string").alias("function_name"), F.lit(None).cast("string").alias("class_name"), one.alias("line_count")))


def exact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(members, groups) of exact duplicates among documents. The hashes are written once without the texts; so
    are the members, which the callers read several times."""
    b = written(blocks(spark, sf_dir).drop("text", "norm", "structural_hash"), "hashes")
    members = written(grouping.exact_members(b).select(*grouping.MEMBER, "class_name", "line_count"), "members")
    return members, grouping.summarized(members)


def norm_sql(text: str) -> str:
    lines = f"list_filter(regexp_split_to_array({text}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: NOT regexp_matches(l, '^\\s*(\"\"\"|'''''')'))"
    bare = f"list_transform({lines}, lambda l: regexp_replace(regexp_replace(l, '#.*$', ''), '^\\s+|\\s+$', '', 'g'))"
    return f"array_to_string(list_filter({bare}, lambda l: l <> ''), chr(10))"


def masked_sql(norm: str) -> str:
    return f"""regexp_replace(regexp_replace(regexp_replace({norm}, '"[^"]*"', '"__STR__"', 'g'), '''[^'']*''', '''__STR__''', 'g'), '\\b\\d+\\.?\\d*\\b', '__NUM__', 'g')"""


BLOCKS = f"""
raw_blocks AS (
  SELECT source || '/' || doc_id || '.' || lang AS file, 1 AS line_start, len(string_split(text, chr(10))) AS line_end, text,
         regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*') AS function_name, lang, source, doc_id
  FROM documents
), norm_blocks AS (
  SELECT *, line_end AS line_count, {norm_sql("text")} AS norm FROM raw_blocks
), blocks AS (
  SELECT *, substring(sha256(norm), 1, 16) AS exact_hash, substring(sha256({masked_sql("norm")}), 1, 16) AS structural_hash FROM norm_blocks WHERE line_count >= 3
)"""

EXACT = (
    BLOCKS
    + """, members AS (
  SELECT 'E' || exact_hash AS group_id, 'exact' AS duplicate_type, file, line_start, line_end, function_name, norm
  FROM blocks WHERE exact_hash IN (SELECT exact_hash FROM blocks GROUP BY exact_hash HAVING count(*) > 1)
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY file, line_start) AS n FROM members
), groups AS (
  SELECT group_id, duplicate_type, count(*) AS occurrences, count(DISTINCT file) AS n_files, max(function_name) FILTER (n = 1) AS name,
         CAST(max(line_end - line_start + 1) FILTER (n = 1) AS BIGINT) AS total_lines, CAST(max(line_end - line_start + 1) FILTER (n = 1) * (count(*) - 1) AS BIGINT) AS saved_lines, 1.0::DOUBLE AS similarity
  FROM firsts GROUP BY group_id, duplicate_type
), scored AS (
  SELECT *, CAST(saved_lines * similarity AS DOUBLE) AS impact FROM groups
)"""
)
