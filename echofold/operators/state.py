"""Incremental state: what a scan need not do again. files (file_path, file_mtime, file_hash,
last_scan_time) and blocks (file_path, block_start, block_end, block_hash, structural_hash, file_hash)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def misses(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (file_path, file_mtime, file_hash) that are new or whose time or content differ from the state."""
    return files.join(state.select("file_path", "file_mtime", "file_hash"), ["file_path", "file_mtime", "file_hash"], "left_anti")


def with_cached_hashes(blocks: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks with their cached hashes, blocks still to hash), so hashing runs on the latter only."""
    key = ["file_path", "file_hash", "block_start", "block_end"]
    known = cached.select(*key, "block_hash", "structural_hash")
    return blocks.join(known, key), blocks.join(known, key, "left_anti")


def upserted(state: DataFrame, fresh: DataFrame, key: str = "file_path") -> DataFrame:
    """The state with every file of `fresh` replaced; for blocks this drops a file's old blocks too."""
    return state.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def unexpired(state: DataFrame, now: float, days: int = 30) -> DataFrame:
    return state.filter(F.col("last_scan_time") >= now - days * 86_400)


def stats(files: DataFrame, blocks: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files")).crossJoin(blocks.agg(F.count("*").alias("blocks")))  # one row each


def config_hash(spark: SparkSession, config) -> DataFrame:
    """One row: the hash under which results of this configuration may be kept."""
    from dataclasses import asdict

    values = {k: str(v) for k, v in sorted(asdict(config).items())}
    return spark.createDataFrame([tuple(values.values())], list(values)).select(F.sha2(F.to_json(F.struct(*values)), 256).alias("config_hash"))
