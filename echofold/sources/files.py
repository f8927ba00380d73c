"""Files and tables as corpora: discovery, filters, decoding, and scan statistics."""

from __future__ import annotations

import fnmatch
import re
import subprocess
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.config import DedupConfig
from echofold.functions.text import path_parts

LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "go": "go", "rs": "rust", "kt": "kotlin", "swift": "swift", "scala": "scala", "m": "objc",
    "lua": "lua", "sh": "bash", "bash": "bash", "html": "html", "htm": "html", "xml": "xml", "svelte": "svelte", "vue": "vue", "css": "css", "scss": "css", "less": "css",
    "sql": "sql", "graphql": "graphql", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "vim": "vim", "conf": "nginx",
}
NAMED_FILES = {"Dockerfile": "dockerfile", "Makefile": "make"}


def language(path: Column) -> Column:
    """Language of a path by its file name or suffix; null where it is unknown."""
    name = F.element_at(F.split(path, "/"), -1)
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.element_at(pairs(NAMED_FILES), name), F.element_at(pairs(LANGUAGES), F.lower(suffix(path))))


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, "\\.([^./]+)$", 1)


def excluded(path: Column, globs: Iterable[str]) -> Column:
    """Whether a glob fits the whole path, its name, or any part of it. The globs become one pattern."""
    pattern = "|".join(f"(?:{re.sub(r'\\Z|\\z', '$', fnmatch.translate(g))})" for g in globs)
    pattern = pattern.replace("(?s:", "(?:")
    if not pattern:
        return F.lit(False)
    whole = f"^(?:{pattern})$"
    return path.rlike(whole) | F.exists(path_parts(path), lambda p: p.rlike(whole))


def is_test(path: Column) -> Column:
    parts = path_parts(path)
    name = F.element_at(parts, -1)
    named = name.rlike("test_|_test\\.|tests\\.|spec_|_spec\\.")
    inside = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.contains("test"))
    return F.when(F.exists(parts, lambda p: p.contains("pytest-")), False).otherwise(named | inside)


def read_files(spark: SparkSession, root: str, config: DedupConfig = DedupConfig(), only: Iterable[str] | None = None) -> DataFrame:
    """path (below root), content, size: decoded files under root that the filters let through. Size,
    path and time filters reach the file listing; `only` names the files instead of walking the tree."""
    paths = [f"{root.rstrip('/')}/{p.removeprefix('./')}" for p in only] if only is not None else [root]
    if only is not None and not paths:
        return spark.createDataFrame([], "path string, content string, size long")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(paths)
    below = F.regexp_replace("path", "^(file:)?/*" + re.escape(root.strip("/").removeprefix("file:")) + "/*", "")
    found = raw.filter(F.col("length") <= config.max_file_kb * 1024).select(below.alias("path"), "content", F.col("length").alias("size"))
    return filter_files(found, config).withColumn("content", decoded(F.col("content"))).dropDuplicates(["path"])


def filter_files(files: DataFrame, config: DedupConfig) -> DataFrame:
    """Keeps the wanted suffixes, drops hidden directories, excluded paths and, unless asked for, tests."""
    hidden = F.exists(F.slice(path_parts(F.col("path")), 1, F.greatest(F.size(path_parts(F.col("path"))) - 1, F.lit(0))), lambda p: p.startswith("."))
    ok = F.lower(suffix(F.col("path"))).isin(*config.extensions) & ~hidden & ~excluded(F.col("path"), config.exclude)
    return files.filter(ok if config.include_tests else ok & ~is_test(F.col("path")))


def decoded(content: Column) -> Column:
    """UTF-8 text, broken bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def first_of_each(files: DataFrame, identity: str = "real_path") -> DataFrame:
    """One row per identity, the one with the least path."""
    first = Window.partitionBy(identity).orderBy("path")
    return files.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def changed_files(root: str, since: str = "HEAD") -> list[str]:
    """Files changed or new since a git revision."""

    def git(*args: str) -> list[str]:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout.splitlines()

    return sorted(set(git("diff", "--name-only", "--diff-filter=d", since)) | set(git("ls-files", "--others", "--exclude-standard")))


def scan_stats(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: files, lines and blocks of a scan."""
    lines = files.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum(F.size(F.split("content", "\n"))), F.lit(0)).alias("total_lines"))
    return lines.crossJoin(blocks.agg(F.count("*").alias("total_blocks")))
