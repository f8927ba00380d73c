"""New files as a stream: each batch is hashed against the state, merged into it, and its new groups told."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions.text import normalized, short_hash
from echofold.operators.graph import written
from echofold.operators.state import misses, upserted


def fresh_files(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """A stream of (file_path, content, ts) without repeats of one content within the watermark."""
    named = stream.withColumn("file_hash", F.sha2("content", 256))
    return named.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["file_path", "file_hash"])


class StateMerger:
    """foreachBatch handler. The state is a folder of versions, each in a folder of its own name, and `commits`, a
    table of (batch, version) that gets a row when a version is whole. A batch builds on the version of the
    last batch before it, so a handler that is made anew goes on where the old one ended, and a batch that is
    run again reads what it read before; of its versions, which are equal, the least name counts."""

    def __init__(self, folder: str, told: Callable[[DataFrame, int], None] | None = None):
        self.folder, self.told = folder.rstrip("/"), told

    def version(self, spark: SparkSession, before: int | None = None) -> str | None:
        """Name of the newest version, or of that of the last batch below `before`; null if there is none."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return None
        done = spark.read.schema("batch long, version string").parquet(f"{self.folder}/commits")
        row = (done if before is None else done.filter(F.col("batch") < before)).orderBy(F.desc("batch"), "version").first()
        return row["version"] if row else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = batch.select("file_path", F.col("ts").cast("double").alias("file_mtime"), F.sha2("content", 256).alias("file_hash"), short_hash(normalized(F.col("content"))).alias("block_hash"))
        files = written(files.withColumn("last_scan_time", F.col("file_mtime")), "stream-batch")
        last = self.version(spark, number)
        before = spark.read.parquet(f"{self.folder}/{last}") if last else spark.createDataFrame([], files.schema)
        new = misses(files, before)
        name = f"v{number}-{uuid.uuid4().hex}"
        upserted(before, files).write.parquet(f"{self.folder}/{name}")
        spark.createDataFrame([(number, name)], "batch long, version string").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        if self.told:
            known = before.join(new.select("file_path"), "file_path", "left_anti").select("file_path", "block_hash")
            both = known.withColumn("is_new", F.lit(False)).unionByName(new.select("file_path", "block_hash").withColumn("is_new", F.lit(True)))
            groups = both.groupBy("block_hash").agg(F.count("*").alias("n_files"), F.max("is_new").alias("is_new"), F.min("file_path").alias("first_file"))
            self.told(groups.filter("n_files > 1 AND is_new").drop("is_new"), number)

    def state(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{self.version(spark)}")


def windowed_activity(stream: DataFrame, window: str = "10 minutes", watermark: str = "30 minutes") -> DataFrame:
    """Events (ts, event_type, value) per window and type; late rows within the watermark count."""
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
