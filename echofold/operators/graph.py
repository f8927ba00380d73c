"""Graphs as edge DataFrames: connected components and modularity communities."""

from __future__ import annotations

import tempfile
import uuid
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


END = "\U0010ffff"  # of two names the longer comes first where one begins with the other


def _folder(spark: SparkSession) -> str:
    """The shared folder of the session; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="echofold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a written table: lineage ends here, in files that outlive an executor."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, label), label being the least node of the component. Each round takes
    the least label among neighbours and then the label of that label, so paths halve; a round is one
    written table and rounds grow with the logarithm of the longest path."""
    both = written(edges.selectExpr("a AS u", "b AS v").unionByName(edges.selectExpr("b AS u", "a AS v")).distinct(), "edges")
    labels = both.selectExpr("u AS node", "u AS label").distinct()
    while True:
        labels = written(labels, "labels")
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("least"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("was"), F.least("label", "least").alias("mid"))
        up = labels.selectExpr("node AS up_node", "label AS up")
        moved = written(step.join(up, F.col("mid") == F.col("up_node")).select("node", "was", F.least("mid", "up").alias("label")), "labels")
        labels = moved.select("node", "label")
        if not moved.filter("was <> label").take(1):
            return labels


def communities(edges: DataFrame, min_weight: float = 0.70) -> DataFrame:
    """(a string, b string, weight) -> (node, community): greedy modularity, component by component.
    Merging two communities that no edge joins never gains, so components may be worked on apart; the
    total weight is the whole graph's."""
    kept = written(edges.filter(F.col("weight") >= min_weight).select("a", "b", "weight"), "community-edges")
    total = kept.agg(F.sum("weight")).first()[0] or 0.0
    label = components(kept.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    rows = kept.withColumn("_n", F.xxhash64("a")).join(label, F.col("_n") == F.col("node")).select("label", "a", "b", "weight")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["a"], *pdf["b"]})
        at = {n: i for i, n in enumerate(names)}
        tie = {i: k for k, i in enumerate(sorted(range(len(names)), key=lambda i: names[i] + END))}
        links: list[dict[int, float]] = [{} for _ in names]
        for x, y, w in zip(pdf["a"], pdf["b"], pdf["weight"], strict=True):
            if x != y:
                a, b = at[x], at[y]
                links[a][b] = links[a].get(b, 0.0) + w
                links[b][a] = links[b].get(a, 0.0) + w
        degree = [sum(x.values()) for x in links]
        held = {i: [i] for i in range(len(names))}
        square = 2 * total * total
        offers: list[tuple] = []

        def offer(a: int, b: int, w: float) -> None:
            gain = w / total - degree[a] * degree[b] / square
            if gain > 4e-13:  # less is never taken
                heappush(offers, (-round(gain, 12), tie[a], tie[b], gain, a, b, w))

        # Degrees only grow, so while the weight between two communities stays, an old gain is a bound of the new
        # one: it is worked out again when it comes up, and only weights that change are offered anew.
        for a in held:
            for b, w in links[a].items():
                if a < b:
                    offer(a, b, w)
        while offers:
            least, *_, a, b, w = heappop(offers)
            if a not in held or b not in held or links[a].get(b) != w:
                continue
            gain = w / total - degree[a] * degree[b] / square
            if -round(gain, 12) != least:
                offer(a, b, w)
                continue
            if gain <= 1e-12:
                break
            held[a] += held.pop(b)
            degree[a] += degree[b]
            for c, w in links[b].items():
                links[c].pop(b)
                if c != a:
                    links[a][c] = links[c][a] = links[a].get(c, 0.0) + w
                    offer(min(a, c), max(a, c), links[a][c])
            links[b] = {}
        return pd.DataFrame([(names[n], names[min(group)]) for group in held.values() for n in group], columns=["node", "community"])

    return rows.groupBy("label").applyInPandas(greedy, "node string, community string")
