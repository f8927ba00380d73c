"""Intent contracts: tags in comments that say what a block is for, parsed, scored and clustered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.operators.graph import components

LISTS = {"in": "inputs", "out": "outputs", "fx": "effects", "no": "forbidden", "scope": "scope"}
WEIGHTS = {"object": 0.22, "domain": 0.10, "inputs": 0.10, "outputs": 0.10, "effects": 0.06, "forbidden": 0.05, "algorithm": 0.04, "tags": 0.04, "priority": 0.03, "scope": 0.02}


def parsed(text: Column) -> Column:
    """struct of the first contract of a text, null where there is none:
    `@intent action:object !pN @domain in:a,b out:c fx:d no:e ~alg #tag scope:f`."""
    line = F.regexp_extract(text, "@intent[ \\t]+([^\\n]+)", 1)
    one = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit(""))
    many = lambda k: F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_extract(line, f"(?:^|\\s){k}:(\\S+)", 1), ","), lambda x: x != "")))
    fields = {
        "action": one("^([\\w-]+):"),
        "object": one("^[\\w-]+:([\\w.-]+)"),
        "priority": one("!p([0-9]+)"),
        "domain": one("\\s@([\\w.-]+)"),
        **{name: many(k) for k, name in LISTS.items()},
        "algorithm": one("~([\\w-]+)"),
        "tags": F.array_sort(F.array_distinct(F.regexp_extract_all(line, F.lit("#([\\w-]+)"), 1))),
    }
    return F.when(line.rlike("^[\\w-]+:"), F.struct(*[c.alias(k) for k, c in fields.items()]))


def score(a: Column, b: Column) -> Column:
    """Weighted agreement of two contracts of one action; equal ones score 1. Sets count by Jaccard, two
    empty ones as equal."""

    def same(name: str) -> Column:
        x, y = a[name], b[name]
        if name in ("object", "domain", "algorithm", "priority"):
            return F.when(x.eqNullSafe(y), 1.0).otherwise(0.0)
        union = F.size(F.array_union(x, y))
        return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)

    total = F.lit(0.24)
    for name, weight in WEIGHTS.items():
        total = total + weight * same(name)
    return F.when(a == b, 1.0).otherwise(F.round(total, 6))


def clusters(blocks: DataFrame, key: str = "key", contract: str = "contract", threshold: float = 0.84) -> DataFrame:
    """(key, cluster): contracts joined on their action; equal ones are one point first."""
    rows = blocks.filter(F.col(contract).isNotNull()).select(F.col(key).alias("key"), F.col(contract).alias("c"), F.xxhash64(F.to_json(contract)).alias("node"))
    points = rows.groupBy("node").agg(F.first("c").alias("c"))
    side = lambda s: points.select(F.col("c.action").alias("action"), F.col("node").alias(s), F.col("c").alias(f"{s}_c"))
    pairs = side("a").join(side("b"), "action").filter((F.col("a") < F.col("b")) & (score(F.col("a_c"), F.col("b_c")) >= threshold)).select("a", "b")
    label = components(pairs).select(F.col("node").alias("l_node"), "label")
    return rows.join(label, F.col("node") == F.col("l_node"), "left").select("key", F.coalesce("label", "node").alias("cluster"))
