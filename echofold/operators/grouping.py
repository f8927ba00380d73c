"""Duplicate groups: equal hashes, coverage, ranking measures, bounded and packed selections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.functions.syntax import syntax_shape
from echofold.functions.text import masked, normalized, short_hash
from echofold.operators.graph import components, written

MEMBER = ["group_id", "duplicate_type", "file", "line_start", "line_end", "function_name"]


def hashed(blocks: DataFrame, syntax: bool = False) -> DataFrame:
    """Blocks with exact_hash and structural_hash, the text being normalised once. The structure is the text
    with its literals masked; with `syntax`, of texts that parse as Python it is the shape of the tree, so
    other names make no difference."""
    norm = blocks.withColumn("norm", normalized(F.col("text")))
    if not syntax:
        return norm.withColumns({"exact_hash": short_hash(F.col("norm")), "structural_hash": short_hash(masked(F.col("norm")))})
    shaped = norm.withColumn("_shape", syntax_shape()("text"))
    both = shaped.withColumns({"exact_hash": short_hash(F.col("norm")), "structural_hash": short_hash(F.coalesce("_shape", masked(F.col("norm"))))})
    return both.drop("_shape")


def members_of(blocks: DataFrame, key: str, kind: str) -> DataFrame:
    """Rows of blocks whose key stands at two or more places. The count is a hash aggregate; the rows
    come back by a join on the keys that are left, so single blocks are not sorted or carried."""
    often = blocks.select(key, "file", "line_start").distinct().groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1")
    rows = blocks.join(often.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_semi")
    return rows.dropDuplicates([key, "file", "line_start"]).withColumns({"group_id": F.concat(F.lit(kind[0].upper()), F.col(key)), "duplicate_type": F.lit(kind)})


def exact_members(blocks: DataFrame) -> DataFrame:
    return members_of(blocks, "exact_hash", "exact")


def uncovered(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """Blocks at places no group holds yet."""
    return blocks.join(members.select("file", "line_start").distinct(), ["file", "line_start"], "left_anti")


def structural_members(blocks: DataFrame, covered: DataFrame) -> DataFrame:
    return members_of(uncovered(blocks, covered), "structural_hash", "structural")


def summarized(members: DataFrame, similarity: Column | None = None) -> DataFrame:
    """One row per group with the measures that rank it; the first member in (file, line) order sets
    its size and name."""
    first = F.min(F.struct("file", "line_start", "line_end", "function_name"))
    g = members.groupBy("group_id", "duplicate_type").agg(
        F.count("*").alias("occurrences"), F.countDistinct("file").alias("n_files"), first.alias("f"), (similarity if similarity is not None else F.lit(1.0)).alias("similarity")
    )
    lines = F.col("f.line_end") - F.col("f.line_start") + 1
    saved = F.when(F.col("occurrences") > 1, lines * (F.col("occurrences") - 1)).otherwise(0)
    return g.select("group_id", "duplicate_type", "occurrences", "n_files", F.col("f.function_name").alias("name"), lines.alias("total_lines"), saved.alias("saved_lines"), "similarity", (saved * F.col("similarity")).alias("impact"))


def in_order(groups: DataFrame) -> DataFrame:
    """The groups with `_n`, their rank by impact and then group id, and `_upto`, the lines saved up to them.
    Groups are sorted over all partitions; ranks and sums run inside a partition and get what comes before it
    from one row a partition, so no task holds all groups."""
    order = [F.desc("impact"), F.asc("group_id")]
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = written(groups.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = spread.withColumns({"_n": F.count("*").over(within), "_upto": F.sum("saved_lines").over(within)})
    sums = spread.groupBy("_part").agg(F.count("*").alias("_rows"), F.sum("saved_lines").alias("_lines"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sums = sums.withColumnRenamed("_part", "_p").select("_p", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_s0"))
    both = local.join(sums, F.col("_part") == F.col("_p"))
    return both.withColumns({"_n": F.col("_n") + F.col("_n0"), "_upto": F.col("_upto") + F.col("_s0")}).drop("_part", "_p", "_n0", "_s0")


def ranked(groups: DataFrame) -> DataFrame:
    """priority by impact, ties by group id."""
    return in_order(groups).withColumn("priority", F.col("_n").cast("int")).drop("_n", "_upto")


def bounded(groups: DataFrame, max_groups: int | None = None, max_saved_lines: int | None = None, min_impact: float = 0.0) -> DataFrame:
    """The best groups until a bound is reached; the group that reaches it is kept."""
    ran = in_order(groups.filter(F.col("impact") >= min_impact))
    if max_groups is not None:
        ran = ran.filter(F.col("_n") <= max_groups)
    if max_saved_lines is not None:
        ran = ran.filter(F.col("_upto") - F.col("saved_lines") < max_saved_lines)
    return ran.drop("_n", "_upto")


def without_subsets(members: DataFrame, groups: DataFrame, keep_type: str = "intent") -> DataFrame:
    """Groups, best first, that still bring two places no better group holds. The order matters only
    among groups that share places: a group that shares none is decided by its size, and of the others each
    connected component by itself, in one pass over sorted rows that holds the shared places of one component."""
    place = F.xxhash64("file", "line_start", "line_end")
    held = written(members.select("group_id", place.alias("place")).distinct(), "places")
    groups = written(groups, "groups")
    often = held.groupBy("place").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("place").alias("shared"))
    marked = held.join(often, F.col("place") == F.col("shared"), "left")
    sums = marked.groupBy("group_id").agg(F.count("*").alias("n"), F.count("shared").alias("n_shared"), F.collect_list("shared").alias("shared"))
    ranks = groups.select(F.col("group_id").alias("g"), "impact", "duplicate_type")
    sized = written(sums.join(ranks, F.col("group_id") == F.col("g")).drop("g"), "group-places")
    alone = sized.filter((F.col("n_shared") == 0) & ((F.col("duplicate_type") == keep_type) | (F.col("n") >= 2))).select(F.col("group_id").alias("kept"))
    several = sized.filter("n_shared > 0").withColumn("_node", F.xxhash64("group_id"))
    label = components(several.select(F.col("_node").alias("a"), F.explode("shared").alias("_p")).select("a", F.xxhash64(F.lit("place"), "_p").alias("b")))
    rows = several.join(label, F.col("_node") == F.col("node")).select("label", "group_id", F.col("duplicate_type").eqNullSafe(keep_type).alias("keep"), (F.col("n") - F.col("n_shared")).alias("own"), "shared", "impact")
    rows = rows.repartition("label").sortWithinPartitions("label", F.desc("impact"), "group_id").drop("impact")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, set()
        for batch in batches:
            kept = []
            for label, gid, keep, own, shared in zip(*batch.columns, strict=True):
                if label != at:
                    at, seen = label, set()
                places = set(shared.as_py())
                if keep.as_py() or own.as_py() + len(places - seen) >= 2:
                    kept.append(gid.as_py())
                    seen |= places
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], ["kept"])

    chosen = rows.mapInArrow(pack, "kept string").unionByName(alone)
    return groups.join(chosen, F.col("group_id") == F.col("kept"), "left_semi")


def star_clusters(pairs: DataFrame, kind: str = "string") -> DataFrame:
    """Greedy stars over verified pairs (a, b, similarity), nodes of type `kind`, a before b in order: an unused anchor takes
    all its unused partners. Components do not touch each other, so each is worked through alone.
    -> (anchor, member, similarity); the anchor is a member of similarity 1."""
    pairs = written(pairs, "pairs")
    label = components(pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    rows = pairs.withColumn("_n", F.xxhash64("a")).join(label, F.col("_n") == F.col("node")).select("label", "a", "b", "similarity")

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        out: list[tuple] = []
        for anchor, part in pdf.sort_values(["a", "b"]).groupby("a", sort=True):
            if anchor in used:
                continue
            mine = [(b, s) for b, s in zip(part["b"], part["similarity"], strict=True) if b not in used]
            if mine:
                out += [(anchor, anchor, 1.0), *((anchor, b, s) for b, s in mine)]
                used |= {anchor, *(b for b, _ in mine)}
        return pd.DataFrame(out, columns=["anchor", "member", "similarity"])

    return rows.groupBy("label").applyInPandas(stars, f"anchor {kind}, member {kind}, similarity double")


def one_to_one(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs by falling similarity, each node in one pair at most; `limit` cuts the ranking at the end. A pair that
    is the best of both its nodes is in the greedy matching whatever comes before it, so each round takes all of
    those and drops the pairs of their nodes; no task sees a component. With `limit`, pairs below the last of that
    many chosen ones can't come in any more and end there."""
    columns = pairs.columns
    order = F.struct((-F.col("similarity")).alias("_s"), "a", "b", *[c for c in columns if c not in ("similarity", "a", "b")])
    left = written(pairs.select(order.alias("e")), "pairs")
    chosen = left.limit(0)
    while left.take(1):
        best = left.select("e", F.explode(F.array_distinct(F.array("e.a", "e.b"))).alias("node")).groupBy("node").agg(F.min("e").alias("e"))
        ends = best.groupBy("e").agg(F.count("*").alias("_n")).filter(F.col("_n") == F.when(F.col("e.a") == F.col("e.b"), 1).otherwise(2))
        picked = written(ends.select("e"), "picked")
        chosen = written(chosen.unionByName(picked), "chosen")
        used = picked.select(F.explode(F.array("e.a", "e.b")).alias("node")).distinct()
        free = left.join(used, F.col("e.a") == F.col("node"), "left_anti").join(used, F.col("e.b") == F.col("node"), "left_anti")
        if limit:
            chosen = written(chosen.orderBy("e").limit(limit), "chosen")
            n, last = chosen.agg(F.count("*"), F.max("e")).first()
            if n == limit:
                free = free.filter(F.col("e._s") <= last["_s"])
        left = written(free, "pairs")
    out = chosen.select("e.*").withColumn("similarity", -F.col("_s")).select(columns)
    return out.orderBy(F.desc("similarity"), "a", "b").limit(limit) if limit else out


def reference_matches(members: DataFrame, ratio, threshold: float) -> DataFrame:
    """The members of each group that are similar enough to its first one, which stays."""
    first = Window.partitionBy("group_id").orderBy("file", "line_start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = members.withColumns({"_first": F.first(F.struct("file", "line_start", "norm")).over(first)})
    same = (F.col("file") == F.col("_first.file")) & (F.col("line_start") == F.col("_first.line_start"))
    scored = out.withColumn("similarity", F.when(same, F.lit(1.0)).otherwise(ratio(F.col("_first.norm"), F.col("norm"))))
    return scored.filter(F.col("similarity") >= threshold).drop("_first")


def external_groups(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, groups) from another detector's (group_id, similarity, fragments array<struct<file_path,
    start_line, end_line>>): the intent tier's way in."""
    each = groups.select("group_id", F.lit("intent").alias("duplicate_type"), "similarity", F.inline("fragments"))
    members = each.select("group_id", "duplicate_type", F.col("file_path").alias("file"), F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"), F.lit(None).cast("string").alias("function_name"), "similarity")
    return members, summarized(members, F.avg("similarity"))


def flattened(pairs: DataFrame) -> DataFrame:
    """Distinct places on either side of (l_file, l_line, r_file, r_line) matches."""
    side = lambda s: pairs.select(F.col(f"{s}_file").alias("file"), F.col(f"{s}_line").alias("line_start"))
    return side("l").unionByName(side("r")).distinct()


