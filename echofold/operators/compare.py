"""Two corpora, or two runs over one: shared content, what changed, and a decision."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.functions.similarity import group_match_score, groups_match, jaccard
from echofold.functions.text import common_prefix
from echofold.operators.classify import decision
from echofold.operators.graph import communities, components


def structural_matches(a: DataFrame, b: DataFrame, key: str = "structural_hash") -> DataFrame:
    """Blocks of two corpora with one hash. A hash with many places on both sides is a product of
    places; places per hash are given once each side (`matched_hashes`) where that is too much."""
    side = lambda df, s: df.select(key, F.col("file").alias(f"file_{s}"), F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end")).alias(f"lines_{s}"), F.col("function_name").alias(f"function_{s}"))
    return side(a, "a").join(side(b, "b"), key).withColumns({"similarity": F.lit(1.0), "similarity_type": F.lit("structural")})


def matched_hashes(a: DataFrame, b: DataFrame, key: str = "structural_hash") -> DataFrame:
    """(key, n_a, n_b, first_a, first_b, loc) of hashes both corpora hold: membership, not pairs."""
    side = lambda df, s: df.groupBy(F.col(key).alias(f"{s}_key")).agg(F.count("*").alias(f"n_{s}"), F.min("file").alias(f"first_{s}"), F.max(F.col("line_end") - F.col("line_start")).alias(f"loc_{s}"))
    both = side(a, "a").join(side(b, "b"), F.col("a_key") == F.col("b_key"))
    return both.select(F.col("a_key").alias(key), "n_a", "n_b", "first_a", "first_b", F.greatest("loc_a", "loc_b").alias("loc"))


def unseen(matches: DataFrame, earlier: DataFrame) -> DataFrame:
    """Matches of a later tier at places no earlier tier matched."""
    return matches.join(earlier.select("file_a", "file_b", "lines_a", "lines_b"), ["file_a", "file_b", "lines_a", "lines_b"], "left_anti")


def best_matches(matches: DataFrame, min_loc: int = 2) -> DataFrame:
    """One row per pair of functions, the most similar, longest first."""
    loc = F.greatest(F.col("lines_a.end") - F.col("lines_a.start"), F.col("lines_b.end") - F.col("lines_b.start"))
    best = matches.withColumn("loc", loc).groupBy("function_a", "function_b", "file_a", "file_b").agg(F.max(F.struct("similarity", "loc")).alias("best"))
    return best.select("function_a", "function_b", "file_a", "file_b", "best.similarity", "best.loc").filter(F.col("loc") > min_loc).orderBy(F.desc("loc"), "file_a", "file_b")


def community_summary(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(community, n_members, avg_similarity, total_loc, candidate_name), longest first.
    nodes: (node, community); edges: (a, b, weight); names: (node, loc, name)."""
    sized = nodes.join(names, "node").groupBy("community").agg(F.count("*").alias("n_members"), F.sum("loc").alias("total_loc"), common_prefix(F.array_sort(F.collect_set("name"))).alias("candidate_name"))
    inside = edges.join(nodes.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(nodes.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").filter("ca = cb")
    weight = inside.groupBy(F.col("ca").alias("community")).agg(F.round(F.avg("weight"), 6).alias("avg_similarity"))
    return sized.filter("n_members > 1").join(weight, "community").orderBy(F.desc("total_loc"), "community")


def significant(summary: DataFrame, min_loc: int = 8, top: int = 20) -> DataFrame:
    return summary.filter(F.col("total_loc") >= min_loc).orderBy(F.desc("total_loc"), "community").limit(top)


def recommended(shared_loc: DataFrame, lines_a: DataFrame, lines_b: DataFrame) -> DataFrame:
    """One row (overlap_percent, shared_loc, decision, confidence) from one-row totals (loc), (n), (n)."""
    t = shared_loc.select(F.coalesce("loc", F.lit(0)).alias("shared_loc")).crossJoin(lines_a.select(F.col("n").alias("na"))).crossJoin(lines_b.select(F.col("n").alias("nb")))  # one row each
    overlap = F.when(F.col("na") + F.col("nb") > 0, F.col("shared_loc") / (F.col("na") + F.col("nb"))).otherwise(0.0)
    return t.withColumn("overlap", overlap).withColumn("d", decision(F.col("overlap"))).select("shared_loc", F.round(100 * F.col("overlap"), 4).alias("overlap_percent"), "d.decision", "d.confidence")


def compared(a: DataFrame, b: DataFrame, matches: DataFrame, min_similarity: float = 0.70) -> tuple[DataFrame, DataFrame]:
    """(community summary, decision) of two block tables and their matches."""
    node = lambda s: F.concat(F.lit(f"{s}:"), F.col(f"file_{s}"), F.lit("#"), F.col(f"lines_{s}.start").cast("string"))
    loc = lambda s: F.col(f"lines_{s}.end") - F.col(f"lines_{s}.start")
    edges = matches.select(node("a").alias("a"), node("b").alias("b"), F.col("similarity").alias("weight")).distinct()
    names = matches.select(node("a").alias("node"), loc("a").alias("loc"), F.col("function_a").alias("name")).unionByName(matches.select(node("b").alias("node"), loc("b").alias("loc"), F.col("function_b").alias("name"))).distinct()
    summary = community_summary(communities(edges, min_similarity), edges, names)
    total = lambda df: df.agg(F.coalesce(F.sum("line_count"), F.lit(0)).alias("n"))
    return summary, recommended(summary.agg(F.sum("total_loc").alias("loc")), total(a), total(b))


def scan_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(group_id, other_id, status): groups (group_id, duplicate_type, similarity, impact, hash, name, files)
    of two runs. Groups with one id are unchanged if they match; the others are matched greedily, best
    first and one to one, within connected components of what can match."""
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in ("group_id", "duplicate_type", "similarity", "impact", "hash", "name", "files")])
    gap = F.abs(F.col("b_similarity") - F.col("a_similarity"))
    files = jaccard(F.col("b_files"), F.col("a_files"))
    fits = groups_match(F.col("b_duplicate_type") == F.col("a_duplicate_type"), gap, files)
    b, a = side(before, "b"), side(after, "a")
    same = b.join(a, F.col("b_group_id") == F.col("a_group_id")).filter(fits).select("b_group_id", "a_group_id")
    rest_b, rest_a = b.join(same.select("b_group_id"), "b_group_id", "left_anti"), a.join(same.select("a_group_id"), "a_group_id", "left_anti")
    # candidates share a file; half of all files are then shared by the residual predicate
    by_file = lambda df, s: df.select(f"{s}_group_id", F.explode(f"{s}_files").alias("file"))
    met = by_file(rest_b, "b").join(by_file(rest_a, "a"), "file").select("b_group_id", "a_group_id").distinct()
    score = group_match_score(files, F.col("b_hash") == F.col("a_hash"), F.col("b_name").eqNullSafe(F.col("a_name")), gap)
    scored = met.join(rest_b, "b_group_id").join(rest_a, "a_group_id").filter(fits).select("b_group_id", "a_group_id", "b_impact", score.alias("score"))
    ids = lambda s, c: F.xxhash64(F.lit(s), F.col(c))
    label = components(scored.select(ids("b", "b_group_id").alias("a"), ids("a", "a_group_id").alias("b")))
    rows = scored.withColumn("_n", ids("b", "b_group_id")).join(label, F.col("_n") == F.col("node")).select("label", "b_group_id", "a_group_id", "b_impact", "score")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for (_, gid), part in sorted(pdf.groupby([-pdf["b_impact"], "b_group_id"]), key=lambda x: x[0]):
            free = part[~part["a_group_id"].isin(used)].sort_values(["score", "a_group_id"], ascending=[False, True])
            if len(free):
                used.add(free["a_group_id"].iloc[0])
                out.append((gid, free["a_group_id"].iloc[0]))
        return pd.DataFrame(out, columns=["b_group_id", "a_group_id"])

    pairs = same.unionByName(rows.groupBy("label").applyInPandas(match, "b_group_id string, a_group_id string"))
    unchanged = pairs.select(F.col("b_group_id").alias("group_id"), F.col("a_group_id").alias("other_id"), F.lit("unchanged").alias("status"))
    none = F.lit(None).cast("string").alias("other_id")
    resolved = b.join(pairs.select("b_group_id"), "b_group_id", "left_anti").select(F.col("b_group_id").alias("group_id"), none, F.lit("resolved").alias("status"))
    new = a.join(pairs.select("a_group_id"), "a_group_id", "left_anti").select(F.col("a_group_id").alias("group_id"), none, F.lit("new").alias("status"))
    return unchanged.unionByName(resolved).unionByName(new)


def diff_statistics(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n_groups"))
