"""Whole analyses: one corpus to ranked groups with advice, two corpora to a decision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.config import DedupConfig
from echofold.functions import text as T
from echofold.functions.similarity import sequence_ratio
from echofold.operators import candidates, classify, compare, grouping, metrics
from echofold.operators.graph import written


@dataclass
class Analysis:
    """Lazy results; each is a DataFrame over the written blocks."""

    blocks: DataFrame
    members: DataFrame
    groups: DataFrame
    classes: DataFrame
    suggestions: DataFrame

    def summary(self) -> DataFrame:
        return metrics.by_actionability(self.groups, self.classes)

    def gate(self, config: DedupConfig = DedupConfig()) -> DataFrame:
        return metrics.quality_gate(self.groups, config.gate_groups, config.gate_lines)


def analyze(blocks: DataFrame, config: DedupConfig = DedupConfig(), external: DataFrame | None = None) -> Analysis:
    """Exact, then structural, then (if asked for) fuzzy and MinHash tiers, each over what the earlier ones
    left; subsets are dropped, what remains is classified and ranked. `external` holds the groups of
    another detector and is kept as it is."""
    hashed = written(grouping.hashed(blocks.filter(F.col("line_count") >= config.min_lines), syntax=True), "blocks")
    columns = [*grouping.MEMBER, "class_name", "text", "similarity"]
    one = lambda df: df.withColumn("similarity", F.lit(1.0)).select(columns)
    exact = grouping.exact_members(hashed)
    members = one(exact).unionByName(one(grouping.structural_members(hashed, exact)))
    if config.fuzzy:
        members = members.unionByName(_fuzzy(grouping.uncovered(hashed, members), config).select(columns))
    if config.minhash_threshold < 1:
        long = grouping.uncovered(hashed, members).filter(F.col("line_count") >= config.minhash_min_lines)
        members = members.unionByName(_near(long, config).select(columns))
    if external is not None:
        more, _ = grouping.external_groups(external)
        none = F.lit(None).cast("string")
        members = members.unionByName(more.withColumns({"class_name": none, "text": none}).select(columns))
    members = written(members, "members")
    groups = grouping.summarized(members, F.avg("similarity"))
    groups = written(grouping.without_subsets(members, groups), "groups")
    members = members.join(groups.select("group_id"), "group_id", "left_semi")
    classes = classify.provenance(members, with_text=True)
    return Analysis(hashed, members, grouping.ranked(groups), classes, classify.suggestions(groups, members, classes))


def _keyed(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("key", F.concat("file", F.lit("#"), F.col("line_start").cast("string")))


def _grouped(blocks: DataFrame, stars: DataFrame, kind: str) -> DataFrame:
    """Star clusters over keys as members."""
    joined = stars.join(_keyed(blocks), F.col("member") == F.col("key"))
    return joined.withColumns({"group_id": F.concat(F.lit(kind[0].upper()), F.substring(F.sha2("anchor", 256), 1, 16)), "duplicate_type": F.lit(kind)})


def _fuzzy(blocks: DataFrame, config: DedupConfig) -> DataFrame:
    b = _keyed(blocks.filter("function_name IS NOT NULL AND function_name <> ''"))
    suffix = F.lower(F.regexp_extract("file", "\\.([^./]+)$", 1)).alias("suffix")
    prints = written(T.simhashed(b.select("key", suffix, "line_count", T.code_tokens(F.col("text")).alias("features")), runs=3), "prints")
    same = prints.groupBy("suffix", "line_count", "fp").agg(F.min("key").alias("l"), F.collect_set("key").alias("rs")).filter(F.size("rs") > 1)
    stars = same.select("l", F.explode("rs").alias("r")).filter("l <> r")
    met = candidates.band_pairs(prints, "fp", 16).select("l", "r").unionByName(stars).distinct()
    side = lambda s: b.select(F.col("key").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("file", "line_start", "line_end", "norm")])
    both = met.join(side("l"), "l").join(side("r"), "r")
    apart = candidates.not_overlapping(*[F.col(f"{s}_{c}") for s in "lr" for c in ("file", "line_start", "line_end")])
    both = written(both.filter(apart).select("l", "r", "l_norm", "r_norm"), "fuzzy-pairs")
    near = both.select(F.col("l").alias("a"), F.col("r").alias("b"), sequence_ratio()("l_norm", "r_norm").alias("similarity")).filter(F.col("similarity") >= config.fuzzy_threshold)
    return _grouped(blocks, grouping.star_clusters(near), "fuzzy")


def _near(blocks: DataFrame, config: DedupConfig) -> DataFrame:
    classes, members = candidates.signature_classes(candidates.whole_signed(_keyed(blocks), "key", "norm"), "key", "signature")
    pairs = candidates.minhash_pairs(classes, config.minhash_threshold)
    same = members.filter("key <> class_id").select(F.col("class_id").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("similarity"))
    return _grouped(blocks, grouping.star_clusters(pairs.selectExpr("l AS a", "r AS b", "similarity").unionByName(same)), "near_duplicate")


def compare_corpora(a: DataFrame, b: DataFrame, config: DedupConfig = DedupConfig(), min_similarity: float = 0.75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, community summary, decision) of two block tables: the structural tier, then MinHash over
    the places it has not matched."""
    ha, hb = (written(_keyed(grouping.hashed(x.filter(F.col("line_count") >= config.min_lines), syntax=True)), "corpus") for x in (a, b))
    first = compare.structural_matches(ha, hb)
    columns = ["file_a", "file_b", "function_a", "function_b", "lines_a", "lines_b", "similarity", "similarity_type"]
    first = written(first.select(columns), "structural-matches")
    long = lambda df: df.filter(F.col("line_count") >= config.minhash_min_lines)
    (ca, ma), (cb, mb) = (candidates.signature_classes(candidates.whole_signed(long(x), "key", "norm"), "key", "signature") for x in (ha, hb))
    pairs = candidates.minhash_pairs(ca, min_similarity, cb)
    side = lambda df, m, s: m.join(df, "key").select(F.col("class_id").alias(f"{s}_class"), F.col("file").alias(f"file_{s}"), F.col("function_name").alias(f"function_{s}"), F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end")).alias(f"lines_{s}"))
    near = pairs.join(side(ha, ma, "a"), F.col("l") == F.col("a_class")).join(side(hb, mb, "b"), F.col("r") == F.col("b_class")).withColumn("similarity_type", F.lit("near_duplicate"))
    matches = written(first.unionByName(compare.unseen(near.select(columns), first)), "matches")
    summary, decided = compare.compared(ha, hb, matches, min_similarity)
    return matches, summary, decided
