"""Where a duplicate comes from, what to do about it, and how risky that is: rules as CASE columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.functions.text import component_root, path_parts
from echofold.operators.grouping import ranked

PUBLISHED = "assets build dist httpdocs public static www".split()
ASSETS = [s for s in PUBLISHED if s not in ("build", "dist")]
CONTROL = "\\b(" + "|".join("case catch else except for if match switch try while".split()) + ")\\b"
PROVENANCE = ["delegating_wrappers", "same_file", "generated_copy", "vendored_copy", "deployment_mirror", "published_copy", "standalone_assets", "platform_variant", "product_family", "local_duplicate", "cross_component"]
ACTIONABILITY = {"refactor": ["same_file", "local_duplicate"], "generated": ["generated_copy", "vendored_copy", "deployment_mirror", "published_copy"]}


def _without(parts: Column, segment: str) -> Column:
    at = F.array_position(parts, segment).cast("int")
    return F.when(at > 0, F.concat(F.slice(parts, F.lit(1), at - 1), F.slice(parts, at + 1, F.size(parts)))).otherwise(parts)


def _any_pair(paths: Column, test) -> Column:
    return F.exists(paths, lambda p: F.exists(paths, lambda q: test(p, q)))


def source_output_pair(paths: Column) -> Column:
    return F.exists(paths, lambda p: F.array_contains(p, "src") & F.array_contains(paths, _without(p, "src")))


def vendored_pair(paths: Column) -> Column:
    last = lambda p: F.element_at(p, -1)
    return _any_pair(paths, lambda p, q: F.array_contains(p, "packages") & F.array_contains(q, "web") & (p != q) & (last(p) == last(q)))


def nested_mirror(paths: Column) -> Column:
    return _any_pair(paths, lambda p, q: (F.size(p) > F.size(q)) & (F.size(q) > 0) & (F.slice(p, F.size(p) - F.size(q) + 1, F.size(q)) == q))


def same_path_below_roots(paths: Column) -> Column:
    roots = F.array_distinct(F.transform(paths, lambda p: F.get(p, 0)))
    rests = F.array_distinct(F.transform(paths, lambda p: F.slice(p, 2, 1 << 20)))
    return (F.size(paths) > 1) & ~F.exists(paths, lambda p: F.size(p) < 2) & (F.size(roots) > 1) & (F.size(rests) == 1)


def family_prefix(roots: Column) -> Column:
    two = F.transform(roots, lambda r: F.slice(F.split(r, "[-_.]+"), 1, 2))
    return (F.size(roots) > 1) & (F.size(F.array_distinct(two)) == 1) & ~F.exists(two, lambda t: F.size(t) < 2)


def wrappers(texts: Column, names: Column, max_lines: Column) -> Column:
    """Short functions of different names that return what a common callee gives, without control flow."""
    bodies = F.transform(texts, lambda t: F.regexp_replace(F.regexp_replace(t, '(?s)""".*?"""', ""), "(?s)'''.*?'''", ""))
    calls = F.transform(bodies, lambda b: F.array_distinct(F.regexp_extract_all(b, F.lit("\\b([A-Za-z_$][\\w$]*(?:\\.[A-Za-z_$][\\w$]*)*)\\s*\\("), 1)))
    own = F.zip_with(calls, names, lambda c, n: F.array_except(c, F.array(n)))
    imports = F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit("\\bfrom\\s+([A-Za-z_][\\w.]*)\\s+import\\s+"), 1))
    shared = lambda a: F.size(F.aggregate(F.slice(a, 2, 1 << 20), F.element_at(a, 1), F.array_intersect)) > 0
    ok = (F.size(texts) > 1) & ~F.exists(texts, lambda t: F.coalesce(t, F.lit("")) == "") & (max_lines <= 20)
    named = ~F.exists(names, lambda n: F.coalesce(n, F.lit("")) == "") & (F.size(F.array_distinct(names)) == F.size(names))
    plain = ~F.exists(bodies, lambda b: b.rlike(CONTROL) | (F.size(F.regexp_extract_all(b, F.lit("\\b(return)\\b"), 1)) != 1))
    return F.when(ok & named & plain, shared(own) | shared(imports)).otherwise(False)


def provenance(members: DataFrame, with_text: bool = False) -> DataFrame:
    """(group_id, duplicate_type, provenance, actionability) of groups by the paths of their members."""
    extra = [F.collect_list("text").alias("texts"), F.collect_list("function_name").alias("names"), F.max(F.col("line_end") - F.col("line_start") + 1).alias("most")] if with_text else []
    g = members.groupBy("group_id", "duplicate_type").agg(F.collect_set("file").alias("files"), *extra)
    g = g.withColumn("paths", F.transform("files", path_parts)).withColumn("roots", F.array_distinct(F.filter(F.transform("paths", component_root), lambda r: r != "")))
    paths, exact = F.col("paths"), F.col("duplicate_type") == "exact"
    names = F.array_distinct(F.transform(paths, lambda p: F.element_at(p, -1)))
    touches = lambda segments: lambda p: F.arrays_overlap(p, F.array(*map(F.lit, segments)))
    one_file = F.size("files") == 1
    what = (
        F.when(one_file & (wrappers(F.col("texts"), F.col("names"), F.col("most")) if with_text else F.lit(False)), "delegating_wrappers")
        .when(one_file, "same_file")
        .when(exact & source_output_pair(paths), "generated_copy")
        .when(exact & vendored_pair(paths), "vendored_copy")
        .when(exact & nested_mirror(paths), "deployment_mirror")
        .when(exact & (F.size(names) == 1) & F.exists(paths, touches(PUBLISHED)), "published_copy")
        .when(exact & ~F.exists(paths, lambda p: ~touches(ASSETS)(p)), "standalone_assets")
        .when(same_path_below_roots(paths), "platform_variant")
        .when(family_prefix(F.col("roots")), "product_family")
        .when(F.size("roots") <= 1, "local_duplicate")
        .otherwise("cross_component")
    )
    return g.select("group_id", "duplicate_type", what.alias("provenance")).withColumn("actionability", actionability(F.col("provenance")))


def actionability(provenance_: Column) -> Column:
    out = F.lit("review")
    for name, kinds in ACTIONABILITY.items():
        out = F.when(provenance_.isin(*kinds), name).otherwise(out)
    return out


def action(total_lines: Column, n_classes: Column) -> Column:
    return F.when(n_classes == 1, "extract_class").when(total_lines > 50, "extract_module").otherwise("extract_function")


def risk(actionability_: Column, n_files: Column, total_lines: Column, n_packages: Column) -> Column:
    return F.when(actionability_ == "review", "medium").when(n_files == 1, "low").when(total_lines > 30, "medium").when(n_packages > 2, "high").otherwise("low")


def common_directory(files: Column) -> Column:
    """The parts that the directories of all files begin with."""
    dirs = F.transform(files, lambda f: F.filter(F.split(F.regexp_extract(f, "^(.*)/[^/]*$", 1), "/"), lambda p: p != ""))
    least, most = F.array_min(dirs), F.array_max(dirs)
    n = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(least), F.size(most)) + 1), lambda i: (i <= F.least(F.size(least), F.size(most))) & (F.slice(least, F.lit(1), i) == F.slice(most, F.lit(1), i))))
    return F.array_join(F.slice(least, F.lit(1), n), "/")


def suggestions(groups: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per group worth a change, with the rank it has among all groups."""
    facts = members.groupBy(F.col("group_id").alias("m_id")).agg(
        F.array_sort(F.collect_set("file")).alias("files"),
        F.countDistinct("class_name").alias("n_classes"),
        F.countDistinct(F.when(F.instr("file", "/") > 0, F.substring_index("file", "/", 1))).alias("n_packages"),
    )
    kind = classes.select(F.col("group_id").alias("c_id"), "provenance", "actionability")
    all_ = ranked(groups).join(facts, F.col("group_id") == F.col("m_id")).join(kind, F.col("group_id") == F.col("c_id"))
    keep = all_.filter((F.col("saved_lines") > 0) & (F.col("actionability") != "generated") & (F.col("provenance") != "delegating_wrappers"))
    where = common_directory(F.col("files"))
    name = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("shared_block_"), F.substring("group_id", 1, 8)))
    why = F.format_string("%d occurrences of %d-line block across %d files, saves %d lines", "occurrences", "total_lines", F.size("files"), "saved_lines")
    return keep.select(
        "group_id",
        "priority",
        action(F.col("total_lines"), F.col("n_classes")).alias("action"),
        F.concat_ws("/", F.nullif(where, F.lit("")), F.lit("utils"), F.concat(name, F.lit(".py"))).alias("new_module"),
        F.array_join("files", ",").alias("original_files"),
        risk(F.col("actionability"), F.size("files"), F.col("total_lines"), F.col("n_packages")).alias("risk_level"),
        why.alias("rationale"),
    )


def task_priority(saved: Column) -> Column:
    return F.when(saved > 30, "critical").when(saved > 15, "major").otherwise("minor")


def task_difficulty(n_files: Column, n_packages: Column, total_lines: Column) -> Column:
    return F.when(n_files == 1, "easy").when((n_packages > 2) | (total_lines > 50), "hard").otherwise("medium")


def decision(overlap: Column) -> Column:
    """struct(decision, confidence) from the shared part of two corpora."""
    pick = lambda a, b: F.struct(F.lit(a).alias("decision"), F.lit(b).alias("confidence"))
    return F.when(overlap > 0.60, pick("merge_projects", 0.9)).when(overlap > 0.20, pick("extract_library", 0.8)).when(overlap > 0.05, pick("extract_library", 0.6)).otherwise(pick("keep_separate", 0.9))
