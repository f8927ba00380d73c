"""Reports of an analysis. Tables go out through Spark; texts are made from the `top` groups only."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.operators import metrics
from echofold.plans.analysis import Analysis

FORMATS = ("json", "yaml", "toon", "markdown", "enhanced", "context", "todo")
GROUP_SCHEMA = "group_id string, duplicate_type string, occurrences long, n_files long, name string, total_lines long, saved_lines long, similarity double, impact double, priority int"


def write_tables(a: Analysis, folder: str) -> None:
    """Every result as its own Parquet table, whatever its size."""
    for name in ("members", "groups", "classes", "suggestions"):
        getattr(a, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def write_groups_json(a: Analysis, folder: str) -> None:
    """All groups with their members as JSON lines."""
    members = a.members.groupBy(F.col("group_id").alias("g")).agg(F.array_sort(F.collect_list(F.struct("file", "line_start", "line_end", "function_name"))).alias("fragments"))
    a.groups.join(members, F.col("group_id") == F.col("g")).drop("g").write.mode("overwrite").json(folder)


def load_groups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GROUP_SCHEMA + ", fragments array<struct<file string, line_start int, line_end int, function_name string>>").json(path)


def collected(a: Analysis, top: int = 30, members: int = 50) -> dict:
    """Totals over everything and the best `top` groups, as plain values: of each the first `members` places, and
    under `fragments_left_out` how many more there are (`write_groups_json` has all)."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    best = a.groups.orderBy("priority").limit(top)
    ids = [r["group_id"] for r in best.select("group_id").collect()]
    first = Window.partitionBy("group_id").orderBy("file", "line_start")
    files = a.members.filter(F.col("group_id").isin(ids)).select("group_id", "file", "line_start", "line_end").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= members).drop("_n")
    by_group: dict[str, list] = {}
    for r in rows(files.orderBy("group_id", "file", "line_start")):
        by_group.setdefault(r.pop("group_id"), []).append(r)
    groups = rows(best)
    for g in groups:
        g["fragments"] = by_group.get(g["group_id"], [])
        g["fragments_left_out"] = g["occurrences"] - len(g["fragments"])
    return {
        "summary": {r["actionability"]: {"groups": r["n_groups"], "saved_lines": r["saved_lines"]} for r in rows(a.summary())},
        "gate": rows(a.gate())[0],
        "groups": groups,
        "refactor_suggestions": rows(a.suggestions.orderBy("priority").limit(top)),
    }


def enhanced(a: Analysis, top: int = 30) -> dict:
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    effort = metrics.effort(a.groups, a.members)
    return collected(a, top) | {
        "duplication": rows(metrics.duplication_metrics(a.groups)),
        "languages": rows(metrics.language_rollup(a.members).orderBy("language")),
        "files": rows(metrics.file_rollup(a.members)),
        "complexity": rows(metrics.complexity_metrics(a.groups).orderBy("size_class")),
        "similarity": rows(metrics.similarity_histogram(a.groups).orderBy("bucket")),
        "refactoring": rows(metrics.refactoring_metrics(a.suggestions)),
        "effort_hours": round((effort.agg(F.sum("minutes")).first()[0] or 0) / 60, 2),
    }


def to_yaml(value: object, depth: int = 0) -> str:
    """Block-style YAML of plain values; scalars are JSON, which YAML reads."""
    pad = "  " * depth
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{json.dumps(str(k))}:" + (f"\n{to_yaml(v, depth + 1)}" if isinstance(v, dict | list) and v else f" {json.dumps(v, default=str)}\n") for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}-" + (f"\n{to_yaml(v, depth + 1)}" if isinstance(v, dict | list) and v else f" {json.dumps(v, default=str)}\n") for v in value)
    return f"{pad}{json.dumps(value, default=str)}\n"


def _marker(impact: float) -> str:
    return "!!" if impact > 100 else "!" if impact > 30 else ""


def to_toon(data: dict) -> str:
    """Compact sections, one line a row."""
    out = ["SUMMARY:"] + [f"  {k} groups={v['groups']} lines={v['saved_lines']}" for k, v in sorted(data["summary"].items())]
    out += ["GATE:", f"  passed={data['gate']['passed']} {data['gate']['violations']}".rstrip(), f"DUPLICATES[{len(data['groups'])}]:"]
    for g in data["groups"]:
        out.append(f"  [{g['group_id']}] {_marker(g['impact'])} {g['duplicate_type']} {g['name'] or '-'} L={g['total_lines']} N={g['occurrences']} saved={g['saved_lines']} sim={g['similarity']:.2f}")
        out += [f"      {f['file']}:{f['line_start']}-{f['line_end']}" for f in g["fragments"]]
    wins = [s for s in data["refactor_suggestions"] if s["risk_level"] == "low"]
    for title, some in (("REFACTOR", data["refactor_suggestions"]), ("QUICK_WINS", wins)):
        if some:
            out += [f"{title}[{len(some)}]:"] + [f"  [{s['priority']}] {s['action']} -> {s['new_module']} risk={s['risk_level']}" for s in some]
    return "\n".join(out) + "\n"


def to_markdown(data: dict) -> str:
    out = ["# Duplicate report", "", "| kind | groups | lines |", "| --- | --- | --- |"]
    out += [f"| {k} | {v['groups']} | {v['saved_lines']} |" for k, v in sorted(data["summary"].items())]
    for g in data["groups"]:
        out += ["", f"## {g['priority']}. {g['name'] or g['group_id']} ({g['duplicate_type']})", "", f"{g['occurrences']} places, {g['saved_lines']} lines to save.", ""]
        out += [f"- `{f['file']}` {f['line_start']}-{f['line_end']}" for f in g["fragments"]]
    return "\n".join(out) + "\n"


def to_todo(data: dict) -> str:
    """One task a suggestion."""
    saved = {g["group_id"]: g["saved_lines"] for g in data["groups"]}
    return "# TODO\n\n" + "".join(f"- [ ] {s['action']} into `{s['new_module']}` ({saved.get(s['group_id'], 0)} lines, {s['risk_level']} risk)\n" for s in data["refactor_suggestions"])


def snapshot(a: Analysis) -> DataFrame:
    """The groups of a run as `scan_diff` compares them."""
    files = a.members.groupBy(F.col("group_id").alias("g")).agg(F.array_sort(F.collect_set("file")).alias("files"))
    g = a.groups.join(files, F.col("group_id") == F.col("g"))
    return g.select("group_id", "duplicate_type", "similarity", "impact", F.col("group_id").alias("hash"), "name", "files")


def diff_text(statistics: DataFrame) -> str:
    found = {r["status"]: r["n_groups"] for r in statistics.collect()}
    return "".join(f"{k}: {found.get(k, 0)}\n" for k in ("resolved", "new", "unchanged"))


def to_context(data: dict) -> str:
    """What a reader who is to remove the duplicates needs: per group where to, how, and which places."""
    advice = {s["group_id"]: s for s in data["refactor_suggestions"]}
    out = ["# Duplicates to remove, best first"]
    for g in data["groups"]:
        s = advice.get(g["group_id"])
        out += ["", f"{g['priority']}. {g['name'] or g['group_id']}: {g['occurrences']} places, {g['saved_lines']} lines to save"]
        out += [f"   do: {s['action']} into {s['new_module']} ({s['risk_level']} risk); {s['rationale']}"] if s else []
        out += [f"   at: {f['file']}:{f['line_start']}-{f['line_end']}" for f in g["fragments"]]
        out += [f"   and {g['fragments_left_out']} more places"] if g["fragments_left_out"] else []
    return "\n".join(out) + "\n"


def rendered(a: Analysis, fmt: str, top: int = 30) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    if fmt == "enhanced":
        return json.dumps(enhanced(a, top), indent=1, default=str)
    data = collected(a, top)
    if fmt == "json":
        return json.dumps(data, indent=1, default=str)
    return {"yaml": to_yaml, "toon": to_toon, "markdown": to_markdown, "context": to_context, "todo": to_todo}[fmt](data)


def write_reports(a: Analysis, folder: str, formats: tuple[str, ...] = ("json",), top: int = 30) -> list[str]:
    """Files on the driver; `all` stands for every format."""
    names = {"json": "report.json", "yaml": "report.yaml", "toon": "report.toon", "markdown": "report.md", "enhanced": "report.enhanced.json", "context": "context.md", "todo": "TODO.md"}
    Path(folder).mkdir(parents=True, exist_ok=True)
    made = []
    for f in FORMATS if "all" in formats else formats:
        path = Path(folder) / names[f]
        path.write_text(rendered(a, f, top))
        made.append(str(path))
    return made
