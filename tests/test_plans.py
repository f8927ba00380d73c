import json

from echofold.api import HANDLERS
from echofold.config import DedupConfig
from echofold.plans.analysis import analyze, compare_corpora
from echofold.sinks import report
from echofold.streaming.incremental import StateMerger, fresh_files, windowed_activity

TAX = "def calculate_{n}({a}):\n    rate = 0.2\n    if {a} > 10:\n        rate = 0.3\n    total = {a} * rate\n    total = round(total, 2)\n    print('tax', total)\n    return total\n"


def project(folder, unique=True):
    """Three functions that differ in the name of their parameter only."""
    for i, (name, value) in enumerate((("a", "amount"), ("b", "value"), ("c", "price"))):
        (folder / f"pkg{i}").mkdir(parents=True)
        (folder / f"pkg{i}" / f"{name}.py").write_text(TAX.format(n="tax", a=value))
    if unique:
        (folder / "other.py").write_text("def lonely(x):\n    y = [x]\n    y.append(3)\n    return y\n")
    return str(folder)


def test_triplicate_project(spark, tmp_path):
    root = project(tmp_path / "p")
    groups = HANDLERS["find_duplicates"](spark, root).collect()
    assert [(g["duplicate_type"], g["occurrences"], g["name"], g["saved_lines"]) for g in groups] == [("structural", 3, "calculate_tax", 16)]
    assert not HANDLERS["check_project"](spark, root, DedupConfig(gate_groups=0)).first()["passed"]
    text = HANDLERS["project_report"](spark, root, "toon")
    assert "calculate_tax" in text and "DUPLICATES[1]" in text and "pkg0/a.py:1-8" in text
    (tmp_path / "empty").mkdir()
    assert HANDLERS["find_duplicates"](spark, str(tmp_path / "empty")).count() == 0


def test_reports_round_trip(spark, tmp_path):
    a = HANDLERS["analyze_project"](spark, project(tmp_path / "p"))
    made = report.write_reports(a, str(tmp_path / "out"), ("all",))
    assert len(made) == len(report.FORMATS)
    assert json.loads((tmp_path / "out" / "report.json").read_text())["groups"][0]["occurrences"] == 3
    report.write_groups_json(a, str(tmp_path / "groups"))
    assert report.load_groups(spark, str(tmp_path / "groups")).first()["fragments"][0]["file"] == "pkg0/a.py"


def test_fuzzy_tier(spark):
    more = "".join(f"    step{i} = total * rate + offset(step{i})\n" for i in range(20))
    rows = [(f"m/{k}.py", 1, 28, TAX.format(n=k, a="amount").replace("    return total\n", more + "    return total\n").replace("> 10", "> 10" if k == "one" else ">= 10"), f"calculate_{k}", None, 28) for k in ("one", "two")]
    blocks = spark.createDataFrame(rows, "file string, line_start int, line_end int, text string, function_name string, class_name string, line_count int")
    assert analyze(blocks).groups.count() == 0
    (g,) = analyze(blocks, DedupConfig(fuzzy=True)).groups.collect()
    assert g["duplicate_type"] == "fuzzy" and g["occurrences"] == 2 and g["similarity"] >= 0.8


def test_reports_say_what_they_leave_out(spark, tmp_path):
    a = HANDLERS["analyze_project"](spark, project(tmp_path / "p"))
    (g,) = report.collected(a, members=2)["groups"]
    assert len(g["fragments"]) == 2 and g["fragments_left_out"] == 1
    text = report.to_context(report.collected(a, members=2))
    assert "extract_function into utils/calculate_tax.py" in text and "and 1 more places" in text
    d = HANDLERS["compare_scans"](spark, report.snapshot(a), report.snapshot(a))
    assert report.diff_text(d) == "resolved: 0\nnew: 0\nunchanged: 1\n"


def test_compare(spark, tmp_path):
    a, b = project(tmp_path / "a", unique=False), project(tmp_path / "b")
    matches, _, decision = HANDLERS["compare_projects"](spark, a, b)
    assert matches.count() == 9 and decision.first()["decision"] in ("merge_projects", "extract_library")
    schema = "file string, line_start int, line_end int, text string, function_name string, class_name string, line_count int"
    x, y = (spark.createDataFrame([(f"{k}.py", 1, 4, f"def {k}():\n    {k} = 1\n    z\n    return {k if k == 'p' else [k]}", k, None, 4)], schema) for k in ("p", "q"))
    m, _, d = compare_corpora(x, y)
    assert m.count() == 0 and d.first()["decision"] == "keep_separate"


def test_stream_merges_state(spark, tmp_path):
    from datetime import datetime

    schema = "file_path string, content string, ts timestamp"
    told = []
    merger = StateMerger(str(tmp_path / "state"), lambda df, n: told.append((n, [tuple(r) for r in df.collect()])))
    source = tmp_path / "in"
    batches = [[("a", "x = 1"), ("b", "y = 2")], [("c", "x = 1 # again"), ("a", "x = 1")], [("b", "x = 1")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([(*r, datetime(2024, 1, 1, 0, k)) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(source))
        q = fresh_files(spark.readStream.schema(schema).parquet(str(source))).writeStream.foreachBatch(merger).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    state = {r["file_path"]: r["block_hash"] for r in merger.state(spark).collect()}
    assert set(state) == {"a", "b", "c"} and state["a"] == state["c"] == state["b"]
    assert [g[0][1] for _, g in told if g] == [2, 3]


def test_state_survives_restart_and_replay(spark, tmp_path):
    from datetime import datetime

    def batch(*rows):
        return spark.createDataFrame([(f, c, datetime(2024, 1, 1)) for f, c in rows], "file_path string, content string, ts timestamp")

    folder = str(tmp_path / "state")
    StateMerger(folder)(batch(("a", "1"), ("b", "2"), ("c", "3")), 0)
    told = []
    later = StateMerger(folder, lambda df, n: told.append(df.count()))  # as after a restart
    for _ in range(2):  # the batch is run again
        later(batch(("d", "1"), ("b", "9")), 1)
        state = {r["file_path"]: r["file_hash"] for r in StateMerger(folder).state(spark).collect()}
        assert set(state) == {"a", "b", "c", "d"} and state["a"] == state["d"] != state["b"]
    assert told == [1, 1]
    StateMerger(folder)(batch(("e", "5")), 2)
    assert later.state(spark).count() == 5


def test_windowed_activity(spark, tmp_path):
    from datetime import datetime

    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame([(datetime(2024, 1, 1, 0, m), "a", 1.0) for m in (1, 2, 11)], schema).write.parquet(str(tmp_path / "in"))
    q = windowed_activity(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 2]
