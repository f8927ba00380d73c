import difflib
import math
import struct
import time

import pytest
from pyspark.sql import functions as F

from echofold.config import DedupConfig
from echofold.functions import similarity as S
from echofold.functions import text as T
from echofold.operators import blocks, candidates, classify, compare, contracts, graph, grouping, metrics, state
from echofold.sources import files


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_normalising_and_masking(spark):
    norm = lambda t: one(spark, t, T.normalized)
    masked = lambda t: one(spark, t, lambda c: T.masked(T.normalized(c)))
    assert norm("x = 1\n# note\n  y = 2  \n") == norm("x = 1\r\ny = 2 # said") == "x = 1\ny = 2"
    assert norm('"""doc\nbody\n"""') == "body"
    assert masked('name="alice"; age=25') == masked('name="bob"; age=30.5')
    assert masked("x = 1") != masked("for x in y: pass")
    assert norm(norm("a # b\n\n c")) == norm("a # b\n\n c")


def test_minhash_features(spark):
    f = lambda t: one(spark, t, lambda c: T.minhash_features(T.tokens(c)))
    assert f("") == []
    assert f("a b c") == ["a", "b", "c", "a b", "b c", "a b c"]
    assert f("a b c d e f g") == ["a", "b", "c", "d", "e", "a b", "b c", "c d", "d e", "e f"]


def test_simhash_forms_agree(spark):
    df = spark.createDataFrame([(["x y z", "q", "q"],), (["a"],), ([],)], "f array<string>")
    rows = df.select(T.portable_simhash(F.col("f"), 32).alias("a"), "f").collect()
    assert [r["a"] for r in rows] == [T.simhash(r["f"], 32) for r in rows]
    assert [r["fp"] for r in T.simhashed(df.withColumnRenamed("f", "features"), bits=32).collect()] == [r["a"] for r in rows]


def test_identifier_words(spark):
    assert one(spark, "computeTotal_price-list", T.identifier_words) == ["aggregate", "total", "price", "list"]


def test_similarities(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "a"), ("same", "same")], "a string, b string")
    got = df.select(S.levenshtein_ratio(F.col("a"), F.col("b")).alias("l"), S.close_levenshtein(F.col("a"), F.col("b"), 0.5).alias("c"), S.sequence_ratio()("a", "b").alias("s")).collect()
    assert [round(r["l"], 4) for r in got] == [round(4 / 7, 4), 0.0, 1.0]
    assert [r["c"] and round(r["c"], 4) for r in got] == [round(4 / 7, 4), None, 1.0]
    assert got[0]["s"] == difflib.SequenceMatcher(None, "kitten", "sitting").ratio() and got[1]["s"] == 0


def test_components_and_communities(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102)]
    labels = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    pairs = [(a, b, 0.9) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w", 0.8)]
    found = graph.communities(spark.createDataFrame(pairs, "a string, b string, weight double"), 0.7).collect()
    assert {r["node"]: r["community"] for r in found} == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("wxyz", "w")}


def member(gid, file, start=1, end=10, name="f", kind="exact"):
    return (gid, kind, file, start, end, name, None, "return g(x)")


MEMBER = "group_id string, duplicate_type string, file string, line_start int, line_end int, function_name string, class_name string, text string"


@pytest.mark.parametrize(
    ("paths", "kind", "want"),
    [
        (["a/x.py", "a/x.py"], "exact", "same_file"),
        (["js/src/c.js", "js/c.js"], "exact", "generated_copy"),
        (["js/src/c.js", "js/c.js"], "structural", "local_duplicate"),
        (["packages/u/c.js", "web/v/c.js"], "exact", "vendored_copy"),
        (["site/app/c.py", "app/c.py"], "exact", "deployment_mirror"),
        (["a/static/c.js", "b/lib/c.js"], "exact", "published_copy"),
        (["a/www/c.js", "b/assets/d.js"], "exact", "standalone_assets"),
        (["ios/app/c.py", "web/app/c.py"], "structural", "platform_variant"),
        (["shop-api-v1/c.py", "shop-api-v2/d.py"], "structural", "product_family"),
        (["a/c.py", "a/d.py"], "exact", "local_duplicate"),
        (["examples/a/c.py", "examples/b/d.py"], "exact", "cross_component"),
        (["a/c.py", "b/d.py"], "exact", "cross_component"),
    ],
)
def test_provenance(spark, paths, kind, want):
    rows = [member("g", p, i * 20 + 1, i * 20 + 10, kind=kind) for i, p in enumerate(paths)]
    assert classify.provenance(spark.createDataFrame(rows, MEMBER)).first()["provenance"] == want


def test_wrappers(spark):
    texts = ["def a(x):\n    return call(x)", "def b(x):\n    return call(x, 2)"]
    rows = [("g", "structural", "m.py", 1 + 5 * i, 2 + 5 * i, "ab"[i], None, t) for i, t in enumerate(texts)]
    assert classify.provenance(spark.createDataFrame(rows, MEMBER), with_text=True).first()["provenance"] == "delegating_wrappers"
    rows[1] = (*rows[1][:-1], "def b(x):\n    if x:\n        return call(x)")
    assert classify.provenance(spark.createDataFrame(rows, MEMBER), with_text=True).first()["provenance"] == "same_file"


def test_suggestions_rank_and_skip(spark):
    rows = [member("big", "a/x.py", 1, 60), member("big", "a/y.py", 1, 60), member("small", "a/x.py", 100, 102), member("small", "a/y.py", 100, 102), member("copy", "s/src/q.js", 1, 90), member("copy", "s/q.js", 1, 90)]
    m = spark.createDataFrame(rows, MEMBER)
    got = {r["group_id"]: r for r in classify.suggestions(grouping.summarized(m), m, classify.provenance(m)).collect()}
    assert set(got) == {"big", "small"} and (got["big"]["priority"], got["small"]["priority"]) == (2, 3)
    assert got["big"]["action"] == "extract_module" and got["small"]["action"] == "extract_function" and got["big"]["new_module"] == "a/utils/f.py" and got["big"]["risk_level"] == "medium"


def test_subsets_and_bounds(spark):
    rows = [member("a", f"f{i}", 1, 30) for i in range(3)] + [member("b", f"f{i}", 1, 30) for i in range(2)] + [member("c", f"z{i}", 1, 5) for i in range(2)]
    m = spark.createDataFrame(rows, MEMBER)
    g = grouping.summarized(m)
    assert {r["group_id"] for r in grouping.without_subsets(m, g).collect()} == {"a", "c"}
    assert [r["group_id"] for r in grouping.bounded(g, max_saved_lines=60).collect()] == ["a"]


def test_greedy_pairs(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.95), ("c", "d", 0.9), ("x", "y", 0.5)], "a string, b string, similarity double")
    assert {(r["a"], r["b"]) for r in grouping.one_to_one(pairs).collect()} == {("b", "c"), ("x", "y")}
    stars = {(r["anchor"], r["member"]) for r in grouping.star_clusters(pairs).collect()}
    assert stars == {("a", "a"), ("a", "b"), ("c", "c"), ("c", "d"), ("x", "x"), ("x", "y")}


def test_minhash_pairs_miss_nothing(spark):
    import random

    rng = random.Random(2)
    base = [[f"{rng.random()}" for _ in range(128)] for _ in range(6)]
    rows = []
    for i, b in enumerate(base):
        for k in (0, 20, 25, 26, 60):
            s = list(b)
            for j in rng.sample(range(128), k):
                s[j] = f"{rng.random()}"
            rows.append((f"{i}/{k}", s))
    packed = [(k, b"".join(struct.pack("<d", float(x)) for x in s)) for k, s in rows]
    classes, _ = candidates.signature_classes(spark.createDataFrame(packed, "key string, sig binary"), "key", "sig")
    got = {(r["l"], r["r"]) for r in candidates.minhash_pairs(classes, 0.8).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and sum(p == q for p, q in zip(x, y, strict=True)) >= math.ceil(0.8 * 128)}
    assert got == want and want


def test_knn_and_cosine_blocks(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(90, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    got = {(r["l"], r["r"]) for r in candidates.cosine_pairs(df, 0.5, block=16).collect()}
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.5}
    near = candidates.knn(df, df.filter("id % 50 = 0"), 3, block=16).collect()
    for q in (0, 50):
        assert [r["neighbour"] for r in sorted(near, key=lambda r: r["rank"]) if r["query"] == q] == [int(j) for j in np.argsort(-s[q]) if j != q][:3]


def test_extractors(spark):
    src = [
        ("a.py", "import x\n\ndef f(a):\n    return a\n\nclass C:\n    @deco\n    def m(self):\n        def inner():\n            pass\n        return 1\n"),
        ("bad.py", "def (:"),
        ("b.js", "function add(a, b) {\n  if (a) {\n    return b;\n  }\n}\n"),
        ("c.rb", "class A\n  def go\n    1\n  end\nend\n"),
        ("d.html", "<div>\n<p>\nx\n</p>\n</div>\n"),
        ("e.css", ".a {\n color: red;\n}\n"),
        ("f.sql", "SELECT 1\nFROM t;\n\nDROP TABLE x;\n"),
    ]
    got = blocks.functions(spark.createDataFrame(src, "path string, content string")).collect()
    named = {(r["file"], r["function_name"], r["class_name"], r["line_start"], r["line_end"]) for r in got}
    assert named >= {("a.py", "f", None, 3, 4), ("a.py", "m", "C", 8, 11), ("a.py", "inner", None, 9, 10), ("b.js", "add", None, 1, 5), ("c.rb", "go", None, 2, 4), ("d.html", "<p>", None, 2, 4), ("d.html", "<div>", None, 1, 5), ("e.css", ".a", None, 1, 3), ("f.sql", "select", None, 1, 2)}
    assert not [r for r in got if r["file"] == "bad.py"]


def test_braces_in_strings_and_methods():
    js = 'function a() {\n  let s = "}";\n  // }\n  /* { */\n  return s;\n}\nclass K {\n  go(x) {\n    if (x) {\n      return `{`;\n    }\n  }\n}\n'
    assert [(r[0], r[1], r[3], r[4]) for r in blocks._Braces().eval(js)] == [(1, 6, "a", None), (8, 12, "go", "K")]
    css = "@media x {\n  .a {\n    color: red;\n  }\n}\n.b { c: d }\n"
    assert [(r[0], r[1], r[3]) for r in blocks._Rules().eval(css)] == [(1, 5, "@media x"), (2, 4, ".a")]
    assert [(r[0], r[1], r[3]) for r in blocks._Sections().eval("# One\ntext\n\n## Two\nmore\n")] == [(1, 2, "One"), (4, 5, "Two")]
    assert [r[3] for r in blocks._Sections().eval("a:\n  - 1\nb: 2\nc:\n  d: 1\n")] == ["a", "c"]
    assert [r[3] for r in blocks._Sections().eval('{\n  "x": {\n    "y": 1\n  },\n  "z": 2\n}')] == ["x", "z"]


def test_syntax_shapes():
    from echofold.functions.syntax import shape

    assert shape("def f(a):\n    return a + 1") == shape("async def g(xyz):\n    return xyz + 'q'")
    assert shape("def f(a):\n    return a + 1") != shape("def f(a):\n    return a - 1")
    assert shape("a < b") != shape("a > b") and shape("not python (") is None and shape("") is None and shape(None) is None


def test_file_filters(spark, tmp_path):
    for p in ("src/a.py", "src/test_a.py", ".git/x.py", "venv/y.py", "src/b.txt", "src/c.min.js", "deep/er/d.js"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x = 1 \xff\n")
    got = {r["path"]: r["content"] for r in files.read_files(spark, str(tmp_path), DedupConfig()).collect()}
    assert set(got) == {"src/a.py", "deep/er/d.js"} and got["src/a.py"] == "x = 1 \ufffd\n"
    assert {r["path"] for r in files.read_files(spark, str(tmp_path), DedupConfig(), ["./src/a.py"]).collect()} == {"src/a.py"}


def test_state(spark):
    now = spark.createDataFrame([("a", 1.0, "h1", 9.0), ("b", 2.0, "h2", 9.0), ("c", 3.0, "h3", 9.0)], "file_path string, file_mtime double, file_hash string, last_scan_time double")
    old = spark.createDataFrame([("a", 1.0, "h1", 5.0), ("b", 2.0, "old", 5.0), ("z", 1.0, "q", -1e7)], now.schema)
    new = state.misses(now, old)
    assert {r["file_path"] for r in new.collect()} == {"b", "c"}
    assert {(r["file_path"], r["file_hash"]) for r in state.upserted(old, new).collect()} == {("a", "h1"), ("b", "h2"), ("c", "h3"), ("z", "q")}
    assert {r["file_path"] for r in state.unexpired(old, 9.0).collect()} == {"a", "b"}


def test_diff(spark):
    schema = "group_id string, duplicate_type string, similarity double, impact double, hash string, name string, files array<string>"
    before = spark.createDataFrame([("a", "exact", 1.0, 9.0, "a", "f", ["x", "y"]), ("b", "exact", 1.0, 5.0, "b", "g", ["p", "q"]), ("gone", "exact", 1.0, 2.0, "c", "h", ["k"])], schema)
    after = spark.createDataFrame([("a", "exact", 1.0, 9.0, "a", "f", ["x", "y"]), ("b2", "exact", 0.95, 5.0, "n", "g", ["p", "q", "r"]), ("fresh", "exact", 1.0, 1.0, "d", "i", ["k2"])], schema)
    got = {(r["group_id"], r["other_id"], r["status"]) for r in compare.scan_diff(before, after).collect()}
    assert got == {("a", "a", "unchanged"), ("b", "b2", "unchanged"), ("gone", None, "resolved"), ("fresh", None, "new")}


@pytest.mark.parametrize(("shared", "want"), [(0, "keep_separate"), (10, "extract_library"), (30, "extract_library"), (70, "merge_projects")])
def test_decision(spark, shared, want):
    row = lambda n, c: spark.createDataFrame([(n,)], f"{c} long")
    assert compare.recommended(row(shared, "loc"), row(50, "n"), row(50, "n")).first()["decision"] == want


def test_contracts(spark):
    rows = [("a", "# @intent read:user !p1 @auth in:id out:user fx:db #core"), ("b", "// @intent read:user !p1 @auth in:id out:user fx:db #core"), ("c", "-- @intent read:order @shop in:id out:order"), ("d", "nothing")]
    df = spark.createDataFrame(rows, "key string, t string").withColumn("contract", contracts.parsed(F.col("t")))
    got = {r["key"]: r["cluster"] for r in contracts.clusters(df).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] == got["b"] != got["c"]


def test_rollups_and_gate(spark):
    m = spark.createDataFrame([member("g1", "a/x.py", 1, 36), member("g1", "b/y.py", 1, 36), member("g2", "a/x.py", 50, 57), member("g2", "a/z.py", 1, 8)], MEMBER)
    g = grouping.summarized(m)
    assert metrics.dependency_risk(m, g).first()["group_id"] == "g1"
    assert {(r["group_id"], r["minutes"], r["difficulty"]) for r in metrics.effort(g, m).collect()} == {("g1", 216.0, "hard"), ("g2", 16.0, "easy")}
    gate = metrics.quality_gate(g, max_groups=1, max_saved_lines=100).first()
    assert not gate["passed"] and gate["violations"] == "groups 2 > 1"


def test_config_layers():
    c = DedupConfig.layered({"min_lines": 5}, {"fuzzy": True}, env={"ECHOFOLD_MIN_LINES": "7", "ECHOFOLD_EXCLUDE": "a, b"})
    assert (c.min_lines, c.fuzzy, c.exclude) == (7, True, ("a", "b"))
    assert DedupConfig.from_toml("min_lines = 4\n[tool.echofold]\nmin_lines = 9\nfuzzy = true", env={}) == DedupConfig(min_lines=4, fuzzy=True)


def test_minhash_reads_whole_texts(spark):
    start = " ".join(f"s{i}" for i in range(12))
    rest = " ".join(f"w{i}" for i in range(400))
    rows = [("a", f"{start} {rest}"), ("b", f"{start} {rest} more"), ("c", start + " " + " ".join(f"z{i}" for i in range(400))), ("d", f"first {start} {rest}"), ("e", "")]
    classes, members = candidates.signature_classes(candidates.whole_signed(spark.createDataFrame(rows, "key string, norm string"), "key", "norm"), "key", "signature")
    assert {(r["key"], r["class_id"]) for r in members.collect()} >= {("a", "a"), ("c", "c")} and members.count() == 4
    got = {(r["l"], r["r"]) for r in candidates.minhash_pairs(classes, 0.8).collect()}
    named = {r["key"]: r["class_id"] for r in members.collect()}  # d begins otherwise and is all but equal to a
    assert named["d"] == named["a"] or (named["a"], named["d"]) in got
    assert not [p for p in got if "c" in p]


def test_joins_of_signatures_are_never_broadcast(spark):
    rows = spark.createDataFrame([(f"{i}", [f"x{i % 7}", "y"]) for i in range(40)], "key string, features array<string>")
    classes, members = candidates.signature_classes(candidates.signed(rows, "key", "features"), "key", "signature")
    for df in (candidates.signed(rows, "key", "features"), classes, members, candidates.minhash_pairs(classes, 0.8)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_thresholds_and_rounding_are_those_of_sql(spark):
    import numpy as np

    s = 0.3599998  # .36 when rounded
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [s, math.sqrt(1 - s * s)]), (3, [0.36001, math.sqrt(1 - 0.36001**2)])], "id long, vector array<double>")
    want = {(0, 3)}
    assert {(r["l"], r["r"]) for r in candidates.cosine_pairs(df, 0.36).filter("l = 0").collect()} == want
    assert {(r["l"], r["r"]) for r in candidates.cosine_pairs(df.filter("id % 2 = 0"), 0.36, other=df.filter("id % 2 = 1")).collect()} == want
    halves = [k / 1e6 for k in range(360050, 1000000, 100)]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in halves], "x double").select(S.rounded(F.col("x"))).collect()]
    assert got == [math.floor(h * 1e4 + 0.5) / 1e4 for h in halves] == S.half_up(np.array(halves), 4).tolist()


def test_pairs_of_blocks_come_few_at_a_time(spark):
    def sizes(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"n": [len(f)]})

    assert {r["n"] for r in candidates._in_small_batches(spark.range(0, 40, 1, 1).mapInPandas(sizes, "n long"), "few").collect()} == {8}


def test_subsets_of_many_components(spark):
    import random

    rng = random.Random(5)
    rows = [member(f"g{i}", f"f{rng.randrange(120)}", 1, 5 + i % 7, kind="intent" if i % 11 == 0 else "exact") for i in range(90) for _ in range(rng.randrange(2, 5))] + [member(f"one{i}", f"only{i}") for i in range(3)]
    rows = [(*r[:4], 10, *r[5:]) for r in rows]
    m = spark.createDataFrame(rows, MEMBER).distinct()
    g = grouping.summarized(m)
    places = {}
    for r in m.collect():
        places.setdefault(r["group_id"], set()).add(r["file"])
    seen, want = set(), set()
    for r in sorted(g.collect(), key=lambda r: (-r["impact"], r["group_id"])):
        if r["duplicate_type"] == "intent" or len(places[r["group_id"]] - seen) >= 2:
            want.add(r["group_id"])
            seen |= places[r["group_id"]]
    kept = grouping.without_subsets(m, g)
    assert {r["group_id"] for r in kept.collect()} == want and len(want) < g.count()
    assert "FlatMapGroupsInPandas" not in kept._jdf.queryExecution().executedPlan().toString()


def test_one_to_one_is_greedy_and_sees_no_component(spark):
    import random

    rng = random.Random(6)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(500)) if a < b})
    rows = [(a, b, rng.randrange(36, 60) / 100) for a, b in pairs]
    df = spark.createDataFrame(rows, "a long, b long, similarity double")
    used, want = set(), []
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if not {a, b} & used:
            used |= {a, b}
            want.append((a, b, s))
    got = grouping.one_to_one(df)
    assert {tuple(r) for r in got.collect()} == set(want)
    assert [tuple(r) for r in grouping.one_to_one(df, 7).collect()] == want[:7]
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_band_pairs_meet_by_sets_of_bands(spark):
    import random

    rng = random.Random(7)
    prints = ["".join(rng.choice(("0000", "1111")) for _ in range(4)) for _ in range(60)]
    rows = [(f"{i:02}", rng.choice(("a", "b")), rng.randrange(3, 14), fp) for i, fp in enumerate(prints)]
    pairs = candidates.band_pairs(spark.createDataFrame(rows, "key string, suffix string, line_count int, fp string"), "fp", 4)
    points = {}
    for key, *point in sorted(rows, reverse=True):
        points[tuple(point)] = key
    shared = lambda x, y: sum(x[i : i + 4] == y[i : i + 4] for i in range(0, 16, 4))
    want = {(k, m, shared(p[2], q[2])) for p, k in points.items() for q, m in points.items() if k < m and p[0] == q[0] and abs(p[1] - q[1]) <= 4 and shared(p[2], q[2]) >= 2}
    assert {tuple(r) for r in pairs.collect()} == want and pairs.count() == len(want)
    assert "Aggregate" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_simhash_makes_runs_of_tokens(spark):
    df = spark.createDataFrame([(["x", "y", "z", "x", "y", "z"],), (["a", "b"],), ([],)], "features array<string>")
    want = [r["fp"] for r in T.simhashed(df.select(T.trigrams(F.col("features")).alias("features"))).collect()]
    assert [r["fp"] for r in T.simhashed(df, runs=3).collect()] == want


def test_communities_of_a_large_component(spark):
    cliques = [[f"{i}_{j}" for j in range(6)] for i in range(150)]
    edges = [(a, b, 0.9) for c in cliques for a in c for b in c if a < b] + [(cliques[i][0], cliques[i + 1][1], 0.4) for i in range(149)]
    began = time.time()
    found = graph.communities(spark.createDataFrame(edges, "a string, b string, weight double"), 0.3).collect()
    assert len(found) == 900 and all(len({r["community"] for r in found if r["node"] in c}) == 1 for c in map(set, cliques))
    assert time.time() - began < 60


def _edited(n, seed=8):
    """Texts of syllables and their copies with edits: at random, evenly spaced (no long run is left), cut off."""
    import random

    rng = random.Random(seed)
    out = {}
    for i in range(n):
        t = "".join(rng.choice(("the", "ing ", "er", "that ", "ou", "qu", "zx", "9", "é", ". ")) for _ in range(rng.choice((12, 60, 80, 250))))
        spaced = lambda k: "".join("#" if j % k == k - 1 else c for j, c in enumerate(t))  # noqa: B023, E731
        some = "".join(rng.choice(("", c, c, c, c, c, c + "j")) if rng.random() < 0.3 else c for c in t)
        out.update({f"{i:02}{s}": x for s, x in zip("abcdefg", (t, t, spaced(9), spaced(11), spaced(5), some, t[: len(t) * 7 // 10]), strict=True)})
    return out


def test_joins_of_texts_lose_no_pair(spark):
    from difflib import SequenceMatcher

    from echofold.operators import near_texts

    rows = _edited(8)
    classes, members = near_texts.text_classes(spark.createDataFrame([*rows.items(), ("x", None), (None, "y")], "key string, text string"))
    kept = {r["id"]: r["class_id"] for r in classes.collect()}
    assert len(kept) == len({*rows.values()}) and members.count() == len(rows) and all(rows[kept[r["id"]]] == rows[r["key"]] for r in members.collect())
    texts = {k: rows[k] for k in kept.values()}

    def distance(a, b):
        line = [*range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            above, line[0] = line[0], i
            for j, y in enumerate(b, 1):
                above, line[j] = line[j], min(above + (x != y), line[j] + 1, line[j - 1] + 1)
        return line[-1]

    both = [(a, b) for a in texts for b in texts if a < b and a[:2] == b[:2]]
    edited = {(a, b): 1 - distance(texts[a], texts[b]) / max(len(texts[a]), len(texts[b])) for a, b in both}
    got = {(kept[r["a"]], kept[r["b"]]): r["similarity"] for r in near_texts.edit_pairs(classes, 0.9).collect()}
    assert {p: s for p, s in got.items() if p in edited} == {p: s for p, s in edited.items() if s >= 0.9 - 1e-9} and len(got) > 8
    matched = {(a, b): SequenceMatcher(None, texts[a], texts[b]).ratio() for a, b in both}
    got = {(kept[r["a"]], kept[r["b"]]): r["similarity"] for r in near_texts.match_pairs(classes, 0.8).collect()}
    assert {p: s for p, s in got.items() if p in matched} == {p: s for p, s in matched.items() if s >= 0.8} and len(got) > 8


def test_edits_of_texts():
    from echofold.operators.near_texts import edits, grams_suffice

    assert edits("kitten", "sitting", 3) == 3 and edits("kitten", "sitting", 2) is None
    assert edits("", "ab", 2) == 2 and edits("abc", "abc", 0) == 0 and edits("xabcx", "xacx", 5) == 1
    assert grams_suffice("abcdefghij", "abcdXfghij", 1, 3) and not grams_suffice("abcdefghij", "jihgfedcba", 1, 3)


def test_edit_and_sequence_queries_see_pairs_without_common_bands(spark, tmp_path):
    from echofold.queries.similar import QUERIES

    base = "\n".join(f"line {i} of {i * 7919 % 1009}" for i in range(12))
    far = base.replace("\n", " ", 6)  # six lines fewer, at six edits
    docs = [(1, base, "en", "s"), (2, base, "en", "s"), (3, far, "de", "s"), (4, "a\nb\nc", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["levenshtein_verified_pairs"](spark, str(tmp_path)).collect()}
    assert got == {("s/1.en", "s/2.en", 1.0), ("s/1.en", "s/3.de", round(1 - 6 / len(base), 6))}
    assert [(r["group_id"], r["occurrences"]) for r in QUERIES["fuzzy_groups"](spark, str(tmp_path)).collect()] == [("s/1.en", 3)]
