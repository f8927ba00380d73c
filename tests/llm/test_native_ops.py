"""Line templates, quality rules, mixing and url reputation against plain Python or the SQL oracles."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from echofold.llm import line_templates, mixing, quality_rules, url_reputation
from echofold.llm.common import fresh_dir


def sql(query, **tables):
    """Rows of an oracle over small tables given as (schema, rows)."""
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({schema})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    r = con.execute(query)
    cols = [d[0] for d in r.description]
    return sorted((dict(zip(cols, row, strict=True)) for row in r.fetchall()), key=str)


def rows_of(df, columns):
    return sorted(({c: r[c] for c in columns} for r in df.collect()), key=str)


def same(df, want):
    assert df.count() == len(want)
    if want:
        cols = list(want[0])
        assert rows_of(df, cols) == sorted(want, key=str)


NOTE = "Page {} of the yearly report by {} for all our readers"
DOCS = (
    [(i, NOTE.format(i, ["Ann", "Bob", "Cy", "Di", "Ed", "Flo", "Gus", "Hal"][i % 8]) + f"\nOnly here is what number {i} says " + "abcdefghij"[i % 10] * 3 + "\nok", f"s{i % 3}") for i in range(40)]
    + [(100, None, "s0"), (101, "", None), (102, " \n\t\n", "s1"), (103, "x\x0by", None), (103, "x\x0by", None), (104, "z " * 1_500, "s2"), (None, NOTE.format(7, "Di"), "s9"), (105, "a b c d\n" * 5 + "tail", "s1")]
)
SCHEMA = "doc_id BIGINT, text VARCHAR, source VARCHAR"
SPARK = "doc_id long, text string, source string"


@pytest.mark.parametrize("docs", [DOCS, DOCS[40:], []])
def test_line_templates(spark, docs):
    same(line_templates.report(spark.createDataFrame(docs, SPARK)), sql(line_templates.SQL, documents=(SCHEMA, docs)))


def test_line_templates_drop_and_keep(spark):
    docs = spark.createDataFrame([(*d, 1, "m") for d in DOCS], SPARK + ", line int, keeper string")
    out = line_templates.without_recurring_lines(docs)
    assert out.columns == docs.columns and out.count() == len(DOCS)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[0].startswith("Page 0 of") and texts[0].endswith("\nok")  # the keeper
    assert all(texts[i] == "" for i in range(1, 40))  # names vary, too, and short lines recur whole
    assert texts[None] == "" and texts[100] is None and texts[102] == " \n\t\n" and texts[105] == DOCS[-1][1]


LISTS = [(1, "\n".join(f"item number {i} of the long list" for i in range(30)), "s"), (2, "item number 99 of the long list\nand more", "s")]
SHORT = [(i, f"only text {'abcdefghijklmno'[i] * 4} says so\nRead more\n{i}", "s") for i in range(12)]


@pytest.mark.parametrize("docs", [LISTS, SHORT, LISTS + SHORT, [(i, ("many words " * 9 + "\n") * (3000 if i == 3 else 2) + "x" * i, "s") for i in range(14)]])
def test_documents_are_counted_not_lines(spark, docs):
    same(line_templates.report(spark.createDataFrame(docs, SPARK)), sql(line_templates.SQL, documents=(SCHEMA, docs)))
    dropped = {r["doc_id"]: r["n_dropped"] for r in line_templates.report(spark.createDataFrame(docs, SPARK)).collect()}
    if docs is LISTS:
        assert dropped == {1: 0, 2: 0}  # thirty lines, but two documents
    if docs is SHORT:
        assert dropped == {0: 0, **dict.fromkeys(range(1, 12), 1)}


def test_copies_are_no_templates(spark):
    docs = [(i, "the very same line of every copy\nand its second line as well", "s") for i in range(50)]
    assert {r["n_dropped"] for r in line_templates.report(spark.createDataFrame(docs, SPARK)).collect()} == {0}


@pytest.mark.parametrize("docs", [DOCS, DOCS[40:], []])
def test_quality_rules(spark, docs):
    same(quality_rules.judged(spark.createDataFrame(docs, SPARK)), sql(quality_rules.SQL, documents=(SCHEMA, docs)))


def test_base_counts_by_hand(spark):
    texts = ["", None, "a b c", "a b c a b c", "a b a b a b a", "x\n\nx\ny\nx", "é # $é", "one two three four " * 20, "w"]
    got = {r["doc_id"]: r for r in quality_rules.judged(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SPARK)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))


def test_frequent_lines_are_removed(spark):
    docs = [(i, f"Shared  NOTE line\nown {i}\n\nshared note line", "h") for i in range(21)] + [(50, "shared note line", "other"), (51, None, None), (None, "shared note line\nx", "h"), (52, "y" * 200_000, "h")]
    df = spark.createDataFrame([(*d, 1, "p") for d in docs], SPARK + ", host int, places string")
    out = quality_rules.without_frequent_lines(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert all(got[i] == f"own {i}\n" for i in range(21)) and got[50] == "shared note line" and got[51] is None and got[None] == "x" and got[52] == docs[-1][1]
    counts = {r["doc_id"]: (r["removed_lines"], r["removed_words"]) for r in quality_rules.judged(df.drop("places")).collect()}
    assert counts[3] == (2, 6) and counts[None] == (1, 3) and counts[50] == (0, 0)
    few = spark.createDataFrame(docs[:20], SPARK)
    assert sorted(map(tuple, quality_rules.without_frequent_lines(few).collect())) == sorted(docs[:20])
    assert quality_rules.without_frequent_lines(few.limit(0)).count() == 0


def test_depleted_documents(spark):
    body = " ".join(f"w{k}" for k in range(80))
    docs = [(i, f"{body}\nown {i}", "h") for i in range(30)] + [(50 + i, f"{body}\n" + " ".join(f"d{i}x{k}" for k in range(90)), "h") for i in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judged(spark.createDataFrame(docs, SPARK)).collect()}
    assert not any(got[i] for i in range(30)) and all(got[50 + i] for i in range(5))


@pytest.mark.parametrize("docs", [DOCS, DOCS[40:], []])
def test_mixing(spark, docs):
    same(mixing.mixture_report(spark.createDataFrame(docs, SPARK)), sql(mixing.SQL, documents=(SCHEMA, docs)))


def waterfill(sizes, weights, repeats=3):
    """Resharing step by step."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weights[s] for s in open_)
        add = {s: left * weights[s] / total for s in open_}
        left = 0.0
        for s, a in add.items():
            target[s] += a
            if target[s] >= repeats * sizes[s]:
                left += target[s] - repeats * sizes[s]
                target[s] = float(repeats * sizes[s])
                open_ = open_ - {s}
    return target


def test_targets_by_resharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 20, "d": 5, "e": 3000, None: 40}
    docs = [(i, "w " * (n // 5), s) for s, n in sizes.items() for i in range(5)]
    docs = [(k, t, s) for k, (_, t, s) in enumerate(docs)]
    rows = mixing.mixture_report(spark.createDataFrame(docs, SPARK)).collect()
    src = {k: s for k, _, s in docs}
    weights = {s: i % 3 + 1 for i, s in enumerate(["a", "b", "c", "d", "e", None])}
    want = waterfill(sizes, weights)
    taken = defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(want[src[r["doc_id"]]]) and r["taken"] <= 3 * r["size"]
        taken[src[r["doc_id"]]] += r["taken"]
    for s, n in sizes.items():
        assert abs(taken[s] - want[s]) <= n // 5 + 1
    assert sum(taken.values()) <= sum(sizes.values())
    again = mixing.mixture_report(spark.createDataFrame(docs[::-1], SPARK).repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_repeats_rows(spark):
    docs = [(i, "w " * 10, "ab"[i % 10 == 0], 1, 2.0) for i in range(100)]
    df = spark.createDataFrame(docs, SPARK + ", size int, finish double")
    out = mixing.mix(df)
    counts = Counter(r["doc_id"] for r in out.collect())
    want = {r["doc_id"]: r["taken"] // 10 for r in mixing.mixture_report(df).collect() if r["taken"]}
    assert out.columns == df.columns and counts == want and max(counts.values()) == 3


URLS = [
    "http://EXAMPLE.org/en/12", "https://a.example.org/es/x?q=1", "https://example.org/fr/1#t", "http://x.org", "http://x.com/fr/9", "ftp://x.com/de/", "nothing", None, "://", "http://net.example.net?x/y",
    "http://badexample.org/es/", "http://a.b.co.uk/path", "http://com/fr/", "https://m.ex.com/en/#a?b", "http://\nX.com/de/1",
]


def test_url_rules(spark):
    pages = [(i, u, "<html></html>") for i, u in enumerate(URLS)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_reputation.judged(df, spark.createDataFrame([], "host string, good boolean")).collect()}
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best[1], best[2])


def world():
    docs, labels, pages = [], [], []
    for h, (host, good, n) in enumerate([("good.site.net", 0.95, 60), ("bad.site.net", 0.05, 60), ("few.site.net", 0.0, 1), ("solo.other.io", 0.9, 30)]):
        for k in range(n):
            i = len(docs)
            docs.append((i, f"text of {h} {k} & <more>\nsecond"))
            labels.append((i, int((k * 37 % 100) / 100 < good), 0))
            pages.append((i, f"http://{host}/p/{k}", f"<article><h1>t</h1><p>text of {h} {k} &amp; &lt;more&gt;</p><p>second</p></article>"))
    pages += [(900, "http://new.site.net/x", None), (901, None, "<p>"), (902, "http://unseen.zz/", "<article></article>")]
    return docs, labels, pages


def test_reputation(spark):
    docs, labels, pages = world()
    args = (spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = url_reputation.from_tables(*args)
    want = sql(url_reputation.SQL, pages=("page_id BIGINT, url VARCHAR, html VARCHAR", pages), documents=("doc_id BIGINT, text VARCHAR", docs), labels=("doc_id BIGINT, quality INT, toxic INT", labels))
    same(out, want)
    said = {r["host"]: r["verdict"] for r in out.collect()}
    assert said["bad.site.net"] == "block" and said["good.site.net"] == "allow" and said["solo.other.io"] == "allow"
    empty = [a.limit(0) for a in args]
    assert url_reputation.from_tables(*empty).count() == 0
    assert {r["verdict"] for r in url_reputation.from_tables(args[0], empty[1], empty[2]).collect()} == {"allow"}


def test_shared_folder_is_the_session_s(spark):
    assert fresh_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
