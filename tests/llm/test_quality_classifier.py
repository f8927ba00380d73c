import random
import zlib

import numpy as np
import pytest

from echofold.llm import quality_classifier as qc


def texts(n):
    rng = random.Random(6)
    stems = ["ter", "mon", "lis", "ga", "ver", "co", "ran", "du"]
    word = lambda: "".join(rng.choice(stems) for _ in range(rng.choice((1, 2, 2, 3))))
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.choice((30, 80, 300)))]
        bad = i % 4 == 0
        if bad:
            w = [[x + "###" for x in w], [x.upper() + "!!" for x in w], [w[0]] * len(w)][i // 4 % 3]
        out.append((i, " ".join(w).capitalize() if not bad else " ".join(w), int(not bad)))
    return out


def test_held_out_accuracy(spark):
    rows = texts(900)
    docs = spark.createDataFrame([(i, t, "en", "s", 3) for i, t, _ in rows] + [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, " \n", "en", "s", 0)], "doc_id long, text string, lang string, score string, predicted int")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(0, 1, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in qc.report(docs, labels).collect()}
    assert len(got) == 903
    right = [got[i]["predicted"] == q for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(right) > 150 and np.mean(right) > 0.97
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.7) for i in got)
    assert got[9001]["score"] == got[9002]["score"] == got[9003]["score"] == 0
    kept = qc.good_documents(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    assert qc.report(docs.limit(0), labels).count() == 0
    few = {r["score"] for r in qc.report(docs.filter("doc_id < 9000"), labels.limit(3)).collect()}
    assert len(few) == 1


def test_held_out_rows_do_not_matter(spark):
    rows = texts(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = lambda i, q: 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q
    a, b = (spark.createDataFrame([(i, f(i, q)) for i, _, q in rows], "doc_id long, quality int") for f in (lambda i, q: q, flip))
    assert sorted(map(tuple, qc.report(docs, a).collect())) == sorted(map(tuple, qc.report(docs, b).collect()))


def test_logistic_against_gradient():
    rng = np.random.default_rng(1)
    x = np.c_[np.ones(300), rng.normal(size=(300, 2))]
    y = (rng.random(300) < 1 / (1 + np.exp(-x @ [0.5, 2, -1]))).astype(float)
    w = qc.logistic(x, y)
    slope = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + np.array([1e-6, 1e-2, 1e-2]) * w
    assert np.abs(slope).max() < 1e-6


@pytest.mark.parametrize("repeat", [1, 7])
def test_scores_are_of_whole_texts(repeat):
    model = qc.fit([r for r in texts(300)])
    z = model.compressors()
    good, bad = (next(t for _, t, q in texts(300) if q == k and len(t) > 400).encode() for k in (1, 0))
    head = good * (8 * repeat)
    assert model.score(head + bad * 40 * repeat, z) < model.score(head, z)


def test_scores_against_plain_compression(spark):
    """Every score by itself: one compressor a dictionary and block, sizes added, the logistic function."""
    import math

    import zstandard

    rows = [*texts(160), (5000, "long text of many blocks, " * 3000, 1), (5001, None, 0), (None, "no id at all " * 9, 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i is not None], "doc_id long, quality int")
    model = qc.fit(qc.sample(docs, labels))
    assert model.weights is not None

    def size(data, d):
        z = zstandard.ZstdCompressor(level=qc.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False)
        return sum(len(z.compress(data[i : i + 4096])) for i in range(0, len(data), 4096))

    def shape(data):
        return bytes(97 if chr(b).islower() and b < 128 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in data)

    got = {r["doc_id"]: r["score"] for r in qc.report(docs, labels).collect()}
    for i, t, _ in rows:
        data = (t or "").encode()
        if not data:
            assert got[i] == 0
            continue
        g, b, gs, bs = (size(x, d) for x, d in zip((data, data, shape(data), shape(data)), model.dictionaries, strict=True))
        f = [1, (g - b) / max(g, b), (gs - bs) / max(gs, bs), math.log(g / len(data)), math.log(gs / len(data))]
        assert abs(got[i] - 1 / (1 + math.exp(-float(np.dot(model.weights, f))))) < 2e-3


def test_sample_is_refilled_and_does_not_depend_on_order(spark):
    rows = texts(200)
    long = [(i, t * 40 if i % 8 == 1 else t) for i, t, _ in rows] + [(i, t + " again") for i, t, _ in rows[:50]]
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    a, b = (sorted(qc.sample(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels, rows=40)) for x, n in ((long, 1), (long[::-1], 5)))
    assert a == b and sum(q for _, _, q in a) == 40 and any(len(t) > 4000 for _, t, _ in a)
    few = qc.sample(spark.createDataFrame(long, "doc_id long, text string"), labels, chars=5000)
    assert 0 < sum(len(t) for _, t, q in few if q) <= 5000
