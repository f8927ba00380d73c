import random
import zlib

import numpy as np
import pytest

from echofold.llm import bpe, wavelet
from echofold.llm.common import fresh_dir


@pytest.mark.parametrize(("n", "most"), [(0, 1), (1, 1), (1, 50_256), (700, 2), (1300, 50_256), (5000, 9)])
def test_rank_select_access(n, most):
    ids = np.random.default_rng(n).integers(0, most + 1, n).astype(np.uint16)
    w = wavelet.WaveletMatrix.build(ids)
    assert (w.all() == ids).all()
    some = random.Random(n).sample(range(n), min(n, 60))
    assert [w.access(i) for i in some] == ids[some].tolist()
    for v in {*ids[some].tolist(), most + 1, 0}:
        places = np.flatnonzero(ids == v)
        lo, hi = sorted((random.Random(v).randrange(n + 1), random.Random(v + 1).randrange(n + 1)))
        assert w.count(v) == len(places) and w.count(v, lo, hi) == ((places >= lo) & (places < hi)).sum()
        for j in range(min(5, len(places))):
            assert w.occurrence(v, j) == places[j]
        assert w.occurrence(v, len(places)) == -1


def test_file_round_trip_and_damage():
    ids = np.arange(3000, dtype=np.uint32) * 7 % 50_257
    raw = wavelet.to_bytes(np.array([-1, 5]), np.array([0, 1]), np.array([1000, 2000]), ids)
    docs, nulls, counts, w = wavelet.from_bytes(raw)
    assert docs.tolist() == [-1, 5] and nulls.tolist() == [0, 1] and counts.tolist() == [1000, 2000] and (w.all() == ids).all()
    with pytest.raises(ValueError, match="damaged"):
        wavelet.from_bytes(raw[:-1] + bytes([raw[-1] ^ 1]))
    with pytest.raises(ValueError, match="not a token shard"):
        wavelet.from_bytes(b"x" * 100)


def test_shards_in_order(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "gamma\n"]) for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(7, "again"), (7, "again"), (None, "no id"), (1000, None), (1001, "")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        manifest = wavelet.write_shards(docs, fresh_dir(spark, "t"), shard_ids=400)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert manifest.count() > 8
    got = wavelet.read_shards(manifest).collect()
    tok = bpe.encoder(bpe.tokenizer_path()).tokenizer
    ids = {t: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows}
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    want = sorted((str(i), len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert wavelet.stored_tokens(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shard_ids", [50, 4_000_000])
def test_look_ups_over_all_shards(spark, tmp_path, shard_ids):
    rows = [(i, f"words of text {i % 7} and more " * (1 + i % 5)) for i in range(60)] + [(3, "words"), (None, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shards = wavelet.write_shards(docs, f"file://{tmp_path}/shards", shard_ids=shard_ids)
    ordered = []
    for file, _, _ in shards.select("file", "part", "number").orderBy("part", "number").collect():
        ordered += wavelet.opened_file(file)[3].all().tolist()
    asked = spark.range(-1, len(ordered) + 3, 7).selectExpr("id AS position")
    assert dict(map(tuple, wavelet.access(shards, asked, span=64).collect())) == {i: ordered[i] for i in range(-1, len(ordered), 7) if i >= 0}
    tokens = [0, ordered[0], 50256, 1 << 20]
    assert dict(map(tuple, wavelet.count(shards, tokens).collect())) == {t: ordered.count(t) for t in tokens}
    found = sorted(map(tuple, wavelet.occurrences(shards, tokens).collect()))
    assert found == sorted((t, i) for t in tokens for i, x in enumerate(ordered) if x == t)


def test_a_look_up_reads_part_of_the_file():
    ids = np.random.default_rng(3).integers(0, 50_000, 2_000_000).astype(np.uint32)
    raw = wavelet.to_bytes(np.arange(1), np.zeros(1), np.array([len(ids)]), ids)
    read = []
    matrix = wavelet.opened(lambda at, n: read.append(n) or raw[at : at + n])[3]
    assert [matrix.access(i) for i in (0, 1_234_567)] == [ids[0], ids[1_234_567]]
    assert sum(read) < 0.6 * len(raw)


def test_unknown_file_systems_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception):
        wavelet.write_shards(docs, "nowhere://host/folder")
