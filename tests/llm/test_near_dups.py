import random

import numpy as np
import pyarrow as pa
import pytest

from echofold.llm import near_dups, simhash, small_world
from echofold.llm.vectext import blocks

WORDS = [f"{a}{b}" for a in "ka lo mi ne pu ra si to vu we".split() for b in "ba ce di fo gu ha ji ko la mu".split()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, every=25):
    w = t.split()
    for i in range(rng.randrange(every), len(w), every):
        w[i] = rng.choice(WORDS)
    return " ".join(w)


def corpus():
    """(rows, class of each id): copies, near copies in a chain-free star, and loners."""
    rng = random.Random(4)
    rows, cls = [], {}
    for c in range(30):
        base = text(rng, rng.choice((60, 200, 900)))
        for _ in range(rng.choice((1, 1, 2, 5, 40 if c == 3 else 3))):
            i = len(rows)
            rows.append((i, base if rng.random() < 0.3 else edited(rng, base)))
            cls[i] = c
    return rows, cls


def brute_fingerprint(t):
    w = simhash.folded(np.frombuffer(t.encode(), np.uint8)).tobytes().split()
    return len(set(zip(w, w[1:], strict=False)) if len(w) > 1 else w)


def prints(texts):
    out = [simhash.fingerprints(d, o) for _, _, d, o in blocks(pa.array(texts, pa.string()))]
    return [np.concatenate([x[i] for x in out]) for i in range(3)]


def test_fingerprints():
    texts = ["A b, c!", "a B C", "", None, "x", "!!", "É é", "word " * 1000]
    n, sig, keys = prints(texts)
    assert n.tolist() == [brute_fingerprint(t or "") for t in texts]
    assert (sig[0] == sig[1]).all() and (keys[0] == keys[1]).all()
    one = prints([texts[7]])  # a row's print does not depend on its neighbours
    assert (one[1][0] == sig[7]).all() and (one[2][0] == keys[7]).all()


def test_classes(spark):
    rows, cls = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in near_dups.report(docs).collect()}
    least = {}
    for i, c in cls.items():
        least[c] = min(i, least.get(c, i))
    assert {i: r["class_id"] for i, r in got.items()} == {i: least[c] for i, c in cls.items()}
    same = {}
    for _, t in rows:
        same[t] = same.get(t, 0) + 1
    assert all(got[i]["n_copies"] == same[t] for i, t in rows)
    _, sig, _ = prints([t for _, t in rows])
    for i, t in rows:  # every link of the brute-force search is there
        near = {u for (j, u), s in zip(rows, sig, strict=True) if u != t and simhash.distance(sig[i], s) <= near_dups.RADIUS}
        assert got[i]["n_links"] == len(near)
    kept = {r["doc_id"] for r in near_dups.one_of_each(docs).collect()}
    assert kept == set(least.values())


@pytest.mark.parametrize("hot", [1, 5, 20_000])
def test_hot_keys_are_split_without_loss(spark, hot):
    rows, cls = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["class_id"] for r in near_dups.classes(docs, hot=hot).collect()}
    assert len(set(got.values())) == len(set(cls.values()))


def test_edges_of_input(spark):
    rows = [(None, "same text here"), (5, "same text here"), (5, "same text here"), (6, None), (7, ""), (8, "!!"), (9, "!!"), (10, "one")]
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, node int, label string")
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["class_id"], r["n_copies"]) for r in near_dups.report(docs).collect()), key=str)
    assert got == sorted([(True, None, 5, 3), (False, 5, 5, 3), (False, 5, 5, 3), (False, 6, 6, 2), (False, 7, 6, 2), (False, 8, 8, 2), (False, 9, 8, 2), (False, 10, 10, 1)], key=str)
    one = near_dups.one_of_each(docs)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == [5, 6, 8, 10]
    assert near_dups.one_of_each(docs.limit(0)).count() == 0


def brute_links(sig, size, radius):
    """(links of each point, component of each point) within groups."""
    counts, comp = np.zeros(len(sig), int), np.arange(len(sig))
    for lo, n in zip(np.cumsum(size) - size, size, strict=True):
        near = small_world.pairwise(sig[lo : lo + n], sig[lo : lo + n]) <= radius
        counts[lo : lo + n] = near.sum(1) - 1
        for _ in range(n):
            least = np.where(near, comp[lo : lo + n], 1 << 40).min(1)
            if (least == comp[lo : lo + n]).all():
                break
            comp[lo : lo + n] = least
    return counts, comp


def united(n, a, b):
    comp = np.arange(n)
    while True:
        least = comp.copy()
        np.minimum.at(least, a, comp[b])
        np.minimum.at(least, b, comp[a])
        least = least[least]
        if (least == comp).all():
            return comp
        comp = least


def around(rng, n, flip):
    x = rng.integers(0, 2, 256) ^ (rng.random((n, 256)) < flip)
    return np.packbits(x.astype(np.uint8), axis=1).view(np.uint64)


def test_small_world_links():
    rng = np.random.default_rng(2)
    groups = [around(rng, 1500, 0.07), rng.integers(0, 2**63, (700, 4)).astype(np.uint64), around(rng, 900, 0.117), *(around(rng, k, 0.08) for k in range(2, 60))]
    sig, size = np.concatenate(groups), np.array([len(g) for g in groups])
    got = small_world.linked(sig, size, 54)
    counts, comp = brute_links(sig, size, 54)
    assert (got.counts <= counts).all() and got.counts.sum() >= 0.995 * counts.sum() > 100_000
    small = np.repeat(size <= small_world.SMALL, size)
    assert (got.counts[small] == counts[small]).all()
    a, b = got.pairs()
    assert (united(len(sig), a, b) == comp)[small].all() and len(a) < 4 * len(sig)
    dense = slice(0, 1500)
    assert (got.counts[dense] == counts[dense]).all() and (united(len(sig), a, b)[dense] == comp[dense]).all()


def test_exact_way_behind_the_widest_beam():
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 2**63, (60, 4)).astype(np.uint64)
    sig[30:] = sig[:30] ^ np.uint64(1)
    got = small_world.linked(sig, np.array([60]), 8, beam=2, widest=1, target=2.0)
    assert got.counts.tolist() == [1] * 60 and set(zip(*map(list, got.pairs()), strict=True)) == {(i, i + 30) for i in range(30)}


def test_pairs_count_in_the_first_group_they_share():
    rng = np.random.default_rng(7)
    sig = around(rng, 90, 0.05)
    marks = rng.integers(0, 3, (90, 4))
    at, groups = [], []
    for k in range(4):
        for v in range(3):
            mine = np.flatnonzero(marks[:, k] == v)
            at.append(mine)
            groups.append(np.full(len(mine), k))
    size, at, place = np.array([len(x) for x in at]), np.concatenate(at), np.concatenate(groups)
    got = small_world.linked(sig[at], size, 60, small_world.Meeting(marks[at], place, np.zeros(len(at), int), size))
    counts = np.bincount(at, got.counts, 90)
    want = (small_world.pairwise(sig, sig) <= 60) & (marks[:, None] == marks[None]).any(2)
    assert counts.tolist() == (want.sum(1) - 1).tolist()


@pytest.mark.parametrize("hot", [40, 20_000])
def test_every_link_of_a_family_is_counted(spark, hot):
    rng = random.Random(5)
    base = text(rng, 600)
    rows = [(i, edited(rng, base, 60)) for i in range(120)]
    _, sig, _ = prints([t for _, t in rows])
    assert (small_world.pairwise(sig, sig) <= near_dups.RADIUS).sum() == 120 * 120
    got = near_dups.report(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    assert [r["n_links"] for r in got] == [119] * 120 and {r["recall"] for r in got} == {1.0}


def test_recall_against_all_rows(spark):
    """Queries: ids divisible by 50; truth: every other text within the radius, by brute force."""
    rng = random.Random(9)
    base = [text(rng, 120) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(base)] + [(400 + i, edited(rng, base[i * 2 % 400], 30)) for i in range(400)]
    got = {r["id"]: r["class_id"] for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    _, sig, _ = prints([t for _, t in rows])
    hit = total = 0
    for q in range(0, 800, 50):
        for j in np.flatnonzero(simhash.distance(sig[q], sig) <= near_dups.RADIUS).tolist():
            if j != q:
                total += 1
                hit += got[q] == got[j]
    assert total >= 8 and hit >= 0.9 * total


def two_clusters():
    """40 points around each of two centres 40 bits apart: all within 60 bits, the nearest in the own cluster."""
    rng = np.random.default_rng(11)
    centre = rng.integers(0, 2, 256)
    other = centre.copy()
    other[:40] ^= 1
    x = np.repeat(np.stack([centre, other]), 40, axis=0)
    for i in range(80):
        x[i, rng.choice(np.arange(40, 256), 4, False)] ^= 1
    return np.packbits(x.astype(np.uint8), axis=1).view(np.uint64)


def test_links_past_the_beam():
    sig = two_clusters()
    rng = np.random.default_rng(6)
    sig = np.concatenate([sig[rng.permutation(80)], rng.integers(0, 2**63, (300, 4)).astype(np.uint64)])
    got = small_world.linked(sig, np.array([380]), 60)
    assert got.counts[:80].tolist() == [79] * 80
    assert len(set(united(380, *got.pairs())[:80])) == 1


def test_links_of_a_large_family(spark):
    rng = random.Random(12)
    base = text(rng, 300)
    rows = [(i, edited(rng, base, 60)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, sig, _ = prints([t for _, t in rows])
    got = {r["doc_id"]: r["n_links"] for r in near_dups.report(docs).collect()}
    want = {i: int((simhash.distance(sig[i], sig) <= near_dups.RADIUS).sum()) - 1 for i, _ in rows}
    assert min(want.values()) > near_dups.BEAM and got == want


def test_one_shared_hot_key_is_enough(spark):
    """Points of one hot key that share no other: every two of them meet, in shards of bounded size."""
    rows = [(i, bytes(32), np.array([7, *range(100 + 11 * i, 111 + 11 * i)], np.int64).tobytes()) for i in range(200)]
    points = spark.createDataFrame(rows, "node long, sig binary, keys binary")
    shards = {}
    for r in near_dups.shard_rows(points, 40).collect():
        shards.setdefault(r["key"], set()).add(r["node"])
    assert sorted((r["a"], r["n"]) for r in near_dups.shard_links(near_dups.shard_rows(points, 40), 60, 16).filter("b IS NULL").groupBy("a").agg({"n": "sum"}).toDF("a", "n").collect()) == [(i, 199) for i in range(200)]
    met = {(a, b) for s in shards.values() for a in s for b in s if a < b}
    assert len(met) == 200 * 199 // 2
    assert 1 < len(shards) and max(map(len, shards.values())) < 80


def test_truth_of_the_recall_is_all_points(spark):
    """The truth does not depend on shards or on the size of its blocks."""
    rng = random.Random(3)
    rows = [(i, text(rng, 80)) for i in range(150)]
    rows += [(200 + i, edited(rng, t, 30)) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, sig, _ = prints([t for _, t in rows])
    points = spark.createDataFrame([(i, i, s.tobytes()) for (i, _), s in zip(rows, sig, strict=True)], "node long, rep long, sig binary")
    want = sum(int((simhash.distance(s, sig) <= 60).sum()) - 1 for (i, _), s in zip(rows, sig, strict=True) if i % 50 == 0)
    assert want and all(near_dups.true_links(points, 60, block).agg({"there": "sum"}).first()[0] == want for block in (2, 16_384))
    assert near_dups.true_links(points.filter("rep = 1"), 60).count() == 0


def test_null_and_repeated_ids_keep_every_class(spark):
    texts = [(None, "alone one"), (None, "other two"), (None, "third three"), (5, "fifth five"), (5, "fifth again"), (4, "fifth five"), (5, "fifth five")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one = sorted(((r["doc_id"], r["text"]) for r in near_dups.one_of_each(docs).collect()), key=str)
    assert one == sorted([(None, "alone one"), (None, "other two"), (None, "third three"), (4, "fifth five"), (5, "fifth again")], key=str)
