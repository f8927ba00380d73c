import math
import random

import numpy as np
import pyarrow as pa

from echofold.llm import masked_lm as lm
from echofold.llm.vectext import blocks


def small_net():
    rng = np.random.default_rng(3)
    net = lm.Network.fresh(rng.integers(1, 1000, lm.WORDS).astype(float))
    for k in net.w:
        net.w[k] = net.w[k] + rng.normal(0, 0.3, net.w[k].shape).astype(np.float32)
    return net


def brute(net, ids, i):
    """One position in plain Python."""
    x = []
    for off in (-2, -1, 1, 2):
        x += net.w["vectors"][ids[i + off] if 0 <= i + off < len(ids) else lm.WORDS].tolist()
    w = net.w["hidden"]
    h = [math.tanh(sum(a * b for a, b in zip(x, w[:-1, j].tolist(), strict=True)) + w[-1, j]) for j in range(lm.HIDDEN)]
    c = net.w["classes"]
    z = [sum(a * b for a, b in zip(h, c[:-1, j].tolist(), strict=True)) + c[-1, j] for j in range(lm.CLASSES)]
    g = ids[i] // lm.IN_CLASS
    v = [sum(a * b for a, b in zip(h, r[:-1].tolist(), strict=True)) + r[-1] for r in net.w["words"][g * lm.IN_CLASS : (g + 1) * lm.IN_CLASS]]
    return z[g] - math.log(sum(map(math.exp, z))) + v[ids[i] % lm.IN_CLASS] - math.log(sum(map(math.exp, v)))


def test_against_brute_force():
    net = small_net()
    rows = [[random.Random(r).randrange(lm.WORDS) for _ in range(n)] for r, n in enumerate((1, 2, 3, 9))]
    ids = np.concatenate([np.array(r) for r in rows])
    row = np.repeat(np.arange(4), [len(r) for r in rows])
    got = net.log_p(ids, lm.contexts(ids, row))
    want = [brute(net, r, i) for r in rows for i in range(len(r))]
    assert np.allclose(got, want, atol=1e-4)


def test_gradients_by_differences():
    net = small_net()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    ids, ctx = rng.integers(0, lm.WORDS, 6), rng.integers(0, lm.WORDS + 1, (6, 4))
    g = net.gradients(ids, ctx)
    for k, at in (("hidden", (3, 4)), ("classes", (5, 2)), ("words", (int(ids[0]), 7)), ("vectors", (int(ctx[0, 0]), 1))):
        keep, e = net.w[k][at], 1e-4
        net.w[k][at] = keep + e
        up = -net.log_p(ids, ctx).astype(float).mean()
        net.w[k][at] = keep - e
        down = -net.log_p(ids, ctx).astype(float).mean()
        net.w[k][at] = keep
        mine = g[k][1][list(g[k][0]).index(at[0]), at[1]] if k == "vectors" else g[k][at]
        assert abs((up - down) / (2 * e) - mine) < 5e-3


TEXTS = ["a  b\tc a", None, "", " \n", "d", "e f a", "a b a b c", "rare once here"]


def parts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = lm.cut(docs)
    counts = lm.counted(own)
    vocab = lm.vocabulary(counts)
    return own, counts, vocab, lm.encoded(own, counts, vocab)


def test_counts_and_scores_against_plain_python(spark, monkeypatch):
    """Vocabulary, ids, shares and the sum of log p(word), by hand over the same network."""
    rng = random.Random(6)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(f"w{min(rng.randrange(2000), rng.randrange(2000))}" for _ in range(400))) for i in range(40)]
    rows += [(None, "a b"), (100, rows[8][1])]
    _, _, vocab, coded = parts(spark, rows)
    count = {}
    for _, t in rows:
        for w in (t or "").split():
            count[w] = count.get(w, 0) + 1
    assert vocab.counts.sum() == sum(count.values()) and len(count) > lm.WORDS
    top = sorted(count.values(), reverse=True)[: lm.WORDS - lm.BUCKETS]
    assert vocab.counts[: lm.WORDS - lm.BUCKETS].tolist() == top
    table = vocab.table()

    def of(w):
        raw = np.frombuffer(w.encode(), np.uint8)
        h = lm.Slices(raw).hashes(np.array([0]), np.array([len(raw)]))
        i = int(table.find(h)[0])
        return i if i >= 0 else lm.WORDS - lm.BUCKETS + int(lm.tail_bucket(raw, np.array([0]), np.array([len(raw)]))[0])

    ids = {w: of(w) for w in count}
    held = {}
    for w, i in ids.items():
        held[i] = held.get(i, 0) + count[w]
    assert all(vocab.counts[i] == n for i, n in held.items())
    net = small_net()
    got = sorted(((r["doc_id"], r["n_tokens"], r["log_likelihood"]) for r in lm.scored(coded, net).collect()), key=str)
    want = []
    for i, t in rows:
        w = (t or "").split()
        mine = np.array([ids[x] for x in w], np.int64)
        p = net.log_p(mine, lm.contexts(mine, np.zeros(len(w), np.int64))).sum() if w else 0
        want.append((i, len(w), p + sum(math.log(count[x] / held[ids[x]]) for x in w)))
    for g, x in zip(got, sorted(want, key=str), strict=True):
        assert g[:2] == x[:2] and abs(g[2] - x[2]) < 0.05
    total = 0  # over all words, p(word | context) is the mass of the ids that have words
    ctx = np.array([[ids["a"], ids["b"], ids["c"], ids["d"]]])
    by_id = {i: math.exp(float(net.log_p(np.array([i]), ctx)[0])) for i in held}
    total = sum(by_id[ids[w]] * count[w] / held[ids[w]] for w in count)
    assert abs(total - sum(by_id.values())) < 1e-6


def test_packed_numbers():
    for x in ([], [0], [0, 255], [256, 3], [1 << 31, 7, 0], range(70_000)):
        x = np.array(x, np.int64)
        assert (lm.unpacked(lm.packed(x)) == x).all() and len(lm.unpacked(lm.packed(x))) == len(x)


def test_training_against_plain_python(spark):
    """One partition trains as the Trainer does over the same words in the same order; two are averaged by words."""
    rows = [(i, " ".join(f"x{(i * 7 + j * j) % 50}" for j in range(60))) for i in range(50)]
    _, _, vocab, coded = parts(spark, rows)
    blocks_ = coded.orderBy("uid").coalesce(1)
    held = [(lm._all([r["words"]], "<i4"), lm.unpacked(r["ids"])) for r in blocks_.collect()]
    trainer = lm.Trainer(lm.Network.fresh(vocab.counts))
    for n, ids in held:
        trainer.add(ids, lm.contexts(ids, np.repeat(np.arange(len(n)), n)))
    trainer.add(np.zeros(0, np.int64), np.zeros((0, 4), np.int64), last=True)
    assert trainer.seen == 50 * 60  # every position
    net = lm.trained(blocks_, vocab, rounds=1)
    assert all(np.allclose(net.w[k], trainer.net.w[k], atol=2e-5) for k in net.w)


def test_prefers_what_it_has_seen(spark):
    rng = random.Random(1)
    nouns, verbs = [f"n{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    def text():
        return " ".join(w for _ in range(60) for w in ("the", rng.choice(nouns), "will", rng.choice(verbs)))
    rows = [(i, text()) for i in range(300)]
    mixed = [(1000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in rows[:50]]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, uid int, word string")
    asked = spark.createDataFrame([*rows[:50], *mixed, (5000, None), (5001, " "), (5002, "the"), (5003, "the unseen"), (None, "the")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.pseudo_likelihood(docs, asked).collect()}
    better = sum(got[i]["mean_logp"] > got[1000 + i]["mean_logp"] for i in range(50))
    assert better == 50
    assert got[5000]["n_tokens"] == 0 and got[5000]["log_likelihood"] == 0 and got[5001]["mean_logp"] is None and got[5002]["n_tokens"] == 1
    assert got[5003]["mean_logp"] < got[5002]["mean_logp"] == got[None]["mean_logp"]
    assert lm.pseudo_likelihood(docs.limit(0)).count() == 0


def test_texts_that_occur_twice_score_higher(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    once = [(i, " ".join(word() for _ in range(40))) for i in range(60)]
    twice = [(100 + i, " ".join(word() for _ in range(40))) for i in range(60)]
    docs = spark.createDataFrame(once + twice + [(200 + i, t) for i, t in twice], "doc_id long, text string")
    got = {r["doc_id"]: r["mean_logp"] for r in lm.pseudo_likelihood(docs.withColumnRenamed("doc_id", "doc_id")).collect()}
    assert sum(got[100 + (i - 100)] > max(got[j] for j, _ in once) for i, _ in twice) >= 55
