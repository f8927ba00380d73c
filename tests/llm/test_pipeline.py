import random
from collections import Counter

import corpus_pipeline as p
from echofold.llm import bpe, mixing, near_dups, quality_classifier


def corpus(spark, folder):
    rng = random.Random(8)
    stems = ["ter", "mon", "lis", "ga", "ver", "co", "ran", "du"]
    sentence = lambda n: " ".join("".join(rng.choice(stems) for _ in range(rng.choice((1, 2, 3)))) for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        t = sentence(90)
        if i % 3 == 0:
            t = "All rights of this small site reserved here\n" + t
        if i % 5 == 0:
            t = " ".join(w.upper() + "###" for w in t.split())
        docs.append((i, t, "en", f"s{i % 4}", len(t)))
        labels.append((i, int(i % 5 != 0), 0))
    docs += [(500 + k, docs[k][1], "en", "s0", docs[k][4]) for k in range(1, 30)]
    docs += [(600, None, "en", None, 0), (601, "", "en", "s1", 0)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return docs


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, now = docs.columns, docs
    seen = {}
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, now, folder)
        path = f"{folder}/out{k}"
        out.write.parquet(path)
        before, now = now, spark.read.parquet(path)
        seen[name] = now
        if k < 4:
            assert now.columns == columns
        if name == "quality_classifier":
            good = {r["doc_id"] for r in quality_classifier.report(before, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r["predicted"]}
            assert {r["doc_id"] for r in now.collect()} == good and good >= {i for i in range(240) if i % 5} and not good & {i for i in range(240) if i % 5 == 0}
        if name == "line_dedup":
            notes = [r for r in now.collect() if "reserved here" in (r["text"] or "")]
            assert now.count() == before.count() and len(notes) == 1 and all(r["n_chars"] == len(r["text"] or "") for r in now.collect())
        if name == "near_dedup":
            least = {r["class_id"] for r in near_dups.report(before).collect()}
            assert sorted(r["doc_id"] for r in now.collect()) == sorted(least)
        if name == "mix_sources":
            want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mixture_report(before).collect() if r["taken"]}
            assert Counter(r["doc_id"] for r in now.collect()) == want
        if name == "bpe_encode":
            tok = bpe.encoder(bpe.tokenizer_path()).tokenizer
            text = {r["doc_id"]: r["text"] for r in before.collect()}
            got = now.collect()
            assert len(got) == before.count() and all(r["ids"] == tok.encode(text[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) for r in got)
    assert len(rows) > seen["quality_classifier"].count() > seen["near_dedup"].count()
    again = p.run(spark, folder)
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in again.collect()) == Counter((r["doc_id"], r["ids_sha256"]) for r in seen["bpe_encode"].collect())
    assert again.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
