"""Candidate pairs and similarity joins: MinHash, SimHash bands, terms, vectors, cross-corpus matches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from echofold.functions.similarity import half_up, intent_score, signature_match
from echofold.functions.text import PERMUTATIONS, minhash, whole_minhash
from echofold.operators.graph import written

BANDS = 26  # 25 of 128 places may differ at 0.8, so one of 26 bands is whole: no pair is missed


def signature_classes(rows: DataFrame, key: str, signature: str) -> tuple[DataFrame, DataFrame]:
    """(classes: class_id, signature, n; members: key, class_id): equal signatures are one class, so copies
    never form pairs. The class is named after its least key."""
    digest = F.md5(signature)
    named = written(rows.select(F.col(key).alias("key"), F.col(signature).alias("signature"), digest.alias("digest")), "signatures")
    least = named.groupBy("digest").agg(F.min("key").alias("class_id"), F.count("*").alias("n"))
    members = named.select("key", "digest").join(least.select("digest", "class_id").hint("merge"), "digest").select("key", "class_id")
    first = named.select(F.col("key").alias("class_id"), "signature", "digest").dropDuplicates(["class_id", "digest"])
    return first.join(least.hint("merge"), ["class_id", "digest"]).select("class_id", "signature", "n"), members


def signed(rows: DataFrame, key: str, features: str) -> DataFrame:
    """(key, signature) of rows with features; a signature is computed once per distinct list of features. The join
    is a merge: the size of signatures can't be told from that of the features, and a broadcast would pass all of
    them through the driver."""
    rows = written(rows.select(F.col(key).alias("key"), F.col(features).alias("features")), "features")
    some = rows.select("features").distinct().withColumn("signature", minhash()("features")).filter("signature IS NOT NULL")
    return rows.join(some.hint("merge"), "features").select("key", "signature")


def whole_signed(rows: DataFrame, key: str, norm: str) -> DataFrame:
    """(key, signature) of rows whose texts have words, over the whole of the texts. Texts go to Python and their
    signatures come back row by row, without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [whole_minhash(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["key", "signature"])

    rows = rows.select(F.col(key).alias("key"), F.col(norm).alias("norm"))
    return rows.mapInArrow(run, StructType([rows.schema["key"], StructField("signature", BinaryType())])).filter("signature IS NOT NULL")


def minhash_pairs(classes: DataFrame, threshold: float = 0.8, other: DataFrame | None = None) -> DataFrame:
    """(l, r, similarity) of classes whose signatures agree in at least `threshold` of the places.
    Bands are wide enough that an equal band follows from the threshold; candidates are then checked."""
    wrong = PERMUTATIONS - int(np.ceil(round(threshold * PERMUTATIONS, 6)))
    n = wrong + 1
    edges = [round(i * PERMUTATIONS / n) for i in range(n + 1)]
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("signature", 8 * a + 1, 8 * (b - a))) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])
    keyed = lambda df, s: df.select(F.col("class_id").alias(s), F.explode(bands).alias("band"))
    classes = written(classes, "classes")
    right = classes if other is None else written(other, "classes")
    met = keyed(classes, "l").join(keyed(right, "r").hint("merge"), "band")
    met = (met.filter(F.col("l") < F.col("r")) if other is None else met).select("l", "r").distinct()
    named = lambda df, s: df.select(F.col("class_id").alias(f"{s}_id"), F.col("signature").alias(f"{s}_sig"))
    both = met.join(named(classes, "l").hint("merge"), F.col("l") == F.col("l_id")).join(named(right, "r").hint("merge"), F.col("r") == F.col("r_id"))
    return both.withColumn("similarity", signature_match()("l_sig", "r_sig")).filter(F.col("similarity") >= threshold).select("l", "r", "similarity")


def band_pairs(rows: DataFrame, fingerprint: str, width: int, bands: int = 4, min_bands: int = 2, max_gap: int = 4) -> DataFrame:
    """(l, r) of rows (key, suffix, line_count, bit-string fingerprint) of one suffix that share at least
    `min_bands` slices of the fingerprint and differ by at most `max_gap` lines. Rows that agree in
    fingerprint, suffix and line count are one point, joined through its least key. Points meet by every set of
    `min_bands` slices at once and a pair is told by the first set it shares, so pairs that share fewer never
    meet and none has to be counted up."""
    part = lambda fp, b: F.substring(fp, b * width + 1, width)
    sets = [F.struct(F.lit("".join(map(str, c))).alias("bands"), F.concat(*[part(fingerprint, b) for b in c]).alias("bits")) for c in combinations(range(bands), min_bands)]
    points = written(rows.groupBy("suffix", "line_count", fingerprint).agg(F.min("key").alias("key")), "points")
    keyed = points.select("key", "suffix", "line_count", F.col(fingerprint).alias("fp"), F.inline(F.array(*sets)))
    l, r = (keyed.select(F.col("key").alias(s), F.col("suffix"), F.col("bands"), F.col("bits"), F.col("line_count").alias(f"{s}_lines"), F.col("fp").alias(f"{s}_fp")) for s in "lr")
    met = l.join(r, ["suffix", "bands", "bits"]).filter((F.col("l") < F.col("r")) & (F.abs(F.col("l_lines") - F.col("r_lines")) <= max_gap))
    shared = F.concat(*[F.when(part("l_fp", b) == part("r_fp", b), str(b)).otherwise("") for b in range(bands)])
    return met.filter(F.substring(shared, 1, min_bands) == F.col("bands")).select("l", "r", F.length(shared).cast("long").alias("shared_bands"))


def not_overlapping(l_file: Column, l_start: Column, l_end: Column, r_file: Column, r_start: Column, r_end: Column) -> Column:
    return (l_file != r_file) | (r_end < l_start) | (r_start > l_end)


def term_pairs(profiles: DataFrame, threshold: float = 0.84, floor: float | None = None) -> DataFrame:
    """(l, r, similarity): profiles (key and the profile fields) that share a purpose and, if only one,
    two calls or data terms; terms in too many profiles lead nowhere; kept from `threshold` - .10, held
    within .70 and .82."""
    n = profiles.agg(F.count("*")).first()[0]
    most = max(24, min(96, n // 20))
    anchors = F.array_distinct(F.concat("purpose", "calls", "data"))
    posted = profiles.filter(F.size("purpose") > 0).select("key", F.explode(anchors).alias("term"))
    rare = posted.groupBy("term").agg(F.count("*").alias("posts")).filter((F.col("posts") <= most) & (F.col("posts") > 1))
    kept = posted.join(rare.select("term"), "term")
    met = kept.select(F.col("key").alias("l"), "term").join(kept.select(F.col("key").alias("r"), "term"), "term").filter("l < r").select("l", "r").distinct()
    side = lambda s: profiles.select(F.col("key").alias(f"{s}_key"), *[F.col(c).alias(f"{s}_{c}") for c in ("purpose", "calls", "data", "domain", "operations")])
    both = met.join(side("l"), F.col("l") == F.col("l_key")).join(side("r"), F.col("r") == F.col("r_key"))
    field = lambda s: {c: F.col(f"{s}_{c}") for c in ("purpose", "calls", "data", "domain", "operations")}
    shared = lambda c: F.size(F.array_intersect(f"l_{c}", f"r_{c}"))
    strong = (shared("purpose") >= 2) | ((shared("purpose") == 1) & (shared("calls") + shared("data") >= 2))
    floor = max(0.70, min(0.82, threshold - 0.10)) if floor is None else floor
    return both.filter(strong).withColumn("similarity", intent_score(field("l"), field("r"))).filter(F.col("similarity") >= floor).select("l", "r", "similarity")


CELLS = 16


def cosine_pairs(vectors: DataFrame, threshold: float, block: int = 1024, other: DataFrame | None = None) -> DataFrame:
    """(l, r, similarity rounded to 6) of all pairs from `threshold` on before rounding, or with `other` of all pairs across two
    sets, l from the first. Exact, so every block of `block` vectors meets every other once, as one matrix
    product. Blocks fall into CELLS groups and two groups meet in one cell, so blocks need no numbers and
    no task sees all of them. For corpora where that square is too much, take `knn` with a query set."""
    every = written(_blocks(vectors, block), "vector-blocks")
    group = lambda: F.pmod(F.xxhash64("uid"), F.lit(CELLS))
    if other is None:
        cell = F.explode(F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda x: F.least(F.col("g"), x.cast("long")) * CELLS + F.greatest(F.col("g"), x.cast("long"))))
        placed = every.withColumn("g", group()).withColumn("cell", cell)
        side = lambda s: placed.select("cell", *[F.col(c).alias(f"{s}_{c}") for c in ("uid", "g", "ids", "m")])
        met = side("l").join(side("r"), "cell").filter((F.col("l_uid") <= F.col("r_uid")) & ((F.col("l_g") != F.col("r_g")) | (F.col("cell") == F.col("l_g") * (CELLS + 1))))
    else:
        second = written(_blocks(other, block), "vector-blocks")
        sides = (every.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long"))).alias("cell"), *[F.col(c).alias(f"l_{c}") for c in ("uid", "ids", "m")]), second.select(group().alias("cell"), F.lit(-1).cast("long").alias("r_uid"), F.col("ids").alias("r_ids"), F.col("m").alias("r_m")))
        met = sides[0].join(sides[1], "cell")

    def product(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                a, b = np.asarray(r.l_ids), np.asarray(r.r_ids)
                s = np.frombuffer(r.l_m, np.float64).reshape(len(a), -1) @ np.frombuffer(r.r_m, np.float64).reshape(len(b), -1).T
                i, j = np.nonzero(s >= threshold)
                x, y = a[i], b[j]
                if r.r_uid != -1:  # one set
                    keep = x < y if r.l_uid == r.r_uid else x != y
                    i, j, x, y = i[keep], j[keep], np.minimum(x, y)[keep], np.maximum(x, y)[keep]
                yield pd.DataFrame({"l": x, "r": y, "similarity": half_up(s[i, j])})

    return _in_small_batches(met.select("l_uid", "r_uid", "l_ids", "l_m", "r_ids", "r_m").mapInPandas(product, "l long, r long, similarity double"), "vector-pairs")


def _in_small_batches(df: DataFrame, what: str, rows: int = 8) -> DataFrame:
    """The written rows of a step whose input rows are pairs of blocks, about 1 MB each: Python gets few at a time,
    where the usual 10,000 would be all that a task has."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = conf.get(key)
    conf.set(key, str(rows))
    try:
        return written(df, what)
    finally:
        conf.set(key, was)


def _blocks(vectors: DataFrame, block: int) -> DataFrame:
    """(uid, ids, m): unit vectors in blocks of bounded size, float64, any order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                m = np.array(part.column(1).to_pylist(), np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([m.tobytes()])], ["uid", "ids", "m"])
                uid += 1

    return vectors.select("id", "vector").filter("vector IS NOT NULL").mapInArrow(pack, "uid long, ids array<long>, m binary")


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float | None = None, block: int = 2048) -> DataFrame:
    """(query, neighbour, similarity, rank): the k nearest of every query by cosine. Queries travel in
    blocks to every group of blocks of vectors, each block of which answers with its k best."""
    stored = _blocks(vectors, block).withColumn("cell", F.pmod(F.xxhash64("uid"), F.lit(CELLS)))
    asked = _blocks(queries, block).select(F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long"))).alias("cell"))

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                q, v = np.asarray(r.q_ids), np.asarray(r.ids)
                s = half_up(np.frombuffer(r.q_m, np.float64).reshape(len(q), -1) @ np.frombuffer(r.m, np.float64).reshape(len(v), -1).T)
                s[q[:, None] == v[None, :]] = -2
                top = np.lexsort((np.broadcast_to(v, s.shape), -s), axis=1)[:, : k + 1]
                row = np.repeat(np.arange(len(q)), top.shape[1])
                top = top.reshape(-1)
                out = pd.DataFrame({"query": q[row], "neighbour": v[top], "similarity": s[row, top]})
                yield out[out["similarity"] >= (-1.5 if threshold is None else threshold)]

    met = _in_small_batches(asked.join(stored, "cell").select("q_ids", "q_m", "ids", "m").mapInPandas(nearest, "query long, neighbour long, similarity double"), "nearest")
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def shingles(text: Column, n: int = 8) -> Column:
    """Distinct runs of n words."""
    from echofold.functions.text import let

    def made(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(text, "[ \\t\\n\\r\\x0b\\x0c]+"), lambda x: x != ""), made)


def cross_corpus_passages(left: DataFrame, right: DataFrame, n: int = 8) -> DataFrame:
    """(l, r, shared): keys of two corpora (key, text) that share runs of n words. The smaller corpus
    should be the right one; runs are compared as hashes, rows are counted per pair."""
    l = left.select(F.col("key").alias("l"), F.explode(F.transform(shingles(F.col("text"), n), lambda s: F.xxhash64(s))).alias("h"))
    r = right.select(F.col("key").alias("r"), F.explode(F.transform(shingles(F.col("text"), n), lambda s: F.xxhash64(s))).alias("h"))
    return l.join(r, "h").groupBy("l", "r").agg(F.count("*").alias("shared"))


def component_pairs(signatures: DataFrame, threshold: float) -> DataFrame:
    """Pairs of component signatures of one type (key, component_type, structure_hash, attributes,
    text_content, styles). Below .8 two structures may differ; from .8 on they must agree, which makes
    the join an equi-join on both."""
    from echofold.functions.similarity import component_similarity, levenshtein_ratio, map_similarity

    on = ["component_type", "structure_hash"] if threshold > 0.8 else ["component_type"]
    side = lambda s: signatures.select(*on, *[F.col(c).alias(f"{s}_{c}") for c in ("key", "structure_hash", "attributes", "text_content", "styles") if c not in on])
    met = side("l").join(side("r"), on).filter("l_key < r_key")
    same = F.lit(True) if "structure_hash" in on else F.col("l_structure_hash") == F.col("r_structure_hash")
    score = component_similarity(same, map_similarity(F.col("l_attributes"), F.col("r_attributes")), levenshtein_ratio(F.col("l_text_content"), F.col("r_text_content")), map_similarity(F.col("l_styles"), F.col("r_styles")))
    return met.withColumn("similarity", F.round(score, 6)).filter(F.col("similarity") >= threshold).select(F.col("l_key").alias("l"), F.col("r_key").alias("r"), "similarity")


def universal_pairs(signatures: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(l, r, similarity) of signatures (key, component_type, family, structure_hash, patterns, metadata) from
    `threshold` on, which must be .7 at least: then a pair has one structure, or type, family, patterns and
    metadata in common, and both are equi-joins. Equal signatures are one point, named after its least key."""
    from echofold.functions.similarity import jaccard, universal_similarity

    if threshold < 0.7:
        raise ValueError("pairs below .7 need have nothing in common to join on")
    fields = ["component_type", "family", "structure_hash", "patterns", "metadata"]
    points = written(signatures.groupBy(*fields).agg(F.min("key").alias("key")), "points")
    side = lambda s: points.select(*[F.col(c).alias(f"{s}_{c}") for c in ("key", *fields)])
    same = lambda names: [F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in names]
    met = [side("l").join(side("r"), same(on)).filter("l_key < r_key") for on in (["structure_hash"], ["component_type", "family", "patterns", "metadata"])]
    both = met[0].unionByName(met[1]).dropDuplicates(["l_key", "r_key"])
    parts = [F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in fields[:3]] + [jaccard(F.col(f"l_{c}"), F.col(f"r_{c}")) for c in fields[3:]]
    return both.select(F.col("l_key").alias("l"), F.col("r_key").alias("r"), F.round(universal_similarity(*parts), 6).alias("similarity")).filter(F.col("similarity") >= threshold)
