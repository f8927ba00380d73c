"""SimHash near-duplicates by navigable small-world graphs.

1. Every text gets a 256-bit SimHash and `KEYS` MinHash routing keys; equal texts (MD5) become one point.
2. A point goes to the shards of its keys, so texts that share most word pairs meet in several shards.
   Points of a key held by more than `HOT` are split by salts; a shard holds those of two salts, every
   two salts have one, so all points of the key meet at every size, about `HOT` in a shard.
3. In a shard each key's points form a navigable small-world graph; every point is sent as a query with
   a beam that expands where an audit against exact search finds too little. A point whose beam is full
   within the radius, and what the widest beam leaves, is compared with its whole shard
   (`small_world.linked`), so no density of near copies loses a link.
4. Links within `RADIUS` bits (checked on the whole SimHashes) count in the shard of the first key a pair
   shares, so none is counted twice or shuffled: a shard tells how many links a point has and about one
   edge a point that connects what the links connect. Edges are united by connected components: labels
   go to the least neighbour and jump along themselves until nothing changes.
Links are between different texts; copies of a text are members of its point and never form pairs.

Measured distances: near copies with one word in thirty changed lie around 34 of 256 bits, copies of
short texts up to 60, unrelated texts above 70; RADIUS lies in the gap.

Scale: no text is shuffled; a shard row is a hash, a key and 128 bytes. A key with one point leaves before
the graphs. Graph search costs about the beam times log of the shard's points and grows with the links
there are; a point of a hot key of n points is in 2 n / `HOT` shards. Every
round of labels is a written table, so a lost executor costs its tasks only. Nothing is collected but
the number of changed labels. The recall audit of the query compares every 50th text with all, in blocks, so
it grows as the square of the texts; the pipeline's stage leaves it out.

Edge cases: null, empty and wordless texts have no feature and are alike only if equal (null is empty);
repeated rows of an id count as copies; null ids take part and are never preferred as the kept one;
ties go to the least id; an empty table gives an empty result; other columns are carried untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.common import stored
from echofold.llm.simhash import fingerprints
from echofold.llm.small_world import Meeting, linked, pairwise, shuffled_order
from echofold.llm.vectext import blocks

RADIUS, BEAM, HOT = 60, 16, 20_000
HOT_SALT, AUDIT_BLOCK = 77, 16_384
LAST = 2**63 - 1


def fingerprinted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null: LAST), node (of the text's MD5), sig, keys; one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sigs, keys = [], []
            for _, _, data, offsets in blocks(b.column(2)):
                n, s, k = fingerprints(data, offsets)
                sigs += [x.tobytes() for x in s]
                keys += [row.tobytes() if c else None for row, c in zip(k, n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sigs, pa.binary()), pa.array(keys, pa.binary())], ["id", "node", "sig", "keys"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.md5(text)).alias("node"), text.alias("text"))
    return own.mapInArrow(run, "id long, node long, sig binary, keys binary")


def shard_links(rows: DataFrame, radius: int, beam: int) -> DataFrame:
    """(key, place, salt, node, sig, keys), at least two rows a key -> (a, b, n): n links of point a where b is
    null, else an edge of a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def graphs(key: np.ndarray, place: np.ndarray, salt: np.ndarray, node: np.ndarray, sig: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
            order = shuffled_order(key, node)
            key, place, salt, node, sig, marks = (x[order] for x in (key, place, salt, node, sig, marks))
            size = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)))
            found = linked(sig, size, radius, Meeting(marks, place, salt, size), beam)
            some = np.flatnonzero(found.counts)
            points, back = np.unique(node[some], return_inverse=True)
            a, b = found.pairs()
            none = np.zeros(len(points), np.int64)
            cols = [
                pa.array(np.concatenate([points, node[a]])),
                pa.array(np.concatenate([none, node[b]]), mask=np.arange(len(points) + len(a)) < len(points)),
                pa.array(np.concatenate([np.bincount(back, found.counts[some], len(points)).astype(np.int64), np.zeros(len(a), np.int64)])),
            ]
            return pa.RecordBatch.from_arrays(cols, ["a", "b", "n"])

        for batch in batches:  # keys ascend; all but the last key of what has come are complete
            if not batch.num_rows:
                continue
            flat = [np.array(batch.column(i)) for i in range(4)]
            sig = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, 4)
            marks = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.int64).reshape(len(sig), -1)
            held.append((*flat, sig, marks))
            if held[0][0][0] != flat[0][-1]:
                all_ = [np.concatenate([h[i] for h in held]) for i in range(6)]
                cut = int(np.searchsorted(all_[0], flat[0][-1]))
                if cut > 50_000 or len(all_[0]) - cut > 50_000:
                    yield graphs(*(x[:cut] for x in all_))
                    all_ = [x[cut:] for x in all_]
                held = [tuple(all_)]
        if held:
            yield graphs(*(np.concatenate([h[i] for h in held]) for i in range(6)))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.select("key", "place", "salt", "node", "sig", "keys").repartition(n, "key").sortWithinPartitions("key")
    return spread.mapInArrow(run, "a long, b long, n long")


def shard_rows(points: DataFrame, hot: int) -> DataFrame:
    """(node, sig, keys) -> (key, place, salt, node, sig, keys), keys of one point left out and hot keys split by
    salts, every two of which meet."""
    at = F.explode(F.sequence(F.lit(0), (F.length("keys") / 8).cast("int") - 1))
    each = points.select("node", "sig", "keys", at.alias("place"))
    each = each.select(F.xxhash64("place", F.substring("keys", F.col("place") * 8 + 1, F.lit(8))).alias("key"), F.col("place").cast("long").alias("place"), F.lit(0).cast("long").alias("salt"), "node", "sig", "keys")
    counts = stored(each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key-counts")
    named = counts.select(F.col("key").alias("c_key"), "n")
    # both sides are shuffled at every size: the keys that are left grow with the rows
    met = each.join(named.filter(F.col("n") <= hot).hint("merge"), F.col("key") == F.col("c_key"), "left_semi")
    if not counts.filter(F.col("n") > hot).take(1):
        return met
    # a hot key's points get salts of about hot / 2 points; those of every two salts meet in one shard
    salts = F.ceil(F.col("n") * 2 / hot).cast("long")
    crowded = each.join(named.filter(F.col("n") > hot), F.col("key") == F.col("c_key")).withColumn("salts", salts)
    pairs = crowded.withColumn("salt", F.pmod(F.xxhash64(F.lit(HOT_SALT), "node"), "salts"))
    pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    pairs = pairs.select(F.xxhash64("key", F.least("salt", "other"), F.greatest("salt", "other")).alias("key"), "place", "salt", "node", "sig", "keys")
    return met.unionByName(pairs)


def true_links(points: DataFrame, radius: int, block: int = AUDIT_BLOCK) -> DataFrame:
    """(there): links within the radius that exact search over all points finds for those of `rep` divisible by 50,
    a row for each block of queries and partition of points."""
    known = points.select("node", "rep", "sig")
    n = known.filter("rep % 50 = 0").count()
    blocks_ = -(-n // block)
    if not blocks_:
        return points.sparkSession.createDataFrame([], "there long")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = known.filter("rep % 50 = 0").select(F.pmod(F.xxhash64(F.lit(HOT_SALT), "node"), F.lit(blocks_)).alias("of"), "node", "sig", F.lit(True).alias("asks"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    told = known.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks_ - 1).cast("long"))).alias("of"), "node", "sig", F.lit(False).alias("asks"))
    told = told.withColumn("part", F.pmod(F.xxhash64(F.lit(HOT_SALT + 1), "node"), F.lit(parts)).cast("int"))
    rows = asked.unionByName(told).repartition(parts, "of", "part").sortWithinPartitions("of", "part", F.desc("asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, node, sig, there = None, [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            cell = np.stack([np.array(b.column(i)) for i in range(2)], 1)
            nodes, asks = np.array(b.column(2)), b.column(4).to_numpy(zero_copy_only=False)
            sigs = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(-1, 4)
            ends = np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1
            for x, y in zip([0, *ends.tolist()], [*ends.tolist(), len(cell)], strict=True):
                if at != tuple(cell[x]):
                    at, node, sig = tuple(cell[x]), [], []
                q = x + int(asks[x:y].sum())  # the queries of a cell come first
                node.append(nodes[x:q])
                sig.append(sigs[x:q])
                mine, own = np.concatenate(node), np.concatenate(sig)
                step = max(1, 1_000_000 // max(1, y - q))
                for k in range(0, len(mine) if y > q else 0, step):
                    near = pairwise(own[k : k + step], sigs[q:y]) <= radius
                    there += int(near.sum()) - int((near & (mine[k : k + step, None] == nodes[None, q:y])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([there], pa.int64())], ["there"])

    return rows.select("of", "part", "node", "sig", "asks").mapInArrow(run, "there long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the least node of each connected component."""
    both = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    labels = stored(both.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct(), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("least"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "least").alias("mid"))
        up = labels.select(F.col("node").alias("up_node"), F.col("label").alias("up"))
        jumped = step.join(up, F.col("mid") == F.col("up_node")).select("node", "old", F.least("mid", "up").alias("label"))
        jumped = stored(jumped, "labels")
        labels = jumped.select("node", "label")
        if not jumped.filter("old <> label").take(1):
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, beam: int = BEAM, hot: int = HOT) -> DataFrame:
    """`labelled` without the labels and nodes."""
    return labelled(docs, id_col, text_col, radius, beam, hot).drop("node", "label")


def labelled(docs: DataFrame, id_col: str, text_col: str, radius: int = RADIUS, beam: int = BEAM, hot: int = HOT, audit: bool = True) -> DataFrame:
    """node and label (of the text and its class), id, class_id (least id of the class), n_links (of its text, to other texts), n_copies (rows of its
    text), recall (links found of those exact search over all points finds, for texts whose least id is divisible
    by 50; null without `audit`); one row per document."""
    rows = stored(fingerprinted(docs, id_col, text_col), "fingerprints")
    points = stored(rows.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"), F.first("keys").alias("keys")), "points")
    made = stored(shard_links(shard_rows(points.filter("keys IS NOT NULL"), hot), radius, beam), "links")
    degree = stored(made.filter("b IS NULL").groupBy(F.col("a").alias("d_node")).agg(F.sum("n").alias("n_links")), "degrees")
    recall = F.lit(None).cast("double")
    if audit:
        there = true_links(points.filter("keys IS NOT NULL"), radius).agg(F.sum("there")).first()[0]
        asked = points.filter("rep % 50 = 0").select("node")
        found = degree.join(asked, F.col("d_node") == F.col("node")).agg(F.sum("n_links")).first()[0] if there else 0
        recall = F.lit(float((found or 0) / there if there else 1.0))
    labels = components(made.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("l_node"), "label")
    named = points.select("node", "rep", "n_copies").join(labels, F.col("node") == F.col("l_node"), "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("class_id")).withColumnRenamed("label", "c_label")
    full = named.join(least, F.col("label") == F.col("c_label")).join(degree, F.col("node") == F.col("d_node"), "left")
    full = full.select(F.col("node").alias("f_node"), "label", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    back = lambda c: F.when(F.col(c) < LAST, F.col(c))
    return rows.join(full, F.col("node") == F.col("f_node")).select("node", "label", back("id").alias("id"), back("class_id").alias("class_id"), "n_links", "n_copies", recall.alias("recall"))


def report(docs: DataFrame, **options) -> DataFrame:
    return classes(docs, **options).withColumnRenamed("id", "doc_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without their near-copies: of every class the row with the least id, null ids last, and
    then the least text hash."""
    found = labelled(docs, id_col, text_col, audit=False, **options)
    order = F.struct(F.coalesce(F.col("id"), F.lit(LAST)).alias("kept_id"), F.col("node").alias("kept_node"))
    kept = found.groupBy("label").agg(F.min(order).alias("kept")).select("kept.*")
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*at.values()).withColumn("own_id", F.coalesce(F.col(at[id_col]).cast("long"), F.lit(LAST)))
    own = own.withColumn("own_node", F.xxhash64(F.md5(F.coalesce(F.col(at[text_col]), F.lit("")))))
    one = own.join(kept, (F.col("own_id") == F.col("kept_id")) & (F.col("own_node") == F.col("kept_node")), "left_semi").dropDuplicates(["own_id", "own_node"])
    return one.select(*[F.col(v).alias(k) for k, v in at.items()])
