"""Quality classifier by compression.

zstandard dictionaries are trained on labelled good and on labelled bad text, in two views: the bytes
themselves and their shape (letters, capitals, digits, marks). A text is compressed in blocks of `BLOCK`
bytes with each dictionary; the sizes add up over the whole text. The normalised differences
(good - bad) / max(good, bad) of both views, and log(good / length), go through a logistic calibration
fitted by Newton steps. Dictionaries and calibration use different halves of the sample.

The sample: per class the `ROWS` labelled documents with the lowest hash of their id, as many in that order as
hold `CHARS` characters together, whole and whatever their length, never from the held-out quarter (crc32 of
the id as text, mod 4, is 2). It is the only thing that is bounded; every text is scored whole. The
broadcast holds at most 2 * ROWS ids.

Edge cases: null, empty and blank texts score 0; conflicting labels of one id are left out, repeated ones
count once, null ones not at all; of several texts of a labelled id the shortest is fitted on (ties: the least); with fewer than `LEAST` texts of a class every other text scores the
smoothed share of good ones; a null id is not held out; an empty table gives an empty result; only id
and text of the documents are read for a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from echofold.llm.vectext import blocks

ROWS, CHARS, LEAST = 1500, 30_000_000, 8
BLOCK, DICTIONARY, LEVEL = 4096, 65_536, 3
CUT = 0.7
_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def dictionary(texts: list[bytes]) -> bytes:
    """Trained from blocks of the texts; their own bytes where there is too little to train from."""
    import zstandard

    samples = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY:]


@dataclass
class Model:
    """Dictionaries (good, bad, good shape, bad shape), calibration weights, score where there is no model."""

    dictionaries: list[bytes]
    weights: np.ndarray | None
    prior: float

    def compressors(self) -> list:
        import zstandard

        flags = {"level": LEVEL, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
        made = []
        for d in self.dictionaries:
            z = zstandard.ZstdCompressionDict(d)
            z.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=z, **flags))
        return made

    @staticmethod
    def features(text: bytes, compressors: list) -> list[float]:
        good, bad, good_shape, bad_shape = (c.compress for c in compressors)
        g = b = gs = bs = 0
        for i in range(0, len(text), BLOCK):
            part = text[i : i + BLOCK]
            shape = part.translate(_SHAPE)
            g += len(good(part))
            b += len(bad(part))
            gs += len(good_shape(shape))
            bs += len(bad_shape(shape))
        return [1.0, (g - b) / max(g, b), (gs - bs) / max(gs, bs), math.log(g / len(text)), math.log(gs / len(text))]

    def score(self, text: bytes, compressors: list) -> float:
        if not text.strip(b" \t\n\x0b\x0c\r"):
            return 0.0
        if self.weights is None:
            return self.prior
        z = float(np.dot(self.weights, self.features(text, compressors)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + v @ penalty @ v / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


def fit(rows: list[tuple[int, str, int]]) -> Model:
    """From (id, text, quality), the order of which does not matter."""
    rows = [(i, t.encode(), q) for i, t, q in sorted(rows) if t.strip()]
    good = sum(q for _, _, q in rows)
    prior = (good + 1) / (len(rows) + 2)
    if min(good, len(rows) - good) < LEAST:
        return Model([b"", b"", b"", b""], None, prior)
    classes = [[t for _, t, q in rows if q == k] for k in (1, 0)]
    first = [c[::2] for c in classes]
    model = Model([*(dictionary(c) for c in first), *(dictionary([t.translate(_SHAPE) for t in c]) for c in first)], None, prior)
    z = model.compressors()
    rest = [(t, 1.0 - k) for k, c in enumerate(classes) for t in c[1::2]]
    x = np.array([model.features(t, z) for t, _ in rest])
    model.weights = logistic(x, np.array([y for _, y in rest]))
    return model


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, chars: int = CHARS) -> list[tuple[int, str, int]]:
    """At most `rows` texts of a class, of at most `chars` characters together, for the driver to fit on."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter(F.col("quality") == F.col("most"))
    picked = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)]
    ids = picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("quality"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), F.col("id") == F.col("l_id")).groupBy("id", "quality").agg(F.min(F.struct(F.length("text").alias("size"), "text")).alias("t"))
    upto = Window.partitionBy("quality").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most `rows` each
    found = found.withColumn("upto", F.sum("t.size").over(upto)).filter(F.col("upto") <= chars)
    return [tuple(r) for r in found.select("id", "t.text", "quality").collect()]


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """Every column of docs, then score and predicted (names in the way are replaced)."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = model.compressors() if model.weights is not None else []
        for b in batches:
            if not b.num_rows:
                continue
            scores = []
            for _, _, data, offsets in blocks(b.column(names.index(text_col))):
                o = offsets.tolist()
                scores += [model.score(data[a:e].tobytes(), z) for a, e in zip(o[:-1], o[1:], strict=True)]
            s = np.round(scores, 6)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= cut).astype(np.int32))], [*names, "score", "predicted"])

    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return kept.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(sample(docs, labels))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with their own columns."""
    model = fit(sample(docs, labels))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name can be in the way
    kept = scored(docs.toDF(*at.values()), model, at["doc_id"], at["text"]).filter(F.col("predicted") == 1)
    return kept.select(*[F.col(v).alias(k) for k, v in at.items()])
