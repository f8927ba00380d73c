"""Language-model scores by masked pseudo-likelihood.

A window network predicts each word from `SIDE` words on both sides: their vectors, one hidden layer, then
a class of ids and the id within its class (two softmaxes of ~sqrt(WORDS) terms, together a proper
distribution). The most frequent words have an id each; all others share `BUCKETS` ids by their last two
bytes, and within its id a word has the share it has of the corpus: p(word | both sides) = p(id | both
sides) * count(word) / count(id). So every word has a probability of its own, from counts of all words of
all texts. A text's score is the sum over its words of log p(word | both sides), every word masked in turn;
`mean_logp` divides it by the number of words.

Training: every partition runs Adagrad over every position of all its texts from the common weights, and
the weights are averaged, weighted by words, in a DataFrame aggregation (one row per 16 weights), `ROUNDS`
times. Nothing is sampled, and nothing that is gathered has a size of its own but the network.

Scale: texts are cut into words once, in blocks of a few MB; a block keeps its distinct words' hashes with
counts and the place of each word among them. Counting shuffles the former only, as arrays by hash range,
and sends each block the corpus counts of its words back, so the table of all words is nowhere in one
place and grows with the corpus. Blocks have numbers (partition, place in it) and are written, so what
follows never cuts texts again and a lost executor repeats tasks. At most `TRAINERS` partitions train, so
the averaged rows are bounded by the cluster, not by the input; the model (under 1 MB) travels with the
tasks; what reaches the driver has the model's size. A repeated task gives the same weights, and sums of
them in another order the same to 5 digits, to which weights are rounded.

Edge cases: null, empty and blank texts have no words: log_likelihood 0, mean_logp null; one word is
predicted from padding alone; long texts are one block and scored whole; repeated rows give equal rows; null
ids stay null; an empty table gives an empty result and is no model; a word the corpus lacks counts as half
a word; only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.common import stored
from echofold.llm.vectext import HashTable, Slices, blocks, mixed, words

CLASSES, IN_CLASS, BUCKETS = 32, 32, 128
WORDS = CLASSES * IN_CLASS
SIDE, VECTOR, HIDDEN = 2, 16, 32
ROUNDS, BATCH, RATE, TRAINERS = 1, 4096, 0.1, 2048
_OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]
_SHAPES = {"vectors": (WORDS + 1, VECTOR), "hidden": (len(_OFFSETS) * VECTOR + 1, HIDDEN), "classes": (HIDDEN + 1, CLASSES), "words": (WORDS, HIDDEN + 1)}


@dataclass
class Vocabulary:
    """Hashes of the frequent words by rank; the others fall into buckets behind them."""

    hashes: np.ndarray
    counts: np.ndarray  # of every id, buckets included

    def table(self) -> HashTable:
        t = HashTable()
        if len(self.hashes):
            t.add(self.hashes)
        return t


def tail_bucket(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bucket of words by their last two bytes."""
    tail = data[end - 1].astype(np.uint64) << np.uint64(8) | data[np.maximum(end - 2, start)].astype(np.uint64)
    return (mixed(tail) % np.uint64(BUCKETS)).astype(np.uint8)


def contexts(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(n, 2 * SIDE) ids around each word, WORDS where the text has none."""
    out = np.full((len(ids), len(_OFFSETS)), WORDS, np.int64)
    for k, off in enumerate(_OFFSETS):
        if off < 0:
            out[-off:, k] = np.where(row[-off:] == row[:off], ids[:off], WORDS)
        elif off < len(ids):
            out[:-off, k] = np.where(row[:-off] == row[off:], ids[off:], WORDS)
    return out


class Network:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Network:
        """Small random vectors, and output biases that give the corpus frequencies."""
        rng = np.random.default_rng(7)
        w = {k: rng.normal(0, 0.1, s) for k, s in _SHAPES.items()}
        w["words"][:, :-1] = 0
        w["classes"][:-1] = 0
        p = (counts + 0.5).reshape(CLASSES, IN_CLASS)
        w["classes"][-1] = np.log(p.sum(1) / p.sum())
        w["words"][:, -1] = np.log(p / p.sum(1, keepdims=True)).reshape(-1)
        return cls(w)

    def _hidden(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.w["vectors"][ctx].reshape(len(ctx), -1)
        return x, np.tanh(x @ self.w["hidden"][:-1] + self.w["hidden"][-1])

    def log_p(self, ids: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """log p(id | both sides) of each position."""
        out = np.empty(len(ids), np.float32)
        for a in range(0, len(ids), 4 * BATCH):
            order, ends = _by_class(ids[a : a + 4 * BATCH])
            t = ids[a : a + 4 * BATCH][order]
            _, h = self._hidden(ctx[a : a + 4 * BATCH][order])
            z = h @ self.w["classes"][:-1] + self.w["classes"][-1]
            part = z[np.arange(len(t)), t // IN_CLASS] - _log_sum(z)
            z = np.empty((len(t), IN_CLASS), np.float32)
            for c in np.flatnonzero(np.diff(ends)):
                w = self.w["words"][c * IN_CLASS : (c + 1) * IN_CLASS]
                z[ends[c] : ends[c + 1]] = h[ends[c] : ends[c + 1]] @ w[:, :-1].T + w[:, -1]
            out[a + order] = part + z[np.arange(len(t)), t % IN_CLASS] - _log_sum(z)
        return out

    def gradients(self, ids: np.ndarray, ctx: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability; those of `vectors` as (distinct ids, rows)."""
        n = len(ids)
        order, ends = _by_class(ids)
        ids, ctx = ids[order], ctx[order]
        x, h = self._hidden(ctx)
        z = _softmax(h @ self.w["classes"][:-1] + self.w["classes"][-1])
        z[np.arange(n), ids // IN_CLASS] -= 1
        dh = z @ self.w["classes"][:-1].T
        g = {"classes": np.concatenate([h.T @ z, z.sum(0, keepdims=True)]) / n, "words": np.zeros(_SHAPES["words"], h.dtype)}
        z = np.empty((n, IN_CLASS), h.dtype)
        some = [(slice(ends[c], ends[c + 1]), slice(c * IN_CLASS, (c + 1) * IN_CLASS)) for c in np.flatnonzero(np.diff(ends))]
        for mine, at in some:
            w = self.w["words"][at]
            z[mine] = h[mine] @ w[:, :-1].T + w[:, -1]
        z = _softmax(z)
        z[np.arange(n), ids % IN_CLASS] -= 1
        for mine, at in some:
            dh[mine] += z[mine] @ self.w["words"][at, :-1]
            g["words"][at, :-1] = z[mine].T @ h[mine]
            g["words"][at, -1] = z[mine].sum(0)
        g["words"] /= n
        dh *= 1 - h * h
        g["hidden"] = np.concatenate([x.T @ dh, dh.sum(0, keepdims=True)]) / n
        dx = (dh @ self.w["hidden"][:-1].T).reshape(-1, VECTOR) / n
        flat = ctx.reshape(-1)
        by = np.argsort(flat.astype(np.uint16), kind="stable")
        flat = flat[by]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        g["vectors"] = (flat[first], np.add.reduceat(dx[by], first, axis=0))
        return g


def _by_class(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the classes, where each class ends in it); classes fit a byte, so sorting is a radix sort."""
    group = (ids // IN_CLASS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    return order, np.searchsorted(group[order], np.arange(CLASSES + 1))


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(1, keepdims=True)
    return top[:, 0] + np.log(np.exp(z - top).sum(1))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


class Trainer:
    """Adagrad over the positions it is given, in batches."""

    def __init__(self, net: Network):
        self.net, self.seen = net, 0
        self.squares = {k: np.full(s, 1e-6, np.float32) for k, s in _SHAPES.items()}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, ids: np.ndarray, ctx: np.ndarray, last: bool = False) -> None:
        if len(ids):
            self.held.append((ids, ctx))
            self.waiting += len(ids)
        if not self.waiting or self.waiting < BATCH and not last:
            return
        ids, ctx = (np.concatenate([h[i] for h in self.held]) for i in range(2))
        whole = len(ids) if last else len(ids) // BATCH * BATCH
        for a in range(0, whole, BATCH):
            self.step(ids[a : min(a + BATCH, whole)], ctx[a : min(a + BATCH, whole)])
        self.held, self.waiting = [(ids[whole:], ctx[whole:])], len(ids) - whole

    def step(self, ids: np.ndarray, ctx: np.ndarray) -> None:
        self.seen += len(ids)
        for k, g in self.net.gradients(ids, ctx).items():
            at, g = g if k == "vectors" else (slice(None), g)
            self.squares[k][at] += g * g
            self.net.w[k][at] -= RATE * g / np.sqrt(self.squares[k][at])


def _all(rows: list, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind)


def packed(x: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed a byte plane after the other, as few planes as they need."""
    import zstandard

    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T[:width])
    return zstandard.ZstdCompressor(level=1).compress(bytes([width]) + planes.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    planes, width = planes[1:].reshape(planes[0], -1), int(planes[0])
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u4")[:, 0].astype(np.int64)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of texts as arrays: uid, doc (ids), absent (null flags), words (of each text), word (distinct hashes,
    ascending), tail (their buckets), n (their counts), at (which of them, the most frequent first, each word is)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 32
        for b in batches:
            absent, ids = np.array(b.column(0).is_null()), np.array(b.column(0).fill_null(0))
            for first, last, data, offsets in blocks(b.column(1)):
                start, end, row = words(data, offsets)
                word, one, at, n = np.unique(Slices(data).hashes(start, end), return_index=True, return_inverse=True, return_counts=True)
                rank = np.empty(len(word), np.int64)
                rank[np.argsort(-n, kind="stable")] = np.arange(len(word))
                parts = [ids[first:last], absent[first:last].astype(np.uint8), np.bincount(row, minlength=last - first).astype(np.int32), word, tail_bucket(data, start[one], end[one]), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([uid]), *(pa.array([x.tobytes()]) for x in parts), pa.array([packed(rank[at])])], ["uid", "doc", "absent", "words", "word", "tail", "n", "at"])
                uid += 1

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stored(own.mapInArrow(run, "uid long, doc binary, absent binary, words binary, word binary, tail binary, n binary, at binary"), "cut")


def counted(corpus: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Counts over the blocks of `corpus`, by ranges of word hashes. Rows of three kinds: (uid, part, totals): the
    counts of a block's words of a range, in their order, for the blocks of `asked` (or the corpus); (word, tail, n):
    the most frequent words of a range; (tail, n): all words of a bucket in a range."""
    parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [(corpus, True, asked is None)] + ([(asked, False, True)] if asked is not None else [])
    rows = [df.select("uid", "word", "tail", "n", F.lit(counts).alias("counts"), F.lit(told).alias("told")) for df, counts, told in kinds]
    every = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                part = ((_all([r["word"]], "<u8") >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                ends = np.searchsorted(part, np.arange(parts + 1))
                some = np.flatnonzero(np.diff(ends))
                slices = lambda raw, width: pa.array([raw[ends[p] * width : ends[p + 1] * width] for p in some], pa.binary())  # noqa: B023, E731
                same = lambda x: pa.array([x] * len(some))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), same(r["uid"]).cast(pa.int64()), slices(r["word"], 8), slices(r["tail"], 1), slices(r["n"], 4), same(r["counts"]).cast(pa.bool_()), same(r["told"]).cast(pa.bool_())], ["part", "uid", "word", "tail", "n", "counts", "told"])

    def out(uid=(), part=(), totals=(), word=(), tail=(), n=()) -> pa.RecordBatch:
        size = max(map(len, (uid, n)))
        none = lambda x, kind: pa.array(x, kind) if len(x) else pa.nulls(size, kind)
        cols = [none(uid, pa.int64()), none(part, pa.int32()), none(totals, pa.binary()), none(word, pa.int64()), none(tail, pa.int32()), none(n, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["uid", "part", "totals", "word", "tail", "n"])

    def total(held: list[dict]) -> Iterator[pa.RecordBatch]:
        word, back = np.unique(_all([r["word"] for r in held], "<u8"), return_inverse=True)
        size = [len(r["word"]) // 8 for r in held]
        mine = np.repeat([r["counts"] for r in held], size)
        totals = np.zeros(len(word), np.int64)
        np.add.at(totals, back, np.where(mine, _all([r["n"] for r in held], "<i4"), 0))
        tail = np.zeros(len(word), np.int64)
        tail[back] = _all([r["tail"] for r in held], np.uint8)
        told = [(r, x) for r, x in zip(held, np.split(back, np.cumsum(size)[:-1]), strict=True) if r["told"]]
        if told:
            yield out(uid=[r["uid"] for r, _ in told], part=[r["part"] for r, _ in told], totals=[totals[x].tobytes() for _, x in told])
        top = np.lexsort((word.view(np.int64), -totals))[: WORDS - BUCKETS]
        top = top[totals[top] > 0]
        yield out(word=word[top].view(np.int64), tail=tail[top], n=totals[top])
        yield out(tail=np.arange(BUCKETS), n=np.bincount(tail, totals, BUCKETS).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:  # ranges ascend
            for r in b.to_pylist():
                if held and held[0]["part"] != r["part"]:
                    yield from total(held)
                    held = []
                held.append(r)
        if held:
            yield from total(held)

    cut_ = every.mapInArrow(split, "part int, uid long, word binary, tail binary, n binary, counts boolean, told boolean")
    spread = cut_.repartition(parts, "part").sortWithinPartitions("part", "uid")
    return stored(spread.mapInArrow(run, "uid long, part int, totals binary, word long, tail int, n long"), "word-counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From `counted`: what comes to the driver are WORDS rows."""
    top = counts.filter("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(WORDS - BUCKETS).select("word", "tail", "n").collect()
    of = np.zeros(WORDS)
    of[: len(top)] = [r["n"] for r in top]
    for r in counts.filter("word IS NULL AND uid IS NULL").groupBy("tail").agg(F.sum("n").alias("n")).collect():
        of[WORDS - BUCKETS + r["tail"]] = r["n"]
    for r in top:
        of[WORDS - BUCKETS + r["tail"]] -= r["n"]
    return Vocabulary(np.array([r["word"] for r in top], np.int64).view(np.uint64), of)


def encoded(cut_: DataFrame, counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Blocks as ids: uid, doc, absent, words, ids (of each word), share (sum over a text of the words' log shares)."""
    mine = counts.filter("uid IS NOT NULL").groupBy(F.col("uid").alias("t_uid")).agg(F.sort_array(F.collect_list(F.struct("part", "totals"))).alias("parts"))
    both = cut_.join(mine, F.col("uid") == F.col("t_uid"), "left").select("uid", "doc", "absent", "words", "word", "tail", "n", "at", F.col("parts.totals").alias("totals"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocab.table()
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                word, n = _all([r["word"]], "<u8"), _all([r["words"]], "<i4")
                totals = _all(r["totals"] or [], "<i8")
                ids = table.find(word) if len(word) else np.zeros(0, np.int64)
                rare = ids < 0
                ids[rare] = WORDS - BUCKETS + _all([r["tail"]], np.uint8)[rare].astype(np.int64)
                share = np.where(rare, np.log(np.maximum(totals, 0.5) / np.maximum(vocab.counts[ids], 1)), 0)
                at = np.argsort(-_all([r["n"]], "<i4"), kind="stable")[unpacked(r["at"])]
                of = np.bincount(np.repeat(np.arange(len(n)), n), share[at], len(n)) if len(at) else np.zeros(len(n))
                cols = [r["uid"], r["doc"], r["absent"], r["words"], packed(ids[at]), of.astype("<f8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in cols], ["uid", "doc", "absent", "words", "ids", "share"])

    return stored(both.mapInArrow(run, "uid long, doc binary, absent binary, words binary, ids binary, share binary"), "token-blocks")


def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, words of each text, ids, text of each word) of the rows of `encoded`."""
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            n = _all([r["words"]], "<i4")
            yield r, n, unpacked(r["ids"]), np.repeat(np.arange(len(n)), n)


def trained(coded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Network:
    net = Network.fresh(vocab.counts)
    values = [f"v{i}" for i in range(16)]
    width = sum(int(np.prod(s)) for s in _SHAPES.values())
    n_rows = -(-width // 16)

    for _ in range(rounds):
        start = net.w

        def run(batches: Iterator[pa.RecordBatch], start: dict = start) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(Network(start))
            for _, _, ids, row in sequences(batches):
                trainer.add(ids, contexts(ids, row))
            trainer.add(np.zeros(0, np.int64), np.zeros((0, len(_OFFSETS)), np.int64), last=True)
            if trainer.seen:
                flat = np.zeros(n_rows * 16, np.float32)
                flat[:width] = np.concatenate([trainer.net.w[k].reshape(-1) for k in _SHAPES])
                cols = [pa.array(np.arange(n_rows)), pa.array(np.full(n_rows, float(trainer.seen)))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c) for c in np.ascontiguousarray(flat.reshape(-1, 16).T))], ["part", "weight", *values])

        schema = "part long, weight double, " + ", ".join(f"{v} float" for v in values)
        made = coded.select("words", "ids").coalesce(TRAINERS).mapInArrow(run, schema)
        total = made.groupBy("part").agg(*[(F.sum(F.col(v).cast("double") * F.col("weight")) / F.sum("weight")).alias(v) for v in values])
        rows = sorted(tuple(r) for r in total.collect())  # the model itself
        if not rows:
            return net
        flat = np.round(np.array([r[1:] for r in rows]).reshape(-1)[:width], 5)
        parts = np.split(flat, np.cumsum([int(np.prod(s)) for s in _SHAPES.values()])[:-1])
        net = Network({k: p.reshape(s) for (k, s), p in zip(_SHAPES.items(), parts, strict=True)})
    return net


def scored(coded: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_logp of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, n, ids, row in sequences(batches):
            total = _all([r["share"]], "<f8") + (np.bincount(row, net.log_p(ids, contexts(ids, row)), len(n)) if len(ids) else 0)
            mean = pa.array(np.round(total / np.maximum(n, 1), 4), mask=n == 0)
            doc = pa.array(_all([r["doc"]], "<i8"), mask=_all([r["absent"]], np.uint8).astype(bool))
            yield pa.RecordBatch.from_arrays([doc, pa.array(n.astype(np.int64)), pa.array(np.round(total, 2)), mean], ["doc_id", "n_tokens", "log_likelihood", "mean_logp"])

    return coded.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_logp double")


def pseudo_likelihood(corpus: DataFrame, asked: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of the documents of `corpus`, or of `asked`, by a model of the corpus."""
    own = cut(corpus, id_col, text_col)
    counts = counted(own)
    vocab = vocabulary(counts)
    coded = encoded(own, counts, vocab)
    net = trained(coded, vocab)
    if asked is not None:
        other = cut(asked, id_col, text_col)
        coded = encoded(other, counted(own, other), vocab)
    return scored(coded, net)
