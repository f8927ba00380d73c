"""Token ids as wavelet-matrix shards.

A shard holds the ids of consecutive documents as bit planes, most significant bit first: plane k has bit
k of every id in the order plane k - 1 left them, and then zeros go before ones, each in order. With the
number of ones before every `SAMPLE`-th place of a plane, a rank is one sample and one short count, so
access, counting of an id in a range and its k-th occurrence each take one rank (or a binary search) a
plane, straight from the planes.

File, all little-endian: magic `EFWM2\\n`; 6 int64 (documents, ids, planes, compressed lengths of the document
table and of the rank samples, CRC-32 of all that follows the header); the ends of the blocks (int64), planes
being cut into blocks of `PIECE` bytes that are a zstd frame each; then the document table (doc_id, null
flag, n ids), the samples (uint32) and the blocks. A look-up reads the head and one block a plane.

Files are written and read through `pyarrow.fs`, by the URI of the folder (file, hdfs, s3 or s3a), so the
folder is the one all executors share; a file system that is not there is an error, never a local folder.

Order: documents are range-partitioned by id and text hash and sorted (null ids first), every
partition writes its shards in turn, so reading shards by (partition, number) is ascending id order.
A shard closes before the block of texts that would take it over `SHARD_IDS` ids, which bounds a task's
memory; a larger block (one very long document) has a shard of its own. Writing is to a temporary name
and then a move, so a repeated task leaves the same file.

Edge cases: null and empty texts are one id, the end id; repeated rows are documents of their own; an
empty table gives an empty result; only id and text are read, so other columns cannot clash; rows equal in
id and text share a partition.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echofold.llm.bpe import encode_rows, tokenizer_path
from echofold.llm.common import fresh_dir, stored

MAGIC = b"EFWM2\n"
SAMPLE, SHARD_IDS, END, PIECE = 512, 4_000_000, 0, 1 << 16


class Plane:
    """A bit plane whose blocks are fetched when they are asked for; no slice may cross a block."""

    def __init__(self, n: int, block: Callable[[int], np.ndarray]):
        self.n, self.block, self.held = n, block, {}

    def _at(self, i: int) -> np.ndarray:
        if i not in self.held:
            self.held[i] = self.block(i)
        return self.held[i]

    def __getitem__(self, at: int | slice) -> np.ndarray:
        first = at.start if isinstance(at, slice) else at
        base = first // PIECE * PIECE
        if isinstance(at, slice):
            return self._at(first // PIECE)[first - base : at.stop - base] if at.stop > first else np.zeros(0, np.uint8)
        return self._at(first // PIECE)[first - base]

    def whole(self) -> np.ndarray:
        return np.concatenate([self._at(i) for i in range(-(-self.n // PIECE))]) if self.n else np.zeros(0, np.uint8)


def _whole(plane: np.ndarray | Plane) -> np.ndarray:
    return plane.whole() if isinstance(plane, Plane) else plane


class WaveletMatrix:
    """Bit planes with rank support over a sequence of unsigned ids."""

    def __init__(self, n: int, planes: list[np.ndarray] | list[Plane], samples: list[np.ndarray]):
        self.n, self.planes, self.samples = n, planes, samples
        self.zeros = [n - self._ones(k, n) for k in range(len(planes))]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        planes, samples, now = [], [], ids
        for k in range(bits - 1, -1, -1):
            bit = (now & now.dtype.type(1 << k)).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            full = np.zeros(-(-len(ids) // SAMPLE) * SAMPLE // 8, np.uint8)
            full[: len(planes[-1])] = planes[-1]
            per = np.bitwise_count(full.view(np.uint64)).reshape(-1, SAMPLE // 64).sum(1) if len(full) else np.zeros(0, np.int64)
            samples.append(np.concatenate([[0], np.cumsum(per)]).astype(np.uint32))
            now = np.concatenate([np.compress(~bit, now), np.compress(bit, now)])
        return cls(len(ids), planes, samples)

    def _ones(self, k: int, i: int) -> int:
        """Ones before place i of plane k."""
        s = i // SAMPLE
        part = self.planes[k][s * SAMPLE // 8 : i // 8]
        rest = int(self.planes[k][i // 8] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0
        return int(self.samples[k][s]) + int(np.bitwise_count(part).sum()) + rest

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        value = 0
        for k in range(len(self.planes)):
            bit, ones = self._bit(k, i), self._ones(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the places of `value` among [lo, hi) lie after the last plane."""
        bits = len(self.planes)
        if value >> bits:
            return 0, 0
        for k in range(bits):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if value >> (bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) `bit` of plane k."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(k, mid + 1)
            if (ones if bit else mid + 1 - ones) > j:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def occurrence(self, value: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of `value`, -1 if there are fewer."""
        a, b = self._range(value, 0, self.n)
        if j >= b - a:
            return -1
        i = a + j
        for k in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def occurrences(self, value: int) -> np.ndarray:
        """All places of `value`, ascending."""
        a, b = self._range(value, 0, self.n)
        at = np.arange(a, b)
        if b - a < 64:
            return np.array([self.occurrence(value, j) for j in range(b - a)], np.int64)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(_whole(self.planes[k]), count=self.n, bitorder="little").astype(bool)
            one = value >> (len(self.planes) - 1 - k) & 1
            at = np.flatnonzero(bit if one else ~bit)[at - self.zeros[k] if one else at]
        return np.sort(at)

    def all(self) -> np.ndarray:
        """The whole sequence: from the last plane up, every plane puts its zeros and ones back."""
        now = np.zeros(self.n, np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(_whole(self.planes[k]), count=self.n, bitorder="little").astype(bool)
            back = np.empty_like(now)
            back[~bit] = now[: self.zeros[k]]
            back[bit] = now[self.zeros[k] :] | np.uint32(1 << (len(self.planes) - 1 - k))
            now = back
        return now


def to_bytes(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    import zstandard

    w = WaveletMatrix.build(ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids)
    zip_ = zstandard.ZstdCompressor(level=1).compress
    table = zip_(doc_ids.astype("<i8").tobytes() + nulls.astype(np.uint8).tobytes() + counts.astype("<i8").tobytes())
    samples = zip_(b"".join(s.astype("<u4").tobytes() for s in w.samples))
    blocks = [zip_(p[i : i + PIECE].tobytes()) for p in w.planes for i in range(0, len(p), PIECE)]
    body = b"".join([np.cumsum([len(x) for x in blocks], dtype="<i8").tobytes(), table, samples, *blocks])
    return MAGIC + struct.pack("<6q", len(doc_ids), len(ids), len(w.planes), len(table), len(samples), zlib.crc32(body)) + body


Reader = Callable[[int, int], bytes]


def opened(read: Reader, check: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """(doc ids, their null flags, ids of each, the matrix) of a shard that `read(offset, length)` reads; the
    blocks of its planes when they are needed. `check` compares the checksum, for which all is read."""
    import zstandard

    head = len(MAGIC) + 48
    start = read(0, head)
    if start[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token shard")
    n_docs, n, bits, n_table, n_samples, crc = struct.unpack("<6q", start[len(MAGIC) :])
    size = -(-n // 8)
    per = -(-size // PIECE)
    index = np.frombuffer(read(head, 8 * bits * per), "<i8")
    at = head + 8 * bits * per
    if check and zlib.crc32(read(head, 8 * bits * per + n_table + n_samples + int(index[-1] if len(index) else 0))) != crc:
        raise ValueError("token shard is damaged")
    unzip = lambda raw: zstandard.ZstdDecompressor().decompress(raw)
    docs, samples = unzip(read(at, n_table)), unzip(read(at + n_table, n_samples))
    first = at + n_table + n_samples

    def block(i: int) -> np.ndarray:
        lo = int(index[i - 1]) if i else 0
        return np.frombuffer(unzip(read(first + lo, int(index[i]) - lo)), np.uint8)

    planes = [Plane(size, lambda i, k=k: block(k * per + i)) for k in range(bits)]
    ids, counts = np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, "<i8", n_docs, 9 * n_docs)
    return ids, np.frombuffer(docs, np.uint8, n_docs, 8 * n_docs), counts, WaveletMatrix(n, planes, list(np.frombuffer(samples, "<u4").reshape(bits, -1)))


def from_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """`opened` of a shard in memory, its checksum compared."""
    return opened(lambda at, n: raw[at : at + n], check=True)


def file_system(uri: str):
    """(pyarrow file system, path in it) of a folder's or a file's URI; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3://" + uri.removeprefix("s3a://") if uri.startswith("s3a://") else uri)


def opened_file(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """`opened` of a shard's file, of which only what is asked for is read."""
    files, path = file_system(uri)
    f = files.open_input_file(path)
    return opened(lambda at, n: f.read_at(n, at))


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, shard_ids: int = SHARD_IDS, end: int = END) -> DataFrame:
    """Writes the shards and returns their manifest: part, number, file, docs, ids, a row a shard."""
    path = path or tokenizer_path()
    files, where = file_system(folder)
    files.create_dir(where, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        size = number = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, number
            ids, nulls, counts, tokens = (np.concatenate([h[i] for h in held]) for i in range(4))
            name = f"part-{part:06d}-{number:05d}.efwm"
            there, base = file_system(folder)
            with there.open_output_stream(tmp := f"{base}/{name}.{uuid.uuid4().hex}") as f:
                f.write(to_bytes(ids, nulls, counts, tokens))
            there.move(tmp, f"{base}/{name}")
            row = [part, number, f"{folder}/{name}", len(ids), len(tokens)]
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "number", "file", "docs", "ids"])

        for b in batches:
            key = b.column(0)
            nulls = np.array(key.is_null())
            key = np.array(key.fill_null(0))
            for first, last, ids, counts in encode_rows(b.column(1), path):
                ends = np.cumsum(counts)
                ids, counts = np.insert(ids, ends, end), counts + 1
                if held and size + len(ids) > shard_ids:
                    yield close()
                held.append((key[first:last], nulls[first:last], counts, ids))
                size += len(ids)
        if held:
            yield close()

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ordered = keyed.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return stored(ordered.mapInArrow(run, "part long, number long, file string, docs long, ids long"), "token-manifest")


def listed(manifest: DataFrame) -> DataFrame:
    """(file, base, ids): the shards in order, base being the ids of all before."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("held"))  # one row per range partition
    parts = parts.select(F.col("part").alias("p"), (F.sum("held").over(upto(Window.orderBy("part"))) - F.col("held")).alias("before"))
    inside = F.sum("ids").over(upto(Window.partitionBy("part").orderBy("number"))) - F.col("ids")
    return manifest.withColumn("inside", inside).join(parts, F.col("part") == F.col("p")).select("file", (F.col("before") + F.col("inside")).alias("base"), "ids")


def _spread(manifest: DataFrame) -> DataFrame:
    return listed(manifest).repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, base in zip(frame["file"], frame["base"], strict=True):
                there, path = file_system(file)
                with there.open_input_stream(path) as f:
                    ids, nulls, counts, matrix = from_bytes(f.read())
                raw = matrix.all().astype("<u4").tobytes()
                ends = np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64").copy() if not nulls.any() else pd.array([None if z else i for i, z in zip(ids.tolist(), nulls, strict=True)], "Int64"), "start": base + ends - counts, "n_tokens": counts, "ids_crc32": crc})

    return _spread(manifest).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def access(manifest: DataFrame, positions: DataFrame, span: int = SHARD_IDS) -> DataFrame:
    """(position, token) of the given positions (position long) among all ids; positions past the end are
    left out. A position meets its shard over the stretches of `span` ids that a shard touches."""
    shards = listed(manifest).filter("ids > 0").withColumn("stretch", F.explode(F.sequence(F.floor(F.col("base") / span), F.floor((F.col("base") + F.col("ids") - 1) / span))))
    met = positions.select(F.col("position").cast("long").alias("position")).withColumn("stretch", F.floor(F.col("position") / span))
    met = met.join(shards, "stretch").filter((F.col("position") >= F.col("base")) & (F.col("position") < F.col("base") + F.col("ids")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, asked in frame.groupby("file"):
                matrix = opened_file(file)[3]
                yield pd.DataFrame({"position": asked["position"], "token": [matrix.access(int(i)) for i in asked["position"] - asked["base"]]})

    return met.select("file", "base", "position").repartition("file").sortWithinPartitions("file", "position").mapInPandas(run, "position long, token long")


def count(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of a stated list of ids stands in all shards."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file in frame["file"]:
                matrix = opened_file(file)[3]
                yield pd.DataFrame({"token": tokens, "n": [matrix.count(t) for t in tokens]})

    return _spread(manifest).mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, position): every place of a stated list of ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, base in zip(frame["file"], frame["base"], strict=True):
                matrix = opened_file(file)[3]
                for t in tokens:
                    yield pd.DataFrame({"token": t, "position": base + matrix.occurrences(t)})

    return _spread(manifest).mapInPandas(run, "token long, position long")


def stored_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: all documents written as shards and read back."""
    return read_shards(write_shards(docs, fresh_dir(docs.sparkSession, "token-shards")))
