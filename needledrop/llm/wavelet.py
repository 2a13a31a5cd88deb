"""Token ids as wavelet matrices: one succinct file for each shard of documents."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from needledrop.llm.common import column_of, held, partitions_for, shared_folder, slices, texts_of, with_ids
from needledrop.llm.encoding import ChunkEncoder

MAGIC = b"WVMX0002"
#: Bits for each entry of a rank directory, and of a chunk that is compressed for itself.
BLOCK, CHUNK = 512, 1 << 16
HEAD = struct.Struct("<8sIQQQ")


def build(tokens: np.ndarray, levels: int) -> list[tuple[int, np.ndarray]]:
    """For each bit from the highest: how many zeros it has, and the bits in the order of that level."""
    out = []
    for level in reversed(range(levels)):
        ones = (tokens >> level) & 1 != 0
        zeros = tokens.take(np.flatnonzero(~ones))
        out.append((len(zeros), np.packbits(ones)))
        tokens = np.concatenate((zeros, tokens.take(np.flatnonzero(ones))))
    return out


def level_bytes(zeros: int, bits: np.ndarray) -> bytes:
    """A level: its zeros, for each chunk the ones before it and where its data ends (u64), then the chunks.

    A chunk, compressed for itself, is a rank directory (the ones in the chunk before each block, u16) and the chunk's bits.
    """
    n = -(-len(bits) // (CHUNK // 8))
    padded = np.pad(bits, (0, n * CHUNK // 8 - len(bits))).reshape(n, CHUNK // BLOCK, BLOCK // 8)
    ones = np.bitwise_count(padded).sum(axis=2, dtype=np.int64)
    before = np.cumsum(ones.sum(axis=1)) - ones.sum(axis=1)
    directory = (np.cumsum(ones, axis=1) - ones).astype("<u2")
    squeeze = zstandard.ZstdCompressor(level=1).compress
    chunks = [squeeze(directory[k].tobytes() + padded[k].tobytes()) for k in range(n)]
    ends = np.cumsum([len(c) for c in chunks], dtype=np.uint64)
    return struct.pack("<QQ", zeros, n) + before.astype("<u8").tobytes() + ends.astype("<u8").tobytes() + b"".join(chunks)


def file_bytes(tokens: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of a shard: head, the ends of its sections (u64), the compressed document table, then the levels.

    Head: magic, levels, tokens, documents, bytes of the document table.
    """
    levels = max(1, int(tokens.max(initial=0)).bit_length())
    table = doc_ids.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + lengths.astype("<u8").tobytes()
    table = zstandard.ZstdCompressor(level=1).compress(table)
    sections = [level_bytes(zeros, bits) for zeros, bits in build(tokens, levels)]
    ends = np.cumsum([len(x) for x in sections], dtype=np.uint64)
    return HEAD.pack(MAGIC, levels, len(tokens), len(doc_ids), len(table)) + ends.astype("<u8").tobytes() + table + b"".join(sections)


class Shard:
    """A file of file_bytes: token access, counts and occurrences by rank and select.

    Opening reads the head; a question inflates the chunks that it touches, of which the last KEPT stay.
    """

    KEPT = 256

    def __init__(self, data: bytes):
        magic, self.levels, self.n, self.docs, size = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.data, at = memoryview(data), HEAD.size
        ends = np.frombuffer(data, "<u8", self.levels, at)
        self._table = at + 8 * self.levels, size
        base = at + 8 * self.levels + size
        self.zeros, self.before, self._ends, self._base = [], [], [], []
        for start in [base, *(base + int(e) for e in ends[:-1])]:
            zeros, n = struct.unpack_from("<QQ", data, start)
            self.zeros.append(zeros)
            self.before.append(np.frombuffer(data, "<u8", n, start + 16))
            self._ends.append(np.frombuffer(data, "<u8", n, start + 16 + 8 * n))
            self._base.append(start + 16 + 16 * n)
        self._inflate = zstandard.ZstdDecompressor().decompress
        self._kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self._documents: tuple | None = None

    def _documents_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._documents is None:
            at, size = self._table
            table, docs = self._inflate(self.data[at : at + size]), self.docs
            self._documents = np.frombuffer(table, "<i8", docs), np.frombuffer(table, "u1", docs, 8 * docs).astype(bool), np.frombuffer(table, "<u8", docs, 9 * docs).astype(np.int64)
        return self._documents

    @property
    def doc_ids(self) -> np.ndarray:
        return self._documents_table()[0]

    @property
    def nulls(self) -> np.ndarray:
        return self._documents_table()[1]

    @property
    def lengths(self) -> np.ndarray:
        return self._documents_table()[2]

    def _read(self, level: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        ends, base = self._ends[level], self._base[level]
        data = self._inflate(self.data[base + (int(ends[chunk - 1]) if chunk else 0) : base + int(ends[chunk])])
        n = CHUNK // BLOCK
        return np.frombuffer(data, "<u2", n), np.frombuffer(data, "u1", offset=2 * n)

    def _chunk(self, level: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """The rank directory and the bits of a chunk."""
        found = self._kept.pop((level, chunk), None) or self._read(level, chunk)
        self._kept[level, chunk] = found  # the last used come last
        if len(self._kept) > self.KEPT:
            del self._kept[next(iter(self._kept))]
        return found

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i."""
        chunk, i = divmod(i, CHUNK)
        if chunk == len(self.before[level]):  # the very end, at a chunk's border
            return self.n - self.zeros[level]
        directory, bits = self._chunk(level, chunk)
        block = i // BLOCK
        whole = int(np.bitwise_count(bits[block * (BLOCK // 8) : i // 8]).sum())
        rest = int(bits[i // 8] >> (8 - i % 8)).bit_count() if i % 8 else 0
        return int(self.before[level][chunk]) + int(directory[block]) + whole + rest

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit: its chunk by the ones before chunks, its block by the directory, then the bit."""
        before = self.before[level].astype(np.int64)
        before = before if bit else np.arange(len(before)) * CHUNK - before
        chunk = int(np.searchsorted(before, k, side="right")) - 1
        k -= int(before[chunk])
        directory, bits = self._chunk(level, chunk)
        inside = directory.astype(np.int64)
        inside = inside if bit else np.arange(len(inside)) * BLOCK - inside
        block = int(np.searchsorted(inside, k, side="right")) - 1
        k -= int(inside[block])
        some = np.unpackbits(bits[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)])
        return chunk * CHUNK + block * BLOCK + int(np.flatnonzero(some == bit)[k])

    def _bit(self, level: int, i: int) -> int:
        chunk, i = divmod(i, CHUNK)
        return int(self._chunk(level, chunk)[1][i // 8] >> (7 - i % 8)) & 1

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            ones = self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if token >> (self.levels - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often the token stands in places start to end."""
        if token < 0 or token >> self.levels:
            return 0
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """The place of the token's k-th (from 0) occurrence, or -1."""
        if token < 0 or token >> self.levels:
            return -1
        a, b = self._range(token, 0, self.n)
        if k >= b - a:
            return -1
        i = a + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in order: the levels undone from the lowest."""
        values = np.zeros(self.n, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            bits = [self._read(level, chunk)[1] for chunk in range(len(self.before[level]))]
            ones = np.unpackbits(np.concatenate(bits), count=self.n).view(bool) if bits else np.zeros(0, dtype=bool)
            zeros, up = self.zeros[level], np.empty_like(values)
            up[np.flatnonzero(~ones)] = values[:zeros]
            up[np.flatnonzero(ones)] = values[zeros:] | values.dtype.type(1 << (self.levels - 1 - level))
            values = up
        return values


def write_shards(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, shard_tokens: int = 1 << 20, batch_bytes: int = 2 << 20) -> None:
    """Writes a Parquet table (part, shard, n_docs, n_tokens, file) to path: one wavelet matrix file for each row.

    Documents stand in ascending doc_id order over (part, shard) and within a file, null ids first, repeated ids side
    by side; each has the library's ids of its whole text (null: empty), then end_id. A file takes documents until it
    has shard_tokens tokens, so its size has the bound of that and one document. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def make() -> ChunkEncoder:
            encoder = ChunkEncoder(vocabulary)
            encoder.kind = "<u2" if max(encoder.library.get_vocab_size(), end_id + 1) <= 65536 else "<u4"
            return encoder

        encoder = held(("wavelet", vocabulary, end_id), make)
        kind = encoder.kind
        width, end = np.dtype(kind).itemsize, np.array([end_id], dtype=kind).tobytes()
        part, shard = TaskContext.get().partitionId(), 0
        held_docs: list[tuple] = []
        lists: list[bytes] = []
        n = 0

        def full() -> pa.RecordBatch:
            nonlocal shard, n
            tokens = np.frombuffer(b"".join(lists), dtype=kind)
            data = file_bytes(tokens, np.array([d or 0 for d, _ in held_docs], dtype=np.int64), np.array([d is None for d, _ in held_docs]), np.array([k for _, k in held_docs], dtype=np.int64))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(held_docs)], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([data], pa.binary())], names=["part", "shard", "n_docs", "n_tokens", "file"])
            shard, n = shard + 1, 0
            held_docs.clear()
            lists.clear()
            return row

        for batch in batches:
            texts, ids = texts_of(batch), column_of(batch, "doc_id").to_pylist()
            sizes = np.array(pa.compute.binary_length(column_of(batch, "text")), dtype=np.int64)
            for a, b in slices(sizes, batch_bytes):
                if b - a == 1 and sizes[a] > batch_bytes:
                    rows = [b"".join(x for p in encoder.pieces(texts[a], batch_bytes) for x in encoder.texts([p]))]
                else:
                    rows = encoder.texts(texts[a:b])
                for d, row in zip(ids[a:b], rows, strict=True):
                    lists += (row, end)
                    held_docs.append((d, k := len(row) // width + 1))
                    n += k
                    if n >= shard_tokens:
                        yield full()
        if held_docs:
            yield full()

    import pyarrow.compute  # noqa: F401

    ranged = with_ids(docs).repartitionByRange(partitions_for(docs), "doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(run, "part int, shard int, n_docs long, n_tokens long, file binary").write.option("compression", "none").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids array<int> from the files at path."""
    return _read(spark, path, "ids")


def read_checksums(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: crc32 of the ids, read from the files, as little-endian 32-bit integers."""
    return _read(spark, path, "crc")


def _read(spark, path: str, what: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*(column_of(batch, c).to_pylist() for c in ("part", "shard", "file")), strict=True):
                shard = Shard(data)
                tokens = shard.tokens().astype("<u4")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                if what == "ids":
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(tokens.astype("<i4")))
                else:
                    view = memoryview(tokens.tobytes())
                    last = pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
                k = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.nulls), pa.array(np.full(k, part, np.int32)), pa.array(np.full(k, number, np.int32)), pa.array(starts), pa.array(shard.lengths), last], names=["doc_id", "part", "shard", "at", "n_tokens", "last"])

    table = spark.read.schema("part int, shard int, n_docs long, n_tokens long, file binary").parquet(path)
    kind, name = ("array<int>", "ids") if what == "ids" else ("long", "ids_crc32")
    rows = table.mapInArrow(run, f"doc_id long, part int, shard int, at long, n_tokens long, last {kind}")
    # One row for each file, then one for each part: never a row for each document.
    of_part = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    of_part = of_part.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    of_shard = table.select(F.col("part").alias("q"), F.col("shard").alias("s"), F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("shard_start"))
    starts = of_shard.join(of_part, F.col("q") == F.col("p"))
    out = rows.join(starts, (F.col("part") == F.col("q")) & (F.col("shard") == F.col("s")))
    return out.select("doc_id", (F.col("part_start") + F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", F.col("last").alias(name))


def archive(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Writes the shards of docs to a new folder in the shared one and reads them back: see read_checksums."""
    path = shared_folder(docs.sparkSession, "wavelet")
    write_shards(docs, path, vocabulary, end_id)
    return read_checksums(docs.sparkSession, path)
