"""Helpers that several operators share: packed arrays, shared folders, word hashing, vocabulary files."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null document id counts as larger than every other id.
NULL_ID = 2**63 - 1


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares (spark.checkpoint.dir); it goes when the session's JVM ends.

    Where that is unset, a session on one machine gets a local folder; on a cluster it is an error, as what an executor
    writes to its own disk is missing for the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if base is None and current is not None:
        base = current
    if base is None:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = "file://" + tempfile.mkdtemp(prefix="needledrop-")
    if current is None:
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    return path


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


#: Where the tables of written() that are still there lie, by the DataFrame that reads them.
_paths: WeakKeyDictionary = WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """df after a trip through a Parquet table in the shared folder: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def remove(df: DataFrame) -> None:
    """Deletes the table of written() that df reads; nothing may read it any more."""
    path = _paths.pop(df, None)
    if path is not None:
        files, where = _files(df.sparkSession, path)
        files.delete(where, True)


#: Bytes of input for each shuffle partition at most.
PARTITION_BYTES = 64 << 20


def partitions_for(df: DataFrame, per_core: int = 1) -> int:
    """Shuffle partitions: what the session asks for, one for every core, and one for each PARTITION_BYTES of the input, at least."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = -(-size // PARTITION_BYTES) if size < 1 << 60 else 1  # beyond: Spark doesn't know
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism, by_size)


#: Bytes of an Arrow batch on its way to Python: a batch goes by rows otherwise, whatever their length.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df; from now on the session's Arrow batches have at most BATCH_BYTES bytes, or one row."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set(key, str(BATCH_BYTES))
    return df


def with_ids(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and text alone, so that extra columns can't clash; null text is the empty text."""
    return bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def whole_rows(df: DataFrame) -> Column:
    """All columns of df as one struct column, so that a column of any name can stand beside it; select("row.*") undoes it."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=kind)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit integers as compressed differences, one byte plane after another."""
    if not len(values):
        return pack(values)
    gaps = np.diff(values.astype("<u8"), prepend=np.uint64(0))
    return pack(gaps.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = unpack(blob, "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def column_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring runs of at most `most` units, or of one item that is larger by itself."""
    start, ends = 0, np.cumsum(lengths)
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


#: What an entry of a store takes besides the bytes of its key and value: two objects and a place in the table.
ENTRY_BYTES = 200
#: A longer key isn't kept: it is rarely met again.
LONGEST_KEY = 256


class Store:
    """Values by key for keys met before, emptied when keys and values together pass most_bytes."""

    def __init__(self, most_bytes: int):
        self.most, self.size, self.known = most_bytes, 0, {}

    def values(self, keys: list, learn: Callable[[list], dict]) -> list:
        """The value of each key; those not met before from learn(keys), which gives a dictionary."""
        found = list(map(self.known.get, keys))
        new = {k for k, v in zip(keys, found, strict=True) if v is None}
        if not new:
            return found
        fresh = learn([*new])
        found = [fresh[k] if v is None else v for k, v in zip(keys, found, strict=True)]
        self.known.update(fresh)
        self.settle(fresh)
        return found

    def settle(self, fresh: dict) -> None:
        """Long keys go; beyond the bound all others do as well, but for the fresh ones if these keep within it."""
        for k in [k for k in fresh if len(k) > LONGEST_KEY]:
            del self.known[k], fresh[k]
        size = sum(map(len, fresh)) + sum(len(v) for v in fresh.values() if isinstance(v, bytes)) + ENTRY_BYTES * len(fresh)
        self.size += size
        if self.size > self.most:
            self.known.clear()
            self.size = 0
            if size <= self.most:
                self.known.update(fresh)
                self.size = size


class WordHashes:
    """64-bit hashes of words, kept for words met before in a store bounded by bytes."""

    def __init__(self, seed: int, most_bytes: int = 45 << 20):
        import xxhash

        self.hash, self.seed, self.store = xxhash.xxh3_64_digest, seed, Store(most_bytes)

    def learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        h, seed = self.hash, self.seed
        return {w: h(w, seed) for w in new}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        try:
            data = b"".join(map(self.store.known.get, words))
        except TypeError:  # a word without a hash
            data = b"".join(self.store.values(words, self.learn))
        return np.frombuffer(data, dtype="<u8")


def vocabulary_file(name: str) -> str:
    """A path as it is; a bare name is one of the installed public vocabularies."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_held: dict[str, dict] = {}


def held(key: tuple, make):
    """One object for each Python worker process; Spark reuses the process for further tasks.

    key: the operator, then what it is. What other operators held goes, so that a process which serves one stage after
    another has the stores of one at a time.
    """
    mine = _held.get(key[0])
    if mine is None:
        if _held:
            _held.clear()
            give_back()
        mine = _held[key[0]] = {}
    if key not in mine:
        mine[key] = make()
    return mine[key]


def give_back() -> None:
    """Free memory of this process goes back to the machine: a worker lives on, and others need it meanwhile."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
