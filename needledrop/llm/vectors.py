"""Vectors as rows of bytes, as exact whole numbers, and exact sums of these over any number of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needledrop.llm.common import bounded_batches, column_of

#: The largest long: what is larger is shown as it.
LARGEST = 2**63 - 1


def finite(vectors: DataFrame, *others: Column, embedding: str = "embedding", zeros: bool = True) -> tuple[DataFrame, str]:
    """others and data (the vector's bytes) of the rows whose vector is there, not empty and all of finite components; the numbers' kind.

    Vectors of floats stay floats; other numbers become doubles. zeros: whether vectors of zeros alone stay.
    """
    kind = "<f4" if isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType) else "<f8"
    rows = bounded_batches(vectors).select(*others, F.col(embedding).cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column_of(batch, "data")
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype(kind, copy=False), lists.offsets.to_numpy()
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            good = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]]) & (ends[1:] > ends[:-1])
            if not zeros:
                some = np.concatenate(([0], np.cumsum(flat != 0)))
                good &= some[ends[1:]] > some[ends[:-1]]
            places = (ends * flat.itemsize).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, data], names=batch.schema.names).filter(pa.array(good))

    schema = T.StructType([*(f for f in rows.schema if f.name != "data"), T.StructField("data", T.BinaryType())])
    return rows.mapInArrow(run, schema), kind


def matrix(data: pa.Array, kind: str) -> np.ndarray:
    """Rows of bytes, all of one length, as a matrix of doubles."""
    n, ends = len(data), np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    flat = np.frombuffer(data.buffers()[2], kind, (ends[-1] - ends[0]) // np.dtype(kind).itemsize, ends[0]) if ends[-1] > ends[0] else np.zeros(0, kind)
    return flat.reshape(n, -1).astype(np.float64)


def usual_length(rows: DataFrame) -> int:
    """The most frequent length in bytes of data (the longer one of two; 0: no rows)."""
    first = rows.groupBy(F.octet_length("data").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return first["n"] if first else 0


def smallest(rows: DataFrame, key: Column, n: int) -> list[bytes]:
    """data of the n rows of smallest key (never null), ties by the bytes. First the n-th key: so tasks send n keys each, not n vectors."""
    keyed = rows.select(key.alias("k"), "data")
    last = keyed.select("k").orderBy("k").limit(n).agg(F.max("k")).first()[0]
    if last is None:
        return []
    few = keyed.where(F.col("k") <= F.lit(last)).orderBy("k", "data").limit(n)
    return [r["data"] for r in few.agg(F.sort_array(F.collect_list(F.struct("k", "data")))).first()[0]]


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact: longs where all of them fit with room to spare, else Python's whole numbers. scale is a power of two."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 2.0**60:
        return y.astype(np.int64)
    return np.array([[int(b) if np.isfinite(b) else int(a) * scale for a, b in zip(p, q, strict=True)] for p, q in zip(x.tolist(), y.tolist(), strict=True)], dtype=object)


def largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


#: An exact sum travels as digits of this base, so that sums of digits fit in a long in a task and in a decimal over all.
DIGIT = 48
SUMS = "entry int, place int, digit int, total long"


def sum_rows(totals: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The numbers of a table of whole numbers that aren't zero, digit by digit (the last digit has the sign), as rows of SUMS."""
    digit, rest = 0, totals
    while rest.size and rest.any():
        if rest.dtype == object or largest(rest) >> DIGIT:
            low, rest = rest & ((1 << DIGIT) - 1), rest >> DIGIT
            negative = (rest == -1).astype(bool)  # nothing is left but the sign
            low, rest = np.where(negative, low - (1 << DIGIT), low), np.where(negative, 0, rest)
        else:
            low, rest = rest, np.zeros(0, np.int64)
        at = np.nonzero(low)
        n = len(at[0])
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(np.full(n, digit, np.int32)), pa.array(low[at].astype(np.int64))], names=["entry", "place", "digit", "total"])
        digit += 1


def summed(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The table of exact sums (Python's whole numbers) from rows of SUMS; as large as its shape, whatever the input."""
    out = np.zeros(shape, dtype=object)
    for r in rows.groupBy("entry", "place", "digit").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["entry"], r["place"]] += int(r["total"]) << (DIGIT * r["digit"])
    return out


def means(old: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Each entry's floor(sum / count) in every place; the old entry where the count (the last column) is 0."""
    return np.array([z if not t[-1] else [s // t[-1] for s in t[:-1]] for z, t in zip(old.tolist(), totals.tolist(), strict=True)], dtype=object).reshape(old.shape)


def narrowed(x: np.ndarray) -> np.ndarray:
    """Whole numbers as longs where they fit with room to spare, else as they are."""
    return x.astype(np.int64) if largest(x) < 2**60 else x


def as_long(x: np.ndarray) -> np.ndarray:
    """Whole numbers as longs; the largest long for what is larger."""
    return np.array([min(v, LARGEST) for v in x.tolist()], dtype=np.int64) if x.dtype == object else x.astype(np.int64)


def total_long(column: str) -> Column:
    """The exact sum of a column of longs; the largest long if it is larger."""
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")


def per_task(work: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the sum of work's tables over all batches of a task, as rows of SUMS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=object)
        for batch in batches:
            if batch.num_rows:
                total = total + work(batch)
        yield from sum_rows(total)

    return run
