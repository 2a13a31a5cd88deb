"""Near copies among embeddings by collision-counting projections."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needledrop.llm.common import column_of, held, partitions_for, written
from needledrop.llm.components import connected_components

#: Vectors of a list that a task compares at a time, and from which size a list is cut into blocks.
BLOCK = 2048
#: Largest table that is broadcast, in rows of three numbers; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


#: Directions that a task projects on at a time, and products that it holds.
DIRECTIONS, PRODUCTS = 1024, 1 << 22


def directions(dim: int, part: int, n: int, seed: int) -> np.ndarray:
    """n random unit vectors as columns, the part-th such lot of a seed; the process keeps one lot."""
    kept = held(("embeddings",), dict)
    key = (dim, part, n, seed)
    if key not in kept:
        kept.clear()
        p = np.random.default_rng((seed, part)).normal(size=(dim, n))
        kept[key] = (p / np.linalg.norm(p, axis=0)).astype(np.float32)
    return kept[key]


def farthest(x: np.ndarray, n_lists: int, per_vector: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The per_vector directions (ascending) on which each row's projection is largest, and these projections, lot after lot."""
    best, top = np.full((len(x), 0), 0, np.float32), np.zeros((len(x), 0), np.int64)
    for part in range(-(-n_lists // DIRECTIONS)):
        n = min(DIRECTIONS, n_lists - part * DIRECTIONS)
        values = np.concatenate((best, x @ directions(x.shape[1], part, n, seed)), axis=1)
        numbers = np.concatenate((top, np.broadcast_to(np.arange(n) + part * DIRECTIONS, (len(x), n))), axis=1)
        keep = np.argpartition(-values, min(per_vector, values.shape[1]) - 1, axis=1)[:, :per_vector]
        best, top = np.take_along_axis(values, keep, axis=1), np.take_along_axis(numbers, keep, axis=1)
    order = np.argsort(top, axis=1)
    return np.take_along_axis(top, order, axis=1), np.take_along_axis(best, order, axis=1)


def unit_rows(data: list[bytes], kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(b, kind) for b in data]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Below this many dimensions every vector stands in all of FEW_LISTS lists, so that no pair can be missed.
EXACT_BELOW, FEW_LISTS = 8, 2


def lists_of(dim: int, n_lists: int, per_vector: int) -> tuple[int, int]:
    """How many lists vectors of that length have, and in how many of them each stands.

    In few dimensions linked vectors can be farthest out on wholly different directions, as many directions lie between
    them. There each stands in every list: linked vectors are in each other's window in all of them.
    """
    return (FEW_LISTS, FEW_LISTS) if dim < EXACT_BELOW else (n_lists, per_vector)


def _classes(vectors: DataFrame) -> tuple[DataFrame, str]:
    """vec_id, node (a 64-bit name of label and vector, null if it links with nothing), label, data for every row."""
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, data = [], []
            for label, row in zip(column_of(batch, "label").to_pylist(), column_of(batch, "embedding"), strict=True):
                x = None
                if label is not None and row.is_valid and row.values is not None and row.values.null_count == 0 and len(row.values):
                    x = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    x = x if np.isfinite(x).all() and x.any() else None
                if x is None:
                    nodes.append(None)
                    data.append(None)
                    continue
                raw = (x.astype(kind) + np.zeros(1, kind)).tobytes()  # -0 and 0 are one
                nodes.append(int.from_bytes(hashlib.blake2b(f"{label}\0".encode() + raw, digest_size=8).digest(), "big", signed=True))
                data.append(raw)
            yield pa.RecordBatch.from_arrays([column_of(batch, "vec_id"), pa.array(nodes, pa.int64()), column_of(batch, "label"), pa.array(data, pa.binary())], names=["vec_id", "node", "label", "data"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return rows.mapInArrow(run, "vec_id long, node long, label string, data binary"), kind


LISTS = "label string, dim int, list int, node long, copies long, value float, lists binary, values binary, data binary"


def sorted_lists(classes: DataFrame, kind: str, n_lists: int, per_vector: int, seed: int) -> DataFrame:
    """Each vector in the lists of the directions on which its projection is farthest out (see lists_of)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = column_of(batch, "data").to_pylist()
            sizes = np.array([len(x) for x in data])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                dim = size // np.dtype(kind).itemsize
                for some in np.array_split(at, -(-len(at) * DIRECTIONS // PRODUCTS)):
                    top, values = farthest(unit_rows([data[i] for i in some], kind).astype(np.float32), *lists_of(dim, n_lists, per_vector), seed)
                    top, k = top.astype("<i4"), top.shape[1]
                    take = pa.array(np.repeat(some, k))
                    own = batch.take(take)
                    row = pa.array(np.repeat(np.arange(len(some)), k))
                    names, heights = (pa.array([t.tobytes() for t in rows], pa.binary()).take(row) for rows in (top, values.astype("<f4")))
                    yield pa.RecordBatch.from_arrays(
                        [column_of(own, "label"), pa.array(np.full(len(take), dim, np.int32)), pa.array(top.ravel()), column_of(own, "node"), column_of(own, "copies"), pa.array(values.ravel()), names, heights, column_of(own, "data")],
                        names=[c.split()[0] for c in LISTS.split(", ")],
                    )

    return classes.mapInArrow(run, LISTS)


#: Words of 64 bits for the set of a vector's lists; with more lists than bits several share one.
SET_WORDS = 16


def _bits(lists: np.ndarray) -> np.ndarray:
    """The lists of each vector as a set of bits."""
    at = lists % (64 * SET_WORDS)
    out = np.zeros((len(at), SET_WORDS), dtype=np.uint64)
    for k in range(at.shape[1]):
        out[np.arange(len(at)), at[:, k] >> 6] |= np.uint64(1) << (at[:, k] & 63).astype(np.uint64)
    return out


def window_collisions(left: dict, i: np.ndarray, right: dict, j: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows: in how many lists one stands in the other's window, and the first such list (-1: none)."""
    n, first = np.zeros(len(i), dtype=np.int64), np.full(len(i), -1, dtype=np.int64)
    for k in reversed(range(left["lists"].shape[1])):  # ascending lists: the last one set is the first
        own = left["lists"][i, k]
        same = right["lists"][j] == own[:, None]
        hit = same.any(axis=1)
        other = right["values"][j, same.argmax(axis=1)]
        hit &= np.abs(left["values"][i, k] - other) <= reach
        n += hit
        first[hit] = own[hit]
    return n, first


def block_links(number: int, left: dict, right: dict | None, least: float, collisions: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks of a list (or within one) as places in left and right.

    For each query the window of its projection gives the others. Pairs that share enough lists (by sets of bits, which
    may count too many) are counted exactly: a collision is a list in which one stands in the window of the other.
    Pairs with enough collisions are verified in double precision, in the first list in which they collide.
    """
    own = right is None
    right = left if own else right
    reach = np.sqrt(max(0.0, 2 - 2 * least)) * (1 + 1e-5) + 1e-6
    order_l, order_r = np.argsort(left["value"], kind="stable"), np.argsort(right["value"], kind="stable")
    values = right["value"][order_r]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(order_l), 256):
        q = order_l[at : at + 256]
        start, stop = np.searchsorted(values, left["value"][q[0]] - reach), np.searchsorted(values, left["value"][q[-1]] + reach, side="right")
        c = order_r[start:stop]
        both = np.zeros((len(q), len(c)), dtype=np.uint8)
        for w in range(SET_WORDS):
            a, b = left["bits"][q, w], right["bits"][c, w]
            i, j = np.flatnonzero(a), np.flatnonzero(b)
            if len(i) and len(j):
                both[np.ix_(i, j)] += np.bitwise_count(a[i][:, None] & b[j][None, :])
        near = (both >= min(collisions, left["lists"].shape[1])) & (np.abs(left["value"][q][:, None] - right["value"][c][None, :]) <= reach)
        if own:
            near &= q[:, None] < c[None, :]
        i, j = np.nonzero(near)
        for k in range(0, len(i), 100_000):
            x, y = q[i[k : k + 100_000]], c[j[k : k + 100_000]]
            n, first = window_collisions(left, x, right, y, reach)
            some = (n >= collisions) & (first == number)
            x, y = x[some], y[some]
            some = np.einsum("ij,ij->i", left["unit"][x], right["unit"][y]) >= least
            found.append((x[some], y[some]))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as a-b do: every node with the smallest of its component, by spreading minima."""
    nodes, both = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def near_copies(vectors: DataFrame, least: float = 0.93, n_lists: int | None = None, per_vector: int | None = None, collisions: int = 2, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, label, embedding array of float or double).

    Rows link when their labels are equal and not null and the cosine, in double precision, is at least `least`.

    Equal vectors of a label are one class from the start. Many random directions each have a list of the vectors,
    sorted by projection; a vector stands in the lists of the directions on which it is farthest out, for elsewhere
    a window tells nothing. Two vectors collide in a list when one stands in the other's window there (as wide as linked
    vectors can be apart); pairs with `collisions` or more are verified. With 1,024 lists and 12 for each vector two
    unit vectors of 64 dimensions at cosine 0.93 collide at least twice in all of 4,000 trials, and about 1 % of unrelated
    pairs do. Lists grow in number with the largest label (from 100,000 vectors on; 16 for each vector then), so that
    their length stays; a task projects on 1,024 at a time. In fewer than EXACT_BELOW dimensions every vector stands in a few
    lists, all of them, and no link is missed. A list over BLOCK vectors is cut into blocks, and each
    pair of blocks is a task's group of its own. Tasks return a sum for each vector and links that join the same
    vectors, never one row for each link.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components: no links, component_id
    = vec_id. Vectors of different length don't link. Null vec_ids count for no component_id, and a row that has no other
    id in its component has a null one (kept). Repeated rows are copies that link. An empty table gives no row.
    """
    named, kind = _classes(vectors)
    named = written(named, "vectors")
    rows = named.select("vec_id", "node")
    classes = named.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("data").alias("data"))
    classes = written(classes, "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    n_lists = n_lists or 1024 << max(0, int(np.ceil(np.log2(max(1, largest) / 100_000))))
    per_vector = per_vector or (12 if n_lists <= 1024 else 16)
    lists = sorted_lists(classes, kind, n_lists, per_vector, seed)
    key = ["label", "dim", "list"]
    long = written(lists.groupBy(*key).count().where(F.col("count") > BLOCK).select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "long-lists")
    n_long = long.count()
    long = long.select(*(F.col(c).alias(f"_{c}") for c in key), "blocks")
    on = (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")) & (F.col("list") == F.col("_list"))
    cut = lists.join(F.broadcast(long) if n_long <= BROADCAST_ROWS else long, on, "left") if n_long else lists.withColumn("blocks", F.lit(None).cast("int"))
    cut = cut.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select(*LISTS_NAMES, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(table: pa.Table) -> pa.RecordBatch | None:
            number, i, j = (table.column(c)[0].as_py() for c in ("list", "i", "j"))
            side = np.array(table.column("block"))

            def block(which: int) -> dict:
                t = table.filter(pa.array(side == which))
                lists = np.stack([np.frombuffer(x, "<i4") for x in t.column("lists").to_pylist()])
                values = np.stack([np.frombuffer(x, "<f4") for x in t.column("values").to_pylist()]).astype(np.float64)
                return {"value": np.array(t.column("value"), dtype=np.float64), "lists": lists, "values": values, "bits": _bits(lists), "unit": unit_rows(t.column("data").to_pylist(), kind), "node": np.array(t.column("node")), "copies": np.array(t.column("copies"))}

            if not (side == i).any() or not (side == j).any():
                return None
            left = block(i)
            right = None if i == j else block(j)
            a, b = block_links(number, left, right, least, collisions)
            if not len(a):
                return None
            right = right or left
            x, y = left["node"][a], right["node"][b]
            one, at = np.unique(np.concatenate((x, y)), return_inverse=True)
            links = np.bincount(at, weights=np.concatenate((right["copies"][b], left["copies"][a]))).astype(np.int64)
            p, q = local_stars(x, y)
            n = len(one) + len(p)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((one, p))), pa.array(np.concatenate((one, q))), pa.array(np.concatenate((links, np.zeros(len(p), np.int64)))), pa.array(np.arange(n) >= len(one))], names=["a", "b", "links", "is_link"])

        last, parts = None, []
        for batch in batches:
            keys = [*zip(*(column_of(batch, c).to_pylist() for c in (*key, "i", "j")), strict=True)]
            start = 0
            for at in range(1, len(keys) + 1):
                if at == len(keys) or keys[at] != keys[start]:
                    if keys[start] != last:
                        if len(parts) and (out := group(pa.Table.from_batches(parts))):
                            yield out
                        last, parts = keys[start], []
                    parts.append(batch.slice(start, at - start))
                    start = at
        if parts and (out := group(pa.Table.from_batches(parts))):
            yield out

    dealt = cut.repartition(partitions_for(vectors), *key, "i", "j").sortWithinPartitions(*key, "i", "j")
    found = written(dealt.mapInArrow(run, "a long, b long, links long, is_link boolean"), "vector-links")
    sums = found.where("not is_link").groupBy("a").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("is_link").select("a", "b"))
    known = classes.select("node", "least_id", "copies").join(sums, F.col("node") == F.col("a"), "left").drop("a")
    known = known.join(groups.select(F.col("node").alias("g"), "component"), F.col("node") == F.col("g"), "left").select("node", "least_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root"))
    roots = known.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumnRenamed("root", "r")
    known = known.join(roots, F.col("root") == F.col("r")).select(F.col("node").alias("k"), "n_links", "component_id")
    out = rows.join(known, F.col("node") == F.col("k"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


LISTS_NAMES = [c.split()[0] for c in LISTS.split(", ")]

#: What op2_embedding_dedup gives, for DuckDB (all pairs of a label: for small tables).
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT c.vec_id, (SELECT count(*) FROM links WHERE a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""
