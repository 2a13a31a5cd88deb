"""Vector code compression: codebooks of vector parts by Lloyd's rounds that filter entries down kd-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import NULL_ID, column_of, pack, remove, unpack, written
from needledrop.llm.vectors import LARGEST, SUMS, as_long, finite, floors, largest, matrix, means, narrowed, per_task, smallest, summed, total_long, usual_length

#: Vectors of a task that share trees: one tree for each part.
CHUNK = 16_384
#: Points of a tree's leaf, at most.
LEAF = 16
#: Pairs of a node and an entry that are tested at a time.
PAIRS = 1 << 16
#: Labels whose sums are broadcast, at most.
BROADCAST_ROWS = 100_000


class Tree:
    """A balanced kd-tree over points (whole numbers): boxes, sums and counts of every node, level by level.

    Node i of level l has the points from i * n >> l to (i + 1) * n >> l, in the tree's order; its children are 2 i and 2 i + 1.
    """

    def __init__(self, order: np.ndarray, points: np.ndarray, boxes: list[tuple[np.ndarray, np.ndarray]], sums: list[np.ndarray]):
        self.order, self.points, self.boxes, self.sums = order, points, boxes, sums

    @staticmethod
    def bounds(n: int, level: int) -> np.ndarray:
        return np.arange((1 << level) + 1) * n >> level

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        """Every node is cut at the median of the widest side of its box."""
        n, order = len(points), np.arange(len(points))
        depth = max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))
        for level in range(depth):
            ends = cls.bounds(n, level)
            now = points[order]
            widest = (np.maximum.reduceat(now, ends[:-1], axis=0) - np.minimum.reduceat(now, ends[:-1], axis=0)).argmax(axis=1)
            node = np.repeat(np.arange(1 << level), np.diff(ends))
            order = order[np.lexsort((now[np.arange(n), widest[node]], node))]
        now, boxes, sums = points[order], [], []
        for level in range(depth + 1):
            starts = cls.bounds(n, level)[:-1]
            boxes.append((np.minimum.reduceat(now, starts, axis=0), np.maximum.reduceat(now, starts, axis=0)))
            sums.append(np.add.reduceat(now, starts, axis=0))
        return cls(order, now, boxes, sums)

    def filtered(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's nearest entry (in the tree's order; the lowest of equally near ones), and sums and count of each entry.

        A node's candidates are its parent's. The candidate nearest to the middle of the box drops every other one that is
        farther from all of the box: the difference of two squared distances is linear in the point, so it is least at a
        corner of the box, and if it isn't negative there (above 0, or 0 for a higher number), the box can't choose that
        candidate. A node with one candidate is assigned as a whole, by its cached sums; leaves compare their points.
        """
        n, (k, dim) = len(self.points), entries.shape
        # Whole numbers in doubles are exact up to 2^53, in longs up to 2^63; beyond that Python's own.
        size = dim * (4 * max(largest(self.points), largest(entries))) ** 2
        kind = np.float64 if size < 2**53 else np.int64 if size < 2**62 else object
        z, points, far = entries.astype(kind), self.points.astype(kind), {np.float64: np.inf, np.int64: LARGEST, object: float("inf")}[kind]
        square = (z * z).sum(axis=1)
        chosen, totals = np.empty(n, np.int64), np.zeros((k, dim + 1), dtype=object)
        nodes, candidates, depth = np.zeros(1, np.int64), np.ones((1, k), bool), len(self.boxes) - 1
        for level in range(depth + 1):
            ends = self.bounds(n, level)
            low, high = (b[nodes].astype(kind) for b in self.boxes[level])
            middle = np.where(candidates, square - (low + high) @ z.T, far).argmin(axis=1)
            kept = candidates.copy()
            i, j = np.nonzero(candidates)
            for at in range(0, len(i), PAIRS):
                a, b = i[at : at + PAIRS], j[at : at + PAIRS]
                m = middle[a]
                way = z[b] - z[m]
                least = square[b] - square[m] - 2 * (np.where(way > 0, high[a], low[a]) * way).sum(axis=1)
                kept[a, b] = (least < 0) | ((least == 0) & (b <= m))
            only = kept.sum(axis=1) == 1
            whole = nodes[only]
            entry = kept[only].argmax(axis=1)
            np.add.at(totals[:, :dim], entry, self.sums[level][whole])
            np.add.at(totals[:, dim], entry, np.diff(ends)[whole])
            chosen[_ranges(ends[whole], ends[whole + 1])] = np.repeat(entry, np.diff(ends)[whole])
            nodes, candidates = nodes[~only], kept[~only]
            if level < depth:
                nodes, candidates = np.stack((2 * nodes, 2 * nodes + 1), axis=1).ravel(), np.repeat(candidates, 2, axis=0)
        ends = self.bounds(n, depth)
        for at in range(0, len(nodes), max(1, 16 * PAIRS // (k * LEAF))):
            some, allowed = nodes[at : at + max(1, 16 * PAIRS // (k * LEAF))], candidates[at : at + max(1, 16 * PAIRS // (k * LEAF))]
            own = _ranges(ends[some], ends[some + 1])
            allowed = np.repeat(allowed, np.diff(ends)[some], axis=0)
            entry = np.where(allowed, square - 2 * (points[own] @ z.T), far).argmin(axis=1)
            chosen[own] = entry
            np.add.at(totals[:, :dim], entry, self.points[own])
            np.add.at(totals[:, dim], entry, 1)
        return chosen, totals

    def packed(self) -> bytes:
        """The tree as bytes; numbers beyond 32 bits as text."""
        arrays = [self.order, self.points, *(x for pair in self.boxes for x in pair), *self.sums]
        flat = [x if x.dtype != object else np.array([str(v) for v in x.ravel()], dtype="S").reshape(x.shape) for x in arrays]
        flat = [x.astype("<i4") if x.dtype == np.int64 and largest(x) < 2**31 else x for x in flat]
        head = repr([(x.dtype.str, x.shape) for x in flat]).encode()
        return len(head).to_bytes(4, "little") + head + pack(np.frombuffer(b"".join(x.tobytes() for x in flat), np.uint8))

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        from ast import literal_eval

        size = int.from_bytes(data[:4], "little")
        body, at, arrays = unpack(data[4 + size :], "u1"), 0, []
        for kind, shape in literal_eval(data[4 : 4 + size].decode()):
            n = int(np.prod(shape)) * np.dtype(kind).itemsize
            x = np.frombuffer(body[at : at + n].tobytes(), kind).reshape(shape)
            arrays.append(np.array([int(v) for v in x.ravel()], dtype=object).reshape(shape) if x.dtype.kind == "S" else x.astype(np.int64))
            at += n
        levels = (len(arrays) - 2) // 3
        return cls(arrays[0], arrays[1], [*zip(arrays[2 : 2 + 2 * levels : 2], arrays[3 : 2 + 2 * levels : 2], strict=True)], arrays[2 + 2 * levels :])


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    sizes = stops - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


TREES = "vec_ids array<long>, labels array<string>, trees array<binary>"


def trees(rows: DataFrame, kind: str, parts: int, scale: int) -> DataFrame:
    """A row for each lot of CHUNK vectors of a task: their ids and labels, and the tree over each of their parts."""

    def lot(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        x = floors(matrix(table.column("data").chunk(0), kind), scale)
        grown = [Tree.build(part).packed() for part in np.split(x, parts, axis=1)]
        columns = [pa.array([table.column(c).to_pylist()], pa.list_(t)) for c, t in (("vec_id", pa.int64()), ("label", pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([grown], pa.list_(pa.binary()))], names=["vec_ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                some = batch.slice(start, CHUNK - n)
                held, n, start = [*held, some], n + some.num_rows, start + some.num_rows
                if n == CHUNK:
                    yield lot(held)
                    held, n = [], 0
        if n:
            yield lot(held)

    return rows.mapInArrow(run, TREES)


def _with_label_sums(found: DataFrame) -> DataFrame:
    """found (vec_id, label, code, error) with label_error. Sums of few labels are broadcast; else those of frequent labels
    are (there can't be many), and the other labels, none of which has many rows, meet theirs in a join.
    """
    sums = found.groupBy("label").agg(total_long("error").alias("label_error"), F.count("*").alias("_n"))
    sums = written(sums.withColumnRenamed("label", "_label"), "label-sums")
    count = sums.agg(F.count("*").alias("labels"), F.sum("_n").alias("rows")).first()
    same = F.col("label").eqNullSafe(F.col("_label"))
    if count["labels"] <= BROADCAST_ROWS:
        return found.join(F.broadcast(sums), same).select("vec_id", "code", "error", "label_error")
    often = F.col("_n") > F.lit(count["rows"] / BROADCAST_ROWS)  # fewer than BROADCAST_ROWS labels can be
    marked = found.join(F.broadcast(sums.where(often)), same, "left")
    hot = marked.where("_n is not null").select("vec_id", "code", "error", "label_error")
    rest = marked.where("_n is null").select("vec_id", "label", "code", "error")
    return hot.unionByName(rest.join(sums.where(~often).hint("merge"), same).select("vec_id", "code", "error", "label_error"))


def compressed(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector of finite components (vec_id, embedding, label).

    Components become floor(scale * x), exact whatever their size; vectors are cut into equal consecutive parts. The
    codebook of a part starts as that part of the vectors of the smallest vec_ids; each round assigns every part to its
    nearest entry (ties: the lower index) and moves the entries to the floors of their means. Each task grows kd-trees
    over its vectors' parts once, CHUNK vectors at a time; all rounds run down these trees. A task returns one exact sum
    for each entry and component; the driver holds the codebooks and nothing that grows with the input.

    Vectors that are null, empty or hold null or non-finite components are left out. Vectors of another than the most
    frequent length can't share its codebooks: they have null code and error and count for no sum; a length that can't be
    cut equally gives all of them null. Rows with the same vec_id are vectors of their own (as entries in the order of
    their bytes, those without vec_id last). Fewer vectors than entries: as many entries. An empty table gives no row.
    Extra columns are ignored. Null labels count as one label. Sums beyond the largest long are shown as the largest long.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits for each part")
    rows, kind = finite(vectors, F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"))
    rows = written(rows, "code-vectors")
    width = usual_length(rows)
    dim = width // np.dtype(kind).itemsize
    other = F.octet_length("data") != width if dim % parts == 0 else F.lit(True)
    odd = rows.where(other).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    usual = rows.where(~other)
    starts = smallest(usual, F.coalesce("vec_id", F.lit(NULL_ID)), entries)
    schema = "vec_id long, label string, code string, error long"
    books: list[np.ndarray] = []
    found = vectors.sparkSession.createDataFrame([], schema)
    if starts:
        first = floors(np.stack([np.frombuffer(x, kind) for x in starts]).astype(np.float64), scale)
        books, k, size = np.split(first, parts, axis=1), len(first), dim // parts
        shape = (parts * k, size + 1)
        grown = written(trees(usual, kind, parts, scale), "code-trees")

        def sums(batch: pa.RecordBatch, now: list[np.ndarray]) -> np.ndarray:
            total = np.zeros(shape, dtype=object)
            for lot in column_of(batch, "trees"):
                total = total + np.concatenate([Tree.unpacked(t.as_py()).filtered(z)[1] for t, z in zip(lot.values, now, strict=True)])
            return total

        for _ in range(rounds):
            now = [*map(narrowed, books)]
            totals = summed(grown.select("trees").mapInArrow(per_task(lambda batch, now=now: sums(batch, now), shape), SUMS), shape)
            books = [means(z, t) for z, t in zip(books, np.split(totals, parts), strict=True)]
        final = [*map(narrowed, books)]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, labels, lot in zip(*(column_of(batch, c) for c in ("vec_ids", "labels", "trees")), strict=True):
                    codes, error = np.empty((len(ids.values), parts), np.uint8), np.zeros(len(ids.values), dtype=object)
                    for p, (data, z) in enumerate(zip(lot.values, final, strict=True)):
                        tree = Tree.unpacked(data.as_py())
                        chosen, _ = tree.filtered(z)
                        codes[tree.order, p] = chosen
                        wide = tree.points.dtype == object or z.dtype == object or size * (2 * max(largest(tree.points), largest(z))) ** 2 >= 2**62
                        off = tree.points.astype(object if wide else np.int64) - z.astype(object if wide else np.int64)[chosen]
                        error[tree.order] += (off * off).sum(axis=1)
                    names = pa.array([row.tobytes().hex() for row in codes])
                    yield pa.RecordBatch.from_arrays([ids.values, labels.values, names, pa.array(as_long(error))], names=["vec_id", "label", "code", "error"])

        found = written(grown.mapInArrow(assign, schema), "codes")
        remove(grown)
    digest = hashlib.sha256(",".join(str(v) for z in books for row in z.tolist() for v in row).encode()).hexdigest()
    return _with_label_sums(found.unionByName(odd)).withColumn("codebooks_sha256", F.lit(digest))


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """What op13 gives, for DuckDB: all distances of every round."""
    far = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS BIGINT)))"
    with_parts = [
        "w AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e"
        " FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "r AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM w)",
        f"v AS MATERIALIZED (SELECT r, vec_id, label, p, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] AS q FROM r, range({parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r AS c, q FROM v WHERE r < {entries})",
    ]
    for i in range(rounds + 1):
        with_parts.append(
            f"a{i} AS MATERIALIZED (SELECT v.r, v.p, any_value(v.q) AS q, min(struct_pack(d := CAST({far} AS BIGINT), c := c.c)) AS m FROM v JOIN c{i} c ON v.p = c.p GROUP BY v.r, v.p)"
        )
        if i < rounds:
            with_parts.append(f"s{i} AS (SELECT p, c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, m.c AS c, unnest(range(1, len(q) + 1)) AS i, unnest(q) AS x FROM a{i}) GROUP BY p, c, i)")
            with_parts.append(f"m{i} AS (SELECT p, c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{i} GROUP BY p, c)")
            with_parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.p, c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON c.p = m.p AND c.c = m.c)")
    return f"""WITH {", ".join(with_parts)},
o AS (SELECT r, string_agg(printf('%02x', CAST(m.c AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, c)) FROM c{rounds}) AS codebooks_sha256
FROM o JOIN r ON o.r = r.r"""


SQL = _sql()
