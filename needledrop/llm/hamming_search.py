"""Nearest neighbours by multi-index hashing: learned rotated binary codes, cut into substrings that are each indexed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needledrop.llm.common import column_of, mix, remove, written
from needledrop.llm.vectors import finite, matrix, usual_length

#: Bits of a code, and its substrings, each of which has an index of its own.
BITS, SUBSTRINGS = 64, 4
WIDTH = BITS // SUBSTRINGS
#: Vectors from which rotation and radii are learned, at most; their distances give each query its first bound.
SAMPLE = 4096
#: Vectors of an index that a task holds together, about.
ROWS = 4096
#: A radius holds this share of the pairs at a distance.
SURE = 0.98


class Codes:
    """Binary codes by rotations learned from a sample, and how far codes of vectors at some distance are apart."""

    def __init__(self, sample: np.ndarray, seed: int = 12):
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        self.scale = float(np.abs(sample).max()) or 1.0
        self.middle = (sample / self.scale).mean(axis=0)
        x = sample / self.scale - self.middle
        directions = np.linalg.eigh(x.T @ x)[1][:, ::-1]  # by falling variance
        turns: list[np.ndarray] = []
        while (left := BITS - sum(t.shape[1] for t in turns)) > 0:  # a short vector has several rotations
            base = directions[:, : min(dim, left)]
            turns.append(base @ self._rotation(x @ base, rng))
        self.turn = np.concatenate(turns, axis=1)
        self.reach = self._reach(x, rng)

    @staticmethod
    def _rotation(v: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
        """The rotation that brings v closest to corners of a cube: signs and rotation in turn."""
        r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
        for _ in range(rounds):
            a, _, b = np.linalg.svd(v.T @ np.where(v @ r > 0, 1.0, -1.0))
            r = a @ b
        return r

    def of(self, x: np.ndarray) -> np.ndarray:
        """The 64-bit code of each row of doubles."""
        with np.errstate(over="ignore"):
            return self._signs(np.clip(x / self.scale, -1e150, 1e150) - self.middle)

    def _signs(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.turn > 0, axis=1, bitorder="little").view("<u8").ravel()

    def _reach(self, x: np.ndarray, rng: np.random.Generator, pairs: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
        """Ascending distances, and the Hamming distance that holds SURE of the pairs up to each of them.

        Near pairs are rare in a sample: of half of the pairs one vector is turned towards the other as well.
        """
        i, j = rng.integers(0, len(x), (2, pairs))
        share = np.where(np.arange(pairs) % 2 == 0, 1.0, rng.random(pairs) ** 2)[:, None]
        length = np.sqrt((x * x).sum(axis=1))
        far, bits = np.empty(pairs), np.empty(pairs, np.int64)
        for at in range(0, pairs, 1 << 14):
            part = slice(at, at + (1 << 14))
            a, b = x[i[part]], x[i[part]] + share[part] * (x[j[part]] - x[i[part]])
            between = (1 - share[part, 0]) * length[i[part]] + share[part, 0] * length[j[part]]
            b *= (between / np.maximum(np.sqrt((b * b).sum(axis=1)), 1e-300))[:, None]
            far[part] = np.sqrt(((a - b) ** 2).sum(axis=1)) * self.scale
            bits[part] = np.bitwise_count(self._signs(a) ^ self._signs(b))
        order = np.argsort(far)
        lots = np.array_split(order, 200)
        most = np.maximum.accumulate([int(np.quantile(bits[lot], SURE, method="higher")) for lot in lots])
        return np.array([far[lot].max() for lot in lots]), most

    def radius(self, distance: np.ndarray) -> np.ndarray:
        """The Hamming radius that is to hold all vectors up to a distance; all bits beyond what the sample has."""
        ends, most = self.reach
        return np.append(most, BITS)[np.searchsorted(ends, distance)]


def substrings(codes: np.ndarray) -> np.ndarray:
    """The substrings of each code, as columns."""
    return np.stack([(codes >> np.uint64(j * WIDTH)) & np.uint64((1 << WIDTH) - 1) for j in range(SUBSTRINGS)], axis=1).astype(np.int64)


def radius_of(substring: int, radius: int) -> int:
    """Within which radius a substring has to be probed, so that every code within `radius` is met in some substring.

    If all of the first b + 1 substrings differed in more than a places and the others in a or more, with
    radius = SUBSTRINGS * a + b, the codes would differ in more than radius. -1: not at all.
    """
    a, b = divmod(radius, SUBSTRINGS)
    return a if substring <= b else a - 1


_masks: dict[int, np.ndarray] = {}


def ball(radius: int) -> np.ndarray:
    """All substrings with at most radius bits set."""
    if radius not in _masks:
        every = np.arange(1 << WIDTH)
        _masks[radius] = every[np.bitwise_count(every) <= radius]
    return _masks[radius]


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The Euclidean distance of each row of x to y in doubles, of numbers of any size."""
    with np.errstate(over="ignore", under="ignore"):
        d = x - y
        out = np.sqrt((d * d).sum(axis=1))
        odd = ~np.isfinite(out) | (out < 1e-140)
        if odd.any():  # squares over- or underflow
            most = np.abs(d[odd]).max(axis=1)
            safe = np.where((most > 0) & np.isfinite(most), most, 1.0)
            out[odd] = safe * np.sqrt(((d[odd] / safe[:, None]) ** 2).sum(axis=1))
    return out


class Bucketed:
    """The index of one substring in a task: the codes by the value of their substring."""

    def __init__(self, substring: int, codes: np.ndarray, vectors: np.ndarray):
        own = substrings(codes)[:, substring]
        self.order = np.argsort(own, kind="stable")
        self.substring, self.codes, self.vectors = substring, codes[self.order], vectors
        self.values, self.starts = np.unique(own[self.order], return_index=True)
        self.stops = np.append(self.starts[1:], len(own))

    def within(self, code: int, radius: int) -> np.ndarray:
        """Places of the codes within the radius that no earlier substring meets: probes, then the whole code."""
        near = radius_of(self.substring, radius)
        if near < 0:
            return np.zeros(0, np.int64)
        own = int(code) >> (self.substring * WIDTH) & ((1 << WIDTH) - 1)
        if sum(comb(WIDTH, k) for k in range(min(near, WIDTH) + 1)) < len(self.values):  # look up each value of the ball
            probes = ball(near) ^ own
            at = np.minimum(np.searchsorted(self.values, probes), len(self.values) - 1)
            at = np.sort(at[self.values[at] == probes])
        else:  # fewer values are there than in the ball
            at = np.flatnonzero(np.bitwise_count(self.values ^ own) <= near)
        sizes = self.stops[at] - self.starts[at]
        found = np.arange(sizes.sum()) + np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes)
        off = self.codes[found] ^ np.uint64(code)
        keep = np.bitwise_count(off) <= radius
        for j in range(self.substring):  # an earlier substring has met it
            keep &= np.bitwise_count((off >> np.uint64(j * WIDTH)) & np.uint64((1 << WIDTH) - 1)) > radius_of(j, radius)
        return self.order[found[keep]]


ENTRY = "substring int, lead int, block int, is_query boolean, node long, code long, radius int, data binary, ids array<long>"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]
FOUND = "query long, score double, ids array<long>"


def _index(classes: DataFrame, lead: int, blocks: np.ndarray) -> DataFrame:
    """Every vector once for each substring, under the substring's leading bits and a block of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, code = batch.num_rows, np.array(column_of(batch, "node")), np.array(column_of(batch, "code"))
            leads = substrings(code.view(np.uint64)) >> (WIDTH - lead)
            for j in range(SUBSTRINGS if n else 0):
                block = mix(node.view(np.uint64)) % blocks[j][leads[:, j]].astype(np.uint64)
                key = [np.full(n, j, np.int32), leads[:, j].astype(np.int32), block.astype(np.int32), np.zeros(n, bool)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, key), column_of(batch, "node"), column_of(batch, "code"), pa.array(np.zeros(n, np.int32)), column_of(batch, "data"), column_of(batch, "ids")], names=NAMES)

    return classes.select("node", "code", "data", "ids").mapInArrow(run, ENTRY)


def _probes(queries: DataFrame, lead: int, blocks: np.ndarray) -> DataFrame:
    """Every query (node, code, radius, data) in all blocks whose leading bits a probe within its radius can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads = np.arange(1 << lead)
        for batch in batches:
            node, code, radius = (np.array(column_of(batch, c)) for c in ("node", "code", "radius"))
            parts = substrings(code.view(np.uint64)) if len(code) else np.zeros((0, SUBSTRINGS), np.int64)
            for q in range(len(code)):
                keys = []
                for j in range(SUBSTRINGS):
                    near = radius_of(j, int(radius[q]))
                    there = leads[(np.bitwise_count(leads ^ (parts[q, j] >> (WIDTH - lead))) <= near) & (blocks[j] > 0)] if near >= 0 else leads[:0]
                    n = blocks[j][there]
                    keys.append(np.stack((np.full(n.sum(), j), np.repeat(there, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))))
                keys = np.concatenate(keys, axis=1).astype(np.int32)
                for at in range(0, keys.shape[1], 4096):
                    some = keys[:, at : at + 4096]
                    n = some.shape[1]
                    same = pa.array(np.full(n, q))
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, some), pa.array(np.ones(n, bool)), pa.array(np.full(n, node[q])), pa.array(np.full(n, code[q])), pa.array(np.full(n, radius[q], np.int32)), column_of(batch, "data").take(same), pa.nulls(n, pa.list_(pa.int64()))],
                        names=NAMES,
                    )

    return queries.select("node", "code", "radius", "data").mapInArrow(run, ENTRY)


def _searched(entries: DataFrame, kind: str, most: int) -> DataFrame:
    """For each query of a block the classes that hold its first `most` rows among the codes within its radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index, ids = None, [], None, None
        for batch in batches:
            keys = [*zip(*(column_of(batch, c).to_pylist() for c in ("substring", "lead", "block", "is_query")), strict=True)]
            start = 0
            for key, run_of in groupby(keys):
                part, start = batch.slice(start, n := sum(1 for _ in run_of)), start + n
                if key[:3] != now:
                    now, held, index = key[:3], [], None
                if not key[3]:
                    held.append(part)
                    continue
                if not held and index is None:
                    continue
                if index is None:  # the block's vectors come before its queries
                    table = pa.Table.from_batches(held).combine_chunks()
                    index, held = Bucketed(key[0], np.array(table.column("code")).view(np.uint64), matrix(table.column("data").chunk(0), kind)), []
                    ids = table.column("ids").chunk(0)
                    least = np.array(pc.list_element(ids, 0).fill_null(2**63 - 1))
                x, codes = matrix(column_of(part, "data"), kind), np.array(column_of(part, "code")).view(np.uint64)
                queries, scores, rows = [], [], []
                for q, node, radius in zip(range(len(x)), column_of(part, "node").to_pylist(), column_of(part, "radius").to_pylist(), strict=True):
                    at = index.within(codes[q], radius)
                    if len(at):
                        far = distance(index.vectors[at], x[q])
                        if len(at) > most:
                            bar = np.partition(far, most - 1)[most - 1]
                            at, far = at[far <= bar], far[far <= bar]
                        best = np.lexsort((least[at], far))[:most]
                        queries += [node] * len(best)
                        scores.append(far[best])
                        rows.append(at[best])
                if queries:
                    yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(np.concatenate(scores)), ids.take(pa.array(np.concatenate(rows)))], names=["query", "score", "ids"])

    key = ["substring", "lead", "block"]
    return entries.repartition(*key).sortWithinPartitions(*key, "is_query").mapInArrow(run, FOUND)


def _best(found: DataFrame, most: int) -> DataFrame:
    """query, near: the first `most` rows (score, vec_id) of each query, ties by vec_id, rows without vec_id last."""
    first = lambda *by: Window.partitionBy("query").orderBy(*by)
    least = F.get("ids", F.lit(0))
    classes = found.withColumn("_n", F.row_number().over(first("score", least.asc_nulls_last()))).where(F.col("_n") <= most)
    rows = classes.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("_n", F.row_number().over(first("score", F.col("vec_id").asc_nulls_last()))).where(F.col("_n") <= most)
    return rows.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "score", "vec_id"))), lambda r: F.struct(r["score"].alias("score"), r["vec_id"].alias("vec_id"))).alias("near"))


def nearest(vectors: DataFrame, wanted: Column, k: int = 10, first_radius: int = 2 * SUBSTRINGS - 1, seed: int = 12) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every row of vectors (vec_id, embedding) for which wanted holds.

    Every vector has a code of 64 bits: signs after rotations learned from a sample of up to SAMPLE vectors (those with
    the smallest hashes; the principal directions, then a rotation towards the corners of a cube). The code's four
    substrings are each an index over all vectors. A code within r of a query's is, in some substring, within about r / 4
    (see radius_of): the query probes these values in every index and gets every code within r, each once; these are ranked
    by the distance of the vectors themselves. The sample also tells within which r nearly all pairs (SURE) at some
    distance are. A query's k-th distance so far (at first: in the sample) bounds that of its k-th nearest, so the bound
    gives its radius: queries that need more than first_radius search with that first, which lowers the bound, then once
    more with the radius that they need. The radius isn't capped: a query that the sample says nothing about searches all.
    On vectors without any structure the radius, and with it the work for a query, is a large part of all.

    Equal vectors are one class, with the k + 1 smallest of its ids, for no others can be among a query's first k; each
    distinct vector searches once for all its queries. A block holds about ROWS vectors with the same leading bits of a
    substring; frequent ones are dealt to several blocks by hash, and each is searched.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of another than the
    most frequent length. Repeated rows are candidates of each other. Rows without vec_id come last among equally near ones and
    ask nothing. An empty table gives no row. Extra columns are ignored. A distance beyond the largest double is infinite.
    """
    spark = vectors.sparkSession
    rows, kind = finite(vectors, F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(wanted, F.lit(False)).alias("asks"), zeros=False)
    rows = written(rows.withColumns({"node": F.xxhash64("data"), "twin": F.xxhash64(F.lit(seed), "data")}), "search-vectors")
    width = usual_length(rows)
    rows_of_width = rows.where(F.octet_length("data") == width)
    asking = written(rows_of_width.where("asks and vec_id is not null").select("vec_id", "node", "twin"), "search-queries")
    low = Window.partitionBy("node", "twin").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows_of_width.withColumn("_n", F.row_number().over(low)).where(F.col("_n") <= k + 1)
    ids = F.transform(F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("no"), "vec_id"))), lambda x: x["vec_id"])
    plain = written(few.groupBy("node", "twin").agg(F.first("data").alias("data"), ids.alias("ids")), "search-classes")
    remove(rows)
    n = plain.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ticket = F.xxhash64("node", F.lit(seed))
    share = F.lit(min(int(2**64 * min(1.0, 2 * SAMPLE / n)), 2**64 - 1) - 2**63)
    sample = plain.where(ticket <= share).orderBy(ticket, "node").select("data").limit(SAMPLE).collect()
    sample = np.stack([np.frombuffer(r["data"], kind) for r in sample]).astype(np.float64)
    codes = Codes(sample, seed)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("code", pa.array(codes.of(matrix(column_of(batch, "data"), kind)).view(np.int64)))

    classes = written(plain.mapInArrow(coded, "node long, twin long, data binary, ids array<long>, code long"), "search-index")
    remove(plain)
    lead = min(WIDTH, max(0, int(np.ceil(np.log2(n / ROWS)))))
    blocks = np.zeros((SUBSTRINGS, 1 << lead), np.int64)
    value = lambda j: F.shiftright(F.shiftrightunsigned("code", j * WIDTH).bitwiseAND((1 << WIDTH) - 1), WIDTH - lead)
    each = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), value(j).alias("lead")) for j in range(SUBSTRINGS))))
    for r in classes.select(each.alias("e")).groupBy("e.j", "e.lead").count().collect():  # at most SUBSTRINGS * 2**WIDTH rows
        blocks[r["j"], r["lead"]] = max(1, round(r["count"] / ROWS))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(column_of(batch, "data"), kind)
                bound = np.array([np.partition(distance(sample, y), k)[k] if len(sample) > k else np.inf for y in x])
                yield batch.append_column("bound", pa.array(bound)).append_column("need", pa.array(codes.radius(bound).astype(np.int32)))

    distinct = asking.select("node", "twin").distinct()
    queries = distinct.join(classes, ["node", "twin"]).select("node", "twin", "code", "data").mapInArrow(bounded, "node long, twin long, code long, data binary, bound double, need int")
    queries = written(queries, "search-bounds")

    def search(some: DataFrame) -> DataFrame:
        return written(_best(_searched(_index(classes, lead, blocks).unionByName(_probes(some, lead, blocks)), kind, k + 1), k + 1), "search-found")

    near = search(queries.withColumn("radius", F.least("need", F.lit(first_radius))))
    tighter = F.get("near", F.lit(k))["score"]

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("radius", pa.array(codes.radius(np.array(column_of(batch, "bound"))).astype(np.int32)))

    wide = queries.where(F.col("need") > first_radius).join(near.select(F.col("query").alias("node"), tighter.alias("_t")), "node", "left")
    wide = wide.select("node", "code", "data", F.least("bound", "_t").alias("bound")).mapInArrow(needs, "node long, code long, data binary, bound double, radius int")
    wide = written(wide.where(F.col("radius") > first_radius), "search-wide")
    if wide.limit(1).count():
        first, second = near, search(wide)
        near = second.unionByName(first.join(second.select("query"), "query", "left_anti"))
    for used in (classes, queries, wide):
        remove(used)
    own = F.array_position("near", F.struct(F.lit(0.0).alias("score"), F.col("query_id").alias("vec_id")))
    answers = asking.select(F.col("vec_id").alias("query_id"), "node").join(near.withColumnRenamed("query", "node"), "node")
    others = F.slice(F.filter("near", lambda _, i: i + 1 != F.col("_own")), 1, k)
    answers = answers.withColumn("_own", own).select("query_id", F.posexplode(others).alias("_rank", "_row"))
    return answers.select("query_id", (F.col("_rank") + 1).cast("int").alias("rank"), F.col("_row.vec_id").alias("vec_id"), F.col("_row.score").alias("score"))
