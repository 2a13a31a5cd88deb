"""Clusters, codebooks and nearest neighbours of vectors against brute force in whole numbers and doubles."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from compare import assert_same, connection
from pyspark.sql import functions as F

from needledrop.llm import clustering, codebooks, hamming_search, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, data string, ids string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, *["x"] * 3)[:6] for r in rows], schema)


def is_finite(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def floor_all(v, scale):
    from fractions import Fraction

    return [math.floor(Fraction(x) * scale) for x in v]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest_of(x, c):
    return min(range(len(c)), key=lambda k: (square(x, c[k]), k))


def moved(c, groups):
    return [[sum(x) // len(g) for x in zip(*g, strict=True)] if (g := groups.get(k)) else z for k, z in enumerate(c)]


def long(x):
    return min(x, 2**63 - 1)


def brute_clusters(rows, k=16, rounds=3, dim=64, scale=64):
    kept = [(i, floor_all(v, scale), v) for i, v in rows if is_finite(v) and len(v) == dim]
    ticket = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    c = [x for _, x, _ in sorted(kept, key=lambda r: (*ticket(r[0]), np.array(r[2]).tobytes()))[:k]]
    for _ in range(rounds):
        groups = {}
        for _, x, _ in kept:
            groups.setdefault(nearest_of(x, c), []).append(x)
        c = moved(c, groups)
    out = [(i, k := nearest_of(x, c), square(x, c[k])) for i, x, _ in kept]
    inertia = lambda k: long(sum(long(d) for _, j, d in out if k in (j, None)))
    digest = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in c]
    return sorted(((i, k, long(d), inertia(k), inertia(None), digest[k]) for i, k, d in out), key=repr)


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, floor_all(v, scale), label, v) for i, v, label in rows if is_finite(v)]
    size = len(kept[0][1]) // parts
    part = lambda x, p: x[p * size : (p + 1) * size]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[3]).tobytes()))[:entries]
    books = [[part(r[1], p) for r in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in kept:
                groups.setdefault(nearest_of(part(r[1], p), books[p]), []).append(part(r[1], p))
            books[p] = moved(books[p], groups)
    out = []
    for i, x, label, _ in kept:
        code = [nearest_of(part(x, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for k in code), long(sum(square(part(x, p), books[p][code[p]]) for p in range(parts)))))
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(v) for b in books for z in b for v in z).encode()).hexdigest()
    return sorted(((i, code, error, long(sums[label]), digest) for i, label, code, error in out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def odd_rows(dim):
    """Rows that are left out, whatever the operator."""
    good = [0.25] * dim
    return [(900, None, 1), (901, [], 1), (902, [*good[1:], None], 1), (903, [*good[1:], float("nan")], 2), (904, [*good[1:], float("inf")], None)]


@pytest.mark.parametrize("query", ["op11", "op13"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_against_sql(spark, query, sf):
    run, sql = {"op11": (clustering.clusters, clustering.SQL), "op13": (codebooks.compressed, codebooks.SQL)}[query]
    assert_same(run(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")), connection(f"/root/testdata/{sf}"), sql)


def test_clusters_with_ties_copies_and_odd_rows(spark):
    random.seed(5)
    rows = [(i, [random.choice([-0.5, 0.0, 0.25]) if j < 4 else 0.0 for j in range(64)], 1) for i in range(90)]
    rows += rows[:9] + [(5, rows[7][1], 1), (None, rows[3][1], 1), (None, [0.125] * 64, 1)] + [(1000 + i, rows[11][1], 2) for i in range(60)]
    df = table(spark, [*rows, *odd_rows(64), (910, [0.5] * 63, 1)]).repartition(5)
    assert rows_of(clustering.clusters(df)) == brute_clusters([r[:2] for r in rows])
    few = rows[:3]
    assert rows_of(clustering.clusters(table(spark, few))) == brute_clusters([r[:2] for r in few])
    assert clustering.clusters(table(spark, odd_rows(64))).collect() == []
    assert clustering.clusters(table(spark, [])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_of_numbers_of_any_size(spark):
    random.seed(6)
    sizes = [1e-310, 1.0, 1e6, 3e9, 1e18, 1e300, 1.7e308]
    rows = [(i, [random.uniform(-1, 1) * sizes[(i + j) % 7 if i % 2 else i % 7] for j in range(6)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert rows_of(clustering.clusters(df, k=5, dim=6)) == brute_clusters(rows, k=5, dim=6)


@pytest.mark.parametrize(("dim", "size"), [(64, 40), (64, 2**26), (7, 2**28), (768, 2**20), (3, 2)])
def test_intervals_hold_the_exact_value(dim, size):
    rng = np.random.default_rng(dim)
    x, c = rng.integers(-size, size, (300, dim)), rng.integers(-size, size, (40, dim))
    low, high = clustering.intervals(x, c)
    exact = ((x.astype(object)[:, None, :] - c.astype(object)[None]) ** 2).sum(axis=2) - (x.astype(object) ** 2).sum(axis=1)[:, None]
    assert (low.astype(object) <= exact).all() and (exact <= high.astype(object)).all()
    best = [min(range(40), key=lambda k: (row[k], k)) for row in exact.tolist()]
    assert clustering.nearest(x, c).tolist() == best
    near = np.concatenate((c, c + rng.integers(-1, 2, c.shape)))  # hardly to be told apart in float32
    assert clustering.nearest(x, near).tolist() == clustering.exactly_nearest(x.astype(object), near.astype(object)).tolist()


def test_exact_sums():
    for values in ([[0, 1, -1], [2**47, -(2**48), 5]], [[2**200, -(2**300) + 7, -1], [2**48, -(2**48) - 1, 0]]):
        x, out = np.array(values, dtype=object), np.zeros((2, 3), dtype=object)
        for batch in vectors.sum_rows(x):
            for r in batch.to_pylist():
                out[r["entry"], r["place"]] += r["total"] << (vectors.DIGIT * r["digit"])
        assert out.tolist() == values


@pytest.mark.parametrize(("n", "dim", "k", "size"), [(1, 4, 3, 5), (17, 2, 9, 3), (700, 3, 40, 4), (3000, 16, 256, 500), (900, 2, 200, 2**29), (120, 3, 9, 2**70)])
def test_filtering_equals_all_distances(n, dim, k, size):
    random.seed(n)
    draw = lambda m: np.array([[random.randint(-size, size) for _ in range(dim)] for _ in range(m)], dtype=np.int64 if size < 2**60 else object)
    points, entries = draw(n), draw(k)
    tree = codebooks.Tree.unpacked(codebooks.Tree.build(points).packed())
    chosen, totals = tree.filtered(entries)
    best = clustering.exactly_nearest(points.astype(object), entries.astype(object))
    assert chosen.tolist() == best[tree.order].tolist()
    for j in range(k):
        assert totals[j].tolist() == [*points[best == j].astype(object).sum(axis=0).tolist(), int((best == j).sum())] or not (best == j).any() and not totals[j].any()


def test_whole_subtrees_are_assigned_without_a_look_at_their_points():
    rng = np.random.default_rng(1)
    middles = rng.integers(-(10**6), 10**6, (20, 4))
    points = (middles[:, None, :] + rng.integers(-50, 50, (20, 200, 4))).reshape(-1, 4)
    tree = codebooks.Tree.build(points)
    best = clustering.exactly_nearest(points.astype(object), middles.astype(object))[tree.order]
    tree.points = np.zeros_like(tree.points)  # leaves would now compare the wrong points
    chosen, _ = tree.filtered(middles)
    assert (chosen == best).mean() > 0.9


def test_codes_with_ties_copies_and_odd_rows(spark):
    random.seed(8)
    rows = [(i, [random.choice([-0.5, 0.0, 0.25, 0.2501]) for _ in range(8)], random.choice([None, 1, 2])) for i in range(120)]
    rows += [*rows[:9], (5, rows[7][1], 1), (None, rows[3][1], None)] + [(1000 + i, rows[11][1], 7) for i in range(60)]
    df = table(spark, [*rows, *odd_rows(8)]).repartition(5)
    assert rows_of(codebooks.compressed(df, entries=12)) == brute_codes(rows, entries=12)
    assert rows_of(codebooks.compressed(table(spark, rows[:3]))) == brute_codes(rows[:3])
    assert codebooks.compressed(table(spark, [])).collect() == codebooks.compressed(table(spark, odd_rows(8))).collect() == []
    odd = {r["vec_id"]: r for r in codebooks.compressed(table(spark, [*rows[:5], (77, [1.0] * 12, 1)])).collect()}
    assert (odd[77]["code"], odd[77]["error"]) == (None, None) and odd[0]["code"] is not None
    assert {r["code"] for r in codebooks.compressed(table(spark, [(1, [1.0] * 6, 1), (2, [2.0] * 6, 1)])).collect()} == {None}


def test_codes_of_numbers_of_any_size(spark):
    random.seed(9)
    sizes = [1e-310, 1.0, 1e6, 3e9, 1e18, 1e300, 1.7e308]
    rows = [(i, [random.uniform(-1, 1) * sizes[i % 7] for _ in range(8)], i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert rows_of(codebooks.compressed(df, entries=6, rounds=2)) == brute_codes(rows, entries=6, rounds=2)


def test_label_sums_of_many_labels(spark, monkeypatch):
    random.seed(10)
    rows = [(i, [random.random() for _ in range(8)], random.choice([None, 1, 1, 1, *range(2, 30)])) for i in range(200)]
    monkeypatch.setattr(codebooks, "BROADCAST_ROWS", 10)
    assert rows_of(codebooks.compressed(table(spark, rows), entries=5, rounds=1)) == brute_codes(rows, entries=5, rounds=1)


def plain_distance(a, b):
    return math.dist(a, b)


def brute_nearest(rows, k=10):
    kept = [(n, i, v) for n, (i, v) in enumerate(rows) if is_finite(v) and any(v)]
    for n, i, v in kept:
        if i is not None and i % 100 == 0:
            others = sorted(((plain_distance(v, w), j is None, j) for m, j, w in kept if m != n), key=lambda t: (t[0], t[1], t[2] or 0))[:k]
            yield from ((i, rank, j, d) for rank, (d, _, j) in enumerate(others, 1))


def asked(df, **how):
    return hamming_search.nearest(df, F.col("vec_id") % 100 == 0, **how)


def share_found(found, rows):
    """Share of the brute-force rows that are there, by query and distance (equally far ones can stand for each other)."""
    want = {}
    for q, _, _, d in brute_nearest(rows):
        want.setdefault(q, []).append(d)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["score"])
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items()}
    assert all(x == sorted(x) for x in got.values())
    return sum(a <= b * (1 + 1e-12) for q in want for a, b in zip(got[q], want[q], strict=True)) / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert share_found(asked(df).collect(), rows) >= 0.97


@pytest.mark.parametrize("dim", [1, 2, 3, 8, 100])
def test_recall_in_other_dimensions(spark, dim, monkeypatch):
    monkeypatch.setattr(hamming_search, "SAMPLE", 300)
    monkeypatch.setattr(hamming_search, "ROWS", 64)  # many blocks, hot leading bits
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(1500, dim)) * (1 + rng.random((1500, 1)))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = asked(df).collect()
    assert share_found(found, rows) >= 0.95
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in found}
    assert all(abs(s - math.dist(rows[q][1], rows[v][1])) < 1e-12 for (q, v), s in exact.items())


def test_clustered_vectors_search_narrowly(spark, monkeypatch):
    monkeypatch.setattr(hamming_search, "SAMPLE", 512)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(60, 32))
    x = np.repeat(middles, 30, axis=0) + 0.02 * rng.normal(size=(1800, 32))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    found = asked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert share_found(found, rows) >= 0.97
    codes = hamming_search.Codes(x[rng.permutation(1800)[:512]])
    assert codes.radius(np.array([0.2]))[0] <= 12


def test_copies_ties_and_odd_rows(spark):
    random.seed(11)
    grid = [(i, [float(random.randint(0, 2)) for _ in range(3)]) for i in range(300)]
    rows = [*grid, *((1000 + i, [1.0, 1.0, 1.0]) for i in range(400)), (100, grid[7][1]), (100, grid[100][1]), (None, [1.0, 1.0, 1.0]), (None, [9.0, 9.0, 9.0]), (5000, [9.0, 9.0, 8.0]), (600, [0.0, 0.0, 0.0]), (700, [-0.0, 0.0, 0.0])]
    df = table(spark, [*((i, v, 1) for i, v in rows), *odd_rows(3), (800, [1.0] * 4, 1)]).repartition(6)
    found = sorted(((r["query_id"], r["rank"], r["vec_id"] if r["vec_id"] is not None else -1, r["score"]) for r in asked(df, first_radius=64).collect()), key=repr)
    assert found == sorted(((q, n, v if v is not None else -1, s) for q, n, v, s in brute_nearest(rows)), key=repr)
    few = table(spark, [(100, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 4.0], 1), (2, [1.0, 2.0, 2.0], 1)])
    assert rows_of(asked(few)) == [(100, 1, 1, 1.0), (100, 2, 2, 1.0)]
    assert asked(table(spark, [])).collect() == asked(table(spark, odd_rows(3))).collect() == []


def test_distances_of_any_size(spark):
    rows = [(100, [1e200, 0.0]), (1, [0.0, 1e200]), (2, [1.1e200, 0.0]), (200, [1e-200, 0.0]), (3, [2e-200, 1e-200])]
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in asked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(found) == 8
    assert math.isclose(found[100, 1], math.sqrt(2) * 1e200) and math.isclose(found[100, 2], 1e199, rel_tol=1e-9)
    assert math.isclose(found[200, 3], math.sqrt(2) * 1e-200)


def test_every_code_within_the_radius_is_met_once():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**64, 400, dtype=np.uint64)
    near = codes[:100].copy()
    for _ in range(20):
        near ^= np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)
    codes = np.concatenate((codes, near, near[:5]))
    indexes = [hamming_search.Bucketed(j, codes, codes[:, None].astype(float)) for j in range(hamming_search.SUBSTRINGS)]
    for q in codes[:40]:
        for radius in (0, 1, 2, 3, 6, 11, 20, 33, 64):
            met = np.concatenate([index.within(int(q), radius) for index in indexes])
            assert sorted(met.tolist()) == np.flatnonzero(np.bitwise_count(codes ^ q) <= radius).tolist()
