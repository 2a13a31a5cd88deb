"""Spectrogram images: signatures against plain loops, panes against a flood fill, axes and numbers against known answers."""

from __future__ import annotations

import math
import random
from statistics import mean, median

import pytest
from pyspark.sql import functions as F

from needledrop.functions import ocr
from needledrop.operators import spectrogram


def quantile(values, q):
    s = sorted(values)
    at = q * (len(s) - 1)
    low = math.floor(at)
    return s[low] + (at - low) * (s[min(low + 1, len(s) - 1)] - s[low])


def plain_signature(energy, top):
    n = len(energy)
    k = max(3, int(n * 0.01))
    k += k % 2 == 0
    soft = [sum(energy[max(0, y - k // 2) : y + k // 2 + 1]) / k for y in range(n)]
    floor = median(soft[: max(5, n // 8)])
    span = max(0.0, quantile(soft, 0.9) - floor)
    level = floor + max(2.0, span * 0.25)
    sustain, start = max(8, n // 18), max(5, int(n * 0.08))
    hits = [y for y in range(start, max(start + 1, n - sustain)) if soft[y : y + sustain] and mean(soft[y : y + sustain]) >= level]
    cut = hits[0] if hits else n - 1
    khz = top * (1 - cut / (n - 1))
    steps = [b - a for a, b in zip(soft, soft[1:])][max(0, cut - 4) : cut + 10]
    row = lambda f: int((1 - min(f, top) / top) * (n - 1))
    ratio = mean(soft[: max(1, row(24.0))]) / max(1e-6, mean(soft[row(20.0) : max(row(20.0) + 1, row(8.0))]))
    wall = max(steps, default=0.0)
    hint = bool(hits) and khz <= 24.5 and (top > 24.5 or khz <= top * 0.88) and wall >= max(2.0, span * 0.12) and (ratio <= 0.45 or top <= 24.5 and ratio <= 0.78)
    return {"cutoff_row": cut, "transition_found": bool(hits), "noise_floor": floor, "threshold": level, "dynamic_span": span, "wall_strength": wall, "high_band_ratio": ratio, "brickwall_hint": hint, "detected_khz": khz}


def test_signatures(spark):
    random.seed(3)
    images = {}
    for i, n in enumerate((6, 12, 30, 90, 160, 420, 700, 1203)):
        for j, (top, at, low, high) in enumerate(((22.05, 0.1, 1.0, 9.0), (48.0, 0.6, 1.0, 40.0), (96.0, 0.8, 0.5, 60.0), (24.0, 2.0, 3.0, 3.0))):
            images[f"{i}/{j}"] = (top, [random.random() + (high if y >= at * n else low) for y in range(n)])
    df = spark.createDataFrame([(name, y, e, top) for name, (top, energy) in images.items() for y, e in enumerate(energy)], "image string, row int, energy double, max_khz double").repartition(7)
    found = {r["image"]: r.asDict() for r in spectrogram.signature(df).collect()}
    assert found.keys() == images.keys()
    for name, (top, energy) in images.items():
        for key, value in plain_signature(energy, top).items():
            assert found[name][key] == (pytest.approx(value, rel=1e-9, abs=1e-9) if isinstance(value, float) else value), (name, key)
    assert {r["transition_found"] for r in found.values()} == {r["brickwall_hint"] for r in found.values()} == {True, False}
    assert not found["6/3"]["transition_found"]


def test_a_signature_is_one_shuffle(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 48.0)], "image string, row int, energy double, max_khz double")
    plan = spectrogram.signature(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def flood(grid):
    """Boxes and areas of dark cells that touch, corners as well."""
    left = {(y, x) for y, row in enumerate(grid) for x, v in enumerate(row) if v < 70}
    while left:
        todo, seen = [left.pop()], []
        while todo:
            y, x = todo.pop()
            seen.append((y, x))
            for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        ys, xs = [y for y, _ in seen], [x for _, x in seen]
        yield min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(seen)


def test_regions_equal_a_flood_fill(spark):
    random.seed(8)
    grids = {}
    for i, share in enumerate((0.2, 0.35, 0.42, 0.5, 0.7)):
        grids[f"r{i}"] = [[10 if random.random() < share else 200 for _ in range(150)] for _ in range(40)]
    snake = [[200] * 90 for _ in range(41)]
    for y in range(0, 41, 2):
        snake[y] = [10] * 90
        if y + 1 < 41:
            snake[y + 1][89 if y % 4 == 0 else 0] = 10
    grids |= {"snake": snake, "bright": [[255] * 80 for _ in range(20)], "dark": [[0] * 80 for _ in range(20)], "two": [[0 if x < 60 and y < 14 or x > 4 and y > 20 else 99 for x in range(100)] for y in range(40)]}
    df = spark.createDataFrame([(k, y, [float(v) for v in row]) for k, g in grids.items() for y, row in enumerate(g)], "image string, row int, values array<double>").repartition(5)
    rows = spectrogram.regions(df).collect()
    for k, g in grids.items():
        h, w = len(g), len(g[0])
        large = [b for b in flood(g) if b[2] >= int(w * 0.45) and b[3] >= int(h * 0.12) and b[4] >= int(w * h * 0.015)]
        large.sort(key=lambda b: (-b[2] * b[3], b[1], b[0]))
        assert [tuple(r[c] for c in ("x", "y", "w", "h", "area")) for r in sorted((r for r in rows if r["image"] == k), key=lambda r: r["rank"])] == large, k
    assert len([r for r in rows if r["image"] == "two"]) == 2 and len([r for r in rows if r["image"] == "snake"]) == 1
    assert spectrogram.regions(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("values", "axis"),
    [
        ([192.0, 60.0, 50.0, 40.0, 20.0, 10.0], 96.0),
        ([46.222, 44.444, 42.666, 40.888, 39.111, 37.333, 35.555, 33.777, 32.0], 48.0),
        ([20.0, 18.0, 16.0, 14.0, 12.0, 10.0], 22.05),
        ([23.111, 22.222, 21.333, 20.444, 19.555, 18.666, 17.777, 16.888], 24.0),
        ([44.1], 22.05),
        ([96.0], 48.0),
        ([21.0, 15.0, 12.5, 9.0], 24.0),
        ([33.9], None),
        ([20.0, 19.7, 19.3], 22.05),
    ],
)
def test_axes(spark, values, axis):
    found = spectrogram.axes(spark.createDataFrame([("a", v) for v in values] + [("b", 192.0)], "image string, khz double")).collect()
    assert {r["image"]: r["axis_khz"] for r in found} == ({"a": axis} if axis else {}) | {"b": 96.0}


def test_frames(spark):
    one = lambda *b: spark.range(1).select(spectrogram.is_full_frame(*map(F.lit, (*b, 1920, 1080))).alias("v")).first()["v"]
    assert one(0, 0, 1920, 1080) and not one(120, 80, 1600, 720)


def test_numbers_of_read_text(spark):
    rows = [
        ("46222.22 44444.45 32000.00", None, None, False),
        ("Peak Amplitude: -1.0 dB", -1.0, None, True),
        ("Dynamic Range: 12.0", None, 12.0, True),
        ("peak = -0.3 DR 7", -0.3, 7.0, True),
        ("DynamicRange: 53940351938", None, 53.94, True),
        ("dynamicrange 99", None, None, True),
        ("", None, None, False),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    t = F.col("t")
    assert [tuple(r) for r in df.select(t, ocr.labelled_number(t, ocr.PEAK), ocr.dynamic_range(t), ocr.has_mastering_stats(t)).collect()] == rows
