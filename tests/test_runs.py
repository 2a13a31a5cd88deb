"""Runs over arrivals and timers of retries, with restarts, against plain replays."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from needledrop.streaming import runs

DAY = 86_400


def plain_run(queue, catalog, listing, budget, now):
    """queue: key to (path, mtime, kind, at); catalog: key to (path, checked, failed); both are changed. What was taken, with phases."""
    def take(n, phase):
        rows = sorted((k for k in queue if queue[k][2] in ("new", "changed")), key=lambda k: (queue[k][2] != "new", queue[k][3], queue[k][0], k))[:n]
        for k in rows:
            catalog[k] = (queue[k][0], now, 0)
        return [(k, *queue.pop(k), phase) for k in rows]

    one, found = take(budget, 1), {}
    paths = {p: c for p, c, failed in catalog.values() if failed == 0}
    for path, a, b, year, changed, content, n in listing:
        checked, newest = paths.get(path, 0) or 0, max(content, changed)
        if path in paths and changed > 0 and checked > 0 and changed <= checked or n == 0 or not a or not b:
            continue
        k = (a, b, year)
        if k in catalog:
            _, last, failed = catalog[k]
            last = last or 0
            if failed == 1 and not (last > 0 and newest > last) and now - last < 7 * DAY:
                continue
            if last > 0 and newest <= last:
                continue
        if k not in found or path > found[k][0]:
            found[k] = (path, newest, "changed" if k in catalog else "new", now)
    queue.update(found)
    return one + (take(budget - len(one), 3) if not one or found else [])


def world(seed, folders=60):
    rng = random.Random(seed)
    key = lambda i: (f"a{i % 9}", f"b{i}", 1990 + i % 3)
    queue = {key(i): (f"/q/{i}", 5, rng.choice(("new", "changed", "other")), rng.randrange(4)) for i in range(0, folders, 7)}
    catalog = {key(i): (f"/m/{i}", rng.choice((None, 100, 10 * DAY)), rng.randrange(4) == 0) for i in range(0, folders, 2)}
    catalog = {k: (p, c, int(f)) for k, (p, c, f) in catalog.items()}
    arrivals = []
    for n in range(3):
        now = (10 + 5 * n) * DAY
        picked = rng.sample(range(folders), 25 if n != 1 else 0) if n != 1 else [3]
        arrivals.append((now, [(f"/m/{i}" if rng.random() < 0.7 else f"/moved/{i}", *(key(i) if rng.random() < 0.9 else ("", "", 0)), now - rng.randrange(12 * DAY), now - rng.randrange(12 * DAY), rng.randrange(5)) for i in picked]))
    return queue, catalog, arrivals


def tables(spark, queue, catalog):
    return spark.createDataFrame([(*k, *v) for k, v in queue.items()], runs.QUEUE), spark.createDataFrame([(*k, *v) for k, v in catalog.items()], runs.CATALOG)


def items(df):
    return sorted(((r["artist_lc"], r["album_lc"], r["year_int"]), r["source_path"], r["album_mtime"], r["scan_kind"], r["enqueued_at"], *([r["phase"]] if "phase" in df.columns else [])) for r in df.collect())


@pytest.mark.parametrize("budget", [0, 3, 8, 100])
def test_a_run(spark, budget):
    queue, catalog, arrivals = world(budget)
    now, listing = arrivals[0]
    got = runs.run(*tables(spark, queue, catalog), spark.createDataFrame(listing, runs.LISTING), budget, now)
    taken = plain_run(queue, catalog, listing, budget, now)
    assert items(got.taken) == sorted(taken)
    assert items(got.queue) == sorted((k, *v) for k, v in queue.items())
    assert sorted(((r["artist_lc"], r["album_lc"], r["year_int"]), r["source_path"], r["last_checked_at"], r["scan_failed"]) for r in got.catalog.collect()) == sorted((k, *v) for k, v in catalog.items())


def test_arrivals_with_a_restart(spark, tmp_path):
    queue, catalog, arrivals = world(5)
    before = tables(spark, dict(queue), dict(catalog))
    source, home = tmp_path / "listing", f"file://{tmp_path}/home"
    stream = lambda: spark.readStream.schema(f"{runs.LISTING}, now long").option("maxFilesPerTrigger", 1).parquet(str(source))
    taken = []
    for n, (now, listing) in enumerate(arrivals):
        spark.createDataFrame([(*r, now) for r in listing], f"{runs.LISTING}, now long").coalesce(1).write.mode("append").parquet(str(source))
        taken += plain_run(queue, catalog, listing, 12, now)
        if n == 1:  # a batch that failed after it wrote some of its tables runs again
            broken = runs.Home(spark, home)
            real, calls = runs.Home.put, []

            def put(self, number, real=real, calls=calls, **kept):
                calls.append(number)
                real(self, number, taken=kept["taken"])
                raise RuntimeError("lost")

            runs.Home.put = put
            with pytest.raises(Exception, match="lost"):
                runs.stream_runs(stream(), *before, 12, home)
            runs.Home.put = real
            assert calls == [1] and broken.last("queue") == 0
        got = runs.stream_runs(stream(), *before, 12, home)
        assert items(got.taken) == sorted(taken) and items(got.queue) == sorted((k, *v) for k, v in queue.items())
    assert len(taken) > 8 and {t[-1] for t in taken} == {1, 3}
    assert items(runs.stream_runs(stream(), *before, 12, home).taken) == sorted(taken)  # nothing new
    assert runs.Home(spark, home).last("queue") == 2


def plain_retries(attempts, ttl):
    """What is due when all attempts are known, the latest of them being the present."""
    end, by, out = max(a for _, a, _ in attempts), {}, []
    for song, at, status in sorted(attempts, key=lambda r: (r[1], r[2])):
        since = by.get(song)
        if since is not None and at - since >= ttl:
            out.append((song, since + ttl))
        by[song] = at if status == "not_found" else None
    return sorted(out + [(s, t + ttl) for s, t in by.items() if t is not None and t + ttl <= end])


def test_retries_by_timers_with_restarts(spark, tmp_path):
    rng, ttl = random.Random(2), runs.RETRY_SECONDS
    at = lambda s: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=s)
    source, home, all_of = tmp_path / "attempts", f"file://{tmp_path}/home", []
    for part in range(3):
        some = [(f"s{rng.randrange(40)}", (part * 150 + rng.randrange(150)) * DAY, rng.choice(("found", "not_found", "not_found"))) for _ in range(60)]
        some += [("once", 5 * DAY, "not_found")] if part == 0 else []
        all_of += some
        spark.createDataFrame([(s, at(t), x) for s, t, x in some], "song string, at timestamp, status string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("song string, at timestamp, status string").parquet(str(source))
        got = runs.stream_retries(stream, ttl, home).collect()
        want = plain_retries(all_of, ttl)
        assert sorted((r["song"], int((r["due"] - at(0)).total_seconds())) for r in got) == want
    assert ("once", 5 * DAY + ttl) in want and len(want) > 5


def test_due_again(spark):
    cache = spark.createDataFrame([(1, "not_found", 0), (2, "not_found", 1), (3, "found", 0), (4, "not_found", None), (5, None, 0)], "id int, status string, attempted_at long")
    assert sorted(r["id"] for r in runs.due_again(cache, runs.RETRY_SECONDS).collect()) == [1, 4]
