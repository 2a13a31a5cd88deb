"""Maintenance runs: drain the queue, discover, drain again, within a budget; as a function of tables and as a stream of arrivals.

And retries by timers: songs that weren't found come up again after half a year, as keyed state of a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from needledrop.operators import maintenance
from needledrop.operators.maintenance import KEY
from needledrop.streaming.queue import drop, folder

#: Columns of the queue, of the catalog as a run needs it, and of a listing (see maintenance.classify).
QUEUE = "artist_lc string, album_lc string, year_int int, source_path string, album_mtime long, scan_kind string, enqueued_at long"
CATALOG = "artist_lc string, album_lc string, year_int int, source_path string, last_checked_at long, scan_failed int"
LISTING = "path string, artist_lc string, album_lc string, year_int int, dir_mtime long, content_mtime long, n_files long"
TAKEN = f"{QUEUE}, phase int"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Run(NamedTuple):
    """What a run leaves: the items it took (with their phase), the queue and the catalog."""

    taken: DataFrame
    queue: DataFrame
    catalog: DataFrame


def _first(queue: DataFrame, n: int) -> DataFrame:
    """The next n items with their place from 1 on: new before changed, first in first out, then by path and key. n is a budget, so small."""
    order = [F.when(F.col("scan_kind") == "new", 0).otherwise(1), F.col("enqueued_at"), F.col("source_path"), *map(F.col, KEY)]
    rows = queue.where(F.col("scan_kind").isin("new", "changed")).orderBy(*order).limit(n)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def _checked(catalog: DataFrame, taken: DataFrame, now: int) -> DataFrame:
    """The catalog after a look at what was taken."""
    t = taken.select(*(F.col(c).alias(f"_{c}") for c in KEY), F.col("source_path").alias("_path"))
    both = catalog.join(t, (F.col("artist_lc") == F.col("_artist_lc")) & (F.col("album_lc") == F.col("_album_lc")) & (F.col("year_int") == F.col("_year_int")), "full_outer")
    new = F.col("_artist_lc").isNotNull()
    return both.select(
        *(F.coalesce(c, f"_{c}").alias(c) for c in KEY),
        F.coalesce("_path", "source_path").alias("source_path"),
        F.when(new, F.lit(now).cast("long")).otherwise(F.col("last_checked_at")).alias("last_checked_at"),
        F.when(new, 0).otherwise(F.col("scan_failed")).alias("scan_failed"),
    )


def discovered(listing: DataFrame, catalog: DataFrame, now: int) -> DataFrame:
    """What of a listing has to be looked at, as items of the queue. Of folders with the same key the last path counts."""
    kinds = maintenance.classify(listing, catalog, now).where("outcome in ('new', 'changed')")
    rows = listing.join(kinds, "path").select(*KEY, F.col("path").alias("source_path"), F.greatest("content_mtime", "dir_mtime").alias("album_mtime"), F.col("outcome").alias("scan_kind"), F.lit(now).cast("long").alias("enqueued_at"))
    return maintenance.last_for_key(rows, F.col("source_path").desc())


def run(queue: DataFrame, catalog: DataFrame, listing: DataFrame, budget: int, now: int) -> Run:
    """One run: take up to `budget` items from the queue (phase 1), put what the listing has of new and changed albums into it
    (phase 2), then take what is left of the budget (phase 3) if the queue was empty at first or the listing brought something.

    queue, catalog: at most one row for a key. Items taken count as looked at now, so the listing doesn't bring them again.
    Decisions hang on counts, which stay one-row tables: nothing is collected.
    """
    queue, catalog = queue.select(*_names(QUEUE)), catalog.select(*_names(CATALOG))
    one = _first(queue, budget)
    between = _checked(catalog, one, now)
    found = discovered(listing, between, now)
    rest = queue.join(one.select(*KEY), list(KEY), "left_anti").join(found.select(*KEY), list(KEY), "left_anti").unionByName(found)
    counts = one.agg(F.count("*").alias("used")).crossJoin(found.agg(F.count("*").alias("brought")))
    goes_on = ((F.col("used") == 0) | (F.col("brought") > 0)) & (F.col("place") <= F.lit(budget) - F.col("used"))
    two = _first(rest, budget).crossJoin(counts).where(goes_on)
    taken = one.drop("place").withColumn("phase", F.lit(1)).unionByName(two.select(*_names(QUEUE)).withColumn("phase", F.lit(3)))
    return Run(taken, rest.join(two.select(*KEY), list(KEY), "left_anti").select(*_names(QUEUE)), _checked(between, two, now))


class Home:
    """Tables of a stream of runs by the number of a batch; a batch that runs again after a failure finds what the one before it left."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, number: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def get(self, name: str, schema: str, number: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/batch={number}")

    def all(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")

    def last(self, name: str) -> int | None:
        """The highest number of a batch that is there."""
        jvm, at = self.spark.sparkContext._jvm, f"{self.path}/{name}"
        where = jvm.org.apache.hadoop.fs.Path(at)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
        return max((int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")), default=None)

    def drop(self, name: str, number: int) -> None:
        drop(self.spark, f"{self.path}/{name}/batch={number}")


def stream_runs(arrivals: DataFrame, queue: DataFrame, catalog: DataFrame, budget: int, home: str | None = None) -> Run:
    """A run for each arrival of a listing, until none is left; what was taken by all of them, and the queue and catalog after the last.

    arrivals: a stream of LISTING with a column now (seconds since 1970; a batch runs at its latest). queue and catalog: before the first
    batch. What is listed is read once: the stream's own position is the mark up to which listings are known. Position and
    tables lie in the folder home (a new one if none is given), so a later call with it goes on where the last one, or a
    failed one, stopped. Each batch writes its whole queue and catalog beside the former ones, which go two batches later.
    """
    spark = arrivals.sparkSession
    state = Home(spark, home or folder(spark, "runs"))
    if state.last("queue") is None:
        state.put(-1, catalog=catalog.select(*_names(CATALOG)), queue=queue.select(*_names(QUEUE)))

    def work(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("now").alias("now")).first()["now"]
        before = Run(None, state.get("queue", QUEUE, number - 1), state.get("catalog", CATALOG, number - 1))
        after = before if now is None else run(before.queue, before.catalog, batch.select(*_names(LISTING)), budget, now)
        taken = after.taken if now is not None else spark.createDataFrame([], TAKEN)
        state.put(number, taken=taken, catalog=after.catalog, queue=after.queue)
        for name in ("queue", "catalog"):
            state.drop(name, number - 2)

    arrivals.writeStream.foreachBatch(work).option("checkpointLocation", f"{state.path}/position").trigger(availableNow=True).start().awaitTermination()
    last = state.last("queue")
    taken = state.all("taken", TAKEN).drop("batch") if state.last("taken") is not None else spark.createDataFrame([], TAKEN)
    return Run(taken, state.get("queue", QUEUE, last), state.get("catalog", CATALOG, last))


#: Fixed value: after how many seconds a song that wasn't found is looked for again.
RETRY_SECONDS = 6 * 30 * 86_400
DUE = "song string, due timestamp"


def due_again(cache: DataFrame, now: int, ttl: int = RETRY_SECONDS) -> DataFrame:
    """The rows of a cache (status, attempted_at) that are due again: not found, and tried ttl seconds ago or more (never tried: at 0)."""
    return cache.where((F.col("status") == "not_found") & (F.lit(now) - F.coalesce("attempted_at", F.lit(0)) >= ttl))


def _retries(ttl: int):
    def look(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """State: when the song was last tried in vain (milliseconds), until it is tried again or due."""
        due, since = [], state.get[0] if state.exists else None
        if state.hasTimedOut:
            due, since = [since + ttl * 1000], None
        else:
            tries = pd.concat([*batches]).sort_values(["at", "status"])
            for at, status in zip(tries["at"].astype("datetime64[ms]").astype("int64"), tries["status"], strict=True):
                if since is not None and at < since:
                    continue
                if since is not None and at >= since + ttl * 1000:
                    due.append(since + ttl * 1000)
                since = int(at) if status == "not_found" else None
        if since is None:
            if state.exists:
                state.remove()
        elif since + ttl * 1000 <= state.getCurrentWatermarkMs():
            due.append(since + ttl * 1000)
            if state.exists:
                state.remove()
        else:
            state.update((since,))
            # A timer fires once the watermark is beyond it, and can't be set to what the watermark has reached.
            state.setTimeoutTimestamp(max(since + ttl * 1000 - 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"song": [key[0]] * len(due), "due": pd.to_datetime(due, unit="ms")})

    return look


def retries(attempts: DataFrame, ttl: int = RETRY_SECONDS, late: str = "0 seconds") -> DataFrame:
    """song, due of each song whose last attempt (song, at, status) was in vain for ttl seconds: a stream of attempts as a stream of what is due.

    One state for each song that is being waited for, with a timer in event time: it fires when the watermark passes, also without a
    further attempt of that song. A new attempt before that replaces the timer, one that finds the song ends it.
    """
    timed = attempts.select("song", "at", "status").withWatermark("at", late)
    return timed.groupBy("song").applyInPandasWithState(_retries(ttl), DUE, "since long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_retries(attempts: DataFrame, ttl: int = RETRY_SECONDS, home: str | None = None) -> DataFrame:
    """All that is due so far of a stream of attempts (see retries), until none is left. Goes on where it stopped, with the same home."""
    spark = attempts.sparkSession
    home = home or folder(spark, "retries")
    out = retries(attempts, ttl).writeStream.outputMode("append").format("parquet").option("path", f"{home}/due").option("checkpointLocation", f"{home}/position")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(DUE).parquet(f"{home}/due")
