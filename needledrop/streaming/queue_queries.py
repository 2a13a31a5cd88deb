"""Queue queries, batch and streaming, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.operators.catalog_queries import Query
from needledrop.operators.maintenance import KEY, keyed, last_for_key
from needledrop.operators.maintenance_queries import _LISTING, _ONE, _SONGS, NOW, _listing, _one, _songs
from needledrop.sources.bind import ALBUMS_SQL, albums, choose, table
from needledrop.streaming import queue, runs
from needledrop.streaming.queue import ITEMS

QUERIES: dict[str, Query] = {
    "upsert_queue": lambda spark, d: queue.latest(queue.items(table(spark, d, "events"))),
    "stream_queue": lambda spark, d: queue.stream_latest(spark, d, "events.parquet"),
    "hourly_items": lambda spark, d: queue.hourly(table(spark, d, "events")),
}
_LATEST = """SELECT key, kind, enqueued AS at, item FROM (SELECT user_id AS key, CASE WHEN event_type = 'signup' THEN 'new' ELSE 'changed' END AS kind, CAST(floor(epoch(ts)) AS BIGINT) AS enqueued, event_id AS item,
  row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) DESC, event_id DESC) AS n FROM events) WHERE n = 1"""
SQL: dict[str, str] = {
    "upsert_queue": _LATEST,
    "stream_queue": _LATEST,
    "hourly_items": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}


def _before(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The queue and the catalog before a run."""
    queue = keyed(albums(spark, d).where("id % 23 = 0")).select(*KEY, "source_path", F.lit(1).cast("long").alias("album_mtime"), choose(("new", "changed", "other"), F.col("id")).alias("scan_kind"), (F.col("id") % 1000).cast("long").alias("enqueued_at"))
    return last_for_key(queue, F.col("source_path").desc()), _one(spark, d)


BUDGET = 400
_RUN = f"""{ALBUMS_SQL}, {_LISTING}, {_ONE},
q AS (SELECT * FROM (SELECT lower(artist) AS artist_lc, lower(album) AS album_lc, year_int, source_path, 1 AS album_mtime, list_extract(['new', 'changed', 'other'], CAST(id % 3 + 1 AS BIGINT)) AS scan_kind, id % 1000 AS enqueued_at, row_number() OVER (PARTITION BY lower(artist), lower(album), year_int ORDER BY source_path DESC) AS r FROM albums WHERE id % 23 = 0) WHERE r = 1),
t1 AS (SELECT * EXCLUDE (r), 1 AS phase FROM q WHERE scan_kind IN ('new', 'changed') ORDER BY scan_kind <> 'new', enqueued_at, source_path, artist_lc, album_lc, year_int LIMIT {BUDGET}),
c1 AS (SELECT artist_lc, album_lc, year_int, source_path, last_checked_at, scan_failed FROM one ANTI JOIN t1 USING (artist_lc, album_lc, year_int) UNION ALL SELECT artist_lc, album_lc, year_int, source_path, {NOW}, 0 FROM t1),
j AS (SELECT l.*, p.source_path AS p_path, p.last_checked_at AS p_checked, k.artist_lc AS k_artist, coalesce(k.last_checked_at, 0) AS checked, k.scan_failed AS failed, greatest(l.content_mtime, l.dir_mtime) AS content
  FROM listing l LEFT JOIN c1 p ON l.path = p.source_path AND p.scan_failed = 0 LEFT JOIN c1 k ON l.artist_lc = k.artist_lc AND l.album_lc = k.album_lc AND l.year_int = k.year_int),
n AS (SELECT *, row_number() OVER (PARTITION BY artist_lc, album_lc, year_int ORDER BY path DESC) AS r FROM j WHERE NOT (p_path IS NOT NULL AND dir_mtime > 0 AND coalesce(p_checked, 0) > 0 AND dir_mtime <= p_checked) AND n_files > 0 AND artist_lc <> ''
  AND NOT (k_artist IS NOT NULL AND failed = 1 AND NOT (checked > 0 AND content > checked) AND NOT ({NOW} - checked >= 604800)) AND NOT (k_artist IS NOT NULL AND checked > 0 AND content <= checked)),
f AS (SELECT artist_lc, album_lc, year_int, path AS source_path, content AS album_mtime, CASE WHEN k_artist IS NULL THEN 'new' ELSE 'changed' END AS scan_kind, {NOW} AS enqueued_at FROM n WHERE r = 1),
q2 AS (SELECT * EXCLUDE (r) FROM q ANTI JOIN t1 USING (artist_lc, album_lc, year_int) ANTI JOIN f USING (artist_lc, album_lc, year_int) UNION ALL SELECT * FROM f),
o AS (SELECT *, row_number() OVER (ORDER BY scan_kind <> 'new', enqueued_at, source_path, artist_lc, album_lc, year_int) AS place FROM q2 WHERE scan_kind IN ('new', 'changed')),
t2 AS (SELECT * EXCLUDE (place), 3 AS phase FROM o WHERE place <= {BUDGET} - (SELECT count(*) FROM t1) AND ((SELECT count(*) FROM t1) = 0 OR (SELECT count(*) FROM f) > 0))"""
QUERIES |= {
    "maintenance_run": lambda spark, d: runs.run(*_before(spark, d), _listing(spark, d), BUDGET, NOW).taken,
    "maintenance_run_queue": lambda spark, d: runs.run(*_before(spark, d), _listing(spark, d), BUDGET, NOW).queue,
    "lyrics_retry_due": lambda spark, d: runs.due_again(_songs(spark, d)[1].withColumn("attempted_at", F.when(F.col("cache_id") % 4 != 0, F.col("updated_at") * 20)), 2_000_000 + runs.RETRY_SECONDS).select("cache_id"),
    "stream_retries": lambda spark, d: _retries(spark, d),
}
SQL |= {
    "maintenance_run": f"WITH {_RUN} SELECT * FROM t1 UNION ALL SELECT * FROM t2",
    "maintenance_run_queue": f"WITH {_RUN} SELECT * FROM q2 ANTI JOIN t2 USING (artist_lc, album_lc, year_int)",
    "lyrics_retry_due": f"WITH {_SONGS} SELECT cache_id FROM cache WHERE status = 'not_found' AND (cache_id % 4 = 0 OR updated_at * 20 <= 2000000)",
    "stream_retries": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS song, epoch_us(ts) // 1000 AS t, CASE WHEN event_type = 'purchase' THEN 'found' ELSE 'not_found' END AS status FROM events),
  n AS (SELECT *, lead(t) OVER (PARTITION BY song ORDER BY t, status) AS next, max(t) OVER () AS latest FROM e) SELECT song, t + 86400000 AS due FROM n WHERE status = 'not_found' AND (next - t >= 86400000 OR (next IS NULL AND t + 86400000 <= latest))""",
}


def _retries(spark: SparkSession, d: str) -> DataFrame:
    """Events as attempts to find a song: a purchase finds it."""
    events = spark.readStream.schema(ITEMS).option("pathGlobFilter", "events.parquet").parquet(d)
    attempts = events.select(F.col("user_id").cast("string").alias("song"), F.col("ts").alias("at"), F.when(F.col("event_type") == "purchase", "found").otherwise("not_found").alias("status"))
    return runs.stream_retries(attempts, ttl=86_400).select("song", F.unix_millis("due").alias("due"))
