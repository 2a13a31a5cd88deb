"""Maintenance queries over the bound tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.operators import catalog, maintenance
from needledrop.operators.catalog_queries import GRADED, Query
from needledrop.sources.bind import ALBUMS_SQL, albums, table, tracks
from needledrop.sources.bind import TRACKS_SQL

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


#: Columns of the catalog that the bound tables don't have, made from keys.
_MORE = {
    "quality_score": "CASE WHEN id % 3 <> 0 THEN CAST(id % 100 AS DOUBLE) END",
    "is_upscaled": "CAST(CASE WHEN id % 4 <> 0 THEN id % 2 END AS INT)",
    "recommendation": "CASE WHEN id % 9 < 5 THEN 'Keep' WHEN id % 9 < 8 THEN 'Replace with Lossless Rip' END",
    "recode_source_profile": "CASE WHEN id % 7 > 2 THEN '96000/24' END",
}
_COLUMNS = (*maintenance.KEY, *maintenance.OVERWRITE, *maintenance.KEEP_IF_NULL, *maintenance.UNTOUCHED)
_NEW = {
    "artist": "upper(artist)",
    "dynamic_range_score": "CASE WHEN id % 5 < 3 THEN dynamic_range_score + 1 END",
    "quality_grade": "CASE WHEN id % 5 < 3 THEN quality_grade END",
    "grade_rank": "CASE WHEN id % 5 < 3 THEN grade_rank END",
    "bitrate": "CASE WHEN id % 2 = 0 THEN bitrate END",
    "quality_score": "CASE WHEN id % 6 <> 0 THEN quality_score END",
    "current_quality": "CASE WHEN id % 4 = 0 THEN NULL ELSE current_quality END",
    "codec": "CASE WHEN id % 6 = 0 THEN NULL ELSE codec END",
    "last_checked_at": "last_checked_at + 1000",
    "source_path": "CASE WHEN id % 8 = 0 THEN NULL ELSE source_path END",
}


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Albums of even or third ids as the catalog; those of odd or third ids, changed, as what a scan found."""
    rows = maintenance.keyed(albums(spark, d))
    # What each row derives is worked out after the choice, for the chosen rows alone.
    chosen = lambda test: catalog.graded(maintenance.last_for_key(rows.where(test), F.col("id").desc())).withColumns({c: F.expr(e) for c, e in _MORE.items()})
    source = chosen("id % 2 = 1 or id % 3 = 0").withColumns({c: F.expr(e) for c, e in _NEW.items()})
    return chosen("id % 2 = 0 or id % 3 = 0").select("id", *_COLUMNS), source.select(*_COLUMNS)


def _key_sql(test: str, new: bool) -> str:
    columns = ", ".join(f"{_NEW[c]} AS {c}" if new and c in _NEW else c for c in _COLUMNS if c not in ("artist_lc", "album_lc"))
    return f"(SELECT * FROM (SELECT id, lower(artist) AS artist_lc, lower(album) AS album_lc, {columns}, row_number() OVER (PARTITION BY lower(artist), lower(album), year_int ORDER BY id DESC) AS _n FROM more WHERE {test}) WHERE _n = 1)"


_T, _S = _key_sql("id % 2 = 0 OR id % 3 = 0", False), _key_sql("id % 2 = 1 OR id % 3 = 0", True)
add(
    "upsert_catalog",
    lambda spark, d: maintenance.upsert(*_sides(spark, d)).drop("id"),
    f"WITH {GRADED}, more AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in _MORE.items())} FROM graded), t AS {_T}, s AS {_S} SELECT "
    + ", ".join(
        [f"coalesce(t.{c}, s.{c}) AS {c}" for c in maintenance.KEY]
        + [f"CASE WHEN s.artist_lc IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in maintenance.OVERWRITE]
        + [f"coalesce(s.{c}, t.{c}) AS {c}" for c in maintenance.KEEP_IF_NULL]
        + ["coalesce(t.rarity, 0) AS rarity", "coalesce(t.has_lyrics, 0) AS has_lyrics", "t.last_recoded_at AS last_recoded_at"]
    )
    + " FROM t FULL OUTER JOIN s ON t.artist_lc = s.artist_lc AND t.album_lc = s.album_lc AND t.year_int = s.year_int",
)
add(
    "mark_rarity",
    lambda spark, d: maintenance.set_rarity(albums(spark, d), table(spark, d, "events").select(F.col("user_id").alias("id")), 1).select("id", "rarity"),
    f"WITH {ALBUMS_SQL} SELECT id, CASE WHEN id IN (SELECT user_id FROM events) THEN 1 ELSE rarity END AS rarity FROM albums",
)


def _queue(spark: SparkSession, d: str) -> DataFrame:
    """Events as queue items."""
    kind = F.when(F.col("event_type") == "signup", "new").when(F.col("event_type").isin("click", "view"), "changed").otherwise("other")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", kind.alias("scan_kind"), F.unix_timestamp("ts").alias("enqueued_at"))


_QUEUE = "queue AS (SELECT event_id AS id, user_id, CASE WHEN event_type = 'signup' THEN 'new' WHEN event_type IN ('click', 'view') THEN 'changed' ELSE 'other' END AS scan_kind, CAST(floor(epoch(ts)) AS BIGINT) AS enqueued_at FROM events)"
add(
    "queue_priority",
    lambda spark, d: maintenance.next_items(_queue(spark, d), 50),
    f"WITH {_QUEUE} SELECT * FROM queue WHERE scan_kind IN ('new', 'changed') ORDER BY CASE WHEN scan_kind = 'new' THEN 0 ELSE 1 END, enqueued_at, id LIMIT 50",
)


def _requeued(spark: SparkSession, d: str) -> DataFrame:
    rows = albums(spark, d)
    queue = maintenance.keyed(rows.where("id % 23 = 0")).select("artist", "artist_lc", "album", "album_lc", "year_int", "source_path", F.lit("changed").alias("scan_kind"), F.col("id").cast("long").alias("enqueued_at"))
    return maintenance.requeue(rows, maintenance.last_for_key(queue, F.col("source_path")), rows.where("id % 7 = 0").select("id"))[1]


def _queued_sql(test: str, kind: str, at: str) -> str:
    return f"(SELECT * EXCLUDE (_n) FROM (SELECT artist, lower(artist) AS artist_lc, album, lower(album) AS album_lc, year_int, source_path, '{kind}' AS scan_kind, CAST({at} AS BIGINT) AS enqueued_at, row_number() OVER (PARTITION BY lower(artist), lower(album), year_int ORDER BY source_path) AS _n FROM albums WHERE {test}) WHERE _n = 1)"


add(
    "delete_and_requeue",
    _requeued,
    f"WITH {ALBUMS_SQL}, q AS {_queued_sql('id % 23 = 0', 'changed', 'id')}, n AS {_queued_sql('id % 7 = 0', 'new', '0')} SELECT * FROM q WHERE (artist_lc, album_lc, year_int) NOT IN (SELECT (artist_lc, album_lc, year_int) FROM n) UNION ALL SELECT * FROM n",
)

NOW = 1_000_000_000


def _listing(spark: SparkSession, d: str) -> DataFrame:
    """Directories of most albums, with times around their last check."""
    k, checked = F.col("id"), F.coalesce("last_checked_at", F.lit(NOW))
    return maintenance.keyed(albums(spark, d)).where("id % 12 <> 5").select(
        F.when(k % 3 == 0, F.col("source_path")).otherwise(F.concat("source_path", F.lit("-moved"))).alias("path"),
        F.when(k % 31 == 0, "").when(k % 6 == 4, F.concat("artist_lc", F.lit(" x"))).otherwise(F.col("artist_lc")).alias("artist_lc"),
        "album_lc",
        "year_int",
        (checked + (k % 5 - 2) * 100).alias("dir_mtime"),
        (checked + (k % 7 - 3) * 100).alias("content_mtime"),
        (k % 9).alias("n_files"),
    )


_LISTING = f"""listing AS (SELECT CASE WHEN id % 3 = 0 THEN source_path ELSE source_path || '-moved' END AS path,
  CASE WHEN id % 31 = 0 THEN '' WHEN id % 6 = 4 THEN lower(artist) || ' x' ELSE lower(artist) END AS artist_lc, lower(album) AS album_lc, year_int,
  coalesce(last_checked_at, {NOW}) + (id % 5 - 2) * 100 AS dir_mtime, coalesce(last_checked_at, {NOW}) + (id % 7 - 3) * 100 AS content_mtime, id % 9 AS n_files FROM albums WHERE id % 12 <> 5)"""
_ONE = "one AS (SELECT * FROM (SELECT *, lower(artist) AS artist_lc, lower(album) AS album_lc, row_number() OVER (PARTITION BY lower(artist), lower(album), year_int ORDER BY id DESC) AS _n FROM albums) WHERE _n = 1)"


def _one(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.last_for_key(maintenance.keyed(albums(spark, d)), F.col("id").desc())


add(
    "discovery_classify",
    lambda spark, d: maintenance.classify(_listing(spark, d), _one(spark, d), NOW),
    f"""WITH {ALBUMS_SQL}, {_LISTING}, {_ONE}, j AS (
  SELECT l.*, p.source_path AS p_path, p.last_checked_at AS p_checked, k.artist_lc AS k_artist, coalesce(k.last_checked_at, 0) AS checked, k.scan_failed AS failed, greatest(l.content_mtime, l.dir_mtime) AS content
  FROM listing l LEFT JOIN one p ON l.path = p.source_path AND p.scan_failed = 0 LEFT JOIN one k ON l.artist_lc = k.artist_lc AND l.album_lc = k.album_lc AND l.year_int = k.year_int
) SELECT path, outcome FROM (SELECT path, CASE
  WHEN p_path IS NOT NULL AND dir_mtime > 0 AND coalesce(p_checked, 0) > 0 AND dir_mtime <= p_checked THEN 'unchanged'
  WHEN n_files = 0 THEN NULL WHEN coalesce(artist_lc, '') = '' OR coalesce(album_lc, '') = '' THEN 'no_key'
  WHEN k_artist IS NOT NULL AND failed = 1 AND NOT (checked > 0 AND content > checked) AND NOT ({NOW} - checked >= 604800) THEN 'fail_hold'
  WHEN k_artist IS NOT NULL AND checked > 0 AND content <= checked THEN 'unchanged' WHEN k_artist IS NOT NULL THEN 'changed' ELSE 'new' END AS outcome FROM j) WHERE outcome IS NOT NULL""",
)
add(
    "purge_missing",
    lambda spark, d: maintenance.missing(albums(spark, d), _listing(spark, d)).select("id", "source_path"),
    f"WITH {ALBUMS_SQL}, {_LISTING} SELECT id, source_path FROM albums WHERE source_path NOT IN (SELECT path FROM listing)",
)


def _songs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Wanted songs and a cache of lyrics. The cache: tracks whose id divides by 3; wanted: all others."""
    rows = tracks(spark, d).select(
        F.concat(F.lit("a"), (F.col("part_id") % 40).cast("string")).alias("artist_lc"),
        F.concat(F.lit("t"), (F.col("supp_id") % 20).cast("string")).alias("title_lc"),
        (F.col("seconds") + F.col("cutoff_hz") % 7).cast("int").alias("duration_int"),
        (F.col("album_id") * 100 + F.col("position")).alias("song_id"),
        (F.col("bitrate_bps") + 0).alias("updated_at"),
    )
    cache = rows.where("song_id % 3 = 0").select("artist_lc", "title_lc", "duration_int", F.col("song_id").alias("cache_id"), "updated_at", F.when(F.col("updated_at") % 2 == 0, "found").otherwise("not_found").alias("status"))
    return rows.where("song_id % 3 <> 0"), cache


_SONGS = f"""{TRACKS_SQL}, songs AS (SELECT 'a' || CAST(part_id % 40 AS VARCHAR) AS artist_lc, 't' || CAST(supp_id % 20 AS VARCHAR) AS title_lc, CAST(seconds + cutoff_hz % 7 AS INTEGER) AS duration_int,
  album_id * 100 + position AS song_id, bitrate_bps AS updated_at FROM tracks), cache AS (SELECT artist_lc, title_lc, duration_int, song_id AS cache_id, updated_at, CASE WHEN updated_at % 2 = 0 THEN 'found' ELSE 'not_found' END AS status FROM songs WHERE song_id % 3 = 0),
  wanted AS (SELECT * FROM songs WHERE song_id % 3 <> 0)"""


def _lyrics_upsert(spark: SparkSession, d: str) -> DataFrame:
    wanted, cache = _songs(spark, d)
    found = wanted.select("artist_lc", "title_lc", "duration_int", F.col("song_id").alias("cache_id"), "updated_at", F.lit("found").alias("status"))
    return maintenance.lyrics_upsert(cache, found)


add(
    "lyrics_asof_all",
    lambda spark, d: maintenance.lyrics_lookup(*_songs(spark, d)),
    f"""WITH {_SONGS} SELECT w.song_id, max(c.m).cache_id AS cache_id, max(c.m).status AS status, max(c.m).updated_at AS updated_at FROM wanted w
  JOIN (SELECT artist_lc, title_lc, duration_int, max({{'updated_at': updated_at, 'cache_id': cache_id, 'status': status}}) AS m FROM cache GROUP BY ALL) c
  ON w.artist_lc = c.artist_lc AND w.title_lc = c.title_lc AND c.duration_int BETWEEN greatest(w.duration_int - 2, 0) AND w.duration_int + 2 GROUP BY w.song_id""",
)
add(
    "lyrics_window_upsert_all",
    _lyrics_upsert,
    f"""WITH {_SONGS} SELECT * FROM cache c WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.artist_lc = c.artist_lc AND w.title_lc = c.title_lc AND c.duration_int BETWEEN greatest(w.duration_int - 2, 0) AND w.duration_int + 2)
  UNION ALL SELECT artist_lc, title_lc, duration_int, song_id AS cache_id, updated_at, 'found' AS status FROM wanted""",
)
