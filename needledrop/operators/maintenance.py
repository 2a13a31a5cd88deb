"""Catalog maintenance as pure functions of tables: upserts, the work queue, change detection, lookups with tolerance.

Nothing is changed in place: each function returns the new table, to be written beside the old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from needledrop.operators.partitions import dealt

#: What an upsert does with each column of the catalog: always the new value, the new one unless null, or always the old.
OVERWRITE = ("artist", "album", "quality_score", "needs_recode", "needs_replacement", "last_checked_at", "scan_failed", "notes")
KEEP_IF_NULL = (
    "quality_grade", "grade_rank", "dynamic_range_score", "is_upscaled", "recommendation", "current_quality", "profile_norm", "bitrate", "codec", "codec_norm",
    "genre_tag", "genre_profile", "recode_recommendation", "recode_source_profile", "source_path",
)
UNTOUCHED = ("rarity", "has_lyrics", "last_recoded_at")
KEY = ("artist_lc", "album_lc", "year_int")


def keyed(albums: DataFrame) -> DataFrame:
    return albums.withColumns({"artist_lc": F.lower("artist"), "album_lc": F.lower("album")})


def last_for_key(rows: DataFrame, *by) -> DataFrame:
    """One row for each key: the last in the given order."""
    newest = Window.partitionBy(*KEY).orderBy(*by)
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def upsert(target: DataFrame, source: DataFrame) -> DataFrame:
    """target with the rows of source put in by (artist, album, year), under the policy of each column.

    One full outer join on the key. Both sides have at most one row for a key (see last_for_key). A scan that found no
    grade, dynamic range or profile leaves the old ones; its score, flags, notes and time always count.
    """
    s = source.select(*(F.col(c).alias(f"s_{c}") for c in source.columns))
    on = [F.col(c) == F.col(f"s_{c}") for c in KEY]
    both = target.join(s, on[0] & on[1] & on[2], "full_outer")
    new = F.col("s_artist_lc").isNotNull()
    columns = [F.coalesce(c, f"s_{c}").alias(c) for c in KEY]
    columns += [F.when(new, F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in OVERWRITE]
    columns += [F.coalesce(f"s_{c}", c).alias(c) for c in KEEP_IF_NULL]
    columns += [(F.coalesce(c, F.lit(0)) if c != "last_recoded_at" else F.col(c)).alias(c) for c in UNTOUCHED]
    return both.select(*columns)


def set_rarity(albums: DataFrame, ids: DataFrame, value: int) -> DataFrame:
    """albums with rarity set on the rows whose id is in ids (a column id)."""
    marked = ids.select(F.col("id").alias("_id")).distinct()
    return albums.join(marked, F.col("id") == F.col("_id"), "left").withColumn("rarity", F.when(F.col("_id").isNotNull(), value).otherwise(F.col("rarity"))).drop("_id")


def requeue(albums: DataFrame, queue: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalog without ids, and the queue with their rows that have a path, as new ones of time 0."""
    gone = albums.join(ids, "id", "left_semi")
    added = keyed(gone).where("source_path is not null and source_path <> ''").select("artist", "artist_lc", "album", "album_lc", "year_int", "source_path", F.lit("new").alias("scan_kind"), F.lit(0).cast("long").alias("enqueued_at"))
    added = last_for_key(added, F.col("source_path"))
    kept = queue.join(added, list(KEY), "left_anti")
    return albums.join(ids, "id", "left_anti"), kept.unionByName(added)


def next_items(queue: DataFrame, n: int) -> DataFrame:
    """The first n items: new before changed, first in first out, then id. Other kinds are never taken."""
    rank = F.when(F.col("scan_kind") == "new", 0).otherwise(1)
    return queue.where(F.col("scan_kind").isin("new", "changed")).orderBy(rank, "enqueued_at", "id").limit(n)


def classify(listing: DataFrame, albums: DataFrame, now: int, retry: int = 7 * 86_400) -> DataFrame:
    """path, outcome for each listed directory: unchanged, no_key, fail_hold, changed or new; those without files go.

    listing: path, artist_lc, album_lc, year_int, dir_mtime, content_mtime, n_files. By the known path first, then by key.
    A failed album whose retry is due still counts as unchanged unless its content is newer, as the steps stand.
    """
    by_path = albums.where("scan_failed = 0").select(F.col("source_path").alias("_path"), F.col("last_checked_at").alias("_path_checked"))
    by_key = albums.select(*(F.col(c).alias(f"_{c}") for c in KEY), F.col("last_checked_at").alias("_checked"), F.col("scan_failed").alias("_failed"))
    rows = listing.join(by_path, F.col("path") == F.col("_path"), "left")
    rows = rows.join(by_key, (F.col("artist_lc") == F.col("_artist_lc")) & (F.col("album_lc") == F.col("_album_lc")) & (F.col("year_int") == F.col("_year_int")), "left")
    checked = F.coalesce("_checked", F.lit(0))
    content = F.greatest("content_mtime", "dir_mtime")
    known = F.col("_path").isNotNull() & (F.col("dir_mtime") > 0) & (F.coalesce("_path_checked", F.lit(0)) > 0) & (F.col("dir_mtime") <= F.col("_path_checked"))
    there = F.col("_artist_lc").isNotNull()
    hold = there & (F.col("_failed") == 1) & ~((checked > 0) & (content > checked)) & ~(F.lit(now) - checked >= retry)
    outcome = (
        F.when(known, "unchanged")
        .when(F.col("n_files") == 0, F.lit(None))
        .when((F.coalesce("artist_lc", F.lit("")) == "") | (F.coalesce("album_lc", F.lit("")) == ""), "no_key")
        .when(hold, "fail_hold")
        .when(there & (checked > 0) & (content <= checked), "unchanged")
        .when(there, "changed")
        .otherwise("new")
    )
    return rows.select("path", outcome.alias("outcome")).where("outcome is not null")


def missing(albums: DataFrame, listing: DataFrame) -> DataFrame:
    """Albums whose path isn't listed."""
    return albums.join(listing.select(F.col("path").alias("_path")), F.col("source_path") == F.col("_path"), "left_anti")


def lyrics_lookup(wanted: DataFrame, cache: DataFrame, tolerance: int = 2) -> DataFrame:
    """For each wanted song the newest cache row of its artist and title within the tolerance of its seconds."""
    # The newest of each artist, title and length that a wanted song may have: it meets one row at most, by equal keys.
    c = cache.where("duration_int >= 0").groupBy(F.col("artist_lc").alias("_artist"), F.col("title_lc").alias("_title"), F.col("duration_int").alias("_seconds")).agg(F.max(F.struct(F.col("updated_at").alias("_at"), "cache_id", "status")).alias("newest"))
    reach = F.explode(F.sequence(F.col("_seconds") - tolerance, F.col("_seconds") + tolerance)).alias("_wanted")
    c = c.select("_artist", "_title", reach, "newest").groupBy("_artist", "_title", "_wanted").agg(F.max("newest").alias("newest"))
    found = wanted.join(c, (F.col("artist_lc") == F.col("_artist")) & (F.col("title_lc") == F.col("_title")) & (F.col("duration_int") == F.col("_wanted"))).select("song_id", "newest")
    best = dealt(found, "song_id", like=wanted).groupBy("song_id").agg(F.max("newest").alias("m"))
    return best.select("song_id", F.col("m.cache_id").alias("cache_id"), F.col("m.status").alias("status"), F.col("m._at").alias("updated_at"))


def lyrics_upsert(cache: DataFrame, found: DataFrame, tolerance: int = 2) -> DataFrame:
    """The cache without rows within the tolerance of a found song, and the found songs."""
    f = found.select(F.col("artist_lc").alias("_artist"), F.col("title_lc").alias("_title"), F.col("duration_int").alias("_seconds")).distinct()
    near = (F.col("artist_lc") == F.col("_artist")) & (F.col("title_lc") == F.col("_title")) & F.col("duration_int").between(F.greatest(F.col("_seconds") - tolerance, F.lit(0)), F.col("_seconds") + tolerance)
    return cache.join(f, near, "left_anti").unionByName(found)
