"""More changes of the catalog as functions of tables: coercion, resets, pruning, re-keying, and the decisions before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needledrop.functions import text
from needledrop.operators.maintenance import KEY, keyed, last_for_key

#: Ranks of grades.
RANKS = {"F": 1, "C": 2, "B": 3, "A": 4, "S": 5}


def _number(c: str) -> Column:
    return F.when(text.is_number(F.col(c)), F.col(c).try_cast("double"))


def coerced(raw: DataFrame, now: int) -> DataFrame:
    """Rows of text columns as catalog values.

    year: four digits or 0; flags: 0 or 1; upscaled: 1 or YES, 0 or NO, else null; grade: one of S A B C F, with its rank;
    scores: numbers or null; last_checked_at: a number or now; current_quality: canonical if it is a profile.
    """
    flag = lambda c: F.when(F.col(c) == "1", 1).otherwise(0)
    grade = F.when(F.col("grade").rlike("^[SABCF]$"), F.col("grade"))
    quality = F.nullif(F.col("current_quality"), F.lit(""))
    return raw.select(
        "id",
        F.when(F.col("year").rlike("^[0-9]{4}$"), F.col("year").try_cast("int")).otherwise(0).alias("year_int"),
        flag("needs_recode").alias("needs_recode"), flag("needs_replacement").alias("needs_replacement"), flag("scan_failed").alias("scan_failed"),
        F.when(F.col("upscaled").isin("1", "YES"), 1).when(F.col("upscaled").isin("0", "NO"), 0).alias("is_upscaled"),
        grade.alias("quality_grade"), F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))[grade].alias("grade_rank"),
        _number("score").alias("quality_score"), F.coalesce(_number("last_checked_at"), F.lit(float(now))).cast("long").alias("last_checked_at"),
        F.coalesce(text.canonical_profile(quality), quality).alias("current_quality"), F.coalesce("notes", F.lit("")).alias("notes"),
    )


def rarity_upsert(albums: DataFrame, wanted: DataFrame, value: int) -> DataFrame:
    """artist_lc, album_lc, year_int, rarity: albums with rarity set for the wanted keys, which are added where they aren't there."""
    marks = wanted.select(*KEY).distinct().withColumn("_set", F.lit(value))
    both = albums.select(*KEY, "rarity").join(marks, list(KEY), "full_outer")
    return both.select(*KEY, F.coalesce("_set", "rarity").alias("rarity"))


#: Fixed value: what an album that was just recoded waits for.
PENDING = "Pending rescan"


def recoded(albums: DataFrame, queue: DataFrame, ids: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """The catalog and the queue after a recode of ids.

    Their rows want no recode and wait for a rescan: the present profile is kept as the source's, checked at 0, not failed,
    recoded now. Each of them stands in the queue as changed now, in place of what was there for its key (of several rows of
    a key the one with the highest id).
    """
    hit = F.col("_id").isNotNull()
    marked = albums.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left")
    changed = {
        "needs_recode": F.lit(0),
        "recode_recommendation": F.lit(PENDING),
        "recode_source_profile": F.coalesce(F.nullif(F.col("current_quality"), F.lit("")), F.col("recode_source_profile")),
        "last_checked_at": F.lit(0).cast("long"),
        "scan_failed": F.lit(0),
        "last_recoded_at": F.lit(now).cast("long"),
    }
    year = F.when(F.col("year_int").between(1000, 9999), F.col("year_int")).otherwise(0).alias("year_int")
    fresh = last_for_key(keyed(marked.where(hit)).withColumn("year_int", year), F.col("id").desc())
    fresh = fresh.select("artist", "artist_lc", "album", "album_lc", "year_int", "source_path", F.lit(now).cast("long").alias("album_mtime"), F.lit("changed").alias("scan_kind"), F.lit(now).cast("long").alias("enqueued_at"))
    catalog = marked.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changed.items()}).drop("_id")
    return catalog, queue.join(fresh, list(KEY), "left_anti").unionByName(fresh)


def removed(albums: DataFrame, queue: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalog without ids, and the queue without their paths or their keys."""
    gone = keyed(albums).join(ids.select("id").distinct(), "id", "left_semi")
    paths = gone.where("source_path is not null").select("source_path").distinct()
    keys = gone.select(*KEY).distinct()
    return albums.join(ids.select("id").distinct(), "id", "left_anti"), queue.join(paths, "source_path", "left_anti").join(keys, list(KEY), "left_anti")


def rescored(albums: DataFrame, scores: DataFrame) -> DataFrame:
    """id, quality_grade, grade_rank (0 without a grade), dynamic_range_score after new scores (id, grade, dr)."""
    s = scores.select(F.col("id").alias("_id"), F.col("grade").alias("_grade"), F.col("dr").alias("_dr"))
    there = F.col("_id").isNotNull()
    rank = F.coalesce(F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))[F.col("_grade")], F.lit(0))
    both = albums.join(s, F.col("id") == F.col("_id"), "left")
    return both.select("id", *(F.when(there, new).otherwise(F.col(old)).alias(old) for old, new in (("quality_grade", F.col("_grade")), ("grade_rank", rank), ("dynamic_range_score", F.col("_dr")))))


def without_stale_keys(albums: DataFrame, scanned: DataFrame) -> DataFrame:
    """albums less the rows whose path was scanned (source_path and key) under another key."""
    now = scanned.select("source_path", *(F.col(c).alias(f"_{c}") for c in KEY)).distinct()
    same = (F.col("artist_lc") == F.col("_artist_lc")) & (F.col("album_lc") == F.col("_album_lc")) & (F.col("year_int") == F.col("_year_int"))
    verdict = albums.join(now, "source_path", "left")
    return verdict.groupBy("id").agg(F.bool_or(F.col("_artist_lc").isNotNull()).alias("scanned"), F.coalesce(F.bool_or(same), F.lit(False)).alias("same")).where("not scanned or same").select("id")


def profiles_migrated(albums: DataFrame) -> DataFrame:
    """id, current_quality, profile_norm: canonical of the present profile, else of the old norm; text that is no profile stays."""
    one = F.coalesce(text.canonical_profile(F.col("current_quality")), text.canonical_profile(F.col("profile_norm")))
    return albums.select("id", F.when(F.coalesce("current_quality", F.lit("")) == "", F.col("current_quality")).otherwise(F.coalesce(text.canonical_profile(F.col("current_quality")), F.col("current_quality"))).alias("current_quality"), F.coalesce(one, F.lower("current_quality"), F.lit("")).alias("profile_norm"))


def relowered(albums: DataFrame) -> DataFrame:
    """albums (id, artist, album, year_int, artist_lc, album_lc) with both keys in lower case, where no other row has or gets that key.

    Of several rows that would get a key that nobody has, the lowest id gets it.
    """
    target = albums.withColumns({"_a": F.lower("artist"), "_b": F.lower("album")})
    stays = (F.col("artist_lc") == F.col("_a")) & (F.col("album_lc") == F.col("_b"))
    key = Window.partitionBy("_a", "_b", "year_int")
    target = target.withColumns({"_taken": F.max(F.when(stays, 1).otherwise(0)).over(key), "_n": F.row_number().over(key.orderBy(stays.cast("int"), "id"))})
    moves = ~stays & (F.col("_taken") == 0) & (F.col("_n") == 1)
    return target.select("id", "artist", "album", "year_int", F.when(moves, F.col("_a")).otherwise(F.col("artist_lc")).alias("artist_lc"), F.when(moves, F.col("_b")).otherwise(F.col("album_lc")).alias("album_lc"))


def failures(scans: DataFrame, now: int) -> DataFrame:
    """Rows for an upsert of scans (artist, album, year_int, profile, codec, error) that failed or found mixed content."""
    mixed = (F.col("profile") == "mixed") | (F.col("codec") == "mixed")
    note = F.when(mixed, F.concat(F.lit("mixed content detected: source_quality="), F.col("profile"), F.lit(" codec="), F.col("codec"), F.lit("; replace source"))).otherwise(F.col("error"))
    rows = scans.where(mixed | (F.coalesce("error", F.lit("")) != ""))
    kept = lambda c: F.when(mixed, F.col(c)).alias(c)
    return last_for_key(keyed(rows).select(*KEY, kept("codec"), F.lit(1).alias("scan_failed"), note.alias("notes"), F.when(mixed, 1).otherwise(0).alias("needs_replacement"), F.lit(now).cast("long").alias("last_checked_at"), "id"), F.col("id").desc()).drop("id")


def lyrics_flagged(albums: DataFrame, cached: DataFrame) -> DataFrame:
    """id, has_lyrics: 1 for albums with a cached song that was found (id, status)."""
    found = cached.where("status = 'found'").select(F.col("id").alias("_id")).distinct()
    return albums.join(found, F.col("id") == F.col("_id"), "left").select("id", F.when(F.col("_id").isNotNull(), 1).otherwise(0).alias("has_lyrics"))


def batch_plan(queue: DataFrame, gone_paths: DataFrame, n: int) -> DataFrame:
    """id, step: purge for items whose path is gone (they cost nothing), take for the first n others, wait for the rest."""
    marked = queue.where(F.col("scan_kind").isin("new", "changed")).join(gone_paths.select(F.col("source_path").alias("_p")).distinct(), F.col("source_path") == F.col("_p"), "left")
    rows = marked.select("id", "enqueued_at", F.when(F.col("scan_kind") == "new", 0).otherwise(1).alias("rank"), F.col("_p").isNotNull().alias("gone"))
    taken = rows.where("not gone").orderBy("rank", "enqueued_at", "id").limit(n).select(F.col("id").alias("_t"))
    return rows.join(taken, F.col("id") == F.col("_t"), "left").select("id", F.when(F.col("gone"), "purge").when(F.col("_t").isNotNull(), "take").otherwise("wait").alias("step"))


def cache_state(now: DataFrame, cached: DataFrame) -> DataFrame:
    """path, state of each path by its fingerprints (config, source): hit, partial (same source, other config) or miss."""
    c = cached.select(F.col("path").alias("_path"), F.col("config").alias("_config"), F.col("source").alias("_source"))
    same = F.col("_source") == F.col("source")
    return now.join(c, F.col("path") == F.col("_path"), "left").select("path", F.when(same & (F.col("_config") == F.col("config")), "hit").when(same, "partial").otherwise("miss").alias("state"))


def analysed_before(now: DataFrame, cached: DataFrame) -> DataFrame:
    """path, known of each path: whether its last analysis still holds, so that a run that asks for no details can end at once.

    now: path, ruleset, mode, source, config, details (boolean); cached: path, ruleset, mode, source, config, target (a
    profile, empty if it wasn't finished), done (boolean); at most one row for a path. Empty fingerprints hold for nothing.
    """
    c = cached.select(*(F.col(x).alias(f"_{x}") for x in ("path", "ruleset", "mode", "source", "config", "target", "done")))
    same = [F.col(x) == F.col(f"_{x}") for x in ("ruleset", "mode", "source", "config")]
    given = [F.col(x) != "" for x in ("_source", "_config", "_target")]
    known = ~F.col("details") & F.col("_done")
    for test in (*same, *given):
        known = known & test
    return now.join(c, F.col("path") == F.col("_path"), "left").select("path", F.coalesce(known, F.lit(False)).alias("known"))


#: After how many seconds each backup is made anew.
BACKUPS = {"daily": 86_400, "weekly": 604_800, "monthly": 2_592_000}


def backups_due(libraries: DataFrame, backups: DataFrame, now: int, force: bool = False) -> DataFrame:
    """library, period, step of each library that is sound (library, sound) and each period: keep, make or replace its backup.

    backups: library, period, mtime (null: unknown), valid. One that isn't valid is replaced whatever its age, a valid one if it
    is as old as its period or that is forced. Libraries that aren't sound get none, so good backups stay.
    """
    periods = F.explode(F.create_map(*(F.lit(x) for pair in BACKUPS.items() for x in pair)))
    rows = libraries.where("sound").select("library", periods.alias("period", "_age"))
    b = backups.select(F.col("library").alias("_l"), F.col("period").alias("_p"), F.coalesce("mtime", F.lit(0)).alias("_mtime"), F.col("valid").alias("_valid"))
    rows = rows.join(b, (F.col("library") == F.col("_l")) & (F.col("period") == F.col("_p")), "left")
    fresh = F.col("_valid") & F.lit(not force) & (F.lit(now) - F.col("_mtime") < F.col("_age"))
    return rows.select("library", "period", F.when(F.col("_l").isNull(), "make").when(fresh, "keep").otherwise("replace").alias("step"))


def lossy_decision(lossy: Column, grade: Column, recode: Column) -> Column:
    """recommendation, recode text, whether replacing is called for, of an album: lossy ones of grade C or F are replaced."""
    poor = lossy & grade.isin("C", "F")
    return F.struct(F.when(poor, "Replace with Lossless Rip").otherwise("Keep").alias("recommendation"), F.when(poor, "Replace with lossless").when(lossy, "Keep as-is").otherwise(recode).alias("recode"), F.coalesce(poor, F.lit(False)).alias("replace"))


def actionable(recode: Column) -> Column:
    """Whether a recode text calls for work."""
    return F.coalesce((recode != "") & (recode != "Keep as-is") & ~recode.startswith(PENDING), F.lit(False))


def matches_target(tracks: DataFrame, targets: DataFrame) -> DataFrame:
    """album_id, matches: every track has the target's rate and at least its depth (targets: album_id, rate, depth)."""
    rows = tracks.join(targets, "album_id")
    return rows.groupBy("album_id").agg(F.bool_and((F.col("sr") == F.col("rate")) & (F.col("bits") >= F.col("depth"))).alias("matches"))


def by_path_or_key(wanted: DataFrame, albums: DataFrame) -> DataFrame:
    """wanted_id, id: the catalog row of the same path, else of the same key (the lowest id of several)."""
    by_path = albums.groupBy("source_path").agg(F.min("id").alias("_by_path"))
    by_key = albums.groupBy(*KEY).agg(F.min("id").alias("_by_key"))
    return wanted.join(by_path, "source_path", "left").join(by_key, list(KEY), "left").select("wanted_id", F.coalesce("_by_path", "_by_key").alias("id"))


def run_counters(outcomes: DataFrame) -> DataFrame:
    """One row: how many outcomes (status ok, warn, fail) of each kind, all, and whether the run counts as failed."""
    n = lambda s: F.count_if(F.col("status") == s)
    return outcomes.agg(n("ok").alias("ok"), n("warn").alias("warn"), n("fail").alias("fail"), F.count("*").alias("total"), (n("fail") > 0).alias("failed"))
