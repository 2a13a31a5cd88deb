"""Queries of changes to the catalog, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from needledrop.functions import text
from needledrop.operators import mutations
from needledrop.operators.catalog_queries import Query, canonical_sql
from needledrop.operators.maintenance import keyed, last_for_key
from needledrop.sources.bind import ALBUMS_SQL, TRACKS_SQL, _pick, albums, choose, table, tracks

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = 1_800_000_000


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


YEARS, FLAGS, UPS, GRADES = ("1999", "99", "", "20x1"), ("1", "0", "yes", ""), ("YES", "NO", "1", "0", "?"), ("S", "A", "B", "C", "F", "D", "")
SCORES, CHECKED, QUALITIES = ("12.5", "-3", "x", ""), ("1700000000", "", "soon"), ("44.1/16", "mixed", "", "9624")


def _raw(spark, d):
    k = F.col("id")
    return albums(spark, d).select("id", choose(YEARS, k).alias("year"), choose(FLAGS, k).alias("needs_recode"), choose(FLAGS, k + 1).alias("needs_replacement"), choose(FLAGS, k + 2).alias("scan_failed"), choose(UPS, k).alias("upscaled"), choose(GRADES, k).alias("grade"), choose(SCORES, k).alias("score"), choose(CHECKED, k).alias("last_checked_at"), choose(QUALITIES, k).alias("current_quality"), "notes")


add(
    "coerced_rows",
    lambda spark, d: mutations.coerced(_raw(spark, d), NOW),
    f"""WITH {ALBUMS_SQL} SELECT id, CASE WHEN id % 4 = 0 THEN 1999 ELSE 0 END AS year_int, CAST(id % 4 = 0 AS INTEGER) AS needs_recode, CAST(id % 4 = 3 AS INTEGER) AS needs_replacement, CAST(id % 4 = 2 AS INTEGER) AS scan_failed,
      list_extract([1, 0, 1, 0, NULL], CAST(id % 5 + 1 AS BIGINT)) AS is_upscaled, list_extract(['S', 'A', 'B', 'C', 'F', NULL, NULL], CAST(id % 7 + 1 AS BIGINT)) AS quality_grade, list_extract([5, 4, 3, 2, 1, NULL, NULL], CAST(id % 7 + 1 AS BIGINT)) AS grade_rank,
      list_extract([12.5, -3.0, NULL, NULL]::DOUBLE[], CAST(id % 4 + 1 AS BIGINT)) AS quality_score, CASE WHEN id % 3 = 0 THEN 1700000000 ELSE {NOW} END AS last_checked_at,
      list_extract(['44100/16', 'mixed', NULL, '96000/24'], CAST(id % 4 + 1 AS BIGINT)) AS current_quality, coalesce(notes, '') AS notes FROM albums""",
)
_KEYED = f"{ALBUMS_SQL}, k AS (SELECT *, lower(artist) AS artist_lc, lower(album) AS album_lc FROM albums)"
add(
    "rarity_upsert",
    lambda spark, d: mutations.rarity_upsert(keyed(albums(spark, d)).where("id % 4 <> 1").groupBy("artist_lc", "album_lc", "year_int").agg(F.max("rarity").alias("rarity")), keyed(albums(spark, d)).where("id % 9 = 1"), 1),
    f"""WITH {_KEYED}, t AS (SELECT artist_lc, album_lc, year_int, max(rarity) AS rarity FROM k WHERE id % 4 <> 1 GROUP BY ALL), w AS (SELECT DISTINCT artist_lc, album_lc, year_int FROM k WHERE id % 9 = 1)
    SELECT artist_lc, album_lc, year_int, CASE WHEN w.artist_lc IS NOT NULL THEN 1 ELSE rarity END AS rarity FROM t FULL JOIN w USING (artist_lc, album_lc, year_int)""",
)


def _after_recode(spark, d):
    a = albums(spark, d).withColumn("recode_source_profile", F.lit("old"))
    waiting = keyed(a).where("id % 10 < 6").select("artist", "artist_lc", "album", "album_lc", "year_int", "source_path", F.lit(7).cast("long").alias("album_mtime"), F.lit("new").alias("scan_kind"), (F.col("id") % 1000).alias("enqueued_at"))
    return mutations.recoded(a, last_for_key(waiting, F.col("enqueued_at"), F.col("source_path")), a.where("needs_recode = 1").select("id"), NOW)


_RECODE_FIELDS = ("id", "needs_recode", "recode_recommendation", "current_quality", "recode_source_profile", "last_checked_at", "scan_failed", "last_recoded_at")
add(
    "after_recode",
    lambda spark, d: _after_recode(spark, d)[0].select(*_RECODE_FIELDS),
    f"""WITH {ALBUMS_SQL} SELECT id, 0 AS needs_recode, CASE WHEN needs_recode = 1 THEN 'Pending rescan' ELSE recode_recommendation END AS recode_recommendation, current_quality, CASE WHEN needs_recode = 1 AND current_quality <> '' THEN current_quality ELSE 'old' END AS recode_source_profile,
      CASE WHEN needs_recode = 1 THEN 0 ELSE last_checked_at END AS last_checked_at, CASE WHEN needs_recode = 1 THEN 0 ELSE scan_failed END AS scan_failed, CASE WHEN needs_recode = 1 THEN {NOW} ELSE last_recoded_at END AS last_recoded_at FROM albums""",
)
add(
    "after_recode_queue",
    lambda spark, d: _after_recode(spark, d)[1],
    f"""WITH {ALBUMS_SQL}, k AS (SELECT *, lower(artist) AS artist_lc, lower(album) AS album_lc FROM albums),
    n AS (SELECT artist, artist_lc, album, album_lc, year_int, source_path, {NOW} AS album_mtime, 'changed' AS scan_kind, {NOW} AS enqueued_at, row_number() OVER (PARTITION BY artist_lc, album_lc, year_int ORDER BY id DESC) AS r FROM k WHERE needs_recode = 1),
    q AS (SELECT artist, artist_lc, album, album_lc, year_int, source_path, 7 AS album_mtime, 'new' AS scan_kind, id % 1000 AS enqueued_at, row_number() OVER (PARTITION BY artist_lc, album_lc, year_int ORDER BY id % 1000, source_path) AS r FROM k WHERE id % 10 < 6)
    SELECT * EXCLUDE (r) FROM n WHERE r = 1 UNION ALL SELECT * EXCLUDE (r) FROM q WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM n WHERE n.artist_lc = q.artist_lc AND n.album_lc = q.album_lc AND n.year_int = q.year_int)""",
)


def _queue(spark, d):
    k = keyed(albums(spark, d))
    return k.select("id", "artist_lc", "album_lc", "year_int", F.when(F.col("id") % 3 == 0, F.concat("source_path", F.lit("/moved"))).otherwise(F.col("source_path")).alias("source_path"), choose(("new", "changed", "other"), F.col("id")).alias("scan_kind"), (F.col("id") % 1000).alias("enqueued_at")).where("id % 2 = 0")


_QUEUE = f"{_KEYED}, q AS (SELECT id, artist_lc, album_lc, year_int, CASE WHEN id % 3 = 0 THEN source_path || '/moved' ELSE source_path END AS source_path, {_pick(('new', 'changed', 'other'), 'id')} AS scan_kind, id % 1000 AS enqueued_at FROM k WHERE id % 2 = 0)"
add("full_remove_catalog", lambda spark, d: mutations.removed(albums(spark, d), _queue(spark, d), albums(spark, d).where("rarity = 1"))[0].select("id"), f"WITH {ALBUMS_SQL} SELECT id FROM albums WHERE rarity <> 1")
add(
    "full_remove_queue",
    lambda spark, d: mutations.removed(albums(spark, d), _queue(spark, d), albums(spark, d).where("rarity = 1"))[1].select("id"),
    f"WITH {_QUEUE}, g AS (SELECT * FROM k WHERE rarity = 1) SELECT id FROM q WHERE source_path NOT IN (SELECT source_path FROM g) AND (artist_lc, album_lc, year_int) NOT IN (SELECT (artist_lc, album_lc, year_int) FROM g)",
)
add(
    "rescored",
    lambda spark, d: mutations.rescored(albums(spark, d).select("id", F.lit("B").alias("quality_grade"), F.lit(3).alias("grade_rank"), "dynamic_range_score"), albums(spark, d).where("id % 3 = 0").select("id", choose(("S", "F", ""), F.col("id")).alias("grade"), F.lit(9.5).alias("dr"))),
    f"WITH {ALBUMS_SQL}, s AS (SELECT *, {_pick(('S', 'F', ''), 'id')} AS g FROM albums) SELECT id, CASE WHEN id % 3 = 0 THEN g ELSE 'B' END AS quality_grade, CASE WHEN id % 3 <> 0 THEN 3 WHEN g = 'S' THEN 5 WHEN g = 'F' THEN 1 ELSE 0 END AS grade_rank, CASE WHEN id % 3 = 0 THEN 9.5 ELSE dynamic_range_score END AS dynamic_range_score FROM s",
)
add(
    "without_stale_keys",
    lambda spark, d: mutations.without_stale_keys(keyed(albums(spark, d)), keyed(albums(spark, d)).where("id % 2 = 0").withColumn("year_int", F.when(F.col("id") % 4 == 0, F.col("year_int") + 1).otherwise(F.col("year_int")))),
    f"WITH {ALBUMS_SQL} SELECT id FROM albums WHERE id % 4 <> 0",
)
add(
    "profiles_migrated",
    lambda spark, d: mutations.profiles_migrated(albums(spark, d).select("id", "current_quality", F.when(F.col("id") % 2 == 0, "48/24").otherwise("junk").alias("profile_norm"))),
    f"""WITH {ALBUMS_SQL}, c AS (SELECT *, map {{'44.1/16': '44100/16', '96-24': '96000/24', '48k/24': '48000/24', '192000/32f': '192000/32f', '44100/16': '44100/16', '88.2/24': '88200/24'}}[current_quality] AS canon FROM albums)
    SELECT id, coalesce(canon, current_quality) AS current_quality, coalesce(canon, CASE WHEN id % 2 = 0 THEN '48000/24' ELSE lower(current_quality) END) AS profile_norm FROM c""",
)


def _relowered(spark, d):
    a = albums(spark, d).select("id", F.concat(F.lit("Artist "), (F.col("id") % 40).cast("string")).alias("artist"), F.lit("Al").alias("album"), (F.col("id") % 7).cast("int").alias("year_int"))
    return mutations.relowered(a.select("*", F.when(F.col("id") % 5 == 0, F.lower("artist")).otherwise(F.col("artist")).alias("artist_lc"), F.lower("album").alias("album_lc")))


add(
    "relowered",
    _relowered,
    f"""WITH {ALBUMS_SQL}, a AS (SELECT id, 'Artist ' || CAST(id % 40 AS VARCHAR) AS artist, 'Al' AS album, CAST(id % 7 AS INTEGER) AS year_int, id % 5 = 0 AS low FROM albums),
    b AS (SELECT *, max(CAST(low AS INTEGER)) OVER (PARTITION BY artist, year_int) AS taken, min(id) OVER (PARTITION BY artist, year_int) AS least FROM a)
    SELECT id, artist, album, year_int, CASE WHEN low OR (taken = 0 AND id = least) THEN lower(artist) ELSE artist END AS artist_lc, 'al' AS album_lc FROM b""",
)


def _scans(spark, d):
    k = F.col("id")
    return albums(spark, d).select("id", "artist", "album", "year_int", choose(("mixed", "44100/16"), k).alias("profile"), choose(("flac", "mixed", "mp3"), k).alias("codec"), F.when(k % 7 == 0, "probe failed").alias("error"))


add(
    "failure_rows",
    lambda spark, d: mutations.failures(_scans(spark, d), NOW),
    f"""WITH {_KEYED}, s AS (SELECT *, {_pick(('mixed', '44100/16'), 'id')} AS p, {_pick(('flac', 'mixed', 'mp3'), 'id')} AS c FROM k), m AS (SELECT *, p = 'mixed' OR c = 'mixed' AS mixed FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY artist_lc, album_lc, year_int ORDER BY id DESC) AS n FROM m WHERE mixed OR id % 7 = 0)
    SELECT artist_lc, album_lc, year_int, CASE WHEN mixed THEN c END AS codec, 1 AS scan_failed, CASE WHEN mixed THEN 'mixed content detected: source_quality=' || p || ' codec=' || c || '; replace source' ELSE 'probe failed' END AS notes, CAST(mixed AS INTEGER) AS needs_replacement, {NOW}::BIGINT AS last_checked_at FROM r WHERE n = 1""",
)
add(
    "lyrics_flags",
    lambda spark, d: mutations.lyrics_flagged(albums(spark, d), tracks(spark, d).select(F.col("album_id").alias("id"), choose(("found", "not_found", "error"), F.col("part_id")).alias("status"))),
    f"WITH {ALBUMS_SQL}, {TRACKS_SQL} SELECT id, CAST(id IN (SELECT album_id FROM tracks WHERE part_id % 3 = 0) AS INTEGER) AS has_lyrics FROM albums",
)
add(
    "batch_plan",
    lambda spark, d: mutations.batch_plan(_queue(spark, d), _queue(spark, d).where("id % 10 = 0"), 50),
    f"""WITH {_QUEUE}, m AS (SELECT *, source_path IN (SELECT source_path FROM q WHERE id % 10 = 0) AS gone FROM q WHERE scan_kind <> 'other'), t AS (SELECT id FROM m WHERE NOT gone ORDER BY scan_kind = 'changed', enqueued_at, id LIMIT 50)
    SELECT id, CASE WHEN gone THEN 'purge' WHEN id IN (SELECT id FROM t) THEN 'take' ELSE 'wait' END AS step FROM m""",
)
add(
    "analysis_cache",
    lambda spark, d: mutations.cache_state(albums(spark, d).select(F.col("id").alias("path"), F.lit("c2").alias("config"), (F.col("id") % 5).alias("source")), albums(spark, d).where("id % 3 <> 0").select(F.col("id").alias("path"), choose(("c1", "c2"), F.col("id")).alias("config"), (F.col("id") % 4).alias("source"))),
    f"WITH {ALBUMS_SQL} SELECT id AS path, CASE WHEN id % 3 = 0 OR id % 5 <> id % 4 THEN 'miss' WHEN id % 2 = 1 THEN 'hit' ELSE 'partial' END AS state FROM albums",
)
add(
    "lossy_decisions",
    lambda spark, d: albums(spark, d).select("id", mutations.lossy_decision(F.col("id") % 2 == 0, choose(GRADES, F.col("id")), F.col("recode_recommendation")).alias("k")).select("id", "k.*").withColumn("actionable", mutations.actionable(F.col("recode"))),
    f"""WITH {ALBUMS_SQL}, p AS (SELECT *, id % 2 = 0 AND id % 7 IN (3, 4) AS poor FROM albums), r AS (SELECT *, CASE WHEN poor THEN 'Replace with lossless' WHEN id % 2 = 0 THEN 'Keep as-is' ELSE recode_recommendation END AS recode FROM p)
    SELECT id, CASE WHEN poor THEN 'Replace with Lossless Rip' ELSE 'Keep' END AS recommendation, recode, poor AS replace, coalesce(recode <> '' AND recode <> 'Keep as-is' AND NOT starts_with(recode, 'Pending rescan'), false) AS actionable FROM r""",
)
add(
    "matches_target",
    lambda spark, d: mutations.matches_target(tracks(spark, d), tracks(spark, d).where("position = 1").select("album_id", F.col("sr").alias("rate"), F.col("bits").alias("depth"))),
    f"WITH {TRACKS_SQL}, t AS (SELECT album_id, sr AS rate, bits AS depth FROM tracks WHERE position = 1) SELECT album_id, bool_and(sr = rate AND bits >= depth) AS matches FROM tracks JOIN t USING (album_id) GROUP BY album_id",
)
add(
    "by_path_or_key",
    lambda spark, d: mutations.by_path_or_key(_queue(spark, d).withColumnRenamed("id", "wanted_id"), keyed(albums(spark, d)).where("id % 8 <> 0")),
    f"""WITH {_QUEUE}, h AS (SELECT * FROM k WHERE id % 8 <> 0), p AS (SELECT source_path, min(id) AS i FROM h GROUP BY ALL), e AS (SELECT artist_lc, album_lc, year_int, min(id) AS j FROM h GROUP BY ALL)
    SELECT q.id AS wanted_id, coalesce(i, j) AS id FROM q LEFT JOIN p USING (source_path) LEFT JOIN e USING (artist_lc, album_lc, year_int)""",
)
add(
    "run_counters",
    lambda spark, d: mutations.run_counters(albums(spark, d).select(F.when(F.col("scan_failed") == 1, "fail").when(F.col("needs_recode") == 1, "warn").otherwise("ok").alias("status"))),
    f"WITH {ALBUMS_SQL} SELECT count(*) FILTER (scan_failed <> 1 AND needs_recode <> 1) AS ok, count(*) FILTER (scan_failed <> 1 AND needs_recode = 1) AS warn, count(*) FILTER (scan_failed = 1) AS fail, count(*) AS total, count(*) FILTER (scan_failed = 1) > 0 AS failed FROM albums",
)
MODES = ("fast", "exact", "")


def _analysed(spark, d):
    a, k = albums(spark, d), F.col("id")
    now = a.select(k.alias("path"), F.lit("v3").alias("ruleset"), choose(MODES, k).alias("mode"), (k % 5).cast("string").alias("source"), (k % 7).cast("string").alias("config"), (k % 11 == 0).alias("details"))
    cached = a.where("id % 6 <> 5").select(k.alias("path"), choose(("v3", "v3", "v3", "v2"), k).alias("ruleset"), choose(MODES, k + F.when(k % 8 == 0, 1).otherwise(0)).alias("mode"), F.when(k % 10 != 0, (k % 5).cast("string")).otherwise("").alias("source"), F.when(k % 9 != 0, (k % 7).cast("string")).alias("config"), F.when(k % 13 != 0, "44100/16").otherwise("").alias("target"), (k % 17 != 0).alias("done"))
    return mutations.analysed_before(now, cached)


add(
    "analysed_before",
    _analysed,
    f"WITH {ALBUMS_SQL} SELECT id AS path, id % 11 <> 0 AND id % 6 <> 5 AND id % 4 <> 3 AND id % 8 <> 0 AND id % 10 <> 0 AND id % 9 <> 0 AND id % 13 <> 0 AND id % 17 <> 0 AS known FROM albums",
)


def _backups(spark, d):
    """Suppliers' libraries, with backups made at the times of events."""
    made = table(spark, d, "events").groupBy((F.col("user_id") % 100 + 1).alias("library"), F.col("event_type")).agg(F.max(F.unix_timestamp("ts")).alias("mtime"), F.min("event_id").alias("k"))
    backups = made.where("event_type in ('click', 'view', 'signup')").select("library", F.when(F.col("event_type") == "click", "daily").when(F.col("event_type") == "view", "weekly").otherwise("monthly").alias("period"), F.when(F.col("k") % 9 != 0, F.col("mtime") - F.col("k") % 40 * 86_400).alias("mtime"), (F.col("k") % 4 != 0).alias("valid"))
    return mutations.backups_due(table(spark, d, "supplier").select(F.col("s_suppkey").alias("library"), (F.col("s_suppkey") % 6 != 0).alias("sound")), backups, 1_706_700_000)


add(
    "backup_due",
    _backups,
    """WITH m AS (SELECT user_id % 100 + 1 AS library, CASE event_type WHEN 'click' THEN 'daily' WHEN 'view' THEN 'weekly' ELSE 'monthly' END AS period, CAST(floor(epoch(max(ts))) AS BIGINT) AS mtime, min(event_id) AS k FROM events WHERE event_type IN ('click', 'view', 'signup') GROUP BY 1, 2, event_type),
    p AS (SELECT s_suppkey AS library, period, age FROM supplier, (VALUES ('daily', 86400), ('weekly', 604800), ('monthly', 2592000)) v(period, age) WHERE s_suppkey % 6 <> 0)
    SELECT p.library, p.period, CASE WHEN k IS NULL THEN 'make' WHEN k % 4 <> 0 AND 1706700000 - CASE WHEN k % 9 <> 0 THEN mtime - k % 40 * 86400 ELSE 0 END < age THEN 'keep' ELSE 'replace' END AS step FROM p LEFT JOIN m ON p.library = m.library AND p.period = m.period""",
)
CELLS = ("12", "-3.5", "1.", "+4", "1e5", "", " 7", "0007")
add(
    "plain_numbers",
    lambda spark, d: table(spark, d, "customer").select("c_custkey", choose(CELLS, F.col("c_custkey")).alias("x")).where(text.is_number(F.col("x"))),
    f"WITH c AS (SELECT c_custkey, {_pick(CELLS, 'c_custkey')} AS x FROM customer) SELECT c_custkey, x FROM c WHERE x IN ('12', '-3.5', '0007')",
)
SOURCES = ("", "96 kHz/32f", "88.2/20", "x", "48000/64f", "192/24")
HINTS = ("Recode to 44.1k/16", "Keep as-is", "", "to 96-24 soon")


def _targets(spark, d):
    k = F.col("id")
    # The profiles are columns of their own first: worked out once, not once for each use.
    rows = albums(spark, d).select(k, choose(HINTS, F.floor(k / 3)).alias("recode"), choose(("dts", " DCA", "flac"), k).alias("codec"), text.canonical_profile(F.col("current_quality")).alias("current"), text.canonical_profile(choose(SOURCES, F.floor(k / 7))).alias("source"), "needs_replacement")
    return rows.select(k, text.recode_target(F.col("recode"), F.col("codec"), F.col("current"), F.col("source"), F.col("needs_replacement")).alias("target"), text.replacement_profile(F.col("current")).alias("replacement"))


add(
    "replacement_target",
    _targets,
    f"""WITH {ALBUMS_SQL}, c AS (SELECT id, needs_replacement = 1 AND id % 3 <> 2 AS surround, {_pick(("44100/16", "", "", "96000/24"), "id // 3")} AS named, {_pick(("", "96000/24", "88200/16", "", "48000/24", "192000/24"), "id // 7")} AS source, {canonical_sql("current_quality")} AS p FROM albums),
    r AS (SELECT *, split_part(p, '/', 1) || CASE WHEN split_part(p, '/', 2) IN ('24', '32', '32f', '64f') THEN '/24' ELSE '/16' END AS replacement FROM c)
    SELECT id, coalesce(nullif(named, ''), CASE WHEN surround THEN coalesce(nullif(source, ''), replacement) END) AS target, replacement FROM r""",
)
