"""Queries of sizes, routes, logs, artwork and reports, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from needledrop.functions import paths, routing, sizes, text
from needledrop.operators import fingerprints, logs, reports
from needledrop.operators.catalog_queries import Query, canonical_sql, grade_sql
from needledrop.plans import planning
from needledrop.sources.bind import ALBUMS_SQL, PROFILES, TRACKS_SQL, _pick, albums, choose, table, tracks

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


_UNIT = "CASE WHEN b >= 1099511627776 THEN 4 WHEN b >= 1073741824 THEN 3 WHEN b >= 1048576 THEN 2 WHEN b >= 1024 THEN 1 ELSE 0 END"
add(
    "size_labels",
    lambda spark, d: tracks(spark, d).select("album_id", "position", (F.floor(F.pow(F.lit(1.7), F.col("position") % 8 * 6 + F.col("part_id") % 8)).cast("long") + F.col("part_id")).alias("b")).select("album_id", "position", sizes.transfer_size(F.col("b")).alias("label"), sizes.short_size(F.col("b")).alias("short")),
    f"""WITH {TRACKS_SQL}, z AS (SELECT album_id, position, CAST(floor(pow(1.7::DOUBLE, position % 8 * 6 + part_id % 8)) AS BIGINT) + part_id AS b FROM tracks), u AS (SELECT *, {_UNIT} AS p, CAST(pow(1024, {_UNIT}) AS BIGINT) AS u FROM z),
  t AS (SELECT *, b // u AS whole, ((b % u) * 10 + u // 2) // u AS tenth, b / CAST(u AS DOUBLE) AS x FROM u), r AS (SELECT *, CASE WHEN tenth >= 10 THEN whole + 1 ELSE whole END AS w, CASE WHEN tenth >= 10 THEN 0 ELSE tenth END AS f FROM t)
  SELECT album_id, position, CASE WHEN p = 0 THEN b || 'b' ELSE CASE WHEN w >= 100 OR f = 0 THEN w || '' ELSE w || '.' || f END || list_extract(['Kb', 'Mb', 'Gb', 'Tb'], p) END AS label,
    CASE WHEN p = 0 THEN b || 'B' ELSE CASE WHEN x >= 100 THEN printf('%.0f', round_even(x, 0)) WHEN x >= 10 THEN printf('%.1f', round_even(x, 1)) ELSE printf('%.2f', round_even(x, 2)) END || list_extract(['K', 'M', 'G', 'T'], p) END AS short FROM r""",
)
add(
    "track_gains",
    lambda spark, d: planning.track_gains(
        tracks(spark, d).select("album_id", "position", F.when(F.col("position") % 3 != 0, F.col("dr") - 30.5).alias("loudness"), F.when(F.col("position") % 4 != 0, F.col("peak_tenths") / 10).alias("peak_db")),
        tracks(spark, d).groupBy("album_id").agg((F.max("dr") / 4 - 3).alias("gain_db")),
    ),
    f"""WITH {TRACKS_SQL}, a AS (SELECT album_id, max(dr) / 4.0::DOUBLE - 3 AS g FROM tracks GROUP BY 1), t AS (SELECT album_id, position, CASE WHEN position % 3 <> 0 THEN round(-23 - (dr - 30.5::DOUBLE), 3) ELSE g END AS gain, CASE WHEN position % 4 <> 0 THEN round(pow(10.0::DOUBLE, peak_tenths / 10.0::DOUBLE / 20), 6) ELSE 1.0 END AS peak FROM tracks JOIN a USING (album_id))
  SELECT album_id, position, gain, CAST(CASE WHEN gain >= 0 THEN floor(gain * 256 + 0.5) ELSE ceil(gain * 256 - 0.5) END AS BIGINT) AS fixed_gain, peak FROM t""",
)
CODECS = ("flac", "x.ALAC", "libvorbis", "opus", "", "y.aiff", "dsf", "weird", "mp4", "a.dca")
AS = ("flac", "m4a", "ogg", "opus", "", "aiff", "dsf", "weird", "mp4", "dts")
FILES = ("/a/b.flac", "/a/c.OGG", "/a/d.oga", "/a/e.xyz", "/a/f.m4a")
FORMATS = ("FLAC ogg", "vorbis aif ffmpeg", "m4a mp4 dsf", "flac ffmpeg weird", "")


def _routes(spark, d):
    k = F.col("c_custkey")
    codec, path = choose(CODECS, F.floor(k / 30)), choose(FILES, F.floor(k / 7))
    files = table(spark, d, "customer").select(k, codec.alias("codec"), path.alias("path"), (k % 2 == 0).alias("sox"), (k % 3 != 0).alias("ffmpeg"), F.split(choose(FORMATS, F.floor(k / 6)), " ").alias("formats"))
    return routing.routes(files).select(k, "codec", "decoder", "encoder", "backend", "input")


def _reads(c: str) -> str:
    return f"(sox AND {c} NOT IN ('', 'opus') AND CASE {c} WHEN 'ogg' THEN list_has_any(f, ['ogg', 'vorbis']) WHEN 'aiff' THEN list_has_any(f, ['aiff', 'aif', 'aifc']) ELSE list_contains(f, {c}) END)"


def _flac(c: str) -> str:
    return f"CASE WHEN sox AND list_contains(f, 'flac') AND {_reads(c)} THEN 'sox' WHEN sox AND list_contains(f, 'flac') AND bridge THEN 'sox(ffmpeg-in)' WHEN ff THEN 'ffmpeg' ELSE 'none' END"


add(
    "backends",
    _routes,
    f"""WITH t AS (SELECT c_custkey, c_custkey % 2 = 0 AS sox, c_custkey % 3 <> 0 AS ff, string_split(lower({_pick(FORMATS, "c_custkey // 6")}), ' ') AS f, {_pick(AS, "c_custkey // 30")} AS c, {_pick(("flac", "ogg", "ogg", ".xyz", "m4a"), "c_custkey // 7")} AS e FROM customer),
  b AS (SELECT *, sox AND ff AND list_contains(f, 'ffmpeg') AS bridge, CASE WHEN c <> '' THEN c ELSE e END AS g FROM t), w AS (SELECT *, CASE WHEN sox THEN {_flac("g")} ELSE 'ffmpeg' END AS way FROM b)
  SELECT c_custkey, c AS codec, CASE WHEN {_reads("c")} THEN 'sox' WHEN bridge THEN 'sox(ffmpeg-in)' WHEN ff THEN 'ffmpeg' ELSE 'none' END AS decoder, {_flac("c")} AS encoder,
    CASE WHEN way IN ('sox', 'sox(ffmpeg-in)') THEN 'sox' ELSE 'ffmpeg' END AS backend, CASE WHEN way = 'sox(ffmpeg-in)' THEN 'ffmpeg' ELSE 'autodetect' END AS input FROM w""",
)
_TARGETS = (*PROFILES, "44.1/20")
add(
    "target_profiles",
    lambda spark, d: table(spark, d, "customer").select("c_custkey", routing.target_profile(text.canonical_profile(choose(_TARGETS, F.col("c_custkey")))).alias("t")).where("t is not null").select("c_custkey", "t.*"),
    f"""WITH p AS (SELECT c_custkey, {canonical_sql("raw")} AS p FROM (SELECT c_custkey, {_pick(_TARGETS, "c_custkey")} AS raw FROM customer))
  SELECT c_custkey, CAST(split_part(p, '/', 1) AS INTEGER) AS rate, CAST(split_part(p, '/', 2) AS INTEGER) AS bits, CASE split_part(p, '/', 2) WHEN '16' THEN 's16' ELSE 's32' END AS sample_format FROM p WHERE split_part(p, '/', 2) IN ('16', '24', '32')""",
)
LINES = ("Input True Peak:  +{n}.5 dBTP", "x Input True Peak: -{n} dBTP", "Input True Peak: nan", "\x1b[31mArt: OK | {n}\x1b[0m", "\x1b[1;32mlog\x1b[0m Art: WARN | {n}", "nothing {n}")


def _lines(spark, d):
    said = F.replace(choose(LINES, F.col("part_id")), F.lit("{n}"), (F.col("dr") % 7).cast("string"))
    return tracks(spark, d).select(F.col("album_id").alias("log"), F.col("position").alias("line_no"), said.alias("text"))


_LINES = f"{TRACKS_SQL}, l AS (SELECT album_id, position, part_id % 6 AS k, dr % 7 AS n FROM tracks)"
add(
    "true_peaks",
    lambda spark, d: logs.true_peaks(_lines(spark, d)),
    f"WITH {_LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY position) AS r FROM l WHERE k < 3) SELECT album_id AS log, CASE k WHEN 0 THEN n + 0.5::DOUBLE WHEN 1 THEN -n::DOUBLE END AS peak FROM f WHERE r = 1",
)
add(
    "art_lines",
    lambda spark, d: logs.art_lines(_lines(spark, d)),
    f"WITH {_LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY position DESC) AS r FROM l WHERE k IN (3, 4)) SELECT album_id AS log, CASE k WHEN 3 THEN 'Art: OK | ' ELSE 'Art: WARN | ' END || n AS art FROM f WHERE r = 1",
)
_WALKED = f"{_LINES}, a AS (SELECT DISTINCT album_id AS dir, CAST(album_id % 5 // 4 * 2 AS INTEGER) AS code FROM tracks)"


def _walk(spark, d):
    return logs.walk(tracks(spark, d).select(F.col("album_id").alias("dir"), F.when(F.col("album_id") % 5 == 4, 2).otherwise(0).alias("code")).distinct(), _lines(spark, d))


add("walk_counts", lambda spark, d: _walk(spark, d)[0], f"WITH {_WALKED} SELECT count(*) AS albums, count(*) FILTER (code = 0) AS ok, count(*) FILTER (code <> 0) AS failed FROM a")
add(
    "walk_failures",
    lambda spark, d: _walk(spark, d)[1],
    f"""WITH {_WALKED}, f AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY position DESC) AS r FROM l WHERE k IN (3, 4)), s AS (SELECT album_id, CASE k WHEN 3 THEN 'Art: OK | ' ELSE 'Art: WARN | ' END || n AS art FROM f WHERE r = 1)
  SELECT dir, dir || ' | ' || coalesce(art, 'Art: ERROR | album processing failed') AS line FROM a LEFT JOIN s ON dir = album_id WHERE code <> 0""",
)


def _art(spark, d):
    k = F.col("id")
    return albums(spark, d).select(
        k, choose(("ok", "error", "warn"), k).alias("status"), F.when(k % 2 == 0, "no cover").alias("error"), F.when(k % 5 == 0, "front.png").alias("sidecar"), F.when(k % 7 != 0, k % 900).alias("width"), (k % 800).alias("height"), (k % 9).alias("tracks_ok"), (k % 9 + k % 2).alias("tracks"),
        F.when(k % 3 == 1, k % 4).alias("sidecars_cleared"), (k % 3).alias("embeds_cleared"), F.when(k % 4 == 1, "embedded:x").otherwise("").alias("source"), F.when(k % 8 == 1, "small").alias("warning"), (k % 6 == 1).alias("cached"), F.when(k % 4 != 0, k % 3 == 2).alias("changed"),
    )


add(
    "art_summaries",
    lambda spark, d: logs.art_summary(_art(spark, d)).select("id", "art"),
    f"""WITH {ALBUMS_SQL} SELECT id, CASE WHEN id % 3 = 1 THEN 'Art: ERROR | ' || CASE WHEN id % 2 = 0 THEN 'no cover' ELSE 'unknown failure' END ELSE 'Art: ' || CASE id % 3 WHEN 0 THEN 'OK' ELSE 'WARN' END || ' | ' || CASE WHEN id % 5 = 0 THEN 'front.png' ELSE 'cover.jpg' END || ' | JPEG ' || CASE WHEN id % 7 <> 0 THEN id % 900 ELSE 0 END || 'x' || id % 800
  || ' | embedded ' || id % 9 || '/' || (id % 9 + id % 2) || ' | sidecars cleared=0 | extra embeds cleared=' || id % 3 || CASE WHEN id % 4 = 1 THEN ' | source=embedded:x' ELSE '' END || CASE WHEN id % 8 = 1 THEN ' | warning=small' ELSE '' END
  || CASE WHEN id % 6 = 1 THEN ' | cached' WHEN id % 4 <> 0 AND id % 3 = 2 THEN ' | updated' ELSE '' END END AS art FROM albums""",
)


def _covers(spark, d):
    k = F.col("id")
    return albums(spark, d).select(
        k.alias("dir"), F.when(k % 3 == 0, "front.jpg").alias("sidecar"), F.when(k % 3 != 2, "01.flac").alias("embedded"), F.when(k % 11 != 0, k % 900).alias("local_width"), (k % 700).alias("local_height"), (k % 4 != 0).alias("fetch"), F.lit(500).alias("least"),
        F.when(k % 5 != 0, F.concat(F.lit("remote:"), k.cast("string"))).alias("remote"), (k % 1000).alias("remote_width"), F.when(k % 13 != 0, (k % 950).cast("string")).otherwise("?").alias("remote_height"),
    )


add(
    "chosen_art",
    lambda spark, d: logs.chosen_art(_covers(spark, d)),
    f"""WITH {ALBUMS_SQL}, c AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'sidecar:front.jpg' WHEN id % 3 = 1 THEN 'embedded:01.flac' END AS local, CASE WHEN id % 11 <> 0 THEN least(id % 900, id % 700) ELSE 0 END AS mine, CASE WHEN id % 13 <> 0 THEN least(id % 1000, id % 950) ELSE 0 END AS other FROM albums),
  a AS (SELECT *, id % 4 <> 0 AND (local IS NULL OR (mine > 0 AND mine < 500)) AS ask FROM c) SELECT id AS dir, CASE WHEN ask AND id % 5 <> 0 AND (local IS NULL OR other > mine) THEN 'remote:' || id ELSE local END AS source, ask AS fetched FROM a""",
)


def _report_tracks(spark, d):
    k = F.col("part_id")
    return tracks(spark, d).select(
        "album_id", "position", F.concat(F.lit("Track\t"), k.cast("string"), F.when(k % 4 == 0, " and a name that is longer than fifty-two characters").otherwise("")).alias("name"), choose(("standard", "audiophile", "high_energy"), F.col("album_id")).alias("profile"),
        F.when(k % 3 == 0, "  Progressive   Rock; Art  Rock ").when(k % 3 == 1, " ").alias("track_genre"), F.when(k % 2 == 0, "Jazz").alias("album_genre"), (F.col("bitrate_bps") * F.col("seconds")).alias("size"), F.nullif("codec", F.lit("wav")).alias("codec"), "bitrate_bps", F.when(k % 5 != 0, F.col("dr") + (k % 4) / 8).alias("dr"),
    )


_REPORT = f"""{TRACKS_SQL}, r AS (SELECT *, part_id AS k, bitrate_bps * seconds AS b, {_pick(("standard", "audiophile", "high_energy"), "album_id")} AS profile, CASE WHEN part_id % 5 <> 0 THEN dr + (part_id % 4) / 8.0::DOUBLE END AS x FROM tracks)"""
add(
    "track_report",
    lambda spark, d: reports.track_report(_report_tracks(spark, d)).drop("size"),
    f"""WITH {_REPORT}, n AS (SELECT *, 'Track ' || k || CASE WHEN k % 4 = 0 THEN ' and a name that is longer than fifty-two characters' ELSE '' END AS name, CASE WHEN codec = 'wav' THEN '-' ELSE coalesce(nullif(lower(codec), ''), '-') END AS c FROM r)
  SELECT album_id, position, CASE WHEN length(name) > 52 THEN rtrim(left(name, 49), ' ') || '...' ELSE name END AS name, profile AS preset, CASE WHEN k % 3 = 0 THEN 'Progressive Rock;...' WHEN k % 2 = 0 THEN 'Jazz' ELSE '-' END AS genre_tag, c AS codec,
    CASE WHEN bitrate_bps > 0 THEN ((bitrate_bps + 500) // 1000) || 'k' ELSE '-' END AS bitrate, CASE WHEN x IS NULL THEN '-' WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.2f', round_even(x, 2)), '\\.?0+$', '') END AS dr, coalesce({grade_sql("x", "profile")}, '-') AS grade FROM n""",
)


def _reported(spark, d):
    k = F.col("album_id")
    known = tracks(spark, d).groupBy("album_id").agg(F.max("dr").alias("top")).select("album_id", choose(("standard", "audiophile", "high_energy"), k).alias("profile"), F.when(k % 4 != 0, F.col("top") / 2).alias("db_dr"), choose(("S", "A", "B", "C", "F", "-"), k).alias("db_class"))
    return _report_tracks(spark, d), known


add(
    "album_report",
    lambda spark, d: reports.album_report(*_reported(spark, d)),
    f"""WITH {_REPORT}, s AS (SELECT album_id, any_value(profile) AS profile, count(*) AS tracks, count(x) AS measured, avg(x) AS mean, CASE WHEN album_id % 4 <> 0 THEN max(dr) / 2.0::DOUBLE END AS db_dr, {_pick(("S", "A", "B", "C", "F", "-"), "album_id")} AS db_class FROM r GROUP BY album_id),
  g AS (SELECT *, CAST(round_even(mean, 0) AS INTEGER) AS mean_dr, coalesce({grade_sql("mean", "profile")}, '-') AS c, coalesce({grade_sql("mean", "'standard'")}, '-') AS sc FROM s)
  SELECT album_id, tracks, measured, mean_dr, c AS class, sc AS standard_class, CASE WHEN mean IS NOT NULL AND profile <> 'standard' AND c <> sc THEN 'album-level scoring preset ' || profile || ' changed class ' || sc || ' -> ' || c || ' at DR ' || mean_dr ELSE '' END AS note,
    mean IS NOT NULL AND (db_dr IS NULL OR CAST(round_even(db_dr, 0) AS INTEGER) <> mean_dr OR db_class <> c) AS save FROM g""",
)


def _totals(spark, d):
    k = F.col("album_id")
    return tracks(spark, d).select(k, choose(("12", "N/A", "", "9.5", "x"), k).alias("total"), choose(("A", "N/A", "", " B "), k).alias("grade")).distinct(), tracks(spark, d).select(k, F.when((k % 3 != 0) & (F.col("position") != 2), F.col("dr")).alias("dr"))


add(
    "album_overall",
    lambda spark, d: reports.overall(*_totals(spark, d)),
    f"""WITH {TRACKS_SQL}, t AS (SELECT album_id, CASE WHEN album_id % 3 <> 0 AND position <> 2 THEN dr END AS x FROM tracks), g AS (SELECT album_id, CAST(round_even(avg(x), 0) AS BIGINT) AS mean, min(CASE {grade_sql("x", "'standard'")} WHEN 'S' THEN 5 WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'F' THEN 1 END) AS worst FROM t GROUP BY album_id)
  SELECT album_id, coalesce(list_extract(['A', NULL, NULL, 'B'], CAST(album_id % 4 + 1 AS BIGINT)), list_extract(['F', 'C', 'B', 'A', 'S'], worst), 'N/A') AS grade, 'DR' || coalesce(list_extract(['12', NULL, NULL, '9.5', NULL], CAST(album_id % 5 + 1 AS BIGINT)), CAST(mean AS VARCHAR), 'N/A') AS dr FROM g""",
)


def _analyses(spark, d):
    k = F.col("event_id")
    whole = F.to_json(F.struct(F.when(k % 3 != 0, "44100/16").alias("recodeTo"), (k % 2 == 0).alias("fakeUpscale"), F.when(k % 5 == 0, 44100).alias("familySampleRateHz"), (k % 20).alias("drTotal"), F.when(k % 4 != 1, "A").alias("grade"), F.when(k % 7 == 0, "audiophile").alias("genreProfile"), F.struct(F.lit(1).alias("x")).alias("more")))
    return table(spark, d, "events").select(k.alias("id"), F.when(k % 11 != 0, whole).otherwise("not json").alias("json"))


add(
    "analysis_fields",
    lambda spark, d: reports.flattened(_analyses(spark, d)),
    """WITH e AS (SELECT event_id AS id, event_id % 11 <> 0 AS j FROM events) SELECT id, CASE WHEN j AND id % 3 <> 0 THEN '44100/16' ELSE '' END AS "recodeTo", CASE WHEN j AND id % 2 = 0 THEN '1' ELSE '0' END AS "fakeUpscale", '0' AS "hasFakeUpscaleTracks", CASE WHEN j AND id % 5 = 0 THEN '44100' ELSE '' END AS "familySampleRateHz", '' AS "analyzeDecision",
  CASE WHEN j THEN CAST(id % 20 AS VARCHAR) ELSE '' END AS "drTotal", CASE WHEN j AND id % 4 <> 1 THEN 'A' ELSE '' END AS "grade", CASE WHEN j AND id % 7 = 0 THEN 'audiophile' ELSE 'standard' END AS "genreProfile", '' AS "samplingRateHz", '' AS "averageBitrateKbs", '' AS "bitsPerSample", j AND id % 3 <> 0 AND id % 4 <> 1 AS ok FROM e""",
)
_RAW_PATHS = ("/a/it\\'s", "/b/end\\", "/c/plain", "/d/\\'both\\")
add(
    "path_candidates",
    lambda spark, d: table(spark, d, "supplier").select("s_suppkey", F.posexplode(paths.path_candidates(choose(_RAW_PATHS, F.col("s_suppkey")))).alias("turn", "path")),
    r"""WITH r AS (SELECT s_suppkey, list_extract([['/a/it\''s', '/a/it''s'], ['/b/end\', '/b/end'''], ['/c/plain'], ['/d/\''both\', '/d/''both\', '/d/\''both''']], CAST(s_suppkey % 4 + 1 AS BIGINT)) AS p FROM supplier)
  SELECT s_suppkey, CAST(unnest(range(len(p))) AS INTEGER) AS turn, unnest(p) AS path FROM r""",
)


def _folders(spark, d):
    k = F.col("id")
    tags = F.create_map(F.lit("album_artist"), F.when(k % 5 == 0, " AA "), F.lit("artist"), F.when(k % 5 == 1, F.col("artist")), F.lit("album"), F.when(k % 4 == 0, F.col("album")))
    folder = F.concat(F.lit("/m/"), F.when(k % 3 == 0, F.concat(F.lit("Last"), k.cast("string"), F.lit(" , First"))).otherwise(F.col("artist")), F.lit("/"), F.when(k % 2 == 0, F.concat(F.col("year_int").cast("string"), F.lit(" - "))).otherwise(""), "album", F.when(k % 7 == 0, "/").otherwise(""))
    return albums(spark, d).select("id", paths.album_identity(tags, folder).alias("i")).select("id", "i.*")


add(
    "album_identity",
    _folders,
    f"""WITH {ALBUMS_SQL} SELECT id, CASE WHEN id % 5 = 0 THEN 'AA' WHEN id % 5 = 1 THEN artist WHEN id % 3 = 0 THEN 'First Last' || id ELSE artist END AS artist, CASE WHEN id % 4 = 0 THEN album WHEN id % 2 = 0 AND year_int = 0 THEN '0 - ' || album ELSE album END AS album, CASE WHEN id % 2 = 0 AND year_int > 0 THEN CAST(year_int AS VARCHAR) ELSE '' END AS year FROM albums""",
)


def _settings(spark, d):
    """Analyses of albums: most settings are the same for all, some differ."""
    k = F.col("id")
    fixed = {name: F.lit(f"{i}.5") for i, name in enumerate(fingerprints.SETTINGS)}
    return albums(spark, d).select("id", fingerprints.config_fingerprint(fixed | {"ruleset": choose(("v1", "v2"), k), "headroom_hz": k % 5 * 100, "fp_mode": choose(("fast", "exact", "auto"), k)}).alias("fingerprint"))


_SETTING = {"ruleset": _pick(("v1", "v2"), "id"), "headroom_hz": "CAST(id % 5 * 100 AS VARCHAR)", "fp_mode": _pick(("fast", "exact", "auto"), "id")}
add(
    "config_fingerprint",
    _settings,
    f"WITH {ALBUMS_SQL} SELECT id, sha256(concat_ws(chr(10), '{fingerprints.CONFIG_VERSION}', " + ", ".join(f"'{name}=' || " + _SETTING.get(name, f"'{i}.5'") for i, name in enumerate(fingerprints.SETTINGS)) + ")) AS fingerprint FROM albums",
)
