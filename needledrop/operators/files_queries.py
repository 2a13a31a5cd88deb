"""Queries of listings and caches, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from needledrop.operators import files
from needledrop.operators.catalog_queries import Query
from needledrop.sources.bind import ALBUMS_SQL, TRACKS_SQL, _pick, albums, choose, table, tracks

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


NAMES = ("01.flac", "02.FLAC", "cover.jpg", "notes.txt", ".cache", "x.bin", "Folder.PNG", "before-recode/03.flac", "03.flac", "front.webp")


def _files(spark, d):
    """A listing: one file for each order line, in folders by order."""
    t = tracks(spark, d)
    return t.select(F.concat(F.lit("/m/"), (F.col("album_id") % 2000).cast("string"), F.lit("/"), choose(NAMES, F.col("part_id") + F.col("position"))).alias("path"), (F.col("bitrate_bps") + 1).alias("size"), (F.col("cutoff_hz") + 1_700_000_000).cast("long").alias("mtime"))


_FILES = f"""{TRACKS_SQL}, files AS (SELECT '/m/' || CAST(album_id % 2000 AS VARCHAR) || '/' || {_pick(NAMES, "part_id + position")} AS path, bitrate_bps + 1 AS size, CAST(cutoff_hz + 1700000000 AS BIGINT) AS mtime FROM tracks),
f AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(lower(path), '\\.([^./]+)$', 1) AS e FROM files), g AS (SELECT *, e = 'flac' AS audio FROM f)"""
_PROBED = "SELECT DISTINCT path FROM files WHERE path LIKE '%x.bin' AND CAST(split_part(path, '/', 3) AS INTEGER) % 2 = 0"


def _probed(spark, d):
    f = _files(spark, d).where("path like '%x.bin'")
    return f.select("path", F.when(F.split_part("path", F.lit("/"), F.lit(3)).cast("int") % 2 == 0, "pcm").alias("codec"))


add("scan_audio_files", lambda spark, d: files.audio_files(_files(spark, d), _probed(spark, d)).select("path"), f"WITH {_FILES} SELECT DISTINCT path FROM g WHERE audio OR path IN ({_PROBED})")
add("walk_audio_folders", lambda spark, d: files.folders_with_audio(_files(spark, d)), f"WITH {_FILES} SELECT DISTINCT dir FROM g WHERE audio AND path NOT LIKE '%/before-recode/%'")
add(
    "changed_folders",
    lambda spark, d: files.changed_folders(_files(spark, d), 1_700_080_000, _files(spark, d).groupBy(files.folder(F.col("path")).alias("dir")).agg((F.min("mtime") + 75_000).alias("mtime"))),
    f"WITH {_FILES} SELECT DISTINCT dir FROM g WHERE audio AND path NOT LIKE '%/before-recode/%' AND mtime > 1700080000 UNION SELECT dir FROM g WHERE dir NOT LIKE '%/before-recode' GROUP BY dir HAVING min(mtime) + 75000 > 1700080000",
)
add(
    "folder_sums",
    lambda spark, d: files.folder_sums(_files(spark, d)),
    f"""WITH {_FILES} SELECT dir, count(*) FILTER (audio) AS n_files, max(mtime) FILTER (audio) AS content_mtime,
      CAST(coalesce(sum(size) FILTER (NOT starts_with(name, '.') AND (e NOT IN ('jpg', 'png', 'webp') OR lower(name) LIKE 'cover.%')), 0) AS BIGINT) AS payload_bytes FROM g GROUP BY dir""",
)
add(
    "pcm_estimates",
    lambda spark, d: files.pcm_bytes(
        tracks(spark, d).withColumns({"channels": F.when(F.col("album_id") % 3 != 0, F.col("album_id") % 3).cast("string"), "bits": F.when(F.col("album_id") % 7 != 2, F.col("bits").cast("string")).otherwise("?"), "sr": F.when(F.col("album_id") % 19 != 4, F.col("sr")), "seconds": F.col("seconds") + F.col("peak_tenths") / 16})
    ),
    f"""WITH {TRACKS_SQL} SELECT album_id, CAST(round_even(sum(seconds + peak_tenths / 16.0::DOUBLE) * CASE WHEN album_id % 19 <> 4 THEN arg_min(sr, position) ELSE 0 END * CASE album_id % 3 WHEN 1 THEN 1 ELSE 2 END * (CASE WHEN album_id % 7 <> 2 THEN arg_min(bits, position) ELSE 24 END / 8.0::DOUBLE), 0) AS BIGINT) AS bytes,
      sum(seconds + peak_tenths / 16.0::DOUBLE) AS seconds FROM tracks GROUP BY album_id""",
)
add(
    "source_caps",
    lambda spark, d: files.source_caps(tracks(spark, d)),
    f"WITH {TRACKS_SQL} SELECT album_id, min(sr) FILTER (sr > 0) AS rate, coalesce(min(bits) FILTER (bits > 0), 24) AS depth, max(cutoff_hz) AS cutoff, count(DISTINCT codec) > 1 AS codecs_differ FROM tracks GROUP BY album_id",
)
add(
    "best_cover",
    lambda spark, d: files.best_cover(_files(spark, d)),
    f"""WITH {_FILES} SELECT dir, arg_min(path, (CASE WHEN lower(name) LIKE 'cover%' THEN 1 WHEN lower(name) LIKE 'folder%' THEN 2 ELSE 3 END)) AS path FROM g WHERE lower(name) IN ('cover.jpg', 'folder.png', 'front.webp') GROUP BY dir""",
)


def _references(spark, d):
    """Two sheets for each tenth folder; the second names files that aren't always there."""
    ids = _files(spark, d).select(files.folder(F.col("path")).alias("dir")).distinct()
    sheets = ids.select("dir", F.explode(F.array(*(F.struct(F.lit(s).alias("sheet"), F.lit(n).alias("number"), F.lit(x).alias("file")) for s, n, x in (("a.cue", 1, "01.wav"), ("a.cue", 2, "02.flac"), ("b.cue", 1, "03.FLAC"))))).alias("r"))
    return sheets.select("dir", "r.*")


_REFERENCES = f"""{_FILES}, refs AS (SELECT dir, unnest([{{'sheet': 'a.cue', 'number': 1, 'file': '01.wav'}}, {{'sheet': 'a.cue', 'number': 2, 'file': '02.flac'}}, {{'sheet': 'b.cue', 'number': 1, 'file': '03.FLAC'}}]) AS r FROM (SELECT DISTINCT dir FROM f)),
met AS (SELECT refs.dir, r.sheet AS sheet, r.number AS number, arg_min(path, (CASE WHEN r.file = name THEN 0 WHEN lower(r.file) = lower(name) THEN 1 ELSE 2 END, path)) AS path
  FROM refs LEFT JOIN g ON g.dir = refs.dir AND audio AND regexp_replace(lower(r.file), '\\.[^.]*$', '') = regexp_replace(lower(name), '\\.[^.]*$', '') GROUP BY ALL)"""
add("sheet_references", lambda spark, d: files.resolved_references(_references(spark, d), _files(spark, d)), f"WITH {_REFERENCES} SELECT * FROM met")
add(
    "chosen_sheet",
    lambda spark, d: files.chosen_sheet(_references(spark, d), _files(spark, d)),
    f"WITH {_REFERENCES}, w AS (SELECT dir, sheet FROM met GROUP BY dir, sheet HAVING count(*) = count(path)) SELECT dir, min(sheet) AS sheet FROM w GROUP BY dir HAVING count(*) = 1",
)
add(
    "source_rows",
    lambda spark, d: files.source_rows(albums(spark, d).select("id", "artist", "album", "year_int"), albums(spark, d).withColumn("source_path", F.when(F.col("id") % 3 != 0, F.col("source_path")))),
    f"""WITH {ALBUMS_SQL}, h AS (SELECT * FROM albums WHERE id % 3 <> 0) SELECT a.id, arg_min(h.id, r) AS source_id, arg_min(h.source_path, r) AS source_path
      FROM (SELECT a.id, a.artist, a.album, a.year_int FROM albums a) a JOIN h ON lower(a.album) = lower(h.album) AND a.year_int = h.year_int, LATERAL (SELECT (CASE WHEN a.id = h.id THEN 0 WHEN lower(a.artist) = lower(h.artist) THEN 1 ELSE 2 END, h.id) AS r) GROUP BY a.id""",
)
add(
    "backup_plan",
    lambda spark, d: files.backup_plan(_files(spark, d).select(files.folder(F.col("path")).alias("source_path")).distinct().select(F.split_part("source_path", F.lit("/"), F.lit(3)).cast("long").alias("id"), F.when(F.col("source_path").endswith("7"), F.replace("source_path", F.lit("/m/"), F.lit("/other/"))).otherwise(F.col("source_path")).alias("source_path")).distinct(), _files(spark, d).select(F.substr("path", F.lit(4)).alias("path"), "size", "mtime").where("size % 2 = 0"), "/m/"),
    f"""WITH {_FILES}, a AS (SELECT DISTINCT CAST(split_part(dir, '/', 3) AS BIGINT) AS id, CASE WHEN ends_with(dir, '7') THEN replace(dir, '/m/', '/other/') ELSE dir END AS p FROM f), b AS (SELECT DISTINCT substr(dir, 4) AS rel FROM g WHERE audio AND size % 2 = 0 AND path NOT LIKE '%/before-recode/%')
    SELECT id, CASE WHEN NOT starts_with(p, '/m/') THEN 'outside' WHEN substr(p, 4) IN (SELECT rel FROM b) THEN 'there' ELSE 'copy' END AS decision FROM a""",
)


def _lines(spark, d):
    return tracks(spark, d).select((F.col("album_id") % 500).alias("file"), (F.col("album_id") * 10 + F.col("position")).alias("line_no"), F.when(F.col("position") % 4 == 0, "no value").otherwise(F.concat(F.lit("K"), (F.col("part_id") % 3).cast("string"), F.lit("="), F.col("sr").cast("string"), F.lit("=x"))).alias("line"))


add(
    "key_value_cache",
    lambda spark, d: files.key_values(_lines(spark, d)),
    f"WITH {TRACKS_SQL} SELECT album_id % 500 AS file, 'K' || CAST(part_id % 3 AS VARCHAR) AS key, arg_min(CAST(sr AS VARCHAR) || '=x', album_id * 10 + position) AS value FROM tracks WHERE position % 4 <> 0 GROUP BY ALL",
)
add(
    "peak_cache",
    lambda spark, d: files.peak_cache(tracks(spark, d).select((F.col("album_id") * 10 + F.col("position")).alias("line_no"), F.concat_ws("\t", F.concat(F.lit("/m/"), (F.col("part_id") % 50).cast("string")), F.when(F.col("position") == 5, "late").otherwise((F.col("dr") % 3).cast("string")), F.lit("7"), (F.col("peak_tenths") / 10).cast("string"), F.when(F.col("position") == 6, "extra")).alias("line"))),
    f"WITH {TRACKS_SQL} SELECT '/m/' || CAST(part_id % 50 AS VARCHAR) AS path, CAST(dr % 3 AS BIGINT) AS mtime, 7::BIGINT AS size, arg_max(peak_tenths / 10.0::DOUBLE, album_id * 10 + position) AS peak FROM tracks WHERE position NOT IN (5, 6) GROUP BY ALL",
)
add(
    "manifest_entries",
    lambda spark, d: files.manifest_entries(table(spark, d, "customer").select(F.col("c_custkey").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(' [{"path":"/a/'), F.col("c_custkey").cast("string"), F.lit('","kind":"trusted"},{"kind":"weak"}]'))).otherwise(F.concat(F.lit('{"entries":[{"path":"/b","kind":"weak"},{"path":"/c"}],"v":'), F.col("c_custkey").cast("string"), F.lit("}"))).alias("json"))),
    "SELECT c_custkey AS name, '/a/' || CAST(c_custkey AS VARCHAR) AS path, 'trusted' AS kind FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, '/b', 'weak' FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, '/c', NULL FROM customer WHERE c_custkey % 2 = 1",
)
add(
    "song_files",
    lambda spark, d: files.song_files(albums(spark, d).select(F.col("id").alias("song_id"), F.lit("/s").alias("dir"), F.concat(F.lit(" Song "), (F.col("id") % 300).cast("string")).alias("title")), table(spark, d, "customer").select(F.concat(F.lit("/s/"), F.when(F.col("c_custkey") % 2 == 0, F.concat((F.col("c_custkey") % 90).cast("string"), F.lit(". "))).otherwise(""), F.lit("SONG "), F.col("c_custkey").cast("string"), F.lit(".flac")).alias("path"))),
    f"""WITH {ALBUMS_SQL}, h AS (SELECT c_custkey, '/s/' || CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 90 AS VARCHAR) || '. ' ELSE '' END || 'SONG ' || CAST(c_custkey AS VARCHAR) || '.flac' AS path FROM customer) SELECT id AS song_id, path FROM albums JOIN h ON id % 300 = c_custkey""",
)
add(
    "row_json",
    lambda spark, d: files.row_json(table(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("r"))),
    """SELECT '{"n_nationkey":' || CAST(n_nationkey AS VARCHAR) || ',"n_name":"' || n_name || '"' || CASE WHEN n_nationkey % 2 = 0 THEN ',"r":' || CAST(n_regionkey AS VARCHAR) ELSE '' END || '}' AS line FROM nation""",
)
add(
    "table_cells",
    lambda spark, d: files.cells(table(spark, d, "supplier").select("s_suppkey", F.array_join(F.slice(F.array(*(F.lit(x) for x in "abcde")), 1, (F.col("s_suppkey") % 5 + 1).cast("int")), "\t").alias("line")), 3).drop("line"),
    "SELECT s_suppkey, 'a' AS c1, CASE WHEN s_suppkey % 5 >= 1 THEN 'b' ELSE '' END AS c2, list_extract(['', '', 'c', 'c d', 'c d e'], CAST(s_suppkey % 5 + 1 AS BIGINT)) AS c3 FROM supplier",
)


def _hints(spark, d):
    path = lambda end: F.concat(F.lit("/m/"), F.col("album_id").cast("string"), F.lit("/"), F.col("position").cast("string"), end)
    t = tracks(spark, d)
    return files.decoding_hints(t.select(path(choose((".flac", ".WV", ".m4a"), F.col("part_id"))).alias("path"), F.when(F.col("supp_id") % 7 != 0, F.col("seconds") - 20).alias("seconds")), t.where("album_id % 3 = 0").select(path(choose((".CUE", ".txt"), F.col("part_id"))).alias("path")))


add(
    "decoding_hints",
    _hints,
    f"""WITH {TRACKS_SQL}, s AS (SELECT DISTINCT album_id FROM tracks WHERE album_id % 3 = 0 AND part_id % 2 = 0) SELECT '/m/' || t.album_id || '/' || position || list_extract(['.flac', '.WV', '.m4a'], CAST(part_id % 3 + 1 AS BIGINT)) AS path, s.album_id IS NOT NULL AS has_sheet,
      part_id % 3 = 1 OR supp_id % 7 = 0 OR seconds <= 20 AS by_ffmpeg FROM tracks t LEFT JOIN s ON t.album_id = s.album_id""",
)
