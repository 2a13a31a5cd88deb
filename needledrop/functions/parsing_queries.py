"""Queries that write lines from tracks and parse them again, each with what must come back in SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.functions import parsing, years
from needledrop.operators import transfer
from needledrop.operators.catalog_queries import Query, grade_sql
from needledrop.sources.bind import ALBUMS_SQL, TRACKS_SQL, _pick, albums, choose, table, tracks

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one sheet for each album: a file for odd and one for even positions in turn of the tracks."""
    t = tracks(spark, d)
    lines = F.array(
        F.concat(F.lit('FILE "side'), (F.col("position") % 2).cast("string"), F.lit('.wav" WAVE')),
        F.concat(F.lit("  TRACK "), _two(F.col("position")), F.lit(" AUDIO")),
        F.concat(F.lit('    TITLE "Part '), F.col("part_id").cast("string"), F.lit('"')),
        F.when(F.col("position") % 3 == 0, F.concat(F.lit('    PERFORMER "S'), F.col("supp_id").cast("string"), F.lit('"'))).otherwise(F.lit("    REM nothing")),
        F.concat(F.lit("    INDEX 01 "), _two(F.floor(F.col("seconds") / 60)), F.lit(":"), _two(F.col("seconds") % 60), F.lit(":"), _two(F.col("dr"))),
    )
    return t.select(F.col("album_id").alias("sheet"), "position", F.posexplode(lines).alias("at", "text")).select("sheet", (F.col("position") * 10 + F.col("at")).alias("line_no"), "text")


add(
    "cue_parse",
    lambda spark, d: parsing.sheet_tracks(_sheet(spark, d)),
    f"""WITH {TRACKS_SQL} SELECT album_id AS sheet, 'side' || CAST(position % 2 AS VARCHAR) || '.wav' AS file, position AS track, 'Part ' || CAST(part_id AS VARCHAR) AS title,
  CASE WHEN position % 3 = 0 THEN 'S' || CAST(supp_id AS VARCHAR) END AS performer, round(seconds + dr / 75.0::DOUBLE, 6) AS start FROM tracks""",
)


def _report(spark: SparkSession, d: str) -> DataFrame:
    """Lines of reports of three kinds, one for each track, with totals and properties between them."""
    t, k, dr = tracks(spark, d), F.col("part_id"), F.col("dr").cast("string")
    name = F.concat(F.lit("Part "), k.cast("string"), F.lit(".flac"))
    track = F.when(k % 3 == 0, F.concat(F.lit("  "), F.col("position").cast("string"), F.lit(". "), name, F.lit(":  DR "), dr, F.lit(".5"))).when(k % 3 == 1, F.concat(F.lit("DR"), dr, F.lit("  -0.10 dB  -12.30 dB  3:45 /x/"), name, F.lit(" [flac] "))).otherwise(F.concat(F.lit("DR"), dr, F.lit(" a b 3:45  "), name))
    total = F.when(k % 5 == 0, F.concat(F.lit(" dr = "), dr)).when(k % 5 == 1, F.concat(F.lit("x official dr value: DR"), dr, F.lit(".25"))).when(k % 5 == 2, F.concat(F.lit("Total DR: DR"), dr)).when(k % 5 == 3, F.concat(F.lit("Album DR:D"), dr)).otherwise(F.lit("DR x"))
    prop = F.when(k % 4 == 0, F.concat(F.lit("Sampling rate: "), F.col("sr").cast("string"), F.lit(" Hz"))).when(k % 4 == 1, F.lit("average bitrate:320kbs")).when(k % 4 == 2, F.concat(F.lit("  Bits per sample:  "), F.col("bits").cast("string"), F.lit(" bit"))).otherwise(F.lit("--"))
    return t.select(F.col("album_id").alias("report"), "position", F.posexplode(F.array(track, total, prop)).alias("at", "text")).select("report", (F.col("position") * 10 + F.col("at")).alias("line_no"), "text")


def _report_files(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).where("part_id % 2 = 0").select(F.col("album_id").alias("report"), F.concat(F.lit("PART "), F.col("part_id").cast("string"), F.lit(".FLAC")).alias("file"))


add(
    "report_tracks",
    lambda spark, d: parsing.report_tracks(_report(spark, d), _report_files(spark, d)),
    f"""WITH {TRACKS_SQL}, l AS (SELECT album_id AS report, position, CASE WHEN part_id % 3 = 0 THEN dr + 0.5::DOUBLE ELSE dr::DOUBLE END AS dr, CASE WHEN part_id % 2 = 0 THEN 'PART ' || part_id || '.FLAC' WHEN part_id % 3 = 0 THEN position || '. Part ' || part_id || '.flac'
    WHEN part_id % 3 = 1 THEN 'Part ' || part_id || '.flac' ELSE 'Part ' || part_id || '.flac' END AS name FROM tracks) SELECT report, name, arg_max(dr, position) AS dr FROM l GROUP BY 1, 2""",
)
add(
    "report_totals",
    lambda spark, d: parsing.report_totals(_report(spark, d)),
    f"""WITH {TRACKS_SQL} SELECT album_id AS report, arg_max(CASE part_id % 5 WHEN 1 THEN dr + 0.25::DOUBLE ELSE dr::DOUBLE END, position) FILTER (part_id % 5 < 4) AS total, arg_max(sr, position) FILTER (part_id % 4 = 0) AS rate, CAST(max(CASE WHEN part_id % 4 = 1 THEN 320 END) AS INTEGER) AS kbps, arg_max(bits, position) FILTER (part_id % 4 = 2) AS bits
    FROM tracks GROUP BY 1 HAVING count(*) FILTER (part_id % 5 < 4) > 0""",
)
add(
    "newest_reports",
    lambda spark, d: parsing.newest_reports(tracks(spark, d).select(F.col("album_id").alias("dir"), F.concat_ws("/", F.col("album_id").cast("string"), F.concat(choose(("dr14", "DR14", "dr14-", "x"), F.col("part_id")), F.col("position").cast("string"), choose((".txt", ".log", ".txt"), F.col("supp_id")))).alias("path"), (F.col("cutoff_hz") % 3).alias("mtime"))),
    f"""WITH {TRACKS_SQL}, f AS (SELECT album_id AS dir, album_id || '/' || CASE part_id % 4 WHEN 0 THEN 'dr14' ELSE 'dr14-' END || position || '.txt' AS path, cutoff_hz % 3 AS mtime FROM tracks WHERE part_id % 4 IN (0, 2) AND supp_id % 3 <> 1)
    SELECT dir, arg_min(path, (-mtime, path)) AS path FROM f GROUP BY dir""",
)


def _name_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = tracks(spark, d, by_size=True)
    key = F.col("album_id") * 100 + F.col("position")
    known = t.select(key.alias("known_id"), F.col("album_id").alias("group"), F.concat(_two(F.col("position")), F.lit(" - Part "), F.col("part_id").cast("string"), F.lit(".flac")).alias("name"), F.when(F.col("position") == 5, "n/a").when(F.col("position") % 2 == 0, F.concat(F.col("dr").cast("string"), F.lit(".5"))).otherwise(F.col("dr").cast("string")).alias("dr"))
    wanted = t.select(key.alias("wanted_id"), F.col("album_id").alias("group"), F.when(F.col("position") % 2 == 0, F.concat(F.lit("PART "), F.col("part_id").cast("string"))).otherwise(F.concat(F.lit("Part "), F.col("part_id").cast("string"), F.lit(" (live)"))).alias("name"), choose(PROFILES, F.col("supp_id")).alias("profile"))
    return wanted, known


def _names(spark: SparkSession, d: str) -> DataFrame:
    return parsing.match_names(*_name_sides(spark, d))


_MATCHED = f"""{TRACKS_SQL}, n AS (SELECT album_id AS g, album_id * 100 + position AS id, position, 'part ' || CAST(part_id AS VARCHAR) AS p, lpad(CAST(position AS VARCHAR), 2, '0') AS t FROM tracks),
  k0 AS (SELECT g, id, unnest([0, 2, 4, 6]) AS turn, unnest([t || ' - ' || p || '.flac', t || ' - ' || p, p || '.flac', p]) AS form FROM n),
  k AS (SELECT g, form, max(id) AS known_id, min((id, turn)) AS place FROM k0 GROUP BY g, form),
  w AS (SELECT g, id, CASE WHEN position % 2 = 0 THEN p ELSE p || ' (live)' END AS alias FROM n),
  e AS (SELECT w.id AS wanted_id, k.known_id, 'alias' AS by FROM w JOIN k ON w.g = k.g AND alias = form),
  o AS (SELECT w.id AS wanted_id, arg_min(k.known_id, place) AS known_id, 'part' AS by FROM w JOIN k ON w.g = k.g AND (contains(alias, form) OR contains(form, alias)) WHERE w.id NOT IN (SELECT wanted_id FROM e) GROUP BY w.id),
  m AS (SELECT * FROM e UNION ALL SELECT * FROM o)"""
add("fuzzy_track_match", _names, f"WITH {_MATCHED} SELECT * FROM m")


def _graded_names(spark: SparkSession, d: str) -> DataFrame:
    return parsing.graded_names(*_name_sides(spark, d))


PROFILES = ("standard", "audiophile", "high_energy", "odd")
add(
    "track_dr_grades",
    _graded_names,
    f"""WITH {_MATCHED.replace("FROM tracks)", "FROM tracks), y AS (SELECT * FROM n WHERE position <> 5)", 1).replace("p || '.flac', p]) AS form FROM n)", "p || '.flac', p]) AS form FROM y)")},
  d AS (SELECT album_id * 100 + position AS id, CASE WHEN position % 2 = 0 THEN dr + 0.5::DOUBLE ELSE dr::DOUBLE END AS dr, CASE WHEN position % 2 = 0 THEN CAST(dr AS VARCHAR) || '.5' ELSE CAST(dr AS VARCHAR) END AS shown, {_pick(PROFILES, "supp_id")} AS profile FROM tracks),
  r AS (SELECT a.id AS wanted_id, b.shown, b.dr, a.profile FROM d a LEFT JOIN m ON a.id = m.wanted_id LEFT JOIN d b ON b.id = m.known_id)
  SELECT wanted_id, coalesce(shown, 'N/A') AS dr, coalesce({grade_sql("dr", "profile")}, 'N/A') AS grade FROM r""",
)
KEYS = ("TAG:originaldate", "tag:Original Year", "TORY", "TAG:OriginalReleaseYear", "original_release", "TAG:date", "TAG:Release-Date", "my original mix date", "TAG:title", "Original--Year--Release")
FOLDERS = ("1985 - x", "[1986] y", "1987", "1988_z", "1989.", "1990", "x 1991", "19922", "album")


def _tag_lines(k: Column, n: int = 4) -> Column:
    """Tag lines made of a key: their names and years run through the lists at different paces."""
    line = lambda i: F.concat(choose(KEYS, k * (i + 1) + i * 3), F.lit("="), F.when((k + i) % 5 == 0, "n/a").when((k + i) % 3 == 0, F.concat(F.lit("on 7."), ((k * 7 + i * 13) % 1200 + 900).cast("string"))).otherwise(((k * 7 + i * 13) % 1200 + 900).cast("string")))
    return F.transform(F.sequence(F.lit(0), (k % n).cast("int")), line)


def _years(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    lines = F.when(k % 6 != 5, _tag_lines(k))
    return albums(spark, d).select("id", years.release_year(lines, F.concat(F.lit("/m/a/"), choose(FOLDERS, F.floor(k / 3)), F.when(k % 2 == 0, "/").otherwise("")), F.col("year_int")).alias("year"))


#: From albums: y, the year of the tags of the first release, and g, that of others; both text.
_TAG_YEARS_SQL = f"""s AS (SELECT id, unnest(range(id % 4 + 1)) AS i FROM albums),
  l AS (SELECT id, i, {_pick(tuple(re.sub("^(TAG|tag):", "", k).lower() for k in KEYS), "id * (i + 1) + i * 3")} AS name, CAST((id * 7 + i * 13) % 1200 + 900 AS VARCHAR) AS v, (id + i) % 5 <> 0 AS given FROM s),
  t AS (SELECT id, i, trim(regexp_replace(name, '[^a-z0-9]+', '_', 'g'), '_') AS key, regexp_extract(v, '([12][0-9]{{3}})', 1) AS year FROM l WHERE given AND regexp_matches(v, '[12][0-9]{{3}}')),
  u AS (SELECT *, list_position([{", ".join(f"'{k}'" for k in years.ORIGINAL)}], key) AS place FROM t),
  y AS (SELECT id, arg_min(year, (coalesce(place, 99), key, -i)) FILTER (place IS NOT NULL OR key = 'my_original_mix_date') AS y, arg_min(year, i) FILTER (key IN ('date', 'release_date')) AS g FROM u GROUP BY id)"""
add(
    "release_year",
    _years,
    f"""WITH {ALBUMS_SQL}, {_TAG_YEARS_SQL} SELECT a.id, CAST(coalesce(CASE WHEN a.id % 6 <> 5 THEN y.y END, list_extract(['1985', '1986', '1987', '1988', '1989', '1990', NULL, NULL, NULL], CAST(a.id // 3 % 9 + 1 AS BIGINT)), CASE WHEN a.id % 6 <> 5 THEN g END, CAST(year_int AS VARCHAR)) AS INTEGER) AS year
  FROM albums a LEFT JOIN y ON a.id = y.id""",
)


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """Albums that are wanted from the catalog; the folders of some are gone, and other rows of their name have one."""
    a, k = albums(spark, d), F.col("id")
    wanted = a.where("id % 5 < 3").select("id", "artist", "album", "year_int", F.when(k % 11 == 0, "").otherwise(F.col("source_path")).alias("source_path"))
    folders = a.where("id % 4 <> 1").select(F.col("source_path").alias("path"))
    tags = a.where("id % 3 = 0").select(F.col("source_path").alias("path"), _tag_lines(k).alias("lines"))
    return transfer.manifest(wanted, a, folders, tags, "/music/7")


add(
    "transfer_manifest",
    _manifest,
    f"""WITH {ALBUMS_SQL}, {_TAG_YEARS_SQL}, c AS (SELECT id, lower(artist) AS a, lower(album) AS b, year_int AS yr, source_path FROM albums WHERE id % 4 <> 1),
  w AS (SELECT id, artist, album, year_int, lower(artist) AS a, lower(album) AS b, CASE WHEN id % 11 = 0 OR id % 4 = 1 THEN NULL ELSE id END AS own FROM albums WHERE id % 5 < 3),
  f AS (SELECT w.*, coalesce(own, (SELECT max(c.id) FROM c WHERE c.id = w.id), (SELECT min(c.id) FROM c WHERE c.a = w.a AND c.b = w.b AND c.yr = w.year_int), (SELECT min(c.id) FROM c WHERE c.b = w.b AND c.yr = w.year_int)) AS src FROM w),
  j AS (SELECT f.*, s.source_path AS source, TRY_CAST(coalesce(CASE WHEN src % 3 = 0 THEN y.y END, regexp_extract(s.source_path, '/([12][0-9]{{3}})$', 1)) AS INTEGER) AS sure, TRY_CAST(CASE WHEN src % 3 = 0 THEN g END AS INTEGER) AS loose FROM f JOIN albums s ON s.id = src LEFT JOIN y ON y.id = src),
  z AS (SELECT *, CASE WHEN coalesce(sure, loose, CASE WHEN year_int BETWEEN 1000 AND 2999 THEN year_int ELSE 0 END) BETWEEN 1000 AND 2999 THEN coalesce(sure, loose, year_int) ELSE year_int END AS year FROM j)
  SELECT id, artist, album, year, source, CASE WHEN starts_with(source, '/music/7/') THEN substr(source, 10) ELSE upper(left(artist, 1)) || '/' || artist || '/' || CASE WHEN year > 0 THEN CAST(year AS VARCHAR) || ' - ' ELSE '' END || album END AS target FROM z""",
)
add(
    "ordered_dialogue",
    lambda spark, d: table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.max_by("role", "turn").alias("ends_with")),
    "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, max_by(role, turn) AS ends_with FROM conversations GROUP BY 1",
)
