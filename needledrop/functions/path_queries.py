"""Queries of keys, paths and marks, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from needledrop.functions import paths
from needledrop.operators.catalog_queries import Query
from needledrop.sources.bind import ALBUMS_SQL, TRACKS_SQL, _pick, albums, choose, table, tracks

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _file(spark, d):
    """Files of albums with some tags; folders with and without years."""
    k = F.col("id")
    folder = F.concat(F.when(k % 3 != 0, F.concat(F.lpad(F.col("year_int").cast("string"), 4, "0"), F.lit(" - "))).when(k % 4 == 1, F.lit("Live 1977 ")).otherwise(""), F.col("album"))
    tags = F.create_map(
        F.lit("album_artist"), F.when(k % 5 == 0, F.concat(F.lit("AA "), F.col("artist"))).when(k % 5 == 1, ""), F.lit("artist"), F.when(k % 7 < 3, F.col("artist")),
        F.lit("album"), F.when(k % 4 == 0, F.concat("album", F.lit(" (tag)"))), F.lit("date"), F.when(k % 6 == 0, "on 12.1987").when(k % 6 == 1, "87"), F.lit("genre"), F.when(k % 2 == 0, "Rock"),
    )
    return albums(spark, d).select("id", tags.alias("tags"), F.concat(F.lit("/m/"), F.when(k % 9 == 0, "_VA").otherwise(F.col("artist")), F.lit("/"), folder, F.lit("/01.flac")).alias("path"))


_FILE = f"""{ALBUMS_SQL}, files AS (SELECT id, CASE WHEN id % 9 = 0 THEN '_VA' ELSE artist END AS above, CASE WHEN id % 3 <> 0 THEN lpad(CAST(year_int AS VARCHAR), 4, '0') || ' - ' WHEN id % 4 = 1 THEN 'Live 1977 ' ELSE '' END || album AS folder,
  CASE WHEN id % 5 = 0 THEN 'AA ' || artist END AS aa, CASE WHEN id % 7 < 3 THEN artist END AS a, CASE WHEN id % 4 = 0 THEN album || ' (tag)' END AS al, CASE WHEN id % 6 = 0 THEN '1987' END AS y, CASE WHEN id % 2 = 0 THEN 'Rock' END AS g FROM albums)"""
add(
    "album_key",
    lambda spark, d: _file(spark, d).select("id", paths.album_key(F.col("tags"), F.col("path")).alias("k")).select("id", "k.*"),
    f"""WITH {_FILE} SELECT id, coalesce(aa, a, CASE WHEN above = '_VA' THEN 'Various Artists' ELSE above END) AS artist, coalesce(y, nullif(regexp_extract(folder, '[0-9]{{4}}'), ''), '0000') AS year, coalesce(al, regexp_replace(folder, '^[0-9]{{4}} - ', '')) AS album, g AS genre FROM files""",
)
NAMES = ("AC/DC", " 3 doors", "ünder", "", "beatles ", "_x/", "Zed")
_NAME = _pick(NAMES, "id % 13")
add(
    "library_path",
    lambda spark, d: albums(spark, d).select("id", paths.library_path_for(F.col("source_path"), "/music/7", choose(NAMES, F.col("id") % 13), F.col("year_int"), F.concat("album", F.when(F.col("id") % 4 == 0, "/live").otherwise(""))).alias("path")),
    f"""WITH {ALBUMS_SQL}, n AS (SELECT *, coalesce(nullif(trim(replace({_NAME}, '/', '_')), ''), 'unknown') AS a FROM albums), i AS (SELECT *, CASE WHEN left(a, 1) IN ('u', 'b', 'Z', 'A', '3') THEN upper(left(a, 1)) ELSE '_' END AS first FROM n)
    SELECT id, CASE WHEN starts_with(source_path, '/music/7/') THEN substr(source_path, 10) ELSE first || '/' || a || '/' || CASE WHEN year_int > 0 THEN CAST(year_int AS VARCHAR) || ' - ' ELSE '' END || album || CASE WHEN id % 4 = 0 THEN '_live' ELSE '' END END AS path FROM i""",
)
add(
    "cue_index",
    lambda spark, d: tracks(spark, d).select("album_id", "position", F.concat_ws(":", F.lpad((F.col("seconds") % 90).cast("string"), 2, "0"), F.lpad((F.col("cutoff_hz") % 70).cast("string"), 2, "0"), F.lpad((F.col("dr") * 4).cast("string"), 2, "0")).alias("mark")).select("album_id", "position", paths.index_seconds(F.col("mark")).alias("at")),
    f"WITH {TRACKS_SQL} SELECT album_id, position, CASE WHEN cutoff_hz % 70 < 60 AND dr * 4 < 80 THEN round((seconds % 90) * 60 + cutoff_hz % 70 + (dr * 4) / 75.0::DOUBLE, 6) END AS at FROM tracks",
)
add(
    "clipped_text",
    lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", paths.clipped(F.col("text"), 52).alias("text")),
    "SELECT conv_id, turn, CASE WHEN length(text) > 52 THEN rtrim(left(text, 49), ' ') || '...' ELSE text END AS text FROM conversations",
)
add(
    "unsorted_names",
    lambda spark, d: table(spark, d, "customer").select("c_custkey", paths.unsorted_name(F.concat_ws(", ", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))).alias("name")),
    "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || ' ' || c_name ELSE c_name END AS name FROM customer",
)
_MINUTES = "CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 26) * 60 ELSE s_suppkey % 90 END"


def _schedules(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k, F.when(k % 3 == 0, k % 26 * 60).otherwise(k % 90).alias("minutes"), (k * 97 % 1440).alias("now"), F.when(k % 5 == 0, k % 4).alias("given"))
    cron = F.col("schedule")
    return rows.withColumn("schedule", paths.cron(F.col("minutes"))).select(k, cron, paths.next_run(cron, F.col("now")).alias("next"), paths.longest_run(F.col("minutes"), F.col("given")).alias("longest"), paths.next_even_run(F.lit(1_700_000_000) + k * 7777, F.col("minutes")).alias("even"))


add(
    "cron_schedules",
    _schedules,
    f"""WITH m AS (SELECT s_suppkey, {_MINUTES} AS m, s_suppkey * 97 % 1440 AS now, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 4 END AS given, 1700000000 + s_suppkey * 7777 AS clock FROM supplier),
    c AS (SELECT *, CASE WHEN m = 0 THEN NULL WHEN m < 60 THEN '*/' || CAST(m AS VARCHAR) || ' * * * *' WHEN m = 60 THEN '0 * * * *' WHEN m = 1440 THEN '0 0 * * *' WHEN m < 1440 AND m % 60 = 0 THEN '0 */' || CAST(m // 60 AS VARCHAR) || ' * * *' END AS schedule,
      CASE WHEN m BETWEEN 1 AND 720 THEN m ELSE 20 END * 60 AS step FROM m),
    n AS (SELECT *, CASE WHEN m = 0 THEN NULL WHEN m < 60 THEN CASE WHEN (now % 60 // m + 1) * m >= 60 THEN (now // 60 + 1) % 24 * 60 ELSE now // 60 * 60 + (now % 60 // m + 1) * m END WHEN m = 60 THEN (now // 60 + 1) % 24 * 60 WHEN m = 1440 THEN 0
      WHEN m % 60 = 0 THEN CASE WHEN (now // 60 // (m // 60) + 1) * (m // 60) < 24 THEN (now // 60 // (m // 60) + 1) * m ELSE 0 END END AS soon FROM c)
    SELECT s_suppkey, schedule, CASE WHEN schedule IS NOT NULL THEN lpad(CAST(soon // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(soon % 60 AS VARCHAR), 2, '0') END AS next,
      CAST(CASE WHEN given >= 1 THEN given WHEN m < 1 THEN 0 WHEN m > 2 THEN m * 60 - 120 ELSE m * 60 END AS BIGINT) AS longest, strftime(make_timestamp(((clock + step - 1) // step) * step * 1000000), '%H:%M') AS even FROM n""",
)
