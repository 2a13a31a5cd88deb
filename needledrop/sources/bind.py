"""The driver's tables as a catalog of albums, tracks, analysis windows and a discovery listing.

The same projection is stated twice: as DataFrames, and as common table expressions for an SQL engine that checks them.
Everything is integer arithmetic over keys, so both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from needledrop.operators.partitions import dealt

CODECS = ("flac", "alac", "mp3", "aac", "dts", "wav", "", " FLAC ", "adpcm_ms", "vorbis", "dca")
PROFILES = ("44.1/16", "96-24", "48k/24", "192000/32f", "mixed", "", "44100/16", "88.2/24")
TAGS = ("Rock;Indie", "Jazz", "Ambient;Electronic", "Classical", "Pop", "Classic Rock;Jazz", "", "Folk; Hip Hop")
RATES = (44100, 48000, 88200, 96000, 176400, 192000, 44100, 384000)
DEPTHS = (16, 24, 24, 32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(values: tuple, number: Column) -> Column:
    """values[number % len(values)]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: id, artist, album, year_int, flags, codec, profile, genre_tag, dr and times."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    k = F.col("o_orderkey")
    artist = F.when(k % 4 == 0, F.replace("c_name", F.lit("#"), F.lit(" - "))).when(k % 4 == 1, F.replace("c_name", F.lit("#"), F.lit(" "))).otherwise(F.col("c_name"))
    tenths = F.floor(F.col("o_totalprice")).cast("long") % 190
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(
        k.alias("id"),
        artist.alias("artist"),
        F.concat(F.col("o_orderpriority"), F.lit(" vol "), (k % 50).cast("string")).alias("album"),
        F.when(k % 11 == 0, 0).otherwise(F.year("o_orderdate")).cast("int").alias("year_int"),
        choose(CODECS, k).alias("codec"),
        choose(PROFILES, F.col("o_custkey")).alias("current_quality"),
        choose(TAGS, F.col("o_custkey") + k).alias("genre_tag"),
        F.when(k % 19 != 0, tenths.cast("double") / 10).alias("dynamic_range_score"),
        (k % 10 == 0).cast("int").alias("rarity"),
        (k % 17 == 0).cast("int").alias("scan_failed"),
        (k % 5 == 0).cast("int").alias("needs_recode"),
        (k % 7 == 0).cast("int").alias("needs_replacement"),
        (k % 6 == 0).cast("int").alias("has_lyrics"),
        F.when(k % 15 == 0, F.unix_timestamp("o_orderdate")).alias("last_recoded_at"),
        F.when(k % 13 != 0, F.unix_timestamp("o_orderdate")).alias("last_checked_at"),
        F.when(k % 5 == 0, F.lit("Recode to 44100/16")).when(k % 9 == 0, F.lit("")).alias("recode_recommendation"),
        F.when(k % 34 == 0, F.lit("probe failed")).when(k % 17 == 0, F.lit("")).alias("notes"),
        F.when(k % 8 != 0, F.concat((k % 320).cast("string"), F.lit("k"))).when(k % 16 == 0, F.lit("")).alias("bitrate"),
        F.concat(F.lit("/music/"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_name"), F.lit("/"), k.cast("string")).alias("source_path"),
    )


def tracks(spark: SparkSession, sf_dir: str, by_size: bool = False) -> DataFrame:
    """One row for each order line: album_id, position, rate, depth, codec, cutoff, dr, seconds, bytes.

    by_size: dealt by album in as many partitions as the size of the table asks for, the same number whatever is read of it.
    """
    t = table(spark, sf_dir, "lineitem")
    if by_size:
        t = dealt(t, "l_orderkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rate = F.when(F.col("l_linenumber") == 7, choose(RATES, F.col("l_orderkey") + 1)).otherwise(choose(RATES, F.col("l_orderkey")))
    return t.select(
        F.col("l_orderkey").alias("album_id"),
        F.row_number().over(order).cast("int").alias("position"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supp_id"),
        rate.cast("int").alias("sr"),
        choose(DEPTHS, F.col("l_orderkey") + F.col("l_linenumber")).cast("int").alias("bits"),
        choose(CODECS, F.col("l_orderkey") * 3 + F.when(F.col("l_linenumber") == 6, 1).otherwise(0)).alias("codec"),
        (cents % 96000).cast("int").alias("cutoff_hz"),
        (F.floor(F.col("l_quantity")).cast("int") % 18).alias("dr"),
        (F.floor(F.col("l_quantity")).cast("int") * 10).alias("seconds"),
        (cents % 1500000).alias("bitrate_bps"),
        (F.floor(F.col("l_discount") * 100 + 0.5).cast("int") - 8).alias("peak_tenths"),
    )


#: The same two tables for an SQL engine (DuckDB's functions).
def _pick(values: tuple, number: str) -> str:
    return "list_extract([" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f"], CAST(({number}) % {len(values)} + 1 AS BIGINT))"


ALBUMS_SQL = f"""albums AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 4 = 0 THEN replace(c_name, '#', ' - ') WHEN o_orderkey % 4 = 1 THEN replace(c_name, '#', ' ') ELSE c_name END AS artist,
    o_orderpriority || ' vol ' || CAST(o_orderkey % 50 AS VARCHAR) AS album,
    CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE year(o_orderdate) END AS INTEGER) AS year_int,
    {_pick(CODECS, "o_orderkey")} AS codec,
    {_pick(PROFILES, "o_custkey")} AS current_quality,
    {_pick(TAGS, "o_custkey + o_orderkey")} AS genre_tag,
    CASE WHEN o_orderkey % 19 <> 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 190 AS DOUBLE) / 10 END AS dynamic_range_score,
    CAST(o_orderkey % 10 = 0 AS INTEGER) AS rarity, CAST(o_orderkey % 17 = 0 AS INTEGER) AS scan_failed,
    CAST(o_orderkey % 5 = 0 AS INTEGER) AS needs_recode, CAST(o_orderkey % 7 = 0 AS INTEGER) AS needs_replacement,
    CAST(o_orderkey % 6 = 0 AS INTEGER) AS has_lyrics,
    CASE WHEN o_orderkey % 15 = 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS last_recoded_at,
    CASE WHEN o_orderkey % 13 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS last_checked_at,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Recode to 44100/16' WHEN o_orderkey % 9 = 0 THEN '' END AS recode_recommendation,
    CASE WHEN o_orderkey % 34 = 0 THEN 'probe failed' WHEN o_orderkey % 17 = 0 THEN '' END AS notes,
    CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_orderkey % 320 AS VARCHAR) || 'k' WHEN o_orderkey % 16 = 0 THEN '' END AS bitrate,
    '/music/' || CAST(c_nationkey AS VARCHAR) || '/' || c_name || '/' || CAST(o_orderkey AS VARCHAR) AS source_path
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

TRACKS_SQL = f"""tracks AS (
  SELECT l_orderkey AS album_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS position,
    l_partkey AS part_id, l_suppkey AS supp_id,
    CAST(CASE WHEN l_linenumber = 7 THEN {_pick(RATES, "l_orderkey + 1")} ELSE {_pick(RATES, "l_orderkey")} END AS INTEGER) AS sr,
    CAST({_pick(DEPTHS, "l_orderkey + l_linenumber")} AS INTEGER) AS bits,
    {_pick(CODECS, "l_orderkey * 3 + CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END")} AS codec,
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 96000 AS INTEGER) AS cutoff_hz,
    CAST(floor(l_quantity) AS INTEGER) % 18 AS dr, CAST(floor(l_quantity) AS INTEGER) * 10 AS seconds,
    CAST(round(l_extendedprice * 100) AS BIGINT) % 1500000 AS bitrate_bps,
    CAST(floor(l_discount * 100 + 0.5) AS INTEGER) - 8 AS peak_tenths
  FROM lineitem
)"""
