"""Queries of what probes tell, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from needledrop.functions import media, paths, text
from needledrop.operators.catalog_queries import Query
from needledrop.sources.bind import ALBUMS_SQL, TRACKS_SQL, _pick, albums, choose, table, tracks

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


PROFILES = ("4410016", "44.1k-24", "96 kHz : 24bits", "48000hz/fltp", "192/dblp", "44.0005k/16", "88.2:0", "176400/1234", "44k_16", "x/16", "float/float", "9624f", "", "96/032")
add(
    "profile_spellings",
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", text.canonical_profile(choose(PROFILES, F.col("o_orderkey"))).alias("profile")).withColumns({"folder": F.replace("profile", F.lit("/"), F.lit("_")), "rate": F.split_part("profile", F.lit("/"), F.lit(1)), "bits": F.split_part("profile", F.lit("/"), F.lit(2))}),
    f"""WITH raw AS (SELECT o_orderkey, replace(regexp_replace(lower({_pick(PROFILES, "o_orderkey")}), '\\s+', '', 'g'), '_', '/') AS x FROM orders),
    cut AS (SELECT o_orderkey, CASE WHEN regexp_matches(x, '^[^/:-]+[/:-][^/:-]+$') THEN regexp_extract(x, '^([^/:-]+)[/:-]([^/:-]+)$', 1) ELSE regexp_extract(x, '^([0-9]+(\\.[0-9]+)?(khz|k)?)([0-9]{{2,3}}f?)$', 1) END AS l,
      CASE WHEN regexp_matches(x, '^[^/:-]+[/:-][^/:-]+$') THEN regexp_extract(x, '^([^/:-]+)[/:-]([^/:-]+)$', 2) ELSE regexp_extract(x, '^([0-9]+(\\.[0-9]+)?(khz|k)?)([0-9]{{2,3}}f?)$', 4) END AS r FROM raw),
    num AS (SELECT *, TRY_CAST(regexp_extract(l, '^([0-9]+(\\.[0-9]+)?)(khz|hz|k)?$', 1) AS DOUBLE) AS n, regexp_extract(l, '^([0-9]+(\\.[0-9]+)?)(khz|hz|k)?$', 3) AS u, TRY_CAST(regexp_extract(r, '^([0-9]{{1,3}})(bits?|b)?$', 1) AS INTEGER) AS b FROM cut),
    made AS (SELECT o_orderkey, CAST(round_even(CASE WHEN u IN ('k', 'khz') OR (u = '' AND n < 1000) THEN n * 1000 ELSE n END, 0) AS INTEGER) AS hz,
      CASE WHEN r IN ('32f', 'f32', 'flt', 'fltp', 'float32') THEN '32f' WHEN r IN ('64f', 'f64', 'dbl', 'dblp', 'double', 'float64') THEN '64f' WHEN b > 0 THEN CAST(b AS VARCHAR) END AS bits FROM num),
    done AS (SELECT o_orderkey, CASE WHEN hz > 0 THEN CAST(hz AS VARCHAR) || '/' || bits END AS profile FROM made)
    SELECT o_orderkey, profile, replace(profile, '/', '_') AS folder, split_part(profile, '/', 1) AS rate, split_part(profile, '/', 2) AS bits FROM done""",
)
RECODES = ("Recode to 44.1k/16", "keep 96000:24 or 48/24", "Keep as-is", "to 88.2khz-24f now", "")
add(
    "profile_in_text",
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", text.profile_in(choose(RECODES, F.col("o_orderkey"))).alias("profile")),
    f"""SELECT o_orderkey, list_extract(['44100/16', '96000/24', NULL, NULL, NULL], CAST(o_orderkey % {len(RECODES)} + 1 AS BIGINT)) AS profile FROM orders""",
)
FORMATS = ("s16", "S24p", "s32", "fltp", " dbl ", "u8", "")
RAWS = ("24", "0", "", " 16 ", "x")
add(
    "bit_depths",
    lambda spark, d: tracks(spark, d).select(
        "album_id", "position", media.sample_bits(choose(FORMATS, F.col("part_id"))).alias("bits"), media.sample_label(choose(FORMATS, F.col("part_id"))).alias("label"),
        media.depth_label(choose(RAWS, F.col("album_id")), choose(RAWS, F.col("part_id")), choose(FORMATS, F.col("supp_id")), choose(("flac", "dsd_lsbf", "dst", ""), F.col("position"))).alias("depth"),
    ),
    f"""WITH {TRACKS_SQL}, f AS (SELECT *, lower(trim({_pick(FORMATS, "part_id")})) AS a, lower(trim({_pick(FORMATS, "supp_id")})) AS c, {_pick(("flac", "dsd_lsbf", "dst", ""), "position")} AS codec_name,
      TRY_CAST(trim({_pick(RAWS, "album_id")}) AS BIGINT) AS r, TRY_CAST(trim({_pick(RAWS, "part_id")}) AS BIGINT) AS k FROM tracks),
    g AS (SELECT *, CASE WHEN r > 0 THEN CAST(r AS VARCHAR) WHEN k > 0 THEN CAST(k AS VARCHAR) ELSE coalesce(map {{'s16': '16', 's24p': '24', 's32': '32', 'fltp': '32f', 'dbl': '64f'}}[c], '') END AS label FROM f)
    SELECT album_id, position, CAST(coalesce(map {{'s16': 16, 's24p': 24, 's32': 32, 'fltp': 32, 'dbl': 64}}[a], 0) AS INTEGER) AS bits, coalesce(map {{'s16': '16', 's24p': '24', 's32': '32', 'fltp': '32f', 'dbl': '64f'}}[a], '') AS label,
      CASE WHEN codec_name IN ('dsd_lsbf', 'dst') AND coalesce(TRY_CAST(label AS INTEGER), 0) < 24 THEN '24' ELSE label END AS depth FROM g""",
)
STREAMS = ("flac", "mpeg_layer_3", "", "Unknown ", "libvorbis", "wmav2", "n/a", "wmapro", "mp2")
LONGS = ("", "MPEG audio layer 3", "Opus  Interactive", "AAC (Advanced)", "Windows Media Audio 2", "odd: one", "unknown")
PATHS = ("/a/b.mp3", "/a/b.opus", "/a/b.WMA", "/a/b", "/a/.ogg", "/a/b.x y")
MARKS = ("0x0055", "", "0x0000", "[1][0]")
add(
    "codec_cascade",
    lambda spark, d: tracks(spark, d).select(
        "album_id", "position",
        media.codec_of(choose(STREAMS, F.col("part_id")), choose(("0", " 1 ", "1", "x"), F.col("cutoff_hz")), choose(LONGS, F.col("supp_id")), choose(MARKS, F.col("album_id")), choose(("", "AAC-LC", "n/a", "Main"), F.col("position")), choose(PATHS, F.col("dr"))).alias("codec"),
    ),
    f"""WITH {TRACKS_SQL}, f AS (SELECT album_id, position, cutoff_hz % 4 <> 3 AS is_stream, {_pick(("flac", "mp3", "", "", "vorbis", "wma", "", "wmapro", "mp2"), "part_id")} AS s, {_pick(("", "mpeg_audio_layer_3", "opus_interactive", "aac_advanced_", "windows_media_audio_2", "odd_one", ""), "supp_id")} AS l,
      {_pick(("0x0055", "", "", "_1_0_"), "album_id")} AS t, {_pick(("", "aac-lc", "", "main"), "position")} AS p, {_pick(("mp3", "opus", "wma", "", "", "x_y"), "dr")} AS e FROM tracks),
    g AS (SELECT *, array_to_string(list_filter([CASE WHEN t <> '' THEN 'tag=' || t END, CASE WHEN l <> '' THEN 'name=' || CASE l WHEN 'odd_one' THEN 'odd_one' WHEN 'aac_advanced_' THEN 'aac_advanced_' ELSE l END END, CASE WHEN p <> '' THEN 'profile=' || p END], lambda x: x IS NOT NULL), ';') AS told FROM f)
    SELECT album_id, position, CASE WHEN s <> '' THEN s WHEN NOT is_stream THEN '' WHEN l = 'mpeg_audio_layer_3' OR t = '0x0055' OR e = 'mp3' THEN 'mp3' WHEN l = 'opus_interactive' OR e = 'opus' THEN 'opus' WHEN l = 'aac_advanced_' OR p = 'aac-lc' THEN 'aac'
      WHEN l = 'windows_media_audio_2' OR e = 'wma' THEN 'wma' WHEN told <> '' THEN 'unknown{{' || told || CASE WHEN e <> '' THEN ';ext=' || e ELSE '' END || '}}' ELSE '' END AS codec FROM g""",
)
add(
    "bitrates",
    lambda spark, d: tracks(spark, d).select("album_id", "position", media.bitrate(F.when(F.col("position") % 3 != 0, (F.col("bitrate_bps") % 1000 * 997).cast("string")).otherwise("N/A"), F.when(F.col("position") % 2 == 0, F.col("bitrate_bps").cast("string"))).alias("bps")).select("*", media.kilobits(F.col("bps")).alias("kbps"), media.bitrate_label(F.col("bps")).alias("label"), media.truly_lossless(F.lit(" FLAC "), F.col("bps")).alias("lossless")),
    f"""WITH {TRACKS_SQL}, f AS (SELECT album_id, position, coalesce(nullif(CASE WHEN position % 3 <> 0 THEN bitrate_bps % 1000 * 997 END, 0), nullif(CASE WHEN position % 2 = 0 THEN bitrate_bps END, 0), 0) AS bps FROM tracks)
    SELECT album_id, position, CAST(bps AS BIGINT) AS bps, CAST((bps + 500) // 1000 AS BIGINT) AS kbps, CASE WHEN bps > 0 THEN CAST(CAST(round_even(bps / 1000.0::DOUBLE, 0) AS BIGINT) AS VARCHAR) || 'k' ELSE '' END AS label, bps > 500000 OR bps = 0 AS lossless FROM f""",
)
RATES = ("2822400", "3072000", "88200", "96000", "50000", "0")
add(
    "dsd_ceilings",
    lambda spark, d: table(spark, d, "supplier").select("s_suppkey", choose(RATES, F.col("s_suppkey")).cast("int").alias("source")).select("s_suppkey", media.dsd_ceiling(F.col("source")).alias("k"), media.family_label(F.col("source")).alias("label"), media.analysis_rate(F.col("source")).alias("analysed")).select("s_suppkey", "k.*", "label", "analysed"),
    f"""WITH f AS (SELECT s_suppkey, CAST({_pick(RATES, "s_suppkey")} AS INTEGER) AS r FROM supplier), g AS (SELECT *, CASE WHEN r <= 0 THEN 'fallback' WHEN r % 44100 = 0 THEN '44.1k-family' WHEN r % 48000 = 0 THEN '48k-family' ELSE 'fallback' END AS family FROM f),
    h AS (SELECT *, CASE WHEN family = '48k-family' THEN 192000 ELSE 176400 END AS top FROM g)
    SELECT s_suppkey, CAST(CASE WHEN r > 0 AND r < top THEN r ELSE top END AS INTEGER) AS rate, family, CASE WHEN r > 0 AND r < top THEN 'no-upscale' ELSE 'max-ceiling' END AS policy,
      CASE WHEN r % 48000 = 0 THEN '48k-family' WHEN r % 44100 = 0 THEN '44.1k-family' ELSE 'fallback' END AS label, CAST(least(r, 192000) AS INTEGER) AS analysed FROM h""",
)
add(
    "analysis_strategy",
    lambda spark, d: tracks(spark, d).select("album_id", "position", media.strategy(choose(("ape", "flac", "", "wavpack"), F.col("part_id")), choose(("/x.dsf", "/x.flac", "/x.wv"), F.col("supp_id")), F.col("album_id") % 2 == 0, F.col("bitrate_bps") * 300, F.col("seconds") * 4.0).alias("s"), media.decode_seconds(F.lit(8.0), F.col("seconds").cast("double")).alias("limit"), media.mode(choose(("EXACT", " fast", "full"), F.col("position"))).alias("mode")).select("album_id", "position", "s.*", "limit", "mode"),
    f"""WITH {TRACKS_SQL}, f AS (SELECT album_id, position, seconds, {_pick(("ape", "flac", "", "wavpack"), "part_id")} AS c, {_pick(("dsf", "flac", "wv"), "supp_id")} AS e, album_id % 2 = 0 AS sheet, bitrate_bps * 300 AS size, seconds * 4.0::DOUBLE AS dur FROM tracks),
    g AS (SELECT *, concat_ws(',', CASE WHEN c IN ('ape', 'wavpack') OR e IN ('dsf', 'wv') THEN 'expensive_codec:' || CASE WHEN c = '' THEN '.' || e ELSE c END END, CASE WHEN sheet AND size >= 104857600 THEN 'cue_backed_large_image' END,
      CASE WHEN dur >= 900 THEN 'long_duration:' || CAST(CAST(floor(dur) AS BIGINT) AS VARCHAR) || 's' END, CASE WHEN size >= 262144000 THEN 'large_file:' || CAST(size AS VARCHAR) END) AS r FROM f)
    SELECT album_id, position, CASE WHEN r <> '' THEN 'segment' ELSE 'fast' END AS strategy, CASE WHEN r <> '' THEN r ELSE 'normal_source' END AS reasons, CASE WHEN seconds > 0 THEN greatest(32.0, least(seconds * 2.0, 300.0))::DOUBLE ELSE 32.0::DOUBLE END AS limit,
      list_extract(['exact', 'fast', 'auto'], CAST(position % 3 + 1 AS BIGINT)) AS mode FROM g""",
)
LABELS = ("0 22.05 kHz 48k", "44100 Hz, 96000", "7 kHz and 500 kHz", "no number", "24 1000 8K")
add(
    "axis_labels",
    lambda spark, d: table(spark, d, "customer").select("c_custkey", media.axis_khz(choose(LABELS, F.col("c_custkey"))).alias("k"), media.nearest_tier(F.col("c_custkey") % 1000 / 10.0).alias("tier")).select("c_custkey", F.size("k").cast("long").alias("n"), F.array_max("k").alias("highest"), "tier"),
    """WITH t AS (SELECT c_custkey, unnest([22.05, 24.0, 48.0, 96.0]::DOUBLE[]) AS tier FROM customer),
    best AS (SELECT c_custkey, arg_min(tier, abs(c_custkey % 1000 / 10.0::DOUBLE - tier) * 1000 + tier / 1000) AS tier FROM t GROUP BY c_custkey)
    SELECT c_custkey, CAST(list_extract([2, 2, 0, 0, 1], CAST(c_custkey % 5 + 1 AS BIGINT)) AS BIGINT) AS n, list_extract([48.0, 96.0, NULL, NULL, 8.0]::DOUBLE[], CAST(c_custkey % 5 + 1 AS BIGINT)) AS highest, tier FROM customer JOIN best USING (c_custkey)""",
)
add(
    "image_rows",
    lambda spark, d: table(spark, d, "customer").select("c_custkey", media.row_khz(F.col("c_custkey") % 400, F.lit(400), F.lit(48.0)).alias("khz"), media.khz_row(F.col("c_custkey") % 60 * 1.0, F.lit(400), F.lit(48.0)).cast("long").alias("row"), media.row_khz(F.col("c_custkey"), F.lit(1), F.lit(48.0)).alias("none")),
    "SELECT c_custkey, 48.0::DOUBLE * (1 - (c_custkey % 400) / 399.0::DOUBLE) AS khz, CAST(trunc((1 - least(c_custkey % 60 * 1.0::DOUBLE, 48.0) / 48.0) * 399) AS BIGINT) AS row, 0.0::DOUBLE AS none FROM customer",
)
add(
    "audio_names",
    lambda spark, d: table(spark, d, "pages").select("page_id", F.concat(F.lit("/m/x."), choose(("FLAC", "txt", "wv", "jpg", "Opus", "m4a.part"), F.col("page_id"))).alias("path")).where(media.is_audio(F.col("path"))).groupBy(media.ending(F.col("path")).alias("ending")).agg(F.count("*").alias("n")),
    "SELECT list_extract(['flac', '', 'wv', '', 'opus', ''], CAST(page_id % 6 + 1 AS BIGINT)) AS ending, count(*) AS n FROM pages WHERE page_id % 6 IN (0, 2, 4) GROUP BY ALL",
)
#: A moment from which on whole days and runs every 35 minutes begin together.
DAY = 604_800 * 2_800
add(
    "titles_and_runs",
    lambda spark, d: albums(spark, d).select("id", media.title_case(F.lower("artist")).alias("title"), paths.next_even_run(F.lit(DAY) + F.col("id") % 1440 * 60, F.lit(35)).alias("run")),
    f"""WITH {ALBUMS_SQL}, f AS (SELECT id, artist, CAST(((id % 1440 + 34) // 35 * 35) % 1440 AS BIGINT) AS m FROM albums)
    SELECT id, array_to_string(list_transform(string_split(lower(artist), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title, lpad(CAST(m // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS run FROM f""",
)
