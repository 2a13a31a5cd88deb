"""Planning queries over the bound tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.functions import text
from needledrop.functions.grading import grade
from needledrop.operators.catalog_queries import Query, any_part, grade_sql, names, norm_sql
from needledrop.plans import planning
from needledrop.sources.bind import ALBUMS_SQL, TRACKS_SQL, albums, choose, table, tracks

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_LOSSY = f"({{0}} IN ({names(text.LOSSY)}) OR starts_with({{0}}, 'adpcm_'))"
_SUMMARY = f"""{TRACKS_SQL}, r AS (SELECT album_id, CAST(sr AS VARCHAR) || '/' || CAST(bits AS VARCHAR) AS profile, {norm_sql('codec')} AS codec, (bitrate_bps + 500) // 1000 AS kbps FROM tracks), summary AS (
  SELECT album_id, CASE WHEN min(profile) = max(profile) THEN min(profile) ELSE 'mixed' END AS profile, CASE WHEN min(codec) = max(codec) THEN min(codec) ELSE 'mixed' END AS codec,
  bool_or({_LOSSY.format('r.codec')}) AS any_lossy, count(*) AS n_tracks, CAST(CASE WHEN count(*) FILTER (kbps > 0) > 0 THEN (sum(kbps) FILTER (kbps > 0) + count(*) FILTER (kbps > 0) // 2) // count(*) FILTER (kbps > 0) ELSE 0 END AS BIGINT) AS mean_kbps FROM r GROUP BY album_id)"""
add("album_summary", lambda spark, d: planning.album_summary(tracks(spark, d)), f"WITH {_SUMMARY} SELECT * FROM summary")
add("mixed_albums", lambda spark, d: planning.album_summary(tracks(spark, d)).where("profile = 'mixed' or codec = 'mixed'").select("album_id", "profile", "codec"), f"WITH {_SUMMARY} SELECT album_id, profile, codec FROM summary WHERE profile = 'mixed' OR codec = 'mixed'")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = tracks(spark, d).withColumn("pair", F.floor(F.col("album_id") / 2).cast("long"))
    return planning.compare(rows.where("album_id % 2 = 0"), rows.where("album_id % 2 = 1"))


_STANDARD = "'standard'"
add(
    "compare_albums",
    _pairs,
    f"""WITH {TRACKS_SQL}, l AS (SELECT album_id // 2 AS pair, position, dr FROM tracks WHERE album_id % 2 = 0), r AS (SELECT album_id // 2 AS pair, position, dr FROM tracks WHERE album_id % 2 = 1),
  j AS (SELECT coalesce(l.pair, r.pair) AS pair, coalesce(l.position, r.position) AS position, l.dr AS left_dr, r.dr AS right_dr FROM l FULL OUTER JOIN r ON l.pair = r.pair AND l.position = r.position)
  SELECT *, {grade_sql('left_dr', _STANDARD)} AS left_grade, {grade_sql('right_dr', _STANDARD)} AS right_grade, CASE WHEN left_dr > right_dr THEN 'left' WHEN left_dr < right_dr THEN 'right' WHEN left_dr = right_dr THEN 'equal' END AS better FROM j""",
)
add(
    "worst_grade",
    lambda spark, d: planning.worst_grade(tracks(spark, d)),
    f"""WITH {TRACKS_SQL}, g AS (SELECT album_id, dr, CASE {grade_sql('dr', _STANDARD)} WHEN 'S' THEN 5 WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 ELSE 1 END AS rank FROM tracks)
  SELECT album_id, list_extract(['F', 'C', 'B', 'A', 'S'], min(rank)) AS worst, CAST(round_even(avg(dr), 0) AS INTEGER) AS mean_dr FROM g GROUP BY album_id""",
)
add("boost_plan", lambda spark, d: planning.boost_plan(tracks(spark, d)).drop("label"), f"WITH {TRACKS_SQL}, p AS (SELECT album_id, round(-1.5::DOUBLE - max(peak_tenths) / 10.0::DOUBLE, 3) AS gain_db FROM tracks GROUP BY album_id) SELECT album_id, gain_db, abs(gain_db) >= 0.3::DOUBLE AS apply FROM p")
add(
    "loudness_weighted",
    lambda spark, d: planning.loudness(tracks(spark, d)),
    f"WITH {TRACKS_SQL}, l AS (SELECT album_id, round(CAST(sum(peak_tenths * seconds) AS DOUBLE) / CAST(sum(seconds) AS DOUBLE) / 10 - 14, 4) AS loudness FROM tracks WHERE seconds > 0 GROUP BY album_id) SELECT album_id, loudness, CAST(round((-23 - loudness) * 256) AS BIGINT) AS fixed_gain FROM l",
)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = tracks(spark, d).where("position = 1").select(F.col("album_id").alias("id"), "sr", "bits")
    existing = rows.select("id", choose(("mp3_128_upscaled", "aac_256_upscaled", "44100/16", "opus_96_upscaled"), F.col("id")).alias("variant"))
    return planning.dataset_matrix(rows, existing)


add(
    "dataset_matrix",
    _matrix,
    f"""WITH {TRACKS_SQL}, s AS (SELECT album_id AS id, sr, bits FROM tracks WHERE position = 1), v AS (SELECT unnest([{names((*planning.CLEAN, *planning.VARIANTS))}]) AS variant)
  SELECT id, variant FROM s, v WHERE (NOT contains(variant, '/') OR TRY_CAST(split_part(variant, '/', 1) AS INTEGER) < sr OR (TRY_CAST(split_part(variant, '/', 1) AS INTEGER) = sr AND TRY_CAST(split_part(variant, '/', 2) AS INTEGER) < bits)) AND variant <> list_extract(['mp3_128_upscaled', 'aac_256_upscaled', '44100/16', 'opus_96_upscaled'], CAST(id % 4 + 1 AS BIGINT))""",
)
def _to_convert(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("part_id")
    path = F.concat(F.lit("/a/"), F.col("album_id").cast("string"), F.lit("/t"), (k % 40).cast("string"), choose((".wav", ".x.dsf", ".m4a"), k))
    t = tracks(spark, d).withColumns({"path": path, "codec": F.when(k % 17 == 0, "dsd_lsbf").otherwise(F.col("codec")), "sr": F.when(k % 23 != 0, F.col("sr").cast("string")).otherwise("N/A"), "bits": F.when(k % 17 == 0, 1).when(k % 29 != 0, F.col("bits")).otherwise(0)})
    return planning.preflight(t, 88200, 24)


add(
    "preflight",
    _to_convert,
    f"""WITH {TRACKS_SQL}, s AS (SELECT album_id, position, '/a/' || album_id || '/t' || (part_id % 40) AS stem, CASE part_id % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.x.dsf' ELSE '.m4a' END AS e, CASE WHEN part_id % 17 = 0 THEN 'dsd_lsbf' ELSE {norm_sql('codec')} END AS c,
    CASE WHEN part_id % 23 <> 0 THEN sr ELSE 0 END AS sr, CASE WHEN part_id % 17 = 0 THEN 24 WHEN part_id % 29 <> 0 THEN bits ELSE 0 END AS bits, chr(39) AS q FROM tracks),
  x AS (SELECT *, stem || e AS path, stem || replace(replace(replace(e, '.wav', ''), '.dsf', ''), '.m4a', '') AS target FROM s), y AS (SELECT *, first_value(path) OVER (PARTITION BY album_id, target ORDER BY position) AS first FROM x),
  z AS (SELECT album_id, position, path, CASE WHEN first <> path THEN 'target collision: ' || q || first || q || ' and ' || q || path || q || ' both map to ' || q || target || '.flac' || q WHEN c = '' THEN path || ': unable to detect codec'
    WHEN {_LOSSY.format('c')} THEN path || ': lossy source codec ' || q || c || q || ' is not allowed for FLAC replace workflow' WHEN sr = 0 THEN path || ': unable to detect sample rate' WHEN bits = 0 THEN path || ': unable to detect bit depth'
    WHEN 88200 > sr OR 24 > bits THEN path || ': target ' || q || '88200/24' || q || ' is higher than source ' || q || sr || '/' || bits || q || ' (upscale blocked)' END AS error FROM y) SELECT * FROM z WHERE error IS NOT NULL""",
)
_SPLIT = f"""{TRACKS_SQL}, st AS (SELECT album_id, position, round(coalesce(sum(seconds) OVER (PARTITION BY album_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (cutoff_hz % 75) / 75.0::DOUBLE, 6) AS start FROM tracks)"""
add("cue_split", lambda spark, d: planning.split_plan(tracks(spark, d)).drop("in_order"), f"WITH {_SPLIT} SELECT album_id, position, start, round(lead(start) OVER (PARTITION BY album_id ORDER BY position) - start, 6) AS duration FROM st")
add("cue_monotonic", lambda spark, d: planning.split_plan(tracks(spark, d)).where("not in_order").select("album_id", "position"), f"WITH {_SPLIT}, o AS (SELECT album_id, position, lag(start) OVER (PARTITION BY album_id ORDER BY position) AS prev, start FROM st) SELECT album_id, position FROM o WHERE prev >= start")
add("carry_forward", lambda spark, d: planning.carried(table(spark, d, "conversations")), "SELECT conv_id, turn, role, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked_at FROM conversations")
add(
    "axis_runs",
    lambda spark, d: planning.runs(table(spark, d, "events").select(F.col("user_id").alias("key"), F.floor("value").cast("long").alias("value")), 1, 6),
    """WITH v AS (SELECT DISTINCT user_id AS key, CAST(floor(value) AS BIGINT) AS value FROM events), s AS (SELECT *, value - lag(value) OVER (PARTITION BY key ORDER BY value) AS step FROM v),
  b AS (SELECT *, sum(CASE WHEN step BETWEEN 1 AND 6 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY value) AS island FROM s), c AS (SELECT key, island, count(*) AS n FROM b GROUP BY 1, 2) SELECT key, max(n) AS longest FROM c GROUP BY key""",
)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).select(F.col("album_id").alias("key"), F.col("position").alias("row"), F.col("dr").alias("value"))


add(
    "sustained_row",
    lambda spark, d: planning.smoothed(_rows(spark, d), half=1, sustain=2, threshold=7.0),
    f"""WITH {TRACKS_SQL}, s AS (SELECT album_id AS key, position AS row, sum(dr) OVER (PARTITION BY album_id ORDER BY position ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0::DOUBLE AS soft FROM tracks),
  a AS (SELECT *, avg(soft) OVER w AS ahead, count(*) OVER w AS remain FROM s WINDOW w AS (PARTITION BY key ORDER BY row ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) SELECT key, min(row) AS first_row FROM a WHERE remain = 2 AND ahead >= 7 GROUP BY key""",
)
add(
    "even_sampling",
    lambda spark, d: planning.even_sample(tracks(spark, d).select(F.col("album_id").alias("key"), "position")),
    f"""WITH {TRACKS_SQL}, n AS (SELECT album_id AS key, position, row_number() OVER (PARTITION BY album_id ORDER BY position) - 1 AS i, count(*) OVER (PARTITION BY album_id) AS n FROM tracks)
  SELECT key, position FROM n WHERE n <= 3 OR i IN (0, (n - 1) // 2, n - 1)""",
)


def _cache(spark: SparkSession, d: str) -> DataFrame:
    rows = tracks(spark, d).select("album_id", F.concat_ws("-", "album_id", "position").alias("path"), F.col("cutoff_hz").alias("mtime"), F.col("bitrate_bps").alias("size"))
    cache = rows.where("mtime % 3 <> 0").select("path", (F.col("mtime") + F.when(F.col("size") % 5 == 0, 1).otherwise(0)).alias("mtime"), "size")
    return planning.cache_hits(rows, cache)


add("cache_hits", _cache, f"WITH {TRACKS_SQL} SELECT album_id, count(*) FILTER (cutoff_hz % 3 <> 0 AND bitrate_bps % 5 <> 0) AS hits, count(*) FILTER (cutoff_hz % 3 = 0 OR bitrate_bps % 5 = 0) AS misses FROM tracks GROUP BY album_id")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    found = albums(spark, d).where("id % 9 <> 0").select(F.col("source_path").alias("path"), (k % 4).alias("target"), choose(("keep", "down"), k).alias("decision"))
    expected = albums(spark, d).select(F.col("source_path").alias("path"), choose(("trusted", "weak"), k).alias("trust"), F.when(k % 8 == 1, 7).otherwise(k % 4).alias("target"), choose(("keep", "down", "keep"), k).alias("decision"))
    return planning.corpus_check(found, expected)


add(
    "corpus_eval",
    _corpus,
    f"""WITH {ALBUMS_SQL}, x AS (SELECT id, id % 9 = 0 AS gone, CASE WHEN id % 2 = 0 THEN 'trusted' ELSE 'weak' END AS trust, id % 8 = 1 OR (id % 2 = 1) <> (id % 3 = 1) AS wrong FROM albums)
  SELECT CASE WHEN gone THEN 'error' WHEN NOT wrong THEN 'pass' WHEN trust = 'trusted' THEN 'fail' ELSE 'warn' END AS status, count(*) AS n FROM x GROUP BY 1""",
)


def _releases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    return planning.release_scores(
        p.select(
            F.floor(k / 5).cast("long").alias("query_id"), (k % 5).alias("place"), F.when(k % 31 != 0, k.cast("string")).otherwise(" ").alias("release_id"), F.when(k % 3 == 0, F.concat("p_name", F.lit(" (Live)"))).when(k % 3 == 1, F.upper("p_name")).otherwise(F.col("p_name")).alias("title"),
            F.col("p_name").alias("wanted_title"), F.when(k % 7 == 0, F.lit("Nobody")).otherwise(F.concat("p_brand", F.lit(", Ensemble"))).alias("artist"), F.when(k % 4 == 0, "someone else").otherwise(F.concat(F.lit("Ensemble: "), "p_brand")).alias("wanted_artist"),
            choose(("1990-05-01", "1991", "", "n/a"), k).alias("date"), F.when(k % 10 < 8, F.lit("1990")).alias("wanted_year"), F.when(k % 9 != 0, (k % 130 - 10).cast("string")).otherwise("x").alias("source_score"),
        )
    )


add(
    "release_candidates",
    _releases,
    """WITH x AS (SELECT p_partkey // 5 AS query_id, p_partkey % 5 AS place, p_partkey AS k, p_partkey % 3 <> 0 AS exact, p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 AS artist, CASE p_partkey % 4 WHEN 0 THEN 1990 WHEN 1 THEN 1991 END AS y, CASE WHEN p_partkey % 10 < 8 THEN 1990 END AS w, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 130 - 10 ELSE 0 END AS src FROM part WHERE p_partkey % 31 <> 0),
  s AS (SELECT *, CASE WHEN exact THEN 120 ELSE 40 END + CASE WHEN artist THEN 80 ELSE 0 END + CASE WHEN y = w THEN 20 WHEN y <> w THEN -40 ELSE 0 END + least(greatest(src, 0), 100) // 5 + CASE WHEN exact AND artist THEN 30 ELSE 0 END AS score FROM x),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS n FROM s WHERE score > -1) SELECT query_id, CAST(k AS VARCHAR) AS release_id, CAST(score AS INTEGER) AS score FROM r WHERE n = 1 AND exact AND artist AND NOT coalesce(y <> w, false)""",
)


def _figures(spark: SparkSession, d: str) -> DataFrame:
    t = tracks(spark, d)
    k = F.col("cutoff_hz")
    return t.select(
        (F.col("album_id") * 100 + F.col("position")).alias("id"), choose((22.0, 24.0, 48.0, 96.0), F.col("album_id")).alias("top"), F.least(choose((22.0, 24.0, 48.0, 96.0), F.col("album_id")), (k % 97).cast("double")).alias("cutoff"),
        (k % 3 != 0).alias("transition"), (k % 4 != 0).alias("stats"), F.when(k % 4 != 0, (k % 50 - 40).cast("double") / 10).alias("peak"), F.when(k % 5 != 0, F.col("dr").cast("double")).alias("dr"),
        (k % 40).cast("double").alias("span"), (k % 20).cast("double").alias("r20"), (k % 6 == 0).alias("brickwall"),
    ).withColumn("ratio", F.col("r20") / 10)


_CARD = f"""{TRACKS_SQL}, f AS (SELECT album_id * 100 + position AS id, list_extract([22.0::DOUBLE, 24.0::DOUBLE, 48.0::DOUBLE, 96.0::DOUBLE], CAST(album_id % 4 + 1 AS BIGINT)) AS top, cutoff_hz AS k, dr AS d FROM tracks),
  x AS (SELECT id, top, least(top, CAST(k % 97 AS DOUBLE)) AS cutoff, k % 3 <> 0 AS transition, k % 4 <> 0 AS stats, CASE WHEN k % 4 <> 0 THEN CAST(k % 50 - 40 AS DOUBLE) / 10 END AS peak, CASE WHEN k % 5 <> 0 THEN CAST(d AS DOUBLE) END AS dr, CAST(k % 40 AS DOUBLE) AS span, CAST(k % 20 AS DOUBLE) / 10 AS ratio, k % 6 = 0 AS brick FROM f), pr AS (SELECT *, NOT brick AND transition AND top BETWEEN 44 AND 52 AND cutoff BETWEEN 21 AND 26 AND span >= 28 AND ratio >= 0.55::DOUBLE AS promoted FROM x),
  b AS (SELECT *, CASE WHEN promoted THEN 'hires-96-class' WHEN top <= 24.5 THEN CASE WHEN cutoff / top < 0.55::DOUBLE THEN 'low-bandwidth' ELSE 'cd-or-48k' END WHEN top <= 50 THEN CASE WHEN cutoff < 16 THEN 'low-bandwidth' WHEN cutoff < 30 THEN 'cd-or-48k' ELSE 'hires-96-class' END
    WHEN cutoff < 18 THEN 'low-bandwidth' WHEN cutoff < 26 THEN 'cd-or-48k' WHEN cutoff < 52 THEN 'hires-96-class' ELSE 'hires-192-class' END AS band FROM pr),
  r AS (SELECT *, band IN ('hires-96-class', 'hires-192-class') AS hires, 62 + CASE band WHEN 'low-bandwidth' THEN -20 WHEN 'hires-96-class' THEN 8 WHEN 'hires-192-class' THEN 10 ELSE 0 END
    + CASE WHEN transition THEN 6 ELSE -4 END + CASE WHEN stats THEN 3 ELSE -2 END + CASE WHEN peak IS NULL THEN -2 WHEN peak > 0.2::DOUBLE THEN -25 WHEN peak >= -0.2::DOUBLE THEN -10 WHEN peak <= -2 THEN 10 ELSE 3 END
    + CASE WHEN dr IS NULL THEN -5 WHEN dr >= 14 THEN 20 WHEN dr >= 10 THEN 10 WHEN dr >= 7 THEN -5 ELSE -20 END + CASE WHEN peak IS NULL AND dr IS NULL THEN -2 ELSE 0 END
    + CASE WHEN NOT brick AND band = 'cd-or-48k' AND cutoff >= 0.75::DOUBLE * top THEN 35 ELSE 0 END
    + CASE WHEN brick THEN -35 WHEN band IN ('hires-96-class', 'hires-192-class') THEN CASE WHEN top >= 90 AND cutoff >= 50 THEN 10 WHEN top >= 44 AND cutoff >= 0.88::DOUBLE * top THEN 8 ELSE 0 END + CASE WHEN span >= 30 THEN 8 ELSE 0 END + CASE WHEN ratio BETWEEN 0.25::DOUBLE AND 1.4::DOUBLE THEN 4 ELSE 0 END
      WHEN band = 'cd-or-48k' AND top >= 90 AND cutoff >= 18 THEN 14 ELSE 0 END AS raw FROM b),
  s AS (SELECT *, greatest(0, least(100, CASE WHEN peak IS NULL AND dr IS NULL AND band = 'cd-or-48k' THEN least(raw, 69) WHEN peak IS NULL AND dr IS NULL AND hires THEN least(raw, 85) ELSE raw END)) AS score FROM r),
  card AS (SELECT * EXCLUDE (score), CAST(score AS INTEGER) AS score, CASE WHEN hires AND NOT brick AND (score >= 95 OR (score >= 93 AND cutoff >= 50 AND span >= 30 AND ratio <= 0.6::DOUBLE) OR coalesce(score >= 90 AND dr >= 20, false)) THEN 'S'
    WHEN score >= 86 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 54 THEN 'C' WHEN score >= 38 THEN 'D' ELSE 'F' END AS class,
    CASE WHEN CAST(transition AS INT) + CAST(stats AS INT) + CAST(peak IS NOT NULL AS INT) + 2 * CAST(dr IS NOT NULL AS INT) >= 4 THEN 'HIGH' WHEN CAST(transition AS INT) + CAST(stats AS INT) + CAST(peak IS NOT NULL AS INT) + 2 * CAST(dr IS NOT NULL AS INT) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s)"""
add(
    "score_card",
    lambda spark, d: planning.score_card(_figures(spark, d)),
    f"WITH {_CARD} SELECT id, band, score, class, confidence FROM card",
)


def _part(*cases: tuple[str, str]) -> str:
    one = lambda n: "{'factor': '%s', 'points': %d, 'reason': '%s'}" % planning.PARTS[n]  # noqa: E731, UP031
    return "CASE " + " ".join(f"WHEN {test} THEN {one(n)}" for test, n in cases) + " END"


_ALL_PARTS = ", ".join(
    (
        _part(("band = 'low-bandwidth'", "low band"), ("band = 'hires-96-class'", "96 band"), ("band = 'hires-192-class'", "192 band"), ("true", "other band")), _part(("transition", "transition"), ("true", "no transition")), _part(("stats", "stats"), ("true", "no stats")),
        _part(("peak IS NULL", "no peak"), ("peak > 0.2::DOUBLE", "over"), ("peak >= -0.2::DOUBLE", "hot"), ("peak <= -2", "headroom"), ("true", "some headroom")), _part(("dr IS NULL", "no range"), ("dr >= 14", "wide"), ("dr >= 10", "healthy"), ("dr >= 7", "moderate"), ("true", "heavy")),
        _part(("peak IS NULL AND dr IS NULL", "neither")), _part(("NOT brick AND band = 'cd-or-48k' AND cutoff >= 0.75::DOUBLE * top", "true cd")),
        _part(("brick", "wall"), ("hires AND top >= 90 AND cutoff >= 50", "deep"), ("hires AND top >= 44 AND cutoff >= 0.88::DOUBLE * top", "aligned"), ("band = 'cd-or-48k' AND top >= 90 AND cutoff >= 18", "cd in hires")),
        _part(("NOT brick AND hires AND span >= 30", "span")), _part(("NOT brick AND hires AND ratio BETWEEN 0.25::DOUBLE AND 1.4::DOUBLE", "ratio")),
    )
)
add(
    "score_parts",
    lambda spark, d: planning.score_breakdown(_figures(spark, d)).select("id", "raw_score", "score", "label", F.posexplode("parts").alias("at", "p")).select("id", "raw_score", "score", "label", "at", "p.*"),
    f"""WITH {_CARD}, p AS (SELECT *, list_filter([{_ALL_PARTS}], lambda x: x IS NOT NULL) AS parts FROM card), u AS (SELECT *, unnest(range(len(parts))) AS i, unnest(parts) AS x FROM p)
  SELECT id, CAST(CASE WHEN peak IS NULL AND dr IS NULL AND band = 'cd-or-48k' THEN least(raw, 69) WHEN peak IS NULL AND dr IS NULL AND hires THEN least(raw, 85) ELSE raw END AS INTEGER) AS raw_score, score, map {{'S': 'Reference', 'A': 'Excellent', 'B': 'Good', 'C': 'Fair', 'D': 'Limited', 'F': 'Poor'}}[class] AS label, CAST(i AS INTEGER) AS at, x.factor AS factor, x.points AS points, x.reason AS reason FROM u""",
)
add(
    "verdict",
    lambda spark, d: planning.verdict(_figures(spark, d)),
    f"""WITH {_CARD}, near AS (SELECT *, greatest(0, least(cutoff, top)) AS c FROM card), tier AS (
  SELECT *, abs(c - k) AS far, profile, row_number() OVER (PARTITION BY near.id ORDER BY abs(c - k), i) AS n FROM near, (VALUES {", ".join(f"({i}, {k}::DOUBLE, '{x}')" for i, (k, x) in enumerate(planning.TIERS))}) t(i, k, profile)
), pts AS (SELECT *, CASE WHEN NOT transition THEN 0 WHEN far <= 1.5 THEN 2 WHEN far <= 4 THEN 1 ELSE 0 END AS raw_points, transition AND c >= 0.88::DOUBLE * top AS aligned FROM tier WHERE n = 1
), q AS (SELECT *, greatest(raw_points - CASE WHEN NOT stats AND raw_points > 0 THEN 1 ELSE 0 END, CASE WHEN aligned OR promoted THEN 1 ELSE 0 END) AS points,
  CASE WHEN aligned THEN CASE WHEN top >= 90 THEN '192000/24' WHEN top >= 44 THEN '96000/24' WHEN top > 22.5 THEN '48000/24' ELSE '44100/16' END WHEN promoted THEN '96000/24' ELSE profile END AS likely,
  NOT brick AND top >= 90 AND cutoff <= 50 AND ratio <= 0.25::DOUBLE AS strong, NOT brick AND top >= 90 AND cutoff <= 45 AND ratio <= 0.7::DOUBLE AND span <= 20 AS middle FROM pts
), z AS (SELECT *, middle AND class IN ('S', 'A', 'B') AS down, CASE WHEN middle AND class IN ('S', 'A', 'B') THEN greatest(score - 12, 0) ELSE score END AS s2 FROM q)
  SELECT id, CASE WHEN brick AND top > 24.5 THEN 'lossy-upsampled' WHEN brick OR strong OR middle THEN 'lossy-compressed' ELSE likely END AS label, band, CAST(s2 AS INTEGER) AS score,
  CASE WHEN NOT down THEN class WHEN s2 >= 95 AND hires THEN 'S' WHEN s2 >= 86 THEN 'A' WHEN s2 >= 70 THEN 'B' WHEN s2 >= 54 THEN 'C' WHEN s2 >= 38 THEN 'D' ELSE 'F' END AS class,
  CASE points WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS profile_confidence FROM z""",
)
add(
    "fingerprint",
    lambda spark, d: tracks(spark, d).groupBy("album_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "position", "bitrate_bps", "cutoff_hz"))), ";"), 256).alias("fingerprint")),
    f"WITH {TRACKS_SQL} SELECT album_id, sha256(array_to_string(list_sort(list(CAST(position AS VARCHAR) || '|' || CAST(bitrate_bps AS VARCHAR) || '|' || CAST(cutoff_hz AS VARCHAR))), ';')) AS fingerprint FROM tracks GROUP BY album_id",
)
add(
    "token_signature",
    lambda spark, d: table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), "[^a-z0-9]+")), " ").alias("signature")),
    "SELECT p_partkey, array_to_string(list_sort(string_split_regex(lower(p_type || ' ' || p_name), '[^a-z0-9]+')), ' ') AS signature FROM part",
)
add(
    "props_json",
    lambda spark, d: table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n")),
    "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
)
add(
    "family_consistency",
    lambda spark, d: tracks(spark, d).withColumn("family", F.when(F.col("sr") % 48000 == 0, 48000).otherwise(44100)).withColumn("first", F.min_by("family", "position").over(planning.Window.partitionBy("album_id"))).where("family <> first").select("album_id", "position"),
    f"WITH {TRACKS_SQL}, f AS (SELECT album_id, position, CASE WHEN sr % 48000 = 0 THEN 48000 ELSE 44100 END AS family FROM tracks), g AS (SELECT *, first_value(family) OVER (PARTITION BY album_id ORDER BY position) AS first FROM f) SELECT album_id, position FROM g WHERE family <> first",
)
add(
    "track_dr_lookup",
    lambda spark, d: tracks(spark, d).join(albums(spark, d), F.col("album_id") == F.col("id")).select("album_id", "position", grade(F.col("dr"), F.lit("standard")).alias("grade"), F.contains(F.lower("genre_tag"), F.lit("rock")).alias("rock")),
    f"WITH {ALBUMS_SQL}, {TRACKS_SQL} SELECT album_id, position, {grade_sql('dr', _STANDARD)} AS grade, {any_part('lower(genre_tag)', ('rock',))} AS rock FROM tracks JOIN albums ON album_id = id",
)
add(
    "insights",
    lambda spark, d: planning.insights(_figures(spark, d)).select("id", F.size("insights").cast("long").alias("n"), F.concat_ws("|", "insights").alias("insights")),
    f"""WITH {_CARD}, n AS (SELECT id, [
    CASE WHEN cutoff < 18 THEN '{planning.LOW_PASS}' WHEN cutoff < 26 THEN '{planning.CEILING}' WHEN cutoff >= 44 THEN '{planning.WIDE_BAND}' END,
    CASE WHEN brick THEN replace(CASE WHEN top > 24.5 THEN '{planning.WALL_HIGH}' ELSE '{planning.WALL_LOW}' END, '%s', format('{{:.1f}}', cutoff)) WHEN band = 'cd-or-48k' AND cutoff >= 0.75::DOUBLE * top THEN '{planning.REDBOOK}' END,
    CASE WHEN peak IS NULL THEN '{planning.PEAK_NONE}' WHEN peak > 0.2::DOUBLE THEN '{planning.PEAK_OVER}' WHEN peak >= -0.2::DOUBLE THEN '{planning.PEAK_NEAR}' WHEN peak <= -2 THEN '{planning.PEAK_FREE}' END,
    CASE WHEN dr IS NULL THEN '{planning.RANGE_NONE}' WHEN dr >= 14 THEN '{planning.RANGE_WIDE}' WHEN dr >= 10 THEN '{planning.RANGE_GOOD}' WHEN dr >= 7 THEN '{planning.RANGE_SOME}' ELSE '{planning.RANGE_LOW}' END, CASE WHEN promoted THEN '{planning.TEXTURE}' END] AS remarks FROM card),
  m AS (SELECT id, list_filter(remarks, lambda r: r IS NOT NULL) AS kept FROM n)
  SELECT id, CAST(len(kept) AS BIGINT) AS n, array_to_string(kept, '|') AS insights FROM m""",
)
