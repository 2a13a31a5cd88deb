"""Queries of looks at tracks and images, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from needledrop.operators import strategy
from needledrop.operators.catalog_queries import Query
from needledrop.operators.signal_queries import _DECIDED, _DECISION_COLUMNS, _segments
from needledrop.sources.bind import TRACKS_SQL, _pick, choose, table, tracks

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _starts(spark, d):
    t = tracks(spark, d).withColumn("segment", strategy.segment_seconds(F.col("dr")))
    starts = strategy.segment_starts(F.when(F.col("position") % 5 != 0, F.col("seconds").cast("double")), F.col("segment"), F.when(F.col("album_id") % 2 == 0, "fast").otherwise("exact"))
    return t.select("album_id", "position", strategy.windows_for_mode(F.col("dr"), choose(("fast", "exact"), F.col("part_id"))).alias("windows"), F.posexplode(starts).alias("i", "start")).withColumn("start", F.round("start", 6))


add(
    "segment_starts",
    _starts,
    f"""WITH {TRACKS_SQL}, s AS (SELECT album_id, position, CASE WHEN part_id % 2 = 1 THEN greatest(dr * 2, 24) ELSE dr END AS windows, CASE WHEN position % 5 <> 0 THEN seconds::DOUBLE END AS dur, greatest(6.0::DOUBLE, least(12.0::DOUBLE, dr::DOUBLE)) AS seg, CASE WHEN album_id % 2 = 0 THEN 4 ELSE 6 END AS most FROM tracks),
    n AS (SELECT *, CASE WHEN dur IS NULL OR dur - seg <= 0 THEN 0 ELSE CAST(least(6, greatest(1, floor(dur / seg))) AS INTEGER) END AS k FROM s), x AS (SELECT *, CAST(unnest(range(greatest(k, 1))) AS INTEGER) AS i FROM n)
    SELECT album_id, position, windows, i, round(CASE WHEN k = 0 THEN 0.0::DOUBLE WHEN k = 1 THEN (dur - seg) * 0.5 ELSE (dur - seg) * (0.08::DOUBLE + 0.84::DOUBLE * (CAST(i AS DOUBLE) / (k - 1))) END, 6) AS start FROM x WHERE i < most""",
)


def _frames(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("x"))
    cut = strategy.frames_at(F.col("x"), (F.col("vec_id") % 9).cast("double"), 8, 2.0)
    both = F.transform(cut, lambda x: F.array(x, x * 3))
    return e.select("vec_id", *(F.aggregate(strategy.channel(both, m), F.lit(0.0), lambda a, x: a + x).alias(m) for m in ("mono", "left", "right")), F.coalesce(F.size(cut), F.lit(0)).alias("frames"))


add(
    "channel_frames",
    _frames,
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 4)) AS x FROM embeddings), c AS (SELECT vec_id, list_slice(x, least(vec_id % 9 * 8, len(x) - 16) + 1, least(vec_id % 9 * 8, len(x) - 16) + 16) AS f FROM e)
    SELECT vec_id, list_sum(list_transform(f, lambda y: (y + y * 3) / 2)) AS mono, list_sum(f) AS left, list_sum(list_transform(f, lambda y: y * 3)) AS right, CAST(len(f) AS INTEGER) AS frames FROM c""",
)
add(
    "window_summary",
    lambda spark, d: strategy.window_summary(tracks(spark, d).select(F.col("album_id").alias("track_id"), "cutoff_hz", (F.col("bitrate_bps") / 1000.0).alias("energy_ratio"), F.col("dr").alias("drop_db"), (F.col("part_id") % 4 == 0).alias("hf_present"), F.col("peak_tenths").alias("hf_peak_db"))),
    f"WITH {TRACKS_SQL} SELECT album_id AS track_id, median(cutoff_hz) AS cutoff_hz, median(bitrate_bps / 1000.0::DOUBLE) AS energy_ratio, median(dr) AS drop_db, count(*) FILTER (part_id % 4 = 0) AS hf_windows, bool_or(part_id % 4 = 0) AS hf_any, max(peak_tenths) AS hf_peak_db FROM tracks GROUP BY 1",
)
_VOTES = f"""{_DECIDED}, tt AS (SELECT album_id, position, cutoff_hz, sr, {_DECISION_COLUMNS} FROM decided), kk AS (SELECT album_id AS track_id, position AS segment, CASE WHEN cutoff_hz % 13 <> 0 AND album_id % 40 <> 7 THEN cutoff_hz END AS cutoff_hz, target_sr, sr, target_sr < sr AS fake, cutoff_hz % 11 = 0 AS hf, abs(cutoff_hz + 500 - target_sr / 2.0::DOUBLE) <= 1500 AS near, cutoff_hz % 30 >= 14 AS steep FROM tt)"""
add(
    "segment_outcome",
    lambda spark, d: strategy.outcome(_segments(spark, d)),
    f"""WITH {_VOTES}, cc AS (SELECT *, CASE WHEN cutoff_hz IS NULL THEN '?' WHEN NOT fake OR hf THEN 'full' WHEN near THEN '?' WHEN steep THEN 'cut' ELSE '?' END AS kind FROM kk),
    vv AS (SELECT track_id, target_sr, count(*) AS votes, min(segment) AS first FROM cc WHERE kind = 'cut' GROUP BY 1, 2), bb AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY votes DESC, first) AS r FROM vv),
    oo AS (SELECT track_id, max(target_sr) FILTER (r = 1) AS best, coalesce(max(votes) FILTER (r = 1), 0) AS votes, count(*) FILTER (r > 1) > 0 AS mixed, coalesce(max(votes) FILTER (r > 1), 0) >= 2 AS minor FROM bb GROUP BY 1),
    mm AS (SELECT track_id, median(cutoff_hz) AS middle, (max(cutoff_hz) - min(cutoff_hz)) / greatest(median(cutoff_hz), 1.0::DOUBLE) AS spread, count(*) AS n, count(cutoff_hz) AS m, max(sr) AS source, coalesce(bool_or(fake AND near) FILTER (cutoff_hz IS NOT NULL), false) AS ambiguous, bool_or(hf) AS hf, count(*) FILTER (kind = 'full') AS fb, count(*) FILTER (kind = 'cut') AS cl FROM cc GROUP BY 1),
    ss AS (SELECT mm.*, best, coalesce(votes, 0) AS votes, coalesce(mixed, false) AS mixed, coalesce(minor, false) AS minor, (SELECT avg(CASE WHEN abs(cutoff_hz - mm.middle) <= 2500 THEN 1.0::DOUBLE ELSE 0 END) FROM cc WHERE cc.track_id = mm.track_id AND cutoff_hz IS NOT NULL) AS share, greatest(2, ceil(greatest(n, fb + cl) * 0.6::DOUBLE)) AS req,
      CASE WHEN m < least(2, n) OR middle <= 0 THEN 'low' WHEN m >= 4 AND spread <= 0.12 THEN 'high' WHEN m >= 3 AND spread <= 0.25 THEN 'medium' ELSE 'low' END AS stat FROM mm LEFT JOIN oo USING (track_id)),
    ww AS (SELECT *, votes >= req AND NOT mixed AND NOT minor AND NOT ambiguous AND NOT hf AND fb = 0 AND share >= 0.6 AND (NOT coalesce(source / best >= 2.5, false) OR (votes = n AND share >= 0.75 AND stat <> 'low')) AS down FROM ss)
    SELECT track_id, CASE WHEN m = 0 THEN 'low' WHEN down THEN CASE WHEN votes >= greatest(3, req) AND share >= 0.75 AND stat <> 'low' THEN 'high' ELSE 'medium' END WHEN mixed OR (ambiguous AND NOT hf AND fb = 0) THEN 'low'
        WHEN fb >= req OR hf OR (votes = 0 AND share >= 0.6) OR (votes >= req AND fb > 0) THEN CASE WHEN fb >= greatest(3, req) AND share >= 0.6 THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence,
      CASE WHEN m = 0 THEN 'fallback_due_to_no_signal' WHEN down THEN CASE WHEN share >= 0.75 THEN 'accepted_by_consistency' ELSE 'accepted_by_majority_vote' END WHEN mixed THEN 'fallback_due_to_family_inconsistency' WHEN ambiguous AND NOT hf AND fb = 0 THEN 'fallback_due_to_boundary_ambiguity'
        WHEN fb >= req OR hf OR (votes = 0 AND share >= 0.6) OR (votes >= req AND fb > 0) THEN CASE WHEN share >= 0.6 OR hf THEN 'accepted_by_consistency' ELSE 'accepted_by_majority_vote' END ELSE 'fallback_due_to_disagreement' END AS reason, m > 0 AND down AS allow FROM ww""",
)
add(
    "earliest_sure",
    lambda spark, d: strategy.earliest_sure(tracks(spark, d).select(F.col("album_id").alias("track_id"), F.col("position").alias("segment"), (F.lit(20000) + F.col("cutoff_hz") % (F.col("album_id") % 7 * 900 + 10)).alias("cutoff_hz"))),
    f"""WITH {TRACKS_SQL}, s AS (SELECT album_id AS track_id, position AS n, 20000 + cutoff_hz % (album_id % 7 * 900 + 10) AS f FROM tracks),
    w AS (SELECT track_id, n, (max(f) OVER p - min(f) OVER p) / greatest(median(f) OVER p, 1.0::DOUBLE) AS spread FROM s WINDOW p AS (PARTITION BY track_id ORDER BY n ROWS UNBOUNDED PRECEDING))
    SELECT track_id, CAST(coalesce(min(n) FILTER (n >= 4 AND spread <= 0.12), max(n)) AS BIGINT) AS used FROM w GROUP BY 1""",
)
LEVELS = ("low", "medium", "high")


def _looks(spark, d):
    k = F.col("part_id")
    return tracks(spark, d).select(F.concat_ws("/", "album_id", "position").alias("track_id"), (k % 2 == 0).alias("segmented"), choose(LEVELS, k).alias("fast_confidence"), choose(LEVELS, F.col("supp_id")).alias("exact_confidence"), F.col("cutoff_hz").alias("fast_cutoff"), (F.col("cutoff_hz") + 1).alias("exact_cutoff"), F.when(k % 5 != 0, F.col("cutoff_hz") + 2).alias("full_cutoff"), (k % 3 == 0).alias("fast_allow"), (k % 7 > 2).alias("exact_allow"), (k % 4 > 1).alias("full_allow"))


add(
    "escalated",
    lambda spark, d: strategy.escalated(_looks(spark, d)),
    f"""WITH {TRACKS_SQL}, m AS (SELECT *, part_id AS k, CASE WHEN part_id % 3 <> 0 THEN 'fast' WHEN supp_id % 3 <> 0 OR part_id % 2 = 1 OR part_id % 5 = 0 THEN 'exact' ELSE 'full' END AS mode FROM tracks)
    SELECT album_id || '/' || position AS track_id, mode, cutoff_hz + CASE mode WHEN 'fast' THEN 0 WHEN 'exact' THEN 1 ELSE 2 END AS cutoff_hz, CASE mode WHEN 'fast' THEN k % 3 = 0 WHEN 'exact' THEN k % 7 > 2 ELSE k % 4 > 1 AND k % 7 > 2 END AS allow FROM m""",
)


def _image(spark, d):
    """Images of rows: the embeddings of a label in the order of their ids."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("image"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("row"), F.transform("embedding", lambda x: x.cast("double") * 40).alias("x"))
    return e.where("image is not null")


_IMAGE = "e AS (SELECT label AS image, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row, list_transform(embedding, lambda x: x::DOUBLE * 40) AS x FROM embeddings WHERE label IS NOT NULL)"
add(
    "row_energies",
    lambda spark, d: _image(spark, d).select("image", F.col("row").cast("long").alias("row"), F.round(strategy.row_energy(F.col("x")), 6).alias("contrast"), F.round(strategy.row_energy(F.col("x"), "intensity"), 6).alias("intensity")),
    f"WITH {_IMAGE} SELECT image, row, round(list_aggregate(x, 'stddev_pop'), 6) AS contrast, round(list_aggregate(x, 'quantile_cont', 0.75), 6) AS intensity FROM e",
)
