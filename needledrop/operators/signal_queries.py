"""Decision and signal queries over the bound tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.functions import decision, text
from needledrop.operators import signal
from needledrop.operators.catalog_queries import Query, canonical_sql
from needledrop.sources.bind import ALBUMS_SQL, TRACKS_SQL, albums, choose, table, tracks

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _measured(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("album_id") + F.col("position")
    return tracks(spark, d).withColumns({"confidence": choose(("high", "low", "medium"), k), "reason": choose(("", "fallback_due_to_disagreement", "x", "fallback_due_to_boundary_ambiguity"), k)})


_MEASURED = f"""{TRACKS_SQL}, measured AS (SELECT *, list_extract(['high', 'low', 'medium'], CAST((album_id + position) % 3 + 1 AS BIGINT)) AS confidence,
  list_extract(['', 'fallback_due_to_disagreement', 'x', 'fallback_due_to_boundary_ambiguity'], CAST((album_id + position) % 4 + 1 AS BIGINT)) AS reason FROM tracks)"""
_DECIDED = f"""{_MEASURED}, a AS (
  SELECT *, CAST(greatest(cutoff_hz + 500, 0) AS DOUBLE) AS eff, CASE WHEN sr % 48000 = 0 THEN 48000 WHEN sr % 44100 = 0 THEN 44100 END AS own FROM measured
), b AS (
  SELECT *, CASE WHEN own = 48000 AND eff BETWEEN 21120 AND 24000 THEN 48000 WHEN eff <= 22050 THEN 44100 WHEN eff <= 24000 THEN 48000 ELSE own END AS std, CASE own WHEN 48000 THEN 192000 WHEN 44100 THEN 176400 END AS top FROM a
), c AS (
  SELECT *, CASE WHEN std = 44100 AND eff <= 22050 THEN 44100 WHEN std = 44100 AND eff <= 44100 THEN 88200 WHEN std = 44100 AND eff <= 88200 THEN 176400
    WHEN std = 48000 AND eff <= 24000 THEN 48000 WHEN std = 48000 AND eff <= 48000 THEN 96000 WHEN std = 48000 AND eff <= 96000 THEN 192000 END AS step FROM b
), e AS (
  SELECT *, coalesce(sr > step, false) AS fake, confidence = 'low' AND reason IN ('fallback_due_to_disagreement', 'fallback_due_to_family_inconsistency', 'fallback_due_to_boundary_ambiguity') AS unsure,
    coalesce(own = std AND step < sr AND sr <= top AND eff / (step / 2) < 0.72::DOUBLE, false) AS middle FROM c
), f AS (
  SELECT *, fake AND NOT unsure AND NOT middle AS lower, fake AND (unsure OR middle) AS guarded FROM e
), decided AS (
  SELECT *, CASE WHEN lower THEN step ELSE sr END AS target FROM f
)"""
_DECISION_COLUMNS = """CAST(CASE WHEN guarded THEN own ELSE std END AS INTEGER) AS standard_family, lower AS fake_upscale,
  CAST(CASE WHEN target > top THEN top ELSE target END AS INTEGER) AS target_sr,
  CASE WHEN lower THEN 'downgrade_fake_upscale' WHEN target > top THEN 'cap_highres_ceiling' ELSE 'keep_source' END AS decision, guarded"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    rows = _measured(spark, d)
    made = decision.decided(rows, F.col("cutoff_hz"), F.col("sr"), F.col("confidence"), F.col("reason"), F.lit(True))
    return made.select("album_id", "position", "sr", "bits", "cutoff_hz", "confidence", "standard_family", "fake_upscale", "target_sr", "decision", "guarded")


add("recode_decision", lambda spark, d: _decided(spark, d).drop("bits", "confidence"), f"WITH {_DECIDED} SELECT album_id, position, sr, cutoff_hz, {_DECISION_COLUMNS} FROM decided")


def _rollup(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    rows = _decided(spark, d).groupBy("album_id").agg(
        F.max("target_sr").alias("target_sr"), F.min(rank).alias("confidence_rank"), F.bool_or("fake_upscale").alias("any_fake"),
        F.bool_or(F.col("decision") == "downgrade_fake_upscale").alias("down"), F.bool_or(F.col("decision") == "cap_highres_ceiling").alias("cap"),
        F.least(F.lit(24), F.greatest(F.lit(16), F.max("bits"))).alias("bits"), F.array_join(F.array_sort(F.collect_set("decision")), ",").alias("decisions"),
        F.when(F.count_distinct("standard_family") == 1, F.max("standard_family")).alias("family"),
    )
    return rows.withColumn("decision", F.when(F.col("down"), "downgrade_fake_upscale").when(F.col("cap"), "cap_highres_ceiling").otherwise("keep_source")).drop("down", "cap")


add(
    "album_rollup",
    _rollup,
    f"""WITH {_DECIDED}, t AS (SELECT album_id, bits, confidence, {_DECISION_COLUMNS} FROM decided) SELECT album_id, max(target_sr) AS target_sr,
  min(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS confidence_rank, bool_or(fake_upscale) AS any_fake, least(24, greatest(16, max(bits))) AS bits,
  array_to_string(list_sort(list_distinct(list(decision))), ',') AS decisions, CASE WHEN count(DISTINCT standard_family) = 1 THEN max(standard_family) END AS family,
  CASE WHEN bool_or(decision = 'downgrade_fake_upscale') THEN 'downgrade_fake_upscale' WHEN bool_or(decision = 'cap_highres_ceiling') THEN 'cap_highres_ceiling' ELSE 'keep_source' END AS decision
  FROM t GROUP BY album_id""",
)


def _advice(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    target = choose(("44100/16", "48000/24", "96000/24", "bad", "88200/32f"), k)
    prior = choose(("", "192000/24", "44100/16"), k)
    # The profiles are columns of their own first: worked out once, not once for each use.
    rows = albums(spark, d).select("id", text.canonical_profile(F.col("current_quality")).alias("source"), target.alias("target"), prior.alias("prior"))
    return rows.select("id", decision.recode_advice(F.col("source"), F.col("target"), k % 29 == 0, F.col("prior")).alias("a")).select("id", "a.text", "a.flag")


add(
    "recode_fields",
    _advice,
    f"""WITH {ALBUMS_SQL}, p AS (SELECT id, {canonical_sql('current_quality')} AS source, list_extract(['44100/16', '48000/24', '96000/24', 'bad', '88200/32f'], CAST(id % 5 + 1 AS BIGINT)) AS target,
  list_extract(['', '192000/24', '44100/16'], CAST(id % 3 + 1 AS BIGINT)) AS prior FROM albums), n AS (SELECT *, TRY_CAST(split_part(source, '/', 1) AS INTEGER) AS sr, TRY_CAST(split_part(target, '/', 1) AS INTEGER) AS tr,
  TRY_CAST(split_part(prior, '/', 1) AS INTEGER) AS pr, split_part(source, '/', 2) IN ('32f', '64f') AS sf,
  CASE WHEN split_part(source, '/', 2) IN ('32f', '64f') THEN 24 ELSE TRY_CAST(split_part(source, '/', 2) AS INTEGER) END AS sb,
  CASE WHEN split_part(target, '/', 2) IN ('32f', '64f') THEN 24 ELSE TRY_CAST(split_part(target, '/', 2) AS INTEGER) END AS tb FROM p),
  y AS (SELECT *, CASE WHEN tr IS NULL OR tb IS NULL THEN false WHEN id % 29 = 0 THEN true WHEN sr IS NULL OR sb IS NULL THEN false WHEN coalesce(pr > sr AND tr < sr, false) THEN false
  ELSE tr < sr OR (tr = sr AND NOT sf AND tb < sb) END AS yes FROM n) SELECT id, CASE WHEN yes THEN 'Recode to ' || target ELSE 'Keep as-is' END AS text, CAST(yes AS INTEGER) AS flag FROM y""",
)
for _name, _segment in (("confidence", False), ("confidence_segment", True)):
    _steps = "WHEN n >= 4 AND spread <= 0.12::DOUBLE THEN 'high' WHEN n >= 3 AND spread <= 0.25::DOUBLE THEN 'medium'" if _segment else "WHEN n >= 8 AND spread <= 0.12::DOUBLE THEN 'high' WHEN n >= 5 AND spread <= 0.25::DOUBLE THEN 'medium'"
    add(
        _name,
        lambda spark, d, s=_segment: tracks(spark, d)
        .groupBy("album_id")
        .agg(F.count("*").alias("n"), F.min("cutoff_hz").alias("low"), F.max("cutoff_hz").alias("high"), F.median("cutoff_hz").alias("m"))
        .select("album_id", decision.confidence(F.col("n"), F.col("low"), F.col("high"), F.col("m"), 12, s).alias("confidence")),
        f"""WITH {TRACKS_SQL}, s AS (SELECT album_id, count(*) AS n, median(cutoff_hz) AS m, (max(cutoff_hz) - min(cutoff_hz)) / greatest(median(cutoff_hz), 1.0::DOUBLE) AS spread FROM tracks GROUP BY album_id)
  SELECT album_id, CASE WHEN n < {2 if _segment else 3} OR m <= 0 THEN 'low' {_steps} ELSE 'low' END AS confidence FROM s""",
    )


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))


_SPECTRA = f"""raw AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings), w AS (
  SELECT id, list_transform(range(1, 65), lambda i: (s[i] - list_sum(s) / 64) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (i - 1) / 63))) AS w FROM raw
), m AS (
  SELECT id, list_transform(range(33), lambda k: sqrt(pow(list_sum(list_transform(range(64), lambda i: w[i + 1] * cos(2 * pi() * ((k * i) % 64) / 64))), 2) + pow(list_sum(list_transform(range(64), lambda i: w[i + 1] * sin(2 * pi() * ((k * i) % 64) / 64))), 2))) AS mag FROM w
), p AS (SELECT *, list_transform(mag, lambda x: 20 * log10(greatest(x / greatest(list_max(mag), 1e-12::DOUBLE), 1e-12::DOUBLE))) AS db FROM m
), q AS (SELECT *, coalesce(list_max(list_filter(range(33), lambda k: db[k + 1] >= -55)), 0) AS cutoff_bin FROM p)"""
add("dft_cutoff", lambda spark, d: signal.spectra(_windows(spark, d)).select("id", F.col("cutoff_bin").cast("long").alias("cutoff_bin"), "cutoff_hz"), f"WITH {_SPECTRA} SELECT id, cutoff_bin, cutoff_bin * 1500.0::DOUBLE AS cutoff_hz FROM q")
add(
    "guard_band",
    lambda spark, d: signal.spectra(_windows(spark, d), guard=signal.guard_hz(choose((96000, 88200, 50000, 44100), F.col("id")))).select("id", F.round("guard_ratio", 6).alias("guard_ratio"), "hf_present"),
    f"""WITH {_SPECTRA}, f AS (SELECT id, CASE id % 4 WHEN 0 THEN 17 WHEN 2 THEN NULL ELSE 16 END AS a, mag, db FROM q), g AS (SELECT id, a, db[a:33] AS db, list_sum(list_transform(mag[a:33], lambda x: x * x)) / list_sum(list_transform(mag, lambda x: x * x)) AS r FROM f)
  SELECT id, CASE WHEN a IS NOT NULL THEN round(r, 6) END AS guard_ratio, a IS NOT NULL AND (list_max(db) >= -78 OR len(list_filter(db, lambda x: x >= -78)) / CAST(34 - a AS DOUBLE) >= 0.002::DOUBLE OR r >= 1e-4::DOUBLE) AS hf_present FROM g""",
)
add(
    "shape_drop",
    lambda spark, d: signal.spectra(_windows(spark, d), threshold=-10.0).select("id", F.round("drop_db", 6).alias("drop_db")),
    f"""WITH {_SPECTRA.replace('>= -55', '>= -10')}, h AS (SELECT id, db, cutoff_bin * 1500.0::DOUBLE AS f FROM q), n AS (SELECT id, f,
  list_transform(list_filter(range(33), lambda k: k * 1500 >= greatest(f - 2000, 0) AND k * 1500 < greatest(f - 500, 0)), lambda k: db[k + 1]) AS lo,
  list_transform(list_filter(range(33), lambda k: k * 1500 >= least(f + 500, 48000) AND k * 1500 < least(f + 2500, 48000)), lambda k: db[k + 1]) AS hi FROM h)
  SELECT id, round(CASE WHEN f > 3000 AND len(lo) > 0 AND len(hi) > 0 THEN list_avg(lo) - list_avg(hi) END, 6) AS drop_db FROM n""",
)
add("fft_cutoff", lambda spark, d: signal.fft_cutoffs(_windows(spark, d)).select("id", F.col("cutoff_bin").cast("long").alias("cutoff_bin")), f"WITH {_SPECTRA} SELECT id, cutoff_bin FROM q")
add(
    "window_starts",
    lambda spark, d: tracks(spark, d).select("album_id", "position", F.posexplode(signal.window_starts(F.col("seconds").cast("double"))).alias("i", "start")).select("album_id", "position", "i", F.round("start", 6).alias("start")),
    f"""WITH {TRACKS_SQL}, n AS (SELECT *, CAST(least(12, greatest(1, floor(seconds / 8.0::DOUBLE))) AS INTEGER) AS k FROM tracks), x AS (SELECT album_id, position, seconds, k, CAST(unnest(range(k)) AS INTEGER) AS i FROM n)
  SELECT album_id, position, i, round(CASE WHEN k = 1 THEN greatest(seconds - 8.0::DOUBLE, 0) * 0.5 ELSE least(greatest((seconds - 8.0::DOUBLE) * (0.1::DOUBLE + 0.8::DOUBLE * (CAST(i AS DOUBLE) / (k - 1))), 0), greatest(seconds - 8.0::DOUBLE, 0)) END, 6) AS start FROM x""",
)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Tracks as segments of their album; some have no cutoff."""
    rows = _decided(spark, d)
    return rows.select(
        F.col("album_id").alias("track_id"), F.col("position").alias("segment"), F.when((F.col("cutoff_hz") % 13 != 0) & (F.col("album_id") % 40 != 7), F.col("cutoff_hz")).alias("cutoff_hz"), F.col("sr").alias("source_sr"), "target_sr",
        (F.col("cutoff_hz") % 11 == 0).alias("hf_present"), (F.col("cutoff_hz") % 30).cast("double").alias("drop_db"), F.abs(F.col("cutoff_hz") + 500 - F.col("target_sr") / 2).alias("distance_hz"),
    )


add(
    "segment_kinds",
    lambda spark, d: signal.classified(_segments(spark, d)).groupBy("track_id", "kind", "reason").agg(F.count("*").alias("n")),
    f"""WITH {_DECIDED}, t AS (SELECT album_id, cutoff_hz, sr, {_DECISION_COLUMNS} FROM decided), k AS (SELECT album_id AS track_id, CASE WHEN cutoff_hz % 13 = 0 OR album_id % 40 = 7 THEN 'no_cutoff' WHEN target_sr >= sr THEN 'full_band_signal' WHEN cutoff_hz % 11 = 0 THEN 'hf_presence_guard'
  WHEN abs(cutoff_hz + 500 - target_sr / 2.0::DOUBLE) <= 1500 THEN 'boundary_ambiguity' WHEN cutoff_hz % 30 >= 14 THEN 'brickwall_cutoff' ELSE 'gradual_rolloff' END AS reason FROM t)
  SELECT track_id, CASE WHEN reason IN ('full_band_signal', 'hf_presence_guard') THEN 'full-band' WHEN reason = 'brickwall_cutoff' THEN 'cutoff-limited' ELSE 'uncertain' END AS kind, reason, count(*) AS n FROM k GROUP BY ALL""",
)
add(
    "segment_votes",
    lambda spark, d: signal.vote(_segments(spark, d)).withColumn("share_near", F.round("share_near", 9)),
    f"""WITH {_DECIDED}, t AS (SELECT album_id, position, cutoff_hz, sr, {_DECISION_COLUMNS} FROM decided), k AS (SELECT album_id AS track_id, position AS segment, CASE WHEN cutoff_hz % 13 <> 0 AND album_id % 40 <> 7 THEN cutoff_hz END AS cutoff_hz, target_sr,
  CASE WHEN cutoff_hz % 13 = 0 OR album_id % 40 = 7 THEN 'uncertain' WHEN target_sr >= sr THEN 'full-band' WHEN cutoff_hz % 11 = 0 THEN 'full-band' WHEN abs(cutoff_hz + 500 - target_sr / 2.0::DOUBLE) <= 1500 THEN 'uncertain' WHEN cutoff_hz % 30 >= 14 THEN 'cutoff-limited' ELSE 'uncertain' END AS kind, target_sr < sr AS fake FROM t),
  v AS (SELECT track_id, target_sr, count(*) AS votes, min(segment) AS first FROM k WHERE kind = 'cutoff-limited' AND fake GROUP BY 1, 2), best AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY votes DESC, first) AS r FROM v),
  m AS (SELECT track_id, median(cutoff_hz) AS middle FROM k GROUP BY 1), s AS (SELECT k.track_id, count(*) AS n, count(*) FILTER (kind = 'full-band') AS full_band, count(*) FILTER (kind = 'cutoff-limited') AS cutoff_limited,
  round(coalesce(avg(CASE WHEN abs(cutoff_hz - middle) <= 2500 THEN 1.0::DOUBLE ELSE 0 END) FILTER (cutoff_hz IS NOT NULL), 0), 9) AS share_near FROM k JOIN m USING (track_id) GROUP BY 1)
  SELECT s.track_id, full_band, cutoff_limited, CAST(greatest(2, ceil(greatest(n, full_band + cutoff_limited) * 0.6::DOUBLE)) AS INTEGER) AS required, share_near, best.target_sr AS majority_target, best.votes FROM s LEFT JOIN best ON s.track_id = best.track_id AND best.r = 1""",
)


def _channels(spark: SparkSession, d: str) -> DataFrame:
    """Three channels of each track, some of them without a cutoff."""
    levels, k = ("high", "low", "medium"), F.col("album_id") + F.col("position")
    one = lambda name, i: F.struct(
        F.lit(name).alias("channel"), F.when((k + i) % 4 != 0, choose(levels, k + i)).alias("decision_confidence"), choose(levels, k * 2 + i).alias("confidence"),
        (F.col("seconds") % (7 + i)).alias("windows_used"), F.when(~((k + i) % 5).isin(0, 1, 2), F.col("cutoff_hz") - i * (k % 3)).alias("cutoff_hz"),
    )
    return tracks(spark, d).select(F.concat_ws("/", "album_id", "position").alias("track_id"), F.explode(F.array(one("mono", 0), one("left", 1), one("right", 2))).alias("c")).select("track_id", "c.*")


add(
    "strongest_channel",
    lambda spark, d: signal.strongest_channel(_channels(spark, d)),
    f"""WITH {TRACKS_SQL}, c AS (SELECT album_id || '/' || position AS track_id, album_id + position AS k, cutoff_hz AS f, seconds, unnest([0, 1, 2]) AS i FROM tracks),
  r AS (SELECT track_id, i, list_extract(['mono', 'left', 'right'], i + 1) AS channel, CASE WHEN (k + i) % 4 <> 0 THEN list_extract(['high', 'low', 'medium'], (k + i) % 3 + 1) END AS decision_confidence,
    list_extract(['high', 'low', 'medium'], (k * 2 + i) % 3 + 1) AS confidence, seconds % (7 + i) AS windows_used, CASE WHEN (k + i) % 5 NOT IN (0, 1, 2) THEN f - i * (k % 3) END AS cutoff_hz FROM c),
  o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY cutoff_hz IS NULL, CASE WHEN cutoff_hz IS NOT NULL THEN list_position(['low', 'medium', 'high'], coalesce(decision_confidence, confidence)) END DESC NULLS LAST,
    CASE WHEN cutoff_hz IS NOT NULL THEN list_position(['low', 'medium', 'high'], confidence) END DESC NULLS LAST, CASE WHEN cutoff_hz IS NOT NULL THEN windows_used END DESC NULLS LAST, cutoff_hz DESC NULLS LAST, i) AS n FROM r)
  SELECT track_id, channel, decision_confidence, confidence, windows_used, cutoff_hz FROM o WHERE n = 1""",
)
