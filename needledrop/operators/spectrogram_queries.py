"""Queries of spectrogram images, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from needledrop.functions import ocr
from needledrop.operators import spectrogram
from needledrop.operators.catalog_queries import Query
from needledrop.operators.partitions import dealt
from needledrop.sources.bind import _pick, choose, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


TOPS = (22.05, 24.0, 48.0, 96.0, 22.05)


def _supplier_images(spark, d):
    """One image for each supplier, a row for each of its order lines: faint above a place that depends on the supplier, strong below."""
    image = Window.partitionBy("l_suppkey")
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    t = dealt(lines, "l_suppkey").withColumns({"row": F.row_number().over(image.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")) - 1, "n": F.count("*").over(image)})
    faint = F.when(F.col("row") * 10 < F.col("n") * (F.col("l_suppkey") % 11), F.lit(0.03)).otherwise(F.lit(1.0))
    values = F.array(*((((F.col("l_partkey") * (j + 3) + F.col("l_orderkey") * (j + 1)) % 97).cast("double")) * faint for j in range(8)))
    return t.select(F.col("l_suppkey").alias("image"), "row", values.alias("values"), choose(TOPS, F.col("l_suppkey")).alias("max_khz"))


def _six(x):
    """x to six decimals as SQL has it: what is rounded is a million times x, itself a rounded double."""
    return F.round(x * 1e6) / 1e6


def _signature(spark, d, by):
    s = spectrogram.signature(spectrogram.energies(_supplier_images(spark, d), by), by, 9.0)
    return s.select("image", "cutoff_row", "transition_found", "brickwall_hint", "brickwall_khz", *(_six(F.col(c)).alias(c) for c in ("detected_khz", "noise_floor", "threshold", "dynamic_span", "wall_strength", "high_band_ratio")))


def _supplier_rows_sql(energy):
    values = ", ".join(f"CAST((l_partkey * {j + 3} + l_orderkey * {j + 1}) % 97 AS DOUBLE) * faint" for j in range(2, 8))
    return f"""t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS row, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
    v AS (SELECT *, CASE WHEN row * 10 < n * (l_suppkey % 11) THEN 0.03::DOUBLE ELSE 1.0::DOUBLE END AS faint FROM t),
    e AS (SELECT l_suppkey AS image, row, n, CAST({_pick(TOPS, "l_suppkey")} AS DOUBLE) AS top, list_aggregate([{values}], {energy}) AS energy FROM v)"""


#: From rows e (image, row, n, top, energy) to a row g for each image.
def _signature_sql(rows, least):
    return f"""WITH {rows}, k AS (SELECT *, greatest(3, CAST(floor(n * 0.01::DOUBLE) AS BIGINT)) + (1 - greatest(3, CAST(floor(n * 0.01::DOUBLE) AS BIGINT)) % 2) AS k FROM e),
    s AS (SELECT *, sum(energy) OVER (PARTITION BY image ORDER BY row ROWS BETWEEN (k - 1) // 2 PRECEDING AND (k - 1) // 2 FOLLOWING) / k AS soft FROM k),
    f AS (SELECT image, median(soft) FILTER (row < greatest(5, n // 8)) AS floor, quantile_cont(soft, 0.9) AS p90 FROM s GROUP BY image),
    l AS (SELECT *, greatest(0, p90 - floor) AS span, greatest({least}, floor + greatest(2.0, greatest(0, p90 - floor) * 0.25)) AS threshold FROM f),
    a AS (SELECT s.*, floor, span, threshold, greatest(8, n // 18) AS sustain, greatest(5, CAST(floor(n * 0.08::DOUBLE) AS BIGINT)) AS start, lead(soft) OVER (PARTITION BY s.image ORDER BY row) - soft AS step FROM s JOIN l ON s.image = l.image),
    h AS (SELECT *, avg(soft) OVER (PARTITION BY image ORDER BY row ROWS BETWEEN CURRENT ROW AND sustain - 1 FOLLOWING) AS ahead FROM a),
    c AS (SELECT image, min(row) FILTER (ahead >= threshold AND row >= start AND row < greatest(start + 1, n - sustain)) AS first FROM h GROUP BY image),
    b AS (SELECT h.*, first, coalesce(first, n - 1) AS cut, CAST(trunc((1 - least(24.0, top) / top) * (n - 1)) AS BIGINT) AS r24, CAST(trunc((1 - least(20.0, top) / top) * (n - 1)) AS BIGINT) AS r20, CAST(trunc((1 - 8.0 / top) * (n - 1)) AS BIGINT) AS r8 FROM h JOIN c ON h.image = c.image),
    g AS (SELECT image, any_value(cut) AS cutoff_row, any_value(first) IS NOT NULL AS found, any_value(top) AS top, any_value(top * (1 - CAST(cut AS DOUBLE) / (n - 1))) AS khz, any_value(floor) AS floor, any_value(threshold) AS threshold, any_value(span) AS span,
      coalesce(max(step) FILTER (row BETWEEN cut - 4 AND cut + 9), 0) AS wall, avg(soft) FILTER (row < greatest(1, r24)) / greatest(0.000001, avg(soft) FILTER (row >= r20 AND row < greatest(r20 + 1, r8))) AS ratio FROM b GROUP BY image)"""


_ALL_FIELDS = """
    SELECT image, cutoff_row, found AS transition_found, found AND khz <= 24.5 AND (top > 24.5 OR khz <= top * 0.88::DOUBLE) AND wall >= greatest(2.0, span * 0.12::DOUBLE) AND ((top <= 24.5 AND ratio <= 0.78::DOUBLE) OR ratio <= 0.45::DOUBLE) AS brickwall_hint,
      round_even(khz, 2) AS brickwall_khz, round(khz, 6) AS detected_khz, round(floor, 6) AS noise_floor, round(threshold, 6) AS threshold, round(span, 6) AS dynamic_span, round(wall, 6) AS wall_strength, round(ratio, 6) AS high_band_ratio FROM g"""


add("image_signature", lambda spark, d: _signature(spark, d, "contrast"), _signature_sql(_supplier_rows_sql("'stddev_pop'"), "0") + _ALL_FIELDS)
add("image_signature_intensity", lambda spark, d: _signature(spark, d, "intensity"), _signature_sql(_supplier_rows_sql("'quantile_cont', 0.75"), "9.0") + _ALL_FIELDS)


def _label_images(spark, d):
    """Images of rows: the embeddings of a label in the order of their ids."""
    e = table(spark, d, "embeddings").where("label is not null").select(F.col("label").alias("image"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("row"), "embedding")
    return spectrogram.energies(e.select("image", "row", F.transform("embedding", lambda x: x.cast("double") * 40).alias("values"), F.lit(48.0).alias("max_khz")))


_LABEL_ROWS = """x AS (SELECT label AS image, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row, count(*) OVER (PARTITION BY label) AS n, list_transform(embedding, lambda v: v::DOUBLE * 40) AS v FROM embeddings WHERE label IS NOT NULL),
    e AS (SELECT image, row, n, 48.0::DOUBLE AS top, list_aggregate(v[17:], 'stddev_pop') AS energy FROM x)"""
add(
    "image_levels",
    lambda spark, d: spectrogram.signature(_label_images(spark, d)).select("image", *(F.round(c, 6).alias(n) for c, n in (("noise_floor", "noise_floor"), ("dynamic_span", "span"), ("threshold", "threshold")))),
    _signature_sql(_LABEL_ROWS, "0") + " SELECT image, round(floor, 6) AS noise_floor, round(span, 6) AS span, round(threshold, 6) AS threshold FROM g",
)
add(
    "wall_strength",
    lambda spark, d: spectrogram.signature(_label_images(spark, d)).select("image", "cutoff_row", F.round("wall_strength", 6).alias("wall")),
    _signature_sql(_LABEL_ROWS, "0") + " SELECT image, cutoff_row, round(wall, 6) AS wall FROM g",
)


def _grids(spark, d):
    """Images of brightness: the embeddings of a label in the order of their ids, with two bright rows in every twenty."""
    e = table(spark, d, "embeddings").where("label is not null").select(F.col("label").alias("image"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("row"), "embedding")
    return e.select("image", "row", F.transform("embedding", lambda x: F.when(F.col("row") % 20 < 2, F.lit(255.0)).otherwise(x.cast("double") * 300 + 70)).alias("values"))


add(
    "image_regions",
    lambda spark, d: spectrogram.regions(_grids(spark, d)),
    """WITH RECURSIVE e AS (SELECT label AS image, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row, embedding FROM embeddings WHERE label IS NOT NULL),
    z AS (SELECT image, max(len(embedding)) AS width, count(*) AS height FROM e GROUP BY image),
    p AS (SELECT image, row, unnest(range(len(embedding))) AS col, unnest(embedding) AS x FROM e WHERE row % 20 >= 2),
    i AS (SELECT image, row, col, col - row_number() OVER (PARTITION BY image, row ORDER BY col) AS island FROM p WHERE CAST(x AS DOUBLE) * 300 + 70 < 70),
    r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY image, row, min(col)) AS id, image, row, min(col) AS first, max(col) AS last FROM i GROUP BY image, row, island),
    l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.image = b.image AND a.row = b.row - 1 AND a.first <= b.last + 1 AND b.first <= a.last + 1),
    n AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    reach AS (SELECT id, id AS other FROM r UNION SELECT reach.id, n.b FROM reach JOIN n ON reach.other = n.a),
    c AS (SELECT id, min(other) AS label FROM reach GROUP BY id),
    x AS (SELECT image, label, min(first) AS x, min(row) AS y, max(last) - min(first) + 1 AS w, max(row) - min(row) + 1 AS h, CAST(sum(last - first + 1) AS BIGINT) AS area FROM r JOIN c ON r.id = c.id GROUP BY image, label)
    SELECT image, x, y, w, h, area, row_number() OVER (PARTITION BY image ORDER BY w * h DESC, y, x) AS rank FROM x JOIN z USING (image) WHERE w >= floor(width * 0.45::DOUBLE) AND h >= floor(height * 0.12::DOUBLE) AND area >= floor(width * height * 0.015::DOUBLE)""",
)


def _axis_labels(spark, d):
    """Labels of axes for customers: from one to nine steps down from some frequency, in Hz or kHz, some with a sample rate beside them."""
    k = F.col("c_custkey")
    step = choose((889, 1778, 2000, 5000, 500, 7000), k)
    hz = F.transform(F.sequence(F.lit(0), (k % 9).cast("int")), lambda i: (k * 37 % 90 * 1000 + 9000 - i * step + F.when(i % 4 == 3, k % 3 * 400).otherwise(0)))
    text = F.array_join(F.transform(F.filter(hz, lambda x: x > 0), lambda x: F.concat(x.cast("string"), F.lit(" Hz"))), " ")
    return table(spark, d, "customer").select(k.alias("image"), F.concat_ws(" ", text, choose(("", "192 kHz", "44.1k", "", "7kHz 500"), F.floor(k / 7))).alias("text"))


_REFS = "[" + ", ".join(f"{v}" for v in spectrogram.KNOWN) + "]::DOUBLE[]"
add(
    "image_axes",
    lambda spark, d: spectrogram.axes(spectrogram.label_values(_axis_labels(spark, d))),
    f"""WITH c AS (SELECT c_custkey AS k FROM customer), s AS (SELECT k, list_extract([889, 1778, 2000, 5000, 500, 7000], CAST(k % 6 + 1 AS BIGINT)) AS step, unnest(range(k % 9 + 1)) AS i FROM c),
    h AS (SELECT k, (k * 37 % 90 * 1000 + 9000 - i * step + CASE WHEN i % 4 = 3 THEN k % 3 * 400 ELSE 0 END) / 1000.0::DOUBLE AS khz FROM s
      UNION ALL SELECT k, unnest(list_extract([[], [192.0], [44.1], [], []]::DOUBLE[][], CAST(k // 7 % 5 + 1 AS BIGINT))) FROM c),
    v AS (SELECT k, khz FROM h WHERE khz BETWEEN 8 AND 384),
    u AS (SELECT DISTINCT k, round(khz, 3) AS khz FROM v WHERE khz <= 120),
    d AS (SELECT *, lag(khz) OVER (PARTITION BY k ORDER BY khz DESC) - khz AS gap FROM u),
    g AS (SELECT *, sum(CASE WHEN gap BETWEEN 0.8 AND 6.0 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY khz DESC) AS island FROM d),
    b AS (SELECT k, island, count(*) AS n, max(khz) AS top, median(gap) FILTER (gap BETWEEN 0.8 AND 6.0) AS step, coalesce(list(gap) FILTER (gap BETWEEN 0.8 AND 6.0), []) AS gaps FROM g GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, top DESC) = 1),
    ladder AS (SELECT k, top FROM b WHERE n >= 5 AND len(list_filter(gaps, lambda x: abs(x - step) <= greatest(0.6::DOUBLE, step * 0.35::DOUBLE))) >= greatest(3, (n - 1) // 2)),
    q AS (SELECT k, khz, (SELECT arg_min(ref, (abs(v.khz - ref), ref)) FROM (SELECT unnest({_REFS}) AS ref) WHERE abs(v.khz - ref) <= greatest(0.8::DOUBLE, ref * 0.08::DOUBLE)) AS ref FROM v),
    low AS (SELECT k, khz, khz - lag(khz) OVER (PARTITION BY k ORDER BY khz) AS gap FROM (SELECT DISTINCT k, khz FROM v WHERE khz <= 24)),
    ls AS (SELECT k, count(*) AS n, max(khz) AS top, median(gap) AS step FROM low GROUP BY k),
    qs AS (SELECT k, max(ref) AS high, max(ref) FILTER (ref < 160) AS mid FROM q GROUP BY k),
    z AS (SELECT qs.k, CASE WHEN ladder.top IS NOT NULL THEN ladder.top WHEN high >= 160 THEN high / 2 WHEN high IS NOT NULL AND n >= 4 THEN ls.top + greatest(1, least(step, 6)) WHEN mid >= 40 THEN mid / 2 ELSE high END AS guess FROM qs LEFT JOIN ls USING (k) LEFT JOIN ladder USING (k))
    SELECT k AS image, list_extract([22.05, 24.0, 48.0, 96.0]::DOUBLE[], list_position(list_transform([22.05, 24.0, 48.0, 96.0]::DOUBLE[], lambda t: abs(t - guess)), list_min(list_transform([22.05, 24.0, 48.0, 96.0]::DOUBLE[], lambda t: abs(t - guess))))) AS axis_khz FROM z WHERE guess IS NOT NULL""",
)
add(
    "image_frames",
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", spectrogram.is_full_frame(F.col("o_orderkey") % 70, F.col("o_orderkey") % 31, F.lit(1920) - F.col("o_custkey") % 150, F.lit(1080) - F.col("o_custkey") % 90, F.lit(1920), F.lit(1080)).alias("full")),
    "SELECT o_orderkey, o_orderkey % 70 <= 57 AND o_orderkey % 31 <= 54 AND o_orderkey % 70 + 1920 - o_custkey % 150 >= 1863 AND o_orderkey % 31 + 1080 - o_custkey % 90 >= 1026 AS full FROM orders",
)
SHAPES = ("Peak Amplitude: -{a}.{b} dB DR = {c}", "peak {a} dynamic range:{c}.{b}dB", "DynamicRange: {c}{b}0351938", "PEAK amplitude=+{a}.{b}", "nothing {a} here", "dynamic range lost: 9{c}99{b}1", "Speaker: {a}")


def _texts(spark, d):
    k = F.col("c_custkey")
    text = choose(SHAPES, k)
    for name, value in (("a", k % 23), ("b", k % 10), ("c", k % 70)):
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return table(spark, d, "customer").select("c_custkey", text.alias("text"))


add(
    "image_numbers",
    lambda spark, d: _texts(spark, d).select("c_custkey", ocr.labelled_number(F.col("text"), ocr.PEAK).alias("peak"), ocr.dynamic_range(F.col("text")).alias("range"), ocr.has_mastering_stats(F.col("text")).alias("stats")),
    f"""WITH t AS (SELECT c_custkey, replace(replace(replace({_pick(SHAPES, "c_custkey")}, '{{a}}', CAST(c_custkey % 23 AS VARCHAR)), '{{b}}', CAST(c_custkey % 10 AS VARCHAR)), '{{c}}', CAST(c_custkey % 70 AS VARCHAR)) AS x FROM customer),
    n AS (SELECT *, regexp_extract(x, '(?i)dynamic\\s*range[^0-9]*([0-9]{{5,}})', 1) AS digits, CAST(c_custkey % 7 AS INTEGER) AS shape, c_custkey % 23 + 0.0::DOUBLE AS a, c_custkey % 10 / 10.0::DOUBLE AS b, c_custkey % 70 + 0.0::DOUBLE AS c FROM t),
    m AS (SELECT *, TRY_CAST(left(digits, 2) || '.' || substr(digits, 3, 2) AS DOUBLE) AS two, TRY_CAST(left(digits, 3) || '.' || substr(digits, 4, 2) AS DOUBLE) AS three FROM n)
    SELECT c_custkey, CASE shape WHEN 0 THEN -(a + b) WHEN 1 THEN a WHEN 3 THEN a + b END AS peak,
      CASE WHEN shape = 0 THEN c WHEN shape = 1 THEN c + b WHEN digits = '' THEN NULL WHEN two BETWEEN 1 AND 60 THEN two WHEN len(digits) >= 5 AND three BETWEEN 1 AND 60 THEN three END AS range, shape NOT IN (4, 6) OR shape = 6 AS stats FROM m""",
)
