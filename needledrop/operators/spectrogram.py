"""Spectrogram images as tables: where sound ends in them, which panes they show and what their axes reach.

An image is rows (image, row from the top, values from left to right). One task holds one image's row energies, runs or
labels at most, never its pixels; nothing here needs Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needledrop.functions.media import axis_khz, khz_row, nearest_tier, row_khz
from needledrop.operators import strategy
from needledrop.streaming.queue import drop, folder

#: Columns that a row without sound has no part in: the left quarter of an image.
LEFT = 0.25


def energies(rows: DataFrame, by: str = "contrast") -> DataFrame:
    """image, row, energy of the rows' right three quarters; other columns of rows but values stay."""
    first = F.floor(F.size("values") * F.lit(LEFT)).cast("int")
    right = F.slice("values", first + 1, F.size("values") - first)
    return rows.withColumn("energy", strategy.row_energy(right, by)).drop("values")


def smooth_kernel(n: Column) -> Column:
    """How many rows a smoothed row is the mean of: 1 % of all, three at least, an odd number."""
    k = F.greatest(F.lit(3), F.floor(n * 0.01)).cast("int")
    return k + (k % 2 == 0).cast("int")


def between(low: Column, high: Column, part: Column) -> Column:
    """low * (1 - part) + high * part with one rounding after the first product, as SQL's quantile_cont has it.

    The first product is kept in two parts (Dekker), so that a value half way between two roundings falls as it does there.
    """
    halves = lambda x: (lambda c: (c - (c - x), x - (c - (c - x))))(x * F.lit(134217729.0))
    weight, other = F.lit(1.0) - part, high * part
    (a, b), (c, d) = halves(low), halves(weight)
    product = low * weight
    lost = ((a * c - product) + a * d + b * c) + b * d
    total = product + other
    back = total - product
    return total + (((product - (total - back)) + (other - back)) + lost)


def signature(rows: DataFrame, by: str = "contrast", brightness: float = 0.0) -> DataFrame:
    """One row for each image (image, row, energy, max_khz; rows numbered from 0 without gaps): what its rows' energies tell.

    cutoff_row, transition_found: the first row from which n/18 (eight at least) smoothed rows have a mean of the threshold
    or more, after the top 8 % (five at least); the last row where there is none. noise_floor: the median of the top eighth;
    dynamic_span: the 90th percentile above it; threshold: the floor and a quarter of the span (by intensity `brightness` at
    least). wall_strength: the steepest step around the cutoff. high_band_ratio: above 24 kHz against 8 to 20 kHz.
    brickwall_hint: a steep cutoff too low for the image's axis.

    Frames are as wide as each image asks for: rows are ordered by row / (reach + 1/2), so that rows within reach are those
    at a distance below 1. All frames are of one image: one shuffle of (image, row, energy). Null energies count as 0.
    """
    image = Window.partitionBy("image")
    n = F.col("_n")
    r = rows.select("image", F.col("row").cast("long").alias("row"), F.coalesce("energy", F.lit(0.0)).alias("energy"), F.col("max_khz").cast("double").alias("max_khz"))
    r = r.withColumn("_n", F.count("*").over(image)).withColumn("_k", smooth_kernel(n))
    near = image.orderBy(F.col("row") / (F.col("_k") / 2)).rangeBetween(-1, 1)  # an odd kernel reaches (k - 1) / 2 rows
    r = r.withColumn("_soft", F.sum("energy").over(near) / F.col("_k"))
    top = F.when(F.col("row") < F.greatest(F.lit(5), F.floor(n / 8)), F.col("_soft"))
    r = r.withColumns({"noise_floor": F.median(top).over(image), "_place": F.row_number().over(image.orderBy("_soft")) - 1, "_at": (n - 1) * F.lit(0.9)})
    ranked = lambda step: F.max(F.when(F.col("_place") == F.least(F.floor("_at") + step, n - 1), F.col("_soft"))).over(image)
    r = r.withColumns({"_low": ranked(0), "_high": ranked(1)})
    r = r.withColumns({"_p90": between(F.col("_low"), F.col("_high"), F.col("_at") - F.floor("_at")), "_step": F.lead("_soft").over(image.orderBy("row")) - F.col("_soft")}).drop("_low", "_high")
    span = F.greatest(F.lit(0.0), F.col("_p90") - F.col("noise_floor"))
    level = F.col("noise_floor") + F.greatest(F.lit(2.0), span * 0.25)
    r = r.withColumns({"dynamic_span": span, "threshold": F.greatest(level, F.lit(float(brightness))) if by == "intensity" else level, "_sustain": F.greatest(F.lit(8), F.floor(n / 18))})
    ahead = image.orderBy(F.col("row") / (F.col("_sustain") - 0.5)).rangeBetween(0, 1)
    start = F.greatest(F.lit(5), F.floor(n * 0.08))
    # A mean that equals the threshold mustn't fall by the last bits of its sum, which depend on the order of adding up.
    sound = (F.avg("_soft").over(ahead) >= F.col("threshold") * (1 - 1e-12)) & (F.col("row") >= start) & (F.col("row") < F.greatest(start + 1, n - F.col("_sustain")))
    r = r.withColumn("_sound", sound)
    r = r.withColumn("_first", F.min(F.when(F.col("_sound"), F.col("row"))).over(image)).withColumn("_cut", F.coalesce("_first", n - 1))
    row_24, row_20, row_8 = (khz_row(F.lit(f), n, F.col("max_khz")) for f in (24.0, 20.0, 8.0))
    low, high = F.least(row_20, row_8), F.greatest(row_20, row_8)
    within = lambda test, what: F.when(test, F.col(what))
    one = r.groupBy("image").agg(
        *(F.first(c).alias(c) for c in ("_n", "max_khz", "_cut", "noise_floor", "threshold", "dynamic_span")),
        F.bool_or("_sound").alias("transition_found"),
        F.coalesce(F.max(within((F.col("row") >= F.col("_cut") - 4) & (F.col("row") < F.col("_cut") + 10), "_step")), F.lit(0.0)).alias("wall_strength"),
        F.avg(within(F.col("row") < F.greatest(F.lit(1), row_24), "_soft")).alias("_high"),
        F.avg(within((F.col("row") >= low) & (F.col("row") < F.greatest(low + 1, high)), "_soft")).alias("_mid"),
    )
    one = one.withColumns({"detected_khz": row_khz(F.col("_cut"), n, F.col("max_khz")), "high_band_ratio": F.col("_high") / F.greatest(F.lit(1e-6), F.col("_mid"))})
    khz, most, ratio = F.col("detected_khz"), F.col("max_khz"), F.col("high_band_ratio")
    short = most <= 24.5
    steep = F.col("wall_strength") >= F.greatest(F.lit(2.0), F.col("dynamic_span") * 0.12)
    hint = F.col("transition_found") & (khz <= 24.5) & (~short | (khz <= most * 0.88)) & steep & ((short & (ratio <= 0.78)) | (ratio <= 0.45))
    return one.select("image", F.col("_cut").alias("cutoff_row"), "detected_khz", "transition_found", "noise_floor", "threshold", "dynamic_span", "wall_strength", "high_band_ratio", hint.alias("brickwall_hint"), F.bround("detected_khz", 2).alias("brickwall_khz"))


#: Columns of a row that share a bin when runs of neighbouring rows look for each other.
BIN = 64


def dark_runs(pixels: DataFrame, below: int = 70) -> DataFrame:
    """image, row, first, last of each run of neighbouring dark pixels of a row (values, brightness up to 255), width of the row."""
    dark = F.transform(F.coalesce("values", F.array().cast("array<double>")), lambda v: F.coalesce(v < below, F.lit(False)))
    rows = pixels.select("image", F.col("row").cast("long").alias("row"), dark.alias("d"), F.size("values").alias("width"))
    edge = lambda step: F.filter(  # noqa: E731  the places where a run begins (the one before isn't dark) or ends
        F.transform("d", lambda x, i: F.when(x & ~F.coalesce(F.get("d", i + step), F.lit(False)), i)), lambda p: p.isNotNull()
    )
    runs = F.arrays_zip(edge(-1).alias("first"), edge(1).alias("last"))
    return rows.select("image", "row", "width", F.explode(runs).alias("r")).select("image", "row", "width", F.col("r.first").alias("first"), F.col("r.last").alias("last"))


def touching(runs: DataFrame) -> DataFrame:
    """a, b: names of runs (name, image, row, first, last) of neighbouring rows that touch, at corners as well.

    Runs look for others in bins of BIN columns, so a row's runs are never all held against those of the next.
    """
    bins = F.explode(F.sequence(F.floor((F.col("first") - 1) / BIN), F.floor((F.col("last") + 1) / BIN)))
    one = runs.select("image", "row", "first", "last", F.col("name").alias("a"), bins.alias("bin"))
    two = runs.select("image", (F.col("row") - 1).alias("row"), F.col("first").alias("_first"), F.col("last").alias("_last"), F.col("name").alias("b"), bins.alias("bin"))
    pairs = one.join(two, ["image", "row", "bin"]).where("first <= _last + 1 and _first <= last + 1")
    return pairs.select("a", "b").distinct()


def labelled(names: DataFrame, links: DataFrame) -> DataFrame:
    """name, label: the smallest name that links (a, b) join to each of names (name).

    Every name hangs on the smallest one that it or a neighbour hangs on; then names follow what they hang on, so chains
    halve. Each round is a table in the shared folder, so no plan grows and a lost executor costs one round at most.
    """
    spark = names.sparkSession
    home = folder(spark, "labels")

    def kept(df: DataFrame, what: str) -> DataFrame:
        df.write.parquet(f"{home}/{what}")
        return spark.read.schema(df.schema).parquet(f"{home}/{what}")

    both = kept(links.select("a", "b").union(links.select("b", "a")), "links")
    now, turn = kept(names.select("name", F.col("name").alias("label")), "start"), 0
    while True:
        # A group (what hangs on one label) takes the smallest label that a neighbour of any of its names has.
        seen = both.join(now.select(F.col("name").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        offers = now.join(seen, F.col("name") == F.col("a")).groupBy("label").agg(F.min("other").alias("to")).where("to < label")
        hung = now.join(offers.withColumnRenamed("label", "_from"), F.col("label") == F.col("_from"), "left").select("name", F.coalesce("to", "label").alias("label"))
        jump = hung.select(F.col("name").alias("_name"), F.col("label").alias("_label"))
        after = hung.join(jump, F.col("label") == F.col("_name")).select("name", F.col("_label").alias("label"))
        now, before, turn = kept(after, f"round-{turn}"), now, turn + 1
        same = not now.join(before.withColumnRenamed("label", "_old"), "name").where("label <> _old").limit(1).count()
        drop(spark, f"{home}/round-{turn - 2}" if turn > 1 else f"{home}/start")
        if same:
            drop(spark, f"{home}/links")
            return now


def regions(pixels: DataFrame, below: int = 70) -> DataFrame:
    """image, x, y, w, h, area of the dark panes of images (image, row, values), with their rank: largest boxes first, then the upper, then the left.

    A pane is a set of dark pixels that touch, at corners as well, with a box of at least 45 % of the width and 12 % of
    the height and an area of at least 1.5 % of the image. Runs of a row are joined to those of the next; what they link
    is labelled over all images at once.
    """
    sized = pixels.groupBy("image").agg(F.max(F.size("values")).alias("width"), F.count("*").alias("height"))
    name = F.concat_ws("/", F.col("image").cast("string"), F.lpad(F.col("row").cast("string"), 9, "0"), F.lpad(F.col("first").cast("string"), 9, "0"))
    runs = dark_runs(pixels, below).drop("width").withColumn("name", name)
    labels = labelled(runs.select("name"), touching(runs))
    boxes = runs.join(labels, "name").groupBy("image", "label").agg(
        F.min("first").alias("x"), F.min("row").alias("y"), (F.max("last") - F.min("first") + 1).alias("w"), (F.max("row") - F.min("row") + 1).alias("h"), F.sum(F.col("last") - F.col("first") + 1).alias("area")
    )
    whole = lambda x: F.floor(x).cast("long")
    large = boxes.join(sized, "image").where((F.col("w") >= whole(F.col("width") * 0.45)) & (F.col("h") >= whole(F.col("height") * 0.12)) & (F.col("area") >= whole(F.col("width") * F.col("height") * 0.015)))
    order = Window.partitionBy("image").orderBy((F.col("w") * F.col("h")).desc(), "y", "x")
    return large.select("image", "x", "y", "w", "h", "area", F.row_number().over(order).alias("rank"))


def is_full_frame(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Whether a box leaves at most 3 % of the width and 5 % of the height (two pixels at least) free on each side."""
    side, above = F.greatest(F.lit(2), F.floor(width * 0.03)), F.greatest(F.lit(2), F.floor(height * 0.05))
    return (x <= side) & (y <= above) & (x + w >= width - side) & (y + h >= height - above)


#: Frequencies in kHz that labels of axes and sample rates show.
KNOWN = (10.0, 12.0, 14.0, 16.0, 18.0, 20.0, 22.05, 24.0, 30.0, 40.0, 44.1, 48.0, 50.0, 60.0, 88.2, 96.0, 176.4, 192.0, 352.8, 384.0)


def known_label(khz: Column) -> Column:
    """The known frequency that is nearest, of those within 8 % (0.8 kHz at least); null if there is none."""
    near = F.filter(F.array(*(F.struct(F.abs(khz - ref).alias("away"), F.lit(ref).alias("ref"), F.lit(max(0.8, ref * 0.08)).alias("reach")) for ref in KNOWN)), lambda s: s["away"] <= s["reach"])
    return F.get(F.array_sort(near), F.lit(0))["ref"]


def label_values(labels: DataFrame) -> DataFrame:
    """image, khz: every frequency that the labels (image, text) of an image name."""
    return labels.select("image", F.explode(axis_khz(F.col("text"))).alias("khz"))


def ladders(values: DataFrame) -> DataFrame:
    """image, top of the images whose frequencies hold a ladder: at least five of 8 to 120 kHz in steps of 0.8 to 6 kHz.

    The longest such run counts (the higher of two), if enough of its steps are near their median: at least three, and half
    of them, within 35 % (0.6 kHz at least). Runs by gaps and islands.
    """
    down = Window.partitionBy("image").orderBy(F.col("v").desc())
    r = values.where("khz between 8 and 120").select("image", F.round("khz", 3).alias("v")).distinct().withColumn("step", F.lag("v").over(down) - F.col("v"))
    r = r.withColumn("breaks", F.when(F.col("step").between(0.8, 6.0), 0).otherwise(1)).withColumn("island", F.sum("breaks").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    inner = F.when(F.col("breaks") == 0, F.col("step"))
    runs = r.groupBy("image", "island").agg(F.count("*").alias("n"), F.max("v").alias("top"), F.median(inner).alias("step"), F.collect_list(inner).alias("steps"))
    best = runs.groupBy("image").agg(F.max_by(F.struct("n", "top", "step", "steps"), F.struct("n", "top")).alias("b")).select("image", "b.*").where("n >= 5")
    stable = F.size(F.filter("steps", lambda s: F.abs(s - F.col("step")) <= F.greatest(F.lit(0.6), F.col("step") * 0.35)))
    return best.where(stable >= F.greatest(F.lit(3), F.floor((F.col("n") - 1) / 2))).select("image", "top")


def axes(values: DataFrame) -> DataFrame:
    """image, axis_khz: the tier of the highest frequency of an image's axis, from the frequencies that it names (image, khz).

    A ladder tells its top. Else only images with some known frequency have an answer: half of the highest label from
    160 kHz on (a sample rate); else one step above at least four different labels of 8 to 24 kHz; else half of the highest
    from 40 to 160 kHz; else the highest. Images without an answer aren't in the result.
    """
    r = values.withColumn("ref", known_label(F.col("khz")))
    low = F.when(F.col("khz").between(8.0, 24.0), F.col("khz"))
    up = Window.partitionBy("image").orderBy("khz")
    sums = r.groupBy("image").agg(F.max("ref").alias("high"), F.max(F.when(F.col("ref") < 160, F.col("ref"))).alias("mid"), F.count_distinct(low).alias("n"), F.max(low).alias("low"))
    steps = r.where("khz between 8 and 24").select("image", "khz").distinct().withColumn("step", F.col("khz") - F.lag("khz").over(up)).groupBy("image").agg(F.median("step").alias("step"))
    r = sums.join(steps, "image", "left").join(ladders(values), "image", "left")
    guess = (
        F.when(F.col("top").isNotNull(), F.col("top"))
        .when(F.col("high") >= 160, F.col("high") / 2)
        .when(F.col("high").isNotNull() & (F.col("n") >= 4), F.col("low") + F.greatest(F.lit(1.0), F.least(F.col("step"), F.lit(6.0))))
        .when(F.col("mid") >= 40, F.col("mid") / 2)
        .otherwise(F.col("high"))
    )
    return r.select("image", guess.alias("g")).where("g is not null").select("image", nearest_tier(F.col("g")).alias("axis_khz"))
