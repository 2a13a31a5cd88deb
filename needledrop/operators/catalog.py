"""Catalog views: filters, sorts, pages, search, copies, inventories and statistics over a table of albums.

albums has the columns of sources.bind.albums. Every function takes and returns DataFrames; none of them collects rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needledrop.functions import grading, text

UNKNOWN = "~unknown"
CLASSES = {"s-b": ("S", "A", "B"), "c-f": ("C", "F")}


def graded(albums: DataFrame) -> DataFrame:
    """albums with genre_profile, quality_grade, grade_rank, codec_norm and profile_norm: derived, never stored."""
    # One step on the columns of the step before: in a single one each step's expression would be there several times.
    rows = albums.withColumn("genre_profile", grading.tag_profile(F.col("genre_tag")))
    rows = rows.withColumn("quality_grade", grading.grade(F.col("dynamic_range_score"), F.col("genre_profile")))
    return rows.withColumns(
        {
            "grade_rank": grading.grade_rank(F.col("quality_grade")),
            "codec_norm": text.norm(F.coalesce("codec", F.lit(""))),
            "profile_norm": F.coalesce(text.canonical_profile(F.col("current_quality")), text.norm(F.coalesce("current_quality", F.lit("")))),
        }
    )


def to_encode() -> Column:
    """Not recoded, not failed, and lossless or a surround track that is to be replaced."""
    codec = F.col("codec_norm")
    surround = (F.coalesce("needs_replacement", F.lit(0)) == 1) & codec.isin("dts", "dca")
    return F.col("last_recoded_at").isNull() & (F.col("scan_failed") == 0) & (((F.col("needs_recode") == 1) & ~text.is_lossy(codec)) | surround)


def where(
    albums: DataFrame,
    *,
    rarity: bool = False,
    replace: bool = False,
    recode: bool = False,
    failed: bool = False,
    encode: bool = False,
    grades: str = "all",
    codec: str | None = None,
    profile: str | None = None,
) -> DataFrame:
    """The rows of graded albums that pass every filter. replace and recode together mean either. ~unknown: none given."""
    tests = [F.col("rarity") == int(rarity)]
    if replace and recode:
        tests.append((F.col("needs_replacement") == 1) | (F.col("needs_recode") == 1))
    elif replace:
        tests.append(F.col("needs_replacement") == 1)
    elif recode:
        tests.append(F.col("needs_recode") == 1)
    if failed:
        tests.append(F.col("scan_failed") == 1)
    if encode:
        tests.append(to_encode())
    if grades in CLASSES:
        tests.append(F.col("quality_grade").isin(*CLASSES[grades]))
    if codec is not None:
        tests.append(F.col("codec_norm") == ("" if codec == UNKNOWN else codec.strip().lower()))
    if profile is not None:
        wanted = F.lit("") if profile == UNKNOWN else F.coalesce(text.canonical_profile(F.lit(profile)), F.lit(profile.lower()))
        tests.append(F.col("profile_norm") == wanted)
    return albums.where(reduce(Column.__and__, tests))


#: Sort keys. Missing values have sentinels, so that their place doesn't depend on an engine's order of nulls.
SORTS = {
    "checked": lambda: F.coalesce("last_checked_at", F.lit(0)),
    "score": lambda: F.coalesce("dynamic_range_score", F.lit(9999.0)),
    "dr": lambda: F.coalesce("dynamic_range_score", F.lit(-9999.0)),
    "grade": lambda: F.col("grade_rank"),
    "artist": lambda: F.lower("artist"),
    "album": lambda: F.lower("album"),
    "year": lambda: F.coalesce("year_int", F.lit(0)),
    "replace": lambda: F.coalesce("needs_replacement", F.lit(0)),
    "fail": lambda: F.coalesce("scan_failed", F.lit(0)),
    "curr": lambda: text.profile_key(F.coalesce("current_quality", F.lit(""))),
    "codec": lambda: F.coalesce(F.nullif("codec_norm", F.lit("")), F.lit(UNKNOWN)),
}


def order(key: str, descending: bool, filtered: bool = False, backward: bool = False) -> list[Column]:
    """The total order of a view, or that order from its end. The artist follows the main direction when a codec, profile or search filter is on."""
    turn = lambda c, down: c.desc() if down != backward else c.asc()
    out = [turn(SORTS[key](), descending)]
    if key in ("replace", "fail"):
        out.append(turn(F.col("grade_rank"), False))
    if key in ("grade", "replace", "fail"):
        out.append(turn(F.coalesce("dynamic_range_score", F.lit(9999.0)), False))
    return [*out, turn(F.lower("artist"), descending and filtered), turn(F.lower("album"), False), turn(F.coalesce("year_int", F.lit(0)), False), turn(F.col("id"), False)]


#: View presets: filters, sort key, descending.
VIEWS: dict[str, tuple[dict, str, bool]] = {
    "default": ({}, "checked", True),
    "grade_first": ({}, "grade", False),
    "replace_queue": ({"replace": True, "recode": True}, "grade", False),
    "codec_inventory": ({}, "codec", False),
    "encoding_inventory": ({}, "curr", True),
    "encode_only": ({"encode": True}, "checked", True),
    "scan_failed": ({"failed": True}, "checked", True),
    "rarity_only": ({"rarity": True}, "checked", True),
    "upscaled_replace": ({"replace": True, "recode": True}, "grade", False),
}


#: Other names of views, of sort keys and of classes.
VIEW_NAMES = {
    "grade": "grade_first", "grades": "grade_first", "grade-first": "grade_first", "replace": "replace_queue", "queue": "replace_queue", "replace-or-upscaled": "replace_queue", "replace_or_upscaled": "replace_queue",
    "codecs": "codec_inventory", "codec": "codec_inventory", "encodings": "encoding_inventory", "encoding": "encoding_inventory", "profile": "encoding_inventory", "profiles": "encoding_inventory",
    "upscaled-replace": "upscaled_replace", "upscaled": "upscaled_replace", "upscaledreplace": "upscaled_replace", "encode": "encode_only", "enc": "encode_only", "upscaled-only": "encode_only", "upscaled_only": "encode_only",
    "scan-failed": "scan_failed", "failed": "scan_failed", "mixed-first": "scan_failed", "mixed_first": "scan_failed", "mixed": "scan_failed", "rarity": "rarity_only", "rarities": "rarity_only", "rarity-only": "rarity_only",
}
SORT_NAMES = {
    "last": "checked", "last_checked": "checked", "last_checked_at": "checked", "quality_score": "score", "dynamic_range": "dr", "dynamic-range": "dr", "dynamicrange": "dr", "dynamic_range_score": "dr", "quality_grade": "grade",
    "artist_lc": "artist", "album_lc": "album", "year_int": "year", "replacement": "replace", "needs_replacement": "replace", "failed": "fail", "scan_failed": "fail", "current": "curr", "profile": "curr", "current_quality": "curr",
}
CLASS_NAMES = {"sb": "s-b", "cf": "c-f"}


def _named(raw: str, names: dict[str, str], known) -> str:
    name = names.get(raw.lower(), raw.lower())
    if name not in known:
        raise ValueError(f"{raw!r} is none of {', '.join(known)}")
    return name


def view_named(raw: str) -> str:
    """The view that a name in any case stands for."""
    return _named(raw, VIEW_NAMES, VIEWS)


def sort_named(raw: str) -> str:
    """The sort key that a name in any case stands for."""
    return _named(raw, SORT_NAMES, SORTS)


def class_named(raw: str) -> str:
    """The class filter (all, s-b, c-f) that a name in any case stands for."""
    return _named(raw, CLASS_NAMES, ("all", *CLASSES))


def display(albums: DataFrame) -> DataFrame:
    """The cells of a page as they are shown: codec, bitrate and profile as they are stored; an album's name is marked with
    a star if it was recoded and one if it has lyrics; a failed one shows its notes, else what is recommended.
    """
    dash = F.lit("-")
    dr = F.col("dynamic_range_score")
    given = lambda c: F.nullif(c, F.lit(""))
    star = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, "*").otherwise("")
    shown = F.when(dr.isNull(), dash).when(dr == F.floor(dr), dr.cast("long").cast("string")).otherwise(F.format_string("%.1f", dr))
    advice = F.coalesce(given("recode_recommendation"), dash)
    return albums.select(
        "id",
        "artist",
        F.concat("album", star("last_recoded_at"), star("has_lyrics")).alias("album"),
        F.when(F.col("year_int") == 0, dash).otherwise(F.col("year_int").cast("string")).alias("year"),
        F.coalesce("quality_grade", dash).alias("grade"),
        shown.alias("dr"),
        F.coalesce(given("codec"), dash).alias("codec"),
        F.coalesce(given("bitrate"), dash).alias("bitrate"),
        F.coalesce(given("current_quality"), dash).alias("profile"),
        F.when(F.coalesce("scan_failed", F.lit(0)) == 1, F.coalesce(given("notes"), advice)).otherwise(advice).alias("recode"),
        F.when(F.col("scan_failed") == 1, "Y").otherwise(dash).alias("fail"),
        F.when(F.coalesce("last_checked_at", F.lit(0)) != 0, F.date_format(F.timestamp_seconds("last_checked_at"), "yyyy-MM-dd HH:mm")).otherwise(dash).alias("checked"),
    )


def page(albums: DataFrame, view: str = "default", number: int = 1, size: int = 15, codec: str | None = None, profile: str | None = None) -> DataFrame:
    """A page of a view by offset, of one codec or profile if given. Only size * number rows are ever sorted to the end (a
    top-k heap in each task), by what the filters and the sort need; all else is worked out for the rows of the page.
    """
    filters, key, descending = VIEWS[view_named(view)]
    keys = order(key, descending, codec is not None or profile is not None)
    rows = where(graded(albums), **filters, codec=codec, profile=profile).orderBy(*keys).offset(size * (number - 1)).limit(size)
    return display(graded(_page_rows(rows, albums)).orderBy(*keys))


def _page_rows(rows: DataFrame, albums: DataFrame) -> DataFrame:
    """The stored columns of a page, in one partition as after its limit: Spark doesn't move what is derived from them below it."""
    return rows.select(*albums.columns).coalesce(1)


def page_count(albums: DataFrame, view: str = "default", size: int = 15) -> int:
    """How many pages a view has, one at least."""
    return max(1, -(-where(graded(albums), **VIEWS[view_named(view)][0]).count() // size))


def nearest_page(albums: DataFrame, view: str, number: int, size: int = 15) -> DataFrame:
    """The page of that number, or the first or the last where there is none.

    Pages of the second half are looked for from the end, so the last page costs as little as the first.
    """
    filters, key, descending = VIEWS[view_named(view)]
    rows = where(graded(albums), **filters)
    total = rows.count()
    number = min(max(number, 1), max(1, -(-total // size)))
    left = total - size * (number - 1)
    if left >= size * number:
        return page(albums, view, number, size)
    keys = order(key, descending)
    last = rows.orderBy(*order(key, descending, backward=True)).limit(left)
    last = last.orderBy(*keys).limit(size) if left > size else last
    return display(graded(_page_rows(last, albums)).orderBy(*keys))


def page_after(albums: DataFrame, cursor: tuple[int, str, str, int, int], size: int = 15, backward: bool = False, descending: bool = True, artist_descending: bool = False, **filters) -> DataFrame:
    """The page after (or before) a row of a view sorted by time of the last check, in the view's order, by that row's key.

    The key: checked (down or up), artist (up, or down as in filtered views), album, year and id up. filters: see where.
    """
    keys = [SORTS["checked"](), F.lower("artist"), F.lower("album"), F.coalesce("year_int", F.lit(0)), F.col("id")]
    down = [descending, artist_descending, False, False, False]
    test, same = F.lit(False), F.lit(True)
    for k, desc, value in zip(keys, down, cursor, strict=True):
        further = (k < F.lit(value)) if desc != backward else (k > F.lit(value))
        test, same = test | (same & further), same & (k == F.lit(value))
    turned = lambda back: [k.desc() if desc != back else k.asc() for k, desc in zip(keys, down, strict=True)]
    rows = where(graded(albums), **filters).where(test).orderBy(*turned(backward)).limit(size)
    return display(graded(_page_rows(rows, albums)).orderBy(*turned(False)))


def stats(albums: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: how many albums, how many of each grade, how long the queue is."""
    by_grade = [F.count_if(F.col("quality_grade") == g).alias(f"n_{g.lower()}") for g in (*grading.GRADES, "F")]
    return where(graded(albums)).agg(F.count("*").alias("total"), *by_grade).crossJoin(queue.agg(F.count("*").alias("queued")))


def inventory(albums: DataFrame, column: str) -> DataFrame:
    """How many albums have each value of codec_norm or profile_norm (~unknown: none), and __all__."""
    rows = where(graded(albums)).select(F.coalesce(F.nullif(column, F.lit("")), F.lit(UNKNOWN)).alias("value"))
    return rows.groupBy("value").agg(F.count("*").alias("n")).unionByName(rows.agg(F.count("*").alias("n")).select(F.lit("__all__").alias("value"), "n"))


def inventory_order(column: str) -> list[Column]:
    """The order of an inventory: all first, then by value; profiles that are one by depth (float as ten times its bits) and rate
    downwards, then others, those without any last.
    """
    v = F.col("value")
    first = F.when(v == "__all__", 0).otherwise(1).asc()
    if column != "profile_norm":
        return [first, v.asc()]
    there, bits = F.instr(v, "/") > 0, F.lower(F.trim(F.substring_index(v, "/", -1)))
    depth = F.when(bits == "64f", 640).when(bits == "32f", 320).when(bits.rlike("^[0-9][0-9]"), F.regexp_extract(bits, "^([0-9]+)", 1).try_cast("int") * 10).otherwise(0)
    rate = F.coalesce(F.regexp_extract(v, r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))
    return [first, F.when(v == UNKNOWN, 3).when(there, 0).otherwise(2).asc(), F.when(there, depth).otherwise(0).desc(), F.when(there, rate).otherwise(0.0).desc(), v.asc()]


def ordered_inventory(albums: DataFrame, column: str) -> DataFrame:
    """inventory() in its order, with the place of each value from 1 on. There are as many rows as values."""
    order = inventory_order(column)
    return inventory(albums, column).withColumn("place", F.row_number().over(Window.orderBy(*order))).orderBy(*order)


def inspectable() -> Column:
    """Whether a row's tracks can be looked at: no recode wanted, not failed, no rescan pending."""
    pending = F.lower(F.coalesce("recode_recommendation", F.lit(""))).contains("pending rescan")
    return (F.coalesce("needs_recode", F.lit(0)) != 1) & (F.coalesce("scan_failed", F.lit(0)) != 1) & ~pending


def grade_shares(albums: DataFrame) -> DataFrame:
    """Whole percents of each grade, half up."""
    rows = where(graded(albums)).select(F.coalesce("quality_grade", F.lit("-")).alias("grade")).groupBy("grade").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("total", total).select("grade", "n", F.floor((F.col("n") * 100 + F.floor(F.col("total") / 2)) / F.col("total")).cast("long").alias("percent"))


def like_hit(query: str) -> Column:
    """Whether artist and album hold the words of the query in order, or the query without spaces."""
    words = " ".join(query.split())
    safe = words.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    hay = F.concat_ws(" ", F.lower("artist"), F.lower("album"))
    return F.ilike(hay, F.lit("%" + safe.replace(" ", "%") + "%")) | F.contains(F.replace(hay, F.lit(" "), F.lit("")), F.lit(words.replace(" ", "").lower()))


def query_tokens(query: str) -> list[str]:
    """Lower-case tokens; neighbouring ones of digits only are one (19 84: 1984)."""
    out: list[str] = []
    for token in query.lower().split():
        if token.isdigit() and out and out[-1].isdigit():
            out[-1] += token
        else:
            out.append(token)
    return out


def token_hit(tokens: Sequence[str]) -> Column:
    """Whether each token begins some word of artist or album, marks of letters aside.

    A token of several words (ac-dc) is a phrase: its words stand side by side, the last one may go on. A token without
    letters and digits (!!!) is a phrase of nothing, which nothing holds.
    """
    words = F.concat(F.lit(" "), F.regexp_replace(text.unmarked(F.concat_ws(" ", "artist", "album")), r"[^\p{L}\p{N}]+", " "))
    phrases = [" ".join(re.findall(r"[^\W_]+", text.unmarked_text(t))) for t in tokens]
    if not all(phrases):
        return F.lit(False)
    return reduce(Column.__and__, (F.contains(words, F.lit(f" {p}")) for p in phrases), F.lit(True))


def search(albums: DataFrame, query: str) -> DataFrame:
    """Rows that the words of the query begin; if none in the whole catalog do, rows that hold it as text.

    Whether any row does is asked with a limit, so each task stops at its first one.
    """
    hit = token_hit(query_tokens(query))
    any_hit = albums.where(hit).select(F.lit(1).alias("_one")).limit(1).agg((F.count("*") > 0).alias("any_hit"))
    rows = where(graded(albums)).crossJoin(any_hit)  # one row
    return rows.where(hit | (~F.col("any_hit") & like_hit(query))).drop("any_hit")


def one_of_variants(albums: DataFrame) -> DataFrame:
    """One row for each artist (spaces and dashes aside), album and year: a dashed name first, the last checked, the highest id.

    Derive columns (see graded) after it: all columns of albums go through its shuffle and sort.
    """
    dashed = F.when(F.col("artist").rlike(f"[{text.DASHES}]"), 0).otherwise(1)
    first = Window.partitionBy(text.compact(F.col("artist")), F.lower("album"), F.coalesce("year_int", F.lit(0))).orderBy(dashed, SORTS["checked"]().desc(), F.col("id").desc())
    return albums.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
