"""Catalog queries over the bound tables, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.functions import text
from needledrop.functions.grading import AUDIOPHILE, BOUNDS, GRADES, HIGH_ENERGY, TAG_AUDIOPHILE, TAG_HIGH, grade, tag_profile, voted_profile
from needledrop.operators import catalog
from needledrop.sources.bind import ALBUMS_SQL, albums, choose, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def names(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def any_part(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def grade_sql(dr: str, profile: str) -> str:
    one = lambda b: "CASE " + " ".join(f"WHEN trunc({dr}) >= {least} THEN '{g}'" for least, g in zip(b, GRADES, strict=True)) + " ELSE 'F' END"
    return f"CASE WHEN {dr} IS NULL THEN NULL WHEN {profile} = 'audiophile' THEN {one(BOUNDS['audiophile'])} WHEN {profile} = 'high_energy' THEN {one(BOUNDS['high_energy'])} ELSE {one(BOUNDS['standard'])} END"


def tag_sql(tag: str) -> str:
    rank = f"CASE WHEN {any_part('s', TAG_HIGH)} THEN 2 WHEN {any_part('s', TAG_AUDIOPHILE)} THEN 1 ELSE 0 END"
    return f"CASE list_max(list_transform(string_split(lower({tag}), ';'), lambda s: {rank})) WHEN 2 THEN 'high_energy' WHEN 1 THEN 'audiophile' ELSE 'standard' END"


def canonical_sql(raw: str) -> str:
    """RATE/DEPTH, by regular expressions."""
    x = f"regexp_replace(replace(lower({raw}), '_', '/'), '\\s+', '', 'g')"
    whole = "^([0-9][0-9.a-z]*)[/:-]([0-9a-z]+)$"
    left, right = f"regexp_extract({x}, '{whole}', 1)", f"regexp_extract({x}, '{whole}', 2)"
    number = f"TRY_CAST(regexp_extract({left}, '^([0-9]+(?:\\.[0-9]+)?)(khz|hz|k)?$', 1) AS DOUBLE)"
    unit = f"regexp_extract({left}, '^([0-9]+(?:\\.[0-9]+)?)(khz|hz|k)?$', 2)"
    hz = f"CAST(round(CASE WHEN {unit} IN ('k', 'khz') THEN {number} * 1000 WHEN {unit} = 'hz' THEN {number} WHEN {number} < 1000 THEN {number} * 1000 ELSE {number} END) AS INTEGER)"
    digits = f"regexp_extract({right}, '^0*([1-9][0-9]*)(?:bits?|b)?$', 1)"
    bits = f"CASE WHEN {right} IN ('32f', 'f32', 'flt', 'fltp', 'float32') THEN '32f' WHEN {right} IN ('64f', 'f64', 'dbl', 'dblp', 'double', 'float64') THEN '64f' WHEN {digits} <> '' THEN {digits} END"
    return f"CASE WHEN {hz} > 0 THEN CAST({hz} AS VARCHAR) || '/' || ({bits}) END"


def norm_sql(x: str) -> str:
    return f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"


GRADED = f"""{ALBUMS_SQL}, tagged AS (
  SELECT *, {tag_sql("genre_tag")} AS genre_profile, {norm_sql("coalesce(codec, '')")} AS codec_norm,
    coalesce({canonical_sql("current_quality")}, {norm_sql("coalesce(current_quality, '')")}) AS profile_norm
  FROM albums
), named AS (
  SELECT *, {grade_sql("dynamic_range_score", "genre_profile")} AS quality_grade FROM tagged
), graded AS (
  SELECT *, CASE quality_grade WHEN 'S' THEN 5 WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'F' THEN 1 ELSE 6 END AS grade_rank FROM named
)"""

LOSSY_SQL = f"(codec_norm IN ({names(text.LOSSY)}) OR starts_with(codec_norm, 'adpcm_'))"
ENCODE_SQL = f"last_recoded_at IS NULL AND scan_failed = 0 AND ((needs_recode = 1 AND NOT {LOSSY_SQL}) OR (needs_replacement = 1 AND codec_norm IN ('dts', 'dca')))"

CELLS = """id, artist,
  album || CASE WHEN last_recoded_at > 0 THEN '*' ELSE '' END || CASE WHEN has_lyrics > 0 THEN '*' ELSE '' END AS album,
  CASE WHEN year_int = 0 THEN '-' ELSE CAST(year_int AS VARCHAR) END AS year, coalesce(quality_grade, '-') AS grade,
  CASE WHEN dynamic_range_score IS NULL THEN '-' WHEN dynamic_range_score = floor(dynamic_range_score) THEN CAST(CAST(dynamic_range_score AS BIGINT) AS VARCHAR)
    ELSE printf('%.1f', dynamic_range_score) END AS dr,
  coalesce(nullif(current_quality, ''), '-') AS profile, coalesce(nullif(codec, ''), '-') AS codec, coalesce(nullif(bitrate, ''), '-') AS bitrate,
  CASE WHEN scan_failed = 1 THEN coalesce(nullif(notes, ''), nullif(recode_recommendation, ''), '-') ELSE coalesce(nullif(recode_recommendation, ''), '-') END AS recode,
  CASE WHEN scan_failed = 1 THEN 'Y' ELSE '-' END AS fail, CASE WHEN last_checked_at <> 0 THEN strftime(make_timestamp(last_checked_at * 1000000), '%Y-%m-%d %H:%M') ELSE '-' END AS checked"""

PROFILE_KEY_SQL = """(CASE WHEN instr(coalesce(current_quality, ''), '/') > 0 THEN CASE lower(split_part(current_quality, '/', 2)) WHEN '64f' THEN 640 WHEN '32f' THEN 320
  ELSE coalesce(TRY_CAST(regexp_extract(lower(split_part(current_quality, '/', 2)), '^([0-9]{2,})', 1) AS INTEGER) * 10, 0) END ELSE 0 END) * 1000.0::DOUBLE
  + coalesce(CASE WHEN instr(coalesce(current_quality, ''), '/') > 0 THEN TRY_CAST(regexp_extract(split_part(current_quality, '/', 1), '^([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) END, 0)"""

SORTED = {
    "checked": "coalesce(last_checked_at, 0)",
    "grade": "grade_rank",
    "codec": "coalesce(nullif(codec_norm, ''), '~unknown')",
    "curr": PROFILE_KEY_SQL,
}
FILTERED = {
    "default": "rarity = 0",
    "grade_first": "rarity = 0",
    "replace_queue": "rarity = 0 AND (needs_replacement = 1 OR needs_recode = 1)",
    "codec_inventory": "rarity = 0",
    "encoding_inventory": "rarity = 0",
    "encode_only": f"rarity = 0 AND {ENCODE_SQL}",
    "scan_failed": "rarity = 0 AND scan_failed = 1",
    "rarity_only": "rarity = 1",
    "upscaled_replace": "rarity = 0 AND (needs_replacement = 1 OR needs_recode = 1)",
}


def page_sql(view: str, number: int = 1, size: int = 15) -> str:
    _, key, down = catalog.VIEWS[view]
    tie = "coalesce(dynamic_range_score, 9999.0) ASC, " if key == "grade" else ""
    return f"""WITH {GRADED} SELECT {CELLS} FROM graded WHERE {FILTERED[view]}
ORDER BY {SORTED[key]} {"DESC" if down else "ASC"}, {tie}lower(artist) ASC, lower(album) ASC, coalesce(year_int, 0) ASC, id ASC LIMIT {size} OFFSET {size * (number - 1)}"""


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


for _view in catalog.VIEWS:
    add(f"browse_{_view}", lambda spark, d, v=_view: catalog.page(albums(spark, d), v), page_sql(_view))
for _alias, _view in (("Grades", "grade_first"), ("upscaled-only", "encode_only"), ("mixed", "scan_failed")):
    add(f"browse_by_alias_{_alias.lower().replace('-', '_')}", lambda spark, d, v=_alias: catalog.page(albums(spark, d), v), page_sql(_view))
add("page_offset", lambda spark, d: catalog.page(albums(spark, d), "grade_first", 3), page_sql("grade_first", 3))

#: A place in the default view: checked, artist, album, year, id.
CURSOR = (900_000_000, "customer#000000100", "3-medium vol 7", 1998, 1234)
_KEYS = ("coalesce(last_checked_at, 0)", "lower(artist)", "lower(album)", "coalesce(year_int, 0)", "id")


def _keyset_sql(backward: bool, descending: bool = True, artist_descending: bool = False, test: str = "rarity = 0") -> str:
    values = [f"'{v}'" if isinstance(v, str) else str(v) for v in CURSOR]
    down = [descending, artist_descending, False, False, False]
    tests = []
    for i in range(5):
        same = [f"{_KEYS[j]} = {values[j]}" for j in range(i)]
        tests.append("(" + " AND ".join([*same, f"{_KEYS[i]} {'<' if down[i] != backward else '>'} {values[i]}"]) + ")")
    order = ", ".join(f"{k} {'DESC' if x != backward else 'ASC'}" for k, x in zip(_KEYS, down, strict=True))
    return f"WITH {GRADED} SELECT {CELLS} FROM graded WHERE {test} AND ({' OR '.join(tests)}) ORDER BY {order} LIMIT 15"


add("page_keyset_next", lambda spark, d: catalog.page_after(albums(spark, d), CURSOR), _keyset_sql(False))
add("page_keyset_prev", lambda spark, d: catalog.page_after(albums(spark, d), CURSOR, backward=True), _keyset_sql(True))
for _back in (False, True):
    for _down, _artist in ((False, False), (True, True)):
        add(
            f"page_keyset_{'prev' if _back else 'next'}_{'of_codec' if _artist else 'ascending'}",
            lambda spark, d, b=_back, x=_down, y=_artist: catalog.page_after(albums(spark, d), CURSOR, backward=b, descending=x, artist_descending=y, **({"codec": "flac"} if y else {"failed": True})),
            _keyset_sql(_back, _down, _artist, "rarity = 0 AND " + ("codec_norm = 'flac'" if _artist else "scan_failed = 1")),
        )

_KEPT = ("id", "artist", "album", "quality_grade", "codec_norm", "profile_norm")


def _filter(name: str, test: str, **filters) -> None:
    add(name, lambda spark, d: catalog.where(catalog.graded(albums(spark, d)), **filters).select(*_KEPT), f"WITH {GRADED} SELECT {', '.join(_KEPT)} FROM graded WHERE {test}")


_filter("class_filter_s_b", "rarity = 0 AND quality_grade IN ('S', 'A', 'B')", grades="s-b")
_filter("class_filter_c_f", "rarity = 0 AND quality_grade IN ('C', 'F')", grades="c-f")
_filter("encode_queue", f"rarity = 0 AND {ENCODE_SQL}", encode=True)
_filter("replace_filter", "rarity = 0 AND needs_replacement = 1", replace=True)
_filter("recode_filter", "rarity = 0 AND needs_recode = 1", recode=True)
_filter("codec_filter", "rarity = 0 AND codec_norm = 'flac'", codec=" FLAC")
_filter("codec_unknown", "rarity = 0 AND codec_norm = ''", codec="~unknown")
_filter("profile_filter", "rarity = 0 AND profile_norm = '44100/16'", profile="44.1-16")
_filter("profile_unknown", "rarity = 0 AND profile_norm = ''", profile="~unknown")

for _column in ("codec_norm", "profile_norm"):
    add(
        f"inventory_{_column.removesuffix('_norm')}",
        lambda spark, d, c=_column: catalog.inventory(albums(spark, d), c),
        f"WITH {GRADED} SELECT coalesce(nullif({_column}, ''), '~unknown') AS value, count(*) AS n FROM graded WHERE rarity = 0 GROUP BY 1 UNION ALL SELECT '__all__', count(*) FROM graded WHERE rarity = 0",
    )
_FIRST = "CASE WHEN value = '__all__' THEN 0 ELSE 1 END"
_PLACES = {
    "codec_norm": f"{_FIRST}, value",
    "profile_norm": f"""{_FIRST}, CASE WHEN value = '~unknown' THEN 3 WHEN contains(value, '/') THEN 0 ELSE 2 END, CASE WHEN NOT contains(value, '/') THEN 0 WHEN ends_with(value, '/64f') THEN 640 WHEN ends_with(value, '/32f') THEN 320 ELSE TRY_CAST(split_part(value, '/', 2) AS INTEGER) * 10 END DESC,
  CASE WHEN contains(value, '/') THEN TRY_CAST(split_part(value, '/', 1) AS DOUBLE) ELSE 0 END DESC, value""",
}
for _column, _places in _PLACES.items():
    add(
        f"inventory_order_{_column.removesuffix('_norm')}",
        lambda spark, d, c=_column: catalog.ordered_inventory(albums(spark, d), c),
        f"WITH {GRADED}, i AS (SELECT coalesce(nullif({_column}, ''), '~unknown') AS value, count(*) AS n FROM graded WHERE rarity = 0 GROUP BY 1 UNION ALL SELECT '__all__', count(*) FROM graded WHERE rarity = 0) SELECT value, n, row_number() OVER (ORDER BY {_places}) AS place FROM i",
    )
add("inspectable_rows", lambda spark, d: albums(spark, d).where(catalog.inspectable()).select("id"), f"WITH {ALBUMS_SQL} SELECT id FROM albums WHERE needs_recode <> 1 AND scan_failed <> 1 AND NOT coalesce(recode_recommendation ILIKE '%pending rescan%', false)")
add(
    "stats_row",
    lambda spark, d: catalog.stats(albums(spark, d), table(spark, d, "events")),
    f"WITH {GRADED} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (quality_grade = '{g}') AS n_{g.lower()}" for g in (*GRADES, "F")) + ", (SELECT count(*) FROM events) AS queued FROM graded WHERE rarity = 0",
)
add(
    "grade_pct",
    lambda spark, d: catalog.grade_shares(albums(spark, d)),
    f"WITH {GRADED}, c AS (SELECT coalesce(quality_grade, '-') AS grade, count(*) AS n FROM graded WHERE rarity = 0 GROUP BY 1) SELECT grade, n, CAST((n * 100 + (SELECT sum(n) FROM c) // 2) // (SELECT sum(n) FROM c) AS BIGINT) AS percent FROM c",
)

_HAY = "lower(artist) || ' ' || lower(album)"
_LIKE = f"({_HAY} ILIKE '%customer%12%vol%' OR contains(replace({_HAY}, ' ', ''), 'customer12vol'))"
_WORDS = "string_split_regex(lower(artist || ' ' || album), '[^\\p{L}\\p{N}]+')"


def _tokens_sql(tokens: list[str]) -> str:
    return "(" + " AND ".join(f"list_bool_or(list_transform({_WORDS}, lambda w: starts_with(w, '{t}')))" for t in tokens) + ")"


add("search_like", lambda spark, d: catalog.where(catalog.graded(albums(spark, d))).where(catalog.like_hit(" customer  12 vol")).select(*_KEPT), f"WITH {GRADED} SELECT {', '.join(_KEPT)} FROM graded WHERE rarity = 0 AND {_LIKE}")
for _name, _query in (("search_token_prefix", "cust 0000 01 vol"), ("search_fallback", "ustomer 0001")):
    _t = catalog.query_tokens(_query)
    _like = f"({_HAY} ILIKE '%{'%'.join(_query.split())}%' OR contains(replace({_HAY}, ' ', ''), '{_query.replace(' ', '')}'))"
    add(
        _name,
        lambda spark, d, q=_query: catalog.search(albums(spark, d), q).select(*_KEPT),
        f"WITH {GRADED} SELECT {', '.join(_KEPT)} FROM graded WHERE rarity = 0 AND ({_tokens_sql(_t)} OR (NOT EXISTS (SELECT 1 FROM graded WHERE {_tokens_sql(_t)}) AND {_like}))",
    )
#: Signs alone match no word, so the text is looked for as it stands.
add("search_signs", lambda spark, d: catalog.search(albums(spark, d), "#").select("id"), f"WITH {GRADED} SELECT id FROM graded WHERE rarity = 0 AND {_HAY} LIKE '%#%'")
add("search_signs_and_word", lambda spark, d: catalog.search(albums(spark, d), "# 00012").select("id"), f"WITH {GRADED} SELECT id FROM graded WHERE rarity = 0 AND ({_HAY} LIKE '%#%00012%' OR contains(replace({_HAY}, ' ', ''), '#00012'))")
add("browse_of_codec", lambda spark, d: catalog.page(albums(spark, d), codec=" FLAC"), page_sql("default").replace("WHERE rarity = 0", "WHERE rarity = 0 AND codec_norm = 'flac'").replace("lower(artist) ASC", "lower(artist) DESC"))
add("browse_last_page", lambda spark, d: catalog.nearest_page(albums(spark, d), "grade_first", 10**6), page_sql("grade_first").rsplit("OFFSET", 1)[0] + "OFFSET (SELECT CAST((count(*) - 1) // 15 * 15 AS BIGINT) FROM graded WHERE rarity = 0)")


def _marked(spark, d):
    """Albums with letters that have marks, alone or after their letter."""
    k, artist = F.col("id"), F.replace("artist", F.lit("o"), F.lit("\u00f6"))
    return albums(spark, d).withColumn("artist", F.when(k % 3 == 0, artist).when(k % 3 == 1, F.replace("artist", F.lit("C"), F.lit("C\u0327"))).otherwise(F.col("artist")))


_PLAIN = "' ' || trim(regexp_replace(lower(artist || ' ' || album), '[^a-z0-9]+', ' ', 'g'))"
add(
    "search_marked_phrase",
    lambda spark, d: catalog.search(_marked(spark, d), "\u00c7ust\u00f6mer-00000 vol").select("id"),
    f"WITH {GRADED} SELECT id FROM graded WHERE rarity = 0 AND contains({_PLAIN}, ' customer 00000') AND contains({_PLAIN}, ' vol')",
)
add(
    "dedupe_artist_variants",
    lambda spark, d: catalog.graded(catalog.one_of_variants(albums(spark, d).where("rarity = 0").where(catalog.like_hit("vol")))).select(*_KEPT),
    f"""WITH {GRADED}, r AS (SELECT *, row_number() OVER (PARTITION BY translate(lower(artist), ' {text.DASHES}', ''), lower(album), coalesce(year_int, 0)
  ORDER BY CASE WHEN regexp_matches(artist, '[{text.DASHES}]') THEN 0 ELSE 1 END, coalesce(last_checked_at, 0) DESC, id DESC) AS k FROM graded WHERE rarity = 0 AND contains({_HAY}, 'vol'))
SELECT {', '.join(_KEPT)} FROM r WHERE k = 1""",
)

# Normalisers and grades over variants made from keys.
RAW = ("44100/16", "44.1/16", "44.1-16", "44k/16", "44khz/16", "48/24", "96-24", "96_24", "176.4/24", "192000hz/32f", "48k/float", " 96k/24 ", "abc", "44.1", "44//16", "foo-24", "0/16", "48/24bit", "88.2:024")


def _raw_sql(values: tuple[str, ...], number: str) -> str:
    return "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], CAST({number} % {len(values)} + 1 AS BIGINT))"


add(
    "profile_normalize",
    lambda spark, d: table(spark, d, "part").select("p_partkey", choose(RAW, F.col("p_partkey")).alias("raw")).select("p_partkey", "raw", text.canonical_profile(F.col("raw")).alias("profile")),
    f"SELECT p_partkey, raw, {canonical_sql('raw')} AS profile FROM (SELECT p_partkey, {_raw_sql(RAW, 'p_partkey')} AS raw FROM part)",
)
add(
    "profile_sort_key",
    lambda spark, d: albums(spark, d).select("id", text.profile_key(F.coalesce("current_quality", F.lit(""))).alias("sort_key")),
    f"WITH {ALBUMS_SQL} SELECT id, {PROFILE_KEY_SQL} AS sort_key FROM albums",
)
CODEC_RAW = ("MP3", "libvorbis", "wmapro", " flac ", "MPEGaudio", "aac", "", "wmav2", "dsd_lsbf", "mpeg1layer3", "mp2", "N/A", "wmavoice")
add(
    "codec_resolve",
    lambda spark, d: table(spark, d, "supplier").select("s_suppkey", choose(CODEC_RAW, F.col("s_suppkey")).alias("raw")).select("s_suppkey", text.codec_name(F.col("raw")).alias("codec"), text.is_lossy(text.codec_name(F.col("raw"))).alias("lossy")),
    f"""SELECT s_suppkey, codec, codec IN ({names(text.LOSSY)}) OR starts_with(codec, 'adpcm_') AS lossy FROM (SELECT s_suppkey, CASE WHEN x IN ('mpegaudio', 'mpeg1layer3') THEN 'mp3' WHEN x = 'libvorbis' THEN 'vorbis'
  WHEN x IN ('wmav2', 'wmavoice') THEN 'wma' WHEN x = 'n/a' THEN '' ELSE x END AS codec FROM (SELECT s_suppkey, {norm_sql(_raw_sql(CODEC_RAW, 's_suppkey'))} AS x FROM supplier))""",
)
add(
    "dr_grade",
    lambda spark, d: albums(spark, d).select("id", "dynamic_range_score", *(grade(F.col("dynamic_range_score"), F.lit(p)).alias(f"grade_{p}") for p in (*BOUNDS, "other"))),
    f"WITH {ALBUMS_SQL} SELECT id, dynamic_range_score, " + ", ".join(f"""{grade_sql("dynamic_range_score", f"'{p}'")} AS grade_{p}""" for p in (*BOUNDS, "other")) + " FROM albums",
)
add("genre_tag", lambda spark, d: albums(spark, d).select("id", tag_profile(F.col("genre_tag")).alias("profile")), f"WITH {ALBUMS_SQL} SELECT id, {tag_sql('genre_tag')} AS profile FROM albums")
_VOTES = "len(list_filter(string_split(lower(genre_tag), ';'), lambda t: {}))"
add(
    "genre_vote",
    lambda spark, d: albums(spark, d).select("id", voted_profile(F.split("genre_tag", ";")).alias("profile")),
    f"WITH {ALBUMS_SQL}, v AS (SELECT id, {_VOTES.format(any_part('t', AUDIOPHILE))} AS calm, {_VOTES.format(any_part('t', HIGH_ENERGY))} AS loud FROM albums) SELECT id, CASE WHEN calm = 0 AND loud = 0 THEN 'standard' WHEN calm >= loud THEN 'audiophile' ELSE 'high_energy' END AS profile FROM v",
)
