"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needledrop.llm.common import column_of, partitions_for, whole_rows, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size, target for a table (source, size) of any number of rows.

    Sources in code-point order, null last, take the weights in turn and share the total of all sizes. A target stops at
    `most` times its source's size; what is over is shared again by weight until no target is above. Sorted by
    size for each weight, the stopped sources come first, so running sums give the end of that in one pass. One row
    for each source goes through one task here; documents don't.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    one = one.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    first = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = one.select(
        "source", "source_size", "weight",
        (F.sum("source_size").over(every) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
        F.row_number().over(first).alias("at"),
    )
    one = one.withColumn("stopped", F.lit(most) * F.col("source_size") * F.col("weight_left") <= F.col("left") * F.col("weight"))
    free = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # The first source that isn't stopped fixes what is left and by which weight it is shared.
    level = F.min(F.when(~F.col("stopped"), F.struct("at", "left", "weight_left"))).over(every)
    one = one.withColumn("level", level)
    target = F.when(F.col("stopped"), (F.lit(most) * F.col("source_size")).cast("double")).otherwise((F.col("level.left") * F.col("weight")).cast("double") / F.col("level.weight_left"))
    return one.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source in [0, 1): 32 bits of a digest, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (doc_id, text, source).

    Systematic sampling: within a source, documents stand in the order of (size, doc_id), each with target/source_size
    expected copies; the prefix sums of those, moved by the source's one random offset, cross whole numbers, and a
    document is emitted once for each number crossed. In the order of sizes each stretch of like documents gives its
    share, so the words taken come near the target.

    The order comes from a range partitioning, whose rows are numbered within a partition and kept in a written
    table; a partition's start in a source is the sum of a few counts for each (source, partition). No task sees
    a whole source, however large.

    Null text has size 0 and is copied as any other; null source is a source of its own, last; null ids sort first.
    Repeated rows are separate documents (equal ones take neighbouring places). A source without words has target
    0 and copies 0. An empty table gives no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    keys = [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("doc_id")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            sources = column_of(batch, "source")
            runs = pa.compute.run_end_encode(sources)
            places = np.empty(len(batch), dtype=np.int64)
            start = 0
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if last != (value,):
                    last, n = (value,), 0
                places[start:end] = np.arange(n, n + end - start)
                n, start = n + end - start, end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, dtype=np.int32)), pa.array(places)], names=["doc_id", "source", "size", "part", "place"])

    import pyarrow.compute  # noqa: F401

    ranged = sized.repartitionByRange(partitions_for(docs), *keys).sortWithinPartitions(*keys)
    rows = written(ranged.mapInArrow(number, "doc_id long, source string, size long, part int, place long"), "mixing")
    counts = rows.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    # One small row for each source and partition: fixed once, then used twice.
    counts = written(counts, "mixing-counts")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    targets = source_targets(counts.select("source", "size"), weights, most)
    plan = starts.join(targets, F.col("s").eqNullSafe(F.col("source")), "left").drop("source")
    e = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)), F.lit(float(most)))
    plan = plan.select("s", "p", "start", "source_size", "target", e.alias("e"), offset(F.col("s"), seed).alias("u"))
    place = F.col("start") + F.col("place")
    copies = F.floor((place + 1) * F.col("e") + F.col("u")) - F.floor(place * F.col("e") + F.col("u"))
    out = rows.join(plan, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def emit_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """The rows of docs, all columns, each as often as mix_sources says; rows without a copy go.

    Rows equal in id, source and size share their copies as evenly as they go.
    """
    mixed = mix_sources(docs, weights, most, seed).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    rows = docs.select(whole_rows(docs), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("of"), word_count(F.col("text")).alias("words"))
    found = rows.join(mixed, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("of").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size")))
    # Only the few rows that share their key need a number.
    many = found.where("n > 1").withColumn("at", F.row_number().over(Window.partitionBy("id", "of", "words").orderBy("copies")))
    numbered = found.where("n = 1").withColumn("at", F.lit(1)).unionByName(many)
    times = (F.floor(F.col("copies") / F.col("n")) + F.when(F.col("at") <= F.col("copies") % F.col("n"), 1).otherwise(0)).cast("int")
    return numbered.select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")


#: What op1_mix_sources gives, for DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), r AS (
  SELECT *, row_number() OVER o AS pos,
    sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0) AS remains,
    sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left
  FROM w
  WINDOW o AS (ORDER BY source_size / weight, source IS NULL, encode(source)),
         b AS (ORDER BY source_size / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, 3 * source_size * weight_left <= remains * weight AS stopped FROM r
), l AS (
  SELECT remains, weight_left FROM t WHERE NOT stopped ORDER BY pos LIMIT 1
), g AS (
  SELECT source, source_size,
    CASE WHEN stopped THEN CAST(3 * source_size AS DOUBLE)
         ELSE CAST((SELECT remains FROM l) * weight AS DOUBLE) / CAST((SELECT weight_left FROM l) AS DOUBLE) END AS target,
    CAST(('0x' || substr(md5('17:' || coalesce('=' || source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM t
), p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.u,
    CASE WHEN g.source_size > 0 THEN least(g.target / CAST(g.source_size AS DOUBLE), 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS e,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS place
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor((place + 1) * e + u) - floor(place * e + u)) * size AS BIGINT) AS taken
FROM p
"""
