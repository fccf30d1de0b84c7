"""Mixing sources to target weights (DataFrame functions only).

Each row gets a hash-random key. Keys are range-partitioned within their source
into buckets of a bounded number of rows; totals of buckets, and of groups of
buckets, give each bucket the sum of all before it, a window inside the bucket
gives the rest of the prefix sum,
and the mix takes whole epochs of a source and then rows in key order up to the
source's exact budget, cutting the row at the edge.

No step gathers a source: a source with a third of all rows is spread over
buckets by its keys. What meets in one task is a bucket's rows, a group's bucket
totals, a source's group totals (one for each GROUP * rows_per_bucket rows), and
one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_words, materialise

#: Bits of the key's head from which the bucket is taken.
HEAD_BITS = 32
#: Buckets whose totals are summed together.
GROUP = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """Share the sum of all sizes among sources by weight, none above epochs times its size.

    sizes has a row per source: source, source_size. Sources by code point, null
    last, get the weights in turn. What a source can't take is shared among the
    others by weight until none is above its bound: that is the water level at
    which min(bound, level * weight) sums to the whole. Returns source,
    source_size, target. Sources of size 0 get 0; an empty table stays empty.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    everything = W.partitionBy()
    by_level = W.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    out = sizes.select("source", "source_size", weight.alias("weight"))
    out = out.withColumn("bound", (F.col("source_size") * epochs).cast("double"))
    out = out.withColumn("fill", F.col("bound") / F.col("weight"))
    out = out.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("parts"),
    )
    out = out.withColumn("level", F.col("left") / F.col("parts"))
    final = F.min(F.when(F.col("bound") > F.col("level") * F.col("weight"), F.struct("fill", "source", "level"))).over(everything)
    out = out.withColumn("final", final["level"])
    capped = (F.col("bound") <= F.col("level") * F.col("weight")) | F.col("final").isNull()
    target = F.when(capped, F.col("bound")).otherwise(F.least("bound", F.col("final") * F.col("weight")))
    return out.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size: Column | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    epochs: int = 3,
    seed: str = "mix",
    rows_per_bucket: int = 4_000,
) -> DataFrame:
    """How much the mix takes of each document.

    Returns one row per input row: id_col, size, source_size, target (of its
    source), taken. size defaults to the words of text_col; null texts have 0.
    taken counts repeats and sums, per source, to the target rounded to a whole;
    it is at most epochs times the size. A rerun takes the same: the order is the
    MD5 of seed and id. Null ids count as empty strings, null sources are a
    source of their own, repeated rows count each, an empty table stays empty.
    """
    size = count_words(F.col(text_col)) if size is None else size
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), key.alias("key"))
    rows = materialise(rows, "mix")
    buckets = max(1, -(-rows.count() // rows_per_bucket))
    head = F.conv(F.substring("key", 1, HEAD_BITS // 4), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(head * buckets / F.lit(2**HEAD_BITS)).cast("int"))

    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    totals = totals.withColumn("group", F.floor(F.col("bucket") / GROUP).cast("int"))
    groups = totals.groupBy("source", "group").agg(F.sum("total").alias("total"))
    before = lambda *within: W.partitionBy(*within[:-1]).orderBy(within[-1]).rowsBetween(W.unboundedPreceding, -1)
    summed = lambda *within: F.coalesce(F.sum("total").over(before(*within)), F.lit(0))
    bases = groups.select(F.col("source").alias("g_source"), F.col("group").alias("g"), summed("source", "group").alias("base"))
    starts = totals.select("source", "group", "bucket", summed("source", "group", "bucket").alias("start"))
    starts = starts.join(bases, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("group") == F.col("g"))).select("source", "bucket", (F.col("start") + F.col("base")).alias("start"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("total").alias("source_size")), weights, epochs)
    plan = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    plan = plan.select(F.col("s.source").alias("p_source"), F.col("bucket").alias("p_bucket"), "start", "source_size", "target")

    out = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
    inside = W.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("prefix", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.round("target").cast("long")
    whole, rest = F.expr("cast(round(target) as bigint) div greatest(source_size, 1)"), budget % F.greatest("source_size", F.lit(1))
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("prefix")))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST([5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
              CAST(3 * source_size AS DOUBLE) AS bound FROM s0),
s2 AS (SELECT *, bound / weight AS fill FROM s1),
s3 AS (SELECT *,
  (sum(source_size) OVER () - coalesce(sum(bound) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level
  FROM s2 WINDOW w AS (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (SELECT arg_min(level, fill) FROM s3 x WHERE x.bound > x.level * x.weight) AS final FROM s3),
t AS (SELECT source, source_size, CASE WHEN bound <= level * weight OR final IS NULL THEN bound ELSE least(bound, final * weight) END AS target FROM s4),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(budget // greatest(source_size, 1) * size + greatest(0, least(size, budget % greatest(source_size, 1) - prefix)) AS BIGINT) AS taken FROM p
"""
