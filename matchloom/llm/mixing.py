"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size (words). A budget is shared in proportion to the weights; a source is clamped at
``max_epochs`` times its size, and what is cut off is shared again among the others by weight until no source is above
its clamp. Documents are then sampled by seeded whole and fractional repetitions: each document is taken
``floor(target / size of source)`` whole times, and the fractional repetition walks the source's documents in the order
of a seeded digest until the rest of the target is used up; the document on the border is taken in part.

Defined cases: a null source is a source of its own (last in order); null or empty texts have size 0 and take 0;
sources of size 0 get target 0; rows repeated in full get their own shares; an empty table gives an empty result; extra
columns pass through untouched unless they bear a result column's name, in which case the result column replaces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shielded, word_count

_OWN = ("__key", "__run", "__run_size", "__start", "__before", "__rest", "__text")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget_ratio: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Water-filling over one row per source (source, source_size) → adds weight, target.

    Closed form of the repeated re-sharing: in ascending order of cap per weight, the first source whose equal share of
    what is left stays within its cap sets the level for itself and all that follow; all before it are at their caps.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    w = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int")).cast("long"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    w = (
        w.withColumn("__cap", F.col("source_size") * F.lit(int(max_epochs)))
        .withColumn("__budget", F.sum("source_size").over(everything).cast("double") * F.lit(float(budget_ratio)))
        .withColumn("__capped", F.coalesce(F.sum("__cap").over(before), F.lit(0)))
        .withColumn("__weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("__level", (F.col("__budget") - F.col("__capped")) / F.col("__weights"))
        .withColumn("__fits", F.col("__level") * F.col("weight") <= F.col("__cap"))
    )
    first = F.min(F.when(F.col("__fits"), F.struct(F.col("__cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("__level"))))
    level = first.over(everything)["__level"]
    place = F.struct(F.col("__cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    edge = F.min(F.when(F.col("__fits"), place)).over(everything)
    return w.withColumn("target", F.when(edge.isNotNull() & (place >= edge), level * F.col("weight")).otherwise(F.col("__cap").cast("double"))).select(
        "source", "source_size", "weight", "target"
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    budget_ratio: float = 1.5,
    max_epochs: int = 2,
    seed: int = 42,
    prefix: int = 3,
) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, taken (words, repeats counted), whole (repetitions) and part (words of the fractional one).

    The order within a source is the md5 of ``doc_id:seed``. Its first ``prefix`` hex digits split each source into
    16^prefix runs, so a source that holds a third of all rows is still sorted by thousands of tasks' worth of keys;
    the runs' totals are summed in advance, which gives each run the offset at which it starts.
    """
    docs, back = shielded(docs, _OWN)
    keep = [c for c in docs.columns if c not in {"size", "source_size", "target", "taken", "whole", "part"}]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], word_count().alias("size"), F.xxhash64("text").alias("__text"))
    rows = rows.withColumn("__key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")))
    rows = rows.withColumn("__run", F.substring("__key", 1, prefix))
    runs = rows.groupBy("source", "__run").agg(F.sum("size").alias("__run_size"))
    targets = source_targets(runs.groupBy("source").agg(F.sum("__run_size").alias("source_size")), weights, budget_ratio, max_epochs)
    upto = Window.partitionBy("source").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("__start", F.coalesce(F.sum("__run_size").over(upto), F.lit(0))).drop("__run_size")
    starts = starts.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "source_size", "target")
    joined = (
        rows.alias("a")
        .join(starts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.__run") == F.col("b.__run")))
        .select("a.*", "source_size", "target", "__start")
    )
    within = Window.partitionBy("source", "__run").orderBy("__key", F.col("doc_id").asc_nulls_last(), "size", "__text").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        joined.withColumn("whole", whole)
        .withColumn("__before", F.col("__start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("__rest", F.floor(F.col("target")).cast("long") - F.col("whole") * F.col("source_size") - F.col("__before"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest"))).cast("long"))
        .withColumn("taken", (F.col("whole") * F.col("size") + F.col("part")).cast("long"))
        .select(*[F.col(f"`{c}`") for c in keep], "size", "source_size", "target", "taken", "whole", "part")
        .withColumnsRenamed(back)
    )


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` with their share of the mix; only doc_id, source and the word count leave the scan."""
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':42') AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight, 2 * source_size AS cap FROM s
), f AS (
  SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget,
         CAST(coalesce(sum(cap) OVER b, 0) AS DOUBLE) AS capped,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS weights,
         row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS place
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), e AS (
  SELECT min(place) AS edge, arg_min((budget - capped) / weights, place) AS level FROM f WHERE (budget - capped) / weights * weight <= cap
), t AS (
  SELECT source, source_size, CASE WHEN place >= edge THEN level * weight ELSE CAST(cap AS DOUBLE) END AS target FROM f, e
), r AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS taken
FROM r
"""
