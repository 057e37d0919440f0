"""Mixing sources to target weights, cut at each source's budget.

Every row gets a hash-random key. Within its source the keys are split into ranges; sums of
the ranges give distributed prefix sums, and each source is cut where the prefix sum meets
its budget. A budget over the source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolake.llm.common import WORD, saved, table

#: Rows of one key range of a source: the largest group that a task sorts.
ROWS_PER_RANGE = 4096
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes: (source_key, no_source, source_size, n_rows), one row a source; adds weight and target.

    Sources in code point order, null last, take the weights in turn. All targets together are
    the sum of sizes; a target stops at max_epochs times its source, and what is over goes to
    the others by weight. That is a water level: the sources in order of cap over weight fill up
    first. The table has one row a source, so a window over it is small.
    """
    everything = Window.partitionBy()
    by_name = everything.orderBy("no_source", "source_key")
    cyclic = F.lit(0)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    for i, w in enumerate(weights):
        cyclic = F.when(F.col("turn") == i, F.lit(w)).otherwise(cyclic)
    t = sizes.withColumn("turn", turn).withColumn("weight", cyclic.cast("double"))
    t = t.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    by_level = everything.orderBy(F.col("cap") / F.col("weight"), "no_source", "source_key")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum(F.col("source_size")).over(everything).cast("double"))
    t = t.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("weight_rest", F.sum("weight").over(rest))
    t = t.withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_rest"))
    # the first source whose cap is above the level ends the filling; its level holds for all after it
    t = t.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    t = t.withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return t.withColumn("target", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.col("final") * F.col("weight"))).select("source_key", "no_source", "source_size", "n_rows", "weight", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED) -> DataFrame:
    """One row for each row of docs: id, text_hash, size, source_size, target, copies (how often the mix takes the row).

    A row is in the part epoch if at least half of it lies before the cut, so a source misses its
    target by half a row at most. Null or empty texts have size 0; a source of size 0 has target
    0 and its rows no copies. A null source is a source of its own, last in order. Repeated rows
    are rows of their own; which of several equal rows lies before the cut cannot be told apart.
    Keys depend on the seed and the id, on the text where the id is null, so reruns agree. An empty table gives an empty result.
    """
    on = ["src", "no_src"]
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.md5(F.encode(text_col, "UTF-8")), F.lit(""))))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), word_count(F.col(text_col)).alias("size"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), F.col(source_col).isNull().alias("no_src"), key.alias("key"))
    keyed = saved(keyed)
    sizes = keyed.groupBy(*on).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = source_targets(sizes.withColumnsRenamed({"src": "source_key", "no_src": "no_source"}), max_epochs, weights)
    targets = targets.select(F.col("source_key").alias("src"), F.col("no_source").alias("no_src"), "source_size", "target", F.ceil(F.col("n_rows") / ROWS_PER_RANGE).cast("long").alias("ranges"))
    # written, so Spark knows the size: a small table is broadcast and no row moves to the task of its source
    rows = keyed.join(saved(targets), on)
    # hash keys are even, so equal steps of the first 32 bits are ranges of about equal size
    rows = rows.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges"), 32))
    sums = rows.groupBy(*on, "range").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy(*on).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*on, "range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    rows = rows.join(saved(sums), [*on, "range"])
    within = Window.partitionBy(*on, "range").orderBy("key", "id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    epochs = F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))
    part = F.col("target") - epochs * F.col("source_size")
    more = F.when((epochs < max_epochs) & (F.col("start") + F.col("size") / F.lit(2.0) < part), 1).otherwise(0)
    copies = F.when(F.col("source_size") > 0, epochs + more).otherwise(0).cast("int")
    return rows.select(F.col("id").alias(id_col), "text_hash", "src", "no_src", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix takes it, with all their columns."""
    taken = mix(docs, id_col, text_col, source_col, max_epochs, weights, seed).withColumnRenamed(id_col, "m_id")
    taken = taken.groupBy("m_id", "text_hash", "src", "no_src").agg(F.array_sort(F.collect_list("copies")).alias("copies")).alias("m")
    # equal rows are numbered, and share out what their copies are
    # rows travel in one column, so no name of theirs meets a helper's
    d = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), F.col(source_col).isNull().alias("no"))
    d = d.withColumn("i", F.row_number().over(Window.partitionBy("id", "hash", "src", "no").orderBy(F.lit(0)))).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("m.m_id")) & (F.col("d.hash") == F.col("m.text_hash")) & (F.col("d.src") == F.col("m.src")) & (F.col("d.no") == F.col("m.no_src"))
    n = F.get(F.col("m.copies"), F.col("d.i") - 1)
    out = d.join(taken, same).filter(n > 0)
    return out.select("d.row", F.explode(F.sequence(F.lit(1), n)).alias("copy")).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS no_src, md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS k,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents
), s AS (
  SELECT src, no_src, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY no_src, src) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY src, no_src
), c AS (
  SELECT *, source_size::DOUBLE * 3 AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, no_src, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, no_src, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c
), o AS (
  SELECT *, min(CASE WHEN level * w <= cap THEN row_number END) OVER () AS first_open
  FROM (SELECT *, row_number() OVER (ORDER BY cap / w, no_src, src) AS row_number FROM l)
), t AS (
  SELECT o.src, o.no_src, o.source_size,
         CASE WHEN o.first_open IS NULL OR o.row_number < o.first_open THEN o.cap ELSE f.level * o.w END AS target
  FROM o LEFT JOIN o AS f ON f.row_number = o.first_open
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, least(3, floor(t.target / nullif(t.source_size, 0))) AS e,
         coalesce(sum(d.size) OVER (PARTITION BY d.src, d.no_src ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.src = t.src AND d.no_src = t.no_src
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE (e + CASE WHEN e < 3 AND start + size / 2.0 < target - e * source_size THEN 1 ELSE 0 END) * size END)::BIGINT AS taken
FROM p
"""
