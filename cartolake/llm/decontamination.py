"""Benchmark decontamination: which words of a document lie in a passage of a benchmark item.

A prefix-filtered set join at full containment. The words of each item window are ordered by
rarity in the corpus; for containment of all words the necessary prefix is the rarest one, so
only document positions with that word are candidates. Length and position bounds drop those
where the window would stand out of the text, and the exact words decide. DataFrame work only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.llm.common import alnum_words, saved, table

WINDOW = 10
#: Item windows are broadcast up to this many; beyond it they are joined by a shuffle.
BROADCAST_WINDOWS = 200_000


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows (win, items): window words of an item, or all of one with fewer; items: their ids, null ids left out."""
    words = benchmark.select(F.col(id_col).alias("item"), alnum_words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    rows = words.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(window)).alias("win"))
    return rows.groupBy("win").agg(F.collect_set("item").alias("items"))


def _with_rarest(windows: DataFrame, docs_words: DataFrame, small: bool) -> DataFrame:
    """Adds the word of each window that the corpus has least, and where it first stands in the window."""
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    counts = docs_words.select(F.explode("w").alias("word")).join(F.broadcast(vocabulary) if small else vocabulary, "word").groupBy("word").count()
    # one row for each word of the windows, written so that a small table is broadcast: a common word's windows don't meet in one task
    rows = windows.select("win", "items", F.posexplode("win").alias("off", "word")).join(saved(counts), "word", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "off")).alias("r")
    return rows.groupBy("win").agg(rarest, F.first("items").alias("items")).select("win", "items", F.col("r.word").alias("word"), F.col("r.off").alias("off"), F.col("r.n").alias("n"))


def find_windows(docs: DataFrame, windows: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Occurrences (id, text_hash, start, n, items) of the windows in docs (id, text_hash, text)."""
    small = windows.count() <= broadcast_windows
    words = docs.select("id", "text_hash", alnum_words(F.col("text")).alias("w"))
    keyed = _with_rarest(windows, words, small).filter(F.col("n") > 0).select("win", "items", "word", "off")
    exploded = words.select("id", "text_hash", "w", F.posexplode("w").alias("pos", "word"))
    start = F.col("pos") - F.col("off")
    n = F.size("win")
    if small:
        found = exploded.join(F.broadcast(keyed), "word").filter((start >= 0) & (start + n <= F.size("w")))
        found = found.filter(F.slice("w", start + 1, n) == F.col("win"))
    else:
        reach = window - 1
        first = F.greatest(F.col("pos") - reach, F.lit(0))
        around = exploded.select("id", "text_hash", "pos", "word", first.alias("first"), F.slice("w", first + 1, F.lit(2 * reach + 1)).alias("near"))
        found = around.join(keyed, "word").filter((start >= F.col("first")) & (start - F.col("first") + n <= F.size("near")))
        found = found.filter(F.slice("near", start - F.col("first") + 1, n) == F.col("win"))
    return found.select("id", "text_hash", start.alias("start"), n.alias("n"), "items")


def _covered(spans: Column) -> Column:
    """Words under sorted, overlapping spans (start, n)."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("upto"))

    def step(a: Column, s: Column) -> Column:
        end = s["start"] + s["n"]
        return F.struct((a["sum"] + F.greatest(F.lit(0), end - F.greatest(s["start"], a["upto"]))).alias("sum"), F.greatest(end, a["upto"]).alias("upto"))

    return F.aggregate(spans, zero, step, lambda a: a["sum"].cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, text_hash, n_words, n_hit, item_ids (sorted strings), spans.

    A word is hit inside any occurrence of a window. Null texts have no words; null or empty
    items have no windows; a null item id hits without being named. Rows that repeat an id are
    told apart by their text and judged each. Empty tables on either side give no hits. Texts are
    worked whole, whatever their length; further columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    windows = item_windows(benchmark, window, item_col, item_text_col)
    found = find_windows(rows, windows, window)
    hits = found.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids"))
    counted = rows.select("id", "text_hash", F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.alias("a").join(hits.alias("b"), F.expr("a.id <=> b.id AND a.text_hash = b.text_hash"), "left")
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return out.select(
        F.col("a.id").alias(id_col),
        F.col("a.text_hash").alias("text_hash"),
        "n_words",
        F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(ids, F.array().cast("array<string>")).alias("item_ids"),
        "spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without any word in a benchmark passage, with all their columns."""
    bad = decontaminate(docs, benchmark, window, id_col, text_col).filter("n_hit > 0")
    bad = bad.select(F.col(id_col).alias("id"), "text_hash").distinct()
    d, b = docs.alias("d"), bad.alias("b")
    return d.join(b, F.col(f"d.{id_col}").eqNullSafe(F.col("b.id")) & (F.xxhash64(f"d.{text_col}") == F.col("b.text_hash")), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH dw AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT item_id, array_to_string(list_slice(w, pos, pos + 9), ' ') AS k, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM bw WHERE len(w) > 0)
), ns AS (SELECT DISTINCT n FROM win), dp AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM dw
), hit AS (
  SELECT dp.doc_id, dp.pos, win.n, win.item_id
  FROM dp JOIN ns ON dp.pos + ns.n - 1 <= len(dp.w)
  JOIN win ON win.n = ns.n AND win.k = array_to_string(list_slice(dp.w, dp.pos, dp.pos + ns.n - 1), ' ')
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
