"""Spelling variants: words one edit apart, each led to the more frequent form it stems from.

Pairs are found by an even-partition pigeonhole join. One edit leaves one of two halves of the
shorter word as it is, so each word is indexed by both halves, and words of the same length or of
one code point more are probed at the places where such a half then stands. Halves that many
words share are split again around the edit, until few words share what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.llm.common import ascii_lower, saved, table

MIN_LENGTH = 5
MIN_COUNT = 3
#: One of so many occurrences (by checksum) loses a code point.
SLIP = 97
#: A form is so many times as frequent as its variant at least.
RATIO = 2
NO_LETTERS = r"[^A-Za-zÀ-ÿ]+"
#: Keys with more pairs than this are split again; results don't depend on it.
SPLIT_PAIRS = 2_000


def slipped_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, those whose checksum slip divides without one code point.

    The checksum is the crc32 of `<id>:<run>`, and its remainder by the run's length is the place
    of the code point. A null id is the empty text there. Words have min_length code points and
    min_count occurrences at least. Null and empty texts have none.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), NO_LETTERS, -1)).alias("run"))
    runs = runs.filter(F.length("run") >= min_length).select("id", ascii_lower(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % slip == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") >= min_count) & (F.length("word") >= min_length))


def _keyed(entries: DataFrame) -> DataFrame:
    """Adds a hash of what stands around the open span lo..hi; in longer words the span is one code point longer."""
    rest = F.expr("substring(word, hi + 1 + cast(longer as int))")
    return entries.withColumn("key", F.xxhash64("size", "lo", "hi", F.expr("substring(word, 1, lo)"), rest))


def _halves(lo: Column, hi: Column) -> Column:
    """The two even parts of a span: the edit is in one of them."""
    middle = F.floor((lo + hi) / 2).cast("int")
    return F.inline(F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), hi.alias("hi"))))


def near_pairs(words: DataFrame, split_pairs: int = SPLIT_PAIRS) -> DataFrame:
    """(a, na, b, nb): all pairs of distinct words (word, n) that one inserted, deleted or replaced code point tells apart, each once.

    A word is shorter than its partner or, at one length, smaller. Null words pair with none.
    """
    own = words.filter("length(word) > 1").select("word", "n", F.length("word").alias("size"), F.lit(False).alias("longer"))
    longer = words.filter("length(word) > 2").select("word", "n", (F.length("word") - 1).alias("size"), F.lit(True).alias("longer"))
    both = own.unionByName(longer)
    entries = saved(_keyed(both.select("word", "n", "size", "longer", _halves(F.lit(0), F.col("size")))))
    found = None
    while True:
        counts = entries.groupBy("key").agg(F.count(F.when(~F.col("longer"), 1)).alias("own"), F.count(F.when(F.col("longer"), 1)).alias("longer"), F.max(F.col("hi") - F.col("lo")).alias("span"))
        # written, so Spark knows the size: a short list is broadcast, so a key's rows don't meet in one task
        crowded = saved(counts.filter((F.col("own") * (F.col("own") + F.col("longer")) > split_pairs) & (F.col("span") > 1)).select("key"))
        few = entries.join(crowded, "key", "left_anti")
        a = few.filter(~F.col("longer")).select("key", F.col("word").alias("a"), F.col("n").alias("na"))
        b = few.select("key", F.col("word").alias("b"), F.col("n").alias("nb"), "longer")
        pairs = a.join(b, "key").filter((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        pairs = pairs.select("a", "na", "b", "nb")
        found = pairs if found is None else found.unionByName(pairs)
        split = entries.join(crowded, "key", "left_semi").select("word", "n", "size", "longer", _halves(F.col("lo"), F.col("hi")))
        entries = saved(_keyed(split))
        if not entries.limit(1).count():
            return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) without circles: each word's last form, by jumps that double."""
    at = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        after = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(at.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of slipped_words.

    form: the near word of largest n, ties to the smallest by code points, if that n is ratio times
    the word's at least; root: the last word on the way over forms, or the word. Repeated rows count
    again; null and empty texts and an empty table give no words; further columns are not read.
    """
    words = saved(slipped_words(docs, id_col, text_col, min_length, min_count, slip))
    pairs = saved(near_pairs(words))
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    around = pairs.select(F.inline(sides)).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    leads = -F.col("best.less") >= ratio * F.col("n")
    linked = saved(around.select("word", "n_near", F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")))
    ends = roots(linked.filter("form IS NOT NULL").select("word", "form"))
    out = words.join(linked, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS m
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL
), bytes AS (
  SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, (unicode(c) - 64)::BIGINT] END)) AS bs
  FROM runs
), hashed AS (
  SELECT run, m, xor(list_reduce(list_concat([4294967295::BIGINT], bs),
           lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, tab
), words AS (
  SELECT word, sum(m)::BIGINT AS n
  FROM (SELECT m, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3
), gone AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gone a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near
  FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1
), linked AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), walk AS (
  SELECT word, word AS at FROM linked
  UNION ALL SELECT walk.word, linked.form FROM walk JOIN linked ON linked.word = walk.at WHERE linked.form IS NOT NULL
), ends AS (
  SELECT walk.word, walk.at AS root FROM walk JOIN linked ON linked.word = walk.at WHERE linked.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM linked JOIN ends USING (word)
"""
