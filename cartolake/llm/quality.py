"""Quality rules: fixed limits, then robust multivariate outliers.

Statistics of whole texts are turned into a vector for each document. For each language and
source a minimum covariance determinant estimate is fitted by concentration steps: from a
start at medians, mean and covariance of the closest half, as long as the determinant falls.
Vectors far from it by Mahalanobis distance are rejected. Everything is DataFrame work;
quantiles of distances come from counts of distance classes, so that no group meets in one task.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement, count
from operator import mul

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolake.llm.common import WORD, saved, space_words, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a group that the estimate is made from, and the chi-square quantile (4 degrees) of it.
COVERAGE = 0.5
CHI2_COVERAGE = 3.357
#: Squared distance beyond which a vector is rejected: the chi-square quantile (4 degrees) of 0.999.
CUTOFF = 18.467
#: A step counts if it takes at least this share off a group's determinant; a group settles at the first that doesn't.
#: FLOOR keeps determinants above a fixed value, so every group settles.
LEAST_FALL = 0.001
#: Groups of fewer rows are judged with the other small groups of their language.
MIN_GROUP = 50
#: Classes of squared distances per power of two, for quantiles.
CLASSES = 32
#: Classes of a feature per unit, for medians.
MEDIAN_CLASSES = 2048
FEATURES = ("v_len", "v_sym", "v_line", "v_rep")
#: Added to the variances, so that a group of equal values doesn't reject the first that differs.
FLOOR = {"v_len": 0.0025, "v_sym": 0.0025, "v_line": 0.01, "v_rep": 0.01}
_BITS = 20
#: Columns of an estimate: means, and the Cholesky factor of the covariance.
_PARTS = [f"m_{f}" for f in FEATURES] + [f"c_{i}_{j}" for i in range(len(FEATURES)) for j in range(i + 1)]


def _repeat_words(words: str) -> tuple[dict[str, Column], Column]:
    """Columns to add one after another, and the number of words in 3-word windows found twice or more.

    Windows are sorted as 44 bits of hash and 20 bits of position; neighbours of equal bits are
    compared by their words. Where a hash misleads, or a text has 2**20 words, the windows
    themselves are sorted.
    """
    w = F.col(words)
    low = (1 << _BITS) - 1
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get(w, i)
    packed = F.transform(starts, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    p = F.col("_packed")
    pos = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    same = lambda x, y: F.shiftright(x, _BITS) == F.shiftright(y, _BITS)
    equal = lambda a, b: (at(a) == at(b)) & (at(a + 1) == at(b + 1)) & (at(a + 2) == at(b + 2))
    # each neighbour pair of equal bits: both positions, or -1 where the words differ
    pair = lambda x, j: F.when((j > 0) & same(x, F.get(p, j - 1)), F.when(equal(pos(x), pos(F.get(p, j - 1))), F.array(pos(F.get(p, j - 1)), pos(x))).otherwise(F.array(F.lit(-1), F.lit(-1)))).otherwise(F.array().cast("array<int>"))
    h = F.col("_hits")
    by_words = F.sort_array(F.transform(starts, lambda i: F.struct(at(i).alias("a"), at(i + 1).alias("b"), at(i + 2).alias("c"), i.alias("i"))))
    s = F.col("_slow")
    like = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    slow_hits = F.transform(F.filter(s, lambda x, j: F.coalesce(like(x, F.get(s, j - 1)), F.lit(False)) & (j > 0) | F.coalesce(like(x, F.get(s, j + 1)), F.lit(False))), lambda x: x["i"])
    misled = (F.size(w) >= low) | F.array_contains(h, -1)
    q = F.col("_at")
    columns = {
        "_packed": F.sort_array(packed),
        "_hits": F.flatten(F.filter(F.transform(p, pair), lambda x: F.size(x) > 0)),
        "_slow": F.when(misled, by_words),
        "_at": F.when(misled, F.sort_array(slow_hits)).otherwise(F.sort_array(F.array_distinct(h))),
    }
    gaps = F.transform(q, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(q, j + 1) - x, F.lit(3))))
    return columns, F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b)


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each whole text.

    A null or empty text has zeros throughout.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], text.alias("_text"), space_words(F.col(text_col)).alias("_words"))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD)))
    columns, n_repeat = _repeat_words("_words")
    for name, column in columns.items():
        out = out.withColumn(name, column)
    long = lambda c: c.cast("long")
    return out.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        long(F.size("_words")).alias("n_words"),
        long(F.length(F.array_join("_words", ""))).alias("word_chars"),
        long(F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]", ""))).alias("n_symbols"),
        long(F.size("_lines")).alias("n_lines"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
    )


def _vectors(stats: DataFrame) -> DataFrame:
    """Transformed statistics: logarithm of the mean word, square roots of shares."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "v_len": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
            "v_sym": F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 1.0)),
            "v_line": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5.0)),
            "v_rep": F.sqrt(F.col("n_repeat_words") / (n + 25)),
        }
    )


def _fit(rows: DataFrame, on: list[str]) -> DataFrame:
    """Mean and Cholesky factor of the covariance for each group, columns m_<f> and c_<i>_<j>, and _det, the determinant."""
    d = len(FEATURES)
    moments = [F.avg(f).alias(f"m_{f}") for f in FEATURES]
    moments += [F.covar_pop(FEATURES[j], FEATURES[i]).alias(f"s_{i}_{j}") for j, i in combinations_with_replacement(range(d), 2)]
    t = rows.groupBy(*on).agg(*moments)
    for i in range(d):
        for j in range(i + 1):
            value = F.col(f"s_{i}_{j}") + (FLOOR[FEATURES[i]] if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"c_{i}_{k}") * F.col(f"c_{j}_{k}")
            t = t.withColumn(f"c_{i}_{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"c_{j}_{j}"))
    root = reduce(mul, [F.col(f"c_{i}_{i}") for i in range(d)])
    return t.select(*on, *_PARTS, (root * root).alias("_det"))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds _d2, the squared Mahalanobis distance, by forward substitution."""
    solved: list[str] = []
    for i, f in enumerate(FEATURES):
        value = F.col(f) - F.col(f"m_{f}")
        for j, z in enumerate(solved):
            value = value - F.col(f"c_{i}_{j}") * F.col(z)
        rows = rows.withColumn(f"_z{i}", value / F.col(f"c_{i}_{i}"))
        solved.append(f"_z{i}")
    return rows.withColumn("_d2", sum((F.col(z) * F.col(z) for z in solved[1:]), F.col(solved[0]) * F.col(solved[0])))


def _reached(counts: DataFrame, on: list[str], share: float) -> DataFrame:
    """Of counts (on, _class, count): _limit, the least class up to which there is share of each group."""
    by_class = Window.partitionBy(*on).orderBy("_class")
    counts = counts.withColumn("_upto", F.sum("count").over(by_class)).withColumn("_all", F.sum("count").over(Window.partitionBy(*on)))
    return counts.filter(F.col("_upto") >= F.col("_all") * share).groupBy(*on).agg(F.min("_class").alias("_limit"))


def _limits(rows: DataFrame, on: list[str]) -> DataFrame:
    """_limit: the class of _d2 that COVERAGE of each group reaches, from counts of classes."""
    return _reached(rows.groupBy(*on, "_class").count(), on, COVERAGE)


def _medians(rows: DataFrame, on: list[str], values: dict[str, Column], prefix: str) -> DataFrame:
    """Columns prefix + name: the middle of the class, of 1 / MEDIAN_CLASSES width, that holds each group's median."""
    classes = F.array(*[F.struct(F.lit(k).alias("f"), F.floor(v * MEDIAN_CLASSES).alias("c")) for k, v in values.items()])
    counts = rows.select(*on, F.explode(classes).alias("x")).groupBy(*on, F.col("x.f").alias("_f"), F.col("x.c").alias("_class")).count()
    middle = (F.col("_limit") + 0.5) / MEDIAN_CLASSES
    return _reached(counts, [*on, "_f"], 0.5).groupBy(*on).agg(*[F.max(F.when(F.col("_f") == k, middle)).alias(prefix + k) for k in values])


def _classes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_class", F.floor(F.log2(F.greatest(F.col("_d2"), F.lit(1e-6))) * CLASSES).cast("int"))


def _estimates(vectors: DataFrame, on: list[str]) -> DataFrame:
    """Mean, Cholesky factor and scale of each group, after concentration steps until its determinant no longer falls by LEAST_FALL."""
    vectors = saved(vectors)
    # tables of one row a group are written before each join: of known size, they are broadcast and no row moves to the task of its group
    middle = saved(_medians(vectors, on, {f: F.col(f) for f in FEATURES}, "m_"))
    away = {f: F.abs(F.col(f) - F.col(f"m_{f}")) for f in FEATURES}
    spread = saved(_medians(vectors.join(middle, on), on, away, "a_")).join(middle, on)
    d = len(FEATURES)
    start = [(F.sqrt(F.pow(F.col(f"a_{FEATURES[i]}") * 1.4826, 2) + FLOOR[FEATURES[i]]) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)]
    # the start is no estimate from a half: the first step counts whatever its determinant
    moved = saved(spread.select(*on, *[f"m_{f}" for f in FEATURES], *start, F.lit(float("inf")).alias("_det")))
    steps = []
    for step in count():
        near = _classes(_distance(vectors.join(moved, on)))
        at = saved(moved.join(_limits(near, on), on).withColumn("_step", F.lit(step)))
        if step:
            steps.append(at)
        # groups that have settled are in no later table, and their rows leave the work
        half = _classes(_distance(vectors.join(at, on))).filter(F.col("_class") <= F.col("_limit"))
        before = at.select(*on, F.col("_det").alias("_before"))
        moved = saved(_fit(half.select(*on, *FEATURES), on).join(before, on).filter(F.col("_det") < F.col("_before") * (1 - LEAST_FALL)).drop("_before"))
        if moved.isEmpty():
            break
    if not steps:  # no rows
        steps = [at]
    last = F.max_by(F.struct(*_PARTS, "_limit"), "_step").alias("e")
    fitted = reduce(DataFrame.union, steps).groupBy(*on).agg(last).select(*on, "e.*")
    # half of a normal group lie within CHI2_COVERAGE; a tighter group isn't stretched
    scale = F.lit(CHI2_COVERAGE) / F.greatest(F.pow(F.lit(2.0), (F.col("_limit") + 1) / CLASSES), F.lit(CHI2_COVERAGE))
    return fitted.withColumn("_scale", scale).drop("_limit")


def _group(column: str) -> Column:
    """A name for each value; null has one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, cutoff: float = CUTOFF) -> DataFrame:
    """One row for each row of docs: id, statistics, base_failed, distance, kept; text_hash, g_lang and g_source tell rows of one id apart.

    base_failed: fewer than min_words words, or more than max_repeat_percent of the words in
    3-word windows found twice or more. Of the others, the method rejects those beyond cutoff.
    A null language or source is a group of its own. Repeated rows are judged each, alike.
    A null or empty text has no words and fails; a text of any length is judged whole. An empty
    table gives an empty result. Further columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"), _group(lang_col).alias("g_lang"), _group(source_col).alias("g_source"))
    stats = saved(statistics(rows, "text", ("id", "text_hash", "g_lang", "g_source")))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    vectors = _vectors(stats.withColumn("base_failed", failed))
    fine = vectors.filter(~F.col("base_failed"))
    sizes = fine.groupBy("g_lang", "g_source").agg(F.count("*").alias("_n"))
    groups = saved(sizes.select("g_lang", "g_source", F.when(F.col("_n") >= MIN_GROUP, F.col("g_source")).otherwise("small").alias("g_fit")))
    on = ["g_lang", "g_fit"]
    estimates = _estimates(fine.join(groups, ["g_lang", "g_source"]).select(*on, *FEATURES), on)
    judged = vectors.join(saved(groups.join(estimates, on).drop("g_fit")), ["g_lang", "g_source"], "left")
    judged = _distance(judged).withColumn("distance", F.when(~F.col("base_failed"), F.col("_d2") * F.col("_scale")))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False))
    return judged.select(F.col("id").alias(id_col), "text_hash", "g_lang", "g_source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that judge keeps, with all their columns."""
    bad = judge(docs, id_col, text_col, lang_col, source_col).filter(~F.col("kept"))
    bad = bad.select(F.col(id_col).alias("id"), "text_hash", "g_lang", "g_source").distinct()
    d, b = docs.alias("d"), bad.alias("b")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("b.id")) & (F.xxhash64(f"d.{text_col}") == F.col("b.text_hash"))
    return d.join(b, same & (_group(f"d.{lang_col}") == F.col("b.g_lang")) & (_group(f"d.{source_col}") == F.col("b.g_source")), "left_anti")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).drop("text_hash", "g_lang", "g_source", "distance")
