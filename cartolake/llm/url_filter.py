"""URL filters: rules by host and path, found with cascades of Bloom filters.

A cascade holds a list of keys exactly with respect to a universe: the first level encodes the
listed keys, the second those keys of the universe that the first takes wrongly, the third the
listed keys that the second takes wrongly, and so on until nothing is taken wrongly. The
universe is every key that any url of the corpus can ask for, so a url is judged without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.llm.common import ascii_lower, saved, table

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"
#: Bits of a whole cascade; it is sent to every executor, so a longer list is refused.
MAX_BITS = 1 << 29
MAX_LEVELS = 64


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h.astype(np.int64).view(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _positions(h1: np.ndarray, h2: np.ndarray, n_bits: int, n_hashes: int, salt: int) -> np.ndarray:
    """Bit positions by double hashing, one column for each hash; each level has its own salt, or the same keys would meet again."""
    a, b = _mixed(h1, salt), _mixed(h2, salt) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(n_hashes, dtype=np.uint64)) % np.uint64(n_bits)


@dataclass
class Level:
    bits: np.ndarray
    n_hashes: int
    salt: int

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = _positions(h1, h2, len(self.bits) * 8, self.n_hashes, self.salt)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


class Cascade:
    """Levels in order; a key is listed if the first level that hasn't it is an even one, counted from 1."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """For keys of the universe."""
        listed = np.full(len(h1), len(self.levels) % 2 == 1)
        open_ = np.ones(len(h1), dtype=bool)
        for i, level in enumerate(self.levels):
            rejected = open_.copy()
            rejected[open_] = ~level.has(h1[open_], h2[open_])
            listed[rejected] = i % 2 == 1
            open_ &= ~rejected
        return listed


def _level(keys: DataFrame, n: int, share: float, salt: int) -> Level:
    """A level over n keys that takes about share of other keys; partitions make their bits, and words of them are or-ed."""
    n_bits = max(64, int(math.ceil(n * math.log(1 / share) / math.log(2) ** 2 / 64)) * 64)
    if n_bits > MAX_BITS:
        raise ValueError(f"{n} listed keys need {n_bits} bits; split the list")
    n_hashes = max(1, round(n_bits / n * math.log(2)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_positions(b.column("h1").to_numpy(), b.column("h2").to_numpy(), n_bits, n_hashes, salt))
            word, start = np.unique(at >> np.uint64(5), return_index=True)
            bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), at & np.uint64(31)), start) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.astype(np.int64))], names=["word", "bits"])

    found = keys.select("h1", "h2").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(n_bits // 32, dtype="<u4")
    bits[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return Level(bits.view(np.uint8), n_hashes, salt)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(level.has(b.column("h1").to_numpy(), b.column("h2").to_numpy())))

    return keys.select("key", "h1", "h2").mapInArrow(keep, "key string, h1 long, h2 long")


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed and universe: (key, h1, h2). Keys in both are listed; neither needs to be distinct, or leave out the other."""
    cascade = Cascade()
    listed = saved(listed.select("key", "h1", "h2").distinct())
    n = listed.count()
    if not n:
        return cascade
    around = max(1, universe.agg(F.approx_count_distinct("h1")).first()[0])
    inside, outside = listed, universe.select("key", "h1", "h2")
    # the first level leaves about as many wrong keys as there are listed ones, later ones half
    share = min(0.5, max(n / around, 1e-9))
    while True:
        if len(cascade.levels) == MAX_LEVELS:
            raise ValueError("keys with equal hashes can't be told apart")
        level = _level(inside, n, share, len(cascade.levels))
        cascade.levels.append(level)
        outside = _passing(outside, level).distinct()
        if len(cascade.levels) == 1:
            outside = outside.join(listed.select("key"), "key", "left_anti")
        outside = saved(outside)
        n = outside.count()
        if not n:
            return cascade
        inside, outside, share = outside, inside, 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first :// to one of / ? # or the end, A-Z lower-cased; then to ? or # or the end. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix at a label with every path start of a rule's length, longest first."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    keys = F.flatten(F.transform(suffixes, lambda s: F.filter(F.array(*[F.concat(s, p) for p in starts]), lambda k: k.isNotNull())))
    sized = F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(sized), lambda s: s["k"]))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id, host, path, rule (host and path, or null), verdict.

    A rule fits its host and the hosts below it, if the path starts with the rule's; the longest
    wins. Urls that no rule fits, null ones too, get the default; an empty table gives an empty
    result, and further columns are left out. Every row is judged by itself,
    so repeated rows are no matter. Rule paths must start with / (an empty path fits no rule).
    """
    spark = pages.sparkSession
    if any(not p.startswith("/") for _, p, _ in rules):
        raise ValueError("the path of a rule starts with /")
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), sorted({len(p) for _, p, _ in rules})))
    universe = rows.select(F.explode("keys").alias("key")).distinct().select("key", *hashed(F.col("key")))
    listed = spark.createDataFrame([(h + p, v) for h, p, v in rules], "key string, verdict string").select("key", "verdict", *hashed(F.col("key")))
    universe = saved(universe)
    any_rule = build_cascade(listed, universe)
    blocks = build_cascade(listed.filter("verdict = 'block'"), universe.unionByName(listed.select("key", "h1", "h2")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("keys")
            offsets = keys.offsets.to_numpy()
            span = slice(offsets[0], offsets[-1])
            h1, h2 = (b.column(c).values.to_numpy()[span] for c in ("h1", "h2"))
            hit = np.flatnonzero(any_rule.has(h1, h2)) + offsets[0]
            place = np.searchsorted(hit, offsets[:-1])
            first = np.append(hit, np.iinfo(np.int64).max)[place]
            found = first < offsets[1:]
            at = np.where(found, first, 0)
            blocked = blocks.has(h1, h2)
            rule = keys.values.take(pa.array(at, mask=~found))
            verdict = [("block" if blocked[i - offsets[0]] else "allow") if ok else default for i, ok in zip(at, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), b.column("path"), rule, pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    ready = rows.withColumns({"h1": F.transform("keys", lambda k: F.xxhash64(k)), "h2": F.transform("keys", lambda k: F.xxhash64(F.lit("second"), k))})
    return ready.mapInArrow(judge, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rh, rp, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT page_id, host, path, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS i
  FROM p LEFT JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE i = 1
"""
