"""Phrase collocations: words that stand together more often than their counts let expect.

Blocks of documents become numbers of words, zeros between pieces. Level by level, a block sends its
distinct n-grams once with their counts to the buckets of their hashes; a bucket sums them, numbers
those that are frequent and answers each block in its own order. An n-gram is told by the numbers of
its two parts of a word less, so from the second level on only numbers travel, and only where both
parts are frequent. Texts come back by joins over the frequent n-grams. Counts of a phrase's parts
come to it by shuffled lookup requests.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolake.llm.blocks import mixed, n_buckets, text_bytes
from cartolake.llm.common import saved, table

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
NO_LANG = "und"
BREAK = b".,;:!?\n\x0b\x0c\r"
BLANK = b" \t"
#: Bytes of text in a block: the unit that a task holds at once.
BLOCK_BYTES = 6 << 20
#: Bytes of packed sequences whose pairs a bucket counts.
BUCKET_BYTES = 8 << 20

#: A block: its text as places of words from 1, 0 between pieces; its languages and how many words of each it has; its distinct words in the order of their hashes, a line feed between, and the place of each one's language.
BLOCKS = "block long, seq binary, langs array<string>, sizes array<long>, words binary, tongue binary"
#: Messages of blocks to buckets: words with languages, or n-grams as numbers, and how often the block has each.
WORDS = "bucket int, block long, langs array<string>, asked binary, tongue binary, w binary"
PAIRS = "bucket int, block long, asked binary, w binary"
#: Of a bucket: to each block the numbers of what it asked for, 0 if rare; without a block one frequent n-gram.
ANSWERS = "block long, bucket int, ids binary, id long, lang string, phrase string, a long, b long, f long"
_ANSWER_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary()), ("id", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("f", pa.int64())])
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("seq", pa.binary()), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("tongue", pa.binary())])
_WORD_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("langs", pa.list_(pa.string())), ("asked", pa.binary()), ("tongue", pa.binary()), ("w", pa.binary())])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(BLANK)], _KIND[list(BREAK)] = 1, 2


def _packed(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little") * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), dtype=kind)


def _plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _text(words: list[str]) -> bytes:
    """Words as one text, a line feed between; no word has one."""
    return _packed(np.frombuffer("\n".join(words).encode(), np.uint8))


def _words(data: bytes) -> list[str]:
    return _unpacked(data, np.uint8).tobytes().decode().split("\n")


def _hashes(words: list[str], tongue: np.ndarray, langs: list[str]) -> np.ndarray:
    """32 bits of each word and its language."""
    seeds = [zlib.crc32(x.encode()) for x in langs]
    out = [zlib.crc32(w.encode(), seeds[t]) for w, t in zip(words, tongue.tolist(), strict=True)]
    return mixed(np.array(out, dtype=np.uint64)) >> np.uint64(32)


def _bounds(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin, and the end."""
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(columns[0])]]) if len(columns[0]) else np.zeros(1, np.int64)


def _block(rows: pa.Table, number: int) -> pa.RecordBatch | None:
    """A block of documents (lang, text)."""
    flat, offsets = text_bytes(rows.column("text"))
    kind = _KIND[flat]
    word = kind == 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = word[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return None
    # only bytes of words are left, so a word ends where the next one begins
    places = np.cumsum(word, dtype=np.int32)
    ends = np.append(places[starts] - 1, places[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[flat[word]])]).dictionary_encode()
    code, size = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
    tongues = _plain(rows.column("lang")).dictionary_encode()
    own = np.searchsorted(starts, offsets)
    tongue = np.repeat(tongues.indices.to_numpy(zero_copy_only=False), np.diff(own))
    breaks = np.cumsum(kind == 2, dtype=np.int32)[starts]
    new = np.append(True, breaks[1:] != breaks[:-1])
    new[own[:-1][np.diff(own) > 0]] = True
    code += tongue.astype(np.int64) * size
    if len(tongues.dictionary) * size <= 16 * len(code) + (1 << 16):
        seen = np.bincount(code, minlength=len(tongues.dictionary) * size) > 0
        distinct, code = np.flatnonzero(seen), (np.cumsum(seen) - 1)[code]
    else:
        distinct, code = np.unique(code, return_inverse=True)
    _, own_tongue = np.unique(distinct // size, return_inverse=True)
    langs = tongues.dictionary.take(pa.array(np.unique(distinct // size))).to_pylist()
    names = words.dictionary.take(pa.array(distinct % size)).to_pylist()
    # in the order of their hashes, so that buckets answer in the order of the words
    order = np.argsort(_hashes(names, own_tongue, langs), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    seq = np.zeros(len(code) + int(new.sum()), np.uint32)
    seq[np.arange(len(code)) + np.cumsum(new)] = rank[code] + 1
    sizes = np.bincount(tongue, minlength=len(tongues.dictionary))
    row = {"block": number, "seq": _packed(seq), "langs": langs, "sizes": sizes[sizes > 0].tolist(), "words": _text([names[i] for i in order]), "tongue": _packed(own_tongue[order].astype(np.uint32))}
    return pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one task, in their order, in blocks of BLOCK_BYTES."""
    held, before, block = [], 0, 0
    first = TaskContext.get().partitionId() << 32

    def done() -> Iterator[pa.RecordBatch]:
        out = _block(pa.Table.from_batches(held), first + block) if held else None
        if out is not None:
            yield out

    for b in batches:
        if not b.num_rows:
            continue
        ends = before + np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        before, numbers = int(ends[-1]), ends // BLOCK_BYTES
        bounds = _bounds(numbers)
        for x, y in zip(bounds, bounds[1:], strict=False):
            if numbers[x] != block:
                yield from done()
                held, block = [], int(numbers[x])
            held.append(b.slice(x, y - x))
    yield from done()


def tokens(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The words of documents in blocks, written (BLOCKS). Documents that few tasks would read are dealt first."""
    spark = docs.sparkSession
    rows = docs.filter(F.octet_length(text_col) > 0).select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    shares = docs.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    cores = spark.sparkContext.defaultParallelism
    if shares["most"] and shares["most"] * cores > 2 * shares["all"]:
        deal = rows.withColumn("_at", F.monotonically_increasing_id()).repartition(max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), "_at")
        rows = deal.drop("_at")
    return saved(rows.mapInArrow(_blocks, BLOCKS))


def _word_requests(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                words, tongue = _words(row["words"]), _unpacked(row["tongue"], np.uint32)
                weight = np.bincount(_unpacked(row["seq"], np.uint32), minlength=len(words) + 1)[1:]
                to = ((_hashes(words, tongue, row["langs"]) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                heads = _bounds(to)
                spans = [slice(x, y) for x, y in zip(heads, heads[1:], strict=False)]
                out = [{"bucket": int(to[x.start]), "block": row["block"], "langs": row["langs"], "asked": _text(words[x]), "tongue": _packed(tongue[x]), "w": _packed(weight[x].astype(np.int64))} for x in spans]
                yield pa.RecordBatch.from_pylist(out, schema=_WORD_SCHEMA)

    return run


def _answers(t: pa.Table, sizes: list[int], which: np.ndarray, f: np.ndarray, min_count: int, buckets: int, **told: pa.Array) -> Iterator[pa.RecordBatch]:
    """What a bucket says of its n-grams with counts f; which are those asked for, message by message; told are columns of the n-grams."""
    good = np.flatnonzero(f >= min_count)
    bucket = t.column("bucket")[0].as_py()
    ids = np.zeros(len(f), np.uint32)
    numbers = np.arange(len(good), dtype=np.int64) * buckets + bucket + 1
    if len(good) and numbers[-1] >= 1 << 32:
        raise ValueError("more frequent phrases than numbers")
    ids[good] = numbers
    rest = {"id": pa.array(numbers), "f": pa.array(f[good], pa.int64())} | {k: v.take(pa.array(good)) for k, v in told.items()}
    yield from pa.Table.from_arrays([rest[n] if n in rest else pa.nulls(len(good), kind) for n, kind in zip(_ANSWER_SCHEMA.names, _ANSWER_SCHEMA.types, strict=True)], schema=_ANSWER_SCHEMA).to_batches(1 << 16)
    ends = np.cumsum(sizes)
    for at in range(0, len(sizes), 64):
        some = slice(at, at + 64)
        packed = [_packed(ids[which[e - n : e]]) for n, e in zip(sizes[some], ends[some], strict=True)]
        rest = {"block": _plain(t.column("block").slice(at, 64)), "bucket": _plain(t.column("bucket").slice(at, 64)), "ids": pa.array(packed, pa.binary())}
        yield pa.RecordBatch.from_arrays([rest[n] if n in rest else pa.nulls(len(packed), kind) for n, kind in zip(_ANSWER_SCHEMA.names, _ANSWER_SCHEMA.types, strict=True)], schema=_ANSWER_SCHEMA)


def _counted_words(min_count: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        w = [_unpacked(x.as_py(), np.int64) for x in t.column("w")]
        langs: dict[str, int] = {}
        of = [np.array([langs.setdefault(x, len(langs)) for x in told.as_py()])[_unpacked(y.as_py(), np.uint32)] for told, y in zip(t.column("langs"), t.column("tongue"), strict=True)]
        names = pc.split_pattern(pa.array([_unpacked(x.as_py(), np.uint8).tobytes().decode() for x in t.column("asked")]), "\n").flatten().dictionary_encode()
        size = len(names.dictionary)
        keys, which = np.unique(np.concatenate(of) * size + names.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        f = np.bincount(which, weights=np.concatenate(w), minlength=len(keys)).astype(np.int64)
        yield from _answers(t, [len(x) for x in w], which, f, min_count, buckets, lang=pa.array(list(langs)).take(pa.array(keys // size)), phrase=names.dictionary.take(pa.array(keys % size)))

    return run


def _pairs(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two frequent n-grams begin one after another, and both as one number: the n-grams of a word more."""
    at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
    return at, seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1].astype(np.uint64)


def _pair_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted keys by bucket and key, and their buckets in it."""
    to = (mixed(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return order, to[order]


def _pair_requests(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, weight = np.unique(_pairs(_unpacked(b.column("seq")[i].as_py(), np.uint32))[1], return_counts=True)
                order, to = _pair_buckets(keys, buckets)
                keys, weight, heads = keys[order], weight[order].astype(np.uint32), _bounds(to)
                spans = list(zip(heads, heads[1:], strict=False))
                # sorted keys as differences, which are short
                asked = [_packed(np.diff(keys[x:y], prepend=np.uint64(0))) for x, y in spans]
                w = [_packed(weight[x:y]) for x, y in spans]
                yield pa.RecordBatch.from_arrays([pa.array(to[heads[:-1]], pa.int32()), pa.array(np.full(len(w), b.column("block")[i].as_py())), pa.array(asked, pa.binary()), pa.array(w, pa.binary())], names=["bucket", "block", "asked", "w"])

    return run


def _counted_pairs(min_count: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        w = [_unpacked(x.as_py(), np.uint32) for x in t.column("w")]
        keys, which = np.unique(np.concatenate([np.cumsum(_unpacked(x.as_py(), np.uint64)) for x in t.column("asked")]), return_inverse=True)
        f = np.bincount(which, weights=np.concatenate(w), minlength=len(keys)).astype(np.int64)
        yield from _answers(t, [len(x) for x in w], which, f, min_count, buckets, a=pa.array((keys >> np.uint64(32)).astype(np.int64)), b=pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)))

    return run


def _told(answers: pa.Table) -> np.ndarray:
    """The answers to a block, by bucket."""
    ids = answers.column("ids")
    parts = [_unpacked(ids[int(i)].as_py(), np.uint32) for i in np.argsort(answers.column("bucket").to_numpy())]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _next(seq: np.ndarray) -> np.ndarray:
    """The sequence with zeros where an n-gram has no neighbour, and one zero between the others."""
    on = np.concatenate([[False], seq > 0, [False]])
    on[1:-1] &= on[:-2] | on[2:]
    keep = on[1:-1] | on[:-2]
    return np.where(on[1:-1], seq, 0)[keep].astype(np.uint32)


def _renumbered(words: bool, buckets: int) -> Callable:
    """A block's sequence with the numbers of its frequent n-grams in place of words, or of pairs of shorter ones."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for i in range(rows.num_rows):
            seq = _unpacked(rows.column("seq")[i].as_py(), np.uint32)
            if words:
                seq = np.append(np.uint32(0), _told(answers))[seq]
            else:
                at, keys = _pairs(seq)
                keys, which = np.unique(keys, return_inverse=True)
                ids = np.zeros(len(keys), np.uint32)
                ids[_pair_buckets(keys, buckets)[0]] = _told(answers)
                seq = np.zeros(len(seq), np.uint32)
                seq[at] = ids[which]
            out.append(_packed(_next(seq)))
        return pa.table({"block": rows.column("block"), "seq": pa.array(out, pa.binary())})

    return run


def frequent_phrases(blocks: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, words, f) for every phrase of 1 to max_words words that occurs min_count times within pieces of tokens(docs).

    Parts of a phrase are as frequent as it at least, so no such phrase is lost. Words have a quarter as many
    buckets as blocks, pairs one for BUCKET_BYTES of what the level before has left; both as many as shuffle
    partitions if those are more. A block sends each bucket one message at most.
    """
    least = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels, rows = [], blocks
    for n in range(1, max_words + 1):
        wanted = n_buckets(blocks.count()) if n == 1 else (rows.agg(F.sum(F.octet_length("seq"))).first()[0] or 0) // BUCKET_BYTES
        buckets = max(int(wanted), least)
        asked = rows.mapInArrow(_word_requests(buckets), WORDS) if n == 1 else rows.mapInArrow(_pair_requests(buckets), PAIRS)
        counted = (_counted_words if n == 1 else _counted_pairs)(min_count, buckets)
        answers = saved(asked.repartitionById(buckets, F.col("bucket")).mapInArrow(counted, ANSWERS))
        found = answers.filter("block IS NULL")
        if n == 1:
            level = found.select("id", "lang", "phrase", "f")
        else:
            first, second = (levels[-1].select(F.col("id").alias(k), "lang", F.col("phrase").alias(f"_{k}")) for k in "ab")
            level = found.select("id", "a", "b", "f").join(first, "a").join(second.drop("lang"), "b")
            level = level.select("id", "lang", F.concat_ws(" ", "_a", F.substring_index("_b", " ", -1)).alias("phrase"), "f")
        levels.append(saved(level))
        if n < max_words:
            told = answers.filter("block IS NOT NULL").select("block", "bucket", "ids")
            rows = saved(rows.select("block", "seq").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_renumbered(n == 1, buckets), "block long, seq binary"))
    out = None
    for n, level in enumerate(levels, 1):
        level = level.select("lang", "phrase", F.lit(n).alias("words"), "f")
        out = level if out is None else out.unionByName(level)
    return out


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the collocations of each language, best first.

    Texts are lower-cased (A-Z), split at BREAK into pieces and at blanks and tabs into words. Phrases
    have 2 to max_words words and at least min_count occurrences (a) within pieces; l and r are the
    counts of the parts at the cut of least floor(1000 * a * n / (l * r)), the first such cut, n all
    words of the language. Phrases inside a longer one of as many occurrences are left out. A null
    language is NO_LANG and one with it; null and empty texts have no words; repeated rows count
    again; an empty table gives no rows; further columns are not read. top = None keeps all.
    """
    blocks = tokens(docs, text_col, lang_col)
    totals = blocks.select(F.inline(F.arrays_zip(F.col("langs").alias("lang"), F.col("sizes").alias("size")))).groupBy("lang").agg(F.sum("size").alias("n"))
    counts = frequent_phrases(blocks, max_words, min_count)
    found = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    # each cut asks for the counts of its two parts, where those are
    asked = found.select("lang", "phrase", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "words")
    sides = F.array(F.struct(F.lit(True).alias("left"), F.expr("substring_index(phrase, ' ', k)").alias("part")), F.struct(F.lit(False).alias("left"), F.expr("substring_index(phrase, ' ', k - words)").alias("part")))
    asked = asked.select("lang", "phrase", "k", F.inline(sides))
    told = asked.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    cuts = told.groupBy("lang", "phrase", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    # a longer phrase around this one in as many places has one of one word more in it that is so too
    around = found.filter("words > 2").select("lang", F.col("a").alias("over"), F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    kept = found.join(around, ["lang", "phrase"], "left").filter("over IS NULL OR 100 * over < 100 * a").join(totals, "lang")
    scored = kept.join(cuts, ["lang", "phrase"]).withColumn("score", F.expr("(cast(1000 * cast(a as decimal(20, 0)) as decimal(24, 0)) * cast(n as decimal(14, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b")).select("lang", "phrase", "b.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH parts AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(part, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM parts
), grams AS (
  SELECT lang, n, list_aggregate(ws[i : i + n - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT lang, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS n))
), counts AS (
  SELECT lang, n AS words, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang
), found AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE words > 1 AND f >= 100
), inner_phrases AS (
  SELECT lang, a AS over, unnest(flatten(list_transform(range(2, words), lambda k:
           list_transform(range(1, words - k + 2), lambda i: list_aggregate(ws[i : i + k - 1], 'string_agg', ' '))))) AS phrase
  FROM found
), dropped AS (
  SELECT DISTINCT f.lang, f.phrase FROM found f JOIN inner_phrases i ON i.lang = f.lang AND i.phrase = f.phrase WHERE 100 * i.over >= 100 * f.a
), cuts AS (
  SELECT lang, phrase, a, k, list_aggregate(ws[1:k], 'string_agg', ' ') AS p, list_aggregate(ws[k + 1:], 'string_agg', ' ') AS q
  FROM (SELECT *, unnest(range(1, words)) AS k FROM found)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang JOIN counts x ON x.lang = c.lang AND x.phrase = c.p JOIN counts y ON y.lang = c.lang AND y.phrase = c.q
  ANTI JOIN dropped d ON d.lang = c.lang AND d.phrase = c.phrase
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
