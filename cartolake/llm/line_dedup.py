"""Line dedup: lines that many documents share are dropped everywhere.

Hashes of lines are range-partitioned with a secondary sort by document and position; each
partition is streamed once to mark first occurrences of a line in a document. Decisions
travel as compressed keep bitmaps, one for each document, never as text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.llm.common import SPACES, ascii_lower, hash_pair, saved, table

MIN_DOCUMENTS = 10
MIN_POINTS = 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by hash, document, position; marks the first of each (hash, document)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        first = np.ones(batch.num_rows, dtype=bool)
        same = np.ones(batch.num_rows - 1, dtype=bool)
        for key in keys:
            same &= key[1:] == key[:-1]
        first[1:] = ~same
        head = tuple(key[0] for key in keys)
        first[0] = head != last
        last = tuple(key[-1] for key in keys)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], names=[*batch.schema.names, "first"])


def _bitmap(positions: list[int] | np.ndarray, n_lines: int) -> bytes:
    keep = np.ones(n_lines, dtype=np.uint8)
    keep[np.asarray(positions, dtype=np.int64)] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, min_points: int = MIN_POINTS) -> DataFrame:
    """One row (doc_key, text_hash, bitmap) for each document that loses lines.

    bitmap: zlib of little-endian bits, 1 for each line that stays. A line's key is the line
    without white space at both ends, A-Z lower-cased; keys of at least min_points code points
    in at least min_documents distinct ids lose all their lines. A null id counts as one id;
    a null or empty text is one empty line, whose key is too short. Repeated rows of one id
    count once and get the same bitmap. Ids are whole numbers. Texts are taken whole, whatever
    their length; an empty table has no bitmaps; further columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), _lines(F.col(text_col)).alias("lines"))
    rows = rows.select("id", "text_hash", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    rows = rows.select("id", "text_hash", "n", "pos", ascii_lower(F.btrim("line", F.lit(SPACES))).alias("key"))
    rows = rows.filter(F.length("key") >= min_points)
    rows = rows.select(*hash_pair(F.col("key")), F.coalesce("id", F.lit(0)).alias("id0"), F.col("id").isNull().alias("no_id"), "text_hash", "pos", "n")
    order = ["h1", "h2", "id0", "no_id"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    marked = saved(placed.mapInArrow(_first_occurrences, "h1 long, h2 long, id0 long, no_id boolean, text_hash long, pos int, n int, first boolean"))
    common = marked.filter("first").groupBy("h1", "h2").count().filter(F.col("count") >= min_documents).select("h1", "h2")
    # written, so Spark knows the size: a small list is broadcast and a line's rows don't meet in one task
    dropped = marked.join(saved(common), ["h1", "h2"], "left_semi")
    per_doc = dropped.groupBy("id0", "no_id", "text_hash").agg(F.first("n").alias("n"), F.collect_set("pos").alias("gone"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [_bitmap(gone, n) for gone, n in zip(b.column("gone").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id0"), b.column("no_id"), b.column("text_hash"), pa.array(maps, pa.binary())], names=["id0", "no_id", "text_hash", "bitmap"])

    return per_doc.mapInArrow(pack, "id0 long, no_id boolean, text_hash long, bitmap binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, min_points: int = MIN_POINTS) -> DataFrame:
    """All rows with (id, n_lines, n_dropped, kept_text): the text without the lines that keep_bitmaps drops.

    An empty table gives an empty result; a text that loses every line becomes the empty string.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_documents, min_points)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = base.withColumns({"id0": F.coalesce("id", F.lit(0)), "no_id": F.col("id").isNull(), "text_hash": F.xxhash64("text")})
    joined = base.join(bitmaps, ["id0", "no_id", "text_hash"], "left").select("id", "text", "bitmap")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, lost, kept = [], [], []
            for text, bitmap in zip(b.column("text"), b.column("bitmap"), strict=True):
                text = text.as_py() or ""
                if bitmap.is_valid:
                    lines = text.split("\n")
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap.as_py()), dtype=np.uint8), bitorder="little")
                    left = [x for x, keep in zip(lines, bits, strict=False) if keep]
                    total.append(len(lines))
                    lost.append(len(lines) - len(left))
                    kept.append("\n".join(left))
                else:
                    total.append(text.count("\n") + 1)
                    lost.append(0)
                    kept.append(text)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_lines", "n_dropped", "kept_text"])

    return joined.mapInArrow(apply, "id long, n_lines long, n_dropped long, kept_text string").withColumnRenamed("id", id_col)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), flat AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM lines
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM flat
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, line, pos, k IN (SELECT k FROM common) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
