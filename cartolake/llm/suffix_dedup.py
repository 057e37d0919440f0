"""Suffix-array dedup: bytes of passages that a document with a smaller id has too are removed.

Prefix doubling over positions, kept distributed and pruned early. A position's name stands for
its rank: positions of equal prefix have equal names. The first round names prefixes of
ANCHOR bytes and is made only at anchors: of each window of `length` bytes the place whose
prefix hashes least, so equal windows have equal anchors. Positions whose name no other
document has are dropped. The second round names, for the others, the longest stretch that its
windows span; a stretch that a smaller id has too is settled whole. Only what still differs
within an anchor's name, every copy of a stretch whose id is its least, goes to the last round,
where windows of the full length are named. Anchors that very many stretches share are sorted by rank pairs: the
names of a window's first and last bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.llm.blocks import KEY_BYTES, SpanHashes, block_rows, counts_of, in_buckets, key_counts, n_buckets, packed, text_bytes, unpacked
from cartolake.llm.common import saved, table

LENGTH = 50
#: Stretches of one anchor that a task compares by itself, a few MB; more are spread by their windows.
TOGETHER = 1 << 16
NO_ID = 2**63 - 1


def anchor_length(length: int) -> int:
    return max(1, length // 2 - 1)


def _runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[SpanHashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor name: hashes, document, first and last window, name."""
    hashes = SpanHashes(data)
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return hashes, none, none, none, none.view(np.uint64)
    k = anchor_length(length)
    least = hashes.grams(k)
    width, size = length - k + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    # a window starts in a document at least `length` bytes before its end
    lengths = np.diff(offsets)
    change = np.ones(n, dtype=bool)
    change[1:] = least[1:] != least[:-1]
    begins = offsets[:-1]
    change[begins[begins < n]] = True
    last_start = offsets[1:] - length
    after = last_start[(lengths >= length) & (last_start + 1 < n)] + 1
    change[after] = True
    first = np.flatnonzero(change)
    last = np.append(first[1:], n) - 1
    doc = np.searchsorted(offsets, first, side="right") - 1
    good = first <= last_start[doc]
    first, last, doc = first[good], last[good], doc[good]
    return hashes, doc, first, last, least[first]


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans sorted by start."""
    upto = np.maximum.accumulate(end)
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > upto[:-1]
    at = np.flatnonzero(new)
    return start[at], upto[np.append(at[1:], len(start)) - 1] if len(at) else end[:0]


def _stretches(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: id, text_hash, spans (settled bytes), open (stretches that need the last round)."""
    rows, n_blocks = block_rows(docs, id_col, text_col)
    rows = rows.withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    buckets = n_buckets(n_blocks)

    def names(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        _, doc, _, _, name = _runs(*text_bytes(t.column("text")), length)
        order = np.lexsort((doc, name))
        name, ids = name[order], t.column("id").to_numpy()[doc[order]]
        new = np.ones(len(name), dtype=bool)
        new[1:] = name[1:] != name[:-1]
        first = np.flatnonzero(new)
        # one or several ids have it here; more need not be told apart
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(first) else np.zeros(0, dtype=bool)
        return name[first], 1 + several.astype(np.int64)

    def shared(t: pa.Table, answers: pa.Table) -> tuple[np.ndarray, ...]:
        """Of the runs whose name several documents have: names of anchor and stretch, row, bounds; sorted by both names and id."""
        data, offsets = text_bytes(t.column("text"))
        hashes, doc, first, last, name = _runs(data, offsets, length)
        distinct, at = np.unique(name, return_inverse=True)
        use = counts_of(distinct, buckets, answers)[at] > 1 if len(name) else np.zeros(0, dtype=bool)
        doc, first, last, name = doc[use], first[use], last[use], name[use]
        stretch = hashes.of(first, last + length)
        ids = t.column("id").to_numpy()[doc]
        order = np.lexsort((first, ids, stretch, name))
        doc, first, last, name, stretch = doc[order], first[order], last[order], name[order], stretch[order]
        new = np.ones(len(name), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | (stretch[1:] != stretch[:-1])
        return data, offsets, doc, first, last, name, stretch, ids[order], new

    def send(t: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, _, _, _, name, stretch, ids, new = shared(t, answers)
        name, stretch, ids = name[new], stretch[new], ids[new]
        order, bounds = in_buckets(name, buckets)
        name, stretch, ids = name[order], stretch[order], ids[order]
        parts = [(b, packed(name[x:y], buckets), stretch[x:y].tobytes(), zlib.compress(ids[x:y].astype("<i8").tobytes(), 1)) for b, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)) if y > x]
        number = t.column("block")[0].as_py() if t.num_rows else 0
        return pa.table({"bucket": pa.array([p[0] for p in parts], pa.int32()), "block": pa.array([number] * len(parts), pa.int32()), "names": pa.array([p[1] for p in parts], pa.binary()), "stretches": pa.array([p[2] for p in parts], pa.binary()), "ids": pa.array([p[3] for p in parts], pa.binary())})

    def settle(t: pa.Table) -> pa.Table:
        """For each entry 0: a smaller id elsewhere has the stretch; 1: none, and no other stretch has its anchor; 2: none, but others have."""
        sizes = [len(x.as_py()) // KEY_BYTES for x in t.column("names")]
        name = np.concatenate([unpacked(x.as_py()) for x in t.column("names")])
        stretch = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64) for x in t.column("stretches")])
        ids = np.concatenate([np.frombuffer(zlib.decompress(x.as_py()), dtype="<i8") for x in t.column("ids")])
        order = np.lexsort((ids, stretch, name))
        n, s, i = name[order], stretch[order], ids[order]
        new_name = np.append(True, n[1:] != n[:-1])
        new = new_name | np.append(True, s[1:] != s[:-1])
        least = i[np.flatnonzero(new)][np.cumsum(new) - 1]
        group = np.cumsum(new_name) - 1
        several = np.bincount(group[new])[group] > 1
        code = np.empty(len(order), dtype=np.uint8)
        code[order] = np.where(i > least, 0, np.where(several, 2, 1))
        answers = [zlib.compress(x.tobytes(), 1) for x in np.split(code, np.cumsum(sizes)[:-1])]
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "codes": pa.array(answers, pa.binary())})

    def build(t: pa.Table, both: pa.Table) -> pa.Table:
        is_code = both.column("counts").is_null()
        data, offsets, doc, first, last, name, stretch, ids, new = shared(t, both.filter(pa.compute.invert(is_code)))
        entry = np.cumsum(new) - 1
        order, bounds = in_buckets(name[new], buckets)
        codes = np.zeros(int(new.sum()), dtype=np.uint8)
        told = both.filter(is_code)
        for bucket, x in zip(told.column("bucket").to_pylist(), told.column("codes"), strict=True):
            codes[order[bounds[bucket] : bounds[bucket + 1]]] = np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint8)
        code = codes[entry]
        gone = (code == 0) | (ids > ids[new][entry])
        open_ = ~gone & (code == 2)
        n_docs = t.num_rows
        by_doc = np.lexsort((first, doc))
        g = by_doc[gone[by_doc]]
        spans: list[bytes] = []
        where = np.searchsorted(doc[g], np.arange(n_docs + 1))
        for i in range(n_docs):
            x = g[where[i] : where[i + 1]]
            a, b = _merged(first[x] - offsets[i], last[x] + length - offsets[i])
            spans.append(np.stack([a, b], axis=1).astype("<i4").tobytes())
        o = by_doc[open_[by_doc]]
        where = np.searchsorted(doc[o], np.arange(n_docs + 1)).astype(np.int32)
        values = pa.StructArray.from_arrays(
            [pa.array(name[o].view(np.int64)), pa.array((first[o] - offsets[doc[o]]).astype(np.int32)), pa.array([data[x : y + length].tobytes() for x, y in zip(first[o], last[o], strict=True)], pa.binary())],
            names=["name", "start", "bytes"],
        )
        return pa.table({"id": t.column("id"), "text_hash": t.column("text_hash"), "spans": pa.array(spans, pa.binary()), "open": pa.ListArray.from_arrays(pa.array(where), values)})

    counts = key_counts(rows, names, buckets)
    sent = rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(send, "bucket int, block int, names binary, stretches binary, ids binary")
    codes = sent.groupBy("bucket").applyInArrow(settle, "block int, bucket int, codes binary")
    answers = counts.select("block", "bucket", "counts", F.lit(None).cast("binary").alias("codes")).union(codes.select("block", "bucket", F.lit(None).cast("binary"), "codes"))
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(build, "id long, text_hash long, spans binary, open array<struct<name:long,start:int,bytes:binary>>")


def _windows(batch: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, SpanHashes]:
    """Of stretches: the row of each window, and where it starts in the bytes of all."""
    data, offsets = text_bytes(batch.column("bytes"))
    n = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + offsets[:-1][row]
    return row, start, SpanHashes(data)


SPAN_SCHEMA = "id long, text_hash long, start int, end int"


def _spans(row: np.ndarray, start: np.ndarray, batch: pa.Table, length: int) -> pa.Table:
    """Windows (row, start in the row) as merged spans of their documents."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    wide = row.astype(np.int64) << 33
    a, b = _merged(wide + start, wide + start + length)
    r = (a >> 33).astype(np.int64)
    at = batch.column("start").to_numpy()[r]
    low = (1 << 33) - 1
    return pa.table({"id": batch.column("id").take(r), "text_hash": batch.column("text_hash").take(r), "start": pa.array(((a & low) + at).astype(np.int32)), "end": pa.array(((b & low) + at).astype(np.int32))})


def _last_round(stretches: DataFrame, length: int) -> DataFrame:
    """Spans (id, text_hash, start, end) of windows that a smaller id has too, among stretches (name, id, text_hash, start, bytes)."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            name = t.column("name").to_numpy()
            # the last anchor may go on in the next batch
            cut = int(np.searchsorted(name, name[-1]))
            rest = t.slice(cut)
            if cut:
                yield from within(t.slice(0, cut)).to_batches()
        if rest is not None and rest.num_rows:
            yield from within(rest).to_batches()

    def within(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        row, start, hashes = _windows(t, length)
        window = hashes.of(start, start + length)
        name, ids = t.column("name").to_numpy()[row], t.column("id").to_numpy()[row]
        order = np.lexsort((ids, window, name))
        n, w, i = name[order], window[order], ids[order]
        new = np.append(True, (n[1:] != n[:-1]) | (w[1:] != w[:-1]))
        least = i[np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = order[i > least]
        return _spans(row[gone], start[gone] - text_bytes(t.column("bytes"))[1][row[gone]], t, length)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window by its rank pair: names of its first and last bytes, which overlap."""
        part = -(-length * 2 // 3)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                t = pa.Table.from_batches([b.slice(at, 2000)])
                row, start, hashes = _windows(t, length)
                place = (start - text_bytes(t.column("bytes"))[1][row] + t.column("start").to_numpy()[row]).astype(np.int32)
                first, last = hashes.of(start, start + part), hashes.of(start + length - part, start + length)
                yield from pa.table({"r1": pa.array(first.view(np.int64)), "r2": pa.array(last.view(np.int64)), "id": t.column("id").take(row), "text_hash": t.column("text_hash").take(row), "start": pa.array(place)}).to_batches()

    sizes = stretches.groupBy("name").agg(F.count("*").alias("n"))
    many = saved(sizes.filter(F.col("n") > TOGETHER).select("name"))
    few = stretches.join(many, "name", "left_anti").repartition("name").sortWithinPartitions("name")
    spans = few.select("name", "id", "text_hash", "start", "bytes").mapInArrow(together, SPAN_SCHEMA)
    windows = stretches.join(many, "name", "left_semi").select("id", "text_hash", "start", "bytes").mapInArrow(ranked, "r1 long, r2 long, id long, text_hash long, start int")
    windows = saved(windows)
    least = windows.groupBy("r1", "r2").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("r1", "r2", "least")
    gone = windows.join(least, ["r1", "r2"]).filter("id > least")
    return spans.union(gone.select("id", "text_hash", "start", (F.col("start") + length).alias("end")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, spans): byte spans [start, end) to remove from each document that has any, merged, as little-endian 32-bit pairs.

    id is NO_ID for a null id, which is larger than any other; rows of one id never remove from each other.
    """
    found = saved(_stretches(docs, length, id_col, text_col))
    stretches = found.select("id", "text_hash", F.explode("open").alias("o")).select("o.name", "id", "text_hash", "o.start", "o.bytes")
    more = _last_round(stretches, length).groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("more"))
    settled = found.groupBy("id", "text_hash").agg(F.first("spans").alias("spans"))
    both = settled.join(more, ["id", "text_hash"], "left").filter((F.length("spans") > 0) | F.col("more").isNotNull())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            lists = b.column("more")
            flat = lists.values
            starts, ends = flat.field("start").to_numpy(zero_copy_only=False), flat.field("end").to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_numpy()
            for i, spans in enumerate(b.column("spans")):
                s = np.frombuffer(spans.as_py(), dtype="<i4").reshape(-1, 2)
                x, y = (offsets[i], offsets[i + 1]) if lists[i].is_valid else (0, 0)
                a, e = np.concatenate([s[:, 0], starts[x:y]]), np.concatenate([s[:, 1], ends[x:y]])
                order = np.argsort(a, kind="stable")
                out.append(np.stack(_merged(a[order], e[order]), axis=1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), pa.array(out, pa.binary())], names=["id", "text_hash", "spans"])

    return both.mapInArrow(merge, "id long, text_hash long, spans binary")


def dedup_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with id, n_bytes, n_removed, n_spans and kept (the bytes that stay).

    A byte goes if a string of `length` bytes over it also starts in a document of a smaller id.
    Texts are their UTF-8 bytes, a null one is empty; matches never cross documents. Texts shorter
    than `length` stay as they are. A null id is larger than every other. Rows of equal ids
    don't remove from each other. An empty table gives an empty result. kept may end within a
    character, so it is binary.
    """
    spans = repeated_spans(docs, length, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = rows.join(spans, ["id", "text_hash"], "left").select("doc", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, runs, kept = [], [], [], []
            for text, spans in zip(b.column("text").cast(pa.binary()), b.column("spans"), strict=True):
                data = text.as_py()
                s = np.frombuffer(spans.as_py(), dtype="<i4").reshape(-1, 2) if spans.is_valid else np.zeros((0, 2), dtype="<i4")
                at, parts = 0, []
                for x, y in s.tolist():
                    parts.append(data[at:x])
                    at = y
                parts.append(data[at:])
                left = b"".join(parts)
                n.append(len(data))
                removed.append(len(data) - len(left))
                runs.append(len(s))
                kept.append(left)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("doc", id_col)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
