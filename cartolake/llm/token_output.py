"""Token-ID output: documents as Parquet list columns of token ids.

Rows are range-sorted by id and tokenized where they lie. The file format is Parquet with
format version 2: ids with dictionary pages, the numbers beside them with delta encoding,
row groups of bounded size and page indexes, so that a reader can fetch the numbers without
the tokens, or the tokens of a few documents without the rest.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolake.llm.blocks import text_bytes
from cartolake.llm.common import scratch_path, table

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
END_ID = 0
#: Pieces whose ids a worker remembers, and bytes of texts that it encodes at once.
CACHED_PIECES = 500_000
SLICE_BYTES = 4 << 20
SCHEMA = "doc_id long, part int, n_tokens int, tokens array<int>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceEncoder:
    """Encodes texts like tokenizer.encode, looking up the pieces that merges stay within.

    Byte-level BPE splits a text into pieces before its merges, so the ids of a text are those of
    its pieces, one after another. Pieces of a whole batch are cut by the classes of its
    characters (letter, digit, white space, other; asked of the tokenizer itself), made distinct
    by Arrow, and only distinct pieces are looked up; new ones are encoded together as one text. A
    text that holds the string of an added token goes to the plain call, and so does every text
    if the tokenizer splits in another way.
    """

    LETTER, DIGIT, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255

    def __init__(self, path: str, end_id: int, limit: int = CACHED_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.limit = end_id, limit
        spec = json.loads(self.tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec["model"].get("dropout")
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        if self.by_piece:
            vocabulary = self.tokenizer.get_vocab()
            self.at_space = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.at_space[[i for x, i in vocabulary.items() if x.startswith("Ġ")]] = True
            self.line_break = self._encode(["\n"])[0][0]
            self.classes = np.full(0x110000, self.UNKNOWN, dtype=np.uint8)
            self.classes[:128] = [self._class_of(chr(c)) for c in range(128)]
            #: Entry 0, under None, is the end id.
            self.index: dict[bytes | None, int] = {None: 0}
            self.flat = np.array([end_id], dtype=np.int32)
            self.starts = np.array([0, 1], dtype=np.int64)
            self.uses = np.array([2], dtype=np.int64)

    def _class_of(self, c: str) -> int:
        """A letter joins a letter, a digit a digit, another character another one; white space joins none of them."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        return next((k for k, beside in ((self.LETTER, "a"), (self.DIGIT, "1"), (self.OTHER, "!")) if len(split(beside + c)) == 1), self.SPACE)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _compact(self) -> None:
        """Forgets pieces that one slice alone had, and the least used ones beyond half the limit."""
        keep = np.zeros(len(self.uses), dtype=bool)
        keep[np.argsort(-self.uses, kind="stable")[: self.limit // 2 + 1]] = True
        keep &= self.uses > 1
        keep[0] = True
        sizes = np.diff(self.starts)
        number = np.cumsum(keep) - 1
        self.flat = self.flat[np.repeat(keep, sizes)]
        self.starts = np.concatenate([[0], np.cumsum(sizes[keep])])
        self.uses = self.uses[keep]
        self.index = {k: int(number[i]) for k, i in self.index.items() if keep[i]}

    def _add(self, group: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.starts) - 1
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), dtype=np.int64)])
        self.index.update(zip(group, range(n, n + len(group)), strict=True))

    def _learn(self, fresh: list[bytes]) -> None:
        """Encodes new pieces together: one starts at a space byte, or after a line break."""
        texts = [x.decode() for x in fresh]
        blank = [bool(self.classes[ord(t[-1])] == self.SPACE) for t in texts]
        for kind in ("spaced", "other", "blank"):
            use = [i for i, t in enumerate(texts) if (kind == "blank") == blank[i] and (kind == "blank" or (kind == "spaced") == (t[0] == " "))]
            if not use:
                continue
            if kind == "blank":
                found = self._encode([texts[i] for i in use])
                ids, sizes = np.array([i for x in found for i in x], dtype=np.int32), np.array([len(x) for x in found])
            elif kind == "spaced":
                ids = np.array(self._encode(["".join([texts[i] for i in use])])[0], dtype=np.int32)
                sizes = np.diff(np.append(np.flatnonzero(self.at_space[ids]), len(ids)))
            else:
                ids = np.array(self._encode(["".join([texts[i] + "\n" for i in use])])[0], dtype=np.int32)
                sizes = np.diff(np.flatnonzero(ids == self.line_break), prepend=-1) - 1
                ids = ids[ids != self.line_break]
            self._add([fresh[i] for i in use], ids, sizes)

    def _char_classes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the bytes of texts: the class of each character at its first byte, carried to its further bytes, and whether a byte is such a further one."""
        out = self.classes[data]
        high = data >= 0x80
        if not high.any():
            return out, high
        at = np.flatnonzero(data >= 0xC0)
        lead = data[at].astype(np.int32)
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        code = lead & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            code[more] = (code[more] << 6) | (data[at[more] + k] & 0x3F)
        kinds = self.classes[code]
        if (kinds == self.UNKNOWN).any():
            for c in np.unique(code[kinds == self.UNKNOWN]).tolist():
                self.classes[c] = self._class_of(chr(c))
            kinds = self.classes[code]
        out[at] = kinds
        for k in range(1, 4):
            more = size > k
            out[at[more] + k] = kinds[more]
        return out, high & (data < 0xC0)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin, by the public byte-level BPE pattern: contractions, then runs of one class with one space before them, then white space."""
        kind, further = self._char_classes(data)
        n = len(data)
        begins = np.zeros(n + 1, dtype=bool)
        begins[offsets] = True
        begins = begins[:-1]
        space = kind == self.SPACE
        cut = np.empty(n, dtype=bool)
        cut[:1] = True
        # of equal neighbours none begins; a single space stays with what follows
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut[1:] &= (data[:-1] != 0x20) | space[1:]
        cut |= begins
        # of a run of white space before something the last character stands by itself, or goes with what follows
        gap = np.flatnonzero(space[1:] & space[:-1]) + 1
        if len(gap):
            first = gap[~further[gap] & ~begins[gap]]
            width = 1 + (data[first] >= 0xC0) + (data[first] >= 0xE0) + (data[first] >= 0xF0)
            after = first + width
            inside = after < n
            after_at = np.minimum(after, n - 1)
            cut[first[inside & ~space[after_at] & ~begins[after_at]]] = True
        quote = np.flatnonzero((data == 0x27) & cut)
        quote = quote[quote + 1 < n]
        if len(quote):
            one, two = data[quote + 1], data[np.minimum(quote + 2, n - 1)]
            short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8)) & ~begins[quote + 1]
            long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
            long &= (quote + 2 < n) & ~begins[quote + 1] & ~begins[np.minimum(quote + 2, n - 1)]
            for found, size in ((quote[short], 2), (quote[long & ~short], 3)):
                cut[found + 1] = False
                end = found + size
                cut[end[end < n]] = True
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, the end id after each text, and the number of ids of each text."""
        if not self.by_piece:
            found = [[*x, self.end_id] for x in self._encode([x or "" for x in texts.to_pylist()])]
            return np.array([i for x in found for i in x], dtype=np.int32), np.array([len(x) for x in found], dtype=np.int32)
        data, offsets = text_bytes(pc.fill_null(texts, ""))
        if len(self.index) > self.limit:
            self._compact()
        cuts = self._cuts(data, offsets)
        bounds = np.append(cuts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        number = np.fromiter(map(self.index.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        missing = np.flatnonzero(number < 0).tolist()
        if missing:
            self._learn([distinct[i] for i in missing])
            number[missing] = [self.index[distinct[i]] for i in missing]
        self.uses[number] += 1
        # the end id after the pieces of each text
        last = np.searchsorted(cuts, offsets[1:])
        at = np.insert(number[pieces.indices.to_numpy()], last, 0)
        last += np.arange(len(last))
        begin = self.starts[at]
        n_ids = self.starts[at + 1] - begin
        ends = np.cumsum(n_ids)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - n_ids), n_ids)]
        sizes = np.diff(ends[last], prepend=0).astype(np.int32)
        alone = [i for x in self.added for i in np.flatnonzero(pc.fill_null(pc.match_substring(texts, x), False).to_numpy(zero_copy_only=False)).tolist()]
        if alone:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in set(alone):
                parts[i] = np.array([*self._encode([texts[i].as_py()])[0], self.end_id], dtype=np.int32)
            ids, sizes = np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int32)
        return ids, sizes


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, end_id: int) -> PieceEncoder:
    """The one of this worker process; tasks that follow one another in it share what it remembers."""
    key = (path, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, end_id)
    return _ENCODERS[key]


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID) -> None:
    """Writes (doc_id, part, n_tokens, tokens) to path in ascending order of ids, null ids first.

    part is the number of the range of ids that a file holds. A null text is an empty one and
    has the end id alone. Repeated rows are written as often as they occur. Ids are whole numbers. An empty table
    gives files without rows. Texts are encoded whole, whatever their length; the string of an added
    token in a text becomes its id, as the library has it. Further columns are left out.
    """
    tokenizer_path = tokenizer_path or default_tokenizer()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path, end_id)
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            cuts = np.searchsorted(upto, np.arange(SLICE_BYTES, upto[-1] if len(upto) else 0, SLICE_BYTES)) + 1
            for at, end in pairwise(np.unique([0, *cuts, batch.num_rows]).tolist()):
                b = batch.slice(at, end - at)
                ids, sizes = own.encode(b.column("text"))
                offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
                np.cumsum(sizes, out=offsets[1:])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "part", "n_tokens", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("doc_id", F.spark_partition_id().alias("part"), "text")
    options = {"parquet.writer.version": "v2", "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES), "parquet.enable.dictionary": "true", "compression": "zstd"}
    rows.mapInArrow(tokenize, SCHEMA).write.options(**options).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, start, n_tokens) from the numbers alone; start: ids of all documents before it.

    Sums of the parts come first, then running sums inside each part. Rows that repeat an id
    follow one another by length.
    """
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "n_tokens")
    return _with_start(rows, rows)


def _with_start(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    parts = numbers.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return rows.join(parts, "part").withColumn("start", start).drop("_before")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column("tokens")
            values = np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), dtype="<i4").view(np.uint8)
            o = tokens.offsets.to_numpy() * 4
            crc = [zlib.crc32(values[o[i] : o[i + 1]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "part", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SCHEMA).parquet(path)
    rows = _with_start(rows.mapInArrow(digest, "doc_id long, part int, n_tokens int, ids_crc32 long"), rows.select("part", "n_tokens"))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)
