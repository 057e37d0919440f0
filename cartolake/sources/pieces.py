"""Large JSON files in pieces: one file is read by many tasks, each taking the features that begin in its piece."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a piece, the most pieces that a task reads one after another, and the most tasks that pieces are dealt to.
PIECE, PIECES_A_TASK, MOST_TASKS = 16 << 20, 64, 20_000
_QUOTE, _SLASH = 34, 92
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z')


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path.rstrip("/")
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside.rstrip("/")


def opened(path: str):
    """A file for reading at any place."""
    system, inside = located(path)
    return system.open_input_file(inside)


def _brackets(data: bytes, slashes: int, inside: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets outside strings, +1 or -1 for each, and the number of quotes that begin or end strings.

    slashes is the number of backslashes right before data; inside tells whether data begins in a string.
    """
    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == _QUOTE)
    if slashes or (b == _SLASH).any():
        # a quote after an odd run of backslashes is a character of its string
        other = np.concatenate(([-1 - slashes], np.flatnonzero(b != _SLASH)))
        before = other[np.searchsorted(other, quotes) - 1]
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    lower = b | 32  # brackets and braces differ by this bit only
    places = np.flatnonzero((lower == ord("{")) | (lower == ord("}")))
    outside = (np.searchsorted(quotes, places) + inside) % 2 == 0
    places = places[outside]
    return places, np.where(lower[places] == ord("{"), 1, -1), len(quotes)


def _slashes_before(file, start: int) -> int:
    n = 0
    while start - n > 0:
        step = min(64, start - n)
        back = file.read_at(step, start - n - step)
        run = step - len(back.rstrip(b"\\"))
        n += run
        if run < step:
            break
    return n


def _key_before(file, at: int) -> bytes | None:
    """The key whose value begins at a place, if a key stands there."""
    size = 64
    while True:
        back = file.read_at(min(size, at), max(0, at - size))
        found = _KEY.search(back)
        if found and (found.start() > 0 or size >= at):
            return found[1]
        if size >= at or back.rstrip() and not back.rstrip().endswith(b":"):
            return None
        size *= 4


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a piece does to whoever reads on after it: quotes, and depth gained if it begins outside or inside a string."""
    for batch in batches:
        out = []
        for p in batch.itertuples():
            with opened(p.path) as file:
                data, slashes = file.read_at(p.stop - p.start, p.start), _slashes_before(file, p.start)
            _, plain, quotes = _brackets(data, slashes, False)
            _, within, _ = _brackets(data, slashes, True)
            out.append((p.path, p.piece, p.start, p.stop, quotes % 2, int(plain.sum()), int(within.sum())))
        yield pd.DataFrame(out, columns=["path", "piece", "start", "stop", "quotes", "plain", "within"])


def _members(file, p) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, bool]]]:
    """Places of a piece's brackets, their turns, the depth after each, and its top-level members: (place, whether it is the list of features)."""
    data = file.read_at(p.stop - p.start, p.start)
    places, turns, _ = _brackets(data, _slashes_before(file, p.start), bool(p.inside))
    depth = p.depth + np.cumsum(turns)
    events = np.flatnonzero((turns == 1) & (depth == 2) | (turns == -1) & (depth == 1))
    marks = [(int(places[i]), bool(turns[i] == 1 and data[places[i]] == ord("[") and _key_before(file, p.start + int(places[i])) == b"features")) for i in events]
    return places, turns, depth, marks


def _begun(places: np.ndarray, turns: np.ndarray, depth: np.ndarray, marks: list[tuple[int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the brackets that begin an element of a top-level list, and for each the last mark before it, -1 for none in the piece."""
    starts = np.flatnonzero((turns == 1) & (depth == 3))
    return starts, np.searchsorted(np.array([m for m, _ in marks], np.int64), places[starts]) - 1


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for p in batch.itertuples():
            with opened(p.path) as file:
                places, turns, depth, marks = _members(file, p)
            _, last = _begun(places, turns, depth, marks)
            own = sum(marks[i][1] for i in last if i >= 0)
            out.append((p.path, p.piece, p.start, p.stop, p.inside, p.depth, marks[-1][1] if marks else None, int((last < 0).sum()), own))
        yield pd.DataFrame(out, columns=["path", "piece", "start", "stop", "inside", "depth", "leaves", "before", "own"]).astype({"leaves": object})


def _rest(file, start: int, size: int) -> bytes:
    """The object that begins at a place, read as far as it goes."""
    while True:
        data = file.read_at(size, start)
        places, turns, _ = _brackets(data, 0, False)
        ends = np.flatnonzero(np.cumsum(turns) == 0)
        if len(ends):
            return data[: places[ends[0]] + 1]
        if start + size >= file.size():
            raise ValueError("a feature doesn't end")
        size *= 4


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for p in batch.itertuples():
            out, fid = [], p.first
            with opened(p.path) as file:
                places, turns, depth, marks = _members(file, p)
                data = file.read_at(p.stop - p.start, p.start)
                starts, last = _begun(places, turns, depth, marks)
                ends = np.flatnonzero((turns == -1) & (depth == 2))
                after = np.searchsorted(ends, starts)
                for i, mark, e in zip(starts, last, after, strict=True):
                    if not (marks[mark][1] if mark >= 0 else p.listed):
                        continue
                    at = int(places[i])
                    body = data[at : places[ends[e]] + 1] if e < len(ends) else _rest(file, p.start + at, 2 * (len(data) - at))
                    out.append((p.path, fid, body.decode("utf-8")))
                    fid += 1
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["path", "fid", "text"])
                        out = []
            yield pd.DataFrame(out, columns=["path", "fid", "text"])


def feature_texts(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """(path, fid, text): each feature of the feature collections under path, as the text of its object; fid numbers a file's features.

    A file is cut into pieces of bytes, whatever stands at the cuts. Whether a piece begins inside
    a string and how deep it lies follows from the summaries of the pieces before it: one small row
    a piece is added up over the file, so files are read three times, but by as many tasks as they
    have pieces, or several pieces a task if there are more than shuffle partitions. A task holds
    one piece at a time and the longest feature that begins in it. Lists named
    otherwise than features, and strings or properties that look like features, are left alone.
    Elements of the list that are no objects are left out and not numbered. Files are UTF-8. An
    empty file has no features.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    cuts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / piece).cast("long"))).alias("piece"))
    pieces = cuts.select("path", "piece", (F.col("piece") * piece).alias("start"), F.least(F.col("length"), (F.col("piece") + 1) * piece).alias("stop"))
    n, few = pieces.count(), max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = max(1, min(n, max(few, -(-n // PIECES_A_TASK)), MOST_TASKS))
    before = Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    place = "path string, piece long, start long, stop long, "
    found = pieces.repartition(tasks, "path", "piece").mapInPandas(_summaries, place + "quotes int, plain long, within long")
    found = found.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    gained = F.when(F.col("inside"), F.col("within")).otherwise(F.col("plain"))
    placed = found.withColumn("depth", F.coalesce(F.sum(gained).over(before), F.lit(0))).select("path", "piece", "start", "stop", "inside", "depth")
    counted = placed.repartition(tasks, "path", "piece").mapInPandas(_counts, place + "inside boolean, depth long, leaves boolean, before long, own long")
    counted = counted.withColumn("listed", F.coalesce(F.last("leaves", ignorenulls=True).over(before), F.lit(False)))
    begun = F.col("own") + F.when(F.col("listed"), F.col("before")).otherwise(0)
    numbered = counted.withColumn("first", F.coalesce(F.sum(begun).over(before), F.lit(0))).select("path", "piece", "start", "stop", "inside", "depth", "listed", "first")
    return numbered.repartition(tasks, "path", "piece").mapInPandas(_texts, "path string, fid long, text string")
