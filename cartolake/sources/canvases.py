"""Canvases as files: rows in order are streamed to one file a canvas, and files appear when all tasks are done."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from cartolake.operators import raster, svg
from cartolake.sources.pieces import located

_BUFFER = 1 << 20
#: Bytes of contents that many tasks join before one task writes a canvas's file.
_CHUNK = 1 << 14


@dataclass
class Written(WriterCommitMessage):
    """The folder that a task filled; None if it had no rows."""

    attempt: str | None


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options["suffix"]
        self.head, self.between, self.tail = (options.get(k, "").encode() for k in ("head", "between", "tail"))
        self.width, self.height = int(options.get("width", 0)), int(options.get("height", 0))

    def _gap(self, file, at: int, upto: int) -> None:
        """Clear rows of pixels for those that no row came for."""
        for _ in range(at, upto):
            file.write(bytes(4 * self.width))

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = located(self.path)
        attempt, file, canvas, upto = uuid.uuid4().hex, None, None, 0
        folder = f"{root}/_temporary/{attempt}"
        for row in iterator:
            name = "\0" if row["canvas"] is None else row["canvas"]
            if file is None or name != canvas:
                if file is not None:
                    self._gap(file, upto, self.height)
                    file.write(self.tail)
                    file.close()
                else:
                    system.create_dir(folder)
                file = system.open_output_stream(f"{folder}/{quote(name, safe='')}{self.suffix}", buffer_size=_BUFFER)
                file.write(self.head)
                canvas, upto = name, 0
            elif not self.height:
                file.write(self.between)
            if self.height:
                if not upto <= row["place"] < self.height:
                    raise ValueError(f"pixel row {row['place']} is outside its canvas or out of order")
                self._gap(file, upto, row["place"])
                upto = row["place"] + 1
            content = row["content"]
            file.write(content.encode() if isinstance(content, str) else bytes(content))
        if file is None:
            return Written(None)
        self._gap(file, upto, self.height)
        file.write(self.tail)
        file.close()
        return Written(attempt)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = located(self.path)
        system.create_dir(root)
        for m in messages:
            if isinstance(m, Written) and m.attempt:
                system.move(f"{root}/_temporary/{m.attempt}", f"{root}/part-{m.attempt}")
        self._forget(system, root)
        system.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._forget(*located(self.path))

    def _forget(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary")


class CanvasFiles(DataSource):
    """Writes (canvas, place, content), sorted by canvas in each partition, to a file for each canvas."""

    @classmethod
    def name(cls) -> str:
        return "canvas_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def _joined(between: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring contents of a canvas as one, about _CHUNK bytes each, numbered in order."""
    number = 0
    for b in batches:
        if not b.num_rows:
            continue
        canvas, content = b.column("canvas"), b.column("content")
        names = pc.fill_null(canvas.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        upto = np.cumsum(pc.fill_null(pc.binary_length(content), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // _CHUNK
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(names) != 0) | (np.diff(upto) != 0)]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, b.num_rows).astype(np.int32)), content)
        whole = pc.binary_join(lists, pa.scalar(between).cast(content.type))
        at = pa.array(begin)
        yield pa.RecordBatch.from_arrays([canvas.take(at), b.column("place").take(at), b.column("part").take(at), pa.array(np.arange(number, number + len(begin)))] + [whole], names=["canvas", "place", "part", "number", "content"])
        number += len(begin)


def _chunks(rows: DataFrame, order: tuple[str, ...], between: str) -> DataFrame:
    """(canvas, place, part, number, content): contents sorted and joined in ranges of canvas and order, so that a canvas is spread over tasks; part and number tell their order."""
    sorted_ = rows.repartitionByRange("canvas", *order).sortWithinPartitions("canvas", *order)
    return sorted_.select("canvas", "place", F.spark_partition_id().alias("part"), "content").mapInArrow(lambda batches: _joined(between, batches), "canvas string, place int, part int, number long, content string")


def write_files(rows: DataFrame, path: str, suffix: str, order: tuple[str, ...], **options: str | int) -> None:
    """Rows (canvas, place, content) as path/part-*/<canvas><suffix>, a file's contents in the order of the columns named.

    head, between and tail stand before, between and after the contents, which are texts unless
    there is a height. Texts are sorted and joined to chunks over ranges of canvas and order, so
    the task that writes a file moves chunks, not rows. Canvases are dealt to tasks by name and
    rows are sorted on disk where needed; a task holds one batch of rows at a time. A task
    fills a folder of its own, and the driver moves one folder a task when all are done, so a lost
    or repeated task leaves nothing behind. Characters of a canvas that file names can't hold are
    written as %XX, and a null canvas as %00. No rows give a folder without files. path must be
    new, on a file system that executors share and that can move folders.
    """
    spark = rows.sparkSession
    system, root = located(path)
    if system.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    spark.dataSource.register(CanvasFiles)
    if not options.get("height"):
        rows, order = _chunks(rows, order, str(options.get("between", ""))), ("part", "number")
    dealt = rows.repartition("canvas").sortWithinPartitions("canvas", *order).select("canvas", "place", "content")
    dealt.write.format("canvas_files").mode("append").options(path=path, suffix=suffix, **options).save()


def write_pixels(blended: DataFrame, path: str, width: int, height: int) -> None:
    """Blended pixels as one file of width * height * 4 bytes a canvas, clear where nothing is."""
    rows = raster.to_bytes(blended, width, height).selectExpr("canvas", "CAST(py AS INT) AS place", "row AS content")
    write_files(rows, path, ".rgba", ("place",), width=width, height=height)


def write_svg(elements: DataFrame, path: str, width: float, height: float, title: str | None = None) -> None:
    """Elements (canvas, layer_ord, fid, element) as one SVG document a canvas, in paint order; the text is that of svg.documents."""
    rows = elements.selectExpr("canvas", "layer_ord", "fid", "CAST(NULL AS INT) AS place", "element AS content")
    write_files(rows, path, ".svg", ("layer_ord", "fid", "content"), head=svg.head(width, height, title) + "\n", between="\n", tail=svg.TAIL)


def write_collections(features: DataFrame, path: str) -> None:
    """Features (canvas, fid, text) as one GeoJSON feature collection a canvas, in order of fid."""
    rows = features.selectExpr("canvas", "fid", "CAST(NULL AS INT) AS place", "text AS content")
    write_files(rows, path, ".json", ("fid", "content"), head='{"type":"FeatureCollection","features":[', between=",\n", tail="]}")
