"""Vector tile files as feature rows: bytes are decoded where they are read, one file a row."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from cartolake.operators.geometry import GEOMETRY
from cartolake.sources.pieces import located

EXTENT = 4096
_VALUE = "struct<kind:string,text:string,number:double,flag:boolean>"
SCHEMA = f"path string, layer string, extent int, fid int, geom {GEOMETRY}, props map<string,{_VALUE}>, error string"


def fields(data: bytes) -> Iterator[tuple[int, int, Any]]:
    """(field, wire type, value) of a protocol buffer message; bytes for length-delimited ones."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ValueError("broken varint")
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out & 0xFFFFFFFFFFFFFFFF
            shift += 7

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, wire, varint()
            continue
        size = {1: 8, 5: 4}.get(wire)
        if wire == 2:
            size = varint()
        if size is None or at + size > len(data):
            raise ValueError("broken field")
        at += size
        yield key >> 3, wire, data[at - size : at]


def packed(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            out.append(value)
            value = shift = 0
    if shift:
        raise ValueError("broken varint")
    return out


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def _value(data: bytes) -> dict | None:
    for field, wire, v in fields(data):
        if field == 1 and wire == 2:
            return {"kind": "string", "text": v.decode("utf-8")}
        if field == 2 and wire == 5:
            return {"kind": "number", "number": struct.unpack("<f", v)[0]}
        if field == 3 and wire == 1:
            return {"kind": "number", "number": struct.unpack("<d", v)[0]}
        if field in (4, 5, 6) and wire == 0:
            signed = zigzag(v) if field == 6 else v - (1 << 64) if v >= 1 << 63 else v
            return {"kind": "integer", "number": float(signed)}
        if field == 7 and wire == 0:
            return {"kind": "boolean", "flag": v != 0}
    return None


def parts_of(commands: list[int]) -> list[list[tuple[int, int]]] | None:
    """Runs of points; None for an unknown command. Missing arguments end the walk."""
    parts: list[list[tuple[int, int]]] = []
    at = x = y = 0
    while at < len(commands):
        op, n = commands[at] & 7, commands[at] >> 3
        at += 1
        if op == 7:
            continue
        if op not in (1, 2):
            return None
        for _ in range(n):
            if at + 1 >= len(commands):
                return parts
            x, y = x + zigzag(commands[at]), y + zigzag(commands[at + 1])
            at += 2
            if op == 1:
                parts.append([])
            if parts:
                parts[-1].append((x, y))
    return parts


def _geometry(kind: int, commands: list[int], extent: int) -> dict | None:
    parts = parts_of(commands)
    if not parts or kind not in (1, 2, 3):
        return None
    pts = lambda p: [{"x": x / extent, "y": 1.0 - y / extent} for x, y in p]
    if kind == 1:
        paths = [{"part": i, "hole": False, "pts": pts([q])} for i, q in enumerate(q for p in parts for q in p)]
    elif kind == 2:
        paths = [{"part": i, "hole": False, "pts": pts(p)} for i, p in enumerate(p for p in parts if len(p) >= 2)]
    else:
        paths, part = [], -1
        for ring in parts:
            # a ring comes without its closing point, and winding tells holes
            if len(ring) < 3:
                continue
            turned = [*ring[1:], ring[0]]
            hole = part >= 0 and sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, turned, strict=True)) < 0
            part += not hole
            paths.append({"part": part, "hole": hole, "pts": pts([*ring, ring[0]])})
    if not paths:
        return None
    name = ("Point", "LineString", "Polygon")[kind - 1]
    return {"kind": ("Multi" if paths[-1]["part"] else "") + name, "paths": paths}


def _layer_name(body: bytes) -> str:
    """The name of a layer, its last one; a layer is skipped over field by field."""
    name = ""
    for field, wire, v in fields(body):
        if field == 1 and wire == 2:
            name = v.decode("utf-8")
    return name


def decode_tile(data: bytes, layers: frozenset[str] | None = None, names: frozenset[str] | None = None) -> Iterator[tuple[str, int, int, dict, dict]]:
    """(layer, extent, fid, geometry, props); coordinates are shares of the tile, y up. fid is the place in the layer.

    Of layers that are not asked for the name is all that is read, and of tags their numbers; None asks for all.
    """
    for field, wire, body in fields(data):
        if field != 3 or wire != 2:
            continue
        if layers is not None and _layer_name(body) not in layers:
            continue
        name, keys, values, features, extent = "", [], [], [], EXTENT
        for f, w, v in fields(body):
            if f == 1 and w == 2:
                name = v.decode("utf-8")
            elif f == 2 and w == 2:
                features.append(v)
            elif f == 3 and w == 2:
                keys.append(v.decode("utf-8"))
            elif f == 4 and w == 2:
                values.append(_value(v))
            elif f == 5 and w == 0:
                extent = v
        for fid, feature in enumerate(features):
            tags: list[int] = []
            kind, commands = 0, []
            for f, w, v in fields(feature):
                if f == 2 and w == 2:
                    tags = packed(v)
                elif f == 3 and w == 0:
                    kind = v
                elif f == 4 and w == 2:
                    commands = packed(v)
            geom = _geometry(kind, commands, extent)
            if geom:
                pairs = zip(tags[::2], tags[1::2], strict=False)
                props = {keys[k]: values[v] for k, v in pairs if k < len(keys) and v < len(values) and values[v] and (names is None or keys[k] in names)}
                yield name, extent, fid, geom, props


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "layer", "extent", "fid", "geom", "props", "error"]
    for batch in batches:
        out = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                out += [(path, *r, None) for r in list(decode_tile(bytes(content)))]
            except (ValueError, UnicodeDecodeError) as e:
                out.append((path, None, None, None, None, None, str(e)))
        yield pd.DataFrame(out, columns=columns)


def decode_tiles(files: DataFrame) -> DataFrame:
    """Features of (path, content) rows: SCHEMA. A broken tile is one row with an error; a broken feature is left out."""
    return files.select("path", "content").mapInPandas(_decoded, SCHEMA)


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    """Tiles of a folder; layers that are not asked for are not decoded."""

    def __init__(self, options: dict[str, str]):
        self.path, self.per_task = options["path"], int(options.get("files", 64))
        self.tags = frozenset(options["tags"].split(",")) if "tags" in options else None
        self.layers = frozenset([options["layer"]]) if "layer" in options else None

    def partitions(self) -> list[InputPartition]:
        system, root = located(self.path)
        found = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        found.sort()
        return [_Files(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = located(self.path)
        for path in partition.paths:
            try:
                with system.open_input_stream(path) as file:
                    rows = list(decode_tile(file.read(), self.layers, self.tags))
                yield from ((path, *r, None) for r in rows)
            except (ValueError, UnicodeDecodeError) as e:
                if self.layers is None:
                    yield path, None, None, None, None, None, str(e)


class _FilteredReader(_Reader):
    """One that takes over equality and IN conditions on the layer."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if asked is None or f.attribute != ("layer",):
                yield f
            else:
                own = frozenset(x for x in asked if x is not None)
                self.layers = own if self.layers is None else self.layers & own


class TileFiles(DataSource):
    """Features of the vector tiles under path: SCHEMA.

    Options: layer, the one to read; tags, the properties to keep, split by commas; files, the
    number a task reads; pushdown, true where spark.sql.python.filterPushdown.enabled is, so that
    conditions on the layer reach the reader.
    """

    @classmethod
    def name(cls) -> str:
        return "vector_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_FilteredReader if self.options.get("pushdown") == "true" else _Reader)(dict(self.options))


def read_tiles(spark: SparkSession, path: str, layer: str | None = None, tags: tuple[str, ...] | None = None) -> DataFrame:
    """Features of the tiles under path, all layers or one, with all properties or those named.

    Layers that are not asked for are not decoded; where spark.sql.python.filterPushdown.enabled is
    set, conditions on the layer of the result ask as well. A broken tile is one row with an error,
    unless layers are asked for.
    """
    spark.dataSource.register(TileFiles)
    reader = spark.read.format("vector_tiles").option("path", path).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled"))
    if layer is not None:
        reader = reader.option("layer", layer)
    return (reader if tags is None else reader.option("tags", ",".join(tags))).load()


def prop(name: str, kind: str) -> Column:
    """A property as a column: of kind string, number or boolean, null where it has another."""
    v = F.try_element_at("props", F.lit(name))
    if kind == "string":
        return F.when(v["kind"] == "string", v["text"])
    return F.when(v["kind"].isin("number", "integer"), v["number"]) if kind == "number" else F.when(v["kind"] == "boolean", v["flag"])
