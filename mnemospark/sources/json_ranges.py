"""One large JSON array or map read by many tasks: byte ranges that find their own element borders.

A range cannot tell from its bytes whether it begins inside a string. So a first pass gives each range as a map of both cases:
the parity of its quotes (escapes resolved by looking back), and by how much brackets outside strings change the depth in
either case. Composed in order, one small row a range, the maps tell each range the state that enters it, without a guess. The second pass is a data
source whose partitions are the ranges: each yields the elements whose separator at depth 1 it holds, and reads on behind its end for the rest of the
last one. Work and memory follow the range, not the file.

Files are opened by path where executors share them, by pyarrow's file systems otherwise. Elements come with the byte offset of their
separator, which orders them; an element is text, to be parsed by from_json. Empty files and ``[]`` have no elements.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mnemospark.operators.segmented import prefix
from mnemospark.session import written

RANGE_BYTES = 16 << 20
RANGES = 1000  # about so many of all files, as long as a range is no longer than RANGE_BYTES: each costs a task
ELEMENT = "path string, offset long, element string"
_QUOTE, _ESCAPE, _COMMA = 0x22, 0x5C, 0x2C


def _open(path: str):
    plain = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    if "://" not in plain:
        return open(plain, "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def _read(f, start: int, size: int) -> np.ndarray:
    f.seek(start)
    return np.frombuffer(f.read(size), np.uint8)


def _quotes(data: np.ndarray, escapes_before: int) -> np.ndarray:
    """Whether each byte is a quote that begins or ends a string: not one after an odd number of backslashes."""
    quote, escape = data == _QUOTE, data == _ESCAPE
    if not escape.any() and not escapes_before:
        return quote
    at = np.arange(len(data))
    last_plain = np.maximum.accumulate(np.where(escape, -1 - escapes_before, at))
    run = np.concatenate([[escapes_before], (at - last_plain)[:-1]])  # backslashes that stand right before each byte
    return quote & (run % 2 == 0)


def _depths(data: np.ndarray, outside: np.ndarray) -> np.ndarray:
    opened = ((data == 0x5B) | (data == 0x7B)) & outside
    closed = ((data == 0x5D) | (data == 0x7D)) & outside
    return opened.astype(np.int64) - closed


def _escapes_before(f, start: int) -> int:
    """How many backslashes stand right before a byte offset."""
    n, end = 0, start
    while end > 0:
        block = _read(f, max(0, end - 4096), min(4096, end))
        plain = np.flatnonzero(block != _ESCAPE)
        if len(plain):
            return n + len(block) - 1 - int(plain[-1])
        n, end = n + len(block), end - len(block)
    return n


def range_map(f, start: int, size: int) -> tuple[int, int, int]:
    """(parity of quotes, depth change if the range begins outside a string, and if inside)."""
    data = _read(f, start, size)
    quotes = _quotes(data, _escapes_before(f, start))
    inside = (np.cumsum(quotes) & 1).astype(bool)
    return int(quotes.sum() & 1), int(_depths(data, ~inside).sum()), int(_depths(data, inside).sum())


def elements(f, start: int, size: int, inside: bool, depth: int) -> Iterator[tuple[int, str]]:
    """(offset of the separator, text) of the elements that begin in a range, whose entering state is known."""
    data = _read(f, start, size)
    owned, end, before = len(data), start + len(data), _escapes_before(f, start)
    held, open_at, begun = b"", None, False

    def cuts(block: np.ndarray, escapes: int, inside: bool, depth: int):
        strings = (np.cumsum(_quotes(block, escapes)) + inside & 1).astype(bool)
        levels = depth + np.cumsum(step := _depths(block, ~strings))
        separator = ((block == _COMMA) & ~strings & (levels == 1)) | ((step == 1) & (levels == 1))
        closing = (step == -1) & (levels == 0)
        return np.flatnonzero(separator | closing), closing, bool(strings[-1]) if len(block) else inside, int(levels[-1]) if len(block) else depth

    def text(raw: bytes) -> str:
        return raw.decode("utf-8").strip()

    at = start
    while len(data):
        places, closing, inside, depth = cuts(data, before, inside, depth)
        raw = data.tobytes()
        for p in places.tolist():
            if open_at is not None:
                piece = text(held + raw[begun:p])
                if piece:
                    yield open_at, piece
                open_at, held = None, b""
            if at + p >= start + owned:  # the next range owns it
                return
            if not closing[p]:
                open_at, begun = at + p, p + 1
        if open_at is None:
            return
        held += raw[begun:]
        begun = 0
        at += len(data)
        with_escapes = len(raw) - len(raw.rstrip(b"\\"))
        before = with_escapes if with_escapes < len(raw) else before + with_escapes
        data = _read(f, at, 1 << 20)
    if open_at is not None:
        raise ValueError(f"the file ends inside the element at byte {open_at}")


class _Range(InputPartition):
    def __init__(self, path: str, start: int, size: int, inside: bool, depth: int):
        self.path, self.start, self.size, self.inside, self.depth = path, start, size, inside, depth


class _Reader(DataSourceReader):
    def __init__(self, ranges: list[list]):
        self.ranges = ranges

    def partitions(self) -> list[InputPartition]:
        return [_Range(*r) for r in self.ranges] or [_Range("", 0, 0, False, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("element", pa.string())])
        with _open(partition.path) as f:
            rows, size = [], 0
            for offset, text in elements(f, partition.start, partition.size, partition.inside, partition.depth):
                rows.append((partition.path, offset, text))
                size += len(text)
                if size > 4_000_000 or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class JsonRanges(DataSource):
    """Option ranges: JSON rows (path, start, size, inside, depth), as plan_ranges makes them."""

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return ELEMENT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["ranges"]))


def plan_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> list[list]:
    """The byte ranges of all files under path (a file, folder or pattern) with the state that enters each; of large files they are longer than range_bytes."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for g in (fs.globStatus(at) or []) for s in ([g] if g.isFile() else fs.listStatus(g.getPath())) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    range_bytes = max(range_bytes, min(RANGE_BYTES, sum(s.getLen() for s in found) // RANGES))
    ranges = [(s.getPath().toString(), start, min(range_bytes, s.getLen() - start)) for s in found for start in range(0, s.getLen(), range_bytes)]
    if not ranges:
        return []

    def run(batches):
        for b in batches:
            out = []
            for p, start, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _open(p) as f:
                    out.append((p, start, size, *range_map(f, start, size)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["path", "start", "size", "parity", "outside", "inside"])

    maps = spark.createDataFrame(ranges, "path string, start long, size long").repartition(min(len(ranges), 10_000), "path", "start")
    maps = maps.mapInArrow(run, "path string, start long, size long, parity long, outside long, inside long").orderBy("path", "start").collect()  # one row a range
    plan, state = [], None
    for m in maps:
        inside, depth = (False, 0) if m.start == 0 else state
        plan.append([m.path, m.start, m.size, inside, depth])
        state = inside ^ bool(m.parity), depth + (m.inside if inside else m.outside)
        if state[1] < 0:
            raise ValueError(f"{m.path} closes more than it opens before byte {m.start + m.size}")
    return plan


def json_elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offset, element): the elements of top-level arrays, or the ``"key": value`` members of top-level maps, as text."""
    spark.dataSource.register(JsonRanges)
    return spark.read.format("json_ranges").option("ranges", json.dumps(plan_ranges(spark, path, range_bytes))).load()


def read_array(spark: SparkSession, path: str, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, pos, fields) of files that hold one JSON array of objects each; pos is the place in the file's array."""
    parsed = json_elements(spark, path, range_bytes).select("path", "offset", F.from_json("element", f"struct<{schema}>").alias("r"))
    parsed = written(parsed, "array-elements")  # places take several passes; files are read and parsed once
    return prefix(parsed, ["path"], ["offset"], position="pos").select("path", "pos", "r.*")


def read_map(spark: SparkSession, path: str, kind: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, key, value) of files that hold one JSON map each; kind is the type of its values."""
    member = F.from_json(F.concat(F.lit("{"), "element", F.lit("}")), f"map<string, {kind}>")
    return json_elements(spark, path, range_bytes).select("path", F.explode(member).alias("key", "value"))
