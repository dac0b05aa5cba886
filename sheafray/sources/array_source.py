"""Chunked arrays as a Spark data source, to read and to write.

    spark.dataSource.register(ChunkedArrays)
    spark.read.format("chunked_array").option("level", "1").load(spec).where("cz < 4")
    chunks.write.format("chunked_array").options(shape="96,320,320", chunks="32,64,64", dtype="uint8").mode("append").save(path)

Filters on cz, cy and cx are pushed down (``spark.sql.python.filterPushdown.enabled``):
chunks have computed names, so that nothing is listed and only files of chunks
asked for are opened. A partition is a stretch of chunk numbers within the box
asked for, whatever the array's size; planning reads the metadata alone.

A task writes each chunk to another name and moves it, so that a repeated or
speculative task leaves the same whole file once; the metadata, by which readers
know an array, and what chunks there are, as runs of their numbers, are written
when all tasks have ended. A write that died before can be run again, and with
``resume`` leaves the chunks alone that are there.

Paths are those of pyarrow's file systems, or http URLs to read from; a file
system that Hadoop alone knows is read by ``arrays.read_chunks``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .codecs import DECODE, ENCODE, FILTERS, decode_chunk

AXES = ("cz", "cy", "cx")
SCHEMA = "cz int, cy int, cx int, data binary"
RUNS = ".available"


def _fetch(path: str) -> bytes | None:
    """A whole file, or None where there is none."""
    if path.startswith(("http://", "https://")):
        import urllib.error
        import urllib.request

        try:
            with urllib.request.urlopen(path, timeout=60) as f:
                return f.read()
        except urllib.error.HTTPError as e:
            if e.code in (403, 404):
                return None
            raise
    system, at = _system(path)
    try:
        with system.open_input_file(at) as f:
            return f.read()
    except FileNotFoundError:
        return None


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(path: str, content: bytes) -> None:
    """Write a file under another name, then move it to its own."""
    from pyarrow import fs

    system, at = _system(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as f:
        f.write(content)
    if system.type_name == "hdfs" and system.get_file_info(at).type != fs.FileType.NotFound:
        system.delete_file(at)  # a move there never replaces
    system.move(part, at)


def array_path(spec: str, level: str = "0") -> str:
    """Where an array lies: the spec itself if it is one or ends in the
    level, else its level."""
    spec = spec.rstrip("/")
    if spec.endswith(f"/{level}") or _fetch(f"{spec}/.zarray") is not None:
        return spec
    return f"{spec}/{level}"


@dataclass
class Stretch(InputPartition):
    """Chunks number ``first`` to ``last`` - 1 of a box, in order of z, y, x."""

    first: int
    last: int


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = array_path(options["path"], options.get("level", "0"))
        raw = _fetch(f"{self.path}/.zarray")
        if raw is None:
            raise FileNotFoundError(f"no array at {self.path}")
        self.meta = json.loads(raw)
        self.codec = (self.meta.get("compressor") or {}).get("id")
        self.filters = self.meta.get("filters") or []
        if self.codec not in DECODE or any(f["id"] not in FILTERS for f in self.filters):
            raise ValueError(f"codec {self.codec} or one of the filters is not available")
        self.each = int(options.get("chunks_per_partition", "64"))
        counts = [-(-n // c) for n, c in zip(self.meta["shape"], self.meta["chunks"], strict=True)]
        self.low, self.high = [0, 0, 0], counts
        self.kept: dict[int, set[int]] = {}

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if name not in AXES or not isinstance(value, int | tuple | list):
                yield f
                continue
            k = AXES.index(name)
            if isinstance(f, EqualTo):
                self.low[k], self.high[k] = max(self.low[k], value), min(self.high[k], value + 1)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low[k] = max(self.low[k], value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.high[k] = min(self.high[k], value + isinstance(f, LessThanOrEqual))
            elif isinstance(f, In) and all(isinstance(v, int) for v in value):
                found = set(value) & self.kept.get(k, set(value))
                self.kept[k] = found
                self.low[k], self.high[k] = max(self.low[k], min(found, default=self.high[k])), min(self.high[k], max(found, default=-1) + 1)
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        n = int(np.prod([max(0, b - a) for a, b in zip(self.low, self.high, strict=True)]))
        return [Stretch(at, min(n, at + self.each)) for at in range(0, n, self.each)] or [Stretch(0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        sizes = [b - a for a, b in zip(self.low, self.high, strict=True)]
        sep, shape, dtype = self.meta.get("dimension_separator", "."), self.meta["chunks"], np.dtype(self.meta["dtype"])
        for number in range(partition.first, partition.last):
            place = [int(a) + self.low[k] for k, a in enumerate(np.unravel_index(number, sizes))]
            if any(place[k] not in held for k, held in self.kept.items()):
                continue
            raw = _fetch(f"{self.path}/{sep.join(map(str, place))}")
            if raw is None:
                continue
            data = decode_chunk(raw, self.codec, self.filters)
            if len(data) != int(np.prod(shape)) * dtype.itemsize:
                raise ValueError(f"chunk {place} has another size than its metadata says")
            yield (*place, np.frombuffer(data, dtype).reshape(shape, order=self.meta.get("order", "C")).tobytes("C"))


@dataclass
class Written(WriterCommitMessage):
    """The numbers of the chunks that a task found or wrote, as runs."""

    runs: list[tuple[int, int]]


def runs_of(numbers: list[int]) -> list[tuple[int, int]]:
    """Ascending (first, last + 1) of neighbouring numbers."""
    out: list[list[int]] = []
    for n in sorted(set(numbers)):
        if out and out[-1][1] == n:
            out[-1][1] = n + 1
        else:
            out.append([n, n + 1])
    return [tuple(r) for r in out]


def joined_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of several tasks as one ascending list without overlaps."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [tuple(r) for r in out]


class ChunkWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        whole = lambda key: tuple(int(n) for n in options[key].split(","))
        self.path, self.shape, self.chunks = options["path"].rstrip("/"), whole("shape"), whole("chunks")
        self.dtype, self.codec = np.dtype(options.get("dtype", "uint8")), options.get("codec", "zlib")
        self.sep = options.get("separator", ".")
        self.resume = options.get("resume", "false") == "true"
        self.counts = [-(-n // c) for n, c in zip(self.shape, self.chunks, strict=True)]
        if self.codec not in ENCODE:
            raise ValueError(f"codec {self.codec} is not available")

    def _block(self, place: tuple, data: bytes) -> np.ndarray | None:
        """A whole chunk: one at the array's end may come as its part within
        the array, and what lies beyond is filled with its last values."""
        inside = tuple(min(c, n - k * c) for k, c, n in zip(place, self.chunks, self.shape, strict=True))
        size = len(data) // self.dtype.itemsize
        shape = self.chunks if size == int(np.prod(self.chunks)) else inside
        block = np.frombuffer(data, self.dtype).reshape(shape)[tuple(slice(0, n) for n in inside)]
        if not block.any():
            return None
        return np.pad(block, [(0, c - n) for c, n in zip(self.chunks, inside, strict=True)], mode="edge")

    def write(self, iterator: Iterator) -> Written:
        numbers = []
        for row in iterator:
            place = (row["cz"], row["cy"], row["cx"])
            if any(not 0 <= k < n for k, n in zip(place, self.counts, strict=True)):
                raise ValueError(f"chunk {place} lies outside the array")
            target = f"{self.path}/{self.sep.join(map(str, place))}"
            if not (self.resume and _fetch(target) is not None):
                block = self._block(place, bytes(row["data"]))
                if block is None:
                    continue
                _put(target, ENCODE[self.codec](block.tobytes()))
            numbers.append(int(np.ravel_multi_index(place, self.counts)))
        return Written(runs_of(numbers))

    def commit(self, messages: list) -> None:
        earlier = json.loads(_fetch(f"{self.path}/{RUNS}") or b"[]")
        runs = joined_runs([tuple(r) for r in earlier] + [r for m in messages if m for r in m.runs])
        _put(f"{self.path}/{RUNS}", json.dumps(runs).encode())
        compressor = None if self.codec is None else {"id": self.codec}
        meta = {"zarr_format": 2, "shape": list(self.shape), "chunks": list(self.chunks), "dtype": self.dtype.str, "compressor": compressor, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": self.sep}
        _put(f"{self.path}/.zarray", json.dumps(meta).encode())

    def abort(self, messages: list) -> None:
        """Chunks stay for a write that resumes; without metadata no reader
        takes them for an array."""


class ChunkedArrays(DataSource):
    """``chunked_array``: rows (cz, cy, cx, data) of a 3-D array."""

    @classmethod
    def name(cls) -> str:
        return "chunked_array"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(dict(self.options))


def available(path: str) -> list[tuple[int, int]]:
    """The runs of chunk numbers that a written array has."""
    return [tuple(r) for r in json.loads(_fetch(f"{path.rstrip('/')}/{RUNS}") or b"[]")]
