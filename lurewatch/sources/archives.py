"""Archives as a data source: the lines, or the entries of the JSON documents, of their members.

A member of a zip archive is a partition of its own; a gzipped tar can only be read from its start, so each is one partition.
Plain files share a partition up to a size, so that many small ones are few tasks. Members are decompressed in pieces: a task holds one piece, and the line or entry that it ends in, however large a member is.
"""

from __future__ import annotations

import json
import re
import tarfile
import zipfile
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PIECE = 1 << 20
#: What a partition of several plain files holds at most, and what opening a file counts for in it.
PART, OPENING = 32 << 20, 64 << 10
BROKEN = "\x00broken"
#: Files that are no archives and are their own only member.
PLAIN = (".json", ".jsonl", ".txt", ".lock")
SCHEMA = "archive string, member string, nth long, key string, value string"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("nth", pa.int64()), ("key", pa.string()), ("value", pa.string())])


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def lines(pieces: Iterator[bytes]) -> Iterator[str]:
    """Lines without their ends; the last one may have none."""
    rest = b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n")
        for x in whole:
            yield x.removesuffix(b"\r").decode("utf-8", "replace")
    if rest:
        yield rest.removesuffix(b"\r").decode("utf-8", "replace")


def entries(pieces: Iterator[bytes], path: tuple[str, ...] = ()) -> Iterator[tuple[str | None, str]]:
    """(key, value as JSON text) of the entries of a JSON array (key None) or object, one after another.

    With a path they are those of the array or object under its keys. A document that is broken anywhere is an error, as soon
    as that is seen.
    """
    decoder, text, at, more = json.JSONDecoder(), "", 0, _decoded(pieces)
    stack: list[list[bool]] = []  # the open containers on the path: is it an object, and is a value (not a comma) next
    opening = True
    while True:
        at = _skip(text, at)
        if at >= len(text) - 1:
            piece = next(more, None)
            if piece is not None:
                text, at = text[at:] + piece, 0
                continue
            if at >= len(text):
                raise ValueError("the document ends too soon")
        c = text[at]
        if opening:
            if c not in "[{":
                raise ValueError("neither an array nor an object")
            stack.append([c == "{", True])
            opening, at = False, at + 1
        elif c in "]}":
            stack.pop()
            at += 1
            if not stack:
                return
        elif c == "," and not stack[-1][1]:
            stack[-1][1], at = True, at + 1
        elif not stack[-1][1]:
            raise ValueError("a comma is missing")
        else:
            try:
                key, end = decoder.raw_decode(text, at) if stack[-1][0] else (None, at)
                if stack[-1][0]:
                    end = _skip(text, end)
                    if end >= len(text):
                        raise ValueError("incomplete")
                    if text[end] != ":":
                        raise KeyError(text[at : at + 40])
                    end = _skip(text, end + 1)
                if key is not None and len(stack) <= len(path) and key == path[len(stack) - 1] and text[end : end + 1] in ("[", "{"):
                    stack[-1][1], opening, at = False, True, end
                    continue
                stop = decoder.raw_decode(text, end)[1]
                if text[stop : stop + 1] not in (" ", "\t", "\r", "\n", ",", "]", "}"):
                    raise ValueError("a number may go on")
            except ValueError:
                # the value may end in a later piece; as much again as there is keeps the work in proportion
                wanted, got = len(text) - at, []
                while sum(map(len, got)) < max(1, wanted) and (piece := next(more, None)) is not None:
                    got.append(piece)
                if not got:
                    raise
                text, at = text[at:] + "".join(got), 0
                continue
            if len(stack) > len(path):
                yield key, text[end:stop]
            stack[-1][1], at = False, stop


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in " \t\r\n":
        at += 1
    return at


def _decoded(pieces: Iterator[bytes]) -> Iterator[str]:
    """Pieces of text; a character that is cut in two goes into the later piece."""
    rest = b""
    for piece in pieces:
        data = rest + piece
        cut = len(data)
        for back in range(1, min(4, len(data)) + 1):
            if data[-back] >= 0xC0:
                cut = len(data) - back if back < (2 if data[-back] < 0xE0 else 3 if data[-back] < 0xF0 else 4) else cut
                break
            if data[-back] < 0x80:
                break
        rest = data[cut:]
        yield data[:cut].decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")


def pieces(stream: IO[bytes], size: int = PIECE) -> Iterator[bytes]:
    while data := stream.read(size):
        yield data


def members(file: IO[bytes], path: str, only: str | None = None) -> Iterator[tuple[str, IO[bytes]]]:
    """(name, open stream) of an archive's files, one after another."""
    if path.endswith(PLAIN):
        yield path.rpartition("/")[2], file
    elif path.endswith(".zip"):
        with zipfile.ZipFile(file) as z:
            for name in [only] if only is not None else [n for n in z.namelist() if not n.endswith("/")]:
                with z.open(name) as stream:
                    yield name, stream
    else:
        with tarfile.open(fileobj=file, mode="r|*") as t:
            for member in t:
                if member.isfile():
                    yield member.name, t.extractfile(member)


class ArchivePart(InputPartition):
    """Members of archives: (path, member), where None stands for all members."""

    def __init__(self, members: list[tuple[str, str | None]]):
        super().__init__(None)
        self.members = members


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.mode = options["path"], options.get("mode", "lines")
        self.rows, self.piece = int(options.get("rows", "4096")), int(options.get("piece", str(PIECE)))
        self.at, self.lenient = json.loads(options.get("at", "{}")), options.get("lenient", "false") == "true"
        self.names, self.tasks = re.compile(options.get("names", "")), int(options.get("tasks", "1"))
        if self.mode not in ("lines", "entries"):
            raise ValueError(f"unknown mode {self.mode!r}")

    def partitions(self) -> list[ArchivePart]:
        where, path = store(self.path)
        info = where.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(path, recursive=True))
        parts, plain = [], []
        for f in sorted(found, key=lambda f: f.path):
            name = f.path.rpartition("/")[2]
            if f.type != fs.FileType.File or name.startswith(("_", ".")) or not self.names.search(f.path):
                continue
            if name.endswith(".zip"):
                with where.open_input_file(f.path) as file, zipfile.ZipFile(file) as z:
                    parts += [ArchivePart([(f.path, n)]) for n in z.namelist() if not n.endswith("/")]
            elif name.endswith(PLAIN):
                plain.append((f.path, (f.size or 0) + OPENING))
            else:
                parts.append(ArchivePart([(f.path, None)]))
        most, size = min(PART, -(-sum(s for _, s in plain) // self.tasks)), 0
        for i, (path, own) in enumerate(plain):
            size += own
            if i == 0 or size > most:
                parts.append(ArchivePart([]))
                size = own
            parts[-1].members.append((path, None))
        return parts

    def read(self, part: ArchivePart) -> Iterator[pa.RecordBatch]:
        where, _ = store(self.path)
        for path, member in part.members:
            with where.open_input_file(path) as file:
                for name, stream in members(file, path, member):
                    held, size, first = [], 0, 0
                    for nth, pair in enumerate(self._cut(name, pieces(stream, self.piece))):
                        held.append(pair)
                        size += len(pair[1] or "")
                        if len(held) >= self.rows or size >= self.piece:
                            yield self._batch(path, name, first, held)
                            held, size, first = [], 0, nth + 1
                    if held:
                        yield self._batch(path, name, first, held)

    def _cut(self, name: str, pieces: Iterator[bytes]) -> Iterator[tuple[str | None, str | None]]:
        if self.mode == "lines":
            yield from ((None, x) for x in lines(pieces))
            return
        try:
            yield from entries(pieces, tuple(self.at.get(name, ())))
        except (ValueError, KeyError):
            if not self.lenient:
                raise
            yield BROKEN, None

    def _batch(self, path: str, name: str, first: int, held: list[tuple[str | None, str | None]]) -> pa.RecordBatch:
        n, (keys, values) = len(held), zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([name] * n), pa.array(range(first, first + n), pa.int64()), pa.array(keys, pa.string()), pa.array(values, pa.string())], schema=_ARROW)


class ArchiveSource(DataSource):
    """Options: path (a file or a folder), names (a pattern of the paths that are read), mode (lines or entries), at (by member
    name, the keys of the entries' container, as JSON), lenient (a broken document ends with a row of the key BROKEN and no
    value, instead of an error), rows and piece (what a task holds at most), tasks (how many the plain files fill, if they can)."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archive(spark: SparkSession, path: str, mode: str = "lines", **options: str) -> DataFrame:
    """(archive, member, nth, key, value): every line or JSON entry of the members; a broken archive is an error."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").options(**{"mode": mode, "tasks": str(spark.sparkContext.defaultParallelism)} | options).load(path)
