"""Streams of XML that is still being written, and a sink that gives each row once.

The source follows a folder of XML files that grow, such as a simulation's output or what a receiver appends from a socket
(a socket itself can't be read again after a failure, so its bytes belong into a file first). Its offsets are bytes of each
file up to the end of its last complete element. A range of bytes between two offsets is read in splits by the executors:
an element belongs to the split in which its tag begins. Reading a range again gives the same rows, so a query that is
restarted from its checkpoint continues where its last finished batch ended.

The sink writes a batch to a folder of its own, named by the batch's number, and a batch that is run again replaces it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.session import ship

BLOCK = 1 << 20


class _Range(InputPartition):
    def __init__(self, file: str, begin: int, end: int, until: int):
        self.file, self.begin, self.end, self.until = file, begin, end, until


class XmlSteps(DataSource):
    """`format("xml_steps")`: options path (a folder), row_tag, child_tag, split_bytes; a row for each child of each element.

    Columns are named <tag>_<attribute> and are strings; an element without children gives a row with nulls for them.
    """

    @classmethod
    def name(cls) -> str:
        return "xml_steps"

    def schema(self) -> StructType:
        raise ValueError("xml_steps needs a schema with columns <tag>_<attribute>")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Steps(self.options, schema.fieldNames())


class _Steps(DataSourceStreamReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path = options["path"]
        self.row, self.child = options.get("row_tag", "timestep"), options.get("child_tag", "vehicle")
        self.split = int(options.get("split_bytes", 16 << 20))
        self.columns = columns

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:  # noqa: N802
        system, folder = fs.FileSystem.from_uri(self.path)
        found = {}
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.is_file and not info.base_name.startswith((".", "_", "~")):
                found[info.path] = _last_end(system, info.path, info.size, self.row)
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        have, want = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for file, until in sorted(want.items()):
            at = have.get(file, 0)
            while at < until:
                out.append(_Range(file, at, min(at + self.split, until), until))
                at += self.split
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        wanted = [c.partition("_")[::2] for c in self.columns]
        with system.open_input_file(partition.file) as data:
            for text in elements(data, partition.begin, partition.end, partition.until, self.row):
                step = ElementTree.fromstring(text)
                for child in list(step.iterfind(self.child)) or [None]:
                    yield tuple(
                        step.get(name) if tag == self.row else child.get(name) if child is not None and tag == self.child else None
                        for tag, name in wanted
                    )

    def commit(self, end: dict) -> None:
        """Nothing is kept for a batch, so nothing is to be released."""


def _open_tag(tag: str) -> re.Pattern[bytes]:
    return re.compile(rb"<" + tag.encode() + rb"(?=[\s/>])")


def _last_end(system: fs.FileSystem, path: str, size: int, tag: str) -> int:
    """Bytes up to the end of the file's last complete element: reads back from the end, not the whole file."""
    with system.open_input_file(path) as data:
        at, tail = size, b""
        while at > 0:
            begin = max(0, at - BLOCK)
            data.seek(begin)
            tail = data.read(at - begin) + tail
            at = begin
            for start in [m.start() for m in _open_tag(tag).finditer(tail)][::-1]:
                length = _length(tail[start:], tag)
                if length is not None:
                    return begin + start + length
    return 0


def _length(text: bytes, tag: str) -> int | None:
    """Bytes of the element that text begins with; None if its end isn't there."""
    head = re.match(rb"""<(?:[^>"']|"[^"]*"|'[^']*')*>""", text)
    if head is None:
        return None
    if head.group().endswith(b"/>"):
        return head.end()
    close = re.compile(rb"</" + tag.encode() + rb"\s*>").search(text, head.end())
    return close.end() if close else None


def elements(data, begin: int, end: int, until: int, tag: str) -> Iterator[bytes]:
    """The elements whose tag begins in [begin, end); they may go on to `until`. Holds a block and an element at most."""
    opening = _open_tag(tag)
    at, held = begin, b""  # held: bytes from `at` on that were read
    data.seek(begin)
    while at < end:
        found = opening.search(held)
        if found and at + found.start() >= end:
            return
        length = _length(held[found.start() :], tag) if found else None
        if length is not None:
            yield held[found.start() : found.start() + length]
            at, held = at + found.start() + length, held[found.start() + length :]
            continue
        more = data.read(min(BLOCK, until - at - len(held)))
        if not more:
            return
        if not found:  # a tag may be cut by the end of what is held
            keep = min(len(held), len(tag) + 1)
            at, held = at + len(held) - keep, held[len(held) - keep :]
        held += more


def read_xml_stream(spark: SparkSession, path: str, schema: str, row_tag: str = "timestep", child_tag: str = "vehicle", split_bytes: int = 16 << 20) -> DataFrame:
    """A stream of the elements in a folder's growing XML files; schema: string columns <tag>_<attribute>."""
    ship(spark)
    spark.dataSource.register(XmlSteps)
    reader = spark.readStream.format("xml_steps").schema(schema)
    uri = path if "://" in path else f"file://{path}"
    return reader.option("row_tag", row_tag).option("child_tag", child_tag).option("split_bytes", split_bytes).load(uri)


def write_once(
    stream: DataFrame, path: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, **trigger
) -> StreamingQuery:
    """Writes each batch to path/batch=<number> as Parquet. A batch that is run again after a failure replaces its folder.

    after: called with each batch and its number when it is written. Read all of it with spark.read.parquet(path).
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if after:
            after(batch, number)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
