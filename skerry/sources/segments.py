"""Segment files as a Spark data source: tasks write whole segments, a manifest commits them.

``df.write.format("skerry_segments").option("rows", n).mode("append").save(folder)`` takes one
column of float vectors.  A segment belongs to the table once the manifest names it,
so what failed or repeated tasks leave is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from skerry.errors import CorruptedFile
from skerry.sources.tables import read_segment, write_segment

#: Vectors of a segment.
ROWS = 100_000
SCHEMA = "segment string, row long, vector array<float>"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifests(path: str) -> list[tuple[str, list[str]]]:
    """(name, segments) of each commit, in name order."""
    files, root = _open(path)
    found = [f for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".manifest")]
    out = []
    for f in sorted(found, key=lambda f: f.base_name):
        with files.open_input_stream(f.path) as s:
            out.append((f.base_name, json.loads(s.read())["segments"]))
    return out


@dataclass
class Written(WriterCommitMessage):
    segments: list[str]


class SegmentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int, overwrite: bool):
        self.path, self.rows, self.overwrite = path, rows, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.path)
        files.create_dir(root)
        held, n, names = [], 0, []

        def flush() -> None:
            nonlocal held, n
            if n:
                names.append(f"{uuid.uuid4().hex}.seg")
                with files.open_output_stream(f"{root}/{names[-1]}") as s:
                    s.write(write_segment(np.concatenate(held)))
            held, n = [], 0

        for batch in iterator:
            column = batch.column(0).drop_null()
            for lo in range(0, len(column), self.rows):
                part = column.slice(lo, self.rows)
                width = pc.unique(pc.list_value_length(part))
                if len(width) > 1:
                    raise ValueError("the vectors of a segment have one dimension")
                if n + len(part) > self.rows:
                    flush()
                held.append(part.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(part), -1))
                n += len(part)
        flush()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        files.create_dir(root)
        old = _manifests(self.path) if self.overwrite else []
        number = len(_manifests(self.path))
        with files.open_output_stream(f"{root}/{number:012d}-{uuid.uuid4().hex}.manifest") as s:
            s.write(json.dumps({"segments": [x for m in messages if m for x in m.segments]}).encode())
        for name, segments in old:
            for x in [name, *segments]:
                files.delete_file(f"{root}/{x}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        for x in [x for m in messages if m for x in m.segments]:
            files.delete_file(f"{root}/{x}")


class SegmentReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for _, segments in _manifests(self.path) for x in segments]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a table without segments
            return
        files, root = _open(self.path)
        try:
            with files.open_input_stream(f"{root}/{partition.value}") as s:
                x = read_segment(s.read())
        except FileNotFoundError as e:
            raise CorruptedFile(f"the manifest names {partition.value}, which is missing") from e
        for i in range(0, len(x), 10_000):
            part = x[i : i + 10_000]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, x.shape[1], dtype=np.int32)), pa.array(part.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array([partition.value] * len(part)), pa.array(np.arange(i, i + len(part))), lists], ["segment", "row", "vector"])


class Segments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skerry_segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SegmentReader:
        return SegmentReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> SegmentWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["array<float>"]:
            raise ValueError("segments hold one column of float vectors")
        return SegmentWriter(self.options["path"], int(self.options.get("rows", ROWS)), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(Segments)
