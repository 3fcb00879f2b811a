"""Streaming sinks that hold each row once: event JSON, window CSV, display lines.

Tasks write text files under names of their own; a trigger counts once its manifest
``_commits/<writer_id>-<batch>.json`` names them.  A trigger that is repeated after a failure finds
its manifest there and drops what it wrote again; files of killed attempts are named by no
manifest, so no reader sees them.  ``writer_id`` names the query: a query that goes on from its
checkpoint keeps it, a new query takes a new one.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from radiolake.functions.formats import with_line
from radiolake.operators.conform import conform_pdus
from radiolake.sources.files import locate
from radiolake.sources.sinks import window_csv

_COMMITS = "_commits"


def _checked(path: str | None, writer_id: str | None) -> tuple[str, str]:
    if not path or not re.fullmatch(r"[A-Za-z0-9_.]+", writer_id or ""):
        raise ValueError("path and writer_id (letters, digits, _ and .) are required")
    return path, writer_id


@dataclass
class Written(D.WriterCommitMessage):
    """What a task wrote: a file (none for no rows) and its lines."""

    file: str | None
    lines: int


class CommittedText(D.DataSourceStreamWriter):
    def __init__(self, path: str, writer_id: str):
        self.path, self.writer_id = path.rstrip("/"), writer_id

    def _at(self, *names: str):
        system, inner = locate(self.path)
        return system, "/".join([inner.rstrip("/"), *names])

    def write(self, rows: Iterator[Row]) -> Written:
        first = next(rows, None)
        if first is None:
            return Written(None, 0)
        name, lines = f"{self.writer_id}-{uuid.uuid4().hex}.txt", 0
        system, data = self._at("data")
        system.create_dir(data, recursive=True)
        with system.open_output_stream(f"{data}/{name}") as out:
            row = first
            while row is not None:
                out.write((row[0] or "").encode() + b"\n")
                lines += 1
                row = next(rows, None)
        return Written(name, lines)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        from pyarrow import fs

        system, folder = self._at(_COMMITS)
        name = f"{folder}/{self.writer_id}-{batchId:020d}.json"
        if system.get_file_info(name).type == fs.FileType.File:
            self.abort(messages, batchId)  # the trigger ran before: its first files count
            return
        system.create_dir(folder, recursive=True)
        done = [m for m in messages if m is not None and m.file is not None]
        body = {"batch": batchId, "files": [m.file for m in done], "lines": sum(m.lines for m in done)}
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps(body).encode())
        system.move(draft, name)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        system, data = self._at("data")
        for m in messages:
            if m is not None and m.file is not None:
                system.delete_file(f"{data}/{m.file}")


class CommittedTextSink(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed_text"

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> CommittedText:
        if len(schema.fields) != 1 or not isinstance(schema.fields[0].dataType, T.StringType):
            raise ValueError("one column of text is required")
        if overwrite:
            raise ValueError("only output mode append is supported")
        return CommittedText(*_checked(self.options.get("path"), self.options.get("writer_id")))


def _start(lines: DataFrame, path: str, writer_id: str, checkpoint: str, **trigger) -> StreamingQuery:
    _checked(path, writer_id)
    lines.sparkSession.dataSource.register(CommittedTextSink)
    out = lines.writeStream.format("committed_text").option("path", path).option("writer_id", writer_id)
    out = out.option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()


def stream_pdus(df: DataFrame, path: str, writer_id: str, checkpoint: str, include_raw_bits: bool = False, **trigger) -> StreamingQuery:
    """The event JSON of ``write_pdus``, one object per line."""
    out = conform_pdus(df)
    if not include_raw_bits:
        out = out.drop("raw_bits")
    return _start(out.select(F.to_json(F.struct("*")).alias("value")), path, writer_id, checkpoint, **trigger)


def stream_window_csv(reports: DataFrame, path: str, writer_id: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The rows of ``write_window_csv`` without header lines."""
    return _start(window_csv(reports).select(F.to_csv(F.struct("*")).alias("value")), path, writer_id, checkpoint, **trigger)


def stream_lines(df: DataFrame, path: str, writer_id: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The display lines of ``write_lines``."""
    return _start(with_line(df).select("line"), path, writer_id, checkpoint, **trigger)


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """(value, batch) of every committed line; batch numbers are those of its writer."""
    path = path.rstrip("/")
    commits = spark.read.schema("batch long, files array<string>, lines long").json(f"{path}/{_COMMITS}")
    files = commits.select("batch", F.explode("files").alias("_file"))
    lines = spark.read.text(f"{path}/data").withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return lines.join(files, "_file").select("value", "batch")
