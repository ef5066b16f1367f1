"""Recorded answers of services and models as a data source of its own: ``spark.read.format("recorded_answers")``, and the same as a stream.

A recording is a folder of JSON lines, ``prompt=P/model=M/NAME.jsonl``; each line is one answer (`ANSWER`). Each file is a partition of the scan. Filters on prompt and model choose folders before any
file is opened. As a stream, an offset is the name of the last file in order, so a recorder adds files with growing names (a run number, a timestamp), and a
query that starts again from its checkpoint reads each file once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

ANSWER = "prompt string, model string, id string, content string, latency_ms double, input_tokens long, output_tokens long, status string"
NAMES = [c.split()[0] for c in ANSWER.split(", ")]
KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
#: Lines of a file that are handed on together.
LINES = 5000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path (file, HDFS, S3 ...), and the path within it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class Recording(InputPartition):
    """One file."""

    def __init__(self, name: str, prompt: str, model: str):
        super().__init__(name)
        self.name, self.prompt, self.model = name, prompt, model


def recordings(path: str, prompts: set[str] | None = None, models: set[str] | None = None) -> list[Recording]:
    """The files of a recording, by file name and then folder; only folders of the given prompts and models are listed."""
    store, root = opened(path)

    def within(folder: str, field: str, wanted: set[str] | None) -> Iterator[tuple[str, str]]:
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.type == fs.FileType.Directory and info.base_name.startswith(f"{field}="):
                value = unquote(info.base_name[len(field) + 1 :])
                if wanted is None or value in wanted:
                    yield value, info.path

    found = []
    for prompt, folder in within(root, "prompt", prompts):
        for model, inner in within(folder, "model", models):
            found += [Recording(x.path, prompt, model) for x in store.get_file_info(fs.FileSelector(inner)) if x.is_file and x.base_name.endswith((".jsonl", ".json")) and not x.base_name.startswith((".", "_"))]
    return sorted(found, key=offset_of)


def offset_of(file: Recording) -> tuple[str, str, str]:
    return file.name.rpartition("/")[2], file.prompt, file.model


def answers(path: str, file: Recording) -> Iterator[pa.RecordBatch]:
    store, _ = opened(path)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        full = [r | {"prompt": file.prompt, "model": file.model} for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in full], kind) for n, kind in zip(NAMES, KINDS, strict=True)], NAMES)

    held: list[dict] = []
    with store.open_input_stream(file.name) as stream:
        import io

        for line in io.TextIOWrapper(stream, "utf-8"):
            if line.strip():
                held.append(json.loads(line))
            if len(held) >= LINES:
                yield batch(held)
                held = []
    if held:
        yield batch(held)


class AnswerReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.prompts, self.models = path, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("prompt",), ("model",)):
                yield f  # Spark's own work
            elif f.attribute == ("prompt",):
                self.prompts = set(values) if self.prompts is None else self.prompts & set(values)
            else:
                self.models = set(values) if self.models is None else self.models & set(values)

    def partitions(self) -> Sequence[InputPartition]:
        return recordings(self.path, self.prompts, self.models)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # no file at all
            yield from answers(self.path, partition)


class AnswerStream(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most, self.last = path, most, None

    def initialOffset(self) -> dict:
        return {"name": "", "prompt": "", "model": ""}

    def latestOffset(self) -> dict:
        """The end of the next batch: at most ``most`` files beyond the last one handed out."""
        start = self.last or self.initialOffset()
        ahead = [offset_of(f) for f in recordings(self.path) if offset_of(f) > tuple(start.values())][: self.most]
        if ahead:
            self.last = dict(zip(("name", "prompt", "model"), ahead[-1], strict=True))
        return self.last or start

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.last = max(self.last or end, end, key=lambda x: tuple(x.values()))  # after a restart, the checkpoint's offset comes first
        return [f for f in recordings(self.path) if tuple(start.values()) < offset_of(f) <= tuple(end.values())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from answers(self.path, partition)


class RecordedAnswers(DataSource):
    """Options: path; files_per_batch of a stream (1,000)."""

    @classmethod
    def name(cls) -> str:
        return "recorded_answers"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema) -> DataSourceReader:
        return AnswerReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return AnswerStream(self.options["path"], int(self.options.get("files_per_batch", 1000)))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters going down to the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedAnswers)


def record(rows: DataFrame, path: str) -> None:
    """Writes answers (`ANSWER`) as a recording, one file or more for each prompt and model."""
    full = rows.select(*NAMES)
    full.hint("rebalance", "prompt", "model").write.mode("append").partitionBy("prompt", "model").option("ignoreNullFields", "false").json(path)


def folder_name(field: str, value: str) -> str:
    return f"{field}={quote(value, safe='')}"
