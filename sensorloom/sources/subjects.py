"""A data source of folders with one delimited file a subject, whose columns may be in any order or missing.

A partition is a bundle of files, of at most ``FILES`` and about ``BYTES``, so that a task's start is shared by many small files;
few files are spread over ``TASKS``. A file's header is read first, by the task that reads the file, and columns are taken by
name; the file then streams through in blocks. The subject's number comes from the path. A filter on it, pushed down or given as ``keys``,
leaves only the files of those subjects: no other file is opened. Files are found through ``pyarrow.fs``, so any store that
it knows will do. An empty file has no rows; a path without a number gives a null subject.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType


#: The setting under which Spark pushes filters to Python sources.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


#: Files and bytes of a task, and tasks that few files are spread over.
FILES, BYTES, TASKS = 1_000, 32 << 20, 64


@dataclass
class SubjectBundle(InputPartition):
    """Files of a task: (subject, path)."""

    files: list[tuple[int | None, str]]


def bundles(files: Sequence[tuple[int | None, str, int]]) -> Iterator[SubjectBundle]:
    """Bundles of (subject, path, bytes) in order; a file isn't divided."""
    most = min(FILES, -(-len(files) // TASKS))
    part, held = [], 0
    for pid, path, size in files:
        if part and (len(part) >= most or held + size > BYTES):
            yield SubjectBundle(part)
            part, held = [], 0
        part.append((pid, path))
        held += size
    if part:
        yield SubjectBundle(part)


class SubjectReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern, self.sep = options["path"], options.get("pattern", r"(\d+)"), options.get("sep", ",")
        self.columns: list[str] = json.loads(options["columns"])
        self.keys: set | None = set(json.loads(options["keys"])) if options.get("keys") else None

    def _only(self, keys: set) -> None:
        self.keys = keys if self.keys is None else self.keys & keys

    def partitions(self) -> list[SubjectBundle]:
        store, root = FileSystem.from_uri(self.path if ":/" in self.path else f"file://{self.path}")
        found = []
        for info in store.get_file_info(FileSelector(root, recursive=True)):
            if info.is_file and info.size and not info.base_name.startswith(("_", ".")):
                number = re.search(self.pattern, info.path[len(root) :])
                pid = int(number[1]) if number else None
                if self.keys is None or pid in self.keys:
                    found.append((pid, info.path, info.size))
        return list(bundles(sorted(found, key=lambda p: p[1])))

    def read(self, partition: SubjectBundle) -> Iterator[pa.RecordBatch]:
        store, _ = FileSystem.from_uri(self.path if ":/" in self.path else f"file://{self.path}")
        names = pa.csv.ConvertOptions(include_columns=self.columns, include_missing_columns=True, column_types=dict.fromkeys(self.columns, pa.string()), strings_can_be_null=True, null_values=[""])
        for pid, path in partition.files:
            with store.open_input_stream(path) as stream:
                for block in pa.csv.open_csv(stream, parse_options=pa.csv.ParseOptions(delimiter=self.sep), convert_options=names):
                    yield pa.RecordBatch.from_arrays([pa.array([pid] * block.num_rows, pa.int64()), *(block[c].cast(pa.string()) for c in self.columns)], ["pid", *self.columns])


class FilteringReader(SubjectReader):
    """For sessions that push filters to Python sources (``PUSHDOWN``)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality and lists of subjects; what it doesn't take Spark does."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("pid",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("pid",):
                self._only(set(f.value))
            else:
                yield f


class Subjects(DataSource):
    """Options: path, columns (a JSON list), pattern of the number in the path, sep, keys (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "subject_files"

    def schema(self) -> StructType:
        return StructType([StructField("pid", LongType()), *(StructField(c, StringType()) for c in json.loads(self.options["columns"]))])

    def reader(self, schema: StructType) -> SubjectReader:
        options = {k: self.options[k] for k in ("path", "columns", "pattern", "sep", "keys") if k in self.options}
        return (FilteringReader if self.options.get("push") == "true" else SubjectReader)(options)


def subject_rows(spark: SparkSession, path: str, columns: Sequence[str], pattern: str = r"(\d+)", sep: str = ",", keys: Sequence[int] | None = None) -> DataFrame:
    """(pid, columns as text) of a folder; only the files of ``keys`` where given."""
    spark.dataSource.register(Subjects)
    options = {"columns": json.dumps(list(columns)), "pattern": pattern, "sep": sep, "push": spark.conf.get(PUSHDOWN, "false")} | ({"keys": json.dumps(list(keys))} if keys is not None else {})
    return spark.read.format("subject_files").options(**options).load(path)
