"""Project folders listed and read by executors, one task a root.

Spark's own file sources pass over files of zero bytes and names that begin with ``_`` or ``.``. Project
folders hold such files (empty models, ``_models.yml``), so this data source lists folders itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tributary.sources.files import SKIPPED_FOLDERS

_NAME = "tributary_files"


class _Root(InputPartition):
    def __init__(self, root: str):
        self.root = root


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.suffixes = tuple(json.loads(options["suffixes"]))
        self.skipped = frozenset(json.loads(options["skipped"]))
        self.content = options["content"] == "true"

    def partitions(self) -> Sequence[InputPartition]:
        return [_Root(root) for root in self.roots]

    def read(self, partition: _Root | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # without any root Spark still runs one task
            return
        system, base = fs.FileSystem.from_uri(partition.root) if "://" in partition.root else (fs.LocalFileSystem(), partition.root)
        base = base.rstrip("/") or "/"
        todo = [base]  # one folder at a time, so memory holds a folder's entries, not the tree's
        while todo:
            for found in system.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
                if found.type == fs.FileType.Directory:
                    if found.base_name not in self.skipped:
                        todo.append(found.path)
                elif found.type == fs.FileType.File and found.base_name.lower().endswith(self.suffixes):
                    content = None
                    if self.content:
                        with system.open_input_stream(found.path) as stream:
                            content = stream.read()
                    yield partition.root, found.path[len(base):].lstrip("/"), found.size, content


class ProjectFiles(DataSource):
    """``spark.read.format("tributary_files")``; see :func:`listed_files`."""

    @classmethod
    def name(cls) -> str:
        return _NAME

    def schema(self) -> str:
        return "root string, path string, bytes bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def listed_files(
    spark: SparkSession,
    roots: Sequence[str],
    suffixes: Sequence[str] = ("",),
    content: bool = False,
    skipped: Sequence[str] = SKIPPED_FOLDERS,
) -> DataFrame:
    """Files below each of ``roots``: ``root, path`` (below the root), ``bytes, content`` (null unless asked for).

    Names end with one of ``suffixes``, whatever their case; folders named in ``skipped`` are not entered.
    Empty files and names that begin with ``_`` or ``.`` are listed as any other. A root that does not exist
    gives no rows. Roots are local paths or URIs of file systems that pyarrow knows; a task reads one
    root, file by file.
    """
    spark.dataSource.register(ProjectFiles)
    options = {"roots": list(roots), "suffixes": [s.lower() for s in suffixes], "skipped": list(skipped)}
    reader = spark.read.format(_NAME).options(**{k: json.dumps(v) for k, v in options.items()})
    return reader.option("content", str(content).lower()).load()


def sql_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """All ``*.sql`` of each root: ``project_id`` (the root), ``relative_path, raw_sql``; empty files have empty text."""
    return listed_files(spark, roots, [".sql"], content=True).selectExpr(
        "root AS project_id", "path AS relative_path", "CAST(content AS STRING) AS raw_sql"
    )
