"""Writing changed files back, with commit and abort.

A Python data source stages each new text beside its file and notes it in a manifest of
the task; nothing is replaced while the job runs.  Commit marks the manifests of the
tasks that count, abort removes what was staged.  A second job, dealt by manifest, puts
the staged files in place; it can run again after a failure and ends the same.  Paths go
to the file system that their URI names (a plain path is the executors' mount).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "treeflow_files"
COMMITTED = "_committed"


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _write(path: str, data: bytes) -> None:
    system, where = _file_system(path)
    with system.open_output_stream(where) as out:
        out.write(data)


def _exists(path: str) -> bool:
    from pyarrow import fs

    system, where = _file_system(path)
    return system.get_file_info(where).type == fs.FileType.File


def _delete(path: str) -> None:
    if _exists(path):
        system, where = _file_system(path)
        system.delete_file(where)


@dataclass
class Staged(WriterCommitMessage):
    manifest: str


class FilesWriter(DataSourceWriter):
    """Rows path, content; content null means that the file goes."""

    def __init__(self, options: dict[str, str]):
        self.manifests = options["manifests"]

    def write(self, rows: Iterator) -> Staged:
        tag = uuid.uuid4().hex
        noted = []
        try:
            for r in rows:
                staged = None if r["content"] is None else f"{r['path']}.{tag}.staged"
                if staged is not None:
                    _write(staged, r["content"].encode("utf-8", "surrogatepass"))
                noted.append({"path": r["path"], "staged": staged})
            manifest = f"{self.manifests}/{tag}.json"
            _write(manifest, "".join(json.dumps(x) + "\n" for x in noted).encode())
        except BaseException:
            for x in noted:
                if x["staged"]:
                    _delete(x["staged"])
            raise
        return Staged(manifest)

    def commit(self, messages: list) -> None:
        _write(f"{self.manifests}/{COMMITTED}", "".join(m.manifest + "\n" for m in messages if m is not None).encode())

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                for x in _entries(m.manifest):
                    if x["staged"]:
                        _delete(x["staged"])
                _delete(m.manifest)


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options)


def _entries(manifest: str) -> list[dict]:
    system, where = _file_system(manifest)
    with system.open_input_stream(where) as f:
        return [json.loads(x) for x in f.read().decode().splitlines()]


def stage(files: DataFrame, folder: str) -> str:
    """Stages files (path, content or null) and commits their manifests in folder, which is returned."""
    from pyarrow import fs

    spark = files.sparkSession
    spark.dataSource.register(FilesSink)
    system, where = _file_system(folder)
    if system.get_file_info(where).type == fs.FileType.NotFound:
        system.create_dir(where, recursive=True)
    files.select("path", "content").write.format(FORMAT).mode("append").option("manifests", folder).save()
    return folder


def put_in_place(spark: SparkSession, folder: str) -> None:
    """Moves what a committed folder of manifests staged to its place; may run any number of times."""
    if not _exists(f"{folder}/{COMMITTED}"):
        raise ValueError(f"{folder}: nothing was committed")
    system, where = _file_system(f"{folder}/{COMMITTED}")
    with system.open_input_stream(where) as f:
        manifests = f.read().decode().splitlines()  # one a task
    if not manifests:
        return

    def move(rows) -> None:
        for r in rows:
            for x in _entries(r["manifest"]):
                if x["staged"] is None:
                    _delete(x["path"])
                elif _exists(x["staged"]):  # else an earlier run has moved it
                    system, source = _file_system(x["staged"])
                    system.move(source, _file_system(x["path"])[1])

    spark.createDataFrame([(m,) for m in manifests], "manifest string").repartition(len(manifests)).foreachPartition(move)
