"""Data sources of rendered verses and annotations: one file a verse, written by tasks and committed together.

    rendered.write.format("verse_files").option("suffix", ".html").mode("append").save(path)
    spark.read.format("verse_files").option("suffix", ".html").load(path)

Rows are (verse_id string, text string). A task writes its files below `_trial/<its own name>`; only
what tasks commit is moved to its place, so that a task that is run again, or twice at once, leaves
one file a verse, and a write that fails leaves none. A verse that is written again replaces its
file. Null texts and ids aren't written; several rows of one verse in one write: the last in the
task's order stays. File names are the ids, with what isn't safe in a name escaped.
"""

from __future__ import annotations

import os
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

TRIAL = "_trial"
FILES_A_TASK = 1000


def _open(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


@dataclass
class Files(WriterCommitMessage):
    folder: str
    names: list


@dataclass
class Names(InputPartition):
    names: list


class VerseFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "verse_files"

    def schema(self) -> str:
        return "verse_id string, text string"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"], self.options.get("suffix", ".txt"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"], self.options.get("suffix", ".txt"), overwrite)


class Reader(DataSourceReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def partitions(self) -> list:
        from pyarrow import fs

        system, path = _open(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(self.suffix))
        return [Names(names[i : i + FILES_A_TASK]) for i in range(0, len(names), FILES_A_TASK)] or [Names([])]

    def read(self, partition: Names) -> Iterator[tuple]:
        system, path = _open(self.path)
        for name in partition.names:
            with system.open_input_file(f"{path}/{name}") as f:
                yield urllib.parse.unquote(name[: len(name) - len(self.suffix)]), f.read().decode()


class Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite, self.job = path, suffix, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Files:
        system, path = _open(self.path)
        folder = f"{TRIAL}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(f"{path}/{folder}", recursive=True)
        names = {}
        for verse_id, text in rows:
            if verse_id is None or text is None:
                continue
            name = urllib.parse.quote(str(verse_id), safe="") + self.suffix
            with system.open_output_stream(f"{path}/{folder}/{name}") as f:
                f.write(text.encode())
            names[name] = True
        return Files(folder, list(names))

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, path = _open(self.path)
        done = [m for m in messages if m is not None]
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.is_file and f.base_name.endswith(self.suffix):
                    system.delete_file(f.path)
        for m in done:
            for name in m.names:
                system.move(f"{path}/{m.folder}/{name}", f"{path}/{name}")
        self._clean(system, path)

    def abort(self, messages: list) -> None:
        self._clean(*_open(self.path))

    def _clean(self, system, path: str) -> None:
        from pyarrow import fs

        trial = f"{path}/{TRIAL}/{self.job}"
        if system.get_file_info(trial).type != fs.FileType.NotFound:
            system.delete_dir(trial)
        left = system.get_file_info(fs.FileSelector(f"{path}/{TRIAL}", allow_not_found=True))
        if not left and system.get_file_info(f"{path}/{TRIAL}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/{TRIAL}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VerseFiles)
