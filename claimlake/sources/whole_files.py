"""Rows as whole files: a sink with a commit protocol, for what other programs read as files.

Tasks write into a staging folder beside the target, each file under a name of its attempt and then renamed, so a task that
runs twice leaves the same files. A commit puts the staging folder in the target's place in one rename; a refusal or a failed
job removes it. Contents stay in the tasks, only notes (a short string a file) come back.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, content binary, note string"


def safe(path: str | None) -> bool:
    """Whether a relative path stays below its folder."""
    return bool(path) and not posixpath.isabs(path) and ".." not in path.split("/") and "\\" not in path and "\0" not in path


def place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI (local, or any that Arrow reaches by its scheme), and the path in it."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme != "file" and rest.startswith("//"):
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), posixpath.abspath("/" + rest.lstrip("/") if colon and scheme == "file" else path)


@dataclass
class Written(WriterCommitMessage):
    notes: list[str] = field(default_factory=list)
    refused: int = 0


class FilesWriter(DataSourceWriter):
    def __init__(self, target: str, notes: str | None, add: bool = False):
        self.target, self.notes, self.add = target.rstrip("/"), notes, add
        self.staging = f"{self.target}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        """A row without content, or whose path leads out of the folder, is refused: then nothing is committed."""
        system, staging = place(self.staging)
        out, attempt, made = Written(), uuid.uuid4().hex, set()
        for row in iterator:
            if row["content"] is None or not safe(row["path"]):
                out.refused += 1
                continue
            at = f"{staging}/{row['path']}"
            folder = posixpath.dirname(at)
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            part = f"{folder}/.{attempt}"
            with system.open_output_stream(part) as stream:
                stream.write(row["content"])
            if system.get_file_info(at).type != arrow_fs.FileType.NotFound:
                system.delete_file(at)  # of an attempt before, with the same content
            system.move(part, at)
            if row["note"] is not None:
                out.notes.append(row["note"])
        return out

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        if any(m.refused for m in done):
            self.abort(messages)
            return
        system, staging = place(self.staging)
        target = place(self.target)[1]
        system.create_dir(staging, recursive=True)
        if self.notes:
            notes_system, notes = place(self.notes)
            notes_system.create_dir(posixpath.dirname(notes), recursive=True)
            with notes_system.open_output_stream(notes) as stream:
                stream.write("".join(f"{json.dumps(n)}\n" for m in done for n in m.notes).encode())
        if self.add:
            for info in system.get_file_info(arrow_fs.FileSelector(staging, recursive=True)):
                if info.type == arrow_fs.FileType.File:
                    at = f"{target}/{posixpath.relpath(info.path, staging)}"
                    system.create_dir(posixpath.dirname(at), recursive=True)
                    if system.get_file_info(at).type != arrow_fs.FileType.NotFound:
                        system.delete_file(at)
                    system.move(info.path, at)
            system.delete_dir(staging)
            return
        old = f"{staging}.old"
        if system.get_file_info(target).type != arrow_fs.FileType.NotFound:
            system.move(target, old)
        system.move(staging, target)
        if system.get_file_info(old).type != arrow_fs.FileType.NotFound:
            system.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        system, staging = place(self.staging)
        if system.get_file_info(staging).type != arrow_fs.FileType.NotFound:
            system.delete_dir(staging)


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "claimlake_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], self.options.get("notes"), self.options.get("add") == "true")


def write_files(rows: DataFrame, target: str, notes: str | None = None, add: bool = False) -> None:
    """rows (path, content and, if wanted, note) as files below ``target``, which they replace; a null content or an unsafe path
    refuses the whole: the caller counts those. ``notes``: a file that takes the notes, a JSON string a line.
    ``add``: files are moved one by one beside those below ``target``."""
    rows.sparkSession.dataSource.register(WholeFiles)
    if "note" not in rows.columns:
        rows = rows.selectExpr("*", "cast(null as string) as note")
    sink = rows.select("path", "content", "note").write.format("claimlake_files").mode("append").option("path", target).option("add", str(add).lower())
    (sink.option("notes", notes) if notes else sink).save()
