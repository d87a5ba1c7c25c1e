"""Publishing as a Spark sink: results.write.format("markdown").mode("append").save(folder) makes a folder for each result.

Tasks write below a staging folder of the run; what an attempt has written counts only once the job commits, when the
driver renames each folder into place and leaves a manifest. Attempts that failed, or that another overtook, are never
renamed and go with the staging folder, as everything does when the job aborts. Nothing that is there is replaced.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from docloom.sources.convert import stem_of
from docloom.sources.publish import EXISTS, INSIDE, OutputError, safe_relative

COLUMNS = ("path", "status", "markdown", "assets")


def opened(location: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a location: a plain path, or an address of any store that pyarrow opens."""
    if location.startswith("file:"):
        location = "/" + location.removeprefix("file:").lstrip("/")
    if location.startswith("/"):
        return pafs.LocalFileSystem(), location.rstrip("/") or "/"
    fs, path = pafs.FileSystem.from_uri(location)
    return fs, path.rstrip("/")


def _there(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


@dataclass
class Written(WriterCommitMessage):
    """Of one task attempt: (source, staged folder, final folder, Markdown file, assets), and (source, kind, error)."""

    done: list[tuple[str, str, str, str, list[str]]] = field(default_factory=list)
    failed: list[tuple[str, str, str]] = field(default_factory=list)


class FolderWriter(DataSourceWriter):
    def __init__(self, folder: str, adjacent: bool, at: dict[str, int]):
        self.folder, self.adjacent, self.at, self.run = folder, adjacent, at, uuid.uuid4().hex
        fs, root = opened(folder)
        if not _there(fs, root):
            raise OutputError("output_parent_missing", f"The output parent directory does not exist: {root}")

    @property
    def staging(self) -> str:
        return posixpath.join(opened(self.folder)[1], f".docloom-{self.run}")

    def place(self, source: str) -> str:
        """The folder of a result: beside its source, or below the folder by name and a hash of the source's path."""
        root, stem = opened(self.folder)[1], stem_of(source)
        if not self.adjacent:
            import hashlib

            return posixpath.join(root, f"{stem}-{hashlib.sha256(source.encode()).hexdigest()[:12]}-markdown")
        path = opened(source)[1]
        if not path.startswith(root.rstrip("/") + "/"):
            raise OutputError("io", f"File-system operation failed: {path} is not below {root}")
        return posixpath.join(posixpath.dirname(path), f"{stem}-markdown")

    def check(self, fs: pafs.FileSystem, source: str, output: str) -> None:
        if _there(fs, output):
            raise OutputError("output_exists", EXISTS.format(output))
        inner = re.sub("/+", "/", opened(source)[1]).rstrip("/").lower() + "/"
        if (output.lower() + "/").startswith(inner):
            raise OutputError("output_inside_input", INSIDE.format(output))

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, attempt, out = opened(self.folder)[0], posixpath.join(self.staging, uuid.uuid4().hex), Written()
        for n, row in enumerate(iterator):
            source, status, markdown, assets = (row[self.at[c]] for c in COLUMNS)
            if status != "ok":
                continue
            try:
                output = self.place(source)
                self.check(fs, source, output)
                name, staged = f"{stem_of(source)}.md", posixpath.join(attempt, str(n))
                files = {name: (markdown or "").encode(), **{a["path"]: bytes(a["bytes"]) for a in assets or []}}
                if bad := next((f for f in files if not safe_relative(f)), None):
                    raise OutputError("io", f"File-system operation failed: unsafe result path {bad}")
                for f, data in files.items():
                    target = posixpath.join(staged, f)
                    fs.create_dir(posixpath.dirname(target), recursive=True)
                    with fs.open_output_stream(target) as stream:
                        stream.write(data)
                out.done.append((source, staged, output, name, sorted(files.keys() - {name})))
            except OutputError as e:
                out.failed.append((source, e.kind, str(e)))
        return out

    def commit(self, messages: list[Written | None]) -> None:
        """Renames what counts into place, in order of source; a manifest tells of each. All of it, or none."""
        fs, moved, told = opened(self.folder)[0], [], []
        every = [m for m in messages if m]
        try:
            for source, staged, output, name, assets in sorted(x for m in every for x in m.done):
                try:
                    self.check(fs, source, output)
                except OutputError as e:  # taken since the task looked, or by another result of this job
                    told.append({"path": source, "output": output, "error_kind": e.kind, "error": str(e)})
                    continue
                fs.move(staged, output)
                moved.append(output)
                told.append({"path": source, "output": output, "markdown_file": posixpath.join(output, name), "assets": [posixpath.join(output, a) for a in assets]})
            told += [{"path": source, "error_kind": kind, "error": error} for m in every for source, kind, error in sorted(m.failed)]
            fs.create_dir(self.staging, recursive=True)
            with fs.open_output_stream(posixpath.join(self.staging, "manifest")) as stream:
                stream.write("".join(json.dumps(t, sort_keys=True) + "\n" for t in told).encode())
            manifests = posixpath.join(opened(self.folder)[1], "_published")
            fs.create_dir(manifests, recursive=True)
            fs.move(posixpath.join(self.staging, "manifest"), posixpath.join(manifests, f"{self.run}.json"))
        except Exception:
            for output in moved:
                fs.delete_dir(output)
            raise
        self._clear(fs)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(opened(self.folder)[0])

    def _clear(self, fs: pafs.FileSystem) -> None:
        if _there(fs, self.staging):
            fs.delete_dir(self.staging)


class MarkdownSink(DataSource):
    """Takes rows of engine.convert_documents(). Option adjacent: results go beside their sources, which lie below the folder."""

    @classmethod
    def name(cls) -> str:
        return "markdown"

    def writer(self, schema: T.StructType, overwrite: bool) -> FolderWriter:
        if overwrite:
            raise ValueError("results are never overwritten: write in append mode")
        missing = [c for c in COLUMNS if c not in schema.names]
        if missing:
            raise ValueError(f"results have no column {missing[0]}")
        return FolderWriter(os.fspath(self.options["path"]), self.options.get("adjacent", "false").lower() == "true", {c: schema.names.index(c) for c in COLUMNS})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MarkdownSink)


def published(spark: SparkSession, folder: str):
    """(path, output, markdown_file, assets, error_kind, error): what all runs into a folder have told of their results."""
    from docloom.sources.publish import PUBLISHED

    return spark.read.schema(PUBLISHED).json(posixpath.join(folder, "_published"))
