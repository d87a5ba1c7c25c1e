"""Results as folders of files: written aside, moved into place at once, never over anything that is there."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.convert import stem_of
from docloom.sources.engine import _arrow, _schema

PUBLISHED = "path string, output string, markdown_file string, assets array<string>, error_kind string, error string"


#: What is said of a place that can't be used.
EXISTS = "Output already exists and will not be overwritten: {0}"
INSIDE = "The output directory must not be inside the source document: {0}"


class OutputError(ValueError):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def default_output(path: str) -> str:
    """The folder beside the input that its result goes to."""
    path = path.removeprefix("file:")
    path = "/" + path.lstrip("/") if path.startswith("/") else path
    return os.path.join(os.path.dirname(path.rstrip("/")), f"{stem_of(path)}-markdown")


def check_output(output: str, source: str | None = None) -> None:
    if os.path.lexists(output):
        raise OutputError("output_exists", EXISTS.format(output))
    if source and os.path.isdir(source) and os.path.realpath(output).lower().startswith(os.path.realpath(source).lower().rstrip("/") + "/"):
        raise OutputError("output_inside_input", INSIDE.format(output))
    if not os.path.isdir(os.path.dirname(output) or "."):
        raise OutputError("output_parent_missing", f"The output parent directory does not exist: {os.path.dirname(output)}")


def safe_relative(path: str) -> bool:
    return bool(path) and not path.startswith("/") and ".." not in path.split("/")


def publish_one(output: str, stem: str, markdown: str, assets: dict[str, bytes], source: str | None = None) -> tuple[str, list[str]]:
    """Writes one result; raises OutputError if its place is taken, also by a task that was quicker."""
    check_output(output, source)
    work = tempfile.mkdtemp(prefix=".docloom-", dir=os.path.dirname(output) or ".")
    try:
        for name, data in {f"{stem}.md": markdown.encode(), **assets}.items():
            if not safe_relative(name):
                raise OutputError("io", f"File-system operation failed: unsafe result path {name}")
            target = os.path.join(work, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "xb") as f:
                f.write(data)
        try:
            os.mkdir(output)  # exclusive: renaming onto an empty folder would replace one that someone else made
        except FileExistsError:
            raise OutputError("output_exists", EXISTS.format(output)) from None
        os.rename(work, output)
        return os.path.join(output, f"{stem}.md"), [os.path.join(output, a) for a in sorted(assets)]
    finally:
        shutil.rmtree(work, ignore_errors=True)


def publish(results: DataFrame, folder: str) -> DataFrame:
    """PUBLISHED: one folder for each good result below `folder`, a shared one on a cluster. Evaluate it once.

    Results whose stems are equal get distinct folders by a hash of their path, so that tasks never meet.
    """
    good = results.where("status = 'ok'").select("path", "markdown", "assets", F.substring(F.sha2("path", 256), 1, 12).alias("tag"))

    schema = _arrow(PUBLISHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stem = stem_of(row["path"])
                output = os.path.join(folder, f"{stem}-{row['tag']}-markdown")
                done = {"path": row["path"], "output": output}
                try:
                    done["markdown_file"], done["assets"] = publish_one(output, stem, row["markdown"], {a["path"]: a["bytes"] for a in row["assets"]})
                except OutputError as e:
                    done |= {"error_kind": e.kind, "error": str(e)}
                except OSError as e:
                    done |= {"error_kind": "io", "error": f"File-system operation failed: {e}"}
                yield pa.RecordBatch.from_pylist([done], schema)

    return good.mapInArrow(run, _schema(PUBLISHED))
