"""A Spark data source: spark.read.format("workbook").load("/folder/*.xlsx") gives a row for each stored cell.

Filters on path, sheet and sheet_no reach the readers: files are passed over unread, and sheets unparsed. A schema given to
the read, with some of the columns, is what rows are made of. Files are packed into partitions by their bytes.
"""

from __future__ import annotations

import glob
import heapq
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from docloom.sources.engine import CELLS

COLUMNS = [c.split(" ")[0] for c in CELLS.split(", ")]
#: Bytes of a partition's files, but for a single larger file; option partitionBytes.
PARTITION_BYTES = 128 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def packed(sizes: dict[str, int], most: int) -> list[list[str]]:
    """Files, the largest first, each to the partition with the fewest bytes, of as many as their sum asks for."""
    n = max(1, min(len(sizes), -(-sum(sizes.values()) // max(1, most))))
    heap = [(0, k, []) for k in range(n)]
    for path in sorted(sizes, key=lambda p: (-sizes[p], p)):
        used, k, own = heap[0]
        own.append(path)
        heapq.heapreplace(heap, (used + sizes[path], k, own))
    return [own for _, _, own in sorted(heap, key=lambda h: h[1]) if own]


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], most: int):
        self.path, self.columns, self.most = path, columns, most
        #: What a column may be, where filters say so.
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            names = getattr(f, "attribute", ())
            if isinstance(f, (EqualTo, In)) and len(names) == 1 and names[0] in ("path", "sheet", "sheet_no"):
                values = {*f.value} if isinstance(f, In) else {f.value}
                self.wanted[names[0]] = self.wanted[names[0]] & values if names[0] in self.wanted else values
            else:
                yield f

    def allows(self, column: str, value) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def partitions(self) -> list[Files]:
        path = os.path.join(self.path, "*") if os.path.isdir(self.path) else self.path
        sizes = {p: os.path.getsize(p) for p in glob.glob(path) if os.path.isfile(p) and self.allows("path", p)}
        return [Files(own) for own in packed(sizes, self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from docloom.sources.convert import workbook_of

        at = [COLUMNS.index(c) for c in self.columns]
        for path in partition.paths:
            with open(path, "rb") as f:
                book = workbook_of(path, f.read(), lambda n, name: self.allows("sheet_no", n) and self.allows("sheet", name))
            for cell in book.cells() if book else ():
                row = (path, *cell)
                yield tuple(row[k] for k in at)


class WorkbookSource(DataSource):
    """For folders that every executor mounts; engine.document_cells() reads any store that Spark can."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: T.StructType) -> Reader:
        unknown = [c for c in schema.names if c not in COLUMNS]
        if unknown:
            raise ValueError(f"a workbook has no column {unknown[0]}")
        return Reader(self.options["path"], schema.names, int(self.options.get("partitionbytes", PARTITION_BYTES)))


def register(spark: SparkSession) -> None:
    """Makes the format known, and has Spark offer filters to Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
