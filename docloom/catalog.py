"""Formats, the tools that they need, and whether these are there."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.resolve import availability
from docloom.sources.adapters import Registry
from docloom.sources.convert import DEFAULT

#: Why a format that is detected is never converted, whatever tools are there.
NEVER = {"doc": "DOC is detected but never converted here"}


def declared(registry: Registry) -> list[tuple[str, list[str], str, list[str]]]:
    """(format, extensions, container, tools) as the adapters declare them."""
    order = ["rtf", "rtfd", "docx", "odt", "doc", "ods", "xlsx", "xls", "odm"]
    formats = sorted(registry.formats.values(), key=lambda f: order.index(f.name) if f.name in order else len(order))
    return [(f.name, [*f.extensions], f.container, [*f.requires]) for f in formats]


def resolve_tool(name: str, explicit: str | None = None) -> str | None:
    """An executable regular file: the explicit path if one is given, else the first on PATH."""
    found = explicit or shutil.which(name)
    real = os.path.realpath(found) if found else None
    return real if real and os.path.isfile(real) and os.access(real, os.X_OK) else None


def catalog(spark: SparkSession, explicit: dict[str, str] | None = None, registry: Registry = DEFAULT) -> DataFrame:
    """(format, extensions, container, requires, missing, available, reason); each tool is looked for once."""
    formats = declared(registry)
    tools = {t for f in formats for t in f[3]}
    there = [t for t in sorted(tools) if resolve_tool(t, (explicit or {}).get(t))]
    rows = spark.createDataFrame(formats, "format string, extensions array<string>, container string, requires array<string>")
    found = availability(rows, there)
    never = F.col("format").isin(*NEVER)
    why = F.try_element_at(F.create_map(*(F.lit(x) for pair in NEVER.items() for x in pair)), F.col("format"))
    return found.withColumn("available", F.col("available") & ~never).withColumn("reason", F.coalesce("reason", why))


def catalog_rows(explicit: dict[str, str] | None = None, registry: Registry = DEFAULT) -> list[dict]:
    """The same without Spark, for the command line."""
    there = {t: bool(resolve_tool(t, (explicit or {}).get(t))) for f in declared(registry) for t in f[3]}
    out = []
    for name, extensions, container, requires in declared(registry):
        missing = [t for t in requires if not there[t]]
        reason = f"missing required tool: {', '.join(missing)}" if missing else NEVER.get(name)
        out.append({"containerKind": container, "fileExtensions": extensions, "format": name, "isAvailable": reason is None, "missingTools": missing, "requiredTools": requires, "unavailableReason": reason})
    return out


def catalog_text(rows: list[dict]) -> str:
    table = [[r["format"], ", ".join(r["fileExtensions"]), r["containerKind"], ", ".join(r["requiredTools"]) or "-", "available" if r["isAvailable"] else r["unavailableReason"]] for r in rows]
    wide = [max(map(len, c)) + 2 for c in zip(*table)]
    return "\n".join("".join(x.ljust(w) for x, w in zip(r[:-1], wide)) + r[-1] for r in table)


def catalog_json(rows: list[dict]) -> str:
    return json.dumps({"formats": rows}, indent=2, sort_keys=True)
