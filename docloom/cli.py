"""python -m docloom.cli INPUT: one document to a new folder of Markdown and images."""

from __future__ import annotations

import json
import os
import sys

from docloom import __version__
from docloom.catalog import catalog_json, catalog_rows, catalog_text
from docloom.operators.resolve import EXIT_CODES
from docloom.sources.convert import Result, child_path, convert, convert_package, resolve_master, stem_of
from docloom.sources.publish import OutputError, default_output, publish_one

USAGE = """Usage: docloom [options] INPUT
       docloom --formats [--json]

  -o, --output DIRECTORY   the new output directory (default: INPUT-markdown beside the source)
      --formats            list the input formats and whether they are available
      --spreadsheet-format table|tsv
      --json               a machine-readable result on standard output
  -h, --help, -V, --version
"""


class UsageError(ValueError):
    kind = "usage"


class InputError(ValueError):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def parse(argv: list[str]) -> dict:
    out = {"input": None, "output": None, "formats": False, "rendering": None, "json": False, "help": False, "version": False}
    values = {"-o": "output", "--output": "output", "--spreadsheet-format": "rendering"}
    flags = {"--formats": "formats", "--json": "json", "-h": "help", "--help": "help", "-V": "version", "--version": "version"}
    rest, only_inputs = [*argv], False
    while rest:
        arg = rest.pop(0)
        if arg == "--" and not only_inputs:
            only_inputs = True
        elif not only_inputs and arg in values:
            if not rest:
                raise UsageError(f"Missing value for {arg}.")
            out[values[arg]] = rest.pop(0)
        elif not only_inputs and arg in flags:
            out[flags[arg]] = True
        elif not only_inputs and arg.startswith("-") and arg != "-":
            raise UsageError(f"Unknown option: {arg}")
        elif out["input"] is not None:
            raise UsageError("Exactly one input is expected.")
        else:
            out["input"] = arg
    if out["rendering"] not in (None, "table", "tsv"):
        raise UsageError(f"Invalid spreadsheet format: {out['rendering']}")
    if out["formats"] and (out["input"] or out["output"] or out["rendering"]):
        raise UsageError("--formats takes no input document and no conversion option.")
    if not (out["formats"] or out["help"] or out["version"] or out["input"]):
        raise UsageError("An input document is expected.")
    return out


def read(path: str) -> bytes:
    if not os.path.exists(path):
        raise InputError("missing_input", f"Input does not exist: {path}")
    if not os.path.isfile(path):
        raise InputError("unsupported_input", f"Unsupported input format: {path}")
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError as e:
        raise InputError("io", f"File-system operation failed: {e}") from None


def run(path: str, rendering: str = "table") -> Result:
    """The result for one document, folder packages and master documents with their sections included."""
    if os.path.isdir(path):
        files = {n: read(os.path.join(path, n)) for n in os.listdir(path) if os.path.isfile(os.path.join(path, n))}
        if "TXT.rtf" not in files:
            raise InputError("unsupported_input", f"Unsupported input format: {path}")
        return convert_package(path, files)
    result = convert(path, read(path), rendering)
    if result.status != "master":
        return result
    children = {}
    for item in result.items or []:
        if item.kind == "section" and item.reference:
            try:
                name = child_path(item.reference)
            except ValueError:
                continue
            child = os.path.join(os.path.dirname(path), name)
            if os.path.isfile(child):
                children[name] = convert(child, read(child))
    return resolve_master(result, children)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    as_json = "--json" in argv
    try:
        args = parse(argv)
        if args["help"]:
            print(USAGE, end="")
            return 0
        if args["version"]:
            print(__version__)
            return 0
        if args["formats"]:
            rows = catalog_rows()
            print(catalog_json(rows) if as_json else catalog_text(rows))
            return 0
        result = run(args["input"], args["rendering"] or "table")
        if result.status != "ok":
            raise InputError(result.error_kind or "tool_failed", result.error or "")
        output = args["output"] or default_output(args["input"])
        markdown, assets = publish_one(output, stem_of(args["input"]), result.markdown or "", result.assets, args["input"])
    except (UsageError, InputError, OutputError) as e:
        if as_json:
            print(json.dumps({"ok": False, "version": __version__, "error": str(e)}, indent=2, sort_keys=True))
        else:
            print(f"error: {e}", file=sys.stderr)
        return EXIT_CODES.get(e.kind, 70)
    except OSError as e:
        print(f"error: File-system operation failed: {e}", file=sys.stderr)
        return EXIT_CODES["io"]
    warnings = [m for _, m in result.warnings]
    if as_json:
        real = os.path.realpath
        print(json.dumps({"ok": True, "version": __version__, "input": real(args["input"]), "outputDirectory": real(output), "markdownFile": real(markdown), "assets": [*map(real, assets)], "warnings": warnings}, indent=2, sort_keys=True))
    else:
        print(markdown)
        for w in warnings:
            print(f"warning: {w}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
