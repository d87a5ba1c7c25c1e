"""One document from bytes to Markdown, warnings and assets; or to an error, which is data as well."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import unquote

from docloom.functions.gfm import markdown as to_markdown
from docloom.functions.images import UnsafeReference, rewrite
from docloom.functions.links import rewritten
from docloom.functions.markdown import normalized
from docloom.functions.render_text import one_line, workbook as render_workbook
from docloom.functions.text import LIST_ITEM
from docloom.sources import cfb, odm, ods, rtf, wordml, xls, xlsx
from docloom.sources.adapters import Detection, Format, Probe, Registry
from docloom.sources.workbook import Keep, Workbook, WorkbookError, every
from docloom.sources.xmltree import XmlError
from docloom.sources.zipgate import Package, PackageError

#: Warnings by code.
WARNINGS = {
    "richText.colorNotPreserved": "Chromatic text colors in RTF cannot be represented and were not preserved.",
    "richText.attachmentNotRepresented": "Attachment was not represented in the generated Markdown: {0}",
    "wordProcessing.commentsNotPreserved": "Document comments are not represented in the generated Markdown.",
    "wordProcessing.changesAccepted": "Tracked changes were accepted before the Markdown was generated.",
    "wordProcessing.macrosNotPreserved": "Word macros cannot be represented in Markdown and were not preserved.",
    "wordProcessing.templateSemanticsNotPreserved": "The Word template function cannot be represented in Markdown and was not preserved.",
    "openDocument.changesNotPreserved": "Tracked changes in ODT are not represented reliably in the generated Markdown.",
    "legacyWord.potentialLoss": "Legacy DOC import can omit OLE objects, text boxes, macros, and other unsupported Word content.",
    "spreadsheet.mergesFlattened": "Merged cells were reduced to the value in their upper-left cell.",
    "spreadsheet.formulaResultMissing": "At least one formula has no stored result; its cell is empty in the Markdown.",
    "spreadsheet.unsupportedObjects": "Charts, images, comments, macros, hyperlink targets, or other spreadsheet objects are not represented in the Markdown.",
    "legacySpreadsheet.potentialLoss": "Legacy XLS import preserves stored cell values but can omit formatting and unsupported workbook features.",
    "openDocumentMaster.flattened": "Master-document sections were flattened; master styles, indexes, and cross-document page layout are not represented.",
}
_PACKAGE_WARNINGS = {
    "macros": "wordProcessing.macrosNotPreserved", "template": "wordProcessing.templateSemanticsNotPreserved", "comments": "wordProcessing.commentsNotPreserved",
    "changes": "wordProcessing.changesAccepted", "odt_changes": "openDocument.changesNotPreserved",
}
ERRORS = (PackageError, WorkbookError, XmlError, cfb.CompoundError, UnsafeReference)


@dataclass
class Result:
    path: str
    format: str | None = None
    status: str = "unsupported"
    error_kind: str | None = None
    error: str | None = None
    warnings: list[tuple[str, str]] = field(default_factory=list)
    markdown: str | None = None
    assets: dict[str, bytes] = field(default_factory=dict)
    book: Workbook | None = None
    items: list[odm.Item] | None = None


def warning(code: str, *args: str) -> tuple[str, str]:
    return code, WARNINGS[code].format(*args)


def name_of(path: str) -> str:
    return unquote(path.rstrip("/").rpartition("/")[2]) if path.startswith(("file:", "hdfs:", "viewfs:", "s3a:")) else path.rstrip("/").rpartition("/")[2]


def stem_of(path: str) -> str:
    name = name_of(path)
    head, dot, _ = name.rpartition(".")
    return head if dot and head else name


def book_warnings(book: Workbook, fmt: str) -> list[str]:
    flags = ((book.merges, "spreadsheet.mergesFlattened"), (book.missing_results, "spreadsheet.formulaResultMissing"), (book.unsupported, "spreadsheet.unsupportedObjects"), (fmt == "xls", "legacySpreadsheet.potentialLoss"))
    return [code for on, code in flags if on]


def _invalid(probe: Probe, fmt: Format, reason: str) -> Detection:
    """Invalid where the path's extension asks for the format, else no match."""
    return Detection("invalid", fmt.name, fmt.priority, reason) if probe.wanted == fmt.name else Detection()


def _packaged(probe: Probe, formats: tuple[Format, ...], find, missing: str) -> Detection:
    """What find() tells of a package; for one that can't be opened or read, or in which it finds none, why."""
    wanted = next((f for f in formats if f.name == probe.wanted), None)
    said = lambda reason: _invalid(probe, wanted, reason) if wanted else Detection()
    if not probe.package:
        return said(probe.package_error or probe.compound_error or "the ZIP package signature is missing")
    try:
        return find(probe.package) or said(missing)
    except ERRORS as e:
        return said(str(e))


#: Formats with their extensions and priorities, and the tools that one needs.
RTF, RTFD = Format("rtf", ("rtf",), 100), Format("rtfd", ("rtfd",), 100, "package")
DOCX, ODT = Format("docx", ("docx", "docm", "dotx", "dotm"), 110), Format("odt", ("odt",), 110)
DOC = Format("doc", ("doc",), 105, requires=("textutil", "pandoc"))
ODS, XLSX, XLS = Format("ods", ("ods",), 108), Format("xlsx", ("xlsx",), 108), Format("xls", ("xls",), 108)
ODM = Format("odm", ("odm",), 109)


class RichText:
    formats = (RTF, RTFD)

    def detect(self, probe: Probe) -> Detection:
        if not rtf.HEADER.match(probe.content):
            return _invalid(probe, RTF, "the RTF header is missing")
        return Detection("match", "rtf", RTF.priority, warnings=["richText.colorNotPreserved"] if rtf.loses_colour(probe.content) else [])

    def convert(self, probe: Probe, found: Detection, result: Result, rendering: str) -> Result:
        html, files = rtf.rtf_html(probe.content)
        return _from_html(result, re.sub(LIST_ITEM, r"\1\2\3", html), files)


class WordPackage:
    formats = (DOCX, ODT)

    def detect(self, probe: Probe) -> Detection:
        def find(package: Package) -> Detection | None:
            if "word/document.xml" in package.entries and "[Content_Types].xml" in package.entries:
                fmt, found = DOCX, wordml.inspect_docx(package)
            elif probe.mimetype == wordml.ODT_MIMETYPE and "content.xml" in package.entries:
                fmt, found = ODT, wordml.inspect_odt(package)
            else:
                return None
            return Detection("match", fmt.name, fmt.priority, warnings=[c for k, c in _PACKAGE_WARNINGS.items() if k in found], parsed=package)

        return _packaged(probe, self.formats, find, "the required document-package entries are missing")

    def convert(self, probe: Probe, found: Detection, result: Result, rendering: str) -> Result:
        return _from_html(result, *(wordml.docx_html if found.format == "docx" else wordml.odt_html)(found.parsed))


class LegacyWord:
    formats = (DOC,)

    def detect(self, probe: Probe) -> Detection:
        if probe.compound and probe.compound.has("WordDocument"):
            return Detection("match", "doc", DOC.priority, warnings=["legacyWord.potentialLoss"])
        return _invalid(probe, DOC, "the compound document is not a Word DOC file" if probe.compound else probe.compound_error or probe.package_error or "the OLE compound-document signature is missing")

    def convert(self, probe: Probe, found: Detection, result: Result, rendering: str) -> Result:
        result.status, result.error_kind, result.error = "error", "missing_tool", "DOC is detected but never converted here"
        return result


class Spreadsheet:
    formats = (ODS, XLSX, XLS)

    def detect(self, probe: Probe) -> Detection:
        if probe.compound and probe.compound.has("Workbook", "Book"):
            try:
                book = xls.read_xls(probe.content)
            except ERRORS as e:
                return _invalid(probe, XLS, str(e))
            return Detection("match", "xls", XLS.priority, warnings=book_warnings(book, "xls"), parsed=book)
        if probe.wanted == "xls":
            return _invalid(probe, XLS, probe.compound_error or probe.package_error or ("the OLE compound document contains no Excel workbook stream" if probe.compound else "the OLE compound-document header is invalid"))

        def find(package: Package) -> Detection | None:
            if probe.mimetype == ods.MIMETYPE and "content.xml" in package.entries:
                fmt, book = ODS, ods.read_ods(package)
            elif xlsx.is_xlsx(package):
                fmt, book = XLSX, xlsx.read_xlsx(package)
            else:
                return None
            return Detection("match", fmt.name, fmt.priority, warnings=book_warnings(book, fmt.name), parsed=book)

        return _packaged(probe, (ODS, XLSX), find, "the required spreadsheet-package metadata is missing or invalid")

    def convert(self, probe: Probe, found: Detection, result: Result, rendering: str) -> Result:
        result.book = found.parsed
        result.markdown = render_workbook(found.parsed, stem_of(probe.path), rendering)
        return result


class Master:
    """Keeps a master's items; its texts are joined to it by resolve_master()."""

    formats = (ODM,)

    def detect(self, probe: Probe) -> Detection:
        def find(package: Package) -> Detection | None:
            if probe.mimetype != odm.MIMETYPE or "content.xml" not in package.entries:
                return None
            return Detection("match", "odm", ODM.priority, warnings=["openDocumentMaster.flattened"], parsed=odm.read_items(package))

        return _packaged(probe, self.formats, find, "the OpenDocument master mimetype or content.xml is missing")

    def convert(self, probe: Probe, found: Detection, result: Result, rendering: str) -> Result:
        result.items, result.status = found.parsed, "master"
        return result


#: The adapters of this library, in the order in which they are asked.
DEFAULT = Registry((RichText(), WordPackage(), LegacyWord(), Spreadsheet(), Master()))


def detectors(path: str, content: bytes, registry: Registry = DEFAULT) -> list[Detection]:
    """What each adapter says, in their order; a document is parsed once, by the adapter that it matches."""
    return registry.detect(registry.probe(path, content))


def pick(path: str, found: list[Detection]) -> tuple[Detection | None, Result]:
    """The match of the highest priority, or a result that says why there is none."""
    result = Result(path)
    matches = [d for d in found if d.kind == "match"]
    best = [d for d in matches if d.priority == max(m.priority for m in matches)]
    if len(best) == 1:
        result.format, result.status, result.warnings = best[0].format, "ok", [warning(c) if c in WARNINGS else (c, c) for c in best[0].warnings]
        return best[0], result
    if best:
        result.status, result.error_kind = "error", "ambiguous_input"
        result.error = f"Input matches more than one format at {path}: {', '.join(sorted(d.format for d in best))}"
    elif bad := [d for d in found if d.kind == "invalid"]:
        worst = max(bad, key=lambda d: d.priority)
        result.format, result.status, result.error_kind = worst.format, "error", "invalid_input"
        result.error = f"Invalid {worst.format.upper()} input at {path}: {worst.reason}"
    else:
        result.status, result.error_kind, result.error = "error", "unsupported_input", f"Unsupported input format: {path}"
    return None, result


def workbook_of(path: str, content: bytes, keep: Keep = every) -> Workbook | None:
    """The workbook that a document is, with the cells of the sheets that are kept; None for others and for broken ones.

    Nothing is rendered, and sheets that aren't kept are not parsed.
    """
    probe = DEFAULT.probe(path, content)
    try:
        if probe.compound and probe.compound.has("Workbook", "Book"):
            return xls.read_xls(content, keep)
        if probe.package and probe.mimetype == ods.MIMETYPE and "content.xml" in probe.package.entries:
            return ods.read_ods(probe.package, keep=keep)
        if probe.package is None or "word/document.xml" in probe.package.entries and WordPackage().detect(probe).kind == "match":
            return None
        return xlsx.read_xlsx(probe.package, keep=keep) if xlsx.is_xlsx(probe.package) else None
    except ERRORS:
        return None
    except Exception:  # one bad file must not fail the job
        return None


def _from_html(result: Result, html: str, files: dict[str, bytes]) -> Result:
    html, result.assets, _ = rewrite(html, files)
    result.markdown = normalized(to_markdown(html))
    return result


def convert(path: str, content: bytes, rendering: str = "table", registry: Registry = DEFAULT) -> Result:
    """A result for any bytes whatever: what cannot be read is an error in the row, never an exception.

    A master document keeps its items; its children are joined to it by resolve_master().
    """
    try:
        probe = registry.probe(path, content)
        told = registry.detect(probe)
        found, result = pick(path, told)
        if found is None:
            return result
        adapter = next(a for a, d in zip(registry.adapters, told) if d is found)
        return adapter.convert(probe, found, result, rendering)
    except ERRORS as e:
        return Result(path, status="error", error_kind="invalid_input", error=str(e))
    except Exception as e:  # one bad file must not fail the job
        return Result(path, status="error", error_kind="tool_failed", error=f"{type(e).__name__}: {e}")


def convert_package(path: str, files: dict[str, bytes | None]) -> Result:
    """A folder package of rich text (TXT.rtf and attachments); attachments that nothing shows are warned about.

    Files of None are over the size limit and were not read.
    """
    body = files.get("TXT.rtf", b"")
    if body is None:
        return Result(path, "rtfd", "error", "invalid_input", f"Input is over the size limit and was not read: {path}/TXT.rtf")
    if not rtf.HEADER.match(body):
        return Result(path, "rtfd", "error", "invalid_input", f"Invalid RTFD input at {path}: the RTF header is missing")
    result = Result(path, "rtfd", "ok")
    try:
        html, pictures = rtf.rtf_html(body, mark_colours=True, attachments={n: data for n, data in files.items() if data is not None})
        _from_html(result, html, pictures)
    except ERRORS as e:
        return Result(path, "rtfd", "error", "invalid_input", str(e))
    left = sorted(n for n in files if n != "TXT.rtf" and not n.startswith(".") and n not in pictures)
    result.warnings = [warning("richText.attachmentNotRepresented", n) for n in left]
    return result


#: What is said of a master document's section, by what is wrong with it.
SECTION_ERRORS = {
    "unsafe": "unsafe or non-local ODM section reference: {0}", "leaves": "ODM section reference leaves the document bundle: {0}", "missing": "linked ODM section is missing: {0}",
    "not_odt": "linked master-document section is not an ODT file: {0}", "invalid": "linked document is invalid ({0}): {1}",
}


def child_path(reference: str) -> str:
    """A section's reference as a path below the master's folder; raises PackageError if it leads elsewhere."""
    path = reference.partition("#")[0]
    plain = unquote(path)
    if not plain or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) or plain.startswith("/") or "\\" in plain or "?" in path:
        raise PackageError(SECTION_ERRORS["unsafe"].format(reference))
    parts = plain.split("/")
    if ".." in parts:
        raise PackageError(SECTION_ERRORS["leaves"].format(reference))
    return "/".join(p for p in parts if p not in ("", "."))


def resolve_master(master: Result, children: dict[str, Result]) -> Result:
    """The master with its sections filled in from children, by child_path(); any child in error is the master's error.

    Assets get their places in the master; their values, bytes or where these are, are passed on as they come.
    """
    parts, assets, warnings = [f"# {one_line(stem_of(master.path))}"], {}, [*master.warnings]
    n = 0
    for item in master.items or []:
        if item.kind == "markdown":
            parts.append(item.text)
            continue
        n += 1
        try:
            path = child_path(item.reference or "")
        except PackageError as e:
            return Result(master.path, "odm", "error", "invalid_input", f"Invalid ODM input at {master.path}: {e}")
        child = children.get(path)
        if child is None or child.status != "ok" or child.format != "odt":
            kind = "missing" if child is None else "invalid" if child.error and child.format == "odt" else "not_odt"
            why = (child.error or "").removeprefix(f"Invalid ODT input at {child.path}: ") if child else ""
            return Result(master.path, "odm", "error", "invalid_input", f"Invalid ODM input at {master.path}: {SECTION_ERRORS[kind].format(item.reference, why)}")
        body = child.markdown or ""
        for old, data in child.assets.items():
            new = f"images/section{n:02d}-{old.rpartition('/')[2]}"
            body = rewritten(body, old, new)
            assets[new] = data
        parts.append(f"## Section: {one_line(item.name or stem_of(path))}")
        if body.strip("\r\n"):
            parts.append(body.strip("\r\n"))
        warnings += child.warnings
    return Result(master.path, "odm", "ok", warnings=[*dict.fromkeys(warnings)], markdown="\n\n".join(parts) + "\n", assets=assets)
