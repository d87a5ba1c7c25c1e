"""Word-processing packages as HTML: Office Open XML documents and OpenDocument texts."""

from __future__ import annotations

from html import escape

from docloom.sources.ods import DRAW, OFFICE, TABLE, TEXT
from docloom.sources.odm import XLINK
from docloom.sources.xlsx import OFFICE_RELS, RELS, TYPES
from docloom.sources.xmltree import Node, parse
from docloom.sources.zipgate import Package, PackageError

#: Namespaces, content types, root elements.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
W_STRICT = "http://purl.oclc.org/ooxml/wordprocessingml/main"
MAIN_TYPES = {
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml": (),
    "application/vnd.ms-word.document.macroenabled.main+xml": ("macros",),
    "application/vnd.openxmlformats-officedocument.wordprocessingml.template.main+xml": ("template",),
    "application/vnd.ms-word.template.macroenabledtemplate.main+xml": ("macros", "template"),
}
ODT_MIMETYPE = "application/vnd.oasis.opendocument.text"
FO = "urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0"
STYLE = "urn:oasis:names:tc:opendocument:xmlns:style:1.0"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
CHANGES = ("ins", "del", "moveFrom", "moveTo")


def inspect_docx(package: Package) -> set[str]:
    """macros, template, comments, changes; raises PackageError for packages that are no documents, or with outside images."""
    root = parse(package.part("[Content_Types].xml"), "[Content_Types].xml")
    if (root.ns, root.name) != (TYPES, "Types"):
        raise PackageError("[Content_Types].xml has no valid Types root")
    kinds = [n.get("ContentType", default="").lower() for n in root.nodes() if (n.ns, n.name) == (TYPES, "Override") and (n.get("PartName") or "").strip("/") == "word/document.xml"]
    if len(kinds) != 1 or kinds[0] not in MAIN_TYPES:
        raise PackageError("word/document.xml has no supported WordprocessingML main content type")
    found = {*MAIN_TYPES[kinds[0]]}
    body = parse(package.part("word/document.xml"), "word/document.xml")
    if body.ns not in (W, W_STRICT) or body.name != "document":
        raise PackageError("word/document.xml has no valid WordprocessingML document root")
    for n in body.walk():
        if n.ns == body.ns and n.name == "commentRangeStart":
            found.add("comments")
        elif n.ns == body.ns and n.name in CHANGES:
            found.add("changes")
    if (data := package.get("word/comments.xml")) is not None and any(n.name == "comment" for n in parse(data, "word/comments.xml").walk()):
        found.add("comments")
    if outside := external_images(package):
        raise PackageError(f"The generated document contains an unsafe image reference: {outside[0]}")
    return found


def external_images(package: Package) -> list[str]:
    """Targets of image relationships that lead out of the package, sorted."""
    out = []
    for name in package.names:
        if name.endswith(".rels"):
            for n in parse(package.part(name), name).walk():
                if (n.ns, n.name) == (RELS, "Relationship") and (n.get("TargetMode") or "").lower() == "external" and (n.get("Type") or "").endswith("/image"):
                    out.append(n.get("Target") or "")
    return sorted(out)


def _relationships(package: Package) -> dict[str, str]:
    data = package.get("word/_rels/document.xml.rels")
    return {} if data is None else {n.get("Id"): n.get("Target") for n in parse(data, "word/_rels/document.xml.rels").nodes()}


class _Docx:
    def __init__(self, package: Package):
        self.package, self.rels, self.files = package, _relationships(package), {}
        self.headings, self.ordered = self._styles(), self._numbering()

    def _styles(self) -> dict[str, int]:
        if (data := self.package.get("word/styles.xml")) is None:
            return {}
        out = {}
        for s in parse(data, "word/styles.xml").nodes():
            name = next((n.get("val", n.ns) or "" for n in s.nodes() if n.name == "name"), "").lower()
            if s.name == "style" and name.startswith("heading ") and name[8:].isdigit():
                out[s.get("styleId", s.ns)] = min(6, int(name[8:]))
        return out

    def _numbering(self) -> dict[tuple[str, str], bool]:
        if (data := self.package.get("word/numbering.xml")) is None:
            return {}
        root = parse(data, "word/numbering.xml")
        kinds = {a.get("abstractNumId", a.ns): {lv.get("ilvl", lv.ns): next((f.get("val", f.ns) for f in lv.nodes() if f.name == "numFmt"), "bullet") for lv in a.nodes() if lv.name == "lvl"} for a in root.nodes() if a.name == "abstractNum"}
        out = {}
        for n in root.nodes():
            if n.name == "num":
                ref = next((x.get("val", x.ns) for x in n.nodes() if x.name == "abstractNumId"), None)
                for level, kind in kinds.get(ref, {}).items():
                    out[n.get("numId", n.ns), level] = kind not in ("bullet", "none")
        return out

    def blocks(self, node: Node) -> str:
        out, stack = [], []  # stack: open lists (ordered)
        for x in node.nodes():
            if x.name == "p":
                props = next((n for n in x.nodes() if n.name == "pPr"), None)
                style, num = self._paragraph(props)
                body = self.inline(x)
                if num is not None:
                    level, ordered = num
                    while len(stack) > level + 1:
                        out.append(f"</li></{stack.pop()}>")
                    if len(stack) == level + 1:
                        out.append("</li><li>" + body)
                    while len(stack) < level + 1:
                        stack.append("ol" if ordered else "ul")
                        out.append(f"<{stack[-1]}><li>" + (body if len(stack) == level + 1 else ""))
                    continue
                while stack:
                    out.append(f"</li></{stack.pop()}>")
                tag = f"h{self.headings[style]}" if style in self.headings else "p"
                if body.strip():
                    out.append(f"<{tag}>{body}</{tag}>")
            elif x.name == "tbl":
                while stack:
                    out.append(f"</li></{stack.pop()}>")
                rows = "".join("<tr>" + "".join(f"<td>{self.blocks(c)}</td>" for c in r.nodes() if c.name == "tc") + "</tr>" for r in x.nodes() if r.name == "tr")
                out.append(f"<table>{rows}</table>")
            elif x.name in ("sdt", "sdtContent", "ins", "moveTo", "customXml"):
                out.append(self.blocks(x))
        while stack:
            out.append(f"</li></{stack.pop()}>")
        return "".join(out)

    def _paragraph(self, props: Node | None):
        style = num = None
        for n in props.nodes() if props else ():
            if n.name == "pStyle":
                style = n.get("val", n.ns)
            elif n.name == "numPr":
                got = {x.name: x.get("val", x.ns) for x in n.nodes()}
                if got.get("numId", "0") != "0":
                    level = got.get("ilvl", "0")
                    num = int(level), self.ordered.get((got["numId"], level), False)
        return style, num

    def inline(self, node: Node) -> str:
        out = []
        for x in node.nodes():
            if x.name == "r":
                out.append(self.run(x))
            elif x.name == "hyperlink":
                target = self.rels.get(x.get("id", OFFICE_RELS), "")
                out.append(f'<a href="{escape(target)}">{self.inline(x)}</a>' if target else self.inline(x))
            elif x.name not in ("pPr", "del", "moveFrom", "p", "tbl"):  # accepted changes: what was deleted is gone
                out.append(self.inline(x))
        return "".join(out)

    def run(self, node: Node) -> str:
        props = next((n for n in node.nodes() if n.name == "rPr"), None)
        on = {n.name for n in (props.nodes() if props else ()) if n.get("val", n.ns) not in ("0", "false", "none")}
        out = []
        for x in node.nodes():
            if x.name == "t":
                out.append(escape(x.text(), quote=False))
            elif x.name == "tab":
                out.append(" ")
            elif x.name in ("br", "cr"):
                out.append("<br>")
            elif x.name in ("drawing", "pict", "object"):
                for n in x.walk():
                    rel = n.get("embed", OFFICE_RELS) if (n.ns, n.name) == (A, "blip") else n.get("id", OFFICE_RELS) if n.name == "imagedata" else None
                    if rel in self.rels:
                        name = "word/" + self.rels[rel].removeprefix("./") if not self.rels[rel].startswith("/") else self.rels[rel][1:]
                        if name in self.package.entries:
                            self.files[name] = self.package.part(name, None)
                            out.append(f'<img src="{escape(name)}" alt="">')
        body = "".join(out)
        for tag, flags in (("del", {"strike", "dstrike"}), ("em", {"i"}), ("strong", {"b"})):
            if on & flags and body.strip():
                body = f"<{tag}>{body}</{tag}>"
        return body


def docx_html(package: Package) -> tuple[str, dict[str, bytes]]:
    """(HTML, files by name) with tracked changes accepted."""
    reader = _Docx(package)
    root = parse(package.part("word/document.xml", None), "word/document.xml")
    html = "".join(reader.blocks(b) for b in root.nodes() if b.name == "body")
    return html, reader.files


def inspect_odt(package: Package) -> set[str]:
    """comments, changes; raises PackageError for images that lead out of the package."""
    root = parse(package.part("content.xml"), "content.xml")
    if (root.ns, root.name) != (OFFICE, "document-content"):
        raise PackageError("content.xml has no valid OpenDocument content root")
    found, unsafe = set(), []
    for n in root.walk():
        if (n.ns, n.name) == (OFFICE, "annotation"):
            found.add("comments")
        elif (n.ns, n.name) == (TEXT, "tracked-changes"):
            found.add("odt_changes")
        elif (n.ns, n.name) == (DRAW, "image") and unsafe_reference(href := n.get("href", XLINK) or ""):
            unsafe.append(href)
    if unsafe:
        raise PackageError(f"The generated document contains an unsafe image reference: {min(unsafe)}")
    return found


def unsafe_reference(ref: str) -> bool:
    head = ref.split("/", 1)[0]
    return not ref or ":" in head or ref.startswith("/") or "\\" in ref or ".." in ref.split("/")


class _Odt:
    def __init__(self, package: Package, root: Node):
        self.package, self.files = package, {}
        self.styles: dict[str, set[str]] = {}
        self.ordered: set[str] = set()
        for n in root.walk():
            name = n.get("name", STYLE)
            if (n.ns, n.name) == (STYLE, "style") and name:
                own = set()
                for p in n.nodes():
                    if p.get("font-weight", FO) == "bold":
                        own.add("strong")
                    if p.get("font-style", FO) == "italic":
                        own.add("em")
                    if (p.get("text-line-through-style", STYLE) or "none") != "none":
                        own.add("del")
                self.styles[name] = own
            elif (n.ns, n.name) == (TEXT, "list-style") and name and any(x.name == "list-level-style-number" for x in n.nodes()):
                self.ordered.add(name)

    def blocks(self, node: Node, ordered: bool = False) -> str:
        out = []
        for x in node.nodes():
            if x.ns == TEXT and x.name == "h":
                level = x.get("outline-level", TEXT, "1")
                n = min(6, max(1, int(level) if level.isdigit() else 1))
                out.append(f"<h{n}>{self.inline(x)}</h{n}>")
            elif x.ns == TEXT and x.name == "p":
                out.append(f"<p>{self.inline(x)}</p>")
            elif x.ns == TEXT and x.name == "list":
                numbered = x.get("style-name", TEXT) in self.ordered or ordered and x.get("style-name", TEXT) is None
                items = "".join(f"<li>{self._item(i, numbered)}</li>" for i in x.nodes() if i.name in ("list-item", "list-header"))
                tag = "ol" if numbered else "ul"
                out.append(f"<{tag}>{items}</{tag}>")
            elif x.ns == TABLE and x.name == "table":
                rows = [r for r in x.walk() if (r.ns, r.name) == (TABLE, "table-row")]
                cells = lambda r: "".join(f"<td>{self.blocks(c)}</td>" for c in r.nodes() if c.ns == TABLE)
                out.append("<table>" + "".join(f"<tr>{cells(r)}</tr>" for r in rows) + "</table>")
            elif (x.ns, x.name) != (TEXT, "tracked-changes"):
                out.append(self.blocks(x))
        return "".join(out)

    def _item(self, node: Node, ordered: bool) -> str:
        parts = [*node.nodes()]
        if parts and (parts[0].ns, parts[0].name) == (TEXT, "p") and all(p.name == "list" for p in parts[1:]):
            rest = Node("", "", {})
            rest.content = parts[1:]
            return self.inline(parts[0]) + self.blocks(rest, ordered)
        return self.blocks(node, ordered)

    def inline(self, node: Node) -> str:
        out = []
        for x in node.content:
            if isinstance(x, str):
                out.append(escape(x, quote=False))
            elif x.ns == TEXT and x.name == "span":
                body = self.inline(x)
                for tag in sorted(self.styles.get(x.get("style-name", TEXT), ())):
                    body = f"<{tag}>{body}</{tag}>" if body.strip() else body
                out.append(body)
            elif x.ns == TEXT and x.name == "a":
                out.append(f'<a href="{escape(x.get("href", XLINK) or "")}">{self.inline(x)}</a>')
            elif x.ns == TEXT and x.name == "line-break":
                out.append("<br>")
            elif x.ns == TEXT and x.name in ("tab", "s"):
                out.append(" ")
            elif (x.ns, x.name) == (DRAW, "image"):
                name = (x.get("href", XLINK) or "").removeprefix("./")
                if name in self.package.entries:
                    self.files[name] = self.package.part(name, None)
                    out.append(f'<img src="{escape(name)}" alt="">')
            elif (x.ns, x.name) == (OFFICE, "annotation"):
                continue
            else:
                out.append(self.inline(x))
        return "".join(out)


def odt_html(package: Package) -> tuple[str, dict[str, bytes]]:
    root = parse(package.part("content.xml", None), "content.xml")
    reader = _Odt(package, root)
    body = next((t for t in root.walk() if (t.ns, t.name) == (OFFICE, "text")), root)
    return reader.blocks(body), reader.files
