"""Text state machines: normaliser, link targets, master paragraphs, images, HTML and rich text."""

import pytest

from docloom.functions import gfm, images, links, markdown
from docloom.functions.render_text import tsv_cell, unescaped_tsv, workbook
from docloom.sources import build, odm, rtf, wordml, xlsx
from docloom.sources.convert import convert, convert_package, resolve_master
from docloom.sources.workbook import Cell, Sheet, Workbook, WorkbookError
from docloom.sources.zipgate import open_package


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Text\\\ncontinued\n\n****\\\n\nNext\n", "Text  \ncontinued\n  \nNext\n"),
        ("Paragraph\\\n\nBefore list\\\n- item\nEnd\\", "Paragraph\n\nBefore list\n- item\nEnd"),
        ("***• ***\n\n***• ***\n\n\\- item\n\n\\_\\_\\_\\_\n", "-\n-\n\n- item\n\n____\n"),
        ("- item\n\n    ***• ***\n\n    \\- sub item\n", "- item\n\n    -\n\n    - sub item\n"),
        ("```\n\\- x\\\n\n\n```\n\\- y\n", "```\n\\- x\\\n\n\n```\n- y\n"),
        ("    code\\\n\n    \\- code\n", "    code\\\n\n    \\- code\n"),
        ("a\r\nb\\\\\r\n", "a\nb\\\\\n"),
        ("", ""),
    ],
)
def test_normalized(given, wanted):
    assert markdown.normalized(given) == wanted


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("![a](images/x)", "![a](new/x)"),
        ("[a](<images/x>)", "[a](<new/x>)"),
        ('[a](images/x "title") [b](<images/x> "t")', '[a](new/x "title") [b](<new/x> "t")'),
        ("[![a](images/x)](images/x)", "[![a](new/x)](new/x)"),
        ("no link](images/x)", "no link](images/x)"),
        ("[a]](images/x)", "[a]](images/x)"),
        ("[a](images/x.png) [b](images/x", "[a](images/x.png) [b](images/x"),
        ("[a](<images/x y>) [b] (images/x)", "[a](<images/x y>) [b] (images/x)"),
        ("`[](images/x)` [a](images/x)", "`[](images/x)` [a](new/x)"),
        ("``a ` [](images/x)`` [](images/x)", "``a ` [](images/x)`` [](new/x)"),
        ("[a \\](images/x)", "[a \\](images/x)"),
        ("\\[a](images/x)", "\\[a](images/x)"),
        ("```\n[](images/x)\n```\n[](images/x)", "```\n[](images/x)\n```\n[](new/x)"),
        ("    [](images/x)\n\n[](images/x)", "    [](images/x)\n\n[](new/x)"),
        ("para\n    [](images/x)", "para\n    [](new/x)"),
        ("- a\n\n      [](images/x)\n\n  [](images/x)", "- a\n\n      [](images/x)\n\n  [](new/x)"),
        ("> ```\n> [](images/x)\n\n[](images/x)", "> ```\n> [](images/x)\n\n[](new/x)"),
        ("`open [](images/x)\n\n` [](images/x)", "`open [](new/x)\n\n` [](new/x)"),
        ("[two\nlines](images/x)", "[two\nlines](new/x)"),
    ],
)
def test_links(given, wanted):
    assert links.rewritten(given, "images/x", "new/x") == wanted


def master(body):
    head = f'<office:document-content xmlns:office="{odm.ods.OFFICE if hasattr(odm, "ods") else "urn:oasis:names:tc:opendocument:xmlns:office:1.0"}" xmlns:text="{odm.TEXT}" xmlns:xlink="{odm.XLINK}">'
    return build.package({"mimetype": odm.MIMETYPE, "content.xml": f"{head}<office:body><office:text>{body}</office:text></office:body></office:document-content>"})


def paragraphs(body):
    return [i.text for i in odm.read_items(open_package(master(body)))]


@pytest.mark.parametrize(
    "body, wanted",
    [
        ("<text:p>Before<text:note><text:p>Note.</text:p></text:note>After</text:p>", ["Before Note. After"]),
        ("<text:p>a<text:note><text:p>(b)</text:p></text:note>, c</text:p>", ["a (b), c"]),
        ("<text:p>~~left as it is~~ &amp;lt;</text:p>", ["\\~\\~left as it is\\~\\~ \\&lt;"]),
        ('<text:p><text:s text:c="4"/>x</text:p><text:p><text:tab/>y</text:p>', ["&nbsp;" * 4 + "x", "&nbsp;" * 4 + "y"]),
        ("<text:p># a</text:p><text:p>12. b</text:p><text:p>- c</text:p>", ["\\# a", "12\\. b", "\\- c"]),
        ('<text:h text:outline-level="9">T</text:h>', ["###### T"]),
        ("<text:p>a<text:line-break/>b</text:p>", ["a  \nb"]),
        ("<text:p> <text:note><text:p> x </text:p></text:note><text:note><text:p>y<text:s/></text:p></text:note>z </text:p>", ["x y z"]),
        ("<text:p><text:note><text:p><text:s/></text:p></text:note>a<text:note><text:p/></text:note>b</text:p>", [" ab"]),
        ("<text:p>see „<text:span><text:note><text:p>n</text:p></text:note></text:span>“ (<text:note><text:p>m</text:p></text:note>)</text:p>", ["see „n“ (m)"]),
    ],
)
def test_master_paragraphs(body, wanted):
    assert paragraphs(body) == wanted


def odt(body, files=None):
    head = f'<office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="{odm.TEXT}" xmlns:xlink="{odm.XLINK}" xmlns:draw="{wordml.DRAW}">'
    return build.package({"mimetype": wordml.ODT_MIMETYPE, "content.xml": f"{head}<office:body><office:text>{body}</office:text></office:body></office:document-content>", **(files or {})})


def test_master_with_sections():
    section = '<text:section text:name="%s"><text:section-source xlink:href="%s"/><text:p>hidden</text:p></text:section>'
    m = convert("/d/All.odm", master("<text:p>Intro</text:p>" + section % ("One", "./a.odt") + section % ("Two", "b.odt")))
    image = '<text:p>see <draw:frame><draw:image xlink:href="Pictures/p.PNG"/></draw:frame></text:p>'
    a = convert("/d/a.odt", odt("<text:h>A</text:h>" + image, {"Pictures/p.PNG": b"png"}))
    b = convert("/d/b.odt", odt("<text:p>B</text:p>"))
    r = resolve_master(m, {"a.odt": a, "b.odt": b})
    assert r.markdown == "# All\n\nIntro\n\n## Section: One\n\n# A\n\nsee ![](images/section01-image01.png)\n\n## Section: Two\n\nB\n"
    assert r.assets == {"images/section01-image01.png": b"png"} and [c for c, _ in r.warnings] == ["openDocumentMaster.flattened"]
    assert resolve_master(m, {"a.odt": a}).status == "error"
    assert "leaves the document bundle" in resolve_master(convert("/d/x.odm", master(section % ("x", "../a.odt"))), {}).error


def test_images():
    html, assets, names = images.rewrite('<img src="b%20c.PNG"><IMG alt="" src=\'./d.jpg\'><img src="b%20c.PNG">', {"b c.PNG": b"1", "d.jpg": b"2"})
    assert html == '<img src="images/image01.png"><IMG alt="" src=\'images/image02.jpg\'><img src="images/image01.png">'
    assert assets == {"images/image01.png": b"1", "images/image02.jpg": b"2"} and names == {"b c.PNG", "d.jpg"}
    assert images.rewrite('<img src="">', {}) == ('<img src="">', {}, set())  # no source, so nothing to rewrite
    for bad in ("http://x/y.png", "../a", "/a", "a\\b", "missing.png"):
        with pytest.raises(images.UnsafeReference):
            images.rewrite(f'<img src="{bad}">', {})


def test_gfm():
    html = "<h2>T</h2><p>a <b>b</b> <em>c</em> <a href='x y'>l</a><br>d*</p><ul><li>one<ol><li>two</li></ol></li></ul><table><tr><td>a|b</td></tr><tr><td>c</td><td>d</td></tr></table><pre>x```\n</pre><blockquote><p>q</p></blockquote><p># no</p>"
    assert gfm.markdown(html) == (
        "## T\n\na **b** *c* [l](<x y>)  \nd\\*\n\n- one\n  1. two\n\n| a\\|b |  |\n| --- | --- |\n| c | d |\n\n````\nx```\n````\n\n> q\n\n\\# no\n"
    )


def test_docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("one") + "<w:p><w:ins><w:r><w:rPr><w:i/></w:rPr><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p>"
    kinds = [*wordml.MAIN_TYPES]

    def doc(kind, more=None):
        return build.package({
            "[Content_Types].xml": f'<Types xmlns="{xlsx.TYPES}"><Override PartName="/word/document.xml" ContentType="{kind}"/></Types>',
            "word/document.xml": f'<w:document xmlns:w="{wordml.W}"><w:body>{body}</w:body></w:document>', **(more or {}),
        })

    r = convert("/x/a.docm", doc(kinds[3]))
    assert r.markdown == "one\n\n*new*\n"
    assert [c for c, _ in r.warnings] == ["wordProcessing.macrosNotPreserved", "wordProcessing.templateSemanticsNotPreserved", "wordProcessing.changesAccepted"]
    rels = f'<Relationships xmlns="{xlsx.RELS}"><Relationship Id="r" Type="x/image" TargetMode="External" Target="http://x/y.png"/></Relationships>'
    assert "unsafe image reference: http://x/y.png" in convert("/x/a.docx", doc(kinds[0], {"word/_rels/document.xml.rels": rels})).error
    assert convert("/x/a.docx", doc("other/type")).error_kind == "invalid_input"


def test_rtf():
    r = convert("/x/a.rtf", b"{\\rtf1{\\fonttbl{\\f0 Arial;}}A \\b b\\b0\\line c\\par {\\i d}\\'e4\\u8364?\\\\\\{\\par{\\pict\\pngblip 89504e47}\\bin3 \\}}\\par}")
    assert r.markdown.startswith("A **b**  \nc\n\n*d*ä€\\\\{\n") and r.assets == {"images/image01.png": b"\x89PNG"}
    assert rtf.loses_colour(b"{\\rtf1{\\colortbl;\\red200\\green0\\blue0;}\\cf1 x}") and not rtf.loses_colour(b"{\\rtf1{\\colortbl;\\red9\\green9\\blue9;}\\cf1 x}")
    p = convert_package("/x/a.rtfd", {"TXT.rtf": b"{\\rtf1 x}", "b.pdf": b"", ".hidden": b"", "a.pdf": b""})
    assert [m.rpartition(": ")[2] for _, m in p.warnings] == ["a.pdf", "b.pdf"] and p.markdown == "x\n"


def test_rtfd_colours_and_attachments():
    head = b"{\\rtf1{\\colortbl;\\red128\\green0\\blue128;\\red90\\green90\\blue90;}"
    body = b"Plain \\cf1 Purple one\\line Purple \\b two\\b0 \\cf2  Gray\\par {{\\NeXTGraphic a b.png \\width10}\\'ac}\\par}"
    p = convert_package("/x/a.rtfd", {"TXT.rtf": head + body, "a b.png": b"png", "c.png": b"x"})
    assert p.markdown == "Plain ==Purple one==  \n==Purple **two**== Gray\n\n![](images/image01.png)\n"
    assert p.assets == {"images/image01.png": b"png"} and [m.rpartition(": ")[2] for _, m in p.warnings] == ["c.png"]


def test_tsv():
    cells = ["a\tb", "c\nd", "e\\f", "\\n", "`" * 3]
    assert [unescaped_tsv(tsv_cell(c)) for c in cells] == cells
    sheet = Workbook([Sheet("S\nx", [[Cell("string", c, c) for c in cells], []])])
    assert workbook(sheet, "w", "tsv") == "# w\n\n## Sheet: S x\n\n````tsv\na\\tb\tc\\nd\te\\\\f\t\\\\n\t```\n\t\t\t\t\n````\n"
    with pytest.raises(WorkbookError, match="the spreadsheet output exceeds the supported size limit"):
        workbook(sheet, "w", limit=30)
