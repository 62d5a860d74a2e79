"""Readers on small files made here."""

import dataclasses
import io
import json
import zipfile
import zlib

import pytest

from leafmill.budget import Budget
from leafmill.engine import Engine
from leafmill.sinks.paths import output_path
from leafmill.sinks.pdf import text_pdf
from leafmill.sources import base
from leafmill.sources.archive import manifest, member
from leafmill.sources.fetch import fetch, file_name
from leafmill.sources.pdf import character_map, words
from leafmill.sources.xbrl import facts


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


HTML = b"""<html lang="en"><head><title>Quarterly  Review</title><meta name="description" content="d"><style>p{}</style></head><body><header>Top</header>
<h1>Quarterly Review</h1><script>var x = "<p>An English sentence.</p>";</script><p>First <b>bold<p>Second<br>line</p><!-- <p>no</p> --><h2>Costs</h2>
<table><tr><th>Region</th><th>Revenue</th></tr><tr><td>North</td><td>412</td></tr></table><ul><li>one <p>inner</p></li><li>two</ul>
<figcaption>Fig</figcaption><div class="ad">dropped</div><nav><ul><li><a href="a">One</a></li><li><a href="b">Two</a></li></ul></nav><h3>Outlook</h3><img src="x"></body>"""


def test_html():
    d = base.read("a.html", HTML)
    assert [(b.kind, b.text) for b in d.blocks] == [
        ("head_foot", "Top"), ("heading", "Quarterly Review"), ("para", "First bold"), ("para", "Secondline"), ("heading", "Costs"), ("table", "Region\tRevenue\nNorth\t412"),
        ("list", "one inner"), ("list", "two"), ("caption", "Fig"), ("head_foot", "OneTwo"), ("heading", "Outlook"),
    ]
    assert [b.level for b in d.blocks if b.kind == "heading"] == [1, 2, 3] and d.blocks[5].rows == [["Region", "Revenue"], ["North", "412"]]
    assert d.meta == {"title": "Quarterly  Review".replace("  ", " "), "lang": "en", "links": 2, "images": 1, "tables": 1, "headings": 3, "description": "d"}
    assert [b.text for b in base.read("b.html", b"just <i>text</i> here").blocks] == ["just text here"]
    assert [b.page for b in base.paged(base.read("c.html", b""))] == [1]
    long = base.paged(base.read("l.html", "".join(f"<p>Paragraph {i:03d}. {'x' * 90}</p>" for i in range(60)).encode()))
    assert long[-1].page == 3 and all(sum(len(b.text) for b in long if b.page == p) <= 2800 for p in (1, 2, 3))


def test_text_markdown_csv():
    assert [b.text for b in base.read("n.txt", b"a\nb\n\n\nc\n \nd").blocks] == ["a\nb", "c", "d"]
    md = base.read("r.md", b"# One\ntext\n\nTwo\n---\n```\n# Not a heading\n```\nThree\n=====\n####### no\n").blocks
    assert [(b.kind, b.level, b.text) for b in md] == [("heading", 1, "One"), ("para", None, "text"), ("heading", 2, "Two"), ("para", None, "```\n# Not a heading\n```\nThree\n=====\n####### no")]
    rows = base.read("s.csv", b'a;b;c\n1;"x;y";"two\nlines"\n;;\n2;z;w\n').blocks[0].rows
    assert rows == [["a", "b", "c"], ["1", "x;y", "two\nlines"], ["2", "z", "w"]]
    assert base.read("l.txt", "café au lait, s'il vous plaît, pour les élèves".encode("latin-1")).blocks[0].text.startswith("caf")


def test_mail():
    raw = b"From: a@x\r\nTo: b@x\r\nSubject: =?utf-8?q?Caf=C3=A9?=\r\nDate: Mon, 1 Jan 2024 00:00:00 +0000\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: multipart/alternative; boundary=C\r\n\r\n--C\r\nContent-Type: text/plain\r\n\r\nPlain body.\r\n\r\n> quoted\r\n--C\r\nContent-Type: text/html\r\n\r\n<p>Html body</p>\r\n--C--\r\n--B\r\nContent-Type: text/csv\r\nContent-Disposition: attachment; filename=d.csv\r\n\r\n1,2\r\n--B--\r\n"
    texts = [b.text for b in base.read("m.eml", raw).blocks]
    assert texts[0] == "Café" and "Plain body." in texts and "> quoted" in texts and texts[-1] == "Attachments: d.csv" and not any("Html" in t for t in texts)
    only = b"Subject: s\r\nContent-Type: text/html\r\n\r\n<p>Shown</p><script>hidden</script>"
    assert [b.text for b in base.read("h.eml", only).blocks] == ["s", "Shown"]


W = 'xmlns:w="w" xmlns:r="r" xmlns:a="a" xmlns:p="p"'
DOCX = {
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:styleId="L"><w:name w:val="List Bullet"/></w:style></w:styles>',
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="T"/></w:pPr><w:r><w:t>Report</w:t></w:r></w:p><w:p><w:r><w:t>A </w:t></w:r><w:r><w:t>para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Next</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="L"/></w:pPr><w:r><w:t>item</w:t></w:r></w:p></w:body></w:document>',
}


def _shape(text, y, kind=""):
    return f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/><a:ext cx="100" cy="100"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'


PPTX = {
    "ppt/presentation.xml": f'<p:presentation {W}><p:sldIdLst><p:sldId id="256" r:id="r1"/><p:sldId id="257" r:id="r2"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/s1.xml"/><Relationship Id="r2" Target="slides/s2.xml"/></Relationships>',
    "ppt/slides/s1.xml": f"<p:sld {W}>{_shape('Body', 900)}{_shape('Head', 100, '<p:ph type=%stitle%s/>' % (chr(34), chr(34)))}</p:sld>",
    "ppt/slides/_rels/s1.xml.rels": '<Relationships><Relationship Id="n" Target="../notesSlides/n1.xml"/></Relationships>',
    "ppt/notesSlides/n1.xml": f"<p:notes {W}>{_shape('Say this', 0)}</p:notes>",
    "ppt/slides/s2.xml": f"<p:sld {W}></p:sld>",
}
XLSX = {
    "xl/workbook.xml": f'<workbook {W}><sheets><sheet name="Revenue" r:id="r1"/><sheet name="Notes" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>Region</t></si><si><t>North</t></si></sst>",
    "xl/worksheets/a.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row r="2"><c r="A2"/></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><f>A1</f></c></row><row r="400"><c r="Z400"/></row></sheetData></worksheet>',
    "xl/worksheets/b.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>n</t></is></c></row></sheetData></worksheet>',
}
EPUB = {
    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>',
    "O/p.opf": '<package><metadata><title>Book</title></metadata><manifest><item id="c3" href="c3.html"/><item id="c1" href="c1.html"/><item id="c2" href="c%202.html"/></manifest><spine><itemref idref="c1"/><itemref idref="c2"/><itemref idref="gone"/><itemref idref="c3"/></spine></package>',
    "O/c3.html": "<h1>Three</h1>",
    "O/c1.html": "<h1>One</h1><p>text</p>",
}


def test_office_and_books():
    d = base.read("r.docx", zipped(**DOCX))
    assert [(b.kind, b.level, b.text) for b in d.blocks] == [("heading", 1, "Report"), ("para", None, "A para"), ("table", None, "x\t1"), ("heading", 1, "Next"), ("list", None, "item")]
    d = base.read("d.pptx", zipped(**PPTX))
    assert [(b.page, b.kind, b.text) for b in d.blocks] == [(1, "heading", "Head"), (1, "para", "Body"), (1, "head_foot", "Say this"), (2, "para", "")] and d.page_count == 2
    d = base.read("b.xlsx", zipped(**XLSX))
    assert [(b.page, b.kind, b.rows or b.text) for b in d.blocks] == [(1, "heading", "Revenue"), (1, "table", [["Region", "", "5"], ["North"]]), (2, "heading", "Notes"), (2, "table", [["n"]])]
    d = base.read("b.epub", zipped(**EPUB))
    assert [(b.page, b.text) for b in d.blocks] == [(1, "One"), (1, "text"), (2, ""), (3, "Three")] and d.page_count == 3


XBRL = b"""<xbrl xmlns:u="u"><context id="c1"><entity/><period><instant>2024-12-31</instant></period></context><context id="c2"><period><startDate>2024-01-01</startDate><endDate>2024-12-31</endDate></period><segment><explicitMember>u:North</explicitMember></segment></context>
<unit id="usd"><measure>iso:USD</measure></unit><u:NetIncomeLoss contextRef="c2" unitRef="usd" decimals="-3">1234000</u:NetIncomeLoss><u:Name contextRef="c9">Acme</u:Name><u:Empty contextRef="c1"> </u:Empty><u:PolicyTextBlock contextRef="c1">&lt;p&gt;We account.&lt;/p&gt;</u:PolicyTextBlock></xbrl>"""


def test_xbrl_and_archives():
    assert facts(XBRL) == [["Net Income Loss", "2024-01-01 to 2024-12-31 | North", "USD", "1234000", "-3"], ["Name", "c9", "", "Acme", ""]]
    d = base.read("i.xbrl", XBRL)
    assert d.meta["numeric_facts"] == 1 and d.basis == "tagged" and [b.text for b in d.blocks[1:]] == ["Policy", "We account."]
    with pytest.raises(base.ReadError):
        base.read("i.xml", b'<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')
    bundle = zipped(**{"a.txt": "hello", "x.bin": "b", "in/c.html": "<p>c</p>"})
    assert manifest(bundle) == [("a.txt", "txt", 5, True), ("x.bin", "bin", 1, False), ("in/c.html", "html", 8, True)]
    assert base.read("b.zip::in/c.html", bundle).blocks[0].text == "c" and member(bundle, "a.txt") == b"hello"
    assert base.read("b.zip", bundle).blocks[0].rows[1] == ["a.txt", "txt", "5", "yes"]
    for name in ("../a.txt", "/a.txt", "nope"):
        with pytest.raises(base.ReadError):
            member(bundle, name)
    with pytest.raises(base.ReadError, match="times"):
        manifest(zipped(bomb=b"0" * 5_000_000))
    with pytest.raises(base.ReadError, match="members"):
        manifest(zipped(**{f"f{i}": "" for i in range(2001)}))
    with pytest.raises(base.ReadError) as bad:
        base.read("x.msg", b"")
    assert bad.value.hint


def pdf(*contents, cmap=b"", extra=b""):
    parts = [b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj", b"2 0 obj <</Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents))) + b"] /Count 1>> endobj", b"3 0 obj <</Type /Font /ToUnicode 4 0 R>> endobj", b"4 0 obj <<>> stream\n" + cmap + b"\nendstream endobj"]
    for i, c in enumerate(contents):
        packed = zlib.compress(c)
        font = b"/Resources <</Font <</F1 3 0 R>> >>" if cmap else b""
        parts += [b"%d 0 obj <</Type /Page /MediaBox [0 0 612 792] %s /Contents %d 0 R>> endobj" % (10 + 2 * i, font, 11 + 2 * i), b"%d 0 obj <</Filter /FlateDecode>> stream\n" % (11 + 2 * i) + packed + b"\nendstream endobj"]
    return b"%PDF-1.4\n" + b"\n".join(parts) + extra


def test_pdf():
    text = b"BT /F1 12 Tf 72 700 Td (First line of a page that is long enough) Tj 0 -16 Td [(kern) -50 (ed and) -300 (spaced \\(x\\))] TJ ET"
    d = base.read("a.pdf", pdf(text, b"0 0 100 100 re f", b""))
    assert [(b.page, b.text) for b in d.blocks] == [(1, "First line of a page that is long enough"), (1, "kerned and spaced (x)"), (2, ""), (3, "")]
    assert d.meta["page_kinds"] == "text_layer,scanned,empty" and d.page_count == 3
    assert words(pdf(text))[0][:4] == (1, "First", 72.0, 80.0)
    cmap = b"beginbfchar <01> <0041> endbfchar beginbfrange <02> <04> <0042> <10> <11> [<0058> <00590059>] endbfrange"
    assert character_map(cmap) == ({1: "A", 2: "B", 3: "C", 4: "D", 16: "X", 17: "YY"}, 1)
    wide = b"begincodespacerange <0000> <FFFF> endcodespacerange beginbfchar <0001> <0041> <0002> <0042> endbfchar"
    assert base.read("w.pdf", pdf(b"BT /F1 10 Tf 10 10 Td <00010002> Tj ET", cmap=wide)).blocks[0].text == "AB"
    assert base.read("g.pdf", pdf(b"BT /F1 10 Tf 10 10 Td <0102031105> Tj ET", cmap=cmap)).blocks[0].text == "ABCYY�"
    with pytest.raises(base.ReadError, match="encrypted"):
        base.read("e.pdf", pdf(text, extra=b"\ntrailer <</Encrypt 9 0 R>>"))


def shown(x, y, text):
    return b"BT /F1 10 Tf %d %d Td (%s) Tj ET " % (x, y, text.encode())


def two_columns():
    left = b"".join(shown(60, 700 - 14 * i, f"left row {i} goes on here") for i in range(24))
    right = b"".join(shown(330, 700 - 14 * i, f"right row {i} goes on") for i in range(24))
    return right + left + shown(60, 740, "A running head that spans both of the columns of this page, whole")


def ruled():
    lines = b"".join(b"%d %d 120 30 re S " % (100 + 120 * c, 500 + 30 * r) for r in range(2) for c in range(2))
    return lines + shown(105, 540, "Name:") + shown(225, 545, "Rate and") + shown(225, 533, "term") + shown(105, 510, "Loan") + shown(225, 510, "4.5") + shown(100, 650, "Before the table there is a line of text")


def test_pdf_pages_have_a_layout():
    d = base.read("two.pdf", pdf(two_columns()))
    texts = [b.text for b in d.blocks if " row " in b.text]  # the head's words go to the column that holds them
    assert texts == [f"left row {i} goes on here" for i in range(24)] + [f"right row {i} goes on" for i in range(24)] and d.blocks[0].text.startswith("A running head")
    assert json.loads(d.meta["layout"])[0]["columns"] == 2 and not [b for b in d.blocks if b.kind == "table"]
    d = base.read("ruled.pdf", pdf(ruled()))
    table = [b for b in d.blocks if b.kind == "table"]
    assert [(t.basis, t.rows) for t in table] == [("ruled", [["Name:", "Rate and term"], ["Loan", "4.5"]])]
    gaps = b"".join(shown(100, 600 - 14 * i, f"item{i}") + shown(300, 600 - 14 * i, f"{i}.50") for i in range(5)) + shown(100, 650, "A heading of some words")
    table = [b for b in base.read("gaps.pdf", pdf(gaps)).blocks if b.kind == "table"]
    assert [(t.basis, t.rows) for t in table] == [("whitespace", [[f"item{i}", f"{i}.50"] for i in range(5)])]


def test_pdf_bookmarks():
    marks = b"""\n5 0 obj <</Type /Catalog /Pages 2 0 R /Outlines 6 0 R>> endobj
6 0 obj <</First 7 0 R>> endobj
7 0 obj <</Title (Part \\(one\\)) /Dest [10 0 R /Fit] /First 8 0 R /Next 9 0 R>> endobj
8 0 obj <</Title <FEFF00E9> /A <</S /GoTo /D [12 0 R /Fit]>> >> endobj
9 0 obj <</Title (Elsewhere)>> endobj"""
    d = base.read("b.pdf", pdf(shown(60, 700, "x" * 40), shown(60, 700, "y" * 40)) + marks)
    assert json.loads(d.meta["bookmarks"]) == [{"level": 1, "title": "Part (one)", "page": 1}, {"level": 2, "title": "\u00e9", "page": 2}, {"level": 1, "title": "Elsewhere", "page": None}]


def test_pdf_sink_reads_back():
    made = text_pdf(["first page of (text)\n  indented \\ line", "word " * 400, ""])
    d = base.read("s.pdf", made)
    assert d.blocks[0].text == "first page of (text)" and "indented \\ line" in d.blocks[1].text
    assert sum(b.text.count("word") for b in d.blocks) == 400


def test_output_paths():
    assert output_path("", "file:/in/a.pdf", ".md") == "a_out.md" and output_path("", "/in/z.zip::b.txt", ".md", "/out") == "/out/z.zip_b_out.md"
    assert output_path("sub/x.md", "a", ".md", "/out") == "/out/sub/x.md" and output_path("file:/out/x", "a", "", "file:/out") == "file:/out/x"
    for bad in ("../x", "/etc/x", "s3a://b/x", "/outside", "sub/../../x"):
        with pytest.raises(base.ReadError, match="outside"):
            output_path(bad, "a", ".md", "/out")


def test_fetch(spark):
    import http.server
    import threading

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.send_header("Content-Type", "text/markdown; charset=utf-8")
            self.end_headers()
            self.wfile.write(b"# Title" if self.path == "/a" else b"x" * 5000)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    rows = [(f"{at}/a",), (f"{at}/big",), ("ftp://x/y",)]
    urls = spark.createDataFrame(rows, "url string")
    got = {r.url: r for r in fetch(urls, budget=Budget(source_bytes=1000), allowed=lambda u: None).collect()}
    assert (got[f"{at}/a"].name, bytes(got[f"{at}/a"].content), got[f"{at}/a"].error) == ("a.md", b"# Title", None)
    assert "over 1000 bytes" in got[f"{at}/big"].error and got["ftp://x/y"].error
    private = {r.url: r for r in fetch(urls).collect()}
    assert "not public" in private[f"{at}/a"].error and "no http" in private["ftp://x/y"].error
    blocks = base.read_column(fetch(urls.limit(1), allowed=lambda u: None), "name", "content").collect()
    assert [(b.kind, b.text) for b in blocks] == [("heading", "Title")]
    assert file_name("http://x/", 'attachment; filename="..a b.pdf"') == "a_b.pdf" and file_name("http://x/", "", "application/pdf") == "download.pdf"
    server.shutdown()


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    (folder / "a.html").write_bytes(HTML)
    (folder / "bad.docx").write_bytes(b"not a zip")
    (folder / "r.md").write_text("# One\n\nmail me at x@y.z\n\nsecond ant and Ant\n")
    (folder / "long.txt").write_text("\n\n".join(f"Paragraph {i} " + f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x " * 300 for i in range(60)))
    (folder / "big.txt").write_text("x" * 200_000)
    (folder / "hybrid.pdf").write_bytes(pdf(two_columns(), ruled(), b"0 0 100 100 re f", b"0 0 90 90 re f", b""))
    with zipfile.ZipFile(folder / "z.zip", "w") as z:
        z.writestr("in.txt", "inside")
    return Engine.open(spark, str(folder), budget=Budget(source_bytes=150_000)), "file:" + str(folder)


def test_engine(engine, tmp_path):
    e, folder = engine

    def run(op, name=None, /, **more):
        return e.run(op, **({"source": f"{folder}/{name}"} if name else {}), **more)

    made = run("probe", "r.md")
    assert made["success"] and made["basis"] == "native" and made["result"]["pages"] == 1 and made["result"]["format"] == "markdown" and made["token_estimate"] > 0
    assert [x["title"] for x in run("outline", "a.html")["result"]["entries"]] == ["Quarterly Review", "Costs", "Outlook"]
    found = run("find", "r.md", query="ant", max_hits=1)["result"]
    assert (found["hits"], found["returned"], found["truncated"], found["pages"]) == (2, 1, True, "1")
    found = run("find", "r.md", query=r"(?P<user>\w+)@(?P<host>[\w.]+)", regex=True)["result"]
    assert found["matches"][0]["groups"] == {"user": "x", "host": "y.z"}
    refused = run("extract", "long.txt")
    assert refused["refused"] and refused["hint"].startswith("ask for pages 1-")
    fits = run("extract", "long.txt", pages=refused["hint"].rsplit(" ", 1)[1])
    assert fits["success"] and fits["result"]["characters"] <= 32_500  # the hint can be followed at once
    assert "Paragraph 0" in fits["result"]["text"] and fits["result"]["cleaned"]["running_heads_checked"]
    assert run("extract_tables", "a.html")["result"]["by_basis"] == {"native": 1}
    assert run("extract_tables", "a.html", min_confidence=1.1)["result"]["found_before_filter"] == 1
    assert run("read_page", "a.html", page=1)["result"]["tables"] == [[["Region", "Revenue"], ["North", "412"]]]
    md = run("to_markdown", "a.html")["result"]
    assert "# Quarterly Review" in md["markdown"] and "| North | 412 |" in md["markdown"] and md["headings"] == 3
    done = run("assemble", sources=[f"{folder}/long.txt", f"{folder}/r.md"], select="r:1,long:2-3r90,1", out=str(tmp_path / "as"))
    assert done["result"]["pages_written"] == 4
    assert run("convert", "r.md", to="html", out=str(tmp_path / "html"))["success"]
    assert run("convert", "r.md", to="docx", out="x")["refused"]
    gone = run("redact", "r.md", pattern="x@y.z", out=str(tmp_path / "red"))["result"]
    assert (gone["redacted"], gone["verified"], gone["residual_matches"]) == (1, True, 0)
    assert run("ocr", "r.md")["result"]["pages_ocred"] == 0
    for bad in (run("probe", "bad.docx"), run("probe", "big.txt"), run("probe", "r.mdd"), run("find", "r.md", query=""), run("find", "r.md", query="(", regex=True), run("extract", "r.md", pages="9"),
                run("serch", "r.md"), run("find", "r.md", qery="x"), run("find", "r.md"), run("read_page", "r.md", page="1"), run("optimize", "r.md"), run("protect", "r.md", action="encrypt")):
        assert not bad["success"] and bad["error"] and bad["hint"]
    assert run("extracts", "r.md")["hint"] == "did you mean extract" and run("find", "r.md", qery="x")["hint"] == "did you mean query"


def test_engine_reads_pdf_pages(engine, tmp_path):
    e, folder = engine
    run = lambda op, **more: e.run(op, source=f"{folder}/hybrid.pdf", **more)
    probed = run("probe")["result"]
    assert (probed["born_digital"], probed["scanned"], probed["empty"], probed["scanned_pages"], probed["ruled_pages"], probed["page_size"]) == (2, 2, 1, "3-5", "2", [612.0, 792.0])
    text = run("extract", pages="1")["result"]
    assert text["columns"] == [2] and text["text"].index("left row 23") < text["text"].index("right row 0")
    assert run("extract_tables")["result"]["by_basis"] == {"ruled": 1}
    page = run("read_page", page=2)["result"]
    assert page["size"] == [612.0, 792.0] and page["tables"] == [[["Name:", "Rate and term"], ["Loan", "4.5"]]]
    md = run("to_markdown", pages="2")["result"]["markdown"]
    assert "| Loan | 4.5 |" in md and md.count("Loan") == 1 and md.index("Before") < md.index("| Name:")
    assert run("ocr")["refused"] and run("convert", to="images")["refused"] and "dpi=" in run("convert", to="images", pages="1-2", dpi=3000)["hint"]
    plugged = dataclasses.replace(e, recogniser=lambda source, pages: {p: f"read {p}" for p in pages}, out_root=str(tmp_path), renderer=lambda *a: None, cipher=lambda *a: None, rewriter=lambda s, a, o: (100, 50))
    run = lambda op, **more: plugged.run(op, source=f"{folder}/hybrid.pdf", **more)
    done = run("ocr")["result"]
    assert (done["pages_ocred"], done["pages"], done["pages_still_without_text"]) == (2, "3-4", 1)
    assert run("convert", to="images", pages="1")["success"] and run("optimize")["result"]["bytes_after"] == 50 and run("protect", action="encrypt", password="x")["success"]
    assert run("convert", to="pdf", pages="1", out="o.pdf")["result"]["bytes"] == len((tmp_path / "o.pdf").read_bytes())
    assert not run("convert", to="pdf", pages="1", out="../o.pdf")["success"]
    assert plugged.run("convert", source=f"{folder}/z.zip::in.txt", to="file")["success"] and (tmp_path / "in.txt").read_text() == "inside"


def test_a_slow_pattern_is_a_refusal(spark):
    blocks = base.read_column(spark.createDataFrame([("a.txt", "word " * 12 + "a" * 40 + "!")], "name string, text string"), "name", "text")
    e = Engine(spark, blocks, Budget(regex_seconds=0.3))
    for made in (e.run("find", source="a.txt", query=r"(\s*\w+)+$", regex=True), e.run("redact", source="a.txt", pattern=r"(\s*\w+)+$", regex=True)):
        assert not made["success"] and made["refused"] and made["limit"] == 0.3


def test_corpus_frames(engine):
    e, _ = engine
    assert e.probe_frame().count() == 5 and e.tables_frame().count() == 2 and e.extract_frame().count() == 5
    assert e.blocks.where("error IS NOT NULL").count() == 2 and e.find_frame("ant").count() >= 2
    assert e.markdown_frame().count() == 5 and e.outline_frame().where("basis = 'native'").count() == 4
