import io
import zipfile

import pytest

from lodestone.sources.parsers import decode, office, parse_column, parse_document

from lodestone.sources.parsers.base import ParseError

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
O = 'xmlns:office="o" xmlns:text="t" xmlns:table="b" xmlns:xlink="x"'
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink"


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def rels(*rows):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{t}" Target="{x}"/>' for i, t, x in rows) + "</Relationships>"


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_lines_keep_their_numbers():
    status, code, _, blocks = parse_document("a.TXT", "one\r\n\r\ntwo\rthree\n \n".encode())
    assert status == "indexed" and code is None
    assert [(b.ordinal, b.content, b.location_value) for b in blocks] == [(0, "one", "第 1 行"), (2, "two", "第 3 行"), (3, "three", "第 4 行")]
    assert parse_document("a.txt", b" \n")[0] == "no_text"
    assert parse_document("a.zzz", None)[0] == "unsupported"
    assert parse_document(".txt", b"x")[0] == "unsupported"


def test_markdown_sections():
    blocks = parse_document("a.md", b"intro\n\n# One\ntext\n```\n# not\n```\n## Two ##\n")[3]
    assert [(b.heading, b.content.split("\n")[0], b.location_value) for b in blocks] == [(None, "intro", "第 1 行"), ("One", "# One", "第 3 行"), ("not", "# not", "第 6 行"), ("Two ##", "## Two ##", "第 8 行")]
    assert [b.heading for b in parse_document("a.md", b" # indented\n#no\n####### seven\n#\tTab\n")[3]] == [None, "Tab"]


def test_csv():
    blocks = parse_document("a.csv", 'h1,h2,h3\r"a,b","c ""q""\nd",\n,,\n,x,y\r\n'.encode())[3]
    assert [(b.ordinal, b.content, b.location_value) for b in blocks] == [(0, "h1 | h2 | h3", "第 1 列（A–C）"), (1, 'a,b | c "q"\nd | ', "第 2 列（A–B）"), (3, " | x | y", "第 4 列（B–C）")]
    for bad in (b'a"b,c', b'"a"b', b'"a'):
        assert parse_document("a.csv", bad)[:2] == ("error", "CSV_FORMAT_ERROR")


def test_html():
    page = '<html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><p>one <b>two</b></p><h2>H &amp; I</h2>x<br>y <a href="/z">link</a><a href="javascript:q">no</a><table><tr><td>a</td><td>b</td></tr></table></body></html>'
    blocks = parse_document("a.html", page.encode())[3]
    assert [(b.heading, b.content) for b in blocks] == [("T", "T"), ("T", "one two"), ("H & I", "H & I"), ("H & I", "x"), ("H & I", "y /z linkno"), ("H & I", "a b")]
    assert parse_document("a.htm", '<meta charset="big5"><p>中文</p>'.encode("big5"))[3][0].content == "中文"


def test_mht():
    mail = 'MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary="b"\r\n\r\n--b\r\nContent-Type: text/html; charset="utf-8"\r\n\r\n<h1>Hi</h1><p>there</p>\r\n--b--\r\n'
    assert [b.content for b in parse_document("a.mht", mail.encode())[3]] == ["Hi", "there"]
    assert parse_document("a.mhtml", b"plain")[1] == "MHT_FORMAT_ERROR"


def test_docx():
    body = f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p/>
    <w:p><w:hyperlink r:id="r1"><w:r><w:t>see</w:t></w:r></w:hyperlink></w:p><w:p><w:r><w:instrText>HYPERLINK "http://f/x%20y"</w:instrText></w:r><w:r><w:t>field</w:t></w:r></w:p>
    <w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""
    data = zipped({"word/document.xml": body, "word/_rels/document.xml.rels": rels(("r1", LINK, "http://e/"), ("r2", LINK, "http://left/"))})
    got = [(b.heading, b.content, b.location_value) for b in parse_document("a.docx", data)[3]]
    assert got == [("Head", "Head", "第 1 段"), ("Head", "see\nhttp://e/", "第 3 段"), ("Head", "field\nhttp://f/x%20y\nhttp://f/x y", "第 4 段"), ("Head", "c1", "表格 1，第 1 列第 1 欄"), ("Head", "c2", "表格 1，第 1 列第 2 欄"), (None, "http://left/", "超連結目標（word/document.xml）")]
    assert parse_document("a.docx", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")[1] == "OFFICE_ENCRYPTED_OR_LEGACY"
    assert parse_document("a.docx", b"nope")[1] == "OFFICE_CORRUPT"


def test_pptx_order_and_notes():
    slide = lambda title, body: f'<p:sld {A}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>{title}</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>{body}</a:t></a:r></a:p></p:sp></p:sld>'
    data = zipped({
        "ppt/presentation.xml": f'<p:presentation {A}><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("r1", "s", "slides/slide1.xml"), ("r2", "s", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide("first file", "b1"),
        "ppt/slides/slide2.xml": slide("second file", "b2"),
        "ppt/slides/_rels/slide2.xml.rels": rels(("n", "s", "../notesSlides/notesSlide1.xml")),
        "ppt/notesSlides/notesSlide1.xml": f'<p:notes {A}><p:sp><p:nvPr><p:ph type="body"/></p:nvPr><a:p><a:r><a:t>note</a:t></a:r></a:p></p:sp></p:notes>',
    })
    assert [(b.heading, b.content, b.location_value) for b in parse_document("a.pptx", data)[3]] == [("second file", "second file\nb2", "投影片 1"), (None, "note", "投影片 1（講者備註）"), ("first file", "first file\nb1", "投影片 2")]


def test_xlsx():
    data = zipped({
        "xl/workbook.xml": f'<workbook {X}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("r1", "s", "worksheets/sheet1.xml")),
        "xl/sharedStrings.xml": f"<sst {X}><si><t>sh</t></si></sst>",
        "xl/styles.xml": f'<styleSheet {X}><numFmts><numFmt numFmtId="170" formatCode="#,##0.00"/><numFmt numFmtId="171" formatCode="0.0%"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {X}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>in</t></is></c><c r="C1" t="b"><v>1</v></c><c r="D1" s="1"><v>45292</v></c><c r="E1" s="2"><v>1234567.5</v></c><c r="F1" s="3"><v>0.125</v></c><c r="G1"><v>7</v></c></row></sheetData><hyperlinks><hyperlink ref="A1" r:id="h1"/><hyperlink ref="Z9" location="S!A1"/></hyperlinks></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": rels(("h1", LINK, "http://l/")),
    })
    got = {b.location_value: b.content for b in parse_document("a.xlsm", data)[3]}
    assert got == {"工作表「S」!A1": "sh\nhttp://l/", "工作表「S」!B1": "in", "工作表「S」!C1": "TRUE", "工作表「S」!D1": "2024-01-01", "工作表「S」!E1": "1,234,567.50", "工作表「S」!F1": "12.5%", "工作表「S」!G1": "7", "工作表「S」!Z9": "#S!A1"}
    assert office.format_number("1.5", "yyyy-mm-dd hh:mm", True) == "1904-01-02 12:00:00"


def test_odt():
    text = f'<office:document-content {O}><office:body><office:text><text:h>Head</text:h><text:p>a<text:s/>b <text:a xlink:href="http://l/">l</text:a></text:p><table:table><table:table-row><table:table-cell><text:p>1</text:p></table:table-cell><table:table-cell><text:p>2</text:p></table:table-cell></table:table-row></table:table></office:text></office:body></office:document-content>'
    assert [(b.heading, b.content, b.location_value) for b in parse_document("a.odt", zipped({"content.xml": text}))[3]] == [("Head", "Head", "標題 1"), ("Head", "a b l\nhttp://l/", "段落 2"), ("Head", "1 | 2", "表格列 3")]
    locked = zipped({"content.xml": text, "META-INF/manifest.xml": "<m><encryption-data/></m>"})
    assert parse_document("a.odt", locked)[:2] == ("encrypted", "ODT_ENCRYPTED")


def test_rtf():
    data = rb'{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\*\generator x;}Caf' rb"\'e9" rb' \u28450?\par two{\field{\*\fldinst HYPERLINK "http://l/"}{\fldrslt here}}\par {\object secret}end}'
    assert [b.content for b in parse_document("a.rtf", data)[3]] == ["Café 漢", "two http://l/ here", "end"]
    assert parse_document("a.rtf", rb"{\rtf1 {")[1] == "RTF_INVALID"


def test_rtf_that_wraps_html():
    data = rb"""{\rtf1\ansi\ansicpg1252\fromhtml1 \deff0{\fonttbl{\f0\fcharset0 Arial;}}{\*\htmltag19 <html><body>}{\*\htmltag64 <p>}\htmlrtf {\htmlrtf0 Caf\'e9 \htmlrtf }\htmlrtf0
\htmlrtf\par\htmlrtf0{\*\htmltag72 </p>}{\*\mhtmltag84 <a href="x">}{\*\htmltag64 <p>}one &amp; two{\*\htmltag72 </p>}{\*\htmltag27 </body></html>}}"""
    assert [(b.content, b.location_value) for b in parse_document("a.rtf", data)[3]] == [("Café", "段落 1"), ("one & two", "段落 2")]


def test_rtf_fonts_name_code_pages():
    data = rb"{\rtf1\ansi\ansicpg1252\deff0{\fonttbl{\f0\fcharset0 A;}{\f1\fcharset204 B;}{\f2\fcharset136 C;}}{\f1 \'c4\'e0}\'e9 {\f2 \'a4\'a4\plain \'e9}}"
    assert [b.content for b in parse_document("a.rtf", data)[3]] == ["Даé 中é"]
    assert parse_document("a.rtf", rb"{\rtf1\ansicpg99999 x}")[1] == "RTF_ENCODING_UNSUPPORTED"
    assert parse_document("a.rtf", rb"{\rtf1 a\bin900 x}")[1] == "RTF_INVALID"


@pytest.mark.parametrize("data, wanted", [("é".encode(), "é"), ("é".encode("utf-16"), "é"), (b"\xef\xbb\xbfx", "x"), ("中文".encode("big5"), "中文")])
def test_decode_text(data, wanted):
    assert decode.decode_text(data) == wanted


def test_decode_xml():
    assert decode.decode_xml('<?xml version="1.0" encoding="ISO-8859-1"?><a>é</a>'.encode("latin-1")).endswith("é</a>")
    assert decode.decode_xml('<?xml version="1.0"?><a>é</a>'.encode("utf-16-le")).endswith("é</a>")
    with pytest.raises(ParseError) as error:
        decode.decode_xml(b'<?xml version="1.0" encoding="nonsense"?><a/>')
    assert error.value.code == "XML_ENCODING_UNSUPPORTED"
    with pytest.raises(ParseError) as error:
        decode.decode_xml('<?xml version="1.0" encoding="utf-8"?><a>é</a>'.encode("latin-1"))
    assert error.value.code == "XML_DECODE_ERROR"
    for label in ("Big5", "cp950", "windows-950", "csBig5", "cn_big5", "x-x-big5"):
        assert "中文" in decode.decode_xml(f'<?xml version="1.0" encoding="{label}"?><a>中文</a>'.encode("big5"))
    with pytest.raises(ParseError) as error:
        decode.decode_text(b"\xff\xff\xff\x80")
    assert error.value.code == "TEXT_DECODE_ERROR"
    assert parse_document("a.html", b'<meta charset="nonsense">x')[1] == "ENCODING_UNSUPPORTED"


def test_links_are_found_as_written_and_decoded():
    assert office.link_texts([" http://x/%E4%B8%AD%2Fa ", "javascript:q", "data:,a", "%zz", "%E4"]) == ["http://x/%E4%B8%AD%2Fa", "http://x/中%2Fa", "javascript:q", "data:,a", "%zz", "%E4"]


def test_decode_xml_keeps_lines():
    assert [b.content for b in parse_document("a.xml", b"<a b='c'>\n<d/>")[3]] == ["<a b='c'>", "<d/>"]


def test_column_of_files(spark):
    files = [(1, "a.txt", b"x\ny"), (2, "b.csv", b'"'), (3, "c.bin", b"\0"), (4, "d.txt", None), (5, "e.txt", b"")]
    got = parse_column(spark.createDataFrame(files, "document_id long, filename string, content binary")).collect()
    assert sorted((r["document_id"], r["status"], r["error_code"], r["content"]) for r in got if r["content"]) == [(1, "indexed", None, "x"), (1, "indexed", None, "y")]
    assert {r["document_id"]: (r["status"], r["error_code"]) for r in got} == {1: ("indexed", None), 2: ("error", "CSV_FORMAT_ERROR"), 3: ("unsupported", None), 4: ("error", "FILE_READ_FAILED"), 5: ("no_text", None)}
