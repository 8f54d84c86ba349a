"""Small files of every format, made from a title and a line of text: what the parsers' queries read."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name spaces of the formats.
WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SLIDE = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
TEXT = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zip(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        for name, text in parts.items():
            file.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _relations(*targets: tuple[str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="r{k}" Type="{RELATIONS}/{kind}" Target="{target}"/>' for k, (kind, target) in enumerate(targets, 1)) + "</Relationships>"


def docx(title: str, line: str) -> bytes:
    t, x = escape(title), escape(line)
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p><w:p><w:r><w:t>{x}</w:t></w:r></w:p>'
    table = f"<w:tbl><w:tr><w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return _zip(**{"word/document.xml": f"<w:document {WORD}><w:body>{body}{table}</w:body></w:document>"})


def pptx(title: str, line: str) -> bytes:
    shape = lambda kind, text: f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = f"<p:sld {SLIDE}><p:cSld><p:spTree>{shape('<p:ph type=\"title\"/>', title)}{shape('', line)}</p:spTree></p:cSld></p:sld>"
    return _zip(**{"ppt/presentation.xml": f'<p:presentation {SLIDE}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": _relations(("slide", "slides/slide1.xml")), "ppt/slides/slide1.xml": slide})


def xlsx(title: str, line: str) -> bytes:
    rows = f'<row r="1"><c r="A1" t="inlineStr"><is><t>{escape(line)}</t></is></c><c r="B1"><v>{len(line)}</v></c></row><row r="3"><c r="C3" t="b"><v>1</v></c></row>'
    return _zip(**{"xl/workbook.xml": f'<workbook {SHEET}><sheets><sheet name="{escape(title)}" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": _relations(("worksheet", "worksheets/sheet1.xml")), "xl/worksheets/sheet1.xml": f"<worksheet {SHEET}><sheetData>{rows}</sheetData></worksheet>"})


def odt(title: str, line: str) -> bytes:
    t, x = escape(title), escape(line)
    cell = lambda text: f"<table:table-cell><text:p>{text}</text:p></table:table-cell>"
    body = f'<text:h text:outline-level="1">{t}</text:h><text:p>{x}</text:p><table:table><table:table-row>{cell(t)}{cell(x)}</table:table-row></table:table>'
    return _zip(**{"content.xml": f"<office:document-content {TEXT}><office:body><office:text>{body}</office:text></office:body></office:document-content>"})


def pdf(title: str, line: str) -> bytes:
    """Two pages of one line each, in an encoding of ASCII."""
    out, places = io.BytesIO(), []
    pages = [title, line]

    def put(body: str) -> None:
        places.append(out.tell())
        out.write(f"{len(places)} 0 obj\n{body}\nendobj\n".encode("latin-1"))

    out.write(b"%PDF-1.4\n")
    put("<< /Type /Catalog /Pages 2 0 R >>")
    put(f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{4 + 2 * k} 0 R' for k in range(len(pages)))}] >>")
    put("<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
    for k, text in enumerate(pages):
        drawn = f"BT /F1 12 Tf 72 700 Td ({text.replace(chr(92), chr(92) * 2).replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) Tj ET"
        put(f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>")
        put(f"<< /Length {len(drawn)} >>\nstream\n{drawn}\nendstream")
    table = out.tell()
    out.write(f"xref\n0 {len(places) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places))
    out.write(f"trailer << /Size {len(places) + 1} /Root 1 0 R >>\nstartxref\n{table}\n%%EOF".encode())
    return out.getvalue()


#: By extension: a file of title and line. Those of text are given as text.
FORMATS: dict[str, Callable[[str, str], bytes | str]] = {
    ".txt": lambda t, x: f"{t}\r\n\r\n{x}\n",
    ".md": lambda t, x: f"before\n# {t}\n{x}\n\n## Next\n",
    ".csv": lambda t, x: f'"{t}",size\r"{x}, and ""more""",{len(x)}\r,\r',
    ".xml": lambda t, x: f'<?xml version="1.0"?>\n<item name="{t}">{x}</item>',
    ".html": lambda t, x: f"<html><head><title>{t}</title><script>no()</script></head><body><p>{x}<br>next</p><a href='/{t}'>link</a></body></html>",
    ".mht": lambda t, x: f"MIME-Version: 1.0\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<h1>{t}</h1><p>{x}</p>",
    ".rtf": lambda t, x: rf"{{\rtf1\ansi {{\fonttbl{{\f0 Arial;}}}}{t}\par {x}}}",
    ".docx": docx,
    ".pptx": pptx,
    ".xlsx": xlsx,
    ".odt": odt,
    ".pdf": pdf,
}


def files(rows: DataFrame, extension: str, title: Column, line: Column) -> DataFrame:
    """rows with filename and content: a file of the format for each."""
    make = FORMATS[extension]

    @F.pandas_udf("binary")
    def content(titles: pd.Series, lines: pd.Series) -> pd.Series:
        made = [make(t, x) for t, x in zip(titles, lines)]
        return pd.Series([m.encode() if isinstance(m, str) else m for m in made])

    return rows.withColumns({"filename": F.lit(f"sample{extension}"), "content": content(title, line)})
