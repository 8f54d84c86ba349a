"""Word, PowerPoint, Excel and OpenDocument text packages."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from lodestone.functions.text import SPACES, trim
from lodestone.sources.parsers.base import Block, ParseError

#: The unpacked size that a package may have, and the number formats that are dates without saying so.
LARGEST_PACKAGE = 200 * 1024 * 1024
DATE_FORMATS = frozenset((14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47))
_OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"

Node = ElementTree.Element


def name(node: Node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def attr(node: Node, wanted: str) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == wanted), None)


def below(node: Node, wanted: str) -> Iterator[Node]:
    return (n for n in node.iter() if name(n) == wanted)


def joined(node: Node, wanted: str = "t") -> str:
    return "".join(n.text or "" for n in below(node, wanted))


class Package:
    """A zip of XML parts; refuses encrypted files, bombs and part names that leave the package."""

    def __init__(self, data: bytes):
        if data.startswith(_OLE):
            raise ParseError("OFFICE_ENCRYPTED_OR_LEGACY", "an OLE file: encrypted, or of an older format")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            raise ParseError("OFFICE_CORRUPT", "not a package") from None
        if sum(i.file_size for i in self.zip.infolist()) > LARGEST_PACKAGE:
            raise ParseError("OFFICE_TOO_LARGE", f"over {LARGEST_PACKAGE} bytes unpacked")
        self.names = self.zip.namelist()

    def xml(self, part: str, needed: bool = True) -> Node | None:
        if part not in self.names:
            if needed:
                raise ParseError("OFFICE_MISSING_PART", part)
            return None
        with self.zip.open(part) as file:
            raw = file.read(LARGEST_PACKAGE + 1)
        if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw[:4096]:
            raise ParseError("OFFICE_CORRUPT_XML", "document types aren't allowed")
        try:
            return ElementTree.fromstring(raw)
        except ElementTree.ParseError as error:
            raise ParseError("OFFICE_CORRUPT_XML", str(error)) from None

    def relations(self, part: str, links_only: bool = False) -> dict[str, str]:
        """Targets by id of a part's relationships."""
        folder, file = posixpath.split(part)
        return self.relations_in(f"{folder}/_rels/{file}.rels" if folder else f"_rels/{file}.rels", links_only)

    def relations_in(self, rels: str, links_only: bool = False) -> dict[str, str]:
        root = self.xml(rels, False)
        if root is None:
            return {}
        found = {}
        for r in below(root, "Relationship"):
            link = (attr(r, "Type") or "").endswith("/hyperlink")
            if attr(r, "Id") and attr(r, "Target") and (link or not links_only):
                found[attr(r, "Id")] = attr(r, "Target")
        return found

    @staticmethod
    def resolve(part: str, target: str) -> str:
        path = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(part), target))
        if path.startswith(".."):
            raise ParseError("OFFICE_CORRUPT", f"{target!r} leaves the package")
        return path


#: Characters whose escapes stay when a link is decoded, as they would change what it means.
RESERVED = ";/?:@&=+$,#"
_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


def decode_link(target: str) -> str | None:
    """The link with its escapes decoded but for those of reserved characters; None if an escape is broken or isn't UTF-8."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", target):
        return None

    def plain(run: re.Match) -> str:
        text = bytes.fromhex(run[0].replace("%", "")).decode("utf-8")
        written = iter(run[0][k : k + 3] for k in range(0, len(run[0]), 3))
        out = []
        for c in text:
            escapes = [next(written) for _ in c.encode()]
            out.append(escapes[0] if c in RESERVED else c)
        return "".join(out)

    try:
        return _ESCAPES.sub(plain, target)
    except UnicodeDecodeError:
        return None


def link_texts(targets: list[str]) -> list[str]:
    """Targets worth finding, each once, as written and decoded."""
    out: list[str] = []
    for t in filter(None, map(trim, targets)):
        out += [t, decode_link(t) or t]
    return list(dict.fromkeys(out))


_FIELD = re.compile(r"""\bHYPERLINK\s+(?:"([^"]+)"|'([^']+)'|(\S+))""", re.I)
_TITLE_STYLE = re.compile(r"Heading[1-6]|Title|Subtitle", re.I)


def _paragraph(node: Node, links: dict[str, str]) -> str:
    visible = trim(joined(node))
    targets = []
    for h in below(node, "hyperlink"):
        targets += [links.get(attr(h, "id") or "", ""), f"#{attr(h, 'anchor')}" if attr(h, "anchor") else ""]
    codes = [attr(f, "instr") or "" for f in below(node, "fldSimple")] + [joined(node, "instrText")]
    targets += [next(filter(None, m.groups())) for m in map(_FIELD.search, codes) if m]
    return "\n".join(filter(None, [visible, *(t for t in link_texts(targets) if t not in visible)]))


def parse_docx(data: bytes) -> list[Block]:
    package = Package(data)
    main = "word/document.xml"
    body = next(below(package.xml(main), "body"), None)
    if body is None:
        return []
    links = package.relations(main, True)
    blocks: list[Block] = []
    heading, paragraphs, tables = None, 0, 0

    def add(content: str, under: str | None, place: str) -> None:
        if content:
            blocks.append(Block(len(blocks), under, content, "section", place))

    for item in body:
        if name(item) == "p":
            paragraphs += 1
            content = _paragraph(item, links)
            style = next(below(item, "pStyle"), None)
            if content and style is not None and _TITLE_STYLE.fullmatch(attr(style, "val") or ""):
                heading = content
            add(content, heading, f"第 {paragraphs} 段")
        elif name(item) == "tbl":
            tables += 1
            for r, row in enumerate(below(item, "tr"), 1):
                for c, cell in enumerate(below(row, "tc"), 1):
                    add("\n".join(filter(None, (_paragraph(p, links) for p in below(cell, "p")))), heading, f"表格 {tables}，第 {r} 列第 {c} 欄")
    known = {line for b in blocks for line in b.content.split("\n")}
    for rels in (n for n in package.names if n.startswith("word/") and n.endswith(".rels")):
        for target in package.relations_in(rels, True).values():
            fresh = [t for t in link_texts([target]) if t not in known]
            known.update(fresh)
            add("\n".join(fresh), None, f"超連結目標（{rels.replace('/_rels/', '/').removesuffix('.rels')}）")
    return blocks


def _paragraph_texts(node: Node) -> list[str]:
    return [t for t in (trim(joined(p)) for p in below(node, "p")) if t]


def _placeholder(shape: Node) -> str | None:
    found = next(below(shape, "ph"), None)
    return None if found is None else attr(found, "type") or ""


def parse_pptx(data: bytes) -> list[Block]:
    """Slides in the order of the presentation, and their notes."""
    package = Package(data)
    main = "ppt/presentation.xml"
    targets = package.relations(main)
    blocks: list[Block] = []
    for number, slide in enumerate(below(package.xml(main), "sldId"), 1):
        ident = next((v for k, v in slide.attrib.items() if k.endswith("}id")), None)
        if ident not in targets:
            raise ParseError("OFFICE_MISSING_PART", "a slide without its part")
        part = package.resolve(main, targets[ident])
        page = package.xml(part)
        titles = [t for s in below(page, "sp") if _placeholder(s) in ("title", "ctrTitle") for t in _paragraph_texts(s)[:1]]
        if texts := _paragraph_texts(page):
            blocks.append(Block(len(blocks), titles[0] if titles else None, "\n".join(texts), "slide", f"投影片 {number}"))
        for target in [t for t in package.relations(part).values() if "notesSlide" in t][:1]:
            notes = package.xml(package.resolve(part, target))
            texts = [t for s in below(notes, "sp") if _placeholder(s) == "body" for t in _paragraph_texts(s)]
            if texts:
                blocks.append(Block(len(blocks), None, "\n".join(texts), "slide", f"投影片 {number}（講者備註）"))
    return blocks


def _grouped(value: float, decimals: int) -> str:
    return f"{value:,.{decimals}f}"


def format_number(raw: str, code: str | None, from_1904: bool = False) -> str:
    """A cell's number as its format shows it: dates in ISO form, percentages, fixed decimals and thousands; others as stored."""
    if code is None:
        return raw
    try:
        value = float(raw)
    except ValueError:
        return raw
    plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
    if re.search("[ymdhHsS]", plain):
        try:
            moment = (datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)) + timedelta(milliseconds=round(value * 86_400_000))
        except OverflowError:
            return raw
        return moment.strftime("%Y-%m-%d %H:%M:%S" if re.search("[hHsS]", plain) else "%Y-%m-%d")
    section = plain.split(";")[0]
    places = re.match("0*", section.partition(".")[2])[0]
    if "%" in plain:
        return f"{value * 100:.{plain.partition('.')[2].count('0')}f}%"
    if places:
        return _grouped(value, len(places)) if "," in plain else f"{value:.{len(places)}f}"
    return _grouped(value, 0) if re.match(r"[-+]?#,##0", section) else raw


def _formats(package: Package) -> list[str | None]:
    """Format codes by cell style."""
    styles = package.xml("xl/styles.xml", False)
    if styles is None:
        return []
    own = {attr(n, "numFmtId"): attr(n, "formatCode") for n in below(styles, "numFmt")}
    cells = next(below(styles, "cellXfs"), None)
    idents = [attr(x, "numFmtId") for x in below(cells, "xf")] if cells is not None else []
    return [own.get(i) or ("yyyy-mm-dd" if i and i.isdigit() and int(i) in DATE_FORMATS else None) for i in idents]


def parse_xlsx(data: bytes) -> list[Block]:
    """A block for each cell with text or a link, under its sheet's name."""
    package = Package(data)
    main = "xl/workbook.xml"
    book = package.xml(main)
    targets = package.relations(main)
    strings = package.xml("xl/sharedStrings.xml", False)
    shared = [joined(s) for s in below(strings, "si")] if strings is not None else []
    formats = _formats(package)
    properties = next(below(book, "workbookPr"), None)
    from_1904 = properties is not None and attr(properties, "date1904") in ("1", "true")

    def text_of(cell: Node) -> str:
        kind = attr(cell, "t")
        if kind == "inlineStr":
            return "".join(joined(i) for i in below(cell, "is"))
        raw = joined(cell, "v")
        if kind == "s":
            return shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
        if kind == "b":
            return ("TRUE" if raw == "1" else "FALSE") if raw else ""
        style = attr(cell, "s") or "0"
        known = style.isdigit() and int(style) < len(formats)
        return raw if kind in ("str", "e") or not raw else format_number(raw, formats[int(style)] if known else None, from_1904)

    cells: list[tuple[str, str, list[str]]] = []  # sheet, address, lines
    for sheet in below(book, "sheet"):
        title = attr(sheet, "name") or "未命名工作表"
        ident = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
        if ident not in targets:
            raise ParseError("OFFICE_MISSING_PART", f"the sheet {title!r} without its part")
        part = package.resolve(main, targets[ident])
        page = package.xml(part)
        at: dict[str, list[str]] = {}
        for cell in below(page, "c"):
            address, text = attr(cell, "r"), text_of(cell)
            if address and trim(text):
                at[address] = [text]
                cells.append((title, address, at[address]))
        links = package.relations(part, True)
        for h in below(page, "hyperlink"):
            more = link_texts([links.get(attr(h, "id") or "", ""), f"#{attr(h, 'location')}" if attr(h, "location") else "", attr(h, "display") or "", attr(h, "tooltip") or ""])
            address = attr(h, "ref")
            if not address or not more:
                continue
            if address not in at:
                at[address] = []
                cells.append((title, address, at[address]))
            have = "\n".join(at[address]).split("\n")
            at[address] += [m for m in more if m not in have]
    return [Block(n, title, "\n".join(lines), "sheet_cell", f"工作表「{title}」!{address}") for n, (title, address, lines) in enumerate(cells)]


def _odf_text(node: Node) -> str:
    """Text with OpenDocument's own spaces and breaks, then its link targets."""

    def walk(n: Node) -> Iterator[str]:
        if name(n) in ("s", "tab", "line-break"):
            yield " "
        yield n.text or ""
        for child in n:
            yield from walk(child)
            yield child.tail or ""

    text = trim(SPACES.sub(" ", "".join(walk(node))))
    return "\n".join(dict.fromkeys(filter(None, [text, *link_texts([attr(a, "href") or "" for a in below(node, "a")])])))


def parse_odt(data: bytes) -> list[Block]:
    package = Package(data)
    manifest = package.xml("META-INF/manifest.xml", False)
    if manifest is not None and next(below(manifest, "encryption-data"), None) is not None:
        raise ParseError("ODT_ENCRYPTED", "the content is encrypted")
    blocks: list[Block] = []
    heading: str | None = None

    def add(content: str, kind: str) -> None:
        if trim(content):
            blocks.append(Block(len(blocks), heading, content, "section", f"{kind} {len(blocks) + 1}"))

    stack = [package.xml("content.xml")]
    while stack:
        node = stack.pop()
        kind = name(node)
        if kind == "h":
            if text := _odf_text(node):
                heading = text.split("\n")[0]
                add(text, "標題")
        elif kind == "p":
            add(_odf_text(node), "段落")
        elif kind == "table-row":
            values = [_odf_text(c) for c in node if name(c) in ("table-cell", "covered-table-cell")]
            if any(map(trim, values)):
                add(" | ".join(values), "表格列")
        elif kind not in ("table-cell", "covered-table-cell"):
            stack += reversed(list(node))
    return blocks
