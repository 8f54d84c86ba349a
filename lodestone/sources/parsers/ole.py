"""OLE compound files, and what three formats keep in them: Outlook messages, Word 97 documents, Excel 97 workbooks."""

from __future__ import annotations

import re
import struct

from lodestone.functions.text import trim
from lodestone.sources.parsers.base import Block, ParseError
from lodestone.sources.parsers.markup import html_blocks
from lodestone.sources.parsers.plain import column_name

#: Fixed values of the formats: signature, end and free marks, streams under this size lie in the small sectors.
SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END, _FREE, _SMALL = 0xFFFFFFFE, 0xFFFFFFFF, 4096


class Compound:
    """Streams by path ("folder/name") of a compound file."""

    def __init__(self, data: bytes, code: str):
        self.code = code
        if not data.startswith(SIGNATURE) or len(data) < 512:
            raise ParseError(code, "not a compound file")
        self.data = data
        self.size, self.small_size = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        if self.size not in (512, 4096):
            raise ParseError(code, "an odd sector size")
        first_dir, first_small, first_more = (struct.unpack_from("<I", data, k)[0] for k in (48, 60, 68))
        tables = list(struct.unpack_from("<109I", data, 76))
        while first_more not in (_END, _FREE) and len(tables) < 1 << 20:
            sector = self.sector(first_more)
            tables += struct.unpack(f"<{self.size // 4 - 1}I", sector[:-4])
            first_more = struct.unpack("<I", sector[-4:])[0]
        self.next = [n for t in tables if t not in (_END, _FREE) for n in struct.unpack(f"<{self.size // 4}I", self.sector(t))]
        small = self.chain(first_small)
        self.small_next = struct.unpack(f"<{len(small) // 4}I", small)
        self.entries = self._directory(self.chain(first_dir))
        self.small = self.chain(self.entries[0][2]) if self.entries else b""
        self.streams: dict[str, tuple[int, int]] = {}
        if self.entries:
            self._walk(self.entries[0][5], "", set())

    def sector(self, number: int) -> bytes:
        at = (number + 1) * self.size
        found = self.data[at : at + self.size]
        return found + bytes(self.size - len(found))

    def chain(self, first: int) -> bytes:
        out, seen = [], set()
        while first not in (_END, _FREE):
            if first in seen or first >= len(self.next):
                raise ParseError(self.code, "a broken chain of sectors")
            seen.add(first)
            out.append(self.sector(first))
            first = self.next[first]
        return b"".join(out)

    @staticmethod
    def _directory(raw: bytes) -> list[tuple]:
        """(name, kind, first sector, left, right, child, size) of each entry."""
        out = []
        for at in range(0, len(raw) - 127, 128):
            e = raw[at : at + 128]
            n = struct.unpack_from("<H", e, 64)[0]
            left, right, child = struct.unpack_from("<3I", e, 68)
            first, size = struct.unpack_from("<IQ", e, 116)
            out.append((e[: max(0, n - 2)].decode("utf-16-le", "replace"), e[66], first, left, right, child, size & 0xFFFFFFFF))
        return out

    def _walk(self, root: int, folder: str, seen: set[int]) -> None:
        todo = [root]
        while todo:
            k = todo.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            name, kind, first, left, right, child, size = self.entries[k]
            todo += [left, right]
            if kind == 2:
                self.streams[folder + name] = (first, size)
            elif kind == 1:
                self._walk(child, f"{folder}{name}/", seen)

    def read(self, path: str) -> bytes | None:
        if path not in self.streams:
            return None
        first, size = self.streams[path]
        if size >= _SMALL:
            return self.chain(first)[:size]
        out = []
        while first not in (_END, _FREE) and len(out) * self.small_size < size:
            if first >= len(self.small_next):
                raise ParseError(self.code, "a broken chain of small sectors")
            out.append(self.small[first * self.small_size : (first + 1) * self.small_size])
            first = self.small_next[first]
        return b"".join(out)[:size]


# Outlook --------------------------------------------------------------------------------------------------------------


#: Where the parts of a message are said to be, and kinds of recipients.
_MAIL, _MAIL_SUBJECT, _MAIL_SENDER, _MAIL_BODY = "郵件", "郵件主旨", "郵件寄件者", "郵件正文（{form}）／段落 {n}"
_MAIL_RECIPIENT, _MAIL_UNKNOWN = {1: "收件者", 2: "副本", 3: "密件副本"}, "收件者（類別未知）"


def _recipient_kind(properties: bytes) -> int | None:
    """The type in a recipient's properties: entries of 16 bytes after a header of 8."""
    for at in range(8, len(properties) - 15, 16):
        if int.from_bytes(properties[at : at + 4], "little") == 0x0C150003:
            return int.from_bytes(properties[at + 8 : at + 12], "little")
    return None


def parse_msg(data: bytes) -> list[Block]:
    """Subject, sender and recipients, then the body: HTML if there is any, else the lines of its text."""
    file = Compound(data, "MSG_FORMAT_ERROR")

    def text(tag: str, folder: str = "") -> str:
        wide = file.read(f"{folder}__substg1.0_{tag}001F")
        if wide is not None:
            return wide.decode("utf-16-le", "replace").rstrip("\0")
        return (file.read(f"{folder}__substg1.0_{tag}001E") or b"").decode("cp1252", "replace").rstrip("\0")

    kind = text("001A").lower()
    if not any(p.startswith(("__substg1.0_", "__properties")) for p in file.streams):
        raise ParseError("MSG_FORMAT_ERROR", "not a message")
    if re.search(r"\.smime(?:\.|$)", kind):
        raise ParseError("MSG_SMIME_UNSUPPORTED", "a signed or encrypted message")
    if kind and not re.match(r"ipm\.note(?:\.|$)", kind):
        raise ParseError("MSG_ITEM_UNSUPPORTED", f"a message of class {kind}")
    people = sorted({p.partition("/")[0] for p in file.streams if p.startswith("__recip_version1.0_")})
    lines = lambda *parts: "\n".join(dict.fromkeys(filter(None, map(trim, parts))))
    subject = trim(text("0037"))
    head = [(_MAIL_SUBJECT, subject, subject or None), (_MAIL_SENDER, lines(text("0C1A"), text("0C1F"), text("5D01")), None)]
    for k, p in enumerate(people, 1):
        label = _MAIL_RECIPIENT.get(_recipient_kind(file.read(f"{p}/__properties_version1.0") or b""), _MAIL_UNKNOWN)
        head.append((f"{_MAIL}{label} {k}", lines(text("3001", f"{p}/"), text("3003", f"{p}/"), text("39FE", f"{p}/")), None))
    if not people:  # some have their recipients' names only
        head += [(_MAIL + _MAIL_RECIPIENT[k], trim(text(tag)), None) for k, tag in ((1, "0E04"), (2, "0E03"), (3, "0E02"))]
    page = file.read("__substg1.0_10130102")
    page_text = page.decode("utf-8", "replace") if page is not None else text("1013")
    body, form = [block.content for block in html_blocks(page_text)] if page_text else [], "HTML"
    if not body:
        body, form = re.split(r"\r\n|\n|\r", text("1000")), "純文字"
    rows = head + [(_MAIL_BODY.format(form=form, n=n), trim(row), None) for n, row in enumerate(filter(trim, body), 1)]
    blocks = [Block(n, heading, value, "section", place) for n, (place, value, heading) in enumerate(r for r in rows if r[1])]
    return blocks


# Word 97 --------------------------------------------------------------------------------------------------------------


def parse_doc(data: bytes) -> list[Block]:
    """The text of body, notes, headers, annotations and text boxes by the piece table; fields show their result and their link."""
    file = Compound(data, "DOC_FORMAT_ERROR")
    main = file.read("WordDocument")
    if main is None or len(main) < 0x1AA or struct.unpack_from("<H", main)[0] not in (0xA5EC, 0xA5DC):
        raise ParseError("DOC_FORMAT_ERROR", "no Word document")
    flags = struct.unpack_from("<H", main, 10)[0]
    if flags & 0x0100:
        raise ParseError("DOC_ENCRYPTED", "the document is encrypted")
    table = file.read("1Table" if flags & 0x0200 else "0Table") or b""
    at, size = struct.unpack_from("<II", main, 0x1A2)
    clx, pieces = table[at : at + size], b""
    k = 0
    while k < len(clx):
        if clx[k] == 1:
            k += 3 + struct.unpack_from("<H", clx, k + 1)[0]
        elif clx[k] == 2:
            pieces = clx[k + 5 : k + 5 + struct.unpack_from("<I", clx, k + 1)[0]]
            break
        else:
            raise ParseError("DOC_PARSE_ERROR", "a broken piece table")
    n = (len(pieces) - 4) // 12
    if n < 1:
        raise ParseError("DOC_PARSE_ERROR", "no piece table")
    ends = struct.unpack_from(f"<{n + 1}I", pieces)
    out = []
    for i in range(n):
        place = struct.unpack_from("<I", pieces, 4 * (n + 1) + 8 * i + 2)[0]
        count = ends[i + 1] - ends[i]
        if place & 0x40000000:
            begin = (place & 0x3FFFFFFF) // 2
            out.append(main[begin : begin + count].decode("cp1252", "replace"))
        else:
            out.append(main[place : place + 2 * count].decode("utf-16-le", "replace"))
    text = "".join(out)
    # a field is 13 instruction 14 result 15
    links = lambda m: " ".join(filter(None, [m[2] or "", *re.findall(r'HYPERLINK\s+(?:\\l\s+)?"([^"]+)"', m[1])]))
    for _ in range(8):
        changed = re.sub("\x13([^\x13\x14\x15]*)(?:\x14([^\x13\x15]*))?\x15", links, text)
        if changed == text:
            break
        text = changed
    rows = re.split("[\r\n\x07\x0b\x0c]", re.sub("[\x00-\x06\x08\x0e-\x1f]", "", text))
    kept = [trim(r) for r in rows if trim(r)]
    return [Block(k, None, row, "section", f"段落 {k + 1}") for k, row in enumerate(kept)]


# Excel 97 -------------------------------------------------------------------------------------------------------------


def _records(book: bytes):
    at = 0
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, at)
        yield kind, book[at + 4 : at + 4 + size], at
        at += 4 + size


class _Strings:
    """The table of shared strings, which goes on over records; a string that does so begins again with its flags."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 8

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.part < len(self.parts):
            piece = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + piece, n - len(piece), self.at + len(piece)
            if n:
                self.part, self.at = self.part + 1, 0
        return out

    def characters(self, n: int, wide: bool) -> str:
        out = []
        while n and self.part < len(self.parts):
            left = len(self.parts[self.part]) - self.at
            if left <= 0:
                self.part, self.at = self.part + 1, 0
                if self.part < len(self.parts):
                    wide, self.at = bool(self.parts[self.part][0] & 1), 1
                continue
            count = min(n, left // 2 if wide else left)
            out.append(self.take(count * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= count
            if wide and not count:
                break
        return "".join(out)

    def next(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        text = self.characters(count, bool(flags & 1))
        self.take(4 * runs + extra)
        return text


def _number(raw: float) -> str:
    return str(int(raw)) if raw == int(raw) and abs(raw) < 1e15 else repr(raw)


def _packed(value: int) -> float:
    number = float(struct.unpack("<i", struct.pack("<I", value))[0] >> 2) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def parse_xls(data: bytes) -> list[Block]:
    """A block for each cell with a value, row by row, under its sheet's name. Numbers are shown as stored."""
    file = Compound(data, "XLS_FORMAT_ERROR")
    book = file.read("Workbook") or file.read("Book")
    if not book:
        raise ParseError("XLS_FORMAT_ERROR", "no workbook")
    sheets: dict[int, str] = {}
    strings: list[str] = []
    parts: list[bytes] = []
    in_table = False
    cells: list[tuple[int, int, int, str]] = []
    order: list[int] = []
    current = -1
    for kind, body, at in _records(book):
        if in_table and kind == 0x3C:
            parts.append(body)
            continue
        if in_table:
            in_table, reader = False, _Strings(parts)
            strings = [reader.next() for _ in range(struct.unpack_from("<I", parts[0], 4)[0])]
        if kind == 0x2F:
            raise ParseError("XLS_ENCRYPTED", "the workbook is encrypted")
        if kind == 0x85:
            size, wide = body[6], body[7] & 1
            sheets[struct.unpack_from("<I", body)[0]] = body[8 : 8 + size * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace")
        elif kind == 0xFC:
            parts, in_table = [body], True
        elif kind == 0x809:
            if at in sheets:
                order.append(at)
                current = len(order) - 1
        elif current >= 0 and len(body) >= 6:
            row, column = struct.unpack_from("<HH", body)
            if kind == 0xFD and len(body) >= 10:
                number = struct.unpack_from("<I", body, 6)[0]
                cells.append((current, row, column, strings[number] if number < len(strings) else ""))
            elif kind == 0x203 and len(body) >= 14:
                cells.append((current, row, column, _number(struct.unpack_from("<d", body, 6)[0])))
            elif kind == 0x27E and len(body) >= 10:
                cells.append((current, row, column, _number(_packed(struct.unpack_from("<I", body, 6)[0]))))
            elif kind == 0xBD:
                for k in range((len(body) - 6) // 6):
                    cells.append((current, row, column + k, _number(_packed(struct.unpack_from("<I", body, 4 + 6 * k + 2)[0]))))
            elif kind == 0x204 and len(body) >= 9:
                count, wide = struct.unpack_from("<H", body, 6)[0], body[8] & 1
                cells.append((current, row, column, body[9 : 9 + count * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace")))
            elif kind == 0x205 and len(body) >= 8 and not body[7]:
                cells.append((current, row, column, "TRUE" if body[6] else "FALSE"))
            elif kind == 0x06 and len(body) >= 14 and body[12:14] != b"\xff\xff":
                cells.append((current, row, column, _number(struct.unpack_from("<d", body, 6)[0])))
            elif kind == 0x06 and len(body) >= 9 and body[6] == 1:
                cells.append((current, row, column, "TRUE" if body[8] else "FALSE"))
    found = sorted((c for c in cells if trim(c[3])), key=lambda c: c[:3])
    return [Block(n, sheets[order[s]], text, "sheet_cell", f"工作表「{sheets[order[s]]}」!{column_name(column)}{row + 1}") for n, (s, row, column, text) in enumerate(found)]
