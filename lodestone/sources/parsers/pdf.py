"""PDF: the text layer, page by page. Pictures of text have none."""

from __future__ import annotations

import re
import zlib

from lodestone.functions.text import SPACES, trim
from lodestone.sources.parsers.base import Block, ParseError

#: Bytes that a file's streams may unpack to, and depth of nested objects.
LARGEST, DEEPEST = 200 * 1024 * 1024, 64

_SPACE = b" \t\r\n\f\x00"
_TOKEN = re.compile(rb"[ \t\r\n\f\x00]*(?:%[^\r\n]*[\r\n \t\f\x00]*)*(<<|>>|\[|\]|\(|<|/[^ \t\r\n\f\x00()<>\[\]{}/%]*|[^ \t\r\n\f\x00()<>\[\]{}/%]+|\{|\}|\)|>)")
_OBJECT = re.compile(rb"(?<!\d)(\d+)[ \t\r\n]+(\d+)[ \t\r\n]+obj\b")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


class Ref(int):
    """A reference to the object of this number."""


class Name(str):
    pass


class Word(str):
    """An operator or keyword."""


class Reader:
    """Tokens of PDF syntax."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self) -> bytes | None:
        found = _TOKEN.match(self.data, self.at)
        if not found:
            return None
        self.at = found.end()
        return found[1]

    def string(self) -> bytes:
        out, depth, data = bytearray(), 1, self.data
        while self.at < len(data):
            c = data[self.at]
            self.at += 1
            if c == 92:
                e = data[self.at] if self.at < len(data) else 0
                self.at += 1
                if 48 <= e <= 55:
                    digits = re.match(rb"[0-7]{1,3}", data[self.at - 1 : self.at + 2])[0]
                    self.at += len(digits) - 1
                    out.append(int(digits, 8) & 255)
                elif e == 13:
                    self.at += data[self.at : self.at + 1] == b"\n"
                elif e != 10:
                    out.append(_ESCAPES.get(e, e))
                continue
            depth += (c == 40) - (c == 41)
            if not depth:
                break
            out.append(c)
        return bytes(out)

    def value(self, depth: int = 0):
        """The next object; None at the end. References are recognised where ``n g R`` follows."""
        if depth > DEEPEST:
            raise ParseError("PDF_PARSE_ERROR", "objects nested too deep")
        token = self.token()
        if token is None:
            return None
        if token == b"<<":
            out: dict = {}
            while True:
                key = self.value(depth + 1)
                if key is None or key == Word(">>"):
                    return out
                value = self.value(depth + 1)
                if isinstance(key, Name):
                    out[str(key)] = value
        if token == b"[":
            items: list = []
            while True:
                item = self.value(depth + 1)
                if item is None or item == Word("]") and isinstance(item, Word):
                    return items
                items.append(item)
        if token == b"(":
            return self.string()
        if token == b"<":
            end = self.data.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at : end])
            self.at = end + 1 if end >= 0 else len(self.data)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if token[:1] == b"/":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), token[1:]).decode("latin-1"))
        if re.fullmatch(rb"[+-]?\d+", token):
            ahead = re.compile(rb"[ \t\r\n\f\x00]+\d+[ \t\r\n\f\x00]+R(?![A-Za-z0-9])").match(self.data, self.at)
            if ahead and token.isdigit():
                self.at = ahead.end()
                return Ref(token)
            return int(token)
        try:
            return float(token)
        except ValueError:
            return Word(token.decode("latin-1"))


class Document:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ParseError("PDF_CORRUPT", "no PDF signature")
        self.data, self.unpacked = data, 0
        self.places = {int(m[1]): m.end() for m in _OBJECT.finditer(data)}  # later ones win, as in updated files
        self.packed: dict[int, object] = {}
        self.known: dict[int, object] = {}
        if re.search(rb"/Encrypt\s+(\d+\s+\d+\s+R|<<)", data):
            raise ParseError("PDF_ENCRYPTED", "the file is encrypted")
        for number in list(self.places):
            head = self.get(Ref(number))
            if isinstance(head, tuple) and head[0].get("Type") == "XRef" and "Encrypt" in head[0]:
                raise ParseError("PDF_ENCRYPTED", "the file is encrypted")
            if isinstance(head, tuple) and head[0].get("Type") == "ObjStm":
                body = self.stream(head)
                reader = Reader(body)
                pairs = [(reader.value(), reader.value()) for _ in range(int(self.get(head[0].get("N", 0)) or 0))]
                for inner, offset in pairs:
                    if isinstance(inner, int) and isinstance(offset, int):
                        self.packed[inner] = Reader(body, int(self.get(head[0].get("First", 0))) + offset).value()

    def get(self, item):
        """The object itself: references are followed; streams are (dictionary, raw bytes)."""
        for _ in range(DEEPEST):
            if not isinstance(item, Ref):
                return item
            number = int(item)
            if number not in self.known:
                self.known[number] = self._load(number)
            item = self.known[number]
        return None

    def _load(self, number: int):
        if number not in self.places:
            return self.packed.get(number)
        reader = Reader(self.data, self.places[number])
        value = reader.value()
        begin = re.compile(rb"[ \t\r\n\f\x00]*stream\r?\n?").match(self.data, reader.at)
        if not isinstance(value, dict) or not begin:
            return value
        length = value.get("Length")
        length = self.get(length) if not isinstance(length, Ref) or int(length) != number else None
        end = begin.end() + length if isinstance(length, int) else -1
        if end < 0 or not re.compile(rb"[ \t\r\n\f\x00]*endstream").match(self.data, end):
            end = self.data.find(b"endstream", begin.end())
        return value, self.data[begin.end() : end if end >= 0 else len(self.data)]

    def stream(self, item) -> bytes:
        found = self.get(item)
        if not isinstance(found, tuple):
            return b""
        head, body = found
        filters = self.get(head.get("Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            name = self.get(name)
            if name in ("FlateDecode", "Fl"):
                body = self._inflate(body)
                body = self._predicted(body, head)
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", body.split(b">")[0])
                body = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                return b""
        return body

    def _inflate(self, body: bytes) -> bytes:
        unpack = zlib.decompressobj()
        try:
            out = unpack.decompress(body, LARGEST - self.unpacked + 1)
        except zlib.error:
            unpack, out = zlib.decompressobj(), b""
            for k in range(0, len(body), 512):  # keeps what can be read of a damaged stream
                try:
                    out += unpack.decompress(body[k : k + 512])
                except zlib.error:
                    break
        self.unpacked += len(out)
        if self.unpacked > LARGEST:
            raise ParseError("PDF_PARSE_ERROR", f"over {LARGEST} bytes unpacked")
        return out

    def _predicted(self, body: bytes, head: dict) -> bytes:
        parms = self.get(head.get("DecodeParms")) or {}
        parms = self.get(parms[0]) if isinstance(parms, list) and parms else parms
        if not isinstance(parms, dict) or (self.get(parms.get("Predictor")) or 1) < 10:
            return body
        width = (int(self.get(parms.get("Colors", 1))) * int(self.get(parms.get("BitsPerComponent", 8))) * int(self.get(parms.get("Columns", 1))) + 7) // 8
        out, above = bytearray(), bytes(width)
        for k in range(0, len(body), width + 1):
            kind, row = body[k], bytearray(body[k + 1 : k + 1 + width])
            if kind == 2:
                row = bytearray((a + b) & 255 for a, b in zip(row, above))
            elif kind == 1:
                for i in range(1, len(row)):
                    row[i] = (row[i] + row[i - 1]) & 255
            out += row
            above = bytes(row)
        return bytes(out)

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with the resources that they inherit."""
        roots = [o for o in map(self.get, map(Ref, sorted({*self.places, *self.packed}))) if isinstance(o, dict) and o.get("Type") == "Catalog"]
        out: list[dict] = []

        def walk(item, inherited, depth: int) -> None:
            node = self.get(item)
            if not isinstance(node, dict) or depth > DEEPEST:
                return
            resources = node.get("Resources", inherited)
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, resources, depth + 1)
            else:
                out.append(node | {"Resources": resources})

        for root in roots[-1:]:
            walk(root.get("Pages"), None, 0)
        return out


_HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")


def _unicode(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace") if len(raw) > 1 else raw.decode("latin-1")


class Font:
    """Codes to text: by the font's own map if it has one, else as Windows Latin."""

    def __init__(self, document: Document, item):
        head = document.get(item)
        head = head if isinstance(head, dict) else {}
        self.map: dict[bytes, str] = {}
        self.wide = head.get("Subtype") == "Type0"
        body = document.stream(head.get("ToUnicode"))
        bytes_of = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode())
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
            codes = [bytes_of(h) for h in _HEX.findall(part)]
            self.map.update({a: _unicode(b) for a, b in zip(codes[::2], codes[1::2])})
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
            reader = Reader(part)
            while (low := reader.value()) is not None:
                high, to = reader.value(), reader.value()
                if not isinstance(low, bytes) or not isinstance(high, bytes):
                    break
                first, n = int.from_bytes(low, "big"), min(int.from_bytes(high, "big") - int.from_bytes(low, "big") + 1, 65536)
                for k in range(n):
                    code = (first + k).to_bytes(len(low), "big")
                    if isinstance(to, list):
                        self.map[code] = _unicode(to[k]) if k < len(to) and isinstance(to[k], bytes) else ""
                    elif isinstance(to, bytes):
                        self.map[code] = _unicode((int.from_bytes(to, "big") + k).to_bytes(len(to), "big"))
        if self.map:
            self.wide = max(map(len, self.map)) > 1

    def text(self, raw: bytes) -> str:
        if self.wide:
            return "".join(self.map.get(raw[k : k + 2], "") for k in range(0, len(raw), 2))
        return "".join(self.map.get(raw[k : k + 1]) or raw[k : k + 1].decode("cp1252", "replace") for k in range(len(raw)))


def page_text(document: Document, page: dict) -> str:
    """Text in the order in which it is drawn; moves to another line are line ends, wide gaps are spaces."""
    resources = document.get(page.get("Resources")) or {}
    fonts = document.get(resources.get("Font")) or {}
    contents = document.get(page.get("Contents"))
    body = b"\n".join(document.stream(c) for c in contents) if isinstance(contents, list) else document.stream(page.get("Contents"))
    known: dict[str, Font] = {}
    font = Font(document, None)
    out: list[str] = []
    operands: list = []
    line = None
    reader = Reader(body)
    while (value := reader.value()) is not None:
        if not isinstance(value, Word):
            operands.append(value)
            continue
        if value == "Tf" and len(operands) >= 2:
            name = str(operands[-2])
            if name not in known:
                known[name] = Font(document, fonts.get(name))
            font = known[name]
        elif value in ("Td", "TD") and len(operands) >= 2:
            out.append("\n" if isinstance(operands[-1], (int, float)) and abs(operands[-1]) > 0.5 else " ")
        elif value == "Tm" and len(operands) >= 6:
            if line is not None and operands[-1] != line:
                out.append("\n")
            line = operands[-1]
        elif value in ("T*", "ET"):
            out.append("\n" if value == "T*" else " ")
        elif value in ("Tj", "'", '"') and operands and isinstance(operands[-1], bytes):
            out += ["\n" if value != "Tj" else "", font.text(operands[-1])]
        elif value == "TJ" and operands and isinstance(operands[-1], list):
            for item in operands[-1]:
                if isinstance(item, bytes):
                    out.append(font.text(item))
                elif isinstance(item, (int, float)) and item < -200:
                    out.append(" ")
        elif value == "BI":  # the bytes of a picture inside the page
            end = re.compile(rb"\sEI\b").search(body, reader.at)
            reader.at = end.end() if end else len(body)
        operands = []
    rows = [trim(SPACES.sub(" ", row)) for row in "".join(out).split("\n")]
    return "\n".join(r for r in rows if r)


def parse_pdf(data: bytes) -> list[Block]:
    """A block for each page with text."""
    document = Document(data)
    pages = document.pages()
    if not pages:
        raise ParseError("PDF_CORRUPT", "no pages")
    texts = [page_text(document, p) for p in pages]
    return [Block(n, None, text, "page", f"第 {k} 頁") for n, (k, text) in enumerate((k, t) for k, t in enumerate(texts, 1) if t)]
