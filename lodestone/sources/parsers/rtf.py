"""Rich Text Format: the visible text, with link targets, line by line. A file that wraps HTML gives the text of that HTML."""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass, replace

from lodestone.functions.text import trim
from lodestone.sources.parsers.base import Block, ParseError
from lodestone.sources.parsers.markup import html_blocks

#: Limits, groups whose content isn't text, and words that stand for characters.
LARGEST, DEEPEST = 20 * 1024 * 1024, 512
SKIPPED = frozenset("fonttbl colortbl stylesheet info pict object objdata header headerl headerr footer footerl footerr footnote themedata datastore listtable listoverridetable rsidtbl generator xmlnstbl filetbl revtbl latentstyles".split())
CHARACTERS = {"par": "\n", "line": "\n", "row": "\n", "page": "\n", "sect": "\n", "cell": " | ", "tab": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "emspace": " ", "enspace": " ", "~": " ", "_": "‑", "-": ""}
#: Code pages of the character sets that fonts name, and those that Python knows by another name than their number.
CHARSETS = {0: 1252, 77: 10000, 128: 932, 129: 949, 130: 1361, 134: 936, 136: 950, 161: 1253, 162: 1254, 163: 1258, 177: 1255, 178: 1256, 186: 1257, 204: 1251, 222: 874, 238: 1250}
PAGES = {10000: "mac_roman", 54936: "gb18030", 65001: "utf-8"}
_HTML = re.compile(rb"\\fromhtml1?(?![0-9a-zA-Z])")
_TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")
_LINK = re.compile(r'HYPERLINK\s+(?:\\l\s+)?"([^"]+)"')


def _page(number: int) -> str | None:
    name = PAGES.get(number, f"cp{number}")
    try:
        return codecs.lookup(name).name
    except LookupError:
        return None


@dataclass(frozen=True)
class _Group:
    """What holds inside a group until it ends."""

    skip: bool = False  # no text
    field: bool = False  # a field's instruction
    fonts: bool = False  # the table of fonts
    rtf_only: bool = False  # stands for HTML that is there too
    stand_ins: int = 1  # characters after a Unicode one that stand for it
    page: str | None = None  # the font's code page


def rtf_text(data: bytes) -> str:
    """The text; of a file that wraps HTML, its source."""
    if len(data) > LARGEST:
        raise ParseError("RTF_LIMIT", f"over {LARGEST} bytes")
    if not data.lstrip().startswith(b"{\\rtf"):
        raise ParseError("RTF_INVALID", "no RTF signature")
    html = _HTML.search(data) is not None
    out: list[str] = []
    page = "cp1252"
    font, first_font, pages = 0, None, {}
    stack: list[_Group] = []
    now = _Group()
    pending = 0
    instruction: list[str] = []
    held = bytearray()
    at = 0

    def emit(text: str) -> None:
        if now.field:
            instruction.append(text)
        elif not now.skip and not (html and now.rtf_only):
            out.append(text)

    def flush() -> None:
        if held:
            emit(bytes(held).decode(now.page or page, "replace"))
            held.clear()

    while at < len(data):
        found = _TOKEN.match(data, at)
        if not found:
            at += 1
            continue
        at = found.end()
        word, number, code, symbol, brace, plain = found.groups()
        if code is not None:
            if pending:
                pending -= 1
            else:
                held.append(int(code, 16))
            continue
        if plain is not None:
            text = plain[pending:]
            pending = max(0, pending - len(plain))
            held.extend(text)
            continue
        flush()
        if brace == b"{":
            stack.append(now)
            if len(stack) > DEEPEST:
                raise ParseError("RTF_LIMIT", f"over {DEEPEST} groups deep")
        elif brace == b"}":
            if not stack:
                raise ParseError("RTF_INVALID", "a group ends that didn't begin")
            ended, now = now, stack.pop()
            if ended.field and not now.field:
                link = _LINK.search("".join(instruction))
                instruction = []
                if link and not now.skip and not html:
                    out.append(f" {link[1]} ")
        elif symbol is not None:
            text = symbol.decode("latin-1")
            if text == "*":
                following = _TOKEN.match(data, at)
                name = following[1] if following else None
                if following and name != b"fldinst" and not (html and name == b"htmltag"):
                    now = replace(now, skip=True)
            elif text in "\\{}":
                emit(text)
            else:
                emit(CHARACTERS.get(text, "\n" if text in "\r\n" else ""))
        elif word is not None:
            name, value = word.decode("ascii"), int(number) if number else None
            if name == "bin" and value is not None:
                if value < 0 or at + value > len(data):
                    raise ParseError("RTF_INVALID", "binary data of no possible length")
                at += value
            elif name == "ansicpg" and value:
                page = _page(value)
                if page is None:
                    raise ParseError("RTF_ENCODING_UNSUPPORTED", f"code page {value}")
            elif name == "uc" and value is not None:
                now = replace(now, stand_ins=max(0, value))
            elif name == "u" and value is not None:
                emit(chr(value % 65536))
                pending = now.stand_ins
            elif name == "fonttbl":
                now = replace(now, skip=True, fonts=True)
            elif name == "deff":
                first_font = value
            elif name == "f" and value is not None:
                if now.fonts:
                    font = value
                else:
                    now = replace(now, page=pages.get(value))
            elif name == "plain":
                now = replace(now, page=pages.get(first_font))
            elif name in ("fcharset", "cpg") and now.fonts and value is not None:
                pages[font] = _page(CHARSETS.get(value, 0) if name == "fcharset" else value)
            elif name == "htmlrtf":
                now = replace(now, rtf_only=value != 0)
            elif name in SKIPPED:
                now = replace(now, skip=True)
            elif name == "fldinst":
                now = replace(now, field=True)
            elif name in CHARACTERS and not (html and name in ("cell", "row")):
                emit(CHARACTERS[name])
    flush()
    if stack:
        raise ParseError("RTF_INVALID", "a group doesn't end")
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def parse_rtf(data: bytes) -> list[Block]:
    text = rtf_text(data)
    if _HTML.search(data):
        kept = [b.content for b in html_blocks(text)]
    else:
        rows = [trim(re.sub(r"[ \t]+", " ", line).removesuffix(" | ")) for line in text.split("\n")]
        kept = [r for r in rows if r.strip("| ")]
    return [Block(n, None, row, "section", f"段落 {n + 1}") for n, row in enumerate(kept)]
