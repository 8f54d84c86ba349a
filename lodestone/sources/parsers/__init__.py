"""Document parsers: bytes of one file -> status and located text blocks, as a distributed column operation."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.sources.parsers import markup, office, ole, pdf, plain, rtf
from lodestone.sources.parsers.base import Block, ParseError

#: The size beyond which a file isn't parsed, the seconds that a parser gets, and what error codes stand for. The codes that parsers raise are fixed values too, as
#: they are part of the results.
LARGEST_FILE = 100 * 1024 * 1024
DEADLINE_SECONDS = 30
ENCRYPTED_CODES = ("PDF_ENCRYPTED", "DOC_ENCRYPTED", "XLS_ENCRYPTED", "ODT_ENCRYPTED")
UNSUPPORTED_CODES = ("VSD_VERSION_UNSUPPORTED", "VSD_STRUCTURE_UNSUPPORTED")

PARSERS: dict[str, Callable[[bytes], list[Block]]] = {
    **dict.fromkeys((".txt", ".adoc", ".java", ".sql", ".js"), plain.parse_text),
    ".xml": plain.parse_xml,
    ".md": plain.parse_markdown,
    ".csv": plain.parse_csv,
    **dict.fromkeys((".html", ".htm", ".xhtml"), markup.parse_html),
    **dict.fromkeys((".mht", ".mhtml"), markup.parse_mht),
    ".docx": office.parse_docx,
    ".pptx": office.parse_pptx,
    **dict.fromkeys((".xlsx", ".xlsm"), office.parse_xlsx),
    ".odt": office.parse_odt,
    ".doc": ole.parse_doc,
    ".xls": ole.parse_xls,
    ".msg": ole.parse_msg,
    ".pdf": pdf.parse_pdf,
    ".rtf": rtf.parse_rtf,
}

PARSED = "document_id long, status string, error_code string, error_message string, ordinal int, heading string, content string, location_kind string, location_value string"
_FIELDS = [("document_id", pa.int64()), ("status", pa.string()), ("error_code", pa.string()), ("error_message", pa.string()), ("ordinal", pa.int32()), ("heading", pa.string()), ("content", pa.string()), ("location_kind", pa.string()), ("location_value", pa.string())]


@contextmanager
def _deadline(seconds: int) -> Iterator[None]:
    """Raises ParseError in a parser that takes too long (where signals work: in a worker's main thread)."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_: object) -> None:
        raise ParseError("PARSER_TIMEOUT", f"no result within {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(seconds)
    try:
        yield
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def extension_of(filename: str) -> str:
    at = filename.rfind(".")
    return filename[at:].lower() if at > 0 else ""


def parse_document(filename: str, content: bytes | None) -> tuple[str, str | None, str | None, list[Block]]:
    """(status, error code, error message, blocks). Never raises; files without a parser are ``unsupported`` and aren't looked into."""
    parser = PARSERS.get(extension_of(filename))
    if parser is None:
        return "unsupported", None, None, []
    if content is None:
        return "error", "FILE_READ_FAILED", "the file can't be read", []
    if len(content) > LARGEST_FILE:
        return "too_large", "FILE_TOO_LARGE", f"over {LARGEST_FILE} bytes", []
    try:
        with _deadline(DEADLINE_SECONDS):
            blocks = parser(content)
    except ParseError as error:
        status = "encrypted" if error.code in ENCRYPTED_CODES else "unsupported" if error.code in UNSUPPORTED_CODES else "error"
        return status, error.code, str(error), []
    except Exception as error:  # a parser's own fault is that file's status, not the job's
        return "error", "PARSE_ERROR", f"{type(error).__name__}: {error}"[:500], []
    return ("indexed" if blocks else "no_text"), None, None, blocks


def parse_column(files: DataFrame) -> DataFrame:
    """Parses (document_id, filename, content): one row per block, or one with null ordinal for a file without blocks. Columns as in PARSED."""
    schema = pa.schema(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for ident, name, content in zip(*(batch.column(k) for k in range(3))):
                status, code, message, blocks = parse_document(name.as_py() or "", content.as_py())
                head = (ident.as_py(), status, code, message)
                for b in blocks or [Block(None, None, None, None, None)]:
                    rows.append((*head, b.ordinal, b.heading, b.content, b.location_kind, b.location_value))
                    size += len(b.content or "")
                    if len(rows) >= 5000 or size > 8 << 20:
                        yield table()
                        rows, size = [], 0
        if rows:
            yield table()

    return files.select("document_id", "filename", "content").mapInArrow(run, PARSED)
