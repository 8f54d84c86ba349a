"""Logical tables of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

#: What documents, blocks and comparisons can be.
STATUSES = ("indexed", "no_text", "unsupported", "too_large", "encrypted", "error")
LOCATION_KINDS = ("section", "line", "slide", "sheet_cell", "page")
REASONS = ("rebuild", "added", "source-changed", "error-retry", "text-upgrade", "unsupported-retry", "unchanged")
#: Extensions whose parse version counts, and the version.
TEXT_EXTENSIONS = (".txt", ".adoc", ".java", ".sql", ".js", ".xml", ".md")
TEXT_PARSE_VERSION = 1

_s, _l, _i, _d = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DOCUMENTS = _struct(id=_l, root_path=_s, path=_s, filename=_s, extension=_s, size_bytes=_l, modified_at_ms=_d, indexed_at_ms=_l, status=_s, error_code=_s, error_message=_s, parse_version=_i)
BLOCKS = _struct(document_id=_l, ordinal=_i, heading=_s, content=_s, location_kind=_s, location_value=_s, norm_heading=_s, norm_content=_s)
LISTING = _struct(path=_s, filename=_s, extension=_s, size_bytes=_l, modified_at_ms=_d)
PARSED_BLOCK = _struct(ordinal=_i, heading=_s, content=_s, location_kind=_s, location_value=_s)
DIAGNOSTIC = _struct(stage=_s, path=_s, code=_s, message=_s)
EVENTS = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("root", _s), T.StructField("path", _s), T.StructField("kind", _s)])
