"""Contents to sections, by format.

Plain text is native. Markdown, code and DOCX go through Arrow batches; PDF takes
an injected extractor of text runs, since none is installed.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import text as T
from . import code, docx, markdown

# Types are objects, not text: workers import this module, and reading text needs a session.
SECTIONS = Y.ArrayType(Y.StructType([Y.StructField("path", Y.ArrayType(Y.StringType())), Y.StructField("body", Y.StringType())]))
_ARROW = pa.list_(pa.struct([("path", pa.list_(pa.string())), ("body", pa.string())]))


def _rows(found: list) -> pa.Array:
    return pa.array([None if s is None else [{"path": p, "body": b} for p, b in s] for s in found], _ARROW)


@F.arrow_udf(SECTIONS)
def markdown_sections(source: pa.Array) -> pa.Array:
    return _rows([markdown.sections(s) if s is not None else None for s in source.to_pylist()])


def code_sections_by(splitter: Callable[[str, str], list]):
    """The sections that *splitter* finds in (source, extension), as a function of columns."""

    @F.arrow_udf(SECTIONS)
    def code_sections(source: pa.Array, extension: pa.Array) -> pa.Array:
        return _rows([splitter(s, e) if s is not None else None for s, e in zip(source.to_pylist(), extension.to_pylist())])

    return code_sections


code_sections = code_sections_by(code.sections)


@F.arrow_udf(Y.StructType([Y.StructField("sections", SECTIONS), Y.StructField("error", Y.StringType())]))
def docx_sections(content: pa.Array) -> pa.Array:
    found, errors = [], []
    for c in content.to_pylist():
        try:
            found.append(docx.sections(c) if c is not None else [])
            errors.append(None)
        except ValueError as e:
            found.append(None)
            errors.append(str(e))
    return pa.StructArray.from_arrays([_rows(found), pa.array(errors, pa.string())], names=["sections", "error"])


def plain_sections(source: Column) -> Column:
    return F.array(F.struct(F.array().cast("array<string>").alias("path"), source.alias("body")))


def source_text(content: Column) -> Column:
    """Normalized text of UTF-8 bytes."""
    return T.normalize_text(F.decode(content, "UTF-8"))


def kept_code(source: Column) -> Column:
    """A source, or null where it is minified or generated."""
    return T.let(source, lambda s: F.when(~T.is_minified(s) & ~T.is_generated(s), s))


Extractor = Callable[[bytes], list[tuple[str, float, float, float, int]]]


def pdf_runs(files: DataFrame, extract: Extractor) -> DataFrame:
    """The text runs (text, font size, x, y, page) that *extract* finds in each content, by document."""
    run = "array<struct<text: string, font_size: double, x: double, y: double, page: int>>"
    kind = pa.list_(pa.struct([("text", pa.string()), ("font_size", pa.float64()), ("x", pa.float64()), ("y", pa.float64()), ("page", pa.int32())]))

    @F.arrow_udf(run)
    def runs(content: pa.Array) -> pa.Array:
        names = ("text", "font_size", "x", "y", "page")
        return pa.array([[dict(zip(names, r)) for r in extract(c)] if c is not None else [] for c in content.to_pylist()], kind)

    return files.select("document_id", F.posexplode(runs(F.col("content"))).alias("seq", "r")).select("document_id", "r.page", "r.x", "r.y", "r.font_size", "r.text", "seq")
