"""What a user may bring: strategies for formats, stores, searchers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, pdf, search
from ..sources import code, files, parsers


class Strategy(Protocol):
    """How the files of some extensions become chunks."""

    name: str
    extensions: tuple[str, ...]

    def parse(self, read: DataFrame) -> DataFrame:
        """(document_id, absolute_path, sections, error) of files (document_id, absolute_path, content, source): an array of
        (path, body), null for files that are left out, and what went wrong, if anything."""
        ...

    def chunk(self, parsed: DataFrame) -> DataFrame:
        """(document_id, chunk_index, title, text, token_count, start_offset, end_offset, content_hash) of parsed files with sections."""
        ...


class Storage(Protocol):
    """Tables of documents and chunks, in the layouts of operators.state, with their vectors."""

    spark: SparkSession

    def documents(self) -> DataFrame: ...

    def chunks(self) -> DataFrame: ...

    def last_chunk_id(self) -> int: ...

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """*df* written once and read again."""
        ...

    def clear_stage(self) -> None: ...

    def commit(self, documents: DataFrame | None, chunks: DataFrame, removed: DataFrame, vectors: DataFrame, last_chunk_id: int) -> object:
        """These documents (None: as before); *chunks* in the place of those with the same ids or added; *removed* (id)
        without their vectors; *vectors* (chunk_id, vector) added."""
        ...


class VectorStorage(Protocol):
    """The vectors, which may be elsewhere than the rest."""

    def vectors(self) -> DataFrame: ...


class Searcher(Protocol):
    """Finds the chunks nearest to a query's vector and ranks their documents."""

    def search(self, vectors: DataFrame, chunks: DataFrame, documents: DataFrame, query: Sequence[float], config: search.SearchConfig, metric: str) -> DataFrame: ...


class ExactSearcher:
    """Every vector is held against the query."""

    def search(self, vectors, chunks, documents, query, config, metric):
        return search.search(vectors, chunks, documents, query, config, metric)


# ---- the formats that are built in ----------------------------------------------

CodeSplitter = Callable[[str, str], list[tuple[list[str], str]]]


class Text:
    """A format whose sections are an expression of the normalized text and the path."""

    def __init__(self, name: str, extensions: Iterable[str], sections: Callable[[Column, Column], Column]):
        self.name, self.extensions, self.sections = name, tuple(extensions), sections

    def parse(self, read: DataFrame) -> DataFrame:
        return read.select("document_id", "absolute_path", self.sections(F.col("source"), F.col("absolute_path")).alias("sections"), F.lit(None).cast("string").alias("error"))

    def chunk(self, parsed: DataFrame) -> DataFrame:
        return chunking.chunked(parsed, F.col("sections"), T.file_title(F.col("absolute_path")), self.name, ["document_id"])


class Docx(Text):
    def __init__(self, extensions: Iterable[str]):
        super().__init__("docx", extensions, None)

    def parse(self, read: DataFrame) -> DataFrame:
        parsed = read.select("document_id", "absolute_path", parsers.docx_sections(F.col("content")).alias("parsed"))
        return parsed.select("document_id", "absolute_path", "parsed.sections", "parsed.error")


class Pdf(Text):
    def __init__(self, extensions: Iterable[str], extract: parsers.Extractor):
        super().__init__("pdf", extensions, None)
        self.extract = extract

    def parse(self, read: DataFrame) -> DataFrame:
        rows = pdf.sections(parsers.pdf_runs(read, self.extract))
        rows = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("section", "path", "body"))).alias("s"))
        rows = rows.select("document_id", F.transform("s", lambda x: F.struct(x["path"].alias("path"), x["body"].alias("body"))).alias("sections"))
        return read.select("document_id", "absolute_path").join(rows, "document_id").withColumn("error", F.lit(None).cast("string"))


def built_in(formats: dict[str, tuple[str, ...]] | None = None, extract: parsers.Extractor | None = None, splitter: CodeSplitter = code.sections) -> list[Strategy]:
    """The strategies of *formats* (name to extensions); PDF only with an extractor."""
    code_of = parsers.code_sections_by(splitter)
    make = {
        "plain": lambda e: Text("plain", e, lambda source, _: parsers.plain_sections(source)),
        "markdown": lambda e: Text("markdown", e, lambda source, _: parsers.markdown_sections(source)),
        "code": lambda e: Text("code", e, lambda source, path: code_of(parsers.kept_code(source), T.extension(path))),
        "docx": Docx,
        "pdf": lambda e: Pdf(e, extract),
    }
    chosen = files.FORMATS if formats is None else formats
    if unknown := sorted(set(chosen) - set(make)):
        raise ValueError(f"no such format: {', '.join(unknown)}")
    return [make[name](extensions) for name, extensions in chosen.items() if name != "pdf" or extract is not None]


def checked(strategies: Sequence[Strategy]) -> list[Strategy]:
    """*strategies*, if there are any and no name or extension is claimed twice."""
    if not strategies:
        raise ValueError("a format is needed")
    for claimed in ([s.name for s in strategies], [e.lower() for s in strategies for e in s.extensions]):
        if twice := sorted({e for e in claimed if claimed.count(e) > 1}):
            raise ValueError(f"claimed twice: {', '.join(twice)}")
    return list(strategies)
