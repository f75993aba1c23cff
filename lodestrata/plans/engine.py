"""The engine: index a directory, search it.

Indexing is one pass of set-at-a-time steps over versioned tables. What hasn't
changed is neither read, parsed nor embedded again: files are skipped by size and
time, then by content hash, and chunks by their own hash. A document that can't
be read or parsed keeps its status and is reported; the others go on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import embedding, search, state
from ..sources import code, files, parsers
from . import seams

_CHUNKED = ("document_id", "chunk_index", "title", "text", "token_count", "start_offset", "end_offset", "content_hash")


class Embedder(Protocol):
    """Adds the column vector to rows, and embeds one query."""

    def embed(self, rows: DataFrame, text: Column) -> DataFrame: ...

    def embed_query(self, spark: SparkSession, query: str) -> list[float]: ...


@dataclass(frozen=True)
class IndexOptions:
    fail_fast: bool = False
    include_hidden: bool = False
    follow_symlinks: bool = False
    keep_missing_files: bool = False


@dataclass
class IndexReport:
    discovered: int = 0
    read: int = 0
    chunked: int = 0
    embedded_chunks: int = 0
    removed_documents: int = 0
    errors: list[tuple[str, str]] = field(default_factory=list)


class IndexFailure(RuntimeError):
    """The first failure of a run with fail_fast."""


def _rows_of(df: DataFrame) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns])


class Engine:
    """*strategies* take the place of the formats that are built in, with their extensions, PDF extractor and code splitter."""

    def __init__(
        self, store: seams.Storage, model: embedding.EmbeddingModel, embedder: Embedder, metric: str = V.L2, formats: dict[str, tuple[str, ...]] | None = None,
        pdf_extractor: parsers.Extractor | None = None, strategies: Sequence[seams.Strategy] | None = None, splitter: seams.CodeSplitter = code.sections, vectors: seams.VectorStorage | None = None, searcher: seams.Searcher | None = None,
    ):
        if model is None:
            raise ValueError("an embedding model is needed")
        if embedder is None:
            raise ValueError("an embedder is needed")
        if store is None:
            raise ValueError("a store is needed")
        if metric not in (V.L2, V.COSINE):
            raise ValueError(f"no such metric: {metric}")
        self.strategies = seams.checked(seams.built_in(formats, pdf_extractor, splitter) if strategies is None else strategies)
        self.formats = {s.name: tuple(s.extensions) for s in self.strategies}
        self.spark, self.store, self.model, self.embedder, self.metric = store.spark, store, model, embedder, metric
        self.vectors, self.searcher = vectors or store, searcher or seams.ExactSearcher()

    # ---- index -------------------------------------------------------------

    def _chunks(self, read: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(chunks of document_id, (document_id, error)) of documents with content and format."""
        source = read.withColumn("source", parsers.source_text(F.col("content")))
        made, errors = [], []
        for strategy in self.strategies:
            parsed = self.store.stage(strategy.parse(source.where(F.col("format") == strategy.name)).select("document_id", "absolute_path", "sections", "error"), "parsed")
            errors.append(parsed.where("error is not null").select("document_id", "error"))
            made.append(strategy.chunk(parsed.where("error is null and sections is not null")).select(*_CHUNKED))
        return state.union(made), state.union(errors)

    def index(self, root: str, options: IndexOptions = IndexOptions()) -> IndexReport:
        report, stage = IndexReport(), self.store.stage
        try:
            found = stage(files.discover(self.spark, root, options.include_hidden, options.follow_symlinks, self.formats), "found")
            report.discovered = found.count()
            stored, old_chunks, old_vectors = self.store.documents(), self.store.chunks(), self.vectors.vectors()
            documents = stage(state.upsert_documents(stored, found.drop("format")), "documents")
            todo = documents.where(state.unread(documents) | F.col("status").isin(state.INDEXED, state.SCANNED))
            content = stage(files.with_content(todo.select(F.col("id").alias("document_id"), "absolute_path")).withColumn("format", files.format_of(F.col("absolute_path"), self.formats)).withColumn("hash", T.content_hash(F.col("content"))), "content")
            report.read = content.where("error is null").count()
            # A document that is to be scanned by its size and time only, and can't be read, stays as it is.
            readable = content.where("error is null").select(F.col("document_id").alias("id"), "hash")
            unreadable = content.where("error is not null").select(F.col("document_id").alias("id"))
            moved = state.fingerprinted(documents.join(unreadable, "id", "left_anti"), readable).unionByName(documents.join(unreadable, "id", "left_semi"))
            scanned = moved.where(F.col("status") == state.SCANNED).select(F.col("id").alias("document_id"))
            read = content.where("error is null and format is not null").join(scanned, "document_id", "left_semi")
            chunks, errors = self._chunks(read)
            chunks, errors = stage(chunks, "chunks"), stage(errors, "errors")
            failures = content.where("error is not null").select("absolute_path", "error").unionByName(errors.join(content.select("document_id", "absolute_path"), "document_id").select("absolute_path", "error"))
            report.errors = sorted(tuple(r) for r in failures.collect())
            if report.errors and options.fail_fast:
                raise IndexFailure(": ".join(report.errors[0]))
            done = stage(read.select("document_id").join(errors.select("document_id"), "document_id", "left_anti"), "done")
            report.chunked = done.count()
            moved = state.with_status(moved, done.withColumnRenamed("document_id", "id"), state.CHUNKED)
            # Only chunks that are new or not as they were are written.
            names = [f.split()[0] for f in state.CHUNKS.split(", ")]
            existing = stage(old_chunks.join(done, "document_id", "left_semi").select(*names), "existing")
            plan = stage(state.reconcile(existing, chunks), "plan")
            last = self.store.last_chunk_id()
            kept = state.applied(plan, last).select(*names)
            written = stage(kept.join(existing.select(_rows_of(existing).alias("__row"), F.col("id").alias("__id")), (F.col("id") == F.col("__id")) & (_rows_of(kept) == F.col("__row")), "left_anti"), "written")
            removed = plan.where("action = 'remove'").select("id")
            if not options.keep_missing_files:
                gone = stage(files.gone(documents.select("id", "absolute_path")), "gone")
                report.removed_documents = gone.count()
                dead = gone.select(F.col("id").alias("document_id"))
                removed = removed.unionByName(old_chunks.select("id", "document_id").join(dead, "document_id", "left_semi").select("id")).distinct()
                written = written.join(dead, "document_id", "left_anti").select(*names)
                moved = moved.join(gone.select("id"), "id", "left_anti")
            removed = stage(removed, "removed")
            # What waits for a vector is found by ids; texts of older chunks are read for those only.
            fresh = written.select("id").unionByName(old_chunks.select("id").join(removed, "id", "left_anti")).distinct()
            waiting = stage(fresh.join(old_vectors.select(F.col("chunk_id").alias("id")), "id", "left_anti"), "waiting")
            older = waiting.join(written.select("id"), "id", "left_anti")
            text = written.join(waiting, "id", "left_semi").select("id", "title", "text")
            if not older.isEmpty():
                text = text.unionByName(old_chunks.join(older, "id", "left_semi").select("id", "title", "text"))
            vectors = stage(self.embedder.embed(text.select(F.col("id").alias("chunk_id"), self.model.build_data(F.col("title"), F.col("text")).alias("prompt")), F.col("prompt")).select("chunk_id", F.col("vector").cast("array<float>").alias("vector")), "vectors")
            report.embedded_chunks = vectors.count()
            if report.embedded_chunks:
                like = old_vectors.select(F.size("vector")).first() or vectors.select(F.size("vector")).first()
                state.check_vectors(vectors, self.model.dimensions or like[0])
            ready = moved.where(F.col("status") == state.CHUNKED).select("id")
            final = stage(state.with_status(moved, ready, state.EMBEDDED), "final")
            last = max(last, written.agg(F.max("id")).first()[0] or 0)
            seen = lambda df: tuple(df.select(*stored.columns).agg(F.count("*"), F.sum(_rows_of(stored).cast("decimal(20,0)"))).first())
            self.store.commit(None if seen(final) == seen(stored) else final, written, removed, vectors, last)
        finally:
            self.store.clear_stage()
        return report

    # ---- search ------------------------------------------------------------

    def search(self, config: search.SearchConfig | str) -> DataFrame:
        """A row for each chunk found; search.nested() makes it one for each document."""
        if isinstance(config, str):
            config = search.SearchConfig(config)
        if not config.query.strip():
            raise ValueError("the query is empty")
        vector = self.embedder.embed_query(self.spark, self.model.build_query(config.query, config.task))
        if self.model.dimensions and len(vector) != self.model.dimensions:
            raise ValueError(f"the query has {len(vector)} dimensions, not {self.model.dimensions}")
        chunks = self.store.chunks().select(F.col("id").alias("chunk_id"), "document_id", "title", "text")
        documents = self.store.documents().select(F.col("id").alias("document_id"), "absolute_path")
        return self.searcher.search(self.vectors.vectors(), chunks, documents, vector, config, self.metric)
