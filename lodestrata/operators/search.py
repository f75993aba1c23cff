"""Nearest chunks, grouped into ranked documents.

The order of the stages is fixed: the nearest FETCH hits; hits without a chunk go;
relevance; documents by their best chunk; caps; text for what is left. Only the
first stage sees all vectors, and it ends in a bounded top-k; what is joined from
then on are at most FETCH rows, whatever the size of the tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

FETCH = 4096
_NEAR = "query_id long, chunk_id long, distance double"
MAX_DOCUMENTS, MAX_CHUNKS = 20, 3
#: Queries whose vectors are held against a batch at once.
BLOCK = 1024
#: Queries up to which a batch search sends them to every vector; beyond it both sides are cut into blocks.
COLLECT = 8192
#: Queries of a block at least, where there are cores for more blocks, and at most; vectors of a block at most.
LEAST_QUERIES, MOST_QUERIES, MOST_VECTORS = 2048, 32768, 131072


@dataclass(frozen=True)
class SearchConfig:
    query: str = ""
    task: str = ""
    min_relevance: float = 0.0
    max_documents: int = 0
    max_chunks: int = 0

    def caps(self) -> tuple[int, int]:
        """(documents, chunks of each); 0 stands for the default."""
        if self.max_documents < 0 or self.max_chunks < 0:
            raise ValueError("caps can't be negative")
        return self.max_documents or MAX_DOCUMENTS, self.max_chunks or MAX_CHUNKS


def knn(vectors: DataFrame, query: Sequence[float], k: int, metric: str = V.L2, dimensions: int | None = None) -> DataFrame:
    """(chunk_id, distance) of the *k* nearest of *vectors* (chunk_id, vector); ties go to the smaller id.

    Each batch of vectors is one matrix product and hands on its own k nearest. Vectors that are null, hold a null or
    have another number of dimensions than the query are near to nothing.
    """
    if dimensions is not None and len(query) != dimensions:
        raise ValueError(f"the query has {len(query)} dimensions, the store {dimensions}")
    if metric not in (V.L2, V.COSINE):
        raise ValueError(f"no such metric: {metric}")
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], "chunk_id long, distance double")
    q, zero = _unit_rows(np.asarray(query, np.float64), 1)
    same = vectors.select("chunk_id", "vector").where(F.size("vector") == len(query))
    hits = same.mapInArrow(_held_against(np.zeros(1, np.int64), q, zero, k, metric), _NEAR).select("chunk_id", "distance")
    return hits.orderBy(F.round("distance", V.ORDER_DIGITS), "chunk_id").limit(k)


def ranked(hits: DataFrame) -> DataFrame:
    """*hits* with their rank from 1. They are a bounded few, so that one partition ranks them."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.round("distance", V.ORDER_DIGITS), "chunk_id")))


def mapped(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """*hits* with the document of each; those without a chunk go. *hits* are a bounded few and are sent to the chunks."""
    return F.broadcast(hits).join(chunks.select("chunk_id", "document_id"), "chunk_id")


def relevant(hits: DataFrame, least: float) -> DataFrame:
    return hits.withColumn("chunk_score", V.relevance(F.col("distance"))).where(F.col("chunk_score") >= least)


def grouped(hits: DataFrame) -> DataFrame:
    """Documents in the order of their best hits, and their chunks in order: doc_rank, doc_score, chunk_rank."""
    per = Window.partitionBy("document_id")
    best = hits.withColumn("best", F.min("rank").over(per)).withColumn("doc_score", F.max("chunk_score").over(per)).withColumn("chunk_rank", F.row_number().over(per.orderBy("rank")))
    return best.withColumn("doc_rank", F.dense_rank().over(Window.orderBy("best"))).drop("best")


def capped(groups: DataFrame, max_documents: int = MAX_DOCUMENTS, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    return groups.where((F.col("chunk_rank") <= max_chunks) & (F.col("doc_rank") <= max_documents))


def hydrated(groups: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """With titles, texts, paths and file names, read for the surviving rows only; what is missing is empty."""
    few = F.broadcast(groups.select("chunk_id"))
    texts = chunks.select("chunk_id", "title", "text").join(few, "chunk_id", "left_semi")
    paths = documents.select("document_id", "absolute_path").join(F.broadcast(groups.select("document_id").distinct()), "document_id", "left_semi")
    out = groups.join(texts, "chunk_id", "left").join(paths, "document_id", "left")
    path = F.coalesce("absolute_path", F.lit(""))
    return out.select("doc_rank", "document_id", T.base_name(path).alias("file_name"), path.alias("absolute_path"), "doc_score", "chunk_rank", "chunk_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), "chunk_score")


def search(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, query: Sequence[float], config: SearchConfig = SearchConfig(), metric: str = V.L2, fetch: int = FETCH) -> DataFrame:
    """A row for each chunk of the result, in the layout of hydrated()."""
    return assembled(knn(vectors, query, fetch, metric), chunks, documents, config)


def assembled(near: DataFrame, chunks: DataFrame, documents: DataFrame, config: SearchConfig) -> DataFrame:
    """The same for the nearest (chunk_id, distance), however they were found."""
    most, each = config.caps()
    hits = mapped(ranked(near), chunks)
    return hydrated(capped(grouped(relevant(hits, config.min_relevance)), most, each), chunks, documents)


def nested(results: DataFrame) -> DataFrame:
    """A row for each document, its chunks as an array in order."""
    chunk = F.struct("chunk_rank", "chunk_id", "title", "text", "chunk_score")
    return results.groupBy("doc_rank", "document_id", "file_name", "absolute_path", "doc_score").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))


def _unit_rows(flat: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows at unit length, whether each was zero). Squares are added one after the other, as SQL does."""
    v = flat.astype(np.float64).reshape(rows, -1)
    n = np.sqrt(np.add.accumulate(v * v, axis=1)[:, -1:])
    return v / np.where(n == 0, 1, n), n[:, 0] == 0


class _Nearest:
    """The k nearest so far of each of some queries, among the vectors offered; ties go to the smaller id.

    Scores are a matrix product in single precision; what could be among the nearest, within its error, is computed
    again in double precision. A score is the cosine, or a half for a zero vector, and falls with the distance."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, q_zero: np.ndarray, k: int, metric: str):
        self.ids, self.q, self.q_zero, self.k, self.metric = ids, q, q_zero, k, metric
        self.single = q.astype(np.float32)
        self.margin = (q.shape[1] + 8) * 1.2e-7 + 1e-8  # of single precision, and of the digits that decide
        self.least = np.full(len(ids), -np.inf, np.float32)
        if metric == V.COSINE:
            self.least[q_zero] = np.nan
        self.found: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def offer(self, chunk_ids: np.ndarray, v: np.ndarray, v_zero: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Hold vectors against the queries at *rows*, or all."""
        fit = np.isfinite(v).all(axis=1) & ~(v_zero & (self.metric == V.COSINE))
        if not fit.all():
            chunk_ids, v, v_zero = chunk_ids[fit], v[fit], v_zero[fit]
        rows, single = np.arange(len(self.ids)) if rows is None else rows, v.astype(np.float32)
        for a in range(0, len(rows), BLOCK):
            for b in range(0, len(v), BLOCK):
                cut = slice(b, b + BLOCK)
                self._hold(rows[a : a + BLOCK], chunk_ids[cut], v[cut], single[cut], v_zero[cut])

    def _hold(self, rows: np.ndarray, chunk_ids: np.ndarray, v: np.ndarray, single: np.ndarray, v_zero: np.ndarray) -> None:
        score = self.single[rows] @ single.T
        if v_zero.any():
            score[:, v_zero] += 0.5
        near, wide = score >= self.least[rows, None], len(v)
        if wide > self.k and np.count_nonzero(near) > 4 * self.k * len(rows):
            self.least[rows] = np.maximum(self.least[rows], np.partition(score, wide - self.k, axis=1)[:, wide - self.k] - 2 * self.margin)
            near = score >= self.least[rows, None]
        row, at = np.divmod(np.flatnonzero(near), wide)
        for a in range(0, len(row), 32768):
            r, i = rows[row[a : a + 32768]], at[a : a + 32768]
            cos = np.add.accumulate(self.q[r] * v[i], axis=1)[:, -1]
            if self.metric == V.L2:
                d = np.sqrt(np.maximum(0, (~v_zero[i]).astype(float) + (~self.q_zero[r]).astype(float) - 2 * cos))
            else:
                d = 1 - cos
            self.found.append((r, chunk_ids[i], d, np.round(d, V.ORDER_DIGITS)))
            self.waiting += len(r)
            if self.waiting > max(2 * self.k * len(self.ids), 65536):
                self._settle()

    def _settle(self) -> None:
        if self.waiting:
            row, chunk, d, key = (np.concatenate(x) for x in zip(*self.found))
            order = np.lexsort((chunk, key, row))
            place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            order, place = order[place < self.k], place[place < self.k]
            self.found, self.waiting = [(row[order], chunk[order], d[order], key[order])], 0
            last = order[place == self.k - 1]
            far = key[last] + 10.0**-V.ORDER_DIGITS
            score = 1 - self.q_zero[row[last]] / 2 - far * far / 2 if self.metric == V.L2 else 1 - far
            self.least[row[last]] = np.maximum(self.least[row[last]], score - self.margin)

    def batch(self) -> pa.RecordBatch:
        self._settle()
        row, chunk, d = self.found[0][:3] if self.found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(chunk), pa.array(d)], names=["query_id", "chunk_id", "distance"])


def _some(rows):
    """A batch or table without the rows of null vectors. Not a filter in Spark, which would make computed vectors twice."""
    return rows.filter(rows.column("vector").is_valid()) if rows.column("vector").null_count else rows


def _vectors(column: pa.Array | pa.ChunkedArray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return _unit_rows(column.flatten().to_numpy(zero_copy_only=False), rows)


def _held_against(ids: np.ndarray, q: np.ndarray, q_zero: np.ndarray, k: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _Nearest(ids, q, q_zero, k, metric)
        for batch in map(_some, batches):
            if batch.num_rows:
                near.offer(batch.column("chunk_id").to_numpy(zero_copy_only=False), *_vectors(batch.column("vector"), batch.num_rows))
        yield near.batch()

    return run


def _block_pairs(k: int, metric: str):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows or not (queries := _some(queries)).num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        vectors = _some(vectors.select(["chunk_id", "held"]).rename_columns(["chunk_id", "vector"]))
        near = _Nearest(queries.column("query_id").to_numpy(), *_vectors(queries.column("vector"), queries.num_rows), k, metric)
        for at in range(0, vectors.num_rows, 16384):
            some = vectors.slice(at, 16384)
            near.offer(some.column("chunk_id").to_numpy(), *_vectors(some.column("vector"), some.num_rows))
        return pa.Table.from_batches([near.batch()])

    return run


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = V.L2, collect: int = COLLECT) -> DataFrame:
    """(query_id, chunk_id, distance, rank): the *k* nearest vectors of every one of *queries* (query_id, vector).

    Up to *collect* queries go to the vectors, of which each task hands on its own k nearest to each query; a window
    takes the best of those. Of more queries blocks are made on both sides, and every two blocks are one task's; nothing
    is collected. A block is bounded, so the vectors are shuffled once for each block of the other side. Null vectors
    are near to nothing.
    """
    queries, vectors = queries.select("query_id", "vector"), vectors.select("chunk_id", "vector")
    count = queries.count()
    near = vectors.sparkSession.createDataFrame([], _NEAR)
    if count > collect:
        most = vectors.sparkSession.sparkContext.defaultParallelism
        across = max(-(-count // MOST_QUERIES), min(most, -(-count // LEAST_QUERIES)))
        down = max(1, -(-vectors.count() // MOST_VECTORS))
        block = lambda key, n, name: F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(name)
        every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        left = queries.select("query_id", "vector", block("query_id", across, "a"), every(down, "b"))
        right = vectors.select("chunk_id", F.col("vector").alias("held"), every(across, "a"), block("chunk_id", down, "b"))
        near = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_block_pairs(k, metric), _NEAR)
    elif count:
        got = _some(queries.toArrow())
        near = near if not got.num_rows else vectors.mapInArrow(_held_against(got.column("query_id").to_numpy(), *_vectors(got.column("vector"), got.num_rows), k, metric), _NEAR)
    order = Window.partitionBy("query_id").orderBy(F.round("distance", V.ORDER_DIGITS), "chunk_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
