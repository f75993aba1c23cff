"""Prompt templates and embedders.

Templates are string projections. The hashing embedder is the default: it needs
no network and is deterministic. The HTTP embedder calls an OpenAI-style server
from Arrow batches; store what it returns at once, keyed by chunk id, so that a
task that runs again repeats calls but not rows.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# ---- templates -------------------------------------------------------------


@dataclass(frozen=True)
class EmbeddingModel:
    """Name, dimensions, and how chunks and queries are phrased. *task* is the default task; None if it takes none."""

    name: str
    dimensions: int = 0
    document: Callable[[Column, Column], Column] = lambda title, text: text
    query: Callable[[str, str], str] = lambda query, task: query
    task: str | None = None

    def build_data(self, title: Column, text: Column) -> Column:
        return self.document(title, text)

    def build_query(self, query: str, task: str = "") -> str:
        if task and self.task is None:
            raise ValueError(f"{self.name} takes no task type, got {task!r}")
        return self.query(query, task or self.task or "")


def _titled(title: Column, text: Column) -> Column:
    label = T.trim(title)
    return F.concat(F.lit("title: "), F.when(label == "", "none").otherwise(label), F.lit(" | text: "), text)


def _prefixed(prefix: str) -> Callable[[Column, Column], Column]:
    return lambda title, text: F.concat(F.lit(prefix), text)


_INSTRUCTION = "Represent this sentence for searching relevant passages: "
GEMMA_TASKS = ("search result", "question answering", "fact checking", "classification", "clustering", "sentence similarity", "code retrieval")
NOMIC_TASKS = ("search_query", "classification", "clustering")
MODELS = {
    "gemma": EmbeddingModel("text-embedding-embeddinggemma-300m-qat", 768, _titled, lambda q, t: f"task: {t} | query: {q}", GEMMA_TASKS[0]),
    "nomic": EmbeddingModel("text-embedding-nomic-embed-text-v1.5", 768, _prefixed("search_document: "), lambda q, t: f"{t}: {q}", NOMIC_TASKS[0]),
    "e5": EmbeddingModel("text-embedding-multilingual-e5-large", 1024, _prefixed("passage: "), lambda q, t: f"query: {q}"),
    "bge": EmbeddingModel("text-embedding-bge-large-en-v1.5", 1024, query=lambda q, t: _INSTRUCTION + q),
    "mxbai": EmbeddingModel("text-embedding-mxbai-embed-large-v1", 1024, query=lambda q, t: _INSTRUCTION + q),
    "qwen3": EmbeddingModel("text-embedding-qwen3-embedding-0.6b", 1024, query=lambda q, t: f"Instruct: {t}\nQuery: {q}", task="Search for this"),
}


def model(name: str, dimensions: int = 0) -> EmbeddingModel:
    """The model of that key or full name, or one without templates."""
    for key, known in MODELS.items():
        if name in (key, known.name):
            return known
    return EmbeddingModel(name, dimensions)


# ---- hashing embedder ------------------------------------------------------

DIMENSIONS = 1024
_BASIS, _FNV = np.uint32(2166136261), np.uint32(16777619)


def hash_words(words: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes of each word: numpy over all words at once, byte by byte."""

    @F.arrow_udf("array<long>")
    def fnv(array: pa.Array) -> pa.Array:
        flat = array.flatten().cast(pa.large_binary())
        n = len(flat)
        if not n:
            return pa.array([[] if ok else None for ok in array.is_valid().to_pylist()], pa.list_(pa.int64()))
        _, offs, data = flat.buffers()
        offsets = np.frombuffer(offs, np.int64, n + 1, flat.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        h = np.full(n, _BASIS)
        left = np.diff(offsets)
        order = np.argsort(-left, kind="stable")
        sizes = left[order]
        for i in range(int(sizes[0]) if n else 0):
            at = order[: int(np.searchsorted(-sizes, -i, side="left"))]
            h[at] = (h[at] ^ raw[offsets[at] + i]) * _FNV
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(h.astype(np.int64)))

    return fnv(words)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+", -1), lambda w: w != "")


def hashing_terms(rows: DataFrame, keys: list[str], text: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """(keys, bucket, n): the embedding's entries that aren't zero."""
    hashed = rows.select(*keys, F.explode(F.transform(hash_words(words(text)), lambda h: F.pmod(h, F.lit(dimensions)))).alias("bucket"))
    return hashed.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))


def hashing_vectors(rows: DataFrame, text: Column, dimensions: int = DIMENSIONS, name: str = "vector") -> DataFrame:
    """*rows* with the term counts of the text by hash as a vector; nothing is shuffled."""

    @F.arrow_udf("array<float>")
    def counts(hashes: pa.Array) -> pa.Array:
        rows = len(hashes)
        at = pc.list_parent_indices(hashes).to_numpy(zero_copy_only=False).astype(np.int64) * dimensions
        out = np.bincount(at + hashes.flatten().to_numpy(zero_copy_only=False) % dimensions, minlength=rows * dimensions)
        ends = np.arange(0, (rows + 1) * dimensions, dimensions, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.astype(np.float32)))

    return rows.withColumn(name, counts(hash_words(words(text))))


class HashingEmbedder:
    """The default embedder: rows of text to vectors, and one query to a vector."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, rows: DataFrame, text: Column) -> DataFrame:
        return hashing_vectors(rows, text, self.dimensions)

    def embed_query(self, spark, query: str) -> list[float]:
        return list(self.embed(spark.range(1), F.lit(query)).first()["vector"])


# ---- HTTP embedder ---------------------------------------------------------

RETRIES, FIRST_WAIT, LONGEST_WAIT, TIMEOUT = 3, 0.2, 5.0, 60.0


def endpoint(url: str) -> str:
    """The embeddings address of a server's base address."""
    parts = urlsplit(url.strip())
    if not parts.scheme or not parts.netloc:
        raise ValueError(f"not an address: {url!r}")
    url = url.strip().rstrip("/")
    return url if url.endswith("/v1/embeddings") else url + "/v1/embeddings"


class EmbeddingError(RuntimeError):
    pass


def parse_response(body: bytes, count: int, dimensions: int = 0) -> list[list[float]]:
    """Vectors in the order of the inputs; an error that the server reports, or a gap, is raised."""
    try:
        got = json.loads(body)
    except ValueError as e:
        raise EmbeddingError(f"can't decode the response: {e}") from e
    if error := got.get("error"):
        raise EmbeddingError(error if isinstance(error, str) else str(error.get("message", error)))
    out: list[list[float] | None] = [None] * count
    for item in got.get("data", []):
        i = item.get("index", -1)
        if not 0 <= i < count:
            raise EmbeddingError(f"index {i} of {count}")
        out[i] = item["embedding"]
    if any(not v for v in out):
        raise EmbeddingError("a vector is missing")
    if dimensions and any(len(v) != dimensions for v in out):
        raise EmbeddingError(f"a vector hasn't {dimensions} dimensions")
    return out


class HttpEmbedder:
    """An OpenAI-style server. Transport errors, 429 and 5xx are tried again, with growing pauses."""

    def __init__(self, url: str, model_name: str, dimensions: int = 0, key: str = "", timeout: float = TIMEOUT, batch: int = 64, sleep: Callable[[float], None] = time.sleep, send: Callable | None = None):
        if not model_name.strip():
            raise ValueError("the model has no name")
        self.url, self.model_name, self.dimensions, self.key, self.timeout, self.batch = endpoint(url), model_name, dimensions, key, timeout, batch
        self.sleep, self.send = sleep, send or self._post

    def _post(self, body: bytes) -> tuple[int, bytes]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    def embed_texts(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        body = json.dumps({"model": self.model_name, "input": list(texts)}).encode()
        for attempt in range(RETRIES + 1):
            try:
                status, answer = self.send(body)
                if 200 <= status < 300:
                    return parse_response(answer, len(texts), self.dimensions)
                failure = EmbeddingError(f"status {status}: {answer[:512].decode(errors='replace')}")
                if status != 429 and status < 500:
                    raise failure
            except (OSError, http.client.HTTPException) as e:  # an answer that breaks off is the latter
                failure = EmbeddingError(str(e))
            if attempt < RETRIES:
                self.sleep(min(LONGEST_WAIT, FIRST_WAIT * 2**attempt))
        raise failure

    def embed(self, rows: DataFrame, text: Column) -> DataFrame:
        @F.arrow_udf("array<float>")
        def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                values, out = texts.to_pylist(), []
                for at in range(0, len(values), self.batch):
                    out += self.embed_texts(values[at : at + self.batch])
                yield pa.array(out, pa.list_(pa.float32()))

        return rows.withColumn("vector", call.asNondeterministic()(text))

    def embed_query(self, spark, query: str) -> list[float]:
        return self.embed_texts([query])[0]
