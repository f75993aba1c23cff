"""Tables in a relational database, through any Python DB-API driver, and a store of documents, chunks and vectors in them.

*connect* is called on the executors, once for each partition, so that it has to
be importable there; sqlite3 needs nothing else installed, a PostgreSQL driver
works the same with its own parameter mark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import state

BATCH = 500
LAYOUT = 1


def upsert(df: DataFrame, connect: Callable, table: str, key: str, mark: str = "?", batch: int = BATCH) -> None:
    """Insert the rows of *df*; those whose *key* is known are updated. A transaction for each batch; a task that runs again writes the same."""
    columns = df.columns
    rest = [c for c in columns if c != key]
    update = f"DO UPDATE SET {', '.join(f'{c} = excluded.{c}' for c in rest)}" if rest else "DO NOTHING"
    statement = f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({', '.join([mark] * len(columns))}) ON CONFLICT ({key}) {update}"

    def write(rows: Iterator) -> None:
        connection = connect()
        try:
            for some in batched(rows, batch):
                connection.cursor().executemany(statement, [tuple(r) for r in some])
                connection.commit()
        finally:
            connection.close()

    df.foreachPartition(write)


def delete(ids: DataFrame, connect: Callable, table: str, key: str, mark: str = "?", batch: int = BATCH) -> None:
    """Delete the rows whose *key* is in the one column of *ids*."""

    def write(rows: Iterator) -> None:
        connection = connect()
        try:
            for some in batched(rows, batch):
                connection.cursor().executemany(f"DELETE FROM {table} WHERE {key} = {mark}", [tuple(r) for r in some])
                connection.commit()
        finally:
            connection.close()

    ids.foreachPartition(write)


def read(spark: SparkSession, connect: Callable, table: str, schema: str, key: str, parts: int = 8, fetch: int = 10_000) -> DataFrame:
    """The rows of a table with a whole-number *key*, read in *parts* ranges of it."""
    connection = connect()
    cursor = connection.cursor()
    cursor.execute(f"SELECT min({key}), max({key}) FROM {table}")
    low, high = cursor.fetchone()
    connection.close()
    empty = spark.createDataFrame([], schema)
    if low is None:
        return empty
    arrow, columns = to_arrow_schema(empty.schema), ", ".join(empty.columns)
    width = -(-(high - low + 1) // parts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ranges in batches:
            for start in ranges.column(0).to_pylist():
                connection = connect()
                cursor = connection.cursor()
                cursor.execute(f"SELECT {columns} FROM {table} WHERE {key} >= {int(start)} AND {key} < {int(start) + width}")
                while rows := cursor.fetchmany(fetch):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                connection.close()

    return spark.range(low, high + 1, width, parts).mapInArrow(scan, empty.schema)


@F.arrow_udf(Y.BinaryType())
def _packed(vector: pa.Array) -> pa.Array:
    return pa.array([None if v is None else np.asarray(v, np.float32).tobytes() for v in vector.to_pylist()], pa.binary())


@F.arrow_udf(Y.ArrayType(Y.FloatType()))
def _unpacked(vector: pa.Array) -> pa.Array:
    return pa.array([None if v is None else np.frombuffer(v, np.float32) for v in vector.to_pylist()], pa.list_(pa.float32()))


class RelationalStore:
    """The tables of plans.store.Store in a database. A commit isn't one transaction: vectors are written first and statuses
    last, and a run after a failed one goes on from there. *stage_root* is a folder that all executors share."""

    TABLES = {"documents": (state.DOCUMENTS, "id"), "chunks": (state.CHUNKS, "id"), "vectors": ("chunk_id long, vector binary", "chunk_id")}

    def __init__(self, spark: SparkSession, connect: Callable, stage_root: str, mark: str = "?", parts: int = 8, writers: int = 1, binary: str = "BLOB"):
        self.spark, self.connect, self.mark, self.parts, self.writers = spark, connect, mark, parts, writers
        self._staged: list[str] = []
        self.stage_root = stage_root.rstrip("/")
        kinds = {"long": "BIGINT", "int": "INTEGER", "string": "TEXT", "binary": binary}
        connection = connect()
        cursor = connection.cursor()
        cursor.execute("CREATE TABLE IF NOT EXISTS layout (version INTEGER PRIMARY KEY)")
        cursor.execute("SELECT max(version) FROM layout")
        (known,) = cursor.fetchone()
        if known is None:
            for table, (schema, key) in self.TABLES.items():
                columns = ", ".join(f"{n} {kinds[k]}{' PRIMARY KEY' if n == key else ''}" for n, k in (c.split() for c in schema.split(", ")))
                cursor.execute(f"CREATE TABLE IF NOT EXISTS {table} ({columns})")
            cursor.execute("CREATE INDEX IF NOT EXISTS chunks_of_document ON chunks (document_id)")
            cursor.execute(f"INSERT INTO layout VALUES ({LAYOUT})")
        connection.commit()
        connection.close()
        if known is not None and known != LAYOUT:
            raise ValueError(f"the database has layout {known}, not {LAYOUT}")

    def _read(self, table: str) -> DataFrame:
        return read(self.spark, self.connect, table, *self.TABLES[table], self.parts)

    def documents(self) -> DataFrame:
        return self._read("documents")

    def chunks(self) -> DataFrame:
        return self._read("chunks")

    def vectors(self) -> DataFrame:
        return self._read("vectors").select("chunk_id", _unpacked("vector").alias("vector"))

    def last_chunk_id(self) -> int:
        return self.chunks().agg(F.max("id")).first()[0] or 0

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        folder = f"{self.stage_root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        self._staged.append(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def clear_stage(self) -> None:
        for folder in self._staged:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._staged.clear()

    def commit(self, documents: DataFrame | None, chunks: DataFrame, removed: DataFrame, vectors: DataFrame, last_chunk_id: int) -> None:
        put = lambda df, table: upsert(df.coalesce(self.writers), self.connect, table, self.TABLES[table][1], self.mark)
        drop = lambda ids, table: delete(ids.coalesce(self.writers), self.connect, table, self.TABLES[table][1], self.mark)
        put(vectors.select("chunk_id", _packed("vector").alias("vector")), "vectors")
        put(chunks.select(*[c.split()[0] for c in state.CHUNKS.split(", ")]), "chunks")
        for table in ("vectors", "chunks"):
            drop(removed.select("id"), table)
        if documents is not None:
            drop(self.stage(self.documents().select("id").join(documents, "id", "left_anti"), "gone"), "documents")
            put(documents.select(*[c.split()[0] for c in state.DOCUMENTS.split(", ")]), "documents")
