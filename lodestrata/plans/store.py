"""Versioned tables of documents, chunks and vectors in Parquet.

A version is a manifest that names folders; the file CURRENT names the manifest
and is replaced last, so that readers see all tables of one version or of another.
Chunks and vectors are the large tables: a version adds a segment of new ones and a
list of ids that are dead in the segments before it, and rewrites them only
when the dead are more than COMPACT of all or the segments more than SEGMENTS. A
run that changes nothing writes no table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state

COMPACT, SEGMENTS = 0.2, 64
#: Layout of manifests and tables; a store of a later one can't be opened.
LAYOUT = 2
#: Dead ids up to which they are sent to the vectors; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


@dataclass
class Segments:
    """Folders of rows in order, and of the ids that are dead in the rows before each."""

    rows: list[str] = field(default_factory=list)
    dead: list[list] = field(default_factory=list)  # (folder, number of segments that it applies to)
    n_rows: int = 0
    n_dead: int = 0


@dataclass
class Manifest:
    documents: str = ""
    chunks: Segments = field(default_factory=Segments)
    vectors: Segments = field(default_factory=Segments)
    last_chunk_id: int = 0
    layout: int = LAYOUT


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    # Small files go through Hadoop's file system, as the tables do.

    def _read_text(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        """Write beside, then rename over."""
        beside, path = self._path(f"{self.root}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        stream = self._fs.create(beside)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(beside, path, options)

    def manifest(self) -> Manifest:
        current = self._read_text("CURRENT")
        if not current:
            return Manifest()
        known = json.loads(self._read_text(current))
        if known.get("layout") != LAYOUT:
            raise ValueError(f"the store has layout {known.get('layout')}, not {LAYOUT}")
        return Manifest(**known | {k: Segments(**known[k]) for k in ("chunks", "vectors")})

    def _table(self, schema: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def documents(self) -> DataFrame:
        m = self.manifest()
        return self._table(state.DOCUMENTS, [m.documents] if m.documents else [])

    def chunks(self) -> DataFrame:
        return self._live(self.manifest().chunks, state.CHUNKS, "id")

    def vectors(self) -> DataFrame:
        return self._live(self.manifest().vectors, state.VECTORS, "chunk_id")

    def last_chunk_id(self) -> int:
        return self.manifest().last_chunk_id

    def _live(self, segments: Segments, schema: str, key: str) -> DataFrame:
        """The rows whose id isn't dead in their segment."""
        if not segments.dead:
            return self._table(schema, segments.rows)
        rows = [self._table(schema, [folder]).withColumn("__at", F.lit(i)) for i, folder in enumerate(segments.rows)]
        dead = [self._table(f"{key} long", [folder]).withColumn("__upto", F.lit(upto)) for folder, upto in segments.dead]
        dead = state.union(dead).groupBy(key).agg(F.max("__upto").alias("__upto")).withColumnRenamed(key, "__dead")
        rows = state.union(rows or [self._table(schema, []).withColumn("__at", F.lit(0))])
        gone = (F.col(key) == F.col("__dead")) & (F.col("__at") < F.col("__upto"))
        return rows.join(F.broadcast(dead) if segments.n_dead <= BROADCAST_ROWS else dead, gone, "left_anti").drop("__at")

    def write(self, df: DataFrame, name: str) -> str:
        """Write a table under a name of its own; returns the folder below the root."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """*df* written once and read again, so that later steps neither recompute it nor call an embedder twice."""
        folder = f"staging/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")

    def clear_stage(self) -> None:
        self._fs.delete(self._path(f"{self.root}/staging"), True)

    def _added(self, old: Segments, name: str, rows: DataFrame, dead: DataFrame, key: str) -> Segments:
        new = Segments(list(old.rows), list(old.dead), old.n_rows, old.n_dead)
        if old.rows and (n := dead.count()):
            new.dead.append([self.write(dead.select(key), f"{name}-dead"), len(old.rows)])
            new.n_dead += n
        if n := rows.count():
            new.rows.append(self.write(rows, name))
            new.n_rows += n
        return new

    def _compact(self, segments: Segments, name: str, schema: str, key: str) -> Segments:
        if segments.n_dead <= COMPACT * max(segments.n_rows, 1) and len(segments.rows) <= SEGMENTS:
            return segments
        folder = self.write(self._live(segments, schema, key), name)
        return Segments([folder], [], self._table(schema, [folder]).count(), 0)

    def commit(self, documents: DataFrame | None, chunks: DataFrame, removed: DataFrame, vectors: DataFrame, last_chunk_id: int) -> Manifest:
        """A new version: these documents (None: as before); *chunks* in the place of those with the same ids or added;
        *removed* (id) without their vectors; *vectors* (chunk_id, vector) added. It is none if nothing changes."""
        old = self.manifest()
        chunks, vectors = chunks.select(*[f.split()[0] for f in state.CHUNKS.split(", ")]), vectors.select("chunk_id", "vector")
        dead = removed.select("id").unionByName(chunks.select("id").where(F.col("id") <= old.last_chunk_id)).distinct()
        new = Manifest(
            old.documents if documents is None else self.write(documents, "documents"),
            self._added(old.chunks, "chunks", chunks, dead, "id"),
            self._added(old.vectors, "vectors", vectors, removed.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id"),
            last_chunk_id,
        )
        if new == old:
            return old
        self._publish(new)
        compact = Manifest(new.documents, self._compact(new.chunks, "chunks", state.CHUNKS, "id"), self._compact(new.vectors, "vectors", state.VECTORS, "chunk_id"), last_chunk_id)
        if compact != new:
            self._publish(compact)
        return compact

    def _publish(self, manifest: Manifest) -> None:
        name = f"manifest-{uuid.uuid4().hex}.json"
        self._write_text(name, json.dumps(asdict(manifest)))
        self._write_text("CURRENT", name)

    def vacuum(self) -> None:
        """Delete what the current version doesn't name; no reader may be on an older one."""
        m, current = self.manifest(), self._read_text("CURRENT")
        named = {p.rpartition("/")[2] for p in [m.documents, *[p for s in (m.chunks, m.vectors) for p in (*s.rows, *(d for d, _ in s.dead))]]}
        data = self._path(f"{self.root}/data")
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if status.getPath().getName() not in named:
                self._fs.delete(status.getPath(), True)
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith("manifest-") and name != current:
                self._fs.delete(status.getPath(), False)
