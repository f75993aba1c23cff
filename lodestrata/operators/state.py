"""The indexing state of documents and chunks: merge, fingerprint, reconcile, delete.

Tables are rewritten set at a time by joins; no row is updated in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INDEXED, SCANNED, CHUNKED, EMBEDDED = "indexed", "scanned", "chunked", "embedded"
STATUSES = (INDEXED, SCANNED, CHUNKED, EMBEDDED)
DOCUMENTS = "id long, file_id string, absolute_path string, file_size long, modified_at_ns long, content_hash string, scanned_file_size long, scanned_modified_at_ns long, status string, embedded_content_hash string"
CHUNKS = "id long, document_id long, chunk_index int, title string, text string, token_count int, start_offset int, end_offset int, content_hash string"
VECTORS = "chunk_id long, vector array<float>"
_ID_BUCKET = "substring(md5(cast({} as string)), 1, 3)"


def with_ids(rows: DataFrame, key: str, start: Column, name: str = "id") -> DataFrame:
    """*rows* with dense ids from *start* + 1, in order of the key's hash bucket and the key.

    A bucket is numbered within itself after what the buckets before it hold, so
    that no window spans all rows. *key* is unique.
    """
    bucketed = rows.withColumn("__bucket", F.expr(_ID_BUCKET.format(key)))
    sizes = bucketed.groupBy("__bucket").agg(F.count("*").alias("__n"))  # 4096 rows at most
    before = sizes.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__bucket").orderBy(key))
    return bucketed.join(F.broadcast(before), "__bucket").withColumn(name, (start + F.col("__before") + at).cast("long")).drop("__bucket", "__before")


def upsert_documents(stored: DataFrame, found: DataFrame) -> DataFrame:
    """*stored* (DOCUMENTS) with what discovery *found* (file_id, absolute_path, file_size, modified_at_ns).

    A new file is indexed under a new id. A known one takes the path, size and
    time found, and is indexed again only if size or time changed. Of a file
    found twice the last path counts. Others stay.
    """
    found = found.groupBy("file_id").agg(F.max(F.struct("absolute_path", "file_size", "modified_at_ns")).alias("f")).select("file_id", "f.*")
    s, d = stored.alias("s"), found.select(F.col("file_id").alias("d_id"), F.col("absolute_path").alias("d_path"), F.col("file_size").alias("d_size"), F.col("modified_at_ns").alias("d_time"))
    both = s.join(d, F.col("s.file_id") == F.col("d_id"), "full_outer")
    changed = ~(F.col("d_size").eqNullSafe(F.col("s.file_size")) & F.col("d_time").eqNullSafe(F.col("s.modified_at_ns")))
    status = F.when(F.col("s.file_id").isNull(), INDEXED).when(F.col("d_id").isNull(), F.col("s.status")).when(changed, INDEXED).otherwise(F.col("s.status"))
    merged = both.select(
        F.col("s.id").alias("id"),
        F.coalesce("s.file_id", "d_id").alias("file_id"),
        F.coalesce("d_path", "s.absolute_path").alias("absolute_path"),
        F.coalesce("d_size", "s.file_size").alias("file_size"),
        F.coalesce("d_time", "s.modified_at_ns").alias("modified_at_ns"),
        *[F.col(f"s.{c}") for c in ("content_hash", "scanned_file_size", "scanned_modified_at_ns")],
        status.alias("status"),
        F.col("s.embedded_content_hash"),
    )
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    fresh = with_ids(merged.where("id is null").drop("id").crossJoin(F.broadcast(last)), "file_id", F.col("__last")).drop("__last")
    return merged.where("id is not null").unionByName(fresh)


def documents_by_status(documents: DataFrame, status: str, after_id: int = 0, limit: int | None = None) -> DataFrame:
    """Documents of a status in order of id, after one of them: a page if *limit* is given."""
    rows = documents.where((F.col("status") == status) & (F.col("id") > after_id)).orderBy("id")
    return rows if limit is None else rows.limit(limit)


def documents_from_id(documents: DataFrame, from_id: int = 0, limit: int | None = None) -> DataFrame:
    rows = documents.where(F.col("id") > from_id).select("id", "absolute_path").orderBy("id")
    return rows if limit is None else rows.limit(limit)


def by_ids(table: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """Point lookup; the list is the caller's and is pushed to the scan."""
    return table.where(F.col(key).isin(ids)) if ids else table.limit(0)


def chunks_of(chunks: DataFrame, document_id: int) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy("chunk_index")


def unread(documents: DataFrame) -> Column:
    """Whether an indexed document has to be read: its size or time isn't that of its last scan, or it has no hash."""
    same = F.col("content_hash").isNotNull() & F.col("scanned_file_size").eqNullSafe(F.col("file_size")) & F.col("scanned_modified_at_ns").eqNullSafe(F.col("modified_at_ns"))
    return (F.col("status") == INDEXED) & ~same


def fingerprinted(documents: DataFrame, hashes: DataFrame) -> DataFrame:
    """Indexed *documents* moved on by the *hashes* (id, hash) of what was read.

    Unchanged by size and time: scanned. Content equal to what is embedded (and
    to what was last chunked): embedded again. Else scanned, with the new hash.
    Without a hash an unread document stays indexed.
    """
    both = documents.join(hashes.select(F.col("id").alias("__id"), F.col("hash").alias("__hash")), F.col("id") == F.col("__id"), "left")
    indexed, read = F.col("status") == INDEXED, unread(documents)
    back = F.coalesce(F.col("embedded_content_hash"), F.lit("")) != ""
    back = back & (F.col("__hash") == F.col("embedded_content_hash")) & (F.col("content_hash").eqNullSafe(F.col("__hash")))
    new = indexed & read & F.col("__hash").isNotNull()
    status = F.when(indexed & ~read, SCANNED).when(new & back, EMBEDDED).when(new, SCANNED).otherwise(F.col("status"))
    moved = (indexed & ~read) | new
    columns = {
        "content_hash": F.when(new, F.col("__hash")).otherwise(F.col("content_hash")),
        "scanned_file_size": F.when(moved, F.col("file_size")).otherwise(F.col("scanned_file_size")),
        "scanned_modified_at_ns": F.when(moved, F.col("modified_at_ns")).otherwise(F.col("scanned_modified_at_ns")),
        "status": status,
    }
    return both.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in documents.columns])


def reconcile(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What becomes of each chunk: (action, id, document_id, and the incoming columns).

    Chunks of a document with equal hashes are matched one by one in order of
    their index. A match keeps its id and takes the rest from *incoming*; others
    are inserted (id null) or removed. An existing id of 0 is never removed.
    """
    order = Window.partitionBy("document_id", "content_hash")
    old = existing.withColumn("occurrence", F.row_number().over(order.orderBy("chunk_index", "id"))).select("document_id", "content_hash", "occurrence", "id", F.lit(True).alias("__old"))
    new = incoming.withColumn("occurrence", F.row_number().over(order.orderBy("chunk_index"))).withColumn("__new", F.lit(True))
    both = old.join(new, ["document_id", "content_hash", "occurrence"], "full_outer")
    action = F.when(F.col("__new").isNull(), "remove").when(F.col("__old").isNull(), "insert").otherwise("keep")
    rest = [c for c in incoming.columns if c not in ("document_id", "content_hash", "id")]
    out = both.select(action.alias("action"), "id", "document_id", *rest, "content_hash")
    return out.where((F.col("action") != "remove") | (F.col("id") != 0))


def applied(plan: DataFrame, last_id: Column | int = 0) -> DataFrame:
    """The chunks after a plan: kept ones under their ids, inserted ones under new ids after *last_id*."""
    start = F.lit(last_id) if isinstance(last_id, int) else last_id
    new = plan.where("action = 'insert'").withColumn("__key", F.format_string("%019d/%010d", F.col("document_id"), F.col("chunk_index"))).drop("id")
    return plan.where("action = 'keep'").drop("action").unionByName(with_ids(new, "__key", start).drop("__key", "action"))


def chunks_to_embed(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector: what was inserted, and what an earlier failure left."""
    return chunks.join(vectors.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def check_vectors(vectors: DataFrame, dimensions: int) -> None:
    """Raise if an id is 0 or a vector isn't of *dimensions*."""
    wrong = vectors.where((F.col("chunk_id") == 0) | F.col("chunk_id").isNull() | (F.coalesce(F.size("vector"), F.lit(-1)) != dimensions)).limit(1)
    for row in wrong.collect():
        raise ValueError(f"chunk {row['chunk_id']} has no id or not {dimensions} dimensions")


def replace_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """*stored* with *new* in the place of those of the same chunk."""
    return stored.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def delete_vectors(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """*stored* without the chunks in *ids* (chunk_id)."""
    return stored.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def missing(documents: DataFrame, present: DataFrame) -> DataFrame:
    """Documents whose path isn't *present* (absolute_path)."""
    return documents.join(present.select("absolute_path"), "absolute_path", "left_anti")


def delete_documents(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents in *gone* (id), their chunks and those chunks' vectors."""
    ids = gone.select("id")
    dead = chunks.join(ids.withColumnRenamed("id", "document_id"), "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return documents.join(ids, "id", "left_anti"), chunks.join(ids.withColumnRenamed("id", "document_id"), "document_id", "left_anti"), delete_vectors(vectors, dead)


def with_status(documents: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """*documents* with a new status for those in *ids* (id); embedding also notes the hash."""
    if status not in STATUSES:
        raise ValueError(f"no such status: {status}")
    hit = documents.join(ids.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left")
    mine = F.col("__id").isNotNull()
    columns = {"status": F.when(mine, status).otherwise(F.col("status"))}
    if status == EMBEDDED:
        columns["embedded_content_hash"] = F.when(mine, F.col("content_hash")).otherwise(F.col("embedded_content_hash"))
    return hit.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in documents.columns])


def set_status(documents: DataFrame, document_id: int, status: str) -> DataFrame:
    """with_status() of one document, which must be there."""
    if documents.where(F.col("id") == document_id).isEmpty():
        raise LookupError(f"document {document_id} not found")
    return with_status(documents, documents.where(F.col("id") == document_id).select("id"), status)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
