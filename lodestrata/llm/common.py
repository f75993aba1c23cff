"""Helpers shared by the operators: column names, ids, tables in the shared folder, Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that the vectorised operators take at a time; it bounds the
#: memory of a Python worker and never splits a document.
SLICE_BYTES = 1 << 19
BATCH = "4m"
#: Rows up to which a list of ids is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def fresh(df: DataFrame, base: str) -> str:
    """A column name that *df* doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(df: DataFrame, new: Mapping[str, Column], drop: Sequence[str] = ()) -> DataFrame:
    """*df* without the columns *drop* and with *new* after the others. An input column whose name
    is among the new ones (names compare without case) stays under the next free name of the form _name."""
    gone, taken = {c.lower() for c in drop}, {c.lower() for c in [*df.columns, *new]}
    columns = []
    for c in df.columns:
        if c.lower() in gone:
            continue
        name, wanted = c, {n.lower() for n in new}
        while name.lower() in wanted or name != c and name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        columns.append(F.col(f"`{c}`").alias(name))
    return df.select(*columns, *[col.alias(n) for n, col in new.items()])


def id_kind(df: DataFrame, id_col: str) -> str:
    """The type under which ids are compared: bigint where the column is of whole numbers, else string."""
    return "bigint" if isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "string"


def id_of(df: DataFrame, id_col: str, kind: str | None = None) -> Column:
    """The id as that type; null where it can't be cast."""
    return F.col(f"`{id_col}`").try_cast(kind or id_kind(df, id_col))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local
    session, as in tests, gets one of its own where that is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
    if checkpoint.isEmpty():
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
    return checkpoint.get().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """*df* as a Parquet table in the shared folder: it is computed once, and
    a lost executor costs no recomputation of what led to it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that written() made and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few(ids: DataFrame, rows: int) -> DataFrame:
    """*ids* marked for broadcast if its counted *rows* are within BROADCAST_ROWS."""
    return F.broadcast(ids) if rows <= BROADCAST_ROWS else ids


def text_slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first row) of runs of whole texts of about *limit* bytes.

    A null counts as an empty text. Offsets start at 0.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if not n:
        return
    wide = pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    # The bytes aren't copied: only the offsets are widened.
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1, arr.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i
        i = j


def bounded(df: DataFrame) -> None:
    """Let Arrow batches to Python hold BATCH bytes at most, in *df*'s session, unless it was given a bound of its own:
    with many rows of long texts the default of 64 MB is held several times over in the JVM and in each worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) in ("67108864b", "64m", "67108864"):
        conf.set(key, BATCH)


def texts(arr: pa.Array) -> Iterator[str | None]:
    """The texts one by one, so that only one is a Python object at a time."""
    return (x.as_py() for x in arr)


def lower_text(col: Column | str) -> Column:
    return F.lower(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
