"""Files of a directory tree as a DataFrame, and their contents.

Discovery lists on the executors, a partition for each folder of the top level,
and gives inode and nanosecond times, which the built-in file source doesn't. The
tree has to be on a file system that all executors mount.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T
from . import code

SCHEMA = "absolute_path string, file_id string, file_size long, modified_at_ns long"
FORMATS = {
    "code": tuple(sorted(code.EXTENSIONS)),
    **{name: tuple("." + e for e in endings.split()) for name, endings in (("docx", "docx"), ("pdf", "pdf"), ("markdown", "markdown md mdown"), ("plain", "adoc log org rst text txt"))},
}


def hidden(name: str) -> bool:
    return name.startswith(".") and name not in (".", "..")


def walk(folder: str, include_hidden: bool) -> Iterator[str]:
    """Paths below a folder in lexical order; links to folders aren't followed. An unreadable folder raises."""
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        if hidden(entry.name) and not include_hidden:
            continue
        if entry.is_dir(follow_symlinks=False):
            yield from walk(entry.path, include_hidden)
        else:
            yield entry.path


def described(path: str, follow: bool) -> tuple[str, str, int, int] | None:
    """(path, id, size, time) of a regular file, else None."""
    info = os.stat(path) if follow else os.lstat(path)
    if not stat.S_ISREG(info.st_mode):
        return None
    return path, f"{info.st_dev}:{info.st_ino}", info.st_size, info.st_mtime_ns


class _Folder(InputPartition):
    def __init__(self, paths: list[str], deep: bool):
        self.paths, self.deep = paths, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, include_hidden: bool, follow: bool):
        self.root, self.include_hidden, self.follow = root, include_hidden, follow

    def partitions(self) -> list[InputPartition]:
        entries = [e for e in sorted(os.scandir(self.root), key=lambda e: e.name) if self.include_hidden or not hidden(e.name)]
        folders = [e.path for e in entries if e.is_dir(follow_symlinks=False)]
        files = [e.path for e in entries if not e.is_dir(follow_symlinks=False)]
        return [_Folder([f], True) for f in folders] + [_Folder(files, False)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for path in partition.paths:
            for name in walk(path, self.include_hidden) if partition.deep else [path]:
                if row := described(name, self.follow):
                    yield row


class FileTree(DataSource):
    """spark.read.format("file_tree").options(include_hidden=..., follow_symlinks=...).load(root)"""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        on = lambda key: str(self.options.get(key, "false")).lower() == "true"
        return _Reader(os.path.abspath(self.options["path"]), on("include_hidden"), on("follow_symlinks"))


def format_of(path: Column, formats: dict[str, tuple[str, ...]] = FORMATS) -> Column:
    """The format that claims a path, null if none does; built code bundles aren't claimed."""
    out = F.lit(None).cast("string")
    for name, extensions in reversed(formats.items()):
        claimed = T.extension(path).isin(list(extensions))
        if name == "code":
            claimed = claimed & ~T.has_minified_name(path)
        out = F.when(claimed, name).otherwise(out)
    return out


def discover(spark: SparkSession, root: str, include_hidden: bool = False, follow_symlinks: bool = False, formats: dict[str, tuple[str, ...]] = FORMATS) -> DataFrame:
    """The claimed files below *root*, with their format; of one file under two paths the last counts."""
    spark.dataSource.register(FileTree)
    tree = spark.read.format("file_tree").options(include_hidden=str(include_hidden), follow_symlinks=str(follow_symlinks)).load(os.path.abspath(root))
    claimed = tree.withColumn("format", format_of(F.col("absolute_path"), formats)).where("format is not null")
    row = F.struct("absolute_path", "file_size", "modified_at_ns", "format")
    return claimed.groupBy("file_id").agg(F.max(row).alias("f")).select("f.absolute_path", "file_id", "f.file_size", "f.modified_at_ns", "f.format")


@F.arrow_udf(Y.StructType([Y.StructField("content", Y.BinaryType()), Y.StructField("error", Y.StringType())]))
def _read(path: pa.Array) -> pa.Array:
    contents, errors = [], []
    for p in path.to_pylist():
        try:
            with open(p, "rb") as f:
                contents.append(f.read())
                errors.append(None)
        except OSError as e:
            contents.append(None)
            errors.append(str(e))
    return pa.StructArray.from_arrays([pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names=["content", "error"])


def with_content(files: DataFrame) -> DataFrame:
    """*files* with their bytes as content and, where they can't be read, an error."""
    return files.withColumn("__read", _read.asNondeterministic()(F.col("absolute_path"))).select("*", "__read.*").drop("__read")


@F.arrow_udf(Y.BooleanType())
def _exists(path: pa.Array) -> pa.Array:
    def one(p: str) -> bool:
        try:
            os.stat(p)
            return True
        except FileNotFoundError:
            return False

    return pa.array([one(p) for p in path.to_pylist()], pa.bool_())


def gone(documents: DataFrame) -> DataFrame:
    """Those of *documents* whose file doesn't exist; a path that can't be checked raises and nothing is taken for gone."""
    return documents.where(~_exists.asNondeterministic()(F.col("absolute_path")))
