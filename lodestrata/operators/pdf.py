"""Sections from the positioned text runs of PDF pages.

Runs come from any extractor as (document_id, page, x, y, font_size, text, seq).
All steps are aggregations and windows by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

HEADING_RATIO = 1.15
REPEATS = 2
RUNS = "document_id long, page int, x double, y double, font_size double, text string, seq int"


def lines(runs: DataFrame) -> DataFrame:
    """(document_id, page, top, left, font_size, text, seq): runs of a page at the same rounded height, from left to right."""
    run = F.struct("x", "seq", "y", "text")
    got = (
        runs.where(T.trim(F.col("text")) != "")
        .groupBy("document_id", "page", F.round("y").alias("line"))
        .agg(F.array_sort(F.collect_list(run)).alias("runs"), F.greatest(F.max("font_size"), F.lit(0.0)).alias("font_size"), F.min("seq").alias("seq"))
    )
    text = F.array_join(T.nonempty(F.transform("runs", lambda r: r["text"])), " ")
    first = F.col("runs")[0]
    return got.select("document_id", "page", first["y"].alias("top"), first["x"].alias("left"), "font_size", text.alias("text"), "seq")


def strip_repeats(rows: DataFrame) -> DataFrame:
    """Without lines that stand at the same height with the same text more than once, where a document has several pages."""
    doc = Window.partitionBy("document_id")
    same = Window.partitionBy("document_id", F.round("top"), F.lower("text"))
    several = F.coalesce(F.min("page").over(doc) < F.max("page").over(doc), F.lit(False))
    counted = rows.withColumn("__several", several).withColumn("__repeats", F.count("*").over(same))
    return counted.where("not __several or __repeats < 2").drop("__several", "__repeats")


def body_font(rows: DataFrame) -> DataFrame:
    """(document_id, body_font): the rounded size that most characters have; the smallest of those that tie."""
    weight = rows.groupBy("document_id", T.round_font(F.col("font_size")).alias("size")).agg(F.sum(F.length("text")).alias("weight"))
    return weight.groupBy("document_id").agg(F.max(F.struct("weight", (-F.col("size")).alias("size"))).alias("best")).select("document_id", (-F.col("best.size")).alias("body_font"))


def heading_levels(rows: DataFrame) -> DataFrame:
    """(document_id, size, level): rounded sizes of headings, the largest on level 1. The rows are summed up once, by size."""
    doc = Window.partitionBy("document_id")
    sizes = rows.groupBy("document_id", T.round_font(F.col("font_size")).alias("size")).agg(F.sum(F.length("text")).alias("weight"), F.max("font_size").alias("largest"))
    body = -F.max(F.struct("weight", (-F.col("size")).alias("size"))).over(doc)["size"]
    big = sizes.withColumn("body", body).where((F.col("size") > F.col("body")) & (F.col("largest") >= F.col("body") * HEADING_RATIO))
    return big.select("document_id", "size", F.dense_rank().over(doc.orderBy(F.desc("size"))).alias("level"))


def _leveled(rows: DataFrame) -> DataFrame:
    """*rows* with the level of each as in heading_levels(), null for body text, by windows instead of a join."""
    doc = Window.partitionBy("document_id")
    sized = rows.withColumn("__size", T.round_font(F.col("font_size")))
    same = Window.partitionBy("document_id", "__size")
    sized = sized.withColumn("__weight", F.sum(F.length("text")).over(same)).withColumn("__largest", F.max("font_size").over(same))
    body = -F.max(F.struct("__weight", (-F.col("__size")).alias("size"))).over(doc)["size"]
    big = sized.withColumn("__body", body).withColumn("__big", (F.col("__size") > F.col("__body")) & (F.col("__largest") >= F.col("__body") * HEADING_RATIO))
    level = F.dense_rank().over(doc.orderBy(F.desc("__big"), F.desc("__size")))
    return big.withColumn("level", F.when(F.col("__big"), level)).drop("__size", "__weight", "__largest", "__body", "__big")


def sections(runs: DataFrame) -> DataFrame:
    """(document_id, section, path, body) in reading order. The runs are shuffled once, by document, and read once."""
    placed = _leveled(strip_repeats(lines(runs.repartition("document_id"))))
    order = Window.partitionBy("document_id").orderBy("page", F.desc("top"), "left", "seq")
    placed = placed.withColumn("at", F.row_number().over(order)).withColumn("section", F.count("level").over(order))
    part, mark = F.when(F.isnull("level"), F.struct("at", "text")), F.when(F.isnotnull("level"), F.struct("level", "text"))
    each = placed.groupBy("document_id", "section").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.first(mark, ignorenulls=True).alias("mark"))
    body = T.dehyphenate(T.trim(F.array_join(F.transform("parts", lambda p: p["text"]), "\n")))
    whole = each.select("document_id", F.struct("section", "mark", body.alias("body")).alias("s")).groupBy("document_id").agg(F.array_sort(F.collect_list("s")).alias("all"))
    marks = F.transform(F.filter("all", lambda s: s["mark"].isNotNull()), lambda s: s["mark"])
    paths = whole.select("document_id", "all", T.push_headings(marks).alias("paths")).select("document_id", F.explode("all").alias("s"), "paths")
    path = F.when(F.col("s.section") > 0, F.get("paths", F.col("s.section").cast("int") - 1))
    return paths.where("s.body <> ''").select("document_id", "s.section", F.coalesce(path, F.array().cast("array<string>")).alias("path"), "s.body")
