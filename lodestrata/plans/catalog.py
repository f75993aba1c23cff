"""The library's operators as queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import text as T
from ..functions import vectors as V
from ..operators import ann, chunking, embedding, pdf, search, state
from ..sources import parsers
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle:
            _oracle[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)


# ---- inputs ----------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ids from 1, since 0 names none."""
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("chunk_id"), F.col("embedding").alias("vector"))


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for every vector but those of label 9, which are orphans; a document for every fifty ids."""
    e = table(spark, sf_dir, "embeddings").where("label <> 9")
    chunk = F.col("vec_id") + 1
    return e.select(chunk.alias("chunk_id"), (F.col("vec_id") % 50).alias("document_id"), F.concat(F.lit("label "), "label").alias("title"), F.concat(F.lit("vector "), chunk).alias("text"))


def vector_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_chunks(spark, sf_dir).select("document_id").distinct().select("document_id", F.concat(F.lit("/corpus/part-"), "document_id", F.lit(".md")).alias("absolute_path"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query: one row by key."""
    return list(vectors(spark, sf_dir).where("chunk_id = 1").first()["vector"])


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files may hold them: a byte-order mark, carriage returns, blank lines between the lines."""
    raw = F.concat(F.lit("﻿"), F.regexp_replace("text", "\n", "\r\n \t\r\n"), F.lit("\r\r\n\n \t\n"))
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), "text", "source")


_RAW = "chr(65279) || replace(text, chr(10), chr(13) || chr(10) || ' ' || chr(9) || chr(13) || chr(10)) || chr(13) || chr(13) || chr(10) || chr(10) || ' ' || chr(9) || chr(10)"
_RAW_CTE = f"raw_texts AS (SELECT doc_id, {_RAW} AS raw, text, source FROM documents)"
_CHUNKS = "vchunks AS (SELECT vec_id + 1 AS chunk_id, vec_id % 50 AS document_id, 'label ' || label AS title, 'vector ' || (vec_id + 1) AS text FROM embeddings WHERE label <> 9)"
_UNITS = f"units AS (SELECT vec_id + 1 AS chunk_id, {sql.unit('embedding')} AS u FROM embeddings), q AS (SELECT u AS qu FROM units WHERE chunk_id = 1)"
_L2_SQL = "sqrt(greatest(0, 2 - 2 * list_dot_product(u, qu)))"
_COS_SQL = "1 - list_dot_product(u, qu)"


def _hits(metric: str, k: int) -> str:
    return f"{_UNITS}, d AS (SELECT chunk_id, {metric} AS distance FROM units, q), hits AS (SELECT chunk_id, distance, row_number() OVER (ORDER BY round(distance, 9), chunk_id) AS rank FROM d QUALIFY rank <= {k})"


_GROUPS = f"""{_hits(_L2_SQL, 4096)}, {_CHUNKS},
scored AS (SELECT h.*, c.document_id, 1 - h.distance / 2 AS chunk_score FROM hits h JOIN vchunks c USING (chunk_id)),
ranked AS (SELECT *, min(rank) OVER (PARTITION BY document_id) AS best, max(chunk_score) OVER (PARTITION BY document_id) AS doc_score, row_number() OVER (PARTITION BY document_id ORDER BY rank) AS chunk_rank FROM scored WHERE chunk_score >= {{least}}),
groups AS (SELECT *, dense_rank() OVER (ORDER BY best) AS doc_rank FROM ranked)"""
_all_groups = "WITH " + _GROUPS.replace("{least}", "-1")
_six = lambda *c: [F.round(x, 6).alias(x) for x in c]

# ---- vectors and search ----------------------------------------------------


@query(f"SELECT vec_id AS chunk_id, {sql.each(sql.unit('embedding'), lambda x: f'round({x}, 6)')} AS vector FROM embeddings")
def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), V.rounded(V.normalized(F.col("embedding")), 6).alias("vector"))


def _knn(metric: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(search.knn(vectors(spark, sf_dir), first_vector(spark, sf_dir), 20, metric))


@query(f"WITH {_hits(_L2_SQL, 20)} SELECT chunk_id, round(distance, 6) AS distance, rank::INT AS rank FROM hits")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors: a top-k report."""
    return _knn(V.L2, spark, sf_dir).select("chunk_id", *_six("distance"), "rank")


@query(f"WITH {_hits(_COS_SQL, 20)} SELECT chunk_id, round(distance, 6) AS distance, rank::INT AS rank FROM hits")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(V.COSINE, spark, sf_dir).select("chunk_id", *_six("distance"), "rank")


@query(f"WITH {_UNITS} SELECT chunk_id, round(1 - {_L2_SQL} / 2, 6) AS score FROM units, q")
def relevance_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.distance(F.col("vector"), first_vector(spark, sf_dir), V.L2)
    return vectors(spark, sf_dir).select("chunk_id", F.round(V.relevance(d), 6).alias("score"))


@query(f"WITH {_UNITS} SELECT chunk_id, round(1 - ({_COS_SQL}) / 2, 6) AS score FROM units, q")
def relevance_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.distance(F.col("vector"), first_vector(spark, sf_dir), V.COSINE)
    return vectors(spark, sf_dir).select("chunk_id", F.round(V.relevance(d), 6).alias("score"))


def _groups(spark: SparkSession, sf_dir: str, least: float = -1.0) -> DataFrame:
    hits = search.ranked(search.knn(vectors(spark, sf_dir), first_vector(spark, sf_dir), search.FETCH))
    return search.grouped(search.relevant(search.mapped(hits, vector_chunks(spark, sf_dir)), least))


def _group_columns(df: DataFrame) -> DataFrame:
    return df.select("doc_rank", "document_id", *_six("doc_score"), "chunk_rank", "chunk_id", *_six("chunk_score"))


_GROUP_COLUMNS = "doc_rank::INT AS doc_rank, document_id, round(doc_score, 6) AS doc_score, chunk_rank::INT AS chunk_rank, chunk_id, round(chunk_score, 6) AS chunk_score"


@query("WITH " + _GROUPS.replace("{least}", "0.4") + f" SELECT {_GROUP_COLUMNS} FROM groups")
def search_min_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group_columns(_groups(spark, sf_dir, 0.4))


@query(f"{_all_groups} SELECT {_GROUP_COLUMNS} FROM groups")
def group_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group_columns(_groups(spark, sf_dir))


@query(f"{_all_groups} SELECT {_GROUP_COLUMNS} FROM groups WHERE chunk_rank <= 3")
def cap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group_columns(_groups(spark, sf_dir).where("chunk_rank <= 3"))


@query(f"{_all_groups} SELECT {_GROUP_COLUMNS} FROM groups WHERE doc_rank <= 20")
def cap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group_columns(_groups(spark, sf_dir).where("doc_rank <= 20"))


@query(
    f"{_all_groups} SELECT doc_rank::INT AS doc_rank, document_id, 'part-' || document_id || '.md' AS file_name, '/corpus/part-' || document_id || '.md' AS absolute_path, round(doc_score, 6) AS doc_score,"
    " chunk_rank::INT AS chunk_rank, chunk_id, c.title, c.text, round(chunk_score, 6) AS chunk_score FROM groups g JOIN vchunks c USING (chunk_id, document_id) WHERE doc_rank <= 20 AND chunk_rank <= 3"
)
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the 20 best documents of one query with their 3 best chunks each."""
    found = search.search(vectors(spark, sf_dir), vector_chunks(spark, sf_dir), vector_documents(spark, sf_dir), first_vector(spark, sf_dir))
    return found.withColumn("doc_score", F.round("doc_score", 6)).withColumn("chunk_score", F.round("chunk_score", 6))


@query(
    f"{_all_groups}, docs AS (SELECT doc_rank::INT AS doc_rank, document_id, any_value(round(doc_score, 6)) AS doc_score, list(chunk_id ORDER BY chunk_rank) AS chunks FROM groups WHERE doc_rank <= 20 AND chunk_rank <= 3 GROUP BY ALL) SELECT * FROM docs"
)
def search_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = search.nested(search.search(vectors(spark, sf_dir), vector_chunks(spark, sf_dir), vector_documents(spark, sf_dir), first_vector(spark, sf_dir)))
    return nested.select("doc_rank", "document_id", F.round("doc_score", 6).alias("doc_score"), F.transform("chunks", lambda c: c["chunk_id"]).alias("chunks"))


@query(f"WITH {_UNITS}, d AS (SELECT a.chunk_id AS query_id, b.chunk_id, sqrt(greatest(0, 2 - 2 * list_dot_product(a.u, b.u))) AS distance FROM units a, units b) SELECT query_id, chunk_id, round(distance, 5) AS distance, (row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id))::INT AS rank FROM d QUALIFY rank <= 10")
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query against all vectors, the ten nearest of each."""
    v = vectors(spark, sf_dir)
    return search.batch_knn(v, v.withColumnRenamed("chunk_id", "query_id"), 10).select("query_id", "chunk_id", F.round("distance", 5).alias("distance"), "rank")


#: Of the cells: the test vectors have no clusters.
ANN_SHARE = 0.75


@query()
def ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: of every vector whose id is divisible by 20 the ten nearest in its nearest cells, against all
    vectors. Its recall is held against the exact search in the tests."""
    v = vectors(spark, sf_dir)
    cells = ann.centroids(v)
    asked = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    return ann.batch_probe(ann.assigned(v, cells), cells, asked, 10, ANN_SHARE).select("query_id", "chunk_id", F.round("distance", 5).alias("distance"), "rank")


_NEW_VECTORS = "fresh AS (SELECT vec_id + 1 AS chunk_id, list_reverse(embedding) AS vector FROM embeddings WHERE label = 3 UNION ALL SELECT vec_id + 1000001, embedding FROM embeddings WHERE label = 4)"


@query(f"WITH {_NEW_VECTORS} SELECT * FROM fresh UNION ALL SELECT vec_id + 1, embedding FROM embeddings WHERE vec_id + 1 NOT IN (SELECT chunk_id FROM fresh)")
def vector_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label written anew, those of another written as new chunks."""
    e = table(spark, sf_dir, "embeddings")
    changed = e.where("label = 3").select((F.col("vec_id") + 1).alias("chunk_id"), F.reverse("embedding").alias("vector"))
    added = e.where("label = 4").select((F.col("vec_id") + 1000001).alias("chunk_id"), F.col("embedding").alias("vector"))
    return state.replace_vectors(vectors(spark, sf_dir), changed.unionByName(added))


@query("SELECT vec_id + 1 AS chunk_id, embedding AS vector FROM embeddings WHERE label <> 5")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = table(spark, sf_dir, "embeddings").where("label = 5").select((F.col("vec_id") + 1).alias("chunk_id"))
    return state.delete_vectors(vectors(spark, sf_dir), dead)


# ---- text ------------------------------------------------------------------


@query(f"WITH {_RAW_CTE} SELECT doc_id, md5({sql.normalize('raw')}) AS normalized, length({sql.normalize('raw')})::INT AS n FROM raw_texts")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_texts(spark, sf_dir).select("doc_id", T.normalize_text(F.col("raw")).alias("t")).select("doc_id", F.md5(F.col("t")).alias("normalized"), F.length("t").alias("n"))


@query(f"SELECT doc_id, {sql.tokens('text')} AS tokens FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("SELECT page_id, sha256(html) AS hash FROM pages")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.content_hash(F.col("html")).alias("hash"))


def _list_query(name: str, oracle: str, column: Callable) -> None:
    """A query of a text function that gives an array: its size and the hash of its joined elements."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = raw_texts(spark, sf_dir).select("doc_id", column(F.col("raw")).alias("l"))
        return got.select("doc_id", F.size("l").alias("n"), F.md5(F.array_join("l", "|")).alias("parts"))

    run.__name__ = name
    query(f"WITH {_RAW_CTE}, l AS (SELECT doc_id, {oracle} AS l FROM raw_texts) SELECT doc_id, len(l)::INT AS n, md5(coalesce(array_to_string(l, '|'), '')) AS parts FROM l")(run)


_list_query("nonempty_lines", sql.nonempty(sql.lines("raw")), T.nonempty_lines)
_list_query("split_paragraphs", sql.paragraphs(sql.normalize("raw")), lambda c: T.split_paragraphs(T.normalize_text(c)))
_list_query("split_sentences", sql.sentences("raw"), T.split_sentences)
_list_query("hard_window", sql.windows("raw", "97"), lambda c: T.hard_window(c, 97))
_list_query("pack_sentences", sql.prose("raw", "64"), lambda c: chunking.prose(c, F.lit(64)))


@query(f"WITH {_RAW_CTE} SELECT doc_id, {sql.tail('raw', 200)} AS tail, {sql.tail('text', 37)} AS short FROM raw_texts")
def tail_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_texts(spark, sf_dir).select("doc_id", T.tail_text(F.col("raw"), 200).alias("tail"), T.tail_text(F.col("text"), 37).alias("short"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '\.[^.]*$', '') AS title, lower(regexp_extract(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '\.[^.]*$')) AS extension FROM pages")
def file_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.file_title(F.col("url")).alias("title"), T.extension(F.col("url")).alias("extension"))


@query(r"SELECT doc_id, md5(regexp_replace(replace(text, 'e', 'e-' || chr(10)), '(\p{L})-\n(\p{Ll})', '\1\2', 'g')) AS whole FROM documents")
def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.replace("text", F.lit("e"), F.lit("e-\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.dehyphenate(broken)).alias("whole"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: length(l) > 5000)) > 0 AS minified FROM documents")
def guard_minified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.is_minified(F.col("text")).alias("minified"))


@query("SELECT conv_id, turn, len(list_filter(string_split(role || chr(10) || replace(text, ' ', chr(10)) || chr(10) || 'DO NOT EDIT', chr(10))[1:8], lambda l: regexp_matches(lower(l), '@generated|auto-?generated|code generated|do not edit'))) > 0 AS generated FROM conversations")
def guard_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.concat("role", F.lit("\n"), F.replace("text", F.lit(" "), F.lit("\n")), F.lit("\nDO NOT EDIT"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_generated(c).alias("generated"))


_TURNS = "SELECT conv_id, turn, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS level, role || ' ' || turn AS heading FROM conversations"


@query(
    f"WITH t AS ({_TURNS}), marks AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, heading) AS i FROM t),"
    " up AS (SELECT a.conv_id, a.i, b.heading, b.i AS bi FROM marks a JOIN marks b ON a.conv_id = b.conv_id AND b.i <= a.i WHERE NOT EXISTS (SELECT 1 FROM marks c WHERE c.conv_id = a.conv_id AND c.i > b.i AND c.i <= a.i AND c.level <= b.level))"
    " SELECT conv_id, i::INT AS i, string_agg(heading, ' > ' ORDER BY bi) AS path FROM up GROUP BY conv_id, i"
)
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as headings: a turn's level is its role's."""
    level = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    mark = F.struct("turn", F.concat("role", F.lit(" "), "turn").alias("text"), level.alias("level"))
    marks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(mark)).alias("marks"))
    paths = T.push_headings(F.transform("marks", lambda m: F.struct(m["level"].alias("level"), m["text"].alias("text"))))
    return marks.select("conv_id", F.posexplode(paths).alias("i", "path")).select("conv_id", (F.col("i") + 1).alias("i"), F.array_join("path", " > ").alias("path"))


# ---- chunks ----------------------------------------------------------------

_TITLE_TOKENS = sql.tokens("source")
_CHUNKED = f"""WITH {_RAW_CTE}, budgeted AS (SELECT *, greatest(32, 350 - {_TITLE_TOKENS}) AS budget FROM raw_texts),
packed AS (SELECT doc_id, source, {sql.pack(sql.paragraphs(sql.normalize('raw')), "chr(10) || chr(10)", 'budget', 50, sql.prose)} AS texts FROM budgeted),
chunks AS (SELECT doc_id, source AS title, unnest(texts) AS text, unnest(range(0, len(texts))) AS chunk_index FROM packed),
placed AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS upto FROM chunks)"""


def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_plain_text(raw_texts(spark, sf_dir), "raw", F.col("source"), ["doc_id"])


@query(f"{_CHUNKED} SELECT doc_id, chunk_index::INT AS chunk_index, title, text, {sql.tokens('text')} AS token_count, (upto - length(text))::INT AS start_offset, upto::INT AS end_offset, sha256(title || chr(10) || text) AS content_hash FROM placed")
def chunk_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_chunks(spark, sf_dir)


@query(f"{_CHUNKED} SELECT doc_id, count(*) AS chunks, max(upto)::INT AS characters, sum({sql.tokens('text')})::BIGINT AS tokens FROM placed GROUP BY doc_id")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("end_offset").alias("characters"), F.sum("token_count").alias("tokens"))


_TURN_TITLE = "'Conversation ' || conv_id || ' > ' || role || ' ' || turn"


@query(
    f"WITH t AS (SELECT conv_id, turn, {_TURN_TITLE} AS title, {sql.nonempty(sql.paragraphs(sql.normalize('text')))} AS parts FROM conversations), b AS (SELECT *, greatest(32, 350 - {sql.tokens('title')}) AS budget FROM t),"
    f" packed AS (SELECT conv_id, turn, title, {sql.pack('parts', 'chr(10) || chr(10)', 'budget', 50, sql.prose)} AS texts FROM b), flat AS (SELECT conv_id, turn, title, unnest(texts) AS text, unnest(range(0, len(texts))) AS k FROM packed),"
    " placed AS (SELECT *, row_number() OVER w - 1 AS chunk_index, sum(length(text)) OVER w AS upto FROM flat WINDOW w AS (PARTITION BY conv_id ORDER BY turn, title, k ROWS UNBOUNDED PRECEDING))"
    f" SELECT conv_id, chunk_index::INT AS chunk_index, title, text, {sql.tokens('text')} AS token_count, (upto - length(text))::INT AS start_offset, upto::INT AS end_offset, sha256(title || chr(10) || text) AS content_hash FROM placed"
)
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown: a heading for each, one below it for each turn."""
    turn = F.struct("turn", F.concat(F.lit("## "), "role", F.lit(" "), "turn", F.lit("\n\n"), "text").alias("t"))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    source = T.normalize_text(F.concat(F.lit("# Conversation "), "conv_id", F.lit("\n\n"), F.array_join(F.transform("turns", lambda x: x["t"]), "\n\n")))
    parsed = docs.select("conv_id", parsers.markdown_sections(source).alias("sections"))
    return chunking.chunked(parsed, F.col("sections"), F.lit(""), "markdown", ["conv_id"])


@query()
def code_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dressed up as Python functions of a class, their lines as comments."""
    body = F.concat(F.lit("class Doc:\n    def text(self):\n        # "), F.replace("text", F.lit("\n"), F.lit("\n        # ")), F.lit("\n        return 1\n\ndef last():\n    return 2\n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", parsers.code_sections(parsers.kept_code(T.normalize_text(body)), F.lit(".py")).alias("sections"))
    return chunking.chunked(docs, F.col("sections"), F.lit("doc"), "code", ["doc_id"])  # null sections have no chunks; a filter would find them all twice


@F.arrow_udf(Y.BinaryType())
def _docx(title: pa.Array, text: pa.Array) -> pa.Array:
    """Small DOCX files of a heading and a paragraph for each line."""
    space, out = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', []
    for head, body in zip(title.to_pylist(), text.to_pylist()):
        lines = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in body.split("\n"))
        heading = f'<w:p><w:pPr><w:outlineLvl w:val="0"/></w:pPr><w:r><w:t>{escape(head)}</w:t></w:r></w:p>'
        file = io.BytesIO()
        with zipfile.ZipFile(file, "w") as z:
            z.writestr("word/document.xml", f"<w:document {space}><w:body>{heading}{lines}</w:body></w:document>")
        out.append(file.getvalue())
    return pa.array(out, pa.binary())


@query(
    f"WITH parts AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda l: {sql.trim('l')}), lambda l: l <> '') AS parts FROM documents), b AS (SELECT *, greatest(32, 350 - {_TITLE_TOKENS}) AS budget FROM parts),"
    f" packed AS (SELECT doc_id, source, {sql.pack('parts', 'chr(10) || chr(10)', 'budget', 50, sql.prose)} AS texts FROM b)"
    " SELECT doc_id, chunk_index::INT AS chunk_index, source AS title, sha256(source || chr(10) || text) AS content_hash FROM (SELECT doc_id, source, unnest(texts) AS text, unnest(range(0, len(texts))) AS chunk_index FROM packed)"
)
def docx_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made DOCX files, a paragraph for each line, and chunked from these."""
    made = table(spark, sf_dir, "documents").select("doc_id", "source", _docx(F.col("source"), F.col("text")).alias("content"))
    parsed = made.select("doc_id", "source", parsers.docx_sections(F.col("content"))["sections"].alias("sections"))
    return chunking.chunked(parsed, F.col("sections"), F.lit(""), "docx", ["doc_id"]).select("doc_id", "chunk_index", "title", "content_hash")


# ---- embedding -------------------------------------------------------------


@query(
    "SELECT conv_id, turn, 'title: ' || CASE WHEN trim(role) = '' THEN 'none' ELSE trim(role) END || ' | text: ' || text AS gemma, 'search_document: ' || text AS nomic, 'passage: ' || text AS e5, text AS bge, text AS mxbai, text AS qwen3 FROM conversations"
)
def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [m.build_data(F.col("role"), F.col("text")).alias(k) for k, m in embedding.MODELS.items()]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *made)


_FNV = "list_reduce(range(1, octet_length(encode(w)) + 1), lambda h, i: (xor(h, ('0x' || hex(encode(w)[i:i]))::UBIGINT) * 16777619) % 4294967296, 2166136261::UBIGINT)"


@query(
    f"WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')) AS w FROM conversations), d AS (SELECT DISTINCT w FROM w), h AS (SELECT w, ({_FNV}) % 1024 AS bucket FROM d)"
    " SELECT conv_id, turn, bucket::BIGINT AS bucket, count(*) AS n FROM w JOIN h USING (w) GROUP BY ALL"
)
def hashing_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.hashing_terms(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], F.col("text"))


@query()
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a query for the three chunks of documents nearest to it, by the hashing embedder."""
    chunks = plain_chunks(spark, sf_dir).withColumn("chunk_id", F.col("doc_id") * 10000 + F.col("chunk_index"))
    embedder = embedding.HashingEmbedder(256)
    stored = embedder.embed(chunks.select("chunk_id", "text"), F.col("text")).select("chunk_id", "vector")
    asked = embedder.embed(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), F.col("text")).select("query_id", "vector")
    return search.batch_knn(stored, asked, 3).select("query_id", "chunk_id", F.round("distance", 5).alias("distance"), "rank")


# ---- PDF -------------------------------------------------------------------

# Lines of documents as runs: two to a line, ten lines to a page; the first line of a page is a title in a larger
# font, and a running head repeats on every page.
_RUNS = """l AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
runs AS (SELECT document_id, (i // 10)::INT AS page, 10.0::DOUBLE AS x, 700.0::DOUBLE - 12 * (i % 10) AS y, (CASE WHEN i % 10 = 0 THEN 16.0 WHEN i % 7 = 3 THEN 13.2 ELSE 10.1 END)::DOUBLE AS font_size, line AS text, (i * 2)::INT AS seq FROM l
 UNION ALL SELECT document_id, (i // 10)::INT, 5.0, 700.3 - 12 * (i % 10), 9.0, ' * ', (i * 2 + 1)::INT FROM l
 UNION ALL SELECT DISTINCT document_id, (i // 10)::INT, 10.0, 780.0, 8.0, 'Running HEAD', -1 FROM l)"""
_LINES = f"""{_RUNS}, pdf_lines AS (SELECT document_id, page, arg_min(y, (x, seq)) AS top, min(x) AS "left", max(font_size) AS font_size, string_agg({sql.trim('text')}, ' ' ORDER BY x, seq) AS text, min(seq) AS seq FROM runs WHERE {sql.trim('text')} <> '' GROUP BY document_id, page, round(y))"""
_KEPT = f"""{_LINES}, kept AS (SELECT * FROM pdf_lines QUALIFY len(list(DISTINCT page) OVER (PARTITION BY document_id)) < 2 OR count(*) OVER (PARTITION BY document_id, round(top), lower(text)) < 2)"""
_FONT = f"""{_KEPT}, sizes AS (SELECT document_id, round(font_size * 2) / 2 AS size, sum(length(text)) AS weight FROM kept GROUP BY ALL), fonts AS (SELECT document_id, arg_max(size, (weight, -size)) AS body_font FROM sizes GROUP BY document_id)"""


def pdf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    page, y = F.floor(F.col("i") / 10).cast("int"), 700.0 - 12 * (F.col("i") % 10)
    size = F.when(F.col("i") % 10 == 0, 16.0).when(F.col("i") % 7 == 3, 13.2).otherwise(10.1)
    main = lines.select("document_id", page.alias("page"), F.lit(10.0).alias("x"), y.alias("y"), size.alias("font_size"), F.col("line").alias("text"), (F.col("i") * 2).alias("seq"))
    marks = lines.select("document_id", page.alias("page"), F.lit(5.0).alias("x"), (y + 0.3).alias("y"), F.lit(9.0).alias("font_size"), F.lit(" * ").alias("text"), (F.col("i") * 2 + 1).alias("seq"))
    heads = lines.select("document_id", page.alias("page")).distinct().select("document_id", "page", F.lit(10.0).alias("x"), F.lit(780.0).alias("y"), F.lit(8.0).alias("font_size"), F.lit("Running HEAD").alias("text"), F.lit(-1).alias("seq"))
    return state.union([main, marks, heads])


@query(f'WITH {_LINES} SELECT document_id, page, round(top, 3) AS top, "left", font_size, text FROM pdf_lines')
def pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.lines(pdf_runs(spark, sf_dir)).select("document_id", "page", F.round("top", 3).alias("top"), "left", "font_size", "text")


@query(f"WITH {_KEPT} SELECT document_id, page, round(top, 3) AS top, text FROM kept")
def pdf_strip_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.strip_repeats(pdf.lines(pdf_runs(spark, sf_dir))).select("document_id", "page", F.round("top", 3).alias("top"), "text")


@query(f"WITH {_FONT} SELECT * FROM fonts")
def pdf_body_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.body_font(pdf.strip_repeats(pdf.lines(pdf_runs(spark, sf_dir))))


@query(f"WITH {_FONT}, big AS (SELECT DISTINCT document_id, round(font_size * 2) / 2 AS size FROM kept JOIN fonts USING (document_id) WHERE round(font_size * 2) / 2 > body_font AND font_size >= body_font * 1.15) SELECT document_id, size, (dense_rank() OVER (PARTITION BY document_id ORDER BY size DESC))::INT AS level FROM big")
def pdf_heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.heading_levels(pdf.strip_repeats(pdf.lines(pdf_runs(spark, sf_dir))))


_BIG = "big AS (SELECT DISTINCT document_id, round(font_size * 2) / 2 AS size FROM kept JOIN fonts USING (document_id) WHERE round(font_size * 2) / 2 > body_font AND font_size >= body_font * 1.15), levels AS (SELECT document_id, size, dense_rank() OVER (PARTITION BY document_id ORDER BY size DESC) AS level FROM big)"
_BODY = r"regexp_replace(regexp_replace(string_agg(text, chr(10) ORDER BY spot), '^\s+|\s+\z', '', 'g'), '(\p{L})-\n(\p{Ll})', '\1\2', 'g')"


@query(
    f"""WITH {_FONT}, {_BIG}, spots AS (SELECT k.*, l.level, row_number() OVER w AS spot, count(l.level) OVER w AS section FROM kept k LEFT JOIN levels l ON k.document_id = l.document_id AND l.size = round(k.font_size * 2) / 2 WINDOW w AS (PARTITION BY k.document_id ORDER BY page, top DESC, "left", seq ROWS UNBOUNDED PRECEDING)),
 bodies AS (SELECT document_id, section, {_BODY} AS body FROM spots WHERE level IS NULL GROUP BY document_id, section), marks AS (SELECT document_id, section, level, text FROM spots WHERE level IS NOT NULL),
 paths AS (SELECT a.document_id, a.section, list(b.text ORDER BY b.section) AS path FROM marks a JOIN marks b ON a.document_id = b.document_id AND b.section <= a.section WHERE NOT EXISTS (SELECT 1 FROM marks c WHERE c.document_id = a.document_id AND c.section > b.section AND c.section <= a.section AND c.level <= b.level) GROUP BY ALL)
 SELECT document_id, section, coalesce(path, []) AS path, body FROM bodies LEFT JOIN paths USING (document_id, section) WHERE body <> ''"""
)
def pdf_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.sections(pdf_runs(spark, sf_dir))


# ---- indexing state --------------------------------------------------------

# The store knows the documents that aren't French; discovery sees those that aren't Spanish, longer ones changed.
_STORED = "stored AS (SELECT doc_id + 1 AS id, 'f' || doc_id AS file_id, '/c/' || doc_id || '.txt' AS absolute_path, n_chars AS file_size, doc_id * 1000 AS modified_at_ns, sha256(text) AS content_hash, n_chars AS scanned_file_size, doc_id * 1000 AS scanned_modified_at_ns, CASE source WHEN 'src1' THEN 'scanned' WHEN 'src2' THEN 'chunked' ELSE 'embedded' END AS status, sha256(text) AS embedded_content_hash FROM documents WHERE lang <> 'fr')"
_FOUND = "found AS (SELECT 'f' || doc_id AS file_id, '/moved/' || doc_id || '.txt' AS absolute_path, n_chars + CASE WHEN n_chars > 2000 THEN 7 ELSE 0 END AS file_size, doc_id * 1000 AS modified_at_ns FROM documents WHERE lang <> 'es')"


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = F.sha2("text", 256)
    status = F.when(F.col("source") == "src1", "scanned").when(F.col("source") == "src2", "chunked").otherwise("embedded")
    time = F.col("doc_id") * 1000
    return table(spark, sf_dir, "documents").where("lang <> 'fr'").select(
        (F.col("doc_id") + 1).alias("id"), F.concat(F.lit("f"), "doc_id").alias("file_id"), F.concat(F.lit("/c/"), "doc_id", F.lit(".txt")).alias("absolute_path"), F.col("n_chars").alias("file_size"), time.alias("modified_at_ns"), hashed.alias("content_hash"),
        F.col("n_chars").alias("scanned_file_size"), time.alias("scanned_modified_at_ns"), status.alias("status"), hashed.alias("embedded_content_hash"),
    )


def found_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("n_chars") + F.when(F.col("n_chars") > 2000, 7).otherwise(0)
    return table(spark, sf_dir, "documents").where("lang <> 'es'").select(F.concat(F.lit("f"), "doc_id").alias("file_id"), F.concat(F.lit("/moved/"), "doc_id", F.lit(".txt")).alias("absolute_path"), size.alias("file_size"), (F.col("doc_id") * 1000).alias("modified_at_ns"))


@query(
    f"WITH {_STORED}, {_FOUND}, m AS (SELECT s.id, coalesce(s.file_id, f.file_id) AS file_id, coalesce(f.absolute_path, s.absolute_path) AS absolute_path, coalesce(f.file_size, s.file_size) AS file_size, coalesce(f.modified_at_ns, s.modified_at_ns) AS modified_at_ns, s.content_hash, s.scanned_file_size, s.scanned_modified_at_ns,"
    " CASE WHEN s.id IS NULL THEN 'indexed' WHEN f.file_id IS NOT NULL AND (f.file_size <> s.file_size OR f.modified_at_ns <> s.modified_at_ns) THEN 'indexed' ELSE s.status END AS status, s.embedded_content_hash FROM stored s FULL JOIN found f ON s.file_id = f.file_id)"
    " SELECT coalesce(id, (SELECT max(id) FROM stored) + row_number() OVER (PARTITION BY id IS NULL ORDER BY substr(md5(file_id), 1, 3), file_id)) AS id, * EXCLUDE (id) FROM m"
)
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.upsert_documents(stored_documents(spark, sf_dir), found_files(spark, sf_dir))


# All are indexed again. English ones are as scanned; of the others German ones hold new content.
_INDEXED = "again AS (SELECT * REPLACE (CASE WHEN lang = 'en' THEN scanned_file_size ELSE NULL END AS scanned_file_size, 'indexed' AS status), lang, text FROM stored JOIN (SELECT doc_id + 1 AS id, lang, text FROM documents) USING (id))"


@query(
    f"WITH {_STORED}, {_INDEXED}, h AS (SELECT *, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS hash FROM again)"
    " SELECT id, CASE WHEN lang = 'en' THEN content_hash ELSE hash END AS content_hash, file_size AS scanned_file_size, CASE WHEN lang <> 'en' AND hash = embedded_content_hash THEN 'embedded' ELSE 'scanned' END AS status FROM h"
)
def fingerprint_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"), "lang", "text")
    again = stored_documents(spark, sf_dir).join(docs.select("id", "lang"), "id").withColumn("scanned_file_size", F.when(F.col("lang") == "en", F.col("scanned_file_size"))).withColumn("status", F.lit(state.INDEXED)).drop("lang")
    content = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    moved = state.fingerprinted(again, docs.select("id", T.content_hash(content).alias("hash")))
    return moved.select("id", "content_hash", "scanned_file_size", "status")


@query(f"WITH {_STORED} SELECT id, file_id, absolute_path, status FROM stored WHERE status = 'chunked' AND id > 0")
def documents_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.documents_by_status(stored_documents(spark, sf_dir), state.CHUNKED).select("id", "file_id", "absolute_path", "status")


@query(f"WITH {_STORED} SELECT id, absolute_path FROM stored WHERE id > 100 ORDER BY id LIMIT 500")
def documents_from_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the keyset scan."""
    return state.documents_from_id(stored_documents(spark, sf_dir), 100, 500)


@query(f"WITH {_STORED} SELECT id, absolute_path, status FROM stored WHERE id IN (3, 5, 8, 13, 1000000)")
def documents_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups: an id that isn't there gives no row."""
    return state.by_ids(stored_documents(spark, sf_dir), [3, 5, 8, 13, 1000000]).select("id", "absolute_path", "status")


@query("SELECT turn::INT AS chunk_index, role AS title, text FROM conversations WHERE conv_id = 1")
def chunks_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("chunk_index"), F.col("role").alias("title"), "text")
    return state.chunks_of(chunks, 1).drop("document_id")


@query(f"WITH {_CHUNKS} SELECT chunk_id, document_id, title, text FROM vchunks WHERE chunk_id IN (SELECT vec_id FROM embeddings WHERE label = 2)")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and texts of the chunks in a table of ids."""
    ids = table(spark, sf_dir, "embeddings").where("label = 2").select(F.col("vec_id").alias("chunk_id"))
    return vector_chunks(spark, sf_dir).join(ids, "chunk_id", "left_semi")


# Chunks are the turns. Before, the user's turns read otherwise and there were no turns of the system; every
# conversation held its first turn twice.
_OLD_CHUNKS = "old AS (SELECT conv_id * 100 + turn + 1 AS id, conv_id AS document_id, turn::INT AS chunk_index, sha256(CASE WHEN role = 'user' AND turn > 1 THEN 'old ' || text ELSE text END) AS content_hash FROM conversations UNION ALL SELECT conv_id * 100 + 99, conv_id, 99, sha256(text) FROM conversations WHERE turn = 0)"
_NEW_CHUNKS = "fresh AS (SELECT conv_id AS document_id, turn::INT AS chunk_index, text, sha256(text) AS content_hash FROM conversations)"
_PLAN = f"""{_OLD_CHUNKS}, {_NEW_CHUNKS}, o AS (SELECT *, row_number() OVER (PARTITION BY document_id, content_hash ORDER BY chunk_index, id) AS k FROM old), n AS (SELECT *, row_number() OVER (PARTITION BY document_id, content_hash ORDER BY chunk_index) AS k FROM fresh),
plan AS (SELECT CASE WHEN n.document_id IS NULL THEN 'remove' WHEN o.document_id IS NULL THEN 'insert' ELSE 'keep' END AS action, o.id, coalesce(o.document_id, n.document_id) AS document_id, n.chunk_index, n.text, coalesce(o.content_hash, n.content_hash) AS content_hash FROM o FULL JOIN n ON o.document_id = n.document_id AND o.content_hash = n.content_hash AND o.k = n.k)"""


def old_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    text = F.when((F.col("role") == "user") & (F.col("turn") > 1), F.concat(F.lit("old "), "text")).otherwise(F.col("text"))
    one = c.select((F.col("conv_id") * 100 + F.col("turn") + 1).alias("id"), F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("chunk_index"), F.sha2(text, 256).alias("content_hash"))
    twice = c.where("turn = 0").select((F.col("conv_id") * 100 + 99).alias("id"), F.col("conv_id").alias("document_id"), F.lit(99).alias("chunk_index"), F.sha2("text", 256).alias("content_hash"))
    return one.unionByName(twice)


def new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("chunk_index"), "text", F.sha2("text", 256).alias("content_hash"))


@query(f"WITH {_PLAN} SELECT * FROM plan")
def reconcile_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.reconcile(old_chunks(spark, sf_dir), new_chunks(spark, sf_dir))


@query(f"WITH {_PLAN} SELECT coalesce(id, 1000000000 + row_number() OVER (PARTITION BY action ORDER BY substr(md5(printf('%019d/%010d', document_id, chunk_index)), 1, 3), printf('%019d/%010d', document_id, chunk_index))) AS id, document_id, chunk_index, text, content_hash FROM plan WHERE action <> 'remove'")
def apply_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.applied(state.reconcile(old_chunks(spark, sf_dir), new_chunks(spark, sf_dir)), F.lit(1000000000))


@query(f"WITH {_OLD_CHUNKS} SELECT id, document_id FROM old WHERE id NOT IN (SELECT conv_id * 100 + turn + 1 FROM conversations WHERE role <> 'assistant')")
def chunks_to_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "conversations").where("role <> 'assistant'").select((F.col("conv_id") * 100 + F.col("turn") + 1).alias("chunk_id"))
    return state.chunks_to_embed(old_chunks(spark, sf_dir), have).select("id", "document_id")


@query(f"WITH {_STORED}, {_FOUND} SELECT id, file_id FROM stored WHERE file_id NOT IN (SELECT file_id FROM found)")
def cleanup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = found_files(spark, sf_dir).select(F.concat(F.lit("/c/"), F.substring("file_id", 2, 100), F.lit(".txt")).alias("absolute_path"))
    return state.missing(stored_documents(spark, sf_dir), present).select("id", "file_id")


@query(
    f"WITH {_STORED}, {_OLD_CHUNKS}, gone AS (SELECT id FROM stored WHERE status = 'chunked')"
    " SELECT 'document' AS kind, id FROM stored WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'chunk', id FROM old WHERE document_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'vector', id FROM old WHERE document_id NOT IN (SELECT id FROM gone)"
)
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks = stored_documents(spark, sf_dir), old_chunks(spark, sf_dir)
    left = state.delete_documents(docs, chunks, chunks.select(F.col("id").alias("chunk_id")), docs.where("status = 'chunked'"))
    return state.union([df.select(F.lit(kind).alias("kind"), F.col(key).alias("id")) for df, kind, key in zip(left, ("document", "chunk", "vector"), ("id", "id", "chunk_id"))])
