import http.client
import io
import os
import sqlite3
import zipfile
from functools import partial

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import ann, embedding, search, state
from lodestrata.plans import seams
from lodestrata.plans import store as store_module
from lodestrata.plans.engine import Engine, IndexFailure, IndexOptions
from lodestrata.plans.store import Store
from lodestrata.sources import relational
from lodestrata.streaming import incremental


def docx(*paragraphs: tuple[str, str]) -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    style = lambda s: f'<w:pPr><w:pStyle w:val="{s}"/></w:pPr>' if s else ""
    body = "".join(f"<w:p>{style(s)}<w:r><w:t>{t}</w:t></w:r></w:p>" for s, t in paragraphs)
    styles = f'<w:styles {ns}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)
    return out.getvalue()


@pytest.fixture()
def corpus(tmp_path):
    root = tmp_path / "files"
    (root / "deep").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / ".hidden" / "no.txt").write_text("never vacation")
    (root / "vacation.txt").write_text("Every employee may take paid vacation days in a year.")
    (root / "billing.md").write_text("# Billing\n\nHow we bill.\n\n## Refunds\n\nAsk for a refund of your payment here.\n")
    (root / "deep" / "loader.go").write_text("package main\n\n// loadConfig reads the config file.\nfunc loadConfig(path string) error {\n\treturn nil\n}\n")
    (root / "handbook.docx").write_bytes(docx(("H1", "Working remote"), ("", "Staff can work remote from home.")))
    (root / "notes.bin").write_text("unclaimed")
    return root


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(Store(spark, str(tmp_path / "store")), embedding.EmbeddingModel("hash", 1024, lambda title, text: F.concat(title, F.lit(" "), text)), embedding.HashingEmbedder(1024))


def test_index_and_search(engine, corpus):
    first = engine.index(str(corpus))
    assert (first.discovered, first.read, first.errors) == (4, 4, [])
    assert first.embedded_chunks == engine.store.vectors().count() == engine.store.chunks().count() == 6
    assert {r["status"] for r in engine.store.documents().collect()} == {"embedded"}
    for query, word in (("paid vacation days", "vacation"), ("refund of payment", "refund"), ("read the config file", "config"), ("work remote from home", "remote")):
        top = engine.search(query).where("doc_rank = 1 and chunk_rank = 1").first()
        assert word in top["text"].lower()
    titles = {r["title"] for r in engine.store.chunks().collect()}
    assert titles == {"vacation", "Billing", "Billing > Refunds", "loader", "loadConfig()", "Working remote"}
    nested = search.nested(engine.search("refund")).collect()
    assert len(nested) == 4 and all(r["chunks"] for r in nested)
    # Nothing new: nothing is read or embedded.
    again = engine.index(str(corpus))
    assert (again.read, again.chunked, again.embedded_chunks) == (0, 0, 0)
    # Touched only: read, but not embedded.
    os.utime(corpus / "vacation.txt", ns=(1, 1))
    touched = engine.index(str(corpus))
    assert (touched.read, touched.embedded_chunks) == (1, 0)
    assert {r["status"] for r in engine.store.documents().collect()} == {"embedded"}
    # One section changes: only its chunk is embedded.
    before = {r["id"] for r in engine.store.chunks().collect()}
    (corpus / "billing.md").write_text("# Billing\n\nHow we bill.\n\n## Refunds\n\nRefunds are paid within two weeks.\n")
    edited = engine.index(str(corpus))
    assert edited.embedded_chunks == 1
    after = {r["id"] for r in engine.store.chunks().collect()}
    assert len(before - after) == len(after - before) == 1 and min(after - before) > max(before)
    assert {r["chunk_id"] for r in engine.store.vectors().collect()} == after
    # A file goes.
    os.remove(corpus / "vacation.txt")
    kept = engine.index(str(corpus), IndexOptions(keep_missing_files=True))
    assert kept.removed_documents == 0 and engine.store.documents().count() == 4
    cleaned = engine.index(str(corpus))
    assert cleaned.removed_documents == 1 and engine.store.documents().count() == 3
    assert engine.store.vectors().count() == engine.store.chunks().count() == 5
    engine.store.vacuum()
    assert engine.search("config").count() == 5


def test_a_run_without_changes_writes_no_table(engine, corpus, tmp_path):
    engine.index(str(corpus))
    tables = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "data").rglob("*.parquet")}
    before, version = tables(), engine.store.manifest()
    engine.index(str(corpus))
    assert tables() == before and engine.store.manifest() == version
    # An edit writes its own chunks only.
    (corpus / "billing.md").write_text("# Billing\n\nHow we bill.\n\n## Refunds\n\nNo.\n")
    engine.index(str(corpus))
    assert len(engine.store.manifest().chunks.rows) == 2
    segment = engine.store._table("id long, text string", engine.store.manifest().chunks.rows[1:])
    assert [r["text"] for r in segment.collect()] == ["No."]
    assert engine.store.chunks().count() == 6


def test_many_versions_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "SEGMENTS", 3)
    store = Store(spark, str(tmp_path / "store"))
    row = lambda i, text: spark.createDataFrame([(i, 1, i, "t", text, 1, 0, 1, "h")], state.CHUNKS)
    none, vector = spark.createDataFrame([], "id long"), lambda i: spark.createDataFrame([(i, [float(i)])], state.VECTORS)
    for i in range(1, 6):
        store.commit(None, row(i, "first"), none, vector(i), i)
        assert len(store.manifest().chunks.rows) <= 3
    store.commit(None, row(2, "second"), spark.createDataFrame([(3,)], "id long"), vector(9).limit(0), 5)
    assert {(r["id"], r["text"]) for r in store.chunks().collect()} == {(1, "first"), (2, "second"), (4, "first"), (5, "first")}
    assert {r["chunk_id"] for r in store.vectors().collect()} == {1, 2, 4, 5}
    store.vacuum()
    assert store.chunks().count() == 4
    store._write_text("CURRENT", "old.json")
    store._write_text("old.json", '{"documents": "", "chunks": ""}')
    with pytest.raises(ValueError, match="layout"):
        store.manifest()


class Tickets:
    """A format of one's own: a ticket for each line."""

    name, extensions = "tickets", (".tickets",)

    def parse(self, read):
        lines = F.split("source", "\n")
        section = lambda x: F.struct(F.array(F.concat(F.lit("Ticket "), F.split(x, " ")[0])).alias("path"), x.alias("body"))
        return read.select("document_id", "absolute_path", F.transform(lines, section).alias("sections"), F.when(F.col("source") == "", "empty").alias("error"))

    def chunk(self, parsed):
        return seams.chunking.chunked(parsed, F.col("sections"), F.lit("ticket"), "plain", ["document_id"])


def test_a_strategy_of_ones_own(spark, tmp_path, corpus):
    (corpus / "open.tickets").write_text("17 printer jams\n18 screen flickers")
    (corpus / "none.tickets").write_text("")
    model, embedder = embedding.EmbeddingModel("hash", 256, lambda title, text: text), embedding.HashingEmbedder(256)
    engine = Engine(Store(spark, str(tmp_path / "store")), model, embedder, strategies=[Tickets(), *seams.built_in({"plain": (".txt",)})])
    report = engine.index(str(corpus))
    assert report.discovered == 3 and [(os.path.basename(p), e) for p, e in report.errors] == [("none.tickets", "empty")]
    assert engine.search("printer jams").first()["title"] == "Ticket 17"
    with pytest.raises(ValueError, match="tickets"):
        Engine(engine.store, model, embedder, strategies=[Tickets(), Tickets()])
    with pytest.raises(ValueError, match="tickets"):
        Engine(engine.store, model, embedder, formats={"tickets": (".tickets",)})


def test_a_splitter_and_a_searcher_of_ones_own(spark, tmp_path, corpus):
    class Last:
        def search(self, vectors, chunks, documents, query, config, metric):
            return chunks.orderBy(F.desc("chunk_id")).limit(config.caps()[0]).select("title")

    engine = Engine(
        Store(spark, str(tmp_path / "store")), embedding.EmbeddingModel("hash", 64, lambda title, text: text), embedding.HashingEmbedder(64), formats={"code": (".go",)}, splitter=lambda source, ending: [([f"whole{ending}"], source)], searcher=Last(),
    )
    engine.index(str(corpus))
    assert [r["title"] for r in engine.search("anything").collect()] == ["whole.go"]


def test_approximate_search_behind_the_engine(engine, corpus, tmp_path):
    engine.index(str(corpus))
    exact = [tuple(r) for r in engine.search("refund of payment").collect()]
    engine.searcher = ann.IvfSearcher(engine.spark, str(tmp_path / "ivf"), share=1.0)
    engine.searcher.build(engine.store.vectors())
    assert [tuple(r) for r in engine.search("refund of payment").collect()] == exact
    engine.searcher = ann.IvfSearcher(engine.spark, str(tmp_path / "ivf"), share=0.5)  # opened again
    assert engine.search("refund of payment").first()["text"] == exact[0][8]


def test_sqlite_behind_the_engine(spark, tmp_path, corpus):
    connect = partial(sqlite3.connect, str(tmp_path / "store.db"), timeout=60)
    engine = Engine(relational.RelationalStore(spark, connect, str(tmp_path / "stage")), embedding.EmbeddingModel("hash", 512, lambda title, text: F.concat(title, F.lit(" "), text)), embedding.HashingEmbedder(512))
    first = engine.index(str(corpus))
    assert first.embedded_chunks == engine.store.chunks().count() == engine.store.vectors().count() == 6
    assert "refund" in engine.search("refund of payment").where("doc_rank = 1 and chunk_rank = 1").first()["text"].lower()
    assert engine.index(str(corpus)).embedded_chunks == 0
    (corpus / "billing.md").write_text("# Billing\n\nHow we bill.\n")
    os.remove(corpus / "vacation.txt")
    changed = engine.index(str(corpus))
    assert (changed.removed_documents, changed.embedded_chunks) == (1, 0)
    assert engine.store.documents().count() == 3 and {r["id"] for r in engine.store.chunks().collect()} == {r["chunk_id"] for r in engine.store.vectors().collect()} and engine.store.chunks().count() == 4
    assert relational.RelationalStore(spark, connect, str(tmp_path / "stage")).documents().count() == 3  # opened again
    with connect() as c:
        c.execute("UPDATE layout SET version = 99")
    with pytest.raises(ValueError, match="layout"):
        relational.RelationalStore(spark, connect, str(tmp_path / "stage"))


def test_dimensions_are_uniform(spark, tmp_path, corpus):
    class Uneven(embedding.HashingEmbedder):
        def embed(self, rows, text):
            return rows.withColumn("vector", F.array_repeat(F.lit(1.0), F.length(text)))

    with pytest.raises(ValueError, match="dimensions"):
        Engine(Store(spark, str(tmp_path / "store")), embedding.EmbeddingModel("hash", 0), Uneven(8)).index(str(corpus))


def test_status_of_no_document(spark):
    documents = spark.createDataFrame([], state.DOCUMENTS)
    with pytest.raises(LookupError, match="not found"):
        state.set_status(documents, 4, state.CHUNKED)


def test_an_answer_that_breaks_off_is_asked_for_again():
    calls = []

    def send(body):
        calls.append(body)
        if len(calls) < 3:
            raise http.client.IncompleteRead(b"")
        return 200, b'{"data": [{"index": 0, "embedding": [1.0]}]}'

    assert embedding.HttpEmbedder("http://host", "m", send=send, sleep=lambda s: None).embed_texts(["x"]) == [[1.0]] and len(calls) == 3


def test_errors_are_reported(engine, corpus):
    (corpus / "broken.docx").write_bytes(b"no archive")
    report = engine.index(str(corpus))
    assert [os.path.basename(p) for p, _ in report.errors] == ["broken.docx"] and report.embedded_chunks == 6
    by_path = {os.path.basename(r["absolute_path"]): r["status"] for r in engine.store.documents().collect()}
    assert by_path["broken.docx"] == "scanned" and by_path["vacation.txt"] == "embedded"
    with pytest.raises(IndexFailure):
        engine.index(str(corpus), IndexOptions(fail_fast=True))


def test_search_rejects(engine, corpus):
    with pytest.raises(ValueError):
        engine.search("  \n")
    with pytest.raises(ValueError):
        search.SearchConfig("x", max_chunks=-1).caps()


def test_config_is_checked(spark, tmp_path):
    store, model, embedder = Store(spark, str(tmp_path / "s")), embedding.model("gemma"), embedding.HashingEmbedder()
    for args in ((store, None, embedder), (store, model, None), (None, model, embedder)):
        with pytest.raises(ValueError):
            Engine(*args)
    with pytest.raises(ValueError):
        Engine(store, model, embedder, formats={})
    with pytest.raises(ValueError, match=".txt"):
        Engine(store, model, embedder, formats={"plain": (".txt",), "markdown": (".TXT",)})


def test_hidden_files_and_links(spark, corpus):
    from lodestrata.sources import files

    names = lambda **kw: sorted(os.path.basename(r["absolute_path"]) for r in files.discover(spark, str(corpus), **kw).collect())
    assert "no.txt" not in names() and "no.txt" in names(include_hidden=True)
    os.symlink(corpus / "vacation.txt", corpus / "zlink.txt")
    os.symlink(corpus / "deep", corpus / "zdeep.txt")
    assert "zlink.txt" not in names()
    followed = names(follow_symlinks=True)
    assert "zlink.txt" in followed and "vacation.txt" not in followed and "zdeep.txt" not in followed


def test_stream_takes_each_file_once(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    put = lambda i, t: spark.createDataFrame([(i, t)], "doc_id long, text string").write.mode("append").parquet(source)
    run = lambda: incremental.run_available(incremental.embedded_stream(spark, source, "doc_id long, text string", "text", "doc_id", 16), sink, checkpoint)
    put(1, "one two")
    run()
    put(2, "three")
    run()
    assert sorted((r["doc_id"], sum(r["vector"])) for r in spark.read.parquet(sink).collect()) == [(1, 2.0), (2, 1.0)]
