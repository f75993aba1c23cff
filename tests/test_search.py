import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.operators import ann, embedding, search
from lodestrata.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select((F.col("vec_id") + 1).alias("chunk_id"), F.col("embedding").alias("vector"))


def table(spark, *rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "chunk_id long, vector array<float>")


def test_knn_axes(spark):
    axes = table(spark, (1, [1.0, 0, 0]), (2, [0, 2.0, 0]), (3, [0, 0, 3.0]), (4, [0.0, 0, 0]))
    got = search.knn(axes, [0.9, 0.1, 0.0], 2).collect()
    assert [r["chunk_id"] for r in got] == [1, 4] and got[0]["distance"] < got[1]["distance"]
    assert [r["chunk_id"] for r in search.knn(axes, [0.9, 0.1, 0.0], 9, V.COSINE).collect()] == [1, 2, 3]
    assert search.knn(axes, [1.0, 0, 0], 1).first()["distance"] < 1e-5
    assert search.knn(axes, [1.0, 0, 0], 0).count() == 0
    with pytest.raises(ValueError):
        search.knn(axes, [1.0], 1, dimensions=3)
    with pytest.raises(ValueError):
        V.distance(F.col("vector"), [1.0], "manhattan")


def test_rounding_keeps_the_sign_of_zero(spark):
    values = [-4e-7, 4e-7, -0.0, 0.0, -0.5000005, 0.1234565, 0.25, float("nan"), None]
    made = spark.createDataFrame([(values,), (None,)], "v array<double>").select(V.rounded(F.col("v"), 6)).collect()
    assert repr(made[0][0][:4]) == "[-0.0, 0.0, -0.0, 0.0]" and made[1][0] is None
    want = duckdb.execute("SELECT list_transform(?::DOUBLE[], lambda x: round(x, 6))", [values]).fetchone()[0]
    assert repr(made[0][0]) == repr(want)


def hits(spark, *scores):
    rows = [(i + 1, d, s) for i, (d, s) in enumerate(scores)]
    return spark.createDataFrame(rows, "chunk_id long, document_id long, chunk_score double").withColumn("rank", F.col("chunk_id").cast("int"))


def test_grouping_and_caps(spark):
    found = search.grouped(hits(spark, (42, 0.95), (7, 0.90), (42, 0.85), (9, 0.80)))
    rows = [(r["doc_rank"], r["document_id"], r["doc_score"], r["chunk_rank"]) for r in found.orderBy("doc_rank", "chunk_rank").collect()]
    assert rows == [(1, 42, 0.95, 1), (1, 42, 0.95, 2), (2, 7, 0.9, 1), (3, 9, 0.8, 1)]
    assert sorted(r["document_id"] for r in search.capped(found, 2, 1).collect()) == [7, 42]


def test_orphans_and_missing_rows(spark):
    vectors = table(spark, (1, [1.0, 0.0]), (2, [1.0, 0.1]))
    chunks = spark.createDataFrame([(1, 42, None, None)], "chunk_id long, document_id long, title string, text string")
    documents = spark.createDataFrame([], "document_id long, absolute_path string")
    rows = search.search(vectors, chunks, documents, [1.0, 0.0]).collect()
    assert [(r["document_id"], r["title"], r["text"], r["file_name"], r["absolute_path"]) for r in rows] == [(42, "", "", "", "")]
    # The cut comes before the mapping: an orphan takes its place among the hits.
    assert search.search(vectors, chunks, documents, [1.0, 0.1], fetch=1).count() == 0


@pytest.mark.parametrize("metric,collect", [(V.L2, 9), (V.COSINE, 9), (V.L2, 0), (V.COSINE, 0)])
def test_batch_equals_single(spark, vectors, metric, collect, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 90)
    queries = vectors.where("chunk_id in (3, 77)").withColumnRenamed("chunk_id", "query_id")
    batch = {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["distance"], 6)) for r in search.batch_knn(vectors, queries, 15, metric, collect).collect()}
    for q in queries.collect():
        one = search.ranked(search.knn(vectors, list(q["vector"]), 15, metric)).collect()
        assert {(q["query_id"], r["rank"]): (r["chunk_id"], round(r["distance"], 6)) for r in one} == {k: v for k, v in batch.items() if k[0] == q["query_id"]}


@pytest.mark.parametrize("collect", [99, 0])
def test_batch_of_ties_and_nulls(spark, collect):
    """Equal vectors are kept by id, not all of them; null vectors are near to nothing."""
    rows = spark.createDataFrame([(i, [1.0, float(i % 2)] if i % 5 else None) for i in range(1, 3001)], "chunk_id long, vector array<float>").repartition(1)
    asked = rows.where("chunk_id in (5, 11, 12)").withColumnRenamed("chunk_id", "query_id")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in search.batch_knn(rows, asked, 3, collect=collect).collect()}
    assert got == {(11, 1): 1, (11, 2): 3, (11, 3): 7, (12, 1): 2, (12, 2): 4, (12, 3): 6}


def test_a_task_hands_on_its_nearest(spark, vectors):
    """Not those of each batch or cell: what is shuffled doesn't grow with the vectors."""
    ids, v = (np.array(x) for x in zip(*[(r["chunk_id"], r["vector"]) for r in vectors.orderBy("chunk_id").collect()]))
    unit, zero = search._unit_rows(v, len(v))
    batches = pa.Table.from_pydict({"chunk_id": ids, "vector": v.astype(np.float32).tolist(), "cell": (ids % 20).astype(np.int32)}).to_batches(max_chunksize=50)
    probes = np.tile(np.arange(20), (9, 1))
    want = [[int(i) for i in np.lexsort((ids, np.round(np.sqrt(np.maximum(0, 2 - 2 * unit @ q)), 9)))[:7]] for q in unit[:9]]
    for run in (search._held_against(ids[:9], unit[:9], zero[:9], 7, V.L2), ann._probed(ids[:9], unit[:9], zero[:9], probes, 7, V.L2)):
        out = pa.Table.from_batches(run(iter(batches))).to_pandas()
        assert len(out) == 9 * 7
        assert [out[out.query_id == i].chunk_id.tolist() for i in ids[:9]] == [[int(ids[j]) for j in w] for w in want]


def test_results_do_not_hang_on_partitions(spark, vectors):
    query, seen = list(vectors.where("chunk_id = 5").first()["vector"]), set()
    for n in (1, 4, 37):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(r["chunk_id"] for r in search.knn(vectors.repartition(n), query, 30).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1


def test_knn_of_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [0.0, 1.0])], "chunk_id long, vector array<float>")
    assert [r["chunk_id"] for r in search.knn(rows, [1.0, 0.1], 9).collect()] == [1, 5]
    assert search.knn(rows, [0.0, 0.0], 9, V.COSINE).count() == 0
    with pytest.raises(ValueError):
        search.knn(rows, [1.0, 0.1], 9, "manhattan")


def test_knn_equals_the_expression(spark, vectors):
    query = [float(x) for x in vectors.orderBy("chunk_id").first()["vector"]]
    for metric in (V.L2, V.COSINE):
        want = vectors.select("chunk_id", V.distance(F.col("vector"), query, metric).alias("d")).orderBy(F.round("d", V.ORDER_DIGITS), "chunk_id").limit(50).collect()
        got = search.knn(vectors, query, 50, metric).collect()
        assert [r["chunk_id"] for r in got] == [r["chunk_id"] for r in want]
        assert np.allclose([r["distance"] for r in got], [r["d"] for r in want], atol=1e-6)


def recall(got, v, ids, queries, k=10):
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["chunk_id"])
    v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    at = {i: n for n, i in enumerate(ids)}
    hit = sum(len(found.get(q, set()) & {ids[j] for j in np.argsort(-(v @ v[at[q]]), kind="stable")[:k]}) for q in queries)
    return hit / (k * len(queries))


def test_ann_query_recall(spark):
    v = catalog.vectors(spark, SF).toPandas()
    ids = v["chunk_id"].tolist()
    got = catalog.ann_search(spark, SF)
    assert recall(got, np.array(v["vector"].tolist(), float), ids, [i for i in ids if i % 20 == 0]) >= 0.9


def test_ann_pays_on_clusters(spark, tmp_path):
    """A quarter of the cells, queries in several blocks, a third of all vectors in one cluster."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(60, 32))
    which = np.where(rng.random(6000) < 0.33, 0, rng.integers(0, 60, 6000))
    v = centres[which] + 0.3 * rng.normal(size=(6000, 32))
    table = spark.createDataFrame(pd.DataFrame({"chunk_id": range(1, 6001), "vector": v.tolist()}), "chunk_id long, vector array<float>")
    cells = ann.build(table, str(tmp_path / "ivf"))
    index = spark.read.parquet(str(tmp_path / "ivf"))
    assert len(cells) == 77 and index.count() == 6000
    asked = table.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    ids = list(range(1, 6001))
    for block in (8192, 100):
        assert recall(ann.batch_probe(index, cells, asked, 10, 0.25, block=block), v, ids, ids[19::20]) >= 0.9
    one = ann.probe(index, cells, v[0].tolist(), 10)
    assert one.first()["chunk_id"] == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters")[1][:60]


def test_ann_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long, vector array<float>")
    cells = ann.centroids(none)
    assert ann.batch_probe(ann.assigned(none, cells), cells, none.withColumnRenamed("chunk_id", "query_id"), 3).count() == 0


def test_templates(spark):
    df = spark.createDataFrame([(" ", "body"), ("Guide", "body")], "title string, text string")
    gemma = embedding.model("gemma")
    assert [r[0] for r in df.select(gemma.build_data(F.col("title"), F.col("text"))).collect()] == ["title: none | text: body", "title: Guide | text: body"]
    assert gemma.build_query("q") == "task: search result | query: q" and gemma.build_query("q", "clustering") == "task: clustering | query: q"
    assert embedding.model("nomic").build_query("q") == "search_query: q" and embedding.model("qwen3").build_query("q") == "Instruct: Search for this\nQuery: q"
    assert embedding.model("e5").build_query("q") == "query: q"
    with pytest.raises(ValueError):
        embedding.model("bge").build_query("q", "clustering")
    other = embedding.model("other", 7)
    assert (other.dimensions, other.build_query("q")) == (7, "q")
    with pytest.raises(ValueError):
        other.build_query("q", "t")


def client(*answers, **kw):
    waits, left = [], list(answers)

    def send(body):
        got = left.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    return embedding.HttpEmbedder("http://localhost:1", "m", send=send, sleep=waits.append, **kw), waits


GOOD = (200, b'{"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}')


def test_http_client():
    c, waits = client((500, b"x"), OSError("down"), (429, b""), GOOD)
    assert c.embed_texts(["a", "b"]) == [[1], [2]] and waits == [0.2, 0.4, 0.8]
    assert c.embed_texts([]) == []
    for answers in ([(500, b"x")] * 4, [(400, b"bad")], [(200, b"{")], [(200, b'{"error": "no"}')], [(200, b'{"error": {"message": "no"}}')], [(200, b'{"data": []}')], [(200, b'{"data": [{"index": 9, "embedding": [1]}]}')]):
        c, waits = client(*answers)
        with pytest.raises(embedding.EmbeddingError):
            c.embed_texts(["a"])
    c, _ = client(GOOD, dimensions=3)
    with pytest.raises(embedding.EmbeddingError):
        c.embed_texts(["a", "b"])
    assert embedding.endpoint("http://h:1/") == "http://h:1/v1/embeddings" == embedding.endpoint("http://h:1/v1/embeddings")
    for bad in ("h:1", "", "/v1"):
        with pytest.raises(ValueError):
            embedding.endpoint(bad)
    with pytest.raises(ValueError):
        embedding.HttpEmbedder("http://h", " ")
