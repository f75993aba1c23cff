"""The corpus pipeline: each stage against what it may do to its own input."""

import corpus_pipeline
import numpy as np
import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import mixing, near_dedup, ordinal, pii, tokens

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        old, new = ({r["doc_id"]: r for r in df.collect()} for df in (before, docs))
        if name != "pack":
            assert docs.columns == columns and set(new) <= set(old)
        if name == "quality":
            model = ordinal.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
            tails = {r["doc_id"]: r["tail_probability"] for r in ordinal.scored(before, model).collect()}
            assert set(new) == {i for i, t in tails.items() if t >= ordinal.TAIL} and 0 < len(new) < len(old)
        elif name == "near_dedup":
            bags = {}
            for i, r in old.items():
                w = "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in r["text"].lower()).split()
                bags[i] = {}
                for p in zip(w, w[1:]) if len(w) > 1 else [tuple(w)] * bool(w):
                    bags[i][p] = bags[i].get(p, 0) + 1

            def similar(a, b):
                low = sum(min(n, bags[b].get(p, 0)) for p, n in bags[a].items())
                return low / max(1, sum(bags[a].values()) + sum(bags[b].values()) - low)

            gone = {r["doc_id"]: r["duplicate_of"] for r in near_dedup.near_duplicates(before).collect()}
            assert set(new) == set(old) - set(gone) and not set(gone.values()) & set(gone)
            left = sorted(new)
            close = sum(similar(a, b) >= near_dedup.THRESHOLD for n, a in enumerate(left) for b in left[n + 1 :])
            assert close <= 0.1 * max(1, len(gone))
        elif name == "pii":
            model = pii.fitted()
            assert set(new) == set(old)
            for i, r in new.items():
                found = model.find(old[i]["text"])
                assert r["text"] == pii.masked(old[i]["text"], found)
                assert r["n_chars"] == (len(r["text"]) if found else old[i]["n_chars"])
        elif name == "mix":
            want = mixing.mixed(before).select("doc_id").collect()
            assert sorted(new) == sorted(r[0] for r in want)
        else:
            totals = docs.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
            counts = {r["doc_id"]: r["n_tokens"] for r in tokens.counted(before).collect()}
            assert {r["doc_id"]: r["n"] for r in totals} == {i: n for i, n in counts.items() if n}
    run = corpus_pipeline.run(spark, SF).toPandas()
    assert len(run) == docs.count() and np.array_equal(np.sort(run["doc_id"]), np.sort(docs.toPandas()["doc_id"]))


@pytest.mark.parametrize("count", [0, 9])
def test_stages_on_awkward_tables(spark, tmp_path, count):
    long = "wide sea " * 250_000  # over 2 MB
    given = [(1, "a plain text on the sea", "en", "a", 23), (1, "a plain text on the sea", "en", "a", 23), (2, None, None, None, None), (3, "", "", "a", 0), (None, "write to jo@mail.example.com", "en", "b", 28), (None, None, None, None, None), (4, long, "en", "a", len(long)), (5, long, "en", None, len(long)), (6, "call +1 (212) 555-0123", "en", "b", 22)]
    docs = spark.createDataFrame(given[:count], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["id", "keys", "tier", "entities", "n_tokens", "__tokens", "__gone", "__pii", "tail_probability", "odd.name", "row"]
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    spark.createDataFrame([(77, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "pack":
            assert bool(count) == (out.count() > 0)
            break
        assert out.columns == docs.columns and out.count() == {"quality": count, "near_dedup": count and count - 1, "pii": count and count - 1}.get(name, out.count())
        docs = out
        if name == "pii" and count:
            assert {r["text"] for r in docs.where("doc_id is null or doc_id = 6").collect()} == {None, "write to [EMAIL]", "call [PHONE]"}


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
