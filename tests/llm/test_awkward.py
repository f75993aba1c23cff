"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import common, fingerprints, html, mixing, near_dedup, ordinal, packing, pii, rules, secrets, tokens

LONG = " ".join(f"word{i % 997} mail{i}@example.org" if i % 500 == 0 else f"word{i % 997}" for i in range(300_000))  # 2.4 MB, of several slices
ROWS = [
    (1, "A plain text about the sea and the ships on it.", "en", "a", 10),
    (1, "A plain text about the sea and the ships on it.", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "A plain text about the sea and the ships on it.", "en", None, 10),
    (None, None, None, None, None),
    (4, LONG, "en", "b", len(LONG)),
    (5, LONG, "en", "b", len(LONG)),
    (6, " \n\t ", "", "", 4),
    (7, "write to jo@mail.example.com or +1 (212) 555-0123 today", "en", "b", 50),
]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CLASHES = ["id", "same", "keys", "bag", "key", "__key", "__cuts", "__tier", "__score", "__pii", "__tokens", "__stats", "__rule", "__expected", "__tail", "__gone", "bucket", "h", "tokens", "label", "rep", "piece", "shard", "odd.name", "a", "b", "ids", "row", "cuts", "rules",
    # names of results
    "expected_grade", "Tail_Probability", "n_tokens", "rule", "stats", "n_blocks", "n_good", "blocks", "entities", "duplicate_of", "TIER", "bin", "length", "position", "start", "end", "kind", "basis", "class_id", "copy_of", "links", "jaccard"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, None, 1), (None, 1, 0), (4, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


def stands(df, tmp_path, count, passed=()):
    """The result can be written and read again, with so many rows and the values of the input columns *passed* under free names."""
    df.write.parquet(str(tmp_path / "out"))
    back = df.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == count and len({c.lower() for c in back.columns}) == len(back.columns)
    for new, old in passed:
        assert {r[0] for r in back.select(f"`{new}`").collect()} == ({CLASHES.index(old)} if count else set())


def strings(docs):
    return docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_ordinal(docs, none, labels, tmp_path):
    for table in (docs, none):
        for known in (labels, labels.limit(0)):
            model = ordinal.train(table, known)
            out = ordinal.select_documents(table, model)
            assert out.columns == docs.columns and out.count() <= table.count()
            scored = ordinal.scored(table, model)
            assert scored.count() == table.count()
            for r in scored.select("tail_probability", "expected_grade").collect():
                assert 0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2
    everything = ordinal.train(docs, labels.limit(0))
    assert ordinal.select_documents(docs, everything).count() == len(ROWS)
    stands(ordinal.selected(docs, everything), tmp_path, len(ROWS), [("_expected_grade", "expected_grade"), ("_Tail_Probability", "Tail_Probability"), ("odd.name", "odd.name")])
    named = ordinal.train(strings(docs), labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert ordinal.selected(strings(docs), named).count() >= 0
    assert ordinal.select_documents(strings(docs), ordinal.train(strings(docs), labels)).count() == len(ROWS)  # no label has such an id


def test_tokens(docs, none, tmp_path):
    got = rows(tokens.counted(docs), "doc_id", "n_tokens")
    assert len(got) == len(ROWS) and got.count((1, 11)) + got.count((1, 12)) == 2 and (2, 0) in got and (3, 0) in got and (None, 0) in got
    stands(tokens.with_counts(docs), tmp_path, len(ROWS), [("_n_tokens", "n_tokens"), ("__tokens", "__tokens")])
    assert rows(tokens.counted(strings(docs)), "doc_id", "n_tokens")[0][0].startswith("d")
    assert tokens.counted(none).count() == 0


def test_rules(docs, none, labels, tmp_path):
    for table in (docs, none):
        learned = rules.train(table, labels)
        assert rules.judged(table, learned).count() == table.count()
        kept = rules.select_documents(table, learned)
        assert kept.columns == docs.columns
    stands(rules.judged(docs, []), tmp_path, len(ROWS), [("_rule", "rule"), ("_stats", "stats"), ("__stats", "__stats")])
    assert rules.train(strings(docs), labels) == []  # no label has such an id
    assert rules.train(docs, labels.limit(0)) == [] and rules.select_documents(docs, []).count() == len(ROWS)


def test_html(spark, tmp_path):
    long = "<p>the cat is in the house and it was with us there for a while and then it went to the sea.</p>" * 25_000  # 2.4 MB
    pages = [(1, "u", "<p>" + "the cat and the dog are in the house with us " * 6), (1, "u", None), (None, "u", ""), (2, None, "<p>x" * 50_000), (3, "u", "no tags"), (4, "u", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("__extracted", F.lit(1)).withColumn("n_good", F.lit(9)).withColumn("text", F.lit(8)).withColumn("N_BLOCKS", F.lit(7))
    out = html.extracted(df)
    assert rows(out, "page_id", "n_blocks", "n_good") == sorted([(1, 1, 1), (1, 0, 0), (None, 0, 0), (2, 50_000, 0), (3, 1, 1), (4, 25_000, 25_000)], key=repr)
    assert {tuple(r) for r in out.select("_n_good", "_text", "_N_BLOCKS", "__extracted").collect()} == {(9, 8, 7, 1)}
    stands(out, tmp_path, 6)
    assert html.extracted(df.limit(0)).count() == 0


def test_pii(docs, none, tmp_path):
    out = pii.redacted(docs, length_col="n_chars")
    by = {r["doc_id"]: r for r in out.select(*COLUMNS, "entities").collect()}
    assert by[7]["text"] == "write to [EMAIL] or [PHONE] today" and by[7]["n_chars"] == 33
    assert by[2]["text"] is None and by[3]["text"] == "" and by[6]["text"] == " \n\t "
    assert len(by[4]["entities"]) == 600 and by[4]["text"].count("[EMAIL]") == 600 and "@" not in by[4]["text"]
    stands(out, tmp_path, len(ROWS), [("_entities", "entities"), ("__pii", "__pii")])
    assert pii.redacted(none).count() == 0 and pii.redacted(strings(docs)).count() == len(ROWS)


def test_near_dedup(docs, none):
    assert rows(near_dedup.near_duplicates(docs), "doc_id", "duplicate_of") == [(5, 4)]
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS) - 1
    assert rows(near_dedup.near_duplicates(strings(docs)), "doc_id", "duplicate_of") == [("d5", "d4")]
    assert near_dedup.drop_near_duplicates(strings(docs)).count() == len(ROWS) - 1
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.drop_near_duplicates(none).count() == 0


def test_mixing(docs, none, tmp_path):
    everything = mixing.mixed(docs, weights={"a": 1}, total_percent=10_000)
    stands(everything, tmp_path, len(ROWS), [("_TIER", "TIER"), ("__tier", "__tier")])
    assert mixing.mixed(docs, tier_name=None).columns == docs.columns
    some = rows(mixing.mixed(docs), "doc_id", "text")
    assert some.count(ROWS[0][:2]) in (0, 2)  # repeated rows go together
    assert mixing.mixed(none).count() == 0 and mixing.mixed(strings(docs), total_percent=10_000).count() == len(ROWS)
    assert {r["text"] for r in mixing.mixed(docs, default=0, weights={}).collect()} <= {None, ""}  # no budget at all: at most texts without a token
    assert mixing.mixed(docs, tokens_col="n_chars").count() > 0


def test_packing(docs, none):
    want = {}
    for r in tokens.counted(docs).collect():
        if r["n_tokens"]:
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["n_tokens"]
    for table, name in ((docs, lambda i: i), (strings(docs), lambda i: i and f"d{i}")):
        got = {r["doc_id"]: r["n"] for r in packing.packed(table).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
        assert got == {name(i): n for i, n in want.items()}
    assert packing.packed(none).count() == 0
    big = (1 << 60) + 1  # not to be had as a float
    assert {r["doc_id"] for r in packing.packed(docs.select(F.when(F.col("doc_id") > 1, F.lit(big)).alias("doc_id"), "text")).collect()} == {None, big}


def test_secrets(docs, none):
    token = 'api_key = "' + "0123456789abcdef" * 2 + '" '
    extra = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.lit(token)).otherwise(F.col("text"))).withColumn("start", F.lit(0))
    assert rows(secrets.scanned(extra), "doc_id", "start", "kind") == [(1, 11, "raw_key")] * 2
    assert rows(secrets.scanned(strings(extra)), "doc_id") == [("d1",)] * 2
    deep = docs.withColumn("text", F.when(F.col("doc_id") == 4, F.concat("text", F.lit(" " + token), "text")).otherwise(F.col("text")))
    assert rows(secrets.scanned(deep), "doc_id", "start") == [(4, len(LONG) + 12)]
    assert secrets.scanned(docs).count() == 0 and secrets.scanned(none).count() == 0


def test_fingerprints(docs, none):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_classes(docs).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]
    assert {i: r["class_id"] for i, r in got.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    assert (got[5]["copy_of"], got[5]["jaccard"], got[5]["links"]) == (4, 1.0, 0) and got[1]["jaccard"] is None
    assert fingerprints.fingerprint_classes(none).count() == 0
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.fingerprint_classes(strings(docs)).collect()}
    assert got == {f"d{i}": f"d{4 if i == 5 else i}" for i in (1, 2, 3, 4, 5, 6, 7)}


@pytest.mark.parametrize("limit", [2_000_000, -1])
def test_joins_beyond_the_broadcast_limit(docs, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    assert rows(near_dedup.near_duplicates(docs), "doc_id", "duplicate_of") == [(5, 4)]
    assert near_dedup.drop_near_duplicates(docs).count() == len(ROWS) - 1


def test_shared_folder_is_never_local_on_a_cluster(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isEmpty = staticmethod(lambda: True)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
