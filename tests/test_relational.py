import sqlite3
from functools import partial

from lodestrata.sources import relational


def test_sqlite(spark, tmp_path):
    connect = partial(sqlite3.connect, str(tmp_path / "store.db"), timeout=60)
    with connect() as c:
        c.execute("CREATE TABLE documents (id INTEGER PRIMARY KEY, status TEXT, file_size INTEGER)")
    schema = "id long, status string, file_size long"
    assert relational.read(spark, connect, "documents", schema, "id").count() == 0
    first = spark.createDataFrame([(i, "indexed", i * 2) for i in range(1, 1201)], schema)
    relational.upsert(first.coalesce(1), connect, "documents", "id")
    relational.upsert(spark.createDataFrame([(7, "embedded", None), (9000, "indexed", 1)], schema).coalesce(1), connect, "documents", "id")
    relational.delete(spark.createDataFrame([(8,), (12345,)], "id long").coalesce(1), connect, "documents", "id")
    got = {r["id"]: (r["status"], r["file_size"]) for r in relational.read(spark, connect, "documents", schema, "id").collect()}
    assert len(got) == 1200 and got[7] == ("embedded", None) and 8 not in got and got[9000] == ("indexed", 1) and got[1200] == ("indexed", 2400)
