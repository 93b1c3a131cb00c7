"""Operator 13 against SQL and a plain version."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from rowdeck.llm import op13_exact as exact, shelf

FOLDER = "/root/testdata/sf0.001"


def test_equals_sql(spark):
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    result = connection.sql(exact.SQL)
    frame = exact.query(spark, FOLDER)
    want = sorted(tuple(row[result.columns.index(c)] for c in frame.columns) for row in result.fetchall())
    assert sorted(map(tuple, frame.collect())) == want


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[ \t-\r]+", " ", text or "")].append(doc_id)
    out = []
    for body, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is None, x))
        digest = hashlib.sha256(body.encode()).hexdigest()
        out += [(x, ids[0], len(ids), k == 0, digest) for k, x in enumerate(ids)]
    return sorted(out, key=str)


TEXTS = [None, "", " ", "\t\n ", "a", "a ", "a  b", "a\nb", "a b", "abcdabcd", "abcdabcdabcd", "abcd", "abcdabce", "é😀" * 9, "é😀" * 9 + " ", "x" * 40, "x" * 41, "x" * 120, "x" * 119 + "y", "a b", "\0", "a\0"]


@pytest.mark.parametrize("block, bits, hot", [(8, 64, 1024), (8, 0, 2), (5, 3, 8)])
def test_equals_plain(spark, monkeypatch, block, bits, hot):
    monkeypatch.setattr(shelf, "HOT", hot)
    rows = [(k, text) for k, text in enumerate(TEXTS * 3)] + [(None, "a b"), (None, "only"), (3, "a"), (3, "a"), (4, "a")] + [(100 + k, "one hot text") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact.exact_groups(docs, block, bits).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_edge_tables(spark):
    schema = "doc_id int, text string, row string, block int, name int, n int, i int, level string, times int, print int, head int"
    docs = spark.createDataFrame([(2, "b a", "r", 1, 1, 1, 1, "l", 1, 1, 1), (1, "b\ta", "r", 1, 1, 1, 1, "l", 1, 1, 1)], schema)
    got = sorted(map(tuple, exact.exact_groups(docs, 2).collect()))
    assert [r[:4] for r in got] == [(1, 1, 2, True), (2, 1, 2, False)]
    assert exact.exact_groups(docs.where("false")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = exact.query(spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


def test_replaced_tables_are_deleted(spark):
    docs = spark.createDataFrame([(k, "some text " * k) for k in range(30)], "doc_id long, text string")
    run = shelf.Shelf(spark)
    exact.identified(docs, run, 8).collect()
    path = spark._jvm.org.apache.hadoop.fs.Path(run.folder)
    left = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    assert len(left) == 1
