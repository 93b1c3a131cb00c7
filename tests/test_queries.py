"""Every registered query against its SQL, value by value, on the smallest tables."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

from __spark_entry__ import entry
from rowdeck.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.sql(f"create view {name} as select * from '{path}'")
    return connection


def same(left, right):
    if isinstance(left, float) and isinstance(right, float):
        return math.isclose(left, right, rel_tol=1e-12, abs_tol=1e-12)
    return left == right


def ordered(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(row[i] for i in places) for row in rows)


@pytest.mark.parametrize("gone", ["rowdeck.llm", "rowdeck.llm.catalog", "corpus_pipeline", "ahocorasick"])
def test_engine_queries_without_the_optional_part(gone):
    """A part or library that cannot be imported takes no other query with it."""
    code = f"""
import sys
sys.modules[{gone!r}] = None
import warnings
warnings.simplefilter("ignore")
import __spark_entry__ as entry
from rowdeck.plans import QUERIES, ORACLES
assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES), sorted(entry.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    wanted = duck.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(wanted.columns)
    got, want = ordered(frame.collect(), frame.columns), ordered(wanted.fetchall(), wanted.columns)
    assert len(got) == len(want)
    assert all(same(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


def test_entry(spark):
    row = entry(spark).first()
    assert row["verdict"] == "passed" and row["multiset_ok"] and row["n"] == row["n_out"]


@pytest.fixture
def small_tasks(monkeypatch):
    """All thresholds at once so low that small tables take the paths of large ones."""
    from rowdeck.operators import balance, ranking, riffle, shuffles, verify
    from rowdeck.sources import positions

    for module, name, value in (
        (ranking, "CELL_ROWS", 16), (ranking, "TASK_ROWS", 8), (ranking, "BLOCK", 5), (riffle, "TASK_SLOTS", 64), (riffle, "SMALL_LANE", 8),
        (riffle, "BROADCAST_LANES", 1), (verify, "CHUNK_ROWS", 64), (positions, "BROADCAST_PARTS", 0), (shuffles, "TOP_LIMIT", 10),
        (balance, "CELL", 16),
    ):
        monkeypatch.setattr(module, name, value)


SCALED = [
    name for name in sorted(QUERIES)
    if any(part in name for part in ("shuffle", "sort", "order", "lane", "riffle", "sample", "exchange", "permutation", "gather", "audit", "number", "inversions", "merge", "moves", "loaded"))
]


@pytest.mark.parametrize("name", SCALED)
def test_large_table_paths_equal_sql(spark, duck, small_tasks, name):
    test_query_equals_sql(spark, duck, name)
