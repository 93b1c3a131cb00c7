"""Operator 11 against SQL and a plain ranking."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from rowdeck.llm import op11_search as search

FOLDER = "/root/testdata/sf0.001"
PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(documents, items, top=10):
    docs = [(i, Counter(words(t)), len(words(t))) for i, t in documents if words(t)]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc_id, counts, size in docs:
            m = 10 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m)) for t in terms if t in counts)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, k + 1, doc_id, -score) for k, (score, _, doc_id) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:top])]
    return sorted(out, key=str)


def test_equals_sql(spark):
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    result = connection.sql(search.SQL)
    frame = search.query(spark, FOLDER)
    want = sorted(tuple(row[result.columns.index(c)] for c in frame.columns) for row in result.fetchall())
    assert sorted(map(tuple, frame.collect())) == want and len(want) > 100


def corpus(seed, docs=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "ñu", "日本", "A1", "x\x80y"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]

    def text(size):
        return "".join(rng.choice([w, w.upper(), w.title()]) + rng.choice([" ", "\n", ", ", "-", "_", "\0"]) for w in rng.choices(vocabulary, weights, k=size))

    rows = [(k, text(rng.randrange(0, 40))) for k in range(docs)]
    items = [(k, text(rng.choice([1, 5, 30, 90]))) for k in range(12)]
    return rows, items


@pytest.mark.parametrize("seed, block, piece, size", [(1, 1 << 16, 1 << 20, 1024), (2, 20, 16, 7)])
def test_equals_plain(spark, monkeypatch, seed, block, piece, size):
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    rows, items = corpus(seed)
    rows += [(None, rows[5][1]), (None, None), (3, rows[3][1]), (3, rows[3][1]), (900, ""), (901, " ,.-\n")]
    items += [(None, "w1 w2"), (50, None), (51, ""), (52, "nowhere at all"), (0, "É w59"), (0, "É w59")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, item_id string, rank int").repartition(4)
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int")
    got = search.ranked(docs, asked).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, items)
    assert (len(list(search.item_blocks(asked))) == 1) == (block > 20)


def test_masks_are_pruned_without_loss():
    rng = np.random.default_rng(4)
    weights = rng.integers(0, 5000, 100)
    asked, best, kept = np.sort(rng.choice(100, 70, replace=False)), [], []
    for round_ in range(30):
        n = rng.integers(1, 60, 50)
        lists = [np.sort(rng.choice(100, rng.integers(0, 30), replace=False)) for _ in range(50)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        terms, counts = np.concatenate(lists).astype(np.int32), rng.integers(1, 5, offsets[-1]).astype(np.int32)
        ids = [int(x) for x in round_ * 50 + rng.permutation(50)]
        part = search.Slice(ids, n.tolist(), offsets, terms, counts, (1500, 45000))
        places = part.places(asked)
        scores = weights[part.present[places]] @ part.parts[places].astype(np.int64)
        kept += [(-int(s), i) for s, i in zip(scores, ids) if s > 0]
        best = search.search_slice(part, asked, weights, best, 10)
        assert best == sorted(kept)[:10]


def test_long_texts_in_pieces(monkeypatch):
    text = ("Ab cd-é " * 40 + "longword" * 30 + " end").encode()
    whole = [w for part in search.term_lists(text) for w in part]
    for piece in (1, 2, 7, 64):
        monkeypatch.setattr(search, "PIECE", piece)
        assert [w for part in search.term_lists(text) for w in part] == whole
    assert [w.decode() for w in whole] == words(text.decode())


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.ranked(docs.where("false"), items).count() == 0
    assert search.ranked(docs, items.where("false")).count() == 0
    assert search.ranked(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
