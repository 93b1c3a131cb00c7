"""Operators 7, 10 and 6 against plain versions, and their edge cases."""

import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest

from rowdeck.llm import catalog, op06_decontamination as leaks, op07_jaccard as pairs, op10_paragraphs as passages
from rowdeck.llm.common import shingle_set
from rowdeck.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w]


def shingles_of(text, n):
    words = words_of(text)
    return {tuple(words)} if 0 < len(words) < n else {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def roots(links, nodes):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def plain_groups(texts, n, percent):
    sets = {k: shingles_of(text, n) for k, text in texts.items()}
    links = []
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    found = roots(links, sets)
    return {k: (len(sets[k]), found[k]) for k in sets}


def family(rng, size, edits):
    """A base text, copies with up to ``edits`` changed words, and chains of growing copies."""
    base = [f"w{rng.randrange(400)}" for _ in range(size)]
    out = [" ".join(base)] * 3
    for _ in range(25):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    for k in range(6):
        out.append(" ".join(base + [f"y{j}" for j in range(k * size // 20)]))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(k, text, "extra") for k, text in texts.items()], "doc_id long, text string, component_id string")


@pytest.mark.parametrize("n, percent, seed", [(3, 90, 1), (5, 80, 2)])
def test_similar_sets_equal_all_pairs(spark, n, percent, seed):
    rng = random.Random(seed)
    texts = family(rng, 120, 6) + family(rng, 40, 2) + [" ".join(f"z{rng.randrange(50)}" for _ in range(rng.randrange(30))) for _ in range(60)]
    texts += [None, "", " \n\t", "one", "One", "one two", "ONE  two", "é è", "É è"]
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in pairs.similar_sets(frame(spark, texts), n, percent).collect()}
    assert got == plain_groups(texts, n, percent)


def test_hot_shingles_and_few_counts(spark, monkeypatch):
    """Tiles cut by salt, and a table of few common shingles, change nothing."""
    monkeypatch.setattr(pairs, "HOT_ROWS", 4)
    monkeypatch.setattr(pairs, "SALTS", 3)
    rng = random.Random(5)
    texts = family(rng, 100, 8) + family(rng, 100, 8) + family(rng, 30, 3) + [" ".join(f"z{rng.randrange(9)}" for _ in range(20)) for _ in range(20)]
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    for kept in (1 << 18, 40, 0):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in pairs.similar_sets(frame(spark, texts), 3, 90, kept).collect()}
        assert got == plain_groups(texts, 3, 90)


def test_common_shingles_are_counted_in_place():
    """Counting must not hold several copies of the shingles of a task."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 62, 1 << 16).astype(np.uint64)) for _ in range(40)]
    sets += [np.arange(1000, dtype=np.uint64) for _ in range(5)]
    tracemalloc.start()
    try:
        common = pairs.Common()
        for found in sets:
            common.add(found)
        hashes, times = common.most(1 << 15)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert hashes.tolist() == list(range(1000)) and set(times.tolist()) == {5}
    assert peak < 4 * 8 * pairs.HELD


def test_counts_of_cells_come_in_small_rows(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(50))) for k in range(40)], "doc_id long, text string")
    digests = pairs._digests(docs, 3, pairs.CELL_BITS).cache()
    sizes = [len(row.counts) for row in digests.where("slice is not null").select("counts").collect()]
    assert max(sizes) <= 1 << 12
    cells = pairs._cells(digests, pairs.CELL_BITS)
    wanted = np.zeros(1 << pairs.CELL_BITS, np.uint32)
    for row in docs.collect():
        np.add.at(wanted, (shingle_set(row.text, 3) >> np.uint64(64 - pairs.CELL_BITS)).astype(np.int64), 1)
    assert np.array_equal(cells, wanted)


def test_common_shingles(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.zipf(1.3, 200)).astype(np.uint64) for _ in range(300)]
    counts = Counter(int(x) for found in sets for x in found)
    common = pairs.Common()
    monkeypatch.setattr(pairs, "HELD", 1000)
    for found in sets:
        common.add(found)
    hashes, times = common.most(20)
    assert len(hashes) == 20 and all(t <= counts[h] for h, t in zip(hashes.tolist(), times.tolist()))
    assert {h for h, _ in counts.most_common(10)} <= set(hashes.tolist())  # rare ones may be forgotten, common ones not
    monkeypatch.setattr(pairs, "HELD", 1 << 21)
    exact = pairs.Common()
    for found in sets:
        exact.add(found)
    hashes, times = exact.most(1 << 20)
    assert dict(zip(hashes.tolist(), times.tolist())) == {h: t for h, t in counts.items() if t > 1}
    order = np.argsort(hashes)
    assert pairs._ranks(sets[0], hashes[order], times[order]).tolist() == [counts[int(x)] if counts[int(x)] > 1 else 0 for x in sets[0]]


def test_similar_sets_repeated_and_null_ids(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (3, "A b c d e"), (None, "a b c d e"), (9, None)]
    got = pairs.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got.collect()) == sorted([(5, 3, 3), (5, 3, 3), (3, 3, 3), (-1, 3, None), (9, 0, 9)])
    assert pairs.similar_sets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_jaccard_query_equals_sql(spark):
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    want = sorted(connection.sql(catalog.ORACLES["op7_ngram_jaccard_join"]).fetchall())
    assert sorted(map(tuple, pairs.query(spark, FOLDER).collect())) == want


def test_bitmap_never_under_counts():
    rng = np.random.default_rng(1)
    for size in (5, 300, 3000):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], rng.integers(0, 2**63, size).astype(np.uint64)]))
        x, y = pairs._bitmap(a), pairs._bitmap(b)
        differ = sum(bin(int(v)).count("1") for v in (x ^ y).view(np.uint64))
        assert (len(a) + len(b) - differ) / 2 >= len(np.intersect1d(a, b))


def test_bitmap_tells_large_sets_apart():
    """Sets of some thousand shingles at Jaccard 0.8 are told apart at 0.9 before their texts are read."""
    rng = np.random.default_rng(3)
    for size in (1500, 4000):
        both = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, size // 8).astype(np.uint64)])) for _ in range(2))
        differ = np.bitwise_count((pairs._bitmap(a) ^ pairs._bitmap(b)).view(np.uint64)).sum()
        assert (len(a) + len(b) - differ) / 2 < 90 * (len(a) + len(b)) / 190


def test_large_tiles(spark, monkeypatch):
    """Tiles that carry bitmaps into their join, and tiles of two classes, which do not reach it."""
    rng = random.Random(9)
    texts = family(rng, 120, 30) + family(rng, 60, 20) + [f"{k} " + " ".join(f"w{j}" for j in range(30)) for k in range(2)]
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    for large in (2, 64):
        monkeypatch.setattr(pairs, "LARGE", large)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in pairs.similar_sets(frame(spark, texts), 3, 90).collect()}
        assert got == plain_groups(texts, 3, 90)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = roots(real, {x for edge in real for x in edge})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_tiles(document, item, least):
    """Greedy string tiling by looking at every pair of positions."""
    used_d, used_t, covered = set(), set(), 0
    while True:
        best = 0
        for i in range(len(document)):
            for j in range(len(item)):
                k = 0
                while i + k < len(document) and j + k < len(item) and i + k not in used_d and j + k not in used_t and document[i + k] == item[j + k]:
                    k += 1
                best = max(best, k)
        if best < least:
            return covered
        for j in range(len(item) - best + 1):
            for i in range(len(document) - best + 1):
                here, there = set(range(i, i + best)), set(range(j, j + best))
                if not here & used_d and not there & used_t and document[i : i + best] == item[j : j + best]:
                    used_d |= here
                    used_t |= there
                    covered += best


def test_tiles_equal_plain_tiling():
    rng = random.Random(8)
    for _ in range(60):
        item = [rng.randrange(30) for _ in range(rng.randrange(1, 30))]
        cut = rng.randrange(len(item))
        document = [rng.randrange(30) for _ in range(10)] + item[cut:] + [99] + item[:cut] + [rng.choice(item) for _ in range(10)]
        found = leaks.tiles(np.array(document, np.uint64), np.array(item, np.uint64), 3)
        assert sum(x[2] for x in found) == plain_tiles(document, item, 3)


def test_reordered_passages_are_found(spark):
    item = "alpha beta gamma delta epsilon zeta. One two three four five six seven. Red green blue white black brown."
    moved = "Red green blue white black brown. Filler words between. ALPHA beta, gamma delta epsilon zeta! one two three four five six seven"
    documents = [(1, f"Some text {item} more text"), (2, moved), (3, "alpha beta gamma delta something else one two three"), (4, None), (5, ""), (None, item), (1, item)]
    docs = spark.createDataFrame([(a, b, 1.0) for a, b in documents], "doc_id long, text string, coverage double")
    bench = spark.createDataFrame([(7, item), (7, item), (8, "too short"), (None, item), (9, None)], "item_id long, text string")
    got = leaks.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.coverage) for r in got) == [(-1, 7, 1.0), (1, 7, 1.0), (1, 7, 1.0), (2, 7, 1.0)]
    assert leaks.contaminated(docs, bench.where("false")).count() == 0
    assert leaks.contaminated(docs.where("false"), bench).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    whole = sorted(map(tuple, leaks.query(spark, FOLDER).collect()))
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 300)
    assert sorted(map(tuple, leaks.query(spark, FOLDER).collect())) == whole and whole


def test_decontamination_equals_plain(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    bench = [(r.item_id, leaks.WORD.findall(r.text.lower())) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = set()
    for row in docs:
        words = leaks.WORD.findall((row.text or "").lower())
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for item_id, item in bench:
            spots = {p for k in range(len(item) - 4) if tuple(item[k : k + 5]) in grams for p in range(k, k + 5)}
            if len(spots) >= 0.5 * len(item):  # few enough to tile by hand, over the stretches that share a seed
                near = sorted({p for k in range(len(words) - 4) if tuple(words[k : k + 5]) in {tuple(item[q : q + 5]) for q in range(len(item) - 4)} for p in range(k, k + 5)})
                stretch = [w for a, b in zip([None] + near, near) for w in ([None] if a is not None and b > a + 1 else []) + [words[b]]]
                if plain_tiles(stretch, item, 5) >= 0.5 * len(item):
                    want.add((row.doc_id, item_id))
    assert {(r.doc_id, r.item_id) for r in leaks.query(spark, FOLDER).collect()} == want


def test_passages_anywhere_and_near_paragraphs(spark):
    rng = random.Random(3)
    new = lambda n: " ".join(f"q{rng.randrange(10**9)}" for _ in range(n))
    shared, line = new(52), new(60)
    near = line.split()
    near[30] = "changed"
    docs = {1: f"{new(30)} {shared} {new(20)}", 2: f"{new(11)} {shared.upper()} {new(3)}", 3: f"{new(9)}\n{line}\n{new(80)}", 4: f"{new(70)}\n{' '.join(near)}", 5: new(300), 6: None, 7: "", 8: "short line\nshort line", 9: new(40)}
    docs[9] += "\n" + docs[9]  # repeated within one document only
    found = passages.repeated_passages(frame(spark, docs))
    rows = found.collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4}
    assert all(r.keeper_id == {1: 1, 2: 1, 3: 3, 4: 3}[r.doc_id] for r in rows)
    assert all(r.removed == (r.doc_id in (2, 4)) for r in rows)
    result = {r.doc_id: r for r in passages.removals(found).collect()}
    assert result[1].n_removed == 0 and result[2].n_removed >= 1
    start, end = map(int, result[4].spans.split(",")[-1].split(":"))
    assert docs[4][start:end] == " ".join(near) and result[4].keeper_ids == [3]
    assert passages.repeated_passages(frame(spark, docs).where("false")).count() == 0


def test_short_lines_and_short_texts_are_found(spark):
    base = "s1 s2 s3 s4 s5 s6 s7 s8 s9 s10 s11"
    docs = {1: "Yes", 2: "a b c d e f g", 3: f"only one here\n{base}", 4: "yes", 5: "A b  c d e f g", 6: f"\nr1 r2 r3\n{base[:-4]} s10 x y z", 7: f"{base[3:]}\nYES\n", 8: "some other", 9: "x\nx", 10: " \n\n"}
    found = passages.repeated_passages(frame(spark, docs))
    got = {(r.doc_id, docs[r.doc_id][r.first : r.last], r.keeper_id, r.removed) for r in found.collect()}
    assert got == {
        (1, "Yes", 1, False), (4, "yes", 1, True), (7, "YES", 1, True), (2, docs[2], 2, False), (5, docs[5], 2, True),
        (3, base, 3, False), (7, base[3:], 3, True),
    }
    result = {r.doc_id: r.spans for r in passages.removals(found).collect()}
    assert result == {1: "", 2: "", 3: "", 4: "0:3", 5: f"0:{len(docs[5])}", 7: f"0:{len(base) - 3},{len(base) - 2}:{len(base) + 1}"}


def test_windows_extend_to_the_whole_shared_passage(spark):
    rng = random.Random(12)
    new = lambda n: [f"q{rng.randrange(10**9)}" for _ in range(n)]
    docs, want = {}, {}
    for k in range(0, 60, 3):
        shared, wide = new(51 + k), new(20)
        for j, middle in enumerate((shared, wide[:7] + shared + wide[7:], wide[:7] + shared + wide[7:])):  # the third shares more with the second
            before = " ".join(["é"] + new(rng.randrange(1, 30)))
            run = " ".join(middle)
            docs[k + j] = f"{before} {run} {' '.join(new(rng.randrange(1, 30)))}"
            body = run if j != 1 else " ".join(shared)
            start = docs[k + j].index(body)
            want[k + j] = (start, start + len(body))
    found = passages.repeated_passages(frame(spark, docs))
    rows = [r for r in found.collect() if r.is_window and r.removed == (r.doc_id % 3 > 0)]
    got = {k: (min(r.first for r in rows if r.doc_id == k), max(r.last for r in rows if r.doc_id == k)) for k in docs}
    assert got == want
    result = {r.doc_id: r for r in passages.removals(found).collect()}
    for k in docs:
        assert result[k].spans == ("" if k % 3 == 0 else "{}:{}".format(*want[k]))
        if k % 3 == 2:
            assert set(result[k].keeper_ids) == {k - 2, k - 1}


def test_extension_equals_plain(spark):
    rng = random.Random(9)
    seeds = [[f"s{rng.randrange(10**6)}" for _ in range(110)] for _ in range(4)]
    docs = {}
    for k in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            seed = rng.choice(seeds)
            a = rng.randrange(60)
            words += seed[a : a + rng.randrange(47, 110)] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(4))]
        docs[k] = " ".join(words)
    split = {k: text.split() for k, text in docs.items()}
    runs = {}  # of every 47 words, their first place
    for k, words in split.items():
        for i in range(len(words) - 46):
            runs.setdefault(tuple(words[i : i + 47]), (k, i))
    whole = {k: {p for i in range(len(w) - 46) if runs[tuple(w[i : i + 47])][0] < k for p in range(i, i + 47)} for k, w in split.items()}
    for row in passages.removals(passages.repeated_passages(frame(spark, docs)).where("is_window")).collect():
        text = docs[row.doc_id]
        starts = [0]
        for word in split[row.doc_id]:
            starts.append(starts[-1] + len(word) + 1)
        spans = [tuple(map(int, x.split(":"))) for x in row.spans.split(",") if x]
        gone = {p for p, at in enumerate(starts[:-1]) if any(a <= at < b for a, b in spans)}
        assert whole[row.doc_id] <= gone
        for a, b in spans:
            assert a in starts and (b + 1 in starts or b == len(text))


def test_shared_words_equal_plain(spark):
    """What sorted batches share, within and beyond them, against all pairs of rows; in batches of a few rows too."""
    rng = random.Random(21)
    rows = {}
    for k in range(160):
        words = tuple(rng.randrange(2) for _ in range(rng.randrange(1, 9)))
        rows.setdefault(words, (rng.randrange(60), k, 5, rng.random() < 0.8, True, rng.random() < 0.2, rng.randrange(60, 90)))
    prefix = {words: [hash(words[: n + 1]) for n in range(len(words))] for words in rows}
    data = [(*row, prefix[words], [10 * (n + 1) for n in range(len(words))]) for words, row in rows.items()]
    kinds = "doc_id long, first int, cluster_id long, removed boolean, left boolean, source boolean, most long, h array<long>, reach array<int>"
    want = {}
    for words, (doc, first, _, removed, _, source, most) in rows.items():
        for n in range(len(words), 0, -1):
            alike = [row for other, row in rows.items() if other[:n] == words[:n]]
            least, top = min(row[:2] for row in alike), max(row[6] for row in alike)
            if not source and (least < (doc, first) if removed else top > doc):
                want[doc, first] = (10 * n, least[0] if removed else doc)
                break
    state = spark.createDataFrame(data, kinds)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows_each, tasks in ((10000, 1), (10000, 3), (7, 2), (1, 5)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_each)
            met = passages._shared(state.repartitionByRange(tasks, "h").sortWithinPartitions("h"))
            got = {(r.doc_id, r.first): (r.far, r.other) for r in passages._beyond(met).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_every_long_shared_passage_holds_a_common_window():
    rng = random.Random(5)
    for _ in range(200):
        shared = np.array([rng.randrange(2**62) for _ in range(51)], np.uint64)
        sides = [np.concatenate([np.array([rng.randrange(2**62) for _ in range(rng.randrange(40))], np.uint64), shared, np.array([rng.randrange(2**62) for _ in range(rng.randrange(40))], np.uint64)]) for _ in range(2)]
        windows = [{tuple(side[k : k + passages.WINDOW]) for k in passages.anchors(passages.gram_hashes(side, 5), len(side))} for side in sides]
        assert windows[0] & windows[1]


def test_near_paragraphs_equal_all_pairs(spark):
    rng = random.Random(6)
    texts = dict(enumerate(family(rng, 50, 3) + family(rng, 30, 2)))
    got = {r.doc_id: r.keeper_id for r in passages.repeated_passages(frame(spark, texts)).where("not is_window").collect()}
    want = {k: top for k, (_, top) in plain_groups(texts, 5, 80).items()}
    grouped = {k for k in want if sum(v == want[k] for v in want.values()) > 1}
    assert set(got) <= grouped and len(set(got)) >= 0.95 * len(grouped)
    assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)


def test_repeated_rows_and_null_ids_of_passages(spark):
    line = " ".join(f"l{k}" for k in range(30))
    rows = [(4, line), (4, line), (2, f"a b\n{line}"), (None, line), (9, line + "".join(f" x{k}" for k in range(60)))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("not is_window")
    assert sorted((r.doc_id, r.keeper_id, r.removed) for r in found.collect()) == [(2, 2, False), (4, 2, True)]


def test_band_hashes_and_digests_follow_content():
    rng = np.random.default_rng(3)
    for size in (12, 40, 300):
        codes = rng.integers(0, 50, size).astype(np.uint64)
        grams = passages.gram_hashes(codes, 5)
        starts = np.array([0, size // 2]) if size > 12 else np.array([0])
        ends = np.array([size // 3 + 3, size]) if size > 12 else np.array([12])
        bands = passages.band_hashes(grams, starts, ends - 4)
        keys = passages.digests(codes, starts, ends, 0)
        for a, b, band, key in zip(starts, ends, bands, keys):
            alone = codes[a:b]
            low = np.array([(np.unique(passages.gram_hashes(alone, 5)) * seed).min() for seed in passages.SEEDS])
            total = np.arange(passages.BANDS, dtype=np.uint64)
            for k in range(passages.ROWS):
                total = passages.mix(total * passages.BASE + low.reshape(passages.BANDS, passages.ROWS)[:, k])
            assert (band == total).all()
            assert passages.digests(alone, np.array([0]), np.array([len(alone)]), 0)[0] == key
            assert passages.digests(alone, np.array([0]), np.array([len(alone)]), 1)[0] != key


def test_anchors_are_last_smallest_and_powers_are_kept():
    rng = np.random.default_rng(6)
    for size in (0, 5, 23, 24, 27, 28, 60, 300):
        for codes in (rng.integers(0, 2**63, size).astype(np.uint64), rng.integers(0, 3, size).astype(np.uint64)):
            grams = passages.gram_hashes(codes, passages.SHINGLE)
            width = min(passages.WINDOW, len(grams))
            want = {max(range(k, k + width), key=lambda j: (-int(grams[j]), j)) for k in range(len(grams) - width + 1)} if size >= passages.WINDOW else set()
            assert passages.anchors(grams, size).tolist() == sorted(k for k in want if k + passages.WINDOW <= size)
    long = passages._powers(passages.BASE, passages.HELD + 5)
    assert np.array_equal(long[:100], passages._powers(passages.BASE, 100))
    assert np.shares_memory(passages._powers(passages.BASE, 100), passages._powers(passages.BASE, 60))


def test_groups_of_texts_equal_single_texts(monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(9)}é" + rng.choice(["", "", "\n", "\n\n", " \t"]) for _ in range(size)) for size in (0, 3, 24, 0, 26, 27, 28, 29, 300, 0, 5, 90)] + [None, "", " \n "]
    words, ones = passages.Group(texts), [passages.Words(text) for text in texts]
    grams, lines, at = passages.gram_hashes(words.codes, 5), words.paragraphs(), words.bounds
    singles = [passages.anchors(passages.gram_hashes(one.codes, 5), len(one.codes)) + k for one, k in zip(ones, at)]
    assert words.anchors(grams).tolist() == np.concatenate(singles).tolist()
    assert [x.tolist() for x in lines] == [np.concatenate([one.paragraphs()[side] + k for one, k in zip(ones, at)]).tolist() for side in (0, 1)]
    owner = words.owner(np.arange(len(words.codes)))
    assert owner.tolist() == np.repeat(np.arange(len(texts)), [len(one.codes) for one in ones]).tolist()
    assert (words.first - words.bases[owner]).tolist() == np.concatenate([one.first for one in ones]).tolist()
    assert (words.last - words.bases[owner]).tolist() == np.concatenate([one.last for one in ones]).tolist()
    assert passages.Group([None, ""]).anchors(np.empty(0, np.uint64)).size == 0
    monkeypatch.setattr(passages, "GROUP", 5)
    assert list(passages.grouped(["abc", "de", None, "f", "longer one", "", "x"])) == [(0, 3), (3, 4), (4, 5), (5, 7)]
    assert list(passages.grouped([])) == []


def test_stretches_are_put_together_within_a_row():
    rng = random.Random(12)
    rows = [sorted({(a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(7)))}) for _ in range(200)] + [[]]
    first, last = (np.array([cut[side] for cuts in rows for cut in cuts], np.int64) for side in (0, 1))
    row, *ends = passages.merged(first, last, np.concatenate([[0], np.cumsum([len(cuts) for cuts in rows])]))
    for k, cuts in enumerate(rows):
        held = {p for a, b in cuts for p in range(a, b)}
        want = [a for a in sorted(held) if a - 1 not in held]
        got = [(a, b) for n, a, b in zip(row, *ends) if n == k]
        assert [a for a, _ in got] == want and {p for a, b in got for p in range(a, b)} == held
    assert all(len(x) == 0 for x in passages.merged(first[:0], last[:0], np.zeros(3, np.int64)))
