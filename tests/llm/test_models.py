"""Operators 3, 5 and 8, held-out quality, and the pipeline against a plain version."""

import hashlib
import math
import random
import re
import weakref
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from rowdeck.llm import common, op03_pii as pii, op05_toxicity as toxicity, op06_decontamination as leaks, op07_jaccard as pairs, op08_ordinal as ordinal, op09_sentencepiece as pieces

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def auc(scores, labels):
    good, bad = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    got = toxicity.toxicity(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect())
    assert auc([r.score for r in rows], [r.toxic for r in rows]) > 0.8
    clean = [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    flipped = labels.selectExpr("doc_id", "case when crc32(string(doc_id)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    same = toxicity.toxicity(docs, flipped)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, got.collect()))


def test_toxicity_edge_cases(spark):
    rows = [(1, None, 0.0), (2, "", 0.0), (None, "some text", 0.0), (4, "x" * 50000, 0.0), (4, "x" * 50000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, none).collect()] == [0.0] * 5
    some = spark.createDataFrame([(2, 1), (4, 0), (4, 0), (8, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, some).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.toxicity(docs.where("false"), some).count() == 0


def test_ftrl_finds_the_sign_words():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(100, 5000, 60)) for _ in range(400)]
    labels = (rng.random(400) < 0.3).astype(float)
    rows = [np.unique(np.append(row, [1, 2][int(rng.integers(2))])) if y else row for row, y in zip(rows, labels)]
    weights, _ = toxicity.fit_ftrl(rows, labels)
    assert set(np.argsort(-weights)[:2].tolist()) == {1, 2} and (weights == 0).mean() > 0.99


def test_ordinal_grades(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rated = labels.selectExpr("doc_id", "case when quality = 0 then 0 when toxic = 1 then 1 else 2 end as grade")
    got = ordinal.graded(docs, rated.where("doc_id % 3 <> 0")).join(rated, "doc_id").where("doc_id % 3 = 0").collect()
    assert auc([r.tail for r in got], [r.grade > 0 for r in got]) > 0.9
    good = [r for r in got if r.grade]
    assert sum(r.selected for r in good) >= 0.95 * len(good)
    assert all(0 <= r.expected_grade <= 2 and r.tail >= r.expected_grade / 2 - 1e-9 for r in got)


def test_rating_features_with_and_without_weights(monkeypatch):
    """Leaving ids without weight out early changes no score, nor does reading a text in pieces."""
    rng = random.Random(3)
    texts = [None, "", "a", "one two two two two three", "A1! A1! b\n\nb\nx", "w" * 9000, "é" * 50 + " \x0b y"]
    texts += [" ".join(rng.choice(["alpha", "beta", "Gamma!", "x1", "delta."]) + str(rng.randrange(3000)) for _ in range(rng.randrange(300))) for _ in range(60)]
    weights = np.random.default_rng(1).normal(size=1 << ordinal.HASH_BITS)
    weights[np.random.default_rng(2).random(len(weights)) < 0.9] = 0
    every, some = ordinal.RatingFeatures(), ordinal.RatingFeatures(weights)
    for text in texts:
        full = every(text)
        assert len(set(full.tolist())) == len(full) and np.array_equal(some(text), full[weights[full] != 0])
    whole = [every(text) for text in texts]
    monkeypatch.setattr(ordinal, "PIECE", 7)
    assert all(np.array_equal(every(text), found) for text, found in zip(texts, whole))


def test_rating_features_follow_content():
    """Runs with equal text have equal hashes wherever they stand, others not; words are those of a regular expression."""
    rng = random.Random(7)
    for _ in range(30):
        text = "".join(rng.choice(["ab", "Ab", "é", " ", "\n", "1", "_", "-", "\U0001f600", "\U00020000", "！", "x" * 9]) for _ in range(200))
        low = ordinal.Codes.of(text.lower())
        starts, ends = low.runs(low.kind(0))
        words = [text.lower()[a:b] for a, b in zip(starts, ends)]
        assert words == re.findall(r"\w+", text.lower())
        hashes = low.hashes(starts, ends).tolist()
        assert len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
        own = ordinal.Codes.of(text)
        assert [text[a:b] for a, b in zip(*own.runs(~own.kind(1)))] == text.split()
        classes = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in text]
        assert "".join(map(chr, own.kind(2).tolist())) == "".join(classes)


def test_ordinal_fit_equals_plain_steps():
    """The fit against the same rule written out for dictionaries, and its slope against differences."""
    rng = np.random.default_rng(8)
    grades = rng.integers(0, 3, 80)
    rows = [np.unique(np.append(rng.integers(100, 160, 6), 10 + g)) for g in grades]
    model = ordinal.fit(rows, grades, alpha=0.3, l1=0.5, epochs=3)
    share = [min(max(float((grades <= k).mean()), 0.01), 0.99) for k in range(2)]
    cuts = [math.log(x / (1 - x)) for x in share]
    cuts = [cuts[0], max(cuts[0], cuts[1] + 1e-3)]
    z, n, squares, order = defaultdict(float), defaultdict(float), [1.0, 1.0], np.random.default_rng(23)

    def w(i):
        return 0.0 if abs(z[i]) <= 0.5 else -(z[i] - math.copysign(0.5, z[i])) / ((1 + math.sqrt(n[i])) / 0.3 + 1)

    def loss(score, t, grade):
        tails = [1.0, *(1 / (1 + math.exp(c - score)) for c in t), 0.0]
        return -math.log(tails[grade] - tails[grade + 1])

    for _ in range(3):
        for k in order.permutation(80):
            ids, grade = rows[k].tolist(), int(grades[k])
            score = sum(w(i) for i in ids)
            slope = (loss(score + 1e-6, cuts, grade) - loss(score - 1e-6, cuts, grade)) / 2e-6
            moves = []
            for t in range(2):
                up, down = list(cuts), list(cuts)
                up[t] += 1e-6
                down[t] -= 1e-6
                moves.append((loss(score, up, grade) - loss(score, down, grade)) / 2e-6)
            for i in ids:
                old = w(i)
                z[i] += slope - (math.sqrt(n[i] + slope**2) - math.sqrt(n[i])) / 0.3 * old
                n[i] += slope**2
            for t in (1, 0):
                if abs(moves[t]) > 1e-12:
                    squares[t] += moves[t] ** 2
                    cuts[t] -= 0.1 * moves[t] / math.sqrt(squares[t])
            cuts = [cuts[0], max(cuts)]
    weights = model.dense()
    assert np.allclose(model.thresholds, cuts, atol=1e-4)
    assert all(abs(weights[i] - w(i)) < 1e-3 for i in list(z))


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(5)
    grades = rng.integers(0, 3, 600)
    rows = [np.unique(np.append(rng.integers(100, 3000, 20), 10 + g)) for g in grades]
    model = ordinal.fit(rows, grades)
    weights = model.dense()
    assert weights[10] < weights[11] < weights[12] and model.thresholds[0] <= model.thresholds[1]


def test_ordinal_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a", 1), (1, None, 1)], "doc_id long, text string, grade int")
    got = ordinal.graded(docs, spark.createDataFrame([(5, 1), (None, 2), (1, None)], "doc_id long, grade int")).collect()
    assert len(got) == 4 and all(r.selected and r.tail is None for r in got)
    got = ordinal.graded(docs, spark.createDataFrame([(2, 0), (2, 2), (1, 9)], "doc_id long, grade int")).collect()
    assert len(got) == 4 and all(0 <= r.tail <= 1 for r in got)
    assert ordinal.graded(docs.where("false"), spark.createDataFrame([(2, 0)], "doc_id long, grade int")).count() == 0


def plain_spans(text):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        double = sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
        found += [("card", m.start(), m.end())] if 16 <= len(digits) <= 19 and double % 10 == 0 else []
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def test_base_spans_equal_plain_rules():
    rng = random.Random(2)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "1.2.3.4.5.6.7", "999.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 555-1234", "+12", "..", "-", " ", "é", "12", "a@b.c@d.e", "0001.002.3.4", "+", "%"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("1" * 30000 + "." + "@" * 3000 + "a" * 30000) == []
    for zeros in (5000, 20000):  # more digits than a number may be read from
        text = "x " + "0" * zeros + "1.2.3.4 y"
        assert pii.base_spans(text) == [("ip", 2, len(text) - 2)]
        assert pii.base_spans(f"x {'0' * zeros}256.2.3.4 y") == []


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(spark.read.parquet(f"{MIDDLE}/documents.parquet"))


def test_gradients_equal_differences():
    model = pii.Tagger()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(1)
    codes, tags = rng.integers(0, pii.N_CODES, (3, 6)), np.array([[0, 1, 2, 0, 3, 4], [0, 0, 0, 0, 0, 0], [7, 8, 8, 0, 1, 0]])
    _, grads = model.gradients(codes, tags)
    for name in model.p:
        for _ in range(4):
            at = tuple(int(rng.integers(0, n)) for n in model.p[name].shape)
            if abs(model.p[name][at]) > 20:
                continue
            old, values = model.p[name][at], []
            for step in (1e-3, -1e-3):
                model.p[name][at] = old + step
                values.append(model.gradients(codes, tags)[0])
            model.p[name][at] = old
            assert abs((values[0] - values[1]) / 2e-3 - grads[name][at]) < 5e-3


def test_model_finds_held_out_made_spans(tagger):
    words = "the quick brown fox sat on a mat and went to read what was in the news of that day".split()
    rng, gen = random.Random(4), np.random.default_rng(99)
    wanted = hits = extra = 0
    for _ in range(300):
        kind, piece = pii._made(gen)
        left, right = " ".join(rng.choices(words, k=30)), " ".join(rng.choices(words, k=30))
        text = f"{left} {piece} {right}"
        spans = pii.merged(pii.base_spans(text), pii.model_spans([text], tagger)[0])
        if kind:
            wanted += 1
            hits += (kind, len(left) + 1, len(left) + 1 + len(piece)) in spans
        else:
            extra += len(spans)
    assert hits >= 0.85 * wanted and extra <= 3


def test_long_texts_decode_as_a_whole(tagger):
    filler = "some words here and there, " * 300
    text = filler + "name.last [at] host.example.org " + filler
    spans = pii.model_spans([text], tagger)[0]
    start = len(filler)
    assert ("email", start, start + len("name.last [at] host.example.org")) in spans
    for shift in range(0, 97, 7):
        moved = pii.model_spans(["x" * shift + " " + text], tagger)[0]
        assert moved and moved[0][1] == spans[0][1] + shift + 1


def test_personal_data_table(spark, tagger):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    more = [(-1, None), (-2, ""), (None, "a@b.cd"), (None, "a@b.cd")]
    frame = spark.createDataFrame([(r.doc_id, r.text, 1) for r in docs] + [(*x, 1) for x in more], "doc_id long, text string, n_ip int")
    got = pii.personal_data(frame, tagger).collect()
    assert len(got) == len(docs) + 4
    texts = {r.doc_id: r.text for r in docs} | dict(more)
    for r in got:
        base = plain_spans(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        joined = [f"{a}:{b}:{c}" for a, b, c in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= set(r.spans.split(",")) | {""}
    assert pii.personal_data(frame.where("false"), tagger).count() == 0
    assert pii.cut("a a@b.cd +1 555 555 5555.", plain_spans("a a@b.cd +1 555 555 5555.")) == "a <email> <phone>."


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    scorer = toxicity.Scorer(*toxicity.train(docs, labels))
    rows = {k: text for k, text in rows.items() if scorer(text) < 0.5}
    sets = {k: set(pairs.shingle_set(text, 5).tolist()) for k, text in rows.items()}
    up = {k: k for k in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if a < b and up[a] != up[b] and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    low = min(up[a], up[b])
                    up[a] = up[b] = low
                    changed = True
    kept = {k for k in rows if up[k] == k}
    items = [leaks.word_codes(r.text) for r in bench.collect()]
    block = leaks.Block(list(range(len(items))), [x for x in items], 5)
    kept = {k for k in kept if not any(sum(t[2] for t in leaks.tiles(words, items[i])) >= 0.5 * len(items[i]) for i, words in leaks.candidates(leaks.word_codes(rows[k]), block, 0.5, 5))}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} == kept and all(r.exact for r in got)


def test_rows_that_share_a_doc_id_or_have_none(spark):
    """Unlike texts stay whatever their doc_id; near copies go, also without one; so do leaks."""
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    words = [f"word{k}" for k in range(40)]
    rows = [(1, " ".join(words)), (1, " ".join(reversed(words))), (2, "other text " * 3), (None, " ".join(words[:39])), (None, "a text of its own"), (None, item), (7, item + " more"), (None, None), (5, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_per_group(spark, docs, SMALL).collect()), key=str)
    assert kept == sorted([rows[k] for k in (0, 1, 2, 4, 6, 7, 8)], key=str)
    clean = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_leaks(spark, docs, SMALL).collect()), key=str)
    assert clean == sorted([rows[k] for k in (0, 1, 2, 3, 4, 7, 8)], key=str)


def test_stages_on_edge_rows(spark):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (None, "text without id", "en", "s", 15), (3, "mail a@b.cd now", None, None, 15), (3, "mail a@b.cd now", None, None, 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.count() == (4 if name == "n-gram Jaccard join" else 5), name
    masked = corpus_pipeline.mask_personal_data(spark, docs, SMALL).where("doc_id = 3").first()
    assert masked.text == "mail <email> now" and masked.n_chars == 16
    assert corpus_pipeline.encode(spark, docs, SMALL).count() == 5


class Captured:
    """A table that only keeps the function it is to be mapped by."""

    columns = ["doc_id", "text"]

    def __init__(self, spark):
        self.sparkSession, self.schema = spark, "doc_id long, text string"

    def mapInArrow(self, function, schema):
        return function


def test_pipeline_holds_few_texts_at_once(spark, monkeypatch):
    docs = pa.RecordBatch.from_pydict({"doc_id": range(3000), "text": [f"text {k} of some words" for k in range(3000)]})
    table = Captured(spark)
    tagger = pii.Tagger()
    benchmark = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(60)))], "item_id long, text string")
    clean = toxicity.keep_clean(table, (np.array([1]), np.array([0.0]), -1.0))
    for stage in (pii.masked(table, tagger), clean, leaks.keep_clean(table, benchmark)):
        out = list(stage(iter([docs])))
        assert max(batch.num_rows for batch in out) <= 512
        assert pa.Table.from_batches(out).to_pydict() == pa.table(docs.to_pydict()).to_pydict()
    encoder = pieces.Pieces(pieces.load_pieces())
    ids = encoder.encode("some words and some words")
    assert encoder.decode(ids) == "some words and some words" and ids.dtype == np.int32
    assert {type(x) for x in encoder.cache.values()} == {bytes}


def test_pipeline_stages_give_memory_back(spark, monkeypatch):
    """Before the first batch of a task and after its last one, by when the task's own tables are gone."""
    calls, alive = [], []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(sum(ref() is not None for ref in alive)))
    docs = pa.RecordBatch.from_pydict({"doc_id": range(3), "text": ["some words", "", None]})
    table = Captured(spark)
    benchmark = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(60)))], "item_id long, text string")
    for module, name in ((toxicity, "Scorer"), (leaks, "Block")):
        made = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, made=made: alive.append(weakref.ref(x := made(*a))) or x)
    clean = toxicity.keep_clean(table, (np.array([1]), np.array([0.0]), -1.0))
    for stage in (pii.masked(table, pii.Tagger()), clean, leaks.keep_clean(table, benchmark)):
        calls.clear()
        assert sum(batch.num_rows for batch in stage(iter([docs]))) == 3
        assert calls == [0, 0]
    assert len(alive) == 2
    for frame in (common.map_batches(table, lambda batch: iter([{"doc_id": batch.column("doc_id")}]), "doc_id long"),):
        calls.clear()
        assert [batch.num_rows for batch in frame(iter([docs]))] == [3]
        assert len(calls) == 2


def test_memory_is_given_back():
    def held():
        return int(re.search(r"Private_Dirty:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

    common.give_back()
    before = held()
    parts = [np.ones(1 << 13) for _ in range(2000)]  # 64 KB each, from the allocator's own stretches
    edge = np.ones(1 << 13)
    del parts
    kept = held() - before
    common.give_back()
    assert edge[0] == 1.0 and kept > 100 and held() - before < 30


def test_pipeline_bounds_arrow_batches(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = spark.conf.get(common.ARROW_ROWS)
    try:
        for rows, want in (("10000", "1000"), ("0", "1000"), ("300", "300")):
            spark.conf.set(common.ARROW_ROWS, rows)
            common.bounded_batches(spark)
            assert spark.conf.get(common.ARROW_ROWS) == want
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(common.ARROW_ROWS, "10000")
            stage(spark, docs, SMALL)
            assert spark.conf.get(common.ARROW_ROWS) == "1000"
    finally:
        spark.conf.set(common.ARROW_ROWS, before)
