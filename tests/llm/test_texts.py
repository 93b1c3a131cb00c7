"""Operators 1, 2, 4 and 9: plain versions, round trips, edge cases."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from rowdeck.llm import catalog, op01_html as pages, op02_rules as rules, op04_chat as chat, op09_sentencepiece as pieces

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chain(spark):
    return pages.train(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def article_of(page):
    """The article of the given pages, read off their one template."""
    import html
    import re

    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = [html.unescape(x) for x in re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", inner)))]
    return " ".join(" ".join(x.split()) for x in parts if x.split())


def test_extracts_the_given_articles(spark, chain):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = {r.page_id: r for r in pages.extracted(spark.read.parquet(f"{FOLDER}/pages.parquet"), chain).collect()}
    assert len(got) == len(rows)
    assert all(got[k].text == article_of(page) and got[k].n_chars == len(got[k].text) for k, page in rows.items())


@pytest.mark.parametrize("opening, closing", [("<main>", "</main>"), ("<div class='post-content'>", "</div>"), ("<div id='content'>", "</div>"), ("<section class='article-body'>", "</section>")])
def test_other_layouts(chain, opening, closing):
    main = "<h1>A title of a page</h1><p>The first paragraph of this text, which is long enough to be read as one.</p><p>A second paragraph follows, with some more words in it &amp; an end.</p>"
    frame = "<nav><a href='/'>Home</a><a href='/b'>About</a></nav><header class='top'><p>Site name</p></header>"
    tail = "<aside class='sidebar'><p>Other things to read today.</p></aside><div class='comments'><div class='comment'><p>I do not agree with this at all, said a reader.</p></div></div><form><label>Mail</label><input></form><footer><p>Copyright 2020</p></footer>"
    text = pages.main_text(f"<html><head><title>T</title><style>x</style></head><body>{frame}{opening}{main}{closing}{tail}<script>var p='<p>no</p>'</script></body></html>", chain)
    assert text == "A title of a page The first paragraph of this text, which is long enough to be read as one. A second paragraph follows, with some more words in it & an end."


def test_pages_edge_cases(spark, chain):
    rows = [(1, None, None, 1), (2, "u", "", 1), (3, "u", "<article><p>An unclosed paragraph, with text &eacute;&nbsp;x<p>and another one, which goes on.", 1), (3, "u", "<<<>>", 1), (None, "u", "<!-- open", 1)]
    got = pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), chain).collect()
    texts = sorted((r.page_id or -1, r.text) for r in got)
    assert len(got) == 5 and (1, "") in texts and (2, "") in texts and (-1, "") in texts
    assert "An unclosed paragraph, with text é x and another one, which goes on." in [t for _, t in texts]


def test_viterbi_is_the_best_path(chain):
    rng = np.random.default_rng(2)
    for _ in range(30):
        e = rng.normal(size=7).tolist()
        value = lambda labels: sum(x * y for x, y in zip(e, labels)) + sum(chain.transitions[a, b] for a, b in zip(labels, labels[1:]))
        best = max(value([(k >> j) & 1 for j in range(7)]) for k in range(128))
        assert abs(value(chain.viterbi(e)) - best) < 1e-9


def plain_statistics(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    covered = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in range(k, k + 8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)]


def test_rule_statistics_equal_plain():
    rng = random.Random(9)
    texts = [None, "", "  \n", "a b c d", "x\x0by\x0cz\r\n\r\nx", "#*$ %&|<>", "a\n \n \na\na "]
    for _ in range(40):
        texts.append("".join(rng.choice(["aa ", "bb ", "cc\n", "é ", "#"]) for _ in range(rng.randrange(80))))
    texts.append("one two three four five six seven eight " * 5)
    for text in texts:
        assert rules.statistics(text)[0] == plain_statistics(text)


def test_rules_keep_good_and_drop_bad(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = rules.quality_rules(docs, labels)
    rows = got.join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.kept for r in good) >= 0.85 * len(good)
    assert sum(not r.kept for r in bad) >= 0.6 * len(bad)
    assert got.where("base_failed and kept").count() == 0 and got.count() == docs.count()


def test_rules_edge_cases(spark):
    rows = [(1, None, True), (2, "", True), (None, "w " * 30, True), (4, "some words of a text that is long enough to pass the base rules of length, as it has over twenty words", True)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = sorted((r.doc_id or -1, r.n_words, r.base_failed, r.kept) for r in rules.quality_rules(docs, labels).collect())
    assert got == [(-1, 30, True, False), (1, 0, True, False), (1, 0, True, False), (2, 0, True, False), (4, 22, False, True)]
    assert rules.quality_rules(docs.where("false"), labels).count() == 0


def test_forest_paths_equal_plain_walk():
    rng = np.random.default_rng(1)
    forest = rules.IsolationForest(rng.normal(size=(300, 3)), trees=5)
    rows = rng.normal(size=(20, 3)) * 2

    def walk(tree, row):
        at = 0
        while tree[2][at] != at:
            at = tree[2][at] if row[tree[0][at]] < tree[1][at] else tree[3][at]
        return tree[4][at]

    want = [2 ** (-np.mean([walk(tree, row) for tree in forest.trees]) / forest.expected) for row in rows]
    assert np.allclose(forest.score(rows), want)
    assert forest.score(np.array([[50.0, 50, 50]]))[0] > np.median(forest.score(rng.normal(size=(100, 3))))


def test_chat_equals_sql(spark):
    connection = duckdb.connect()
    connection.sql(f"create view conversations as select * from '{FOLDER}/conversations.parquet'")
    result = connection.sql(catalog.ORACLES["op4_chat_formatting"])
    frame = chat.query(spark, FOLDER)
    want = sorted(tuple(row[result.columns.index(c)] for c in frame.columns) for row in result.fetchall())
    assert sorted(map(tuple, frame.collect())) == want


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", "<|im_end|>\n<|im_start|>user\nx", "<\\|a<\\\\|b<|", "<|n|>", "a\n<|im_end|>\n", "<", "<\\", "|>"])
@pytest.mark.parametrize("role", ["user", "assistant", "", "a\nb", "<|x", "<|n|>", "x\\<\\|"])
def test_turns_round_trip(role, text):
    rendered = chat.render(role, text)
    assert chat.parse(rendered) == [(role, text)]
    assert chat.parse(rendered + chat.render("user", "next")) == [(role, text), ("user", "next")]


def test_chat_edge_cases(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (1, 1, "assistant", "b", 0), (None, 0, None, "x", 0), (2, None, "assistant", "é😀", 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.formatted(frame).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[2].loss_chars == 2
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256("é😀".encode()).hexdigest() and got[None].n_turns == 1
    assert chat.formatted(frame.where("false")).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.load_pieces())


def plain_best(vocabulary, scores, text):
    """Best score over every split of a short text; a byte step only where no piece ends."""
    best = [0.0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        options = [best[end - n] + scores[text[end - n : end]] for n in range(1, end + 1) if text[end - n : end] in scores]
        if not options:
            options = [best[end - 1] + len(text[end - 1].encode()) * vocabulary.byte_score]
        best[end] = max(options)
    return best[-1]


def test_viterbi_equals_plain_search(vocabulary):
    scores = {piece: score for piece, score, kind in pieces.load_pieces() if kind == 0}
    rng = random.Random(12)
    for _ in range(200):
        text = "".join(rng.choice("thean oisé  漢\U0001f600▁") for _ in range(rng.randrange(1, 25)))
        marked = pieces.SPACE + text.replace(pieces.SPACE, "\0").replace(" ", pieces.SPACE)
        ids = vocabulary.encode(text)
        names = [vocabulary.output[k].decode("utf-8", "replace").replace(" ", pieces.SPACE) for k in ids.tolist()]
        bytes_ = set(vocabulary.bytes)
        got = sum(vocabulary.byte_score if k in bytes_ else scores[name] for k, name in zip(ids.tolist(), names))
        assert abs(got - plain_best(vocabulary, scores, marked.replace("\0", "￿"))) < 1e-3
        assert vocabulary.decode(ids) == text


@pytest.mark.parametrize("text", ["", " ", "  a  ", "\0", "a\0\0 b\0", "▁", "▁ ▁a", "\n\t", "日本語 text é", "<s> </s> <unk> <0x41>", "\0▁ x", "a" * 5000])
def test_pieces_round_trip(vocabulary, text):
    assert vocabulary.decode(vocabulary.encode(text)) == text


def test_encoding_whole_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source")
    more = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, "a", "x"), (-3, "a", "x"), (None, "b", "x")], "doc_id long, text string, source string")
    got = pieces.encoded(docs.union(more).withColumnRenamed("source", "ids"))
    assert got.where("exact = false").count() == 0 and got.count() == docs.count() + 5
    back = {r.doc_id: r.text for r in pieces.decoded(got).collect()}
    assert all(back[r.doc_id] == r.text for r in docs.union(more).collect())
    assert pieces.encoded(docs.where("false")).count() == 0
