"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks, stretches of text between block-level tags. Each block has
features of its ancestors (tag names, words of class, id and role attributes) and of its text
(length, share of link text, punctuation, cue words). A CRF with two labels, main text or not,
is trained on labelled pages: pages of the table whose own markup says which part is the
article, and pages composed for training in many layouts, with texts from that sample. Viterbi
decodes the labels of each page's chain; blocks labelled main make the text, in page order.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from rowdeck.llm.common import first_rows, map_batches, narrow, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME_WORD = re.compile(r"[a-z]+")
# Names with a fixed meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg math iframe select object".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
# Words that tell blocks of a site's frame from its articles; fixed values.
CUES = frozenset(
    "cookie cookies subscribe newsletter share tweet comment comments reply login sign register copyright rights reserved privacy terms advertisement sponsored related menu search home contact previous next".split()
)
MAX_PAGES = 300


def blocks(page: str) -> list[tuple[tuple, str, float]]:
    """Leaf blocks of a page: (path of (tag, attribute words), text, share of link text)."""
    found: list[tuple[tuple, str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                path = tuple(x for x in stack if x[0] not in INLINE or x[1])
                found.append((path, text, min(1.0, linked / len(text))))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text.strip())

    size = len(page)
    while at < size:
        match = TOKEN.search(page, at)
        if match is None:
            add(page[at:])
            break
        add(page[at : match.start()])
        at = match.end()
        name = match[2]
        if name is None:
            continue
        name = name.lower()
        if match[1]:
            if name not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in INLINE:
                        del stack[k:]
                    else:
                        del stack[k]
                    break
            if name == "a":
                in_link = max(0, in_link - 1)
            continue
        if name in INLINE:
            if name == "br":
                pieces.append(" ")
        else:
            flush()
        if name in RAW and not match[3].endswith("/"):
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID or match[3].endswith("/"):
            continue
        if name == "a":
            in_link = 1
        _imply(stack, name)
        words = ()
        if match[3]:
            words = tuple(
                word for m in ATTRIBUTE.finditer(match[3]) for word in NAME_WORD.findall(re.sub("([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower())
            )
        stack.append((name, words))
    flush()
    return found


def _imply(stack: list, name: str) -> None:
    """End tags that a start tag implies: a paragraph before any block, an item before the next."""
    if name not in INLINE:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == "p":
                del stack[k:]
                break
            if stack[k][0] not in INLINE:
                break
    if name in CLOSES:
        closing = CLOSES[name].split()
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in closing:
                del stack[k:]
                break
            if stack[k][0] in ("ul", "ol", "dl", "table", "tbody", "select"):
                break


def path_features(path: tuple) -> list[str]:
    names = [name for name, _ in path]
    out = [f"in {name}" for name in set(names)]
    out += [f"word {word}" for word in {word for _, words in path for word in words}]
    out += [f"leaf {name}" for name in names[-1:]] + [f"pair {a} {b}" for a, b in zip(names[-2:-1], names[-1:])]
    return out


def text_features(text: str, links: float) -> list[str]:
    words = text.split(" ", 64)
    size = len(text)
    out = ["bias", f"size {min(12, size.bit_length())}", f"links {math.ceil(4 * links)}"]
    if len(words) <= 40:
        cues = CUES.intersection(word.strip(".,:;!?()").lower() for word in words)
        out += ["cues"] * bool(cues) + [f"cue {cue}" for cue in cues]
    if text[-1] in ".!?…。\"”»":
        out.append("sentence end")
    if "©" in text[:40]:
        out.append("copyright sign")
    if text.count(", ") > 1:
        out.append("commas")
    return out


class Chain:
    """Binary linear-chain CRF: a weight per feature for label 1, and a 2 x 2 transition table."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.transitions = np.zeros((2, 2))
        self.paths: dict[tuple, float] = {}

    def emissions(self, page: list[tuple[tuple, str, float]]) -> list[float]:
        get, out = self.weights.get, []
        for path, text, links in page:
            score = self.paths.get(path)
            if score is None:
                if len(self.paths) > 1 << 16:
                    self.paths.clear()
                score = self.paths[path] = sum(get(f, 0.0) for f in path_features(path))
            out.append(score + sum(get(f, 0.0) for f in text_features(text, links)))
        return out

    def viterbi(self, emissions: list[float]) -> list[int]:
        """Best labels; of equal paths the one that keeps less."""
        if not emissions:
            return []
        (t00, t01), (t10, t11) = self.transitions.tolist()
        best0, best1, back = 0.0, emissions[0], []
        for e in emissions[1:]:
            from0, from1 = (0 if best0 + t00 >= best1 + t10 else 1), (0 if best0 + t01 >= best1 + t11 else 1)
            back.append((from0, from1))
            best0, best1 = max(best0 + t00, best1 + t10), max(best0 + t01, best1 + t11) + e
        label = 1 if best1 > best0 else 0
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]

    def fit(self, pages: list[tuple[list, list[int]]], epochs: int = 12, rate: float = 0.3, l2: float = 1e-4) -> "Chain":
        """Adaptive gradients on the log-likelihood of each page's labels."""
        squares: dict[str, float] = {}
        square_t, rng = np.full((2, 2), 1e-6), np.random.default_rng(29)
        featured = [([path_features(path) + text_features(text, links) for path, text, links in page], np.array(labels)) for page, labels in pages if page]
        for _ in range(epochs):
            for k in rng.permutation(len(featured)):
                features, labels = featured[k]
                e = np.zeros((len(features), 2))
                e[:, 1] = [sum(self.weights.get(f, 0.0) for f in names) for names in features]
                single, pair = self._marginals(e)
                for names, p, y in zip(features, single[:, 1].tolist(), labels.tolist()):
                    g = p - y
                    if abs(g) < 1e-4:
                        continue
                    for f in names:
                        w = self.weights.get(f, 0.0)
                        slope = g + l2 * w
                        squares[f] = squares.get(f, 1e-6) + slope * slope
                        self.weights[f] = w - rate * slope / math.sqrt(squares[f])
                gold = np.zeros((2, 2))
                np.add.at(gold, (labels[:-1], labels[1:]), 1)
                slope = pair - gold
                square_t += slope**2
                self.transitions -= rate * slope / np.sqrt(square_t)
        self.paths.clear()
        return self

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, T = len(e), self.transitions
        alpha, beta = np.zeros((size, 2)), np.zeros((size, 2))
        alpha[0] = e[0]
        for t in range(1, size):
            alpha[t] = e[t] + np.logaddexp(alpha[t - 1, 0] + T[0], alpha[t - 1, 1] + T[1])
        for t in range(size - 2, -1, -1):
            after = e[t + 1] + beta[t + 1]
            beta[t] = np.logaddexp(T[:, 0] + after[0], T[:, 1] + after[1])
        total = np.logaddexp(alpha[-1, 0], alpha[-1, 1])
        single = np.exp(alpha + beta - total)
        pair = np.zeros((2, 2))
        if size > 1:
            pair = np.exp(alpha[:-1, :, None] + T + (e[1:] + beta[1:])[:, None, :] - total).sum(0)
        return single, pair


BOILER = frozenset("nav footer aside form header menu button".split())
BOILER_WORDS = frozenset("ad ads advert banner promo sponsor sidebar comment comments cookie notice share social related menu nav footer breadcrumb newsletter widget".split())


def marked_by_page(page: list[tuple[tuple, str, float]]) -> list[int] | None:
    """Labels from a page's own markup, where it names an article or main part; else None."""
    labels, seen = [], False
    for path, _, _ in page:
        names = [name for name, _ in path]
        if "article" in names or "main" in names:
            at = names.index("article") if "article" in names else names.index("main")
            inner = path[at:]
            frame = any(name in BOILER or BOILER_WORDS.intersection(words) for name, words in inner)
            labels.append(int(not frame))
            seen = seen or not frame
        else:
            labels.append(0)
    return labels if seen else None


# Layouts to compose labelled pages from: openings and closings around the main text and around what is not.
MAIN = (
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article class='post'>", "</article></main>"), ("<div class='content'>", "</div>"),
    ("<div id='main-content'>", "</div>"), ("<div class='post-body entry-content'>", "</div>"), ("<section class='article-text'>", "</section>"),
    ("<table><tr><td class='content'>", "</td></tr></table>"), ("<div class='story'>", "</div>"), ("<div id='article' class='body'>", "</div>"),
    ("<div class='page'><div class='text'>", "</div></div>"), ("<div role='main'>", "</div>"),
)
FRAME = (
    ("<nav><ul>", "<li><a href='/x'>{}</a></li>", "</ul></nav>", 4), ("<div class='menu'>", "<a href='/x'>{}</a> ", "</div>", 5), ("<ul id='nav'>", "<li><a href='/x'>{}</a></li>", "</ul>", 5),
    ("<header class='site-header'>", "<h2>{}</h2>", "</header>", 2), ("<div id='header'>", "<p>{}</p>", "</div>", 2), ("<header>", "<p>{}</p>", "</header>", 9),
    ("<footer>", "&copy; {}", "</footer>", 9), ("<footer class='footer'>", "<p>{}</p>", "</footer>", 12), ("<div id='footer'>", "<p>Copyright {}. All rights reserved.</p>", "</div>", 4),
    ("<aside>", "<p>{}</p>", "</aside>", 15), ("<aside class='sidebar'>", "<h3>Related</h3><p>{}</p>", "</aside>", 12), ("<div class='sidebar'>", "<p>{}</p>", "</div>", 14), ("<div id='sidebar' class='widget'>", "<ul><li>{}</li></ul>", "</div>", 6),
    ("<div class='ad'>", "{}", "</div>", 9), ("<div class='advert banner'>", "<p>{}</p>", "</div>", 12), ("<div class='ads'>", "{}", "</div>", 14), ("<div class='promo sponsored'>", "<p>Advertisement {}</p>", "</div>", 10),
    ("<div class='cookie-notice'>", "<p>We use cookies. {}</p>", "</div>", 12), ("<div id='cookie-banner'>", "{}", "</div>", 12), ("<div class='notice'>", "<p>{}</p>", "</div>", 10), ("<div role='alert' class='alert'>", "<p>{}</p>", "</div>", 9),
    ("<form action='/s'>", "<label>{}</label><input name='q'><button>Search</button>", "</form>", 3), ("<form class='newsletter'>", "<p>Subscribe {}</p><button>Sign up</button>", "</form>", 8),
    ("<div class='comments'>", "<div class='comment'><p>{}</p></div>", "</div>", 16), ("<section id='comments'>", "<h3>Comments</h3><article class='comment'><p>{}</p></article>", "</section>", 18), ("<ol class='comment-list'>", "<li><b>Reader</b><p>{}</p></li>", "</ol>", 16),
    ("<div class='share social'>", "<a href='/t'>Share {}</a>", "</div>", 2), ("<div class='related'>", "<h3>Related</h3><a href='/r'>{}</a>", "</div>", 7), ("<div class='breadcrumb'>", "<a href='/'>{}</a>", "</div>", 2),
)


def composed_pages(texts: list[str], count: int = 240, seed: int = 31) -> list[tuple[list, list[int]]]:
    """Labelled pages: main text in one of the layouts, framed and interrupted by what is not."""
    rng = np.random.default_rng(seed)
    words = " ".join(texts).split() or ["text"]

    def some(n: int) -> str:
        n = max(1, int(rng.poisson(n)))
        start = int(rng.integers(0, max(1, len(words) - n)))
        return html.escape(" ".join(words[start : start + n]))

    def frame() -> str:
        opening, inner, closing, size = FRAME[int(rng.integers(len(FRAME)))]
        return opening + "".join(inner.format(some(size)) for _ in range(int(rng.integers(1, 5)))) + closing

    def paragraph() -> str:
        kind, text = int(rng.integers(0, 9)), "\x02" + some(int(rng.choice([3, 12, 40, 90])))
        if kind == 0:
            return f"<ul><li>{text}</li><li>\x02{some(9)}</li></ul>"
        if kind == 1:
            return f"<blockquote>{text}</blockquote>"
        if kind == 2:
            return f"<h2>{text[:60]}</h2>"
        if kind == 3:
            return f"<p>{text} <a href='/l'>{some(2)}</a> {some(12)}.</p>"
        return f"<p>{text}.</p>"

    pages = []
    for _ in range(count):
        opening, closing = MAIN[int(rng.integers(len(MAIN)))]
        body = f"<h1>\x02{some(7)}</h1>" if rng.random() < 0.8 else ""
        for _ in range(int(rng.integers(1, 9))):
            body += paragraph()
            if rng.random() < 0.15:
                body += frame()
        before = "".join(frame() for _ in range(int(rng.integers(0, 4))))
        after = "".join(frame() for _ in range(int(rng.integers(0, 4))))
        found = blocks(f"<html><body>{before}{opening}{body}{closing}{after}</body></html>")
        labels = [int("\x02" in text) for _, text, _ in found]
        pages.append(([(path, text.replace("\x02", "").strip() or ".", links) for path, text, links in found], labels))
    return pages


def train(pages: DataFrame, max_pages: int = MAX_PAGES) -> Chain:
    """A CRF from at most ``max_pages`` pages of the table and the pages composed from their texts."""
    rows = narrow(pages, page_id=F.col("page_id").cast("long"), html="html").where("page_id is not null and html is not null")
    ids = first_rows(rows.select("page_id"), "page_id", max_pages).distinct()
    sample = rows.join(F.broadcast(ids), "page_id").collect()
    cut = [blocks(row["html"]) for row in sorted(sample, key=lambda row: (row["page_id"], row["html"]))]
    labelled = [(page, labels) for page in cut if (labels := marked_by_page(page))]
    texts = [text[:2000] for page, labels in labelled[:60] for (_, text, _), label in zip(page, labels) if label]
    return Chain().fit(labelled + composed_pages(texts))


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page or "")
    return " ".join(text for (_, text, _), label in zip(found, chain.viterbi(chain.emissions(found))) if label)


def extracted(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per page row, from the whole html.

    NULL and empty pages, and pages without a main part, have an empty text. Broken markup is read
    as far as it goes; pages of any length are read whole. Repeated rows give repeated results,
    NULL ids and urls are carried through, other columns are ignored, an empty table gives no rows.
    """
    rows = narrow(pages, page_id=F.col("page_id").cast("long"), url="url", html="html")
    shared = pages.sparkSession.sparkContext.broadcast(train(pages) if chain is None else chain)

    def run(batch):
        texts = [main_text(page, shared.value) for page in batch.column("html").to_pylist()]
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(text) for text in texts]}

    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")


def query(spark, folder: str) -> DataFrame:
    return extracted(table(spark, folder, "pages"))
