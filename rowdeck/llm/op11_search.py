r"""Ranked lexical search by presence masks.

The items are the stated query set: they go out in blocks of at most ``BLOCK_TERMS`` terms, each
block one scan of the texts. The scan leaves, per document, its number of terms and the
block's terms it holds with their counts (a narrow written table); document frequencies and the
corpus totals are aggregates over all documents.

Then each task works through its documents slice by slice. For an item, the presence
bitmaps of its terms over the slice are packed into one mask per document, and documents are grouped
by mask. A mask's greatest possible score is the sum, over its terms, of the weight times
the greatest term part in the slice. Masks are evaluated in falling order of that bound
until the bound is below the item's tenth score so far; what is left cannot enter the ranking,
nor win a tie. The bests of all tasks are ranked in two steps, inside buckets and then
per item, so no task gets the bests of all tasks of an item at once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowdeck.llm.common import map_batches, narrow, table
from rowdeck.llm.shelf import Shelf

TOP = 10
BLOCK_TERMS = 1 << 16  # most distinct terms of a block of items, unless one item has more
PIECE = 1 << 20  # bytes of a long text that are split into words at once
SLICE, CELLS = 1024, 1 << 24  # documents of a slice at most, and terms times documents
BUCKETS = 32
# Terms are runs of digits, letters and anything outside ASCII; only A-Z are lowered.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
LONGEST = (1 << 63) - 1


def term_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, long texts piece by piece."""
    text = text or b""
    at = 0
    while at < len(text):
        end = at + PIECE
        piece = text[at:end].translate(TERM_BYTES)
        while end < len(text) and not piece.endswith(b" "):  # never cut a term
            gap = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").search(text, end)
            end = gap.end() if gap else len(text)
            piece = text[at:end].translate(TERM_BYTES)
        yield piece.split()
        at = end


class Items:
    """A block of items: the terms of each as numbers into one vocabulary."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.terms: list[list[int]] = []
        self.known: dict[bytes, int] = {}

    def add(self, item_id: int | None, terms: list[bytes]) -> None:
        self.ids.append(item_id)
        self.terms.append(sorted({self.known.setdefault(t, len(self.known)) for t in terms}))


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """Items with at least one term; the rows of one item_id are one item."""
    rows = narrow(items, item_id=F.col("item_id").cast("long"), text=F.col("text").cast("binary")).where("text is not null")
    block, last, terms = Items(), None, set()
    for row in rows.orderBy("item_id").toLocalIterator():
        if last is not None and last[0] != row["item_id"]:
            block = yield from _added(block, last[0], terms)
            terms = set()
        last = (row["item_id"],)
        terms.update(t for part in term_lists(bytes(row["text"])) for t in part)
    if last is not None:
        block = yield from _added(block, last[0], terms)
    if block.ids:
        yield block


def _added(block: Items, item_id: int | None, terms: set[bytes]):
    if terms:
        if block.ids and len(block.known) + len(terms) > BLOCK_TERMS:
            yield block
            block = Items()
        block.add(item_id, sorted(terms))
    return block


def postings(documents: DataFrame, block: Items) -> DataFrame:
    """``(doc_id, n, terms, counts)`` of each document with a term: ``n`` terms with repeats, and
    the block's terms among them."""
    docs = narrow(documents, doc_id=F.col("doc_id").cast("long"), text=F.col("text").cast("binary"))
    shared = docs.sparkSession.sparkContext.broadcast(block.known)

    def run(batch):
        find = shared.value.get
        rows, sizes, offsets, terms, counts = [], [], [0], [], []
        for k, text in enumerate(batch.column("text")):
            n, found = 0, Counter()
            for words in term_lists(text.as_py()):
                n += len(words)
                found.update(map(find, words))
            if n:
                found.pop(None, None)
                rows.append(k)
                sizes.append(n)
                terms += found.keys()
                counts += found.values()
                offsets.append(len(terms))
        starts = pa.array(offsets, pa.int32())
        yield {
            "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())),
            "n": sizes,
            "terms": pa.ListArray.from_arrays(starts, pa.array(terms, pa.int32())),
            "counts": pa.ListArray.from_arrays(starts, pa.array(counts, pa.int32())),
        }

    return map_batches(docs, run, "doc_id long, n long, terms array<int>, counts array<int>")


class Slice:
    """Some documents as a table of presence and one of term parts, a row per term they hold."""

    def __init__(self, doc_ids: list[int | None], n: list[int], offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray, corpus: tuple[int, int]):
        size = len(doc_ids)
        documents, total = corpus
        m = np.array([100 - 90 + 90 * x * documents // total for x in n], np.int64)
        rows = np.repeat(np.arange(size), np.diff(offsets))
        present, place = np.unique(terms, return_inverse=True)
        tf = counts.astype(np.int64)
        parts = 1_000_000_000 * tf // (1000 * tf + 8 * m[rows])
        self.doc_ids, self.present = doc_ids, present
        self.parts = np.zeros((len(present), size), np.int32)  # a part is under 10^6
        self.parts[place, rows] = parts
        self.holds = np.zeros((len(present), size), bool)
        self.holds[place, rows] = True
        self.most = self.parts.max(axis=1) if size and len(present) else np.zeros(len(present), np.int32)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Rows of those of the terms that occur here."""
        at = np.searchsorted(self.present, terms)
        at[at == len(self.present)] = 0
        return at[self.present[at] == terms] if len(self.present) else at[:0]

    def masks(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct presence masks (a row of bits each), and each document's mask."""
        packed = np.packbits(self.holds[places], axis=0)
        words = np.zeros((packed.shape[1], -(-packed.shape[0] // 8) * 8), np.uint8)
        words[:, : packed.shape[0]] = packed.T
        words = words.view(np.uint64)
        if words.shape[1] == 1:
            distinct, group = np.unique(words[:, 0], return_inverse=True)
        else:
            distinct, group = np.unique(words, axis=0, return_inverse=True)
        bits = np.unpackbits(np.ascontiguousarray(distinct).view(np.uint8).reshape(len(distinct), -1), axis=1)
        return bits[:, : len(places)], group.reshape(-1)


def search_slice(part: Slice, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
    """``best``, sorted pairs (-score, doc_id), with the documents of a slice taken in."""
    places = part.places(terms)
    if not len(places):
        return best
    w = weights[part.present[places]]
    bits, group = part.masks(places)
    bounds = bits.astype(np.int64) @ (w * part.most[places])
    order = np.argsort(-bounds, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    document = np.argsort(rank[group], kind="stable")  # documents in the order of their masks
    ends = np.searchsorted(rank[group][document], np.arange(len(order)), "right")
    done, step = 0, 8
    while done < len(order):
        least = -best[-1][0] if len(best) == top else 1
        open_ = np.searchsorted(-bounds[order], -least, "right")  # masks that can reach the least score
        until = min(open_, done + step)
        if until <= done:
            break
        chosen = document[ends[done - 1] if done else 0 : ends[until - 1]]
        scores = w @ part.parts[np.ix_(places, chosen)].astype(np.int64)
        (good,) = np.nonzero(scores >= least)
        new = [(-int(scores[k]), LONGEST if part.doc_ids[chosen[k]] is None else part.doc_ids[chosen[k]]) for k in good.tolist()]
        best = sorted(best + new)[:top]
        done, step = until, 2 * step
    return best


def _bests(found: DataFrame, block: Items, weights: np.ndarray, corpus: tuple[int, int], top: int) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast((block.ids, [np.array(t) for t in block.terms], weights))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    size = max(1, min(SLICE, CELLS // max(1, len(block.known))))

    def run(batches):
        ids, items, weights = shared.value
        bests: list[list[tuple[int, int]]] = [[] for _ in ids]
        for batch in batches:
            for low in range(0, len(batch), size):
                rows = batch.slice(low, size)
                lists, counts = rows.column("terms"), rows.column("counts")
                offsets = lists.offsets.to_numpy()
                part = Slice(
                    rows.column("doc_id").to_pylist(), rows.column("n").to_pylist(), offsets - offsets[0],
                    lists.flatten().to_numpy(), counts.flatten().to_numpy(), corpus,
                )
                for k, terms in enumerate(items):
                    bests[k] = search_slice(part, terms, weights, bests[k], top)
        rows = [(item, None if doc == LONGEST else doc, -score) for item, best in zip(ids, bests) for score, doc in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return found.mapInArrow(run, "item_id long, doc_id long, score long")


RESULT = "item_id long, rank int, doc_id long, score long"


def ranked(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best documents of every item.

    Every row of ``documents`` is a document, whatever its doc_id; equal scores go by doc_id, NULL
    last. NULL and empty texts have no terms; documents that score 0 are left out, and so are items
    without terms or without any such document. Rows of one item_id form one item with the
    terms of all its texts; a NULL item_id is an item like others. Texts are read whole, long ones
    piece by piece. Other columns are ignored; an empty table on either side gives no rows.
    """
    spark: SparkSession = documents.sparkSession
    shelf, results, corpus = Shelf(spark), [], None
    for block in item_blocks(items):
        found = shelf.put(postings(documents, block))
        if corpus is None:
            corpus = tuple(found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first())
        frequencies = np.zeros(len(block.known), np.int64)
        for term, df in found.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            frequencies[term] = df
        # one number per term of the block; terms that no document holds are never looked up
        weights = np.array([math.floor(1000 * math.log((2 * corpus[0] + 2) / (2 * df + 1))) for df in frequencies.tolist()], np.int64)
        results.append(shelf.put(_bests(found, block, weights, corpus, top)))
        shelf.drop(found)
    if not results:
        return spark.createDataFrame([], RESULT)
    rows = results[0]
    for more in results[1:]:
        rows = rows.unionByName(more)
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("item_id", "bucket").orderBy(*best)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    rows = rows.withColumn("place", F.row_number().over(some)).where(F.col("place") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best)))
    return rows.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def query(spark, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
SQL = rf"""
with texts as (select row_number() over () as r, doc_id, {_WORDS} as words from documents where text is not null),
docs as (select r, doc_id, words, len(words) as n from texts where len(words) > 0),
total as (select count(*) as docs, cast(sum(n) as bigint) as terms from docs),
tf as (select r, term, count(*) as tf from (select r, unnest(words) as term from docs) group by r, term),
wanted as (select distinct item_id, unnest({_WORDS}) as term from benchmark where text is not null),
df as (select term, count(*) as df from tf where term in (select term from wanted) group by term),
scores as (
    select w.item_id, d.r, any_value(d.doc_id) as doc_id, cast(sum(
        cast(floor(1000 * ln((2 * t.docs + 2) / (2 * f.df + 1))) as bigint)
        * ((1000000000 * x.tf) // (1000 * x.tf + 8 * (100 - 90 + (90 * d.n * t.docs) // t.terms)))
    ) as bigint) as score
    from wanted w join df f on w.term = f.term join tf x on x.term = w.term join docs d on d.r = x.r cross join total t
    group by w.item_id, d.r
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
from scores where score > 0 qualify rank <= 10
"""
