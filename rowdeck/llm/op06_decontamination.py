"""Benchmark decontamination by greedy string tiling.

The benchmark is the stated query set: its items go out in blocks of at most ``BLOCK_WORDS``
words, each block one scan of the documents and one broadcast of that proven size. In a task a
document's five-word seeds are joined with the seeds of the block; items whose seeds can reach
the wanted coverage are tiled: the longest unmarked match is found by Karp-Rabin window hashes
and a binary search over lengths, all matches of that length are marked, and so on down to the
least length. The share of an item's words under tiles is its coverage, whatever their order,
so a passage with its sentences moved about is caught as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rowdeck.llm.common import gram_hashes, lean, map_batches, narrow, slices, table

WORD = re.compile(r"\w+")
LEAST = 5
COVERAGE = 0.5
BLOCK_WORDS = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def word_codes(text: str | None) -> np.ndarray:
    """Hashes of the lower-case words without punctuation."""
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Windows:
    """Karp-Rabin hashes of the windows of one sequence, modulo 2^64; marked words are taken."""

    def __init__(self, codes: np.ndarray):
        size = len(codes)
        self.codes, self.marked = codes, np.zeros(size, bool)
        self.down = np.cumprod(np.full(size + 1, INVERSE, np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * np.cumprod(np.full(size, BASE, np.uint64)))])

    def free(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of ``length`` without a marked word."""
        if len(self.codes) < length:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        used = np.concatenate([[0], np.cumsum(self.marked)])
        (starts,) = np.nonzero(used[length:] == used[:-length])
        return starts, (self.sums[starts + length] - self.sums[starts]) * self.down[starts]


def tiles(document: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(start in document, start in item, length)``, longest first."""
    doc, test = Windows(document), Windows(item)

    def matches(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document starts by hash; item starts and the range of document starts that each meets."""
        i, left = doc.free(length)
        j, right = test.free(length)
        order = np.argsort(left, kind="stable")
        left = left[order]
        lo, hi = np.searchsorted(left, right, "left"), np.searchsorted(left, right, "right")
        keep = hi > lo
        return i[order], j[keep], lo[keep], hi[keep]

    found = []
    upper = min(len(document), len(item))
    while upper >= least:
        low, high = least - 1, upper  # a common free run of a length implies one of every shorter length
        while low < high:
            middle = (low + high + 1) // 2
            if len(matches(middle)[1]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        i, starts, lo, hi = matches(low)
        for j, a, b in zip(starts.tolist(), lo.tolist(), hi.tolist()):
            if test.marked[j : j + low].any():
                continue
            for at in i[a:b].tolist():
                if not doc.marked[at : at + low].any() and np.array_equal(document[at : at + low], item[j : j + low]):
                    doc.marked[at : at + low] = test.marked[j : j + low] = True
                    found.append((at, j, low))
                    break
        upper = low - 1
    return found


class Block:
    """Items of one block with their seeds sorted for lookup."""

    def __init__(self, ids: list[int], items: list[np.ndarray], least: int):
        self.ids, self.items = ids, items
        seeds = [gram_hashes(item, least) for item in items]
        hashes = np.concatenate(seeds)
        owner = np.repeat(np.arange(len(items)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order], place[order]


def blocks(benchmark: DataFrame, least: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Items of at least ``least`` words, in blocks of at most BLOCK_WORDS words (or one longer item)."""
    rows = narrow(benchmark, item_id=F.col("item_id").cast("long"), text="text").where("item_id is not null and text is not null")
    ids, items, size = [], [], 0
    for row in rows.dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        codes = word_codes(row["text"])
        if len(codes) < least:
            continue
        if size and size + len(codes) > BLOCK_WORDS:
            yield ids, items
            ids, items, size = [], [], 0
        ids.append(row["item_id"])
        items.append(codes)
        size += len(codes)
    if size:
        yield ids, items


def contaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """``(doc_id, item_id, n_tiles, n_covered, n_item_words, coverage)`` of every document row and
    benchmark item of which at least that share is tiled by the document's words.

    Words are lower-cased and freed of punctuation; items of fewer than ``least`` words cannot
    hold a tile and are never reported. NULL and empty texts cover nothing, NULL item_ids are
    left out, rows with a NULL doc_id are reported with it. Repeated items count once, items of
    one id but different texts apart, repeated documents give repeated rows. Other columns are
    ignored; an empty table on either side gives no rows.
    """
    docs = narrow(documents, doc_id=F.col("doc_id").cast("long"), text="text")
    schema = "doc_id long, item_id long, n_tiles int, n_covered int, n_item_words int, coverage double"
    found = [_scan(docs, ids, items, coverage, least, schema) for ids, items in blocks(benchmark, least)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return result


def _scan(docs: DataFrame, ids: list[int], items: list[np.ndarray], coverage: float, least: int, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((ids, items))
    state: dict = {}

    def run(batch):
        if not state:
            state["block"] = Block(*shared.value, least)
        block = state["block"]
        rows: dict[str, list] = {name: [] for name in ("doc_id", "item_id", "n_tiles", "n_covered", "n_item_words", "coverage")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            codes = word_codes(text)
            for k, words in candidates(codes, block, coverage, least):
                item = block.items[k]
                found = tiles(words, item, least)
                covered = sum(length for _, _, length in found)
                if covered >= coverage * len(item):
                    values = (doc_id, block.ids[k], len(found), covered, len(item), covered / len(item))
                    for name, value in zip(rows, values):
                        rows[name].append(value)
        yield rows

    return map_batches(docs, run, schema)


def keep_clean(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """The rows whose text covers less than that share of every benchmark item, all columns as they
    came, rows with a NULL text or doc_id included. A filter in the scan: no row is exchanged."""
    kept = documents
    place = documents.columns.index("text")
    for ids, items in blocks(benchmark, least):
        kept = _without(kept, place, ids, items, coverage, least)
    return kept


def _without(documents: DataFrame, place: int, ids: list[int], items: list[np.ndarray], coverage: float, least: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast((ids, items))

    def clean(text: str | None, block: Block) -> bool:
        found = candidates(word_codes(text), block, coverage, least)
        return all(sum(length for _, _, length in tiles(words, block.items[k], least)) < coverage * len(block.items[k]) for k, words in found)

    def run(batches):
        block = Block(*shared.value, least)
        for batch in slices(batches):
            yield batch.filter(pa.array([clean(text, block) for text in batch.column(place).to_pylist()], pa.bool_()))

    return documents.mapInArrow(lean(run), documents.schema)


def candidates(codes: np.ndarray, block: Block, coverage: float, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Items whose seeds in the document could cover enough, each with the document's words under
    those seeds; a zero, the hash of no word, stands where other words are left out."""
    seeds = gram_hashes(codes, least)
    if not len(seeds):
        return
    lo = np.searchsorted(block.hashes, seeds, "left")
    hi = np.searchsorted(block.hashes, seeds, "right")
    (hits,) = np.nonzero(hi > lo)
    if not len(hits):
        return
    sizes = (hi - lo)[hits]
    starts = np.repeat(hits, sizes)
    entries = np.repeat(lo[hits], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    owners = block.owner[entries]
    run = np.arange(least)
    for k in np.unique(owners).tolist():
        mine = owners == k
        reach = np.unique(block.place[entries[mine]][:, None] + run)
        if len(reach) >= coverage * len(block.items[k]):
            places = np.unique(starts[mine][:, None] + run)
            yield k, np.insert(codes[places], np.nonzero(np.diff(places) > 1)[0] + 1, 0)


def query(spark, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
