"""Substring dedup: paragraph MinHash banding, exact verification, clusters by components.

Two kinds of passages are compared. *Paragraphs* are the lines of a text, of any number of
words: equal ones are one class. Lines of ``SHINGLE`` and more words are also compared as sets of
shingles (shorter ones have no whole shingle, and only equal ones are repeated): classes meet where one of ``BANDS`` bands of ``ROWS`` MinHash values
agrees (a pair at Jaccard 0.8 does with probability 0.99), and every pair that meets is verified
on its exact shingle sets. *Windows* catch passages that begin and end anywhere: runs of
``WINDOW`` words that start at winnowing anchors. An anchor is the smallest five-word hash of
some ``WINDOW`` neighbours, so every passage of ``2 * WINDOW + 3`` words shared by two documents
holds an anchor, with its whole window, that both select; equal windows are equal passages.
Shared windows are seeds: each is extended word by word, up to ``REACH`` words to either side,
as far as any earlier occurrence of the window goes on alike. No more words are needed: where a
run goes on for longer, it holds another shared window there.

Pairs are never emitted all at once within a bucket: every class first meets its bucket's
head; then only classes of still different components meet, and of these only pairs whose
bitmaps leave room for the wanted similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rowdeck.llm.common import arrow_schema, gram_hashes, map_batches, mix, narrow, signed, table, word_hashes
from rowdeck.llm.components import components
from rowdeck.llm.shelf import Shelf, join_counted

BANDS, ROWS = 9, 4
WINDOW = 24
REACH = WINDOW - 1
BITS = 512
HELD = 1 << 16
GROUP = 1 << 16  # code points of the texts that are worked on at once; a longer text comes alone
SHINGLE = 5
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)  # odd, so each permutes the hashes
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Words:
    """Word hashes of a text with the code points at which words start and end, and its line breaks."""

    def __init__(self, text: str | None):
        raw = (text or "").encode().lower()
        self.codes = word_hashes(raw.split())
        data = np.frombuffer(raw, np.uint8)
        blank = np.concatenate([[True], BLANK[data], [True]])
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        change = np.diff(blank.astype(np.int8))
        self.first, self.last = points[np.nonzero(change == -1)[0]], points[np.nonzero(change == 1)[0]]
        breaks = points[np.nonzero(data == 10)[0]]
        self.edges = np.concatenate([[0], np.searchsorted(self.first, breaks), [len(self.codes)]])

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges of the lines that hold words: starts and ends."""
        keep = np.diff(self.edges) > 0
        return self.edges[:-1][keep], self.edges[1:][keep]


class Group(Words):
    """The words of several texts, one after the other; no line goes on from one text into the next."""

    def __init__(self, texts: list[str | None]):
        super().__init__("\n".join(text or "" for text in texts))
        self.bases = np.concatenate([[0], np.cumsum([len(text or "") + 1 for text in texts])])[:-1]  # code points before each text
        self.bounds = np.concatenate([np.searchsorted(self.first, self.bases), [len(self.codes)]])  # words before each text

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The text of each word."""
        return np.searchsorted(self.bounds, places, "right") - 1

    def anchors(self, grams: np.ndarray) -> np.ndarray:
        """The anchors of every text."""
        sizes = np.diff(self.bounds)
        parts = [self.bounds[k] + anchors(grams[self.bounds[k] : self.bounds[k + 1] - SHINGLE + 1], sizes[k]) for k in np.nonzero((sizes >= WINDOW) & (sizes < WINDOW + SHINGLE - 1))[0]]
        if len(grams) >= WINDOW:
            places = _last_smallest(grams, WINDOW)
            inside = np.zeros(len(grams) + SHINGLE, np.int8)  # neighbours that lie in one text
            long = sizes >= WINDOW + SHINGLE - 1
            inside[self.bounds[:-1][long]] = 1
            inside[self.bounds[1:][long] - WINDOW - SHINGLE + 2] -= 1
            places = places[np.cumsum(inside)[: len(places)] > 0]
            places = places[np.diff(places, prepend=-1) != 0]
            parts.append(places[places + WINDOW <= self.bounds[self.owner(places) + 1]])
        return np.sort(np.concatenate([np.empty(0, np.int64), *parts]))


def grouped(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to GROUP code points in all, or of one text."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text or "") > GROUP:
            yield start, k
            start, size = k, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def anchors(grams: np.ndarray, n_words: int) -> np.ndarray:
    """Winnowing: positions of the rightmost smallest hash among any WINDOW neighbouring five-word hashes."""
    if n_words < WINDOW:
        return np.empty(0, np.int64)
    places = _last_smallest(grams, min(WINDOW, len(grams)))
    places = places[np.concatenate([[True], places[1:] != places[:-1]])]
    return places[places + WINDOW <= n_words]


def _last_smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """Of any ``width`` neighbours the place of the rightmost smallest."""
    low, places, reach = grams, np.arange(len(grams)), 1  # least hash of the next ``reach``, and where it is last
    while reach < width:
        step = min(reach, width - reach)
        later = low[step:] <= low[:-step]
        low, places = np.where(later, low[step:], low[:-step]), np.where(later, places[step:], places[:-step])
        reach += step
    return places


def shingles(codes: np.ndarray) -> np.ndarray:
    return np.unique(gram_hashes(codes, SHINGLE))


def band_hashes(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(paragraph, band): one hash per band of the MinHash of the shingles ``grams[start:end]``."""
    ranges, low = np.stack([starts, ends], axis=1).ravel(), []
    step = max(1, HELD // (len(grams) + 1))  # functions at once: memory of HELD numbers, or of one text's shingles
    for seeds in np.split(SEEDS, range(step, len(SEEDS), step)):
        hashed = np.full((len(seeds), len(grams) + 1), np.uint64(2**64 - 1))  # one more, so that a range may end with the text
        np.multiply(grams[None, :], seeds[:, None], out=hashed[:, :-1])
        low.append(np.minimum.reduceat(hashed, ranges, axis=1)[:, ::2])
    low = np.concatenate(low).T.reshape(-1, BANDS, ROWS)
    total = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(starts), BANDS))
    for k in range(ROWS):
        total = mix(total * BASE + low[:, :, k])
    return total


class Runs:
    """Karp-Rabin sums of the scrambled words of a text."""

    def __init__(self, codes: np.ndarray):
        self.back = _powers(INVERSE, len(codes) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes) * _powers(BASE, len(codes)))])

    def digests(self, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
        """64-bit keys of the word runs from ``starts`` to ``ends``: their sums brought to one power, with
        the length and the kind of passage."""
        found = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(mix(found) + (ends - starts).astype(np.uint64) * np.uint64(2) + np.uint64(kind))


def digests(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    return Runs(codes).digests(starts, ends, kind)


def _powers(base: np.uint64, size: int) -> np.ndarray:
    return _first_powers(int(base))[:size] if size <= HELD else _all_powers(base, size)


@cache
def _first_powers(base: int) -> np.ndarray:
    """The first HELD powers, made once per process."""
    powers = _all_powers(np.uint64(base), HELD)
    powers.flags.writeable = False
    return powers


def _all_powers(base: np.uint64, size: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, size - 1), base))])[:size]


def passages(documents: DataFrame) -> DataFrame:
    """``(doc_id, first, last, is_window, key, bands)``: code points, end exclusive; bands for
    paragraphs of at least SHINGLE words. For windows the key with the next REACH words to a side
    (as many as there are), and the code points these take."""
    sides = ("left_whole", "right_whole", "left_far", "right_far")
    columns = ("first", "last", "is_window", "key", *sides, "bands")

    def run(batch):
        for k in range(0, batch.num_rows, 200):
            ids, texts = (batch.column(c).slice(k, 200).to_pylist() for c in ("doc_id", "text"))
            for start, end in grouped(texts):
                words = Group(texts[start:end])
                if len(words.codes):
                    yield found(words, np.array(ids[start:end], np.int64))

    def found(words: Group, ids: np.ndarray) -> dict:
        codes = words.codes
        grams = gram_hashes(codes, SHINGLE)
        at = words.anchors(grams)
        a, b = words.paragraphs()
        banded = b - a >= SHINGLE
        bands = band_hashes(grams, a[banded], b[banded] - SHINGLE + 1) if banded.any() else np.empty((0, BANDS), np.uint64)
        starts, ends = np.concatenate([at, a]), np.concatenate([at + WINDOW, b])
        runs = Runs(codes)
        keys = np.concatenate([runs.digests(at, at + WINDOW, 1), runs.digests(a, b, 0)])
        owner = words.owner(starts)
        low, high = np.maximum(at - REACH, words.bounds[owner[: len(at)]]), np.minimum(at + WINDOW + REACH, words.bounds[owner[: len(at)] + 1])
        wholes = [runs.digests(low, at + WINDOW, 0), runs.digests(at, high, 1)]
        fars = [words.first[at] - words.first[low], words.last[high - 1] - words.last[at + WINDOW - 1]]
        none = np.zeros(len(a), np.int64)
        around = [np.concatenate([x.astype(np.int64, copy=False) if x.dtype != np.uint64 else signed(x), none]) for x in (*wholes, *fars)]
        banded = np.concatenate([np.zeros(len(at), bool), banded])
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(banded, BANDS, 0))]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(signed(bands).ravel()), mask=pa.array(~banded))
        first, last = words.first[starts] - words.bases[owner], words.last[ends - 1] - words.bases[owner]
        return dict(zip(("doc_id", *columns), (ids[owner], first, last, np.arange(len(starts)) < len(at), signed(keys), *around, lists)))

    kinds = "left_whole long, right_whole long, left_far int, right_far int"
    return map_batches(documents, run, f"doc_id long, first int, last int, is_window boolean, key long, {kinds}, bands array<long>")


def repeated_passages(documents: DataFrame, percent: int = 80) -> DataFrame:
    """``(doc_id, first, last, is_window, cluster_id, keeper_id, removed)``: every passage that lies in a
    cluster over two or more documents. Windows come as long as they go on alike (``_extended``).

    A cluster is a component of passages that are equal or, for paragraphs, of Jaccard at least
    ``percent`` on five-word shingles; lines of fewer words must be equal. It keeps the passage of its smallest doc_id
    (``keeper_id``), there the first; the others are removals. Words compare with A-Z lowered.
    NULL texts and texts without words hold no passages; rows with a NULL doc_id are left out;
    repeated rows of a doc_id are one document. Texts of any length are read whole, other columns
    are ignored, an empty table gives no rows.
    """
    docs = narrow(documents, doc_id=F.col("doc_id").cast("long"), text="text").where("doc_id is not null")
    shelf = Shelf(documents.sparkSession)
    every = shelf.put(passages(docs))
    around = ["left_whole", "right_whole", "left_far", "right_far"]
    rows = every.select("key", "doc_id", "first", "last", "is_window", *around)
    # passages equal in two or more documents; keys of windows and of paragraphs are unrelated hashes
    equal = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    lines = every.where("bands is not null")
    classes = lines.groupBy("key").agg(F.min(F.struct("doc_id", "first", "last")).alias("head"), F.max("doc_id").alias("most"))
    classes = shelf.put(classes)
    groups = components(_links(docs, lines, classes, percent, shelf)).select(F.col("node").alias("key"), F.col("component").alias("cluster_id"))
    near = classes.join(groups, "key").select("key", "cluster_id", F.col("head.doc_id").alias("least"), "most")
    members = equal.join(groups, "key", "left_anti").select("key", F.col("key").alias("cluster_id"), "least", "most").union(near)
    spans = members.groupBy("cluster_id").agg(F.min("least").alias("keeper_id"), F.max("most").alias("last_id")).where("keeper_id < last_id")
    members = shelf.put(members.join(spans, "cluster_id").select("key", "cluster_id", "keeper_id"))
    held = shelf.put(rows.join(members, "key").select("doc_id", "first", "last", "is_window", "cluster_id", "keeper_id", *around).distinct())
    shelf.drop(every, classes, members)
    keeper = held.groupBy("cluster_id").agg(F.min(F.when(F.col("doc_id") == F.col("keeper_id"), F.col("first"))).alias("kept"), F.count("*").alias("times"))
    stays = (F.col("doc_id") == F.col("keeper_id")) & (F.col("first") == F.col("kept"))
    found = shelf.put(join_counted(held, shelf.put(keeper), ["cluster_id"], "times", held.count()).select(
        "doc_id", "first", "last", "is_window", "cluster_id", "keeper_id", (~stays).alias("removed"), *around
    ))
    shelf.drop(held)
    return found.where("not is_window").drop(*around).unionByName(_extended(docs, found.where("is_window"), shelf))


def _extended(docs: DataFrame, windows: DataFrame, shelf: Shelf) -> DataFrame:
    """The windows as long as they go on alike: removals with an earlier occurrence, kept ones with
    any other document. If that is not one document to both sides, a row for each, with it as ``keeper_id``."""
    seed = ["doc_id", "first", "cluster_id"]
    ends = _ends(docs, windows, shelf).groupBy(*seed).agg(
        *(F.max(F.when(side, F.col(c))).alias(f"{name}_{c}") for side, name in ((F.col("left"), "left"), (~F.col("left"), "right")) for c in ("far", "other"))
    )
    others = F.array_distinct(F.array("keeper_id", F.coalesce("left_other", "keeper_id"), F.coalesce("right_other", "keeper_id")))
    rows = windows.drop("left_far", "right_far").join(ends, seed, "left").withColumn("with", F.explode(others))
    first = F.col("first") - F.when(F.col("with") == F.col("left_other"), F.col("left_far")).otherwise(0)
    last = F.col("last") + F.when(F.col("with") == F.col("right_other"), F.col("right_far")).otherwise(0)
    return rows.select("doc_id", first.alias("first"), last.alias("last"), "is_window", "cluster_id", F.col("with").alias("keeper_id"), "removed")


def _sides(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows with ``h`` and ``reach``: hashes of the window with its next 1 .. REACH words to the row's side, and
    the code points those words take."""
    names = ("first", "cluster_id", "removed", "left", "source", "most")
    by_doc = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("cuts"))

    def sides(texts: list[str | None], owner: np.ndarray, firsts: np.ndarray, clusters: np.ndarray, to_left: np.ndarray):
        """Per side: which windows, their hashes, the code points and how many words there are."""
        words = Group(texts)
        codes = words.codes
        keys, low, high = clusters.view(np.uint64), words.bounds[owner], words.bounds[owner + 1]
        firsts = words.bases[owner] + firsts
        places = np.searchsorted(words.first, firsts)
        fits = places + WINDOW <= high
        if not fits.any():  # windows of another text under this doc_id
            return
        places = np.where(fits, places, 0)
        fits &= (Runs(codes).digests(places, np.where(fits, places + WINDOW, 0), 1) == keys) & (words.first[places] == firsts)
        for left in (True, False):
            which = np.nonzero(fits & (to_left == left))[0]
            at = places[which]
            size = np.minimum(REACH, at - low[which] if left else high[which] - at - WINDOW)
            total, h, reach = mix(keys[which] + np.uint64(left)), [], []
            edge = words.first[at] if left else words.last[at + WINDOW - 1]
            for k in range(REACH):
                place = np.clip(at - 1 - k if left else at + WINDOW + k, 0, len(codes) - 1)
                total = mix(total * BASE + codes[place])
                h.append(total)
                reach.append(edge - words.first[place] if left else words.last[place] - edge)
            yield which, signed(np.stack(h, 1)), np.stack(reach, 1), size

    def packed(which: np.ndarray, doc_ids: np.ndarray, h: np.ndarray, reach: np.ndarray, sizes: np.ndarray, cuts: dict) -> dict:
        inside = np.arange(REACH) < sizes[:, None]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = {"h": pa.ListArray.from_arrays(offsets, pa.array(h[inside])), "reach": pa.ListArray.from_arrays(offsets, pa.array(reach[inside].astype(np.int32)))}
        return {"doc_id": doc_ids, **{c: cuts[c][which] for c in names}, **lists}

    def run(batch):
        lists = batch.column("cuts")
        cuts = {c: x.to_numpy(zero_copy_only=False) for c, x in zip(names, lists.flatten().flatten())}
        bounds = lists.offsets.to_numpy()
        bounds = bounds - bounds[0]
        ids = batch.column("doc_id").to_numpy()
        for k in range(0, batch.num_rows, 1000):
            texts = batch.column("text").slice(k, 1000).to_pylist()
            for start, end in grouped(texts):
                low, high = bounds[k + start], bounds[k + end]
                owner = np.repeat(np.arange(end - start), np.diff(bounds[k + start : k + end + 1]))
                for which, *found in sides(texts[start:end], owner, *(cuts[c][low:high] for c in ("first", "cluster_id", "left"))):
                    yield packed(which + low, ids[k + start + owner[which]], *found, cuts)

    kinds = "doc_id long, first int, cluster_id long, removed boolean, left boolean, source boolean, most long, h array<long>, reach array<int>"
    return map_batches(docs.join(by_doc, "doc_id").select("doc_id", "text", "cuts"), run, kinds)


def _ends(docs: DataFrame, windows: DataFrame, shelf: Shelf) -> DataFrame:
    """``(doc_id, first, cluster_id, left, far, other)``: the code points to add to that side, and the
    document that shares most there; sides where no word goes on alike have no row.

    Occurrences with all REACH words alike are grouped first; the earliest of a group stands for it. These
    are sorted by the hashes of their next 1 .. REACH words, over ranges, so that those that share words lie
    side by side however many of them a cluster holds. A sorted batch finds by itself what its rows share
    with each other (``_shared``). What goes on beyond it shares words with its first or its last row: of
    these two rows every batch tells, for each number of words, the earliest and latest document, which are
    put together over all batches (``_beyond``).
    """
    own = F.struct("doc_id", "first")
    seed = ["doc_id", "first", "cluster_id", "removed", "left"]
    both = [F.struct(F.lit(x).alias("left"), F.col(f"{n}_whole").alias("whole"), F.col(f"{n}_far").alias("far")) for x, n in ((True, "left"), (False, "right"))]
    sides = windows.select("doc_id", "first", "cluster_id", "removed", F.inline(F.array(*both)))
    groups = sides.groupBy("whole").agg(F.min(own).alias("least"), F.max("doc_id").alias("top"))
    more = F.when(F.col("removed"), F.col("least") < own).otherwise(F.col("top") > F.col("doc_id"))
    sides = shelf.put(sides.join(groups, "whole").drop("whole").withColumn("more", more))
    other = F.when(F.col("removed"), F.col("least.doc_id")).otherwise(F.col("doc_id"))
    done = sides.where("more").select(*seed, "far", other.alias("other"))
    # alone in its cluster a row has nobody to meet
    first = sides.where(F.col("least") == own).select(*seed, F.col("more").alias("source"), F.col("top").alias("most"))
    several = first.groupBy("cluster_id", "left").count().where("count > 1").drop("count")
    state = shelf.put(_sides(docs, first.join(several, ["cluster_id", "left"])).where("size(h) > 0"))
    ordered = state.withColumn("h0", F.get("h", F.lit(0))).repartitionByRange("h0", "h").sortWithinPartitions("h0", "h").drop("h0")
    met = shelf.put(_shared(ordered))
    shelf.drop(state)
    found = _beyond(met)
    return done.union(found.select(*seed, "far", "other")).drop("removed")


def _shared(state: DataFrame) -> DataFrame:
    """Of rows in the order of ``h``: per row the most words it shares within its batch and with whom, and how
    many with the batch's first and last row; and a row per batch that describes these two."""
    kinds = (
        "chunk long, doc_id long, first int, cluster_id long, removed boolean, left boolean, reach array<int>, words int, other long, "
        "before int, after int, at_end array<boolean>, depth array<int>, probe array<long>, least_doc array<long>, least_first array<int>, top array<long>"
    )
    arrow = arrow_schema(kinds)

    def filled(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in arrow], schema=arrow)

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            h = batch.column("h")
            sizes = np.diff(h.offsets.to_numpy())
            hashes = np.zeros((len(sizes), REACH), np.int64)
            hashes[np.arange(REACH) < sizes[:, None]] = h.flatten().to_numpy()
            doc, first, most = (batch.column(c).to_numpy() for c in ("doc_id", "first", "most"))
            removed = batch.column("removed").to_numpy(zero_copy_only=False)
            words, other, before, after, ends = common_runs(hashes, sizes, doc, first, most, removed)
            kept = ~batch.column("source").to_numpy(zero_copy_only=False)
            rows = batch.filter(pa.array(kept))
            if kept.any():
                names = ("doc_id", "first", "cluster_id", "removed", "left", "reach")
                yield filled(
                    rows.num_rows, chunk=np.full(rows.num_rows, part + number), **{c: rows.column(c) for c in names},
                    words=words[kept], other=other[kept], before=before[kept], after=after[kept],
                )
            yield filled(1, chunk=[part + number], **{c: [list(x)] for c, x in zip(("at_end", "depth", "probe", "least_doc", "least_first", "top"), zip(*ends))})

    return state.mapInArrow(run, kinds)


def common_runs(hashes: np.ndarray, sizes: np.ndarray, doc: np.ndarray, first: np.ndarray, most: np.ndarray, removed: np.ndarray) -> tuple:
    """Sorted rows of ``sizes`` hashes each: the most words that a removed row shares with an earlier
    document (or place), a kept one with a later one, and the earliest document that does (itself for a kept
    one); the words shared with the first and with the last row; and, for every number of words of these two,
    ``(at_end, depth, hash, earliest doc_id, its first, latest doc_id)`` of the rows that share them."""
    column = np.arange(hashes.shape[1])

    def alike(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        same = (x == y) & (column < np.minimum(m, n)[:, None])
        return np.logical_and.accumulate(same, axis=1).sum(1)

    n = len(sizes)
    near = np.concatenate([[-1], alike(hashes[1:], hashes[:-1], sizes[1:], sizes[:-1])])
    before = alike(hashes, hashes[:1], sizes, sizes[:1])
    after = alike(hashes, hashes[-1:], sizes, sizes[-1:])
    order = np.lexsort((first, doc))
    new = np.concatenate([[False], (np.diff(doc[order]) != 0) | (np.diff(first[order]) != 0)])
    rank, at = np.empty(n, np.int64), np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    at[rank] = np.arange(n)  # a row of each rank
    words, other, ends = np.zeros(n, np.int32), np.where(removed, -1, doc), []
    for k in range(1, int(sizes.max()) + 1):
        long = np.nonzero(sizes >= k)[0]
        starts = np.nonzero(near[long] < k)[0]
        least, top = np.minimum.reduceat(rank[long], starts), np.maximum.reduceat(most[long], starts)
        for at_end, edge, run in ((False, 0, 0), (True, n - 1, -1)):
            if sizes[edge] >= k:
                row = at[least[run]]
                ends.append((at_end, k, hashes[edge, k - 1], doc[row], first[row], top[run]))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(long))))
        up = np.where(removed[long], least[run] < rank[long], top[run] > doc[long])
        words[long[up]] = k
        earlier = long[up & removed[long]]
        other[earlier] = doc[at[least[run[up & removed[long]]]]]
    return words, other, before, after, ends


def _beyond(met: DataFrame) -> DataFrame:
    """The rows of ``_shared`` with ``far`` and ``other``, over all batches."""
    told = met.where("probe is not null").select("chunk", F.inline(F.arrays_zip("at_end", "depth", "probe", "least_doc", "least_first", "top")))
    whole = told.groupBy("probe").agg(F.min(F.struct(F.col("least_doc").alias("doc_id"), F.col("least_first").alias("first"))).alias("least"), F.max("top").alias("top"))
    told = told.select("chunk", "at_end", "depth", "probe").join(whole, "probe")
    entry = F.struct("depth", "least", "top")
    info = told.groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.when(~F.col("at_end"), entry))).alias("head"), F.sort_array(F.collect_list(F.when(F.col("at_end"), entry))).alias("tail")
    )
    rows = met.where("probe is null").drop("at_end", "depth", "probe", "least_doc", "least_first", "top")
    inside = rows.where("before = 0 and after = 0").drop("before", "after")
    touch = "size(filter(slice({0}, 1, {1}), x -> if(removed, x.least < struct(doc_id, first), x.top > doc_id)))"
    edge = rows.where("before > 0 or after > 0").join(info, "chunk")
    edge = edge.withColumns({"a": F.expr(touch.format("head", "before")), "b": F.expr(touch.format("tail", "after"))})
    most = F.greatest("words", "a", "b")
    # a run of so many words that the first (last) row shares is the whole run; else it lies inside the batch
    other = F.when(F.col("a") == most, F.get("head", most - 1)["least"]["doc_id"]).when(F.col("b") == most, F.get("tail", most - 1)["least"]["doc_id"]).otherwise(F.col("other"))
    other = F.when(F.col("removed"), other).otherwise(F.col("doc_id"))
    edge = edge.select(*inside.drop("words", "other").columns, most.alias("words"), other.alias("other"))
    every = inside.unionByName(edge).where("words > 0")
    return every.withColumn("far", F.get("reach", F.col("words") - 1)).drop("reach", "words", "chunk")


def _links(docs: DataFrame, lines: DataFrame, classes: DataFrame, percent: int, shelf: Shelf) -> DataFrame:
    """Verified pairs of paragraph classes that settle the components."""
    entries = lines.select("key", "bands").dropDuplicates(["key"]).select("key", F.explode("bands").alias("band"))
    # one exchange of two longs per entry; classes alone in their bucket go no further
    order = Window.partitionBy("band").orderBy("key")
    entries = entries.withColumns({"top": F.first("key").over(order), "next": F.lead("key").over(order)})
    shared = shelf.put(entries.where("key <> top or next is not null").select("band", "key", "top"))
    first = shelf.put(shared.where("key <> top").select(F.col("top").alias("a"), F.col("key").alias("b")).distinct())
    wanted = shared.select("key").distinct().join(classes, "key")
    places = shelf.put(wanted.select("key", F.col("head.doc_id").alias("doc_id"), F.col("head.first").alias("first"), F.col("head.last").alias("last")))
    sets = shelf.put(_sets(docs, places))
    found = shelf.put(_verified(sets, first, percent))
    names = components(found).select(F.col("node").alias("key"), "component")
    spread = shelf.put(shared.join(names, "key", "left").select("band", "key", F.coalesce("component", "key").alias("component")))
    sizes = spread.groupBy("band", "component").count()
    mixed = sizes.groupBy("band").agg(F.count("*").alias("parts"), F.max(F.struct("count", "component")).alias("m")).where("parts > 1")
    named = shelf.put(spread.join(mixed, "band").select("band", "key", "component", (F.col("component") == F.col("m.component")).alias("main")))
    shelf.drop(spread)
    full = named.join(sets.select("key", "n", "bits"), "key")
    x, y = full.where("not main").alias("x"), full.alias("y")
    apart = (F.col("x.component") != F.col("y.component")) & (F.col("y.main") | (F.col("x.key") < F.col("y.key")))
    # bitmaps that differ in d bits share at most (m + n - d) / 2 shingles
    differ = F.expr("aggregate(zip_with(x.bits, y.bits, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)")
    total = F.col("x.n") + F.col("y.n")
    near = (100 + percent) * (total - differ) >= 2 * percent * total
    second = x.join(y, (F.col("x.band") == F.col("y.band")) & apart & near)
    second = second.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    links = shelf.put(found.union(_verified(sets, second.join(first, ["a", "b"], "left_anti"), percent)))
    shelf.drop(shared, first, places, sets, found, named)
    return links


def _sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Shingle sets of the paragraphs at the given places."""
    by_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("key", "first", "last")).alias("cuts"))

    def run(batch):
        rows: dict[str, list] = {"key": [], "s": [], "n": [], "bits": []}
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
            for cut in cuts:
                words = text[cut["first"] : cut["last"]].encode().lower().split()
                rows["key"].append(cut["key"])
                found = shingles(word_hashes(words))
                rows["s"].append(found.tobytes())
                rows["n"].append(len(found))
                rows["bits"].append(bitmap(found))
        yield rows

    joined = docs.join(by_doc, "doc_id").select("text", "cuts")
    return map_batches(joined, run, "key long, s binary, n int, bits array<long>").dropDuplicates(["key"])


def bitmap(found: np.ndarray) -> np.ndarray:
    """Which of BITS cells the shingles fall in."""
    flags = np.zeros(BITS, np.uint8)
    flags[(found % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(flags).view(np.int64)


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    def run(batch):
        kept: dict[str, list] = {"a": [], "b": []}
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * common >= percent * (len(p) + len(q) - common):
                kept["a"].append(a)
                kept["b"].append(b)
        yield kept

    left, right = sets.select(F.col("key").alias("a"), F.col("s").alias("x")), sets.select(F.col("key").alias("b"), F.col("s").alias("y"))
    return map_batches(pairs.join(left, "a").join(right, "b"), run, "a long, b long")


def merged(first: np.ndarray, last: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last of the stretches of every row, overlapping and touching ones put together; the
    stretches of row k are those from ``bounds[k]`` to ``bounds[k + 1]``, in order."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    reached = np.maximum.accumulate(last + (row << 32))  # those of later rows lie behind all of earlier ones
    (starts,) = np.nonzero(np.concatenate([[True], first[1:] + (row[1:] << 32) > reached[:-1]])[: len(row)])
    ends = np.append(starts[1:], len(row))[: len(starts)] - 1
    return row[starts], first[starts], reached[ends] - (row[ends] << 32)


def removals(found: DataFrame) -> DataFrame:
    """Per document that shares a passage: ``(doc_id, n_passages, n_removed, removed_chars, spans,
    keeper_ids)``; ``spans`` are the removed stretches, overlaps merged, as ``start:end`` joined by
    commas; ``keeper_ids`` the documents that keep what this one shares."""
    by_doc = found.groupBy("doc_id").agg(
        F.count("*").alias("n_passages"),
        F.sum(F.col("removed").cast("long")).alias("n_removed"),
        F.sort_array(F.collect_set(F.when(F.col("removed"), F.struct("first", "last")))).alias("cuts"),
        F.sort_array(F.collect_set("keeper_id")).alias("keeper_ids"),
    )

    def run(batch):
        lists = batch.column("cuts")
        bounds = lists.offsets.to_numpy()
        row, first, last = merged(*(x.to_numpy().astype(np.int64) for x in lists.flatten().flatten()), bounds - bounds[0])
        sizes = np.bincount(row, last - first, batch.num_rows).astype(np.int64)
        texts = [f"{a}:{b}" for a, b in zip(first.tolist(), last.tolist())]
        ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
        spans = [",".join(texts[a:b]) for a, b in zip(ends, ends[1:])]
        yield {**{c: batch.column(c) for c in ("doc_id", "n_passages", "n_removed", "keeper_ids")}, "removed_chars": sizes, "spans": spans}

    return map_batches(by_doc, run, "doc_id long, n_passages long, n_removed long, removed_chars long, spans string, keeper_ids array<long>")


def query(spark, folder: str) -> DataFrame:
    return removals(repeated_passages(table(spark, folder, "documents")))
