"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersections.

Documents are sets of hashed word shingles. Equal sets are one class. Shingles get a global
order, commonest last (the counts of the commonest ones go out in a table of fixed size, and those of all
others as counts per hash cell, so a passage in a third of all documents sorts to the end), and a class offers only the first few of its shingles, the
prefix that two sets over the threshold must share. A *tile* holds the classes that offer one
shingle and lie in one band of set sizes. Inside a tile two steps find the links:

1. every class meets the tile's head (the one with the fewest rarer shingles); links found
   so join most of a group of copies in as many comparisons as it has members;
2. classes of a tile that are still in different components meet each other. Pairs inside
   one component are skipped: they cannot change it, and so are tiles of two classes, which have met.

A pair must pass the position bound of the prefix, then the bitmap bound (two bitmaps that
differ in d bits share at most (m + n - d) / 2 shingles), then the exact intersection of the
sorted arrays. In tiles of more than LARGE classes the bitmaps lie beside the classes, so that only pairs
within both bounds become rows. No link between different sets is lost, so the components are exact.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowdeck.llm.common import lean, map_batches, mix, narrow, shingle_set, signed, slices, table
from rowdeck.llm.components import components
from rowdeck.llm.shelf import Shelf

KEPT = 1 << 18  # common shingles whose counts are known everywhere
TOLD = 1 << 15  # common shingles a task tells of at most
HELD = 1 << 21  # shingles a task holds before it counts them
CELL_BITS, SLICE_CELLS = 20, 1 << 12  # hash cells whose counts order the shingles that are not common; cells in a row
ADDERS = 16  # tasks that add up the slices of all tasks
HOT_SHARE, HOT_ROWS, SALTS = 1024, 1000, 64  # a shingle in more than one of so many documents is hot
SIGNATURE_BITS = 1024
PAIRS = 64  # pairs of sets held as Python objects at once
LARGE = 64  # classes of a tile above which bitmaps are compared inside the join


def similar_sets(documents: DataFrame, n: int = 3, percent: int = 90, kept: int = KEPT, cell_bits: int = CELL_BITS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, class_id)``, one row per document.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of ``n``-word
    shingles; ``component_id`` is the smallest doc_id reachable by links, ``class_id`` the
    smallest with the same set. NULL, empty or wordless texts have no shingles, link with
    nothing and keep their own doc_id. A text of fewer than ``n`` words is one shingle.
    Repeated rows of a doc_id give one row each with the same component; rows with a NULL doc_id keep
    a NULL component and are compared with nothing. Texts of any length are read whole. Other columns
    are ignored, an empty table gives none. ``kept`` bounds the table of common shingles and
    ``cell_bits`` that of the cells, which changes the work, not the result.
    """
    docs = narrow(documents, doc_id=F.col("doc_id").cast("long"), text="text")
    shelf = Shelf(documents.sparkSession)
    digests = shelf.put(_digests(docs, n, cell_bits))
    counts = (*_common(digests, kept), _cells(digests, cell_bits))
    sets = digests.where("digest is not null").select("doc_id", "n_shingles", "digest")
    filled = sets.where("n_shingles > 0 and doc_id is not null")
    classes = shelf.put(filled.groupBy("digest").agg(F.min("doc_id").alias("class_id")))
    members = filled.join(classes, "digest").select("doc_id", "digest", "class_id")
    heads = members.where("doc_id = class_id").select("doc_id").distinct()
    hot = max(HOT_ROWS, sets.count() // HOT_SHARE)
    offers = _offers(docs, n, percent, counts, hot).where("n > 0 and doc is not null")
    offers = shelf.put(offers.join(heads.withColumnRenamed("doc_id", "doc"), "doc").dropDuplicates(["doc"]))
    edges = _links(docs, offers, n, percent, shelf)
    groups = components(edges)
    named = classes.join(groups.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "digest", "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    empty = sets.where("n_shingles = 0 or doc_id is null")
    result = (
        filled.join(named, "digest").select("doc_id", "n_shingles", "component_id", "class_id")
        .union(empty.select("doc_id", "n_shingles", F.col("doc_id"), F.col("doc_id")))
    )
    shelf.drop(offers, edges)
    return result


class Common:
    """Shingles that came up most often so far, with counts; rare ones are forgotten when too many are held."""

    def __init__(self):
        self.hashes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.held = np.empty(HELD, np.uint64)  # the system gives the pages as they fill
        self.size = 0

    def add(self, found: np.ndarray) -> None:
        while len(found):
            part = found[: HELD - self.size]
            self.held[self.size : self.size + len(part)] = part
            self.size += len(part)
            found = found[len(part) :]
            if self.size == HELD:
                self.settle()

    def settle(self) -> None:
        """Count what is held, sorted where it lies: copies of it would take several times its memory."""
        held = self.held[: self.size]
        held.sort()
        self.size = 0
        if not len(held):
            return
        self.counts += np.searchsorted(held, self.hashes, "right") - np.searchsorted(held, self.hashes, "left")
        first, last = np.ones(len(held), bool), np.ones(len(held), bool)
        np.not_equal(held[1:], held[:-1], out=first[1:])
        last[:-1] = first[1:]
        places = np.nonzero(first & ~last)[0]
        self._learn(held[places], np.nonzero(last & ~first)[0] - places + 1)
        first &= last
        if len(self.hashes) + np.count_nonzero(first) <= HELD // 2:  # else those that came up once are forgotten anyway
            once = held[first]
            self._learn(once, np.ones(len(once), np.int64))
        elif len(self.hashes):
            keep = self.counts > 1
            self.hashes, self.counts = self.hashes[keep], self.counts[keep]
        least = 1
        while len(self.hashes) > HELD // 4:
            least += 1
            keep = self.counts >= least
            self.hashes, self.counts = self.hashes[keep], self.counts[keep]

    def _learn(self, found: np.ndarray, times: np.ndarray) -> None:
        """Take in those of the sorted ``found`` that are not known yet."""
        place = np.searchsorted(self.hashes, found)
        new = np.ones(len(found), bool)
        inside = place < len(self.hashes)
        new[inside] = self.hashes[place[inside]] != found[inside]
        self.hashes, self.counts = np.insert(self.hashes, place[new], found[new]), np.insert(self.counts, place[new], times[new])

    def most(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """At most ``size`` of those that came up twice or more."""
        self.settle()
        order = np.argsort(-self.counts, kind="stable")[:size]
        order = order[self.counts[order] > 1]
        return self.hashes[order], self.counts[order]


def _digests(docs: DataFrame, n: int, cell_bits: int) -> DataFrame:
    """A row per document with its set's size and digest, and per task its most common shingles, and how
    many shingles fell in each hash cell, a byte per cell and in slices."""
    kinds = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("shingle", pa.int64()), ("times", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())]
    arrow = pa.schema(kinds)

    def filled(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in arrow], schema=arrow)

    def run(batches):
        common, shift = Common(), np.uint64(64 - cell_bits)
        cells = np.zeros(1 << cell_bits, np.int64)
        for batch in batches:
            sizes, digests = [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, n)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                common.add(found)
                np.add.at(cells, (found >> shift).astype(np.int64), 1)
            yield filled(len(sizes), doc_id=batch.column("doc_id"), n_shingles=sizes, digest=digests)
        hashes, counts = common.most(TOLD)
        if len(hashes):
            yield filled(len(hashes), shingle=signed(hashes), times=counts)
        if cells.any():
            parts = np.minimum(cells, 255).astype(np.uint8).reshape(-1, min(SLICE_CELLS, len(cells)))
            yield filled(len(parts), slice=range(len(parts)), counts=[part.tobytes() for part in parts])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_shingles long, digest binary, shingle long, times long, slice int, counts binary")


def _cells(digests: DataFrame, cell_bits: int) -> np.ndarray:
    """The cells of all tasks added up: 2^cell_bits numbers, whatever the input. A row has few cells, so that
    an Arrow batch of rows of very many tasks stays small."""

    def add_all(kind):
        def run(batches):
            kept: dict[int, np.ndarray] = {}
            for batch in batches:
                for name, part in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                    values = np.frombuffer(part.as_buffer(), kind).astype(np.uint32)
                    kept[name] = kept[name] + values if name in kept else values
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array([x.tobytes() for x in kept.values()], pa.binary())], names=["slice", "counts"])

        return run

    told = "slice int, counts binary"
    tables = digests.where("slice is not null").select("slice", "counts").mapInArrow(lean(add_all(np.uint8)), told)
    rows = tables.repartition(ADDERS, "slice").mapInArrow(lean(add_all(np.uint32)), told).collect()
    total = np.zeros(1 << cell_bits, np.uint32)
    width = min(SLICE_CELLS, len(total))
    for row in rows:
        total[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["counts"], np.uint32)
    return total


def _common(digests: DataFrame, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles, at most ``kept``, sorted by hash, and their counts.

    Every power of two of the counts is taken whole or not at all, so that what reaches the driver is
    bounded whatever the number of tasks.
    """
    summed = digests.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    powers = summed.groupBy(F.floor(F.log2("times")).cast("int").alias("power")).count().collect()
    least, total = None, 0
    for power, count in sorted(map(tuple, powers), reverse=True):
        total += count
        if total > kept:
            break
        least = 1 << power
    rows = summed.where(F.col("times") >= least).toPandas() if least else pd.DataFrame({"shingle": [], "times": []})
    hashes = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["times"].to_numpy(np.int64)[order]


def _ranks(found: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of every shingle that is common, zero for the others."""
    if not len(hashes):
        return np.zeros(len(found), np.int64)
    place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    return np.where(hashes[place] == found, counts[place], 0)


def _prefix_size(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _offers(docs: DataFrame, n: int, percent: int, counts: tuple[np.ndarray, np.ndarray, np.ndarray], hot: int) -> DataFrame:
    """Per class: set size, bitmap, its rarest shingles in the global order, and how many of these, the
    first ones, are in no more than ``hot`` documents."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    shift = np.uint64(64 - int(np.log2(len(counts[2]))))

    def run(batch):
        hashes, times, cells = shared.value
        rows = {"doc": [], "n": [], "bits": [], "cold": [], "prefix": []}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            found = shingle_set(text, n)
            rank = _ranks(found, hashes, times)
            order = np.lexsort((found, cells[(found >> shift).astype(np.int64)], rank))[: _prefix_size(len(found), percent)]
            rows["cold"].append(int((rank[order] <= hot).sum()))
            rows["doc"].append(doc)
            rows["n"].append(len(found))
            rows["bits"].append(_bitmap(found))
            rows["prefix"].append(signed(found[order]))
        yield rows

    return map_batches(docs, run, "doc long, n int, bits array<long>, cold int, prefix array<long>")


def _bitmap(found: np.ndarray) -> np.ndarray:
    """Which cells hold an odd number of the shingles: what two sets share cancels out, however large they are."""
    cells = np.bincount((mix(found) % np.uint64(SIGNATURE_BITS)).astype(np.int64), minlength=SIGNATURE_BITS)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def _needed(m: Column, n: Column, percent: int) -> Column:
    """Fewest common shingles of two sets over the threshold."""
    return F.floor((percent * (m + n) + 99 + percent) / (100 + percent))


def _close(a: str, b: str, percent: int) -> Column:
    """Sizes and prefix positions leave room for the threshold."""
    m, n = F.col(f"{a}.n"), F.col(f"{b}.n")
    room = F.least(m - F.col(f"{a}.i"), n - F.col(f"{b}.i"))
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & (room >= _needed(m, n, percent))


def _bitmaps_close(m: Column, n: Column, x: str, y: str, percent: int) -> Column:
    """Bitmaps leave room for the threshold."""
    differ = sum((F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(SIGNATURE_BITS // 64)), F.lit(0))
    return (m + n - differ) / 2 >= _needed(m, n, percent)


def _links(docs: DataFrame, offers: DataFrame, n: int, percent: int, shelf: Shelf) -> DataFrame:
    """Verified links between classes that settle the components.

    Tiles of a hot shingle are cut by salt: there every class meets the head of its part, and the heads
    of the parts, at most SALTS of them, meet the first of them.
    """
    low = F.floor(F.log2(F.col("n"))).cast("int")
    high = F.floor(F.log2(F.col("n") * 100 / percent + 1e-6)).cast("int")
    bands = F.explode(F.when(low == high, F.array(low)).otherwise(F.array(low, high)))
    entries = offers.select("doc", "n", "cold", F.posexplode("prefix").alias("i", "token")).withColumn("band", bands)
    salt = F.when(F.col("i") < F.col("cold"), 0).otherwise(1 + F.pmod(F.xxhash64("doc"), F.lit(SALTS))).cast("int")
    # one exchange of a few numbers per entry; rows alone in their tile go no further
    place = F.shiftleft(F.col("i").cast("long"), 32) + F.col("n")
    entries = entries.select(F.xxhash64("token", "band").alias("tile"), salt.alias("salt"), "doc", place.alias("place"))
    order = Window.partitionBy("tile", "salt").orderBy("place", "doc")
    entries = entries.withColumns(
        {"next": F.lead("doc").over(order), "third": F.lead("doc", 2).over(order), "rank": F.row_number().over(order), "head": F.first("doc").over(order), "top": F.first("place").over(order)}
    ).where("doc <> head or next is not null or salt > 0")
    more = F.expr("salt > 0 or rank > 2 or third is not null or (rank = 2 and next is not null)")  # not just two classes
    entries = shelf.put(entries.select("tile", "salt", "doc", "place", "head", "top", more.alias("more")))
    parts = Window.partitionBy("tile").orderBy("place", "doc")
    heads = entries.where("salt > 0 and doc = head").select("tile", "doc", "place", F.first("doc").over(parts).alias("head"), F.first("place").over(parts).alias("top"))

    def side(doc: str, place: str) -> Column:
        return F.struct(F.col(doc).alias("doc"), F.shiftright(place, 32).cast("int").alias("i"), F.col(place).bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("n"))

    bits = offers.select("doc", "n", "bits")
    first = entries.drop("salt", "more").unionByName(heads).where("doc <> head")
    first = first.select(side("doc", "place").alias("x"), side("head", "top").alias("h")).where(_close("x", "h", percent))
    first = shelf.put(first.select(F.least("x.doc", "h.doc").alias("a"), F.greatest("x.doc", "h.doc").alias("b")).distinct())
    found = _verified(docs, bits, first, n, percent, shelf)
    names = components(found).select(F.col("node").alias("doc"), "component")

    named = shelf.put(entries.where("more").select("tile", "doc", "place").join(names, "doc", "left").withColumn("component", F.coalesce("component", "doc")))
    shelf.drop(entries)
    sizes = named.groupBy("tile", "component").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("tile").agg(F.count("*").alias("parts"), F.sum("size").alias("all"), F.max(F.struct("size", "component")).alias("m")).where("parts > 1")
    main = F.col("component") == F.col("m.component")
    named_ = shelf.put(named.join(mixed, "tile").select("tile", side("doc", "place").alias("e"), "component", main.alias("main"), (F.col("all") > LARGE).alias("large")))
    shelf.drop(named)

    def apart(rows: DataFrame, *bounds: Column) -> DataFrame:
        x, y = (rows.select("tile", F.col("e").alias(name), F.col("component").alias(f"{name}c"), F.col("main").alias(f"{name}m"), *(F.col(c).alias(f"{name}{c}") for c in rows.columns if c == "bits")) for name in "xy")
        once = (F.col("xc") != F.col("yc")) & (F.col("ym") | (F.col("x.doc") < F.col("y.doc")))
        met = x.where("not xm").join(y, "tile").where(reduce(Column.__and__, bounds, once & _close("x", "y", percent)))
        return met.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))

    large = named_.where("large").join(offers.select(F.col("doc").alias("owner"), "bits"), F.col("e.doc") == F.col("owner"))
    second = apart(named_.where("not large")).union(apart(large, _bitmaps_close(F.col("x.n"), F.col("y.n"), "xbits", "ybits", percent))).distinct()
    second = shelf.put(second.join(first, ["a", "b"], "left_anti"))
    more = _verified(docs, bits, second, n, percent, shelf)
    links = shelf.put(found.union(more))
    shelf.drop(named_, first, second, found, more)
    return links


def _verified(docs: DataFrame, bits: DataFrame, pairs: DataFrame, n: int, percent: int, shelf: Shelf) -> DataFrame:
    """The pairs over the threshold: bitmap bound first, then exact intersection."""
    left = bits.select(F.col("doc").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x"))
    right = bits.select(F.col("doc").alias("b"), "n", F.col("bits").alias("y"))
    near = pairs.join(left, "a").join(right, "b").where(_bitmaps_close(F.col("m"), F.col("n"), "x", "y", percent))
    near = shelf.put(near.select("a", "b"))
    wanted = shelf.put(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct())

    def arrays(batch):
        yield {"doc": batch.column("doc_id"), "s": [shingle_set(text, n).tobytes() for text in batch.column("text").to_pylist()]}

    sets = map_batches(docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), arrays, "doc long, s binary")

    def over(batch):
        kept: dict[str, list] = {"a": [], "b": []}
        for part in slices(iter([batch]), PAIRS):
            for a, b, x, y in zip(*(part.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    kept["a"].append(a)
                    kept["b"].append(b)
        yield kept

    left = sets.select(F.col("doc").alias("a"), F.col("s").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("s").alias("y"))
    links = shelf.put(map_batches(near.join(left, "a").join(right, "b"), over, "a long, b long"))
    shelf.drop(near, wanted)
    return links


def query(spark, folder: str) -> DataFrame:
    return similar_sets(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') as w
    from documents
),
shingles as (
    select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as s
    from words
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
    select a.doc_id as a, b.doc_id as b, count(*) as common
    from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
),
links as (
    select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 90 * (x.n + y.n - common)
),
steps as (select a as u, b as v from links union all select b, a from links),
reach as (
    select distinct u as node, u as seen from steps
    union
    select reach.node, steps.v from reach join steps on steps.u = reach.seen
),
least_seen as (select node, min(seen) as component_id from reach group by node)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id
from words d left join sizes on sizes.doc_id = d.doc_id left join least_seen on node = d.doc_id
"""
