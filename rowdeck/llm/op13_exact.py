r"""Exact dedup by deterministic block naming, with DataFrame functions only.

A normalised text is cut into blocks of ``BLOCK`` bytes. The distinct blocks of the corpus are
sorted, and the place in that order is the block's integer name: equal blocks have equal names,
different blocks different ones. Then adjacent names are paired, distinct pairs are sorted
and named in the same way, until each document has one name. ``(level, name)`` identifies a
text without any chance of a collision; the SHA-256 in the result is only reported.

Block contents are exchanged once, as distinct blocks with map-side combine. Documents learn
their names through a 64-bit print of each block. Prints under which two different blocks were
found are listed, and blocks with such a print are told apart by their contents.

Every exchange carries distinct values or narrow rows. Names that very many documents
share are few; they are broadcast instead of meeting in one task (``shelf.join_counted``). A level
halves the longest text, so there are ``log2(longest / BLOCK)`` levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rowdeck.llm.common import narrow, table
from rowdeck.llm.shelf import Shelf, join_counted

BLOCK = 1024  # bytes of a block
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with one space for every run of white space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def blocks(documents: DataFrame, block: int, bits: int) -> DataFrame:
    """``(row, doc_id, body, n, i, print, block)``: the blocks of every text, an empty text having one."""
    rows = narrow(documents, doc_id=F.col("doc_id").cast("long"), body=normalised(F.col("text")).cast("binary"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(block)).cast("int")))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.withColumn("block", F.substring(F.col("body"), F.col("i") * F.lit(block) + 1, F.lit(block)))
    print_ = F.xxhash64("block") if bits == 64 else F.pmod(F.xxhash64("block"), F.lit(1 << bits))
    return rows.withColumn("print", print_)


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct ``keys``, how many ``times`` each occurs, and its integer ``name``.

    Distinct keys are dealt to tasks by hash and sorted there; a name is the task and the place in
    it. Write the result before use: names are fixed only within one run of a job.
    """
    distinct = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identified(documents: DataFrame, shelf: Shelf, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """``(row, doc_id, sha, level, name)`` of every row; ``(level, name)`` is equal for equal texts only."""
    names = shelf.put(named(blocks(documents, block, bits), ["print", "block"]).select("print", "name", "times"))
    unsure = shelf.put(names.groupBy("print").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select("print"))
    split = not unsure.isEmpty()

    cut = blocks(documents, block, bits)
    first = F.col("i") == 0
    doc_id, sha = F.when(first, F.col("doc_id")), F.when(first, F.unhex(F.sha2("body", 256)))
    fields = ["row", "i", "n", "print", doc_id.alias("doc_id"), sha.alias("sha")]
    none = F.lit(None).cast("long")
    if split:
        # the same print for several blocks: these few blocks are named apart, by content, from -2 down
        apart = blocks(documents, block, bits).join(unsure, "print", "left_semi")
        apart = shelf.put(named(apart, ["print", "block"]).select("print", "block", (F.lit(-2) - F.col("name")).alias("own")))
        entries = shelf.put(cut.join(apart, ["print", "block"], "left").select(*fields, "own"))
        plain = shelf.put(names.join(unsure, "print", "left_anti"))
        shelf.drop(apart)
    else:
        entries, plain = shelf.put(cut.select(*fields, none.alias("own"))), names

    total, longest = entries.agg(F.count(F.lit(1)), F.max("n")).first()
    steps = entries.select("row", "i", "n", "print", "own")
    found = join_counted(steps.where("own is null").drop("own"), plain, ["print"], "times", total).select("row", "i", "n", "name")
    found = found.unionByName(steps.where("own is not null").select("row", "i", "n", F.col("own").alias("name")))
    level, levels = 0, [shelf.put(found)]
    shelf.drop(names, unsure, *([plain] if split else []))
    while (longest or 0) > 1 << level:
        still = levels[-1].where(F.col("n") > F.lit(1 << level))
        level += 1
        even = F.pmod(F.col("i"), F.lit(2)) == 0
        pairs = still.groupBy("row", "n", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1).cast("long")).alias("b")
        )
        pairs = shelf.put(pairs)
        names = shelf.put(named(pairs, ["a", "b"]))
        count = pairs.count()
        levels.append(shelf.put(join_counted(pairs, names, ["a", "b"], "times", count).select("row", "i", "n", "name")))
        shelf.drop(pairs, names)
    done = [
        found.where((F.col("n") <= F.lit(1 << k)) & (F.col("n") > F.lit((1 << k) // 2))).select("row", F.lit(k).alias("level"), "name")
        for k, found in enumerate(levels)
    ]
    heads = entries.where("i = 0").select("row", "doc_id", "sha")
    result = shelf.put(heads.join(reduce(DataFrame.unionByName, done), "row"))
    shelf.drop(entries, *levels)
    return result


def exact_groups(documents: DataFrame, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` per row of ``documents``.

    Texts are equal when identical after each run of white space became one space; a NULL
    text counts as empty, an empty text equals empty and NULL ones only. Of equal texts the row
    with the smallest doc_id stays; a NULL doc_id comes last, and of rows that share text and
    doc_id one stays, so each group keeps exactly one row. Texts of any length are read
    whole. Other columns are ignored, whatever their names; an empty table gives no rows.
    ``bits`` is the width of the prints; fewer change nothing but the work (for tests).
    """
    shelf = Shelf(documents.sparkSession)
    rows = identified(documents, shelf, block, bits)
    head = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("head")
    groups = shelf.put(rows.groupBy("level", "name").agg(head, F.count(F.lit(1)).alias("times")))
    groups = groups.select("level", "name", "head", "times", F.col("times").alias("group_size"))
    joined = join_counted(rows, groups, ["level", "name"], "times", rows.count())
    return joined.select(
        "doc_id",
        F.col("head.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("head.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def query(spark, folder: str) -> DataFrame:
    """Every document with the one that stays for it."""
    return exact_groups(table(spark, folder, "documents"))


SQL = r"""
with texts as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents
)
select doc_id, min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
    doc_id = min(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
from texts
"""
