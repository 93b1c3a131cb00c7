"""Is the output a proper reordering of the input? Every answer is an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowdeck.functions import idiv
from rowdeck.functions.hashing import PRINT, row_draw
from rowdeck.operators.pairing import missing_elements

CHUNK_ROWS = 1 << 15  # positions compared in one window
MEASURES = ("a", "b", "moved", "descents", "bad", "repeated", "one_sided", "unequal")


def value_report(original: DataFrame, shuffled: DataFrame, value: str) -> DataFrame:
    """One row: ``n``, ``n_out``, ``one_sided`` and ``unequal`` value counts.

    Both sides are counted per value in one aggregate with a map-side part, so a value
    that fills a third of the table is a third of a row per task, not a hot key.
    """
    sides = original.select(F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(
        shuffled.select(F.col(value).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    counts = sides.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return counts.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("n_out"),
        F.count_if((F.col("a") > 0) != (F.col("b") > 0)).alias("one_sided"),
        F.count_if(F.col("a") != F.col("b")).alias("unequal"),
    )


def verify_set(original: DataFrame, shuffled: DataFrame, value: str) -> DataFrame:
    """Same distinct values on both sides (blind to duplicates)."""
    return value_report(original, shuffled, value).select((F.col("one_sided") == 0).alias("set_ok"))


def verify_multiset(original: DataFrame, shuffled: DataFrame, value: str) -> DataFrame:
    """Same values, each as often."""
    return value_report(original, shuffled, value).select((F.col("unequal") == 0).alias("multiset_ok"))


PRINT_BITS = 22  # of a word of a fingerprint: sums of 2^41 rows stay within 64 bits


def _sums(pairs: list[tuple[str, DataFrame, list[str]]]) -> list[Column]:
    """Per named fingerprint, what to sum on the rows of a side: six words of two 64-bit hashes."""
    words = []
    for name, df, columns in pairs:
        for seed in (0, 1):
            hashed = row_draw(df, PRINT, seed, columns)
            for k in range(3):
                word = F.shiftrightunsigned(hashed, k * PRINT_BITS).bitwiseAND(F.lit((1 << PRINT_BITS) - 1))
                words.append(word.alias(f"{name}{3 * seed + k}"))
    return words


def _fingerprints(original: DataFrame, shuffled: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    """One row: ``n``, ``n_out``, and per part the arrays ``<part>_in`` and ``<part>_out``.

    A fingerprint is a sum over rows, so neither order nor partitioning matters, and each table
    is read once, in tasks that hand on one row each.
    """
    sides = []
    for df, side in ((original, 0), (shuffled, 1)):
        words = _sums([(name, df, columns) for name, columns in parts.items()])
        sides.append(df.select(F.lit(side).alias("side"), *words))
    rows = sides[0].unionByName(sides[1])

    def total(side: int, column: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, column)), F.lit(0).cast("bigint"))

    measures = [total(0, F.lit(1)).alias("n"), total(1, F.lit(1)).alias("n_out")]
    for name in parts:
        for side, suffix in ((0, "in"), (1, "out")):
            measures.append(F.array(*[total(side, F.col(f"{name}{k}")) for k in range(6)]).alias(f"{name}_{suffix}"))
    return rows.agg(*measures)


def fingerprints_equal(left: DataFrame, right: DataFrame, columns: list[str]) -> bool:
    """Whether two tables hold the same rows of the columns, in whatever order; one small job."""
    found = _fingerprints(left, right, {"row": columns}).first()
    return found["n"] == found["n_out"] and found["row_in"] == found["row_out"]


def verify_fingerprint(original: DataFrame, shuffled: DataFrame, value: str) -> DataFrame:
    """Same values, each as often, by fingerprints of 132 bits: ``n``, ``n_out``, both
    fingerprints, ``multiset_ok``.

    Different tables agree with a probability of about 2^-128 unless made for it; for a proof,
    or to find the differing values, use ``verify_multiset`` and ``value_report``. Nearly unique
    values cost no exchange here. NULL is a value; both sides must store values in one type, up to
    the width of integers.
    """
    found = _fingerprints(original, shuffled, {"value": [value]})
    same = (F.col("n") == F.col("n_out")) & (F.col("value_in") == F.col("value_out"))
    told = [F.array_join(F.col(f"value_{side}").cast("array<string>"), ",").alias(f"print_{side}") for side in ("in", "out")]
    return found.select("n", "n_out", *told, same.alias("multiset_ok"))


def fingerprint_audit(original: DataFrame, shuffled: DataFrame, pos: str = "pos", value: str = "value") -> DataFrame:
    """One row with the checks that need no order, in one pass over each table without any
    exchange of rows: ``n``, ``n_out``, ``positions_ok`` (the output holds just the positions of
    the input), ``multiset_ok``, ``identical`` (every position its value), and a verdict as in
    ``shuffle_audit``, where "sorted" is not told from "passed".

    ``elements differ`` here also means a value that is there, but not as often.
    """
    found = _fingerprints(original, shuffled, {"pos": [pos], "value": [value], "both": [pos, value]})
    verdict = (
        F.when(F.col("n") != F.col("n_out"), "length differs")
        .when(~F.col("positions_ok"), "positions wrong")
        .when(~F.col("multiset_ok"), "elements differ")
        .when(F.col("identical"), "identical")
        .otherwise("passed")
    )
    same = {"positions_ok": "pos", "multiset_ok": "value", "identical": "both"}
    checked = found.select("n", "n_out", *[(F.col(f"{part}_in") == F.col(f"{part}_out")).alias(name) for name, part in same.items()])
    return checked.withColumn("verdict", verdict)


def verify_length(original: DataFrame, shuffled: DataFrame, value: str) -> DataFrame:
    """Same distinct values and same length."""
    report = value_report(original, shuffled, value)
    return report.select(
        "n", "n_out", ((F.col("one_sided") == 0) & (F.col("n") == F.col("n_out"))).alias("length_ok")
    )


def verify_elements(original: DataFrame, shuffled: DataFrame, value: str) -> DataFrame:
    """One row: how many input rows have no equal value in the output."""
    missing = missing_elements(original.select(value), shuffled.select(value), value)
    return missing.agg(F.count(F.lit(1)).alias("missing")).withColumn("all_present", F.col("missing") == 0)


def _by_position(sides: DataFrame) -> DataFrame:
    """One row per position of ``(p, v, side)``: how many input (``a``) and output rows (``b``) it has,
    and their values ``av`` and ``bv``. Rows are combined before they are exchanged, so however many
    rows claim one position, or have none (NULL), a task hands on one of them."""
    output = F.col("side") == 1
    return sides.groupBy("p").agg(
        F.count_if(~output).alias("a"),
        F.count_if(output).alias("b"),
        F.first(F.when(~output, F.col("v")), ignorenulls=True).alias("av"),
        F.first(F.when(output, F.col("v")), ignorenulls=True).alias("bv"),
    )


def _with_descents(positions: DataFrame, plain: Column) -> DataFrame:
    """Add ``descents``: 1 where the output's value is below that of the position before, 0 elsewhere.
    Only ``plain`` positions count.

    Positions meet in chunks of consecutive ones, in one exchange; the last of a chunk is repeated at
    the head of the next one, so that neighbours across the border are compared too.
    """
    border = F.pmod(F.col("p"), F.lit(CHUNK_ROWS)) == CHUNK_ROWS - 1
    copies = F.when(border, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = positions.withColumn("plain", plain).withColumn("ahead", F.explode(copies))
    rows = rows.withColumn("chunk", idiv(F.col("p"), CHUNK_ROWS) + F.col("ahead"))
    order = Window.partitionBy("chunk").orderBy("p")
    lags = {f"{name}1": F.lag(name).over(order) for name in ("p", "bv", "plain")}
    rows = rows.withColumns(lags).filter(F.col("ahead") == 0)
    fell = F.col("plain") & F.col("plain1") & (F.col("p1") == F.col("p") - 1) & (F.col("bv1") > F.col("bv"))
    return rows.withColumn("descents", _flag(fell))


def _sides(original: DataFrame | None, shuffled: DataFrame, pos: str, value: str) -> DataFrame:
    output = shuffled.select(F.col(pos).alias("p"), F.col(value).alias("v"), F.lit(1).alias("side"))
    if original is None:
        return output
    return original.select(F.col(pos).alias("p"), F.col(value).alias("v"), F.lit(0).alias("side")).unionByName(output)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def position_report(original: DataFrame, shuffled: DataFrame, pos: str, value: str) -> DataFrame:
    """One row: ``pairs`` of equal position, how many ``moved``, ``descents`` (neighbours of
    the output in falling order), output rows at ``bad`` positions, which the input does not have, and on
    ``repeated`` ones. Positions that several output rows claim are left out of the first three."""
    once = (F.col("a") > 0) & (F.col("b") == 1)
    rows = _with_descents(_by_position(_sides(original, shuffled, pos, value)), once)
    repeated = F.when((F.col("a") > 0) & (F.col("b") > 1), F.col("b") - 1).otherwise(0)
    rows = rows.select(
        _flag(F.col("plain")).alias("pairs"),
        _flag(F.col("plain") & ~F.col("av").eqNullSafe(F.col("bv"))).alias("moved"),
        "descents",
        F.when(F.col("a") == 0, F.col("b")).otherwise(0).alias("bad"),
        repeated.alias("repeated"),
    )
    return rows.agg(*[_total(name) for name in ("pairs", "moved", "descents", "bad", "repeated")])


def inversions(table: DataFrame, pos: str, value: str) -> DataFrame:
    """One row: neighbours in falling order (zero means sorted). The table is read once; positions that
    several rows claim have no neighbours."""
    rows = _with_descents(_by_position(_sides(None, table, pos, value)), F.col("b") == 1)
    return rows.agg(_total("descents").alias("inversions"))


def shuffle_percentage(original: DataFrame, shuffled: DataFrame, pos: str, value: str) -> DataFrame:
    """One row: share of the original's positions that do not hold their value now, be it that
    they hold another or none. NULL for an empty table. Whether positions are right is for
    ``shuffle_audit`` to say.
    """
    before = original.select(F.col(pos).alias("_p"), F.col(value).alias("_a"))
    after = shuffled.select(F.col(pos).alias("_q"), F.col(value).alias("_b"))
    kept = before.join(after, (F.col("_p") == F.col("_q")) & F.col("_a").eqNullSafe(F.col("_b")), "left_semi")
    sides = before.select(F.lit(1).alias("n"), F.lit(1).alias("moved")).unionAll(kept.select(F.lit(0), F.lit(-1)))
    return sides.agg(_total("n"), _total("moved")).withColumn(
        "pct_moved", F.try_divide(F.col("moved") * F.lit(100.0), F.col("n"))
    )


def shuffle_audit(original: DataFrame, shuffled: DataFrame, pos: str = "pos", value: str = "value") -> DataFrame:
    """One row with every measure and a verdict: the first check that fails, in the order
    length, positions, elements, identical, sorted, or else ``passed``. ``bad_positions`` are
    NULL or outside ``0 .. n-1``, ``repeated`` ones held by an earlier row already; where there are
    any, ``pct_moved`` and ``inversions`` leave those rows out.

    Both tables are read twice, once by position and once to count each value; rows on NULL, outside
    or crowded positions are combined before any exchange. ``fingerprint_audit`` answers most of
    this in one read without an exchange of rows.
    """
    by_position = position_report(original, shuffled, pos, value)
    by_value = value_report(original, shuffled, value).withColumnsRenamed({"n": "a", "n_out": "b"})
    parts = [part.select(*[F.col(c) if c in part.columns else F.lit(0).alias(c) for c in MEASURES]) for part in (by_position, by_value)]
    totals = parts[0].unionByName(parts[1]).agg(*[_total(name) for name in MEASURES])
    verdict = (
        F.when(F.col("a") != F.col("b"), "length differs")
        .when((F.col("bad") > 0) | (F.col("repeated") > 0), "positions wrong")
        .when(F.col("one_sided") > 0, "elements differ")
        .when(F.col("moved") == 0, "identical")
        .when(F.col("descents") == 0, "sorted")
        .otherwise("passed")
    )
    return totals.select(
        F.col("a").alias("n"),
        F.col("b").alias("n_out"),
        (F.col("one_sided") == 0).alias("set_ok"),
        (F.col("unequal") == 0).alias("multiset_ok"),
        F.try_divide(F.col("moved") * F.lit(100.0), F.col("a")).alias("pct_moved"),
        F.col("descents").alias("inversions"),
        F.col("bad").alias("bad_positions"),
        F.col("repeated"),
        verdict.alias("verdict"),
    )
