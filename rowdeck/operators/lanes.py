"""Lanes: rules that deal positions ``0 .. rows-1`` into numbered lanes.

Each rule is arithmetic on the position, so a row's lane, its rank inside the lane, the
lane's size and the lane's place in the concatenated result are all plain column
expressions. Nothing is counted, collected or shuffled to cut a table into lanes.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

from rowdeck.functions import idiv


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


class Lanes:
    """``count`` lanes over ``rows`` positions; subclasses supply the rule."""

    even = True  # lanes are of about one size, so one number of cells fits all

    def __init__(self, rows: int, count: int):
        if count < 1:
            raise ValueError("at least one lane is needed")
        if rows < 0:
            raise ValueError("rows cannot be negative")
        self.rows = rows
        self.count = count

    @property
    def largest(self) -> int:
        """Upper bound on the rows of one lane."""
        return -(-self.rows // self.count)

    def lane(self, pos: Column) -> Column:
        """Lane of a position."""
        raise NotImplementedError

    def rank(self, pos: Column) -> Column:
        """How many earlier positions are in the same lane."""
        raise NotImplementedError

    def start(self, lane: Column) -> Column:
        """Rows in all lower lanes: the lane's offset after concatenation."""
        raise NotImplementedError

    def size(self, lane: Column) -> Column:
        """Rows of the lane."""
        return self.start(lane + 1) - self.start(lane)

    def member(self, lane: Column, rank: Column) -> Column:
        """Position of the lane's ``rank``-th row (inverse of lane and rank)."""
        raise NotImplementedError

    def bounds(self, number: int) -> tuple[int, int] | None:
        """First position of a lane and the one after its last, where lanes are contiguous."""
        return None


class Strided(Lanes):
    """Round robin: position i goes to lane i mod k."""

    def lane(self, pos):
        return F.pmod(pos, _long(self.count))

    def rank(self, pos):
        return idiv(pos, _long(self.count))

    def start(self, lane):
        whole, extra = divmod(self.rows, self.count)
        return lane * _long(whole) + F.least(lane, _long(extra))

    def member(self, lane, rank):
        return rank * _long(self.count) + lane


class Diagonal(Lanes):
    """Round robin that moves one lane further on every lap: (i + i div k) mod k."""

    def lane(self, pos):
        return F.pmod(pos + idiv(pos, _long(self.count)), _long(self.count))

    def rank(self, pos):
        return idiv(pos, _long(self.count))

    def start(self, lane):
        laps, extra = divmod(self.rows, self.count)
        first = laps % self.count

        def reached(low: int, high: int) -> Column:
            return F.greatest(F.least(lane, _long(high)) - _long(low), _long(0))

        # the unfinished last lap fills lanes first, first + 1, ... and may wrap round
        wrapped = max(first + extra - self.count, 0)
        return (
            lane * _long(laps)
            + reached(first, min(first + extra, self.count))
            + reached(0, wrapped)
        )

    def member(self, lane, rank):
        return rank * _long(self.count) + F.pmod(lane - rank, _long(self.count))


class Batches(Lanes):
    """Contiguous lanes of ``size`` positions; the last may be short."""

    def __init__(self, rows: int, size: int, count: int | None = None):
        if size < 1:
            raise ValueError("a batch needs at least one row")
        super().__init__(rows, count or max(1, -(-rows // size)))
        self.batch = size

    @property
    def largest(self):
        return min(self.batch, self.rows)

    def lane(self, pos):
        return idiv(pos, _long(self.batch))

    def rank(self, pos):
        return F.pmod(pos, _long(self.batch))

    def start(self, lane):
        return F.least(lane * _long(self.batch), _long(self.rows))

    def member(self, lane, rank):
        return lane * _long(self.batch) + rank

    def bounds(self, number):
        return min(number * self.batch, self.rows), min((number + 1) * self.batch, self.rows)


def ceil_chunks(rows: int, count: int) -> Batches:
    """``count`` contiguous chunks of ceil(rows / count); late ones short or empty."""
    return Batches(rows, max(1, -(-rows // count)), count)


def merge_blocks(rows: int, k: int) -> Batches:
    """Contiguous blocks of ceil(rows / 2k), so about 2k of them."""
    return Batches(rows, max(1, -(-rows // (2 * k))))


class FloorChunks(Lanes):
    """``count`` contiguous chunks of rows div count; the last also takes the tail."""

    even = False

    @property
    def largest(self):
        return self.rows // self.count + self.rows % self.count

    def lane(self, pos):
        whole = self.rows // self.count
        last = _long(self.count - 1)
        return F.least(idiv(pos, _long(whole)), last) if whole else F.lit(0) * pos + last

    def rank(self, pos):
        return pos - self.start(self.lane(pos))

    def start(self, lane):
        whole = self.rows // self.count
        return F.when(lane >= self.count, _long(self.rows)).otherwise(lane * _long(whole))

    def member(self, lane, rank):
        return self.start(lane) + rank

    def bounds(self, number):
        whole = self.rows // self.count
        return number * whole, self.rows if number == self.count - 1 else (number + 1) * whole


class Balanced(Lanes):
    """Contiguous lanes whose sizes differ by at most one row: (i * k) div rows."""

    def lane(self, pos):
        rows = max(self.rows, 1)
        if rows * self.count < 1 << 63:
            return idiv(pos * _long(self.count), _long(rows))
        # the product needs more than 64 bits: 19 + 19 digits are what a decimal holds
        product = pos.cast("decimal(19,0)") * _long(self.count).cast("decimal(18,0)")
        return idiv(product, _long(rows).cast("decimal(19,0)"))

    def rank(self, pos):
        return pos - self.start(self.lane(pos))

    def start(self, lane):
        # ceil(lane * rows / count) with the whole part apart, so that no product overflows
        whole, extra = divmod(self.rows, self.count)
        return lane * _long(whole) + idiv(lane * _long(extra) + _long(self.count - 1), _long(self.count))

    def member(self, lane, rank):
        return self.start(lane) + rank

    def bounds(self, number):
        return -(-number * self.rows // self.count), -(-(number + 1) * self.rows // self.count)


class HeadTail(Lanes):
    """Lane 0 is the first int(rows * percent / 100) rows, lane 1 the rest."""

    even = False

    def __init__(self, rows: int, percent: int | float | str):
        share = Fraction(str(percent))
        if not 0 <= share <= 100:
            raise ValueError("the percentage must be between 0 and 100")
        super().__init__(rows, 2)
        self.head = int(rows * share / 100)

    @classmethod
    def by_shares(cls, rows: int, head: int | float | str, tail: int | float | str) -> HeadTail:
        """Both percentages given; they must add up to 100."""
        if Fraction(str(head)) + Fraction(str(tail)) != 100:
            raise ValueError("the two percentages must add up to 100")
        return cls(rows, head)

    @property
    def largest(self):
        return max(self.head, self.rows - self.head)

    def lane(self, pos):
        return (pos >= self.head).cast("bigint")

    def rank(self, pos):
        return F.when(pos >= self.head, pos - self.head).otherwise(pos)

    def start(self, lane):
        return F.when(lane == 0, _long(0)).when(lane == 1, _long(self.head)).otherwise(_long(self.rows))

    def member(self, lane, rank):
        return self.start(lane) + rank

    def bounds(self, number):
        return (0, self.head) if number == 0 else (self.head, self.rows)


class Pairs(Lanes):
    """Neighbouring lanes 2i and 2i+1 of another rule, taken together.

    A rule for shuffling pairs: it knows lanes and their starts, not the order of positions
    inside a pair, so operators that need ``rank`` or ``member`` refuse it.
    """

    def __init__(self, inner: Lanes):
        super().__init__(inner.rows, -(-inner.count // 2))
        self.inner = inner

    @property
    def largest(self):
        return min(2 * self.inner.largest, self.rows)

    def lane(self, pos):
        return idiv(self.inner.lane(pos), 2)

    def start(self, lane):
        return self.inner.start(F.least(lane * 2, _long(self.inner.count)))

    def rank(self, pos):
        raise TypeError("paired lanes have no order of positions inside a pair")

    def member(self, lane, rank):
        raise TypeError("paired lanes have no order of positions inside a pair")


def with_lane(df: DataFrame, lanes: Lanes, pos: str = "pos", out: str = "lane") -> DataFrame:
    """Add the lane number as a column."""
    return df.withColumn(out, lanes.lane(F.col(pos)))


def only_lane(df: DataFrame, lanes: Lanes, number: int, pos: str = "pos") -> DataFrame:
    """Rows of one lane; of a contiguous lane by its bounds, which reach the scan."""
    bounds = lanes.bounds(number)
    if bounds is None or not 0 <= number < lanes.count:
        return df.filter(lanes.lane(F.col(pos)) == number)
    return df.filter((F.col(pos) >= bounds[0]) & (F.col(pos) < bounds[1]))


def split(df: DataFrame, lanes: Lanes, pos: str = "pos") -> list[DataFrame]:
    """One DataFrame per lane, lazily filtered: k lanes are k scans, pruned by position where
    lanes are contiguous. To write all lanes at once use ``repartition_lanes``."""
    return [only_lane(df, lanes, number, pos) for number in range(lanes.count)]


def repartition_lanes(df: DataFrame, lanes: Lanes, pos: str = "pos") -> DataFrame:
    """One physical partition per lane, in lane order; for a moderate number of lanes."""
    number = lanes.lane(F.col(pos)).cast("int")
    return df.withColumn("_lane", number).repartitionById(lanes.count, F.col("_lane")).drop("_lane")


def half_rotate(df: DataFrame, lanes: Lanes, pos: str = "pos", out: str = "new_pos") -> DataFrame:
    """Inside each lane the second half comes first. A projection: no row moves."""
    lane = lanes.lane(F.col(pos))
    size = lanes.size(lane)
    half = idiv(size, 2)
    return df.withColumn(
        out, lanes.start(lane) + F.pmod(lanes.rank(F.col(pos)) + size - half, size)
    )


def lane_loads(df: DataFrame, lane: str = "lane", size_bytes: Column | None = None) -> DataFrame:
    """Rows, and bytes if a size expression is given, per lane."""
    measures = [F.count(F.lit(1)).alias("rows")]
    if size_bytes is not None:
        measures.append(F.sum(size_bytes).alias("bytes"))
    return df.groupBy(lane).agg(*measures)


def lane_extremes(loads: DataFrame, lane: str = "lane", load: str = "rows") -> DataFrame:
    """Fullest and emptiest lane; the lowest lane wins a tie."""
    low = F.min(F.struct(F.col(load), F.col(lane)))
    high = F.min(F.struct((-F.col(load)).alias("load"), F.col(lane).alias("lane")))
    return loads.agg(
        high["lane"].alias("fullest"),
        (-high["load"]).alias("max_rows"),
        low[lane].alias("emptiest"),
        low[load].alias("min_rows"),
    )
