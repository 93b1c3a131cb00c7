r"""Conversation structure repair by a rank-convergence parallel Viterbi.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Its rows may be kept,
given another role or deleted, and empty turns may be inserted; the cheapest such edits are a
shortest path over four states (nothing yet, after ``s``, after ``u``, after ``a``).

All rows are sorted by conversation and turn into ranges, so a long conversation lies in as many
chunks as ranges, and one that holds a third of all rows is worked on by a third of the tasks. A
chunk is one byte per row. Backward costs run from a chunk's end to its start and depend on
what follows only through the cost vector there. Chunks start from a speculative vector at
once. Then a chunk's end vector is compared with the start vector of the next chunk: where they
differ by a constant only, all costs inside differ by that constant and the chunk stands;
else it is run again from the right vector, in a fix-up pass over all such chunks. A vector
asked for by one chunk is tried by the chunks before it as well, so the number of passes is
bounded by the number of different vectors, a handful, not by the number of chunks. The
constants are summed per conversation. The state in which the cheapest path enters each chunk
is stitched in the same way, from the end states of all four entries, and every chunk
traces its part of the least audit by the stitched costs.

Only the last step is sequential by nature: the digest of a repaired conversation. Its rows are
sorted on disk and streamed, with the audit of one conversation in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowdeck.llm.common import map_batches, narrow, table
from rowdeck.llm.shelf import Shelf, join_counted

RETYPE, DELETE, INSERT, BROKEN = 2, 3, 2, 1  # costs of the edits, and of an undeleted truncated row
INFINITE = 1 << 40
Vector = tuple[int, int, int, int]

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The next turn of a user or assistant by state:
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
# Row kinds: forced deletions are "B" (blank) and "=" (duplicate), others the role's initial or "x",
# in upper case where the text is truncated.
DUPLICATE = "="
FORCED = "B" + DUPLICATE


def closed(v: Vector) -> Vector:
    """Cheapest costs when empty turns may be inserted first; two in a row are all that can pay."""
    after_u, after_a = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + after_u), min(v[1], INSERT + after_u), after_u, after_a


END: Vector = closed((0, INFINITE, INFINITE, 0))


def normal(v: Vector) -> tuple[Vector, int]:
    """The vector less its least cost, and that cost: vectors of one normal form differ by a constant."""
    least = min(v)
    return (v[0] - least, v[1] - least, v[2] - least, v[3] - least), least


def kept_state(state: int, initial: str) -> int | None:
    """The state after keeping a row of that initial, None where the grammar forbids it."""
    if initial == "s":
        return 1 if state == 0 else None
    wanted = {"u": 2, "a": 3}.get(initial)
    return wanted if wanted == NEXT[state] else None


def edits(kind: str, after: Vector, state: int) -> Iterator[tuple[str, int, int]]:
    """``(letter, state after the row, cost from here)`` of the edits of a live row, letters in order."""
    initial, broken = kind.lower(), BROKEN if kind.isupper() else 0
    yield "D", state, DELETE + after[state]
    kept = kept_state(state, initial)
    if kept is not None:
        yield "K", kept, broken + after[kept]
    yield "R", NEXT[state], RETYPE + broken + after[NEXT[state]]


@lru_cache(maxsize=None)
def before(kind: str, after: Vector) -> tuple[Vector, int]:
    """Normal form and constant of the costs before a row, by those after it."""
    if kind in FORCED:
        return after, DELETE
    return normal(closed(tuple(min(cost for _, _, cost in edits(kind, after, state)) for state in range(4))))


@lru_cache(maxsize=None)
def step(kind: str, after: Vector, state: int) -> tuple[str, int]:
    """Least letters of the cheapest edits of a row, inserted turns before it included, and the
    state after it. Letters of truncated rows are in lower case, of forced ones the row's kind."""
    if kind in FORCED:
        return kind, state
    costs = closed(tuple(min(cost for _, _, cost in edits(kind, after, s)) for s in range(4)))
    letters = ""
    while True:
        options = [o for o in edits(kind, after, state) if o[2] == costs[state]]
        if options and options[0][0] == "D" or INSERT + costs[NEXT[state]] != costs[state]:
            letter, state, _ = options[0]
            return letters + (letter.lower() if kind.isupper() else letter), state
        letters, state = letters + "I", NEXT[state]


def backward(kinds: str, end: Vector) -> tuple[list[Vector], int]:
    """Normal forms of the costs after every row, the chunk's start first, and the sum of constants."""
    vectors, total = [end], 0
    for kind in reversed(kinds):
        vector, added = before(kind, vectors[-1])
        vectors.append(vector)
        total += added
    return vectors[::-1], total


def trace(kinds: str, vectors: list[Vector], state: int, last: bool) -> tuple[str, int]:
    """The chunk's part of the audit, and the state in which it ends."""
    letters = []
    for kind, after in zip(kinds, vectors[1:]):
        found, state = step(kind, after, state)
        letters.append(found)
    if last:
        letters.append({0: "", 1: "II", 2: "I", 3: ""}[state])
    return "".join(letters), state


def cost_of(audit: str) -> int:
    """The cost of an audit in the letters of ``step``."""
    count = audit.count
    return INSERT * count("I") + DELETE * sum(map(count, "Dd" + FORCED)) + RETYPE * (count("R") + count("r")) + BROKEN * (count("k") + count("r"))


# --- rows -----------------------------------------------------------------------------------

SPACES = " \t\n\v\f\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, print)`` of the rows after damage; ``conv`` is the conv_id as text."""
    key = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" "))
    rows = narrow(conversations, conv=key, turn=F.col("turn").cast("long"), role=F.coalesce("role", F.lit(" ")), text=F.coalesce("text", F.lit(" ")))
    fault = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = rows.withColumn("fault", fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")
    told = F.concat("conv", F.lit("|"), F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("print", F.unhex(F.sha2(told, 256)))


def kind_of(role: Column, text: Column) -> Column:
    """The kind of a row, duplicates aside."""
    initial = F.substring(role, 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    last = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)
    return F.when(last == "", "B").when(last.isin(".", "!", "?"), initial).otherwise(F.upper(initial))


def chunks(rows: DataFrame, shelf: Shelf, parts: int | None) -> DataFrame:
    """``(conv, part, kinds)``: the conversations cut where ranges of the sorted table end."""
    # equal rows are told apart by number, so that ranges can end between them
    keyed = rows.select("conv", "turn", "print", kind_of(F.col("role"), F.col("text")).alias("kind")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("print"), F.col("row")]
    ranges = keyed.repartitionByRange(parts, *order) if parts else keyed.repartitionByRange(*order)
    placed = ranges.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = shelf.put(placed.select("conv", F.shiftright("at", 33).cast("int").alias("part"), "at", "print", "kind"))
    # only values that occur again are joined back to the rows; most occur once
    seen = placed.where("kind <> 'B'").groupBy("print").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times"))
    again = shelf.put(seen.where("times > 1"))
    same = join_counted(placed.where("kind <> 'B'").select("part", "at", "print"), again, ["print"], "times", placed.count())
    none = F.lit(None).cast("string")
    marked = placed.select("part", "at", "conv", "kind").unionByName(
        same.where("at > first").select("part", "at", none.alias("conv"), F.lit(DUPLICATE).alias("kind"))
    )
    marked = marked.repartition("part").sortWithinPartitions("part", "at", F.col("conv").asc_nulls_last())
    schema = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("kinds", pa.string())])

    def run(batches):
        conv, part, kinds = None, None, []
        for batch in batches:
            done = []
            for row_part, row_conv, kind in zip(*(batch.column(c).to_pylist() for c in ("part", "conv", "kind"))):
                if row_conv is None:
                    kinds[-1] = DUPLICATE
                    continue
                if (row_part, row_conv) != (part, conv):
                    if kinds:
                        done.append((conv, part, "".join(kinds)))
                    conv, part, kinds = row_conv, row_part, []
                kinds.append(kind)
            if done:
                yield _batch(done, schema)
        if kinds:
            yield _batch([(conv, part, "".join(kinds))], schema)

    result = shelf.put(marked.select("part", "conv", "kind").mapInArrow(run, "conv string, part int, kinds string"))
    shelf.drop(placed, again)
    return result


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


# --- chunks ---------------------------------------------------------------------------------


WALKED = "conv string, part int, end string, start string"


def _told(vector: Vector) -> str:
    return ",".join(map(str, vector))


def _read(vector: str) -> Vector:
    return tuple(map(int, vector.split(",")))


def _responses(asked: DataFrame) -> DataFrame:
    """Run chunks from the vectors asked of them: ``(conv, part, end, start)``, up to constants."""

    def run(batch):
        starts = [_told(backward(kinds, _read(end))[0][0]) for kinds, end in zip(batch.column("kinds").to_pylist(), batch.column("end").to_pylist())]
        yield {"conv": batch.column("conv"), "part": batch.column("part"), "end": batch.column("end"), "start": starts}

    return map_batches(asked.select("conv", "part", "kinds", "end"), run, WALKED)


def _stitch_backward(responses: pd.DataFrame) -> pd.DataFrame:
    """Walk one conversation from its end: each chunk's right end vector, or, at the first chunk that
    has not been run from it, what it and the chunks before it are to try."""
    known = {(part, end): start for part, end, start in zip(responses["part"], responses["end"], responses["start"])}
    conv, end, rows = responses["conv"].iloc[0], _told(END), []
    for part in sorted(set(responses["part"].tolist()), reverse=True):
        if (part, end) not in known:
            return pd.DataFrame({"conv": [conv], "part": [part], "end": [end], "start": [None]})
        rows.append((conv, part, end, known[part, end]))
        end = known[part, end]
    return pd.DataFrame(rows, columns=["conv", "part", "end", "start"])


def _stitch_forward(found: pd.DataFrame) -> pd.DataFrame:
    """Walk one conversation from its start: the state in which each chunk is entered."""
    state, rows = 0, []
    for conv, part, ends in sorted(zip(found["conv"], found["part"], found["ends"])):
        rows.append((conv, part, state))
        state = int(ends[state])
    return pd.DataFrame(rows, columns=["conv", "part", "state"])


def passes(cut: DataFrame, shelf: Shelf) -> tuple[DataFrame, int]:
    """``(conv, part, end, start)``: the right end vector of every chunk of the conversations that
    have several, by fix-up passes, and how many passes it took.

    Only the first and the last conversation of a range can have several chunks, so all tables here
    but ``cut`` itself have at most a few rows per range, and are broadcast.
    """
    # the speculation: that every chunk is followed by the end of its conversation
    seen = [shelf.put(_responses(cut.withColumn("end", F.lit(_told(END)))))]
    while True:
        known = reduce(DataFrame.unionByName, seen)
        walk = shelf.put(known.groupBy("conv").applyInPandas(_stitch_backward, WALKED))
        open_ = walk.where("start is null").select("conv", F.col("part").alias("until"), "end")
        if open_.isEmpty():
            return walk, len(seen)
        # a chunk before the one that asked may have been run from that vector already, and is left out
        asked = cut.join(F.broadcast(open_), "conv").where("part <= until")
        asked = asked.join(F.broadcast(known.select("conv", "part", "end")), ["conv", "part", "end"], "left_anti")
        seen.append(shelf.put(_responses(asked)))


def audits(cut: DataFrame, shelf: Shelf) -> DataFrame:
    """``(conv, part, audit, cost, head)`` of every chunk: its letters, the constants of its costs, and
    the least cost from its start in state 0 less these."""
    several = shelf.put(cut.groupBy("conv").agg(F.max("part").alias("end_part"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts"))
    alone = cut.join(F.broadcast(several), "conv", "left_anti")
    alone = alone.select("conv", "part", "kinds", F.lit(_told(END)).alias("end"), F.lit(0).alias("state"), F.lit(True).alias("last"))
    if several.isEmpty():
        return _traced(alone)
    long = shelf.put(cut.join(F.broadcast(several), "conv").select("conv", "part", "kinds", (F.col("part") == F.col("end_part")).alias("last")))
    right, _ = passes(long.select("conv", "part", "kinds"), shelf)
    long = long.join(F.broadcast(right.select("conv", "part", "end")), ["conv", "part"])

    def run_ends(batch):
        ends = []
        for kinds, end in zip(batch.column("kinds").to_pylist(), batch.column("end").to_pylist()):
            vectors, _ = backward(kinds, _read(end))
            ends.append("".join(str(trace(kinds, vectors, state, False)[1]) for state in range(4)))
        yield {"conv": batch.column("conv"), "part": batch.column("part"), "ends": ends}

    ends = map_batches(long.select("conv", "part", "kinds", "end"), run_ends, "conv string, part int, ends string")
    states = shelf.put(ends.groupBy("conv").applyInPandas(_stitch_forward, "conv string, part int, state int"))
    entered = long.join(F.broadcast(states), ["conv", "part"]).select("conv", "part", "kinds", "end", "state", "last")
    return _traced(entered.unionByName(alone))


def _traced(entered: DataFrame) -> DataFrame:
    def run(batch):
        letters, costs = [], []
        for kinds, end, state, last in zip(*(batch.column(c).to_pylist() for c in ("kinds", "end", "state", "last"))):
            vectors, added = backward(kinds, _read(end))
            letters.append(trace(kinds, vectors, state, last)[0])
            costs.append((added, vectors[0][0]))
        yield {"conv": batch.column("conv"), "part": batch.column("part"), "audit": letters, "cost": [a for a, _ in costs], "head": [h for _, h in costs]}

    return map_batches(entered, run, "conv string, part int, audit string, cost long, head long")


# --- results --------------------------------------------------------------------------------

COLUMNS = [
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
]  # fmt: skip


class _Repair:
    """What has been read of one conversation: first its audit, then its rows in order."""

    def __init__(self, conv: str):
        self.conv, self.parts, self.cost, self.head = conv, [], 0, 0
        self.audit, self.at, self.state = None, 0, 0
        self.digest, self.written = hashlib.sha256(), False
        self.low, self.high, self.turns, self.illegal, self.initial = None, None, 0, 0, None

    def add_audit(self, audit: str, cost: int, head: int) -> None:
        if not self.parts:
            self.head = head  # the least cost from the start, less the constants
        self.parts.append(audit)
        self.cost += cost

    def write(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
        self.written = True

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            self.write(ROLES[self.state], "")

    def add_row(self, turn: int | None, role: str, text: str) -> None:
        if self.audit is None:
            self.audit, self.parts = "".join(self.parts), []
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.insert()
        letter = self.audit[self.at].upper() if self.audit[self.at] in "dkr" else self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            self.write(role, text)
        elif letter == "R":
            self.state = NEXT[self.state]
            self.write(ROLES[self.state], text)

    def row(self) -> tuple:
        self.audit = self.audit or ""
        self.insert()
        cost, count = cost_of(self.audit), self.audit.count
        if cost != self.cost + self.head or self.at != len(self.audit):
            raise ValueError("stitched costs and the audit disagree")
        told = self.audit.upper().replace("B", "D").replace(DUPLICATE, "D")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        truncated = sum(map(count, "dkr"))
        conv_id = None if self.conv == " " else int(self.conv)
        return conv_id, gaps, count("B"), count(DUPLICATE), truncated, self.illegal, cost, told, self.digest.hexdigest()


def repaired(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """The columns of the contract, a row per original conv_id.

    NULL roles and texts count as one space, so such texts are blank; rows of a NULL conv_id form
    one conversation; NULL turns come first and count for no gap. Rows of one turn (ties) follow the
    order of the digest of role and text; equal ones are duplicates of the first. Texts are read
    whole, whatever their length; other columns are ignored; an empty table gives no rows. A
    conversation without rows after damage has zeros, an empty audit and the digest of nothing.
    ``parts`` is the number of ranges, by default the shuffle partitions.
    """
    shelf = Shelf(conversations.sparkSession)
    rows = damaged(conversations)
    cut = chunks(rows, shelf, parts)
    found = shelf.put(audits(cut, shelf))
    none = {"turn": "long", "print": "binary", "role": "string", "text": "string", "part": "int", "audit": "string", "cost": "long", "head": "long"}
    keys = narrow(conversations, conv=F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" "))).distinct()

    def filled(df: DataFrame, step: int) -> DataFrame:
        blanks = [F.lit(None).cast(kind).alias(name) for name, kind in none.items() if name not in df.columns]
        return df.select("*", F.lit(step).alias("step"), *blanks)

    together = filled(keys, 0).unionByName(filled(found, 1)).unionByName(filled(rows, 2))
    together = together.repartition("conv").sortWithinPartitions("conv", "step", "part", F.col("turn").asc_nulls_first(), "print")
    schema = pa.schema(COLUMNS)

    def run(batches):
        state = None
        for batch in batches:
            done = []
            for conv, step_, turn, role, text, audit, cost, head in zip(*(batch.column(c).to_pylist() for c in ("conv", "step", "turn", "role", "text", "audit", "cost", "head"))):
                if state is None or state.conv != conv:
                    done += [state.row()] if state else []
                    state = _Repair(conv)
                if step_ == 1:
                    state.add_audit(audit, cost, head)
                elif step_ == 2:
                    state.add_row(turn, role, text)
            if done:
                yield _batch(done, schema)
        if state:
            yield _batch([state.row()], schema)

    wanted = together.select("conv", "step", "turn", "role", "text", "audit", "cost", "head")
    return wanted.mapInArrow(run, ", ".join(f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in COLUMNS))


def query(spark, folder: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repaired(table(spark, folder, "conversations"))


def _edges() -> str:
    """The edits of a row as SQL values: state, state after, letters, roles inserted, role (NULL: as it is),
    initial needed (NULL: any), whether forced rows may take it, cost, cost more where truncated."""
    rows = []
    for state in range(4):
        at, inserted = state, ""
        for count in range(3):
            for kind, needed, after, role, cost in (
                ("D", "null", at, "null", DELETE), ("R", "null", NEXT[at], f"'{ROLES[NEXT[at]]}'", RETYPE),
                *[("K", f"'{x}'", kept_state(at, x), "null", 0) for x in "sua" if kept_state(at, x) is not None],
            ):  # fmt: skip
                keeps = kind != "D"
                rows.append(f"({state}, {after}, '{'I' * count}{kind}', '{inserted}', {role}, {needed}, {not keeps}, {INSERT * count + cost}, {BROKEN * keeps}, {keeps})")
            at = NEXT[at]
            inserted += f"{ROLES[at]}:\n"
    return ", ".join(rows)


SQL = rf"""
with recursive polynomial as (
    select list(c order by n) as crc from (
        select n, list_reduce([n] || range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
        from range(256) t(n)
    )
),
source as (
    select conv_id, coalesce(cast(conv_id as varchar), ' ') as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text from conversations
),
faults as (
    select *, xor(list_reduce([4294967295] || list_transform(string_split(conv || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint)),
        lambda c, b: xor(c >> 8, crc[cast(xor(c, b) & 255 as int) + 1])), 4294967295) % 20 as fault
    from source cross join polynomial
),
changed as (
    select conv, turn, case when fault = 4 then 'user' else role end as role,
        case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when fault = 3 then [0, 1] else [0] end) as copy
    from faults where fault <> 0
),
placed as (
    select *, sha256(conv || '|' || strlen(role) || ':' || role || text) as print from changed
),
numbered as (
    select *, row_number() over (partition by conv order by turn nulls first, print, copy) as i,
        row_number() over (partition by conv, print order by turn nulls first, copy) as seen,
        regexp_extract(text, '([^ 	-])[ 	-]*$', 1) as final
    from placed
),
kinds as (
    select conv, turn, i, role, text, final = '' as blank, final <> '' and seen > 1 as duplicate,
        final <> '' and seen = 1 and final not in ('.', '!', '?') as truncated,
        lag(role) over (partition by conv order by i) as former
    from numbered
),
edges as (select * from (values {_edges()}) e(state, after, letters, inserted, role, needed, may, cost, more, keeps)),
path as (
    select conv, cast(0 as bigint) as i, 0 as state, {{'cost': cast(0 as bigint), 'audit': '', 'body': ''}} as best from (select distinct conv from source)
    union all
    select p.conv, k.i, e.after, min({{
        'cost': p.best.cost + e.cost + case when k.truncated then e.more else 0 end, 'audit': p.best.audit || e.letters,
        'body': p.best.body || replace(e.inserted, '
', chr(10)) || case when e.keeps then coalesce(e.role, k.role) || ':' || k.text || chr(10) else '' end
    }})
    from path p join kinds k on k.conv = p.conv and k.i = p.i + 1
    join edges e on e.state = p.state and (e.may or not (k.blank or k.duplicate)) and (e.needed is null or e.needed = left(k.role, 1))
    group by p.conv, k.i, e.after
),
summed as (
    select conv, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
        count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
        count(*) filter (i > 1 and left(former, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal
    from kinds group by conv
),
ended as (
    select p.conv, min({{
        'cost': p.best.cost + t.cost, 'audit': p.best.audit || t.letters, 'body': p.best.body || replace(t.inserted, '
', chr(10))
    }}) as best
    from path p left join summed s on s.conv = p.conv
    join (values (0, 0, '', ''), (1, 4, 'II', 'user:
assistant:
'), (2, 2, 'I', 'assistant:
'), (3, 0, '', '')) t(state, cost, letters, inserted) on t.state = p.state
    where p.i = coalesce(s.n, 0) group by p.conv
)
select cast(nullif(e.conv, ' ') as bigint) as conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
    coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, e.best.cost as cost, e.best.audit as audit,
    sha256(left(e.best.body, greatest(length(e.best.body) - 1, 0))) as repaired_sha256
from ended e left join summed s on s.conv = e.conv
"""
