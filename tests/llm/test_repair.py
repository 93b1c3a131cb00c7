"""Operator 12 against SQL and a plain search over edits."""

import hashlib
import random
import zlib

import duckdb
import pytest

from rowdeck.llm import op12_repair as repair
from rowdeck.llm.shelf import Shelf

FOLDER = "/root/testdata/sf0.001"
SPACES = " \t\n\v\f\r"


def rows_of(result, columns):
    return sorted((tuple(row[result.columns.index(c)] for c in columns) for row in result.fetchall()), key=str)


def test_equals_sql(spark):
    connection = duckdb.connect()
    connection.sql(f"create view conversations as select * from '{FOLDER}/conversations.parquet'")
    frame = repair.query(spark, FOLDER)
    want = rows_of(connection.sql(repair.SQL), frame.columns)
    assert sorted(map(tuple, frame.collect()), key=str) == want and len(want) > 10


def plain(conversations):
    """Rows in order; forward search that keeps the cheapest, then least audit of every state."""
    groups = {}
    for conv, turn, role, text in conversations:
        rows = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        told = " " if conv is None else str(conv)
        fault = zlib.crc32(f"{told}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        role = "user" if fault == 4 else role
        digest = hashlib.sha256(f"{told}|{len(role.encode())}:{role}{text}".encode()).digest()
        rows += [(turn is not None, turn or 0, digest, turn, role, text)] * (2 if fault == 3 else 1)
    out = []
    for conv, rows in groups.items():
        rows = [r[3:] for r in sorted(rows, key=lambda r: r[:3])]
        seen, paths, count = set(), {0: (0, "", ())}, {"b": 0, "d": 0, "t": 0}

        def inserted(paths):
            for _ in range(3):
                for state, (cost, audit, body) in list(paths.items()):
                    after = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                    new = (cost + 2, audit + "I", body + (("user:" if after == 2 else "assistant:"),))
                    paths[after] = min(paths.get(after, new), new)
            return paths

        for turn, role, text in rows:
            final = text.rstrip(SPACES)[-1:]
            forced = not final or (role, text) in seen
            broken = not forced and final not in ".!?"
            count["b"] += not final
            count["d"] += bool(final) and (role, text) in seen
            count["t"] += broken
            seen.add((role, text))
            new = {}
            for state, (cost, audit, body) in inserted(paths).items():
                options = [(state, cost + 3, "D", body)]
                if not forced:
                    after = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                    options.append((after, cost + 2 + broken, "R", body + (("user:" if after == 2 else "assistant:") + text,)))
                    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role[:1]))
                    if kept is not None:
                        options.append((kept, cost + broken, "K", body + (f"{role}:{text}",)))
                for after, total, letter, lines in options:
                    path = (total, audit + letter, lines)
                    new[after] = min(new.get(after, path), path)
            paths = new
        cost, audit, body = min(path for state, path in inserted(paths).items() if state in (0, 3))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        digest = hashlib.sha256("\n".join(body).encode()).hexdigest()
        out.append((conv, gaps, count["b"], count["d"], count["t"], illegal, cost, audit, digest))
    return sorted(out, key=str)


def made(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        size = rng.randrange(longest)
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant", "tool"], ["system"], ["tool", ""]])
        for k in range(size):
            turn = rng.choice([k, k, k, k // 2, None]) if conv % 3 else k
            role = roles[k % len(roles)] if conv % 2 else rng.choice(roles + ["user", None])
            text = rng.choice([f"t{k}.", f"t{k}!", f"t{k}", "same.", "", None, " \n", "x. "])
            rows.append((conv if conv else None, turn, role, text))
    return rows


@pytest.mark.parametrize("seed, convs, longest, parts", [(1, 30, 9, 4), (2, 6, 120, 40)])
def test_equals_plain(spark, seed, convs, longest, parts):
    rows = made(seed, convs, longest)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, part string")
    got = repair.repaired(frame, parts).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_search_equals_every_edit():
    """The two-way search against all edits of short conversations."""

    def least(kinds, state):
        """Cheapest, then least audit from a state, by trying everything."""
        options = [(0, "")] if not kinds and state in (0, 3) else []
        if kinds and kinds[0] in repair.FORCED:
            cost, audit = least(kinds[1:], state)
            options.append((cost + 3, "D" + audit))
        elif kinds:
            for letter, after, cost in repair.edits(kinds[0], (0, 0, 0, 0), state):
                rest, audit = least(kinds[1:], after)
                options.append((cost + rest, letter + audit))
        if state in (0, 1) or least.depth < 2:
            least.depth += 1
            cost, audit = least(kinds, repair.NEXT[state])
            least.depth -= 1
            options.append((cost + 2, "I" + audit))
        return min(options) if options else (1 << 30, "")

    rng = random.Random(6)
    for _ in range(150):
        kinds = "".join(rng.choice("suaxSUAXB=") for _ in range(rng.randrange(5)))
        least.depth = 0
        vectors, total = repair.backward(kinds, repair.END)
        audit, _ = repair.trace(kinds, vectors, 0, True)
        want = least(kinds, 0)
        assert (total + vectors[0][0], audit.upper().replace("B", "D").replace("=", "D")) == want
        assert repair.cost_of(audit) == want[0]


def test_few_passes(spark):
    """A run of rows that never forgets what follows: passes are bounded by the vectors, not by the chunks."""
    rng = random.Random(1)
    chunks = [("0", k, "x" * 5) for k in range(60)] + [("1", k, "".join(rng.choice("usaxUB") for _ in range(40))) for k in range(60)]
    cut = spark.createDataFrame(chunks, "conv string, part int, kinds string")
    walk, times = repair.passes(cut, Shelf(spark))
    vectors, new = set(), {repair.END}
    while new:
        vectors |= new
        new = {repair.before(kind, v)[0] for kind in "suaxSUAXB=" for v in vectors} - vectors
    assert walk.count() == 120 and times <= len(vectors) < 60
    for conv in ("0", "1"):
        end = repair.END
        right = {r.part: r.end for r in walk.where(f"conv = '{conv}'").collect()}
        for _, part, kinds in sorted((c for c in chunks if c[0] == conv), reverse=True):
            assert right[part] == ",".join(map(str, end))
            end = repair.backward(kinds, end)[0][0]


def test_hot_conversation_and_edges(spark):
    rows = [(7, k % 50, "user" if k % 2 else "assistant", f"text {k % 40}.") for k in range(700)] + [(7, 3, "user", "same again")] * 60
    rows += [(k, None, None, None) for k in range(30)] + [(None, 1, "user", "a."), (None, 2, "assistant", "b.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, repair.repaired(frame, 30).collect()), key=str) == plain(rows)
    assert repair.repaired(frame.where("false")).count() == 0
