"""The same results as plain SQL, for checking the queries with another engine.

The seeded draws are 64-bit xxHash values, which plain integer SQL can compute, so even
the random orders are compared value by value.
"""

from __future__ import annotations

from rowdeck.functions.hashing import COIN, GENERATE, LANES, ORDER, PRINT, SAMPLE

SEED = 7

# The primes of the public 64-bit xxHash specification.
P1, P2, P3, P4, P5 = (
    11400714785074694791,
    14029467366897019727,
    1609587929392839161,
    9650029242287828579,
    2870177450012600261,
)
WORD = 1 << 64


def _hash_long(value: int, seed: int) -> int:
    mixed = value * P2 % WORD
    mixed = (mixed << 31 | mixed >> 33) % WORD * P1 % WORD
    word = (seed + P5 + 8) % WORD ^ mixed
    word = ((word << 27 | word >> 37) % WORD * P1 + P4) % WORD
    word = (word ^ word >> 33) * P2 % WORD
    word = (word ^ word >> 29) * P3 % WORD
    return word ^ word >> 32


def hashed(relation: str, key: str, seed: int, use: int, out: str = "h") -> str:
    """``relation`` plus the signed draw of a non-negative integer key, in the stream of ``use``."""
    first = (_hash_long(use, _hash_long(seed % WORD, 42)) + P5 + 8) % WORD
    steps = [
        f"({key})::UHUGEINT * {P2}::UHUGEINT % {WORD}::UHUGEINT",
        f"(_w * {1 << 31}::UHUGEINT % {WORD}::UHUGEINT + (_w >> 33)) * {P1}::UHUGEINT % {WORD}::UHUGEINT",
        f"xor(_w, {first}::UHUGEINT)",
        f"((_w * {1 << 27}::UHUGEINT % {WORD}::UHUGEINT + (_w >> 37)) * {P1}::UHUGEINT + {P4}::UHUGEINT)"
        f" % {WORD}::UHUGEINT",
        f"xor(_w, _w >> 33) * {P2}::UHUGEINT % {WORD}::UHUGEINT",
        f"xor(_w, _w >> 29) * {P3}::UHUGEINT % {WORD}::UHUGEINT",
        "xor(_w, _w >> 32)",
    ]
    query = f"(SELECT *, {steps[0]} AS _w FROM {relation})"
    for step in steps[1:]:
        query = f"(SELECT * REPLACE ({step} AS _w) FROM {query})"
    signed = f"CASE WHEN _w >= {WORD // 2}::UHUGEINT THEN _w::HUGEINT - {WORD}::HUGEINT ELSE _w::HUGEINT END"
    return f"(SELECT * EXCLUDE (_w), ({signed})::BIGINT AS {out} FROM {query})"


def unit(h: str) -> str:
    """Double in [0, 1) from the signed draw ``h``."""
    return (
        f"((({h}::HUGEINT + CASE WHEN {h} < 0 THEN {WORD}::HUGEINT ELSE 0::HUGEINT END) >> 11)::DOUBLE"
        f" / {1 << 53}::DOUBLE)"
    )


EVENTS = "(SELECT event_id AS pos, value, user_id FROM events)"
N = "(SELECT count(*) FROM events)"


def _ranked(relation: str, lane: str, order: str) -> str:
    """Lane, rank in the lane and rows in lower lanes."""
    return f"""(
        WITH laned AS (SELECT *, ({lane})::BIGINT AS lane FROM {relation}),
        sizes AS (SELECT lane, count(*) AS size FROM laned GROUP BY lane),
        starts AS (SELECT lane, size, coalesce(sum(size) OVER (ORDER BY lane
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sizes)
        SELECT laned.*, start, size,
            (row_number() OVER (PARTITION BY lane ORDER BY {order}) - 1)::BIGINT AS rank
        FROM laned JOIN starts USING (lane))"""


def _lanes(lane: str) -> str:
    return f"SELECT pos, lane, rank, start, size, pos AS member FROM {_ranked(EVENTS, lane, 'pos')}"


def _lane_shuffle(lane: str, columns: str = "pos, value", key: str = "pos") -> str:
    ranked = _ranked(hashed(EVENTS, key, SEED, LANES), lane, f"h, {key}")
    return f"SELECT {columns}, start + rank AS new_pos FROM {ranked}"


def _shuffled(relation: str, key: str = "pos", seed: int = SEED, out: str = "new_pos", use: int = ORDER) -> str:
    ranked = hashed(relation, key, seed, use)
    return f"(SELECT * EXCLUDE (h), (row_number() OVER (ORDER BY h, {key}) - 1)::BIGINT AS {out} FROM {ranked})"


STRIDED, DIAGONAL, CHUNKS = "pos % {k}", "(pos + pos // {k}) % {k}", f"pos // ceil({N} / {{k}}::DOUBLE)::BIGINT"
ROOT = f"floor(sqrt({N}))::BIGINT"
HEAD = f"CASE WHEN pos < {N} * 30 // 100 THEN 0 ELSE 1 END"

_PARTS = "(SELECT row_number() OVER () - 1 AS pos, l_partkey AS value FROM lineitem)"

ORACLES: dict[str, str] = {
    "sequence": "SELECT range AS pos, range AS data FROM range((SELECT count(*) FROM orders))",
    "hash_uniform": f"SELECT pos, {unit('h')} AS u FROM {hashed('(SELECT event_id AS pos FROM events)', 'pos', SEED, GENERATE)}",
    "hash_randint": f"""SELECT pos, floor({unit('h')} * 10000)::BIGINT AS below_high,
        floor({unit('h')} * 1000)::BIGINT + 1 AS up_to_high
        FROM {hashed('(SELECT event_id AS pos FROM events)', 'pos', SEED, GENERATE)}""",
    "scan_numbers": "SELECT o_orderkey AS pos, o_custkey::DOUBLE AS value FROM orders",
    "scan_tokens": """SELECT o_orderkey AS pos, 0 AS nth, o_orderkey::INTEGER AS value FROM orders
        UNION ALL SELECT o_orderkey, 1, o_custkey::INTEGER FROM orders""",
    "scan_dicts": "SELECT event_id AS pos, value AS item FROM events",
    "number_parquet": "SELECT event_id, event_id AS pos FROM events",
    "take_n": "SELECT event_id AS pos, value FROM events ORDER BY event_id LIMIT 100",
    "flatten_record": """SELECT event_id * 2 AS pos, event_id AS value FROM events
        UNION ALL SELECT event_id * 2 + 1, user_id FROM events""",
    "flatten_float": """SELECT o_orderkey * 2 AS pos, o_totalprice::FLOAT::DOUBLE AS value FROM orders
        UNION ALL SELECT o_orderkey * 2 + 1, o_custkey::FLOAT::DOUBLE FROM orders""",
    "cast_float": """SELECT o_orderkey AS pos, o_totalprice::FLOAT::DOUBLE AS single,
        trunc(o_totalprice)::BIGINT AS whole, o_custkey::VARCHAR AS text FROM orders""",
    "trim_text": """SELECT doc_id, length(t)::BIGINT AS chars, md5(t) AS digest FROM (
        SELECT doc_id, regexp_replace(regexp_replace(text, '^[\\s\\x0B\\x1c-\\x1f\\x{85}\\p{Z}]+', ''),
            '[\\s\\x0B\\x1c-\\x1f\\x{85}\\p{Z}]+$', '') AS t FROM documents)""",
    "digit": """SELECT o_orderkey AS pos,
        (floor((o_custkey - 500) / 1.0)::BIGINT % 10 + 10) % 10 AS digit0,
        (floor((o_custkey - 500) / 10.0)::BIGINT % 10 + 10) % 10 AS digit1,
        (floor((o_custkey - 500) / 100.0)::BIGINT % 10 + 10) % 10 AS digit2 FROM orders""",
    "max_digits": "SELECT length(max(o_orderkey)::VARCHAR)::BIGINT AS max_digits FROM orders",
    "round_sig": """SELECT o_orderkey AS pos, printf('%.1e', o_totalprice)::DOUBLE AS two,
        printf('%.2e', o_totalprice / 1000000)::DOUBLE AS three FROM orders""",
    "readable_size": """SELECT doc_id, CASE WHEN n_chars * 1000003 / 1073741824.0 >= 1
        THEN printf('%.2f GB', (n_chars * 1000003)::DOUBLE / 1073741824.0)
        ELSE printf('%.2f MB', (n_chars * 1000003)::DOUBLE / 1048576.0) END AS size FROM documents""",
    "zip_add": "SELECT event_id AS pos, user_id + o_custkey AS total FROM events JOIN orders ON event_id = o_orderkey",
    "argmax": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS index FROM embeddings",
    "class_label": "SELECT vec_id, n_name AS name FROM embeddings JOIN nation ON label = n_nationkey",
    "class_label_missing": """SELECT vec_id, label, r_name AS name
        FROM embeddings LEFT JOIN region ON label = r_regionkey""",
    "lane_offsets_sparse": """WITH offsets AS (SELECT o_custkey AS lane, count(*) AS rows, sum(o_orderkey)::BIGINT AS total
        FROM orders GROUP BY o_custkey)
        SELECT lane, (row_number() OVER w - 1)::BIGINT AS rank, coalesce(sum(rows) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
            AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM offsets WINDOW w AS (ORDER BY total, lane)""",
    "shuffle_generated": f"""SELECT pos, u, (row_number() OVER (ORDER BY g, pos) - 1)::BIGINT AS new_pos
        FROM {hashed(f"(SELECT pos, {unit('h')} AS u FROM {hashed('(SELECT event_id AS pos FROM events)', 'pos', SEED, GENERATE)})", 'pos', SEED, ORDER, 'g')}""",
    "lane_round_robin": _lanes(STRIDED.format(k=8)),
    "lane_diagonal": _lanes(DIAGONAL.format(k=7)),
    "chunk_ceil": _lanes(CHUNKS.format(k=7)),
    "chunk_floor": _lanes(f"least(pos // ({N} // 7), 6)"),
    "batch_id": _lanes("pos // 1000"),
    "split_percent": _lanes(HEAD),
    "merge_blocks": _lanes(CHUNKS.format(k=64)),
    "lane_rebalance": _lanes(f"pos * 7 // {N}"),
    "lane_filter": "SELECT event_id AS pos FROM events WHERE event_id % 8 = 3",
    "split_k": f"SELECT pos, ({CHUNKS.format(k=4)})::INTEGER AS part FROM {EVENTS}",
    "digit_buckets": "SELECT p_partkey // 10 % 10 AS bucket, count(*) AS rows FROM part GROUP BY 1",
    "keyed_shuffle": f"SELECT pos, value, new_pos FROM {_shuffled(EVENTS)}",
    "rand_shuffle": "SELECT event_id AS pos, value FROM events",
    "chunk_then_global_shuffle": f"SELECT pos, new_pos FROM {_shuffled(EVENTS, seed=SEED + 1)}",
    "merge_shuffle_uniform": f"SELECT pos, new_pos FROM {_shuffled(EVENTS)}",
    "lane_shuffle_rr": _lane_shuffle(STRIDED.format(k=ROOT)),
    "lane_shuffle_diagonal": _lane_shuffle(DIAGONAL.format(k=ROOT)),
    "lane_shuffle_chunk": _lane_shuffle(CHUNKS.format(k=8)),
    "split_shuffle": _lane_shuffle(HEAD),
    "batch_shuffle": _lane_shuffle("pos // 1000", "pos"),
    "pair_exchange": _lane_shuffle("pos % 7 // 2", "pos"),
    "permutation": f"SELECT new_pos AS pos, pos AS src FROM {_shuffled(EVENTS)}",
    "gather": f"SELECT new_pos AS pos, pos AS src, value FROM {_shuffled(EVENTS)}",
    "sample_k": f"SELECT pos, value FROM {_shuffled(EVENTS, use=SAMPLE)} WHERE new_pos < 500",
    "stable_sort": """SELECT event_id AS pos, user_id AS v,
        (row_number() OVER (ORDER BY user_id, event_id) - 1)::BIGINT AS new_pos FROM events""",
    "zip_join": """SELECT event_id AS pos, value, o_totalprice AS price
        FROM events JOIN orders ON event_id = o_orderkey""",
    "missing_elements": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "concat": """SELECT c_custkey AS pos, c_acctbal AS v FROM customer
        UNION ALL SELECT s_suppkey + (SELECT count(*) FROM customer), s_acctbal FROM supplier""",
    "sum_squares": "SELECT round(sum(l_quantity * l_quantity), 2) AS sum_squares FROM lineitem",
    "verify_set": """SELECT NOT EXISTS (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem)
        AND NOT EXISTS (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part) AS set_ok""",
    "verify_multiset": f"""WITH a AS (SELECT value FROM {_PARTS}), b AS (SELECT value FROM {_shuffled(_PARTS)})
        SELECT NOT EXISTS (SELECT value FROM a EXCEPT ALL SELECT value FROM b)
        AND NOT EXISTS (SELECT value FROM b EXCEPT ALL SELECT value FROM a) AS multiset_ok""",
    "verify_multiset_false": """SELECT NOT EXISTS (SELECT p_partkey FROM part EXCEPT ALL SELECT l_partkey FROM lineitem)
        AND NOT EXISTS (SELECT l_partkey FROM lineitem EXCEPT ALL SELECT p_partkey FROM part) AS multiset_ok""",
    "verify_set_false": """SELECT NOT EXISTS (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
        AND NOT EXISTS (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) AS set_ok""",
    "verify_length": """SELECT (SELECT count(*) FROM customer) AS n, (SELECT count(*) FROM orders) AS n_out,
        NOT EXISTS (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
        AND NOT EXISTS (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)
        AND (SELECT count(*) FROM customer) = (SELECT count(*) FROM orders) AS length_ok""",
    "verify_elements": """SELECT count(*) AS missing, count(*) = 0 AS all_present FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "inversions": """SELECT count(*) FILTER (WHERE before > v) AS inversions FROM (
        SELECT o_totalprice AS v, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS before FROM orders)""",
    "map_features": """SELECT vec_id, (i - 1)::BIGINT AS nth,
        round((embedding[i]::DOUBLE - 0.5) / 0.25, 6) AS feature
        FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "apply_per_lane": """WITH RECURSIVE steps AS (
        SELECT event_id AS pos, user_id AS v, user_id % 1000003 AS state FROM events WHERE event_id % 1000 = 0
        UNION ALL SELECT event_id, user_id, (state * 31 + user_id) % 1000003
        FROM steps JOIN events ON event_id = pos + 1 WHERE event_id % 1000 <> 0)
        SELECT pos, v, state::BIGINT AS state FROM steps""",
}

ORACLES["half_rotate"] = f"""SELECT pos, start + (rank + size - size // 2) % size AS new_pos
    FROM {_ranked(EVENTS, CHUNKS.format(k=7), 'pos')}"""

_TURNED = f"""(SELECT pos, start + (rank + size - size // 2) % size AS turned
    FROM {_ranked(EVENTS, CHUNKS.format(k=7), 'pos')})"""
ORACLES["rotate_shuffle"] = f"""SELECT pos, start + rank AS new_pos
    FROM {_ranked(hashed(_TURNED, 'turned', SEED, LANES), CHUNKS.format(k=7), 'h, turned')}"""

ORACLES["cyclic_shuffle"] = f"""SELECT pos, coalesce(lead(pos) OVER w, first_value(pos) OVER w) AS new_pos
    FROM (SELECT *, {CHUNKS.format(k=8)} AS lane FROM {hashed(EVENTS, 'pos', SEED, LANES)})
    WINDOW w AS (PARTITION BY lane ORDER BY h, pos)"""

ORACLES["lane_shuffle_inplace"] = f"""WITH ranked AS (
    SELECT pos, lane, row_number() OVER (PARTITION BY lane ORDER BY pos) AS by_pos,
        row_number() OVER (PARTITION BY lane ORDER BY h, pos) AS by_draw
    FROM (SELECT *, {DIAGONAL.format(k=7)} AS lane FROM {hashed(EVENTS, 'pos', SEED, LANES)}))
    SELECT a.pos, b.pos AS new_pos FROM ranked a JOIN ranked b ON a.lane = b.lane AND a.by_draw = b.by_pos"""

_ORDERS = "(SELECT o_orderkey AS pos, o_custkey AS v FROM orders)"
ORACLES["lane_shuffle_digit"] = f"""SELECT pos, v % 10 AS bucket,
    (row_number() OVER (ORDER BY v % 10, h, pos) - 1)::BIGINT AS new_pos FROM {hashed(_ORDERS, 'pos', SEED, LANES)}"""

ORACLES["radix_order"] = f"""SELECT pos, v, (row_number() OVER (ORDER BY reverse(lpad(v::VARCHAR,
    (SELECT length(max(o_custkey)::VARCHAR) FROM orders)::INTEGER, '0')), pos) - 1)::BIGINT AS new_pos
    FROM {_ORDERS}"""

_DOCS = "(SELECT doc_id AS pos, n_chars FROM documents)"
_DOC_LANE = "pos // ceil((SELECT count(*) FROM documents) / 8.0)::BIGINT"
_DOC_LOADS = f"""(SELECT ({_DOC_LANE})::BIGINT AS lane, count(*) AS rows, sum(n_chars)::BIGINT AS bytes
    FROM {_DOCS} GROUP BY 1)"""
ORACLES["lane_loads"] = f"SELECT lane, rows, bytes FROM {_DOC_LOADS}"
ORACLES["argsort"] = f"""SELECT lane, bytes, (row_number() OVER (ORDER BY bytes, lane) - 1)::BIGINT AS rank
    FROM {_DOC_LOADS}"""
ORACLES["lane_by_size"] = f"""SELECT pos, (row_number() OVER (ORDER BY bytes, lane, h, pos) - 1)::BIGINT AS new_pos
    FROM (SELECT *, ({_DOC_LANE})::BIGINT AS lane FROM {hashed(_DOCS, 'pos', SEED, LANES)}) JOIN {_DOC_LOADS} USING (lane)"""


def _by_nation(measure: str) -> str:
    return f"""SELECT pos, (row_number() OVER (ORDER BY {measure}, lane, pos) - 1)::BIGINT AS new_pos
    FROM {_ranked(EVENTS, CHUNKS.format(k=25), 'pos')} JOIN nation ON lane = n_nationkey"""


ORACLES["lane_by_distance"] = _by_nation("abs(2 - n_regionkey)")
ORACLES["lane_by_cost"] = _by_nation("size / (n_regionkey + 1)::DOUBLE")

ORACLES["lane_extremes"] = f"""WITH loads AS (SELECT {DIAGONAL.format(k=7)} AS lane, count(*) AS rows
    FROM {EVENTS} GROUP BY 1)
    SELECT (SELECT lane FROM loads ORDER BY rows DESC, lane LIMIT 1) AS fullest, max(rows) AS max_rows,
        (SELECT lane FROM loads ORDER BY rows, lane LIMIT 1) AS emptiest, min(rows) AS min_rows FROM loads"""


def _riffle(relation: str, rows: str, lane_slots: str, width: str, seed: int, keep: str, uniform: bool = False) -> str:
    """Merge the two sides of each lane of ``relation`` by one coin per slot, or by the smallest draws."""
    slots = hashed(f"(SELECT range AS slot FROM range({rows}))", "slot", seed, COIN)
    start = f"slot // ({lane_slots}) * ({lane_slots})"
    head = f"row_number() OVER (PARTITION BY {start} ORDER BY h, slot) <= least({width}, {rows} - {start})" if uniform else "h < 0"
    return f"""(
        WITH coins AS (SELECT slot, {head} AS head, {start} AS start FROM {slots}),
        counted AS (SELECT slot, head, start,
            least({width}, {rows} - start) AS lft,
            least({lane_slots}, {rows} - start) - least({width}, {rows} - start) AS rgt,
            coalesce(sum(head::BIGINT) OVER (PARTITION BY start ORDER BY slot
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS heads FROM coins),
        taken AS (SELECT slot, CASE WHEN head THEN start + heads
                ELSE start + lft + (slot - start - heads) END AS src
            FROM counted WHERE heads < lft AND slot - start - heads < rgt),
        placed AS (SELECT *, pos // ({lane_slots}) * ({lane_slots}) AS start FROM {relation}),
        sized AS (SELECT *, least({width}, {rows} - start) AS lft,
            least({lane_slots}, {rows} - start) - least({width}, {rows} - start) AS rgt FROM placed)
        SELECT {keep}, coalesce(slot, CASE WHEN pos - start < lft THEN pos + rgt ELSE pos END)::BIGINT AS new_pos
        FROM sized LEFT JOIN taken ON pos = src)"""


_BOTH = f"(({N}) + (SELECT count(*) FROM orders))"
_STACK = f"""(SELECT event_id AS pos, user_id AS v FROM events
    UNION ALL SELECT o_orderkey + {N}, o_custkey FROM orders)"""
ORACLES["riffle_merge"] = f"SELECT * FROM {_riffle(_STACK, _BOTH, _BOTH, N, SEED, 'pos, v')}"

ORACLES["riffle_uniform"] = f"SELECT * FROM {_riffle(_STACK, _BOTH, _BOTH, N, SEED, 'pos, v', True)}"

_BLOCK = f"ceil({N} / 4.0)::BIGINT"
_BLOCKS = f"(SELECT pos AS origin, new_pos AS pos FROM ({_lane_shuffle(f'pos // {_BLOCK}', 'pos')}))"
_ROUND1 = f"(SELECT origin, new_pos AS pos FROM {_riffle(_BLOCKS, N, f'2 * {_BLOCK}', _BLOCK, SEED + 1, 'origin')})"
ORACLES["merge_shuffle"] = f"""SELECT origin AS pos, new_pos
    FROM {_riffle(_ROUND1, N, f'4 * {_BLOCK}', f'2 * {_BLOCK}', SEED + 2, 'origin')}"""

_EVEN1 = f"(SELECT origin, new_pos AS pos FROM {_riffle(_BLOCKS, N, f'2 * {_BLOCK}', _BLOCK, SEED + 1, 'origin', True)})"
ORACLES["merge_uniform"] = f"""SELECT origin AS pos, new_pos
    FROM {_riffle(_EVEN1, N, f'4 * {_BLOCK}', f'2 * {_BLOCK}', SEED + 2, 'origin', True)}"""

_LANED = "(SELECT o_orderkey AS pos, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 13 END AS lane FROM orders)"
ORACLES["rebalance_moves"] = f"""WITH loads AS (
        SELECT range AS lane, count(pos) AS load FROM range(16) LEFT JOIN {_LANED} ON lane = range GROUP BY range),
    plan AS (SELECT lane, load, (SELECT count(*) FROM orders) // 16
        + (row_number() OVER (ORDER BY load DESC, lane) <= (SELECT count(*) FROM orders) % 16)::BIGINT AS target FROM loads),
    summed AS (SELECT *, greatest(target - load, 0) AS gap,
        coalesce(sum(greatest(load - target, 0)) OVER before, 0) AS given,
        coalesce(sum(greatest(target - load, 0)) OVER before, 0) AS taken
        FROM plan WINDOW before AS (ORDER BY lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY pos) - 1 AS rank FROM {_LANED})
    SELECT r.pos, r.lane, coalesce(g.lane, r.lane) AS new_lane FROM ranked r JOIN summed s ON s.lane = r.lane
    LEFT JOIN summed g ON r.rank >= s.target AND s.given + r.rank - s.target >= g.taken AND s.given + r.rank - s.target < g.taken + g.gap"""

_LEAST = "list_position(loads, list_min(loads))"
ORACLES["least_loaded"] = f"""WITH RECURSIVE sorted AS (
        SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS i, n_chars AS cost FROM documents),
    greedy AS (SELECT 0::BIGINT AS i, list_transform(range(8), lambda x: 0::BIGINT) AS loads, list_transform(range(8), lambda x: 0::BIGINT) AS counts
        UNION ALL SELECT s.i, list_transform(loads, lambda x, j: CASE WHEN j = {_LEAST} THEN x + cost ELSE x END),
            list_transform(counts, lambda x, j: CASE WHEN j = {_LEAST} THEN x + 1 ELSE x END)
        FROM greedy g JOIN sorted s ON s.i = g.i + 1)
    SELECT unnest(range(8)) AS lane, unnest(counts) AS rows, unnest(loads) AS cost
    FROM greedy WHERE i = (SELECT count(*) FROM documents)"""

ORACLES["radix_sort"] = """SELECT pos, v, (row_number() OVER (ORDER BY v NULLS LAST, pos) - 1)::BIGINT AS new_pos FROM (
    SELECT o_orderkey AS pos, CASE WHEN o_custkey % 3 = 0 THEN 42 WHEN o_custkey % 7 = 0 THEN NULL
        ELSE (o_custkey - 500) * 1000003 END AS v FROM orders)"""

ORACLES["permutation_cycles"] = f"""WITH RECURSIVE moves AS MATERIALIZED (
        SELECT pos, coalesce(lead(pos) OVER w, first_value(pos) OVER w) AS new_pos
        FROM (SELECT *, {CHUNKS.format(k=64)} AS lane FROM {hashed(EVENTS, 'pos', SEED, LANES)})
        WINDOW w AS (PARTITION BY lane ORDER BY h, pos)),
    walk AS (SELECT pos AS origin, new_pos AS here, least(pos, new_pos) AS low FROM moves
        UNION ALL SELECT origin, new_pos, least(low, new_pos) FROM walk JOIN moves ON pos = here WHERE here <> origin)
    SELECT low AS cycle, count(*) AS length FROM walk WHERE here = origin GROUP BY low"""

ORACLES["predict_in_batches"] = f"""SELECT pos, user_id AS v, user_id - min(user_id) OVER batch + 1000 * count(*) OVER batch AS answer
    FROM {EVENTS} WINDOW batch AS (PARTITION BY pos // 360)"""


def _print(relation: str) -> str:
    """The fingerprint of the values of a relation."""
    halves = []
    for seed in (0, 1):
        h = f"(h::HUGEINT + CASE WHEN h < 0 THEN {WORD}::HUGEINT ELSE 0::HUGEINT END)"
        words = ", ".join(f"coalesce(sum(({h} >> {22 * k}) & 4194303), 0)" for k in range(3))
        halves.append(f"(SELECT concat_ws(',', {words}) FROM {hashed(relation, 'value', seed, PRINT)})")
    return " || ',' || ".join(halves)


def _same_print(left: str, right: str) -> str:
    return f"""SELECT *, n = n_out AND print_in = print_out AS multiset_ok FROM (
        SELECT (SELECT count(*) FROM {left}) AS n, (SELECT count(*) FROM {right}) AS n_out,
            {_print(left)} AS print_in, {_print(right)} AS print_out)"""


ORACLES["verify_fingerprint"] = _same_print(_PARTS, f"(SELECT value FROM {_shuffled(_PARTS)})")
ORACLES["verify_fingerprint_false"] = _same_print("(SELECT p_partkey AS value FROM part)", _PARTS)
_USERS = "(SELECT event_id AS pos, user_id AS value FROM events)"


def _checks(nth: int, shuffled: str) -> str:
    """What needs no order, by set differences."""

    def same(columns: str) -> str:
        left, right = f"SELECT {columns} FROM {_USERS}", f"SELECT {columns} FROM {shuffled}"
        return f"NOT EXISTS ({left} EXCEPT ALL {right}) AND NOT EXISTS ({right} EXCEPT ALL {left})"

    return f"""SELECT {nth} AS nth, n, n_out, positions_ok, multiset_ok, identical,
        CASE WHEN n <> n_out THEN 'length differs' WHEN NOT positions_ok THEN 'positions wrong'
            WHEN NOT multiset_ok THEN 'elements differ' WHEN identical THEN 'identical' ELSE 'passed' END AS verdict
        FROM (SELECT {N} AS n, (SELECT count(*) FROM {shuffled}) AS n_out, {same('pos')} AS positions_ok,
            {same('value')} AS multiset_ok, {same('pos, value')} AS identical)"""


ORACLES["fingerprint_audit"] = " UNION ALL ".join(
    _checks(nth, shuffled)
    for nth, shuffled in enumerate((
        f"(SELECT new_pos AS pos, value FROM {_shuffled(_USERS)})", _USERS,
        "(SELECT event_id AS pos, user_id + (event_id = 5)::BIGINT AS value FROM events)",
    ))
)

ORACLES["shuffle_percentage"] = f"""SELECT {N} AS n, count(*) FILTER (WHERE a.value <> b.value) AS moved,
    count(*) FILTER (WHERE a.value <> b.value) * 100.0::DOUBLE / {N} AS pct_moved
    FROM {_USERS} a JOIN {_shuffled(_USERS)} b ON a.pos = b.new_pos"""


def _audit(original: str, shuffled: str) -> str:
    """``original`` is (pos, value), ``shuffled`` (pos, value) with new positions."""
    return f"""
    WITH a AS (SELECT pos, value FROM {original}), b AS (SELECT pos, value FROM {shuffled}),
    counts AS (SELECT value, sum(x)::BIGINT AS x, sum(y)::BIGINT AS y FROM (
        SELECT value, 1 AS x, 0 AS y FROM a UNION ALL SELECT value, 0, 1 FROM b) GROUP BY value),
    m AS (SELECT (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM b) AS n_out,
        (SELECT count(*) FROM counts WHERE (x > 0) <> (y > 0)) = 0 AS set_ok,
        (SELECT count(*) FROM counts WHERE x <> y) = 0 AS multiset_ok,
        (SELECT count(*) FROM a JOIN b USING (pos) WHERE a.value <> b.value) AS moved,
        (SELECT count(*) FROM (SELECT value AS v, lag(value) OVER (ORDER BY pos) AS before FROM b)
            WHERE before > v) AS inversions,
        (SELECT count(*) FROM b WHERE pos IS NULL OR pos < 0 OR pos >= (SELECT count(*) FROM a)) AS bad_positions,
        (SELECT count(pos) - count(DISTINCT pos) FROM b WHERE pos >= 0 AND pos < (SELECT count(*) FROM a)) AS repeated)
    SELECT n, n_out, set_ok, multiset_ok, moved * 100.0::DOUBLE / n AS pct_moved, inversions, bad_positions, repeated,
        CASE WHEN n <> n_out THEN 'length differs' WHEN bad_positions + repeated > 0 THEN 'positions wrong' WHEN NOT set_ok THEN 'elements differ'
            WHEN moved = 0 THEN 'identical' WHEN inversions = 0 THEN 'sorted' ELSE 'passed' END AS verdict
    FROM m"""


ORACLES["shuffle_audit"] = _audit(EVENTS, f"(SELECT new_pos AS pos, value FROM {_shuffled(EVENTS)})")

_ORDER_VALUES = "(SELECT o_orderkey AS pos, o_custkey AS value FROM orders)"
ORACLES["lane_audit"] = _audit(
    _ORDER_VALUES,
    f"(SELECT start + rank AS pos, value FROM {_ranked(hashed(_ORDER_VALUES, 'pos', SEED, LANES), 'pos % 8', 'h, pos')})",
)

ORACLES["audit_bad_positions"] = f"""SELECT n, n_out, set_ok, multiset_ok, bad_positions, repeated, verdict FROM ({_audit(
    _ORDER_VALUES,
    "(SELECT CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 2 = 1 THEN o_orderkey + 1000000 WHEN o_orderkey % 3 = 0 THEN 6 ELSE o_orderkey END AS pos, o_custkey AS value FROM orders)",
)})"""

_SCORES = """(SELECT vec_id, c, sum(((7 * c + 3 * j + c * j) % 11 - 5) * ((embedding[j + 1]::DOUBLE - 0.5) / 0.25)) AS score
    FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS j FROM embeddings), range(0, 10) AS classes(c)
    GROUP BY vec_id, c)"""
_PREDICTED = f"(SELECT vec_id, arg_max(c, score)::BIGINT AS predicted FROM {_SCORES} GROUP BY vec_id)"
ORACLES["batch_predict"] = f"""SELECT vec_id, predicted, n_name AS name
    FROM {_PREDICTED} LEFT JOIN nation ON predicted = n_nationkey"""
ORACLES["predict_sample"] = f"SELECT vec_id, predicted FROM {_PREDICTED} ORDER BY vec_id LIMIT 10"
