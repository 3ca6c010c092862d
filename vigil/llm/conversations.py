"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation's roles should read as an optional system turn and then pairs of user and assistant, or
nothing at all. Four states follow that pattern (nothing yet, after system, after user, after assistant). Each row is
kept, given another role or deleted, with rows inserted before it; a row's edits never begin another's,
so audits of the same rows compare edit by edit. To find the cheapest edits, a cost vector over the four states comes
forward from the start, another backward from the end, and they meet in the middle: of the crossings with
the least sum, the one whose forward audit is ASCII-least is taken (its order among the four is carried
along), and both halves are repaired alike. That takes memory in proportion to the rows, no table of costs.

A conversation may be larger than any task. Rows are sorted by range over (conversation, turn, ...), and
sorted runs are cut into fragments of bounded size. A conversation that lies within one fragment and one task is
repaired there. The others exchange their fragments' digests, to know repetitions, then their
cost matrices (four starts by four ends): first those of one task, then one of each task, meet as above,
which gives every fragment its start and end state; fragments are then repaired independently.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b, sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import written

FRAGMENT_ROWS, FRAGMENT_OCTETS = 4096, 1_000_000

RESPELL, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: state, role initial -> state
LEGAL = {
    (NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
#: The state that an inserted or renamed row leads to, and its role.
ONWARD = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What is inserted behind the last row, by state.
ENDING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
NEVER = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"
#: Kinds of rows: for each initial sound or cut off, then those that must go.
INITIALS = "sua?"
GOES = 2 * len(INITIALS)

COUNTS = ["blank", "duplicate", "truncated", "illegal"]
REPORT = ["gaps", *COUNTS, "cost"]
LONG_MAX = (1 << 63) - 1


# ---- edits of one row, and vectors over the states -------------------------------------------------


def _edits(kind: int) -> list[dict[int, tuple[int, str]]]:
    """By state before and state after: the cheapest edits of a row of this kind, ASCII-least among equals."""
    table: list[dict[int, tuple[int, str]]] = []
    for start in range(4):
        found: dict[int, tuple[int, str]] = {}
        state = start
        for inserted in range(3):  # more would pass through the same states again
            options = [(DELETE, "D", state)]
            if kind != GOES:
                extra = CUT_OFF * (kind % 2)
                options.append((RESPELL + extra, "R", ONWARD[state]))
                kept = LEGAL.get((state, INITIALS[kind // 2]))
                if kept is not None:
                    options.append((extra, "K", kept))
            for cost, letter, end in options:
                edit = (INSERT * inserted + cost, "I" * inserted + letter)
                found[end] = min(found.get(end, edit), edit)
            state = ONWARD[state]
        table.append(found)
    return table


EDITS = [_edits(kind) for kind in range(GOES + 1)]



def remembered(limit: int) -> Callable:
    """Keep a function's results, at most ``limit`` of them (an ordinary function, so it travels by value)."""

    def wrap(function: Callable) -> Callable:
        cache: dict = {}

        def call(*key):
            out = cache.get(key)
            if out is None:
                if len(cache) >= limit:
                    cache.clear()
                out = cache[key] = function(*key)
            return out

        return call

    return wrap


#: Costs by state, and the order of the audits that lead there. Least cost 0.
Vector = tuple[tuple[int, ...], tuple[int, ...]]


def single(state: int) -> Vector:
    return tuple(0 if s == state else NEVER for s in range(4)), (0, 0, 0, 0)


def _levelled(costs: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least if c < NEVER else NEVER for c in costs), least


@remembered(1 << 16)  # costs differ by a few edits at most, so vectors are few
def forward_step(vector: Vector, kind: int) -> tuple[Vector, int]:
    """One row onwards; what was taken off all costs comes beside the vector."""
    costs, order = vector
    best = [(NEVER, 0, "")] * 4
    for start in range(4):
        if costs[start] < NEVER:
            for end, (cost, letters) in EDITS[kind][start].items():
                best[end] = min(best[end], (costs[start] + cost, order[start], letters))
    ranked = sorted({b[1:] for b in best if b[0] < NEVER})
    levelled, least = _levelled([b[0] for b in best])
    return (levelled, tuple(ranked.index(b[1:]) if b[0] < NEVER else 0 for b in best)), least


@remembered(1 << 16)
def backward_step(costs: tuple[int, ...], kind: int) -> tuple[int, ...]:
    """One row back, levelled (only differences matter where halves meet)."""
    return _levelled([
        min(min(costs[end], NEVER) + cost if costs[end] < NEVER else NEVER for end, (cost, _) in EDITS[kind][start].items())
        for start in range(4)
    ])[0]


def forward(kinds: bytes, vector: Vector) -> tuple[Vector, int]:
    total = 0
    for kind in kinds:
        vector, least = forward_step(vector, kind)
        total += least
    return vector, total


def backward(kinds: bytes, costs: tuple[int, ...]) -> tuple[int, ...]:
    for kind in reversed(kinds):
        costs = backward_step(costs, kind)
    return costs


def crossing(ahead: Vector, behind: tuple[int, ...]) -> int:
    """The state to meet in: least sum, then least audit before it."""
    return min((c + b, rank, s) for s, (c, rank, b) in enumerate(zip(*ahead, behind)) if c < NEVER and b < NEVER)[2]


def edits_between(kinds: bytes, start: int, end: int) -> str:
    """The cheapest, then ASCII-least edits that lead from state ``start`` to ``end``."""
    if len(kinds) < 2:
        return EDITS[kinds[0]][start][end][1] if kinds else ""
    half = len(kinds) // 2
    middle = crossing(forward(kinds[:half], single(start))[0], backward(kinds[half:], single(end)[0]))
    return edits_between(kinds[:half], start, middle) + edits_between(kinds[half:], middle, end)


def last_state(vector: Vector) -> int:
    return crossing(vector, tuple(INSERT * len(ENDING[s]) for s in range(4)))


@remembered(1 << 16)
def _short_repair(kinds: bytes) -> tuple[str, int]:
    return repair_kinds(kinds)


def repair_kinds(kinds: bytes) -> tuple[str, int]:
    """(audit, cost) of a whole conversation."""
    vector, total = forward(kinds, single(NOTHING))
    end = last_state(vector)
    cost = total + vector[0][end] + INSERT * len(ENDING[end])
    return edits_between(kinds, NOTHING, end) + ENDING[end], cost


def applied(audit: str, state: int, roles: list[str], texts: list[str]) -> list[dict]:
    """The rows that the edits leave, from ``state`` on."""
    out, at = [], 0
    for letter in audit:
        if letter in "IR":
            state = ONWARD[state]
            out.append({"role": ROLES[state], "text": "" if letter == "I" else texts[at]})
        elif letter == "K":
            state = LEGAL[state, roles[at][:1]]
            out.append({"role": roles[at], "text": texts[at]})
        at += letter != "I"
    return out


# ---- faults ------------------------------------------------------------------------------------


def _illegal(before: str | None, role: str) -> bool:
    return before is not None and before[:1] + role[:1] not in ("su", "ua", "au")


def faults(roles: list[str], texts: list[str], keys: list, seen: set) -> tuple[bytes, list[int]]:
    """Kinds of the rows and COUNTS; ``keys`` tell rows of equal role and text, ``seen`` has those before."""
    kinds, counts, before = bytearray(), [0, 0, 0, 0], None
    for role, text, key in zip(roles, texts, keys):
        counts[3] += _illegal(before, role)
        before = role
        end = text.rstrip(BLANKS)[-1:]
        if not end:
            counts[0] += 1
            kinds.append(GOES)
            continue
        if key in seen:
            counts[1] += 1
            kinds.append(GOES)
            continue
        seen.add(key)
        cut = end not in ".!?"
        counts[2] += cut
        initial = INITIALS.find(role[:1]) if role[:1] in ("s", "u", "a") else 3
        kinds.append(2 * initial + cut)
    return bytes(kinds), counts


def gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return min(max(known) - min(known) + 1 - len(known), LONG_MAX) if known else 0


# ---- fragments ---------------------------------------------------------------------------------

REPAIRED = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
LONGS = [T.StructField(c, T.LongType()) for c in REPORT]


def _schema(conv_type, *fields: str) -> T.StructType:
    known = {
        "open": T.BooleanType(), "turns": T.ArrayType(T.LongType()), "roles": T.ArrayType(T.StringType()),
        "texts": T.ArrayType(T.StringType()), "audit": T.StringType(), "repaired": REPAIRED, "kinds": T.BinaryType(),
        "digest": T.BinaryType(), "matrix": T.ArrayType(T.LongType()), "first_role": T.StringType(), "last_role": T.StringType(),
    }
    return T.StructType([T.StructField("conv_id", conv_type)] + [T.StructField(f, known.get(f, T.LongType())) for f in fields])


FRAGMENT = ["task", "fragment", "open", "turns", "roles", "texts", *REPORT, "audit", "repaired"]


def _batch(rows: list[dict], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist(rows, schema)


def _fragments(schema, rows_held: int, octets_held: int):
    """Sorted rows to FRAGMENT rows; conversations that are whole here are repaired at once."""

    def finished(conv, task, number, turns, roles, texts):
        kinds, counts = faults(roles, texts, list(zip(roles, texts)), set())
        audit, cost = _short_repair(kinds) if len(kinds) <= 64 else repair_kinds(kinds)
        return {
            "conv_id": conv, "task": task, "fragment": number, "open": False, "gaps": gaps(turns), **dict(zip(COUNTS, counts)),
            "cost": cost, "audit": audit, "repaired": applied(audit, NOTHING, roles, texts),
        }

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, task = to_arrow_schema(schema), TaskContext.get().partitionId()
        made, out, out_octets = 0, [], 0
        conv, begun, edge, held, octets = None, False, True, ([], [], []), 0

        def cut(is_open: bool):
            """Close the fragment in hand."""
            nonlocal made, held, octets
            number, made = (task << 32) + made, made + 1
            turns, roles, texts = held
            held, octets = ([], [], []), 0
            if not is_open:
                return finished(conv, task, number, turns, roles, texts)
            return {"conv_id": conv, "task": task, "fragment": number, "open": True, "turns": turns, "roles": roles, "texts": texts}

        for batch in batches:
            for key, turn, role, text, present in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if not begun or key != conv:
                    if begun:
                        out_octets += octets
                        out.append(cut(edge))
                    conv, edge, begun = key, not begun, True  # the first here may have begun in another task
                if present:
                    size = len(role) + len(text)
                    if held[0] and (len(held[0]) >= rows_held or octets + size > octets_held):
                        edge = True
                        out_octets += octets
                        out.append(cut(True))
                    for column, value in zip(held, (turn, role, text)):
                        column.append(value)
                    octets += size
                if out_octets > 8 * FRAGMENT_OCTETS or len(out) > 4096:
                    yield _batch(out, arrow)
                    out, out_octets = [], 0
        if begun:
            out.append(cut(True))  # the last here may go on in another task
        yield _batch(out, arrow)

    return run


def _key(conv, role: str, text: str) -> bytes:
    parts = [repr(conv), role, text]
    data = "".join(f"{len(p)}:{p}" for p in parts).encode("utf-8", "surrogatepass")
    return blake2b(data, digest_size=16).digest()


def _digests(schema):
    """Open fragments to their distinct digests."""

    def run(batches: Iterator) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for r in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                keys = {_key(r["conv_id"], *row) for row in zip(r["roles"], r["texts"])}
                yield _batch([{"digest": k, "fragment": r["fragment"]} for k in keys], arrow)

    return run


NODE = ["task", "fragment", "rows", *COUNTS, "distinct", "least", "most", "first_role", "last_role", "matrix"]


def _matrix(kinds: bytes) -> list[int]:
    """For each start state: four costs, then the four places in the order of audits."""
    out = []
    for start in range(4):
        (costs, order), total = forward(kinds, single(start))
        out += [c + total if c < NEVER else NEVER for c in costs] + list(order)
    return out


def _onward(vector: Vector, matrix: list[int]) -> tuple[Vector, int]:
    """A vector led through a fragment's matrix, as :func:`forward_step` leads it through a row."""
    costs, order = vector
    best = [(NEVER, 0, 0)] * 4
    for start in range(4):
        if costs[start] < NEVER:
            for end in range(4):
                cost, place = matrix[8 * start + end], matrix[8 * start + 4 + end]
                if cost < NEVER:
                    best[end] = min(best[end], (costs[start] + cost, order[start], place))
    ranked = sorted({b[1:] for b in best if b[0] < NEVER})
    levelled, least = _levelled([b[0] for b in best])
    return (levelled, tuple(ranked.index(b[1:]) if b[0] < NEVER else 0 for b in best)), least


def _back(costs: tuple[int, ...], matrix: list[int]) -> tuple[int, ...]:
    return _levelled([
        min((matrix[8 * s + e] + costs[e] if matrix[8 * s + e] < NEVER and costs[e] < NEVER else NEVER) for e in range(4))
        for s in range(4)
    ])[0]


def states_between(matrices: list[list[int]], start: int, end: int) -> list[int]:
    """The state before each of the fragments, by meeting in the middle."""
    if len(matrices) < 2:
        return [start] * len(matrices)
    half = len(matrices) // 2
    ahead, behind = single(start), single(end)[0]
    for m in matrices[:half]:
        ahead = _onward(ahead, m)[0]
    for m in reversed(matrices[half:]):
        behind = _back(behind, m)
    middle = crossing(ahead, behind)
    return states_between(matrices[:half], start, middle) + states_between(matrices[half:], middle, end)


def _nodes(schema):
    """Open fragments, with the digests that earlier ones have, to kinds of rows and NODE."""

    def run(batches: Iterator) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for r in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                roles, texts = r["roles"], r["texts"]
                keys = [_key(r["conv_id"], *row) for row in zip(roles, texts)]
                kinds, counts = faults(roles, texts, keys, set(r["earlier"] or []))
                known = [t for t in r["turns"] if t is not None]
                yield _batch([{
                    **{c: r[c] for c in ("conv_id", "task", "fragment", "roles", "texts")}, "kinds": kinds, "rows": len(roles),
                    **dict(zip(COUNTS, counts)), "distinct": len(set(known)), "least": min(known, default=None), "most": max(known, default=None),
                    "first_role": roles[0] if roles else None, "last_role": roles[-1] if roles else None, "matrix": _matrix(kinds),
                }], arrow)

    return run


def _joined(nodes: pd.DataFrame) -> dict:
    """One node for consecutive ones."""
    rows = nodes.sort_values("fragment").to_dict("records")
    out = {**rows[0], "rows": 0, **dict.fromkeys(COUNTS, 0), "distinct": 0, "least": None, "most": None, "first_role": None, "last_role": None}
    vectors = [(single(s), 0) for s in range(4)]
    for r in rows:
        if not r["rows"]:
            continue
        out["rows"] += r["rows"]
        for c in COUNTS:
            out[c] += r[c]
        out["illegal"] += _illegal(out["last_role"], r["first_role"])
        out["first_role"] = r["first_role"] if out["first_role"] is None else out["first_role"]
        out["last_role"] = r["last_role"]
        if not pd.isna(r["least"]):  # turns ascend, so a turn can be in two neighbours only
            out["distinct"] += r["distinct"] - (out["most"] == r["least"])
            out["least"] = r["least"] if out["least"] is None else out["least"]
            out["most"] = r["most"]
        for s, (vector, total) in enumerate(vectors):
            vector, least = _onward(vector, r["matrix"])
            vectors[s] = (vector, total + least)
    out["matrix"] = [
        x for (costs, order), total in vectors for x in [*(c + total if c < NEVER else NEVER for c in costs), *order]
    ]
    return out


def _exact(nodes: pd.DataFrame) -> pd.DataFrame:
    """Turns as Python integers: pandas would read nullable ones as floats."""
    for c in ("least", "most"):
        nodes[c] = pd.Series([None if pd.isna(x) else int(x) for x in nodes[c]], nodes.index, dtype=object)
    return nodes


def _turns_as_text(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({c: F.col(c).cast("string") for c in ("least", "most")})


def _joined_nodes(nodes: DataFrame) -> DataFrame:
    """The fragments of one task to one node, by conversation."""
    schema = nodes.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _joined(_exact(pdf))
        return pd.DataFrame([{c: out[c] for c in schema.names}]).astype({"least": object, "most": object})

    return _turns_as_text(nodes).groupBy("conv_id", "task").applyInPandas(run, schema)


def _reports(nodes: DataFrame) -> DataFrame:
    """One node a task to the report of each conversation and each task's states before and after."""
    schema = _schema(nodes.schema["conv_id"].dataType, "task", "before", "after", "final", *REPORT)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _exact(pdf).sort_values("task")
        whole = _joined(pdf)
        vector = (tuple(whole["matrix"][:4]), tuple(whole["matrix"][4:8]))
        end = last_state(vector)
        before = states_between(list(pdf["matrix"]), NOTHING, end)
        span = 0 if whole["least"] is None else min(whole["most"] - whole["least"] + 1 - whole["distinct"], LONG_MAX)
        report = {"gaps": span, **{c: whole[c] for c in COUNTS}, "cost": vector[0][end] + INSERT * len(ENDING[end])}
        out = pd.DataFrame({"conv_id": pdf["conv_id"], "task": pdf["task"], "before": before, "after": [*before[1:], end]})
        out["final"] = [0] * (len(out) - 1) + [1]
        for c, v in report.items():
            out[c] = pd.array([v] + [None] * (len(out) - 1), dtype="Int64")
        return out[schema.names]

    return _turns_as_text(nodes).groupBy("conv_id").applyInPandas(run, schema)


def _inner_states(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """The states before and after each fragment."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("fragment", "before", "after", "final", *REPORT)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fragment").reset_index(drop=True)
        n, first = len(pdf), pdf.iloc[0]
        before = states_between(list(pdf["matrix"]), int(first["before"]), int(first["after"]))
        out = pd.DataFrame({"fragment": pdf["fragment"], "before": before, "after": [*before[1:], int(first["after"])]})
        out["final"] = [0] * (n - 1) + [int(first["final"])]
        for c in REPORT:
            out[c] = pd.array([None if pd.isna(first[c]) else int(first[c])] + [None] * (n - 1), dtype="Int64")
        return out

    met = nodes.select("conv_id", "task", "fragment", "matrix").alias("n").join(
        states.alias("s"), F.col("n.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("n.task") == F.col("s.task"))
    )
    met = met.select("n.*", "s.before", "s.after", "s.final", *[F.col(f"s.{c}").cast("string").alias(c) for c in REPORT])
    return met.groupBy("conv_id", "task").applyInPandas(run, schema)


def _repaired(schema):
    """Fragments with their states to their edits and rows."""

    def run(batches: Iterator) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for r in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                audit = edits_between(r["kinds"], r["before"], r["after"]) + (ENDING[r["after"]] if r["final"] else "")
                yield _batch([{
                    **{c: r[c] for c in ("conv_id", "fragment", *REPORT)}, "open": True, "audit": audit,
                    "repaired": applied(audit, r["before"], r["roles"], r["texts"]),
                }], arrow)

    return run


PIECE = ["fragment", "open", *REPORT, "audit", "repaired"]


def repair(rows: DataFrame, present: str | None = None, fragment_rows: int = FRAGMENT_ROWS, fragment_octets: int = FRAGMENT_OCTETS) -> DataFrame:
    """rows (conv_id, turn, role, text) -> pieces of repaired conversations: conv_id, fragment (the order of the pieces),
    open (may the conversation have several pieces?), gaps, blank, duplicate, truncated, illegal, cost (null but in
    the first piece), audit (a letter an edit) and repaired (role, text).

    Rows of a conversation come by turn, null turns first; rows of one turn by the first 32 characters of ``role:text``, then by
    its md5; equal rows are adjacent, and the later ones are duplicates. A null role or text is one
    space; null ids are one conversation. ``present`` names a boolean column: rows where it is not true only name
    their conversation, which has no rows if none is present: counts and cost 0, empty audit. Other columns are
    ignored; no rows give no pieces."""
    conv_type = rows.schema["conv_id"].dataType
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    there = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), there.alias("present"))
    line = F.concat_ws(":", "role", "text")
    keys = ["conv_id", "turn", "head", "digest", "place"]
    ranged = rows.withColumns({
        "head": F.substring(line, 1, 32), "digest": F.unhex(F.md5(line)),
        "place": F.monotonically_increasing_id(),  # splits equal rows; their order among each other is no matter
    }).repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = _schema(conv_type, *FRAGMENT)
    table = written(
        ranged.select("conv_id", "turn", "role", "text", "present").mapInArrow(_fragments(schema, fragment_rows, fragment_octets), schema),
        "conversation-fragments",
    )
    parts = table.filter("open").select("conv_id", "task", "fragment", "turns", "roles", "texts")

    # 1. digests that an earlier fragment of the conversation has
    digests = parts.mapInArrow(_digests(_only("digest", "fragment")), _only("digest", "fragment"))
    first = F.min("fragment").over(Window.partitionBy("digest"))
    earlier = digests.withColumn("first", first).filter("fragment > first").groupBy("fragment").agg(
        F.collect_list("digest").alias("earlier")  # at most a fragment's rows
    )
    node_schema = _schema(conv_type, *NODE[:2], "roles", "texts", "kinds", *NODE[2:])
    coded = written(parts.join(earlier, "fragment", "left").mapInArrow(_nodes(node_schema), node_schema), "conversation-nodes")

    # 2. matrices: those of a task, then one of each task
    nodes = coded.select("conv_id", *NODE)
    states = _reports(_joined_nodes(nodes))
    inner = _inner_states(nodes, states)

    # 3. fragments between their states
    pieces = _schema(conv_type, *PIECE)
    solved = coded.select("conv_id", "fragment", "roles", "texts", "kinds").join(inner, "fragment").mapInArrow(_repaired(pieces), pieces)
    return table.filter("NOT open").select("conv_id", *PIECE).unionByName(solved)


def _only(*fields: str) -> T.StructType:
    return T.StructType(_schema(T.LongType(), *fields).fields[1:])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 not ``present``, 1 empty text, 2 without ``.!?``,
    3 twice, 4 role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fault") != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def _open_reports(schema):
    """Sorted pieces to one row a conversation; only the audit is held, texts go into the hash."""

    def run(batches: Iterator) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, current, begun = to_arrow_schema(schema), None, False
        report, audit, digest, some = {}, [], sha256(), False

        def ended():
            return _batch([{"conv_id": current, **report, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], arrow)

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if not begun or r["conv_id"] != current:
                    if begun:
                        yield ended()
                    current, begun = r["conv_id"], True
                    report, audit, digest, some = {}, [], sha256(), False
                report |= {c: r[c] for c in REPORT if r[c] is not None}
                audit.append(r["audit"])
                if r["repaired"]:
                    lines = "\n".join(f"{x['role']}:{x['text']}" for x in r["repaired"])
                    digest.update((("\n" if some else "") + lines).encode("utf-8", "surrogatepass"))
                    some = True
        if begun:
            yield ended()

    return run


def reports(pieces: DataFrame) -> DataFrame:
    """Pieces to one row a conversation: the report, the whole audit and the hash of the repaired
    ``role:text`` lines. The hash of a large conversation is one chain: its pieces go through
    one task, one at a time."""
    schema = T.StructType([
        T.StructField("conv_id", pieces.schema["conv_id"].dataType), *LONGS, T.StructField("audit", T.StringType()),
        T.StructField("repaired_sha256", T.StringType()),
    ])
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    whole = pieces.filter("NOT open").select("conv_id", *REPORT, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    several = pieces.filter("open").repartition("conv_id").sortWithinPartitions("conv_id", "fragment")
    return whole.unionByName(several.mapInArrow(_open_reports(schema), schema))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return reports(repair(damaged(rows), present="present"))
