"""Conversation repair against a search over all edits and against a plain table of costs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from vigil.llm import conversations as C

WS = " \t\n\x0b\x0c\r"


def plain(rows):
    """Report of one conversation's (turn, role, text) rows in order, by a table of best (cost, audit)."""
    seen, kinds, blank, dup, cut = set(), [], 0, 0, 0
    for _, role, text in rows:
        end = text.rstrip(WS)[-1:]
        if not end:
            blank, kind = blank + 1, "delete"
        elif (role, text) in seen:
            dup, kind = dup + 1, "delete"
        else:
            kind = "cut" if end not in ".!?" else "sound"
            cut += kind == "cut"
        seen.add((role, text))
        kinds.append(kind)
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", [])}  # state -> cost, audit, repaired lines

    def better(table, state, option):
        if state not in table or option[:2] < table[state][:2]:
            table[state] = option

    def inserted(table):
        for _ in range(6):
            for state, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in legal:
                        better(table, legal[state, role[0]], (cost + 3, audit + "I", [*lines, f"{role}:"]))
        return table

    for (_, role, text), kind in zip(rows, kinds):
        after = {}
        for state, (cost, audit, lines) in inserted(dict(best)).items():
            better(after, state, (cost + 4, audit + "D", lines))
            extra = 3 if kind == "cut" else 0
            if kind != "delete":
                if (state, role[:1]) in legal:
                    better(after, legal[state, role[:1]], (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
                for other in ("user", "assistant"):
                    if (state, other[0]) in legal:
                        better(after, legal[state, other[0]], (cost + 3 + extra, audit + "R", [*lines, f"{other}:{text}"]))
        best = after
    best = inserted(dict(best)) if rows else best
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_brute_force(rows):
    """Reports of damaged (conv_id, turn, role, text) rows by conversation."""
    held = {}
    for conv, turn, role, text in rows:
        mine = held.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        mine.extend([(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1))

    def order(r):
        line = f"{r[1]}:{r[2]}"
        return (r[0] is not None, r[0] or 0, line[:32].encode(), hashlib.md5(line.encode()).digest())

    return {conv: plain(sorted(mine, key=order)) for conv, mine in held.items()}


def reported(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def every_audit(kinds):
    """All edits of a few rows by exhaustive search: least (cost, audit)."""
    found = []

    def go(at, state, cost, audit, spare):
        if cost > 30:
            return
        if at == len(kinds) and state in (C.NOTHING, C.ASSISTANT):
            found.append((cost, audit))
        if spare:
            go(at, C.ONWARD[state], cost + 3, audit + "I", spare - 1)
        if at < len(kinds):
            go(at + 1, state, cost + 4, audit + "D", 2)
            if kinds[at] != C.GOES:
                extra = 3 * (kinds[at] % 2)
                go(at + 1, C.ONWARD[state], cost + 3 + extra, audit + "R", 2)
                kept = C.LEGAL.get((state, C.INITIALS[kinds[at] // 2]))
                if kept is not None:
                    go(at + 1, kept, cost + extra, audit + "K", 2)

    go(0, C.NOTHING, 0, "", 2)
    return min(found)


def test_repair_equals_exhaustive_search():
    import itertools
    import random

    for n in range(4):
        for kinds in itertools.product(range(C.GOES + 1), repeat=n):
            assert C.repair_kinds(bytes(kinds))[::-1] == every_audit(kinds), kinds
    rng = random.Random(5)
    for _ in range(60):
        kinds = bytes(rng.choices(range(C.GOES + 1), k=6))
        assert C.repair_kinds(kinds)[::-1] == every_audit(kinds), kinds


def test_states_between_fragments_equal_one_piece():
    import random

    rng = random.Random(9)
    for _ in range(200):
        kinds = bytes(rng.choices(range(C.GOES + 1), k=rng.randint(1, 40)))
        cuts = sorted(rng.sample(range(len(kinds) + 1), min(5, len(kinds))))
        parts = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, len(kinds)])]
        vector, total = C.forward(kinds, C.single(C.NOTHING))
        end = C.last_state(vector)
        before = C.states_between([C._matrix(p) for p in parts], C.NOTHING, end)
        audit = "".join(C.edits_between(p, a, b) for p, a, b in zip(parts, before, [*before[1:], end]))
        assert audit + C.ENDING[end] == C.repair_kinds(kinds)[0]


EDGE = [
    *[(1, t, ["system", "user", "assistant"][min(t, 1) + (t % 2 == 0 and t > 0)], f"turn {t}.") for t in range(12)],
    (2, 0, None, None), (2, None, "user", "no turn"), (2, None, "user", "no turn"), (2, 7, "tool", "result!"),
    (None, 0, "user", "null id?"), (None, 1, "assistant", "yes."), (None, 1, "assistant", "yes."),
    (3, 5, "user", " \t\n"), (4, 9, "", ""), (5, 0, "user", "x" * 200_000 + "."), (5, 1, "assistant", "😀 ünd 日本  "),
    (6, -3, "assistant", "starts late."), (6, 4, "user", "and ends"), (6, 4, "user", "with ties."), (6, 4, "assistant", "of one turn."),
    *[(7, t, "user" if t % 3 else "assistant", "same." if t % 5 == 0 else f"t{t}") for t in range(90)],
    *[(8, 1, "user", "hot row.") for _ in range(40)],
]


@pytest.mark.parametrize("limits", [(4096, 1_000_000), (3, 1_000_000), (4096, 20)])
def test_edge_rows_equal_brute_force(spark, limits):
    df = spark.createDataFrame(EDGE, "conv_id long, turn long, role string, text string").repartition(3)
    clash = df.withColumns({c: F.lit("x") for c in ("task", "fragment", "open", "head", "digest", "place", "copy", "fault", "matrix", "earlier")})
    got = reported(C.reports(C.repair(C.damaged(clash), "present", *limits)))
    assert got == by_brute_force(EDGE)


def test_given_conversations_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reported(C.op11_conversation_repair(spark, sf)) == by_brute_force(rows)


def test_no_rows_and_undamaged_conversations(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert C.reports(C.repair(spark.createDataFrame([], schema))).count() == 0
    rows = [("a", 0, "user", "Hello."), ("a", 1, "assistant", "Hi!"), ("b", 0, "system", "Be brief.")]
    got = reported(C.reports(C.repair(spark.createDataFrame(rows, schema))))
    assert got["a"][:7] == (0, 0, 0, 0, 0, 0, "KK")
    assert got["b"][5:7] == (4, "D")
    assert got["b"][7] == hashlib.sha256(b"").hexdigest()
