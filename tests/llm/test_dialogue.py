"""Conversation repair against an enumeration of all edits, and its edge cases."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest

from tablescope.llm import dialogue

GOAL = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """(cost, audit, repaired rows) of the best of all edits; rows are (initial, role, text, must go, truncated)."""
    best = None
    fillings = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    for gaps in itertools.product(fillings, repeat=len(rows) + 1):
        for edits in itertools.product(("K", "U", "A", "D"), repeat=len(rows)):
            cost, audit, roles, kept = 0, "", "", []
            for i in range(len(rows) + 1):
                for r in gaps[i]:
                    cost, audit, roles = cost + 3, audit + "I", roles + r
                    kept.append(("user" if r == "u" else "assistant", ""))
                if i == len(rows):
                    break
                initial, role, text, must_go, cut = rows[i]
                e = edits[i]
                if e == "D":
                    cost, audit = cost + 4, audit + "D"
                    continue
                if must_go:
                    cost = 10 ** 6
                    break
                cost += (0 if e == "K" else 3) + (3 if cut else 0)
                audit += "K" if e == "K" else "R"
                roles += initial if e == "K" else e.lower()
                kept.append((role if e == "K" else {"U": "user", "A": "assistant"}[e], text))
            if cost < 10 ** 6 and GOAL.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, kept)
    return best


def judged(rows):
    """Rows (turn, role, text) of a conversation with their faults, in the operator's order."""
    rows = sorted(((-1 if t is None else t, t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0], r[2][:64], r[3][:64]))
    seen, out = set(), []
    for _, turn, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        blank = not body
        twice = (role, text) in seen
        seen.add((role, text))
        out.append((role[:1] or " ", role, text, blank or twice, body[-1:] not in tuple(".!?"), blank, twice and not blank, turn))
    return out


def expected(rows):
    rows = judged(rows)
    cost, audit, kept = brute([r[:5] for r in rows])
    turns = {r[7] for r in rows if r[7] is not None}
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": sum(r[5] for r in rows),
            "duplicate": sum(r[6] for r in rows), "truncated": sum(r[4] and not r[3] for r in rows),
            "illegal": sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()}


def random_rows(rng, n):
    return [(rng.choice([None, 0, 1, 2, 5]), rng.choice(["system", "user", "assistant", "tool", "", None, "user", "assistant"]),
             rng.choice(["Hi.", "No end", " ", "", None, "é?\n", "a ", " ", "Yes!", "So. x"])) for _ in range(n)]


SCHEMA = "conv long, turn long, role string, text string, audit int, rid string"


@pytest.mark.parametrize("piece_rows", [1, 2, 100])
def test_repair_is_the_best_of_all_edits(spark, piece_rows):
    rng = random.Random(4)
    convs = {i: random_rows(rng, rng.choice([1, 2, 2, 3])) for i in range(40)}
    convs[None] = random_rows(rng, 2)
    rows = [(c, *r, 0, "x") for c, rs in convs.items() for r in rs]
    rng.shuffle(rows)
    got = dialogue.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3), piece_rows=piece_rows)
    found = {r.conv: r.asDict() for r in got.conversations.collect()}
    assert set(found) == set(convs)
    for conv, rs in convs.items():
        want = expected(rs)
        assert {k: found[conv][k] for k in want} == want, (rs, found[conv])


def plain_search(rows):
    """Cost and audit by whole strings per state, without pruning or a tree."""
    states = {0: (0, "")}

    def relax(states):
        for a, b in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if a in states:
                new = (states[a][0] + 3, states[a][1] + "I")
                states[b] = min(states.get(b, new), new)
        return states

    states = relax(states)
    for initial, _, _, must_go, cut in rows:
        new = {s: (c + 4, a + "D") for s, (c, a) in states.items()}
        for s, (c, a) in states.items() if not must_go else ():
            fault = 3 if cut else 0
            t = 3 if s == 2 else 2
            options = [(t, (c + fault + (0 if initial == "ua"[t - 2] else 3), a + ("K" if initial == "ua"[t - 2] else "R")))]
            if s == 0 and initial == "s":
                options.append((1, (c + fault, a + "K")))
            for target, way in options:
                new[target] = min(new.get(target, way), way)
        states = relax(new)
    return min(states[s] for s in (0, 3) if s in states)


def random_steps(rng, n):
    return [(rng.choice("suauaua "), "", "", rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def test_long_conversations_and_bounded_memory():
    rng = random.Random(8)
    for trial in range(60):
        rows = random_steps(rng, rng.randint(1, 400))
        found = dialogue.search_piece([(r[0], r[3], r[4]) for r in rows], dialogue.START)
        ends = [(e["cost"], found["common"] + e["tail"]) for e in found["exits"] if e["exit"] in (0, 3)]
        assert min(ends) == plain_search(rows)
    # The open part stays short however long the conversation is.
    tree, most = dialogue.Survivors(dialogue.EMPTY), 0
    for r in random_steps(rng, 20_000):
        tree.advance(dialogue.MOVES[r[0], r[3], r[4]])
        tree.advance(dialogue.INSERTS)
        tree.prune()
        tree.settled()
        most = max([most, *(len(tree.open_labels(node)) for _, node in tree.heads.values())])
    assert most < 100


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(3)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "assistant", "system"]), f"t{i % 900}" + rng.choice([".", "", "!"]))
            for i in range(3000)]
    frame = spark.createDataFrame(rows, "conv long, turn long, role string, text string").repartition(16)
    got = dialogue.repair_conversations(frame, piece_rows=64)
    one = got.conversations.collect()[0]
    want = judged([r[1:] for r in rows])
    assert (one.cost, one.audit) == plain_search([r[:5] for r in want])
    kept = got.rows.orderBy("ord", "seq").collect()
    assert GOAL.fullmatch("".join(r.role[0] for r in kept))
    assert one.repaired_sha256 == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest()
    assert one.truncated == sum(r[4] and not r[3] for r in want) and one.duplicate == sum(r[6] for r in want)


def test_empty_tables_long_texts_and_lost_conversations(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    got = dialogue.repair_conversations(nothing)
    assert got.conversations.count() == 0 and got.rows.count() == 0
    assert dialogue.with_lost_conversations(got.conversations, nothing, "conv").count() == 0
    long = spark.createDataFrame([(1, 0, "user", "x" * 300_000), (1, 1, "assistant", " " * 300_000), (1, 2, "assistant", "word " * 90_000 + "!")],
                                 "conv long, turn long, role string, text string")
    one = dialogue.repair_conversations(long).conversations.collect()[0]
    assert (one.blank, one.truncated, one.cost, one.audit) == (1, 1, 7, "KDK")
    ids = spark.createDataFrame([(1,), (None,), (5,)], "conv_id long")
    rows = {r.conv: r for r in dialogue.with_lost_conversations(dialogue.repair_conversations(long).conversations, ids).collect()}
    assert rows[5].audit == rows[None].audit == "" and rows[5].cost == 0 and rows[1].cost == 7
    assert rows[5].repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_damage(spark):
    import zlib
    rows = [(c, t, r, x) for c, t, r, x in itertools.product((1, 2, None), (0, 1, 2, 3, 4, 5, 6, None), ("system", None), ("A. b!", None))]
    got = defaultdict(int)
    for r in dialogue.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[tuple(r)] += 1
    want = defaultdict(int)
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        r = "user" if kind == 4 else r
        x = "" if kind == 1 else re.sub(r"[.!?]", "", x) if kind == 2 else x
        want[(c, t, r, x)] += 0 if kind == 0 else 2 if kind == 3 else 1
    assert got == {k: v for k, v in want.items() if v}
