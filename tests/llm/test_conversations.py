import random
import zlib
from functools import cache
from hashlib import sha256
from itertools import product

import pytest

from foliant.llm import conversations as con, queries

SCHEMA = "conv_id long, turn long, role string, text string, cost string, pos int"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, lines) by search over all edits, forward from each turn and state, without a fold."""

    @cache
    def rest(i, state, inserted):
        found = [(0, "", ())] if i == len(turns) and state in "na" else []
        moves = {"n": "u", "s": "u", "a": "u", "u": "a"}
        names = {"u": "user", "a": "assistant"}
        if inserted < 3:
            c, w, t = rest(i, moves[state], inserted + 1)
            found.append((c + 3, "I" + w, (f"{names[moves[state]]}:", *t)))
        if i < len(turns):
            role, text, fault = turns[i]
            c, w, t = rest(i + 1, state, 0)
            found.append((c + 4, "D" + w, t))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                to = moves[state]
                c, w, t = rest(i + 1, to, 0)
                found.append((c + 3 + more, "R" + w, (f"{names[to]}:{text}", *t)))
                initial = role[:1]
                if initial == to or (state == "n" and initial == "s"):
                    c, w, t = rest(i + 1, initial, 0)
                    found.append((c + more, "K" + w, (f"{role}:{text}", *t)))
        return min(found, default=(10**9, "", ()))

    return rest(0, "n", 0)


def brute(rows, damage=True):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        mine = damaged(mine) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in mine]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, turns = set(), []
        for _, _, role, text in mine:
            body = text.rstrip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = {r[1] for r in mine if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        count = lambda f: sum(t[2] == f for t in turns)  # noqa: B023, E731
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(tuple(turns))
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(spark, rows, damage=True):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return {r[0]: tuple(r[1:]) for r in con.report(con.damaged(table) if damage else table, table).collect()}


def made(rng, conversations, most):
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(most + 1)):
            rows.append((c, t + rng.randrange(2), rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rng.choice(["Yes.", "No!", "so", " \t", "Why?", "word " + str(t), f"Whole {t}."])))
    return rows or [(0, 0, "user", "x")]


def test_all_short_conversations(spark):
    """Every sequence of up to four turns of three roles and of good, cut and blank texts."""
    rows, conv = [], 0
    for n in range(1, 5):
        for roles in product("sua", repeat=n):
            for kinds in product(("fine.", "cut", "") if n < 4 else ("fine.", "cut"), repeat=n):
                rows += [(conv, t, {"s": "system", "u": "user", "a": "assistant"}[r], f"{t}{k}" if k else "") for t, (r, k) in enumerate(zip(roles, kinds))]
                conv += 1
    assert got(spark, rows, damage=False) == brute(rows, damage=False)


def test_damage_and_repair(spark):
    rows = made(random.Random(4), 150, 14)
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("bits", [(0, 1), (1, 1), (2, 2)])
def test_any_cut_of_the_fold(spark, monkeypatch, bits):
    """Blocks of one, two and four turns, joined two and four at a time."""
    monkeypatch.setattr(con, "BLOCK_BITS", bits[0])
    monkeypatch.setattr(con, "FAN_BITS", bits[1])
    rows = made(random.Random(8), 25, 40)
    assert got(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_odd_roles(spark):
    rows = [
        (None, None, "user", "Hi."), (None, 3, None, None), (None, 3, "assistant", "Yes."), (1, None, "", "Empty role."), (1, None, "user", "b."), (1, 5, "user", "a."), (1, 5, "user", "a."), (1, 5, "us", "a."),
        (2, 1, "assistant", "Zoë — ‘fin’?\x0b "), (2, 2, "system", "x\x00y."), (2, -4, "system", "Start."), (3, 9, "ünser", "Ja."), (4, 0, "user", "long " * 100_000 + "."), (4, 1, "assistant", "."),
    ]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, damage=False) == brute(rows, damage=False)


def test_no_rows_at_all_and_none_left(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert got(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())}
    assert got(spark, [(gone, 0, "user", "Hi."), (5, 2, "user", " ")])[gone][-2:] == ("", sha256(b"").hexdigest())
    assert got(spark, []) == {}


def test_hot_conversation(spark):
    """One of 3000 turns among small ones: the same edits as turn by turn."""
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)] + [(c, 0, "user", "Hi.") for c in range(200) if c != 7]
    cost = got(spark, rows)[7]
    d = [r for r in damaged([r for r in rows if r[0] == 7])]
    assert cost[2] + cost[1] > 0 and cost[6].count("K") + cost[6].count("D") + cost[6].count("R") == len(d)


def test_repaired_turns_are_whole(spark):
    rows = made(random.Random(9), 60, 9)
    turns = con.numbered(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    plan = con.plans(con.faults(turns))
    by = {}
    for r in sorted(con.repaired(turns, plan).collect(), key=lambda r: (r.conv_id, r.nth, r.part)):
        by.setdefault(r.conv_id, []).append(r.role[0])
    import re

    assert by and all(re.fullmatch("s?(ua)+", "".join(x)) for x in by.values())


def test_query_is_its_sql_over_the_whole_table(spark):
    import duckdb

    sf, name = "/root/testdata/sf0.001", "op12_conversation_repair"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(db.execute(queries.ORACLE_SQL[name]).fetchall())
    assert sorted(map(tuple, queries.QUERIES[name](spark, sf).collect())) == want
