import hashlib
import random
import zlib
from functools import lru_cache

import duckdb
import pytest

from hazeline.llm import conversations as C
from hazeline.llm.oracles import conversations_sql

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        said = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(said.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(hit, 1)
    return out


def brute(rows):
    """Every list of edits, with up to two insertions in a gap, as strings."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    word = {"u": "user", "a": "assistant"}

    @lru_cache(maxsize=None)
    def best(i, state, room):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if room:
            for to in follows[state].replace("s", ""):
                rest = best(i, to, room - 1)
                if rest:
                    ways.append((rest[0] + 3, "I" + rest[1], (word[to] + ":", *rest[2])))
        if i < len(rows):
            role, text = rows[i][2:]
            rest = best(i + 1, state, 2)
            if rest:
                ways.append((rest[0] + 4, "D" + rest[1], rest[2]))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                for letter, to, cost, name in [("K", role[:1], 0, role)] + [("R", x, 3, word[x]) for x in "ua"]:
                    if to and to in follows[state]:
                        rest = best(i + 1, to, 2)
                        if rest:
                            ways.append((rest[0] + cost + extra, letter + rest[1], (f"{name}:{text}", *rest[2])))
        return min(ways, default=None)

    for i in range(len(rows), 0, -1):
        for state in follows:
            best(i, state, 2)
    cost, audit, lines = best(0, "", 2)
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def order(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0, role.encode(), text.encode()[:32], hashlib.sha256(text.encode()).digest())


def expected(rows):
    ids = {r[0] for r in rows}
    hurt = damaged(rows)
    return {i: brute(sorted((r for r in hurt if r[0] == i), key=order)) for i in ids}


def conversations(seed, n, longest, roles=("user", "assistant", "system", "User", "tool", "sage", "", None)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        turn = rng.randint(-3, 3)
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 1, 3])
            text = rng.choice(["Yes.", "No!", "Why? ", "cut off", "", " \t", None, "é ", "End.\n", "x. ", f"Line {rng.randint(0, 9)}.", "a" * 40 + rng.choice("xy.")])
            rows.append((i if i else None, turn if rng.random() > 0.1 else None, rng.choice(roles), text))
    return rows


def got(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, mark string, piece int").repartition(3)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = C.repair(frame).collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: tuple(r[n] for n in names) for r in found}


def test_equals_every_list_of_edits(spark):
    rows = conversations(1, 150, 9)
    assert got(spark, rows) == expected(rows)


def test_equals_on_usual_roles(spark):
    rows = conversations(2, 120, 14, ("user", "assistant", "user", "assistant", "system"))
    assert got(spark, rows) == expected(rows)


def test_long_conversations_are_cut_into_blocks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 3)
    rows = conversations(3, 4, 90, ("user", "assistant", "user", "assistant", "system", "tool"))
    assert got(spark, rows) == expected(rows)


def test_one_conversation_over_all_ranges(spark):
    rng = random.Random(4)
    rows = [(5, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice([f"{i}.", f"{i}", "same.", ""])) for i in range(600)]
    rows += [(6, None, "user", "copy.")] * 300 + [(6, 1, "assistant", "ok.")] + [(7, 1, "user", f"{i}.") for i in range(200)]
    assert got(spark, rows) == expected(rows)


def test_blocks_give_the_whole_path(monkeypatch):
    rng = random.Random(6)
    for n in (1, 2, 5, 40):
        kinds = [rng.choice("suax") + rng.choice("xt...") for _ in range(n)]
        whole = C.solve(kinds, C.NOTHING, None)
        for block in (2, 3, 7):
            with monkeypatch.context() as m:
                m.setattr(C, "BLOCK", block)
                assert C.solve(kinds, C.NOTHING, None) == whole


def test_sql_says_the_same(spark):
    rows = conversations(8, 60, 8, ("user", "assistant", "system", None))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cols = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
    assert {r[0]: r[1:] for r in con.execute(f"SELECT {cols} FROM ({conversations_sql()})").fetchall()} == expected(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(empty).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert got(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("low,high", [(-(2**63), 2**63 - 1)])
def test_gaps_beyond_a_long(spark, low, high):
    ids = [i for i in range(200) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 > 4 for t in (low, high))]
    found = got(spark, [(ids[0], low, "user", "a."), (ids[0], high, "assistant", "b.")])
    assert found[ids[0]][0] == 0 and found[ids[0]][6] == "KK"
