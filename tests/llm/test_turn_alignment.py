"""Conversation repair: brute force over all target lengths, the SQL counterpart on odd rows, long conversations."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import pyarrow as pa
import pytest

from foliospark.llm import QUERIES, turn_alignment
from foliospark.llm.turn_alignment import Alignment, repair, steps

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain(initials, faults):
    """Cheapest (cost, audit) over every target length, all cells, audits carried along."""
    n, best = len(initials), None
    for m in [0, *range(2, 2 * n + 5)]:
        target = ("s" if m % 2 else "") + "ua" * (m // 2)
        cells = [[None] * (m + 1) for _ in range(n + 1)]
        for i in range(n, -1, -1):
            for j in range(m, -1, -1):
                options = [(0, "")] if (i, j) == (n, m) else []
                if i < n and cells[i + 1][j]:
                    options.append((cells[i + 1][j][0] + 4, "D" + cells[i + 1][j][1]))
                if j < m and target[j] != "s" and cells[i][j + 1]:
                    options.append((cells[i][j + 1][0] + 3, "I" + cells[i][j + 1][1]))
                if i < n and j < m and faults[i] not in "bd" and cells[i + 1][j + 1]:
                    cost, audit = cells[i + 1][j + 1]
                    cost += 3 * (faults[i] == "t")
                    if initials[i] == target[j]:
                        options.append((cost, "K" + audit))
                    if target[j] != "s":
                        options.append((cost + 3, "R" + audit))
                cells[i][j] = min(options, default=None)
        if cells[0][0] and (best is None or cells[0][0] < best):
            best = cells[0][0]
    return best


@pytest.mark.parametrize("block", [3, 256])
def test_alignment_by_brute_force(monkeypatch, block):
    monkeypatch.setattr(turn_alignment, "LEAST_BLOCK", block)
    rng = random.Random(block)
    for k in range(1500):
        n = rng.randrange(9) if k < 1200 else rng.randrange(9, 30)
        initials = "".join(rng.choice("suax" if k % 2 else "suauaua") for _ in range(n))
        faults = "".join(rng.choice("bdt    ") for _ in range(n))
        found = Alignment(initials, faults)
        assert (found.best, found.audit()) == plain(initials, faults)


def test_long_alignment_is_fast():
    rng = random.Random(2)
    initials = "".join("ua"[i % 2] if rng.random() > 0.05 else rng.choice("suax") for i in range(10_000))
    faults = "".join(rng.choice("bdt" + " " * 30) for _ in initials)
    start = time.perf_counter()
    found = Alignment(initials, faults)
    audit = found.audit()
    assert time.perf_counter() - start < 20
    rows, roles = steps(audit)
    made = "".join(role[0] if role else initials[row] for row, role in zip(rows, roles))
    assert re.fullmatch("(s?(ua)+)?", made)
    kept = [row for row in rows if row >= 0]
    cost = 4 * audit.count("D") + 3 * audit.count("I") + 3 * audit.count("R") + 3 * sum(faults[r] == "t" for r in kept)
    assert cost == found.best and not any(faults[r] in "bd" for r in kept)


def odd_rows():
    rng = random.Random(4)
    texts = ["Yes.", "No!", "what?", "half a", "", " \n", None, "Ünï .", "x" * 300_000 + "."]
    rows = []
    for c in [*range(120), None]:
        n = rng.choice([1, 1, 2, 3, 5, 9, 30])
        for t in range(n):
            turn = rng.choice([t, t, t, rng.randrange(12), None])
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            rows.append((c, turn, role, rng.choice(texts[:-1] if rng.random() < 0.97 else texts)))
    rows += rows[:40] + [(500, -(2**63), "user", "a."), (500, 2**63 - 1, "assistant", "b."), (501, None, "user", "a.")]
    return rows


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out.setdefault(conv, []).extend([(turn is not None, turn or 0, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return {c: [r[2:] for r in sorted(turns, key=lambda r: (r[0], r[1], r[3].encode(), r[4].encode()))] for c, turns in out.items()}


def test_repair_by_plain_rules(table):
    rows = odd_rows()
    got = {r["conv_id"]: r for r in repair(table(rows, SCHEMA).selectExpr("*", "'x' AS audit", "0 AS gaps")).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, turns in damaged(rows).items():
        row, seen, faults = got[conv], set(), []
        for _, role, text in turns:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not body else "d" if (role, text) in seen else " " if body[-1] in ".!?" else "t")
            seen.add((role, text))
        initials = "".join(role[:1] if role[:1] in ("s", "u", "a") else "x" for _, role, _ in turns)
        cost, audit = plain(initials, faults)
        known = {t for t, _, _ in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        assert row["gaps"] == (gaps if gaps < 2**63 else None)
        assert [row["blank"], row["duplicate"], row["truncated"]] == [faults.count(x) for x in "bdt"]
        assert row["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert (row["cost"], row["audit"]) == (cost, audit)
        sources, roles = steps(audit)
        lines = [f"{role or turns[s][1]}:{turns[s][2] if s >= 0 else ''}" for s, role in zip(sources, roles)]
        assert row["repaired"] == lines
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_sql_agrees_on_odd_rows(table):
    rows = [r for r in odd_rows() if r[0] != 500]
    conversations = pa.table({n: pa.array(v, t) for n, v, t in zip(("conv_id", "turn", "role", "text"), zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))})
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({turn_alignment.ORACLE})").fetchall()
    got = [tuple(r) for r in repair(table(rows, SCHEMA)).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table_and_query(spark, table):
    assert repair(table([], SCHEMA)).collect() == []
    rows = QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.001").collect()
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert len(rows) == given.select("conv_id").distinct().count() and set(rows[0].asDict()) == set(COLUMNS)
