"""Conversation repair by Wagner-Fischer alignment of turns to the alternating grammar ``(s?(ua)+)?``.

Turns may be kept, given another role, deleted, or inserted with an empty text. For every length there is one target
string of role initials (an odd length begins with ``s``), and all targets share their tails, so one edit-distance
table over (turns from the end, symbols left) holds the alignment to each length. It is filled by rows of numpy arrays
within Ukkonen's band: a first narrow band gives a cost that is reached, and cells farther from the diagonal than that
cost allows cannot lie on a cheapest path. Every length of least cost is traced back, by the least letter first, and
the audits are compared, so ties give the least audit in ASCII order.

Faults of turns, all texts and the repaired conversation are columns; only two letters and a digest per turn reach
Python. The table's rows are kept for a block of about the square root of the turns and computed anew for the others
during the trace. A conversation is one value by its contract (one digest over its repaired turns) and so one row; each
row costs one task memory in proportion to its own length, and conversations are independent.

Defined cases: null roles and texts, and nulls in the text that decides on damage, are one space; a null conversation id
is a conversation of its own; turns are ordered by turn (null first), role and text; equal rows stay and the later one
is a duplicate; a conversation without rows has zeros, an empty audit and the digest of the empty string; ``gaps``
beyond a long is null; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.words import SPACES

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
FAR = 1 << 40
#: first band on either side of the diagonal
NARROW = 2
LEAST_BLOCK = 256
VERDICT = (
    "blank long, duplicate long, truncated long, illegal long, cost long, audit string, rows array<int>, roles array<string>"
)


class Alignment:
    """Costs of aligning the turns from each one on to the last symbols of the grammar string.

    ``initials`` are ``s``, ``u``, ``a`` or another letter per turn, ``faults`` are ``b``, ``d``, ``t`` or a blank.
    """

    def __init__(self, initials: str, faults: str):
        self.n = len(initials)
        self.initials, self.faults = initials, faults
        self.gone = [f in "bd" for f in faults]
        self.late = [TRUNCATED if f == "t" else 0 for f in faults]
        self.least = DELETE * sum(self.gone) + sum(self.late)
        self.block = max(LEAST_BLOCK, isqrt(self.n) + 1)
        best, ends = self._align(NARROW, NARROW)
        # paths that stray farther need more inserts or deletions than the cost reached pays for
        self.below, self.above = best // DELETE, max(0, best - self.least) // INSERT
        self.best, self.ends = self._align(self.below, self.above)

    # The row of turn i holds, at place o, the cost with r = o - below + n - i symbols left.

    def _last(self, below: int, above: int) -> np.ndarray:
        left = np.arange(-below, above + 1, dtype=np.int64)
        return np.where(left < 0, FAR, INSERT * left)

    def _row(self, i: int, after: np.ndarray, below: int) -> np.ndarray:
        width = len(after)
        start = self.n - i - below
        row = np.full(width, FAR, np.int64)
        row[:-1] = after[1:] + DELETE
        if not self.gone[i]:
            # symbols left are odd at an assistant's turn
            odd, even = [self.late[i] + (0 if self.initials[i] == c else REROLE) for c in "au"]
            step = np.empty(width, np.int64)
            step[::2], step[1::2] = (odd, even) if start % 2 else (even, odd)
            taken = after + step
            if start <= 0:
                taken[: 1 - start] = FAR
            np.minimum(row, taken, out=row)
        if start < 0:
            row[:-start] = FAR
        slope = INSERT * np.arange(width, dtype=np.int64)
        return np.minimum.accumulate(row - slope) + slope

    def _align(self, below: int, above: int) -> tuple[int, list[tuple[int, int]]]:
        """Least cost and where it is reached: (turn kept as system or -1, symbols in the target after it)."""
        n, row = self.n, self._last(below, above)
        found: list[tuple[int, int, int]] = []
        self.saved = {n: row}
        system = [i for i in range(n) if self.initials[i] == "s" and not self.gone[i]]
        wanted = set(system)
        for i in range(n - 1, -1, -1):
            if i in wanted:
                self._ends(found, row, i + 1, below, i, DELETE * i + self.late[i], 2)
            row = self._row(i, row, below)
            if i % self.block == 0:
                self.saved[i] = row
        self._ends(found, row, 0, below, -1, 0, 0)
        best = min(c for c, _, _ in found)
        return best, [(i, r) for c, i, r in found if c == best]

    def _ends(self, found: list, row: np.ndarray, at: int, below: int, system: int, before: int, least: int) -> None:
        """Cheapest even target lengths of one row."""
        start = self.n - at - below
        first = max(least, start + start % 2)
        places = np.arange(first - start, len(row), 2)
        if len(places):
            costs = row[places] + before
            low = int(costs.min())
            if low < FAR and (not found or low <= min(c for c, _, _ in found)):
                found += [(low, system, int(p) + start) for p in places[costs == low]]

    def _rows(self, low: int) -> dict[int, np.ndarray]:
        """The table's rows of one block, computed from the saved row after it."""
        high = min(self.n, low + self.block)
        rows = {high: self.saved[high]}
        for i in range(high - 1, low - 1, -1):
            rows[i] = self._row(i, rows[i + 1], self.below)
        return rows

    def _trace(self, rows: dict[int, np.ndarray], at: int, stop: int, left: int) -> tuple[str, int]:
        """The least letters of a cheapest way through the turns of a block, and the symbols then left."""
        letters = []
        while at < stop:
            here, after, place = rows[at], rows[at + 1], left - (self.n - at - self.below)
            cost = here[place]
            if place + 1 < len(here) and after[place + 1] + DELETE == cost:
                letters.append("D")
                at += 1
            elif left and place and here[place - 1] + INSERT == cost:
                letters.append("I")
                left -= 1
            else:
                letters.append("K" if self.initials[at] == ("a" if left % 2 else "u") else "R")
                at += 1
                left -= 1
        return "".join(letters), left

    def audit(self) -> str:
        """The least audit over all targets of least cost; each block's rows are computed once for all of them."""
        ways = [["D" * system + "K", system + 1, left] if system >= 0 else ["", 0, left] for system, left in self.ends]
        for low in range(0, self.n, self.block):
            stop = min(self.n, low + self.block)
            rows = self._rows(low)
            for way in ways:
                if way[1] < stop:
                    letters, way[2] = self._trace(rows, way[1], stop, way[2])
                    way[0], way[1] = way[0] + letters, stop
        return min(letters + "I" * left for letters, _, left in ways)


def steps(audit: str) -> tuple[list[int], list[str | None]]:
    """Per turn of the repaired conversation its source row (-1 for inserted ones) and its new role, if any."""
    size = sum(c != "D" for c in audit)
    rows, roles, at = [], [], 0
    for letter in audit:
        if letter != "D":
            rows.append(-1 if letter == "I" else at)
            roles.append(None if letter == "K" else ("assistant" if size % 2 else "user"))
            size -= 1
        at += letter != "I"
    return rows, roles


def examine(codes: str, digests: str) -> tuple:
    """The verdict on a conversation: two letters per turn (initial, fault) and 64 per turn of its digest."""
    initials, faults, seen = codes[::2], list(codes[1::2]), set()
    for i in range(len(initials)):
        digest = digests[64 * i : 64 * i + 64]
        if faults[i] != "b" and digest in seen:
            faults[i] = "d"
        seen.add(digest)
    illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
    alignment = Alignment(initials, "".join(faults))
    audit = alignment.audit()
    return (faults.count("b"), faults.count("d"), faults.count("t"), illegal, alignment.best, audit, *steps(audit))


def verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in VERDICT.split(", ")]
    for codes, digests in batches:
        yield pd.DataFrame([examine(c, d) for c, d in zip(codes, digests)], columns=names)


def damaged(rows: DataFrame) -> DataFrame:
    """Columns conv_id and ``_turn``: the row after damage, null if it is dropped, and how often it stands."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    times = F.when(kind == 3, 2).otherwise(1)
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("text"), times.alias("times"))
    return rows.select("conv_id", F.when(kind != 0, turn).alias("_turn"))


def _code(turn: Column) -> Column:
    """Two letters of a turn: its role's initial (``x`` for any other) and its fault, but for duplicates."""
    first = F.left(turn["role"], F.lit(1))
    body = F.rtrim(turn["text"], F.lit(SPACES))
    fault = F.when(body == "", "b").when(F.right(body, F.lit(1)).isin(".", "!", "?"), " ").otherwise("t")
    return F.concat(F.when(first.isin("s", "u", "a"), first).otherwise("x"), fault)


def _gaps(turns: Column) -> Column:
    known = F.array_distinct(F.filter(F.transform(turns, lambda t: t["turn"]), lambda t: t.isNotNull()))
    wide = "decimal(38,0)"
    span = F.array_max(known).cast(wide) - F.array_min(known).cast(wide) + 1 - F.size(known)
    return F.when(F.size(known) == 0, F.lit(0).cast("long")).otherwise(span.try_cast("long"))


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: faults, least cost, its audit, the repaired turns (``role:text``) and their digest."""
    turns = damaged(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    turns = turns.withColumn("_turns", F.flatten(F.transform("_turns", lambda t: F.array_repeat(t, t["times"]))))
    codes = F.array_join(F.transform("_turns", _code), "")
    # a role's length before it keeps pairs of role and text apart
    digests = F.transform("_turns", lambda t: F.sha2(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256))
    examined = F.pandas_udf(verdicts, VERDICT)
    seen = turns.withColumn("_v", examined(codes, F.array_join(digests, "")))
    places = F.arrays_zip(F.col("_v.rows").alias("row"), F.col("_v.roles").alias("role"))

    def line(step: Column) -> Column:
        source = F.get("_turns", step["row"])
        return F.concat(F.coalesce(step["role"], source["role"]), F.lit(":"), F.coalesce(source["text"], F.lit("")))

    made = seen.withColumn("repaired", F.transform(places, line))
    return made.select(
        "conv_id", _gaps(F.col("_turns")).alias("gaps"), "_v.blank", "_v.duplicate", "_v.truncated", "_v.illegal", "_v.cost", "_v.audit",
        F.sha2(F.array_join("repaired", "\n"), 256).alias("repaired_sha256"), "repaired",
    )


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text."""
    halves = "[-1, -1, -1, -1, -1, -1, -1, -1]"
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_prepend(ascii(c)::BIGINT, {halves}::BIGINT[])))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, x: {step}), 4294967295)"


def _oracle() -> str:
    """Repair by a fold over the turns from the last: the cheapest (cost, audit, text) per symbol expected next."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    add = "{{'c': {0}.c + {1}, 'a': {2} || {0}.a, 't': {3} || {0}.t}}".format
    none = "{'c': 1000000000::BIGINT, 'a': 'Z', 't': ''}"
    ins = {"u": "'user:' || chr(10)", "a": "'assistant:' || chr(10)"}
    own = "x.role || ':' || x.text || chr(10)"

    def take(symbol: str, after: str) -> str:
        role = {"u": "user", "a": "assistant"}[symbol]
        kept = add(after, "x.late", "'K'", own)
        moved = add(after, "x.late + 3", "'R'", f"'{role}:' || x.text || chr(10)")
        return f"CASE WHEN x.gone THEN {none} WHEN x.initial = '{symbol}' THEN {kept} ELSE {moved} END"

    gone = {k: add(f"s.{k}", "4", "'D'", "''") for k in "euaz"}
    deleted_and_taken = {
        "e": gone["e"],
        "u": f"least({gone['u']}, {take('u', 's.a')})",
        "a": f"least({gone['a']}, {take('a', 'least(s.e, s.u)')})",
        "z": f"least({gone['z']}, CASE WHEN x.gone OR x.initial <> 's' THEN {none} ELSE {add('s.u', 'x.late', chr(39) + 'K' + chr(39), own)} END)",
    }
    base = "{" + ", ".join(f"'{k}': {v}" for k, v in deleted_and_taken.items()) + "}"
    # inserts: an assistant before the end or before a user, a user before an assistant, both before the end
    i_a = lambda s: add(s, "3", "'I'", ins["a"])
    i_u = lambda s: add(s, "3", "'I'", ins["u"])
    i_ua = lambda s: add(s, "6", "'II'", f"{ins['u']} || {ins['a']}")
    closed = "{{'e': {0}.e, 'u': least({0}.u, {1}, {2}), 'a': least({0}.a, {3}, {4}), 'z': {0}.z}}".format
    fold = f"list_transform([{base}], lambda b: {closed('b', i_u('b.a'), i_ua('b.e'), i_a('b.e'), i_a('b.u'))})[1]"
    end = "{'c': 0::BIGINT, 'a': '', 't': ''}"
    first = f"{{'e': {end}, 'u': {i_ua(end)}, 'a': {i_a(end)}, 'z': {none}}}"
    return f"""
    WITH given AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
        FROM conversations
    ), rows AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
        FROM given WHERE kind <> 0
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
            rtrim(text, {space}) AS body, left(role, 1) AS initial
        FROM rows
    ), counted AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth FROM placed
    ), judged AS (
        SELECT *, body = '' AS blank, body <> '' AND nth > 1 AS duplicate,
            body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
            lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair
        FROM counted
    ), folded AS (
        SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
            count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
            list({{'role': role, 'text': text, 'initial': initial, 'gone': blank OR duplicate, 'late': CASE WHEN truncated THEN 3 ELSE 0 END::BIGINT}}
                ORDER BY place DESC) AS turns
        FROM judged GROUP BY conv_id
    ), solved AS (
        SELECT conv_id, gaps, blank, duplicate, truncated, illegal,
            list_transform([list_reduce(turns, lambda s, x: {fold}, {first})], lambda s: least(s.e, s.u, s.z))[1] AS best
        FROM folded
    )
    SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
        coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
        coalesce(best.a, '') AS audit, sha256(regexp_replace(coalesce(best.t, ''), '\\n$', '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN solved ON ids.conv_id IS NOT DISTINCT FROM solved.conv_id
    """


ORACLE = _oracle()
