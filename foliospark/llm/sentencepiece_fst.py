"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model: the normaliser (a space put before the text, spaces as U+2581), the pieces (an
arc per piece, weighing its negative score) and the byte fallback (arcs for characters that are no piece). A fourth one
states which pieces may follow each other: under a BPE model a pair is passed only if merging its own characters gives
just this pair. A segmentation whose adjacent pairs all pass is the one that merging the whole text gives: the first
merge across a border would also be the first across it in that pair alone. So the composed machine, searched for the
path of least weight over (min, +), gives exactly what merging by rank gives; at most one state per place is reached, as
the prefix up to there also has one segmentation. Under a model with log-probabilities every pair passes, and the path
is the most probable segmentation.

No piece reaches across the start of a run of spaces or over a character without a piece, so the path is searched
per unit between such places, and units met before come from a table of bounded size. Decoding is the inverse machine:
surfaces of pieces, bytes put together, the space before the text taken away.

Work is per text; nothing is shuffled. Defined cases: a null or empty text has no pieces and decodes to the empty text;
very long texts are taken in units; bytes that are no UTF-8 decode to U+FFFD; repeated rows and further columns stay;
columns with the names of the result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.pieces import BYTE, NORMAL, SPACE, PieceModel, load
from foliospark.llm.token_counts import runs
from foliospark.llm.words import whole_text

KNOWN = 200_000
KNOWN_PAIRS = 300_000
PAIR_BITS = 21
#: units are searched together up to these sizes, so many at once
SIZES = (8, 16, 40)
ROWS = 20_000
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
FACTOR = np.uint64(0xD6E8FEB86659FD93)
LONGEST_KNOWN = 64
#: characters of the texts encoded together
RUN = 1_000_000
UNKNOWN_PENALTY = 10.0


class Index:
    """Piece ids by hash: two tables of slots, the second for pieces whose slot in the first is taken."""

    def __init__(self, ids: dict[str, int]):
        names = list(ids)
        hashes = np.zeros(len(names), np.uint64)
        for k in range(max(map(len, names))):
            at = np.array([i for i, p in enumerate(names) if len(p) > k])
            hashes[at] = hashes[at] * FACTOR + np.array([ord(names[i][k]) for i in at], np.uint64) + np.uint64(1)
        if len(np.unique(hashes)) < len(names):
            raise ValueError("two pieces have one hash")
        numbers = np.array([ids[p] for p in names], np.int32)
        self.hash_of = np.zeros(int(numbers.max()) + 2, np.uint64)
        self.hash_of[numbers] = hashes
        self.first, self.second = np.full(SLOTS, -1, np.int32), np.full(SLOTS, -1, np.int32)
        one = self._slots(hashes, 1)
        self.first[one] = numbers
        lost = self.first[one] != numbers
        self.turn = next(t for t in range(3, 1000, 2) if len(np.unique(self._slots(hashes[lost], t))) == lost.sum())
        self.second[self._slots(hashes[lost], self.turn)] = numbers[lost]

    @staticmethod
    def _slots(hashes: np.ndarray, turn: int) -> np.ndarray:
        spread = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 * turn % 2**64)
        return (spread >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        found = self.first[self._slots(hashes, 1)]
        miss = (self.hash_of[found] != hashes) & (found >= 0)
        found[miss] = self.second[self._slots(hashes[miss], self.turn)]
        found[self.hash_of[found] != hashes] = -1
        return found


class Transducer:
    def __init__(self, model: PieceModel):
        self.model = model
        self.ids = model.normal
        self.weight = {p: -model.scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        #: beginnings of pieces that more pieces go on from
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p))}
        self.fallback = max(self.weight.values()) + UNKNOWN_PENALTY
        self.byte_ids = {int(model.pieces[i][3:5], 16): i for i, k in enumerate(model.kinds) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(model.kinds) if k not in (NORMAL, BYTE)), 0)
        # A unit starts at a run of spaces; line feeds and tabs have no piece here and stand alone.
        alone = "".join(c for c in "\n\t\r\x0b\x0c" if c not in self.ids)
        self.units = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")).findall
        #: ids of units as bytes of 32-bit numbers, which join without being read
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.index = Index(self.ids)
        #: verdicts on pairs of labels, in slots by a hash of the pair
        self.codes, self.verdicts = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        #: cost of the arc of each label; the label after the last piece is a character without one
        self.costs = np.append(-np.array(model.scores, float), self.fallback)
        self.spines: dict[str, tuple | None] = {}

    # -- machines ---------------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merged(self, text: str, trace: dict | None = None) -> list[str]:
        """The pieces that merging by rank makes of a short text: best pair first, of equals the left.

        ``trace`` gets the two parts of every piece made.
        """
        parts = list(text)
        weight = self.weight
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                w = weight.get(parts[i] + parts[i + 1])
                if w is not None and (best is None or w < best):
                    best, at = w, i
            if at < 0:
                break
            if trace is not None:
                trace[parts[at] + parts[at + 1]] = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def borders(self, piece: str) -> tuple[list, list] | None:
        """What stands at the right and the left border of a piece while it is made: (part, weight of its successor).

        None if merging does not make the piece, or not by rising weights.
        """
        found = self.spines.get(piece, 0)
        if found == 0:
            trace: dict = {}
            found = None
            if self.merged(piece, trace) == [piece]:
                weight, sides = self.weight, []
                for side in (1, 0):
                    spine, part, after, rising = [], piece, float("inf"), True
                    while True:
                        spine.append((part, after))
                        if part not in trace:
                            break
                        rising &= all(weight.get(x, -1.0) < weight[part] for x in trace[part] if len(x) > 1)
                        after, part = weight[part], trace[part][side]
                    sides.append(spine[::-1])
                if rising and all(weight[x] > max((weight[y] for y in trace[x] if len(y) > 1), default=-1.0) for x in trace):
                    found = tuple(sides)
            self.spines[piece] = found
        return found

    def follows(self, a: str, b: str) -> bool:
        """Whether piece ``b`` may stand after ``a``, or first if ``a`` is empty (both may be characters without a piece).

        It may not if, while both are made, their borders would merge sooner than either goes on by itself.
        """
        if not self.model.bpe:
            return True
        right = self.borders(b)
        if not a:
            return right is not None or self.merged(b) == [b]
        left = self.borders(a)
        if left is None or right is None:
            key = (a, b)
            ok = self.pairs.get(key)
            if ok is None:
                if len(self.pairs) > KNOWN_PAIRS:
                    self.pairs.clear()
                ok = self.pairs[key] = self.merged(a + b) == [a, b]
            return ok
        one, two, i, k, weight = left[0], right[1], 0, 0, self.weight
        while True:
            part, goes = one[i]
            other, comes = two[k]
            w = weight.get(part + other)
            if w is not None and w < goes and w <= comes:
                return False
            if goes <= comes:
                if goes == float("inf"):
                    return True
                i += 1
            else:
                k += 1

    # -- composition and shortest path ------------------------------------------------------------------------------

    def path(self, unit: str) -> list[str]:
        """Output labels of the lightest path through the machines composed with ``unit``."""
        n, weight, starts, bpe, follows = len(unit), self.weight, self.starts, self.model.bpe, self.follows
        cost: list[float] = [0.0] + [float("inf")] * n
        label = [""] * (n + 1)
        for start in range(n):
            before, base = label[start], cost[start]
            for end in range(start + 1, n + 1):
                arc = unit[start:end]
                w = weight.get(arc)
                if w is not None or end == start + 1:
                    w = base + (self.fallback if w is None else w)
                    # under BPE the prefix up to here has one segmentation, so a label once set stands
                    if (not label[end] if bpe else w < cost[end]) and follows(before, arc):
                        cost[end], label[end] = w, arc
                if arc not in starts:
                    break
        parts, end = [], n
        while end:
            parts.append(label[end])
            end -= len(label[end])
        return parts[::-1]

    def labels(self, part: str) -> list[int]:
        i = self.ids.get(part)
        if i is not None:
            return [i]
        if self.byte_ids:
            return [self.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def paths(self, units: list[str]) -> list[bytes]:
        """Piece ids of many units, as bytes of 32-bit numbers. Units of up to the largest of ``SIZES`` are searched at once."""
        out: list[bytes] = [b""] * len(units)
        low = 0
        for high in SIZES:
            block = [i for i, u in enumerate(units) if low < len(u) <= high]
            for at in range(0, len(block), ROWS):
                part = block[at : at + ROWS]
                for i, ids in zip(part, self._search([units[i] for i in part], high)):
                    out[i] = ids
            low = high
        for i, u in enumerate(units):
            if len(u) > low:
                out[i] = np.array([x for p in self.path(u) for x in self.labels(p)], np.int32).tobytes()
        return out

    def _search(self, units: list[str], longest: int) -> list[bytes]:
        """Shortest paths over (min, +) of all units: per place the least cost and the last arc of the way there."""
        none, deep, count = len(self.model.pieces), min(longest, self.longest), len(units)
        lengths = np.array([len(u) for u in units])
        chars = np.zeros((count, longest), np.uint64)
        inside = np.arange(longest) < lengths[:, None]
        chars[inside] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        # arcs of each size as rows and labels, by end; hashes grow by one character at a time
        arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        hashed = np.zeros((count, longest + 1), np.uint64)
        for size in range(1, deep + 1):
            hashed = hashed[:, :-1] * FACTOR + chars[:, size - 1 :] + np.uint64(1)
            found = self.index.find(hashed)
            found[~inside[:, size - 1 :]] = -1
            if size == 1:
                found[inside & (found < 0)] = none
            ends, rows = np.nonzero(found.T >= 0)
            arcs.append((rows, found.T[ends, rows], np.searchsorted(ends, np.arange(longest + 2 - size))))
        cost = np.full((longest + 1, count), np.inf)
        label = np.full((longest + 1, count), none + 1, np.int32)
        size_of = np.zeros((longest + 1, count), np.int8)
        cost[0] = 0.0
        for end in range(1, longest + 1):
            for size in range(min(end, deep), 0, -1):
                rows, labels, starts = arcs[size - 1]
                part = slice(starts[end - size], starts[end - size + 1])
                rows, arc = rows[part], labels[part]
                total = cost[end - size, rows] + self.costs[arc]
                better = np.flatnonzero(total < cost[end, rows])
                rows, arc, total = rows[better], arc[better], total[better]
                if self.model.bpe and len(rows):
                    ok = self._pass(label[end - size, rows], arc, none)
                    rows, arc, total = rows[ok], arc[ok], total[ok]
                cost[end, rows], label[end, rows], size_of[end, rows] = total, arc, size
        return self._labels_back(units, lengths, label, size_of)

    def _labels_back(self, units: list[str], lengths: np.ndarray, label: np.ndarray, size_of: np.ndarray) -> list[bytes]:
        """Output labels of all units from their last place back to the first."""
        every, none = np.arange(len(units)), len(self.model.pieces)
        end, steps = lengths.copy(), []
        while end.any():
            steps.append((np.where(end > 0, label[end, every], -1), end))
            end = end - size_of[end, every]
        ids = np.array([x for x, _ in steps[::-1]], np.int32).T
        ends = np.cumsum((ids >= 0).sum(1)) * 4
        joined = ids[ids >= 0].tobytes()
        out = [joined[i:j] for i, j in zip((ends - 4 * (ids >= 0).sum(1)).tolist(), ends.tolist())]
        for row in np.flatnonzero((ids == none).any(1)).tolist():
            way = [(x[row], e[row]) for x, e in steps[::-1] if x[row] >= 0]
            out[row] = np.array([i for x, e in way for i in ([x] if x < none else self.labels(units[row][e - 1]))], np.int32).tobytes()
        return out

    def _pass(self, before: np.ndarray, arc: np.ndarray, none: int) -> np.ndarray:
        """Which pairs of labels pass; a character without a piece passes everywhere."""
        codes = before.astype(np.int64) * (none + 2) + arc
        slots = (codes.astype(np.uint64) * FACTOR >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        result = self.verdicts[slots]
        new = np.flatnonzero(self.codes[slots] != codes)
        if len(new):
            pieces, made = self.model.pieces, {}
            for code in set(codes[new].tolist()):
                a, b = divmod(code, none + 2)
                made[code] = a == none or b == none or self.follows("" if a > none else pieces[a], pieces[b])
            result[new] = [made[c] for c in codes[new].tolist()]
            self.codes[slots[new]] = codes[new]
            # of several codes in one slot the last stays, and its verdict with it
            self.verdicts[slots[new]] = [made[c] for c in self.codes[slots[new]].tolist()]
        return result

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of texts."""
        known, find = self.known, self.units
        if len(known) > KNOWN:
            known.clear()
        split = [find(self.normalise(t)) for t in texts]
        new = list({u for units in split for u in units if u not in known})
        known.update(zip(new, self.paths(new)))
        out = [np.frombuffer(b"".join(map(known.__getitem__, units)), np.int32) for units in split]
        for u in new:
            if len(u) > LONGEST_KNOWN:
                del known[u]
        return out


def shared_model(spark: SparkSession, path: str):
    """A broadcast of plain lists, so that executors need nothing installed; ``machine`` is room for what they compile."""
    model = load(path)
    return spark.sparkContext.broadcast({"pieces": model.pieces, "scores": model.scores, "kinds": model.kinds, "bpe": model.bpe, "machine": None})


def model_of(shared: dict) -> PieceModel:
    return PieceModel(shared["pieces"], shared["scores"], shared["kinds"], shared["bpe"])


def machine_of(shared: dict) -> Transducer:
    """The compiled machine of a model; a worker that serves several tasks keeps it, with the units it knows."""
    if shared["machine"] is None:
        shared["machine"] = Transducer(model_of(shared))
    return shared["machine"]


class Inverse:
    """Decoding machine: bytes of every piece."""

    def __init__(self, model: PieceModel):
        surface = [
            bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k == NORMAL else b""
            for p, k in zip(model.pieces, model.kinds)
        ]
        self.all = np.frombuffer(b"".join(surface), np.uint8)
        self.size = np.array([len(x) for x in surface])
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> str:
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return ""
        at = np.arange(ends[-1]) + np.repeat(self.start[ids] - (ends - size), size)
        return self.all[at].tobytes().decode("utf-8", "replace").removeprefix(" ")


def encoder(spark: SparkSession, path: str):
    """A column function text -> array of piece ids. The model travels whole; its size is the vocabulary's."""
    shared = shared_model(spark, path)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = machine_of(shared.value)
        for batch in batches:
            for run in runs([t or "" for t in batch], RUN):
                yield pd.Series(machine.encode(run), dtype=object)

    return encode


def decoder(spark: SparkSession, path: str):
    """A column function array of piece ids -> text."""
    shared = shared_model(spark, path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = Inverse(model_of(shared.value))
        for batch in batches:
            yield pd.Series([machine.decode(np.array([], np.int32) if ids is None else ids) for ids in batch], dtype=object)

    return decode


def pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids``, and ``decoded``, what the ids read back as."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "decoded")])
    shared = shared_model(docs.sparkSession, path)

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine, inverse = machine_of(shared.value), Inverse(model_of(shared.value))
        for batch in batches:
            for run in runs(batch.tolist(), RUN):
                coded = machine.encode(run)
                yield pd.DataFrame({"ids": coded, "decoded": [inverse.decode(ids) for ids in coded]})

    return docs.withColumn("_coded", both(whole_text(text))).select(*docs.columns, "_coded.ids", "_coded.decoded")


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, ","), 256)
