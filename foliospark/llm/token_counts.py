"""Token counts by rank-synchronous array merging.

The tokenizer is byte-level BPE with word ends, read from a ``.json`` file: NFC, lower case, pre-tokens by pattern,
bytes as symbols, merges by rank. All new pre-tokens of a batch are held as one ragged numpy array of symbols; in each
round every pre-token merges the pairs of its lowest rank at once (of overlapping ones the left), pre-tokens without a
pair leave the array, and what is left of them are their token counts. Counts of pre-tokens met before come from a
table of bounded size. Special strings inside texts count as one token and part the text, as the library does it.

Work is per text, so nothing is shuffled. Texts are taken whole, in runs of about ``RUN`` characters, so memory follows
the longest text and not the Arrow batch. Defined cases: a null text is an empty one with 0 tokens; repeated rows and
further columns stay; columns with the names of the result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.words import whole_text

RUN = 2_000_000
KNOWN = 300_000
LONGEST_KNOWN = 64
#: Unicode white space, as the file's patterns understand it
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class MergeTable:
    """Symbols and merges of a tokenizer file as arrays that travel to the tasks; its size is the vocabulary's."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE)
        shown = _byte_letters()
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[shown[b] + suffix] for b in range(256)], np.int64)
        self.width = len(vocab) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]

    @classmethod
    def of(cls, parts: dict) -> MergeTable:
        table = cls.__new__(cls)
        vars(table).update(parts)
        return table


def _byte_letters() -> list[str]:
    """The letter byte-level BPE shows for each byte: printable Latin-1 as itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(rest)) for b in range(256)]


def merge_all(table: MergeTable, tokens: list[bytes]) -> np.ndarray:
    """Number of symbols that each (non-empty) pre-token ends with."""
    n = len(tokens)
    counts = np.zeros(n, np.int64)
    if not n:
        return counts
    lengths = np.array([len(t) for t in tokens], np.int64)
    raw = np.frombuffer(b"".join(tokens), np.uint8)
    symbols = table.inner[raw]
    ends = np.cumsum(lengths)
    symbols[ends - 1] = table.last[raw[ends - 1]]
    owner = np.repeat(np.arange(n), lengths)
    none = np.int64(len(table.keys))
    while len(symbols):
        # one entry per symbol: the pair it forms with the next one of the same pre-token
        keys = symbols[:-1] * table.width + symbols[1:]
        at = np.minimum(np.searchsorted(table.keys, keys), len(table.keys) - 1)
        fits = (table.keys[at] == keys) & (owner[:-1] == owner[1:])
        rank = np.full(len(symbols), none)
        rank[:-1][fits] = table.ranks[at[fits]]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, len(symbols)])
        lowest = np.minimum.reduceat(rank, starts)
        done = lowest == none
        counts[owner[starts[done]]] = sizes[done]
        chosen = (rank == np.repeat(lowest, sizes)) & (rank < none)
        where = np.flatnonzero(chosen)
        if not len(where):
            break
        # in a chain of overlapping pairs every second one stands
        first = np.r_[True, np.diff(where) != 1]
        chain = np.flatnonzero(first)
        step = np.arange(len(where)) - np.repeat(chain, np.diff(np.r_[chain, len(where)]))
        where = where[step % 2 == 0]
        symbols = symbols.copy()
        symbols[where] = table.made[at[where]]
        keep = np.repeat(~done, sizes)
        keep[where + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return counts


class Counter:
    """Counts tokens of texts; holds the counts of at most ``KNOWN`` pre-tokens."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.find = regex.compile(table.pattern).findall
        self.part = regex.compile("|".join(map(regex.escape, table.specials))).split if table.specials else None
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and how many special strings stand in it."""
        if self.part and any(s in text for s in self.table.specials):
            parts = self.part(text)
            found = [t for p in parts for t in self.pre_tokens(p)[0]]
            return found, len(parts) - 1
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: letters are lowered one by one
        return self.find(text.lower()), 0

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pre_tokens(t) for t in texts]
        known = self.known
        new = list({t for tokens, _ in split for t in tokens if t not in known})
        got = merge_all(self.table, [t.encode("utf-8", "surrogatepass") for t in new]).tolist()
        now = dict(zip(new, got))
        known |= now
        counts = [sum(map(known.__getitem__, tokens)) + special for tokens, special in split]
        if len(known) > KNOWN:
            known.clear()
        else:
            for t in new:
                if len(t) > LONGEST_KNOWN:
                    del known[t]
        return counts


def runs(values: list, size: int = RUN) -> Iterator[list]:
    """Cuts a list of texts into runs of about ``size`` characters, at least one text each."""
    run, chars = [], 0
    for v in values:
        run.append(v)
        chars += len(v)
        if chars >= size:
            yield run
            run, chars = [], 0
    if run:
        yield run


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens)."""
    made = {"n_bytes", "n_tokens", "over_limit"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    # plain arrays as large as the vocabulary; executors need nothing installed
    shared = docs.sparkSession.sparkContext.broadcast(vars(MergeTable(path)))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(MergeTable.of(shared.value))
        for batch in batches:
            yield pd.Series([n for run in runs(batch.tolist()) for n in counter.count(run)], dtype="int64")

    t = whole_text(text)
    return (
        docs.withColumn("n_bytes", F.octet_length(t).cast("long"))
        .withColumn("n_tokens", tokens(t))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
