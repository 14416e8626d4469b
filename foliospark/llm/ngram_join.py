"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

A document's set holds its distinct shingles of five words (A-Z in lower case), or its whole word sequence as one if it
has fewer. Documents whose sets have a Jaccard similarity of at least 80 % are linked; links are united to components.

Light sets (few shingles) enumerate their subsets of the size that a similar set of each possible size must share with
them; equal subsets meet in a list. Heavy sets go through inverted lists: shingles are put in an order that all sets
share, rare ones first, and a set is listed under its first n - ceil(0.8 n) + 1 shingles, since two similar sets share
one of those. The size at which sets become heavy is the one with the least cost: subsets written, or entries written
times the length of lists. Both kinds of lists go on as one table.

The common order comes from counts of all shingles in 65,536 buckets, so shared passages and boilerplate stand last
whatever the corpus; any order is right, a good one keeps lists short. Lists of one set are dropped. In a long list not
all pairs are formed: first every set is compared with the set in which the shingle stands earliest, which joins a group
of copies by as many pairs as it has members. Lists whose sets are then of one component are done; of the others, only
sets of different components are paired. Pairs go on only if sizes, places and the number of shared entries allow 80 %,
and are then verified on whole sets, so no link between different components is lost and none is added.

Sets are known by a 64-bit sum of mixed shingle hashes; equal sets are one from the start, so exact copies cost one
entry per task. Shingle hashes have 64 bits. Texts are read three times instead of moving sets: for counts, for lists,
and for the sets of candidates, found through a bitmap of fixed size.

Defined cases: null and empty texts and texts without words have no shingles and are linked with nothing; rows with a
null id are answered with a null component and take no part; rows repeating an id are answered each; further columns
are not returned; an empty table gives an empty result. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.components import components
from foliospark.llm.token_counts import runs
from foliospark.llm.words import whole_text
from foliospark.plans.session import stored

WORDS = 5
BUCKET_BITS = 16
BITMAP_BITS = 24
#: sets up to this size may be light
MOST_LIGHT = 12
SEEN = 200_000

_BYTES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.array([0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes: only A-Z change
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    bounds = np.cumsum([len(r) + 1 for r in raw])
    inside = ~_SPACE[data]
    edge = np.diff(np.r_[False, inside].astype(np.int8))
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    if not len(starts):
        return [np.empty(0, np.uint64) for _ in texts]
    lengths = ends - starts
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(lengths.max()), _STEP | np.uint64(1))])
    place = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    value = np.where(inside, _BYTES[data] * powers[np.where(inside, place, 0)], np.uint64(0))
    word = mix(np.add.reduceat(value, starts) + lengths.astype(np.uint64))
    count = len(word) - words + 1
    shingles = np.zeros(len(word), np.uint64)
    if count > 0:
        total = np.zeros(count, np.uint64)
        for k in range(words):
            total += mix(word[k : k + count] + _PLACES[k % len(_PLACES)] + np.uint64(k // len(_PLACES)))
        shingles[:count] = mix(total)
    first = np.searchsorted(starts, np.r_[0, bounds[:-1]])
    last = np.r_[first[1:], len(starts)]
    sets = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= words:
            sets.append(np.unique(shingles[a : b - words + 1]))
        elif b > a:
            short = sum((mix(word[a + k : a + k + 1] + _PLACES[k % len(_PLACES)]) for k in range(b - a)), np.zeros(1, np.uint64))
            sets.append(mix(short ^ np.uint64(b - a)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def set_id(s: np.ndarray) -> int:
    """64-bit name of a set, as a signed number."""
    parts = np.r_[mix(s ^ _STEP), mix(np.array([len(s)], np.uint64))]
    return int(parts.sum(dtype=np.uint64).astype(np.int64))


def buckets(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def common(a: int, b: int, percent: int) -> int:
    """Least number of common shingles of similar sets of sizes ``a`` and ``b``."""
    return -(-percent * (a + b) // (100 + percent))


def listed(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def light_limit(sizes: dict[int, int], length: float, percent: int) -> int:
    """The largest light size with the least cost; ``length``: other entries met per entry of an inverted list."""

    def subsets(n: int, limit: int) -> int:
        return sum(comb(n, common(n, m, percent)) for m in partner_sizes(n, percent) if m <= limit and common(n, m, percent) <= n)

    def cost(limit: int) -> float:
        total = 0.0
        for n, docs in sizes.items():
            if n <= limit:
                total += docs * subsets(n, limit)
            if max(partner_sizes(n, percent), default=n) > limit:
                total += docs * listed(n, percent) * (1 + length)
        return total

    return min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def light_keys(s: np.ndarray, limit: int, percent: int) -> list[int]:
    """Hashes of the subsets a light set shares with similar light sets."""
    n, mixed, out = len(s), mix(s + _PLACES[0]), []
    for m in partner_sizes(n, percent):
        c = common(n, m, percent)
        if m > limit or not 0 < c <= n:
            continue
        tag = mix(np.array([min(n, m) << 20 | max(n, m)], np.uint64))
        for chosen in combinations(range(n), c):
            out.append(np.r_[mixed[list(chosen)], tag].sum(dtype=np.uint64))
    return mix(np.array(out, np.uint64)).astype(np.int64).tolist() if out else []


def _known(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))


def _rate(docs: DataFrame, words: int) -> DataFrame:
    """Rows kind 0: (doc_id, size, set); rows kind 1: (bucket, entries), one per task and used bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            sizes, names = [], []
            for texts in runs(batch["text"].tolist()):
                for s in shingle_sets(texts, words):
                    sizes.append(len(s))
                    names.append(set_id(s))
                    if len(s):
                        used += np.bincount(buckets(s), minlength=len(used))
            yield pd.DataFrame({"kind": 0, "doc_id": batch["doc_id"].astype("Int64"), "size": sizes, "name": names})
        at = np.flatnonzero(used)
        yield pd.DataFrame({"kind": 1, "doc_id": pd.Series(at, dtype="Int64"), "size": used[at], "name": 0})

    return docs.mapInPandas(run, "kind int, doc_id long, size long, name long")


def _entries(docs: DataFrame, order: np.ndarray, limit: int, percent: int, words: int, only: np.ndarray | None = None) -> DataFrame:
    """List entries (key, place, size, name) of every set; a task writes a set that it meets again only once.

    ``only``: bitmap of keys that are wanted.
    """
    shared = docs.sparkSession.sparkContext.broadcast((order, only))  # one number per bucket, and a bitmap of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (rank, wanted), seen = shared.value, set()
        for batch in batches:
            for texts in runs(batch["text"].tolist()):
                keys, places, sizes, names = [], [], [], []
                for s in shingle_sets(texts, words):
                    n, name = len(s), set_id(s)
                    if not n or name in seen:
                        continue
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(name)
                    if n <= limit:
                        found = light_keys(s, limit, percent)
                        keys.append(np.array(found, np.int64))
                        places.append(np.zeros(len(found), np.int32))
                        sizes.append(np.full(len(found), n))
                        names.append(np.full(len(found), name))
                    if max(partner_sizes(n, percent)) > limit:
                        order_in = np.argsort(rank[buckets(s)], kind="stable")[: listed(n, percent)]
                        keys.append(s[order_in].astype(np.int64))
                        places.append(np.arange(len(order_in), dtype=np.int32))
                        sizes.append(np.full(len(order_in), n))
                        names.append(np.full(len(order_in), name))
                if keys:
                    made = {"key": keys, "place": places, "size": sizes, "name": names}
                    made = {c: np.concatenate(v) for c, v in made.items()}
                    if wanted is not None:
                        hit = _in_bitmap(wanted, made["key"])
                        made = {c: v[hit] for c, v in made.items()}
                    yield pd.DataFrame(made)

    return docs.select("text").mapInPandas(run, "key long, place int, size int, name long")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of the values in column h, modulo a fixed number of bits; at most 2 ** (BITMAP_BITS - 6) rows reach the driver."""
    h = F.pmod("h", F.lit(1 << BITMAP_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))
    found = hashes.groupBy(F.shiftright(h, 6).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bitmap[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bitmap.view(np.uint64)


def _in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.astype(np.uint64) & np.uint64((1 << BITMAP_BITS) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _sets_of(docs: DataFrame, names: DataFrame, words: int) -> DataFrame:
    """(name, shingles) of the sets in ``names`` (name, doc_id: a document that has it)."""
    h = F.xxhash64("doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(names.select(h.alias("h"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wanted = _in_bitmap(shared.value, batch["h"].to_numpy(np.int64))
            for texts in runs(batch["text"][wanted].tolist()):
                sets = shingle_sets(texts, words)
                yield pd.DataFrame({"name": [set_id(s) for s in sets], "shingles": [s.astype(np.int64) for s in sets]})

    read = docs.where(F.col("doc_id").isNotNull()).select("text", h.alias("h")).mapInPandas(run, "name long, shingles array<long>")
    return read.join(names.select("name"), "name", "left_semi").dropDuplicates(["name"])


def jaccard_join(docs: DataFrame, percent: int = 80, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    spark = docs.sparkSession
    docs = _known(docs, doc_id, text)
    rated = stored(_rate(docs, words), "ngram-sizes")
    rows = rated.where("kind = 0").select("doc_id", "size", "name")
    sketch = rated.where("kind = 1").groupBy("doc_id").agg(F.sum("size").alias("n")).toPandas()  # a row per bucket
    counts = np.zeros(1 << BUCKET_BITS)
    counts[sketch["doc_id"].to_numpy(np.int64)] = sketch["n"].to_numpy()
    used = counts[counts > 0]
    length = float((used**2).sum() / used.sum() - used.mean()) if len(used) else 0.0
    small = rows.where(F.col("size").between(1, 2 * MOST_LIGHT)).groupBy("size").count().toPandas()
    limit = light_limit(dict(zip(small["size"].tolist(), small["count"].tolist())), length, percent)

    classes = rows.where("doc_id is not null and size > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    classes = stored(classes, "ngram-classes")
    entries = _entries(docs.where("doc_id is not null"), counts, limit, percent, words)
    # Texts are read again for the entries of lists with two sets and more, so the others are neither kept nor moved.
    shared_keys = entries.groupBy("key").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low != high").select("key")
    shared_keys = stored(shared_keys, "ngram-keys")
    wanted = _bitmap(shared_keys.select(F.col("key").alias("h")))
    entries = _entries(docs.where("doc_id is not null"), counts, limit, percent, words, wanted)
    entries = stored(entries.join(shared_keys, "key", "left_semi").distinct(), "ngram-entries")
    lists = entries.groupBy("key").agg(F.min(F.struct("place", "name", "size")).alias("head"))
    lists = stored(entries.join(lists, "key"), "ngram-lists")

    def allowed(a: str, b: str):
        """Whether sizes, and what can follow the places of the common entry, leave room for the similarity."""
        sizes = F.col(f"{a}size") + F.col(f"{b}size")
        rest = 1 + F.least(F.col(f"{a}size") - F.col(f"{a}place") - 1, F.col(f"{b}size") - F.col(f"{b}place") - 1)
        return (100 + percent) * rest >= percent * sizes

    heads = lists.select("key", "name", "place", "size", F.col("head.name").alias("h_name"), F.col("head.place").alias("h_place"), F.col("head.size").alias("h_size"))
    pairs = heads.where("name != h_name").withColumnsRenamed({"name": "a_name", "place": "a_place", "size": "a_size"})
    pairs = pairs.where(allowed("a_", "h_")).select(F.col("a_name").alias("x"), F.col("h_name").alias("y")).distinct()
    marks = entries.groupBy("name").agg(F.collect_set("key").alias("keys"), F.max("size").alias("size"))
    marks = stored(marks, "ngram-marks")  # a set has no more entries than it has shingles
    links = _verified(docs, _promising(pairs, marks, limit, percent), classes, percent, words)

    joined = components(links, "x", "y")
    one = lists.drop("head").join(joined, F.col("name") == F.col("node"), "left").withColumn("part", F.coalesce("component", "name")).drop("node", "component")
    one = stored(one, "ngram-parts")
    open_keys = one.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("key")
    rest = stored(one.join(open_keys, "key", "left_semi"), "ngram-open")
    a, b = (rest.select("key", *[F.col(c).alias(f"{p}{c}") for c in ("name", "place", "size", "part")]) for p in ("a_", "b_"))
    more = (
        a.join(b, "key")
        .where((F.col("a_name") < F.col("b_name")) & (F.col("a_part") != F.col("b_part")) & allowed("a_", "b_"))
        .select(F.col("a_name").alias("x"), F.col("b_name").alias("y"))
        .distinct()
    )
    links = links.union(_verified(docs, _promising(more, marks, limit, percent), classes, percent, words))

    # components of set names, then their smallest document
    joined = components(links, "x", "y")
    parts = classes.join(joined, F.col("name") == F.col("node"), "left").select("name", "doc_id", F.coalesce("component", "name").alias("part"))
    least = parts.groupBy("part").agg(F.min("doc_id").alias("component"))
    named = parts.select("name", "part").join(least, "part").select("name", "component")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return rows.join(named, "name", "left").select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))


def _promising(pairs: DataFrame, marks: DataFrame, limit: int, percent: int) -> DataFrame:
    """Pairs whose listed shingles leave room for the similarity.

    Of two sets, take the one whose listed part ends first in the common order: what it shares stands in both listed
    parts, or after its own. So similar sets share at least the common shingles they need, less what is not listed.
    """
    x, y = (marks.select(F.col("name").alias(n), F.col("keys").alias(f"{n}k"), F.col("size").alias(f"{n}n")) for n in ("x", "y"))
    rest = lambda n: F.floor((percent * F.col(n) + 99) / 100) - 1
    needed = F.ceil(percent * (F.col("xn") + F.col("yn")) / (100 + percent)) - F.greatest(rest("xn"), rest("yn"))
    enough = (F.least("xn", "yn") <= limit) | (F.size(F.array_intersect("xk", "yk")) >= needed)
    return stored(pairs.join(x, "x").join(y, "y").where(enough).select("x", "y"), "ngram-pairs")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (x, y) of set names whose sets are similar."""
    names = pairs.select(F.col("x").alias("name")).union(pairs.select(F.col("y").alias("name"))).distinct()
    sets = _sets_of(docs, classes.join(names, "name"), words)
    x, y = (sets.select(F.col("name").alias(n), F.col("shingles").alias(f"{n}s")) for n in ("x", "y"))
    both = F.size(F.array_intersect("xs", "ys"))
    similar = (100 + percent) * both >= percent * (F.size("xs") + F.size("ys"))
    return stored(pairs.join(x, "x").join(y, "y").where(similar).select("x", "y"), "ngram-verified")
