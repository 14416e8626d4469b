"""Embedding near-duplicates by a forest of random-projection trees.

Vectors of one label and length are split recursively by random directions. A vector nearer to a split than the spill
margin goes to both sides. Trees are independent, so a pair that one tree parts meets in another. Within the leaves all
vectors are compared by cosine in double precision; what is linked is verified, and links are united to components.

Directions come from a pool per tree, chosen per node by a hash, so a vector's way through a tree needs one product with
the pool and no stored tree. Split points are medians of a bounded sample (``SAMPLE_FLOATS`` numbers, drawn by a hash of
the vector); the number of levels follows the number of vectors of the label, so leaves keep their size when the table
grows, and every vector is put into its leaves.

Equal vectors are one class with a count before the forest. No pair becomes a row: a leaf gives, per vector, how many
vectors it is linked to in this leaf first (a pair is counted in the lowest leaf that both share), and the smallest
vector it is joined with there. A leaf with more than ``BLOCK`` vectors is compared in pairs of blocks, each a task of
its own, so memory is bounded. What remains is time: in a group of many different vectors that are all linked, the
exact number of links takes time with the square of the group.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and those with a null label, link
with nothing; repeated rows count as vectors of their own; rows with a null id are answered without links; further
columns are not returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.components import components
from foliospark.plans.session import stored

TREES = 10
LEAF = 96
POOL = 48
#: spill margin in standard deviations of a projection of unit vectors
SPILL = 0.16
SAMPLE_FLOATS = 2_000_000
BLOCK = 1024
LEVELS = 40


def pools(size: int, trees: int, seed: int) -> np.ndarray:
    """Random unit directions: trees x POOL x size."""
    d = np.random.default_rng([seed, size]).standard_normal((trees, POOL, size))
    return d / np.linalg.norm(d, axis=2, keepdims=True)


def pick(tree: int, nodes: np.ndarray, seed: int) -> np.ndarray:
    """The direction of each node."""
    x = nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tree * 1000003 + seed)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(POOL)).astype(np.int64)


def descend(projected: np.ndarray, tree: int, levels: int, splits: dict, middle: np.ndarray, margin: float, seed: int):
    """Rows and leaves of all ways through a tree: nodes are numbered 1, then 2n and 2n + 1.

    ``splits`` holds the split points of nodes with enough sample; below them ``middle``, the medians per direction.
    """
    rows, nodes = np.arange(len(projected)), np.ones(len(projected), np.int64)
    for _ in range(levels):
        direction = pick(tree, nodes, seed)
        unique, back = np.unique(nodes, return_inverse=True)
        known = np.array([splits.get((tree, int(n)), np.nan) for n in unique])[back]
        point = np.where(np.isnan(known), middle[direction], known)
        side = projected[rows, direction] - point
        left, right = side < margin, side >= -margin
        rows = np.concatenate([rows[left], rows[right]])
        nodes = np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
    return rows, nodes


def fit_splits(sample: np.ndarray, trees: int, levels: int, seed: int) -> tuple[dict, np.ndarray]:
    """Split points from unit vectors: medians of the sample in each node that holds at least 16 of them."""
    directions = pools(sample.shape[1], trees, seed)
    splits: dict = {}
    middle = np.zeros((trees, POOL))
    for tree in range(trees):
        projected = sample @ directions[tree].T
        middle[tree] = np.median(projected, axis=0)
        members = {1: np.arange(len(sample))}
        for _ in range(levels):
            below = {}
            for node, rows in members.items():
                if len(rows) < 16:
                    continue
                value = projected[rows, pick(tree, np.array([node]), seed)[0]]
                point = splits[tree, node] = float(np.median(value))
                below[2 * node], below[2 * node + 1] = rows[value < point], rows[value >= point]
            members = below
    return splits, middle


def unit(values) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in values])
    # scaled first, so that squares of very large or very small entries stay in range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    trees: int = TREES,
    leaf: int = LEAF,
    seed: int = 17,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    v = F.transform(vector, lambda x: x.cast("double"))
    sound = (
        F.col(label).isNotNull()
        & F.col(vec_id).isNotNull()
        & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    )
    group = F.concat_ws("\x01", F.size(vector).cast("string"), F.col(label).cast("string"))
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"),
        F.when(sound, group).alias("group"),
        F.when(sound, F.xxhash64(group, F.lit(1), vector)).alias("h1"),
        F.when(sound, F.xxhash64(F.lit(2), vector, group)).alias("h2"),
        F.when(sound, v).alias("v"),
    )
    rows = stored(rows, "forest-rows")
    classes = rows.where(F.col("group").isNotNull()).groupBy("h1", "h2").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("group").alias("group"), F.first("v").alias("v")
    )
    classes = stored(classes, "forest-classes")
    placed = _leaves(classes, trees, leaf, seed)
    sizes = placed.groupBy("group", "leaf").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
    blocks = sizes.select("group", "leaf", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("id", "leaf"), F.coalesce("_blocks", F.lit(1))).cast("int")
    tasks = (
        placed.join(blocks, ["group", "leaf"], "left")
        .withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)))
        .select("group", "leaf", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "n", "v", "leaves")
    )
    found = tasks.groupBy("group", "leaf", "one", "two").applyInPandas(_comparison(threshold), "id long, links long, root long")
    found = stored(found, "forest-links")
    links = found.groupBy(F.col("id")).agg(F.sum("links").alias("_links"))
    joined = components(found.where(F.col("id") != F.col("root")).select(F.col("id").alias("a"), F.col("root").alias("b")))
    answer = (
        classes.select("h1", "h2", "id", "n")
        .join(links, "id", "left")
        .join(joined, F.col("id") == F.col("node"), "left")
        .select(
            "h1", "h2", (F.col("n") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")
        )
    )
    return (
        rows.select("vec_id", "h1", "h2")
        .join(answer, ["h1", "h2"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
        )
    )


def _leaves(classes: DataFrame, trees: int, leaf: int, seed: int) -> DataFrame:
    """(group, leaf, id, n, v, leaves): a row per vector and leaf, with all leaves of the vector."""
    counts = classes.groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.first(F.size("v")).alias("d"))
    levels = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("m") / leaf)))).cast("int")
    numbered = stored(counts.select("group", "m", "d", levels.alias("levels")), "forest-groups")
    total = numbered.agg(F.sum("m").alias("m"), F.max("d").alias("d"), F.count(F.lit(1)).alias("g")).first()
    schema = "group string, leaf long, id long, n long, v array<double>, leaves array<long>"
    if not total["m"]:
        return classes.sparkSession.createDataFrame([], schema)
    # The sample takes all of a small table, and a bounded part of a large one.
    share = SAMPLE_FLOATS / (float(total["m"]) * total["d"])
    draw = F.pmod(F.col("h2"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = classes.where(draw < share).select("group", "v")

    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        splits, middle = fit_splits(unit(rows["v"]), trees, int(rows["levels"].iloc[0]), seed)
        return pd.DataFrame(
            {"group": [key[0]], "t": [[k[0] for k in splits]], "node": [[k[1] for k in splits]], "point": [list(splits.values())], "middle": [middle.ravel().tolist()]}
        )

    fitted = (
        sample.join(numbered.where("levels > 0").select("group", "levels"), "group")
        .groupBy("group")
        .applyInPandas(fit, "group string, t array<int>, node array<long>, point array<double>, middle array<double>")
    )
    # Groups small enough to be one leaf need no splits; a larger one without sample is split at the origin of its directions. Split points have at most one sixteenth of the
    # sample's rows per tree and level, so this table is as bounded as the sample.
    fitted = {
        r["group"]: (dict(zip(zip(r["t"], r["node"]), r["point"])), np.array(r["middle"]).reshape(trees, POOL)) for r in fitted.collect()
    }
    shared = classes.sparkSession.sparkContext.broadcast(fitted)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            for (group, levels), rows in batch.groupby(["group", "levels"], sort=False):
                x = unit(rows["v"])
                d = x.shape[1]
                if d not in directions:
                    directions[d] = pools(d, trees, seed)
                splits, middle = shared.value.get(group, ({}, np.zeros((trees, POOL))))
                ways = [descend(x @ directions[d][t].T, t, levels, splits, middle[t], SPILL / d**0.5, seed) for t in range(trees)]
                at = np.concatenate([w[0] for w in ways])
                code = np.concatenate([w[1] + (t << 42) for t, w in enumerate(ways)])
                order = np.lexsort((code, at))
                at, code = at[order], code[order]
                lists = np.split(code, np.flatnonzero(np.diff(at)) + 1)
                yield pd.DataFrame({"group": rows["group"], "id": rows["id"], "n": rows["n"], "v": rows["v"], "leaves": lists})

    placed = classes.join(numbered.select("group", "levels"), "group").select("group", "levels", "id", "n", "v").mapInPandas(
        place, "group string, id long, n long, v array<double>, leaves array<long>"
    )
    placed = stored(placed, "forest-leaves")
    return placed.select("group", F.explode("leaves").alias("leaf"), "id", "n", "v", "leaves")


def _comparison(threshold: float):
    """Links within one leaf, or between two of its blocks.

    A pair is counted here if no lower leaf holds both, which a product of the 0/1 matrix of lower leaves tells.
    """

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        leaf, one, two = key[1], key[2], key[3]
        ids, n = rows["id"].to_numpy(), rows["n"].to_numpy(np.float64)
        x = unit(rows["v"])
        linked = x @ x.T >= threshold
        block = rows["block"].to_numpy()
        if one != two:
            linked &= block[:, None] != block[None, :]
        np.fill_diagonal(linked, False)
        touched = linked.any(1)
        if not touched.any():
            return pd.DataFrame({"id": [], "links": [], "root": []}, dtype="int64")
        ids, n, linked = ids[touched], n[touched], linked[np.ix_(touched, touched)]
        lower = [np.asarray(v)[np.asarray(v) < leaf] for v in rows["leaves"][touched]]
        names, where = np.unique(np.concatenate(lower), return_inverse=True)
        member = np.zeros((len(ids), len(names)), np.float32)
        member[np.repeat(np.arange(len(ids)), [len(v) for v in lower]), where] = 1
        first = linked & (member @ member.T == 0)
        root = ids.copy()
        while True:
            low = np.minimum(root, np.where(linked, root[None, :], root.max()).min(1))
            if (low == root).all():
                break
            root = low
        return pd.DataFrame({"id": ids, "links": (first @ n).astype(np.int64), "root": root})

    return run
