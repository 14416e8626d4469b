"""Recogniser scores to text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_CHARACTER_TOKEN = 4  # fixed value: 0 ends a text, 1 to 3 are special


def greedy_decode(scores: DataFrame, charset: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Text of each line from (keys, pos, tok, logit): best token per position, lowest id on ties.

    Reading stops at the first end token; special and unknown tokens are skipped, repeats are kept. ``charset`` maps
    id-1 positions: (tok, ch) with tok counted from 1. The per-position maximum is combined before the shuffle.
    """
    keys = list(keys)
    logit = F.when(F.isnan("logit"), F.lit(float("-inf"))).otherwise(F.col("logit"))
    best = scores.groupBy(*keys, "pos").agg(F.max_by("tok", F.struct(logit, -F.col("tok"))).alias("tok"))
    # Positions per line are few (at most the recogniser's output length), so a line is one short array.
    lines = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("_path"))
    stop = F.array_position(F.transform("_path", lambda p: p["tok"]), 0)
    read = F.when(stop > 0, F.slice("_path", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("_path"))
    letters = F.filter(read, lambda p: p["tok"] >= FIRST_CHARACTER_TOKEN)
    exploded = lines.select(*keys, F.explode_outer(letters).alias("_p")).select(*keys, "_p.pos", "_p.tok")
    return (
        exploded.join(charset, "tok", "left")
        .groupBy(*keys)
        .agg(F.coalesce(F.expr("listagg(ch, '') within group (order by pos)"), F.lit("")).alias("text"))
    )
