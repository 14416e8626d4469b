"""Mixing sources to target weights by Pareto order sampling.

``source_targets`` pours the wanted total over the sources by weight, never above a source's limit. ``mix`` gives every
document of a source the whole copies its target pays for, and draws the rest as a Pareto order sample: the document's
inclusion probability p grows with its size, it gets the rank U/(1-U) * (1-p)/p from a number U that its id decides, and
the lowest ranks are taken until the words left for the source are used up. The last document taken is the one that
brings the sum nearest to the target.

No source is ordered as a whole: ranks fall into buckets, bucket sums give the bucket in which the cut lies, and only
that bucket is ordered. The cut is one row per source, so documents are decided without being moved.

Defined cases: a null text or one without words has size 0 and takes part with 0 words; a null source is a source of
its own, the last in order; a null id is an id like any other; rows repeating an id share one decision; an empty table
gives an empty result; further columns stay, and columns of the input with the names of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.words import whole_text, word_count
from foliospark.plans.session import stored

WEIGHTS = (5, 2, 1)
GRAIN = 1048576  # sizes' share of the probability is kept as a multiple of 1/GRAIN, so sums do not depend on order
BUCKETS_PER_OCTAVE = 256


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of ``total`` times all sizes by weight, at most ``limit`` times
    the source's size; what is above a limit goes to the other sources by their weights.

    Weights repeat over the sources in code point order, null last. With limits reached in the order of limit / weight,
    the level (words per unit of weight) after each reached limit is highest where the pouring ends, so the common
    level is a maximum over one ordered pass of the source table, which has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    all_rows = Window.partitionBy()
    by_limit = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    poured = (
        sizes.withColumn("_weight", weight)
        .withColumn("_cap", F.lit(float(limit)) * F.col("source_size"))
        .withColumn("_total", F.lit(float(total)) * F.sum("source_size").over(all_rows))
        .withColumn("_weights", F.sum("_weight").over(all_rows))
    )
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.col("_weights") - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    return (
        poured.withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(all_rows))
        .withColumn("target", F.least("_cap", F.col("_level") * F.col("_weight")))
        .drop("_weight", "_cap", "_total", "_weights", "_level")
    )


def _number(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that the id and the seed decide: 52 bits of an MD5."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"-{seed}"))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(4503599627370496.0)


def _grain(size: Column) -> Column:
    """Size / (size + mean size of the source) in grains; 0 for an empty text."""
    mean = F.col("source_size") / F.col("_docs")
    return F.when(size > 0, F.floor(size / (size + mean) * GRAIN)).otherwise(0).cast("long")


def _rank(size: Column, doc_id: Column, seed: str) -> Column:
    part = F.col("_part")
    chance = part + F.least(part, 1 - part) * (_grain(size) / F.lit(float(GRAIN)) - F.col("_mean_grain"))
    chance = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), chance))
    u = _number(doc_id, seed)
    return (u / (1 - u)) * ((1 - chance) / chance)


def mixing_plan(sized: DataFrame, weights=WEIGHTS, total=1.5, limit=2.0, seed: str = "mix") -> DataFrame:
    """One row per source from (doc_id, source, size): source_size, target, whole copies and the cut of the sample."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    grains = (
        _with_source(sized, sums)
        .groupBy("source")
        .agg(F.sum(F.col("size").cast("decimal(20,0)") * _grain(F.col("size"))).alias("_grains"))
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = (
        source_targets(sums, weights, total, limit)
        .join(grains.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_whole", F.floor(ratio))
        .withColumn("_part", ratio - F.col("_whole"))
        .withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumn(
            "_mean_grain",
            F.when(F.col("source_size") > 0, F.col("_grains").cast("double") / F.col("source_size") / GRAIN).otherwise(0.0),
        )
        .drop("_grains")
    )
    sources = stored(sources, "mix-sources")
    ranked = (
        _with_source(sized, sources)
        .where(F.col("_part") > 0)
        .select("source", "doc_id", "size", "_left", _rank(F.col("size"), F.col("doc_id"), seed).alias("_rank"))
        .withColumn("_bucket", F.floor(F.log2("_rank") * BUCKETS_PER_OCTAVE))
    )
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first bucket whose end lies beyond the words left can be taken in part.
    edges = (
        ranked.groupBy("source", "_bucket", "_left")
        .agg(F.sum("size").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .where(F.col("_before") + F.col("_sum") > F.col("_left"))
        .groupBy(F.col("source").alias("_s"))
        .agg(F.min(F.struct("_bucket", "_before")).alias("_edge"))
        .select("_s", F.col("_edge._bucket").alias("_edge"), "_edge._before")
    )
    edges = stored(edges, "mix-edges")
    inside = Window.partitionBy("source").orderBy("_rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        ranked.join(edges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_edge")))
        .withColumn("_sum", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .where(2 * F.col("_sum") + F.col("size") <= 2 * F.col("_left"))
        .groupBy(F.col("source").alias("_s"))
        .agg(F.max(F.struct("_rank", F.col("doc_id").alias("_id"))).alias("_cut"))
    )
    return (
        sources.join(edges.select("_s", "_edge"), F.col("source").eqNullSafe(F.col("_s")), "left")
        .drop("_s")
        .join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left")
        .drop("_s")
    )


def _with_source(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the columns of their source; the source table has one row per source."""
    other = sources.withColumnRenamed("source", "_s")
    return docs.join(other, docs["source"].eqNullSafe(F.col("_s"))).drop("_s")


def mix(docs: DataFrame, weights=WEIGHTS, total=1.5, limit=2.0, seed: str = "mix", text: str = "text") -> DataFrame:
    """Every row of ``docs`` (doc_id, source, text, ...) with size, source_size, target, copies and taken = size * copies."""
    made = {"size", "source_size", "target", "copies", "taken"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    sized = stored(docs.select("doc_id", "source", word_count(whole_text(text)).alias("size")), "mix-sizes")
    plan = stored(mixing_plan(sized, weights, total, limit, seed), "mix-plan")
    return _decide(docs.withColumn("size", word_count(whole_text(text))), plan, seed)


def mix_sizes(sized: DataFrame, weights=WEIGHTS, total=1.5, limit=2.0, seed: str = "mix") -> DataFrame:
    """The same for rows (doc_id, source, size) whose size is known; the rows are read several times."""
    return _decide(sized, stored(mixing_plan(sized, weights, total, limit, seed), "mix-plan"), seed)


def _decide(docs: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    rank = _rank(F.col("size"), F.col("doc_id"), seed)
    key = F.struct(rank.alias("_rank"), F.col("doc_id").alias("_id"))
    bucket = F.floor(F.log2(rank) * BUCKETS_PER_OCTAVE)
    inside = F.coalesce((bucket == F.col("_edge")) & (key <= F.col("_cut")), F.lit(False))
    extra = (F.col("_part") > 0) & (F.col("_edge").isNull() | (bucket < F.col("_edge")) | inside)
    hidden = ("_docs", "_whole", "_part", "_left", "_mean_grain", "_cut", "_edge")
    return (
        _with_source(docs, plan)
        .withColumn("copies", (F.col("_whole") + extra.cast("long")).cast("long"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .drop(*hidden)
    )


def copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("_copy")


ORACLE = """
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) size from documents),
s as (select source, cast(sum(size) as bigint) ss, count(*) n from d group by 1),
w as (select *, cast([5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as double) wt, 2.0::double * ss cap from s),
t as (select *, 1.5::double * cast(sum(ss) over () as double) tot, sum(wt) over () wsum,
 coalesce(sum(cap) over o, 0) capb, coalesce(sum(wt) over o, 0) wb from w
 window o as (order by cap / wt, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, max((tot - capb) / (wsum - wb)) over () lev from t),
g as (select *, least(cap, lev * wt) target from l),
f as (select *, case when ss > 0 then target / ss else 0 end ratio from g),
e as (select source, ss, n, target, floor(ratio) whole, ratio - floor(ratio) part, target - floor(ratio) * ss lft from f),
x as (select d.*, ss, target, whole, part, lft,
 case when size > 0 then cast(floor(size::double / (size::double + ss::double / n) * 1048576) as bigint) else 0 end gr,
 (cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || '-mix'), 1, 13)) as bigint) + 0.5::double) / 4503599627370496.0::double u
 from d join e on d.source is not distinct from e.source),
m as (select *, case when ss > 0 then cast(sum(cast(size as hugeint) * gr) over (partition by source) as double) / ss / 1048576 else 0 end mg from x),
p as (select *, greatest(1e-12::double, least(1 - 1e-12::double, part + least(part, 1 - part) * (gr / 1048576.0::double - mg))) c from m),
r as (select *, (u / (1 - u)) * ((1 - c) / c) rk from p),
q as (select *, coalesce(sum(size) over (partition by source order by rk, doc_id rows between unbounded preceding and 1 preceding), 0) b from r)
select doc_id, size, cast(ss as bigint) source_size, cast(target as double) target,
 cast(size * (whole + case when part > 0 and 2 * b + size <= 2 * lft then 1 else 0 end) as bigint) taken from q
"""
