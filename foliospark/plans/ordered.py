"""Order-dependent steps that never put a whole book into one task.

``Window.partitionBy("book_id")`` sends a book to a single task, and one book may hold a third of the corpus. The
helpers here cut a book into buckets that follow its order (for example 4,096 page positions each), run the window
inside (book, bucket) and correct the result with one small row per bucket:

* ``number_rows`` and ``running_sum`` add the total of all earlier buckets,
* ``carry`` looks up the nearest non-null value in the buckets before (or after) when the own bucket has none.

The bucket table is built by a partial aggregate, so before its shuffle it is already reduced to one row per bucket
and task. ``sorted_positions`` covers sort keys without a usable bucket, such as file names.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from foliospark.plans.session import cut_lineage

BUCKET = 4096


def slot(col: str | Column, width: int = BUCKET) -> Column:
    """Bucket number of an integer order column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(width)).cast("long")


def _bucket_columns(df: DataFrame, buckets: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_bucket{i}" for i in range(len(buckets))]
    for name, expr in zip(names, buckets):
        df = df.withColumn(name, expr)
    return df, names


def _bucket_order(names: Sequence[str], descending: Sequence[bool] | None) -> list[Column]:
    flags = descending or [False] * len(names)
    return [F.col(n).desc() if d else F.col(n).asc() for n, d in zip(names, flags)]


def _before(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def _or_zero(coarse: Column | None) -> Column:
    return F.lit(0).cast("long") if coarse is None else coarse


def _offsets(
    totals: DataFrame, part: Sequence[str], names: Sequence[str], descending: Sequence[bool] | None, two_levels: bool
) -> DataFrame:
    """Sum of all earlier buckets of the part, per bucket."""
    order = _bucket_order(names, descending)
    if two_levels:
        summed = running_sum(
            totals.withColumnsRenamed({n: f"{n}_" for n in names}),
            part,
            [F.col("_coarse")],
            _bucket_order([f"{n}_" for n in names], descending),
            F.col("_total"),
            "_earlier",
            inclusive=False,
        ).withColumnRenamed("_earlier", "_offset")
        return summed.withColumnsRenamed({f"{n}_": n for n in names}).drop("_total", "_coarse")
    outer = _before(Window.partitionBy(*part).orderBy(*order))
    return totals.withColumn("_offset", F.coalesce(F.sum("_total").over(outer), F.lit(0))).drop("_total", "_coarse")


def running_sum(
    df: DataFrame,
    part: Sequence[str],
    buckets: Sequence[Column],
    order: Sequence[Column],
    value: Column,
    name: str,
    *,
    inclusive: bool = True,
    descending: Sequence[bool] | None = None,
    coarse: Column | None = None,
) -> DataFrame:
    """Running total of ``value`` in each part; ``order`` sorts inside a bucket, ``buckets`` sort as listed.

    ``coarse`` is a bucket of buckets for parts whose bucket table may itself be long.
    """
    df, names = _bucket_columns(df, buckets)
    keys = [*part, *names]
    inner = Window.partitionBy(*keys).orderBy(*order)
    frame = inner.rowsBetween(Window.unboundedPreceding, 0) if inclusive else _before(inner)
    totals = df.withColumn("_coarse", _or_zero(coarse)).groupBy(*keys).agg(
        F.sum(value).alias("_total"), F.min("_coarse").alias("_coarse")
    )
    offsets = _offsets(totals, part, names, descending, coarse is not None)
    return (
        df.withColumn("_local", F.coalesce(F.sum(value).over(frame), F.lit(0)))
        .join(offsets, keys)
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", *names)
    )


def number_rows(
    df: DataFrame,
    part: Sequence[str],
    buckets: Sequence[Column],
    order: Sequence[Column],
    name: str,
    *,
    start: int = 0,
    descending: Sequence[bool] | None = None,
    coarse: Column | None = None,
) -> DataFrame:
    """Consecutive integers per part from ``start``, the scalable form of ``row_number``."""
    df, names = _bucket_columns(df, buckets)
    keys = [*part, *names]
    inner = Window.partitionBy(*keys).orderBy(*order)
    totals = df.withColumn("_coarse", _or_zero(coarse)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"), F.min("_coarse").alias("_coarse")
    )
    offsets = _offsets(totals, part, names, descending, coarse is not None)
    return (
        df.withColumn("_local", F.row_number().over(inner))
        .join(offsets, keys)
        .withColumn(name, (F.col("_local") + F.col("_offset") + F.lit(start - 1)).cast("int"))
        .drop("_local", "_offset", *names)
    )


class Nearest(NamedTuple):
    """What ``carry_all`` looks up: the nearest non-null ``value`` before (or after) a row, stored as ``name``."""

    value: Column
    name: str
    backwards: bool = False
    inclusive: bool = False


def carry_all(
    df: DataFrame,
    part: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    wanted: Sequence[Nearest],
    *,
    coarse: Column | None = None,
) -> DataFrame:
    """Nearest earlier or later non-null values per part, several at once over one bucket table.

    With a value that is never null this is ``lag``/``lead`` by one row; with nullable values it is
    ``last``/``first`` with nulls ignored. ``order`` names columns that sort the rows of a bucket totally; ``coarse``
    is a bucket of buckets for parts with very many of them.
    """
    df = df.withColumn("_bucket0", bucket).withColumns({f"_value{i}": n.value for i, n in enumerate(wanted)})
    inner = Window.partitionBy(*part, "_bucket0").orderBy(*order)
    edges, locals_ = [], {}
    for i, n in enumerate(wanted):
        value = F.col(f"_value{i}")
        place = F.when(value.isNotNull(), F.struct(*order))
        if n.backwards:
            frame = inner.rowsBetween(0 if n.inclusive else 1, Window.unboundedFollowing)
            locals_[f"_local{i}"] = F.first(value, ignorenulls=True).over(frame)
            edges.append(F.min_by(value, place).alias(f"_edge{i}"))
        else:
            frame = inner.rowsBetween(Window.unboundedPreceding, 0 if n.inclusive else -1)
            locals_[f"_local{i}"] = F.last(value, ignorenulls=True).over(frame)
            edges.append(F.max_by(value, place).alias(f"_edge{i}"))
    table = df.withColumn("_coarse", _or_zero(coarse)).groupBy(*part, "_bucket0").agg(
        *edges, F.min("_coarse").alias("_coarse")
    )
    if coarse is None:
        outer = Window.partitionBy(*part).orderBy("_bucket0")
        for i, n in enumerate(wanted):
            if n.backwards:
                beyond = F.first(f"_edge{i}", ignorenulls=True).over(outer.rowsBetween(1, Window.unboundedFollowing))
            else:
                beyond = F.last(f"_edge{i}", ignorenulls=True).over(_before(outer))
            table = table.withColumn(f"_beyond{i}", beyond)
    else:
        again = [Nearest(F.col(f"_edge{i}"), f"_outside{i}", n.backwards) for i, n in enumerate(wanted)]
        table = carry_all(
            table.withColumnRenamed("_bucket0", "_fine"),
            part,
            F.col("_coarse"),
            ["_fine"],
            again,
        ).withColumnsRenamed({"_fine": "_bucket0"} | {f"_outside{i}": f"_beyond{i}" for i in range(len(wanted))})
    table = table.select(*part, "_bucket0", *[f"_beyond{i}" for i in range(len(wanted))])
    out = df.withColumns(locals_).join(table, [*part, "_bucket0"])
    out = out.withColumns({n.name: F.coalesce(f"_local{i}", f"_beyond{i}") for i, n in enumerate(wanted)})
    helpers = [f"_{kind}{i}" for kind in ("value", "local", "beyond") for i in range(len(wanted))]
    return out.drop("_bucket0", *helpers)


def carry(
    df: DataFrame,
    part: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    value: Column,
    name: str,
    *,
    backwards: bool = False,
    inclusive: bool = False,
    coarse: Column | None = None,
) -> DataFrame:
    """``carry_all`` for one value."""
    return carry_all(df, part, bucket, order, [Nearest(value, name, backwards, inclusive)], coarse=coarse)


def sorted_positions(df: DataFrame, part: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """0-based position per part for any total order, by one range shuffle over (part, order).

    The sorted rows are checkpointed, so partition numbers are fixed before they are counted. Only one row per
    partition and one row per part are aggregated afterwards.
    """
    ranged = df.repartitionByRange(*part, *order).sortWithinPartitions(*part, *order)
    shift = F.lit(1 << 33)
    fixed = cut_lineage(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    fixed = fixed.withColumn("_pid", F.floor(F.col("_mid") / shift)).withColumn("_at", F.col("_mid") % shift)
    sizes = fixed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_size"))
    # One row per shuffle partition, a number set by configuration and not by the data.
    before = _before(Window.partitionBy(F.lit(0)).orderBy("_pid"))
    offsets = sizes.select("_pid", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    placed = fixed.join(F.broadcast(offsets), "_pid").withColumn("_global", F.col("_at") + F.col("_offset"))
    starts = placed.groupBy(*part).agg(F.min("_global").alias("_start"))
    return (
        placed.join(starts, list(part))
        .withColumn(name, (F.col("_global") - F.col("_start")).cast("int"))
        .drop("_mid", "_pid", "_at", "_offset", "_global", "_start")
    )


def text_parts(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    text: str,
    separator: str,
    name: str,
    *,
    per_part: int,
) -> DataFrame:
    """Join texts in order into numbered parts of at most ``per_part`` positions.

    A long book becomes several rows (``part_no`` 0, 1, …) instead of one unbounded string; the parts in order,
    joined by the same separator, are the whole text.
    """
    quoted = separator.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return (
        df.withColumn("part_no", slot(position, per_part).cast("int"))
        .groupBy(*keys, "part_no")
        .agg(F.expr(f"listagg({text}, '{quoted}') within group (order by {position})").alias(name))
    )
