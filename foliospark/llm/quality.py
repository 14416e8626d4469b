"""Quality rules: fixed limits, then robust multivariate outliers.

Five statistics of a text, brought to a logarithmic scale, are compared with texts of the same language and source.
Location and scatter of such a group come from the minimum covariance determinant: starting from medians and median
absolute deviations, concentration steps keep the ``KEEP_SHARE`` of the group with the smallest Mahalanobis distances
and take mean and covariance anew. A text whose squared distance exceeds ``CUTOFF`` is rejected.

Groups with fewer than ``MIN_GROUP`` texts use the estimate of their language over all sources; languages with fewer
keep what the fixed limits keep. The three rates get a least standard deviation (``FLOORS``), else one repeated line
would be an outlier among texts without any; it is such that in a group without any the smallest rate of
``OUTLIER_RATES`` is an outlier by itself. Length and word length, which always vary, get theirs added to the spread of
the group.

Scale: statistics are whole numbers (1/256 of a unit), so a group's medians come from counts of few distinct values and
its sums are exact in any order; distances fall into logarithmic bins, and the kept share is found on bin sums. A hot
source is thus reduced in each task before rows move, and reruns agree.

Defined cases: a null text has no words and fails the fixed limits, and so does an empty one; null languages and sources
form groups like others; repeated rows count each; an empty table gives an empty result; further columns stay, and
columns of the input with the names of the result are replaced. Texts are judged as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.words import SPACES, whole_text, words
from foliospark.plans.session import stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
SCALE = 256
KEEP_SHARE = 0.75
MIN_GROUP = 50
STEPS = 3
#: chi-square with five degrees of freedom leaves 1e-5 beyond it
CUTOFF = 30.9
#: smallest symbols, repeated lines and words in repeated windows per word that are outliers where the group has none
OUTLIER_RATES = (0.1, 0.1, 0.4)
#: least standard deviations: log length, log word length, log symbol rate, log repeated-line rate, log repetition rate
FLOORS = (0.7, 0.05, *(math.log(1 + 100 * rate) / math.sqrt(CUTOFF) for rate in OUTLIER_RATES))
#: so many of the statistics have their floor added to the variance; for the others it is a true minimum
ADDED = 2
#: makes the covariance of the nearest three quarters that of all, for five normal statistics
SPREAD = 1.41
BINS = 16
SALTS = 16
D = len(FLOORS)

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five counts of ``STATS``.

    Repetition is read off the sorted hashes of all windows of three words; only texts in which one occurs twice are
    sorted. Hashes have 64 bits and are compared within one text.
    """
    t = whole_text(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    w = F.col("_words")
    heads = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    windows = F.transform(heads, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    h, s = F.col("_windows"), F.col("_sorted")
    repeats = F.size(F.array_distinct(h)) < F.size(h)
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    twice = F.filter(
        s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
    )
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return (
        docs.withColumn("_words", words(t))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.translate(t, SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", F.when(F.instr(t, "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long"))
        .withColumn("_windows", windows)
        .withColumn("_sorted", F.when(repeats, F.sort_array(pairs)))
        .withColumn("n_repeat_words", F.when(s.isNull(), 0).otherwise(F.size(covered)).cast("long"))
        .drop("_words", "_windows", "_sorted")
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _scaled() -> list[Column]:
    """The statistics on a logarithmic scale, in whole units of 1/SCALE."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rate = lambda c: F.log(1 + 100 * F.col(c) / n)
    raw = [F.log(1 + n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]
    return [F.round(x * SCALE).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def _distance(center: list[Column], low: list[list[Column]]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor, unrolled."""
    z: list[Column] = []
    for i in range(D):
        rest = F.col(f"x{i}") - center[i]
        for k in range(i):
            rest = rest - low[i][k] * z[k]
        z.append(rest / low[i][i])
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _cholesky(frame: DataFrame) -> DataFrame:
    """Adds l{i}{j}, the Cholesky factor of the matrix in v{i}{j}; a column at a time, so no expression repeats."""
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"v{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l{j}{j}")
            frame = frame.withColumn(f"l{i}{j}", value)
    return frame


CENTER = [f"m{i}" for i in range(D)]
FACTOR = [f"l{i}{j}" for i in range(D) for j in range(i + 1)]


def _start(points: DataFrame) -> DataFrame:
    """Medians and median absolute deviations of every group as a first location and diagonal scatter."""
    medians = points.groupBy("g").agg(*[F.median(f"x{i}").alias(f"m{i}") for i in range(D)])
    spread = _beside(points, medians).groupBy("g").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(D)],
        *[F.median(F.abs(F.col(f"x{i}") - F.col(f"m{i}"))).alias(f"a{i}") for i in range(D)],
    )
    factor = [
        (F.greatest(F.col(f"a{i}") * 1.4826, F.lit(FLOORS[i] * SCALE)) if i == j else F.lit(0.0)).alias(f"l{i}{j}")
        for i in range(D)
        for j in range(i + 1)
    ]
    return spread.select("g", *CENTER, *factor)


def _beside(points: DataFrame, estimates: DataFrame) -> DataFrame:
    """Points with the estimate of their group. Estimates go to each of ``SALTS`` parts of their group, so a hot group
    is spread over tasks, and what is summed after the join is reduced there first."""
    salted = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return points.join(salted, ["g", "salt"])


def _with_distance(points: DataFrame, estimates: DataFrame) -> DataFrame:
    low = [[F.col(f"l{i}{j}") for j in range(i + 1)] for i in range(D)]
    return _beside(points, estimates).withColumn("d2", _distance([F.col(c) for c in CENTER], low)).drop(*CENTER, *FACTOR)


def _concentrate(points: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step: mean and covariance of the nearest ``KEEP_SHARE`` of each group, by distance bins."""
    binned = _with_distance(points, estimates).withColumn("bin", F.floor(F.log(1 + F.col("d2")) * BINS))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(D)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i in range(D) for j in range(i + 1)]
    bins = binned.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    up = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    near = bins.withColumn("_before", F.coalesce(F.sum("n").over(up), F.lit(0))).withColumn("_all", F.sum("n").over(Window.partitionBy("g")))
    near = near.where(F.col("_before") < KEEP_SHARE * F.col("_all"))
    names = [f"s{i}" for i in range(D)] + [f"p{i}{j}" for i in range(D) for j in range(i + 1)]
    total = near.groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    mean = [F.col(f"s{i}") / F.col("n") for i in range(D)]
    total = total.withColumns({f"m{i}": mean[i] for i in range(D)})
    cov = {}
    for i in range(D):
        for j in range(i + 1):
            value = SPREAD * (F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
            floor = F.lit((FLOORS[i] * SCALE) ** 2)
            if i == j:
                value = value + floor if i < ADDED else F.greatest(value, floor)
            cov[f"v{i}{j}"] = value
    return _cholesky(total.withColumns(cov)).select("g", *CENTER, *FACTOR)


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows of ``docs`` (lang, source, text, ...) with the counts, ``base_failed``, ``distance2`` and ``kept``."""
    made = {*STATS, "base_failed", "distance2", "kept"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    rated = base_stats(docs, text).withColumn("base_failed", base_failed())
    return verdict(rated, stored(rated.select("lang", "source", *STATS, "base_failed"), "quality-stats"))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept.

    A filter would be moved below the statistics and evaluate them again at each place they are used in; a generator
    stays above them.
    """
    once = F.explode(F.array_repeat(F.lit(1), F.col("kept").cast("int"))).alias("_once")
    return judge(docs, text).select(*docs.columns, once).drop("_once")


def verdict(rated: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """Adds ``distance2`` and ``kept`` to rows with counts; ``sample`` has the counts of all rows, ``rated`` by default,
    and is read once more."""
    sample = rated if sample is None else sample
    points = stored(
        sample.where(~F.col("base_failed")).select(_group("lang", "source").alias("own"), _group("lang").alias("wide"), *_scaled()).withColumn(
            "salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
        ),
        "quality-points",
    )
    sizes = points.groupBy("own", "wide").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("_wide_n", F.sum("n").over(Window.partitionBy("wide")))
    used = F.when(F.col("n") >= MIN_GROUP, F.col("own")).when(F.col("_wide_n") >= MIN_GROUP, F.col("wide"))
    chosen = stored(sizes.select("own", used.alias("g")).where(F.col("g").isNotNull()), "quality-groups")
    # The language's estimate is made of all its texts, and only where one of its sources needs it.
    needed = chosen.select("g").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    columns = [f"x{i}" for i in range(D)]
    own = points.select(F.col("own").alias("g"), "salt", *columns).join(needed, ["g", "salt"], "left_semi")
    wide = points.select(F.col("wide").alias("g"), "salt", *columns).join(needed, ["g", "salt"], "left_semi")
    both = own.unionByName(wide)
    estimates = _start(both)
    for _ in range(STEPS):
        estimates = _concentrate(both, estimates)
    estimates = stored(chosen.join(estimates, "g").drop("g").withColumnRenamed("own", "g"), "quality-estimates")
    low = [[F.col(f"l{i}{j}") for j in range(i + 1)] for i in range(D)]
    scaled = rated.withColumn("g", _group("lang", "source")).withColumns({f"x{i}": c for i, c in enumerate(_scaled())})
    near = scaled.join(estimates, "g", "left").withColumn("distance2", _distance([F.col(c) for c in CENTER], low))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True))
    return near.withColumn("kept", kept).drop("g", *columns, *CENTER, *FACTOR)


def _group(*names: str) -> Column:
    """A group as text; null parts differ from every text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(n)), F.lit("null")) for n in names]
    return F.concat(F.lit(f"{len(names)}"), *[F.concat(F.lit("\x01"), p) for p in parts])



