"""Model files with several download sources: checks, audits and mirror plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import content_key
from foliospark.plans.ordered import number_rows, slot, text_parts

REASONS_PER_PART = 4096


def read_asset_manifest(manifest: DataFrame) -> DataFrame:
    """One row per (asset, source); priority is the place in the list."""
    return manifest.select("dest", "sha256", F.posexplode("sources").alias("priority", "source"))


def _checked(expected: DataFrame, fetched: DataFrame) -> DataFrame:
    """Adds ``good``: fetched with status 2xx and, where a hash is recorded, with that hash.

    Contents are hashed where they are read and do not travel further.
    """
    narrow = fetched.withColumn("_sha", F.sha2(F.col("content").cast("binary"), 256)).drop("content")
    status = F.col("http_status").between(200, 299)
    match = F.col("sha256").isNull() | (F.col("_sha") == F.col("sha256"))
    rows = narrow.join(expected.select("dest", "sha256"), "dest")
    return rows.withColumns({"_status_ok": status, "good": status & F.coalesce(match, F.lit(False))})


def source_audit(expected: DataFrame, fetched: DataFrame) -> DataFrame:
    """State of every asset: good official sources, mirror good or not, and the alarm class."""
    rows = _checked(expected, fetched)
    per_asset = rows.groupBy("dest").agg(
        F.count_if(F.col("official") & F.col("good")).alias("official_alive"),
        F.bool_or(F.when(~F.col("official") & F.col("sha256").isNotNull(), F.col("good"))).alias("mirror_alive"),
    )
    joined = expected.select("dest").join(per_asset, "dest", "left").withColumn(
        "official_alive", F.coalesce("official_alive", F.lit(0).cast("long"))
    )
    dead = F.col("official_alive") == 0
    return joined.withColumns(
        {
            "official_dead": dead,
            "fully_dead": dead & ~F.coalesce("mirror_alive", F.lit(False)),
            "mirror_dead": F.coalesce(~F.col("mirror_alive"), F.lit(False)),
        }
    )


def audit_exit_code(audit: DataFrame) -> DataFrame:
    """1 when any asset has lost all official sources, else 0."""
    return audit.agg(F.coalesce(F.max(F.col("official_dead").cast("int")), F.lit(0)).alias("exit_code"))


def source_priority(fetched: DataFrame) -> DataFrame:
    """Adds ``priority`` per asset: official sources first, then mirrors, each by source number."""
    return number_rows(
        fetched,
        ["dest"],
        [(~F.col("official")).cast("int"), slot("src_no")],
        [F.col("src_no")],
        "priority",
    )


def first_valid_source(expected: DataFrame, fetched: DataFrame) -> DataFrame:
    """The best source of each asset, or all reasons in order when no source is good (in parts of 4,096 reasons)."""
    rows = source_priority(_checked(expected, fetched))
    best = rows.where("good").groupBy("dest").agg(F.min_by("src_no", "priority").alias("chosen_source"))
    why: Column = F.when(~F.col("_status_ok"), F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))).otherwise(
        F.lit("SHA-256 不一致")
    )
    failed = rows.join(best, "dest", "left_anti").withColumn(
        "reason", F.concat(F.col("src_no").cast("string"), F.lit(": "), why)
    )
    reasons = text_parts(failed, ["dest"], "priority", "reason", "\n", "reasons", per_part=REASONS_PER_PART)
    return (
        expected.select("dest")
        .join(best, "dest", "left")
        .join(reasons, "dest", "left")
        .withColumn("part_no", F.coalesce("part_no", F.lit(0)))
    )


def content_keys(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets with their content-addressed key, and rejected rows (hash missing or malformed)."""
    keyed = assets.withColumn("key", content_key("sha256", "dest"))
    return keyed.where(F.col("key").isNotNull()), keyed.where(F.col("key").isNull()).drop("key")


def mirror_plan(assets: DataFrame) -> DataFrame:
    """Uploads (key, local_path, sha256) of all assets with a recorded hash; a malformed hash is an error."""
    bad = F.raise_error(F.concat(F.lit("malformed sha256: "), F.col("dest")))
    key = F.coalesce(content_key("sha256", "dest"), bad.cast("string"))
    return assets.where(F.coalesce(F.col("sha256"), F.lit("")) != "").select(
        key.alias("key"), F.col("dest").alias("local_path"), "sha256"
    )
