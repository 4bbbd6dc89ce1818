"""What changed between consecutive full snapshots of a branch.

Layout
    Chain metadata (one small row per delivery) decides which delivery of a snapshot is valid and which
    snapshot follows which. The listings themselves are exploded to keyed rows, range-partitioned and sorted by
    (repo, branch, record_kind, record_key, instant), and merged in one pass: for each key the merge holds two
    pointers, the row of the older snapshot and the row of the newer one, and emits a typed change wherever they
    disagree. A range holds whole keys, so a hot chain is spread over many ranges and no task has to hold a chain.

Defined cases
    * Deliveries sharing snapshot_id are one snapshot; the last by delivered_at wins (ties: a hash of the row,
      so the choice does not depend on row order). If that delivery has null files the snapshot does not exist.
    * Order is the parsed instant, then snapshot_id. Rows whose timestamp cannot be parsed, or whose repo, branch
      or snapshot_id is null, are no snapshots.
    * Paths: ``\\`` becomes ``/`` and one leading ``./`` is dropped; null paths and links without both ends are
      ignored. Repeated entries count once; of several hashes of one path in one snapshot the largest counts.
    * Missing or null hashes are unknown and never give ``changed``; null links are an empty list.
    * Empty input gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN = ["repo", "branch"]


def instant(c: Column) -> Column:
    """ISO 8601 text (``T`` or blank, ``Z`` or offset, optional fraction) to microseconds since the epoch."""
    return F.unix_micros(F.regexp_replace(F.trim(c), "^(\\S+) +(?=\\d)", "$1T").try_cast("timestamp"))


def clean_path(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^\\./", "")


def _version(cols: list[str]) -> Column:
    return F.struct(F.col("delivered_at"), F.xxhash64(*cols).alias("tie"))


def chain_order(snapshots: DataFrame) -> DataFrame:
    """One row per existing snapshot: chain, instant, version, is_first and the id of the next snapshot.

    The successor is found in two levels, first within (chain, day), then over the days of a chain, so that no
    task orders more than a day of a hot chain at once.
    """
    meta = (
        snapshots.select(
            "snapshot_id",
            _version(["timestamp", "files", "hashes", "links", "repo", "branch"]).alias("version"),
            F.struct("repo", "branch", instant(F.col("timestamp")).alias("at"), F.col("files").isNotNull().alias("ok")).alias("m"),
        )
        .where(F.col("snapshot_id").isNotNull())
        .groupBy("snapshot_id")
        .agg(F.max_by("m", "version").alias("m"), F.max("version").alias("version"))
        .where("m.ok and m.at is not null and m.repo is not null and m.branch is not null")
        .select("snapshot_id", "version", "m.repo", "m.branch", "m.at", F.floor(F.col("m.at") / 86_400_000_000).alias("day"))
    )
    within = Window.partitionBy(*CHAIN, "day").orderBy("at", "snapshot_id")
    over_days = Window.partitionBy(*CHAIN).orderBy("day")
    days = (
        meta.groupBy(*CHAIN, "day")
        .agg(F.min(F.struct("at", "snapshot_id")).alias("head"))
        .select(*CHAIN, "day", F.lead("head.snapshot_id").over(over_days).alias("next_day"), (F.lag("day").over(over_days).isNull()).alias("first_day"))
    )
    return (
        meta.withColumn("next_in_day", F.lead("snapshot_id").over(within))
        .withColumn("first_in_day", F.lag("snapshot_id").over(within).isNull())
        .join(days, [*CHAIN, "day"])
        .select(
            "snapshot_id", "version", *CHAIN, "at",
            (F.col("first_in_day") & F.col("first_day")).alias("is_first"),
            F.coalesce("next_in_day", "next_day").alias("next_id"),
        )
    )


def keyed_records(snapshots: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Explode valid snapshots (of ``order``, by default all) to (chain, record_kind, record_key, at, snapshot_id, next_id, is_first, hash)."""
    order = (chain_order(snapshots) if order is None else order).select("snapshot_id", "version", "at", "is_first", "next_id")
    files = F.transform(
        F.coalesce(F.col("files"), F.array()),
        lambda p, i: F.struct(F.lit("file").alias("kind"), clean_path(p).alias("key"), F.lower(F.get(F.col("hashes"), i)).alias("hash")),
    )
    links = F.transform(
        F.filter(F.coalesce(F.col("links"), F.array()), lambda l: (F.size(l) >= 2) & F.get(l, F.lit(0)).isNotNull() & F.get(l, F.lit(1)).isNotNull()),
        lambda l: F.struct(
            F.lit("link").alias("kind"),
            F.concat(clean_path(F.get(l, F.lit(0))), F.lit(" -> "), clean_path(F.get(l, F.lit(1)))).alias("key"),
            F.lit(None).cast("string").alias("hash"),
        ),
    )
    return (
        snapshots.select("snapshot_id", _version(["timestamp", "files", "hashes", "links", "repo", "branch"]).alias("version"), *CHAIN, "files", "hashes", "links")
        .join(order, ["snapshot_id", "version"])
        .select("snapshot_id", *CHAIN, "at", "is_first", "next_id", F.explode(F.array_distinct(F.concat(files, links))).alias("r"))
        .select("snapshot_id", *CHAIN, "at", "is_first", "next_id", F.col("r.kind").alias("record_kind"), F.col("r.key").alias("record_key"), F.col("r.hash").alias("hash"))
        .where(F.col("record_key").isNotNull())
    )


def snapshot_changes(snapshots: DataFrame, partitions: int | None = None) -> DataFrame:
    """(snapshot_id, record_kind, record_key, change_kind) of every snapshot after a chain's first."""
    key = [*CHAIN, "record_kind", "record_key"]
    rows = keyed_records(snapshots)
    n = [partitions] if partitions else []
    ranged = rows.repartitionByRange(*n, *key)
    # The range partitioning already clusters by key, so neither of these steps shuffles again.
    one = ranged.groupBy(*key, "at", "snapshot_id", "next_id", "is_first").agg(F.max("hash").alias("hash"))
    merge = Window.partitionBy(*key).orderBy("at", "snapshot_id")
    before_next = F.lag("next_id").over(merge)
    before_hash = F.lag("hash").over(merge)
    continues = before_next.eqNullSafe(F.col("snapshot_id"))
    both = (
        one.withColumn("follows", continues)
        .withColumn("old_hash", before_hash)
        .withColumn("later_id", F.lead("snapshot_id").over(merge))
        .withColumn("arrives", F.when(~F.col("follows") & ~F.col("is_first"), F.lit("added"))
                    .when(F.col("follows") & (F.col("record_kind") == "file") & (F.col("old_hash") != F.col("hash")), F.lit("changed")))
        .withColumn("leaves_at", F.when(F.col("next_id").isNotNull() & ~F.col("later_id").eqNullSafe(F.col("next_id")), F.col("next_id")))
    )
    events = F.array(
        F.struct(F.col("snapshot_id").alias("snapshot_id"), F.col("arrives").alias("change_kind")),
        F.struct(F.col("leaves_at").alias("snapshot_id"), F.when(F.col("leaves_at").isNotNull(), F.lit("removed")).alias("change_kind")),
    )
    return (
        both.where(F.col("arrives").isNotNull() | F.col("leaves_at").isNotNull())
        .select("record_kind", "record_key", F.explode(F.filter(events, lambda e: e["change_kind"].isNotNull())).alias("e"))
        .select("e.snapshot_id", "record_kind", "record_key", "e.change_kind")
    )
