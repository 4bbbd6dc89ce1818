"""Content-addressed cache tables: look-up, column-wise upsert, invalidation.

A cache is a DataFrame keyed by (file_path, content_hash); old hashes stay as history. ``save`` writes a new version beside the
old one and moves the pointer last, so readers see the old or the new version whole.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["file_path", "content_hash"]


def look_up(files: DataFrame, cache: DataFrame, column: str = "analysis", parser_version: int | None = None) -> DataFrame:
    """Files with their cached columns and ``hit``: a row with a non-empty ``column`` (of the parser version asked for)."""
    c = cache if parser_version is None or "parser_version" not in cache.columns else cache.where(F.col("parser_version") == parser_version)
    got = files.join(c, KEY, "left")
    return got.withColumn("hit", F.coalesce(F.length(F.col(column)) > 0, F.lit(False)))


def upsert(cache: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Insert new keys and overwrite ``columns`` of known ones where the new value is not null; other columns stay."""
    rest = [c for c in cache.columns if c not in KEY]
    a, b = cache.alias("a"), new.select(*KEY, *columns).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in KEY]
    value = {c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in columns else F.col(f"a.{c}") for c in rest}
    return a.join(b, on, "full_outer").select(*[F.coalesce(F.col(f"b.{k}"), F.col(f"a.{k}")).alias(k) for k in KEY], *[v.alias(c) for c, v in value.items()])


def latest(versions: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order`` (pre-aggregated: no window over a hot key)."""
    rest = [c for c in versions.columns if c not in key]
    return versions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(*key, "v.*")


def decode(cache: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON text to columns; corrupt text becomes null and so a miss."""
    return cache.withColumn(column, F.from_json(column, schema, {"mode": "PERMISSIVE"}))


def save(df: DataFrame, path: str) -> str:
    version = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return version


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{path}/current").first()[0])


def of_url(base: str, url: str) -> str:
    """The folder of a repository's own cache, by a digest of its address."""
    return f"{base.rstrip('/')}/{hashlib.sha256(url.encode()).hexdigest()[:16]}"


def load_or(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache as it was saved, or an empty one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    return load(spark, path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else spark.createDataFrame([], schema)


def expired(jobs: DataFrame, now: F.Column, hours: int = 48, created: str = "created_at") -> DataFrame:
    return jobs.where(F.col(created) < now - F.expr(f"INTERVAL {int(hours)} HOURS"))
