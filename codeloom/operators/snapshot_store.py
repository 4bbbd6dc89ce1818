"""Snapshots kept range-partitioned and sorted by key, into which each delivery is merged.

A store is a folder all executors share. It holds the newest listing of every chain, as one sorted Parquet file per range of
(repo, branch, record_kind, record_key), the ranges' lower bounds, and a pointer to the version in force. Merging a delivery shuffles the
delivery's rows only: a task per range streams its file of the old version and the new rows side by side with two pointers, writes
the range's next version and emits the typed changes. The old version stays readable until the pointer moves.

Defined cases
    * Deliveries are judged as in ``snapshot_diff``: repeated ones by their last, failed ones do not exist, paths and hashes normalised.
    * A delivery may hold several snapshots of a chain, new chains, and chains the store has; chains it does not name stay as they are.
    * Snapshots not later than the one kept of their chain are late and are ignored: the changes they would have caused are told by a full run.
    * A chain's first snapshot has no changes. An empty delivery changes nothing. Extra columns are ignored.
    * A task that is run twice writes files of its own attempt; only those of the attempt that counted are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.snapshot_diff import CHAIN, chain_order, keyed_records
from codeloom.session import cut

KEY = [*CHAIN, "record_kind", "record_key"]
CHANGE = "snapshot_id long, record_kind string, record_key string, change_kind string"
LAST = "\U0010ffff"


def _files(path: str):
    """(file system, path on it) of a folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _text(*parts) -> str:
    return "\0".join(parts)


def create(spark: SparkSession, path: str, sample: DataFrame, ranges: int = 64) -> None:
    """An empty store whose ranges are cut so that a sample of snapshots falls evenly into them."""
    rows = keyed_records(sample).select(*KEY).repartitionByRange(ranges, *KEY)
    low = rows.groupBy(F.spark_partition_id().alias("r")).agg(F.min(F.struct(*KEY)).alias("k")).orderBy("r").collect()  # one row per range
    bounds = sorted({_text(*r["k"]) for r in low})[1:]
    spark.createDataFrame([(bounds,)], "bounds array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")
    _point(spark, path, "", [])


def _point(spark: SparkSession, path: str, version: str, files: list) -> None:
    name = uuid.uuid4().hex
    spark.createDataFrame(files, "range int, file string, rows long").coalesce(1).write.parquet(f"{path}/manifest/{name}")
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").text(f"{path}/current")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest/{spark.read.text(f'{path}/current').first()[0]}")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """What the store holds: (key, hash, snapshot_id, at)."""
    files = [r["file"] for r in _manifest(spark, path).where("rows > 0").collect()]  # one per range
    schema = ", ".join(f"{k} string" for k in KEY) + ", hash string, snapshot_id long, at long"
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


class _Side:
    """One pointer over sorted rows that come in batches."""

    def __init__(self, rows: Iterator[tuple]):
        self.rows = rows
        self.now = next(rows, None)

    def take(self) -> tuple:
        got, self.now = self.now, next(self.rows, None)
        return got


def merge_range(old: Iterator[tuple], new: Iterator[tuple]) -> Iterator[tuple]:
    """Merge two sorted streams of one range; yields ("keep", key..., hash, snapshot_id, at) and ("change", snapshot_id, kind, key, what).

    ``old`` has (repo, branch, kind, key, hash, snapshot_id, at). ``new`` has (repo, branch, kind, key, at, snapshot_id, hash); rows with an empty kind
    come first in their chain and name its snapshots in order.
    """
    a, b = _Side(old), _Side(new)
    chain, ids = None, []
    while a.now is not None or b.now is not None:
        if b.now is not None and b.now[2] == "" and (a.now is None or b.now[:2] <= a.now[:2]):
            chain, ids = b.now[:2], []
            while b.now is not None and b.now[:3] == (*chain, ""):
                r = b.take()
                if not ids or ids[-1][0] != r[5]:
                    ids.append((r[5], r[4]))
            continue
        key = min(x.now[:4] for x in (a, b) if x.now is not None)
        had = a.take() if a.now is not None and a.now[:4] == key else None
        got: dict[int, str | None] = {}
        while b.now is not None and b.now[:4] == key:
            r = b.take()
            h = got.get(r[5])
            got[r[5]] = r[6] if h is None or r[6] is not None and r[6] > h else h
        if key[:2] != chain:  # a chain the delivery does not name
            if had is not None:
                yield ("keep", *had)
            continue
        known, start = had is not None, 0
        value = had[4] if had is not None else None
        first = next((i for i, (_, at) in enumerate(ids) if at is None), None)  # a mark: the chain was there before
        todo = ids if first is None else [x for x in ids if x[1] is not None]
        for n, (sid, at) in enumerate(todo):
            if sid in got:
                if not known and (n > 0 or first is not None):
                    yield ("change", sid, key[2], key[3], "added")
                elif known and key[2] == "file" and value is not None and got[sid] is not None and value != got[sid]:
                    yield ("change", sid, key[2], key[3], "changed")
                known, value = True, got[sid]
            elif known:
                yield ("change", sid, key[2], key[3], "removed")
                known, value = False, None
        if known:
            yield ("keep", *key, value, *todo[-1])


def merge(spark: SparkSession, path: str, delivery: DataFrame) -> DataFrame:
    """Merge a delivery of snapshots into the store; the changes it brings, as in ``snapshot_changes``."""
    bounds = spark.read.parquet(f"{path}/bounds").first()["bounds"]  # one text per range
    ranges, version = len(bounds) + 1, uuid.uuid4().hex
    held = _manifest(spark, path)
    kept = cut(listing(spark, path).select(*CHAIN, "at").distinct())  # the instant kept of each chain
    order = chain_order(delivery).join(kept.withColumnRenamed("at", "kept_at"), CHAIN, "left").where("kept_at is null or at > kept_at")
    fresh = cut(order.withColumn("known", F.col("kept_at").isNotNull()))
    rows = keyed_records(delivery, fresh).select("snapshot_id", *KEY, "at", "hash")

    @F.pandas_udf("int")
    def range_of(text: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, dtype=object), text.to_numpy(dtype=object), "right").astype("int32") if bounds else np.zeros(len(text), "int32"))

    def whole(*c):
        return range_of(F.concat_ws("\0", *c))

    body = rows.select(whole(*KEY).alias("r"), *KEY, "at", "snapshot_id", "hash")
    # Every range that can hold keys of a chain learns the chain's snapshots; the order begins with the chain, so these ranges are neighbours.
    empty, end = F.lit(""), F.lit(LAST)
    marks = fresh.select(*CHAIN, "snapshot_id", F.col("at").cast("long").alias("at")).unionByName(fresh.where("known").select(*CHAIN, F.lit(-1).cast("long").alias("snapshot_id"), F.lit(None).cast("long").alias("at")).distinct())
    heads = marks.select(F.explode(F.sequence(whole(*CHAIN, empty, empty), whole(*CHAIN, end, end))).alias("r"), *CHAIN, empty.alias("record_kind"), empty.alias("record_key"), "at", "snapshot_id", F.lit(None).cast("string").alias("hash"))
    # A row for every range, so that ranges without news are carried over by their task as well.
    every = spark.range(ranges).select(F.col("id").cast("int").alias("r"), *[empty.alias(k) for k in KEY], F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("snapshot_id"), F.lit(None).cast("string").alias("hash"))
    placed = body.withColumn("at", F.col("at").cast("long")).unionByName(heads).unionByName(every).repartitionById(ranges, F.col("r")).sortWithinPartitions("r", *KEY, F.col("at").asc_nulls_first(), "snapshot_id")
    old_file = {r["range"]: r["file"] for r in held.where("rows > 0").collect()}  # one per range

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        schema = pa.schema([*[(k, pa.string()) for k in KEY], ("hash", pa.string()), ("snapshot_id", pa.int64()), ("at", pa.int64())])
        stream = (r for b in batches for r in zip(b["r"], *(b[k] for k in KEY), *(b[c].astype("object").where(b[c].notna(), None) for c in ("at", "snapshot_id", "hash"))))
        pointer = _Side(stream)
        while pointer.now is not None:
            r = pointer.now[0]

            def news(r=r):
                while pointer.now is not None and pointer.now[0] == r:
                    x = pointer.take()
                    if x[1] or x[6] is not None:  # not the row that only names the range
                        yield (*x[1:5], x[5], x[6], x[7])

            def olds(r=r):
                if r in old_file:
                    fs, at = _files(old_file[r])
                    with fs.open_input_file(at) as f:
                        for b in pq.ParquetFile(f).iter_batches(10_000):
                            yield from zip(*(c.to_pylist() for c in b.columns))

            to = f"{path}/data/{version}/{int(r):05d}-{TaskContext.get().taskAttemptId()}.parquet"
            fs, at = _files(to)
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            n, keep, changes = 0, [], []
            with fs.open_output_stream(at) as f, pq.ParquetWriter(f, schema) as w:

                def flush():
                    w.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*keep), schema.types)], schema=schema))
                    keep.clear()

                for x in merge_range(olds(), news()):
                    if x[0] == "keep":
                        keep.append(x[1:])
                        n += 1
                        if len(keep) >= 10_000:
                            flush()
                    else:
                        changes.append((*x[1:], None, None, None))
                        if len(changes) >= 10_000:
                            yield pd.DataFrame(changes, columns=cols)
                            changes = []
                if keep:
                    flush()
            changes.append((None, None, None, None, int(r), to, n))
            yield pd.DataFrame(changes, columns=cols)

    cols = ["snapshot_id", "record_kind", "record_key", "change_kind", "range", "file", "rows"]
    done = cut(placed.mapInPandas(run, CHANGE + ", range int, file string, rows long"))  # once; its files are those of the attempts that counted
    _point(spark, path, version, [tuple(r) for r in done.where("file is not null").select("range", "file", "rows").collect()])  # one per range
    return done.where("change_kind is not null").select("snapshot_id", "record_kind", "record_key", "change_kind")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove the files of versions no longer in force; the names of the versions removed. No merge may be going on."""
    now = {r["file"].rsplit("/", 2)[1] for r in _manifest(spark, path).collect()}  # one row per range
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName() not in now] if fs.exists(p) else []
    for v in old:
        _delete(spark, f"{path}/data/{v}")
    return sorted(old)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a store."""
    _delete(spark, path)
