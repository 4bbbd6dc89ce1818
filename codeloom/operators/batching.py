"""Chunks of fixed length and greedy batches under a token limit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_ranks(df: DataFrame, group: list[str], order: str, ties: list[str] | None = None, prefix: int = 24, rank: str = "rank") -> DataFrame:
    """Ranks from 1 within a group by a text column, for groups of any size.

    Two levels: rows are ranked among those that share the first ``prefix`` characters (which keeps the order of texts), and the counts of
    the prefixes give each its offset; only the counts of a group meet in one task.
    """
    order_by = [F.col(order).asc_nulls_first(), *(ties or [])]
    head = F.substring(F.col(order), 1, prefix)
    part = df.withColumn("_head", head)
    counts = part.groupBy(*group, "_head").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(F.col("_head").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = part.withColumn("_k", F.row_number().over(Window.partitionBy(*group, "_head").orderBy(*order_by)))
    a, b = within.alias("a"), offsets.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_head"]]
    return a.join(b, on).select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("b._off") + F.col("a._k")).alias(rank))


def first_n(df: DataFrame, group: list[str], order: list, n: int, salts: int = 16) -> DataFrame:
    """The first n rows of each group in an order, in two levels, so that a hot group is cut before its rows meet."""
    part = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    short = part.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))).where(F.col("_r") <= n).drop("_r", "_salt")
    return short.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def chunks(df: DataFrame, n: int, group: list[str], order: list) -> DataFrame:
    """Number consecutive runs of n rows within each group, ordered by a text column and further ones for ties."""
    ranked = ordered_ranks(df, group, order[0], order[1:], rank="_rank")
    return ranked.withColumn("chunk", F.floor((F.col("_rank") - 1) / n).cast("int")).drop("_rank")


def greedy(tokens: list[int], limit: int, most: int) -> list[int]:
    """Batch number of each item in order: a batch closes when the next item would exceed the limit, or at ``most`` items."""
    out, batch, used, n = [], 0, 0, 0
    for t in tokens:
        if n and (used + t > limit or n >= most):
            batch, used, n = batch + 1, 0, 0
        out.append(batch)
        used, n = used + t, n + 1
    return out


def greedy_batches(df: DataFrame, limit: int, group: list[str], order: list[str], tokens: str = "tokens", most: int = 6) -> DataFrame:
    """Greedy batches per group, in order. Rows are sorted by the shuffle and folded as a stream: a task carries only the
    running batch of each group it meets, whatever the group's size."""
    src = df.repartition(*group).sortWithinPartitions(*group, *order)
    schema = T.StructType([*src.schema.fields, T.StructField("batch", T.IntegerType())])

    def fold(batches):
        now, batch, used, n = None, 0, 0, 0
        for b in batches:
            out = []
            for key, t in zip(zip(*(b[g] for g in group)), b[tokens]):
                if key != now:
                    now, batch, used, n = key, 0, 0, 0
                if n and (used + t > limit or n >= most):
                    batch, used, n = batch + 1, 0, 0
                out.append(batch)
                used, n = used + t, n + 1
            yield b.assign(batch=pd.Series(out, index=b.index, dtype="int32"))

    return src.mapInPandas(fold, schema)
