"""Filling containers of fixed capacity: minimum bin slack over a histogram of lengths.

Only lengths matter for the fill, and there are at most ``capacity`` of them, so the search runs on the histogram
(at most ``capacity`` rows, whatever the number of items). For each bin it takes the largest remaining length and, by
bitset subset-sum over the lengths that remain, the fullest combination with it; the combination is removed as
often as the counts allow. Bins are then dealt out to the items by their rank within their length, which is
computed in two levels (length, salt), so that a length shared by a third of all rows is still spread over tasks.

Defined cases
    * An item larger than the capacity is split into full containers and a remainder; no other item is split.
    * Null or empty content has size 0; such items ride along in existing bins, spread by hash (bin 0 if none).
    * The size is always computed from the content, never taken from a stale tokens column.
    * Equal lengths are interchangeable and assigned in the order of (salt, id); repeated rows are packed each.
    * An empty table gives an empty result. Extra columns are ignored; null paths are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import cut, shuffle_partitions


def fullest(sizes: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available sizes with the largest sum not above ``room`` (bitset subset-sum with traceback)."""
    mask, reach, goal, steps = (1 << (room + 1)) - 1, 1, 1 << room, []
    for s in sizes:
        if s > room:
            continue
        left, part = min(counts[s], room // s), 1
        while left > 0 and not reach & goal:
            k = min(part, left)
            steps.append((s, k, reach))
            reach |= (reach << (s * k)) & mask
            left -= k
            part *= 2
        if reach & goal:
            break
    best, use = reach.bit_length() - 1, {}
    for s, k, before in reversed(steps):
        if not (before >> best) & 1:
            use[s] = use.get(s, 0) + k
            best -= s * k
    return use


def pack_histogram(hist: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(combination {size: how often}, number of bins filled so)]; sizes must be 1..capacity."""
    counts = {s: c for s, c in hist.items() if c > 0}
    order, out = sorted(counts, reverse=True), []
    while order:
        top = order[0]
        counts[top] -= 1
        use = fullest(order, counts, capacity - top)
        counts[top] += 1
        use[top] = use.get(top, 0) + 1
        times = min(counts[s] // k for s, k in use.items())
        for s, k in use.items():
            counts[s] -= k * times
        out.append((use, times))
        order = [s for s in order if counts[s] > 0]
    return out


def pack(df: DataFrame, capacity: int, id_col: str = "module_id", text_col: str = "content", name_col: str = "path") -> DataFrame:
    """(id, name, part_no, tokens, bin_id): one row per item, or per part of an item above the capacity."""
    capacity = int(capacity)
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark = df.sparkSession
    salts = max(16, 4 * shuffle_partitions(spark))
    size = F.coalesce(F.floor(F.length(text_col) / 4), F.lit(0)).cast("long")
    n_full = F.floor(size / capacity)
    parts = F.concat(
        F.transform(F.when(n_full > 0, F.sequence(F.lit(1), n_full)).otherwise(F.array().cast("array<bigint>")), lambda i: F.lit(capacity).cast("long")),
        F.when((size % capacity > 0) | (size == 0), F.array((size % capacity).cast("long"))).otherwise(F.array().cast("array<bigint>")),
    )
    units = cut(
        df.select(F.col(id_col).alias("id"), F.col(name_col).cast("string").alias("name"), F.posexplode(parts).alias("part_no", "tokens"))
        .withColumn("salt", F.pmod(F.xxhash64("id", "part_no", "name"), F.lit(salts)).cast("int"))
    )
    cells = cut(units.where("tokens > 0").groupBy("tokens", "salt").agg(F.count("*").alias("n")))
    hist = {r["tokens"]: r["n"] for r in cells.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    first_bin, taken, rows = 0, dict.fromkeys(hist, 0), []
    for use, times in pack_histogram(hist, capacity):
        for s, k in use.items():
            rows.append((s, taken[s], k, first_bin))
            taken[s] += k * times
        first_bin += times
    bins = max(first_bin, 1)
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    heads = {int(s): i for s, i in zip(*np.unique(table[:, 0], return_index=True))} if len(table) else {}

    def deal(batches):
        for b in batches:
            s, r = b["tokens"].to_numpy(np.int64), b["r"].to_numpy(np.int64)
            out = np.zeros(len(b), np.int64)
            for size_ in np.unique(s):
                lo = heads[int(size_)]
                hi = lo + int(np.searchsorted(table[lo:, 0], size_, "right"))
                here = s == size_
                at = lo + np.searchsorted(table[lo:hi, 1], r[here], "right") - 1
                out[here] = table[at, 3] + (r[here] - table[at, 1]) // table[at, 2]
            yield pd.DataFrame({"id": b["id"], "name": b["name"], "part_no": b["part_no"], "tokens": s, "bin_id": out})

    before = Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    ranked = (
        units.where("tokens > 0")
        .withColumn("k", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("id", "part_no")) - 1)
        .join(offsets, ["tokens", "salt"])
        .select(F.col("id").cast("string").alias("id"), "name", "part_no", "tokens", (F.col("off") + F.col("k")).alias("r"))
    )
    kind = dict(df.dtypes)[id_col]
    placed = ranked.mapInPandas(deal, "id string, name string, part_no int, tokens long, bin_id long").withColumn("id", F.col("id").cast(kind))
    riders = units.where("tokens = 0").select("id", "name", "part_no", "tokens", F.pmod(F.xxhash64("id", "name"), F.lit(bins)).cast("long").alias("bin_id"))
    return placed.unionByName(riders).withColumnRenamed("id", id_col).withColumnRenamed("name", name_col)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(capacity, bins, items, tokens, fill): how full the bins are on the whole."""
    return packed.groupBy("bin_id").agg(F.sum("tokens").alias("used"), F.count("*").alias("items")).agg(
        F.lit(int(capacity)).alias("capacity"), F.count("*").alias("bins"), F.sum("items").alias("items"), F.sum("used").alias("tokens"),
        (F.sum("used") / (F.count("*") * int(capacity))).alias("fill"), F.max("used").alias("fullest_bin"),
    )
