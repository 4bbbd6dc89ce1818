"""Mixing sources to target shares of tokens by pivotal dependent rounding.

Every record of a source is to be used x times on average; floor(x) copies are certain, the fractional part is a
probability. Pairs of probabilities play against each other: probability mass, weighted by size, moves at
random from one to the other until one is 0 or 1, so the expected copies of every record stay as they were and the
tokens of a source hardly move at all. Pairing runs within (source, bucket) groups of bounded size; each leaves at
most one fractional record, and these residuals meet in a tree of the same step until one per source is left.

The total is the largest at which every share can be met with at most ``max_repeats`` copies of a record; shares of
sources without any tokens are spread over the others in proportion. With ``total_tokens`` given, sources
that run into their cap fall short, and the report shows by how much.

Defined cases
    * Source spellings are folded (case, outer blanks, runs of blanks and hyphens become ``_``), on both sides.
    * Records of sources not listed, of null source, and with null or empty text are not used.
    * Targets folding to the same name add their shares and take the larger cap; null share is 0, null or
      smaller cap is 1.
    * Repeated rows take part each on their own, paired in the order of (id, size). Empty tables give empty results.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.bpe import count_tokens
from codeloom.session import cut, spread

GROUP = 20_000
FAN_IN = 4_096


def fold_source(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[-\\s]+", "_")


def duel(p: list[float], size: list[int], rng: random.Random) -> list[float]:
    """Pivotal rounding of probabilities p, keeping sum(p * size); at most one of the result is fractional."""
    p, eps = list(p), 1e-12
    i = None
    for j in range(len(p)):
        if not eps < p[j] < 1 - eps:
            p[j] = float(p[j] > 0.5)
            continue
        if i is None:
            i = j
            continue
        a, b, s, t = p[i], p[j], size[i], size[j]
        up, down = min((1 - a) * s, b * t), min(a * s, (1 - b) * t)
        if rng.random() * (up + down) < down:
            a, b = a + up / s, b - up / t
        else:
            a, b = a - down / s, b + down / t
        p[i], p[j] = min(max(a, 0.0), 1.0), min(max(b, 0.0), 1.0)
        done_i, done_j = not eps < p[i] < 1 - eps, not eps < p[j] < 1 - eps
        if done_i:
            p[i] = float(p[i] > 0.5)
        if done_j:
            p[j] = float(p[j] > 0.5)
        if done_i:
            i = None if done_j else j
    return p


def _round(df: DataFrame, seed: int, last: bool = False) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["id", "tokens"], kind="stable")
        rng = random.Random(f"{seed}/{g['source'].iloc[0]}/{g['bucket'].iloc[0]}/{len(g)}")
        p = duel(g["p"].tolist(), g["tokens"].tolist(), rng)
        if last:
            p = [float(x > rng.random()) if 0 < x < 1 else x for x in p]
        return g.assign(p=p)

    return df.groupBy("source", "bucket").applyInPandas(run, df.schema)


def plan_totals(available: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: int | None = None) -> dict[str, float]:
    """source -> average copies of each of its records."""
    live = {s: t for s, t in targets.items() if available.get(s, 0) > 0 and t[0] > 0}
    weight = sum(w for w, _ in live.values())
    if not live:
        return {}
    total = min(cap * available[s] * weight / w for s, (w, cap) in live.items()) if total_tokens is None else total_tokens
    return {s: min(float(cap), total * w / weight / available[s]) for s, (w, cap) in live.items()}


def mix(docs: DataFrame, targets: DataFrame, vocab: str | None = None, total_tokens: int | None = None, seed: int = 42,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(records (id, source, tokens, copies) of the mixture, report per target source)."""
    wanted = targets.select(fold_source(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"),
                            F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("cap")).where("source is not null")
    wanted = wanted.groupBy("source").agg(F.sum("share").alias("target_share"), F.max("cap").alias("max_repeats"))
    goal = {r["source"]: (r["target_share"], r["max_repeats"]) for r in wanted.collect()}  # one row per listed source
    listed = docs.select(F.col(id_col).cast("string").alias("id"), fold_source(F.col(source_col)).alias("source"), F.col(text_col).alias("text")).where(
        F.col("source").isin(list(goal)) & (F.length("text") > 0)) if goal else docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where("false")
    sized = cut(count_tokens(spread(listed), vocab).where("tokens > 0"))
    per_source = {r["source"]: (r["n"], r["t"]) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    x = plan_totals({s: t for s, (_, t) in per_source.items()}, goal, total_tokens)
    rates = F.create_map(*[F.lit(v) for s, q in x.items() for v in (s, float(q))]) if x else None
    groups = F.create_map(*[F.lit(v) for s in x for v in (s, -(-per_source[s][0] // GROUP))]) if x else None
    base = sized.where(F.col("source").isin(list(x))) if x else sized.where("false")
    rate = rates[F.col("source")] if x else F.lit(0.0)
    n_groups = groups[F.col("source")] if x else F.lit(1)
    start = base.select(
        "id", "source", "tokens", F.floor(rate + 1e-9).cast("int").alias("sure"), F.greatest(rate - F.floor(rate + 1e-9), F.lit(0.0)).alias("p"),
        F.pmod(F.xxhash64("id", F.lit(seed)), n_groups).cast("int").alias("bucket"),
    )
    most = max((-(-n // GROUP) for s, (n, _) in per_source.items() if s in x), default=1)
    done, level = [], cut(_round(start, seed, most == 1))
    while most > 1:
        done.append(level.where("p = 0 or p = 1"))
        most = -(-most // FAN_IN)
        left = level.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("int"))
        level = cut(_round(left, seed, most == 1))
    done.append(level)
    records = done[0]
    for d in done[1:]:
        records = records.unionByName(d)
    records = records.select("id", "source", "tokens", (F.col("sure") + F.col("p").cast("int")).alias("copies")).where("copies > 0")
    used = records.groupBy("source").agg(F.count("*").alias("records"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    had = sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    report = wanted.join(had, "source", "left").join(used, "source", "left").na.fill(0, ["source_tokens", "records", "used_tokens", "most_copies"])
    whole = records.agg(F.sum(F.col("tokens") * F.col("copies"))).scalar()
    report = report.select(
        "source", "target_share", "max_repeats", "source_tokens", "records", "used_tokens", "most_copies",
        F.coalesce(F.try_divide("used_tokens", whole), F.lit(0.0)).alias("actual_share"))
    return records.withColumn("id", F.col("id").cast(dict(docs.dtypes)[id_col])).withColumnRenamed("id", id_col), report
