"""Ranking files for a task under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))


def snippet(content: Column, n: int = 1500) -> Column:
    """The part of a file that the context index keeps."""
    return F.substring(content, 1, n)


def with_filters(files: DataFrame, exts: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Keep files with one of the extensions (``py`` and ``.py`` alike) below a path prefix (its trailing ``/`` is dropped)."""
    if exts:
        tails = ["." + e.strip().lstrip(".").lower() for e in exts if e.strip()]
        files = files.where(F.exists(F.array(*[F.lit(t) for t in tails]), lambda t: F.endswith(F.lower("path"), t)))
    if prefix and prefix.strip().rstrip("/"):
        files = files.where(F.col("path").startswith(prefix.strip().rstrip("/")))
    return files


def symbol_words() -> Column:
    """Distinct lower-case words of path, functions and classes."""
    path = F.translate("path", "/_.", "   ")
    return _words(F.lower(F.concat_ws(" ", path, F.translate(F.array_join("functions", " "), "_", " "), F.translate(F.array_join("classes", " "), "_", " "))))


def keyword_score(task: str, snippet: Column) -> dict[str, Column]:
    """Score parts of a task text: 3 per exact word, 0.5 per word containing or contained, 2 per word pair, 1 per word of the snippet."""
    words = sorted(set(task.lower().split()))
    run = task.lower().split()
    pairs = sorted({f"{a} {b}" for a, b in zip(run, run[1:])})
    sym = symbol_words()
    w = F.array(*[F.lit(x) for x in words]).cast("array<string>")
    exact = F.array_intersect(w, sym)
    rest = F.array_except(w, sym)
    partial = F.filter(rest, lambda t: F.exists(sym, lambda s: F.contains(t, s) | F.contains(s, t)))
    low = F.lower(F.coalesce(snippet, F.lit("")))
    hay = F.concat(F.lower("path"), F.lit(" "), low)
    phrase = F.filter(F.array(*[F.lit(x) for x in pairs]).cast("array<string>"), lambda p: F.contains(hay, p))
    snip = F.filter(rest, lambda t: F.contains(low, t))
    return {
        "score": 3.0 * F.size(exact) + 0.5 * F.size(partial) + 2.0 * F.size(phrase) + 1.0 * F.size(snip),
        "reasons": F.array_distinct(F.concat(F.slice(F.sort_array(exact), 1, 4), F.slice(F.sort_array(phrase), 1, 2), F.slice(F.sort_array(F.array_except(snip, partial)), 1, 2))),
    }


def centrality(in_degree: Column) -> Column:
    return F.log1p(in_degree) * 2.0


def within_budget(scored: DataFrame, budget: int, score: str = "score", order: str = "ord", tokens: str = "tokens") -> DataFrame:
    """Rows by score while the total before a row is below the budget; the last may overshoot.

    Every file costs at least one token, so no more than ``budget`` rows can be chosen: the top-k in front of the running sum
    keeps its single partition bounded by the budget. Null tokens count 100; a budget of 0 or less means 8000.
    """
    budget = budget if budget > 0 else 8000
    cost = F.greatest(F.coalesce(F.col(tokens), F.lit(100)), F.lit(1))
    top = scored.orderBy(F.desc(score), order).limit(budget).withColumn("cost", cost)
    w = Window.orderBy(F.desc(score), order)
    before = F.coalesce(F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return top.withColumn("rank", F.row_number().over(w)).withColumn("before", before).where(F.col("before") < budget).drop("before")


def fit_snippets(chosen: DataFrame, budget: int, snippet: str = "snippet") -> DataFrame:
    """Scale snippets to the budget if the chosen files exceed it and add each file's share of the tokens."""
    total = F.sum("cost").over(Window.partitionBy())
    keep = F.when(total > budget, F.floor(F.length(snippet) * (F.lit(float(budget)) / total))).otherwise(F.length(snippet)).cast("int")
    return chosen.withColumns({snippet: F.substring(F.col(snippet), F.lit(1), keep), "tokens_share": F.col("cost") / total})
