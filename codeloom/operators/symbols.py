"""Symbol analyses: inverted token index, dead code, test coverage gaps, call reachability.

A word-boundary search of every symbol in every file is an equi-join once the texts are tokenised: for a symbol of word
characters, ``\\bsym\\b`` matches exactly where ``sym`` is a maximal run of word characters. Symbols with other
characters (``foo?``, ``$x``) are rare and take a regular-expression join of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import is_analysis_target, is_test_file
from codeloom.operators.graph import reach

#: Fixed value: decorators that register a function with a framework.
DECORATORS = r"@(app|router|blueprint|celery|pytest|signal|admin)\.|@(staticmethod|classmethod|property|overload|abstractmethod)|urlpatterns|admin\.register"


def token_index(files: DataFrame, key: list[str], text: str = "content") -> DataFrame:
    """(key, token, n): every maximal run of word characters and how often it occurs; counted per file before the shuffle."""
    words = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?U)(\w+)"), F.lit(1)))
    return files.where(F.length(text) > 0).select(*key, words.alias("token")).groupBy(*key, "token").agg(F.count("*").alias("n"))


def word_symbols(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    return df.where(F.col(symbol).rlike(r"(?U)^\w+$"))


def references(definitions: DataFrame, index: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, symbol, path, in_path, n) of every mention of a defined symbol within its scope (repository)."""
    idx = index.withColumnRenamed("path", "in_path").withColumnRenamed("token", "symbol")
    return word_symbols(definitions).join(idx, [*scope, "symbol"])


def odd_references(definitions: DataFrame, files: DataFrame, scope: list[str], text: str = "content") -> DataFrame:
    """The same for symbols that are not plain words (``foo?``): files that hold the symbol's longest word, by an equi-join with the token
    index, are searched by a regular expression. Symbols without any word are held against the files that hold their first sign.
    """
    odd = definitions.where(~F.col("symbol").rlike(r"(?U)^\w+$") & (F.length("symbol") > 0))
    runs = F.regexp_extract_all("symbol", F.lit(r"(?U)(\w+)"), F.lit(1))
    longest = F.element_at(F.transform(F.array_sort(F.transform(runs, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"]), 1)
    odd = odd.withColumn("token", F.when(F.size(runs) > 0, longest).otherwise(F.substring(F.trim("symbol"), 1, 1)))
    signs = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?U)([^\w\s])"), F.lit(1)))
    index = token_index(files, [*scope, "path"], text).select(*scope, F.col("path").alias("in_path"), "token").unionByName(
        files.where(F.length(text) > 0).select(*scope, F.col("path").alias("in_path"), F.explode(signs).alias("token")))
    odd = odd.join(index, [*scope, "token"]).drop("token")
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("symbol"), F.lit(r"\E(?!\w)"))
    hay = files.select(*scope, F.col("path").alias("in_path"), F.col(text).alias("t"))
    return odd.join(hay, [*scope, "in_path"]).where(F.contains("t", "symbol")).withColumn("n", F.regexp_count("t", quoted).cast("long")).where("n > 0").drop("t")


def definition_counts(files: DataFrame, key: list[str], text: str = "content") -> DataFrame:
    """(key, symbol, defs): occurrences of ``def`` or ``class`` before a name."""
    names = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?U)\b(?:def|class)\s+(\w+)"), F.lit(1)))
    return files.select(*key, names.alias("symbol")).groupBy(*key, "symbol").agg(F.count("*").alias("defs"))


def framework_symbols(files: DataFrame, key: list[str], text: str = "content") -> DataFrame:
    """(key, symbol) of definitions with a framework decorator on one of the lines just above."""
    block = r"(?U)((?:[^\n]*\n){0,3}?[^\n]*\b(?:def|class)\s+\w+)"
    hit = F.explode(F.regexp_extract_all(F.col(text), F.lit(block), F.lit(1)))
    files = files.where(F.col(text).rlike(DECORATORS))  # few files have any; the block search below is slow
    return files.select(*key, hit.alias("b")).where(F.col("b").rlike(DECORATORS)).select(*key, F.regexp_extract("b", r"(?U)\b(?:def|class)\s+(\w+)$", 1).alias("symbol")).where("symbol <> ''").distinct()


def dead_symbols(definitions: DataFrame, files: DataFrame, scope: list[str], callees: DataFrame | None = None, exports: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """Defined symbols (scope, path, kind, symbol) that nothing refers to.

    Dead: not private, not a dunder, not registered by a framework, not exported, not a callee, no mention in another file,
    no mention beyond its definitions in its own file, and not vetoed by ``live`` (an external analyser, optional).
    """
    key = [*scope, "path"]
    # Tests are no targets, but what they mention is alive; a symbol defined in two files mentions itself across files.
    todo = definitions.where(is_analysis_target(F.col("path")) & ~F.col("symbol").startswith("_")).select(*key, "kind", "symbol").distinct()
    idx = token_index(files, key)
    seen = references(todo, idx, scope).unionByName(odd_references(todo, files, scope).select(*key, "kind", "symbol", "in_path", "n"))
    counts = seen.groupBy(*key, "kind", "symbol").agg(F.max((F.col("in_path") != F.col("path")).cast("int")).alias("elsewhere"), F.sum(F.when(F.col("in_path") == F.col("path"), F.col("n")).otherwise(0)).alias("own"))
    out = (
        todo.join(counts, [*key, "kind", "symbol"], "left").join(definition_counts(files, key), [*key, "symbol"], "left").na.fill(0, ["elsewhere", "own", "defs"])
        .where("elsewhere = 0 and own <= defs").join(framework_symbols(files, key), [*key, "symbol"], "left_anti")
    )
    for veto in (callees, exports, live):
        if veto is not None:
            out = out.join(veto, [c for c in [*scope, "symbol"] if c in veto.columns], "left_anti")
    return out.select(*key, "kind", "symbol")


def coverage(definitions: DataFrame, files: DataFrame, scope: list[str], calls: DataFrame | None = None) -> DataFrame:
    """(scope, path, fn, status): public functions outside tests, ``covered`` if a test mentions them, ``indirect`` if covered code reaches them, else ``gap``.

    ``calls`` has (scope, caller, callee) by bare name. Names count across all files of a scope.
    """
    fns = definitions.where((F.col("kind") == "function") & ~F.col("symbol").startswith("_") & ~is_test_file(F.col("path"))).select(*scope, "path", F.col("symbol").alias("fn"))
    mentioned = token_index(files.where(is_test_file(F.col("path"))), scope).select(*scope, F.col("token").alias("fn"))
    names = fns.select(*scope, "fn").distinct().join(mentioned, [*scope, "fn"], "left_semi").withColumn("direct", F.lit(1))
    out = fns.join(names, [*scope, "fn"], "left")
    if calls is not None:
        tag = F.to_json(F.struct(*scope, F.col("x")))
        group = scope[0] if len(scope) == 1 else None
        by = [group] if group else []
        seeds = names.withColumn("x", F.col("fn")).select(*by, F.lit(0).alias("origin"), tag.alias("node"))
        edges = calls.select(*by, F.to_json(F.struct(*scope, F.col("caller").alias("x"))).alias("src"), F.to_json(F.struct(*scope, F.col("callee").alias("x"))).alias("dst")).distinct()
        hit = reach(seeds, edges, reverse=False, group=group).select("node").distinct().withColumn("indirect", F.lit(1))
        out = out.withColumn("node", F.to_json(F.struct(*scope, F.col("fn").alias("x")))).join(hit, "node", "left").drop("node")
    else:
        out = out.withColumn("indirect", F.lit(None).cast("int"))
    return out.select(*scope, "path", "fn", F.when(F.col("direct") == 1, "covered").when(F.col("indirect") == 1, "indirect").otherwise("gap").alias("status"))


def coverage_totals(status: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, total, covered, indirect, gaps, pct) with the percentage truncated."""
    n = F.count("*")
    c, i, g = (F.count_if(F.col("status") == s) for s in ("covered", "indirect", "gap"))
    return status.groupBy(*scope).agg(n.alias("total"), c.alias("covered"), i.alias("indirect"), g.alias("gaps"), ((c + i).cast("double") / n * 100).cast("int").alias("pct"))
