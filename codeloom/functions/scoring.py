"""Scores and size classes (all thresholds are fixed values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Extensions of files that go to the fastest models whatever their size.
NON_CODE_EXTENSIONS = [
    ".md", ".txt", ".rst", ".pdf", ".docx", ".log",
    ".yml", ".yaml", ".toml", ".cfg", ".ini", ".conf",
    ".env", ".env.example", ".properties",
    ".sh", ".bash", ".zsh", ".fish", ".bat", ".cmd", ".ps1",
    ".html", ".htm", ".css", ".scss", ".sass", ".less",
    ".json", ".xml", ".csv", ".tsv",
    ".sql",
    ".gitignore", ".gitattributes", ".editorconfig",
    ".dockerignore", ".mailmap", ".npmrc", ".yarnrc",
    ".license", ".changelog", ".makefile",
]


def file_tier(ext: Column, tokens: Column, non_code: list[str] = NON_CODE_EXTENSIONS) -> Column:
    """Model tier of a file by kind and size."""
    return F.when(ext.isin(non_code), "tier0").when(tokens < 500, "tier1").when(tokens < 3000, "tier2").when(tokens < 8000, "tier3").otherwise("tier4")


def out_tokens(tokens: Column) -> Column:
    return F.when(tokens < 300, 512).when(tokens < 1000, 768).otherwise(1024)


def refactor_budget(tokens: Column) -> Column:
    return F.least(F.floor(tokens * 1.5).cast("int") + 512, F.lit(8192))


def capacity(limit: Column, share: float = 0.80) -> Column:
    return F.floor(limit * share).cast("int")


def size_class(tokens: Column, threshold: int = 50_000) -> Column:
    return F.when(tokens >= threshold, "large").otherwise("standard")


def severity(label: Column) -> Column:
    """Analyser severities to HIGH, MEDIUM, LOW."""
    u = F.upper(F.coalesce(label, F.lit("WARNING")))
    return F.when(u.isin("ERROR", "HIGH"), "HIGH").when(u.isin("WARNING", "MEDIUM"), "MEDIUM").otherwise("LOW")


def answer_quality(answer: Column, functions: Column, classes: Column, tokens: Column) -> Column:
    """0..1: half for named symbols, 0.3 for length against size, 0.1 each for purpose and structure words; 0 below 50 characters."""
    names = F.concat(F.slice(functions, 1, 6), F.slice(classes, 1, 4))
    named = F.size(F.filter(names, lambda n: F.contains(answer, n)))
    by_name = F.when(F.size(names) > 0, 0.5 * named / F.size(names)).otherwise(0.25)
    expected = F.greatest(F.lit(80.0), tokens * 0.4)
    low = F.lower(answer)
    purpose = low.rlike("purpose|this file|this module|responsible for")
    structure = low.rlike("function|class|method|def |returns|handles")
    full = by_name + 0.3 * F.least(F.length(answer) / expected, F.lit(1.0)) + 0.1 * purpose.cast("int") + 0.1 * structure.cast("int")
    return F.when(F.coalesce(F.length(answer), F.lit(0)) < 50, 0.0).otherwise(full)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)

    def norm(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))  # a vector of zeros is like none


def change_scope(files: Column) -> Column:
    """Size class of a change set."""
    return F.when(files < 5, "small").when(files <= 20, "medium").otherwise("large")


def complexity_class(cx: Column) -> Column:
    return F.when(cx <= 0, "").when(cx < 50, "low").when(cx < 200, "medium").otherwise("high")


def budget_label(tokens: Column) -> Column:
    """Size class of a token budget."""
    out = F.lit("4k")
    for n, name in ((8000, "8k"), (16000, "16k"), (32000, "32k"), (64000, "64k"), (128000, "128k")):
        out = F.when(tokens >= n, name).otherwise(out)
    return out


def k_format(n: Column) -> Column:
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", n / 1000.0), F.lit("k"))).otherwise(n.cast("string"))
