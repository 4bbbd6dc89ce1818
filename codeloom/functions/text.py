"""Text expressions: estimates, cleaning, markup lines, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROVIDERS = ["groq", "gemini", "openai", "anthropic", "nvidia"]


def token_estimate(*parts: Column) -> Column:
    """Characters of all parts together, divided by 4 and rounded down."""
    n = F.lit(0)
    for p in parts:
        n = n + F.coalesce(F.length(p), F.lit(0))
    return F.floor(n / 4).cast("int")


def strip_think(text: Column) -> Column:
    """Drop ``<think>`` blocks (an open one runs to the end), then outer blanks."""
    return F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?(?:</think>|\z)", ""), r"^\s+|\s+$", "")


def strip_fences(text: Column) -> Column:
    """Drop a leading code-fence line and a closing one."""
    head = F.regexp_replace(text, r"\A[ \t]*```[^\n]*(?:\n|\z)", "")
    return F.regexp_replace(head, r"(?:\A|\n)[ \t]*```[ \t]*\n?\z", "")


def marked_blocks(text: Column, begin: str = r"\[FILE:\s*([^\]]+)\]", end: str = r"\[END\]") -> Column:
    """array<struct(name, body)> of blocks between a begin marker that names them and an end marker."""
    whole = F.regexp_extract_all(text, F.lit(f"(?s)({begin}.*?{end})"), F.lit(1))
    return F.transform(whole, lambda b: F.struct(F.trim(F.regexp_extract(b, begin, 1)).alias("name"), F.regexp_replace(F.regexp_replace(F.regexp_replace(b, rf"(?s)\A{begin}", ""), rf"(?s){end}\z", ""), r"^\s+|\s+$", "").alias("body")))


def markdown_class(line: Column) -> Column:
    """Class of a Markdown line, outer blanks aside: h1, h2, h3, bullet, numbered, blank, text."""
    s = F.trim(line)
    return (
        F.when(s == "", "blank").when(s.startswith("# "), "h1").when(s.startswith("## "), "h2").when(s.startswith("### "), "h3")
        .when(s.rlike("^[-*•] "), "bullet").when(s.rlike(r"^\d+\.\s"), "numbered").otherwise("text")
    )


def strip_inline(line: Column) -> Column:
    """Drop bold, italic and code marks, keep their text."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"\*\*(.+?)\*\*", "$1"), r"\*(.+?)\*", "$1"), r"`(.+?)`", "$1")


def parse_chain(text: Column, providers: list[str] | None = None) -> Column:
    """array<struct(provider, model, key)> of a ``provider:model:key`` list; invalid entries drop out, none left gives null.

    The split is limited to three parts, so a key may hold further colons.
    """
    rows = F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda e: F.split(F.trim(e), ":", 3)),
        lambda p: (F.size(p) == 3) & F.trim(F.get(p, F.lit(0))).isin(providers or PROVIDERS) & (F.trim(F.get(p, F.lit(1))) != "") & (F.trim(F.get(p, F.lit(2))) != ""),
    )
    out = F.transform(rows, lambda p: F.struct(F.trim(p[0]).alias("provider"), F.trim(p[1]).alias("model"), F.trim(p[2]).alias("key")))
    return F.when(F.size(out) > 0, out)


def provider_of(model: Column) -> Column:
    """Provider inferred from the prefix of a model name (fixed values)."""
    return F.when(model.startswith("gemma-") | model.startswith("gemini-"), "gemini").when(model.startswith("nvidia/"), "nvidia").otherwise("groq")


def unused_name(line: Column) -> Column:
    """Name reported by a line ``path:line: unused kind 'name' (..% confidence)`` of an external analyser."""
    return F.nullif(F.regexp_extract(line, r"unused \w+ '([^']+)'", 1), F.lit(""))


def import_lines(text: Column) -> Column:
    """The import statements of a Python file that stand on lines of their own, by pattern."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*((?:import|from)[ \t][^\r\n]+)"), F.lit(1)), lambda s: F.rtrim(s))


def python_import(stmt: Column) -> Column:
    """Module named by a Python import statement; only the first of several."""
    return F.coalesce(F.nullif(F.regexp_extract(stmt, r"^\s*from\s+(\.*[\w.]*)\s+import\b", 1), F.lit("")), F.nullif(F.regexp_extract(stmt, r"^\s*import\s+([\w.]+)", 1), F.lit("")))


def js_import(stmt: Column) -> Column:
    """Module named by a JavaScript import or require."""
    return F.coalesce(F.nullif(F.regexp_extract(stmt, r"from\s+['\"]([^'\"]+)['\"]", 1), F.lit("")), F.nullif(F.regexp_extract(stmt, r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", 1), F.lit("")))


def normal_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; ``..`` at the root is ignored."""
    return F.array_join(F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))), "/")


def python_candidates(path: Column, module: Column) -> Column:
    """Ordered candidate files of a (possibly relative) Python import in ``path``; null if it climbs too far or names nothing."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.regexp_replace(module, r"^\.+", "")
    pkg = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    keep = F.size(pkg) - dots + 1
    base = F.when(dots > 0, F.when((keep > 0) | ((keep == 0) & (rest != "")), F.slice(pkg, F.lit(1), F.greatest(keep, F.lit(0))))).otherwise(F.array().cast("array<string>"))
    stem = F.array_join(F.concat(base, F.filter(F.split(rest, r"\."), lambda s: s != "")), "/")
    return F.when(base.isNotNull() & (stem != ""), F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py"))))


# What a JavaScript import without an extension may stand for, in order.
JS_TAILS = [".js", ".ts", ".tsx", ".jsx", ".mjs", ".cjs", "/index.js", "/index.ts", "/index.tsx", ""]


def js_candidates(path: Column, module: Column) -> Column:
    """Ordered candidate files of a relative JavaScript import; null for packages."""
    folder = F.array_join(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), "/")
    full = normal_path(F.concat_ws("/", folder, module))
    return F.when(module.startswith("."), F.array(*[F.concat(full, F.lit(t)) for t in JS_TAILS]))
