"""Parsing files to symbols, imports, exports and calls.

Python files are parsed exactly (``ast``); other languages by regular expressions over comment-free text, which is an
approximation. One Arrow-batched pass; the result is one row per file with the fields of ``schema.STRUCTURE``.
Files that do not parse give empty lists.
"""

from __future__ import annotations

import ast
import re
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = "functions array<string>, classes array<string>, imports array<string>, exports array<string>, calls map<string,array<string>>"
EMPTY: dict = {"functions": [], "classes": [], "imports": [], "exports": [], "calls": {}}


class _Walk(ast.NodeVisitor):
    def __init__(self, source: str):
        self.lines, self.scope = source, []
        self.out: dict = {"functions": [], "classes": [], "imports": [], "exports": [], "calls": {}}

    def visit_FunctionDef(self, node):
        for d in node.decorator_list:
            self.visit(d)
        self.out["functions"].append(node.name)
        self.out["calls"].setdefault(node.name, [])
        self.scope.append(node.name)
        for child in [node.args, *([node.returns] if node.returns else []), *node.body]:
            self.visit(child)
        self.scope.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self.out["classes"].append(node.name)
        self.generic_visit(node)

    def visit_Import(self, node):
        self.out["imports"].append(ast.get_source_segment(self.lines, node) or ast.unparse(node))

    visit_ImportFrom = visit_Import

    def visit_Assign(self, node):
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            self.out["exports"] += [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        self.generic_visit(node)

    def visit_Call(self, node):
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name and self.scope:
            self.out["calls"][self.scope[-1]].append(name)
        self.generic_visit(node)


def parse_python(text: str) -> dict:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.lstrip("﻿"))
        w = _Walk(text)
        w.visit(tree)
        return w.out
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return dict(EMPTY)


_NOISE = {"c": re.compile(r"//[^\n]*|/\*.*?\*/", re.S), "rb": re.compile(r"#[^\n{]*")}
_RULES = {
    "js": {"functions": r"\bfunction\s*\*?\s+([\w$]+)|(?:const|let|var)\s+([\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=\n]+)?=>|^[ \t]+(?:async\s+|static\s+|get\s+|set\s+|public\s+|private\s+|protected\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b)([\w$]+)\s*\([^()\n]*\)\s*(?::[^{\n]+)?\{",
           "classes": r"\bclass\s+([\w$]+)|\binterface\s+([\w$]+)", "imports": r"^\s*(import\b[^;\n]*)"},
    "go": {"functions": r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "classes": r"^type\s+(\w+)\s+(?:struct|interface)", "imports": r"^\s*import\s+(\"[^\"]+\")|^\s+(\"[\w./-]+\")\s*$"},
    "rs": {"functions": r"\bfn\s+(\w+)", "classes": r"\b(?:struct|enum|trait)\s+(\w+)", "imports": r"^\s*(use\s[^;]+)"},
    "java": {"functions": r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)+(?:<[^>]+>\s*)?[\w<>\[\], .?]+?\s+(\w+)\s*\(", "classes": r"\b(?:class|interface|enum|record)\s+(\w+)", "imports": r"^\s*(import\s[^;]+)"},
    "rb": {"functions": r"^\s*def\s+(?:self\.)?([\w?!=]+)", "classes": r"^\s*(?:class|module)\s+(\w+)", "imports": r"^\s*(require(?:_relative)?\b[^\n]*)"},
}
_RULES["ts"] = _RULES["js"]
_COMPILED = {x: {k: re.compile(p, re.M) for k, p in r.items()} for x, r in _RULES.items()}
PARSED = {"py": "py", "js": "js", "mjs": "js", "cjs": "js", "ts": "ts", "tsx": "ts", "go": "go", "rs": "rs", "java": "java", "rb": "rb"}


def parse(ext: str, text: str | None) -> dict:
    """Structure of one file; ``ext`` without its dot."""
    lang = PARSED.get(ext or "")
    if not text or lang is None:
        return dict(EMPTY)
    if lang == "py":
        return parse_python(text)
    clean = _NOISE["rb" if lang == "rb" else "c"].sub("", text)
    out = {"exports": [], "calls": {}}
    for field, rule in _COMPILED[lang].items():
        out[field] = [next(g for g in m.groups() if g).strip() for m in rule.finditer(clean)]
    return out


def parse_files(files: DataFrame, keep: list[str], text: str = "content") -> DataFrame:
    """(keep..., functions, classes, imports, exports, calls) of every file, by the extension of its path."""
    types = dict(files.dtypes)
    src = files.select(*keep, F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("_ext"), F.col(text).alias("_text"))

    def run(batches):
        for b in batches:
            got = [parse(e, t) for e, t in zip(b["_ext"], b["_text"])]
            yield pd.DataFrame({**{k: b[k] for k in keep}, **{f: [g[f] for g in got] for f in ("functions", "classes", "imports", "exports", "calls")}})

    return src.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", " + FIELDS)


def definitions(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., kind, symbol), one row per defined function and class."""
    f = F.transform("functions", lambda s: F.struct(F.lit("function").alias("kind"), s.alias("symbol")))
    c = F.transform("classes", lambda s: F.struct(F.lit("class").alias("kind"), s.alias("symbol")))
    return parsed.select(*keep, F.explode(F.concat(f, c)).alias("d")).select(*keep, "d.kind", "d.symbol")


def call_pairs(parsed: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct (scope, caller, callee), by bare name across files."""
    return parsed.select(*scope, F.explode("calls").alias("caller", "to")).select(*scope, "caller", F.explode("to").alias("callee")).distinct()


_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension)
_OTHER_BRANCH = re.compile(r"\b(?:if|for|while|case|catch|elsif|when|rescue|unless)\b|&&|\|\||\?(?![.?:])")


def cyclomatic(ext: str, text: str | None) -> int:
    """Sum over functions of one plus their branches: exact for Python, by keywords for other languages, 0 if unparsed."""
    if not text:
        return 0
    if PARSED.get(ext or "") == "py":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text.lstrip("\ufeff"))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return 0
        n = sum(isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) for x in ast.walk(tree))
        inside = [x for f in ast.walk(tree) if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) for x in f.body]
        seen = {id(y): y for x in inside for y in ast.walk(x)}
        return n + sum(isinstance(y, _BRANCH) for y in seen.values()) + sum(len(y.values) - 1 for y in seen.values() if isinstance(y, ast.BoolOp))
    got = parse(ext, text)
    return len(got["functions"]) + len(_OTHER_BRANCH.findall(text)) if got["functions"] else 0


def complexity(parsed: DataFrame, files: DataFrame, key: list[str], text: str = "content") -> DataFrame:
    """(key..., complexity): tokens + 10 per import + 5 per function + 3 per cyclomatic unit (the heat map's score)."""
    types = dict(files.dtypes)
    src = files.select(*key, F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("_ext"), F.col(text).alias("_text"))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({**{k: b[k] for k in key}, "cc": [cyclomatic(e, t) for e, t in zip(b["_ext"], b["_text"])]})

    cc = src.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in key) + ", cc long")
    return parsed.join(files.select(*key, "tokens"), key).join(cc, key).select(*key, (F.coalesce("tokens", F.lit(0)) + 10 * F.size("imports") + 5 * F.size("functions") + 3 * F.col("cc")).alias("complexity"))


def resolve_imports(parsed: DataFrame, known: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, path, position, target): each import's first candidate file that exists in its scope."""
    from codeloom.functions.text import js_candidates, js_import, python_candidates, python_import

    imports = parsed.select(*scope, "path", F.posexplode("imports").alias("position", "stmt"))
    script = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin("js", "mjs", "cjs", "ts", "tsx", "jsx")
    cand = F.when(script, js_candidates(F.col("path"), js_import(F.col("stmt")))).otherwise(python_candidates(F.col("path"), python_import(F.col("stmt"))))
    rows = imports.select(*scope, "path", "position", F.posexplode(cand).alias("k", "target"))
    return rows.join(known.select(*scope, F.col("path").alias("target")).distinct(), [*scope, "target"]).groupBy(*scope, "path", "position").agg(F.min_by("target", "k").alias("target"))


def import_links(resolved: DataFrame, nodes: DataFrame, scope: list[str]) -> DataFrame:
    """Resolved imports as (source, target, position) ids without self loops."""
    n = nodes.select(*scope, "id", "path")
    return (
        resolved.join(n.select(*scope, F.col("id").alias("source"), "path"), [*scope, "path"])
        .join(n.select(*scope, F.col("id").alias("target_id"), F.col("path").alias("target")), [*scope, "target"])
        .where("source <> target_id").select("source", F.col("target_id").alias("target"), "position")
    )
