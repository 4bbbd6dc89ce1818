"""Steps around an injected language model: per-file analysis, synthesis, refactoring, test scaffolds.

The model is a plain function ``text -> text`` that workers import (``Model``); the default is a deterministic stub, so all
flows run offline. Calls run in ``mapInPandas``; every call returns its result or its error class in a column, failures are counted and
only a run in which all calls fail raises. Concurrency is the number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import scoring as S
from codeloom.functions.paths import suffix
from codeloom.functions.text import marked_blocks, strip_fences, strip_think
from codeloom.operators.batching import chunks, greedy_batches

Model = Callable[[str], str]
#: Quality below this is asked once more; batch sizes; length and coverage thresholds.
ASK_AGAIN_BELOW = 0.35
SYNTHESIS_BATCH = 10
KEPT_LENGTH = 0.40
DOCUMENTED = 0.70


def stub(prompt: str) -> str:
    """Purpose line with the first words of the prompt; no network, no randomness."""
    return "Purpose: this file handles " + " ".join(prompt.split()[:40]) + ". It has functions and returns values."


def error_class(e: Exception) -> str:
    """rate_limit (next model), transient (retry), missing (skip) or fatal."""
    text = f"{type(e).__name__} {e}".lower()
    if "429" in text or "rate limit" in text or "ratelimit" in text or "quota" in text:
        return "rate_limit"
    if any(w in text for w in ("timeout", "timed out", "connection", "503", "502", "500", "overloaded", "unavailable")):
        return "transient"
    return "missing" if "404" in text or "not found" in text else "fatal"


def call(df: DataFrame, model: Model, keep: list[str], prompt: str = "prompt", retries: int = 2) -> DataFrame:
    """(keep..., answer, error, tries): the cleaned answer to each prompt; transient errors are tried again."""
    types = dict(df.dtypes)

    def run(batches):
        for b in batches:
            out = []
            for p in b[prompt]:
                answer, error, tries = None, None, 0
                while tries <= retries:
                    tries += 1
                    try:
                        answer, error = model(p or ""), None
                        break
                    except Exception as e:  # the model is foreign code
                        error = error_class(e)
                        if error != "transient":
                            break
                out.append((answer, error, tries))
            yield pd.DataFrame({**{k: b[k] for k in keep}, "answer": [o[0] for o in out], "error": [o[1] for o in out], "tries": [o[2] for o in out]})

    got = df.select(*dict.fromkeys([*keep, prompt])).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", answer string, error string, tries int")
    return got.withColumn("answer", strip_think(F.col("answer")))


def outcome(answered: DataFrame) -> DataFrame:
    """(calls, failures, all_failed)."""
    bad = F.count_if(F.col("error").isNotNull())
    return answered.agg(F.count("*").alias("calls"), bad.alias("failures"), ((bad == F.count("*")) & (F.count("*") > 0)).alias("all_failed"))


def analyse(files: DataFrame, cached: DataFrame, model: Model = stub, key: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """(key..., analysis, from_cache, quality): cached analyses by content hash, the rest by the model, poor ones asked once more.

    ``files`` has the key, content_hash, prompt, functions, classes, tokens; ``cached`` has content_hash, analysis.
    """
    c = cached.where("analysis <> '' and content_hash is not null").groupBy("content_hash").agg(F.max("analysis").alias("cached"))
    f = files.join(c, "content_hash", "left")
    keep = [*key, "functions", "classes", "tokens"]
    hits = f.where("cached is not null").select(*keep, F.col("cached").alias("analysis"), F.lit(True).alias("from_cache"))
    first = call(f.where("cached is null"), model, [*keep, "prompt"]).withColumn("q", S.answer_quality(F.col("answer"), F.col("functions"), F.col("classes"), F.col("tokens")))
    poor = first.where(F.col("q") < ASK_AGAIN_BELOW)
    again = call(poor.select(*keep, F.col("answer").alias("before"), "prompt"), model, [*keep, "before"]).select(*keep, F.coalesce("answer", "before").alias("analysis"))
    new = first.where(~(F.col("q") < ASK_AGAIN_BELOW)).select(*keep, F.col("answer").alias("analysis")).unionByName(again).withColumn("from_cache", F.lit(False))
    return hits.unionByName(new).select(*key, "analysis", "from_cache", S.answer_quality(F.col("analysis"), F.col("functions"), F.col("classes"), F.col("tokens")).alias("quality"))


def synthesis(reports: DataFrame, model: Model = stub, group: str = "repo", path: str = "path") -> DataFrame:
    """(group, batches, answer): groups of up to ten reports in one call, larger ones by summaries of ten each."""
    part = F.concat(F.lit("File: "), F.col(path), F.lit("\n"), F.col("analysis"))
    batches = chunks(reports, SYNTHESIS_BATCH, [group], [path]).groupBy(group, "chunk").agg(F.count("*").alias("files"), F.array_join(F.sort_array(F.collect_list(part)), "\n\n---\n\n").alias("prompt"))
    sizes = batches.groupBy(group).agg(F.count("*").alias("batches"))
    large = batches.join(sizes.where("batches > 1"), group)
    summed = call(large, model, [group, "chunk", "files"]).select(group, "chunk", F.concat(F.lit("### Batch "), F.col("chunk") + 1, F.lit(" ("), F.col("files"), F.lit(" files)\n"), F.coalesce("answer", F.lit(""))).alias("prompt"))
    rest = batches.join(sizes.where("batches = 1"), group).select(group, "chunk", "prompt")
    final = summed.unionByName(rest).groupBy(group).agg(F.count("*").alias("batches"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "prompt"))), lambda s: s["prompt"]), "\n\n").alias("prompt"))
    return call(final, model, [group, "batches"]).select(group, "batches", "answer")


def well_documented(ext: Column, content: Column, functions: Column) -> Column:
    """Python files with a module docstring and docstrings in at least 70 % of their functions."""
    has_doc = F.ltrim(content).rlike(r"\A\s*(\"\"\"|''')")
    with_doc = F.regexp_extract_all(content, F.lit(r"(?s)def\s+(\w+)\s*\([^)]*\)[^:\n]*:\s*\n\s*(?:\"\"\"|''')"), F.lit(1))
    share = F.size(F.filter(functions, lambda f: F.array_contains(with_doc, f))) / F.greatest(F.size(functions), F.lit(1))
    return (ext == ".py") & has_doc & ((F.size(functions) == 0) | (share >= DOCUMENTED))


def accept(old: Column, new: Column) -> Column:
    """A rewritten text is kept if it is not blank and at least 40 % as long as the old one."""
    return F.coalesce((F.length(F.trim(new)) > 0) & (F.length(new) >= KEPT_LENGTH * F.length(old)), F.lit(False))


def refactor(files: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """(keep..., content, changed): each file's rewritten content where it is acceptable, else its old one."""
    got = call(files.withColumn("prompt", F.concat(F.lit("Improve this file:\n"), F.col("content"))), model, [*keep, "content"])
    new = strip_fences(F.col("answer"))
    ok = accept(F.col("content"), new)
    return got.select(*keep, F.when(ok, new).otherwise(F.col("content")).alias("content"), ok.alias("changed"))


def refactor_ways(files: DataFrame, batch_tokens: int = 2000) -> DataFrame:
    """Files (path, content, functions, tokens) with the way to rewrite each: only its ``header`` (well documented), in a ``batch``, or ``alone`` (too large for one)."""
    good = well_documented(suffix(F.col("path")), F.col("content"), F.col("functions"))
    return files.withColumn("way", F.when(good, "header").when(F.col("tokens") <= batch_tokens, "batch").otherwise("alone"))


def batch_prompts(files: DataFrame, group: list[str], batch_tokens: int = 2000) -> DataFrame:
    """(group, batch, prompt): up to six small files a prompt, each between markers."""
    part = F.concat(F.lit("[FILE: "), F.col("path"), F.lit("]\n"), F.col("content"), F.lit("\n[END]"))
    rows = greedy_batches(files.select(*group, "path", "tokens", part.alias("part")), batch_tokens, group, ["path"])
    one = rows.groupBy(*group, "batch").agg(F.sort_array(F.collect_list(F.struct("path", "part"))).alias("parts"))  # at most six
    return one.select(*group, "batch", F.concat(F.lit("Improve these files:\n"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n")).alias("prompt"))


def refactor_fast(files: DataFrame, model: Model, group: list[str], batch_tokens: int = 2000) -> DataFrame:
    """(group, path, content, changed, way): rewriting with few calls; what a batch's answer lacks or spoils stays as it was."""
    f = refactor_ways(files, batch_tokens)
    key = [*group, "path"]
    ask = F.when(F.col("way") == "header", F.lit("Update only the header of this file:\n")).otherwise(F.lit("Improve this file:\n"))
    single = call(f.where("way <> 'batch'").withColumn("prompt", F.concat(ask, "content")), model, key).select(*key, strip_fences(F.col("answer")).alias("new"))
    answers = call(batch_prompts(f.where("way = 'batch'"), group, batch_tokens), model, [*group, "batch"])
    blocks = answers.select(*group, F.explode(marked_blocks(F.col("answer"))).alias("b")).select(*group, F.col("b.name").alias("path"), strip_fences(F.col("b.body")).alias("new"))
    new = single.unionByName(blocks).groupBy(*key).agg(F.max("new").alias("new"))
    ok = accept(F.col("content"), F.col("new"))
    return f.join(new, key, "left").select(*key, F.when(ok, F.col("new")).otherwise(F.col("content")).alias("content"), ok.alias("changed"), "way")


def scaffold_prompts(gaps: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """(key..., prompt): one prompt per existing file with untested functions."""
    per = gaps.where("status = 'gap'").groupBy(*key).agg(F.sort_array(F.collect_list("fn")).alias("fns"))
    return per.join(files.select(*key, "content"), key).select(*key, F.concat(F.lit("Source file: "), F.col("path"), F.lit("\nImport path: "), F.regexp_replace(F.replace("path", F.lit("/"), F.lit(".")), r"\.py$", ""), F.lit("\nUntested: "), F.array_join("fns", ", "), F.lit("\n\n"), F.substring("content", 1, 2000)).alias("prompt"))


def scaffold_name(path: Column) -> Column:
    """Files of the same stem share a name; the last one in path order wins (see ``last_per_name``)."""
    return F.concat(F.lit("tests_generated/test_"), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.\w+$", ""), F.lit(".py"))


def last_per_name(scaffolds: DataFrame, group: list[str]) -> DataFrame:
    s = scaffolds.withColumn("name", scaffold_name(F.col("path")))
    return s.groupBy(*group, "name").agg(F.max_by("answer", "path").alias("content"))


def executive(files: DataFrame, links: DataFrame, group: str = "repo") -> DataFrame:
    """(group, files, tokens, edges, size_class, prompt) of the summary for managers."""
    f = files.groupBy(group).agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"))
    e = links.groupBy(group).agg(F.count("*").alias("edges"))
    r = f.join(e, group, "left").na.fill(0, ["edges"]).withColumn("size_class", S.size_class(F.col("tokens")))
    return r.withColumn("prompt", F.format_string("%s: %d files, %d tokens, %d import edges (%s)", group, "files", "tokens", "edges", "size_class"))


def safe_budget(model: Column, limits: list[tuple[str, int]], default: int = 5000) -> Column:
    """Tokens per minute of the first limit whose name the model contains."""
    out = F.lit(default)
    for name, n in reversed(limits):
        out = F.when(F.contains(model, F.lit(name)), n).otherwise(out)
    return out


# Which role or pool of models each step asks, and the longest answer it takes.
ROUTES = {"analysis": ("file", 1024), "synthesis": ("heavy", 4096), "security": ("traversal", 1024), "impact": ("report", 1024), "scaffold": ("traversal", 1024), "refactor": ("refactor", 8192)}


def route(step: str) -> tuple[str, int]:
    """(role or pool, most tokens of an answer) of a step."""
    if step not in ROUTES:
        raise ValueError(f"unknown step: {step}")
    return ROUTES[step]


def key_for(provider: str, keys: dict[str, str]) -> str:
    """The key of a provider; a missing one is an error that names the variable to set."""
    if not keys.get(provider):
        raise ValueError(f"no key for provider {provider!r}: set {provider.upper()}_API_KEY")
    return keys[provider]


def gather(steps: dict[str, Callable | None], at_once: int = 4) -> dict[str, object]:
    """Run independent steps side by side; each gives its result, its exception, or None if it is switched off (None)."""
    def run(f):
        try:
            return f() if f else None
        except Exception as e:  # one step's failure leaves the others alone
            return e

    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(steps, pool.map(run, steps.values())))


def model_for(role: str, provider: str, cheap: dict, premium: dict, allow_premium: bool = False, override: str | None = None) -> tuple[str, str]:
    """(provider, model) of a role; per-file roles are always cheap, an override wins."""
    if role not in ("traversal", "report", "refactor"):
        raise ValueError(f"unknown role: {role}")
    if override:
        return provider, override
    return provider, (premium if role == "report" and allow_premium else cheap)[provider][role]
