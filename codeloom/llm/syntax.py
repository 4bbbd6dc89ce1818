"""Source files that do not parse in their language.

Every file is lexed to one-character tokens, bracket groups are reduced from the inside, and the remaining token strings
are recognised by generalised LL parsing with a graph-structured stack (``gll.py``, ``grammars.py``). The dialects of a
language (script and module, for instance) are alternatives of one grammar and run together on the shared stack; a
file is flagged when none of them accepts it. Files that the grammars reject are checked once more by an exact parser where one is at
hand (Python, JSON).

Defined cases
    * The language follows from the extension of the path; where the path has none, from ``ext``. Other files are no cases.
    * null and empty content is never a case; white space alone is a valid program, but no valid JSON.
    * A byte order mark and CRLF line ends are allowed. Very long texts and deep nesting are handled without recursion.
    * Repeated rows are judged each. Rates count every file of a supported language; null repositories form one group.
    * Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import spread

LANGUAGES = {"py": "Python", "js": "JavaScript", "ts": "TypeScript", "go": "Go", "java": "Java", "rb": "Ruby", "rs": "Rust", "json": "Json"}


@functools.lru_cache(maxsize=None)
def language(ext: str):
    from codeloom.llm import grammars

    return getattr(grammars, LANGUAGES[ext])()


def _exact(ext: str, text: str) -> bool:
    """Whether an exact parser accepts the text after all."""
    try:
        if ext == "py":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text.lstrip("﻿"), "module", "exec", dont_inherit=True)
        elif ext == "json":
            json.loads(text.lstrip("﻿"), parse_constant=lambda c: 1 / 0)
        else:
            return False
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError, ZeroDivisionError):
        return False


def parses(ext: str, text: str) -> bool:
    return language(ext).valid(text) or _exact(ext, text)


def extension(path: str = "path", ext: str = "ext") -> Column:
    """Lower-case extension without its dot: of the path, else of the ext column."""
    name = F.element_at(F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/"), -1)
    of_path = F.nullif(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1), F.lit(""))
    return F.lower(F.coalesce(of_path, F.nullif(F.regexp_replace(F.col(ext), "^\\.", ""), F.lit(""))))


def judge(df: DataFrame, id_col: str = "module_id", text_col: str = "content") -> DataFrame:
    """(id, repo, language, valid) of every file in a supported language."""
    kind = dict(df.dtypes)[id_col]
    src = (
        df.where(F.length(text_col) > 0)
        .select(F.col(id_col).cast("string").alias("id"), F.col("repo").cast("string"), extension().alias("language"), F.col(text_col).alias("t"))
        .where(F.col("language").isin(list(LANGUAGES)))
    )

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "repo": b["repo"], "language": b["language"], "valid": [parses(x, t) for x, t in zip(b["language"], b["t"])]})

    return spread(src).mapInPandas(run, "id string, repo string, language string, valid boolean").withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def invalid_rates(judged: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, rate)."""
    bad = (~F.col("valid")).cast("int")
    return judged.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum(bad).alias("invalid"), F.avg(bad).alias("rate"))
