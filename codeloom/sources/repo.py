"""Reading repository trees and artifacts, and writing results."""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import subprocess
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.functions import paths as P
from codeloom.functions.text import token_estimate


def gitignore_patterns(text: str) -> list[tuple[bool, str]]:
    """(negated, regular expression) of the lines of a root ``.gitignore``, matched against slash paths relative to the root."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negate, line = line.startswith("!"), line.removeprefix("!")
        only_dir, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.removeprefix("/")
        body = "".join("(?:.*/)?" if part == "**/" else ".*" if part == "**" else "[^/]*" if part == "*" else "[^/]" if part == "?" else re.escape(part) if not part.startswith("[") else part for part in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]*\]|[^*?\[]+|\[", line))
        out.append((negate, ("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if only_dir else "(?:/.*)?$")))
    return out


def ignored(path: F.Column, patterns: list[tuple[bool, str]]) -> F.Column:
    """The last matching pattern decides."""
    got = F.lit(False)
    for negate, rx in patterns:
        got = F.when(path.rlike(rx), F.lit(not negate)).otherwise(got)
    return got


def _walk(root: str, below: str = "", deep: bool = True):
    """(relative path, bytes) of every file below directories that are not pruned; names only, nothing is read. Without ``deep``: this folder's own."""
    for folder, dirs, names in os.walk(os.path.join(root, below)):
        dirs[:] = sorted(x for x in dirs if x not in P.IGNORE_DIRS and not x.startswith(".")) if deep else []
        for n in sorted(names):
            full = os.path.join(folder, n)
            if os.path.isfile(full):
                yield os.path.relpath(full, root).replace(os.sep, "/"), os.path.getsize(full)


def _branches(root: str, levels: int = 2) -> list[tuple[str, bool]]:
    """(folder, whether with all below it) that together hold the tree: the folders of the first levels, of which the last are walked by workers."""
    out, level = [], [""]
    for k in range(levels + 1):
        out += [(f, k == levels) for f in level]
        if k < levels:
            level = [os.path.join(f, x.name) for f in level for x in sorted(os.scandir(os.path.join(root, f)), key=lambda x: x.name) if x.is_dir(follow_symlinks=False) and x.name not in P.IGNORE_DIRS and not x.name.startswith(".")]
    return out


def scan(spark: SparkSession, root: str, gitignore: str | None = None, max_tokens: int = P.MAX_FILE_TOKENS, partitions: int = 64) -> DataFrame:
    """Files of a tree as the relation ``files``; path rules and the size cap apply before anything is read.

    Of a local or mounted tree the driver lists the folders of the first two levels; workers walk what is below and read the files
    (Spark's own file index hides names starting with ``_`` or ``.``, such as ``__init__.py``). Any other file system is read with the
    binary file source.
    """
    base = str(root).rstrip("/")
    if re.match(r"^(?!file:)[a-z][a-z0-9+.-]*:/", base):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).withColumn("path", F.regexp_replace("path", "^" + re.escape(base) + "/", "")).select("path", "length", "content")
    else:
        base = re.sub(r"^file:/+", "/", base)

        def names(batches):
            for b in batches:
                for f, deep in zip(b["folder"], b["deep"]):
                    yield pd.DataFrame(list(_walk(base, f, deep)), columns=["path", "length"])

        raw = spark.createDataFrame(_branches(base), "folder string, deep boolean").repartition(partitions).mapInPandas(names, "path string, length long")
    files = raw.where((F.col("length") <= P.MAX_FILE_SIZE_BYTES) & ~P.ignored_dir(F.col("path")) & ~P.suffix(F.col("path")).isin(P.IGNORE_EXTENSIONS))
    if gitignore:
        files = files.where(~ignored(F.col("path"), gitignore_patterns(gitignore)))
    if "content" not in files.columns:

        def read(batches):
            for b in batches:
                yield pd.DataFrame({"path": b["path"], "content": [Path(base, p).read_bytes().decode("utf-8", "ignore") for p in b["path"]]})

        files = files.select("path").mapInPandas(read, "path string, content string")
    else:
        files = files.select("path", F.decode("content", "UTF-8").alias("content"))
    text = files.select("path", F.concat(F.lit(base + "/"), "path").alias("abs_path"), P.suffix(F.col("path")).alias("ext"), "content")
    return text.withColumn("tokens", token_estimate(F.col("content"))).where(F.col("tokens") <= max_tokens).withColumn("content_hash", F.sha2("content", 256))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a graph document."""
    doc = spark.read.schema(S.schema("graph")).json(path, multiLine=True)
    return doc.select(F.explode("nodes").alias("n")).select("n.*"), doc.select(F.explode("links").alias("l")).select("l.*")


def read_context_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.schema("context_index")).json(path, multiLine=True).select(F.explode("files").alias("f")).select("f.*")


def read_embed_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an embedding index document."""
    return spark.read.schema(S.schema("embed_index")).json(path, multiLine=True)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.schema("snapshot")).json(path, multiLine=True)


@contextlib.contextmanager
def cloned(url: str, timeout: int = 120, parent: str | None = None):
    """The folder of a shallow clone (or of a local folder itself, which is left alone); a clone is removed on exit.

    ``parent`` should be a shared folder where the workers are other machines. Raises ``ValueError`` if the clone fails or takes too long.
    """
    if os.path.isdir(url) and not os.path.isdir(os.path.join(url, "objects")):
        yield url
        return
    folder = tempfile.mkdtemp(prefix="codeloom-clone-", dir=parent)
    try:
        try:
            subprocess.run(["git", "clone", "--depth", "1", "--quiet", "--", url, folder], capture_output=True, text=True, timeout=timeout, check=True, env={**os.environ, "GIT_TERMINAL_PROMPT": "0"})
        except (OSError, subprocess.SubprocessError) as e:
            raise ValueError(f"cannot clone: {type(e).__name__}") from None  # the message may hold a token
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def changed_files(spark: SparkSession, repo: str, base: str = "main", timeout: int = 15) -> DataFrame:
    """Paths that differ from a base revision; empty on any error."""
    try:
        got = subprocess.run(["git", "-C", repo, "diff", "--name-only", base, "HEAD"], capture_output=True, text=True, timeout=timeout, check=True).stdout.split("\n")
    except (OSError, subprocess.SubprocessError):
        got = []
    return spark.createDataFrame([(p,) for p in got if p], "path string")


def write_text(row_text: str, path: str) -> str:
    """One rendered document on the driver's file system (Markdown, JSON or HTML)."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(row_text, encoding="utf-8")
    return path


def fill_template(template: str, nodes: DataFrame, links: DataFrame) -> str:
    """An HTML graph page: the placeholders ``__NODES__`` and ``__LINKS__`` get JSON arrays. For one repository's graph."""
    def js(df):
        return df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("j")).first()["j"]

    return template.replace("__NODES__", js(nodes)).replace("__LINKS__", js(links))


def clone_with(files: DataFrame, changed: DataFrame, scope: list[str] = []) -> DataFrame:
    """The file tree with changed contents put in place: (scope, path, content); a path counts within its scope (repository)."""
    key = [*scope, "path"]
    return files.join(changed.select(*key, F.col("content").alias("new")), key, "left").select(*key, F.coalesce("new", "content").alias("content"))


def write_tree(files: DataFrame, root: str, hidden: list[str] = P.IGNORE_DIRS) -> DataFrame:
    """Write (path, content) rows as files below ``root``, a shared folder, from the executors: (path, bytes) of what was written.

    Paths that would leave the root are refused; directories that the scan prunes are not written.
    """
    kept = files.where(~P.ignored_dir(F.col("path")) & ~F.col("path").rlike(r"(^|/)\.\.(/|$)|^/")).select("path", F.coalesce("content", F.lit("")).alias("content"))

    def put(batches):
        for b in batches:
            sizes = []
            for p, t in zip(b["path"], b["content"]):
                to = Path(root, p)
                to.parent.mkdir(parents=True, exist_ok=True)
                sizes.append(to.write_bytes(t.encode("utf-8", "replace")))
            yield pd.DataFrame({"path": b["path"], "bytes": sizes})

    return kept.mapInPandas(put, "path string, bytes long")


def snapshot_of(files: DataFrame, links: DataFrame, now: F.Column, group: str = "repo") -> DataFrame:
    """One snapshot row per group: sorted distinct files and link pairs with a UTC time stamp."""
    f = files.groupBy(group).agg(F.sort_array(F.collect_set("path")).alias("files"))
    l = links.groupBy(group).agg(F.sort_array(F.collect_set(F.array("source_path", "target_path"))).alias("links"))
    return f.join(l, group, "left").select(group, F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "files", F.coalesce("links", F.array().cast("array<array<string>>")).alias("links"))


def visible(names: DataFrame, hidden: list[str]) -> DataFrame:
    return names.where(~F.col("name").isin(hidden))


