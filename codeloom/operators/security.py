"""Findings of external analysers as one relation (schema.RELATIONS["security_findings"])."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.paths import is_audited
from codeloom.functions.scoring import severity
from codeloom.functions.text import unused_name
from codeloom.operators.batching import chunks

BANDIT = "results array<struct<filename:string,issue_severity:string,issue_text:string,line_number:int,code:string,test_id:string>>"
SEMGREP = "results array<struct<path:string,check_id:string,start:struct<line:int>,extra:struct<severity:string,message:string>>>"


def read_bandit(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Findings of a bandit report; absolute file names become relative where ``known`` (abs_path, path) has them."""
    r = spark.read.schema(BANDIT).json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.*")
    if known is not None:
        r = r.join(known.select(F.col("abs_path").alias("filename"), "path"), "filename", "left")
    else:
        r = r.withColumn("path", F.lit(None).cast("string"))
    return r.select(F.coalesce("path", "filename").alias("file"), severity(F.col("issue_severity")).alias("severity"), F.col("issue_text").alias("issue"), F.concat(F.lit("line "), F.col("line_number")).alias("code"), F.concat(F.lit("see rule "), F.col("test_id")).alias("fix"), F.lit("bandit").alias("tool"))


def read_semgrep(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """Findings of a semgrep report: first line of the message, at most 120 characters."""
    r = spark.read.schema(SEMGREP).json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.*")
    rel = F.regexp_replace("path", "^" + root.rstrip("/") + "/", "") if root else F.col("path")
    return r.select(rel.alias("file"), severity(F.col("extra.severity")).alias("severity"), F.substring(F.substring_index(F.col("extra.message"), "\n", 1), 1, 120).alias("issue"), F.concat(F.lit("line "), F.col("start.line")).alias("code"), F.concat(F.lit("See semgrep rule "), F.col("check_id")).alias("fix"), F.lit("semgrep").alias("tool"))


#: Files per audit prompt, and characters of each that a prompt shows.
AUDIT_BATCH, AUDIT_PREVIEW = 4, 3000


def audit_prompts(files: DataFrame, group: str = "repo") -> DataFrame:
    """(group, batch, files, prompt): the audited files in the order of their paths, a few to a prompt, each by its beginning."""
    part = F.concat(F.lit("### "), "path", F.lit("\n```\n"), F.substring("content", 1, AUDIT_PREVIEW), F.lit("\n```"))
    rows = chunks(files.where(is_audited(F.col("path"), F.col("content"))).select(group, "path", part.alias("part")), AUDIT_BATCH, [group], ["path"])
    one = rows.groupBy(group, F.col("chunk").alias("batch")).agg(F.sort_array(F.collect_list(F.struct("path", "part"))).alias("parts"))  # at most four each
    return one.select(group, "batch", F.size("parts").alias("files"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("prompt"))


def read_vulture(spark: SparkSession, path: str) -> DataFrame:
    """(symbol) that the text report of vulture calls unused; lines of other forms are skipped."""
    kind = F.col("value").rlike(r"unused (?:function|class|variable|import|attribute) '\w+'")
    return spark.read.text(path).where(kind).select(unused_name(F.col("value")).alias("symbol")).where("symbol is not null").distinct()


def live_by_vulture(definitions: DataFrame, unused: DataFrame) -> DataFrame:
    """(symbol) defined in Python files and not reported: an external opinion that a symbol is in use; empty if nothing was reported."""
    python = definitions.where(F.col("path").endswith(".py")).select("symbol").distinct()
    return python.join(unused.select("symbol"), "symbol", "left_anti")


def by_file(findings: DataFrame) -> DataFrame:
    """(file, tool, findings, worst, section), one Markdown section per file and tool."""
    rank = F.when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1)
    line = F.concat(F.lit("FILE: "), F.col("file"), F.lit("\nSEVERITY: "), F.col("severity"), F.lit("\nISSUE: "), F.col("issue"), F.lit("\nCODE: "), F.col("code"), F.lit("\nFIX: "), F.col("fix"))
    return findings.groupBy("file", "tool").agg(F.count("*").alias("findings"), F.max_by("severity", rank).alias("worst"), F.array_join(F.sort_array(F.collect_list(line)), "\n\n").alias("section"))


def sections(*parts: DataFrame) -> DataFrame:
    """Findings of several tools in the order given."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("section_no", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out
