"""Rendering results as Markdown rows and prompts; pure string expressions, one row per section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.batching import ordered_ranks


def bullet_section(df: DataFrame, title: F.Column, item: F.Column, group: list[str]) -> DataFrame:
    """(group, line_no, line): a Markdown section per group as rows, a heading at 0 and the bullets in their order from 2.

    Rows and not one text: a section may be larger than a task. Ranks come from ``ordered_ranks``, in two levels.
    """
    head = df.select(*group, title.alias("title")).distinct().select(*group, F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("## "), "title").alias("line"))
    rows = ordered_ranks(df.select(*group, item.alias("item")), group, "item")
    return head.unionByName(rows.select(*group, (F.col("rank") + 1).alias("line_no"), F.concat(F.lit("- "), "item").alias("line")))


def dead_code_report(dead: DataFrame, group: str = "repo") -> DataFrame:
    return bullet_section(dead, F.concat(F.lit("Dead symbols in "), F.col(group)), F.concat(F.lit("`"), F.col("symbol"), F.lit("` in "), F.col("path")), [group])


def gap_report(status: DataFrame, group: str = "repo") -> DataFrame:
    return bullet_section(status.where("status = 'gap'"), F.concat(F.lit("Untested in "), F.col(group)), F.concat(F.col("path"), F.lit(": `"), F.col("fn"), F.lit("`")), [group])


def impact_report(changed: DataFrame, affected: DataFrame, group: str = "repo") -> DataFrame:
    """(group, section, line_no, line): the report of a change set as rows: head, changed files, files downstream."""
    n = changed.groupBy(group).agg(F.count("*").alias("changed")).join(affected.groupBy(group).agg(F.count("*").alias("affected")), group, "left").na.fill(0)
    head = n.select(group, F.lit(0).alias("section"), F.posexplode(F.array(
        F.lit("# PR Impact Analysis"), F.concat(F.lit("**Changed files:** "), F.col("changed").cast("string")), F.concat(F.lit("**Downstream files affected:** "), F.col("affected").cast("string")))).alias("line_no", "line"))
    none = n.where("affected = 0").select(group, F.lit(2).alias("section"), F.lit(1).alias("line_no"), F.lit("_No downstream dependents — isolated change._").alias("line"))
    titles = n.select(group, F.posexplode(F.array(F.lit(None), F.lit("## Changed Files"), F.lit("## Downstream Impact"))).alias("section", "line")).where("line is not null").select(group, "section", F.lit(0).alias("line_no"), "line")
    out = head.unionByName(titles).unionByName(none)
    for section, rows in ((1, changed), (2, affected)):
        ranked = ordered_ranks(rows.select(group, "path").distinct(), [group], "path")
        out = out.unionByName(ranked.select(group, F.lit(section).alias("section"), F.col("rank").cast("int").alias("line_no"), F.concat(F.lit("- `"), "path", F.lit("`")).alias("line")))
    return out


def analysis_prompt(path: F.Column, tokens: F.Column, functions: F.Column, classes: F.Column, imports: F.Column, content: F.Column) -> F.Column:
    """Prompt of a file's analysis: header, the first names of each kind, and the whole body without outer white space."""

    def head(names, n):
        return F.when(F.size(names) > 0, F.array_join(F.slice(names, 1, n), ", ")).otherwise(F.lit("none"))

    body = F.regexp_replace(F.coalesce(content, F.lit("")), r"\A\s+|\s+\z", "")
    return F.concat(F.lit("### "), path, F.lit(" ("), F.coalesce(tokens, F.lit(0)).cast("string"), F.lit(" tokens)\nfn: "), head(functions, 6), F.lit(" | cls: "), head(classes, 4), F.lit(" | imports: "), head(imports, 5), F.lit("\n```\n"), body, F.lit("\n```"))


def combined_map(files: DataFrame, group: str = "repo") -> DataFrame:
    """(group, path, json): the map of a group as JSON lines, one per file, so that no group has to fit into a task."""
    return files.select(group, "path", F.to_json(F.struct("path", "tokens")).alias("json"))
