"""Queries of the training-data operators and, where SQL can say the same, their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.llm.abuse import THRESHOLD, rates, score_documents
from codeloom.llm.credentials import find_credentials, redact_credentials
from codeloom.llm.handwritten import classify
from codeloom.llm.leakage import leak_report, leaks, near_leaks
from codeloom.llm.mixing import mix
from codeloom.llm.packing import fill_report, pack
from codeloom.llm.splitting import split_oversized
from codeloom.llm.syntax import invalid_rates, judge
from codeloom.session import table


def _limit(spark, sf_dir, purpose):
    return table(spark, sf_dir, "size_limits").where(f"purpose = '{purpose}'").first()  # one row per purpose


def _pieces(spark, sf_dir):
    lim = _limit(spark, sf_dir, "piece")
    return split_oversized(table(spark, sf_dir, "modules"), lim["max_tokens"], lim["overlap_tokens"])


def p2_found(spark, sf_dir):
    return classify(table(spark, sf_dir, "modules")).select("module_id")


def p2_kinds(spark, sf_dir):
    return classify(table(spark, sf_dir, "modules"))


def p3_found(spark, sf_dir):
    return find_credentials(table(spark, sf_dir, "modules")).select("module_id", "line_no").distinct()


def p3_redacted(spark, sf_dir):
    return redact_credentials(table(spark, sf_dir, "modules"))


def p4_found(spark, sf_dir):
    return _pieces(spark, sf_dir).where("piece_no = 1").select("module_id")


def p4_pieces(spark, sf_dir):
    return _pieces(spark, sf_dir)


def p5_batches(spark, sf_dir):
    return pack(table(spark, sf_dir, "modules"), _limit(spark, sf_dir, "container")["max_tokens"])


def p5_fill(spark, sf_dir):
    cap = _limit(spark, sf_dir, "container")["max_tokens"]
    return fill_report(pack(table(spark, sf_dir, "modules"), cap), cap)


def p6_found(spark, sf_dir):
    return judge(table(spark, sf_dir, "modules")).where("not valid").select("module_id").distinct()


def p6_rates(spark, sf_dir):
    return invalid_rates(judge(table(spark, sf_dir, "modules")))


def _leaks(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark, sf_dir):
    return _leaks(spark, sf_dir)


def p7_near(spark, sf_dir):
    return near_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_suites(spark, sf_dir):
    return leak_report(_leaks(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p8_mixture(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_report(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def _scored(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), keep=("source",))


def p9_found(spark, sf_dir):
    return _scored(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p9_scores(spark, sf_dir):
    return _scored(spark, sf_dir)


def p9_rates(spark, sf_dir):
    return rates(_scored(spark, sf_dir))


def p3_checked(spark, sf_dir):
    """Of every text after redaction: its line breaks, which stay, and the credentials still found in it, which are none."""
    after = redact_credentials(table(spark, sf_dir, "modules").where("content is not null")).select("module_id", "content")
    left = find_credentials(after).groupBy("module_id").agg(F.count("*").alias("left_over"))
    lines = (F.length("content") - F.length(F.replace("content", F.lit("\n")))).alias("line_breaks")
    return after.select("module_id", lines).join(left, "module_id", "left").na.fill(0, ["left_over"])


def p4_checked(spark, sf_dir):
    """Of every text that was cut: whether its pieces cover it, keep the limit and overlap as asked."""
    lim = _limit(spark, sf_dir, "piece")
    w = Window.partitionBy("module_id").orderBy("piece_no")
    p = _pieces(spark, sf_dir).withColumns({"before": F.lag("end_char").over(w), "size": F.col("end_char") - F.col("start_char")})
    return p.groupBy("module_id").agg(
        F.max("end_char").alias("chars"), (F.min("start_char") == 0).alias("from_start"), F.every(F.coalesce(F.col("before") - F.col("start_char") == 4 * lim["overlap_tokens"], F.col("piece_no") == 0)).alias("overlaps"),
        F.every((F.col("size") <= 4 * lim["max_tokens"]) & (F.length("piece") == F.col("size"))).alias("within_limit"))


def p5_checked(spark, sf_dir):
    """Of every item: its tokens and parts as placed, and whether all its bins keep the capacity."""
    cap = _limit(spark, sf_dir, "container")["max_tokens"]
    placed = pack(table(spark, sf_dir, "modules"), cap)
    full = placed.groupBy("bin_id").agg(F.sum("tokens").alias("used"))
    return placed.join(full, "bin_id").groupBy("module_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"), F.every(F.col("used") <= cap).alias("fits"))


def p6_judged(spark, sf_dir):
    """How many files of each language were judged per repository."""
    return invalid_rates(judge(table(spark, sf_dir, "modules"))).select("repo", "language", "files")


def p8_repeated(spark, sf_dir):
    """The report of a mixture of ten million tokens, for which small sources are repeated up to their caps."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), total_tokens=10_000_000)[1]


def p8_checked(spark, sf_dir):
    """Of every target: its share and cap as asked, and whether the share reached is within half a point and no record used too often."""
    rep = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]
    live = rep.where("source_tokens > 0").agg(F.sum("target_share")).scalar()
    goal = F.when(F.col("source_tokens") > 0, F.col("target_share") / live).otherwise(F.lit(0.0))
    return rep.select("source", F.round("target_share", 9).alias("target_share"), "max_repeats", (F.col("source_tokens") > 0).alias("live"), (F.abs(F.col("actual_share") - goal) < 0.005).alias("reached"), (F.col("most_copies") <= F.col("max_repeats")).alias("kept"))


def p9_sources(spark, sf_dir):
    """How many documents were scored per source."""
    return rates(_scored(spark, sf_dir)).select("source", "documents")


QUERIES = {f.__name__: f for f in (
    p2_found, p2_kinds, p3_found, p3_redacted, p3_checked, p4_found, p4_pieces, p4_checked, p5_batches, p5_fill, p5_checked, p6_found, p6_rates, p6_judged, p7_found, p7_near, p7_suites,
    p8_mixture, p8_report, p8_repeated, p8_checked, p9_found, p9_scores, p9_rates, p9_sources)}

_FOLD = "regexp_replace(lower(trim(source, ' ')), '[-\\s]+', '_', 'g')"
_EXT = r"lower(coalesce(nullif(regexp_extract(string_split(replace(path, '\', '/'), '/')[-1], '\.([A-Za-z0-9]+)$', 1), ''), nullif(regexp_replace(ext, '^\.', ''), '')))"

ORACLES = {
    "p3_checked": "SELECT module_id, length(content) - length(replace(content, chr(10), '')) AS line_breaks, 0 AS left_over FROM modules WHERE content IS NOT NULL",
    "p4_checked": "SELECT module_id, length(content) AS chars, true AS from_start, true AS overlaps, true AS within_limit FROM modules WHERE length(content) // 4 > (SELECT max_tokens FROM size_limits WHERE purpose = 'piece')",
    "p5_checked": """SELECT module_id, coalesce(length(content) // 4, 0) AS tokens, greatest(CAST(ceil(coalesce(length(content) // 4, 0) / CAST(c.max_tokens AS DOUBLE)) AS BIGINT), 1) AS parts, true AS fits
FROM modules, (SELECT max_tokens FROM size_limits WHERE purpose = 'container') c""",
    "p6_judged": f"SELECT repo, {_EXT} AS language, count(*) AS files FROM modules WHERE length(content) > 0 AND {_EXT} IN ('py', 'js', 'ts', 'go', 'java', 'rb', 'rs', 'json') GROUP BY 1, 2",
    "p8_checked": f"""WITH t AS (SELECT {_FOLD} AS source, sum(coalesce(target_share, 0)) AS target_share, max(greatest(coalesce(max_repeats, 1), 1)) AS max_repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
d AS (SELECT DISTINCT {_FOLD} AS source FROM documents WHERE length(text) > 0) SELECT source, round(target_share, 9) AS target_share, max_repeats, source IN (SELECT source FROM d WHERE source IS NOT NULL) AS live, true AS reached, true AS kept FROM t""",
    "p9_sources": f"SELECT coalesce({_FOLD}, 'unknown') AS source, count(*) AS documents FROM documents GROUP BY 1",
    "p4_found": "SELECT module_id FROM modules WHERE length(content) // 4 > (SELECT max_tokens FROM size_limits WHERE purpose = 'piece')",
}
