"""Query of the snapshot-difference operator."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom.operators import snapshot_store
from codeloom.operators.snapshot_diff import chain_order, snapshot_changes
from codeloom.session import ensure_checkpoint_dir, shuffle_partitions, table


def p1_found(spark, sf_dir):
    return snapshot_changes(table(spark, sf_dir, "snapshots"))


def p1_merged(spark, sf_dir):
    """The same changes from a store that is kept sorted: the history is delivered in four parts, each merged into it."""
    s = table(spark, sf_dir, "snapshots")
    at = chain_order(s).select("snapshot_id", F.timestamp_micros("at").alias("instant"))
    parts = s.join(at, "snapshot_id")
    store = f"{ensure_checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    snapshot_store.create(spark, store, s, 2 * shuffle_partitions(spark))
    out = None
    for lo, hi in (("0001-01-01", "2025-04-01"), ("2025-04-01", "2025-07-01"), ("2025-07-01", "2025-10-01"), ("2025-10-01", "9999-01-01")):
        got = snapshot_store.merge(spark, store, parts.where((F.col("instant") >= F.lit(lo).cast("timestamp")) & (F.col("instant") < F.lit(hi).cast("timestamp"))).drop("instant"))
        out = got if out is None else out.unionByName(got)
    snapshot_store.drop(spark, store)  # the changes are kept by themselves
    return out


QUERIES = {"p1_found": p1_found, "p1_merged": p1_merged}

_PATH = "regexp_replace(replace({0}, '\\', '/'), '^\\./', '')"

ORACLES = {
    "p1_found": f"""
WITH valid AS (
  SELECT *, CAST(replace("timestamp", ' ', 'T') AS TIMESTAMPTZ) AS inst
  FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY delivered_at DESC) AS rn FROM snapshots)
  WHERE rn = 1 AND files IS NOT NULL),
chain AS (
  SELECT *, row_number() OVER (PARTITION BY repo, branch ORDER BY inst, snapshot_id) AS seq FROM valid),
file_rows AS (
  SELECT repo, branch, seq, 'file' AS record_kind, {_PATH.format("f.p")} AS record_key, max(lower(f.h)) AS hash
  FROM (SELECT repo, branch, seq, unnest(files) AS p,
          unnest(coalesce(hashes, list_transform(files, lambda x: CAST(NULL AS VARCHAR)))) AS h FROM chain) f
  WHERE f.p IS NOT NULL GROUP BY ALL),
link_rows AS (
  SELECT DISTINCT repo, branch, seq, 'link' AS record_kind,
    {_PATH.format("l[1]")} || ' -> ' || {_PATH.format("l[2]")} AS record_key, CAST(NULL AS VARCHAR) AS hash
  FROM (SELECT repo, branch, seq, unnest(links) AS l FROM chain) WHERE len(l) >= 2 AND l[1] IS NOT NULL AND l[2] IS NOT NULL),
recs AS (SELECT * FROM file_rows UNION ALL SELECT * FROM link_rows),
old AS (SELECT repo, branch, seq + 1 AS seq, record_kind, record_key, hash AS old_hash, 1 AS was FROM recs),
merged AS (
  SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.branch, o.branch) AS branch, coalesce(n.seq, o.seq) AS seq,
    coalesce(n.record_kind, o.record_kind) AS record_kind, coalesce(n.record_key, o.record_key) AS record_key,
    CASE WHEN o.was IS NULL THEN 'added' WHEN n.seq IS NULL THEN 'removed'
         WHEN n.record_kind = 'file' AND n.hash <> o.old_hash THEN 'changed' END AS change_kind
  FROM recs n FULL JOIN old o ON n.repo = o.repo AND n.branch = o.branch AND n.seq = o.seq
    AND n.record_kind = o.record_kind AND n.record_key = o.record_key)
SELECT c.snapshot_id, m.record_kind, m.record_key, m.change_kind
FROM merged m JOIN chain c ON c.repo = m.repo AND c.branch = m.branch AND c.seq = m.seq
WHERE m.change_kind IS NOT NULL AND m.seq > 1
""",
}
ORACLES["p1_merged"] = ORACLES["p1_found"]
