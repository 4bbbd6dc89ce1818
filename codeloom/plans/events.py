"""Queries over the event stream table in batch form and their oracles.

The event log stands in for requests to rate-limited models: ``user_id`` is the model, ``value`` the tokens.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.operators import cache, limits
from codeloom.session import table


def _events(spark, d):
    return table(spark, d, "events").withColumn("n", F.floor("value").cast("long"))


def sliding_usage(spark, d):
    return limits.sliding_usage(_events(spark, d).select("event_id", "user_id", "ts", "n"), "user_id").select("event_id", "requests_60s", "amount_60s")


def sliding_usage_total(spark, d):
    """The same over event types, where windows hold many events."""
    return limits.sliding_usage(_events(spark, d).select("event_id", "event_type", F.timestamp_micros(F.floor(limits.micros("ts") / 100)).alias("ts"), "n"), "event_type").select("event_id", "requests_60s", "amount_60s")


def capacity_wait(spark, d):
    e = _events(spark, d).select("event_type", F.timestamp_micros(F.floor(limits.micros("ts") / 100)).alias("ts"), "n")
    now = F.floor(limits.micros(F.lit("2024-01-15 00:00:00").cast("timestamp")) / 100)
    return limits.capacity_wait(e, now, cap=60, need=40, key="event_type")


def rate_admit(spark, d):
    """Requests admitted per model under 4 a minute, 60 tokens a minute and 16 a day, on a clock a hundred times as fast."""
    e = _events(spark, d).select("event_id", "event_type", F.timestamp_micros(F.floor(limits.micros("ts") / 100)).alias("ts"), "n")
    return limits.rate_admission(e, "event_type", "ts", "n", "event_id", rpm=4, tpm=60, rpd=1600).groupBy("event_type", "admitted").agg(F.count("*").alias("n"))


def rate_recorded(spark, d):
    """Requests admitted under 5 a minute, 60 reported tokens a minute, 900 requests and 9000 tokens a day; events of odd value report the tokens of a call."""
    kind = F.when(F.col("n") % 2 == 0, "request").otherwise("report")
    e = _events(spark, d).select("event_id", "event_type", F.timestamp_micros(F.floor(limits.micros("ts") / 100)).alias("ts"), kind.alias("kind"), "n")
    return limits.recorded_admission(e, "event_type", "ts", "kind", "n", "event_id", 5, 60, 900, 9000).groupBy("event_type", "admitted").agg(F.count("*").alias("n"))


def job_admit(spark, d):
    """Jobs started per event type taken as a host: at most 3 running and 5 an hour per client, on a clock twenty times as fast; a job takes a minute per unit of value."""
    e = _events(spark, d).select("event_type", "user_id", "event_id", F.timestamp_micros(F.floor(limits.micros("ts") / 20)).alias("ts"), (F.col("n") * 60_000_000).alias("took"))
    return limits.job_admission(e, "event_type", "user_id", "ts", "took", "event_id").groupBy("event_type", "outcome").agg(F.count("*").alias("n"))


def dispatch(spark, d):
    """Waiting times of calls per event type taken as a queue, with 4 workers and 5 starts a minute, on a clock a hundred times as fast; a call takes a second per unit of value."""
    e = _events(spark, d).select("event_type", "event_id", F.timestamp_micros(F.floor(limits.micros("ts") / 100)).alias("ts"), (F.col("n") * 1_000_000).alias("took"))
    t = limits.dispatch_times(e, "event_type", "ts", "took", "event_id", workers=4, rpm=5).join(e, ["event_type", "event_id"])
    wait = F.col("start_us") - limits.micros("ts")
    waited = F.sum(wait.cast("decimal(28,0)"))  # of type decimal(38,0): a queue of about a million calls waits for longer than a long holds
    return t.groupBy("event_type").agg(F.count("*").alias("calls"), F.max(wait).alias("longest_us"), waited.alias("waited_us"), F.max("end_us").alias("done_us"))


def session_debounce(spark, d):
    return limits.sessions(table(spark, d, "events"), "user_id", "ts", 3_600_000_000)


def status_changes(spark, d):
    return limits.changes(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type"]).select("event_id")


def daily_reset(spark, d):
    """Requests and tokens per model and day, and what is left of a daily cap of 16."""
    day = F.to_date("ts")
    return _events(spark, d).groupBy("user_id", day.alias("day")).agg(F.count("*").alias("requests"), F.sum("n").alias("tokens"), F.greatest(F.lit(16) - F.count("*"), F.lit(0)).alias("left"))


def _cooldowns(spark, d):
    """Every error cools its user for one hour per token spent, at most a day."""
    us = limits.micros("ts")
    return _events(spark, d).where("event_type = 'error'").select("user_id", us.alias("start_us"), (us + F.least(F.col("n"), F.lit(24)) * 3_600_000_000).alias("until_us"))


def cooldown_asof(spark, d):
    q = table(spark, d, "events").where("event_type = 'view'").select("event_id", "user_id", limits.micros("ts").alias("us"))
    return limits.cooldown_asof(q, _cooldowns(spark, d), "user_id").select("event_id", "cooling", "remaining_us")


def cooldown_matrix(spark, d):
    """Cooling flag and seconds left of every user at one instant."""
    users = table(spark, d, "events").select("user_id").distinct().withColumn("us", limits.micros(F.lit("2024-01-20 00:00:00").cast("timestamp")))
    return limits.cooldown_asof(users, _cooldowns(spark, d), "user_id").select("user_id", "cooling", F.floor(F.col("remaining_us") / 1_000_000).alias("seconds_left"))


def pool_cascade(spark, d):
    """Models of a cascade over pools made of the nation table, for two available providers."""
    key = F.col("n_nationkey")
    w = Window.partitionBy("tier").orderBy("n_nationkey")
    pools = table(spark, d, "nation").select(F.concat(F.lit("tier"), key % 5).alias("tier"), F.when(key % 3 == 0, "groq").when(key % 3 == 1, "gemini").otherwise("nvidia").alias("provider"), F.concat(F.lit("m"), key % 7).alias("model"), "n_nationkey").withColumn("pool_pos", F.row_number().over(w)).drop("n_nationkey")
    return limits.cascade(pools, spark.createDataFrame([("groq",), ("gemini",)], "provider string"))


def ttl_filter(spark, d):
    e = table(spark, d, "events")
    return cache.expired(e.withColumn("created_at", F.col("ts").cast("timestamp")), F.lit("2024-01-10 00:00:00").cast("timestamp")).select("event_id")


def event_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def job_counts(spark, d):
    """Jobs and running jobs per user; clicks stand for running ones."""
    s = table(spark, d, "events").withColumn("status", F.when(F.col("event_type") == "click", "running").otherwise("done"))
    return s.groupBy("user_id").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "running").alias("running"))


def job_listing(spark, d):
    """The ten latest events of each user, newest first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, d, "events").withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("user_id", "rank", "event_id")


QUERIES = {f.__name__: f for f in (sliding_usage, sliding_usage_total, capacity_wait, rate_admit, rate_recorded, job_admit, dispatch, session_debounce, status_changes, daily_reset, cooldown_asof, cooldown_matrix, pool_cascade, ttl_filter, event_summary, job_counts, job_listing)}

_E = "WITH e AS (SELECT *, CAST(floor(value) AS BIGINT) AS n, epoch_us(ts) AS us, epoch_us(ts) // 100 AS fast FROM events)"
_COOL = _E + ", c AS (SELECT user_id, us AS start_us, us + least(n, 24) * 3600000000 AS until_us FROM e WHERE event_type = 'error')"

ORACLES = {
    "sliding_usage": _E + " SELECT event_id, count(*) OVER w AS requests_60s, sum(n) OVER w AS amount_60s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)",
    "sliding_usage_total": _E + " SELECT event_id, count(*) OVER w AS requests_60s, sum(n) OVER w AS amount_60s FROM e WINDOW w AS (PARTITION BY event_type ORDER BY fast RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)",
    "capacity_wait": _E + """, p AS (SELECT epoch_us(TIMESTAMP '2024-01-15') // 100 AS now),
l AS (SELECT event_type, fast, n, sum(n) OVER (PARTITION BY event_type ORDER BY fast, n ROWS UNBOUNDED PRECEDING) AS freed, sum(n) OVER (PARTITION BY event_type) AS total, now FROM e, p WHERE fast > now - 60000000 AND fast <= now)
SELECT event_type, CASE WHEN max(total) + 40 < 60 THEN 0 ELSE greatest(min(fast) FILTER (WHERE freed >= total + 40 - 60 + 1) + 60000000 - max(now), 0) END AS wait_us FROM l GROUP BY event_type""",
    "session_debounce": _E + """, g AS (SELECT *, CASE WHEN us - lag(us) OVER w >= 3600000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS events FROM r GROUP BY user_id, run""",
    "status_changes": "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type",
    "daily_reset": _E + " SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS requests, sum(n) AS tokens, greatest(16 - count(*), 0) AS \"left\" FROM e GROUP BY 1, 2",
    "cooldown_asof": _COOL + " SELECT q.event_id, coalesce(until_us > q.us, false) AS cooling, greatest(coalesce(until_us - q.us, 0), 0) AS remaining_us FROM (SELECT * FROM e WHERE event_type = 'view') q ASOF LEFT JOIN c ON c.user_id = q.user_id AND c.start_us <= q.us",
    "cooldown_matrix": _COOL + " SELECT q.user_id, coalesce(until_us > q.us, false) AS cooling, greatest(coalesce(until_us - q.us, 0), 0) // 1000000 AS seconds_left FROM (SELECT DISTINCT user_id, epoch_us(TIMESTAMP '2024-01-20') AS us FROM e) q ASOF LEFT JOIN c ON c.user_id = q.user_id AND c.start_us <= q.us",
    "pool_cascade": """WITH pools AS (SELECT 'tier' || (n_nationkey % 5) AS tier, CASE n_nationkey % 3 WHEN 0 THEN 'groq' WHEN 1 THEN 'gemini' ELSE 'nvidia' END AS provider, 'm' || (n_nationkey % 7) AS model, row_number() OVER (PARTITION BY n_nationkey % 5 ORDER BY n_nationkey) AS pool_pos FROM nation),
o(p, i, tier) AS (VALUES ('tier0',0,'tier0'),('tier0',1,'tier1'),('tier0',2,'tier2'),('tier0',3,'tier3'),('tier1',0,'tier1'),('tier1',1,'tier0'),('tier1',2,'tier2'),('tier1',3,'tier3'),('tier2',0,'tier2'),('tier2',1,'tier1'),('tier2',2,'tier3'),('tier2',3,'tier0'),
('tier3',0,'tier3'),('tier3',1,'tier4'),('tier3',2,'tier2'),('tier3',3,'tier1'),('tier3',4,'tier0'),('tier4',0,'tier4'),('tier4',1,'tier3'),('tier4',2,'tier2'),('tier4',3,'tier1')),
r AS (SELECT p, i, pool_pos, provider, model, row_number() OVER (PARTITION BY p, provider, model ORDER BY i, pool_pos) AS k FROM pools JOIN o USING (tier) WHERE provider IN ('groq', 'gemini'))
SELECT p AS "primary", row_number() OVER (PARTITION BY p ORDER BY i, pool_pos) - 1 AS pos, provider, model FROM r WHERE k = 1""",
    "ttl_filter": "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-08'",
    "event_summary": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS \"first\", max(ts) AS \"last\" FROM events GROUP BY event_type",
    "job_counts": "SELECT user_id, count(*) AS jobs, count(*) FILTER (WHERE event_type = 'click') AS running FROM events GROUP BY user_id",
    "job_listing": "SELECT user_id, rank, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 10",
    "job_admit": """WITH RECURSIVE e AS (SELECT event_type AS k, epoch_us(ts) // 20 AS us, CAST(floor(value) AS BIGINT) * 60000000 AS took, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 20, event_id) AS i,
  row_number() OVER (PARTITION BY event_type, user_id, (epoch_us(ts) // 20) // 3600000000 ORDER BY epoch_us(ts) // 20, event_id) AS nth FROM events),
r AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ends, '' AS outcome FROM e
  UNION ALL
  SELECT k, i, CASE WHEN o = 'started' THEN list_append(live, us + took) ELSE live END, o FROM (SELECT *, CASE WHEN nth > 5 THEN 'rate' WHEN len(live) >= 3 THEN 'busy' ELSE 'started' END AS o
    FROM (SELECT e.k, e.i, e.us, e.took, e.nth, list_filter(r.ends, lambda x: x > e.us) AS live FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1)))
SELECT k AS event_type, outcome, count(*) AS n FROM r WHERE i > 0 GROUP BY k, outcome""",
    "rate_recorded": """WITH RECURSIVE e AS (SELECT event_type AS k, epoch_us(ts) // 100 AS us, CAST(floor(value) AS BIGINT) AS n, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 100, event_id) AS i FROM events),
r AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS reqs, CAST([] AS STRUCT(t BIGINT, n BIGINT)[]) AS reps, CAST(-1 AS BIGINT) AS day, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS spent, false AS ok, false AS asked FROM e
  UNION ALL
  SELECT k, i, CASE WHEN good THEN list_append(q, us) ELSE q END, CASE WHEN asks THEN p ELSE list_append(p, struct_pack(t := us, n := n)) END, today, used0 + CAST(good AS INT), spent0 + CASE WHEN asks THEN 0 ELSE n END, good, asks
  FROM (SELECT *, asks AND used0 < 900 AND spent0 < 9000 AND len(q) < 5 AND NOT (len(p) > 0 AND list_sum(list_transform(p, lambda x: x.n)) + n >= 60) AS good
    FROM (SELECT e.k, e.i, e.us, e.n, e.n % 2 = 0 AS asks, list_filter(r.reqs, lambda x: x > e.us - 60000000) AS q, list_filter(r.reps, lambda x: x.t > e.us - 60000000) AS p, e.us // 86400000000 AS today,
        CASE WHEN r.day = e.us // 86400000000 THEN r.used ELSE 0 END AS used0, CASE WHEN r.day = e.us // 86400000000 THEN r.spent ELSE 0 END AS spent0 FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1)))
SELECT k AS event_type, ok AS admitted, count(*) AS n FROM r WHERE asked GROUP BY k, ok""",
    "dispatch": """WITH RECURSIVE e AS (SELECT event_type AS k, epoch_us(ts) // 100 AS us, CAST(floor(value) AS BIGINT) * 1000000 AS took, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 100, event_id) AS i FROM events),
r AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, [CAST(0 AS BIGINT), 0, 0, 0] AS free, CAST([] AS BIGINT[]) AS starts, CAST(0 AS BIGINT) AS us, CAST(0 AS BIGINT) AS began, CAST(0 AS BIGINT) AS fin FROM e
  UNION ALL
  SELECT k, i, list_sort(list_append(free[2:4], begun + took)), list_append(starts[greatest(len(starts) - 3, 1):], begun), us, begun, begun + took
  FROM (SELECT e.k, e.i, e.us, e.took, r.free, r.starts, greatest(e.us, r.free[1], CASE WHEN len(r.starts) = 5 THEN r.starts[1] + 60000000 ELSE e.us END) AS begun FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1))
SELECT k AS event_type, count(*) AS calls, max(began - us) AS longest_us, sum(began - us) AS waited_us, max(fin) AS done_us FROM r WHERE i > 0 GROUP BY k""",
    "rate_admit": """WITH RECURSIVE e AS (SELECT event_type AS k, epoch_us(ts) // 100 AS us, CAST(floor(value) AS BIGINT) AS n, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 100, event_id) AS i FROM events),
r AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(t BIGINT, n BIGINT)[]) AS kept, CAST(-1 AS BIGINT) AS day, 0 AS used, false AS ok FROM e
  UNION ALL
  SELECT k, i, CASE WHEN good THEN list_append(live, struct_pack(t := us, n := n)) ELSE live END, today, used0 + CAST(good AS INT), good
  FROM (SELECT *, used0 < 1600 AND len(live) < 4 AND NOT (len(live) > 0 AND list_sum(list_transform(live, lambda x: x.n)) + n >= 60) AS good
    FROM (SELECT e.k, e.i, e.us, e.n, list_filter(r.kept, lambda x: x.t > e.us - 60000000) AS live, e.us // 86400000000 AS today, CASE WHEN r.day = e.us // 86400000000 THEN r.used ELSE 0 END AS used0
      FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1)))
SELECT k AS event_type, ok AS admitted, count(*) AS n FROM r WHERE i > 0 GROUP BY k, ok""",
}
