"""Rate windows, admission, cooldowns and model cascades over event logs (batch forms).

Times are microseconds; a window of 60 seconds holds events with ``t > now - 60 s``.
"""

from __future__ import annotations

import heapq
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
#: In which order the tiers of models are tried.
CASCADE = {"tier0": ["tier0", "tier1", "tier2", "tier3"], "tier1": ["tier1", "tier0", "tier2", "tier3"], "tier2": ["tier2", "tier1", "tier3", "tier0"], "tier3": ["tier3", "tier4", "tier2", "tier1", "tier0"], "tier4": ["tier4", "tier3", "tier2", "tier1"]}
SHARE = 0.80


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def sliding_usage(events: DataFrame, key: str, ts: str = "ts", amount: str = "n", span: int = 10 * MINUTE) -> DataFrame:
    """Requests and amount within the last 60 seconds up to each event, per key.

    A key's events are split into spans of time, each with the last minute of the span before carried along, so a hot key spreads over tasks.
    """
    e = events.withColumn("us", micros(ts))
    at = F.floor(F.col("us") / span)
    carried = F.when(F.col("us") % span >= span - MINUTE, F.array(F.struct(at.alias("span"), F.lit(True).alias("own")), F.struct((at + 1).alias("span"), F.lit(False).alias("own"))))
    placed = e.withColumn("_p", F.explode(F.coalesce(carried, F.array(F.struct(at.alias("span"), F.lit(True).alias("own")))))).withColumn("_span", F.col("_p.span"))
    w = Window.partitionBy(key, "_span").orderBy("us").rangeBetween(-(MINUTE - 1), 0)
    return placed.withColumns({"requests_60s": F.count("*").over(w), "amount_60s": F.sum(amount).over(w)}).where("_p.own").drop("us", "_p", "_span")


def capacity_wait(usage: DataFrame, now: Column, cap: int, need: int, key: str, ts: str = "ts", amount: str = "n") -> DataFrame:
    """(key, wait_us): until so much of the last minute's amount has expired that ``need`` fits under ``cap``; 0 if it fits now.

    Running sums in two levels, within each tenth of a second and over at most 600 of these.
    """
    live = usage.withColumn("us", micros(ts)).where((F.col("us") > now - MINUTE) & (F.col("us") <= now)).withColumn("_tick", F.floor(F.col("us") / 100_000))
    ticks = live.groupBy(key, "_tick").agg(F.sum(amount).alias("_s"))
    before = Window.partitionBy(key).orderBy("_tick").rowsBetween(Window.unboundedPreceding, -1)
    ticks = ticks.select(key, "_tick", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"), F.sum("_s").over(Window.partitionBy(key)).alias("total"))
    w = Window.partitionBy(key, "_tick").orderBy("us", amount).rowsBetween(Window.unboundedPreceding, 0)
    run = live.withColumn("_in", F.sum(amount).over(w)).join(ticks, [key, "_tick"]).withColumn("freed", F.col("_off") + F.col("_in"))
    free_at = F.min(F.when(F.col("freed") >= F.col("total") + need - cap + 1, F.col("us")))
    return run.groupBy(key).agg(F.max("total").alias("total"), free_at.alias("free_at")).select(
        key, F.when(F.col("total") + need < cap, F.lit(0)).otherwise(F.greatest(F.col("free_at") + MINUTE - now, F.lit(0))).cast("long").alias("wait_us"))


def admit(times: list[int], amounts: list[int], rpm: int, tpm: int, rpd: int) -> list[bool]:
    """Sequential admission of requests in time order under minute and day caps."""
    minute: deque = deque()
    tokens, day, today, out = 0, 0, None, []
    for t, n in zip(times, amounts):
        if t // 86_400_000_000 != today:
            today, day = t // 86_400_000_000, 0
        while minute and minute[0][0] <= t - MINUTE:
            tokens -= minute.popleft()[1]
        ok = day < rpd and len(minute) < rpm and not (minute and tokens + n >= tpm)
        if ok:
            minute.append((t, n))
            tokens += n
            day += 1
        out.append(ok)
    return out


def rate_admission(events: DataFrame, key: str, ts: str, amount: str, order: str, rpm: int, tpm: int, rpd: int) -> DataFrame:
    """Admit or reject each event of a key, in order. Sorted by the shuffle and folded as a stream: a task holds one minute
    of one key at a time."""
    src = events.select(key, order, micros(ts).alias("us"), F.col(amount).cast("long").alias("amount")).where("us is not null").repartition(key).sortWithinPartitions(key, "us", order)
    types = dict(src.dtypes)

    def fold(batches):
        now, minute, tokens, day, today = None, deque(), 0, 0, None
        for b in batches:
            out = []
            for k, t, n in zip(b[key], b["us"], b["amount"]):
                if k != now:
                    now, minute, tokens, day, today = k, deque(), 0, 0, None
                if t // 86_400_000_000 != today:
                    today, day = t // 86_400_000_000, 0
                while minute and minute[0][0] <= t - MINUTE:
                    tokens -= minute.popleft()[1]
                ok = day < rpd and len(minute) < rpm and not (minute and tokens + n >= tpm)
                if ok:
                    minute.append((t, n))
                    tokens += n
                    day += 1
                out.append(ok)
            yield pd.DataFrame({key: b[key], order: b[order], "admitted": out})

    return src.mapInPandas(fold, f"`{key}` {types[key]}, `{order}` {types[order]}, admitted boolean")


DAY = 86_400_000_000


class Gate:
    """Admission of one key under caps of requests and tokens a minute and a day, where tokens count once a call reports them.

    A request is judged by its estimate against the tokens reported within the last minute; without any report the estimate is not looked at.
    """

    def __init__(self, rpm: int, tpm: int, rpd: int, tpd: int, requests=(), reports=(), today: int | None = None, day_requests: int = 0, day_tokens: int = 0):
        self.rpm, self.tpm, self.rpd, self.tpd = rpm, tpm, rpd, tpd
        self.requests, self.reports = deque(requests), deque(map(tuple, reports))
        self.tokens = sum(n for _, n in self.reports)
        self.today, self.day_requests, self.day_tokens = today, day_requests, day_tokens

    def take(self, t: int, kind: str, n: int) -> bool | None:
        """Whether a request may go on; None for a report."""
        if t // DAY != self.today:
            self.today, self.day_requests, self.day_tokens = t // DAY, 0, 0
        while self.requests and self.requests[0] <= t - MINUTE:
            self.requests.popleft()
        while self.reports and self.reports[0][0] <= t - MINUTE:
            self.tokens -= self.reports.popleft()[1]
        if kind != "request":
            self.reports.append((t, n))
            self.tokens += n
            self.day_tokens += n
            return None
        ok = self.day_requests < self.rpd and self.day_tokens < self.tpd and len(self.requests) < self.rpm and not (self.reports and self.tokens + n >= self.tpm)
        if ok:
            self.requests.append(t)
            self.day_requests += 1
        return ok


def recorded_admission(events: DataFrame, key: str, ts: str, kind: str, amount: str, order: str, rpm: int, tpm: int, rpd: int, tpd: int) -> DataFrame:
    """(key, order, admitted) of the requests among events of two kinds, ``request`` with an estimate and any other with the tokens a call has used.

    Sorted by the shuffle and folded as a stream; a task holds the last minute of one key.
    """
    src = events.select(key, order, micros(ts).alias("us"), F.col(kind).alias("kind"), F.col(amount).cast("long").alias("n")).where("us is not null and n is not null").repartition(key).sortWithinPartitions(key, "us", order)
    types = dict(src.dtypes)

    def fold(batches):
        now, gate = None, None
        for b in batches:
            out = []
            for k, i, t, what, n in zip(b[key], b[order], b["us"], b["kind"], b["n"]):
                if gate is None or k != now:
                    now, gate = k, Gate(rpm, tpm, rpd, tpd)
                ok = gate.take(t, what, n)
                if ok is not None:
                    out.append((k, i, ok))
            yield pd.DataFrame(out, columns=[key, order, "admitted"])

    return src.mapInPandas(fold, f"`{key}` {types[key]}, `{order}` {types[order]}, admitted boolean")


HOUR = 3_600_000_000


def job_admission(requests: DataFrame, host: str, client: str, ts: str, duration_us: str, order: str, running: int = 3, per_hour: int = 5) -> DataFrame:
    """(host, order, outcome) of requests to start a job: ``rate`` (over the client's hourly count), ``busy`` (too many jobs running), or ``started``.

    The count of a client is by fixed hours and holds every request, as the limit is looked at before anything else. Which jobs
    run depends on the ones admitted before, so a host's requests are folded in order as a stream; a task holds the end times of the running jobs.
    """
    e = requests.select(host, client, order, micros(ts).alias("us"), F.col(duration_us).cast("long").alias("took")).where("us is not null")
    nth = F.row_number().over(Window.partitionBy(host, client, F.floor(F.col("us") / HOUR)).orderBy("us", order))
    src = e.withColumn("nth", nth).select(host, order, "us", "took", "nth").repartition(host).sortWithinPartitions(host, "us", order)
    types = dict(src.dtypes)

    def fold(batches):
        now, ends = None, []
        for b in batches:
            out = []
            for h, t, d, n in zip(b[host], b["us"], b["took"], b["nth"]):
                if h != now:
                    now, ends = h, []
                ends = [x for x in ends if x > t]
                if n > per_hour:
                    out.append("rate")
                elif len(ends) >= running:
                    out.append("busy")
                else:
                    ends.append(t + d)
                    out.append("started")
            yield pd.DataFrame({host: b[host], order: b[order], "outcome": out})

    return src.mapInPandas(fold, f"`{host}` {types[host]}, `{order}` {types[order]}, outcome string")


def dispatch_times(calls: DataFrame, key: str, ts: str, duration_us: str, order: str, workers: int = 10, rpm: int = 30) -> DataFrame:
    """(key, order, start_us, end_us): when a queue's calls begin, in order, with so many workers and at most ``rpm`` starts in any minute.

    A slot is claimed by one call at a time: a call starts when it has come, a worker is free, and a minute has passed since the start ``rpm`` calls
    before. Folded as a stream; a task holds the free times of the workers and the last ``rpm`` starts of one queue.
    """
    src = calls.select(key, order, micros(ts).alias("us"), F.col(duration_us).cast("long").alias("took")).where("us is not null").repartition(key).sortWithinPartitions(key, "us", order)
    types = dict(src.dtypes)

    def fold(batches):
        now, free, starts = None, [], deque()
        for b in batches:
            out = []
            for k, t, d in zip(b[key], b["us"], b["took"]):
                if k != now:
                    now, free, starts = k, [0] * workers, deque(maxlen=rpm)
                heapq.heapify(free)
                at = max(t, free[0], starts[0] + MINUTE if len(starts) == rpm else t)
                starts.append(at)
                heapq.heapreplace(free, at + d)
                out.append((at, at + d))
            yield pd.DataFrame({key: b[key], order: b[order], "start_us": [o[0] for o in out], "end_us": [o[1] for o in out]})

    return src.mapInPandas(fold, f"`{key}` {types[key]}, `{order}` {types[order]}, start_us long, end_us long")


def running_now(jobs: DataFrame, status: str = "status") -> DataFrame:
    """(jobs, running)."""
    return jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col(status) == "running").alias("running"))


def set_cooling(cooldowns: DataFrame, new: DataFrame) -> DataFrame:
    """(model, cool_until) with the latest setting of each model: ``new`` overwrites what is kept."""
    both = cooldowns.select("model", "cool_until", F.lit(0).alias("o")).unionByName(new.select("model", "cool_until", F.lit(1).alias("o")))
    return both.groupBy("model").agg(F.max_by("cool_until", F.struct("o", "cool_until")).alias("cool_until"))


def reset_daily(cooldowns: DataFrame, last_reset: str | None, today: str) -> tuple[DataFrame, str, bool]:
    """(cooldowns, last reset day, whether it ran): the first run of a day clears all cooldowns."""
    return (cooldowns, last_reset, False) if last_reset == today else (cooldowns.where("false"), today, True)


def sessions(events: DataFrame, key: str, ts: str, gap_us: int = 3_000_000) -> DataFrame:
    """(key, start_us, end_us, events): runs without a pause of ``gap_us`` or more."""
    w = Window.partitionBy(key).orderBy("us")
    e = events.withColumn("us", micros(ts)).withColumn("new", F.coalesce((F.col("us") - F.lag("us").over(w) >= gap_us).cast("int"), F.lit(1)))
    return e.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("events")).drop("run")


def changes(events: DataFrame, key: str, order: list[str], watch: list[str]) -> DataFrame:
    """Rows whose watched columns differ from the row before in the same key; the first row counts."""
    w = Window.partitionBy(key).orderBy(*order)
    same = F.lit(True)
    for c in watch:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    return events.withColumn("_same", same & F.lag(F.lit(1)).over(w).isNotNull()).where("not _same").drop("_same")


def cooldown_asof(queries: DataFrame, cooldowns: DataFrame, key: str, at: str = "us", start: str = "start_us", until: str = "until_us") -> DataFrame:
    """For each query time the latest cooldown of its key that had begun, and whether it still holds (``at < until``).

    One union and one window instead of a range join: both sides are sorted by time within the key.
    """
    q = queries.withColumn("_t", F.col(at)).withColumn("_c", F.lit(None).cast("struct<s:bigint,u:bigint>")).withColumn("_q", F.lit(1))
    c = cooldowns.select(key, F.col(start).alias("_t"), F.struct(F.col(start).cast("bigint").alias("s"), F.col(until).cast("bigint").alias("u")).alias("_c"), F.lit(0).alias("_q"))
    w = Window.partitionBy(key).orderBy("_t", "_q", F.col("_c.u")).rowsBetween(Window.unboundedPreceding, 0)
    both = q.unionByName(c, allowMissingColumns=True).withColumn("_last", F.last("_c", ignorenulls=True).over(w)).where("_q = 1")
    left = F.greatest(F.coalesce(F.col("_last.u") - F.col(at), F.lit(0)), F.lit(0))
    return both.withColumns({"cooling": left > 0, "remaining_us": left}).drop("_t", "_c", "_q", "_last")


def cascade(pools: DataFrame, available: DataFrame) -> DataFrame:
    """(primary, pos, provider, model): the models of a primary tier's cascade in order, each once, of available providers."""
    spark = pools.sparkSession
    order = spark.createDataFrame([(p, i, t) for p, ts in CASCADE.items() for i, t in enumerate(ts)], "primary string, tier_pos int, tier string")
    rows = pools.join(available.select("provider").distinct(), "provider", "left_semi").join(F.broadcast(order), "tier")
    first = Window.partitionBy("primary", "provider", "model").orderBy("tier_pos", "pool_pos")
    rank = Window.partitionBy("primary").orderBy("tier_pos", "pool_pos")
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").withColumn("pos", F.row_number().over(rank) - 1).select("primary", "pos", "provider", "model")
