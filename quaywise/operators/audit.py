"""Audit jobs: reconciliation, delivery checks, latency against budgets, feed planning, shortlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaywise.operators.text import sent_if_small


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``by, left_rows, right_rows, only_left, only_right, duplicates``: key sets of two tables, per group."""
    count = lambda df, name: df.groupBy(by, *[k for k in keys if k != by]).agg(F.count("*").alias(name))
    both = count(left, "l").join(count(right, "r"), [by, *[k for k in keys if k != by]], "full")
    over = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)) - 1, F.lit(0))
    return both.groupBy(by).agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.count_if(F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull()).alias("only_right"),
        F.sum(over("l") + over("r")).alias("duplicates"),
    )


def reconcile_callbacks(sent: DataFrame, received: DataFrame) -> DataFrame:
    """One row: requests sent, answered, lost, answered twice or more, and exact percentiles of the first answer's
    delay in seconds. ``sent``: ``message_id, ts``; ``received``: ``message_id, ts``."""
    answers = received.groupBy("message_id").agg(F.min("ts").alias("first"), F.count("*").alias("n"))
    joined = sent.join(answers, "message_id", "left").withColumn("delay", F.unix_micros(F.col("first").cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return joined.agg(
        F.count("*").alias("sent"),
        F.count("n").alias("received"),
        F.count_if(F.col("n").isNull()).alias("lost"),
        F.count_if(F.col("n") > 1).alias("duplicated"),
        *(F.round(F.percentile("delay", p / 100), 3).alias(f"p{p}") for p in (50, 95, 99)),
    )


def same_final_state(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``same``: whether two final states hold equal rows (any order), by counts and hash sums."""
    mark = lambda df, s: df.agg(F.count("*").alias(f"n{s}"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias(f"h{s}"), F.lit(1).alias("k"))
    return mark(a, 1).join(mark(b, 2), "k").select(((F.col("n1") == F.col("n2")) & F.col("h1").eqNullSafe(F.col("h2"))).alias("same"))


def slo_percentiles(timed: DataFrame, by: str, value: str, budgets: DataFrame) -> DataFrame:
    """``by, p50, p95, p99, budget, met`` against budgets (``by, budget`` on p99)."""
    shares = timed.groupBy(by).agg(*(F.percentile(value, p / 100).alias(f"p{p}") for p in (50, 95, 99)))
    return shares.join(sent_if_small(budgets), by, "left").withColumn("met", F.col("p99") <= F.col("budget"))


def freshness(checks: DataFrame, today) -> DataFrame:
    """``status``: STALE where a declared check is older than its validity in days."""
    return checks.withColumn("status", F.when(F.date_add("last_checked", F.col("valid_days")) < today, "STALE").otherwise("FRESH"))


def hourly_drift(timed: DataFrame, value: str) -> DataFrame:
    """``hour, p99, drift``: p99 by hour and its change from the hour before, as a share."""
    hourly = timed.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.percentile(value, 0.99).alias("p99"))
    before = F.lag("p99").over(Window.orderBy("hour"))  # one row per hour
    return hourly.withColumn("drift", (F.col("p99") - before) / before)


def apply_change_feed(baseline: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Baseline and ordered changes (``key, version, op`` and the same value columns) as the final state: the last
    change of a key decides, deletions leave nothing."""
    base = baseline.withColumn("version", F.lit(0).cast("long")).withColumn("op", F.lit("UPSERT"))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version")))
    every = base.unionByName(changes)
    return every.withColumn("_n", last).where("_n = 1 and op <> 'DELETE'").select(*baseline.columns)


def feed_plan(segments: DataFrame, state: DataFrame, most_behind: int, share: float = 0.25) -> DataFrame:
    """``feed, pending, plan``: segments for a reader only slightly behind, else the baseline.

    ``segments``: ``feed, version, size``; ``state``: ``feed, seen (null if new), baseline_size``.
    """
    open_ = segments.join(state, "feed", "right").groupBy("feed", "seen", "baseline_size")
    pending = open_.agg(F.coalesce(F.sum(F.when(F.col("version") > F.col("seen"), F.col("size"))), F.lit(0)).alias("pending"), F.count_if(F.col("version") > F.col("seen")).alias("behind"))
    plan = F.when(F.col("seen").isNull(), "BASELINE").when(F.col("behind") == 0, "NONE").when((F.col("behind") > most_behind) | (F.col("pending") >= share * F.col("baseline_size")), "BASELINE").otherwise("SEGMENTS")
    return pending.select("feed", "pending", "behind", plan.alias("plan"))


def digest_skip(parts: DataFrame, known: DataFrame) -> DataFrame:
    """Parts to index again: digest changed and version higher, or not known yet; retired catalogues never."""
    joined = parts.where(F.col("status") != "RETIRED").join(known.select("catalog_id", "part", F.col("digest").alias("old"), F.col("version").alias("seen")), ["catalog_id", "part"], "left")
    return joined.where(F.col("old").isNull() | ((F.col("digest") != F.col("old")) & (F.col("version") > F.col("seen")))).drop("old", "seen")


def shortlist(providers: DataFrame, slots: int) -> DataFrame:
    """Healthy providers by rank, ``slots`` in all, no operator above half of them (at least one).

    Reads ``provider, operator, score, healthy``; ties by provider.
    """
    order = [F.desc("score"), "provider"]
    capped = providers.where("healthy").withColumn("of_operator", F.row_number().over(Window.partitionBy("operator").orderBy(*order))).where(F.col("of_operator") <= max(1, slots // 2))
    return capped.orderBy(*order).limit(slots).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def pull_stats(pulled: DataFrame) -> DataFrame:
    """``mode, reject_reason, n``: catalogues received by way of delivery, and why some were refused."""
    return pulled.groupBy("mode", "reject_reason").agg(F.count("*").alias("n"))


def step_latency(steps: DataFrame) -> DataFrame:
    """``request_id, step, elapsed_ms`` from the moments at which steps ended (``request_id, step, ts``): each lasts
    since the step before it, and repeated steps of a request are summed."""
    before = F.lag("ts").over(Window.partitionBy("request_id").orderBy("ts", "step"))
    lasted = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1000
    return steps.withColumn("ms", lasted).where("ms is not null").groupBy("request_id", "step").agg(F.sum("ms").alias("elapsed_ms"))


def engine_stats(searches: DataFrame) -> DataFrame:
    """Durations and result counts by engine: ``engine, n, mean_ms, p99_ms, most_ms, empty, truncated``."""
    return searches.groupBy("engine").agg(
        F.count("*").alias("n"),
        F.avg("ms").alias("mean_ms"),
        F.percentile_approx("ms", 0.99).alias("p99_ms"),
        F.max("ms").alias("most_ms"),
        F.count_if(F.col("results") == 0).alias("empty"),
        F.count_if(F.col("results") >= F.col("limit")).alias("truncated"),
    )


def fanout_status(requests: DataFrame, answers: DataFrame, now) -> DataFrame:
    """``request_id, status, responded, timed_out``: COMPLETE when every asked provider has answered or run out of
    time, PARTIAL when some have, else INITIATED.

    ``requests``: ``request_id, provider, deadline``; ``answers``: ``request_id, provider, ts``. Late answers do not count.
    """
    first = answers.groupBy("request_id", "provider").agg(F.min("ts").alias("ts"))
    joined = requests.join(first, ["request_id", "provider"], "left").withColumn("ok", F.coalesce(F.col("ts") <= F.col("deadline"), F.lit(False)))
    late = ~F.col("ok") & (F.col("deadline") < now)
    counted = joined.groupBy("request_id").agg(F.count("*").alias("asked"), F.count_if("ok").alias("responded"), F.count_if(late).alias("timed_out"))
    closed = F.col("responded") + F.col("timed_out")
    status = F.when(closed >= F.col("asked"), "COMPLETE").when(closed > 0, "PARTIAL").otherwise("INITIATED")
    return counted.select("request_id", status.alias("status"), "responded", "timed_out")
