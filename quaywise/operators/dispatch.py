"""Delivery of answers: callback addresses, attempts with backoff, outcomes, dead letters, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaywise.functions import scalars
from quaywise.operators.filters import callback_url_allowed

ATTEMPTS, FIRST_WAIT, FACTOR, LONGEST_WAIT = 3, 1.0, 2.0, 10.0
INDEX_ATTEMPTS = 5


def resolve_callbacks(envelopes: DataFrame, registry: DataFrame, static_url: str | None = None) -> DataFrame:
    """Envelopes (``subscriber_id, record_id, action``) with ``callback_url`` and, where none can be used, a
    ``dead_reason``. A configured address overrides the registry (``subscriber_id, record_id, base_url``)."""
    if static_url:
        joined = envelopes.withColumn("base_url", F.lit(static_url))
    else:
        joined = envelopes.join(registry, ["subscriber_id", "record_id"], "left")
    out = joined.withColumn("callback_url", scalars.endpoint_for_action(F.col("base_url"), F.col("action")))
    reason = F.when(F.col("base_url").isNull(), "unknown subscriber").when(F.col("callback_url").isNull(), "unknown action").when(~callback_url_allowed(F.col("base_url")), "address refused")
    return out.withColumn("dead_reason", reason).drop("base_url")


def outcome(status: Column) -> Column:
    """What an HTTP status means: conflict counts as delivered, client errors are final, the rest is retried."""
    return F.when(status.between(200, 299) | (status == 409), "DELIVERED").when(status.between(400, 499) & ~status.isin(408, 429), "FAILED").otherwise("RETRY")


def wait_before(attempt: Column, first: float = FIRST_WAIT, factor: float = FACTOR, longest: float = LONGEST_WAIT) -> Column:
    """Seconds before an attempt (numbered from 1, which does not wait)."""
    return F.when(attempt <= 1, F.lit(0.0)).otherwise(F.least(F.lit(longest), F.lit(first) * F.pow(F.lit(factor), attempt - 2)))


def delivery_results(attempts: DataFrame, most: int = ATTEMPTS) -> DataFrame:
    """``message_id, attempts, waited, result`` from attempt rows (``message_id, attempt, status``): attempts count
    up to the first that settles the message or the last allowed one."""
    marked = attempts.where(F.col("attempt") <= most).withColumn("o", outcome(F.col("status")))
    settled = marked.groupBy("message_id").agg(F.min(F.when(F.col("o") != "RETRY", F.col("attempt"))).alias("at"), F.max("attempt").alias("tried"))
    used = settled.select("message_id", F.coalesce("at", "tried").alias("attempts"), F.col("at").isNull().alias("open"), "tried")
    last = marked.join(used, "message_id").where(F.col("attempt") <= F.col("attempts"))
    return last.groupBy("message_id", "attempts").agg(
        F.sum(wait_before(F.col("attempt"))).alias("waited"),
        F.max_by(F.when(F.col("o") == "RETRY", F.when(F.col("attempt") >= most, "DEAD").otherwise("PENDING")).when(F.col("o") == "FAILED", "DEAD").otherwise("DELIVERED"), "attempt").alias("result"),
    )


def next_attempts(failures: DataFrame, most: int = INDEX_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(failures queued again with the attempt counted up, final dead letters)."""
    counted = failures.withColumn("attempt", F.coalesce("attempt", F.lit(0)) + 1)
    return counted.where(F.col("attempt") < most), counted.where(F.col("attempt") >= most)


def dead_letters(rows: DataFrame) -> DataFrame:
    """The original value with what went wrong and where it came from, as a header map."""
    names = ["error", "error_class", "topic", "partition", "offset"]
    return rows.select("key", "value", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(n).cast("string") for n in names))).alias("headers"))
