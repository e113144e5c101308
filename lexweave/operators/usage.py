"""Consent records and usage figures; every aggregate combines on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from .evidence import first_per_key

WINDOW, LIMIT = "15 minutes", 100
SCOPE_PARTS = 64


def validate_consents(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected).  Processing and storage must be granted; other flags default to no."""
    filled = requests.withColumns(
        {
            "data_sharing": F.coalesce("data_sharing", F.lit(False)),
            "marketing": F.coalesce("marketing", F.lit(False)),
            "consent_date": F.coalesce("consent_date", F.current_timestamp()),
            "version": F.lit("1.0"),
        }
    )
    granted = F.coalesce(F.col("data_processing") & F.col("data_storage"), F.lit(False))
    return filled.where(granted), filled.where(~granted)


def latest_consent(consents: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The newest record of each user."""
    order = order or ["consent_date"]
    return first_per_key(consents, ["user_id"], [F.desc(name) for name in order])


def scope_of(consents: DataFrame, role: str, user_id: int | None = None) -> DataFrame:
    """The consents one principal may see: all for the service role, else those of the user.

    This is what a reader asks for: a filter that reaches the scan.  ``consent_scope`` lists every principal.
    """
    if role == "service":
        return consents
    return consents.where(F.col("user_id") == F.lit(user_id))


def consent_scope(consents: DataFrame, principals: DataFrame) -> DataFrame:
    """``(principal, consent columns)``: own record for users, all records for the service role.

    ``principals`` has ``(principal, role, user_id)``.
    """
    users = principals.where(F.col("role") != "service").select("principal", "user_id")
    own = users.join(consents, "user_id").select("principal", *consents.columns)
    return own.unionByName(service_scope(consents, principals))


def service_scope(consents: DataFrame, principals: DataFrame) -> DataFrame:
    """Every record for each principal of the service role.

    The result has as many rows as it must, principals times records; no task and no array holds the principals.  Both
    sides meet in ``SCOPE_PARTS`` shares of the users, and every principal goes to each share.
    """
    services = principals.where(F.col("role") == "service").select("principal").where("principal is not null").distinct()
    parts = F.explode(F.sequence(F.lit(0), F.lit(SCOPE_PARTS - 1))).alias("__part")
    dealt = consents.withColumn("__part", F.pmod(F.xxhash64("user_id"), F.lit(SCOPE_PARTS)).cast("int"))
    return dealt.join(services.select("principal", parts), "__part").select("principal", *consents.columns)


def duration_histogram(
    traces: DataFrame, labels: list[str], seconds: str = "seconds", bounds: list[float] = fixed.DURATION_BUCKETS
) -> DataFrame:
    """``(labels, le, n)``: cumulative counts per upper bound, ``+Inf`` for all.

    The counts of all bounds are taken in one pass and unfolded afterwards.
    """
    counted = traces.groupBy(*labels).agg(
        *[F.count_if(F.col(seconds) <= bound).alias(f"n_{at}") for at, bound in enumerate(bounds)],
        F.count("*").alias("n_all"),
    )
    entries = [
        F.struct(F.lit(str(bound)).alias("le"), F.col(f"n_{at}").alias("n")) for at, bound in enumerate(bounds)
    ]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.col("n_all").alias("n")))
    return counted.select(*labels, F.inline(F.array(*entries)))


def duration_summary(
    traces: DataFrame, labels: list[str], seconds: str = "seconds", accuracy: int = 100_000
) -> DataFrame:
    """Count, sum, median and 95th percentile per label set.

    The percentiles are exact up to about ``accuracy`` traces per label set, and beyond that off by one rank in so
    many at most.
    """
    return traces.groupBy(*labels).agg(
        F.count("*").alias("n"),
        F.sum(seconds).alias("total_seconds"),
        F.percentile_approx(seconds, 0.5, accuracy).alias("p50"),
        F.percentile_approx(seconds, 0.95, accuracy).alias("p95"),
    )


def error_counts(traces: DataFrame, labels: list[str], status: str = "status") -> DataFrame:
    return traces.where(F.col(status) == "error").groupBy(*labels).agg(F.count("*").alias("errors"))


TIMING_SCHEMA = "msg string, operation string, durationMs double, timestamp string"


def timing_log_summary(lines: DataFrame) -> DataFrame:
    """``(operation, n, mean_ms, max_ms)`` of the completed operations in a timing log."""
    completed = lines.where(F.col("msg").contains("Completed:") & F.col("durationMs").isNotNull())
    return completed.groupBy("operation").agg(
        F.count("*").alias("n"),
        F.avg("durationMs").alias("mean_ms"),
        F.max("durationMs").alias("max_ms"),
    )


def request_key(user: Column, address: Column) -> Column:
    """Who a request counts for: the user, else the network address in its plain form."""
    plain = F.regexp_replace(F.regexp_replace(address, r"\A::ffff:", ""), r"\A\[|\]\z", "")
    return F.coalesce(
        F.concat(F.lit("user:"), user.cast("string")), F.nullif(plain, F.lit("")), F.lit("unknown")
    )


def request_windows(requests: DataFrame, limit: int = LIMIT, window: str = WINDOW) -> DataFrame:
    """``(requester, window_start, requests, over_limit)`` per clock-aligned window.

    ``requests`` has ``(ts, requester)``.
    """
    counted = requests.groupBy("requester", F.window("ts", window)).agg(F.count("*").alias("requests"))
    return counted.select(
        "requester",
        F.col("window.start").alias("window_start"),
        "requests",
        (F.col("requests") > limit).alias("over_limit"),
    )
