"""Log and request streams: parsing, routing, windowed counts, alerts and limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyroll.functions.logs import enrich
from tallyroll.operators.analytics import count_rows
from tallyroll.session import stored
from tallyroll.streaming.runs import BYTES_PER_TRIGGER
from tallyroll.streaming.windows import Windows

# A service may get this many requests of a client per calendar window.
SERVICE_LIMITS = {"minute": 100, "hour": 1000}
GLOBAL_LIMITS = {"minute": 1000, "hour": 10000, "day": 50000}
# Alert when more than this share of requests fail, or one takes longer.
ERROR_SHARE = 0.05
SLOW_MS = 1000.0
ROUTES = {"logs": None, "errors": "error", "performance": "performance"}
# Rows that one task writes of a route.
ROWS_PER_TASK = 2_000_000


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of arriving text files as column ``line``."""
    reader = spark.readStream.option("maxBytesPerTrigger", BYTES_PER_TRIGGER)
    return reader.text(path).withColumnRenamed("value", "line")


def json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of arriving JSON-lines files."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", BYTES_PER_TRIGGER).json(path)


def parsed(lines: DataFrame) -> DataFrame:
    return enrich(lines)


def route(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Every record to the daily log; errors and performance records to their own places as well.

    The batch is parsed once, and a repeated batch overwrites its own folders. A route's counted rows choose the
    number of its tasks, and Spark cuts ranges of days from a sample: a large day spans several tasks, small ones share.
    """
    day = F.coalesce(F.date_format("time", "yyyy.MM.dd"), F.lit("unknown"))
    rows = stored(batch.withColumn("day", day), "parsed")
    for name, tag in ROUTES.items():
        part = rows if tag is None else rows.filter(F.array_contains("tags", tag))
        tasks = -(-part.count() // ROWS_PER_TASK)
        cut = part.repartitionByRange(tasks, "day", F.xxhash64("message"), F.monotonically_increasing_id()) if tasks > 1 else part.coalesce(1)
        cut.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/{name}/batch={batch_id}")


def timed(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Event time as a zoned timestamp with a watermark."""
    return requests.withColumn("time", F.col("seen_at").cast("timestamp")).withWatermark("time", delay)


def request_rates(size: str = "1 minute", delay: int = 600) -> Windows:
    """Requests, total and slowest duration per window, method and endpoint."""
    sums = {"requests": count_rows(), "total_ms": F.sum("duration_ms")}
    return Windows("seen_at", size, ["method", "endpoint"], sums, {"slowest_ms": F.max("duration_ms")}, delay=delay)


def duration_rates(bounds: Mapping[str, float], size: str = "1 hour", delay: int = 600) -> Windows:
    """Cumulative duration histogram per window, one column per bound (in milliseconds)."""
    sums = {n: F.count_if(F.col("duration_ms") <= b) for n, b in bounds.items()}
    return Windows("seen_at", size, [], sums | {"requests": count_rows()}, delay=delay)


def failure_rates(size: str = "5 minutes", slide: str = "1 minute", delay: int = 600) -> Windows:
    """Requests, failures and the slowest answer in sliding windows."""
    sums = {"requests": count_rows(), "failures": F.count_if(F.col("status") >= 500)}
    return Windows("seen_at", size, [], sums, {"slowest_ms": F.max("duration_ms")}, slide, delay)


def alerts(rates: DataFrame, share: float = ERROR_SHARE, slow_ms: float = SLOW_MS) -> DataFrame:
    """Of ``failure_rates`` the windows with too many failures or a slow answer."""
    return (
        rates.withColumn("error_share", F.round(F.col("failures") / F.col("requests"), 4))
        .withColumn("too_many_errors", F.col("failures") > F.col("requests") * share)
        .withColumn("too_slow", F.col("slowest_ms") > slow_ms)
        .filter(F.col("too_many_errors") | F.col("too_slow"))
        .select(
            "window_start", "requests", "failures", "error_share", "slowest_ms", "too_many_errors", "too_slow",
        )
    )


def request_counts(unit: str, by: Sequence[str] = ("client",), delay: int = 600) -> Windows:
    """Requests per calendar window of one unit and client, or client of a service."""
    return Windows("seen_at", f"1 {unit}", by, {"requests": count_rows()}, delay=delay)


def with_service(requests: DataFrame) -> DataFrame:
    """The service is the path's part after the version."""
    return requests.withColumn("service", F.regexp_extract("endpoint", r"^/api/v\d+/([^/?]+)", 1))


def over_limit(counts: DataFrame, unit: str, limit: int) -> DataFrame:
    """Of ``request_counts`` the windows in which the limit of that window size is exceeded."""
    over = counts.filter(F.col("requests") > limit).drop("window_end")
    return over.withColumns({"unit": F.lit(unit), "excess": F.col("requests") - limit})


def interval_matches(purchases: DataFrame, clicks: DataFrame, minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """Purchases with the same user's clicks at most ``minutes`` before them, to the instant, as a stream-stream join.

    The watermarks bound the state: a side's rows go when no row of the other side can reach them.
    """

    def side(events: DataFrame, name: str) -> DataFrame:
        timed = events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", delay)
        return timed.select(
            F.col("time").alias(f"{name}_time"), F.col("user_id").alias(f"{name}_user"), F.col("event_id").alias(f"{name}_id")
        )

    bought, clicked = side(purchases, "purchase"), side(clicks, "click")
    inside = (
        (F.col("purchase_user") == F.col("click_user"))
        & (F.col("click_time") <= F.col("purchase_time"))
        & (F.col("click_time") >= F.col("purchase_time") - F.expr(f"INTERVAL {minutes} MINUTES"))
    )
    return bought.join(clicked, inside).select(
        F.col("purchase_user").alias("user_id"), "purchase_id", "purchase_time", "click_id", "click_time"
    )


def activity_sessions(requests: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Activity sessions per client: a pause longer than ``gap`` ends one.

    The runner has sessions merge inside each task before the shuffle, which keeps a busy client cheap.
    """
    return (
        timed(requests, delay)
        .groupBy(F.session_window("time", gap), "client")
        .agg(count_rows().alias("requests"))
        .select(
            "client", F.col("session_window.start").alias("session_start"),
            F.col("session_window.end").alias("session_end"), "requests",
        )
    )


def cleanup_ticks(every: str = "5 minutes", delay: int = 600) -> Windows:
    """Sessions each periodic cleanup removes: those whose end fell in the interval before it (``window_end``)."""
    return Windows("expires_at", every, [], {"expired": count_rows()}, delay=delay)
