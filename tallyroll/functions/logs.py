"""Log lines to fields, components and tags; one regular-expression pass per line."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

APP_LINE = (
    r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
    r" - ([A-Za-z]+) - (.*?) - (.*)$"
)
ACCESS_LINE = (
    r'^(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}) - - \[([^\]]+)\] "(\w+) (\S+) HTTP/([\d.]+)" (\d+) (\d+).*$'
)
# Names of the services and of the gateway's component.
SERVICE = "backend"
GATEWAY, GATEWAY_COMPONENT = "gateway", "api-gateway"
# Message pattern -> component. Several may match one line.
COMPONENT_RULES = {
    "telegram-bot": r"Telegram",
    "file-processor": r"FileProcessor|обработка файла",
    "authentication": r"auth|Auth|аутентификация",
    "database": r"SQL|database|PostgreSQL",
}
ALERT_LEVELS = ["ERROR", "CRITICAL"]
PERFORMANCE_PATTERN = r"performance|время выполнения|duration"
DURATION_PATTERN = r".*duration[:\s]+(\d+\.?\d*)"
_MARK = "\u0001"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; a branch would compute it again wherever it names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _groups(line: Column, pattern: str, count: int) -> Column:
    """All groups of the pattern as an array; null when the line does not match."""
    joined = F.regexp_replace(line, pattern, _MARK + _MARK.join(f"${i}" for i in range(1, count + 1)))
    return _once(joined, lambda j: F.when(j.startswith(_MARK), F.split(j, _MARK)))


def app_fields(line: Column) -> Column:
    """struct(time, level, logger, message); null for lines of another form."""
    return _once(_groups(line, APP_LINE, 4), _app_record)


def _app_record(parts: Column) -> Column:
    stamp = F.replace(F.replace(parts[1], F.lit("T"), F.lit(" ")), F.lit(","), F.lit("."))
    return F.when(
        parts.isNotNull(),
        F.struct(
            stamp.try_cast("timestamp").alias("time"),
            parts[2].alias("level"),
            parts[3].alias("logger"),
            parts[4].alias("message"),
        ),
    )


def access_fields(line: Column) -> Column:
    """struct(client_ip, time, method, request, http_version, response_code, bytes)."""
    return _once(_groups(line, ACCESS_LINE, 7), _access_record)


def _access_record(parts: Column) -> Column:
    return F.when(
        parts.isNotNull(),
        F.struct(
            parts[1].alias("client_ip"),
            F.try_to_timestamp(parts[2], F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("time"),
            parts[3].alias("method"),
            parts[4].alias("request"),
            parts[5].alias("http_version"),
            parts[6].try_cast("int").alias("response_code"),
            parts[7].try_cast("bigint").alias("bytes"),
        ),
    )


def gateway_fields(message: Column) -> Column:
    """Fields of a gateway record in JSON; null when it is not JSON."""
    return _once(F.try_parse_json(message), _gateway_record)


def _gateway_record(doc: Column) -> Column:
    return F.when(
        doc.isNotNull(),
        F.struct(
            F.try_variant_get(doc, "$.client_ip", "string").alias("client_ip"),
            F.try_variant_get(doc, "$.request.method", "string").alias("method"),
            F.try_variant_get(doc, "$.request.uri", "string").alias("uri"),
            F.try_variant_get(doc, "$.response.status", "int").alias("status"),
            F.try_variant_get(doc, "$.latencies.request", "double").alias("latency_ms"),
            F.try_variant_get(doc, "$.correlation_id", "string").alias("correlation_id"),
            F.timestamp_millis(F.try_variant_get(doc, "$.started_at", "bigint")).alias("time"),
        ),
    )


def _mentions(message: Column, pattern: str) -> Column:
    """Whether the pattern is found; alternatives that are plain words need no regular expression."""
    if any(c in r".^$*+?{}[]()\\" for c in pattern):
        return message.rlike(pattern)
    return reduce(operator.or_, [message.contains(word) for word in pattern.split("|")])


def components(message: Column) -> Column:
    hits = [F.when(_mentions(message, p), F.lit(name)) for name, p in COMPONENT_RULES.items()]
    return F.array_compact(F.array(*hits))


def duration_of(message: Column) -> Column:
    """Number after the last 'duration'; null when there is none."""
    found = F.regexp_extract(message, DURATION_PATTERN, 1)
    return F.when(_mentions(message, PERFORMANCE_PATTERN), found.try_cast("double"))


def tags(level: Column, duration: Column) -> Column:
    alert = F.when(level.isin(ALERT_LEVELS), F.array(F.lit("error"), F.lit("alert")))
    slow = F.when(duration.isNotNull(), F.array(F.lit("performance")))
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(alert, empty), F.coalesce(slow, empty))


def enrich(lines: DataFrame, line: str = "line", environment: str = "production", version: str = "1.0.0") -> DataFrame:
    """Parse, tag and annotate log lines of the application, of web access and of the gateway, mixed as they come.

    Works on batches and streams; a line of no known form keeps its text and has no time.
    """
    parsed = lines.withColumn("_f", app_fields(F.col(line)))
    message = F.coalesce(F.col("_f.message"), F.col(line))
    parsed = parsed.withColumn("_a", access_fields(message)).withColumn(
        "_g", F.when(F.ltrim(F.col(line)).startswith("{"), gateway_fields(F.col(line)))
    )
    gateway = F.col("_g").isNotNull()
    own = F.when(gateway, F.array(F.lit(GATEWAY_COMPONENT))).otherwise(F.array().cast("array<string>"))
    return (
        parsed.withColumns(
            {
                "time": F.coalesce("_f.time", "_a.time", "_g.time"),
                "level": F.col("_f.level"),
                "logger": F.col("_f.logger"),
                "message": message,
                "client_ip": F.coalesce("_a.client_ip", "_g.client_ip"),
                "method": F.coalesce("_a.method", "_g.method"),
                "request": F.coalesce("_a.request", "_g.uri"),
                "response_code": F.coalesce("_a.response_code", "_g.status"),
                "latency_ms": F.col("_g.latency_ms"),
                "trace_id": F.col("_g.correlation_id"),
                "components": F.concat(own, components(message)),
                "duration": duration_of(message),
                "service": F.when(gateway, GATEWAY).otherwise(SERVICE),
            }
        )
        .withColumns(
            {
                "tags": tags(F.col("level"), F.col("duration")),
                "environment": F.lit(environment),
                "version": F.lit(version),
            }
        )
        .drop("_f", "_a", "_g")
    )
