"""Keyed state: anchored request limits, brute-force blocking and re-delivered files.

Requests are first counted per client and second, with a partial count before the shuffle, and leave that
query (``per_second``, written to a folder) when the watermark has passed their second. The limits read that
folder as a stream. So the state function sees one row per client and second however many requests there
are, and sees a client's seconds in order however they arrived. Seconds are the resolution of the logs. Requests
without a client count as those of the client ``unknown``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyroll.operators.analytics import count_rows
from tallyroll.session import stored
from tallyroll.streaming.deltas import DeltaTable

UNKNOWN = "unknown"
# Groups of clients whose states are kept together; fixed, as a checkpoint holds them by their numbers.
BUCKETS = 2048


def per_second(requests: DataFrame, counts: Mapping[str, Column], delay: str) -> DataFrame:
    """(client, time, second, counts...), one row per client and second, when no earlier one can come.

    What a batch gives for a client lies in one file, so readers see a client's seconds in order.
    """
    timed = requests.withColumn("time", F.col("seen_at").cast("timestamp")).withWatermark("time", delay)
    client = F.coalesce(F.col("client").cast("string"), F.lit(UNKNOWN)).alias("client")
    return (
        timed.groupBy(F.window("time", "1 second"), client)
        .agg(*[c.alias(n) for n, c in counts.items()])
        .select("client", F.window_time("window").alias("time"), F.unix_seconds("window.start").alias("second"), *counts)
        .repartition("client")
    )


def stepped(
    seconds: DataFrame,
    counts: list[str],
    step: Callable[[tuple | None, tuple], tuple[tuple | None, tuple]],
    output: str,
    state: str,
    end: Callable[[tuple], int],
) -> DataFrame:
    """Run ``step(state, row) -> (state, result)`` over each client's seconds in order.

    ``end(state)`` is the last second at which the state still matters; after it the state goes. Clients share
    their calls and their stored rows by BUCKETS, since a call costs far more than the few seconds of one client.
    """
    names = [part.split()[0] for part in output.split(", ")]
    fields = ", ".join(f"{name} array<{kind}>" for name, kind in (part.split() for part in state.split(", ")))

    def decide(key, batches: Iterator[pd.DataFrame], held: GroupState):
        clients, *values = held.get if held.exists else ([],)
        states, out = dict(zip(clients, zip(*values))), []
        if not held.hasTimedOut:
            rows = sorted(row for b in batches for row in zip(*(b[c].tolist() for c in ["client", "second", *counts])))
            for client, *row in rows:
                now, result = step(states.pop(client, None), tuple(row))
                if now is not None:
                    states[client] = now
                out.append((client, row[0], *result))
        passed = held.getCurrentWatermarkMs()
        states = {client: now for client, now in states.items() if (end(now) + 1) * 1000 > passed}
        if states:
            held.update((list(states), *map(list, zip(*states.values()))))
            held.setTimeoutTimestamp((min(map(end, states.values())) + 1) * 1000)
        elif held.exists:
            held.remove()
        if out:
            yield pd.DataFrame(dict(zip(names, zip(*out))))

    timed = seconds.withWatermark("time", "0 seconds").withColumn("bucket", F.pmod(F.xxhash64("client"), F.lit(BUCKETS)))
    return timed.groupBy("bucket").applyInPandasWithState(
        decide, output, f"clients array<string>, {fields}", "append", GroupStateTimeout.EventTimeTimeout
    )


def request_seconds(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return per_second(requests, {"n": count_rows()}, delay)


def login_seconds(logins: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return per_second(logins, {"wrong": F.count_if(~F.col("success")), "right": F.count_if("success")}, delay)


def anchored_limit(counted: DataFrame, most: int = 100, seconds: int = 3600) -> DataFrame:
    """At most ``most`` requests per client in a window that starts with its first request.

    Refused requests do not count; the first request strictly later than the window's length opens
    a new one. Gives (client, second, window_start, passed, refused).
    """

    def step(state, row):
        (second, n), (start, used) = row, state or (None, 0)
        if start is None or second - start > seconds:
            start, used = second, 0
        passed = min(n, most - used)
        return (start, used + passed), (start, passed, n - passed)

    return stepped(
        counted,
        ["n"],
        step,
        "client string, second bigint, window_start bigint, passed bigint, refused bigint",
        "start bigint, used bigint",
        lambda state: state[0] + seconds,
    )


def brute_force(counted: DataFrame, most: int = 5, seconds: int = 900) -> DataFrame:
    """Block a client after ``most`` failures within the window of the first one.

    A success clears the count, and so does an attempt after the window. Blocked attempts change
    nothing. Within one second failures count before successes. Gives
    (client, second, failed, succeeded, blocked).
    """

    def step(state, row):
        (second, wrong, right), (first, failures) = row, state or (None, 0)
        if first is not None and second - first > seconds:
            first, failures = None, 0
        failed = min(wrong, most - failures)
        if failed and first is None:
            first = second
        failures += failed
        succeeded = right if failures < most else 0
        if succeeded:
            first = None
        result = (failed, succeeded, wrong - failed + right - succeeded)
        return None if first is None else (first, failures), result

    return stepped(
        counted,
        ["wrong", "right"],
        step,
        "client string, second bigint, failed bigint, succeeded bigint, blocked bigint",
        "first bigint, failures bigint",
        lambda state: state[0] + seconds,
    )


FIRST_SCHEMA = "content_hash string, id bigint, time timestamp, batch bigint"


def hash_index(spark: SparkSession, folder: str) -> DeltaTable:
    """All hashes seen, in buckets by hash; no hash comes twice, so merged pieces are just put together."""
    return DeltaTable(spark, f"{folder}/first", FIRST_SCHEMA, ["content_hash"], lambda rows, whole: rows)


def first_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """The first delivery of every content so far."""
    table = hash_index(spark, folder)
    return table.rows(table.pieces()).withColumn("content_hash", F.nullif("content_hash", F.lit("")))


def keep_first_deliveries(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Files whose content has never come before, whenever that was; copies in the batch count once.

    The hashes of all earlier batches are kept, so nothing is forgotten and nothing is late. A batch opens only the
    buckets of its own hashes, in a few merged pieces. Files without a hash are one content, kept under an empty text.
    """
    table = hash_index(batch.sparkSession, folder)
    key = F.coalesce("content_hash", F.lit("")).alias("content_hash")
    slim = batch.select(key, "id", F.col("uploaded_at").cast("timestamp").alias("time"))
    first = slim.groupBy("content_hash").agg(F.min(F.struct("time", "id")).alias("_f"))
    first = stored(first.select("content_hash", "_f.id", "_f.time", F.lit(batch_id).cast("bigint").alias("batch")), "deliveries")
    if pieces := table.pieces(batch_id):
        known = table.rows(pieces, first).select("content_hash")
        first = stored(first.join(known, "content_hash", "left_anti"), "fresh")
    table.append(batch_id, first)
    table.merge(batch_id)
    table.clean()
