"""Listings and aggregates over orders, files, users and requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyroll.functions.values import or_default, page_count
from tallyroll.operators.filters import in_period

TOTAL = "decimal(18,2)"
# Default histogram bounds of the Prometheus client, in seconds.
HISTOGRAM_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def count_rows() -> Column:
    return F.count(F.lit(1))


def money_sum(column: str = "order_price") -> Column:
    """Sum with 0 for nothing, exact and independent of row order."""
    return F.coalesce(F.sum(column), F.lit(0)).cast(TOTAL)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def summary(orders: DataFrame) -> DataFrame:
    """One row; the average divides by all orders, so missing prices count as zero."""
    return orders.agg(count_rows().alias("total_orders"), money_sum().alias("total_revenue")).withColumn(
        "avg_order_value", F.coalesce(ratio(F.col("total_revenue"), F.col("total_orders")), F.lit(0.0))
    )


def summary_distinct(orders: DataFrame) -> DataFrame:
    """One row; the average ignores missing prices."""
    return (
        orders.agg(
            count_rows().alias("total_orders"),
            money_sum().alias("total_revenue"),
            F.count("order_price").alias("_priced"),
            F.count_distinct("machine_code").alias("unique_machines"),
            F.count_distinct("created_by").alias("unique_users"),
        )
        .withColumn("avg_order_value", F.coalesce(ratio(F.col("total_revenue"), F.col("_priced")), F.lit(0.0)))
        .drop("_priced")
    )


def by_code(orders: DataFrame, code: str) -> DataFrame:
    """Count and revenue per code, missing codes under 'Unknown'."""
    return orders.groupBy(or_default(F.col(code)).alias(code)).agg(
        count_rows().alias("orders_count"), money_sum().alias("total")
    )


def machine_totals(orders: DataFrame) -> DataFrame:
    totals = orders.groupBy(or_default(F.col("machine_code")).alias("machine_code")).agg(
        count_rows().alias("orders_count"),
        money_sum().alias("total_revenue"),
        F.count("order_price").alias("_priced"),
    )
    return totals.withColumn(
        "avg_order_value", F.coalesce(ratio(F.col("total_revenue"), F.col("_priced")), F.lit(0.0))
    ).drop("_priced")


def top_machines(
    orders: DataFrame, limit: int = 10, date_from: str | None = None, date_to: str | None = None
) -> DataFrame:
    """Machines with the highest revenue in a period; the code breaks ties."""
    dated = in_period(orders, "creation_time", date_from, date_to)
    return machine_totals(dated).orderBy(F.desc("total_revenue"), "machine_code").limit(limit)


def machine_detail(orders: DataFrame) -> DataFrame:
    """Average as total over count, so missing prices count as zero."""
    return by_code(orders, "machine_code").withColumn("average", ratio(F.col("total"), F.col("orders_count")))


def time_series(orders: DataFrame, unit: str = "day") -> DataFrame:
    """Count and revenue per day, week (from Monday) or month."""
    if unit not in ("day", "week", "month"):
        raise ValueError(f"unknown unit: {unit}")
    period = F.date_trunc(unit, F.col("creation_time")).cast("date")
    return (
        orders.groupBy(period.alias("period"))
        .agg(count_rows().alias("orders_count"), money_sum().alias("total"))
        .orderBy("period")
    )


def change_summary(changes: DataFrame) -> DataFrame:
    """Count per change type and, under 'total', of all."""
    return (
        changes.rollup("change_type")
        .agg(count_rows().alias("changes"), F.grouping("change_type").alias("_all"))
        .select(F.when(F.col("_all") == 1, "total").otherwise(F.col("change_type")).alias("change_type"), "changes")
    )


def run_totals(files: DataFrame, key: str = "session_id", batch: int = 1000) -> DataFrame:
    """Totals over the files of a run: rows, new, updated, batches of rows and failed files."""
    return files.groupBy(key).agg(
        count_rows().alias("files"),
        F.sum("total_rows").alias("total_rows"),
        F.sum("processed_rows").alias("processed_rows"),
        F.sum(F.ceil(F.col("processed_rows") / batch)).cast("bigint").alias("batches"),
        F.count_if(F.col("processing_status") == "failed").alias("errors"),
    )


def archive_totals(members: DataFrame) -> DataFrame:
    """Totals per archive; the member list is bounded by the archive's size limit."""
    return members.groupBy("archive").agg(
        count_rows().alias("extracted_files"),
        F.sum("total_rows").alias("total_rows"),
        F.sum("processed_rows").alias("processed_rows"),
        F.array_sort(F.collect_list("member")).alias("files_processed"),
    )


def period_change(orders: DataFrame, start: str, days: int) -> DataFrame:
    """Current period against the one of the same length before it, in one pass."""
    begin = F.lit(start).cast("timestamp_ntz")
    length = F.make_interval(days=F.lit(days))
    now = (F.col("creation_time") >= begin) & (F.col("creation_time") < begin + length)
    before = (F.col("creation_time") >= begin - length) & (F.col("creation_time") < begin)
    both = orders.filter((F.col("creation_time") >= begin - length) & (F.col("creation_time") < begin + length))

    def money(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("order_price"))), F.lit(0)).cast(TOTAL)

    totals = both.agg(
        F.count_if(now).alias("orders_now"),
        F.count_if(before).alias("orders_before"),
        money(now).alias("revenue_now"),
        money(before).alias("revenue_before"),
        F.count_distinct(F.when(now, F.col("machine_code"))).alias("machines_now"),
        F.count_distinct(F.when(before, F.col("machine_code"))).alias("machines_before"),
    )

    def percent(a: str, b: str) -> Column:
        return F.round(
            F.try_divide((F.col(a) - F.col(b)).cast("double") * 100, F.col(b).cast("double")), 2
        )

    return totals.withColumns(
        {
            "orders_change": percent("orders_now", "orders_before"),
            "revenue_change": percent("revenue_now", "revenue_before"),
            "machines_change": F.col("machines_now") - F.col("machines_before"),
        }
    )


def weekday_counts(orders: DataFrame) -> DataFrame:
    """Orders per weekday, 1 = Monday."""
    return orders.groupBy((F.weekday("creation_time") + 1).alias("weekday")).agg(count_rows().alias("orders_count"))


def payment_share(orders: DataFrame) -> DataFrame:
    """Each payment type's share of all orders; over the few aggregated rows."""
    mix = orders.groupBy(or_default(F.col("payment_type")).alias("payment_type")).agg(
        count_rows().alias("orders_count")
    )
    return mix.withColumn("share", ratio(F.col("orders_count"), mix.agg(F.sum("orders_count")).scalar()))


def top_locations(orders: DataFrame, locations: DataFrame, limit: int = 5) -> DataFrame:
    """Best machines with their place, null where it is not known; machines are aggregated before the join."""
    best = machine_totals(orders).select("machine_code", "orders_count", "total_revenue")
    return (
        best.join(locations, "machine_code", "left")
        .orderBy(F.desc("total_revenue"), "machine_code")
        .limit(limit)
    )


def user_stats(users: DataFrame, orders: DataFrame, files: DataFrame) -> DataFrame:
    """Orders, completed orders and files per user; both facts are aggregated before the joins."""
    made = orders.groupBy(F.col("created_by").alias("id")).agg(
        count_rows().alias("total_orders"),
        F.count_if(F.col("match_status") == "matched").alias("completed_orders"),
    )
    sent = files.groupBy(F.col("uploaded_by").alias("id")).agg(count_rows().alias("files_uploaded"))
    return (
        users.join(made, "id", "left")
        .join(sent, "id", "left")
        .fillna(0, ["total_orders", "completed_orders", "files_uploaded"])
    )


def system_summary(users: DataFrame, orders: DataFrame, files: DataFrame, active: Column) -> DataFrame:
    """One row with counts, a map of file formats and a list of the orders of each day."""
    people = users.agg(count_rows().alias("total_users"), F.count_if(active).alias("active_users"))
    sales = orders.agg(
        count_rows().alias("total_orders"), F.count_if(F.col("match_status") == "matched").alias("completed_orders")
    )
    formats = (
        files.groupBy("file_type")
        .agg(count_rows().alias("n"))
        .agg(
            F.sum("n").alias("total_files_processed"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_type", "n")))).alias("popular_file_formats"),
        )
    )
    daily = (
        orders.groupBy(F.col("creation_time").cast("date").alias("day"))
        .agg(count_rows().alias("orders"))
        .agg(F.array_sort(F.collect_list(F.struct("day", "orders"))).alias("daily_stats"))
    )

    def single(df: DataFrame) -> list[Column]:
        return [df.select(c).scalar().alias(c) for c in df.columns]

    return people.select("*", *single(sales), *single(formats), *single(daily))


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "endpoint").agg(count_rows().alias("requests"))


def duration_histogram(requests: DataFrame, seconds: Column, bounds: Sequence[float] = HISTOGRAM_BOUNDS) -> DataFrame:
    """Cumulative histogram in one pass: rows up to each bound, all rows under '+Inf', sum and count."""
    names = [f"{b:g}" for b in bounds] + ["+Inf"]
    counts = [F.count_if(seconds <= b) for b in bounds] + [F.count(seconds)]
    entries = [F.struct(F.lit(n).alias("le"), c.alias("requests")) for n, c in zip(names, counts)]
    total = F.coalesce(F.sum(seconds), F.lit(0)).cast("decimal(28,6)")
    return requests.agg(F.array(*entries).alias("_rows"), total.alias("total_seconds")).select(
        F.inline("_rows"), "total_seconds"
    )


def login_log(logins: DataFrame) -> DataFrame:
    """Attempts per day and outcome."""
    return logins.groupBy(F.col("seen_at").cast("date").alias("day"), "success").agg(count_rows().alias("attempts"))


# ---- sorts and pages ---------------------------------------------------------------------------


def page_of(df: DataFrame, page: int, size: int, order: Sequence[Column | str]) -> DataFrame:
    """One page; ``order`` must end in a unique key. Spark keeps only offset + size rows per task."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_info(df: DataFrame, page: int, size: int) -> DataFrame:
    return df.agg(count_rows().alias("total")).select(
        F.lit(page).cast("bigint").alias("page"),
        F.lit(size).cast("bigint").alias("page_size"),
        "total",
        page_count(F.col("total"), size).alias("pages"),
    )


def first_row(df: DataFrame, order: str = "id") -> DataFrame:
    return df.orderBy(order).limit(1)


def progress(files: DataFrame, total: str = "total_rows", step: int = 100, block: int = 10_000) -> DataFrame:
    """Progress marks of a file every ``step`` rows, from its row total alone.

    The marks follow from the total, so no row of the file is read again. Long files are first cut
    into blocks of marks that spread over the tasks, which also keeps every array short.
    """
    zero, width = F.lit(0).cast("bigint"), F.lit(step * block).cast("bigint")
    last = (F.col(total) - 1).cast("bigint")
    blocks = (
        files.filter(F.col(total) > 0)
        .withColumn("_block", F.explode(F.sequence(zero, last, width)))
        .repartition(*files.columns, "_block")
    )
    marks = F.sequence(F.col("_block"), F.least(last, F.col("_block") + width - 1), F.lit(step).cast("bigint"))
    return (
        blocks.withColumn("row_number", F.explode(marks))
        .drop("_block")
        .withColumn("progress", F.round(F.col("row_number") * 100.0 / F.col(total), 4).cast("double"))
    )
