"""Exports and batch writes. Every writer takes a folder and leaves the work to Spark's tasks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tallyroll.functions.values import iso_text, shorten
from tallyroll.operators import analytics as A
from tallyroll.operators.relations import PART_ROWS, in_documents, with_orders

# Widths and rows of the preview, the mark and names of the information rows, change types.
VALUE_WIDTH = 30
NAME_WIDTH = 20
PREVIEW_ROWS = 100
INFO_MARK = "ORDER_INFO"
INFO_NAMES = ("order_number", "filename", "total_rows")
CHANGE_TYPES = ("new", "updated", "filled", "changed")


# ---- change exports ----------------------------------------------------------------------------


def change_rows(order: DataFrame, changes: DataFrame) -> DataFrame:
    """Three ORDER_INFO rows on top of the change rows, which name their order.

    ``order`` holds (order_number, filename, total_rows); without changes only the info remains.
    """
    info = order.select(
        F.posexplode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("new_value"))
                    for name in INFO_NAMES
                ]
            )
        ).alias("line", "_e")
    ).select(
        F.col("line").cast("bigint").alias("line"), F.lit(INFO_MARK).alias("row_number"), "_e.column_name", "_e.new_value",
        F.lit("info").alias("change_type"),
    )
    rows = changes.select(
        F.lit(len(INFO_NAMES)).cast("bigint").alias("line"), "order_id", "version",
        F.col("version").cast("string").alias("row_number"), F.col("field_name").alias("column_name"), "old_value", "new_value", "change_type",
        iso_text(F.col("changed_at")).alias("created_at"),
    )
    return info.unionByName(rows, allowMissingColumns=True)


def write_change_csv(order: DataFrame, changes: DataFrame, folder: str) -> None:
    """Change export as CSV in UTF-8, sorted; the byte-order mark is left out."""
    rows = change_rows(order, changes).orderBy("line", "order_id", "version", "column_name", "new_value")
    rows.select(
        "order_id", "row_number", "column_name", "old_value", "new_value", "change_type", "created_at"
    ).write.mode("errorifexists").csv(folder, header=True)


def change_documents(orders: DataFrame, changes: DataFrame, as_of: Column, part_rows: int = PART_ROWS) -> DataFrame:
    """{export_info, order, changes, summary} per order and version, the same form for all histories.

    The summary of a document counts its own changes, so the documents of an order add up. A version of more than
    ``part_rows`` changes goes on in documents of further parts.
    """
    entry = F.struct(
        F.col("version").alias("row_number"), F.col("field_name").alias("column_name"), "old_value", "new_value",
        "change_type", iso_text(F.col("changed_at")).alias("created_at"),
    )
    kept = in_documents(changes, ["field_name", "old_value", "new_value", "change_type", "changed_at"], part_rows)
    documents = kept.groupBy(F.col("order_id").alias("id"), "version", "part").agg(
        F.array_sort(F.collect_list(entry)).alias("changes"),
        A.count_rows().alias("total_changes"),
        *[F.count_if(F.col("change_type") == k).alias(f"_{k}") for k in CHANGE_TYPES],
    )
    whole = with_orders(documents, orders).fillna(0, ["total_changes", *[f"_{k}" for k in CHANGE_TYPES]])
    return whole.select(
        F.struct(
            F.col("id").alias("order_id"), "version", "part", iso_text(as_of).alias("export_date"), F.lit("json").alias("format")
        ).alias("export_info"),
        "order",
        "changes",
        F.struct(
            "total_changes", F.struct(*[F.col(f"_{k}").alias(k) for k in CHANGE_TYPES]).alias("by_type")
        ).alias("summary"),
    )


def write_change_json(orders: DataFrame, changes: DataFrame, as_of: Column, folder: str) -> None:
    """Documents as JSON lines in gzip: names and repeated heads are nine tenths of the plain text."""
    change_documents(orders, changes, as_of).write.mode("errorifexists").json(folder, compression="gzip")


def preview(changes: DataFrame) -> DataFrame:
    """First 100 changes with long texts cut, and a note saying how many there are."""
    total = changes.agg(A.count_rows()).scalar()
    first = changes.orderBy("order_id", "version", "field_name", "new_value", "old_value", "change_type").limit(PREVIEW_ROWS)
    return first.select(
        "order_id", "version", shorten(F.col("field_name"), NAME_WIDTH).alias("field_name"),
        shorten(F.coalesce("old_value", F.lit("")), VALUE_WIDTH).alias("old_value"),
        shorten(F.coalesce("new_value", F.lit("")), VALUE_WIDTH).alias("new_value"), "change_type",
        F.when(total > PREVIEW_ROWS, F.concat(F.lit(f"{PREVIEW_ROWS} of "), total.cast("string"))).alias("note"),
    )


# ---- reports -----------------------------------------------------------------------------------


def analytics_report(orders: DataFrame) -> DataFrame:
    """Sections of the report as rows (section, key, orders_count, total)."""
    summary = A.summary(orders).select(F.lit("summary").alias("section"), F.inline(F.array(
        *[
            F.struct(F.lit(k).alias("key"), n.cast("bigint").alias("orders_count"), F.col(c).cast("double").alias("total"))
            for k, n, c in (
                ("total_orders", F.col("total_orders"), "total_orders"),
                ("total_revenue", F.col("total_orders"), "total_revenue"),
                ("avg_order_value", F.col("total_orders"), "avg_order_value"),
            )
        ]
    )))

    def section(name: str, df: DataFrame, key: str, total: str) -> DataFrame:
        return df.select(
            F.lit(name).alias("section"), F.col(key).alias("key"), "orders_count", F.col(total).cast("double").alias("total")
        )

    payments = section("payment_types", A.by_code(orders, "payment_type"), "payment_type", "total")
    machines = section("top_machines", A.top_machines(orders), "machine_code", "total_revenue")
    return summary.unionByName(payments).unionByName(machines)


def file_history(files: DataFrame) -> DataFrame:
    """Name, size, upload date, status and rows of every file."""
    return files.select(
        F.col("original_name").alias("filename"), "file_size", iso_text(F.col("uploaded_at")).alias("upload_date"),
        F.col("processing_status").alias("status"), "total_rows", "processed_rows",
    )


# ---- appends -----------------------------------------------------------------------------------


def append_rows(
    df: DataFrame, folder: str, as_of: Column, batch: int, stamps: tuple[str, ...] = ("created_at", "updated_at")
) -> None:
    """Append a batch under its number; missing time stamps get ``as_of``. A repeated batch replaces itself."""
    present = [c for c in stamps if c in df.columns]
    filled = df.withColumns(
        {c: (F.coalesce(F.col(c), as_of) if c in present else as_of).cast("timestamp_ntz") for c in stamps}
    )
    filled.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def _csv(df: DataFrame, folder: str) -> None:
    df.write.mode("errorifexists").csv(folder, header=True)


def _json(df: DataFrame, folder: str) -> None:
    df.write.mode("errorifexists").json(folder)


# Export format -> writer; add an entry to support another format.
WRITERS: Mapping[str, Callable[[DataFrame, str], None]] = {"csv": _csv, "json": _json}


def export(df: DataFrame, kind: str, folder: str) -> None:
    if kind not in WRITERS:
        raise ValueError(f"unsupported export format: {kind}")
    WRITERS[kind](df, folder)
