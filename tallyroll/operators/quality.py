"""Checks of files, rows and reconciled orders."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyroll.sources.files import FORMATS, MAX_FILE_BYTES, extension, mime_type

# Allowed codes.
MATCH_STATUSES = ["matched", "unmatched", "partial"]
PAYMENT_TYPES = ["Cash", "Card", "Digital"]


@F.pandas_udf(T.BooleanType())
def _is_broken(kind: pd.Series, content: pd.Series) -> pd.Series:
    """Whether JSON, XML or ZIP bytes cannot be read whole; null where no content is given."""

    def broken(k: str, data: bytes):
        if data is None:
            return None
        try:
            if k == "json":
                json.loads(bytes(data).decode("utf-8"))
                return False
            if k == "xml":
                ElementTree.fromstring(bytes(data))
                return False
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return z.testzip() is not None
        except Exception:
            return True

    return pd.Series([broken(k, d) for k, d in zip(kind, content)], dtype=object)


def validate_files(
    files: DataFrame, name: str, content: str, length: str | None = None, splittable: Sequence[str] = ()
) -> DataFrame:
    """Adds file_type, file_size, mime_type, errors and valid.

    ``length`` names a column with the size, for files too large to have been loaded; those of a
    ``splittable`` format are valid.

    An unknown extension, excess size or an empty file stops the check of that file. Only JSON, XML
    and ZIP contents go to Python (Spark's own JSON parser overlooks what follows the first value);
    everything else is decided in the JVM.
    """
    data = F.col(content).cast("binary")
    text = data.cast("string")
    size = F.col(length) if length else F.octet_length(data).cast("bigint")
    ext = F.col("file_type")
    opened = F.col("file_size").between(1, MAX_FILE_BYTES)
    utf8 = F.is_valid_utf8(text)
    cyrillic = ~F.decode(data, "ISO-8859-1").contains("\u0098")
    deep = F.when(ext.isin("json", "xml", "zip") & opened, data)

    first = (
        F.when(~ext.isin(list(FORMATS)), F.concat(F.lit("unsupported format: "), ext))
        .when((F.col("file_size") > MAX_FILE_BYTES) & ~ext.isin(list(splittable)), "file too large")
        .when(F.col("file_size") == 0, "file is empty")
    )
    delimited = ext.isin("csv", "tsv")
    second = (
        F.when(delimited & utf8 & ~text.rlike(r"(?U)\S"), "no data")
        .when(delimited & ~utf8 & ~cyrillic, "unknown encoding")
        .when((ext == "json") & F.col("_broken"), "invalid JSON")
        .when((ext == "xml") & F.col("_broken"), "invalid XML")
        .when((ext == "pdf") & ~text.startswith("%PDF"), "invalid PDF")
        .when((ext == "zip") & F.col("_broken"), "damaged ZIP archive")
    )
    return (
        files.withColumns({"file_type": extension(F.col(name)), "file_size": size})
        .withColumn("mime_type", mime_type(ext))
        .withColumn("_broken", _is_broken(ext, deep))
        .withColumn("errors", F.array_compact(F.array(F.coalesce(first, second))))
        .withColumn("valid", F.size("errors") == 0)
        .drop("_broken")
    )


def quarantine(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split into good rows and bad ones with the names of the failed checks; the run goes on."""
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    )
    marked = df.withColumn("failed_checks", failed)
    return (
        marked.filter(F.size("failed_checks") == 0).drop("failed_checks"),
        marked.filter(F.size("failed_checks") > 0),
    )


def order_checks() -> dict[str, Column]:
    return {
        "key_present": F.coalesce(F.trim("order_number"), F.lit("")) != "",
        "price_not_negative": F.col("order_price").isNull() | (F.col("order_price") >= 0),
        "price_present": F.col("order_price").isNotNull(),
        "status_known": F.col("match_status").isin(MATCH_STATUSES),
        "payment_known": F.col("payment_type").isNull() | F.col("payment_type").isin(PAYMENT_TYPES),
        "machine_present": F.col("machine_code").isNotNull(),
    }


def domain_report(orders: DataFrame, users: DataFrame) -> DataFrame:
    """Violations per check: row checks in one pass, the reference to users over counted keys."""
    checks = order_checks()
    row_checks = orders.agg(
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()]
    ).unpivot([], list(checks), "check_name", "violations")
    unknown = (
        orders.groupBy(F.col("created_by").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(users.select("id"), "id", "left_anti")
        .agg(F.lit("creator_exists").alias("check_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    )
    return row_checks.unionByName(unknown)


def conflicts(reconciled: DataFrame, first: str, others: Sequence[str], large: float = 1000.0) -> DataFrame:
    """Errors of reconciled orders: amounts that differ, several records, missing reports and orphans.

    All rules read the same wide row, so no join is needed. Of the rules but the one for several records, a source
    can break one.
    """
    main = F.col(f"{first}_amount")
    has_main = F.col(f"{first}_records") > 0

    def entry(kind: str, severity: Column, target: str, values: Column, hint: str) -> Column:
        return F.struct(
            F.lit(kind).alias("error_type"),
            severity.alias("severity"),
            F.lit(first).alias("source_table"),
            F.lit(target).alias("target_table"),
            values.alias("conflicting_values"),
            F.lit(hint).alias("suggested_resolution"),
            F.lit("open").alias("resolution_status"),
        )

    found = []
    for other in others:
        amount = F.col(f"{other}_amount")
        gap = F.abs(main - amount)
        severity = F.when(gap >= large, "high").otherwise("medium")
        both = F.to_json(F.struct(main.cast("string").alias(first), amount.cast("string").alias(other)))
        differs = F.when(gap > 0.01, entry("amount_mismatch", severity, other, both, "check the amounts"))
        number = F.col(f"{other}_records")
        has_other = number > 0
        missing = F.when(has_main & ~has_other, entry("missing_record", F.lit("low"), other, F.lit("{}"), "wait for the report"))
        orphan = F.when(~has_main & has_other, entry("orphan_record", F.lit("high"), other, F.lit("{}"), "find the order"))
        found.append(F.coalesce(differs, missing, orphan))
        several = F.to_json(F.struct(number.cast("string").alias("records"), amount.cast("string").alias(other)))
        found.append(F.when(number > 1, entry("duplicate_record", F.lit("medium"), other, several, "check for a double payment")))
    return reconciled.select("order_number", F.inline(F.array(*found))).filter("error_type is not null")


def error_rollup(errors: DataFrame) -> DataFrame:
    """Counts per type and severity with subtotals under 'all'."""
    return (
        errors.rollup("error_type", "severity")
        .agg(
            F.count(F.lit(1)).alias("errors"),
            F.count_if(F.col("resolution_status") == "open").alias("open_errors"),
            F.grouping("error_type").alias("_t"),
            F.grouping("severity").alias("_s"),
        )
        .select(
            F.when(F.col("_t") == 1, "all").otherwise(F.col("error_type")).alias("error_type"),
            F.when(F.col("_s") == 1, "all").otherwise(F.col("severity")).alias("severity"),
            "errors",
            "open_errors",
        )
    )
