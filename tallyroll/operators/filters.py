"""Predicates of listings and exports; each gives a frame or a boolean column."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class OrderCriteria:
    """Every given field must hold; the ones left out do not restrict."""

    order_number: str | None = None
    machine_code: str | None = None
    payment_type: str | None = None
    match_status: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    change_type: str | None = None


def instant(text: str | None) -> Column | None:
    """Literal of an ISO date or time; None when it is absent or unreadable."""
    try:
        return F.lit(datetime.fromisoformat(text).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    except (TypeError, ValueError):
        return None


def contains_text(column: Column, text: str) -> Column:
    """Case-insensitive substring; % and _ inside the text are wildcards."""
    return column.ilike(f"%{text}%")


def in_period(df: DataFrame, time: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Both ends inclusive at the instant; a bare end date is that day's midnight."""
    low, high = instant(date_from), instant(date_to)
    if low is not None:
        df = df.filter(F.col(time) >= low)
    if high is not None:
        df = df.filter(F.col(time) <= high)
    return df


def with_change_type(orders: DataFrame, changes: DataFrame, change_type: str) -> DataFrame:
    """Orders that have a change of the type."""
    hits = changes.filter(F.col("change_type") == change_type).select(F.col("order_id").alias("id")).distinct()
    return orders.join(hits, "id", "left_semi")


def without_change_type(orders: DataFrame, changes: DataFrame, change_type: str) -> DataFrame:
    """Orders that have no change of the type."""
    hits = changes.filter(F.col("change_type") == change_type).select(F.col("order_id").alias("id")).distinct()
    return orders.join(hits, "id", "left_anti")


def filter_orders(orders: DataFrame, f: OrderCriteria, changes: DataFrame | None = None) -> DataFrame:
    if f.order_number:
        orders = orders.filter(contains_text(F.col("order_number"), f.order_number))
    for name in ("machine_code", "payment_type", "match_status"):
        value = getattr(f, name)
        if value:
            orders = orders.filter(F.col(name) == value)
    orders = in_period(orders, "creation_time", f.date_from, f.date_to)
    if f.change_type and changes is not None:
        orders = with_change_type(orders, changes, f.change_type)
    return orders


def present(column: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(F.trim(column.cast("string")) != "", F.lit(False))


def by_keys(df: DataFrame, key: str, wanted: Iterable[str] | DataFrame) -> DataFrame:
    """Rows whose key is among the wanted ones, a list or the first column of a frame; blank keys want nothing."""
    if not isinstance(wanted, DataFrame):
        wanted = df.sparkSession.createDataFrame([(k,) for k in wanted], df.select(key).schema)
    keys = wanted.select(F.col(wanted.columns[0]).alias(key)).filter(present(F.col(key)))
    return df.join(keys.distinct(), key, "left_semi")


def is_approved() -> Column:
    return F.col("status") == "approved"


def is_admin() -> Column:
    return F.col("role") == "admin"


def is_active_user() -> Column:
    return is_approved() & ~F.coalesce(F.col("is_deactivated"), F.lit(False))


def is_open_session() -> Column:
    return F.col("status").isin("started", "processing")


def is_live(as_of: Column) -> Column:
    return F.col("is_active") & (F.col("expires_at") > as_of.cast("timestamp_ntz"))


def has_prefix(column: Column, pattern: str) -> Column:
    """LIKE with the pattern as given, so _ stands for any one character."""
    return column.like(pattern)


def one_of(column: str, wanted: str | Iterable[str]) -> Column:
    return F.col(column).isin([wanted] if isinstance(wanted, str) else list(wanted))


def between(column: str, low: Column | None, high: Column | None) -> Column:
    """Both ends inclusive; an end that is not given is open."""
    ends = [F.col(column) >= low] * (low is not None) + [F.col(column) <= high] * (high is not None)
    return reduce(Column.__and__, ends, F.lit(True))


def row_bound(value: int | None) -> Column | None:
    return None if value is None else F.lit(value)


# Key of a change filter -> predicate of its value.
CHANGE_PREDICATES: Mapping[str, Callable[..., Column]] = {
    "change_type": lambda v: one_of("change_type", v),
    "columns": lambda v: one_of("column_name", v),
    "row_range": lambda v: between("row_number", row_bound(v.get("min")), row_bound(v.get("max"))),
    "date_range": lambda v: between("changed_at", instant(v.get("start")), instant(v.get("end"))),
}


def filter_changes(changes: DataFrame, spec: Mapping) -> DataFrame:
    """Changes that meet every predicate the filter names."""
    return changes.filter(reduce(Column.__and__, [CHANGE_PREDICATES[k](v) for k, v in spec.items()], F.lit(True)))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows that are wholly null go; other nulls become blank text."""
    return df.dropna("all").fillna("")


def worth_processing(files: DataFrame) -> DataFrame:
    """Only files that are not near copies of earlier ones."""
    return files.filter(F.col("similarity") < 90)
