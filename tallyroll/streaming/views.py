"""Aggregates of the orders that are kept up to date from each batch's changes alone.

A batch hands over the rows that it replaces and the rows that stand in their place. The first count -1, the
second +1, and sums of these signed rows per view and name are the batch's delta; counts and sums can be taken
back, so the state is the sum of all deltas, whatever changed or went. A batch reads its own rows and nothing
else. The deltas are a ``DeltaTable``, whose merged pieces hold one row per view and name.

Views: totals (AGG-1), payment types (AGG-3), machines (AGG-5), days and months (AGG-6, AGG-14). Missing names
count as ``Unknown``, merged with a literal one; orders without a time are in no day and no month.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyroll.functions.values import or_default
from tallyroll.session import stored
from tallyroll.streaming.deltas import DeltaTable

SCHEMA = "view string, name string, orders bigint, priced bigint, revenue decimal(38,2)"
MEASURES = ("orders", "priced", "revenue")


def names() -> dict[str, Column]:
    """The name under which an order counts in each view."""
    time = F.col("creation_time")
    return {
        "total": F.lit(""),
        "payment_type": or_default(F.col("payment_type")),
        "machine": or_default(F.col("machine_code")),
        "day": F.date_format(time, "yyyy-MM-dd"),
        "month": F.date_format(time, "yyyy-MM"),
    }


def signed_sums(before: DataFrame, after: DataFrame) -> DataFrame:
    """(view, name, orders, priced, revenue) of the change from some orders' rows to others."""
    columns = ["machine_code", "payment_type", "order_price", "creation_time"]
    rows = before.select(*columns, F.lit(-1).alias("sign")).unionByName(after.select(*columns, F.lit(1).alias("sign")))
    kinds = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), n.alias("name")) for v, n in names().items()]))
    each = rows.select("order_price", "sign", kinds.alias("k")).filter("k.name is not null")
    sums = each.groupBy("k.view", "k.name").agg(
        F.sum("sign").alias("orders"),
        F.sum(F.when(F.col("order_price").isNotNull(), F.col("sign")).otherwise(0)).alias("priced"),
        F.coalesce(F.sum(F.col("order_price") * F.col("sign")), F.lit(0)).cast("decimal(38,2)").alias("revenue"),
    )
    return sums.filter("orders <> 0 or priced <> 0 or revenue <> 0")


def summed(rows: DataFrame, whole: bool) -> DataFrame:
    """One row per view and name; those without orders go once nothing older is left out."""
    sums = rows.groupBy("view", "name").agg(*[F.sum(m).alias(m) for m in MEASURES[:2]], F.sum("revenue").cast("decimal(38,2)").alias("revenue"))
    return sums.filter("orders > 0") if whole else sums


def table(spark: SparkSession, folder: str) -> DeltaTable:
    return DeltaTable(spark, f"{folder}/views", SCHEMA, ["view", "name"], summed)


def apply(spark: SparkSession, folder: str, batch_id: int, before: DataFrame, after: DataFrame) -> None:
    """Take a batch's changes into the views; a repeated batch replaces what it wrote."""
    kept = table(spark, folder)
    kept.append(batch_id, stored(signed_sums(before, after), "signed"))
    kept.merge(batch_id)
    kept.clean()


def current(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(view, name, orders, priced, revenue, average_price) after all batches, or those before one."""
    rows = table(spark, folder).current(before)
    return rows.withColumn("average_price", F.when(F.col("priced") > 0, F.col("revenue").cast("double") / F.col("priced")))


def change(spark: SparkSession, folder: str, begin: str, middle: str, end: str) -> DataFrame:
    """Orders and revenue of the days from ``middle`` up to ``end`` against those from ``begin`` (AGG-14)."""
    days = current(spark, folder).filter((F.col("view") == "day") & F.col("name").between(begin, end))
    now = F.col("name") >= middle
    return days.agg(
        *[F.coalesce(F.sum(F.when(now, F.col(m))), F.lit(0)).alias(m) for m in ("orders", "revenue")],
        *[F.coalesce(F.sum(F.when(~now, F.col(m))), F.lit(0)).alias(f"earlier_{m}") for m in ("orders", "revenue")],
    )


@dataclass
class TopNames:
    """The ``n`` names of a view with the most revenue, kept with a reserve.

    All names outside the list have at most ``bound`` revenue, as of the last full look or since they changed. A batch
    looks up its changed names only; whoever is above the bound is in the list or has just changed. When
    fewer than ``n`` are left above it, the whole view is read once more.
    """

    view: str
    n: int = 10
    reserve: int = 20
    best: Sequence[tuple] = ()
    bound: object = None
    full_looks: int = 0

    def update(self, spark: SparkSession, folder: str, batch_id: int) -> list[tuple]:
        """(name, revenue, orders) of the best after a batch, which the views have taken in."""
        kept, size = table(spark, folder), self.n + self.reserve
        pieces = kept.pieces(batch_id + 1)

        def top(rows: DataFrame) -> list[tuple]:
            ordered = rows.filter(F.col("view") == self.view).select("name", "revenue", "orders").orderBy(F.desc("revenue"), "name")
            return [tuple(r) for r in ordered.limit(size + 1).collect()]

        if self.bound is not None:
            changed = delta_names(kept, batch_id).filter(F.col("view") == self.view)
            listed = spark.createDataFrame([(self.view, b[0]) for b in self.best], "view string, name string")
            looked_up = changed.unionByName(listed).distinct()
            found = top(summed(kept.rows(pieces, looked_up), True).filter(F.col("revenue") > F.lit(self.bound)))
            if len(found) >= self.n:
                self.best, self.bound = found[:size], max(self.bound, found[size][1]) if len(found) > size else self.bound
                return list(self.best[: self.n])
        found = top(summed(kept.rows(pieces), True))
        self.full_looks += 1
        self.best, self.bound = found[:size], found[size][1] if len(found) > size else None
        return list(self.best[: self.n])


def delta_names(kept: DeltaTable, batch_id: int) -> DataFrame:
    """(view, name) that a batch changed, from its own piece."""
    own = [p for p in kept.committed(batch_id) if p not in kept.pieces(batch_id)]
    return kept.rows(own).select("view", "name")
