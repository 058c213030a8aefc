"""Pages far into a sorted table, without bringing all earlier rows to one task.

A bounded sample gives row values that cut the order into ranges, one pass counts the rows of every range, and only the
range that holds the page's first row is looked at again, until few rows lie between its beginning and the page. The
page is then the first rows of what follows that beginning, which Spark takes with a few rows per task. Nothing is
shuffled but the counts.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row, functions as F

# Sampled rows, ranges per round, and rows before the page that may be sorted with it.
SAMPLE, RANGES, NEAR = 4096, 64, 10_000


def sort_columns(order: Mapping[str, bool]) -> list[Column]:
    """Spark's own null order: first where values ascend, last where they descend."""
    return [F.desc(c) if down else F.asc(c) for c, down in order.items()]


def comes_after(order: Mapping[str, bool], place: Row, kinds: Mapping[str, str]) -> Column:
    """Whether a row sorts strictly behind a place, given by its order columns as text."""
    cases, equal = [], []
    for name, down in order.items():
        value = F.lit(place[name]).cast(kinds[name])
        if place[name] is None:
            behind = F.lit(False) if down else F.col(name).isNotNull()
        else:
            behind = (F.col(name) < value) | F.col(name).isNull() if down else F.col(name) > value
        cases.append(reduce(and_, [*equal, F.coalesce(behind, F.lit(False))]))
        equal.append(F.col(name).eqNullSafe(value))
    return reduce(or_, cases)


def page_start(df: DataFrame, skip: int, order: Mapping[str, bool]) -> tuple[Row | None, int] | None:
    """A place in the order, and how many rows to skip behind it to be ``skip`` rows into the table.

    The place is None for the beginning; without so many rows there is no start at all. At most NEAR rows are left to
    skip, unless ranges stop shrinking because ``order`` does not end in a unique key.
    """
    names, kinds = list(order), dict(df.dtypes)
    rows, place, before = df.select(*names), None, 0
    while skip - before > NEAR:
        # Least random numbers: at most SAMPLE rows per task and in the driver. Text reads back to the same value.
        sample = rows.orderBy(F.rand()).limit(SAMPLE).orderBy(*sort_columns(order)).select(*[F.col(n).cast("string") for n in names]).collect()
        step = max(1, len(sample) // RANGES)
        cuts = list(dict.fromkeys(sample[step - 1 :: step]))
        number = reduce(Column.__add__, [comes_after(order, c, kinds).cast("int") for c in cuts], F.lit(0))
        counts = dict(rows.groupBy(number.alias("range")).count().collect())
        at, passed = 0, before
        while at <= len(cuts) and passed + counts.get(at, 0) <= skip:
            passed += counts.get(at, 0)
            at += 1
        if at > len(cuts):
            return None
        if at:
            place, before = cuts[at - 1], passed
            rows = rows.filter(comes_after(order, place, kinds))
        if at < len(cuts):
            rows = rows.filter(~comes_after(order, cuts[at], kinds))
        if counts[at] == sum(counts.values()):
            break
    return place, skip - before


def deep_page(df: DataFrame, page: int, size: int, order: Mapping[str, bool]) -> DataFrame:
    """One page; ``order`` maps columns to whether they descend and must end in a unique key.

    A page beyond the end is empty. Pages near the beginning cost what ``page_of`` costs.
    """
    if page < 1 or size < 0:
        raise ValueError("pages count from 1, and their size is not negative")
    start = page_start(df, (page - 1) * size, order)
    if start is None:
        return df.limit(0)
    place, rest = start
    rows = df if place is None else df.filter(comes_after(order, place, dict(df.dtypes)))
    return rows.orderBy(*sort_columns(order)).offset(rest).limit(size)
