"""Filter interaction audit: what every filter removes in every order of the filters, and its Shapley share.

Each document gets a mask of the filters that it fails. Documents are counted per part and mask, and a part's
few masks give the documents that every coalition of filters removes: for five filters 32 numbers. The
Shapley share is the solution of the kernel-weighted least squares over all coalitions under the constraint
that the shares add up to what all filters remove together; its normal equations are solved in rationals, so
shares are exact. What a step of an order removes is the difference of two coalitions.

The filters look at one text each, but for copies, which fail if a smaller id has the same text anywhere in
the table. Texts meet by their SHA-256. Counts per (id, part, mask, text) come first, so a text that fills a
third of all rows reaches its group as a few partial rows, and labels are joined with salts for hot ids.

Null text is empty, null part is the empty name, and both meet their literal forms. A null id has no label,
is no copy, and makes no other text one. Repeated rows count each; rows of one id and text are not copies of
each other. A document is good or toxic if any of its label rows says so. An empty table gives no rows.
Columns beyond the named ones are not read, so their names do not matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyroll.llm.common import stored
from tallyroll.operators.spread import join_dimension

SPACE = "[\\x20\\x09-\\x0D]+"
MEASURES = ("documents", "good", "toxic")
SCHEMA = (
    "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column) -> dict[str, Column]:
    """Few words, few different words, many capitals, symbols: true where a text fails."""
    body = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def patterns(
    df: DataFrame,
    labels: DataFrame,
    failures: Mapping[str, Column] | None = None,
    copies: str = "E",
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> tuple[DataFrame, list[str]]:
    """Counts per (part, mask): ``documents``, ``good``, ``toxic``; and the filters in the order of their bits.

    ``failures`` are conditions over the column ``_text``; the filter ``copies`` comes after them.
    """
    failures = text_failures(F.col("_text")) if failures is None else failures
    names = [*failures, copies]
    rows = df.select(
        F.col(f"`{doc_id}`").alias("_id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"),
    )
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failures.values())]
    mask = sum(bits, F.lit(0))
    rows = rows.select("_id", "part", mask.alias("mask"), F.unhex(F.sha2("_text", 256)).alias("_hash"))
    each = stored(rows.groupBy("_id", "part", "mask", "_hash").agg(F.count(F.lit(1)).alias("documents")), "audit")
    marks = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic"),
    )
    marked = join_dimension(each, marks, "_id").withColumns(
        {m: F.col("documents") * F.coalesce(F.col(f"_{m}"), F.lit(0)) for m in ("good", "toxic")}
    )
    # Rows of the least id per text and part; those of the least id of the text are no copies.
    same = marked.groupBy("_hash", "part", "mask", F.col("_id").isNull().alias("_none")).agg(
        *[F.sum(m).alias(m) for m in MEASURES], F.min(F.struct("_id", *MEASURES)).alias("_first")
    )
    least = same.filter(~F.col("_none")).groupBy("_hash").agg(F.min("_first._id").alias("_least"))
    same = same.join(least, "_hash", "left")
    own = {
        m: F.when(F.col("_none"), F.col(m)).when(F.col("_first._id") == F.col("_least"), F.col(f"_first.{m}")).otherwise(F.lit(0))
        for m in MEASURES
    }
    kinds = F.explode(
        F.array(
            F.struct("mask", *[own[m].alias(m) for m in MEASURES]),
            F.struct((F.col("mask") + (1 << len(failures))).alias("mask"), *[(F.col(m) - own[m]).alias(m) for m in MEASURES]),
        )
    )
    counts = same.select("part", kinds.alias("_k")).select("part", "_k.*").filter("documents > 0")
    return counts.groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES]), names


def coalitions(masks: Sequence[Mapping[str, int]], n: int) -> dict[str, list[int]]:
    """Per measure, what each of the 2^n coalitions of filters removes, from a part's counts per mask."""
    return {m: [sum(int(r[m]) for r in masks if r["mask"] & s) for s in range(1 << n)] for m in MEASURES}


def solve(matrix: Sequence[Sequence[Fraction]], right: Sequence[Fraction]) -> list[Fraction]:
    """Solution of a regular system by elimination, in rationals."""
    rows = [[*line, value] for line, value in zip(matrix, right)]
    n = len(rows)
    for i in range(n):
        pivot = next(k for k in range(i, n) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i and rows[k][i]:
                rows[k] = [a - rows[k][i] * b for a, b in zip(rows[k], rows[i])]
    return [line[-1] for line in rows]


def shapley(removed: Sequence[int], n: int) -> list[Fraction]:
    """Shapley shares of ``n`` filters in what the coalitions remove, by constrained least squares.

    The last row and column hold the constraint and its multiplier.
    """
    matrix = [[Fraction(0)] * n + [Fraction(1)] for _ in range(n)] + [[Fraction(1)] * n + [Fraction(0)]]
    right = [Fraction(0)] * n + [Fraction(removed[-1])]
    for s in range(1, (1 << n) - 1):
        inside = [i for i in range(n) if s >> i & 1]
        k = len(inside)
        weight = Fraction(n - 1, math.comb(n, k) * k * (n - k))
        for i in inside:
            right[i] += weight * removed[s]
            for j in inside:
                matrix[i][j] += weight
    return solve(matrix, right)[:n]


def steps(part: str, size: int, values: Mapping[str, Sequence[int]], names: Sequence[str]) -> Iterator[tuple]:
    """The rows of SCHEMA for one part."""
    n, removed = len(names), values["documents"]
    every = (1 << n) - 1
    shares = [int(x * math.factorial(n)) for x in shapley(removed, n)] if n > 1 else [removed[1]]
    for order in itertools.permutations(range(n)):
        label, before = "".join(names[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = removed[after] - removed[before]
            yield (
                part, label, step, names[i], size - removed[after], here, removed[1 << i] - here,
                removed[every] - removed[every ^ 1 << i],
                values["good"][after] - values["good"][before], values["toxic"][after] - values["toxic"][before], shares[i],
            )
            before = after


def interactions(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step, from ``patterns``: the columns of SCHEMA.

    ``removed`` and ``kept`` count after the step, ``redundant`` what fails the filter but was gone before,
    ``unique_fails`` what fails no other filter; ``shapley`` sums the filter's removals over all orders.
    """
    names = list(names)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, size, masks in zip(frame["part"], frame["size"], frame["masks"]):
                yield pd.DataFrame(list(steps(part, int(size), coalitions(masks, len(names)), names)), columns=columns)

    # A part has at most 2^n masks.
    parts = counts.groupBy("part").agg(F.sum("documents").alias("size"), F.collect_list(F.struct("mask", *MEASURES)).alias("masks"))
    return parts.mapInPandas(rows, SCHEMA)
