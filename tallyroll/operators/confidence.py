"""How sure a match is: agreement weights of fields, fitted to the matches themselves.

Each candidate pair of records agrees in every field to some level, or a side has no value there. Pairs are
counted per pattern of levels, and the few counted patterns are all that expectation maximisation works on: a
pair is a true match with some probability, and true and accidental pairs reach each level with probabilities of
their own, fields taken as independent. A pair's confidence is the fitted probability that it is true.
The fit goes through the patterns in their order, so the order of rows has no influence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

# More patterns than this are not collected.
MOST_PATTERNS = 10_000


@dataclass
class Fit:
    """``share`` of true pairs; per field the probabilities of the levels among true and among accidental pairs."""

    share: float
    true: dict[str, list[float]]
    accidental: dict[str, list[float]] = field(default_factory=dict)

    def posterior(self, pattern: Mapping[str, int | None]) -> float:
        a, b = self.share, 1 - self.share
        for name, level in pattern.items():
            if level is not None:
                a, b = a * self.true[name][level], b * self.accidental[name][level]
        return a / (a + b) if a + b > 0 else 0.0


def step(fit: Fit, patterns: Sequence[tuple[Mapping[str, int | None], int]]) -> Fit:
    """One round: the expected number of true pairs per pattern, then the probabilities that fit them best.

    A field that no pair has on both sides keeps its probabilities.
    """
    weights = [(pattern, n, n * fit.posterior(pattern)) for pattern, n in patterns]
    total = sum(n for _, n, _ in weights)

    def levels(name: str, old: Sequence[float], true: bool) -> list[float]:
        sums = [0.0] * len(old)
        for pattern, n, g in weights:
            if pattern[name] is not None:
                sums[pattern[name]] += g if true else n - g
        every = sum(sums)
        return [s / every for s in sums] if every > 0 else list(old)

    return Fit(
        sum(g for _, _, g in weights) / total if total else fit.share,
        {name: levels(name, old, True) for name, old in fit.true.items()},
        {name: levels(name, old, False) for name, old in fit.accidental.items()},
    )


def counted(pairs: DataFrame, fields: Sequence[str]) -> list[tuple[dict[str, int | None], int]]:
    """(pattern, number of pairs) in the order of the levels, missing ones first."""
    rows = pairs.groupBy(*fields).agg(F.count(F.lit(1)).alias("_n")).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} patterns of {', '.join(fields)}")
    found = [({f: r[f] for f in fields}, r["_n"]) for r in rows]
    return sorted(found, key=lambda x: [(v is not None, v or 0) for v in x[0].values()])


def fitted(patterns: Sequence[tuple[Mapping[str, int | None], int]], start: Fit, steps: int = 30) -> Fit:
    fit = start
    for _ in range(steps):
        fit = step(fit, patterns)
    return fit


def with_confidence(pairs: DataFrame, start: Fit, steps: int = 30) -> DataFrame:
    """The pairs with ``confidence``, from their columns of levels (0 up to the number of levels, or null).

    ``pairs`` are read twice, so they should be a stored table. The patterns' confidences go back as an expression.
    """
    fields = list(start.true)
    patterns = counted(pairs, fields)
    fit = fitted(patterns, start, steps)
    if not patterns:
        return pairs.withColumn("confidence", F.lit(None).cast("decimal(3,2)"))
    rows = [(*[p[f] for f in fields], fit.posterior(p)) for p, _ in patterns]
    schema = ", ".join(f"`_{f}` int" for f in fields) + ", _posterior double"
    known = pairs.sparkSession.createDataFrame(rows, schema)  # at most MOST_PATTERNS rows
    same = F.lit(True)
    for f in fields:
        same = same & pairs[f].eqNullSafe(known[f"_{f}"])
    found = pairs.join(F.broadcast(known), same)
    return found.withColumn("confidence", F.round("_posterior", 2).cast("decimal(3,2)")).select(*pairs.columns, "confidence")


def agreement(left: Column, right: Column) -> Column:
    """1 where both values are there and equal, 0 where they differ, null where one is missing."""
    return (left == right).cast("int")


def level_of(value: Column, bounds: Sequence[float]) -> Column:
    """Number of bounds that a value exceeds."""
    return sum((F.when(value > b, 1).otherwise(0) for b in bounds), F.lit(0))
