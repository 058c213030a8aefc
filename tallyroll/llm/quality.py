"""Quality rules: counts of every text, fixed base rules, and robust multivariate outliers.

Per language and source the minimum-covariance-determinant estimate (centre and scatter of the least
spread three quarters of the documents) is found by concentration steps, until no group's scatter
changes any more.
Each step is one aggregation: the groups' estimates go to the documents (broadcast up to a stated size,
salted beyond it), and documents are summed by group and distance bucket before anything is dealt by group.
Statistics are rounded to whole 1/4096, and sums of whole numbers do not depend on their order, so neither
do the verdicts.

Only DataFrame functions are used. Null text counts as empty; null language or source counts as an empty
name. Sources with few documents of a language share one estimate; languages whose shared documents are few
share one over all such languages, however many documents that has, where the least spreads keep the
scatter regular. So every document past the base rules has a distance. Repeated rows are judged each for itself. An empty table gives an empty result. Columns of the
input that carry a result's name give way to it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyroll.llm.common import beside_groups, empty, stored, together

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Statistics for the outlier test and the least standard deviation that is taken for each.
SPREADS = {"word_length": 0.05, "symbols": 0.10, "capitals": 0.08, "marks": 0.08, "repeats": 0.12}
UNIT = 4096
SHARE = 0.75
MIN_WORDS = 50
# Buckets per unit of the squared distance's logarithm.
BUCKETS = 32


def gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its power series."""
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi_square(d: int, share: float) -> float:
    """Quantile of the chi-square distribution with ``d`` degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_share(d / 2, mid / 2) < share else (low, mid)
    return high


def counted(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the counts of COUNTS and the helper counts _capitals, _marks.

    Windows are compared by a 64-bit hash of their three words, inside one text.
    """
    source = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    body = F.btrim(source, F.lit(" \t\n\x0b\f\r"))
    out = df.withColumn("_words", F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE)))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split(source, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.withColumns(
        {
            "_lines": lines,
            "_windows": F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.size("_words"), F.lit(3)) - 3),
                    lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
                )
            ),
        }
    )
    # Sorted (hash, place) of every window, where any repeats.
    order = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), order))
    twice = F.filter(
        "_sorted",
        lambda x, k: x["h"].eqNullSafe(F.get("_sorted", k - 1)["h"]) | x["h"].eqNullSafe(F.get("_sorted", k + 1)["h"]),
    )
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    out = out.withColumn("_places", F.when(F.col("_sorted").isNotNull(), places))
    # A repeated window covers three words, less those that the window before it covers already.
    steps = F.transform("_places", lambda p, k: F.least(F.lit(3), p - F.coalesce(F.get("_places", k - 1), p - 3)))
    return out.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(source, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
            "_capitals": F.regexp_count(source, F.lit("\\p{Lu}")),
            "_marks": F.regexp_count(source, F.lit("\\p{P}")),
        }
    ).drop("_words", "_lines", "_windows", "_sorted", "_places")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def statistics() -> list[Column]:
    """The transformed statistics in whole units, null for rows that the base rules reject."""
    words, chars = F.col("n_words"), F.col("word_chars")
    values = [
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("_capitals") / chars),
        F.sqrt(F.col("_marks") / chars),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    return [F.when(~F.col("base_failed"), F.round(v * UNIT).cast("long")).alias(f"_x{i}") for i, v in enumerate(values)]


def distance(d: int) -> Column:
    """Squared Mahalanobis distance by the centre _m and the triangular factor _l of the scatter."""
    z: list[Column] = []
    for i in range(d):
        rest = reduce(lambda a, b: a + b, [F.col(f"_l{i}{j}") * z[j] for j in range(i)], F.lit(0.0))
        z.append((F.col(f"_x{i}") / UNIT - F.col(f"_m{i}") - rest) / F.col(f"_l{i}{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in z])


def with_factor(sums: DataFrame, keys: Sequence[str], scale: float) -> DataFrame:
    """Centre and triangular factor of the scatter, times ``scale`` and plus the least spreads."""
    d, spreads = len(SPREADS), list(SPREADS.values())
    n = F.col("_n").cast("double")
    mean = [F.col(f"_s{i}").cast("double") / n / UNIT for i in range(d)]
    out = sums.select(
        *keys,
        *[mean[i].alias(f"_m{i}") for i in range(d)],
        *[
            ((F.col(f"_p{i}{j}").cast("double") / n / UNIT / UNIT - mean[i] * mean[j]) * scale + (spreads[i] ** 2 if i == j else 0)).alias(f"_c{i}{j}")
            for i in range(d)
            for j in range(i + 1)
        ],
    )
    for i in range(d):
        for j in range(i + 1):
            inner = reduce(lambda a, b: a + b, [F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}") for k in range(j)], F.lit(0.0))
            left = F.col(f"_c{i}{j}") - inner
            out = out.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(left, F.lit(spreads[i] ** 2 / 4))) if i == j else left / F.col(f"_l{j}{j}"))
    return out.drop(*[f"_c{i}{j}" for i in range(d) for j in range(i + 1)])


def log_volume() -> Column:
    """Logarithm of the scatter's determinant."""
    return reduce(lambda a, b: a + b, [2 * F.log(f"_l{i}{i}") for i in range(len(SPREADS))])


def grouped(scored: DataFrame, min_group: int) -> DataFrame:
    """The group of every language and source: (_names, _lang, _group), stored.

    The source itself, the language's few or, where those are below ``min_group`` too, all few.
    """
    sizes = scored.groupBy("_names").agg(F.count(F.lit(1)).alias("_size"))
    small = F.col("_size") < min_group
    sizes = stored(sizes.withColumn("_lang", F.col("_names.lang")), "sizes")
    few = sizes.filter(small).groupBy("_lang").agg((F.sum("_size") < min_group).alias("_lone"))
    own = sizes.join(few, "_lang", "left").withColumn("_lone", small & F.coalesce("_lone", F.lit(False)))
    group = F.when(F.col("_lone"), "all").when(small, "few").otherwise(F.concat(F.lit("="), "_names.source"))
    return stored(own.select("_names", F.struct(F.when(F.col("_lone"), "").otherwise(F.col("_lang")).alias("lang"), group.alias("name")).alias("_group")), "groups")


def closest(buckets: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums over the nearest SHARE of each group, from rows per (group, distance bucket)."""
    up_to = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    near = buckets.withColumns({"_before": F.coalesce(F.sum("_n").over(up_to), F.lit(0)), "_all": F.sum("_n").over(whole)})
    near = near.filter(F.col("_before") < F.ceil(F.col("_all") * SHARE))
    return near.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_n", *sums)])


def start(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First centre and scatter: median and interquartile range of each statistic, from counts of their values."""
    d = len(SPREADS)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_x{i}").alias("x")) for i in range(d)]))
    counts = scored.select(*keys, pairs.alias("_p")).groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*keys, F.col("_p.i").alias("_i"), F.floor(F.col("_p.x") / 16).alias("_v"), "_n")
    counts = counts.groupBy(*keys, "_i", "_v").agg(F.sum("_n").alias("_n"))
    group = Window.partitionBy(*keys, "_i")
    run = F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumns({"_run": run, "_all": F.sum("_n").over(group)})
    value = F.col("_v") * 16.0 / UNIT

    def quantile(i: int, q: float) -> Column:
        return F.min(F.when((F.col("_i") == i) & (F.col("_run") >= F.col("_all") * q), value))

    spreads = list(SPREADS.values())
    return counts.groupBy(*keys).agg(
        *[quantile(i, 0.5).alias(f"_m{i}") for i in range(d)],
        *[
            (F.greatest((quantile(i, 0.75) - quantile(i, 0.25)) / 1.349, F.lit(spreads[i])) if i == j else F.lit(0.0)).alias(f"_l{i}{j}")
            for i in range(d)
            for j in range(i + 1)
        ],
    )


def judge(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    keep: Sequence[str] | None = None,
    steps: int = 20,
    min_group: int = 200,
    confidence: float = 1 - 1e-5,
) -> DataFrame:
    """The columns ``keep`` (default all) with the counts, ``base_failed``, ``distance`` and ``kept``.

    Concentration steps end when no group's log determinant moves by more than the width of a distance bucket,
    below which a few documents on the edge may go back and forth, or after ``steps``. Groups below ``min_group``
    rows are pooled. ``distance`` is null for documents that fail the base rules.
    """
    d = len(SPREADS)
    results = [*COUNTS, "base_failed", "distance", "kept"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in results]
    names = F.struct(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))])
    rows = counted(df.select(together(df, keep), names.alias("_names"), F.col(f"`{text}`").alias("_text")), "_text").withColumn("base_failed", base_failed())
    rows = stored(rows.select("_kept", "_names", *COUNTS, "base_failed", *statistics()), "quality")
    x = [f"_x{i}" for i in range(d)]
    scored = rows.filter(~F.col("base_failed")).select("_names", *x)
    own = grouped(scored, min_group)
    keys = ["_group"]
    scored = beside_groups(scored, own, "_names").select("_group", *x)

    sums = {"_n": F.count(F.lit(1))} | {f"_s{i}": F.sum(x[i]) for i in range(d)}
    sums |= {f"_p{i}{j}": F.sum((F.col(x[i]) * F.col(x[j])).cast("decimal(20,0)")) for i in range(d) for j in range(i + 1)}
    scale = SHARE / gamma_share(d / 2 + 1, chi_square(d, SHARE) / 2)
    model = stored(start(scored, keys), "model")
    for _ in range(steps):
        bucket = F.floor(F.log(distance(d) + 1e-6) * BUCKETS).cast("int").alias("_bucket")
        near = beside_groups(scored, model, "_group").select("_group", *x, bucket).groupBy("_group", "_bucket").agg(*[c.alias(n) for n, c in sums.items()])
        last, model = model, stored(with_factor(closest(near, keys, [n for n in sums if n != "_n"]), keys, scale), "model")
        moved = model.select("_group", log_volume().alias("_new")).join(last.select("_group", log_volume().alias("_old")), "_group")
        if empty(moved.filter(F.abs(F.col("_new") - F.col("_old")) > 1 / BUCKETS)):
            break
    model = stored(own.join(model, "_group").drop("_group"), "model")
    # Documents that fail the base rules have no statistics, and their names may have no estimate.
    passed = beside_groups(rows.filter(~F.col("base_failed")), model, "_names").withColumn("distance", F.sqrt(distance(d)))
    passed = passed.select("_kept", *COUNTS, "base_failed", "distance")
    failed = rows.filter("base_failed").select("_kept", *COUNTS, "base_failed", F.lit(None).cast("double").alias("distance"))
    kept = F.coalesce(F.col("distance") <= math.sqrt(chi_square(d, confidence)), F.lit(False)).alias("kept")
    return passed.unionByName(failed).select("_kept.*", *results[:-1], kept)
