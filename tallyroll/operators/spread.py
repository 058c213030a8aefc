"""Work on groups without ever holding one whole group in a task.

One key may hold a third of all rows. For ordered work Spark cuts the rows into ranges of (key, order) from a
sample, so ranges are even whatever the values are and a hot key spans many of them. The ranges are written
once; each is aggregated, a window runs over one row per key and range, and the row-level window only covers
the rows of one key in one range. Null keys form a group like any other, and null orders come first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyroll.session import stored

# A key with more than this share of the rows is hot; there can be at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


# ---- ordered work ------------------------------------------------------------------------------


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with the number of their range as ``_part``; equal (key, order) stay together."""
    return stored(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def beside(rows: DataFrame, parts: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The rows with ``values`` of their key and range; null keys meet each other."""
    other = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k_part"), *values)
    test = rows["_part"] == other["_k_part"]
    for k in keys:
        test = test & rows[k].eqNullSafe(other[f"_k_{k}"])
    return rows.join(other, test).drop("_k_part", *[f"_k_{k}" for k in keys])


def place(order: Sequence[str]) -> Column:
    """What the order columns compare by, nulls first."""
    return F.struct(*[c for o in order for c in (F.col(o).isNotNull().alias(f"_h_{o}"), F.col(o))])


def carried_sums(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Per (keys, range) the total over all earlier ranges, as ``<name>``."""
    per_part = rows.groupBy(*keys, "_part").agg(*[c.alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.withColumns({n: F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in sums})


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Adds per name the sum of a column over the group's rows up to and including this one."""
    rows = in_ranges(df, keys, order)
    before = carried_sums(rows, keys, {f"_b_{n}": F.sum(c) for n, c in sums.items()})
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = beside(rows, before, keys, [f"_b_{n}" for n in sums])
    return found.withColumns({n: F.col(f"_b_{n}") + F.sum(c).over(inside) for n, c in sums.items()}).select(*df.columns, *sums)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_number") -> DataFrame:
    """1-based number inside each group."""
    rows = in_ranges(df, keys, order)
    before = carried_sums(rows, keys, {"_start": F.count(F.lit(1))})
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    found = beside(rows, before, keys, ["_start"])
    return found.withColumn(name, (F.row_number().over(inside) + F.col("_start")).cast("bigint")).drop("_part", "_start")


def in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Numbers pieces of at most ``size`` rows of each group, in order, as ``part`` from 0.

    One count per group tells whether any group needs more than one piece; if none does, no rows are sorted for it.
    """
    if not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size).take(1):
        return df.withColumn("part", F.lit(0).cast("bigint"))
    numbered = row_numbers(df, keys, order, "_row")
    return numbered.withColumn("part", F.floor((F.col("_row") - 1) / F.lit(size)).cast("bigint")).drop("_row")


def carry_last(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Replace each value by the last non-null one so far; one row per key and range travels between ranges."""
    rows = in_ranges(df, keys, [order])
    closing = rows.groupBy(*keys, "_part").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), place([order]))).alias(f"_c_{v}") for v in values]
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    opening = closing.select(
        *keys, "_part", *[F.last(f"_c_{v}", ignorenulls=True).over(earlier).alias(f"_o_{v}") for v in values]
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = beside(rows, opening, keys, [f"_o_{v}" for v in values])
    return found.withColumns(
        {v: F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"_o_{v}")) for v in values}
    ).select(*df.columns)


def next_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``value`` of the following row in the group, null for the last one."""
    rows = in_ranges(df, keys, order)
    opening = rows.groupBy(*keys, "_part").agg(F.min_by(value, place(order)).alias("_first"))
    across = Window.partitionBy(*keys).orderBy("_part")
    following = opening.select(*keys, "_part", F.lead("_first").over(across).alias("_following"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    found = beside(rows, following, keys, ["_following"])
    return found.withColumn(name, F.coalesce(F.lead(value).over(inside), F.col("_following"))).select(*df.columns, name)


# ---- joins with hot keys -----------------------------------------------------------------------


def key_counts(fact: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """(key, _n) of every key column, from one pass over the fact."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys]))
    counts = fact.select(each.alias("_e")).filter("_e.v is not null").groupBy("_e").agg(F.count(F.lit(1)).alias("_n"))
    counts = stored(counts.select("_e.k", "_e.v", "_n"), "counts")
    kinds = dict(fact.dtypes)
    return {k: counts.filter(F.col("k") == k).select(F.col("v").cast(kinds[k]).alias(k), "_n") for k in keys}


def join_dimension(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    dim_key: str | None = None,
    how: str = "left",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join to a dimension that is unique on its key, safe for hot and null keys of the fact.

    A pre-aggregated count finds the hot keys; at most 1 / HOT_SHARE keys can be hot, so that list is always
    small enough to broadcast. A hot key's rows spread over as many salts as it has shares of HOT_SHARE, those
    without a key over 1 / HOT_SHARE, and only the dimension rows of hot keys are repeated to meet them.
    A caller that has counted the fact's keys already gives ``counts`` as (key, _n).
    """
    dim_key = dim_key or key
    if counts is None:
        counts = fact.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    share = counts.agg(F.sum("_n")).scalar() * HOT_SHARE
    hot = counts.filter(F.col("_n") > share).select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / share).cast("int").alias("_salts"))
    salts = F.when(F.col(key).isNull(), F.lit(round(1 / HOT_SHARE))).otherwise(F.coalesce("_salts", F.lit(1)))
    hashed = [c for c, kind in fact.dtypes if "map<" not in kind]
    left = fact.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*hashed), salts).cast("int")
    )
    right = (
        dim.join(F.broadcast(hot), F.col(dim_key) == F.col("_hot"), "left")
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_hot", "_salts")
        .withColumnsRenamed({c: f"_d_{c}" for c in dim.columns})
    )
    joined = left.join(right, (F.col(key) == F.col(f"_d_{dim_key}")) & (F.col("_salt") == F.col("_copy")), how)
    keep = [c for c in dim.columns if c != dim_key]
    return joined.select(*fact.columns, *[F.col(f"_d_{c}").alias(c) for c in keep])
