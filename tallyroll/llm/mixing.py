"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Every source gets the share of its weight of all words, but no more than ``epochs`` times its own. Sources
above that are clamped, and what they leave is shared again by weight among the rest, round by round until no
source is above. A source's target is whole repetitions of all its documents, plus one more repetition of
those that come first in a seeded order; the document on the edge repeats in part, so a source's words meet
its target to the word.

The seeded order is a hash of the id. Sizes are summed per source and bucket of the hash, which finds the
bucket of the edge; only that bucket's documents, about one in a thousand, are put into order, by ranges that Spark
cuts, so neither a source with a third of all rows nor an id that fills one meets in one task.

Only DataFrame functions are used. Null text has no words, a null source is a source of its own, and null ids
share one hash. Rows that tie in the order are told apart by their place in the table; if id and size are
equal, so are their results in any order. A source without words has target 0. An empty table gives an
empty result. Columns of the input that carry a result's name give way to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyroll.llm.common import beside_groups, stored, together
from tallyroll.operators.spread import row_numbers, running_sums

WORD = "[^\\x20\\x09-\\x0D]+"
RESULTS = ("size", "source_size", "target", "repeats", "part_words", "taken")
# Bits of the hash, and those that number its buckets.
HASH_BITS, BUCKET_BITS = 60, 10


def seeded(seed: int, doc_id: Column) -> Column:
    """60 bits of a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """The rows (_group, source_size) with ``target``, by clamping rounds.

    Groups take the weights in turn, in their order. Every round is one aggregate; the level only rises, so
    a clamped group stays clamped, and rounds end when none is added.
    """
    turn = F.get(F.array(*map(F.lit, weights)), ((F.col("_n") - 1) % len(weights)).cast("int"))
    named = row_numbers(sizes, [], ["_group"], "_n").withColumns({"_weight": turn, "_cap": epochs * F.col("source_size")}).drop("_n")
    named = stored(named, "sources")
    total, open_weight = named.agg(F.sum("source_size"), F.sum("_weight")).first()
    level = (total or 0) / (open_weight or 1)
    while True:
        full = F.col("_cap") <= F.col("_weight") * F.lit(level)
        taken, rest = named.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight")))).first()
        above = (total - (taken or 0)) / rest if rest else level
        if above <= level:
            break
        level = above
    return named.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_weight") * F.lit(level))).drop("_weight", "_cap")


def mix(
    df: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    epochs: int = 3,
    seed: int = 12,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (default all) with the words a mix takes of every document.

    ``repeats`` whole copies and the first ``part_words`` words once more make ``taken``.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in RESULTS]
    name = F.col(f"`{source}`").cast("string")
    rows = df.select(
        together(df, keep),
        F.struct(name.isNull().alias("none"), F.coalesce(name, F.lit("")).alias("name")).alias("_group"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        seeded(seed, F.col(f"`{doc_id}`")).alias("_order"),
        F.monotonically_increasing_id().alias("_row"),
    )
    bucket = F.shiftright("_order", HASH_BITS - BUCKET_BITS).cast("int")
    rows = stored(rows.withColumn("_bucket", bucket), "mix")
    buckets = stored(rows.groupBy("_group", "_bucket").agg(F.sum("size").alias("_size")), "buckets")
    plan = targets(buckets.groupBy("_group").agg(F.sum("_size").alias("source_size")), weights, epochs)
    plan = plan.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = plan.withColumn("_need", F.greatest(F.floor(F.col("target") + 0.5) - F.col("repeats") * F.col("source_size"), F.lit(0)))
    plan = stored(plan, "plan")
    # The bucket where the needed words of a source run out, and what is left for it.
    earlier = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = buckets.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).join(plan.select("_group", "_need"), "_group")
    edges = edges.filter((F.col("_before") < F.col("_need")) & (F.col("_need") <= F.col("_before") + F.col("_size")))
    edges = edges.select("_group", F.col("_bucket").alias("_edge"), (F.col("_need") - F.col("_before")).alias("_room"))
    plan = stored(plan.drop("_need").join(edges, "_group", "left").fillna({"_edge": -1, "_room": 0}), "plan")

    planned = beside_groups(rows, plan, "_group")
    clear = planned.filter(F.col("_bucket") != F.col("_edge"))
    clear = clear.withColumn("_more", F.when(F.col("_bucket") < F.col("_edge"), F.col("size")).otherwise(F.lit(0)))
    on_edge = running_sums(planned.filter(F.col("_bucket") == F.col("_edge")), ["_group"], ["_order", "size", "_row"], {"_sum": "size"})
    free = F.col("_room") - F.col("_sum") + F.col("size")
    on_edge = on_edge.withColumn("_more", F.greatest(F.least(free, F.col("size")), F.lit(0))).drop("_sum")
    done = clear.unionByName(on_edge)
    whole = (F.col("size") > 0) & (F.col("_more") == F.col("size"))
    return done.select(
        "_kept.*",
        "size",
        "source_size",
        "target",
        (F.col("repeats") + whole.cast("long")).alias("repeats"),
        F.when(whole, F.lit(0)).otherwise(F.col("_more")).cast("long").alias("part_words"),
        (F.col("repeats") * F.col("size") + F.col("_more")).alias("taken"),
    )


def copies(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mixed corpus: one row per copy, numbered from 1 in ``copy``, with the text that it takes.

    A copy in part holds its words joined by one space. Documents that the mix does not take have no row.
    """
    body = F.btrim(F.col(f"`{text}`"), F.lit(" \t\n\x0b\f\r"))
    head = F.array_join(F.slice(F.split(body, "[\\x20\\x09-\\x0D]+"), F.lit(1), F.col("part_words").cast("int")), " ")
    n = (F.col("repeats") + (F.col("part_words") > 0).cast("long")).cast("int")
    found = mixed.filter((F.col("size") > 0) & (n > 0)).withColumn("copy", F.explode(F.sequence(F.lit(1), n)))
    return found.withColumn(text, F.when(F.col("copy") > F.col("repeats"), head).otherwise(F.col(f"`{text}`")))
