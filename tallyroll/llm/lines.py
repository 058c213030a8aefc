"""Cross-site boilerplate: lines that stand on many different sites, found by merged HyperLogLog sketches.

Every line is reduced to two 64-bit hashes. One aggregation merges a sketch of the sites per line, with a
partial sketch on each machine first, so a line that a third of all documents hold costs no more than
another. Lines whose estimate lies near the threshold, within the sketch's error, get an exact count of
distinct sites. Of a boilerplate line the first occurrence (least id, then place) stays, so no text is lost.

Blank lines and lines below ``min_chars`` characters always stay. Null text counts as empty and stays null;
null sites do not count as sites. Repeated rows are equal in id and text: their first occurrences all stay.
An empty table gives an empty result. Columns that carry a result's name give way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyroll.llm.common import stored, together

LOG_BUCKETS = 12
ERROR = 1.04 / 2 ** (LOG_BUCKETS / 2)


def lines_of(df: DataFrame, id_column: str, text: str, site: str, min_chars: int) -> DataFrame:
    """(id, site, place, h1, h2, row) of every line that may be boilerplate."""
    lines = df.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{site}`").alias("site"),
        F.xxhash64(f"`{id_column}`", f"`{text}`").alias("row"),
        F.posexplode(F.split(F.col(f"`{text}`").cast("string"), "\n")).alias("place", "line"),
    )
    return lines.filter((F.length("line") >= min_chars) & F.col("line").rlike("[^\\x20\\x09-\\x0D]")).select(
        "id", "site", "row", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    )


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2, first) of the lines on at least ``min_sites`` sites; first is the least (id, place)."""
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "place"))
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_BUCKETS))).alias("sites"), first.alias("first"), F.count(F.lit(1)).alias("n"))
    margin = 4 * ERROR * min_sites + 0.5
    likely = stored(spread.filter((F.col("n") >= min_sites) & (F.col("sites") >= min_sites - margin)), "likely")
    near = likely.filter(F.col("sites") < min_sites + margin).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count("site").alias("exact")).filter(F.col("exact") >= min_sites)
    clear = likely.filter(F.col("sites") >= min_sites + margin)
    return stored(clear.union(likely.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi").select(*likely.columns)).select("h1", "h2", "first"), "boilerplate")


def without_boilerplate(
    df: DataFrame, min_sites: int = 5, min_chars: int = 20, id_column: str = "doc_id", text: str = "text", site: str = "source"
) -> DataFrame:
    """The rows of ``df``, boilerplate lines taken out of ``text``, with their number as ``removed_lines``."""
    columns = [c for c in df.columns if c != "removed_lines"]
    rows = df.select(together(df, columns), *[F.col(f"`{c}`").alias(n) for c, n in ((id_column, "_id"), (text, "_text"), (site, "_site"))])
    lines = lines_of(rows, "_id", "_text", "_site", min_chars)
    found = boilerplate(lines, min_sites)
    later = lines.join(found, ["h1", "h2"]).filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("place") == F.col("first.place"))))
    drops = later.groupBy("row").agg(F.collect_set("place").alias("_drops"))
    # Merged at every size: a broadcast that only small inputs allow would change the plan as they grow.
    drops = stored(drops.withColumnRenamed("row", "_of"), "drops").hint("merge")
    marked = rows.withColumn("_row", F.xxhash64("_id", "_text")).join(drops, F.col("_row") == F.col("_of"), "left")
    marked = marked.withColumn("_lines", F.when(F.col("_drops").isNotNull(), F.split(F.col("_text").cast("string"), "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drops")
    rest = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    new = F.when(F.col("_drops").isNotNull(), rest).otherwise(F.col("_text"))
    removed = F.when(F.col("_drops").isNotNull(), F.size("_drops")).otherwise(0).cast("long")
    return marked.select(
        *[(new if c == text else F.col("_kept").getField(c)).alias(c) for c in columns], removed.alias("removed_lines")
    )
