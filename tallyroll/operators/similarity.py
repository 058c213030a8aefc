"""Files that hold nearly the same records, as an exact set-similarity join without pairs of equal files.

The similarity of two files is 100 * shared records / all records of both, over their different records.
Files of equal records form a class, and only its earliest file goes on. Two sets of the wanted similarity
share one of their few rarest records, so each file is listed under these alone, and a size and a position
bound thin the listed ones out before any sets are compared.

A record's list may be long (a template with thousands of variants). It is searched in blocks that double,
earliest files first: a file that has found its earliest partner leaves every list whose later blocks could
only give later ones, so variants of one template meet its first block and not each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyroll.operators.spread import join_dimension, row_numbers
from tallyroll.session import stored

FIRST_BLOCK = 32


def line_records(content: Column) -> Column:
    """Sorted 64-bit hashes of the different lines that are not blank; null for null."""
    lines = F.filter(F.split(content, "\r\n|\r|\n"), lambda line: F.trim(line) != "")
    return F.array_sort(F.array_distinct(F.transform(lines, lambda line: F.xxhash64(line))))


def needed(n: Column, m: Column, percent: int) -> Column:
    """The least number of shared records of sets of ``n`` and ``m`` records."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent))


def similar_files(files: DataFrame, percent: int = 90, first_block: int = FIRST_BLOCK) -> DataFrame:
    """(id, similarity, duplicate_of_id) of files (id, records), one row per file.

    A later file of equal records has 100 and the first such file. Any other has the earliest file of a
    smaller id that is at least ``percent`` alike and the similarity to it, else 0 and null. Files
    without records equal each other only; null records equal nothing. ``records`` holds no value twice.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    text = F.array_join(F.transform(F.array_sort("records"), lambda r: r.cast("string")), " ")
    keyed = stored(files.select("id", F.array_sort("records").alias("records"), F.sha2(text, 256).alias("_key")), "records")
    ids = keyed.select("id", "_key")
    copies = stored(ids.filter("_key is not null").groupBy("_key").agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n")), "classes")
    many = copies.filter("_n > 1")
    whole = stored(join_dimension(ids, many.select("_key", "_first"), "_key", counts=many.select("_key", "_n")), "assigned")
    later = whole.filter(F.col("id") != F.col("_first")).select(
        "id", F.lit(100.0).alias("similarity"), F.col("_first").alias("duplicate_of_id")
    )
    alone = whole.filter(F.col("_first").isNull() | (F.col("id") == F.col("_first"))).select("id")
    sets = keyed.join(copies.select(F.col("_first").alias("id")), "id", "left_semi").select("id", "records", F.size("records").alias("n"))
    found = near_sets(sets.filter("n > 0"), percent, first_block)
    partner = alone.join(found, "id", "left").select("id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "duplicate_of_id")
    return partner.unionByName(later)


def rarest_records(sets: DataFrame, percent: int) -> DataFrame:
    """(record, id, n, pos) for the rarest records of a set that it must share one of, ``pos`` from 1."""
    each = stored(sets.select("id", "n", F.explode("records").alias("record")), "each")
    shared = stored(each.groupBy("record").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "shared")
    counted = join_dimension(each, shared.select("record", F.col("_n").alias("_files")), "record", counts=shared)
    pair = F.struct(F.coalesce("_files", F.lit(1)).alias("files"), F.col("record"))
    ordered = counted.groupBy("id", "n").agg(F.array_sort(F.collect_list(pair)).alias("_r"))
    prefix = (F.col("n") - F.ceil(percent * F.col("n") / F.lit(100)) + 1).cast("int")
    listed = ordered.select("id", "n", F.posexplode(F.slice("_r", 1, prefix)).alias("_p", "_e"))
    return listed.filter("_e.files > 1").select("_e.record", "id", "n", (F.col("_p") + 1).alias("pos"))


def near_sets(sets: DataFrame, percent: int, first_block: int = FIRST_BLOCK) -> DataFrame:
    """(id, similarity, duplicate_of_id) for different sets (id, records, n) with an earlier one that near."""
    sets = stored(sets, "sets")
    lists = row_numbers(rarest_records(sets, percent), ["record"], ["id"], "_row")
    block = F.floor(F.log2((F.col("_row") - 1) / F.lit(first_block) + 1)).cast("int")
    lists = stored(lists.withColumn("_block", block), "lists")
    best = sets.sparkSession.createDataFrame([], f"id {dict(sets.dtypes)['id']}, best {dict(sets.dtypes)['id']}, shared long, n long, m long")
    last = lists.agg(F.max("_block")).first()[0]
    for number in range(0 if last is None else last + 1):
        best = stored(_with_block(lists, sets, best, number, percent), "best")
    return best.select(
        "id", (F.lit(100.0) * F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("similarity"),
        F.col("best").alias("duplicate_of_id"),
    )


def _with_block(lists: DataFrame, sets: DataFrame, best: DataFrame, number: int, percent: int) -> DataFrame:
    """The best partners so far after every list's block ``number`` has been searched for earlier ones."""
    members = lists.filter(F.col("_block") == number).select("record", F.col("id").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"))
    starts = members.groupBy("record").agg(F.min("other").alias("_start"))
    known = best.select("id", F.col("best").alias("_best"))
    seekers = lists.filter(F.col("_block") >= number).join(known, "id", "left").join(starts, "record")
    seekers = seekers.filter((F.col("id") > F.col("_start")) & (F.col("_best").isNull() | (F.col("_best") > F.col("_start"))))
    seekers = stored(seekers.select("record", "id", "n", "pos", "_best"), "seekers")
    least = needed(F.col("n"), F.col("m"), percent)
    most = F.least("pos", "at") + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    pairs = seekers.join(stored(members, "block"), "record").filter(
        (F.col("other") < F.col("id")) & (F.col("_best").isNull() | (F.col("other") < F.col("_best"))) & (most >= least)
    )
    pairs = stored(pairs.select("id", "other", "n", "m").distinct(), "candidates")
    mine = sets.select("id", F.col("records").alias("_mine"))
    theirs = sets.select(F.col("id").alias("other"), F.col("records").alias("_theirs"))
    counted = pairs.join(mine, "id").join(theirs, "other").withColumn("shared", F.size(F.array_intersect("_mine", "_theirs")).cast("long"))
    matched = counted.filter(F.col("shared") >= needed(F.col("n"), F.col("m"), percent)).select(
        "id", F.col("other").alias("best"), "shared", F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m")
    )
    return best.unionByName(matched).groupBy("id").agg(F.min_by(F.struct("best", "shared", "n", "m"), "best").alias("_b")).select("id", "_b.*")
