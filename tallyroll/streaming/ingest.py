"""Incremental ingest of arriving files of all formats, with status steps, change log and run log.

The order table (``deltas.DeltaTable``) takes one delta per micro-batch, holding only inserted, updated and deleted
rows; the current state is the latest row per order number. A batch reads the buckets of its own order numbers in
a few merged pieces, and a repeated batch overwrites what it wrote. Files count in the order in which they arrived,
so the cut into batches does not change orders, log or totals. Views of the orders can be kept up to date along
the way (``views``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyroll.functions import values as V
from tallyroll.operators import history as H, quality as Q
from tallyroll.operators.analytics import count_rows
from tallyroll.session import stored
from tallyroll.sources import files as S
from tallyroll.streaming import views as W
from tallyroll.streaming.deltas import DeltaTable

ORDER_SCHEMA = (
    "order_number string, machine_code string, order_price decimal(20,2), payment_type string, "
    "creation_time timestamp_ntz, match_status string, file string, arrived timestamp, batch bigint, deleted boolean"
)
CHANGE_SCHEMA = (
    "order_number string, field_name string, old_value string, new_value string, change_type string, "
    "changed_at timestamp_ntz, changed_by bigint, file string, arrived timestamp, batch bigint"
)
STATUS_SCHEMA = (
    "file string, status string, errors array<string>, total_rows bigint, new_rows bigint, updated_rows bigint, "
    "rejected_rows bigint, batch bigint"
)
REJECT_SCHEMA = (
    "file string, row_number bigint, order_number string, machine_code string, order_price decimal(20,2), "
    "payment_type string, creation_time timestamp_ntz, failed_checks array<string>, batch bigint"
)
STEP_SCHEMA = "file string, step int, status string, at timestamp_ntz, batch bigint"
KINDS = {"changes": CHANGE_SCHEMA, "files": STATUS_SCHEMA, "rejects": REJECT_SCHEMA, "steps": STEP_SCHEMA}


def arriving_files(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Stream of (file, arrived, length, content) of all files; too large ones come without their content."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"

    def files() -> DataFrame:
        reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
        if per_trigger:
            reader = reader.option("maxFilesPerTrigger", per_trigger)
        found = reader.load(path).filter(~F.col("path").rlike("/[_.][^/]*$"))
        return found.withColumnsRenamed({"path": "file", "modificationTime": "arrived"})

    small = files().filter(F.col("length") <= S.MAX_FILE_BYTES).select("file", "arrived", "length", "content")
    large = files().filter(F.col("length") > S.MAX_FILE_BYTES).select("file", "arrived", "length")
    return small.unionByName(large, allowMissingColumns=True)


def read_kind(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(KINDS[kind]).parquet(f"{folder}/{kind}")


def latest(rows: DataFrame, whole: bool) -> DataFrame:
    """The last row of every order number; marks of deletion stay as long as older rows may lie elsewhere."""
    rest = [c for c in rows.columns if c != "order_number"]
    last = rows.groupBy("order_number").agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select("order_number", "_r.*")
    return last.filter(~F.col("deleted")) if whole else last


def order_table(spark: SparkSession, folder: str) -> DeltaTable:
    return DeltaTable(spark, f"{folder}/orders", ORDER_SCHEMA, ["order_number"], latest)


def current_orders(spark: SparkSession, folder: str, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Latest row per order number that is not deleted, optionally of earlier batches or of some order numbers only."""
    return order_table(spark, folder).current(before, keys).drop("deleted")


def purge_orders(spark: SparkSession, folder: str, batch_id: int, gone: Column, views: bool = False) -> None:
    """Delete the orders that meet a condition, as a batch of its own: marks of deletion, no rewriting."""
    known = stored(current_orders(spark, folder, batch_id).filter(gone), "purged")
    marks = known.withColumns({"batch": F.lit(batch_id).cast("bigint"), "deleted": F.lit(True)})
    commit(spark, folder, batch_id, marks, known if views else None)


def commit(spark: SparkSession, folder: str, batch_id: int, delta: DataFrame, known: DataFrame | None = None) -> None:
    """Add a stored delta to the order table; with the rows ``known`` before it, to the kept views as well."""
    if known is not None:
        W.apply(spark, folder, batch_id, known, delta.filter(~F.col("deleted")))
    table = order_table(spark, folder)
    table.append(batch_id, delta)
    table.merge(batch_id)
    table.clean()


def records_of(batch: DataFrame, states: DataFrame) -> DataFrame:
    """(file, row_number, cells, surplus, unclosed) of the valid files, each by the reader of its format.

    Delimited files give their records. Of the others only cells whose name is an order field come into the
    records; a JSON file is one row.
    """
    spark, kind = batch.sparkSession, S.extension(F.col("file"))
    columns = ["file", "row_number", "cells", "surplus", "unclosed"]
    valid = states.filter("valid")
    kinds = [r[0] for r in valid.select(kind).distinct().collect()]  # at most as many as there are formats
    large = [r["file"] for r in valid.filter("large").select("file").collect()]  # files of one trigger
    good = batch.filter(F.col("content").isNotNull()).join(valid.select("file"), "file", "left_semi").select("file", "content")
    parts = [spark.createDataFrame([], "file string, row_number bigint, cells map<string,string>, surplus int, unclosed boolean")]
    for ext, sep in (("csv", ","), ("tsv", "\t")):
        if ext in kinds:
            parts.append(S.delimited_records(good.filter(kind == ext), sep, lower_headers=True).select(columns))
        if paths := [p for p in large if p.lower().endswith(f".{ext}")]:
            parts.append(S.split_records(spark, paths, sep, lower_headers=True).select(columns))
    names = [a for aliases in V.FIELD_ALIASES.values() for a in aliases]
    for ext in (k for k in ("txt", "json", "xml", "zip") if k in kinds):
        cells = S.READERS[ext](good.filter(kind == ext))
        paths = [p for p in large if p.lower().endswith(f".{ext}")]  # texts only, the others are refused
        cells = (cells.union(S.SPLIT[ext](spark, paths)) if paths else cells).filter(F.col("column_name") != S.ERROR)
        name = F.lower(F.trim("column_name"))
        found = [F.min(F.when(name == n, F.col("new_value"))) for n in names]
        entries = F.create_map(*[x for n, v in zip(names, found) for x in (F.lit(n), v)])
        rows = cells.groupBy("file", "row_number").agg(F.map_filter(entries, lambda k, v: v.isNotNull()).alias("cells"))
        parts.append(rows.select("file", "row_number", "cells", F.lit(0).alias("surplus"), F.lit(False).alias("unclosed")))
    return reduce(DataFrame.union, parts)


def checks() -> dict[str, Column]:
    """What a row must meet to become an order."""
    return {
        "field_count": F.col("surplus") == 0,
        "closed_quotes": ~F.col("unclosed"),
        "price_fits": ~F.col("price_unfit"),
        "time_readable": ~F.col("time_unread"),
    }


def with_last(states: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Adds ``effective``, a delivered state that is new or changes something, and ``last``, the key's last of those."""
    beside = Window.partitionBy("order_number").orderBy(*order)
    marked = states.withColumn("effective", ~F.col("known") & (F.col("first") | (F.size("changes") > 0)))
    sofar = F.count_if("effective").over(beside.rowsBetween(Window.unboundedPreceding, 0))
    total = F.count_if("effective").over(beside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return marked.withColumn("last", F.col("effective") & (sofar == total))


def ingest_batch(batch: DataFrame, batch_id: int, folder: str, as_of: str, author: int, views: bool = False) -> None:
    """One micro-batch: validate, parse once, clean, compare in order of arrival, write what is new.

    Bad files and rows are recorded with their reasons; the run goes on. ``views`` keeps the aggregates too.
    """
    spark = batch.sparkSession
    now = F.lit(as_of).cast("timestamp_ntz")

    def write(df: DataFrame, kind: str, part: str = "") -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{kind}/batch={batch_id}{part}")

    def step(df: DataFrame, number: int, status: Column) -> DataFrame:
        return df.select("file", F.lit(number).alias("step"), status.alias("status"), now.alias("at"))

    started = batch.select("file")
    write(step(started, 0, F.lit("pending")).union(step(started, 1, F.lit("processing"))), "steps", "/part=0")
    checked = Q.validate_files(batch, "file", "content", "length", splittable=list(S.SPLIT))
    large = F.col("content").isNull() & (F.col("length") > 0)
    states = stored(checked.select("file", "arrived", "valid", "errors", large.alias("large")), "arrived")
    rows = H.typed_rows(records_of(batch, states), ["surplus", "unclosed"], flags=True)
    # A member of an archive arrived with its archive.
    source = F.regexp_extract("file", r"(?i)^(.*?\.zip)/", 1)
    rows = stored(rows.withColumn("source", F.when(source != "", source).otherwise(F.col("file"))), "rows")
    fitting, misfits = Q.quarantine(rows, checks())
    fields = ["order_number", *H.COMPARED, "creation_time", "file", "arrived"]
    arrivals = states.select(F.col("file").alias("source"), "arrived")
    # Rows without any order field, as of plain texts, are counted but give no order.
    orders = fitting.filter(F.greatest(*[F.col(c).isNotNull() for c in ("machine_code", "payment_type", "creation_time")]) | (F.col("order_number") != "") | (F.col("order_price") > 0))
    clean = H.clean_orders(orders.select("file", "row_number", "source", "order_number", "machine_code", "order_price", "payment_type", "creation_time"), now)
    incoming = clean.join(arrivals, "source").select(fields)
    if batch_id > 0:
        incoming = stored(incoming, "incoming")  # read for the keys and for the rows
        known = current_orders(spark, folder, batch_id, incoming).select(fields)
    else:
        known = spark.createDataFrame([], ORDER_SCHEMA).select(fields)
    both = known.withColumn("known", F.lit(True)).union(incoming.withColumn("known", F.lit(False)))
    order = [F.desc("known"), "arrived", "file"]
    compared = stored(with_last(H.in_sequence(both, order), order).filter(~F.col("known")), "compared")
    effective = compared.filter("effective")
    # Picked where the states were in sequence, so the delta needs no shuffle and no copy of its own.
    marks = {"batch": F.lit(batch_id).cast("bigint"), "deleted": F.lit(False)}
    delta = compared.filter("last").select(fields).withColumns(marks)
    before = known.join(delta.select("order_number"), "order_number", "left_semi") if views else None
    commit(spark, folder, batch_id, delta, before)
    log = effective.select("order_number", F.inline("changes"), "file", "arrived")
    write(H.change_log(log, now, F.lit(author).cast("bigint")).select(*[c.split()[0] for c in CHANGE_SCHEMA.split(", ")][:-1]), "changes")
    write(misfits.drop("surplus", "unclosed", "price_unfit", "time_unread", "source"), "rejects")
    totals = rows.groupBy(F.col("source").alias("file")).agg(count_rows().alias("total_rows"))
    bad = misfits.groupBy(F.col("source").alias("file")).agg(count_rows().alias("rejected_rows"))
    outcome = F.regexp_extract("file", r"(?i)^(.*?\.zip)/", 1)
    outcomes = compared.groupBy(F.when(outcome != "", outcome).otherwise(F.col("file")).alias("file")).agg(
        F.count_if("first").alias("new_rows"), F.count_if(~F.col("first") & (F.size("changes") > 0)).alias("updated_rows")
    )
    status = F.when(F.col("valid"), "completed").otherwise("failed")
    found = states.select("file", status.alias("status"), "errors")
    for other in (totals, outcomes, bad):
        found = found.join(other, "file", "left")
    write(found.fillna(0, ["total_rows", "new_rows", "updated_rows", "rejected_rows"]), "files")
    write(step(states, 2, status), "steps", "/part=1")


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """Progress messages: one per batch with running totals, then one 'completed' message.

    The window runs over one row per batch.
    """
    per_batch = read_kind(spark, folder, "files").groupBy("batch").agg(
        count_rows().alias("files"),
        F.count_if(F.col("status") == "failed").alias("failed_files"),
        F.sum("total_rows").alias("rows"),
    )
    sofar = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    running = per_batch.select(
        F.lit("progress").alias("type"), "batch", F.sum("files").over(sofar).alias("files"),
        F.sum("failed_files").over(sofar).alias("failed_files"), F.sum("rows").over(sofar).alias("processed_rows"),
    )
    done = per_batch.agg(
        F.lit("completed").alias("type"), F.max("batch").alias("batch"), F.sum("files").alias("files"),
        F.sum("failed_files").alias("failed_files"), F.sum("rows").alias("processed_rows"),
    )
    return running.unionByName(done)
