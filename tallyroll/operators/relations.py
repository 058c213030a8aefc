"""Joins between users, files, orders, changes and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyroll.operators.analytics import count_rows, money_sum
from tallyroll.operators.spread import in_parts, join_dimension, key_counts, next_in_group, running_sums

# The most changes that one document holds.
PART_ROWS = 1000


def pending_users_with_stats(users: DataFrame, orders: DataFrame) -> DataFrame:
    """Pending users with their order count and spending, zero when they have none."""
    totals = orders.groupBy(F.col("created_by").alias("id")).agg(
        count_rows().alias("orders_count"), money_sum().alias("total_spent")
    )
    return (
        users.filter(F.col("status") == "pending")
        .join(totals, "id", "left")
        .withColumns(
            {
                "orders_count": F.coalesce("orders_count", F.lit(0).cast("bigint")),
                "total_spent": F.coalesce("total_spent", F.lit(0).cast("decimal(18,2)")),
            }
        )
    )


def files_with_stats(files: DataFrame, orders: DataFrame) -> DataFrame:
    """Files with the count and value of the orders that came from them."""
    totals = orders.groupBy(F.col("source_file_id").alias("id")).agg(
        count_rows().alias("orders_count"), money_sum().alias("total_value")
    )
    return files.join(totals, "id", "left").withColumns(
        {
            "orders_count": F.coalesce("orders_count", F.lit(0).cast("bigint")),
            "total_value": F.coalesce("total_value", F.lit(0).cast("decimal(18,2)")),
        }
    )


def enrich_orders(orders: DataFrame, users: DataFrame, files: DataFrame) -> DataFrame:
    """Orders with their creator's name and their file's name; one creator may own a third of them."""
    people = users.select(F.col("id").alias("_user"), F.col("username").alias("creator_name"))
    sources = files.select(F.col("id").alias("_file"), F.col("original_name").alias("source_file"))
    counts = key_counts(orders, ["created_by", "source_file_id"])
    named = join_dimension(orders, people, "created_by", "_user", counts=counts["created_by"])
    return join_dimension(named, sources, "source_file_id", "_file", counts=counts["source_file_id"])


def with_orders(documents: DataFrame, orders: DataFrame) -> DataFrame:
    """Documents (id, version, ...) with their ``order``; orders without one stand alone.

    An order may own a third of the documents. Documents of unknown orders drop out, whatever their version.
    """
    heads = orders.select("id", F.struct(*orders.columns).alias("order"))
    found = join_dimension(documents, heads, "id", how="inner")
    alone = heads.join(documents.select("id").distinct(), "id", "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)


def in_documents(changes: DataFrame, order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """Changes of known orders with the ``part`` of the document that they go to; changes without an order drop out."""
    return in_parts(changes.filter(F.col("order_id").isNotNull()), ["order_id", "version"], order, part_rows)


def nest_changes(orders: DataFrame, changes: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One document per order and version, (id, version, part, changes, order), changes in time order.

    The form is the same for short and long histories, and changes without a version are one version. More than
    ``part_rows`` changes go on in the documents of the next parts, so no document grows with a history.
    """
    order = ["changed_at", "field_name", "old_value", "new_value", "change_type"]
    entry = F.struct("changed_at", "version", *order[1:])
    documents = in_documents(changes, order, part_rows).groupBy(F.col("order_id").alias("id"), "version", "part").agg(
        F.array_sort(F.collect_list(entry)).alias("changes")
    )
    return with_orders(documents, orders)


def session_files(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Files that some given session's user uploaded since it began, latest first.

    A user's sessions come down to the earliest one, so a file is listed once.
    """
    since = sessions.groupBy(F.col("created_by").alias("_user")).agg(F.min("started_at").alias("_since"))
    found = join_dimension(files, since, "uploaded_by", "_user", how="inner")
    return found.filter(F.col("uploaded_at") >= F.col("_since")).drop("_since").orderBy(F.desc("uploaded_at"), "id")


def session_file_totals(sessions: DataFrame, files: DataFrame, size: str) -> DataFrame:
    """For every session the number and size of those files, without forming the pairs.

    A session's files are all files of its user less the ones before it, and the latter is a
    running sum over both kinds of rows in time order. Sessions without user or start have no files.
    """
    uploads = files.select(
        F.col("uploaded_by").alias("user"), F.col("uploaded_at").cast("timestamp_ntz").alias("time"),
        F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("id"), F.col(size).alias("size"),
    )
    starts = sessions.select(
        F.col("created_by").alias("user"), F.col("started_at").cast("timestamp_ntz").alias("time"),
        F.lit(0).alias("kind"), F.col("id"), F.lit(0).cast("bigint").alias("size"),
    )
    uploads = uploads.filter(F.col("user").isNotNull() & F.col("time").isNotNull())
    whole = F.col("user").isNotNull() & F.col("time").isNotNull()
    points = running_sums(uploads.unionByName(starts.filter(whole)), ["user"], ["time", "kind"], {"_n": "kind", "_s": "size"})
    totals = uploads.groupBy("user").agg(count_rows().alias("_all"), F.sum("size").alias("_all_size"))
    found = join_dimension(points.filter(F.col("kind") == 0), totals, "user")
    none = F.lit(0).cast("bigint")
    return found.select(
        "id",
        (F.coalesce("_all", F.lit(0)) - F.col("_n")).cast("bigint").alias("files"),
        (F.coalesce("_all_size", F.lit(0)) - F.coalesce("_s", F.lit(0))).cast("bigint").alias("bytes"),
    ).union(starts.filter(~whole).select("id", none, none))


def duplicate_files(files: DataFrame) -> DataFrame:
    """Similarity 100 and the first id for later files of equal hash, else 0 and null.

    One aggregate gives the first id and the number of copies of every hash, and only hashes with
    copies go into the join.
    """
    copies = (
        files.groupBy("content_hash")
        .agg(F.min("id").alias("_first"), count_rows().alias("_n"))
        .filter(F.col("_n") > 1)
    )
    later = F.col("id") != F.col("_first")
    return (
        join_dimension(
            files, copies.select("content_hash", "_first"), "content_hash", counts=copies.select("content_hash", "_n")
        )
        .withColumn("similarity", F.when(later, 100.0).otherwise(0.0))
        .withColumn("duplicate_of_id", F.when(later, F.col("_first")))
        .drop("_first")
    )


def users_by_token(tokens: DataFrame, users: DataFrame, live: Column) -> DataFrame:
    """Live tokens with their users; tokens of unknown users drop out."""
    people = users.select(F.col("id").alias("_user"), "username", "status", "role")
    return join_dimension(tokens.filter(live), people, "user_id", "_user", how="inner")


def split_batch(incoming: DataFrame, stored: DataFrame, key: str = "order_number") -> DataFrame:
    """Incoming rows marked ``new`` or ``existing``; both sides are unique on the key."""
    known = stored.select(key, F.lit(True).alias("_known"))
    return incoming.join(known, key, "left").withColumn(
        "batch_action", F.when(F.col("_known"), "existing").otherwise("new")
    ).drop("_known")


# ---- sessions ----------------------------------------------------------------------------------


def session_validity(sessions: DataFrame) -> DataFrame:
    """A new session of a user ends the earlier one: adds ``valid_until`` and ``is_latest``."""
    ends = next_in_group(sessions, ["user_id"], ["created_at", "id"], "created_at", "_next")
    return ends.withColumns(
        {
            "valid_until": F.least(F.coalesce("_next", F.col("expires_at")), F.col("expires_at")),
            "is_latest": F.col("_next").isNull(),
        }
    ).drop("_next")


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """The one live session of each user, by aggregation alone."""
    rest = [c for c in sessions.columns if c != "user_id"]
    return (
        sessions.groupBy("user_id")
        .agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("_s"))
        .select("user_id", "_s.*")
    )
