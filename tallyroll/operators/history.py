"""Change capture: cleaning a delivery, comparing it with what is stored, and folding the log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyroll.functions import values as V
from tallyroll.operators.spread import carry_last, join_dimension

# The fields a change is looked for in.
COMPARED = ["machine_code", "order_price", "payment_type", "match_status"]
# The fields a new order's first version starts with.
BASE_FIELDS = ["order_number", "machine_code", "order_price"]


# ---- a delivery to typed rows ------------------------------------------------------------------


def keep_first(rows: DataFrame, keys: Sequence[str], order: str = "row_number") -> DataFrame:
    """First row per key; blank keys count as one. Aggregated before the shuffle, so hot keys are cheap."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("_row"))
        .select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
        .select(*rows.columns)
    )


def typed_rows(records: DataFrame, extra: Sequence[str] = (), flags: bool = False) -> DataFrame:
    """Records with a ``cells`` map to typed rows, aliases resolved; ``extra`` columns are kept.

    With ``flags`` a row also says which given values cannot be read: ``price_unfit`` and ``time_unread``.
    """
    filled = records.withColumn("cells", V.filled_cells(F.col("cells")))
    texts = filled.select(
        "file", "row_number", *extra, *[V.first_cell(F.col("cells"), names).alias(f) for f, names in V.FIELD_ALIASES.items()]
    )
    price, time = V.parse_price(F.col("order_price")), V.parse_time(F.col("creation_time"))
    marks = {
        "price_unfit": F.col("order_price").isNotNull() & price.isNull(),
        "time_unread": F.col("creation_time").isNotNull() & time.isNull(),
    }
    return texts.withColumns(
        {"order_number": F.coalesce("order_number", F.lit("")), "order_price": price, "creation_time": time}
        | (marks if flags else {})
    )


def clean_orders(rows: DataFrame, as_of: Column) -> DataFrame:
    """First row per file and order number, with defaults set."""
    return V.with_defaults(keep_first(rows, ["file", "order_number"]), as_of)


def typed_orders(records: DataFrame, as_of: Column, extra: Sequence[str] = ()) -> DataFrame:
    return clean_orders(typed_rows(records, extra), as_of)


def cell_log(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wide to long: (keys, column_name, new_value), nulls dropped, values as text."""
    names = [c for c in df.columns if c not in keys]
    texts = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in names])
    return texts.unpivot(list(keys), names, "column_name", "new_value").filter(F.col("new_value").isNotNull())


def value_pairs(fields: Sequence[str] = COMPARED) -> Column:
    """Array of (field_name, old_value, new_value, change_type) that builds a new row from nothing."""
    entries = [
        F.when(
            V.as_text(F.col(f)) != "",
            F.struct(
                F.lit(f).alias("field_name"), F.lit("").alias("old_value"), V.as_text(F.col(f)).alias("new_value"),
                F.lit("new").alias("change_type"),
            ),
        )
        for f in fields
    ]
    return F.array_compact(F.array(*entries))


def in_sequence(states: DataFrame, order: Sequence[str], key: str = "order_number", fields: Sequence[str] = COMPARED) -> DataFrame:
    """Adds to every delivered state of a key how it differs from the one before: ``first`` and ``changes``.

    The first state of a key has a ``new`` change for every field it sets. A key stands at most once in a
    file, so a window holds as many rows as there are files.
    """
    texts = {f for f in fields if dict(states.dtypes)[f] == "string"}
    before = F.lag(F.struct(*fields)).over(Window.partitionBy(key).orderBy(*order))
    beside = states.withColumns({"_o": before, "_n": F.struct(*fields)})
    return (
        beside.withColumn("first", F.col("_o").isNull())
        .withColumn("changes", F.when(F.col("first"), value_pairs(fields)).otherwise(_differences(fields, texts)))
        .drop("_o", "_n")
    )


# ---- comparing two snapshots -------------------------------------------------------------------


def _comparable(column: Column, is_text: bool) -> Column:
    return V.blank_to_null(column) if is_text else column


def _differences(fields: Sequence[str], texts: set[str]) -> Column:
    """Array of (field_name, old_value, new_value, change_type) over columns _o.f and _n.f."""
    entries = []
    for f in fields:
        old = _comparable(F.col(f"_o.{f}"), f in texts)
        new = _comparable(F.col(f"_n.{f}"), f in texts)
        entries.append(
            F.when(
                ~old.eqNullSafe(new),
                F.struct(
                    F.lit(f).alias("field_name"),
                    V.as_text(old).alias("old_value"),
                    V.as_text(new).alias("new_value"),
                    F.when(old.isNull(), "filled").otherwise("changed").alias("change_type"),
                ),
            )
        )
    return F.array_compact(F.array(*entries))


def compare(stored: DataFrame, incoming: DataFrame, key: str = "order_number", fields: Sequence[str] = COMPARED) -> DataFrame:
    """Full outer match on the key: (key, _o, _n, presence, changes). Both sides are unique on it."""
    texts = {f for f in fields if dict(incoming.dtypes)[f] == "string"}
    old = stored.select(key, F.struct(*stored.columns).alias("_o"))
    new = incoming.select(key, F.struct(*incoming.columns).alias("_n"))
    presence = (
        F.when(F.col("_o").isNull(), "only_new").when(F.col("_n").isNull(), "only_old").otherwise("both")
    )
    return (
        old.join(new, key, "full_outer")
        .withColumn("presence", presence)
        .withColumn(
            "changes",
            F.when(F.col("presence") == "both", _differences(fields, texts)),
        )
    )


def diff(stored: DataFrame, incoming: DataFrame, key: str = "order_number", fields: Sequence[str] = COMPARED) -> DataFrame:
    """(key, field_name, old_value, new_value, change_type) of every field that really differs."""
    texts = {f for f in fields if dict(incoming.dtypes)[f] == "string"}
    old = stored.select(key, F.struct(*fields).alias("_o"))
    new = incoming.select(key, F.struct(*fields).alias("_n"))
    return old.join(new, key).select(key, F.inline(_differences(fields, texts)))


def change_log(differences: DataFrame, as_of: Column, author: Column) -> DataFrame:
    """Differences as change-log rows with time and author."""
    return differences.withColumns({"changed_at": as_of.cast("timestamp_ntz"), "changed_by": author})


def classify(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One class per incoming order: new, updated or unchanged."""
    return (
        compare(stored, incoming)
        .filter(F.col("presence") != "only_old")
        .select(
            "order_number",
            F.when(F.col("presence") == "only_new", "new")
            .when(F.size("changes") > 0, "updated")
            .otherwise("unchanged")
            .alias("record_type"),
        )
    )


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next snapshot, with an ``action`` per row: inserted, updated, unchanged or kept."""
    same = stored.columns
    return resolve(compare(stored.select(*same), incoming.select(*same)))


def resolve(compared: DataFrame) -> DataFrame:
    """Snapshot rows and actions of a comparison."""
    action = (
        F.when(F.col("presence") == "only_new", "inserted")
        .when(F.col("presence") == "only_old", "kept")
        .when(F.size("changes") > 0, "updated")
        .otherwise("unchanged")
    )
    taken = F.when(F.col("action").isin("inserted", "updated"), F.col("_n")).otherwise(F.col("_o"))
    return compared.withColumn("action", action).select(taken.alias("_row"), "action").select("_row.*", "action")


def differences(compared: DataFrame, key: str = "order_number") -> DataFrame:
    """The field differences of a comparison, as ``diff`` gives them."""
    return compared.filter(F.col("presence") == "both").select(key, F.inline("changes"))


def action_counts(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("action").agg(F.count(F.lit(1)).alias("orders"))


def compare_keys(stored: DataFrame, incoming: DataFrame, key: str = "order_number") -> DataFrame:
    """(key, presence): only_old, only_new or both."""
    old = stored.select(key, F.lit(True).alias("_o"))
    new = incoming.select(key, F.lit(True).alias("_n"))
    return old.join(new, key, "full_outer").select(
        key,
        F.when(F.col("_o").isNull(), "only_new").when(F.col("_n").isNull(), "only_old").otherwise("both").alias("presence"),
    )


def last_value(column: str, order: Sequence[str]) -> Column:
    """Aggregate: the last non-null value in the order; rows that tie in it give the greatest value."""
    value = F.col(column)
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order, value)))


def partial_update(
    stored: DataFrame, incoming: DataFrame, key: str = "order_number", fields: Sequence[str] = COMPARED, order: Sequence[str] = ()
) -> DataFrame:
    """Stored rows with only the non-null incoming fields written over.

    Several incoming rows of a key count as written one after the other in ``order``: the last non-null value
    of each field stays, so every stored row comes out once. A null key meets nothing.
    """
    news = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(*[last_value(f, order).alias(f"_{f}") for f in fields])
    return (
        stored.join(news, key, "left")
        .withColumns({f: F.coalesce(f"_{f}", f) for f in fields})
        .select(*stored.columns)
    )


# ---- maintenance -------------------------------------------------------------------------------


def apply_status(rows: DataFrame, updates: DataFrame, as_of: Column, order: Sequence[str] = ()) -> DataFrame:
    """Status updates by id, with the start or finish time the status calls for.

    Several updates of an id are applied one after the other in ``order`` (ties: the greatest status): the last
    status and the last message stay. A time is written only by the statuses that call for it; all else, also
    what an id without updates has, keeps its earlier value. Every row comes out once.
    """
    now = as_of.cast("timestamp_ntz")
    started, finished = F.col("status") == "processing", F.col("status").isin("completed", "failed")
    new = updates.filter(F.col("id").isNotNull()).groupBy("id").agg(
        last_value("status", order).alias("_status"),
        last_value("error_message", order).alias("_message"),
        F.coalesce(F.bool_or(started), F.lit(False)).alias("_started"),
        F.coalesce(F.bool_or(finished), F.lit(False)).alias("_finished"),
    )
    have = set(rows.columns)

    def earlier(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    return (
        rows.join(new, "id", "left")
        .withColumns(
            {
                "error_message": F.coalesce("_message", earlier("error_message", "string")),
                "processing_started_at": F.when(F.col("_started"), now).otherwise(earlier("processing_started_at", "timestamp_ntz")),
                "processing_finished_at": F.when(F.col("_finished"), now).otherwise(earlier("processing_finished_at", "timestamp_ntz")),
                "processing_status": F.coalesce("_status", "processing_status"),
            }
        )
        .drop("_status", "_message", "_started", "_finished")
    )


def approve(users: DataFrame, ids: DataFrame, approver: int, as_of: Column) -> DataFrame:
    """Users on the list become approved; the rest stays."""
    listed = ids.select("id", F.lit(True).alias("_listed")).distinct()
    hit = F.coalesce("_listed", F.lit(False))
    return (
        users.join(listed, "id", "left")
        .withColumns(
            {
                "status": F.when(hit, "approved").otherwise(F.col("status")),
                "approved_by": F.when(hit, F.lit(approver).cast("bigint")),
                "approved_at": F.when(hit, as_of.cast("timestamp_ntz")),
            }
        )
        .drop("_listed")
    )


def purge_expired(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.filter(F.col("expires_at") >= as_of.cast("timestamp_ntz"))


def file_outcomes(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Files with processed flag and their total, new and updated rows; kept rows are not theirs."""
    totals = (
        snapshot.filter(F.col("action") != "kept")
        .groupBy(F.col("source_file_id").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if(F.col("action") == "inserted").alias("new_rows"),
            F.count_if(F.col("action") == "updated").alias("updated_rows"),
        )
    )
    return (
        files.join(totals, "id", "left")
        .withColumn("processed", F.col("total_rows").isNotNull())
        .fillna(0, ["total_rows", "new_rows", "updated_rows"])
    )


# ---- versions ----------------------------------------------------------------------------------


def versions(changes: DataFrame, orders: DataFrame | None = None, base: Sequence[str] = BASE_FIELDS) -> DataFrame:
    """One document per order and version: a map of the fields it set, last write per field.

    A version with a ``new`` change starts from the order's ``base`` fields, which the other changes of the
    version overwrite; without ``orders``, or for an order that is not known, it starts empty.
    """
    is_new = F.col("change_type") == "new"
    kept = changes.withColumn("field_name", F.when(~F.coalesce(is_new, F.lit(False)), F.col("field_name")))
    last = kept.groupBy("order_id", "version", "field_name").agg(
        F.max(F.struct("changed_at", "new_value")).alias("_w"), F.max("changed_at").alias("changed_at"), F.max(is_new).alias("new")
    )
    entry = F.when(F.col("field_name").isNotNull(), F.struct("field_name", "_w.new_value"))
    documents = last.groupBy("order_id", "version").agg(
        F.max("changed_at").alias("changed_at"), F.max("new").alias("new"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fields"),
    )
    if orders is None:
        return documents.drop("new")
    pairs = F.create_map(*[x for f in base for x in (F.lit(f), F.col(f).cast("string"))])
    heads = orders.select(F.col("id").alias("_order"), F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("_base"))
    found = join_dimension(documents, heads, "order_id", "_order")
    start = F.map_filter("_base", lambda k, v: ~F.map_contains_key("fields", k))
    fields = F.when(F.col("new") & F.col("_base").isNotNull(), F.map_concat(start, "fields")).otherwise(F.col("fields"))
    return found.select("order_id", "version", "changed_at", fields.alias("fields"))


def state_at_versions(changes: DataFrame, fields: Sequence[str] = COMPARED) -> DataFrame:
    """The state of every field as of each version, carried over versions that did not set it."""

    def last_write(field: str) -> Column:
        write = F.when(F.col("field_name") == field, F.struct("changed_at", "new_value"))
        return F.max(write)["new_value"].alias(field)

    wide = changes.groupBy("order_id", "version").agg(*[last_write(f) for f in fields])
    return carry_last(wide, ["order_id"], "version", fields)
