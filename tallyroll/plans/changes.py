"""Change capture, versions and exports (CDC, WIN-3, WIN-4, SNK)."""

from pyspark.sql import functions as F

from tallyroll.functions import values as V
from tallyroll.operators import analytics as A, history as H
from tallyroll.plans.registry import query
from tallyroll.session import scratch_dir
from tallyroll.sinks import exports as X

NOW = "2024-02-01 08:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def _fields(template: str) -> str:
    """One branch per compared field, prices as text with two digits."""
    return " UNION ALL ".join(template.replace("@", f) for f in H.COMPARED)


DIFF_SQL = _fields(
    """SELECT s.order_number, '@' AS field_name, coalesce(cast(s.@ AS string), '') AS old_value,
        coalesce(cast(i.@ AS string), '') AS new_value,
        CASE WHEN s.@ IS NULL THEN 'filled' ELSE 'changed' END AS change_type
    FROM {stored_orders} s JOIN {incoming_orders} i USING (order_number) WHERE s.@ IS DISTINCT FROM i.@"""
)


@query("cdc_1_diff", DIFF_SQL)
def cdc_1(t):
    return H.diff(t.stored_orders, t.incoming_orders)


@query(
    "cdc_2_change_log",
    f"SELECT *, '{NOW}' AS changed_at, cast(7 AS bigint) AS changed_by FROM ({DIFF_SQL})",
)
def cdc_2(t):
    return H.change_log(H.diff(t.stored_orders, t.incoming_orders), now(), F.lit(7))


@query(
    "cdc_3_classify",
    f"""SELECT i.order_number, CASE WHEN s.order_number IS NULL THEN 'new' WHEN d.order_number IS NOT NULL THEN 'updated'
        ELSE 'unchanged' END AS record_type
    FROM {{incoming_orders}} i LEFT JOIN {{stored_orders}} s USING (order_number)
    LEFT JOIN (SELECT DISTINCT order_number FROM ({DIFF_SQL})) d USING (order_number)""",
)
def cdc_3(t):
    return H.classify(t.stored_orders, t.incoming_orders)


UPSERT_SQL = f"""SELECT CASE WHEN s.order_number IS NULL THEN 'inserted' WHEN i.order_number IS NULL THEN 'kept'
        WHEN d.order_number IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS action,
        coalesce(s.id, i.id) AS id, coalesce(s.order_number, i.order_number) AS order_number,
        CASE WHEN i.order_number IS NULL THEN s.machine_code ELSE i.machine_code END AS machine_code,
        cast(CASE WHEN i.order_number IS NULL THEN s.order_price ELSE i.order_price END AS double) AS order_price,
        CASE WHEN i.order_number IS NULL THEN s.payment_type ELSE i.payment_type END AS payment_type,
        CASE WHEN i.order_number IS NULL THEN s.match_status ELSE i.match_status END AS match_status,
        coalesce(s.source_file_id, i.source_file_id) AS source_file_id
    FROM {{stored_orders}} s FULL JOIN {{incoming_orders}} i ON s.order_number = i.order_number
    LEFT JOIN (SELECT DISTINCT order_number FROM ({DIFF_SQL})) d ON d.order_number = i.order_number"""
UPSERT_COLUMNS = ["action", "id", "order_number", "machine_code", "order_price", "payment_type", "match_status", "source_file_id"]


@query("cdc_4_upsert", UPSERT_SQL)
def cdc_4(t):
    return H.upsert(t.stored_orders, t.incoming_orders).select(UPSERT_COLUMNS)


@query("cdc_4_counts", f"SELECT action, count(*) AS orders FROM ({UPSERT_SQL}) GROUP BY 1")
def cdc_4_counts(t):
    return H.action_counts(H.upsert(t.stored_orders, t.incoming_orders))


# Two deliveries of fields to write over, the first of them in part; many orders are in both.
PARTIAL_SQL = """SELECT 1 AS seq, order_number, machine_code, order_price, payment_type, match_status FROM {incoming_orders}
    UNION ALL SELECT 0, order_number, 'VM-777', CASE WHEN created_by % 2 = 0 THEN order_price + 1 END, CAST(NULL AS string), 'partial'
    FROM {sales_orders} WHERE id % 3 = 0"""


@query(
    "cdc_5_partial_update",
    f"""WITH i AS (SELECT order_number, {", ".join(f"last({f} ORDER BY seq) FILTER ({f} IS NOT NULL) AS {f}" for f in H.COMPARED)}
        FROM ({PARTIAL_SQL}) GROUP BY order_number)
    SELECT s.order_number, coalesce(i.machine_code, s.machine_code) AS machine_code,
        cast(coalesce(i.order_price, s.order_price) AS double) AS order_price,
        coalesce(i.payment_type, s.payment_type) AS payment_type, coalesce(i.match_status, s.match_status) AS match_status
    FROM {{stored_orders}} s LEFT JOIN i USING (order_number)""",
)
def cdc_5(t):
    return H.partial_update(t.stored_orders, t.sql(PARTIAL_SQL), order=["seq"]).select("order_number", *H.COMPARED)


@query(
    "cdc_6_snapshot_compare",
    """SELECT coalesce(s.order_number, i.order_number) AS order_number,
        CASE WHEN s.order_number IS NULL THEN 'only_new' WHEN i.order_number IS NULL THEN 'only_old' ELSE 'both' END AS presence
    FROM {stored_orders} s FULL JOIN {incoming_orders} i ON s.order_number = i.order_number""",
)
def cdc_6(t):
    return H.compare_keys(t.stored_orders, t.incoming_orders)


@query(
    "cdc_7_cell_log",
    _fields("SELECT id, '@' AS column_name, cast(@ AS string) AS new_value FROM {sales_orders} WHERE @ IS NOT NULL")
    + " UNION ALL SELECT id, 'creation_time', cast(creation_time AS string) FROM {sales_orders}",
)
def cdc_7(t):
    return H.cell_log(t.sales_orders.select("id", *H.COMPARED, "creation_time"), ["id"])


# Files with earlier times and messages, and one to three updates of each labelled file, in the order of seq.
TRACKED_SQL = """SELECT id, processing_status, CASE WHEN id % 4 = 0 THEN 'earlier' END AS error_message,
        CASE WHEN id % 3 = 0 THEN cast('2023-05-06 07:08:09' AS timestamp) END AS processing_started_at,
        CASE WHEN id % 5 = 0 THEN cast('2023-05-06 08:09:10' AS timestamp) END AS processing_finished_at
    FROM {file_entries}"""
UPDATES_SQL = """SELECT doc_id AS id, 0 AS seq, 'processing' AS status, CAST(NULL AS string) AS error_message FROM {labels} WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 1, 'failed', 'first try' FROM {labels} WHERE toxic = 1
    UNION ALL SELECT doc_id, 2, CASE WHEN quality = 1 THEN 'completed' WHEN toxic = 1 THEN 'failed' ELSE 'processing' END,
        CASE WHEN quality = 0 AND toxic = 1 THEN 'rejected' END FROM {labels}"""


@query(
    "cdc_8_status_update",
    f"""WITH u AS (SELECT id, last(status ORDER BY seq) AS status, last(error_message ORDER BY seq) FILTER (error_message IS NOT NULL) AS message,
            bool_or(status = 'processing') AS started, bool_or(status IN ('completed', 'failed')) AS finished
        FROM ({UPDATES_SQL}) GROUP BY id)
    SELECT f.id, coalesce(u.status, f.processing_status) AS processing_status, coalesce(u.message, f.error_message) AS error_message,
        CASE WHEN u.started THEN '{NOW}' ELSE strftime(f.processing_started_at, '%Y-%m-%d %H:%M:%S') END AS processing_started_at,
        CASE WHEN u.finished THEN '{NOW}' ELSE strftime(f.processing_finished_at, '%Y-%m-%d %H:%M:%S') END AS processing_finished_at
    FROM ({TRACKED_SQL}) f LEFT JOIN u USING (id)""",
)
def cdc_8(t):
    tracked = t.sql(TRACKED_SQL)
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("processing_started_at", "processing_finished_at")}
    return H.apply_status(tracked.withColumns(times), t.sql(UPDATES_SQL), now(), ["seq"])


@query(
    "cdc_8_approve",
    f"""SELECT id, CASE WHEN hit THEN 'approved' ELSE status END AS status, CASE WHEN hit THEN cast(1 AS bigint) END AS approved_by,
        CASE WHEN hit THEN '{NOW}' END AS approved_at
    FROM (SELECT *, id IN (SELECT created_by FROM {{sales_orders}} WHERE match_status = 'partial') AS hit FROM {{app_users}})""",
)
def cdc_8_approve(t):
    buyers = t.sales_orders.filter(F.col("match_status") == "partial").select(F.col("created_by").alias("id"))
    return H.approve(t.app_users.select("id", "status"), buyers, 1, now())


@query(
    "cdc_9_purge",
    "SELECT id, token FROM {access_sessions} WHERE expires_at >= timestamp '2024-01-15 12:00:00'",
)
def cdc_9(t):
    return H.purge_expired(t.access_sessions, F.lit("2024-01-15 12:00:00")).select("id", "token")


@query(
    "cdc_10_file_outcomes",
    f"""SELECT f.id, r.id IS NOT NULL AS processed, coalesce(r.n, 0) AS total_rows, coalesce(r.a, 0) AS new_rows,
        coalesce(r.b, 0) AS updated_rows
    FROM {{file_entries}} f LEFT JOIN (SELECT source_file_id AS id, count(*) AS n, count(*) FILTER (action = 'inserted') AS a,
        count(*) FILTER (action = 'updated') AS b FROM ({UPSERT_SQL}) WHERE action <> 'kept' GROUP BY 1) r ON r.id = f.id""",
)
def cdc_10(t):
    snapshot = H.upsert(t.stored_orders, t.incoming_orders)
    return H.file_outcomes(t.file_entries.select("id"), snapshot).select(
        "id", "processed", "total_rows", "new_rows", "updated_rows"
    )


# ---- versions ----------------------------------------------------------------------------------

LAST_SQL = """SELECT order_id, version, field_name, last(new_value ORDER BY changed_at, new_value) AS new_value,
        max(changed_at) AS changed_at FROM {order_changes} GROUP BY 1, 2, 3"""


@query(
    "win_3_versions",
    """WITH v AS (SELECT order_id, version, max(changed_at) AS changed_at, bool_or(change_type = 'new') AS fresh FROM {order_changes} GROUP BY 1, 2),
    s AS (SELECT order_id, version, field_name, last(new_value ORDER BY changed_at, new_value) AS new_value FROM {order_changes}
        WHERE change_type <> 'new' GROUP BY 1, 2, 3),
    b AS (SELECT v.order_id, v.version, f AS field_name, CASE f WHEN 'order_number' THEN order_number WHEN 'machine_code' THEN machine_code
            ELSE cast(order_price AS string) END AS new_value
        FROM v JOIN {sales_orders} o ON o.id = v.order_id, (SELECT unnest(['order_number', 'machine_code', 'order_price']) AS f) WHERE fresh),
    u AS (SELECT * FROM s UNION ALL SELECT * FROM b WHERE new_value IS NOT NULL AND (order_id, version, field_name) NOT IN (SELECT order_id, version, field_name FROM s))
    SELECT v.order_id, v.version, cast(changed_at AS string) AS changed_at,
        coalesce(string_agg(field_name || '=' || new_value, ',' ORDER BY field_name), '') AS fields
    FROM v LEFT JOIN u ON u.order_id = v.order_id AND u.version = v.version GROUP BY 1, 2, 3""",
)
def win_3(t):
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return H.versions(t.order_changes, t.sales_orders).withColumn("fields", pairs)


@query(
    "win_4_state_at_version",
    "SELECT order_id, version, "
    + ", ".join(f"last_value({f} IGNORE NULLS) OVER w AS {f}" for f in H.COMPARED)
    + " FROM (SELECT order_id, version, "
    + ", ".join(f"max(new_value) FILTER (field_name = '{f}') AS {f}" for f in H.COMPARED)
    + f" FROM ({LAST_SQL}) GROUP BY 1, 2) WINDOW w AS (PARTITION BY order_id ORDER BY version ROWS UNBOUNDED PRECEDING)",
)
def win_4(t):
    return H.state_at_versions(t.order_changes)


# ---- exports: written, then read back ----------------------------------------------------------

CHANGE_ROWS_SQL = """SELECT order_id, cast(version AS string) AS row_number, field_name AS column_name, old_value, new_value, change_type,
        strftime(changed_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM {order_changes}"""


@query(
    "snk_1_change_csv",
    f"""WITH n AS (SELECT count(*) AS n FROM {{order_changes}}),
    i AS (SELECT unnest(['order_number', 'filename', 'total_rows']) AS k)
    SELECT cast(NULL AS bigint) AS order_id, 'ORDER_INFO' AS row_number, k AS column_name, NULL AS old_value,
        CASE k WHEN 'order_number' THEN 'ALL' WHEN 'filename' THEN 'changes.csv' ELSE cast(n AS string) END AS new_value,
        'info' AS change_type, NULL AS created_at FROM n, i
    UNION ALL SELECT order_id, row_number, column_name, nullif(old_value, ''), new_value, change_type, created_at FROM ({CHANGE_ROWS_SQL})""",
)
def snk_1(t):
    folder = scratch_dir(t.spark, "change-csv")
    head = t.order_changes.agg(A.count_rows().alias("total_rows")).select(
        F.lit("ALL").alias("order_number"), F.lit("changes.csv").alias("filename"), "total_rows"
    )
    X.write_change_csv(head, t.order_changes, folder)
    schema = "order_id bigint, row_number string, column_name string, old_value string, new_value string, change_type string, created_at string"
    return t.spark.read.schema(schema).csv(folder, header=True)


@query(
    "snk_2_change_json",
    """SELECT o.id AS order_id, o.order_number, c.version, count(c.order_id) AS total_changes,
        count(*) FILTER (c.change_type = 'filled') AS filled,
        coalesce(string_agg(c.version || '/' || c.field_name || '/' || c.new_value, ';'
            ORDER BY c.version, c.field_name, c.old_value, c.new_value, c.change_type, c.changed_at), '') AS changes
    FROM {sales_orders} o LEFT JOIN {order_changes} c ON c.order_id = o.id GROUP BY 1, 2, 3""",
)
def snk_2(t):
    folder = scratch_dir(t.spark, "change-json")
    X.write_change_json(t.sales_orders.select("id", "order_number"), t.order_changes, now(), folder)
    schema = (
        "export_info struct<order_id:bigint,version:bigint>, order struct<order_number:string>, "
        "changes array<struct<row_number:bigint,column_name:string,new_value:string>>, "
        "summary struct<total_changes:bigint,by_type:struct<filled:bigint>>"
    )
    entry = lambda c: F.concat_ws("/", c["row_number"].cast("string"), c["column_name"], c["new_value"])
    return t.spark.read.schema(schema).json(folder).select(
        "export_info.order_id", "order.order_number", "export_info.version", "summary.total_changes", "summary.by_type.filled",
        F.coalesce(F.array_join(F.transform("changes", entry), ";"), F.lit("")).alias("changes"),
    )


@query(
    "snk_3_report",
    """WITH s AS (SELECT count(*) AS n, cast(sum(order_price) AS double) AS r FROM {sales_orders})
    SELECT 'summary' AS section, 'total_orders' AS key, n AS orders_count, cast(n AS double) AS total FROM s
    UNION ALL SELECT 'summary', 'total_revenue', n, r FROM s
    UNION ALL SELECT 'summary', 'avg_order_value', n, round(r / n, 4) FROM s
    UNION ALL SELECT 'payment_types', coalesce(payment_type, 'Unknown'), count(*), cast(sum(order_price) AS double)
        FROM {sales_orders} GROUP BY 2
    UNION ALL (SELECT 'top_machines', coalesce(machine_code, 'Unknown') AS m, count(*), cast(sum(order_price) AS double)
        FROM {sales_orders} GROUP BY 2 ORDER BY sum(order_price) DESC, m LIMIT 10)""",
)
def snk_3(t):
    folder = scratch_dir(t.spark, "report")
    X.export(X.analytics_report(t.sales_orders), "csv", folder)
    return t.spark.read.schema("section string, key string, orders_count bigint, total double").csv(folder, header=True)


@query(
    "snk_4_file_history",
    """SELECT original_name AS filename, strlen(content) AS file_size,
        strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S') AS upload_date, processing_status AS status,
        len(string_split(content, chr(10))) AS total_rows,
        len(list_filter(string_split(content, chr(10)), lambda x: trim(x, chr(9) || chr(10) || chr(13) || ' ') <> '')) AS processed_rows
    FROM {file_entries}""",
)
def snk_4(t):
    from tallyroll.sources.files import text_totals

    folder = scratch_dir(t.spark, "files")
    row = F.struct("original_name", "uploaded_at", "processing_status", F.octet_length("content").cast("bigint").alias("file_size"))
    files = text_totals(t.file_entries.select(row.alias("k"), "content"), "k", "content").select("k.*", "total_rows", "processed_rows")
    X.export(X.file_history(files), "json", folder)
    schema = "filename string, file_size bigint, upload_date string, status string, total_rows bigint, processed_rows bigint"
    return t.spark.read.schema(schema).json(folder)


@query(
    "snk_5_append",
    f"""SELECT order_number, '{NOW}' AS created_at, cast(creation_time AS string) AS updated_at FROM {{stored_orders}}
    UNION ALL SELECT order_number, '{NOW}', '{NOW}' FROM {{incoming_orders}}""",
)
def snk_5(t):
    folder = scratch_dir(t.spark, "append")
    X.append_rows(t.stored_orders.select("order_number", F.col("creation_time").alias("updated_at")), folder, now(), 0)
    X.append_rows(t.incoming_orders.select("order_number"), folder, now(), 1)
    schema = "order_number string, created_at timestamp_ntz, updated_at timestamp_ntz, batch int"
    return t.spark.read.schema(schema).parquet(folder).drop("batch")


@query(
    "snk_7_preview",
    """SELECT order_id, version, field_name, old_value, new_value, change_type,
        (SELECT CASE WHEN count(*) > 100 THEN '100 of ' || count(*) END FROM {order_changes}) AS note
    FROM {order_changes} ORDER BY order_id, version, field_name, new_value, old_value, change_type LIMIT 100""",
)
def snk_7(t):
    return X.preview(t.order_changes)


# ---- value functions over the change data ------------------------------------------------------


@query(
    "fn_6_shorten",
    """SELECT id, CASE WHEN length(content) > 30 THEN substr(content, 1, 30) || '...' ELSE content END AS short FROM {file_entries}""",
)
def fn_6(t):
    return t.file_entries.select("id", V.shorten(F.col("content"), 30).alias("short"))


@query(
    "fn_19_json_row",
    """SELECT id, '{{"order_number":"' || order_number || '","payment_type":"' || coalesce(payment_type, '-') || '"}}' AS json_text,
        strftime(creation_time, '%Y-%m-%dT%H:%M:%S') AS iso_time FROM {sales_orders}""".replace("{{", "{").replace("}}", "}"),
)
def fn_19(t):
    row = F.struct("order_number", F.coalesce("payment_type", F.lit("-")).alias("payment_type"))
    return t.sales_orders.select("id", F.to_json(row).alias("json_text"), V.iso_text(F.col("creation_time")).alias("iso_time"))


@query(
    "fn_20_as_text",
    """SELECT id, coalesce(cast(order_price AS string), '') AS price_text, coalesce(machine_code, '') AS machine_text FROM {sales_orders}""",
)
def fn_20(t):
    return t.sales_orders.select(
        "id", V.as_text(F.col("order_price")).alias("price_text"), V.as_text(F.col("machine_code")).alias("machine_text")
    )


@query(
    "fn_21_names",
    """SELECT id, 'export_' || order_number || '_' || strftime(creation_time, '%Y%m%d_%H%M%S') || '.csv' AS export_name,
        'TEMP_' || created_by || '_' || source_file_id AS temporary_number FROM {sales_orders}""",
)
def fn_21(t):
    return t.sales_orders.select(
        "id", V.export_name(F.col("order_number"), F.col("creation_time"), "csv").alias("export_name"),
        V.temporary_number(F.col("created_by"), F.col("source_file_id")).alias("temporary_number"),
    )
