"""Filters, listings and aggregates (FLT, ORD, AGG)."""

from pyspark.sql import functions as F

from tallyroll.functions import values as V
from tallyroll.operators import analytics as A, filters as P, paging as G
from tallyroll.plans.registry import query
from tallyroll.sources.files import extension

ORDER_COLUMNS = [
    "id", "order_number", "machine_code", "order_price", "creation_time", "payment_type", "match_status", "created_by",
]
ORDER_SQL = """id, order_number, machine_code, cast(order_price AS double) AS order_price,
       cast(creation_time AS string) AS creation_time, payment_type, match_status, created_by"""


def as_of():
    return F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")


# ---- filters -----------------------------------------------------------------------------------


@query(
    "flt_1_composite",
    f"""SELECT {ORDER_SQL} FROM {{sales_orders}}
    WHERE order_number ILIKE '%vn0%' AND payment_type = 'Cash' AND match_status = 'matched'
      AND creation_time >= '1997-01-01' AND creation_time <= '1999-06-30'
      AND id IN (SELECT order_id FROM {{order_changes}} WHERE change_type = 'filled')""",
)
def flt_1(t):
    spec = P.OrderCriteria(
        order_number="vn0", payment_type="Cash", match_status="matched",
        date_from="1997-01-01", date_to="1999-06-30", change_type="filled",
    )
    return P.filter_orders(t.sales_orders, spec, t.order_changes).select(ORDER_COLUMNS)


@query("flt_2_substring", f"SELECT {ORDER_SQL} FROM {{sales_orders}} WHERE order_number ILIKE '%n0%_7%'")
def flt_2(t):
    return t.sales_orders.filter(P.contains_text(F.col("order_number"), "n0%_7")).select(ORDER_COLUMNS)


@query(
    "flt_3_equality",
    f"""SELECT {ORDER_SQL} FROM {{sales_orders}}
    WHERE machine_code = 'VM-007' AND payment_type = 'Card' AND match_status = 'unmatched'""",
)
def flt_3(t):
    spec = P.OrderCriteria(machine_code="VM-007", payment_type="Card", match_status="unmatched")
    return P.filter_orders(t.sales_orders, spec).select(ORDER_COLUMNS)


@query(
    "flt_4_date_range",
    f"""SELECT {ORDER_SQL} FROM {{sales_orders}}
    WHERE creation_time >= timestamp '1998-01-01' AND creation_time <= timestamp '1998-03-31'""",
)
def flt_4(t):
    return P.in_period(t.sales_orders, "creation_time", "1998-01-01", "1998-03-31").select(ORDER_COLUMNS)


@query(
    "flt_5_key_lookup",
    f"""SELECT {ORDER_SQL} FROM {{sales_orders}}
    WHERE order_number IN (SELECT order_number FROM {{payme_payments}} WHERE trim(order_number) <> '')""",
)
def flt_5(t):
    return P.by_keys(t.sales_orders, "order_number", t.payme_payments.select("order_number")).select(ORDER_COLUMNS)


@query(
    "flt_6_blank_keys",
    """SELECT order_number, cast(amount AS double) AS amount FROM {payme_payments} WHERE trim(order_number) <> ''""",
)
def flt_6(t):
    return t.payme_payments.filter(P.present(F.col("order_number"))).select("order_number", "amount")


@query(
    "flt_7_active_users",
    """SELECT id, status = 'approved' AS is_approved, role = 'admin' AS is_admin,
              status = 'approved' AND NOT is_deactivated AS is_active FROM {app_users}""",
)
def flt_7(t):
    return t.app_users.select(
        "id", P.is_approved().alias("is_approved"), P.is_admin().alias("is_admin"), P.is_active_user().alias("is_active")
    )


@query(
    "flt_8_status_membership",
    """SELECT 'session' AS kind, id FROM {run_sessions} WHERE status IN ('started', 'processing')
    UNION ALL SELECT 'user', id FROM {app_users} WHERE status = 'pending'""",
)
def flt_8(t):
    open_runs = t.run_sessions.filter(P.is_open_session()).select(F.lit("session").alias("kind"), "id")
    pending = t.app_users.filter(F.col("status") == "pending").select(F.lit("user").alias("kind"), "id")
    return open_runs.union(pending)


@query(
    "flt_9_live_rows",
    """SELECT id, user_id, token FROM {access_sessions}
    WHERE is_active AND expires_at > timestamp '2024-01-15 12:00:00'""",
)
def flt_9(t):
    return t.access_sessions.filter(P.is_live(as_of())).select("id", "user_id", "token")


@query("flt_10_prefix", "SELECT id, token FROM {access_sessions} WHERE token LIKE 'admin_%'")
def flt_10(t):
    return t.access_sessions.filter(P.has_prefix(F.col("token"), "admin_%")).select("id", "token")


@query(
    "flt_11_change_filter",
    """SELECT order_id, version, field_name, new_value, change_type FROM {order_changes}
    WHERE change_type IN ('filled', 'changed') AND version >= 2 AND version <= 5
      AND field_name IN ('order_price', 'payment_type') AND changed_at >= timestamp '1996-01-01'""",
)
def flt_11(t):
    named = t.order_changes.withColumnsRenamed({"version": "row_number", "field_name": "column_name"})
    spec = {
        "change_type": ["filled", "changed"], "row_range": {"min": 2, "max": 5},
        "columns": ["order_price", "payment_type"], "date_range": {"start": "1996-01-01"},
    }
    return P.filter_changes(named, spec).select(
        "order_id", F.col("row_number").alias("version"), F.col("column_name").alias("field_name"), "new_value", "change_type"
    )


@query(
    "flt_12_row_pruning",
    """SELECT coalesce(machine_code, '') AS machine_code, coalesce(payment_type, '') AS payment_type,
              count(*) AS orders
    FROM {sales_orders} WHERE machine_code IS NOT NULL OR payment_type IS NOT NULL GROUP BY 1, 2""",
)
def flt_12(t):
    kept = P.drop_empty_rows(t.sales_orders.select("machine_code", "payment_type"))
    return kept.groupBy("machine_code", "payment_type").agg(A.count_rows().alias("orders"))


@query(
    "flt_14_point_lookup",
    f"""SELECT 'number' AS found_by, {ORDER_SQL} FROM {{sales_orders}} WHERE order_number = 'VN0000000042'
    UNION ALL SELECT 'id', {ORDER_SQL} FROM {{sales_orders}} WHERE id = 99""",
)
def flt_14(t):
    by_number = t.sales_orders.filter(F.col("order_number") == "VN0000000042")
    by_id = t.sales_orders.filter(F.col("id") == 99)
    return by_number.select(F.lit("number").alias("found_by"), *ORDER_COLUMNS).union(
        by_id.select(F.lit("id").alias("found_by"), *ORDER_COLUMNS)
    )


# ---- sorts and pages ---------------------------------------------------------------------------


@query(
    "ord_1_page",
    f"SELECT {ORDER_SQL} FROM {{sales_orders}} ORDER BY {{sales_orders}}.creation_time DESC, id LIMIT 50 OFFSET 100",
)
def ord_1(t):
    return A.page_of(t.sales_orders, 3, 50, [F.desc("creation_time"), "id"]).select(ORDER_COLUMNS)


@query(
    "ord_1_deep_page",
    f"""SELECT {ORDER_SQL} FROM (SELECT *, row_number() OVER (ORDER BY creation_time DESC NULLS LAST, id) AS place,
        count(*) OVER () AS total FROM {{sales_orders}}) WHERE place > total // 2 // 50 * 50 AND place <= total // 2 // 50 * 50 + 50""",
)
def ord_1_deep(t):
    """The page in the middle of the table."""
    page = t.sales_orders.count() // 2 // 50 + 1
    return G.deep_page(t.sales_orders, page, 50, {"creation_time": True, "id": False}).select(ORDER_COLUMNS)


@query(
    "ord_1_page_info",
    """SELECT cast(3 AS bigint) AS page, cast(50 AS bigint) AS page_size, count(*) AS total,
              cast((count(*) + 49) // 50 AS bigint) AS pages FROM {sales_orders}""",
)
def ord_1_info(t):
    return A.page_info(t.sales_orders, 3, 50)


@query(
    "ord_2_full_sort",
    """SELECT id, original_name, cast(uploaded_at AS string) AS uploaded_at FROM {file_entries}
    ORDER BY {file_entries}.uploaded_at DESC, id""",
)
def ord_2(t):
    return t.file_entries.select("id", "original_name", "uploaded_at").orderBy(F.desc("uploaded_at"), "id")


@query(
    "ord_3_top_users",
    """SELECT created_by, cast(sum(order_price) AS double) AS total FROM {sales_orders}
    GROUP BY created_by ORDER BY sum(order_price) DESC, created_by LIMIT 25""",
)
def ord_3(t):
    totals = t.sales_orders.groupBy("created_by").agg(A.money_sum().alias("total"))
    return totals.orderBy(F.desc("total"), "created_by").limit(25)


@query("ord_4_first", f"SELECT {ORDER_SQL} FROM {{sales_orders}} WHERE machine_code = 'VM-011' ORDER BY id LIMIT 1")
def ord_4(t):
    return A.first_row(t.sales_orders.filter(F.col("machine_code") == "VM-011")).select(ORDER_COLUMNS)


@query(
    "ord_5_preview",
    """SELECT order_id, version, field_name, new_value FROM {order_changes}
    ORDER BY order_id, version, field_name, new_value LIMIT 100""",
)
def ord_5(t):
    cols = ["order_id", "version", "field_name", "new_value"]
    return t.order_changes.select(cols).orderBy(*cols).limit(100)


# ---- aggregates --------------------------------------------------------------------------------

PERIOD = "creation_time >= timestamp '1996-01-01' AND creation_time <= timestamp '1999-12-31'"


def dated(t):
    return P.in_period(t.sales_orders, "creation_time", "1996-01-01", "1999-12-31")


@query(
    "agg_1_summary",
    f"""SELECT count(*) AS total_orders, cast(coalesce(sum(order_price), 0) AS double) AS total_revenue,
              round(cast(coalesce(sum(order_price), 0) AS double) / count(*), 4) AS avg_order_value
    FROM {{sales_orders}} WHERE {PERIOD}""",
)
def agg_1(t):
    return A.summary(dated(t))


@query(
    "agg_2_summary_distinct",
    f"""SELECT count(*) AS total_orders, cast(sum(order_price) AS double) AS total_revenue,
              count(DISTINCT machine_code) AS unique_machines, count(DISTINCT created_by) AS unique_users,
              round(cast(sum(order_price) AS double) / count(order_price), 4) AS avg_order_value
    FROM {{sales_orders}} WHERE {PERIOD}""",
)
def agg_2(t):
    return A.summary_distinct(dated(t))


@query(
    "agg_3_payment_types",
    f"""SELECT coalesce(payment_type, 'Unknown') AS payment_type, count(*) AS orders_count,
              cast(coalesce(sum(order_price), 0) AS double) AS total
    FROM {{sales_orders}} WHERE {PERIOD} GROUP BY 1""",
)
def agg_3(t):
    return A.by_code(dated(t), "payment_type")


@query(
    "agg_4_machines",
    f"""SELECT coalesce(machine_code, 'Unknown') AS machine_code, count(*) AS orders_count,
              cast(coalesce(sum(order_price), 0) AS double) AS total
    FROM {{sales_orders}} WHERE {PERIOD} GROUP BY 1""",
)
def agg_4(t):
    return A.by_code(dated(t), "machine_code")


@query(
    "agg_5_top_machines",
    f"""SELECT coalesce(machine_code, 'Unknown') AS machine_code, count(*) AS orders_count,
              cast(sum(order_price) AS double) AS total_revenue,
              round(cast(sum(order_price) AS double) / count(order_price), 4) AS avg_order_value
    FROM {{sales_orders}} WHERE {PERIOD} GROUP BY 1 ORDER BY sum(order_price) DESC, 1 LIMIT 10""",
)
def agg_5(t):
    return A.top_machines(t.sales_orders, 10, "1996-01-01", "1999-12-31")


def _series(unit):
    @query(
        f"agg_6_{unit}",
        f"""SELECT cast(cast(date_trunc('{unit}', creation_time) AS date) AS string) AS period,
                  count(*) AS orders_count, cast(coalesce(sum(order_price), 0) AS double) AS total
        FROM {{sales_orders}} WHERE {PERIOD} GROUP BY 1""",
    )
    def agg_6(t):
        return A.time_series(dated(t), unit)


for _unit in ("day", "week", "month"):
    _series(_unit)


@query(
    "agg_7_machine_detail",
    """SELECT coalesce(machine_code, 'Unknown') AS machine_code, count(*) AS orders_count,
              cast(coalesce(sum(order_price), 0) AS double) AS total,
              round(cast(coalesce(sum(order_price), 0) AS double) / count(*), 4) AS average
    FROM {sales_orders} GROUP BY 1""",
)
def agg_7(t):
    return A.machine_detail(t.sales_orders)


@query(
    "agg_8_change_summary",
    """SELECT change_type, count(*) AS changes FROM {order_changes} GROUP BY 1
    UNION ALL SELECT 'total', count(*) FROM {order_changes}""",
)
def agg_8(t):
    return A.change_summary(t.order_changes)


@query(
    "agg_9_run_totals",
    """SELECT uploaded_by AS session_id, count(*) AS files,
              cast(sum(n) AS bigint) AS total_rows, cast(sum(m) AS bigint) AS processed_rows,
              cast(sum(ceil(m / 1000.0)) AS bigint) AS batches,
              cast(count(*) FILTER (processing_status = 'failed') AS bigint) AS errors
    FROM (SELECT uploaded_by, processing_status, len(string_split(content, chr(10))) AS n,
                 len(list_filter(string_split(content, chr(10)), lambda x: trim(x, chr(9) || chr(10) || chr(13) || ' ') <> '')) AS m
          FROM {file_entries}) GROUP BY 1""",
)
def agg_9(t):
    from tallyroll.sources.files import text_totals

    lines = text_totals(t.file_entries.select(F.struct("uploaded_by", "processing_status").alias("k"), "content"), "k", "content")
    per_file = lines.select(F.col("k.uploaded_by").alias("session_id"), "k.processing_status", "total_rows", "processed_rows")
    return A.run_totals(per_file)


@query(
    "agg_11_counts",
    """SELECT (SELECT count(*) FROM {app_users}) AS users,
              (SELECT count(*) FROM {run_sessions} WHERE status IN ('started', 'processing')) AS open_sessions,
              (SELECT count(*) FROM {access_sessions}
               WHERE is_active AND expires_at > timestamp '2024-01-15 12:00:00') AS live_tokens""",
)
def agg_11(t):
    runs = t.run_sessions.agg(F.count_if(P.is_open_session())).scalar()
    live = t.access_sessions.agg(F.count_if(P.is_live(as_of()))).scalar()
    users = t.app_users.agg(A.count_rows().alias("users"))
    return users.select("users", runs.alias("open_sessions"), live.alias("live_tokens"))


@query(
    "agg_12_user_stats",
    """SELECT u.id, coalesce(o.n, 0) AS total_orders, coalesce(o.m, 0) AS completed_orders,
              coalesce(f.n, 0) AS files_uploaded
    FROM {app_users} u
    LEFT JOIN (SELECT created_by, count(*) AS n, count(*) FILTER (match_status = 'matched') AS m
               FROM {sales_orders} GROUP BY 1) o ON o.created_by = u.id
    LEFT JOIN (SELECT uploaded_by, count(*) AS n FROM {file_entries} GROUP BY 1) f ON f.uploaded_by = u.id""",
)
def agg_12(t):
    return A.user_stats(t.app_users.select("id"), t.sales_orders, t.file_entries)


@query(
    "agg_13_system_summary",
    """SELECT (SELECT count(*) FROM {app_users}) AS total_users,
      (SELECT count(*) FROM {app_users} WHERE status = 'approved' AND NOT is_deactivated) AS active_users,
      (SELECT count(*) FROM {sales_orders}) AS total_orders,
      (SELECT count(*) FROM {sales_orders} WHERE match_status = 'matched') AS completed_orders,
      (SELECT count(*) FROM {file_entries}) AS total_files_processed,
      (SELECT string_agg(ft || '=' || n, ',' ORDER BY ft) FROM
         (SELECT lower(regexp_extract(original_name, '[^/]\\.([^./]+)$', 1)) AS ft, count(*) AS n
          FROM {file_entries} GROUP BY 1)) AS popular_file_formats,
      (SELECT string_agg(d || '=' || n, ',' ORDER BY d) FROM
         (SELECT cast(cast(creation_time AS date) AS string) AS d, count(*) AS n FROM {sales_orders}
          GROUP BY 1)) AS daily_stats""",
)
def agg_13(t):
    files = t.file_entries.select(extension(F.col("original_name")).alias("file_type"))
    one = A.system_summary(t.app_users, t.sales_orders, files, P.is_active_user())
    formats = F.transform(
        F.map_entries("popular_file_formats"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    days = F.transform("daily_stats", lambda e: F.concat_ws("=", e["day"].cast("string"), e["orders"].cast("string")))
    return one.withColumns({"popular_file_formats": formats, "daily_stats": days})


@query(
    "agg_14_period_change",
    """WITH x AS (SELECT *, creation_time >= timestamp '1999-01-01' AS now FROM {sales_orders}
        WHERE creation_time >= timestamp '1998-10-03' AND creation_time < timestamp '1999-04-01'),
    y AS (SELECT count(*) FILTER (now) AS orders_now, count(*) FILTER (NOT now) AS orders_before,
        cast(sum(order_price) FILTER (now) AS double) AS revenue_now,
        cast(sum(order_price) FILTER (NOT now) AS double) AS revenue_before,
        count(DISTINCT machine_code) FILTER (now) AS machines_now,
        count(DISTINCT machine_code) FILTER (NOT now) AS machines_before FROM x)
    SELECT *, round((orders_now - orders_before) * 100.0::double / orders_before, 2) AS orders_change,
        round(cast(cast(revenue_now AS decimal(18,2)) - cast(revenue_before AS decimal(18,2)) AS double) * 100 / revenue_before, 2) AS revenue_change,
        machines_now - machines_before AS machines_change FROM y""",
)
def agg_14(t):
    return A.period_change(t.sales_orders, "1999-01-01", 90)


@query(
    "agg_15_weekday",
    "SELECT cast(isodow(creation_time) AS bigint) AS weekday, count(*) AS orders_count FROM {sales_orders} GROUP BY 1",
)
def agg_15_weekday(t):
    return A.weekday_counts(t.sales_orders)


@query(
    "agg_15_payment_share",
    """SELECT coalesce(payment_type, 'Unknown') AS payment_type, count(*) AS orders_count,
              round(cast(count(*) AS double) / sum(count(*)) OVER (), 4) AS share
    FROM {sales_orders} GROUP BY 1""",
)
def agg_15_share(t):
    return A.payment_share(t.sales_orders)


@query(
    "agg_15_top_locations",
    """SELECT machine_code, n AS orders_count, cast(total AS double) AS total_revenue, n_name AS location
    FROM (SELECT coalesce(machine_code, 'Unknown') AS machine_code, count(*) AS n, coalesce(sum(order_price), 0) AS total
          FROM {sales_orders} GROUP BY 1)
    LEFT JOIN {nation} ON try_cast(substr(machine_code, 4) AS int) = n_nationkey
    ORDER BY total DESC, machine_code LIMIT 5""",
)
def agg_15_locations(t):
    places = t.nation.select(
        F.concat(F.lit("VM-"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("machine_code"),
        F.col("n_name").alias("location"),
    )
    return A.top_locations(t.sales_orders, places)


@query("agg_16_requests", "SELECT method, endpoint, count(*) AS requests FROM {requests} GROUP BY 1, 2")
def agg_16(t):
    return A.request_counts(t.requests)


@query(
    "agg_17_histogram",
    "WITH r AS (SELECT cast(duration_ms AS double) / 100 AS s, cast(duration_ms AS decimal(18,6)) / 100 AS d FROM {requests}), "
    + "b AS (SELECT unnest(["
    + ",".join(f"'{b:g}'" for b in A.HISTOGRAM_BOUNDS)
    + """, '+Inf']) AS le)
    SELECT le, (SELECT count(*) FROM r WHERE le = '+Inf' OR s <= try_cast(le AS double)) AS requests,
           (SELECT round(sum(cast(s AS decimal(18,6)))::double, 4) FROM r) AS total_seconds FROM b""",
)
def agg_17(t):
    seconds = (F.col("duration_ms").cast("double") / 100).cast("decimal(18,6)")
    rows = t.requests.select(seconds.alias("seconds"))
    return A.duration_histogram(rows, F.col("seconds")).withColumn(
        "total_seconds", F.round(F.col("total_seconds").cast("double"), 4)
    )


@query(
    "agg_18_logins",
    """SELECT cast(cast(seen_at AS date) AS string) AS day, success, count(*) AS attempts FROM {logins} GROUP BY 1, 2""",
)
def agg_18(t):
    return A.login_log(t.logins)


@query("agg_20_distinct", "SELECT DISTINCT order_id FROM {order_changes} WHERE change_type = 'filled'")
def agg_20(t):
    return t.order_changes.filter(F.col("change_type") == "filled").select("order_id").distinct()


# ---- pages, presets, labels --------------------------------------------------------------------


@query(
    "fn_10_pages",
    """WITH n AS (SELECT created_by, count(*) AS total FROM {sales_orders} GROUP BY 1),
    p AS (SELECT *, cast((total + 4) // 5 AS bigint) AS pages FROM n)
    SELECT created_by, total, pages, cast(6 AS bigint) AS first_index, least(10, total) AS last_index,
           array_to_string(list_filter([1, 2, 3, 4], lambda x: x <= pages), ',') AS visible FROM p""",
)
def fn_10(t):
    totals = t.sales_orders.groupBy("created_by").agg(A.count_rows().alias("total"))
    page = F.lit(2).cast("bigint")
    return totals.select(
        "created_by", "total", V.page_count(F.col("total"), 5).alias("pages"),
        V.first_index(page, 5).alias("first_index"), V.last_index(page, 5, F.col("total")).alias("last_index"),
        V.visible_pages(page, V.page_count(F.col("total"), 5)).cast("array<string>").alias("visible"),
    )


@query(
    "fn_11_presets",
    """WITH p AS (SELECT unnest([0, 1, 7, 30, 90]) AS days)
    SELECT cast(days AS bigint) AS days, cast(date '1998-12-31' - cast(days AS int) AS string) AS date_from,
           '1998-12-31' AS date_to,
           (SELECT count(*) FROM {sales_orders}
            WHERE creation_time >= date '1998-12-31' - cast(days AS int) AND creation_time <= date '1998-12-31') AS orders
    FROM p""",
)
def fn_11(t):
    today = F.lit("1998-12-31").cast("date")
    counts = t.sales_orders.filter(
        (F.col("creation_time") <= F.lit("1998-12-31").cast("timestamp_ntz"))
        & (F.col("creation_time") >= F.lit("1998-10-02").cast("timestamp_ntz"))
    ).groupBy(F.col("creation_time").cast("date").alias("day")).agg(A.count_rows().alias("n"))
    # One row of totals, so that all presets come out even if no order falls into the period.
    inside = lambda p: F.coalesce(F.sum(F.when(F.col("day") >= F.date_sub(today, p), F.col("n"))), F.lit(0))
    totals = counts.agg(*[inside(p).alias(f"_{p}") for p in V.DATE_PRESETS])
    number = F.create_map(*[x for p in V.DATE_PRESETS for x in (F.lit(p), F.col(f"_{p}"))])
    presets = totals.select(number.alias("_n"), F.explode(V.preset_ranges(today)).alias("p"))
    return presets.select("p.days", "p.date_from", "p.date_to", F.col("_n")[F.col("p.days")].alias("orders"))


@query(
    "fn_9_formats",
    """SELECT id, CASE WHEN order_price IS NULL OR order_price = 0 THEN '-' ELSE
           replace(replace(format('{{:,.2f}}', cast(order_price AS double)), ',', chr(160)), '.', ',') || chr(160) || 'UZS' END AS price_text,
       strftime(creation_time, '%d.%m.%Y, %H:%M:%S') AS time_text FROM {sales_orders}""".replace("{{:,.2f}}", "{:,.2f}"),
)
def fn_9(t):
    return t.sales_orders.select(
        "id", V.currency_text(F.col("order_price")).alias("price_text"), V.local_time_text(F.col("creation_time")).alias("time_text")
    )


@query(
    "fn_12_substitution",
    """SELECT id, coalesce(machine_code, 'Unknown') AS machine, coalesce(payment_type, '-') AS payment,
              cast(coalesce(order_price, 0) AS double) AS price FROM {sales_orders}""",
)
def fn_12(t):
    return t.sales_orders.select(
        "id", V.or_default(F.col("machine_code")).alias("machine"),
        V.or_default(F.col("payment_type"), "-").alias("payment"),
        F.coalesce("order_price", F.lit(0).cast("decimal(12,2)")).alias("price"),
    )


@query(
    "fn_13_labels",
    """SELECT 'status' AS kind, match_status AS code,
        CASE match_status WHEN 'matched' THEN 'Сопоставлен' WHEN 'unmatched' THEN 'Не сопоставлен'
             ELSE 'Частично' END AS label, count(*) AS n FROM {sales_orders} GROUP BY 1, 2, 3
    UNION ALL SELECT 'change', change_type, CASE change_type WHEN 'new' THEN 'Новый' WHEN 'updated' THEN 'Обновлён'
        WHEN 'filled' THEN 'Заполнен' ELSE change_type END, count(*) FROM {order_changes} GROUP BY 1, 2, 3""",
)
def fn_13(t):
    def counted(df, kind, code, labels):
        return df.groupBy(F.lit(kind).alias("kind"), F.col(code).alias("code")).agg(A.count_rows().alias("n")).select(
            "kind", "code", V.label_of(F.col("code"), labels).alias("label"), "n"
        )

    return counted(t.sales_orders, "status", "match_status", V.MATCH_LABELS).union(
        counted(t.order_changes, "change", "change_type", V.CHANGE_LABELS)
    )


@query(
    "fn_14_patterns",
    r"""SELECT id, regexp_matches(phone, '^\+?[1-9]\d{1,14}$') AS phone_ok,
        regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS email_ok,
        regexp_matches('C' || cast(id AS string) || '00000', '^[A-Z0-9]{6,20}$') AS number_ok FROM {app_users}""",
)
def fn_14(t):
    number = F.concat(F.lit("C"), F.col("id").cast("string"), F.lit("00000"))
    return t.app_users.select(
        "id", F.col("phone").rlike(V.PHONE_PATTERN).alias("phone_ok"), F.col("email").rlike(V.EMAIL_PATTERN).alias("email_ok"),
        number.rlike(V.ORDER_NUMBER_PATTERN).alias("number_ok"),
    )
