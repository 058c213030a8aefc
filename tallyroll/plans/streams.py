"""Streams run over what has arrived (SRC-12, SNK-6, STR) and log parsing (FN-15 to FN-18)."""

from functools import partial, reduce

from pyspark.sql import DataFrame, functions as F

from tallyroll.functions import logs as L, values as V
from tallyroll.plans.ingest import delivery, write_delimited
from tallyroll.plans.registry import query
from tallyroll.session import dealt, scratch_dir, stored
from tallyroll.streaming import ingest as I, limits as M, logs as S, views as W
from tallyroll.streaming.runs import StreamTables, for_each_batch, tick, to_parquet, with_clock


def streams(t):
    return StreamTables(t.spark, t.folder)


def dealt_streams(t, name):
    """The streams, with the rows of one base table dealt over all cores before anything is made of them."""
    s = streams(t)
    s._made[name] = dealt(getattr(s, name))
    return s


def result(t, stream, label):
    return to_parquet(stream, scratch_dir(t.spark, label))


def whole_delay(t, name, time):
    """A delay by which no row of a table is late, in whatever order its files arrive: the time it spans."""
    low, high = getattr(t, name).agg(F.min(time), F.max(time)).first()
    return f"{int((high - low).total_seconds()) + 1 if low else 0} seconds"


def all_windows(t, name, time, build, label):
    """The result of ``build`` over a table's stream with every window closed: what is there, then a clock tick."""
    folder, stream = scratch_dir(t.spark, label), getattr(streams(t), name)
    built = build(with_clock(stream, folder), delay=whole_delay(t, name, time))
    return to_parquet(built, folder, lambda: tick(stream, time, folder))


def windowed(t, name, windows, change=None):
    """What each kind of windows holds after a table has been read as a stream, late rows and open windows included."""
    folder, stream = scratch_dir(t.spark, "windows"), getattr(streams(t), name)

    def take(batch, batch_id):
        for i, w in enumerate(windows):
            w.take(batch, batch_id, f"{folder}/{i}")

    for_each_batch(change(stream) if change else stream, folder, take)
    return [w.results(t.spark, f"{folder}/{i}") for i, w in enumerate(windows)]


# ---- log parsing on batches --------------------------------------------------------------------

TAGS_SQL = """CASE WHEN severity IN ('ERROR', 'CRITICAL') THEN 'error,alert' ELSE '' END ||
        CASE WHEN severity IN ('ERROR', 'CRITICAL') AND event_type = 'error' THEN ',' ELSE '' END ||
        CASE WHEN event_type IN ('error', 'purchase') THEN 'performance' ELSE '' END"""
COMPONENTS_SQL = """CASE event_type WHEN 'error' THEN 'file-processor' WHEN 'click' THEN 'telegram-bot,authentication'
        WHEN 'purchase' THEN 'database' WHEN 'view' THEN '' ELSE 'authentication,database' END"""


@query(
    "fn_15_log_parse",
    """SELECT event_id, cast(seen_at AS string) AS time, severity AS level, 'app.' || event_type AS logger, body AS message FROM {log_records}""",
)
def fn_15(t):
    return t.log_lines.withColumn("f", L.app_fields(F.col("line"))).select("event_id", "f.*")


@query(
    "fn_15_access_parse",
    r"""SELECT event_id, regexp_extract(line, '^(\S+) ', 1) AS client_ip, cast(seen_at AS string) AS time,
        regexp_extract(line, '"(\w+) ', 1) AS method, regexp_extract(line, '"\w+ (\S+) ', 1) AS request, '1.1' AS http_version,
        cast(regexp_extract(line, '" (\d+) ', 1) AS bigint) AS response_code, event_id % 1000 AS bytes
    FROM {access_lines} JOIN {log_records} USING (event_id)""",
)
def fn_15_access(t):
    return t.access_lines.withColumn("f", L.access_fields(F.col("line"))).select("event_id", "f.*")


@query("fn_16_components", f"SELECT event_id, {COMPONENTS_SQL} AS components FROM {{log_records}}")
def fn_16(t):
    return L.enrich(t.log_lines).select("event_id", "components")


@query(
    "fn_17_tags",
    f"""SELECT event_id, {TAGS_SQL} AS tags, CASE WHEN event_type IN ('error', 'purchase') THEN cast(amount_text AS double) END AS duration
    FROM {{log_records}}""",
)
def fn_17(t):
    return L.enrich(t.log_lines).select("event_id", "tags", "duration")


@query(
    "fn_18_gateway",
    """SELECT id, 'c' || client AS client_ip, method, endpoint AS uri, cast(status AS bigint) AS status,
        cast(duration_ms AS double) AS latency_ms, 't' || id AS trace_id, 'gateway' AS service, 'api-gateway' AS components,
        cast(seen_at AS string) AS time FROM {requests}""",
)
def fn_18(t):
    rows = L.enrich(gateway_lines(t.requests, "id"))
    return rows.select(
        "id", "client_ip", "method", F.col("request").alias("uri"), F.col("response_code").alias("status"), "latency_ms",
        "trace_id", "service", "components", "time",
    )


def gateway_lines(requests, *keep):
    """Requests as the gateway logs them, one JSON record per line."""
    record = F.struct(
        F.concat(F.lit("c"), F.col("client").cast("string")).alias("client_ip"),
        F.struct("method", F.col("endpoint").alias("uri")).alias("request"),
        F.struct("status").alias("response"),
        F.struct(F.col("duration_ms").alias("request")).alias("latencies"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("correlation_id"),
        F.unix_millis(F.col("seen_at").cast("timestamp")).alias("started_at"),
    )
    return requests.select(*keep, F.to_json(record).alias("line"))


# ---- log streams -------------------------------------------------------------------------------


@query(
    "src_12_log_stream",
    "SELECT cast(seen_at AS string) AS time, severity AS level, 'app.' || event_type AS logger, body AS message FROM {log_records}",
)
def src_12(t):
    folder = scratch_dir(t.spark, "log-files")
    t.log_lines.select("line").write.text(f"{folder}/in")
    parsed = S.parsed(S.text_stream(t.spark, f"{folder}/in"))
    return to_parquet(parsed.select("time", "level", "logger", "message"), folder)


@query("src_12_json_stream", "SELECT id, client, method, endpoint, cast(status AS bigint) AS status FROM {requests}")
def src_12_json(t):
    folder = scratch_dir(t.spark, "json-logs")
    t.requests.select("id", "client", "method", "endpoint", "status").write.json(f"{folder}/in")
    stream = S.json_stream(t.spark, f"{folder}/in", "id bigint, client bigint, method string, endpoint string, status bigint")
    return to_parquet(stream, folder)


@query(
    "str_3_log_route",
    f"""SELECT cast(seen_at AS string) AS time, severity AS level, {COMPONENTS_SQL} AS components, {TAGS_SQL} AS tags,
        'backend' AS service, body AS message, cast(NULL AS bigint) AS response_code, NULL AS trace_id FROM {{log_records}}
    UNION ALL SELECT cast(seen_at AS string), NULL, '', '', 'backend', NULL, CASE event_type WHEN 'error' THEN 500 ELSE 200 END, NULL
        FROM {{log_records}}
    UNION ALL SELECT cast(seen_at AS string), NULL, 'api-gateway', '', 'gateway', NULL, status, 't' || id FROM {{requests}}""",
)
def str_3(t):
    s = dealt_streams(t, "events")
    lines = s.log_lines.select("line").union(s.access_lines.select("line")).union(gateway_lines(s.requests))
    message = F.when(F.col("level").isNotNull(), F.col("message")).alias("message")
    enriched = S.parsed(lines).select("time", "level", "components", "tags", "service", message, "response_code", "trace_id")
    return result(t, enriched, "enriched")


@query(
    "snk_6_routes",
    """SELECT route, strftime(seen_at, '%Y.%m.%d') AS day, count(*) AS records FROM {log_records},
        LATERAL (SELECT unnest(list_filter(['logs', CASE WHEN severity IN ('ERROR', 'CRITICAL') THEN 'errors' END,
            CASE WHEN event_type IN ('error', 'purchase') THEN 'performance' END], lambda x: x IS NOT NULL)) AS route)
    GROUP BY 1, 2""",
)
def snk_6(t):
    folder = scratch_dir(t.spark, "routes")
    for_each_batch(S.parsed(streams(t).log_lines), folder, partial(S.route, folder=folder))
    out = None
    for name in S.ROUTES:
        part = t.spark.read.schema("event_id bigint, batch bigint, day string").parquet(f"{folder}/{name}")
        part = part.select(F.lit(name).alias("route"), "day")
        out = part if out is None else out.union(part)
    return out.groupBy("route", "day").agg(F.count(F.lit(1)).alias("records"))


@query(
    "str_4_tumbling",
    """SELECT cast(date_trunc('minute', seen_at) AS string) AS window_start, method, endpoint, count(*) AS requests,
        cast(sum(duration_ms) AS double) AS total_ms, cast(max(duration_ms) AS double) AS slowest_ms FROM {requests}
    GROUP BY date_trunc('minute', seen_at), method, endpoint""",
)
def str_4(t):
    return windowed(t, "requests", [S.request_rates()])[0].drop("window_end")


@query(
    "str_4_histogram",
    """SELECT cast(date_trunc('hour', seen_at) AS string) AS window_start, count(*) FILTER (duration_ms <= 10) AS le_10,
        count(*) FILTER (duration_ms <= 100) AS le_100, count(*) AS requests FROM {requests}
    GROUP BY date_trunc('hour', seen_at)""",
)
def str_4_histogram(t):
    return windowed(t, "requests", [S.duration_rates({"le_10": 10, "le_100": 100})])[0].drop("window_end")


@query(
    "str_5_error_alert",
    f"""SELECT cast(w AS string) AS window_start, count(*) AS requests, count(*) FILTER (status >= 500) AS failures,
        round(count(*) FILTER (status >= 500) / count(*), 4) AS error_share, cast(max(duration_ms) AS double) AS slowest_ms,
        count(*) FILTER (status >= 500) > count(*) * 0.05 AS too_many_errors, max(duration_ms) > 400 AS too_slow
    FROM (SELECT *, date_trunc('minute', seen_at) - i * INTERVAL '1' MINUTE AS w FROM {{requests}}, (SELECT unnest([0, 1, 2, 3, 4]) AS i))
    GROUP BY w HAVING count(*) FILTER (status >= 500) > count(*) * 0.05 OR max(duration_ms) > 400""",
)
def str_5(t):
    return S.alerts(windowed(t, "requests", [S.failure_rates()])[0], slow_ms=400.0)


# The fixed limits, brought down to the rate of these tables' clients.
SCALE = 10_000
GLOBAL_LIMITS = {unit: max(1, n // SCALE) for unit, n in S.GLOBAL_LIMITS.items()}
SERVICE_LIMITS = {unit: max(1, n // SCALE) for unit, n in S.SERVICE_LIMITS.items()}


def _limit_sql(unit, limit, service):
    return f"""SELECT '{unit}' AS unit, cast(date_trunc('{unit}', seen_at) AS string) AS window_start, {service} AS service, client,
        count(*) AS requests, count(*) - {limit} AS excess FROM {{requests}} GROUP BY date_trunc('{unit}', seen_at), {service}, client
    HAVING count(*) > {limit}"""


@query(
    "str_6_limits",
    " UNION ALL ".join(
        [_limit_sql(u, n, "'all'") for u, n in GLOBAL_LIMITS.items()]
        + [_limit_sql(u, n, "substr(endpoint, 9)") for u, n in SERVICE_LIMITS.items()]
    ),
)
def str_6(t):
    columns = ["unit", "window_start", "service", "client", "requests", "excess"]
    limits = [(u, n, ["client"]) for u, n in GLOBAL_LIMITS.items()] + [(u, n, ["service", "client"]) for u, n in SERVICE_LIMITS.items()]
    counts = windowed(t, "requests", [S.request_counts(u, by) for u, _, by in limits], S.with_service)
    over = [S.over_limit(c, u, n) for c, (u, n, _) in zip(counts, limits)]
    return reduce(DataFrame.union, [(o if "service" in o.columns else o.withColumn("service", F.lit("all"))).select(columns) for o in over])


# ---- keyed state -------------------------------------------------------------------------------

def counted_stream(t, name, build, label):
    """Counts per client and second, as a stream of the files that the counting query wrote."""
    folder, stream = scratch_dir(t.spark, label), getattr(streams(t), name)
    counts = to_parquet(build(with_clock(stream, folder), delay=whole_delay(t, name, "seen_at")), folder, lambda: tick(stream, "seen_at", folder))
    return t.spark.readStream.schema(counts.schema).parquet(f"{folder}/out")


ANCHORED_SQL = """WITH RECURSIVE points AS (SELECT client, epoch(seen_at)::bigint AS s, count(*) AS n,
        row_number() OVER (PARTITION BY client ORDER BY epoch(seen_at)::bigint) AS rn FROM {requests} GROUP BY client, epoch(seen_at)::bigint),
    walk AS (SELECT client, rn, s, s AS start, least(n, 2) AS passed, n - least(n, 2) AS refused, least(n, 2) AS used FROM points WHERE rn = 1
        UNION ALL
        SELECT p.client, p.rn, p.s, CASE WHEN p.s - w.start > 86400 THEN p.s ELSE w.start END,
            CASE WHEN p.s - w.start > 86400 THEN least(p.n, 2) ELSE least(p.n, 2 - w.used) END,
            p.n - CASE WHEN p.s - w.start > 86400 THEN least(p.n, 2) ELSE least(p.n, 2 - w.used) END,
            CASE WHEN p.s - w.start > 86400 THEN least(p.n, 2) ELSE w.used + least(p.n, 2 - w.used) END
        FROM walk w JOIN points p ON p.client = w.client AND p.rn = w.rn + 1)
    SELECT cast(client AS string) AS client, s AS second, start AS window_start, passed, refused FROM walk"""


@query("str_7_anchored_limit", ANCHORED_SQL)
def str_7(t):
    counted = counted_stream(t, "requests", M.request_seconds, "request-seconds")
    return result(t, M.anchored_limit(counted, 2, 86400), "anchored")


BRUTE_SQL = """WITH RECURSIVE points AS (SELECT client, epoch(seen_at)::bigint AS s, count(*) FILTER (NOT success) AS bad,
        count(*) FILTER (success) AS good, row_number() OVER (PARTITION BY client ORDER BY epoch(seen_at)::bigint) AS rn
        FROM {logins} GROUP BY client, epoch(seen_at)::bigint),
    walk AS (SELECT client, cast(0 AS bigint) AS rn, cast(NULL AS bigint) AS s, cast(NULL AS bigint) AS f, cast(0 AS bigint) AS c,
            cast(0 AS bigint) AS failed, cast(0 AS bigint) AS succeeded, cast(0 AS bigint) AS blocked FROM points WHERE rn = 1
        UNION ALL
        SELECT client, rn, s, CASE WHEN succeeded > 0 THEN NULL WHEN c0 = 0 AND failed > 0 THEN s ELSE f0 END,
            CASE WHEN succeeded > 0 THEN 0 ELSE c0 + failed END, failed, succeeded, bad - failed + good - succeeded
        FROM (SELECT *, CASE WHEN c0 + failed < 2 THEN good ELSE 0 END AS succeeded
              FROM (SELECT *, least(bad, 2 - c0) AS failed
                    FROM (SELECT p.client, p.rn, p.s, p.bad, p.good,
                            CASE WHEN w.f IS NOT NULL AND p.s - w.f > 172800 THEN NULL ELSE w.f END AS f0,
                            CASE WHEN w.f IS NOT NULL AND p.s - w.f > 172800 THEN 0 ELSE w.c END AS c0
                          FROM walk w JOIN points p ON p.client = w.client AND p.rn = w.rn + 1))))
    SELECT cast(client AS string) AS client, s AS second, failed, succeeded, blocked FROM walk WHERE rn > 0"""


@query("str_8_brute_force", BRUTE_SQL)
def str_8(t):
    counted = counted_stream(t, "logins", M.login_seconds, "login-seconds")
    return result(t, M.brute_force(counted, 2, 172800), "brute-force")


@query(
    "str_9_activity_sessions",
    """WITH x AS (SELECT client, seen_at, coalesce(seen_at > lag(seen_at) OVER w + INTERVAL '30' MINUTE, true) AS fresh
        FROM {requests} WINDOW w AS (PARTITION BY client ORDER BY seen_at)),
    y AS (SELECT client, seen_at, sum(fresh::int) OVER (PARTITION BY client ORDER BY seen_at ROWS UNBOUNDED PRECEDING) AS g FROM x)
    SELECT client, cast(min(seen_at) AS string) AS session_start, cast(max(seen_at) + INTERVAL '30' MINUTE AS string) AS session_end,
        count(*) AS requests FROM y GROUP BY client, g""",
)
def str_9(t):
    return all_windows(t, "requests", "seen_at", S.activity_sessions, "sessions")


@query(
    "str_9_cleanup",
    """SELECT cast(time_bucket(INTERVAL '5' MINUTE, expires_at) + INTERVAL '5' MINUTE AS string) AS cleanup_at, count(*) AS expired
    FROM {access_sessions} GROUP BY time_bucket(INTERVAL '5' MINUTE, expires_at)""",
)
def str_9_cleanup(t):
    return windowed(t, "access_sessions", [S.cleanup_ticks()])[0].select(F.col("window_end").alias("cleanup_at"), "expired")


@query("str_10_dedup", "SELECT DISTINCT sha256(content) AS content_hash FROM {file_entries}")
def str_10(t):
    files = streams(t).file_entries.select("id", "uploaded_at", V.content_hash(F.col("content")).alias("content_hash"))
    folder = scratch_dir(t.spark, "first-files")
    for_each_batch(files, folder, partial(M.keep_first_deliveries, folder=folder))
    return M.first_deliveries(t.spark, folder).select("content_hash")


@query(
    "str_11_interval_join",
    """SELECT p.user_id, p.event_id AS purchase_id, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS purchase_time,
        c.event_id AS click_id, strftime(c.ts, '%Y-%m-%d %H:%M:%S') AS click_time
    FROM {events} p JOIN {events} c ON c.user_id = p.user_id AND c.ts BETWEEN p.ts - INTERVAL '30' MINUTE AND p.ts
    WHERE p.event_type = 'purchase' AND c.event_type = 'click'""",
)
def str_11(t):
    events = streams(t).events
    purchases = events.filter(F.col("event_type") == "purchase")
    clicks = events.filter(F.col("event_type") == "click")
    return result(t, S.interval_matches(purchases, clicks, delay=whole_delay(t, "events", "ts")), "matches")


# ---- incremental ingest ------------------------------------------------------------------------


def ingested(t):
    """Two deliveries as CSV files, ingested one after the other by the same stream."""
    folder = scratch_dir(t.spark, "ingest")
    handle = partial(I.ingest_batch, folder=folder, as_of="2024-01-01", author=1)
    for wave in ("stored_orders", "incoming_orders"):
        write_delimited(delivery(getattr(t, wave)), f"{folder}/in/{wave}")
        for_each_batch(I.arriving_files(t.spark, f"{folder}/in/*"), folder, handle)
    return folder


TYPED_SQL = """SELECT order_number, coalesce('ВМ ' || machine_code, 'UNKNOWN') AS machine_code, coalesce(order_price, 0) AS order_price,
        coalesce(payment_type, 'unknown') AS payment_type, creation_time"""
INGESTED_SQL = f"""SELECT coalesce(s.order_number, i.order_number) AS order_number,
        CASE WHEN s.order_number IS NULL OR (i.order_number IS NOT NULL AND (s.machine_code <> i.machine_code
             OR s.order_price <> i.order_price OR s.payment_type <> i.payment_type)) THEN 1 ELSE 0 END AS batch,
        s.order_number IS NULL AS fresh, i.machine_code AS im, i.order_price AS ip, i.payment_type AS it, i.order_number AS inum,
        s.machine_code AS sm, s.order_price AS sp, s.payment_type AS st, coalesce(s.creation_time, i.creation_time) AS creation_time
    FROM ({TYPED_SQL} FROM {{stored_orders}}) s FULL JOIN ({TYPED_SQL} FROM {{incoming_orders}}) i ON s.order_number = i.order_number"""


@query(
    "str_1_ingest",
    f"""SELECT order_number, cast(batch AS bigint) AS batch, CASE batch WHEN 1 THEN im ELSE sm END AS machine_code,
        cast(CASE batch WHEN 1 THEN ip ELSE sp END AS double) AS order_price, CASE batch WHEN 1 THEN it ELSE st END AS payment_type,
        cast(creation_time AS string) AS creation_time FROM ({INGESTED_SQL})""",
)
def str_1(t):
    return I.current_orders(t.spark, ingested(t)).select(
        "order_number", "batch", "machine_code", "order_price", "payment_type", "creation_time"
    )


@query(
    "str_2_run_log",
    """SELECT 'progress' AS type, cast(0 AS bigint) AS batch, (SELECT count(*) FROM {stored_orders}) AS processed_rows
    UNION ALL SELECT 'progress', 1, (SELECT count(*) FROM {stored_orders}) + (SELECT count(*) FROM {incoming_orders})
    UNION ALL SELECT 'completed', 1, (SELECT count(*) FROM {stored_orders}) + (SELECT count(*) FROM {incoming_orders})""",
)
def str_2(t):
    return I.run_log(t.spark, ingested(t)).select("type", "batch", "processed_rows")


# ---- aggregates kept up to date ----------------------------------------------------------------


PURGED = "1994-01-01"


def kept(t, after):
    """Three deliveries and a purge, each taken into the order table and the views; ``after(folder, batch)`` follows."""
    folder = scratch_dir(t.spark, "kept")
    incoming = t.incoming_orders
    for batch, rows in enumerate([t.stored_orders, incoming.filter("id % 2 = 0"), incoming.filter("id % 2 = 1")]):
        added = {"order_price": F.col("order_price").cast("decimal(20,2)"), "file": F.lit("f"), "arrived": F.lit("2024-01-01").cast("timestamp")}
        marks = {"batch": F.lit(batch).cast("bigint"), "deleted": F.lit(False)}
        columns = [c.split()[0] for c in I.ORDER_SCHEMA.split(", ")]
        delta = stored(rows.withColumns(added | marks).select(columns), "delivery")
        I.commit(t.spark, folder, batch, delta, I.current_orders(t.spark, folder, batch, delta))
        after(folder, batch)
    I.purge_orders(t.spark, folder, 3, F.col("creation_time") < F.lit(PURGED).cast("timestamp_ntz"), views=True)
    after(folder, 3)


KEPT_SQL = f"""WITH rows AS (
        SELECT order_number, machine_code, order_price, payment_type, creation_time, 0 AS batch FROM {{stored_orders}}
        UNION ALL SELECT order_number, machine_code, order_price, payment_type, creation_time, 1 + id % 2 FROM {{incoming_orders}}),
    states AS (
        SELECT b.batch, r.* EXCLUDE (batch) FROM rows r JOIN (SELECT unnest([0, 1, 2, 3]) AS batch) b ON r.batch <= b.batch
        QUALIFY row_number() OVER (PARTITION BY b.batch, order_number ORDER BY r.batch DESC) = 1),
    named AS (
        SELECT batch, order_price, unnest(['total', 'payment_type', 'machine', 'day', 'month']) AS view,
            unnest(['', coalesce(nullif(trim(payment_type), ''), 'Unknown'), coalesce(nullif(trim(machine_code), ''), 'Unknown'),
                strftime(creation_time, '%Y-%m-%d'), strftime(creation_time, '%Y-%m')]) AS name
        FROM states WHERE batch < 3 OR creation_time >= timestamp '{PURGED}'),
    kept AS (SELECT cast(batch AS bigint) AS batch, view, name, count(*) AS orders, count(order_price) AS priced,
            coalesce(sum(order_price), 0) AS revenue FROM named GROUP BY batch, view, name)"""


@query(
    "agg_1_kept_views",
    f"""{KEPT_SQL} SELECT batch, view, name, orders, priced, cast(revenue AS double) AS revenue,
        CASE WHEN priced > 0 THEN cast(revenue AS double) / priced END AS average_price FROM kept""",
)
def agg_1_kept(t):
    states = []

    def after(folder, batch):
        states.append(stored(W.current(t.spark, folder).withColumn("batch", F.lit(batch)), "state"))

    kept(t, after)
    return reduce(DataFrame.unionByName, states)


@query(
    "agg_5_kept_top_machines",
    f"""{KEPT_SQL} SELECT batch, name AS machine_code, orders, cast(revenue AS double) AS revenue,
        row_number() OVER (PARTITION BY batch ORDER BY revenue DESC, name) AS place FROM kept WHERE view = 'machine'
        QUALIFY place <= 10""",
)
def agg_5_kept(t):
    top, rows = W.TopNames("machine", n=10, reserve=10), []

    def after(folder, batch):
        rows.extend((batch, name, orders, revenue, i) for i, (name, revenue, orders) in enumerate(top.update(t.spark, folder, batch), 1))

    kept(t, after)
    return t.spark.createDataFrame(rows, "batch bigint, machine_code string, orders bigint, revenue decimal(38,2), place int")


@query(
    "udf_1_reader_registry",
    """SELECT column_name, count(*) AS cells FROM (
        SELECT 'order_number' AS column_name, order_number AS v FROM {sales_orders}
        UNION ALL SELECT 'machine_code', machine_code FROM {sales_orders} UNION ALL SELECT 'payment_type', payment_type FROM {sales_orders}
        UNION ALL SELECT 'price', cast(order_price AS string) FROM {sales_orders} UNION ALL SELECT 'date', 'x' FROM {sales_orders})
    WHERE v IS NOT NULL GROUP BY 1
    UNION ALL SELECT 'text_line', count(*) FROM {log_lines}""",
)
def udf_1(t):
    from tallyroll.sources.files import read_cells

    folder = scratch_dir(t.spark, "mixed")
    write_delimited(delivery(t.sales_orders), f"{folder}/orders")
    t.log_lines.select("line").write.text(f"{folder}/logs")
    return read_cells(t.spark, folder).groupBy("column_name").agg(F.count(F.lit(1)).alias("cells"))
