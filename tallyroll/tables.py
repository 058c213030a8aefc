"""Logical tables of the order business, read from the TPC-H-like inputs.

Every text below is accepted by Spark and by DuckDB alike; names in braces are other
tables. Times stay TIMESTAMP_NTZ, so date filters still reach the Parquet scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DERIVED: dict[str, str] = {
    # central fact: one row per order number
    "sales_orders": """
        SELECT o_orderkey AS id,
               'VN' || lpad(cast(o_orderkey AS string), 10, '0') AS order_number,
               CASE WHEN o_orderkey % 101 = 0 THEN NULL
                    ELSE 'VM-' || lpad(cast(o_custkey % 47 AS string), 3, '0') END AS machine_code,
               CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN NULL
                    ELSE cast(o_totalprice AS decimal(12,2)) END AS order_price,
               o_orderdate AS creation_time,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Card' WHEN '2-HIGH' THEN 'Cash'
                    WHEN '3-MEDIUM' THEN 'Digital' WHEN '5-LOW' THEN 'Cash' END AS payment_type,
               CASE o_orderstatus WHEN 'F' THEN 'matched' WHEN 'O' THEN 'unmatched'
                    ELSE 'partial' END AS match_status,
               o_custkey AS created_by,
               o_orderkey % 200 AS source_file_id
        FROM {orders}""",
    # what is already known, and a later delivery that overlaps it
    "stored_orders": "SELECT * FROM {sales_orders} WHERE creation_time < '2000-01-01'",
    "incoming_orders": """
        SELECT id, order_number,
               CASE WHEN match_status = 'partial' AND created_by % 5 = 0 THEN 'VM-900'
                    ELSE machine_code END AS machine_code,
               CASE WHEN payment_type = 'Digital' THEN cast(order_price * 1.05 AS decimal(12,2))
                    ELSE order_price END AS order_price,
               creation_time,
               CASE WHEN payment_type IS NULL AND match_status <> 'partial' THEN 'Card'
                    WHEN payment_type = 'Card' AND match_status = 'matched' THEN NULL
                    ELSE payment_type END AS payment_type,
               CASE WHEN match_status = 'unmatched' AND created_by % 3 = 0 THEN 'matched'
                    ELSE match_status END AS match_status,
               created_by, source_file_id
        FROM {sales_orders} WHERE creation_time >= '1996-07-01'""",
    # append-only history, several rows per order and version
    "order_changes": """
        SELECT l_orderkey AS order_id, l_linenumber AS version,
               CASE l_partkey % 4 WHEN 0 THEN 'machine_code' WHEN 1 THEN 'order_price'
                    WHEN 2 THEN 'payment_type' ELSE 'match_status' END AS field_name,
               CASE WHEN l_returnflag = 'N' THEN '' ELSE cast(l_partkey AS string) END AS old_value,
               cast(l_suppkey AS string) || ':' || cast(cast(l_quantity AS int) AS string) AS new_value,
               CASE WHEN l_returnflag = 'N' THEN 'new' WHEN l_returnflag = 'A' THEN 'filled'
                    WHEN l_linestatus = 'O' THEN 'updated' ELSE 'changed' END AS change_type,
               l_shipdate AS changed_at, l_suppkey AS changed_by
        FROM {lineitem}""",
    "app_users": """
        SELECT c_custkey AS id, c_name AS username,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'pending' WHEN 'MACHINERY' THEN 'blocked'
                    ELSE 'approved' END AS status,
               CASE WHEN c_nationkey = 7 THEN 'admin' ELSE 'user' END AS role,
               c_acctbal < 0 AS is_deactivated,
               '+998' || lpad(cast(c_custkey AS string), 9, '0') AS phone,
               CASE WHEN c_nationkey = 3 THEN 'no mail' ELSE
                    replace(lower(c_name), '#', '.') || '@example.com' END AS email,
               c_nationkey AS nation_id, cast(c_acctbal AS decimal(12,2)) AS balance
        FROM {customer}""",
    "file_entries": """
        SELECT doc_id AS id,
               source || '_' || cast(doc_id AS string) ||
               CASE doc_id % 8 WHEN 0 THEN '.csv' WHEN 1 THEN '.TXT' WHEN 2 THEN '.json'
                    WHEN 3 THEN '.xml' WHEN 4 THEN '.tsv' WHEN 5 THEN '.pdf'
                    WHEN 6 THEN '.exe' ELSE '' END AS original_name,
               text AS content,
               cast(replace(source, 'src', '') AS bigint) AS uploaded_by,
               cast('2024-01-01 00:00:00' AS timestamp) + doc_id * INTERVAL '1' MINUTE AS uploaded_at,
               CASE lang WHEN 'en' THEN 'completed' WHEN 'fr' THEN 'pending'
                    WHEN 'de' THEN 'failed' ELSE 'processing' END AS processing_status,
               n_chars AS char_count
        FROM {documents}""",
    "run_sessions": """
        SELECT event_id AS id, user_id AS created_by, ts AS started_at,
               CASE WHEN value < 5 THEN 'started' WHEN value < 20 THEN 'processing'
                    WHEN value < 200 THEN 'completed' ELSE 'failed' END AS status
        FROM {events} WHERE event_type = 'signup'""",
    "access_sessions": """
        SELECT event_id AS id, user_id,
               CASE WHEN value < 30 THEN 'admin_' ELSE 'tok_' END || cast(event_id AS string) AS token,
               ts AS created_at,
               ts + CASE WHEN value < 30 THEN INTERVAL '8' HOUR ELSE INTERVAL '2' HOUR END AS expires_at,
               value >= 3 AS is_active
        FROM {events} WHERE event_type IN ('signup', 'purchase')""",
    # one log line per event, at second resolution as log files have it
    "log_records": """
        SELECT event_id, user_id, event_type, date_trunc('second', ts) AS seen_at,
               cast(cast(value AS decimal(10,2)) AS string) AS amount_text,
               CASE WHEN event_type = 'error' AND value > 100 THEN 'CRITICAL'
                    WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'view' THEN 'DEBUG'
                    WHEN event_type = 'signup' THEN 'WARNING' ELSE 'INFO' END AS severity,
               CASE event_type WHEN 'error' THEN 'FileProcessor failed, duration: '
                    WHEN 'click' THEN 'Telegram auth pressed by ' || cast(user_id AS string) || ' after '
                    WHEN 'purchase' THEN 'SQL insert duration '
                    WHEN 'view' THEN 'performance page '
                    ELSE 'Auth signup into database ' END ||
               cast(cast(value AS decimal(10,2)) AS string) AS body
        FROM {events}""",
    "log_lines": """
        SELECT event_id, seen_at,
               replace(cast(seen_at AS string), ' ', 'T') || ' - ' || severity || ' - app.' ||
               event_type || ' - ' || body AS line
        FROM {log_records}""",
    "access_lines": """
        SELECT event_id,
               '10.' || cast(cast(floor(user_id / 65536) AS int) AS string) || '.' ||
               cast(cast(floor(user_id / 256) AS int) % 256 AS string) || '.' ||
               cast(user_id % 256 AS string) || ' - - [' ||
               lpad(cast(day(seen_at) AS string), 2, '0') || '/' ||
               substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(month(seen_at) AS int) * 3 - 2, 3) || '/' ||
               cast(year(seen_at) AS string) || ':' || substr(cast(seen_at AS string), 12, 8) || ' +0000] "' ||
               CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'GET' ELSE 'POST' END ||
               ' /api/v1/' || event_type || '?u=' || cast(user_id AS string) || ' HTTP/1.1" ' ||
               CASE event_type WHEN 'error' THEN '500' ELSE '200' END || ' ' ||
               cast(event_id % 1000 AS string) AS line
        FROM {log_records}""",
    "requests": """
        SELECT event_id AS id, date_trunc('second', ts) AS seen_at, user_id AS client,
               CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'GET' ELSE 'POST' END AS method,
               '/api/v1/' || event_type AS endpoint,
               CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status,
               cast(value AS decimal(10,2)) AS duration_ms
        FROM {events}""",
    "logins": """
        SELECT event_id AS id, date_trunc('second', ts) AS seen_at, user_id AS client,
               event_type = 'signup' AS success
        FROM {events} WHERE event_type IN ('error', 'signup')""",
    # reconciliation inputs with an order number
    "sales_reports": """
        SELECT order_number,
               CASE WHEN payment_type = 'Digital' THEN cast(order_price + 1 AS decimal(12,2))
                    ELSE order_price END AS amount, creation_time AS seen_at
        FROM {sales_orders} WHERE match_status <> 'partial'""",
    "payme_payments": """
        SELECT CASE WHEN match_status = 'partial' THEN replace(order_number, 'VN', 'XP')
                    WHEN payment_type IS NULL THEN '' ELSE order_number END AS order_number,
               order_price AS amount, creation_time AS seen_at
        FROM {sales_orders} WHERE payment_type IS NULL OR payment_type <> 'Cash'""",
    # receipts of the cash register, which know only amount and time
    "fiscal_receipts": """
        SELECT id, amount, seen_at + id % 5 * INTERVAL '1' MINUTE AS seen_at FROM {timed_orders} WHERE id % 3 = 0""",
    # sales on a short price list, and payments that carry no order number
    "timed_orders": """
        SELECT o_orderkey AS id,
               cast(1000 + cast(floor(o_totalprice / 25000) AS int) * 500 AS decimal(12,2)) AS amount,
               o_orderdate + (o_custkey * 37 % 1440) * INTERVAL '1' MINUTE AS seen_at
        FROM {orders}""",
    # timed orders with their order number
    "timed_sales": """
        SELECT o_orderkey AS id,
               'VN' || lpad(cast(o_orderkey AS string), 10, '0') AS order_number,
               cast(1000 + cast(floor(o_totalprice / 25000) AS int) * 500 AS decimal(12,2)) AS amount,
               o_orderdate + (o_custkey * 37 % 1440) * INTERVAL '1' MINUTE AS seen_at
        FROM {orders} WHERE o_orderkey IS NOT NULL""",
    # timed orders with machine and kind of payment, as terminals report them: sometimes missing, sometimes wrong
    "terminal_orders": """
        SELECT t.id, t.amount, t.seen_at, s.machine_code, s.payment_type
        FROM {timed_orders} t JOIN {sales_orders} s ON s.id = t.id""",
    "terminal_payments": """
        SELECT p.id, p.amount, p.seen_at,
               CASE WHEN p.id % 11 = 0 THEN NULL WHEN p.id % 13 = 0 THEN 'VM-999' ELSE s.machine_code END AS machine,
               CASE WHEN p.id % 17 = 0 THEN 'Cash' ELSE s.payment_type END AS kind
        FROM {loose_payments} p JOIN {sales_orders} s ON s.id = p.id""",
    "loose_payments": """
        SELECT o_orderkey AS id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'click' WHEN '2-HIGH' THEN 'click'
                    WHEN '3-MEDIUM' THEN 'uzum' ELSE 'uzum' END AS provider,
               cast(CASE WHEN o_orderstatus = 'P' THEN 1250
                    ELSE 1000 + cast(floor(o_totalprice / 25000) AS int) * 500 END AS decimal(12,2)) AS amount,
               o_orderdate + (o_custkey * 37 % 1440 + o_orderkey % 9 - 4) * INTERVAL '1' MINUTE AS seen_at
        FROM {orders}""",
}


def references(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


class Tables:
    """``Tables(spark, folder).sales_orders`` and so on; base tables by their own names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE_TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in DERIVED:
                self._made[name] = self.sql(DERIVED[name])
            else:
                raise AttributeError(name)
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in references(text)})


def duckdb_sql(text: str) -> str:
    """The same text for DuckDB: derived tables become common table expressions."""
    ctes: dict[str, str] = {}

    def visit(body: str) -> None:
        for name in references(body):
            if name in DERIVED and name not in ctes:
                visit(DERIVED[name])
                ctes[name] = re.sub(r"\{(\w+)\}", r"\1", DERIVED[name])

    visit(text)
    body = re.sub(r"\{(\w+)\}", r"\1", text).strip()
    if not ctes:
        return body
    head = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
