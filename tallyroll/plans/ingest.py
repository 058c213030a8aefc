"""Sources, parsing and file checks (SRC, FN, DQ-1, UDF). Files are written from the tables first."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tallyroll.functions import flatten as X, values as V
from tallyroll.operators import analytics as A, history as H, quality as Q
from tallyroll.plans.registry import query
from tallyroll.session import dealt, scratch_dir
from tallyroll.sources import files as S

# Keeps every written file far below the size limit of one file.
RECORDS_PER_FILE = 50_000


def write_delimited(df, folder, encoding="utf-8", sep=","):
    df.write.option("maxRecordsPerFile", RECORDS_PER_FILE).csv(folder, header=True, sep=sep, encoding=encoding, emptyValue="")


def delivery(orders):
    """Orders as a delivery writes them: prices with a decimal comma, days first."""
    return orders.select(
        "order_number", F.concat(F.lit("ВМ "), F.col("machine_code")).alias("machine_code"),
        F.replace(F.col("order_price").cast("string"), F.lit("."), F.lit(",")).alias("price"), "payment_type",
        F.date_format("creation_time", "dd.MM.yyyy HH:mm").alias("date"),
    )


DELIVERY_SQL = """order_number, coalesce('ВМ ' || machine_code, 'UNKNOWN') AS machine_code,
        cast(coalesce(order_price, 0) AS double) AS order_price, coalesce(payment_type, 'unknown') AS payment_type,
        cast(creation_time AS string) AS creation_time, 'new' AS match_status FROM {sales_orders}"""


@query("src_1_csv_encodings", f"SELECT 'utf-8' AS encoding, {DELIVERY_SQL} UNION ALL SELECT 'cp1251', {DELIVERY_SQL}")
def src_1(t):
    folder = scratch_dir(t.spark, "csv")
    rows = delivery(t.sales_orders)
    write_delimited(rows, f"{folder}/english")
    russian = rows.toDF("номер_заказа", "код_автомата", "цена", "тип_оплаты", "дата_создания")
    write_delimited(S.as_cp1251(russian), f"{folder}/russian", encoding="ISO-8859-1")
    records = S.delimited_records(S.binary_files(t.spark, folder, "csv"), lower_headers=True)
    orders = H.typed_orders(records, F.lit("2024-01-01"), ["encoding"])
    return orders.drop("file", "row_number")


@query(
    "src_2_csv_strings",
    """SELECT order_number, coalesce(machine_code, '') AS machine_code, coalesce(cast(order_price AS string), '') AS order_price,
        coalesce(payment_type, '') AS payment_type FROM {sales_orders}""",
)
def src_2(t):
    folder = scratch_dir(t.spark, "strings")
    rows = t.sales_orders.select("order_number", "machine_code", "order_price", "payment_type")
    rows.withColumnRenamed("order_number", " Order_Number ").write.csv(folder, header=True, ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)
    return S.csv_strings(t.spark, folder)


@query(
    "src_3_tsv",
    """SELECT order_number, column_name, new_value FROM (
        SELECT order_number, 'machine_code' AS column_name, 'ВМ ' || machine_code AS new_value FROM {sales_orders}
        UNION ALL SELECT order_number, 'price', replace(cast(order_price AS string), '.', ',') FROM {sales_orders}
        UNION ALL SELECT order_number, 'payment_type', payment_type FROM {sales_orders}
        UNION ALL SELECT order_number, 'date', strftime(creation_time, '%d.%m.%Y %H:%M') FROM {sales_orders})
    WHERE new_value IS NOT NULL""",
)
def src_3(t):
    folder = scratch_dir(t.spark, "tsv")
    write_delimited(delivery(t.sales_orders), folder, sep="\t")
    files = t.spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), "content")
    records = S.delimited_records(files, sep="\t")
    keyed = records.withColumn("file", F.col("cells")["order_number"])
    cells = S.record_cells(keyed).filter(F.col("column_name") != "order_number")
    return cells.select(F.col("file").alias("order_number"), "column_name", "new_value")


LINES_SQL = r"""SELECT id, i + 1 AS row_number, regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS line
    FROM (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i
          FROM {file_entries})"""


@query("src_4_text_lines", f"SELECT * FROM ({LINES_SQL}) WHERE line <> ''")
def src_4(t):
    return S.text_lines(t.file_entries, "id", "content")


@query(
    "src_4_text_totals",
    f"SELECT id, count(*) AS total_rows, count(*) FILTER (line <> '') AS processed_rows FROM ({LINES_SQL}) GROUP BY 1",
)
def src_4_totals(t):
    return S.text_totals(t.file_entries, "id", "content")


JSON_TEXT = """SELECT event_id, '{"event":{"id":' || event_id || ',"kind":"' || event_type || '","props":' || props ||
        '},"list":[' || user_id || ',{"amount":"' || cast(value AS decimal(10,2)) || '"},[]],"none":null,"empty":{}}' AS body FROM {events}"""
FLAT_JSON_SQL = f"""SELECT event_id, path, value FROM (
        SELECT event_id, regexp_replace(replace(replace(replace(fullkey, '$.', ''), '"', ''), ']', ''), '\\[', '.', 'g') AS path,
            trim(cast(atom AS string), '"') AS value, type
        FROM ({JSON_TEXT}) x, LATERAL (SELECT fullkey, atom, type FROM json_tree(x.body)) j
        WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL'))"""


def json_bodies(t):
    """JSON documents of several levels, put together from events by Spark."""
    return dealt(t.events.select("event_id", "user_id", "event_type", "value", "props")).select(
        "event_id",
        F.concat(
            F.lit('{"event":{"id":'), F.col("event_id").cast("string"), F.lit(',"kind":"'), "event_type", F.lit('","props":'), "props",
            F.lit('},"list":['), F.col("user_id").cast("string"), F.lit(',{"amount":"'),
            F.col("value").cast("decimal(10,2)").cast("string"), F.lit('"},[]],"none":null,"empty":{}}'),
        ).alias("body"),
    )


@query("src_5_json_flatten", FLAT_JSON_SQL)
def src_5(t):
    return X.flatten_json(json_bodies(t), "body").select("event_id", "path", "value")


def _xml_expected(pos, path, value, attributes="''"):
    return f"SELECT id, {pos} AS pos, '{path}' AS path, {value} AS value, {attributes} AS attributes FROM {{app_users}}"


FLAT_XML_SQL = " UNION ALL ".join(
    [
        _xml_expected(0, "user@id", "cast(id AS string)"),
        _xml_expected(1, "user@role", "role"),
        _xml_expected(2, "user.name", "username"),
        _xml_expected(3, "user.state.status", "status"),
        _xml_expected(4, "user.state.mail", "email", "'main=' || CASE WHEN nation_id < 10 THEN 'true' ELSE 'false' END"),
    ]
)


def xml_bodies(t):
    return t.app_users.select(
        "id",
        F.concat(
            F.lit('<user id="'), F.col("id").cast("string"), F.lit('" role="'), "role", F.lit('"> <name>'), "username",
            F.lit("</name><state><status>"), "status", F.lit('</status><mail main="'), (F.col("nation_id") < 10).cast("string"),
            F.lit('"> '), "email", F.lit(" </mail></state><empty/></user>"),
        ).alias("body"),
    )


@query(
    "src_6_xml_flatten",
    FLAT_XML_SQL
    + " UNION ALL SELECT id, 5, 'user.state.mail@main', CASE WHEN nation_id < 10 THEN 'true' ELSE 'false' END, '' FROM {app_users}",
)
def src_6(t):
    pairs = F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return X.flatten_xml(xml_bodies(t), "body").select("id", "pos", "path", "value", F.array_join(pairs, ";").alias("attributes"))


@query("udf_2_sql_table_function", f"SELECT path, count(*) AS leaves, count(DISTINCT value) AS texts FROM ({FLAT_JSON_SQL}) GROUP BY 1")
def udf_2(t):
    X.register(t.spark)
    return t.spark.sql(
        """SELECT f.path, count(*) AS leaves, count(DISTINCT f.value) AS texts
        FROM {bodies} b, LATERAL flatten_json(b.body) f GROUP BY f.path""",
        bodies=json_bodies(t),
    )


def archives(t):
    """One ZIP per file entry: the text, a small table and a member that is not read."""

    def packed(file_id, text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("doc/text.txt", text)
            z.writestr("rows.csv", f"order_number,price\nA{file_id},1\nB{file_id},2\n")
            z.writestr("tool.exe", "x")
        return out.getvalue()

    def pack(batches):
        for batch in batches:
            content = [packed(i, text) for i, text in zip(batch["id"], batch["content"])]
            yield pd.DataFrame({"file": batch["id"].astype(str) + ".zip", "content": content})

    return t.file_entries.select("id", "content").mapInPandas(pack, "file string, content binary")


@query(
    "src_7_archives",
    """SELECT id || '.zip' AS archive, 'doc/text.txt' AS member, 'txt' AS format, strlen(content) AS size, sha256(content) AS hash
        FROM {file_entries}
    UNION ALL SELECT id || '.zip', 'rows.csv', 'csv', strlen(body), sha256(body) FROM (SELECT id, 'order_number,price' || chr(10)
        || 'A' || id || ',1' || chr(10) || 'B' || id || ',2' || chr(10) AS body FROM {file_entries})""",
)
def src_7(t):
    return X.expand_archives(archives(t), "file").filter(F.col("error").isNull()).select(
        "archive", "member", "format", F.octet_length("bytes").cast("bigint").alias("size"), F.sha2("bytes", 256).alias("hash")
    )


@query(
    "agg_10_archive_totals",
    f"""SELECT id || '.zip' AS archive, cast(2 AS bigint) AS extracted_files, n + 4 AS total_rows, m + 3 AS processed_rows,
        'doc/text.txt,rows.csv' AS files_processed
    FROM (SELECT id, count(*) AS n, count(*) FILTER (line <> '') AS m FROM ({LINES_SQL}) GROUP BY 1)""",
)
def agg_10(t):
    members = X.expand_archives(archives(t), "file").filter(F.col("error").isNull())
    texts = members.select(F.struct("archive", "member").alias("k"), F.col("bytes").cast("string").alias("text"))
    return A.archive_totals(S.text_totals(texts, "k", "text").select("k.*", "total_rows", "processed_rows"))


@query(
    "udf_3_archive_cells",
    f"""SELECT id || '.zip/doc/text.txt' AS file, row_number, 'text_line' AS column_name, line AS new_value
        FROM ({LINES_SQL}) WHERE line <> ''
    UNION ALL SELECT id || '.zip/rows.csv', r, 'order_number', CASE r WHEN 1 THEN 'A' ELSE 'B' END || id
        FROM {{file_entries}}, (SELECT unnest([1, 2]) AS r)
    UNION ALL SELECT id || '.zip/rows.csv', r, 'price', cast(r AS string) FROM {{file_entries}}, (SELECT unnest([1, 2]) AS r)
    UNION ALL SELECT id || '.zip/tool.exe', 0, 'error', 'unsupported format: exe' FROM {{file_entries}}""",
)
def udf_3(t):
    return S.zip_cells(archives(t))


@query(
    "src_8_catalogue",
    """SELECT id, original_name, lower(regexp_extract(original_name, '[^/]\\.([^./]+)$', 1)) AS file_type, strlen(content) AS file_size,
        sha256(content) AS content_hash, 'uploads/' || original_name AS storage_path FROM {file_entries}""",
)
def src_8(t):
    return S.catalogue(t.file_entries, "original_name", "content").select(
        "id", "original_name", "file_type", "file_size", "content_hash", "storage_path"
    )


MIME_SQL = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.FORMATS.items()) + " END"


@query(
    "src_9_formats",
    f"""SELECT id, ext AS file_type, {MIME_SQL} AS mime_type,
        CASE WHEN {MIME_SQL} IS NULL THEN 'unsupported file format: ' || ext END AS format_error
    FROM (SELECT id, lower(regexp_extract(original_name, '[^/]\\.([^./]+)$', 1)) AS ext FROM {{file_entries}})""",
)
def src_9(t):
    return S.detect_format(t.file_entries.select("id", "original_name"), "original_name").drop("original_name")


@query(
    "src_10_sheets",
    """SELECT order_number, cast(order_price AS double) AS order_price, NULL AS payment, 'hardware' AS _sheet_name FROM {sales_orders}
    UNION ALL SELECT order_number, cast(amount AS double), NULL, 'sales' FROM {sales_reports}
    UNION ALL SELECT order_number, NULL, cast(amount AS double), 'payme' FROM {payme_payments}""",
)
def src_10(t):
    return S.union_sheets(
        {
            "hardware": t.sales_orders.select("order_number", "order_price"),
            "sales": t.sales_reports.select("order_number", F.col("amount").alias("order_price")),
            "payme": t.payme_payments.select("order_number", F.col("amount").alias("payment")),
        }
    )


@query(
    "src_11_table_scan",
    "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderdate >= '1999-01-01' AND o_orderstatus = 'F'",
)
def src_11(t):
    recent = (F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "F")
    return t.orders.filter(recent).select("o_orderkey", "o_totalprice")


# ---- value parsing -----------------------------------------------------------------------------

PRICE_TEXT = """CASE WHEN id % 7 = 0 THEN '-' || cast(order_price AS string) WHEN id % 7 = 1 THEN replace(cast(order_price AS string), '.', ',')
        WHEN id % 7 = 2 THEN cast(order_price AS string) || ' сум' WHEN id % 7 = 3 THEN '1,' || cast(order_price AS string)
        WHEN id % 7 = 4 THEN 'n/a' WHEN id % 7 = 5 THEN ' ' || replace(cast(order_price AS string), '.', ' ') ELSE cast(order_price AS string) END"""


@query(
    "fn_1_price_parse",
    f"""SELECT id, cast(coalesce(try_cast(regexp_replace(replace(replace(v, ',', '.'), ' ', ''), '[^0-9.]', '', 'g') AS decimal(12,2)), 0) AS double) AS price
    FROM (SELECT id, {PRICE_TEXT} AS v FROM {{sales_orders}})""",
)
def fn_1(t):
    return t.sales_orders.select("id", V.parse_price(F.expr(PRICE_TEXT)).alias("price"))


@query(
    "fn_2_time_parse",
    """SELECT id, CASE WHEN created_by % 4 = 3 THEN '2024-01-01 00:00:00' ELSE cast(creation_time AS string) END AS parsed FROM {sales_orders}""",
)
def fn_2(t):
    text = (
        F.when(F.col("created_by") % 4 == 0, F.date_format("creation_time", "dd.MM.yyyy HH:mm"))
        .when(F.col("created_by") % 4 == 1, F.date_format("creation_time", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(F.col("created_by") % 4 == 2, F.date_format("creation_time", "MM/dd/yyyy"))
        .otherwise("soon")
    )
    return t.sales_orders.select("id", V.parse_time(text, F.lit("2024-01-01")).alias("parsed"))


@query(
    "fn_3_alias_coalesce",
    """SELECT id, CASE WHEN payment_type IS NULL THEN order_number || '-b' ELSE order_number END AS order_number,
        coalesce(machine_code, 'M' || created_by) AS machine_code FROM {sales_orders}""",
)
def fn_3(t):
    wide = t.sales_orders.select(
        "id", F.when(F.col("payment_type").isNull(), " ").otherwise(F.col("order_number")).alias(" Order_Number"),
        F.concat("order_number", F.lit("-b")).alias("НОМЕР_ЗАКАЗА "), F.coalesce("machine_code", F.lit("")).alias("machine_code"),
        F.concat(F.lit("M"), F.col("created_by").cast("string")).alias("machine_id"),
    )
    clean = V.normalise_headers(wide)
    return clean.select(
        "id", *[V.first_present(clean.columns, V.FIELD_ALIASES[f]).alias(f) for f in ("order_number", "machine_code")]
    )


@query(
    "fn_4_headers",
    "SELECT id AS number, order_number AS order_text, machine_code AS machine FROM {sales_orders}",
)
def fn_4(t):
    return V.normalise_headers(t.sales_orders.select("id", "order_number", "machine_code").toDF(" Number", "ORDER_Text ", "Machine"))


@query(
    "fn_5_defaults",
    """SELECT id, coalesce(order_number, 'none') AS order_number, coalesce(machine_code, 'UNKNOWN') AS machine_code,
        cast(coalesce(order_price, 0) AS double) AS order_price, coalesce(payment_type, 'unknown') AS payment_type,
        cast(creation_time AS string) AS creation_time, 'new' AS match_status FROM {sales_orders}""",
)
def fn_5(t):
    rows = t.sales_orders.select(
        "id", "order_number", "machine_code", "order_price", "payment_type", "creation_time",
        F.col("source_file_id").alias("file"), F.col("id").alias("row_number"),
    )
    return V.with_defaults(rows, F.lit("2024-01-01")).drop("file", "row_number")


@query("fn_7_hash", "SELECT id, sha256(content) AS content_hash FROM {file_entries}")
def fn_7(t):
    return t.file_entries.select("id", V.content_hash(F.col("content")).alias("content_hash"))


@query(
    "fn_8_file_size",
    """SELECT id, CASE WHEN n >= 1073741824 THEN cast(floor(n / 1073741824 + 0.5) AS bigint) || ' GB'
        WHEN n >= 1048576 THEN cast(floor(n / 1048576 + 0.5) AS bigint) || ' MB'
        WHEN n >= 1024 THEN cast(floor(n / 1024 + 0.5) AS bigint) || ' KB' ELSE n || ' Bytes' END AS size_text
    FROM (SELECT id, strlen(content) * strlen(content) AS n FROM {file_entries})""",
)
def fn_8(t):
    size = F.octet_length("content").cast("bigint")
    return t.file_entries.select("id", V.human_size(size * size).alias("size_text"))


# ---- validation --------------------------------------------------------------------------------


@query(
    "dq_1_validation",
    f"""SELECT id, ext AS file_type, strlen(content) AS file_size, {MIME_SQL} AS mime_type,
        CASE WHEN {MIME_SQL} IS NULL THEN 'unsupported format: ' || ext WHEN strlen(content) = 0 THEN 'file is empty'
             WHEN ext IN ('csv', 'tsv') AND trim(content, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'no data'
             WHEN ext = 'json' AND NOT json_valid(content) THEN 'invalid JSON' WHEN ext = 'xml' THEN 'invalid XML'
             WHEN ext = 'pdf' AND NOT starts_with(content, '%PDF') THEN 'invalid PDF' ELSE '' END AS errors,
        (ext IN ('csv', 'tsv', 'txt') AND strlen(content) > 0 AND NOT (ext <> 'txt' AND trim(content, ' ' || chr(9) || chr(10) || chr(13)) = ''))
            OR (ext = 'json' AND json_valid(content)) OR (ext = 'pdf' AND starts_with(content, '%PDF')) AS valid
    FROM (SELECT id, content, lower(regexp_extract(original_name, '[^/]\\.([^./]+)$', 1)) AS ext FROM {{file_entries}})""",
)
def dq_1(t):
    return Q.validate_files(t.file_entries.select("id", "original_name", "content"), "original_name", "content").drop(
        "original_name", "content"
    )
