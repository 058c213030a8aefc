"""Hand-worked cases of the value functions."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyroll.functions import logs as L, values as V


def values(spark, texts, expression, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], f"i int, v {kind}").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_price(spark):
    cases = {
        "1 234,50": 1234.50, "15000 сум": 15000.00, "-5": 5.00, "1,234.50": 0.00, "abc": 0.00, "": 0.00,
        "1.": 1.00, ".5": 0.50, None: 0.00, "12.345": 12.35,
    }
    assert [float(x) for x in values(spark, list(cases), V.parse_price)] == list(cases.values())
    assert [str(x) for x in values(spark, ["99999999999.99", "9" * 30], V.parse_price)] == ["99999999999.99", "None"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="0123456789., -a", max_size=10), min_size=1, max_size=40))
def test_price_never_fails_and_is_never_negative(spark, texts):
    assert all(x >= 0 for x in values(spark, texts, V.parse_price))


def test_time(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02T03:04", "05.02.2024 10:11", "12/31/2024", "2024-13-01", "soon", None]
    want = ["2024-01-02 03:04:05", "2024-01-02 03:04:00", "2024-02-05 10:11:00", "2024-12-31 00:00:00"]
    assert values(spark, texts, lambda c: V.parse_time(c).cast("string")) == want + [None] * 3
    more = {
        "2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "2024-01-02T03:04:05+05:00": "2024-01-01 22:04:05",
        "2024-01-02 03:04:05.25-0330": "2024-01-02 06:34:05.25", "01/02/2024 10:00": "2024-01-02 10:00:00",
        "1.2.2024": "2024-02-01 00:00:00", "2024/01/02": "2024-01-02 00:00:00", "31/12/2024 9:05:06": "2024-12-31 09:05:06",
        "31.02.2024": None, "1.2.2024 25:00": None,
    }
    assert values(spark, list(more), lambda c: V.parse_time(c).cast("string")) == list(more.values())
    assert values(spark, ["soon"], lambda c: V.parse_time(c, F.lit("2024-01-01")).cast("string")) == ["2024-01-01 00:00:00"]


def test_human_size(spark):
    sizes = [0, 1, 1023, 1024, 1536, 5 * 1024**2, 3 * 1024**4]
    want = ["0 Bytes", "1 Bytes", "1023 Bytes", "1 KB", "2 KB", "5 MB", "3072 GB"]
    assert values(spark, sizes, V.human_size, "bigint") == want


def test_shorten_keeps_short_texts(spark):
    assert values(spark, ["x" * 30, "x" * 31, None], lambda c: V.shorten(c, 30)) == ["x" * 30, "x" * 30 + "...", None]


def test_visible_pages(spark):
    got = values(spark, [1, 5, 9], lambda c: V.visible_pages(c, F.lit(9).cast("bigint")), "bigint")
    assert got == [[1, 2, 3], [3, 4, 5, 6, 7], [7, 8, 9]]
    assert values(spark, [1], lambda c: V.visible_pages(c, F.lit(0).cast("bigint")), "bigint") == [[]]


def test_surrogates_are_unique_per_file_and_row(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "f string, r bigint")
    got = [r[0] for r in rows.select(V.surrogate_number(F.col("f"), F.col("r"))).collect()]
    assert len(set(got)) == 3 and all(x.startswith("AUTO_") for x in got)


def test_app_line(spark):
    line = "2025-01-28T14:30:00 - ERROR - app.files - FileProcessor duration: 12.5"
    row = L.enrich(spark.createDataFrame([(line,)], "line string")).collect()[0]
    assert (row.level, row.logger, row.message) == ("ERROR", "app.files", "FileProcessor duration: 12.5")
    assert (row.components, row.tags, row.duration) == (["file-processor"], ["error", "alert", "performance"], 12.5)


def test_access_line(spark):
    line = '10.0.0.1 - - [28/Jan/2025:14:30:00 +0000] "GET /api/v1/orders HTTP/1.1" 200 512'
    got = values(spark, [line, "other"], L.access_fields)
    assert (got[0].client_ip, got[0].method, got[0].request, got[0].response_code, got[0].bytes) == (
        "10.0.0.1", "GET", "/api/v1/orders", 200, 512,
    )
    assert str(got[0].time) == "2025-01-28 14:30:00" and got[1] is None


def test_duration_is_the_last_one_and_needs_the_pattern(spark):
    got = values(spark, ["duration: 1 duration: 2.5", "took 5", "performance ok"], L.duration_of)
    assert got == [2.5, None, None]


@pytest.mark.parametrize("text,want", [("{", None), ('{"request":{"method":"GET"},"response":{"status":200}}', ("GET", 200))])
def test_gateway(spark, text, want):
    got = values(spark, [text], L.gateway_fields)[0]
    assert (got and (got.method, got.status)) == want
