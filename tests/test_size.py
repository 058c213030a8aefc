"""What larger tables need: work that is dealt to all cores, and bytes that stay few."""

import glob
import os
import random
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroll.functions import flatten as X, logs as L
from tallyroll.operators import quality as Q, reconcile as R
from tallyroll.plans.ingest import json_bodies
from tallyroll.plans.joining import numbered_sales
from tallyroll.session import dealt, scratch_dir
from tallyroll.sinks import exports
from tallyroll.tables import Tables

CHANGES = "order_id bigint, version bigint, field_name string, old_value string, new_value string, change_type string, changed_at timestamp_ntz"


def test_change_documents_are_written_compressed(spark):
    rows = [(i, 1, "price", "", str(i), "new", datetime(2024, 1, 1)) for i in range(500)]
    orders = spark.createDataFrame([(i, f"VN{i}") for i in range(500)], "id bigint, order_number string")
    folder = scratch_dir(spark, "json")
    exports.write_change_json(orders, spark.createDataFrame(rows, CHANGES), F.lit("2024-01-01").cast("timestamp_ntz"), folder)
    names = glob.glob(f"{folder.removeprefix('file:')}/part-*")
    assert names and all(n.endswith(".json.gz") for n in names)
    # 500 documents of over 300 characters each.
    assert sum(os.path.getsize(n) for n in names) < 50_000
    back = spark.read.schema("export_info struct<order_id:bigint>, changes array<struct<new_value:string>>").json(folder)
    assert sorted((r[0].order_id, r[1][0].new_value) for r in back.collect()) == sorted((i, str(i)) for i in range(500))


@pytest.mark.parametrize(
    "text",
    [
        '{"a": {"b": 1, "c": [true, null, {"d": "x"}]}, "e": -0.5}',
        '{"a": {"b": 1}, "a": {"c": 2}, "a.b": 3}',
        '{"": {"": 1, "x": NaN}, "list": [[], {}, [[2]]]}',
        ' "text" ',
        "[" * 20_000 + "1" + "]" * 20_000,
        '{"n":' * 3_000 + "1" + "}" * 3_000,
    ],
)
def test_leaves_are_those_of_the_plain_parser(text):
    assert repr(list(X.leaves_by_path(text).items())) == repr(list(dict(X.json_leaves(text)).items()))


@pytest.mark.parametrize("text", [None, b"{}", "", "[1,]", '{"a":1,}', "{} x", '{"a" 1}', "﻿{}"])
def test_what_is_not_json_has_no_rows(text):
    assert list(X.json_rows(text)) == []


def one_row_group(spark, rows):
    """Rows in one Parquet file of one row group, which one task reads."""
    folder = scratch_dir(spark, "one")
    rows.coalesce(1).write.parquet(folder)
    return spark.read.parquet(folder)


def rows_per_task(df):
    return sorted(n for (n,) in df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1))).select("count(1)").collect())


def test_json_bodies_of_one_row_group_are_parsed_in_many_tasks(spark):
    events = spark.range(4000).select(
        F.col("id").alias("event_id"), F.lit(7).cast("bigint").alias("user_id"), F.lit("click").alias("event_type"),
        F.lit(1.5).alias("value"), F.lit('{"k":1}').alias("props"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
    )
    tables = type("T", (), {"events": one_row_group(spark, events), "spark": spark})
    sizes = rows_per_task(json_bodies(tables))
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 1000
    X.register(spark)
    leaves = spark.sql("SELECT f.path, f.value FROM {b} b, LATERAL flatten_json(b.body) f", b=json_bodies(tables))
    # One call for many rows, not a table of its own for each.
    assert "ArrowEvalPythonUDTF" not in leaves._jdf.queryExecution().toString()
    assert leaves.filter("path = 'event.props.k' AND value = '1'").count() == 4000


def test_dealt_rows_stay_the_same_rows(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "x")], "a bigint, b string")
    assert sorted(map(str, dealt(rows).collect())) == sorted(map(str, rows.collect()))


LINES = [
    "2024-01-01T10:00:00,5 - ERROR - app.x - SQL duration: 3.5 then duration 7",
    '10.0.0.1 - - [02/Jan/2024:03:04:05 +0000] "GET /a HTTP/1.1" 500 12',
    '2024-01-01 10:00:00 - INFO - app.web - 10.0.0.1 - - [02/Jan/2024:03:04:05 +0000] "GET /a HTTP/1.1" 404 12',
    '{"client_ip":"c1","request":{"method":"GET","uri":"/u"},"response":{"status":200},"correlation_id":"t1"}',
    "{broken", "no form, Auth duration", "", None,
]


def test_log_lines_match_each_pattern_once(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "line string")
    plan = L.enrich(lines)._jdf.queryExecution().analyzed().toString()
    # Once per form of line, however many of its groups are named.
    assert plan.count("regexp_replace(") == 2 and plan.count("try_parse_json(") == 1
    rows = L.enrich(lines).select("level", "response_code", "components", "tags", "duration", "service", "trace_id").collect()
    assert [tuple(r) for r in rows] == [
        ("ERROR", None, ["database"], ["error", "alert", "performance"], 7.0, "backend", None),
        (None, 500, [], [], None, "backend", None),
        ("INFO", 404, [], [], None, "backend", None),
        (None, 200, ["api-gateway"], [], None, "gateway", "t1"),
        (None, None, [], [], None, "backend", None),
        (None, None, ["authentication"], [], None, "backend", None),
        (None, None, [], [], None, "backend", None),
        (None, None, [], [], None, "backend", None),
    ]


@pytest.mark.parametrize("pattern", ["SQL|database", r"dur\w+", "a.b"])
def test_mentions_are_those_of_the_pattern(spark, pattern):
    texts = spark.createDataFrame([(x,) for x in ["SQL", "my database", "duration", "axb", "a.b", "", None]], "t string")
    assert texts.filter(~L._mentions(F.col("t"), pattern).eqNullSafe(F.col("t").rlike(pattern))).count() == 0


def shown(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sold(spark, n, each):
    """``each`` rows at every of so many minutes, all at one price."""
    rows = [(i, f"VN{i}", Decimal(5), datetime(2024, 1, 1) + timedelta(minutes=20 * (i // each))) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, order_number string, amount decimal(12,2), seen_at timestamp_ntz")


def test_points_of_several_rows_are_paired_without_joins(spark):
    orders = sold(spark, 600, 3)
    payments = orders.select("id", F.lit("a").alias("lane"), "amount", "seen_at")
    found = R.match_by_amount(orders, payments, 5, "lane", ["order_number"], ["seen_at"])
    assert "Join" not in shown(found)
    assert sorted((r.payment_id, r.order_number) for r in found.collect()) == sorted((i, f"VN{i}") for i in range(600))


def test_sources_meet_without_a_shuffle_of_wide_sums(spark):
    orders = sold(spark, 60, 1).select("order_number", "amount", "seen_at")
    wide = R.reconcile({"hardware": orders, "sales": orders, "payme": orders})
    # One per source, of its own sums.
    assert shown(wide).count("Exchange hashpartitioning") == 3
    rows = wide.collect()
    assert len(rows) == 60 and all((r.sales_records, r.payme_amount, r.match_status) == (1, Decimal(5), "matched") for r in rows)


def test_conflicts_are_told_apart_in_generated_code(spark):
    orders = sold(spark, 3, 1).select("order_number", "amount", "seen_at")
    double = orders.unionByName(orders).filter("order_number <> 'VN2'")
    more = double.withColumn("order_number", F.concat(F.lit("X"), "order_number"))
    errors = Q.conflicts(R.reconcile({"hardware": orders, "sales": double, "payme": more}), "hardware", ["sales", "payme"])
    # A lambda would leave all rules to the interpreter.
    assert "lambda" not in shown(errors)
    got = sorted((r.order_number, r.error_type, r.severity, r.target_table) for r in errors.collect())
    assert got == sorted(
        [(f"VN{i}", k, "medium", "sales") for i in (0, 1) for k in ("amount_mismatch", "duplicate_record")]
        + [("VN2", "missing_record", "low", "sales")] + [(f"VN{i}", "missing_record", "low", "payme") for i in range(3)]
        + [(f"XVN{i}", *k, "payme") for i in (0, 1) for k in (("orphan_record", "high"), ("duplicate_record", "medium"))]
    )


def test_numbered_orders_are_those_of_the_join(spark):
    rows = [(1, 7), (2, 8), (2, 9), (None, 9), (3, None)]
    orders = spark.createDataFrame(
        [(i, c, "P", 60_000.0, datetime(2024, 1, 1), "2-HIGH") for i, c in rows],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    )
    folder = scratch_dir(spark, "tables")
    orders.write.parquet(f"{folder}/orders.parquet")
    orders.filter("o_custkey < 9").write.parquet(f"{folder}/unique/orders.parquet")
    for at in (folder, f"{folder}/unique"):
        t = Tables(spark, at)
        want = t.timed_orders.join(t.sales_orders.select("id", "order_number"), "id")
        got = numbered_sales(t).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


@pytest.mark.parametrize("span", [400, 3000])
def test_nearest_of_many_groups_are_those_of_the_heap(span):
    rng = random.Random(span)
    groups, expected, opened = [], set(), set()
    for g in range(40):
        points = sorted({(rng.randrange(0, span, 10), rng.randrange(2)) for _ in range(rng.randrange(60))})
        groups += [(g, s, k, rng.randrange(1, 4)) for s, k in points]
    low, high = 0, span - 60
    for g in range(40):
        own = [x for x in groups if x[0] == g]
        runs, stuck = R.nearest_in_turn([x[1:] for x in own], 45, low, high)
        expected |= {(g, own[p][1], own[o][1], n) for p, o, n in runs}
        opened |= {(g, own[i][1], own[i][2]) for i in stuck}
    group, second, kind, free = (np.array(x) for x in zip(*groups))
    all_of = np.ones(len(group), dtype=np.int64)
    (p, o, _, _, n), stuck = R._nearest(group, second, kind, free, 45, low * all_of, high * all_of)
    got = {(g, a, b, m) for g, a, b, m in zip(group[p].tolist(), second[p].tolist(), second[o].tolist(), n.tolist())}
    # What is nearest on both sides may be settled where the heap waits, and holds as well.
    assert expected <= got and {(groups[i][0], groups[i][1], groups[i][2]) for i in stuck} <= opened
