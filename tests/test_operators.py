"""Change capture, versions, matching, skew helpers and keyed state on small cases and by property."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyroll.operators import analytics as A, confidence as E, filters as P, history as H, paging as G, quality as Q, reconcile as R, relations as J, similarity as S, spread
from tallyroll.plans import run
from tallyroll.sinks import exports as X
from tallyroll.streaming import limits as M, runs, windows as W
from tallyroll.streaming.runs import tick, to_parquet, with_clock

SNAPSHOT = "order_number string, machine_code string, order_price decimal(12,2), payment_type string, match_status string"


def snapshot(spark, rows):
    return spark.createDataFrame([(n, m, Decimal(p), t, "new") for n, m, p, t in rows], SNAPSHOT)


OLD = [("A", "VM-1", "15000.00", None), ("B", "VM-2", "10.00", "Card"), ("D", "VM-4", "1.00", "Cash"), ("E", "VM-5", "2.00", "Cash")]
NEW = [("A", "VM-1", "15000.0", "Cash"), ("B", "VM-2", "12.00", "Card"), ("C", "VM-3", "7.00", "Cash"), ("D", "VM-4", "1.00", "Cash")]


def test_diff(spark):
    got = sorted(tuple(r) for r in H.diff(snapshot(spark, OLD), snapshot(spark, NEW)).collect())
    assert got == [("A", "payment_type", "", "Cash", "filled"), ("B", "order_price", "10.00", "12.00", "changed")]


def test_upsert_and_classes(spark):
    old, new = snapshot(spark, OLD), snapshot(spark, NEW)
    assert {r.order_number: r.action for r in H.upsert(old, new).collect()} == {
        "A": "updated", "B": "updated", "C": "inserted", "D": "unchanged", "E": "kept"
    }
    assert {r.order_number: r.record_type for r in H.classify(old, new).collect()} == {
        "A": "updated", "B": "updated", "C": "new", "D": "unchanged"
    }


row = st.tuples(
    st.sampled_from("ABCDEF"), st.sampled_from(["VM-1", "VM-2", None]), st.sampled_from(["1.00", "2.50"]),
    st.sampled_from(["Cash", "Card", None]),
)
rows = st.lists(row, max_size=6, unique_by=lambda r: r[0])


@settings(max_examples=5, deadline=None)
@given(rows, rows)
def test_upsert_is_idempotent_and_the_log_explains_it(spark, old, new):
    stored, incoming = snapshot(spark, old), snapshot(spark, new)
    once = H.upsert(stored, incoming).drop("action")
    twice = H.upsert(once, incoming)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.drop("action").collect()))
    assert {r.action for r in twice.collect()} <= {"unchanged", "kept"}
    state = {r.order_number: r.asDict() for r in stored.collect()}
    for change in H.diff(stored, incoming).collect():
        value = change.new_value or None
        state[change.order_number][change.field_name] = Decimal(value) if change.field_name == "order_price" else value
    after = {r.order_number: r.asDict() for r in once.collect()}
    assert all(after[k] == v for k, v in state.items())


def change_log(spark):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(1, 2, "order_price", "12", at, "changed"), (1, 2, "payment_type", "Card", at, "filled"), (1, 3, "order_price", "13", at, "changed"),
         (1, 1500, "machine_code", "VM-9", at, "changed")],
        "order_id bigint, version bigint, field_name string, new_value string, changed_at timestamp_ntz, change_type string",
    )


def test_versions(spark):
    got = {r.version: r.fields for r in H.versions(change_log(spark)).collect()}
    assert got[2] == {"order_price": "12", "payment_type": "Card"} and got[3] == {"order_price": "13"}
    state = {r.version: (r.order_price, r.payment_type, r.machine_code) for r in H.state_at_versions(change_log(spark)).collect()}
    assert state == {2: ("12", "Card", None), 3: ("13", "Card", None), 1500: ("13", "Card", "VM-9")}


def test_first_version_starts_from_the_order(spark):
    log = change_log(spark).withColumn("change_type", F.when(F.col("version") == 2, F.when(F.col("field_name") == "order_price", "new").otherwise("filled")).otherwise("changed"))
    orders = spark.createDataFrame([(1, "A", "VM-1", Decimal("7.00"))], "id bigint, order_number string, machine_code string, order_price decimal(12,2)")
    got = {r.version: r.fields for r in H.versions(log, orders).collect()}
    assert got[2] == {"order_number": "A", "machine_code": "VM-1", "order_price": "7.00", "payment_type": "Card"}
    assert got[3] == {"order_price": "13"}
    assert {r.version: r.fields for r in H.versions(log, orders.limit(0)).collect()}[2] == {"payment_type": "Card"}


def test_histories_have_one_form(spark):
    """Null versions stay, and changes of unknown orders go whatever their version is."""
    at = datetime(2024, 1, 1)
    more = spark.createDataFrame([(1, None, "f", "x", at, "new"), (9, 5, "f", "x", at, "new"), (9, 1500, "f", "x", at, "new"), (None, 1, "f", "x", at, "new")], change_log(spark).schema)
    log = change_log(spark).union(more).withColumn("old_value", F.lit(""))
    orders = spark.createDataFrame([(1, "A"), (2, "B")], "id bigint, order_number string")
    got = {(r.id, r.version): len(r.changes or []) for r in J.nest_changes(orders, log).collect()}
    assert got == {(1, 2): 2, (1, 3): 1, (1, 1500): 1, (1, None): 1, (2, None): 0}
    documents = X.change_documents(orders, log, F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert sorted((r.export_info.order_id, r.summary.total_changes) for r in documents) == [(1, 1), (1, 1), (1, 1), (1, 2), (2, 0)]


def test_long_histories_go_on_in_further_documents(spark):
    at = datetime(2024, 1, 1)
    rows = [(1, 1 if i % 2 else None, "f", str(i % 30), at + timedelta(minutes=i), "new") for i in range(250)]
    rows += [(2, 1, "f", "x", at, "new")] + [(None, 1, "f", "x", at, "new")] * 300
    log = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), change_log(spark).schema).withColumn("old_value", F.lit(""))
    orders = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id bigint, order_number string")
    got = J.nest_changes(orders, log, part_rows=50).collect()
    assert {(r.id, r.version, r.part): len(r.changes or []) for r in got} == {
        **{(1, v, p): n for v in (1, None) for p, n in enumerate([50, 50, 25])}, (2, 1, 0): 1, (3, None, None): 0
    }
    for version in (1, None):
        parts = sorted((r for r in got if (r.id, r.version) == (1, version)), key=lambda r: r.part)
        times = [c.changed_at for r in parts for c in r.changes]
        assert len(times) == 125 and times == sorted(times)
    documents = X.change_documents(orders, log, F.lit("2024-01-01").cast("timestamp_ntz"), part_rows=50).collect()
    assert sorted((r.export_info.order_id, r.summary.total_changes) for r in documents) == [(1, 25)] * 2 + [(1, 50)] * 4 + [(2, 1), (3, 0)]


def test_appends_repeat_without_doubling(spark, tmp_path):
    rows, as_of = spark.createDataFrame([("A",), ("B",)], "order_number string"), F.lit("2024-01-01").cast("timestamp_ntz")
    for batch in (0, 1, 1):
        X.append_rows(rows, str(tmp_path / "out"), as_of, batch)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_sessions_keep_every_row(spark):
    start = datetime(2024, 1, 1, 10)
    sessions = spark.createDataFrame([(1, 7, start), (2, None, start), (3, 7, None), (4, 7, start + timedelta(hours=2)), (5, 8, start)], "id bigint, created_by bigint, started_at timestamp_ntz")
    files = spark.createDataFrame([(10, 7, start, 5), (11, 7, start + timedelta(hours=3), 6), (12, None, start, 7), (13, 8, None, 9)], "id bigint, uploaded_by bigint, uploaded_at timestamp_ntz, size bigint")
    got = {r.id: (r.files, r.bytes) for r in J.session_file_totals(sessions, files, "size").collect()}
    assert got == {1: (2, 11), 2: (0, 0), 3: (0, 0), 4: (1, 6), 5: (0, 0)}
    assert [r.id for r in J.session_files(sessions, files).collect()] == [11, 10]


def test_validity_keeps_sessions_without_user(spark):
    start = datetime(2024, 1, 1)
    rows = [(1, 7, start), (2, 7, start + timedelta(hours=1)), (3, None, start), (4, None, start + timedelta(hours=5)), (5, 8, None)]
    sessions = spark.createDataFrame([(*r, datetime(2024, 2, 1)) for r in rows], "id bigint, user_id bigint, created_at timestamp_ntz, expires_at timestamp_ntz")
    got = {r.id: r.is_latest for r in J.session_validity(sessions).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True}


def test_carried_values_keep_rows_without_key_or_order(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("a", None, "n"), (None, 1, "y"), (None, 2, None)]
    df = spark.createDataFrame(rows, "k string, o bigint, v string")
    got = {(r.k, r.o): r.v for r in spread.carry_last(df, ["k"], "o", ["v"]).collect()}
    assert got == {("a", None): "n", ("a", 1): "x", ("a", 2): "x", (None, 1): "y", (None, 2): "y"}


def test_filters_of_changes(spark):
    df = spark.createDataFrame([(i, c, k) for i, (c, k) in enumerate([("new", "a"), ("new", "b"), ("changed", "a")])], "row_number bigint, change_type string, column_name string")
    assert P.filter_changes(df, {}).count() == 3
    assert P.filter_changes(df, {"change_type": "new", "row_range": {"max": 0}}).count() == 1
    assert P.filter_changes(df, {"columns": ["a"], "row_range": {"min": 1}}).count() == 1


def test_keys_from_a_list_and_a_frame(spark):
    df = spark.createDataFrame([(str(i),) for i in range(3000)] + [("",), (None,)], "k string")
    wanted = [str(i) for i in range(0, 5000, 2)] + ["", None]
    assert P.by_keys(df, "k", wanted).count() == P.by_keys(df, "k", spark.createDataFrame([(w,) for w in wanted], "w string")).count() == 1500
    assert P.by_keys(df, "k", ["7", "7"]).count() == 1


def test_unreadable_dates_do_not_filter(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 12),), (datetime(2024, 1, 2),)], "t timestamp_ntz")
    assert P.in_period(df, "t", "nonsense", None).count() == 2
    assert P.in_period(df, "t", "2024-01-01", "2024-01-01").count() == 0
    assert P.in_period(df, "t", None, "2024-01-02").count() == 2


def test_empty_summary(spark):
    empty = spark.createDataFrame([], "order_price decimal(12,2), machine_code string, created_by bigint")
    assert tuple(A.summary(empty).collect()[0]) == (0, Decimal("0.00"), 0.0)
    assert A.summary_distinct(empty).collect()[0].avg_order_value == 0.0


def test_hot_and_null_keys_join_like_any_other(spark):
    facts = [(i, 1 if i % 3 else (None if i % 2 else i)) for i in range(300)]
    fact = spark.createDataFrame(facts, "id bigint, k bigint")
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(200)], "k bigint, name string")
    got = sorted((r.id, r.name) for r in spread.join_dimension(fact, dim, "k").collect())
    assert got == sorted((i, None if k is None or k >= 200 else f"n{k}") for i, k in facts)
    inner = spread.join_dimension(fact, dim, "k", how="inner").count()
    assert inner == sum(k is not None and k < 200 for _, k in facts)


def test_row_numbers_across_buckets(spark):
    values = [(k, v) for k in ("a", None) for v in random.Random(1).sample(range(1000), 60)]
    df = spark.createDataFrame(values, "k string, v bigint")
    got = {(r.k, r.v): r.row_number for r in spread.row_numbers(df.repartition(5), ["k"], ["v"]).collect()}
    for k in ("a", None):
        assert [got[k, v] for v in sorted(v for x, v in values if x == k)] == list(range(1, 61))


def test_ranges_are_even_despite_an_outlier(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.when(F.col("id") == 0, 10**15).otherwise(F.col("id")).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows would fit one range
    try:
        parts = [r["count"] for r in spread.in_ranges(df.repartition(7), ["k"], ["v"]).groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(parts) < 2000


MATCHED = "id bigint, lane string, amount decimal(12,2), seen_at timestamp_ntz, note string"


def brute_matching(orders, payments, width=300):
    """Least pair first, over all pairs."""
    second = lambda t: int((t - datetime(1970, 1, 1)).total_seconds())
    pairs = sorted(
        (abs(second(p[3]) - second(o[3])), second(p[3]), second(o[3]), p[0], o[0], p, o)
        for p in payments for o in orders if p[2] is not None and p[2] == o[2] and abs(second(p[3]) - second(o[3])) <= width
    )
    paid, served, out = set(), set(), []
    for apart, *_, p, o in pairs:
        if (p[1], p[0]) not in paid and (p[1], o[0]) not in served:
            paid.add((p[1], p[0]))
            served.add((p[1], o[0]))
            out.append((p[1], p[0], o[0], apart, p[4], o[4]))
    return sorted(out)


def matched_rows(spark, orders, payments):
    orders = spark.createDataFrame(orders, MATCHED).withColumnRenamed("note", "order_note")
    payments = spark.createDataFrame(payments, MATCHED).withColumnRenamed("note", "payment_note")
    found = R.match_by_amount(orders, payments, 5, "lane", ["order_note"], ["payment_note"])
    return sorted((r["lane"], r["payment_id"], r["order_id"], r["seconds_apart"], r["payment_note"], r["order_note"]) for r in found.collect())


@pytest.mark.parametrize("case", ["spread", "crowded", "small blocks", "hot point"])
def test_matching_against_brute_force(spark, monkeypatch, case):
    rng = random.Random(case)
    base = datetime(2024, 1, 1)
    if case != "spread":
        monkeypatch.setattr(R, "CROWDED", 3)
    if case == "small blocks":
        monkeypatch.setattr(R, "BLOCK_WINDOWS", 1)
    step = {"spread": 1, "crowded": 60, "small blocks": 7, "hot point": 20}[case]

    def points(n, lanes, first):
        # a third of all rows share one price
        rows = [
            (first + i, rng.choice(lanes), Decimal(100 if rng.random() < 0.34 else rng.choice([200, 300])),
             base + timedelta(seconds=step * rng.randrange(7200 // step), milliseconds=rng.randrange(1000)), f"n{i}")
            for i in range(n)
        ]
        if case == "hot point":
            rows += [(first + n + i, rng.choice(lanes), Decimal(200), base, "hot") for i in range(40)]
        return rows + [(first + 5000, lanes[0], None, base, "none")]

    orders, payments = points(220, [None], 0), points(220, ["", "a", "b"], 10_000)
    assert matched_rows(spark, orders, payments) == brute_matching(orders, payments)


def test_losers_are_offered_the_next_order(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    orders = [(i, None, Decimal(5), at(10 * i), "") for i in range(3)]
    payments = [(i, "a", Decimal(5), at(0), "") for i in range(3)]
    assert [r[1:4] for r in matched_rows(spark, orders, payments)] == [(0, 0, 0), (1, 1, 10), (2, 2, 20)]
    assert matched_rows(spark, orders, []) == matched_rows(spark, [], payments) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 1), st.integers(1, 3)), max_size=40), st.integers(10, 60), st.integers(0, 300))
def test_what_a_block_decides_holds_in_the_whole(points, width, begin):
    """Runs from a cut of the points are runs of all points; what a cut leaves open says so."""
    merged = {}
    for s, k, n in points:
        merged[s, k] = merged.get((s, k), 0) + n
    whole = [(s, k, n) for (s, k), n in sorted(merged.items())]
    full, stuck = R.nearest_in_turn(whole, width, -(10**9), 10**9)
    assert not stuck
    named = lambda pts, runs: {(pts[p][0], pts[o][0], n) for p, o, n in runs}
    part = [x for x in whole if begin <= x[0] < begin + 150]
    runs, stuck = R.nearest_in_turn(part, width, begin, begin + 150)
    assert named(part, runs) <= named(whole, full)
    missed = {r for r in named(whole, full) - named(part, runs) if begin + 2 * width <= r[0] < begin + 150 - 2 * width}
    left = {part[i][0] for i in stuck}
    assert all(p in left for p, _, _ in missed)


def test_reconcile_levels(spark):
    schema = "order_number string, amount decimal(12,2), seen_at timestamp_ntz"
    at = datetime(2024, 1, 1)

    def source(pairs):
        return spark.createDataFrame([(n, Decimal(a), at) for n, a in pairs], schema)

    got = R.reconcile(
        {"hardware": source([("A", "1"), ("B", "2"), ("C", "3")]), "sales": source([("A", "1"), ("B", "9"), ("", "4")]), "payme": source([("A", "0.25"), ("A", "0.75"), ("X", "5")])}
    )
    rows = got.collect()
    assert {r.order_number: (r.match_status, r.match_score, r.is_temporary) for r in rows} == {
        "A": ("matched", 3, False), "B": ("partial", 1, False), "C": ("unmatched", 1, False), "X": ("unmatched", 1, True)
    }
    assert {r.order_number: r.payme_records for r in rows}["A"] == 2
    errors = Q.conflicts(got, "hardware", ["sales", "payme"]).collect()
    assert ("A", "duplicate_record", "payme") in {(r.order_number, r.error_type, r.target_table) for r in errors}


def test_confidence_equals_a_plain_fit_over_all_pairs(spark):
    """Row by row in numpy; the order of rows and their cut have no influence."""
    import numpy as np

    rng = random.Random(11)
    rows = []
    for _ in range(600):
        true = rng.random() < 0.7
        machine = rng.choice([None, int(rng.random() < (0.95 if true else 0.2))])
        rows.append((min(3, int(rng.expovariate(2 if true else 0.5))), machine, int(rng.random() < (0.9 if true else 0.4))))
    start = E.Fit(0.6, {"time": [0.4, 0.3, 0.2, 0.1], "machine": [0.2, 0.8], "kind": [0.2, 0.8]}, {"time": [0.25] * 4, "machine": [0.6, 0.4], "kind": [0.5, 0.5]})
    p, m, u = start.share, [np.array(v) for v in start.true.values()], [np.array(v) for v in start.accidental.values()]
    known = [np.array([r[k] is not None for r in rows]) for k in range(3)]
    level = [np.array([r[k] or 0 for r in rows]) for k in range(3)]

    def posterior():
        a, b = np.full(len(rows), p), np.full(len(rows), 1 - p)
        for k in range(3):
            a, b = a * np.where(known[k], m[k][level[k]], 1), b * np.where(known[k], u[k][level[k]], 1)
        return a / (a + b)

    for _ in range(12):
        g = posterior()
        p = g.mean()
        for k in range(3):
            m[k] = np.array([g[known[k] & (level[k] == i)].sum() for i in range(len(m[k]))]) / g[known[k]].sum()
            u[k] = np.array([(1 - g)[known[k] & (level[k] == i)].sum() for i in range(len(u[k]))]) / (1 - g)[known[k]].sum()
    want = sorted((r[0], -1 if r[1] is None else r[1], r[2], round(float(x), 2)) for r, x in zip(rows, posterior()))
    schema, seen = "time int, machine int, kind int", set()
    for parts in (1, 5):
        got = E.with_confidence(spark.createDataFrame(rows, schema).repartition(parts), start, 12).collect()
        assert sorted((r[0], -1 if r[1] is None else r[1], r[2], float(r[3])) for r in got) == want
        seen.add(tuple(sorted((r[0], -1 if r[1] is None else r[1], r[2], r[3]) for r in got)))
    assert len(seen) == 1
    assert E.with_confidence(spark.createDataFrame([], schema), start).count() == 0


# ---- updates of one key, several times -----------------------------------------------------------


def test_repeated_updates_leave_one_row_and_earlier_times(spark):
    early = datetime(2023, 1, 1)
    rows = spark.createDataFrame(
        [(1, "pending", "old", early, None), (2, "processing", None, early, early), (3, "pending", None, None, None), (None, "pending", None, None, None)],
        "id bigint, processing_status string, error_message string, processing_started_at timestamp_ntz, processing_finished_at timestamp_ntz",
    )
    updates = spark.createDataFrame(
        [(1, 2, "completed", None), (1, 1, "processing", "slow"), (2, 1, "completed", None), (3, 1, "failed", "a"), (3, 1, "failed", "b"), (None, 1, "failed", "x"), (9, 1, "failed", "x")],
        "id bigint, seq int, status string, error_message string",
    )
    now = datetime(2024, 2, 1)
    got = {r[0]: tuple(r)[1:] for r in H.apply_status(rows, updates, F.lit("2024-02-01").cast("timestamp"), ["seq"]).select(rows.columns).collect()}
    assert got == {
        1: ("completed", "slow", now, now),
        2: ("completed", None, early, now),
        3: ("failed", "b", None, now),
        None: ("pending", None, None, None),
    }


def test_repeated_partial_rows_fold_in_order(spark):
    stored = spark.createDataFrame([("A", "m", Decimal(1), "Cash", "old"), ("B", "m", None, None, None)], SNAPSHOT)
    incoming = spark.createDataFrame(
        [("A", 2, None, Decimal(3), None, "new"), ("A", 1, "x", Decimal(2), None, None), (None, 1, "y", None, None, None), ("C", 1, "y", None, None, None)],
        "order_number string, seq int, " + SNAPSHOT.split(", ", 1)[1],
    )
    got = sorted(tuple(r) for r in H.partial_update(stored, incoming, order=["seq"]).collect())
    assert got == [("A", "x", Decimal(3), "Cash", "new"), ("B", "m", None, None, None)]


@pytest.mark.parametrize("down", [True, False])
def test_deep_pages_against_a_sorted_list(spark, monkeypatch, down):
    """Ties, nulls and a hot value in the first column; pages from the first to beyond the end."""
    monkeypatch.setattr(G, "SAMPLE", 64)
    monkeypatch.setattr(G, "RANGES", 8)
    monkeypatch.setattr(G, "NEAR", 20)
    rng = random.Random(11)
    rows = [(i, rng.choice([None, at(0), at(0), at(0), at(rng.randrange(90))]), rng.choice([None, "x", "Y"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id bigint, t timestamp_ntz, s string").repartition(3)
    order = {"t": down, "s": not down, "id": False}

    def place(row):
        head = ((row[1] is None) == down, 0 if row[1] is None else (row[1] - at(0)).seconds * (-1 if down else 1))
        word = ["Y", "x"].index(row[2]) if row[2] else 0
        return head, ((row[2] is None) != down, word if down else -word), row[0]

    want = sorted(rows, key=place)
    for page in (1, 75, 150, 151):
        assert [tuple(r) for r in G.deep_page(df, page, 10, order).collect()] == want[10 * page - 10 : 10 * page]
    assert G.page_start(df, 1490, order)[1] <= 20  # rows that a task may hold before the page
    assert G.page_start(df, 5000, order) is None
    equal = spark.createDataFrame([(7,)] * 200, "id bigint")
    assert G.deep_page(equal, 15, 10, {"id": False}).count() == 10
    assert G.deep_page(df.limit(0), 9, 10, order).collect() == []


# ---- keyed state -------------------------------------------------------------------------------


def stream_of(spark, tmp_path, waves, schema):
    """One file per wave, read one per trigger, so state has to survive between batches."""
    folder = str(tmp_path / "in")
    for i, rows in enumerate(waves):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


@pytest.mark.parametrize("name", ["str_4_tumbling", "str_4_histogram", "str_9_cleanup", "str_7_anchored_limit", "str_11_interval_join"])
def test_files_out_of_order_in_several_batches(spark, tmp_path, monkeypatch, name):
    """The latest events arrive first, a file a batch; no row is late."""
    rows = [(i, at(60 * i + i % 7), i % 5, ["signup", "purchase", "click", "view"][i % 4], float(i % 50)) for i in range(1200)]
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    events.coalesce(1).write.parquet(f"{whole}/events.parquet")
    for low in (800, 400, 0):
        events.filter(F.col("event_id").between(low, low + 399)).coalesce(1).write.mode("append").parquet(f"{parts}/events.parquet")
    want = sorted(tuple(r) for r in run(name, spark, whole).collect())
    monkeypatch.setattr(runs, "BYTES_PER_TRIGGER", "1")
    assert sorted(tuple(r) for r in run(name, spark, parts).collect()) == want and len(want) > 10


def test_windows_keep_a_bounded_state_and_correct_late_rows(spark, tmp_path):
    """Batches mostly in order, some rows long after their window: the state holds the open windows only."""
    rng, folder = random.Random(5), str(tmp_path)
    kept = W.Windows("seen_at", "1 minute", ["key"], {"n": F.count(F.lit(1)), "total": F.sum("v")}, {"top": F.max("v")}, delay=120)
    everything, schema = [], "key string, seen_at timestamp_ntz, v decimal(10,2)"
    for b in range(13):
        rows = [(rng.choice(["a", "b", None]), at(300 * b + rng.randrange(300)), rng.choice([None, *map(Decimal, range(9))])) for _ in range(30)]
        rows += [("late", at(rng.randrange(300 * b + 1)), Decimal(1)) for _ in range(2)] if b % 4 == 3 else []
        rows += [("a", None, Decimal(5))] if b == 7 else []  # belongs to no window
        rows = [] if b == 9 else rows
        everything += rows
        batch = spark.createDataFrame(rows, schema)
        kept.take(batch, b, folder)
        if b in (0, 11):
            before = sorted(map(tuple, kept.results(spark, folder).collect()), key=repr)
            kept.take(batch, b, folder)  # repeated after a failure
            assert sorted(map(tuple, kept.results(spark, folder).collect()), key=repr) == before
        # Open are at most the windows of the delay and of one that it cuts, for every key.
        assert W.mark(spark, folder, b)["open_rows"] <= 4 * (120 // 60 + 2)
    want = kept.merged(kept.partial(spark.createDataFrame(everything, schema)).drop("_seen"))
    got = kept.results(spark, folder)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    late = kept.corrections(spark, folder).collect()
    assert {r.key for r in late} >= {"late"} and sum(r.n for r in late) == sum(r.n for r in late if r.batch > 0) > 3
    closed = kept.results(spark, folder, open_too=False)
    assert closed.count() + W.mark(spark, folder, 12)["open_rows"] >= want.count() > closed.count()


def test_windows_of_nothing(spark, tmp_path):
    kept = W.Windows("seen_at", "1 minute", ["key"], {"n": F.count(F.lit(1))})
    for b in range(2):
        kept.take(spark.createDataFrame([], "key string, seen_at timestamp_ntz"), b, str(tmp_path))
    assert kept.results(spark, str(tmp_path)).collect() == [] and kept.corrections(spark, str(tmp_path)).collect() == []


def at(second):
    return datetime(2024, 1, 1) + timedelta(seconds=second)


START = int((datetime(2024, 1, 1) - datetime(1970, 1, 1)).total_seconds())


def limited(spark, tmp_path, stream, count, limit):
    """Counts per second in one query, the limit in the next, a batch of files at a time."""
    folder = str(tmp_path / "count")
    counts = to_parquet(count(with_clock(stream, folder)), folder, lambda: tick(stream, "seen_at", folder))
    seconds = spark.readStream.schema(counts.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/out")
    return to_parquet(limit(seconds), str(tmp_path / "limit")).collect()


def test_anchored_limit(spark, tmp_path):
    waves = [[(1, at(0)), (1, at(10)), (1, at(20))], [(1, at(30)), (1, at(60)), (1, at(61))]]
    stream = stream_of(spark, tmp_path, waves, "client bigint, seen_at timestamp_ntz")
    got = {r.second - START: r.passed for r in limited(spark, tmp_path, stream, M.request_seconds, lambda s: M.anchored_limit(s, 3, 60))}
    assert got == {0: 1, 10: 1, 20: 1, 30: 0, 60: 0, 61: 1}


def test_late_and_unknown_clients(spark, tmp_path):
    """Shuffled arrivals give what ordered ones give, and requests without a client share one limit."""
    rows = [(c, at(s)) for c in (1, None) for s in (10, 20, 100, 101, 101, 101)]
    want = {(str(c or "unknown"), s): p for c in (1, None) for s, p in ((10, 1), (20, 1), (100, 1), (101, 1))}
    for i, order in enumerate((rows, rows[::-1], random.Random(3).sample(rows, len(rows)))):
        folder = tmp_path / str(i)
        folder.mkdir()
        stream = stream_of(spark, folder, [order[:5], order[5:8], order[8:]], "client bigint, seen_at timestamp_ntz")
        got = limited(spark, folder, stream, M.request_seconds, lambda s: M.anchored_limit(s, 2, 60))
        assert {(r.client, r.second - START): r.passed for r in got} == want
        assert sum(r.passed + r.refused for r in got) == len(rows)


def test_state_stores_follow_the_cores(spark, tmp_path):
    """Not the shuffle partitions, of which a small batch opens far too many; the setting is as before afterwards."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        stream = stream_of(spark, tmp_path, [[(1, at(0)), (2, at(1))]], "client bigint, seen_at timestamp_ntz")
        to_parquet(M.request_seconds(stream), str(tmp_path / "count"))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    stores = [f for f in (tmp_path / "count/checkpoint/state/0").iterdir() if f.name.isdigit()]
    assert 0 < len(stores) <= 4 * spark.sparkContext.defaultParallelism < 200


def test_clients_share_calls_but_no_limits(spark, tmp_path, monkeypatch):
    """One bucket for all: each client has its own window, also one that ends batches earlier than another's."""
    monkeypatch.setattr(M, "BUCKETS", 1)
    rows = [(c, at(s)) for c, seconds in ((1, (0, 5, 9, 70, 300)), (2, (8, 9, 10, 200)), (3, (299, 300, 301))) for s in seconds]
    rows.sort(key=lambda r: r[1])
    stream = stream_of(spark, tmp_path, [rows[:4], rows[4:8], rows[8:]], "client bigint, seen_at timestamp_ntz")
    got = limited(spark, tmp_path, stream, M.request_seconds, lambda s: M.anchored_limit(s, 2, 60))
    want = {1: (1, 1, 0, 1, 1), 2: (1, 1, 0, 1), 3: (1, 1, 0)}
    passed = {c: tuple(r.passed for r in sorted(got, key=lambda r: r.second) if r.client == str(c)) for c in want}
    assert passed == want


def test_copies_are_found_however_late(spark, tmp_path):
    from functools import partial

    from tallyroll.streaming.runs import for_each_batch

    waves = [[("h1", 1, at(10**7)), ("h1", 2, at(10**7))], [("h2", 3, at(0)), ("h1", 4, at(2 * 10**7))], [("h3", 5, at(1)), ("h2", 6, at(3 * 10**7))]]
    stream = stream_of(spark, tmp_path, waves, "content_hash string, id bigint, uploaded_at timestamp_ntz")
    folder = str(tmp_path / "run")
    for_each_batch(stream, folder, partial(M.keep_first_deliveries, folder=folder))
    assert sorted((r.content_hash, r.id) for r in M.first_deliveries(spark, folder).collect()) == [("h1", 1), ("h2", 3), ("h3", 5)]


def test_a_batch_opens_the_buckets_of_its_hashes(spark, tmp_path, monkeypatch):
    from tallyroll.streaming import deltas as D

    monkeypatch.setattr(D, "BUCKET_ROWS", 8)
    opened, touched = [], D.DeltaTable.touched

    def watched(self, pieces, keys):
        out = touched(self, pieces, keys)
        opened.append([(p.buckets, len(b) if b is not None else p.buckets) for p, b in zip(pieces, out)])
        return out

    monkeypatch.setattr(D.DeltaTable, "touched", watched)
    folder, want = str(tmp_path), {}
    batches = [[f"h{i}" for i in range(64)], ["h3", "new", "new"], [None, None], ["h60", None, "h3", "later"], ["new", "last"]]
    for b, hashes in enumerate(batches):
        rows = [(h, 100 * b + i, at(i)) for i, h in enumerate(hashes)]
        for h, i, _ in rows:
            want.setdefault(h, i)
        batch = spark.createDataFrame(rows, "content_hash string, id bigint, uploaded_at timestamp_ntz")
        for _ in range(2 if b == 3 else 1):  # a repeated batch
            M.keep_first_deliveries(batch, b, folder)
    assert [o[0] for o in opened if o and o[0][1] < o[0][0]][:1] == [(8, 2)]  # two hashes, two of eight buckets
    assert {r.content_hash: r.id for r in M.first_deliveries(spark, folder).collect()} == want


@pytest.mark.parametrize("clearing", [False, True])
def test_brute_force(spark, tmp_path, clearing):
    waves = [[(1, at(60 * i), clearing and i == 4) for i in range(5)], [(1, at(301), False), (1, at(302), True), (1, at(901), True)]]
    stream = stream_of(spark, tmp_path, waves, "client bigint, seen_at timestamp_ntz, success boolean")
    got = sorted(limited(spark, tmp_path, stream, M.login_seconds, lambda s: M.brute_force(s, 5, 900)), key=lambda r: r.second)
    blocked = [r.blocked for r in got]
    assert blocked == ([0] * 8 if clearing else [0, 0, 0, 0, 0, 1, 1, 0])
    assert got[-1].succeeded == 1


def test_ingest_survives_bad_files_and_rows(spark, tmp_path):
    """Two deliveries through one stream: bad files and rows are recorded, orders follow the last delivery."""
    from functools import partial

    from tallyroll.streaming import ingest as I
    from tallyroll.streaming.runs import for_each_batch

    source, folder = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    handle = partial(I.ingest_batch, folder=folder, as_of="2024-01-01", author=1)

    def deliver(name, data):
        (source / name).write_bytes(data)

    def run():
        for_each_batch(I.arriving_files(spark, str(source)), folder, handle)

    deliver("a.csv", b"order_number,price,date\nA,10\nA,11\nB,5,,surplus\n,7\nD,\"1,\nE,1,soon\nF,99999999999999999999\n")
    deliver("b.csv", b"  \n")
    deliver("x.exe", b"?")
    run()
    deliver("c.CSV", "номер_заказа,цена\nA,12\nC,1\n".encode("cp1251"))
    run()
    orders = {r.order_number[:5]: (float(r.order_price), r.batch) for r in I.current_orders(spark, folder).collect()}
    assert orders == {"A": (12.0, 1), "AUTO_": (7.0, 0), "C": (1.0, 1)}
    changes = [tuple(r)[:5] for r in I.read_kind(spark, folder, "changes").collect()]
    assert [c for c in changes if c[4] != "new"] == [("A", "order_price", "10.00", "12.00", "changed")]
    assert ("C", "order_price", "", "1.00", "new") in changes
    files = {r.file[-5:]: (r.status, r.total_rows, r.new_rows, r.updated_rows, r.rejected_rows) for r in I.read_kind(spark, folder, "files").collect()}
    assert files == {"a.csv": ("completed", 7, 2, 0, 4), "b.csv": ("failed", 0, 0, 0, 0), "x.exe": ("failed", 0, 0, 0, 0), "c.CSV": ("completed", 2, 1, 1, 0)}
    rejects = {r.order_number: r.failed_checks for r in I.read_kind(spark, folder, "rejects").collect()}
    assert rejects == {"B": ["field_count"], "D": ["closed_quotes"], "E": ["time_readable"], "F": ["price_fits"]}
    log = [(r.type, r.batch, r.files, r.failed_files) for r in I.run_log(spark, folder).orderBy("type", "batch").collect()]
    assert log == [("completed", 1, 4, 2), ("progress", 0, 3, 2), ("progress", 1, 4, 2)]
    steps = sorted((r.file[-5:], r.step, r.status) for r in I.read_kind(spark, folder, "steps").collect())
    assert steps[:3] == [("a.csv", 0, "pending"), ("a.csv", 1, "processing"), ("a.csv", 2, "completed")] and steps[-1] == ("x.exe", 2, "failed")


@pytest.mark.parametrize("per_trigger", [None, 1, 2])
def test_ingest_does_not_depend_on_batches(spark, tmp_path, per_trigger):
    """The same files in one, two or many triggers; the order of arrival decides, and the log rebuilds the orders."""
    import json
    import os
    import zipfile
    from functools import partial

    from tallyroll.streaming import ingest as I
    from tallyroll.streaming.runs import for_each_batch

    source, folder = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    made = ["z_first.csv", "a_second.tsv", "m.json", "k.ZIP", "b.txt"]
    (source / made[0]).write_text("order_number,price,payment_type\nA,10,Cash\nB,1,Card\n")
    (source / made[1]).write_text("order_number\tprice\nA\t12\nC\t3\n")
    (source / made[2]).write_text(json.dumps({"order_number": "A", "price": "14", "payment_type": "Cash"}))
    with zipfile.ZipFile(source / made[3], "w") as z:
        z.writestr("in/x.csv", "order_number,price\nB,2\nD,4\n")
        z.writestr("skip.exe", "?")
    (source / made[4]).write_text("some text\n\nmore\n")
    for i, name in enumerate(made):
        os.utime(source / name, (1_700_000_000 + 10 * i,) * 2)
    for_each_batch(I.arriving_files(spark, str(source), per_trigger), folder, partial(I.ingest_batch, folder=folder, as_of="2024-01-01", author=1))
    orders = {r.order_number: (float(r.order_price), r.payment_type) for r in I.current_orders(spark, folder).collect()}
    assert orders == {"A": (14.0, "Cash"), "B": (2.0, "unknown"), "C": (3.0, "unknown"), "D": (4.0, "unknown")}
    state = {}
    for r in I.read_kind(spark, folder, "changes").orderBy("arrived", "file").collect():
        state.setdefault(r.order_number, {})[r.field_name] = r.new_value
    assert {k: (float(v["order_price"]), v["payment_type"]) for k, v in state.items()} == orders
    assert sorted(r.new_value for r in I.read_kind(spark, folder, "changes").filter("order_number = 'A' and field_name = 'order_price'").collect()) == ["10.00", "12.00", "14.00"]
    files = {os.path.basename(r.file): (r.status, r.total_rows, r.new_rows, r.updated_rows) for r in I.read_kind(spark, folder, "files").collect()}
    assert files == {"z_first.csv": ("completed", 2, 2, 0), "a_second.tsv": ("completed", 2, 1, 1), "m.json": ("completed", 1, 0, 1), "k.ZIP": ("completed", 2, 1, 1), "b.txt": ("completed", 2, 0, 0)}


def test_ingest_picks_the_last_change_in_sequence(spark, tmp_path, monkeypatch):
    """The last state that changes something becomes the order, without a copy of the rows for it or of a first delivery."""
    import os
    from functools import partial

    from tallyroll.streaming import ingest as I
    from tallyroll.streaming.runs import for_each_batch

    source, folder, labels = tmp_path / "in", str(tmp_path / "state"), []
    source.mkdir()
    monkeypatch.setattr(I, "stored", lambda df, label, kept=I.stored: (labels.append(label), kept(df, label))[1])

    def run(files):
        for i, (name, prices) in enumerate(files):
            (source / name).write_text("order_number,price\n" + "".join(f"{k},{v}\n" for k, v in prices.items()))
            os.utime(source / name, (1_700_000_000 + 10 * (i + 100 * len(labels)),) * 2)
        for_each_batch(I.arriving_files(spark, str(source)), folder, partial(I.ingest_batch, folder=folder, as_of="2024-01-01", author=1))
        return {r.order_number: (float(r.order_price), os.path.basename(r.file), r.batch) for r in I.current_orders(spark, folder).collect()}

    # The last file of A repeats what the one before it said.
    assert run([("c.csv", {"A": 1, "B": 1}), ("b.csv", {"A": 2}), ("a.csv", {"A": 2, "C": 3})]) == {
        "A": (2.0, "b.csv", 0), "B": (1.0, "c.csv", 0), "C": (3.0, "a.csv", 0)
    }
    assert labels == ["arrived", "rows", "compared"]
    # B goes to and fro, C does not change.
    assert run([("f.csv", {"B": 5, "C": 3}), ("e.csv", {"B": 1}), ("d.csv", {"D": 4})]) == {
        "A": (2.0, "b.csv", 0), "B": (1.0, "e.csv", 1), "C": (3.0, "a.csv", 0), "D": (4.0, "d.csv", 1)
    }
    assert labels[3:] == ["arrived", "rows", "incoming", "compared"]


# ---- tables of deltas ----------------------------------------------------------------------------


def delta_table(spark, folder):
    from tallyroll.streaming.deltas import DeltaTable

    def fold(rows, whole):
        last = rows.groupBy("k").agg(F.max_by(F.struct("v", "gone"), "v").alias("r")).select("k", "r.*")
        return last.filter(~F.col("gone")) if whole else last

    return DeltaTable(spark, str(folder), "k bigint, v bigint, gone boolean", ["k"], fold)


def test_many_batches_cost_what_they_bring(spark, tmp_path, monkeypatch):
    """Pieces stay few, rows are rewritten a few times, and one key opens one file a piece."""
    import glob

    from tallyroll.streaming import deltas as D

    monkeypatch.setattr(D, "BUCKET_ROWS", 64)
    table, want, rewritten = delta_table(spark, tmp_path), {}, 0
    for b in range(24):
        rows = [(k, b, False) for k in range(b * 8, b * 8 + 8)] + [(k, b, b % 2 == 0) for k in range(max(0, b * 4 - 2), b * 4)]
        table.append(b, spark.createDataFrame(rows, "k bigint, v bigint, gone boolean").coalesce(1))
        rewritten += table.merge(b)
        for k, v, gone in rows:
            want.pop(k, None) if gone else want.update({k: v})
        assert len(table.pieces()) <= 3 * 4
    table.clean()
    pieces = table.pieces()
    assert rewritten <= 24 * 10 * 3
    assert max(p.buckets for p in pieces) >= 2
    key = spark.createDataFrame([(95,)], "k bigint")
    opened = [1 if x is None else len(x) for x in table.touched(pieces, key)]
    assert all(n == 1 for n in opened)
    for p in pieces:
        folders = glob.glob(f"{tmp_path}/pieces/{p.name}/_bucket=*")
        assert len(folders) <= p.buckets and all(len(glob.glob(f"{f}/*.parquet")) == 1 for f in folders)
    assert {r.k: r.v for r in table.current().collect()} == want
    assert [tuple(r)[:2] for r in table.current(keys=key).collect()] == ([(95, want[95])] if 95 in want else [])
    assert len(glob.glob(f"{tmp_path}/pieces/*")) <= len(pieces) + 2 * D.KEEP


def test_a_reader_keeps_its_state_and_a_broken_batch_leaves_none(spark, tmp_path, monkeypatch):
    table = delta_table(spark, tmp_path)
    assert table.current().count() == 0
    frame = lambda *rows: spark.createDataFrame(list(rows), "k bigint, v bigint, gone boolean")
    state = lambda before=None: {r.k: r.v for r in table.current(before).collect()}
    for b in range(3):
        table.append(b, frame((1, b, False), (10 + b, b, False)))
    reader = table.current()
    table.append(3, frame((1, 3, True)))
    table.merge(3)
    assert len(table.pieces()) == 1 and state() == {10: 0, 11: 1, 12: 2}
    assert {r.k: r.v for r in reader.collect()} == {1: 2, 10: 0, 11: 1, 12: 2}
    assert state(3) == {1: 2, 10: 0, 11: 1, 12: 2}

    def broken(*_):
        raise RuntimeError("lost before the manifest")

    with monkeypatch.context() as m:
        m.setattr(table, "_publish", broken)
        with pytest.raises(RuntimeError):
            table.append(4, frame((1, 9, False)))
    assert state() == {10: 0, 11: 1, 12: 2}
    table.append(4, frame((1, 4, False)))
    table.append(4, frame((1, 4, False)))
    assert state() == {1: 4, 10: 0, 11: 1, 12: 2}
    table.append(5, frame().limit(0))
    table.clean()
    assert state() == {1: 4, 10: 0, 11: 1, 12: 2}


def test_top_names_need_a_full_look_only_when_the_reserve_is_gone(spark, tmp_path):
    from tallyroll.streaming import views as V

    rng, top, totals = random.Random(4), V.TopNames("machine", n=3, reserve=3), {}
    schema = "machine_code string, payment_type string, order_price decimal(20,2), creation_time timestamp_ntz"
    for b in range(8):
        before = [(f"m{i}", None, Decimal(totals.get(f"m{i}", 0)), None) for i in rng.sample(range(20), 4)] if b else []
        before = [r for r in before if r[2]]
        after = [(f"m{i}", None, Decimal(rng.randrange(1, 900)), None) for i in (range(20) if b == 0 else rng.sample(range(20), 3))]
        for r in before:
            totals.pop(r[0])
        for r in after:
            totals[r[0]] = totals.get(r[0], 0) + int(r[2])
        V.apply(spark, str(tmp_path), b, spark.createDataFrame(before, schema), spark.createDataFrame(after, schema))
        got = [(name, int(revenue)) for name, revenue, _ in top.update(spark, str(tmp_path), b)]
        assert got == sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert top.full_looks < 8


def plain_similar(files, percent):
    """Every two files compared, in the order of their ids."""
    out = {}
    for i, mine in files.items():
        equal = min((j for j, other in files.items() if j < i and mine is not None and other == mine), default=None)
        near = [
            (j, 100.0 * len(mine & other) / len(mine | other))
            for j, other in sorted(files.items())
            if j < i and mine and other and 100 * len(mine & other) >= percent * len(mine | other)
        ]
        out[i] = (100.0, equal) if equal is not None else next(((s, j) for j, s in near), (0.0, None))
    return out


@pytest.mark.parametrize("percent, block", [(100, 2), (90, 2), (50, 32)])
def test_similar_files_against_all_pairs(spark, percent, block):
    rng = random.Random(percent)
    files = {0: set(), 1: None, 2: None, 3: set(), 4: {7}, 5: {7}}
    template = set(range(1000, 1040))
    for i in range(6, 160):
        kind = rng.randrange(4)
        if kind == 0:  # variants of one template, some of them equal
            files[i] = (template - set(rng.sample(sorted(template), rng.randrange(4)))) | {rng.randrange(2000, 2005) for _ in range(rng.randrange(3))}
        elif kind == 1:  # a variant of any earlier file
            base = sorted(files[rng.randrange(6, i)] if i > 6 else template)
            files[i] = set(base[rng.randrange(0, 2):]) | {rng.randrange(3000)}
        elif kind == 2:  # the border: 9 of 10, 8 of 10
            files[i] = set(range(5000, 5000 + rng.randrange(8, 12)))
        else:
            files[i] = {rng.randrange(60) for _ in range(rng.randrange(1, 25))}
    df = spark.createDataFrame([(i, None if r is None else list(r)) for i, r in files.items()], "id long, records array<long>")
    want = plain_similar(files, percent)
    got = {r.id: (r.similarity, r.duplicate_of_id) for r in S.similar_files(df, percent, block).collect()}
    assert {i: v[1] for i, v in got.items()} == {i: v[1] for i, v in want.items()}
    assert all(got[i][0] == pytest.approx(want[i][0]) for i in want)


def test_variants_of_one_template_meet_its_first_block(spark, monkeypatch):
    base = list(range(100))
    rows = [(i, base[:-1] + [1000 + i]) for i in range(600)] + [(i, base) for i in range(600, 1600)]
    sizes = {}
    store = S.stored

    def counted(df, label):
        out = store(df, label)
        sizes[label] = sizes.get(label, 0) + (out.count() if label in ("candidates", "sets") else 0)
        return out

    monkeypatch.setattr(S, "stored", counted)
    got = S.similar_files(spark.createDataFrame(rows, "id long, records array<long>"), 90).groupBy("duplicate_of_id").count().collect()
    assert {r[0]: r[1] for r in got} == {None: 1, 0: 600, 600: 999}
    assert sizes["sets"] == 601  # equal files are one
    assert sizes["candidates"] <= 601 * S.FIRST_BLOCK  # of 180,300 pairs


def test_lines_of_files(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n\n b"), (2, "b\ra\r b\na"), (3, " \n"), (4, ""), (5, None)], "id long, content string")
    got = S.similar_files(df.select("id", S.line_records(F.col("content")).alias("records")))
    assert {r.id: r.duplicate_of_id for r in got.collect()} == {1: None, 2: 1, 3: None, 4: 3, 5: None}
    empty = S.similar_files(df.limit(0).select("id", S.line_records(F.col("content")).alias("records")))
    assert empty.collect() == []
