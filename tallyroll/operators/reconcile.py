"""Matching orders with reports and payments, with and without an order number."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyroll.operators.filters import present
from tallyroll.operators.spread import carry_last, join_dimension, row_numbers
from tallyroll.session import stored

TOLERANCE = 0.01
# A block of time is so many matching windows long; a point of up to so many rows goes into its blocks row by row.
BLOCK_WINDOWS, CROWDED = 48, 100
# Nearest neighbours are taken at once as long as a pass settles one in so many points.
WORTHWHILE = 32


def reconcile(sources: Mapping[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """One row per order number over all sources, each a frame (order_number, amount, seen_at).

    Each source is added up by itself, in one shuffle of narrow sums, and all of them are cut alike, so that they
    meet without another. Several rows of one source add up, and their
    number stays as ``<name>_records``. The score is the number of sources whose amount agrees with the first
    source that has one; matched means that all sources that know the order agree and more than one does.
    An order that the first source does not know is temporary. Rows without an order number are left to
    ``match_by_amount``, whose matches can come back as a source of their own.
    """
    rows = None
    for name, df in sources.items():
        part = df.filter(present(F.col("order_number"))).groupBy("order_number").agg(
            F.sum(F.col("amount").cast("decimal(20,2)")).cast("decimal(20,2)").alias("amount"),
            F.count(F.lit(1)).alias("records"),
            F.min("seen_at").alias("first_seen"),
            F.max("seen_at").alias("last_seen"),
        )
        part = part.withColumn("source", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("source") == name, F.col(column)))

    wide = rows.groupBy("order_number").agg(
        *[of(n, "amount").alias(f"{n}_amount") for n in sources],
        *[F.coalesce(of(n, "records"), F.lit(0)).alias(f"{n}_records") for n in sources],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("_last"),
    )
    reference = F.coalesce(*[F.col(f"{n}_amount") for n in sources])
    found = F.array_compact(F.array(*[F.when(F.col(f"{n}_records") > 0, F.lit(n)) for n in sources]))
    agreeing = sum(
        F.when(F.abs(F.col(f"{n}_amount") - reference) <= F.lit(tolerance).cast("decimal(20,2)"), 1).otherwise(0)
        for n in sources
    )
    status = (
        F.when(F.size("source_files") < 2, "unmatched")
        .when(F.col("match_score") == F.size("source_files"), "matched")
        .otherwise("partial")
    )
    main = next(iter(sources))
    return (
        wide.withColumn("source_files", found)
        .withColumn("match_score", agreeing.cast("int"))
        .withColumn("match_status", status)
        .withColumn("is_temporary", F.col(f"{main}_records") == 0)
        .withColumn("last_matched_at", F.when(F.size("source_files") > 1, F.col("_last")))
        .drop("_last")
    )


def matched_source(orders: DataFrame, payments: DataFrame, lanes: Sequence[str], minutes: int = 5) -> dict[str, DataFrame]:
    """Payments without an order number as sources (order_number, amount, seen_at), by stable matching.

    ``orders`` are (id, order_number, amount, seen_at), ``payments`` (id, lane, amount, seen_at). Each lane matches
    by itself, all in one pass over the orders.
    """
    found = match_by_amount(orders, payments, minutes, "lane", ["order_number"], ["seen_at"])
    found = stored(found.select("lane", "order_number", "amount", "seen_at"), "matches")
    return {x: found.filter(F.col("lane") == x).drop("lane") for x in lanes}


def match_by_amount(
    orders: DataFrame,
    payments: DataFrame,
    minutes: int = 5,
    lane: str | None = None,
    order_columns: Sequence[str] = (),
    payment_columns: Sequence[str] = (),
) -> DataFrame:
    """One-to-one matching of payments to orders of equal amount within +-``minutes``.

    Gives (payment_id, order_id, seconds_apart, amount), the column ``lane`` of the payments if it is named, and
    the named columns of both sides. Of all pairs that are still free the one with the least time apart is taken
    first; then the earlier payment, the earlier order, the lower payment id and the lower order id decide. So no
    payment and order that both would rather have each other stay apart (the matching is stable), and who loses
    the nearest partner gets the next one. Payments of different lanes do not compete: an order can serve each.

    Nothing pairs all candidates. Rows are cut into blocks of time, which also hold the rows of two more windows
    on either side; the rows of an (amount, second) are one point. A point of more than ``CROWDED`` rows goes in
    as their number, so a group is bounded by the seconds of a block, whatever the price. A block takes the nearest
    neighbours, as far as it sees that no point outside can matter; the few points that it cannot decide go to the
    next round, with other borders. The least free pair is always seen whole, so the rounds end. Blocks pair the
    rows of a point by their ranks; those of crowded points meet afterwards, in ranges that Spark cuts, so one
    crowded second is no group of its own.

    Times count in whole seconds. Rows without amount or time match nothing; null ids come first.
    """
    width = minutes * 60
    sides = [_side(payments, 0, lane, payment_columns), _side(orders, 1, None, order_columns)]
    both, crowded = _points(sides)
    pairs, turn = None, 0
    while True:
        decided = stored(_blocks(both, width, turn), "matching")
        # Only what lies near a border is seen by two blocks.
        edge = decided.filter("not open and shared").dropDuplicates(["lane", "amount", "second0", "second1", "place0"])
        new = decided.filter("not open and not shared").unionByName(edge)
        pairs = new if pairs is None else pairs.unionByName(new)
        left = decided.filter("open")
        if not left.take(1):
            break
        used = edge.select("lane", "amount", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"second{k}").alias("second"), "n") for k in (0, 1)])))
        used = used.groupBy("lane", "amount", "kind", "second").agg(F.sum("n").alias("used"))
        kind = F.col("second0").isNull().cast("int").alias("kind")
        left = left.select("lane", "amount", kind, F.coalesce("second0", "second1").alias("second"), "n", "whole", "first0", "first1", "shared", "place0", "place1")
        done = F.when(F.col("shared"), F.col("place1") + F.coalesce("used", F.lit(0))).otherwise(F.col("place0"))
        both = left.join(used, ["lane", "amount", "kind", "second"], "left").withColumn("done", done).select(both.columns)
        both = stored(both, "open")
        turn += 1
    return _resolved(pairs, crowded, sides, lane, payment_columns, order_columns)


def _side(df: DataFrame, kind: int, lane: str | None, columns: Sequence[str]) -> DataFrame:
    """(lane, amount, second, id, more) of the rows that can match; orders have no lane, as they serve each."""
    own = F.coalesce(F.col(lane).cast("string"), F.lit("")) if lane else F.lit(None if kind else "").cast("string")
    second = F.unix_seconds(F.col("seen_at").cast("timestamp"))
    more = F.struct(*columns) if columns else F.struct(F.lit(None).cast("int").alias("none"))
    rows = df.filter(F.col("amount").isNotNull() & F.col("seen_at").isNotNull())
    return rows.select(own.alias("lane"), "amount", second.alias("second"), "id", more.alias("more"))


def _points(sides: Sequence[DataFrame]) -> tuple[DataFrame, bool]:
    """The rows of both sides as (lane, amount, kind, second, n, done, whole, first0, first1), and whether any point is crowded.

    A row is one of its point's; a crowded point comes as one row that is not ``whole``, with their number.
    """
    kinds = [rows.select(F.struct("id", "more").alias("first")).schema["first"].dataType for rows in sides]
    key = ["lane", "amount", "kind", "second"]
    both = keys = None
    for i, rows in enumerate(sides):
        firsts = [(F.struct("id", "more") if i == k else F.lit(None)).cast(kinds[k]).alias(f"first{k}") for k in (0, 1)]
        one = rows.select("lane", "amount", F.lit(i).alias("kind"), "second", F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("done"), F.lit(True).alias("whole"), *firsts)
        both = one if both is None else both.unionByName(one)
        keys = one.select(key) if keys is None else keys.unionByName(one.select(key))
    hot = stored(keys.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED), "crowded")
    if not hot.take(1):
        return both, False
    named = hot.withColumnsRenamed({c: f"_{c}" for c in key})
    same = F.col("lane").eqNullSafe(F.col("_lane"))
    for c in key[1:]:
        same = same & (F.col(c) == F.col(f"_{c}"))
    rest = both.join(named.drop("n"), same, "left_anti")
    none = [F.lit(None).cast(kinds[k]).alias(f"first{k}") for k in (0, 1)]
    return rest.unionByName(hot.select(*key, "n", F.lit(0).cast("bigint").alias("done"), F.lit(False).alias("whole"), *none)), True


def _blocks(rows: DataFrame, width: int, turn: int) -> DataFrame:
    """What the blocks of one round decide: pairs of rows, runs of pairs of crowded points, and the rows of points that stay open.

    A pair has its rows' ranks as ``place0`` and ``place1``, a run those it begins with. An open row has how many of
    its point's rows are taken as far as the block knows, and how many were before. Only ``shared`` rows can come twice.
    """
    size, reach = BLOCK_WINDOWS * width, 2 * width
    shift = size // 2 if turn % 2 else 0
    at = F.col("second") + shift
    near = F.sequence(F.floor((at - reach) / size), F.floor((at + reach) / size))
    cut = rows.select("*", F.explode(near).alias("block")).repartition("amount", "block")
    cut = cut.sortWithinPartitions("block", "amount", "second", "kind", "lane", "first0", "first1")
    cut = cut.select("lane", "amount", "block", "kind", "second", "n", "done", "whole", "first0", "first1")
    long, flag = T.LongType(), T.BooleanType()
    schema = T.StructType([T.StructField("lane", T.StringType()), T.StructField("amount", cut.schema["amount"].dataType)])
    for name in ("second0", "second1", "place0", "place1", "n"):
        schema = schema.add(name, long)
    for name in ("first0", "first1"):
        schema = schema.add(name, cut.schema[name].dataType)
    for name in ("whole", "shared", "open"):
        schema = schema.add(name, flag)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last group may go on in the next batch.
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if kept and _same_group(kept[-1], batch):
                kept.append(batch)
                continue
            table = pa.Table.from_batches([*kept, batch])
            edges = _edges(table)
            yield from _decided(table, edges[:-1], width, size, shift)
            kept = table.slice(edges[-2]).combine_chunks().to_batches()
        if kept:
            table = pa.Table.from_batches(kept)
            yield from _decided(table, _edges(table), width, size, shift)

    return cut.mapInArrow(decide, schema)


def _same_group(before: pa.RecordBatch, batch: pa.RecordBatch) -> bool:
    """True if a batch only goes on with the group that the one before ends with."""
    return all(before.column(c)[-1] == batch.column(c)[0] == batch.column(c)[-1] for c in ("amount", "block"))


def _edges(table: pa.Table) -> list[int]:
    """Where the groups (amount, block) begin, and the end."""
    n = table.num_rows
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in ("amount", "block"):
        values = table.column(c).combine_chunks()
        change[1:] |= pc.not_equal(values.slice(1), values.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return [*np.flatnonzero(change).tolist(), n]


def _decided(table: pa.Table, edges: Sequence[int], width: int, size: int, shift: int) -> Iterator[pa.RecordBatch]:
    """Output rows of the whole groups between the edges."""
    if len(edges) < 2:
        return
    table = table.slice(0, edges[-1]).combine_chunks()
    kinds, seconds, rows, done, blocks = (table.column(c).to_numpy() for c in ("kind", "second", "n", "done", "block"))
    names = table.column("lane").combine_chunks().dictionary_encode()
    lanes = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))

    # Rows that lie side by side are one point.
    marks = np.stack([group, seconds, kinds, lanes])
    starts = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)])
    counts = np.add.reduceat(rows, starts)
    kind, second, lane, group = kinds[starts], seconds[starts], lanes[starts], group[starts]
    low = blocks[starts] * size - shift

    # Each lane with the orders, which serve all of them unless they name one.
    k = max(len(names.dictionary), 1)
    payment = kind == 0
    asked = np.zeros((group[-1] + 1) * k, dtype=bool)
    asked[group[payment] * k + lane[payment]] = True
    at, own = [np.flatnonzero(payment)], [lane[payment]]
    for x in range(k):
        serve = np.flatnonzero(~payment & ((lane == x) | (lane < 0)) & asked[group * k + x])
        at.append(serve)
        own.append(np.full(len(serve), x))
    at, own = np.concatenate(at), np.concatenate(own)
    order = np.lexsort((kind[at], second[at], group[at] * k + own))
    at, own = at[order], own[order]
    total, before = counts[at], done[starts][at]
    free = total - before
    bounds = low[at]
    taken, stuck = _nearest(group[at] * k + own, second[at], kind[at], free, width, bounds - 2 * width, bounds + size + 2 * width)
    inner = (second[at] >= bounds + 2 * width) & (second[at] < bounds + size - 2 * width)

    p, o, from0, from1, n = taken
    from0, from1 = from0 + before[p], from1 + before[o]
    first, whole = starts[at], table.column("whole").combine_chunks().to_numpy(zero_copy_only=False)[starts[at]]
    both = whole[p] & whole[o]
    times = np.where(both, n, 1)
    run = np.repeat(np.arange(len(p)), times)
    step = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
    p, o, both, from0, from1, n = p[run], o[run], both[run], from0[run] + step, from1[run] + step, np.where(both, 1, n)[run]
    yield from _output(
        table, names, own[p], first[p], second[at][p], second[at][o], from0, from1, n, both,
        [pa.array(first[p] + from0, pa.int64(), mask=~both), pa.array(first[o] + from1, pa.int64(), mask=~both)],
        ~(inner[p] & inner[o]), False,
    )
    stuck = stuck[(second[at][stuck] >= bounds[stuck]) & (second[at][stuck] < bounds[stuck] + size)]
    length = np.diff(np.r_[starts, table.num_rows])[at]
    here = np.repeat(stuck, length[stuck])
    row = first[here] + np.arange(len(here)) - np.repeat(np.cumsum(length[stuck]) - length[stuck], length[stuck])
    side = [kind[at][here] == x for x in (0, 1)]
    yield from _output(
        table, names, own[here], row, *[pa.array(second[at][here], pa.int64(), mask=~x) for x in side],
        total[here] - free[here], before[here], rows[row], whole[here],
        [pa.array(row, pa.int64(), mask=~x) for x in side], ~inner[here], True,
    )


def _output(table, names, lane, row, second0, second1, place0, place1, n, whole, firsts, shared, is_open) -> Iterator[pa.RecordBatch]:
    if not len(row):
        return
    columns = {
        "lane": names.dictionary.take(pa.array(lane)), "amount": table.column("amount").take(pa.array(row)),
        "second0": second0, "second1": second1, "place0": place0, "place1": place1, "n": n,
        **{f"first{k}": table.column(f"first{k}").take(x) for k, x in enumerate(firsts)},
        "whole": whole, "shared": shared, "open": np.full(len(row), is_open),
    }
    yield from pa.table(columns).combine_chunks().to_batches()


def _nearest(group, second, kind, free, width, low, high) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """``nearest_in_turn`` for the points of many groups, sorted by (group, second, kind); ``free`` is reduced.

    Gives runs as (payment point, order point, rows taken before of either, rows), and the points that stay open.
    Points that are each other's nearest are taken, of all groups at once; what is left goes through the heaps.
    """
    runs: list[tuple[np.ndarray, ...]] = []

    def take(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> None:
        swap = kind[i] == 1
        p, o = np.where(swap, j, i), np.where(swap, i, j)
        runs.append((p, o, begin[p] - free[p], begin[o] - free[o], n))
        free[p] -= n
        free[o] -= n

    begin = free.copy()
    live, far = np.arange(len(second)), width + 1
    while True:
        live = live[free[live] > 0]
        n, index = len(live), np.arange(len(live))
        g, s, k = group[live], second[live], kind[live]
        last = [np.maximum.accumulate(np.where(k == x, index, -1)) for x in (0, 1)]
        following = [np.minimum.accumulate(np.where(k == x, index, n)[::-1])[::-1] for x in (0, 1)]
        left, right = np.where(k == 0, last[1], last[0]), np.where(k == 0, following[1], following[0])
        a, b = np.maximum(left, 0), np.minimum(right, n - 1)
        to_left = np.where((left >= 0) & (g[a] == g), s - s[a], far)
        to_right = np.where((right < n) & (g[b] == g), s[b] - s, far)
        # Of two equally near the earlier one is better.
        best, apart = np.where(to_left <= to_right, a, b), np.minimum(to_left, to_right)
        i = np.flatnonzero((apart <= width) & (best > index))
        i = i[best[best[i]] == i]
        j = best[i]
        seen = (s[i] - apart[i] >= low[live[i]]) & (s[j] + apart[i] < high[live[i]])
        i, j = live[i[seen]], live[j[seen]]
        # A point without a free partner in reach never gets one.
        live = live[apart <= width]
        take(i, j, np.minimum(free[i], free[j]))
        if len(i) * WORTHWHILE < n or not n:
            break
    live = live[free[live] > 0]
    stuck: list[int] = []
    for here in np.split(live, np.flatnonzero(np.diff(group[live])) + 1) if len(live) else []:
        found, open_points = nearest_in_turn(list(zip(second[here].tolist(), kind[here].tolist(), free[here].tolist())), width, int(low[here[0]]), int(high[here[0]]))
        for p, o, n in found:
            take(here[[p]], here[[o]], np.array([n]))
        stuck += here[open_points].tolist()
    taken = tuple(np.concatenate(x) for x in zip(*runs))
    return taken, np.array(stuck, dtype=np.int64)


def nearest_in_turn(points: Sequence[tuple[int, int, int]], width: int, low: int, high: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Match points (second, kind, rows), sorted, that are all there is from ``low`` up to ``high``.

    Gives runs (payment point, order point, rows) in the order they were taken, and the points that have a
    partner in reach but depend on what lies outside. The nearest pair of free points always lies side by side, so
    a heap over neighbours in a linked list finds it.
    """
    n = len(points)
    free = [p[2] for p in points]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple] = []

    def key(i: int, j: int) -> tuple:
        p, o = (i, j) if points[i][1] == 0 else (j, i)
        return (abs(points[i][0] - points[j][0]), points[p][0], points[o][0])

    def push(i: int, j: int) -> None:
        if 0 <= i and j < n and points[i][1] != points[j][1] and points[j][0] - points[i][0] <= width:
            heapq.heappush(heap, (*key(i, j), i, j))

    def rival(i: int, step: Sequence[int], best: tuple) -> bool:
        """True if the other side of a point holds an undecided partner that it likes better."""
        k = step[i]
        while 0 <= k < n and abs(points[k][0] - points[i][0]) <= best[0]:
            if points[k][1] != points[i][1]:
                return key(i, k) < best
            k = step[k]
        return False

    for i in range(n - 1):
        push(i, i + 1)
    runs: list[tuple[int, int, int]] = []
    stuck = False
    while heap:
        *best, i, j = heapq.heappop(heap)
        if not free[i] or not free[j] or after[i] != j:
            continue
        apart = best[0]
        if points[i][0] - apart < low or points[j][0] + apart >= high:
            stuck = True
            continue
        if stuck and (rival(i, before, tuple(best)) or rival(j, after, tuple(best))):
            continue
        took = min(free[i], free[j])
        runs.append((i, j, took) if points[i][1] == 0 else (j, i, took))
        free[i] -= took
        free[j] -= took
        left, right = (before[i], i), (j, after[j])
        for k in (i, j):
            if not free[k]:
                a, b = before[k], after[k]
                if a >= 0:
                    after[a] = b
                if b < n:
                    before[b] = a
        for a in {left[0], i, j, right[0]}:
            if a >= 0 and free[a]:
                push(a, after[a])
    return runs, _in_reach(points, free, width) if stuck else []


def _in_reach(points: Sequence[tuple[int, int, int]], free: Sequence[int], width: int) -> list[int]:
    """Free points that have a free point of the other kind within ``width``."""
    out = set()
    for order in (range(len(points)), range(len(points) - 1, -1, -1)):
        last: list[int | None] = [None, None]
        for i in order:
            if free[i]:
                second, kind, _ = points[i]
                other = last[1 - kind]
                if other is not None and abs(points[other][0] - second) <= width:
                    out.add(i)
                last[kind] = i
    return sorted(out)


def _resolved(pairs: DataFrame, crowded: bool, sides: Sequence[DataFrame], lane: str | None, payment_columns: Sequence[str], order_columns: Sequence[str]) -> DataFrame:
    """The pairs, with those of crowded points, whose runs meet the rows by their ranks."""
    columns = ["lane", "amount", "second0", "second1", "first0", "first1"]
    found = pairs.filter("whole").select(columns)
    if crowded:
        runs = pairs.filter("not whole").select("lane", "amount", "second0", "second1", F.col("place0").alias("from0"), F.col("place1").alias("from1"), "n")
        runs = stored(runs, "runs")
        p, o = (_ranked(runs, rows, k) for k, rows in enumerate(sides))
        found = found.unionByName(p.join(o, ["lane", "amount", "second0", "second1", "offset"]).select(columns))
    return found.select(
        F.col("first0.id").alias("payment_id"),
        F.col("first1.id").alias("order_id"),
        F.abs(F.col("second0") - F.col("second1")).alias("seconds_apart"),
        "amount",
        *([F.col("lane").alias(lane)] if lane else []),
        *[F.col(f"first0.more.`{c}`").alias(c) for c in payment_columns],
        *[F.col(f"first1.more.`{c}`").alias(c) for c in order_columns],
    )


def _starts(runs: DataFrame, k: int) -> DataFrame:
    """Per run of one side: its point, the point's rank where the run begins, and its number of rows."""
    point = F.struct(*(["lane"] if k == 0 else []), "amount", F.col(f"second{k}").alias("second")).alias("point")
    return runs.select(point, F.col(f"from{k}").alias("at"), F.struct("lane", "amount", "second0", "second1").alias("run"), "n")


def _held(rows: DataFrame, k: int) -> DataFrame:
    point = F.struct(*(["lane"] if k == 0 else []), "amount", "second").alias("point")
    return rows.select(point, F.struct("id", "more").alias("first"))


def _ranked(runs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The rows of the runs' points with their run and offset; a point's rows spread over ranges of their ranks."""
    starts = _starts(runs, k)
    lanes = starts.groupBy("point").agg(F.collect_set("run.lane").alias("lanes"))
    own = row_numbers(join_dimension(_held(rows, k), lanes, "point", how="inner"), ["point"], ["first"], "rank")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in starts.dtypes if c in ("at", "run", "n")]
    own = own.select("point", F.explode("lanes").alias("lane"), ((F.col("rank") - 1) * 2 + 1).alias("place"), "first", *none)
    marks = starts.select(
        "point", F.col("run.lane").alias("lane"), (F.col("at") * 2).alias("place"), F.lit(None).cast(dict(own.dtypes)["first"]).alias("first"), "at", "run", "n"
    )
    # Every row takes the last run that begins at or before its rank.
    lined = carry_last(marks.unionByName(own), ["point", "lane"], "place", ["run", "at", "n"]).filter("first is not null")
    offset = (F.col("place") - 1) / 2 - F.col("at")
    lined = lined.withColumn("offset", offset.cast("bigint")).filter("offset < n")
    return lined.select("run.*", "offset", F.col("first").alias(f"first{k}"))
