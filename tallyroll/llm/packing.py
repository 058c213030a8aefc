"""Best-fit packing of token sequences, improved by a swap-based local search.

Only the lengths decide which pieces share a sequence. So the driver sees the histogram of lengths
(at most ``size`` rows, whatever the corpus), packs it best-fit decreasing into groups of equally
filled sequences, and improves these by moves, one-for-one and two-for-one exchanges between underfull
groups that raise the sum of squared fills, until no sequence can be saved or no exchange helps.
The plan, a few rows per length, goes back to the executors, where every piece finds its place by its
rank among the pieces of its length. Ranks are counted in hashed buckets, so a length that a third
of all pieces have does not meet in one task.

Null text counts as empty and gives one piece, the closing id alone. Texts of any length are cut as a
whole. Rows that repeat are packed each for itself, ties in any order. Columns called ``sequence_id`` or
``offset`` in the input give way to the result's. Empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from heapq import heapify, heappop, heappush
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tallyroll.llm.bpe import codec
from tallyroll.llm.common import slices, stored, together

Group = tuple[tuple[int, ...], int]  # the lengths in a sequence, how many such sequences


def token_pieces(
    df: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids) per piece; ``ids`` is binary, little-endian unsigned 32-bit.

    A document is its text's ids and ``end_id``. One longer than ``size`` is cut into pieces of
    ``size`` ids, the first of which takes the remainder.
    """
    kept = df.select(df[id_column].alias("id"), df[text].cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField(id_column, kept.schema["id"].dataType),
            T.StructField("piece", T.IntegerType(), False),
            T.StructField("start", T.LongType(), False),
            T.StructField("length", T.LongType(), False),
            T.StructField("ids", T.BinaryType(), False),
        ]
    )
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, closing = codec(tokenizer, library=True), end_id.to_bytes(4, "little")
        for part in slices(batches, 1):
            row, out = [], ([], [], [], [])
            for i, raw in enumerate(coder.encode(part.column(1).to_pylist())):
                raw += closing
                n = len(raw) // 4
                cuts = [0, *range(n % size or size, n, size), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    for column, value in zip(out, (k, a, b - a, raw[4 * a : 4 * b])):
                        column.append(value)
            ids = part.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out, kinds)], names=schema.names)

    return kept.mapInArrow(work, schema)


def best_fit(histogram: Mapping[int, int], size: int) -> list[Group]:
    """Best-fit decreasing, a whole length at a time; equal sequences stay one group."""
    open_groups: dict[int, list[Group]] = {}
    for length in sorted(histogram, reverse=True):
        left, changed = histogram[length], []

        def fill(items: tuple[int, ...], number: int, room: int) -> int:
            """Put up to ``left`` pieces into ``number`` sequences; return the sequences used."""
            nonlocal left
            each = room // length
            whole = min(number, left // each)
            rest = left - whole * each if whole < number else 0
            if whole:
                changed.append((items + (length,) * each, whole))
            if rest:
                changed.append((items + (length,) * rest, 1))
            left -= whole * each + rest
            return whole + bool(rest)

        for room in sorted(r for r in open_groups if r >= length):
            groups, kept = open_groups.pop(room), []
            for items, number in groups:
                used = fill(items, number, room) if left else 0
                if used < number:
                    kept.append((items, number - used))
            if kept:
                open_groups[room] = kept
            if not left:
                break
        if left:
            fill((), left, size)
        for items, number in changed:
            open_groups.setdefault(size - sum(items), []).append((items, number))
    return [g for groups in open_groups.values() for g in groups]


def least_sequences(histogram: Mapping[int, int], size: int) -> int:
    """A lower bound: pieces over half the size need a sequence each, small ones what room is left."""
    best = 0
    for small in range(size // 2 + 1):
        large = {s: n for s, n in histogram.items() if s > size - small}
        middle = {s: n for s, n in histogram.items() if size // 2 < s <= size - small}
        rest = sum(s * n for s, n in histogram.items() if small <= s <= size // 2)
        room = sum((size - s) * n for s, n in middle.items())
        best = max(best, sum(large.values()) + sum(middle.values()) + max(0, -(-(rest - room) // size)))
    return best


def given_totals(items: tuple[int, ...]) -> tuple[list[int], dict[int, tuple[int, ...]]]:
    """What one or two pieces of a sequence add up to, in order, and the pieces for each sum."""
    counts = Counter(items)
    kinds = list(counts)
    gives = {a + b: (a, b) for a, b in combinations(kinds, 2)} | {2 * a: (a, a) for a, n in counts.items() if n > 1}
    gives |= {a: (a,) for a in kinds}
    return sorted(gives), gives


def exchange(
    lower: tuple[int, ...], upper: tuple[int, ...], room: int, totals: tuple[list[int], dict[int, tuple[int, ...]]] | None = None
) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The exchange that fills ``upper`` most: one or two pieces of ``lower`` for none or one of ``upper``.

    It must raise the sum of squared fills, so ``upper`` has to end fuller than ``lower`` was.
    """
    order, gives = totals or given_totals(lower)
    best, found = max(0, sum(lower) - sum(upper)), None
    for back in (0, *dict.fromkeys(upper)):
        at = bisect_right(order, room + back) - 1
        if at >= 0 and order[at] - back > best:
            best, found = order[at] - back, (gives[order[at]], (back,) if back else ())
            if best == room:
                break
    return found


def without(items: tuple[int, ...], out: Sequence[int], more: Sequence[int]) -> tuple[int, ...]:
    kept = list(items)
    for x in out:
        kept.remove(x)
    return tuple(sorted([*kept, *more], reverse=True))


def local_search(groups: Sequence[Group], histogram: Mapping[int, int], size: int) -> list[Group]:
    """Exchange pieces between underfull groups, emptiest first, until no sequence can be saved or no exchange helps.

    Whether an exchange helps depends on what two groups hold alone. So a group is tried once against each other
    one; no two of the ``settled`` ones can exchange, and only groups that an exchange has made queue again. Every
    exchange raises the squared fills, which are bounded, so the search ends by itself.
    """
    bins: Counter = Counter()
    for items, number in groups:
        bins[tuple(sorted(items, reverse=True))] += number
    goal, total = least_sequences(histogram, size), sum(bins.values())
    queue = [(sum(b), b) for b in bins if sum(b) < size]
    heapify(queue)
    settled: list[tuple[int, tuple[int, ...]]] = []
    inside: set[tuple[int, ...]] = set()
    totals = {}

    def change(items: tuple[int, ...], number: int) -> None:
        """Add to a group's number; a group that is gone leaves, one that is new or has a twin now queues."""
        bins[items] += number
        if not bins[items]:
            del bins[items]
            totals.pop(items, None)
            if items in inside:
                inside.remove(items)
                settled.pop(bisect_left(settled, (sum(items), items)))
        elif number > 0 and sum(items) < size and (items not in inside or bins[items] > 1):
            heappush(queue, (sum(items), items))

    while queue and total > goal:
        fill, new = heappop(queue)
        if new not in bins:
            continue
        pairs = [(new, new)]
        if new not in inside:
            fuller, emptier = settled[bisect_left(settled, (fill,)) :], settled[: bisect_left(settled, (fill + 1,))]
            pairs += [(new, other) for _, other in reversed(fuller)] + [(other, new) for _, other in emptier]
        for lower, upper in pairs:
            number = bins[new] // 2 if lower == upper else min(bins[lower], bins[upper])
            if not number:
                if new not in bins:
                    break
                continue
            if lower not in totals:
                totals[lower] = given_totals(lower)
            found = exchange(lower, upper, size - sum(upper), totals[lower])
            if not found:
                continue
            given, back = found
            rest = without(lower, given, back)
            change(lower, -number)
            change(upper, -number)
            change(without(upper, back, given), number)
            if rest:
                change(rest, number)
            else:
                total -= number
                if total <= goal:
                    break
        if new in bins and new not in inside:
            inside.add(new)
            insort(settled, (fill, new))
    return sorted(bins.items())


def slots(groups: Sequence[Group]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies in a sequence, first sequence, first offset) for every length of a group."""
    out, ranks, sequence = [], Counter(), 0
    for items, number in groups:
        at = 0
        for length, copies in sorted(Counter(items).items(), reverse=True):
            out.append((length, ranks[length], ranks[length] + number * copies, copies, sequence, at))
            ranks[length] += number * copies
            at += length * copies
        sequence += number
    return out


def pack(pieces: DataFrame, keys: Sequence[str], size: int = 1024, length: str = "length", bucket_rows: int | None = None) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: as few sequences of at most ``size`` as the search finds.

    The pieces of a length are ranked in hashed buckets of about ``bucket_rows``, by default a thousandth of all
    pieces, but 500 at least and 20,000 at most. A bucket's ranks begin where the earlier ones end, and the plan is cut along the buckets, so all tables meet by (length, bucket) and none has to be broadcast.
    """
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    names = [f"_k{i}" for i in range(len(keys))]
    kept = pieces.select(together(pieces, columns), F.col(f"`{length}`").alias("_n"), *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)])
    kept = stored(kept, "pieces")
    histogram = {r[0]: r[1] for r in kept.groupBy("_n").count().collect()}  # at most ``size`` rows
    plan = slots(local_search(best_fit(histogram, size), histogram, size)) if histogram else []
    places = spark.createDataFrame(plan, "_length long, _from long, _to long, _copies long, _sequence long, _at long")
    bucket_rows = bucket_rows or max(500, min(20_000, sum(histogram.values()) // 1000))
    buckets = F.element_at(F.lit([-(-histogram.get(n, 1) // bucket_rows) for n in range(1, size + 1)]), F.col("_n").cast("int"))
    marked = kept.withColumn("_bucket", F.pmod(F.xxhash64(*names), buckets).cast("int"))
    counts = marked.groupBy("_n", "_bucket").count()
    earlier = Window.partitionBy("_n").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    cuts = before.join(
        places, (F.col("_n") == F.col("_length")) & (F.col("_from") < F.col("_before") + F.col("count")) & (F.col("_to") > F.col("_before"))
    )
    cuts = stored(cuts.drop("_length", "count").withColumnsRenamed({"_n": "_l", "_bucket": "_b"}), "cuts")
    inside = Window.partitionBy("_n", "_bucket").orderBy(*names)
    ranked = marked.withColumn("_inside", F.row_number().over(inside) - 1)
    rank = F.col("_before") + F.col("_inside")
    placed = ranked.join(
        cuts, (F.col("_n") == F.col("_l")) & (F.col("_bucket") == F.col("_b")) & (rank >= F.col("_from")) & (rank < F.col("_to"))
    )
    turn = rank - F.col("_from")
    return placed.select(
        "_kept.*",
        (F.col("_sequence") + F.floor(turn / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_at") + turn % F.col("_copies") * F.col("_n")).cast("long").alias("offset"),
    )
