"""SimHash fingerprints, linked by pigeonring filtering, and the groups that the links form.

A fingerprint of 64 bits is cut into ``bits + 1`` segments that stand in a ring. If two fingerprints
differ in at most ``bits`` bits, some segment starts a chain whose every prefix of length l differs in at
most l * bits / (bits + 1) bits: nothing in the first segment, one bit in the first two, and so on. The
first two segments of the chain are an equality join: one side gives its own segments, the other its own
and all with one bit of the second segment turned. Longer prefixes prune before the full count of bits.

Equal fingerprints are one node, so copies never meet in pairs. Buckets with more than BUCKET different
fingerprints are not paired off: their members look up every fingerprint within reach by value, which is
linear in the members and loses no link. Components come from alternating star contractions.

Null text counts as empty; texts without words have fingerprint zero and link like any other. Ties in a
bit's majority give 0. Repeated rows share a component. A component whose ids are all null has id null. An
empty table gives an empty result. Columns that carry a result's name give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyroll.llm.common import empty, slices, stored, together

WIDTH = 64
BUCKET = 64
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """Bit by bit the strict majority over the XXH64 of all shingles of ``words`` words, as a signed number."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(found) - words + 1)
    begins, ends = (ends - sizes)[:n].tolist(), ends[-n:].tolist()
    counts = np.zeros(WIDTH, np.int64)
    hash_of = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        cut = zip(begins[at : at + CHUNK], ends[at : at + CHUNK])
        hashes = np.array([hash_of(line[a:b], seed) for a, b in cut], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def with_fingerprints(df: DataFrame, words: int = 3, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default all) and ``fingerprint`` as a long."""
    keep = [c for c in (df.columns if keep is None else keep) if c != "fingerprint"]
    kept = df.select(*[df[f"`{c}`"] for c in keep], df[f"`{text}`"].cast("string").alias("_shingled"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("fingerprint", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, -1):
            found = [fingerprint(t, words) for t in part.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.int64())], names=schema.names)

    return kept.mapInArrow(work, schema)


def segments(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    cuts = [WIDTH * i // (bits + 1) for i in range(bits + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def segment(value: Column, place: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(value, place[0]).bitwiseAND(F.lit((1 << place[1]) - 1))


def ring_keys(bits: int, turned: bool) -> Column:
    """Keys of all chain starts: a segment, the next one as it is or with up to one bit turned, and the start."""
    ring, value, out = segments(bits), F.col("fingerprint"), []
    for i, first in enumerate(ring):
        second = ring[(i + 1) % len(ring)]
        masks = [0, *(1 << b for b in range(second[1]))] if turned else [0]
        head = F.shiftleft(segment(value, first), second[1])
        key = F.xxhash64(F.lit(i), head) if first[1] + second[1] > 56 else head.bitwiseOR(F.lit(i << 57))
        tail = segment(value, second)
        if first[1] + second[1] > 56:
            out += [F.xxhash64(key, tail.bitwiseXOR(F.lit(m))) for m in masks]
        else:
            out += [key.bitwiseOR(tail.bitwiseXOR(F.lit(m))) for m in masks]
    return F.explode(F.array(*out))


def ring_viable(a: Column, b: Column, bits: int) -> Column:
    """Whether some chain around the ring stays within its budget at every length."""
    ring = segments(bits)
    m = len(ring)
    differ = a.bitwiseXOR(b)
    parts = [F.bit_count(segment(differ, s)) for s in ring]
    viable = F.lit(False)
    for i in range(m):
        total, holds = F.lit(0), F.lit(True)
        for length in range(1, m + 1):
            total = total + parts[(i + length - 1) % m]
            holds = holds & (total <= length * bits // m)
        viable = viable | holds
    return viable


def links(distinct: DataFrame, bits: int) -> DataFrame:
    """(a, b), a < b, of different fingerprints with at most ``bits`` different bits."""
    a, b = F.col("a"), F.col("b")
    base = distinct.select(F.col("fingerprint").alias("b"), ring_keys(bits, False).alias("key"))
    probe = distinct.select(F.col("fingerprint").alias("a"), ring_keys(bits, True).alias("key"))
    crowded = stored(base.groupBy("key").count().filter(F.col("count") > BUCKET).select("key"), "crowded")
    near = (a < b) & ring_viable(a, b, bits) & (F.bit_count(a.bitwiseXOR(b)) <= bits)
    if empty(crowded):
        return probe.join(base, "key").filter(near).select("a", "b").distinct()
    plain = probe.join(crowded, "key", "left_anti").join(base.join(crowded, "key", "left_anti"), "key")
    members = probe.join(crowded, "key", "left_semi").select("a").distinct()
    turns = [sum(1 << i if i < 63 else -(1 << 63) for i in flips) for n in range(1, bits + 1) for flips in combinations(range(WIDTH), n)]
    masks = distinct.sparkSession.createDataFrame([(turns,)], "turns array<bigint>")
    reached = members.join(F.broadcast(masks)).select("a", F.explode("turns").alias("turn"))
    reached = reached.select("a", a.bitwiseXOR(F.col("turn")).alias("b"))
    looked_up = reached.join(distinct.select(F.col("fingerprint").alias("b")), "b", "left_semi")
    found = plain.filter(near).select("a", "b").union(looked_up.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node of its component.

    Large stars and small stars alternate until nothing changes. Minima are aggregates, and each join
    reads two stored tables, so a centre with very many neighbours is split by adaptive execution.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x > y").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select("y", "x"))
        least = stored(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = stored(large.distinct(), "large")
        least = stored(large.groupBy("x").agg(F.min("y").alias("m")), "least")
        small = large.join(least, "x").filter("y > m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = stored(small.union(least.select("x", "m")).distinct(), "small")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("x").alias("node"), F.col("y").alias("root"))


def near_duplicates(
    df: DataFrame, words: int = 3, bits: int = 2, id_column: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (default all) with ``fingerprint`` (long) and ``component_id``, the least id of the component."""
    keep = [c for c in (df.columns if keep is None else keep) if c != "component_id"]
    rows = stored(with_fingerprints(df, words, text, keep), "fingerprints")
    distinct = stored(rows.groupBy("fingerprint").agg(F.min(id_column).alias("least")), "distinct")
    roots = components(links(distinct, bits))
    nodes = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    nodes = stored(nodes, "nodes")
    named = stored(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    named = stored(nodes.join(named, "root").select("fingerprint", "component_id"), "named")
    return rows.join(named, "fingerprint").select(*[f"`{c}`" for c in keep if c != "fingerprint"], "fingerprint", "component_id")


def first_of_each(df: DataFrame, words: int = 3, bits: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each component the row with the least id stays."""
    rows = stored(df.select(together(df, df.columns), F.monotonically_increasing_id().alias("_row")), "rows")
    texts = rows.select("_row", F.col("_kept").getField(id_column).alias("_id"), F.col("_kept").getField(text).alias("_text"))
    grouped = near_duplicates(texts, words, bits, "_id", "_text", ["_row", "_id"])
    # A component without any id has none to go by, so there the fingerprint stands for it.
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("f"))
    first = F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_row"))
    winners = grouped.groupBy(group.alias("group")).agg(first.alias("first")).select(F.col("first._row").alias("_row"))
    return rows.join(winners, "_row", "left_semi").select("_kept.*")
