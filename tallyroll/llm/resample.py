"""Importance resampling of documents towards a target corpus, by hashed word runs.

Features of a text are its single words and its pairs of neighbouring words, each hashed to a bucket. A bucket
gains by the logarithm of its smoothed share in the target over its share in the corpus; a document weighs the
mean gain of its features, and a Gumbel draw over the weights samples documents without replacement.

Counting goes by segments. A newline ends a word, so a text falls into lines: Spark counts equal lines of the
whole corpus, the features of each distinct line are computed once and multiplied by its occurrences, and the
pairs that cross from a line to the next one with a word are added as segments of their own. A line that is
in a third of all rows comes down to one partial row a task. Each task then sends at most one row per bucket.
The gains, one number a bucket, go to the driver and to every task; their number does not grow.

Words and their CRC-32 are found in numpy over the bytes of a batch, all words a byte at a time.

Null text has no words; a document without features weighs 0. A null id hashes as an empty one and ranks
last among equals. Repeated rows each take part; rows that tie in score and id are ranked by their counts.
With no target text all gains are those of the corpus against nothing. An empty table gives an empty result.
Columns of the input that carry a result's name give way to it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyroll.llm.common import slices, stored, together
from tallyroll.operators.spread import row_numbers

BUCKETS = 10_000
RESULTS = ("n_words", "n_features", "weight", "score", "rank")
# Words longer than this many bytes are hashed one by one.
LONG = 64
# A line's words begin and end with these; all other characters below 128 part words.
WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def crc_table() -> np.ndarray:
    """CRC-32 of one byte each, before the final complement."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = crc_table()


def extended(crc: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of what ``crc`` stands for (0: nothing), followed by a stretch of ``data`` each."""
    out = crc.astype(np.uint32)
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    long = int(np.searchsorted(-size[order], -LONG))
    for i in order[:long]:
        out[i] = zlib.crc32(data[begin[i] : begin[i] + size[i]], int(out[i]))
    order = order[long:]
    state, at, rest = ~out[order], begin[order], size[order]
    live = len(order) - np.searchsorted(rest[::-1], np.arange(LONG), side="right")
    for k in range(LONG):
        n = int(live[k])
        if not n:
            break
        state[:n] = CRC[(state[:n] ^ data[at[:n] + k]) & 255] ^ (state[:n] >> 8)
    out[order] = ~state
    return out


class Features:
    """Features of a batch of texts: per word its text, its bucket, and the bucket of the pair with the word before.

    ``paired`` is false for the first word of a text, which has no such pair.
    """

    def __init__(self, texts: pa.Array, buckets: int) -> None:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        texts = pa.concat_arrays([texts])
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        raw = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
        data = LOWER[raw[ends[0] : ends[-1]]]
        ends = ends - ends[0]
        # A word ends where a text ends, whatever the next one begins with.
        inside = IN_WORD[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        cuts = ends[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        starts[cuts] = inside[cuts]
        stops[cuts - 1] = inside[cuts - 1]
        begin = np.flatnonzero(starts)
        size = np.flatnonzero(stops) + 1 - begin
        self.text = np.searchsorted(ends, begin, side="right") - 1
        self.n_texts = len(texts)
        self.paired = np.zeros(len(begin), dtype=bool)
        self.paired[1:] = self.text[1:] == self.text[:-1]
        crc = extended(np.zeros(len(begin), dtype=np.uint32), data, begin, size)
        self.single = (crc % buckets).astype(np.int64)
        before = np.concatenate([crc[:1], crc[:-1]])
        space = ~(CRC[(~before ^ 32) & 255] ^ (~before >> 8))
        self.pair = (extended(space, data, begin, size) % buckets).astype(np.int64)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of whole numbers, one a word, per text."""
        total = np.concatenate([[0], np.cumsum(values)])
        edges = np.searchsorted(self.text, np.arange(self.n_texts + 1))
        return total[edges[1:]] - total[edges[:-1]]


def segments(texts: DataFrame) -> DataFrame:
    """(segment, across, n) of the texts' lines, and of the word pairs across lines, from the column ``_text``."""
    lines = F.split(F.coalesce(F.col("_text"), F.lit("")), "\n")
    first = F.transform(lines, lambda x: F.regexp_extract(x, WORD, 0))
    last = F.transform(lines, lambda x: F.reverse(F.regexp_extract(F.reverse(x), WORD, 0)))
    ends = F.filter(F.arrays_zip(first.alias("first"), last.alias("last")), lambda x: x["first"] != "")
    rows = texts.select(lines.alias("_lines"), ends.alias("_ends"))
    across = F.transform("_ends", lambda x, i: F.concat_ws(" ", x["last"], F.get("_ends", i + 1)["first"]))
    pairs = F.slice(across, F.lit(1), F.greatest(F.size("_ends") - 1, F.lit(0)))
    whole = F.filter("_lines", lambda x: x.rlike(WORD))

    def kind(found: Column, across: bool) -> Column:
        return F.transform(found, lambda x: F.struct(x.alias("segment"), F.lit(across).alias("across")))

    each = F.explode(F.concat(kind(whole, False), kind(pairs, True)))
    return rows.select(each.alias("_s")).groupBy("_s.segment", "_s.across").agg(F.count(F.lit(1)).alias("n"))


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how often the features of all texts fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches, 0):
            found = Features(batch.column(0), buckets)
            across = batch.column(1).to_numpy(zero_copy_only=False)[found.text]
            n = batch.column(2).to_numpy()[found.text]
            for bucket, use in ((found.single, ~across), (found.pair, found.paired)):
                np.add.at(total, bucket[use], n[use])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return segments(texts).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Whole thousandths of the log ratio of every bucket; two tables of at most ``buckets`` rows come here."""
    s, t = np.zeros(buckets, dtype=object), np.zeros(buckets, dtype=object)
    for counts, into in ((corpus, s), (target, t)):
        for bucket, n in counts.collect():
            into[bucket] = n
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array(
        [math.floor(1000 * math.log(((b + 1) * (all_s + buckets)) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s, t)], dtype=np.int64
    )


def weighed(df: DataFrame, gain: np.ndarray, kept: Column, text: Column) -> DataFrame:
    """(_kept, n_words, n_features, weight) of every row."""
    buckets = len(gain)
    rows = df.select(text.cast("string").alias("_text"), kept)
    schema = rows.select("_kept").schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = Features(batch.column(0), buckets)
            words = found.per_text(np.ones(len(found.text), dtype=np.int64))
            total = found.per_text(gain[found.single] + np.where(found.paired, gain[found.pair], 0))
            n = np.maximum(2 * words - 1, 0)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(words), pa.array(n), pa.array(weight)], names=schema.names)

    return rows.mapInArrow(weigh, schema)


def resample(
    df: DataFrame,
    target: DataFrame,
    percent: int = 25,
    min_words: int = 20,
    seed: int = 7,
    buckets: int = BUCKETS,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (default all) with counts, ``weight``, ``score`` and, for drawn documents, ``rank``.

    Of the documents with at least ``min_words`` words the ``percent`` per cent with the highest scores are drawn.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in RESULTS]
    body = F.col(f"`{text}`").cast("string")
    corpus = bucket_counts(df.select(body.alias("_text")), buckets)
    wanted = bucket_counts(target.select(F.col(f"`{target_text}`").cast("string").alias("_text")), buckets)
    gain = gains(corpus, wanted, buckets)
    kept = F.struct(together(df, keep), F.col(f"`{doc_id}`").alias("_id")).alias("_kept")
    rows = weighed(df, gain, kept, body).select("_kept._kept", "_kept._id", "n_words", "n_features", "weight")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    part = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    gumbel = F.floor(-1000 * F.log(-F.log(part)))
    rows = stored(rows.withColumn("score", (F.col("weight") + gumbel).cast("long")), "weighed")
    able = F.col("n_words") >= min_words
    drawn = rows.filter(able).count() * percent // 100
    ranks = rows.filter(able).withColumns({"_low": -F.col("score"), "_none": F.col("_id").isNull(), "_row": F.monotonically_increasing_id()})
    ranks = row_numbers(ranks, [], ["_low", "_none", "_id", "n_words", "weight", "_row"], "rank")
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["_kept", "n_words", "n_features", "weight", "score", "rank"]
    out = ranks.select(*columns).unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("long")).select(*columns))
    return out.select("_kept.*", *RESULTS)
