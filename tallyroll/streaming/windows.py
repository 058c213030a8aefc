"""Windowed aggregates in event time that stay right when rows come late.

Every micro-batch is aggregated once to partial rows per window and key. Windows that the watermark (the latest time
of earlier batches less ``delay``) has not passed are open: their partials are merged into a small state, written anew
by each batch, so the state holds the open windows and nothing else. When the watermark passes a window it goes
out once. Rows that come after that go out as a correction, a partial row of the same form, and readers merge windows,
corrections and, if they like, the windows that are still open. So nothing is dropped, whatever order files arrive in,
and no clock has to tick for the last windows to show.

A batch writes only to places named by its id and reads only those of the batch before it, so it can be repeated. A
batch counts once its mark is written; readers take the last mark. Rows without a time belong to no window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyroll.session import child_names, remove

MARK = "reached bigint, open_rows bigint, late_rows bigint, schema string"


@dataclass(frozen=True)
class Windows:
    """What is kept per window of ``size`` (every ``slide``) and ``keys``.

    ``sums`` and ``tops`` are aggregates of a batch's rows, which merge by sum and by maximum.
    """

    time: str
    size: str
    keys: Sequence[str] = ()
    sums: Mapping[str, Column] = field(default_factory=dict)
    tops: Mapping[str, Column] = field(default_factory=dict)
    slide: str | None = None
    delay: int = 600  # seconds

    def partial(self, batch: DataFrame) -> DataFrame:
        """(window_start, window_end, keys, values, _seen) of one batch; ``_seen`` is the latest time in microseconds."""
        window = F.window("_time", self.size, self.slide) if self.slide else F.window("_time", self.size)
        values = [c.alias(n) for n, c in (*self.sums.items(), *self.tops.items())]
        rows = (
            batch.withColumn("_time", F.col(self.time).cast("timestamp"))
            .groupBy(window.alias("_w"), *self.keys)
            .agg(*values, F.unix_micros(F.max("_time")).alias("_seen"))
            .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *self.keys, *self.sums, *self.tops, "_seen")
        )
        # Sums of decimals take the widest type at once, as every merge would widen them again.
        kinds = {n: k for n, k in rows.dtypes if n in self.sums and k.startswith("decimal")}
        return rows.withColumns({n: F.col(n).cast(f"decimal(38,{k.split(',')[1]}") for n, k in kinds.items()})

    def merged(self, parts: DataFrame) -> DataFrame:
        """One row per window and key of any partial rows."""
        kinds = dict(parts.dtypes)
        values = [F.sum(n).cast(kinds[n]).alias(n) for n in self.sums] + [F.max(n).alias(n) for n in self.tops]
        return parts.groupBy("window_start", "window_end", *self.keys).agg(*values)

    def take(self, batch: DataFrame, batch_id: int, folder: str) -> None:
        """One micro-batch, as ``foreachBatch`` gives it."""
        spark, work = batch.sparkSession, f"{folder}/work/batch={batch_id}"

        def kept(rows: DataFrame, path: str) -> DataFrame:
            rows.write.mode("overwrite").parquet(path)
            return spark.read.schema(rows.schema).parquet(path)

        parts = kept(self.partial(batch), f"{work}/parts")
        before = mark(spark, folder, batch_id - 1)["reached"] if batch_id > 0 else None
        times = [t for t in (before, parts.agg(F.max("_seen")).first()[0]) if t is not None]
        reached = max(times) if times else None
        late = passed(before, self.delay)
        fresh, late_rows = parts.filter(~late).drop("_seen"), parts.filter(late).drop("_seen")
        if batch_id > 0:
            fresh = fresh.unionByName(spark.read.schema(fresh.schema).parquet(f"{folder}/open/batch={batch_id - 1}"))
        fresh = kept(self.merged(fresh), f"{work}/fresh")
        done = passed(reached, self.delay)
        out = fresh.filter(done).withColumn("kind", F.lit("window")).unionByName(late_rows.withColumn("kind", F.lit("correction")))
        kept(out, f"{folder}/out/batch={batch_id}")
        still = kept(fresh.filter(~done), f"{folder}/open/batch={batch_id}")
        schema = ", ".join(f"`{n}` {k}" for n, k in still.dtypes)
        row = [(reached, still.count(), late_rows.count(), schema)]
        spark.createDataFrame(row, MARK).coalesce(1).write.mode("overwrite").json(f"{folder}/marks/batch={batch_id}")
        remove(spark, work)
        if batch_id > 1:
            remove(spark, f"{folder}/open/batch={batch_id - 2}")

    def _read(self, spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
        """What has gone out up to the last marked batch, and the windows that are open after it."""
        last = last_batch(spark, folder)
        schema = mark(spark, folder, last)["schema"]
        out = spark.read.schema(f"{schema}, kind string, batch bigint").parquet(f"{folder}/out")
        return out.filter(F.col("batch") <= last), spark.read.schema(schema).parquet(f"{folder}/open/batch={last}")

    def results(self, spark: SparkSession, folder: str, open_too: bool = True) -> DataFrame:
        """Every window once, with all that came for it; without the windows that are still open if not ``open_too``.

        Before the first batch there is nothing to read, which is an error.
        """
        out, state = self._read(spark, folder)
        return self.merged(out.drop("kind", "batch").unionByName(state) if open_too else out)

    def corrections(self, spark: SparkSession, folder: str) -> DataFrame:
        """(window_start, window_end, keys, values, batch) of what came after its window had gone out."""
        return self._read(spark, folder)[0].filter(F.col("kind") == "correction").drop("kind")


def passed(reached: int | None, delay: int) -> Column:
    """Whether the watermark of a latest time (in microseconds) has passed the window."""
    if reached is None:
        return F.lit(False)
    return F.unix_micros("window_end") <= F.lit(reached - delay * 1_000_000)


def mark(spark: SparkSession, folder: str, batch_id: int) -> dict:
    """What a batch left: the latest time so far, open windows, partial rows that came late, the columns of a window."""
    return spark.read.schema(MARK).json(f"{folder}/marks/batch={batch_id}").first().asDict()


def last_batch(spark: SparkSession, folder: str) -> int:
    return max(int(n.removeprefix("batch=")) for n in child_names(spark, f"{folder}/marks") if n.startswith("batch="))
