"""What the operators of this folder share: session settings, scratch tables, batches of texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyroll import session
from tallyroll.operators.spread import join_dimension
from tallyroll.session import stored

# Rows in one Arrow batch, so that a batch of long texts stays small.
ARROW_ROWS = 512
# A table with one row per group is broadcast up to so many rows and bytes of its keys.
GROUP_ROWS, GROUP_BYTES = 20_000, 4_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on."""
    session.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def together(df: DataFrame, columns: Sequence[str]) -> Column:
    """Columns that an operator only hands on, as one column, so that their names meet no other."""
    return F.struct(*[df[f"`{c}`"] for c in columns]).alias("_kept")


def beside_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """The rows with the columns of their group; ``groups`` is a stored table of numbers, unique on its key.

    The key is a struct of names. Few groups are broadcast, so the rows stay where they are; beyond the bounds
    the rows are dealt by key and salt, so that no group meets in one task. Rows without a group go.
    """
    names = [F.octet_length(f"{key}.{f.name}") for f in groups.schema[key].dataType if f.dataType.typeName() == "string"]
    n, size = groups.agg(F.count(F.lit(1)), F.sum(sum(names, F.lit(0)))).first()
    if n <= GROUP_ROWS and (size or 0) <= GROUP_BYTES:
        return rows.join(F.broadcast(groups), key)
    return join_dimension(rows, groups, key, how="inner")


def empty(df: DataFrame) -> bool:
    """True if a stored table has no row."""
    return not df.take(1)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches where the texts of a column pass ``limit`` bytes; one longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)
