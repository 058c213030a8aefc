"""Tables that grow by deltas: one piece per batch, a manifest as the commit, and merged pieces.

A batch writes its rows as one piece of Parquet files, which no manifest names yet, and then a manifest: one
small file that lists all pieces, which appears at once or not at all. Readers take the last manifest and read
just its pieces, so they see one state while a writer merges, and a piece whose batch failed is never seen.

Every FAN pieces of a size class are merged into one of the next class, so n batches leave about log(n)
pieces and rewrite each row about log(n) times. Each piece has its own number of hash buckets, a power of two
chosen from its counted rows, and a file per bucket: a small delta is one file, and buckets split in two as
merged pieces grow. Wanted keys name the buckets that are opened.

One writer at a time, as a streaming query is. A repeated batch starts from the manifest before it and replaces
its own. The last KEEP manifests stay readable; ``clean`` deletes pieces that none of them names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyroll.session import child_names, remove, stored

MANIFEST = "name string, level int, buckets int, n_rows bigint, whole boolean"
FAN, KEEP = 4, 6
# Rows in one bucket at most, and keys' buckets that a read lists one by one.
BUCKET_ROWS, LISTED = 1_000_000, 10_000


@dataclass(frozen=True)
class Piece:
    name: str
    level: int
    buckets: int
    n_rows: int
    whole: bool  # holds everything before it as well, so marks of deletion have done their work


class DeltaTable:
    """A table in ``folder`` with the given schema, bucketed by ``keys``.

    ``fold`` merges rows of any pieces into the rows that stand for them; its second argument says whether
    these are all rows since the beginning, so that it may leave out what has no more effect.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], fold: Callable[[DataFrame, bool], DataFrame]):
        self.spark, self.folder, self.schema, self.keys, self.fold = spark, folder, schema, list(keys), fold
        self.columns = [c.split()[0] for c in schema.split(", ")]

    # Batch b commits version 2 b, and what it merges afterwards version 2 b + 1.

    def versions(self) -> list[int]:
        names = child_names(self.spark, f"{self.folder}/manifest")
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def pieces(self, before: int | None = None) -> list[Piece]:
        """Pieces of the last manifest, or of the last one of batches before ``before``; the oldest piece first."""
        known = [v for v in self.versions() if before is None or v < 2 * before]
        return self._listed(known[-1]) if known else []

    def committed(self, batch_id: int) -> list[Piece]:
        """Pieces as the batch committed them, before it merged any."""
        return self._listed(2 * batch_id)

    def _listed(self, version: int) -> list[Piece]:
        rows = self.spark.read.schema(f"place int, {MANIFEST}").json(f"{self.folder}/manifest/version={version}")
        return [Piece(*tuple(r)[1:]) for r in sorted(rows.collect())]

    def _publish(self, version: int, pieces: Sequence[Piece]) -> None:
        rows = [(i, *asdict(p).values()) for i, p in enumerate(pieces)]
        path = f"{self.folder}/manifest/version={version}"
        self.spark.createDataFrame(rows, f"place int, {MANIFEST}").coalesce(1).write.mode("overwrite").json(path)

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, n_rows: int, level: int, whole: bool) -> Piece:
        buckets = 1
        while buckets * BUCKET_ROWS < n_rows:
            buckets *= 2
        piece = Piece(uuid.uuid4().hex, level, buckets, n_rows, whole)
        out = rows.select(*self.columns).withColumn("_bucket", self.bucket(buckets))
        out = out.repartitionByRange(buckets, "_bucket") if buckets > 1 else out.coalesce(1)
        out.write.partitionBy("_bucket").parquet(f"{self.folder}/pieces/{piece.name}")
        return piece

    def append(self, batch_id: int, rows: DataFrame) -> None:
        """Commit the rows as the batch's piece. The rows are counted, so they should be a stored table."""
        earlier = self.pieces(batch_id)
        n = rows.count()
        self._publish(2 * batch_id, [*earlier, *([self._write(rows, n, 0, not earlier)] if n else [])])

    def merge(self, batch_id: int) -> int:
        """Merge size classes that are full; gives the number of rows that were rewritten."""
        pieces = self.pieces(batch_id + 1)
        before, rewritten = list(pieces), 0
        while True:
            full = next((p.level for p in pieces if sum(q.level == p.level for q in pieces) >= FAN), None)
            if full is None:
                break
            at = [i for i, p in enumerate(pieces) if p.level == full]
            # What lies between the first and the last goes along, so pieces stay in order.
            first, last = at[0], at[-1] + 1
            whole = first == 0
            merged = stored(self.fold(self.rows(pieces[first:last]), whole), "merged")
            n = merged.count()
            rewritten += n
            pieces[first:last] = [self._write(merged, n, full + 1, whole)] if n else []
        if pieces != before:
            self._publish(2 * batch_id + 1, pieces)
        return rewritten

    def touched(self, pieces: Sequence[Piece], keys: DataFrame | None) -> list[list[int] | None]:
        """Per piece the buckets that the keys fall into, None for all of them."""
        most = max((p.buckets for p in pieces), default=1)
        if keys is None or most == 1:
            return [None] * len(pieces)
        found = [r[0] for r in keys.select(self.bucket(most)).distinct().limit(LISTED + 1).collect()]
        if len(found) > LISTED:
            return [None] * len(pieces)
        return [sorted({b % p.buckets for b in found}) if p.buckets > 1 else None for p in pieces]

    def rows(self, pieces: Sequence[Piece], keys: DataFrame | None = None) -> DataFrame:
        """All rows of the pieces, or those of some keys; only the keys' buckets are opened."""
        parts = []
        for piece, buckets in zip(pieces, self.touched(pieces, keys)):
            part = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(f"{self.folder}/pieces/{piece.name}")
            if buckets is not None:
                part = part.filter(F.col("_bucket").isin(buckets))
            parts.append(part.select(*self.columns))
        found = reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], self.schema)
        return found if keys is None else found.join(keys.select(*self.keys), self.keys, "left_semi")

    def current(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The folded state, optionally of earlier batches or of some keys only."""
        return self.fold(self.rows(self.pieces(before), keys), True)

    def clean(self) -> None:
        """Delete manifests but for the last KEEP, and pieces that none of those names."""
        versions = self.versions()
        for v in versions[:-KEEP]:
            remove(self.spark, f"{self.folder}/manifest/version={v}")
        rows = [f"{self.folder}/manifest/version={v}" for v in versions[-KEEP:]]
        held = {r["name"] for r in self.spark.read.schema(MANIFEST).json(rows).select("name").collect()} if rows else set()
        for name in child_names(self.spark, f"{self.folder}/pieces"):
            if name not in held:
                remove(self.spark, f"{self.folder}/pieces/{name}")
