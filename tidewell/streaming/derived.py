"""T12, SC6, SC7: tables derived from saved rows, fed by one stream, and a sweep for what it missed.

Each derived table is a folder of transactions, `tx=<name>`, each written whole by
one job. A micro-batch is a transaction of every table, named after its number, so
when a run is killed between two tables, or within one, the batch comes again and
rewrites the same transactions: each derived row is there once. Keys that other
transactions already have are left out before anything is derived, so a row that is
saved again, or swept, is not judged twice.

A derivation may give no row for what it refuses (no budget, no answer); a sweep
derives what a table still lacks. Sweeps run when the stream doesn't: one writer
at a time is assumed, readers need no lock. A batch becomes visible table by table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: Bytes of lacking keys up to which a sweep broadcasts them; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Derived:
    """A derived table: its schema, which has the key, and what makes its rows from saved ones (at most one for a key)."""

    schema: str
    derive: Callable[[DataFrame], DataFrame]


@dataclass
class PostSave:
    """Derived tables in `folder`, which the driver and all executors reach.

    Saved rows have `key`; of rows with one key in a batch the last by `order` counts.
    Rows with a null key have no identity and are passed over.
    """

    spark: SparkSession
    folder: str
    tables: dict[str, Derived]
    key: str = "id"
    order: str = "seq"

    def table(self, name: str) -> DataFrame:
        """The rows of a derived table, with the transaction `tx` that wrote each."""
        schema = f"{self.tables[name].schema}, tx string"
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}/tx=*")
        except AnalysisException as none:
            if none.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def lacking(self, name: str, saved: DataFrame, tx: str = "") -> DataFrame:
        """Saved rows that no transaction but `tx` has derived. Only row groups in the saved rows' range of keys are read."""
        low, high = saved.agg(F.min(self.key), F.max(self.key)).first()
        if low is None:
            return saved.limit(0)
        done = self.table(name).where((F.col("tx") != tx) & F.col(self.key).between(low, high)).select(F.col(self.key).alias("__key"))
        return saved.join(done, F.col(self.key) == F.col("__key"), "left_anti")

    def _commit(self, name: str, derived: DataFrame, tx: str) -> None:
        columns = self.spark.createDataFrame([], self.tables[name].schema).columns
        derived.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/tx={tx}")

    def land(self, batch: DataFrame, number: int) -> None:
        """Derive every table's rows of a micro-batch; to be given to foreachBatch."""
        tx = f"batch-{number:012d}"
        others = [c for c in batch.columns if c != self.key]
        last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in others]), self.order).alias("__row")
        # the rows stay dealt by key, so no table's join shuffles them again
        rows = batch.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(last).select(self.key, "__row.*").persist()
        try:
            for name, table in self.tables.items():
                self._commit(name, table.derive(self.lacking(name, rows, tx)), tx)
        finally:
            rows.unpersist()

    def follow(self, saved: DataFrame) -> StreamingQuery:
        """Feed all tables from a stream of saved rows until it is read; a restart goes on where the last run was killed."""
        return saved.writeStream.foreachBatch(self.land).option("checkpointLocation", f"{self.folder}/_stream").trigger(availableNow=True).start()

    def sweep(self, saved: DataFrame, run: str, derive: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> None:
        """Derive what tables still lack of saved (one row for each key), with other derivations if told; a repeated sweep of a run replaces its own."""
        rows, tx = saved.where(F.col(self.key).isNotNull()), f"sweep-{run}"
        for name, table in self.tables.items():
            missing = self.lacking(name, rows.select(self.key), tx).persist()  # keys alone: whole rows are read for these
            try:
                count, size = missing.agg(F.count("*"), F.sum(F.octet_length(F.col(self.key).cast("string")))).first()
                if count:
                    keys = F.broadcast(missing) if size + 16 * count <= BROADCAST_BYTES else missing
                    self._commit(name, (derive or {}).get(name, table.derive)(rows.join(keys, self.key, "left_semi")), tx)
            finally:
                missing.unpersist()
