"""A text index that is kept up to date by changes instead of being built again.

A folder holds immutable segments of postings, partitioned by a hash of the term,
and small tables of removed documents. A batch of changes adds one segment and at
most one such table; a later version of a document, or its removal, hides what
earlier segments have of it. The manifest lists what belongs to each version and
is appended last, in one file: readers see a batch whole or not at all, a failed
or repeated batch leaves only folders that no version names, and segments that a
batch doesn't touch are never written again.

A lookup reads the buckets of its terms alone. The numbers that ranking needs of
the whole corpus, documents and their total length, are kept in the manifest.
Segments are merged by size, so there are about as many as the logarithm of the
batches. One writer at a time is assumed; readers need no lock.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from . import retrieval

_MANIFEST = "version long, kind string, segment long, name string, rows long, total long"
_POSTINGS = "id long, term string, wtf double, len int, segment long, name string, bucket int"
_DOCS = "id long, len int, segment long, name string"
_REMOVED = "id long, at long"
#: Bytes of text that one task cuts into postings: it holds a row for each document and term, some thirty times as much.
TASK_BYTES = 8 << 20


@dataclass(frozen=True)
class Part:
    """A line of the manifest. kind: segment (rows: postings), removed (rows: documents), stream (rows: its last batch), stats (rows, total: documents and their length)."""

    kind: str
    segment: int
    name: str
    rows: int
    total: int = 0


@dataclass
class TextIndex:
    """An index in `folder`, which the driver and all executors reach."""

    spark: SparkSession
    folder: str
    fields: dict[str, float] = field(default_factory=lambda: dict(retrieval.WEIGHTS))
    porter: bool = False
    buckets: int = 64

    # ---- reading ----

    def parts(self) -> tuple[int, list[Part]]:
        """The newest version and its parts; version 0 has none."""
        try:
            lines = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest")
        except AnalysisException:
            return 0, []
        part = F.struct("kind", "segment", "name", "rows", "total")
        newest = lines.groupBy("version").agg(F.collect_list(part).alias("parts")).orderBy(F.desc("version")).limit(1).collect()
        return (newest[0].version, [Part(*p) for p in newest[0].parts]) if newest else (0, [])

    def _table(self, table: str, schema: str, parts: list[Part]) -> DataFrame:
        paths = [f"{self.folder}/{table}/segment={p.segment}/name={p.name}" for p in parts if p.kind == "segment"]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{table}").parquet(*paths)

    def _live(self, rows: DataFrame, parts: list[Part]) -> DataFrame:
        paths = [f"{self.folder}/removed/{p.name}" for p in parts if p.kind == "removed"]
        if not paths:
            return rows
        gone = self.spark.read.schema(_REMOVED).parquet(*paths).groupBy(F.col("id").alias("__id")).agg(F.max("at").alias("__at"))
        return rows.join(gone, (F.col("id") == F.col("__id")) & (F.col("segment") < F.col("__at")), "left_anti")

    def documents(self) -> DataFrame:
        """(id, len) of the documents in the index."""
        _, parts = self.parts()
        return self._live(self._table("docs", _DOCS, parts), parts).select("id", "len")

    def bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def lookup(self, terms: list[str], parts: list[Part] | None = None) -> DataFrame:
        """(id, term, wtf, len) of the terms, from their buckets alone."""
        parts = self.parts()[1] if parts is None else parts
        rows = self._table("postings", _POSTINGS, parts)
        buckets = [self.bucket(F.lit(t)) for t in terms]  # constants, so whole folders are passed over
        rows = rows.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms)) if terms else rows.limit(0)
        return self._live(rows, parts).select("id", "term", "wtf", "len")

    def stats(self, parts: list[Part] | None = None) -> DataFrame:
        """One row: the number of documents and their mean length."""
        found = [p for p in (self.parts()[1] if parts is None else parts) if p.kind == "stats"]
        docs, total = (found[0].rows, found[0].total) if found else (0, 0)
        return self.spark.createDataFrame([(docs, total / docs if docs else None)], "docs long, avg_len double")

    def search(self, terms: list[str], most: int | None = None) -> DataFrame:
        """(id, score), lower is better."""
        _, parts = self.parts()
        return retrieval.bm25(self.lookup(terms, parts), self.stats(parts), terms, most)

    # ---- writing ----

    def apply(self, changes: DataFrame, stream: str = "", batch: int = -1) -> bool:
        """Add the changes (id, op, seq, and the fields): op is delete, or anything else to insert or replace.

        Of several changes of an id the one with the greatest seq counts; a null id
        is passed over. With `stream`, a batch that was applied before is not applied
        again. Tells whether the index changed.
        """
        version, parts = self.parts()
        if any(p.kind == "stream" and p.name == stream and p.rows >= batch for p in parts):
            return False
        at, name = version + 1, uuid.uuid4().hex
        have = [f for f in self.fields if f in changes.columns]
        row = F.struct("op", *have)
        known = changes.where("id IS NOT NULL").withColumn("id", F.col("id").cast("long"))
        hidden = self._live(self._table("docs", _DOCS, parts), parts).join(known.select("id"), "id", "left_semi").select("id", F.lit(at).cast("long").alias("at"), "len")
        hidden.select("id", "at").write.parquet(f"{self.folder}/removed/{name}")
        removed = self.spark.read.schema(_REMOVED).parquet(f"{self.folder}/removed/{name}").count()
        lost = hidden.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("n")).first().n if removed else 0
        size = known.agg(F.sum(sum((F.coalesce(F.octet_length(f), F.lit(0)) for f in have), F.lit(0)))).first()[0]
        dealt = known.repartition(1 + (size or 0) // TASK_BYTES, "id")  # their number follows the batch, so no task grows with it
        new = dealt.groupBy("id").agg(F.max_by(row, "seq").alias("row")).select("id", "row.*").where("op IS NULL OR op <> 'delete'").drop("op")
        added = self._write(new.select("id", retrieval.lengths(new, self.fields).alias("len")), retrieval.postings(new, self.fields, self.porter), at, name)
        stats = next((p for p in parts if p.kind == "stats"), Part("stats", 0, "", 0))
        keep = [p for p in parts if p.kind != "stats" and not (p.kind == "stream" and p.name == stream)]
        keep += [Part("removed", at, name, removed)] if removed else []
        keep += [Part("segment", at, name, added[0])] if added[1] else []
        keep += [Part("stream", 0, stream, batch)] if stream else []
        self._commit(at, [*keep, Part("stats", 0, "", stats.rows + added[1] - removed, stats.total + added[2] - lost)])
        return True

    def _write(self, docs: DataFrame, posted: DataFrame, segment: int, name: str) -> tuple[int, int, int]:
        """Write a segment; the numbers of its postings and documents, and their total length."""
        where = f"segment={segment}/name={name}"
        # a bucket that holds much of the rows is split when the shuffle is read
        posted.withColumn("bucket", self.bucket("term")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/postings/{where}")
        docs.write.parquet(f"{self.folder}/docs/{where}")
        part = [Part("segment", segment, name, 0)]
        written = self._table("docs", _DOCS, part).agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
        return self._table("postings", _POSTINGS, part).count() if written.n else 0, written.n, written.total

    def _commit(self, version: int, parts: list[Part]) -> None:
        lines = [(version, p.kind, p.segment, p.name, p.rows, p.total) for p in parts]
        self.spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def merge(self, growth: float = 1.0) -> list[int]:
        """Merge the newest segments as long as the next older one is no larger than `growth` times those before; their numbers.

        The merged segment takes the newest number, so a removal hides in it what it
        hid before. Removals that no older segment needs are left out.
        """
        version, parts = self.parts()
        segments = sorted((p for p in parts if p.kind == "segment"), key=lambda p: -p.segment)
        run = segments[:1]
        while len(run) < len(segments) and segments[len(run)].rows <= growth * sum(p.rows for p in run):
            run.append(segments[len(run)])
        if len(run) < 2:
            return []
        name, newest = uuid.uuid4().hex, run[0].segment
        removals = [p for p in parts if p.kind == "removed"]
        docs, posted = (self._live(self._table(table, schema, run), removals) for table, schema in (("docs", _DOCS), ("postings", _POSTINGS)))
        rows, n, _ = self._write(docs.select("id", "len"), posted.select("id", "term", "wtf", "len"), newest, name)
        rest = [p for p in parts if p not in run and not (p.kind == "removed" and len(run) == len(segments) and p.segment <= newest)]
        self._commit(version + 1, [*rest, *([Part("segment", newest, name, rows)] if n else [])])
        return [p.segment for p in run]

    def follow(self, changes: DataFrame, checkpoint: str, stream: str, **options) -> StreamingQuery:
        """Start a stream that applies each micro-batch of changes once, and merges after it."""

        def step(batch: DataFrame, number: int) -> None:
            if self.apply(batch, stream, number):
                self.merge()

        writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return writer.trigger(**(options or {"availableNow": True})).start()
