"""Shared-folder and graph helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import Membership

#: Bytes of one Arrow batch of texts.
BATCH_BYTES = 4 << 20
#: Edges of one task of a connected-components step, and the fewest tasks it has.
TASK_EDGES, LEAST_TASKS = 1 << 17, 32
#: Edges (16 bytes each) that one task labels without any rounds.
ONE_TASK_EDGES = 1 << 20
#: Bits of the filters that pick rows before a shuffle: 2 MiB where the number of keys isn't told, at most 32 MiB where it is.
FILTER_BITS, LARGEST_FILTER_BITS = 1 << 24, 1 << 28

#: Stands for a null doc_id inside the operators; results carry the null again.
NULL_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is absent and the master is local (tests, a single
    machine) is a temporary folder of this machine set instead.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches bounded to BATCH_BYTES unless they were set otherwise.

    Whole texts go to Python workers; the usual bound of 64 MiB a batch, held on
    both sides of the pipe by every task, is most of a small executor's spare memory.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) in (None, "67108864b", "64m", "64MB"):
        df.sparkSession.conf.set(key, f"{BATCH_BYTES}b")
    return df


def identified(docs: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, columns) alone, so extra columns can't clash; null ids get NULL_ID."""
    return small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), *columns)


def trimmed(step):
    """step, a generator over batches, with the memory it freed given back to the system when it ends.

    Python workers serve one stage after the other; what each keeps for reuse
    adds up in a small executor.
    """
    def run(batches):
        yield from step(batches)
        give_back()

    return run


def reusing(step):
    """step, trimmed, which keeps what it frees at hand while it runs.

    Steps that make and drop arrays of some megabytes all the time else get them from the system,
    and clear them, each time.
    """
    def run(batches):
        option = getattr(ctypes.CDLL(None), "mallopt", lambda *_: 0)  # glibc has it
        option(-3, 32 << 20)  # smaller arrays are not mapped on their own
        option(-1, 256 << 20)  # so much may be free before any is given back
        yield from step(batches)
        option(-1, 64 << 20)
        give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def hash_sample(rows: DataFrame, most: int, seed: int, *ties: str) -> DataFrame:
    """The `most` rows that come first by a hash of doc_id; for fits, whose bound is a parameter.

    Where there are many more, rows beyond twice the expected last place are
    dropped in the scan, so the sort does not get `most` rows from every task.
    """
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 31))
    total = rows.count()
    if total > 4 * most:
        rows = rows.where(place < F.lit(2 * most * (1 << 31) // total))
    return rows.orderBy(place, "doc_id", *ties).limit(most)


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, label, text): one text for each row of chosen(doc_id, label), whose size is bounded by its fit.

    Of several different texts of one doc_id the one with the least hash is
    taken, so repeated rows add nothing to a fit. Null texts are left out.
    """
    rows = small_batches(docs).select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def agreed_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of 0/1 labels; ids with both are left out, as are nulls and other values."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.min(column).cast("int").alias("label"), F.max(column).cast("int").alias("most"))
    return known.where("label = most").drop("most")


def restored(column: str = "doc_id"):
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias(column)


def _labelled(batches):
    """(node, root) of all edges of a task, by minimum labels and pointer jumping."""
    batches = [b for b in batches if len(b)]
    if not batches:
        return
    a, b = (np.concatenate([x.column(k).to_numpy() for x in batches]) for k in (0, 1))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        # only roots are hung below others, so what is joined stays joined
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "root"])


def connected_components(edges: DataFrame, max_rounds: int = 40, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the component's least node.

    At most `one_task` edges are labelled by one task. For more, it alternates the large-star and small-star steps of Kiveris et al. (2014),
    which need a number of rounds logarithmic in the component size and never
    hold a component in one task: each step is one aggregation with partial
    results before its shuffle and one join. Few edges are read by few tasks, so
    the shuffles of a step are not made of near-empty blocks.
    """
    def star(pairs: DataFrame, large: bool, tasks: int) -> DataFrame:
        if large:
            both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        out = out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return out.coalesce(tasks).distinct().coalesce(tasks)

    def mark(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(pairs)
    if before[0] <= one_task:
        return pairs.coalesce(1).mapInArrow(_labelled, "node long, root long")
    for _ in range(max_rounds):
        tasks = max(LEAST_TASKS, before[0] // TASK_EDGES)
        pairs = cut(star(star(pairs.coalesce(tasks), True, tasks), False, tasks))
        after = mark(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected_components did not settle")
    roots = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().join(roots.select("node"), "node", "left_anti"))


def members_of(df: DataFrame, column: str, keys: int | None = None):
    """A function from an Arrow column to booleans: false where a value is surely not in df[column].

    A Bloom filter of some 16 bits for each of the `keys` told, filled in tasks and
    merged by pieces. Its size has a bound; beyond some 30 million keys it fills
    up, more rows pass and the join that follows drops them.
    """
    filter_bits = FILTER_BITS if keys is None else min(LARGEST_FILTER_BITS, max(1 << 16, 1 << (16 * keys).bit_length()))

    def filled(batches):
        found = Membership(filter_bits)
        for batch in batches:
            found.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        pieces = found.table.reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "bits"])

    def merged(table: pa.Table) -> pa.Table:
        bits = np.zeros(filter_bits // 512, np.uint8)
        for piece in table.column("bits"):
            bits |= np.frombuffer(piece.as_py(), np.uint8)
        return pa.table({"piece": table.column("piece")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    pieces = df.select(column).coalesce(64).mapInArrow(filled, "piece int, bits binary").groupBy("piece").applyInArrow(merged, "piece int, bits binary").collect()
    table = np.frombuffer(b"".join(bytes(r.bits) for r in sorted(pieces, key=lambda r: r.piece)), np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(table if len(table) else np.zeros(filter_bits // 8, np.uint8))

    def has(values) -> np.ndarray:
        keys = np.asarray(values.to_numpy(zero_copy_only=False) if isinstance(values, pa.Array) else values, np.int64).view(np.uint64)
        return Membership(filter_bits, shared.value).has(keys)

    return has
