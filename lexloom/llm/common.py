"""Shared pieces: written cut points, text identities, exact distributed ranks and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from itertools import chain
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one below the warehouse, or of a single machine its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            where = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        else:
            where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lexloom-checkpoints"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """Tables written below the shared folder. They cut the lineage and survive the loss of an executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex}", 0
        self.tables: dict[str, str] = {}

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Writes df once and returns the written table."""
        df.write.parquet(path := self.path(label), compression="zstd")
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
        """Like keep, as a table bucketed by keys, so that joins on them don't move it."""
        name, n, path = f"lexloom_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.path(label)
        w = df.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).option("compression", "zstd")
        w.saveAsTable(name)
        self.tables[path.rpartition("/")[2]] = name
        return self.spark.table(name)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now: it does so as their plans are collected as garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more, with their entries in the catalogue."""
        jvm = self.spark._jvm
        for df in frames:
            for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
                if "/lexloom/" in f:
                    p = jvm.org.apache.hadoop.fs.Path(f)
                    p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
                if name := self.tables.pop(f.rpartition("/")[2], None):
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def text_key(text: Column | str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text, together its identity (null and empty are the same text)."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.xxhash64(t), F.xxhash64(F.lit(0x5EED), t)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_groups(df: DataFrame, keys: Sequence[str], run: Callable[[pa.Table, int, int], pa.RecordBatch | None], schema: str, rows: int = 20_000) -> DataFrame:
    """What `run` makes of each group of rows with equal keys (not null). It gets a table and the group's bounds there.

    Rows are dealt out and sorted by the keys; a task holds about `rows` rows or one group, so groups must have a bounded size.
    Small groups cost no call of their own between Spark and Python, unlike applyInPandas.
    """
    n = len(keys)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                if len(batch):
                    held.append(batch)
                if sum(map(len, held)) < rows:
                    continue
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            new = np.zeros(len(t), bool)
            new[0] = True
            for k in range(n):
                x = t.column(k).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            at = np.flatnonzero(new).tolist()
            ends = [*at[1:], len(t)]
            if batch is not None:  # the last group may go on
                held = t.slice(at[-1]).to_batches()
                at, ends = at[:-1], ends[:-1]
            for a, b in zip(at, ends, strict=True):
                out = run(t, a, b)
                if out is not None and len(out):
                    yield out

    return df.select(*keys, *[c for c in df.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(groups, schema)


def with_rank(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str, buckets: int) -> DataFrame:
    """Adds the exact rank (long, from 0) of each row among rows with equal keys.

    No task sorts a whole group: rows are counted by (keys, bucket), the counts of at most `buckets`
    buckets give offsets, and rows are numbered inside (keys, bucket) only. The order is bucket first,
    then `order`; rows equal in all of these get their numbers in any order.
    """
    b = "__bucket"
    rows = df.withColumn(b, F.pmod(bucket, F.lit(buckets)).cast("int"))
    counts = rows.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1) if keys else None
    if before is None:
        counts = counts.withColumn("__all", F.lit(1))
        before = Window.partitionBy("__all").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    offsets = offsets.select(*[F.col(k).alias(f"__rk{i}") for i, k in enumerate(keys)], F.col(b).alias("__b"), "__before")
    inside = Window.partitionBy(*keys, b).orderBy(*order)
    numbered = rows.withColumn("__in", F.row_number().over(inside))
    cond = numbered[b] == offsets["__b"]
    for i, k in enumerate(keys):
        cond = cond & numbered[k].eqNullSafe(offsets[f"__rk{i}"])
    out = numbered.join(offsets, cond)
    return out.withColumn(name, (F.col("__before") + F.col("__in") - 1).cast("long")).drop(
        b, "__in", "__before", "__b", *[f"__rk{i}" for i in range(len(keys))]
    )


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, root): the smallest node that edges (a, b: long) reach from each node with an edge.

    Each round takes the least label among neighbours, then the label of that label, so chains shrink by
    halves; hubs are aggregated before the shuffle. Every round is written, and its predecessor deleted.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("__r"))
        step = labels.join(near, "node").select("node", F.col("root").alias("__old"), F.least("root", "__r").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("__up"))
        nxt = scratch.keep(step.join(jump, "root", "left").select("node", F.least("root", "__up").alias("root"), "__old"), "labels")
        moved = nxt.where("root <> __old").limit(1).count()
        scratch.drop(labels)
        labels = nxt
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    scratch.drop(both)
    return labels.select("node", "root")
