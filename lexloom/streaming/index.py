"""Streams: documents indexed as files arrive, statistics kept up by batch, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import tokenize
from lexloom.operators.store import DocumentTable


def read_files(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 100, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def index_stream(source: DataFrame, table: DocumentTable, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x, policy: str = "overwrite", once: bool = True):
    """Writes each batch to the table; overwriting makes a repeated batch harmless. Returns the started query."""

    def write(batch: DataFrame, _: int) -> None:
        table.write(transform(batch), policy)

    w = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def term_counts(source: DataFrame, content: str = "content") -> DataFrame:
    """A running count of documents by token, for outputMode complete or update."""
    return source.select(F.explode(F.array_distinct(tokenize(F.col(content)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def merge_statistics(old: DataFrame, batch_docs: DataFrame, content: str = "content", sign: int = 1) -> DataFrame:
    """Document frequencies after a batch is added (sign 1) or deleted (-1): a merge of two aggregated tables."""
    new = term_counts(batch_docs, content).select("token", (F.col("df") * sign).alias("df"))
    return old.unionByName(new).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")


def windowed(events: DataFrame, ts: str = "ts", length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Counts and sums by tumbling or sliding windows; batch or stream alike."""
    df = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return df.groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    df = events.withWatermark(ts, late) if events.isStreaming else events
    return df.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def reduce_state(messages: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """A conversation's state as a stream of its messages: number and last text, kept by key between batches."""

    def step(k, parts, state):
        import pandas as pd

        n, last = state.get if state.exists else (0, None)
        for p in parts:
            n += len(p)
            last = p[text].iloc[-1] if len(p) else last
        state.update((n, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "last": [last]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return messages.groupBy(key).applyInPandasWithState(step, f"{key} long, n long, last string", "n long, last string", "update", GroupStateTimeout.NoTimeout)
