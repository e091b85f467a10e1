"""Operator 10: line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, text_key

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class LineRuns:
    """A log of line hashes: each batch adds a run sorted by hash, and `fanout` runs of a level merge into one of the next.

    A run has a row for each hash (h1, h2): n, the documents of the batch that hold the line, and top, the largest doc_id
    among them. `top` is set only where the hash was new, found by anti-joining the batch with the runs: batches
    come by falling doc_id, so the first batch with a line has its largest holder, and later ones only add to n.
    """

    def __init__(self, scratch: Scratch, fanout: int = 2):
        self.tmp, self.fanout, self.levels = scratch, fanout, [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.max("held").alias("held"))

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, n, top with one row for each hash."""
        mine = batch.withColumn("held", F.lit(True))
        keys = None
        for r in self.runs():
            held = r.where("held").select("h1", "h2")
            keys = held if keys is None else keys.unionByName(held)
        if keys is not None:
            mine = mine.drop("held").join(keys.withColumn("old", F.lit(True)), ["h1", "h2"], "left")
            mine = mine.select("h1", "h2", "n", F.when(F.col("old").isNull(), F.col("top")).alias("top"), F.col("old").isNull().alias("held"))
        self.levels[0].append(self.tmp.keep(mine.repartition("h1", "h2").sortWithinPartitions("h1", "h2"), "run0"))
        at = 0
        while len(self.levels[at]) >= self.fanout:
            old = self.levels[at]
            new = self.tmp.keep(self.merged(old).sortWithinPartitions("h1", "h2"), f"run{at + 1}")
            self.tmp.drop(*old)
            self.levels[at] = []
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(new)
            at += 1

    def totals(self) -> DataFrame:
        """h1, h2, n and top over all batches."""
        return self.merged(self.runs()).drop("held")


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drops lines whose key has at least `least_chars` code points and stands in at least `least_docs` documents, but for
    the document with the largest doc_id that holds it, which keeps all of them. Adds n_lines (before) and n_dropped.

    Documents are told apart by doc_id; a null doc_id is one document, below all others. Rows that share the largest doc_id
    all keep their lines. Null text stays null and empty text empty, with one line. A text that loses all lines becomes
    empty. Columns n_lines and n_dropped of the input are replaced; others pass through.

    Line counts are aggregated before each shuffle, so a line in a third of all documents is one row for each task;
    only the documents' positions of dropped lines meet the text.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "lines")
    base = docs.drop("n_lines", "n_dropped")
    a, b = text_key("text")
    rows = base.where(F.length("text") >= least_chars).select(F.col("doc_id"), a.alias("t1"), b.alias("t2"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    k1, k2 = text_key("key")
    rows = rows.select("doc_id", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    rows = tmp.keep(rows.select("doc_id", "t1", "t2", "pos", k1.alias("h1"), k2.alias("h2")), "lines")

    cuts = base.agg(F.percentile_approx("doc_id", [i / batches for i in range(batches - 1, 0, -1)], 1000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    held = rows.select("h1", "h2", "doc_id").distinct()
    batch = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        batch = F.when(F.col("doc_id") > cuts[i], F.lit(i)).otherwise(batch)
    counted = held.groupBy(batch.alias("batch"), "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    counted = tmp.keep(counted, "counted")
    log = LineRuns(tmp, fanout)
    for i in range(len(cuts) + 1):
        log.add(counted.where(F.col("batch") == i).drop("batch"))
    # Written, so that Spark can deal out the rows of a hot line in the join.
    known = tmp.keep(log.totals().where(F.col("n") >= least_docs).drop("n"), "known")
    drops = rows.join(known, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    drops = drops.groupBy(F.col("doc_id").alias("__d"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).agg(F.collect_set("pos").alias("__drop"))
    drops = tmp.keep(drops, "drops")
    keyed = base.withColumns({"__a": a, "__b": b})
    met = keyed.join(drops, (F.col("__a") == F.col("__t1")) & (F.col("__b") == F.col("__t2")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left")
    met = met.select(*[F.col(f"`{c}`") for c in base.columns], "__drop")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields] + ["n_lines bigint", "n_dropped bigint"])

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            at = p.schema.get_field_index("text")
            texts, gone = p.column(at).to_pylist(), p.column(p.num_columns - 1).to_pylist()
            counts, dropped = [], []
            for i, (t, g) in enumerate(zip(texts, gone, strict=True)):
                counts.append(1 + (t or "").count("\n"))
                g = set(g or ())
                dropped.append(len(g))
                if g:
                    texts[i] = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in g)
            cols = p.columns[:-1]
            cols[at] = pa.array(texts, p.schema.field(at).type)
            cols += [pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*p.schema.names[:-1], "n_lines", "n_dropped"])

    return met.mapInArrow(apply, schema)
