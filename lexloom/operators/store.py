"""A stored table of documents: scan, filter, upserts by policy, deletes and statistics."""

from __future__ import annotations

import re
import uuid
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.errors import DuplicateDocument
from lexloom.functions.filters import apply_filter

POLICIES = ("none", "fail", "skip", "overwrite")


def latest(batch: DataFrame, id_col: str, arrival: str | None, last: bool) -> DataFrame:
    """One row for each id: the first or last to arrive."""
    if arrival is None:
        return batch.dropDuplicates([id_col])
    order = F.col(arrival).desc() if last else F.col(arrival).asc()
    return batch.withColumn("__n", F.row_number().over(Window.partitionBy(id_col).orderBy(order))).where("__n = 1").drop("__n")


def fresh(stored: DataFrame, batch: DataFrame, policy: str = "none", id_col: str = "id", arrival: str | None = None) -> DataFrame:
    """What a write adds to the ids stored: none and fail raise on any id that is stored or repeated; skip takes the first of each new id."""
    if policy not in POLICIES[:3]:
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "skip":
        return latest(batch, id_col, arrival, False).join(stored.select(id_col), id_col, "left_anti")
    twice = batch.groupBy(id_col).count().where("count > 1").select(id_col)
    clash = batch.select(id_col).join(stored.select(id_col), id_col, "left_semi").union(twice).limit(1).collect()
    if clash:
        raise DuplicateDocument(f"id {clash[0][0]!r} is already there")
    return batch


def upsert(stored: DataFrame, batch: DataFrame, policy: str = "none", id_col: str = "id", arrival: str | None = None) -> DataFrame:
    """The table after a write: what `fresh` adds, or, with overwrite, the batch's last row of each id instead of the stored one."""
    if policy != "overwrite":
        return stored.unionByName(fresh(stored, batch, policy, id_col, arrival), allowMissingColumns=True)
    new = latest(batch, id_col, arrival, True)
    return stored.join(new.select(id_col), id_col, "left_anti").unionByName(new, allowMissingColumns=True)


class Segment(NamedTuple):
    first: int
    last: int
    kind: str
    path: str


NAME = re.compile(r"(\d+)_(\d+)-(add|put|del)-\w+")


class DocumentTable:
    """Documents in Parquet below a folder, as segments: a write costs what it brings, not what is stored.

    A segment's folder is named by the numbers of the writes that it covers and its kind: `add` brings ids that were not stored, `put`
    takes the place of rows of its ids in earlier segments, `del` removes them. A segment counts once its writer has marked it as
    whole, and one that lies within the range of a later merge no longer does, so readers see whole writes only. After `fanout`
    writes, segments since the last base are merged; they join the base once they hold a `ratio` of its bytes, so each row is
    rewritten a bounded number of times for each doubling of the table.
    """

    def __init__(self, spark: SparkSession, root: str, schema: Any = None, id_col: str = "id", fanout: int = 8, ratio: float = 0.25):
        self.spark, self.root, self.id, self.schema, self.fanout, self.ratio = spark, root.rstrip("/"), id_col, schema, fanout, ratio

    def _path(self, *parts: Any):
        return self.spark._jvm.org.apache.hadoop.fs.Path(*parts)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _segments(self) -> tuple[list[Segment], list[Segment]]:
        """(segments that count, by number; segments that a merge has replaced)."""
        fs, p = self._fs(), self._path(self.root)
        if not fs.exists(p):
            return [], []
        found = []
        for s in fs.listStatus(p):
            m = NAME.fullmatch(s.getPath().getName())
            if m and fs.exists(self._path(s.getPath(), "_SUCCESS")):
                found.append(Segment(int(m[1]), int(m[2]), m[3], s.getPath().toString()))
        wider = lambda x, y: y.first <= x.first and x.last <= y.last and (y.first, y.last) != (x.first, x.last)
        gone = [x for x in found if any(wider(x, y) for y in found)]
        return sorted(x for x in found if x not in gone), gone

    def _merged(self, segments: list[Segment]) -> DataFrame:
        """Live rows of segments. Rows of one segment are hidden by later `put` and `del` segments, an anti-join on ids alone."""
        out = None
        for i, s in enumerate(segments):
            if s.kind == "del":
                continue
            df, hide = self.spark.read.parquet(s.path), None
            for later in segments[i + 1 :]:
                if later.kind != "add":
                    ids = self.spark.read.parquet(later.path).select(self.id)
                    hide = ids if hide is None else hide.unionByName(ids)
            df = df if hide is None else df.join(hide, self.id, "left_anti")
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out if out is not None else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        found = self._segments()[0]
        if not any(s.kind != "del" for s in found) and self.schema is None:
            raise FileNotFoundError(f"nothing is stored in {self.root}")
        return self._merged(found)

    def _append(self, df: DataFrame, kind: str, first: int | None = None, last: int | None = None) -> str:
        if first is None:
            first = last = max((s.last for s in self._segments()[0]), default=-1) + 1
        df.write.parquet(path := f"{self.root}/{first:09d}_{last:09d}-{kind}-{uuid.uuid4().hex[:8]}")
        return path

    def _bytes(self, segments: list[Segment]) -> int:
        return sum(self._fs().getContentSummary(self._path(s.path)).getLength() for s in segments)

    def compact(self, whole: bool = False) -> None:
        """Merges segments as described; whole merges all. What the last merge replaced is deleted, what this one does stays for readers that have begun."""
        found, old = self._segments()
        for x in old:
            self._fs().delete(self._path(x.path), True)
        base, rest = (found[:1], found[1:]) if found and found[0].first == 0 and found[0].kind == "add" else ([], found)
        if not rest:
            return
        if whole or not base or self._bytes(rest) >= self.ratio * self._bytes(base):
            self._append(self._merged(found), "add", 0, found[-1].last)
        elif all(s.kind == "add" for s in rest):
            self._append(self._merged(rest), "add", rest[0].first, rest[-1].last)
        elif not any(s.kind == "del" for s in rest):
            self._append(self._merged(rest), "put", rest[0].first, rest[-1].last)
        # With deletes among them, ids that no row carries any more still hide those of the base: they stay apart until they join it.
        elif len(rest) >= 4 * self.fanout:
            self._append(self._merged(found), "add", 0, found[-1].last)

    def _settle(self) -> None:
        if len(self._segments()[0]) > self.fanout:
            self.compact()

    def count(self) -> int:
        return self.read().count()

    def filter(self, spec: dict | None = None) -> DataFrame:
        return apply_filter(self.read(), spec)

    def write(self, batch: DataFrame, policy: str = "none", arrival: str | None = None) -> int:
        """Writes all or nothing by a policy as in `upsert`; returns the number of documents written."""
        there = any(s.kind != "del" for s in self._segments()[0])
        if policy == "overwrite":
            new, kind = latest(batch, self.id, arrival, True), "put"
        else:
            stored = self.read().select(self.id) if there else self.spark.createDataFrame([], batch.select(self.id).schema)
            new, kind = fresh(stored, batch, policy, self.id, arrival), "add"
        path = self._append(new, kind)
        n = self.spark.read.schema(new.schema).parquet(path).count()
        self._settle()
        return n

    def delete(self, ids: DataFrame) -> None:
        """Ids that aren't stored are ignored."""
        self._append(ids.select(F.col(ids.columns[0]).alias(self.id)).distinct(), "del")
        self._settle()

    def save(self, path: str) -> None:
        self.read().write.mode("overwrite").json(path)

    def load(self, path: str) -> int:
        return self.write(self.spark.read.schema(self.read().schema).json(path), "overwrite")
