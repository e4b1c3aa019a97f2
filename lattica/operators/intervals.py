"""Sets of sequence numbers as disjoint intervals, and runs that process only the gaps.

An interval set is a DataFrame (lo long, hi long), both ends included. All steps work in blocks of
`width` consecutive numbers, so no task ever sorts more than a block's worth of ends, whatever the
numbers' distribution; intervals over several blocks are cut at the blocks' ends.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16


def islands(points: DataFrame, column: str, width: int = WIDTH) -> DataFrame:
    """The numbers in a column as intervals without gaps. Nulls name nothing; repeated numbers count once."""
    by_block = Window.partitionBy("b").orderBy("p")
    return (
        points.select(F.col(column).cast("long").alias("p"))
        .where("p is not null")
        .distinct()
        .withColumn("b", F.floor(F.col("p") / F.lit(width)))
        .withColumn("g", F.col("p") - F.row_number().over(by_block))
        .groupBy("b", "g")
        .agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
        .select("lo", "hi")
    )


def _edges(intervals: DataFrame, mark: str, width: int) -> DataFrame:
    """Both ends of each piece, as (block, position, +1 or -1 in the column named mark)."""
    w = F.lit(width)
    pieces = (
        intervals.select(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
        .where("lo <= hi")
        .withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / w), F.floor(F.col("hi") / w))))
        .select("b", F.greatest("lo", F.col("b") * w).alias("lo"), F.least("hi", (F.col("b") + 1) * w - 1).alias("hi"))
    )
    a, p = ("d", "z") if mark == "a" else ("z", "d")
    ends = F.explode(F.array(F.struct(F.col("lo").alias("x"), F.lit(1).alias("d"), F.lit(0).alias("z")), F.struct((F.col("hi") + 1).alias("x"), F.lit(-1).alias("d"), F.lit(0).alias("z"))))
    return pieces.select("b", ends.alias("e")).select("b", "e.x", F.col(f"e.{a}").alias("a"), F.col(f"e.{p}").alias("p"))


def _sweep(edges: DataFrame, keep) -> DataFrame:
    """Stretches between successive ends of a block for which keep(open available, open processed) holds."""
    by_block = Window.partitionBy("b").orderBy("x")
    return (
        edges.groupBy("b", "x")
        .agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
        .select("b", "x", F.sum("a").over(by_block).alias("a"), F.sum("p").over(by_block).alias("p"), F.lead("x").over(by_block).alias("n"))
        .where(keep(F.col("a"), F.col("p")) & F.col("n").isNotNull())
        .select(F.col("x").alias("lo"), (F.col("n") - 1).alias("hi"))
    )


def subtract(available: DataFrame, processed: DataFrame, width: int = WIDTH) -> DataFrame:
    """Numbers of `available` that `processed` doesn't cover, as disjoint intervals: the gaps still to process.

    Either side may overlap itself, be unsorted or empty; intervals with lo > hi or a null end hold nothing.
    """
    return _sweep(_edges(available, "a", width).unionByName(_edges(processed, "p", width)), lambda a, p: (a > 0) & (p == 0))


def merge(*sets: DataFrame, width: int = WIDTH) -> DataFrame:
    """The union of interval sets as disjoint intervals that don't touch within a block."""
    edges = _edges(sets[0], "a", width)
    for s in sets[1:]:
        edges = edges.unionByName(_edges(s, "a", width))
    flat = _sweep(edges, lambda a, p: a > 0)
    by_block = Window.partitionBy("b").orderBy("lo")
    starts = F.when(F.col("lo") == F.lag("hi").over(by_block) + 1, 0).otherwise(1)
    return (
        flat.withColumn("b", F.floor(F.col("lo") / F.lit(width)))
        .withColumn("s", starts)
        .withColumn("g", F.sum("s").over(by_block))
        .groupBy("b", "g")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .select("lo", "hi")
    )


def numbers(intervals: DataFrame, name: str) -> DataFrame:
    """Each number of an interval set as a row."""
    return intervals.select(F.explode(F.sequence("lo", "hi")).alias(name))


def meet(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    """The numbers that both interval sets hold, as disjoint intervals."""
    return _sweep(_edges(a, "a", width).unionByName(_edges(b, "p", width)), lambda x, y: (x > 0) & (y > 0))


@dataclass(frozen=True)
class Gaps:
    """What a run has to process, and the number of commits it was derived from."""

    base: int
    intervals: DataFrame


class Ledger:
    """Which sequence numbers were processed, kept in a folder beside the outputs.

    A run takes the gaps, writes its output and the merged intervals to a folder of its own, then publishes
    both at once by one numbered marker. The number follows from the commits that the gaps were derived from,
    and a marker is never replaced, so of two runs that took the same gaps only one can commit. A run that
    fails before its marker leaves nothing that counts: its numbers stay gaps and the next run takes them;
    numbers that arrive late are gaps likewise.

    The marker is written aside and then moved, which on HDFS and the like fails if the name is taken, in one
    step; on a folder of this machine a hard link does the same. A store without such a step needs another lock.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _count(self) -> int:
        root = self._hadoop(f"{self.path}/commits")
        return sum(s.getPath().getName().endswith(".json") for s in self._fs.listStatus(root)) if self._fs.exists(root) else 0

    def runs(self) -> list[dict]:
        """The committed runs, in order; one job reads all markers."""
        if not self._count():
            return []
        found = self.spark.read.text(f"{self.path}/commits/*.json", wholetext=True).collect()
        return sorted((json.loads(r[0]) for r in found), key=lambda r: r["number"])

    def _ledger(self, count: int) -> DataFrame:
        if not count:
            return self.spark.createDataFrame([], "lo long, hi long")
        marker = self.spark.read.text(f"{self.path}/commits/{count - 1:08d}.json", wholetext=True).first()[0]
        return self.spark.read.parquet(f"{self.path}/{json.loads(marker)['run']}/ledger")

    def processed(self) -> DataFrame:
        """The intervals that the last commit holds; none at first."""
        return self._ledger(self._count())

    def outputs(self) -> DataFrame | None:
        """What all committed runs put out together."""
        paths = [f"{self.path}/{r['run']}/output" for r in self.runs()]
        return self.spark.read.parquet(*paths) if paths else None

    def gaps(self, available: DataFrame) -> Gaps:
        """The numbers of available (lo, hi) that no commit holds, to be handed to commit()."""
        base = self._count()
        return Gaps(base, subtract(available, self._ledger(base)))

    def commit(self, output: DataFrame, gaps: Gaps, done: DataFrame | None = None) -> str:
        """Writes output and merged intervals, then makes both visible at once.

        done: the intervals that output really covers, if not all gaps; they must not meet what is processed.
        RuntimeError if another run committed since the gaps were taken; nothing is visible then.
        """
        if self._count() != gaps.base:
            raise RuntimeError(f"another run committed number {gaps.base} first; take the gaps anew")
        before = self._ledger(gaps.base)
        if done is not None and not meet(done, before).isEmpty():
            raise ValueError("numbers that were processed before would be processed again")
        run = f"run-{gaps.base:08d}-{uuid.uuid4().hex[:12]}"
        output.write.parquet(f"{self.path}/{run}/output")
        merge(before, gaps.intervals if done is None else done).write.parquet(f"{self.path}/{run}/ledger")
        self._publish(run, gaps.base)
        return run

    def _publish(self, run: str, number: int) -> None:
        draft, final = self._hadoop(f"{self.path}/{run}/marker"), self._hadoop(f"{self.path}/commits/{number:08d}.json")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps({"run": run, "number": number}).encode()))
        stream.close()
        self._fs.mkdirs(final.getParent())
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            else:
                jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
                rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
                how = self.spark.sparkContext._gateway.new_array(rename, 1)
                how[0] = rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, how)
        except Exception as e:
            if self._fs.exists(final):
                raise RuntimeError(f"another run committed number {number} first; take the gaps anew") from e
            raise
