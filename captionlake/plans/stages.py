"""Pipeline stages: injected batch functions, resumable checkpoints, batch plans and memory-adaptive batches."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any, TypeVar

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

A, B = TypeVar("A"), TypeVar("B")


class OutOfMemory(RuntimeError):
    """Raised by an injected function whose batch does not fit."""


def run_batches(jobs: Iterable[A], fn: Callable[[list[A]], list[B]], size: int, key: Callable[[A], Any] | None = None, flush_every: int = 0, flush: Callable[[], None] | None = None, failed: Callable[[A, Exception], B] | None = None) -> Iterator[tuple[A, B]]:
    """Jobs in batches, longest first by key (stable); a batch that does not fit is halved for good; one job that does not is an error.

    failed: what a job gives that can't be done. A batch that fails is cut in halves until the jobs at fault stand alone; the
    others are done, and later batches have their full size again. Without it, a failure is raised.
    """
    rest = sorted(jobs, key=key, reverse=True) if key else list(jobs)

    def halved(part: list[A], error: Exception) -> list[B]:
        if len(part) == 1:
            return [failed(part[0], error)]
        middle, out = len(part) // 2, []
        for half in (part[:middle], part[middle:]):
            try:
                out += _called(fn, half)
            except Exception as e:
                out += halved(half, e)
        return out

    at = done = 0
    while at < len(rest):
        part = rest[at : at + size]
        try:
            out = _called(fn, part)
        except OutOfMemory as e:
            if size == 1 or len(part) == 1:
                if failed is None:
                    raise
                out = [failed(part[0], e)]
            else:
                size = max(1, size // 2)
                continue
        except Exception as e:
            if failed is None:
                raise
            out = halved(part, e)
        yield from zip(part, out, strict=True)
        at += len(part)
        done += 1
        if flush and flush_every and done % flush_every == 0:
            flush()


def _called(fn: Callable[[list[A]], list[B]], part: list[A]) -> list[B]:
    out = fn(part)
    if len(out) != len(part):
        raise ValueError("a batch function must return one result for each job")
    return out


def batch_plan(jobs: DataFrame, length: str, size: int, partition: str) -> DataFrame:
    """Add batch: rows of a partition column, longest first, by the batch size. Rows need an `id` that breaks ties."""
    w = Window.partitionBy(partition).orderBy(F.desc(length), "id")
    return jobs.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def infer(rows: DataFrame, fn: Callable[[list[dict]], list[dict]], columns: list[str], out: str, size: int = 16, key: Callable[[dict], Any] | None = None, load: Callable[[], Any] | None = None, failed: dict | None = None) -> DataFrame:
    """Run a model over rows: fn gets batches of dicts of `columns` (and the loaded model) and returns dicts of the fields of `out`.

    The other columns pass through. Batches mix files; rows carry their keys, so order never matters. failed: the fields of a
    row on which fn raises; only that row has them, and there is a column `error` with what was raised, else null.
    """
    passed = list(rows.columns)
    names = [x.strip().split()[0] for x in out.split(",")]
    if failed is not None:
        names, out = [*names, "error"], f"{out}, error string"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {out}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load() if load else None
        lost = None if failed is None else (lambda job, e: {**failed, "error": f"{type(e).__name__}: {e}"})
        for f in frames:
            jobs = list(enumerate(f[columns].to_dict("records")))
            call = (lambda part: fn([x for _, x in part], model)) if load else (lambda part: fn([x for _, x in part]))
            found = dict(sorted(((i, r) for (i, _), r in run_batches(jobs, call, size, (lambda x: key(x[1])) if key else None, failed=lost)), key=lambda x: x[0]))
            yield pd.concat([f[passed].reset_index(drop=True), pd.DataFrame([found[i] for i in range(len(f))], columns=names, dtype=object)], axis=1)

    return rows.mapInPandas(run, schema)


def split_cached(items: DataFrame, cached: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(items that the checkpoint has, items to compute)."""
    keys = cached.select(key).distinct()
    return items.join(keys, key, "left_semi"), items.join(keys, key, "left_anti")


@dataclass
class Stage:
    """A named step with a checkpoint: files that it has are read, others computed and added.

    A run adds a folder of at most `buckets` parts, however many files there are, and counts once it has its mark of success.
    metrics: after a run, files and rows computed, files read from before, and seconds; dropped by what `drops` says of a row
    that is given.
    """

    name: str
    compute: Callable[[DataFrame], DataFrame]
    key: str = "file_id"
    buckets: int = 64
    drops: Column | None = None
    metrics: dict[str, float] = field(default_factory=dict)

    def run(self, items: DataFrame, checkpoint: str | None = None) -> DataFrame:
        if checkpoint is None:
            return self.compute(items)
        spark, path = items.sparkSession, f"{checkpoint.rstrip('/')}/stage={self.name}"
        began = time.monotonic()
        cached = read_checkpoint(spark, path)
        todo = items if cached is None else split_cached(items, cached, self.key)[1]
        given, made = Observation(), Observation()
        lost = F.count_if(self.drops) if self.drops is not None else F.lit(0).cast("long")
        todo = todo.observe(given, F.count(F.lit(1)).alias("rows_in"), lost.alias("dropped"))
        out = self.compute(todo).withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets))).observe(made, F.count(F.lit(1)).alias("rows_out"))
        out.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/run={uuid.uuid4().hex}")
        self.metrics = {"rows_in": 0, "dropped": 0, "rows_out": 0, **_seen(given), **_seen(made), "seconds": round(time.monotonic() - began, 3)}
        done = read_checkpoint(spark, path)
        if done is None:
            return self.compute(items.limit(0))
        return done.join(items.select(self.key).distinct(), self.key, "left_semi")


def _seen(observation: Observation) -> dict[str, int]:
    """What was observed; nothing where Spark knew that there are no rows, and so ran no such step."""
    try:
        return observation.get
    except Py4JJavaError:
        return {}


def metrics_table(spark: SparkSession, stages: list[Stage]) -> DataFrame:
    """stage, place, metric, value of stages that have run, in their order."""
    rows = [(s.name, k, name, float(v)) for k, s in enumerate(stages) for name, v in s.metrics.items()]
    return spark.createDataFrame(rows, "stage string, place int, metric string, value double")


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all runs that ended well; None where there is none. A run that broke off has no mark and is not read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in fs.listStatus(root) if s.isDirectory()] if fs.exists(root) else []
    ended = [x for x in found if fs.exists(hadoop.Path(f"{x}/_SUCCESS")) and any(s.isDirectory() for s in fs.listStatus(hadoop.Path(x)))]
    return spark.read.option("basePath", path).parquet(*sorted(ended)).drop("bucket", "run") if ended else None


def needs_run(items: DataFrame, cached: DataFrame | None, key: str = "file_id") -> bool:
    return not (items if cached is None else items.join(cached.select(key), key, "left_anti")).isEmpty()
