"""Write-ahead ledgers of calls: replay, orphans, latest terminals, caps, and phase readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_terminal(events: DataFrame, key: str, seq: str, value: str, ok: Column) -> DataFrame:
    """The terminal that counts per key: the first OK one, which nothing later overrides, else the last."""
    first, last = F.min_by(value, F.when(ok, F.col(seq))), F.max_by(value, seq)
    return events.groupBy(key).agg(F.when(F.bool_or(ok), first).otherwise(last).alias("last_value"), F.when(F.bool_or(ok), F.min(F.when(ok, F.col(seq)))).otherwise(F.max(seq)).alias("last_seq"))


def after_success(events: DataFrame, key: str, seq: str, ok: str) -> DataFrame:
    """Rows that follow an OK row of their key; there must be none."""
    before = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_ok", F.max(F.col(ok).cast("int")).over(before)).filter("_ok = 1").drop("_ok")


def orphans(starts: DataFrame, terminals: DataFrame, key: str) -> DataFrame:
    return starts.join(terminals.select(key), key, "left_anti")


def running_cap(events: DataFrame, key: str, seq: str, started: str, cap: int, reserve: int, retry: str) -> DataFrame:
    """Calls started so far per run, and whether the next is allowed: first tries stop `reserve` before the cap. A started call counts even if it never ended."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.col(started).cast("long")).over(w)
    limit = F.when(F.col(retry), F.lit(cap)).otherwise(F.lit(cap - reserve))
    return events.withColumn("spent", spent).withColumn("allowed", F.col("spent") <= limit)


def ready_phases(tasks: DataFrame, deps: DataFrame, done: DataFrame) -> DataFrame:
    """Phases without an incomplete task in any phase that they need. tasks: task_id, phase; deps: phase, needs; done: task_id."""
    open_ = tasks.join(done.select("task_id"), "task_id", "left_anti").select(F.col("phase").alias("needs")).distinct()
    blocked = deps.join(open_, "needs", "left_semi").select("phase").distinct()
    return tasks.select("phase").distinct().join(blocked, "phase", "left_anti")
