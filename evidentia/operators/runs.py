"""Ledgers, checkpoints and imports of runs: states, replay checks, routing and verification, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import first_reason


def replayed(events: DataFrame, key: str, seq: str, ok: Column, freeze: str) -> DataFrame:
    """Per task: starts, terminals, and the reason against its ledger: two freezes, a terminal after an OK one, a terminal without a start."""
    before = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    terminal = F.col("kind") == "CALL_TERMINAL"
    rows = events.withColumn("_late", terminal & F.coalesce(F.max((terminal & ok).cast("int")).over(before) == 1, F.lit(False)))
    g = rows.groupBy(key).agg(F.count_if(F.col("kind") == "CALL_STARTED").alias("starts"), F.count_if(terminal).alias("terminals"), F.bool_or("_late").alias("_late"), F.count_distinct(freeze).alias("_freezes"))
    reason = first_reason((F.col("_freezes") > 1, "mixed_freeze"), (F.col("_late"), "terminal_after_ok"), (F.col("terminals") > F.col("starts"), "terminal_without_start"))
    return g.select(key, "starts", "terminals", reason.alias("reason"))


def import_status(selected: DataFrame, events: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Of the selected tasks: importable only if planned, with one start and one terminal, which is OK; else the reason."""
    terminal = F.col("kind") == "CALL_TERMINAL"
    g = events.groupBy(key).agg(F.count_if(F.col("kind") == "CALL_STARTED").alias("_s"), F.count_if(terminal).alias("_t"), F.bool_and(F.when(terminal, F.col("ok"))).alias("_ok"))
    rows = selected.select(key).distinct().join(plan.select(key, F.lit(True).alias("_p")).distinct(), key, "left").join(g, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    reason = first_reason((F.col("_p").isNull(), "not_in_plan"), (zero("_s") != 1, "start_count"), (zero("_t") != 1, "terminal_count"), (~F.coalesce("_ok", F.lit(False)), "not_ok"))
    return rows.select(key, reason.alias("reason"), reason.isNull().alias("verified"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one row, with their number."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def call_plan(tasks: DataFrame, calls: DataFrame, key: str, retries: int) -> DataFrame:
    """Per task what its cached calls allow: REUSE (an OK or a final failure), RETRY, EXHAUSTED or CALL. calls: key, seq, ok, retryable."""
    last = calls.groupBy(key).agg(F.bool_or("ok").alias("_ok"), F.bool_or(~F.col("ok") & ~F.col("retryable")).alias("_final"), F.count(F.lit(1)).alias("attempts"))
    rows = tasks.select(key).distinct().join(last, key, "left")
    state = F.when(F.col("attempts").isNull(), "CALL").when(F.col("_ok") | F.col("_final"), "REUSE").when(F.col("attempts") > retries, "EXHAUSTED").otherwise("RETRY")
    return rows.select(key, F.coalesce("attempts", F.lit(0)).alias("attempts"), state.alias("state"))


def resumable(tasks: DataFrame, done: DataFrame, key: str, phase: str, calls: str) -> DataFrame:
    """Per phase: tasks and calls planned, done and still to do, from checkpoints."""
    rows = tasks.join(done.select(key, F.lit(True).alias("_d")).distinct(), key, "left")
    is_done = F.col("_d").isNotNull()
    return rows.groupBy(phase).agg(F.count(F.lit(1)).alias("tasks"), F.sum(calls).alias("calls"), F.count_if(is_done).alias("done"), F.coalesce(F.sum(F.when(~is_done, F.col(calls))), F.lit(0)).alias("calls_left"))


def importable(records: DataFrame, phases: Sequence[str], origin: Sequence[str]) -> Column:
    """Whether a completed record can be taken over: of a phase that allows it, with one call, and with every field of its origin."""
    ok = F.col("phase").isin(*phases) & (F.col("calls") == 1)
    for c in origin:
        ok &= F.col(c).isNotNull()
    return F.coalesce(ok, F.lit(False))


def phase_plan(chunks: DataFrame, chunk: str, arms: DataFrame) -> DataFrame:
    """Every task of every chunk: the arms (phase, arm, calls) are a small table, broadcast."""
    return chunks.select(chunk).distinct().crossJoin(F.broadcast(arms)).select(chunk, "phase", "arm", "calls", F.concat_ws("::", "phase", F.col(chunk).cast("string"), "arm").alias("task_id"))


def blockers(facts: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: all reasons against a run, distinct and sorted, and READY only without any."""
    found = facts.select(F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in sorted(rules.items())]))).alias("reason"))
    return found.agg(F.array_sort(F.collect_set("reason")).alias("blockers")).withColumn("status", F.when(F.size("blockers") == 0, "READY").otherwise("BLOCKED"))


def merged_chunks(images: DataFrame, chunk: str, rejected: Column, label: str, order: str) -> DataFrame:
    """Per chunk the labels of its images in order, ids prefixed by the image; NOT_APPLICABLE if any image was rejected."""
    g = images.groupBy(chunk).agg(F.bool_or(rejected).alias("_r"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(label).alias("l")))).alias("_l"))
    merged = F.array_join(F.transform("_l", lambda x, i: F.concat(F.lit("i"), (i + 1).cast("string"), F.lit(":"), x.l)), " ")
    return g.select(chunk, F.when(F.col("_r"), "NOT_APPLICABLE").otherwise("COMPLETE").alias("status"), F.when(~F.col("_r"), merged).alias("merged"))


def answers_against(answers: DataFrame, packages: DataFrame) -> DataFrame:
    """Reasons against answers (item_id, condition, package_sha256): no such package, another digest, twice."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("item_id", "condition")) > 1
    p = packages.select("item_id", "condition", F.col("package_sha256").alias("_sha"))
    rows = answers.withColumn("_twice", twice).join(p, ["item_id", "condition"], "left")
    reason = first_reason((F.col("_sha").isNull(), "no_package"), (F.col("_sha") != F.col("package_sha256"), "package_receipt"), (F.col("_twice"), "duplicate_identity"))
    return rows.select("item_id", "condition", reason.alias("reason"))


def run_verdict(answers: DataFrame, packages: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """One row: records, reasons found, missing identities of the selected conditions, PASS or FAIL."""
    bad = answers_against(answers, packages).agg(F.count(F.lit(1)).alias("records"), F.count("reason").alias("broken"), F.min("reason").alias("first_reason"))
    want = packages.filter(F.col("condition").isin(*conditions)).select("item_id", "condition")
    missing = want.join(answers.select("item_id", "condition"), ["item_id", "condition"], "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return bad.crossJoin(F.broadcast(missing)).withColumn("status", F.when((F.col("broken") == 0) & (F.col("missing") == 0), "PASS").otherwise("FAIL"))


def scored(answers: DataFrame, key: str, abstain: Column, index: Column, right: Column) -> list[Column]:
    """correct: not abstained and the right index; agrees: same index and abstention in both replicates (rows of one key)."""
    correct = F.coalesce(~abstain & (index == right), F.lit(False))
    same = (F.count_distinct(F.struct(abstain.alias("a"), F.coalesce(index, F.lit(-1)).alias("i"))).alias("_kinds")) == 1
    return [F.bool_and(correct).alias("correct"), same.alias("agrees")]


def routed(children: DataFrame, parents: DataFrame, parent: str, key: str) -> DataFrame:
    """Each child with what its parent's status sends it to: RUN after COMPLETE, NOT_APPLICABLE after another end, WAIT without one."""
    p = parents.select(F.col(key).alias(parent), F.col("status").alias("_s"))
    state = F.when(F.col("_s").isNull(), "WAIT").when(F.col("_s") == "COMPLETE", "RUN").otherwise("NOT_APPLICABLE")
    return children.join(p, parent, "left").withColumn("state", state).drop("_s")


def differing(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Per key that both have, the fields that differ (nulls equal nulls)."""
    r = right.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return left.select(key, *fields).join(r, key).select(key, F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f) for f in fields])).alias("differs"))


def matches(files: DataFrame, path: str, text: str, rules: DataFrame) -> DataFrame:
    """path and rule of the texts in which a rule's pattern is found. rules (rule, pattern) are a small table; every text meets every rule once."""
    return files.select(path, text).crossJoin(F.broadcast(rules)).filter(F.expr(f"`{text}` RLIKE pattern")).select(path, "rule")
