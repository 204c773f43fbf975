"""Reports over arms and units: contrasts against one arm, sign blocks, endpoints, adjudicated rates, grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def wide(df: DataFrame, unit: str, arm: str, value: str, arms: Sequence[str]) -> DataFrame:
    """A row per unit with a column per arm (null where the unit lacks it); one shuffle for all contrasts."""
    return df.groupBy(unit).agg(*[F.max(F.when(F.col(arm) == a, F.col(value))).alias(a) for a in arms])


def _contrasts(rows: DataFrame, pairs: Sequence[tuple[str, str]], cells: dict[str, tuple]) -> DataFrame:
    """For each pair the counts named in `cells` (conditions of left and right), a row per pair."""
    structs = []
    for left, right in pairs:
        x, y = F.col(left), F.col(right)
        structs.append(F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"), *[F.count_if(F.coalesce(f(x, y), F.lit(False))).alias(k) for k, f in cells.items()]))
    return rows.agg(F.array(*structs).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def contrasts(df: DataFrame, unit: str, arm: str, value: str, pairs: Sequence[tuple[str, str]], missing: bool | None = None) -> DataFrame:
    """b and c of a boolean value for each pair of arms, with the exact p; units that lack a side are left out, or count as `missing`."""
    arms = sorted({a for p in pairs for a in p})
    rows = wide(df, unit, arm, value, arms)
    if missing is not None:
        rows = rows.select(unit, *[F.coalesce(F.col(a), F.lit(missing)).alias(a) for a in arms])
    out = _contrasts(rows, pairs, {"b": lambda x, y: x & ~y, "c": lambda x, y: ~x & y})
    return out.withColumn("p_value", F.round(stats.binomial_two_sided("b", "c"), 6))


def sign_blocks(df: DataFrame, unit: str, arm: str, value: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Higher, lower and tied units of a score for each pair of arms, with the exact sign test."""
    rows = wide(df, unit, arm, value, sorted({a for p in pairs for a in p}))
    out = _contrasts(rows, pairs, {"higher": lambda x, y: x > y, "lower": lambda x, y: x < y, "tied": lambda x, y: x == y})
    return out.withColumn("n", F.col("higher") + F.col("lower") + F.col("tied")).withColumn("p_value", F.round(stats.binomial_two_sided("higher", "lower"), 6))


def least_of(columns: Sequence[Column]) -> Column:
    """The least value; null if any is missing (least() alone would skip it)."""
    none = columns[0].isNull()
    for c in columns[1:]:
        none |= c.isNull()
    return F.when(~none, F.least(*columns))


def any_of(columns: Sequence[Column]) -> Column:
    """Whether any flag is set, a missing one counting as not set."""
    out = F.coalesce(columns[0], F.lit(False))
    for c in columns[1:]:
        out |= F.coalesce(c, F.lit(False))
    return out


def endpoint(df: DataFrame, passed: Column, needs: Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts of needed and answerable items among passed and failed ones, both rates, and Fisher's p."""
    c = lambda a, b: F.count_if(F.coalesce(a, F.lit(False)) & b)
    failed = ~F.coalesce(passed, F.lit(False))
    t = df.groupBy(*by).agg(c(passed, needs).alias("pass_needs"), c(passed, ~needs).alias("pass_answerable"), F.count_if(failed & needs).alias("fail_needs"), F.count_if(failed & ~needs).alias("fail_answerable"))
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 4)
    p = stats.fisher_two_sided("pass_needs", "pass_answerable", "fail_needs", "fail_answerable")
    return t.select("*", rate("pass_needs", "pass_answerable").alias("rate_pass"), rate("fail_needs", "fail_answerable").alias("rate_fail"), F.round(p, 6).alias("p_value"))


def metric(passed: Column, eligible: Column) -> list[Column]:
    """passed, eligible, rate and status; nothing eligible is not applicable, and has no rate."""
    return [passed.alias("passed"), eligible.alias("eligible"), F.try_divide(passed, eligible).alias("rate"), F.when(eligible == 0, "NOT_APPLICABLE").otherwise("EVALUATED").alias("status")]


def adjudicated(df: DataFrame, method: str, correct: Column, methods: Sequence[str]) -> DataFrame:
    """Per method, in the order given and with those that have no row: n, correct, incorrect, rate."""
    dim = df.sparkSession.createDataFrame(list(enumerate(methods)), f"ordinal int, {method} string")
    g = df.groupBy(method).agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("correct"))
    rows = F.broadcast(dim).join(g, method, "left").select("ordinal", method, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "correct")])
    return rows.select("ordinal", method, "n", "correct", (F.col("n") - F.col("correct")).alias("incorrect"), F.try_divide("correct", "n").alias("rate"))


def verdict(df: DataFrame, by: str, name: str, ok: Column, needed: int) -> DataFrame:
    """Per key: whether all of `needed` different gates are there and hold, and those that do not; a missing gate is never a pass."""
    held = F.coalesce(ok, F.lit(False))
    g = df.groupBy(by).agg(F.count_distinct(name).alias("n"), F.array_sort(F.collect_set(F.when(~held, F.col(name)))).alias("failed"))
    return g.select(by, "n", "failed", ((F.col("n") == needed) & (F.size("failed") == 0)).alias("passed"))


def shared_grid(df: DataFrame, grid: str, run: str, runs: int) -> DataFrame:
    """Each grid point with the number of runs that have it, and whether all have."""
    g = df.select(grid, run).distinct().groupBy(grid).agg(F.count(F.lit(1)).alias("n_runs"))
    return g.withColumn("shared", F.col("n_runs") == runs)


def largest_meeting(df: DataFrame, at: str, *conditions: Column) -> DataFrame:
    """One row: the largest point at which all conditions hold (null: none)."""
    both = conditions[0]
    for c in conditions[1:]:
        both &= c
    return df.agg(F.max(F.when(both, F.col(at))).alias(at))


def call_budget(base: Column, share: float, cap: int) -> list[Column]:
    """Reserve and total: a share of the base calls, rounded up, but within the cap; a base beyond the cap is a reason."""
    reserve = F.least(F.ceil(base * F.lit(share)), F.lit(cap) - base)
    return [reserve.cast("long").alias("reserve"), (base + reserve).cast("long").alias("total"), F.when(base > cap, "base_exceeds_cap").alias("reason")]


def blinded(df: DataFrame, item: str, salt: str) -> DataFrame:
    """Items in the order of a salted hash: ordinal from 1 and an opaque id, the first 20 hex digits.

    The global order is found from counts of hash prefixes: no task sees all rows.
    """
    h = F.sha2(F.concat_ws(":", F.lit("judge-order"), F.lit(salt), F.col(item).cast("string")), 256)
    return ordinal(df.withColumn("_h", h), ["_h", item], F.substring("_h", 1, 3)).withColumn("opaque_id", F.substring("_h", 1, 20)).drop("_h")


def ordinal(df: DataFrame, order: Sequence[str], part: Column) -> DataFrame:
    """`ordinal` from 1 in the order given. part: a value that rises with the order and deals the rows out; each part is numbered on its own and begins where the parts before it end."""
    rows = df.withColumn("_part", part)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # a row per part: a bounded number, since parts are few
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_own", own).join(before, "_part").withColumn("ordinal", (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def first_seen(df: DataFrame, key: str, at: str) -> DataFrame:
    """Keys in the order in which they first appear: key, first (least position), n."""
    return df.groupBy(key).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))


def first_offenders(df: DataFrame, key: str, bad: Column, by: Sequence[str] = (), most: int = 5) -> DataFrame:
    """The least `most` keys of bad rows, kept small while grouping."""
    rows = df.filter(bad).select(*by, key).distinct()
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(key)
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias("offenders"))


def same(got: Column, want: Column, slack: float = 1e-4) -> Column:
    """Floats within the slack, nulls equal to nulls."""
    return (got.isNull() & want.isNull()) | F.coalesce(F.abs(got - want) <= slack, F.lit(False))


def dig(tree: dict, path: str) -> object:
    """The value at a dotted path; the longest key that fits comes first, so keys may hold dots."""
    node, parts = tree, path.split(".")
    while parts:
        if not isinstance(node, dict):
            raise KeyError(path)
        span = next((n for n in range(len(parts), 0, -1) if ".".join(parts[:n]) in node), None)
        if span is None:
            raise KeyError(path)
        node, parts = node[".".join(parts[:span])], parts[span:]
    return node


def pairs_before(df: DataFrame, group: str, at: str, kept: Sequence[str], apart: Column) -> DataFrame:
    """Pairs (a, b) of rows of one group with a.at < b.at that meet `apart` (over a_* and b_* columns). Groups are short lists (lines of a page)."""
    a = df.select(F.col(group), *[F.col(c).alias(f"a_{c}") for c in (at, *kept)])
    b = df.select(F.col(group), *[F.col(c).alias(f"b_{c}") for c in (at, *kept)])
    return a.join(b, group).filter((F.col(f"a_{at}") < F.col(f"b_{at}")) & apart)
