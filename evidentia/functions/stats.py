"""Exact small-sample statistics as column expressions over aggregated counts, and pandas UDFs where sums need care.

All of these run on one row per group, after the group-by; counts are integers and divided once.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _binomial_sum(n: str, lo: str, hi: str, p: str) -> str:
    """Sum of C(n, i) p^i (1 - p)^(n - i) for i from lo to hi, as SQL: terms follow from their neighbours in logarithms, so one pass does without any array of n.

    Lambda variables have names that no count's column should have, since they would hide it.
    """
    ln_q, ln_p = f"ln(1 - {p})", f"ln({p})"
    start = f"aggregate(sequence(1, {lo}), {n} * {ln_q}, (s__, i__) -> s__ + ln({n} - i__ + 1) - ln(i__) + {ln_p} - {ln_q})"
    first = f"CASE WHEN {lo} = 0 THEN {n} * {ln_q} ELSE {start} END"
    step = f"named_struct('l', a__.l + ln(greatest({n} - i__, 1)) - ln(i__ + 1) + {ln_p} - {ln_q}, 's', a__.s + exp(a__.l))"
    return f"CASE WHEN {lo} > {hi} THEN 0.0D ELSE aggregate(sequence({lo}, {hi}), named_struct('l', cast({first} as double), 's', 0.0D), (a__, i__) -> {step}, a__ -> a__.s) END"


def binomial_two_sided(b: str, d: str) -> Column:
    """min(1, 2 * P(X >= max(b, d))) for X ~ Bin(b + d, 1/2); 1 when there are no discordant pairs."""
    return F.expr(f"CASE WHEN {b} + {d} = 0 THEN 1.0D ELSE least(1.0D, 2 * {_binomial_sum(f'({b} + {d})', '0L', f'least({b}, {d})', '0.5D')}) END")


def binomial_tails(n: str, k: str, p: str) -> Column:
    """pmf, cdf (P(X <= k)) and sf_ge (P(X >= k)) of Bin(n, p) for 0 < p < 1, each summed directly; 0 or 1 beyond the range."""
    inside = f"{k} BETWEEN 0 AND {n}"
    clamp = lambda x: f"least(1.0D, greatest(0.0D, {x}))"
    return F.expr(
        f"named_struct('pmf', CASE WHEN {inside} THEN {_binomial_sum(n, f'cast({k} as bigint)', f'cast({k} as bigint)', p)} ELSE 0.0D END, "
        f"'cdf', CASE WHEN {k} < 0 THEN 0.0D WHEN {k} >= {n} THEN 1.0D ELSE {clamp(_binomial_sum(n, '0L', f'cast({k} as bigint)', p))} END, "
        f"'sf_ge', CASE WHEN {k} <= 0 THEN 1.0D WHEN {k} > {n} THEN 0.0D ELSE {clamp(_binomial_sum(n, f'cast({k} as bigint)', f'cast({n} as bigint)', p))} END)"
    )


def mcnemar(left: str, right: str, alpha: float = 0.05) -> list[Column]:
    """Columns of an exact McNemar record from the two one-sided counts: a null result is never called equivalence."""
    p = binomial_two_sided(left, right)
    d = F.col(left) + F.col(right)
    need = least_discordance(alpha)
    return [d.alias("discordant"), p.alias("p_value"), (p <= alpha).alias("significant"), F.when(p <= alpha, "difference_detected").otherwise("inconclusive").alias("verdict"), F.lit(False).alias("equivalence_claimed"), F.lit(need).alias("discordance_required"), (d >= need).alias("discordance_target_met"), (d == 0).alias("no_discordance")]


def least_discordance(alpha: float = 0.05) -> int:
    """Fewest discordant pairs, all on one side, whose two-sided p can reach alpha."""
    if not 0 < alpha < 1:
        raise ValueError("BLOCKED:alpha")
    return next(d for d in range(1, 4097) if min(1.0, 2 * 0.5**d) <= alpha)


def least_discordance_of(alpha: Column) -> Column:
    """least_discordance of a column, from the binary logarithm and its neighbours, since powers of a half are exact; null if alpha is not between 0 and 1."""
    near = F.ceil(1 - F.log2(alpha)).cast("int")
    reach = lambda k: 2 * F.pow(F.lit(0.5), k) <= alpha
    fewest = F.when(reach(near - 1), near - 1).when(reach(near), near).otherwise(near + 1)
    return F.when((alpha > 0) & (alpha < 1), F.greatest(F.lit(1), fewest).cast("long"))


def fisher_two_sided(a: str, b: str, c: str, d: str) -> Column:
    """Sum of the hypergeometric probabilities of all tables with these margins that are at most (1 + 1e-9) times the observed one's.

    Log weights follow from their neighbours, relative to the observed table; their sums are kept relative
    to the largest so far. One pass over the tables, no array of the margins.
    """
    a, b, c, d = (f"cast({x} as bigint)" for x in (a, b, c, d))
    r1, r2, c1 = f"({a} + {b})", f"({c} + {d})", f"({a} + {c})"
    lo, hi = f"greatest(0L, {c1} - {r2})", f"least({r1}, {c1})"
    up = lambda x: f"ln(greatest({r1} - {x}, 1)) + ln(greatest({c1} - {x}, 1)) - ln({x} + 1) - ln({r2} - {c1} + {x} + 1)"
    first = f"CASE WHEN {a} > {lo} THEN -aggregate(sequence({lo}, {a} - 1), 0.0D, (s__, x__) -> s__ + {up('x__')}) ELSE 0.0D END"
    zero = f"named_struct('l', cast({first} as double), 'm', -1.0e308D, 'all', 0.0D, 'low', 0.0D)"
    top = "greatest(t__.m, t__.l)"
    step = f"named_struct('l', t__.l + {up('x__')}, 'm', {top}, 'all', t__.all * exp(t__.m - {top}) + exp(t__.l - {top}), 'low', t__.low * exp(t__.m - {top}) + CASE WHEN t__.l <= ln(1 + 1e-9D) THEN exp(t__.l - {top}) ELSE 0.0D END)"
    return F.expr(f"CASE WHEN {r1} + {r2} = 0 THEN 1.0D ELSE least(1.0D, aggregate(sequence({lo}, {hi}), {zero}, (t__, x__) -> {step}, t__ -> t__.low / t__.all)) END")


def _tail_at_least(k: int, n: int, p: float) -> float:
    """P(X >= k) for X ~ Bin(n, p), by log-space terms."""
    if k <= 0:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p >= 1)
    lp, lq, top = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq) for i in range(k, n + 1)))


def clopper_pearson_interval(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact interval; [0, 0] for n = 0. Closed forms at k = 0 and k = n, bisection between."""
    if n == 0:
        return 0.0, 0.0

    def solve(goal: Callable[[float], bool]) -> float:
        lo, hi = 0.0, 1.0
        while hi - lo > 1e-15:
            mid = (lo + hi) / 2
            if mid in (lo, hi):
                break
            lo, hi = (mid, hi) if goal(mid) else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else (alpha / 2) ** (1 / n) if k == n else solve(lambda p: _tail_at_least(k, n, p) < alpha / 2)
    high = 1.0 if k == n else 1 - (alpha / 2) ** (1 / n) if k == 0 else solve(lambda p: 1 - _tail_at_least(k + 1, n, p) > alpha / 2)
    return min(low, k / n), max(high, k / n)


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clopper_pearson_interval(int(a), int(b)) for a, b in zip(k, n)], columns=["low", "high"])


def clopper_pearson_strict(k: int, n: int, alpha: float = 0.05) -> dict:
    """The release record: an empty denominator is an error, not an interval."""
    for name, x in (("n", n), ("successes", k)):
        if isinstance(x, bool) or not isinstance(x, int):
            raise ValueError(f"BLOCKED:{name}_not_int")
    if n <= 0:
        raise ValueError("BLOCKED:n_not_positive")
    if not 0 <= k <= n:
        raise ValueError(f"BLOCKED:successes_out_of_range:{k}/{n}")
    if not 0 < alpha < 1:
        raise ValueError("BLOCKED:alpha")
    low, high = clopper_pearson_interval(k, n, alpha)
    return {"method": "clopper_pearson_exact", "successes": k, "n": n, "point": k / n, "alpha": alpha, "conf_level": 1 - alpha, "lower": low, "upper": high, "interval": [low, high]}


def proportion_report(k: int, n: int, alpha: float = 0.05, label: str | None = None) -> dict:
    """clopper_pearson_strict() with a label."""
    if label is not None and not (isinstance(label, str) and label.strip()):
        raise ValueError("BLOCKED:label_invalid")
    return clopper_pearson_strict(k, n, alpha) | ({} if label is None else {"label": label})


def rounded_interval(ci: Column, n: Column) -> list[Column]:
    """low and high as census reports have them: four digits, 0 and 0 without any observation."""
    return [F.when(n == 0, F.lit(0.0)).otherwise(F.round(ci[x], 4)).alias(x) for x in ("low", "high")]


def quadratic_weight(i: Column, j: Column, categories: int) -> Column:
    """1 - (i - j)^2 / (k - 1)^2."""
    if categories < 2:
        raise ValueError("BLOCKED:n_categories_lt_2")
    return 1 - (i - j) * (i - j) / F.lit(float((categories - 1) ** 2))


def holm(df: DataFrame, p: str, alpha: float = 0.05, stop: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Holm step-down: rank, threshold alpha / (m - rank + 1), reject. With stop, nothing is rejected after the first that is not."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(F.col(p), *[F.col(c) for c in df.columns if c != p])))
    ranked = ranked.withColumn("threshold", F.lit(alpha) / (F.count(F.lit(1)).over(w) - F.col("rank") + 1))
    below = F.col(p) <= F.col("threshold")
    reject = F.min(below).over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) if stop else below
    return ranked.withColumn("reject", reject)


def cohen_kappa(both: Column, neither: Column, left: Column, right: Column) -> Column:
    """(po - pe) / (1 - pe) of a 2x2 table; null where 1 - pe is 0."""
    n = both + neither + left + right
    po = (both + neither) / n
    pe = ((both + left) / n) * ((both + right) / n) + ((neither + right) / n) * ((neither + left) / n)
    return F.when(F.abs(1 - pe) > 1e-12, (po - pe) / (1 - pe))


def weighted_kappa(df: DataFrame, a: str, b: str, least: int, most: int) -> DataFrame:
    """Quadratic-weighted kappa of integer ratings on a fixed scale, in one row: n, observed, expected, kappa (null if undefined).

    From the confusion counts alone: the weighted disagreement of the pairs, and that of the margins.
    """
    span = float((most - least) ** 2)
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    s = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))).alias("gap"),
        F.sum(F.col(a)).alias("sa"),
        F.sum(F.col(b)).alias("sb"),
        F.sum(F.col(a) * F.col(a)).alias("qa"),
        F.sum(F.col(b) * F.col(b)).alias("qb"),
    )
    observed = F.col("gap") / F.col("n") / span
    expected = (F.col("qa") * F.col("n") + F.col("qb") * F.col("n") - 2 * F.col("sa") * F.col("sb")) / (F.col("n") * F.col("n")) / span
    return s.select(F.col("n").cast("long").alias("n"), observed.alias("observed"), expected.alias("expected")).withColumn("kappa", F.when(F.abs(F.col("expected")) > 1e-12, 1 - F.col("observed") / F.col("expected")))


def census_kappa(df: DataFrame, a: str, b: str, least: int = 1, most: int = 5) -> DataFrame:
    """weighted_kappa() as census reports have it: 0.0 where it is undefined, four digits."""
    return weighted_kappa(df, a, b, least, most).select("n", F.round(F.coalesce("kappa", F.lit(0.0)), 4).alias("kappa"))


def kappa_claim(kappas: DataFrame, dimension: Column, threshold: float = 0.60, eligible: str = "answerability") -> DataFrame:
    """Whether a kappa supports a secondary claim: defined, at the threshold or above, and of the one eligible dimension; else exploratory."""
    if not -1 <= threshold <= 1:
        raise ValueError("BLOCKED:threshold_out_of_range")
    meets = F.coalesce(F.col("kappa") >= threshold, F.lit(False))
    claim = meets & (dimension == eligible)
    return kappas.select("*", F.col("kappa").isNotNull().alias("defined"), F.when(F.col("kappa").isNull(), "expected_agreement_is_one").alias("reason"), meets.alias("meets_threshold"), claim.alias("secondary_claim_eligible"), F.when(claim, "secondary_claim_eligible").otherwise("exploratory").alias("status"))


def paired_difference(df: DataFrame, control: Column, perturbed: Column, by: list[str]) -> DataFrame:
    """Mean of control - perturbed over complete pairs, with both rates."""
    pairs = df.withColumn("_c", control.cast("double")).withColumn("_p", perturbed.cast("double")).filter("_c IS NOT NULL AND _p IS NOT NULL")
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_c").alias("control_rate"), F.avg("_p").alias("perturbed_rate"), F.avg(F.col("_c") - F.col("_p")).alias("difference"))


#: Controls of either kind, least separation, most disagreement of replicates.
CONTROLS, SEPARATION, DISAGREEMENT = 5, 8, 0.10


def sensitivity(rows: DataFrame, family: str, positive: Column, correct: Column, agrees: Column) -> DataFrame:
    """Per family: correct controls of both kinds, separation, disagreement rate, and whether the floor is passed.

    Exactly CONTROLS controls of each kind are asked for; other numbers give the reason 'control_count'.
    """
    c = F.coalesce(correct, F.lit(False))
    g = rows.groupBy(family).agg(
        F.count_if(positive).alias("n_positive"), F.count_if(~positive).alias("n_negative"), F.count_if(positive & c).alias("positive_correct"), F.count_if(~positive & c).alias("negative_correct"), F.count_if(~F.coalesce(agrees, F.lit(False))).alias("disagreements")
    )
    g = g.withColumn("separation", F.col("positive_correct") + F.col("negative_correct")).withColumn("disagreement_rate", F.col("disagreements") / (F.col("n_positive") + F.col("n_negative")))
    ok = (F.col("separation") >= SEPARATION) & (F.col("disagreement_rate") <= DISAGREEMENT + 1e-12)
    counted = (F.col("n_positive") == CONTROLS) & (F.col("n_negative") == CONTROLS)
    return g.withColumn("reason", F.when(~counted, "control_count").when(F.col("separation") < SEPARATION, "separation_below_floor").when(~ok, "replicate_disagreement_exceeded")).withColumn("passed", counted & ok)


def sensitivity_floor(families: DataFrame, family: str, least: int = 2) -> DataFrame:
    """One row: every family must pass, and there must be `least` of them."""
    g = families.agg(F.count(F.lit(1)).alias("n_families"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col(family)))).alias("failed_families"))
    passed = (F.size("failed_families") == 0) & (F.col("n_families") >= least)
    return g.withColumn("passed", passed).withColumn("probe_status", F.when(passed, "sensitive").otherwise("insensitive"))


#: Draws of a bootstrap, and indices drawn at once.
RESAMPLES, DRAWN = 10_000, 1 << 22


def percentile(sorted_values: Sequence[float], q: float) -> float:
    """Type 7: linear interpolation."""
    at = q * (len(sorted_values) - 1)
    lo = math.floor(at)
    return sorted_values[lo] + (at - lo) * (sorted_values[min(lo + 1, len(sorted_values) - 1)] - sorted_values[lo])


def bootstrap(values: Sequence[float], statistic: Callable[[Sequence[float]], float], seed: int, resamples: int = RESAMPLES, alpha: float = 0.05) -> dict:
    """Seeded percentile bootstrap with Python's Mersenne twister."""
    rng, n = random.Random(seed), len(values)
    return _summary(n, statistic(values), [statistic([values[rng.randrange(n)] for _ in range(n)]) for _ in range(resamples)], alpha)


def _summary(n: int, point: float, draws: Sequence[float], alpha: float) -> dict:
    draws, resamples = sorted(draws), len(draws)
    mean = math.fsum(draws) / resamples
    spread = math.sqrt(math.fsum((x - mean) ** 2 for x in draws) / (resamples - 1)) if resamples > 1 else 0.0
    low, high = percentile(draws, alpha / 2), percentile(draws, 1 - alpha / 2)
    return {"n": n, "point": point, "mean": mean, "bias": mean - point, "se": spread, "low": low, "high": high, "excludes_zero": low > 0 or high < 0}


def randranges(seed: int, n: int, draws: int, size: int) -> Iterator[np.ndarray]:
    """The numbers that random.Random(seed).randrange(n) gives one after the other, as `draws` rows of `size`, in blocks of rows."""
    *key, at = random.Random(seed).getstate()[1]
    twister = np.random.MT19937()
    twister.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": at}}
    shift, spare = np.uint64(32 - n.bit_length()), np.zeros(0, np.int64)
    while draws:
        rows = min(draws, max(1, DRAWN // size))
        have, total = [spare], len(spare)
        while total < rows * size:
            x = twister.random_raw(rows * size - total + 64) >> shift
            have.append(x[x < n].astype(np.int64))
            total += len(have[-1])
        x = np.concatenate(have)
        yield x[: rows * size].reshape(rows, size)
        spare, draws = x[rows * size :], draws - rows


def bootstrap_mean(values: Sequence[float], seed: int, resamples: int = RESAMPLES, alpha: float = 0.05) -> dict:
    """bootstrap() of the mean by math.fsum; whole numbers are summed as integers, which is as exact."""
    n, v = len(values), np.array(values, np.float64)
    if np.all(np.isfinite(v)) and np.all(v == np.floor(v)) and np.abs(v).max() * n < 2**53:
        whole = v.astype(np.int64)
        sums = [float(x) for rows in randranges(seed, n, resamples, n) for x in whole[rows].sum(1).tolist()]
    else:
        sums = [math.fsum(row) for rows in randranges(seed, n, resamples, n) for row in map(np.ndarray.tolist, v[rows])]
    return _summary(n, math.fsum(values) / n, [x / n for x in sums], alpha)


def paired_bootstrap(df: DataFrame, key: str, unit: str, control: str, perturbed: str, seed: int = 0, resamples: int = RESAMPLES) -> DataFrame:
    """Per key, the bootstrap of mean(control - perturbed); units in order, so results do not depend on partitioning."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(unit)
        gaps = [float(a) - float(b) for a, b in zip(pdf[control], pdf[perturbed])]
        return pd.DataFrame([{key: pdf[key].iloc[0]} | bootstrap_mean(gaps, seed, resamples)])

    return df.select(key, unit, control, perturbed).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, n long, point double, mean double, bias double, se double, low double, high double, excludes_zero boolean")


def clustered_bootstrap(control: Sequence[float], perturbed: Sequence[float], clusters: Sequence[str], seed: int, resamples: int = RESAMPLES, alpha: float = 0.05) -> dict:
    """Percentile bootstrap of the mean difference that draws whole clusters, taken in the order in which they first appear."""
    gaps: dict[str, list[float]] = {}
    for label, a, b in zip(clusters, control, perturbed):
        gaps.setdefault(label, []).append(float(a) - float(b))
    if len(gaps) < 2:
        raise ValueError(f"BLOCKED:insufficient_clusters_for_bootstrap:{len(gaps)}")
    blocks, n = list(gaps.values()), len(gaps)
    draws = []
    for rows in randranges(seed, n, resamples, n):
        for row in rows.tolist():
            pooled = [x for i in row for x in blocks[i]]
            draws.append(math.fsum(pooled) / len(pooled))
    every = [x for own in blocks for x in own]
    return _summary(len(every), math.fsum(every) / len(every), draws, alpha) | {"n_clusters": n}


def clustered(df: DataFrame, key: str, cluster: str, unit: str, control: str, perturbed: str, seed: int = 0, resamples: int = RESAMPLES) -> DataFrame:
    """Per key, clustered_bootstrap() with units in order; keys with fewer than two clusters give nulls and a reason."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(unit)
        head = {key: pdf[key].iloc[0], "reason": None}
        try:
            return pd.DataFrame([head | clustered_bootstrap(pdf[control].tolist(), pdf[perturbed].tolist(), pdf[cluster].tolist(), seed, resamples)])
        except ValueError as e:
            return pd.DataFrame([head | {"reason": str(e), "n": len(pdf)}])

    return df.select(key, cluster, unit, control, perturbed).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, reason string, n long, point double, mean double, bias double, se double, low double, high double, excludes_zero boolean, n_clusters long")


def gated(estimates: DataFrame, floor: DataFrame, columns: list[str]) -> DataFrame:
    """Estimates with `columns` nulled and a reason where the one-row sensitivity floor failed: an insensitive probe must not leak an estimate."""
    ok = floor.select(F.col("passed").alias("_ok"))
    rows = estimates.crossJoin(F.broadcast(ok))
    return rows.select(*[F.when(F.col("_ok"), F.col(c)).alias(c) if c in columns else F.col(c) for c in estimates.columns], F.col("_ok").alias("reported"), F.when(~F.col("_ok"), "sensitivity_floor_failed").alias("suppressed_reason"))
