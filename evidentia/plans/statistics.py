"""Queries of the exact statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals, stats
from ..operators import relational
from ._registry import clopper_sql, good, query, t, toxic

_PAIRS = "SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS l, count(*) FILTER (quality = 0 AND toxic = 1) AS r FROM labels JOIN documents USING (doc_id) GROUP BY lang"
_BIN = "list_sum(list_transform(range({lo}, {hi} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))"
_P = "CASE WHEN l + r = 0 THEN 1.0 ELSE least(1.0, 2 * " + _BIN.format(lo="0", hi="least(l, r)", n="(l + r)", p="0.5::DOUBLE") + ") END"


def _by_lang(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


def _sides(spark, d):
    return _by_lang(spark, d).groupBy("lang").agg(F.count_if(good() & ~toxic()).alias("l"), F.count_if(~good() & toxic()).alias("r"))


@query(f"""
WITH c AS ({_PAIRS}), p AS (SELECT *, {_P} AS p FROM c)
SELECT lang, l AS left_only, r AS right_only, l + r AS discordant, round(p, 9) AS p_value, p <= 0.05 AS significant, CASE WHEN p <= 0.05 THEN 'difference_detected' ELSE 'inconclusive' END AS verdict,
false AS equivalence_claimed, 6 AS discordance_required, l + r >= 6 AS discordance_target_met, l + r = 0 AS no_discordance FROM p
""")
def q_exact_mcnemar(spark, d):
    out = _sides(spark, d).select("lang", F.col("l").alias("left_only"), F.col("r").alias("right_only"), *stats.mcnemar("l", "r"))
    return out.withColumn("p_value", F.round("p_value", 9))


@query(f"""
WITH c AS ({_PAIRS}) SELECT lang, CASE WHEN l + r = 0 THEN 1.0 ELSE round(least(1.0, {_BIN.format(lo="0", hi="least(l, r)", n="(l + r)", p="0.5::DOUBLE")} * 2), 6) END AS p_value FROM c
""")
def q_mcnemar_round(spark, d):
    return _sides(spark, d).select("lang", F.round(stats.binomial_two_sided("l", "r"), 6).alias("p_value"))


@query(clopper_sql("SELECT source, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source UNION ALL SELECT 'none', 0, 0", "source", 4))
def q_clopper_census(spark, d):
    c = _by_lang(spark, d).groupBy("source").agg(F.count_if(good()).alias("k"), F.count(F.lit(1)).alias("n"))
    c = c.unionByName(spark.sql("SELECT 'none' AS source, 0L AS k, 0L AS n"))
    return c.withColumn("ci", intervals.clopper_pearson("k", "n")).select("source", "k", "n", *stats.rounded_interval(F.col("ci"), F.col("n")))


@query(clopper_sql("SELECT event_type, count(*) FILTER (value > 250) AS k, count(*) AS n FROM events GROUP BY event_type", "event_type", 6))
def q_clopper_large(spark, d):
    c = t(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 250).alias("k"), F.count(F.lit(1)).alias("n"))
    return c.withColumn("ci", intervals.clopper_pearson("k", "n")).select("event_type", "k", "n", F.round("ci.low", 6).alias("low"), F.round("ci.high", 6).alias("high"))


@query(f"""
WITH g AS (SELECT lang, source, avg(n_chars) FILTER (quality = 1) AS a, avg(n_chars) FILTER (quality = 0) AS b FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
c AS (SELECT lang, count(*) FILTER (a > b) AS l, count(*) FILTER (a < b) AS r, count(*) FILTER (a = b) AS tied FROM g GROUP BY lang)
SELECT lang, l AS higher, r AS lower, tied, round({_P}, 6) AS p_value FROM c
""")
def q_sign_test(spark, d):
    g = _by_lang(spark, d).groupBy("lang", "source").agg(F.avg(F.when(good(), F.col("n_chars"))).alias("a"), F.avg(F.when(~good(), F.col("n_chars"))).alias("b"))
    c = g.groupBy("lang").agg(F.count_if(F.col("a") > F.col("b")).alias("l"), F.count_if(F.col("a") < F.col("b")).alias("r"), F.count_if(F.col("a") == F.col("b")).alias("tied"))
    return c.select("lang", F.col("l").alias("higher"), F.col("r").alias("lower"), "tied", F.round(stats.binomial_two_sided("l", "r"), 6).alias("p_value"))


_KAPPA = """
r AS (SELECT {a} AS a, {b} AS b FROM labels JOIN documents USING (doc_id) {where}),
s AS (SELECT count(*) AS n, avg((a - b) * (a - b)) / 16 AS o, (sum(a * a) * count(*) + sum(b * b) * count(*) - 2 * sum(a) * sum(b)) / (count(*) * count(*)) / 16 AS e FROM r)
"""
_A, _B = "1 + quality * 3 + (n_chars % 2)::INTEGER", "5 - toxic * 3 - (n_chars % 2)::INTEGER"


def _rated(spark, d):
    odd = (F.col("n_chars") % 2).cast("int")
    return _by_lang(spark, d).select("lang", (1 + F.col("quality") * 3 + odd).alias("a"), (5 - F.col("toxic") * 3 - odd).alias("b"))


@query(f"WITH {_KAPPA.format(a=_A, b=_B, where='')} SELECT 'all' AS part, n, round(CASE WHEN abs(e) > 1e-12 THEN 1 - o / e ELSE 0.0 END, 4) AS kappa FROM s UNION ALL SELECT 'constant', count(*), 0.0 FROM labels")
def q_qwk_census(spark, d):
    constant = t(spark, d, "labels").select(F.lit(3).alias("a"), F.lit(3).alias("b"))
    parts = [stats.census_kappa(x, "a", "b").select(F.lit(n).alias("part"), "n", "kappa") for n, x in (("all", _rated(spark, d)), ("constant", constant))]
    return parts[0].union(parts[1])


@query(f"""
WITH {_KAPPA.format(a=_A, b=_B, where='')}, k AS (SELECT n, CASE WHEN abs(e) > 1e-12 THEN 1 - o / e END AS kappa FROM s)
SELECT dimension, n, round(kappa, 9) AS kappa, kappa IS NOT NULL AS defined, coalesce(kappa >= t, false) AS meets_threshold, coalesce(kappa >= t, false) AND dimension = 'answerability' AS secondary_claim_eligible,
CASE WHEN coalesce(kappa >= t, false) AND dimension = 'answerability' THEN 'secondary_claim_eligible' ELSE 'exploratory' END AS status FROM k, (VALUES ('answerability', -0.9), ('clarity', -0.9)) AS v(dimension, t)
""")
def q_judge_agreement(spark, d):
    k = stats.weighted_kappa(_rated(spark, d), "a", "b", 1, 5).crossJoin(spark.sql("SELECT explode(array('answerability', 'clarity')) AS dimension"))
    out = stats.kappa_claim(k, F.col("dimension"), threshold=-0.9)
    return out.select("dimension", "n", F.round("kappa", 9).alias("kappa"), "defined", "meets_threshold", "secondary_claim_eligible", "status")


@query("""
SELECT lang, count(*) AS n, round(avg(quality), 9) AS control_rate, round(avg(toxic), 9) AS perturbed_rate, round(avg(quality - toxic), 9) AS difference FROM labels JOIN documents USING (doc_id) GROUP BY lang
""")
def q_paired_difference(spark, d):
    out = stats.paired_difference(_by_lang(spark, d), F.col("quality"), F.col("toxic"), ["lang"])
    return out.select("lang", "n", *[F.round(c, 9).alias(c) for c in ("control_rate", "perturbed_rate", "difference")])


@query()
def q_clustered_bootstrap(spark, d):
    return stats.clustered(_by_lang(spark, d), "lang", "source", "doc_id", "quality", "toxic", seed=20260101, resamples=2000)


_CONTROLS = """
c AS (SELECT event_type AS family, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, value FROM events),
f AS (SELECT family, count(*) FILTER (k <= 5) AS n_positive, count(*) FILTER (k > 5) AS n_negative, count(*) FILTER (k <= 5 AND value > 12) AS positive_correct, count(*) FILTER (k > 5 AND value > 12) AS negative_correct, count(*) FILTER (NOT value < 150) AS disagreements FROM c WHERE k <= 10 GROUP BY family),
g AS (SELECT *, positive_correct + negative_correct AS separation, disagreements / (n_positive + n_negative) AS disagreement_rate FROM f),
h AS (SELECT *, CASE WHEN separation < 8 THEN 'separation_below_floor' WHEN disagreement_rate > 0.1 + 1e-12 THEN 'replicate_disagreement_exceeded' END AS reason FROM g)
"""


def _families(spark, d):
    rows = relational.first_rows(t(spark, d, "events").select(F.col("event_type").alias("family"), "event_id", "value"), "family", "event_id", 10)
    return stats.sensitivity(rows, "family", F.col("rank") <= 5, F.col("value") > 12, F.col("value") < 150)


@query(f"WITH {_CONTROLS} SELECT *, reason IS NULL AS passed FROM h")
def q_family_sensitivity(spark, d):
    return _families(spark, d)


@query(f"WITH {_CONTROLS} SELECT count(*) AS n_families, coalesce(list_sort(list(family) FILTER (reason IS NOT NULL)), []) AS failed_families, count(*) FILTER (reason IS NOT NULL) = 0 AND count(*) >= 2 AS passed, CASE WHEN count(*) FILTER (reason IS NOT NULL) = 0 AND count(*) >= 2 THEN 'sensitive' ELSE 'insensitive' END AS probe_status FROM h")
def q_sensitivity_floor(spark, d):
    return stats.sensitivity_floor(_families(spark, d), "family")


@query(f"""
WITH {_CONTROLS}, ok AS (SELECT count(*) FILTER (reason IS NOT NULL) = 0 AS ok FROM h), e AS (SELECT lang, count(*) AS n, avg(quality - toxic) AS difference FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, n, CASE WHEN ok THEN round(difference, 9) END AS difference, ok AS reported, CASE WHEN NOT ok THEN 'sensitivity_floor_failed' END AS suppressed_reason FROM e, ok
""")
def q_gated_interval(spark, d):
    e = stats.paired_difference(_by_lang(spark, d), F.col("quality"), F.col("toxic"), ["lang"]).select("lang", "n", F.round("difference", 9).alias("difference"))
    return stats.gated(e, stats.sensitivity_floor(_families(spark, d), "family"), ["difference"])


@query("""
WITH a AS (SELECT p_partkey, p_size::DOUBLE / 64 / (1 + p_partkey % 7)::DOUBLE AS alpha FROM part)
SELECT p_partkey, alpha, list_min(list_filter(range(1, 60), lambda k: 2 * pow(0.5::DOUBLE, k) <= alpha)) AS discordance FROM a
""")
def q_min_discordance(spark, d):
    """A level of each part: its size by 64, shared by up to seven."""
    a = t(spark, d, "part").select("p_partkey", (F.col("p_size").cast("double") / 64 / (1 + F.col("p_partkey") % 7)).alias("alpha"))
    return a.withColumn("discordance", stats.least_discordance_of(F.col("alpha")))


@query(f"""
WITH s AS (SELECT doc_id, quality, toxic FROM labels ORDER BY doc_id LIMIT 16), c AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS l, count(*) FILTER (quality = 0 AND toxic = 1) AS r FROM s)
SELECT n, CASE WHEN n <> 16 THEN 'n_pairs' END AS reason, l AS left_only, r AS right_only, round({_P}, 9) AS p_value FROM c
""")
def q_primary_contrast(spark, d):
    s = t(spark, d, "labels").orderBy("doc_id").limit(16)
    c = s.agg(F.count(F.lit(1)).alias("n"), F.count_if(good() & ~toxic()).alias("l"), F.count_if(~good() & toxic()).alias("r"))
    return c.select("n", F.when(F.col("n") != 16, "n_pairs").alias("reason"), F.col("l").alias("left_only"), F.col("r").alias("right_only"), F.round(stats.binomial_two_sided("l", "r"), 9).alias("p_value"))


@query(f"""
WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, n, k, round({_BIN.format(lo="k", hi="k", n="n", p="0.1::DOUBLE")}, 9) AS pmf, round({_BIN.format(lo="0", hi="k", n="n", p="0.1::DOUBLE")}, 9) AS cdf, round({_BIN.format(lo="k", hi="n", n="n", p="0.1::DOUBLE")}, 9) AS sf_ge FROM c
""")
def q_binomial_tails(spark, d):
    c = _by_lang(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(toxic()).alias("k")).withColumn("b", stats.binomial_tails("n", "k", "0.1D"))
    return c.select("lang", "n", "k", *[F.round(f"b.{x}", 9).alias(x) for x in ("pmf", "cdf", "sf_ge")])


@query(f"SELECT a, b, count(*) AS n, any_value(1 - (a - b) * (a - b) / 16.0)::DOUBLE AS weight, sum(count(*)) OVER (PARTITION BY a)::BIGINT AS of_a, sum(count(*)) OVER (PARTITION BY b)::BIGINT AS of_b FROM (SELECT {_A} AS a, {_B} AS b FROM labels JOIN documents USING (doc_id)) GROUP BY a, b")
def q_confusion(spark, d):
    return relational.confusion(_rated(spark, d), "a", "b").withColumn("weight", stats.quadratic_weight(F.col("a"), F.col("b"), 5))


@query("WITH s AS (SELECT lang, n_chars::DOUBLE AS v FROM documents) SELECT lang, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM s GROUP BY lang")
def q_percentile_type7(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.expr("percentile(n_chars, 0.025D)").alias("low"), F.expr("percentile(n_chars, 0.975D)").alias("high"))
