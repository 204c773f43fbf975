"""Queries of the census reports: arms are event types, units are users, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import census, relational
from ._registry import clopper_sql, good, query, t, toxic

ARMS = ["click", "error", "purchase", "signup", "view"]
BASE = "purchase"
OTHERS = [(BASE, a) for a in ARMS if a != BASE]

_CELL = "a AS (SELECT user_id, event_type AS arm, max(value) > 60 AS ok, max(value)::INTEGER % 5 AS score FROM events GROUP BY ALL)"
_PAIR = "p AS (SELECT l.arm AS \"left\", r.arm AS \"right\", l.user_id, l.ok AS x, r.ok AS y, l.score AS u, r.score AS v FROM a l JOIN a r USING (user_id) WHERE l.arm = 'purchase' AND r.arm <> 'purchase')"
_P2 = "CASE WHEN {b} + {c} = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(greatest({b}, {c}), {b} + {c} + 1), lambda i: exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) - ({b} + {c}) * ln(2.0))))), 6) END"


def _cells(spark, d):
    return t(spark, d, "events").groupBy("user_id", F.col("event_type").alias("arm")).agg((F.max("value") > 60).alias("ok"), (F.bround(F.max("value")).cast("int") % 5).alias("score"))


@query(f"""
WITH {_CELL}, {_PAIR}, c AS (SELECT "left", "right", count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c FROM p GROUP BY ALL), q AS (SELECT *, {_P2.format(b='b', c='c')} AS p_value FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY p_value, "left", "right", b, c)::INTEGER AS rank FROM q), h AS (SELECT *, 0.05 / (count(*) OVER () - rank + 1) AS threshold FROM r)
SELECT *, bool_and(p_value <= threshold) OVER (ORDER BY rank) AS reject FROM h
""")
def q_confirmatory_family(spark, d):
    return stats.holm(census.contrasts(_cells(spark, d), "user_id", "arm", "ok", OTHERS), "p_value")


@query(f"""
WITH {_CELL}, u AS (SELECT DISTINCT user_id FROM a), w AS (SELECT "left", "right", coalesce(x.ok, false) AS x, coalesce(y.ok, false) AS y FROM u CROSS JOIN (VALUES ('purchase', 'view'), ('purchase', 'click')) AS g("left", "right")
LEFT JOIN a x ON x.user_id = u.user_id AND x.arm = g."left" LEFT JOIN a y ON y.user_id = u.user_id AND y.arm = g."right"), c AS (SELECT "left", "right", count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c FROM w GROUP BY ALL)
SELECT *, {_P2.format(b='b', c='c')} AS p_value FROM c
""")
def q_hard_valid_contrasts(spark, d):
    return census.contrasts(_cells(spark, d), "user_id", "arm", "ok", [("purchase", "view"), ("purchase", "click")], missing=False)


@query(f"""
WITH {_CELL}, {_PAIR}, c AS (SELECT "left", "right", count(*) FILTER (u > v) AS higher, count(*) FILTER (u < v) AS lower, count(*) FILTER (u = v) AS tied FROM p GROUP BY ALL)
SELECT *, higher + lower + tied AS n, {_P2.format(b='higher', c='lower')} AS p_value FROM c
""")
def q_sign_blocks(spark, d):
    return census.sign_blocks(_cells(spark, d), "user_id", "arm", "score", OTHERS)


@query(f"WITH {_CELL}, r AS (SELECT arm, round(count(*) FILTER (ok) / count(*), 4) AS rate FROM a GROUP BY arm) SELECT min(rate) AS least, max(rate) AS most, count(*) AS n_arms FROM r")
def q_spread(spark, d):
    r = _cells(spark, d).groupBy("arm").agg(F.round(F.count_if("ok") / F.count(F.lit(1)), 4).alias("rate"))
    return r.agg(F.min("rate").alias("least"), F.max("rate").alias("most"), F.count(F.lit(1)).alias("n_arms"))


@query(clopper_sql(f"WITH {_CELL} SELECT arm, count(*) FILTER (ok) AS k, count(*) AS n FROM a GROUP BY arm", "arm", 4, ", round(k / n, 4) AS rate"))
def q_admission_with_interval(spark, d):
    c = _cells(spark, d).groupBy("arm").agg(F.count_if("ok").alias("k"), F.count(F.lit(1)).alias("n")).withColumn("ci", stats.clopper_pearson("k", "n"))
    return c.select("arm", "k", "n", *stats.rounded_interval(F.col("ci"), F.col("n")), F.round(F.col("k") / F.col("n"), 4).alias("rate"))


@query(clopper_sql("SELECT coalesce(lang, 'all') AS lang, count(*) FILTER (toxic = 1) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)", "lang", 9, ", k / n AS rate"))
def q_prevalence_interval(spark, d):
    rows = _labelled(spark, d).rollup("lang").agg(F.count_if(toxic()).alias("k"), F.count(F.lit(1)).alias("n")).withColumn("ci", stats.clopper_pearson("k", "n"))
    return rows.select(F.coalesce("lang", F.lit("all")).alias("lang"), "k", "n", F.round("ci.low", 9).alias("low"), F.round("ci.high", 9).alias("high"), (F.col("k") / F.col("n")).alias("rate"))


def _labelled(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


_ENDPOINT = """
m AS (SELECT {by} count(*) FILTER (coalesce({p}, false) AND {n}) AS pass_needs, count(*) FILTER (coalesce({p}, false) AND NOT ({n})) AS pass_answerable, count(*) FILTER (NOT coalesce({p}, false) AND {n}) AS fail_needs, count(*) FILTER (NOT coalesce({p}, false) AND NOT ({n})) AS fail_answerable FROM {t} {group}),
e AS (SELECT *, pass_needs + pass_answerable AS r1, fail_needs + fail_answerable AS r2, pass_needs + fail_needs AS c1 FROM m),
x AS (SELECT *, list_transform(range(greatest(0, c1 - r2), least(r1, c1) + 1), lambda k: exp(lgamma(r1 + 1) + lgamma(r2 + 1) + lgamma(c1 + 1) + lgamma(r1 + r2 - c1 + 1) - lgamma(r1 + r2 + 1) - lgamma(k + 1) - lgamma(r1 - k + 1) - lgamma(c1 - k + 1) - lgamma(r2 - c1 + k + 1))) AS q FROM e),
f AS (SELECT {by} pass_needs, pass_answerable, fail_needs, fail_answerable, round(pass_needs / nullif(r1, 0), 4) AS rate_pass, round(fail_needs / nullif(r2, 0), 4) AS rate_fail,
 round(least(1.0, list_sum(list_filter(q, lambda z: z <= q[pass_needs - greatest(0, c1 - r2) + 1] * (1 + 1e-9)))), 6) AS p_value FROM x)
"""


@query("WITH r AS (SELECT *, n_chars % 3 = 0 AS needs FROM labels JOIN documents USING (doc_id) WHERE doc_id % 10 <> 0), " + _ENDPOINT.format(by="", p="quality = 1", n="needs", t="r", group="") + "SELECT * FROM f")
def q_containment_endpoint(spark, d):
    kept = relational.excluded(_labelled(spark, d), "doc_id", _labelled(spark, d).filter("doc_id % 10 = 0"))
    return census.endpoint(kept, good(), F.col("n_chars") % 3 == 0)


@query("WITH g AS (SELECT unnest([500, 1000, 2000]) AS threshold), r AS (SELECT g.threshold, quality, n_chars >= g.threshold AS needs FROM labels JOIN documents USING (doc_id), g), " + _ENDPOINT.format(by="threshold,", p="quality = 1", n="needs", t="r", group="GROUP BY threshold") + "SELECT * FROM f")
def q_threshold_endpoints(spark, d):
    rows = _labelled(spark, d).withColumn("threshold", F.explode(F.array(F.lit(500), F.lit(1000), F.lit(2000))))
    return census.endpoint(rows, good(), F.col("n_chars") >= F.col("threshold"), ["threshold"])


@query("""
WITH r AS (SELECT DISTINCT lang AS run, (n_chars // 2000)::BIGINT AS point FROM documents), g AS (SELECT point, count(*) AS n_runs FROM r GROUP BY point) SELECT point, n_runs, n_runs = 4 AS shared FROM g
""")
def q_shared_grid(spark, d):
    rows = t(spark, d, "documents").select(F.col("lang").alias("run"), F.expr("n_chars div 2000").alias("point"))
    return census.shared_grid(rows, "point", "run", 4)


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS left_correct, count(*) FILTER (toxic = 1) AS right_correct FROM labels JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars >= 300 AND n_chars <= 10000")
def q_choice_subset(spark, d):
    rows = _labelled(spark, d).filter("lang = 'en' AND n_chars >= 300 AND n_chars <= 10000")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(good()).alias("left_correct"), F.count_if(toxic()).alias("right_correct"))


_FLAG = "r AS (SELECT lang, quality, toxic, n_chars % 4 = 0 AS flagged FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_FLAG} SELECT lang, count(*) AS admitted, count(*) FILTER (flagged) AS flagged, count(*) FILTER (flagged AND quality = 1) AS flagged_passed, count(*) FILTER (NOT flagged AND quality = 1) AS rest_passed FROM r GROUP BY lang")
def q_answer_in_question(spark, d):
    flag = F.col("n_chars") % 4 == 0
    return _labelled(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("admitted"), F.count_if(flag).alias("flagged"), F.count_if(flag & good()).alias("flagged_passed"), F.count_if(~flag & good()).alias("rest_passed"))


@query(f"WITH {_FLAG}, k AS (SELECT * FROM r WHERE NOT flagged), " + _ENDPOINT.format(by="", p="quality = 1", n="toxic = 0", t="k", group="") + "SELECT *, rate_pass > rate_fail AS direction_preserved, p_value <= 0.05 AS still_significant FROM f")
def q_leave_out_endpoint(spark, d):
    out = census.endpoint(_labelled(spark, d).filter("n_chars % 4 <> 0"), good(), F.col("toxic") == 0)
    return out.withColumn("direction_preserved", F.col("rate_pass") > F.col("rate_fail")).withColumn("still_significant", F.col("p_value") <= 0.05)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN least(o_custkey % 5, o_orderkey % 5) END AS least_score, o_totalprice > 200000 OR (o_custkey % 7 <> 0 AND o_custkey % 3 = 0) AS violation FROM orders")
def q_least_over_raters(spark, d):
    a = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 5)
    v = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 3 == 0)
    return t(spark, d, "orders").select("o_orderkey", census.least_of([a, F.col("o_orderkey") % 5]).alias("least_score"), census.any_of([F.col("o_totalprice") > 200000, v]).alias("violation"))


@query("SELECT left(text, 70) AS reason, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1")
def q_failure_reasons(spark, d):
    return t(spark, d, "conversations").filter("role = 'user'").groupBy(F.left(F.col("text"), F.lit(70)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_type AS arm, d.dim, round(sum(CASE d.dim WHEN 'value' THEN coalesce(CASE WHEN value > 5 THEN value END, 0) ELSE user_id END) / count(*), 3) AS mean FROM events, (VALUES ('value'), ('user')) AS d(dim) GROUP BY ALL
""")
def q_judge_means(spark, d):
    rows = t(spark, d, "events").select(F.col("event_type").alias("arm"), F.explode(F.array(F.struct(F.lit("value").alias("dim"), F.when(F.col("value") > 5, F.col("value")).alias("x")), F.struct(F.lit("user").alias("dim"), F.col("user_id").cast("double").alias("x")))).alias("s")).select("arm", "s.*")
    return rows.groupBy("arm", "dim").agg(F.round(F.avg(F.coalesce("x", F.lit(0.0))), 3).alias("mean"))


@query("""
WITH m(ordinal, lang) AS (VALUES (0, 'en'), (1, 'de'), (2, 'none'), (3, 'fr')), g AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS correct FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT ordinal, m.lang, coalesce(n, 0) AS n, coalesce(correct, 0) AS correct, coalesce(n, 0) - coalesce(correct, 0) AS incorrect, correct / n AS rate FROM m LEFT JOIN g USING (lang)
""")
def q_adjudicated_rates(spark, d):
    return census.adjudicated(_labelled(spark, d), "lang", good(), ["en", "de", "none", "fr"])


@query("WITH g AS (SELECT source, count(*) FILTER (toxic = 1) AS eligible, count(*) FILTER (toxic = 1 AND quality = 1) AS passed FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT source, passed, eligible, passed / nullif(eligible, 0) AS rate, CASE WHEN eligible = 0 THEN 'NOT_APPLICABLE' ELSE 'EVALUATED' END AS status FROM g")
def q_metric_status(spark, d):
    g = _labelled(spark, d).groupBy("source").agg(F.count_if(toxic()).alias("e"), F.count_if(toxic() & good()).alias("p"))
    return g.select("source", *census.metric(F.col("p"), F.col("e")))


@query("SELECT p_brand, count(*) AS n, count(DISTINCT p_name) AS n_names, count(DISTINCT p_name) = count(*) AS unique_names FROM part GROUP BY p_brand")
def q_motif_totals(spark, d):
    g = t(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_name").alias("n_names"))
    return g.withColumn("unique_names", F.col("n_names") == F.col("n"))


@query("WITH w(event_type, declared) AS (VALUES ('click', 2006::BIGINT), ('view', 1::BIGINT), ('gone', 3::BIGINT)), g AS (SELECT event_type, count(*) AS calls FROM events GROUP BY 1) SELECT coalesce(w.event_type, g.event_type) AS phase, coalesce(calls, 0) AS calls, declared, coalesce(calls, 0) IS NOT DISTINCT FROM declared AS ok FROM w FULL JOIN g USING (event_type)")
def q_phase_parity(spark, d):
    declared = spark.createDataFrame([("click", 2006), ("view", 1), ("gone", 3)], "phase string, declared long")
    g = t(spark, d, "events").groupBy(F.col("event_type").alias("phase")).agg(F.count(F.lit(1)).alias("calls"))
    out = g.join(F.broadcast(declared), "phase", "full_outer").withColumn("calls", F.coalesce("calls", F.lit(0)))
    return out.withColumn("ok", F.col("calls").eqNullSafe(F.col("declared")))


@query(f"WITH {_CELL} SELECT user_id, count(*) AS n, coalesce(list_sort(list(arm) FILTER (NOT ok)), []) AS failed, count(*) = 5 AND count(*) FILTER (NOT ok) = 0 AS passed FROM a GROUP BY user_id")
def q_conjunctive_verdict(spark, d):
    return census.verdict(_cells(spark, d), "user_id", "arm", F.col("ok"), 5)


@query("SELECT (SELECT count(*) FROM nation) AS n_nodes, (SELECT count(DISTINCT n_regionkey) FROM nation) AS n_levels, (SELECT max(n_regionkey) FROM nation) AS top_level, (SELECT count(*) FROM supplier) AS n_edges, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS n_kinds")
def q_graph_stats(spark, d):
    nodes = t(spark, d, "nation").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("n_regionkey").alias("n_levels"), F.max("n_regionkey").alias("top_level"))
    edges = t(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("s_nationkey").alias("n_kinds"))
    return nodes.crossJoin(F.broadcast(edges))


@query("WITH g AS (SELECT tau::DOUBLE AS tau, count(*) FILTER (value < tau) AS kept, count(*) FILTER (value >= tau AND event_type = 'error') AS caught FROM events, (VALUES (10), (20), (40), (80), (160)) AS v(tau) GROUP BY tau) SELECT max(tau) FILTER (kept >= 100 AND caught >= 50) AS tau FROM g")
def q_tau_recommendation(spark, d):
    grid = t(spark, d, "events").select("value", "event_type", F.explode(F.array(*[F.lit(float(x)) for x in (10, 20, 40, 80, 160)])).alias("tau"))
    g = grid.groupBy("tau").agg(F.count_if(F.col("value") < F.col("tau")).alias("kept"), F.count_if((F.col("value") >= F.col("tau")) & (F.col("event_type") == "error")).alias("caught"))
    return census.largest_meeting(g, "tau", F.col("kept") >= 100, F.col("caught") >= 50)


@query("WITH f AS (SELECT unnest(list_filter([CASE WHEN n_chars < 400 THEN 'short' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'poor' END], lambda x: x IS NOT NULL)) AS gate FROM labels JOIN documents USING (doc_id)) SELECT gate, count(*) AS n FROM f GROUP BY gate")
def q_gate_failures(spark, d):
    gates = F.array_compact(F.array(F.when(F.col("n_chars") < 400, "short"), F.when(toxic(), "toxic"), F.when(~good(), "poor")))
    return _labelled(spark, d).select(F.explode(gates).alias("gate")).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) AS n_rows, sum((event_type <> 'view')::BIGINT)::BIGINT AS calls FROM events GROUP BY user_id")
def q_plan_totals(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum((F.col("event_type") != "view").cast("long")).alias("calls"))


@query("WITH g AS (SELECT user_id, count(*) AS base FROM events GROUP BY user_id) SELECT user_id, base, least(ceil(base * 0.1), 70 - base)::BIGINT AS reserve, (base + least(ceil(base * 0.1), 70 - base))::BIGINT AS total, CASE WHEN base > 70 THEN 'base_exceeds_cap' END AS reason FROM g")
def q_call_budget(spark, d):
    g = t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("base"))
    return g.select("user_id", "base", *census.call_budget(F.col("base"), 0.1, 70))


@query("SELECT DISTINCT user_id FROM events WHERE event_type IN ('click', 'view')")
def q_arm_units(spark, d):
    e = t(spark, d, "events")
    return e.filter("event_type = 'click'").select("user_id").union(e.filter("event_type = 'view'").select("user_id")).distinct()


@query("SELECT user_id FROM events WHERE value > 300 UNION SELECT user_id FROM events WHERE event_type = 'error' AND value < 1")
def q_left_out_units(spark, d):
    e = t(spark, d, "events")
    return e.filter("value > 300").select("user_id").union(e.filter("event_type = 'error' AND value < 1").select("user_id")).distinct()


@query("SELECT conv_id, count(DISTINCT role) = 1 AS single_role, count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0 AS overlap FROM conversations GROUP BY conv_id")
def q_disjoint_sets(spark, d):
    has = lambda r: F.bool_or(F.col("role") == r)
    return t(spark, d, "conversations").groupBy("conv_id").agg((F.count_distinct("role") == 1).alias("single_role"), (has("user") & has("assistant")).alias("overlap"))


@query("WITH o AS (SELECT o_orderpriority AS method, o_custkey % 100 AS item, o_orderstatus AS attr FROM orders) SELECT item, count(DISTINCT method) AS methods, count(DISTINCT attr) AS attrs, count(DISTINCT method) = 5 AND count(DISTINCT attr) = 1 AS paired FROM o GROUP BY item")
def q_method_pairing(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), (F.col("o_custkey") % 100).alias("item"), F.col("o_orderstatus").alias("attr"))
    g = o.distinct().groupBy("item").agg(F.count_distinct("method").alias("methods"), F.count_distinct("attr").alias("attrs"))
    return g.withColumn("paired", (F.col("methods") == 5) & (F.col("attrs") == 1))


@query("SELECT event_id, user_id, 'event:' || user_id || '::' || event_type AS item, event_type AS arm, 'event:' || user_id AS unit FROM events WHERE event_id % 5 = 0")
def q_composite_key(spark, d):
    item = F.concat(F.lit("event:"), F.col("user_id").cast("string"), F.lit("::"), "event_type").alias("item")
    e = t(spark, d, "events").filter("event_id % 5 = 0").select("event_id", "user_id", item)
    return e.select("*", F.substring_index("item", "::", -1).alias("arm"), F.regexp_replace("item", "::[^:]*$", "").alias("unit"))


@query(f"""
WITH {_CELL}, r AS (SELECT user_id, score >= 3 AS rated FROM a WHERE arm = 'click'), m AS (SELECT user_id, ok AS measured FROM a WHERE arm = 'view'), j AS (SELECT rated, measured FROM r JOIN m USING (user_id)),
c AS (SELECT count(*) AS n, count(*) FILTER (rated AND measured) AS b, count(*) FILTER (NOT rated AND NOT measured) AS z, count(*) FILTER (rated AND NOT measured) AS x, count(*) FILTER (NOT rated AND measured) AS y FROM j),
k AS (SELECT *, (b + z) / n AS po, ((b + x) * (b + y) + (z + y) * (z + x)) / (n * n) AS pe FROM c)
SELECT n, b AS "both", z AS neither, x AS rated_only, y AS measured_only, round(po, 4) AS raw_agreement, round(CASE WHEN abs(1 - pe) > 1e-12 THEN (po - pe) / (1 - pe) END, 4) AS kappa FROM k
""")
def q_rated_vs_measured(spark, d):
    c = _cells(spark, d)
    r = c.filter("arm = 'click'").select("user_id", (F.col("score") >= 3).alias("rated"))
    j = r.join(c.filter("arm = 'view'").select("user_id", F.col("ok").alias("measured")), "user_id")
    k = relational.contingency(j, F.col("rated"), F.col("measured")).select("both", "neither", F.col("a_only").alias("rated_only"), F.col("b_only").alias("measured_only"))
    n = F.col("both") + F.col("neither") + F.col("rated_only") + F.col("measured_only")
    kappa = stats.cohen_kappa(F.col("both"), F.col("neither"), F.col("rated_only"), F.col("measured_only"))
    return k.select(n.alias("n"), "*", F.round((F.col("both") + F.col("neither")) / n, 4).alias("raw_agreement"), F.round(kappa, 4).alias("kappa"))


@query("SELECT user_id, coalesce(sum(value) FILTER (event_id % 4 <> 0), 0) AS known_cost, count(*) FILTER (event_id % 4 = 0) AS unknown FROM events GROUP BY user_id")
def q_known_cost(spark, d):
    cost = F.when(F.col("event_id") % 4 != 0, F.col("value"))
    return t(spark, d, "events").groupBy("user_id").agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("known_cost"), F.count_if(cost.isNull()).alias("unknown"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('judge-order:f1:' || doc_id), doc_id) AS ordinal, left(sha256('judge-order:f1:' || doc_id), 20) AS opaque_id FROM documents")
def q_blinded_order(spark, d):
    return census.blinded(t(spark, d, "documents").select("doc_id"), "doc_id", "f1")


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS ordinal FROM conversations")
def q_global_index(spark, d):
    return census.ordinal(t(spark, d, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], F.expr("conv_id div 16"))


@query('SELECT event_type, min(event_id) AS "first", count(*) AS n FROM events GROUP BY event_type')
def q_first_seen(spark, d):
    return census.first_seen(t(spark, d, "events"), "event_type", "event_id")


@query("SELECT event_type, list_sort(list(DISTINCT user_id))[1:5] AS offenders FROM events WHERE value > 100 GROUP BY event_type")
def q_first_offenders(spark, d):
    return census.first_offenders(t(spark, d, "events"), "user_id", F.col("value") > 100, ["event_type"])


@query("WITH g AS (SELECT lang, avg(n_chars) AS got, median(n_chars) AS want FROM documents GROUP BY lang) SELECT lang, abs(got - want) <= 300 AS same FROM g")
def q_tolerance_compare(spark, d):
    g = t(spark, d, "documents").groupBy("lang").agg(F.avg("n_chars").alias("got"), F.median("n_chars").alias("want"))
    return g.select("lang", census.same(F.col("got"), F.col("want"), 300).alias("same"))


@query("SELECT a.conv_id, a.turn AS a_turn, b.turn AS b_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn AND length(a.text) < length(b.text)")
def q_pair_enumeration(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", F.char_length("text").alias("size"))
    return census.pairs_before(c, "conv_id", "turn", ["size"], F.col("a_size") < F.col("b_size")).select("conv_id", "a_turn", "b_turn")
