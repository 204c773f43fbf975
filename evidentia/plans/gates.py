"""Queries of gates, compiler and scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import gates
from ._registry import query, t

_STOP = ", ".join(f"'{w}'" for w in sorted(set(text.STOP_WORDS)))


@query(rf"""
WITH c AS (SELECT conv_id, turn, text, turn % 4 AS slot FROM conversations WHERE turn < 4), s AS (SELECT conv_id, list(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS sents FROM conversations WHERE turn >= 4 GROUP BY conv_id),
x AS (SELECT c.conv_id, slot, list_filter(list_distinct(regexp_extract_all(lower(c.text), '[\p{{L}}\p{{N}}]+')), lambda w: w NOT IN ({_STOP})) AS own, sents FROM c JOIN s USING (conv_id)),
p AS (SELECT conv_id, slot, CASE WHEN len(own) = 0 THEN 0.0 ELSE coalesce(list_max(list_transform(sents, lambda z: len(list_intersect(own, z)))), 0) / len(own) END AS sup FROM x),
g AS (SELECT conv_id, list(sup ORDER BY slot) AS sups, conv_id % 5 AS idx FROM p GROUP BY conv_id)
SELECT conv_id, CASE WHEN idx >= len(sups) THEN 'bad_answer_index' WHEN len(list_filter(sups, lambda z: z >= sups[idx + 1] - 1e-9)) >= 2 THEN 'multi_correct' END AS reason, round(sups[1], 9) AS first_support FROM g
""")
def q_unique_gate(spark, d):
    c = t(spark, d, "conversations")
    s = c.filter("turn >= 4").select("conv_id", text.tokens(F.col("text")).alias("w")).groupBy("conv_id").agg(F.collect_list("w").alias("sents"))
    p = c.filter("turn < 4").join(s, "conv_id").select("conv_id", "turn", gates.support(F.col("text"), F.col("sents")).alias("sup"))
    g = p.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "sup"))), lambda x: x.sup).alias("sups"))
    return g.select("conv_id", gates.unique_gate(F.col("sups"), (F.col("conv_id") % 5).cast("int")).alias("reason"), F.round(F.col("sups")[0], 9).alias("first_support"))


@query("""
WITH g AS (SELECT user_id, max(value > 5) FILTER (event_type = 'click') AS cue, max(value > 60) FILTER (event_type = 'error') AS sup, max(value > 40) FILTER (event_type = 'purchase') AS uni, max(value > 20) FILTER (event_type = 'signup') AS con, max(value > 10) FILTER (event_type = 'view' AND event_id % 3 = 0) AS seal FROM events GROUP BY user_id)
SELECT user_id, list_filter([CASE WHEN NOT cue THEN 'G-CUE' END, CASE WHEN NOT sup THEN 'G-SUPPORT' END, CASE WHEN NOT uni THEN 'G-UNIQUE' END, CASE WHEN NOT con THEN 'CONTRACT' END, CASE WHEN NOT seal THEN 'SEAL' END], lambda x: x IS NOT NULL) AS failed,
CASE WHEN cue IS NULL THEN 'missing_confirmatory_gate:G-CUE' WHEN sup IS NULL THEN 'missing_confirmatory_gate:G-SUPPORT' WHEN uni IS NULL THEN 'missing_confirmatory_gate:G-UNIQUE' WHEN con IS NULL THEN 'missing_confirmatory_gate:CONTRACT' WHEN seal IS NULL THEN 'missing_confirmatory_gate:SEAL' END AS reason, coalesce(cue AND sup AND uni AND con AND seal, false) AS ok FROM g
""")
def q_gate_verdict(spark, d):
    name = F.expr("CASE event_type WHEN 'click' THEN 'G-CUE' WHEN 'error' THEN 'G-SUPPORT' WHEN 'purchase' THEN 'G-UNIQUE' WHEN 'signup' THEN 'CONTRACT' WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'SEAL' END END")
    least = F.expr("CASE event_type WHEN 'click' THEN 5 WHEN 'error' THEN 60 WHEN 'purchase' THEN 40 WHEN 'signup' THEN 20 ELSE 10 END")
    return gates.gate_verdict(t(spark, d, "events").select("user_id", name.alias("gate"), (F.col("value") > least).alias("ok")), "user_id")


_STEPS = """
SELECT event_id AS program, CASE WHEN event_id % 17 = 0 THEN 'unknown' WHEN event_id % 2 = 0 THEN 'condition_chain' ELSE 'figure_condition_apply' END AS motif, s.step,
CASE WHEN s.step < 2 THEN 'locate' WHEN event_id % 5 = 0 THEN 'sum' WHEN event_id % 2 = 0 THEN 'chain' ELSE 'apply' END AS op, CASE WHEN s.step = 0 AND event_id % 7 = 0 THEN '  ' WHEN s.step = 0 AND event_id % 3 = 0 THEN 'map' WHEN s.step < 2 THEN 'a quoted passage' END AS anchor,
CASE WHEN event_id % 11 = 0 AND s.step = 2 THEN NULL ELSE 'r' END AS result, CASE WHEN event_id % 2 = 1 AND s.step = 0 AND event_id % 13 <> 0 THEN 1 WHEN s.step = 1 AND event_id % 19 = 0 THEN 2 END AS visual_node
FROM events CROSS JOIN {grid} WHERE NOT (event_id % 23 = 0 AND s.step = 1)
"""


@query(f"""
WITH s AS ({_STEPS.format(grid="(VALUES (0), (1), (2)) AS s(step)")}), c AS (SELECT *, motif = 'figure_condition_apply' AS x, CASE WHEN step < 2 THEN 'locate' WHEN motif = 'condition_chain' THEN 'chain' ELSE 'apply' END AS want, length(trim(coalesce(anchor, ''))) AS size FROM s),
r AS (SELECT *, CASE WHEN motif = 'unknown' THEN 'step_not_in_catalog' WHEN op <> want THEN 'op_mismatch' WHEN step < 2 AND size < CASE WHEN x AND step = 0 THEN 1 ELSE 10 END THEN 'anchor_missing_or_too_short' WHEN result IS NULL THEN 'result_missing' WHEN x AND step = 0 AND visual_node IS NULL THEN 'visual_step_missing_visual_node' WHEN x AND step = 1 AND visual_node IS NOT NULL THEN 'text_step_must_not_bind_visual' END AS bad FROM c),
g AS (SELECT program, motif, count(*) AS n, arg_min('step' || step || '_' || bad, step) FILTER (bad IS NOT NULL) AS firstbad, count(*) FILTER (step < 2 AND motif <> 'unknown') AS n_anchors, count(*) FILTER (x AND step = 0) AS n_visual, count(*) FILTER (x AND step = 1) AS n_text FROM r GROUP BY ALL),
o AS (SELECT *, CASE WHEN motif = 'unknown' THEN 'motif_not_in_catalog' WHEN n <> 3 THEN 'step_count_mismatch' ELSE firstbad END AS reason FROM g)
SELECT program, motif, reason, n_anchors, n_visual, n_text, reason IS NULL AND motif = 'figure_condition_apply' AS closed_path FROM o
""")
def q_compile_programs(spark, d):
    steps = spark.sql(_STEPS.format(grid="(SELECT explode(array(0, 1, 2)) AS step) AS s").replace("FROM events", "FROM {rows} AS events"), rows=t(spark, d, "events"))
    return gates.compile_programs(steps, "program")


_NAMES = ", ".join(f"'{m}'" for m in [*gates.MOTIFS, "unknown"])


@query(f"""
WITH m(motif, op, cross_modal) AS (VALUES ('compare_two_entities', 'compare', false), ('condition_chain', 'chain', false), ('exception_detect', 'subtract', false), ('hierarchy_traverse', 'traverse', false), ('numeric_derive', 'compute', false), ('diagram_text_reconcile', 'reconcile', true), ('figure_condition_apply', 'apply', true)),
e AS (SELECT event_id, [{_NAMES}][(event_id % 8)::INTEGER + 1] AS motif FROM events)
SELECT event_id, motif, step::INTEGER AS step, CASE WHEN step < 2 THEN 'locate' ELSE op END AS op, step < 2 AS anchored, CASE WHEN step = 2 OR NOT cross_modal THEN 'any' WHEN step = 0 THEN 'visual' ELSE 'text' END AS modality, cross_modal FROM e JOIN m USING (motif), range(3) AS s(step)
""")
def q_motif_catalogue(spark, d):
    """The steps that the catalogue asks of each event's motif; a motif that it does not have has none."""
    e = t(spark, d, "events").select("event_id", F.expr(f"element_at(array({_NAMES}), cast(event_id % 8 as int) + 1)").alias("motif"))
    return e.join(F.broadcast(gates.catalogue(spark)), "motif")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 300 = 0 OR o_custkey % 4 = 0 THEN 40 ELSE greatest(1, least(40, floor(0.35::DOUBLE * (o_orderkey % 300) / (o_custkey % 4))::INTEGER)) END AS words FROM orders")
def q_excerpt_budget(spark, d):
    return t(spark, d, "orders").select("o_orderkey", gates.excerpt_budget(F.col("o_orderkey") % 300, F.col("o_custkey") % 4).alias("words"))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws, trim(text, E' \n\t\r\f\v') AS plain FROM documents) SELECT doc_id, CASE WHEN len(ws) <= 40 THEN plain ELSE array_to_string(ws[1:40], ' ') END AS excerpt FROM w
""")
def q_excerpts(spark, d):
    return t(spark, d, "documents").select("doc_id", gates.truncated(F.col("text"), F.lit(40)).alias("excerpt"))


@query(r"""
WITH t AS (SELECT doc_id, text, substr(text, 1, 200) AS a, substr(text, 201, 400) AS b FROM documents), n AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-zA-ZÀ-ỹ0-9]+')) AS total, len(regexp_extract_all(lower(a), '[a-zA-ZÀ-ỹ0-9]+')) AS x, len(regexp_extract_all(lower(b), '[a-zA-ZÀ-ỹ0-9]+')) AS y FROM t),
r AS (SELECT *, CASE WHEN total > 0 THEN (x + y) / total ELSE 1.0 END AS ratio FROM n) SELECT doc_id, round(ratio, 4) AS leak_ratio, list_filter([CASE WHEN ratio > 0.35 THEN 'excerpt_leak_ratio' END, CASE WHEN x > 40 OR y > 40 THEN 'excerpt_too_long' END], lambda z: z IS NOT NULL) AS problems FROM r
""")
def q_realizer_blindness(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "text")
    ratio, problems = gates.blindness(F.array(F.substring("text", 1, 200), F.substring("text", 201, 400)), F.col("text"))
    return rows.select("doc_id", ratio.alias("leak_ratio"), problems.alias("problems"))


@query()
def q_sentence_spans(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "text", text.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.posexplode(gates.spans(F.col("s"), F.col("text"))).alias("i", "span")).select("doc_id", "i", "span.*")


@query("""
WITH p AS (SELECT DISTINCT l_orderkey AS k, l_linenumber * 3 - (l_linenumber % 2) * 2 AS pos FROM lineitem), g AS (SELECT *, coalesce((pos - lag(pos) OVER (PARTITION BY k ORDER BY pos) - 1 > 2)::INTEGER, 0) AS fresh FROM p), r AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY pos) AS run FROM g)
SELECT k, min(pos) AS "first", max(pos) AS "last", count(*) AS n FROM r GROUP BY k, run
""")
def q_merged_islands(spark, d):
    p = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 3 - (F.col("l_linenumber") % 2) * 2).alias("at"))
    return gates.merged_islands(p, "k", "at")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'x 7 ''a''' WHEN 1 THEN 'H2O 0' WHEN 2 THEN '-1.5' WHEN 3 THEN 'a 100' WHEN 4 THEN '0.25 b' ELSE 'v1.0 12' END AS label FROM events")
def q_label_key(spark, d):
    raw = F.expr("CASE event_id % 6 WHEN 0 THEN '  x  007.00 ′a’ ' WHEN 1 THEN 'H₂O -0.0' WHEN 2 THEN '-1.50' WHEN 3 THEN 'a 100' WHEN 4 THEN '.250 b' ELSE 'v1.0 +12.' END")
    return t(spark, d, "events").select("event_id", gates.label_key(raw).alias("label"))


@query(r"SELECT event_id, left(CASE event_id % 3 WHEN 0 THEN 'Bearer [REDACTED] at ' || event_type WHEN 1 THEN 'key [REDACTED_KEY], [REDACTED]' ELSE repeat('y', 900) END, 800) AS text FROM events")
def q_redacted(spark, d):
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN concat('bearer  ab.cd-ef= at ', event_type) WHEN 1 THEN 'key sk-abcdef123, s3cret' ELSE repeat('y', 900) END")
    return t(spark, d, "events").select("event_id", gates.redacted(raw, "s3cret").alias("text"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'base_url_must_be_https_or_loopback_http' WHEN 2 THEN NULL WHEN 3 THEN 'base_url_credentials_forbidden' WHEN 4 THEN 'base_url_must_have_host' ELSE NULL END AS reason FROM events")
def q_base_url(spark, d):
    raw = F.expr("CASE event_id % 6 WHEN 0 THEN 'https://a.example/v1' WHEN 1 THEN 'http://a.example/v1' WHEN 2 THEN 'http://localhost:8000/v1' WHEN 3 THEN 'https://u:p@a.example/' WHEN 4 THEN 'nothing' ELSE 'http://127.0.0.1' END")
    return t(spark, d, "events").select("event_id", gates.url_reason(raw).alias("reason"))


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'TRANSPORT_ERROR' ELSE 'OK' END AS o, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 ELSE 600 END AS s FROM events) SELECT event_id, o = 'TRANSPORT_ERROR' AND (s IS NULL OR s = 429 OR s BETWEEN 500 AND 599) AS again FROM e")
def q_retryable(spark, d):
    o = F.when(F.col("event_id") % 2 == 0, "TRANSPORT_ERROR").otherwise("OK")
    s = F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 ELSE 600 END")
    return t(spark, d, "events").select("event_id", gates.retryable(o, s).alias("again"))


@query("""
WITH RECURSIVE s AS (SELECT event_id AS id, event_id % 9 + 1 AS n, event_id AS x, range(0, event_id % 9 + 1) AS a, event_id % 9 AS i FROM events WHERE event_id < 500
UNION ALL SELECT id, n, y, list_transform(range(0, n), lambda k: CASE WHEN k = i THEN a[y % (i + 1) + 1] WHEN k = y % (i + 1) THEN a[i + 1] ELSE a[k + 1] END), i - 1 FROM (SELECT *, (1664525 * x + 1013904223) % 4294967296 AS y FROM s WHERE i > 0))
SELECT id, list_transform(a, lambda v: v::INTEGER) AS a FROM s WHERE i = 0
""")
def q_durstenfeld(spark, d):
    return t(spark, d, "events").filter("event_id < 500").select(F.col("event_id").alias("id"), gates.shuffled((F.col("event_id") % 9 + 1).cast("int"), F.col("event_id")).alias("a"))


_PIX = "SELECT user_id AS image, (event_id * 37 % 256)::INTEGER AS v FROM events"


@query(f"""
WITH p AS ({_PIX}), h AS (SELECT image, v, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS w0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY image) AS w, sum(n * v) OVER (PARTITION BY image) AS s FROM h WINDOW w AS (PARTITION BY image ORDER BY v)),
b AS (SELECT image, v, CASE WHEN w > w0 THEN w0 * (w - w0) * ((s0 / w0) - (s - s0) / (w - w0)) * ((s0 / w0) - (s - s0) / (w - w0)) ELSE 0 END AS var FROM c) SELECT image, arg_min(v, (-round(var, 6), v)) AS threshold FROM b GROUP BY image
""")
def q_otsu(spark, d):
    return gates.otsu(t(spark, d, "events").select(F.col("user_id").alias("image"), (F.col("event_id") * 37 % 256).cast("int").alias("v")), "image", "v")


@query("WITH b AS (SELECT user_id AS image, event_id % 16 AS v, 1 AS d FROM events WHERE event_type <> 'view' UNION ALL SELECT user_id, event_id % 15, -1 FROM events WHERE event_type <> 'click') SELECT image, sum(gap)::BIGINT AS l1 FROM (SELECT image, v, abs(sum(d)) AS gap FROM b GROUP BY ALL) GROUP BY image")
def q_histogram_gap(spark, d):
    e = t(spark, d, "events").withColumnRenamed("user_id", "image")
    side = lambda kind, m: e.filter(F.col("event_type") != kind).select("image", (F.col("event_id") % m).alias("v"))
    return gates.histogram_gap(side("view", 16), side("click", 15), "image", "v")


_BOX = "SELECT p_partkey, (p_partkey % 70) / 100.0 AS x0, (p_size % 50) / 100.0 AS y0, (p_partkey % 70) / 100.0 + 0.01 + (p_size % 25) / 100.0 AS x1, (p_size % 50) / 100.0 + 0.3 AS y1 FROM part"


def _boxes(spark, d):
    x0, y0 = (F.col("p_partkey") % 70) / F.lit(100.0), (F.col("p_size") % 50) / F.lit(100.0)
    return t(spark, d, "part").select("p_partkey", F.array(x0, y0, x0 + 0.01 + (F.col("p_size") % 25) / F.lit(100.0), y0 + 0.3).alias("b"))


@query(f"""
WITH b AS ({_BOX}), r AS (SELECT p_partkey, greatest(0.0, x0 - (x1 - x0) * 0.1) AS a, greatest(0.0, y0 - (y1 - y0) * 0.1) AS b, least(1.0, x1 + (x1 - x0) * 0.1) AS c, least(1.0, y1 + (y1 - y0) * 0.1) AS d FROM b)
SELECT p_partkey, round(a, 9) AS x0, round(b, 9) AS y0, round(c, 9) AS x1, round(d, 9) AS y1, round(a + 0.5 * (c - a), 9) AS centre, c - a > 0.2951 AS wide FROM r
""")
def q_padded_roi(spark, d):
    roi = _boxes(spark, d).withColumn("r", gates.padded_roi(F.col("b")))
    half = gates.to_global(F.array(F.lit(0.5), F.lit(0.0), F.lit(1.0), F.lit(1.0)), F.col("r"))
    return roi.select("p_partkey", *[F.round(F.col("r")[i], 9).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.round(half[0], 9).alias("centre"), (F.col("r")[2] - F.col("r")[0] > 0.2951).alias("wide"))


@query(f"""
WITH b AS ({_BOX}), o AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'too short' ELSE 'four words stand here' END AS obs FROM b)
SELECT p_partkey, CASE WHEN (x1 - x0) * (y1 - y0) >= 0.8 THEN 'whole_page' WHEN (x1 - x0) * (y1 - y0) < 0.0004 THEN 'too_small' WHEN p_partkey % 3 = 0 THEN 'observation_short' END AS reason FROM o
""")
def q_box_reason(spark, d):
    obs = F.when(F.col("p_partkey") % 3 == 0, "too short").otherwise("four words stand here")
    return _boxes(spark, d).select("p_partkey", geometry.box_reason(F.col("b"), obs).alias("reason"))


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS key FROM orders""")
def q_idempotency_key(spark, d):
    from ..functions import integrity

    return t(spark, d, "orders").select("o_orderkey", integrity.row_digest("o_orderkey", "o_custkey", "o_orderstatus").alias("key"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0312 WHEN 1 THEN 0.1235 WHEN 2 THEN 1.0001 ELSE 2.5 END::DOUBLE AS r FROM events")
def q_half_even(spark, d):
    x = F.expr("CASE event_id % 4 WHEN 0 THEN 0.03125D WHEN 1 THEN 0.12345D WHEN 2 THEN 1.00005D ELSE 2.5D END")
    return t(spark, d, "events").select("event_id", text.python_round(x, 4).alias("r"))
