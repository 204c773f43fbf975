"""Queries of typed programs over documents as evidence: execution, guards, traces, seals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import overlap, programs
from ._registry import SQL, query, t

_LEGAL = "regexp_extract_all(lower({}), '[a-zA-ZÀ-ỹ0-9]+')"
_WHITE = r"E' \t\n\v\f\r '"
_PARTS = r"string_split(regexp_replace(text, '([.;:!?])[ \t\n\v\f\r]+|\n+', '\1' || chr(1), 'g'), chr(1))"

#: A program of each document, in SQL that both engines read; {0} and {2} are its first and third sentence.
_CROSS = "doc_id % 4 = 1 AND doc_id % 17 <> 0"
_FIELDS = {
    "motif": f"CASE WHEN doc_id % 17 = 0 THEN 'unknown' WHEN {_CROSS} THEN 'figure_condition_apply' ELSE 'condition_chain' END",
    "condition": f"CASE WHEN ({_CROSS}) AND doc_id % 10 <> 3 THEN 'TLV' WHEN doc_id % 31 = 0 THEN 'TLV' ELSE 'T' END",
    "n_images": "CASE WHEN doc_id % 9 = 0 THEN 0 ELSE 2 END",
    "op0": "CASE WHEN doc_id % 41 = 0 THEN NULL ELSE 'locate' END",
    "op1": "'locate'",
    "op2": f"CASE WHEN doc_id % 13 = 0 THEN 'sum' WHEN {_CROSS} THEN 'apply' ELSE 'chain' END",
    "anchor0": f"CASE WHEN {_CROSS} THEN ' map' WHEN doc_id % 29 = 0 THEN 'short' ELSE coalesce(substr({{0}}, 1, 60), 'no sentence here at all') END",
    "anchor1": "CASE WHEN doc_id % 7 = 0 THEN coalesce(substr({0}, 1, 50), 'no sentence here at all') WHEN doc_id % 11 = 0 THEN 'zzz yyy xxx www vvv' ELSE coalesce(substr({2}, 1, 70), {0}, 'no sentence here at all') END",
    "result0": f"CASE WHEN ({_CROSS}) AND doc_id % 3 = 0 THEN 'the map shows seven rivers' WHEN ({_CROSS}) AND doc_id % 3 = 1 THEN 'Theo hình vẽ này rõ' WHEN {_CROSS} THEN 'one two' ELSE 'value one' END",
    "result1": "'value two '",
    "result2": "CASE WHEN doc_id % 19 = 0 THEN '  ' ELSE 'final value' END",
    "node0": f"CASE WHEN NOT ({_CROSS}) OR doc_id % 23 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN 3 ELSE 1 END",
    "node1": f"CASE WHEN NOT ({_CROSS}) AND doc_id % 37 = 0 THEN 1 END",
    "question": "CASE doc_id % 3 WHEN 0 THEN coalesce(substr({0}, 1, 200), 'x') WHEN 1 THEN concat('what is ', coalesce(substr({0}, 1, 30), 'it')) ELSE 'which map is it' END",
}
_BOXES = "CASE WHEN NOT ({c}) THEN NULL WHEN doc_id % 5 = 0 THEN {a}0.1, 0.2, 0.5, 0.6{z} WHEN doc_id % 5 = 1 THEN {a}0.0, 0.0, 1.0, 1.0{z} WHEN doc_id % 5 = 2 THEN {a}0.1, 0.1, 0.11, 0.11{z} WHEN doc_id % 5 = 4 THEN {a}0.5, 0.2, 0.4, 0.9{z} END"


def _field(name: str, *places: str) -> str:
    out = _FIELDS[name]
    return out.replace("{0}", places[0]).replace("{2}", places[1])


def _programs(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("text").alias("evidence"), text.sentences(F.col("text")).alias("s"))
    col = lambda n: F.expr(_field(n, "get(s, 0)", "get(s, 2)"))
    box = F.expr(_BOXES.format(c=_CROSS, a="array(", z=")")).cast("array<double>")
    none = F.lit(None)
    step = lambda i: F.struct(col(f"op{i}").alias("op"), (col(f"anchor{i}") if i < 2 else none.cast("string")).alias("anchor"), col(f"result{i}").alias("result"), (col(f"node{i}") if i < 2 else none).cast("int").alias("visual_node"), (box if i == 0 else none.cast("array<double>")).alias("bbox"))
    return docs.select("doc_id", "evidence", col("motif").alias("motif"), col("condition").alias("condition"), col("n_images").alias("n_images"), F.array(step(0), step(1), step(2)).alias("steps"), col("question").alias("question"))


def _common(c: str, i: int) -> str:
    return f"CASE WHEN best{i} > 0 THEN list_position(c{i}, best{i})::INTEGER - 1 ELSE -1 END AS at{i}, CASE WHEN len(a{i}) > 0 THEN best{i} / len(a{i}) ELSE 0.0 END AS score{i}"


_BAD = " ".join(
    f"WHEN op{i} IS DISTINCT FROM want{i} THEN 'step{i}_op_mismatch:expected=' || want{i} || ':got=' || CASE WHEN op{i} IS NULL THEN 'None' ELSE '''' || op{i} || '''' END "
    + (f"WHEN length(trim(anchor{i})) < {'CASE WHEN x THEN 1 ELSE 10 END' if i == 0 else '10'} THEN 'step{i}_anchor_missing_or_too_short' " if i < 2 else "")
    + f"WHEN trim(result{i}) = '' THEN 'step{i}_result_missing' "
    + ("WHEN x AND node0 IS NULL THEN 'step0_visual_step_missing_visual_node'" if i == 0 else "WHEN x AND node1 IS NOT NULL THEN 'step1_text_step_must_not_bind_visual:' || node1" if i == 1 else "")
    for i in range(3)
)
_CHAIN = f"""
b AS (SELECT doc_id, text AS evidence, list_filter(list_transform({_PARTS}, lambda x: trim(x, {_WHITE})), lambda x: length(x) >= 25) AS s FROM documents),
p0 AS (SELECT doc_id, evidence, s, {", ".join(f"{_field(n, 's[1]', 's[3]')} AS {n}" for n in _FIELDS)}, {_BOXES.format(c=_CROSS, a="[", z="]")}::DOUBLE[] AS box FROM b),
p1 AS (SELECT *, motif = 'figure_condition_apply' AS x, 'locate' AS want0, 'locate' AS want1, CASE WHEN motif = 'condition_chain' THEN 'chain' ELSE 'apply' END AS want2 FROM p0),
p2 AS (SELECT *, CASE WHEN motif = 'unknown' THEN 'motif_not_in_catalog:''unknown''' {_BAD} END AS compile_reason FROM p1),
p3 AS (SELECT *, list_transform(s, lambda y: list_distinct({_LEGAL.format("y")})) AS w, list_distinct({_LEGAL.format("anchor0")}) AS a0, list_distinct({_LEGAL.format("anchor1")}) AS a1 FROM p2),
p4 AS (SELECT *, list_transform(w, lambda y: len(list_intersect(a0, y))) AS c0, list_transform(w, lambda y: len(list_intersect(a1, y))) AS c1 FROM p3),
p5 AS (SELECT *, coalesce(list_max(c0), 0) AS best0, coalesce(list_max(c1), 0) AS best1 FROM p4),
p6 AS (SELECT *, {_common("c0", 0)}, {_common("c1", 1)} FROM p5),
p7 AS (SELECT *, CASE WHEN x THEN 'VISUAL' WHEN score0 >= 0.5 THEN 'MATCHED' ELSE 'UNGROUNDED' END AS st0, CASE WHEN score1 >= 0.5 THEN 'MATCHED' ELSE 'UNGROUNDED' END AS st1, CASE WHEN x THEN 1 ELSE 2 END AS floor_ FROM p6),
p8 AS (SELECT *, (st0 = 'UNGROUNDED')::INTEGER + (st1 = 'UNGROUNDED')::INTEGER AS lost, len(list_distinct(list_filter([CASE WHEN st0 = 'MATCHED' THEN at0 END, CASE WHEN st1 = 'MATCHED' THEN at1 END], lambda y: y IS NOT NULL)))::INTEGER AS distinct_ FROM p7),
p AS (SELECT *, CASE WHEN compile_reason IS NULL THEN CASE WHEN len(s) = 0 THEN 'evidence_has_no_sentences' WHEN lost > 0 THEN 'ungrounded_steps:' || lost WHEN distinct_ < floor_ THEN 'anchors_not_distinct:' || distinct_ || '<' || floor_ END END AS exec_reason, CASE WHEN compile_reason IS NULL THEN
 CASE WHEN condition <> 'TLV' THEN CASE WHEN x THEN 'cross_modal_motif_outside_TLV:' || condition WHEN node0 IS NOT NULL OR node1 IS NOT NULL THEN 'visual_node_declared_outside_TLV:' || condition END
 WHEN n_images = 0 THEN 'TLV_package_has_no_images' WHEN node0 IS NULL AND node1 IS NULL THEN 'TLV_no_visual_binding' WHEN node0 > n_images THEN 'step0_visual_node_out_of_range:' || node0 WHEN node1 > n_images THEN 'step1_visual_node_out_of_range:' || node1 END END AS bind_reason FROM p8)"""


@query(f"WITH {_CHAIN} SELECT doc_id, compile_reason, x AND compile_reason IS NULL AS closed FROM p")
def q_compile_rows(spark, d):
    rows = programs.compiled(_programs(spark, d))
    return rows.select("doc_id", "compile_reason", F.coalesce("path.closed", F.lit(False)).alias("closed"))


@query(f"""
WITH {_CHAIN} SELECT doc_id, i AS step, CASE i WHEN 0 THEN st0 WHEN 1 THEN st1 ELSE 'DERIVED' END AS status, CASE WHEN i = 0 AND NOT x THEN at0 WHEN i = 1 THEN at1 END AS matched_sentence, CASE WHEN i = 0 AND NOT x THEN round(score0, 3) WHEN i = 1 THEN round(score1, 3) END AS match_score,
exec_reason, distinct_ AS n_distinct FROM p, (VALUES (0), (1), (2)) AS o(i) WHERE compile_reason IS NULL AND len(s) > 0
""")
def q_execute_programs(spark, d):
    rows = programs.executed(programs.compiled(_programs(spark, d))).select("doc_id", "execution.*")
    each = rows.select("doc_id", F.explode("per_step").alias("p"), F.col("reason").alias("exec_reason"), F.col("distinct_anchor_sentences").alias("n_distinct"))
    return each.select("doc_id", F.col("p.index").alias("step"), "p.status", "p.matched_sentence", "p.match_score", "exec_reason", "n_distinct")


_RUN = "coalesce(list_max(list_filter(range(1, 31), lambda n: len(list_filter(range(1, len({q}) - n + 2), lambda i: contains({e}, ' ' || array_to_string({q}[i:i + n - 1], ' ') || ' '))) > 0)), 0)::INTEGER"


@query(f"""
WITH {_CHAIN}, q AS (SELECT *, {_LEGAL.format("question")} AS q, ' ' || array_to_string({_LEGAL.format("evidence")}, ' ') || ' ' AS e FROM p),
r AS (SELECT *, CASE WHEN compile_reason IS NULL AND exec_reason IS NULL THEN {_RUN.format(q="q", e="e")} END AS verbatim_run FROM q)
SELECT doc_id, verbatim_run, coalesce('compile:' || compile_reason, 'exec:' || exec_reason, CASE WHEN verbatim_run > 7 THEN 'anti_verbatim:run=' || verbatim_run || '>7' END) AS reason FROM r
""")
def q_guard_question(spark, d):
    return programs.guard_question(_programs(spark, d)).select("doc_id", "verbatim_run", "reason")


@query(f"WITH {_CHAIN} SELECT doc_id, bind_reason FROM p WHERE compile_reason IS NULL")
def q_visual_binding(spark, d):
    return programs.bound(programs.compiled(_programs(spark, d))).filter("compile_reason IS NULL").select("doc_id", "bind_reason")


_SPANS = """
sp AS (SELECT doc_id, 0 AS i, 0::BIGINT AS cur, 0::BIGINT AS st, 0::BIGINT AS en FROM b UNION ALL
SELECT doc_id, i, CASE WHEN st < 0 THEN cur ELSE greatest(cur, st + size) END, st, CASE WHEN st < 0 THEN -1 ELSE st + size END FROM (SELECT sp.doc_id, i + 1 AS i, cur, length(s[i + 1]) AS size,
CASE WHEN strpos(substr(evidence, cur + 1), s[i + 1]) > 0 THEN cur + strpos(substr(evidence, cur + 1), s[i + 1]) - 1 ELSE strpos(evidence, s[i + 1]) - 1 END AS st FROM sp JOIN b USING (doc_id) WHERE i < len(s)))"""
SQL["q_sentence_spans"] = f"WITH RECURSIVE {_CHAIN.split(', p0 AS'.strip())[0].split('p0 AS')[0].rstrip().rstrip(',')}, {_SPANS} SELECT doc_id, (i - 1)::INTEGER AS i, st::INTEGER AS start, en::INTEGER AS \"end\" FROM sp WHERE i > 0"

_ATOM = """'{{"atom_id": "a{i}", "op": ' || to_json(op{i}) || ', "step_index": {i}, "value": ' || to_json(trim(result{i})) || '}}'"""
_TEXT = """'{{"anchor_declared": ' || to_json(trim(anchor{i})) || ', "atom_id": "a{i}", "char_span": [' || span{i}[1] || ', ' || span{i}[2] || '], "kind": "text", "match_score": ' || round(score{i}, 3)::VARCHAR || ', "sentence_index": ' || at{i} || ', "source_excerpt": ' || to_json(substr(s[at{i} + 1], 1, 200)) || ', "visual_node": ' || coalesce(node{i}::VARCHAR, 'null') || '}}'"""
_VISUAL = """'{"anchor_declared": ' || to_json(trim(anchor0)) || ', "atom_id": "a0", "bbox": ' || CASE WHEN box IS NULL THEN 'null' ELSE '[' || array_to_string(list_transform(box, lambda v: v::VARCHAR), ', ') || ']' END || ', "char_span": null, "kind": "visual", "observation": ' || to_json(trim(result0)) || ', "sentence_index": null, "visual_node": ' || coalesce(node0::VARCHAR, 'null') || '}'"""
_DERIVED = """'{"atom_id": "a2", "char_span": null, "derived_from": ["a0", "a1"], "kind": "derived", "sentence_index": null, "visual_node": null}'"""
_TRACED = f"""{_CHAIN}, {_SPANS},
g0 AS (SELECT p.*, [u.st, u.en] AS span0, [v.st, v.en] AS span1 FROM p LEFT JOIN sp u ON u.doc_id = p.doc_id AND u.i = p.at0 + 1 AND p.at0 >= 0 LEFT JOIN sp v ON v.doc_id = p.doc_id AND v.i = p.at1 + 1 WHERE compile_reason IS NULL AND exec_reason IS NULL),
g AS (SELECT *, substr(sha256('{{"atoms": [' || {_ATOM.format(i=0)} || ', ' || {_ATOM.format(i=1)} || ', ' || {_ATOM.format(i=2)} || '], "gamma": [' || CASE WHEN x THEN {_VISUAL} ELSE {_TEXT.format(i=0)} END || ', ' || {_TEXT.format(i=1)} || ', ' || {_DERIVED} || ']}}'), 1, 16) AS trace_hash FROM g0)"""


@query(f"WITH RECURSIVE {_TRACED} SELECT doc_id, trace_hash, span1[1]::INTEGER AS start1, span1[2]::INTEGER AS end1 FROM g")
def q_traces(spark, d):
    rows = programs.traced(programs.executed(programs.compiled(_programs(spark, d)))).filter("atoms IS NOT NULL")
    return rows.select("doc_id", "trace_hash", F.col("gamma")[1]["char_span"][0].alias("start1"), F.col("gamma")[1]["char_span"][1].alias("end1"))


_NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"


@query(rf"""
WITH RECURSIVE {_TRACED}, m AS (SELECT *, left({_NORM.format("substr(evidence, span1[1] + 2, span1[2] - span1[1] - 1)")}, 60) <> left({_NORM.format("substr(s[at1 + 1], 1, 200)")}, 60) AS moved FROM g)
SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN CASE WHEN moved THEN 'a1:span_text_mismatch,trace_hash_mismatch' ELSE 'trace_hash_mismatch' END WHEN 2 THEN 'a1:span_text_mismatch,trace_hash_mismatch' WHEN 3 THEN 'trace_hash_mismatch' WHEN 4 THEN 'a1:span_out_of_range,trace_hash_mismatch' WHEN 5 THEN 'duplicate_atom_ids,trace_hash_mismatch' ELSE '' END AS problems FROM m
""")
def q_trace_replay(spark, d):
    """Five traces of six are changed: a span moved, an excerpt, the hash, a span beyond the text, an atom doubled."""
    rows = programs.traced(programs.executed(programs.compiled(_programs(spark, d)))).filter("atoms IS NOT NULL")
    k, g = F.col("doc_id") % 6, F.col("gamma")[1]
    span = F.when(k == 1, F.array(g["char_span"][0] + 1, g["char_span"][1])).when(k == 4, F.array(g["char_span"][0], F.char_length("evidence") + 1)).otherwise(g["char_span"])
    other = g.withField("char_span", span).withField("source_excerpt", F.when(k == 2, "something else").otherwise(g["source_excerpt"]))
    gamma = F.array(F.col("gamma")[0], other, F.col("gamma")[2])
    atoms = F.when(k == 5, F.concat("atoms", F.slice("atoms", 1, 1))).otherwise(F.col("atoms"))
    rows = rows.withColumn("gamma", gamma).withColumn("atoms", atoms).withColumn("trace_hash", F.when(k == 3, F.reverse("trace_hash")).otherwise(F.col("trace_hash")))
    return rows.select("doc_id", F.array_join(programs.trace_problems(F.col("atoms"), F.col("gamma"), F.col("trace_hash"), F.col("evidence")), ",").alias("problems"))


_SEEN = """CASE WHEN node0 IS NULL THEN 'a0:visual_node_not_int' WHEN n_images = 0 THEN 'a0:no_declared_images' WHEN node0 > n_images THEN 'a0:visual_node_out_of_range:' || node0 WHEN box IS NULL THEN 'a0:bbox_missing_or_malformed' WHEN doc_id % 5 = 4 THEN 'a0:bbox_degenerate'
WHEN doc_id % 5 = 1 THEN 'a0:bbox_covers_whole_page:1.000' WHEN doc_id % 5 = 2 THEN 'a0:bbox_too_small:0.00010' WHEN doc_id % 3 = 2 THEN 'a0:observation_too_short' WHEN doc_id % 3 = 1 THEN 'a0:observation_is_placeholder' END"""


@query(f"WITH {_CHAIN} SELECT doc_id, coalesce({_SEEN}, '') AS problems FROM p WHERE x")
def q_visual_anchors(spark, d):
    s = F.col("steps")[0]
    gamma = F.array(F.struct(F.lit("a0").alias("atom_id"), F.lit("visual").alias("kind"), s["visual_node"].alias("visual_node"), s["bbox"].alias("bbox"), s["result"].alias("observation")))
    rows = _programs(spark, d).filter("motif = 'figure_condition_apply'").withColumn("gamma", gamma)
    return rows.select("doc_id", F.array_join(programs.visual_problems(F.col("gamma"), F.col("n_images")), ",").alias("problems"))


_PLANNED = f"(SELECT *, coalesce('compile:' || compile_reason, 'exec:' || exec_reason, 'visual:' || bind_reason, CASE WHEN x THEN 'visual_anchor:' || {_SEEN} END) AS reason FROM {{0}})"


@query(f"WITH {_CHAIN} SELECT doc_id, reason, CASE WHEN reason IS NULL THEN 'PLAN_OK' ELSE 'REJECTED' END AS status FROM {_PLANNED.format('p')}")
def q_guard_plan(spark, d):
    return programs.guard_plan(_programs(spark, d)).select("doc_id", "reason", "status")


_EXCERPT = r"CASE WHEN len(list_filter(regexp_split_to_array({0}, '\s+'), lambda y: y <> '')) <= {1} THEN trim({0}, E' \t\n\v\f\r') ELSE array_to_string(list_filter(regexp_split_to_array({0}, '\s+'), lambda y: y <> '')[1:{1}], ' ') END"
_SEALED = rf"""{_TRACED}, k AS (SELECT *, len({_LEGAL.format("evidence")}) AS n_words, CASE WHEN x THEN 1 ELSE 2 END AS n_text FROM {_PLANNED.format('g')} WHERE reason IS NULL),
z AS (SELECT *, CASE WHEN n_words = 0 THEN 40 ELSE greatest(1, least(40, floor(0.35::DOUBLE * n_words / n_text)::INTEGER)) END AS most FROM k)"""


@query(rf"""
WITH RECURSIVE {_SEALED} SELECT doc_id, trace_hash AS construction_hash, CASE WHEN x THEN '' ELSE {_EXCERPT.format("substr(s[at0 + 1], 1, 200)", "most")} || ' | ' END || {_EXCERPT.format("substr(s[at1 + 1], 1, 200)", "most")} AS excerpts, x::INTEGER AS n_visual FROM z
""")
def q_seals(spark, d):
    rows = programs.sealed(programs.guard_plan(_programs(spark, d))).filter("seal IS NOT NULL")
    return rows.select("doc_id", "seal.construction_hash", F.array_join(F.transform("seal.anchors", lambda a: a.excerpt), " | ").alias("excerpts"), F.size("seal.visual_observations").alias("n_visual"))


@query(rf"""
WITH RECURSIVE {_SEALED}, q AS (SELECT *, {_LEGAL.format("question")} AS q, ' ' || array_to_string({_LEGAL.format("evidence")}, ' ') || ' ' AS e FROM z),
r AS (SELECT *, {_RUN.format(q="q", e="e")} AS verbatim_run, CASE WHEN x AND list_contains(q, 'map') THEN 1 ELSE 0 END AS stem_run FROM q)
SELECT doc_id, stem_run, verbatim_run, (CASE WHEN doc_id % 16 = 0 OR doc_id % 8 = 1 THEN 0.0 WHEN doc_id % 8 = 2 THEN 0.5 ELSE 1.0 END)::DOUBLE AS atom_overlap, CASE WHEN doc_id % 16 = 0 THEN 'missing:choices' WHEN doc_id % 8 = 1 THEN 'answer_index_out_of_range' WHEN doc_id % 8 = 4 THEN 'choices_not_distinct' WHEN doc_id % 8 = 5 THEN 'invalid_choices' WHEN verbatim_run > 7 THEN 'anti_verbatim:run=' || verbatim_run || '>7' END AS reason FROM r WHERE doc_id % 16 <> 8
UNION ALL SELECT doc_id, stem_run, verbatim_run, 1.0::DOUBLE, CASE WHEN verbatim_run > 7 THEN 'anti_verbatim:run=' || verbatim_run || '>7' END FROM r WHERE doc_id % 16 = 8
""")
def q_guard_realized(spark, d):
    rows = programs.sealed(programs.guard_plan(_programs(spark, d))).filter("seal IS NOT NULL")
    choices = F.expr("CASE WHEN doc_id % 16 = 0 THEN array('final value') WHEN doc_id % 8 = 2 THEN array('value', 'b', 'c', 'd') WHEN doc_id % 8 = 4 THEN array('final value', 'B  x', 'b x', 'd') WHEN doc_id % 8 = 5 THEN array('final value', 'b', 'c', ' ') ELSE array('The final value', 'b', 'c', 'd') END")
    items = rows.withColumn("choices", choices).withColumn("answer_index", F.when(F.col("doc_id") % 8 == 1, 4).otherwise(0))
    items = items.withColumn("choices", F.when(F.col("doc_id") % 16 == 0, F.array().cast("array<string>")).otherwise(F.col("choices")))
    out = programs.guard_realized(items)
    return out.select("doc_id", "stem_run", "verbatim_run", "atom_overlap", F.col("realized_reason").alias("reason"))


@query(f"""
WITH a AS (SELECT item_id, list_distinct({_LEGAL.format("text")}) AS w FROM benchmark), x AS (SELECT item_id, len(w) AS size, unnest(w) AS token FROM a),
b AS (SELECT doc_id, list_filter(list_transform({_PARTS}, lambda x: trim(x, {_WHITE})), lambda x: length(x) >= 25) AS s FROM documents),
s AS (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM b), y AS (SELECT doc_id * 100000 + i AS s, unnest(list_distinct({_LEGAL.format("x")})) AS token FROM s),
h AS (SELECT item_id, size, s, count(*) AS common FROM x JOIN y USING (token) GROUP BY ALL)
SELECT item_id, arg_max(s, (common, -s)) AS s, round(max(common / size), 9) AS score, CASE WHEN max(common / size) >= 0.5 THEN 'MATCHED' ELSE 'UNGROUNDED' END AS status FROM h GROUP BY item_id
""")
def q_grounded_anchors(spark, d):
    """Each benchmark passage with the sentence of all documents that holds most of its words."""
    a = t(spark, d, "benchmark").select("item_id", text.legal_words(F.col("text")).alias("tokens"))
    s = t(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "x"))
    s = s.select((F.col("doc_id") * 100000 + F.col("i")).alias("s"), F.array_distinct(text.legal_words(F.col("x"))).alias("tokens"))
    return overlap.best_matches(a, s, ["item_id"]).withColumn("score", F.round("score", 9))


@query(f"""
WITH b AS (SELECT unnest(list_filter(list_transform({_PARTS}, lambda x: trim(x, {_WHITE})), lambda x: length(x) >= 25)) AS x FROM documents), n AS (SELECT count(*) AS n FROM b), y AS (SELECT unnest(list_distinct({_LEGAL.format("x")})) AS token FROM b),
i AS (SELECT token, count(*) AS df, ln(((SELECT n FROM n) + 1) / (count(*) + 1)) AS idf FROM y GROUP BY token), c AS (SELECT list_sort(list(idf))[floor(count(*) * 0.40)::BIGINT + 1] AS cut FROM i)
SELECT token, df, round(idf, 9) AS idf, idf >= cut AS kept FROM i, c
""")
def q_idf_sentences(spark, d):
    s = t(spark, d, "documents").select(F.explode(text.sentences(F.col("text"))).alias("x"))
    rows, cut = overlap.idf_with_cut(s.select(F.array_distinct(text.legal_words(F.col("x"))).alias("tokens")))
    return rows.select("token", "df", F.round("idf", 9).alias("idf"), (F.col("idf") >= F.lit(cut)).alias("kept"))
