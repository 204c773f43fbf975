"""Queries of the record contracts: texts are made of the tables by SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from ._registry import query, spread, t


def _when(*cases: tuple[int, str], other: str, key: str = "event_id") -> str:
    return "CASE " + " ".join(f"WHEN {key} % {m} = 0 THEN {v}" for m, v in cases) + f" ELSE {other} END"


def _first(*cases: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in cases) + " END"


def _record(spark, d, sql, table="events", keep=("event_id",)):
    return spread(t(spark, d, table), keep[0]).select(*keep, F.expr(sql).alias("j"))


def _closed(keys: list[str]) -> str:
    names = ", ".join(f"'{k}'" for k in keys)
    return f"len(list_filter(json_keys(j), lambda k: k NOT IN ({names}))) > 0 OR len(list_filter([{names}], lambda k: NOT list_contains(json_keys(j), k))) > 0"


_INT = "coalesce(json_type(j, '$.{0}') IN ('UBIGINT', 'BIGINT') AND try_cast(json_extract_string(j, '$.{0}') AS BIGINT) BETWEEN {1} AND {2}, false)"
_UNIT = "coalesce(json_type(j, '$.confidence') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND try_cast(json_extract_string(j, '$.confidence') AS DOUBLE) BETWEEN 0 AND 1, false)"
_BLANK = "coalesce(json_type(j, '$.{0}') <> 'VARCHAR' OR trim(json_extract_string(j, '$.{0}')) = '', true)"

_ANSWER = "concat('{\"abstain\":', " + _when((7, "'true'"), (11, "'1'"), other="'false'") + ", ',\"answer_index\":', " + _when((5, "'null'"), (23, "'\"2\"'"), other="cast(event_id % 6 as string)") + ", ',\"confidence\":', " + _when((13, "'1.5'"), (17, "'\"high\"'"), other="'0.25'") + ", " + _when((19, "',\"extra\":1'"), other="''") + ", " + _when((29, "'x'"), other="'}'") + ")"


@query(
    f"WITH r AS (SELECT event_id, {_ANSWER} AS j FROM events), v AS (SELECT event_id, CASE WHEN json_valid(j) THEN j END AS j FROM r) SELECT event_id, "
    + _first(("j IS NULL", "not_object"), (_closed(["abstain", "answer_index", "confidence"]), "keys"), ("json_type(j, '$.abstain') <> 'BOOLEAN'", "abstain_not_bool"), ("json_extract_string(j, '$.abstain') = 'true' AND json_type(j, '$.answer_index') <> 'NULL'", "abstention_must_have_null_index"), (f"json_extract_string(j, '$.abstain') = 'false' AND NOT {_INT.format('answer_index', 0, 3)}", "index_out_of_range"), (f"NOT {_UNIT}", "confidence_not_unit_interval"))
    + " AS reason FROM v"
)
def q_parse_answer(spark, d):
    return _record(spark, d, _ANSWER).select("event_id", records.answer_reason(F.col("j")).alias("reason"))


_JUDGE = "concat('{\"answerability\":', cast(event_id % 7 as string), ',\"single_best_answer\":', " + _when((5, "'true'"), other="'3'") + ", ',\"clarity\":', " + _when((4, "'2.5'"), other="'4'") + ", ',\"notes\":', " + _when((3, "'null'"), other="'\"fine\"'") + ", " + _when((19, "',\"more\":1'"), other="''") + ", '}')"


@query(
    f"WITH v AS (SELECT event_id, {_JUDGE} AS j FROM events) SELECT event_id, "
    + _first((_closed(["answerability", "single_best_answer", "clarity", "notes"]), "keys"), *[(f"NOT {_INT.format(s, 1, 5)}", f"invalid_score:{s}") for s in ("answerability", "single_best_answer", "clarity")], ("json_type(j, '$.notes') <> 'VARCHAR'", "notes_not_string"))
    + " AS reason FROM v"
)
def q_parse_judgement(spark, d):
    return _record(spark, d, _JUDGE).select("event_id", records.judgement_reason(F.col("j")).alias("reason"))


_AUDIT = "concat('{\"supported\":', " + _when((5, "'1'"), other="'true'") + ", ',\"relation_supported\":', " + _when((7, "'null'"), other="'false'") + ", " + _when((11, "''"), (3, "',\"notes\":7'"), other="',\"notes\":\"n\"'") + ", '}')"


@query(f"WITH v AS (SELECT event_id, {_AUDIT} AS j FROM events) SELECT event_id, " + _first((_closed(["supported", "relation_supported", "notes"]), "keys"), ("json_type(j, '$.supported') <> 'BOOLEAN' OR json_type(j, '$.relation_supported') <> 'BOOLEAN'", "verdict_not_bool"), ("json_type(j, '$.notes') <> 'VARCHAR'", "notes_not_string")) + " AS reason FROM v")
def q_parse_image_audit(spark, d):
    return _record(spark, d, _AUDIT).select("event_id", records.audit_reason(F.col("j")).alias("reason"))


_SMOKE = "concat(" + _when((2, "'```json '"), other="''") + ", '{\"status\":', " + _when((5, "'\"no\"'"), other="'\"ok\"'") + ", ',\"code\":', " + _when((3, "'null'"), (7, "'\"K8\"'"), other="'\"K7\"'") + ", " + _when((11, "',\"x\":1'"), other="''") + ", '}', " + _when((2, "' ```'"), other="''") + ")"


@query(
    f"WITH r AS (SELECT event_id, event_type = 'view' AS vision, {_SMOKE} AS x FROM events), v AS (SELECT event_id, vision, regexp_replace(regexp_replace(x, '^```json ', ''), ' ```$', '') AS j FROM r) SELECT event_id, "
    + _first((_closed(["status", "code"]), "unexpected_answer_keys"), ("json_extract_string(j, '$.status') <> 'ok'", "invalid_status"), ("vision AND coalesce(json_extract_string(j, '$.code') <> 'K7', true)", "visual_code_mismatch"), ("NOT vision AND json_type(j, '$.code') <> 'NULL'", "text_code_must_be_null"))
    + " AS reason FROM v"
)
def q_smoke_answer(spark, d):
    return _record(spark, d, _SMOKE, keep=("event_id", "event_type")).select("event_id", records.smoke_reason(F.col("j"), F.col("event_type") == "view", "K7").alias("reason"))


_CAPTION = "concat('{\"caption\":\"', repeat('word ', cast(event_id % 66 as int)), '\",\"relations\":', " + _when((5, "'[]'"), (7, "concat('[', repeat('\"a b\",', 12), '\"c d\"]')"), (9, "'[\"one\"]'"), (10, "'[\"a b\",3]'"), other="'[\"a b\",\"c d e\"]'") + ", ',\"confidence\":', " + _when((13, "'2'"), other="'1'") + ", " + _when((17, "',\"y\":0'"), other="''") + ", '}')"
_RELATIONS = "CASE WHEN json_type(j, '$.relations') = 'ARRAY' THEN json_extract(j, '$.relations[*]') ELSE [] END"


@query(
    f"WITH v AS (SELECT event_id, {_CAPTION.replace('cast(event_id % 66 as int)', '(event_id % 66)::INTEGER')} AS j FROM events), w AS (SELECT *, {_RELATIONS} AS rs FROM v) SELECT event_id, "
    + _first((_closed(["caption", "relations", "confidence"]), "unexpected_keys"), (_BLANK.format("caption"), "empty_caption"), ("len(list_filter(string_split(json_extract_string(j, '$.caption'), ' '), lambda x: x <> '')) > 60", "caption_too_long"), ("len(rs) = 0", "no_relations"), ("len(rs) > 12", "too_many_relations"), ("len(list_filter(rs, lambda x: json_type(x) <> 'VARCHAR' OR NOT contains(x::VARCHAR, ' '))) > 0", "invalid_relation"), (f"NOT {_UNIT}", "confidence_not_unit_interval"))
    + " AS reason FROM w"
)
def q_parse_caption(spark, d):
    return _record(spark, d, _CAPTION).select("event_id", records.caption_reason(F.col("j")).alias("reason"))


_ITEM = "concat('{\"question\":', " + _when((19, "'\"  \"'"), other="'\"Why?\"'") + ", ',\"choices\":', " + _when((5, "'[\"a\",\"b\",\"c\"]'"), (7, "'[\"a\",\"B  c\",\"b C\",\"d\"]'"), (11, "'[\"a\",\"b\",\"c\",4]'"), other="'[\"a\",\"b\",\"c\",\"d\"]'") + ", ',\"answer_index\":', " + _when((13, "'true'"), other="cast(event_id % 5 as string)") + ", ',\"rationale\":\"r\",\"distractor_faults\":', " + _when((17, "'[\"x\",\"y\"]'"), other="'[\"x\",\"y\",\"z\"]'") + ", " + _when((23, "',\"note\":1'"), other="''") + ", '}')"


@query(
    f"WITH v AS (SELECT event_id, {_ITEM} AS j FROM events), w AS (SELECT *, json_extract(j, '$.choices[*]') AS cs FROM v) SELECT event_id, "
    + _first((_closed(["question", "choices", "answer_index", "rationale", "distractor_faults"]), "unexpected_keys"), (_BLANK.format("question"), "empty_question"), ("len(cs) <> 4", "choices_must_have_four_entries"), ("len(list_filter(cs, lambda x: json_type(x) <> 'VARCHAR')) > 0", "invalid_choice"), ("len(list_distinct(list_transform(cs, lambda x: lower(regexp_replace(x::VARCHAR, ' +', ' ', 'g'))))) <> 4", "duplicate_choices"), ("json_type(j, '$.answer_index') NOT IN ('UBIGINT', 'BIGINT')", "answer_index_not_int"), (f"NOT {_INT.format('answer_index', 0, 3)}", "answer_index_out_of_range"), ("len(json_extract(j, '$.distractor_faults[*]')) <> 3", "distractor_faults_must_have_three_entries"))
    + " AS reason FROM w"
)
def q_parse_item(spark, d):
    return _record(spark, d, _ITEM).select("event_id", records.item_reason(F.col("j")).alias("reason"))


_PROGRAM = "concat('{\"motif\":', " + _when((7, "'\"none\"'"), other="'\"condition_chain\"'") + ", ',\"steps\":[{\"op\":\"locate\",\"anchor\":\"a\",\"result\":\"r\"},{\"op\":\"locate\",\"anchor\":', " + _when((5, "'\" \"'"), other="'\"b\"'") + ", ',\"result\":\"r\"},{\"op\":', " + _when((11, "'3'"), other="'\"chain\"'") + ", " + _when((3, "',\"anchor\":\"c\"'"), (4, "',\"anchor\":null'"), other="''") + ", ',\"result\":\"r\"', " + _when((13, "',\"z\":1'"), other="''") + ", '}]}')"
_STEP2 = "json_extract(j, '$.steps[2]')"


@query(
    f"WITH r AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '{{\"abstain\":\"no_cross_modal_dependency\"}}' ELSE {_PROGRAM} END AS j FROM events) SELECT event_id, "
    + _first(("json_extract_string(j, '$.abstain') = 'x'", ""), ("json_keys(j) <> ['abstain'] AND json_extract_string(j, '$.motif') = 'none'", "unknown_motif"), ("json_extract_string(j, '$.steps[1].anchor') = ' '", "missing_anchor:1"), (f"list_contains(json_keys({_STEP2}), 'z')", "invalid_step:2"), (f"json_type({_STEP2}, '$.op') <> 'VARCHAR'", "invalid_step_fields:2"), (f"json_type({_STEP2}, '$.anchor') = 'VARCHAR'", "derived_step_must_not_have_anchor"))
    + " AS reason FROM r"
)
def q_planner_program(spark, d):
    rows = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 17 == 0, '{"abstain":"no_cross_modal_dependency"}').otherwise(F.expr(_PROGRAM)).alias("j"))
    return rows.select("event_id", records.program_reason(F.col("j"), ["condition_chain", "numeric_derive"]).alias("reason"))


_BODY = "concat('{\"choices\":', " + _when((7, "'[]'"), (11, "'[5]'"), other="concat('[{\"finish_reason\":', " + _when((5, "'\"length\"'"), other="'\"stop\"'") + ", ',\"message\":', " + _when((13, "'\"m\"'"), other="concat('{\"content\":', " + _when((3, "'[{\"text\":\"a\"},{\"image\":1},{\"text\":\"b\"}]'"), (17, "'[{\"image\":1}]'"), (19, "'\" \"'"), (4, "'12'"), other="'\"hello\"'") + ", '}')") + ", '}]')") + ", '}')"
_MSG = "json_type(j, '$.choices[0].message.content')"


@query(
    f"""WITH v AS (SELECT event_id, {_BODY} AS j FROM events), c AS (SELECT *, CASE WHEN {_MSG} = 'VARCHAR' THEN json_extract_string(j, '$.choices[0].message.content') WHEN {_MSG} = 'ARRAY' AND event_id % 3 = 0 THEN 'ab' END AS txt FROM v), f AS (SELECT event_id, txt, """
    + _first(("json_array_length(j, '$.choices') = 0", "missing_choices"), ("json_type(j, '$.choices[0]') <> 'OBJECT'", "choice_not_object"), ("json_extract_string(j, '$.choices[0].finish_reason') IN ('length', 'max_tokens')", "truncated_response"), ("json_type(j, '$.choices[0].message') <> 'OBJECT'", "missing_message"), ("txt IS NULL", "content_not_text"), ("trim(txt) = ''", "empty_content"))
    + " AS reason FROM c) SELECT event_id, CASE WHEN reason IS NULL THEN txt END AS content, reason FROM f"
)
def q_completion_content(spark, d):
    content, reason = records.content(F.col("j"))
    return _record(spark, d, _BODY).select("event_id", content.alias("content"), reason.alias("reason"))


_GRAPH = "concat('{\"graph_type\":', " + _when((7, "'\"blob\"'"), other="'\"flow\"'") + ", ',\"nodes\":', " + _when((11, "'[]'"), other="concat('[{\"id\":\"a\",\"label\":\"x\",\"level\":', " + _when((5, "'1.5'"), other="'1'") + ", ',\"bbox\":[0,0,1', " + _when((3, "''"), other="',1'") + ", ']},{\"id\":', " + _when((13, "'\"a\"'"), other="'\"b\"'") + ", ',\"label\":\"y\",\"level\":2,\"bbox\":[0,0.5,1,1]}]')") + ", ',\"edges\":[{\"src\":\"a\",\"dst\":', " + _when((17, "'\"q\"'"), other="'\"b\"'") + ", ',\"kind\":', " + _when((19, "'\"bad\"'"), other="'\"flow\"'") + ", '}],\"confidence\":', " + _when((23, "'-1'"), other="'0.5'") + ", '}')"


@query(
    f"WITH v AS (SELECT event_id, {_GRAPH} AS j FROM events) SELECT event_id, "
    + _first(("json_extract_string(j, '$.graph_type') = 'blob'", "unknown_graph_type"), ("json_array_length(j, '$.nodes') = 0", "empty_nodes"), (f"NOT {_UNIT}", "bad_confidence"), ("json_array_length(j, '$.nodes') = 2 AND json_extract_string(j, '$.nodes[0].id') = json_extract_string(j, '$.nodes[1].id')", "duplicate_node_id"), ("json_type(j, '$.nodes[0].level') = 'DOUBLE'", "bad_level"), ("json_array_length(j, '$.nodes[0].bbox') <> 4", "bad_bbox"), ("json_extract_string(j, '$.edges[0].kind') = 'bad'", "unknown_edge_kind"), ("json_extract_string(j, '$.edges[0].dst') NOT IN (json_extract_string(j, '$.nodes[0].id'), json_extract_string(j, '$.nodes[1].id'))", "dangling_edge"))
    + " AS reason FROM v"
)
def q_validate_graph(spark, d):
    return _record(spark, d, _GRAPH).select("event_id", records.graph_reason(F.col("j")).alias("reason"))


_RECORD = "concat('{\"schema\":\"answer.v1\",\"item_id\":\"', " + _when((7, "'-bad'"), other="concat('item-', cast(event_id as string))") + ", '\",\"condition\":\"', " + _when((5, "'blind'"), other="'text_only'") + ", '\",\"package_sha256\":\"', " + _when((11, "'abc'"), other="sha256(cast(event_id as string))") + ", '\",\"answer\":\"', " + _when((13, "' '"), (17, "'see /home/x'"), other="'forty two'") + ", '\",\"source\":\"model\"', " + _when((19, "',\"k\":1'"), other="''") + ", '}')"


@query(
    f"WITH v AS (SELECT event_id, {_RECORD} AS j FROM events) SELECT event_id, "
    + _first((_closed(["schema", "item_id", "condition", "package_sha256", "answer", "source"]), "unknown"), ("NOT regexp_full_match(json_extract_string(j, '$.item_id'), '[A-Za-z0-9][A-Za-z0-9._-]{0,127}')", "identity"), ("json_extract_string(j, '$.condition') NOT IN ('text_only', 'text_layout', 'full_pixels')", "condition"), ("NOT regexp_full_match(json_extract_string(j, '$.package_sha256'), '[a-f0-9]{64}')", "package_sha256"), (_BLANK.format("answer"), "answer"), ("contains(lower(j), '/home/')", "unsafe"))
    + " AS reason FROM v"
)
def q_answer_record(spark, d):
    rows = _record(spark, d, _RECORD.replace("sha256(cast(event_id as string))", "sha2(cast(event_id as string), 256)"))
    return rows.select("event_id", records.answer_record_reason(F.col("j"), "answer.v1").alias("reason"))


_QUOTE = _when((5, "substr(text, 3, 30)"), (7, "'never in any text at all'"), other="substr(text, 1, 12)", key="doc_id")
_GENERATION = "concat('{\"question\":\"q\",\"answer\":\"', " + _when((3, "'b'"), other="'a'", key="doc_id") + ", '\",\"question_type\":\"multiple_choice\",\"text_evidence_quote\":', quote, ',\"visual_evidence\":[],\"options\":[\"a\",\"b\",\"c\",\"d\"],\"correct_option\":', " + _when((4, "'1'"), other="'0'", key="doc_id") + ", '}')"


@query(f"""
WITH q AS (SELECT doc_id, text, {_QUOTE} AS raw FROM documents WHERE n_chars > 100), v AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'b' ELSE 'a' END AS answer, CASE WHEN doc_id % 4 = 0 THEN 'b' ELSE 'a' END AS option FROM q),
c AS (SELECT *, CASE WHEN trim(regexp_replace(raw, '\\s+', ' ', 'g')) = '' THEN 'missing' WHEN contains(text, raw) THEN 'exact' ELSE 'non_verbatim' END AS cls FROM v)
SELECT doc_id, CASE WHEN cls = 'missing' THEN 'GENERATION' WHEN cls = 'non_verbatim' THEN 'QUOTE_NON_VERBATIM' WHEN answer <> option THEN 'GENERATION' END AS reason, CASE WHEN cls = 'exact' AND answer = option THEN 'exact' END AS quote_class FROM c
""")
def q_validate_generation(spark, d):
    rows = t(spark, d, "documents").filter("n_chars > 100").select("doc_id", "text", F.expr(_QUOTE).alias("raw"))
    # the quotation as a JSON string
    rows = rows.withColumn("quote", F.regexp_replace(F.to_json(F.struct("raw")), r'(?s)^\{"raw":(.*)\}$', "$1")).select("doc_id", "text", F.expr(_GENERATION).alias("j"))
    reason, cls = records.generation_reason(F.col("j"), F.lit("multiple_choice"), F.col("text"))
    return rows.select("doc_id", reason.alias("reason"), cls.alias("quote_class"))


_PACKAGES = "SELECT conv_id AS item_id, CASE turn % 4 WHEN 0 THEN 'text_only' WHEN 1 THEN 'text_layout' WHEN 2 THEN 'full_pixels' ELSE 'other' END AS condition, CASE WHEN conv_id % 7 = 0 AND turn = 2 THEN 'odd' ELSE 'q' END AS question, CASE WHEN conv_id % 11 = 0 AND turn = 1 THEN 'u' ELSE 't' END AS text, CASE WHEN turn % 4 IN (1, 2) THEN CASE WHEN conv_id % 5 = 0 AND turn = 2 THEN 'l2' ELSE 'l1' END END AS layout FROM conversations WHERE turn < 3 + conv_id % 2"


@query(f"""
WITH p AS ({_PACKAGES}), g AS (SELECT item_id, count(*) AS n, count(DISTINCT condition) AS kinds, count(DISTINCT question) AS qs, count(DISTINCT text) AS ts, max(layout) FILTER (condition = 'text_layout') AS tl, max(layout) FILTER (condition = 'full_pixels') AS tlv FROM p GROUP BY item_id)
SELECT item_id, CASE WHEN n <> 3 THEN 'not_three' WHEN kinds <> 3 THEN 'duplicate_condition' WHEN qs <> 1 THEN 'question' WHEN ts <> 1 THEN 'text' WHEN tl IS DISTINCT FROM tlv THEN 'layout' END AS reason FROM g
""")
def q_validate_triplet(spark, d):
    return records.triplets(spark.sql(_PACKAGES.replace("FROM conversations", "FROM {rows}"), rows=t(spark, d, "conversations")))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'unknown_input' WHEN c_custkey % 7 = 0 THEN 'duplicate_output' WHEN c_custkey % 11 = 0 THEN 'final_not_produced' WHEN c_custkey % 13 = 0 THEN 'final_without_provenance' WHEN c_custkey % 3 = 0 THEN 'correct_choice' WHEN c_custkey % 17 = 0 THEN 'choice_is_not_the_answer' END AS reason FROM customer
""")
def q_validate_construction(spark, d):
    m = lambda n: F.col("c_custkey") % n == 0
    step = lambda i, o: F.struct(i.alias("inputs"), o.alias("output"))
    steps = F.array(step(F.array(F.when(m(5), "zz").otherwise("a0")), F.when(m(7), "a2").otherwise("a1")), step(F.array(F.lit("a1")), F.lit("a2")))
    atom = lambda k, v, s: F.struct(F.lit(k).alias("id"), v.alias("value"), s.alias("source"))
    atoms = F.array(atom("a0", F.lit("x"), F.lit("s")), atom("a1", F.lit("y"), F.lit("s")), atom("a2", F.col("c_name"), F.when(m(13), "").otherwise("s")), atom("a3", F.col("c_name"), F.lit("s")))
    choice = lambda x, ok: F.struct(x.alias("text"), ok.alias("correct"))
    choices = F.array(choice(F.when(m(17), "no").otherwise(F.col("c_name")), F.lit(True)), choice(F.lit("other"), m(3)))
    final = F.when(m(11), "a3").otherwise("a2")
    return t(spark, d, "customer").select("c_custkey", records.construction_reason(steps, atoms, choices, final).alias("reason"))


@query("WITH g AS (SELECT count(*) AS n, count(*) FILTER (p_type IN ('ECONOMY', 'STANDARD') AND p_size < 40) AS eligible, min(p_partkey) FILTER (NOT (p_type IN ('ECONOMY', 'STANDARD') AND p_size < 40)) AS first_blocked FROM part) SELECT *, CASE WHEN n > 0 AND n = eligible THEN 'ELIGIBLE' ELSE 'BLOCKED' END AS status FROM g")
def q_eligibility(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.col("p_type").alias("rights"), F.when(F.col("p_size") < 40, "small").alias("size"))
    return records.eligibility(rows, "p_partkey", rights=["ECONOMY", "STANDARD"], size=["small"])
