"""Closed JSON records judged by column expressions: the first rule that a text breaks is its reason, null if none.

Texts are parsed to VARIANT, whose schema tells true from 1 and null from a missing key, so nothing is cast
before its type is known and no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts
from .relational import first_reason

#: Fixed values of the records.
CHOICES, FAULTS, CAPTION_WORDS, RELATIONS = 4, 3, 60, 12
GRAPH_TYPES = ["hierarchy", "flow", "network", "table", "other"]
EDGE_KINDS = ["parent", "flow", "association"]
CONDITIONS = ["text_only", "text_layout", "full_pixels"]
TRUNCATED = ["length", "max_tokens"]


class Json:
    """Paths of a JSON text and what stands there."""

    def __init__(self, text: Column, v: Column | None = None):
        self.text, self.v = text, F.try_parse_json(text) if v is None else v

    def at(self, path: str) -> Column:
        return F.try_variant_get(self.v, path, "variant")

    def kind(self, path: str) -> Column:
        """STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID (null), ARRAY<..>, OBJECT<..>; empty if there is nothing."""
        return F.coalesce(F.schema_of_variant(self.at(path)), F.lit(""))

    def string(self, path: str) -> Column:
        return F.when(self.kind(path) == "STRING", F.try_variant_get(self.v, path, "string"))

    def blank(self, path: str) -> Column:
        """Not a string with something in it."""
        return F.coalesce(texts.strip(self.string(path)) == "", F.lit(True))

    def integer(self, path: str) -> Column:
        return F.when(self.kind(path) == "BIGINT", F.try_variant_get(self.v, path, "bigint"))

    def outside(self, path: str, least: int, most: int) -> Column:
        """Not an integer from least to most."""
        return ~F.coalesce(self.integer(path).between(least, most), F.lit(False))

    def not_unit(self, path: str) -> Column:
        number = self.kind(path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        return ~F.coalesce(number & F.try_variant_get(self.v, path, "double").between(0, 1), F.lit(False))

    def array(self, path: str, kind: str = "array<variant>") -> Column:
        return F.when(self.kind(path).startswith("ARRAY"), F.try_variant_get(self.v, path, kind))

    def missing(self, keys: Sequence[str]) -> Column:
        return F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(self.text))

    def unknown(self, keys: Sequence[str]) -> Column:
        return F.array_except(F.json_object_keys(self.text), F.array(*map(F.lit, keys)))

    def not_object(self) -> Column:
        return self.v.isNull() | F.json_object_keys(self.text).isNull()

    def not_closed(self, keys: Sequence[str]) -> Column:
        return (F.size(self.missing(keys)) > 0) | (F.size(self.unknown(keys)) > 0)


def parsed_once(text: Column, rule: Callable[[Json], Column]) -> Column:
    """rule of the text's Json, which a lambda binds: else each use of it would parse the text anew."""
    one = F.array(F.struct(text.alias("t"), F.try_parse_json(text).alias("v")))
    return F.transform(one, lambda b: rule(Json(b["t"], b["v"])))[0]


def string_of(v: Column) -> Column:
    """A variant's string; null if it is of another kind."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def no_strings(a: Column) -> Column:
    """Whether some member of an array of variants is not a string with something in it."""
    return F.exists(a, lambda x: F.coalesce(texts.strip(string_of(x)) == "", F.lit(True)))


def unfenced(text: Column) -> Column:
    """Without the code fence around it, if there is one."""
    inner = F.regexp_extract(text, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return F.when(text.rlike(r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"), inner).otherwise(text)


def answer_reason(text: Column) -> Column:
    """abstain, answer_index, confidence: an abstention has no index, any other answer one from 0 to 3."""
    j = Json(text)
    return first_reason(
        (j.not_object(), "not_object"), (j.not_closed(["abstain", "answer_index", "confidence"]), "keys"), (j.kind("$.abstain") != "BOOLEAN", "abstain_not_bool"),
        (F.try_variant_get(j.v, "$.abstain", "boolean") & (j.kind("$.answer_index") != "VOID"), "abstention_must_have_null_index"),
        (~F.try_variant_get(j.v, "$.abstain", "boolean") & j.outside("$.answer_index", 0, CHOICES - 1), "index_out_of_range"), (j.not_unit("$.confidence"), "confidence_not_unit_interval"),
    )


def judgement_reason(text: Column) -> Column:
    """Three scores from 1 to 5 and notes."""
    j, scores = Json(text), ["answerability", "single_best_answer", "clarity"]
    return first_reason((j.not_object(), "not_object"), (j.not_closed([*scores, "notes"]), "keys"), *[(j.outside(f"$.{s}", 1, 5), f"invalid_score:{s}") for s in scores], (j.kind("$.notes") != "STRING", "notes_not_string"))


def audit_reason(text: Column) -> Column:
    j = Json(text)
    flags = (j.kind("$.supported") != "BOOLEAN") | (j.kind("$.relation_supported") != "BOOLEAN")
    return first_reason((j.not_object(), "not_object"), (j.not_closed(["supported", "relation_supported", "notes"]), "keys"), (flags, "verdict_not_bool"), (j.kind("$.notes") != "STRING", "notes_not_string"))


def smoke_reason(text: Column, vision: Column, code: str) -> Column:
    """A probe's answer, fenced or not: status ok, and the code that the image shows, or none."""
    j = Json(unfenced(text))
    seen = F.coalesce(j.string("$.code") == code, F.lit(False))
    return first_reason(
        (j.v.isNull(), "invalid_json"), (j.not_object(), "answer_not_object"), (j.not_closed(["status", "code"]), "unexpected_answer_keys"), (~F.coalesce(j.string("$.status") == "ok", F.lit(False)), "invalid_status"),
        (vision & ~seen, "visual_code_mismatch"), (~vision & (j.kind("$.code") != "VOID"), "text_code_must_be_null"),
    )


def words_of(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))


def caption_reason(text: Column) -> Column:
    """A caption of 60 words at most and 1 to 12 relations of two words or more."""
    j = Json(unfenced(text))
    relations = j.array("$.relations")
    short = F.exists(relations, lambda r: F.coalesce(words_of(string_of(r)) < 2, F.lit(True)))
    keys = ["caption", "relations", "confidence"]
    return first_reason(
        (j.v.isNull(), "invalid_json"), (j.not_object(), "top_level_not_object"), (F.size(j.unknown(keys)) > 0, "unexpected_keys"), (F.size(j.missing(keys)) > 0, "missing_keys"),
        (j.blank("$.caption"), "empty_caption"), (words_of(j.string("$.caption")) > CAPTION_WORDS, "caption_too_long"), (F.coalesce(F.size(relations), F.lit(0)) <= 0, "no_relations"),
        (F.size(relations) > RELATIONS, "too_many_relations"), (short, "invalid_relation"), (j.not_unit("$.confidence"), "confidence_not_unit_interval"),
    )


def item_reason(text: Column) -> Column:
    """A question with four choices that differ after white space and case are folded, its answer's index, and three faults."""
    j = Json(unfenced(text))
    keys = ["question", "choices", "answer_index", "rationale", "distractor_faults"]
    choices, faults = j.array("$.choices"), j.array("$.distractor_faults")
    folded = F.transform(choices, lambda c: texts.casefold(texts.strip(F.regexp_replace(string_of(c), r"(?U)\s+", " "))))
    return first_reason(
        (j.v.isNull(), "invalid_json"), (j.not_object(), "top_level_not_object"), (F.size(j.unknown(keys)) > 0, "unexpected_keys"), (F.size(j.missing(keys)) > 0, "missing_keys"), (j.blank("$.question"), "empty_question"),
        (F.coalesce(F.size(choices), F.lit(0)) != CHOICES, "choices_must_have_four_entries"), (no_strings(choices), "invalid_choice"), (F.size(F.array_distinct(folded)) != CHOICES, "duplicate_choices"),
        (j.kind("$.answer_index") != "BIGINT", "answer_index_not_int"), (j.outside("$.answer_index", 0, CHOICES - 1), "answer_index_out_of_range"), (j.blank("$.rationale"), "empty_rationale"),
        (F.coalesce(F.size(faults), F.lit(0)) != FAULTS, "distractor_faults_must_have_three_entries"), (no_strings(faults), "invalid_distractor_fault"),
    )


def program_reason(text: Column, motifs: Sequence[str]) -> Column:
    """An abstention, or a motif of the catalogue with three steps: two with an anchor, the third without."""
    return parsed_once(text, lambda j: _program_reason(j, motifs))


def _program_reason(j: Json, motifs: Sequence[str]) -> Column:
    steps = j.array("$.steps")
    known = F.array(*map(F.lit, ["op", "anchor", "result", "visual_node", "bbox", "observation"]))
    get = lambda s, k: F.when(F.schema_of_variant(F.try_variant_get(s, f"$.{k}", "variant")) == "STRING", F.try_variant_get(s, f"$.{k}", "string"))
    empty = lambda x: F.coalesce(texts.strip(x) == "", F.lit(True))
    closed = lambda s: F.coalesce(F.size(F.array_except(F.json_object_keys(F.to_json(s)), known)) == 0, F.lit(False))
    checks = []
    for i in range(3):
        s = steps[i]
        anchor = F.coalesce(F.schema_of_variant(F.try_variant_get(s, "$.anchor", "variant")), F.lit("VOID"))
        checks += [(~closed(s), f"invalid_step:{i}"), (get(s, "op").isNull() | empty(get(s, "result")), f"invalid_step_fields:{i}"), (empty(get(s, "anchor")), f"missing_anchor:{i}") if i < 2 else (anchor != "VOID", "derived_step_must_not_have_anchor")]
    abstains = (F.array_join(F.json_object_keys(j.text), ",") == "abstain") & F.coalesce(j.string("$.abstain") == "no_cross_modal_dependency", F.lit(False))
    reason = first_reason(
        (j.v.isNull(), "invalid_json"), (j.not_object(), "top_level_not_object"), (j.not_closed(["motif", "steps"]), "expected_motif_and_steps"), (~F.coalesce(j.string("$.motif").isin(*motifs), F.lit(False)), "unknown_motif"),
        (F.coalesce(F.size(steps), F.lit(0)) != 3, "steps_must_have_three_entries"), *checks,
    )
    return F.when(~F.coalesce(abstains, F.lit(False)), reason)


def content(text: Column) -> tuple[Column, Column]:
    """Text of a completion's first choice (its parts joined), and the reason why there is none."""
    j = Json(text)
    m = "$.choices[0].message"
    whole, parts = j.string(f"{m}.content"), j.array(f"{m}.content")
    pieces = F.filter(F.transform(parts, lambda p: string_of(F.try_variant_get(p, "$.text", "variant"))), lambda p: p.isNotNull())
    out = F.coalesce(whole, F.when(F.size(pieces) > 0, F.array_join(pieces, "")))
    reason = first_reason(
        (j.not_object(), "not_object"), (F.coalesce(F.size(j.array("$.choices")), F.lit(0)) <= 0, "missing_choices"), (~j.kind("$.choices[0]").startswith("OBJECT"), "choice_not_object"),
        (F.coalesce(j.string("$.choices[0].finish_reason").isin(*TRUNCATED), F.lit(False)), "truncated_response"), (~j.kind(m).startswith("OBJECT"), "missing_message"), (out.isNull(), "content_not_text"), (texts.strip(out) == "", "empty_content"),
    )
    return F.when(reason.isNull(), out), reason


def graph_reason(text: Column) -> Column:
    """A closed graph: type, nodes with ids, levels and boxes, edges of known kinds between them, confidence."""
    return parsed_once(unfenced(text), _graph_reason)


def _graph_reason(j: Json) -> Column:
    keys = ["graph_type", "nodes", "edges", "confidence"]
    nodes, edges = j.array("$.nodes"), j.array("$.edges")
    name = lambda v: F.json_object_keys(F.to_json(v))
    part = lambda v, k: string_of(F.try_variant_get(v, f"$.{k}", "variant"))
    ids = F.transform(nodes, lambda n: part(n, "id"))
    extra = lambda a, ks: F.exists(a, lambda v: F.size(F.array_except(name(v), F.array(*map(F.lit, ks)))) > 0)
    lacks = lambda a, ks: F.exists(a, lambda v: F.size(F.array_except(F.array(*map(F.lit, ks)), name(v))) > 0)
    box = lambda n: F.try_variant_get(n, "$.bbox", "array<variant>")
    bad_box = F.exists(nodes, lambda n: F.coalesce((F.size(box(n)) != 4) | F.exists(box(n), lambda x: ~F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")), F.lit(True)))
    bad_level = F.exists(nodes, lambda n: F.coalesce(F.schema_of_variant(F.try_variant_get(n, "$.level", "variant")), F.lit("")) != "BIGINT")
    node_keys, edge_keys = ["id", "label", "level", "bbox"], ["src", "dst", "kind"]
    return first_reason(
        (j.v.isNull(), "non_json"), (j.not_object(), "not_object"), (F.size(j.unknown(keys)) > 0, "unknown_top_key"), (F.size(j.missing(keys)) > 0, "missing_top_key"), (~F.coalesce(j.string("$.graph_type").isin(*GRAPH_TYPES), F.lit(False)), "unknown_graph_type"),
        (nodes.isNull(), "nodes_not_list"), (edges.isNull(), "edges_not_list"), (F.size(nodes) == 0, "empty_nodes"), (j.not_unit("$.confidence"), "bad_confidence"), (F.exists(nodes, lambda n: name(n).isNull()), "node_not_object"),
        (extra(nodes, node_keys), "unknown_node_key"), (lacks(nodes, node_keys), "missing_node_key"), (F.exists(ids, lambda x: F.coalesce(x == "", F.lit(True))), "node_not_object"), (F.size(F.array_distinct(ids)) != F.size(ids), "duplicate_node_id"), (bad_level, "bad_level"), (bad_box, "bad_bbox"),
        (F.exists(edges, lambda e: name(e).isNull()), "edge_not_object"), (extra(edges, edge_keys), "unknown_edge_key"), (lacks(edges, edge_keys), "missing_edge_key"), (F.exists(edges, lambda e: ~F.coalesce(part(e, "kind").isin(*EDGE_KINDS), F.lit(False))), "unknown_edge_kind"),
        (F.exists(edges, lambda e: ~F.coalesce(F.array_contains(ids, part(e, "src")) & F.array_contains(ids, part(e, "dst")), F.lit(False))), "dangling_edge"),
    )


def answer_record_reason(text: Column, schema: str) -> Column:
    """An answer to a package: identity, condition, digest of the package, answer, source; nothing unsafe in it."""
    return parsed_once(text, lambda j: _answer_record_reason(j, schema))


def _answer_record_reason(j: Json, schema: str) -> Column:
    like = lambda path, pattern: ~F.coalesce(j.string(path).rlike(rf"\A(?:{pattern})\z"), F.lit(False))
    long = lambda path, n: j.blank(path) | (F.char_length(j.string(path)) > n)
    return first_reason(
        (j.not_object(), "not_object"), (F.size(j.missing(["schema", "item_id", "condition", "package_sha256", "answer", "source"])) > 0, "missing"), (F.size(j.unknown(["schema", "item_id", "condition", "package_sha256", "answer", "source"])) > 0, "unknown"),
        (~F.coalesce(j.string("$.schema") == schema, F.lit(False)) | like("$.item_id", "[A-Za-z0-9][A-Za-z0-9._-]{0,127}"), "identity"), (~F.coalesce(j.string("$.condition").isin(*CONDITIONS), F.lit(False)), "condition"),
        (like("$.package_sha256", "[a-f0-9]{64}"), "package_sha256"), (long("$.answer", 20_000), "answer"), (long("$.source", 100), "source"), (texts.unsafe(F.to_json(j.v)), "unsafe"),
    )


def generation_reason(text: Column, kind: Column, source: Column) -> tuple[Column, Column]:
    """Reason and quotation class of a generated question of the kind asked for; a quotation must stand in the source, the answer of a choice question be its option."""
    j = Json(text)
    common = ["question", "answer", "question_type", "text_evidence_quote", "visual_evidence"]
    choice = kind == "multiple_choice"
    options = j.array("$.options")
    quote = texts.quote_class(j.string("$.text_evidence_quote"), source)
    wrong = (F.coalesce(F.size(options), F.lit(0)) != CHOICES) | no_strings(options) | (F.size(F.array_distinct(F.transform(options, string_of))) != CHOICES) | j.outside("$.correct_option", 0, 3) | ~F.coalesce(string_of(options[j.integer("$.correct_option").cast("int")]) == j.string("$.answer"), F.lit(False))
    reason = first_reason(
        (~kind.isin("short_answer", "multiple_choice"), "QUESTION_TYPE"), (j.not_object(), "GENERATION"), (F.when(choice, j.not_closed([*common, "options", "correct_option"])).otherwise(j.not_closed(common)), "GENERATION"),
        (~F.coalesce(j.string("$.question_type") == kind, F.lit(False)) | j.blank("$.question") | j.blank("$.answer") | j.blank("$.text_evidence_quote"), "GENERATION"), (quote == "missing", "QUOTE_MISSING"), (quote == "non_verbatim", "QUOTE_NON_VERBATIM"), (choice & wrong, "GENERATION"),
    )
    return reason, F.when(reason.isNull(), quote)


def triplets(packages: DataFrame) -> DataFrame:
    """Per item of packages (item_id, condition, question, text, layout): the reason why they are no triplet, or null.

    One shuffle; layouts are canonical texts, which only the last two conditions have.
    """
    only = lambda c: F.max(F.when(F.col("condition") == c, F.col("layout")))
    g = packages.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("condition").alias("kinds"), F.bool_and(F.col("condition").isin(*CONDITIONS)).alias("known"), F.count_distinct("question").alias("questions"), F.count_distinct("text").alias("texts"), only("text_layout").alias("tl"), only("full_pixels").alias("tlv")
    )
    return g.select(
        "item_id", first_reason((F.col("n") != 3, "not_three"), (F.col("kinds") != 3, "duplicate_condition"), (~F.col("known"), "condition_set"), (F.col("questions") != 1, "question"), (F.col("texts") != 1, "text"), (~F.col("tl").eqNullSafe(F.col("tlv")), "layout")).alias("reason")
    )


def construction_reason(steps: Column, atoms: Column, choices: Column, final: Column) -> Column:
    """steps (inputs, output), atoms (id, value, source), choices (text, correct), id of the final atom.

    Inputs must be atoms, outputs differ, the final atom be some step's output and have a source, and
    exactly one choice be correct, with the final atom's value as its text.
    """
    ids = F.transform(atoms, lambda a: a["id"])
    outputs = F.transform(steps, lambda s: s["output"])
    end = F.filter(atoms, lambda a: a["id"] == final)
    right = F.filter(choices, lambda c: c["correct"])
    return first_reason(
        (F.size(F.array_distinct(ids)) != F.size(ids), "duplicate_atom"), (F.exists(steps, lambda s: F.size(F.array_except(s["inputs"], ids)) > 0), "unknown_input"), (F.size(F.array_distinct(outputs)) != F.size(outputs), "duplicate_output"),
        (F.size(F.array_except(outputs, ids)) > 0, "unknown_output"), (~F.array_contains(outputs, final), "final_not_produced"), (F.size(end) != 1, "final_not_atom"), (F.coalesce(end[0]["source"], F.lit("")) == "", "final_without_provenance"),
        (F.size(right) != 1, "correct_choice"), (~F.coalesce(right[0]["text"] == end[0]["value"], F.lit(False)), "choice_is_not_the_answer"),
    )


def eligibility(rows: DataFrame, key: str, **allowed: Sequence[str]) -> DataFrame:
    """One row: how many rows meet all enumerations, the least ids that do not, and ELIGIBLE only if there are rows and all do."""
    ok = F.lit(True)
    for column, values in allowed.items():
        ok &= F.coalesce(F.col(column).isin(*values), F.lit(False))
    g = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("eligible"), F.min(F.when(~ok, F.col(key))).alias("first_blocked"))
    return g.withColumn("status", F.when((F.col("n") > 0) & (F.col("n") == F.col("eligible")), "ELIGIBLE").otherwise("BLOCKED"))
