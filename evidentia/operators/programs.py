"""Typed programs over evidence: compile, execute, bind images, trace, replay, seal, and judge what was written from the seal.

A program is a row: `motif`, `condition`, `evidence`, `n_images` and `steps`, an array of
struct<op, anchor, result, visual_node, bbox>. All stages are column expressions over that row, so a table
of programs is one pass without a shuffle; anchors that are looked for in a whole corpus go through
overlap.best_matches instead. Each stage adds columns that the next one reads, so nothing is worked out twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts
from ..functions.text import python_round
from . import gates

CROSS = [m for m, (_, first) in gates.MOTIFS.items() if first == "visual"]
#: Words of the source that a question may repeat, and of a visual anchor that its stem may.
VERBATIM_RUN, STEM_RUN, RUN_LIMIT = 7, 2, 30
#: A box's share of the page, words of an observation, and openings that point instead of reporting.
BOX_MOST, BOX_LEAST, OBSERVATION_WORDS = 0.80, 0.0004, 4
PLACEHOLDERS = [
    "theo hinh", "theo so do", "theo bang", "xem hinh", "xem so do", "xem bang", "nhu hinh", "nhu so do", "trong hinh", "trong so do",
    "quan sat hinh", "quan sat so do", "hinh minh hoa", "so do minh hoa",
]
#: Operations that may read an image without a motif that asks for it.
VISUAL_OPS = ["locate", "traverse", "identify", "compare"]
EXCERPT_CHARS, COMPARED_CHARS, HASH_CHARS = 200, 60, 16

STEP = "struct<op:string,anchor:string,result:string,visual_node:int,bbox:array<double>>"


def _quoted(x: Column) -> Column:
    return F.when(x.isNull(), "None").otherwise(F.concat(F.lit("'"), x, F.lit("'")))


def _cross(motif: Column) -> Column:
    return F.coalesce(motif.isin(*CROSS), F.lit(False))


def _text(*each: str | Column) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in each])


def _once(rows: DataFrame) -> DataFrame:
    """The same rows, whose columns are worked out once for each: filters and columns on them are not merged into what made them."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def compiled(programs: DataFrame) -> DataFrame:
    """Adds compile_reason (null: sound), cross_modal and path: the visual, text and derived step of a program that joins both."""
    motif, steps = F.col("motif"), F.col("steps")
    wanted = F.coalesce(*[F.when(motif == m, op) for m, (op, _) in gates.MOTIFS.items()])
    cross = _cross(motif)
    reasons = []
    for i in range(3):
        s = F.get(steps, F.lit(i))
        op = F.lit("locate") if i < 2 else wanted
        length = F.char_length(texts.strip(F.coalesce(s["anchor"], F.lit(""))))
        visual, text = (cross if i == 0 else F.lit(False)), (cross if i == 1 else F.lit(False))
        node = s["visual_node"]
        rule = F.when(s.isNull(), f"step{i}_not_object").when(~s["op"].eqNullSafe(op), _text(f"step{i}_op_mismatch:expected=", op, ":got=", _quoted(s["op"])))
        if i < 2:
            rule = rule.when(length < F.when(visual, 1).otherwise(gates.ANCHOR_CHARS), f"step{i}_anchor_missing_or_too_short")
        rule = rule.when(texts.strip(F.coalesce(s["result"], F.lit(""))) == "", f"step{i}_result_missing")
        rule = rule.when(visual & node.isNull(), f"step{i}_visual_step_missing_visual_node").when(visual & (node < 1), _text(f"step{i}_visual_node_not_positive_int:", node))
        reasons.append(rule.when(text & node.isNotNull(), _text(f"step{i}_text_step_must_not_bind_visual:", node)))
    size = F.coalesce(F.size(steps), F.lit(-1))
    count = F.when(size != 3, _text("step_count_mismatch:expected=3:got=", F.when(size < 0, "NoneType").otherwise(size.cast("string"))))
    known = F.when(~F.coalesce(motif.isin(*gates.MOTIFS), F.lit(False)), _text("motif_not_in_catalog:", _quoted(motif)))
    out = programs.withColumn("compile_reason", F.coalesce(known, count, *reasons)).withColumn("cross_modal", cross)
    path = F.struct(F.lit(0).alias("visual_step"), F.lit(1).alias("text_step"), F.lit(2).alias("derived_step"), F.lit(True).alias("closed"))
    return out.withColumn("path", F.when(F.col("compile_reason").isNull() & F.col("cross_modal"), path))


def executed(programs: DataFrame, dropped: str | None = None) -> DataFrame:
    """Adds execution: struct<ok, reason, per_step, distinct_anchor_sentences, n_evidence_sentences, text_anchor_floor, n_visual_steps, matched>.

    Text anchors are MATCHED with the sentence (from 0) that has most of their words, the first of equals, if
    it has half of them, else UNGROUNDED; visual ones are VISUAL, and the last step is DERIVED. `dropped` names
    an array of words that do not count. Only sound programs (compiled()) have an execution.
    """
    words = lambda x: F.array_distinct(texts.legal_words(x))
    known = (lambda x: F.array_except(words(x), F.col(dropped))) if dropped else words
    sound = F.col("compile_reason").isNull()
    rows = programs.withColumn("_sentences", F.when(sound, texts.sentences(F.coalesce("evidence", F.lit("")))))
    rows = _once(rows.withColumn("_words", F.transform("_sentences", known)))
    per = []
    for i in range(2):
        anchor = F.when(sound, known(texts.strip(F.get("steps", F.lit(i))["anchor"])))
        rows = _once(rows.withColumn(f"_a{i}", anchor))
        own = F.col(f"_a{i}")
        rows = rows.withColumn(f"_common{i}", F.transform("_words", lambda w: F.size(F.array_intersect(own, w))))  # noqa: B023
        rows = rows.withColumn(f"_best{i}", F.coalesce(F.array_max(f"_common{i}"), F.lit(0)))
        at = F.when(F.col(f"_best{i}") > 0, F.array_position(F.col(f"_common{i}"), F.col(f"_best{i}")).cast("int") - 1).otherwise(-1)
        score = F.when(F.size(f"_a{i}") > 0, F.col(f"_best{i}") / F.size(f"_a{i}")).otherwise(F.lit(0.0))
        visual = F.col("cross_modal") if i == 0 else F.lit(False)
        step = F.get("steps", F.lit(i))
        status = F.when(visual, "VISUAL").when(score >= 0.5, "MATCHED").otherwise("UNGROUNDED")
        per.append(F.struct(F.lit(i).alias("index"), step["op"].alias("op"), status.alias("status"), F.when(~visual, at).alias("matched_sentence"), F.when(~visual, python_round(score, 3)).alias("match_score"), F.when(visual, step["visual_node"]).alias("visual_node")))
    last = F.struct(F.lit(2).alias("index"), F.get("steps", F.lit(2))["op"].alias("op"), F.lit("DERIVED").alias("status"), F.lit(None).cast("int").alias("matched_sentence"), F.lit(None).cast("double").alias("match_score"), F.lit(None).cast("int").alias("visual_node"))
    rows = _once(rows).withColumn("_per", F.when(sound, F.array(*per, last)))
    rows = rows.withColumn("_matched", F.array_sort(F.array_distinct(F.transform(F.filter("_per", lambda p: p.status == "MATCHED"), lambda p: p.matched_sentence))))
    ungrounded = F.size(F.filter("_per", lambda p: p.status == "UNGROUNDED"))
    floor = F.when(F.col("cross_modal"), 1).otherwise(2)
    none = F.size("_sentences") == 0
    reason = F.when(none, "evidence_has_no_sentences").when(ungrounded > 0, _text("ungrounded_steps:", ungrounded)).when(F.size("_matched") < floor, _text("anchors_not_distinct:", F.size("_matched"), "<", floor))
    out = F.struct(
        reason.isNull().alias("ok"), reason.alias("reason"), F.when(~none, F.col("_per")).alias("per_step"), F.size("_matched").alias("distinct_anchor_sentences"), F.size("_sentences").alias("n_evidence_sentences"),
        floor.alias("text_anchor_floor"), F.size(F.filter("_per", lambda p: p.status == "VISUAL")).alias("n_visual_steps"), F.col("_matched").alias("matched"),
    )
    kept = [c for c in rows.columns if not c.startswith("_") or c in programs.columns]
    return _once(rows.withColumn("execution", F.when(sound, out)).select(*kept, "execution", *[c for c in ("_sentences",) if c not in kept]))


def bound(programs: DataFrame, need_cross: bool = False) -> DataFrame:
    """Adds bind_reason: only condition TLV may, and must, bind a declared image; need_cross asks for a motif that requires one."""
    steps, cross, condition, images = F.col("steps"), F.col("cross_modal"), F.col("condition"), F.coalesce("n_images", F.lit(0))
    tied = F.filter(F.transform(steps, lambda s, i: F.struct(i.alias("i"), s["visual_node"].alias("node"), s["op"].alias("op"))), lambda x: x.node.isNotNull())
    outside = F.when(cross, _text("cross_modal_motif_outside_TLV:", condition)).when(F.size(tied) > 0, _text("visual_node_declared_outside_TLV:", condition))
    bad = F.filter(F.transform(tied, lambda x: F.when(~x.node.between(1, images), F.concat(F.lit("step"), x.i.cast("string"), F.lit("_visual_node_out_of_range:"), x.node.cast("string"))).when(~(cross & (x.i == 0)) & ~x.op.isin(*VISUAL_OPS), F.concat(F.lit("step"), x.i.cast("string"), F.lit("_op_cannot_consume_visual:"), x.op))), lambda r: r.isNotNull())
    inside = F.when(images == 0, "TLV_package_has_no_images").when(F.lit(need_cross) & ~cross, _text("TLV_motif_not_cross_modal:", F.col("motif"))).when(F.size(tied) == 0, "TLV_no_visual_binding").otherwise(F.get(bad, F.lit(0)))
    reason = F.when(F.coalesce(condition, F.lit("")) != "TLV", outside).otherwise(inside)
    return programs.withColumn("bind_reason", F.when(F.col("compile_reason").isNull(), reason))


# ---------------------------------------------------------------- traces


def json_string(x: Column) -> Column:
    """A JSON string with other letters than ASCII as they are; null: null. Escapes have lower-case digits."""
    s = F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"})
    for c in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        s = F.replace(s, F.lit(f"\\u{c:04X}"), F.lit(f"\\u{c:04x}"))
    return F.substring(s, F.lit(6), F.char_length(s) - 6)


def _number(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("null"))


def _object(*pairs: tuple[str, Column]) -> Column:
    parts: list[Column] = []
    for i, (k, v) in enumerate(pairs):
        parts += [F.lit((", " if i else "{") + f'"{k}": '), v]
    return F.concat(*parts, F.lit("}"))


def trace_payload(atoms: Column, gamma: Column) -> Column:
    """The trace as JSON with sorted keys and a space after commas and colons, which its hash is taken of."""
    atom = lambda a: _object(("atom_id", json_string(a.atom_id)), ("op", json_string(a.op)), ("step_index", _number(a.step_index)), ("value", json_string(a.value)))
    span = lambda g: F.when(g.char_span.isNull(), "null").otherwise(F.concat(F.lit("["), F.array_join(g.char_span.cast("array<string>"), ", "), F.lit("]")))
    box = lambda g: F.when(g.bbox.isNull(), "null").otherwise(F.concat(F.lit("["), F.array_join(F.transform(g.bbox, _number), ", "), F.lit("]")))
    base = lambda g: (("atom_id", json_string(g.atom_id)),)
    text = lambda g: _object(("anchor_declared", json_string(g.anchor_declared)), *base(g), ("char_span", span(g)), ("kind", json_string(g.kind)), ("match_score", _number(g.match_score)), ("sentence_index", _number(g.sentence_index)), ("source_excerpt", json_string(g.source_excerpt)), ("visual_node", _number(g.visual_node)))
    visual = lambda g: _object(("anchor_declared", json_string(g.anchor_declared)), *base(g), ("bbox", box(g)), ("char_span", F.lit("null")), ("kind", json_string(g.kind)), ("observation", json_string(g.observation)), ("sentence_index", F.lit("null")), ("visual_node", _number(g.visual_node)))
    derived = lambda g: _object(*base(g), ("char_span", F.lit("null")), ("derived_from", F.concat(F.lit("["), F.array_join(F.transform(g.derived_from, json_string), ", "), F.lit("]"))), ("kind", json_string(g.kind)), ("sentence_index", F.lit("null")), ("visual_node", F.lit("null")))
    each = F.transform(gamma, lambda g: F.when(g.kind == "text", text(g)).when(g.kind == "visual", visual(g)).otherwise(derived(g)))
    return F.concat(F.lit('{"atoms": ['), F.array_join(F.transform(atoms, atom), ", "), F.lit('], "gamma": ['), F.array_join(each, ", "), F.lit("]}"))


def trace_hash(atoms: Column, gamma: Column) -> Column:
    return F.left(F.sha2(trace_payload(atoms, gamma), 256), F.lit(HASH_CHARS))


def traced(programs: DataFrame) -> DataFrame:
    """Adds atoms, gamma and trace_hash of programs whose execution is good (others: null). Needs executed()."""
    good = F.coalesce(F.col("execution.ok"), F.lit(False))
    rows = _once(programs.withColumn("_spans", F.when(good, gates.spans(F.col("_sentences"), F.col("evidence")))))
    atoms, gamma = [], []
    for i in range(3):
        s, p = F.get("steps", F.lit(i)), F.get("execution.per_step", F.lit(i))
        name = F.lit(f"a{i}")
        atoms.append(F.struct(name.alias("atom_id"), F.lit(i).alias("step_index"), s["op"].alias("op"), texts.strip(s["result"]).alias("value")))
        visual = F.col("cross_modal") if i == 0 else F.lit(False)
        text = ~visual if i < 2 else F.lit(False)
        at = p["matched_sentence"]
        span, sentence = F.get("_spans", at), F.coalesce(F.get("_sentences", at), F.lit(""))
        place = F.when(at >= 0, F.array(span["start"], span["end"])).otherwise(F.array(F.lit(-1), F.lit(-1)))
        gamma.append(
            F.struct(
                name.alias("atom_id"), (F.when(visual, "visual").otherwise("text") if i < 2 else F.lit("derived")).alias("kind"), F.when(text, at).alias("sentence_index"), F.when(text, place).alias("char_span"), F.when(text, p["match_score"]).alias("match_score"),
                F.when(text, F.left(sentence, F.lit(EXCERPT_CHARS))).alias("source_excerpt"), (texts.strip(s["anchor"]) if i < 2 else F.lit(None).cast("string")).alias("anchor_declared"), (s["visual_node"] if i < 2 else F.lit(None).cast("int")).alias("visual_node"),
                F.when(visual, s["bbox"]).alias("bbox"), F.when(visual, texts.strip(s["result"])).alias("observation"), (F.array(F.lit("a0"), F.lit("a1")) if i == 2 else F.lit(None).cast("array<string>")).alias("derived_from"),
            )
        )
    rows = rows.withColumn("atoms", F.when(good, F.array(*atoms))).withColumn("gamma", F.when(good, F.array(*gamma)))
    return _once(_once(rows.drop("_spans")).withColumn("trace_hash", trace_hash(F.col("atoms"), F.col("gamma"))))


def _norm(x: Column) -> Column:
    return texts.strip(F.regexp_replace(F.lower(texts.nfc(x)), r"(?U)\s+", " "))


def trace_problems(atoms: Column, gamma: Column, hash_: Column, evidence: Column) -> Column:
    """What a replay finds wrong: atoms doubled, atoms and places that do not match, spans beyond the text, slices that read otherwise, a hash of other content."""
    ids = F.transform(atoms, lambda a: a.atom_id)
    places = F.array_distinct(F.transform(gamma, lambda g: g.atom_id))
    same = (F.size(F.array_except(places, ids)) == 0) & (F.size(F.array_except(ids, places)) == 0)

    def check(g: Column) -> Column:
        start, end = F.get(g.char_span, F.lit(0)), F.get(g.char_span, F.lit(1))
        shape = g.char_span.isNull() | (F.size(g.char_span) != 2) | start.isNull() | end.isNull()
        out = (start < 0) | (end <= start) | (end > F.char_length(evidence))
        head = lambda x: F.left(_norm(x), F.lit(COMPARED_CHARS))
        other = head(F.substring(evidence, start + 1, end - start)) != head(F.coalesce(g.source_excerpt, F.lit("")))
        return F.when(g.kind == "text", F.when(shape, F.concat(g.atom_id, F.lit(":bad_span"))).when(out, F.concat(g.atom_id, F.lit(":span_out_of_range"))).when(other, F.concat(g.atom_id, F.lit(":span_text_mismatch"))))

    whole = [F.when(F.size(F.array_distinct(ids)) != F.size(ids), "duplicate_atom_ids"), F.when(~same, "atom_gamma_mismatch")]
    last = [F.when(~hash_.eqNullSafe(trace_hash(atoms, gamma)), "trace_hash_mismatch")]
    return F.array_compact(F.concat(F.array(*whole), F.transform(gamma, check), F.array(*last)))


def visual_problems(gamma: Column, n_images: Column) -> Column:
    """What is wrong with each visual place: its image, its box, or an observation that reports nothing."""
    images = F.coalesce(n_images, F.lit(0))

    def check(g: Column) -> Column:
        b = g.bbox
        area = (b[2] - b[0]) * (b[3] - b[1])
        flat = texts.strip_marks(_norm(F.coalesce(g.observation, F.lit(""))))
        rules = (
            (g.visual_node.isNull(), ":visual_node_not_int"), (images == 0, ":no_declared_images"), (~g.visual_node.between(1, images), F.concat(F.lit(":visual_node_out_of_range:"), g.visual_node.cast("string"))),
            (b.isNull() | (F.size(b) != 4) | F.exists(b, lambda v: v.isNull()), ":bbox_missing_or_malformed"), (F.exists(b, lambda v: ~v.between(0.0, 1.0)), ":bbox_not_normalised"), ((b[2] <= b[0]) | (b[3] <= b[1]), ":bbox_degenerate"),
            (area >= BOX_MOST, F.concat(F.lit(":bbox_covers_whole_page:"), F.format_string("%.3f", area))), (area < BOX_LEAST, F.concat(F.lit(":bbox_too_small:"), F.format_string("%.5f", area))),
            (F.size(texts.legal_words(F.coalesce(g.observation, F.lit("")))) < OBSERVATION_WORDS, ":observation_too_short"), (F.exists(F.array(*map(F.lit, PLACEHOLDERS)), lambda p: F.startswith(flat, p)), ":observation_is_placeholder"),
        )
        out = F.when(F.lit(False), "")
        for bad, reason in rules:
            out = out.when(bad, F.concat(g.atom_id, F.lit(reason) if isinstance(reason, str) else reason))
        return out

    return F.array_compact(F.transform(F.filter(gamma, lambda g: g.kind == "visual"), check))


# ---------------------------------------------------------------- guards


def guard_plan(programs: DataFrame, dropped: str | None = None, need_cross: bool = False) -> DataFrame:
    """Adds status PLAN_OK or REJECTED and the reason of the first failed stage: compile, exec, visual, trace, visual_anchor."""
    rows = traced(bound(executed(compiled(programs), dropped), need_cross))
    rows = _once(rows.withColumn("_trace", trace_problems(F.col("atoms"), F.col("gamma"), F.col("trace_hash"), F.col("evidence"))).withColumn("_visual", visual_problems(F.col("gamma"), F.col("n_images"))))
    several = lambda c: F.when(F.size(c) > 0, F.left(F.array_join(c, ","), F.lit(80)))
    stages = (("compile:", F.col("compile_reason")), ("exec:", F.col("execution.reason")), ("visual:", F.col("bind_reason")), ("trace:", several("_trace")), ("visual_anchor:", several("_visual")))
    reason = F.coalesce(*[F.concat(F.lit(name), x) for name, x in stages])
    return rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "PLAN_OK").otherwise("REJECTED")).drop("_trace", "_visual", "_sentences")


def guard_question(programs: DataFrame, question: str = "question", dropped: str | None = None) -> DataFrame:
    """Adds status PARSED or REJECTED, reason and verbatim_run: a sound, grounded program whose question repeats at most VERBATIM_RUN words of the evidence in a row."""
    rows = executed(compiled(programs), dropped)
    good = F.coalesce(F.col("execution.ok"), F.lit(False))
    run = F.when(good, texts.longest_common_run(texts.legal_words(F.coalesce(question, F.lit(""))), texts.legal_words(F.col("evidence")), RUN_LIMIT))
    rows = rows.withColumn("verbatim_run", run)
    long = F.when(F.col("verbatim_run") > VERBATIM_RUN, _text("anti_verbatim:run=", F.col("verbatim_run"), f">{VERBATIM_RUN}"))
    reason = F.coalesce(F.concat(F.lit("compile:"), F.col("compile_reason")), F.concat(F.lit("exec:"), F.col("execution.reason")), long)
    return rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "PARSED").otherwise("REJECTED")).drop("_sentences")


def sealed(plans: DataFrame) -> DataFrame:
    """Adds seal, all that a writer of the question may see: struct<motif, condition, atoms, anchors, visual_observations, construction_hash>.

    Excerpts are cut to a number of words that all anchors together can have of this evidence. Only plans that passed have a seal.
    """
    of = lambda kind: F.filter("gamma", lambda g: g.kind == kind)
    rows = plans.withColumn("_most", gates.excerpt_budget(F.size(texts.legal_words(F.col("evidence"))), F.size(of("text"))))
    anchors = F.transform(of("text"), lambda g: F.struct(g.atom_id.alias("atom_id"), gates.truncated(F.coalesce(g.source_excerpt, F.lit("")), F.col("_most")).alias("excerpt"), g.sentence_index.alias("sentence_index")))
    seen = F.transform(of("visual"), lambda g: F.struct(g.atom_id.alias("atom_id"), g.visual_node.alias("visual_node"), g.bbox.alias("bbox"), g.anchor_declared.alias("anchor"), g.observation.alias("observation")))
    atoms = F.transform("atoms", lambda a: F.struct(a.atom_id.alias("atom_id"), a.op.alias("op"), a.value.alias("value")))
    seal = F.struct("motif", "condition", atoms.alias("atoms"), anchors.alias("anchors"), seen.alias("visual_observations"), F.col("trace_hash").alias("construction_hash"))
    return rows.withColumn("seal", F.when(F.col("status") == "PLAN_OK", seal)).drop("_most")


def guard_realized(items: DataFrame) -> DataFrame:
    """Adds realized_status and realized_reason, stem_run, verbatim_run and atom_overlap of items (seal, evidence, question, choices, answer_index)."""
    q, choices, index = F.col("question"), F.col("choices"), F.col("answer_index")
    blank = lambda x: texts.strip(F.coalesce(x, F.lit(""))) == ""
    shape = (
        F.when(q.isNull() | (q == ""), "missing:question").when(choices.isNull() | (F.size(choices) == 0), "missing:choices").when(index.isNull(), "missing:answer_index").when(blank(q), "invalid_question")
        .when((F.size(choices) != 4) | F.exists(choices, blank), "invalid_choices").when(F.size(F.array_distinct(F.transform(choices, _norm))) != 4, "choices_not_distinct").when(~index.between(0, 3), "answer_index_out_of_range")
    )
    own = texts.legal_words(F.coalesce(q, F.lit("")))
    seen = lambda v: F.when(F.coalesce(v.anchor, F.lit("")) != "", v.anchor).otherwise(F.coalesce(v.observation, F.lit("")))
    rows = items.withColumn("_shape", shape).withColumn("_q", own).withColumn("_b", texts.legal_words(F.coalesce("evidence", F.lit(""))))
    rows = rows.withColumn("stem_run", F.coalesce(F.array_max(F.transform("seal.visual_observations", lambda v: texts.longest_common_run(F.col("_q"), texts.legal_words(seen(v)), RUN_LIMIT))), F.lit(0)))
    rows = rows.withColumn("verbatim_run", texts.longest_common_run(F.col("_q"), F.col("_b"), RUN_LIMIT))
    final = F.array_distinct(texts.legal_words(F.coalesce(F.element_at("seal.atoms", -1)["value"], F.lit(""))))
    chosen = F.array_distinct(texts.legal_words(F.coalesce(F.get(choices, index), F.lit(""))))
    rows = rows.withColumn("_final", final)
    rows = rows.withColumn("atom_overlap", python_round(F.when(F.size("_final") > 0, F.size(F.array_intersect("_final", chosen)) / F.size("_final")).otherwise(F.lit(0.0)), 3))
    reason = F.coalesce("_shape", F.when(F.col("stem_run") > STEM_RUN, _text("visual_stem_leak:run=", F.col("stem_run"), f">{STEM_RUN}")), F.when(F.col("verbatim_run") > VERBATIM_RUN, _text("anti_verbatim:run=", F.col("verbatim_run"), f">{VERBATIM_RUN}")))
    rows = rows.withColumn("realized_reason", reason).withColumn("realized_status", F.when(F.col("realized_reason").isNull(), "PARSED").otherwise("REJECTED"))
    return rows.drop("_shape", "_q", "_b", "_final")
