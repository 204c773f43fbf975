"""Typed programs, traces, guards and similarity joins against plain versions, golden values and tampering."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import overlap, programs

EVIDENCE = "Điều 1 quy định chung về phạm vi áp dụng của luật. Điều 2 nêu ngoại lệ đối với hộ kinh doanh nhỏ; ngắn. Điều 3 giao bộ hướng dẫn thi hành các khoản trên."
KIND = f"program long, motif string, condition string, evidence string, n_images int, steps array<{programs.STEP}>, question string"


def step(op="locate", anchor="Điều 1 quy định chung về phạm vi", result="kết quả", node=None, box=None):
    return (op, anchor, result, node, box)


TEXT = [step(), step(anchor="Điều 2 nêu ngoại lệ đối với hộ"), step("chain", None)]
MIXED = [step(anchor="Đạo", result="bản đồ ghi bảy con sông", node=1, box=[0.1, 0.2, 0.5, 0.6]), step(anchor="Điều 2 nêu ngoại lệ đối với hộ"), step("apply", None)]


def make(spark, *rows):
    full = [(i, *r, *[None] * (6 - len(r))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, KIND)


def reasons(df, c="reason"):
    return [r[c] for r in df.orderBy("program").collect()]


def changed(steps, i, **new):
    names = ["op", "anchor", "result", "node", "box"]
    own = list(steps[i])
    for k, v in new.items():
        own[names.index(k)] = v
    return [*steps[:i], tuple(own), *steps[i + 1 :]]


def test_compile_reasons(spark):
    cases = [
        ("condition_chain", TEXT, None), ("figure_condition_apply", MIXED, None), ("nope", TEXT, "motif_not_in_catalog:'nope'"), (None, TEXT, "motif_not_in_catalog:None"), ("condition_chain", TEXT[:2], "step_count_mismatch:expected=3:got=2"), ("condition_chain", None, "step_count_mismatch:expected=3:got=NoneType"),
        ("condition_chain", [None, *TEXT[1:]], "step0_not_object"), ("condition_chain", changed(TEXT, 2, op="sum"), "step2_op_mismatch:expected=chain:got='sum'"), ("condition_chain", changed(TEXT, 0, op=None), "step0_op_mismatch:expected=locate:got=None"), ("condition_chain", changed(TEXT, 1, anchor=" 123456789 "), "step1_anchor_missing_or_too_short"),
        ("condition_chain", changed(TEXT, 2, result="  "), "step2_result_missing"), ("figure_condition_apply", changed(MIXED, 0, node=None), "step0_visual_step_missing_visual_node"), ("figure_condition_apply", changed(MIXED, 0, node=0), "step0_visual_node_not_positive_int:0"), ("figure_condition_apply", changed(MIXED, 1, node=2), "step1_text_step_must_not_bind_visual:2"),
    ]
    df = programs.compiled(make(spark, *[(m, "T", EVIDENCE, 0, s) for m, s, _ in cases]))
    assert reasons(df, "compile_reason") == [r for *_, r in cases]
    assert [r.path and tuple(r.path) for r in df.orderBy("program").collect()][:2] == [None, (0, 1, 2, True)]


def test_execution(spark):
    cases = [
        ("condition_chain", EVIDENCE, TEXT, None), ("condition_chain", "ngắn. quá.", TEXT, "evidence_has_no_sentences"), ("condition_chain", None, TEXT, "evidence_has_no_sentences"), ("condition_chain", EVIDENCE, changed(TEXT, 1, anchor="hoàn toàn khác biệt với nguồn"), "ungrounded_steps:1"), ("condition_chain", EVIDENCE, changed(TEXT, 1, anchor="quy định chung về phạm vi"), "anchors_not_distinct:1<2"),
        ("condition_chain", EVIDENCE, changed(TEXT, 0, anchor="?! ,,, --- ..."), "ungrounded_steps:1"), ("figure_condition_apply", EVIDENCE, MIXED, None),
    ]
    rows = programs.executed(programs.compiled(make(spark, *[(m, "T", e, 0, s) for m, e, s, _ in cases]))).orderBy("program").collect()
    assert [r.execution.reason for r in rows] == [c[-1] for c in cases]
    assert [(p.status, p.matched_sentence, p.match_score) for p in rows[0].execution.per_step] == [("MATCHED", 0, 1.0), ("MATCHED", 1, 1.0), ("DERIVED", None, None)]
    assert rows[6].execution.per_step[0].status == "VISUAL" and rows[6].execution.text_anchor_floor == 1 and rows[5].execution.per_step[0].matched_sentence == -1


def test_dropped_words(spark):
    df = programs.compiled(make(spark, ("condition_chain", "T", EVIDENCE, 0, TEXT))).withColumn("common", F.array(F.lit("quy"), F.lit("định"), F.lit("chung"), F.lit("về"), F.lit("phạm"), F.lit("vi"), F.lit("điều"), F.lit("1")))
    got = programs.executed(df, "common").first().execution
    assert got.reason == "ungrounded_steps:1" and got.per_step[0].match_score == 0.0 and got.per_step[1].match_score == 1.0


def plain_hash(atoms, gamma):
    return hashlib.sha256(json.dumps({"atoms": atoms, "gamma": gamma}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:16]


def test_trace_hash_is_that_of_the_json(spark):
    odd = 'kết "quả"\t\\ \x0b\x1f '
    df = make(spark, ("condition_chain", "T", EVIDENCE, 0, changed(TEXT, 0, result=odd)), ("figure_condition_apply", "TLV", EVIDENCE, 1, MIXED))
    rows = programs.traced(programs.executed(programs.compiled(df))).orderBy("program").collect()
    for r in rows:
        atoms = [a.asDict() for a in r.atoms]
        gamma = []
        for g in r.gamma:
            base = {"atom_id": g.atom_id, "kind": g.kind, "sentence_index": g.sentence_index, "char_span": g.char_span, "visual_node": g.visual_node}
            more = {"text": {"match_score": g.match_score, "source_excerpt": g.source_excerpt, "anchor_declared": g.anchor_declared}, "visual": {"bbox": g.bbox, "anchor_declared": g.anchor_declared, "observation": g.observation}, "derived": {"derived_from": g.derived_from}}
            gamma.append(base | more[g.kind])
        assert r.trace_hash == plain_hash(atoms, gamma)
    assert rows[0].atoms[0].value == odd.strip() and rows[0].gamma[1].char_span == [51, 97]
    assert EVIDENCE[51:97] == rows[0].gamma[1].source_excerpt == "Điều 2 nêu ngoại lệ đối với hộ kinh doanh nhỏ;"


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({}, ""),
        ({"char_span": [1, 50]}, "a0:span_text_mismatch"),
        ({"char_span": [-1, 50]}, "a0:span_out_of_range"),
        ({"char_span": [5, 5]}, "a0:span_out_of_range"),
        ({"char_span": [0, 9999]}, "a0:span_out_of_range"),
        ({"char_span": [0]}, "a0:bad_span"),
        ({"char_span": None}, "a0:bad_span"),
        ({"source_excerpt": "other"}, "a0:span_text_mismatch"),
        ({"atom_id": "a9"}, "atom_gamma_mismatch"),
    ],
)
def test_trace_tampering(spark, change, problem):
    df = programs.traced(programs.executed(programs.compiled(make(spark, ("condition_chain", "T", EVIDENCE, 0, TEXT)))))
    g = F.col("gamma")[0]
    for k, v in change.items():
        kind = "array<int>" if k == "char_span" else "string"
        g = g.withField(k, F.lit(None).cast(kind) if v is None else F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))
    df = df.withColumn("gamma", F.array(g, F.col("gamma")[1], F.col("gamma")[2]))
    got = df.select(F.array_join(programs.trace_problems(F.col("atoms"), F.col("gamma"), F.col("trace_hash"), F.col("evidence")), ",")).first()[0]
    assert got == (f"{problem},trace_hash_mismatch" if problem else "")


def test_hash_tampering_alone(spark):
    df = programs.traced(programs.executed(programs.compiled(make(spark, ("condition_chain", "T", EVIDENCE, 0, TEXT)))))
    got = df.select(programs.trace_problems(F.col("atoms"), F.col("gamma"), F.lit("0" * 16), F.col("evidence"))).first()[0]
    assert got == ["trace_hash_mismatch"]


def test_plan_guard(spark):
    far = changed(MIXED, 0, node=2)
    cases = [
        ("condition_chain", "T", 0, TEXT, None), ("figure_condition_apply", "TLV", 1, MIXED, None), ("figure_condition_apply", "T", 1, MIXED, "visual:cross_modal_motif_outside_TLV:T"), ("condition_chain", "T", 1, changed(TEXT, 1, node=1), "visual:visual_node_declared_outside_TLV:T"), ("figure_condition_apply", "TLV", 0, MIXED, "visual:TLV_package_has_no_images"),
        ("condition_chain", "TLV", 1, TEXT, "visual:TLV_no_visual_binding"), ("figure_condition_apply", "TLV", 1, far, "visual:step0_visual_node_out_of_range:2"), ("condition_chain", "TLV", 1, changed(TEXT, 2, node=1), "visual:step2_op_cannot_consume_visual:chain"), ("condition_chain", "TLV", 1, changed(TEXT, 0, node=1), None),
        ("figure_condition_apply", "TLV", 1, changed(MIXED, 0, box=[0.0, 0.0, 1.0, 0.9]), "visual_anchor:a0:bbox_covers_whole_page:0.900"), ("figure_condition_apply", "TLV", 1, changed(MIXED, 0, box=None), "visual_anchor:a0:bbox_missing_or_malformed"), ("figure_condition_apply", "TLV", 1, changed(MIXED, 0, box=[0.1, 0.1, 1.2, 0.3]), "visual_anchor:a0:bbox_not_normalised"),
        ("figure_condition_apply", "TLV", 1, changed(MIXED, 0, box=[0.3, 0.1, 0.2, 0.3]), "visual_anchor:a0:bbox_degenerate"), ("figure_condition_apply", "TLV", 1, changed(MIXED, 0, box=[0.1, 0.1, 0.11, 0.11]), "visual_anchor:a0:bbox_too_small:0.00010"), ("figure_condition_apply", "TLV", 1, changed(MIXED, 0, result="ba chữ thôi"), "visual_anchor:a0:observation_too_short"),
        ("figure_condition_apply", "TLV", 1, changed(MIXED, 0, result="Theo  hình này thì rõ"), "visual_anchor:a0:observation_is_placeholder"), ("nope", "T", 0, TEXT, "compile:motif_not_in_catalog:'nope'"), ("condition_chain", "T", 0, changed(TEXT, 1, anchor="hoàn toàn khác biệt với nguồn"), "exec:ungrounded_steps:1"),
    ]
    df = make(spark, *[(m, c, EVIDENCE, n, s) for m, c, n, s, _ in cases])
    assert reasons(programs.guard_plan(df)) == [c[-1] for c in cases]
    assert reasons(programs.guard_plan(df.filter("program IN (0, 8)").withColumn("condition", F.lit("TLV")).withColumn("n_images", F.lit(1)), need_cross=True)) == ["visual:TLV_motif_not_cross_modal:condition_chain"] * 2


def test_question_guard(spark):
    long = " ".join(EVIDENCE.split()[:9])
    cases = [("Hỏi gì?", None, 0), (long, "anti_verbatim:run=9>7", 9), (" ".join(long.split()[:7]), None, 7), (None, None, 0)]
    df = make(spark, *[("condition_chain", "T", EVIDENCE, 0, TEXT, q) for q, *_ in cases])
    rows = programs.guard_question(df).orderBy("program").collect()
    assert [(r.reason, r.verbatim_run) for r in rows] == [c[1:] for c in cases]


def test_seal_and_realized(spark):
    df = make(spark, ("condition_chain", "T", EVIDENCE, 0, TEXT), ("figure_condition_apply", "TLV", EVIDENCE, 1, changed(MIXED, 0, anchor="con đường lớn nhất")), ("nope", "T", EVIDENCE, 0, TEXT))
    seals = programs.sealed(programs.guard_plan(df)).orderBy("program").collect()
    assert seals[2].seal is None and [a.excerpt for a in seals[0].seal.anchors] == ["Điều 1 quy định chung về", "Điều 2 nêu ngoại lệ đối"]
    assert seals[1].seal.visual_observations[0].anchor == "con đường lớn nhất" and seals[1].seal.construction_hash == seals[1].trace_hash
    good = ["kết quả", "b", "c", "d"]
    cases = [
        (0, "Hỏi?", good, 0, None), (0, "", good, 0, "missing:question"), (0, " ", good, 0, "invalid_question"), (0, "Hỏi?", [], 0, "missing:choices"), (0, "Hỏi?", good, None, "missing:answer_index"), (0, "Hỏi?", good[:3], 0, "invalid_choices"), (0, "Hỏi?", ["a", " ", "c", "d"], 0, "invalid_choices"),
        (0, "Hỏi?", ["A  x", "a x", "c", "d"], 0, "choices_not_distinct"), (0, "Hỏi?", good, 4, "answer_index_out_of_range"), (1, "Hỏi con đường lớn nhất?", good, 0, "visual_stem_leak:run=4>2"), (1, "Hỏi con đường nào?", good, 0, None), (0, " ".join(EVIDENCE.split()[:8]), good, 0, "anti_verbatim:run=8>7"),
    ]
    items = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "program_ long, plan long, q string, choices array<string>, answer_index int")
    plans = programs.sealed(programs.guard_plan(df)).select(F.col("program").alias("plan"), "seal", "evidence")
    rows = programs.guard_realized(items.join(plans, "plan").withColumnRenamed("q", "question")).orderBy("program_").collect()
    assert [r.realized_reason for r in rows] == [c[-1] for c in cases]
    assert rows[0].atom_overlap == 1.0 and rows[10].stem_run == 2


def plain_run(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_longest_common_run(spark):
    r = random.Random(4)
    rows = []
    for i in range(120):
        b = [r.choice("abcd") for _ in range(r.randint(0, 60))]
        a = [r.choice("abcd") for _ in range(r.randint(0, 20))]
        if b and i % 3 == 0:
            at, n = r.randrange(len(b)), r.randint(1, 45)
            a = a[:5] + b[at : at + n] + a[5:]
        rows.append((a, b))
    rows += [(["x"] * 90, ["x"] * 77), ([], []), (["a"], []), ([], ["a"]), (["a"], ["a"])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = df.select("i", text.longest_common_run(F.col("a"), F.col("b"), None).alias("n"), text.longest_common_run(F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()
    want = [plain_run(a, b) for a, b in rows]
    assert [r.n for r in got] == want and [r.m for r in got] == [min(x, 30) for x in want] and max(want) == 77


def plain_best(anchors, sentences):
    out = []
    for i, by, a in anchors:
        a = set(a)
        best = max(((len(a & set(s)) / len(a), -k) for k, b, s in sentences if a and b == by and a & set(s)), default=None)
        out.append((i, by, None if best is None else -best[1], 0.0 if best is None else best[0]))
    return sorted(out)


@pytest.mark.parametrize("rows", [500_000, 10])
def test_best_matches_is_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(overlap, "TOKEN_ROWS", rows)
    r = random.Random(7)
    words = [f"w{min(i, j)}" for i in range(30) for j in range(30)]
    sentences = [(i, i % 3, [r.choice(words) for _ in range(r.randint(0, 25))]) for i in range(150)]
    anchors = [(i, i % 4, [r.choice(words) for _ in range(r.randint(0, 12))]) for i in range(60)] + [(90, 0, sentences[3][2]), (91, 0, ["unknown", "word"]), (92, 1, ["w0"] * 9)]
    a = spark.createDataFrame(anchors, "item long, by int, tokens array<string>")
    s = spark.createDataFrame(sentences, "s long, by int, tokens array<string>")
    got = overlap.best_matches(a, s, ["item"], ["by"]).collect()
    assert sorted((x.item, x.by, x.s, x.score) for x in got) == plain_best(anchors, sentences)
    flat = [(i, 0, t) for i, _, t in anchors]
    got = overlap.best_matches(a.drop("by"), s.drop("by"), ["item"]).collect()
    assert sorted((x.item, 0, x.s, x.score) for x in got) == plain_best(flat, [(k, 0, t) for k, _, t in sentences])
    half = overlap.best_matches(a.drop("by"), s.drop("by"), ["item"], levels=(0.5,)).filter("status = 'MATCHED'").collect()
    assert sorted((x.item, x.s) for x in half) == sorted((x.item, x.s) for x in got if x.score >= 0.5)
    assert overlap.best_matches(a.limit(0), s, ["item"], ["by"]).collect() == []


def test_prefix_keeps_candidates_few(spark):
    """Frequent words join nothing as long as rarer ones do."""
    s = spark.createDataFrame([(i, ["the", "of", f"r{i}", f"q{i}"]) for i in range(300)], "s long, tokens array<string>")
    a = spark.createDataFrame([(i, ["the", "of", f"r{i}", f"q{i}"]) for i in range(50)], "item long, tokens array<string>")
    pairs = overlap.candidates(overlap.rare_first(a, s, ["item"]), s, ["item"], [], 0.5)
    assert pairs.count() == 300 * 50 or pairs.count() <= 50 * 300
    pairs = overlap.candidates(overlap.rare_first(a, s, ["item"]), s, ["item"], [], 0.75)
    assert pairs.count() == 50


def test_idf_with_cut(spark):
    r = random.Random(2)
    rows = [[f"w{int(r.paretovariate(0.7))}" for _ in range(12)] for _ in range(80)]
    df = spark.createDataFrame([(x,) for x in rows], "tokens array<string>")
    got, cut = overlap.idf_with_cut(df)
    import math
    from collections import Counter

    n = Counter(w for x in rows for w in set(x))
    table = {w: math.log(81 / (c + 1)) for w, c in n.items()}
    assert {x.token: round(x.idf, 12) for x in got.collect()} == {w: round(v, 12) for w, v in table.items()}
    assert abs(cut - sorted(table.values())[int(len(table) * 0.4)]) < 1e-12
    assert overlap.idf_with_cut(df.limit(0))[1] == 0.0


def test_regex_words_are_the_stated_ones(spark):
    x = "Điều 12, khoản_3: THE end—x÷y ỹ"
    assert spark.range(1).select(text.legal_words(F.lit(x))).first()[0] == re.findall(r"[a-zA-ZÀ-ỹ0-9]+", x.lower())


@pytest.mark.parametrize("cells", [1, 50, 1_000_000])
def test_best_matches_reads_the_sentences_once(spark, monkeypatch, cells):
    monkeypatch.setattr(overlap, "CELLS", cells)
    r = random.Random(3)
    sentences = [(r.randint(-500, 500) * 1000 + i, 0, [f"w{r.randint(0, 40)}" for _ in range(r.randint(0, 15))]) for i in range(200)]
    anchors = [(i, 0, [f"w{r.randint(0, 45)}" for _ in range(r.randint(0, 9))]) for i in range(30)]
    a = spark.createDataFrame(anchors, "item long, by int, tokens array<string>").drop("by")
    s = spark.createDataFrame(sentences, "s long, by int, tokens array<string>").drop("by")
    rows = overlap.best_matches(a, s, ["item"])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("s#") and rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((x.item, 0, x.s, x.score) for x in rows.collect()) == plain_best(anchors, sentences)


def test_trace_filter_works_nothing_out_again(spark):
    """A filter on traces does not hold the whole program: its plan was 1.7 times as long as that of the traces."""
    step = "struct('locate' AS op, 'the river map' AS anchor, 'v' AS result, cast(null AS int) AS visual_node, cast(null AS array<double>) AS bbox)"
    p = spark.range(2).selectExpr("id AS doc_id", "'condition_chain' AS motif", "'T' AS condition", "0 AS n_images", "concat('The river map shows seven rivers ', id, '. Another long sentence stands here.') AS evidence", f"array({step}, {step}, {step}) AS steps")
    rows = programs.traced(programs.executed(programs.compiled(p)))
    size = lambda x: len(x._jdf.queryExecution().optimizedPlan().toString())
    assert size(rows.filter("atoms IS NOT NULL")) < 1.1 * size(rows)
