import json
import shutil

import pytest

from evidentia import artifacts, cli
from evidentia.functions import integrity

from .test_reference_ops import _document


def written(path, doc):
    path.write_text(json.dumps(doc))
    return str(path)


def document():
    d = _document()
    d["edges"].append({"id": "seen", "type": "visual_attachment", "source": "t", "target": "pic", "relation": "shown_by", "directed": True})
    return d


def test_generate_and_validate(spark, tmp_path):
    source, out = written(tmp_path / "d.json", document()), tmp_path / "out"
    made = artifacts.generate(spark, source, str(out))
    assert made["item_count"] == 2 and artifacts.validate_generated(spark, str(out), source)["receipt"] == made["receipt"]
    record = json.loads((out / "items/d1-m1/tqa.json").read_text())
    assert record["answer"] == "42" and record["question"] == "What value is right of it?" and record["answer_frozen_before_question"]
    assert [s["operation"] for s in record["provenance_steps"]] == ["select_typed_directed_edge", "read_node_value"]
    seen = json.loads((out / "items/d1-m2/packages/full_pixels.json").read_text())
    assert seen["evidence"]["layout"]["edges"] == [document()["edges"][0]] and seen["pixel_asset"] == document()["nodes"][4]["value"] and seen["evidence"]["text"] == "t: words"
    assert json.loads((out / "items/d1-m2/tqa.json").read_text())["provenance_steps"][1] == {"step_id": "s2", "operation": "count_exact_rgb", "inputs": {"tie_break": "lexicographically_smallest_rgb"}, "output": {"rgb": "#FF0000", "count": 3}}
    with pytest.raises(ValueError, match="not empty"):
        artifacts.generate(spark, source, str(out))
    assert artifacts.generate(spark, source, str(out), replace=True) == made and sorted(p.name for p in tmp_path.iterdir()) == ["d.json", "out"]


@pytest.mark.parametrize("change, reason", [(lambda d: d["nodes"][0].update(value="it is 42 here"), "answer_in_text_evidence"), (lambda d: d["motifs"][0].update(prompt_label="42"), "answer_in_question"), (lambda d: d["edges"].pop(), "no_image_attached"), (lambda d: d["edges"][0].update(directed=False), "edge:type")])
def test_nothing_is_left_of_a_failed_generation(spark, tmp_path, change, reason):
    d = document()
    change(d)
    with pytest.raises(ValueError, match=reason):
        artifacts.generate(spark, written(tmp_path / "d.json", d), str(tmp_path / "out"))
    assert [p.name for p in tmp_path.iterdir()] == ["d.json"]


def test_tampering_is_found(spark, tmp_path):
    source, out = written(tmp_path / "d.json", document()), tmp_path / "out"
    artifacts.generate(spark, source, str(out))

    def tampered(name, change, reason, reseal=False, source=None):
        copy = tmp_path / "copy"
        shutil.copytree(out, copy)
        record = json.loads((copy / name).read_text())
        change(record)
        (copy / name).write_text(json.dumps(artifacts.sealed(record, "receipt") if reseal else record))
        with pytest.raises(ValueError, match=reason):
            artifacts.validate_generated(spark, str(copy), source)
        shutil.rmtree(copy)

    tampered("items/d1-m1/tqa.json", lambda r: r.update(answer="17"), "generated:receipt")
    tampered("items/d1-m1/tqa.json", lambda r: r.update(answer="17"), "receipt", reseal=True)
    tampered("items/d1-m1/packages/text_only.json", lambda r: r.update(question="other"), "receipt")
    tampered("manifest.json", lambda r: r["items"].pop(), "MANIFEST:receipt")
    tampered("manifest.json", lambda r: r["items"].pop(), "stale", reseal=True)
    tampered("manifest.json", lambda r: r["items"][0].update(tqa_path="../x"), "outside", reseal=True)
    tampered("manifest.json", lambda r: r["source"].update(document_id="other"), "source", reseal=True)
    (out / "more.json").write_text("{}")
    with pytest.raises(ValueError, match="stale"):
        artifacts.validate_generated(spark, str(out), source)


def test_replay_finds_another_answer(spark, tmp_path):
    from evidentia.operators import generation

    doc = document()
    docs = spark.createDataFrame([(json.dumps(doc), "a" * 64)], "text string, source_sha256 string")
    made = [json.loads(r.record) for r in generation.items(docs, "x").collect()]
    made[0]["answer"] = "other"
    made.append(json.loads(json.dumps(made[1])) | {"item_id": "lost"})
    made[-1]["program"]["motif_id"] = "none"
    again = generation.replay(spark.createDataFrame([(json.dumps(r),) for r in made], "text string"), docs)
    assert {r.item_id: r.reason for r in again.collect()} == {made[0]["item_id"]: "answer_differs", made[1]["item_id"]: None, "lost": "motif_absent"}


def test_inventory_and_statistics(spark, tmp_path):
    row = lambda i, **more: {"candidate_id": i, "rights_status": "CLEARED", "text_leakage_status": "AUDITED_PASS", "source_disjoint_split": "DISJOINT", "human_adjudication_status": "ADJUDICATED"} | more
    inventory = {"schema": "x.conference-eval.inventory.v1", "records": [row("a"), row("b")], "shortlist": {"count": 2}}
    path = written(tmp_path / "i.json", inventory)
    checked = artifacts.validate_inventory(path)
    assert checked["status"] == "ELIGIBLE" and cli.main(["validate-real-inventory", path]) == 0
    written(tmp_path / "i.json", inventory | {"records": [row("a"), row("b", rights_status="UNKNOWN")]})
    assert artifacts.validate_inventory(path)["eligible_candidate_ids"] == ["a"] and cli.main(["validate-real-inventory", path]) == 2
    judged = artifacts.sealed({"schema": "x.adjudication-manifest.v1", "status": "COMPLETED", "candidate_ids": ["a", "b"], "blinded": True, "annotator_count": 2}, "adjudication_sha256")
    item = lambda i, method, ok, **more: {"item_id": i, "document_id": "d", "method": method, "candidate_id": i, "eligibility_status": "ELIGIBLE", "annotation_status": "ADJUDICATED", "answer_correct": ok} | more
    links = {"eligibility_validation_sha256": checked["validation_sha256"], "adjudication_manifest_sha256": judged["adjudication_sha256"]}

    def rates(*items):
        results = {"schema": "x.adjudicated-results.v1", "items": list(items)} | links
        return artifacts.adjudicated_statistics(spark, written(tmp_path / "r.json", results), str(tmp_path / "s.json"), written(tmp_path / "v.json", checked), written(tmp_path / "j.json", judged))

    out = rates(item("a", "direct", True), item("b", "direct", False), item("a", "full", True))
    assert [(m["method"], m["n"], m["answer_correct_rate"], m["status"]) for m in out["methods"]] == [("direct", 2, 0.5, "DESCRIPTIVE"), ("answer_first", 0, None, "NO_ELIGIBLE_ROWS"), ("full", 1, 1.0, "DESCRIPTIVE")]
    assert json.loads((tmp_path / "s.json").read_text()) == out and integrity.receipt({k: v for k, v in out.items() if k != "report_sha256"}) == out["report_sha256"]
    for bad, reason in ((item("a", "direct", 1), "answer_correct"), (item("z", "direct", True), "not_linked"), (item("a", "none", True), "unknown_method"), (item("a", "full", True, annotation_status="PROVISIONAL"), "not_adjudicated"), (item("b", "full", True, item_id=""), "identity")):
        with pytest.raises(ValueError, match=reason):
            rates(item("a", "direct", True), bad)
    with pytest.raises(ValueError, match="duplicate"):
        rates(item("a", "direct", True), item("a", "direct", False))
