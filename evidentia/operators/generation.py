"""Questions generated from typed documents: the answer is frozen, then asked for, and shown under three conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import integrity
from ..functions import text as texts
from . import graph
from .records import CONDITIONS, first_reason


def evidence_text(nodes: Column) -> Column:
    """Label and value of the text nodes, a line each, in the order of their ids."""
    lines = F.array_sort(F.transform(F.filter(nodes, lambda n: n["type"] == "text"), lambda n: F.struct(n["id"].alias("i"), F.concat(n["label"], F.lit(": "), n["value"]).alias("x"))))
    return F.array_join(F.transform(lines, lambda n: n["x"]), "\n")


def layout(nodes: Column, edges: Column) -> Column:
    """The layout nodes and their typed edges, both in the order of their ids, as JSON."""
    shown = F.array_sort(F.transform(F.filter(nodes, lambda n: n["type"] == "layout"), lambda n: F.struct(n["id"].alias("id"), n["label"].alias("label"), n["value"].alias("value"))))
    typed = F.filter(edges, lambda e: e["type"] == "layout_relation")
    return F.to_json(F.struct(shown.alias("nodes"), F.array_sort(typed).alias("edges")))


def _object(**parts: Column) -> Column:
    """An object of JSON texts, those that are null left out."""
    pairs = [F.when(x.isNotNull(), F.concat(F.lit(f'"{k}":'), x)) for k, x in parts.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*pairs)), ","), F.lit("}"))


def _json(x: Column) -> Column:
    """A string as JSON; null is null."""
    quoted = F.to_json(F.array(x))
    return F.when(x.isNull(), "null").otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def items(documents: DataFrame, prefix: str) -> DataFrame:
    """Per motif of documents (text, source_sha256): document_id, item_id, motif_id, place, reason, record, receipt, and packages with their receipts by condition.

    Documents hold to their contract. The reason says why a motif gives no item: the answer stands in its
    own question or in the text that every condition shows, or no image is attached. Records and packages
    are canonical JSON. No shuffle: a motif is derived where its document stands.
    """
    parsed = graph.parse_documents(documents, ["source_sha256"])
    rows = graph.derive_answers(parsed, ["source_sha256", "nodes", "edges", "place", "m"])
    attached = F.get(F.filter("edges", lambda e: e["type"] == "visual_attachment"), F.lit(0))["target"]
    image = F.when(F.col("m.operation") == "dominant_rgb", F.col("m.target")).otherwise(attached)
    rows = rows.select(
        "document_id", "source_sha256", "motif_id", "place", "m", "answer", F.concat_ws("-", "document_id", "motif_id").alias("item_id"), F.concat(F.lit("["), F.array_join("steps", ","), F.lit("]")).alias("steps"),
        graph.question(F.col("m.operation"), F.col("m.relation"), F.col("m.prompt_label")).alias("question"), evidence_text(F.col("nodes")).alias("shown"), layout(F.col("nodes"), F.col("edges")).alias("layout"),
        F.get(F.filter("nodes", lambda n: n["id"] == image), F.lit(0))["value"].alias("asset"),
    )
    reason = first_reason(
        (texts.contains_run(F.col("answer"), F.col("question")), "answer_in_question"),
        (texts.contains_run(F.col("answer"), F.col("shown")), "answer_in_text_evidence"),
        (F.col("asset").isNull(), "no_image_attached"),
    )
    rows = rows.withColumn("reason", reason)
    for c in CONDITIONS:
        evidence = _object(text=_json(F.col("shown")), **({} if c == CONDITIONS[0] else {"layout": F.col("layout")}))
        package = _object(schema=F.lit(f'"{prefix}.condition-package.v1"'), item_id=_json(F.col("item_id")), condition=F.lit(f'"{c}"'), question=_json(F.col("question")), evidence=evidence, **({"pixel_asset": F.col("asset")} if c == CONDITIONS[2] else {}))
        rows = rows.withColumn(c, integrity.canonical_text(package)).withColumn(f"{c}_sha256", F.sha2(c, 256))
    program = _object(motif_id=_json(F.col("motif_id")), operation=_json(F.col("m.operation")), target_node_id=_json(F.col("m.target")), relation=_json(F.col("m.relation")), color_map=F.coalesce(F.to_json("m.color_map"), F.lit("null")))
    fields = dict(
        schema=F.lit(f'"{prefix}.generated-tqa.v2"'), item_id=_json(F.col("item_id")), source=_object(document_id=_json(F.col("document_id")), sha256=_json(F.col("source_sha256"))), program=program, answer=_json(F.col("answer")),
        answer_frozen_before_question=F.lit("true"), question=_json(F.col("question")), provenance_steps=F.col("steps"), package_hashes=_object(**{c: _json(F.col(f"{c}_sha256")) for c in CONDITIONS}),
    )
    rows = rows.withColumn("receipt", F.sha2(integrity.canonical_text(_object(**fields)), 256)).withColumn("record", integrity.canonical_text(_object(**fields, receipt=_json(F.col("receipt")))))
    return rows.select("document_id", "item_id", "motif_id", "place", "reason", "record", "receipt", *[x for c in CONDITIONS for x in (c, f"{c}_sha256")])


def replay(generated: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id and reason of generated records (text) against documents (text): no such motif, another answer, or other steps."""
    r = generated.select(F.get_json_object("text", "$.item_id").alias("item_id"), F.get_json_object("text", "$.source.document_id").alias("document_id"), F.get_json_object("text", "$.program.motif_id").alias("motif_id"), F.get_json_object("text", "$.answer").alias("_answer"), integrity.canonical_text(F.get_json_object("text", "$.provenance_steps")).alias("_steps"))
    again = graph.derive_answers(graph.parse_documents(documents)).select("document_id", "motif_id", "answer", integrity.canonical_text(F.concat(F.lit("["), F.array_join("steps", ","), F.lit("]"))).alias("steps"))
    reason = first_reason((F.col("answer").isNull(), "motif_absent"), (F.col("answer") != F.col("_answer"), "answer_differs"), (~F.col("steps").eqNullSafe(F.col("_steps")), "steps_differ"))
    return r.join(again, ["document_id", "motif_id"], "left").select("item_id", reason.alias("reason"))
