"""Queries of packages, documents, items, constructions and generation: records are made of customers, each key's remainder breaking one rule."""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import integrity
from ..operators import contracts, generation
from ..operators.records import CONDITIONS
from ._registry import query, spread, t


def _png(rgb: bytes) -> bytes:
    """An image of one pixel."""
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return bytes.fromhex(contracts.PNG) + chunk(b"IHDR", (1).to_bytes(4, "big") * 2 + bytes([8, 2, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(b"\0" + rgb)) + chunk(b"IEND", b"")


RED = _png(b"\xff\0\0")


def _n(n: int) -> Column:
    return F.col("c_custkey") % n == 0


def _either(n: int, fault, right) -> Column:
    """A literal or column instead of the right one where n divides the key."""
    return F.when(_n(n), fault).otherwise(right)


def _struct(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def _asset(byte_length: Column | int = len(RED)) -> Column:
    return _struct(encoding="base64", media_type="image/png", data=base64.b64encode(RED).decode(), byte_length=byte_length, sha256=hashlib.sha256(RED).hexdigest(), dimensions=_struct(width=1, height=1), provenance="made")


def _customers(spark, d):
    return spread(t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


def _judged(spark, d, kind: str, record: Column):
    rows = _customers(spark, d).select("c_custkey", record.alias("text"))
    return contracts.validate(rows, kind, prefix="x").select("c_custkey", "reason")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'package:question' WHEN c_custkey % 3 > 0 AND c_custkey % 11 = 0 THEN 'layout:duplicate_node' WHEN c_custkey % 3 > 0 AND c_custkey % 13 = 0 THEN 'layout:typed_edge'
WHEN c_custkey % 3 = 2 AND c_custkey % 5 = 0 THEN 'pixels:byte_length' WHEN c_custkey % 17 = 0 THEN 'package:unsafe' END AS reason FROM customer
""")
def q_validate_package(spark, d):
    node = lambda i: _struct(id=i, label="l", value="v")
    edge = _struct(id="e", type="layout_relation", source="a", target=_either(13, "z", "b"), relation="next", directed=True)
    shape = _struct(nodes=F.array(node("a"), node("b"), node(_either(11, "a", "c"))), edges=F.array(edge))
    kind = F.col("c_custkey") % 3
    evidence = _struct(text=_either(17, "see file://x", F.col("c_name")), layout=F.when(kind > 0, shape))
    condition = F.element_at(F.array(*map(F.lit, CONDITIONS)), (kind + 1).cast("int"))
    record = _struct(schema="x.condition-package.v1", item_id=F.concat(F.lit("i"), "c_custkey"), condition=condition, question=_either(7, " ", "What?"), evidence=evidence, pixel_asset=F.when(kind == 2, _asset(_either(5, 1, len(RED)))))
    return _judged(spark, d, "package", F.to_json(record))


def _document(answer_shown: int, label: int, **faults: int) -> Column:
    """A document whose layout answer is the customer's name; where a number divides the key, that fault."""
    node = lambda i, kind, value: _struct(id=i, type=kind, label=i, value=value)
    fault = lambda name, wrong, right: _either(faults[name], wrong, right) if name in faults else F.lit(right)
    texts = [node("t", fault("no_text", "layout", "text"), _either(answer_shown, F.concat(F.lit("by "), "c_name"), "some words")), node("h", "layout", "head"), node(fault("twice", "h", "c"), "layout", F.col("c_name"))]
    edge = lambda i, kind, source, target, relation, directed: _struct(id=i, type=kind, source=source, target=target, relation=relation, directed=directed)
    edges = F.array(edge("e1", "layout_relation", F.lit("h"), fault("loop", "h", "c"), "right_of", fault("undirected", False, True)), edge("e2", "visual_attachment", F.lit("t"), F.lit("p"), "seen", F.lit(True)))
    motif = lambda **f: _struct(prompt_label=_either(label, F.col("c_name"), "the head"), **f)
    asks = F.array(motif(id="m1", operation="layout_relation_value", target="h", relation=fault("lost", "left_of", "right_of"), color_map=F.lit(None).cast("map<string,string>")), motif(id="m2", operation="dominant_rgb", target="p", relation=F.lit(None).cast("string"), color_map=F.create_map(F.lit("#FF0000"), F.lit("red"))))
    # Nodes of two types of value cannot stand in one array: their texts are joined.
    picture = F.to_json(_struct(id="p", type="visual", label="p", value=_asset()))
    nodes = F.concat(F.lit("["), F.array_join(F.array(*map(F.to_json, texts), picture), ","), F.lit("]"))
    keep = {"ignoreNullFields": "false"}
    return F.concat(F.lit('{"schema":"x.normalized-document.v2","document_id":"c'), F.col("c_custkey").cast("string"), F.lit('","nodes":'), nodes, F.lit(',"edges":'), F.to_json(edges), F.lit(',"motifs":'), F.to_json(asks, keep), F.lit("}"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'node:duplicate' WHEN c_custkey % 7 = 0 THEN 'document:no_text_node' WHEN c_custkey % 11 = 0 THEN 'edge:type' WHEN c_custkey % 13 = 0 THEN 'edge:endpoints' WHEN c_custkey % 3 = 0 THEN 'motif:not_one_edge' END AS reason FROM customer
""")
def q_validate_document(spark, d):
    return _judged(spark, d, "document", _document(1 << 30, 1 << 30, twice=5, no_text=7, undirected=11, loop=13, lost=3))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'item:atom_trace' WHEN c_custkey % 7 = 0 THEN 'item:choices' WHEN c_custkey % 11 = 0 THEN 'item:answer_index' WHEN c_custkey % 13 = 0 THEN 'item:answer' WHEN c_custkey % 3 = 0 THEN 'item:rationale' END AS reason FROM customer
""")
def q_validate_constructed_item(spark, d):
    choices = F.array(F.lit("w"), F.lit("x"), F.col("c_name"), _either(7, "x", "z"))
    atoms, traces = F.array(_struct(atom_id="a", value=F.col("c_name"), kind="name")), F.array(_struct(atom_id=_either(5, "b", "a"), source_ref="s"))
    record = _struct(
        schema="x.constructed-item.v1", item_id=F.concat(F.lit("i"), "c_custkey"), package_sha256="a" * 64, motif=_struct(type="m", evidence_nodes=F.array(F.lit("n"))), derivation=F.array(F.lit("read")), answer_atoms=atoms, provenance_trace=traces,
        question="Who?", choices=choices, answer_index=_either(11, 4, 2), answer=_either(13, "x", F.col("c_name")), rationale=_either(3, "", "r"),
    )
    return _judged(spark, d, "constructed_item", F.to_json(record))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'construction:unknown_input' WHEN c_custkey % 7 = 0 THEN 'construction:final_without_provenance' WHEN c_custkey % 11 = 0 THEN 'construction:choice_is_not_the_answer' WHEN c_custkey % 3 = 0 THEN 'construction:receipt' END AS reason FROM customer
""")
def q_validate_construction_record(spark, d):
    choice = lambda i, text, atom, right: _struct(id=i, text=text, atom_id=atom, correct=right)
    body = _struct(
        schema="x.construction-record.v1", item_id=F.concat(F.lit("i"), "c_custkey"), motif=_struct(id="m", kind="k", description="d"), program=_struct(steps=F.array(_struct(id="s", operation="read", input_atom_ids=F.array(_either(5, "z", "a")), output_atom_id="b")), final_answer_atom_id="b"),
        answer_atoms=F.array(*[_struct(id=F.lit(i), value=v) for i, v in (("a", F.lit("first")), ("b", F.col("c_name")))]), provenance=F.array(_struct(id="p", atom_id=_either(7, "a", "b"), source="s")), question=_struct(text="Who?"),
        choices=F.array(choice("1", _either(11, "nobody", F.col("c_name")), "b", True), choice("2", F.lit("first"), "a", False)),
    )
    rows = _customers(spark, d).select("c_custkey", F.to_json(body).alias("body")).withColumn("receipt", F.sha2(integrity.canonical_text("body"), 256))
    signed = F.concat(F.lit('{"receipt":"'), _either(3, "0", F.col("receipt")), F.lit('",'), F.expr("substring(body, 2)"))
    return contracts.validate(rows.select("c_custkey", signed.alias("text")), "construction", prefix="x").select("c_custkey", "reason")


@query("""
SELECT 'c' || c_custkey || '-m1' AS item_id, c_name AS answer, 'What value is right of ' || CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE 'the head' END || '?' AS question,
CASE WHEN c_custkey % 7 = 0 THEN 'answer_in_question' WHEN c_custkey % 5 = 0 THEN 'answer_in_text_evidence' END AS reason, 3 AS packages FROM customer
UNION ALL SELECT 'c' || c_custkey || '-m2', 'red', 'What is the dominant exact RGB color of ' || CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE 'the head' END || '?', NULL, 3 FROM customer
""")
def q_generate_items(spark, d):
    docs = _customers(spark, d).select(_document(5, 7).alias("text")).withColumn("source_sha256", F.sha2("text", 256))
    rows = generation.items(docs, "x")
    right = [F.when(F.get_json_object("record", f"$.package_hashes.{c}") == F.sha2(c, 256), 1).otherwise(0) for c in CONDITIONS]
    return rows.select("item_id", F.get_json_object("record", "$.answer").alias("answer"), F.get_json_object("record", "$.question").alias("question"), "reason", (right[0] + right[1] + right[2]).alias("packages"))
