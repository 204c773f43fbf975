"""Closed record contracts as column expressions: the first rule that a JSON text breaks is its reason, null if none.

A contract lists what must hold of the parsed text; a rule that cannot be judged (a missing part, another
type) does not hold. Members of arrays are judged by higher-order functions, so no row leaves the JVM but for
the canonical receipts of sealed records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import integrity
from ..functions import text as texts
from .records import CONDITIONS, Json, parsed_once, string_of

#: Fixed values of the records: patterns, kinds, the PNG signature and header in hex.
IDENTITY, SHA256, RGB = "[A-Za-z0-9][A-Za-z0-9._-]{0,127}", "[a-f0-9]{64}", "#[0-9A-F]{6}"
NODE_TYPES, EDGE_TYPES = ["text", "layout", "visual"], ["layout_relation", "visual_attachment"]
OPERATIONS = ["layout_relation_value", "dominant_rgb"]
PNG, IHDR = "89504E470D0A1A0A", "49484452"

Rule = tuple[Column, "Column | str"]


def yes(holds: Column) -> Column:
    return F.coalesce(holds, F.lit(False))


def first_broken(*rules: Rule) -> Column:
    out = F.when(~yes(rules[0][0]), rules[0][1])
    for holds, reason in rules[1:]:
        out = out.when(~yes(holds), reason)
    return out


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def part(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def word(v: Column, key: str) -> Column:
    """The string under a key; null if there is none or something else."""
    return string_of(part(v, key))


def kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def whole(v: Column) -> Column:
    return F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def flag(v: Column) -> Column:
    return F.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def members(v: Column) -> Column:
    return F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def keys(v: Column) -> Column:
    """An object's keys; null for anything else. Read from the variant: written as JSON, each string would cost a writer of its own."""
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def exactly(v: Column, *names: str) -> Column:
    """An object of these keys and no others."""
    return F.sort_array(keys(v)) == F.array(*map(F.lit, sorted(names)))


def filled(s: Column, most: int = 10_000) -> Column:
    return (texts.strip(s) != "") & (F.char_length(s) <= most)


def like(s: Column, pattern: str) -> Column:
    return s.rlike(rf"\A(?:{pattern})\z")


def every(a: Column, holds: Callable[[Column], Column]) -> Column:
    return F.forall(a, lambda x: yes(holds(x)))


def differ(a: Column) -> Column:
    return F.size(F.array_distinct(a)) == F.size(a)


def within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def closed_root(j: Json, name: str, required: list[str], optional: list[str] | None = None) -> list[Rule]:
    """The text is one JSON object, without repeated keys, of the keys named."""
    missing, unknown = j.missing(required), j.unknown(required + (optional or []))
    listed = lambda a: F.array_join(F.array_sort(a), ",")
    return [
        (j.v.isNotNull() | F.json_object_keys(j.text).isNull(), "json:duplicate_key"),
        (j.v.isNotNull(), "json:invalid"),
        (kind(j.v).startswith("OBJECT"), f"{name}:not_object"),
        (F.size(missing) == 0, F.concat(F.lit(f"{name}:missing:"), listed(missing))),
        (F.size(unknown) == 0, F.concat(F.lit(f"{name}:unknown:"), listed(unknown))),
    ]


def asset_reason(asset: Column) -> Column:
    """A PNG in base64 whose length, digest and header agree with what is said of it."""
    data = word(asset, "data")
    strict = like(data, "[A-Za-z0-9+/]*={0,2}") & (F.char_length(data) % 4 == 0)

    def rules(b: Column) -> Column:
        a, raw = b["a"], b["raw"]
        big_endian = lambda at: F.conv(F.hex(F.substring(raw, at, 4)), 16, 10).cast("bigint")
        size = part(a, "dimensions")
        stated = lambda side, at: (whole(part(size, side)) == big_endian(at)) & (big_endian(at) > 0)
        return first_broken(
            (exactly(a, "encoding", "media_type", "data", "byte_length", "sha256", "dimensions", "provenance"), "pixels:keys"),
            ((word(a, "encoding") == "base64") & (word(a, "media_type") == "image/png"), "pixels:encoding"),
            (raw.isNotNull(), "pixels:base64"),
            ((F.length(raw) >= 24) & (F.hex(F.substring(raw, 1, 8)) == PNG) & (F.hex(F.substring(raw, 13, 4)) == IHDR), "pixels:png"),
            (exactly(size, "width", "height") & stated("width", 17) & stated("height", 21), "pixels:dimensions"),
            (whole(part(a, "byte_length")) == F.length(raw), "pixels:byte_length"),
            (word(a, "sha256") == F.sha2(raw, 256), "pixels:sha256"),
            (filled(word(a, "provenance"), 500), "pixels:provenance"),
        )

    return bound(F.struct(asset.alias("a"), F.when(yes(strict), F.unbase64(data)).alias("raw")), rules)


def layout_reason(layout: Column) -> Column:
    """Nodes as plain names with pairs of them as edges, or as typed objects with typed directed edges."""
    nodes = members(part(layout, "nodes"))
    plain = every(nodes, lambda n: string_of(n) != "")
    shape = F.struct(layout.alias("l"), nodes.alias("nodes"), plain.alias("plain"), F.when(plain, F.transform(nodes, string_of)).otherwise(F.transform(nodes, lambda n: word(n, "id"))).alias("ids"), members(part(layout, "edges")).alias("edges"))

    def rules(b: Column) -> Column:
        inside = lambda name: F.array_contains(b["ids"], name)
        pair = lambda e: (F.size(members(e)) == 2) & every(members(e), lambda x: inside(string_of(x)))
        node = lambda n: exactly(n, "id", "label", "value") & filled(word(n, "id"), 128) & filled(word(n, "label"), 500) & filled(word(n, "value"))
        edge = lambda e: exactly(e, "id", "type", "source", "target", "relation", "directed") & filled(word(e, "id"), 128) & filled(word(e, "relation"), 128)
        typed = lambda e: (word(e, "type") == EDGE_TYPES[0]) & flag(part(e, "directed")) & inside(word(e, "source")) & inside(word(e, "target"))
        return first_broken(
            (exactly(b["l"], "nodes", "edges"), "layout:keys"),
            (F.size(b["nodes"]) > 0, "layout:nodes"),
            (b["edges"].isNotNull(), "layout:edges"),
            (b["plain"] | every(b["nodes"], node), "layout:node"),
            (differ(b["ids"]), "layout:duplicate_node"),
            (~b["plain"] | every(b["edges"], pair), "layout:plain_edge"),
            (b["plain"] | every(b["edges"], lambda e: edge(e) & typed(e)), "layout:typed_edge"),
        )

    return bound(shape, rules)


def _package(j: Json) -> Column:
    """A question with its evidence under one of three conditions."""
    v, evidence = j.v, part(j.v, "evidence")
    condition = word(v, "condition")
    shown, seen = condition != CONDITIONS[0], condition == CONDITIONS[2]
    has = lambda o, key: F.array_contains(keys(o), key)
    layout, asset = layout_reason(part(evidence, "layout")), asset_reason(part(v, "pixel_asset"))
    return first_broken(
        *closed_root(j, "package", ["schema", "item_id", "condition", "question", "evidence"], ["pixel_asset"]),
        (like(word(v, "item_id"), IDENTITY), "package:item_id"),
        (condition.isin(*CONDITIONS), "package:condition"),
        (filled(word(v, "question"), 2000), "package:question"),
        (exactly(evidence, "text") | exactly(evidence, "text", "layout"), "evidence:keys"),
        (filled(word(evidence, "text")), "evidence:text"),
        (shown == has(evidence, "layout"), F.when(shown, "evidence:layout_missing").otherwise("evidence:layout_not_allowed")),
        (~shown | layout.isNull(), layout),
        (seen == has(v, "pixel_asset"), F.when(seen, "package:pixels_missing").otherwise("package:pixels_not_allowed")),
        (~seen | asset.isNull(), asset),
        (~texts.unsafe(F.to_json(v)), "package:unsafe"),
    )


def _document(j: Json) -> Column:
    """A typed graph of text, layout and visual nodes with motifs to ask about."""
    listed = lambda name, *fields: F.transform(members(part(j.v, name)), lambda x: F.struct(x.alias("v"), *[word(x, f).alias(f) for f in fields]))
    graph = F.struct(listed("nodes", "id", "type", "label").alias("nodes"), listed("edges", "id", "type", "source", "target", "relation").alias("edges"), listed("motifs", "id", "operation", "target", "relation").alias("motifs"))

    def rules(b: Column) -> Column:
        nodes, edges, motifs = b["nodes"], b["edges"], b["motifs"]
        ids = lambda *types: F.transform(F.filter(nodes, lambda n: n["type"].isin(*types)), lambda n: n["id"])
        node = lambda name, *types: F.array_contains(ids(*(types or NODE_TYPES)), name)
        names = lambda a: F.transform(a, lambda x: x["id"])
        broken = F.filter(F.transform(F.filter(nodes, lambda n: n["type"] == "visual"), lambda n: asset_reason(part(n["v"], "value"))), lambda r: r.isNotNull())
        followed = lambda m: F.size(F.filter(edges, lambda e: (e["type"] == EDGE_TYPES[0]) & (e["source"] == m["target"]) & (e["relation"] == m["relation"])))
        looks_up, looks_at = (lambda m: m["operation"] == OPERATIONS[0]), (lambda m: m["operation"] == OPERATIONS[1])
        absent = lambda m, key: kind(part(m["v"], key)) == "VOID"
        colours = lambda m: F.try_variant_get(part(m["v"], "color_map"), "$", "map<string,variant>")
        named = lambda c: (F.size(c) > 0) & every(F.map_keys(c), lambda k: like(k, RGB)) & every(F.map_values(c), lambda x: filled(string_of(x), 100))
        return first_broken(
            (F.size(nodes) > 0, "document:nodes"),
            (edges.isNotNull(), "document:edges"),
            (F.size(motifs) > 0, "document:motifs"),
            (every(nodes, lambda n: exactly(n["v"], "id", "type", "label", "value") & like(n["id"], IDENTITY) & filled(n["label"], 500)), "node:fields"),
            (every(nodes, lambda n: n["type"].isin(*NODE_TYPES)), "node:type"),
            (differ(names(nodes)), "node:duplicate"),
            (every(nodes, lambda n: (n["type"] == "visual") | filled(word(n["v"], "value"))), "node:value"),
            (F.size(broken) == 0, F.get(broken, F.lit(0))),
            (F.size(ids("text")) > 0, "document:no_text_node"),
            (every(edges, lambda e: exactly(e["v"], "id", "type", "source", "target", "relation", "directed") & like(e["id"], IDENTITY) & like(e["relation"], IDENTITY)), "edge:fields"),
            (differ(names(edges)), "edge:duplicate"),
            (every(edges, lambda e: e["type"].isin(*EDGE_TYPES) & flag(part(e["v"], "directed"))), "edge:type"),
            (every(edges, lambda e: node(e["source"]) & node(e["target"]) & (e["source"] != e["target"])), "edge:endpoints"),
            (every(edges, lambda e: F.when(e["type"] == EDGE_TYPES[1], node(e["target"], "visual")).otherwise(node(e["source"], "layout") & node(e["target"], "layout"))), "edge:endpoint_types"),
            (every(motifs, lambda m: exactly(m["v"], "id", "operation", "target", "relation", "prompt_label", "color_map") & like(m["id"], IDENTITY) & filled(word(m["v"], "prompt_label"), 500)), "motif:fields"),
            (differ(names(motifs)), "motif:duplicate"),
            (every(motifs, lambda m: m["operation"].isin(*OPERATIONS) & node(m["target"])), "motif:operation_or_target"),
            (every(motifs, lambda m: ~looks_up(m) | (node(m["target"], "layout") & (m["relation"] != "") & absent(m, "color_map"))), "motif:layout"),
            (every(motifs, lambda m: ~looks_up(m) | (followed(m) == 1)), "motif:not_one_edge"),
            (every(motifs, lambda m: ~looks_at(m) | (node(m["target"], "visual") & absent(m, "relation"))), "motif:visual"),
            (every(motifs, lambda m: ~looks_at(m) | named(colours(m))), "motif:color_map"),
        )

    shape = bound(graph, rules)
    return first_broken(*closed_root(j, "document", ["schema", "document_id", "nodes", "edges", "motifs"]), (like(word(j.v, "document_id"), IDENTITY), "document:document_id"), (shape.isNull(), shape))


def _constructed_item(j: Json) -> Column:
    """Four different choices, the answer among them, atoms and traces one to one."""
    v, motif = j.v, part(j.v, "motif")
    get = lambda name: members(part(v, name))
    atoms, traces, choices, at = get("answer_atoms"), get("provenance_trace"), get("choices"), whole(part(v, "answer_index"))
    named = lambda a: F.transform(a, lambda x: word(x, "atom_id"))
    strings = lambda a, most: (F.size(a) > 0) & every(a, lambda x: filled(string_of(x), most))
    return first_broken(
        *closed_root(j, "item", ["schema", "item_id", "package_sha256", "motif", "derivation", "answer_atoms", "provenance_trace", "question", "choices", "answer_index", "answer", "rationale"]),
        (like(word(v, "item_id"), IDENTITY), "item:item_id"),
        (like(word(v, "package_sha256"), SHA256), "item:package_sha256"),
        (exactly(motif, "type", "evidence_nodes") & filled(word(motif, "type"), 100) & strings(members(part(motif, "evidence_nodes")), 1 << 30), "item:motif"),
        (strings(get("derivation"), 1000), "item:derivation"),
        ((F.size(atoms) > 0) & every(atoms, lambda a: exactly(a, "atom_id", "value", "kind") & like(word(a, "atom_id"), IDENTITY) & filled(word(a, "value"), 4000) & filled(word(a, "kind"), 100)), "item:atoms"),
        (every(traces, lambda x: exactly(x, "atom_id", "source_ref") & filled(word(x, "source_ref"), 500)), "item:traces"),
        (differ(named(atoms)) & differ(named(traces)) & within(named(atoms), named(traces)) & within(named(traces), named(atoms)), "item:atom_trace"),
        (filled(word(v, "question"), 4000), "item:question"),
        ((F.size(choices) == 4) & strings(choices, 4000) & differ(F.transform(choices, string_of)), "item:choices"),
        (at.between(0, 3), "item:answer_index"),
        (word(v, "answer") == string_of(F.get(choices, at.cast("int"))), "item:answer"),
        (filled(word(v, "rationale"), 8000), "item:rationale"),
    )


def _construction(j: Json) -> Column:
    """A program over answer atoms whose last result has provenance and is the one correct choice."""
    get = lambda v, name, *fields: F.transform(members(part(v, name)), lambda x: F.struct(x.alias("v"), *[word(x, f).alias(f) for f in fields]))
    program = part(j.v, "program")
    shape = F.struct(
        get(j.v, "answer_atoms", "id", "value").alias("atoms"), get(program, "steps", "id", "operation", "output_atom_id").alias("steps"), word(program, "final_answer_atom_id").alias("final"),
        get(j.v, "provenance", "id", "atom_id", "source").alias("sources"), get(j.v, "choices", "id", "text", "atom_id").alias("choices"),
    )

    def rules(b: Column) -> Column:
        column = lambda a, f: F.transform(b[a], lambda x: x[f])
        ids = column("atoms", "id")
        fields = lambda a, *names: (F.size(b[a]) > 0) & every(b[a], lambda x: exactly(x["v"], *names) & like(x["id"], IDENTITY)) & differ(column(a, "id"))
        right = F.filter(b["choices"], lambda c: flag(part(c["v"], "correct")))
        answer = F.get(F.filter(b["atoms"], lambda a: a["id"] == b["final"]), F.lit(0))["value"]
        return first_broken(
            (fields("atoms", "id", "value") & every(b["atoms"], lambda a: filled(a["value"])), "construction:atoms"),
            (exactly(program, "steps", "final_answer_atom_id") & fields("steps", "id", "operation", "input_atom_ids", "output_atom_id") & every(b["steps"], lambda s: like(s["operation"], IDENTITY)), "construction:steps"),
            (every(b["steps"], lambda s: within(F.transform(members(part(s["v"], "input_atom_ids")), string_of), ids)), "construction:unknown_input"),
            (within(column("steps", "output_atom_id"), ids), "construction:unknown_output"),
            (differ(column("steps", "output_atom_id")), "construction:duplicate_output"),
            (F.array_contains(column("steps", "output_atom_id"), b["final"]), "construction:final_not_produced"),
            (fields("sources", "id", "atom_id", "source") & every(b["sources"], lambda s: F.array_contains(ids, s["atom_id"]) & filled(s["source"], 500)), "construction:provenance"),
            (F.array_contains(column("sources", "atom_id"), b["final"]), "construction:final_without_provenance"),
            ((F.size(b["choices"]) > 1) & fields("choices", "id", "text", "atom_id", "correct") & differ(column("choices", "text")), "construction:choices"),
            (every(b["choices"], lambda c: filled(c["text"], 1000) & F.array_contains(ids, c["atom_id"]) & flag(part(c["v"], "correct")).isNotNull()), "construction:choice"),
            ((F.size(right) == 1) & (F.get(right, F.lit(0))["atom_id"] == b["final"]), "construction:correct_choice"),
            (F.get(right, F.lit(0))["text"] == answer, "construction:choice_is_not_the_answer"),
        )

    motif, asked = part(j.v, "motif"), part(j.v, "question")
    reason = bound(shape, rules)
    return first_broken(
        *closed_root(j, "construction", ["schema", "item_id", "motif", "program", "answer_atoms", "provenance", "question", "choices", "receipt"]),
        (like(word(j.v, "item_id"), IDENTITY), "construction:item_id"),
        (exactly(motif, "id", "kind", "description") & like(word(motif, "id"), IDENTITY) & like(word(motif, "kind"), IDENTITY) & filled(word(motif, "description"), 500), "construction:motif"),
        (exactly(asked, "text") & filled(word(asked, "text"), 2000), "construction:question"),
        (reason.isNull(), reason),
    )


def _generated(j: Json) -> Column:
    """A question whose answer was frozen first, with the program and steps that give it and its packages' receipts."""
    v, source, program = j.v, part(j.v, "source"), part(j.v, "program")
    colours, hashes, steps = part(program, "color_map"), part(v, "package_hashes"), members(part(v, "provenance_steps"))
    table = F.try_variant_get(colours, "$", "map<string,variant>")
    none = lambda x: kind(x) == "VOID"
    whole_step = lambda s: exactly(s, "step_id", "operation", "inputs", "output") & like(word(s, "step_id"), IDENTITY) & filled(word(s, "operation"), 200) & kind(part(s, "inputs")).startswith("OBJECT") & kind(part(s, "output")).startswith("OBJECT")
    return first_broken(
        *closed_root(j, "generated", ["schema", "item_id", "source", "program", "answer", "answer_frozen_before_question", "question", "provenance_steps", "package_hashes", "receipt"]),
        (like(word(v, "item_id"), IDENTITY), "generated:item_id"),
        (exactly(source, "document_id", "sha256") & like(word(source, "document_id"), IDENTITY) & like(word(source, "sha256"), SHA256), "generated:source"),
        (exactly(program, "motif_id", "operation", "target_node_id", "relation", "color_map") & like(word(program, "motif_id"), IDENTITY) & like(word(program, "target_node_id"), IDENTITY), "generated:program"),
        (word(program, "operation").isin(*OPERATIONS), "generated:operation"),
        (none(part(program, "relation")) | like(word(program, "relation"), IDENTITY), "generated:relation"),
        (none(colours) | ((F.size(table) > 0) & every(F.map_keys(table), lambda k: like(k, RGB)) & every(F.map_values(table), lambda x: filled(string_of(x), 100))), "generated:color_map"),
        (filled(word(v, "answer")), "generated:answer"),
        (filled(word(v, "question"), 2000), "generated:question"),
        (flag(part(v, "answer_frozen_before_question")), "generated:answer_not_frozen"),
        ((F.size(steps) >= 2) & every(steps, whole_step), "generated:steps"),
        (exactly(hashes, *CONDITIONS) & every(F.array(*[word(hashes, c) for c in CONDITIONS]), lambda x: like(x, SHA256)), "generated:package_hashes"),
    )


#: Per kind: its contract, what follows the prefix in its schema, and the key of its receipt.
KINDS: dict[str, tuple[Callable[[Json], Column], str, str | None]] = {
    "package": (_package, "condition-package.v1", None),
    "document": (_document, "normalized-document.v2", None),
    "constructed_item": (_constructed_item, "constructed-item.v1", None),
    "construction": (_construction, "construction-record.v1", "receipt"),
    "generated": (_generated, "generated-tqa.v2", "receipt"),
}


def validate(records: DataFrame, kind: str, column: str = "text", prefix: str | None = None) -> DataFrame:
    """records with a nullable `reason`. Unknown kinds are an error. prefix: what must stand before the kind in a record's schema (None: any one name).

    Of several broken rules the first counts; the schema and, of sealed records, the receipt are judged last. A null or empty text is json:invalid.
    """
    if kind not in KINDS:
        raise ValueError(f"CONTRACT:unknown:{kind}")
    rules, suffix, sealed = KINDS[kind]
    schema = F.get_json_object(F.col(column), "$.schema")
    known = like(schema, rf"[A-Za-z0-9_-]+\Q.{suffix}\E") if prefix is None else schema == f"{prefix}.{suffix}"
    reason = F.coalesce(parsed_once(F.col(column), rules), F.when(~yes(known), f"{kind}:schema"))
    if sealed:
        reason = F.coalesce(reason, F.when(~yes(integrity.seal_holds(sealed)(column)), f"{kind}:receipt"))
    return records.withColumn("reason", reason)
