"""Answers derived from typed graphs and pixels: the two operations, with replayable steps, as joins."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSET = "struct<encoding:string,media_type:string,data:string,byte_length:long,sha256:string,dimensions:struct<width:int,height:int>,provenance:string>"
EDGE = "struct<id:string,type:string,source:string,target:string,relation:string,directed:boolean>"
MOTIF = "struct<id:string,operation:string,target:string,relation:string,prompt_label:string,color_map:map<string,string>>"


def parse_documents(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """document_id, nodes (value as text: that of a visual node is its asset's JSON), edges, motifs, and the columns of keep."""
    kind = f"struct<document_id:string,nodes:array<struct<id:string,type:string,label:string,value:string>>,edges:array<{EDGE}>,motifs:array<{MOTIF}>>"
    return records.select(F.from_json("text", kind).alias("d"), *keep).select("d.*", *keep)


def _motifs(documents: DataFrame, operation: str) -> DataFrame:
    return documents.select("*", F.posexplode("motifs").alias("place", "m")).filter(F.col("m.operation") == operation)


def png_rgb(raw: bytes) -> np.ndarray:
    """Height x width x 3 of a PNG: 8-bit RGB or RGBA, not interlaced, one million pixels at most. Anything else is an error."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("PNG:signature")
    at, body, head = 8, [], b""
    while at < len(raw):
        size, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        chunk = raw[at + 8 : at + 8 + size]
        if zlib.crc32(kind + chunk) != int.from_bytes(raw[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("PNG:crc")
        if kind == b"IHDR":
            head = chunk
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + size
    if len(head) != 13:
        raise ValueError("PNG:header")
    w, h, depth, colour, _, _, interlace = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), *head[8:13]
    if depth != 8 or colour not in (2, 6) or interlace or not 0 < w * h <= 1_000_000:
        raise ValueError("PNG:unsupported")
    n = 3 if colour == 2 else 4
    size = h * (w * n + 1)
    data = zlib.decompressobj().decompress(b"".join(body), size + 1)
    if len(data) != size:
        raise ValueError("PNG:scanlines")
    lines = np.frombuffer(data, np.uint8).reshape(h, w * n + 1)
    out, above = np.zeros((h, w, n), np.uint8), np.zeros((w, n), np.int64)
    for y, line in enumerate(lines):
        mode, row = int(line[0]), line[1:].reshape(w, n).astype(np.int64)
        if mode == 1:
            row = np.cumsum(row, 0)
        elif mode == 2:
            row = row + above
        elif mode in (3, 4):
            left = corner = np.zeros(n, np.int64)
            for x in range(w):
                up = above[x]
                if mode == 3:
                    guess = (left + up) // 2
                else:
                    gaps = np.abs(np.stack((up - corner, left - corner, left + up - 2 * corner)))
                    guess = np.choose(gaps.argmin(0), (left, up, corner))  # the first of equals, as the standard has it
                left = row[x] = (row[x] + guess) & 255
                corner = up
        elif mode:
            raise ValueError("PNG:filter")
        above = row & 255
        out[y] = above
    return out[:, :, :3]


@F.udtf(returnType=T.StructType([T.StructField(c, T.IntegerType()) for c in "yxrgb"]))
class Pixels:
    """Pixels of a PNG, a row each, for queries that need them all; a null has none."""

    def eval(self, raw: bytes):
        if raw is not None:
            rgb = png_rgb(bytes(raw))
            for y, line in enumerate(rgb.tolist()):
                for x, (r, g, b) in enumerate(line):
                    yield y, x, r, g, b


@F.pandas_udf(T.StructType([T.StructField("rgb", T.StringType()), T.StructField("count", T.LongType()), T.StructField("pixels", T.LongType())]))
def dominant_colour(raw: pd.Series) -> pd.DataFrame:
    """The most frequent exact colour of an image (the smallest of equals), how often it stands there, and the image's pixels."""
    rows = []
    for x in raw:
        if x is None:
            rows.append((None, None, None))
            continue
        flat = png_rgb(bytes(x)).reshape(-1, 3).astype(np.int64) @ np.array([65536, 256, 1])
        values, counts = np.unique(flat, return_counts=True)
        rows.append((f"#{int(values[counts.argmax()]):06X}", int(counts.max()), len(flat)))
    return pd.DataFrame(rows, columns=["rgb", "count", "pixels"])


def _step(number: int, operation: str, inputs: dict[str, Column], output: dict[str, Column]) -> Column:
    """A step as JSON, with numbers as numbers."""
    fields = lambda d: F.struct(*[v.alias(k) for k, v in d.items()])
    return F.to_json(F.struct(F.lit(f"s{number}").alias("step_id"), F.lit(operation).alias("operation"), fields(inputs).alias("inputs"), fields(output).alias("output")))


def layout_answers(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """document_id, motif_id, answer, steps (a JSON text each) and the columns of keep of the motifs that follow one typed directed edge: edges looked up inside the document."""
    motifs = _motifs(documents, "layout_relation_value")
    edge = F.filter("edges", lambda e: (e.type == "layout_relation") & (e.source == F.col("m.target")) & (e.relation == F.col("m.relation")))
    found = motifs.withColumn("e", F.get(edge, F.lit(0)))
    answer = F.get(F.filter("nodes", lambda n: n.id == F.col("e.target")), F.lit(0)).value
    steps = F.array(
        _step(1, "select_typed_directed_edge", {"source_node_id": F.col("m.target"), "edge_type": F.lit("layout_relation"), "relation": F.col("m.relation")}, {"edge_id": F.col("e.id"), "target_node_id": F.col("e.target")}),
        _step(2, "read_node_value", {"node_id": F.col("e.target"), "field": F.lit("value")}, {"answer": answer}),
    )
    return found.select("document_id", F.col("m.id").alias("motif_id"), answer.alias("answer"), steps.alias("steps"), *keep)


def colour_answers(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """document_id, motif_id, answer, steps and the columns of keep of the motifs that name an image's most frequent exact colour (the smallest of equals); a colour without a name is an error."""
    motifs = _motifs(documents, "dominant_rgb")
    asset = F.from_json(F.get(F.filter("nodes", lambda n: n.id == F.col("m.target")), F.lit(0)).value, ASSET)
    images = motifs.withColumn("asset", asset).withColumn("c", dominant_colour(F.unbase64("asset.data")))
    named = F.try_element_at("m.color_map", "c.rgb")
    answer = F.coalesce(named, F.raise_error(F.concat(F.lit("COLOUR:not in the map: "), F.coalesce("c.rgb", F.lit("none")))))
    steps = F.array(
        _step(1, "decode_png_rgb_pixels", {"node_id": F.col("m.target"), "asset_sha256": F.col("asset.sha256")}, {"pixel_count": F.col("c.pixels")}),
        _step(2, "count_exact_rgb", {"tie_break": F.lit("lexicographically_smallest_rgb")}, {"rgb": F.col("c.rgb"), "count": F.col("c.count")}),
        _step(3, "map_rgb_to_label", {"rgb": F.col("c.rgb")}, {"answer": named}),
    )
    return images.select("document_id", F.col("m.id").alias("motif_id"), answer.alias("answer"), steps.alias("steps"), *keep)


def replayed(recorded: DataFrame, documents: DataFrame) -> DataFrame:
    """Recorded answers (document_id, motif_id, answer) with what a second derivation gives: same, differs, or not derivable."""
    again = derive_answers(documents).select("document_id", "motif_id", F.col("answer").alias("_again"))
    state = F.when(F.col("_again").isNull(), "not_derivable").when(F.col("_again") == F.col("answer"), "same").otherwise("differs")
    return recorded.join(again, ["document_id", "motif_id"], "left").withColumn("replay", state).drop("_again")


def derive_answers(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Answers of both operations. keep: columns of documents, `place` (of the motif in its list) or `m` (the motif)."""
    return layout_answers(documents, keep).unionByName(colour_answers(documents, keep))


# The two question templates.
def question(operation, relation, label):
    return F.when(operation == "layout_relation_value", F.concat(F.lit("What value is "), F.replace(relation, F.lit("_"), F.lit(" ")), F.lit(" "), label, F.lit("?"))).otherwise(F.concat(F.lit("What is the dominant exact RGB color of "), label, F.lit("?")))
