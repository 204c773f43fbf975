"""Alignment of two tokenizers: groups and links of the tokens of a text, and how often ids are linked.

A task tokenises some texts at a time and looks for the places (in bytes of space and text) where tokens of
both sides end: these cut the id lists into groups, and the last ids of a group's two sides are linked, since
one token of each side ends there. Links are counted, ranked and summed by Spark's joins and aggregations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, chunks, id_and_text, own_worker, stored, trim
from .tokens import Encoder, tokenizer_path

#: Pieces that a worker remembers for each tokenizer.
CACHE_PIECES = 500_000
CHUNK_BYTES = 1_000_000
#: Id pairs whose counts are broadcast at most (about 100 bytes each in an executor); more are joined by a shuffle.
PAIR_ROWS = 2_000_000
#: Rows over which one id pair is dealt in that shuffle.
SALT = 64


class ByteTokens(Encoder):
    """Ids of space and text by a byte-level tokenizer, special tokens as plain text."""

    def __init__(self, path: str):
        super().__init__(path, CACHE_PIECES)
        self.tokenizer.encode_special_tokens = True
        inside = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in inside]
        byte = {chr(b): b for b in inside} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * len(self.widths)
        for piece, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in piece if c in byte)
        self.pool = Pool(self.bytes)

    def spaced(self, texts: list[bytes]) -> list[np.ndarray]:
        # a letter in front keeps the text's own leading space, if any, apart from the one that is put before it
        return [np.frombuffer(x, "<u4")[1:] for x in self.encode([b"x " + x for x in texts])]


class PieceTokens(Encoder):
    """Ids of text by a SentencePiece model that puts a space before it; a word after a space is a unit of its own."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i in range(n) for x in (self.model.id_to_piece(i),)]
        self.added, self.cap = None, CACHE_PIECES
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        #: False for a model with pieces that go on over a space: then texts are encoded whole.
        self.by_word = not any("▁" in x.lstrip("▁") for x in pieces)
        self.pool = Pool(self.bytes)
        self._forget()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self.model.encode(texts, num_threads=1)] if texts else []

    def _learn(self, new: list[str]) -> None:
        ids = [np.frombuffer(x, "<u4") for x in self._whole(new)]
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids)
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        while self.rows + len(new) > len(self.starts):
            self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes))
        self.store[self.used : self.used + len(flat)] = flat
        self.starts[self.rows : self.rows + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.rows : self.rows + len(new)] = sizes
        self.used, self.rows = self.used + len(flat), self.rows + len(new)

    def spaced(self, texts: list[bytes]) -> list[np.ndarray]:
        out = self.encode(texts) if self.by_word else self._whole([x.decode() for x in texts])
        return [np.frombuffer(x, "<u4") for x in out]


class Pool:
    """The bytes of all ids side by side."""

    def __init__(self, each: list[bytes]):
        self.size = np.array([len(x) for x in each], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(each), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()


class Written:
    """Ids in decimal, each with the sign that follows it: , inside a side, | after the first side, ; after a group."""

    def __init__(self):
        self.table = np.array([f"{i}{c}" for i in range(1 << 16) for c in ",|;"], "S6").view(np.uint8).reshape(-1, 6)
        self.size = (self.table != 0).sum(1)

    def joined(self, ids: np.ndarray, sign: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All of them side by side, and where each ends."""
        at = ids * 3 + sign
        flat = self.table[at].ravel()
        return flat[flat != 0].tobytes(), np.cumsum(self.size[at])


def _groups(written: Written, ids: list[np.ndarray], ends: list[np.ndarray], upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of texts with ids and ends of both sides, each text's ends below its `upto` and from the one before: groups of each text, links of all, digests."""
    cuts = np.intersect1d(*ends)
    edge = [np.concatenate(([0], np.searchsorted(e, cuts, "right"))) for e in ends]
    group = [np.repeat(np.arange(len(cuts)), np.diff(x)) for x in edge]
    # before a token of the first side stand the other side's tokens of earlier groups; before one of the second the first side's of its own group, too
    place = [np.arange(len(ids[0])) + edge[1][group[0]], np.arange(len(ids[1])) + edge[0][group[1] + 1]]
    every, sign = np.zeros(len(ids[0]) + len(ids[1]), np.int64), np.zeros(len(ids[0]) + len(ids[1]), np.int64)
    for k in range(2):
        every[place[k]] = ids[k]
        sign[place[k][edge[k][1:] - 1]] = k + 1
    text, end = written.joined(every, sign)
    count = np.diff(np.searchsorted(cuts, upto), prepend=0)
    last = np.concatenate(([0], end))[(edge[0] + edge[1])[np.cumsum(count)]].tolist()
    digests = [hashlib.sha256(text[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip([0, *last], last)]
    return count, ids[0][edge[0][1:] - 1] << 16 | ids[1][edge[1][1:] - 1], digests


_pairs: dict[tuple[str, str], tuple[ByteTokens, PieceTokens, Written]] = {}
KIND = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>"


def _tokens(path_a: str, path_b: str):
    names = [x.split()[0] for x in KIND.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("align", _pairs.clear)
        key = (path_a, path_b)
        if key not in _pairs:
            _pairs[key] = ByteTokens(path_a), PieceTokens(path_b), Written()
        *sides, written = _pairs[key]
        row = TaskContext.get().partitionId() << 33
        none = np.zeros(0, np.int64)
        for batch in batches:
            for piece in chunks(batch, "text", CHUNK_BYTES):
                texts = as_bytes(piece.column("text"))
                ids = [x.spaced(texts) for x in sides]
                for i, text in enumerate(texts):
                    if not text or any(s.pool.joined(x[i]) != b" " + text for s, x in zip(sides, ids)):
                        for x in ids:
                            x[i] = none
                upto = np.cumsum([len(x) + 2 for x in texts])  # a text's ends go from 0 to its length + 1
                sizes = [np.array([len(y) for y in x], np.int64) for x in ids]
                flat = [np.concatenate([none, *x]).astype(np.int64) for x in ids]
                ends = []
                for s, x, n in zip(sides, flat, sizes):
                    width = np.concatenate(([0], np.cumsum(s.pool.size[x])))
                    first = np.cumsum(n) - n
                    ends.append(width[1:] + np.repeat(np.concatenate(([0], upto[:-1])) - width[first], n))
                count, links, digests = _groups(written, flat, ends, upto)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(links, pa.int64()))
                groups = pa.array(count, pa.int64())
                yield pa.record_batch([pa.array(np.arange(row, row + len(texts))), piece.column("doc_id").cast(pa.int64()), pa.array(sizes[0]), pa.array(sizes[1]), groups, groups, pa.array(digests, pa.string()), lists], names=names)
                row += len(texts)
        trim()

    return run


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Stored: row_id, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links (A id << 16 | B id of each).

    One row for each row of docs; repeated doc_ids stay apart, a null doc_id stays null. Texts that are
    null or empty, or that a tokenizer does not give back byte by byte, have no tokens. Only doc_id and
    text are read. An empty table gives an empty one. Ids of A lie below 2^16, as those of B.
    """
    return stored(id_and_text(docs).mapInArrow(_tokens(path_a or tokenizer_path(), path_b or tokenizer_path("piece_bpe_32k.model")), KIND), "links")


def link_counts(aligned: DataFrame) -> DataFrame:
    """Stored: pair (A id << 16 | B id), count, best (whether no pair of its B id has more)."""
    each = stored(aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(65535)
    most = each.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return stored(each.join(most, b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "counts")


def rated_links(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Cases as in align()."""
    aligned = align(docs, path_a, path_b)
    counts = link_counts(aligned)
    few = counts.limit(PAIR_ROWS + 1).count() <= PAIR_ROWS
    each = aligned.select("row_id", F.explode("links").alias("pair"))
    if few:
        hits = each.join(F.broadcast(counts), "pair").select("row_id", "count", "best", F.lit(1).alias("m"))
    else:  # a document's equal pairs become one row, and each pair's rows are dealt over SALT keys
        each = each.groupBy("row_id", "pair").agg(F.count(F.lit(1)).alias("m")).withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALT)))
        dealt = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        hits = each.join(dealt, ["pair", "salt"]).select("row_id", "count", "best", "m")
    sums = hits.groupBy("row_id").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("m")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.drop("links").join(sums, "row_id", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
