"""Token ids: encoding with a public tokenizer, Elias-Fano document boundaries, and packing.

Encoding: the byte-level pre-tokenizer always starts a piece at a space between two characters that
are not white space, so a text with such spaces only is the concatenation of its space-led pieces.
Each distinct piece goes through the tokenizers library once per worker and cache generation; texts
with a space at an end or next to other white space (Unicode's too), or with an added token such as
<|endoftext|>, go through the library whole.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, chunks, id_and_text, own_worker, run_hashes, shuffle_partitions, stored, trim

#: Pieces that a worker remembers before it starts afresh; bounds its memory at about 100 MB.
CACHE_PIECES = 1_500_000
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 3_000_000
#: Ids in a stored block before the next one begins (a longer document has a block of its own).
BLOCK_IDS = 1 << 20
#: Documents whose boundaries are looked up at once.
READ_DOCS = 16_384
#: Documents packed together by one task.
GROUP_PIECES = 20_000


#: White space other than the space, in UTF-8, as big-endian numbers by size.
WHITE = {n: np.array([int.from_bytes(x, "big") for c in range(0x3001) if chr(c).isspace() and c != 32 and len(x := chr(c).encode()) == n], np.uint32) for n in (1, 2, 3)}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        vocab = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in vocab.items():
            self.widths[i] = len(piece)
        self.cap = cache_pieces
        #: A comma or full stop that is one id; others are encoded with their words.
        self.marks = {m: int(np.frombuffer(x, "<u4")[0]) for m, x in zip(",.", self._whole([",", "."])) if len(x) == 4}
        self._forget()

    def _forget(self) -> None:
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and their rows below
        self.used = self.rows = 0
        self.store, self.starts, self.sizes = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids side by side, and where those of each piece begin and how many they are.

        new: pieces without their leading space, none of them empty or with a space inside.
        """
        rough = np.fromiter((x[0].isspace() or x[-1].isspace() for x in new), bool, len(new))  # these could melt with their neighbours
        smooth, odd = np.flatnonzero(~rough), np.flatnonzero(rough)
        flats, sizes = [np.zeros(0, "<u4")], np.zeros(len(new), np.int64)
        for i in range(0, len(smooth), 8192):
            own = smooth[i : i + 8192]
            part = [new[k] for k in own.tolist()]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.cumsum(self.widths[ids])
            ends = np.cumsum([1 + len(x.encode()) for x in part])
            cut = np.searchsorted(at, ends)
            assert np.array_equal(at[cut], ends)
            flats.append(ids)
            sizes[own] = np.diff(cut, prepend=-1)
        alone = [np.frombuffer(x, "<u4") for x in self._whole([" " + new[k] for k in odd.tolist()])]
        sizes[odd] = [len(x) for x in alone]
        order = np.concatenate((smooth, odd))
        starts = np.zeros(len(new), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(flats + alone), starts, sizes

    def _learn(self, new: list[str]) -> None:
        """A comma or full stop after letters is a piece of its own for the pre-tokenizer, so such words share their letters' ids."""
        mark = np.fromiter((self.marks.get(x[-1], 0) if x[:-1].isalpha() else 0 for x in new), np.int64, len(new))
        cores = [x[:-1] if m else x for x, m in zip(new, mark.tolist())]
        each = dict.fromkeys(cores)
        for i, x in enumerate(each):
            each[x] = i
        core = np.fromiter(map(each.__getitem__, cores), np.int64, len(new))
        ids, start, size = self._encode_pieces(list(each))
        start, size = start[core], size[core]
        sizes = size + (mark > 0)
        ends = np.cumsum(sizes)
        flat = np.zeros(ends[-1], "<u4")
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(ends - sizes, size) + inside] = ids[np.repeat(start, size) + inside]
        flat[ends[mark > 0] - 1] = mark[mark > 0]
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        while self.rows + len(new) > len(self.starts):
            self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes))
        self.store[self.used : self.used + len(flat)] = flat
        self.starts[self.rows : self.rows + len(new)] = self.used + ends - sizes
        self.sizes[self.rows : self.rows + len(new)] = sizes
        self.used, self.rows = self.used + len(flat), self.rows + len(new)

    def _spaced(self, texts: list[bytes]) -> set[int]:
        """Texts in which a space stands next to other white space."""
        data = np.frombuffer(b"\0\0\0" + b"\0".join(texts) + b"\0\0\0", np.uint8)
        gaps = np.flatnonzero(data == 32)
        near = np.zeros(len(gaps), bool)
        for first in (1, -1):  # what follows, and what stands before (of each size, beginning so far before the space)
            for n, white in WHITE.items():
                at = gaps + (1 if first == 1 else -n)
                code = np.zeros(len(gaps), np.uint32)
                for k in range(n):
                    code = code << np.uint32(8) | data[at + k]
                near |= np.isin(code, white)
        return set(np.searchsorted(np.cumsum([1 + len(x) for x in texts]), gaps[near] - 3, "right").tolist())

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8). Pieces are told apart by 64-bit hashes."""
        out: list[bytes] = [b""] * len(texts)
        spaced = self._spaced(texts)
        if self.added and self.added.search(b"\0".join(texts)):
            spaced |= {i for i, x in enumerate(texts) if self.added.search(x)}
        plain = [i for i, x in enumerate(texts) if x and b"  " not in x and x[0] != 32 and x[-1] != 32 and i not in spaced]
        odd = sorted(set(range(len(texts))) - set(plain))
        for i, x in zip(odd, self._whole([texts[i].decode() for i in odd])):
            out[i] = x
        if not plain:
            return out
        if self.rows > self.cap:
            self._forget()
        raw = b" ".join([texts[i] for i in plain])
        data = np.frombuffer(raw, np.uint8)
        gaps = np.flatnonzero(data == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(data))
        first = np.searchsorted(starts, np.cumsum([0] + [len(texts[i]) + 1 for i in plain[:-1]]))
        each, sample, inverse = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, each)
        known = np.zeros(len(each), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == each[inside]
        at = np.zeros(len(each), np.int64)
        at[known] = self.row[place[known]]
        missing = np.flatnonzero(~known)
        if len(missing):
            lo, hi = starts[sample[missing]].tolist(), ends[sample[missing]].tolist()
            self._learn([raw[a:b].decode() for a, b in zip(lo, hi)])
            at[missing] = np.arange(self.rows - len(missing), self.rows)
            self.keys = np.insert(self.keys, place[missing], each[missing])
            self.row = np.insert(self.row, place[missing], at[missing])
        at = at[inverse]
        heads = [np.frombuffer(x, "<u4") for x in self._whole([raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())])]
        begin, size = self.starts[at], self.sizes[at]
        size[first] = [len(x) for x in heads]
        begin[first] = self.used + np.cumsum(size[first]) - size[first]
        pool = np.concatenate((self.store[: self.used], *heads))
        total = np.cumsum(size)
        ids = pool[np.repeat(begin - total + size, size) + np.arange(total[-1])].tobytes()
        cuts = [*(4 * (total[first] - size[first])).tolist(), len(ids)]
        for i, a, b in zip(plain, cuts, cuts[1:]):
            out[i] = ids[a:b]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    own_worker("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A non-decreasing list of n integers, from 0 to `top`, in about n * (2 + log2(top / n)) bits.

    The lower bits lie side by side, the upper ones in unary. The places of every STEP-th one-bit are
    stored beside them (half a bit for each value), so select() unpacks one stretch of the unary part alone.
    """

    STEP = 64

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n, bits), np.uint8)
        for j in range(bits):
            low[:, j] = (values >> (bits - 1 - j)) & 1
        high = np.zeros((top >> bits) + n + 1, np.uint8)
        ones = (values >> bits) + np.arange(n)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.ravel()).tobytes(), np.packbits(high).tobytes(), ones[:: cls.STEP].astype("<u4"))

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.low_bits, len(self.low)], "<u8").tobytes() + self.low + self.samples.tobytes() + self.high

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, bits, size = (int(x) for x in np.frombuffer(raw[:24], "<u8"))
        mid = 24 + size + 4 * -(-n // cls.STEP)
        return cls(n, bits, raw[24 : 24 + size], raw[mid:], np.frombuffer(raw[24 + size : mid], "<u4"))

    def _low(self, lo: int, hi: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(hi - lo, np.int64)
        a, b = lo * self.low_bits, hi * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low[a // 8 : (b + 7) // 8], np.uint8))[a % 8 : a % 8 + b - a]
        return bits.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits - 1, -1, -1, dtype=np.int64))

    def stretch(self, k: int) -> np.ndarray:
        """The values from number k * STEP on, STEP of them at most: one look at a stored sample."""
        lo, hi = k * self.STEP, min(self.n, (k + 1) * self.STEP)
        at = int(self.samples[k])
        end = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high[at // 8 : -(-end // 8)], np.uint8))) + at // 8 * 8
        ones = ones[np.searchsorted(ones, at) :][: hi - lo]
        return ((ones - np.arange(lo, hi)) << self.low_bits) | self._low(lo, hi)

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.stretch(i // self.STEP)[i % self.STEP])

    def select_many(self, at: np.ndarray) -> np.ndarray:
        """The values of these numbers, which rise."""
        each, first = np.unique(at // self.STEP, return_index=True)
        parts = [self.stretch(int(k))[own % self.STEP] for k, own in zip(each, np.split(at, first[1:]))]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


# ---------------------------------------------------------------- the id files

BLOCK_SCHEMA = "part int, block int, part_start long, n_docs int, n_null int, first_id long, doc_ids binary, n_ids long, ids binary, ends binary"
#: Doc_ids of a block differ by less than this.
WIDEST = 1 << 62


def _blocks(path: str, end_id: int, block_ids: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, end = encoder(path), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        wide = len(enc.widths) > 65536
        doc_ids: list = []
        ids: list[bytes] = []
        size = start = block = 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, ids, size, start, block
            ends = np.cumsum([len(x) // 4 for x in ids])
            flat = np.frombuffer(b"".join(ids), "<u4")
            raw = (flat if wide else flat.astype("<u2")).tobytes()
            known = [x for x in doc_ids if x is not None]
            first = known[0] if known else 0
            row = {
                "part": part, "block": block, "part_start": start, "n_docs": len(ids), "n_null": len(ids) - len(known), "first_id": first,
                "doc_ids": EliasFano.encode(np.array([x - first for x in known], np.int64)).to_bytes(), "n_ids": size, "ids": raw, "ends": EliasFano.encode(ends).to_bytes(),
            }
            start, block, doc_ids, ids, size = start + size, block + 1, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            for piece in chunks(batch, "text", CHUNK_BYTES):
                for doc_id, x in zip(piece.column("doc_id").to_pylist(), enc.encode(as_bytes(piece.column("text")))):
                    known = next((y for y in doc_ids if y is not None), None) if doc_id is not None else None
                    if known is not None and doc_id - known >= WIDEST:
                        yield flush()
                    doc_ids.append(doc_id)
                    ids.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= block_ids:
                        yield flush()
        if doc_ids:
            yield flush()
        trim()

    return run


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("n_docs", pa.int32()), ("n_null", pa.int32()), ("first_id", pa.int64()), ("doc_ids", pa.binary()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary())])


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every document and store the ids in ascending doc_id order; returns the stored blocks.

    A block is a row: the concatenated ids (2 bytes each if the vocabulary allows, else 4), and two
    Elias-Fano lists, of the doc_ids (less the first; n_null documents without one stand before) and of
    the documents' ends. Parts are ranges of doc_id, blocks
    follow each other in a part, part_start counts the ids before a block in its part. Rows of one
    doc_id stay side by side, in the order of their texts' hashes; a null doc_id comes first; a null
    text is empty and has only the end id; a longer document than block_ids has a block of its own.
    Other columns are not read. No documents: no blocks.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs).repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(rows.mapInArrow(_blocks(path or tokenizer_path(), end_id, block_ids), BLOCK_SCHEMA), "ids")


def read_boundaries(blocks: DataFrame) -> DataFrame:
    """Per document of the stored blocks: doc_id, start, n_tokens and the crc32 of its ids.

    Ends and doc_ids are looked up by the select structures, a stretch at a time. Only one total per part
    goes to the driver; the number of parts is the number of shuffle partitions.
    """
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("tokens", _encoders.clear)
        for batch in batches:
            for r in batch.to_pylist():
                ends, known = EliasFano.from_bytes(r["ends"]), EliasFano.from_bytes(r["doc_ids"])
                kind = "<u2" if len(r["ids"]) == 2 * r["n_ids"] else "<u4"
                raw = memoryview(np.frombuffer(r["ids"], kind).astype("<u4").tobytes())
                last = 0
                for lo in range(0, r["n_docs"], READ_DOCS):
                    docs = np.arange(lo, min(r["n_docs"], lo + READ_DOCS))
                    stop = ends.select_many(docs)
                    start = np.concatenate(([last], stop[:-1]))
                    last = int(stop[-1])
                    ids = known.select_many(docs[docs >= r["n_null"]] - r["n_null"]) + r["first_id"]
                    doc_ids = pa.array([None] * (len(docs) - len(ids)) + ids.tolist(), pa.int64())
                    crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist())]
                    yield pa.record_batch([doc_ids, pa.array(start + base[r["part"]] + r["part_start"]), pa.array(stop - start), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


# ---------------------------------------------------------------- packing


class Tournament:
    """Bins in the order in which they were opened; each inner node knows the most room below it."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1
        while self.leaves < max(1, most):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for `size`, and the room it had."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had = room[node]
        room[node] = had - size
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            a, b = room[2 * node], room[2 * node + 1]
            most = a if a > b else b
            if room[node] == most:
                break
            room[node] = most
        return bin_, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; equal sizes keep their order."""
    tree = Tournament(capacity, len(sizes))
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    values = sizes.tolist()
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], had = tree.place(values[i])
        offsets[i] = capacity - had
    return bins, offsets


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for piece in chunks(batch, "text", CHUNK_BYTES):
                out: list[tuple] = []
                for doc_id, x in zip(piece.column("doc_id").to_pylist(), enc.encode(as_bytes(piece.column("text")))):
                    x += end
                    n = len(x) // 4
                    for at in range(0, n, capacity):
                        raw = x[4 * at : 4 * (at + capacity)]
                        out.append((doc_id, at, len(raw) // 4, zlib.crc32(raw), n, raw if with_ids else None))
                cols = list(zip(*out))
                kinds = (pa.int64(),) * 5 + (pa.binary(),)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        trim()

    return run


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = 2048, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """Pack every document's ids into sequences of `capacity` by first-fit decreasing.

    Documents are cut into whole sequences and a rest. The pieces are dealt at random (by a hash of
    doc_id, start and checksum) into groups of about `group_pieces`; each group is packed on its own
    with a tournament tree over its bins. sequence_id is the group in the upper and the bin in the
    lower 32 bits; offsets are gapless from 0. A null text is empty and has the end id alone; equal
    doc_ids are packed as separate documents; a text of any length is cut into whole pieces; other columns
    are not read; no documents give no pieces. with_ids adds the ids of
    each piece (little-endian unsigned 32-bit).
    """
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    pieces = stored(id_and_text(docs).mapInArrow(_pieces(path or tokenizer_path(), end_id, capacity, with_ids), kind), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))

    def run(group: pa.Table) -> pa.Table:
        own_worker("tokens", _encoders.clear)
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), capacity)
        key = group.column("group").to_numpy()
        return group.drop_columns(["group"]).append_column("sequence_id", pa.array((key << 32) | bins)).append_column("offset", pa.array(offsets))

    out = dealt.groupBy("group").applyInArrow(run, f"{kind}, sequence_id long, offset long")
    return out if with_ids else out.drop("ids")
