"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

The lattice of a text has a node before and after each byte and an edge for each piece; a mark stands
before the text and for each space. A piece's score is ln(piece id + 2) below zero (pieces stand by
falling frequency in the model), a byte falls back to its byte piece at BYTE_COST. A mark has no byte
pieces, so what decode() returns is the text, literal marks included.

Two bytes that stand side by side in no piece are a cut that no edge crosses, so the lattice is a chain
of the lattices of the units between such cuts. Forward Viterbi scores are computed for all different
units of a batch side by side, a byte at a time, with the ids of the best path. With the backward scores
they give for each unit how much its second best segmentation loses. The n best segmentations of a text
differ from the best in at most n - 1 units, namely those of least loss (fewer than n units can change,
and a change in any other unit comes later). For these a backward A-star search with the forward scores
as exact heuristic lists the n best paths, which are joined and spliced into the ids of the whole text.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import SPACE, TABLE, U64, as_bytes, bounds, chunks, id_and_text, mix, own_worker, powers, run_hashes

MARK = "▁".encode()
#: Costs are integers, so that ties are exact: a thousandth of a nat.
UNIT, BYTE_COST = 1000, 30_000
CHUNK_BYTES = 1_500_000
#: Bytes that UTF-8 never has stand for those of a mark that is in the text itself.
LITERAL = b"\xf5\xf6\xf7"
#: Cells of a batch's Viterbi table; units are searched one by one where fewer than FEW share a table.
CELLS, FEW = 1_300_000, 64
#: Size code of a byte piece.
BYTE = 255
FAR = np.int64(1) << 44


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[bytes, int] = {}
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw = piece.encode()
                self.ids[raw] = i
        self.bytes_of = {i: p.replace(MARK, b" ") for p, i in self.ids.items()} | {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.byte_ids[list(LITERAL)] = self.byte_ids[list(MARK)]
        #: Whether two bytes stand side by side in some piece.
        self.joined = np.zeros((256, 256), bool)
        for p in self.ids:
            raw = p.replace(MARK, b" ")
            self.joined[list(raw[:-1]), list(raw[1:])] = True
        self.longest = max(map(len, self.ids))
        self.costs = {p: int(round(UNIT * np.log(i + 2.0))) for p, i in self.ids.items()}
        #: For each size in bytes the sorted hashes of the pieces of that size, and their costs and ids.
        self.of_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in range(1, self.longest + 1):
            own = [p for p in self.ids if len(p) == size]
            if own:
                starts = np.arange(len(own)) * size
                keys = run_hashes(np.frombuffer(b"".join(own), np.uint8), starts, starts + size)
                order = np.argsort(keys)
                self.of_size[size] = keys[order], np.array([self.costs[p] for p in own], np.int64)[order], np.array([self.ids[p] for p in own], np.int64)[order]

    def edges_to(self, word: bytes, j: int, in_mark: bytearray) -> Iterator[tuple[int, int, int]]:
        """(start, id, cost) of the edges that end at j."""
        for size in self.of_size:
            if size > j:
                break
            k = self.ids.get(piece := word[j - size : j])
            if k is not None:
                yield j - size, k, self.costs[piece]
        if not in_mark[j - 1]:
            yield j - 1, int(self.byte_ids[word[j - 1]]), BYTE_COST

    def edges(self, word: bytes) -> list[list[tuple[int, int, int]]]:
        """For each end position: (start, id, cost)."""
        inside = mark_bytes(word)
        return [[]] + [list(self.edges_to(word, j, inside)) for j in range(1, len(word) + 1)]


def mark_bytes(word: bytes) -> bytearray:
    """1 for each byte of a mark."""
    return bytearray(word.replace(b"\1", b"\0").replace(MARK, b"\1" * len(MARK)).translate(bytes(int(b == 1) for b in range(256))))


def best(words: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Cost of each word's best segmentation, what its second best loses (FAR or more: there is none), and (pieces of each best, their ids side by side).

    words: bytes, one row per word, by rising size. Ties go to the least ids, read from the last.
    """
    n, width = words.shape
    every = np.arange(n)
    up, down = powers(width + 1)
    ahead = np.zeros((width + 1, n), np.uint64)
    np.cumsum(TABLE[words.T] * up[:width, None], axis=0, out=ahead[1:])
    byte_cost = np.full((width, n), BYTE_COST, np.int64)
    marks = np.all([words.T[k : max(0, width - len(MARK) + 1 + k)] == b for k, b in enumerate(MARK)], axis=0)
    for k in range(len(MARK)):
        byte_cost[k : k + len(marks)][marks] = FAR
    low: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    forward = np.full((width + 1, n), FAR)
    forward[0] = 0
    last, back = np.zeros((width + 1, n), np.int32), np.zeros((width + 1, n), np.uint8)  # the best path's last piece, and its size (BYTE: a byte piece)
    first = np.searchsorted(sizes, np.arange(width + 1)).tolist()
    for j in range(1, width + 1):
        a = first[j]
        value, ids, size_of = forward[j - 1, a:] + byte_cost[j - 1, a:], pieces.byte_ids[words[a:, j - 1]], np.full(n - a, BYTE, np.uint8)
        for size, (keys, costs, own_ids) in pieces.of_size.items():
            if size > j:
                break
            i = j - size
            h = mix((ahead[j, a:] - ahead[i, a:]) * down[i] + U64(size))
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            hit = np.flatnonzero(keys[at] == h)
            if not len(hit):
                continue
            cost, k = costs[at[hit]], own_ids[at[hit]]
            low[i, j] = a + hit, cost
            new = forward[i, a + hit] + cost
            take = (new < value[hit]) | (new == value[hit]) & (k < ids[hit])
            value[hit[take]], ids[hit[take]], size_of[hit[take]] = new[take], k[take], size
        forward[j, a:], last[j, a:], back[j, a:] = value, ids, size_of
    backward = np.full((width + 1, n), FAR)
    backward[sizes, every] = 0
    for j in range(width, 0, -1):
        a = first[j]
        np.minimum(backward[j - 1, a:], backward[j, a:] + byte_cost[j - 1, a:], out=backward[j - 1, a:])
        for size in pieces.of_size:
            if (j - size, j) in low:
                who, cost = low[j - size, j]
                backward[j - size, who] = np.minimum(backward[j - size, who], backward[j, who] + cost)
    total = forward[sizes, every]
    # the second best path leaves the best one by some edge: the least cost of a path through an edge that is not on it
    on_best = np.zeros((width + 1, n), np.uint8)
    count, steps = np.zeros(n, np.int64), []
    place, who = sizes.astype(np.int64), every
    while len(who):
        j = place[who]
        on_best[j, who] = back[j, who]
        steps.append((who, last[j, who]))
        count[who] += 1
        place[who] = j - np.where(back[j, who] == BYTE, 1, back[j, who])
        who = who[place[who] > 0]
    ends = np.cumsum(count)
    flat = np.zeros(count.sum(), np.int32)
    for k, (who, ids) in enumerate(steps):
        flat[ends[who] - 1 - k] = ids
    second = np.full(n, FAR)
    for (i, j), (rows, cost) in low.items():
        off = on_best[j, rows] != j - i
        rows = rows[off]
        second[rows] = np.minimum(second[rows], forward[i, rows] + cost[off] + backward[j, rows])
    for j in range(1, width + 1):
        rows = first[j] + np.flatnonzero(on_best[j, first[j] :] != BYTE)
        second[rows] = np.minimum(second[rows], forward[j - 1, rows] + byte_cost[j - 1, rows] + backward[j, rows])
    return total, np.where(second < FAR, second - total, FAR), (count, flat)


class _Path:
    """Ids from the last one, shared with the paths that go on from it; compared as tuples of ids, in steps of growing length."""

    __slots__ = ("up", "id", "depth", "jump")

    def __init__(self, up: _Path | None = None, k: int = -1):
        self.up, self.id = up, k
        if up is None:
            self.depth, self.jump = 0, self
        else:
            self.depth, far = up.depth + 1, up.jump
            self.jump = far.jump if up.depth - far.depth == far.depth - far.jump.depth else up

    def _at(self, depth: int) -> _Path:
        x = self
        while x.depth > depth:
            x = x.jump if x.jump.depth >= depth else x.up
        return x

    def __lt__(self, other: _Path) -> bool:
        depth = min(self.depth, other.depth)
        x, y = self._at(depth), other._at(depth)
        if x is y:
            return self.depth < other.depth
        while x.up is not y.up:
            x, y = (x.jump, y.jump) if x.jump is not y.jump else (x.up, y.up)
        return x.id < y.id

    def ids(self) -> list[int]:
        out, x = [], self
        while x.up is not None:
            out.append(x.id)
            x = x.up
        return out


def n_best(word: bytes, pieces: Pieces, n: int) -> list[tuple[int, list[int]]]:
    """The n cheapest segmentations (cost, ids), ties by ids from the last one.

    Forward Viterbi, then A-star from the end. A path in the heap is a prefix (from the end) of its
    completions and its total is exact, so complete paths leave the heap in the order stated.
    """
    inside, far = mark_bytes(word), 1 << 60
    ahead = [0] + [far] * len(word)
    for j in range(1, len(word) + 1):
        ahead[j] = min((ahead[i] + c for i, _, c in pieces.edges_to(word, j, inside)), default=far)
    heap = [(ahead[-1], _Path(), len(word), 0)]
    out: list[tuple[int, list[int]]] = []
    while heap and len(out) < n:
        total, path, j, cost = heapq.heappop(heap)
        if j == 0:
            out.append((total, path.ids()))
            continue
        for i, k, c in pieces.edges_to(word, j, inside):
            if ahead[i] < far:
                heapq.heappush(heap, (ahead[i] + cost + c, _Path(path, k), i, cost + c))
    return out


def decode(ids: Iterable[int], pieces: Pieces) -> str:
    """Text of the ids: bytes joined, word marks to spaces, the first one dropped."""
    return b"".join([pieces.bytes_of[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


_pieces: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


#: Units, and ids of their best paths, that a worker remembers before it starts afresh; units whose n best paths it remembers.
CACHE_UNITS, CACHE_IDS, CACHE_PATHS = 1_000_000, 8_000_000, 100_000


class _Units:
    """Different units of the texts and which each text has."""

    def __init__(self, texts: list[bytes], pieces: Pieces):
        self.data = np.frombuffer(b"".join([b" " + x for x in texts if x]), np.uint8)
        at = np.cumsum([0] + [len(x) + 1 if x else 0 for x in texts])
        words = bounds(~SPACE[self.data])[0]
        self.n_words = np.diff(np.searchsorted(words, at)).tolist()
        # no piece crosses two bytes that no piece has side by side
        cut = np.ones(len(self.data), bool)
        cut[1:] = ~pieces.joined[self.data[:-1], self.data[1:]]
        cut[at[at < len(cut)]] = True
        lo = np.flatnonzero(cut)
        hi = np.append(lo[1:], len(cut))
        self.cuts = np.searchsorted(lo, at).tolist()
        self.keys, pick, self.inverse = np.unique(run_hashes(self.data, lo, hi), return_index=True, return_inverse=True)
        self.lo, self.hi = lo[pick], hi[pick]

    def text(self, i: int) -> bytes:
        return self.data[self.lo[i] : self.hi[i]].tobytes().replace(MARK, LITERAL).replace(b" ", MARK)


class _Memory:
    """What is known of the units seen, by their 64-bit hashes: of the best path cost, loss of the second best, ids; and the n best paths of some."""

    def __init__(self, pieces: Pieces, n: int):
        self.pieces, self.n = pieces, n
        self._forget()

    def _forget(self) -> None:
        self.index: dict[int, int] = {}
        self.rows = np.zeros((1 << 14, 4), np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.paths: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def _search(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and ids of the units, which stand by rising size."""
        lo = 0
        while lo < len(texts):
            hi = lo + 1
            while hi < len(texts) and (hi + 1 - lo) * len(texts[hi]) <= CELLS:
                hi += 1
            part = texts[lo:hi]
            if len(part) < FEW:
                found = [n_best(x, self.pieces, 2) for x in part]
                total, count = [x[0][0] for x in found], np.array([len(x[0][1]) for x in found])
                loss = [x[1][0] - x[0][0] if len(x) > 1 else FAR for x in found]
                flat = np.array([k for x in found for k in x[0][1]], np.int32)
            else:
                sizes = np.array([len(x) for x in part])
                words = np.zeros((len(part), sizes[-1]), np.uint8)
                words[np.arange(sizes[-1]) < sizes[:, None]] = np.frombuffer(b"".join(part), np.uint8)
                total, loss, (count, flat) = best(words, sizes, self.pieces)
            yield np.stack((total, loss, count, np.cumsum(count) - count), 1), flat
            lo = hi

    def of(self, units: _Units) -> np.ndarray:
        """Cost, loss, number of pieces, and place in self.ids, of each different unit."""
        if len(self.index) > CACHE_UNITS or self.used > CACHE_IDS:
            self._forget()
        at = list(map(self.index.get, keys := units.keys.tolist()))
        texts = sorted(((units.text(i), i) for i, x in enumerate(at) if x is None), key=lambda x: len(x[0]))
        done = len(self.index)
        for _, i in texts:
            self.index[keys[i]] = at[i] = len(self.index)
        while len(self.index) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        for rows, flat in self._search([x for x, _ in texts]):
            rows[:, 3] += self.used
            self.rows[done : done + len(rows)] = rows
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            self.ids[self.used : self.used + len(flat)] = flat
            done, self.used = done + len(rows), self.used + len(flat)
        return self.rows[np.array(at, np.int64)]

    def n_best(self, units: _Units, i: int) -> list[tuple[int, tuple[int, ...]]]:
        """The unit's best paths, two at least: cost, ids from the last one."""
        found = self.paths.get(key := int(units.keys[i]))
        if found is None:
            if len(self.paths) > CACHE_PATHS:
                self.paths = {}
            found = self.paths[key] = [(c, tuple(reversed(ids))) for c, ids in n_best(units.text(i), self.pieces, max(2, self.n))]
        return found

    def open(self, units: _Units, w: np.ndarray, loss: np.ndarray) -> list[int]:
        """Places of the n - 1 units (w: which they are) whose second best paths stand first.

        Of equal losses a change to lesser ids comes first, and then the later place; of changes to
        greater ids the earlier place.
        """
        k = self.n - 1
        places = np.flatnonzero(loss < FAR)
        if len(places) <= k or not k:
            return places[:k].tolist()
        edge = np.partition(loss[places], k - 1)[k - 1]
        sure, tied = places[loss[places] < edge], places[loss[places] == edge]
        if len(tied) > k - len(sure):
            which, of = np.unique(w[tied], return_inverse=True)
            less = np.array([x[1][1] < x[0][1] for x in (self.n_best(units, i) for i in which.tolist())])[of]
            tied = np.concatenate((tied[less][::-1], tied[~less]))[: k - len(sure)]
        return np.sort(np.concatenate((sure, tied))).tolist()


_memory: dict[tuple[str, int], _Memory] = {}


def _forget() -> None:
    _memory.clear()
    _pieces.clear()


def _segment(path: str, n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("segments", _forget)
        memory = _memory.setdefault((path, n), _Memory(load(path), n))
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                units = _Units(as_bytes(part.column("text")), memory.pieces)
                w = units.inverse
                cost, loss, size, start = memory.of(units)[w].T
                ends = np.cumsum(size)
                flat = memory.ids[np.repeat(start - ends + size, size) + np.arange(size.sum())]
                out, ids = [], []
                for doc_id, n_words, a, b in zip(part.column("doc_id").to_pylist(), units.n_words, units.cuts, units.cuts[1:]):
                    if a == b:
                        out.append((doc_id, 1, 0, n_words, 0, 0))
                        ids.append(flat[:0])
                        continue
                    total = int(cost[a:b].sum())
                    open_ = [a + x for x in memory.open(units, w[a:b], loss[a:b])]
                    joined: list[tuple[int, tuple[int, ...], tuple[tuple[int, ...], ...]]] = [(total, (), ())]
                    for x in open_:
                        own = memory.n_best(units, int(w[x]))
                        joined = sorted((c + d - own[0][0], q + p, (*parts, q)) for c, p, parts in joined for d, q in own)[:n]
                    for rank, (c, _, parts) in enumerate(joined, 1):
                        at, pieces_of = int(ends[a] - size[a]), []
                        for x, q in zip(open_, parts):
                            pieces_of += [flat[at : ends[x] - size[x]], np.array(q[::-1], np.int32)]
                            at = ends[x]
                        each = np.concatenate((*pieces_of, flat[at : ends[b - 1]]))
                        ids.append(each)
                        out.append((doc_id, rank, c, n_words, len(each), zlib.crc32(each.astype("<u4").tobytes())))
                cols = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.record_batch([*cols, pa.ListArray.from_arrays(offsets, np.concatenate(ids))], names=["doc_id", "rank", "cost", "n_words", "n_pieces", "ids_crc32", "ids"])

    return run


def segment(docs: DataFrame, n: int = 3, path: str | None = None) -> DataFrame:
    """The n best segmentations of every whole text: doc_id, rank, cost (thousandths of a nat), n_words, n_pieces, ids_crc32, ids.

    ids are those of the whole text, ids_crc32 is over them as little-endian 32-bit numbers. decode() of each gives the text back. n_words
    counts the runs between white space. Equal costs are ranked by ids, read from the last. A null or
    empty text has one segmentation, of no pieces; repeated rows are segmented each; an empty table gives an empty one.
    """
    return id_and_text(docs).mapInArrow(_segment(path or model_path(), n), "doc_id long, rank int, cost long, n_words long, n_pieces long, ids_crc32 long, ids array<int>")
