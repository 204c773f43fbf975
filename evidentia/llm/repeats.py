"""Removal of repeated byte strings across documents, over an anchored enhanced suffix array.

Every window of LENGTH bytes has an anchor: its GRAM-byte string of least hash (leftmost of equals), a
function of the window's bytes alone. Equal windows therefore have equal anchors at equal offsets, and
all occurrences of a window meet where contexts are dealt by anchor. The steps:

1. Documents are dealt into groups of about GROUP_BYTES. Exact copies of a text with a smaller doc_id
   are set aside (all their windows repeat, and they add none of their own).
2. Each group sends the hashes of its anchors, once each; what comes back is one bit for each: whether
   the anchor occurs in two documents. A hash in a third of all documents is one entry per group.
3. For shared anchors the group sends the distinct contexts: the bytes of those windows whose anchor it
   is, with the smallest and largest doc_id of the occurrences.
4. The contexts that meet form a suffix array: sorted from the anchor on, with the lengths of common
   prefixes. A stack scan of these gives the tree of common-prefix intervals, children before parents. In
   each interval the members' left extensions are scanned in the same way: where these differ, a node
   with members of two children of the interval is extended neither to the left nor to the right, so it
   is a maximal repeat group (within the contexts), and it is given out with all its occurrences.
5. The group marks the bytes of each repeat with a smaller doc_id than its own and cuts them out.
   A window occurs wherever the smallest maximal repeat around it does, so no window is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import U64, as_bytes, bounds, fresh, mix, own_worker, run_hashes, shuffle_partitions

LENGTH, GRAM = 50, 16
#: Bytes of text in a group of documents, and of text handled at once in it.
GROUP_BYTES, CHUNK_BYTES = 16_000_000, 1_000_000
#: A small table is dealt into one group for each shuffle partition, but of no fewer bytes than this.
LEAST_GROUP_BYTES = 1_000_000
#: Order of a missing doc_id: smaller than any other.
NO_ID = -(2**63)
_HASH_BITS = 48


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Anchors of the windows in the texts that end at `ends`: hashes, places, first and last window starts, text numbers."""
    empty = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return empty.astype(np.uint64), empty, empty, empty, empty
    starts = np.concatenate(([0], ends[:-1]))
    span = length - gram + 1
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << U64(8)
    x = x[:-2] | x[2:] << U64(16)
    x = x[:-4] | x[4:] << U64(32)
    m = n - gram + 1
    h = x[:m] * U64(0x9E3779B97F4A7C15) + mix(x[gram - 8 : gram - 8 + m])
    h = mix(h)
    low = (h & ~U64(0xFFFFFFFF)) | np.arange(m, dtype=np.uint64)
    have = 1
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if span > have:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    sizes = np.maximum(ends - starts - length + 1, 0)
    text = np.repeat(np.arange(len(ends)), sizes)
    at = np.arange(len(text)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    place = (low[at] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.diff(place, prepend=-1) | np.diff(text, prepend=-1))
    last = np.append(new[1:], len(place))[: len(new)] - 1
    p = place[new]
    return h[p], p, at[new], at[last], text[new]


class _Group:
    """The texts of a group that are no copies, in pieces and chunks, with their anchors."""

    def __init__(self, docs: pa.Table, copies: set, length: int, gram: int):
        self.ids = np.array([NO_ID if x is None else x for x in docs.column("doc_id").to_pylist()], np.int64)
        self.texts = as_bytes(docs.column("text").combine_chunks()) if docs.num_rows else []
        some = {i for i, _ in copies}
        self.copy = np.array([i in some and (i, hashlib.md5(x).digest()) in copies for i, x in zip(self.ids.tolist(), self.texts)], bool)
        self.length, self.gram = length, gram

    def _pieces(self) -> Iterator[tuple[int, int, bytes]]:
        """Text number, offset and bytes; a long text is split so that each window stands in one piece."""
        for i, x in enumerate(self.texts):
            if len(x) >= self.length and not self.copy[i]:
                for at in range(0, len(x) - self.length + 1, CHUNK_BYTES):
                    yield i, at, x[at : at + CHUNK_BYTES + self.length - 1] if len(x) > CHUNK_BYTES else x

    def chunks(self):
        """Text numbers and offsets of the pieces of a chunk, its bytes, the pieces' ends, and their anchors."""
        part, size = [], 0
        for piece in self._pieces():
            if part and size + len(piece[2]) > CHUNK_BYTES:
                yield self._chunk(part)
                part, size = [], 0
            part.append(piece)
            size += len(piece[2])
        if part:
            yield self._chunk(part)

    def _chunk(self, part: list[tuple[int, int, bytes]]):
        rows, bases = np.array([x[0] for x in part]), np.array([x[1] for x in part])
        ends = np.cumsum([len(x[2]) for x in part])
        data = np.frombuffer(b"".join([x[2] for x in part]), np.uint8)
        return rows, bases, data, ends, anchors(data, ends, self.length, self.gram)


def _context_keys(data: np.ndarray, a) -> np.ndarray:
    _, p, lo, hi, _ = a
    return (lambda length: run_hashes(data, lo, hi + length) + mix(((p - hi) * 4096 + p - lo).astype(np.uint64)))


def _short(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    v = h & U64((1 << _HASH_BITS) - 1)
    return (v % U64(buckets)).astype(np.int64), v // U64(buckets)


def _six(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _copies(info: pa.Table) -> set:
    """(doc_id, MD5 of the text) of the group's copies."""
    return {(NO_ID if i is None else i, b) for k, i, b in zip(*(info.column(c).to_pylist() for c in ("kind", "id", "body"))) if k == 0}


def _pid(docs: pa.Table) -> int:
    return docs.column(docs.num_columns - 1)[0].as_py()


_INFO = "pid int, kind int, id long, body binary"


def _group_anchors(group: _Group, buckets: int):
    """Sorted distinct anchors of the group as (bucket, rest), and whether each has two documents here."""
    hs, ids = [], []
    for rows, _, _, _, a in group.chunks():
        hs.append(a[0])
        ids.append(group.ids[rows][a[4]])
    if not hs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    h, ids = np.concatenate(hs), np.concatenate(ids)
    bucket, rest = _short(h, buckets)
    order = np.lexsort((rest, bucket))
    bucket, rest, ids = bucket[order], rest[order], ids[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1).astype(bool) | (np.diff(rest, prepend=rest[:1]) != 0))
    first = np.union1d([0], first)
    two = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
    return bucket[first], rest[first], two


def _send_anchors(buckets: int, length: int, gram: int):
    def run(docs: pa.Table, info: pa.Table) -> pa.Table:
        own_worker("repeats")
        out = []
        if docs.num_rows:
            pid = _pid(docs)
            bucket, rest, two = _group_anchors(_Group(docs, _copies(info), length, gram), buckets)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            out = [{"bucket": b, "pid": pid, "hashes": _six(rest[i:j]), "two": np.packbits(two[i:j]).tobytes()} for b, (i, j) in enumerate(zip(edges.tolist(), edges[1:].tolist())) if j > i]
        return pa.Table.from_pylist(out, pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("hashes", pa.binary()), ("two", pa.binary())]))

    return run


def _shared(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    each = [_unsix(r["hashes"]) for r in rows]
    two = np.concatenate([np.unpackbits(np.frombuffer(r["two"], np.uint8))[: len(h)] for r, h in zip(rows, each)]).astype(bool)
    values, inverse, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    hit = counts > 1
    hit[inverse[two]] = True
    bits, at, out = hit[inverse], 0, []
    for r, h in zip(rows, each):
        out.append({"pid": r["pid"], "kind": 1, "id": r["bucket"], "body": np.packbits(bits[at : at + len(h)]).tobytes()})
        at += len(h)
    return pa.Table.from_pylist(out, pa.schema([("pid", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("body", pa.binary())]))


def _send_contexts(buckets: int, length: int, gram: int):
    def run(docs: pa.Table, info: pa.Table) -> pa.Table:
        own_worker("repeats")
        kind = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
        out: list[dict] = []
        if not docs.num_rows:
            return pa.Table.from_pylist(out, kind)
        pid = _pid(docs)
        group = _Group(docs, _copies(info), length, gram)
        bits = {i: b for k, i, b in zip(info.column("kind").to_pylist(), info.column("id").to_pylist(), info.column("body").to_pylist()) if k == 1}
        bucket, rest, _ = _group_anchors(group, buckets)
        edges = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
        keep = np.concatenate([np.zeros(0, bool)] + [np.unpackbits(np.frombuffer(bits[b], np.uint8))[: j - i].astype(bool) for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i])
        shared = np.sort(bucket[keep].astype(np.uint64) + rest[keep] * U64(buckets))
        cols: list[list] = [[] for _ in range(6)]
        texts: list[np.ndarray] = []
        for rows, _, data, _, a in group.chunks():
            v = a[0] & U64((1 << _HASH_BITS) - 1)
            at = np.searchsorted(shared, v)
            at[at == len(shared)] = 0
            hit = np.flatnonzero(shared[at] == v) if len(shared) else np.zeros(0, np.int64)
            a = tuple(x[hit] for x in a)
            keys = _context_keys(data, a)(length)
            ids = group.ids[rows][a[4]]
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] + U64(1)) != 0)
            if not len(first):
                continue
            pick = order[first]
            lo, hi = a[2][pick], a[3][pick] + length
            size = hi - lo
            texts.append(data[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())])
            for c, x in zip(cols, (keys[pick], a[1][pick] - a[3][pick], a[1][pick] - a[2][pick], np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first), (v[hit][pick] % U64(buckets)).astype(np.int64))):
                c.append(x)
        if not texts:
            return pa.Table.from_pylist(out, kind)
        keys, near, far, least, most, where = (np.concatenate(c) for c in cols)
        text = np.concatenate(texts)
        size = far - near + length
        begin = np.cumsum(size) - size
        order = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[order], np.arange(buckets + 1)).tolist()
        for b, (i, j) in enumerate(zip(edges, edges[1:])):
            if j > i:
                o = order[i:j]
                body = text[np.repeat(begin[o] - (np.cumsum(size[o]) - size[o]), size[o]) + np.arange(size[o].sum())]
                raw = b"".join([keys[o].tobytes(), least[o].tobytes(), most[o].tobytes(), near[o].astype(np.uint16).tobytes(), far[o].astype(np.uint16).tobytes(), body.tobytes()])
                out.append({"bucket": b, "pid": pid, "n": j - i, "body": zstandard.ZstdCompressor(level=3).compress(raw)})
        return pa.Table.from_pylist(out, kind)

    return run


def _classes(members: list[int], left: list[int], reach: list[int], need: int, width: int) -> Iterator[tuple[int, list[int]]]:
    """Left-diverse classes of the members that share `need` bytes to the left or more: (how many bytes, members), inner before outer.

    left: the `width` bytes before the anchor as an integer, the nearest byte on top; reach: how many of them a context has.
    """
    shift, alike = 8 * (width - need), {}
    for m in members:
        if reach[m] >= need:
            alike.setdefault(left[m] >> shift, []).append(m)
    for own in alike.values():
        if len(own) == 2:
            a, b = own
            yield min(width - ((left[a] ^ left[b]).bit_length() + 7) // 8, reach[a], reach[b]), own
        elif len(own) > 2:
            own.sort(key=lambda m: (left[m], reach[m]))
            stack: list[tuple[int, int]] = []  # depth and first member of the open classes
            for k in range(1, len(own) + 1):
                depth, first = -1, k - 1
                if k < len(own):
                    a, b = own[k - 1], own[k]
                    depth = min(width - ((left[a] ^ left[b]).bit_length() + 7) // 8, reach[a], reach[b])
                while stack and stack[-1][0] > depth:
                    closed, first = stack.pop()
                    yield closed, own[first:k]
                if depth >= 0 and (not stack or stack[-1][0] < depth):
                    stack.append((depth, first))


def maximal_groups(right: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray, length: int) -> Iterator[tuple[list[int], int, int]]:
    """Maximal repeat groups of `length` bytes or more among contexts: (members, bytes left of the anchor, bytes from it on).

    right: bytes from the anchor on; left: bytes before it, nearest first; near and far: how many bytes left of
    the anchor the context's windows reach at least and at most. Inner groups come before outer ones.
    """
    n, width = left.shape
    if n < 2:
        return
    size = length - near
    words = np.zeros((n, -(-right.shape[1] // 8) * 8), np.uint8)
    words[:, : right.shape[1]] = right
    keys = words.view(">u8").astype(np.uint64)
    order = np.lexsort((size, *keys.T[::-1]))
    right, size_ = right[order], size[order]
    differ = right[1:] != right[:-1]
    lcp = np.minimum(np.where(differ.any(1), differ.argmax(1), right.shape[1]), np.minimum(size_[1:], size_[:-1])).tolist()
    # nearest byte on top
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = left
    parts = wide.view(">u8").astype(np.uint64).T.tolist()
    drop = 8 * (wide.shape[1] - width)
    value = parts[0]
    for more in parts[1:]:
        value = [a << 64 | b for a, b in zip(value, more)]
    value = [x >> drop for x in value]
    reach, members, at = far.tolist(), order.tolist(), [0] * n
    for i, m in enumerate(members):
        at[m] = i
    child = list(range(n))  # for each place, the first place of the largest closed interval around it
    stack: list[tuple[int, int]] = []  # depth and first place of the open intervals
    lcp.append(-1)
    for i in range(n):
        depth, first = lcp[i], i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            own = members[first : i + 1]
            for o, group in _classes(own, value, reach, max(0, length - d), width) if length - d <= width else ():
                one = child[at[group[0]]]
                if any(child[at[m]] != one for m in group):
                    yield group, o, d
            child[first : i + 1] = [first] * (i + 1 - first)
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _alike(right: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Contexts that can share a window with another: each window has the middle number of bytes left of the anchor, or else the rest from the anchor on."""
    middle = (length - gram) // 2
    out = np.zeros(len(right), bool)
    for cells, has in ((np.hstack((left[:, :middle], right[:, :gram])), far >= middle), (right[:, : length - middle], near <= middle)):
        at = np.flatnonzero(has)
        flat = np.ascontiguousarray(cells[at])
        starts = np.arange(len(at)) * flat.shape[1]
        _, inverse, counts = np.unique(run_hashes(flat.ravel(), starts, starts + flat.shape[1]), return_inverse=True, return_counts=True)
        out[at[counts[inverse] > 1]] = True
    return out


def _scan(length: int, gram: int, every: bool):
    """every: give out all occurrences of each repeat with its digest; else those with a smaller doc_id elsewhere, and none inside another with a doc_id as small."""

    def run(group: pa.Table) -> pa.Table:
        own_worker("repeats")
        kind = pa.schema([("pid", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("body", pa.binary())])
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        pids = []
        for r in group.to_pylist():
            raw, n = zstandard.ZstdDecompressor().decompress(r["body"]), r["n"]
            at = 0
            for c, (t, w) in zip(parts, ((np.uint64, 8), (np.int64, 8), (np.int64, 8), (np.uint16, 2), (np.uint16, 2))):
                c.append(np.frombuffer(raw, t, n, at))
                at += n * w
            parts[5].append(np.frombuffer(raw, np.uint8, offset=at))
            pids.append(np.full(n, r["pid"]))
        keys, least, most, near, far, text = (np.concatenate(c) for c in parts)
        near, far, pid = near.astype(np.int64), far.astype(np.int64), np.concatenate(pids)
        size = far - near + length
        begin = np.cumsum(size) - size
        n = len(keys)
        right, left = np.zeros((n, length), np.uint8), np.zeros((n, length - gram), np.uint8)
        for j in range(length):
            has = np.flatnonzero(j < length - near)
            right[has, j] = text[begin[has] + far[has] + j]
        for j in range(length - gram):
            has = np.flatnonzero(j < far)
            left[has, j] = text[begin[has] + far[has] - 1 - j]
        live = np.flatnonzero(_alike(right, left, near, far, length, gram))
        low, high, to_left = least.tolist(), most.tolist(), far.tolist()
        out_m, out_o, out_d, out_s, digests = [], [], [], [], []
        found: dict[int, list[tuple[int, int]]] = {}  # of each context: (left reach, smallest doc_id) of what was given out, of falling reach to the right
        for m in np.flatnonzero(least < most).tolist():  # the whole context repeats
            out_m.append(m), out_o.append(to_left[m]), out_d.append(length - int(near[m])), out_s.append(low[m])
            found[m] = [(to_left[m], low[m])]
        if every:
            digests = [hashlib.blake2b(left[m, :o][::-1].tobytes() + right[m, :d].tobytes(), digest_size=8).digest() for m, o, d in zip(out_m, out_o, out_d)]
        names = live.tolist()
        for group_, o, d in maximal_groups(right[live], left[live], near[live], far[live], length):
            own = [names[k] for k in group_]
            smallest = min([low[m] for m in own])
            if every:
                digest = hashlib.blake2b(left[own[0], :o][::-1].tobytes() + right[own[0], :d].tobytes(), digest_size=8).digest()
                digests += [digest] * len(own)
            for m in own:
                if every or high[m] > smallest:
                    have = found.get(m)
                    if not every and have and any(x >= o and y <= smallest for x, y in have):
                        continue
                    if not every:
                        if have is None:
                            found[m] = [(o, smallest)]
                        else:
                            have.append((o, smallest))
                    out_m.append(m), out_o.append(o), out_d.append(d), out_s.append(smallest)
        m, o, d, s = np.array(out_m, np.int64), np.array(out_o, np.uint16), np.array(out_d, np.uint16), np.array(out_s, np.int64)
        names8 = np.frombuffer(b"".join(digests), np.uint64)
        by, out = np.argsort(pid[m], kind="stable"), []
        for p in np.unique(pid[m]).tolist():
            i = by[np.searchsorted(pid[m][by], p) : np.searchsorted(pid[m][by], p, "right")]
            out.append({"pid": p, "kind": 2, "id": len(i), "body": b"".join([keys[m[i]].tobytes(), s[i].tobytes(), o[i].tobytes(), d[i].tobytes()] + ([names8[i].tobytes()] if every else []))})
        return pa.Table.from_pylist(out, kind)

    return run


def _found(group: _Group, info: pa.Table, length: int):
    """For each chunk: text numbers and offsets of its pieces, bytes, ends, anchors, and (anchor number, smallest doc_id, reach to left and right, digest) of its repeats."""
    raw = [(i, b) for k, i, b in zip(*(info.column(c).to_pylist() for c in ("kind", "id", "body"))) if k == 2]
    keys, least, o, d, names = (np.concatenate([np.zeros(0, t)] + [np.frombuffer(b, t, n if at < 20 or len(b) > 20 * n else 0, at * n if len(b) > at * n else 0) for n, b in raw]) for t, at in ((np.uint64, 0), (np.int64, 8), (np.uint16, 16), (np.uint16, 18), (np.uint64, 20)))
    by = np.argsort(keys, kind="stable")
    keys, least, o, d = keys[by], least[by], o[by].astype(np.int64), d[by].astype(np.int64)
    names = names[by] if len(names) else np.zeros(len(by), np.uint64)
    for rows, bases, data, ends, a in group.chunks():
        own = _context_keys(data, a)(length)
        i, j = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
        count = j - i
        who = np.repeat(np.arange(len(own)), count)
        at = np.repeat(i - (np.cumsum(count) - count), count) + np.arange(count.sum())
        yield rows, bases, data, ends, a, who, least[at], o[at], d[at], names[at]


def _occurrences(length: int, gram: int):
    kind = pa.schema([("repeat", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_bytes", pa.int32())])

    def run(docs: pa.Table, info: pa.Table) -> pa.Table:
        own_worker("repeats")
        group, out = _Group(docs, _copies(info) if docs.num_rows else set(), length, gram), []
        for rows, bases, _, ends, a, who, _, o, d, names in _found(group, info, length):
            text = a[4][who]
            start = a[1][who] - o - np.concatenate(([0], ends[:-1]))[text] + bases[text]
            ids = [None if x == NO_ID else x for x in group.ids[rows[text]].tolist()]
            out.append(pa.Table.from_arrays([pa.array(names.view(np.int64)), pa.array(ids, pa.int64()), pa.array(start), pa.array((o + d).astype(np.int32))], schema=kind))
        return pa.concat_tables(out) if out else kind.empty_table()

    return run


def _cut(length: int, gram: int, with_text: bool, names: list[str], kind: pa.Schema):
    def run(docs: pa.Table, info: pa.Table) -> pa.Table:
        own_worker("repeats")
        if not docs.num_rows:
            return kind.empty_table()
        group = _Group(docs, _copies(info), length, gram)
        spans: dict[int, list[tuple[int, int]]] = {}
        for rows, bases, data, ends, a, who, least, o, d, _ in _found(group, info, length):
            hit = least < group.ids[rows][a[4][who]]
            who, o, d = who[hit], o[hit], d[hit]
            diff = np.zeros(len(data) + 1, np.int32)
            np.add.at(diff, a[1][who] - o, 1)
            np.add.at(diff, a[1][who] + d, -1)
            removed = np.cumsum(diff[:-1]) > 0
            if removed.any():
                s, e = bounds(removed)
                # a run of removed bytes is cut where texts meet
                inner = ends[:-1]
                inside = inner[(np.searchsorted(s, inner, "left") - np.searchsorted(e, inner, "right")) > 0]
                s, e = np.sort(np.concatenate((s, inside))), np.sort(np.concatenate((e, inside)))
                starts = np.concatenate(([0], ends[:-1]))
                lo, hi = np.searchsorted(s, starts, "left"), np.searchsorted(s, ends, "left")
                for r, base, x, y in zip(rows.tolist(), (starts - bases).tolist(), lo.tolist(), hi.tolist()):
                    if y > x:
                        spans.setdefault(r, []).append((s[x:y] - base, e[x:y] - base))
        gone: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for r, own in spans.items():  # pieces of a long text overlap: what touches is one run
            s, e = (np.concatenate(x) for x in zip(*own))
            if len(own) > 1:
                by = np.argsort(s, kind="stable")
                s, e = s[by], np.maximum.accumulate(e[by])
                first = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
                s, e = s[first], e[np.append(first[1:], len(e)) - 1]
            gone[r] = s, e
        n_bytes, n_removed, n_spans, digests, kept = [], [], [], [], []
        for r, text in enumerate(group.texts):
            left, spans, size = text, 0, 0
            if group.copy[r] and len(text) >= length:
                left, spans, size = b"", 1, len(text)
            elif r in gone:
                s, e = gone[r]
                spans, size = len(s), int((e - s).sum())
                cuts = [0, *np.stack((s, e), 1).ravel().tolist(), len(text)]
                left = b"".join([text[x:y] for x, y in zip(cuts[::2], cuts[1::2])])
            n_bytes.append(len(text))
            n_removed.append(size)
            n_spans.append(spans)
            digests.append(None if with_text else hashlib.sha256(left).hexdigest())
            kept.append(left)
        if not with_text:
            cols = {"doc_id": docs.column("doc_id"), "n_bytes": n_bytes, "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": digests}
        else:
            texts = [x.decode("utf-8", "ignore") for x in kept]
            cols = {c: docs.column(c) for c in names} | {"text": texts} | ({"n_chars": list(map(len, texts))} if "n_chars" in names else {})
        return pa.Table.from_arrays([pa.array(cols[f.name], f.type) if isinstance(cols[f.name], list) else cols[f.name].cast(f.type) for f in kind], schema=kind)

    return run


def _dealt(docs: DataFrame, names: list[str], every: bool, length: int, gram: int):
    """The documents in groups, and what each group is told: its copies, and its repeats."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES), min(shuffle_partitions(docs.sparkSession), size // LEAST_GROUP_BYTES))
    text = F.coalesce("text", F.lit(""))
    # by id and text, so that neither rows without an id nor repeated ids gather in one group
    pid = F.pmod(F.xxhash64("doc_id", text), F.lit(groups)).cast("int")
    (own,) = fresh(docs.columns, "group")
    base = docs.select(*[F.col(c) if c != "text" else text.alias("text") for c in names], pid.alias(own))
    digest, order = F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("digest"), F.coalesce("doc_id", F.lit(NO_ID))
    narrow = docs.select("doc_id", digest, pid.alias("pid"))
    first = narrow.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = narrow.join(first, "digest").filter(order > F.col("first")).select("pid", F.lit(0).alias("kind"), F.col("doc_id").cast("long").alias("id"), F.col("digest").alias("body")).distinct()

    def told(more: DataFrame):
        return base.groupBy(own).cogroup(more.groupBy("pid"))

    sent = told(copies).applyInArrow(_send_anchors(groups, length, gram), "bucket int, pid int, hashes binary, two binary")
    shared = sent.groupBy("bucket").applyInArrow(_shared, _INFO)
    contexts = told(copies.union(shared)).applyInArrow(_send_contexts(groups, length, gram), "bucket int, pid int, n int, body binary")
    spans = contexts.groupBy("bucket").applyInArrow(_scan(length, gram, every), _INFO)
    return told(copies.union(spans))


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Every occurrence of every maximal repeat group: repeat (64-bit digest of its bytes), doc_id, start (byte), n_bytes.

    A repeat of `length` bytes or more stands in two places or more (of one document, too) and no common
    byte can be added at either side within the contexts, which reach 2 * length - gram bytes at most; a
    longer passage is given as repeats that overlap. Exact copies of a text with a smaller doc_id are left
    out, as are repeats inside one document's equal contexts. Nulls and repeated ids are as in
    remove_repeats; an empty table gives an empty one.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _dealt(base, ["doc_id", "text"], True, length, gram).applyInArrow(_occurrences(length, gram), "repeat long, doc_id long, start long, n_bytes int").distinct()


def remove_repeats(docs: DataFrame, with_text: bool = False, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Cut from each document every byte covered by a `length`-byte string that also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256; or, with_text, docs
    with all columns, whatever these are called, the remaining text (bytes of a character that was cut in
    two go as well) and its n_chars. A null text is empty, a null doc_id counts as smaller than any other,
    rows with equal doc_ids are not smaller than each other, and only those go whole whose own text is a
    copy. Texts shorter than `length` are left alone, long ones are handled in pieces that overlap. An empty
    table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = docs.columns if with_text else ["doc_id", "text"]
    kind = T.StructType([docs.schema[c] if c != "text" else T.StructField("text", T.StringType()) for c in names]) if with_text else T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return _dealt(docs, names, False, length, gram).applyInArrow(_cut(length, gram, with_text, names, to_arrow_schema(kind)), kind)
