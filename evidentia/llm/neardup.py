"""Near-duplicate groups: fast similarity sketches, banding, exact links, components.

Sketch (rounds of hashed bin placement): in round i every shingle falls into one of t bins with a
value i plus a fraction, both hashed; a bin keeps its least value. From round t on, round i puts every
shingle into bin i - t, so after 2t rounds at most each bin is filled, and the sketch of a set depends
on the set alone. Rounds end once all bins are filled.

Links: documents with equal shingle sets form a class. Class representatives that agree in a band of
the sketch meet in a bucket; the member with the most bucket mates leads it. All members are compared
with their leads on full sets (in chunks, so a hot lead is spread). Members that are not linked with a
lead are then compared, in blocks, with that lead's other members; the triangle inequality of the
Jaccard distance, through the exact distances from the lead, and the set sizes exclude pairs. Every
pair that shares a bucket is linked with its lead, compared, or excluded by proof.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, U64, as_bytes, chunks, folders, fresh, id_and_text, mix, own_worker, release, shingle_hashes, stored, trim, word_hashes

WIDTH = 5
#: Bands of rows: a pair of similarity 0.85 is missed with probability 6e-9, one of 0.8 with 5e-6.
BANDS, ROWS = 40, 6
#: Members in a chunk beside their lead; unlinked and all members in a block. Long texts make chunks and blocks smaller.
STAR, BLOCK_A, BLOCK_B = 500, 512, 2048
#: Bytes of text in a chunk; shingles in a block.
STAR_BYTES, BLOCK_A_SHINGLES, BLOCK_B_SHINGLES = 4_000_000, 250_000, 1_000_000
CHUNK_BYTES = 500_000


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = LOWER[np.frombuffer(b" ".join(texts) or b" ", np.uint8)]
    words, starts, _ = word_hashes(data)
    cuts = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in texts])).tolist()
    return [np.unique(shingle_hashes(words[a:b], width)) for a, b in zip(cuts, cuts[1:])]


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """The t bins of a non-empty set of 64-bit hashes."""
    bins = np.full(t, 2**64 - 1, np.uint64)
    at, step = 0, max(1, (4 * t) // len(items))
    while at < 2 * t:
        rounds = np.arange(at, min(2 * t, at + step), dtype=np.uint64)[:, None]
        h = mix(items[None, :] + (rounds + U64(1)) * U64(0x9E3779B97F4A7C15))
        place = np.where(rounds < t, (h >> U64(32)) % U64(t), rounds - U64(t) if at >= t else rounds % U64(t))
        np.minimum.at(bins, place.ravel().astype(np.int64), ((rounds << U64(32)) | (h & U64(0xFFFFFFFF))).ravel())
        at += step
        if not (bins == U64(2**64 - 1)).any():
            break
    return bins


def band_keys(bins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=np.uint64) * U64(0xC2B2AE3D27D4EB4F)
    for j in range(rows):
        out = mix(out ^ bins.reshape(bands, rows)[:, j]) + U64(j)
    return out.view(np.int64)


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("neardup")
        for batch in batches:
            for piece in chunks(batch, "text", CHUNK_BYTES):
                sets = shingle_sets(as_bytes(piece.column("text")), width)
                keys = [None if not len(s) else bytes(np.array([mix(s).sum(dtype=np.uint64), mix(s ^ U64(0xABCDEF)).sum(dtype=np.uint64), len(s)], np.uint64)) for s in sets]
                found = [None if not len(s) else band_keys(sketch(s, bands * rows), bands, rows) for s in sets]
                yield pa.record_batch([piece.column("doc_id").cast(pa.int64()), piece.column("digest"), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "digest", "n_shingles", "key", "bands"])
        trim()

    return run


def _star(percent: int, width: int):
    kind = pa.schema([("lead", pa.int64()), ("x", pa.int64()), ("inter", pa.int64()), ("total", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        own_worker("neardup")
        ids = group.column("x").to_numpy()
        lead = group.column("lead")[0].as_py()
        out = []
        own = np.flatnonzero(ids == lead)
        hub = shingle_sets(as_bytes(group.slice(int(own[0]), 1).column("text").combine_chunks()), width)[0]
        for batch in group.to_batches():
            for piece in chunks(batch, "text", CHUNK_BYTES):
                for x, s in zip(piece.column("x").to_pylist(), shingle_sets(as_bytes(piece.column("text")), width)):
                    if x != lead:
                        at = np.searchsorted(hub, s)
                        at[at == len(hub)] = 0
                        inter = int(np.count_nonzero(hub[at] == s)) if len(hub) else 0
                        out.append((lead, x, inter, len(hub) + len(s) - inter))
        if group.nbytes > CHUNK_BYTES:
            trim()
        cols = list(zip(*out)) or [[]] * 4
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=kind)

    return run


def _find(parent: dict, x):
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _blocks(percent: int, width: int):
    kind = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        own_worker("neardup")
        rows = group.select(["x", "side", "inter", "total"]).to_pylist()
        sets: list[np.ndarray] = []
        for batch in group.to_batches():
            for piece in chunks(batch, "text", CHUNK_BYTES):
                sets += shingle_sets(as_bytes(piece.column("text")), width)
        lead = group.column("lead")[0].as_py()
        vocab, flat = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array(list(map(len, sets)))
        cut = np.cumsum(sizes) - sizes
        b = np.array([i for i, r in enumerate(rows) if r["side"] == 1], np.int64)
        ids = np.array([r["x"] for r in rows])
        inter, total = np.array([r["inter"] for r in rows]), np.array([r["total"] for r in rows])
        away = 1 - inter / total
        parent: dict[int, int] = {}
        for i in b.tolist():
            if 100 * inter[i] >= percent * total[i]:
                parent[_find(parent, int(ids[i]))] = _find(parent, lead)
        out = []
        for i in (i for i, r in enumerate(rows) if r["side"] == 0):
            near = b[(np.abs(away[b] - away[i]) <= 1 - percent / 100 + 1e-9) & (100 * np.minimum(sizes[b], sizes[i]) >= percent * np.maximum(sizes[b], sizes[i])) & (ids[b] != ids[i])]
            if not len(near):
                continue
            mark = np.zeros(len(vocab), bool)
            mark[flat[cut[i] : cut[i] + sizes[i]]] = True
            spans = np.repeat(cut[near] - (np.cumsum(sizes[near]) - sizes[near]), sizes[near]) + np.arange(sizes[near].sum())
            common = np.add.reduceat(mark[flat[spans]].astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
            for j in near[100 * common >= percent * (sizes[near] + sizes[i] - common)].tolist():
                a, c = _find(parent, int(ids[i])), _find(parent, int(ids[j]))
                if a != c:
                    parent[a] = c
                    out.append((int(ids[i]), int(ids[j])))
        del sets, vocab, flat
        trim()
        cols = list(zip(*out)) or [[], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=kind)

    return run


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of undirected links x, y; by rounds of neighbour minima and pointer jumps, each round stored."""
    spark = links.sparkSession
    both = stored(links.select("x", "y").union(links.select("y", "x")).distinct(), "links")
    labels = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")).withColumnRenamed("x", "node")
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.x).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = stored(lower.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), (F.least("low", F.coalesce("far", "low")) < F.col("label")).alias("moved")), "labels")
        last = folders(spark) - 1
        if not new.filter("moved").limit(1).count():
            release(spark, last)  # the last round changed nothing
            return labels.withColumnRenamed("label", "component")
        release(spark, last - 1, last)
        labels = new.drop("moved")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A & B| >= percent * |A | B| on their sets of shingles. A null or
    wordless text has an empty set and is linked with nothing. Rows with one doc_id count as one
    document: each of its different texts links, and all its rows with words get the same component.
    A null doc_id never leads and links nothing, its component_id is that of its class or null. The
    order of the rows changes nothing. Only doc_id and text are read. An empty table gives an empty one.
    """
    return _grouped(docs, percent, width, bands, rows, True).drop("digest")


def _one_document(classes: DataFrame) -> DataFrame:
    """Links x, y between the classes in which a doc_id with different texts stands, from doc_id and node of each row."""
    some = classes.groupBy("doc_id").agg(F.min("node").alias("y"), F.max("node").alias("z")).filter("y < z").select("doc_id", "y")
    return classes.join(some, "doc_id").filter("node != y").select(F.col("node").alias("x"), "y").distinct()


def _grouped(docs: DataFrame, percent: int, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, by_doc: bool = False) -> DataFrame:
    """near_duplicates() with the MD5 of each row's text.

    Links are between classes of equal sets, which have numbers of their own, so rows of one doc_id with
    different texts stay apart; `by_doc` links the classes of such rows. A class is shown by the text of
    its least (doc_id, MD5).
    """
    base = id_and_text(docs).withColumn("digest", F.md5(F.encode("text", "UTF-8")))
    sig = stored(base.mapInArrow(_signatures(width, bands, rows), "doc_id long, digest string, n_shingles long, key binary, bands array<bigint>"), "sketches")
    # stored, so that the numbers stay and joins on it can be split where one text has very many copies
    least = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "digest")).alias("m"))
    reps = stored(least.select("key", F.monotonically_increasing_id().alias("node"), F.col("m.doc_id").alias("rep"), F.col("m.digest").alias("rep_digest")), "classes")
    members = stored(sig.select("doc_id", "digest", "n_shingles", "key").join(reps.select("key", "node", "rep"), "key", "left").drop("key"), "members")
    own = sig.join(reps, (sig.key == reps.key) & (sig.doc_id == reps.rep) & (sig.digest == reps.rep_digest)).select(sig.key, sig.doc_id, sig.digest, "node", "bands")
    own = own.dropDuplicates(["key", "doc_id", "digest"]).select("node", F.explode("bands").alias("band"))
    multi = own.groupBy("band").agg(F.count(F.lit(1)).alias("mates")).filter("mates > 1")
    buckets = stored(own.join(multi, "band"), "buckets")
    degree = buckets.groupBy("node").agg(F.sum("mates").alias("degree"))
    lead = buckets.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", (-F.col("node")).alias("r"))).alias("m")).select("band", (-F.col("m.r")).alias("lead"))
    edges = stored(buckets.join(lead, "band").filter("node != lead").select("lead", F.col("node").alias("x")).distinct(), "edges")
    roster = edges.union(edges.select("lead", F.col("lead").alias("x")).distinct())
    roster = roster.join(reps.select(F.col("node").alias("x"), F.col("rep").alias("doc_id"), F.col("rep_digest").alias("digest")), "x")
    # a merge join at every size: the list of candidates grows with the corpus, so it is never broadcast;
    # rows that a table has twice are made one where the join has put them side by side
    texts = roster.hint("merge").join(base, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest", "lead"]).select("lead", "x", "text")
    texts = stored(texts, "candidates")
    counts = texts.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    parts = F.ceil(F.greatest(F.col("n") / STAR, F.col("bytes") / STAR_BYTES)).cast("int")
    dealt = texts.join(counts, "lead")
    salts = F.when(F.col("x") == F.col("lead"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("x"), parts).cast("int")))
    star = dealt.select("lead", "x", "text", F.explode(salts).alias("salt")).groupBy("lead", "salt").applyInArrow(_star(percent, width), "lead long, x long, inter long, total long")
    star = stored(star, "star")
    linked = F.col("inter") * 100 >= F.col("total") * percent
    loose = star.groupBy("lead").agg(F.count_if(~linked).alias("a"), F.count(F.lit(1)).alias("b"), F.sum(F.when(~linked, F.col("total"))).alias("a_size"), F.sum("total").alias("b_size")).filter("a > 0 AND b > 1")
    na = F.ceil(F.greatest(F.col("a") / BLOCK_A, F.col("a_size") / BLOCK_A_SHINGLES)).cast("int")
    nb = F.ceil(F.greatest(F.col("b") / BLOCK_B, F.col("b_size") / BLOCK_B_SHINGLES)).cast("int")
    rest = star.join(loose, "lead").join(texts, ["lead", "x"])
    all_ = rest.select("lead", "x", "text", "inter", "total", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), na - 1)).alias("i"), F.pmod(F.xxhash64("x"), nb).cast("int").alias("j"))
    alone = rest.filter(~linked).select("lead", "x", "text", "inter", "total", F.lit(0).alias("side"), F.pmod(F.xxhash64("x", F.lit(1)), na).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), nb - 1)).alias("j"))
    more = all_.union(alone).groupBy("lead", "i", "j").applyInArrow(_blocks(percent, width), "x long, y long")
    links = star.filter(linked).select("x", F.col("lead").alias("y")).union(more)
    if by_doc:
        links = links.union(_one_document(members.filter("doc_id IS NOT NULL AND node IS NOT NULL").select("doc_id", "node")))
    groups = components(links)
    named = groups.join(reps.select("node", "rep"), "node")
    named = stored(named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("node", "component_id"), "components")
    out = members.join(named, "node", "left")
    component = F.coalesce("component_id", "rep", "doc_id")
    return out.select("doc_id", "digest", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs, with all columns, with one document, that of the least doc_id, of each group of near-duplicates.

    Verdicts are by doc_id and text: of rows that share a doc_id only those go whose own text is a copy of
    another document; repeated rows stay or go alike. Documents without words all stay. A row without
    doc_id goes if its text is that of a document with one. An empty table gives an empty one.
    """
    text, gone_id, gone_text = fresh(docs.columns, "text_md5", "gone_id", "gone_md5")
    gone = _grouped(docs, percent).filter("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_text)).distinct()
    rows = docs.withColumn(text, F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(text) == F.col(gone_text)), "left_anti").drop(text)
