"""Phrase collocations of each language: candidates from sketch upper bounds, counts in one more pass.

A text is lower-cased (A-Z), split at . , ; : ! ? and line ends into pieces, those at spaces and tabs
into words. For each order from 1 to 5 the tasks add the hashes of their phrases to a one-row sketch
(the row saturates, the tasks' rows are added by a shuffle on blocks of cells); a cell's sum bounds the
count of each phrase in it from above. A phrase of the next order is only sketched if both of its parts
one word shorter can reach the least count. What passes all bounds is a candidate: no frequent phrase
is lost, some rare ones come along. One more pass counts the candidates of each task, whatever their
number; the tasks' counts are summed by phrase and only then compared with the least count. Tasks are as
many as the cores ask for, however long the texts: each adds up all that it reads before it hands it on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import U64, as_bytes, bounds, chunks, mix, own_worker, run_hashes, stored, trim

#: Words of the longest phrase; the least count; phrases listed for each language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Parts of a language that are ranked side by side.
DEAL = 64
#: Cells of a sketch: at least, at most. Beyond the most the bounds get looser and candidates more; counts stay exact.
CELLS, CELLS_MOST = 1 << 24, 1 << 27
#: Cells of a block, and tasks whose blocks are added at once (256 times 192 KB at most).
BLOCK, FAN = 1 << 16, 256
#: Tasks for each core. A task names each of its phrases once, so with a task for each stretch of text the rows would be phrases times text; so many tasks keep them in step with the phrases.
TASKS = 2
#: Characters of the different phrases that a task holds with their counts (about 100 MB); beyond them it hands on what it has and begins anew.
AUTOMATON_CHARS = 30_000_000
CHUNK_BYTES = 2_000_000

#: Lower-cases A-Z; tabs become spaces, breaks between pieces line ends.
PLAIN = bytes(32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = np.array([c not in (10, 32) for c in range(256)])
_SKETCH = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
SKETCH_SCHEMA = "block int, shard int, cells binary, counts binary"


class Words:
    """The words of some texts: hashes (that differ by language), bytes from `starts` to `ends`, and their pieces."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.data = b"\n".join(texts).translate(PLAIN)
        raw = np.frombuffer(self.data, np.uint8)
        self.starts, self.ends = bounds(_WORD[raw])
        cuts = np.cumsum([0] + [len(x) + 1 for x in texts])
        self.doc = np.searchsorted(cuts, self.starts, "right") - 1
        names = sorted(set(langs))
        at = np.array([names.index(x) for x in langs], np.int64)
        seed = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
        self.hash = mix(run_hashes(raw, self.starts, self.ends) + seed[at[self.doc]]) if len(self.starts) else np.zeros(0, np.uint64)
        self.piece = np.cumsum(raw == 10)[self.starts] if len(self.starts) else np.zeros(0, np.int64)

    def orders(self, bits: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: first words of the phrases whose parts passed the sketches so far, and their hashes.

        All orders but the last are narrowed by their own sketch, too: there are as many sketches or one less.
        """
        n = len(self.hash)
        may, own = np.ones(n, bool), self.hash
        for k in range(1, len(bits) + 2):
            if k > 1:
                m = max(0, n - k + 1)
                may = may[:m] & may[1 : m + 1] & (self.piece[:m] == self.piece[k - 1 : m + k - 1]) if m else np.zeros(0, bool)
                own = mix(own[:m] * U64(0x9E3779B97F4A7C15) + self.hash[k - 1 : m + k - 1]) if m else np.zeros(0, np.uint64)
            first = np.flatnonzero(may)
            if k <= len(bits):
                cell = own[first] & U64(8 * len(bits[k - 1]) - 1)
                passed = (bits[k - 1][(cell >> U64(3)).astype(np.int64)] >> (cell & U64(7)).astype(np.uint8)) & 1
                first = first[passed == 1]
                may = np.zeros(len(may), bool)
                may[first] = True
            yield first, own[first]

    def phrase(self, first: int, k: int) -> bytes:
        """The words with one space between them."""
        return b" ".join(x for x in self.data[self.starts[first] : self.ends[first + k - 1]].split(b" ") if x)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    own_worker("phrases")
    for batch in batches:
        for part in chunks(batch, "text", CHUNK_BYTES):
            yield as_bytes(part.column("text")), part.column("lang").to_pylist()


def _sketch(bits: list[np.ndarray], cells: int, kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.iinfo(kind).max
        row = np.zeros(cells, kind)
        for texts, langs in _read(batches):
            *_, (_, hashes) = Words(texts, langs).orders(bits)
            at, n = np.unique(hashes & U64(cells - 1), return_counts=True)
            at = at.astype(np.int64)
            row[at] = np.minimum(row[at] + n, most)
        shard = TaskContext.get().partitionId()
        for lo in range(0, cells, BLOCK):
            own = row[lo : lo + BLOCK]
            used = np.flatnonzero(own)
            if len(used):
                yield pa.record_batch([pa.array([lo // BLOCK], pa.int32()), pa.array([shard], pa.int32()), pa.array([used.astype("<u2").tobytes()]), pa.array([own[used].tobytes()])], schema=_SKETCH)
        del row
        trim()

    return run


def _add(kind: str):
    """The sum of some tasks' rows of one block, again as its used cells."""

    def run(group: pa.Table) -> pa.Table:
        own_worker("phrases")
        total = np.zeros(BLOCK, np.int64)
        for cells, counts in zip(group.column("cells").to_pylist(), group.column("counts").to_pylist()):
            total[np.frombuffer(cells, "<u2")] += np.frombuffer(counts, kind)
        used = np.flatnonzero(total)
        counts = np.minimum(total[used], np.iinfo(kind).max).astype(kind)
        return pa.table([[group.column("block")[0].as_py()], [group.column("shard")[0].as_py()], [used.astype("<u2").tobytes()], [counts.tobytes()]], schema=_SKETCH)

    return run


def _bits(rows: DataFrame, shards: int, cells: int, least: int, kind: str) -> np.ndarray:
    """A bit for each cell that reaches `least`, from the sketches of so many tasks. Goes through the driver: cells / 8 bytes, 16 MB at most."""

    def reach(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for used, counts in zip(batch.column("cells").to_pylist(), batch.column("counts").to_pylist()):
                own = np.zeros(BLOCK, bool)
                own[np.frombuffer(used, "<u2")] = np.frombuffer(counts, kind) >= least
                out.append(np.packbits(own, bitorder="little").tobytes())
            yield pa.record_batch([batch.column("block"), pa.array(out, pa.binary())], names=["block", "bits"])

    add = _add(kind)
    if shards > FAN:  # the rows of FAN tasks first, then their sums
        rows = rows.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int")).groupBy("block", "shard").applyInArrow(add, SKETCH_SCHEMA)
    all_ = rows.groupBy("block").applyInArrow(add, SKETCH_SCHEMA).mapInArrow(reach, "block int, bits binary")
    out = np.zeros(cells // 8, np.uint8)
    for r in all_.collect():
        out[r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
    return out


class Tally:
    """Counts of the phrases of one order, by hash; `row` is a phrase's place among the texts that the task holds."""

    def __init__(self):
        self.hash, self.n, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray, rows: int) -> np.ndarray:
        """Count the occurrences; places of the phrases that are new, which get the rows from `rows` on."""
        each, at, n = np.unique(hashes, return_index=True, return_counts=True)
        place = np.searchsorted(self.hash, each)
        known = place < len(self.hash)
        known[known] = self.hash[place[known]] == each[known]
        self.n[place[known]] += n[known]
        new = ~known
        place = place[new]
        self.hash, self.n = np.insert(self.hash, place, each[new]), np.insert(self.n, place, n[new])
        self.row = np.insert(self.row, place, rows + np.arange(len(place)))
        return at[new]


def _counts(bits: list[np.ndarray]):
    """Each task's counts of the phrases that pass all sketches, and its words for each language (without phrase)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        tallies, held, rows, chars = [Tally() for _ in bits], [], 0, 0

        def given() -> Iterator[pa.RecordBatch]:
            n = np.zeros(rows, np.int64)
            for x in tallies:
                n[x.row] = x.n
            lo = 0
            for langs, phrases in held:
                yield pa.record_batch([langs, phrases, pa.array(n[lo : lo + len(langs)])], names=["lang", "phrase", "n"])
                lo += len(langs)

        for texts, langs in _read(batches):
            w = Words(texts, langs)
            for lang, n in zip(langs, np.bincount(w.doc, minlength=len(texts)).tolist()):
                total[lang] = total.get(lang, 0) + n
            out: list[tuple[str, str]] = []
            for k, (tally, (first, hashes)) in enumerate(zip(tallies, w.orders(bits)), 1):
                out += [(langs[w.doc[i]], w.phrase(i, k).decode()) for i in first[tally.add(hashes, rows + len(out))].tolist()]
            if out:
                held.append((pa.array([x for x, _ in out]), pa.array([x for _, x in out])))
                rows += len(out)
                chars += sum(len(x) for _, x in out)
            if chars > AUTOMATON_CHARS:
                yield from given()
                tallies, held, rows, chars = [Tally() for _ in bits], [], 0, 0
        yield from given()
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([None] * len(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "phrase", "n"])
        trim()

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of the phrases of up to `longest` words with f >= least, and (lang, n) of all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang")).coalesce(TASKS * spark.sparkContext.defaultParallelism)
    size, shards = rows.select(F.octet_length("text").alias("bytes"), F.spark_partition_id().alias("part")).agg(F.sum("bytes"), F.max("part")).first()
    size, shards = size or 0, (shards or 0) + 1
    cells = CELLS
    while cells < CELLS_MOST and cells * least < 2 * size:
        cells *= 2
    kind = "<u1" if least <= 255 else "<u4"
    bits: list[np.ndarray] = []
    for _ in range(longest):
        bits.append(_bits(rows.mapInArrow(_sketch(list(bits), cells, kind), SKETCH_SCHEMA), shards, cells, least, kind))
    found = rows.mapInArrow(_counts(bits), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    found = stored(found.filter((F.col("n") >= least) | F.col("phrase").isNull()), "frequent")
    total = found.filter("phrase IS NULL").select("lang", "n")
    return found.filter("phrase IS NOT NULL").select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), F.col("n").alias("f")), total


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's first `top` phrases of 2 to `longest` words by cohesion: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, n the language's words; of the cuts into two parts with counts l and r, that of
    the lowest floor(1000 * a * n / (l * r)) counts, of equals the first. A phrase inside a longer candidate
    with the same count is dropped. Ties of score and count go by the phrase's bytes. A null language is
    `und`; null and empty texts have no words; repeated rows count each. Only text and lang are read. Phrases
    are told apart by 64-bit hashes in the sketches and within a task, then by their words. An empty table gives an empty one.
    """
    counts, total = phrase_counts(docs, least, longest)
    many = counts.filter("words > 1")
    words = F.split("phrase", " ")
    # a phrase inside a longer one of the same count lies inside one that is a word longer, with that count
    part = lambda start: F.array_join(F.slice(words, start, F.col("words") - 1), " ")
    longer = many.select("lang", F.explode(F.array_distinct(F.array(part(1), part(2)))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("inside"))
    kept = many.join(longer, ["lang", "phrase"], "left").filter("inside IS NULL OR inside < f").drop("inside")
    cut = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), words.alias("w"))
    join = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cut = cut.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("first"), join(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    cut = cut.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(total, "lang")
    score = F.expr("cast(1000BD * cast(a as decimal(15,0)) * cast(n as decimal(19,0)) as decimal(38,0)) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    flat = best.select("lang", "phrase", *[F.col(f"b.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])
    # the first of each part of a language before the first of the language: DEAL * top rows of it meet in one task at most
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    flat = flat.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(DEAL))).withColumn("rank", rank("part")).filter(F.col("rank") <= top)
    return flat.withColumn("rank", rank()).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
