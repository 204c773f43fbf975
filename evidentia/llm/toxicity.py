"""Toxicity by two Kneser-Ney language models with shared backoff.

Each class has a model of the bytes of words, given the five bytes before in the word. Discounted
counts of the class are interpolated with lower orders whose continuation counts are shared by both
classes, so what neither class has seen weighs the same in both and cancels. The classes' counts come
from a bounded sample of labelled rows, the shared continuation counts from all documents. A text is
compared by the difference of the log-likelihoods per byte: over the whole text, over its most toxic
stretch of WINDOW words, and over its two most toxic words. A logistic map of these, fitted on training
rows that the models have not seen, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, U64, as_bytes, bounds, chunks, id_and_text, own_worker, run_hashes, trim
from .labelled import held_out, logistic, sample

#: Labelled rows of each class at most; two thirds train the models, the rest the map.
SAMPLE_ROWS = 6000
ORDER, DISCOUNT, WINDOW = 6, 0.75, 12
#: Discount of the classes' own counts (numbers of documents); rarer expressions rest on the shared counts alone.
CLASS_DISCOUNT = 3.0
CHUNK_BYTES = 1_000_000
THRESHOLD = 0.5
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_EDGE = 1  # stands for what is before and after a word
#: Continuations that a worker remembers before it starts afresh.
MOST_SEEN = 2_000_000


def _last(grams: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes of each gram."""
    return grams & U64((1 << (8 * k)) - 1)


def _level(k: int) -> np.uint64:
    """Marks keys of order k, above the bytes of a gram."""
    return U64(k << (8 * ORDER))


def word_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ORDER bytes up to each byte of the words and to the edge after them, as integers, and where each word's begin."""
    sizes = ends - starts + 1
    first = np.cumsum(sizes) - sizes
    offset = np.arange(sizes.sum()) - np.repeat(first, sizes)
    at = np.repeat(starts, sizes) + offset
    out = np.where(offset == np.repeat(sizes - 1, sizes), _EDGE, data[np.minimum(at, len(data) - 1)]).astype(np.uint64)
    for j in range(1, ORDER):
        out |= np.where(offset >= j, data[np.maximum(at - j, 0)], _EDGE).astype(np.uint64) << U64(8 * j)
    return out, first


def _split(texts: list[bytes]):
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    starts, ends = bounds(_LETTER[data])
    cuts = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in texts]))
    each, pick, inverse = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return data, starts, ends, cuts, pick, inverse


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own_worker("toxicity")
        label = np.array(batch.column("label").to_pylist())
        texts = as_bytes(batch.column("text"))
        for k in (0, 1):
            own = [texts[i] for i in np.flatnonzero(label == k)]
            if not own:
                continue
            data, starts, ends, cuts, pick, inverse = _split(own)
            if not len(starts):
                continue
            doc = np.repeat(np.arange(len(own)), np.diff(cuts))
            times = np.bincount(np.unique(inverse * np.int64(len(own)) + doc) // len(own), minlength=len(pick))
            grams, first = word_grams(data, starts[pick], ends[pick])
            weight = np.repeat(times, np.diff(np.append(first, len(grams))))
            values, at = np.unique(grams, return_inverse=True)
            n = np.bincount(at, weight).astype(np.int64)
            yield pa.record_batch([pa.array(values.astype(np.int64)), pa.array(n if k == 0 else n * 0), pa.array(n if k else n * 0)], names=["gram", "ordinary", "toxic"])


def _of(values: np.ndarray, keys: np.ndarray, table: np.ndarray, default: float) -> np.ndarray:
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return np.where(keys[at] == values, table[at], default) if len(keys) else np.full(len(values), default)


def _has(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values if len(keys) else np.zeros(len(values), bool)


def contexts_of(grams: np.ndarray) -> np.ndarray:
    """Keys of the contexts that the lower orders of these grams need, sorted."""
    return np.unique(np.concatenate([_level(k) | (_last(grams, k) >> U64(8)) for k in range(1, ORDER)]))


def _continuations(contexts: np.ndarray):
    """Grams of k + 1 bytes, for each order k, whose context is among these; a worker's repetitions are mostly left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("toxicity")
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            for piece in chunks(batch, "text", CHUNK_BYTES):
                data, starts, ends, _, pick, _ = _split(as_bytes(piece.column("text")))
                if not len(starts):
                    continue
                grams = np.unique(word_grams(data, starts[pick], ends[pick])[0])
                found = []
                for k in range(1, ORDER):
                    longer = np.unique(_last(grams, k + 1))
                    found.append(_level(k) | longer[_has(_level(k) | (_last(longer, k) >> U64(8)), contexts)])
                keys = np.concatenate(found)
                new = keys[~_has(keys, seen)]
                if len(new):
                    seen = np.union1d(seen, new) if len(seen) < MOST_SEEN else np.sort(new)
                    yield pa.record_batch([pa.array(new.astype(np.int64))], names=["gram"])
        trim()

    return run


def shared_counts(docs: DataFrame, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lower orders and the number of different bytes before each, over all documents.

    Only contexts of `grams` are counted, so at most 256 rows for each context of the bounded sample go
    to the driver, however large the corpus is.
    """
    pairs = id_and_text(docs).select("text").mapInArrow(_continuations(contexts_of(grams)), "gram long").distinct()
    level = f"shiftright(gram, {8 * ORDER})"
    own = F.expr(f"shiftleft({level}, {8 * ORDER}) | (gram & (shiftleft(1L, cast(8 * {level} as int)) - 1L))")
    got = pairs.groupBy(own.alias("own")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    keys = got.column("own").to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    return keys[order], got.column("n").to_numpy()[order]


class Models:
    """Tables of log-likelihood differences: of the grams seen, and of the contexts for unseen ones."""

    def __init__(self, gram: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray, lower: np.ndarray, befores: np.ndarray):
        order = np.argsort(gram)
        gram, counts = gram[order].astype(np.uint64), {0: ordinary[order], 1: toxic[order]}
        shared = np.full(1, 1 / 256)
        keys = np.zeros(1, np.uint64)
        for k in range(1, ORDER):  # orders 1 to ORDER - 1 by the number of different bytes before
            level = slice(*np.searchsorted(lower, [_level(k), _level(k + 1)]))
            own, n = _last(lower[level], k), befores[level]
            context, at = np.unique(own >> U64(8), return_inverse=True)
            total, kinds = np.bincount(at, n), np.bincount(at)
            below = _of(_last(own, k - 1), keys, shared, 1 / 256)
            keys, shared = own, np.maximum(n - DISCOUNT, 0) / total[at] + DISCOUNT * kinds[at] / total[at] * below
        below = _of(_last(gram, ORDER - 1), keys, shared, 1 / 256)
        context, at = np.unique(gram >> U64(8), return_inverse=True)
        log_p, log_rest = {}, {}
        for c in (0, 1):
            total, taken = np.bincount(at, counts[c]), np.bincount(at, np.minimum(counts[c], CLASS_DISCOUNT))
            rest = np.where(total > 0, taken / np.maximum(total, 1), 1.0)
            log_p[c] = np.log(np.where(total[at] > 0, np.maximum(counts[c] - CLASS_DISCOUNT, 0) / np.maximum(total[at], 1), 0) + rest[at] * below)
            log_rest[c] = np.log(rest)
        gap, wide = log_p[1] - log_p[0], log_rest[1] - log_rest[0]
        self.grams, self.gaps = gram, gap.astype(np.float32)
        self.contexts, self.rests = context, wide.astype(np.float32)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Difference of the log-likelihoods (toxic less ordinary) of each word."""
        if not len(starts):
            return np.zeros(0)
        grams, first = word_grams(data, starts, ends)
        gap = _of(grams, self.grams, self.gaps, np.nan)
        odd = np.flatnonzero(np.isnan(gap))
        gap[odd] = _of(grams[odd] >> U64(8), self.contexts, self.rests, 0.0)
        return np.add.reduceat(gap, first)

    def compare(self, texts: list[bytes]) -> np.ndarray:
        """Per text: whole, most toxic stretch, most toxic two words, and log of its words."""
        data, starts, ends, cuts, pick, inverse = _split(texts)
        gap = self.words(data, starts[pick], ends[pick])[inverse] if len(starts) else np.zeros(0)
        size = (ends - starts + 1).astype(float)
        out = np.zeros((len(texts), 5))
        for i, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            if a == b:
                continue
            g, n = gap[a:b], size[a:b]
            w = min(WINDOW, b - a)
            total, chars = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(n)))
            top = np.partition(g, -2)[-2:] if b - a > 1 else np.array([0.0, g[0]])
            out[i] = (total[-1] / chars[-1], ((total[w:] - total[:-w]) / (chars[w:] - chars[:-w])).max(), top[1], top[0], np.log1p(b - a))
        return out


def _matrix(models: Models, column: str, kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("toxicity")
        for batch in batches:
            for piece in chunks(batch, "text", CHUNK_BYTES):
                x = models.compare(as_bytes(piece.column("text")))
                yield pa.record_batch([piece.column(column), pa.array(list(x), pa.list_(pa.float64()))], names=[column, "x"])

    return run, f"{column} {kind}, x array<double>"


class Judge:
    def __init__(self, models: Models | None, x: np.ndarray, y: np.ndarray, base: float):
        self.models, self.base = models, base
        self.ok = models is not None and bool((y == 1).any() and (y == 0).any())
        if self.ok:
            self.mean, self.std = x.mean(0), x.std(0) + 1e-6
            weight = np.where(y == 1, max(1, (y == 1).sum()), max(1, (y == 0).sum())) ** -0.5
            self.beta = logistic(self._scaled(x), y, weight, ridge=2e-3)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -6, 6)

    def rate(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text, and difference of its two log-likelihoods per byte."""
        if not self.ok:
            return np.full(len(texts), self.base), np.zeros(len(texts))
        x = self.models.compare(texts)
        z = self._scaled(x)
        # summed row by row: a matrix product rounds differently with the number of rows
        return 1 / (1 + np.exp(-np.clip((z * self.beta[:-1]).sum(1) + self.beta[-1], -40, 40))), x[:, 0]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Judge:
    """Models and map from at most `rows` training rows of each label.

    Counts are added up on the executors; the driver gets one row per different gram of the sample,
    the shared counts that these need and the few figures of each text for the map.
    """
    got = sample(docs, labels, "toxic", rows).select("doc_id", "label", "text").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)))
    counted = got.filter("part < 2").select("label", "text").mapInArrow(_counts, "gram long, ordinary long, toxic long")
    table = counted.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).toArrow()
    if not table.num_rows:
        return Judge(None, np.zeros((0, 5)), np.zeros(0), 0.0)
    gram = table.column("gram").to_numpy()
    models = Models(gram, table.column("ordinary").to_numpy(), table.column("toxic").to_numpy(), *shared_counts(docs, gram.astype(np.uint64)))
    run, kind = _matrix(models, "label", "int")
    rest = got.filter("part = 2").select("label", "text").mapInArrow(run, kind).toArrow()
    x = np.array(rest.column("x").to_pylist(), float).reshape(-1, 5)
    y = np.array(rest.column("label").to_pylist(), int)
    order = np.lexsort((*x.T, y))
    return Judge(models, x[order], y[order], 0.0)


def rate_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, difference (of the log-likelihoods per byte, toxic less ordinary).

    A null text is scored as an empty one, a null doc_id is held out, repeated rows get equal scores; a
    text is scored whole, however long. Other columns are not read. Without labels of both kinds every
    score is 0. An empty table gives an empty one.
    """
    judge = fit(docs, labels, rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("toxicity")
        for batch in batches:
            for piece in chunks(batch, "text", CHUNK_BYTES):
                score, gap = judge.rate(as_bytes(piece.column("text")))
                yield pa.record_batch([piece.column("doc_id"), piece.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(gap)], names=["doc_id", "held_out", "score", "predicted", "difference"])
        trim()

    return id_and_text(docs).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, difference double")


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with all columns, without those that are predicted toxic; one pass over the texts, nothing is shuffled.

    Nulls, empty texts, repeated rows and missing labels are as in rate_toxicity: an empty or null text
    stays unless empty texts are toxic, rows with equal texts stay or go alike. An empty table gives an
    empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    judge = fit(docs, labels)
    kind = to_arrow_schema(docs.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("toxicity")
        for batch in batches:
            for piece in chunks(batch, "text", CHUNK_BYTES):
                keep = judge.rate(as_bytes(piece.column("text")))[0] < THRESHOLD
                yield piece.filter(pa.array(keep)).cast(kind)
        trim()

    return docs.mapInArrow(run, docs.schema)
