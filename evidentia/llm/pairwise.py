"""Quality scores by Bradley-Terry ranking: preference pairs, feature differences, logistic loss.

The features describe a text alone. All training rows are learnt from, in all pairs (a document labelled 1
is preferred to one labelled 0): in each step of Newton's method the rows are summed in narrow bins of
their score, and a pair of bins stands for all pairs of their rows, so work grows with the rows and not
with the pairs. The threshold is the quantile of the training rows' scores at which fewest rows are
wrong; a logistic map puts that quantile at 0.3.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE, as_bytes, chunks, id_and_text, own_worker, shingle_hashes, stored, word_hashes
from .labelled import held_out, logistic, shares, training

#: Bins of a score's unit. The loss is taken at the mean of a bin's rows, so its error is of the order of 1 / (200 * BINS ** 2) at most.
BINS = 16
#: Rows are summed as whole numbers of these units, so that their order and their partitions change nothing.
MOMENT, FINE, ROOT = 2.0**30, 2.0**20, 2.0**12
RIDGE, STEPS, ENOUGH = 1e-3, 40, 1e-4
#: Parts of a score's unit whose cuts are compared side by side; equal scores are one row.
PARTS = 1024
CHUNK_BYTES = 3_000_000
THRESHOLD = 0.3
NAMES = ["log_words", "word_chars", "distinct", "top_word", "adjacent", "windows", "upper", "digit", "symbol", "bang", "punct", "newline", "other", "dup_lines", "pipes", "long_words"]


def _sets() -> np.ndarray:
    out = np.zeros((7, 256), bool)
    for k, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>", "!?", ".,;:'\"()-", "\n", "|")):
        out[k, [ord(c) for c in chars]] = True
    return out


_CLASSES = _sets()
_CODE = np.full(256, 7, np.uint8)
for _k, _row in enumerate(_CLASSES):
    _CODE[_row] = _k


def text_features(texts: list[bytes]) -> np.ndarray:
    """A row of NAMES for each text; an empty text has zeros."""
    data = np.frombuffer(b" ".join(texts) or b" ", np.uint8)
    words, starts, ends = word_hashes(data)
    sizes = ends - starts
    base = np.cumsum([0] + [len(x) + 1 for x in texts])
    cuts = np.searchsorted(starts, base).tolist()
    out = np.zeros((len(texts), len(NAMES)))
    code = _CODE[data]
    for i, text in enumerate(texts):
        a, b, n = cuts[i], cuts[i + 1], len(text)
        if b == a:
            continue
        w, m = words[a:b], b - a
        counts = np.bincount(code[base[i] : base[i] + n], minlength=8) / n
        _, each = np.unique(w, return_counts=True)
        grams = shingle_hashes(w, 3)
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[i] = (np.log1p(m), min(30.0, sizes[a:b].mean()), len(each) / m, each.max() / m, np.count_nonzero(w[1:] == w[:-1]) / m, 1 - len(np.unique(grams)) / len(grams), counts[0], counts[1], counts[2], counts[3], counts[4], counts[5], np.count_nonzero(SPACE[data[base[i] : base[i] + n]]) / n, 1 - len(set(lines)) / len(lines), counts[6], np.count_nonzero(sizes[a:b] > 20) / m)
    return out


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own_worker("pairwise")
    for batch in batches:
        for piece in chunks(batch, "text", CHUNK_BYTES):
            x = text_features(as_bytes(piece.column("text")))
            yield pa.record_batch([piece.column("doc_id"), piece.column("held_out"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "held_out", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES))


def _sums(rows: DataFrame, width: int, parts: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ascending order and the sums of the `width` whole numbers a key that `parts` gives for some rows' features and labels.

    A task hands on one row for each of its keys, and these arrays are added up whole.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("pairwise")
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, numbers = parts(_matrix(batch.column("x")), batch.column("label").to_numpy())
            for k, v in zip(keys.tolist(), numbers):
                total[k] = total[k] + v if k in total else v
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.int64()))], names=["key", "v"])

    whole = F.array_repeat(F.lit(0).cast("decimal(38,0)"), width)
    add = lambda a, v: F.zip_with(a, v, lambda p, q: (p + q).cast("decimal(38,0)"))
    each = rows.mapInArrow(run, "key long, v array<long>").groupBy("key").agg(F.collect_list("v").alias("v"))
    got = each.select("key", F.aggregate("v", whole, add, lambda a: a.cast("array<double>")).alias("v")).toArrow()
    key = got.column("key").to_numpy()
    order = np.argsort(key)
    return key[order], got.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)[order]


def _by_key(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' numbers summed by key."""
    order = np.argsort(keys, kind="stable")
    each, first = np.unique(keys[order], return_index=True)
    return each, np.add.reduceat(numbers[order].astype(np.int64), first, axis=0) if len(first) else numbers.astype(np.int64)


class Ranking:
    """Weights, centre and spread of the features, and the map from a Bradley-Terry score to 0..1.

    This one is learnt from arrays in memory and so many drawn pairs; rank_quality learns a Whole one.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, share: dict[int, int], pairs: int, seed: int = 7):
        self.ok = bool((y == 1).any() and (y == 0).any())
        total = sum(share.values())
        self.base = share.get(1, 0) / total if total else 0.5
        if not self.ok:
            return
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        z = self._wide(x)
        rng = np.random.default_rng(seed)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        i, j = rng.choice(good, pairs), rng.choice(bad, pairs)
        d = z[i] - z[j]
        self.w = logistic(np.concatenate((d, -d)), np.repeat([1.0, 0.0], pairs), ridge=1e-3, intercept=False)[:-1]
        s = z @ self.w
        weight = np.where(y == 1, share.get(1, 1) / len(good), share.get(0, 1) / len(bad))
        order = np.argsort(s, kind="stable")
        s, y, weight = s[order], y[order], weight[order]
        # wrong rows if the cut lies before position k
        wrong = np.concatenate(([0], np.cumsum(np.where(y == 1, weight, 0)))) + np.concatenate((np.cumsum(np.where(y == 0, weight, 0)[::-1])[::-1], [0]))
        best = np.flatnonzero(wrong == wrong.min())
        k = int(best[len(best) // 2])
        self.cut = (s[max(k - 1, 0)] + s[min(k, len(s) - 1)]) / 2
        self.quantile = float(weight[:k].sum() / weight.sum())
        self.slope = 1 / max(1e-3, 0.5 * float(np.std(s - self.cut)))

    def _wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.column_stack([z, np.minimum(z * z, 9)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ok:
            return np.full(len(x), self.base)
        # summed row by row: a matrix product rounds differently with the number of rows
        s = ((self._wide(x) * self.w).sum(1) - self.cut) * self.slope
        return 1 / (1 + np.exp(-np.clip(s + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


class Whole(Ranking):
    """A ranking learnt from all rows of `train` (label, x) and all their pairs, by sums over Spark."""

    def __init__(self, train: DataFrame, base: float):
        self.base, width = base, len(NAMES)
        labels, sums = _sums(train, 1 + 2 * width, lambda x, y: _by_key(y, np.rint(np.column_stack([np.ones(len(x)), x, x * x]) * MOMENT)))
        self.ok = labels.tolist() == [0, 1]
        if not self.ok:
            return
        n, sums = sums[:, 0] / MOMENT, sums.sum(0)
        self.mean = sums[1 : width + 1] / sums[0]
        self.std = np.sqrt(np.maximum(sums[width + 1 :] / sums[0] - self.mean**2, 0)) + 1e-6
        self.w = np.zeros(2 * width)
        best, step = np.inf, np.zeros(2 * width)
        for _ in range(STEPS):
            keys, bins = self._bins(train)
            loss, gradient, weight, cross = self._pairs(keys, bins, n)
            if loss > best + 1e-6:  # too far: half the way back
                step /= 2
                self.w += step
                continue
            best = loss
            step = np.linalg.solve(self._curvature(train, keys, weight) - cross - cross.T + RIDGE * np.eye(2 * width), gradient)
            step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < ENOUGH:
                break
            self.w -= step
        keys, bins = self._bins(train)
        rows, score = bins[:, 0], bins[:, 1:] @ self.w / bins[:, 0]
        self.slope = 1 / max(1e-3, 0.5 * float(np.sqrt(np.average((score - np.average(score, weights=rows)) ** 2, weights=rows))))
        self._threshold(train)

    def _key(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Twice the number of the score's bin, and the label."""
        return 2 * np.floor((z * self.w).sum(1) * BINS).astype(np.int64) + y

    def _bins(self, train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each bin and label, and the sums of their features."""

        def parts(x: np.ndarray, y: np.ndarray):
            z = self._wide(x)
            return _by_key(self._key(z, y), np.rint(np.column_stack([np.ones(len(z)), z]) * FINE))

        keys, sums = _sums(train, 1 + len(self.w), parts)
        return keys, sums / FINE

    def _pairs(self, keys: np.ndarray, bins: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Mean loss of all pairs and its gradient; each bin's share in the second derivative, and what of that is between bins."""
        rows, sums, score = bins[:, 0], bins[:, 1:], bins[:, 1:] @ self.w / bins[:, 0]
        bad, good = keys % 2 == 0, keys % 2 == 1
        d, pairs = score[good][:, None] - score[bad], n[0] * n[1]
        lost = 1 / (1 + np.exp(np.clip(d, -40, 40)))
        curve = lost * (1 - lost)
        loss = rows[good] @ np.logaddexp(0, -d) @ rows[bad] / pairs + RIDGE / 2 * self.w @ self.w
        gradient = (sums[bad].T @ (lost.T @ rows[good]) - sums[good].T @ (lost @ rows[bad])) / pairs + RIDGE * self.w
        weight = np.zeros(len(keys))
        weight[good], weight[bad] = curve @ rows[bad] / pairs, curve.T @ rows[good] / pairs
        return float(loss), gradient, weight, sums[good].T @ curve @ sums[bad] / pairs

    def _curvature(self, train: DataFrame, keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The rows' squares, each with its bin's share."""
        most = weight.max()

        def parts(x: np.ndarray, y: np.ndarray):
            z = self._wide(x)
            u = np.rint(z * np.sqrt(weight[np.searchsorted(keys, self._key(z, y))] / most)[:, None] * ROOT)
            return np.arange(len(self.w)), (u.T @ u).astype(np.int64)  # whole numbers far below 2 ** 53: exact

        return _sums(train, len(self.w), parts)[1] * (most / ROOT**2)

    def _threshold(self, train: DataFrame) -> None:
        """Cut and quantile: between two scores where fewest rows are wrong, of equally good cuts the middle one."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_worker("pairwise")
            for batch in batches:
                s = (self._wide(_matrix(batch.column("x"))) * self.w).sum(1)
                yield pa.record_batch([pa.array(np.floor(s * PARTS).astype(np.int64)), pa.array(s), batch.column("label")], names=["part", "s", "label"])

        spark = train.sparkSession
        scores = stored(train.mapInArrow(run, "part long, s double, label int").groupBy("part", "s").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")), "scores")
        each = scores.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow().sort_by("part")
        part, good, bad = (each.column(c).to_numpy() for c in ("part", "good", "bad"))
        # a cut in a part has the good rows of the parts before on its wrong side, and all the bad rows that are not below it
        start = np.cumsum(good) - good + bad.sum() - (np.cumsum(bad) - bad)
        below = np.cumsum(good + bad) - good - bad
        starts = spark.createDataFrame(pa.table({"part": part, "start": start, "below": below}))
        upto = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cuts = scores.join(F.broadcast(starts), "part").select("s", (F.col("start") + F.sum(F.col("good") - F.col("bad")).over(upto)).alias("wrong"), (F.col("below") + F.sum(F.col("good") + F.col("bad")).over(upto)).alias("rows"))
        cuts = stored(cuts, "cuts")
        least = cuts.agg(F.min("wrong").alias("wrong"), F.min("s").alias("s")).first()
        if bad.sum() < least.wrong:  # nothing is cut off
            self.cut, self.quantile = least.s, 0.0
            return
        best = cuts.filter(F.col("wrong") == least.wrong)
        at = best.orderBy("s").offset(best.count() // 2).limit(1).first()
        above = cuts.filter(F.col("s") > at.s).agg(F.min("s")).first()[0]
        self.cut, self.quantile = (at.s + (at.s if above is None else above)) / 2, at.rows / int((good + bad).sum())


def rank_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    All training rows are learnt from. A null text is scored as an empty one, a null doc_id is held out, repeated
    rows get equal scores; a text is scored whole, however long. Other columns are not read; an empty table gives
    an empty one. Without labels of both kinds the score is the share of label 1 (0.5 without any).
    """
    share = shares(labels, "quality")
    features = stored(id_and_text(docs).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_features, "doc_id long, held_out boolean, x array<double>"), "features")
    train = stored(features.filter("NOT held_out").join(training(labels, "quality"), "doc_id").select("label", "x"), "training")
    model = Whole(train, share.get(1, 0) / sum(share.values()) if share else 0.5)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("pairwise")
        for batch in batches:
            score = model.score(_matrix(batch.column("x")))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return features.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
