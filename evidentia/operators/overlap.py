"""Similarity joins on token sets: which sentence holds most of an anchor's tokens, without meeting all sentences.

Anchors of up to TOKEN_ROWS tokens go to all tasks, which read the sentences once and hand on the best of each
anchor: no pair is shuffled or kept. More anchors, and those with `by`, are joined. If an anchor of k tokens must have m of them in a sentence, one of its k - m + 1 rarest is there. Only these
are joined with the sentences' tokens; pairs that meet are then measured on whole sets. Anchors that no
sentence answers go on with a lower threshold, down to any common token, so frequent tokens are joined
for those anchors alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of anchor tokens that are broadcast at most (some tens of bytes each); more are joined by a shuffle.
TOKEN_ROWS = 500_000
#: Thresholds tried in turn; 0 is any common token.
LEVELS = (0.5, 0.2, 0.0)
#: Counts of sentences by anchors that a task holds at once (8 bytes each, some times over).
CELLS = 1_000_000


def fits(anchors: DataFrame) -> bool:
    """Whether the anchors' different tokens are few enough for all tasks."""
    return anchors.select(F.explode(F.array_distinct("tokens"))).limit(TOKEN_ROWS + 1).count() <= TOKEN_ROWS


def _best(names: pa.Table, tokens: pa.ChunkedArray):
    """For each anchor (names) the most tokens that a sentence of the task has of it, and the least s of these sentences."""
    total, flat = len(tokens), pc.list_flatten(tokens).combine_chunks()
    vocabulary = flat.unique()
    word = pc.index_in(flat, value_set=vocabulary).to_numpy()
    owner = pc.list_parent_indices(tokens).to_numpy()[np.argsort(word, kind="stable")]
    start = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(vocabulary)))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for batch in batches:
            s = batch.column("s").to_numpy()
            order = np.argsort(s, kind="stable")
            s, place = s[order], np.empty(len(s), np.int64)
            place[order] = np.arange(len(s))
            found = pc.index_in(pc.list_flatten(batch.column("tokens")), value_set=vocabulary)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            row = place[pc.list_parent_indices(batch.column("tokens")).to_numpy()[known]]
            # a sentence's different tokens, the sentences by s
            row, w = np.divmod(np.unique(row * len(vocabulary) + found.drop_null().to_numpy()), max(1, len(vocabulary)))
            each = start[w + 1] - start[w]
            upto = np.concatenate(([0], np.cumsum(np.bincount(row, each, len(s)).astype(np.int64))))
            lo = 0
            while lo < len(s):
                hi = max(lo + 1, min(lo + CELLS // total, int(np.searchsorted(upto, upto[lo] + CELLS, "right")) - 1, len(s)))
                a, b = np.searchsorted(row, (lo, hi))
                n = each[a:b]
                one = owner[np.repeat(start[w[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                common = np.bincount(np.repeat(row[a:b] - lo, n) * total + one, minlength=(hi - lo) * total).reshape(hi - lo, total)
                # the most tokens, of equals the first sentence
                most, back = np.divmod((common * (hi - lo) + np.arange(hi - lo)[::-1, None]).max(0), hi - lo)
                first = s[hi - 1 - back]
                better = (most > best) | (most == best) & (first < at)
                best, at = np.where(better, most, best), np.where(better, first, at)
                lo = hi
        some = np.flatnonzero(best)
        out = names.take(pa.array(some)).append_column("s", pa.array(at[some])).append_column("common", pa.array(best[some]))
        yield from out.combine_chunks().to_batches()

    return run


def most_common(anchors: DataFrame, sentences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per anchor (keys, tokens) that has a token in any sentence (s, tokens): common, the most different tokens in one, and the least s (long) of these.

    One pass over the sentences; a task hands on a row for each anchor at most. The anchors go through the driver: see fits().
    """
    sets = anchors.select(*keys, F.explode("tokens").alias("token")).groupBy(*keys).agg(F.collect_set("token").alias("tokens"))
    got = sets.toArrow()
    kind = T.StructType([*[sets.schema[k] for k in keys], T.StructField("s", T.LongType()), T.StructField("common", T.LongType())])
    if not len(got):
        return anchors.sparkSession.createDataFrame([], kind)
    rows = sentences.select(F.col("s").cast("long").alias("s"), "tokens").filter("s IS NOT NULL")
    each = rows.mapInArrow(_best(got.select(list(keys)), got.column("tokens")), kind)
    top = each.groupBy(*keys).agg(F.max(F.struct("common", (-F.col("s")).alias("m"))).alias("b"))
    return top.select(*keys, (-F.col("b.m")).alias("s"), F.col("b.common").alias("common"))


def rare_first(anchors: DataFrame, sentences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anchors (keys, tokens) with their different tokens, those of fewest sentences first."""
    own = anchors.select(*keys, F.explode(F.array_distinct("tokens")).alias("token"))
    wanted = own.select("token").distinct()
    few = wanted.limit(TOKEN_ROWS + 1).count() <= TOKEN_ROWS
    each = sentences.select(F.explode(F.array_distinct("tokens")).alias("token")).join(F.broadcast(wanted) if few else wanted, "token", "left_semi")
    count = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rows = own.join(F.broadcast(count) if few else count, "token", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("t"))
    return rows.select(*keys, F.transform("t", lambda x: x.token).alias("tokens"))


def needed(size: Column, least: float) -> Column:
    """Tokens that must be common for a share of `least`; one at least."""
    return F.greatest(F.lit(1), F.ceil(size * F.lit(least) - 1e-9).cast("int"))


def candidates(ordered: DataFrame, sentences: DataFrame, keys: Sequence[str], by: Sequence[str], least: float) -> DataFrame:
    """Pairs (keys, by, s) that share one of the anchor's rarest tokens, enough of them for the threshold."""
    head = F.slice("tokens", F.lit(1), F.size("tokens") - needed(F.size("tokens"), least) + 1)
    x = ordered.select(*keys, F.explode(head).alias("token"))
    y = sentences.select(*by, "s", F.explode(F.array_distinct("tokens")).alias("token"))
    on = [*by, "token"]
    few = x.limit(TOKEN_ROWS + 1).count() <= TOKEN_ROWS
    return y.join(F.broadcast(x) if few else x, on).select(*dict.fromkeys([*keys, *by, "s"])).distinct()


def best_matches(anchors: DataFrame, sentences: DataFrame, key: Sequence[str], by: Sequence[str] = (), levels: Sequence[float] = LEVELS) -> DataFrame:
    """Per anchor (key, by, tokens): s, score and status of the sentence (by, s, tokens) with most of its tokens, the least s of equals.

    Sentences are those with the same values of `by`, or all. MATCHED has half of the tokens or more, else
    UNGROUNDED; without a common token (or any token) s is null and the score 0. With levels (0.5,) anchors below a
    half are not looked for further. Tokens are sets; empty and null arrays match nothing.
    """
    keys = [*dict.fromkeys([*key, *by])]
    if not by and fits(anchors):
        size = F.size(F.array_distinct("tokens"))
        top = anchors.select(*keys, size.alias("_size")).join(most_common(anchors, sentences, keys), keys).select(*keys, F.col("s").cast(sentences.schema["s"].dataType).alias("s"), (F.col("common") / F.col("_size")).alias("score"))
        return _rated(anchors.select(*keys), top.filter(F.col("score") >= levels[-1]), keys)
    ordered = rare_first(anchors, sentences, keys)
    left, found = ordered, []
    for least in levels:
        pairs = candidates(left, sentences, keys, by, least)
        whole = pairs.join(sentences.select(*by, "s", F.col("tokens").alias("_s")), [*by, "s"]).join(left.select(*keys, F.col("tokens").alias("_a")), keys)
        scored = whole.select(*keys, "s", (F.size(F.array_intersect("_a", "_s")) / F.size("_a")).alias("score")).filter(F.col("score") >= least)
        top = scored.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("s")).alias("m"))).alias("b")).select(*keys, (-F.col("b.m")).alias("s"), F.col("b.score").alias("score"))
        found.append(top)
        if least != levels[-1]:
            left = left.join(top.select(*keys), keys, "left_anti")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return _rated(anchors.select(*keys), out, keys)


def _rated(anchors: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = anchors.join(found, keys, "left")
    return rows.select(*keys, "s", F.coalesce("score", F.lit(0.0)).alias("score")).withColumn("status", F.when(F.col("score") >= 0.5, "MATCHED").otherwise("UNGROUNDED"))


def idf_with_cut(sentences: DataFrame, drop: float = 0.40) -> tuple[DataFrame, float]:
    """(token, df, idf) with idf = ln((N + 1) / (df + 1)) over N sentences (tokens), and the idf below which the share `drop` of all tokens lies.

    The cut is an order statistic of the idfs; tokens of equal frequency are counted first, so only the
    different frequencies are ranked.
    """
    total = sentences.count()
    rows = sentences.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).select("token", "df", F.log(F.lit(total + 1) / (F.col("df") + 1)).alias("idf"))
    each = rows.groupBy("idf").agg(F.count(F.lit(1)).alias("n"))
    n = each.agg(F.sum("n")).first()[0] or 0
    w = Window.orderBy("idf").rowsBetween(Window.unboundedPreceding, 0)
    cut = each.withColumn("upto", F.sum("n").over(w)).filter(F.col("upto") > int(n * drop)).agg(F.min("idf")).first()[0]
    return rows, cut or 0.0
