"""Joins and aggregations of paired, complete and conjunctive evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import overlap

#: Quotes that are broadcast at most.
QUOTE_ROWS = 20_000


def contingency(df: DataFrame, a: Column, b: Column, by: list[str] | None = None) -> DataFrame:
    """Counts of the four cells; rows where either side is missing are in none."""
    both = df.withColumn("_a", a).withColumn("_b", b)
    cell = lambda x, y: F.count_if((F.col("_a") == x) & (F.col("_b") == y))
    return both.groupBy(*(by or [])).agg(cell(True, True).alias("both"), cell(True, False).alias("a_only"), cell(False, True).alias("b_only"), cell(False, False).alias("neither"))


def discordance(df: DataFrame, unit: str, arm: str, value: str, left: str, right: str) -> DataFrame:
    """b (left only) and c (right only) over units with both arms; one shuffle on the unit, no self-join."""
    side = lambda name: F.max(F.when(F.col(arm) == name, F.col(value)))
    wide = df.groupBy(unit).agg(side(left).alias("l"), side(right).alias("r")).filter("l IS NOT NULL AND r IS NOT NULL")
    return wide.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("l") & ~F.col("r")).alias("b"), F.count_if(~F.col("l") & F.col("r")).alias("c"))


def divide(df: DataFrame, unit: str, attribute: str, needed: int) -> DataFrame:
    """Units that have `needed` different attributes (relational division)."""
    return df.groupBy(unit).agg(F.count_distinct(attribute).alias("n")).filter(F.col("n") == needed).select(unit)


def for_all(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """Per key: rows, rows that meet the condition (missing: not met), and whether all do."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(condition, F.lit(False))).alias("met")).withColumn("all_met", F.col("n") == F.col("met"))


def repeats(df: DataFrame, item: str, outcome: Column) -> DataFrame:
    """Repeated outcomes per item: n, successes, proportion, tie, and the majority (a tie is false), all and any rules."""
    g = df.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.count_if(outcome).alias("success"))
    return g.select(item, "n", "success", (F.col("success") / F.col("n")).alias("proportion"), (2 * F.col("success") == F.col("n")).alias("tie"), (2 * F.col("success") > F.col("n")).alias("majority"), (F.col("success") == F.col("n")).alias("all_"), (F.col("success") > 0).alias("any_"))


def full_cover(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with that side."""
    a, b = left.select(key).distinct().withColumn("in_left", F.lit(True)), right.select(key).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, key, "full_outer").filter("in_left IS NULL OR in_right IS NULL").select(key, F.when(F.col("in_left").isNull(), "right").otherwise("left").alias("only_in"))


def best_overlap(anchors: DataFrame, sentences: DataFrame) -> DataFrame:
    """For each anchor (item, a, tokens) the sentence (s, tokens) with most of its tokens; the smallest s of equals; null without any.

    Anchors that are few go to all tasks, so neither sentences nor pairs are shuffled; more are joined on tokens.
    Rows of one s count together, so a table with repeated (or null) s is joined, too.
    """
    n = anchors.select("item", "a", F.size(F.array_distinct("tokens")).alias("size"))
    apart = not sentences.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR s IS NULL").head(1)
    if apart and overlap.fits(anchors):
        best = overlap.most_common(anchors, sentences, ["item", "a"]).withColumn("s", F.col("s").cast(sentences.schema["s"].dataType))
    else:
        x = anchors.select("item", "a", F.explode(F.array_distinct("tokens")).alias("t"))
        y = sentences.select("s", F.explode(F.array_distinct("tokens")).alias("t"))
        hits = y.join(x, "t").groupBy("item", "a", "s").agg(F.count(F.lit(1)).alias("common"))
        best = hits.groupBy("item", "a").agg(F.max(F.struct("common", (-F.col("s")).alias("m"))).alias("b")).select("item", "a", (-F.col("b.m")).alias("s"), F.col("b.common").alias("common"))
    out = n.join(best, ["item", "a"], "left")
    score = F.when(F.col("size") > 0, F.coalesce("common", F.lit(0)) / F.col("size"))
    return out.select("item", "a", "s", score.alias("score")).withColumn("status", F.when(F.col("score") >= 0.5, "MATCHED").otherwise("UNGROUNDED"))


def idf(df: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """Document frequency and ln((N + 1) / (df + 1)) of each token. A row is a document of its own: counts shrink before they are shuffled."""
    total = df.agg(F.count(doc).alias("total"))
    each = df.filter(F.col(doc).isNotNull()).select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # total is one row
    return each.crossJoin(F.broadcast(total)).select("token", "df", F.log((F.col("total") + 1) / (F.col("df") + 1)).alias("idf"))


def islands(df: DataFrame, key: str, at: Column, gap: float, tie: str) -> DataFrame:
    """Gaps and islands: a row more than `gap` after its predecessor begins a new island."""
    w = Window.partitionBy(key).orderBy("_at", tie)
    rows = df.withColumn("_at", at).withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(w) > gap).cast("int"), F.lit(0)))
    return rows.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def top_by_hash(df: DataFrame, group: str, item: str, salt: str, k: int) -> DataFrame:
    """The k items of each group with the least SHA-256 of salt:group:item, ranked from 1."""
    key = F.sha2(F.concat_ws(":", F.lit(salt), F.col(group), F.col(item).cast("string")), 256)
    w = Window.partitionBy(group).orderBy(key, item)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key, the smallest of equals, with its count."""
    each = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(key).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value))).alias("value"), F.max("n").alias("n"))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that holds, in order; null if none does."""
    out = F.when(checks[0][0], checks[0][1])
    for failed, reason in checks[1:]:
        out = out.when(failed, reason)
    return out


def fail_closed(df: DataFrame, reason: str = "reason", key: str | None = None) -> DataFrame:
    """df if no row has a reason; else the job stops with the reason of the smallest key. An action of its own: a filter put on the result cannot move below it."""
    bad = df.filter(F.col(reason).isNotNull())
    first = bad.orderBy(key or reason).select(reason).limit(1).collect()
    if first:
        raise ValueError(f"BLOCKED:{first[0][0]}")
    return df


def quote_matches(quotes: DataFrame, docs: DataFrame, most: int = 8) -> DataFrame:
    """item_id, doc_id, quote_class of the pairs where quote (item_id, text) stands in document (doc_id, text): exact, normalised or elided.

    Words between the first and the last one of a quote's longest fragment are whole words of each such
    document, and so is a run of them, `most` at most. The longest word of the run is the equi-join key, and the
    document, which is at hand, must contain the run. Quotes that are too many to broadcast are joined on hashes
    of their runs; a fragment without such words is looked for in all documents.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    inner = lambda p: F.transform(F.array(words(p)), lambda w: F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))))[0]
    fragments = F.transform(F.split(text.collapsed(F.col("text")), r"\.\.\.|…"), inner)
    run = F.array_max(F.transform(fragments, lambda w: F.struct(F.size(w).alias("n"), F.slice(w, 1, most).alias("w"))))["w"]
    b = quotes.filter(F.col("text").isNotNull()).select("item_id", F.col("text").alias("quote"), run.alias("run")).withColumn("n", F.size("run"))
    sizes = sorted(r.n for r in b.select("n").distinct().collect() if r.n)
    docs = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    if b.limit(QUOTE_ROWS + 1).count() <= QUOTE_ROWS:
        longest = F.array_max(F.transform("run", lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
        x = b.filter("n > 0").select("item_id", "quote", longest.alias("word"), F.array_join("run", " ").alias("run"))
        y = docs.withColumn("c", text.collapsed(F.col("text"))).withColumn("word", F.explode(F.array_distinct(F.split("c", " "))))
        rows = y.join(F.broadcast(x), "word").filter(F.contains("c", "run")).select("item_id", "doc_id", "quote", "text")
    else:
        w = docs.select("doc_id", words(text.collapsed(F.col("text"))).alias("w"))
        grams = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " ")))).otherwise(F.array().cast("array<bigint>"))
        keys = w.select("doc_id", F.explode(F.array_distinct(F.concat(F.array().cast("array<bigint>"), *map(grams, sizes)))).alias("g"))
        pairs = keys.join(b.filter("n > 0").select(F.xxhash64(F.array_join("run", " ")).alias("g"), "item_id"), "g").select("doc_id", "item_id").distinct()
        rows = pairs.join(docs, "doc_id").join(b.filter("n > 0").select("item_id", "quote"), "item_id").select("item_id", "doc_id", "quote", "text")
    short = docs.crossJoin(F.broadcast(b.filter("n = 0").select("item_id", "quote"))).select("item_id", "doc_id", "quote", "text")
    # a generator's column is worked out once, for pairs that meet; a filter on a plain column would work it out again below the join
    found = rows.union(short).select("item_id", "doc_id", F.explode(F.array(text.quote_class(F.col("quote"), F.col("text")))).alias("quote_class"))
    return found.filter("quote_class IN ('exact', 'normalised', 'elided')")


def first_rows(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The first k rows of each group, ranked from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("rank") <= k)


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each pair of values with both margins; the margins are sums over the counted cells, not over rows."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    margin = lambda c: F.sum("n").over(Window.partitionBy(c))
    return cells.withColumn("of_a", margin(a)).withColumn("of_b", margin(b))


def excluded(df: DataFrame, key: str, out: DataFrame) -> DataFrame:
    """df without the keys that were declared out beforehand."""
    return df.join(out.select(key).distinct(), key, "left_anti")
