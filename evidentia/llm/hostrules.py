"""Quality rules by document and by host, in DataFrame functions only.

Every document is tested by the base rules and by four shape rules. Failures are counted by host
(`source`); a host's failure rate is shrunk towards all hosts by a beta prior whose two parameters
come from the mean and the variance of the hosts' rates (method of moments). A host whose shrunk
rate reaches `host_limit` is closed: none of its documents is kept. Documents of open hosts are kept
unless they themselves fail a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, stored

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: A document fails the base rules below this many words, or above this share of words in repeated windows.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Shape rules: symbols per 100 words, percent of lines that repeat, characters per word times 100.
MOST_SYMBOLS, MOST_DUP_LINES_PERCENT, SHORTEST_WORD, LONGEST_WORD = 50, 50, 200, 1500
#: Shrunk failure rate from which a host is closed.
HOST_LIMIT = 0.8
#: Prior weight when the hosts' rates leave nothing to estimate it from (one host, or no variance).
FALLBACK_WEIGHT = 20.0
#: Closed hosts are broadcast up to this many bytes of their names; beyond it they are joined by a merge join.
BROADCAST_BYTES = 4_000_000


def features(rows: DataFrame) -> DataFrame:
    """Adds one struct column `_f`: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words.

    A null text has no words. Works on whole texts; nothing is shuffled. For n_repeat_words each
    three-word window becomes one long: hash bits above, its position below (as many bits as the text
    needs). Sorted, windows of equal hashes are neighbours, and neighbours are compared word by word. Should
    two different windows of a text share their hash bits, each window there is compared with all others of
    its hash. The sorted positions of repeated windows give the words that they cover.
    """
    rows = rows.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumn("_w", F.filter(F.split("_t", GAP), lambda x: x != ""))
    rows = rows.withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_b", F.length(F.bin(F.col("_n").cast("long"))))
    # one long per window: hash bits above, position below
    rows = rows.withColumn(
        "_k",
        F.expr("CASE WHEN _n < 4 THEN cast(array() as array<bigint>) ELSE sort_array(transform(sequence(0, _n - 3), i -> shiftleft(xxhash64(_w[i], _w[i + 1], _w[i + 2]), _b) | cast(i as bigint))) END"),
    )
    # neighbours with equal hash bits; a position can come twice
    rows = rows.withColumn(
        "_p",
        F.expr("""
        transform(
          filter(sequence(0, greatest(size(_k) - 2, 0)), j -> size(_k) > 1 AND shiftright(_k[j], _b) = shiftright(_k[j + 1], _b)),
          j -> named_struct('a', cast(_k[j] & (shiftleft(1L, _b) - 1) as int), 'b', cast(_k[j + 1] & (shiftleft(1L, _b) - 1) as int)))
        """),
    )
    rows = rows.withColumn("_s", F.expr("filter(_p, p -> _w[p.a] = _w[p.b] AND _w[p.a + 1] = _w[p.b + 1] AND _w[p.a + 2] = _w[p.b + 2])"))
    every = "array_distinct(concat(transform({0}, p -> p.a), transform({0}, p -> p.b)))"
    other = "exists({0}, y -> y != x AND _w[x] = _w[y] AND _w[x + 1] = _w[y + 1] AND _w[x + 2] = _w[y + 2])".format(every.format("_p"))
    rows = rows.withColumn("_q", F.expr(f"sort_array(CASE WHEN size(_s) = size(_p) THEN {every.format('_s')} ELSE filter({every.format('_p')}, x -> {other}) END)"))
    rows = rows.withColumn("_l", F.expr(r"filter(split(_t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    fields = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.expr("CASE WHEN size(_q) = 0 THEN 0L ELSE 3L + aggregate(sequence(1, greatest(size(_q) - 1, 1)), 0L, (s, i) -> s + if(i < size(_q), least(3, _q[i] - _q[i - 1]), 0)) END").alias("n_repeat_words"),
    )
    return rows.withColumn("_f", fields).drop("_t", "_w", "_n", "_b", "_k", "_p", "_s", "_q", "_l")


def rules(f: str = "_f") -> tuple[Column, Column]:
    """Whether the base rules fail, and whether any rule fails."""
    c = lambda x: F.col(f"{f}.{x}")
    base = (c("n_words") < LEAST_WORDS) | (100 * c("n_repeat_words") > MOST_REPEATED_PERCENT * c("n_words"))
    shape = (100 * c("n_symbols") > MOST_SYMBOLS * c("n_words")) | (100 * c("n_dup_lines") > MOST_DUP_LINES_PERCENT * c("n_lines")) | (100 * c("word_chars") < SHORTEST_WORD * c("n_words")) | (100 * c("word_chars") > LONGEST_WORD * c("n_words"))
    return base, base | shape


def host_verdicts(flags: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Per host (null counts as one): n_docs, n_failed, shrunk_rate, closed. flags: source, failed."""
    hosts = flags.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("failed").alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.sum("n_failed").alias("f"), F.sum("n_docs").alias("n"), F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    weight = F.when((F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("v")), F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(FALLBACK_WEIGHT))
    prior = prior.select(F.coalesce(F.col("f") / F.col("n"), F.lit(0.0)).alias("mean"), weight.alias("weight"))
    # the prior is one row
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    return hosts.crossJoin(F.broadcast(prior)).select("source", "n_docs", "n_failed", shrunk.alias("shrunk_rate")).withColumn("closed", F.col("shrunk_rate") >= host_limit)


def closed_hosts(flags: DataFrame, host_limit: float, name: str) -> DataFrame:
    """The closed hosts as column `name`, stored; to be broadcast if their counted size allows, else merge joined."""
    closed = stored(host_verdicts(flags, host_limit).filter("closed").select(F.col("source").alias(name)), "closed")
    size = closed.agg(F.sum(16 + F.coalesce(F.octet_length(name), F.lit(0)))).first()[0] or 0
    return F.broadcast(closed) if size <= BROADCAST_BYTES else closed.hint("merge")


def judge(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed, host_closed, kept.

    The narrow features are stored once and read for both the hosts' counts and the verdicts. A null text
    has no words and fails, a null source counts as one host, repeated rows are judged alike and each
    counts, texts of any length are judged whole, other columns are not read; an empty table gives an
    empty one.
    """
    base, failed = rules()
    rows = features(docs.select("doc_id", "text", "source")).select("doc_id", "source", "_f.*", base.alias("base_failed"), failed.alias("failed"))
    rows = stored(rows, "rules")
    closed = closed_hosts(rows, host_limit, "_host").withColumn("_closed", F.lit(True))
    out = rows.join(closed, F.col("source").eqNullSafe(F.col("_host")), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", F.coalesce("_closed", F.lit(False)).alias("host_closed"), (~F.col("failed") & F.col("_closed").isNull()).alias("kept"))


def keep_good(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that judge() keeps, with all their columns, whatever these are called.

    Documents and their verdicts by the rules are stored once; then the documents of closed hosts are left out. Documents are not shuffled unless the closed
    hosts' names exceed BROADCAST_BYTES. Nulls, ties and repeated rows are as in judge(); an empty table
    gives an empty one.
    """
    _, failed = rules()
    bad, host = fresh(docs.columns, "bad", "host")
    rows = features(docs.select(F.struct("*").alias("_row")).select("_row", F.col("_row.text").alias("text")))
    # stored, since a filter on the flags would be pushed below the features and repeat them many times over
    flagged = stored(rows.select("_row.*", failed.alias(bad)), "flagged")
    closed = closed_hosts(flagged.select("source", F.col(bad).alias("failed")), host_limit, host)
    return flagged.filter(~F.col(bad)).drop(bad).join(closed, F.col("source").eqNullSafe(F.col(host)), "left_anti")
