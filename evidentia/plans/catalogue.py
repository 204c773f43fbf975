"""The reference's operators as named queries over the tables at hand, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry, integrity, stats, text
from ..operators import ledger, relational
from ._registry import QUERIES, SQL, clopper_sql, good, query, t, toxic

_CELLS = "count(*) FILTER (quality = 1 AND toxic = 1) AS \"both\", count(*) FILTER (quality = 1 AND toxic <> 1) AS a_only, count(*) FILTER (quality <> 1 AND toxic = 1) AS b_only, count(*) FILTER (quality <> 1 AND toxic <> 1) AS neither"
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


@query(f"SELECT {_CELLS} FROM labels")
def q_contingency_quality_toxic(spark, d):
    return relational.contingency(t(spark, d, "labels"), good(), toxic())


@query("""
WITH c AS (SELECT count(*) AS pairs, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels)
SELECT pairs, b, c, round(least(1.0, 2 * list_sum(list_transform(range(greatest(b, c), b + c + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0))))), 6) AS p_value FROM c
""")
def q_mcnemar_quality_vs_toxic(spark, d):
    long_ = t(spark, d, "labels").select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("arm"), good().alias("v")), F.struct(F.lit("toxic").alias("arm"), toxic().alias("v")))).alias("r")).select("doc_id", "r.*")
    counts = relational.discordance(long_, "doc_id", "arm", "v", "quality", "toxic")
    return counts.select("pairs", "b", "c", F.round(stats.binomial_two_sided("b", "c"), 6).alias("p_value"))


_FISHER = f"""
WITH c AS (SELECT lang, {_CELLS} FROM labels JOIN documents USING (doc_id) GROUP BY lang),
m AS (SELECT *, "both" + a_only AS r1, b_only + neither AS r2, "both" + b_only AS c1, "both" + a_only + b_only + neither AS n FROM c),
x AS (SELECT *, unnest(range(greatest(0, c1 - r2), least(r1, c1) + 1)) AS k FROM m),
p AS (SELECT *, exp(lgamma(r1 + 1) + lgamma(r2 + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(r1 - k + 1) - lgamma(c1 - k + 1) - lgamma(r2 - c1 + k + 1)) AS q FROM x),
o AS (SELECT lang, q AS obs FROM p WHERE k = "both"),
f AS (SELECT p.lang, round(least(1.0, sum(q) FILTER (q <= obs * (1 + 1e-9))), 6) AS p_value FROM p JOIN o USING (lang) GROUP BY p.lang)
"""


def _fisher(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang")
    cells = relational.contingency(t(spark, d, "labels").join(docs, "doc_id"), good(), toxic(), ["lang"])
    return cells.withColumn("p_value", F.round(stats.fisher_two_sided("both", "a_only", "b_only", "neither"), 6))


@query(_FISHER + 'SELECT c.lang, "both", a_only, b_only, neither, p_value FROM c JOIN f USING (lang)')
def q_fisher_quality_toxic_by_lang(spark, d):
    return _fisher(spark, d)


_RANKS = _FISHER + ", k AS (SELECT lang, p_value, row_number() OVER (ORDER BY p_value, lang) AS rank, 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY p_value, lang) + 1) AS threshold FROM f)"


@query(_RANKS + "SELECT lang, p_value, rank::INTEGER AS rank, threshold, bool_and(p_value <= threshold) OVER (ORDER BY rank) AS reject FROM k")
def q_holm(spark, d):
    return stats.holm(_fisher(spark, d).select("lang", "p_value"), "p_value")


@query(_RANKS + "SELECT lang, p_value, rank::INTEGER AS rank, threshold, p_value <= threshold AS reject FROM k")
def q_holm_nostop(spark, d):
    return stats.holm(_fisher(spark, d).select("lang", "p_value"), "p_value", stop=False)


@query("""
SELECT source, count(*) AS n, count(*) FILTER (coalesce(quality = 1, false)) AS admitted, count(*) FILTER (coalesce(quality = 1, false)) / count(*) AS rate
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
""")
def q_admission_rate_by_source(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    admitted = F.count_if(F.coalesce(good(), F.lit(False)))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), admitted.alias("admitted"), F.try_divide(admitted, F.count(F.lit(1))).alias("rate"))


@query("""
SELECT lang, source, count(*) AS n, count(*) FILTER (coalesce(quality = 1, false)) AS admitted
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())
""")
def q_strata_counts(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source", "lang").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(good(), F.lit(False))).alias("admitted"))


@query("SELECT lang, min(n_chars) AS least, max(n_chars) AS most, median(n_chars)::DOUBLE AS middle FROM documents GROUP BY lang")
def q_chars_min_max_median(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.median("n_chars").alias("middle"))


@query("""
WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS success FROM events GROUP BY user_id)
SELECT user_id, n, success, success / n AS proportion, 2 * success = n AS tie, 2 * success > n AS majority, success = n AS all_, success > 0 AS any_ FROM g
""")
def q_repeat_aggregation(spark, d):
    return relational.repeats(t(spark, d, "events"), "user_id", F.col("event_type") == "purchase")


@query("""
WITH l AS (SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 0 AND event_type = 'error'), r AS (SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 1 AND event_type = 'error')
SELECT user_id, 'left' AS only_in FROM l WHERE user_id NOT IN (FROM r) UNION ALL SELECT user_id, 'right' FROM r WHERE user_id NOT IN (FROM l)
""")
def q_paired_aggregate_cover(spark, d):
    e = t(spark, d, "events").filter("event_type = 'error'")
    return relational.full_cover(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id")


@query("SELECT user_id, ts::DATE AS day FROM events GROUP BY ALL HAVING count(DISTINCT event_type) = 5")
def q_listwise_common_units(spark, d):
    e = t(spark, d, "events").select(F.struct("user_id", F.to_date("ts").alias("day")).alias("unit"), "event_type")
    return relational.divide(e, "unit", "event_type", 5).select("unit.*")


@query("""
SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity >= 5 AND l_discount <= 0.08 AND l_tax <= 0.07) AS met,
  count(*) = count(*) FILTER (l_quantity >= 5 AND l_discount <= 0.08 AND l_tax <= 0.07) AS all_met FROM lineitem GROUP BY l_orderkey
""")
def q_for_all_judges(spark, d):
    return relational.for_all(t(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax"), "l_orderkey", (F.col("l_quantity") >= 5) & (F.col("l_discount") <= 0.08) & (F.col("l_tax") <= 0.07))


@query("""
WITH f AS (SELECT lang, unnest(list_filter([CASE WHEN n_chars > 10000 THEN 'too_long' END, CASE WHEN n_chars < 300 THEN 'too_short' END, CASE WHEN contains(lower(text), 'http') THEN 'link' END], lambda x: x IS NOT NULL)) AS reason FROM documents)
SELECT lang, reason, count(*) AS n FROM f GROUP BY ALL
""")
def q_reject_reason_explode(spark, d):
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") > 10000, "too_long"), F.when(F.col("n_chars") < 300, "too_short"), F.when(F.contains(F.lower("text"), F.lit("http")), "link")))
    return t(spark, d, "documents").select("lang", F.explode(reasons).alias("reason")).groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'blank' WHEN length(text) > 10000 THEN 'too_long' WHEN NOT regexp_full_match(source, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') THEN 'source_id' WHEN lang NOT IN ('en', 'fr', 'de') THEN 'lang' END AS reason FROM documents
""")
def q_validator_first_reason(spark, d):
    reason = relational.first_reason(
        (F.col("text").isNull() | (F.trim("text") == ""), "blank"),
        (F.char_length("text") > 10000, "too_long"),
        (~F.col("source").rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"), "source_id"),
        (~F.col("lang").isin("en", "fr", "de"), "lang"),
    )
    return t(spark, d, "documents").select("doc_id", reason.alias("reason"))


_UNSAFE = "contains(lower({0}), '/home/') OR contains(lower({0}), '/users/') OR contains(lower({0}), 'file://') OR contains(lower({0}), 'bearer ') OR contains(lower({0}), 'api_key') OR contains(lower({0}), 'api-key') OR contains(lower({0}), 'sk-') OR regexp_matches(lower({0}), '[a-z]:\\\\')"


@query(f"SELECT 'document' AS kind, doc_id AS id, {_UNSAFE.format('text')} AS unsafe FROM documents UNION ALL SELECT 'page', page_id, {_UNSAFE.format('html')} FROM pages")
def q_unsafe_markers(spark, d):
    a = t(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), text.unsafe(F.col("text")).alias("unsafe"))
    return a.union(t(spark, d, "pages").select(F.lit("page"), "page_id", text.unsafe(F.col("html"))))


@query("SELECT event_id, len(list_filter(json_keys(props), lambda k: k NOT IN ('k'))) = 0 AND list_contains(json_keys(props), 'k') AS closed FROM events")
def q_closed_keys_props(spark, d):
    keys, need = F.json_object_keys("props"), F.array(F.lit("k"))
    return t(spark, d, "events").select("event_id", ((F.size(F.array_except(keys, need)) == 0) & (F.size(F.array_except(need, keys)) == 0)).alias("closed"))


@query("SELECT sha256(text) AS identity, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def q_duplicate_identity(spark, d):
    return t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("identity")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("SELECT o_custkey AS custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY 1")
def q_referential_anti_join(spark, d):
    good = t(spark, d, "customer").filter("c_acctbal >= 0").select("c_custkey")
    o = t(spark, d, "orders").select("o_custkey")
    return o.join(good, o.o_custkey == good.c_custkey, "left_anti").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def q_edge_lookup(spark, d):
    s, n, r = t(spark, d, "supplier"), t(spark, d, "nation"), t(spark, d, "region").filter("r_name = 'ASIA'")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("""
WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM documents WHERE n_chars >= 500)
SELECT (SELECT count(*) FROM a) AS expected, (SELECT count(*) FROM b) AS actual, (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS missing, (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS extra
""")
def q_expected_vs_actual(spark, d):
    a, b = t(spark, d, "labels").filter("quality = 1").select("doc_id", F.lit(1).alias("side")), t(spark, d, "documents").filter("n_chars >= 500").select("doc_id", F.lit(2).alias("side"))
    n = a.union(b).groupBy("doc_id").agg(F.count_if(F.col("side") == 1).alias("a"), F.count_if(F.col("side") == 2).alias("b"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return n.agg(total("a").alias("expected"), total("b").alias("actual"), total(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"), total(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("extra"))


_IDF = f"w AS (SELECT DISTINCT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents), i AS (SELECT token, count(*) AS df, ln(((SELECT count(DISTINCT doc_id) FROM documents) + 1) / (count(*) + 1)) AS idf FROM w GROUP BY token)"


def _idf(spark, d):
    return relational.idf(t(spark, d, "documents").select("doc_id", "text"), "doc_id", text.tokens(F.col("text")))


@query(f"WITH {_IDF} SELECT token, df, round(idf, 9) AS idf FROM i")
def q_idf_tokens(spark, d):
    return _idf(spark, d).select("token", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {_IDF} SELECT count(*) AS n, round(list_sort(list(idf))[floor(count(*) * 0.40)::BIGINT + 1], 9) AS cut FROM i")
def q_idf_cut(spark, d):
    # values that are equal are counted first, so that the ranked table is as small as the number of different frequencies
    each = _idf(spark, d).groupBy("df", "idf").agg(F.count(F.lit(1)).alias("n"))
    total = each.agg(F.sum("n").alias("total"))
    w = Window.orderBy("idf").rowsBetween(Window.unboundedPreceding, 0)
    upto = each.withColumn("upto", F.sum("n").over(w)).crossJoin(F.broadcast(total)).filter(F.col("upto") > F.floor(F.col("total") * 0.40))
    return upto.agg(F.min("total").alias("n"), F.round(F.min("idf"), 9).alias("cut"))


@query(f"""
WITH {_IDF}, b AS (SELECT item_id, unnest(list_distinct({_TOKENS.format('text')})) AS token FROM benchmark),
v AS (SELECT b.item_id, b.token, coalesce(i.idf, ln((SELECT count(DISTINCT doc_id) FROM documents) + 1.0)) AS idf, coalesce(i.df, 0) AS df FROM b LEFT JOIN i USING (token))
SELECT item_id, round(coalesce(sum(idf) FILTER (df >= 5) / sum(idf), 1.0), 9) AS coverage, coalesce(sum(idf) FILTER (df >= 5) / sum(idf), 1.0) >= 0.95 AS rejected FROM v GROUP BY item_id
""")
def q_novelty_coverage(spark, d):
    docs = t(spark, d, "documents").agg(F.count_distinct("doc_id").alias("total"))
    b = t(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token"))
    v = b.join(_idf(spark, d), "token", "left").crossJoin(F.broadcast(docs)).select("item_id", F.coalesce("idf", F.log(F.col("total") + 1.0)).alias("idf"), F.coalesce("df", F.lit(0)).alias("df"))
    c = v.groupBy("item_id").agg(F.coalesce(F.sum(F.when(F.col("df") >= 5, F.col("idf"))) / F.sum("idf"), F.lit(1.0)).alias("c"))
    return c.select("item_id", F.round("c", 9).alias("coverage"), (F.col("c") >= 0.95).alias("rejected"))


_QUOTES = "SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 100000, replace(text, ' ', '  ') FROM benchmark UNION ALL SELECT item_id + 200000, concat(substr(text, 1, 40), ' ... ', substr(text, 80, 30)) FROM benchmark"
_COLLAPSED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(rf"""
WITH b AS ({_QUOTES}), q AS (SELECT item_id, text AS quote, {_COLLAPSED.format("text")} AS c FROM b), p AS (SELECT *, list_filter(list_transform(string_split(c, '...'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM q),
d AS (SELECT doc_id, text, {_COLLAPSED.format("text")} AS s FROM documents)
SELECT item_id, doc_id, CASE WHEN contains(text, quote) THEN 'exact' WHEN contains(s, c) THEN 'normalised' ELSE 'elided' END AS quote_class FROM p JOIN d
ON contains(text, quote) OR contains(s, c) OR (len(parts) = 2 AND len(parts[1]) >= 8 AND len(parts[2]) >= 8 AND contains(s, parts[1]) AND contains(substr(s, strpos(s, parts[1]) + length(parts[1])), parts[2]))
""")
def q_quote_class(spark, d):
    quotes = spark.sql(_QUOTES.replace("FROM benchmark", "FROM {b}"), b=t(spark, d, "benchmark"))
    return relational.quote_matches(quotes, t(spark, d, "documents"))


@query(f"""
WITH a AS (SELECT item_id, list_distinct({_TOKENS.format('text')}) AS w FROM benchmark), x AS (SELECT item_id, len(w) AS size, unnest(w) AS token FROM a),
s AS (SELECT doc_id, unnest(list_distinct({_TOKENS.format('text')})) AS token FROM documents),
h AS (SELECT item_id, size, doc_id, count(*) AS common FROM x JOIN s USING (token) GROUP BY ALL)
SELECT item_id AS item, arg_max(doc_id, (common, -doc_id)) AS s, round(max(common / size), 9) AS score, CASE WHEN max(common / size) >= 0.5 THEN 'MATCHED' ELSE 'UNGROUNDED' END AS status FROM h GROUP BY item_id
""")
def q_best_overlap(spark, d):
    a = t(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.lit(0).alias("a"), text.tokens(F.col("text")).alias("tokens"))
    s = t(spark, d, "documents").select(F.col("doc_id").alias("s"), text.tokens(F.col("text")).alias("tokens"))
    return relational.best_overlap(a, s).select("item", "s", F.round("score", 9).alias("score"), "status")


_LEGAL = "regexp_extract_all(lower({}), '[a-zA-ZÀ-ỹ0-9]+')"


@query(f"""
WITH p AS (SELECT item_id, doc_id, {_LEGAL.format("b.text")} AS a, ' ' || array_to_string({_LEGAL.format("d.text")}, ' ') || ' ' AS s FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))))
SELECT item_id, doc_id, coalesce(list_max(list_filter(range(1, 31), lambda n: len(list_filter(range(1, len(a) - n + 2), lambda i: contains(s, ' ' || array_to_string(a[i:i + n - 1], ' ') || ' '))) > 0)), 0)::INTEGER AS run FROM p
""")
def q_longest_common_run(spark, d):
    pairs = relational.quote_matches(t(spark, d, "benchmark"), t(spark, d, "documents")).select("item_id", "doc_id")
    rows = pairs.join(t(spark, d, "benchmark").withColumnRenamed("text", "quote"), "item_id").join(t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("item_id", "doc_id", text.longest_common_run(text.legal_words(F.col("quote")), text.legal_words(F.col("text"))).alias("run"))


_CUT = r"string_split(regexp_replace(text, '([{}])[ \t\n\v\f\r]+|\n+', '\1' || chr(1), 'g'), chr(1))"


@query(rf"""
SELECT doc_id, len(list_filter({_CUT.format(".;:!?")}, lambda x: length(trim(x, E' \t\n\v\f\r\u00a0')) >= 25))::INTEGER AS long_sentences, len(list_filter({_CUT.format(".!?;:")}, lambda x: trim(x, E' \t\n\v\f\r\u00a0') <> ''))::INTEGER AS sentences FROM documents
""")
def q_sentence_counts(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("long_sentences"), F.size(text.split_sentences(F.col("text"))).alias("sentences"))


@query(r"""
WITH j AS (SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') AS s FROM conversations)
SELECT conv_id, turn, contains(s, 'the') OR contains(s, 'please') OR contains(s, 'la de') AS cued FROM j
""")
def q_cue_phrases(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", (F.size(text.cues(F.col("text"), ["the", "please", "la de"])) > 0).alias("cued"))


@query(f"""
WITH w AS (SELECT conv_id, turn, list_distinct({_TOKENS.format('text')}) AS k, lag(list_distinct({_TOKENS.format('text')})) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, turn, len(k) AS tokens, len(list_filter(k, lambda x: NOT list_contains(coalesce(p, []), x))) AS unsupported FROM w
""")
def q_support_gate(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(text.tokens(F.col("text"))).alias("k"))
    rows = rows.withColumn("p", F.coalesce(F.lag("k").over(w), F.array().cast("array<string>")))
    return rows.select("conv_id", "turn", F.size("k").cast("long").alias("tokens"), F.size(F.array_except("k", "p")).cast("long").alias("unsupported"))


@query("SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id")
def q_contiguous_turns(spark, d):
    n = F.count(F.lit(1))
    return t(spark, d, "conversations").groupBy("conv_id").agg(n.alias("n"), ((F.min("turn") == 0) & (F.max("turn") == n - 1) & (F.count_distinct("turn") == n)).alias("contiguous"))


@query("SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role AS same_role FROM conversations")
def q_replicate_agreement(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).eqNullSafe(F.col("role")).alias("same_role"))


@query("""
SELECT source, doc_id, rank::INTEGER AS rank, left(sha256('judge-order:freeze:' || doc_id), 20) AS blind_id FROM
(SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('freeze:' || source || ':' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 8
""")
def q_topk_hash_rank(spark, d):
    top = relational.top_by_hash(t(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", "freeze", 8)
    return top.select("source", "doc_id", "rank", F.left(F.sha2(F.concat(F.lit("judge-order:freeze:"), F.col("doc_id").cast("string")), 256), F.lit(20)).alias("blind_id"))


@query("""
WITH r AS (SELECT 1 + quality * 2 AS a, 5 - toxic * 3 AS b FROM labels), s AS (SELECT count(*) AS n, avg((a - b) * (a - b)) / 16 AS o, (sum(a * a) * count(*) + sum(b * b) * count(*) - 2 * sum(a) * sum(b)) / (count(*) * count(*)) / 16 AS e FROM r)
SELECT n, round(o, 9) AS observed, round(e, 9) AS expected, round(CASE WHEN abs(e) > 1e-12 THEN 1 - o / e END, 9) AS kappa FROM s
""")
def q_qwk(spark, d):
    r = t(spark, d, "labels").select((1 + F.col("quality") * 2).cast("long").alias("a"), (5 - F.col("toxic") * 3).cast("long").alias("b"))
    return stats.weighted_kappa(r, "a", "b", 1, 5).select("n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


@query(f"""
WITH c AS (SELECT {_CELLS} FROM labels), p AS (SELECT ("both" + neither) / ("both" + a_only + b_only + neither) AS po, "both" + a_only + b_only + neither AS n, * FROM c),
e AS (SELECT po, (("both" + a_only) / n) * (("both" + b_only) / n) + ((neither + b_only) / n) * ((neither + a_only) / n) AS pe FROM p)
SELECT round(po, 9) AS raw, round((po - pe) / (1 - pe), 4) AS kappa FROM e
""")
def q_kappa(spark, d):
    c = relational.contingency(t(spark, d, "labels"), good(), toxic())
    both, neither, a, b = (F.col(x) for x in ("both", "neither", "a_only", "b_only"))
    return c.select(F.round((both + neither) / (both + neither + a + b), 9).alias("raw"), F.round(stats.cohen_kappa(both, neither, a, b), 4).alias("kappa"))


@query("""
WITH r AS (SELECT p_size % 5 AS a, floor(p_retailprice)::BIGINT % 5 AS b, p_brand FROM part)
SELECT p_brand, count(*) AS n, count(*) FILTER (a = b) AS exact, count(*) FILTER (abs(a - b) <= 1) AS within_one, round(count(*) FILTER (a = b) / count(*), 4) AS rate FROM r GROUP BY p_brand
""")
def q_within_one_agreement(spark, d):
    r = t(spark, d, "part").select("p_brand", (F.col("p_size") % 5).alias("a"), (F.floor("p_retailprice") % 5).alias("b"))
    exact = F.count_if(F.col("a") == F.col("b"))
    return r.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), exact.alias("exact"), F.count_if(F.abs(F.col("a") - F.col("b")) <= 1).alias("within_one"), F.round(exact / F.count(F.lit(1)), 4).alias("rate"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, arg_min(event_type, (-n, event_type)) AS value, max(n) AS n FROM c GROUP BY user_id")
def q_mode_tiebreak(spark, d):
    return relational.mode(t(spark, d, "events"), "user_id", "event_type")


@query(SQL["q_novelty_coverage"].replace("SELECT item_id, round", ", n AS (SELECT item_id, round", 1) + ") SELECT tau::DOUBLE AS tau, count(*) AS n, count(*) FILTER (coverage >= tau) AS rejected FROM n, (VALUES (0.5), (0.6), (0.7), (0.8), (0.9), (0.95), (1.0)) AS g(tau) GROUP BY tau")
def q_tau_scan(spark, d):
    taus = F.array(*[F.lit(x) for x in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0)])
    rows = q_novelty_coverage(spark, d).select("coverage", F.explode(taus).alias("tau"))
    return rows.groupBy("tau").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("coverage") >= F.col("tau")).alias("rejected"))


@query(f"SELECT threshold, {_CELLS.replace('toxic = 1', 'n_chars >= threshold').replace('toxic <> 1', 'n_chars < threshold')} FROM labels JOIN documents USING (doc_id), (VALUES (500), (1000), (2000), (4000)) AS g(threshold) GROUP BY threshold")
def q_threshold_curve(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (500, 1000, 2000, 4000)])))
    return relational.contingency(rows, good(), F.col("n_chars") >= F.col("threshold"), ["threshold"])


@query("SELECT event_id, user_id, sum((event_type = 'click')::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS spent, sum((event_type = 'click')::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) <= CASE WHEN event_type = 'error' THEN 12 ELSE 10 END AS allowed FROM events")
def q_running_cap(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", (F.col("event_type") == "click").alias("started"), (F.col("event_type") == "error").alias("retry"))
    return ledger.running_cap(e, "user_id", "event_id", "started", 12, 2, "retry").select("event_id", "user_id", "spent", "allowed")


@query("SELECT c.event_id, c.user_id FROM events c WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = c.user_id AND p.event_type = 'purchase' AND p.event_id > c.event_id)")
def q_orphan_starts(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type")
    last = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("last"))
    return e.filter("event_type = 'click'").join(last, "user_id", "left").filter("last IS NULL OR event_id > last").select("event_id", "user_id")


@query("""
WITH e AS (SELECT *, event_type = 'purchase' AND value < 40 AS ok FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ok DESC, CASE WHEN ok THEN event_id ELSE -event_id END) AS k FROM e)
SELECT user_id, event_type AS last_value, event_id AS last_seq FROM r WHERE k = 1
""")
def q_latest_terminal(spark, d):
    ok = (F.col("event_type") == "purchase") & (F.col("value") < 40)
    return ledger.latest_terminal(t(spark, d, "events"), "user_id", "event_id", "event_type", ok)


@query("""
WITH g AS (SELECT user_id, epoch(ts) AS tt, event_id, coalesce((epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) > 3600)::INTEGER, 0) AS fresh FROM events),
i AS (SELECT user_id, tt, sum(fresh) OVER (PARTITION BY user_id ORDER BY tt, event_id) AS island FROM g)
SELECT user_id, island::BIGINT AS island, count(*) AS n FROM i GROUP BY ALL
""")
def q_gaps_islands(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "ts")
    return relational.islands(e, "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3600.0, "event_id").groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS receipt FROM nation""")
def q_record_digest(spark, d):
    return t(spark, d, "nation").select("n_nationkey", integrity.row_digest("n_nationkey", "n_name", "n_regionkey").alias("receipt"))


@query("SELECT n_regionkey, sha256(string_agg(n_nationkey || chr(0) || n_name, chr(10) ORDER BY n_nationkey)) AS digest FROM nation GROUP BY n_regionkey")
def q_ordered_digest(spark, d):
    return integrity.ordered_digest(t(spark, d, "nation"), "n_nationkey", "n_name", ["n_regionkey"])


@query("""
WITH b AS (SELECT p_partkey, p_size * 1.0 AS x0, (p_partkey % 40) * 1.0 AS y0, p_size + 10.0 AS x1, (p_partkey % 40) + 20.0 AS y1 FROM part),
i AS (SELECT *, greatest(0, least(x1, 40) - greatest(x0, 10)) * greatest(0, least(y1, 40) - greatest(y0, 10)) AS inter FROM b)
SELECT p_partkey, round(inter / (200 + 900 - inter), 9) AS iou, inter / (200 + 900 - inter) >= 0.15 AS hit, x0 >= 10 AND y0 >= 10 AND x1 <= 40 AND y1 <= 40 AS contained FROM i
""")
def q_bbox_iou(spark, d):
    x, y = F.col("p_size").cast("double"), (F.col("p_partkey") % 40).cast("double")
    box, fixed = F.array(x, y, x + 10, y + 20), F.array(*[F.lit(v) for v in (10.0, 10.0, 40.0, 40.0)])
    rows = t(spark, d, "part").select("p_partkey", box.alias("box"))
    v = geometry.iou(F.col("box"), fixed)
    return rows.select("p_partkey", F.round(v, 9).alias("iou"), (v >= 0.15).alias("hit"), geometry.contained(F.col("box"), fixed).alias("contained"))


@query("""
WITH j AS (SELECT l_orderkey, l_returnflag AS status, l_linestatus AS recorded FROM lineitem), k AS (SELECT l_orderkey, count(*) AS calls, count(DISTINCT status) AS verdicts, min(status) AS lo, max(status) AS hi FROM j GROUP BY 1)
SELECT CASE WHEN verdicts = 1 THEN 'agree:' || lo ELSE 'DISAGREE:' || lo || '/' || hi END AS key, count(*) AS n FROM k WHERE calls >= 2 GROUP BY 1
""")
def q_duplicate_concordance(spark, d):
    k = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("l_returnflag").alias("v"), F.min("l_returnflag").alias("lo"), F.max("l_returnflag").alias("hi")).filter("calls >= 2")
    key = F.when(F.col("v") == 1, F.concat(F.lit("agree:"), "lo")).otherwise(F.concat(F.lit("DISAGREE:"), "lo", F.lit("/"), "hi"))
    return k.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT coalesce(o_orderpriority, 'ALL') AS priority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 9) AS rate FROM orders GROUP BY ROLLUP (o_orderpriority)
""")
def q_prevalence_rollup(spark, d):
    done = F.count_if(F.col("o_orderstatus") == "F")
    return t(spark, d, "orders").rollup("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), done.alias("done"), F.round(done / F.count(F.lit(1)), 9).alias("rate")).withColumn("priority", F.coalesce("o_orderpriority", F.lit("ALL"))).drop("o_orderpriority")


@query("""
WITH j AS (SELECT *, list_filter([CASE WHEN l_quantity < 10 THEN 'quantity' END, CASE WHEN l_tax > 0.06 THEN 'tax' END, CASE WHEN l_discount > 0.08 THEN 'discount' END], lambda x: x IS NOT NULL) AS why FROM lineitem),
f AS (SELECT l_orderkey, arg_min(why, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS why FROM j WHERE len(why) > 0 GROUP BY l_orderkey), e AS (SELECT unnest(why) AS blocker FROM f) SELECT blocker, count(*) AS n FROM e GROUP BY blocker
""")
def q_first_blocker(spark, d):
    why = F.array_compact(F.array(F.when(F.col("l_quantity") < 10, "quantity"), F.when(F.col("l_tax") > 0.06, "tax"), F.when(F.col("l_discount") > 0.08, "discount")))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("o")
    rows = t(spark, d, "lineitem").select("l_orderkey", order, why.alias("why")).filter(F.size("why") > 0)
    first = rows.groupBy("l_orderkey").agg(F.min_by("why", "o").alias("why"))
    return first.select(F.explode("why").alias("blocker")).groupBy("blocker").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT coalesce(event_type, 'MISSING') AS status, count(*) AS n, round(avg(coalesce(value, 0)), 3) AS mean_value, count(*) FILTER (value IS NULL) AS unknown FROM events GROUP BY 1
""")
def q_status_counts(spark, d):
    return t(spark, d, "events").groupBy(F.coalesce("event_type", F.lit("MISSING")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("value", F.lit(0.0))), 3).alias("mean_value"), F.count_if(F.col("value").isNull()).alias("unknown"))


@query("""
WITH done AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), open AS (SELECT DISTINCT o_orderpriority AS needs FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01' AND o_orderkey NOT IN (FROM done)),
p AS (SELECT DISTINCT o_orderpriority AS phase FROM orders), deps AS (SELECT a.phase, b.phase AS needs FROM p a JOIN p b ON b.phase < a.phase)
SELECT phase FROM p WHERE phase NOT IN (SELECT phase FROM deps WHERE needs IN (FROM open))
""")
def q_ready_phases(spark, d):
    o = t(spark, d, "orders")
    tasks = o.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("phase"), "o_orderdate", "o_orderstatus")
    p = tasks.select("phase").distinct()
    deps = p.join(p.withColumnRenamed("phase", "needs"), F.col("needs") < F.col("phase"))
    done = tasks.filter("o_orderstatus = 'F' OR o_orderdate >= TIMESTAMP '1993-01-01'")
    return ledger.ready_phases(tasks.select("task_id", "phase"), deps, done)


@query(clopper_sql("SELECT lang, count(*) FILTER (toxic = 1) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang", "lang", 9))
def q_clopper_pearson(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    c = rows.groupBy("lang").agg(F.count_if(toxic()).alias("k"), F.count(F.lit(1)).alias("n"))
    return c.withColumn("ci", stats.clopper_pearson("k", "n")).select("lang", "k", "n", F.round("ci.low", 9).alias("low"), F.round("ci.high", 9).alias("high"))


@query()
def q_paired_bootstrap(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return stats.paired_bootstrap(rows, "lang", "doc_id", "quality", "toxic", seed=20260101, resamples=stats.RESAMPLES)


# the queries of the other modules register themselves
from . import census, contracts, gates, programs, records, runs, statistics  # noqa: E402, F401
