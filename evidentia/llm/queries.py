"""One query per operator, over its whole table; SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._common import table
from . import align, flac, hostrules, maintext, neardup, pairwise, phrases, repeats, segments, tokens, toxicity, warc


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(spark, warc.write_archives(table(spark, sf_dir, "pages")))


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(table(spark, sf_dir, "documents")).drop("failed", "host_closed")


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_features(flac.write_media(table(spark, sf_dir, "documents")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack_documents(table(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_boundaries(tokens.write_ids(table(spark, sf_dir, "documents")))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract_text(table(spark, sf_dir, "pages"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.rated_links(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_host_rules, op3_flac, op4_suffix_dedup, op5_minhash, op6_packing, op7_pairwise_quality, op8_nbest_pieces, op9_toxicity, op10_token_ids, op11_main_text, op12_token_alignment, op13_collocations)}

SQL: dict[str, str] = {}

SQL["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS last_page FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN g.last_page IS NULL OR g.last_page = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.last_page = d.page_id THEN NULL ELSE g.last_page END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes >= 1000
"""

SQL["op2_host_rules"] = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
f AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
s AS (SELECT *, base_failed OR 100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 50 * n_lines
        OR 100 * word_chars < 200 * n_words OR 100 * word_chars > 1500 * n_words AS failed FROM r),
h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS k FROM s GROUP BY source),
p AS (SELECT sum(k) / sum(n) AS mean, avg(k / n) AS m, var_pop(k / n) AS v FROM h),
q AS (SELECT mean, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 20.0 END AS weight FROM p),
c AS (SELECT source, (k + mean * weight) / (n + weight) >= 0.8 AS closed FROM h, q)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND NOT c.closed AS kept
FROM s JOIN c ON s.source IS NOT DISTINCT FROM c.source
"""

SQL["op13_collocations"] = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM t),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, ws, len(ws) AS size, unnest(range(1, len(ws) + 1)) AS i FROM p),
o AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM g, (VALUES (1), (2), (3), (4), (5)) AS o(k) WHERE i + k - 1 <= size),
f AS (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 100),
w AS (SELECT *, string_split(phrase, ' ') AS ws FROM f),
inner_ AS (SELECT lang, unnest([array_to_string(ws[1:k - 1], ' '), array_to_string(ws[2:k], ' ')]) AS phrase, f FROM w WHERE k > 2),
inside AS (SELECT lang, phrase, max(f) AS f FROM inner_ GROUP BY ALL),
kept AS (SELECT w.* FROM w LEFT JOIN inside USING (lang, phrase) WHERE w.k > 1 AND (inside.f IS NULL OR inside.f < w.f)),
cut AS (SELECT lang, phrase, f AS a, ws, k AS size, unnest(range(1, k)) AS k FROM kept),
s AS (SELECT cut.lang, cut.phrase, cut.a, x.f AS l, y.f AS r, n.n, cut.k, (1000::HUGEINT * cut.a * n.n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:cut.k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[cut.k + 1:size], ' ') JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""
