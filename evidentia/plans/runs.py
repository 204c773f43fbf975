"""Queries of runs: users are tasks, events their ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational, runs
from ._registry import query, t

_LEDGER = "SELECT event_id AS seq, user_id * 40 + event_id % 40 AS task, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'CALL_STARTED' ELSE 'CALL_TERMINAL' END AS kind, event_type = 'purchase' AS ok, CASE WHEN event_id % 500 = 0 THEN 'f2' ELSE 'f1' END AS frz FROM events"


def _ledger(spark, d):
    return spark.sql(_LEDGER.replace("FROM events", "FROM {rows}"), rows=t(spark, d, "events"))


@query(f"""
WITH e AS ({_LEDGER}), w AS (SELECT *, kind = 'CALL_TERMINAL' AND coalesce(max((kind = 'CALL_TERMINAL' AND ok)::INTEGER) OVER (PARTITION BY task ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS late FROM e),
g AS (SELECT task, count(*) FILTER (kind = 'CALL_STARTED') AS starts, count(*) FILTER (kind = 'CALL_TERMINAL') AS terminals, bool_or(late) AS late, count(DISTINCT frz) AS f FROM w GROUP BY task)
SELECT task, starts, terminals, CASE WHEN f > 1 THEN 'mixed_freeze' WHEN late THEN 'terminal_after_ok' WHEN terminals > starts THEN 'terminal_without_start' END AS reason FROM g
""")
def q_ledger_replay(spark, d):
    return runs.replayed(_ledger(spark, d), "task", "seq", F.col("ok"), "frz")


@query(f"""
WITH e AS ({_LEDGER}), g AS (SELECT task, count(*) FILTER (kind = 'CALL_STARTED') AS s, count(*) FILTER (kind = 'CALL_TERMINAL') AS n, bool_and(ok) FILTER (kind = 'CALL_TERMINAL') AS ok FROM e GROUP BY task), x AS (SELECT range AS task FROM range(0, 6400, 2)),
r AS (SELECT x.task, CASE WHEN x.task % 5 = 0 THEN 'not_in_plan' WHEN coalesce(s, 0) <> 1 THEN 'start_count' WHEN coalesce(n, 0) <> 1 THEN 'terminal_count' WHEN NOT coalesce(ok, false) THEN 'not_ok' END AS reason FROM x LEFT JOIN g ON g.task = x.task) SELECT *, reason IS NULL AS verified FROM r
""")
def q_import_verification(spark, d):
    selected = spark.range(0, 6400, 2).select(F.col("id").alias("task"))
    return runs.import_status(selected, _ledger(spark, d), selected.filter("task % 5 <> 0"), "task")


@query("SELECT o_custkey AS task, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING count(*) > 1")
def q_checkpoint_duplicates(spark, d):
    return runs.duplicates(t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("task")), "task")


@query(f"""
WITH e AS ({_LEDGER}), c AS (SELECT task, ok, frz = 'f1' AND seq % 3 <> 0 AS again FROM e WHERE kind = 'CALL_TERMINAL'), g AS (SELECT task, bool_or(ok) AS ok, bool_or(NOT ok AND NOT again) AS final, count(*) AS n FROM c GROUP BY task)
SELECT x.task, coalesce(n, 0) AS attempts, CASE WHEN n IS NULL THEN 'CALL' WHEN ok OR final THEN 'REUSE' WHEN n > 1 THEN 'EXHAUSTED' ELSE 'RETRY' END AS state FROM (SELECT DISTINCT task FROM e) x LEFT JOIN g USING (task)
""")
def q_call_cache(spark, d):
    e = _ledger(spark, d)
    calls = e.filter("kind = 'CALL_TERMINAL'").select("task", "ok", F.expr("frz = 'f1' AND seq % 3 <> 0").alias("retryable"))
    return runs.call_plan(e, calls, "task", 1)


@query("""
WITH k AS (SELECT o_orderkey AS task, o_orderpriority AS phase, o_custkey % 3 + 1 AS calls, o_orderstatus = 'F' AS done FROM orders)
SELECT phase, count(*) AS tasks, sum(calls)::BIGINT AS calls, count(*) FILTER (done) AS done, coalesce(sum(calls) FILTER (NOT done), 0)::BIGINT AS calls_left FROM k GROUP BY phase
""")
def q_resume_plan(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderpriority").alias("phase"), (F.col("o_custkey") % 3 + 1).alias("calls"), "o_orderstatus")
    return runs.resumable(o.drop("o_orderstatus"), o.filter("o_orderstatus = 'F'"), "task", "phase", "calls")


@query("SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey % 2 = 1 AND o_orderkey % 7 <> 0 AS importable FROM orders")
def q_import_completed(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("phase"), (F.col("o_custkey") % 2).alias("calls"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")).alias("origin_task"), F.lit("f").alias("origin_freeze"))
    return rows.select("o_orderkey", runs.importable(rows, ["1-URGENT", "2-HIGH"], ["origin_task", "origin_freeze"]).alias("importable"))


@query("SELECT conv_id, phase, arm, calls, phase || '::' || conv_id || '::' || arm AS task_id FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('construct', 'full', 2), ('construct', 'direct', 1), ('judge', 'full', 3), ('gates_off', 'full', 0)) AS a(phase, arm, calls)")
def q_phase_plan(spark, d):
    arms = spark.createDataFrame([("construct", "full", 2), ("construct", "direct", 1), ("judge", "full", 3), ("gates_off", "full", 0)], "phase string, arm string, calls int")
    return runs.phase_plan(t(spark, d, "conversations"), "conv_id", arms)


@query("""
WITH b AS (SELECT CASE WHEN c_acctbal < 0 THEN 'budget' END AS r FROM customer UNION ALL SELECT CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'roster' END FROM customer UNION ALL SELECT CASE WHEN c_nationkey > 99 THEN 'approval' END FROM customer)
SELECT coalesce(list_sort(list(DISTINCT r) FILTER (r IS NOT NULL)), []) AS blockers, CASE WHEN count(r) = 0 THEN 'READY' ELSE 'BLOCKED' END AS status FROM b
""")
def q_blockers(spark, d):
    return runs.blockers(t(spark, d, "customer"), {"budget": F.col("c_acctbal") < 0, "roster": F.col("c_mktsegment") == "HOUSEHOLD", "approval": F.col("c_nationkey") > 99})


@query("""
WITH g AS (SELECT l_orderkey, bool_or(l_tax > 0.07) AS bad, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_returnflag || l_linestatus) AS ls FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN bad THEN 'NOT_APPLICABLE' ELSE 'COMPLETE' END AS status, CASE WHEN NOT bad THEN array_to_string(list_transform(ls, lambda x, i: 'i' || i || ':' || x), ' ') END AS merged FROM g
""")
def q_merged_chunks(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_tax", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("label"))
    return runs.merged_chunks(rows, "l_orderkey", F.col("l_tax") > 0.07, "label", "l_linenumber")


_ANSWERS = "SELECT o_orderkey % 4000 AS item_id, o_orderstatus AS condition, sha256((o_orderkey % 4000) || o_orderstatus || CASE WHEN o_orderkey % 50 = 0 THEN 'x' ELSE '' END) AS package_sha256 FROM orders WHERE o_orderkey % 3 <> 0"
_PACKAGES = "SELECT DISTINCT o_orderkey % 4000 AS item_id, o_orderstatus AS condition, sha256((o_orderkey % 4000) || o_orderstatus) AS package_sha256 FROM orders WHERE o_orderkey % 7 <> 0"


def _answers(spark, d):
    o = t(spark, d, "orders").select((F.col("o_orderkey") % 4000).alias("item_id"), F.col("o_orderstatus").alias("condition"), "o_orderkey")
    sha = lambda tail: F.sha2(F.concat(F.col("item_id").cast("string"), "condition", tail), 256).alias("package_sha256")
    answers = o.filter("o_orderkey % 3 <> 0").select("item_id", "condition", sha(F.when(F.col("o_orderkey") % 50 == 0, "x").otherwise("")))
    return answers, o.filter("o_orderkey % 7 <> 0").select("item_id", "condition", sha(F.lit(""))).distinct()


_AGAINST = f"a AS ({_ANSWERS}), p AS ({_PACKAGES}), r AS (SELECT a.item_id, a.condition, CASE WHEN p.package_sha256 IS NULL THEN 'no_package' WHEN p.package_sha256 <> a.package_sha256 THEN 'package_receipt' WHEN count(*) OVER (PARTITION BY a.item_id, a.condition) > 1 THEN 'duplicate_identity' END AS reason FROM a LEFT JOIN p ON a.item_id = p.item_id AND a.condition = p.condition)"


@query(f"WITH {_AGAINST} SELECT * FROM r")
def q_answers_against_packages(spark, d):
    return runs.answers_against(*_answers(spark, d))


@query(f"WITH {_AGAINST}, m AS (SELECT count(*) AS missing FROM p WHERE condition IN ('F', 'O') AND NOT EXISTS (SELECT 1 FROM a WHERE a.item_id = p.item_id AND a.condition = p.condition)) SELECT count(*) AS records, count(reason) AS broken, min(reason) AS first_reason, any_value(missing) AS missing, CASE WHEN count(reason) = 0 AND any_value(missing) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r, m")
def q_verify_run(spark, d):
    return runs.run_verdict(*_answers(spark, d), ["F", "O"])


@query("""
WITH a AS (SELECT user_id, event_id % 9 = 0 AS abst, CASE WHEN event_id % 9 <> 0 THEN event_id % 4 END AS idx, event_id // 40 AS probe FROM events)
SELECT user_id, probe, bool_and(NOT abst AND coalesce(idx = user_id % 4, false)) AS correct, count(DISTINCT (abst, coalesce(idx, -1))) = 1 AS agrees FROM a GROUP BY ALL
""")
def q_control_scores(spark, d):
    a = t(spark, d, "events").select("user_id", (F.col("event_id") % 9 == 0).alias("abst"), F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 4).alias("idx"), F.expr("event_id div 40").alias("probe"))
    return a.groupBy("user_id", "probe").agg(*runs.scored(a, "user_id", F.col("abst"), F.col("idx"), F.col("user_id") % 4))


@query("SELECT l_orderkey, l_linenumber, l_orderkey AS parent, CASE WHEN o_orderkey IS NULL OR o_orderkey % 11 = 0 THEN 'WAIT' WHEN o_orderstatus = 'F' THEN 'RUN' ELSE 'NOT_APPLICABLE' END AS state FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def q_parent_link(spark, d):
    parents = t(spark, d, "orders").filter("o_orderkey % 11 <> 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "COMPLETE").otherwise(F.col("o_orderstatus")).alias("status"))
    children = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("parent"))
    return runs.routed(children, parents, "parent", "o_orderkey")


@query("SELECT c_custkey, list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'c_name' END, CASE WHEN c_custkey % 5 = 0 THEN 'c_mktsegment' END], lambda x: x IS NOT NULL) AS differs FROM customer")
def q_frozen_fields(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    other = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "other").otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return runs.differing(c, other, "c_custkey", ["c_name", "c_mktsegment"])


@query(r"SELECT page_id, rule FROM pages, (VALUES ('mail', '[a-z]+@[a-z]+\.[a-z]+'), ('script', '<script'), ('query', '\?page=[0-9]+')) AS r(rule, pattern) WHERE regexp_matches(html, pattern)")
def q_rule_matches(spark, d):
    rules = spark.createDataFrame([("mail", r"[a-z]+@[a-z]+\.[a-z]+"), ("script", "<script"), ("query", r"\?page=[0-9]+")], "rule string, pattern string")
    return runs.matches(t(spark, d, "pages").filter("html IS NOT NULL"), "page_id", "html", rules)


@query("SELECT p_brand AS chunk, arg_min(p_name, p_partkey) AS text FROM part WHERE p_size > 5 GROUP BY p_brand")
def q_first_text(spark, d):
    return t(spark, d, "part").filter("p_size > 5").groupBy(F.col("p_brand").alias("chunk")).agg(F.min_by("p_name", "p_partkey").alias("text"))


@query("SELECT name, name IN (SELECT n_name FROM nation) AS found FROM (VALUES ('NATION_0'), ('NATION_3'), ('NOWHERE')) AS v(name)")
def q_mandatory_members(spark, d):
    want = spark.createDataFrame([("NATION_0",), ("NATION_3",), ("NOWHERE",)], "name string")
    have = t(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit(True).alias("h")).distinct()
    return want.join(have, "name", "left").select("name", F.coalesce("h", F.lit(False)).alias("found"))


@query("""
WITH p AS (SELECT conv_id, role, min(turn) AS turn, count(*) AS n FROM conversations GROUP BY ALL)
SELECT conv_id, count(*) AS roles, count(*) FILTER (role = 'user') = 1 AND count(*) FILTER (role = 'assistant') = 1 AS complete, max(n) - min(n) <= 1 AS parity FROM p GROUP BY conv_id
""")
def q_corpus_parity(spark, d):
    p = t(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    one = lambda r: F.count_if(F.col("role") == r) == 1
    return p.groupBy("conv_id").agg(F.count(F.lit(1)).alias("roles"), (one("user") & one("assistant")).alias("complete"), (F.max("n") - F.min("n") <= 1).alias("parity"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN CASE WHEN contains(lower(text), 'th') THEN 'positive_answer_in_text' END ELSE CASE WHEN NOT contains(lower(text), 'an') THEN 'negative_answer_not_in_text' END END AS reason FROM benchmark")
def q_controls(spark, d):
    has = lambda w: F.contains(F.lower("text"), F.lit(w))
    positive = F.col("item_id") % 2 == 0
    return t(spark, d, "benchmark").select("item_id", relational.first_reason((positive & has("th"), "positive_answer_in_text"), (~positive & ~has("an"), "negative_answer_not_in_text")).alias("reason"))


@query("SELECT n_regionkey, count(*) AS n, count(*) = 5 AS balanced FROM nation GROUP BY n_regionkey")
def q_cardinality(spark, d):
    return t(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == 5).alias("balanced"))


@query("SELECT page_id, sha256(html) AS sha, CASE WHEN page_id % 9 = 0 THEN 'hash' WHEN page_id % 7 = 0 THEN 'missing' END AS reason FROM pages WHERE html IS NOT NULL")
def q_sidecars(spark, d):
    p = t(spark, d, "pages").filter("html IS NOT NULL")
    ledger = p.select("page_id", F.when(F.col("page_id") % 9 == 0, "0" * 64).otherwise(F.sha2(F.encode("html", "UTF-8"), 256)).alias("want"))
    files = p.filter("page_id % 7 <> 0 OR page_id % 9 = 0").select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("have"))
    reason = F.when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("want"), "hash")
    sha = p.select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("sha"))
    return ledger.join(files, "page_id", "left").join(sha, "page_id").select("page_id", "sha", reason.alias("reason"))


@query("SELECT p_partkey AS ordinal, left(p_name, 3) AS model, CASE WHEN p_size % 2 = 0 THEN 'judge-b' ELSE 'judge-a' END AS judge FROM part")
def q_judge_remap(spark, d):
    route = spark.createDataFrame([("old-0", "judge-b"), ("old-1", "judge-a")], "old string, judge string")
    p = t(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), F.left(F.col("p_name"), F.lit(3)).alias("model"), F.concat(F.lit("old-"), (F.col("p_size") % 2).cast("string")).alias("old"))
    return p.join(F.broadcast(route), "old").select("ordinal", "model", "judge")


@query("WITH r AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT g.event_type, count(r.user_id) AS users, bool_and(coalesce(n, 0) >= 5) AS enough FROM (SELECT DISTINCT event_type FROM events) g LEFT JOIN r USING (event_type) GROUP BY g.event_type")
def q_roster_cover(spark, d):
    r = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return r.groupBy("event_type").agg(F.count("user_id").alias("users"), F.bool_and(F.col("n") >= 5).alias("enough"))


@query("SELECT l.doc_id, l.quality AS control, d.n_chars % 2 AS perturbed, row_number() OVER (ORDER BY l.doc_id) AS position FROM labels l JOIN documents d USING (doc_id)")
def q_paired_in_order(spark, d):
    from ..operators import census

    rows = t(spark, d, "labels").select("doc_id", F.col("quality").alias("control")).join(t(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).alias("perturbed")), "doc_id")
    return census.ordinal(rows, ["doc_id"], F.expr("doc_id div 4096")).withColumnRenamed("ordinal", "position")


@query("SELECT a.doc_id, a.quality AS left_rating, b.toxic AS right_rating FROM labels a JOIN labels b USING (doc_id) WHERE a.doc_id % 2 = 0")
def q_rater_join(spark, d):
    left = t(spark, d, "labels").filter("doc_id % 2 = 0").select("doc_id", F.col("quality").alias("left_rating"))
    return left.join(t(spark, d, "labels").select("doc_id", F.col("toxic").alias("right_rating")), "doc_id")


@query("SELECT c_custkey, sha256(c_name) = sha256(c_name || CASE WHEN c_custkey % 4 = 0 THEN '!' ELSE '' END) AS same_digest FROM customer")
def q_source_digest(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("sha"))
    inventory = t(spark, d, "customer").select("c_custkey", F.sha2(F.concat("c_name", F.when(F.col("c_custkey") % 4 == 0, "!").otherwise("")), 256).alias("want"))
    return c.join(inventory, "c_custkey").select("c_custkey", (F.col("sha") == F.col("want")).alias("same_digest"))
